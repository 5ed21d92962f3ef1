"""Score logins as they arrive, with per-user state."""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from loginlens.functions.geo import EARTH_RADIUS_KM, valid_coordinates
from loginlens.operators.scoring import NEW_DEVICE
from loginlens.schema import EVENT, NEUTRAL, TIME, USER, VELOCITY_TIERS

SCORES = T.StructType([
    T.StructField(USER, T.StringType()), T.StructField(EVENT, T.LongType()),
    T.StructField(TIME, T.TimestampType()), T.StructField("total_logins", T.LongType()),
    T.StructField("device_score", T.DoubleType()), T.StructField("time_score", T.DoubleType()),
    T.StructField("velocity_score", T.DoubleType())])
_STATE = T.StructType([T.StructField("profile", T.StringType())])


def drop_repeats(logins: DataFrame, delay: str = "1 day") -> DataFrame:
    """Drop logins delivered more than once within the watermark delay."""
    return logins.withWatermark(TIME, delay).dropDuplicatesWithinWatermark([EVENT])


def _km(lat1: float, lon1: float, lat2: float, lon2: float) -> float:
    a = (math.sin(math.radians(lat2 - lat1) / 2) ** 2 + math.cos(math.radians(lat1))
         * math.cos(math.radians(lat2)) * math.sin(math.radians(lon2 - lon1) / 2) ** 2)
    a = min(a, 1.0)
    return round(EARTH_RADIUS_KM * 2 * math.atan2(math.sqrt(a), math.sqrt(1 - a)), 2)


def _empty() -> dict:
    return {"total": 0, "last": None, "place": None, "devices": {}, "hours": {}, "days": {}, "cells": {}}


def score_and_update(profile: dict, at: pd.Timestamp, lat: float, lon: float, device: str) -> tuple:
    """(total before, device, time, velocity score) of one login; then count it in.

    A login at or before the last one is scored 1.0 for velocity; one before it
    does not move the last known time or place. A cell keeps the coordinates that
    arrived first.
    """
    total, hour, day = profile["total"], str(at.hour), str(at.weekday())
    micros = at.value // 1000
    if total == 0:
        scores = (NEUTRAL, NEUTRAL, NEUTRAL)
    else:
        seen = profile["devices"].get(device, 0)
        device_score = 1.0 - (seen / total * 100) / 100 if seen else NEW_DEVICE
        time_score = 1.0 - (0.7 * (profile["hours"].get(hour, 0) / total)
                            + 0.3 * (profile["days"].get(day, 0) / total))
        hours = (micros - profile["last"]) / 3.6e9
        speed = _km(*profile["place"], lat, lon) / hours if hours > 0 else None
        velocity = 1.0 if speed is None else next((s for above, s in VELOCITY_TIERS if speed > above), 0.0)
        scores = (device_score, time_score, velocity)
    cell = "_".join(str(int(math.copysign(math.floor(abs(x) * 1000 + 0.5), x))) for x in (lat, lon))
    first = profile["cells"].setdefault(cell, [lat, lon])
    if profile["last"] is None or micros >= profile["last"]:
        profile["last"], profile["place"] = micros, first
    profile["total"] = total + 1
    for counter, key in (("devices", device), ("hours", hour), ("days", day)):
        profile[counter][key] = profile[counter].get(key, 0) + 1
    return (total, *scores)


def _score_user(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    if state.hasTimedOut:
        state.remove()
        return
    profile = json.loads(state.get[0]) if state.exists else _empty()
    rows = pd.concat(list(batches)).sort_values([TIME, EVENT])
    out = [(key[0], e, t, *score_and_update(profile, t, lat, lon, dev))
           for e, t, lat, lon, dev in zip(rows[EVENT], rows[TIME], rows["latitude"], rows["longitude"],
                                          rows["device_id"])]
    state.update((json.dumps(profile),))
    yield pd.DataFrame(out, columns=SCORES.fieldNames())


def stream_scores(logins: DataFrame) -> DataFrame:
    """Device, time and velocity scores of a login stream, in append mode.

    Within a micro-batch a user's logins are taken in time order; bound the
    micro-batch at the source (``maxFilesPerTrigger`` and the like). Rows without
    user, time or valid coordinates are passed over.
    """
    rows = logins.select(USER, EVENT, F.col(TIME).cast("timestamp").alias(TIME),
                         "latitude", "longitude", "device_id")
    rows = rows.where(F.col(USER).isNotNull() & F.col(TIME).isNotNull() & valid_coordinates())
    return rows.groupBy(USER).applyInPandasWithState(
        _score_user, SCORES, _STATE, "append", GroupStateTimeout.NoTimeout)
