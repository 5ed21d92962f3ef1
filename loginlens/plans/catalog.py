"""Every operator as a runnable query over the given tables, with its SQL twin.

A query takes (spark, directory of parquet tables) and returns a DataFrame.
Queries whose result SQL cannot express carry no twin.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loginlens.functions import clock, geo, stats, text
from loginlens.operators import (chunks, dbscan, geocode, identify, kmeans, layers, outliers, patterns, profiles,
                                 quality, replay, scoring, seeded)
from loginlens.operators.segments import latest
from loginlens.plans import oracle as o
from loginlens.plans.ingest import Snapshot, process_logins
from loginlens.plans.score import score_logins
from loginlens.schema import EVENT, TIME, USER, WEIGHTS
from loginlens.session import durable, run_dir, shuffled_joins, sized_as_rows
from loginlens.sources import checked, documents, encode, readers, sinks
from loginlens.sources.event_store import EventStore
from loginlens.sources.profile_log import ProfileLog
from loginlens.sources.event_logins import derive_logins, logins_from_events, raw_logins
from loginlens.streaming.ingest import stream_ingest
from loginlens.streaming.scores import drop_repeats, stream_scores

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

LATEST_N = 20
CHUNK_SIZE = 25
#: Buckets of the stores that queries make; a store of a 1000 times the events takes that many more.
CATALOG_BUCKETS = 8
TIME_TEXT = "yyyy-MM-dd HH:mm:ss.SSSSSS"


def query(name: str, body: str | None = None, *needs: str):
    def add(run: Query) -> Query:
        QUERIES[name] = run
        if body is not None:
            ORACLES[name] = o.sql(body, *needs)
        return run
    return add


# --- Inputs ------------------------------------------------------------------

def logins(spark, sf) -> DataFrame:
    sized_as_rows(spark)
    return logins_from_events(spark, sf)


def _before(df: DataFrame, moment: str) -> DataFrame:
    return df.where(F.col(TIME) < F.lit(moment).cast("timestamp_ntz"))


def _since(df: DataFrame, moment: str) -> DataFrame:
    return df.where(F.col(TIME) >= F.lit(moment).cast("timestamp_ntz"))


def hist(spark, sf) -> DataFrame:
    return _before(logins(spark, sf), o.CUTOFF)


def fresh(spark, sf) -> DataFrame:
    return _since(logins(spark, sf), o.CUTOFF)


def raw(spark, sf) -> DataFrame:
    return raw_logins(logins(spark, sf))


def scored(spark, sf) -> DataFrame:
    """Logins with a verdict from the replayed device, time and speed scores."""
    rows = logins(spark, sf)
    score = (F.col("device_score") * 0.2 + F.col("time_score") * 0.15 + F.col("velocity_score") * 0.2) / 0.55
    verdict = replay.replay_scores(rows).select(EVENT, score.alias("anomaly_score"))
    return rows.join(verdict, EVENT).withColumn("is_anomalous", F.col("anomaly_score") > 0.7)


def files_view(df: DataFrame) -> DataFrame:
    """Logins under the file-loader's column names."""
    return df.select(F.col(USER).alias("id"), "device_id", F.col(TIME).alias("login_time"), "latitude", "longitude")


def _plain_time(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in columns})


def dense_clusters(df: DataFrame) -> DataFrame:
    """Cluster statistics from density clustering alone, fixed once."""
    with shuffled_joins(df.sparkSession):
        return durable(patterns.cluster_stats(durable(dbscan.dbscan(df))))


# --- Sources and sinks -------------------------------------------------------

_FILE_ROWS = """SELECT user_id AS id, device_id, "timestamp" AS login_time, latitude, longitude FROM logins"""


@query("read_logins", _FILE_ROWS, "logins")
def _(spark, sf):
    path = run_dir(spark, "logins") + ".csv"
    _write_csv(files_view(logins(spark, sf)), path)
    return _plain_time(readers.read_logins(spark, path, timestampFormat=TIME_TEXT), "login_time")


def _write_csv(df, path, sep=","):
    df.write.options(header=True, sep=sep, timestampNTZFormat=TIME_TEXT).csv(path)


@query("scan_csv", _FILE_ROWS, "logins")
def _(spark, sf):
    path = run_dir(spark, "csv")
    _write_csv(files_view(logins(spark, sf)), path)
    rows = readers.scan_csv(spark, path, readers.FILE_SCHEMA, timestampFormat=TIME_TEXT)
    return _plain_time(rows, "login_time")


@query("scan_delimited", _FILE_ROWS, "logins")
def _(spark, sf):
    path = run_dir(spark, "text") + ".txt"
    _write_csv(files_view(logins(spark, sf)), path, sep=";")
    return _plain_time(readers.scan_delimited(spark, path, timestampFormat=TIME_TEXT), "login_time")


@query("scan_json", _FILE_ROWS, "logins")
def _(spark, sf):
    path = run_dir(spark, "json")
    files_view(logins(spark, sf)).write.option("timestampNTZFormat", TIME_TEXT).json(path)
    rows = readers.scan_json(spark, path, readers.FILE_SCHEMA, multi_line=False, timestampFormat=TIME_TEXT)
    return _plain_time(rows, "login_time")


@query("scan_json_envelope", """SELECT user_id, "timestamp", latitude, longitude, device_id, ip_address FROM logins""",
       "logins")
def _(spark, sf):
    path = run_dir(spark, "envelope")
    event = F.struct(USER, F.date_format(TIME, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias(TIME),
                     "latitude", "longitude", "device_id", "ip_address")
    # Envelopes of a bounded number of events each, one per line.
    envelope = F.struct(F.collect_list(event).alias("login_events"))
    rows = logins(spark, sf).groupBy(F.floor(F.col(EVENT) / 100).alias("part")).agg(F.to_json(envelope).alias("value"))
    rows.select("value").write.text(path)
    return _plain_time(readers.scan_json_envelope(spark, path, multi_line=False), TIME)


@query("scan_parquet", _FILE_ROWS, "logins")
def _(spark, sf):
    path = run_dir(spark, "table") + ".parquet"
    files_view(logins(spark, sf)).write.parquet(path)
    return readers.scan_parquet(spark, path)


@query("scan_feather", _FILE_ROWS, "logins")
def _(spark, sf):
    path = run_dir(spark, "feather")
    # The encoded files stay rows: (path, content), as a binary file scan gives.
    rows = _typed_time(files_view(logins(spark, sf)))
    encode.feather_files(rows).write.parquet(path)
    return _plain_time(readers.decode_feather(spark.read.parquet(path)), "login_time")


def _typed_time(df):
    return df.withColumn("login_time", F.col("login_time").cast("timestamp"))


@query("scan_excel", _FILE_ROWS, "logins")
def _(spark, sf):
    path = run_dir(spark, "excel")
    rows = files_view(logins(spark, sf)).withColumn("login_time", F.date_format("login_time", TIME_TEXT))
    encode.excel_files(rows).write.parquet(path)
    return _plain_time(readers.decode_excel(spark.read.parquet(path)), "login_time")


@query("scan_event_table", 'SELECT event_id, user_id, "timestamp", latitude, longitude, device_id, ip_address FROM logins',
       "logins")
def _(spark, sf):
    path = run_dir(spark, "events")
    sinks.append_login_events(sinks.login_events(logins(spark, sf)), path)
    return readers.scan_event_table(spark, path).select(*logins(spark, sf).columns)


_SPOILT = """
  SELECT event_id, CASE WHEN event_id % 113 = 0 THEN 'malformed' WHEN event_id % 71 = 0 THEN 'missing_device'
    WHEN event_id % 47 = 0 THEN 'bad_time'
    WHEN event_id % 53 = 0 OR event_id % 59 = 0 OR event_id % 61 = 0 OR event_id % 67 = 0 THEN 'bad_coordinates' END AS reason FROM raw"""


@query("scan_rejects", f"""
  SELECT format, event_id, coalesce(reason, 'valid') AS outcome
  FROM ({_SPOILT}), (SELECT unnest(['csv', 'json']) AS format)""", "raw")
def _(spark, sf):
    """Spoilt files: every row comes out once, as valid or with the reason why not."""
    work = run_dir(spark, "spoilt")
    rows = raw(spark, sf).select(EVENT, F.col(USER).alias("id"), "device_id", F.col(TIME).alias("login_time"), "latitude", "longitude")
    broken = F.col(EVENT) % 113 == 0
    # Without quotes a comma in the last field makes one field more.
    rows.withColumn("longitude", F.when(broken, F.concat("longitude", F.lit(",more"))).otherwise(F.col("longitude"))).write.csv(
        f"{work}/csv", header=True, quote="", emptyValue="", nullValue="")
    line = F.to_json(F.struct(*rows.columns))
    rows.select(F.when(broken, F.substring(line, 1, F.length(line) - 2)).otherwise(line)).write.text(f"{work}/json")
    outcomes = []
    for kind, found, number in (("csv", checked.scan_checked_csv(spark, f"{work}/csv", (EVENT,)), r"^(\d+),"),
                                ("json", checked.scan_checked_json(spark, f"{work}/json", (EVENT,)), r'"event_id":"?(\d+)')):
        outcomes.append(found.rows.select(EVENT, F.lit("valid").alias("outcome"), F.lit(kind).alias("format")))
        outcomes.append(found.rejects.select(F.regexp_extract("row", number, 1).alias(EVENT), F.col("reason").alias("outcome"),
                                             F.lit(kind).alias("format")))
    union = outcomes[0]
    for part in outcomes[1:]:
        union = union.unionByName(part)
    return union.select("format", F.col(EVENT).cast("bigint").alias(EVENT), "outcome")


@query("clean_logins", """
  SELECT event_id, user_id AS id, device_id, "timestamp" AS login_time, latitude, longitude FROM typed_raw
  WHERE latitude BETWEEN -90 AND 90 AND longitude BETWEEN -180 AND 180""", "typed_raw")
def _(spark, sf):
    files = raw(spark, sf).drop("ip_address").withColumnsRenamed({USER: "id", TIME: "login_time"})
    return _plain_time(quality.clean_file(files), "login_time")


@query("append_login_events", """
  SELECT l.event_id, l.user_id, l."timestamp", l.latitude, l.longitude, l.device_id, l.ip_address,
    coalesce(s.anomaly_score > 0.7::DOUBLE, false) AS is_anomalous, coalesce(s.anomaly_score, 0) AS anomaly_score,
    CASE WHEN s.event_id IS NULL THEN NULL ELSE '{}' END AS details
  FROM logins l LEFT JOIN (SELECT * FROM scored WHERE "timestamp" >= TIMESTAMP '2024-01-20 00:00:00') s
  ON s.event_id = l.event_id""", "scored")
def _(spark, sf):
    path = run_dir(spark, "append")
    results = _since(scored(spark, sf), o.CUTOFF).withColumnRenamed("anomaly_score", "combined_score")
    sinks.append_login_events(sinks.login_events(hist(spark, sf)), path)
    sinks.append_login_events(sinks.login_events(fresh(spark, sf), results), path)
    return spark.read.parquet(path).drop("login_date", "created_at")


@query("latest_events", f"""
  SELECT event_id, user_id, "timestamp", CAST(r AS INTEGER) AS recency FROM (
    SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY "timestamp" DESC, event_id DESC) AS r FROM logins)
  WHERE r <= {LATEST_N}""", "logins")
def _(spark, sf):
    return latest(logins(spark, sf).select(EVENT, USER, TIME), LATEST_N)


@query("get_profile", """
  SELECT t.user_id, total_logins, first_login, last_login, d.devices, c.locations
  FROM logins_totals t JOIN (SELECT user_id, count(*) AS devices FROM logins_devices GROUP BY user_id) d
    ON d.user_id = t.user_id JOIN (SELECT user_id, count(*) AS locations FROM logins_cells GROUP BY user_id) c
    ON c.user_id = t.user_id WHERE t.user_id IN (SELECT user_id FROM early)""",
       "logins_totals", "logins_devices", "logins_cells", "early")
def _(spark, sf):
    rows = logins(spark, sf)
    wanted = profiles.build_profile(rows).of_users(_before(rows, o.NOON_OF_FIRST_DAY))
    entries = profiles.nested_entries(wanted).groupBy(USER).agg(
        F.sum(F.size("devices")).alias("devices"), F.sum(F.size("locations")).alias("locations"))
    return profiles.nested_profile(wanted).select(USER, "total_logins", "first_login", "last_login").join(entries, USER)


@query("upsert_profiles", """
  SELECT * FROM hist_totals WHERE user_id NOT IN (SELECT user_id FROM fresh) UNION ALL SELECT * FROM fresh_totals""",
       "hist_totals", "fresh_totals")
def _(spark, sf):
    return sinks.upsert_snapshot(profiles.user_totals(hist(spark, sf)), profiles.user_totals(fresh(spark, sf)),
                                 run_dir(spark, "profiles"))


_CLUSTER_COLUMNS = """user_id, cluster, "count", round(percentage, 6) AS percentage,
  round(center_lat, 6) AS center_lat, round(center_lon, 6) AS center_lon, round(std_distance, 6) AS std_distance, num_clusters"""


@query("upsert_patterns", f"""
  SELECT {_CLUSTER_COLUMNS} FROM hist_clusters WHERE user_id NOT IN (SELECT user_id FROM fresh_clusters)
  UNION ALL SELECT {_CLUSTER_COLUMNS} FROM fresh_clusters""", "hist_clusters", "fresh_clusters")
def _(spark, sf):
    """All clusters of a user are replaced by those of the later logins."""
    old, new = dense_clusters(hist(spark, sf)), dense_clusters(fresh(spark, sf))
    return _rounded_clusters(sinks.upsert_snapshot(old, new, run_dir(spark, "patterns")))


@query("get_patterns", f"""
  SELECT {_CLUSTER_COLUMNS} FROM (
    SELECT * FROM logins_clusters
    UNION ALL SELECT * FROM hist_clusters WHERE user_id NOT IN (SELECT user_id FROM logins_clusters))
  WHERE user_id IN (SELECT user_id FROM early)""", "logins_clusters", "hist_clusters", "early")
def _(spark, sf):
    """Patterns of wanted users from the log, each user's from the newest batch that renewed them."""
    log, rows = ProfileLog(spark, run_dir(spark, "log")), logins(spark, sf)
    log.commit(0, {}, {"patterns": dense_clusters(hist(spark, sf))})
    log.commit(1, {}, {"patterns": dense_clusters(rows)})
    return _rounded_clusters(log.patterns(users=_before(rows, o.NOON_OF_FIRST_DAY)))


def _rounded_clusters(clusters):
    return clusters.select(USER, "cluster", "count", *[F.round(c, 6).alias(c) for c in (
        "percentage", "center_lat", "center_lon", "std_distance")], "num_clusters")


@query("nested_json_round_trip", 'SELECT user_id, device_id, "count", percentage FROM logins_devices', "logins_devices")
def _(spark, sf):
    devices = profiles.user_devices(logins(spark, sf)).select(
        USER, F.struct("device_id", "count", "percentage").alias("device"))
    kind = devices.schema["device"].dataType
    back = sinks.json_to_nested(sinks.nested_to_json(devices, "device"), "device", kind)
    return back.where("device_ok").select(USER, "device.*")


@query("geojson_sink", f"""
  SELECT event_id, user_id AS who, longitude AS lon, latitude AS lat, {o.FORMAT_TS} AS "time" FROM logins""", "logins")
def _(spark, sf):
    path = run_dir(spark, "geojson")
    features = layers.search_json(layers.search_features(logins(spark, sf)))
    named = features.select(F.concat(F.lit('{"id":'), F.col(EVENT).cast("string"), F.lit(","),
                                     F.expr("substring(feature, 2)")).alias("feature"))
    sinks.write_geojson(named, path)
    def get(p):
        return F.get_json_object("feature", p)
    return sinks.read_geojson(spark, path).select(
        get("$.id").cast("bigint").alias(EVENT), get("$.properties.user_id").alias("who"),
        get("$.geometry.coordinates[0]").cast("double").alias("lon"),
        get("$.geometry.coordinates[1]").cast("double").alias("lat"), get("$.properties.timestamp").alias("time"))


@query("extract_documents", """
  SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY n) - 1 AS INTEGER) AS "position", line AS "text"
  FROM (SELECT doc_id, unnest(string_split("text", chr(10))) AS line,
               unnest(range(0, len(string_split("text", chr(10))))) AS n FROM documents)
  WHERE regexp_matches(line, '\\S')""")
def _(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    blocks = documents.extract_documents(encode.word_files(docs))
    return blocks.select(F.regexp_extract("path", r"(\d+)", 1).cast("bigint").alias("doc_id"), "position", "text")


def _office_names(spark, sf):
    """Documents under office file names, kinds in rotation."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kinds = F.array(*[F.lit(e) for e in (".docx", ".XLSX", ".pptx", ".json", ".pdf", "")])
    name = F.concat(F.lit("/in/doc"), F.col("doc_id"), F.element_at(kinds, (F.col("doc_id") % 6 + 1).cast("int")))
    return docs.select("doc_id", name.alias("path"), F.encode("text", "UTF-8").alias("content"))


_KIND = """CASE doc_id % 6 WHEN 0 THEN 'word' WHEN 1 THEN 'excel' WHEN 2 THEN 'powerpoint' WHEN 3 THEN 'json' END"""


@query("document_bytes", f"""
  SELECT doc_id, {_KIND} AS file_type, CASE WHEN doc_id % 6 < 4 THEN 'ok' ELSE 'missing file type' END AS status,
    CASE WHEN doc_id % 6 < 4 THEN "text" END AS restored FROM documents""")
def _(spark, sf):
    named = _office_names(spark, sf)
    stored = named.select("doc_id", documents.file_type("path").alias("file_type"),
                          F.base64("content").alias("binary_content"))
    return documents.document_bytes(stored).select(
        "doc_id", "file_type", "status", F.decode("content", "UTF-8").alias("restored"))


@query("is_supported_format", "SELECT doc_id, doc_id % 6 < 4 AS supported FROM documents")
def _(spark, sf):
    return _office_names(spark, sf).select("doc_id", documents.is_supported_format("path").alias("supported"))


# --- Cleaning and filters ----------------------------------------------------

@query("parse_timestamps", 'SELECT event_id, "timestamp" FROM typed_raw', "typed_raw")
def _(spark, sf):
    return _plain_time(quality.parse_timestamps(raw(spark, sf).select(EVENT, TIME)), TIME)


@query("rejected_times", """SELECT event_id, "timestamp" FROM raw WHERE try_cast("timestamp" AS TIMESTAMP) IS NULL""",
       "raw")
def _(spark, sf):
    return quality.rejected_times(raw(spark, sf).select(EVENT, TIME))


@query("coerce_numeric", "SELECT event_id, latitude, longitude FROM typed_raw", "typed_raw")
def _(spark, sf):
    return quality.coerce_numeric(raw(spark, sf).select(EVENT, "latitude", "longitude"))


@query("drop_null_coords", """SELECT event_id, latitude, longitude FROM typed_raw
  WHERE latitude IS NOT NULL AND longitude IS NOT NULL""", "typed_raw")
def _(spark, sf):
    return quality.drop_null_coords(quality.coerce_numeric(raw(spark, sf).select(EVENT, "latitude", "longitude")))


@query("null_coord_counts", """SELECT count(*) AS "rows",
  count(*) FILTER (WHERE latitude IS NULL OR longitude IS NULL) AS dropped FROM typed_raw""", "typed_raw")
def _(spark, sf):
    return quality.null_coord_counts(quality.coerce_numeric(raw(spark, sf)))


@query("valid_coordinates", """SELECT event_id,
  coalesce(latitude BETWEEN -90 AND 90 AND longitude BETWEEN -180 AND 180, false) AS valid FROM typed_raw""", "typed_raw")
def _(spark, sf):
    rows = quality.coerce_numeric(raw(spark, sf).select(EVENT, "latitude", "longitude"))
    return rows.select(EVENT, geo.valid_coordinates().alias("valid"))


@query("default_columns", "SELECT event_id, false AS is_anomalous, 0.0::DOUBLE AS anomaly_score FROM logins", "logins")
def _(spark, sf):
    return quality.default_columns(logins(spark, sf).select(EVENT))


_FLAGS = """SELECT event_id, user_id IS NOT NULL AS has_user, device_id IS NOT NULL AS has_device,
  "timestamp" IS NOT NULL AS has_time,
  coalesce(latitude BETWEEN -90 AND 90 AND longitude BETWEEN -180 AND 180, false) AS has_coordinates,
  ip_address IS NULL OR ip_address NOT IN ('300.1.1.1', ':::', '1:2', '1::2::3', '2001:db8::12345') AS has_valid_ip FROM typed_raw"""


@query("login_quality", f"""SELECT *, has_user AND has_device AND has_time AND has_coordinates AND has_valid_ip AS is_valid
  FROM ({_FLAGS})""", "typed_raw")
def _(spark, sf):
    flagged = quality.quality_flags(quality.coerce_numeric(raw(spark, sf)))
    return flagged.select(EVENT, "has_user", "has_device", "has_time", "has_coordinates", "has_valid_ip", "is_valid")


@query("ensure_valid", f"""SELECT event_id FROM ({_FLAGS}) WHERE has_user AND has_device AND has_time
  AND has_coordinates AND has_valid_ip""", "typed_raw")
def _(spark, sf):
    return quality.ensure_valid(quality.coerce_numeric(raw(spark, sf))).select(EVENT)


@query("filter_user", "SELECT event_id, user_id FROM logins WHERE user_id = 'user3'", "logins")
def _(spark, sf):
    return quality.filter_user(logins(spark, sf), "user3").select(EVENT, USER)


@query("date_range_filter", """SELECT event_id, "timestamp" FROM logins
  WHERE "timestamp" BETWEEN (SELECT max("timestamp") FROM logins) - INTERVAL 7 DAY
  AND (SELECT max("timestamp") FROM logins)""", "logins")
def _(spark, sf):
    return quality.date_range_filter(logins(spark, sf).select(EVENT, TIME), days=7)


@query("split_known_new_users", """SELECT DISTINCT user_id, user_id IN (SELECT user_id FROM early) AS known FROM later""",
       "early", "later")
def _(spark, sf):
    rows = logins(spark, sf)
    stored = profiles.user_totals(_before(rows, o.NOON_OF_FIRST_DAY))
    later = _since(rows, o.NOON_OF_FIRST_DAY).select(USER).distinct()
    return (quality.known_users(later, stored).withColumn("known", F.lit(True))
            .unionByName(quality.new_users(later, stored).withColumn("known", F.lit(False))))


@query("anomalies_only", "SELECT event_id, user_id, anomaly_score FROM scored WHERE is_anomalous", "scored")
def _(spark, sf):
    return quality.anomalies_only(scored(spark, sf)).select(EVENT, USER, "anomaly_score")


# --- Joins -------------------------------------------------------------------

@query("last_known_place", "SELECT user_id, prev_lat, prev_lon FROM hist_place", "hist_place")
def _(spark, sf):
    return scoring.last_place(profiles.build_profile(hist(spark, sf)))


@query("orphan_events", """SELECT event_id, user_id FROM later WHERE user_id NOT IN (SELECT user_id FROM early)""",
       "later", "early")
def _(spark, sf):
    rows = logins(spark, sf)
    return profiles.orphans(_since(rows, o.NOON_OF_FIRST_DAY).select(EVENT, USER),
                            profiles.user_totals(_before(rows, o.NOON_OF_FIRST_DAY)))


# --- Profiles ----------------------------------------------------------------

@query("user_totals", "SELECT * FROM logins_totals", "logins_totals")
def _(spark, sf):
    return profiles.user_totals(logins(spark, sf))


@query("user_devices", "SELECT * FROM logins_devices", "logins_devices")
def _(spark, sf):
    return profiles.user_devices(logins(spark, sf))


@query("user_locations", "SELECT * EXCLUDE (ord) FROM logins_cells", "logins_cells")
def _(spark, sf):
    return profiles.user_locations(logins(spark, sf)).drop("first_order")


@query("user_hours", "SELECT * FROM logins_hours", "logins_hours")
def _(spark, sf):
    return profiles.user_hours(logins(spark, sf))


@query("user_days", "SELECT * FROM logins_days", "logins_days")
def _(spark, sf):
    return profiles.user_days(logins(spark, sf))


def _rounded(df: DataFrame, places: int = 6) -> DataFrame:
    return df.select(*[F.round(f.name, places).alias(f.name) if f.dataType.typeName() == "double" else F.col(f.name)
                       for f in df.schema.fields])


_GAP_SQL = ", ".join(f"round({c}, 6) AS {c}" for c in profiles.GAP_FIELDS)
_SPREAD_SQL = ", ".join(f"round(std_distance, 6) AS {c}" for c in profiles.SPREAD_FIELDS)


@query("login_gaps", f"SELECT user_id, {_GAP_SQL} FROM logins_gaps", "logins_gaps")
def _(spark, sf):
    return _rounded(profiles.login_gaps(logins(spark, sf)))


@query("geo_mean_center", """SELECT user_id, points, round(center_lat, 6) AS center_lat,
  round(center_lon, 6) AS center_lon FROM logins_centers""", "logins_centers")
def _(spark, sf):
    return _rounded(profiles.geo_mean_center(logins(spark, sf), USER))


@query("standard_distance", """SELECT user_id, points, round(center_lat, 6) AS center_lat,
  round(center_lon, 6) AS center_lon, round(std_distance, 6) AS std_distance FROM logins_spread""", "logins_spread")
def _(spark, sf):
    return _rounded(profiles.standard_distance(logins(spark, sf), USER))


@query("geo_variance", f"SELECT user_id, {_SPREAD_SQL} FROM logins_spread", "logins_spread")
def _(spark, sf):
    return _rounded(profiles.geo_variance(logins(spark, sf)))


def _flat_sql(src: str, totals: str, gaps: str) -> str:
    """Flat profile of ``src``; metrics come from the table prefix ``gaps``."""
    return f"""
  SELECT t.user_id, total_logins, first_login, last_login, d.devices, d.top_device_logins, c.locations, h.top_hour,
    w.top_day, {_GAP_SQL}, {_SPREAD_SQL}
  FROM {totals} t
  JOIN (SELECT user_id, count(*) AS devices, max("count") AS top_device_logins FROM {src}_devices GROUP BY user_id) d
    ON d.user_id = t.user_id
  JOIN (SELECT user_id, count(*) AS locations FROM {src}_cells GROUP BY user_id) c ON c.user_id = t.user_id
  JOIN (SELECT user_id, max_by("hour", ROW("count", -"hour")) AS top_hour FROM {src}_hours GROUP BY user_id) h
    ON h.user_id = t.user_id
  JOIN (SELECT user_id, max_by("day", ROW("count", -"day")) AS top_day FROM {src}_days GROUP BY user_id) w
    ON w.user_id = t.user_id
  JOIN {gaps}_gaps g ON g.user_id = t.user_id JOIN {gaps}_spread s ON s.user_id = t.user_id"""


_FLAT_TABLES = [f"logins_{t}" for t in ("totals", "devices", "cells", "hours", "days", "gaps", "spread")]


@query("user_profile", f"""
  SELECT 'user' AS part, * FROM ({_flat_sql("logins", "logins_totals", "logins")})
  UNION ALL BY NAME SELECT 'device' AS part, * FROM logins_devices
  UNION ALL BY NAME SELECT 'location' AS part, * EXCLUDE (ord) FROM logins_cells
  UNION ALL BY NAME SELECT 'hour' AS part, * FROM logins_hours
  UNION ALL BY NAME SELECT 'day' AS part, * FROM logins_days""", *_FLAT_TABLES)
def _(spark, sf):
    """All of a profile: a row of totals and metrics per user, and a row per device, cell, hour and weekday."""
    whole = profiles.build_profile(logins(spark, sf), whole=True)
    return profiles.with_entries(_rounded(profiles.flat_profile(whole)), whole)


@query("merge_profiles", _flat_sql("logins", "logins_totals", "logins"), *_FLAT_TABLES)
def _(spark, sf):
    """Profile of the history merged with the later batch equals the profile of both."""
    rows = logins(spark, sf)
    old = profiles.build_profile(_before(rows, o.CUTOFF))
    return _rounded(profiles.flat_profile(profiles.merge_profiles(old, _since(rows, o.CUTOFF), rows)))


@query("apply_logins", _flat_sql("logins", "logins_totals", "hist"), *_FLAT_TABLES, "hist_gaps", "hist_spread")
def _(spark, sf):
    """Counters move with scored logins, metrics stay as they were."""
    rows = logins(spark, sf)
    old = profiles.build_profile(_before(rows, o.CUTOFF))
    return _rounded(profiles.flat_profile(profiles.apply_logins(old, _since(rows, o.CUTOFF))))


_CLUSTER_SQL = """SELECT user_id, cluster, "count", round(percentage, 6) AS percentage,
  round(center_lat, 6) AS center_lat, round(center_lon, 6) AS center_lon, round(std_distance, 6) AS std_distance,
  num_clusters FROM {}_clusters"""


@query("cluster_stats", _CLUSTER_SQL.format("logins"), "logins_clusters")
def _(spark, sf):
    return _rounded(dense_clusters(logins(spark, sf)))


@query("cluster_breakdown", """
  SELECT user_id, cluster, 'device' AS part, device_id AS "key", count(*) AS "count" FROM logins_real GROUP BY ALL
  UNION ALL SELECT user_id, cluster, 'hour', CAST(hour("timestamp") AS VARCHAR), count(*) FROM logins_real GROUP BY ALL
  UNION ALL SELECT user_id, cluster, 'day', CAST(isodow("timestamp") - 1 AS VARCHAR), count(*) FROM logins_real
  GROUP BY ALL""", "logins_real")
def _(spark, sf):
    labelled = durable(dbscan.dbscan(logins(spark, sf)))
    parts = (("device", patterns.cluster_devices(labelled), "device_id"),
             ("hour", patterns.cluster_hours(labelled), "hour"), ("day", patterns.cluster_days(labelled), "day"))
    out = None
    for name, table, key in parts:
        rows = table.select(USER, "cluster", F.lit(name).alias("part"), F.col(key).cast("string").alias("key"), "count")
        out = rows if out is None else out.unionByName(rows)
    return out


@query("ingest_stats", """SELECT count(DISTINCT user_id) AS users_processed,
  count(DISTINCT user_id) FILTER (WHERE user_id NOT IN (SELECT user_id FROM early)) AS new_users,
  count(DISTINCT user_id) FILTER (WHERE user_id IN (SELECT user_id FROM early)) AS updated_users FROM later""",
       "later", "early")
def _(spark, sf):
    rows = logins(spark, sf)
    return profiles.ingest_stats(_since(rows, o.NOON_OF_FIRST_DAY),
                                 profiles.user_totals(_before(rows, o.NOON_OF_FIRST_DAY)))


@query("map_center", """SELECT round(avg(latitude), 6) AS center_lat, round(avg(longitude), 6) AS center_lon FROM logins""",
       "logins")
def _(spark, sf):
    return _rounded(profiles.map_center(logins(spark, sf)))


@query("distinct_users", "SELECT DISTINCT user_id FROM logins", "logins")
def _(spark, sf):
    return quality.distinct_users(logins(spark, sf))


_COV_COLUMNS = ("mean_lat", "mean_lon", "mean_hour", "cov_xx", "cov_xy", "cov_xh", "cov_yy", "cov_yh", "cov_hh")


@query("covariance_stats", "SELECT user_id, n, " + ", ".join(f"round({c}, 6) AS {c}" for c in _COV_COLUMNS)
       + " FROM hist_cov", "hist_cov")
def _(spark, sf):
    return _rounded(outliers.covariance_stats(hist(spark, sf)))


_DAYS = """CAST(floor(date_diff('microsecond', min("timestamp"), max("timestamp")) / 86400000000::DOUBLE) AS BIGINT)"""


@query("time_extent", f"""SELECT user_id, min("timestamp") AS first_time, max("timestamp") AS last_time,
  {_DAYS} AS span_days FROM logins GROUP BY user_id""", "logins")
def _(spark, sf):
    return profiles.time_extent(logins(spark, sf), USER)


@query("longitude_range", """SELECT user_id, count(*) AS points, max(longitude) - min(longitude) AS lon_range
  FROM logins GROUP BY user_id""", "logins")
def _(spark, sf):
    return profiles.longitude_range(logins(spark, sf))


# --- Windows, order, top-k ---------------------------------------------------

@query("gap_to_next", f"""SELECT * FROM (SELECT user_id, event_id, "timestamp",
  {o.hours('"timestamp"', 'lead("timestamp") OVER (PARTITION BY user_id ORDER BY "timestamp", event_id)')} AS gap_h
  FROM logins) WHERE gap_h IS NOT NULL""", "logins")
def _(spark, sf):
    return profiles.gap_to_next(logins(spark, sf))


@query("trajectory_segments", """SELECT * FROM (SELECT user_id, event_id, "timestamp", longitude AS from_lon,
  latitude AS from_lat, lead(longitude) OVER w AS to_lon, lead(latitude) OVER w AS to_lat FROM logins
  WINDOW w AS (PARTITION BY user_id ORDER BY "timestamp", event_id)) WHERE to_lon IS NOT NULL""", "logins")
def _(spark, sf):
    return layers.trajectory_segments(logins(spark, sf))


@query("elbow_k", """
  SELECT user_id, CAST(coalesce(max_by(k, ROW(bend, -k)) FILTER (WHERE bend IS NOT NULL) + 1, 2) AS INTEGER) AS best_k
  FROM (SELECT user_id, k, (lead(inertia, 2) OVER w - lead(inertia, 1) OVER w) - (lead(inertia, 1) OVER w - inertia)
          AS bend
        FROM (SELECT user_id, CAST("hour" % 9 + 1 AS INTEGER) AS k, sum("count")::DOUBLE AS inertia
              FROM logins_hours GROUP BY ALL) WINDOW w AS (PARTITION BY user_id ORDER BY k)) GROUP BY user_id""",
       "logins_hours")
def _(spark, sf):
    # Hour counters folded to nine steps stand for inertias.
    steps = profiles.user_hours(logins(spark, sf)).groupBy(USER, (F.col("hour") % 9 + 1).alias("k")).agg(
        F.sum("count").cast("double").alias("inertia"))
    return patterns.elbow_k(steps)


@query("replay_prefix", """SELECT event_id, user_id, total_logins, device_count, hour_count, day_count, last_login,
  prev_lat, prev_lon FROM replay_state""", "replay_state")
def _(spark, sf):
    return replay.replay_state(logins(spark, sf)).select(
        EVENT, USER, "total_logins", "device_count", "hour_count", "day_count", "last_login", "prev_lat", "prev_lon")


@query("chunk_id", f"""SELECT event_id, user_id, CAST(floor((row_number() OVER (PARTITION BY user_id
  ORDER BY "timestamp", event_id) - 1) / {CHUNK_SIZE}) AS BIGINT) AS chunk_id FROM logins""", "logins")
def _(spark, sf):
    return chunks.chunk_id(logins(spark, sf).select(EVENT, USER, TIME), CHUNK_SIZE).drop(TIME)


@query("sort_logins", _FILE_ROWS, "logins")
def _(spark, sf):
    return quality.clean_file(files_view(logins(spark, sf)), order=True)


@query("sort_time", 'SELECT event_id, user_id, "timestamp" FROM logins', "logins")
def _(spark, sf):
    return quality.sort_time(logins(spark, sf).select(EVENT, USER, TIME))


@query("top_n_recent", f"""SELECT event_id, user_id, "timestamp" FROM logins WHERE user_id = 'user3'
  ORDER BY "timestamp" DESC, event_id DESC LIMIT {LATEST_N}""", "logins")
def _(spark, sf):
    mine = quality.filter_user(logins(spark, sf), "user3").select(EVENT, USER, TIME)
    return mine.orderBy(F.desc(TIME), F.desc(EVENT)).limit(LATEST_N)


# --- Scalar functions --------------------------------------------------------

@query("haversine_km", f"""SELECT event_id, {o.haversine('latitude', 'longitude', '51.5::DOUBLE', '-0.15::DOUBLE')} AS km
  FROM logins""", "logins")
def _(spark, sf):
    return logins(spark, sf).select(
        EVENT, geo.haversine_km("latitude", "longitude", F.lit(51.5), F.lit(-0.15)).alias("km"))


@query("shift_antimeridian", "SELECT event_id, user_id, longitude, lon_unwrapped FROM logins_unwrapped",
       "logins_unwrapped")
def _(spark, sf):
    return profiles.shift_antimeridian(logins(spark, sf)).select(EVENT, USER, "longitude", "lon_unwrapped")


_CYCLIC = ("hour_sin", "hour_cos", "day_sin", "day_cos")


@query("cyclic_time", "SELECT event_id, " + ", ".join(f"round({c}, 6) + 0.0 AS {c}" for c in _CYCLIC)
       + " FROM logins_features", "logins_features")
def _(spark, sf):
    columns = {n: F.round(c, 6) + 0.0 for n, c in clock.cyclic_time().items()}
    return logins(spark, sf).select(EVENT, *[c.alias(n) for n, c in columns.items()])


@query("location_key", f"""SELECT event_id, {o.cell('latitude')} AS cell_lat, {o.cell('longitude')} AS cell_lon,
  CAST(round(latitude, 3) AS VARCHAR) || '_' || CAST(round(longitude, 3) AS VARCHAR) AS "key" FROM logins""", "logins")
def _(spark, sf):
    return logins(spark, sf).select(EVENT, geo.cell_lat().alias("cell_lat"), geo.cell_lon().alias("cell_lon"),
                                    geo.location_key().alias("key"))


@query("sigmoid_z", f"SELECT event_id, round({o.sigmoid('latitude / 10')}, 6) AS score FROM logins", "logins")
def _(spark, sf):
    return logins(spark, sf).select(EVENT, F.round(stats.sigmoid_z(F.col("latitude") / 10), 6).alias("score"))


@query("chi2_cdf_3", f"SELECT event_id, round({o.chi2_cdf_3('abs(longitude) / 4')}, 6) AS p FROM logins", "logins")
def _(spark, sf):
    return logins(spark, sf).select(EVENT, F.round(stats.chi2_cdf_3(F.abs("longitude") / 4), 6).alias("p"))


@query("format_timestamp", f"SELECT event_id, {o.FORMAT_TS} AS plain, {o.FORMAT_TS} AS from_iso FROM logins", "logins")
def _(spark, sf):
    iso = F.concat(F.date_format(TIME, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"),
                   F.when(F.col(EVENT) % 2 == 0, "Z").otherwise("+05:30"))
    return logins(spark, sf).select(EVENT, clock.format_timestamp(TIME).alias("plain"),
                                    clock.format_iso_text(iso).alias("from_iso"))


@query("anonymize_ip", """
  SELECT event_id, CASE event_id % 5
    WHEN 0 THEN CASE k WHEN '0' THEN '2001:db8::' ELSE '2001:db8:' || k || '::' END
    WHEN 1 THEN '010.1.1.1' ELSE regexp_replace(ip_address, '[0-9]+$', '0') END AS network
  FROM (SELECT *, split_part(ip_address, '.', 3) AS k FROM logins)""", "logins")
def _(spark, sf):
    k = F.split_part("ip_address", F.lit("."), F.lit(3))
    ip = (F.when(F.col(EVENT) % 5 == 0, F.concat(F.lit("2001:db8:"), k, F.lit(":2::5")))
          .when(F.col(EVENT) % 5 == 1, "010.1.1.1").otherwise(F.col("ip_address")))
    return logins(spark, sf).select(EVENT, text.anonymize_ip(ip).alias("network"))


@query("merge_maps", """
  SELECT coalesce(f.user_id, h.user_id) AS user_id, coalesce(f."hour", h."hour") AS "hour",
    coalesce(f."count", h."count") AS "count"
  FROM hist_hours h FULL JOIN fresh_hours f ON f.user_id = h.user_id AND f."hour" = h."hour" """,
       "hist_hours", "fresh_hours")
def _(spark, sf):
    def maps(df, name):
        pairs = F.map_from_entries(F.collect_list(F.struct("hour", "count")))
        return profiles.user_hours(df).groupBy(USER).agg(pairs.alias(name))
    both = maps(hist(spark, sf), "a").join(maps(fresh(spark, sf), "b"), USER, "full")
    merged = text.merge_maps("a", "b", both.schema["a"].dataType)
    return both.select(USER, F.explode(merged).alias("hour", "count"))


@query("unique_id")
def _(spark, sf):
    return logins(spark, sf).select(EVENT, text.unique_id().alias("id"))


@query("unique_id_shape", """SELECT count(*) AS ids, count(*) AS different, count(*) AS well_formed FROM logins""", "logins")
def _(spark, sf):
    ids = logins(spark, sf).select(text.unique_id().alias("id"))
    shape = "^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$"
    return ids.agg(F.count("*").alias("ids"), F.count_distinct("id").alias("different"),
                   F.count_if(F.col("id").rlike(shape)).alias("well_formed"))


@query("stable_id", "SELECT event_id, sha256(CAST(event_id AS VARCHAR) || '|' || user_id) AS id FROM logins", "logins")
def _(spark, sf):
    return logins(spark, sf).select(EVENT, text.stable_id(EVENT, USER).alias("id"))


@query("dow_hour", f'SELECT event_id, {o.hour()} AS "hour", {o.day()} AS "day" FROM logins', "logins")
def _(spark, sf):
    return logins(spark, sf).select(EVENT, clock.login_hour().alias("hour"), clock.login_day().alias("day"))


@query("clip01", "SELECT event_id, greatest(0, least(1, latitude / 45)) AS clipped FROM logins", "logins")
def _(spark, sf):
    return logins(spark, sf).select(EVENT, stats.clip01(F.col("latitude") / 45).alias("clipped"))


_POPUP = f"""'User ID: ' || {o.escape_html('user_id')} || '<br>Device ID: ' || {o.escape_html('device_id')}
  || '<br>Timestamp: ' || {o.FORMAT_TS} || '<br>Coordinates: [' || printf('%.5f', latitude) || ', '
  || printf('%.5f', longitude) || ']<br>Anomaly: ' || {o.YES_NO}
  || '<br>Anomaly Score: ' || printf('%.4f', anomaly_score)"""


@query("popup_text", f"SELECT event_id, {_POPUP} AS popup FROM scored", "scored")
def _(spark, sf):
    return scored(spark, sf).select(EVENT, text.popup_text().alias("popup"))


# --- Features and models -----------------------------------------------------

@query("login_features", """SELECT event_id, user_id, latitude, lon_unwrapped, round(hour_sin, 6) + 0.0 AS hour_sin,
  round(hour_cos, 6) + 0.0 AS hour_cos, round(day_sin, 6) + 0.0 AS day_sin, round(day_cos, 6) + 0.0 AS day_cos,
  device_id FROM logins_features""", "logins_features")
def _(spark, sf):
    rows = patterns.login_features(logins(spark, sf))
    return rows.select(EVENT, USER, "latitude", "lon_unwrapped", "device_id",
                       *[(F.round(c, 6) + 0.0).alias(c) for c in _CYCLIC])


@query("device_one_hot", """SELECT event_id, user_id, 'device_' || device_id AS feature, 1 AS "value" FROM logins""",
       "logins")
def _(spark, sf):
    return patterns.device_indicators(logins(spark, sf))


@query("standardize", "SELECT event_id, user_id, " + ", ".join(
    f"round({c}_z, 4) + 0.0 AS {c}_z" for c in patterns.NUMERIC) + " FROM logins_z", "logins_z")
def _(spark, sf):
    rows = patterns.standardize(logins(spark, sf))
    return rows.select(EVENT, USER, *[(F.round(f"{c}_z", 4) + 0.0).alias(f"{c}_z") for c in patterns.NUMERIC])


_Z_DIST = " + ".join(f"({c}_z - lag({c}_z) OVER w) * ({c}_z - lag({c}_z) OVER w)" for c in patterns.NUMERIC)


@query("pair_distance", f"""
  SELECT user_id, event_id, round(d, 4) AS distance FROM (
    SELECT z.user_id, z.event_id, sqrt({_Z_DIST} + CASE WHEN z.device_id = lag(z.device_id) OVER w THEN 0
             ELSE weight + lag(weight) OVER w END) AS d
    FROM logins_z z JOIN (SELECT user_id, device_id, CASE WHEN percentage >= 100 THEN 0.0::DOUBLE
        ELSE 1 / (percentage / 100 * (1 - percentage / 100)) END AS weight FROM logins_devices) s
      ON s.user_id = z.user_id AND s.device_id = z.device_id
    WINDOW w AS (PARTITION BY z.user_id ORDER BY z."timestamp", z.event_id)) WHERE d IS NOT NULL""",
       "logins_z", "logins_devices")
def _(spark, sf):
    return _rounded(patterns.distance_to_previous(logins(spark, sf)), 4)


@query("dbscan_core", "SELECT user_id, event_id FROM logins_core", "logins_core")
def _(spark, sf):
    return dbscan.core_logins(logins(spark, sf)).select(USER, EVENT)


@query("dbscan", "SELECT user_id, event_id, cluster FROM logins_labels", "logins_labels")
def _(spark, sf):
    return dbscan.dbscan(logins(spark, sf)).select(USER, EVENT, "cluster")


@query("kmeans_fallback")
def _(spark, sf):
    rows = logins(spark, sf)
    undivided = identify.undivided_users(dbscan.dbscan(rows))
    return kmeans.kmeans(rows.join(undivided, USER, "left_semi"))


@query("isolation_forest_score")
def _(spark, sf):
    return outliers.isolation_forest_scores(fresh(spark, sf), hist(spark, sf))


@query("isolation_forest_gate", """
  SELECT f.event_id, f.user_id, coalesce(n.c >= 10, false) AS learned, true AS in_range
  FROM fresh f LEFT JOIN (SELECT user_id, count(*) AS c FROM hist GROUP BY user_id) n ON n.user_id = f.user_id""",
       "fresh", "hist")
def _(spark, sf):
    rows = outliers.isolation_forest_scores(fresh(spark, sf), hist(spark, sf))
    learned = F.col("message").isNull()
    score = F.col("isolation_forest_score")
    return rows.select(EVENT, USER, learned.alias("learned"),
                       (score.between(0, 1) & (learned | (score == scoring.NEUTRAL))).alias("in_range"))


@query("mahalanobis_score", """
  SELECT f.event_id, f.user_id, CASE WHEN n.n >= 5 THEN n.degenerate END AS degenerate,
    CASE WHEN n.n >= 5 THEN round(m.d, 6) END AS distance,
    CASE WHEN coalesce(n.n, 0) < 5 THEN 0.5 ELSE round(m.score, 6) END AS score
  FROM fresh f LEFT JOIN hist_model n ON n.user_id = f.user_id
  LEFT JOIN fresh_mahalanobis m ON m.event_id = f.event_id""", "fresh_mahalanobis")
def _(spark, sf):
    rows = outliers.with_mahalanobis(fresh(spark, sf), outliers.mahalanobis_model(hist(spark, sf)))
    # The figure of a degenerate model hangs on the last bits of its ridge, so its rows show the flag alone.
    degenerate = F.col("mahalanobis_details.degenerate")
    sound = ~F.coalesce(degenerate, F.lit(False))
    return rows.select(
        EVENT, USER, degenerate.alias("degenerate"),
        F.when(sound, F.round("mahalanobis_details.mahalanobis_distance", 6)).alias("distance"),
        F.when(sound, F.round("mahalanobis_score", 6)).alias("score"))


@query("identify_patterns")
def _(spark, sf):
    return identify.identify_patterns(logins(spark, sf))


# --- Scoring -----------------------------------------------------------------

@query("score_location", """SELECT event_id, user_id, km AS distance_km, cluster AS closest_cluster,
  round(std_distance, 6) AS cluster_std_distance, round(z, 4) AS z_score, round(score, 6) AS score
  FROM fresh_location
  UNION ALL SELECT event_id, user_id, NULL, NULL, NULL, NULL, 0.5 FROM fresh
  WHERE user_id NOT IN (SELECT user_id FROM hist_clusters)""", "fresh_location")
def _(spark, sf):
    return _location(spark, sf, dense_clusters(hist(spark, sf)))


@query("score_location_all_users")
def _(spark, sf):
    return _location(spark, sf, identify.identify_patterns(hist(spark, sf)))


def _location(spark, sf, clusters):
    rows = scoring.with_location(fresh(spark, sf), clusters)
    d = F.col("location_details")
    return rows.select(EVENT, USER, d["distance_km"].alias("distance_km"),
                       d["closest_cluster"].alias("closest_cluster"),
                       F.round(d["cluster_std_distance"], 6).alias("cluster_std_distance"),
                       F.round(d["z_score"], 4).alias("z_score"), F.round("location_score", 6).alias("score"))


@query("score_device", "SELECT * FROM fresh_device", "fresh_device")
def _(spark, sf):
    rows = scoring.with_device(fresh(spark, sf), profiles.user_devices(hist(spark, sf)))
    return rows.select(EVENT, USER, F.col("device_score").alias("score"), "device_details.device_status",
                       "device_details.previous_usage_count", "device_details.previous_usage_percent")


@query("score_time", "SELECT * FROM fresh_time", "fresh_time")
def _(spark, sf):
    rows = scoring.with_time(fresh(spark, sf), profiles.build_profile(hist(spark, sf)))
    return rows.select(EVENT, USER, F.col("time_score").alias("score"), *[
        F.col(f"time_details.{c}").alias(c) for c in
        ("login_hour", "login_day", "hour_frequency", "day_frequency", "hour_count", "day_count")])


@query("score_velocity", """SELECT event_id, user_id, score, CASE WHEN gap_h > 0 THEN km END AS distance_km,
  CASE WHEN gap_h > 0 THEN gap_h END AS time_diff_hours, CASE WHEN gap_h > 0 THEN km / gap_h END AS velocity_km_h
  FROM fresh_velocity""", "fresh_velocity")
def _(spark, sf):
    rows = scoring.with_velocity(fresh(spark, sf), profiles.build_profile(hist(spark, sf)))
    return rows.select(EVENT, USER, F.col("velocity_score").alias("score"), "velocity_details.distance_km",
                       "velocity_details.time_diff_hours", "velocity_details.velocity_km_h")


_COMBINED = """(((((0.0::DOUBLE + {location} * 0.25::DOUBLE) + {device} * 0.2::DOUBLE) + {time} * 0.15::DOUBLE)
  + {velocity} * 0.2::DOUBLE) + {forest} * 0.1::DOUBLE) + {mahalanobis} * 0.1::DOUBLE"""


@query("combine_scores", "SELECT event_id, user_id, c AS combined_score, c > 0.7::DOUBLE AS is_anomalous FROM ("
       "SELECT event_id, user_id, " + _COMBINED.format(
           location="0.5::DOUBLE", device="device_score", time="time_score", velocity="velocity_score",
           forest="0.5::DOUBLE", mahalanobis="0.5::DOUBLE") + " AS c FROM replay)", "replay")
def _(spark, sf):
    parts = replay.replay_scores(logins(spark, sf))
    neutral = {f"{n}_score": F.lit(scoring.NEUTRAL) for n in WEIGHTS if f"{n}_score" not in parts.columns}
    return scoring.combine_scores(parts.withColumns(neutral)).select(EVENT, USER, "combined_score", "is_anomalous")


@query("cold_start", """
  SELECT l.event_id, l.user_id, t.user_id IS NOT NULL AS stored,
    CASE WHEN t.user_id IS NULL THEN 0.5::DOUBLE WHEN d."count" IS NULL THEN 0.9::DOUBLE
         ELSE 1 - d.percentage / 100 END AS device_score
  FROM later l LEFT JOIN early_totals t ON t.user_id = l.user_id
  LEFT JOIN early_devices d ON d.user_id = l.user_id AND d.device_id = l.device_id""",
       "later", "early_totals", "early_devices")
def _(spark, sf):
    rows = logins(spark, sf)
    early = _before(rows, o.NOON_OF_FIRST_DAY)
    out = scoring.with_device(_since(rows, o.NOON_OF_FIRST_DAY), profiles.user_devices(early))
    out = out.join(profiles.user_totals(early), USER, "left")
    cold = F.col("total_logins").isNull()
    return out.select(EVENT, USER, (~cold).alias("stored"),
                      F.when(cold, scoring.NEUTRAL).otherwise(F.col("device_score")).alias("device_score"))


@query("advanced_gate", """
  SELECT l.event_id, l.user_id, coalesce(n.n >= 10, false) AS scored,
    coalesce(g.degenerate AND n.n >= 10, false) AS degenerate,
    round(CASE WHEN n.n >= 10 THEN m.score ELSE 0.5::DOUBLE END, 6) AS score
  FROM after_start l LEFT JOIN start_cov n ON n.user_id = l.user_id
  LEFT JOIN start_model g ON g.user_id = l.user_id LEFT JOIN after_start_mahalanobis m ON m.event_id = l.event_id""", "after_start_mahalanobis")
def _(spark, sf):
    rows = logins(spark, sf)
    model = outliers.mahalanobis_model(_before(rows, o.FIFTH_DAY))
    out = outliers.with_mahalanobis(_since(rows, o.FIFTH_DAY), model, min_rows=10)
    gated = F.col("mahalanobis_details.message").isNull()
    degenerate = F.coalesce("mahalanobis_details.degenerate", F.lit(False))
    return out.select(EVENT, USER, gated.alias("scored"), degenerate.alias("degenerate"),
                      F.when(~degenerate, F.round("mahalanobis_score", 6)).alias("score"))


def _analysis(spark, sf, isolation: bool):
    past = hist(spark, sf)
    clusters = dense_clusters(past) if not isolation else durable(identify.identify_patterns(past))
    return scoring.analyze_logins(fresh(spark, sf), profiles.build_profile(past), clusters, past, isolation)


@query("analyze_logins_native", """
  SELECT event_id, user_id, stored, stored AND coalesce(degenerate, false) AS degenerate,
    round(c, 6) AS combined_score, c > 0.7::DOUBLE AS is_anomalous,
    CASE WHEN stored THEN round(location, 6) ELSE 0.5 END AS location_score,
    CASE WHEN stored THEN round(device, 6) ELSE 0.5 END AS device_score,
    CASE WHEN stored THEN round("time", 6) ELSE 0.5 END AS time_score,
    CASE WHEN stored THEN velocity ELSE 0.5 END AS velocity_score,
    CASE WHEN stored THEN round(mahalanobis, 6) ELSE 0.5 END AS mahalanobis_score
  FROM (SELECT *, CASE WHEN stored THEN """ + _COMBINED.format(
      location="location", device="device", time='"time"', velocity="velocity", forest="0.5::DOUBLE",
      mahalanobis="mahalanobis") + """ ELSE 0.5 END AS c
    FROM (SELECT * REPLACE (CASE WHEN coalesce(degenerate, false) AND n >= 10 THEN NULL ELSE mahalanobis END AS mahalanobis,
                            coalesce(degenerate, false) AND n >= 10 AS degenerate) FROM fresh_scores))""",
       "fresh_scores")
def _(spark, sf):
    out = _analysis(spark, sf, isolation=False)
    # As in mahalanobis_score: what hangs on a degenerate model is left null, its row and the other scores stay.
    degenerate = F.coalesce("mahalanobis_details.degenerate", F.lit(False))
    sure = lambda c: F.when(~degenerate, c)
    return out.select(
        EVENT, USER, "stored", degenerate.alias("degenerate"), sure(F.col("is_anomalous")).alias("is_anomalous"),
        sure(F.round("combined_score", 6)).alias("combined_score"), sure(F.round("mahalanobis_score", 6)).alias("mahalanobis_score"),
        *[F.round(f"{n}_score", 6).alias(f"{n}_score") for n in WEIGHTS if n not in ("isolation_forest", "mahalanobis")])


@query("analyze_logins")
def _(spark, sf):
    return _analysis(spark, sf, isolation=True).drop(*[f"{n}_details" for n in WEIGHTS])


@query("detector_details", """
  SELECT s.event_id, s.user_id, s.stored, CASE WHEN s.stored THEN l.km END AS distance_km,
    CASE WHEN s.stored THEN l.cluster END AS closest_cluster,
    CASE WHEN s.stored THEN round(l.std_distance, 6) END AS cluster_std_distance,
    CASE WHEN s.stored THEN round(l.z, 4) END AS z_score,
    CASE WHEN s.stored THEN d.device_status END AS device_status,
    CASE WHEN s.stored THEN d.previous_usage_count END AS previous_usage_count,
    CASE WHEN s.stored THEN d.previous_usage_percent END AS previous_usage_percent,
    CASE WHEN s.stored THEN t.login_hour END AS login_hour, CASE WHEN s.stored THEN t.login_day END AS login_day,
    CASE WHEN s.stored THEN t.hour_frequency END AS hour_frequency,
    CASE WHEN s.stored THEN t.day_frequency END AS day_frequency,
    CASE WHEN s.stored THEN t.hour_count END AS hour_count, CASE WHEN s.stored THEN t.day_count END AS day_count,
    CASE WHEN s.stored AND v.gap_h > 0 THEN v.km END AS moved_km,
    CASE WHEN s.stored AND v.gap_h > 0 THEN round(v.gap_h, 6) END AS time_diff_hours,
    CASE WHEN s.stored AND v.gap_h > 0 THEN v.prev_lat END AS prev_lat,
    CASE WHEN s.stored AND v.gap_h > 0 THEN v.prev_lon END AS prev_lon
  FROM fresh_scores s LEFT JOIN fresh_location l ON l.event_id = s.event_id
  JOIN fresh_device d ON d.event_id = s.event_id JOIN fresh_time t ON t.event_id = s.event_id
  JOIN fresh_velocity v ON v.event_id = s.event_id""", "fresh_scores")
def _(spark, sf):
    return _details(_analysis(spark, sf, isolation=False))


@query("detector_details_all_users")
def _(spark, sf):
    return _details(_analysis(spark, sf, isolation=True))


def _details(out):
    return out.select(
        EVENT, USER, "stored", "location_details.distance_km", "location_details.closest_cluster",
        F.round("location_details.cluster_std_distance", 6).alias("cluster_std_distance"),
        F.round("location_details.z_score", 4).alias("z_score"),
        "device_details.device_status", "device_details.previous_usage_count", "device_details.previous_usage_percent",
        *[f"time_details.{c}" for c in ("login_hour", "login_day", "hour_frequency", "day_frequency", "hour_count", "day_count")],
        F.col("velocity_details.distance_km").alias("moved_km"),
        F.round("velocity_details.time_diff_hours", 6).alias("time_diff_hours"),
        "velocity_details.prev_lat", "velocity_details.prev_lon")


_REPLAY_SQL = """SELECT event_id, user_id, "timestamp", total_logins, device_score, time_score, velocity_score FROM replay"""


@query("replay_scores", _REPLAY_SQL, "replay")
def _(spark, sf):
    return replay.replay_scores(logins(spark, sf)).drop("device_count", "hour_count", "day_count")


_STATE = ("total_logins", "device_count", "hour_count", "day_count")


@query("replay_from_snapshot", f"""
  SELECT event_id, user_id, stored, {", ".join(f"CASE WHEN stored THEN {c} END AS {c}" for c in _STATE)},
    stored AND degenerate AS degenerate, round(c, 6) AS combined_score, c > 0.7::DOUBLE AS is_anomalous,
    CASE WHEN stored THEN round(location, 6) ELSE 0.5 END AS location_score,
    CASE WHEN stored THEN round(device, 6) ELSE 0.5 END AS device_score,
    CASE WHEN stored THEN round("time", 6) ELSE 0.5 END AS time_score,
    CASE WHEN stored THEN velocity ELSE 0.5 END AS velocity_score,
    CASE WHEN stored THEN round(mahalanobis, 6) ELSE 0.5 END AS mahalanobis_score
  FROM (SELECT *, CASE WHEN stored THEN """ + _COMBINED.format(
      location="location", device="device", time='"time"', velocity="velocity", forest="0.5::DOUBLE",
      mahalanobis="mahalanobis") + """ ELSE 0.5 END AS c FROM fresh_replayed)""", "fresh_replayed")
def _(spark, sf):
    """Each fresh login against its user's state just before it, from the snapshot of the history on."""
    past = hist(spark, sf)
    out = seeded.replay_from_snapshot(fresh(spark, sf), seeded.Seed.of(past), dense_clusters(past))
    degenerate = F.coalesce("mahalanobis_details.degenerate", F.lit(False))
    sure = lambda c: F.when(~degenerate, c)
    return out.select(
        EVENT, USER, "stored", *[F.when(F.col("stored"), F.col(c)).alias(c) for c in _STATE],
        degenerate.alias("degenerate"), sure(F.col("is_anomalous")).alias("is_anomalous"),
        sure(F.round("combined_score", 6)).alias("combined_score"), sure(F.round("mahalanobis_score", 6)).alias("mahalanobis_score"),
        *[F.round(f"{n}_score", 6).alias(f"{n}_score") for n in WEIGHTS if n not in ("isolation_forest", "mahalanobis")])


@query("replay_from_snapshot_all_users")
def _(spark, sf):
    """All six scores of the fresh logins; the patterns are renewed on the fifth day and at the end of the history."""
    rows, past = logins(spark, sf), hist(spark, sf)
    first = _before(rows, o.FIFTH_DAY)
    versions = identify.identify_patterns(first).withColumn(seeded.SINCE, F.lit(o.FIFTH_DAY).cast("timestamp_ntz")).unionByName(
        identify.identify_patterns(past).withColumn(seeded.SINCE, F.lit(o.CUTOFF).cast("timestamp_ntz")))
    out = seeded.replay_from_snapshot(_since(rows, o.FIFTH_DAY), seeded.Seed.of(first), durable(versions), rows)
    return out.drop(*[f"{n}_details" for n in WEIGHTS])


@query("replay_velocity", f"""SELECT event_id, user_id, "timestamp", CASE WHEN gap_h <= 0 THEN 1.0::DOUBLE
  ELSE {o.tiers('speed')} END AS velocity_score FROM replay_speed WHERE last_login IS NOT NULL""", "replay_speed")
def _(spark, sf):
    return replay.replay_velocity(logins(spark, sf)).select(EVENT, USER, TIME, "velocity_score")


@query("impossible_travel", f"""SELECT * FROM (SELECT event_id, user_id, "timestamp", km AS distance_km,
  gap_h AS time_diff_hours, speed AS velocity_km_h, {o.tiers('speed')} AS velocity_score
  FROM replay_speed WHERE gap_h > 0) WHERE velocity_score >= 0.9::DOUBLE""", "replay_speed")
def impossible_travel(spark, sf):
    return replay.impossible_travel(logins(spark, sf))


@query("process_logins", """SELECT count(DISTINCT user_id) AS users_processed,
  count(DISTINCT user_id) FILTER (WHERE user_id NOT IN (SELECT user_id FROM early)) AS new_users,
  count(DISTINCT user_id) FILTER (WHERE user_id IN (SELECT user_id FROM early)) AS updated_users FROM later""",
       "later", "early")
def _(spark, sf):
    store, rows = run_dir(spark, "store"), logins(spark, sf)
    process_logins(_before(rows, o.NOON_OF_FIRST_DAY), store, 0, None, buckets=CATALOG_BUCKETS)
    return process_logins(_since(rows, o.NOON_OF_FIRST_DAY), store, 1, 0)


@query("process_logins_patterns", f"""
  SELECT {_CLUSTER_COLUMNS} FROM logins_clusters WHERE user_id IN (
    SELECT user_id FROM logins_labels GROUP BY user_id HAVING count(DISTINCT cluster) > 1)""", "logins_clusters")
def _(spark, sf):
    """Patterns after three batches, of the users with density clusters of their own (the others' come from k-means)."""
    store, rows = run_dir(spark, "store"), logins(spark, sf)
    early, late = _before(rows, o.FIFTH_DAY), _since(rows, o.CUTOFF)
    batches = [_before(_since(rows, o.FIFTH_DAY), o.CUTOFF), early, late]
    for i, batch in enumerate(batches):
        process_logins(batch, store, i, i - 1 if i else None, buckets=CATALOG_BUCKETS)
    divided = durable(dbscan.dbscan(rows)).groupBy(USER).agg(F.countDistinct("cluster").alias("n")).where("n > 1")
    return _rounded_clusters(Snapshot.read(spark, f"{store}/snapshots/2").patterns.join(divided, USER, "left_semi"))


@query("score_logins", """
  SELECT s.event_id, s.user_id, d.device_status, d.previous_usage_count, l.cluster AS closest_cluster,
    t.total_logins + n.c AS total_after
  FROM fresh_scores s JOIN fresh_device d ON d.event_id = s.event_id JOIN fresh_location l ON l.event_id = s.event_id
  JOIN hist_totals t ON t.user_id = s.user_id
  JOIN (SELECT user_id, count(*) AS c FROM fresh_scores WHERE stored GROUP BY user_id) n ON n.user_id = s.user_id
  WHERE s.stored""", "fresh_scores")
def _(spark, sf):
    return _scored_and_stored(spark, sf, dense_clusters(hist(spark, sf)), isolation=False)


@query("score_logins_all_users")
def _(spark, sf):
    return _scored_and_stored(spark, sf, identify.identify_patterns(hist(spark, sf)), isolation=True)


def _scored_and_stored(spark, sf, clusters, isolation: bool):
    store, past = run_dir(spark, "scored"), hist(spark, sf)
    kept = EventStore.open(spark, store, CATALOG_BUCKETS)
    kept.append(sinks.login_events(past), 0)
    ProfileLog(spark, store).commit_seed(0, seeded.Seed.of(past, whole=True), clusters)
    score_logins(fresh(spark, sf), store, 1, 0, isolation=isolation)
    found = lambda path: F.get_json_object("details", path)
    events = kept.batch(1)
    after = ProfileLog(spark, store).read("totals", 1).select(USER, F.col("total_logins").alias("total_after"))
    return events.select(
        EVENT, USER, found("$.device_details.device_status").alias("device_status"),
        found("$.device_details.previous_usage_count").cast("bigint").alias("previous_usage_count"),
        found("$.location_details.closest_cluster").cast("int").alias("closest_cluster")).join(after.hint("merge"), USER)


# --- Streaming ---------------------------------------------------------------

def _login_stream(spark, sf, **options):
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    reader = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").options(**options)
    return derive_logins(reader.parquet(sf))


def _run_to_end(writer, path, checkpoint):
    writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path).awaitTermination()


@query("stream_scores", _REPLAY_SQL, "replay")
def _(spark, sf):
    work = run_dir(spark, "stream")
    scores = stream_scores(_login_stream(spark, sf, maxFilesPerTrigger=1))
    _run_to_end(scores.writeStream.format("parquet").outputMode("append"), f"{work}/out", f"{work}/state")
    return _plain_time(spark.read.parquet(f"{work}/out"), TIME)


@query("stream_drop_repeats", "SELECT event_id, user_id FROM logins", "logins")
def _(spark, sf):
    work = run_dir(spark, "repeats")
    rows = _login_stream(spark, sf).withColumn(TIME, F.col(TIME).cast("timestamp")).select(EVENT, USER, TIME)
    twice = rows.unionByName(rows)
    _run_to_end(drop_repeats(twice, "60 days").writeStream.format("parquet").outputMode("append"),
                f"{work}/out", f"{work}/state")
    return spark.read.parquet(f"{work}/out").drop(TIME)


@query("stream_ingest", _flat_sql("logins", "logins_totals", "logins"), *_FLAT_TABLES)
def _(spark, sf):
    """Three files, a micro-batch each; the last snapshot is merged from all."""
    work = run_dir(spark, "ingest")
    events = spark.read.parquet(f"{sf}/events.parquet")
    part = F.when(F.col("ts") < F.lit(o.FIFTH_DAY).cast("timestamp_ntz"), 0).when(
        F.col("ts") < F.lit(o.CUTOFF).cast("timestamp_ntz"), 1).otherwise(2)
    for i in (1, 0, 2):  # the second batch is late
        events.where(part == i).coalesce(1).write.mode("append").parquet(f"{work}/in")
    stream = derive_logins(spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{work}/in"))
    writer = stream_ingest(stream, f"{work}/store", f"{work}/state", buckets=CATALOG_BUCKETS)
    writer.trigger(availableNow=True).start().awaitTermination()
    return _rounded(profiles.flat_profile(Snapshot.read(spark, f"{work}/store/snapshots/2").profile))


# --- Map layers and addresses ------------------------------------------------

@query("heatmap_points", "SELECT event_id, latitude, longitude, anomaly_score * 10 AS weight FROM scored", "scored")
def _(spark, sf):
    return layers.heatmap_points(scored(spark, sf))


@query("heatmap_grid", f"""SELECT {o.cell('latitude')} AS cell_lat, {o.cell('longitude')} AS cell_lon,
  count(*) AS points, round(sum(anomaly_score * 10), 6) AS weight FROM scored GROUP BY ALL""", "scored")
def _(spark, sf):
    return _rounded(layers.heatmap_grid(scored(spark, sf)))


_STYLE = """CASE WHEN is_anomalous THEN 'red' ELSE 'blue' END AS fill_color,
  CASE WHEN is_anomalous THEN 8 ELSE 5 END AS radius"""


@query("geojson_points", f"""SELECT event_id, user_id, "timestamp", longitude AS lon, latitude AS lat,
  {o.FORMAT_TS} AS "time", {_STYLE}, 'User: ' || {o.escape_html('user_id')} || '<br>Device: '
  || {o.escape_html('device_id')} || '<br>Time: ' || {o.FORMAT_TS} || '<br>Anomaly: ' || {o.YES_NO}
  || '<br>Score: ' || printf('%.4f', anomaly_score) AS popup FROM scored""", "scored")
def _(spark, sf):
    return layers.geojson_points(scored(spark, sf))


@query("search_features", f"""SELECT event_id, user_id, device_id, longitude AS lon, latitude AS lat,
  {o.FORMAT_TS} AS "time", {o.YES_NO} AS is_anomalous, anomaly_score, 'User: ' || user_id AS name FROM scored""",
       "scored")
def _(spark, sf):
    return layers.search_features(scored(spark, sf))


@query("trajectory_lines", f"""SELECT event_id, user_id, from_lon, from_lat, to_lon, to_lat, "time" FROM (
  SELECT event_id, user_id, longitude AS from_lon, latitude AS from_lat, lead(longitude) OVER w AS to_lon,
    lead(latitude) OVER w AS to_lat, {o.FORMAT_TS} AS "time" FROM logins
  WINDOW w AS (PARTITION BY user_id ORDER BY "timestamp", event_id)) WHERE to_lon IS NOT NULL""", "logins")
def _(spark, sf):
    lines = layers.trajectory_lines(layers.trajectory_segments(logins(spark, sf)))
    def number(path):
        return F.get_json_object("feature", f"$.geometry.coordinates{path}").cast("double")
    return lines.select(EVENT, USER, number("[0][0]").alias("from_lon"), number("[0][1]").alias("from_lat"),
                        number("[1][0]").alias("to_lon"), number("[1][1]").alias("to_lat"),
                        F.get_json_object("feature", "$.properties.time").alias("time"))


@query("animation_settings", f"""
  SELECT user_id, span_days, CASE WHEN span_days > 30 THEN 'P1D' WHEN span_days > 7 THEN 'PT12H'
      WHEN span_days > 1 THEN 'PT3H' ELSE 'PT30M' END AS period,
    CASE WHEN span_days > 30 THEN 'P5D' WHEN span_days > 7 THEN 'P1D' WHEN span_days > 1 THEN 'PT12H'
      ELSE 'PT3H' END AS duration
  FROM (SELECT user_id, {_DAYS} AS span_days FROM logins GROUP BY user_id)""", "logins")
def _(spark, sf):
    return layers.animation_settings(logins(spark, sf), USER)


@query("marker_rows", f"""SELECT event_id, user_id, latitude, longitude,
  CASE WHEN is_anomalous THEN 'Anomalous Logins' ELSE 'Standard Logins' END AS layer,
  CASE WHEN is_anomalous THEN 'red' ELSE 'blue' END AS icon_color,
  CASE WHEN is_anomalous THEN 'exclamation-circle' ELSE 'user' END AS icon,
  CASE WHEN is_anomalous THEN 'Anomaly' ELSE 'Standard' END || ': User ' || {o.escape_html('user_id')} AS tooltip,
  {_POPUP} AS popup FROM scored""", "scored")
def _(spark, sf):
    return layers.marker_rows(scored(spark, sf))


@query("marker_layers", """SELECT CASE WHEN is_anomalous THEN 'Anomalous Logins' ELSE 'Standard Logins' END AS layer,
  count(*) AS markers FROM scored GROUP BY ALL
  UNION ALL SELECT 'User ' || user_id, count(*) FROM scored GROUP BY user_id""", "scored")
def _(spark, sf):
    return layers.marker_layers(layers.marker_rows(scored(spark, sf)))


@query("geocode_addresses", """
  SELECT DISTINCT address, CASE WHEN n_nationkey IS NOT NULL THEN n_nationkey * 2.0::DOUBLE END AS latitude,
    CASE WHEN n_nationkey IS NOT NULL THEN n_nationkey * -5.0::DOUBLE END AS longitude
  FROM (SELECT '  ' || c_mktsegment || ' ,  Nation ' || c_nationkey AS address, c_mktsegment, c_nationkey FROM customer)
  LEFT JOIN (SELECT n_nationkey FROM nation WHERE n_nationkey < 20) ON n_nationkey = c_nationkey""")
def _(spark, sf):
    customers = spark.read.parquet(f"{sf}/customer.parquet")
    addresses = customers.select(F.concat(F.lit("  "), F.col("c_mktsegment"), F.lit(" ,  Nation "),
                                          F.col("c_nationkey").cast("string")).alias("address"))
    # The gazetteer knows every segment of the first twenty nations.
    nations = spark.read.parquet(f"{sf}/nation.parquet").where("n_nationkey < 20")
    known = nations.join(customers.select("c_mktsegment", F.col("c_nationkey").alias("n_nationkey")).distinct(),
                         "n_nationkey")
    gazetteer = known.select(
        F.concat(F.lower("c_mktsegment"), F.lit(", nation "), F.col("n_nationkey").cast("string")).alias("address"),
        (F.col("n_nationkey") * 2.0).alias("lat"), (F.col("n_nationkey") * -5.0).alias("lon"))
    return geocode.geocode_addresses(addresses, gazetteer)
