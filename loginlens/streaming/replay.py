"""Score a login stream with all six detectors, each login against the state just before it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from loginlens.operators.segments import SKEW, SkewPolicy
from loginlens.plans.score import replay_logins
from loginlens.sources.profile_log import ProfileLog


def stream_replay(logins: DataFrame, store: str, out: str, checkpoint: str, isolation: bool = True,
                  skew: SkewPolicy = SKEW) -> DataStreamWriter:
    """A writer that scores micro-batches against a store of ingested logins and carries its state on.

    The state is the store's log of profile changes: typed tables by user, device, cell,
    hour and day, of which a micro-batch reads its users' rows and writes its own changes.
    Results go to ``out`` by micro-batch. Versions follow the newest that the store held
    when the stream began; a micro-batch that is repeated after a failure replaces its own.
    Users are scored when an ingest has given them a profile and patterns; patterns are
    renewed by ingests between runs of the stream.
    """
    session = logins.sparkSession
    first = _first_version(session, store, checkpoint)

    def score(batch: DataFrame, batch_id: int) -> None:
        version = first + batch_id
        results = replay_logins(batch, store, version, version - 1, isolation, skew)
        results.drop(*[c for c in results.columns if c.endswith("_details")]).withColumn(
            "batch_id", F.lit(batch_id).cast("bigint")).write.mode("overwrite").parquet(f"{out}/part={batch_id}")

    return logins.writeStream.foreachBatch(score).option("checkpointLocation", checkpoint)


def _first_version(session, store: str, checkpoint: str) -> int:
    """The version of the stream's first micro-batch, kept beside its checkpoint for later runs."""
    place = f"{checkpoint.rstrip('/')}-first"
    found = session._jvm.org.apache.hadoop.fs.Path(f"{place}/_SUCCESS")
    if not found.getFileSystem(session._jsc.hadoopConfiguration()).exists(found):
        versions = ProfileLog(session, store).versions()
        if not versions:
            raise ValueError(f"nothing has been ingested into {store}")
        session.createDataFrame([(versions[-1] + 1,)], "first long").coalesce(1).write.mode("overwrite").json(place)
    return session.read.schema("first long").json(place).first()["first"]
