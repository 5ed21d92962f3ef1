"""Tables are broadcast by the size of their rows, not of their compressed files."""

from pyspark.sql import DataFrameWriter
from pyspark.sql import functions as F

from conftest import SF
from loginlens.plans import catalog
from loginlens.session import durable, shuffled_joins
from loginlens.sources.profile_log import ProfileLog


def test_a_table_of_small_files_and_large_rows_is_not_broadcast(spark):
    catalog.logins(spark, SF)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    table = durable(spark.range(20_000).select((F.col("id") % 10).alias("user_id"), F.lit("x" * 400).alias("text")))
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "50000")  # the file has fewer bytes, its rows 8,000,000
        plan = spark.range(10).select(F.col("id").alias("user_id"), F.rand().alias("r")).join(table, "user_id", "left")
        assert "BroadcastHashJoin" not in plan._jdf.queryExecution().sparkPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_tables_of_users_are_shuffled_while_a_batch_is_scored_and_stored(spark, tmp_path, monkeypatch):
    """Without a hint nothing is broadcast, however small; the session is as it was afterwards."""
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    rows, few = spark.range(1_000).withColumn("r", F.rand()), spark.range(10).withColumn("s", F.rand())
    planned = lambda df: df._jdf.queryExecution().sparkPlan().toString()
    with shuffled_joins(spark):
        assert "BroadcastHashJoin" not in planned(rows.join(few, "id"))
        assert "BroadcastHashJoin" in planned(rows.join(F.broadcast(few), "id"))
    assert spark.conf.get(key) == before

    settings = []

    class Watched(ProfileLog):
        """Notes the threshold under which tables are written."""
        def _publish(self, *args):
            pass

    table = rows.join(few, "id").select(F.col("id").cast("string").alias("user_id"), "s")
    taken = spark._jsparkSession.sessionState().conf()
    watched = Watched(spark, str(tmp_path / "log"))
    original = DataFrameWriter.parquet

    def parquet(self, *args, **kwargs):
        settings.append(taken.autoBroadcastJoinThreshold())
        return original(self, *args, **kwargs)

    monkeypatch.setattr(DataFrameWriter, "parquet", parquet)
    watched.commit(0, {"t": table}, {"p": table})
    assert settings == [-1, -1] and spark.conf.get(key) == before
    try:
        with shuffled_joins(spark):
            raise KeyError
    except KeyError:
        assert spark.conf.get(key) == before
