"""Helpers shared by the corpus operators: tables, row ids, running totals, components."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from loginlens.session import discard, durable


#: Rows that a Python worker is handed at once. Whole texts are large; Spark's own default is 10,000.
ARROW_ROWS = 500


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the corpus; the session's Arrow batches are kept small enough for whole texts."""
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > ARROW_ROWS or int(spark.conf.get(key)) <= 0:
        spark.conf.set(key, str(ARROW_ROWS))


def with_row_id(df: DataFrame, name: str = "_row") -> DataFrame:
    """Add an id that is unique per row and equal whenever the table is read again.

    Rows of a file scan are named by file and position. Any other input is
    first written to the shared folder, which makes it a file scan.
    """
    try:
        df.select("_metadata.file_path", "_metadata.row_index")
    except Exception:  # not a file scan: Spark cannot resolve the column
        df = durable(df)
    kept = [F.col(f"`{c}`") for c in df.columns if c not in (name, "_metadata")]
    return df.select(*kept, F.struct(F.xxhash64("_metadata.file_path").alias("file"),
                                     F.col("_metadata.row_index").alias("at")).alias(name))


def carried(docs: DataFrame, *needed: str) -> DataFrame:
    """`_row`, the needed columns, and `_doc` with all columns, so that no name of theirs can clash."""
    rows = docs
    try:
        docs.select("_metadata.row_index")
    except Exception:  # not a file scan
        rows = durable(docs)
    return with_row_id(rows.select(*needed, F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"), "_metadata"))


def uncarried(rows: DataFrame, docs: DataFrame, **changed: Column) -> DataFrame:
    """The columns of `docs` out of `_doc`, some of them replaced."""
    return rows.select(*[changed.get(c, F.col("_doc").getField(c)).alias(c) for c in docs.columns])


def div(a: Column | int, b: Column | int) -> Column:
    """Whole-number quotient."""
    return F.call_function("div", *[x if isinstance(x, Column) else F.lit(x) for x in (a, b)])


def fingerprint(*columns: Column | str) -> Column:
    """128 bits of the columns' values; nulls differ from every value but null."""
    known = [F.col(c) if isinstance(c, str) else c for c in columns]
    marks = [c.isNull() for c in known]
    return F.struct(F.xxhash64(*known, *marks).alias("a"), F.xxhash64(F.lit(7), *marks, *known).alias("b"))


def running_total(df: DataFrame, group: str, order: Sequence[str], value: str, out: str) -> DataFrame:
    """Add `out`: the sum of `value` over the earlier rows of the same group.

    Rows are dealt by ranges of (group, order), so a group of any size is
    spread; each range adds up its own rows, and range bases come from a prefix
    sum over the few range totals. Rows that tie in `order` should be
    interchangeable. The rows are written to the shared folder once.
    """
    schema = T.StructType([*df.schema.fields, T.StructField("_range", T.IntegerType()),
                           T.StructField("_inside", T.LongType())])
    names = df.columns
    group_at, value_at = names.index(group), names.index(value)

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, last, carry = TaskContext.get().partitionId(), None, 0
        for rows in batches:
            if not rows.num_rows:
                continue
            codes = rows.column(group_at).dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
            amounts = rows.column(value_at).to_numpy(zero_copy_only=False).astype(np.int64)
            before = np.cumsum(amounts) - amounts
            starts = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]])
            inside = before - np.repeat(before[starts], np.diff(np.r_[starts, len(codes)]))
            if rows.column(group_at)[0].as_py() == last:
                inside[codes == codes[0]] += carry
            last, carry = rows.column(group_at)[-1].as_py(), int(inside[-1] + amounts[-1])
            yield pa.RecordBatch.from_arrays(
                [*rows.columns, pa.array(np.full(len(codes), here, np.int32)), pa.array(inside)],
                [*names, "_range", "_inside"])

    ranged = df.repartitionByRange(group, *order).sortWithinPartitions(group, *order)
    summed = durable(ranged.mapInArrow(add_up, schema))
    totals = summed.groupBy(F.col(group).alias("_group"), F.col("_range").alias("_at")).agg(F.sum(value).alias("_sum"))
    before = Window.partitionBy("_group").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("_group", "_at", F.coalesce(F.sum("_sum").over(before), F.lit(0)).cast("long").alias("_base"))
    return (summed.join(bases, F.col(group).eqNullSafe(F.col("_group")) & (F.col("_range") == F.col("_at")))
            .withColumn(out, F.col("_base") + F.col("_inside")).select(*names, out))


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Label every node with the smallest node of its connected component.

    nodes(id), edges(a, b) with ids of one ordered type. Each round every node
    takes the smallest label among its neighbours' and then the label of its
    label (pointer jumping), so stars and short chains settle in a few rounds.
    Rounds are written to the shared folder; messages are combined before the
    shuffle, so one huge component is an ordinary case.
    """
    both = durable(edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).where("a <> b").distinct())
    touched = both.select(F.col("a").alias("id")).distinct()
    label = durable(both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("m"))
                    .select("id", F.least("id", "m").alias("label")))
    stored = label
    while True:
        heard = both.join(label, both.b == label.id).groupBy("a").agg(F.min("label").alias("heard"))
        joined = label.join(heard, label.id == heard.a, "left").select(
            "id", "label", F.least("label", F.coalesce("heard", "label")).alias("new"))
        jump = label.select(F.col("id").alias("j"), F.col("label").alias("farther"))
        step = joined.join(jump, joined.new == jump.j, "left").select(
            "id", "label", F.least("new", F.coalesce("farther", "new")).alias("new"))
        step = durable(step)
        discard(stored)
        stored, label = step, step.select("id", F.col("new").alias("label"))
        if step.where("new <> label").isEmpty():
            break
    alone = nodes.select("id").join(touched, "id", "left_anti").select("id", F.col("id").alias("label"))
    return label.unionByName(alone)
