"""Token counts kept up to date by signed changes.

A change is a row `source, lang, tokenizer, sign, docs, tokens`: an insert
counts +1, a delete -1, and a revised count is the delete of the old and the
insert of the new one. A batch of changes is added up by key and committed as one
small table under its batch id. The totals are the sum over the committed
batches, so order does not matter.

Commits are idempotent. A batch is written under its own id, and Spark's marker
of a finished write is the commit: a batch that has it is not applied again, one
that failed half-way is written anew, and readers pass over it until then.
`compact` folds committed batches into a snapshot that remembers their ids.

Cases: null source, lang or tokenizer are keys of their own. A null text has no
tokens but counts as a document. A null sign or count adds nothing. A batch
without rows commits nothing but its id. Keys whose counts have returned to zero
are kept, with zeros. Repeated rows of a batch all count.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loginlens.llm.encoding import token_counter

KEYS = ("source", "lang", "tokenizer")
SUMS = "source string, lang string, tokenizer string, docs long, tokens long"
BATCH = 512
#: Every worker may hold two tokenizers, each with two generations of pieces of about 130 bytes (an estimate), so they remember less.
REMEMBER = 200_000


def count_tokens(docs: DataFrame, tokenizer: str, cut: str, out: str = "tokens") -> DataFrame:
    """Add the number of token ids of `text`; every other column passes through."""
    return count_with(docs, [(tokenizer, cut, out)], [f.name for f in docs.schema.fields])


def count_with(docs: DataFrame, counters: list[tuple[str, str, str]], keep: list[str]) -> DataFrame:
    """The columns to keep and, per (tokenizer, cut, out), the number of token ids of `text`; texts are handed over once."""
    names = [*keep, *[out for _, _, out in counters]]
    fields = docs.schema

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = [token_counter(tokenizer, cut, REMEMBER) for tokenizer, cut, _ in counters]
        for batch in batches:
            for first in range(0, batch.num_rows, BATCH):
                some = batch.slice(first, BATCH)
                texts = some.column(0).to_pylist()
                sizes = [pa.array(run(texts), pa.int64()) for run in runs]
                yield pa.RecordBatch.from_arrays([*some.columns[1:], *sizes], names)

    kinds = [f"`{c}` {fields[c].dataType.simpleString()}" for c in keep] + [f"`{out}` long" for _, _, out in counters]
    read = docs.select(F.col("text").alias("_text"), *[F.col(f"`{c}`") for c in keep])
    return read.mapInArrow(count, ", ".join(kinds))


def change(sign: int | Column, tokens: Column, tokenizer: str | Column) -> list[Column]:
    """Columns of a change, from a row with source and lang."""
    sign = F.lit(sign) if isinstance(sign, int) else sign
    name = F.lit(tokenizer) if isinstance(tokenizer, str) else tokenizer
    return [F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"),
            name.alias("tokenizer"), sign.cast("long").alias("docs"), (sign * tokens).cast("long").alias("tokens")]


def add_up(changes: DataFrame) -> DataFrame:
    return changes.groupBy(*KEYS).agg(F.coalesce(F.sum("docs"), F.lit(0)).alias("docs"),
                                      F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"))


class Rollup:
    """Totals by source, language and tokenizer version in a folder of the shared store."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Apply a batch once; False if it was committed before."""
        if batch in self.committed():
            return False
        add_up(changes.select("source", "lang", "tokenizer", "docs", "tokens")).write.mode("overwrite").parquet(
            f"{self.root}/batch={batch}")
        return True

    def committed(self) -> set[str]:
        """Ids of the batches whose write has finished, with those a snapshot holds."""
        done = self._finished("batch=")
        snapshot = self._snapshot()
        if snapshot:
            done |= {r["batch"] for r in self.spark.read.parquet(f"{self.root}/{snapshot}/ids").toLocalIterator()}
        return done

    def totals(self) -> DataFrame:
        return self._summed(*self._parts())

    def _parts(self) -> tuple[str | None, set[str], set[str]]:
        """The newest snapshot, the ids that it holds, and the committed batches besides; listed once."""
        snapshot, held = self._snapshot(), set()
        if snapshot:
            held = {r["batch"] for r in self.spark.read.parquet(f"{self.root}/{snapshot}/ids").toLocalIterator()}
        return snapshot, held, self._finished("batch=") - held

    def _summed(self, snapshot: str | None, held: set[str], batches: set[str]) -> DataFrame:
        parts = ([f"{self.root}/{snapshot}/sums"] if snapshot else []) + [f"{self.root}/batch={b}" for b in sorted(batches)]
        if not parts:
            return self.spark.createDataFrame([], SUMS)
        return add_up(self.spark.read.schema(SUMS).option("recursiveFileLookup", "true").parquet(*parts))

    def compact(self) -> None:
        """Fold the batches committed by now into a snapshot; the ids are written last and make it count.

        Sums and ids come from one listing, so a batch that is committed meanwhile is in
        neither. Snapshots of two writers have names of their own, and either is whole.
        """
        snapshot, held, batches = self._parts()
        number = max([int(n.split("-")[0]) for n in self._finished("snapshot=", "ids")], default=0) + 1
        name = f"snapshot={number}-{uuid.uuid4().hex}"
        self._summed(snapshot, held, batches).write.parquet(f"{self.root}/{name}/sums")
        self.spark.createDataFrame([(b,) for b in sorted(held | batches)], "batch string").coalesce(1).write.parquet(
            f"{self.root}/{name}/ids")

    def _snapshot(self) -> str | None:
        names = self._finished("snapshot=", "ids")
        return f"snapshot={max(names, key=lambda n: (int(n.split('-')[0]), n))}" if names else None

    def _finished(self, prefix: str, inner: str = "") -> set[str]:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        store = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not store.exists(path):
            return set()
        names = [s.getPath().getName() for s in store.listStatus(path)]
        make = self.spark._jvm.org.apache.hadoop.fs.Path
        return {n[len(prefix):] for n in names if n.startswith(prefix)
                and store.exists(make(f"{self.root}/{n}/{inner + '/' if inner else ''}_SUCCESS"))}
