"""Flat token-id files with 64-bit document offsets, memory-mapped on reading.

Per range partition of the document id three files are written below `root`:

* `*.ids`: the token ids of all its documents, one after another, as
  little-endian unsigned integers (16 bits where the vocabulary fits, else 32);
* `*.off`: one little-endian unsigned 64-bit offset per document and a last
  one, in ids from the start of the `.ids` file;
* `*.doc`: the document ids, signed 64 bits (null ids come first; the manifest
  counts them).

The manifest table has one row per partition; its `base` (ids in all earlier
partitions) is a prefix sum over the partitions' totals.

Cases: a null text is an empty one and yields the end id alone. Null document
ids sort first. Rows with one id are ordered by a hash of the text, then the
text. An empty table gives an empty manifest. Other columns are not read.
A task that is run again writes files of new names; the manifest lists those of
the run that counted.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loginlens.llm.encoding import encoder, id_type
from loginlens.session import durable

MANIFEST = "part int, ids string, offsets string, docs string, width int, n_docs long, n_null long, n_ids long"
READ = "doc_id long, start long, n_tokens long, ids_crc32 long, part int"
BATCH = 512


def write_token_files(docs: DataFrame, root: str, tokenizer: str, cut: str, end_id: int,
                      vocabulary_size: int) -> DataFrame:
    """Encode `doc_id, text`, append `end_id` to each document, write the files; returns the manifest."""
    kind = id_type(max(vocabulary_size, end_id + 1))
    end = np.array([end_id], dtype=kind).tobytes()
    ordered = (docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text",
                           F.xxhash64("text").alias("h"))
               .repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h", "text")
               .select("doc_id", "text"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, folder = fs.FileSystem.from_uri(root)
        store.create_dir(folder, recursive=True)
        part = TaskContext.get().partitionId()
        stem = f"{folder}/part-{part:06d}-{uuid.uuid4().hex}"
        names = [f"{stem}.{x}" for x in ("ids", "off", "doc")]
        encode, width = encoder(tokenizer, cut, kind), np.dtype(kind).itemsize
        n_docs = n_null = n_ids = 0
        streams = []
        for batch in batches:
            for first in range(0, batch.num_rows, BATCH):
                some = batch.slice(first, BATCH)
                if not streams:
                    streams = [store.open_output_stream(n) for n in names]
                encoded = encode(some.column(1).to_pylist())
                sizes = np.array([len(e) // width + 1 for e in encoded], dtype=np.int64)
                streams[0].write(b"".join(x for e in encoded for x in (e, end)))
                streams[1].write((n_ids + np.cumsum(sizes) - sizes).astype("<u8").tobytes())
                streams[2].write(some.column(0).fill_null(0).to_numpy(zero_copy_only=False).astype("<i8").tobytes())
                n_docs, n_ids = n_docs + some.num_rows, n_ids + int(sizes.sum())
                n_null += some.column(0).null_count
        if streams:
            streams[1].write(np.array([n_ids], dtype="<u8").tobytes())
            for stream in streams:
                stream.close()
            uris = [f"{root}/{n.rsplit('/', 1)[1]}" for n in names]
            yield pa.RecordBatch.from_pydict(
                {"part": pa.array([part], pa.int32()), "ids": [uris[0]], "offsets": [uris[1]], "docs": [uris[2]],
                 "width": pa.array([width], pa.int32()), "n_docs": [n_docs], "n_null": [n_null], "n_ids": [n_ids]})

    parts = durable(ordered.mapInArrow(write, MANIFEST))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return parts.withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).cast("long"))


def open_mapped(uri: str, dtype: str) -> np.ndarray:
    """The file's values without reading it: mapped where the store is local, else fetched."""
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    if isinstance(store, fs.LocalFileSystem):
        return np.memmap(path, dtype=dtype, mode="r") if store.get_file_info(path).size else np.empty(0, dtype)
    with store.open_input_file(path) as file:
        return np.frombuffer(file.read_buffer(), dtype=dtype)


def document_ids(row: pd.Series, at: int) -> np.ndarray:
    """The ids of document number `at` of a manifest row's partition."""
    offsets = open_mapped(row["offsets"], "<u8")
    return open_mapped(row["ids"], f"<u{row['width']}")[int(offsets[at]):int(offsets[at + 1])]


def read_token_files(manifest: DataFrame) -> DataFrame:
    """Per document, from the files: its id, its start over all partitions, its length and a checksum.

    The checksum is the unsigned CRC-32 of the ids as little-endian unsigned
    32-bit integers, whatever the width in the file.
    """
    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                ids = open_mapped(row.ids, f"<u{row.width}")
                offsets = open_mapped(row.offsets, "<u8").astype(np.int64)
                docs = open_mapped(row.docs, "<i8")
                for first in range(0, row.n_docs, 10_000):
                    last = min(first + 10_000, row.n_docs)
                    cut = offsets[first:last + 1]
                    names = pd.Series(np.asarray(docs[first:last]), dtype="Int64")
                    names[:max(0, row.n_null - first)] = pd.NA
                    yield pd.DataFrame({
                        "doc_id": names, "start": cut[:-1] + row.base, "n_tokens": np.diff(cut),
                        "ids_crc32": [zlib.crc32(ids[i:j].astype("<u4").tobytes())
                                      for i, j in zip(cut[:-1], cut[1:])],
                        "part": np.int32(row.part)})

    files = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return manifest.repartition(files, "part").mapInPandas(read, READ)
