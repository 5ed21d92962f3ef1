"""Office documents as rows: text blocks, metadata and original bytes."""

from __future__ import annotations

import io
import json
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from loginlens.sources.readers import sheet_parts, sheet_rows

# Supported extension to document kind.
FILE_TYPES = {
    ".docx": "word", ".doc": "word",
    ".xlsx": "excel", ".xls": "excel", ".xlsm": "excel",
    ".pptx": "powerpoint", ".ppt": "powerpoint",
    ".json": "json",
}
#: Blocks, and characters of them, that are handed back at once.
BLOCKS_AT_ONCE, CHARS_AT_ONCE = 10_000, 8_000_000
RESTORABLE = ("word", "excel", "powerpoint", "json")

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
_P = "{http://schemas.openxmlformats.org/presentationml/2006/main}"
_PARAGRAPH, _TEXT, _STYLE, _VALUE = f"{_W}p", f"{_W}t", f"{_W}pPr/{_W}pStyle", f"{_W}val"
_BREAKS = {f"{_W}tab": "\t", f"{_W}br": "\n", f"{_W}cr": "\n"}

BLOCKS = T.StructType([
    T.StructField("path", T.StringType()), T.StructField("file_type", T.StringType()),
    T.StructField("block", T.StringType()), T.StructField("part", T.StringType()),
    T.StructField("position", T.IntegerType()), T.StructField("text", T.StringType()),
    T.StructField("style", T.StringType())])


def extension(path) -> Column:
    c = F.col(path) if isinstance(path, str) else path
    return F.lower(F.regexp_extract(c, r"(\.[^./]+)$", 1))


def is_supported_format(path) -> Column:
    return extension(path).isin(*FILE_TYPES)


def file_type(path) -> Column:
    kinds = F.create_map(*[F.lit(v) for pair in FILE_TYPES.items() for v in pair])
    return F.try_element_at(kinds, extension(path))


def office_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) of supported files below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.where(is_supported_format("path")).select("path", "content")


def document_metadata(files: DataFrame) -> DataFrame:
    """Metadata and base64 bytes; never leaves the JVM."""
    return files.select(
        "path", file_type("path").alias("file_type"),
        F.regexp_extract("path", r"([^/]+)$", 1).alias("original_filename"),
        extension("path").alias("extension"), F.base64("content").alias("binary_content"))


def document_bytes(documents: DataFrame) -> DataFrame:
    """Original bytes, or a status saying why a row cannot be restored."""
    status = (F.when(F.col("file_type").isNull(), "missing file type")
              .when(~F.col("file_type").isin(*RESTORABLE), "unsupported file type").otherwise("ok"))
    return (documents.withColumn("status", status)
            .withColumn("content", F.when(F.col("status") == "ok", F.unbase64("binary_content"))))


def _word_blocks(content: bytes) -> Iterator[tuple]:
    with zipfile.ZipFile(io.BytesIO(content)) as package:
        body = ElementTree.fromstring(package.read("word/document.xml")).find(f"{_W}body")
        styles = {}
        if "word/styles.xml" in package.namelist():
            for style in ElementTree.fromstring(package.read("word/styles.xml")).iter(f"{_W}style"):
                name = style.find(f"{_W}name")
                if name is not None:
                    styles[style.get(f"{_W}styleId")] = name.get(f"{_W}val")

    def text(node) -> str:
        return "".join(_BREAKS.get(n.tag, n.text or "") for n in node.iter() if n.tag == _TEXT or n.tag in _BREAKS)

    paragraphs = tables = 0
    for node in body:
        if node.tag == _PARAGRAPH:
            words = text(node)
            if words.strip():
                mark = node.find(_STYLE)
                key = mark.get(_VALUE) if mark is not None else None
                yield "paragraph", "body", paragraphs, words, styles.get(key, key or "Normal")
                paragraphs += 1
        elif node.tag == f"{_W}tbl":
            rows = [["\n".join(text(p) for p in cell.iter(f"{_W}p")) for cell in row.iter(f"{_W}tc")]
                    for row in node.iter(f"{_W}tr")]
            for at, row in enumerate(rows):
                yield "table_row", f"table{tables}", at, json.dumps(row, ensure_ascii=False), None
            tables += 1


def _excel_blocks(content: bytes) -> Iterator[tuple]:
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        for name, part in sheet_parts(book):
            rows = sheet_rows(book, part)
            header = next(rows, [])
            for at, row in enumerate(rows):
                record = dict(zip((str(h) for h in header), row + [None] * (len(header) - len(row))))
                yield "sheet_row", name, at, json.dumps(record, ensure_ascii=False), None


def _slide_blocks(content: bytes) -> Iterator[tuple]:
    with zipfile.ZipFile(io.BytesIO(content)) as package:
        slides = [n for n in package.namelist() if re.fullmatch(r"ppt/slides/slide\d+\.xml", n)]
        slides.sort(key=lambda n: int(re.search(r"\d+", n).group(0)))
        for number, name in enumerate(slides, start=1):
            shapes = 0
            for shape in ElementTree.fromstring(package.read(name)).iter(f"{_P}sp"):
                lines = ["".join(t.text or "" for t in p.iter(f"{_A}t")) for p in shape.iter(f"{_A}p")]
                if "\n".join(lines).strip():
                    yield "shape", f"slide{number}", shapes, "\n".join(lines), None
                    shapes += 1


def _json_blocks(content: bytes) -> Iterator[tuple]:
    yield "json", "root", 0, json.dumps(json.loads(content), ensure_ascii=False), None


_EXTRACTORS = {"word": _word_blocks, "excel": _excel_blocks, "powerpoint": _slide_blocks, "json": _json_blocks}


def _kind(path: str) -> str | None:
    match = re.search(r"\.[^./]+$", path)
    return FILE_TYPES.get(match.group(0).lower()) if match else None


def _blocks_of(path: str, content: bytes) -> Iterator[tuple]:
    """The rows of one file."""
    kind = _kind(path)
    try:
        if kind is None:
            raise ValueError("Unsupported file format")
        for block in _EXTRACTORS[kind](bytes(content)):
            yield path, kind, *block
    except Exception as error:  # a damaged file keeps its row
        yield path, kind, "error", None, 0, f"Error extracting text: {error}", "Error"


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks are handed back together, however many files they come from: a batch a file costs more than its text."""
    schema = to_arrow_schema(BLOCKS)

    def together(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    for batch in batches:
        rows, size = [], 0
        for path, content in zip(batch.column(0), batch.column(1)):
            for row in _blocks_of(path.as_py(), content.as_py()):
                rows.append(row)
                size += len(row[5])
                if len(rows) == BLOCKS_AT_ONCE or size > CHARS_AT_ONCE:
                    yield together(rows)
                    rows, size = [], 0
        if rows:
            yield together(rows)


def extract_documents(files: DataFrame) -> DataFrame:
    """One row per paragraph, table row, sheet row or shape of (path, content) files.

    A file that cannot be read yields one ``error`` row instead of failing the job.
    """
    return files.select("path", "content").mapInArrow(_extract, BLOCKS)
