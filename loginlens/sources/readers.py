"""Login files of many formats, chosen by extension, as one cleaned table."""

from __future__ import annotations

import csv
import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
import pyarrow as pa
import pyarrow.feather as feather
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loginlens.operators.quality import clean_file
from loginlens.schema import USER

# File extension to reader.
FORMATS = {
    ".csv": "csv",
    ".txt": "text", ".tsv": "text", ".data": "text", ".dat": "text",
    ".xlsx": "excel", ".xlsm": "excel",
    ".json": "json",
    ".parquet": "parquet", ".pq": "parquet",
    ".feather": "feather", ".ftr": "feather",
}
DELIMITERS = (",", "\t", ";", "|")
SAMPLE_LINES = 5


def _extension(path: str) -> str:
    match = re.search(r"\.[^./\\]+$", path.rstrip("/"))
    return match.group(0).lower() if match else ""


def read_logins(spark: SparkSession, source, clean: bool = True, order: bool = False, **options) -> DataFrame:
    """A path, glob or DataFrame as a cleaned login-file table.

    A DataFrame passes through untouched. ``clean=False`` skips the loader's
    required columns and row rules; ``order=True`` sorts by id and time.
    """
    if isinstance(source, DataFrame):
        return source
    kind = FORMATS.get(_extension(source))
    if kind is None:
        raise ValueError(f"No reader available for file type: {_extension(source) or 'unknown'}")
    raw = READERS[kind](spark, source, **options)
    return clean_file(raw, order) if clean else raw


def scan_csv(spark: SparkSession, path: str, schema: T.StructType | None = None, **options) -> DataFrame:
    reader = spark.read.options(header=True, **options)
    return (reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(path)


def rank_delimiters(lines: list[str]) -> list[str]:
    """Delimiters found in the sample, most frequent first, ties in fixed order."""
    sample = "\n".join(lines)
    counts = [(sample.count(d), d) for d in DELIMITERS]
    return [d for n, d in sorted(counts, key=lambda c: -c[0]) if n > 0]


def scan_delimited(spark: SparkSession, path: str, **options) -> DataFrame:
    """Delimited text; the delimiter is found from the first five lines.

    Text without any delimiter is one column: under its header where the
    default reader accepts it, as ``text`` when even that fails.
    """
    sample = [r.value for r in spark.read.text(path).limit(SAMPLE_LINES).collect()]
    for delimiter in rank_delimiters(sample):
        # The header tells the number of columns; the file is read for one delimiter only.
        if len(next(csv.reader(sample[:1], delimiter=delimiter), [])) > 1:
            return scan_csv(spark, path, sep=delimiter, **options)
    if sample:
        return scan_csv(spark, path, **options)
    return spark.read.text(path).withColumnRenamed("value", "text")


def scan_json(spark: SparkSession, path: str, schema: T.StructType | None = None,
              multi_line: bool = True, **options) -> DataFrame:
    """JSON records. Large data should be one record per line with ``multi_line=False``,
    which lets Spark split files."""
    reader = spark.read.options(multiLine=multi_line, **options)
    return (reader.schema(schema) if schema else reader).json(path)


ENVELOPE_SCHEMA = T.StructType([T.StructField("login_events", T.ArrayType(T.StructType([
    T.StructField("user_id", T.StringType()), T.StructField("timestamp", T.TimestampType()),
    T.StructField("latitude", T.DoubleType()), T.StructField("longitude", T.DoubleType()),
    T.StructField("device_id", T.StringType()), T.StructField("ip_address", T.StringType())])))])


def scan_json_envelope(spark: SparkSession, path: str, field: str = "login_events",
                       schema: T.StructType = ENVELOPE_SCHEMA, multi_line: bool = True) -> DataFrame:
    """An object with one array of events, as a table of events; one object per line with ``multi_line=False``."""
    return spark.read.schema(schema).json(path, multiLine=multi_line).select(F.inline(field))


def scan_parquet(spark: SparkSession, path: str, **options) -> DataFrame:
    return spark.read.options(**options).parquet(path)


def scan_event_table(spark: SparkSession, name: str) -> DataFrame:
    """A stored login table, by catalog name or path."""
    return spark.read.parquet(name) if "/" in name else spark.table(name)


# --- Binary formats: Spark lists and ships the files, a task decodes each -----

FILE_SCHEMA = T.StructType([
    T.StructField("id", T.StringType()), T.StructField("device_id", T.StringType()),
    T.StructField("login_time", T.TimestampType()), T.StructField("latitude", T.DoubleType()),
    T.StructField("longitude", T.DoubleType())])


def binary_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "content")


def decode_files(files: DataFrame, decode, schema: T.StructType) -> DataFrame:
    """Rows of each (path, content) file, a bounded slice of a file at a time."""
    names = schema.fieldNames()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch["content"]:
                for rows in decode(bytes(content)):
                    yield rows.reindex(columns=names)

    return files.mapInPandas(run, schema)


def _feather_rows(content: bytes) -> Iterator[pd.DataFrame]:
    table = feather.read_table(pa.BufferReader(content))
    for batch in table.to_batches(max_chunksize=10_000):
        yield batch.to_pandas()


def decode_feather(files: DataFrame, schema: T.StructType = FILE_SCHEMA) -> DataFrame:
    return decode_files(files, _feather_rows, schema)


def scan_feather(spark: SparkSession, path: str, schema: T.StructType = FILE_SCHEMA) -> DataFrame:
    return decode_feather(binary_files(spark, path), schema)


_SHEET = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


def _column_number(reference: str) -> int:
    number = 0
    for letter in re.match(r"[A-Z]+", reference).group(0):
        number = number * 26 + ord(letter) - ord("A") + 1
    return number - 1


def sheet_parts(book: zipfile.ZipFile) -> list[tuple[str, str]]:
    """(sheet name, part name) in workbook order."""
    targets = {r.get("Id"): r.get("Target")
               for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
    sheets = ElementTree.fromstring(book.read("xl/workbook.xml")).iter(f"{_SHEET}sheet")
    def part(target: str) -> str:
        return target.lstrip("/") if target.startswith("/") else f"xl/{target}"
    return [(s.get("name"), part(targets[s.get(f"{_REL}id")])) for s in sheets]


def sheet_rows(book: zipfile.ZipFile, part: str) -> Iterator[list]:
    """Cell values row by row: text, float, bool or None."""
    shared = []
    if "xl/sharedStrings.xml" in book.namelist():
        for item in ElementTree.fromstring(book.read("xl/sharedStrings.xml")).iter(f"{_SHEET}si"):
            shared.append("".join(t.text or "" for t in item.iter(f"{_SHEET}t")))
    with book.open(part) as stream:
        for _, row in ElementTree.iterparse(stream):
            if row.tag != f"{_SHEET}row":
                continue
            values = []
            for at, cell in enumerate(row.iter(f"{_SHEET}c")):
                column = _column_number(cell.get("r")) if cell.get("r") else at
                values.extend([None] * (column - len(values)))
                values.append(_cell_value(cell, shared))
            yield values
            row.clear()


def _cell_value(cell, shared):
    kind, raw = cell.get("t", "n"), cell.findtext(f"{_SHEET}v")
    if kind == "inlineStr":
        return "".join(t.text or "" for t in cell.iter(f"{_SHEET}t"))
    if raw is None:
        return None
    if kind == "s":
        return shared[int(raw)]
    if kind == "b":
        return raw == "1"
    return raw if kind in ("str", "e", "d") else float(raw)


def _excel_time(values: pd.Series) -> pd.Series:
    """Excel day numbers or text to timestamps."""
    days = pd.to_numeric(values, errors="coerce")
    numbers = pd.Timestamp("1899-12-30") + pd.to_timedelta(days, unit="D")
    texts = pd.to_datetime(values.where(days.isna()), errors="coerce", format="ISO8601")
    return numbers.fillna(texts).dt.round("us")


def _excel_rows(content: bytes, slice_rows: int = 10_000) -> Iterator[pd.DataFrame]:
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        rows = sheet_rows(book, sheet_parts(book)[0][1])
        header = [str(h) for h in next(rows, [])]
        block = []
        for row in rows:
            block.append((row + [None] * len(header))[:len(header)])
            if len(block) == slice_rows:
                yield _typed(pd.DataFrame(block, columns=header))
                block = []
        if block:
            yield _typed(pd.DataFrame(block, columns=header))


def _typed(df: pd.DataFrame) -> pd.DataFrame:
    if "login_time" in df:
        df["login_time"] = _excel_time(df["login_time"])
    for name in ("latitude", "longitude"):
        if name in df:
            df[name] = pd.to_numeric(df[name], errors="coerce")
    for name in ("id", "device_id"):
        if name in df:
            df[name] = df[name].map(lambda v: v if v is None or isinstance(v, str) else f"{v:.15g}")
    return df


def decode_excel(files: DataFrame, schema: T.StructType = FILE_SCHEMA) -> DataFrame:
    """First sheet of xlsx/xlsm workbooks, header in the first row."""
    return decode_files(files, _excel_rows, schema)


def scan_excel(spark: SparkSession, path: str, schema: T.StructType = FILE_SCHEMA) -> DataFrame:
    return decode_excel(binary_files(spark, path), schema)


READERS = {"csv": scan_csv, "text": scan_delimited, "excel": scan_excel, "json": scan_json,
           "parquet": scan_parquet, "feather": scan_feather}
