"""Small binary files built inside tasks, for round trips through the decoders.

Each Arrow batch of the input becomes one file, so nothing is gathered.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.sax.saxutils import escape

import pandas as pd
import pyarrow as pa
import pyarrow.feather as feather
from pyspark.sql import DataFrame
from pyspark.sql import types as T

FILES = T.StructType([T.StructField("path", T.StringType()), T.StructField("content", T.BinaryType())])

_NOT_XML = re.compile("[^\t\n\r -퟿-�\U00010000-\U0010ffff]")
_CT = "http://schemas.openxmlformats.org/package/2006/content-types"
_PKG_REL = "http://schemas.openxmlformats.org/package/2006/relationships"
_DOC_REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_S = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
_P = "http://schemas.openxmlformats.org/presentationml/2006/main"
_A = "http://schemas.openxmlformats.org/drawingml/2006/main"


def _xml(text) -> str:
    """Escaped text; carriage returns survive as character references."""
    return escape(_NOT_XML.sub("", str(text)), {"\r": "&#13;"})


def _package(parts: dict[str, str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED, compresslevel=1) as package:
        package.writestr("[Content_Types].xml", f'<Types xmlns="{_CT}"/>')
        for name, text in parts.items():
            package.writestr(name, '<?xml version="1.0" encoding="UTF-8"?>' + text)
    return out.getvalue()


_P_START, _P_END = '<w:p><w:r><w:t xml:space="preserve">', "</w:t></w:r></w:p>"


def word_bytes(paragraphs: list[str], table: list[list[str]] | None = None) -> bytes:
    body = "".join(f"{_P_START}{_xml(p)}{_P_END}" for p in paragraphs)
    return _word_package(body, table)


def word_bytes_of_text(text: str) -> bytes:
    """`word_bytes` of the lines of a text, which is escaped whole."""
    return _word_package(f"{_P_START}{_xml(text)}{_P_END}".replace("\n", f"{_P_END}{_P_START}"))


def _word_package(body: str, table: list[list[str]] | None = None) -> bytes:
    for row in [table] if table else []:
        cells = "".join("<w:tr>" + "".join(f"<w:tc><w:p><w:r><w:t>{_xml(c)}</w:t></w:r></w:p></w:tc>" for c in r)
                        + "</w:tr>" for r in row)
        body += f"<w:tbl>{cells}</w:tbl>"
    return _package({"word/document.xml": f'<w:document xmlns:w="{_W}"><w:body>{body}</w:body></w:document>'})


def slides_bytes(slides: list[list[str]]) -> bytes:
    parts = {}
    for number, shapes in enumerate(slides, start=1):
        tree = "".join(
            "<p:sp><p:txBody>" + "".join(f"<a:p><a:r><a:t>{_xml(line)}</a:t></a:r></a:p>" for line in s.split("\n"))
            + "</p:txBody></p:sp>" for s in shapes)
        parts[f"ppt/slides/slide{number}.xml"] = (
            f'<p:sld xmlns:p="{_P}" xmlns:a="{_A}"><p:cSld><p:spTree>{tree}</p:spTree></p:cSld></p:sld>')
    return _package(parts)


def workbook_bytes(df: pd.DataFrame, sheet: str = "logins") -> bytes:
    def cell(value) -> str:
        if value is None or value is pd.NaT or value != value:
            return "<c/>"
        if isinstance(value, (int, float)):
            return f"<c><v>{value!r}</v></c>"
        return f'<c t="inlineStr"><is><t>{_xml(value)}</t></is></c>'

    lines = [list(df.columns), *df.astype(object).values.tolist()]
    rows = "".join("<row>" + "".join(cell(v) for v in line) + "</row>" for line in lines)
    return _package({
        "xl/workbook.xml": f'<workbook xmlns="{_S}" xmlns:r="{_DOC_REL}"><sheets>'
                           f'<sheet name="{_xml(sheet)}" sheetId="1" r:id="rId1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="{_PKG_REL}"><Relationship Id="rId1" '
                                      'Target="worksheets/sheet1.xml"/></Relationships>',
        "xl/worksheets/sheet1.xml": f'<worksheet xmlns="{_S}"><sheetData>{rows}</sheetData></worksheet>'})


def _per_batch(df: DataFrame, suffix: str, encode) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for number, batch in enumerate(batches):
            yield pd.DataFrame({"path": [f"part-{number}{suffix}"], "content": [encode(batch)]})
    return df.mapInPandas(run, FILES)


def feather_files(df: DataFrame) -> DataFrame:
    def encode(batch: pd.DataFrame) -> bytes:
        out = io.BytesIO()
        feather.write_feather(pa.Table.from_pandas(batch, preserve_index=False), out)
        return out.getvalue()
    return _per_batch(df, ".feather", encode)


def excel_files(df: DataFrame) -> DataFrame:
    """Workbooks of one sheet; times go in as ISO text."""
    return _per_batch(df, ".xlsx", workbook_bytes)


def word_files(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One document per row, one paragraph per line of text."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({
                "path": [f"document-{k}.docx" for k in batch[key]],
                "content": [word_bytes_of_text(t or "") for t in batch[text]]})
    return documents.select(key, text).mapInPandas(run, FILES)
