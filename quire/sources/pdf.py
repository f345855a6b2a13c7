"""PDF files as tables: positioned text, page boxes, commands and content streams."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import _parse_datatype_string

from quire.pages import pdf

ENTRY = "struct<entry_idx:int,a:double,b:double,c:double,d:double,x:double,y:double,text:string,font_id:string,font_size:double,units:double>"
COMMAND = "struct<cmd_idx:int,op:string,operand:string>"
PAGES = f"doc_id string, page_no int, page_count int, box array<double>, rotate int, content string, entries array<{ENTRY}>, commands array<{COMMAND}>, error string"


def supports(path: Column) -> Column:
    return F.lower(path).endswith(".pdf")


def files(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id (the path) and content of all files with the extension pdf, in either case, below a folder."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return found.where(supports(F.col("path"))).select(F.col("path").alias("doc_id"), "content")


def _rows(doc: str, data: bytes | None) -> list[dict]:
    try:
        found = pdf.read(data or b"")
    except pdf.PdfError as e:
        return [{"doc_id": doc, "error": f"PdfError: {e}"}]
    out = []
    for p in found:
        entries = [{"entry_idx": i, **dict(zip("abcdxy", r.matrix)), "text": r.text, "font_id": r.font, "font_size": r.size, "units": r.units} for i, r in enumerate(p.runs)]
        commands = [{"cmd_idx": i, "op": op, "operand": json.dumps(operand)} for i, (op, operand) in enumerate(p.commands)]
        out.append({"doc_id": doc, "page_no": p.number, "page_count": len(found), "box": p.box, "rotate": p.rotate, "content": p.content.decode("latin-1"), "entries": entries, "commands": commands, "error": None})
    return out


def pages(found: DataFrame, strict: bool = False) -> DataFrame:
    """A row for each page of (doc_id, content); of a file that cannot be read one row with its error and nothing else.

    With ``strict`` such a file ends the query with a ``PdfError``.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = _parse_datatype_string(PAGES)
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, data in zip(batch.column(0).to_pylist(), batch.column(1)):  # one file at a time is held as pages
                rows = _rows(doc, data.as_py())
                if strict and rows and rows[0]["error"]:
                    raise pdf.PdfError(f"{doc}: {rows[0]['error']}")
                yield pa.RecordBatch.from_pylist([{n: r.get(n) for n in arrow.names} for r in rows], schema=arrow)

    return found.select("doc_id", "content").mapInArrow(run, schema)


def entries(read: DataFrame) -> DataFrame:
    return read.where("error IS NULL").select("doc_id", "page_no", F.inline("entries"))


def commands(read: DataFrame) -> DataFrame:
    return read.where("error IS NULL").select("doc_id", "page_no", F.inline("commands")).withColumn("raw", F.lit(None).cast("binary"))


def page_lists(read: DataFrame) -> DataFrame:
    """The pages with lists of entries and commands beside their boxes, as they were read."""
    return read.where("error IS NULL").select("doc_id", "page_no", "box", "entries", "commands")


def boxes(read: DataFrame) -> DataFrame:
    return read.where("error IS NULL").select("doc_id", "page_no", "box", "rotate", "content")
