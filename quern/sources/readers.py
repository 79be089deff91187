"""Readers of uploaded files and crawled pages, into sections and pages.

Files come in through Spark's ``binaryFile`` source, a row a file; what parses them is chosen by extension, and a
file that can't be parsed gives a row with an error instead of failing the batch.
"""

from __future__ import annotations

import csv
import io
import re
import zipfile
from collections.abc import Callable
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.functions.text import file_type

SECTION_SCHEMA = "path string, file_type string, ordinal int, section_title string, content string, page int, total_pages int, error string"
#: Rows of a CSV section, and printable runs of a legacy document.
CSV_ROWS = 20
_RUN = re.compile(r"[a-zA-Z0-9\s.,!?;:\-–—()\[\]\"'@#$%&*+/=<>_]{4,}")
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def tidy(text: str) -> str:
    text = re.sub(r"\r\n?", "\n", text or "")
    return re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]+", " ", text)).strip()


def read_csv_bytes(data: bytes) -> list[tuple]:
    """Sections of 20 non-empty rows, each row as ``Row i: header: value; ...`` without its blank values."""
    rows = csv.reader(io.StringIO(data.decode("utf-8", "replace"), newline=""))
    header = [h.strip() for h in next(rows, [])]
    held: list[str] = []
    out: list[tuple] = []
    for i, row in enumerate(rows, 1):
        parts = [f"{h}: {v.strip()}" for h, v in zip(header, row) if v.strip()]
        if parts:
            held.append(f"Row {i}: " + "; ".join(parts))
        if len(held) == CSV_ROWS:
            out.append((f"Rows {i - CSV_ROWS + 1} - {i}", "\n".join(held), None, None))
            held = []
    if held:
        out.append(("CSV Data Records", "\n".join(held), None, None))
    return out


def read_docx_bytes(data: bytes) -> list[tuple]:
    """Paragraphs, then tables with merged cells collapsed, of a zipped XML document."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_W}body")
    text = lambda e: "".join(t.text or "" for t in e.iter(f"{_W}t")).strip()
    blocks = [t for p in body.findall(f"{_W}p") if (t := text(p))]
    for n, table in enumerate(body.findall(f"{_W}tbl"), 1):
        lines = []
        for row in table.findall(f"{_W}tr"):
            cells = [text(c) for c in row.findall(f"{_W}tc")]
            cells = [c for i, c in enumerate(cells) if i == 0 or c != cells[i - 1]]
            if any(cells):
                lines.append(" | ".join(cells))
        if lines:
            blocks.append(f"[Table {n}]\n" + "\n".join(lines))
    content = tidy("\n\n".join(blocks))
    return [("Document Content", content, None, None)] if content else []


def read_doc_bytes(data: bytes) -> list[tuple]:
    """Printable runs of a legacy document."""
    content = tidy(" ".join(_RUN.findall(data.decode("latin-1"))))
    return [("Binary Document Stream", content, None, None)] if content else []


def read_pdf_bytes(data: bytes) -> list[tuple]:
    """A section for each page that has text; needs an optional library."""
    from pypdf import PdfReader  # optional

    pages = PdfReader(io.BytesIO(data)).pages
    found = ((n, tidy(p.extract_text() or "")) for n, p in enumerate(pages, 1))
    return [(f"Page {n}", text, n, len(pages)) for n, text in found if text]


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of JSON files, one object to a line. Missing files and lines that are no JSON give nothing, missing fields nulls."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(target):
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(f"{schema}, _corrupt string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(path)
    return rows.where("_corrupt is null").drop("_corrupt")


#: Parsers by extension; a deployment may add its own.
PARSERS: dict[str, Callable[[bytes], list[tuple]]] = {"csv": read_csv_bytes, "docx": read_docx_bytes, "doc": read_doc_bytes, "pdf": read_pdf_bytes}


def read_files(spark: SparkSession, path: str, parsers: dict[str, Callable[[bytes], list[tuple]]] | None = None) -> DataFrame:
    """Sections of all files under ``path``: ``path, file_type, ordinal, section_title, content, page, total_pages, error``.

    A file of an unknown type, or one that fails, gives one row with ``error``. An empty file has no sections.
    """
    known = dict(PARSERS if parsers is None else parsers)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    rows = files.select("path", file_type(F.element_at(F.split("path", "/"), -1)).alias("file_type"), "content")

    def parse(batches):
        for b in batches:
            out: list[tuple] = []
            for name, kind, data in zip(b.column("path").to_pylist(), b.column("file_type").to_pylist(), b.column("content").to_pylist()):
                try:
                    if kind not in known:
                        raise ValueError(f"unsupported file type {kind!r}")
                    out += [(name, kind, i, title, text, page, total, None) for i, (title, text, page, total) in enumerate(known[kind](data), 1)]
                except Exception as error:  # a bad file mustn't end the batch
                    out.append((name, kind, 0, None, None, None, None, f"{type(error).__name__}: {error}"[:300]))
            columns = list(zip(*out)) if out else [()] * 8
            types = (pa.string(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string())
            names = [x.split(" ")[0] for x in SECTION_SCHEMA.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

    return rows.mapInArrow(parse, SECTION_SCHEMA)


def section_items(sections: DataFrame) -> DataFrame:
    """Sections as items: ``source_id, source_name, source_type, item_key, title, text``; the id of a document is
    derived from its name."""
    name = F.element_at(F.split("path", "/"), -1)
    return sections.where("error is null").select(
        F.concat(F.lit("doc-"), F.substring(F.md5(F.lower(F.trim(name))), 1, 10)).alias("source_id"),
        name.alias("source_name"),
        F.lit("document").alias("source_type"),
        F.concat(F.lit("section-"), F.col("ordinal")).alias("item_key"),
        F.coalesce(F.when(F.col("page").isNotNull(), F.concat(F.lit("Page "), F.col("page"))), F.col("section_title")).alias("title"),
        F.col("content").alias("text"),
    )


def csv_sections(rows: DataFrame, order: str, values: list[str], group: str | None = None, size: int = CSV_ROWS) -> DataFrame:
    """Sections of tabular rows that are already in a table: ``[group,] section, section_title, content``.

    Rows are numbered in ``order``; blank values are skipped, and rows without any fill no section. A section is
    ``size`` non-empty rows; the last, incomplete one is ``CSV Data Records``.
    """
    keys = [group] if group else []
    value = lambda c: F.trim(F.coalesce(F.col(c).cast("string"), F.lit("")))
    parts = F.filter(F.array(*[F.when(value(c) != "", F.concat(F.lit(f"{c}: "), value(c))) for c in values]), lambda x: x.isNotNull())
    w = Window.partitionBy(*keys).orderBy(order)
    numbered = rows.withColumn("_i", F.row_number().over(w)).withColumn("_parts", parts).where(F.size("_parts") > 0)
    running = numbered.withColumn("_n", F.row_number().over(w))
    line = F.concat(F.lit("Row "), F.col("_i"), F.lit(": "), F.array_join("_parts", "; "))
    grouped = running.groupBy(*keys, F.floor((F.col("_n") - 1) / F.lit(size)).cast("int").alias("section")).agg(
        F.count("*").alias("_rows"), F.max("_i").alias("_last"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_i", line.alias("line")))), lambda x: x["line"]), "\n").alias("content")
    )
    title = F.when(F.col("_rows") == size, F.concat(F.lit("Rows "), F.col("_last") - size + 1, F.lit(" - "), F.col("_last"))).otherwise(F.lit("CSV Data Records"))
    return grouped.select(*keys, "section", title.alias("section_title"), "content")
