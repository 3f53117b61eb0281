"""Files in and out: CSV, plain text, PDF and DOCX documents, JSON and Parquet artifacts."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tagloom.plans.lineage import cut

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def read_csv(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """CSV with a header; quoted fields may hold commas, quotes and line ends."""
    return spark.read.csv(path, schema=schema, header=True, multiLine=True, quote='"', escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True, quote='"', escape='"', quoteAll=True, emptyValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def read_or_empty(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """A Parquet artifact, or an empty table of its schema where it doesn't exist."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    return spark.read.schema(schema).parquet(path) if fs.exists(hadoop) else spark.createDataFrame([], schema)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_by(df: DataFrame, path: str, *by: str) -> None:
    """Parquet in folders by the values of some columns."""
    df.write.mode("overwrite").partitionBy(*by).parquet(path)


def append_new(df: DataFrame, path: str, key: str) -> DataFrame:
    """Appends the rows whose key isn't in the artifact yet, to resume a job; returns them."""
    old = read_or_empty(df.sparkSession, path, df.schema)
    new = cut(df.join(old.select(key).distinct(), key, "left_anti"))
    new.write.mode("append").parquet(path)
    return new


def docx_text(content: bytes) -> str:
    """Paragraphs, then the cells of tables."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        root = ElementTree.fromstring(z.read("word/document.xml"))
    body = root.find(f"{_W}body")
    cells = {p for tc in body.iter(f"{_W}tc") for p in tc.iter(f"{_W}p")}
    text = lambda p: "".join(t.text or "" for t in p.iter(f"{_W}t"))
    return "\n".join([text(p) for p in body.iter(f"{_W}p") if p not in cells] + ["\n".join(text(p) for p in tc.iter(f"{_W}p")) for tc in body.iter(f"{_W}tc")])


def pdf_text(content: bytes) -> str:
    """Text page by page; needs a PDF reader that this package doesn't bring."""
    try:
        import pdfplumber
    except ImportError as e:
        raise ValueError("reading PDF files needs pdfplumber") from e
    with pdfplumber.open(io.BytesIO(content)) as pdf:
        return "\n".join(page.extract_text() or "" for page in pdf.pages)


def file_text(path: str, content: bytes) -> str:
    if re.search(r"\.pdf$", path, re.I):
        return pdf_text(content)
    if re.search(r"\.docx?$", path, re.I):
        return docx_text(content)
    return content.decode("utf-8", "replace")


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """``path, text, error``: documents of a folder by their suffix; unreadable ones keep a null text and the error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for p, c in zip(b["path"], b["content"]):
                try:
                    out.append((p, file_text(p, c), None))
                except Exception as e:  # noqa: BLE001
                    out.append((p, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(out, columns=["path", "text", "error"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, text string, error string")


def unwrap_reply(reply):
    """The list in a model's reply: code fences and an enclosing object removed."""
    x = F.trim(F.regexp_replace(reply, r"(?s)^\s*```[a-zA-Z]*\s*|\s*```\s*$", ""))
    return F.regexp_extract(x, r"(?s)(\[.*\])", 1)
