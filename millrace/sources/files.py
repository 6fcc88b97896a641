"""File trees and documents: scans by extension, text of DOCX and PDF pages, JSON, CSV,
vector indexes and calibration lists."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import strip
from .pdf import pdf_pages

#: Loaders by extension: bytes to text. Those that need a model or a program are injected.
Loader = Callable[[bytes], str]


def extension(path: Column) -> Column:
    """The lower-case extension with its dot, or empty text."""
    return F.lower(F.regexp_extract(path, r"(\.[^./\\]+)$", 1))


def file_tree(spark: SparkSession, root: str, extensions: list[str] | None = None) -> DataFrame:
    """(path, source_file, category, file_type, length, content) of all files below a folder.

    The category is the name of the parent folder up to its first underscore. Extensions
    match in any letter case; content is read only where it is used.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    tree = files.select(
        "path",
        F.regexp_extract("path", r"([^/]+)$", 1).alias("source_file"),
        F.substring_index(F.regexp_extract("path", r"([^/]+)/[^/]+$", 1), "_", 1).alias("category"),
        extension(F.col("path")).alias("file_type"),
        "length",
        "content",
    )
    return tree.filter(F.col("file_type").isin([e.lower() for e in extensions])) if extensions else tree


def extension_histogram(files: DataFrame) -> DataFrame:
    return files.groupBy("file_type").agg(F.count("*").alias("n")).orderBy("file_type")


_WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def docx_text(content: bytes) -> str:
    """The non-blank paragraphs of a word-processor file, one a line."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml"))
    lines = ("".join(t.text or "" for t in p.iter(f"{_WORD}t")) for p in body.iter(f"{_WORD}p"))
    return "\n".join(line for line in lines if line.strip())


def plain_text(content: bytes) -> str:
    return content.decode("utf-8-sig", "replace")


def pdf_pages_text(content: bytes, least: int = 30) -> str:
    """The text of the pages of a PDF that hold more than so many characters, joined by lines."""
    return "\n".join(page for page in pdf_pages(content) if len(page.strip()) > least)


LOADERS: dict[str, Loader] = {".docx": docx_text, ".pdf": pdf_pages_text, ".txt": plain_text, ".md": plain_text}


def kept_pages(pages: Column, least: int = 30) -> Column:
    """The text of the pages that hold more than so many characters, joined by lines."""
    return F.array_join(F.filter(pages, lambda p: F.length(strip(p)) > least), "\n")


def loaded(files: DataFrame, loaders: dict[str, Loader] | None = None) -> DataFrame:
    """The files with their text; a failure gives null text and its message, an unknown
    extension empty text."""
    by_extension = {**LOADERS, **(loaders or {})}
    kept = [c for c in files.columns if c != "content"]
    schema = ", ".join(f"`{c}` {files.schema[c].dataType.simpleString()}" for c in kept) + ", text string, error string"

    def load(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            texts, errors = [], []
            for kind, content in zip(frame["file_type"], frame["content"], strict=True):
                text, error = "", None
                if kind in by_extension:
                    try:
                        text = by_extension[kind](bytes(content))
                    except Exception as e:
                        text, error = None, f"{type(e).__name__}: {e}"
                texts.append(text)
                errors.append(error)
            yield frame[kept].assign(text=texts, error=errors)

    return files.mapInPandas(load, schema)


def unless_present(files: DataFrame, done: str, instead_of: str) -> DataFrame:
    """Files without those of one extension whose name exists with another."""
    stem = F.regexp_replace("path", r"\.[^./\\]+$", "")
    have = files.filter(F.col("file_type") == done).select(stem.alias("_s"))
    marked = files.withColumn("_s", F.when(F.col("file_type") == instead_of, stem))
    return marked.join(have, "_s", "left_anti").drop("_s")


def read_json_array(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Records of a JSON array file."""
    reader = spark.read.option("multiLine", "true")
    return (reader.schema(schema) if schema else reader).json(path)


def write_json(df: DataFrame, path: str, mode: str = "error") -> None:
    """JSON lines in UTF-8, one file a partition."""
    df.write.mode(mode).option("ignoreNullFields", "false").json(path)


def read_csv(spark: SparkSession, path: str, schema: str | None = None, index: bool = False) -> DataFrame:
    """A CSV file with a header and perhaps a byte-order mark; an index column is left out."""
    reader = spark.read.option("header", "true").option("encoding", "UTF-8").option("multiLine", "true")
    df = (reader.schema(schema) if schema else reader.option("inferSchema", "true")).csv(path)
    return df.drop(df.columns[0]) if index else df


def write_csv(df: DataFrame, path: str, mode: str = "error") -> None:
    """CSV files with a header, each beginning with a byte-order mark, as spreadsheets want it."""
    first = df.columns[0]
    df.withColumnRenamed(first, "\ufeff" + first).write.mode(mode).option("header", "true").csv(path)


def write_index(vectors: DataFrame, texts: DataFrame, key: str, path: str, mode: str = "error") -> None:
    """Vectors with their texts under explicit keys, as parquet."""
    vectors.join(texts, key).write.mode(mode).parquet(path)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def calibration_pairs(spark: SparkSession, path: str) -> DataFrame:
    """(pair, left, right, cols, rows) of a list whose first line gives the board's size and
    whose others name left and right pictures by turns."""
    lines = spark.read.text(path, wholetext=True)
    rows = lines.select(F.posexplode(F.filter(F.transform(F.split("value", r"\R"), strip), lambda s: F.length(s) > 0)).alias("n", "line"))
    size = rows.filter("n = 0").select(F.split("line", r"\s+").alias("s")).select(F.get("s", F.lit(0)).try_cast("int").alias("cols"), F.get("s", F.lit(1)).try_cast("int").alias("rows"))
    names = rows.filter("n > 0").select(F.floor((F.col("n") - 1) / 2).cast("int").alias("pair"), ((F.col("n") - 1) % 2).alias("side"), "line")
    pairs = names.groupBy("pair").agg(F.max(F.when(F.col("side") == 0, F.col("line"))).alias("left"), F.max(F.when(F.col("side") == 1, F.col("line"))).alias("right"))
    return pairs.crossJoin(F.broadcast(size))


def with_previous(df: DataFrame, group: str, order: str, columns: list[str]) -> DataFrame:
    """Each row beside the values of the row before it in its group."""
    w = Window.partitionBy(group).orderBy(order)
    return df.select("*", *[F.lag(c).over(w).alias(f"previous_{c}") for c in columns])
