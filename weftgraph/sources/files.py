"""Files of documents: listing, reading, conversion to Markdown."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.functions.text import clean_markdown, normalize_markdown

# Endings of documents, those of a library, and those that are text already.
DOCUMENTS = ("md", "txt", "rst", "ipynb", "pdf", "docx", "html", "asciidoc")
LIBRARY = ("md", "txt", "rst", "pdf", "docx", "html", "pptx", "xlsx", "png", "jpg", "jpeg")
TEXT = ("md", "txt", "rst")
MARKDOWN = ("md", "markdown")
FORMATS = {"pdf": "pdf", "docx": "docx", "pptx": "pptx", "html": "html", "md": "md", "txt": "txt", "asciidoc": "asciidoc", "xlsx": "xlsx"}


def suffix(path: Column) -> Column:
    return F.lower(F.substring_index(path, ".", -1))


def stem(path: Column) -> Column:
    return F.regexp_replace(F.substring_index(path, "/", -1), r"\.[^.]*$", "")


def _files(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)


def scan_files(spark: SparkSession, folder: str, suffixes: tuple[str, ...] = DOCUMENTS) -> DataFrame:
    """path, length and modificationTime of every document below folder (or of one file), by path; contents are not read."""
    files = _files(spark, folder).select("path", "length", "modificationTime")
    return files.filter(suffix(F.col("path")).isin(*suffixes)).orderBy("path")


def scan_library(spark: SparkSession, folder: str) -> DataFrame:
    return scan_files(spark, folder, LIBRARY)


def read_markdown(spark: SparkSession, folder: str) -> DataFrame:
    """path, content, source_hash of every text file; content is null where it isn't UTF-8."""
    files = _files(spark, folder).filter(suffix(F.col("path")).isin(*TEXT))
    return files.select("path", F.try_validate_utf8(F.col("content").cast("string")).alias("content"), F.sha2("content", 256).alias("source_hash"))


def read_documents(docs: DataFrame, content: str = "content", filename: str = "filename") -> DataFrame:
    """filename ("unknown" where it is missing), content and source_hash of documents that are rows already."""
    name = F.coalesce(F.nullif(F.col(filename), F.lit("")), F.lit("unknown")) if filename in docs.columns else F.lit("unknown")
    return docs.select(name.alias("filename"), F.coalesce(F.col(content), F.lit("")).alias("content"), F.sha2(F.coalesce(F.col(content), F.lit("")), 256).alias("source_hash"))


def markdown_name(path: Column) -> Column:
    """The file that a converted document is written to: its stem and six characters of its path's MD5."""
    return F.concat(stem(path), F.lit("_"), F.substring(F.md5(F.encode(path, "UTF-8")), 1, 6), F.lit(".md"))


def format_of(path: Column) -> Column:
    """The format that an extractor is asked for, null for unknown endings."""
    return F.coalesce(*[F.when(suffix(path) == k, v) for k, v in FORMATS.items()])


def ensure_markdown(files: DataFrame, convert: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """path, name, content and error of every file of path and content (binary).

    Markdown passes unchanged, .txt has its white space normalised. Others go to `convert`, a user's function from a DataFrame
    of path, content and format to one of path and converted; what it returns is cleaned and gets a name of its own. A file that
    can't be read or converted is a row with an error, never lost and never the end of the run.
    """
    end = suffix(F.col("path"))
    text = F.try_validate_utf8(F.col("content").cast("string"))
    own = F.when(end.isin(*MARKDOWN), text).when(end == "txt", normalize_markdown(text, stem(F.col("path"))))
    ready = files.filter(end.isin(*MARKDOWN, "txt")).select("path", F.substring_index("path", "/", -1).alias("name"), own.alias("content"), F.when(text.isNull(), "not UTF-8").alias("error"))
    rest = files.filter(~end.isin(*MARKDOWN, "txt"))
    if convert is None:
        lost = rest.select("path", markdown_name(F.col("path")).alias("name"), F.lit(None).cast("string").alias("content"), F.lit("no converter").alias("error"))
        return ready.unionByName(lost)
    made = rest.select("path").join(convert(rest.select("path", "content", format_of(F.col("path")).alias("format"))), "path", "left")
    empty = F.coalesce(F.length(F.trim("converted")), F.lit(0)) == 0
    done = made.select("path", markdown_name(F.col("path")).alias("name"), F.when(~empty, clean_markdown(F.col("converted"), stem(F.col("path")))).alias("content"), F.when(empty, "nothing converted").alias("error"))
    return ready.unionByName(done)


def upload_samples(files: DataFrame, most: int = 2000) -> DataFrame:
    """path and the first characters of text files, a placeholder for others."""
    text = F.try_validate_utf8(F.col("content").cast("string"))
    sample = F.when(suffix(F.col("path")).isin(*TEXT), F.substring(F.coalesce(text, F.lit("")), 1, most)).otherwise(F.concat(F.lit("["), suffix(F.col("path")), F.lit(" file]")))
    return files.select("path", sample.alias("sample"))
