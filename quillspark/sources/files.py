"""Sources and sinks: files, archives, JSON lines, compressed pages, ledgers, stores."""

from __future__ import annotations

import gzip
import io
import zipfile
import zlib
from collections.abc import Callable, Iterator
from itertools import accumulate

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.functions.quality import OCR_SUFFIXES
from quillspark.functions.text import suffix_of
from quillspark.schemas import CANON, MANIFEST, MANIFEST_FIELDS
from quillspark.util import cut


def files(spark: SparkSession, path: str) -> DataFrame:
    """(path, modificationTime, length, content) of the files below ``path``."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)


def in_order(rows: DataFrame, *order: str) -> DataFrame:
    """O1: ``rows`` with ``place``, from 0 in order of the columns (nulls first): sorted by ranges over all tasks, and each
    range's first place from the sizes of those before it. Equal rows have places in no stated order."""
    ranged = cut(rows.orderBy(*order).withColumn("__part", F.spark_partition_id()).withColumn("__at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))))
    sizes = sorted((r["__part"], r["n"]) for r in ranged.groupBy("__part").agg(F.count("*").alias("n")).collect())  # a row per task
    starts = list(accumulate((n for _, n in sizes), initial=0))
    first = rows.sparkSession.createDataFrame([(part, start) for (part, _), start in zip(sizes, starts)], "__part int, __first bigint")
    return ranged.join(F.broadcast(first), "__part").withColumn("place", F.col("__first") + F.col("__at")).select(*rows.columns, "place")


def json_lines(spark: SparkSession, path: str, schema: str = CANON) -> DataFrame:
    """Records of JSON lines; blank lines are skipped, a malformed one fails the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """A saved manifest, one JSON object of entries by address; a missing or corrupt file is empty.

    Only what isn't there or isn't such an object counts as empty: missing rights and the like are errors.
    """
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(folder):
        return spark.createDataFrame([], MANIFEST)
    entry = "STRUCT<" + ", ".join(f"{c}: STRING" for c in MANIFEST_FIELDS) + ">"
    read = spark.read.text(path, wholetext=True).select(F.from_json("value", f"MAP<STRING, {entry}>").alias("m"))
    return read.select(F.explode("m").alias("pdf_url", "e")).select("pdf_url", "e.*")


def save_manifest(entries: DataFrame) -> DataFrame:
    """K6: (content): the manifest as one JSON object by address. One file of one run's addresses, as other programs read
    it; between runs the manifest stays a table."""
    fields = F.to_json(F.struct(*MANIFEST_FIELDS), {"ignoreNullFields": "false"})
    pair = F.concat(F.substring(F.to_json(F.array("pdf_url")), 2, 2**30), F.lit(""))
    return entries.select(F.concat(F.regexp_replace(pair, r"\]$", ""), F.lit(": "), fields).alias("line")).agg(F.concat(F.lit("{"), F.array_join(F.array_sort(F.collect_list("line")), ",\n"), F.lit("}")).alias("content"))


def archive_entries(archives: DataFrame) -> DataFrame:
    """(archive, entry, content, error) of the supported files in ZIP archives (path, content), in any depth.

    An archive that can't be read gives one row with its error. Order by (archive, entry).
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path, content in zip(frame["path"], frame["content"]):
                try:
                    with zipfile.ZipFile(io.BytesIO(content)) as archive:
                        names = [n for n in sorted(archive.namelist()) if n.lower().endswith(OCR_SUFFIXES)]
                        for name in names:
                            yield pd.DataFrame({"archive": [path], "entry": [name], "content": [archive.read(name)], "error": [None]})
                except Exception as problem:
                    yield pd.DataFrame({"archive": [path], "entry": [None], "content": [None], "error": [str(problem)]})

    return archives.select("path", "content").mapInPandas(run, "archive string, entry string, content binary, error string")


# What is said of an upload that can't be worked on.
NO_FILE, BAD_ARCHIVE, NOTHING_FOUND = "Please upload a ZIP or PDF file first.", "That file doesn't look like a valid ZIP archive.", "No supported files/pages found."


def batch_status(uploads: DataFrame) -> DataFrame:
    """(path, message) of uploads (path, content): null where there is something to work on, else what is wrong."""

    @F.pandas_udf("string")
    def inside(content: pd.Series) -> pd.Series:
        def one(value: bytes) -> str | None:
            try:
                with zipfile.ZipFile(io.BytesIO(value)) as archive:
                    return None if any(n.lower().endswith(OCR_SUFFIXES) for n in archive.namelist()) else NOTHING_FOUND
            except Exception:
                return BAD_ARCHIVE

        return content.map(one, na_action="ignore").astype(object)

    suffix = suffix_of(F.col("path"))
    unfit = F.concat(F.lit("Unsupported file type '"), suffix, F.lit("'. Upload a .zip or a .pdf."))
    zipped = inside(F.when(suffix == ".zip", F.coalesce("content", F.lit(b""))))
    return uploads.select("path", F.when(F.col("path").isNull(), NO_FILE).when(suffix == ".zip", zipped).when(suffix != ".pdf", unfit).alias("message"))


@F.pandas_udf(T.BinaryType())
def gunzip(content: pd.Series) -> pd.Series:
    """Content without gzip, where it begins as gzip does; null where that is broken."""

    def plain(value: bytes) -> bytes | None:
        try:
            return gzip.decompress(value) if value[:2] == b"\x1f\x8b" else value
        except (OSError, EOFError, zlib.error):
            return None

    return content.map(plain, na_action="ignore")


@F.pandas_udf(T.BinaryType())
def gunzip_named(url: pd.Series, content: pd.Series) -> pd.Series:
    """As :func:`gunzip`, and also where the address ends in ``.gz``; null where the content is no gzip then."""

    def plain(name: str | None, value: bytes | None) -> bytes | None:
        try:
            return None if value is None else gzip.decompress(value) if (name or "").endswith(".gz") or value[:2] == b"\x1f\x8b" else value
        except (OSError, EOFError, zlib.error):
            return None

    return pd.Series([plain(u, c) for u, c in zip(url, content)], dtype=object)


def split_pages(documents: DataFrame, splitter: Callable[[bytes], list[bytes]], file_no: str | None = None) -> DataFrame:
    """(path, file_no, page_no, name, content): PDFs page by page by the injected ``splitter``, images as
    they are. ``file_no`` is the column with a file's place, else null; order by (file_no, path, page_no)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path, place, content in zip(frame["path"], frame["file_no"], frame["content"]):
                pages = splitter(content)
                yield pd.DataFrame({"path": path, "file_no": pd.array([place] * len(pages), dtype="Int64"), "page_no": range(1, len(pages) + 1), "content": pages})

    suffix = suffix_of(F.col("path"))
    placed = documents.select("path", (F.col(file_no) if file_no else F.lit(None)).cast("bigint").alias("file_no"), "content")
    pdf = placed.where(suffix == ".pdf").mapInPandas(run, "path string, file_no bigint, page_no int, content binary")
    stem = F.regexp_extract("path", r"([^/]*)\.[^./]+$", 1)
    named = pdf.withColumn("name", F.concat(stem, F.lit("_page"), F.col("page_no").cast("string"), F.lit(".pdf")))
    images = placed.where((suffix != ".pdf") & suffix.isin(*OCR_SUFFIXES)).select("path", "file_no", F.lit(1).alias("page_no"), "content", F.regexp_extract("path", "([^/]*)$", 1).alias("name"))
    return named.unionByName(images).select("path", "file_no", "page_no", "name", "content")


def extract(documents: DataFrame, hebrew: Column, convert: Callable[[bytes], str], pages_of: Callable[[bytes], list[str]], recognise: Callable[[bytes, int], list[dict]], image_says: Callable[[bytes], bool | None] | None = None, dpi: int = 300) -> DataFrame:
    """(path, markdown, used_ocr, error) of documents (path, content).

    The Hebrew flag is resolved from ``hebrew``, the suffix, the text layer of the first pages (``pages_of``) and the image
    (``image_says``). Hebrew files of OCR suffixes take their text layer where it serves, else the words that ``recognise``
    finds (rows of page, block_num, par_num, line_num, pos, text, conf at ``dpi``), regrouped page by page; all others go
    through the layout converter. Then entities are resolved and invisible marks dropped, and from recognised text what
    only recognition leaves. Each branch is filtered before its model runs; a failing file has a null text and its error.
    """
    from quillspark.functions.quality import first_pages, hebrew_ratio, native_pages, resolve_hebrew
    from quillspark.functions.text import strip_marks, strip_ocr_matter, unescape
    from quillspark.operators.ocr import join_pages, regroup

    def model(call: Callable, kind: str):
        @F.pandas_udf(f"value {kind}, error string")
        def run(content: pd.Series) -> pd.DataFrame:
            rows = []
            for value in content:
                try:
                    rows.append((call(value), None))
                except Exception as problem:
                    rows.append((None, str(problem) or type(problem).__name__))
            return pd.DataFrame(rows, columns=["value", "error"], dtype=object)

        return run

    suffix = suffix_of(F.col("path"))
    of_kind = suffix.isin(*OCR_SUFFIXES)
    layered = documents.select("path", "content", hebrew.alias("flag"), F.when(suffix == ".pdf", F.col("content")).alias("pdf"), F.when(of_kind, F.col("content")).alias("image"))
    layered = layered.withColumn("pages", model(lambda c: None if c is None else pages_of(c), "array<string>")("pdf")["value"])
    says = model(lambda c: None if c is None or image_says is None else image_says(c), "boolean")("image")["value"]
    marked = cut(layered.withColumn("hebrew", resolve_hebrew(F.col("flag"), suffix, hebrew_ratio(first_pages(F.col("pages"))), says)).withColumn("layer", native_pages(F.col("pages"), F.lit(True))).drop("pdf", "image", "pages"))
    scanned = F.col("hebrew") & of_kind
    native = marked.where(scanned & F.col("layer").isNotNull()).select("path", F.col("layer").alias("text"), F.lit(True).alias("used_ocr"), F.lit(None).cast("string").alias("error"))
    word = "array<struct<page:int,block_num:int,par_num:int,line_num:int,pos:int,text:string,conf:string>>"
    seen = cut(marked.where(scanned & F.col("layer").isNull()).select("path", model(lambda c: recognise(c, dpi), word)("content").alias("r")))
    pages = regroup(seen.select("path", F.explode("r.value").alias("w")).select("path", "w.*"), ["path", "page"])
    read = seen.select("path", F.col("r.error").alias("error")).join(join_pages(pages, "path", "page", "text"), "path", "left").select("path", F.when(F.col("error").isNull(), F.coalesce("text", F.lit(""))).alias("text"), F.lit(True).alias("used_ocr"), "error")
    plain = marked.where(~scanned).select("path", model(convert, "string")("content").alias("r")).select("path", F.col("r.value").alias("text"), F.lit(False).alias("used_ocr"), F.col("r.error").alias("error"))
    whole = native.unionByName(read).unionByName(plain).withColumn("text", strip_marks(unescape(F.col("text"))))
    return whole.select("path", F.when(F.col("used_ocr"), strip_ocr_matter(F.col("text"))).otherwise(F.col("text")).alias("markdown"), "used_ocr", "error")


def write_ledger(rows: DataFrame, path: str) -> None:
    """K5: ledger rows, a folder per sheet; Unrecognized only where it has rows."""
    rows.write.mode("overwrite").partitionBy("sheet").parquet(path)


#: K2: the property of a vector store's table that says how its vectors are compared.
SPACE_PROPERTY, COSINE = "vector.space", "cosine"


def write_store(rows: DataFrame, path: str) -> None:
    """K1, K2: a vector store's new state, to a path of its own (never the one that is read); its schema carries how vectors
    are compared, which :func:`store_space` reads."""
    columns = [F.col(c.name).alias(c.name, metadata={**c.metadata, SPACE_PROPERTY: COSINE}) if c.name == "embedding" else F.col(c.name) for c in rows.schema]
    rows.select(*columns).write.mode("errorifexists").parquet(path)


def open_store(spark: SparkSession, path: str) -> DataFrame | None:
    """The vector store at ``path``, or None where there is none."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(folder):
        return None
    return spark.read.parquet(path)


def store_space(store: DataFrame) -> str | None:
    """K2: how the vectors of an opened store are compared."""
    return store.schema["embedding"].metadata.get(SPACE_PROPERTY)


def store_health(spark: SparkSession, root: str, name: str) -> DataFrame:
    """(stores, found, n): how many stores are below ``root``, whether ``name`` is one of them, and its vectors."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(root)
    system = folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    names = [e.getPath().getName() for e in system.listStatus(folder) if e.isDirectory()] if system.exists(folder) else []
    n = spark.read.parquet(f"{root}/{name}").count() if name in names else 0
    return spark.createDataFrame([(len(names), name in names, n)], "stores int, found boolean, n bigint")
