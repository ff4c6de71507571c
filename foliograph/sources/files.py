"""Files: scan, format sniffing and fail-closed guards. A refused file becomes a row of the quarantine, never a failed job."""

from __future__ import annotations

import io
import zipfile

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliograph.config import Settings
from foliograph.functions.lexicon import first_case
from foliograph.sources.pdf import pdf_facts

# Kinds of errors with what users read about them.
ERRORS = {
    "unsupported_format": ("Nieobsługiwany format pliku.", "Unsupported file format."),
    "parse_error": ("Nie udało się odczytać dokumentu.", "The document could not be read."),
    "resource_limit": ("Dokument przekracza dozwolone limity.", "The document exceeds the allowed limits."),
    "encrypted": ("Dokument jest zaszyfrowany.", "The document is encrypted."),
    "suspicious_archive": ("Archiwum wygląda podejrzanie.", "The archive looks suspicious."),
    "ingestion_error": ("Błąd przetwarzania dokumentu.", "The document could not be processed."),
}
REQUIRED_PARTS = ("word/document.xml", "[Content_Types].xml")
EXTENSIONS = {"pdf": ("pdf",), "docx": ("docx",), "tex": ("tex", "latex", "ltx")}
MAIN_NAMES = ("main.tex", "master.tex", "thesis.tex", "praca.tex")
_ENTRIES = T.ArrayType(T.StructType().add("name", "string").add("file_size", "long").add("compress_size", "long"))


def scan(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(doc_id, path, filename, length, sha256, content) of all files below a path; doc_id is the content's hash."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    sha = F.sha2("content", 256)
    return files.select(sha.alias("doc_id"), "path", F.element_at(F.split("path", "/"), -1).alias("filename"), "length", sha.alias("sha256"), "content")


@F.pandas_udf(T.StringType())
def decoded(contents: pd.Series) -> pd.Series:
    """Bytes as UTF-8, else cp1250, else Latin-1."""

    def one(raw: bytes) -> str:
        for encoding in ("utf-8-sig", "cp1250"):
            try:
                return raw.decode(encoding)
            except UnicodeDecodeError:
                continue
        return raw.decode("latin-1")

    return contents.map(lambda raw: None if raw is None else one(raw))


@F.pandas_udf(T.BooleanType())
def _is_cp1250(heads: pd.Series) -> pd.Series:
    def one(raw: bytes) -> bool:
        try:
            raw.decode("cp1250")
        except UnicodeDecodeError:
            return False
        return True

    return heads.map(lambda raw: raw is not None and one(raw))


def sniff(content: str | Column) -> Column:
    """pdf, docx or tex by the first 4096 bytes; null for binary and empty content."""
    head = F.substring(F.col(content) if isinstance(content, str) else content, 1, 4096)
    starts = lambda magic: F.substring(head, 1, len(magic)) == F.lit(bytearray(magic))
    text = (F.octet_length(head) > 0) & ~F.hex(head).rlike("^(..)*?00") & (F.is_valid_utf8(head.cast("string")) | _is_cp1250(head))
    return first_case([(starts(b"%PDF-"), "pdf"), (starts(b"PK\x03\x04"), "docx"), (text, "tex")])


def detect(files: DataFrame) -> DataFrame:
    """files with source_format; null where content and extension disagree."""
    extension = F.lower(F.regexp_extract("filename", r"\.([^.]+)$", 1))
    agrees = [((F.col("sniffed") == k) & extension.isin(*v), "latex" if k == "tex" else k) for k, v in EXTENSIONS.items()]
    return files.withColumn("sniffed", sniff("content")).withColumn("source_format", first_case(agrees)).drop("sniffed")


@F.pandas_udf(_ENTRIES)
def zip_entries(contents: pd.Series) -> pd.Series:
    """The members of an archive; null if it is none."""

    def one(raw: bytes) -> list[dict] | None:
        try:
            with zipfile.ZipFile(io.BytesIO(raw)) as z:
                return [{"name": i.filename, "file_size": i.file_size, "compress_size": i.compress_size} for i in z.infolist()]
        except (zipfile.BadZipFile, ValueError, EOFError, OSError):
            return None

    return contents.map(lambda raw: None if raw is None else one(raw))


def container_error(entries: Column, s: Settings) -> Column:
    """The error kind of an archive's member list, or null."""
    total = F.aggregate(entries, F.lit(0).cast("long"), lambda n, e: n + e.file_size)
    packed = F.aggregate(entries, F.lit(0).cast("long"), lambda n, e: n + e.compress_size)
    names = F.transform(entries, lambda e: e["name"])
    outside = F.exists(names, lambda n: n.startswith("/") | n.startswith("\\") | F.exists(F.split(n, r"[/\\]"), lambda p: p == ".."))
    missing = F.size(F.array_except(F.array(*(F.lit(p) for p in REQUIRED_PARTS)), names)) > 0
    return first_case([
        (entries.isNull(), "parse_error"), (F.size(entries) > s.max_zip_members, "suspicious_archive"), (missing, "unsupported_format"), (outside, "suspicious_archive"),
        (total > s.max_uncompressed_mb * 1024 * 1024, "suspicious_archive"), ((packed > 0) & (total > packed * s.max_compression_ratio), "suspicious_archive"),
    ])


def guarded(files: DataFrame, settings: Settings | None = None) -> tuple[DataFrame, DataFrame]:
    """(accepted files, quarantine): size first, then format, then the archive's members or the PDF's pages and encryption (a PDF that shows no page count passes)."""
    s = settings or Settings()
    small = F.col("length") <= s.max_upload_mb * 1024 * 1024
    known = detect(files.filter(small))
    listed = known.withColumn("entries", F.when(F.col("source_format") == "docx", zip_entries("content")))
    listed = listed.withColumn("facts", F.when(F.col("source_format") == "pdf", pdf_facts("content")))
    pages = F.col("facts.pages")
    pdf_error = first_case([(F.col("facts.encrypted"), "encrypted"), (pages > s.max_pages, "resource_limit"), (pages == 0, "parse_error")])
    error = F.when(F.col("source_format").isNull(), "unsupported_format").when(F.col("source_format") == "docx", container_error(F.col("entries"), s)).when(F.col("source_format") == "pdf", pdf_error)
    checked = listed.withColumn("error_kind", error).drop("facts")
    refused = checked.filter("error_kind IS NOT NULL").select("doc_id", "path", "filename", "length", "error_kind")
    refused = refused.unionByName(files.filter(~small).select("doc_id", "path", "filename", "length", F.lit("resource_limit").alias("error_kind")))
    says = lambda i: first_case([(F.col("error_kind") == k, v[i]) for k, v in ERRORS.items()])
    return checked.filter("error_kind IS NULL").drop("error_kind", "entries"), refused.withColumns({"message_pl": says(0), "message_en": says(1)})


def corpus(spark: SparkSession, path: str) -> DataFrame:
    """(name, path, annotation): each <name>.expected.json with its document, of several by docx, pdf, tex, then a folder's main file; without one it is left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path")
    root = F.regexp_replace(F.lit(path.rstrip("/")), r"^file:/*", "/")
    rel = files.withColumn("rel", F.regexp_replace(F.regexp_replace("path", r"^file:/*", "/"), F.concat(F.lit(r"^\Q"), root, F.lit(r"\E/")), ""))
    sidecars = spark.read.text(f"{path}/*.expected.json", wholetext=True).select(F.regexp_extract(F.input_file_name(), r"([^/]+)\.expected\.json$", 1).alias("name"), F.col("value").alias("annotation"))
    plain = rel.filter(~F.contains("rel", F.lit("/"))).select(F.regexp_extract("rel", r"^(.*)\.(docx|pdf|tex)$", 1).alias("name"), F.regexp_extract("rel", r"\.(docx|pdf|tex)$", 1).alias("kind"), "path").filter("name <> ''")
    mains = rel.filter(F.element_at(F.split("rel", "/"), -1).isin(*MAIN_NAMES) & (F.size(F.split("rel", "/")) == 2)).select(F.substring_index("rel", "/", 1).alias("name"), F.element_at(F.split("rel", "/"), -1).alias("kind"), "path")
    order = {k: i for i, k in enumerate(("docx", "pdf", "tex", *MAIN_NAMES))}
    ranked = plain.unionByName(mains).withColumn("rank", first_case([(F.col("kind") == k, F.lit(v)) for k, v in order.items()]))
    best = ranked.groupBy("name").agg(F.min_by("path", "rank").alias("path"))
    return sidecars.join(best, "name").select("name", "path", "annotation")
