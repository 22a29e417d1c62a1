"""Sources: delimited tables, canonical corpora, reviews, JSON lines, ZIP collections and folders of text."""

from __future__ import annotations

import bz2
import codecs
import csv
import gzip
import io
import zipfile
from collections.abc import Callable, Iterator, Sequence
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textquarry.errors import CorpusReadError, InvalidInput
from textquarry.functions.text import strip
from textquarry.session import shared_path

CSV_OPTIONS = {"header": True, "quote": '"', "escape": '"', "multiLine": True, "mode": "FAILFAST", "inferSchema": False, "enforceSchema": False}
CANONICAL_HEADERS = (("id", "text"), ("id", "text", "label"), ("id", "text", "split"), ("id", "text", "label", "split"))
SPLITS = ("train", "validation", "test")
DOCUMENT = "id string, title string, text string"


# Encodings that Spark's reader takes; files in others are decoded whole, one file a task.
NATIVE_ENCODINGS = {"utf-8", "us-ascii", "iso-8859-1", "utf-16", "utf-16be", "utf-16le", "utf-32"}


def _decoded(spark: SparkSession, path: str, delimiter: str, encoding: str, names: list[str] | None) -> DataFrame:
    """Rows of files in an encoding that only Python decodes, as arrays of fields, the header left out; without
    names the header itself."""
    codecs.lookup(encoding)
    width = len(names or ())

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                data = bz2.decompress(content) if name.endswith(".bz2") else gzip.decompress(content) if name.endswith(".gz") else content
                rows = csv.reader(io.StringIO(data.decode(encoding), newline=""), delimiter=delimiter, strict=True)
                header = next(rows, [])
                if names is None:
                    yield pa.RecordBatch.from_arrays([pa.array([header], pa.list_(pa.string()))], ["fields"])
                    continue
                held = [r + [""] * (width - len(r)) for r in rows if r]
                if any(len(r) > width for r in held):
                    raise ValueError(f"{name}: a row has more fields than the header")
                yield pa.RecordBatch.from_arrays([pa.array(held, pa.list_(pa.string()))], ["fields"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(parse, "fields array<string>")


def _header(spark: SparkSession, path: str, delimiter: str, encoding: str) -> list[str]:
    """Column names of the first line; only that line is read."""
    if encoding.lower() not in NATIVE_ENCODINGS:
        first = _decoded(spark, path, delimiter, encoding, None).first()
        if not first or not first["fields"]:
            raise CorpusReadError(f"{path}: empty")
        return first["fields"]
    rows = spark.read.options(sep=delimiter, encoding=encoding, quote='"', escape='"', multiLine=False).csv(path).limit(1).collect()
    if not rows:
        raise CorpusReadError(f"{path}: empty")
    return [(x or "").lstrip("﻿") for x in rows[0]]


def read_table(spark: SparkSession, path: str, required: Sequence[str] = (), delimiter: str = ",", encoding: str = "UTF-8") -> DataFrame:
    """A delimited file with header; all values strings, absent ones empty. bz2 and gz are read as they are.

    Missing required columns, a repeated column, a row with more fields than the header and a broken quote
    are errors; the last two show when rows are read, also behind rows that a limit takes.
    """
    if len(delimiter) != 1:
        raise InvalidInput("the delimiter is one character")
    names = _header(spark, path, delimiter, encoding)
    missing = [c for c in required if c not in names]
    if missing:
        raise CorpusReadError(f"{path}: no column {', '.join(missing)}")
    if len(set(names)) < len(names):
        raise CorpusReadError(f"{path}: a column stands twice")
    if encoding.lower() not in NATIVE_ENCODINGS:
        return _decoded(spark, path, delimiter, encoding, names).select(*[F.col("fields")[i].alias(n) for i, n in enumerate(names)])
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    df = spark.read.options(**CSV_OPTIONS, sep=delimiter, encoding=encoding).schema(schema).csv(path)
    return df.select(*[F.coalesce(F.col(f"`{n}`"), F.lit("")).alias(n) for n in names])


def read_canonical(spark: SparkSession, path: str, validate: bool = True) -> DataFrame:
    """(id, text, label, split) of a canonical corpus; label and split are null where the file lacks them."""
    names = tuple(_header(spark, path, ",", "UTF-8"))
    if names not in CANONICAL_HEADERS:
        raise CorpusReadError(f"{path}: the header is none of {CANONICAL_HEADERS}")
    df = read_table(spark, path, names)
    df = df.select("id", "text", *[F.col(c) if c in names else F.lit(None).cast("string").alias(c) for c in ("label", "split")])
    return require_valid(df) if validate else df


def canonical_violations(df: DataFrame) -> DataFrame:
    """One row of counts: rows, empty ids and texts, repeats of ids and texts, labels and splits that break the
    rule that one means all. Only aggregates; repeats are counted after partial grouping."""
    plain = df.select(*[F.col(c) for c in ("id", "text", "label", "split")])
    sums = plain.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(F.coalesce(F.col("id"), F.lit("")) == "").alias("empty_id"),
        F.count_if(F.coalesce(F.col("text"), F.lit("")) == "").alias("empty_text"),
        F.count("label").alias("_labels"), F.count_if(F.col("label") == "").alias("_blank_labels"),
        F.count("split").alias("_splits"), F.count_if(~F.col("split").isin(*SPLITS)).alias("_bad_splits"),
    )
    repeats = [plain.groupBy(c).count().agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias(f"repeated_{c}")) for c in ("id", "text")]
    both = sums.select("*", *[r.scalar().alias(f"repeated_{c}") for r, c in zip(repeats, ("id", "text"), strict=True)])
    labels = F.when(F.col("_labels") > 0, F.col("rows") - F.col("_labels") + F.col("_blank_labels")).otherwise(0)
    splits = F.when(F.col("_splits") > 0, F.col("rows") - F.col("_splits") + F.col("_bad_splits")).otherwise(0)
    return both.select("rows", "empty_id", "empty_text", "repeated_id", "repeated_text", labels.cast("long").alias("bad_label"), splits.cast("long").alias("bad_split"))


def require_valid(df: DataFrame) -> DataFrame:
    """df, if it is a valid canonical corpus; else an error that names what is wrong."""
    found = canonical_violations(df).first().asDict()
    rows = found.pop("rows")
    bad = {k: v for k, v in found.items() if v}
    if bad or not rows:
        raise InvalidInput("not a canonical corpus: " + (", ".join(f"{k} {v}" for k, v in bad.items()) or "no rows"))
    return df


def read_reviews(spark: SparkSession, path: str, labels: Sequence[str] = ("negative", "neautral", "positive")) -> DataFrame:
    """(review, sentiment) of a tab-separated file with exactly these columns; empty values and unknown labels
    are errors."""
    if _header(spark, path, "\t", "UTF-8") != ["review", "sentiment"]:
        raise CorpusReadError(f"{path}: the columns are not review and sentiment")
    df = read_table(spark, path, ("review", "sentiment"), "\t")
    # The values that a table reader commonly takes for missing are missing here too.
    missing = ["", "NA", "N/A", "NaN", "nan", "null", "NULL", "None", "n/a", "<NA>", "#N/A"]
    bad = df.agg(F.count_if(F.col("review").isin(missing) | F.col("sentiment").isin(missing)).alias("m"), F.count_if(~F.col("sentiment").isin(*labels)).alias("l")).first()
    if bad["m"] or bad["l"]:
        raise InvalidInput(f"{path}: {bad['m']} rows with a missing value, {bad['l']} with an unknown label")
    return df


def numbered(df: DataFrame) -> DataFrame:
    """df with seq, increasing in source order within a file's partitions."""
    return df.withColumn("seq", F.monotonically_increasing_id())


def read_documents_csv(spark: SparkSession, path: str) -> DataFrame:
    df = read_table(spark, path, ("id", "text"))
    title = F.col("title") if "title" in df.columns else F.lit("")
    return numbered(df.select("id", title.alias("title"), "text"))


def parse_json_lines(lines: DataFrame) -> DataFrame:
    """(id, title, text, seq) of lines of JSON objects; blank lines are skipped, and a line without scalar _id or
    string text is an error that shows the line when it is read."""
    row = F.try_parse_json("value")
    text_kind, id_kind = [F.schema_of_variant(F.try_variant_get(row, p, "variant")) for p in ("$.text", "$._id")]
    ok = F.coalesce(text_kind == "STRING", F.lit(False)) & F.coalesce(~id_kind.rlike("^(OBJECT|ARRAY|VOID)"), F.lit(False))
    checked = lines.where(strip(F.col("value")) != "")
    bad = F.raise_error(F.concat(F.lit("not a document: "), F.substring("value", 1, 200))).cast("string")
    value = lambda p: F.try_variant_get(row, p, "string")
    return checked.select(F.when(ok, value("$._id")).otherwise(bad).alias("id"), F.coalesce(value("$.title"), F.lit("")).alias("title"), value("$.text").alias("text"), F.monotonically_increasing_id().alias("seq"))


def read_json_lines(spark: SparkSession, path: str) -> DataFrame:
    return parse_json_lines(spark.read.text(path))


def read_zip(spark: SparkSession, path: str, entry: str = "corpus.jsonl") -> DataFrame:
    """The entry of a ZIP file, unpacked once to the shared folder so that many tasks can read it."""
    try:
        with zipfile.ZipFile(path.removeprefix("file://")) as archive:
            if entry not in archive.namelist():
                raise CorpusReadError(f"{path}: no entry {entry}")
            target = shared_path(spark, "unpacked")
            jvm = spark.sparkContext._jvm
            file = jvm.org.apache.hadoop.fs.Path(f"{target}/{entry}")
            out = file.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(file)
            with archive.open(entry) as source:
                while block := source.read(1 << 20):
                    out.write(bytearray(block))
            out.close()
    except zipfile.BadZipFile as e:
        raise CorpusReadError(f"{path}: not a ZIP file") from e
    return read_json_lines(spark, f"{target}/{entry}")


def read_text_folder(spark: SparkSession, path: str) -> DataFrame:
    """All .txt files below a folder, in whatever letter case: id is the path from the folder, title the name."""
    files = spark.read.options(recursiveFileLookup=True, pathGlobFilter="*.[tT][xX][tT]").text(path, wholetext=True)
    name = F.regexp_replace(F.url_decode(F.regexp_replace(F.col("_metadata.file_path"), r"\+", "%2B")), r"^file:/+", "/")
    root = "/" + str(Path(path.removeprefix("file://")).resolve()).strip("/") + "/"
    relative = F.expr(f"substring(_path, {len(root) + 1})")
    ordered = files.select(name.alias("_path"), "value").orderBy("_path")
    return ordered.select(relative.alias("id"), F.regexp_extract("_path", "[^/]+$", 0).alias("title"), F.col("value").alias("text"), F.monotonically_increasing_id().alias("seq"))


def _is_folder(path: str) -> bool:
    return Path(path.removeprefix("file://")).is_dir()


#: Readers in the order in which they are asked; a folder is one of text whatever its name.
FORMATS: list[tuple[Callable[[str], bool], Callable[[SparkSession, str], DataFrame]]] = [
    (_is_folder, read_text_folder),
    (lambda p: p.lower().endswith(".csv"), read_documents_csv),
    (lambda p: p.lower().endswith(".jsonl"), read_json_lines),
    (lambda p: p.lower().endswith(".zip"), read_zip),
]


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """(id, title, text, seq) by the first format that supports the path."""
    for supports, reader in FORMATS:
        if supports(path):
            return reader(spark, path)
    raise InvalidInput(f"no reader for {path}")


def read_until(df: DataFrame, rows: int) -> DataFrame:
    """The first rows in source order. Spark may read ahead, so a damaged record behind them can still fail."""
    return df.orderBy("seq").limit(rows)


def read_queries(spark: SparkSession, path: str) -> DataFrame:
    """(query_id, text) of JSON lines; ids not blank and unique, text not null."""
    row = F.from_json("value", "_id string, text string")
    df = spark.read.text(path).where(strip(F.col("value")) != "").select(row["_id"].alias("query_id"), row["text"].alias("text"))
    bad = df.agg(F.count_if(F.coalesce(strip(F.col("query_id")), F.lit("")) == "").alias("i"), F.count_if(F.col("text").isNull()).alias("t"), (F.count("query_id") - F.countDistinct("query_id")).alias("r")).first()
    if any(bad):
        raise CorpusReadError(f"{path}: {bad['i']} queries without id, {bad['t']} without text, {bad['r']} repeated")
    return df


def read_judgments(spark: SparkSession, path: str, queries: DataFrame) -> DataFrame:
    """(query_id, doc_id, score) with score > 0; scores are whole and not negative, queries known, pairs unique."""
    row = F.try_parse_json("value")
    whole = F.schema_of_variant(F.try_variant_get(row, "$.score", "variant")) == "BIGINT"
    df = spark.read.text(path).where(strip(F.col("value")) != "").select(
        F.get_json_object("value", "$['query-id']").alias("query_id"),
        F.get_json_object("value", "$['corpus-id']").alias("doc_id"), F.when(whole, F.try_variant_get(row, "$.score", "int")).alias("score"),
    )
    bad = df.agg(F.count_if(F.col("score").isNull() | (F.col("score") < 0) | F.col("query_id").isNull() | F.col("doc_id").isNull()).alias("b")).first()["b"]
    unknown = df.join(queries.select("query_id"), "query_id", "left_anti").count()
    repeated = df.groupBy("query_id", "doc_id").count().where("count > 1").count()
    if bad or unknown or repeated:
        raise CorpusReadError(f"{path}: {bad} damaged rows, {unknown} of unknown queries, {repeated} repeated pairs")
    return df.where("score > 0")


def query_text(text: str | None, file: str | None) -> str:
    """Exactly one of a text and a file with it."""
    if (text is None) == (file is None):
        raise InvalidInput("give either a text or a file")
    return text if text is not None else Path(file).read_text("utf-8")
