"""Declared preparation of a table into a canonical corpus: map, deduplicate, split, sample, check, write."""

from __future__ import annotations

import importlib
import math
import tomllib
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textquarry.errors import InvalidInput
from textquarry.functions.text import joined, labels_replaced, strip
from textquarry.operators.dedup import deduplicate
from textquarry.operators.splits import SPLITS, allocate, sample_per_group, seeded_splits
from textquarry.session import materialize
from textquarry.sources.readers import read_table, require_valid
from textquarry.sources.sinks import write_canonical


@dataclass(frozen=True)
class TableConfig:
    text: tuple[str, ...]
    id: str | None = None
    label: str | None = None
    split: str | None = None
    joiner: str = " "
    format: str = "csv"
    encoding: str = "utf-8"
    delimiter: str = ","
    trim: bool = True
    empty: str = "error"
    labels: Mapping[str, str] = field(default_factory=dict)
    duplicates: str = "error"
    conflicts: str = "error"
    tie: str = "error"
    split_enabled: bool = False
    shares: Mapping[str, float] = field(default_factory=dict)
    seed: int = 42
    per_class: int | None = None
    per_split: int | Mapping[str, int] | None = None
    expected_rows: int | None = None
    expected_classes: int | None = None
    expected_splits: Mapping[str, float] = field(default_factory=dict)
    adapter: str | None = None
    parameters: Mapping[str, object] = field(default_factory=dict)


def _fail(where: str, what: str):
    raise InvalidInput(f"[{where}] {what}")


def _string(value, where):
    return value if isinstance(value, str) and value else _fail(where, "is text that is not empty")


def _choice(*allowed):
    return lambda value, where: value if value in allowed else _fail(where, f"is one of {', '.join(allowed)}")


def _flag(value, where):
    return value if isinstance(value, bool) else _fail(where, "is true or false")


def _whole(least):
    return lambda value, where: value if isinstance(value, int) and not isinstance(value, bool) and value >= least else _fail(where, f"is a whole number from {least}")


def _strings(value, where):
    ok = isinstance(value, dict) and all(isinstance(k, str) and isinstance(v, str) for k, v in value.items())
    return dict(value) if ok else _fail(where, "is a table of texts")


def _text_columns(value, where):
    columns = [value] if isinstance(value, str) else value
    ok = isinstance(columns, list) and columns and all(isinstance(c, str) and c for c in columns) and len(set(columns)) == len(columns)
    return tuple(columns) if ok else _fail(where, "is a column or a list of different ones")


def _per_split(value, where):
    if isinstance(value, dict):
        ok = set(value) <= set(SPLITS) and all(isinstance(v, int) and not isinstance(v, bool) and v >= 0 for v in value.values())
        return dict(value) if ok else _fail(where, "holds sizes of splits")
    return _whole(1)(value, where)


def percentages(values: Mapping, where: str) -> dict[str, float]:
    """Shares from percents of splits: finite, not negative, 100 together."""
    ok = set(values) <= set(SPLITS) and all(isinstance(v, int | float) and not isinstance(v, bool) and math.isfinite(v) and v >= 0 for v in values.values())
    if not ok or abs(sum(values.values()) - 100) > 1e-9:
        _fail(where, "holds percents of splits, 100 together")
    return {k: v / 100 for k, v in values.items()}


#: Of each table of a configuration its keys, the field that takes the value, and the check.
_SCHEMA: dict[str, dict[str, tuple[str, Callable]]] = {
    "dataset": {"format": ("format", _choice("csv", "tsv")), "encoding": ("encoding", _string), "delimiter": ("delimiter", _string)},
    "columns": {"text": ("text", _text_columns), "id": ("id", _string), "label": ("label", _string), "split": ("split", _string), "joiner": ("joiner", lambda v, w: v if isinstance(v, str) else _fail(w, "is text"))},
    "cleaning": {"trim": ("trim", _flag), "empty": ("empty", _choice("error", "drop")), "labels": ("labels", _strings), "duplicates": ("duplicates", _choice("error", "drop", "keep")), "conflicts": ("conflicts", _choice("error", "majority")), "tie": ("tie", _choice("error", "drop"))},
    "split": {"enabled": ("split_enabled", _flag), "random_state": ("seed", _whole(0))},
    "sampling": {"per_class": ("per_class", _whole(1)), "per_split": ("per_split", _per_split)},
    "expect": {"rows": ("expected_rows", _whole(0)), "classes": ("expected_classes", _whole(0)), "splits": ("expected_splits", lambda v, w: percentages(v, w) if v else {})},
    "adapter": {"path": ("adapter", _string), "parameters": ("parameters", lambda v, w: dict(v) if isinstance(v, dict) else _fail(w, "is a table"))},
}


def parse_config(source: Mapping) -> TableConfig:
    """Unknown tables and keys are errors, as are settings that need a column which is not named."""
    values: dict[str, object] = {}
    for table in ("dataset", "columns"):
        if table not in source:
            _fail(table, "is missing")
    for table, content in source.items():
        if table not in _SCHEMA or not isinstance(content, dict):
            _fail(table, "is no known table")
        percent = {k: content[k] for k in SPLITS if table == "split" and k in content}
        for key, value in content.items():
            if key in percent:
                continue
            if key not in _SCHEMA[table]:
                _fail(table, f"has no key {key}")
            name, check = _SCHEMA[table][key]
            values[name] = check(value, f"{table}.{key}")
        if table == "split":
            values["shares"] = percentages({"train": 80, "validation": 0, "test": 20} | percent, "split")
    for table, key in (("dataset", "format"), ("columns", "text")):
        if key not in source[table]:
            _fail(table, f"needs {key}")
    values.setdefault("delimiter", "," if values["format"] == "csv" else "\t")
    if len(values["delimiter"]) != 1:
        _fail("dataset.delimiter", "is one character")
    config = TableConfig(**values)
    if (config.split_enabled or config.per_class is not None) and config.label is None:
        _fail("columns", "needs label for a split or a sample per class")
    if config.split_enabled and config.split is not None:
        _fail("columns.split", "does not go with a split that is made")
    if config.per_split is not None and not config.split_enabled and config.split is None:
        _fail("sampling.per_split", "needs splits")
    return config


def load_config(path: str) -> TableConfig:
    try:
        return parse_config(tomllib.loads(Path(path).read_text("utf-8")))
    except (OSError, tomllib.TOMLDecodeError) as e:
        raise InvalidInput(f"{path}: {e}") from e


def mapped(df: DataFrame, config: TableConfig) -> DataFrame:
    """(id, text, label, split) of a table; rows with an empty value are dropped or an error, as configured."""
    clean = strip if config.trim else (lambda c: c)
    column = lambda name: clean(F.coalesce(F.col(f"`{name}`"), F.lit("")))
    texts = [F.col(f"`{c}`") for c in config.text]
    whole = joined(texts, config.joiner) if config.trim else F.concat_ws(config.joiner, *[F.coalesce(c, F.lit("")) for c in texts])
    any_text = F.lit(False)
    for c in texts:
        any_text = any_text | (clean(F.coalesce(c, F.lit(""))) != "")  # untrimmed, blanks are a text
    label = labels_replaced(column(config.label), dict(config.labels)) if config.label and config.labels else column(config.label) if config.label else F.lit(None).cast("string")
    split = column(config.split) if config.split else F.lit(None).cast("string")
    rows = df.select(whole.alias("text"), label.alias("label"), split.alias("split"), (column(config.id) if config.id else F.lit(None).cast("string")).alias("id"), any_text.alias("_any"))
    if not config.id:
        rows = rows.withColumn("id", F.concat(F.lit("sha256:"), F.sha2("text", 256)))
    full = F.col("_any") & (F.col("id") != "")
    for name, used in (("label", config.label), ("split", config.split)):
        full = full & (F.col(name) != "") if used else full
    if config.empty == "error" and (bad := rows.where(~full).count()):
        raise InvalidInput(f"{bad} rows lack a value")
    return rows.where(full).select("id", "text", "label", "split")


def check_expectations(df: DataFrame, config: TableConfig) -> None:
    """Rows, classes, and sizes of splits by largest remainder over all rows."""
    found = df.agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("label").alias("classes")).first()
    if config.expected_rows is not None and found["rows"] != config.expected_rows:
        raise InvalidInput(f"expected {config.expected_rows} rows, there are {found['rows']}")
    if config.expected_classes is not None and found["classes"] != config.expected_classes:
        raise InvalidInput(f"expected {config.expected_classes} classes, there are {found['classes']}")
    if config.expected_splits:
        sizes = {r["split"]: r["count"] for r in df.groupBy("split").count().collect()}
        wanted = {k: v for k, v in allocate(found["rows"], config.expected_splits).items() if v}
        if sizes != wanted:
            raise InvalidInput(f"expected splits {wanted}, there are {sizes}")


def prepare(df: DataFrame, config: TableConfig) -> DataFrame:
    """The canonical corpus of a table: map, deduplicate, split, sample, validate, expect, in this order."""
    rows = deduplicate(mapped(df, config), config.duplicates, config.conflicts, config.tie)
    if config.split_enabled:
        rows = seeded_splits(rows, config.shares, config.seed).select("id", "text", "label", "split")
    rows = materialize(sample_per_group(rows, config.per_class, config.per_split), "prepared")
    check_expectations(require_valid(rows), config)
    return rows


def load_adapter(path: str) -> Callable:
    """The function that `module:object` names."""
    module, _, name = path.partition(":")
    try:
        found = getattr(importlib.import_module(module), name)
    except (ImportError, AttributeError, ValueError) as e:
        raise InvalidInput(f"no adapter {path}") from e
    return found if callable(found) else _fail("adapter.path", "names no function")


def prepare_file(spark: SparkSession, source: str, output: str, config: TableConfig, **parameters) -> dict:
    """Prepare a file by its configuration and write the corpus; returns the summary. An adapter takes (session,
    path, parameters) and gives (rows, metadata); its rows skip all steps up to validation."""
    if config.adapter:
        rows, metadata = load_adapter(config.adapter)(spark, source, dict(config.parameters) | parameters)
        rows = require_valid(rows.select("id", "text", "label", "split"))
        check_expectations(rows, config)
        read = metadata.get("input_rows")
    else:
        needed = [*config.text, *[c for c in (config.id, config.label, config.split) if c]]
        table = read_table(spark, source, needed, config.delimiter, config.encoding)
        rows, metadata, read = prepare(table, config), {}, table.count()
    write_canonical(rows, output)
    counts = {c: {r[c]: r["count"] for r in rows.where(F.col(c).isNotNull()).groupBy(c).count().orderBy(c).collect()} for c in ("label", "split")}
    kept = rows.count()
    return {"source": source, "output": output, "input_rows": kept if read is None else read, "rows": kept, "dropped_rows": (kept if read is None else read) - kept, "classes": counts["label"], "splits": counts["split"], "metadata": metadata}


def prepare_lenta(spark: SparkSession, path: str, parameters: Mapping[str, object]) -> tuple[DataFrame, dict]:
    """Adapter for news (url, title, text, topic): rows of listed topics with all fields, urls that stand once,
    equal articles once, the first of each topic by hash of the url, split 80 to 20."""
    return select_news(read_table(spark, path, ("url", "title", "text", "topic")), **dict(parameters))


def select_news(df: DataFrame, topics: tuple[str, ...] = ("Россия", "Мир", "Экономика", "Спорт"), per_topic: int = 250, valid_first: bool = False, seed: int = 42) -> tuple[DataFrame, dict]:
    from textquarry.operators.dedup import first_of_text, top_by_hash, unrepeated

    rows = df.select(*[strip(F.coalesce(F.col(c), F.lit(""))).alias(c) for c in ("url", "title", "text", "topic")])
    valid = F.col("topic").isin(*topics) & (F.col("title") != "") & (F.col("text") != "")
    unique = first_of_text(unrepeated(rows, "url", valid, valid_first), ["title", "text"], "url")
    chosen = top_by_hash(unique, ["topic"], "url", per_topic)
    corpus = chosen.select(F.col("url").alias("id"), F.concat_ws("\n", "title", "text").alias("text"), F.col("topic").alias("label"))
    read = df.count()
    corpus = materialize(seeded_splits(corpus, {"train": 0.8, "test": 0.2}, seed).select("id", "text", "label", "split"), "news")
    return corpus, {"input_rows": read, "dropped_rows": read - corpus.count()}
