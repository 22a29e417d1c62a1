"""Sinks: canonical CSV, JSON protocols, evaluation collections. Nothing is overwritten unless asked for."""

from __future__ import annotations

import glob
import hashlib
import json
import os
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textquarry.errors import InvalidInput, ModelExportError
from textquarry.sources.readers import require_valid

WRITE_OPTIONS = {"header": True, "quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False, "emptyValue": "", "lineSep": "\n"}


def _single_file(df: DataFrame, target: Path, fmt: str, **options) -> None:
    """Write df, in its order, to one file that appears whole or not at all. For exchange files of a size that one
    machine holds; larger corpora are written by df.write with WRITE_OPTIONS."""
    folder = tempfile.mkdtemp(dir=target.parent, prefix=f".{target.name}-")
    try:
        df.coalesce(1).write.mode("overwrite").format(fmt).options(**options).save(f"file://{folder}/out")
        os.replace(glob.glob(f"{folder}/out/part-*")[0], target)
    finally:
        shutil.rmtree(folder, ignore_errors=True)


def write_canonical(df: DataFrame, path: str) -> None:
    """A validated corpus with no more columns than it needs, sorted by id."""
    require_valid(df)
    used = df.agg(F.count("label").alias("label"), F.count("split").alias("split")).first()
    columns = ["id", "text", *[c for c in ("label", "split") if used[c]]]
    _single_file(df.select(*columns).orderBy("id"), Path(path), "csv", **WRITE_OPTIONS)


def write_json(value: object, path: str) -> None:
    """Keys sorted, indented by two, in place at once."""
    target = Path(path)
    with tempfile.NamedTemporaryFile("w", encoding="utf-8", dir=target.parent, delete=False) as f:
        json.dump(value, f, ensure_ascii=False, indent=2, sort_keys=True)
        f.write("\n")
    os.replace(f.name, target)


def render(result: dict, style: str = "text") -> str:
    """`key: value` lines, or compact or indented JSON."""
    if style == "text":
        return "\n".join(f"{k}: {v}" for k, v in result.items())
    if style not in ("json", "pretty-json"):
        raise InvalidInput("a result is rendered as text, json or pretty-json")
    return json.dumps(result, ensure_ascii=False, **({"indent": 2} if style == "pretty-json" else {"separators": (",", ":")}))


def checksum(path: str | Path) -> str:
    digest = hashlib.sha256()
    with open(path, "rb") as f:
        while block := f.read(1 << 20):
            digest.update(block)
    return digest.hexdigest()


def write_collection(documents: DataFrame, queries: DataFrame, qrels: DataFrame, folder: str, manifest: dict) -> dict:
    """corpus.csv, queries.jsonl, qrels.jsonl and manifest.json in a new folder; the manifest gets the checksums."""
    target = Path(folder)
    if target.exists():
        raise ModelExportError(f"{folder} exists")
    work = Path(tempfile.mkdtemp(dir=target.parent, prefix=f".{target.name}-"))
    try:
        _single_file(documents.orderBy("seq").select("id", "title", "text"), work / "corpus.csv", "csv", **WRITE_OPTIONS)
        _single_file(queries.orderBy("seq").select(F.to_json(F.struct(F.col("query_id").alias("_id"), "text"))), work / "queries.jsonl", "text")
        judged = qrels.orderBy("query_id", "doc_id").select(F.to_json(F.struct(F.col("query_id").alias("query-id"), F.col("doc_id").alias("corpus-id"), "score")))
        _single_file(judged, work / "qrels.jsonl", "text")
        full = manifest | {"sha256": {name: checksum(work / name) for name in ("corpus.csv", "queries.jsonl", "qrels.jsonl")}}
        write_json(full, str(work / "manifest.json"))
        os.replace(work, target)
    finally:
        shutil.rmtree(work, ignore_errors=True)
    return full
