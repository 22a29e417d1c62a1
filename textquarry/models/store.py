"""Model folders: tables as Parquet, a manifest with checksums, written once and checked when opened."""

from __future__ import annotations

import json
import os
import shutil
import tempfile
from dataclasses import asdict, dataclass, fields
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from textquarry.errors import InvalidInput, ModelExportError, ModelImportError
from textquarry.functions.lexicon import STOP_WORDS
from textquarry.functions.normalize import PROFILE
from textquarry.models import cnn, lda, lsa, naive_bayes, word2vec
from textquarry.sources.sinks import checksum, write_json

VERSION = 1


def stop_word_hash() -> str:
    import hashlib

    return hashlib.sha256("\n".join(STOP_WORDS).encode()).hexdigest()


def _files(folder: Path) -> dict[str, str]:
    return {str(p.relative_to(folder)): checksum(p) for p in sorted(folder.rglob("*")) if p.is_file() and p.name != "manifest.json" and not p.name.startswith((".", "_"))}


def save(model, folder: str, details: dict | None = None, documents: DataFrame | None = None) -> dict:
    """Write a model, and its documents if given, into a new folder; an existing one stays and is an error."""
    target = Path(folder)
    if target.exists():
        raise ModelExportError(f"{folder} exists")
    work = Path(tempfile.mkdtemp(dir=target.parent, prefix=f".{target.name}-"))
    try:
        kind, tables, arrays, values = _parts(model)
        for name, df in (tables | ({"documents": documents} if documents is not None else {})).items():
            df.write.parquet(f"file://{work}/{name}")
        if arrays:
            np.savez(work / "arrays.npz", **arrays)
        manifest = {"version": VERSION, "kind": kind, "profile": PROFILE, "stop_words": stop_word_hash(), "values": values, "details": details or {}, "sha256": _files(work)}
        write_json(manifest, str(work / "manifest.json"))
        os.replace(work, target)
    except OSError as e:
        raise ModelExportError(f"{folder}: {e}") from e
    finally:
        shutil.rmtree(work, ignore_errors=True)
    return manifest


def _parts(model) -> tuple[str, dict[str, DataFrame], dict[str, np.ndarray], dict]:
    if isinstance(model, lsa.Lsa):
        return "lsa", {"vocabulary": model.vocabulary}, {"projection": model.projection, "singular_values": model.singular_values}, {"unit": model.unit}
    if isinstance(model, lda.Lda):
        return "lda", {}, {"center": model.center, "scalings": model.scalings}, {"classes": list(model.classes)}
    if isinstance(model, word2vec.WordVectors):
        return "word2vec", {"vectors": model.vectors}, {}, {"dimensions": model.dimensions}
    if isinstance(model, naive_bayes.NaiveBayes):
        return "naive_bayes", {"terms": model.terms}, {}, {"classes": list(model.classes), "priors": list(model.priors)}
    if isinstance(model, cnn.Cnn):
        return "cnn", {}, model.weights, {"parameters": asdict(model.parameters), "words": model.words, "history": model.history}
    raise InvalidInput(f"no kind of model: {type(model).__name__}")


def read_manifest(folder: str) -> dict:
    try:
        manifest = json.loads((Path(folder) / "manifest.json").read_text("utf-8"))
    except (OSError, ValueError) as e:
        raise ModelImportError(f"{folder} has no readable manifest") from e
    if not isinstance(manifest, dict) or manifest.get("version") != VERSION:
        raise ModelImportError(f"{folder} has another version")
    return manifest


def load(spark: SparkSession, folder: str, kind: str | None = None):
    """The model of a folder, if its files, normalization profile and stop words are those it was written with."""
    manifest = read_manifest(folder)
    if kind and manifest.get("kind") != kind:
        raise ModelImportError(f"{folder} holds {manifest.get('kind')}, not {kind}")
    if manifest.get("profile") != PROFILE or manifest.get("stop_words") != stop_word_hash():
        raise ModelImportError(f"{folder} was made with another normalization")
    if manifest.get("sha256") != _files(Path(folder)):
        raise ModelImportError(f"{folder} is damaged")
    values, root = manifest["values"], f"file://{Path(folder).resolve()}"
    try:
        arrays = dict(np.load(Path(folder) / "arrays.npz")) if (Path(folder) / "arrays.npz").exists() else {}
        if any(not np.isfinite(x).all() for x in arrays.values()):
            raise ModelImportError(f"{folder} holds numbers that are not finite")
        match manifest["kind"]:
            case "lsa":
                vocabulary = spark.read.parquet(f"{root}/vocabulary")
                if vocabulary.count() != arrays["projection"].shape[0] or arrays["projection"].shape[1] != len(arrays["singular_values"]):
                    raise ModelImportError(f"{folder}: vocabulary and projection differ in size")
                return lsa.Lsa(vocabulary, arrays["projection"], arrays["singular_values"], values["unit"])
            case "lda":
                return lda.Lda(tuple(values["classes"]), arrays["center"], arrays["scalings"])
            case "word2vec":
                return word2vec.WordVectors(spark.read.parquet(f"{root}/vectors"), values["dimensions"])
            case "naive_bayes":
                if len(values["classes"]) != len(values["priors"]):
                    raise ModelImportError(f"{folder}: classes and priors differ in number")
                return naive_bayes.NaiveBayes(tuple(values["classes"]), tuple(values["priors"]), spark.read.parquet(f"{root}/terms"))
            case "cnn":
                known = {f.name for f in fields(cnn.CnnParameters)}
                parameters = cnn.CnnParameters(**{"sampling": "symmetric"} | {k: v for k, v in values["parameters"].items() if k in known})
                shapes = {k: x.shape for k, x in cnn.initial_weights(parameters, len(values["words"])).items()}
                if {k: x.shape for k, x in arrays.items()} != shapes:
                    raise ModelImportError(f"{folder}: weights do not fit the parameters")
                return cnn.Cnn(parameters, values["words"], arrays, values["history"])
    except (KeyError, TypeError, ValueError) as e:
        raise ModelImportError(f"{folder}: {e}") from e
    raise ModelImportError(f"{folder} holds an unknown kind")


@dataclass(frozen=True)
class Backend:
    """What a search needs of an algorithm."""

    name: str
    fit: object
    transform: object


BACKENDS = {b.name: b for b in (Backend("lsa", lsa.fit, lsa.transform), Backend("word2vec", word2vec.fit, word2vec.transform), Backend("cnn", cnn.fit, cnn.transform))}


def backend(name: str) -> Backend:
    if name not in BACKENDS:
        raise InvalidInput(f"the algorithm is one of {', '.join(sorted(BACKENDS))}")
    return BACKENDS[name]
