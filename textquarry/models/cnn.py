"""A convolutional text encoder trained without labels on pairs of fragments of one document.

Embedding, one convolution of odd width with tanh, maximum over known positions, and a linear layer. Training
is a loop on the driver over a bounded number of documents; encoding a corpus runs in the tasks.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import asdict, dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textquarry.errors import InvalidInput, ModelTrainingError
from textquarry.functions.java_random import JavaRandom
from textquarry.operators.splits import validation_groups
from textquarry.operators.terms import collection_frequencies, top_terms

PAD, UNKNOWN = 0, 1
SHORTEST, SHORT = 4, 16  # fixed values: tokens of the short fragment of a pair
SPAN_TRIES, PAIR_TRIES = 16, 32  # fixed values: draws before the fallback


@dataclass(frozen=True)
class CnnParameters:
    dimensions: int = 100
    filters: int = 64
    width: int = 3
    max_length: int = 128
    max_features: int = 20_000
    min_count: int = 2
    epochs: int = 9
    batch: int = 16
    learning_rate: float = 0.001
    temperature: float = 0.1
    validation: float = 0.0
    sampling: str = "symmetric"
    seed: int = 42

    def __post_init__(self):
        positive = ("dimensions", "filters", "width", "max_length", "max_features", "min_count", "epochs")
        if any(getattr(self, n) < 1 for n in positive) or self.batch < 2 or self.width % 2 == 0:
            raise InvalidInput("sizes are positive, a batch has two documents, and the width is odd")
        if self.sampling not in ("symmetric", "short_long") or not 0 <= self.validation < 1 or self.learning_rate <= 0 or self.temperature <= 0:
            raise InvalidInput("sampling is symmetric or short_long, validation a share, rates are positive")
        if (self.max_features + 2) * self.dimensions > 5_000_000 or 2 * self.batch * self.max_length * max(self.dimensions * self.width, self.filters) > 20_000_000:
            raise InvalidInput("weights or activations are too large; lower max_features, dimensions or batch")


@dataclass
class Cnn:
    parameters: CnnParameters
    words: list[str]  # ids from 2, most frequent first
    weights: dict[str, np.ndarray]
    history: list[dict] = field(default_factory=list)

    def ids(self, tokens: Sequence[str]) -> np.ndarray:
        table = self.__dict__.setdefault("_table", {w: i for i, w in enumerate(self.words, 2)})
        return np.array([table.get(t, UNKNOWN) for t in tokens[: self.parameters.max_length]], np.int64)

    def windows(self, tokens: Sequence[str]) -> list[np.ndarray]:
        """The ids of all tokens, max_length at a time."""
        return [self.ids(tokens[at : at + self.parameters.max_length]) for at in range(0, len(tokens), self.parameters.max_length)]


def known(ids) -> int:
    return int((np.asarray(ids) >= 2).sum())


def fragment(ids: Sequence[int], least: int, most: int, random: JavaRandom) -> Sequence[int]:
    """A stretch of random length and place with a known token, else the longest from the first known token on."""
    for _ in range(SPAN_TRIES):
        length = least + random.below(most - least + 1)
        start = random.below(len(ids) - length + 1)
        if known(ids[start : start + length]):
            return ids[start : start + length]
    start = min(next(i for i, x in enumerate(ids) if x >= 2), len(ids) - most)
    return ids[start : start + most]


def fragments(ids: Sequence[int], max_length: int, random: JavaRandom, sampling: str = "symmetric") -> tuple:
    most = min(max_length, len(ids))
    first = (min(SHORTEST, most), min(SHORT, most)) if sampling == "short_long" else (max(1, most // 2), most)
    return fragment(ids, *first, random), fragment(ids, max(1, most // 2), most, random)


def usable_documents(documents: Sequence[Sequence[int]]) -> list[tuple[int, ...]]:
    """Distinct id sequences with a known token, in order."""
    rows = list(dict.fromkeys(tuple(d) for d in documents if known(d)))
    if len(rows) < 2:
        raise ModelTrainingError("two different documents with known tokens are needed")
    return rows


def batches(documents: Sequence[Sequence[int]], max_length: int, size: int, random: JavaRandom, sampling: str = "symmetric") -> list[tuple[list, list[int]]]:
    """One epoch: (fragments, their documents), partners side by side; no fragment stands in a batch twice but as
    its own partner; a last batch of one document is left out."""
    order = list(range(len(documents)))
    random.shuffle(order)
    done, rows, sources, seen = [], [], [], set()
    for document in order:
        for _ in range(PAIR_TRIES):
            pair = [tuple(x) for x in fragments(documents[document], max_length, random, sampling)]
            if seen.isdisjoint(pair):
                rows += pair
                sources += [document, document]
                seen.update(pair)
                break
        if len(rows) == 2 * size:
            done.append((rows, sources))
            rows, sources, seen = [], [], set()
    if len(rows) >= 4:
        done.append((rows, sources))
    if not done:
        raise ModelTrainingError("no batch of two different pairs can be made")
    return done


def contrastive_loss(vectors: np.ndarray, partners: np.ndarray, temperature: float) -> tuple[float, np.ndarray]:
    """Mean of -log softmax of each row's partner among all other rows by cosine, and its gradient."""
    length = np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)
    unit = vectors / length
    scores = unit @ unit.T / temperature
    np.fill_diagonal(scores, -np.inf)
    top = scores.max(axis=1, keepdims=True)
    exp = np.exp(scores - top)
    total = exp.sum(axis=1, keepdims=True)
    rows = np.arange(len(vectors))
    loss = float((np.log(total[:, 0]) + top[:, 0] - scores[rows, partners]).mean())
    grad = exp / total
    grad[rows, partners] -= 1
    grad /= len(vectors) * temperature
    by_unit = (grad + grad.T) @ unit
    return loss, (by_unit - unit * (by_unit * unit).sum(axis=1, keepdims=True)) / length


def initial_weights(p: CnnParameters, vocabulary: int) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(p.seed)

    def xavier(rows: int, columns: int) -> np.ndarray:
        return (rng.standard_normal((rows, columns)) * np.sqrt(2 / (rows + columns))).astype(np.float64)

    return {
        "embedding": xavier(vocabulary + 2, p.dimensions), "kernel": xavier(p.width * p.dimensions, p.filters), "kernel_bias": np.zeros(p.filters),
        "output": xavier(p.filters, p.dimensions), "output_bias": np.zeros(p.dimensions),
    }


def padded(rows: Sequence[Sequence[int]]) -> tuple[np.ndarray, np.ndarray]:
    length = max(len(r) for r in rows)
    ids = np.zeros((len(rows), length), np.int64)
    for i, r in enumerate(rows):
        ids[i, : len(r)] = r
    return ids, np.arange(length)[None, :] < np.array([len(r) for r in rows])[:, None]


def forward(w: dict[str, np.ndarray], ids: np.ndarray, mask: np.ndarray, width: int) -> tuple[np.ndarray, dict]:
    """Vectors of padded rows; padding changes nothing, as it is zero for the convolution and left out of the maximum."""
    embedded = w["embedding"][ids] * mask[:, :, None]
    half = width // 2
    wide = np.pad(embedded, ((0, 0), (half, half), (0, 0)))
    windows = np.concatenate([wide[:, i : i + ids.shape[1]] for i in range(width)], axis=2)
    active = np.tanh(windows @ w["kernel"] + w["kernel_bias"])
    best = np.where(mask[:, :, None], active, -np.inf).argmax(axis=1)
    pooled = np.take_along_axis(active, best[:, None, :], axis=1)[:, 0]
    return pooled @ w["output"] + w["output_bias"], {"windows": windows, "best": best, "pooled": pooled, "ids": ids, "mask": mask}


def backward(w: dict[str, np.ndarray], kept: dict, grad: np.ndarray, width: int) -> dict[str, np.ndarray]:
    """Gradients of all weights for the gradient of the vectors."""
    out = {"output": kept["pooled"].T @ grad, "output_bias": grad.sum(axis=0)}
    pooled = (grad @ w["output"].T) * (1 - kept["pooled"] ** 2)
    rows, filters = pooled.shape
    at = np.zeros((rows, kept["ids"].shape[1], filters))
    np.put_along_axis(at, kept["best"][:, None, :], pooled[:, None, :], axis=1)
    flat = at.reshape(-1, filters)
    out["kernel"] = kept["windows"].reshape(len(flat), -1).T @ flat
    out["kernel_bias"] = flat.sum(axis=0)
    by_window = (flat @ w["kernel"].T).reshape(rows, -1, width, w["embedding"].shape[1])
    half, length = width // 2, kept["ids"].shape[1]
    by_place = np.zeros((rows, length + 2 * half, by_window.shape[3]))
    for i in range(width):
        by_place[:, i : i + length] += by_window[:, :, i]
    by_place = by_place[:, half : half + length] * kept["mask"][:, :, None]
    out["embedding"] = np.zeros_like(w["embedding"])
    np.add.at(out["embedding"], kept["ids"].ravel(), by_place.reshape(-1, by_place.shape[2]))
    return out


def _epoch(w, p, documents, random, update=None) -> float:
    total, rows = 0.0, 0
    for fragments_, _ in batches(documents, p.max_length, p.batch, random, p.sampling):
        ids, mask = padded(fragments_)
        vectors, kept = forward(w, ids, mask, p.width)
        loss, grad = contrastive_loss(vectors, np.arange(len(ids)) ^ 1, p.temperature)
        if not np.isfinite(loss):
            raise ModelTrainingError("the loss is not finite")
        if update:
            update(backward(w, kept, grad, p.width))
        total, rows = total + loss * len(ids), rows + len(ids)
    return total / rows


def train(words: list[str], documents: Sequence[Sequence[int]], p: CnnParameters) -> Cnn:
    """Weights stay those of the last epoch; history has each epoch's losses, and which was best on validation."""
    training, held = list(documents), []
    if p.validation:
        a, b = validation_groups([list(d) for d in documents], p.validation, p.seed)
        training, held = [documents[i] for i in a], usable_documents([documents[i] for i in b])
    training = usable_documents(training)
    w, step = initial_weights(p, len(words)), 0
    moments = {k: (np.zeros_like(x), np.zeros_like(x)) for k, x in w.items()}

    def update(gradients: dict[str, np.ndarray]) -> None:
        nonlocal step
        step += 1
        for k, g in gradients.items():
            g = np.clip(g, -5, 5)
            m, v = moments[k]
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            w[k] -= p.learning_rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)

    random, history = JavaRandom(p.seed), []
    for epoch in range(1, p.epochs + 1):
        row = {"epoch": epoch, "loss": _epoch(w, p, training, random, update)}
        if held:
            row["validation_loss"] = _epoch(w, p, held, JavaRandom(p.seed))
        history.append(row)
    return Cnn(p, words, w, history)


def fit(docs: DataFrame, parameters: CnnParameters | None = None, tokens: str = "tokens", documents: int = 10_000, order: str | None = None) -> Cnn:
    """The vocabulary is counted over all rows; training sees at most `documents` of them, in order of a column or
    of a hash of their tokens."""
    p = parameters or CnnParameters()
    words = [r["term"] for r in top_terms(collection_frequencies(docs, tokens, p.min_count), p.max_features).orderBy("rank").select("term").collect()]
    if not words:
        raise ModelTrainingError("no term is frequent enough")
    model = Cnn(p, words, {})
    drawn = docs.orderBy(F.col(order) if order else F.xxhash64(tokens)).limit(documents).select(F.slice(tokens, 1, 50 * p.max_length)).collect()
    table = {t: i for i, t in enumerate(words, 2)}
    return train(words, [[table.get(t, UNKNOWN) for t in r[0]] for r in drawn], model.parameters)


def best_epoch(model: Cnn) -> int | None:
    rated = [r for r in model.history if "validation_loss" in r]
    return min(rated, key=lambda r: (r["validation_loss"], r["epoch"]))["epoch"] if rated else None


def transform(model: Cnn, docs: DataFrame, doc_id: str = "doc_id", tokens: str = "tokens", whole: bool = False) -> DataFrame:
    """(doc_id, vec, known_tokens) of the first max_length tokens, or of the whole text, unit length; zeros where none
    of them is known. A whole text is the mean of its windows of max_length tokens, weighted by their known ones."""
    kind = dict(docs.dtypes)[doc_id]
    state = (asdict(model.parameters), model.words, {k: x.astype(np.float32) for k, x in model.weights.items()})
    held = docs.sparkSession.sparkContext.broadcast(state)

    def encode(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, words, weights = held.value
        model = Cnn(CnnParameters(**p), words, weights)
        for all_rows in found:
            for batch in (all_rows.slice(at, 256) for at in range(0, all_rows.num_rows, 256)):
                texts = [model.windows(t or []) if whole else [model.ids(t or [])] for t in batch.column(1).to_pylist()]
                some = [(i, x, known(x)) for i, windows in enumerate(texts) for x in windows if known(x)]
                counts, vectors = np.zeros(len(texts), np.int64), np.zeros((len(texts), p["dimensions"]))
                for at in range(0, len(some), 256):
                    owners, rows, weight = zip(*some[at : at + 256], strict=True)
                    v = _unit(forward(weights, *padded(rows), p["width"])[0].astype(np.float64))
                    np.add.at(vectors, list(owners), v * np.array(weight)[:, None])
                    np.add.at(counts, list(owners), weight)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(_unit(vectors)), pa.list_(pa.float64())), pa.array(counts, pa.int32())], ["doc_id", "vec", "known_tokens"])

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(tokens).alias("tokens")).mapInArrow(encode, f"doc_id {kind}, vec array<double>, known_tokens int")


def _unit(v: np.ndarray) -> np.ndarray:
    length = np.linalg.norm(v, axis=1, keepdims=True)
    return np.where(length > 1e-12, v / np.maximum(length, 1e-300), 0)
