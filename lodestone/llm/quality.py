"""Quality by a generalised additive model with pairwise interactions.

Cyclic boosting fits shallow trees on one binned feature after the other, again and again with a
small step, so each feature ends as a lookup table from bin to log-odds; then the pairs of
features that explain most of what is left get small two-way tables. Scoring is one table
lookup for each feature and pair, added up for a whole batch at a time.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import by_batch, fold, labelled_sample, texts

FEATURES = ("log_words", "word_length", "upper", "symbols", "digits", "non_ascii", "spaces", "sentence_ends", "distinct_words", "distinct_pairs", "top_word", "line_length", "repeated_lines", "long_words", "single_letters", "edge_symbols", "capital_starts", "vowels")

_CLASSES = np.zeros(256, dtype=np.uint8)
for _chars, _class in ((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", 1), (b"0123456789", 2), (b" \t\n\r\x0b\x0c", 3), (b".?", 4), (b",;:'\"()-", 5), (b"aeiou", 7)):
    _CLASSES[list(_chars)] = _class
_CLASSES[[c for c in range(33, 127) if not chr(c).isalnum() and _CLASSES[c] == 0]] = 6
_CLASSES[128:] = 8
_EDGE = re.compile(r"[^\w\s.,;:?'\"()\-]\S*(?:\s|$)")


def features(text: str) -> list[float]:
    """The numbers of one text, in the order of FEATURES; zeros for a text without words."""
    words = text.split()
    if not words:
        return [0.0] * len(FEATURES)
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)
    kinds = np.bincount(_CLASSES[raw], minlength=9) / len(raw)
    n = len(words)
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=n)
    codes: dict[str, int] = {}
    ids = np.fromiter((codes.setdefault(w, len(codes)) for w in words), dtype=np.int64, count=n)
    top = np.bincount(ids).max() / n
    pairs = len(np.unique(ids[:-1] * len(codes) + ids[1:])) / (n - 1) if n > 1 else 1.0
    lines = [s for s in text.split("\n") if s.strip()]
    starts = sum(1 for w in words if w[0].isupper()) / n
    return [
        float(np.log(n)), float(lengths.mean()), kinds[1], kinds[6], kinds[2], kinds[8], kinds[3], kinds[4], len(codes) / n, pairs, top,
        float(np.log(n / len(lines))), 1 - len(set(lines)) / len(lines), float((lengths > 15).mean()), float((lengths == 1).mean()), len(_EDGE.findall(text)) / n, starts, kinds[7],
    ]


def matrix(docs: list[str]) -> np.ndarray:
    return np.array([features(t) for t in docs], dtype=np.float64).reshape(len(docs), len(FEATURES))


@dataclass
class AdditiveModel:
    """Bin edges and lookup tables of log-odds."""

    intercept: float
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)

    def score(self, x: np.ndarray) -> np.ndarray:
        logit = np.full(len(x), self.intercept)
        for j, (edges, values) in enumerate(zip(self.edges, self.tables, strict=True)):
            logit += values[np.searchsorted(edges, x[:, j], side="right")]
        for i, j, ei, ej, values in self.pairs:
            logit += values[np.searchsorted(ei, x[:, i], side="right"), np.searchsorted(ej, x[:, j], side="right")]
        return 1 / (1 + np.exp(-np.clip(logit, -500, 500)))


def _edges(x: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1]))


def _step(g: np.ndarray, h: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    return g / (h + ridge)


def _tree(g: np.ndarray, h: np.ndarray, depth: int) -> np.ndarray:
    """A shallow tree over ordered bins with gradient sums g and curvature sums h."""
    if depth and len(g) > 1:
        gl, hl = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
        gr, hr = g.sum() - gl, h.sum() - hl
        gain = gl**2 / (hl + 1) + gr**2 / (hr + 1) - g.sum() ** 2 / (h.sum() + 1)
        cut = int(gain.argmax())
        if gain[cut] > 1e-9:
            return np.concatenate([_tree(g[: cut + 1], h[: cut + 1], depth - 1), _tree(g[cut + 1 :], h[cut + 1 :], depth - 1)])
    return np.full(len(g), _step(g.sum(), h.sum()))


def _square(g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, float]:
    """The best tree of one cut in each direction over a table of bins, and its gain."""
    cg, ch = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    tg, th = cg[-1, -1], ch[-1, -1]
    a, b = cg[:-1, :-1], ch[:-1, :-1]
    parts = [(a, b), (cg[:-1, -1:] - a, ch[:-1, -1:] - b), (cg[-1:, :-1] - a, ch[-1:, :-1] - b)]
    parts.append((tg - sum(p for p, _ in parts), th - sum(q for _, q in parts)))
    gain = sum(p**2 / (q + 1) for p, q in parts) - tg**2 / (th + 1)
    i, j = np.unravel_index(int(gain.argmax()), gain.shape)
    out = np.empty_like(g)
    for k, (rows, cols) in enumerate(((slice(None, i + 1), slice(None, j + 1)), (slice(None, i + 1), slice(j + 1, None)), (slice(i + 1, None), slice(None, j + 1)), (slice(i + 1, None), slice(j + 1, None)))):
        out[rows, cols] = _step(parts[k][0][i, j], parts[k][1][i, j])
    return out, float(gain[i, j])


def train(x: np.ndarray, y: np.ndarray, rounds: int = 120, rate: float = 0.15, bins: int = 48, depth: int = 2, pair_bins: int = 8, pairs: int = 6, pair_rounds: int = 40) -> AdditiveModel:
    """Fit the model; one class gives its constant, no rows a score of 0.5 for every document."""
    if len(set(y.tolist())) < 2:
        return AdditiveModel(0.0 if not len(y) else 30.0 if y[0] else -30.0)
    model = AdditiveModel(float(np.log(y.mean() / (1 - y.mean()))))
    model.edges = [_edges(x[:, j], bins) for j in range(x.shape[1])]
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    at = [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(model.edges)]
    logit = np.full(len(y), model.intercept)
    for _ in range(rounds):
        for j, where in enumerate(at):
            p = 1 / (1 + np.exp(-logit))
            n = len(model.tables[j])
            step = rate * _tree(np.bincount(where, y - p, n), np.bincount(where, p * (1 - p), n), depth)
            model.tables[j] += step
            logit += step[where]
    coarse = [_edges(x[:, j], pair_bins) for j in range(x.shape[1])]
    cells = [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(coarse)]

    def grid(i: int, j: int) -> tuple[np.ndarray, np.ndarray]:
        p, shape = 1 / (1 + np.exp(-logit)), (len(coarse[i]) + 1, len(coarse[j]) + 1)
        flat = cells[i] * shape[1] + cells[j]
        return np.bincount(flat, y - p, shape[0] * shape[1]).reshape(shape), np.bincount(flat, p * (1 - p), shape[0] * shape[1]).reshape(shape)

    usable = [j for j, e in enumerate(coarse) if len(e)]
    gains = sorted(((_square(*grid(i, j))[1], i, j) for k, i in enumerate(usable) for j in usable[k + 1 :]), reverse=True)[:pairs]
    chosen = [(i, j, np.zeros((len(coarse[i]) + 1, len(coarse[j]) + 1))) for _, i, j in gains]
    for _ in range(pair_rounds):
        for i, j, values in chosen:
            step = rate * _square(*grid(i, j))[0]
            values += step
            logit += step[cells[i], cells[j]]
    model.pairs = [(i, j, coarse[i], coarse[j], values) for i, j, values in chosen]
    return model


def fit(docs: DataFrame, labels: DataFrame, folds: int = 3, held: int = 1, max_train: int = 20_000) -> AdditiveModel:
    """Train on the features of at most ``max_train`` labelled documents outside the held-out fold, one text an id."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(list(matrix(texts(batch))), pa.list_(pa.float64()))], names=["doc_id", "y", "x"])

    sample = labelled_sample(docs, labels, "quality", fold("doc_id", folds) != held, max_train).select("doc_id", "text", "y")
    kind = dict(docs.dtypes)["doc_id"]
    got = sample.mapInArrow(by_batch(run), f"doc_id {kind}, y int, x array<double>").toPandas().sort_values("doc_id")
    return train(np.array(got["x"].tolist(), dtype=np.float64).reshape(len(got), len(FEATURES)), got["y"].to_numpy(dtype=np.float64))


def score_quality(docs: DataFrame, model: AdditiveModel, folds: int = 3, held: int = 1) -> DataFrame:
    """doc_id, held_out, score, predicted of every whole text.

    Null texts count as empty; a text without words has all features 0 and gets what the model says
    of that. Each row is scored by itself; a null id counts as the empty text in the fold; other
    columns are ignored; an empty table gives an empty result.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        score = model.score(matrix(texts(batch)))
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    kind = dict(docs.dtypes)["doc_id"]
    rows = docs.select("doc_id", "text", (fold("doc_id", folds) == held).alias("held_out"))
    return rows.mapInArrow(by_batch(run), f"doc_id {kind}, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, model: AdditiveModel) -> DataFrame:
    """The rows of ``docs``, with all their columns, that score at least 0.5."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return batch.filter(pa.array(model.score(matrix(texts(batch))) >= 0.5))

    return docs.mapInArrow(by_batch(run), docs.schema)
