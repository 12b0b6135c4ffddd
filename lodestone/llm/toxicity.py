"""Toxicity by averaged subword embeddings and a linear softmax, trained in numpy.

A word's vector is the mean of the embeddings of its character n-grams and of the word itself,
all hashed into one table of fixed size, so a misspelling never seen still shares most of its
n-gram vectors with the word it hides. A window of words is the mean of its words' vectors,
classified by a linear softmax; embeddings and softmax are trained jointly. A document scores as
its most toxic window; a document of one window scores as a whole.
"""

from __future__ import annotations

from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import by_batch, drop_materialized, fold, labelled_sample, materialize, texts, within_bytes

EDGES = ".,;:!?\"'()[]{}<>|#%&*-_=+/\\~^$@`"
SHORTEST, LONGEST = 3, 5
#: Words that a Python worker remembers at most.
MEMORY = 400_000
_PLACES = np.random.default_rng(11).integers(0, 1 << 63, LONGEST + 1, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _slots(h: np.ndarray, salt: int, buckets: int) -> np.ndarray:
    h = h + np.uint64(salt * int(_PLACES[LONGEST]) % (1 << 64))
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return ((h >> np.uint64(32)) % np.uint64(buckets)).astype(np.int32)


def subword_rows(tokens: list[str], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the embedding table for many tokens at once: all rows, and how many each token has.

    A token, lower-cased and without marks at its edges, stands between < and >; its rows are the
    hashes of the whole and of its character n-grams.
    """
    if not tokens:
        return np.zeros(0, dtype=np.int32), np.zeros(0, dtype=np.int64)
    marked = [f"<{(t.strip(EDGES) or t).lower()}>" for t in tokens]
    codes = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    lengths = np.fromiter(map(len, marked), dtype=np.int64, count=len(marked))
    ends = np.cumsum(lengths)
    token = np.repeat(np.arange(len(marked)), lengths)
    left = ends[token] - np.arange(len(codes))  # characters from here to the token's end
    whole = np.fromiter((crc32(m.encode("utf-8", "surrogatepass")) for m in marked), dtype=np.uint64, count=len(marked))
    rows, owner = [_slots(whole, 0, buckets)], [np.arange(len(marked))]
    for n in range(SHORTEST, LONGEST + 1):
        at = np.flatnonzero((left >= n) & (lengths[token] > n))
        h = np.zeros(len(at), dtype=np.uint64)
        for k in range(n):
            h += codes[at + k] * _PLACES[k]
        rows.append(_slots(h, n, buckets))
        owner.append(token[at])
    owner_of = np.concatenate(owner)
    order = np.argsort(owner_of, kind="stable")
    return np.concatenate(rows)[order], np.bincount(owner_of, minlength=len(marked))


#: What this worker knows of the model it used last: its key and the logits of words.
_KNOWN: dict[str, dict[str, float]] = {}


@dataclass
class SubwordModel:
    """What scoring needs: for each row the softmax's difference of the two classes' logits.

    Rows that training did not keep are NaN and count for nothing.
    """

    row_logit: np.ndarray
    bias: float
    scale: float
    blank: int = 32
    window: int = 128

    def __post_init__(self) -> None:
        self.key = f"{crc32(self.row_logit.tobytes())}:{self.bias}:{self.scale}"

    def known(self, tokens: set[str]) -> dict[str, float]:
        """Logits of these tokens and of others met before."""
        if self.key not in _KNOWN:
            _KNOWN.clear()
            _KNOWN[self.key] = {}
        known = _KNOWN[self.key]
        if len(known) + len(tokens) > MEMORY:
            known.clear()
        fresh = [t for t in tokens if t not in known]
        for at in range(0, len(fresh), 20_000):
            some = fresh[at : at + 20_000]
            rows, sizes = subword_rows(some, len(self.row_logit))
            values = self.row_logit[rows]
            kept = ~np.isnan(values)
            first = np.cumsum(sizes) - sizes
            total = np.add.reduceat(np.where(kept, values, 0).astype(np.float64), first)
            known.update(zip(some, (total / np.maximum(np.add.reduceat(kept.astype(np.int64), first), 1)).tolist(), strict=True))
        return known

    def scores(self, docs: list[str]) -> np.ndarray:
        split = [t.split() for t in docs]
        known = self.known(set().union(*split)) if split else {}
        logits = np.full(len(docs), self.bias)
        for i, tokens in enumerate(split):
            if tokens:
                values = np.fromiter(map(known.__getitem__, tokens), dtype=np.float64, count=len(tokens))
                at, length = windows(len(tokens), self.window)
                sums = np.concatenate([[0.0], np.cumsum(values)])
                logits[i] += self.scale * (sums[at + length] - sums[at]).max() / (length + self.blank)
        return 1 / (1 + np.exp(-np.clip(logits, -500, 500)))


def windows(n: int, window: int) -> tuple[np.ndarray, int]:
    """Starts and length of the half-overlapping windows that cover n words."""
    if n <= window:
        return np.zeros(1, dtype=np.int64), n
    return np.append(np.arange(0, n - window, window // 2), n - window), window


def train(docs: list[str], y: np.ndarray, dim: int = 8, buckets: int = 1 << 17, steps: int = 900, batch: int = 128, rate: float = 0.3, scale: float = 60.0, min_docs: int = 6, blank: int = 32, window: int = 128, whole_epochs: int = 3, shrink: float = 1e-4, seed: int = 7) -> SubwordModel:
    """Fit embeddings and softmax together by Adagrad; one class or no rows give its constant.

    ``scale`` multiplies the mean before the softmax, as a temperature. Only rows met in at least
    ``min_docs`` training documents are kept: rarer ones could only learn single documents by heart.
    After ``whole_epochs`` a long document is represented by its most toxic window of ``window``
    words, as in scoring, so a few insults in a long text are not averaged away. ``blank`` zero
    vectors join every mean, so a few words alone decide little; ``shrink`` pulls rows of no use to 0.
    Training takes about ``steps`` batches, however many documents there are.
    """
    if len(set(y.tolist())) < 2:
        return SubwordModel(np.zeros(1, dtype=np.float32), 30.0 if len(y) and y[0] else -30.0, scale)
    rng = np.random.default_rng(seed)
    index: dict[str, int] = {}
    per_doc = []
    for text in docs:
        per_doc.append(np.array([index.setdefault(token, len(index)) for token in text.split()], dtype=np.int32))
    # tokens are taken in slices, as the n-grams of all at once would not fit the driver
    words = list(index)
    index.clear()
    slices = [subword_rows(words[at : at + 10_000], buckets) for at in range(0, len(words), 10_000)]
    del words
    flat = np.concatenate([np.zeros(0, dtype=np.int32), *(rows for rows, _ in slices)])
    sizes = np.concatenate([np.zeros(0, dtype=np.int64), *(n for _, n in slices)])
    del slices
    starts = np.concatenate([[0], np.cumsum(sizes)])
    met = np.zeros(buckets, dtype=np.int32)
    for ids in per_doc:
        if len(ids):
            met[np.unique(_gather(flat, starts, sizes, np.unique(ids)))] += 1
    # kept rows are renumbered; one spare row, always zero, stands for a token without any
    kept = np.flatnonzero(met >= min_docs)
    number = np.full(buckets, len(kept), dtype=np.int32)
    number[kept] = np.arange(len(kept))
    parts, known = [np.zeros(0, dtype=np.int32)], np.ones(len(sizes), dtype=np.int64)
    for at in range(0, len(sizes), 10_000):
        some = slice(at, min(at + 10_000, len(sizes)))
        rows = number[flat[starts[at] : starts[some.stop]]]
        hit = rows < len(kept)
        here = np.add.reduceat(hit.astype(np.int64), starts[some] - starts[at])
        # a token without any row keeps its first one, which is the spare row
        hit[(starts[some] - starts[at])[here == 0]] = True
        parts.append(rows[hit])
        known[some] = np.maximum(here, 1)
    flat, sizes = np.concatenate(parts), known
    starts = np.concatenate([[0], np.cumsum(sizes)])
    del parts
    used = len(kept) + 1
    E = rng.uniform(-0.5 / dim, 0.5 / dim, (used, dim)).astype(np.float32)
    E[-1] = 0
    W = rng.normal(0, 0.5, (dim, 2)).astype(np.float32)
    b = np.log(np.array([np.mean(y == 0), np.mean(y == 1)])).astype(np.float32)
    gE, gW, gb = np.full((used, 1), 1e-6, np.float32), np.full_like(W, 1e-3), np.full_like(b, 1e-3)
    keep = np.array([i for i, ids in enumerate(per_doc) if len(ids)])
    parts = list(per_doc)
    weight = np.where(y == 1, max(1.0, 0.5 * np.mean(y == 0) / np.mean(y == 1)), 1.0).astype(np.float32)
    rounds = max(1, len(keep) // batch)
    step, last = 0, np.zeros(used, dtype=np.int64)

    def catch_up(hit: np.ndarray) -> None:
        """Shrink rows for the steps in which they were not met; ``step`` will do its own."""
        E[hit] = _shrunk(E[hit], (step - 1 - last[hit])[:, None] * (shrink * rate) / np.sqrt(gE[hit]))
        last[hit] = step

    for epoch in range(-(-steps // rounds)):
        if epoch >= whole_epochs:
            step += 1
            catch_up(np.arange(used))
            step, last[:] = step - 1, step - 1
            value = np.add.reduceat((E @ (W[:, 1] - W[:, 0]))[flat], starts[:-1]) / sizes
            parts = [_best(ids, value, window) for ids in per_doc]
        for at in np.array_split(rng.permutation(keep), rounds):
            tokens, inverse = np.unique(np.concatenate([parts[i] for i in at]), return_inverse=True)
            lengths = np.array([len(parts[i]) for i in at])
            doc_of = np.repeat(np.arange(len(at)), lengths)
            counts = (1 / (lengths + blank)).astype(np.float32)[doc_of]
            n = sizes[tokens]
            first = np.concatenate([[0], np.cumsum(n)[:-1]])
            rows = _gather(flat, starts, sizes, tokens)
            # only rows of this batch change; what the others' norms shrink by adds up until they are met
            hit, step = np.flatnonzero(np.bincount(rows, minlength=used)), step + 1
            catch_up(hit)
            V = np.add.reduceat(E[rows], first, axis=0) / n[:, None]
            D = np.stack([np.bincount(doc_of, counts * V[inverse, k], len(at)) for k in range(dim)], 1)
            z = scale * D @ W + b
            z -= z.max(1, keepdims=True)
            p = np.exp(z)
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(at)), y[at]] -= 1
            p *= (weight[at] / weight[at].sum())[:, None]
            dW, db, dD = scale * D.T @ p, p.sum(0), scale * p @ W.T
            gW += dW**2
            gb += db**2
            dV = np.stack([np.bincount(inverse, counts * dD[doc_of, k], len(tokens)) for k in range(dim)]) / n
            dE = np.stack([np.bincount(rows, np.repeat(d, n), used)[hit] for d in dV], 1).astype(np.float32)
            gE[hit] += (dE**2).mean(1, keepdims=True)
            size = np.sqrt(gE[hit])
            E[hit] = _shrunk(E[hit] - rate * dE / size, shrink * rate / size)
            E[-1] = 0
            W -= (rate * dW / np.sqrt(gW)).astype(np.float32)
            b -= (3 * rate * db / np.sqrt(gb)).astype(np.float32)
    step += 1
    catch_up(np.arange(used))
    row_logit = np.full(buckets, np.nan, dtype=np.float32)
    row_logit[kept] = E[:-1] @ (W[:, 1] - W[:, 0])
    return SubwordModel(row_logit, float(b[1] - b[0]), scale, blank, window)


def _shrunk(rows: np.ndarray, by: np.ndarray) -> np.ndarray:
    """Rows whose norm is smaller by so much, down to 0."""
    norm = np.sqrt((rows**2).sum(1, keepdims=True)) + 1e-12
    return (rows * np.maximum(0, 1 - by / norm)).astype(np.float32)


def _gather(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray, which: np.ndarray) -> np.ndarray:
    """The rows of some tokens, one token after the other."""
    n = sizes[which]
    ends = np.cumsum(n)
    return flat[np.repeat(starts[which] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)]


def _best(ids: np.ndarray, value: np.ndarray, window: int) -> np.ndarray:
    """The window of a document in which the model sees most toxicity."""
    if len(ids) <= window:
        return ids
    at, length = windows(len(ids), window)
    sums = np.concatenate([[0.0], np.cumsum(value[ids])])
    best = at[int((sums[at + length] - sums[at]).argmax())]
    return ids[best : best + length]


def fit(docs: DataFrame, labels: DataFrame, folds: int = 5, held: int = 0, max_train: int = 6000, max_bytes: int = 1 << 26) -> SubwordModel:
    """Train on at most ``max_train`` labelled documents outside the held-out fold, of ``max_bytes`` together, one text an id."""
    sample = materialize(labelled_sample(docs, labels, "toxic", fold("doc_id", folds) != held, max_train), "toxicity-sample")
    rows = within_bytes(sample, max_bytes).toPandas().sort_values("doc_id")
    drop_materialized(sample)
    return train([t or "" for t in rows["text"]], rows["y"].to_numpy(dtype=np.int64))


def score_toxicity(docs: DataFrame, model: SubwordModel, folds: int = 5, held: int = 0) -> DataFrame:
    """doc_id, held_out, score, predicted of every whole text.

    Null and empty texts get the score of a document without words, the learned bias. Each row is
    scored by itself, so repeated rows agree; a null id counts as the empty text in the fold; other
    columns are ignored; an empty table gives an empty result.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        score = model.scores(texts(batch))
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    kind = dict(docs.dtypes)["doc_id"]
    rows = docs.select("doc_id", "text", (fold("doc_id", folds) == held).alias("held_out"))
    return rows.mapInArrow(by_batch(run), f"doc_id {kind}, held_out boolean, score double, predicted int")


def keep_clean(docs: DataFrame, model: SubwordModel) -> DataFrame:
    """The rows of ``docs``, with all their columns, that score below 0.5."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return batch.filter(pa.array(model.scores(texts(batch)) < 0.5))

    return docs.mapInArrow(by_batch(run), docs.schema)
