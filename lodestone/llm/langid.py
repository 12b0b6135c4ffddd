"""Language identification by rank-order profiles.

A language's profile ranks its most frequent character n-grams (1 to 3 characters, words padded
by a space). A document's own ranking is compared with each profile: every n-gram adds how far
out of place it is, or the profile's length if the language does not list it. The nearest
language wins.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import by_batch, drop_materialized, fold, materialize, texts

LONGEST = 3
#: An n-gram is known by its code points, 21 bits each, the first one highest and none as 0: the order of the
#: numbers is the order of the n-grams by code point.
_BITS = 21


@lru_cache(1)
def _letters() -> np.ndarray:
    """Which code points are letters."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)


def count(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The different n-grams of a text's words, each between two blanks, in order, and how often each occurs."""
    codes = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    letter = _letters()[codes]
    # a run of anything else is one blank
    kept = letter.copy()
    kept[0] = True
    kept[1:] |= letter[:-1]
    codes, letter = np.where(letter, codes, 32)[kept].astype(np.int64), letter[kept]
    # code points as ranks among those of the text, from 1, so that three of them fit a short table
    used = np.flatnonzero(np.bincount(codes))
    rank = np.zeros(used[-1] + 1, dtype=np.int64)
    rank[used] = np.arange(1, len(used) + 1)
    rank, base = rank[codes], len(used) + 1
    grams = []
    for n in range(1, min(LONGEST, len(codes)) + 1):
        span = len(codes) - n + 1
        # blanks only at the ends, and a letter somewhere
        good = letter[:span] | letter[n - 1 :] if n < 3 else np.logical_and.reduce([letter[k : span + k] for k in range(1, n - 1)])
        gram = np.zeros(span, dtype=np.int64)
        for k in range(LONGEST):
            gram = gram * base + (rank[k : span + k] if k < n else 0)
        grams.append(gram[good])
    flat = np.concatenate(grams)
    if base**LONGEST <= max(1 << 12, 4 * len(flat)):
        table = np.bincount(flat, minlength=1)
        short = np.flatnonzero(table)
        times = table[short]
    else:
        short, times = np.unique(flat, return_counts=True)
    points = np.concatenate([[0], used])
    whole = np.zeros(len(short), dtype=np.int64)
    for k in range(LONGEST):
        whole = (whole << _BITS) | points[short // base ** (LONGEST - 1 - k) % base]
    return whole, times


def summed(counts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Counts of several texts as those of one."""
    grams, where = np.unique(np.concatenate([g for g, _ in counts]), return_inverse=True)
    return grams, np.bincount(where, np.concatenate([n for _, n in counts]), len(grams)).astype(np.int64)


def ranking(grams: np.ndarray, counts: np.ndarray, length: int) -> np.ndarray:
    """The ``length`` most frequent n-grams in order; ties by code point."""
    return grams[np.argsort(-counts, kind="stable")[:length]]


@dataclass
class Profiles:
    """Languages in code-point order, their profiles and the profile length."""

    langs: list[str]
    ranked: list[np.ndarray]
    length: int

    def __post_init__(self) -> None:
        self.listed = np.unique(np.concatenate(self.ranked)) if self.ranked else np.zeros(0, dtype=np.int64)
        # one place more than is listed stands for all other n-grams
        self.place = np.full((len(self.langs), len(self.listed) + 1), -1, dtype=np.int64)
        for k, r in enumerate(self.ranked):
            self.place[k, np.searchsorted(self.listed, r)] = np.arange(len(r))

    def __getstate__(self) -> dict:
        return {"langs": self.langs, "ranked": self.ranked, "length": self.length}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self.__post_init__()

    def predict(self, text: str) -> tuple[str, float]:
        """The language and 1 - distance / largest distance; ``und`` and 0 without letters or profiles."""
        mine = ranking(*count(text), self.length) if self.langs else ()
        if not len(mine):
            return "und", 0.0
        at = np.searchsorted(self.listed, mine)
        at[self.listed[np.minimum(at, len(self.listed) - 1)] != mine] = len(self.listed)
        at = self.place[:, at]
        far = np.where(at < 0, self.length, np.abs(at - np.arange(len(mine)))).sum(1)
        best = int(far.argmin())
        return self.langs[best], float(max(0.0, 1 - far[best] / (self.length * len(mine))))


def fit(docs: DataFrame, folds: int = 3, held: int = 1, per_lang: int = 300, length: int = 300) -> Profiles:
    """Profiles from about ``per_lang`` documents of each language outside the held-out fold.

    The documents are those whose ids hash below a cut, all of a language that has no more. Rows
    without id or language are left out; a null text adds nothing.
    """
    rows = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & (fold("doc_id", folds) != held))
    # a language's cut keeps the share of all hashes that leaves about per_lang ids: one row a language,
    # from counts alone, and written, so that Spark broadcasts it only if its file is small
    share = F.least(F.lit(float(per_lang)) / F.col("n"), F.lit(1.0))
    cut = F.when(F.col("n") <= per_lang, F.lit((1 << 63) - 1)).otherwise((F.lit(-float(1 << 63)) + share * float(1 << 64)).cast("long"))
    cuts = materialize(rows.groupBy(F.col("lang").alias("cut_lang")).agg(F.count("*").alias("n")).select("cut_lang", cut.alias("cut")), "language-cuts")
    kept = rows.join(cuts, F.col("lang") == F.col("cut_lang")).where(F.xxhash64("doc_id") <= F.col("cut"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        found: dict[str, list] = {}
        for text, lang in zip(texts(batch), batch.column(1).to_pylist(), strict=True):
            if len((counted := count(text))[0]):
                found.setdefault(lang, []).append(counted)
        out = [(lang, *summed(counts)) for lang, counts in found.items()]
        if not out:
            return None
        columns = [np.repeat([lang for lang, _, _ in out], [len(g) for _, g, _ in out]), np.concatenate([g for _, g, _ in out]), np.concatenate([n for _, _, n in out])]
        return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), *map(pa.array, columns[1:])], names=["lang", "gram", "n"])

    counted = kept.select("text", "lang").mapInArrow(by_batch(run), "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    first = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    ranked = counted.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= length).toPandas().sort_values(["lang", "rank"])
    drop_materialized(cuts)
    langs = sorted(ranked["lang"].unique().tolist())
    return Profiles(langs, [ranked.loc[ranked["lang"] == x, "gram"].to_numpy(dtype=np.int64) for x in langs], length)


def identify(docs: DataFrame, profiles: Profiles, folds: int = 3, held: int = 1) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every whole text.

    Null, empty and letterless texts are ``und`` with score 0. Equal distances go to the language
    first by code point. Each row is judged by itself; a null id counts as the empty text in the
    fold; other columns are ignored; an empty table gives an empty result.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        got = [profiles.predict(t) for t in texts(batch)]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    kind = dict(docs.dtypes)["doc_id"]
    rows = docs.select("doc_id", "text", (fold("doc_id", folds) == held).alias("held_out"))
    return rows.mapInArrow(by_batch(run), f"doc_id {kind}, held_out boolean, lang_pred string, score double")
