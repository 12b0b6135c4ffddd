import re
from collections import Counter

import corpus_pipeline
from lodestone.llm import mixing, quality, toxicity

from ..conftest import SMALL
from .test_documents import packed_is_right
from .test_pairs import brute
from .test_plain import plain_quality, plain_toxicity


def test_stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    (_, clean), (_, good), (_, single), (_, mixed), (_, packed) = corpus_pipeline.STAGES

    kept = clean(spark, docs, SMALL).cache()
    scores = toxicity.score_toxicity(docs, toxicity.fit(docs, labels)).where("predicted = 0")
    assert kept.columns == docs.columns and sorted(r[0] for r in kept.select("doc_id").collect()) == sorted(r[0] for r in scores.select("doc_id").collect())

    better = good(spark, kept, SMALL).cache()
    scores = quality.score_quality(kept, quality.fit(kept, labels)).where("predicted = 1")
    assert sorted(r[0] for r in better.select("doc_id").collect()) == sorted(r[0] for r in scores.select("doc_id").collect())

    alone = single(spark, better, SMALL).cache()
    rows = [(r["doc_id"], r["text"]) for r in better.collect()]
    _, component = brute(rows, 5, 80)
    assert alone.count() == len({component[k] for k in range(len(rows))}) and alone.columns == docs.columns

    mix = mixed(spark, alone, SMALL).cache()
    plan = {r["doc_id"]: r["copies"] for r in mixing.plan_mix(alone).collect()}
    have = {r["doc_id"]: r["count"] for r in mix.groupBy("doc_id").count().collect()}
    assert have == {d: n for d, n in plan.items() if n}

    pieces = packed(spark, mix, SMALL)
    assert pieces.where("piece = 0").count() == mix.count()


def as_rows(df):
    return Counter(map(str, df.collect()))


def test_odd_tables(spark, odd, none, tmp_path):
    """Each stage's rows, with all their columns, are those that brute force keeps of its own input."""
    df, _ = odd
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(30)], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    labels = spark.read.parquet(f"{tmp_path}/labels.parquet")

    def judged(name, docs):
        """The rows that stay, as (row, times)."""
        rows = docs.collect()
        if name == "toxicity":
            model = toxicity.fit(docs, labels)
            return Counter(str(r) for r in rows if plain_toxicity(model, r["text"]) < 0.5)
        if name == "quality":
            model = quality.fit(docs, labels)
            return Counter(str(r) for r in rows if plain_quality(model, quality.features(r["text"] or "")) >= 0.5)
        copies = Counter()
        for r in mixing.plan_mix(docs).distinct().collect():
            copies[r["doc_id"], r["source"], r["size"]] = r["copies"]
        out = Counter()
        for r in rows:
            if n := copies[r["doc_id"], r["source"], len(re.findall(mixing.WORD, r["text"] or ""))]:
                out[str(r)] += n
        return out

    docs = df
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path)).cache()
        if name == "pack":
            packed_is_right(out.collect(), [(r["doc_id"], r["text"]) for r in docs.collect()])
            break
        assert out.columns == docs.columns
        if name == "near_copies":
            rows = docs.collect()
            usable = [r for r in rows if r["doc_id"] is not None and (r["text"] or "").split()]
            _, component = brute([(r["doc_id"], r["text"]) for r in usable], 5, 80)
            got, groups = as_rows(out), {}
            for k, r in enumerate(usable):
                groups.setdefault(component[k], []).append(r)
            for members in groups.values():
                least = {str(r) for r in members if r["doc_id"] == min(m["doc_id"] for m in members)}
                assert sum(got[x] for x in {str(r) for r in members}) == 1 == sum(got[x] for x in least)
            assert sum(got.values()) == len(groups) + len(rows) - len(usable)
            # what follows also sees documents without words, ids and sources
            docs = df
        else:
            assert as_rows(out) == judged(name, docs)
            docs = df if name == "quality" else out
    docs = none
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.count() == 0
