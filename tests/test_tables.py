"""Commits of many writers, deletes by key, and compaction."""

import threading
import time

import pytest
from pyspark.sql import functions as F

from lodestone.operators import tables as S
from lodestone.plans.keyword import KeywordIndex


def rows(spark, pairs):
    return spark.createDataFrame(pairs, "id string, v int")


def test_concurrent_upserts(spark, tmp_path):
    """Eight writers in two sessions, each with a store of its own, five rounds of five rows: nothing is lost."""
    folder, errors = f"file://{tmp_path}/s", []
    sessions = [spark, spark.newSession()]

    def writer(number, round_):
        try:
            barrier.wait()
            session = sessions[number % 2]
            store = S.TableStore(session, folder)
            store.upsert("t", rows(session, [(f"{round_}-{number}-{k}", k) for k in range(4)] + [("shared", number)]), ["id"])
        except Exception as e:  # noqa: BLE001
            errors.append(e)

    for round_ in range(5):
        barrier = threading.Barrier(8)
        threads = [threading.Thread(target=writer, args=(n, round_)) for n in range(8)]
        for t in threads:
            t.start()
        for t in threads:
            t.join()
    store = S.TableStore(spark, folder)
    got = {r["id"]: r["v"] for r in store.read("t").collect()}
    assert not errors and store.state()["number"] == 40
    assert store.read("t").count() == len(got) == 8 * 5 * 4 + 1 and all(f"{r}-{n}-{k}" in got for r in range(5) for n in range(8) for k in range(4))
    assert store.compact("t") == 39 and store.compact("t") == 0
    assert {r["id"]: r["v"] for r in store.read("t").collect()} == got


def test_read_modify_write(spark, tmp_path):
    """Writers that read what they replace run again on a conflict; without that, they are told of it."""
    store = S.TableStore(spark, f"file://{tmp_path}")
    store.write("n", rows(spark, [("sum", 0)]))

    def add():
        S.TableStore(spark, f"file://{tmp_path}").update(lambda tx: tx.replace("n", tx.read("n").withColumn("v", F.col("v") + 1)), tries=50)

    threads = [threading.Thread(target=add) for _ in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert store.read("n").first()["v"] == 4

    tx = store.begin()
    tx.replace("n", tx.read("n").withColumn("v", F.lit(9)))
    store.append("n", rows(spark, [("other", 1)]))
    with pytest.raises(S.Conflict):
        tx.commit()
    assert sorted(map(tuple, store.read("n").collect())) == [("other", 1), ("sum", 4)]
    # what a commit neither reads nor replaces may change
    tx = store.begin()
    tx.append("m", tx.read("n"))
    tx.delete("n", spark.createDataFrame([("sum",)], "id string"))
    store.append("x", rows(spark, [("x", 1)]))
    tx.commit()
    assert store.read("m").count() == 2 and [r["id"] for r in store.read("n").collect()] == ["other"]
    # a taken number is never overwritten
    assert not store.publish({"number": 1, "tables": {}}) and store.exists("x")


def test_failed_change_leaves_nothing(spark, tmp_path):
    store = S.TableStore(spark, f"file://{tmp_path}")
    store.write("t", rows(spark, [("a", 1)]))

    def change(tx):
        tx.append("t", rows(spark, [("b", 2)]))
        tx.replace("u", spark.range(1).select(F.raise_error(F.lit("no")).cast("string").alias("id")))

    with pytest.raises(Exception):
        store.update(change)
    assert store.read("t").count() == 1 and not store.exists("u") and len([p for p in (tmp_path / "t").iterdir() if p.is_dir()]) == 1


def test_deletes(spark, tmp_path):
    """Keys delete what was there before them, in all their columns, null with null; later rows stay."""
    store = S.TableStore(spark, f"file://{tmp_path}")
    store.write("t", spark.createDataFrame([(i, i % 3 if i else None, f"p{i % 2}") for i in range(12)], "a int, b int, p string").coalesce(1), ["p"])
    store.delete("t", spark.createDataFrame([(1,), (99,), (1,)], "a int"))
    store.delete("t", spark.createDataFrame([(0, None), (2, 0), (4, 1)], "a int, b int"))
    store.append("t", spark.createDataFrame([(1, 1, "p1")], "a int, b int, p string"), ["p"])
    store.delete("t", spark.createDataFrame([], "a int"))
    want = [1, 2, 3, 5, 6, 7, 8, 9, 10, 11]
    assert sorted(r["a"] for r in store.read("t").collect()) == want
    assert sorted(r["a"] for r in store.read("t", "a int, b int, p string").where("p = 'p1'").collect()) == [1, 3, 5, 7, 9, 11]
    before = store.state()
    assert store.compact("t") == 2 and not store.state()["tables"]["t"]["gone"]
    assert sorted(r["a"] for r in store.read("t").collect()) == want and sorted(r["a"] for r in store.rows_of(before, "t").collect()) == want
    store.vacuum(["t"], keep_seconds=-5)
    assert sorted(r["a"] for r in store.read("t").collect()) == want and len(store._numbers()) == 1
    with pytest.raises(FileNotFoundError):
        store.read("none")


def test_deletes_write_little(spark, tmp_path):
    """Deleting a thousandth of the rows writes under a hundredth of the bytes, and compaction rewrites only the files they are in."""
    store = S.TableStore(spark, f"file://{tmp_path}")
    store.write("t", spark.range(0, 400_000, 1, 8).select("id", F.sha2(F.col("id").cast("string"), 256).alias("v")))
    store.delete("t", spark.range(1000, 1400))
    whole, gone = store.bytes_of("t")
    assert gone < 0.01 * whole and store.read("t").count() == 399_600
    assert store.compact("t") == 1 and store.read("t").count() == 399_600 and store.read("t").where("id = 1200").isEmpty()


def test_compaction_with_writers(spark, tmp_path):
    """What is added and deleted while a compaction runs stands after it."""
    store = S.TableStore(spark, f"file://{tmp_path}")
    store.write("t", rows(spark, [(str(k), k) for k in range(10)]))
    store.delete("t", spark.createDataFrame([("1",)], "id string"))

    def arrange(found):
        store.append("t", rows(spark, [("1", 100)]))
        store.delete("t", spark.createDataFrame([("2",)], "id string"))
        return found

    assert store.compact("t", arrange) == 1
    assert sorted((r["id"], r["v"]) for r in store.read("t").collect()) == sorted([("1", 100), *((str(k), k) for k in (0, *range(3, 10)))])

    store.delete("t", spark.createDataFrame([("3",)], "id string"))

    def replaced(found):
        store.write("t", rows(spark, [("new", 1)]))
        return found

    with pytest.raises(S.Conflict):
        store.compact("t", replaced)
    assert [r["id"] for r in store.read("t").collect()] == ["new"]


def test_vacuum_spares_commits_under_way(spark, tmp_path):
    store = S.TableStore(spark, f"file://{tmp_path}")
    store.write("t", rows(spark, [("a", 1)]))
    tx = store.begin()
    tx.append("t", rows(spark, [("b", 2)]))
    time.sleep(0.1)
    store.vacuum(["t"])
    tx.commit()
    assert store.read("t").count() == 2


def test_index_of_two_writers(spark, tmp_path):
    """Two writers add overlapping documents to one index; each document is there once, and a removed one is not."""
    folder = f"file://{tmp_path}"
    doc = lambda *ids: spark.createDataFrame([(str(i), f"red fox number {i}") for i in ids], "id string, text string")
    KeywordIndex(spark, folder, "words", 3).build(doc(0))
    threads = [threading.Thread(target=lambda ids=ids: KeywordIndex(spark, folder, "words").add(doc(*ids))) for ids in ((1, 2, 3), (3, 4), (4, 5, 1))]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    index = KeywordIndex(spark, folder, "words")
    assert sorted(r["id"] for r in index.find("fox", 99, phrase=False).collect()) == ["0", "1", "2", "3", "4", "5"] and index.stats().first()["n"] == 6
    before = [tuple(r) for r in KeywordIndex(spark, f"{folder}/other", "words", 3).build(doc(0, 1, 2, 4, 5)).find("red fox", 99).collect()]
    index.remove(doc(3, 77))
    assert [tuple(r) for r in index.find("red fox", 99).collect()] == before and index.count() == 5
    assert index.compact() and [tuple(r) for r in index.find("red fox", 99).collect()] == before
