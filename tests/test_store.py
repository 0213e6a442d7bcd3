"""The keyed store: first insert wins, whatever comes again, together or after a restart."""

import os
import random
import threading

import pytest
from pyspark.sql import functions as F

from fidelis.sources.store import Conflict, KeyedStore

SCHEMA = "hash string, uid string, ts long, text string"


@pytest.fixture
def store(spark, tmp_path):
    return KeyedStore(spark, str(tmp_path / "s"), ["hash"], "uid", ["ts"], buckets=4)


def rows(store):
    df = store.read()
    return sorted(tuple(r) for r in df.select("hash", "uid", "ts", "text").collect()) if df is not None else []


def test_first_wins(spark, store):
    assert store.read() is None and store.of_owner("u") is None and store.owners() is None
    df = lambda data: spark.createDataFrame(data, SCHEMA)
    assert store.insert(df([("a", "u1", 5, "late"), ("a", "u2", 3, "early"), ("b", "u1", 1, None), (None, "u1", 0, "x"), ("c", None, 2, "no owner")]), "s", 0) == {"version": 0, "added": 3, "repeated": False}
    assert rows(store) == [("a", "u2", 3, "early"), ("b", "u1", 1, None), ("c", None, 2, "no owner")]
    assert store.insert(df([("a", "u9", 0, "earlier but later"), ("d", "u1", 0, "new")]), "s", 1)["added"] == 1
    assert store.insert(df([("e", "u1", 0, "again")]), "s", 1) == {"version": 1, "added": 0, "repeated": True}
    assert store.insert(df([("e", "u1", 9, "other source")]), "t", 0)["added"] == 1
    assert store.insert(df([("e", "u1", 9, "nothing new")]), "t", 1)["added"] == 0
    assert store.insert(df([]), "t", 2)["added"] == 0
    assert [r["hash"] for r in store.of_owner("u1").collect()] == ["d", "b", "e"]
    assert {r["uid"] for r in store.owners().collect()} == {"u1", "u2", None}
    plan = store.of_owner("u1")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "bucket" in plan
    before = rows(store)
    store.compact()
    assert rows(store) == before and len(store.state()["folders"]) == 1 and store.state()["batches"] == {"s": 1, "t": 2}
    assert len(store.vacuum()) == 3 and rows(store) == before
    assert store.insert(df([("a", "u9", 0, "still")]), "s", 1)["repeated"] and store.insert(df([("a", "u9", 0, "still")]), "s", 2)["added"] == 0


def test_versions_are_made_once(store):
    store._save(0, {"add": [], "batches": {}})
    with pytest.raises(Conflict):
        store._save(0, {"add": [], "batches": {}})
    assert [n for n in os.listdir(f"{store.path}/commits") if not n.startswith(".")] == ["000000000000.json"]


def test_writers_at_once(spark, store):
    rng = random.Random(2)
    batches = [[(f"h{rng.randint(0, 40)}", f"u{w}", rng.randint(0, 9), f"{w}") for _ in range(60)] for w in range(4)]
    done = []

    def write(w):
        own = KeyedStore(spark, store.path, ["hash"], "uid", ["ts"], buckets=4)
        done.append(own.insert(spark.createDataFrame(batches[w], SCHEMA), f"w{w}", 0))

    threads = [threading.Thread(target=write, args=(w,)) for w in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    got = rows(store)
    assert sorted(d["version"] for d in done) == [0, 1, 2, 3]
    assert len(got) == len({r[0] for r in got}) == len({h for b in batches for h, *_ in b}) == sum(d["added"] for d in done)
    assert len(store.vacuum()) == 0 or rows(store) == got


def test_stream_restarts(spark, store, tmp_path):
    src, check = tmp_path / "in", tmp_path / "check"
    src.mkdir()

    def run():
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(src))
        q = stream.writeStream.foreachBatch(store.sink("stream")).option("checkpointLocation", str(check)).trigger(availableNow=True).start()
        q.awaitTermination()

    put = lambda n, data: spark.createDataFrame(data, SCHEMA).coalesce(1).write.mode("append").parquet(str(src))
    put(0, [("a", "u", 1, "first"), ("b", "u", 2, "x")])
    run()
    put(1, [("a", "v", 0, "second"), ("c", "u", 3, "y")])
    run()
    want = rows(store)
    assert [r[0] for r in want] == ["a", "b", "c"] and want[0][3] == "first"
    version = store.state()["version"]
    # the driver died after storing the last batch, before the stream noted it
    last = max((n for n in os.listdir(check / "commits") if n.isdigit()), key=int)
    for n in (last, f".{last}.crc"):
        if (check / "commits" / n).exists():
            (check / "commits" / n).unlink()
    run()
    assert rows(store) == want and store.state()["version"] == version
    put(2, [("d", "u", 4, "z")])
    run()
    assert [r[0] for r in rows(store)] == ["a", "b", "c", "d"]


def test_a_writer_that_died(spark, store):
    """Data without a commit is not read."""
    store.insert(spark.createDataFrame([("a", "u", 1, "x")], SCHEMA), "s", 0)
    lost = store._write(spark.createDataFrame([("b", "u", 1, "y")], SCHEMA))
    assert [r[0] for r in rows(store)] == ["a"] and store.vacuum() == [lost]
    assert store.insert(spark.createDataFrame([("b", "u", 1, "y")], SCHEMA), "s", 1)["added"] == 1
    assert rows(store)[1] == ("b", "u", 1, "y") and store.read().filter(F.col("hash") == "b").count() == 1
