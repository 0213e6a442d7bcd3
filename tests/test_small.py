"""Readers, writers and column functions that no query calls."""

import json
import random
import statistics

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from fidelis.functions import scalars as sc
from fidelis.functions import text as tx
from fidelis.operators import features
from fidelis.sources import readers, sinks


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


def test_parquet_shards(spark, tmp_path):
    for i in range(3):
        spark.range(i * 10, i * 10 + 10).select("id", (F.col("id") * 2).alias("b"), F.lit("x").alias("c")).coalesce(1).write.parquet(str(tmp_path / f"d/part{i}"))
    df = readers.parquet_shards(spark, str(tmp_path / "d"), ["b"], 3)
    assert df.columns == ["b"] and sorted(r[0] for r in df.collect()) == [2 * i for i in range(30)]
    with pytest.raises(ValueError, match="3 shards, 14 expected"):
        readers.parquet_shards(spark, str(tmp_path / "d"), ["b"], 14)


def test_contexts_and_samples(spark, tmp_path):
    turns = [{"role": "user", "content": "a"}, {"role": "assistant", "content": "b"}]
    path = tmp_path / "c.jsonl"
    path.write_text("\n".join(json.dumps({f"c{i}": turns[: i + 1]}) for i in range(2)))
    got = {r["context_id"]: [t["content"] for t in r["turns"]] for r in readers.contexts(spark, str(path)).collect()}
    assert got == {"c0": ["a"], "c1": ["a", "b"]}
    path.write_text(json.dumps({"a": turns, "b": turns}))
    with pytest.raises(PySparkException, match="exactly one key"):
        readers.contexts(spark, str(path)).collect()
    rows = [{"key": "r", "arm": "A3", "k": k, "text": f"t{k}", "generated_tokens": 1, "terminal": False} for k in (2, 0, 1)]
    path.write_text("\n".join(map(json.dumps, rows)))
    assert readers.samples(spark, str(path), 3).first()["texts"] == ["t0", "t1", "t2"]
    with pytest.raises(PySparkException, match="incomplete"):
        readers.samples(spark, str(path), 8).collect()


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([(2, "b", True), (1, "a,c", False)], "k int, s string, f boolean")
    sinks.report_csv(df, str(tmp_path / "r"), ["k"])
    (part,) = (tmp_path / "r").glob("part-*.csv")
    assert part.read_text() == 'k,s,f\n1,"a,c",false\n2,b,true\n'
    with pytest.raises(PySparkException):
        sinks.report_csv(df, str(tmp_path / "r"), ["k"])
    sinks.if_absent(df, str(tmp_path / "p"))
    sinks.if_absent(df.limit(0), str(tmp_path / "p"))
    assert spark.read.parquet(str(tmp_path / "p")).count() == 2
    counted, seen = sinks.observed_counts(df, "counts", flagged=F.col("f"))
    counted.collect()
    assert seen.get == {"rows": 2, "flagged": 1}


def test_keys_and_prompts(spark):
    assert one(spark, tx.day_of(F.lit("2024-05-06T07:08:09Z"))) == "2024-05-06"
    stamps = ["2024-05-06T09:08:09+02:00", "2024-05-06T07:08:09.5Z", "2024-05-06T07:08:09Z", "yesterday"]
    keys = [one(spark, tx.ts_key(F.lit(s))) for s in stamps]
    assert keys[0] == keys[2] == "2024-05-06T07:08:09.000000" and keys[1] > keys[0] and keys[3] == "yesterday"
    assert one(spark, tx.format_options(F.lit('[{"letter": "A", "option": "x y"}, {"letter": "B", "option": "z"}]'))) == "(A) x y\n(B) z"
    turns = F.from_json(F.lit(json.dumps([{"role": "user", "content": "abcdef"}, {"role": "assistant", "content": "0123456789"}, {"role": None, "content": None}])), "array<struct<role:string,content:string>>")
    assert [len(one(spark, tx.context_prefix(turns, F.lit(n)))) for n in (0, 2, 9)] == [0, 2, 3]
    assert one(spark, tx.conversation_so_far(turns, 2, 3, 4)) == '[assistant]\n"""\n…6789\n"""\n[user]\n"""\n\n"""'
    dist = F.create_map(*[x for k, v in (("b", 0.4), ("a", 0.4), ("c", 0.2)) for x in (F.lit(k), F.lit(v))])
    assert [(r["key"], r["value"]) for r in one(spark, sc.map_top(dist, 2))] == [("a", 0.4), ("b", 0.4)]


def test_think_row(spark):
    rng = random.Random(3)
    rows = [(u, t, rng.choice([None, 0.5, 1.0, 3.0, rng.random() * 9]), rng.choice([None, 10.0, 59.9, 60.0, 400.0]), rng.choice([None, 0, 1720])) for u, n in ((1, 2500), (2, 1), (3, 40)) for t in range(n)]
    df = spark.createDataFrame(rows, "u long, t long, s double, left double, elo int").repartition(5)
    got = {(r["u"], r["t"]): r for r in features.think_row(df, "u", ["t"], "s", "left", "elo").collect()}
    assert len(got) == len(rows)
    hist = {}
    for u, t, s, left, elo in rows:
        h = hist.setdefault(u, [])
        r, x = got[u, t], [v for v, _ in h]
        assert r["m_elo"] == (elo or 1500)
        if not h:
            assert [r[c] for c in ("m_has_history", "m_median", "m_last5", "m_last", "m_fast", "m_pressure")] == [0.0] * 6
        elif t < 200 or t % 97 == 0:
            pressed = [v for v, w in h if w is not None and w < 60]
            want = (1.0, statistics.median(x), sum(x[-5:]) / len(x[-5:]), x[-1], sum(v < 2 for v in x) / len(x), sum(pressed) / len(pressed) if pressed else statistics.median(x))
            assert tuple(r[c] for c in ("m_has_history", "m_median", "m_last5", "m_last", "m_fast", "m_pressure")) == pytest.approx(want)
        h.append((s or 0.0, left))
