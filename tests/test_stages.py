"""A run that is killed goes on where it was and gives the same; only what changed is made again."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from fidelis.operators import panel
from fidelis.operators.stages import Graph, Stage


class Killed(Exception):
    pass


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


def sums(rows):
    return rows.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars"))


@pytest.fixture
def documents(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "source", "lang", "n_chars")


def test_resumes(spark, documents, tmp_path):
    calls = []

    def fragile(rows):
        calls.append(1)
        if len(calls) == 3:
            raise Killed
        return sums(rows)

    stage = Stage("sums", fragile, "source", batches=5)
    graph = Graph(spark, str(tmp_path / "g"))
    with pytest.raises(Killed):
        graph.run(documents, stage)
    assert len(stage.made) == 2
    finished = {r["_key"] for r in graph._done(stage).collect()}
    assert 0 < len(finished) < documents.select("source").distinct().count()
    again = Stage("sums", sums, "source", batches=5)
    got = rows_of(graph.run(documents, again))
    assert got == rows_of(sums(documents))
    assert {r["_key"] for r in graph._done(again).filter(F.col("_batch").isin(again.made)).collect()}.isdisjoint(finished)
    third = Stage("sums", sums, "source", batches=5)
    assert rows_of(graph.run(documents, third)) == got and third.made == []


def test_data_without_keys_does_not_count(spark, documents, tmp_path):
    graph, stage = Graph(spark, str(tmp_path / "g")), Stage("sums", sums, "source", batches=1)
    sums(documents).withColumn("n", F.lit(-1).cast("long")).write.parquet(str(tmp_path / "g/sums/data/1-lost"))
    assert rows_of(graph.run(documents, stage)) == rows_of(sums(documents))


def test_only_what_changed(spark, documents, tmp_path):
    graph = Graph(spark, str(tmp_path / "g"))
    run = lambda df, version="1": (s := Stage("sums", sums, "source", version, batches=3), rows_of(graph.run(df, s)))
    run(documents)
    some = documents.filter("source is not null").select("source").first()["source"]
    changed = documents.withColumn("n_chars", F.when(F.col("source") == some, F.col("n_chars") + 1).otherwise(F.col("n_chars")))
    stage, got = run(changed)
    assert got == rows_of(sums(changed)) and len(stage.made) == 1
    assert [r["_key"] for r in graph._done(stage).filter(F.col("_batch").isin(stage.made)).collect()] == [some]
    less = documents.filter(F.col("source") != some)
    stage, got = run(less)
    assert got == rows_of(sums(less)) and stage.made == []
    stage, got = run(documents)  # as before: nothing to make
    assert got == rows_of(sums(documents)) and stage.made == []
    stage, got = run(documents.repartition(7).orderBy("lang"), "2")  # another rule
    assert got == rows_of(sums(documents)) and len(stage.made) > 1
    odd = documents.limit(20).withColumn("source", F.when(F.col("doc_id") % 2 == 0, F.col("source")))
    stage, got = run(odd, "3")
    assert got == rows_of(sums(odd))
    assert rows_of(graph.run(documents.filter("false"), Stage("none", sums, "source"))) == []


def test_panel_of_stages(spark, documents, tmp_path):
    """A panel in three stages: documents within a budget per source, the sources' languages, and folds over all."""

    def budget(rows):
        return panel.budget_fill(rows, "source", ["doc_id"], "n_chars", 20_000).filter("taken").select("source", "doc_id", "lang", "n_chars")

    def primary(rows):
        sizes = rows.groupBy("source", "lang").agg(F.count(F.lit(1)).alias("size"), F.min("doc_id").alias("earliest"))
        return panel.choose_primary(sizes, "source", "size", "earliest", "lang", least=3).select("source", "lang", "size")

    def whole(rows):
        ranked = rows.withColumn("stratum", F.ntile(3).over(Window.orderBy("size", "source", "lang")))
        return panel.folds(ranked, "stratum", "source").select("source", "lang", "size", "stratum", "fold")

    graph = Graph(spark, str(tmp_path / "p"))
    docs = documents.filter("source is not null")

    def build(df, stop=None):
        made, stages = df, [Stage("budget", budget, "source", batches=3), Stage("primary", primary, "source", batches=2), Stage("panel", whole)]
        for s in stages:
            if s.name == stop:
                raise Killed
            made = graph.run(made, s)
        return rows_of(made), {s.name: len(s.made) for s in stages}

    with pytest.raises(Killed):
        build(docs, stop="primary")
    got, made = build(docs)
    assert made["budget"] == 0 and made["primary"] >= 1 and made["panel"] == 1
    assert got == rows_of(whole(primary(budget(docs))))
    assert build(docs) == (got, {"budget": 0, "primary": 0, "panel": 0})
