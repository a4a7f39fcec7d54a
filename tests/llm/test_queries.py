"""The registered queries and the pipeline against SQL or each other on the smallest tables."""

from __future__ import annotations

import os
import random

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from codeloom.llm.common import materialize
from codeloom.llm.oracles import ORACLES
from codeloom.llm.queries import QUERIES
from codeloom.storage import shared_dir

SF = "/root/testdata/sf0.001"


def test_names_and_registration():
    assert {n.split("_")[0] for n in QUERIES} == {f"op{i}" for i in range(1, 11)}
    assert set(QUERIES) | {"pipeline"} <= set(__spark_entry__.queries()) and set(ORACLES) <= set(__spark_entry__.oracle_sql())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    db = duckdb.connect()
    for t in ("documents", "pages"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    want = db.execute(f"SELECT {', '.join(columns)} FROM ({ORACLES[name]})").fetchall()
    assert sorted(map(repr, (tuple(r) for r in got.select(*columns).collect()))) == sorted(map(repr, want))


def test_pipeline_stages(spark):
    docs = first = spark.read.parquet(f"{SF}/documents.parquet")
    counts = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = materialize(stage(spark, docs.withColumn("extra", F.lit(1)), SF).drop("extra"), "stage")
        assert docs.columns == first.columns
        counts.append(docs.count())
    assert first.count() > counts[0] >= counts[1] >= counts[2] >= counts[3] > 0
    mixed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert mixed.count() and mixed.where("taken > 2 * size OR taken <= 0").count() == 0
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, first.limit(0), SF).count() == 0


def test_pipeline_stages_by_hand(spark, tmp_path):
    """Each stage on rows with nulls, repeats and clashing names, against plain Python."""
    rng = random.Random(7)
    text = lambda n, seed: " ".join(f"w{random.Random(seed * 1000 + i).randrange(3000)}" for i in range(n))
    line, item = "a line of more than forty characters that documents share", text(30, 900)
    rows = [(i, text(60, i) + ("\n" + line if i < 7 else "")) for i in range(20)]
    rows += [(30, text(60, 10)), (31, text(60, 10).upper()), (10, text(60, 10)), (10, text(50, 11)), (None, text(60, 12)), (None, text(60, 50)), (None, text(60, 50))]
    rows += [(40, text(20, 60) + " " + item), (None, item + " " + text(20, 61)), (41, None), (42, ""), (42, ""), (43, "---"), (44, "---")]
    kind = "doc_id long, text string, lang string, source string, n_chars long, row string, keep int, class_id long"
    docs = spark.createDataFrame([(i, t, "en", rng.choice(["a", "b", None]), len(t or ""), "r", 1, 2) for i, t in rows], kind).repartition(3)
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    stages = dict(corpus_pipeline.STAGES)
    run = lambda name: stages[name](spark, docs, str(tmp_path))
    pairs = lambda df: sorted(((r.doc_id, r.text) for r in df.collect()), key=str)
    for name in list(stages)[:-1]:
        assert stages[name](spark, docs.limit(0), str(tmp_path)).columns == docs.columns
    assert pairs(run("quality classifier")) == sorted(rows, key=str)
    lined = [(i, (t or "") if i is None or i == 6 or line not in (t or "") else t.replace("\n" + line, "")) for i, t in rows]
    assert pairs(run("line dedup")) == sorted(lined, key=str)
    assert all(r.n_chars == len(r.text) for r in run("line dedup").collect())
    single = [(i, t) for i, t in dict.fromkeys(rows) if i not in (11, 30, 31) and not (i is None and t == text(60, 12))]
    assert pairs(run("n-gram Jaccard join")) == sorted(single + [(42, "")], key=str)
    assert pairs(run("benchmark decontamination")) == sorted([(i, t) for i, t in rows if item not in (t or "")], key=str)
    mixed = run("mixing sources")
    assert {r.doc_id for r in mixed.collect()} <= {i for i, t in rows if (t or "").split()} and mixed.count()


def test_pipeline_run_chains_stages_and_removes_their_tables(spark, monkeypatch):
    """``run`` is the stages one after the other; that each is right is tested above."""
    seen = []

    def stage(name):
        def step(spark, docs, sf_dir):
            seen.append((name, sf_dir, docs.count()))
            kept = materialize(docs.where(F.col("doc_id") % 7 != len(seen)), "inner")
            return kept.withColumn("doc_id", F.col("doc_id") + 1)

        return name, step

    whole = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id").collect()
    monkeypatch.setattr(corpus_pipeline, "STAGES", [stage(n) for n in ("a b", "c", "d")])
    before = set(os.listdir(shared_dir(spark).removeprefix("file://")))
    got, ids = sorted(r.doc_id for r in corpus_pipeline.run(spark, SF).collect()), [r.doc_id for r in whole]
    assert [(n, d) for n, d, _ in seen] == [("a b", SF), ("c", SF), ("d", SF)] and seen[0][2] == len(ids)
    for k in (1, 2, 3):
        ids = [i + 1 for i in ids if i % 7 != k]
    assert got == sorted(ids)
    assert len(set(os.listdir(shared_dir(spark).removeprefix("file://"))) - before) == 1


def test_pipeline_run(spark):
    before = set(os.listdir(shared_dir(spark).removeprefix("file://")))
    got = corpus_pipeline.run(spark, SF)
    left = set(os.listdir(shared_dir(spark).removeprefix("file://"))) - before
    assert len(left) == 1 and got.count() and got.columns[:3] == ["doc_id", "source", "size"]
