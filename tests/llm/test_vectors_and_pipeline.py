import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from scrubspark.llm import hash_forest
from scrubspark.llm.graph import components

from ..conftest import SF_SMALL


def exact(ids, x, q, top):
    s = np.array([(v * q[1]).sum() for v in x])
    order = [k for k in np.lexsort((ids, -s)) if ids[k] != q[0]]
    return [(int(ids[k]), float(s[k])) for k in order[:top]]


def test_recall_and_exact_scores(spark):
    e = spark.read.parquet(f"{SF_SMALL}/embeddings.parquet")
    rows = e.collect()
    ids, x = np.array([r["vec_id"] for r in rows]), np.array([r["embedding"] for r in rows], float)
    got = {}
    for r in hash_forest.nearest(e, shard=200, block=10).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert set(got) == {int(i) for i in ids if i % 20 == 0}
    hit = sum(len({v for v, _ in got[i]} & {v for v, _ in exact(ids, x, (i, x[ids == i][0]), 20)}) for i in got)
    assert hit >= 0.9 * 20 * len(got)
    for i, found in got.items():
        assert found == sorted(found, key=lambda p: (-p[1], p[0])) and len(found) == 20
        assert all(abs(s - (x[ids == v][0] * x[ids == i][0]).sum()) < 1e-12 for v, s in found)


def test_odd_vectors_ties_and_copies(spark):
    rows = [(i, [1.0, 0.0, float(i % 3)], "x") for i in range(45)] + [
        (60, None, "x"), (61, [0.0, 0.0, 0.0], "x"), (62, [float("nan"), 1.0, 1.0], "x"), (63, [1.0, None, 1.0], "x"),
        (64, [float("inf"), 1.0, 1.0], "x"), (None, [1.0, 1.0, 1.0], "x"), (80, [1.0, 2.0], "x"), (20, [1.0, 0.0, 2.0], "x")]
    rows += [(100 + i, [3.0, 3.0, 3.0], "x") for i in range(40)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string")
    # Query 20 is there twice with one vector: the repeated row counts once.
    got = hash_forest.nearest(v).orderBy("query_id", "rank").collect()
    by = {}
    for r in got:
        by.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    ok = [r for r in rows[:45] + rows[53:]]
    ids, x = np.array([r[0] for r in ok]), np.array([r[1] for r in ok])
    assert set(by) == {0, 20, 40, 100, 120}
    for q in by:
        assert by[q] == exact(ids, x, (q, x[ids == q][0]), 20)
    assert hash_forest.nearest(v.limit(0)).count() == 0 and hash_forest.nearest(v.where("vec_id = 20")).count() == 0


def test_components_of_chains_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(100, 140)] + [(7, k) for k in range(8, 30)] + [(1, 1), (3, 2), (2, 3)]
    got = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert all(got[k] == 100 for k in range(100, 141)) and all(got[k] == 7 for k in range(7, 30)) and got[3] == got[2] == 2
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_pipeline_stages_take_effect(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    at = docs
    for name, stage in corpus_pipeline.STAGES:
        at = stage(spark, at, SF_SMALL)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert at.columns == docs.columns
            at = spark.createDataFrame(at.collect(), docs.schema)
    assert at.where(F.length("ids") != 4 * F.col("n_tokens")).count() == 0 and at.count() > 0
