"""Approximate nearest neighbours by inner product with a hash-prefix forest.

Each tree maps a vector to a long string of hash bits (signs of random projections); a shard keeps the
strings of its vectors sorted, one array per tree.  A query descends in every tree to the items that share
its longest prefix, then all trees ascend together, one bit at a time, until ``SHARE`` of the shard's
vectors are candidates.  Candidates are scored exactly and the best of all shards are merged.  Vectors are
lengthened by one coordinate so that all have the largest norm, which turns the inner product into an angle.

Shards hold at most about ``SHARD`` different vectors and meet blocks of ``BLOCK`` queries, so a task's
memory is bounded.  Equal vectors are one entry with their ``TOP`` + 1 least ids (no more can appear in a
result), so a vector that a third of all rows share costs one row, and its queries are searched once.

Defined cases: vectors that are NULL, zero, hold NULL or non-finite components, or differ in length from the
most common (then longest) take no part; NULL ids neither; a repeated (id, vector) counts once; ties go to
the smaller id; an empty table, or a single id, gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from scrubspark.llm.common import stored

#: Neighbours of a query; trees and bits of the forest; different vectors of a shard; queries of a block.
TOP, TREES, BITS, SHARD, BLOCK = 20, 48, 32, 8192, 2048
#: Share of a shard that must be candidates before the ascent stops, and the least number of them.
SHARE, LEAST = 0.6, 64


def usable(vectors: DataFrame, vec_id: str = "vec_id", vec: str = "embedding") -> DataFrame:
    """(id, vec) of the rows that take part, each pair once, components as doubles."""
    v = vectors.select(F.col(vec_id).cast("long").alias("id"), F.transform(
        F.col(vec), lambda x: x.cast("double") + F.lit(0.0)).alias("vec")).where("id is not null and vec is not null")
    v = v.where(~F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
                & F.exists("vec", lambda x: x != 0))
    size = v.groupBy(F.size("vec").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    return v.where(F.size("vec") == (size["n"] if size else 0)).distinct()


def _strings(x: np.ndarray, seed: int) -> np.ndarray:
    """(trees, rows) hash strings as integers, the first bit highest."""
    planes = np.random.default_rng(seed).standard_normal((TREES, x.shape[1], BITS))
    place = np.uint64(1) << np.arange(BITS - 1, -1, -1, dtype=np.uint64)
    return np.stack([((x @ p > 0) * place).sum(axis=1, dtype=np.uint64) for p in planes])


class Forest:
    def __init__(self, x: np.ndarray, norm: float, seed: int = 7):
        self.x, self.seed = x, seed
        extra = np.sqrt(np.maximum(norm * norm - (x * x).sum(axis=1), 0))
        s = _strings(np.c_[x, extra], seed)
        self.order = np.argsort(s, axis=1, kind="stable")
        self.sorted = np.take_along_axis(s, self.order, axis=1)

    def search(self, q: np.ndarray, top: int, share: float, least: int):
        """For each query, positions and inner products of the ``top`` best candidates."""
        n = len(self.x)
        want = min(n, max(least, int(np.ceil(share * n))))
        s = _strings(np.c_[q, np.zeros(len(q))], self.seed)
        # Range of each tree's items that share the first ``level`` bits, for every level.
        low = np.empty((BITS + 1, TREES, len(q)), np.int32)
        high = np.empty_like(low)
        for level in range(BITS + 1):
            rest = np.uint64((1 << BITS - level) - 1)
            for t in range(TREES):
                low[level, t] = np.searchsorted(self.sorted[t], s[t] & ~rest, "left")
                high[level, t] = np.searchsorted(self.sorted[t], s[t] | rest, "right")
        total = (high - low).sum(axis=1)
        for k in range(len(q)):
            # No level with fewer entries can have enough different items.
            level = int(np.flatnonzero(total[:, k] >= want)[-1])
            found = np.zeros(n, bool)
            while True:
                for t in range(TREES):
                    found[self.order[t, low[level, t, k]:high[level, t, k]]] = True
                if level == 0 or np.count_nonzero(found) >= want:
                    break
                level -= 1
            at = np.flatnonzero(found)
            score = (self.x[at] * q[k]).sum(axis=1)
            if len(at) > top:
                # Keep ties at the edge: the merge decides them by id.
                edge = np.partition(score, len(at) - top)[len(at) - top]
                at, score = at[score >= edge], score[score >= edge]
            yield at, score


def _searcher(norm: float, top: int, share: float, least: int):
    def run(items: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out = {"q": [], "found": [], "score": []}
        if len(items) and len(queries):
            items = items.sort_values("v")
            ids = items["v"].to_numpy()
            forest = Forest(np.stack(items["vec"].to_numpy()), norm)
            got = forest.search(np.stack(queries["vec"].to_numpy()), top, share, least)
            for q, (at, score) in zip(queries["v"], got):
                best = np.lexsort((ids[at], -score))[:top]
                out["q"].append(q)
                out["found"].append(ids[at][best])
                out["score"].append(score[best])
        return pd.DataFrame(out)
    return run


def nearest(vectors: DataFrame, every: int = 20, top: int = TOP, share: float = SHARE, least: int = LEAST,
            shard: int = SHARD, block: int = BLOCK, vec_id: str = "vec_id", vec: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the ``top`` nearest found of each id divisible by ``every``."""
    rows = stored(usable(vectors, vec_id, vec), "vectors")
    first = rows.withColumn("n", F.row_number().over(W.Window.partitionBy("vec").orderBy("id"))).where(F.col("n") <= top + 1)
    each = stored(first.groupBy("vec").agg(F.sort_array(F.collect_list("id")).alias("ids")).withColumn(
        "v", F.element_at("ids", 1)), "distinct-vectors")
    asked = stored(rows.where(F.col("id") % every == 0).join(each.select("vec", "v"), "vec").select(
        F.col("id").alias("query_id"), "v"), "asked")
    queries = stored(each.join(asked.select("v").distinct(), "v", "left_semi").select("v", "vec"), "query-vectors")
    n, norm = each.agg(F.count("*"), F.sqrt(F.max(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x)))).first()
    shards, blocks = max(1, -(-n // shard)), max(1, -(-queries.count() // block))
    deal = lambda what, k: F.pmod(F.xxhash64(F.lit(what), "v"), F.lit(k)).cast("int")
    left = each.select(deal("shard", shards).alias("shard"), "v", "vec",
                       F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    right = queries.select(deal("block", blocks).alias("block"), "v", "vec",
                           F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"))
    found = left.groupBy("shard", "block").cogroup(right.groupBy("shard", "block")).applyInPandas(
        _searcher(norm or 0.0, top + 1, share, least), "q long, found array<long>, score array<double>")
    pairs = found.select("q", F.explode(F.arrays_zip("found", "score")).alias("x")).select(
        "q", F.col("x.found").alias("v"), F.col("x.score").alias("score"))
    best = W.Window.partitionBy("q").orderBy(F.desc("score"), "v")
    pairs = pairs.withColumn("n", F.row_number().over(best)).where(F.col("n") <= top + 1).drop("n")
    pairs = pairs.join(each.select("v", "ids"), "v").select("q", "score", F.explode("ids").alias("vec_id"))
    best = W.Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    pairs = stored(pairs.withColumn("n", F.row_number().over(best)).where(F.col("n") <= top + 1).groupBy("q").agg(
        F.sort_array(F.collect_list(F.struct("n", "vec_id", "score"))).alias("list")), "neighbours")
    # One list per query vector; a query drops its own id and keeps the first ``top``.
    out = asked.join(pairs, F.col("v") == F.col("q")).select("query_id", F.posexplode(F.slice(F.filter(
        "list", lambda x: x["vec_id"] != F.col("query_id")), 1, top)).alias("at", "x"))
    return out.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"),
                      F.col("x.score").alias("score"))
