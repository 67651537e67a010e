"""SimHash near-duplicates by covering locality-sensitive hashing.

Every text gets a 64-bit SimHash of its word shingles.  Two fingerprints within ``radius`` bits must
share a bucket in one of 2^(radius+1)-1 tables: bit i carries a vector m(i) of radius+1 bits, and the
table of a non-zero vector w keeps the bits with odd <m(i), w>.  The differing bits of a close pair
span at most ``radius`` dimensions, so some w is orthogonal to all of them, and its table masks them out.

Only distinct fingerprints are bucketed, so exact copies cost one row.  A bucket of more than
``SPLIT`` fingerprints is cut exactly: its free bits fall into radius+1 blocks and a close pair agrees on
one of them, so members move to one sub-bucket per block.  After ``LEVELS`` cuts at most 2^13 different
fingerprints can share a bucket.  A bucket returns a spanning forest of its links, never all pairs.

Defined cases: NULL text counts as empty; no words give fingerprint zero, linked like any other; a
repeated row keeps its rows; a NULL doc_id is never a group's name unless the group has no other;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scrubspark.llm.common import fresh, map_texts, quoted, stored
from scrubspark.llm.graph import components

#: Fingerprints of a bucket beyond which it is cut further, and the number of cuts.
SPLIT, LEVELS = 1000, 3
#: Shingles whose bits are counted at once.
RUN = 1 << 15


def fingerprint(text: str, shingle: int = 3, seed: int = 42) -> int:
    """Majority bits of the XXH64 of each shingle (repeats included) of the lower-cased (A-Z) text."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    flat = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return digest(flat, seed)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = [0, *ends[:len(words) - shingle].tolist()]
    stops = (ends[shingle - 1:] - 1).tolist()
    count, n = np.zeros(64, np.int64), len(starts)
    for k in range(0, n, RUN):
        h = np.array([digest(flat[a:b], seed) for a, b in zip(starts[k:k + RUN], stops[k:k + RUN])], "<u8")
        count += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * count > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, keys: list[str], text: str = "text", shingle: int = 3) -> DataFrame:
    """``keys`` and ``fp`` (the fingerprint as a signed long), one row per row of ``docs``."""
    def run(texts):
        return {"fp": np.array([fingerprint(t, shingle) for t in texts], np.uint64).view(np.int64)}
    return map_texts(docs, keys, text, run, "fp long")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def covering_masks(radius: int) -> list[int]:
    """One mask for each non-zero vector of radius+1 bits; bit i has the vector 1 + i mod (2^(radius+1)-1)."""
    n = (1 << radius + 1) - 1
    return [sum(1 << i for i in range(64) if bin((1 + i % n) & w).count("1") & 1) for w in range(1, n + 1)]


def _cut(mask: int, radius: int) -> list[int]:
    """``mask`` with one more of the radius+1 blocks of its free bits each."""
    free = [i for i in range(64) if not mask >> i & 1]
    parts = np.array_split(np.array(free, int), radius + 1)
    return [mask | sum(1 << int(i) for i in part) for part in parts]


def _forest(fps: np.ndarray, radius: int) -> Iterator[tuple[int, int]]:
    """Edges of a spanning forest of the links among the distinct fingerprints of one bucket."""
    n = len(fps)
    near = np.empty((n, n), bool)
    for a in range(0, n, 256):
        near[a:a + 256] = np.bitwise_count(fps[a:a + 256, None] ^ fps[None, :]) <= radius
    if near.sum() == n:
        return
    open_ = np.ones(n, bool)
    for first in range(n):
        if not open_[first]:
            continue
        open_[first] = False
        wave = [first]
        while wave:
            at = wave.pop()
            new = np.flatnonzero(near[at] & open_)
            open_[new] = False
            for j in new.tolist():
                yield at, j
            wave.extend(new.tolist())


def _linker(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by (path, key); a bucket may cross batches, so the last one is carried."""
        left = np.empty((0, 3), np.int64)

        def emit(rows):
            if not len(rows):
                return None
            new = np.flatnonzero((rows[1:, :2] != rows[:-1, :2]).any(axis=1)) + 1
            starts, ends = np.r_[0, new], np.r_[new, len(rows)]
            fps, size = rows[:, 2].view(np.uint64), ends - starts
            two = starts[size == 2]
            two = two[np.bitwise_count(fps[two] ^ fps[two + 1]) <= radius]
            a, b = [fps[two]], [fps[two + 1]]
            for s, e in zip(starts[size > 2], ends[size > 2]):
                got = list(_forest(fps[s:e], radius))
                if got:
                    i, j = np.array(got).T
                    a.append(fps[s:e][i])
                    b.append(fps[s:e][j])
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).view(np.int64)) for x in (a, b)], ["a", "b"])

        for batch in batches:
            rows = np.concatenate([left, np.stack([batch.column(i).to_numpy(False) for i in range(3)], axis=1)])
            if not len(rows):
                continue
            same = (rows[:, :2] == rows[-1, :2]).all(axis=1)
            keep = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
            left = rows[keep:]
            if (out := emit(np.ascontiguousarray(rows[:keep]))) is not None:
                yield out
        if (out := emit(np.ascontiguousarray(left))) is not None:
            yield out
    return run


def links(fps: DataFrame, radius: int = 3) -> DataFrame:
    """(a, b): a spanning forest, per bucket, of all pairs of distinct ``fp`` within ``radius`` bits."""
    masks = covering_masks(radius)
    members = fps.select(F.explode(F.array(*[
        F.struct(F.lit(t).cast("long").alias("path"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key"), "fp")
        for t, m in enumerate(masks)])).alias("x")).select("x.*")
    found = None
    for level in range(LEVELS + 1):
        cold = members
        if level < LEVELS:
            hot = stored(members.groupBy("path", "key").count().where(F.col("count") > SPLIT).select("path", "key"),
                         "hot-buckets")
            if hot.isEmpty():
                hot = None
            else:
                cold = members.join(hot, ["path", "key"], "left_anti")
        else:
            hot = None
        dealt = cold.select("path", "key", "fp").repartition("path", "key").sortWithinPartitions("path", "key", "fp")
        part = dealt.mapInArrow(_linker(radius), "a long, b long")
        found = part if found is None else found.unionAll(part)
        if hot is None:
            return found
        finer = [_cut(m, radius) for m in masks]
        masks = [m for ms in finer for m in ms]
        table_ = F.array(*[F.array(*[F.lit(_signed(m)) for m in ms]) for ms in finer])
        members = members.join(hot, ["path", "key"], "left_semi").withColumn(
            "cuts", F.element_at(table_, (F.col("path") + 1).cast("int"))).select(
            "path", "fp", F.posexplode("cuts").alias("j", "mask")).select(
            (F.col("path") * (radius + 1) + F.col("j")).alias("path"),
            F.col("fp").bitwiseAND(F.col("mask")).alias("key"), "fp")
    return found


def groups(fps: DataFrame, radius: int = 3, name: str = "doc_id") -> DataFrame:
    """(fp, component_id) for each distinct ``fp``: the smallest ``name`` in its linked component."""
    each = stored(fps.groupBy("fp").agg(F.min(quoted(name)).alias("first")), "fingerprints")
    comp = components(links(each.select("fp"), radius))
    named = each.join(comp, each.fp == comp.node, "left").select(
        "fp", "first", F.coalesce("root", "fp").alias("root"))
    least = named.groupBy("root").agg(F.min("first").alias("component_id"))
    return named.join(least, "root").select("fp", "component_id")


def simhash_components(docs: DataFrame, radius: int = 3, shingle: int = 3) -> DataFrame:
    """(doc_id, fp, component_id), one row per row of ``docs``."""
    fps = stored(fingerprints(docs.select("doc_id", "text"), ["doc_id"], shingle=shingle), "simhash")
    return fps.join(groups(fps, radius), "fp").select("doc_id", "fp", "component_id")


def hex_digits(fp):
    """A signed long as 16 lowercase hex digits."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def deduplicate(docs: DataFrame, radius: int = 3, shingle: int = 3) -> DataFrame:
    """``docs`` with one row of each group: the least (doc_id, NULL last; hash of the text).

    Rows that repeat a whole (doc_id, text) are one document.  All columns of ``docs`` are kept.
    """
    h = fresh(docs, "text_hash")
    with_hash = docs.withColumn(h, F.xxhash64(F.coalesce("text", F.lit(""))))
    fps = stored(fingerprints(with_hash.select("doc_id", h, "text"), ["doc_id", h], shingle=shingle), "simhash")
    fps = fps.withColumnRenamed(h, "h")
    comp = groups(fps, radius)
    order = F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("d"), F.col("h"))
    keep = fps.join(comp, "fp").withColumn("order", order)
    # A group may have no doc_id at all: name it by its least fingerprint then.
    keep = keep.groupBy("component_id", F.when(F.col("component_id").isNull(), F.col("fp")).alias("f")).agg(
        F.min("order").alias("o")).select(F.col("o.d").alias("kept_id"), F.col("o.h").alias("kept_h"))
    keep = stored(keep, "kept")
    repeats = not fps.groupBy("doc_id", "h").count().where("count > 1").isEmpty()
    out = with_hash.join(keep, F.col("doc_id").eqNullSafe(F.col("kept_id")) & (quoted(h) == F.col("kept_h")), "left_semi")
    if repeats:
        out = out.dropDuplicates(["doc_id", h])
    return out.drop(h)
