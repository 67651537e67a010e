"""Phrase collocations by Toivonen mining.

A hash sample of the documents is mined at a lowered support and proposes a set S of phrases.  A full pass then
counts S and its negative border: all words, and every longer phrase whose leading and trailing part (without
the last and the first word) are both in S.  It sums by 64-bit phrase hash, so a total is the count or, should two
phrases share a hash, more; a phrase whose total is below the support is settled as too rare.  The last pass counts the
others by their text, exactly, and expands where the border failed: a frequent phrase outside S admits
longer ones that the first pass did not count.  It looks ahead, i.e. takes a phrase it has just admitted for
frequent, so the expansion runs to the longest phrases at once and closes: the parts of a frequent phrase are
frequent, hence either settled as possible by the first pass or admitted in this one, and so is the phrase.

A set of phrases travels as a bit table over their hashes, of at most ``MOST_BITS`` bits (32 MB) however many it
holds; a foreign phrase that shares a bit is merely counted as well.  Inside a task, slices of text become word
numbers, and the phrases of each length are numbered from those of the length before (a pair of exact numbers,
never a hash).  Totals by hash are merged per range of hashes, as many ranges as the bytes of text call for; counts
by text are summed by Spark with map-side combine.  So neither a common phrase nor a large language gathers in one
task.

Defined cases: a NULL text is empty and counts no words; a NULL language is ``und``; empty texts, texts without
words and an empty table add nothing; a repeated row counts each time; very long texts are read whole; other
columns are ignored.  Scores are compared after flooring, ties go to the earliest cut, and products are decimals.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scrubspark.llm.common import quoted, stored

LONGEST = 4
#: Share of the documents in the sample, and how far its support is lowered below the expected count.
SHARE, LOWERED = 0.1, 0.5
#: Bit tables have 16 bits for each phrase of S, within these bounds.
LEAST_BITS, MOST_BITS = 1 << 20, 1 << 28
#: Bytes of text that a task numbers at once, and that call for one range of hashes.
SLICE, RANGE = 4_000_000, 8_000_000
#: Fixed values: ``bitmap_construct_agg`` gives tables of so many bits.
BUCKET_BITS = 32768
TOTALS = pa.schema([("part", pa.int64()), ("h", pa.binary()), ("a", pa.binary())])
COUNTS = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("len", pa.int32()), ("a", pa.int64())])
_BREAKS = bytes(10 if chr(i) in ".,;:!?\n\x0b\x0c\r" else 32 if i == 9 else i for i in range(256))
_K1, _K2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


class _Numbers(dict):
    """Numbers words in the order they are first looked up."""

    def __missing__(self, word):
        self[word] = n = len(self)
        return n


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = (a ^ (a >> np.uint64(29))) * _K1 + b * _K2
    return x ^ (x >> np.uint64(32))


class Table:
    """A set of phrases as a bit table over their hashes."""

    def __init__(self, bits: bytes):
        self.bits, self.mask = np.frombuffer(bits, np.uint8), np.uint64(len(bits) * 8 - 1)

    def has(self, h: np.ndarray) -> np.ndarray:
        at = h & self.mask
        return (self.bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


def numbered(lang: str, texts: list[bytes]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """(words, numbers, hashes): the distinct words, the number of each word of the texts in turn (1 between two
    pieces), and the hash of each distinct word."""
    data = b"\n".join(texts).lower().translate(_BREAKS).replace(b"\n", b" \n ").split(b" ")
    numbers = _Numbers({b"": 0, b"\n": 1})
    w = np.fromiter(map(numbers.__getitem__, data), np.int64, len(data))
    seed = xxhash.xxh64_intdigest(lang.encode())
    return list(numbers), w[w != 0], np.array([xxhash.xxh64_intdigest(x, seed) for x in numbers], np.uint64)


def _longer(w: np.ndarray, size: int, at: np.ndarray, n: int):
    """The phrases of ``n`` words whose parts start at p and p+1 (``at``: the part's number or -1).

    Returns their numbers by place (or -1), and for each number its first part, its trailing part, its last word
    and its count.
    """
    left, right = at[:-1], at[1:]
    pos = np.flatnonzero((left >= 0) & (right >= 0))
    code, pairs = pd.factorize(left[pos] * size + w[pos + n - 1])
    here = np.full(len(left), -1, np.int64)
    here[pos] = code
    tail = np.zeros(len(pairs), np.int64)
    tail[code] = right[pos]
    return here, pairs // size, tail, pairs % size, np.bincount(code, minlength=len(pairs))


def _only(at: np.ndarray, keep: np.ndarray) -> np.ndarray:
    """``at`` with -1 for the numbers that ``keep`` does not mark."""
    return np.where((at >= 0) & keep[at], at, -1) if len(keep) else at


def proposals(lang: str, texts: list[bytes], table: Table | None, known: int, least: int, longest: int):
    """Yield (hashes, counts) of S, ``table``, and its border, by length; S has phrases of up to ``known`` words,
    longer ones are only asked to be made of them."""
    names, w, hashes = numbered(lang, texts)
    word = w != 1
    count, h, at = np.bincount(w[word], minlength=len(names)), hashes, np.where(word, w, -1)
    for n in range(1, longest + 1):
        if n > 1:
            at, first, _, last, count = _longer(w, len(names), at, n)
            h = _mix(h[first], hashes[last])
        if n >= least:
            there = np.flatnonzero(count)
            yield h[there], count[there]
        if n <= known:
            at = _only(at, table.has(h))


def counted(lang: str, texts: list[bytes], proposed: Table, possible: Table, longest: int):
    """Yield (phrases, length, counts): the empty phrase with the number of words, the ``possible`` phrases among
    those that the pass over ``proposed`` counted, and phrases that it did not but whose parts come here."""
    names, w, hashes = numbered(lang, texts)
    word = w != 1
    yield [b""], 0, np.array([int(word.sum())])
    count, h, at, part = np.bincount(w[word], minlength=len(names)), hashes, np.where(word, w, -1), [np.arange(len(names))]
    told = np.ones(len(names), bool)  # counted by the pass before
    for n in range(1, longest + 1):
        if n > 1:
            spread = told & proposed.has(h)
            at, first, tail, last, count = _longer(w, len(names), at, n)
            told = spread[first] & spread[tail]
            h = _mix(h[first], hashes[last])
            part = [*[x[first] for x in part], last]
        keep = (~told | possible.has(h)) & (count > 0)
        new = np.flatnonzero(keep)
        yield [b" ".join(x) for x in zip(*[[names[i] for i in x[new].tolist()] for x in part])], n, count[new]
        at = _only(at, keep)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, list[bytes]]]:
    """The texts of the batches (lang, text) by language, about ``SLICE`` bytes at a time."""
    held: dict[str, list[bytes]] = {}
    taken = 0
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            held.setdefault(lang, []).append(text)
            taken += len(text)
            if taken > SLICE:
                yield held
                held, taken = {}, 0
    yield held


def hash_totals(texts: DataFrame, bits, known: int, support: int, ranges: int, least: int = 1, longest: int = LONGEST) -> DataFrame:
    """(h): the hashes whose total over all ``texts`` (lang, text) is at least ``support``.

    A slice sends, for each of the ``ranges`` (a power of two) of hashes, one row with its hashes and counts.
    """
    low = ranges.bit_length() - 1

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Table(bits.value) if bits else None

        for held in _slices(batches):
            got = [x for lang, own in held.items() for x in proposals(lang, own, table, known, least, longest)]
            if not got:
                continue
            h, a = np.concatenate([x for x, _ in got]), np.concatenate([x for _, x in got]).astype("<i8")
            order = np.argsort(h)
            h, a = h[order], a[order]
            parts, start = np.unique((h >> np.uint64(64 - low)).astype(np.int64), return_index=True)
            cut = [*start.tolist(), len(h)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(parts), pa.array([h[x:y].tobytes() for x, y in zip(cut, cut[1:])], pa.binary()),
                 pa.array([a[x:y].tobytes() for x, y in zip(cut, cut[1:])], pa.binary())], schema=TOTALS)

    def merge(rows: pd.DataFrame) -> pd.DataFrame:
        h, at = np.unique(np.frombuffer(b"".join(rows["h"]), np.uint64), return_inverse=True)
        total = np.zeros(len(h), np.int64)
        np.add.at(total, at, np.frombuffer(b"".join(rows["a"]), "<i8"))
        return pd.DataFrame({"h": h[total >= support].view(np.int64)})

    return texts.mapInArrow(part, "part long, h binary, a binary").groupBy("part").applyInPandas(merge, "h long")


def exact_counts(texts: DataFrame, proposed, possible) -> DataFrame:
    """(lang, phrase, len, a): the counts over all ``texts`` of ``counted`` phrases."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = Table(proposed.value), Table(possible.value)

        for held in _slices(batches):
            for lang, own in held.items():
                for names, n, a in counted(lang, own, *tables, LONGEST):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang] * len(names), pa.string()), pa.array(names, pa.binary()).cast(pa.string()),
                         pa.array(np.full(len(names), n, np.int32)), pa.array(a.astype(np.int64))], schema=COUNTS)

    return texts.mapInArrow(run, "lang string, phrase string, len int, a long").groupBy("lang", "phrase", "len").agg(F.sum("a").alias("a"))


def bit_table(members: DataFrame):
    """A broadcast bit table of the hashes ``h`` of ``members``: at most ``MOST_BITS`` bits reach the driver."""
    size = min(MOST_BITS, max(LEAST_BITS, 1 << (16 * members.count()).bit_length()))
    at = F.col("h").bitwiseAND(F.lit(size - 1)) + 1
    rows = members.groupBy(F.bitmap_bucket_number(at).alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits")).collect()
    out = np.zeros(size // 8, np.uint8)
    for r in rows:
        start = (r["k"] - 1) * BUCKET_BITS // 8
        out[start:start + BUCKET_BITS // 8] = np.frombuffer(r["bits"], np.uint8)
    return members.sparkSession.sparkContext.broadcast(out.tobytes())


def frequent(texts: DataFrame, sample: DataFrame, support: int, share: float, lowered: float = LOWERED) -> DataFrame:
    """(lang, phrase, len, a) of every phrase with a count of at least ``support``, and of the empty phrase."""
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = 1 << max(6, (size // RANGE).bit_length())
    low = max(2, int(support * share * lowered))
    # The sample: its words first, then the phrases made of its frequent words.
    words = stored(hash_totals(sample, None, 0, low, ranges, longest=1), "phrase-words")
    longer = hash_totals(sample, bit_table(words), 1, low, ranges, least=2, longest=LONGEST - 1)
    proposed = bit_table(stored(words.unionAll(longer), "phrase-sample"))
    possible = bit_table(stored(hash_totals(texts, proposed, LONGEST, support, ranges), "phrase-possible"))
    counts = exact_counts(texts, proposed, possible)
    return stored(counts.where((F.col("a") >= support) | (F.col("len") == 0)), "phrase-counts")


def _wide(name: str) -> Column:
    return F.col(name).cast("decimal(38,0)")


def scored(counts: DataFrame) -> DataFrame:
    """(lang, phrase, len, a, l, r, score) of every frequent phrase of two words or more, at its worst cut."""
    long_ = counts.where("len > 1").select("lang", "phrase", "len", "a", F.split("phrase", " ").alias("w"))
    cuts = long_.select("lang", "phrase", "len", "a", "w", F.explode(F.sequence(F.lit(1), F.col("len") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "len", "a", "k", F.array_join(F.slice("w", F.lit(1), F.col("k")), " ").alias("first"),
                       F.array_join(F.slice("w", F.col("k") + 1, F.col("len") - F.col("k")), " ").alias("rest"))
    of = counts.where("len > 0")
    cuts = cuts.join(of.select("lang", F.col("phrase").alias("first"), F.col("a").alias("l")), ["lang", "first"])
    cuts = cuts.join(of.select("lang", F.col("phrase").alias("rest"), F.col("a").alias("r")), ["lang", "rest"])
    score = F.expr("cast(2000000 * cast(a as decimal(38,0)) as decimal(38,0)) div cast(l + r as decimal(38,0))")
    worst = cuts.groupBy("lang", "phrase", "len", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut"))
    return worst.select("lang", "phrase", "len", "a", "cut.l", "cut.r", "cut.score")


def maximal(found: DataFrame) -> DataFrame:
    """``found`` without phrases that lie inside a longer one with at least 80 % of their count."""
    longer = found.where("len > 2").select("lang", "len", "a", F.split("phrase", " ").alias("w"))
    runs = longer.select("lang", "a", "len", "w", F.explode(F.sequence(F.lit(2), F.col("len") - 1)).alias("n"))
    runs = runs.select("lang", "a", "n", "w", F.explode(F.sequence(F.lit(1), F.col("len") - F.col("n") + 1)).alias("at"))
    most = runs.groupBy("lang", F.array_join(F.slice("w", F.col("at"), F.col("n")), " ").alias("phrase")).agg(F.max("a").alias("most"))
    tight = F.coalesce(100 * _wide("most") >= 80 * _wide("a"), F.lit(False))
    return found.join(most, ["lang", "phrase"], "left").where(~tight).drop("most")


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", support: int = 30,
                 top: int = 2000, share: float = SHARE) -> DataFrame:
    """The first ``top`` collocations of each language: lang, rank, phrase, a, l, r, n, score."""
    of = F.coalesce(quoted(lang), F.lit("und")).alias("lang")
    body = F.coalesce(quoted(text), F.lit("")).cast("binary").alias("text")
    texts = docs.select(of, body)
    drawn = F.pmod(F.xxhash64(F.lit("phrases"), quoted(key)), F.lit(1 << 20)) < int(share * (1 << 20))
    counts = frequent(texts, docs.where(drawn).select(of, body), support, share)
    total = counts.where("len = 0").select("lang", F.col("a").alias("n"))
    found = maximal(stored(scored(counts), "phrase-scores"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.join(total, "lang").select("lang", "rank", "phrase", F.col("a"), "l", "r", "n", "score")
