"""Token ids of documents in Huffman-coded files.

Ids are counted over all documents; a canonical Huffman code with words of at most ``LIMIT`` bits is built by
package-merge.  Documents are range-partitioned and sorted by doc_id; each partition writes one Parquet file
of blocks.  A block holds the ids of whole documents as one bit string, with the bit offset of every
``EVERY``-th id, the documents' ids and lengths, and the number of ids before it in its file, so blocks are
read on their own, and inside a block every checkpoint starts a lane that is decoded by table look-up in step
with the others.  The code (id, length) is a Parquet table beside the blocks.

Files are written by Spark's committer into the shared folder: a lost task leaves nothing half-written.

Defined cases: NULL is the empty text (only the end id); a NULL doc_id comes first; repeated rows are all
written, side by side; an empty table writes no blocks and reads back empty; strings of special tokens are
ordinary text; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import window as W

from scrubspark.llm.common import map_texts, stored

#: Longest code word, ids between checkpoints, ids of a block (or one document), words a worker remembers.
LIMIT, EVERY, BLOCK, MEMO = 18, 256, 1 << 15, 300_000
END = 1

# Unicode's white space; Python's own split would also cut at four control characters.
SPACES = re.compile(r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
CONTROLS = re.compile("[\x1c-\x1f]")
#: A word whose normal form is its lower case, split into letters and marks as the tokenizer does.
PLAIN = re.compile("([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,;:!?|#%&*$]*)")


class Words:
    """Ids of texts by a tokenizers file that drops white space: each distinct word is encoded once.

    Neither normalisation nor merges cross white space, so a text's ids are its words' ids joined.  Two generations
    of words are remembered: a full one becomes the older, from which words come back when they are met again.
    """

    def __init__(self, path: str, memo: int = MEMO):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel
        tokenizer = Tokenizer.from_file(path)
        tokenizer.encode_special_tokens = True
        self.kind = "<u2" if tokenizer.get_vocab_size() <= 1 << 16 else "<u4"
        self.limit, kind = memo, self.kind

        class Memo(dict):
            def __init__(self, encode):
                self.encode, self.older = encode, {}

            def __missing__(self, word):
                ids = self.older.get(word)
                if ids is None:
                    ids = self.encode(word)
                    if len(word) >= 64:
                        return ids
                self[word] = ids
                return ids

            def turn(self):
                self.older = dict(self)
                self.clear()

        def whole(word):
            return np.array(tokenizer.encode(word, add_special_tokens=False).ids, kind).tobytes()

        # Letters and marks of PLAIN are their own normal form, so the library's merges are asked directly,
        # in the characters that its byte-level step writes for them.
        written = ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
        alphabet = {ord(c): written(c)[0][0] for c in map(chr, range(33, 256)) if PLAIN.fullmatch("a" + c) or c.islower()}
        merge, code = tokenizer.model.tokenize, kind[1:].replace("u2", "H").replace("u4", "I")

        def merged(part):
            return array(code, [t.id for t in merge(part if part.isascii() else part.translate(alphabet))]).tobytes()

        parts = self.parts = Memo(merged)

        def word(w):
            m = PLAIN.fullmatch(w)
            if not m:
                return whole(w)
            letters, marks = m.groups()
            return parts[letters.lower()] + parts[marks] if marks else parts[letters.lower()]

        self.words = Memo(word)
        self.end = np.array([END], kind).tobytes()

    def encode(self, text: str) -> bytes:
        for memo in (self.words, self.parts):
            if len(memo) > self.limit:
                memo.turn()
        words = SPACES.split(text) if CONTROLS.search(text) else text.split()
        return b"".join(map(self.words.__getitem__, filter(None, words)))


@lru_cache(maxsize=2)
def words_of(path: str) -> Words:
    return Words(path)


def tokens(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids): ids of each document with the end id, as little-endian integers of 16 or 32 bits."""
    def run(texts):
        w = words_of(path)
        return {"ids": [w.encode(t) + w.end for t in texts]}
    return map_texts(docs.select("doc_id", "text"), ["doc_id"], "text", run, "ids binary")


def code_lengths(weights: np.ndarray, limit: int) -> np.ndarray:
    """Lengths of an optimal prefix code with words of at most ``limit`` bits, by package-merge.

    ``weights`` are positive.  Level by level, pairs of the cheapest items become packages that are merged
    with the symbols again; a symbol's length is the number of levels at which it is among those taken.
    """
    n = len(weights)
    if n == 1:
        return np.array([1])
    if n > 1 << limit:
        raise ValueError(f"{n} symbols need more than {limit} bits")
    order = np.argsort(weights, kind="stable")
    w = weights[order].astype(np.int64)
    levels, cur = [np.ones(n, bool)], w
    for _ in range(limit - 1):
        pairs = cur[0:len(cur) // 2 * 2:2] + cur[1::2]
        both = np.concatenate([w, pairs])
        by = np.argsort(both, kind="stable")
        levels.append(by < n)
        cur = both[by]
    lengths, take = np.zeros(n, np.int64), 2 * n - 2
    for symbol in reversed(levels):
        own = int(symbol[:take].sum())
        lengths[order[:own]] += 1
        take = 2 * (take - own)
    return lengths


class Code:
    """The canonical code of (ids, lengths): words by length, then id."""

    def __init__(self, ids: np.ndarray, lengths: np.ndarray):
        order = np.lexsort((ids, lengths))
        ids, lengths = ids[order], lengths[order]
        self.top = int(lengths[-1]) if len(ids) else 1
        # In units of the shortest step, each word starts where the one before it ended.
        span = np.int64(1) << (self.top - lengths)
        first = np.cumsum(span) - span
        self.word = np.zeros(int(ids.max()) + 1 if len(ids) else 1, np.uint64)
        self.size = np.zeros(len(self.word), np.int64)
        self.word[ids] = first >> (self.top - lengths)
        self.size[ids] = lengths
        # Any ``top`` bits tell the id they begin with and its length.
        self.id_at = np.repeat(ids, span).astype(np.uint32)
        self.size_at = np.repeat(lengths, span).astype(np.uint8)
        gap = (1 << self.top) - len(self.id_at)
        self.id_at, self.size_at = np.r_[self.id_at, np.zeros(gap, np.uint32)], np.r_[self.size_at, np.ones(gap, np.uint8)]

    def encode(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """(bits, bit offset of every EVERY-th id)."""
        size = self.size[ids]
        end = np.cumsum(size)
        at = end - size
        value = self.word[ids] << (64 - size - (at & 31)).astype(np.uint64)
        place, n = at >> 5, (int(end[-1]) >> 5) + 2
        # Bits never overlap, so sums are unions; both halves are exact in a double.
        words = np.bincount(place, (value >> np.uint64(32)).astype(float), n)
        words += np.bincount(place + 1, (value & np.uint64(0xFFFFFFFF)).astype(float), n)
        return words.astype(np.uint32).astype(">u4").tobytes()[:(int(end[-1]) + 7) // 8], at[::EVERY]

    def decode(self, blocks: list[tuple[bytes, np.ndarray, int]]) -> list[np.ndarray]:
        """Ids of blocks (bits, checkpoints, number of ids): all lanes advance one id a step."""
        base = np.cumsum([0] + [len(b) for b, _, _ in blocks])[:-1]
        raw = np.frombuffer(b"".join(b for b, _, _ in blocks) + bytes(8), np.uint8).astype(np.uint32)
        window = raw[:-3] << 24 | raw[1:-2] << 16 | raw[2:-1] << 8 | raw[3:]
        at = np.concatenate([c.astype(np.int64) + 8 * o for (_, c, _), o in zip(blocks, base)])
        count = np.concatenate([np.minimum(EVERY, n - EVERY * np.arange(len(c))) for _, c, n in blocks])
        out = np.zeros((len(at), EVERY), np.uint32)
        live = np.argsort(-count, kind="stable")
        for step in range(int(count.max(initial=0))):
            live = live[:np.searchsorted(-count[live], -step, "left")]
            p = at[live]
            seen = window[p >> 3] >> (32 - self.top - (p & 7)).astype(np.uint32) & np.uint32((1 << self.top) - 1)
            out[live, step] = self.id_at[seen]
            at[live] = p + self.size_at[seen]
        found, lane = [], 0
        for _, c, n in blocks:
            found.append(out[lane:lane + len(c)].reshape(-1)[:n])
            lane += len(c)
        return found


def count_ids(tok: DataFrame, kind: str) -> DataFrame:
    """(id, n) over all documents; each task sends an id once."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            for ids in batch.column(0):
                one = np.bincount(np.frombuffer(ids.as_buffer(), kind))
                if len(one) > len(total):
                    total = np.r_[total, np.zeros(len(one) - len(total), np.int64)]
                total[:len(one)] += one
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["id", "n"])
    return tok.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def _blocks(code: Code, kind: str, id_type: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, first = TaskContext.get().partitionId(), 0, 0
        ids, held, size = [], [], 0

        def block():
            nonlocal number, first, ids, held, size
            flat = np.frombuffer(b"".join(held), kind)
            bits, points = code.encode(flat)
            row = [[part], [number], [first], [len(flat)], [bits], [points.astype("<i8").tobytes()], [ids],
                   [[len(h) // np.dtype(kind).itemsize for h in held]]]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.list_(id_type),
                     pa.list_(pa.int64())]
            number, first = number + 1, first + len(flat)
            ids, held, size = [], [], 0
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row, kinds)],
                                              ["part", "block", "first", "n", "bits", "points", "doc_ids", "sizes"])

        for batch in batches:
            for doc, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids.append(doc)
                held.append(x)
                size += len(x)
                if size >= BLOCK * np.dtype(kind).itemsize:
                    yield block()
        if held:
            yield block()
    return run


def write(docs: DataFrame, path: str) -> tuple[DataFrame, DataFrame]:
    """Write the files of ``docs``; returns (blocks, code) as read from the shared folder."""
    kind = Words(path, 0).kind
    tok = tokens(docs, path).withColumns({"at": F.monotonically_increasing_id(), "h": F.xxhash64("ids")})
    tok = stored(tok, "tokens")
    counts = count_ids(tok, kind).orderBy("id").collect()  # at most one row per id of the vocabulary
    ids = np.array([r["id"] for r in counts], np.int64)
    lengths = code_lengths(np.array([r["n"] for r in counts], np.int64), LIMIT) if counts else np.zeros(0, np.int64)
    spark = docs.sparkSession
    code = stored(spark.createDataFrame(list(zip(ids.tolist(), lengths.tolist())), "id long, length long"), "code")
    # The scan position keeps equal keys apart: a hot doc_id spreads over ranges.
    dealt = tok.repartitionByRange("doc_id", "h", "at").sortWithinPartitions("doc_id", "h", "at")
    doc_type = tok.schema["doc_id"].dataType
    schema = T.StructType([
        T.StructField("part", T.IntegerType()), T.StructField("block", T.IntegerType()),
        T.StructField("first", T.LongType()), T.StructField("n", T.LongType()),
        T.StructField("bits", T.BinaryType()), T.StructField("points", T.BinaryType()),
        T.StructField("doc_ids", T.ArrayType(doc_type)), T.StructField("sizes", T.ArrayType(T.LongType()))])
    from pyspark.sql.pandas.types import to_arrow_type
    blocks = dealt.select("doc_id", "ids").mapInArrow(_blocks(Code(ids, lengths), kind, to_arrow_type(doc_type)), schema)
    return stored(blocks, "token-files"), code


def read(blocks: DataFrame, code: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32[, order columns part, at]) of the documents in the files."""
    table = code.orderBy("id").collect()
    coder = Code(np.array([r["id"] for r in table], np.int64), np.array([r["length"] for r in table], np.int64))
    doc_type = blocks.schema["doc_ids"].dataType.elementType
    schema = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("doc_id", doc_type),
                           T.StructField("at", T.LongType()), T.StructField("n_tokens", T.LongType()),
                           T.StructField("ids_crc32", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema
        arrow = to_arrow_schema(schema)
        for batch in batches:
            rows = batch.to_pylist()
            for k in range(0, len(rows), 32):
                some = rows[k:k + 32]
                out = []
                for r, ids in zip(some, coder.decode([(r["bits"], np.frombuffer(r["points"], "<i8"), r["n"]) for r in some])):
                    flat, at = ids.astype("<u4").tobytes(), 0
                    for doc, n in zip(r["doc_ids"], r["sizes"]):
                        out.append((r["part"], doc, r["first"] + at, n, zlib.crc32(flat[4 * at:4 * (at + n)])))
                        at += n
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), arrow)], schema=arrow)

    docs = blocks.select("part", "first", "n", "bits", "points", "doc_ids", "sizes").mapInArrow(run, schema)
    # One row per file: its ids and those of the files before it.
    before = blocks.groupBy("part").agg(F.sum("n").alias("all")).withColumn("before", F.coalesce(F.sum("all").over(
        W.Window.orderBy("part").rowsBetween(W.Window.unboundedPreceding, -1)), F.lit(0))).drop("all")
    return docs.join(before, "part").select("doc_id", (F.col("at") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")
