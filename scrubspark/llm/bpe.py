"""Byte-level BPE of whole texts by overlapping chunks, and decoding.

A text longer than ``CHUNK`` characters becomes chunks that overlap by ``OVERLAP``; the chunks are dealt
over the cluster and pre-tokenised on their own.  Between a character that is not white space and a
space or line feed every pre-tokenisation has a boundary, wherever it began, so neighbours resynchronise
at the first such boundary in their overlap: the left chunk ends there and the right one starts there.
Where an overlap has none (text without spaces), both chunks' pre-tokens are compared, and they meet at the first
boundary that both have.  Only a text with no common boundary in some overlap (one run of letters, digits
out of step) is encoded in one piece, exactly.  Shorter texts are a single chunk and stay in the task that reads
them.  Copies of a long text are encoded once.

Inside a chunk the pieces between such boundaries repeat often, so each distinct piece is encoded by the
rank file once per worker (a bounded memo) and the ids are joined.  Decoding joins the bytes of the ids.

Defined cases: NULL is the empty text (no ids, hash of no bytes); repeated rows keep their rows; an empty
table gives an empty result; strings of special tokens are ordinary text; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scrubspark.llm.common import map_texts, stored

#: Characters of a chunk and of the overlap with the next; pieces a worker remembers.
CHUNK, OVERLAP, MEMO = 1 << 15, 1 << 10, 400_000
#: Copies of a long text that one task writes; texts without a common boundary whose keys (40 bytes) are broadcast.
COPIES, BROADCAST_APART = 1000, 100_000

#: A boundary of every pre-tokenisation: after a character that is no white space, before a space or line feed.
SAFE = re.compile(r"(?<=\S)(?=[ \n])")
BLANK_THEN_SPACE = re.compile(r"\s |\x00")
FIELDS = "n_tokens long, ids_sha256 string, decoded_sha256 string"


class Codec:
    """Ids of texts by one rank file, each distinct piece encoded once while the memo holds it."""

    def __init__(self, ranks: str, pattern: str, memo: int = MEMO):
        import tiktoken
        with open(ranks, "rb") as f:
            table = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={})
        self.bytes = [b""] * (max(table.values()) + 1)
        for piece, i in table.items():
            self.bytes[i] = piece
        self.pattern = regex.compile(pattern)
        self.limit = memo
        encode = self.encoding.encode_ordinary

        class Memo(dict):
            def __missing__(self, piece):
                ids = np.array(encode(piece), "<u4").tobytes()
                if len(piece) < 64:
                    self[piece] = ids
                return ids
        self.memo = Memo()

    def encode(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        if len(self.memo) > self.limit:
            self.memo.clear()
        if BLANK_THEN_SPACE.search(text):
            pieces = SAFE.split(text)
        else:
            pieces = text.replace(" ", "\x00 ").split("\x00")
        return b"".join(map(self.memo.__getitem__, pieces))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes.__getitem__, np.frombuffer(ids, "<u4").tolist()))

    def digests(self, ids: bytes) -> tuple:
        return len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(self.decode(ids)).hexdigest()


@lru_cache(maxsize=2)
def codec(ranks: str, pattern: str) -> Codec:
    return Codec(ranks, pattern)


def chunks(docs: DataFrame, keys: list[str], size: int, overlap: int) -> DataFrame:
    """``keys``, ``k``, ``piece`` and ``copies``: overlapping chunks of texts longer than ``size``, dealt by key and number.

    The chunks of equal rows are one row each, with their number: copies meet before the shuffle.
    """
    # A chunk that reaches the text's end is the last.
    last = F.greatest(F.ceil((F.length("text") - overlap) / size).cast("int") - 1, F.lit(0))
    return docs.where(F.length("text") > size).select(
        *keys, "text", F.explode(F.sequence(F.lit(0), last)).alias("k")).select(
        *keys, "k", F.expr(f"substring(text, k * {size} + 1, {size + overlap})").alias("piece")).groupBy(
        *keys, "k", "piece").agg(F.count(F.lit(1)).alias("copies"))


def marks(c: Codec, t: str, size: int, overlap: int) -> tuple[list, list, list, list, bytes]:
    """Where a chunk may be joined: offsets in its first ``overlap`` characters and, from ``size`` on, in its last, each with the
    bytes of ids before it; and the ids.

    Where an overlap has a boundary of every pre-tokenisation, that is its only mark.  Otherwise all boundaries of
    the chunk's own pre-tokenisation are: it depends on nothing before them, so neighbours that share one go on alike.
    One whose next pre-token reaches the chunk's end is left out, as that end may have made it.
    """
    n = len(t)
    head, tail = SAFE.search(t, 1, min(overlap, n)), SAFE.search(t, size + 1, n)
    if head and (tail or n <= size):
        a = c.encode(t[:head.start()])
        rest = c.encode(t[head.start():tail.start()] if tail else t[head.start():])
        end = c.encode(t[tail.start():]) if tail else b""
        return [head.start()], [len(a)], [tail.start() - size] if tail else [], [len(a) + len(rest)] if tail else [], a + rest + end
    at, before, ids, done = [], [], [], 0
    for m in c.pattern.finditer(t):
        if m.start() != (at[-1][1] if at else 0):
            return [], [], [], [], b""
        at.append(m.span())
        before.append(done)
        ids.append(c.memo[m[0]])
        done += len(ids[-1])
    if not at or at[-1][1] != n:
        return [], [], [], [], b""
    first = [(p, b) for (p, _), b in zip(at, before) if 0 < p < min(overlap, n) and (not head or p == head.start())]
    last = [(p - size, b) for (p, end), b in zip(at, before) if size < p and (p == tail.start() if tail else end < n)]
    return [p for p, _ in first], [b for _, b in first], [p for p, _ in last], [b for _, b in last], b"".join(ids)


MARKS = ("head_at", "head_ids", "tail_at", "tail_ids")


def _chunk_ids(ranks: str, pattern: str, size: int, overlap: int):
    def run(texts):
        c = codec(ranks, pattern)
        return dict(zip((*MARKS, "ids"), zip(*[marks(c, t, size, overlap) for t in texts])))
    return run


def joined(chunks: list[tuple]) -> bytes | None:
    """The ids of a text from the ``marks`` of its chunks in order; None where two neighbours share no boundary."""
    out, start = [], 0
    for i, (_, _, tail_at, tail_ids, ids) in enumerate(chunks):
        end, after = len(ids), 0
        if i + 1 < len(chunks):
            right = dict(zip(*chunks[i + 1][:2]))
            met = next(((b, right[p]) for p, b in zip(tail_at, tail_ids) if p in right), None)
            if met is None:
                return None
            end, after = met
        out.append(ids[start:end])
        start = after
    return b"".join(out)


def _stitch(ranks: str, pattern: str, names: list[str]):
    def run(table: pa.Table) -> pa.Table:
        c = codec(ranks, pattern)
        t = table.sort_by("k")
        ids = joined(list(zip(*[t.column(x).to_pylist() for x in (*MARKS, "ids")])))
        n, a, b = c.digests(ids or b"")
        new = {"met": pa.array([ids is not None]), "n_tokens": pa.array([n]), "ids_sha256": pa.array([a]),
               "decoded_sha256": pa.array([b]), "ids": pa.array([ids or b""], pa.binary())}
        return pa.table({x: new.get(x, t.column(x).slice(0, 1) if x in t.column_names else None) for x in names})
    return run


def encoded(docs: DataFrame, ranks: str, pattern: str, keep_ids: bool = False,
            chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256[, ids]), one row per row of ``docs``.

    ``ranks`` is the path of the rank file on every machine, ``ids`` little-endian unsigned 32-bit.
    """
    fields = FIELDS + (", ids binary" if keep_ids else "")

    def whole(texts):
        c = codec(ranks, pattern)
        ids = [c.encode(t) for t in texts]
        n, a, b = zip(*[c.digests(x) for x in ids])
        return {"n_tokens": n, "ids_sha256": a, "decoded_sha256": b, "ids": ids}

    # A key of its own text keeps two long texts with one doc_id apart.
    keys = ["doc_id", "key"]
    d = docs.select("doc_id", "text")
    short = map_texts(d.where(F.coalesce(F.length("text"), F.lit(0)) <= chunk), ["doc_id"], "text", whole, fields)
    d = d.where(F.length("text") > chunk).withColumn("key", F.md5("text"))
    parts = map_texts(chunks(d, keys, chunk, overlap), [*keys, "k", "copies"], "piece", _chunk_ids(ranks, pattern, chunk, overlap),
                      ", ".join(f"{m} array<int>" for m in MARKS) + ", ids binary")
    # Copies past ``COPIES`` are made by other tasks.
    parts = parts.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(copies - 1) div {COPIES}"))).alias("salt"))
    names = T.StructType([*[parts.schema[x] for x in (*keys, "copies", "salt")], *T.StructType.fromDDL("met boolean, " + fields).fields])
    long_ = stored(parts.groupBy(*keys, "salt").applyInArrow(_stitch(ranks, pattern, names.names), names), "long-texts")
    each = F.explode(F.sequence(F.lit(1).cast("long"), F.least(F.lit(COPIES), F.col("copies") - F.col("salt") * COPIES)))
    out = short.unionByName(long_.where("met").select(*short.columns, each.alias("copy")).drop("copy"))
    apart = long_.where("not met").select(F.col("doc_id").alias("id"), F.col("key").alias("print")).distinct()
    n_apart = apart.count()
    if n_apart:
        # No common boundary, as in a run of one letter: the text is a piece.
        apart = F.broadcast(apart) if n_apart <= BROADCAST_APART else apart
        rest = d.join(apart, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("key") == F.col("print")), "left_semi")
        out = out.unionByName(map_texts(rest, ["doc_id"], "text", whole, fields))
    return out
