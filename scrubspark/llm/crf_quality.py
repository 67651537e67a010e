"""Quality classifier: a linear-chain conditional random field over the lines of a text.

Every line is labelled good or bad.  A line's features are shares of character classes, its length, whether
it repeats in the text and how many of its words differ, joined with those of the lines before and after.
Forward-backward gives each line's chance of being good; the document's score is their mean weighted by line
length, made a probability by a logistic curve fitted to the training documents.

Training takes at most about ``SAMPLE_DOCS`` labelled documents (rows, equal ones once) of at most ``SAMPLE_LINES``
lines, ``TOTAL_LINES`` together, about 100 MB on the driver (all lines of a document carry its label, in chains of
``CHAIN`` lines); scoring covers every whole text where it lies.

Defined cases: NULL or empty text is one empty line; without usable labels, or with one class, every score is
the share of good labels (0.5 without any); repeated rows score alike; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scrubspark.llm.common import labelled_sample, map_texts, thinned, training_rows

SAMPLE_DOCS, SAMPLE_LINES, TOTAL_LINES, CHAIN, STEPS = 2500, 2000, 300_000, 48, 120
#: Character classes: white space, lower-case or other letter, upper case, digit, symbol of junk, ! and ?, the rest.
CLASSES = 7
N_LINE = CLASSES - 1 + 4


@lru_cache(maxsize=1)
def class_table() -> np.ndarray:
    """Class of each code point."""
    t = np.full(0x110000, 6, np.uint8)
    for c in range(0x30000):
        cat = unicodedata.category(chr(c))
        t[c] = 2 if cat in ("Lu", "Lt") else 1 if cat[0] in "LM" else 3 if cat[0] == "N" else 0 if cat[0] == "Z" else 6
    t[[9, 10, 11, 12, 13]] = 0
    for c in "#*$%&|<>":
        t[ord(c)] = 4
    for c in "!?":
        t[ord(c)] = 5
    return t


def line_features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features of every line, length of every line, number of lines of each text)."""
    split = [t.split("\n") for t in texts]
    lines = np.array([len(s) for s in split])
    flat = [x for s in split for x in s]
    size = np.array([len(x) for x in flat])
    code = np.frombuffer("".join(flat).encode("utf-32-le", "surrogatepass"), np.uint32)
    of = np.repeat(np.arange(len(flat)), size)
    count = np.bincount(of * CLASSES + class_table()[code], minlength=len(flat) * CLASSES).reshape(-1, CLASSES)
    x = np.empty((len(flat), N_LINE))
    x[:, :CLASSES - 1] = count[:, 1:] / np.maximum(size, 1)[:, None]
    x[:, CLASSES - 1] = np.log1p(size) / 8
    at = 0
    for s in split:
        seen: dict[str, int] = {}
        for line in s:
            seen[line] = seen.get(line, 0) + 1
        for line in s:
            words = line.split()
            x[at, CLASSES:] = (seen[line] > 1 and bool(words), len(set(words)) / len(words) if words else 1.0,
                               min(len(line) / (8 * len(words)), 2.0) if words else 0.0)
            at += 1
    return x, size, lines


def with_neighbours(x: np.ndarray, lines: np.ndarray) -> np.ndarray:
    """Features of the line, of the line before and of the line after (zero at the ends), and a constant."""
    start = np.r_[0, np.cumsum(lines)[:-1]]
    before, after = np.zeros_like(x), np.zeros_like(x)
    before[1:], after[:-1] = x[:-1], x[1:]
    before[start] = 0
    after[start + lines - 1] = 0
    return np.c_[x, before, after, np.ones(len(x))]


def _layout(lines: np.ndarray):
    """Chains sorted by length (longest first) and, for each position, the rows of the chains that reach it."""
    order = np.argsort(-lines, kind="stable")
    start = np.r_[0, np.cumsum(lines)[:-1]][order]
    reach = np.searchsorted(-lines[order], -np.arange(1, lines.max() + 1), side="right")
    return start, reach


def forward_backward(u: np.ndarray, move: np.ndarray, lines: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log odds of a good line from the lines up to it and from the lines after it.

    ``u``: log odds of each line alone; ``move[a, b]``: log weight of label b after label a.
    """
    start, reach = _layout(lines)
    ahead, back = np.empty(len(u)), np.zeros(len(u))
    ahead[start] = u[start]
    for t in range(1, len(reach)):
        rows = start[:reach[t]] + t
        r = ahead[rows - 1]
        ahead[rows] = u[rows] + np.logaddexp(move[0, 1], r + move[1, 1]) - np.logaddexp(move[0, 0], r + move[1, 0])
    for t in range(len(reach) - 1, 0, -1):
        rows = start[:reach[t]] + t
        r = u[rows] + back[rows]
        back[rows - 1] = np.logaddexp(move[1, 0], move[1, 1] + r) - np.logaddexp(move[0, 0], move[0, 1] + r)
    return ahead, back


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def train(x: np.ndarray, lines: np.ndarray, y: np.ndarray, steps: int = STEPS) -> tuple[np.ndarray, np.ndarray]:
    """Weights of the line features and of the label moves: likelihood ascent with adaptive steps.

    ``x`` has neighbours already; ``y`` is the label of each chain, which all its lines carry.
    """
    label = np.repeat(y, lines).astype(float)
    chain_weight = np.where(y == 1, 0.5 / max((y == 1).mean(), 1e-9), 0.5 / max((y == 0).mean(), 1e-9))
    weight = np.repeat(chain_weight, lines)
    first = np.zeros(len(x), bool)
    first[np.r_[0, np.cumsum(lines)[:-1]]] = True
    later = np.flatnonzero(~first)
    w, move = np.zeros(x.shape[1]), np.zeros((2, 2))
    sw, sm = np.full_like(w, 1e-8), np.full_like(move, 1e-8)
    for _ in range(steps):
        u = x @ w
        ahead, back = forward_backward(u, move, lines)
        p = _sigmoid(ahead + back)
        gw = x.T @ (weight * (label - p)) / weight.sum() - 1e-3 * w
        # Expected moves between a line and the one before it.
        r, s = ahead[later - 1], u[later] + back[later]
        z = np.stack([np.zeros_like(r) + move[0, 0], s + move[0, 1], r + move[1, 0], r + s + move[1, 1]])
        z = np.exp(z - z.max(axis=0))
        z *= weight[later] / z.sum(axis=0)
        seen = np.array([[(weight[later] * (label[later] == 0)).sum(), 0], [0, (weight[later] * (label[later] == 1)).sum()]])
        gm = (seen - z.sum(axis=1).reshape(2, 2)) / weight.sum() - 1e-2 * move
        sw += gw * gw
        sm += gm * gm
        w += 0.6 * gw / np.sqrt(sw)
        move += 0.3 * gm / np.sqrt(sm)
    return w, move


def good_share(texts: list[str], w: np.ndarray, move: np.ndarray) -> np.ndarray:
    """Mean chance of a good line, weighted by line length, for each text."""
    x, size, lines = line_features(texts)
    ahead, back = forward_backward(with_neighbours(x, lines) @ w, move, lines)
    start = np.r_[0, np.cumsum(lines)[:-1]]
    weight = size + 1.0
    return np.add.reduceat(weight * _sigmoid(ahead + back), start) / np.add.reduceat(weight, start)


def _log_odds(p):
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


def curve(share: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Logistic curve from the log odds of the share of good lines to the label."""
    z, a, b = _log_odds(share), 1.0, 0.0
    for _ in range(50):
        p = _sigmoid(a * z + b)
        g = np.array([((y - p) * z).sum() - 0.1 * (a - 1), (y - p).sum() - 0.1 * b])
        v = p * (1 - p)
        h = np.array([[(v * z * z).sum() + 0.1, (v * z).sum()], [(v * z).sum(), v.sum() + 0.1]])
        a, b = np.array([a, b]) + np.linalg.solve(h, g)
    return max(float(a), 0.05), float(b)


def held_out_rows(doc_id: Column, modulus: int, remainder: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``, is ``remainder``; false for a NULL id."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % modulus == remainder, F.lit(False))


def scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, modulus: int = 4, remainder: int = 2) -> DataFrame:
    """(doc_id, held_out, score, predicted), one row per row of ``docs``; held-out labels are never learned."""
    sample = labelled_sample(labels, "quality", SAMPLE_DOCS, held_out_rows(F.col("doc_id"), modulus, remainder))
    text = F.coalesce("text", F.lit(""))
    lines = F.length(text) - F.length(F.replace(text, F.lit("\n"))) + 1
    rows = thinned(training_rows(docs, sample, SAMPLE_DOCS).where(lines <= SAMPLE_LINES), lines, TOTAL_LINES)

    def measure(texts):
        x, size, lines = line_features(texts)
        cut = np.cumsum(lines)[:-1]
        return {"x": [m.astype("<f4").tobytes() for m in np.split(x, cut)],
                "size": [s.astype("<i4").tobytes() for s in np.split(size, cut)]}

    got = map_texts(rows, ["doc_id", "y"], "text", measure, "x binary, size binary").orderBy("doc_id", "size", "x").collect()
    y = np.array([r["y"] for r in got])
    if len(got) and 0 < y.mean() < 1:
        each = [np.frombuffer(r["x"], "<f4").reshape(-1, N_LINE).astype(float) for r in got]
        whole = np.array([len(m) for m in each])
        full = with_neighbours(np.concatenate(each), whole)
        cut = [np.array([CHAIN] * (n // CHAIN) + [n % CHAIN] * int(n % CHAIN > 0)) for n in whole.tolist()]
        w, move = train(full, np.concatenate(cut), np.repeat(y, [len(c) for c in cut]))
        ahead, back = forward_backward(full @ w, move, whole)
        size = np.concatenate([np.frombuffer(r["size"], "<i4") for r in got]) + 1.0
        start = np.r_[0, np.cumsum(whole)[:-1]]
        share = np.add.reduceat(size * _sigmoid(ahead + back), start) / np.add.reduceat(size, start)
        a, b = curve(share, y)

        def score(texts):
            return {"score": _sigmoid(a * _log_odds(good_share(texts, w, move)) + b)}
    else:
        flat = float(y.mean()) if len(got) else 0.5

        def score(texts):
            return {"score": [flat] * len(texts)}

    out = map_texts(docs.select("doc_id", "text"), ["doc_id"], "text", score, "score double")
    return out.select("doc_id", held_out_rows(F.col("doc_id"), modulus, remainder).alias("held_out"), "score",
                      (F.col("score") >= threshold).cast("int").alias("predicted"))
