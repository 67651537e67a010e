"""Toxicity by fuzzy lexicon matching and context windows.

The lexicon is learned: words and word beginnings (stems) that labelled toxic documents use at a far higher
rate than others, which may use or quote them too.  Its trie is intersected with Levenshtein automata (one edit for words of 5 to 9 letters, two for
longer, none for shorter words and stems) into one deterministic table, built once on the driver and
bounded by ``LEXICON`` terms.  Every word of every text runs through the table; nearly all die after two
or three letters.  A hit is judged by its place: quotation marks at it or around its passage, however long, or
reporting words before it speak for quotation, address of a person for abuse.  A logistic model of the hits' counts scores a text;
hits of stems, which clean texts have singly, are counted apart from those of words.

Training takes at most about ``SAMPLE_DOCS`` labelled documents (rows, equal ones once); scoring covers every whole text.

Defined cases: NULL or empty text has no hits and scores as such; without usable labels, or with one class,
every score is the share of toxic labels (0 without any); repeated rows score alike; an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scrubspark.llm.common import labelled_sample, map_texts, stored, training_rows
from scrubspark.llm.crf_quality import held_out_rows

#: Labelled documents to learn from, terms of the lexicon, least documents of a term and its precision.
SAMPLE_DOCS, LEXICON, LEAST_DOCS, PRECISION = 10_000, 256, 4, 0.9
#: Lengths of stems, different words a stem must have.
STEMS, STEM_WORDS = (4, 5, 6), 6
WINDOW = 40
DEAD = 0

QUOTES = "\"'“”„«»‘’`"
#: Quotation marks by family, those that only open or only close, and what ends an open quotation.
FAMILY = {c: k for k, f in enumerate(['"', "'", "`", "“”„", "‘’", "«»"]) for c in f}
OPEN_ONLY, CLOSE_ONLY = "„‘", "”’"
MARK = re.compile(r"[\"'`“”„‘’«»]|\n[ \t]*\n")
REPORT = re.compile(r"\b(?:said|says|called|wrote|quote|quoted|word|term|sagte|nannte|wort|dit|appel\w*|mot|dijo|llam\w*|palabra)\b[^.!?]*$")
ADDRESS = re.compile(r"\b(?:you|your|you're|du|dich|ihr|euch|sie|tu|te|vous|toi|usted|ustedes|tú)\b")


def edits(term: str) -> int:
    return 0 if len(term) < 5 else 1 if len(term) < 10 else 2


class Automaton:
    """The lexicon's trie intersected with Levenshtein automata, as a table state x letter class.

    A state is a set of (trie node, edits used).  ``hit`` is 1 + the least edits of a term that ends in the
    state, 0 if none; a stem, once read, stays a hit whatever follows.
    """

    def __init__(self, words: list[str], stems: list[str]):
        letters = sorted({c for w in [*words, *stems] for c in w})
        self.letters = {c: i + 1 for i, c in enumerate(letters)}
        kids, allowed, ends, stem = [{}], [0], [None], [False]
        for term, is_stem in [(w, False) for w in words] + [(s, True) for s in stems]:
            node, k = 0, 0 if is_stem else edits(term)
            allowed[0] = max(allowed[0], k)
            for c in term:
                if c not in kids[node]:
                    kids[node][c] = len(kids)
                    kids.append({}), allowed.append(0), ends.append(None), stem.append(False)
                node = kids[node][c]
                allowed[node] = max(allowed[node], k)
            ends[node] = max(k, ends[node] or 0)
            stem[node] = stem[node] or is_stem

        def close(pairs):
            """With letters of the term left out; of equal nodes only the fewest edits."""
            best, todo = {}, list(pairs)
            while todo:
                node, e = todo.pop()
                if e > allowed[node] or best.get(node, 99) <= e:
                    continue
                best[node] = e
                todo.extend((kid, e + 1) for kid in kids[node].values())
            if any(stem[n] and e == 0 for n, e in best.items()):
                return "stem"
            return frozenset(best.items())

        start = close([(0, 0)])
        number, order = {frozenset(): DEAD, start: 1}, [frozenset(), start]
        rows = []
        for state in order:
            row = []
            for c in [None, *letters]:
                if state == "stem":
                    nxt = "stem"
                else:
                    nxt = close([p for n, e in state for p in [(n, e + 1)] + [
                        (kid, e if c == k else e + 1) for k, kid in kids[n].items()]]) if state else state
                if nxt not in number:
                    number[nxt] = len(order)
                    order.append(nxt)
                row.append(number[nxt])
            rows.append(row)
        self.table = np.array(rows, np.int32)
        self.hit = np.array([1 if s == "stem" else 1 + min([e for n, e in s if ends[n] is not None and e <= ends[n]],
                                                           default=-1) for s in order], np.int8)
        self.whole = np.array([s == "stem" for s in order])
        below = stem[:]
        for node, k in enumerate(kids):
            for kid in k.values():
                below[kid] |= below[node]
        # Stems, and misspelt words that begin with one.
        self.stem = np.array([s == "stem" or any(below[n] and ends[n] is not None and e <= ends[n] and e + 1 == h for n, e in s)
                              for s, h in zip(order, self.hit)])

    def words(self, code: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """``hit`` of each word code[start:start + size]."""
        return self.hit[self.states(code, start, size)]

    def states(self, code: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Last state of each word, all words a letter at a time.

        A word of any length is done once it is dead or has a stem; no other state outlives the longest term.
        """
        classes = np.zeros(0x110000, np.int32)
        for c, i in self.letters.items():
            classes[ord(c)] = i
        out = np.full(len(start), DEAD, np.int32)
        live = np.flatnonzero(size > 0)
        state = np.ones(len(live), np.int32)
        step = 0
        while len(live):
            state = self.table[state, classes[code[start[live] + step]]]
            step += 1
            done = (size[live] == step) | self.whole[state]
            out[live[done]] = state[done]
            keep = ~done & (state != DEAD)
            live, state = live[keep], state[keep]
        return out


@lru_cache(maxsize=1)
def word_characters() -> np.ndarray:
    """Whether each code point is part of a word."""
    return np.array([chr(c).isalnum() for c in range(0x30000)] + [False] * (0x110000 - 0x30000))


def word_bounds(code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    inside = np.r_[False, word_characters()[code], False]
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    return edge[::2], edge[1::2] - edge[::2]


def quotations(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(starts, furthest end of this or an earlier one) of the quotations of ``text``, sorted, in one pass.

    A mark opens before a word and closes after one, so apostrophes do neither; guillemets may stand apart and
    point either way.  A blank line ends what is open.
    """
    opened, spans = {}, []
    for m in MARK.finditer(text):
        c, at = m[0], m.start()
        if c not in FAMILY:
            opened.clear()
            continue
        before, after = text[at - 1:at] or " ", text[at + 1:at + 2] or " "
        k, guillemet = FAMILY[c], c in "«»"
        first = opened.get(k)
        if first is not None and c not in OPEN_ONLY and (
                text[first] != c if guillemet else not before.isspace() and not after.isalnum()):
            spans.append((opened.pop(k), at))
        elif c not in CLOSE_ONLY and (guillemet or not before.isalnum() and not after.isspace()):
            opened[k] = at
    spans.sort()
    at = np.array(spans, np.int64).reshape(-1, 2)
    return at[:, 0], np.maximum.accumulate(at[:, 1])


#: Counts of a text: direct and quoted hits of words without edits, with edits, hits that address a person, share
#: of direct hits of words; direct and quoted hits of stems, share of direct ones; direct and quoted hits, with
#: edits, of words that begin with a stem.
FEATURES = 11


def features(texts: list[str], auto: Automaton) -> np.ndarray:
    low = [t.lower() for t in texts]
    flat = "\n".join(low) + "\n"
    code = np.frombuffer(flat.encode("utf-32-le", "surrogatepass"), np.uint32)
    start, size = word_bounds(code)
    state = auto.states(code, start, size)
    hit, stem = auto.hit[state], auto.stem[state]
    ends = np.cumsum([len(t) + 1 for t in low])
    n = np.zeros((len(texts), FEATURES))
    last = -1
    for k in np.flatnonzero(hit):
        a, b = int(start[k]), int(start[k] + size[k])
        doc = int(np.searchsorted(ends, a, "right"))
        first = int(ends[doc - 1]) if doc else 0
        if doc != last:
            last, (opens, closes) = doc, quotations(low[doc])
        i = int(np.searchsorted(opens, a - first)) - 1
        left = flat[max(a - WINDOW, first):a]
        right = flat[b:min(b + WINDOW, int(ends[doc]) - 1)]
        quoted = ((left[-1:] in QUOTES and right[:1] in QUOTES and left and right)
                  or (i >= 0 and closes[i] >= b - first) or bool(REPORT.search(left)))
        far = hit[k] > 1
        n[doc, ((9 if far else 6) if stem[k] else 2 if far else 0) + bool(quoted)] += 1
        n[doc, 4] += bool(ADDRESS.search(left) or ADDRESS.search(right))
    words = np.bincount(np.searchsorted(ends, start, "right"), minlength=len(texts))
    n[:, 5] = (n[:, 0] + n[:, 2]) / np.maximum(words, 1) * 10
    n[:, 8] = n[:, 6] / np.maximum(words, 1) * 10
    counts = [0, 1, 2, 3, 4, 6, 7, 9, 10]
    n[:, counts] = np.log1p(n[:, counts])
    return n


def lexicon(rows: DataFrame, toxic: int, clean: int) -> tuple[list[str], list[str]]:
    """(words, stems) of labelled rows (text, y), at most LEXICON each, by the ratio of their rates."""
    words = rows.select("y", F.explode(F.array_distinct(F.regexp_extract_all(
        F.lower("text"), F.lit(r"[\p{L}\p{N}]{3,40}"), F.lit(0)))).alias("w"))
    counts = stored(words.groupBy("w").agg(F.sum("y").alias("t"), F.sum(1 - F.col("y")).alias("c")), "toxic-words")
    # Rates, not counts: toxic documents are rare.
    precise = (F.col("t") / toxic) >= PRECISION * (F.col("t") / toxic + F.col("c") / clean)

    def best(df, least):
        # One use more in either class: a term of few uses does not come first for want of clean ones.
        ratio = (F.col("t") + 1) / (F.col("c") + 1)
        return df.where((F.col("t") >= least) & precise).orderBy(ratio.desc(), F.desc("t"), "w").limit(LEXICON)

    stems = counts.where(F.length("w") > min(STEMS)).select(
        "t", "c", F.col("w").alias("full"), F.explode(F.array(*[F.when(F.length("w") > n, F.substring("w", 1, n))
                                                               for n in STEMS])).alias("w")).where("w is not null")
    stems = stems.groupBy("w").agg(F.sum("t").alias("t"), F.sum("c").alias("c"), F.count_if(F.col("t") > 0).alias("n")).where(
        F.col("n") >= STEM_WORDS)
    stems = [r["w"] for r in best(stems, 4 * LEAST_DOCS).collect()]
    stems = [s for s in stems if not any(s != o and s.startswith(o) for o in stems)]
    # Words that begin with a stem stay: the stem matches no misspelling of their first letters.
    return [r["w"] for r in best(counts, LEAST_DOCS).collect()], stems


def logistic(x: np.ndarray, y: np.ndarray, rounds: int = 30) -> np.ndarray:
    """Weights (constant last) by Newton's method with a small ridge."""
    x = np.c_[x, np.ones(len(x))]
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + 0.5 * np.eye(len(w))
        w += np.linalg.solve(h, x.T @ (y - p) - 0.5 * w)
    return w


def scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, modulus: int = 5, remainder: int = 0) -> DataFrame:
    """(doc_id, held_out, score, predicted), one row per row of ``docs``; held-out labels are never learned."""
    sample = labelled_sample(labels, "toxic", SAMPLE_DOCS, held_out_rows(F.col("doc_id"), modulus, remainder))
    rows = training_rows(docs, sample, SAMPLE_DOCS)
    toxic, n = rows.agg(F.sum("y"), F.count("*")).first()
    toxic = toxic or 0
    if 0 < toxic < n:
        auto = Automaton(*lexicon(rows, toxic, n - toxic))
        got = map_texts(rows, ["doc_id", "y"], "text", lambda t: {"x": list(features(t, auto))}, "x array<double>")
        got = got.groupBy("x", "y").count().orderBy("x", "y").collect()
        w = logistic(np.repeat([r["x"] for r in got], [r["count"] for r in got], axis=0),
                     np.repeat([r["y"] for r in got], [r["count"] for r in got]).astype(float))

        def score(texts):
            return {"score": 1 / (1 + np.exp(-np.clip(features(texts, auto) @ w[:-1] + w[-1], -30, 30)))}
    else:
        flat = toxic / n if n else 0.0

        def score(texts):
            return {"score": [flat] * len(texts)}

    out = map_texts(docs.select("doc_id", "text"), ["doc_id"], "text", score, "score double")
    return out.select("doc_id", held_out_rows(F.col("doc_id"), modulus, remainder).alias("held_out"), "score",
                      (F.col("score") >= threshold).cast("int").alias("predicted"))
