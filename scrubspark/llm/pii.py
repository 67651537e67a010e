"""Personal data by weak supervision.

Candidate spans are the matches of the base patterns and of looser ones.  Labelers vote on each
candidate (+ personal, - not, 0 abstains): patterns, gazetteers and words of the context.  The votes of
all documents are counted by vote pattern and span signature; expectation-maximisation on the counts
estimates each labeler's reliability and the chance that a pattern means personal data; a logistic
classifier of the span's signature is fitted to those chances, and decides on every candidate.  Matches
of the base patterns stay whatever it says; other candidates are added if it accepts them and they
overlap no base match.

The counted table holds vote patterns x signatures, both from fixed small sets, so it is bounded however
many documents there are.  Texts are read where they lie; nothing of them is shuffled.

Defined cases: NULL is the empty text (no spans); repeated rows are treated alike; an empty table trains
nothing and gives an empty result; other columns are kept (redaction) or ignored, never read.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scrubspark.llm.common import fresh, map_texts, quoted

#: Base kinds in the order of the result, then the kinds the method adds.
BASE = ("email", "ip", "card", "phone")
ADDED = ("mail_at", "number", "person")
#: Characters before and after a span that context labelers read.
CONTEXT = 32

LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A digit run that fails fails from each of its digits, so only its first one is tried.
IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
MAIL_AT = re.compile(r"(?<![A-Za-z0-9._-])[A-Za-z0-9._-]{2,64} ?[(\[]at[)\]] ?[A-Za-z0-9-]{2,63}"
                     r"(?: ?(?:\.|[(\[]dot[)\]]) ?[A-Za-z]{2,24}){1,4}")
NUMBER = re.compile(r"(?<![\w.+$#-])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{2,3}[ .-][0-9]{4}(?![\w-])")
PERSON = re.compile(r"\b(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Monsieur|Madame|Señor|Señora)\.? [A-Z][a-z]{1,20}(?: [A-Z][a-z]{1,20})?\b")

#: Gazetteers: top-level domains, calling codes, first names.
DOMAINS = frozenset("com org net edu gov de fr es uk eu it nl ch at be us ca io info".split())
CODES = ("1", "7", "20", "27", "30", "31", "32", "33", "34", "39", "41", "43", "44", "45", "46", "47", "48", "49",
         "52", "55", "61", "81", "82", "86", "90", "91")
NAMES = frozenset("anna maria peter paul john james mary linda hans klaus jean pierre marie luis carlos ana jose".split())
#: Words of the context for and against personal data.
FOR = re.compile(r"\b(?:call|tel|phone|mobile|fax|mail|e-?mail|contact|card|visa|credit|ssn|social|address|reach|"
                 r"telefon|anruf|karte|téléphone|carte|courriel|teléfono|tarjeta|correo)\b", re.I)
AGAINST = re.compile(r"(?:\b(?:version|v|isbn|issn|page|order|invoice|chapter|section|figure|rfc|build|release)\b|[$€£#%])", re.I)

LABELERS = ("pattern", "strict", "gazetteer", "words_for", "words_against", "groups", "repeated", "edges")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of ``[local]+@label(.label)+``, found from each @: linear on any text."""
    end, at = 0, text.find("@")
    while at >= 0:
        left = text[end:at]
        n = len(left) - len(left.rstrip(LOCAL))
        m = DOMAIN.match(text, at + 1) if n else None
        if m:
            yield at - n, m.end()
        end = m.end() if m else at + 1
        at = text.find("@", end)


def luhn(digits: str) -> bool:
    total = sum(int(d) for d in digits[-1::-2]) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by kind as listed, then start."""
    out = [("email", a, b) for a, b in emails(text)] if "@" in text else []
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 13 and 13 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= len(_digits(m[0])) <= 15:
                out.append(("phone", *m.span()))
    return out


def other_spans(text: str, base: list) -> list[tuple[str, int, int]]:
    """Looser candidates that overlap no base match, nor an earlier candidate."""
    found = []
    if "(at)" in text or "[at]" in text:
        found += [("mail_at", *m.span()) for m in MAIL_AT.finditer(text)]
    found += [("number", *m.span()) for m in NUMBER.finditer(text)]
    found += [("person", *m.span()) for m in PERSON.finditer(text)]
    # Both lists ascend: of the base spans that start before a candidate's end, the farthest end decides.
    taken = sorted((a, b) for _, a, b in base)
    starts, farthest = [a for a, _ in taken], list(accumulate((b for _, b in taken), max))
    out, reach = [], 0
    for kind, a, b in sorted(found, key=lambda s: s[1:]):
        before = bisect_left(starts, b)
        if reach <= a and (not before or farthest[before - 1] <= a):
            out.append((kind, a, b))
            reach = b
    return out


def votes(text: str, kind: str, a: int, b: int, is_base: bool) -> str:
    """One character for each of LABELERS."""
    span, before, after = text[a:b], text[max(0, a - CONTEXT):a], text[b:b + CONTEXT]
    d = _digits(span)
    if kind == "email":
        known = span.rsplit(".", 1)[-1].lower() in DOMAINS
    elif kind == "phone":
        known = d.startswith(CODES)
    elif kind == "card":
        known = d[0] in "3456"
    elif kind == "ip":
        known = not d.startswith("0")
    elif kind == "person":
        known = any(w.lower() in NAMES for w in span.split())
    elif kind == "mail_at":
        known = re.split(r"[^a-z]+", span.lower().rstrip(")]"))[-1] in DOMAINS
    else:
        known = None
    strict = {"email": span.count("@") == 1 and not span.startswith("."), "ip": span.count(".") == 3 and "." != after[:1],
              "card": len(d) in (15, 16), "phone": 10 <= len(d) <= 13, "mail_at": True, "number": len(d) in (9, 10),
              "person": True}[kind]
    sizes = [len(g) for g in re.findall("[0-9]+", span)]
    plain = kind in ("email", "mail_at", "person")
    return "".join((
        "+" if is_base else "0", "+" if strict else "-", "0" if known is None else "+" if known else "-",
        "+" if FOR.search(before) or FOR.search(after) else "0",
        "-" if AGAINST.search(before[-12:]) else "0",
        "0" if plain else "+" if max(sizes) >= 3 or kind == "ip" else "-",
        "-" if len(d) > 3 and len(set(d)) <= 2 else "0",
        "-" if re.search(r"\w$", before) or re.match(r"\w", after) else "+"))


def signature(text: str, kind: str, a: int, b: int) -> str:
    """What the classifier sees of a span: a few small categories."""
    span = text[a:b]
    d = len(_digits(span))
    return "|".join((kind, f"d{min(d, 20) // 4}", f"n{min(b - a, 64) // 8}", f"g{min(len(re.findall('[0-9]+', span)), 5)}",
                     "word_left" if a and text[a - 1].isalnum() else "-", "word_right" if text[b:b + 1].isalnum() else "-"))


def _candidates(text: str) -> Iterator[tuple[str, str]]:
    base = base_spans(text)
    for kind, a, b in base:
        yield votes(text, kind, a, b, True), signature(text, kind, a, b)
    for kind, a, b in other_spans(text, base):
        yield votes(text, kind, a, b, False), signature(text, kind, a, b)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        seen = Counter(c for t in batch.column(0) if (s := t.as_py()) for c in _candidates(s))
        rows = [(v, s, n) for (v, s), n in seen.items()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(
            (pa.string(), pa.string(), pa.int64()))], ["votes", "signature", "n"])


def estimate(patterns: list[str], counts: np.ndarray, rounds: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """EM over vote patterns: (chance of personal data by pattern, reliability [labeler, class, vote]).

    Labelers are independent given the class; it starts from the votes' majority.
    """
    code = np.array([["-0+".index(c) for c in p] for p in patterns])
    chance = np.clip(0.5 + (code - 1).sum(axis=1) / code.shape[1], 0.02, 0.98)
    rel = np.zeros((code.shape[1], 2, 3))
    for _ in range(rounds):
        for k in range(code.shape[1]):
            for y, w in ((0, counts * (1 - chance)), (1, counts * chance)):
                tally = np.bincount(code[:, k], w, 3) + 0.5
                rel[k, y] = tally / tally.sum()
        prior = np.clip((counts * chance).sum() / counts.sum(), 0.05, 0.95)
        odds = np.log(prior / (1 - prior)) + sum(
            np.log(rel[k, 1, code[:, k]] / rel[k, 0, code[:, k]]) for k in range(code.shape[1]))
        chance = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
    # The class that the base patterns vote for is the one called personal data.
    if (counts * chance * (code[:, 0] == 2)).sum() < (counts * (1 - chance) * (code[:, 0] == 2)).sum():
        chance, rel = 1 - chance, rel[:, ::-1]
    return chance, rel


def fit(signatures: list[str], soft: np.ndarray, counts: np.ndarray, steps: int = 300) -> dict[str, float]:
    """Weights of signature parts by logistic regression on soft labels, each row weighing log(1 + count)."""
    names = sorted({p for s in signatures for p in s.split("|")})
    at = {p: i for i, p in enumerate(names)}
    x = np.zeros((len(signatures), len(names) + 1))
    x[:, -1] = 1
    for i, s in enumerate(signatures):
        for p in s.split("|"):
            x[i, at[p]] = 1
    w, weight = np.zeros(x.shape[1]), np.log1p(counts)
    weight /= weight.sum()
    for _ in range(steps):
        p = 1 / (1 + np.exp(-x @ w))
        w -= 2.0 * (x.T @ (weight * (p - soft)) + 1e-3 * w)
    return dict(zip([*names, ""], w.tolist()))


def train(docs: DataFrame) -> dict[str, float]:
    """Weights of the span classifier from the candidates of all documents."""
    seen = docs.select("text").mapInArrow(_count, "votes string, signature string, n long")
    rows = seen.groupBy("votes", "signature").agg(F.sum("n").alias("n")).orderBy("votes", "signature").collect()
    if not rows:
        return {}
    by_votes = Counter()
    for r in rows:
        by_votes[r["votes"]] += r["n"]
    patterns = sorted(by_votes)
    chance, _ = estimate(patterns, np.array([by_votes[p] for p in patterns], float))
    soft = dict(zip(patterns, chance))
    return fit([r["signature"] for r in rows], np.array([soft[r["votes"]] for r in rows]),
               np.array([r["n"] for r in rows], float))


def spans(text: str, weights: dict[str, float]) -> tuple[list, list]:
    """(base spans, added spans), each by kind as listed, then start."""
    base, added = base_spans(text), []
    for kind, a, b in other_spans(text, base):
        score = weights.get("", 0.0) + sum(weights.get(p, 0.0) for p in signature(text, kind, a, b).split("|"))
        if score >= 0:
            added.append((kind, a, b))
    return base, sorted(added, key=lambda s: (ADDED.index(s[0]), s[1]))


def joined(found: list) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in found)


def find(docs: DataFrame, weights: dict[str, float]) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans), one row per row of ``docs``."""
    def run(texts):
        out = {f"n_{k}": [] for k in BASE} | {"base_sha256": [], "spans": []}
        for t in texts:
            base, added = spans(t, weights)
            n = Counter(k for k, _, _ in base)
            for k in BASE:
                out[f"n_{k}"].append(n[k])
            out["base_sha256"].append(hashlib.sha256(joined(base).encode()).hexdigest())
            out["spans"].append(joined(base + added))
        return out
    return map_texts(docs.select("doc_id", "text"), ["doc_id"], "text", run,
                     ", ".join(f"n_{k} long" for k in BASE) + ", base_sha256 string, spans string")


def masked(text: str, weights: dict[str, float]) -> str:
    """``text`` with each run of overlapping spans replaced by the kind of its first, in brackets."""
    base, added = spans(text, weights)
    found = sorted(base + added, key=lambda s: (s[1], -s[2]))
    if not found:
        return text
    runs = []
    for kind, a, b in found:
        if runs and a < runs[-1][2]:
            runs[-1][2] = max(b, runs[-1][2])
        else:
            runs.append([kind, a, b])
    out, end = [], 0
    for kind, a, b in runs:
        out += [text[end:a], f"[{kind.upper()}]"]
        end = b
    return "".join(out) + text[end:]


def redact(docs: DataFrame, weights: dict[str, float]) -> DataFrame:
    """``docs`` with spans in ``text`` masked (a NULL text stays) and ``n_chars``, if there, counted anew."""
    keys = [c for c in docs.columns if c != "text"]
    out = fresh(docs, "masked")
    d = map_texts(docs.withColumn(out, F.col("text").isNull()), [*keys, out], "text",
                  lambda texts: {"text": [masked(t, weights) for t in texts]}, "text string")
    text = F.when(~quoted(out), F.col("text"))
    cols = [text.alias("text") if c == "text" else
            F.length(text).cast(docs.schema["n_chars"].dataType).alias("n_chars") if c == "n_chars" else quoted(c)
            for c in docs.columns]
    return d.select(*cols)
