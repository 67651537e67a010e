"""Secret scan with a trigram inverted index, in DataFrame functions only.

From each rule's regular expression a Boolean trigram query is derived: the literal runs every match must
contain, as an AND of ORs of trigram sets.  The index holds a posting (trigram, document key) for each
queried trigram that a document's lower-cased text contains; postings are intersected by document, the
queries evaluated, and only candidates are verified by the expression.  A rule with no mandatory trigram
scans every document.

Positions come from the text between matches: gaps and matches become rows, and a running sum by document
and rule gives starts and ends in code points.

Defined cases: NULL or empty text has no spans; repeated rows get the same result each; documents are
told apart by a hash of (doc_id, text), so a NULL doc_id is no special case; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from re import _constants as C
from re import _parser as parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from scrubspark.llm.common import stored

#: Candidate documents up to which their keys are broadcast (16 bytes each); beyond, the join shuffles.
BROADCAST_KEYS = 500_000
#: Strings followed at once while a literal run is spelled out.
SPELLED = 64


@dataclass(frozen=True)
class Rule:
    """``group``: the part whose length must be ``least`` or more (0 is the whole match)."""
    kind: str
    pattern: str
    group: int = 0
    least: int = 1


#: The base rules in the order of the result, then the rules the method adds.
BASE = (
    Rule("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]+", 0, 24),
)
ADDED = (
    Rule("private_key", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("stripe", r"sk_live_[A-Za-z0-9]{16,}"),
    # Only at the start of a run, and without going back into one: linear on any text.
    Rule("jwt", r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{10,}+\.eyJ[A-Za-z0-9_-]{10,}+\.[A-Za-z0-9_-]{10,}+"),
)


def _spell(items) -> tuple[set[str] | None, list]:
    """(all strings the items can match in lower case, or None if they are too many; clauses they need)."""
    run, open_, clauses = {""}, False, []

    def flush():
        nonlocal run, open_
        clause = [frozenset(s[i:i + 3] for i in range(len(s) - 2)) for s in run]
        if all(clause):
            clauses.append([a for a in set(clause) if not any(b < a for b in clause)])
        run, open_ = {""}, True

    def add(more: set[str] | None):
        nonlocal run
        if more is None:
            flush()
            return
        if len(run) * len(more) > SPELLED:
            flush()
        run = {a + b for a in run for b in more} if len(more) <= SPELLED else {""}

    for op, arg in items:
        if op is C.LITERAL:
            add({chr(arg).lower()})
        elif op is C.IN:
            span = sum(1 if o is C.LITERAL else a[1] - a[0] + 1 if o is C.RANGE else 1 << 20 for o, a in arg)
            add({chr(x).lower() for o, a in arg for x in ([a] if o is C.LITERAL else range(a[0], a[1] + 1))}
                if span <= 8 else None)
        elif op is C.SUBPATTERN or op is C.BRANCH:
            ways = [_spell(w) for w in (arg[1] if op is C.BRANCH else [arg[3]])]
            if all(w[0] is not None for w in ways):
                add(set().union(*[w[0] for w in ways]))
            else:
                flush()
                if len(ways) == 1:
                    clauses.extend(ways[0][1])
        elif op is C.MAX_REPEAT:
            low, high, sub = arg
            strings = _spell(sub)[0]
            if strings is not None and high == 1:
                add(strings | {""} if low == 0 else strings)
            elif strings is not None and low == high and len(strings) ** low <= SPELLED:
                for _ in range(low):
                    add(strings)
            else:
                flush()
        elif op is not C.AT:
            flush()
    if open_:
        flush()
        return None, clauses
    return run, clauses


def trigram_query(pattern: str) -> list[list[frozenset]]:
    """Clauses (all must hold) of alternatives (one must hold) of trigrams (all must occur in lower case)."""
    run, clauses = _spell(parser.parse(pattern))
    if run is not None:
        clause = [frozenset(s[i:i + 3] for i in range(len(s) - 2)) for s in run]
        clauses = clauses + ([[a for a in set(clause) if not any(b < a for b in clause)]] if all(clause) else [])
    return clauses


def _met(query: list, at: dict[str, int]) -> Column:
    """The Boolean query over ``mask``, an array of words of 32 bits, bit k for trigram k."""
    def has(t):
        word, bit = divmod(at[t], 32)
        return F.col(f"m{word}").bitwiseAND(F.lit(1 << bit)) != 0
    out = F.lit(True)
    for clause in query:
        any_ = F.lit(False)
        for alternative in clause:
            all_ = F.lit(True)
            for t in sorted(alternative):
                all_ = all_ & has(t)
            any_ = any_ | all_
        out = out & any_
    return out


def postings(docs: DataFrame, trigrams: list[str]) -> DataFrame:
    """(trigram, key): the inverted index of ``docs`` (key, text) for the given trigrams, by their number."""
    low = docs.select("key", F.lower("text").alias("low"))
    held = F.array_compact(F.array(*[F.when(F.contains("low", F.lit(t)), F.lit(i)) for i, t in enumerate(trigrams)]))
    return low.select(F.explode(held).alias("trigram"), "key")


def candidates(docs: DataFrame, rules: list[tuple[int, Rule]]) -> DataFrame:
    """(key, rules): which of the numbered rules (a bit each) a document can match, by intersected postings."""
    queries = {i: trigram_query(r.pattern) for i, r in rules}
    trigrams = sorted({t for q in queries.values() for clause in q for a in clause for t in a})
    at = {t: i for i, t in enumerate(trigrams)}
    index = postings(docs, trigrams)
    # One row per document and scan task: its postings meet before the shuffle.
    masks = index.groupBy("key").agg(*[
        F.bit_or(F.when(F.floor(F.col("trigram") / 32) == w, F.expr("shiftleft(1L, trigram % 32)")).otherwise(
            F.lit(0).cast("long"))).alias(f"m{w}") for w in range((len(trigrams) + 31) // 32)])
    hit = F.lit(0).cast("long")
    for i, q in queries.items():
        hit = hit.bitwiseOR(F.when(_met(q, at), F.lit(1 << i).cast("long")).otherwise(F.lit(0).cast("long")))
    return masks.select("key", hit.alias("rules")).where("rules <> 0")


def _matches(docs: DataFrame, rules: list[tuple[int, Rule, Column]]) -> DataFrame:
    """(key, kind, at, gap, len, part) for each match of the rules whose condition holds."""
    found = [F.when(cond, F.struct(
        F.lit(i).alias("kind"), F.transform(F.split("text", r.pattern), F.length).alias("gaps"),
        F.transform(F.regexp_extract_all("text", F.lit(r.pattern), F.lit(0)), F.length).alias("lens"),
        F.transform(F.regexp_extract_all("text", F.lit(r.pattern), F.lit(r.group)), F.length).alias("parts")))
        for i, r, cond in rules]
    each = docs.select("key", F.explode(F.array_compact(F.array(*found))).alias("m"))
    return each.select("key", "m.kind", F.posexplode(F.arrays_zip("m.gaps", "m.lens", "m.parts")).alias("at", "x")).select(
        "key", "kind", "at", F.col("x.gaps").alias("gap"), F.col("x.lens").alias("len"),
        F.col("x.parts").alias("part")).where("len is not null")


def secret_spans(docs: DataFrame, base=BASE, added=ADDED, broadcast_keys: int = BROADCAST_KEYS) -> DataFrame:
    """(doc_id, n_<base kind>..., base_sha256, spans), one row per row of ``docs``."""
    rules = list(enumerate([*base, *added]))
    keyed = docs.select("doc_id", F.col("text"), F.xxhash64("doc_id", "text").alias("key"))
    full = [(i, r) for i, r in rules if not trigram_query(r.pattern)]
    indexed = [(i, r) for i, r in rules if trigram_query(r.pattern)]
    cand = stored(candidates(keyed.select("key", "text"), indexed), "secret-candidates")
    side = F.broadcast(cand) if cand.count() <= broadcast_keys else cand
    verify = keyed.select("key", "text").join(side, "key")
    hits = _matches(verify, [(i, r, F.col("rules").bitwiseAND(F.lit(1 << i).cast("long")) != 0) for i, r in indexed])
    # A character class repeated is found at once if it can reach the wanted length.
    far = [(i, r, F.col("text").rlike(r.pattern[:-1] + "{%d}" % r.least if r.pattern.endswith("]+") and not r.group
                                      else r.pattern)) for i, r in full]
    if far:
        hits = hits.unionAll(_matches(keyed.select("key", "text"), far))
    # Rows with one key hold one text: their matches count once.
    hits = hits.distinct()
    w = W.Window.partitionBy("key", "kind").orderBy("at").rowsBetween(W.Window.unboundedPreceding, 0)
    end = F.sum(F.col("gap") + F.col("len")).over(w)
    least = F.element_at(F.array(*[F.lit(r.least) for _, r in rules]), F.col("kind") + 1)
    kinds = F.array(*[F.lit(r.kind) for _, r in rules])
    spans = hits.withColumn("end", end).where(F.col("part") >= least).select(
        "key", F.struct((F.col("end") - F.col("len")).alias("start"), "kind", "end").alias("s"))
    per = spans.groupBy("key").agg(F.sort_array(F.collect_list("s")).alias("all"))
    per = per.withColumn("base", F.filter("all", lambda s: s["kind"] < len(base)))

    def text(a):
        return F.array_join(F.transform(a, lambda s: F.concat_ws(
            ":", F.element_at(kinds, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")

    def number(i):
        return F.size(F.filter("base", lambda s: s["kind"] == i)).cast("long")
    per = per.select("key", *[number(i).alias(f"n_{r.kind}") for i, r in enumerate(base)],
                     text(F.col("base")).alias("base_text"), text(F.col("all")).alias("spans"))
    out = keyed.select("doc_id", "key").join(per, "key", "left")
    zero = F.lit(0).cast("long")
    return out.select("doc_id", *[F.coalesce(f"n_{r.kind}", zero).alias(f"n_{r.kind}") for r in base],
                      F.sha2(F.coalesce("base_text", F.lit("")), 256).alias("base_sha256"),
                      F.coalesce("spans", F.lit("")).alias("spans"))
