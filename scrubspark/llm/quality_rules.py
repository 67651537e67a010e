"""Quality rules as a learned decision list, in DataFrame functions only.

Statistics of a text are array and string functions of its own row.  The list is learned by
sequential covering from a bounded sample of labelled documents: a rule is a conjunction of threshold
conditions ``statistic >= t`` or ``statistic < t`` on quantile thresholds, grown by the best gain in
information about bad documents, pruned on rows kept aside, and accepted when it is precise there;
rows it covers leave the sample and the next rule is grown.  Every step is one grouped count over the
binned sample, at most (statistics x thresholds x 4) rows.  The list becomes one ordered ``when`` chain.

Defined cases: NULL or empty text has no words, so it fails the base test; fewer than three words have
no window; without labels (or with one class) the list is empty and only the base test rejects;
repeated rows are judged alike; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scrubspark.llm.common import fresh, labelled_sample, quoted, stored, training_rows, where_computed

#: Labelled documents used to learn, quantile thresholds for each statistic, and the limits of a list.
SAMPLE_ROWS, THRESHOLDS, MAX_RULES, MAX_CONDITIONS = 12_000, 15, 8, 3
#: A rule must reject this share of bad documents among those it covers, on rows kept aside, and cover this many.
PRECISION, COVER = 0.9, 5

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
FEATURES = ("n_words", "symbols_per_word", "dup_line_share", "repeat_share", "chars_per_word", "upper_share",
            "words_per_line")


@dataclass(frozen=True)
class Condition:
    feature: str
    at_least: bool
    threshold: float

    def column(self) -> Column:
        c = quoted(self.feature)
        return c >= self.threshold if self.at_least else c < self.threshold

    def __str__(self):
        return f"{self.feature} {'>=' if self.at_least else '<'} {self.threshold:.6g}"


def statistics(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` without ``text`` and with the columns BASE and FEATURES, computed row by row."""
    keep = [c for c in df.columns if c != text]
    kept = ["`" + c.replace("`", "``") + "`" for c in keep]
    d = df.select(*[quoted(c) for c in keep], F.coalesce(quoted(text), F.lit("")).alias("_t"))
    d = d.withColumn("_w", F.array_remove(F.split(F.translate("_t", "\t\n\x0b\x0c\r", "     "), " "), ""))
    d = d.withColumn("_l", F.filter(F.split("_t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    d = d.select(*[quoted(c) for c in keep], "_w", F.size("_w").alias("_n"), F.length(F.array_join("_w", "")).alias("_wc"),
                 (F.length("_t") - F.length(F.translate("_t", "#*$%&|<>", ""))).alias("_sym"),
                 (F.length("_t") - F.length(F.translate("_t", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))).alias("_up"),
                 F.size("_l").alias("_lines"), F.size(F.array_distinct("_l")).alias("_dl"))
    rest = [*kept, "_n", "_wc", "_sym", "_up", "_lines", "_dl"]
    # Windows whose hashes all differ cannot repeat; only the other texts sort their windows.
    d = d.selectExpr(*rest, "_w", """case when _n >= 4 then transform(sequence(0, _n - 3),
                     i -> xxhash64(get(_w, i), get(_w, i + 1), get(_w, i + 2))) end as _h""")
    d = d.selectExpr(*rest, "_w", "coalesce(size(_h) > size(array_distinct(_h)), false) as _again")
    d = d.selectExpr(*rest, """case when _again then sort_array(transform(sequence(0, _n - 3),
                     i -> struct(concat_ws(' ', get(_w, i), get(_w, i + 1), get(_w, i + 2)) as x, i as i))) end as _s""")
    d = d.selectExpr(*rest, """case when _s is not null then sort_array(transform(filter(sequence(0, size(_s) - 1),
                     k -> coalesce(get(_s, k).x = get(_s, k + 1).x, false) or coalesce(get(_s, k).x = get(_s, k - 1).x, false)),
                     k -> get(_s, k).i)) end as _p""")
    # Words covered: three for each repeated window, less what neighbouring windows share.
    d = d.selectExpr(*rest, """coalesce(3 * size(_p) - case when size(_p) > 1 then aggregate(sequence(1, size(_p) - 1), 0,
                     (acc, k) -> acc + greatest(0, 3 - (get(_p, k) - get(_p, k - 1)))) else 0 end, 0) as _rep""")
    one = lambda c: F.greatest(F.col(c), F.lit(1))
    return d.select(
        *[quoted(c) for c in keep], F.col("_n").cast("long").alias("n_words"), F.col("_wc").cast("long").alias("word_chars"),
        F.col("_sym").cast("long").alias("n_symbols"), (F.col("_lines") - F.col("_dl")).cast("long").alias("n_dup_lines"),
        F.greatest(F.col("_rep"), F.lit(0)).cast("long").alias("n_repeat_words"),
        (F.col("_sym") / one("_n")).alias("symbols_per_word"),
        ((F.col("_lines") - F.col("_dl")) / one("_lines")).alias("dup_line_share"),
        (F.col("_rep") / one("_n")).alias("repeat_share"), (F.col("_wc") / one("_n")).alias("chars_per_word"),
        (F.col("_up") / one("_wc")).alias("upper_share"), (F.col("_n") / one("_lines")).alias("words_per_line"))


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def _gain(p: int, n: int, p0: int, n0: int) -> float:
    return p * (log2(p / (p + n)) - log2(p0 / (p0 + n0))) if p else 0.0


def learn(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> list[list[Condition]]:
    """The decision list: rules (conjunctions) in the order they apply; a document that meets one is bad."""
    ids = labelled_sample(labels, "quality", sample_rows)
    rows = training_rows(docs, ids, sample_rows)
    stats = statistics(rows).withColumn("grow", F.pmod(F.xxhash64(F.lit("grow"), "doc_id"), F.lit(3)) > 0)
    stats = stored(where_computed(stats, ~base_failed(), ["y", "grow", *FEATURES]), "rule-sample")
    marks = [(k + 1) / (THRESHOLDS + 1) for k in range(THRESHOLDS)]
    # Thresholds come from the quantiles of either class, so a rare class has its own.
    cuts = {f: set() for f in FEATURES}
    for row in stats.groupBy("y").agg(*[F.percentile_approx(f, marks, 1000).alias(f) for f in FEATURES]).collect():
        for f in FEATURES:
            cuts[f].update(float(v) for v in row[f])
    cuts = {f: sorted(v) for f, v in cuts.items()}
    bins = stats.select("y", "grow", *[
        sum([(F.col(f) >= t).cast("int") for t in cuts[f]], F.lit(0)).alias(f) for f in FEATURES])
    bins = stored(bins.groupBy("y", "grow", *FEATURES).count(), "rule-bins")

    def inside(rule):
        cond = F.lit(True)
        for f, at_least, k in rule:
            cond = cond & ((F.col(f) > k) if at_least else (F.col(f) <= k))
        return cond

    def counts(where) -> dict:
        got = bins.where(where).select("y", "grow", "count", F.posexplode(F.array(*FEATURES)).alias("f", "bin"))
        return {tuple(r[:4]): r[4] for r in got.groupBy("f", "bin", "y", "grow").agg(F.sum("count")).collect()}

    def total(c, y, grow):
        return sum(v for (f, _, a, b), v in c.items() if (f, a, b) == (0, y, grow))

    rules, left = [], F.lit(True)
    while len(rules) < MAX_RULES:
        rule, c = [], counts(left)
        steps = [(total(c, 0, False), total(c, 1, False))]
        while len(rule) < MAX_CONDITIONS:
            p0, n0 = total(c, 0, True), total(c, 1, True)
            if not p0 or not n0:
                break
            best = (1e-9, None)
            for i, f in enumerate(FEATURES):
                for k in range(len(cuts[f])):
                    p = sum(c.get((i, b, 0, True), 0) for b in range(k + 1, len(cuts[f]) + 1))
                    n = sum(c.get((i, b, 1, True), 0) for b in range(k + 1, len(cuts[f]) + 1))
                    for at_least, a, b in ((True, p, n), (False, p0 - p, n0 - n)):
                        if (g := _gain(a, b, p0, n0)) > best[0]:
                            best = (g, (f, at_least, k))
            if best[1] is None:
                break
            rule.append(best[1])
            c = counts(left & inside(rule))
            steps.append((total(c, 0, False), total(c, 1, False)))
        # Prune: the shortest start of the rule with the best balance on rows kept aside.
        worth = [(p - n) / (p + n) if p + n else -1.0 for p, n in steps]
        size = max(range(len(rule) + 1), key=lambda k: (worth[k], -k))
        p, n = steps[size]
        if not size or p < COVER or p < PRECISION * (p + n):
            break
        rules.append(rule[:size])
        left = left & ~inside(rule[:size])
    return [[Condition(f, at_least, cuts[f][k]) for f, at_least, k in rule] for rule in rules]


def verdict(rules: list[list[Condition]]) -> Column:
    """The rule that rejects a row (1 is the first), or 0: one ordered conditional expression."""
    out = None
    for i, rule in enumerate(rules):
        cond = rule[0].column()
        for c in rule[1:]:
            cond = cond & c.column()
        out = F.when(cond, i + 1) if out is None else out.when(cond, i + 1)
    return F.lit(0) if out is None else out.otherwise(0)


def judged(docs: DataFrame, rules: list[list[Condition]]) -> DataFrame:
    """(doc_id, BASE..., base_failed, rule, kept), one row per row of ``docs``."""
    d = statistics(docs.select("doc_id", "text"))
    d = d.withColumn("base_failed", base_failed()).withColumn("rule", verdict(rules))
    d = d.withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0))
    # So that a caller's filter on these columns is not pushed into their computation.
    return where_computed(d, F.lit(True), ["doc_id", *BASE, "base_failed", "kept", "rule"])


def keep_good(docs: DataFrame, rules: list[list[Condition]]) -> DataFrame:
    """The rows of ``docs`` that neither the base test nor a rule rejects, with the columns of ``docs``."""
    whole = fresh(docs, "whole_row")
    d = docs.select("text", F.struct(*[quoted(c) for c in docs.columns]).alias(whole))
    return where_computed(statistics(d), ~base_failed() & (verdict(rules) == 0), [whole]).select(f"{whole}.*")
