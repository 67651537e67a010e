"""Merkle manifest, URL filter and phrase mining against plain Python."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from scrubspark.llm import collocations, merkle, url_filter

from ..conftest import SF_SMALL


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, text):
    vals = [row["doc_id"], row["source"], row["lang"], row["n_chars"], text]
    return H(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in vals])


def plain_tree(digests, fanout):
    """(root, [(before, after) steps] per leaf)."""
    steps = [[] for _ in digests]
    under = [[i] for i in range(len(digests))]
    while len(digests) > 1:
        up, below = [], []
        for a in range(0, len(digests), fanout):
            run = digests[a:a + fanout]
            for j in range(len(run)):
                for i in under[a + j]:
                    steps[i].append(("".join(run[:j]), "".join(run[j + 1:])))
            up.append(H(*run))
            below.append(sum(under[a:a + fanout], []))
        digests, under = up, below
    return digests[0], steps


def plain_manifest(rows, fanout):
    by = defaultdict(list)
    for r in rows:
        hit = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 2 == 0
        text = r["text"].replace("\n", "") if hit and r["text"] is not None else r["text"]
        by["" if r["source"] is None else "=" + r["source"]].append(
            ((r["doc_id"] is not None, r["doc_id"] or 0, leaf(r, r["text"])), r["doc_id"], leaf(r, r["text"]), leaf(r, text)))
    names = sorted(by, key=str.encode)
    trees = {g: plain_tree([x[2] for x in sorted(by[g])], fanout) for g in names}
    root, above = plain_tree([trees[g][0] for g in names], fanout)
    out = []
    for g, up in zip(names, above):
        for (_, doc, own, claimed), steps in zip(sorted(by[g]), trees[g][1]):
            path, at = steps + up, claimed
            for a, b in path:
                at = H(a, at, b)
            out.append((doc, own, trees[g][0], root, H(*[x for s in path for x in s]), at, at == root))
    return sorted(map(str, out))


@pytest.mark.parametrize("fanout", [2, 3, 4])
def test_manifest_equals_plain_trees(spark, odd, fanout):
    small = spark.read.parquet(f"{SF_SMALL}/documents.parquet").where("doc_id < 70").unionByName(
        odd.select("doc_id", "text", "lang", "source", "n_chars"), allowMissingColumns=True)
    small = small.withColumns({c: F.lit("x") for c in ("grp", "idx", "n", "digest", "c_claimed", "Place")})
    m = merkle.manifest(small, fanout=fanout, carry={"claimed": merkle.without_newlines(small)})
    got = merkle.verified(m, "claimed").collect()
    assert sorted(str(tuple(r)) for r in got) == plain_manifest(small.collect(), fanout)
    assert {r["verified"] for r in got} == {True, False}


def test_manifest_of_hot_group_in_many_ranges_and_of_none(spark, none):
    rows = spark.range(400).select(F.col("id").alias("doc_id"), F.concat(F.lit("t\n"), "id").alias("text"), F.lit("en").alias("lang"),
                                   F.when(F.col("id") % 10 < 8, "hot").otherwise(F.col("id").cast("string")).alias("source"),
                                   F.lit(1).alias("n_chars")).repartition(5)
    m = merkle.manifest(rows, carry={"claimed": merkle.without_newlines(rows)})
    assert sorted(str(tuple(r)) for r in merkle.verified(m, "claimed").collect()) == plain_manifest(rows.collect(), 3)
    m = merkle.manifest(none, carry={"claimed": merkle.without_newlines(none)})
    assert m.root is None and merkle.verified(m, "claimed").count() == 0


def verdicts(spark, rows, **more):
    pages = spark.createDataFrame([(i, u, h, "x") for i, (u, h) in enumerate(rows)], "page_id long, url string, html string, host string")
    return [r for r in url_filter.verdicts(pages, **more).orderBy("page_id").collect()]


def test_rules_hosts_and_paths(spark):
    rows = [("http://Example.COM/en/1?x#y", ""), ("https://www.example.com/en/", None), ("a.net/es/1", ""), ("http://a.NET/es/1", ""),
            ("http://net/fr/", ""), ("http://net/fr", ""), ("http://anet/fr/", ""), (None, None), ("", ""), ("http://b.com", ""),
            ("x://b.com?/en/", ""), ("http://m.example.com/en/é", ""), ("http://example.com/EN/", ""), ("http://a.org/u://b.com/", "")]
    got = [(r["host"], r["path"], r["rule"], r["verdict"]) for r in verdicts(spark, rows)]
    assert got == [
        ("example.com", "/en/1", "example.com/en/", "block"), ("www.example.com", "/en/", "www.example.com/en/", "allow"), ("", "", None, "allow"),
        ("a.net", "/es/1", "net/es/", "block"), ("net", "/fr/", "net/fr/", "block"), ("net", "/fr", None, "allow"), ("anet", "/fr/", None, "allow"),
        ("", "", None, "allow"), ("", "", None, "allow"), ("b.com", "", None, "allow"), ("b.com", "", None, "allow"),
        ("m.example.com", "/en/é", "example.com/en/", "block"), ("example.com", "/EN/", "com/", "allow"), ("a.org", "/u://b.com/", None, "allow")]


def test_blocks_reach_aliases_and_allows_stay(spark):
    to = '<head><LINK href="%s" Rel=canonical></head>'
    moved = "<meta content='0; URL=%s' http-equiv='Refresh'>"
    rows = [
        ("http://a.org/1", to % "http://b.org/x?p=1&amp;q=2"), ("http://B.org/x?p=1&q=2#top", moved % "//c.net/fr/9"),   # chain to a blocked url
        ("https://shop.com/z", to % "http://a.org/1"),                                                                   # its own allow stays
        ("http://d.org/dir/page", to % "other"), ("http://d.org/dir/other", moved % "/up"), ("http://d.org/up", to % "?k"),
        ("http://e.org/1", "<!-- " + to % "http://c.net/fr/9" + "-->"), ("http://f.org/1", "<script>x='" + to % "http://c.net/fr/9" + "'</script>"),
        ("http://g.org/1", to % "http://g.org/1"), ("http://h.org/1", to % ""), ("http://i.org/1", "<link rel=canonical <p>"),
        ("http://j.org/1", '<link rel="icon canonical" href=\'http://d.org/up?k\'>'), ("http://k.org/1", None)]
    rows += [(f"http://hub{i}.org/", to % "http://c.net/es/hub") for i in range(40)]
    got = {u: r["verdict"] for (u, _), r in zip(rows, verdicts(spark, rows))}
    blocked = {u for u, v in got.items() if v == "block"}
    assert blocked == {"http://a.org/1", "http://B.org/x?p=1&q=2#top", *[f"http://hub{i}.org/" for i in range(40)]}
    more = spark.createDataFrame([("http://d.org/up?k", "http://q.net/es/1"), (None, "http://z.org/"), ("HTTP://K.org/1", "http://q.net/es/1")],
                                 "from_url string, to_url string")
    got = {u: r["verdict"] for (u, _), r in zip(rows, verdicts(spark, rows, redirects=more))}
    assert {u for u, v in got.items() if v == "block"} - blocked == {
        "http://d.org/dir/page", "http://d.org/dir/other", "http://d.org/up", "http://j.org/1", "http://k.org/1"}


def test_url_filter_on_no_pages_and_long_pages(spark):
    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert url_filter.verdicts(none).count() == 0
    for unit in ("<!-- canonical", "<script canonical ", "<link rel=canonical ", "<meta http-equiv=refresh content=", "<link " + "a=b " * 9):
        got = verdicts(spark, [("http://a.org/1", unit * (2_000_000 // len(unit)))] * 2)
        assert [r["verdict"] for r in got] == ["allow", "allow"]


def plain_collocations(rows, support, top):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\n-\r]", low):
            w = re.findall(r"[^ \t]+", piece)
            n[lang] += len(w)
            for size in range(1, 5):
                f[lang].update(tuple(w[i:i + size]) for i in range(len(w) - size + 1))
    out = []
    for lang, c in f.items():
        cand = {p: a for p, a in c.items() if a >= support and len(p) > 1}
        rows = []
        for p, a in cand.items():
            inside = any(100 * b >= 80 * a and len(q) > len(p) and any(q[i:i + len(p)] == p for i in range(len(q))) for q, b in cand.items())
            if not inside:
                score, k = min((2_000_000 * a // (c[p[:k]] + c[p[k:]]), k) for k in range(1, len(p)))
                rows.append((score, a, " ".join(p), c[p[:k]], c[p[k:]]))
        rows.sort(key=lambda r: (-r[0], -r[1], r[2].encode()))
        out += [(lang, i, r[2], r[1], r[3], r[4], n[lang], r[0]) for i, r in enumerate(rows[:top], 1)]
    return sorted(out)


@pytest.mark.parametrize("share", [0.0, 0.1, 1.0])
def test_collocations_equal_plain_counting(spark, odd, share, monkeypatch):
    monkeypatch.setattr(collocations, "SLICE", 100_000)
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").where("doc_id < 60").select("doc_id", "lang", "text").unionByName(
        odd.where("coalesce(doc_id, 0) <> 9").select("doc_id", "lang", "text")).repartition(3)
    extra = spark.createDataFrame([(500 + i, "xx", "A b\tc  d.a B c D;é É a b c d\x0bx y\u00a0z") for i in range(12)] + [(600, None, "a b a b a b " * 30)],
                                  "doc_id long, lang string, text string")
    docs = docs.unionByName(extra).withColumns({c: F.lit(1) for c in ("phrase", "A", "n", "score")})
    got = collocations.collocations(docs, support=6, top=400, share=share).collect()
    assert sorted(map(tuple, got)) == plain_collocations([(r["lang"], r["text"]) for r in docs.collect()], 6, 400)


def test_collocations_close_where_the_sample_proposes_nothing(spark):
    """The sample holds none of the phrases: words, pairs, triples and longer ones all fail and are expanded."""
    docs = spark.createDataFrame([(i, "en", "p q r s" if i % 2 else "p t u") for i in range(40)], "doc_id long, lang string, text string")
    got = collocations.collocations(docs, support=20, share=0.0).collect()
    assert sorted(map(tuple, got)) == plain_collocations([("en", r["text"]) for r in docs.collect()], 20, 2000)
    assert {r["phrase"] for r in got} == {"p q r s", "p t u"}


def test_collocations_are_exact_in_crowded_bit_tables_and_few_hashes(spark, odd, monkeypatch):
    """Foreign phrases share bits and hashes: they are counted as well, and by their text."""
    docs = odd.where("coalesce(doc_id, 0) <> 9").select("doc_id", "lang", "text")
    want = plain_collocations([(r["lang"], r["text"]) for r in docs.collect()], 4, 900)
    tables = [(collocations.Table(np.zeros(8, np.uint8).tobytes()), collocations.Table(np.full(8, 255, np.uint8).tobytes())),
              (collocations.Table(np.full(8, 255, np.uint8).tobytes()),) * 2]
    for proposed, possible in tables:
        f = defaultdict(Counter)
        for r in docs.collect():
            for names, n, a in collocations.counted(r["lang"] or "und", [(r["text"] or "").encode()], proposed, possible, 4):
                f[r["lang"] or "und"].update({(n, x.decode()): int(c) for x, c in zip(names, a)})
        rows = [(g, x, n, a) for g, c in f.items() for (n, x), a in c.items() if a >= 4 or n == 0]
        counts = spark.createDataFrame(rows, "lang string, phrase string, len int, a long")
        got = {(r["lang"], r["phrase"], r["a"], r["l"], r["r"], r["score"]) for r in collocations.maximal(collocations.scored(counts)).collect()}
        assert {(x[0], *x[2:6], x[7]) for x in want} <= got


def test_collocations_of_nothing_and_of_huge_counts(spark, none):
    assert collocations.collocations(none).count() == 0
    big = 7_000_000_000_000
    counts = spark.createDataFrame([("en", "a", 1, 3 * big), ("en", "b", 1, 2 * big), ("en", "a b", 2, big), ("en", "", 0, 9 * big)],
                                   "lang string, phrase string, len int, a long")
    (r,) = collocations.maximal(collocations.scored(counts)).collect()
    assert (r["a"], r["l"], r["r"], r["score"]) == (big, 3 * big, 2 * big, 400_000)


def test_one_very_long_text_is_read_whole(spark):
    text = "k l m " * 300_000
    got = collocations.collocations(spark.createDataFrame([(1, "en", text)], "doc_id long, lang string, text string")).collect()
    assert {r["n"] for r in got} == {900_000} and max(r["a"] for r in got) <= 300_000
