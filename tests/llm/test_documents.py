"""The document operators on odd rows and, against plain Python, on the small tables."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from scrubspark.llm import bpe, common, crf_quality, mixing, pii, quality_rules, secrets, simhash, token_files, toxicity

from ..conftest import SF_CHECK, SF_SMALL

WORD = re.compile(r"[^\x20\x09-\x0D]+")
RANKS = P.path("byte_bpe_50k.tiktoken")


def texts_of(df):
    return {r["doc_id"]: r["text"] or "" for r in df.collect()}


def test_statistics_equal_plain_counting(odd):
    got = quality_rules.judged(odd, []).collect()
    texts = texts_of(odd)
    assert len(got) == odd.count()
    for r in got:
        t = texts[r["doc_id"]] if r["doc_id"] is not None else None
        if t is None:
            continue
        w = WORD.findall(t)
        seen = Counter(tuple(w[i:i + 3]) for i in range(len(w) - 2))
        inside = {i + j for i in range(len(w) - 2) if seen[tuple(w[i:i + 3])] > 1 for j in range(3)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(inside))
        assert tuple(r[c] for c in quality_rules.BASE) == want
        assert r["base_failed"] == (len(w) < 50 or 100 * len(inside) > 50 * len(w))


def test_rules_are_learned_and_filter(spark, odd, labels, none):
    docs, lab = (spark.read.parquet(f"{SF_CHECK}/{t}.parquet") for t in ("documents", "labels"))
    rules = quality_rules.learn(docs, lab)
    out = quality_rules.judged(docs, rules).join(lab, "doc_id").where("not base_failed").collect()
    assert rules and np.mean([r["kept"] == (r["quality"] == 1) for r in out]) > 0.9
    kept = quality_rules.keep_good(odd, rules)
    assert kept.columns == odd.columns and {4, 5, 6}.isdisjoint({r["doc_id"] for r in kept.collect()})
    assert quality_rules.learn(none, labels) == [] and quality_rules.judged(none, rules).count() == 0


def test_simhash_fingerprints_and_components_equal_brute_force(spark, odd, none, monkeypatch):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text").unionByName(
        odd.select("doc_id", "text").where("doc_id > 0").withColumn("doc_id", F.col("doc_id") + 10_000))
    rows = simhash.simhash_components(docs).collect()
    fp = np.array([r["fp"] for r in rows]).view(np.uint64)
    name = list(range(len(rows)))
    for i in range(len(rows)):
        for j in np.flatnonzero(np.bitwise_count(fp[i] ^ fp) <= 3).tolist():
            a, b = name[i], name[j]
            name = [a if x == b else x for x in name]
    least = defaultdict(lambda: 1 << 60)
    for n, r in zip(name, rows):
        least[n] = min(least[n], r["doc_id"])
    assert [r["component_id"] for r in rows] == [least[n] for n in name]
    monkeypatch.setattr(simhash, "SPLIT", 3)
    again = simhash.simhash_components(docs)
    assert sorted((r["doc_id"], r["component_id"]) for r in again.collect()) == sorted(
        (r["doc_id"], r["component_id"]) for r in rows)
    assert simhash.simhash_components(none).count() == 0


def test_simhash_covers_every_pair_within_the_radius():
    masks, rng = simhash.covering_masks(3), np.random.default_rng(1)
    for _ in range(2000):
        flips = sum(1 << int(i) for i in rng.choice(64, 3, replace=False))
        assert any(m & flips == 0 for m in masks)


def test_one_document_of_each_group_stays(odd, none):
    out = simhash.deduplicate(odd)
    ids = [r["doc_id"] for r in out.collect()]
    assert out.columns == odd.columns and 1 in ids and 2 not in ids and ids.count(7) <= 1
    assert simhash.deduplicate(none).count() == 0


@pytest.mark.parametrize("chunk,overlap", [(bpe.CHUNK, bpe.OVERLAP), (120, 24)])
def test_bpe_equals_the_library_and_round_trips(odd, none, chunk, overlap):
    import tiktoken
    c = bpe.Codec(RANKS, P.PATTERN)
    library = tiktoken.Encoding("t", pat_str=P.PATTERN, mergeable_ranks={b: i for i, b in enumerate(c.bytes)},
                                special_tokens={})
    texts = texts_of(odd.where("doc_id is not null"))
    got = bpe.encoded(odd, RANKS, P.PATTERN, chunk=chunk, overlap=overlap).collect()
    assert len(got) == odd.count()
    for r in got:
        if r["doc_id"] is not None:
            ids = np.array(library.encode_ordinary(texts[r["doc_id"]]), "<u4")
            assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest())
            assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()
    assert bpe.encoded(none, RANKS, P.PATTERN).count() == 0


UNSPACED = ["中文字符,", "don't", "x=1;", "1234567", "'ll", "!!'", "\t\t", "\n\n ", "  ", "é", "a b"]


@pytest.mark.parametrize("alphabet", [UNSPACED, UNSPACED[:3], UNSPACED[5:9], ["7"], ["a", "a", "a", "'s"], ["\n", " "]])
def test_chunks_meet_at_common_pre_token_boundaries(alphabet):
    """Joined chunks give the ids of the whole text, or are told apart as never meeting."""
    c, rnd, met = bpe.Codec(RANKS, P.PATTERN), random.Random(str(alphabet)), []
    for _ in range(300):
        t = "".join(rnd.choices(alphabet, k=rnd.randint(20, 120)))
        size, overlap = rnd.choice([(40, 12), (33, 30), (64, 5)])
        parts = [bpe.marks(c, t[k:k + size + overlap], size, overlap) for k in range(0, max(1, len(t) - overlap), size)]
        got = bpe.joined(parts)
        met += [got is not None] if overlap == 30 else []
        assert got in (None, np.array(c.encoding.encode_ordinary(t), "<u4").tobytes()), t
    # A wide overlap of mixed characters has a common boundary nearly always.
    assert alphabet is not UNSPACED or sum(met) > 0.9 * len(met)


def test_unspaced_texts_are_stitched_and_copies_encoded_once(spark, monkeypatch):
    monkeypatch.setattr(bpe, "COPIES", 7)
    texts = {1: "中文字符,数据。" * 40, 2: "7" * 500, 3: "word " * 100, 4: "a" * 400}
    rows = [(i, t) for i, t in texts.items()] + [(1, texts[1])] * 30 + [(None, texts[3])] * 9 + [(4, texts[4])] * 2 + [(1, texts[3])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = Counter((r["doc_id"], r["n_tokens"], r["decoded_sha256"]) for r in bpe.encoded(docs, RANKS, P.PATTERN, chunk=120, overlap=24).collect())
    c = bpe.Codec(RANKS, P.PATTERN)
    want = Counter((i, len(c.encoding.encode_ordinary(t)), hashlib.sha256(t.encode()).hexdigest()) for i, t in rows)
    assert got == want
    parts = bpe.chunks(docs.withColumn("key", F.md5("text")), ["doc_id", "key"], 120, 24)
    assert parts.groupBy("doc_id", "key", "k").count().where("count > 1").count() == 0 and parts.agg(F.max("copies")).first()[0] == 31


def test_training_rows_are_bounded_by_rows_and_lines(spark, monkeypatch):
    """One id on 20,000 rows: equal ones count once, unlike ones are thinned; so are lines."""
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int")
    sample = common.labelled_sample(labels, "quality", 1000)
    same = spark.range(20_000).select(F.lit(1).alias("doc_id"), F.lit("a text\nof lines").alias("text"))
    assert common.training_rows(same, sample, 1000).count() == 1
    unlike = same.withColumn("text", F.concat("text", F.monotonically_increasing_id().cast("string"))).unionByName(
        spark.createDataFrame([(2, None), (2, "## $$"), (None, "x")], "doc_id int, text string"))
    assert 800 < common.training_rows(unlike, sample, 1000).count() < 1200
    assert common.training_rows(unlike.limit(0), sample, 1000).count() == 0
    monkeypatch.setattr(crf_quality, "TOTAL_LINES", 300)
    got = crf_quality.scores(unlike, labels)
    assert got.count() == unlike.count() and got.where("score is null or score < 0 or score > 1").count() == 0


def test_mix_reaches_targets_and_repeats(spark, odd, none):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    rows = mixing.mixed(docs).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, mixing.mixed(docs.repartition(7)).collect()))
    total = sum(r["size"] for r in rows)
    source = {r["doc_id"]: r["source"] for r in docs.collect()}
    by = defaultdict(list)
    for r in rows:
        by[source[r["doc_id"]]].append(r)
    assert abs(sum(v[0]["target"] for v in by.values()) - 1.5 * total) < 1e-6 * total
    for k, v in by.items():
        assert v[0]["source_size"] == sum(r["size"] for r in v)
        assert abs(sum(r["taken"] for r in v) - v[0]["target"]) <= max(r["size"] for r in v)
        assert all(r["taken"] <= 2 * r["size"] for r in v)
    # Rows that share everything are split by number: the source's words still come near its target.
    same = spark.createDataFrame([(None, "one two three", "a")] * 90 + [(1, "x " * 500, "b")], "doc_id long, text string, source string")
    out = mixing.mixed(same.repartition(5)).collect()
    near = [r for r in out if r["doc_id"] is None]
    assert abs(sum(r["taken"] for r in near) - near[0]["target"]) <= 3
    assert mixing.mix(odd).columns == odd.columns
    assert mixing.mixed(none).count() == 0 and mixing.mix(none).count() == 0


def test_pii_base_spans_equal_the_patterns(odd, none):
    patterns = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    digits = lambda s: re.sub("[^0-9]", "", s)
    keep = {"email": lambda s: True, "ip": lambda s: all(int(p) <= 255 for p in s.split(".")),
            "card": lambda s: 13 <= len(digits(s)) <= 19 and pii.luhn(digits(s)), "phone": lambda s: 9 <= len(digits(s)) <= 15}
    hard = ["a@b@c.d@e.f.g @x.y a..@b.c- +1@2.3", "1.2.3.4.5.6.7.8 300.1.1.1 01.02.03.04", "+1 2 ((3))) 4-5-6-7-8-9-0 +",
            "4111-1111 1111-1111 4111111111111112 0000000000000", "a" * 5000 + "@" + "b" * 50 + "." + "1" * 6000]
    for t in [*hard, *texts_of(odd).values()]:
        want = [(k, *m.span()) for k, p in patterns.items() for m in re.finditer(p, t[:20_000]) if keep[k](m[0])]
        assert pii.base_spans(t[:20_000]) == want
    w = pii.train(odd)
    out = pii.redact(odd, w)
    seven = out.where("doc_id = 7").first()
    assert out.columns == odd.columns and out.count() == odd.count()
    assert "[EMAIL]" in seven["text"] and "555-0147" not in seven["text"] and seven["n_chars"] == len(seven["text"])
    assert out.where("doc_id = 6").first()["text"] is None
    assert pii.train(none) == {} and pii.find(none, w).count() == 0


def test_pii_labelers_are_weighed_by_agreement():
    votes = ["+++++0++" for _ in range(3)] + ["0--0---+"]
    chance, rel = pii.estimate(sorted(set(votes)), np.array([900.0, 100.0]) if sorted(set(votes))[0][0] == "+" else np.array([100.0, 900.0]))
    by = dict(zip(sorted(set(votes)), chance))
    assert by["+++++0++"] > 0.9 > 0.5 > by["0--0---+"] and rel.shape == (8, 2, 3)


def test_secrets_equal_the_patterns(odd, none):
    got = secrets.secret_spans(odd).collect()
    texts = texts_of(odd)
    assert len(got) == odd.count()
    for r in got:
        if r["doc_id"] is None:
            continue
        t, want = texts[r["doc_id"]], []
        for k, rule in enumerate(secrets.BASE):
            want += [(m.start(), k, m.end()) for m in re.finditer(rule.pattern, t) if len(m[rule.group]) >= rule.least]
        text = ",".join(f"{secrets.BASE[k].kind}:{a}:{b}" for a, k, b in sorted(want))
        assert r["base_sha256"] == hashlib.sha256(text.encode()).hexdigest()
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(k == i for _, k, _ in want) for i in range(3)]
    by_join = secrets.secret_spans(odd, broadcast_keys=-1)
    assert by_join.exceptAll(secrets.secret_spans(odd)).count() == 0
    assert secrets.secret_spans(none).count() == 0


@pytest.mark.parametrize("rule,texts", [
    (secrets.BASE[0], ["api_key: abcdef", 'ApiKey="xx.yy==" ', "PASSWD = zzzzzz", "token:t=ok"]),
    (secrets.BASE[1], ["AKIA" + "Z" * 16]), (secrets.ADDED[1], ["ghp_" + "a1" * 20]), (secrets.ADDED[0], ["-----BEGIN RSA PRIVATE KEY-----"])])
def test_a_match_always_meets_its_trigram_query(rule, texts):
    for t in texts:
        assert re.search(rule.pattern, t)
        assert all(any(all(g in t.lower() for g in a) for a in clause) for clause in secrets.trigram_query(rule.pattern))


def test_token_files_read_back(odd, none):
    from tokenizers import Tokenizer
    import zlib
    path = P.path("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    tok.encode_special_tokens = True
    got = token_files.read(*token_files.write(odd, path)).collect()
    at = 0
    assert len(got) == odd.count()
    for r in sorted(got, key=lambda r: r["start"]):
        assert r["start"] == at
        at += r["n_tokens"]
    order = [r["doc_id"] for r in sorted(got, key=lambda r: r["start"])]
    assert order == sorted(order, key=lambda d: (d is not None, d or 0))
    texts = texts_of(odd.where("doc_id is not null"))
    for r in got:
        if r["doc_id"] is not None:
            ids = np.array([*tok.encode(texts[r["doc_id"]], add_special_tokens=False).ids, 1], "<u4")
            assert (r["n_tokens"], r["ids_crc32"]) == (len(ids), zlib.crc32(ids.tobytes()))
    assert token_files.read(*token_files.write(none, path)).count() == 0


def test_code_is_optimal_limited_and_decodes():
    rng = np.random.default_rng(3)
    w = rng.zipf(1.3, 700).clip(1, 10**9)
    free, tight = token_files.code_lengths(w, 40), token_files.code_lengths(w, 11)
    assert abs((2.0 ** -free).sum() - 1) < 1e-12 and tight.max() <= 11 and (2.0 ** -tight).sum() <= 1
    assert (w * free).sum() <= (w * tight).sum()
    ids = np.arange(700) * 3
    code = token_files.Code(ids, tight)
    seqs = [rng.choice(ids, n) for n in (1, 255, 256, 257, 5000)]
    back = code.decode([(*code.encode(s), len(s)) for s in seqs])
    assert all((a == b).all() for a, b in zip(seqs, back))
    assert token_files.code_lengths(np.array([5]), 18).tolist() == [1]


def brute_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        row = _next(row, x, b, i)
    return row[-1]


def _next(row, x, b, i):
    new = [i + 1]
    for j, y in enumerate(b):
        new.append(min(row[j + 1] + 1, new[j] + 1, row[j] + (x != y)))
    return new


def test_automaton_equals_edit_distance():
    words, stems = ["idiot", "scum", "worthless", "disgusting"], ["lowei"]
    auto, rng = toxicity.Automaton(words, stems), np.random.default_rng(5)
    tries = ["idiot", "idoit", "idit", "idiiot", "scum", "scam", "wortless", "worthles", "disgstin", "disgusting", "loweix", "lowe", "x"]
    tries += ["".join(rng.choice(list("idotscumwrhleg"), rng.integers(1, 9))) for _ in range(300)]
    flat = " ".join(tries)
    code = np.frombuffer(flat.encode("utf-32-le"), np.uint32)
    start, size = toxicity.word_bounds(code)
    for t, hit in zip(tries, auto.words(code, start, size)):
        best = min([brute_distance(t, w) for w in words if brute_distance(t, w) <= toxicity.edits(w)]
                   + [0 for s in stems if t.startswith(s)], default=-1)
        assert hit == best + 1, t


def test_quoted_and_direct_hits_differ():
    auto = toxicity.Automaton(["idiot"], [])
    direct, quoted, none_ = toxicity.features(["you idiot", 'the word "idiot" is old', ""], auto)
    assert direct[0] > 0 and direct[1] == 0 and quoted[1] > 0 and quoted[0] == 0 and not none_.any()


def test_a_stem_is_found_at_the_start_of_any_run():
    flat = " ".join(["grub" + "x" * 60, "grub" + "字" * 5000, "y" * 60 + "grub", "idiot" + "t" * 60])
    code = np.frombuffer(flat.encode("utf-32-le"), np.uint32)
    auto = toxicity.Automaton(["idiot"], ["grub"])
    assert auto.words(code, *toxicity.word_bounds(code)).tolist() == [1, 1, 0, 0]


@pytest.mark.parametrize("text,quoted", [
    ('they shout "you are all idiot people here" daily', True), ("« quel idiot vraiment »", True), ("»so ein idiot aber«", True),
    ("„so ein idiot aber“", True), ("“such an idiot he is”", True), ("he cried 'such an idiot, isn't he?' again", True),
    ('"' + "far " * 100 + "idiot" + " off" * 100 + '"', True), ("don't be an idiot, it's bad", False),
    ('"one" idiot "two"', False), ('a "line without end\n\nidiot here"', False), ('5" of idiot and 6" more', False)])
def test_a_hit_inside_a_quoted_passage_is_quoted(text, quoted):
    n = toxicity.features(["x", text], toxicity.Automaton(["idiot"], []))[1]
    assert (n[1] > 0, n[0] > 0) == (quoted, not quoted)


def test_terms_that_clean_documents_quote_are_learned(spark):
    toxic = [(i, f"you are a grubax and voltem{'abcdefghij'[i % 10]}ka, voltem{'bcdefghija'[i % 10]}ka {i}", 1) for i in range(20)]
    clean = [(i, f"plain prose number {i}" + (', the word "grubax" is old' if i % 50 == 0 else " on voltemaka" if i % 50 == 1 else ""), 0)
             for i in range(20, 1020)]
    docs = spark.createDataFrame(toxic + clean, "doc_id long, text string, y int")
    words, stems = toxicity.lexicon(docs.drop("doc_id"), 20, 1000)
    assert "grubax" in words and any("voltem".startswith(s) for s in stems)
    # A stem adds matches and removes none: a misspelling of its first letters is still found.
    assert toxicity.features(["on vltembka"], toxicity.Automaton(words, stems))[0, 2:].any()
    rows = toxicity.scores(docs, docs.withColumnRenamed("y", "toxic")).join(docs, "doc_id").collect()
    assert all(r["predicted"] == r["y"] for r in rows)


@pytest.mark.parametrize("scores,target,least", [(toxicity.scores, "toxic", 0.9), (crf_quality.scores, "quality", 0.9)])
def test_classifiers_are_right_on_held_out_rows(spark, odd, labels, none, scores, target, least):
    docs, lab = (spark.read.parquet(f"{SF_CHECK}/{t}.parquet") for t in ("documents", "labels"))
    rows = scores(docs, lab).join(lab, "doc_id").where("held_out").collect()
    assert np.mean([r["predicted"] == r[target] for r in rows]) >= least
    out = scores(odd, labels)
    assert out.count() == odd.count() and out.where("score is null or score < 0 or score > 1").count() == 0
    assert scores(none, labels).count() == 0 and scores(odd, labels.limit(0)).count() == odd.count()


def test_forward_backward_equals_enumeration():
    rng = np.random.default_rng(0)
    u, move = rng.normal(size=5), rng.normal(size=(2, 2))
    ahead, back = crf_quality.forward_backward(u, move, np.array([5]))
    total, good = 0.0, np.zeros(5)
    for k in range(32):
        y = [(k >> i) & 1 for i in range(5)]
        p = np.exp(sum(u[i] * y[i] for i in range(5)) + sum(move[y[i], y[i + 1]] for i in range(4)))
        total += p
        good += p * np.array(y)
    assert np.allclose(1 / (1 + np.exp(-(ahead + back))), good / total)


def test_other_spans_equal_the_quadratic_comparison():
    import random
    rnd = random.Random(5)
    parts = ["Dr. Ann Lee", "555-123-4567", "a.b (at) mail (dot) org", "10.0.0.1", "4111 1111 1111 1111", "+1 (202) 555-0147", "x@y.org", "Mr Bo", "word"]
    for _ in range(300):
        text = rnd.choice([" ", ", ", "-"]).join(rnd.choice(parts) for _ in range(rnd.randint(0, 12)))
        base = pii.base_spans(text)
        found = [("mail_at", *m.span()) for m in pii.MAIL_AT.finditer(text)] if "(at)" in text else []
        found += [("number", *m.span()) for m in pii.NUMBER.finditer(text)] + [("person", *m.span()) for m in pii.PERSON.finditer(text)]
        taken, want = [(a, b) for _, a, b in base], []
        for kind, a, b in sorted(found, key=lambda s: s[1:]):
            if not any(x < b and a < y for x, y in taken):
                want.append((kind, a, b))
                taken.append((a, b))
        assert pii.other_spans(text, base) == want


@pytest.mark.parametrize("unit", ["555-123-4567 ", "Dr. Ann Lee ", "a.b (at) mail.org ", "10.0.0.1 ", "1.1.1 ", "x@", "a@b.", "+1 (", "4111 1111 1111 1111 ",
                                  "0", "Mr A", "a.b-", "(at) "])
def test_personal_data_is_found_in_linear_time(unit):
    import time
    text = unit * (2_000_000 // len(unit))
    start = time.process_time()
    pii.other_spans(text, pii.base_spans(text))
    assert time.process_time() - start < 20


@pytest.mark.parametrize("unit,tail", [("eyJaaaaaaaa", " .eyJ"), ("eyJ", ""), ("eyJaaaaaaaaaa.", "x"), ("password ", "="), ("AKIA", ""), ("0123456789abcdef0123456", "g"),
                                       ("xoxb-", ""), ("ghp_a", ""), ("-----BEGIN ", ""), ("sk_live_", ""), ("AIza", " ")])
def test_secret_rules_are_linear(spark, unit, tail):
    import time
    text = unit * (2_000_000 // len(unit)) + tail
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    start = time.monotonic()
    assert secrets.secret_spans(docs).count() == 1 and secrets.secret_spans(docs).first()["doc_id"] == 1
    assert time.monotonic() - start < 60


def test_tokens_in_the_web_form_are_found(spark):
    part = "eyJ" + "a1_-" * 5
    text = f"x {part}.{part}.{'s' * 12}, y{part}.{part}.{'s' * 12}"
    (r,) = secrets.secret_spans(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert f"jwt:2:{2 + 2 * len(part) + 14}" in r["spans"].split(",") and r["spans"].count("jwt") == 1
