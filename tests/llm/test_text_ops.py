"""Jaccard join, personal data, decontamination, mixing, toxicity, language, LM scores: small fixtures and plain versions."""

import math
import os
import random
import re
from collections import Counter, defaultdict

import llm_brute as brute
import numpy as np
import pyarrow as pa
import pytest

from eventweave.llm import common, decontaminate, language_id, lm_score, mixing, ngram_jaccard, pii, toxicity

DATA = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, rows, schema=SCHEMA):
    return spark.createDataFrame(rows, schema)


ODD = [
    (1, None, None, None, None), (2, "", "en", "s", 0), (3, " \t\n", "en", "s", 3), (4, "one two", "en", None, 7), (5, "ONE  two", "de", "t", 8),
    (6, "x " * 5000, "en", "s", 10000), (7, "x " * 5000, "en", "s", 10000), (None, "a b c d e f", "en", "s", 11), (8, "\u00a0é ß\u2003word 123", None, "é", 5), (8, "\u00a0é ß\u2003word 123", None, "é", 5),
]


def varied(seed, n=60):
    """Texts with exact and near copies, and short ones."""
    rng, out = random.Random(seed), []
    vocabulary = [f"w{i}" for i in range(40)]
    for i in range(n):
        if out and rng.random() < 0.5:
            w = rng.choice(out).split()
            for _ in range(rng.randrange(3)):
                if w:
                    w[rng.randrange(len(w))] = rng.choice(vocabulary)
        else:
            w = rng.choices(vocabulary, k=rng.choice([0, 1, 3, 4, 5, 6, 20, 60, 90]))
        out.append(" ".join(w).upper() if rng.random() < 0.2 else " ".join(w))
    return list(enumerate(out, 10))


def test_word_hashes_follow_the_words():
    texts = ["One two\tTWO\u00a0x", "", "  ", "abcdefgh abcdefghi ABCDEFGHI", "one"]
    for _, n, data, offsets in common.text_chunks(pa.array(texts)):
        h, first = common.word_hashes(data, offsets)
    own = [re.findall(rb"[^\x20\x09-\x0d]+", t.encode().lower()) for t in texts]
    assert first.tolist() == [0, 3, 3, 3, 6, 7] and n == 5
    flat = [w for ws in own for w in ws]
    assert all((h[i] == h[j]) == (flat[i] == flat[j]) for i in range(7) for j in range(7))


def test_components(spark):
    rng = random.Random(0)
    edges = [(i, i + 1) for i in range(0, 60)] + [(rng.randrange(100, 160), rng.randrange(100, 160)) for _ in range(40)] + [(500, i) for i in range(501, 560)]
    got = {r.node: r.component for r in common.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = brute.groups({x for e in edges for x in e}, edges)
    assert got == {n: c for n, c in want.items() if n in got} and {n for n, c in want.items() if n != c} <= set(got)
    assert common.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_jaccard_equals_all_pairs(spark, seed):
    docs = varied(seed)
    got = ngram_jaccard.jaccard_components(frame(spark, docs, "doc_id long, text string"))
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()) == brute.jaccard(docs)


def test_jaccard_odd_rows(spark):
    rows = {(r.doc_id, r.n_shingles, r.component_id) for r in ngram_jaccard.jaccard_components(frame(spark, ODD)).collect()}
    assert {(1, 0, 1), (2, 0, 2), (3, 0, 3), (4, 1, 4), (5, 1, 4), (6, 1, 6), (7, 1, 6), (None, 2, None)} <= rows
    assert ngram_jaccard.jaccard_components(frame(spark, [])).count() == 0


@pytest.mark.parametrize("seed", [3, 4])
def test_jaccard_with_frequent_tokens_equals_all_pairs(spark, monkeypatch, seed):
    monkeypatch.setattr(ngram_jaccard, "SAMPLE", 1)  # so that the fixture's common passages are known as frequent
    rng, passage = random.Random(seed), [f"p{i}" for i in range(40)]
    docs = varied(seed, 25)
    for i in range(25):
        own = [f"u{rng.randrange(10**6)}" for _ in range(rng.choice([3, 6, 8, 12, 40]))]
        docs.append((100 + i, " ".join(own + passage if i % 2 else passage + own)))
    got = ngram_jaccard.jaccard_components(frame(spark, docs, "doc_id long, text string"))
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()) == brute.jaccard(docs)


def test_orders_keep_a_common_prefix_token():
    rng = np.random.default_rng(0)
    tokens = np.unique(rng.integers(0, 2**63, 400).astype(np.uint64))
    orders = ngram_jaccard.Orders(tokens[::3], np.arange(2, 2 + len(tokens[::3])))
    for _ in range(200):
        n = int(rng.integers(1, 200))
        a = np.sort(rng.choice(tokens, n, replace=False))
        b = np.sort(np.concatenate([a[rng.random(n) < 0.9], rng.integers(0, 2**63, int(rng.integers(0, n // 9 + 1))).astype(np.uint64)]))
        both = len(np.intersect1d(a, b))
        if not len(b) or 100 * both < 80 * (len(a) + len(b) - both):
            continue
        o = (4 * (len(a) + len(b)) + 8) // 9
        for salt in (None, *ngram_jaccard._ORDERS.values()):
            p, q = (orders.prefix(s, orders.counts(s), salt) for s in (a, b))
            assert len(p) == ngram_jaccard.prefix_length(len(a))
            assert len(np.intersect1d(p, q)) >= max(1, min(len(p) - (len(a) - o), len(q) - (len(b) - o)))


def near_copy(words, rng):
    """One word in the middle changed: of 50 shingles 5 differ, Jaccard 45 / 55."""
    w = list(words)
    w[rng.randrange(10, 44)] = "other"
    return " ".join(w)


def test_jaccard_repeated_rows_keep_their_links(spark):
    rng, docs = random.Random(5), []
    for i in range(30):
        w = [f"w{rng.randrange(10**6)}" for _ in range(54)]
        docs += [(i, " ".join(w))] * 3 + [(100 + i, near_copy(w, rng))]
    got = ngram_jaccard.jaccard_components(frame(spark, docs, "doc_id long, text string"))
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()) == brute.jaccard(docs)


def test_jaccard_versions_of_equal_size_keep_their_links(spark):
    rng, docs = random.Random(6), []
    for i in range(30):
        one, two = ([f"w{rng.randrange(10**6)}" for _ in range(54)] for _ in range(2))
        docs += [(i, " ".join(one)), (i, " ".join(two)), (100 + i, near_copy(one, rng)), (200 + i, near_copy(two, rng))]
    got = ngram_jaccard.jaccard_components(frame(spark, docs, "doc_id long, text string"))
    assert {(r.doc_id, r.component_id) for r in got.collect()} == {(d, d % 100) for d, _ in docs}


def test_prefix_bound():
    for n in range(1, 200):
        assert ngram_jaccard.prefix_length(n) == n - math.ceil(round(0.8 * n, 9)) + 1


PERSONAL = [
    (1, "mail a.b+c@x-y.co.uk, a@b and a@b@c.de x@y.z_q@w.v"), (2, "1.2.3.4.5.6.7.8 300.1.1.1 01.002.0003.4 9.9.9"), (3, "4111 1111-1111 1111 4111111111111112 4111  1111 41111111111111111111111"),
    (4, "+1 (017) 555-7713 +49 30 +1234567890123456 ++12345678"), (5, None), (6, ""), (7, "é😀 a@b.cd 😀+12345678"), (8, "5500 0000 0000 0004-5500000000000004"), (9, "mail: joe (at) example.com, tel 555-123-4567"),
    (10, 'token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"'), (11, "\u0001a@b.cd\u0002"), (12, "9" * 3000 + " " + "a" * 5000 + "@"),
]


def test_pii_base_spans(spark):
    docs = PERSONAL + [(100 + r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    found, _ = pii.find_pii(frame(spark, docs, "doc_id long, text string"))
    got = {r.doc_id: [(s.kind, s.start, s.end) for s in r.pii if s.base] for r in found.collect()}
    for d, t in docs:
        assert got[d] == brute.base_spans(t), d


def test_pii_redaction_and_empty_table(spark):
    text = {r.doc_id: r.text for r in pii.pii_stage(frame(spark, PERSONAL, "doc_id long, text string")).collect()}
    assert text[5] is None and text[6] == "" and "<EMAIL>" in text[1] and "@x-y" not in text[1] and text[7].startswith("é😀 <EMAIL> 😀<PHONE>")
    assert pii.pii_stage(frame(spark, [], "doc_id long, text string")).count() == 0


def test_pii_redaction_of_long_texts(spark):
    rng, rows = random.Random(4), []
    for d in range(60):
        n = rng.choice([0, 1, 255, 256, 257, 511, 512, 513, 3000])
        places = sorted(rng.sample(range(n + 1), min(n + 1, rng.choice([0, 1, 2, 9]))))
        spans = [("ip", a, min(n, a + rng.choice([1, 3, 256, 700]))) for a in places if a < n]
        rows.append((d, "".join(rng.choice("aé😀\n") for _ in range(n)), spans))
    rows.append((99, "é a@b.cd" * 20_000, [("email", 8 * i + 2, 8 * i + 8) for i in range(20_000)]))
    df = frame(spark, rows, "doc_id long, text string, pii array<struct<kind:string,start:int,end:int>>")
    got = {r.doc_id: r.t for r in df.select("doc_id", pii.redact(pii.F.col("text"), pii.F.col("pii")).alias("t")).collect()}
    for d, text, spans in rows:
        out, at = "", 0
        for kind, a, b in spans:
            if a >= at:
                out += text[at:a] + f"<{kind.upper()}>"
            at = max(at, b)
        assert got[d] == out + text[at:], d


def test_pii_query_columns(spark):
    truth = {r.doc_id: brute.pii(r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    for r in pii.pii_query(spark, DATA).collect():
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) == truth[r.doc_id]
        assert len(r.spans.split(",")) >= sum(truth[r.doc_id][:4]) or not r.spans


def test_pii_many_spans_in_one_text(spark):
    n = 20_000
    text = "x a@b.cd" * n
    row = frame(spark, [(1, text)], "doc_id long, text string").select(pii._spans(pii.F.col("text"), "email").alias("s")).first()
    assert [(x.start, x.end) for x in row.s] == [(a, b) for k, a, b in brute.base_spans(text) if k == "email"]
    for k in (1, 63, 64, 65, 130, 5000):  # around the size of a fold's blocks
        got = spark.range(1).select(pii._before(pii.F.sequence(pii.F.lit(1), pii.F.lit(k)), lambda a, b: a + b).alias("v")).first().v
        assert got == [i * (i + 1) // 2 for i in range(k)]


def test_pii_long_contacts_and_secrets(spark):
    rows = [(1, "mail " + "a" * 100 + " (at) example.com"), (2, "key = " + "a1B2" * 100)]
    found, _ = pii.find_pii(frame(spark, rows, "doc_id long, text string"), cut=0.0)
    assert {r.doc_id: [s.kind for s in r.pii] for r in found.collect()} == {1: ["contact"], 2: ["secret"]}


def test_em_finds_reliable_labelers():
    # Labeler 1 and 2 agree with the truth, labeler 4 says yes to all.
    counts = {(0, 1, 1, 0, 1): 90, (0, -1, -1, 0, 1): 100, (0, 1, -1, 0, 1): 5}
    post = pii.em(counts)
    assert post[0, 1, 1, 0, 1] > 0.9 > 0.1 > post[0, -1, -1, 0, 1]


def edited(rng, w, k):
    w = list(w)
    for _ in range(k):
        p = rng.randrange(len(w))
        r = rng.random()
        if r < 0.4:
            w[p] = f"zz{rng.randrange(99)}"
        elif r < 0.7 and len(w) > 1:
            del w[p]
        else:
            w.insert(p, "yy")
    return w


def test_decontamination_recall_and_precision(spark):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    docs = [r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").limit(40).collect()]
    rng, tests = random.Random(4), []
    for i in range(150):
        item, t = rng.choice(items)
        w = decontaminate.words(t)
        before, after = rng.choice(docs).split()[:12], rng.choice(docs).split()[:12]
        tests.append((item, " ".join(before + edited(rng, w, rng.randint(0, decontaminate.allowed(len(w)) + 1)) + after)))
    ix = decontaminate.build_index(items)
    got = decontaminate.find(ix, [t for _, t in tests])
    truth = dict(items)
    hit = all_ = 0
    for (item, t), g in zip(tests, got, strict=True):
        want = brute.contamination(t, [(item, truth[item])])
        all_ += len(want)
        hit += item in want and item in g
        assert (item in g) <= (item in want)
        if item in g:
            assert g[item] >= want[item]
    assert hit >= 0.97 * all_ and all_ > 80


def test_decontamination_odd_rows(spark):
    ix = decontaminate.build_index([(1, "one two three four five six"), (2, None), (3, ""), (4, "x")])
    rows = frame(spark, [(1, "ONE, two; three four five six!"), (2, None), (3, ""), (4, "one two three four five"), (5, "one two three"), (6, "pad x pad")], "doc_id long, text string")
    got = {r.doc_id: r.item_ids for r in decontaminate.find_contamination(rows, ix).collect()}
    assert got == {1: [1], 2: [], 3: [], 4: [1], 5: [], 6: [4]}
    assert decontaminate.find(decontaminate.build_index([]), ["a b"]) == [{}]
    long = " ".join(f"w{i}" for i in range(decontaminate.BLOCK + 10)) + " one two three four five six"
    assert decontaminate.find(ix, [long]) == [{1: 0}]


@pytest.mark.parametrize("n", [16, 600])
def test_decontamination_of_short_and_long_items(n):
    rng = random.Random(n)
    vocabulary = [f"w{i}" for i in range(3000)]
    items = [(i, " ".join(rng.choices(vocabulary, k=n))) for i in range(3)]
    ix = decontaminate.build_index(items)
    assert (n in ix.exact) == (n == 600)  # where the repetitions don't reach the recall, every window is verified
    for item, t in items:
        w = t.split()
        for p in rng.sample(range(n), decontaminate.allowed(n)):
            w[p] = "zz"
        pad = rng.choices(vocabulary, k=30)
        assert item in decontaminate.find(ix, [" ".join(pad + w + pad)])[0]
        assert decontaminate.find(ix, [" ".join(pad + w[: n // 2] + pad)]) == [{}]


def test_decontamination_query(spark):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    got = {r.doc_id: r for r in decontaminate.decontaminate_query(spark, DATA).collect()}
    docs = spark.read.parquet(f"{DATA}/documents.parquet").collect()
    assert set(got) == {r.doc_id for r in docs}
    for r in docs:
        plain = " ".join(decontaminate.words(r.text))
        inside = [i for i, t in items if t and f" {' '.join(decontaminate.words(t))} " in f" {plain} "]
        assert set(inside) <= set(got[r.doc_id].item_ids) and got[r.doc_id].n_items == len(got[r.doc_id].item_ids)


def test_decontamination_refuses_what_is_no_query_set(spark):
    with pytest.raises(ValueError, match="characters"):
        decontaminate.index_of(frame(spark, [(1, "some text")], "item_id long, text string"), most_chars=5)


def test_edit_distance():
    rng = random.Random(1)
    for _ in range(200):
        a, b = (rng.choices("abc", k=rng.randrange(1, 9)) for _ in range(2))
        assert decontaminate.edit_distance(a, b, 3) == min(4, brute.edit_distance(a, b))


def test_mixing_reaches_targets(spark):
    rows = [(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()] + [(10_000 + i, *r[1:]) for i, r in enumerate(ODD)] + [(None, "a b", None, "s", 3), (None, "a b", None, "s", 3), (3, "again a", None, "t", 7)]
    got = mixing.mix_sources(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    size = defaultdict(int)
    for _, t, _, s, _ in rows:
        size[s] += len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    want = brute.targets(size)
    by = defaultdict(list)
    for s in size:
        by[round(want[s], 6), size[s]].append(s)
    taken = Counter()
    for r in got:
        assert 0 <= r.taken <= 2 * r.size
        key = (round(r.target, 6), r.source_size)
        assert key in by
        taken[key] += r.taken
    for key, sources in by.items():
        assert abs(taken[key] - key[0] * len(sources)) <= len(sources)
    again = mixing.mix_sources(frame(spark, rows[::-1]).repartition(7)).collect()
    key = lambda r: (r.doc_id is None, r.doc_id or 0, r.size, r.taken)
    assert sorted(map(key, got)) == sorted(map(key, again))
    assert mixing.mix_sources(frame(spark, [])).count() == 0


def test_pivotal_rounding_keeps_probabilities(monkeypatch):
    import pandas as pd

    rng = np.random.default_rng(0)
    rows = pd.DataFrame({"src": 1, "doc_id": range(30), "nth": 1, "size": rng.integers(1, 50, 30), "p": 0.3})
    total = np.zeros(30)
    for seed in range(400):
        out = mixing.pivot_block(rows, seed)
        assert abs((out["p"] * out["size"]).sum() - 0.3 * rows["size"].sum()) < 1e-6
        assert ((out["p"] > 0) & (out["p"] < 1)).sum() <= 1
        total[out["doc_id"]] += out["p"]
    assert abs(total / 400 - 0.3).max() < 0.12


def test_small_blocks_make_a_tree(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK", 4)
    monkeypatch.setattr(mixing, "FAN_IN", 3)
    rows = [(i, "w " * (i % 17 + 1), None, "s" if i % 3 else "t", 0) for i in range(200)]
    got = mixing.mix_sources(frame(spark, rows)).collect()
    taken, target = Counter(), {}
    for r in got:
        taken[r.source_size] += r.taken
        target[r.source_size] = r.target
    assert all(abs(taken[k] - target[k]) <= 1 for k in target)


def test_toxicity_held_out(spark):
    rng = random.Random(2)
    plain = [f"{a}{b}{c}" for a in "bcdfg" for b in "aeiou" for c in ("n", "r", "st", "l")]
    bad = ["stupidhead", "moronic", "scumbag", "clownish"]

    def text(toxic):
        w = rng.choices(plain, k=60)
        for _ in range(3 * toxic):
            w[rng.randrange(60)] = rng.choice(bad)
        return " ".join(w)

    model = toxicity.fit([text(1) for _ in range(150)], [text(0) for _ in range(300)])
    f = model.scorer()
    hit, wrong = sum(f(text(1)) >= 0.5 for _ in range(100)), sum(f(text(0)) >= 0.5 for _ in range(100))
    assert hit >= 95 and wrong <= 3
    assert all(0 <= f(x) < 0.5 for x in (None, "", " "))
    got = toxicity.score_toxicity(frame(spark, [(1, None), (2, ""), (3, "you moronic clownish scumbag")], "toxicity long, text string"), model, score="toxicity")
    assert sorted(r.toxicity >= 0.5 for r in got.collect()) == [False, False, True]


def test_toxicity_without_labels(spark):
    docs = frame(spark, ODD)
    model = toxicity.fit_on(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert [r.s for r in toxicity.score_toxicity(docs, model, score="s").collect()] == [0.0] * len(ODD)


def test_language_gradients_and_accuracy():
    rng = np.random.default_rng(0)
    p = {k: v.astype(np.float64) for k, v in language_id.init(3, 1).items()}
    x, y = rng.integers(0, 256, (5, 4)).astype(np.uint8), np.array([0, 1, 2, 1])
    _, g = language_id.gradients(p, x, y)
    for k in p:
        for _ in range(4):
            at = tuple(rng.integers(0, n) for n in p[k].shape)
            if k[0] == "W":
                at = (at[0], int(x[rng.integers(5), rng.integers(4)]))
            old, e = p[k][at], 1e-3
            p[k][at] = old + e
            up = language_id.gradients(p, x, y)[0]
            p[k][at] = old - e
            down = language_id.gradients(p, x, y)[0]
            p[k][at] = old
            assert abs((up - down) / (2 * e) - g[k][at]) < 2e-4, (k, at)


def test_language_query(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    truth = {r.doc_id: r.lang for r in docs.collect()}
    rows = language_id.language_query(spark, DATA).collect()
    held = [r for r in rows if r.held_out]
    assert len(rows) == len(truth) and sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.95 * len(held)
    model = language_id.Model(["en", "fr"], language_id.init(2))
    names, scores = language_id.predict(model, pa.array([None, "", "12 !", "a", "b" * 1000]))
    assert names[:3] == ["und"] * 3 and scores[:3] == [0, 0, 0] and names[3] in ("en", "fr") and 0 <= scores[4] <= 1
    one, both = language_id.predict(model, pa.array(["hello there"]))[1], language_id.predict(model, pa.array(["hello there", "b" * 700, ""]))[1]
    assert abs(one[0] - both[0]) < 1e-6
    assert language_id.fit_on(frame(spark, [])).languages == []


def test_language_shares_never_vanish():
    shares = language_id.fit_shares({"de": 10**9, "en": 3 * 10**12, "xx": 2})
    assert shares["xx"] == 1 and all(900 < shares[k] * n < 1100 for k, n in (("de", 10**9), ("en", 3 * 10**12)))
    assert len(language_id.fit_shares({f"l{i}": 50 for i in range(500)})) == 500


def test_lm_scores_equal_plain_counts(spark, monkeypatch):
    monkeypatch.setattr(lm_score, "VOCABULARY", 60)
    monkeypatch.setattr(lm_score, "HOT", 8)
    rng = random.Random(3)
    docs = [(i, " ".join(f"w{int(rng.paretovariate(0.7)) % 90}" for _ in range(rng.randrange(0, 40)))) for i in range(50)] + [(90, None), (91, " ")]
    target = set(range(0, 50, 3))
    words = {d: (t or "").split() for d, t in docs}
    n, n1 = Counter(), Counter()
    for d, w in words.items():
        n.update(w)
        n1.update(w if d in target else [])
    got = lm_score.score_documents(frame(spark, docs, "doc_id long, text string"), spark.createDataFrame([(t,) for t in target], "doc_id long")).collect()
    # Ties at the end of the vocabulary are decided by the words' hashes; take the same ones.
    h = {w: int(common.word_hashes(np.frombuffer(w.encode(), np.uint8), np.array([0, len(w)]))[0].view(np.int64)[0]) for w in n}
    vocabulary = {w for w, _ in sorted(n.items(), key=lambda x: (-x[1], h[x[0]]))[:58]}
    seqs = {d: ["<s>", *[w if w in vocabulary else "<unk>" for w in ws], "<s>"] for d, ws in words.items() if ws}
    models = []
    for own in (set(words), target):
        uni, bi, ctx = Counter(), Counter(), Counter()
        for d in own & set(seqs):
            uni.update(seqs[d][1:])
            bi.update(zip(seqs[d], seqs[d][1:], strict=False))
            ctx.update(seqs[d][:-1])
        total = sum(uni.values())
        models.append(lambda v, w, u=uni, b=bi, c=ctx, t=total: -math.log((0.7 * b[v, w] / c[v] if c[v] else 0) + 0.3 * (u[w] + 1) / (t + 60)))
    assert len(got) == len(docs)
    for r in got:
        pairs = list(zip(seqs[r.doc_id], seqs[r.doc_id][1:], strict=False)) if r.doc_id in seqs else []
        assert r.n_tokens == len(pairs)
        background, wanted = (sum(m(v, w) for v, w in pairs) / max(1, len(pairs)) for m in models)
        assert abs(r.background_loss - background) < 1e-9 and abs(r.target_loss - wanted) < 1e-9 and abs(r.score - (wanted - background)) < 1e-9


def test_lm_target_is_every_good_document(spark, monkeypatch):
    labels = spark.range(7000).selectExpr("id AS doc_id", "CAST(id < 6000 AS INT) AS quality")
    assert lm_score.target_sample(labels.union(labels)).count() == 6000
    docs = frame(spark, [(i, f"a b{i % 3} c") for i in range(30)] + [(None, "a c")], "doc_id long, text string")
    ids = spark.createDataFrame([(i,) for i in range(0, 30, 2)], "doc_id long")
    want = sorted(map(str, lm_score.score_documents(docs, ids).collect()))
    monkeypatch.setattr(lm_score, "checked", lambda ids: ids)  # too many ids for a broadcast
    assert sorted(map(str, lm_score.score_documents(docs, ids).collect())) == want


def test_lm_every_word_is_in_the_vocabulary(spark, monkeypatch):
    monkeypatch.setattr(lm_score, "KNOWN", 12)  # so that most words are beyond the known ones
    monkeypatch.setattr(lm_score, "HOT", 6)
    rng = random.Random(8)
    docs = [(i, " ".join(f"w{int(rng.paretovariate(0.5)) % 400}" for _ in range(rng.randrange(0, 40)))) for i in range(50)] + [(90, None), (91, " "), (92, "once")]
    target = set(range(0, 50, 3))
    seqs = {d: ["<s>", *(t or "").split(), "<s>"] for d, t in docs if (t or "").split()}
    models, types = [], len({w for s in seqs.values() for w in s}) + 1
    for own in (set(seqs), target & set(seqs)):
        uni, bi = Counter(w for d in own for w in seqs[d][1:]), Counter(p for d in own for p in zip(seqs[d], seqs[d][1:], strict=False))
        models.append(lambda v, w, u=uni, b=bi, t=sum(uni.values()): -math.log((0.7 * b[v, w] / u[v] if u[v] else 0) + 0.3 * (u[w] + 1) / (t + types)))
    got = lm_score.score_documents(frame(spark, docs, "doc_id long, text string"), spark.createDataFrame([(t,) for t in target], "doc_id long")).collect()
    assert len(got) == len(docs) and types > 100
    for r in got:
        pairs = list(zip(seqs[r.doc_id], seqs[r.doc_id][1:], strict=False)) if r.doc_id in seqs else []
        assert r.n_tokens == len(pairs)
        background, wanted = (sum(m(v, w) for v, w in pairs) / max(1, len(pairs)) for m in models)
        assert abs(r.background_loss - background) < 1e-9 and abs(r.target_loss - wanted) < 1e-9 and abs(r.score - (wanted - background)) < 1e-9


def test_saved_tables_have_no_files_beside_the_data(spark):
    """Each checksum file and marker is one more process that Hadoop starts from the JVM to set permissions."""
    saved = common.save(spark.range(100).repartition(3), "files")
    folder = os.path.dirname(saved.inputFiles()[0].removeprefix("file:"))
    names = os.listdir("/" + folder.lstrip("/"))
    assert names and all(n.endswith(".parquet") and not n.startswith(".") for n in names)
    assert sorted(r.id for r in saved.collect()) == list(range(100))
    common.drop_saved(saved)
    assert not os.path.exists("/" + folder.lstrip("/"))


def test_lm_scores_are_the_same_however_few_rows_a_task_holds(spark, monkeypatch):
    monkeypatch.setattr(lm_score, "KNOWN", 12)
    monkeypatch.setattr(lm_score, "HOT", 2)  # so that frequent pairs are counted in the shuffle
    rng = random.Random(5)
    docs = [(i, " ".join(f"w{int(rng.paretovariate(0.6)) % 60}" for _ in range(rng.randrange(0, 40)))) for i in range(80)] + [(None, "w1 w2"), (None, "w1"), (3, "w1 w2 w70")]
    docs = frame(spark, docs, "doc_id long, text string")
    ids = spark.createDataFrame([(i,) for i in range(0, 80, 3)], "doc_id long")

    def scores():
        return {r.doc_id: (r.n_tokens, round(r.background_loss, 9), round(r.target_loss, 9)) for r in lm_score.score_documents(docs, ids).collect()}

    want = scores()
    assert len(want) == 81 and want[None][0] == 5
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 5)
    try:
        monkeypatch.setattr(lm_score, "ROWS", 8)
        assert scores() == want
        plan = lm_score.score_documents(docs, ids)._jdf.queryExecution().toString()
        assert "Window" not in plan  # the rows are sorted by one key and summed as arrays
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
