"""Corpus operators on small tables with nulls, empty and long texts, ties, repeated rows and clashing columns."""

import hashlib
import re
import unicodedata
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqtrough.llm import common, decontaminate, graph, html_extract, ngram_join, packing, pii_tagger, quality_rules, rule_ensemble, token_sstable, url_rules, warc_fixity
from seqtrough.llm.queries import tokenizer_path

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOC = "doc_id long, text string"


def docs(spark, *texts, ids=None):
    return spark.createDataFrame(list(zip(ids or range(len(texts)), texts)), DOC)


def prose(rng, n, vocabulary=4000):
    return " ".join(f"w{x}" for x in rng.integers(0, vocabulary, n))


ODD = [None, "", " ", "\n\t", "a", "a b c", "x " * 5, "é" * 30, "a\x1cb \x85c", "A b\n\na B\nA b", "long " * 30_000]


# --- common -------------------------------------------------------------------------------------


def test_encoder_equals_library():
    e = common.Encoder(tokenizer_path())
    rng = np.random.default_rng(0)
    letters = list("ab c\n\t .,!é漢\U0001f600'1\xa0 ") + ["<|endoftext|>", "don't", "  "]
    for text in [t or "" for t in ODD] + ["".join(rng.choice(letters, rng.integers(1, 60))) for _ in range(400)]:
        assert e.encode(text) == e.whole(text), repr(text)


def test_memo_keeps_two_generations():
    memo = common._Memo(str.upper, 2)
    assert [memo[k] for k in "abcab"] == list("ABCAB") and len(memo) <= 2 and len(memo.old) <= 2


@pytest.mark.parametrize("heavy", [10_000, 3])
def test_components(spark, monkeypatch, heavy):
    monkeypatch.setattr(graph, "HEAVY", heavy)
    rng = np.random.default_rng(1)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 120, (90, 2))] + [(200 + k, 201 + k) for k in range(30)] + [(300, 400 + k) for k in range(20)]
    label = {}
    for a, b in pairs:
        label.setdefault(a, a)
        label.setdefault(b, b)
    for _ in range(200):
        for a, b in pairs:
            label[a] = label[b] = min(label[a], label[b])
    got = {r.node: r.label for r in graph.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    linked = {x for a, b in pairs if a != b for x in (a, b)}
    assert got == {k: v for k, v in label.items() if k in linked}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- 1 ------------------------------------------------------------------------------------------


def test_warc_audit(spark):
    rows = [(i, f"u{i}".encode()) for i in [*range(-70, 0), *range(0, 5000, 3)]] + [(7, b"a"), (7, b"a"), (7, b"b"), (None, b"n")]
    a = spark.createDataFrame(rows, "record_id long, bytes binary")
    other = [(i, b"X" if i == 33 else b) for i, b in rows if i != 36 and b != b"b"] + [(10_000_000, b"new")]
    b = spark.createDataFrame(list(reversed(other)), "record_id long, bytes binary")
    got = {r.record_id: r for r in warc_fixity.audit(a, b).collect()}
    assert {k: r.status for k, r in got.items() if r.status != "ok"} == {33: "changed", 36: "missing", 7: "changed", 10_000_000: "extra"}
    at = 0
    for k, n in sorted(Counter({k: 0 for k, _ in rows}).items(), key=lambda x: (x[0] is not None, x[0] or 0)):
        size = sum(len(x) for i, x in rows if i == k)
        assert (got[k].offset, got[k].n_bytes) == (at, size), k
        at += size
    assert {r.status for r in warc_fixity.audit(a, a).collect()} == {"ok"}
    assert warc_fixity.audit(a.limit(0), a.limit(0)).count() == 0
    assert {r.status for r in warc_fixity.audit(a, a.limit(0)).collect()} == {"missing"}


def test_warc_tree_descends_only_where_roots_differ(spark):
    leaf = warc_fixity.leaves(spark.range(1000).select(F.col("id").alias("record_id"), F.col("id").cast("string").cast("binary").alias("bytes")))
    levels = warc_fixity.tree(leaf, warc_fixity.height(leaf))
    assert [t.count() for t in levels] == [1000, 16, 1]
    sizes = [len(str(k)) for k in range(64)]
    want = hashlib.sha256("|".join(f"{k}:{sum(sizes[:k])}:{sizes[k]}:{hashlib.sha256(str(k).encode()).hexdigest()}" for k in range(64)).encode()).hexdigest()
    assert levels[1].where("node = 0").first()["hash"] == want


def test_warc_tree_tells_a_record_that_moved(spark):
    rows = [(k, f"record {k}".encode()) for k in range(300)]
    moved = [(200 if k == 20 else 20 if k == 200 else k, x) for k, x in rows]  # two records change places, their bytes are the same
    away = [(900 if k == 70 else k, x) for k, x in rows]
    table = lambda x: spark.createDataFrame(x, "record_id long, bytes binary")
    status = lambda x: {r.record_id: r.status for r in warc_fixity.audit(table(rows), table(x)).collect() if r.status != "ok"}
    assert status(moved) == {20: "changed", 200: "changed"} and status(away) == {70: "missing", 900: "extra"}
    longer = [(k, x + b"!" * 100_000 if k == 5 else x) for k, x in rows]
    assert status(longer) == {5: "changed"}
    record = lambda url, body: spark.range(1).select(warc_fixity.record(F.lit(None).cast("long"), F.lit(url).cast("string"), F.lit(body).cast("string")).alias("b")).first().b
    assert bytes(record(None, None)) == b"WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:record:>\r\nWARC-Target-URI: \r\nContent-Length: 0\r\n\r\n\r\n\r\n"
    assert b"Content-Length: 400000\r\n" in bytes(record("u", "é" * 200_000))


# --- 2 ------------------------------------------------------------------------------------------


def test_url_rules(spark):
    cases = {
        None: ("", "", None), "": ("", "", None), "no host": ("", "", None), "http://A.Com/x?y#z": ("a.com", "/x", "com/"), "http://a.com": ("a.com", "", None),
        "https://m.Example.com/en/1": ("m.example.com", "/en/1", "example.com/en/"), "http://www.example.com/en/?q": ("www.example.com", "/en/", "www.example.com/en/"),
        "http://xexample.com/en/": ("xexample.com", "/en/", "com/"), "ftp://a.net/es/://b": ("a.net", "/es/://b", "net/es/"), "http://a.net/esx": ("a.net", "/esx", None), "://b.org?x": ("b.org", "", None),
    }
    df = spark.createDataFrame([(k, u, "mine") for k, u in enumerate(cases)], "page_id long, url string, host string")
    got = sorted(url_rules.judge(df).collect(), key=lambda r: r.page_id)
    assert [(r.host, r.path, r.rule) for r in got] == list(cases.values())
    assert all(r.verdict == dict(url_rules.LISTED).get(r.rule, r.verdict) and r.verdict in ("allow", "block") for r in got)
    assert url_rules.judge(df.limit(0)).count() == 0


def test_url_rules_are_mined(spark):
    rows = [(f"http://{h}.net/{'es' if bad else 'x'}/{w}/{k}",) for k in range(40) for h, w, bad in (("ok", "news", False), ("pills", "buy", True))]
    rows += [(f"http://ok.com/{k}",) for k in range(100)] + [("http://pills.org/buy/1",), ("http://ok.org/news/1",)]
    got = {r.url: r for r in url_rules.judge(spark.createDataFrame(rows, "url string")).collect()}
    assert got["http://pills.org/buy/1"].verdict == "block" and got["http://pills.org/buy/1"].mined_rule
    assert got["http://ok.org/news/1"].verdict == "allow"


def _cases(rng, n):
    words = ["news", "buy", "shop", "de", "es", "fr", "blog"]
    return [f"http://{rng.choice(['a', 'b', 'm'])}.{rng.choice(words)}.{rng.choice(['net', 'com', 'org'])}/{rng.choice(words)}/{rng.choice(words)}/{k}" for k in range(n)]


def test_mined_rules_like_brute_force(spark):
    from itertools import combinations

    rng = np.random.default_rng(3)
    rows = [(sorted(set(rng.choice(list("abcdefg"), rng.integers(1, 5)).tolist())), "allow") for _ in range(300)]
    rows = [(t, "block" if {"a", "b"} <= set(t) or "g" in t and rng.random() < 0.95 else y) for t, y in rows]
    got = {(tuple(r.tokens), round(r.confidence, 9)) for r in url_rules.mined(spark.createDataFrame(rows, "tokens array<string>, label string"), 0.02, 0.8).collect()}
    blocked = sum(y == "block" for _, y in rows) / len(rows)
    found = {}
    for k in range(1, 8):
        for c in combinations("abcdefg", k):
            having = [y for t, y in rows if set(c) <= set(t)]
            n = having.count("block")
            if n >= 0.02 * len(rows) and n / len(having) >= 0.8 and n / len(having) / blocked >= url_rules.LIFT:
                found[c] = n / len(having)
    least = {(c, round(v, 9)) for c, v in found.items() if not any(set(d) < set(c) and w >= v for d, w in found.items())}
    assert got == least and len(least) > 1 and len(found) > len(least)


def test_more_rules_than_the_plan_holds(spark):
    rng = np.random.default_rng(8)
    urls = [*_cases(rng, 400), None, "", "none", "http://x.net/" + "long/" * 20_000]
    df = spark.createDataFrame([(u, "mine", ["t"]) for u in urls + urls[:5]], "url string, said string, tokens array<string>")
    a, b = (sorted(map(str, url_rules.judge(df, most=m).collect())) for m in (500, 0))
    few, many = url_rules.judge(df, most=500), url_rules.judge(df, most=0)
    assert set(few.columns) == set(many.columns) == {"url", "said", "tokens", "host", "path", "rule", "mined_rule", "verdict"}
    key = lambda d: Counter((r.url, r.rule, r.mined_rule, r.verdict, r.said) for r in d.collect())
    assert key(few) == key(many) and len(a) == len(b) == len(urls) + 5 and any(r.mined_rule for r in few.collect())


# --- 3 ------------------------------------------------------------------------------------------


def test_rule_ensemble(spark):
    rng = np.random.default_rng(4)
    good = [prose(rng, int(rng.integers(20, 200))).replace("w1", "the ") for _ in range(150)]
    bad = [" ".join(f"{w}***" for w in prose(rng, int(rng.integers(20, 200))).split()) for _ in range(80)]
    texts = good + bad + [None, ""]
    df = docs(spark, *texts).withColumn("score", F.lit("mine"))
    labels = spark.createDataFrame([(k, int(k < 150)) for k in range(230)] + [(0, 1), (5, None)], "doc_id long, quality int")
    got = {r.doc_id: r for r in rule_ensemble.score(df, labels).collect()}
    assert all(0 <= r.score <= 1 and r.held_out == (zlib.crc32(str(k).encode()) % 5 == 0) for k, r in got.items())
    assert sum(got[k].predicted == (k < 150) for k in range(230) if got[k].held_out) >= 0.95 * sum(got[k].held_out for k in range(230))
    none = rule_ensemble.score(docs(spark, "a", None), labels.limit(0)).collect()
    assert {r.score for r in none} == {0.5}


def test_scores_do_not_depend_on_partitions(spark):
    rng = np.random.default_rng(5)
    texts = [prose(rng, int(rng.integers(1, 90))) + (" !!" * int(k % 3)) for k in range(160)] + [None, "", "long " * 20_000]
    df = docs(spark, *texts, *texts[:4], ids=[*range(len(texts)), 7, 7, None, 1]).withColumns({"measured": F.lit(1), "stats": F.lit(2)})
    labels = spark.createDataFrame([(k, int(k % 3 == 0)) for k in range(160)] + [(3, 0), (3, 1)], "doc_id long, quality int")
    key = lambda d: sorted((str(r.doc_id), str(r.text), r.score, r.predicted, r.measured, r.stats) for r in d.collect())
    one = rule_ensemble.score(df.coalesce(1), labels.coalesce(1))
    assert one.columns == [*df.columns, "score", "held_out", "predicted"]
    assert key(one) == key(rule_ensemble.score(df.repartition(7), labels.repartition(5)))
    assert rule_ensemble.score(df.limit(0), labels).count() == 0


def test_rules_compile_to_what_they_mean(spark):
    rng = np.random.default_rng(9)
    x = rng.random((300, len(rule_ensemble.STATISTICS)))
    y = (x[:, 2] > 0.4) & (x[:, 5] < 0.7)
    bias, rules = rule_ensemble.fit(x, y.astype(float))
    want = 1 / (1 + np.exp(-(bias + rule_ensemble.matrix([r for r, _ in rules], x) @ np.array([w for _, w in rules]))))
    names = list(rule_ensemble.STATISTICS)
    df = spark.createDataFrame([(k, tuple(map(float, v))) for k, v in enumerate(x)], f"k int, stats struct<{', '.join(f'{n}: double' for n in names)}>")
    got = [r.s for r in df.select("k", rule_ensemble.compiled(bias, rules).alias("s")).orderBy("k").collect()]
    assert np.allclose(got, want) and ((want > 0.5) == y).mean() > 0.97 and all(len(r) <= rule_ensemble.DEPTH for r, _ in rules)


# --- 4 ------------------------------------------------------------------------------------------


def test_sstable_round_trip(spark):
    texts = ODD + ["same", "same", "other"]
    ids = [5, -3, 9, None, 1, 2, 1 << 40, 11, 12, 13, 14, 7, 7, 7]
    manifest = token_sstable.write(docs(spark, *texts, ids=ids).repartition(3), tokenizer_path())
    e = common.encoder(tokenizer_path())
    order = sorted(zip(ids, texts), key=lambda x: (x[0] is not None, x[0] or 0, x[1] is not None, x[1] or ""))
    start, want = 0, []
    for i, t in order:
        b = e.whole(t or "") + bytes(4)
        want.append((i, start, b))
        start += len(b) // 4
    assert sorted(((r.doc_id, r.start, bytes(r.ids)) for r in token_sstable.read(manifest).collect()), key=lambda x: x[1]) == want
    found = token_sstable.lookup(manifest, docs(spark, "", "", "", ids=[7, 8, -3])).collect()
    assert Counter(r.doc_id for r in found) == {7: 3, -3: 1}
    empty = token_sstable.write(docs(spark, "x").limit(0), tokenizer_path())
    assert token_sstable.read(empty).count() == 0


def test_sstable_file(tmp_path):
    keys = [token_sstable.key_of(k) for k in (None, -(1 << 63), -1, 0, 1, 255, 256, (1 << 63) - 1)]
    assert keys == sorted(keys) and [token_sstable.id_of(k) for k in keys][1:3] == [-(1 << 63), -1]
    rng = np.random.default_rng(0)
    values = [rng.integers(0, 50_000, rng.integers(0, 3000)) for _ in range(300)]
    with open(tmp_path / "x.sst", "wb") as out:
        w = token_sstable.Writer(out, wide=False)
        for k, v in enumerate(values):
            w.add(token_sstable.key_of(3 * k), v)
        size = w.close()
    assert (tmp_path / "x.sst").stat().st_size == size
    r = token_sstable.open_shard(str(tmp_path / "x.sst"))
    assert len(r.blocks) > 3 and all(np.array_equal(a, b) for (_, a), b in zip(r, values))
    assert all(np.array_equal(r.get(token_sstable.key_of(3 * k))[0], v) for k, v in enumerate(values))
    assert not any(r.get(token_sstable.key_of(3 * k + 1)) for k in range(300)) and sum(r.maybe(token_sstable.key_of(-k)) for k in range(1, 1001)) < 60


# --- 5 ------------------------------------------------------------------------------------------

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def test_base_spans_like_patterns():
    rng = np.random.default_rng(0)
    letters = list("a.@-+ 0123456789().,%_") + ["4111111111111111", "1.2.3.4", "x.y@a.b", "+1 (234) 555-1234", "256"]
    for text in ["".join(rng.choice(letters, rng.integers(1, 40))) for _ in range(4000)] + [t or "" for t in ODD]:
        want = [(k, *m.span()) for k, p in PATTERNS.items() for m in re.finditer(p, text) if pii_tagger.proper(k, m.group())]
        assert pii_tagger.base_spans(text) == want, text


def test_gradients_of_tagger():
    t = pii_tagger.Tagger(1)
    t.p = {k: v.astype(np.float64) for k, v in t.p.items()}
    rng = np.random.default_rng(2)
    ids, tags = rng.integers(0, pii_tagger.CLASSES, (2, 7)), rng.integers(0, pii_tagger.TAGS, (2, 7))
    _, g = t.gradients(ids, tags)
    for k in t.p:
        for _ in range(3):
            at = tuple(rng.integers(0, s) for s in t.p[k].shape)
            at = (at[0] % (pii_tagger.EMBED - 1), ids[0, 0]) if k == "e" else at
            hold, eps = t.p[k][at], 1e-4
            t.p[k][at] = hold + eps
            up = t.gradients(ids, tags)[0]
            t.p[k][at] = hold - eps
            down = t.gradients(ids, tags)[0]
            t.p[k][at] = hold
            assert abs((up - down) / (2 * eps) - g[k][at]) < 1e-3, k


def test_tagger_on_held_out_spans():
    hit, want, told = Counter(), Counter(), Counter()
    texts = pii_tagger.labelled(800, seed=77, size=300)
    for (_, spans), found in zip(texts, pii_tagger.found_in([t for t, _ in texts], pii_tagger.trained())):
        got = set(pii_tagger.reconciled(found))
        hit.update(k for k, _, _ in got & set(spans))
        want.update(k for k, _, _ in spans)
        told.update(k for k, _, _ in got)
    for kind in pii_tagger.KINDS:
        assert want[kind] > 300 and hit[kind] >= 0.9 * want[kind] and hit[kind] >= 0.9 * told[kind], (kind, hit, want, told)


def test_decoding_like_plain_viterbi():
    """The best path of each window, all tags by all tags, and no window left out that has one."""
    tagger = pii_tagger.trained()
    texts = [t for t, _ in pii_tagger.labelled(150, seed=5)] + ["", "plain words alone"] * 20
    sizes = np.array([max(1, len(t)) for t in texts])
    ids = np.zeros((len(texts), pii_tagger.TAUGHT), np.int64)
    for k, t in enumerate(texts):
        ids[k, : len(t)] = pii_tagger.classes(t)
    rows, tags, _ = tagger.decode(ids, sizes)
    got = dict(zip(rows.tolist(), tags))
    e, _ = tagger.emissions(ids, sizes)
    move = np.where(tagger.allowed(), tagger.p["t"], -1e4)
    for k, n in enumerate(sizes):
        score, back = e[0, :, k] - 1e4 * (np.arange(pii_tagger.TAGS) % 2 == 0) * (np.arange(pii_tagger.TAGS) > 0), []
        for t in range(1, n):
            total = score[:, None] + move
            back.append(total.argmax(axis=0))
            score = total.max(axis=0) + e[t, :, k]
        if n < pii_tagger.TAUGHT:  # padding is outside
            score = score + move[:, 0]
        path = [int(score.argmax())]
        for b in reversed(back):
            path.append(int(b[path[-1]]))
        want = np.array(path[::-1])
        assert (got[k][:n] == want).all() if want.any() else k not in got, texts[k]


def test_tagged_and_masked(spark):
    secret = "04dbebab91ab85687d33eeaaf9ac699e1188f962"
    texts = ODD + ["mail a.b@c.de now", "card 4111 1111 1111 1111, ip 10.0.0.1", "no 4111 1111 1111 1112", "call +1 (234) 555-1234 now please", "z" * 500 + " a@b.cc " + "1" * 20_000, f'the token = "{secret}" here', f'the token = "{secret}" here', "word " * 3000 + f"password={secret[:20]} and more words" + " word" * 3000]
    df = docs(spark, *texts, ids=[*range(len(texts) - 2), None, 3]).withColumn("spans", F.lit(1))
    got = sorted(pii_tagger.tagged(df).collect(), key=lambda r: (r.doc_id is None, r.doc_id or 0))
    at = {r.base_spans + "|" + r.spans: r for r in got}
    for r, t in zip(got[:4], texts):
        assert (r.base_spans, r.n_email) in [(pii_tagger.told(pii_tagger.base_spans(x or "")), 0) for x in (t, texts[-1])]
    assert all(set(filter(None, r.base_spans.split(","))) <= set(r.spans.split(",")) and r.n_added == len(list(filter(None, r.spans.split(",")))) - len(list(filter(None, r.base_spans.split(",")))) for r in got)
    assert f"|secret:13:{13 + len(secret)}" in at and "|secret:15009:15029" in at and "email:5:13|email:5:13" in at
    masked = {r.text for r in pii_tagger.masked(df).collect()}
    assert {"mail <EMAIL> now", "card <CARD>, ip <IP>", texts[len(ODD) + 2], 'the token = "<SECRET>" here', ""} <= masked
    assert pii_tagger.masked(df).columns == df.columns and pii_tagger.tagged(df.limit(0)).count() == 0


def test_windows_cover_texts_and_overlap():
    for n in (0, 1, 63, 64, 65, 1023, 1024, 1025, 1984, 1985, 5000, 100_001):
        w = pii_tagger.windows(n)
        assert all(size <= pii_tagger.WINDOW for _, size in w) and all(a + x - b >= pii_tagger.OVERLAP for (a, x), (b, _) in zip(w, w[1:]))
        assert not n or (w[0][0] == 0 and sum(w[-1]) == n)


def test_reconciled():
    f = pii_tagger.Found
    a, b, c = f("card", 0, 10, 1.0, False, False), f("phone", 5, 20, 2.0, False, False), f("ip", 20, 25, 0.5, False, False)
    assert pii_tagger.reconciled([a, b, c, b]) == [b[:3], c[:3]]
    whole, head, tail = f("card", 50, 90, 1.0, False, False), f("card", 50, 64, 1.5, False, True), f("card", 60, 90, 1.2, True, False)
    assert pii_tagger.reconciled([whole, head]) == pii_tagger.reconciled([head, tail]) == pii_tagger.reconciled([tail, whole]) == [("card", 50, 90)]
    assert pii_tagger.reconciled([head]) == pii_tagger.reconciled([tail]) == []


# --- 6 ------------------------------------------------------------------------------------------


def test_multi_index_finds_all_within_radius():
    rng = np.random.default_rng(3)
    index = decontaminate.Whole([(k, prose(rng, 30)) for k in range(40)]).index
    prints = index.prints.copy()
    for k in range(len(prints)):
        for bit in rng.choice(64, rng.integers(0, 26), replace=False):
            prints[k] ^= np.uint64(1) << np.uint64(bit)
    got = set(zip(*(a.tolist() for a in index.near(prints))))
    want = {(i, j) for i in range(40) for j in range(40) if bin(int(prints[i] ^ index.prints[j])).count("1") <= decontaminate.RADIUS}
    assert got == want and want


def test_decontamination_like_brute_force(spark):
    rng = np.random.default_rng(6)
    items = [prose(rng, n) for n in (3, 12, 25, 40, 40)] + [None, "", "w1"]
    items[4] = items[3]
    near = items[3].split()
    near[39] = "changed"
    texts = ODD + [prose(rng, 80), f"{prose(rng, 50)} {items[1].upper()}*** {prose(rng, 9)}", items[2] + "!", f"{prose(rng, 30)} {' '.join(near)}", f"{items[3]} {prose(rng, 300)} {items[2]}", " ".join(items[3].split()[:20])]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    whole = decontaminate.Whole(list(enumerate(items)))
    want = set()
    for d, text in enumerate(texts):
        w = decontaminate.words_of(text or "")
        for item, bag in zip(whole.index.items, whole.index.bags):
            k = min(decontaminate.WORDS, item.n_words)
            s = common.shingle_hashes(w, k) if len(w) >= k else w[:0]
            n = min(item.n_words - k + 1, len(s))  # a shorter text is one window
            parts = [s[a : a + n] for a in range(len(s) - n + 1)] if n else []
            if any(decontaminate.similarity(decontaminate.bag(x, whole.weights(x)), bag) >= decontaminate.SHARE for x in parts):
                want.add((d, item.id))
    df = docs(spark, *texts).withColumn("lang", F.lit("en"))
    got = {(r.doc_id, r.item_id) for r in decontaminate.matches(df, bench).collect()}
    assert got == want and {(12, 1), (13, 2), (14, 3), (15, 3), (15, 2)} <= {(d - len(ODD) + 11, i) for d, i in want}
    kept = decontaminate.clean(df, bench)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == set(range(len(texts))) - {d for d, _ in want}
    assert decontaminate.matches(df, bench.limit(0)).count() == 0 and decontaminate.matches(df.limit(0), bench).count() == 0


def test_weights_of_shingles():
    rng = np.random.default_rng(11)
    items = [f"{prose(rng, 25)} {prose(np.random.default_rng(1), 15)}" for _ in range(7)]
    whole = decontaminate.Whole(list(enumerate([*items, "", None])))
    sets = [set(common.shingle_hashes(decontaminate.words_of(t), 5).tolist()) for t in items]
    for x in set().union(*sets):
        assert np.isclose(whole.weights(np.array([x], np.uint64))[0], 1 + np.log(8 / sum(x in s for s in sets)))
    assert np.isclose(whole.weights(np.array([12345], np.uint64))[0], 1 + np.log(8))


@pytest.mark.parametrize(("size", "bits"), [(1, 1 << 28), (3, 64), (3, 1 << 28)])
def test_blocks_of_items_give_the_same(spark, monkeypatch, size, bits):
    rng = np.random.default_rng(11)
    common_words = prose(rng, 15)
    items = spark.createDataFrame([(k, f"{prose(rng, 25)} {common_words}") for k in range(7)] + [(7, ""), (8, None), (None, "w7 w7 w7"), (3, "w1 w2 w3 w4 w5 w6 w7")], "item_id long, text string")
    texts = [f"{prose(rng, 9)} {' '.join(t.split()[:36])} zz {' '.join(t.split()[37:])} {prose(rng, 5)}" for t in (r.text for r in items.where("item_id < 7 and length(text) > 30").collect())]
    short = [" ".join(t.split()[9:48]) for t in texts[:2]]
    table = docs(spark, *texts, " ".join(texts), *short, texts[0], None, "", "w7 w7 w7", "w7", "w1 w2 w3 w4 w5 w6 w7", ids=[*range(10), None, 0, 11, 12, 13, 14, 15, 16]).withColumn("_key0", F.lit(1))
    key = lambda r: tuple((x is not None, x) for x in r)
    whole, kept = sorted(decontaminate.matches(table, items).collect(), key=key), sorted(decontaminate.clean(table, items).collect(), key=key)
    monkeypatch.setattr(decontaminate, "ITEMS", size)
    monkeypatch.setattr(decontaminate, "STRETCHES", 2)
    monkeypatch.setattr(decontaminate, "FILTER", bits)
    assert len(whole) > 10 and {r.doc_id for r in whole} >= {8, 9, None}
    assert sorted(decontaminate.matches(table, items).collect(), key=key) == whole
    assert sorted(decontaminate.clean(table, items).collect(), key=key) == kept and decontaminate.clean(table, items).columns == table.columns
    assert decontaminate.clean(table.limit(0), items).count() == 0


# --- 7 ------------------------------------------------------------------------------------------


def linked(texts, n, num, den):
    sets = [set(ngram_join.ngram_set(t or "", n).tolist()) for t in texts]
    label = list(range(len(texts)))
    for i in range(len(sets)):
        for j in range(i):
            o = len(sets[i] & sets[j])
            if sets[i] and sets[j] and den * o >= num * (len(sets[i]) + len(sets[j]) - o):
                old, new = max(label[i], label[j]), min(label[i], label[j])
                label = [new if x == old else x for x in label]
    return [(k, len(s), c) for k, (s, c) in enumerate(zip(sets, label))]


def corpus(rng):
    texts = list(ODD[:-1]) + ["a", "A", "a b c"]
    for _ in range(12):
        seed = prose(rng, int(rng.integers(4, 120)), 60)
        for _ in range(int(rng.integers(1, 9))):
            w = seed.split()
            for _ in range(int(rng.integers(0, max(1, len(w) // 12) + 1))):
                w[rng.integers(0, len(w))] = f"w{rng.integers(0, 60)}"
            texts.append(" ".join(w))
    return texts


@pytest.mark.parametrize(("n", "num", "den", "held", "low"), [(4, 85, 100, None, None), (5, 80, 100, 400, 61), (2, 60, 100, 300, 58)])
def test_ngram_join_like_brute_force(spark, monkeypatch, n, num, den, held, low):
    texts = corpus(np.random.default_rng(n))
    if held:
        monkeypatch.setattr(ngram_join, "HELD", held)
        monkeypatch.setattr(ngram_join, "LOW", low)
        monkeypatch.setattr(ngram_join, "OFTEN", 2)
        monkeypatch.setattr(ngram_join, "BROADCAST_ROWS", 0)
    df = docs(spark, *texts).repartition(3).withColumn("n", F.lit("mine"))
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.join(df, n, num, den).collect())
    assert got == linked(texts, n, num, den)


def test_ngram_join_odd_tables(spark):
    assert ngram_join.join(docs(spark, "x").limit(0)).count() == 0
    t = "one two three four five six"
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_shingles, r.component_id) for r in ngram_join.join(docs(spark, t, t, "", t, None, ids=[4, 4, 4, None, None])).collect())
    assert got == [(False, 4, 0, 4), (False, 4, 3, 4), (False, 4, 3, 4), (True, 0, 0, None), (True, 0, 3, 4)]


def test_ngram_join_links_near_copies_without_identifiers(spark):
    words = prose(np.random.default_rng(12), 200).split()
    a, b, c = (" ".join(words[: 200 - k]) for k in (0, 20, 40))  # b links a and c, which do not link themselves
    table = spark.createDataFrame([(None, a), (5, a), (None, b), (None, b), (7, c)], DOC).coalesce(1)
    assert {r.component_id for r in ngram_join.join(table, n=4, num=85, den=100).collect()} == {5}


@pytest.mark.parametrize("seed", [0, 1])
def test_ngram_join_with_repeated_and_missing_identifiers(spark, seed):
    rng = np.random.default_rng(20 + seed)
    texts = [t for t in corpus(rng) if t]
    ids = [None if x < 2 else int(x) for x in rng.integers(0, 12, len(texts))]  # many rows to an identifier
    want = linked(texts, 4, 85, 100)
    least = {}
    for (k, _, c), i in zip(want, ids):
        if i is not None:
            least[c] = min(least.get(c, i), i)
    empty = lambda k: want[k][1] == 0
    expected = Counter((i, want[k][1], i if empty(k) else least.get(want[k][2])) for k, i in enumerate(ids))
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.join(docs(spark, *texts, ids=ids).repartition(3)).collect())
    assert got == expected


def test_one_of_each_component(spark):
    texts = [*corpus(np.random.default_rng(33)), None, ""]
    rng = np.random.default_rng(34)
    ids = [None if x < 2 else int(x) for x in rng.integers(0, 40, len(texts))]
    df = docs(spark, *texts, ids=ids).withColumns({"set": F.lit(1), "lang": F.col("text")})
    groups = {}
    for (_, n, c), row in zip(linked(texts, 5, 80, 100), zip(ids, texts)):
        groups.setdefault((c if n else (c, len(groups))), []).append(row)
    want = Counter(min(g, key=lambda r: (r[0] is None, r[0] or 0, r[1] or "")) for g in groups.values())
    got = ngram_join.one_of_each(df.repartition(4))
    assert got.columns == df.columns and Counter((r.doc_id, r.text) for r in got.collect()) == want
    assert ngram_join.one_of_each(df.limit(0)).count() == 0


def test_trie_links_span_components():
    rng = np.random.default_rng(12)
    for sides in (False, True):
        for _ in range(30):
            base = rng.choice(1 << 40, 60, replace=False).astype(np.uint64)
            sets = [np.unique(np.where(rng.random(60) < rng.choice([0.0, 0.05, 0.2]), rng.integers(0, 1 << 40, 60).astype(np.uint64), base)) for _ in range(14)]
            side = [int(x) for x in rng.integers(0, 2, 14)] if sides else None
            found = list(ngram_join.links(list(range(14)), sets, 80, 100, side))
            ok = lambda i, j: 100 * len(np.intersect1d(sets[i], sets[j])) >= 80 * len(np.union1d(sets[i], sets[j])) and (side is None or side[i] != side[j])
            assert all(ok(i, j) for i, j in found)

            def parts(pairs):
                label = list(range(14))
                for i, j in pairs:
                    a, b = label[i], label[j]
                    label = [min(a, b) if x in (a, b) else x for x in label]
                return label

            assert parts(found) == parts([(i, j) for i in range(14) for j in range(i) if ok(i, j)])


# --- 8 ------------------------------------------------------------------------------------------


def test_quality_counts(spark):
    rng = np.random.default_rng(3)
    texts = ODD + [prose(rng, int(rng.integers(1, 300)), int(rng.choice([3, 8, 50, 4000]))).replace("w1 ", "w1\n") for _ in range(60)] + ["a#*$% &|<> b\r\nb\n b"]
    df = docs(spark, *texts).withColumn("n_words", F.lit("mine"))
    got = sorted(quality_rules.judge(df).collect(), key=lambda r: r.doc_id)
    for r, t in zip(got, texts):
        t = t or ""
        w = WORD.findall(t)
        tri = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
        c = Counter(tri)
        covered = {k + j for k, x in enumerate(tri) if c[x] > 1 for j in range(3)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        want = (len(w), sum(map(len, w)), sum(x in "#*$%&|<>" for x in t), len(lines) - len(set(lines)), len(covered))
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, t[:80]
        assert r.base_failed == (len(w) < 50 or 100 * len(covered) > 50 * len(w)) and not (r.kept and r.base_failed)
    plan = quality_rules.judge(df)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan.replace("Exchange hashpartitioning", "") and "Python" not in plan and "Arrow" not in plan
    assert quality_rules.judge(df.limit(0)).count() == 0


@pytest.mark.parametrize("places", [24, 60, 2])  # 60: upper bits clash; 2: more words than places
def test_repeat_words_at_any_length(spark, places):
    rng = np.random.default_rng(places)
    texts = [prose(rng, int(rng.integers(1, 200)), int(rng.choice([3, 8, 50]))) for _ in range(40)] + ["a b c a b c", "a a a a", ""]
    got = docs(spark, *texts).select("doc_id", quality_rules.repeat_words(quality_rules.words_of(F.col("text")), places).alias("n")).collect()
    for r in got:
        w = texts[r.doc_id].split()
        c = Counter(zip(w, w[1:], w[2:]))
        assert r.n == len({k + j for k in range(len(w) - 2) if c[tuple(w[k : k + 3])] > 1 for j in range(3)}), texts[r.doc_id]


def test_kept_like_brute_force(spark):
    rng = np.random.default_rng(31)
    words = ["the", "of", "Word", "UPPER", "x1", "123456", "a", "###", "wow!!", "extraordinarily-long-hyphenated-word", "plain", "text", "für", "ÉCOLE", "le", "|", "und."]
    texts = []
    for _ in range(120):
        some = rng.choice(words, int(rng.integers(1, 6)))
        texts.append("".join(f"{w}{k % 37 if rng.random() < 0.7 else ''}{rng.choice([' ', ' ', chr(10)])}" for k, w in enumerate(rng.choice(some, int(rng.integers(30, 140))))))
    texts += [" ".join(f"word{chr(97 + k % 26)}{chr(97 + k // 26)} the" for k in range(100)), *ODD]
    df = docs(spark, *texts).withColumns({"measured": F.lit(1), "kept": F.lit("mine")})
    judged = quality_rules.judge(df)
    assert {"measured", "kept"} <= set(judged.columns) and judged.first().measured == 1
    kept = 0
    for r in judged.collect():
        t = texts[r.doc_id] or ""
        w, lines = WORD.findall(t), [x for x in t.split("\n") if WORD.search(x)]
        chars = sum(map(len, w))
        stops = sum(x.rstrip(".,;:!?").lower() in quality_rules.STOP_WORDS for x in w)
        c = Counter(zip(w, w[1:], w[2:]))
        repeats = len({k + j for k in range(len(w) - 2) if c[tuple(w[k : k + 3])] > 1 for j in range(3)})
        share = lambda a, b: a / b if b else None
        values = {
            "symbols_per_word": share(sum(x in "#*$%&|<>" for x in t), len(w)), "marks_per_word": share(sum(x in "!?" for x in t), len(w)), "mean_word_length": share(chars, len(w)),
            "upper_share": share(sum(unicodedata.category(x) == "Lu" for x in t), chars), "digit_share": share(sum(x in "0123456789" for x in t), chars),
            "stop_word_share": share(stops, len(w)), "dup_line_share": share(len(lines) - len(set(lines)), len(lines)), "repeat_word_share": share(repeats, len(w)),
        }
        ok = all(values[x.value] is None or (x.low is None or values[x.value] >= x.low) and (x.high is None or values[x.value] <= x.high) for x in quality_rules.RULES)
        assert r.kept == (ok and len(w) >= 50 and 100 * repeats <= 50 * len(w)), t[:60]
        kept += r.kept
    assert 5 < kept < 100


# --- 9 ------------------------------------------------------------------------------------------


@pytest.mark.parametrize(("html", "text"), [
    (None, ""), ("", ""), ("plain &amp; text", "plain & text"),
    ("<nav><a>x</a></nav><article><h1>T  t</h1><p>a<b>b</b> c<br>d<p>e &lt;&eacute;</article><footer>f</footer>", "T t\nab c d\ne <é"),
    ("<div class='menu'>m</div><div id=main><p>one long paragraph of text here</p><p>two</p></div><div class='comments'><p>no</p></div>", "one long paragraph of text here\ntwo"),
    ("<article><p>a</p><div class='ad'>x</div><form><p>q</p></form><aside>s</aside><script>'</p>'</script><div class='comment'>c</div><p>b</p></article>", "a\nb"),
    ("<nav><ul><li>never closed<article><p>kept</p></article>", "kept"),
    ("<header><h1>site</h1></header><main><header><h1>title</h1></header><p>x</p></main>", "title\nx"),
    ("<p>unclosed <b>bold <p>next</div></p>", "unclosed bold\nnext"), ("<article><p>cut &am", "cut &am"),
])
def test_main_text(html, text):
    assert html_extract.main_text(html or "") == text


LINKS = "".join(f"<div><a href='/{k}'>link {k}</a></div>" for k in range(12))
LONG = [f"{w} " + "words of a long paragraph that goes on and on " * 4 for w in ("one", "two", "three", "four")]


def test_clusters_choose_the_region_whatever_its_name(monkeypatch):
    page = f"<div><div>{LINKS}</div><div><div>{LONG[0]}</div><div>short</div><div>{LONG[1]}</div></div><div><div>{LONG[2]}</div></div><div>{LINKS}</div></div>"
    inner = f"<article><div>{LINKS}</div><div><h2>T</h2><p>{LONG[0]}</p><p>{LONG[1]}</p></div><div>{LINKS}</div></article>"
    menu = f"<div><div>{LINKS}</div><div><div>{LONG[0]}</div><div>{LONG[1]}</div></div></div>"
    body = [x.strip() for x in LONG]
    assert html_extract.main_text(menu) == "\n".join(body[:2])
    assert html_extract.main_text(inner) == "\n".join(["T", *body[:2]])
    assert html_extract.main_text(page) == "\n".join([body[0], "short", *body[1:3]])  # two sections: neither is lost
    found = html_extract.clusters
    monkeypatch.setattr(html_extract, "clusters", lambda lines: (np.full(len(lines), True), found(lines)[1]))
    assert all("link 0" in html_extract.main_text(x) for x in (menu, inner, page))


def test_smoothed_ratio_like_brute_force():
    lines = html_extract.parsed(f"<p>{LONG[0]}</p><ul><li>a<li>b</ul><div>c <b>d</b></div>{LINKS}<p>{LONG[1]}").lines
    assert [(x.text, x.tags) for x in lines[1:4]] == [("a", 2), ("b", 2), ("c d", 4)]  # <ul><li>, <li></ul>, <div><b></b></div>
    ratio = [len(x.text) / max(1, x.tags) for x in lines]
    for k, got in enumerate(html_extract.smoothed(lines)):
        near = [(np.exp(-(d * d) / 8), ratio[min(max(k + d, 0), len(lines) - 1)]) for d in range(-6, 7)]
        assert abs(got - sum(w * x for w, x in near) / sum(w for w, _ in near)) < 1e-9
    inside, least = html_extract.clusters(lines)
    smooth = html_extract.smoothed(lines)
    assert abs(least - smooth.std() / 2) < 1e-6 and inside.tolist() == [x >= least for x in smooth]


def test_one_huge_line_does_not_push_the_others_out():
    page = f"<body><nav>{LINKS}</nav><article><h1>T</h1><p>{'x ' * 40_000}</p>" + "".join(f"<p>line {k}</p>" for k in range(60)) + "</article><footer>f</footer></body>"
    got = html_extract.main_text(page).split("\n")
    assert got[0] == "T" and got[2:] == [f"line {k}" for k in range(60)] and len(got[1]) == 79_999
    assert html_extract.main_text("<div>" * 3000 + "deep") == "deep"


def test_extract_columns(spark):
    df = spark.createDataFrame([(1, "u", "<p>a</p>", 5), (1, "u", None, 6)], "page_id long, url string, html string, text int")
    got = html_extract.extract(df)
    assert got.columns == ["page_id", "url", "text"] and sorted(map(tuple, got.collect())) == [(1, "u", ""), (1, "u", "a")]
    assert html_extract.extract(df.limit(0)).count() == 0
    clash = spark.createDataFrame([(1, "u", "<p>a</p>", 5)] * 3, "page_id long, url string, html string, n_chars int")
    assert [tuple(r) for r in html_extract.extract(clash).collect()] == [(1, "u", "a", 5)] * 3


# --- 10 -----------------------------------------------------------------------------------------


def test_cuts():
    assert packing.cuts(10, 10) == [(0, 10)] and packing.cuts(25, 10) == [(0, 5), (5, 10), (15, 10)] and packing.cuts(20, 10) == [(0, 10), (10, 10)]


def test_plans_are_whole_and_near_optimal():
    rng = np.random.default_rng(5)
    for _ in range(60):
        size = int(rng.integers(10, 60))
        counts = {int(k): int(c) for k, c in zip(*np.unique(rng.integers(1, size, rng.integers(1, 200)), return_counts=True))}
        plan = packing.plan(counts, size)
        used = Counter()
        for lengths, times in plan:
            assert sum(lengths) <= size
            for n in lengths:
                used[n] += times
        assert used == counts
        total, bound, greedy = sum(t for _, t in plan), packing.lower_bound(counts, size), sum(t for _, t in packing.best_fit(counts, size))
        assert bound <= total <= greedy
    assert packing.plan({}) == [] and sum(t for _, t in packing.plan({6: 1, 5: 2, 4: 1, 3: 2, 2: 1}, 10)) == 3


def test_completion_takes_the_heaviest_filling():
    rng = np.random.default_rng(15)
    for _ in range(150):
        counts, room = {int(k): int(c) for k, c in zip(rng.integers(1, 12, 5), rng.integers(1, 4, 5))}, int(rng.integers(0, 25))
        got = packing._heaviest(counts, room)
        assert all(k <= counts[n] for n, k in Counter(got).items())
        choices = [()]
        for n, c in counts.items():
            choices = [(*x, *[n] * k) for x in choices for k in range(c + 1) if sum(x) + n * k <= room]
        assert (sum(got), sum(n * n for n in got)) == max((sum(x), sum(n * n for n in x)) for x in choices)
    counts = {int(n): int(c) for n, c in zip(rng.integers(1, 1024, 400), rng.integers(1, 1 << 33, 400))}
    plan = packing.completed(counts, 1024)
    used = Counter()
    for f, t in plan:
        used.update({n: k * t for n, k in Counter(f).items()})
    assert used == counts and all(sum(f) <= 1024 for f, _ in plan) and len(plan) < 4000


def test_improved_plans():
    rng = np.random.default_rng(40)
    better = 0
    for _ in range(25):
        size = int(rng.integers(50, 200))
        counts = Counter(rng.integers(size // 12, size // 2 + 8, 60).tolist())
        plan = packing.best_fit(counts, size)
        got = packing.improved(plan, size, packing.lower_bound(counts, size), 400)
        used = Counter()
        for f, t in got:
            assert t > 0 and sum(f) <= size
            used.update({n: k * t for n, k in Counter(f).items()})
        before, after = (sum(t for _, t in x) for x in (plan, got))
        assert used == counts and packing.lower_bound(counts, size) <= after <= before
        better += after < before
    assert better
    many = [((60, 30), 1 << 40), ((50, 20), 3), ((40,), 2)]
    used = Counter()
    for f, t in packing.improved(many, 100, 0, 50):
        used.update({n: k * t for n, k in Counter(f).items()})
    assert used == {60: 1 << 40, 30: 1 << 40, 50: 3, 20: 3, 40: 2} and packing.improved([], 10, 0, 5) == []


def test_plan_looks_past_the_third_filling():
    lengths = [1, 4, 6, 7, 12, 12, 26, 27, 28, 28, 31, 35, 36, 41, 70, 70, 73, 75, 85, 102, 107]  # six full sequences of 146, cut up
    plan = packing.plan(dict(Counter(lengths)), 146)
    assert sum(t for _, t in plan) == 6 == packing.lower_bound(dict(Counter(lengths)), 146)
    assert Counter(n for f, t in plan for n in f * t) == Counter(lengths)


def test_pack(spark):
    texts = ODD + ["same words here"] * 5
    e = common.encoder(tokenizer_path())
    rows = packing.pack(docs(spark, *texts).repartition(3).withColumn("offset", F.lit(1)), tokenizer_path(), size=64).collect()
    by_doc, seats = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, {})[r.piece] = r
        seats.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for k, t in enumerate(texts):
        mine = [by_doc[k][p] for p in sorted(by_doc[k])]
        assert b"".join(bytes(r.ids) for r in mine) == e.whole(t or "") + np.array([2], "<u4").tobytes()
        assert [(r.start, r.length) for r in mine] == packing.cuts(sum(r.length for r in mine), 64)
    for seat in seats.values():
        at = 0
        for offset, length in sorted(seat):
            assert offset == at
            at += length
        assert at <= 64
    assert packing.pack(docs(spark, "x").limit(0), tokenizer_path()).count() == 0


def test_pack_repeated_and_missing_identifiers(spark):
    texts, ids = ["a b", "c d e", "", None, "a b", "long text " * 200], [None, None, 1, 1, None, 7]
    e, end = common.encoder(tokenizer_path()), np.array([2], "<u4").tobytes()
    rows = packing.pack(docs(spark, *texts, ids=ids).repartition(3), tokenizer_path(), size=64).collect()
    short = Counter((r.doc_id, bytes(r.ids)) for r in rows if r.doc_id != 7)
    assert short == Counter((i, e.whole(t or "") + end) for i, t in zip(ids, texts) if i != 7)
    assert b"".join(bytes(r.ids) for r in sorted((r for r in rows if r.doc_id == 7), key=lambda r: r.piece)) == e.whole(texts[-1]) + end


# --- pipeline -----------------------------------------------------------------------------------


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rng = np.random.default_rng(8)
    text = lambda n: " ".join(rng.choice([*["the", "of", "and"] * 30, *("word" + chr(97 + k % 26) + chr(97 + k // 26) for k in range(676))], n))
    item, base = text(30), text(200)
    near = base.split()
    near[100] = "other"
    texts = [None, "", "too short", base, base, " ".join(near), text(150) + " mail x.y@z.org " + text(50), text(60) + " " + item + " " + text(60), " ".join(["Buy now!!"] * 80), text(2000)]
    df = docs(spark, *texts).select("doc_id", "text", F.lit("en").alias("lang"), F.lit("s").alias("source"), F.length("text").cast("long").alias("n_chars"))
    df.coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    stage, kept = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for k, (_, f) in enumerate(corpus_pipeline.STAGES):
        f(spark, stage, str(tmp_path)).write.parquet(str(tmp_path / f"out{k}"))
        stage = spark.read.parquet(str(tmp_path / f"out{k}"))
        kept.append(sorted({r.doc_id for r in stage.collect()}))
        assert k == 4 or stage.columns == df.columns
    assert kept == [[3, 4, 5, 6, 7, 9], [3, 6, 7, 9], [3, 6, 9], [3, 6, 9], [3, 6, 9]]
    masked = spark.read.parquet(str(tmp_path / "out3")).where("doc_id = 6").first()
    assert "<EMAIL>" in masked.text and "x.y@z" not in masked.text and masked.n_chars == len(masked.text)
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == stage.count()


def test_pipeline_stages_on_odd_tables(spark, tmp_path):
    import corpus_pipeline

    rng = np.random.default_rng(18)
    text = lambda n: " ".join(rng.choice([*["the", "of", "and"] * 30, *("word" + chr(97 + k % 26) + chr(97 + k // 26) for k in range(676))], n))
    base = text(200)
    rows = [(1, base, None, None, None, 7), (1, text(200), "en", "s", 5, 7), (None, base, "en", "s", 5, 7), (None, text(120), None, "s", 5, 7), (5, text(90), "en", None, 5, 7), (5, None, "en", "s", None, 7), (6, "", "en", "s", 0, 7)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, kept int"
    spark.createDataFrame([(None, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    names = corpus_pipeline.COLUMNS
    for k, some in enumerate((rows, [])):
        at, counts = spark.createDataFrame(some, schema), []
        for j, (_, f) in enumerate(corpus_pipeline.STAGES):
            f(spark, at, str(tmp_path)).write.parquet(str(tmp_path / f"odd{k}-{j}"))
            at = spark.read.parquet(str(tmp_path / f"odd{k}-{j}"))
            assert j == 4 or at.columns == names
            counts.append(at.count())
            if some and j == 1:
                assert sorted((r.doc_id or 0, r.text == base) for r in at.collect()) == [(0, False), (1, False), (1, True), (5, False)]
        assert counts[:4] == ([5, 4, 4, 4] if some else [0, 0, 0, 0]) and counts[4] >= counts[3] and (some or not counts[4])


def test_large_and_missing_identifiers_stay_beyond_one_index(spark, monkeypatch):
    rng = np.random.default_rng(31)
    items = [(9007199254740995, prose(rng, 30)), (None, prose(rng, 25)), (9007199254740997, prose(rng, 30))]
    rows = [(9007199254740993, f"{prose(rng, 40)} {items[0][1]}"), (None, f"{items[1][1]} {prose(rng, 9)} {items[2][1]}"), (3, None), (9007199254740995, prose(rng, 60))]
    df, bench = spark.createDataFrame(rows, DOC), spark.createDataFrame(items, "item_id long, text string")
    want = sorted(map(tuple, decontaminate.matches(df, bench).collect()), key=str)
    assert [r[:2] for r in want] == sorted([(9007199254740993, 9007199254740995), (None, None), (None, 9007199254740997)], key=str)
    monkeypatch.setattr(decontaminate, "ITEMS", 1)
    assert sorted(map(tuple, decontaminate.matches(df, bench).collect()), key=str) == want


@pytest.mark.parametrize("name", ["post no-sidebar", "content-with-sidebar", "entry-content share-enabled", "story toc-enabled", "widget-text", "sidebar", "related"])
def test_a_name_loses_no_article(name):
    body = "".join(f"<p>{x}</p>" for x in LONG)
    text = "\n".join(["Title", *(x.strip() for x in LONG)])
    assert html_extract.main_text(f"<h1>Title</h1><div class='{name}'>{body}</div>") == text
    assert html_extract.main_text(f"<nav>{LINKS}</nav><h1>Title</h1><div id='{name}'>{body}</div><div class='comment-list'>{body}{body}</div>").endswith(text[len("Title\n") :])


def test_names_inside_an_article():
    page = f"<article><h1>T</h1><p>{LONG[0]}</p><div class='related-work'><p>see others</p></div><div id='search-results'><p>found it</p></div><div class='sidebar-left'><p>{LONG[1]}</p></div><p>{LONG[2]}</p></article>"
    assert html_extract.main_text(page) == "\n".join(["T", LONG[0].strip(), "see others", "found it", LONG[2].strip()])
    assert [x for x in ("comment", "comment-list", "ad_slot2", "site-footer", "Cookie-Banner", "no-ads", "ad:x", "adjust", "search-results") if html_extract.tells(x.lower())] == ["comment", "comment-list", "ad_slot2", "site-footer", "Cookie-Banner"]


def test_tokens_that_always_come_together_are_mined_as_one(spark):
    segments = [f"seg{chr(97 + k)}" for k in range(18)]  # by themselves 2^18 itemsets
    rows = [([f"path:{s}" for s in segments] + [f"host:{k % 3}"], "block") for k in range(100)] + [([f"host:{k % 3}", "path:x"], "allow") for k in range(100)] + [([], "allow")]
    got = url_rules.mined(spark.createDataFrame(rows, "tokens array<string>, label string"))
    assert sorted((tuple(r.tokens), r.confidence) for r in got.collect()) == sorted(((f"path:{s}",), 1.0) for s in segments)
    pairs = [(["a", "b", "c"], "block")] * 30 + [(["a", "b"], "allow")] * 30 + [(["c"], "allow")] * 30 + [(["d", "e", "c"], "block")] * 5
    told = {(tuple(r.tokens), round(r.confidence, 3)) for r in url_rules.mined(spark.createDataFrame(pairs, "tokens array<string>, label string")).collect()}
    assert told == {(("a", "c"), 1.0), (("b", "c"), 1.0), (("d",), 1.0), (("e",), 1.0)}


def test_near_copies_share_their_numbers():
    """Sets that have most n-grams in common are held by places of n-grams, a number of Python for each n-gram and not for each set that has it."""
    import tracemalloc

    from seqtrough.llm import ngram_join

    rng = np.random.default_rng(5)
    common = rng.integers(0, 1 << 63, 3_000).astype(np.uint64)
    sets = [np.unique(np.append(common, rng.integers(0, 1 << 63, 3).astype(np.uint64))) for _ in range(150)]
    tracemalloc.start()
    found = list(ngram_join.links(list(range(150)), sets, 80, 100))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(found) == 149 and peak < 40 * 450_000


def test_a_task_lets_go_of_another_stages_encoder():
    from seqtrough.llm import common
    from seqtrough.llm.queries import tokenizer_path

    common.encoder(tokenizer_path())
    common.unburdened()
    assert common.encoder.cache_info().currsize == 0
