"""Language identification, the conversation trie and the filter audit against brute force on small odd tables."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqtrough.llm import filter_audit, language_id, prefix_trie, scan

WORD = re.compile(r"[^\x20\x09-\x0D]+")


# --- running sums -------------------------------------------------------------------------------


@pytest.mark.parametrize("partitions", ["1", "7"])
def test_running_sums_of_a_key_over_many_tasks(spark, partitions):
    rng = np.random.default_rng(4)
    rows = [(int(k), int(o), int(v), "x") for k, o, v in zip(rng.choice([-5, 3, 3, 3, 3, 9], 400), rng.permutation(400), rng.integers(-9, 9, 400))]
    rows += [(1, None, 7, None)]
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    got = scan.upto(spark.createDataFrame(rows, "k long, o long, v long, upto string").withColumn("one", F.lit(1).cast("long")), "k", ["o"], ["v", "one"])
    got = {(r.k, r.o): (r.upto_v, r.upto_one, r.upto) for r in got.collect()}
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    spark.conf.unset("spark.sql.adaptive.enabled")
    at = defaultdict(lambda: [0, 0])
    for k, o, v, x in sorted(rows, key=lambda r: (r[0], r[1] is not None, r[1])):
        at[k][0] += v
        at[k][1] += 1
        assert got.pop((k, o)) == (*at[k], x)
    assert not got
    assert scan.upto(spark.createDataFrame([], "k long, o long, v long"), "k", ["o"], ["v"]).count() == 0


# --- 11 -----------------------------------------------------------------------------------------


def plain_features(text):
    x = f" {text.lower()} "
    return Counter(x[i : i + k] for k in (1, 2, 3) for i in range(len(x) - k + 1))


def test_features_like_brute_force(monkeypatch):
    number = lambda run: int(language_id.numbers(np.frombuffer(run.encode("utf-32-le", "surrogatepass"), np.uint32))[len(run) - 1][0])
    texts = ["a", "Été À \U0001f600", "abc " * 50, "x\ud800y", "".join(map(chr, range(97, 123))) * 40]
    want = []
    for t in texts:
        total = Counter()
        for run, n in plain_features(t).items():
            total[number(run)] += n
        want.append(total)
        assert dict(zip(*map(np.ndarray.tolist, language_id.counted(t)))) == total
    monkeypatch.setattr(language_id, "FEATURES", 1 << 16)
    monkeypatch.setattr(language_id, "PIECE", 7)
    long = "word und mot " * 2000
    total = Counter()
    for run, n in plain_features(long).items():
        total[number(run)] += n
    assert dict(zip(*map(np.ndarray.tolist, language_id.counted(long)))) == total  # in pieces of seven characters


def test_values_have_length_one():
    v = language_id.values(np.array([3, 5]), np.array([1, 4]), np.arange(10.0))
    assert np.allclose(v, np.array([3.0, (1 + np.log(4)) * 5]) / np.hypot(3, (1 + np.log(4)) * 5))


def test_learner_like_plain_ftrl():
    rng = np.random.default_rng(1)
    rows = [(np.sort(rng.choice(12, 4, replace=False)), rng.normal(size=4)) for _ in range(30)]
    labels = rng.integers(0, 3, 30)
    weights, bias = language_id.follow(rows, labels, 3, epochs=2)
    a, b, l1, l2 = language_id.ALPHA, language_id.BETA, language_id.L1, language_id.L2
    z, n = defaultdict(float), defaultdict(float)

    def weight(key):
        least = 0.0 if key[0] == "bias" else l1
        return 0.0 if abs(z[key]) <= least else (np.sign(z[key]) * least - z[key]) / ((b + n[key] ** 0.5) / a + l2)

    order = np.random.default_rng(11)
    for _ in range(2):
        for r in order.permutation(30):
            x = dict(zip(rows[r][0].tolist(), rows[r][1])) | {"bias": 1.0}
            w = {(f, c): weight((f, c)) for f in x for c in range(3)}
            s = np.exp([sum(x[f] * w[f, c] for f in x) for c in range(3)])
            for c in range(3):
                for f in x:
                    g = (s[c] / s.sum() - (c == labels[r])) * x[f]
                    z[f, c] += g - ((n[f, c] + g * g) ** 0.5 - n[f, c] ** 0.5) / a * w[f, c]
                    n[f, c] += g * g
    assert np.allclose(weights[:12], [[weight((f, c)) for c in range(3)] for f in range(12)])
    assert np.allclose(bias, [weight(("bias", c)) for c in range(3)]) and not weights[12:].any()


def test_temperature_is_the_likeliest():
    rng = np.random.default_rng(2)
    labels = rng.integers(0, 3, 400)
    logits = rng.normal(size=(400, 3)) * 4 + 5 * np.eye(3)[labels]
    loss = lambda t: -np.log(language_id.softmax(logits / t)[np.arange(400), labels]).mean()
    t = language_id.calibrated(logits, labels)
    assert loss(t) <= min(loss(x) for x in np.linspace(0.3, 15, 200)) + 1e-6 and t != 1
    assert language_id.calibrated(np.zeros((0, 3)), labels[:0]) == 1 and language_id.calibrated(9 * np.eye(3)[labels], labels) < 0.26


def spoken(rng, lang, n):
    words = {"en": "the of and with that house tree", "de": "der und nicht schön über haus baum", "fr": "le été dans que maison arbre où"}[lang].split()
    return " ".join(rng.choice(words, n))


def test_language_of_every_document(spark):
    rng = np.random.default_rng(3)
    rows = [(k, spoken(rng, lang, int(rng.integers(2, 40))), lang, "mine") for k, lang in enumerate(rng.choice(["en", "de", "fr"], 240, p=[0.7, 0.2, 0.1]))]
    odd = [(None, spoken(rng, "de", 9), None, ""), (500, None, "en", ""), (501, "", "de", ""), (502, "12 $$ \n", "fr", ""), (503, "été " * 60_000, "fr", ""), (1, rows[0][1], "en", ""), (1, rows[0][1], "en", "")]
    df = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string, score string")
    out = language_id.identify(df)
    got = out.collect()
    assert out.columns == ["doc_id", "text", "lang", "lang_pred", "score", "held_out"] and len(got) == len(rows + odd)
    for r in got:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1
        assert (r.lang_pred == "und") == (not any(map(str.isalpha, r.text or ""))) and (r.score == 0) == (r.lang_pred == "und")
    held = [r for r in got if r.held_out and r.lang_pred != "und"]
    assert np.mean([r.lang == r.lang_pred for r in held]) >= 0.97 and len(held) > 30
    again = language_id.identify(df.repartition(7))
    assert sorted(map(str, again.collect())) == sorted(map(str, got))  # however rows lie
    lone = language_id.identify(df.where("lang = 'de'")).where("lang_pred <> 'und'").collect()
    assert {(r.lang_pred, r.score) for r in lone} == {("de", 1.0)}
    assert {r.lang_pred for r in language_id.identify(df.where("lang is null or text is null")).collect()} == {"und"}
    assert language_id.identify(df.limit(0)).count() == 0


def test_frequencies_and_sample_bounds(spark):
    rng = np.random.default_rng(5)
    rows = [(str(k), spoken(rng, lang, 12), lang) for k, lang in enumerate(["en"] * 50 + ["de"] * 6)]
    df = spark.createDataFrame(rows, "doc_id string, text string, lang string").repartition(5)
    having = Counter()
    for _, t, _ in rows:
        having.update(set(language_id.counted(t)[0].tolist()))
    assert {r.feature: r.n for r in language_id.frequencies(df.select("text")).collect()} == having | {-1: 56}
    languages, told = language_id.sample(df, most=20)
    assert languages == ["de", "en"] and Counter(x for x, _, _ in told) == {"en": 10, "de": 6}
    few = language_id.sample(df, most=20, cells=200)[1]
    assert 0 < sum(len(f) for _, f, _ in few) <= 200 and [f.tolist() for _, f, _ in few] == [f.tolist() for _, f, _ in told[: len(few)]]


# --- 12 -----------------------------------------------------------------------------------------


def plain_trie(rows):
    turns = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            turns[c].append((turn is not None, turn or 0, hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest(), role, text))
    paths = {}
    for c in turns:
        own, first = ([(r, t) for *_, r, t in sorted(turns.get(k, []))] for k in (c, c - int(np.fmod(c, 5))))
        h = zlib.crc32(str(c).encode()) % 9
        paths[c] = tuple(first[:h] + own[h:])
    members = defaultdict(list)
    for c, p in paths.items():
        for d in range(len(p) + 1):
            members[p[:d]].append(c)
    out = []
    for v, of in members.items():
        below = [u for u in members if u[: len(v)] == v]
        child = lambda u: [w for w in members if len(w) == len(u) + 1 and w[: len(u)] == u]
        ends = ",".join(str(c) for c in sorted(c for c in of if len(paths[c]) == len(v)))
        saved = sum((len(members[u]) - 1) * (len(u[-1][1].encode()) if u else 0) for u in below)
        out.append((min(of), len(v), min(members[v[:-1]]) if v else None, len(of), len(child(v)), sum(not child(u) for u in below), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


CONV = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("partitions", ["4", "23"])
def test_trie_like_brute_force(spark, partitions):
    rng = np.random.default_rng(6)
    rows = []
    for c in [*range(-7, 30), 101, 104, 10**15]:
        for t in range(int(rng.integers(1, 12))):
            rows.append((c, int(t), ["user", "assistant"][t % 2], str(rng.choice(["hello", "é" * 3, "so", ""])) if t < 2 or rng.random() < 0.6 else f"{c} {t}"))
    rows += [(3, None, None, None), (3, None, "user", "before"), (4, 0, None, "tie"), (4, 0, None, "tie"), (4, 0, "x", "tie"), (None, 1, "user", "nobody's"), (200, 0, "user", "long " * 20_000), (200, 1, "user", None)]
    rows += [(500 + 5 * k, t, "user", "the same") for k in range(40) for t in range(3)]  # many of one path
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    got = prefix_trie.nodes(spark.createDataFrame(rows, CONV).withColumns({"share": F.lit("x"), "depth": F.lit(1)}).repartition(5))
    told = sorted(map(tuple, got.collect()), key=str)
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert told == plain_trie(rows) and got.columns == "conv_id depth parent_conv_id n_convs n_children n_leaves saved_tokens ends_sha256".split()
    assert {t for c, t in got.dtypes if c != "ends_sha256"} == {"bigint"}


def test_trie_of_nothing_and_of_turnless_conversations(spark):
    assert prefix_trie.nodes(spark.createDataFrame([], CONV)).count() == 0
    turnless = next(c for c in range(1, 100) if zlib.crc32(str(c).encode()) % 9 and c % 5)
    rows = [(turnless, 0, "user", "x")]  # its family's first conversation is absent
    assert [tuple(r) for r in prefix_trie.nodes(spark.createDataFrame(rows, CONV)).collect()] == plain_trie(rows) == [(turnless, 0, None, 1, 0, 1, 0, hashlib.sha256(str(turnless).encode()).hexdigest())]


def test_identifiers_are_hashed_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "BLOCK", 20)
    ids = [int(x) for x in np.random.default_rng(7).permutation(300)]
    zero = {c: F.lit(0).cast("long") for c in prefix_trie.NODE}
    ends = spark.createDataFrame([(c,) for c in ids], "conv_id long").withColumns(zero)
    (r,) = prefix_trie.hashed(ends).collect()
    assert r.ends_sha256 == hashlib.sha256(",".join(map(str, sorted(ids))).encode()).hexdigest()


# --- 13 -----------------------------------------------------------------------------------------


def plain_audit(docs, labels):
    good, toxic = ({d for d, q, t in labels if d is not None and (q, t)[k] == 1} for k in (0, 1))
    least = {}
    for d, text, _ in docs:
        if d is not None:
            least[text or ""] = min(d, least.get(text or "", d))
    told = []
    for d, text, source in docs:
        t = text or ""
        w = WORD.findall(t)
        fails = {"A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": d is not None and least[t] < d}
        told.append((source or "", {k for k, v in fails.items() if v}, d in good, d in toxic))
    out, removals = {}, Counter()
    for order in permutations("ABCDE"):
        for k, f in enumerate(order):
            for part, fails, is_good, is_toxic in told:
                c = out.setdefault((part, "".join(order), k + 1), [0] * 6)
                gone, fail = bool(fails & set(order[:k])), f in fails
                for j, yes in enumerate((not gone and not fail, not gone and fail, gone and fail, fails == {f}, not gone and fail and is_good, not gone and fail and is_toxic)):
                    c[j] += bool(yes)
                removals[part, f] += not gone and fail
    return {key: (*c, removals[key[0], key[1][key[2] - 1]]) for key, c in out.items()}


def test_audit_like_playing_every_order(spark):
    rng = np.random.default_rng(8)
    pool = ["plain", "Word", "LOUD", "a|b", "x$", *(f"w{k}" for k in range(60))]
    texts = [" ".join(rng.choice(pool[: int(rng.integers(3, 65))], int(rng.integers(1, 120)))) for _ in range(40)]
    texts += [None, "", " \n\t", "one" * 50_000, "a\x1cb " * 60, " ".join(f"w{k}" for k in range(80)), "É" * 10]
    docs = [(int(d), texts[int(t)], str(s)) for d, t, s in zip(rng.permutation(150), rng.integers(0, len(texts), 150), rng.choice(["s0", "s0", "s1"], 150))]
    docs += [(7, texts[1], None), (7, texts[1], None), (7, texts[2], "s1"), (None, texts[3], "s1"), (None, None, None), (None, texts[3], "s0")]
    labels = [(int(d), int(q), int(t)) for d, q, t in zip(rng.integers(0, 150, 80), rng.integers(0, 2, 80), rng.integers(0, 2, 80))] + [(None, 1, 1), (7, None, None), (7, 1, None), (9999, 1, 1)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string").withColumns({"n": F.lit(1), "part": F.lit("x"), "good": F.lit(2), "key": F.lit(3)})
    got = filter_audit.audit(df.repartition(5), spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("text", F.lit("")))
    told = {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in got.collect()}
    assert told == plain_audit(docs, labels) and len(told) == 3 * 600
    assert [t for _, t in got.dtypes] == ["string", "string", "int", *["bigint"] * 7]
    assert filter_audit.audit(df.limit(0), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).count() == 0


def test_joint_counts_are_flag_products_and_invert(spark):
    cells = spark.createDataFrame([("p", bits, bits + 1, 1, 0) for bits in range(32)], "part string, bits int, n long, good long, toxic long")
    (r,) = filter_audit.joint(cells).collect()
    assert list(r.n) == [sum(b + 1 for b in range(32) if b & s == s) for s in range(32)] and list(r.toxic) == [0] * 32
    (x,) = filter_audit.joint(cells).select(filter_audit.survivors("n").alias("left")).collect()
    assert list(x.left) == [sum(b + 1 for b in range(32) if not b & t) for t in range(32)]


# --- 3 and 10: exact answers on small cases -----------------------------------------------------


def test_splits_lower_impurity_most():
    from seqtrough.llm import rule_ensemble as rules

    rng = np.random.default_rng(51)
    gini = lambda y: 2 * y.sum() * (len(y) - y.sum()) / len(y) if len(y) else 0.0
    for _ in range(40):
        x, y = rng.integers(0, 9, (int(rng.integers(20, 50)), 3)).astype(float), None
        y = (x[:, 1] + rng.normal(size=len(x)) > 4).astype(float)
        best = 0.0
        for f in range(3):
            for t in np.unique(x[:, f])[:-1] + 0.5:
                left = x[:, f] <= t
                if rules.LEAST <= left.sum() <= len(y) - rules.LEAST:
                    best = max(best, gini(y) - gini(y[left]) - gini(y[~left]))
        found = rules._split(x, y, np.arange(3))
        if best < 1e-9:
            assert found is None
        else:
            f, t = found
            left = x[:, f] <= t
            assert abs(gini(y) - gini(y[left]) - gini(y[~left]) - best) < 1e-9


def test_tree_rules_are_paths_of_growing_trees():
    from seqtrough.llm import rule_ensemble as rules

    rng = np.random.default_rng(52)
    x = rng.normal(size=(200, len(rules.STATISTICS)))
    y = (x[:, 0] * x[:, 1] > 0).astype(float)
    found = rules.tree_rules(x, y, np.random.default_rng(1))
    assert found and all(1 <= len(r) <= rules.DEPTH for r in found)
    a = rules.matrix(sorted(found), x)
    for rule, column in zip(sorted(found), a.T):
        holds = np.ones(len(x), bool)
        for name, above, t in rule:
            value = x[:, list(rules.STATISTICS).index(name)]
            holds &= value > t if above else value <= t
        assert np.array_equal(column, holds)


def test_lasso_meets_its_conditions():
    """At the optimum the gradient is within the penalty, and at it where a weight is not zero."""
    from seqtrough.llm import rule_ensemble as rules

    rng = np.random.default_rng(53)
    a = (rng.random((300, 12)) < 0.4).astype(float)
    y = (a[:, 0] + a[:, 1] - a[:, 2] + rng.normal(size=300) > 0.6).astype(float)
    for penalty in (0.002, 0.02):
        bias, w = rules.lasso(a, y, penalty, rounds=20_000)
        weight = np.where(y > 0, 0.5 / y.sum(), 0.5 / (1 - y).sum())
        g = a.T @ (weight * (1 / (1 + np.exp(-(a @ w + bias))) - y))
        assert abs((weight * (1 / (1 + np.exp(-(a @ w + bias))) - y)).sum()) < 1e-6
        assert np.all(np.abs(g) <= penalty + 1e-6) and np.allclose(g[w != 0], -penalty * np.sign(w[w != 0]), atol=1e-6)
    assert (w == 0).any() and (w != 0).any()


def least_bins(lengths, size):
    """Fewest bins by trying every place of every piece."""
    best = len(lengths)

    def seat(k, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if k == len(lengths):
            best = len(rooms)
            return
        for room in sorted(set(rooms)):
            if room >= lengths[k]:
                rest = list(rooms)
                rest[rest.index(room)] -= lengths[k]
                seat(k + 1, rest)
        seat(k + 1, [*rooms, size - lengths[k]])

    lengths = sorted(lengths, reverse=True)
    seat(0, [])
    return best


def test_plans_of_few_pieces_are_the_best_there_are():
    from seqtrough.llm import packing

    rng = np.random.default_rng(54)
    for _ in range(150):
        size = int(rng.integers(8, 40))
        lengths = rng.integers(max(1, size // 6), size, int(rng.integers(1, 11))).tolist()
        counts = dict(Counter(lengths))
        total = sum(t for _, t in packing.plan(counts, size))
        assert total == least_bins(lengths, size), (lengths, size)
    search = packing._Search({6: 1, 5: 2, 4: 1, 3: 2, 2: 1}, 10, 2000)
    search.best, search.most = [((n,), 1) for n in (6, 5, 5, 4, 3, 3, 2)], 7
    for look, whole in search.PASSES:
        search._pass(look, whole)
    assert search.most == 3  # by branch and bound alone, from a plan of single pieces


def test_few_sequences_are_searched_like_brute_force():
    import random

    from seqtrough.llm import packing

    rng, better = np.random.default_rng(81), 0
    for _ in range(120):
        size = int(rng.integers(8, 40))
        lengths = rng.integers(max(1, size // 6), size, int(rng.integers(2, 9))).tolist()
        alone = [(n,) for n in lengths]
        got, found = packing._few(alone, size, 100_000, random.Random(1))
        assert len(got) == least_bins(lengths, size) and found == (len(got) < len(alone))
        assert Counter(n for f in got for n in f) == Counter(lengths) and all(sum(f) <= size for f in got)
        again, found = packing._few(got, size, 100_000, random.Random(2))
        assert not found and len(again) == len(got)
        assert sorted(map(sorted, packing._few(alone, size, 0, random.Random(1))[0])) == sorted(map(list, alone))  # no node, no change
        room = int(rng.integers(1, 30))
        subsets = {tuple(sorted((n for k, n in enumerate(lengths) if b >> k & 1), reverse=True)) for b in range(1 << len(lengths))}
        expected = set()
        for f in (f for f in subsets if sum(f) <= room):
            rest, spare = list((Counter(lengths) - Counter(f)).elements()), room - sum(f)
            if not any(x < n <= x + spare for n in rest for x in (0, *f)):
                expected.add(f)
        fillings = list(packing._fillings_of(lengths, room, room, random.Random(3), [1000]))
        fillings = [tuple(sorted(f, reverse=True)) for f in fillings]
        assert set(fillings) == expected and len(fillings) == len(expected)
        assert [sum(f) for f in fillings] == sorted(map(sum, fillings), reverse=True)
        better += len(got) < len(alone)
    assert better > 60
    looks = [50]
    assert len(list(packing._fillings_of([1] * 500 + [2] * 500 + [3] * 500, 600, 600, random.Random(1), looks))) == 50 and looks[0] < 0
