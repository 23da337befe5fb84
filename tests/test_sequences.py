"""Sequence engine against small cases worked by hand, known values and a plain numpy version."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqtrough.functions.params import Params, hat
from seqtrough.operators import motifs as M
from seqtrough.operators import population as P
from seqtrough.operators import regions as R
from seqtrough.operators import segments as G
from seqtrough.operators import signals as S
from seqtrough.plans import views as V
from seqtrough.sources import fasta, sinks

#: A stretch of AT between two mixed repeats; its one region is known.
FRAGMENT = "ACGTGCGTATGC" * 80 + "AT" * 200 + "CGCGATGCTAGCTTACGATC" * 40


def sequences(spark, *seqs):
    return spark.createDataFrame([(k, f"s{k}", s, len(s)) for k, s in enumerate(seqs)], "seq_idx long, sequence_id string, seq string, seq_len int")


def plain_signals(seq, p=Params()):
    """di, smoothed and pds of one sequence, position by position."""
    n = len(seq) - p.window + 1
    di = np.full(n, np.nan)
    for i in range(n):
        w = seq[i : i + p.window]
        if "N" not in w:
            _, c = np.unique([w[k : k + 2] for k in range(len(w) - 1)], return_counts=True)
            q = c / c.sum()
            di[i] = 2 ** -(q * np.log2(q)).sum()
    if np.isnan(di).all():
        return di, di, di
    ok = ~np.isnan(di)
    x = np.interp(np.arange(n), np.flatnonzero(ok), di[ok])
    wl, po = p.smoothing(n)
    if wl:
        h = np.array(hat(wl, po))
        s = np.clip(np.arange(n) - wl // 2, 0, n - wl)
        x = np.array([h[i - s[i]] @ x[s[i] : s[i] + wl] for i in range(n)])
    sm = np.where(ok, x, np.nan)
    q = np.floor(np.nan_to_num(sm) * 1e6 + 0.5) * ok
    cs, cn = np.concatenate([[0], np.cumsum(q)]), np.concatenate([[0], np.cumsum(ok)])
    pds = np.full(n, np.nan)
    for c in range(n):
        m = {}
        for k, (a, b) in p.frames.items():
            if c + a >= 0 and c + b <= n and cn[c + b] > cn[c + a]:
                m[k] = (cs[c + b] - cs[c + a]) / (cn[c + b] - cn[c + a]) / 1e6
        if len(m) == 3 and m["up"] > m["reg"] and m["dn"] > m["reg"]:
            pds[c] = (m["up"] + m["dn"]) / 2 - m["reg"]
    return di, sm, pds


def random_sequence(rng, n, gaps=0):
    s = rng.choice(list("ACGT"), n)
    for _ in range(3):
        a = rng.integers(0, max(1, n - 120))
        s[a : a + 120] = list("AT" * 60)[: len(s[a : a + 120])]
    for _ in range(gaps):
        a = rng.integers(0, n)
        s[a : a + rng.integers(1, 60)] = "N"
    return "".join(s)


SMALL = Params(flank=20, spacer=5, min_candidate=10, max_candidate=40, min_region=10, max_region=60, merge_gap=10)


@pytest.mark.parametrize("chunk", [None, 100])
def test_signals_like_plain(spark, chunk):
    rng = np.random.default_rng(5)
    seqs = [random_sequence(rng, n, g) for n, g in ((17, 0), (18, 0), (30, 1), (37, 0), (400, 0), (700, 4), (500, 9))] + ["A" * 80, "N" * 60, "ACG" + "N" * 300 + "ACGTTGCA" * 20]
    rows = S.signals(sequences(spark, *seqs), SMALL, chunk).collect()
    for k, seq in enumerate(seqs):
        mine = sorted((r for r in rows if r.seq_idx == k), key=lambda r: r.pos)
        assert [r.pos for r in mine] == list(range(len(seq) - 16))
        for name, want, tol in zip(("di", "smoothed", "pds"), plain_signals(seq, SMALL), (1e-9, 2e-6, 2e-6)):
            got = np.array([np.nan if r[name] is None else r[name] for r in mine])
            assert np.array_equal(np.isnan(got), np.isnan(want)), (k, name)
            assert np.nanmax(np.abs(got - want), initial=0) <= tol, (k, name)


def test_short_and_homopolymer(spark):
    rows = S.signals(sequences(spark, "ACGT" * 4, "A" * 20)).collect()
    assert {r.seq_idx for r in rows} == {1} and all(r.di == 1 for r in rows)
    assert R.regions(sequences(spark, "ACGT")).columns[:2] == ["seq_idx", "Region_ID"]


@pytest.mark.parametrize("chunk", [None, 700])
def test_known_region(spark, chunk):
    (r,) = R.regions(sequences(spark, FRAGMENT), chunk=chunk).collect()
    want = {"Signal_Start": 1082, "Signal_End": 1222, "Start": 1082, "End": 1238, "Length": 157, "Mean_Perplexity": 2, "Upstream_Mean": 3.1860201, "Downstream_Mean": 3.7095041, "Region_Mean": 2,
            "Perplexity_Depression_Score": 3.9323947, "Prominence": 1.4477625, "Persistence": 1, "Variance": 0.3132549, "GC_Content": 0, "Region_Score": 62.1234643, "Rank": 1}
    for k, v in want.items():
        assert math.isclose(r[k], v, rel_tol=1e-5, abs_tol=1e-9), k


def test_fasta_forms(spark):
    text = "lost\n>a\nacgu\n\nRYN>\r\n>\nGG\n  >b c \nTT\n>none\n>a\nC"
    rows = sorted(fasta.from_text(spark, text, pasted=False).collect())
    assert [(r.seq_idx, r.sequence_id, r.seq) for r in rows] == [(0, "a", "ACGTN"), (1, "sequence", "GG"), (2, "b c", "TT"), (3, "a", "C")]
    assert [r.sequence_id for r in fasta.from_text(spark, "acgt\nac").collect()] == ["query"]
    assert fasta.from_text(spark, "").count() == 0


def test_fasta_files(spark, tmp_path):
    (tmp_path / "x.fa").write_text(">a 1\nAC\nGT\n>b\n>c\nNN\n")
    (tmp_path / "y.fa").write_text("lost\r\n\r\n>>d\r\nac\r\n   >e  \r\nuu\r\n>\r\nG")
    (tmp_path / "z.fa").write_text("ACGT\nno header\n")
    for whole in (False, True):
        x, y, z = (sorted(map(tuple, fasta.read_fasta(spark, str(tmp_path / n), whole).collect())) for n in ("x.fa", "y.fa", "z.fa"))
        assert x == [(0, "a 1", "ACGT", 4), (1, "c", "NN", 2)] and z == []
        assert y == [(0, ">d", "AC", 2), (1, "e", "TT", 2), (2, "sequence", "G", 1)]
        assert [r.seq_idx for r in fasta.read_fasta(spark, str(tmp_path), whole).orderBy("seq_idx").collect()] == [0, 1, 2, 3, 4]


def test_fasta_in_splits(spark, tmp_path):
    rng = np.random.default_rng(6)
    rows = [(f"r{k}", "".join(rng.choice(list("ACGT"), int(rng.integers(1, 200))))) for k in range(400)]
    (tmp_path / "x.fa").write_text("".join(f">{n}\n" + "\n".join(s[i : i + 60] for i in range(0, len(s), 60)) + "\n" for n, s in rows))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    got = fasta.read_fasta(spark, str(tmp_path / "x.fa")).orderBy("seq_idx").collect()
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")
    assert [(r.seq_idx, r.sequence_id, r.seq) for r in got] == [(k, *x) for k, x in enumerate(rows)]


def test_command_line(spark, tmp_path):
    from seqtrough.__main__ import main

    (tmp_path / "x.fa").write_text(f">one\n{FRAGMENT}\n>two\nACGT\n")
    assert main([str(tmp_path / "x.fa"), "--out", str(tmp_path / "out"), "--motifs", "AT{1,}"], spark) == 1
    (r,) = spark.read.option("header", True).csv(str(tmp_path / "out")).collect()
    assert (r.Sequence_ID, r.Start, r.End, r.Region_ID, r.Motif_Count) == ("one", "1082", "1238", "LPR_000001", "78")
    assert main([str(tmp_path / "x.fa"), "--out", str(tmp_path / "none"), "--format", "json", "--min-region", "900"], spark) == 0


def test_merge_gap(spark):
    df = spark.createDataFrame([(0, 0, 9), (0, 19, 25), (0, 36, 40), (1, 0, 50), (1, 5, 6), (1, 61, 62)], "seq_idx int, start int, end int")
    assert sorted(map(tuple, G.merge_intervals(df, 10).collect())) == [(0, 0, 25), (0, 36, 40), (1, 0, 50), (1, 61, 62)]
    touching = spark.createDataFrame([(0, 0, 1), (0, 2, 3)], "seq_idx int, start int, end int")
    assert G.merge_intervals(touching, 0).count() == 2


def test_runs_over_spans(spark):
    rows = spark.range(G.SPAN - 5, G.SPAN + 5).select(F.lit(0).alias("seq_idx"), F.col("id").alias("pos"))
    assert [tuple(r) for r in G.runs(rows).collect()] == [(0, G.SPAN - 5, G.SPAN + 4)]


def bounded_plain(v, lo, hi):
    best = None
    pre = np.concatenate([[0], np.cumsum(v)])
    for j in range(lo - 1, len(v)):
        starts = range(max(0, j - hi + 1), j - lo + 2)
        i = min(starts, key=lambda s: (pre[s], -s))
        mean = (pre[j + 1] - pre[i]) / (j + 1 - i)
        if best is None or mean > best[0]:
            best = (mean, i, j)
    return best[1:]


def test_bounded_segments(spark):
    rng = np.random.default_rng(2)
    rows, want = [], []
    p = Params(min_region=3, max_region=7)
    for k in range(12):
        v = rng.integers(1, 9, rng.integers(2, 30))
        rows += [(k, i + 5, float(x)) for i, x in enumerate(v)]
        if len(v) >= 3:
            want.append((k, 5, 5, 4 + len(v)) if len(v) <= 7 else (k, 5, *(x + 5 for x in bounded_plain(v, 3, 7))))
    signals = spark.createDataFrame(rows, "seq_idx int, pos int, pds double")
    got = G.bounded_segments(signals, p)
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert sorted(r.end - r.start + 1 for r in G.expanded(got, signals).collect()) == sorted(sum(x[0] == k for x in rows) for k, *_ in want)


def densest_plain(v, lo, hi):
    ends = [(-sum(v[i : j + 1]) / (j + 1 - i), j, -i) for i in range(len(v)) for j in range(i + lo - 1, min(i + hi, len(v)))]
    if ends:
        m, j, i = min(ends)
        return -i, j, sum(v[-i : j + 1])


def test_densest_stretch_like_all_pairs():
    rng = np.random.default_rng(21)
    for _ in range(600):
        v = rng.integers(1, int(rng.choice([2, 4, 1000])), rng.integers(0, 25)).tolist()
        lo, hi = sorted(map(int, rng.integers(1, 12, 2)))
        assert G.densest(np.array(v, np.int64), lo, hi) == densest_plain(v, lo, hi), (v, lo, hi)
    huge = np.full(3000, 1 << 50)
    huge[1500] += 1
    assert G.densest(huge, 1000, 1999) == (501, 1500, 1000 * (1 << 50) + 1)  # beyond 64 bits
    assert G.densest(np.array([3, 1]), 2, 1) is None


@pytest.mark.parametrize("dense", [1, 1 << 16])
def test_densest_segments_of_runs(spark, monkeypatch, dense):
    monkeypatch.setattr(G, "DENSE", dense)
    rng = np.random.default_rng(22)
    rows, want, p = [], [], Params(min_region=3, max_region=9)
    for k in range(12):
        v = rng.integers(1, 9, rng.integers(1, 90)).tolist()
        rows += [(k, i + 5, float(x)) for i, x in enumerate(v)] + [(k, len(v) + 5, None), (k, len(v) + 6, 2.0)]
        if len(v) >= 3:
            i, j, total = densest_plain(v, 3, 9)
            want.append((k, 5, i + 5, j + 5, total / (j - i + 1)))
    got = G.densest_segments(spark.createDataFrame(rows, "seq_idx int, pos int, pds double"), p)
    assert sorted(tuple(r)[:4] for r in got.collect()) == [w[:4] for w in sorted(want)]
    assert np.allclose(sorted(r["mean"] for r in got.collect()), sorted(w[4] for w in want), atol=1e-6)
    assert G.densest_segments(spark.createDataFrame(rows[:1], "seq_idx int, pos int, pds double"), p).count() == 0


def test_no_region_if_bounds_cross(spark):
    s = sequences(spark, random_sequence(np.random.default_rng(1), 600))
    assert R.regions(s, Params(min_region=50, max_region=40)).count() == 0


def test_region_properties(spark):
    rng = np.random.default_rng(8)
    seqs = [random_sequence(rng, 900, 2) for _ in range(4)]
    rows = R.regions(sequences(spark, *seqs, seqs[0]), SMALL).collect()
    assert rows
    for k in range(5):
        mine = sorted((r for r in rows if r.seq_idx == k), key=lambda r: r.Start)
        assert sorted(r.Rank for r in mine) == list(range(1, len(mine) + 1))
        assert [r.Region_ID for r in mine] == [f"LPR_{i + 1:06d}" for i in range(len(mine))]
        assert all(b.Signal_Start - a.Signal_End > SMALL.merge_gap for a, b in zip(mine, mine[1:]))
        by_score = sorted(mine, key=lambda r: (-r.Region_Score, r.Start))
        assert [r.Rank for r in by_score] == list(range(1, len(mine) + 1))
        for r in mine:
            assert r.Signal_End - r.Signal_Start + 1 >= SMALL.min_region and 1 <= r.Min_Perplexity <= r.Max_Perplexity <= 16
            assert r.Sequence == (seqs + seqs[:1])[k][r.Start : r.End + 1] and r.Persistence == 1
            _, sm, pds = plain_signals((seqs + seqs[:1])[k], SMALL)
            part = pds[r.Signal_Start : r.Signal_End + 1]
            part = part[~np.isnan(part)]
            assert math.isclose(r.Variance, part.var(), rel_tol=1e-4, abs_tol=1e-9) and math.isclose(r.Perplexity_Depression_Score, part.mean(), rel_tol=1e-5)
    assert [(r.Start, r.Rank) for r in rows if r.seq_idx == 0] == [(r.Start, r.Rank) for r in rows if r.seq_idx == 4]


def region_rows(spark, rows):
    return spark.createDataFrame([(i, f"s{i}", f"LPR_{k:06d}", a, b, s, g, q) for k, (i, a, b, s, g, q) in enumerate(rows)], "seq_idx long, sequence_id string, Region_ID string, Signal_Start int, Signal_End int, Region_Score double, GC_Content double, Sequence string")


def test_motifs(spark):
    assert M.pattern("tatawawr") == "TATA[AT]A[AT][AG]" and M.pattern("UAUA") == "UAUA" and M.pattern("  ") == ""
    with pytest.raises(ValueError):
        M.parse("A(")
    df = region_rows(spark, [(0, 0, 5, 1.0, 0.0, "AAAAAAAAaaaaaaaTATAAAAG"), (0, 9, 12, 1.0, 0.0, "")]).withColumns({"Motif_Count": F.lit(0), "Motifs": F.lit("")})
    got = sorted(M.annotate(df, M.parse("A{7}|T{7}\n\nTATAWAWR\nGGG")).collect())
    assert [(r.Motif_Count, r.Motifs) for r in got] == [(3, "A{7}|T{7}:2;TATAWAWR:1"), (0, "")]
    assert M.with_hits(M.annotate(df, M.parse("GGG"))).count() == 0


def test_population(spark):
    p = spark.createDataFrame([(i, 1.0 if 2 <= i <= 4 else 0.5 if i in (8, 20) else 0.0, 1.0, None, 2.0, 0.5) for i in range(25)], "pos int, lpr_frequency double, mean_region_score double, mean_pds double, mean_perplexity double, gc_map double")
    c = P.consensus(p, 0.5, gap=4)
    assert sorted((r.region_id, r.consensus_start, r.consensus_end, r.mean_pds) for r in c.collect()) == [("CLPR_0001", 2, 8, 0.0), ("CLPR_0002", 20, 20, 0.0)]
    seqs = sequences(spark, "A" * 30, "C" * 30, "G" * 30)
    regions = region_rows(spark, [(0, 0, 2, 4.0, 10.0, "TATA"), (0, 5, 6, 2.0, 30.0, "TATA"), (1, 19, 99, 1.0, 50.0, "")])
    occ = P.occurrence(seqs, regions, c)
    assert sorted((r.seq_idx, r.region_id, r.present) for r in occ.collect()) == [(0, "CLPR_0001", 1), (0, "CLPR_0002", 0), (1, "CLPR_0001", 0), (1, "CLPR_0002", 1), (2, "CLPR_0001", 0), (2, "CLPR_0002", 0)]
    assert sorted(map(tuple, P.occurrence_matrix(occ).collect())) == [(0, "s0", 1, 0), (1, "s1", 0, 1), (2, "s2", 0, 0)]
    motifs = M.parse("TATA")
    assert [tuple(r) for r in P.motif_frequencies(regions, c, motifs, 1).collect()] == [("CLPR_0001", "TATA", 2.0)]
    assert [tuple(r) for r in P.motif_frequencies(regions, c, motifs, 1, distinct_sequences=True).collect()] == [("CLPR_0001", "TATA", 1.0)]
    cover = {r.pos: (r.n_regions, r.score, r.gc) for r in P.coverage(regions, 21).collect()}
    assert cover[5] == (1, 2.0, 0.3) and cover[20] == (1, 1.0, 0.5) and 3 not in cover
    assert P.eligible(seqs).first().eligible and not P.eligible(sequences(spark, "A" * 30)).first().eligible and not P.eligible(sequences(spark, "A" * 30, "A" * 31)).first().eligible
    gc = [r.mean_gc for r in P.gc_profile(sequences(spark, "GAAAAAAAAAAAAAAAAAAAAAAAAAAAAC"), 30).orderBy("pos").collect()]
    padded = np.pad([1] + [0] * 28 + [1], 10, "edge")
    assert np.allclose(gc, [padded[k : k + 21].mean() for k in range(30)])


def test_sinks(spark, tmp_path):
    r = R.regions(sequences(spark, FRAGMENT))
    for fmt in ("csv", "tsv", "json"):
        sinks.write_table(r, str(tmp_path / fmt), fmt, advanced=True, single=True)
    with pytest.raises(ValueError):
        sinks.write_table(r, str(tmp_path / "x"), "yaml")
    back = spark.read.option("header", True).csv(str(tmp_path / "csv"))
    assert back.count() == r.count()
    if r.count():
        assert back.columns[0] == "Sequence_ID" and set(R.ADVANCED) <= set(back.columns) and "Signal_Start" not in back.columns
        assert [tuple(x)[:4] for x in sinks.bed(r).collect()] == [("s0", 1082, 1239, "LPR_000001")]
        assert sinks.fasta_lines(r).first()[0].startswith(">LPR_000001|s0:1082-1238|Region_Score=62.123")
        fields = sinks.gff_lines(M.annotate(r, M.parse("AT{1,}\nTA")), escape=True).first()[0].split("\t")
        assert fields[3:5] == ["1083", "1239"] and fields[8].count(";") == 5 and "%3B" in fields[8]
        sinks.write_lines(sinks.gff_lines(r), str(tmp_path / "gff"), "##gff-version 3")
        parts = [x.read_text() for x in sorted((tmp_path / "gff").glob("part-*"))]
        assert "".join(parts).startswith("##gff-version 3\ns0\tseqtrough\t") and len("".join(parts).splitlines()) == 2
        assert "Region_Score=62.123" in "".join(parts)


def test_four_digits(spark):
    values = [0.0, 1.0, 62.12346434, -0.00004, -1.5, 0.00005, 123456.789]
    got = spark.createDataFrame([(v,) for v in values], "v double").select(sinks.four("v").alias("t")).collect()
    assert [r.t for r in got] == ["0.0000", "1.0000", "62.1235", "0.0000", "-1.5000", "0.0001", "123456.7890"]


def test_views(spark):
    df = spark.createDataFrame([(float(v),) for v in (0, 1, 5, 10, 10)], "v double")
    assert sorted((r.bin, r.n) for r in V.histogram(df, F.col("v"), 10).collect()) == [(0, 1), (1, 1), (5, 1), (9, 2)]
    assert [r.n for r in V.histogram(df.where("v = 1"), F.col("v"), 10).collect()] == [1]


def test_streaming(spark, tmp_path):
    from seqtrough.streaming.incremental import stream_regions

    s = sequences(spark, random_sequence(np.random.default_rng(3), 600), random_sequence(np.random.default_rng(4), 600))
    s.write.parquet(str(tmp_path / "in"))
    q = stream_regions(spark.readStream.schema(s.schema).parquet(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "check"), SMALL)
    q.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).drop("batch").count() == R.regions(s, SMALL).count() > 0


def test_signals_shuffle_nothing(spark):
    plan = lambda c: S.signals(sequences(spark, "ACGT" * 30), chunk=c)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan(0) and plan(50).count("Exchange") == 1 == plan(None).count("Exchange")  # of long sequences alone


def test_pieces_tell_the_windows_around_gaps():
    seq = b"ACGTTGCA" * 20 + b"N" * 700 + b"ACGTTGGA" * 20 + b"N" * 900 + b"A" * 17
    p = Params()
    whole = [k for k in range(len(seq) - 16) if b"N" not in seq[k : k + 17]]
    for x in S.pieces(seq, p, 100):
        last = min(x.high + p.halo, x.n)
        assert x.letters == seq[x.first : last + 16]
        before, after = [k for k in whole if k < x.first], [k for k in whole if k >= last]
        assert (x.before, x.after) == (before[-1] if before else None, after[0] if after else None)
        assert x.before is None or x.before_letters == seq[x.before : x.before + 17]


def test_small_windows(spark):
    for w in (1, 2, 3):
        rows = S.signals(sequences(spark, "ACNGTTTTTACGA"), Params(window=w, flank=2, spacer=1, min_candidate=2, max_candidate=2)).orderBy("pos").collect()
        assert [r.di is None for r in rows] == ["N" in "ACNGTTTTTACGA"[k : k + w] for k in range(14 - w)] and all(r.di is None or 1 <= r.di <= max(1, w - 1) for r in rows)


@pytest.mark.parametrize("chunk", [None, 0, 50])
def test_prefix_sums_like_plain(spark, monkeypatch, chunk):
    monkeypatch.setattr(S, "LONG", 300)
    monkeypatch.setattr(S, "PIECE", 120)  # of what is dealt out
    rng = np.random.default_rng(12)
    seqs = [random_sequence(rng, n, g) for n, g in ((17, 0), (60, 1), (301, 3), (900, 5), (640, 0))] + ["N" * 400, "ACG"]
    rows = S.prefix_sums(sequences(spark, *seqs), SMALL, chunk).collect()
    assert len(rows) == sum(max(0, len(x) - 16) for x in seqs)
    for k, seq in enumerate(seqs):
        got = sorted((r.pos, r.cs, r.cn) for r in rows if r.seq_idx == k)
        if got:
            _, sm, _ = plain_signals(seq, SMALL)
            assert [n for *_, n in got] == np.cumsum(~np.isnan(sm)).tolist()
            assert np.abs(np.array([c for _, c, _ in got]) - np.cumsum(np.floor(np.nan_to_num(sm) * 1e6 + 0.5))).max() <= len(got)


def test_a_long_sequence_is_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(S, "LONG", 5_000)
    monkeypatch.setattr(S, "PIECE", 1_000)
    one = sequences(spark, random_sequence(np.random.default_rng(13), 20_000, 9), "ACGT" * 100)
    rows = S.signals(one)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    dealt = rows.where("seq_idx = 0").groupBy(F.spark_partition_id()).count().collect()
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(dealt) > 1 and max(r["count"] for r in dealt) < 15_000
    assert rows.exceptAll(S.signals(one, chunk=0)).count() == 0 == S.signals(one, chunk=0).exceptAll(rows).count()


def test_ranges_hold_their_values(spark):
    seq = random_sequence(np.random.default_rng(14), 400, 3)
    _, sm, _ = plain_signals(seq, SMALL)
    for r in S.tracks(sequences(spark, seq), SMALL, wanted=("up", "reg", "dn")).collect():
        for k, (a, b) in SMALL.frames.items():
            part = sm[max(r.pos + a, 0) : max(r.pos + b, 0)] if r.pos + a >= 0 and r.pos + b <= len(sm) else np.array([])
            part = part[~np.isnan(part)]
            assert r[k] is None if not len(part) else abs(r[k] - part.mean()) < 2e-6


@pytest.mark.parametrize("bucket", [4, 1024])
def test_coverage_like_every_position_of_every_region(spark, monkeypatch, bucket):
    monkeypatch.setattr(P, "BUCKET", bucket)
    rng = np.random.default_rng(15)
    rows = [(k, int(a), int(a + n), float(s), float(g), "") for k, (a, n, s, g) in enumerate(zip(rng.integers(-5, 70, 40), rng.integers(0, 30, 40), rng.integers(0, 99, 40), rng.integers(0, 99, 40)))]
    want = {}
    for _, a, b, s, g, _ in rows:
        a = max(0, min(a, 59))
        for pos in range(a, max(a, min(b, 59)) + 1):
            want.setdefault(pos, []).append((s, g))
    got = {r.pos: (r.n_regions, r.score, r.gc) for r in P.coverage(region_rows(spark, rows), 60).collect()}
    assert got.keys() == want.keys()
    for pos, x in want.items():
        assert got[pos][0] == len(x) and np.allclose(got[pos][1:], (np.mean([s for s, _ in x]), np.mean([g for _, g in x]) / 100))
    assert P.coverage(region_rows(spark, rows).limit(0), 60).count() == 0


@pytest.mark.parametrize("piece", [7, 1 << 16])
def test_gc_profile_like_padded_windows(spark, monkeypatch, piece):
    monkeypatch.setattr(P, "PIECE", piece)
    monkeypatch.setattr(P, "LONG", 60)
    monkeypatch.setattr(P, "HELD", 3 * piece)
    rng = np.random.default_rng(16)
    seqs = ["".join(rng.choice(list("ACGTN"), n)) for n in (1, 5, 40, 61, 90, 40)]
    got = {r.pos: r.mean_gc for r in P.gc_profile(sequences(spark, *seqs, ""), 50).collect()}
    want = np.zeros(50)
    for s in seqs:
        flags = np.pad([c in "GC" for c in s], 10, "edge").astype(float)
        for pos in range(min(50, len(s))):
            want[pos] += flags[pos : pos + 21].mean()
    assert sorted(got) == list(range(50)) and np.allclose([got[k] for k in range(50)], want / 7)


def test_words_in_one_pass_like_expressions(spark):
    import re

    rng = np.random.default_rng(23)
    motifs = M.motif_list("AA\naNa\nNN\nUA\nACACA\nt.")
    seqs = ["".join(rng.choice(list("ACGTN"), int(n), p=[0.3, 0.2, 0.2, 0.28, 0.02])) for n in rng.integers(0, 400, 60)] + ["A" * 50, "acacacaca" * 5, "é", ""]
    words = [m for m, p in motifs if M._WORD.fullmatch(m)]
    assert len(words) == 14
    for s in seqs:
        assert M.Words([w.upper() for w in words]).counts(s.encode()) == [len(re.findall(f"(?i){M.pattern(w)}", s)) for w in words]
    df = spark.createDataFrame([(k, "LPR", s, 7) for k, s in enumerate(seqs)] + [(99, "LPR", None, 7)], "seq_idx int, Region_ID string, Sequence string, _hits0 int")
    got = {(r.seq_idx, r.motif_ord): (r.motif, r.hits) for r in M.counts(df, motifs).collect()}
    for k, s in enumerate(seqs):
        for j, (m, p) in enumerate(motifs):
            assert got[k, j] == (m, len(re.findall(f"(?i){p}", s))), (s, m)
    plan = M.with_hit_counts(df, motifs)[0]._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1  # one scan for all words
    many = [("A" * k, "A" * k) for k in range(1, 70)]
    assert [r.hits for r in M.counts(df.where("seq_idx = 60"), many).orderBy("motif_ord").collect()] == [50 // k for k in range(1, 70)]


def test_validation_is_the_running_engines(spark):
    text = "TATAWAWR\n\n (?P<x>TA)\n(?<x>TA)\nA(\nA{7}|T{7}\n[A\n*A"
    got = [(r.motif, r.status) for r in M.validate(spark, text).orderBy("motif_ord").collect()]
    assert got == [("TATAWAWR", "valid"), ("(?P<x>TA)", "invalid"), ("(?<x>TA)", "valid"), ("A(", "invalid"), ("A{7}|T{7}", "valid"), ("[A", "invalid"), ("*A", "invalid")]
    with pytest.raises(ValueError, match="P<x>"):
        M.parse("TATA\n(?P<x>TA)")
    odd = spark.createDataFrame([(None,), (" ",), (" tata ",), ("T**A(",)], "motif string")
    assert [r.status for r in M.validated(odd).collect()] == [None, None, "valid", "invalid"]


def test_one_pass_and_rows_of_positions_give_the_same_regions(spark):
    rng = np.random.default_rng(31)
    some = sequences(spark, *(random_sequence(rng, int(n), int(g)) for n, g in zip(rng.integers(300, 1500, 6), rng.integers(0, 4, 6))), "ACG", "N" * 300)
    one, rows = (sorted(map(tuple, df.collect())) for df in (R.regions(some, SMALL), R.regions(some, SMALL, signals=S.signals(some, SMALL))))
    assert len(one) > 5 and one == rows


def test_long_sequences_go_by_pieces(spark, monkeypatch):
    monkeypatch.setattr(R, "LONG", 1000)
    rng = np.random.default_rng(32)
    some = sequences(spark, *(random_sequence(rng, n, 2) for n in (700, 1400, 900, 2200)))
    mixed = sorted(map(tuple, R.regions(some, SMALL).collect()))
    monkeypatch.setattr(R, "LONG", 1 << 20)
    assert mixed == sorted(map(tuple, R.regions(some, SMALL).collect())) and len({r[0] for r in mixed}) > 2


@pytest.mark.parametrize("squares", [3, 10_000])
def test_sums_by_position_like_signals(spark, monkeypatch, squares):
    monkeypatch.setattr(P, "SQUARES", squares)
    monkeypatch.setattr(P, "LONG", 500)
    rng = np.random.default_rng(33)
    some = sequences(spark, *(random_sequence(rng, n, g) for n, g in ((400, 0), (400, 3), (650, 1), (400, 0), (30, 0), (700, 0))), "AC")
    want = {r.pos: r for r in P.signal_profile(S.signals(some, SMALL)).collect()}
    got = {r.pos: r for r in P.sequence_profile(some, SMALL).collect()}
    assert got.keys() == want.keys() and any(r.mean_pds for r in got.values())
    for pos, r in got.items():
        assert tuple(r) == tuple(want[pos]), pos


def test_sparse_matrix_of_any_width(spark, monkeypatch):
    monkeypatch.setattr(P, "ROWS", 7)
    monkeypatch.setattr(P, "COLUMNS", 2)  # joins instead of broadcasts
    rng = np.random.default_rng(34)
    seqs = spark.createDataFrame([(k, f"s,{k}") for k in range(40)], "seq_idx long, sequence_id string")
    cons = spark.createDataFrame([(f"CLPR_{k + 1:04d}", 100 * k, 100 * k + 40) for k in range(30)], "region_id string, consensus_start int, consensus_end int")
    spans = [(int(s), int(a), int(a + n)) for s, a, n in zip(rng.integers(0, 30, 90), rng.integers(0, 3000, 90), rng.integers(0, 150, 90))]
    regions = spark.createDataFrame(spans, "seq_idx long, Signal_Start int, Signal_End int")
    has = {(s, f"CLPR_{k + 1:04d}") for s, a, b in spans for k in range(30) if a <= 100 * k + 40 and b >= 100 * k}
    blocks = P.occurrence_blocks(seqs, regions, cons)
    assert 1 < blocks.count() <= 6 and sum(len(r.gaps) for r in blocks.collect()) == len(has)
    held = {r.seq_idx: r.held for r in P.unpacked(blocks).collect()}
    assert {(s, f"CLPR_{c + 1:04d}") for s, cs in held.items() for c in cs} == has and len(held) == 40
    cells = P.occurrence(seqs, regions, cons).collect()
    assert len(cells) == 1200 and {(r.seq_idx, r.region_id) for r in cells if r.present} == has
    lines = sorted(r.value for r in P.occurrence_lines(blocks, 30).collect())
    assert lines == sorted(",".join([f'"s,{s}"', *("1" if (s, f"CLPR_{k + 1:04d}") in has else "0" for k in range(30))]) for s in range(40))
    with pytest.raises(ValueError, match="blocks"):
        P.occurrence_matrix(P.occurrence(seqs, regions, cons))
    none = P.occurrence_blocks(seqs, regions, cons.limit(0))
    assert P.unpacked(none).count() == 40 and P.occurrence(seqs, regions, cons.limit(0)).count() == 0 and P.occurrence_blocks(seqs.limit(0), regions, cons).count() == 0


def test_round_bins(spark):
    df = spark.createDataFrame([(float(v),) for v in (3, 7, 12, 99, 99)] + [(None,)], "v double")
    assert sorted(map(tuple, V.round_histogram(df, F.col("v"), 10).collect())) == [(0, 0.0, 10.0, 2), (1, 10.0, 20.0, 1), (9, 90.0, 100.0, 2)]
    assert [tuple(r) for r in V.round_histogram(df.where("v = 7"), F.col("v"), 10).collect()] == [(0, 7.0, 8.0, 1)]
    rng = np.random.default_rng(35)
    for scale, bins in ((0.01, 7), (1.0, 40), (3e6, 60)):
        v = rng.normal(size=200) * scale
        rows = V.round_histogram(spark.createDataFrame([(float(x),) for x in v], "v double"), F.col("v"), bins).collect()
        width = rows[0].high - rows[0].low
        assert sum(r.n for r in rows) == 200 and all(0 <= r.bin <= bins for r in rows) and f"{width:.3e}"[:5] in ("1.000", "2.000", "5.000")
        assert all(r.n == ((v >= r.low) & (v < r.high)).sum() for r in rows)
    assert V.round_histogram(df.limit(0), F.col("v"), 5).count() == 0


def test_sql_functions(spark):
    from seqtrough.functions import sql

    sql.register(spark)
    some = [FRAGMENT, FRAGMENT.lower().replace("t", "u") + "xyz", "ACGT", None, ""]
    spark.createDataFrame(list(enumerate(some)), "k int, seq string").createOrReplaceTempView("some_sequences")
    rows = spark.sql("SELECT k, r.* FROM some_sequences, LATERAL regions(seq) r ORDER BY k").collect()
    (want,) = R.regions(sequences(spark, FRAGMENT)).collect()
    assert [r.k for r in rows] == [0, 1]
    for r in rows:
        assert all(r[c] == pytest.approx(want[c], rel=1e-12) if isinstance(want[c], float) else r[c] == want[c] for c in rows[0].__fields__ if c != "k")
    assert spark.sql("SELECT count(*) FROM some_sequences, LATERAL regions(seq, min_region => 900) r").first()[0] == 0
    (di, pds, gc) = spark.sql("SELECT di_profile(seq), pds_profile(seq), gc_profile(seq) FROM some_sequences WHERE k = 0").first()
    plain = plain_signals(FRAGMENT)
    for got, x, tol in ((di, plain[0], 1e-9), (pds, plain[2], 2e-6)):
        assert np.array_equal([v is None for v in got], np.isnan(x)) and np.nanmax(np.abs(np.array(got, float) - x)) < tol
    flags = np.pad([c in "GC" for c in FRAGMENT], 10, "edge").astype(float)
    assert np.allclose(gc, [flags[k : k + 21].mean() for k in range(len(FRAGMENT))])
    assert [tuple(r) for r in spark.sql("SELECT di_profile(seq), gc_profile(seq) FROM some_sequences WHERE k > 2").collect()] == [([], [])] * 2


def test_population_stream_goes_on_after_a_restart(spark, tmp_path):
    from seqtrough.streaming import population as stream

    rng = np.random.default_rng(41)
    same = [random_sequence(rng, 400, k % 3) for k in range(9)]
    source, out, check = (str(tmp_path / x) for x in ("in", "out", "check"))

    def put(*seqs):
        spark.createDataFrame([(x,) for x in seqs], "seq string").repartition(2).write.mode("append").parquet(source)

    def run():
        stream.stream_profile(spark.readStream.schema("seq string").parquet(source), out, check, 384, SMALL).awaitTermination(120)
        return {r.pos: r for r in stream.read_profile(spark, out).collect()}

    def batch(seqs):
        some = sequences(spark, *seqs)
        return {r.pos: r for r in P.profile(P.sequence_profile(some, SMALL), R.regions(some, SMALL), len(seqs), 384).collect()}

    put(*same[:4], "ACGT" * 50, None)
    first = run()
    assert first[0].n_sequences == 4 and first[0].n_aside == 2
    put(*same[4:], same[0] + "A")
    for got, want in ((first, batch(same[:4])), (run(), batch(same))):  # the same as in one batch
        assert got.keys() == want.keys() == set(range(384))
        for pos, r in want.items():
            assert all(got[pos][c] == pytest.approx(r[c], abs=1e-9) if r[c] is not None else got[pos][c] is None for c in r.__fields__), pos
    assert run()[0].n_sequences == 9  # nothing new, nothing twice


def test_texts_are_sanitised_once(spark):
    """No filter on letters works a text out again, and the letters are those of the column expression."""
    from seqtrough.functions.columns import sanitised

    texts = spark.createDataFrame([(1, "acgu nNñŉ x"), (2, ""), (3, None), (4, "zz"), (5, "UuTt-ẗﬆ")], "id int, text string")
    kept = fasta.from_table(texts, "id", "text").where("seq_len >= 2").where("length(seq) < 100")
    plan = kept._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "regexp" not in plan and "translate" not in plan
    want = {r.id: r.seq for r in texts.select("id", sanitised(F.col("text")).alias("seq")).collect()}
    assert {r.seq_idx: r.seq for r in fasta.from_table(texts, "id", "text").collect()} == want
    assert {r.seq_idx: (r.seq, r.seq_len) for r in fasta.from_table(texts, "id", "text", masked=False).collect()} == {k: (v and v.replace("N", ""), None if v is None else len(v.replace("N", ""))) for k, v in want.items()}


def test_pieces_side_by_side_like_each_alone():
    rng = np.random.default_rng(21)
    seqs = [random_sequence(rng, int(n), g).encode() for n, g in zip((*range(17, 45), 300, 900), [0, 1, 2] * 10)] + [b"N" * 60, b"ACGT" * 90]
    for size in (40, 1 << 16):
        xs = [x for seq in seqs for x in S.pieces(seq, SMALL, size)]
        for x, y in zip(xs, S.piece_signals(xs, SMALL)):
            assert all((a == b).all() for a, b in zip(y, S.piece_signals([x], SMALL)[0])) and len(y.d) == x.high - x.low


def test_prefix_sums_write_no_row_for_a_position(spark, monkeypatch):
    kept, sizes = S.written, []
    monkeypatch.setattr(S, "written", lambda df: sizes.append((out := kept(df)).count()) or out)
    some = sequences(spark, random_sequence(np.random.default_rng(22), 5_000, 3), "ACGT" * 300)
    assert S.prefix_sums(some, SMALL, 500).count() == 5_000 + 1_200 - 32 and max(sizes) <= 13
    assert S.prefix_sums(some, SMALL).count() == 5_000 + 1_200 - 32 and max(sizes) <= 13


def test_a_stream_works_a_batch_out_once(spark, tmp_path, monkeypatch):
    """The profile is made of a table that a batch's own tasks have written, not of the stream's plan twice or in one task."""
    from seqtrough.streaming import population as streamed

    plans, kept = [], streamed.profile
    monkeypatch.setattr(streamed, "profile", lambda df: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or kept(df))
    spark.createDataFrame([(random_sequence(np.random.default_rng(k), 400),) for k in range(3)], "seq string").write.parquet(str(tmp_path / "in"))
    streamed.stream_profile(spark.readStream.schema("seq string").parquet(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "check"), 384, SMALL).awaitTermination(120)
    assert len(plans) == 1 and plans[0].strip().endswith("parquet") and streamed.read_profile(spark, str(tmp_path / "out")).count() == 384


def test_profile_functions_hold_no_numbers_of_python():
    import tracemalloc

    import pyarrow as pa

    from seqtrough.functions import sql

    texts = pa.array(["ACGTTGCA" * 250, None, "ac"] * 300)
    of = sql._profile(sql._di).func
    of(texts.slice(0, 3))
    tracemalloc.start()
    got = of(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [len(x) for x in got[:3]] == [1984, 0, 0] and len(got) == 900
    assert peak < 24 * 1984 * 300  # a number of Python's own and its place are 32 bytes, without the array it is copied from


def test_histograms_work_regions_out_once(spark, monkeypatch):
    from seqtrough.plans import queries as Q

    calls = []
    monkeypatch.setattr(Q, "written", lambda df: calls.append(df) or df.limit(0))
    monkeypatch.setattr(Q, "_regions", lambda spark, sf_dir: region_rows(spark, [(0, 0, 5, 1.0, 0.0, "")]))
    for name in ("length_hist", "length_round_hist", "score_hist", "score_round_hist", "boundary_hist"):
        Q.QUERIES[name](spark, "")
    assert len(calls) == 5


def seen_once(spark, sequences):
    """``sequences`` and a count of how often tasks took its rows."""
    taken = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            taken.add(batch.num_rows)
            yield batch

    return sequences.mapInArrow(count, sequences.schema), taken


def test_windows_of_all_partitions_in_any_order_like_plain_sums():
    rng = np.random.default_rng(51)
    p, m = Params(), 16
    assert len({sum(S.WEIGHTS[c] for c in x) for x in S._partitions(m, m)}) == 231
    some = [b"".join([x * int(k) for x, k in zip((b"AC", b"G", b"TT", b"N"), rng.integers(0, 9, 4))]) for _ in range(4000)] + [b"ACGT" * 30, b"A" * 40]
    code = S.codes(b"".join(some))
    din, terms, n = S.dinucleotides_of(code), np.array(S.entropy_terms(m)), len(code) - m
    total = np.zeros(n)
    for d in range(16):
        upto = np.concatenate([[0], np.cumsum(din == d)])
        total += terms[upto[m : m + n] - upto[:n]]
    masked = np.array([(code[k : k + p.window] < 0).any() for k in range(n)])
    assert np.array_equal(S.perplexities(code, p), np.where(masked, np.nan, 2.0 ** (4.0 - total / 16.0)), equal_nan=True)


def test_counts_of_values_like_signals_and_no_row_for_a_position(spark):
    rng = np.random.default_rng(52)
    some, taken = seen_once(spark, sequences(spark, *(random_sequence(rng, n, g) for n, g in ((400, 0), (650, 2), (900, 30), (30, 0))), "AC", "N" * 50))
    want = S.signals(some, SMALL).groupBy("seq_idx").agg(F.count("*"), F.count("di"), F.count("smoothed"), F.count("pds"))
    assert sorted(map(tuple, S.counts(some, SMALL).collect())) == sorted(map(tuple, want.collect())) and taken.value == 2 * 6


def test_tracks_and_regions_take_a_sequence_once(spark):
    rng = np.random.default_rng(53)
    seqs = [random_sequence(rng, n, 1) for n in (700, 900, 1400)]
    for work in (lambda x: S.tracks(x, SMALL, wanted=("pds",)), lambda x: R.regions(x, SMALL), lambda x: P.surveyed(x, SMALL)[0]):
        some, taken = seen_once(spark, sequences(spark, *seqs))
        assert work(some).count() and taken.value == len(seqs)


@pytest.mark.parametrize("long", [500, 1 << 20])
def test_regions_and_profile_of_one_pass_like_each_alone(spark, monkeypatch, long):
    monkeypatch.setattr(R, "LONG", long)
    monkeypatch.setattr(R, "SQUARES", 2)
    rng = np.random.default_rng(54)
    some = sequences(spark, *(random_sequence(rng, n, g) for n, g in ((700, 1), (400, 3), (650, 0), (1400, 2), (30, 0))), "AC")
    found, told = P.surveyed(some, SMALL)
    want = P.signal_profile(S.signals(some, SMALL))
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, R.regions(some, SMALL).collect())) and found.count()
    assert {r.pos: tuple(r) for r in told.collect()} == {r.pos: tuple(r) for r in want.collect()}


def test_folders_of_sequences_are_dealt_over_all_tasks(spark, tmp_path):
    """Their bytes are few, so that tasks chosen by bytes would be one."""
    rows = spark.range(60).select(F.concat(F.lit("s"), "id").alias("Sequence_ID"), F.lit("R").alias("Region_ID"), F.col("id").alias("Length"))
    sinks.write_table(rows.repartition("Sequence_ID"), str(tmp_path / "out"), "json", by_sequence=True)
    parts = [x.name[:10] for x in (tmp_path / "out").glob("*/part-*")]
    assert len(parts) == 60 and len(set(parts)) == 4
    assert spark.read.json(str(tmp_path / "out")).agg(F.sum("Length")).first()[0] == 60 * 59 // 2
