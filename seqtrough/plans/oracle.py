"""The same analyses as plain SQL, against which the queries' results are held."""

from __future__ import annotations

import math

from ..functions.params import EPSILON, Params, entropy_terms, hats
from ..operators.motifs import Motif

SEQ_RAW = "SELECT doc_id AS seq_idx, CAST(doc_id AS VARCHAR) AS sequence_id, regexp_replace(translate(upper(text), 'U', 'T'), '[^ACGTN]', '', 'g') AS seq FROM documents"
SEQ_ACGT = f"SELECT seq_idx, sequence_id, replace(seq, 'N', '') AS seq FROM ({SEQ_RAW}) WHERE length(replace(seq, 'N', '')) >= 540"
TILE = 800
#: More than the tiles of any sequence: a text has fewer than 2^31 letters.
TILES = 10_000_000
SEQ_POP = f"""SELECT seq_idx * {TILES} + t AS seq_idx, sequence_id || ':' || t AS sequence_id, rpad(substr(seq, CAST(t * {TILE} + 1 AS BIGINT), {TILE}), {TILE}, 'N') AS seq
FROM (SELECT *, unnest(range(CAST(ceil(length(seq) / {TILE}.0) AS BIGINT))) AS t FROM ({SEQ_ACGT}))"""


#: Every sequence of letters in equal parts, the last filled up with N.
SEQ_TILES = f"""SELECT seq_idx * {TILES} + t AS seq_idx, sequence_id || ':' || t AS sequence_id, rpad(substr(seq, CAST(t * {TILE} + 1 AS BIGINT), {TILE}), {TILE}, 'N') AS seq
FROM (SELECT *, unnest(range(CAST(ceil(length(seq) / {TILE}.0) AS BIGINT))) AS t FROM (SELECT seq_idx, sequence_id, replace(seq, 'N', '') AS seq FROM ({SEQ_RAW}) WHERE replace(seq, 'N', '') <> ''))"""


def four(x: str) -> str:
    """Four digits after the point."""
    v = f"CAST(floor(({x}) * 10000.0 + 0.5) AS BIGINT)"
    return f"(CASE WHEN {v} < 0 THEN '-' ELSE '' END || CAST(abs({v}) // 10000 AS VARCHAR) || '.' || lpad(CAST(abs({v}) % 10000 AS VARCHAR), 4, '0'))"


def micro(x: str) -> str:
    return f"CAST(floor(({x}) * 1000000.0 + 0.5) AS BIGINT)"


def r(x: str, digits: int = 6) -> str:
    return f"(floor(({x}) * {float(10**digits)} + 0.5) / {float(10**digits)})"


def mean(total: str, n: str) -> str:
    return f"CASE WHEN {n} > 0 THEN CAST({total} AS DOUBLE) / CAST({n} AS DOUBLE) / 1000000.0 END"


def _list(x) -> str:
    return "[" + ", ".join(map(_list, x)) + "]" if isinstance(x, list) else repr(float(x))


def di_ctes(seqs: str, p: Params = Params()) -> str:
    """seqs, bases, dins, di(seq_idx, n, pos, di)."""
    m = max(p.window - 1, 1)
    counts = ", ".join(f"count(*) FILTER (WHERE din = {k}) OVER f AS c{k}" for k in range(16))
    total = " + ".join(["0.0", *(f"t[c{k} + 1]" for k in range(16))])
    return f"""seqs AS ({seqs}),
bases AS (SELECT seq_idx, length(seq) AS len, unnest(range(length(seq))) AS pos, unnest(string_split(seq, '')) AS base FROM seqs WHERE length(seq) >= {p.window}),
coded AS (SELECT seq_idx, len - {p.window - 1} AS n, pos, base, CASE base WHEN 'C' THEN 1 WHEN 'G' THEN 2 WHEN 'T' THEN 3 ELSE 0 END AS code, CASE WHEN base IN ('A','C','G','T') THEN 0 ELSE 1 END AS is_n FROM bases),
dins AS (SELECT seq_idx, n, pos, is_n, 4 * code + lead(code) OVER (PARTITION BY seq_idx ORDER BY pos) AS din FROM coded),
counted AS (SELECT seq_idx, n, pos, max(is_n) OVER (PARTITION BY seq_idx ORDER BY pos ROWS BETWEEN CURRENT ROW AND {p.window - 1} FOLLOWING) AS has_n, {counts}, {_list(entropy_terms(m))} AS t
  FROM dins WINDOW f AS (PARTITION BY seq_idx ORDER BY pos ROWS BETWEEN CURRENT ROW AND {max(p.window - 2, 0)} FOLLOWING)),
di AS (SELECT seq_idx, n, pos, CASE WHEN has_n = 0 THEN pow(2.0, {math.log2(m)!r} - ({total}) / {float(m)}) END AS di FROM counted WHERE pos < n)"""


def x_ctes() -> str:
    """filled(seq_idx, n, pos, di, x): gaps interpolated."""
    return """seen AS (SELECT *, CASE WHEN di IS NOT NULL THEN pos END AS fp FROM di),
ends AS (SELECT seq_idx, n, pos, di,
    last_value(fp IGNORE NULLS) OVER b AS x0, last_value(di IGNORE NULLS) OVER b AS y0, first_value(fp IGNORE NULLS) OVER a AS x1, first_value(di IGNORE NULLS) OVER a AS y1 FROM seen
  WINDOW b AS (PARTITION BY seq_idx ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), a AS (PARTITION BY seq_idx ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
filled AS (SELECT seq_idx, n, pos, di, CASE WHEN di IS NOT NULL THEN di WHEN y0 IS NULL THEN y1 WHEN y1 IS NULL THEN y0 ELSE y0 + (y1 - y0) / CAST(x1 - x0 AS DOUBLE) * CAST(pos - x0 AS DOUBLE) END AS x FROM ends)"""


def q_ctes(p: Params = Params()) -> str:
    """smooth(seq_idx, n, pos, di, q)."""
    full = p.sg_window - (p.sg_window % 2 == 0)
    return f"""near AS (SELECT *, list(x) OVER (PARTITION BY seq_idx ORDER BY pos ROWS BETWEEN {full - 1} PRECEDING AND {full - 1} FOLLOWING) AS xs, least({full}, n - CASE WHEN n % 2 = 0 THEN 1 ELSE 0 END) AS wl FROM filled),
placed AS (SELECT *, greatest(least(pos - wl // 2, n - wl), 0) AS s FROM near),
smooth AS (SELECT seq_idx, n, pos, di, CASE WHEN di IS NOT NULL THEN {micro(f"list_inner_product(xs[s - greatest(pos - {full - 1}, 0) + 1 : s - greatest(pos - {full - 1}, 0) + wl], CAST({_list(hats(p))} AS DOUBLE[][][])[(wl - 1) // 2 + 1][pos - s + 1])")} END AS q FROM placed)"""


def sum_ctes(p: Params = Params()) -> str:
    """sums(…, cs, cn) and ranges(…, sum_up, cnt_up, …)."""
    points = sorted({o - 1 for f in p.frames.values() for o in f})
    at = lambda c, o: f"lead({c}, {o}) OVER w" if o > 0 else f"lag({c}, {-o}) OVER w"
    name = lambda c, o: f"{c}_{'m' if o < 0 else ''}{abs(o)}"
    cols = ", ".join(f"{at(c, o)} AS {name(c, o)}" for c in ("cs", "cn") for o in points)
    out = []
    for k, (a, b) in p.frames.items():
        for c, nm in (("cs", "sum"), ("cn", "cnt")):
            out.append(f"CASE WHEN pos + ({a}) >= 0 AND pos + ({b}) <= n THEN {name(c, b - 1)} - coalesce({name(c, a - 1)}, 0) END AS {nm}_{k}")
    return f"""sums AS (SELECT *, CAST(sum(coalesce(q, 0)) OVER w AS BIGINT) AS cs, count(q) OVER w AS cn FROM smooth WINDOW w AS (PARTITION BY seq_idx ORDER BY pos ROWS UNBOUNDED PRECEDING)),
shifted AS (SELECT *, {cols} FROM sums WINDOW w AS (PARTITION BY seq_idx ORDER BY pos)),
ranges AS (SELECT *, {", ".join(out)} FROM shifted)"""


def signal_ctes(seqs: str, p: Params = Params()) -> str:
    """… signals(seq_idx, n, pos, di, smoothed, pds)."""
    ratio = lambda k: f"CAST(sum_{k} AS DOUBLE) / CAST(cnt_{k} AS DOUBLE)"
    under = lambda k: f"sum_{k} * cnt_reg > sum_reg * cnt_{k}"
    pds = f"CASE WHEN cnt_up > 0 AND cnt_reg > 0 AND cnt_dn > 0 AND {under('up')} AND {under('dn')} THEN (({ratio('up')} + {ratio('dn')}) / 2.0 - {ratio('reg')}) / 1000000.0 END"
    return f"""{di_ctes(seqs, p)},
{x_ctes()},
{q_ctes(p)},
{sum_ctes(p)},
signals AS MATERIALIZED (SELECT seq_idx, n, pos, di, q / 1000000.0 AS smoothed, {pds} AS pds FROM ranges)"""


def run_ctes(p: Params = Params()) -> str:
    """runs(seq_idx, start, end, length) of positive pds."""
    return """runs AS (SELECT seq_idx, min(pos) AS s, max(pos) AS e, max(pos) - min(pos) + 1 AS length FROM (SELECT seq_idx, pos, pos - row_number() OVER (PARTITION BY seq_idx ORDER BY pos) AS g FROM signals WHERE pds > 0) GROUP BY seq_idx, g)"""


def merge_cte(source: str, gap: int, key: str = "seq_idx") -> str:
    return f"""SELECT {key}, min(s) AS s, max(e) AS e FROM (SELECT *, sum(fresh) OVER (PARTITION BY {key} ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS g FROM (
    SELECT *, CASE WHEN s <= max(e) OVER (PARTITION BY {key} ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + {gap} THEN 0 ELSE 1 END AS fresh FROM {source})) GROUP BY {key}, g"""


def bound_ctes(seqs: str, p: Params = Params()) -> str:
    """… bounds(seq_idx, s, e)."""
    return f"""{signal_ctes(seqs, p)},
{run_ctes(p)},
bounds AS ({merge_cte(f"(SELECT * FROM runs WHERE length >= {p.min_region})", p.merge_gap)})"""


def region_ctes(seqs: str, p: Params = Params(), motifs: list[Motif] = ()) -> str:
    """… regions: the region table with lower-case s, e beside its own columns."""
    far = p.spacer + p.flank
    inside, up, dn = "pos BETWEEN s AND e", f"pos >= s - {far} AND pos < s - {p.spacer}", f"pos > e + {p.spacer} AND pos <= e + {far}"
    each = lambda c, name, where: f"sum({c}) FILTER (WHERE {where}) AS {name}_sum, count({c}) FILTER (WHERE {where}) AS {name}_n"
    background = f"({mean('coalesce(up_sum, 0) + coalesce(dn_sum, 0)', '(up_n + dn_n)')})"
    raw = f"pds_mean * persistence * ln(CAST(e - s + 1 AS DOUBLE)) / (variance + {EPSILON!r})"
    count = " + ".join([f"len(regexp_extract_all(letters, '(?i){x}'))" for _, x in motifs] or ["0"])
    told = ", ".join(f"CASE WHEN len(regexp_extract_all(letters, '(?i){x}')) > 0 THEN '{m}:' || len(regexp_extract_all(letters, '(?i){x}')) END" for m, x in motifs) or "NULL"
    return f"""{bound_ctes(seqs, p)},
rows AS (SELECT b.s, b.e, g.seq_idx, g.n, g.pos, {micro("g.di")} AS d, {micro("g.smoothed")} AS q, {micro("g.pds")} AS v, g.pds FROM bounds b JOIN signals g ON g.seq_idx = b.seq_idx AND g.pos >= b.s - {far} AND g.pos <= b.e + {far}),
measured AS (SELECT seq_idx, s, e, n, {each("d", "d", inside)}, min(d) FILTER (WHERE {inside}) AS d_min, max(d) FILTER (WHERE {inside}) AS d_max, {each("q", "q", inside)}, min(q) FILTER (WHERE {inside}) AS q_min,
    {each("v", "v", inside)}, sum(v * v) FILTER (WHERE {inside}) AS v_square, count(*) FILTER (WHERE {inside} AND pds > 0) AS v_positive, {each("q", "up", up)}, {each("q", "dn", dn)} FROM rows GROUP BY seq_idx, s, e, n),
parts AS (SELECT m.*, sequence_id, coalesce({mean("v_sum", "v_n")}, 0.0) AS pds_mean, CASE WHEN v_n > 0 THEN CAST(v_positive AS DOUBLE) / CAST(v_n AS DOUBLE) ELSE 0.0 END AS persistence,
    CASE WHEN v_n >= 2 THEN CAST(v_n * v_square - v_sum * v_sum AS DOUBLE) / CAST(v_n * v_n AS DOUBLE) / 1000000.0 / 1000000.0 ELSE 0.0 END AS variance,
    greatest(s, 0) AS first, least(length(seq) - 1, e + {p.window - 1}) AS last, substr(seq, CAST(greatest(s, 0) + 1 AS BIGINT), CAST(least(length(seq) - 1, e + {p.window - 1}) - greatest(s, 0) + 1 AS BIGINT)) AS letters FROM measured m JOIN seqs USING (seq_idx)),
scored AS (SELECT *, greatest(0.0, {raw}) AS score FROM parts),
regions AS (SELECT seq_idx, s, e, printf('LPR_%06d', row_number() OVER (PARTITION BY seq_idx ORDER BY s)) AS Region_ID, s AS Signal_Start, e AS Signal_End, s AS Kadane_Core_Start, e AS Kadane_Core_End,
    first AS Start, last AS "End", last - first + 1 AS Length, {mean("d_sum", "d_n")} AS Mean_Perplexity, d_min / 1000000.0 AS Min_Perplexity, d_max / 1000000.0 AS Max_Perplexity,
    {mean("up_sum", "up_n")} AS Upstream_Mean, {mean("q_sum", "q_n")} AS Region_Mean, {mean("dn_sum", "dn_n")} AS Downstream_Mean, pds_mean AS Perplexity_Depression_Score,
    coalesce(greatest(0.0, {background} - q_min / 1000000.0), 0.0) AS Prominence, persistence AS Persistence, variance AS Variance, sqrt(variance) AS Std_Dev,
    CASE WHEN abs(pds_mean) > {EPSILON!r} THEN sqrt(variance) / abs(pds_mean) ELSE 0.0 END AS CV, coalesce(v_sum / 1000000.0, 0.0) AS AUC_PDS,
    {r("100.0 * (length(letters) - length(replace(replace(letters, 'G', ''), 'C', ''))) / greatest(length(letters), 1)", 2)} AS GC_Content,
    {count} AS Motif_Count, coalesce(array_to_string([x FOR x IN [{told}] IF x IS NOT NULL], ';'), '') AS Motifs, letters AS "Sequence", sequence_id AS Sequence_ID, score AS Region_Score,
    row_number() OVER (PARTITION BY seq_idx ORDER BY score DESC, s) AS Rank FROM scored)"""


def population_ctes(seqs: str = SEQ_POP, p: Params = Params(), support: float = 0.5, gap: int = 50) -> str:
    """… profile and consensus over equal sequences of TILE letters."""
    n = TILE - p.window + 1
    moments = lambda c, name: f"{mean(f'sum({micro(c)})', f'count({c})')} AS mean_{name}, CASE WHEN count({c}) > 0 THEN sqrt(CAST(count({c}) * sum({micro(c)} * {micro(c)}) - sum({micro(c)}) * sum({micro(c)}) AS DOUBLE)) / CAST(count({c}) AS DOUBLE) / 1000000.0 END AS std_{name}"
    return f"""{region_ctes(seqs, p)},
population AS (SELECT count(*) AS n_sequences FROM seqs),
base_profile AS (SELECT pos, {moments("di", "perplexity")}, {moments("pds", "pds")} FROM signals GROUP BY pos),
covered AS (SELECT pos, count(*) AS n_regions, CAST(sum(CAST(floor(Region_Score * 10000.0 + 0.5) AS HUGEINT)) AS DOUBLE) / CAST(count(*) AS DOUBLE) / 10000.0 AS score, CAST(sum(CAST(floor(GC_Content * 100 + 0.5) AS BIGINT)) AS DOUBLE) / CAST(count(*) AS DOUBLE) / 10000.0 AS gc
  FROM (SELECT unnest(range(CAST(s AS BIGINT), CAST(e + 1 AS BIGINT))) AS pos, Region_Score, GC_Content FROM regions) GROUP BY pos),
profile AS (SELECT z.pos, mean_perplexity, std_perplexity, mean_pds, std_pds, coalesce(CAST(n_regions AS DOUBLE), 0.0) / CAST(n_sequences AS DOUBLE) AS lpr_frequency, coalesce(score, 0.0) AS mean_region_score, coalesce(gc, 0.5) AS gc_map
  FROM (SELECT unnest(range({n})) AS pos) z LEFT JOIN base_profile USING (pos) LEFT JOIN covered USING (pos) CROSS JOIN population),
high AS (SELECT 0 AS pop, min(pos) AS s, max(pos) AS e FROM (SELECT pos, pos - row_number() OVER (ORDER BY pos) AS g FROM profile WHERE lpr_frequency >= {support}) GROUP BY g),
joined AS ({merge_cte("high", gap, "pop")}),
consensus AS (SELECT printf('CLPR_%04d', row_number() OVER (ORDER BY s)) AS region_id, CAST(s AS INTEGER) AS consensus_start, CAST(e AS INTEGER) AS consensus_end, CAST(e - s + 1 AS INTEGER) AS consensus_length,
    {r("f", 4)} AS support, {r("rs")} AS mean_region_score, coalesce({r("pd")}, 0.0) AS mean_pds, coalesce({r("pp", 4)}, 0.0) AS mean_perplexity, {r("gc * 100", 2)} AS mean_gc
  FROM (SELECT s, e, avg(lpr_frequency) AS f, avg(mean_region_score) AS rs, avg(mean_pds) AS pd, avg(mean_perplexity) AS pp, avg(gc_map) AS gc FROM joined JOIN profile ON pos BETWEEN s AND e GROUP BY s, e))"""
