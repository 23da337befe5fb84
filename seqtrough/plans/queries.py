"""The registered queries over the test tables, each with its SQL twin.

The tables have no DNA, so sequences are the letters A, C, G, T and N of whole documents: ``raw`` keeps N,
``letters`` drops it, ``acgt`` also keeps only sequences that can have a region (a score needs 540 letters), ``tiles`` cuts
sequences into equal ones, the last of each filled up with N. Queries whose values shorter sequences have too run over
``raw`` or ``letters``; scores, regions and populations of regions over ``acgt``.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import gc_count, micro, rounded, sanitised
from ..functions import sql as sql_functions
from ..functions.params import Params
from ..operators import motifs as M
from ..operators import population as P
from ..operators import regions as R
from ..operators import segments as G
from ..operators import signals as S
from ..sources import fasta, formats, sinks
from ..sources.scratch import folder, written
from ..streaming import population as streamed
from . import oracle as O
from . import views as V

DEFAULT = Params()
#: Runs of the test texts are short; these bounds make the bounded segment choose.
NARROW = Params(min_region=20, max_region=60)
SUPPORT = 0.05
MOTIFS = M.motif_list()

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def add(f):
        QUERIES[name or f.__name__] = f
        if sql:
            SQL[name or f.__name__] = sql
        return f

    return add


def raw(spark: SparkSession, sf_dir: str, masked: bool = True) -> DataFrame:
    return fasta.from_table(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text", masked=masked)


def acgt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw(spark, sf_dir, masked=False).where("seq_len >= 540")


def letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw(spark, sf_dir, masked=False).where("seq <> ''")


def tiles(sequences: DataFrame) -> DataFrame:
    t = F.explode(F.sequence(F.lit(0), (F.ceil(F.length("seq") / O.TILE) - 1).cast("int")))
    df = sequences.select("seq_idx", "sequence_id", "seq", t.alias("t"))
    seq = F.rpad(F.substring(F.col("seq"), F.col("t") * O.TILE + 1, F.lit(O.TILE)), O.TILE, "N")
    return df.select((F.col("seq_idx") * O.TILES + F.col("t")).alias("seq_idx"), F.concat_ws(":", "sequence_id", "t").alias("sequence_id"), seq.alias("seq"), F.lit(O.TILE).alias("seq_len"))


def told(df: DataFrame, **digits: int) -> DataFrame:
    """``df`` with its doubles rounded alike in every engine: six digits, or as given by name."""
    return df.select(*(rounded(F.col(f"`{n}`"), digits.get(n, 6)).alias(n) if t == "double" else F.col(f"`{n}`") for n, t in df.dtypes))


def r6(*names: str, **digits: int) -> str:
    q = lambda n: f'"{n}"'
    return ", ".join(f"{O.r(q(n), digits.get(n, 6))} AS {q(n)}" for n in names)


# --- sequences ----------------------------------------------------------------------------------


@query(f"SELECT seq_idx, sequence_id, seq, length(seq) AS seq_len FROM ({O.SEQ_RAW})")
def sanitize(spark, sf_dir):
    return raw(spark, sf_dir).select("seq_idx", "sequence_id", "seq", F.col("seq_len").cast("long"))


_BREAK, _BLANK = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]", "chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(28) || chr(29) || chr(30) || chr(31) || chr(32) || chr(133) || chr(160)"


@query(f"""WITH t AS (SELECT CAST(doc_id AS VARCHAR) AS file, regexp_split_to_array('>' || doc_id || chr(10) || coalesce(text, ''), '{_BREAK}') AS l FROM documents),
s AS (SELECT file, i, trim(l[i], {_BLANK}) AS line FROM (SELECT file, l, unnest(range(1, len(l) + 1)) AS i FROM t)),
r AS (SELECT *, line LIKE '>%' AS head, sum(CASE WHEN line LIKE '>%' THEN 1 ELSE 0 END) OVER (PARTITION BY file ORDER BY i ROWS UNBOUNDED PRECEDING) AS rec FROM s),
g AS (SELECT file, rec, max(trim(substr(line, 2), {_BLANK})) FILTER (WHERE head) AS header, coalesce(string_agg(line, '' ORDER BY i) FILTER (WHERE NOT head), '') AS body FROM r GROUP BY file, rec),
q AS (SELECT file, rec, CASE WHEN header = '' THEN 'sequence' ELSE header END AS sequence_id, regexp_replace(translate(upper(body), 'U', 'T'), '[^ACGTN]', '', 'g') AS seq FROM g)
SELECT row_number() OVER (ORDER BY file, rec) - 1 AS seq_idx, sequence_id, seq, length(seq) AS seq_len FROM q WHERE seq <> ''""")
def fasta_parse(spark, sf_dir):
    """Every document as a FASTA text of its own, with its identifier as the header."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = docs.select(F.col("doc_id").cast("string").alias("file"), F.concat(F.lit(">"), F.col("doc_id").cast("string"), F.lit("\n"), F.coalesce("text", F.lit(""))).alias("value"))
    return fasta.parse(texts).withColumn("seq_len", F.col("seq_len").cast("long"))


@query(f"SELECT count(*) AS n_sequences, CAST(sum(length(seq)) AS BIGINT) AS total_bp FROM ({O.SEQ_RAW}) WHERE seq <> ''")
def seq_summary(spark, sf_dir):
    return fasta.summary(raw(spark, sf_dir).where("seq <> ''"))


@query(f"SELECT base, count(*) AS n FROM (SELECT unnest(string_split(seq, '')) AS base FROM ({O.SEQ_RAW}) WHERE seq <> '') GROUP BY base")
def base_composition(spark, sf_dir):
    letters = [F.struct(F.lit(b).alias("base"), (F.length("seq") - F.length(F.translate("seq", b, ""))).alias("n")) for b in "ACGTN"]
    df = raw(spark, sf_dir).select(F.explode(F.array(*letters)).alias("x")).groupBy("x.base").agg(F.sum("x.n").alias("n"))
    return df.where("n > 0")


@query(f"SELECT seq_idx, length(seq) - length(replace(replace(seq, 'G', ''), 'C', '')) AS gc, {O.r('100.0 * (length(seq) - length(replace(replace(seq, chr(71), chr(32)[1:0]), chr(67), chr(32)[1:0]))) / greatest(length(seq), 1)', 2)} AS gc_percent FROM ({O.SEQ_RAW})".replace("chr(71), chr(32)[1:0]", "'G', ''").replace("chr(67), chr(32)[1:0]", "'C', ''"))
def gc_content(spark, sf_dir):
    return raw(spark, sf_dir).select("seq_idx", gc_count(F.col("seq")).cast("long").alias("gc"), rounded(100.0 * gc_count(F.col("seq")) / F.greatest(F.length("seq"), F.lit(1)), 2).alias("gc_percent"))


# --- signals ------------------------------------------------------------------------------------


@query(f"WITH {O.di_ctes(O.SEQ_RAW)} SELECT seq_idx, count(*) AS n_windows, count(*) - count(di) AS n_masked FROM di GROUP BY seq_idx")
def n_mask(spark, sf_dir):
    df = S.tracks(raw(spark, sf_dir), wanted=("di",))
    return df.groupBy("seq_idx").agg(F.count("*").alias("n_windows"), (F.count("*") - F.count("di")).alias("n_masked"))


@query(f"WITH {O.di_ctes(O.SEQ_RAW)} SELECT din, count(*) AS n FROM dins WHERE pos < n GROUP BY din")
def dinuc_counts(spark, sf_dir):
    """Of the dinucleotides at which a window begins."""
    return S.tracks(raw(spark, sf_dir), wanted=("din",)).groupBy(F.col("din").cast("long").alias("din")).agg(F.count("*").alias("n"))


@query(f"WITH {O.di_ctes(O.SEQ_RAW)} SELECT seq_idx, pos, {r6('di')} FROM di")
def di_perplexity(spark, sf_dir):
    return told(S.tracks(raw(spark, sf_dir), wanted=("di",)).select("seq_idx", F.col("pos").cast("long").alias("pos"), "di"))


@query(f"WITH {O.di_ctes(O.SEQ_RAW)}, d AS (SELECT seq_idx, {O.micro('di')} AS v FROM di) SELECT seq_idx, count(*) AS n_windows, {O.r(O.mean('sum(v)', 'count(v)'))} AS mean_di, min(v) / 1000000.0 AS min_di, max(v) / 1000000.0 AS max_di FROM d GROUP BY seq_idx")
def di_summary(spark, sf_dir):
    v = S.tracks(raw(spark, sf_dir), wanted=("di",)).select("seq_idx", micro(F.col("di")).alias("v"))
    mean = F.when(F.count("v") > 0, F.sum("v").cast("double") / F.count("v").cast("double") / 1000000.0)
    return v.groupBy("seq_idx").agg(F.count("*").alias("n_windows"), rounded(mean).alias("mean_di"), (F.min("v") / 1000000.0).alias("min_di"), (F.max("v") / 1000000.0).alias("max_di"))


@query(f"WITH {O.di_ctes(O.SEQ_RAW)}, {O.x_ctes()} SELECT seq_idx, pos, {r6('x')} FROM filled WHERE di IS NULL AND x IS NOT NULL")
def nan_interp(spark, sf_dir):
    df = S.tracks(raw(spark, sf_dir), wanted=("di", "x"))
    return told(df.where("di is null and x is not null").select("seq_idx", F.col("pos").cast("long").alias("pos"), "x"))


@query(f"WITH {O.di_ctes(O.SEQ_RAW)}, {O.x_ctes()}, {O.q_ctes()} SELECT seq_idx, pos, q FROM smooth WHERE q IS NOT NULL")
def sg_smooth(spark, sf_dir):
    df = S.tracks(raw(spark, sf_dir), wanted=("q",))
    return df.where("q is not null").select("seq_idx", F.col("pos").cast("long").alias("pos"), "q")


_SUMS = f"{O.di_ctes(O.SEQ_RAW)}, {O.x_ctes()}, {O.q_ctes()}, {O.sum_ctes()}"


@query(f"WITH {_SUMS} SELECT seq_idx, pos, cs, cn FROM sums")
def prefix_sums(spark, sf_dir):
    return S.prefix_sums(raw(spark, sf_dir)).select("seq_idx", F.col("pos").cast("long").alias("pos"), "cs", "cn")


@query(SQL["prefix_sums"])
def prefix_sums_chunked(spark, sf_dir):
    """The same by pieces of 512 positions, whose sums are carried on."""
    return S.prefix_sums(raw(spark, sf_dir), chunk=512).select("seq_idx", F.col("pos").cast("long").alias("pos"), "cs", "cn")


@query(f"WITH {_SUMS} SELECT seq_idx, pos, " + ", ".join(f"{O.r(O.mean(f'sum_{k}', f'cnt_{k}'))} AS {k}" for k in ("up", "reg", "dn")) + " FROM ranges WHERE cnt_up > 0 AND cnt_dn > 0")
def range_means(spark, sf_dir):
    df = S.tracks(raw(spark, sf_dir), wanted=("up", "reg", "dn")).where("up is not null and dn is not null")
    return told(df.select("seq_idx", F.col("pos").cast("long").alias("pos"), "up", "reg", "dn"))


_SIG = O.signal_ctes(O.SEQ_ACGT)


@query(f"WITH {_SIG} SELECT seq_idx, pos, {r6('di', 'smoothed', 'pds')} FROM signals WHERE pds IS NOT NULL")
def pds(spark, sf_dir):
    df = S.signals(acgt(spark, sf_dir)).where("pds is not null")
    return told(df.select("seq_idx", F.col("pos").cast("long").alias("pos"), "di", "smoothed", "pds"))


@query(SQL["pds"])
def pds_chunked(spark, sf_dir):
    """The same by chunks of 2048 positions with halos, as a chromosome would be dealt out."""
    df = S.signals(acgt(spark, sf_dir), chunk=2048).where("pds is not null")
    return told(df.select("seq_idx", F.col("pos").cast("long").alias("pos"), "di", "smoothed", "pds"))


@query(f"WITH {O.signal_ctes(O.SEQ_RAW)} SELECT seq_idx, count(*) AS n_windows, count(di) AS n_di, count(smoothed) AS n_smoothed, count(pds) AS n_pds FROM signals GROUP BY seq_idx")
def signal_counts(spark, sf_dir):
    return S.counts(raw(spark, sf_dir))


_ALL = O.signal_ctes(O.SEQ_RAW)


@query(f"WITH {_ALL} SELECT seq_idx, pos, {r6('di', 'pds')}, greatest({O.r('coalesce(pds, 0.0)')}, 0.0) AS pds_positive FROM signals WHERE di IS NOT NULL")
def pds_landscape(spark, sf_dir):
    df = V.landscape(S.signals(raw(spark, sf_dir))).where("di is not null")
    return told(df.select("seq_idx", F.col("pos").cast("long").alias("pos"), "di", "pds", "pds_positive"))


@query(f"WITH {_ALL} SELECT seq_idx, pos, {O.r('pds')} AS value FROM signals")
def heatmap_long(spark, sf_dir):
    return told(V.heatmap(S.tracks(raw(spark, sf_dir), wanted=("pds",))).select("seq_idx", F.col("pos").cast("long").alias("pos"), "value"))


# --- segments -----------------------------------------------------------------------------------


def _bounds(df: DataFrame) -> DataFrame:
    return df.select(*(F.col(c).cast("long").alias(c) if c != "seq_idx" else F.col(c) for c in df.columns))


@query(f'WITH {_SIG}, {O.run_ctes()} SELECT seq_idx, s AS start, e AS "end", length FROM runs')
def positive_runs(spark, sf_dir):
    return _bounds(G.positive_runs(S.signals(acgt(spark, sf_dir))))


_SEGMENT = f"""WITH {_SIG}, {O.run_ctes()}, over_long AS (SELECT * FROM runs WHERE length > {NARROW.max_region}),
inside AS (SELECT r.seq_idx, r.s AS run_start, g.pos, CAST(sum({O.micro('g.pds')}) OVER (PARTITION BY r.seq_idx, r.s ORDER BY g.pos ROWS UNBOUNDED PRECEDING) AS BIGINT) AS upto FROM over_long r JOIN signals g ON g.seq_idx = r.seq_idx AND g.pos BETWEEN r.s AND r.e),
sums2 AS (SELECT *, coalesce(lag(upto) OVER (PARTITION BY seq_idx, run_start ORDER BY pos), 0) AS before FROM inside),
ends2 AS (SELECT seq_idx, run_start, pos, upto, min(struct_pack(b := before, neg := -pos)) OVER (PARTITION BY seq_idx, run_start ORDER BY pos ROWS BETWEEN {NARROW.max_region - 1} PRECEDING AND {NARROW.min_region - 1} PRECEDING) AS x FROM sums2),
best AS (SELECT seq_idx, run_start, pos AS e, -x.neg AS s, row_number() OVER (PARTITION BY seq_idx, run_start ORDER BY CAST(upto - x.b AS DOUBLE) / CAST(pos + x.neg + 1 AS DOUBLE) DESC, pos) AS k FROM ends2 WHERE x IS NOT NULL)
SELECT seq_idx, s AS run_start, s AS start, e AS "end" FROM runs WHERE length BETWEEN {NARROW.min_region} AND {NARROW.max_region}
UNION ALL SELECT seq_idx, run_start, s, e FROM best WHERE k = 1"""


def _scored(spark, sf_dir) -> DataFrame:
    """The positions with a positive score, written once: runs have no others, and segments are of runs."""
    return written(S.tracks(acgt(spark, sf_dir), wanted=("pds",)).where("pds > 0"))


@query(_SEGMENT)
def bounded_segment(spark, sf_dir):
    return _bounds(G.bounded_segments(_scored(spark, sf_dir), NARROW))


#: All pairs of ends within the bounds.
_DENSE = f"""WITH {_SIG}, {O.run_ctes()},
inside AS (SELECT r.seq_idx, r.s AS run_start, g.pos, {O.micro('g.pds')} AS v, CAST(sum({O.micro('g.pds')}) OVER (PARTITION BY r.seq_idx, r.s ORDER BY g.pos ROWS UNBOUNDED PRECEDING) AS BIGINT) AS upto FROM runs r JOIN signals g ON g.seq_idx = r.seq_idx AND g.pos BETWEEN r.s AND r.e WHERE r.length >= {NARROW.min_region}),
pairs AS (SELECT a.seq_idx, a.run_start, a.pos AS s, b.pos AS e, CAST(b.upto - a.upto + a.v AS DOUBLE) / CAST(b.pos - a.pos + 1 AS DOUBLE) AS mean FROM inside a JOIN inside b ON b.seq_idx = a.seq_idx AND b.run_start = a.run_start AND b.pos BETWEEN a.pos + {NARROW.min_region - 1} AND a.pos + {NARROW.max_region - 1}),
best AS (SELECT *, row_number() OVER (PARTITION BY seq_idx, run_start ORDER BY mean DESC, e, s DESC) AS k FROM pairs)
SELECT seq_idx, run_start, s AS start, e AS "end", {O.r('mean / 1000000.0')} AS mean FROM best WHERE k = 1"""


@query(_DENSE)
def densest_segment(spark, sf_dir):
    return told(G.densest_segments(_scored(spark, sf_dir), NARROW))


@query(f'WITH {_SIG}, {O.run_ctes()} SELECT seq_idx, s AS start, e AS "end" FROM runs WHERE length >= {NARROW.min_region}')
def expand(spark, sf_dir):
    signals = _scored(spark, sf_dir)
    return _bounds(G.expanded(G.bounded_segments(signals, NARROW), signals))


_BOUNDS = O.bound_ctes(O.SEQ_ACGT)


@query(f'WITH {_BOUNDS} SELECT seq_idx, s AS start, e AS "end" FROM bounds')
def merge_intervals(spark, sf_dir):
    return _bounds(G.region_bounds(S.signals(acgt(spark, sf_dir))))


# --- regions ------------------------------------------------------------------------------------

_REGIONS = O.region_ctes(O.SEQ_ACGT)
_NUMBERS = "Mean_Perplexity Min_Perplexity Max_Perplexity Upstream_Mean Region_Mean Downstream_Mean Perplexity_Depression_Score Prominence Persistence Variance Std_Dev CV AUC_PDS GC_Content".split()
_WHOLE = "Signal_Start Signal_End Start End Length".split()


def _regions(spark, sf_dir) -> DataFrame:
    return R.regions(acgt(spark, sf_dir))


def _q(*names: str) -> str:
    return ", ".join(f'"{n}"' for n in names)


def _pick(df: DataFrame, *names: str) -> DataFrame:
    return told(df.select(*(F.col(n).cast("long").alias(n) if t == "int" else F.col(n) for n, t in df.select(*names).dtypes)), Region_Score=4)


@query(f"WITH {_REGIONS} SELECT seq_idx, {_q('Region_ID', *_WHOLE)}, {r6(*_NUMBERS)} FROM regions")
def region_metrics(spark, sf_dir):
    return _pick(_regions(spark, sf_dir), "seq_idx", "Region_ID", *_WHOLE, *_NUMBERS)


@query(f"WITH {_REGIONS} SELECT seq_idx, {_q('Region_ID')}, {r6('Upstream_Mean', 'Downstream_Mean', 'Prominence')} FROM regions")
def region_flanks(spark, sf_dir):
    return _pick(_regions(spark, sf_dir), "seq_idx", "Region_ID", "Upstream_Mean", "Downstream_Mean", "Prominence")


@query(f"WITH {_REGIONS} SELECT seq_idx, {_q('Sequence_ID', 'Region_ID', *_WHOLE)}, {r6('Perplexity_Depression_Score', 'Region_Score', Region_Score=4)}, \"Rank\" FROM regions")
def region_score_rank(spark, sf_dir):
    return _pick(_regions(spark, sf_dir), "seq_idx", "Sequence_ID", "Region_ID", *_WHOLE, "Perplexity_Depression_Score", "Region_Score", "Rank")


@query(f"WITH {_REGIONS} SELECT seq_idx, {_q('Region_ID')}, {r6('Region_Score', Region_Score=4)}, \"Rank\" FROM regions WHERE Rank <= 20")
def top_regions(spark, sf_dir):
    return _pick(R.top(_regions(spark, sf_dir)), "seq_idx", "Region_ID", "Region_Score", "Rank")


@query(f"WITH {_REGIONS} SELECT seq_idx, {_q('Region_ID', 'Sequence')}, GC_Content FROM regions")
def region_sequence(spark, sf_dir):
    return _pick(_regions(spark, sf_dir), "seq_idx", "Region_ID", "Sequence", "GC_Content")


@query(f"WITH {_REGIONS} SELECT count(*) AS n_regions, CAST(max(Length) AS BIGINT) AS longest, {O.r('max(Region_Score)', 4)} AS best_score, {O.r('(SELECT max(pds) FROM signals)')} AS peak_pds FROM regions")
def result_figures(spark, sf_dir):
    sequences = acgt(spark, sf_dir)
    signals = written(S.signals(sequences))
    return told(V.result_figures(R.regions(sequences, signals=signals), signals).withColumn("longest", F.col("longest").cast("long")), best_score=4)


@query(SQL["region_metrics"])
def regions_lateral(spark, sf_dir):
    """The same from SQL: a table function joined laterally."""
    sql_functions.register(spark)
    acgt(spark, sf_dir).createOrReplaceTempView("seqtrough_sequences")
    found = spark.sql("SELECT s.seq_idx, r.* FROM seqtrough_sequences s, LATERAL regions(s.seq) r")
    return _pick(found, "seq_idx", "Region_ID", *_WHOLE, *_NUMBERS)


_PROFILES = f"WITH {O.signal_ctes(O.SEQ_RAW)}, k AS (SELECT seq_idx, count(di) AS n_di, sum({O.micro('di')}) AS di, count(pds) AS n_pds, sum({O.micro('pds')}) AS pds, count(*) AS n FROM signals GROUP BY seq_idx) SELECT seq_idx, coalesce(n, 0) AS n, coalesce(n_di, 0) AS n_di, CAST(coalesce(di, 0) AS BIGINT) AS di, coalesce(n_pds, 0) AS n_pds, CAST(coalesce(pds, 0) AS BIGINT) AS pds FROM seqs LEFT JOIN k USING (seq_idx)"


@query(_PROFILES)
def profile_functions(spark, sf_dir):
    """Lengths and sums of the arrays that ``di_profile`` and ``pds_profile`` make of every document, from SQL."""
    sql_functions.register(spark)
    spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").createOrReplaceTempView("seqtrough_documents")
    known = "filter({0}, x -> x IS NOT NULL)".format
    total = lambda c: f"aggregate({known(c)}, 0L, (a, x) -> a + CAST(floor(x * 1000000D + 0.5D) AS BIGINT))"
    sql = f"SELECT doc_id AS seq_idx, CAST(size(di) AS BIGINT) AS n, CAST(size({known('di')}) AS BIGINT) AS n_di, {total('di')} AS di, CAST(size({known('pds')}) AS BIGINT) AS n_pds, {total('pds')} AS pds"
    return spark.sql(f"{sql} FROM (SELECT doc_id, di_profile(text) AS di, pds_profile(text) AS pds FROM seqtrough_documents)")


_MOTIF_REGIONS = O.region_ctes(O.SEQ_ACGT, motifs=MOTIFS)


@query(f"WITH {_REGIONS} " + " UNION ALL ".join(f"SELECT seq_idx, \"Region_ID\", {k} AS motif_ord, '{m}' AS motif, len(regexp_extract_all(\"Sequence\", '(?i){p}')) AS hits FROM regions" for k, (m, p) in enumerate(MOTIFS)))
def motif_counts(spark, sf_dir):
    df = M.counts(_regions(spark, sf_dir), MOTIFS)
    return df.withColumn("hits", F.col("hits").cast("long"))


@query(f"WITH {_MOTIF_REGIONS} SELECT seq_idx, {_q('Region_ID', 'Motif_Count', 'Motifs')} FROM regions")
def motif_annotation(spark, sf_dir):
    return M.annotate(_regions(spark, sf_dir), MOTIFS).select("seq_idx", "Region_ID", F.col("Motif_Count").cast("long").alias("Motif_Count"), "Motifs")


@query(f"WITH {_MOTIF_REGIONS} SELECT seq_idx, {_q('Region_ID', 'Motif_Count', 'Motifs')} FROM regions WHERE Motif_Count > 0")
def motif_hits(spark, sf_dir):
    return M.with_hits(M.annotate(_regions(spark, sf_dir), MOTIFS)).withColumn("Motif_Count", F.col("Motif_Count").cast("long"))


#: Expressions that both engines take or refuse alike: words of the texts, in which characters of expressions occur.
_PATTERNS = "SELECT DISTINCT x AS motif FROM (SELECT unnest(regexp_split_to_array(text, '[ \\n]+')) AS x FROM documents) WHERE length(x) BETWEEN 1 AND 40"


@query(f"SELECT motif, CASE WHEN TRY(regexp_matches('', '(?i)' || motif)) IS NULL THEN 'invalid' ELSE 'valid' END AS status FROM ({_PATTERNS})")
def motif_validation(spark, sf_dir):
    """Every distinct word of all documents, taken as a motif."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    words = docs.select(F.explode(F.split("text", "[ \n]+")).alias("motif")).where("length(motif) between 1 and 40").distinct()
    return M.validated(words)


@query(f'WITH {_REGIONS} SELECT Sequence_ID, "Start", "End" + 1 AS "End", Region_ID, {r6("Region_Score", Region_Score=4)} FROM regions')
def export_bed(spark, sf_dir):
    return _pick(sinks.bed(_regions(spark, sf_dir)), "Sequence_ID", "Start", "End", "Region_ID", "Region_Score")


_GFF = "Sequence_ID || chr(9) || 'seqtrough' || chr(9) || 'low_perplexity_region' || chr(9) || (\"Start\" + 1) || chr(9) || (\"End\" + 1) || chr(9) || " + O.four("Region_Score") + " || chr(9) || '.' || chr(9) || '.' || chr(9) || 'ID=' || Region_ID" + "".join(f" || ';{c}=' || {O.four(c)}" for c in ("Region_Score", "Perplexity_Depression_Score", "Persistence", "Prominence")) + " || ';Motifs=' || Motifs"


@query(f"WITH {_MOTIF_REGIONS} SELECT {_GFF} AS value FROM regions")
def export_gff(spark, sf_dir):
    return sinks.gff_lines(M.annotate(_regions(spark, sf_dir), MOTIFS))


@query(f"""WITH {_REGIONS} SELECT '>' || Region_ID || '|' || Sequence_ID || ':' || "Start" || '-' || "End" || '|Region_Score=' || {O.four("Region_Score")} || chr(10) || "Sequence" AS value FROM regions""")
def export_fasta(spark, sf_dir):
    return sinks.fasta_lines(_regions(spark, sf_dir))


_GFF_ROWS = f"""WITH {_MOTIF_REGIONS} SELECT Sequence_ID AS seqid, "Start" + 1 AS "start", "End" + 1 AS "end", CAST({O.four("Region_Score")} AS DOUBLE) AS score, Region_ID AS id, {O.four("Prominence")} AS prominence, Motifs AS motifs FROM regions"""


@query(_GFF_ROWS)
def gff_source(spark, sf_dir):
    """Regions written by the ``gff`` format, one file a task, and read back in splits of 64 KB."""
    formats.register(spark)
    at = folder(spark)
    formats.gff_of(M.annotate(_regions(spark, sf_dir), MOTIFS)).write.format("gff").mode("overwrite").save(at)
    rows = spark.read.format("gff").option("splitBytes", 1 << 16).load(at)
    return rows.select("seqid", "start", "end", "score", F.col("attributes.ID").alias("id"), F.col("attributes.Prominence").alias("prominence"), F.col("attributes.Motifs").alias("motifs"))


@query(f"""WITH {_REGIONS} SELECT Sequence_ID AS chrom, "Start" AS "start", "End" + 1 AS "end", Region_ID AS "name", CAST({O.four("Region_Score")} AS DOUBLE) AS score FROM regions""")
def bed_source(spark, sf_dir):
    formats.register(spark)
    at = folder(spark)
    formats.bed_of(_regions(spark, sf_dir)).write.format("bed").mode("overwrite").save(at)
    return spark.read.format("bed").option("splitBytes", 1 << 16).load(at)


@query(f"SELECT sequence_id, seq, length(seq) AS seq_len FROM ({O.SEQ_RAW}) WHERE seq <> ''")
def fasta_source(spark, sf_dir):
    """Whole documents written by the ``fasta`` format, a record each, and read back in splits of 256 KB."""
    formats.register(spark)
    at = folder(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    docs.select(F.col("doc_id").cast("string").alias("sequence_id"), sanitised(F.col("text")).alias("seq")).write.format("fasta").mode("overwrite").save(at)
    return spark.read.format("fasta").option("splitBytes", 1 << 18).load(at).select("sequence_id", "seq", F.length("seq").cast("long").alias("seq_len"))


def _read_back(df: DataFrame, fmt: str, **how) -> DataFrame:
    """What ``write_table`` wrote, as Spark reads it, with the types that were written."""
    spark, at = df.sparkSession, folder(df.sparkSession)
    sinks.write_table(df, at, fmt, **how)
    wanted = df if how.get("every_column") else R.exported_columns(df, how.get("advanced", False))
    if fmt in ("json_array", "xlsx"):
        return spark.read.format(fmt).schema(wanted.schema).load(at)
    if fmt == "json":
        return spark.read.schema(wanted.schema).json(at).select(*wanted.columns)
    return spark.read.schema(wanted.schema).option("header", True).option("enforceSchema", False).option("emptyValue", "").option("nullValue", "null").option("sep", "\t" if fmt == "tsv" else ",").csv(at)


_EXPORTED = [c for c in (*R.PRIMARY, *R.ADVANCED) if c not in ("Region_Score", "Motif_Count", "Rank", "Motifs", "Sequence", "Region_ID", "Start", "End", "Length", "Kadane_Core_Start", "Kadane_Core_End")]
_TEXTS = ("Sequence_ID", "Region_ID", "Motifs", "Sequence")
_COUNTS = ("Start", "End", "Length", "Motif_Count", "Rank", "Kadane_Core_Start", "Kadane_Core_End")
_EXPORT = f"WITH {_MOTIF_REGIONS} SELECT {_q(*_TEXTS)}, {', '.join(f'CAST({chr(34)}{c}{chr(34)} AS BIGINT) AS {chr(34)}{c}{chr(34)}' for c in _COUNTS)}, {r6(*_EXPORTED, 'Region_Score', Region_Score=4)} FROM regions"


def _exported(spark, sf_dir, fmt: str, **how) -> DataFrame:
    return _pick(_read_back(M.annotate(_regions(spark, sf_dir), MOTIFS), fmt, advanced=True, **how), *_TEXTS, *_COUNTS, *_EXPORTED, "Region_Score")


@query(_EXPORT)
def export_csv(spark, sf_dir):
    return _exported(spark, sf_dir, "csv")


@query(_EXPORT)
def export_tsv(spark, sf_dir):
    return _exported(spark, sf_dir, "tsv", single=True)


@query(_EXPORT)
def export_json(spark, sf_dir):
    return _exported(spark, sf_dir, "json")


@query(_EXPORT)
def export_json_array(spark, sf_dir):
    """Parts that together are one array, read back."""
    return _exported(spark, sf_dir, "json_array")


@query(_EXPORT)
def export_xlsx(spark, sf_dir):
    """Workbooks, read back by a parser of sheets."""
    return _exported(spark, sf_dir, "xlsx")


@query(f'WITH {_REGIONS} SELECT Sequence_ID, count(*) AS n_regions, CAST(sum("Length") AS BIGINT) AS total FROM regions GROUP BY Sequence_ID')
def export_by_sequence(spark, sf_dir):
    """A folder for each sequence, read back."""
    at = folder(spark)
    sinks.write_table(_regions(spark, sf_dir), at, "json", by_sequence=True)
    back = spark.read.schema("Length long, Sequence_ID string").json(at)
    return back.groupBy("Sequence_ID").agg(F.count("*").alias("n_regions"), F.sum("Length").alias("total"))


@query(f"WITH {_REGIONS} SELECT {_q('Sequence_ID', 'Region_ID', *_WHOLE)}, \"Rank\" FROM regions WHERE Sequence_ID = (SELECT min(Sequence_ID) FROM regions)")
def sequence_lookup(spark, sf_dir):
    """The regions of one sequence by its identifier: the first that has any."""
    found = written(_regions(spark, sf_dir))
    first = found.agg(F.min("Sequence_ID")).first()[0]
    return _pick(R.of_sequence(found, first or ""), "Sequence_ID", "Region_ID", *_WHOLE, "Rank")


@query(f"WITH {_REGIONS} SELECT seq_idx, Region_ID, {O.r('Region_Score', 4)} AS \"Region_Score\" FROM regions ORDER BY seq_idx, Region_Score DESC, Region_ID")
def ranking_bars(spark, sf_dir):
    return _pick(V.ranking(_regions(spark, sf_dir)), "seq_idx", "Region_ID", "Region_Score")


@query(f"WITH {_MOTIF_REGIONS} SELECT seq_idx, Region_ID, CAST(Motif_Count AS BIGINT) AS \"Motif_Count\" FROM regions ORDER BY seq_idx, Motif_Count DESC, Region_ID")
def motif_bars(spark, sf_dir):
    return _pick(V.motif_bars(M.annotate(_regions(spark, sf_dir), MOTIFS)), "seq_idx", "Region_ID", "Motif_Count")


@query(f'WITH {_REGIONS} SELECT seq_idx, Region_ID, CAST(s AS BIGINT) AS "Signal_Start" FROM regions ORDER BY seq_idx, s')
def region_order(spark, sf_dir):
    return _pick(R.in_order(_regions(spark, sf_dir)), "seq_idx", "Region_ID", "Signal_Start")


_BANDS = "s - 150 AS up_start, s - 50 AS up_end, s AS region_start, e AS region_end, e + 51 AS dn_start, e + 151 AS dn_end, greatest(s - 175, 0) AS view_start, least(e + 176, length(seq)) AS view_end"


@query(f"WITH {_REGIONS} SELECT seq_idx, Region_ID, {_BANDS} FROM regions JOIN seqs USING (seq_idx)")
def three_window(spark, sf_dir):
    sequences = acgt(spark, sf_dir)
    df = V.three_windows(R.regions(sequences), sequences)
    return df.select("seq_idx", "Region_ID", *(F.col(c).cast("long").alias(c) for c in df.columns[2:]))


def _hist(value: str, bins: int, source: str = "regions", extra: str = "") -> str:
    return f"""SELECT {extra}bin, {O.r('lo + bin * w')} AS low, {O.r('lo + (bin + 1) * w')} AS high, count(*) AS n FROM (SELECT CAST(least(floor((v - lo) / w), {bins - 1}) AS INTEGER) AS bin, lo, w FROM
    (SELECT CAST({value} AS DOUBLE) AS v FROM {source}), (SELECT CAST(min({value}) AS DOUBLE) AS lo, CASE WHEN max({value}) > min({value}) THEN (CAST(max({value}) AS DOUBLE) - CAST(min({value}) AS DOUBLE)) / {float(bins)} ELSE 1.0 END AS w FROM {source})) GROUP BY bin, lo, w"""


@query(f"WITH {_REGIONS} {_hist('e - s + 1', V.LENGTH_BINS)}")
def length_hist(spark, sf_dir):
    return told(V.length_histogram(written(_regions(spark, sf_dir).select("Signal_Start", "Signal_End"))))


def _round_hist(value: str, bins: int) -> str:
    sizes = "[" + ", ".join(repr(float(f"{m}e{k}")) for k in range(-6, 16) for m in (1, 2, 5)) + "]"
    return f"""SELECT CAST(k - floor(lo / w) AS INTEGER) AS bin, {O.r('k * w')} AS low, {O.r('(k + 1) * w')} AS high, count(*) AS n FROM (SELECT floor(v / w) AS k, lo, w FROM (SELECT CAST({value} AS DOUBLE) AS v FROM regions),
    (SELECT lo, CASE WHEN hi > lo THEN list_min([x FOR x IN CAST({sizes} AS DOUBLE[]) IF x >= (hi - lo) / {float(bins)}]) ELSE 1.0 END AS w FROM (SELECT CAST(min({value}) AS DOUBLE) AS lo, CAST(max({value}) AS DOUBLE) AS hi FROM regions))) GROUP BY k, lo, w"""


@query(f"WITH {_REGIONS} {_round_hist('e - s + 1', V.LENGTH_BINS)}")
def length_round_hist(spark, sf_dir):
    return told(V.round_histogram(written(_regions(spark, sf_dir).select("Signal_Start", "Signal_End")), F.col("Signal_End") - F.col("Signal_Start") + 1, V.LENGTH_BINS))


@query(f"WITH {_REGIONS} {_round_hist('floor(Region_Score * 10000.0 + 0.5) / 10000.0', V.SCORE_BINS)}")
def score_round_hist(spark, sf_dir):
    return told(V.round_histogram(written(_regions(spark, sf_dir).select("Region_Score")), rounded(F.col("Region_Score"), 4), V.SCORE_BINS))


@query(f"WITH {_REGIONS} {_hist('floor(Region_Score * 10000.0 + 0.5) / 10000.0', V.SCORE_BINS)}")
def score_hist(spark, sf_dir):
    return told(V.score_histogram(written(_regions(spark, sf_dir).select("Region_Score")).withColumn("Region_Score", rounded(F.col("Region_Score"), 4))))


@query(f"WITH {_REGIONS} " + _hist("s", V.BOUNDARY_BINS, extra="'start' AS kind, ") + " UNION ALL " + _hist("e", V.BOUNDARY_BINS, extra="'end' AS kind, "))
def boundary_hist(spark, sf_dir):
    return told(V.boundary_histogram(written(_regions(spark, sf_dir).select("Signal_Start", "Signal_End"))))


# --- populations --------------------------------------------------------------------------------


@query(f"SELECT count(*) AS n_sequences, count(DISTINCT greatest(length(seq) - 16, 0)) AS n_lengths, min(greatest(length(seq) - 16, 0)) AS signal_length, count(*) >= 2 AND count(DISTINCT greatest(length(seq) - 16, 0)) = 1 AND min(greatest(length(seq) - 16, 0)) > 0 AS eligible FROM ({O.SEQ_POP})")
def pop_eligibility(spark, sf_dir):
    return P.eligible(tiles(acgt(spark, sf_dir))).withColumn("signal_length", F.col("signal_length").cast("long"))


class _Population:
    """Regions, profile and consensus of the tiles, each written once when it is asked for."""

    def __init__(self, spark, sf_dir):
        self.sequences = written(tiles(acgt(spark, sf_dir)))
        self.n, self.n_signal = self.sequences.count(), O.TILE - DEFAULT.window + 1

    @cached_property
    def _surveyed(self) -> tuple[DataFrame, DataFrame]:
        return P.surveyed(self.sequences)

    @cached_property
    def regions(self) -> DataFrame:
        return written(self._surveyed[0])

    @cached_property
    def profile(self) -> DataFrame:
        return written(P.profile(self._surveyed[1], self.regions, self.n, self.n_signal))

    @cached_property
    def consensus(self) -> DataFrame:
        return P.consensus(self.profile, SUPPORT)


_POP = O.population_ctes(support=SUPPORT)


def _pos(df: DataFrame, **digits: int) -> DataFrame:
    return told(df.withColumn("pos", F.col("pos").cast("long")), **digits)


@query(f"WITH {_POP} SELECT pos, {r6('mean_perplexity', 'std_perplexity', 'mean_pds', 'std_pds')} FROM profile")
def pop_profile(spark, sf_dir):
    return _pos(_Population(spark, sf_dir).profile.select("pos", "mean_perplexity", "std_perplexity", "mean_pds", "std_pds"))


@query(f"WITH {_POP} SELECT pos, {r6('mean_perplexity', 'std_perplexity', 'mean_pds', 'std_pds', 'lpr_frequency', 'mean_region_score', 'gc_map', mean_region_score=4)}, n_sequences, 0 AS n_aside FROM profile, population")
def stream_profile(spark, sf_dir):
    """The profile by a stream of the tiles, in two runs over one checkpoint."""
    at = folder(spark)
    rows = tiles(acgt(spark, sf_dir)).select("seq_idx", "seq")
    for part in range(2):
        rows.where(F.pmod(F.xxhash64("seq_idx"), F.lit(2)) == part).select("seq").write.mode("append").parquet(f"{at}/in")
        streamed.stream_profile(spark.readStream.schema("seq string").parquet(f"{at}/in"), f"{at}/out", f"{at}/check", O.TILE - DEFAULT.window + 1).awaitTermination()
    return _pos(streamed.read_profile(spark, f"{at}/out"), mean_region_score=4)


@query(f"WITH {_POP} SELECT pos, {r6('lpr_frequency')} FROM profile")
def pop_lpr_frequency(spark, sf_dir):
    return _pos(_Population(spark, sf_dir).profile.select("pos", "lpr_frequency"))


@query(f"WITH {_POP} SELECT pos, {r6('mean_region_score', mean_region_score=4)} FROM profile")
def pop_region_score(spark, sf_dir):
    return _pos(_Population(spark, sf_dir).profile.select("pos", "mean_region_score"), mean_region_score=4)


@query(f"WITH {_POP} SELECT pos, {r6('gc_map')} FROM profile")
def pop_gc_map(spark, sf_dir):
    return _pos(_Population(spark, sf_dir).profile.select("pos", "gc_map"))


@query(f"""WITH s AS ({O.SEQ_TILES}), b AS (SELECT seq_idx, unnest(range({O.TILE})) AS pos, unnest(string_split(seq, '')) AS base FROM s), g AS (SELECT *, CASE WHEN base IN ('G', 'C') THEN 1 ELSE 0 END AS gc FROM b),
w AS (SELECT pos, sum(gc) OVER (PARTITION BY seq_idx ORDER BY pos ROWS BETWEEN 10 PRECEDING AND 10 FOLLOWING) + greatest(10 - pos, 0) * first_value(gc) OVER a + greatest(pos + 10 - {O.TILE - 1}, 0) * last_value(gc) OVER a AS t FROM g
  WINDOW a AS (PARTITION BY seq_idx ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))
SELECT pos, {O.r('CAST(sum(t) AS DOUBLE) / 21.0 / CAST((SELECT count(*) FROM s) AS DOUBLE)')} AS mean_gc FROM w WHERE pos < {O.TILE - 16} GROUP BY pos""")
def pop_gc_profile(spark, sf_dir):
    return _pos(P.gc_profile(tiles(letters(spark, sf_dir)), O.TILE - 16))


@query(f"WITH {_POP} SELECT * FROM consensus")
def consensus(spark, sf_dir):
    return _Population(spark, sf_dir).consensus


@query(f'WITH {_POP} SELECT region_id AS "Region_ID", consensus_start AS "Consensus_Start", consensus_end AS "Consensus_End", consensus_length AS "Length", support AS "Support", mean_pds AS "Mean_PDS", mean_region_score AS "Mean_RegionScore", mean_perplexity AS "Mean_Perplexity", mean_gc AS "GC%" FROM consensus')
def consensus_summary(spark, sf_dir):
    return P.summary(_Population(spark, sf_dir).consensus)


@query(f"WITH {_POP} SELECT pos, {O.r('profile.mean_pds')} AS mean_pds, {O.r('lpr_frequency')} AS lpr_frequency, consensus.region_id FROM profile LEFT JOIN consensus ON pos BETWEEN consensus_start AND consensus_end")
def consensus_track(spark, sf_dir):
    x = _Population(spark, sf_dir)
    return _pos(V.consensus_track(x.profile, written(x.consensus)))


_OCC = f"WITH {_POP}, occ AS (SELECT q.seq_idx, q.sequence_id, c.region_id, CAST(coalesce(max(CASE WHEN g.s <= c.consensus_end AND g.e >= c.consensus_start THEN 1 END), 0) AS TINYINT) AS present FROM seqs q CROSS JOIN consensus c LEFT JOIN regions g ON g.seq_idx = q.seq_idx GROUP BY ALL)"


@query(f"{_OCC} SELECT * FROM occ")
def occurrence_long(spark, sf_dir):
    x = _Population(spark, sf_dir)
    return P.occurrence(x.sequences, x.regions, x.consensus)


_PIVOT = f"{_OCC} SELECT {{}} FROM (PIVOT occ ON region_id USING max(present) GROUP BY seq_idx, sequence_id)"


@query(_PIVOT.format("*"))
def occurrence_pivot(spark, sf_dir):
    x = _Population(spark, sf_dir)
    return P.occurrence_matrix(P.occurrence(x.sequences, x.regions, x.consensus))


@query(f"{_OCC} SELECT seq_idx, sequence_id, coalesce(string_agg(region_id, ',' ORDER BY region_id) FILTER (WHERE present = 1), '') AS present FROM occ GROUP BY seq_idx, sequence_id")
def occurrence_blocks(spark, sf_dir):
    """The sparse matrix in blocks, written, read and unpacked: the consensus regions of each sequence."""
    x = _Population(spark, sf_dir)
    ids = written(P.numbered(x.consensus)).agg(F.transform(F.array_sort(F.collect_list(F.struct("column", "region_id"))), lambda c: c["region_id"]).alias("ids"))
    rows = P.unpacked(written(P.occurrence_blocks(x.sequences, x.regions, x.consensus)))
    return rows.join(F.broadcast(ids)).select("seq_idx", "sequence_id", F.array_join(F.transform("held", lambda c: F.get("ids", c)), ",").alias("present"))


@query(_PIVOT.format("* EXCLUDE (seq_idx)"))
def occurrence_file(spark, sf_dir):
    """The matrix of all consensus regions, written tab-separated from its blocks and read back."""
    x, at = _Population(spark, sf_dir), folder(spark)
    sinks.write_occurrence_blocks(P.occurrence_blocks(x.sequences, x.regions, x.consensus), P.numbered(x.consensus), at, "tsv")
    lines = spark.read.format("lines").load(at)
    names = lines.where("value like 'sequence_id%'").first()[0].split("\t")
    fields = F.split("value", "\t")
    return lines.where("value not like 'sequence_id%'").select(fields[0].alias("sequence_id"), *(fields[k].cast("tinyint").alias(n) for k, n in enumerate(names) if k))


@query(f'WITH {_POP} SELECT region_id AS "Region_ID", consensus_start AS "Consensus_Start", consensus_end AS "Consensus_End", consensus_length AS "Length", support AS "Support", mean_pds AS "Mean_PDS", mean_region_score AS "Mean_RegionScore", mean_perplexity AS "Mean_Perplexity", mean_gc AS "GC%" FROM consensus')
def summary_file(spark, sf_dir):
    """The consensus summary, written as csv and read back."""
    return _read_back(written(P.summary(_Population(spark, sf_dir).consensus)), "csv", every_column=True)


_FREQ = f"WITH {_POP}, freq AS (" + " UNION ALL ".join(f"SELECT consensus.region_id AS region_id, '{m}' AS motif, {O.r('CAST(count(*) AS DOUBLE) / CAST((SELECT n_sequences FROM population) AS DOUBLE)', 4)} AS frequency FROM regions JOIN consensus ON s <= consensus_end AND e >= consensus_start WHERE regexp_matches(\"Sequence\", '(?i){p}') GROUP BY consensus.region_id" for m, p in MOTIFS) + ")"


@query(f"{_FREQ} SELECT * FROM freq")
def motif_frequency(spark, sf_dir):
    x = _Population(spark, sf_dir)
    return P.motif_frequencies(x.regions, x.consensus, MOTIFS, x.n)


@query(f"{_FREQ} SELECT motif, max(frequency) AS max_frequency FROM freq GROUP BY motif ORDER BY max_frequency DESC, motif LIMIT 15")
def motif_top(spark, sf_dir):
    x = _Population(spark, sf_dir)
    return V.top_motifs(P.motif_frequencies(x.regions, x.consensus, MOTIFS, x.n))
