"""A cleaning pipeline over ``documents``: each stage applies one of the corpus operators to all that its predecessor kept."""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqtrough.llm import decontaminate, ngram_join, packing, pii_tagger, quality_rules
from seqtrough.llm.common import recorded, removed, shared_dir, table
from seqtrough.llm.queries import tokenizer_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep.

    Null, empty and short texts go; repeated rows are judged each by itself; an empty table stays empty. Here and below
    columns other than those of documents are not carried.
    """
    return quality_rules.judge(docs.select(*COLUMNS)).where("kept").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that links of five-word shingles at a Jaccard similarity of 0.8 join: the smallest identifier.

    Rows without an identifier come last in their group; of rows that repeat the smallest one that stays whose text sorts first.
    Different texts under one identifier are documents of their own. Texts without words are in no group and stay.
    """
    return ngram_join.one_of_each(docs.select(*COLUMNS), n=5, num=80, den=100)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark.

    Null and empty texts and items match nothing, so such documents stay; rows that repeat an identifier are judged each.
    """
    return decontaminate.clean(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data masked, and n_chars of the new text; a null text becomes an empty one, every row stays."""
    return pii_tagger.masked(docs.select(*COLUMNS)).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 1024 tokens: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A null or empty text is its end id alone; rows that repeat an identifier, or have none, are packed each; no documents, no pieces.
    """
    cut = packing.pieces(docs.select("doc_id", "text"), tokenizer_path(), end_id=2, size=1024)
    return packing.place(cut.select("doc_id", "piece", "start", F.col("length").cast("long"), F.crc32("ids").alias("ids_crc32"), "task", "rank"))


#: Folders of the stage before, which its written result no longer needs, by Spark application and tables.
_scratch: dict[tuple[str, str], list[str]] = {}


def _stage(f):
    """The stage ``f``, after the last stage's scratch tables are deleted."""

    @wraps(f)
    def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        run = (spark.sparkContext.applicationId, sf_dir)
        removed(spark, _scratch.pop(run, []))
        with recorded() as made:
            out = f(spark, docs, sf_dir)
        _scratch[run] = made
        return out

    return stage


STAGES = [
    ("quality rules", _stage(quality)),
    ("n-gram Jaccard join", _stage(near_duplicates)),
    ("benchmark decontamination", _stage(decontamination)),
    ("personal data", _stage(personal_data)),
    ("best-fit packing", _stage(packed)),
]

#: The join's components, SimHash, the tagger and the tokenizer are beyond SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over ``documents``, each one's result written and read again."""
    docs = table(spark, sf_dir, "documents")
    _scratch.pop((spark.sparkContext.applicationId, sf_dir), None)  # of a run that failed; it may still be read
    at = shared_dir(spark)
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{at}/{k}")
        docs = spark.read.parquet(f"{at}/{k}")
    return docs
