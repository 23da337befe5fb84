"""Regions of FASTA files as a table: ``python -m seqtrough genomes.fa --out regions``."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from .functions.params import Params
from .operators import motifs, regions
from .sources import fasta, sinks

#: Options that are parameters of the analysis.
NUMBERS = {"sg-window": "sg_window", "sg-order": "sg_order", "flank-size": "flank", "spacer-size": "spacer", "min-candidate": "min_candidate", "max-candidate": "max_candidate", "min-region": "min_region", "max-region": "max_region", "merge-gap": "merge_gap"}


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    """Write the regions; returns their number."""
    parser = argparse.ArgumentParser(prog="seqtrough", description=__doc__)
    parser.add_argument("fasta", nargs="+", help="files, folders or globs")
    parser.add_argument("--out", default="regions", help="folder of the table")
    parser.add_argument("--format", default="csv", choices=("csv", "tsv", "json"))
    parser.add_argument("--motifs", default="", help="motifs to count, separated by spaces")
    parser.add_argument("--chunk", type=int, help="positions of a piece, to deal long sequences out")
    parser.add_argument("--parts", action="store_true", help="as many parts as tasks, instead of one")
    for name, field in NUMBERS.items():
        parser.add_argument(f"--{name}", dest=field, type=int, default=getattr(Params(), field))
    given = parser.parse_args(argv)
    spark = spark or SparkSession.builder.appName("seqtrough").getOrCreate()
    found = regions.regions(fasta.read_fasta(spark, given.fasta), Params.of(**vars(given)), given.chunk)
    found = motifs.annotate(found, motifs.parse("\n".join(given.motifs.split())))
    sinks.write_table(regions.in_order(found), given.out, given.format, every_column=True, single=not given.parts)
    reader = spark.read.json(given.out) if given.format == "json" else spark.read.option("header", True).option("sep", "\t" if given.format == "tsv" else ",").csv(given.out)
    number = reader.count() if reader.columns else 0
    print(f"{number} regions in {given.out}")
    return number


if __name__ == "__main__":
    main()
