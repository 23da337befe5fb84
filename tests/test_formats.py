"""FASTA, GFF and BED as data sources: splits, filters, streams, and what a failed write leaves."""

import gzip
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqtrough.sources import fasta, formats


@pytest.fixture(scope="module", autouse=True)
def registered(spark):
    formats.register(spark)


def names(path):
    return sorted(x for x in os.listdir(path) if not x.startswith("."))


TEXT = "lost\n>a 1\nac-gu\nNN\n\n  >b\r\nGG\r\n>\nT\n>none\n>a 1\nCC>C\n>last\nAcGt"


@pytest.mark.parametrize("size", [1, 3, 7, 10, 1000])
def test_fasta_splits_give_each_record_once(spark, tmp_path, size):
    (tmp_path / "x.fa").write_bytes(TEXT.encode())
    (tmp_path / "_hidden.fa").write_text(">h\nA\n")
    want = list(fasta.records(TEXT, False, "sequence"))
    df = spark.read.format("fasta").option("splitBytes", size).load(str(tmp_path))
    rows = sorted(df.collect(), key=lambda r: r.start)
    assert [(r.sequence_id, r.seq) for r in rows] == want == [("a 1", "ACGTNN"), ("b", "GG"), ("sequence", "T"), ("a 1", "CCC"), ("last", "ACGT")]
    assert df.rdd.getNumPartitions() == -(-len(TEXT) // size)


def test_fasta_forms_of_files(spark, tmp_path):
    (tmp_path / "a.fa").write_bytes(b">x\rAC\rGT\r>y\rT\r")
    (tmp_path / "b.fa.gz").write_bytes(gzip.compress(b">z\n" + b"ACGT\n" * 1000))
    (tmp_path / "c.txt").write_text("")
    (tmp_path / "d.fa").write_bytes(b">bad \xff\nA\xffC\n")
    read = lambda p, **o: sorted((r.sequence_id, r.seq) for r in spark.read.format("fasta").options(**o).load(p).collect())
    assert read(str(tmp_path / "a.fa"), splitBytes=2) == [("x", "ACGT"), ("y", "T")]
    assert read(f"{tmp_path}/b.*,{tmp_path}/c.txt") == [("z", "ACGT" * 1000)]
    assert read(f"file://{tmp_path}/d.fa") == [("bad �", "AC")]
    assert read(f"{tmp_path}/none*") == []
    with pytest.raises(Exception, match="none"):
        read(f"{tmp_path}/none.fa")


def test_name_filters_reach_the_reader(spark, tmp_path):
    (tmp_path / "x.fa").write_text("".join(f">s{k}\n{'ACGT' * k}\n" for k in range(1, 50)))
    df = spark.read.format("fasta").option("splitBytes", 200).load(str(tmp_path))
    assert [(r.sequence_id, len(r.seq)) for r in df.where("sequence_id = 's7'").collect()] == [("s7", 28)]
    assert sorted(r.sequence_id for r in df.where("sequence_id in ('s7', 's20') and length(seq) > 30").collect()) == ["s20"]
    assert df.where("sequence_id = 's7' and sequence_id = 's8'").count() == 0


def test_round_trips(spark, tmp_path):
    rng = np.random.default_rng(9)
    seqs = [(f"s {k}", "".join(rng.choice(list("ACGTN"), int(rng.integers(1, 300))))) for k in range(60)]
    for width in (60, 0):
        out = f"{tmp_path}/fa{width}"
        spark.createDataFrame(seqs, "sequence_id string, seq string").repartition(5).write.format("fasta").option("lineWidth", width).mode("append").save(out)
        back = spark.read.format("fasta").option("splitBytes", 700).load(out)
        assert sorted((r.sequence_id, r.seq) for r in back.collect()) == sorted(seqs)
    rows = [("chr;1\t", None, "lpr", 1, 9, 0.5, None, None, {"ID": "a;b=c", "Motifs": "TATA:2;GG,C:1", "Empty": ""}), ("x", "s", "t", 2, 3, None, "+", "0", {})]
    df = spark.createDataFrame(rows, formats.GFF)
    df.repartition(3).write.format("gff").mode("append").save(f"{tmp_path}/gff")
    assert sorted(map(tuple, spark.read.format("gff").option("splitBytes", 11).load(f"{tmp_path}/gff").collect())) == sorted(rows)
    text = "".join((tmp_path / "gff" / x).read_text() for x in names(tmp_path / "gff") if x.startswith("part-"))
    assert text.startswith("##gff-version 3\n") and text.count("##gff") == 1 and len(text.splitlines()) == 3
    df.write.format("gff").mode("append").save(f"{tmp_path}/gff")
    assert spark.read.format("gff").load(f"{tmp_path}/gff").count() == 4
    df.limit(1).write.format("gff").mode("overwrite").save(f"{tmp_path}/gff")
    assert spark.read.format("gff").load(f"{tmp_path}/gff").count() == 1 and spark.read.format("gff").load(f"{tmp_path}/gff").where("seqid = 'x'").count() == 0
    bed = [("x", 0, 5, "r1", 1.25), ("x", 7, 8, None, None)]
    spark.createDataFrame(bed, formats.BED).write.format("bed").mode("append").save(f"{tmp_path}/bed")
    assert sorted(map(tuple, spark.read.format("bed").load(f"{tmp_path}/bed").collect())) == bed


def test_empty_tables_and_malformed_lines(spark, tmp_path):
    spark.createDataFrame([], formats.GFF).write.format("gff").mode("append").save(f"{tmp_path}/none")
    assert names(tmp_path / "none") == ["_SUCCESS", "part-000000.gff3"] and spark.read.format("gff").load(f"{tmp_path}/none").count() == 0
    (tmp_path / "x.gff").write_text("##gff-version 3\na\t.\t.\t1\t2\t.\t.\t.\tID=1\n##FASTA\n>a\nACGT\n")
    assert spark.read.format("gff").load(f"{tmp_path}/x.gff").count() == 1
    (tmp_path / "y.gff").write_text("a\tb\n")
    with pytest.raises(Exception, match="instead of 9"):
        spark.read.format("gff").load(f"{tmp_path}/y.gff").collect()


def test_a_failed_write_leaves_nothing_and_keeps_what_was_there(spark, tmp_path):
    good = spark.createDataFrame([("a", "ACGT")], "sequence_id string, seq string")
    bad = spark.range(400).repartition(4).select(F.col("id").cast("string").alias("sequence_id"), F.when(F.col("id") == 399, F.raise_error(F.lit("lost"))).otherwise(F.lit("ACGT")).alias("seq"))
    good.write.format("fasta").mode("append").save(f"{tmp_path}/out")
    for mode in ("append", "overwrite"):
        with pytest.raises(Exception, match="lost"):
            bad.write.format("fasta").mode(mode).save(f"{tmp_path}/out")
        assert names(tmp_path / "out") == ["_SUCCESS", "part-000000.fa"]
        assert [tuple(r)[:2] for r in spark.read.format("fasta").load(f"{tmp_path}/out").collect()] == [("a", "ACGT")]


def test_repeated_attempts_leave_one_file(spark, tmp_path):
    """What two attempts of one task wrote: the commit takes the one that Spark says succeeded."""
    writer = formats.Writer(str(tmp_path / "out"), ".fa", ("##head\n", "", ""), formats.lines_body(formats.fasta_line(0)), True)
    job = tmp_path / "out" / writer.job
    (job / "000000-1").write_text(">half")
    (job / "000000-2").write_text(">a\nAC\n")
    (job / "000001-3").write_text(">b\nGT\n")
    writer.commit([formats.Written(1, str(job / "000001-3")), formats.Written(0, str(job / "000000-2")), formats.Written(2, None), None])
    assert names(tmp_path / "out") == ["_SUCCESS", "part-000000.fa", "part-000001.fa", "part-000002.fa"]
    assert "".join((tmp_path / "out" / f"part-{k:06d}.fa").read_text() for k in range(3)) == "##head\n>a\nAC\n>b\nGT\n"


def test_stream_goes_on_after_a_restart(spark, tmp_path):
    source, out, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    os.makedirs(source)

    def run():
        rows = spark.readStream.format("fasta").option("splitBytes", 9).load(source).select("sequence_id", "seq")
        rows.writeStream.format("parquet").option("checkpointLocation", check).trigger(availableNow=True).start(out).awaitTermination(120)
        return sorted(map(tuple, spark.read.schema("sequence_id string, seq string").parquet(out).collect()))

    def put(name, text, time):
        with open(f"{source}/{name}", "w") as f:
            f.write(text)
        os.utime(f"{source}/{name}", (time, time))

    put("a.fa", ">a\nACGT\n>b\nGG\n", 1_000_000_000)
    assert run() == [("a", "ACGT"), ("b", "GG")] == run()
    put("z.fa", ">c\nT\n", 1_000_000_000)
    put("b.fa", ">d\nTT\n>e\nCC\n", 1_000_000_001)
    assert run() == [("a", "ACGT"), ("b", "GG"), ("c", "T"), ("d", "TT"), ("e", "CC")]


TABLE = "name string, n long, x double, yes boolean, d decimal(20,3), small int"
ODD = [("a<b>&\"' \t\n\r", 1, 0.1, True, None, -5), (None, None, None, None, None, None), ("_x0041_ \x01", -(2**62), 1e-300, False, None, 0), ("é\U0001f600 ", 2**53 + 1, float("inf"), None, None, 2**31 - 1), ("", 0, -0.0, None, None, None)]


@pytest.mark.parametrize("rows", [2, 3, 1000])
def test_workbooks_in_sheets(spark, tmp_path, rows):
    import zipfile

    df = spark.createDataFrame(ODD, TABLE).coalesce(1)
    df.write.format("xlsx").option("sheetRows", rows).option("sheetName", "A & B").mode("overwrite").save(f"{tmp_path}/x")
    (book,) = [x for x in names(tmp_path / "x") if x.endswith(".xlsx")]
    with zipfile.ZipFile(tmp_path / "x" / book) as z:
        assert z.testzip() is None and sum("worksheets/sheet" in x for x in z.namelist()) == -(-len(ODD) // (rows - 1)) and b'name="A &amp; B"' in z.read("xl/workbook.xml")
    back = [tuple(r) for r in spark.read.format("xlsx").schema(TABLE).load(f"{tmp_path}/x").collect()]
    want = [tuple(None if v == float("inf") else v for v in r) for r in ODD]
    assert back == [(r[0].replace("\r", "\n") if r[0] else r[0], *r[1:]) for r in want]  # as XML reads line ends
    some = spark.read.format("xlsx").schema("x double, absent string, name string").load(f"{tmp_path}/x").first()
    assert (some.x, some.absent) == (0.1, None)


def test_workbooks_of_tasks_and_shared_strings(spark, tmp_path):
    import zipfile

    spark.range(100).repartition(5).write.format("xlsx").mode("append").save(f"{tmp_path}/many")
    assert len(names(tmp_path / "many")) == 6 and sorted(r.id for r in spark.read.format("xlsx").schema("id long").load(f"{tmp_path}/many").collect()) == list(range(100))
    spark.range(0).write.format("xlsx").mode("append").save(f"{tmp_path}/none")
    assert spark.read.format("xlsx").schema("id long").load(f"{tmp_path}/none").count() == 0
    main, office = (f"http://schemas.openxmlformats.org/{x}" for x in ("spreadsheetml/2006/main", "officeDocument/2006/relationships"))
    with zipfile.ZipFile(tmp_path / "other.xlsx", "w") as z:  # as other programs write it
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{office}"><sheets><sheet name="S" sheetId="1" r:id="rId7"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId7" Type="x" Target="/xl/worksheets/s.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{main}"><si><t>n</t></si><si><r><t>ri</t></r><r><t>ch</t></r></si><si><t>t</t></si></sst>')
        z.writestr("xl/worksheets/s.xml", f'<worksheet xmlns="{main}"><sheetData><row r="1"><c r="B1" t="s"><v>0</v></c><c r="AA1" t="s"><v>2</v></c></row><row r="2"><c r="B2"><v>3.0</v></c><c r="AA2" t="s"><v>1</v></c></row></sheetData></worksheet>')
    assert [tuple(r) for r in spark.read.format("xlsx").schema("n long, t string").load(f"{tmp_path}/other.xlsx").collect()] == [(3, "rich")]


def test_parts_are_one_array(spark, tmp_path):
    import json

    schema = "name string, n long, x double, m map<string,int>, a array<struct<k:int>>"
    rows = [("a\n\"é", 1, 0.5, {"k": 1}, [(1,), (None,)]), (None, None, float("nan"), None, []), ("],", 3, 2.0, {}, None)]
    df = spark.createDataFrame(rows, schema).repartition(7)
    df.write.format("json_array").mode("overwrite").save(f"{tmp_path}/x")
    text = "".join((tmp_path / "x" / x).read_text() for x in names(tmp_path / "x") if x.startswith("part-"))
    got = sorted(json.loads(text), key=lambda r: r["n"] or 0)
    assert got == [{"name": None, "n": None, "x": None, "m": None, "a": []}, {"name": "a\n\"é", "n": 1, "x": 0.5, "m": {"k": 1}, "a": [{"k": 1}, {"k": None}]}, {"name": "],", "n": 3, "x": 2.0, "m": {}, "a": None}]
    back = spark.read.format("json_array").schema("n long, name string").option("splitBytes", 9).load(f"{tmp_path}/x").collect()
    assert sorted(map(tuple, back), key=str) == sorted([(1, "a\n\"é"), (None, None), (3, "],")], key=str)
    with pytest.raises(Exception, match="appended"):
        df.write.format("json_array").mode("append").save(f"{tmp_path}/x")
    df.limit(0).write.format("json_array").mode("overwrite").save(f"{tmp_path}/x")
    assert json.loads("".join((tmp_path / "x" / x).read_text() for x in names(tmp_path / "x") if x.startswith("part-"))) == []
