"""Genotype tables derived from the test tables by integer arithmetic.

The given Parquet tables hold no genotypes, so calls come from `lineitem`,
chain blocks and rsid coordinates from `part`.  All work grows with them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from zygospark.functions.common import int_div
from zygospark.functions.genotype import indexed_rs, no_strings
from zygospark.functions.policy import ref_calls_policy
from zygospark.schema import GRCH37, GRCH38
from zygospark.session import small_table, written
from zygospark.sources.fasta import reference_chunks

BASES = "ACGT"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def base_at(i: Column) -> Column:
    return F.substring(F.lit(BASES), (i % 4 + 1).cast("int"), F.lit(1))


def contig(cm: Column) -> Column:
    return (
        F.when(cm == 0, F.lit("hs37d5"))
        .when(cm == 26, F.lit("GL000192.1"))
        .when(cm == 23, F.lit("X"))
        .when(cm == 24, F.lit("Y"))
        .when(cm == 25, F.lit("MT"))
        .otherwise(cm.cast("string"))
    )


def calls(spark: SparkSession, sf: str) -> DataFrame:
    """Calls of four kits, one for each line item; a place of a kit can have several.

    The source order packs (order, line) into one number.
    """
    d = table(spark, sf, "lineitem").select(
        (F.col("l_suppkey") % 4 + 1).alias("kn"),
        F.col("l_partkey").alias("pk"),
        F.col("l_quantity").cast("bigint").alias("q"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("src_ord"),
    )
    kn, pk, q = F.col("kn"), F.col("pk"), F.col("q")
    cm = (pk % 27).cast("int")
    ok, ln = int_div(F.col("src_ord"), 10), F.col("src_ord") % 10
    array = kn == 1
    turn = ((ok + ln) % 10).cast("int")
    pos = 1 + int_div(pk - pk % 27, 27) * 40000 + q * 100
    number = (pk * 100 + q).cast("string")
    prefix = F.when((pk + q) % 10 == 0, F.lit("i")).otherwise(F.lit("rs"))
    rsid = F.when(~((kn == 2) | ((kn > 2) & (pk % 2 == 1))), F.concat(prefix, number))

    def by_turn(values: list[str]) -> Column:
        return F.element_at(F.array(*[F.lit(v) for v in values]), turn + 1)

    gts = ["0/1"] * 4 + ["1/1"] * 2 + ["0/0"] * 2 + ["./.", "1"]
    on_array = ["het"] * 4 + ["hom"] * 4 + ["no_call", "hemi"]
    on_vcf = ["het"] * 4 + ["hom_alt"] * 2 + ["hom_ref"] * 2 + ["no_call", "hemi"]
    d = d.select(
        F.concat(F.lit("k"), kn.cast("string")).alias("kit"),
        "src_ord",
        contig(cm).alias("chrom"),
        F.when(cm.between(1, 25), cm).alias("contig_ord"),
        pos.alias("pos"),
        rsid.alias("rsid"),
        base_at(pk + q).alias("r"),
        base_at(pk + q + 1 + pk % 3).alias("a"),
        by_turn(gts).alias("g"),
        F.when(array, by_turn(on_array)).otherwise(by_turn(on_vcf)).alias("zygosity"),
        F.when(ok % 7 == 0, F.lit("LowQual")).otherwise(F.lit("PASS")).alias("flt"),
        (ln * 10).cast("float").alias("ql"),
        (q + ln).alias("dp"),
        array.alias("array"),
        ((kn == 3) & turn.isin(6, 7)).alias("ref_block"),
    )
    g, r, a = F.col("g"), F.col("r"), F.col("a")
    genotype = (
        F.when(g == "0/1", F.concat(r, a))
        .when(g == "1/1", F.concat(a, a))
        .when(g == "0/0", F.concat(r, r))
        .when(g == "1", a)
        .otherwise(F.lit("--"))
    )

    def unless_array(c: Column) -> Column:
        return F.when(~F.col("array"), c)

    return d.select(
        "kit",
        "src_ord",
        "chrom",
        "contig_ord",
        "pos",
        F.when(F.col("ref_block"), F.col("pos") + 250).otherwise(F.col("pos")).alias("end"),
        "rsid",
        indexed_rs("rsid").alias("rs_num"),
        unless_array(r).alias("ref"),
        F.when(F.col("array"), no_strings()).otherwise(F.array(a)).alias("alt"),
        genotype.alias("genotype"),
        unless_array(g).alias("gt"),
        "zygosity",
        unless_array(F.col("flt")).alias("filter"),
        unless_array(F.col("ql")).alias("quality"),
        unless_array(F.col("dp")).alias("depth"),
        "ref_block",
    )


def stored_calls(spark: SparkSession, sf: str) -> DataFrame:
    """The calls as a table partitioned by kit, for queries that read them several times."""
    return written(calls(spark, sf), "kit")


def kits(spark: SparkSession, counts: DataFrame | None = None) -> DataFrame:
    """Metadata of the four kits; with `counts` also records, rsid_records and has_rsids."""
    rows = [
        (1, "k1", "array one", "23andme", "array", GRCH37),
        (2, "k2", "wgs two", "vcf", "wgs", GRCH38),
        (3, "k3", "gvcf three", "gvcf", "wgs", GRCH38),
        (4, "k4", "exome four", "vcf", "wes", GRCH38),
    ]
    meta = small_table(spark, rows, "seq long, id string, name string, source_format string, assay string, build string")
    meta = meta.withColumn("ref_calls", ref_calls_policy("assay", "source_format")).withColumn("sample", F.col("name"))
    if counts is None:
        return meta
    return meta.join(counts.withColumnRenamed("kit", "id"), "id", "left")


def chain_blocks(spark: SparkSession, sf: str, from_build: str = GRCH37, to_build: str = GRCH38) -> DataFrame:
    """Alignment blocks: every fifth on the minus strand, some overlapped by a second chain."""
    pk = F.col("p_partkey")
    p = table(spark, sf, "part").select(
        pk.alias("blk"),
        contig((pk % 27).cast("int")).alias("chrom"),
        (int_div(pk - pk % 27, 27) * 40000).alias("t_start"),
        F.col("p_size").cast("double").alias("size"),
    )
    minus = F.col("blk") % 5 == 0
    start = F.col("t_start")
    one = F.struct(
        F.col("blk"),
        (start + 3000).alias("t_end"),
        F.when(minus, 300000000 - (start + 5000)).otherwise(start + 200).alias("q_start"),
        minus.alias("q_neg"),
        F.col("size").alias("score"),
    )
    two = F.struct(
        (F.col("blk") + 1000000).alias("blk"),
        (start + 4000).alias("t_end"),
        (start + 300).alias("q_start"),
        F.lit(False).alias("q_neg"),
        (60 - F.col("size")).alias("score"),
    )
    each = F.when(F.col("size") % 7 == 0, F.array(one, two)).otherwise(F.array(one))
    return p.select("chrom", "t_start", F.explode(each).alias("x")).select(
        F.lit(from_build).alias("from_build"),
        F.lit(to_build).alias("to_build"),
        "x.blk",
        F.col("chrom").alias("t_chrom"),
        "t_start",
        "x.t_end",
        F.col("chrom").alias("q_chrom"),
        "x.q_start",
        F.lit(300000001).cast("bigint").alias("q_size"),
        "x.q_neg",
        "x.score",
    )


def rsid_coords(spark: SparkSession, sf: str) -> DataFrame:
    """dbSNP-like coordinates of the parts on primary contigs: every third in GRCh38, the others in GRCh37."""
    pk = F.col("p_partkey")
    cm = (pk % 27).cast("int")
    number = pk * 100 + 25
    p = table(spark, sf, "part").filter(cm.between(1, 25))
    return p.select(
        F.when(pk % 3 == 0, F.lit(GRCH38)).otherwise(F.lit(GRCH37)).alias("build"),
        number.alias("rs_num"),
        F.concat(F.lit("rs"), number.cast("string")).alias("rsid"),
        contig(cm).alias("chrom"),
        cm.alias("contig_ord"),
        (1 + int_div(pk - pk % 27, 27) * 40000 + 2500).alias("pos"),
        base_at(pk + 25).alias("ref"),
        F.array(base_at(pk + 26 + pk % 3)).alias("alt"),
        F.lit("dbsnp").alias("source"),
    )


def lines(rows: DataFrame, file: Column, at: Column, value: Column, block: int = 4096) -> DataFrame:
    """Text lines from rows: `at` is the line number inside the file.

    The line comes out of a generator, so predicates on it stay above, as they
    do for lines read from a file.
    """
    return rows.select(
        file.alias("file"), int_div(at, block).alias("block"), at.cast("bigint").alias("ord"), F.explode(F.array(value)).alias("value")
    )


def fasta_lines(spark: SparkSession, sf: str) -> DataFrame:
    """FASTA text: contig c<cm> has one 20-base line per part, in slot order."""
    pk = F.col("p_partkey")
    cm = pk % 27
    slot = int_div(pk - cm, 27)
    letters = F.concat(*[base_at(pk * (i + 3) + i) for i in range(20)])
    p = table(spark, sf, "part").withColumn("two", F.explode(F.when(slot == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(1)))))
    file = F.concat(F.lit("c"), cm.cast("string"))
    text = F.when(F.col("two") == 0, F.concat(F.lit(">"), file, F.lit(" synthetic"))).otherwise(F.lower(letters))
    return lines(p, file, slot * 2 + F.col("two"), text)


def fasta_chunks(spark: SparkSession, sf: str, chunk: int) -> DataFrame:
    return reference_chunks(fasta_lines(spark, sf), GRCH38, chunk)
