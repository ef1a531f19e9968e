"""Reference, alternate and rsid of array calls."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zygospark.functions.genotype import array_zygosity
from zygospark.functions.naming import contig_ord
from zygospark.operators.rsids import Coords, first_per_rs, name_positions, reference_bases, spread
from zygospark.session import checked_broadcast
from zygospark.sources.rsid_tables import CURATED_IDS


def enrich_arrays(
    calls: DataFrame,
    kits: DataFrame,
    coords: Coords = None,
    reference: DataFrame | None = None,
    split: bool = True,
) -> DataFrame:
    """Calls with ref/alt/rsid filled and zygosity re-judged for array kits.

    The coordinate named by the call's own rsid counts when it agrees on the
    place; otherwise the coordinate known at the place; otherwise the FASTA base.
    Calls of other kits, and calls that already have a reference, pass by: with
    `split` they skip the shuffled joins, without it (few calls) they ride along
    under a build key that matches nothing.
    """
    columns = calls.columns
    meta = kits.select(F.col("id").alias("kit"), F.col("build").alias("_build"), F.col("assay").alias("_assay"))
    marked = calls.join(checked_broadcast(meta), "kit", "left")
    todo = F.coalesce((F.col("_assay") == "array") & F.col("ref").isNull(), F.lit(False))
    if split and not (coords is None and reference is None):
        rest = marked.filter(~todo).select(*columns)
        rows = marked.filter(todo).withColumn("_todo", F.lit(True))
        return rest.unionByName(_enriched(rows, coords, reference).select(*columns))
    rows = marked.withColumn("_todo", todo).withColumn("_build", F.when(F.col("_todo"), F.col("_build")))
    return _enriched(rows, coords, reference).select(*columns)


def _enriched(rows: DataFrame, coords: Coords, reference: DataFrame | None) -> DataFrame:
    at = name_positions(rows, coords, "_build", "_at")
    if coords is None:
        at = at.withColumn("_own", F.lit(None).cast("struct<rsid:string,ref:string,alt:array<string>>"))
    else:
        # A curated id at its own place is also what the place resolves to, so only
        # dbSNP numbers need a second look by identifier.
        number = F.when(~F.coalesce(F.col("rsid").isin(CURATED_IDS), F.lit(False)), F.col("rs_num"))
        other = -1 - spread(rows)  # meets nothing, and does not pile up
        at = at.withColumns({"_rs": F.coalesce(number, other), "_ord": F.coalesce(contig_ord("chrom"), F.lit(-1))})
        at = at.alias("c").join(
            first_per_rs(coords).alias("o"),
            (F.col("c._build") == F.col("o.build"))
            & (F.col("c._rs") == F.col("o.rs_num"))
            & (F.col("c._ord") == F.col("o.contig_ord"))
            & (F.col("c.pos") == F.col("o.pos")),
            "left",
        )
        hit = F.struct(F.col("c.rsid").alias("rsid"), F.col("o.ref").alias("ref"), F.col("o.alt").alias("alt"))
        at = at.select("c.*", F.when(F.col("o.pos").isNotNull(), hit).alias("_own"))
    place = F.struct(F.col("_at.rsid").alias("rsid"), F.col("_at.ref").alias("ref"), F.col("_at.alt").alias("alt"))
    at = at.withColumn("_k", F.explode(F.array(F.coalesce("_own", F.when(F.col("_at").isNotNull(), place)))))
    at = reference_bases(at, reference, "_build", "_base")
    known, todo = F.col("_k").isNotNull(), F.col("_todo")
    at = at.withColumns(
        {
            "ref": F.when(known, F.col("_k.ref")).when(todo, F.col("_base")).otherwise(F.col("ref")),
            "alt": F.when(known, F.col("_k.alt")).otherwise(F.col("alt")),
            "rsid": F.coalesce("rsid", F.when(known, F.col("_k.rsid"))),
        }
    )
    return at.withColumn("zygosity", F.when(todo, array_zygosity("genotype", "ref")).otherwise(F.col("zygosity")))
