"""rsid <-> coordinate resolution and reference bases."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from zygospark.functions.common import int_div
from zygospark.functions.genotype import rs_number
from zygospark.functions.naming import contig_name, contig_ord, other_build
from zygospark.operators.liftover import lift_best
from zygospark.schema import UNKNOWN_BUILD
from zygospark.sources.fasta import CHUNK
from zygospark.sources.rsid_tables import CURATED_IDS, curated_coords


@dataclass
class CoordTables:
    """dbSNP coordinates cut down to the rows that answer: one per (build, rs number), one per (build, place).

    Stored once at import (`store.write_rsid_coords`), so that no query has to find
    the first records again; every operator takes them in place of the raw rows.
    """

    by_rs: DataFrame  # build, rs_num, contig_ord, pos, ref, alt
    by_pos: DataFrame  # build, contig_ord, pos, rs_num, ref, alt


Coords = DataFrame | CoordTables | None


def first_per_rs(coords: DataFrame | CoordTables, only: DataFrame | None = None) -> DataFrame:
    """dbSNP record an rs number resolves to: the first by (contig, pos); `only` lists the numbers asked, if they are few."""
    stored = isinstance(coords, CoordTables)
    db = coords.by_rs if stored else coords.filter(F.col("source") == "dbsnp")
    db = db if only is None else db.join(F.broadcast(only), "rs_num", "left_semi")
    if stored:
        return db.select("build", "rs_num", "contig_ord", "pos", "ref", "alt")
    best = db.groupBy("build", "rs_num").agg(F.min(F.struct("contig_ord", "pos", "ref", "alt")).alias("b"))
    return best.select("build", "rs_num", "b.*")


def first_per_position(coords: DataFrame | CoordTables, only: DataFrame | None = None) -> DataFrame:
    """dbSNP record a position resolves to: the lowest rs number; `only` lists the places asked, if they are few."""
    stored = isinstance(coords, CoordTables)
    db = coords.by_pos if stored else coords.filter(F.col("source") == "dbsnp")
    db = db if only is None else db.join(F.broadcast(only), ["contig_ord", "pos"], "left_semi")
    if stored:
        return db.select("build", "contig_ord", "pos", "rs_num", "ref", "alt")
    best = db.groupBy("build", "contig_ord", "pos").agg(F.min(F.struct("rs_num", "ref", "alt")).alias("b"))
    return best.select("build", "contig_ord", "pos", "b.*")


def _curated(df: DataFrame, *names: str) -> DataFrame:
    """The bundled curated rows (16 rows, safe to broadcast)."""
    return F.broadcast(curated_coords(df.sparkSession).select(*names))


def spread(rows: DataFrame) -> Column:
    """A number of 0 to 2^20 - 1 from a row's plain columns, for rows that would else share one key."""
    plain = [f.name for f in rows.schema.fields if not isinstance(f.dataType, (T.StructType, T.ArrayType, T.MapType))]
    return F.pmod(F.xxhash64(*(plain or rows.columns)), F.lit(1 << 20))


def _coord(rsid: Column, chrom: Column, pos: Column, ref: Column, alt: Column, source: str) -> Column:
    return F.struct(
        rsid.alias("rsid"), chrom.alias("chrom"), pos.alias("pos"), ref.alias("ref"), alt.alias("alt"),
        F.lit(source).alias("source"),
    )


def resolve_rsids(
    queries: DataFrame, coords: Coords, build: str = "build", into: str = "coord", small: bool = False
) -> DataFrame:
    """Queries (rsid, build, ...) plus a coordinate struct, null when unknown.

    Curated ids win and are matched by text; others resolve by rs number.  With
    `small` queries the coordinate table is cut down to their numbers first.
    """
    keep = queries.columns
    cur = _curated(queries, "build", "rsid", "chrom", "pos", "ref", "alt").alias("k")
    out = queries.alias("q").join(
        cur, (F.col("q.rsid") == F.col("k.rsid")) & (F.col(f"q.{build}") == F.col("k.build")), "left"
    )
    curated = F.when(
        F.col("k.pos").isNotNull(),
        _coord(F.col("k.rsid"), F.col("k.chrom"), F.col("k.pos"), F.col("k.ref"), F.col("k.alt"), "curated"),
    )
    out = out.select(*[F.col(f"q.{c}") for c in keep], curated.alias("_cur"))
    if coords is None:
        return out.withColumnRenamed("_cur", into)
    # Rows without a usable number get a distinct key that never matches, which
    # keeps them from piling up on one null key.
    number = F.when(~F.col("rsid").isin(CURATED_IDS), rs_number("rsid"))
    out = out.withColumn("_rs", F.coalesce(number, -1 - F.abs(F.xxhash64("rsid") % (1 << 40))))
    db = first_per_rs(coords, out.select(F.col("_rs").alias("rs_num")).distinct() if small else None).alias("d")
    out = out.alias("q").join(db, (F.col(f"q.{build}") == F.col("d.build")) & (F.col("q._rs") == F.col("d.rs_num")), "left")
    found = F.when(
        F.col("d.pos").isNotNull(),
        _coord(
            F.concat(F.lit("rs"), F.col("d.rs_num").cast("string")),
            contig_name(F.col("d.contig_ord")),
            F.col("d.pos"),
            F.col("d.ref"),
            F.col("d.alt"),
            "dbsnp",
        ),
    )
    return out.select(*[F.col(f"q.{c}") for c in keep], F.coalesce(F.col("q._cur"), found).alias(into))


def resolve_across_builds(
    queries: DataFrame, coords: Coords, blocks: DataFrame | None, build: str = "build", small: bool = False
) -> DataFrame:
    """resolve_rsids with fallback to the other build's entry, lifted over.

    Adds coord, lifted_from (struct, null when direct) and lift_failed.  A lifted
    coordinate has no reference and keeps its alts as listed (not complemented).
    """
    keep = queries.columns
    out = resolve_rsids(queries, coords, build, small=small)
    out = out.withColumn("_other", other_build(build))
    out = resolve_rsids(out, coords, "_other", "_far", small)
    known = F.col(build) != UNKNOWN_BUILD
    far = F.when(F.col("coord").isNull() & known, F.col("_far"))
    if blocks is None:
        return out.select(
            *keep,
            F.when(known, F.col("coord")).alias("coord"),
            F.lit(None).cast("struct<build:string,pos:bigint>").alias("lifted_from"),
            far.isNotNull().alias("lift_failed"),
        )
    flat = out.select(
        *[F.col(c).alias(f"_q_{c}") for c in keep],
        F.when(known, F.col("coord")).alias("coord"),
        F.col("_other"),
        F.col(build).alias("_own"),
        far.alias("far"),
        # Rows that need no lift get keys that meet nothing, spread so that they do not pile up on one.
        F.coalesce(far.chrom, F.concat(F.lit("-"), F.pmod(F.xxhash64(*keep), F.lit(4096)).cast("string"))).alias("chrom"),
        F.coalesce(far.pos, F.lit(1).cast("bigint")).alias("pos"),
    )
    up = lift_best(flat, blocks, F.col("_other"), F.col("_own"))
    moved = F.when(
        F.col("lifted_pos").isNotNull(),
        F.struct(
            F.col("far.rsid").alias("rsid"),
            F.col("lifted_chrom").alias("chrom"),
            F.col("lifted_pos").alias("pos"),
            F.lit(None).cast("string").alias("ref"),
            F.col("far.alt").alias("alt"),
            F.col("far.source").alias("source"),
        ),
    )
    return up.select(
        *[F.col(f"_q_{c}").alias(c) for c in keep],
        F.coalesce("coord", moved).alias("coord"),
        F.when(
            F.col("lifted_pos").isNotNull(), F.struct(F.col("_other").alias("build"), F.col("pos").alias("pos"))
        ).alias("lifted_from"),
        (F.col("far").isNotNull() & F.col("lifted_pos").isNull()).alias("lift_failed"),
    )


def name_positions(
    points: DataFrame, coords: Coords, build: str = "build", into: str = "named", small: bool = False
) -> DataFrame:
    """Points (chrom, pos, build, ...) plus the coordinate known at that place, null when none."""
    keep = points.columns
    cur = _curated(points, "build", "rsid", "chrom", "pos", "ref", "alt").alias("k")
    out = points.alias("q").join(
        cur,
        (F.col("q.chrom") == F.col("k.chrom"))
        & (F.col("q.pos") == F.col("k.pos"))
        & (F.col(f"q.{build}") == F.col("k.build")),
        "left",
    )
    curated = F.when(
        F.col("k.pos").isNotNull(),
        _coord(F.col("k.rsid"), F.col("k.chrom"), F.col("k.pos"), F.col("k.ref"), F.col("k.alt"), "curated"),
    )
    out = out.select(*[F.col(f"q.{c}") for c in keep], curated.alias("_cur"))
    if coords is None:
        return out.withColumnRenamed("_cur", into)
    # Rows without a place get keys that meet nothing, spread so that they do not pile up on one null key.
    nowhere = (-1 - spread(points)).cast("int")
    out = out.withColumn("_ord", F.coalesce(F.when(F.col("pos").isNotNull(), contig_ord("chrom")), nowhere))
    out = out.withColumn("_pos", F.coalesce("pos", F.lit(0)))
    places = out.filter("_ord >= 0").select(F.col("_ord").alias("contig_ord"), "pos").distinct() if small else None
    db = first_per_position(coords, places).alias("d")
    out = out.alias("q").join(
        db,
        (F.col(f"q.{build}") == F.col("d.build"))
        & (F.col("q._ord") == F.col("d.contig_ord"))
        & (F.col("q._pos") == F.col("d.pos")),
        "left",
    )
    found = F.when(
        F.col("d.pos").isNotNull(),
        _coord(
            F.concat(F.lit("rs"), F.col("d.rs_num").cast("string")),
            contig_name(F.col("d.contig_ord")),
            F.col("d.pos"),
            F.col("d.ref"),
            F.col("d.alt"),
            "dbsnp",
        ),
    )
    # Through a generator: predicates on the answer stay above it and do not build it again at each mention.
    return out.select(*[F.col(f"q.{c}") for c in keep], F.explode(F.array(F.coalesce(F.col("q._cur"), found))).alias(into))


def reference_bases(
    points: DataFrame, reference: DataFrame | None, build: str = "build", into: str = "base", chunk: int = CHUNK
) -> DataFrame:
    """Points (chrom, pos, build, ...) plus the reference base, null outside the contig."""
    if reference is None:
        return points.withColumn(into, F.lit(None).cast("string"))
    keep = points.columns
    p = points.withColumn("_chunk", int_div(F.col("pos") - 1, chunk))
    hit = p.alias("q").join(
        reference.alias("r"),
        (F.col(f"q.{build}") == F.col("r.build"))
        & (F.col("q.chrom") == F.col("r.chrom"))
        & (F.col("q._chunk") == F.col("r.chunk")),
        "left",
    )
    base = F.upper(F.substring(F.col("r.seq"), (F.pmod(F.col("q.pos") - 1, F.lit(chunk)) + 1).cast("int"), F.lit(1)))
    return hit.select(*[F.col(f"q.{c}") for c in keep], F.nullif(base, F.lit("")).alias(into))


def site_reference(
    points: DataFrame,
    coords: Coords,
    reference: DataFrame | None,
    needed: Column,
    hint: Column,
    build: str = "build",
    into: str = "site_ref",
    split: bool = True,
) -> DataFrame:
    """Reference letter per point: hint, then coordinate table, then FASTA.

    With `split`, rows that need no letter or bring a hint skip the shuffled joins.
    """
    want = F.coalesce(needed & hint.isNull(), F.lit(False))
    if split and not (coords is None and reference is None):
        done = points.filter(~want).withColumn(into, hint)
        rest = _looked_up(points.filter(want), coords, reference, build)
        return done.unionByName(rest.withColumn(into, F.coalesce("_named.ref", "_base")).drop("_named", "_base"))
    rest = _looked_up(points, coords, reference, build)
    return rest.withColumn(into, F.coalesce(hint, F.when(needed, F.coalesce("_named.ref", "_base")))).drop("_named", "_base")


def _looked_up(points: DataFrame, coords: Coords, reference: DataFrame | None, build: str) -> DataFrame:
    return reference_bases(name_positions(points, coords, build, "_named"), reference, build, "_base")
