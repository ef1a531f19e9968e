"""Liftover of positions through chain blocks as a binned equi-join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from zygospark.functions.common import int_div
from zygospark.functions.genotype import lifted, lifted_alts
from zygospark.schema import UNKNOWN_BUILD
from zygospark.session import BROADCAST_ROWS

BIN = 1 << 14

_KEYS = ["from_build", "to_build", "t_chrom"]
_TARGET = ["q_chrom", "q_start", "q_size", "q_neg", "score"]


def _bins(start: Column, end: Column, width: int) -> Column:
    """Bins touched by the half-open interval [start, end)."""
    return F.sequence(int_div(start, width), int_div(end - 1, width))


def best_segments(blocks: DataFrame, width: int = BIN) -> DataFrame:
    """Disjoint segments per bin, each with its best covering block.

    The best hit of a position depends only on which blocks cover it, so ties
    are settled here, on the small chain table.  A position then meets at most
    one segment and lifting needs neither a sort nor a shuffle of the positions.
    """
    cover = blocks.filter("t_start < t_end").withColumn("bin", F.explode(_bins(F.col("t_start"), F.col("t_end"), width)))
    cover = cover.withColumns(
        {
            "lo": F.greatest(F.col("t_start"), F.col("bin") * width),
            "hi": F.least(F.col("t_end"), (F.col("bin") + 1) * width),
            "rank": F.struct("score", "t_start", "blk"),
        }
    )
    cuts = cover.select(*_KEYS, "bin", F.explode(F.array("lo", "hi")).alias("lo")).distinct()
    edge = W.partitionBy(*_KEYS, "bin").orderBy("lo")
    # At most width + 1 cuts fall into a bin, whatever the number of blocks.
    spans = cuts.withColumn("hi", F.lead("lo").over(edge)).filter("hi is not null")
    same = [F.col(f"s.{k}") == F.col(f"c.{k}") for k in [*_KEYS, "bin"]]
    hits = spans.alias("s").join(
        cover.alias("c"), [*same, F.col("c.lo") <= F.col("s.lo"), F.col("s.hi") <= F.col("c.hi")]
    )
    best = hits.groupBy(*[F.col(f"s.{k}") for k in [*_KEYS, "bin", "lo", "hi"]]).agg(
        F.max_by(F.struct(*[F.col(f"c.{c}") for c in ["t_start", *_TARGET]]), F.col("c.rank")).alias("b")
    )
    return best.select(*_KEYS, "bin", "lo", "hi", "b.*")


def _bounded(blocks: DataFrame, table: DataFrame, width: int, per_block: int) -> DataFrame:
    """Broadcast hint for a table with at most per_block rows per block and bin, if that bound is small."""
    touched = int_div(F.col("t_end") - 1, width) - int_div("t_start", width) + 1
    bound = blocks.agg(F.sum(touched)).first()[0] or 0
    return F.broadcast(table) if bound * per_block <= BROADCAST_ROWS else table


def _target(x: Column) -> dict[str, Column]:
    q = F.col("q_start") + (x - F.col("t_start"))
    q0 = F.when(F.col("q_neg"), F.col("q_size") - 1 - q).otherwise(q)
    return {"lifted_chrom": F.col("q_chrom"), "lifted_pos": q0 + 1, "reverse": F.col("q_neg")}


def _keyed(points: DataFrame, from_build, to_build, width: int) -> DataFrame:
    x = F.greatest(F.col("pos") - 1, F.lit(0))
    return points.withColumns(
        {
            "_from": F.lit(from_build) if isinstance(from_build, str) else from_build,
            "_to": F.lit(to_build) if isinstance(to_build, str) else to_build,
            "_x": x,
            "_bin": int_div(x, width),
        }
    )


def _matches(side: str) -> list[Column]:
    pairs = [("_from", "from_build"), ("_to", "to_build"), ("chrom", "t_chrom"), ("_bin", "bin")]
    return [F.col(f"p.{p}") == F.col(f"{side}.{c}") for p, c in pairs]


def lift_best(
    points: DataFrame,
    blocks: DataFrame,
    from_build: Column | str,
    to_build: Column | str,
    width: int = BIN,
    how: str = "left",
) -> DataFrame:
    """Points (chrom, pos, ...) plus lifted_chrom, lifted_pos, reverse.

    Unmapped points have nulls, or are dropped with how="inner".  The builds are
    names or columns of `points`, so mixed directions lift in one join.
    """
    segments = _bounded(blocks, best_segments(blocks, width), width, 2)
    p = _keyed(points, from_build, to_build, width)
    hit = p.alias("p").join(
        segments.alias("g"), [*_matches("g"), F.col("g.lo") <= F.col("p._x"), F.col("p._x") < F.col("g.hi")], how
    )
    out = _target(F.col("_x"))
    return hit.select(*[F.col(f"p.{c}") for c in points.columns], *[e.alias(n) for n, e in out.items()])


def lift_all(
    points: DataFrame, blocks: DataFrame, from_build: Column | str, to_build: Column | str, width: int = BIN
) -> DataFrame:
    """Every hit of every point (inner), with chain score, t_start and block number."""
    cover = blocks.filter("t_start < t_end").withColumn("bin", F.explode(_bins(F.col("t_start"), F.col("t_end"), width)))
    p = _keyed(points, from_build, to_build, width)
    hit = p.alias("p").join(
        _bounded(blocks, cover, width, 1).alias("c"),
        [*_matches("c"), F.col("c.t_start") <= F.col("p._x"), F.col("p._x") < F.col("c.t_end")],
    )
    out = _target(F.col("_x"))
    return hit.select(
        *[F.col(f"p.{c}") for c in points.columns], *[e.alias(n) for n, e in out.items()], "c.score", "c.t_start", "c.blk"
    )


def liftover(
    points: DataFrame, blocks: DataFrame | None, from_build: str, to_build: str, hits: str = "best", width: int = BIN
) -> DataFrame:
    """The liftover report: build, lifted_chrom, lifted_pos, lifted_build, strand, status."""
    if from_build == to_build:
        out = points.withColumns({"lifted_chrom": F.col("chrom"), "lifted_pos": F.col("pos"), "reverse": F.lit(False)})
    elif UNKNOWN_BUILD in (from_build, to_build):
        raise ValueError("cannot lift over to or from an unknown build")
    elif blocks is None:
        raise ValueError(f"no chain blocks from {from_build} to {to_build}")
    else:
        out = (lift_all if hits == "all" else lift_best)(points, blocks, from_build, to_build, width)
    mapped = F.col("lifted_pos").isNotNull()
    return out.withColumns(
        {
            "build": F.lit(from_build),
            "lifted_build": F.lit(to_build),
            "strand": F.when(mapped, F.when(F.col("reverse"), F.lit("-")).otherwise(F.lit("+"))),
            "status": F.when(mapped, F.lit("mapped")).otherwise(F.lit("unmapped")),
        }
    )


def apply_lift(calls: DataFrame) -> DataFrame:
    """Move lifted calls to their new place; alleles are complemented on the minus strand."""
    return calls.withColumns(
        {
            "genotype": lifted("genotype", "reverse"),
            "ref": lifted("ref", "reverse"),
            "alt": lifted_alts("alt", "reverse"),
            "chrom": F.col("lifted_chrom"),
            "pos": F.col("lifted_pos"),
            "end": F.col("lifted_pos"),
        }
    ).drop("lifted_chrom", "lifted_pos", "reverse")


