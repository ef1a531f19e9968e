"""Genotype concordance of kit pairs, within or across builds."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from zygospark.functions.common import round_places
from zygospark.functions.genotype import hom_ref_letters, is_called, lifted, lifted_alts, snv_key
from zygospark.functions.naming import contig_ord, is_primary
from zygospark.operators.enrich import enrich_arrays
from zygospark.operators.liftover import apply_lift, lift_best
from zygospark.operators.lookup import INFERRED_WARNING, LIFT_TYPE, near_sites
from zygospark.operators.ordering import rank_rows
from zygospark.operators.rsids import site_reference
from zygospark.schema import ABSENT_MEANS_REF, HOM_REF, INFERRED_REF, OBSERVED, UNKNOWN_BUILD
from zygospark.session import BROADCAST_ROWS, written

MAX_DISCORDANT = 50
AFTER_PRIMARY = 1 << 30

# Verdicts of one pair of genotypes.
SKIPPED, CONCORDANT, DISCORDANT = 0, 1, 2

SITE = ["a", "b", "chrom", "pos"]
DETAIL = ["rsid", "ref", "alt", "genotype", "zygosity", "filter", "quality", "depth"]
# What judging a call needs; the other columns stay behind, a listing fetches them for its own rows.
JUDGED = ["kit", "src_ord", "chrom", "contig_ord", "pos", "end", "rsid", "rs_num", "ref", "alt", "genotype", "zygosity"]


def verdict(x: Column, y: Column) -> Column:
    return F.when(x.isNull() | y.isNull(), SKIPPED).when(x == y, CONCORDANT).otherwise(DISCORDANT)


@dataclass
class Plan:
    """Kit pairs with their facts, and which branches the comparison needs."""

    pairs: DataFrame  # a, b, a_build, b_build, a_absent, b_absent
    small: bool
    a_infer: bool  # some A calls are judged against B's implied reference
    b_infer: bool
    same: bool  # some pairs share a build
    lift: bool
    arrays: bool  # some A kit is an array
    dense: bool  # most combinations of an A kit and a B kit are pairs
    n_pairs: int

    def hint(self, df: DataFrame) -> DataFrame:
        """Broadcast a table with at most one row per pair, when the pairs are few."""
        return F.broadcast(df) if self.small else df


def describe_pairs(pairs: DataFrame, kits: DataFrame) -> Plan:
    """Pairs (a, b) with both kits' builds and absence rules; raises on unknown builds.

    One aggregate over the pair list tells which branches the plan needs.
    """
    side = kits.select("id", "build", "assay", (F.col("ref_calls") == ABSENT_MEANS_REF).alias("absent"))
    out = pairs.select("a", "b")
    for k in ("a", "b"):
        out = out.join(side.select(*[F.col(c).alias(k if c == "id" else f"{k}_{c}") for c in side.columns]), k)
    differ = F.col("a_build") != F.col("b_build")
    clash = differ & ((F.col("a_build") == UNKNOWN_BUILD) | (F.col("b_build") == UNKNOWN_BUILD))
    names = F.concat("a", F.lit(" ("), "a_build", F.lit(") with "), "b", F.lit(" ("), "b_build", F.lit(")"))
    facts = out.agg(
        F.count("*").alias("n"),
        F.bool_or("b_absent").alias("a_infer"),
        F.bool_or("a_absent").alias("b_infer"),
        F.bool_or(~differ).alias("same"),
        F.bool_or(differ).alias("lift"),
        F.bool_or(F.col("a_assay") == "array").alias("arrays"),
        (F.count_distinct("a") * F.count_distinct("b") <= F.count("*") * 4).alias("dense"),
        F.min(F.when(clash, names)).alias("clash"),
    ).first()
    if facts.clash:
        raise ValueError(f"cannot compare {facts.clash}: unknown build")
    flags = {k: bool(facts[k]) for k in ("a_infer", "b_infer", "same", "lift", "arrays", "dense")}
    return Plan(out.drop("a_assay", "b_assay"), facts.n <= BROADCAST_ROWS, n_pairs=facts.n, **flags)


def _in_region(region: tuple[str, int, int] | None) -> Column:
    if region is None:
        return F.lit(True)
    chrom, start, end = region
    return (F.col("chrom") == chrom) & F.col("pos").between(start, end)


def _single(ref: Column) -> Column:
    return F.when(F.length(ref) == 1, ref)


def _order(*place: Column) -> Column:
    """Order of records: of those at one place, or with the `place` they came from."""
    c = F.coalesce("contig_ord", F.lit(AFTER_PRIMARY)).alias("c")
    return F.struct(c, *place, F.col("end").alias("e"), F.col("src_ord").alias("s"))


def _ref_key(letter: Column | str) -> Column:
    """Key of an inferred reference genotype."""
    return snv_key(hom_ref_letters(letter), F.lit(HOM_REF))


def _need_letter(wanted: bool) -> Column:
    """Calls that may have to be judged against a letter they do not bring; lifting changes no length."""
    return F.coalesce(F.col("infer") & _single(F.col("ref")).isNull(), F.lit(False)) if wanted else F.lit(False)


def _with_reference(rows, coords, reference) -> DataFrame:
    """Calls that need a letter with the one known at their place."""
    return site_reference(rows, coords, reference, F.col("infer") & is_primary("chrom"), _single(F.col("ref")), "a_build", split=False)


def _with_own(rows) -> DataFrame:
    return rows.withColumn("site_ref", _single(F.col("ref")))


def _a_rows(calls, kits, plan: Plan, coords, reference, region) -> DataFrame:
    """Called A records with their order, key and the verdict against an inferred B.

    Records that need a letter part from the others before any join, so that each
    goes one way only.
    """
    who = plan.pairs.groupBy(F.col("a").alias("kit"), F.col("a_build")).agg(F.bool_or("b_absent").alias("infer"))
    rows = calls.filter(is_called() & ~F.col("ref_block") & _in_region(region)).select(*JUDGED).join(plan.hint(who), "kit")
    bare = _need_letter(plan.a_infer)
    branches = [_with_own(rows.filter(~bare))]
    if plan.a_infer:
        rest = rows.filter(bare)
        if plan.arrays:
            rest = enrich_arrays(rest, kits, coords, reference, split=False)
        branches.append(_with_reference(rest, coords, reference))
    rows = reduce(DataFrame.unionByName, branches).withColumn("at", _order())
    rows = rows.withColumn("key", snv_key("genotype", "zygosity"))
    return rows.select(
        "kit", "a_build", "chrom", "pos", "at", "key", "site_ref",
        verdict(F.col("key"), _ref_key("site_ref")).alias("inf"),
    )


def _need_chain(plan: Plan, blocks: DataFrame | None) -> None:
    """Raise where kits of different builds have no chain from the one's build to the other's."""
    wanted = plan.pairs.filter("a_build <> b_build").select(F.col("b_build").alias("from_build"), F.col("a_build").alias("to_build")).distinct()
    if blocks is not None:
        wanted = wanted.join(blocks.select("from_build", "to_build").distinct(), ["from_build", "to_build"], "left_anti")
    missing = wanted.first()  # at most one row per pair of builds
    if missing:
        raise ValueError(f"comparing these kits needs chain blocks from {missing.from_build} to {missing.to_build}")


def _b_rows(calls, plan: Plan, blocks, coords, reference, region) -> DataFrame:
    """Called B records in A's build; rows that do not lift have a null chrom.

    Records that need a letter part from the others before they are lifted, so
    that each is lifted once.
    """
    who = plan.pairs.groupBy(F.col("b").alias("kit"), "b_build", "a_build").agg(F.bool_or("a_absent").alias("infer"))
    rows = calls.filter(is_called() & ~F.col("ref_block")).select(*JUDGED).join(plan.hint(who), "kit")
    rows = rows.withColumn("at", _order(F.col("chrom").alias("name"), F.col("pos").alias("p")))
    differ = F.col("a_build") != F.col("b_build")
    if plan.lift:
        _need_chain(plan, blocks)

    def moved(rows: DataFrame) -> DataFrame:
        branches = []
        if plan.same:
            near = rows.filter(~differ) if plan.lift else rows
            branches.append(near.withColumn("turned", F.lit(False)))
        if plan.lift:
            far = rows.filter(differ) if plan.same else rows
            far = lift_best(far, blocks, F.col("b_build"), F.col("a_build"))
            branches.append(apply_lift(far.withColumn("turned", F.col("reverse"))))
        return reduce(DataFrame.unionByName, branches).filter(F.col("chrom").isNull() | _in_region(region))

    bare = _need_letter(plan.b_infer)
    branches = [_with_own(moved(rows.filter(~bare)))]
    if plan.b_infer:
        branches.append(_with_reference(moved(rows.filter(bare)), coords, reference))
    rows = reduce(DataFrame.unionByName, branches)
    rows = rows.withColumn("key", snv_key("genotype", "zygosity"))
    return rows.select(
        "kit", "a_build", "chrom", "pos", "at", "key", "site_ref", "turned",
        verdict(_ref_key("site_ref"), F.col("key")).alias("inf"),
    )


def _reduced(a_rows: DataFrame, b_rows: DataFrame, detail: bool) -> tuple[DataFrame, DataFrame]:
    """Each side once per (kit, build, place): A with its first record and sums, B with its last record.

    Map-side aggregates make a crowded place cost one row.  The results are narrow
    tables of kits and places, whatever the number of pairs, and are written, since
    totals and matches both read them.  `detail` keeps what a listing needs.
    """
    more = ["at", "site_ref"] if detail else []
    a = a_rows.groupBy("kit", "a_build", "chrom", "pos").agg(
        F.min_by(F.struct("key", "inf", *more), "at").alias("r"),
        F.count("*").alias("n"),
        F.count_if(F.col("inf") == CONCORDANT).alias("conc"),
        F.count_if(F.col("inf") == DISCORDANT).alias("disc"),
    )
    more += ["turned"] if detail else []
    b = b_rows.groupBy("kit", "a_build", "chrom", "pos").agg(F.max_by(F.struct("key", "inf", *more), "at").alias("r"), F.count("*").alias("n"))
    a = a.select(F.col("kit").alias("a"), "a_build", "chrom", "pos", "r.*", "n", "conc", "disc")
    return written(a), written(b.select(F.col("kit").alias("b"), "a_build", "chrom", "pos", "r.*", "n"))


def _matched(a: DataFrame, b: DataFrame, plan: Plan) -> DataFrame:
    """(a, b, chrom, pos, x, y): places where both kits of a pair have records; x and y are the two rows.

    Where most kits meet most others, places are joined once and the combinations
    at a place are cut down to pairs; few pairs are spread over A's rows instead.
    """
    pairs = plan.pairs.select("a", "b", "a_build")
    place = ["a_build", "chrom", "pos"]
    x = a.select("a", *place, F.struct(*[c for c in a.columns if c not in ("a", *place)]).alias("x"))
    y = b.select("b", *place, F.struct(*[c for c in b.columns if c not in ("b", *place)]).alias("y"))
    if plan.dense:
        return x.join(y, place).join(plan.hint(pairs), ["a", "b", "a_build"]).select(*SITE, "x", "y")
    return x.join(plan.hint(pairs), ["a", "a_build"]).join(y, ["b", *place]).select(*SITE, "x", "y")


def _tally(a: DataFrame, b: DataFrame, plan: Plan) -> DataFrame:
    """Counts per pair: matches are counted, and what a kit has beside its matches is its total less the matched part."""
    primary = is_primary("chrom")
    met = verdict(F.col("x.key"), F.col("y.key"))
    names = {CONCORDANT: "conc", DISCORDANT: "disc", SKIPPED: "skip"}
    counts = [F.count_if(met == v).alias(f"met_{n}") for v, n in names.items()]
    counts += [F.count_if(primary & (F.col(f"{side}.inf") == v)).alias(f"{side}_{n}") for side in "xy" for v, n in names.items()]
    matched = _matched(a, b, plan).groupBy("a", "b").agg(*counts)
    a_total = a.filter(primary).groupBy("a").agg(F.sum("n").alias("a_n"), F.sum("conc").alias("a_conc"), F.sum("disc").alias("a_disc"))
    b_total = b.groupBy("b", "a_build").agg(
        F.sum(F.when(F.col("chrom").isNull(), F.col("n"))).alias("unlifted_sites"),
        *[F.count_if(primary & (F.col("inf") == v)).alias(f"b_{n}") for v, n in names.items()],
    )
    out = plan.pairs.join(a_total, "a", "left").join(b_total, ["b", "a_build"], "left").join(matched, ["a", "b"], "left")
    n = {c: F.coalesce(c, F.lit(0)) for c in out.columns if c not in plan.pairs.columns}

    def left(total: str, *matched: str) -> Column:
        """A's records that no B record answered, judged against B's implied reference."""
        return F.when(F.col("b_absent"), reduce(lambda x, c: x - n[c], matched, n[total])).otherwise(F.lit(0))

    def only_b(kind: str) -> Column:
        return F.when(F.col("a_absent"), n[f"b_{kind}"] - n[f"y_{kind}"]).otherwise(F.lit(0))

    left_n, left_conc, left_disc = left("a_n", "x_conc", "x_disc", "x_skip"), left("a_conc", "x_conc"), left("a_disc", "x_disc")
    sums = {
        "concordant": n["met_conc"] + left_conc + only_b("conc"),
        "discordant": n["met_disc"] + left_disc + only_b("disc"),
        "inferred_ref_sites": left_n + only_b("conc") + only_b("disc") + only_b("skip"),
        "skipped_sites": n["met_skip"] + left_n - left_conc - left_disc + only_b("skip"),
        "unlifted_sites": n["unlifted_sites"],
    }
    out = out.select(
        "a", "b", F.col("a_build").alias("build"), (F.col("a_build") != F.col("b_build")).alias("lifted"),
        *[c.cast("bigint").alias(name) for name, c in sums.items()],
    )
    overlap = F.col("concordant") + F.col("discordant")
    ratio = F.when(overlap > 0, round_places(F.col("concordant") / overlap, 6)).otherwise(F.lit(0.0))
    return out.withColumns({"overlap": overlap, "concordance": ratio})


def compare_tallies(
    calls, kits, pairs, chain_blocks=None, coords=None, reference=None, region: tuple[str, int, int] | None = None
) -> DataFrame:
    """One row of concordance counts per pair (a, b), in A's build."""
    plan = describe_pairs(pairs, kits)
    a = _a_rows(calls, kits, plan, coords, reference, region)
    b = _b_rows(calls, plan, chain_blocks, coords, reference, region)
    return _tally(*_reduced(a, b, detail=False), plan)


def _picks(a: DataFrame, b: DataFrame, a_rows: DataFrame, plan: Plan) -> DataFrame:
    """(a, b, chrom, pos, b_side, c, e, s, met, letter) of every discordant site: among matches, of A alone, of B alone.

    c, e and s are the rest of its order and, with the place, name A's record; b_side
    marks sites of B alone, met those that have B's record of the place.
    """
    order = [F.col("at.c").alias("c"), F.col("at.e").alias("e"), F.col("at.s").alias("s")]
    met = _matched(a, b, plan).filter(verdict(F.col("x.key"), F.col("y.key")) == DISCORDANT)
    met = met.select(*SITE, F.col("x.at").alias("at"), F.col("x.site_ref").alias("letter"))
    met = met.select(*SITE, F.lit(False).alias("b_side"), *order, F.lit(True).alias("met"), "letter")
    # Only records that disagree with the implied reference are spread over pairs.
    pairs = plan.pairs.select("a", "b", "a_build", "a_absent", "b_absent")
    wrong = is_primary("chrom") & (F.col("inf") == DISCORDANT)
    of_a = F.lit(False).alias("b_side"), *order, F.lit(False).alias("met"), F.col("site_ref").alias("letter")
    alone = a.filter(wrong).join(plan.hint(pairs.filter("b_absent")), ["a", "a_build"])
    alone = alone.join(b.select("b", "a_build", "chrom", "pos"), ["b", "a_build", "chrom", "pos"], "left_anti").select(*SITE, *of_a)
    only = b.filter(wrong).select("b", "a_build", "chrom", "pos").join(plan.hint(pairs.filter("a_absent")), ["b", "a_build"])
    only = only.join(a.select("a", "a_build", "chrom", "pos"), ["a", "a_build", "chrom", "pos"], "left_anti")
    only = only.select(
        *SITE, F.lit(True).alias("b_side"), F.coalesce(contig_ord("chrom"), F.lit(AFTER_PRIMARY)).alias("c"), F.col("pos").alias("e"),
        F.lit(0).cast("bigint").alias("s"), F.lit(True).alias("met"), F.lit(None).cast("string").alias("letter"),
    )
    picks = met.unionByName(alone).unionByName(only)
    # Records of A beyond the first at their place are not answered by B.
    repeated = a.filter("n > 1").select("a", "a_build", "chrom", "pos", F.col("at").alias("first_at"))
    if repeated.isEmpty():
        return picks
    later = a_rows.filter(wrong).withColumnRenamed("kit", "a").join(repeated, ["a", "a_build", "chrom", "pos"]).filter(F.col("at") != F.col("first_at"))
    return picks.unionByName(later.join(plan.hint(pairs.filter("b_absent")), ["a", "a_build"]).select(*SITE, *of_a))


def _with_b(picks: DataFrame, b: DataFrame, plan: Plan, few: bool) -> DataFrame:
    """Listed sites with both builds, and b_at, letter and turned of B's record of their place, where they have one."""
    if few:
        picks = written(picks)  # at most cap rows per pair
    picks = picks.join(plan.hint(plan.pairs.select("a", "b", "a_build", "b_build")), ["a", "b"])
    place = ["b", "a_build", "chrom", "pos"]
    same = [F.col(f"p.{c}").eqNullSafe(F.col(f"r.{c}")) for c in place]
    wanted = picks.filter("met").select(*place).distinct()
    there = b.alias("r").join((F.broadcast(wanted) if few else wanted).alias("p"), same, "left_semi")
    there = there.select(*place, F.col("at").alias("b_at"), F.col("site_ref").alias("_letter"), "turned")
    there = F.broadcast(there) if few else there
    out = picks.alias("p").join(there.alias("r"), [*same, F.col("p.met")], "left").select("p.*", "b_at", "_letter", "turned")
    return out.withColumn("letter", F.coalesce("letter", "_letter")).drop("_letter")


def discordant_sites(
    calls, kits, pairs, chain_blocks=None, coords=None, reference=None,
    region: tuple[str, int, int] | None = None, max_discordant: int | None = MAX_DISCORDANT,
) -> DataFrame:
    """Discordant sites per pair, A's sites first in coordinate order, then B-only sites.

    Sites are found and ranked on narrow rows (the per-pair cap is a top-k report
    whose filter runs before the shuffle); only the listed ones fetch their calls.
    """
    plan = describe_pairs(pairs, kits)
    a_rows = written(_a_rows(calls, kits, plan, coords, reference, region))  # narrow, and read again for records beyond a place's first
    a, b = _reduced(a_rows, _b_rows(calls, plan, chain_blocks, coords, reference, region), detail=True)
    picks = _picks(a, b, a_rows, plan)
    order = ["b_side", "c", "chrom", "pos", "e", "s"]
    if max_discordant is None:
        # A whole list is ranked over a range sort; a pair's numbers begin at its first place.
        ranked = rank_rows(picks, ["a", "b", *order])
        begins = ranked.groupBy("a", "b").agg(F.min("row_no").alias("_first"))
        picks = ranked.join(plan.hint(begins), ["a", "b"]).withColumn("n", (F.col("row_no") - F.col("_first") + 1).cast("int")).drop("row_no", "_first")
    else:
        rank = F.row_number().over(W.partitionBy("a", "b").orderBy(*order))
        picks = picks.withColumn("n", rank).filter(F.col("n") <= max_discordant)
    few = max_discordant is not None and plan.n_pairs * max_discordant <= BROADCAST_ROWS
    return _with_calls(_with_b(picks, b, plan, few), calls, kits, coords, reference, few)


def _with_calls(picks: DataFrame, calls, kits, coords, reference, few: bool) -> DataFrame:
    """Listed sites with both genotypes as structs; absent sides are implied by the reference."""

    def fetch(side: str, wanted: DataFrame) -> DataFrame:
        keys = wanted.select(
            F.col(side).alias("kit"), F.col(f"{side}_at.name").alias("chrom"), F.col(f"{side}_at.p").alias("pos"),
            F.col(f"{side}_at.e").alias("end"), F.col(f"{side}_at.s").alias("src_ord"),
        ).filter("src_ord is not null").distinct()
        near = near_sites(calls, keys) if few else calls
        return near.join(F.broadcast(keys) if few else keys, keys.columns, "left_semi")

    a_at = F.struct("c", F.col("chrom").alias("name"), F.col("pos").alias("p"), "e", "s")
    picks = picks.withColumn("a_at", F.when(~F.col("b_side"), a_at))
    if few:
        picks = written(picks)  # at most cap rows per pair, read three times
    key = ["kit", "chrom", "pos", "end", "src_ord"]
    a = enrich_arrays(fetch("a", picks), kits, coords, reference, split=not few)
    out = picks
    for side, rows in (("a", a), ("b", fetch("b", picks))):
        r = rows.select(
            F.struct(*[F.col(k) for k in key]).alias(f"_{side}_key"),
            F.struct(*[F.col(c) for c in DETAIL]).alias(f"_{side}"),
        )
        at = F.struct(
            F.col(side).alias("kit"), F.col(f"{side}_at.name").alias("chrom"), F.col(f"{side}_at.p").alias("pos"),
            F.col(f"{side}_at.e").alias("end"), F.col(f"{side}_at.s").alias("src_ord"),
        )
        out = out.withColumn(f"_{side}_key", F.when(F.col(f"{side}_at").isNotNull(), at)).join(r, f"_{side}_key", "left")

    def moved(c: Column) -> Column:
        return lifted(c, F.col("turned"))

    fields = {c: F.col(f"_b.{c}") for c in DETAIL}
    fields |= {"ref": moved(fields["ref"]), "genotype": moved(fields["genotype"]), "alt": lifted_alts(fields["alt"], F.col("turned"))}
    b_call = F.struct(*[fields[c].alias(c) for c in DETAIL])

    def implied(rsid: str) -> Column:
        r = F.col("letter")
        none = {
            "rsid": F.col(rsid), "ref": r, "alt": F.array().cast("array<string>"), "genotype": hom_ref_letters(r),
            "zygosity": F.lit(HOM_REF), "filter": F.lit(None).cast("string"), "quality": F.lit(None).cast("float"),
            "depth": F.lit(None).cast("bigint"),
        }
        return F.struct(*[none[c].alias(c) for c in DETAIL])

    has_a, has_b = F.col("a_at").isNotNull(), F.col("b_at").isNotNull()
    origin = F.struct(F.col("b_build").alias("build"), F.col("b_at.p").alias("pos"))
    return out.select(
        *SITE, "n",
        F.coalesce("_a.rsid", "_b.rsid").alias("rsid"),
        F.when(has_a, F.col("_a")).otherwise(implied("_b.rsid")).alias("call_a"),
        F.when(has_a, F.lit(OBSERVED)).otherwise(F.lit(INFERRED_REF)).alias("source_a"),
        F.when(has_b, b_call).otherwise(implied("_a.rsid")).alias("call_b"),
        F.when(has_b, F.lit(OBSERVED)).otherwise(F.lit(INFERRED_REF)).alias("source_b"),
        F.when(has_b & (F.col("a_build") != F.col("b_build")), origin).cast(LIFT_TYPE).alias("lifted_from_b"),
    )


def compare_warnings(tallies: DataFrame, max_discordant: int = MAX_DISCORDANT) -> DataFrame:
    """(a, b, warnings) for a tally table."""
    n = {c: F.col(c).cast("string") for c in ("unlifted_sites", "skipped_sites", "discordant")}
    texts = [
        F.when(F.col("lifted"), F.concat("b", F.lit(" was compared at its places in "), "build")),
        F.when(F.col("unlifted_sites") > 0, F.concat(n["unlifted_sites"], F.lit(" calls of "), "b", F.lit(" have no place in the other build"))),
        F.when(F.col("inferred_ref_sites") > 0, F.lit(INFERRED_WARNING)),
        F.when(
            F.col("skipped_sites") > 0,
            F.concat(n["skipped_sites"], F.lit(" shared sites left out: I/D codes, or no reference letter")),
        ),
        F.when(
            F.col("discordant") > max_discordant,
            F.concat(F.lit(f"the first {max_discordant} discordant sites are listed, of "), n["discordant"]),
        ),
    ]
    return tallies.select("a", "b", F.array_compact(F.array(*texts)).alias("warnings"))


def compare(
    calls, kits, pairs, chain_blocks=None, coords=None, reference=None, region=None, max_discordant=MAX_DISCORDANT
) -> tuple[DataFrame, DataFrame]:
    """(tallies per pair, capped discordant sites)."""
    args = (calls, kits, pairs, chain_blocks, coords, reference, region)
    return compare_tallies(*args), discordant_sites(*args, max_discordant)
