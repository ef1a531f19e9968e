"""A kit store as its users see it: import, lookup, compare and export, each noted in the audit log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from zygospark.operators import catalog, compare, export, lookup
from zygospark.operators.rsids import CoordTables
from zygospark.session import small_table, written
from zygospark.sinks import audit_log, store
from zygospark.sinks import export as sink
from zygospark.sources import importer


class KitStore:
    """The tables under one root folder.

    Queries take the stored access paths: calls sorted by place and by id, and the
    first-per-key coordinate tables.  Answers are run once and counted on the way.
    """

    def __init__(self, spark: SparkSession, root: str, user: str | None = None):
        self.spark, self.root, self.user = spark, root, user

    def calls(self, kits: list[str] | None = None) -> DataFrame:
        return store.read_calls(self.spark, f"{self.root}/calls", kits)

    def calls_by_rsid(self) -> DataFrame | None:
        path = f"{self.root}/calls_by_rsid"
        return store.read_calls_by_rsid(self.spark, path) if store.exists(self.spark, path) else None

    def kits(self) -> DataFrame:
        return store.read_kits(self.spark, f"{self.root}/kits")

    def coords(self) -> CoordTables | None:
        path = f"{self.root}/coords"
        return store.read_coord_tables(self.spark, path) if store.exists(self.spark, path) else None

    def summaries(self) -> DataFrame:
        return importer.stored_summaries(self.spark, self.root)

    def audit(self) -> DataFrame:
        return audit_log.read_audit(self.spark, self.root)

    def import_files(self, paths: list[str], options: importer.Options | None = None, replace: bool | str = False) -> DataFrame:
        return importer.import_files(self.spark, self.root, paths, options, replace)

    def kit(self, key: str):
        """Catalog row of a kit by id or name."""
        found = catalog.find_kits(self.kits(), small_table(self.spark, [(key,)], "key string")).first()
        if found is None:
            raise KeyError(f"no kit '{key}'")
        return found

    def lookup(self, queries: DataFrame, chain_blocks: DataFrame | None = None, reference: DataFrame | None = None, max_lookback: int | None = None) -> DataFrame:
        """Answers of rsid and position queries (qid, kit, rsid, chrom, pos, build)."""
        answers = lookup.lookup(self.calls(), self.kits(), queries, self.coords(), chain_blocks, reference, max_lookback, self.calls_by_rsid())
        return audit_log.audited_lookup(self.spark, self.root, answers, self.user)

    def compare(self, pairs: DataFrame, chain_blocks: DataFrame | None = None, reference: DataFrame | None = None, region=None, max_discordant: int | None = compare.MAX_DISCORDANT) -> tuple[DataFrame, DataFrame]:
        """(tallies, discordant sites) of kit pairs (a, b)."""
        tallies, sites = compare.compare(self.calls(), self.kits(), pairs, chain_blocks, self.coords(), reference, region, max_discordant)
        return audit_log.audited_compare(self.spark, self.root, tallies, self.user), sites

    def export_vcf(
        self, key: str, path: str, regions: DataFrame | None = None, offset: int = 0, limit: int | None = None, reference: DataFrame | None = None
    ) -> str | None:
        """Write a kit as VCF parts, array calls enriched; returns a note on calls that were left out."""
        kit = self.kit(key)
        calls = written(export.export_calls(self.calls([kit.id]), regions, offset, limit, self.kits(), self.coords(), reference))
        skipped = sink.write_vcf(calls, path, kit.build, kit.id, kit.source_format, kit.sample)
        details = {"kit": kit.id, "records": calls.agg(F.count(F.lit(1))).first()[0], "skipped": skipped}
        audit_log.append_audit(self.spark, self.root, "export", details, self.user)
        return sink.skipped_note(skipped)
