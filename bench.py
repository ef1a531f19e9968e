"""Headline timings: prints one JSON line.

Each query runs over its whole tables with a noop sink; a small warm-up query
takes the JVM start out of the first number.
"""

from __future__ import annotations

import json
import os
import shutil
import sys
import tempfile
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from zygospark.plans import derived as D  # noqa: E402
from zygospark.plans import parsing  # noqa: E402
from zygospark.plans.queries import QUERIES  # noqa: E402
from zygospark.session import local_session, small_table  # noqa: E402
from zygospark.sources import importer  # noqa: E402
from zygospark.store_api import KitStore  # noqa: E402

COPIES = 4  # the import reads this many copies of every file, as kits of their own

HEADLINE = [
    "q_summary_zygosity",
    "q_summary_by_chrom",
    "q_sex_inference",
    "q_parse_vcf_lines",
    "q_parse_array_lines",
    "q_dbsnp_import",
    "q_liftover_best",
    "q_liftover_all",
    "q_enrich_array",
    "q_reference_base",
    "q_lookup_exact",
    "q_lookup_spanning",
    "q_lookup_rsid",
    "q_lookup_crossbuild",
    "q_compare_same_build",
    "q_compare_lifted",
    "q_compare_all_pairs",
    "q_discordant_capped",
    "q_export_vcf_lines",
    "q_export_page",
    "q_fastq_pairs",
    "q_audit_verify",
]


def timed(run) -> float:
    start = time.time()
    run()
    return round(time.time() - start, 3)


def import_rate(spark, sf: str) -> dict[str, float]:
    """Import of the derived VCF text as one file per kit: parse, sort, write, summarise."""
    base = tempfile.mkdtemp(prefix="zygospark-bench-")
    head = "##fileformat=VCFv4.2\n##contig=<ID=chr1,length=248956422>\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tS1\n"
    lines = parsing.vcf_text(spark, sf)
    files = []
    for kit in ("k2", "k3", "k4"):
        lines.filter(lines.file == kit).select("value").coalesce(1).write.text(f"{base}/{kit}")
        (part,) = Path(f"{base}/{kit}").glob("part-*")
        path = f"{base}/{kit}.vcf"
        with open(part) as body, open(path, "w") as out:
            out.write(head)
            shutil.copyfileobj(body, out)
        files.append(path)
        for copy in range(1, COPIES):
            shutil.copy(path, f"{base}/{kit}-{copy}.vcf")
            files.append(f"{base}/{kit}-{copy}.vcf")
    records = lines.count() * COPIES
    took = timed(lambda: importer.import_files(spark, f"{base}/store", files).collect())
    kits = KitStore(spark, f"{base}/store")
    ids = [r.rsid for r in kits.calls_by_rsid().select("rsid").distinct().orderBy("rsid").limit(10).collect()]
    kit = kits.kits().orderBy("seq").first().id
    asked = small_table(spark, [(i, kit, i, None, None, None) for i in ids], "qid string, kit string, rsid string, chrom string, pos bigint, build string")
    return {
        "import_vcf": took,
        "lookup_10_ids_stored": timed(lambda: kits.lookup(asked).collect()),
        "summaries_stored": timed(lambda: kits.summaries().collect()),
        "import_vcf_records_per_sec": round(records / took),
    }


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "bench")
    spark.sparkContext.setLogLevel("OFF")
    D.calls(spark, sf).write.format("noop").mode("overwrite").save()
    wanted = sys.argv[1:] or HEADLINE
    seconds = {}
    for name in wanted:
        if name in QUERIES:
            seconds[name] = timed(lambda: QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save())
    extra = import_rate(spark, sf) if "import" in wanted or not sys.argv[1:] else {}
    seconds |= {k: v for k, v in extra.items() if not k.endswith("_per_sec")}
    result = {
        "metric": "headline queries, total wall time",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": Path(sf).name,
        "import_vcf_records_per_sec": extra.get("import_vcf_records_per_sec"),
    }
    print(json.dumps(result))
    spark.stop()


if __name__ == "__main__":
    main()
