import re

from zygospark.sources import fastq

SCHEMA = "file string, block long, ord long, value string"


def test_reads_are_not_dealt_by_file(spark, capsys):
    """A lane is two files, so no exchange of lines may go by the file alone."""
    rows = []
    for side in (1, 2):
        for read in range(8):
            record = (f"@r{read}/{side}", "ACGT", "+", "IIII")
            rows += [(f"/d/NA_S1_L001_R{side}_001.fastq.gz", read // 2, read % 2 * 4 + i, v) for i, v in enumerate(record)]
    rows.append(("/d/other.fastq", 0, 0, "@x"))
    lines = spark.createDataFrame(rows, SCHEMA)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = fastq.read_pairs(lines, fastq.lane_manifest(lines.select("file")))
        out.explain(mode="formatted")
        plan = capsys.readouterr().out
        got = sorted((r.lane, r.pair, r.r1_name, r.r2_name, r.problem) for r in out.collect())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert got == [("L001", i, f"@r{i}/1", f"@r{i}/2", None) for i in range(8)]
    exchanges = re.findall(r"Exchange\nInput \[\d+\]: \[(.*)\]\nArguments: hashpartitioning\((.*?), \d+\)", plan)
    assert exchanges and not [x for x in exchanges if "value#" in x[0] and re.fullmatch(r"file#\d+", x[1])]
