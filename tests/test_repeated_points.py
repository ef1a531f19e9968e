"""Hits of a call that is listed twice."""

from zygospark.plans import sites
from zygospark.plans.derived import calls

SMOKE = "/root/testdata/sf0.001"


def test_hits_of_a_repeated_call_keep_their_numbers(spark, monkeypatch):
    points = calls(spark, SMOKE).select("kit", "src_ord", "chrom", "pos").limit(500).cache()

    def numbered(p):
        monkeypatch.setattr(sites, "_points", lambda *_: p)
        return sorted(tuple(r) for r in sites.liftover_all(spark, SMOKE).collect())

    once = numbered(points)
    assert numbered(points.unionByName(points)) == sorted(once + once) and once
