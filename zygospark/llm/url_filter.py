"""URL filter: rules by host and path, and boosted trees on lexical features for the rest."""

from __future__ import annotations

import string

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from zygospark.llm.rows import written
from zygospark.session import checked_broadcast

#: rule (host/path) -> verdict; fixed values of the query's contract
RULES = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}
FIT_ROWS = 20_000  # labelled URLs that the trees are fitted on at most: those with the smallest hash
TREES, DEPTH, SEED = 8, 4, 7
SMOOTH = 5.0  # rows of the overall share that every suffix starts with
SUFFIXES = ("suffix1", "suffix2")  # the last label of the host, and the last two
LEXICAL = ["length", "host_length", "path_length", "host_depth", "path_depth", "digit_ratio", "hyphen_ratio", "entropy", "parameters", "fragment"]


def host_of(url: Column) -> Column:
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, string.ascii_uppercase, string.ascii_lowercase), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: dict[str, str] = RULES) -> Column:
    """The longest rule whose host is the URL's host or a parent of it and whose path begins the URL's path."""
    out = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r), r)):  # the longest is asked first
        own, slash, rest = rule.partition("/")
        fits = ((host == own) | host.endswith("." + own)) & path.startswith(slash + rest)
        out = F.when(fits, F.lit(rule)).otherwise(out)
    return out


def verdict_of(rule: Column, rules: dict[str, str] = RULES) -> Column:
    out = F.lit(None).cast("string")
    for name, verdict in rules.items():
        out = F.when(rule == name, F.lit(verdict)).otherwise(out)
    return out


def _share(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)) / F.greatest(F.length(text), F.lit(1))


def _entropy(text: Column) -> Column:
    """Bits per character."""
    n = F.length(text)
    chars = F.transform(F.sequence(F.lit(1), n), lambda i: F.substring(text, i, F.lit(1)))
    shares = F.transform(F.array_distinct(chars), lambda c: F.size(F.filter(chars, lambda x: x == c)) / n)
    return F.when(n > 0, F.aggregate(shares, F.lit(0.0), lambda s, p: s - p * F.log2(p))).otherwise(0.0)


def with_features(pages: DataFrame) -> DataFrame:
    """Lexical features beside page_id, url, host and path; a null url counts as empty."""
    url = F.coalesce(F.col("url").cast("string"), F.lit(""))
    base = pages.select(F.col("page_id").cast("long").alias("page_id"), url.alias("url"), host_of(url).alias("host"), path_of(url).alias("path"))
    labels = F.split("host", r"\.")
    query = F.regexp_extract("url", r"(?s)^[^?#]*\?([^#]*)", 1)
    features = {
        "length": F.length("url"),
        "host_length": F.length("host"),
        "path_length": F.length("path"),
        "host_depth": F.size(labels),
        "path_depth": F.regexp_count("path", F.lit("/+[^/]")),
        "digit_ratio": _share(F.col("url"), "[0-9]"),
        "hyphen_ratio": _share(F.col("url"), "[-_]"),
        "entropy": _entropy(F.col("url")),
        "parameters": F.when(query == "", 0).otherwise(F.regexp_count(query, F.lit("&")) + 1),
        "fragment": F.col("url").contains("#"),
    }
    suffixes = {f"suffix{k}": F.array_join(F.slice(labels, F.greatest(F.size(labels) - (k - 1), F.lit(1)), k), ".") for k in (1, 2)}
    return base.select("*", *(v.cast("double").alias(k) for k, v in features.items()), *(v.alias(k) for k, v in suffixes.items()))


def judge_urls(pages: DataFrame, rules: dict[str, str] = RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict, blocked_by_trees) of every row of pages.

    The host follows the first `://` up to `/`, `?`, `#` or the end, A-Z
    lower-cased; the path goes on to `?`, `#` or the end.  A rule fits its host
    and all subdomains where the path begins with the rule's; the longest wins.
    URLs that no rule fits get the verdict of gradient-boosted trees on length,
    depth, digit and hyphen ratio, entropy, parameters and the smoothed block
    shares of the host's last label and last two labels.  URLs that a rule
    judges are the labelled ones; suffix shares use all of them, the trees at
    most FIT_ROWS.

    DataFrame expressions and the library's boosted trees only.  A hot suffix
    is partial sums, then one row of a small table.  Null urls and those
    without `://` have empty host and path and are judged by the trees.
    Without labelled URLs of both kinds the trees' verdict is the only kind
    seen, or allow.  Repeated rows are judged alike.
    """
    rows = with_features(pages)
    rule = rule_of(F.col("host"), F.col("path"), rules)
    rows = written(rows.withColumn("rule", rule).withColumn("label", (verdict_of(F.col("rule"), rules) == "block").cast("double")))
    labelled = rows.filter("label is not null")
    n, blocked = labelled.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0.0))).first()
    share = blocked / n if n else 0.0
    for c in SUFFIXES:
        known = labelled.groupBy(c).agg(((F.sum("label") + SMOOTH * share) / (F.count("*") + SMOOTH)).alias(f"{c}_share"), F.log1p(F.count("*")).alias(f"{c}_rows"))
        rows = rows.join(checked_broadcast(written(known), 100_000), c, "left").fillna({f"{c}_share": share, f"{c}_rows": 0.0})
    if 0 < blocked < n:
        inputs = [*LEXICAL, *(f"{c}_{x}" for c in SUFFIXES for x in ("share", "rows"))]
        assembler = VectorAssembler(inputCols=inputs, outputCol="features", handleInvalid="keep")
        chosen = written(rows.filter("label is not null").orderBy(F.xxhash64("url", "page_id"), "page_id").limit(FIT_ROWS).select("label", *inputs))
        trees = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, seed=SEED, labelCol="label", featuresCol="features", cacheNodeIds=False)
        model = trees.fit(assembler.transform(chosen))
        rows = model.transform(assembler.transform(rows)).withColumn("blocked_by_trees", F.col("prediction") > 0.5)
    else:
        rows = rows.withColumn("blocked_by_trees", F.lit(bool(n and blocked == n)))
    guess = F.when(F.col("blocked_by_trees"), "block").otherwise("allow")
    return rows.select("page_id", "host", "path", "rule", F.coalesce(verdict_of(F.col("rule"), rules), guess).alias("verdict"), "blocked_by_trees")
