"""URL filters: host-suffix / path-prefix expressions, looked up by short hash prefix and confirmed by full digest.

Every URL is expanded into the combinations of its host suffixes and path prefixes that a rule could name. Expressions
are equi-joined to the rules on the first four bytes of their SHA-256; equal full digests confirm a hit, and the longest
rule that fits decides. DataFrame operations only.

Defined cases: a null URL or one without ``://`` has an empty host and path, fits no rule and gets ``default``; repeated
rows each keep their own result row; no pages give no rows; no rules give ``default`` everywhere; columns other than
``page_id`` and ``url`` are ignored whatever their names; host labels and paths may be of any length.
"""

from __future__ import annotations

import string

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.storage import materialise

#: The rules of the contract: verdict, host, path.
RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]
#: Tables of up to this many rows and characters, counted first, are broadcast; larger ones are joined by shuffle.
BROADCAST_RULES, BROADCAST_SIZE = 50_000, 8_000_000


def rules_frame(spark: SparkSession, rules=None) -> DataFrame:
    """``(verdict, host, path)`` triples as a rule table."""
    return spark.createDataFrame(RULES if rules is None else rules, "verdict string, host string, path string")


def _digest(host, path):
    # A host cannot hold a slash, so the joined string is unambiguous.
    return F.sha2(F.concat(host, F.when(F.startswith(path, F.lit("/")), F.lit("")).otherwise(F.lit("/?")), path), 256)


def parse_urls(pages: DataFrame) -> DataFrame:
    """``page_id, host, path`` of every row; A-Z of the host are lower-cased, nothing else is changed."""
    part = lambda i: F.coalesce(F.regexp_extract("url", r"(?s)^.*?://([^/?#]*)([^?#]*)", i), F.lit(""))
    return pages.select("page_id", F.translate(part(1), string.ascii_uppercase, string.ascii_lowercase).alias("host"), part(2).alias("path"))


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """``page_id, host, path, rule, verdict`` for every row of ``pages``; ``rules`` has ``verdict, host, path``.

    Equal rules with different verdicts: ``block`` wins.
    """
    rules = rules.filter("host is not null and path is not null").groupBy("host", "path").agg(F.max(F.struct((F.col("verdict") == "block").alias("blocks"), "verdict"))["verdict"].alias("verdict"))
    shape = rules.agg(F.coalesce(F.max(F.size(F.split("host", r"\."))), F.lit(0)).alias("labels"), F.sort_array(F.collect_set(F.length("path"))).alias("lengths"), F.count("*").alias("n")).first()
    parsed = parse_urls(pages)
    if not shape["n"]:
        return parsed.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(default)})
    # Only so much of a path as the longest rule path can matter: fewer distinct keys.
    parsed = parsed.withColumn("head", F.substring("path", 1, max(shape["lengths"] or [0])))
    keys = parsed.filter("host <> ''").select("host", "head").distinct()
    labels = F.split("host", r"\.")
    n = F.size(labels)
    suffixes = F.transform(F.sequence(F.greatest(n - shape["labels"] + 1, F.lit(1)), n), lambda i: F.array_join(F.slice(labels, i, n - i + 1), "."))
    prefixes = F.transform(F.filter(F.array(*map(F.lit, shape["lengths"])), lambda x: x <= F.length("head")), lambda x: F.substring("head", F.lit(1), x))
    expressions = keys.select("host", "head", F.explode(suffixes).alias("suffix"), prefixes.alias("prefixes")).select("host", "head", "suffix", F.explode("prefixes").alias("prefix"))
    expressions = expressions.select("host", "head", _digest(F.col("suffix"), F.col("prefix")).alias("digest")).withColumn("short", F.substring("digest", 1, 8))
    listed = rules.select("verdict", F.concat("host", "path").alias("rule"), F.length("host").alias("host_length"), _digest(F.col("host"), F.col("path")).alias("full")).withColumn("short", F.substring("full", 1, 8))
    if shape["n"] <= BROADCAST_RULES:
        listed = F.broadcast(listed)
    hits = expressions.join(listed, "short").filter("digest = full")
    best = hits.groupBy("host", "head").agg(F.max(F.struct(F.length("rule").alias("n"), "host_length", "rule", "verdict")).alias("best"))
    best = materialise(best.select(F.col("host").alias("k_host"), F.col("head").alias("k_head"), "best"), "url-hits")
    # A written table: a join with a host that very many pages share can be split, unless the hits are few anyway.
    held = best.agg(F.coalesce(F.sum(F.length("k_host") + F.length("k_head") + F.length("best.rule")), F.lit(0)).alias("size"), F.count("*").alias("n")).first()
    if held["n"] <= BROADCAST_RULES and held["size"] <= BROADCAST_SIZE:
        best = F.broadcast(best)
    joined = parsed.join(best, (F.col("host") == F.col("k_host")) & (F.col("head") == F.col("k_head")), "left")
    return joined.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))


def op9_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"), rules_frame(spark))


_FIT = lambda host, path: f"((host = '{host}' OR suffix(host, '.{host}')) AND starts_with(path, '{path}'))"
_CASES = sorted(RULES, key=lambda r: -len(r[1] + r[2]))

ORACLE_SQL = f"""
WITH rest AS (
    SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), parsed AS (
    SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{string.ascii_uppercase}', '{string.ascii_lowercase}') AS host,
           regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
    FROM rest
)
SELECT page_id, host, path,
       CASE {' '.join(f"WHEN {_FIT(h, p)} THEN '{h}{p}'" for _, h, p in _CASES)} END AS rule,
       CASE {' '.join(f"WHEN {_FIT(h, p)} THEN '{v}'" for v, h, p in _CASES)} ELSE 'allow' END AS verdict
FROM parsed
"""
