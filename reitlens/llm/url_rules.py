"""URL filters: host-suffix x path-prefix expressions, joined with the rules on short hash prefixes.

Every URL is expanded into all its host suffixes, each combined with the path
prefixes of the lengths that occur among the rules.  An expression and a rule
meet in an equi-join on the first hex digits of their SHA-256; the full digests
are then compared, and of all rules that fit the longest wins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Hex digits of the digest that the join is on.
SHORT = 8
#: (verdict, host, path) of the production rules.
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def rules_frame(spark: SparkSession, rules=RULES) -> DataFrame:
    return spark.createDataFrame(list(rules), "verdict string, host string, path string")


def url_parts(url):
    """(host, path) columns of a URL column; both empty for null or a URL without ``://``."""
    has = url.isNotNull() & (F.instr(url, "://") > 0)
    rest = F.substring_index(url, "://", 1)
    rest = F.substring(url, F.length(rest) + 4, F.length(url))
    host = F.translate(F.regexp_extract(rest, "^([^/?#]*)", 1), _UPPER, _LOWER)
    path = F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)
    return F.when(has, host).otherwise(""), F.when(has, path).otherwise("")


def judge(df: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """Columns of ``df`` plus host, path, rule (``host + path`` or null) and verdict.

    Distinct URLs are judged once and joined back, so repeated rows share a
    verdict.  A null or malformed URL has an empty host that no rule fits:
    ``rule`` is null and the verdict is ``default``.  Rules with a null or empty
    host never fit; a null rule path counts as empty.  Of rules of equal length
    the one with the longer host wins, of the same rule given twice a block.
    Columns of ``df`` named like the results are replaced.  An empty table gives
    an empty result.
    """
    clash = [c for c in ("host", "path", "rule", "verdict") if c in df.columns]
    df = df.drop(*clash)
    rules = rules.where("length(host) > 0").select(
        F.translate("host", _UPPER, _LOWER).alias("r_host"), F.coalesce("path", F.lit("")).alias("r_path"), F.col("verdict").alias("r_verdict"))
    # distinct path lengths: at most as many as the longest rule path has characters
    lengths = sorted(r[0] for r in rules.select(F.length("r_path")).distinct().collect())
    expr = F.concat("r_host", "r_path")
    rules = rules.withColumn("r_rule", expr).withColumn("r_digest", F.sha2(expr, 256)).withColumn("short", F.substring("r_digest", 1, SHORT))

    host, path = url_parts(F.col("url__"))
    urls = df.select(F.col(url).alias("url__")).where(F.col(url).isNotNull()).distinct().select("url__", host.alias("h"), path.alias("p"))
    labels = F.split("h", "\\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    prefixes = F.transform(F.filter(F.array(*[F.lit(n) for n in lengths]).cast("array<int>"), lambda n: n <= F.length("p")), lambda n: F.substring(F.col("p"), F.lit(1), n))
    forms = (urls.select("url__", F.explode(suffixes).alias("s"), prefixes.alias("ps")).where("s <> ''")
             .select("url__", "s", F.explode("ps").alias("q"))
             .select("url__", F.sha2(F.concat("s", "q"), 256).alias("digest")))
    forms = forms.withColumn("short", F.substring("digest", 1, SHORT))
    hits = forms.join(rules, "short").where("digest = r_digest")
    best = F.max_by(F.struct("r_rule", "r_verdict"), F.struct(F.length("r_rule"), F.length("r_host"), (F.col("r_verdict") == "block"), "r_rule"))
    found = hits.groupBy("url__").agg(best.alias("best__"))
    host, path = url_parts(F.col(url))
    return (df.join(found, F.col(url) == F.col("url__"), "left")
            .select(*df.columns, host.alias("host"), path.alias("path"), F.col("best__.r_rule").alias("rule"),
                    F.coalesce("best__.r_verdict", F.lit(default)).alias("verdict")))


def kept_urls(df: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """The rows of ``df`` whose URL is allowed."""
    return judge(df, rules, url, default).where("verdict = 'allow'").select(*df.columns)
