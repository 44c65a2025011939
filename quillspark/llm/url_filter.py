"""URL filters: host-suffix and path-prefix expressions joined with rules on short digests.

Every url is expanded into the expressions that a rule could be written as (a suffix of its host,
whole labels, followed by a prefix of its path); expressions meet rules on the first 32 bits of
their SHA-256, the full digest confirms, and the longest rule wins (block before allow on a tie).
Only host depths and path lengths that some rule has are expanded; that table has a row per depth,
with the distinct lengths, so rules may have any number of shapes.

Defined cases: a null url, or one without "://", has an empty host and path, meets no rule and gets
the default verdict; very long urls are expanded like others; an empty rule table gives every url the default;
of rules that tie in length a block wins, then the last in order of text; repeated rules count once;
repeated rows and repeated page_ids stay, each judged by its own url; an empty table gives an empty result;
columns other than page_id and url are neither needed nor read. A rule with a null or empty host fits nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import ascii_lower, looked_up

def with_host_path(df: DataFrame) -> DataFrame:
    """Add host and path of the column url."""
    rest = F.expr("CASE WHEN instr(url, '://') > 0 THEN substring(url, instr(url, '://') + 3) ELSE '' END")
    host = F.regexp_extract("_rest", r"^[^/?#]*", 0)
    df = df.withColumn("_rest", F.coalesce(rest, F.lit("")))
    df = df.withColumn("_host", host).withColumn("path", F.regexp_extract(F.expr("substring(_rest, length(_host) + 1)"), r"^[^?#]*", 0))
    return df.withColumn("host", ascii_lower(F.col("_host"))).drop("_rest", "_host")


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """page_id, host, path, rule, verdict for every row of pages(page_id, url).

    rules(host, path, verdict): a rule fits its host and all subdomains where the url's path starts
    with the rule's path."""
    rules = (
        rules.where("host IS NOT NULL AND host != ''")
        .select(ascii_lower(F.col("host")).alias("rule_host"), F.coalesce("path", F.lit("")).alias("rule_path"), "verdict")
        .withColumn("rule", F.concat("rule_host", "rule_path"))
        .withColumn("rule_digest", F.sha2("rule", 256))
        .withColumn("short", F.substring("rule_digest", 1, 8))
        .withColumn("precedence", F.struct(F.length("rule"), (F.col("verdict") == "block").alias("blocks"), "rule", "verdict"))
    )
    # A row per host depth: as many lengths at most as the longest rule has characters, so it can be broadcast.
    shapes = rules.select(F.size(F.split("rule_host", r"\.")).alias("depth"), F.length("rule_path").alias("n")).groupBy("depth").agg(F.sort_array(F.collect_set("n")).alias("lengths"))
    rows = pages.select("page_id", "url")
    urls = with_host_path(rows.where("url IS NOT NULL").groupBy("url").agg(F.count(F.lit(1)).alias("copies"))).withColumn("labels", F.split("host", r"\."))
    depths = urls.select("url", "copies", "path", "labels", F.explode(F.sequence(F.lit(1), F.size("labels"))).alias("depth")).join(F.broadcast(shapes), "depth")
    suffix = F.array_join(F.slice("labels", F.size("labels") - F.col("depth") + 1, F.col("depth")), ".")
    fitting = F.filter("lengths", lambda n: n <= F.length("path"))
    forms = F.transform(fitting, lambda n: F.concat("suffix", F.expr("path").substr(F.lit(1), n)))
    expressions = (
        depths.withColumn("suffix", suffix)
        .select("url", "copies", F.explode(forms).alias("expression"))
        .withColumn("digest", F.sha2("expression", 256))
        .withColumn("short", F.substring("digest", 1, 8))
    )
    found = (
        expressions.join(rules.select("short", "rule_digest", "precedence"), "short")
        .where(F.col("digest") == F.col("rule_digest"))
        .groupBy("url")
        .agg(F.max("precedence").alias("best"), F.max("copies").alias("n"))
    )
    judged = looked_up(rows, found, "url", "left")
    return with_host_path(judged).select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce(F.col("best.verdict"), F.lit(default)).alias("verdict"))
