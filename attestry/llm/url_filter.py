"""URL rules found by hashes of host suffixes and path prefixes (operator 6, native).

Every URL is cut into host and path, and expanded into the expressions (host suffix, path prefix) that a rule
could name. Suffixes are taken at the label counts that occur among the rules, and for each of them prefixes at the lengths that
occur with it: no other expression can equal a rule's, so the expansion is exact and short however long the URL is, and the
plan is the same for five rules and five millions. Expressions
meet the rules by the first 8 hex digits of their SHA-256; the full digest confirms, and the longest rule wins.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestry.llm.shared import HOT, ascii_lower, cut, fresh, join_split, small

PREFIX = 8


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path): '' for both where the URL is null or has no '://'."""
    rest = F.when(F.instr(url, "://") > 0, F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    return ascii_lower(F.regexp_extract(rest, r"^([^/?#]*)", 1)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def digest(host: Column, path: Column) -> Column:
    return F.sha2(F.concat_ws("\n", host, path), 256)


def prepared(rules: DataFrame) -> DataFrame:
    """Rules (host, path, verdict) with their digests; rows with a null or an empty host or another verdict than allow and block never fit and go."""
    host, path = ascii_lower(F.col("host")), F.coalesce("path", F.lit(""))
    return (
        rules.filter(F.col("verdict").isin("allow", "block") & (F.col("host") != ""))
        .select(host.alias("r_host"), path.alias("r_path"), (F.col("verdict") == "block").alias("r_block"))
        .groupBy("r_host", "r_path").agg(F.max("r_block").alias("r_block"))
        .withColumns({
            "r_digest": digest(F.col("r_host"), F.col("r_path")), "r_rule": F.concat("r_host", "r_path"),
            "r_labels": F.size(F.split("r_host", r"\.")), "r_cut": F.char_length("r_path"),
        })
        .withColumn("r_prefix", short(F.col("r_digest")))
    )


def short(digest: Column) -> Column:
    """The first PREFIX hex digits of a digest as a number."""
    return F.conv(F.substring(digest, 1, PREFIX), 16, 10).cast("long")


def judge_urls(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """pages with host, path, rule and verdict added (columns of these names are replaced).

    A rule fits its host and all subdomains where the path starts with the rule's; of several, the longest rule
    string wins, then the longer host, and block where the same rule is given both ways. Without a fitting rule:
    rule null, verdict `default`. A null url, or one without '://', has empty host and path and fits no rule.
    Repeated pages each keep their row. No rules or no pages: nothing fits, or no rows.

    Distinct (host, path) pairs are judged, so that a URL that holds a third of all rows is expanded once; the
    page's other columns take part only in the last join, where pairs that hold very many pages are broadcast (`join_split`). Rules are
    broadcast while they are few (`small`), and joined by shuffle beyond that.
    """
    known = cut(prepared(rules), "url-rules")
    shapes = known.groupBy("r_labels").agg(F.collect_set("r_cut").alias("r_cuts"))  # a row a label count, with lengths of paths: bounded by what a URL can be
    host, path = url_parts(F.col(url))
    parts = pages.drop("host", "path", "rule", "verdict").withColumns({"host": host, "path": path})
    pairs = parts.filter(F.col("host") != "").groupBy("host", "path").agg(F.count("*").alias("rows"))
    asked = (
        pairs.select("host", "path", "rows", F.explode(F.sequence(F.lit(1), F.size(F.split("host", r"\.")))).alias("labels"))
        .join(small(shapes), F.col("labels") == F.col("r_labels"))
        .select("host", "path", "rows", F.expr("substring_index(host, '.', -labels)").alias("h"), F.explode(F.filter("r_cuts", lambda k: k <= F.char_length("path"))).alias("k"))
        .select("host", "path", "rows", digest(F.col("h"), F.substring(F.col("path"), F.lit(1), F.col("k"))).alias("digest"))
        .withColumn("prefix", short(F.col("digest")))
    )
    listed = known.groupBy("r_prefix").agg(F.collect_list(F.struct("r_digest", "r_rule", "r_host", "r_block")).alias("r_listed"))  # the rules that share a prefix: few, by chance
    b_host, b_path, b_rows, b_best = fresh(parts, "b_host", "b_path", "b_rows", "b_best")
    best = cut(
        asked.join(small(listed), F.col("prefix") == F.col("r_prefix"))
        .select("host", "path", "rows", F.inline(F.filter("r_listed", lambda r: r["r_digest"] == F.col("digest"))))
        .groupBy("host", "path")
        .agg(F.max("rows").alias(b_rows), F.max(F.struct(F.char_length("r_rule").alias("n"), F.char_length("r_host").alias("h"), "r_block", "r_rule")).alias(b_best))
        .withColumnsRenamed({"host": b_host, "path": b_path}), "url-best"
    )
    judged = join_split(parts, best, (F.col("host") == F.col(b_host)) & (F.col("path") == F.col(b_path)), b_rows, "left", HOT)  # pairs are as long as URLs, so few are broadcast
    return judged.select(
        *[F.col(c) for c in parts.columns], F.col(f"{b_best}.r_rule").alias("rule"),
        F.when(F.col(b_best).isNull(), default).when(F.col(f"{b_best}.r_block"), "block").otherwise("allow").alias("verdict"),
    )
