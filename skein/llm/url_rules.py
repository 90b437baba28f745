"""URL filters: an explicit rule list first, association rules over URL tokens for the rest. DataFrame operations only.

FP-growth mines token combinations from labelled URLs; rules that conclude the label "block" and pass the confidence
and support bounds are matched by an inverted index: each rule stands under its rarest token, a URL meets only the rules
under its own tokens, and a rule fires if the URL has all the others too. A rule that holds all tokens of another one is
left out: wherever it fires, so does the other. Labels come from the caller; the URLs that the explicit rules decide are
labelled rows for those that they leave open (decided()).
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.llm.common import materialize

BLOCK_ITEM = "label=block"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """The host after the first `://`, A-Z in lower case, and the path after it; both empty for null and without `://`."""
    host = F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), string.ascii_uppercase, string.ascii_lowercase)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def url_tokens(url: Column) -> Column:
    """Distinct tokens of a URL: host labels, path parts with digits as #, names of query fields; none for null."""
    host, path = host_and_path(url)
    query = F.regexp_extract(F.coalesce(url, F.lit("")), r"\?([^#]*)", 1)
    parts = [
        F.transform(F.split(host, r"\."), lambda x: F.when(x != "", F.concat(F.lit("host:"), x))),
        F.transform(F.split(path, "/"), lambda x: F.when(x != "", F.concat(F.lit("path:"), F.regexp_replace(x, "[0-9]+", "#")))),
        F.transform(F.split(query, "&"), lambda x: F.when(x != "", F.concat(F.lit("query:"), F.regexp_extract(x, "^([^=]*)", 1)))),
    ]
    return F.array_distinct(F.array_compact(F.flatten(F.array(*parts))))


def listed_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest fitting (verdict, host, path) rule as `host` + `path`, and its verdict; null where none fits."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1:])):  # the last one wins
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def decided(pages: DataFrame, rules: list[tuple[str, str, str]], url_col: str = "url") -> DataFrame:
    """(url, bad) of the rows that a listed rule decides: labels for mine(). Repeated URLs count as often as they stand there."""
    host, path = host_and_path(F.col("url"))
    verdict = listed_rule(F.col("host"), F.col("path"), rules)[1]
    found = pages.select(F.col(url_col).cast("string").alias("url")).withColumns({"host": host, "path": path}).withColumn("verdict", verdict)
    return found.where("verdict is not null").select("url", (F.col("verdict") == "block").alias("bad"))


def mine(labelled: DataFrame, min_support: float = 0.002, min_count: int = 20, min_confidence: float = 0.8) -> DataFrame:
    """Rules from labelled URLs (url, bad): key (the rarest token), tokens, confidence, support.

    A set of tokens is a rule if min_count labelled URLs and a share min_support of them have it and the label, and a
    share min_confidence of those that have it have the label, more than of all. Rules with all tokens of another rule
    are left out. Null URLs and labels don't count; repeated rows do; an empty table gives no rules.
    """
    from pyspark.ml.fpm import FPGrowth

    spark = labelled.sparkSession
    kind = "key string, tokens array<string>, confidence double, support double"
    items = labelled.where("url is not null and bad is not null").select(
        F.when(F.col("bad"), F.array_append(url_tokens(F.col("url")), F.lit(BLOCK_ITEM))).otherwise(url_tokens(F.col("url"))).alias("items")
    )
    n = items.count()
    if n < min_count:
        return spark.createDataFrame([], kind)
    min_support = max(min_support, min_count / n)
    model = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence).fit(items)
    rules = model.associationRules.where(F.array_contains("consequent", BLOCK_ITEM) & (F.col("lift") > 1)).select(F.array_sort("antecedent").alias("tokens"), "confidence", "support")
    single = model.freqItemsets.where(F.size("items") == 1).select(F.col("items")[0].alias("token"), "freq")
    rarest = rules.select("*", F.explode("tokens").alias("token")).join(single, "token").groupBy("tokens", "confidence", "support")
    keyed = materialize(rarest.agg(F.min_by("token", F.struct("freq", "token")).alias("key")).select("key", "tokens", "confidence", "support"), "mined")
    smaller = keyed.select(F.col("key").alias("token"), F.col("tokens").alias("part"))
    larger = keyed.select("tokens", F.explode("tokens").alias("token")).join(smaller, "token")
    larger = larger.where((F.size("part") < F.size("tokens")) & (F.size(F.array_except("part", "tokens")) == 0)).select("tokens").distinct()
    return keyed.join(larger, "tokens", "left_anti").select("key", "tokens", "confidence", "support")


def judge(pages: DataFrame, rules: list[tuple[str, str, str]], mined: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """One row per page: id_col, host, path, rule, verdict, confidence (of the mined rule that decided; else null).

    A listed rule decides where one fits; else a mined rule blocks; else the default holds. Null URLs and URLs without
    `://` have empty host and path and get the default unless a mined rule fits. Repeated rows stay and repeated URLs
    are matched once; very long URLs are matched whole. Other columns aren't read; an empty table gives an empty result.
    """
    host, path = host_and_path(F.col("url"))
    rule, verdict = listed_rule(F.col("host"), F.col("path"), rules)
    parsed = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url")).withColumns({"host": host, "path": path}).withColumns({"rule": rule, "listed": verdict})
    mined = materialize(mined, "rules")
    open_ = parsed.where("listed is null and url is not null").select("url").distinct().withColumn("own", url_tokens(F.col("url")))
    met = open_.select("url", "own", F.explode("own").alias("key")).join(mined, "key")
    fired = met.where(F.size(F.array_except("tokens", "own")) == 0).groupBy("url").agg(F.max("confidence").alias("confidence"))
    out = parsed.join(fired, "url", "left")
    return out.select(
        F.col("id").alias(id_col), "host", "path", "rule",
        F.coalesce("listed", F.when(F.col("confidence").isNotNull(), "block").otherwise(default)).alias("verdict"),
        F.when(F.col("listed").isNull(), F.col("confidence")).alias("confidence"),
    )
