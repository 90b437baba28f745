"""Context packing, source blocks, citation resolution and answer validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.functions.text import citations, collapse_whitespace, key_tokens

#: Fixed value: what a refusing answer says.
REFUSAL = "I cannot answer this from the provided sources"


def admit(sources: DataFrame, budget: int = 6000) -> DataFrame:
    """query_id, rank, number of the sources that fit the budget.

    In rank order a source is admitted if its cost still fits; one that doesn't is skipped, a later smaller one may fit,
    the first always is. sources: query_id, rank, cost.
    """
    ordered = sources.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", F.col("cost").cast("long").alias("cost")))).alias("all"))
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<int>").alias("ranks"))

    def step(s: Column, x: Column) -> Column:
        fits = (F.size(s["ranks"]) == 0) | (s["used"] + x["cost"] <= budget)
        return F.struct(F.when(fits, s["used"] + x["cost"]).otherwise(s["used"]).alias("used"), F.when(fits, F.array_append(s["ranks"], x["rank"].cast("int"))).otherwise(s["ranks"]).alias("ranks"))

    kept = ordered.select("query_id", F.aggregate("all", start, step)["ranks"].alias("ranks"))
    return kept.select("query_id", F.posexplode("ranks").alias("number", "rank")).select("query_id", "rank", (F.col("number") + 1).alias("number"))


def source_block(number: Column, title: Column, page: Column, kind: Column, section: Column | None = None) -> Column:
    """Header of a source in a prompt; with a section in the longer form."""
    if section is None:
        return F.format_string("[%d] %s - page %d (%s)", number, title, page, kind)
    return F.concat(F.format_string("[%d] ", number), F.concat_ws(" · ", title, F.format_string("page %d", page), kind, F.nullif(section, F.lit(""))))


def snippet(text: Column, header: Column, limit: int = 240) -> Column:
    """Start of a source without its header, in one line."""
    body = F.when(F.startswith(text, header) & (F.length(header) > 0), F.substr(text, F.length(header) + 1)).otherwise(text)
    flat = collapse_whitespace(body)
    return F.when(F.length(flat) > limit, F.concat(F.rtrim(F.substring(flat, 1, limit - 1)), F.lit("…"))).otherwise(flat)


def is_refusal(answer: Column) -> Column:
    return F.contains(F.lower(F.coalesce(answer, F.lit(""))), F.lit(REFUSAL.lower()))


def resolve_citations(answers: DataFrame, sources: DataFrame) -> DataFrame:
    """query_id, number, chunk_id: what each cited number stands for; null if there is no such source.

    answers: query_id, answer; sources: query_id, number, chunk_id.
    """
    cited = answers.select("query_id", F.posexplode(citations(F.col("answer"))).alias("place", "number"))
    return cited.join(sources.select("query_id", "number", "chunk_id"), ["query_id", "number"], "left").select("query_id", "place", "number", "chunk_id")


def validate(answers: DataFrame, sources: DataFrame) -> DataFrame:
    """Per sentence of an answer: cited numbers, unresolved ones, and identifiers that no cited source contains.

    answers: query_id, sentence_id, sentence; sources: query_id, number, text.
    """
    own = answers.withColumn("cited", citations(F.col("sentence"))).withColumn("identifiers", key_tokens(F.regexp_replace("sentence", r"\[[0-9, ]+\]", "")))
    one = own.select("query_id", "sentence_id", F.explode_outer("cited").alias("number"))
    seen = one.join(sources.select("query_id", "number", F.lower("text").alias("text")), ["query_id", "number"], "left")
    held = seen.groupBy("query_id", "sentence_id").agg(F.array_sort(F.collect_list(F.when(F.col("text").isNull(), F.col("number")))).alias("unresolved"), F.concat_ws("\n", F.collect_list("text")).alias("haystack"))
    joined = own.join(held, ["query_id", "sentence_id"])
    bare = F.replace(F.col("haystack"), F.lit(","), F.lit(""))
    missing = F.filter("identifiers", lambda t: ~F.contains(F.col("haystack"), t) & ~F.contains(bare, F.replace(t, F.lit(","), F.lit(""))))
    return joined.select("query_id", "sentence_id", "cited", "unresolved", missing.alias("ungrounded"))


def display_groups(sources: DataFrame) -> DataFrame:
    """Sources with display_order: pages in the order of their first source. sources: query_id, number, doc_id, page."""
    first = F.min("number").over(Window.partitionBy("query_id", "doc_id", "page"))
    return sources.withColumn("display_order", F.dense_rank().over(Window.partitionBy("query_id").orderBy(first)))


def echo_answer(sources: DataFrame, n: int = 3) -> DataFrame:
    """A stand-in for a provider: an answer that cites the first n sources. sources: query_id, number, text."""
    used = F.array_sort(F.collect_list(F.when(F.col("number") <= n, F.struct("number", F.substring("text", 1, 80).alias("t")))))
    return sources.groupBy("query_id").agg(F.array_join(F.transform(used, lambda x: F.concat(x["t"], F.format_string(" [%d]", x["number"]))), " ").alias("answer"), F.floor(F.sum(F.length("text")) / 4).alias("prompt_tokens"))
