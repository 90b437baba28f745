"""Language identification by Bayesian evidence fusion.

log posterior = text log-likelihood (byte trigrams, naive Bayes, tempered as trigrams overlap)
              + log p(declared language | language), a confusion table counted over all documents
              + log prior of the address: global -> suffix -> domain -> host, each level's counts of text-only posteriors
                smoothed towards the level above (Dirichlet, `strength` pseudo-documents).
What a document itself adds to the confusion table and to its address is taken off before it is judged, so its text
isn't counted twice.
An unknown class stands beside the languages: each of its trigrams is as likely as those of the least likely labelled
texts, less a margin, so a text in none of the languages goes to it, unless it is so short that its declaration and
address outweigh it.
Both tables are grouped aggregations; a host that holds a third of all rows is one partial sum per task. Texts are read
once: what joins the priors are narrow rows of scores.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.llm.common import byte_tables, fresh, frugal, materialize, release, text_slices

LANGUAGES = ("de", "en", "es", "fr")
TABLE_BITS = 16
NEVER = -1e3
SPACES = byte_tables(bytes([*range(0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]))


def trigrams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Table places of the byte trigrams of all texts, and for each text where its own start; ASCII non-letters are one space."""
    n = len(texts)
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int32)[texts.offset : texts.offset + n + 1].astype(np.int64) if n else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    is_space, lower = SPACES
    letters = np.where(is_space[raw], 32, lower[raw]).astype(np.uint32)
    keep = np.ones(len(letters), bool)
    keep[1:] = (letters[1:] != 32) | (letters[:-1] != 32)
    keep[offsets[:-1][np.diff(offsets) > 0]] = True
    bounds = np.r_[0, np.cumsum(keep)][offsets]
    letters = letters[keep]
    if len(letters) < 3:
        return np.zeros(0, np.int64), np.zeros(n + 1, np.int64)
    codes = ((letters[:-2] * 0x9E3779B1) ^ (letters[1:-1] * 0x85EBCA6B) ^ (letters[2:] * 0xC2B2AE35)) >> (32 - TABLE_BITS)
    ends = np.minimum(np.maximum(bounds[1:] - 2, bounds[:-1]), len(codes))
    own = np.zeros(len(codes), bool)
    counts = ends - np.minimum(bounds[:-1], ends)
    first = np.repeat(np.minimum(bounds[:-1], ends) - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
    own[first] = True
    return codes[own].astype(np.int64), np.r_[0, np.cumsum(counts)]


def fit(labelled: DataFrame, languages: tuple[str, ...] = LANGUAGES, sample: int = 20_000, margin: float = 1.0, fewest: int = 20) -> np.ndarray:
    """Log probabilities (table place, language) from rows (text, language) with a known language; the last column is the unknown class.

    At most about `sample` rows are used, chosen by a hash of the text; without any, all languages are alike. The unknown
    class has `margin` less than the mean per trigram that 999 of 1000 of these rows of `fewest` trigrams or more reach
    in their language, each trigram's own occurrence left out.
    """
    known = labelled.where(F.col("language").isin(*languages) & F.col("text").isNotNull())
    n = known.count()
    if n > sample:
        known = known.where(F.pmod(F.xxhash64("text"), F.lit(1_000_000)) < int(1_000_000 * sample / n))
    size = 1 << TABLE_BITS

    def count(batches):
        tables: dict[str, np.ndarray] = {}
        for rows, texts in text_slices(batches, 0):
            names = rows.column(1).to_pylist()
            codes, bounds = trigrams(texts)
            for name in set(names):
                own = np.repeat([x == name for x in names], np.diff(bounds))
                tables[name] = tables.get(name, 0) + np.bincount(codes[own], minlength=size)
        for name, own in tables.items():
            places = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(places)), pa.array(places), pa.array(own[places])], ["language", "place", "n"])

    counted = known.select("text", "language").mapInArrow(frugal(count), "language string, place long, n long").groupBy("language", "place").agg(F.sum("n").alias("n")).toArrow()  # at most `size` rows a language
    names, places, numbers = (counted.column(c) for c in ("language", "place", "n"))
    found = {name: np.zeros(size) for name in languages}
    for name in languages:
        own = pa.compute.equal(names, name)
        found[name][places.filter(own).to_numpy()] = numbers.filter(own).to_numpy()
    table = np.stack([found[name] + 0.5 for name in languages], 1).astype(np.float64)
    held_out = np.log(np.maximum(table - 1, 0.5) / table.sum(0))

    def mean(batches):
        for rows, texts in text_slices(batches, 0):
            codes, bounds = trigrams(texts)
            own = np.array([languages.index(x) for x in rows.column(1).to_pylist()], np.int64)
            n = np.diff(bounds)
            total = np.diff(np.r_[0.0, np.cumsum(held_out[codes, np.repeat(own, n)])][bounds])
            yield pa.RecordBatch.from_arrays([pa.array((total / np.maximum(n, 1))[n >= fewest])], ["mean"])

    least = known.select("text", "language").mapInArrow(frugal(mean), "mean double").agg(F.percentile_approx("mean", 0.001, 10_000)).first()[0]
    unknown = np.full((size, 1), NEVER if least is None else least - margin)
    return np.c_[np.log(table / table.sum(0)), unknown].astype(np.float32)


def address_parts(address: Column) -> tuple[Column, Column, Column]:
    """Host of a URL (or the address itself), its last two labels, and its last label (empty if there is only one)."""
    host = F.lower(F.coalesce(F.regexp_extract(address, r"(?s)^(?:.*?://)?([^/?#]*)", 1), F.lit("")))
    return host, F.regexp_extract(host, r"([^.]*\.?[^.]*)$", 1), F.regexp_extract(host, r"\.([^.]*)$", 1)


def declared_language(html: Column) -> Column:
    """The lang attribute of the html element, without its region; null if there is none."""
    return F.nullif(F.lower(F.regexp_extract(html, r"(?is)<html\b[^>]*?\blang\s*=\s*[\"']?([a-z]+)", 1)), F.lit(""))


def identify(docs: DataFrame, model: np.ndarray, text_col: str = "text", declared: Column | None = None, address: Column | None = None, id_col: str = "doc_id", languages: tuple[str, ...] = LANGUAGES, temper: float = 0.3, strength: float = 20.0, least: float = 0.5, unknown: float = 1e-3) -> DataFrame:
    """One row per document: id_col, language, posterior, text_language, evidence (trigrams), accepted, text_hash.

    A text without trigrams (null, empty, no letters) has no evidence: language is null, and it is not accepted, nor is
    one whose posterior is below `least`. Very long texts are read whole. Of languages that tie the first of `languages`
    counts. `unknown`: prior of the unknown class, whose posterior the others share less; it
    is as likely to declare any language. Declared languages outside `languages` and null addresses say nothing. Rows
    that repeat are judged one by one; an empty table gives an empty result. text_hash tells apart rows that share an id.
    """
    names = list(languages)
    n = len(names)
    text = F.col(text_col).cast("string")
    host, domain, suffix = address_parts(address if address is not None else F.lit(None).cast("string"))
    stated = declared if declared is not None else F.lit(None).cast("string")
    source = docs.select(
        F.col(id_col).alias("id"), text.alias("text"), F.when(stated.isin(*names), stated).alias("declared"), host.alias("host"), domain.alias("domain"), suffix.alias("suffix"), F.xxhash64(text).alias("text_hash")
    )
    log_p = model

    def score(batches):
        for rows, texts in text_slices(batches, 1):
            codes, bounds = trigrams(texts)
            sums = np.stack([np.diff(np.r_[0.0, np.cumsum(log_p[codes, k], dtype=np.float64)][bounds]) for k in range(n)], 1) * temper
            most = sums.max(1, keepdims=True)
            none = np.diff(bounds) * float(log_p[0, n]) * temper + np.log(unknown) - most[:, 0]
            sums -= most
            part = np.exp(sums)
            part /= part.sum(1, keepdims=True) + np.exp(np.minimum(none, 700.0))[:, None]
            part[np.diff(bounds) == 0] = 0
            arrays = [*(rows.column(k) for k in (0, 2, 3, 4, 5, 6)), pa.array(np.diff(bounds)), pa.array(none), *(pa.array(sums[:, k]) for k in range(n)), *(pa.array(part[:, k]) for k in range(n))]
            yield pa.RecordBatch.from_arrays(arrays, columns)

    columns = ["id", "declared", "host", "domain", "suffix", "text_hash", "evidence", "none", *(f"l{k}" for k in range(n)), *(f"p{k}" for k in range(n))]
    kind = source.schema["id"].dataType.simpleString()
    schema = f"id {kind}, declared string, host string, domain string, suffix string, text_hash long, evidence long, none double, " + ", ".join(f"l{k} double" for k in range(n)) + ", " + ", ".join(f"p{k} double" for k in range(n))
    scored = materialize(source.mapInArrow(frugal(score), schema), "langid")
    masses = [F.sum(f"p{k}").alias(f"p{k}") for k in range(n)]

    # One row: the corpus; and at most len(languages) rows of what is declared for each language.
    top = scored.agg(*masses).first()
    root = np.array([top[k] or 0.0 for k in range(n)]) + 1.0
    root = root / root.sum()
    stated_rows = {r.declared: [r[f"p{k}"] for k in range(n)] for r in scored.where("declared is not null").groupBy("declared").agg(*masses).collect()}
    confusion = np.array([[stated_rows.get(d, [0.0] * n)[k] + (n - 1.0 if d == names[k] else 1.0) for k in range(n)] for d in names])

    # What each level has counted, beside every host.
    level = materialize(scored.groupBy("suffix", "domain", "host").agg(*masses), "hosts")
    domains = level.groupBy("suffix", "domain").agg(*(F.sum(f"p{k}").alias(f"d{k}") for k in range(n)))
    suffixes = level.groupBy("suffix").agg(*(F.sum(f"p{k}").alias(f"s{k}") for k in range(n)))
    level = level.select("suffix", "domain", "host", *(F.col(f"p{k}").alias(f"h{k}") for k in range(n)))
    priors = level.join(domains.join(suffixes, "suffix"), ["suffix", "domain"])

    def said(k: int) -> Column:
        """log p(declared | language k); the document's own share isn't counted."""
        own, whole, out = F.col(f"p{k}"), float(confusion[:, k].sum()), F.lit(0.0)
        for d, name in enumerate(names):
            out = F.when(F.col("declared") == name, F.log(F.greatest(F.lit(float(confusion[d, k])) - own, F.lit(1e-9)) / F.greatest(F.lit(whole) - own, F.lit(1e-9)))).otherwise(out)
        return out

    fused = scored.join(priors, ["suffix", "domain", "host"])
    own_mass = sum((F.col(f"p{k}") for k in range(n)), F.lit(0.0))
    above: list[Column] = [F.lit(float(x)) for x in root]
    for prefix in "sdh":
        # Each level is smoothed towards the one above it.
        total = sum((F.col(f"{prefix}{k}") for k in range(n)), F.lit(0.0)) - own_mass
        fused = fused.withColumns({f"{prefix}_{k}": F.greatest((F.col(f"{prefix}{k}") - F.col(f"p{k}") + strength * above[k]) / (total + strength), F.lit(1e-12)) for k in range(n)})
        above = [F.col(f"{prefix}_{k}") for k in range(n)]
    fused = fused.withColumns({f"f{k}": F.col(f"l{k}") + said(k) + F.log(F.col(f"h_{k}")) for k in range(n)})
    best = F.greatest(*(F.col(f"f{k}") for k in range(n)))
    total = sum((F.exp(F.col(f"f{k}") - F.col("best")) for k in range(n)), F.exp(F.col("none") - F.when(F.col("declared").isNull(), 0.0).otherwise(float(np.log(n))) - F.col("best")))
    fused = fused.withColumn("best", best).withColumn("posterior", 1.0 / total)

    def first(prefix: str, value: Column) -> Column:
        return F.coalesce(*(F.when(F.col(f"{prefix}{k}") == value, F.lit(names[k])) for k in range(n)))

    some = F.col("evidence") > 0
    return fused.select(
        F.col("id").alias(id_col), F.when(some, first("f", F.col("best"))).alias("language"), F.when(some, F.col("posterior")).alias("posterior"),
        F.when(some, first("l", F.greatest(*(F.col(f"l{k}") for k in range(n))))).alias("text_language"), "evidence", (some & (F.col("posterior") >= least)).alias("accepted"), "text_hash",
    )


def keep_identified(docs: DataFrame, found: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """docs without the rows that identify() did not accept. Those are few, so the anti-join broadcasts them when they are small.

    Rows that repeat, null ids and any other columns stay as they are; rows of one id are told apart by their texts; an
    empty table stays empty.
    """
    name, mark = fresh("id"), fresh("hash")
    gone = materialize(found.where("not accepted").select(F.col(id_col).alias(name), F.col("text_hash").alias(mark)).distinct(), "rejected")
    return docs.join(gone, F.col(id_col).eqNullSafe(F.col(name)) & F.xxhash64(F.col(text_col).cast("string")).eqNullSafe(F.col(mark)), "left_anti")
