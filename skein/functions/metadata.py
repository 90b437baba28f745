"""Document metadata from what a file and its manifest say: authors, dates, version, language, labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from skein.functions.classify import document_type

# Patterns whose results must match.
TOOLS = r"(?i)acrobat|distiller|latex|pdftex|word|indesign|quark|ghostscript|writer|microsoft|adobe|printer|unknown"
AUTHOR_GAP = r"\s*(?:;|,|\band\b|&)\s*"
VERSION = r"(?i)\b(rev(?:ision)?\.?\s*\d+|v\d+(?:\.\d+)*)\b"
YEAR = r"\b((?:19|20)\d{2})\b"
FILE_DATE = r"^D?:?(\d{4})(\d{2})?(\d{2})?"


def _blank_null(text: Column) -> Column:
    return F.nullif(F.trim(text), F.lit(""))


def authors(value: Column) -> Column:
    """Names of three letters or more, 20 at most; none where the value names a tool."""
    parts = F.filter(F.transform(F.split(F.coalesce(value, F.lit("")), AUTHOR_GAP), lambda p: F.trim(p)), lambda p: F.length(p) > 2)
    return F.when(value.isNull() | value.rlike(TOOLS), F.array().cast("array<string>")).otherwise(F.slice(parts, 1, 20))


def file_date(value: Column) -> Column:
    """Date of D:YYYY[MM[DD]], months and days held to what there is; null outside 1900-2100; the first of January where the day doesn't exist."""
    flat = F.trim(F.coalesce(value, F.lit("")))
    year, month, day = (F.regexp_extract(flat, FILE_DATE, k).try_cast("int") for k in (1, 2, 3))
    m = F.least(F.greatest(F.coalesce(month, F.lit(1)), F.lit(1)), F.lit(12))
    d = F.least(F.greatest(F.coalesce(day, F.lit(1)), F.lit(1)), F.when(m == 2, 28).otherwise(31))
    text = F.format_string("%04d-%02d-%02d", year, m, d)
    return F.when(year.between(1900, 2100), F.coalesce(text.try_cast("date"), F.format_string("%04d-01-01", year).try_cast("date")))


def version(title: Column) -> Column:
    return F.nullif(F.regexp_extract(F.coalesce(title, F.lit("")), VERSION, 1), F.lit(""))


def title_year(title: Column) -> Column:
    return F.nullif(F.regexp_extract(F.coalesce(title, F.lit("")), YEAR, 1), F.lit(""))


def language(declared: Column) -> Column:
    """The declared code, five characters at most; en without one."""
    return F.coalesce(_blank_null(F.substring(F.lower(F.trim(declared)), 1, 5)), F.lit("en"))


def document_record(title: Column, file_title: Column, author: Column, created: Column, modified: Column, category: Column, declared: Column) -> Column:
    """struct: title, authors, publication_date, version, doc_type, language and field_sources, which says where each came from."""
    own_title = _blank_null(title)
    people = authors(author)
    year = title_year(title)
    first, second = file_date(created), file_date(modified)
    date = F.coalesce(first, second, F.concat(year, F.lit("-01-01")).try_cast("date"))
    date_source = F.when(first.isNotNull(), "file.created").when(second.isNotNull(), "file.modified").when(year.isNotNull(), "title_year")
    entries = F.array(
        F.struct(F.lit("title").alias("k"), F.when(own_title.isNotNull() | _blank_null(file_title).isNull(), "manifest").otherwise("file").alias("v")),
        F.struct(F.lit("authors").alias("k"), F.when(F.size(people) > 0, "file").alias("v")), F.struct(F.lit("publication_date").alias("k"), date_source.alias("v")),
        F.struct(F.lit("version").alias("k"), F.when(version(title).isNotNull(), "title").alias("v")),
    )
    return F.struct(
        F.coalesce(own_title, _blank_null(file_title)).alias("title"), people.alias("authors"), date.alias("publication_date"), version(title).alias("version"), document_type(F.coalesce(title, F.lit("")), category).alias("doc_type"),
        language(declared).alias("language"), F.map_from_entries(F.filter(entries, lambda e: e["v"].isNotNull())).alias("field_sources"),
    )


def effective_pages(n_pages: Column, limit: Column) -> Column:
    """Pages that will be read; no limit: all."""
    return F.least(n_pages, limit)


def is_truncated(n_read: Column, n_pages: Column) -> Column:
    return n_read < n_pages


def citation_label(title: Column, organisation: Column, source: Column, published: Column) -> Column:
    """title (organisation or source, year), without what is missing."""
    bits = F.concat_ws(", ", F.coalesce(_blank_null(organisation), _blank_null(source)), F.year(published).cast("string"))
    return F.when(bits == "", title).otherwise(F.concat(title, F.lit(" ("), bits, F.lit(")")))


def human_label(title: Column, page: Column, section: Column) -> Column:
    """title, p. page (section)."""
    base = F.format_string("%s, p. %d", title, page)
    return F.when(F.coalesce(section, F.lit("")) == "", base).otherwise(F.concat(base, F.lit(" ("), section, F.lit(")")))


def is_meaningful(text: Column, min_chars: int = 3, share: float = 0.5) -> Column:
    """Recovered text that is content: long enough, and at least half letters and digits."""
    flat = F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)^\s+|\s+$", "")
    visible, alnum = F.length(F.regexp_replace(flat, r"(?U)\s", "")), F.length(F.regexp_replace(flat, r"[^\p{L}\p{N}]", ""))
    return (F.length(flat) >= min_chars) & (visible > 0) & (alnum >= share * visible)
