"""Genre, table-type and figure-type classification and extraction confidence, as ordered conditions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from skein.functions.text import probably_numeric

# Patterns and word lists of the classifiers.
DOCUMENT_PATTERNS = (
    ("annual_report", r"(?i)\bannual report\b|\b10-K\b|\bshareholder"),
    ("datasheet", r"(?i)\bdatasheet\b|\breference manual\b"),
    ("whitepaper", r"(?i)\bwhitepaper\b|\bwhite paper\b|\barchitecture\b"),
    ("situation_report", r"(?i)\bsituation report\b|\bsitrep\b"),
    ("technical_manual", r"(?i)\bhandbook\b|\bmanual\b|\bguide\b"),
    ("policy_report", r"(?i)\bsummary for policymakers\b|\boutlook\b|\bmonetary policy\b"),
)
DOMAIN_DEFAULTS = {"science": "research_paper", "finance": "annual_report", "policy": "policy_report", "technical": "technical_manual", "energy": "policy_report", "health": "situation_report"}
REGISTER_HEADERS = ("bits", "bit", "field", "offset", "reset", "register", "address", "rw", "r/w")
FINANCIAL_HEADERS = ("amount", "total", "revenue", "earnings", "assets", "liabilities", "cost", "expense", "income", "cash", "%", "usd", "eur")
HEX, CURRENCY, PAREN_NEGATIVE = r"\b0x[0-9a-fA-F]+\b", "[$€£¥]", r"\(\s*[0-9,]+(\.[0-9]+)?\s*\)"


def document_type(title: Column, domain: Column) -> Column:
    """The first title pattern that fits, else the domain's default, else other."""
    options = [F.when(title.rlike(p), F.lit(name)) for name, p in DOCUMENT_PATTERNS]
    options += [F.when(domain == d, F.lit(name)) for d, name in DOMAIN_DEFAULTS.items()]
    return F.coalesce(*options, F.lit("other"))


def table_type(columns: Column, rows: Column) -> Column:
    """register, financial, matrix, comparison, simple, or unknown without a filled cell."""
    headers = F.transform(F.filter(columns, lambda c: c.isNotNull()), lambda c: F.lower(F.trim(c)))
    cells = F.filter(F.flatten(rows), lambda c: F.trim(F.coalesce(c, F.lit(""))) != "")
    n = F.size(cells)
    joined = F.array_join(cells, " ")

    def hits(pattern: str) -> Column:
        return F.size(F.regexp_extract_all(joined, F.lit(pattern), F.lit(0)))

    def named(words: tuple[str, ...]) -> Column:
        return F.arrays_overlap(headers, F.array(*map(F.lit, words)))

    numeric = F.size(F.filter(cells, probably_numeric)) / F.greatest(n, F.lit(1))
    wide = F.size(columns) >= 3
    return (
        F.when(n == 0, "unknown")
        .when(named(REGISTER_HEADERS) | (hits(HEX) >= F.greatest(F.lit(3.0), n * 0.1)), "register")
        .when((hits(CURRENCY) >= 2) | (hits(PAREN_NEGATIVE) >= 2) | named(FINANCIAL_HEADERS), "financial")
        .when((numeric > 0.7) & (F.size(rows) >= 3) & wide, "matrix")
        .when((numeric > 0.3) & (numeric <= 0.7) & wide, "comparison")
        .otherwise("simple")
    )


def fill_ratio(rows: Column) -> Column:
    cells = F.flatten(rows)
    filled = F.size(F.filter(cells, lambda c: F.trim(F.coalesce(c, F.lit(""))) != ""))
    return F.when(F.size(cells) > 0, filled / F.size(cells)).otherwise(0.0)


def is_word_grid(rows: Column) -> Column:
    """Text that was cut into a grid: six or more columns, most cells single words."""
    cells = F.filter(F.flatten(rows), lambda c: c.rlike(r"[\p{L}\p{N}]"))
    words = F.size(F.filter(cells, lambda c: F.trim(c).rlike(r"^\p{L}+$")))
    return (F.size(rows[0]) >= 6) & (F.size(cells) > 0) & (words > 0.6 * F.size(cells))


def is_degenerate(n_rows: Column, n_cols: Column, header_rows: Column, fill: Column, rows: Column) -> Column:
    """Grids that are no tables."""
    return (n_cols < 2) | (n_rows < 1) | (n_rows + header_rows < 2) | (n_cols > 20) | (fill < 0.3) | F.coalesce(is_word_grid(rows), F.lit(False))


def figure_type(area_ratio: Column, aspect: Column, vector: Column, colors: Column, saturation: Column) -> Column:
    """Type of an uncaptioned figure from its looks."""
    return (
        F.when((area_ratio < 0.01) & ((aspect > 4) | (aspect < 0.25)), "logo")
        .when(vector & (colors <= 12), "diagram")
        .when(vector, "chart")
        .when((colors > 5000) & (saturation > 0.15), "photo")
        .when((colors < 64) & saturation.isNotNull(), "diagram")
        .otherwise("unknown")
    )


def _held(score: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))


def text_confidence(replacement_ratio: Column, n_chars: Column, alpha_ratio: Column) -> Column:
    score = 1.0 - F.least(F.lit(1.0), replacement_ratio * 3.0) - F.when(n_chars < 15, 0.2).otherwise(0.0) - F.when((alpha_ratio < 0.2) & (n_chars > 20), 0.2).otherwise(0.0)
    return F.when(n_chars == 0, 0.0).otherwise(_held(score))


def table_confidence(fill: Column, n_rows: Column, n_cols: Column, has_header: Column, ragged: Column) -> Column:
    score = 0.25 + 0.6 * fill + F.when(has_header, 0.1).otherwise(0.0) - F.when((n_rows < 2) | (n_cols < 2), 0.3).otherwise(0.0) - F.least(F.lit(0.2), 0.05 * ragged)
    return F.when((n_rows < 1) | (n_cols < 1), 0.0).otherwise(_held(score))


def figure_confidence(area_ratio: Column, has_caption: Column, has_text: Column, vector: Column) -> Column:
    return _held(0.4 + F.least(F.lit(0.3), area_ratio * 3.0) + F.when(has_caption, 0.25).otherwise(0.0) + F.when(has_text, 0.05).otherwise(0.0) - F.when(vector, 0.1).otherwise(0.0))


def error_kind(error: Column) -> Column:
    """timeout, rate_limit, connection or other; null without an error."""
    return (
        F.when(error.isNull() | (error == ""), None)
        .when(error.rlike(r"(?i)\b\w*Timeout\w*\b|timed out"), "timeout")
        .when(error.rlike(r"(?i)\bRateLimitError\b|\b429\b"), "rate_limit")
        .when(error.rlike(r"\b(APIConnectionError|ConnectError|ConnectionError)\b"), "connection")
        .otherwise("other")
    )
