"""Text functions as column expressions; texts stay in the JVM."""

from __future__ import annotations

import functools
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns and tables whose results must match.
LEXICAL = r"[A-Za-z0-9]+(?:[._,][A-Za-z0-9]+)*"
PIECE = r"(?U)\w+|[^\w\s]"
SUBWORD_FACTOR = 1.25
SECRET = r"\b(?:sk|rk)-[A-Za-z0-9_\-*]{6,}"
CITATION = r"\[(\d+(?:\s*,\s*\d+)*)\]"
ABBREVIATIONS = ("e.g.", "i.e.", "cf.", "vs.", "etc.", "al.", "fig.", "eq.", "no.", "dr.", "mr.", "mrs.", "ms.", "prof.", "st.", "approx.", "vol.", "pp.", "ref.", "sec.")
SENTENCE_GAP = re.compile(r"(?<=[.!?])\s+(?=[\"'(\[]?[A-Z0-9])")
#: What Python strips and `\s` of its patterns finds.
_SPACES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "ft", "ﬆ": "st"}
PLAIN = {
    "‘": "'", "’": "'", "‚": "'", "“": '"', "”": '"', "„": '"',
    "‐": "-", "‑": "-", "−": "-", " ": " ", " ": " ", " ": " ",
}
INVISIBLE = "​‌‍⁠﻿"


def lexical_tokens(text: Column) -> Column:
    """Lower-case tokens of the lexical index; none for null."""
    return F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(LEXICAL), F.lit(0)), F.lower)


def token_estimate(text: Column) -> Column:
    """Subword count estimate: pieces (words, single signs) times 1.25, rounded down."""
    pieces = F.size(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(PIECE), F.lit(0)))
    return F.floor(pieces * F.lit(SUBWORD_FACTOR)).cast("int")


def collapse_whitespace(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"(?U)\s+", " "), "^ | $", "")


def mask_digits(text: Column) -> Column:
    return F.regexp_replace(text, "[0-9]+", "#")


def furniture_key(text: Column) -> Column:
    """What running heads of different pages share; null for texts too short or too long to be one."""
    flat = collapse_whitespace(text)
    return F.when(F.length(flat).between(2, 200), F.lower(mask_digits(flat)))


def probably_numeric(text: Column) -> Column:
    """At least 40 % of what is not white space are digits or number signs."""
    dense = F.regexp_replace(text, r"(?U)\s", "")
    signs = F.regexp_replace(dense, r"[^0-9.,%$()\-+]", "")
    return (F.length(dense) > 0) & (F.length(signs) >= 0.4 * F.length(dense))


def quality(text: Column) -> Column:
    """struct: n_chars, n_replacement, n_alpha, replacement_ratio, alpha_ratio, is_usable."""
    t = F.coalesce(text, F.lit(""))
    n, bad = F.length(t), F.length(F.regexp_replace(t, "[^\uFFFD]", ""))
    alpha = F.length(F.regexp_replace(t, r"[^\p{L}]", ""))
    ratio = F.when(n > 0, bad / n).otherwise(0.0)
    return F.struct(
        n.alias("n_chars"), bad.alias("n_replacement"), alpha.alias("n_alpha"), ratio.alias("replacement_ratio"),
        F.when(n > 0, alpha / n).otherwise(0.0).alias("alpha_ratio"), ((n > 0) & (ratio < 0.1)).alias("is_usable"),
    )


def _nfkc(text: Column) -> Column:
    """Compatibility forms by the ICU library in Spark's own jars, so a text goes through the JVM alone, one row at a time."""
    return F.when(text.isNotNull(), F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), text, F.lit(True)))


def normalize_basic(text: Column) -> Column:
    """normalize() after the compatibility forms: signs, line ends, control characters, hyphenation, spacing."""
    out = F.translate(text, "".join(PLAIN) + INVISIBLE, "".join(PLAIN.values()))
    for sign, letters in LIGATURES.items():
        out = F.replace(out, F.lit(sign), F.lit(letters))
    for pattern, to in ((r"\r\n?", "\n"), (r"[\x00-\x08\x0b-\x1f\x7f]", ""), (r"([a-z])-\n([a-z])", "$1$2"), (r"[ \t]+\n", "\n"), (r"[ \t]{2,}", " "), (r"\n{3,}", "\n\n")):
        out = F.regexp_replace(out, pattern, to)
    return F.regexp_replace(out, r"(?U)^\s+|\s+$", "")


def normalize(text: Column) -> Column:
    """Canonical text; applying it again changes nothing."""
    return normalize_basic(_nfkc(text))


def split_sentences(text: str | None) -> list[str]:
    """Sentences of a text, paragraphs first; a piece that ends in an abbreviation or an initial goes on."""
    out: list[str] = []
    for paragraph in (text or "").split("\n\n"):
        open_ = False
        for piece in SENTENCE_GAP.split(paragraph.strip()):
            piece = piece.strip()
            if not piece:
                continue
            if open_:
                out[-1] += " " + piece
            else:
                out.append(piece)
            last = piece.rsplit(None, 1)[-1].lower()
            open_ = last in ABBREVIATIONS or len(last) == 2 and last[1] == "." and last[0].isalnum()
    return out


@functools.cache
def _gaps() -> tuple[str, str]:
    """Java patterns of the gaps that split_sentences() closes up and of those where it parts; letters and digits are Python's, as the JVM's may be of an older Unicode."""
    known = [c for c in range(0x110000) if chr(c).isalnum() and len(chr(c).lower()) == 1]
    firsts = [c for k, c in enumerate(known) if not k or known[k - 1] != c - 1]
    lasts = [c for k, c in enumerate(known) if k + 1 == len(known) or known[k + 1] != c + 1]
    initial = "".join(f"{chr(a)}-{chr(z)}" for a, z in zip(firsts, lasts, strict=True))
    word = rf"(?:\A|[{_SPACES}])(?:(?i:{'|'.join(map(re.escape, ABBREVIATIONS))})|(?=.\.)[{initial}]\.)"
    gap, ahead = f"[{_SPACES}]++", r"[\"'(\[]?[A-Z0-9]"
    return rf"\.(?={gap}{ahead})(?<={word}){gap}", rf"([.!?])(?={gap}{ahead})(?<!{word}){gap}"


def sentences(text: Column) -> Column:
    """split_sentences() as patterns; none for null. A paragraph has no empty line, so one can stand for a gap where it parts."""
    goes_on, parts = _gaps()
    paragraphs = F.split(F.coalesce(text, F.lit("")), "\n\n")
    marked = F.transform(paragraphs, lambda p: F.regexp_replace(F.regexp_replace(F.btrim(p, F.lit(_SPACES)), goes_on, ". "), parts, "$1\n\n"))
    return F.filter(F.split(F.array_join(marked, "\n\n"), "\n\n"), lambda s: s != "")


def context_header(title: Column, section: Column, subsection: Column) -> Column:
    """title > section > subsection without repeats; headings over 80 characters don't serve."""
    usable = [F.when(F.length(collapse_whitespace(c)).between(1, 80), collapse_whitespace(c)) for c in (section, subsection)]
    return F.array_join(F.array_distinct(F.array_compact(F.array(F.nullif(collapse_whitespace(title), F.lit("")), *usable))), " > ")


def markdown_table(columns: Column, rows: Column) -> Column:
    """A Markdown grid; null cells are blank, bars escaped, line breaks spaces."""

    def line(cells: Column) -> Column:
        clean = F.transform(cells, lambda c: F.regexp_replace(F.replace(F.coalesce(c, F.lit("")), F.lit("|"), F.lit("\\|")), r"\s*\n\s*", " "))
        return F.concat(F.lit("| "), F.array_join(clean, " | "), F.lit(" |"))

    rule = F.concat(F.lit("| "), F.array_join(F.transform(columns, lambda _: F.lit("---")), " | "), F.lit(" |"))
    return F.array_join(F.concat(F.array(line(columns), rule), F.transform(rows, line)), "\n")


def citations(answer: Column) -> Column:
    """Cited source numbers of [1] and [1, 2] in order of first mention."""
    groups = F.regexp_extract_all(F.coalesce(answer, F.lit("")), F.lit(CITATION), F.lit(1))
    return F.array_distinct(F.flatten(F.transform(groups, lambda g: F.transform(F.split(g, ","), lambda x: F.trim(x).cast("int")))))


def key_tokens(text: Column) -> Column:
    """Digit-bearing tokens that a fact hangs on: lower case, outer dots and commas cut."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"[A-Za-z0-9][A-Za-z0-9_.,%\-/]*"), F.lit(0))
    cut = F.transform(found, lambda t: F.lower(F.regexp_replace(t, r"^[.,]+|[.,]+$", "")))
    return F.filter(cut, lambda t: t.rlike("[0-9]"))


def redact(text: Column) -> Column:
    return F.regexp_replace(text, SECRET, "[redacted]")
