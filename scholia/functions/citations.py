"""Citation and bibliography text functions (inventory C1 to C17)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from scholia.functions.text import once

#: The citation patterns, written so that RE2 reads them alike.
_SPAN = r"\s*\d+(?:\s*(?:,|;|:|\-|–|—)\s*\d+)*(?:\s*(?:\-|–|—)\s*\d+)?\s*"
BRACKETED = rf"\[{_SPAN}\]"
PARENTHESISED = rf"\({_SPAN}\)"
AUTHOR_YEAR = (
    r"\([A-Z][A-Za-z\-\s\.]+(?:et al\.|and [A-Z][A-Za-z\-]+)?,?\s*(?:19|20)\d{2}\)"
    r"|\b[A-Z][A-Za-z\-\.\s]+et al\.\s*\(\s*(?:19|20)\d{2}\s*\)"
    r"|\b[A-Z][A-Za-z\-\.\s]+\,\s*(?:19|20)\d{2}\b"
)
YEAR = r"\b(?:19|20)\d{2}\b"
LABEL = r"^\s*\[\s*\d+\s*\]"
LEADING_NUMBER = r"^\s*(?:\d{1,4}\s*[\.\)]\s+|\d{1,4}\s+-\s+)"
SMALL_NUMBER = r"\b\d{1,3}\b"
NAMES = r"[A-Z][a-z]{2,}\s+(and|&|,|\.)"
SUPERSCRIPT = "[¹²³⁰-⁹]"
MARKER = r"\[([^\]]+)\]"
FULL_ENTRY = r"\b(19|20)\d{2}\.\s+[A-Za-z]"
NAME_BLOCK = r"(?i)^\s*([A-Za-z][A-Za-z\-\.\s]*)\s*(?:et\s+al\.?|and)\s*\.?\s*(?:\]?)(?:\D|$)"
FULL_WORDS = (" in ", "iclr", "acl", "nips", "emnlp", "in proceedings", "computational")
RAW_AUTHORS = r"^(.+?)(?:\.\s*(?:19|20)\d{2}|\s*\((?:19|20)\d{2}\))"
AUTHOR_SPLIT = r"\s+and\s+|;\s*|(?<=\w),\s+(?=[A-Z][a-z])"
HEADINGS = ("references", "references and notes", "bibliography", "literature cited", "reference list", "citations", "references & notes")
SECTION_WORDS = ("introduction", "related", "related work", "background", "method", "methods", "approach", "experiments", "evaluation", "results")
TAIL_CHARS = 40_000


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def occurrences(text: Column | str, pattern: str) -> Column:
    return F.coalesce(F.regexp_count(_col(text), F.lit(pattern)), F.lit(0))


def style_counts(text: Column | str) -> Column:
    """What kinds of citation a text holds, as a struct of counts."""
    kinds = {"bracket": BRACKETED, "paren": PARENTHESISED, "author_year": AUTHOR_YEAR, "superscript": SUPERSCRIPT, "raw_numeric": SMALL_NUMBER}
    return F.struct(*(occurrences(text, p).alias(k) for k, p in kinds.items()))


def entry_kind(entry: Column | str) -> Column:
    """C6/A8: 'numeric', 'author_year' or 'ambiguous'; the first rule that fits decides."""
    entry = _col(entry)
    year = entry.rlike(YEAR)
    return (
        F.when(entry.rlike(LABEL) | entry.rlike(LEADING_NUMBER), "numeric")
        .when(year & entry.rlike(NAMES), "author_year")
        .when(year & F.contains(entry, F.lit("et al.")), "author_year")
        .otherwise("ambiguous")
    )


def style_decision(
    bib: Column, numeric: Column, author_year_entries: Column, bracket: Column, author_year: Column, superscript: Column,
    body_bracket: Column, body_author_year: Column, body_superscript: Column, min_bib: int = 5, ratio: float = 0.6,
) -> Column:
    """(numbered, reason), by the first of nine rules that holds."""
    most = F.greatest(F.lit(2), F.floor(bib * ratio).cast("int"))
    rules = (
        ((bib >= min_bib) & (numeric >= most), True, "bibliography_majority_numeric"),
        ((bib >= min_bib) & (author_year_entries >= most), False, "bibliography_majority_author_year"),
        ((author_year >= 3) & (bracket + superscript <= 1), False, "sections_author_year_strong"),
        ((bracket >= 4) | ((bracket >= 2) & (superscript >= 2)), True, "sections_bracket_strong"),
        (superscript >= 4, True, "sections_superscript_strong"),
        ((author_year >= 4) & (author_year > bracket + superscript), False, "sections_author_year_dominate"),
        ((body_bracket >= 8) | ((body_bracket >= 5) & (body_superscript >= 3)), True, "body_bracket_fallback"),
        ((body_author_year >= 8) & (body_author_year > body_bracket + body_superscript), False, "body_author_year_fallback"),
    )
    out = F
    for condition, numbered, reason in rules:
        out = out.when(condition, F.struct(F.lit(numbered).alias("numbered"), F.lit(reason).alias("reason")))
    return out.otherwise(F.struct(F.lit(False).alias("numbered"), F.lit("conservative_default_no_clear_numeric_evidence").alias("reason")))


def markers(text: Column | str) -> Column:
    """C11: every bracketed marker with the ranges of numbers it stands for, in order: a number alone is a range of one.

    ``low`` and ``high`` are BIGINT, ``at`` is the place of ``low`` among the marker's numbers. A descending
    range stands for nothing, and so does a number beyond BIGINT. `expand_range` makes the numbers.
    """

    def limits(token: Column) -> Column:
        low, high = F.split_part(token, F.lit("-"), F.lit(1)).try_cast("bigint"), F.split_part(token, F.lit("-"), F.lit(2))
        return F.struct(low.alias("low"), F.when(high == "", low).otherwise(high.try_cast("bigint")).alias("high"))

    def placed(state: Column, r: Column) -> Column:
        one = F.struct(r["low"], r["high"], state["n"].alias("at"))
        return F.struct((state["n"] + r["high"] - r["low"] + 1).alias("n"), F.concat(state["done"], F.array(one)).alias("done"))

    def ranges(inner: Column) -> Column:
        each = F.filter(F.transform(F.regexp_extract_all(inner, F.lit("([0-9]+(?:-[0-9]+)?)"), F.lit(1)), limits), lambda r: r["high"] >= r["low"])
        start = F.struct(F.lit(0).cast("bigint").alias("n"), F.array().cast("array<struct<low:bigint,high:bigint,at:bigint>>").alias("done"))
        return F.aggregate(each, start, placed, lambda state: state["done"])

    inner = F.regexp_extract_all(_col(text), F.lit(MARKER), F.lit(1))
    return F.transform(inner, lambda m: F.struct(F.concat(F.lit("["), m, F.lit("]")).alias("marker"), ranges(m).alias("ranges")))


#: Numbers of a range that are made at a time.
RANGE_BLOCK = 1 << 16


def range_blocks(low: Column, high: Column) -> Column:
    """The first numbers of the blocks of a range, to be exploded; a block's own numbers come from `block_numbers`."""
    return F.transform(F.sequence(F.lit(0).cast("bigint"), F.floor((high - low) / RANGE_BLOCK)), lambda i: low + i * RANGE_BLOCK)


def block_numbers(first: Column, high: Column) -> Column:
    return F.sequence(first, F.least(high, first + RANGE_BLOCK - 1))


def reference_tail(text: Column | str, tail_chars: int = TAIL_CHARS) -> Column:
    """From the last heading of a reference list to the end, else the last ``tail_chars`` characters."""

    def cut(both: Column) -> Column:
        text, backwards = both["text"], both["back"]

        def begin(heading: str) -> Column:
            p = F.position(F.lit(heading[::-1]), backwards)
            return F.when(p == 0, 0).otherwise(F.length(text) - p - len(heading) + 2)

        start = F.greatest(*(begin(h) for h in HEADINGS))
        tail = F.greatest(F.lit(1), F.length(text) - tail_chars + 1)
        return once(start, lambda s: F.substring(text, F.when(s > 0, s).otherwise(tail), F.length(text)))

    return once(_col(text), lambda t: once(F.struct(t.alias("text"), F.reverse(F.lower(t)).alias("back")), cut))


#: C10, entries as [n] and as n., each up to where the next one begins; and the looser form where there are none.
BRACKET_ENTRY = r"(?s)(?:^|\n)\s*\[\s*(\d+)\s*\]\s*(.*?)\s*(?=(?:\n\s*\[\s*\d+\s*\])|(?:\n\s*\d+\s*[\.\)])|$)"
DOT_ENTRY = r"(?s)(?:^|\n)\s*(\d+)\s*\.\s*(.*?)\s*(?=(?:\n\s*\d+\s*\.)|(?:\n\s*\[\s*\d+\s*\])|$)"
LOOSE_ENTRY = r"(?s)\[\s*(\d+)\s*\]\s*(.*?)\s*(?=(?:\n\s*\[\s*\d+\s*\])|(?:\n\s*$)|$)"
ARXIV_MENTION = r"(?i)\s*arXiv[:\s]\S+\s*"


def numbered_entries(tail: Column | str) -> Column:
    """The entries (num, text) of a reference list in order of precedence: all in brackets, then all with a dot.

    The first of a number counts; `operators.references.references_of` picks it. Where neither form
    occurs, a looser one is read. Mentions of arXiv drop out of the texts.
    """

    def entries(text: Column, pattern: str) -> Column:
        begin = r"^\s*(?:\[\s*\d+\s*\]|\d+\s*\.)\s*"
        part = lambda m: F.struct(F.regexp_extract(m, r"(\d+)", 1).alias("num"), F.regexp_replace(m, begin, "").alias("text"))
        return F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), part)

    # Each stage is bound to a variable, so that the tail and the entries are made once.
    anchored = once(_col(tail), lambda t: F.struct(t.alias("tail"), F.concat(entries(t, BRACKET_ENTRY), entries(t, DOT_ENTRY)).alias("found")))
    return once(anchored, lambda a: F.when(F.size(a["found"]) > 0, a["found"]).otherwise(entries(a["tail"], LOOSE_ENTRY)))


def entry_text(text: Column | str) -> Column:
    """An entry in one line, without mentions of arXiv."""
    one_line = F.regexp_replace(F.regexp_replace(_col(text), r"(?U)\s+", " "), r"^ | $", "")
    return F.trim(F.regexp_replace(F.regexp_replace(one_line, ARXIV_MENTION, " "), r"(?U)\s{2,}", " "))


def find_year(entry: Column | str) -> Column:
    """The first 19xx or 20xx, with no word boundary asked; null without one."""
    return F.nullif(F.regexp_extract(_col(entry), r"((?:19|20)[0-9]{2})", 1), F.lit(""))


def short_surnames(entry: Column | str) -> Column:
    """C14: family names of a short citation: the last word of each name, letters and hyphens, lower case."""
    entry = _col(entry)
    block = F.regexp_extract(entry, NAME_BLOCK, 1)
    before_year = F.regexp_extract(entry, r"^(.*?)[0-9]{4}", 1)
    head = F.when(block != "", block).when(before_year != "", before_year).otherwise(entry)
    names = F.split(head, r"[,;]| and | & ")
    last = F.transform(names, lambda n: F.lower(F.regexp_replace(F.element_at(F.split(F.trim(n), r"\s+"), -1), r"[^A-Za-z\-]", "")))
    return F.array_distinct(F.filter(last, lambda n: n != ""))


def is_full_entry(entry: Column | str) -> Column:
    """C15: 'year. Word', a word of a venue, or more than 60 characters."""
    entry = _col(entry)
    low = F.lower(entry)
    word = F.lit(False)
    for w in FULL_WORDS:
        word = word | F.contains(low, F.lit(w))
    return entry.rlike(FULL_ENTRY) | word | (F.length(entry) > 60)


def raw_authors(entry: Column | str) -> Column:
    """What stands before the year, else a first sentence of 2 to 8 words, else null."""
    entry = _col(entry)
    before = F.regexp_extract(entry, RAW_AUTHORS, 1)
    sentence = F.trim(F.split_part(entry, F.lit("."), F.lit(1)))
    words = F.size(F.split(sentence, r"\s+"))
    return F.when(before != "", F.trim(before)).when((sentence != "") & words.between(2, 8), sentence)


def split_authors(names: Column | str) -> Column:
    """C17: the names of an author string, without trailing commas."""
    parts = F.transform(F.split(_col(names), AUTHOR_SPLIT), lambda n: F.trim(F.regexp_replace(F.trim(n), r",+$", "")))
    return F.filter(parts, lambda n: n != "")
