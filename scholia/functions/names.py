"""Author-name functions (inventory N11 to N19)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from scholia.functions.text import once


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def token_set(name: Column | str) -> Column:
    """The name's distinct lower-case words in order; two names match if these are equal."""
    return F.array_sort(F.array_distinct(F.split(F.lower(F.trim(_col(name))), r"\s+")))


def same_name(a: Column | str, b: Column | str) -> Column:
    return token_set(a) == token_set(b)


def author_tokens(name: Column | str) -> Column:
    """Words of a name without braces, quotes and punctuation; trailing dots dropped."""
    kept = F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(_col(name), F.lit(""))), r"""[{}"']""", ""), r"[^\w\-\s]", " ")
    return F.filter(F.split(kept, r"\s+"), lambda t: t != "")


def tokens_match(a: Column, b: Column) -> Column:
    """A shared word, or a single letter that begins a word of the other name; False if either is empty."""
    initial = lambda x, y: F.exists(x, lambda s: (F.length(s) == 1) & F.exists(y, lambda t: F.startswith(t, s)))
    return (F.size(a) > 0) & (F.size(b) > 0) & (F.arrays_overlap(a, b) | initial(a, b) | initial(b, a))


def literal_list(text: Column | str) -> Column:
    """The items of an array literal {"a","b",c}; quoted items may hold commas."""
    body = F.regexp_replace(_col(text), r"^\{|\}$", "")
    items = F.regexp_extract_all(body, F.lit(r'("(?:[^"\\]|\\.)*"|[^,"]+)'), F.lit(1))
    return F.filter(F.transform(items, lambda i: F.trim(F.regexp_replace(i, r'^"|"$', ""))), lambda i: i != "")


def is_initial(token: Column) -> Column:
    """One letter, or single letters joined by hyphens; dots don't count."""
    return F.replace(token, F.lit("."), F.lit("")).rlike(r"^[A-Za-z](-[A-Za-z])*$")


def name_tokens(name: Column | str) -> Column:
    """Pieces of letters, digits, apostrophes and hyphens."""
    return F.filter(F.split(_col(name), r"[^0-9A-Za-z'\-]+"), lambda t: t != "")


def surname_candidates(name: Column | str) -> Column:
    """The last and the first piece that isn't an initial, the last piece, the last two together; distinct."""

    def candidates(both: Column) -> Column:
        parts, words = both["parts"], both["words"]
        last_two = F.when(F.size(parts) > 1, F.array_join(F.slice(parts, -2, 2), " "))
        found = F.array(F.try_element_at(words, F.lit(-1)), F.try_element_at(words, F.lit(1)), F.try_element_at(parts, F.lit(-1)), last_two)
        return F.array_distinct(F.transform(F.filter(found, lambda c: c.isNotNull()), F.lower))

    return once(name_tokens(name), lambda parts: once(F.struct(parts.alias("parts"), F.filter(parts, lambda t: ~is_initial(t)).alias("words")), candidates))


def given_tokens(name: Column | str, surname: Column) -> Column:
    """The pieces that are neither initials nor the surname."""
    return F.filter(F.transform(name_tokens(name), F.lower), lambda t: ~is_initial(t) & (t != surname))


def words_with_positions(text: Column | str) -> Column:
    """The words of a text with their places from 0, as an array of structs."""
    words = F.regexp_extract_all(_col(text), F.lit(r"([0-9a-zA-Z'\-]+)"), F.lit(1))
    return F.transform(words, lambda w, i: F.struct(i.alias("pos"), w.alias("word")))
