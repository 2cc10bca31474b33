"""Normalisation, hashing and identifier functions (inventory section 2.9)."""

from __future__ import annotations

import html
import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The DNS name space of version-5 UUIDs (RFC 4122).
NAMESPACE_DNS = "6ba7b8109dad11d180b400c04fd430c8"
_WHITE = r"(?U)\s+"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def once(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often ``use`` mentions it."""
    return F.element_at(F.transform(F.array(value), use), 1)


@F.arrow_udf(T.StringType())
def _ascii(column: pa.Array) -> pa.Array:
    return pa.array([None if t is None else t if t.isascii() else unicodedata.normalize("NFKD", t).encode("ascii", "ignore").decode() for t in column.to_pylist()], pa.string())


@F.arrow_udf(T.StringType())
def _unmarked(column: pa.Array) -> pa.Array:
    return pa.array(
        [None if t is None else t if t.isascii() else "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c)) for t in column.to_pylist()], pa.string()
    )


@F.arrow_udf(T.StringType())
def _unescaped(column: pa.Array) -> pa.Array:
    return pa.array([None if t is None else html.unescape(t) for t in column.to_pylist()], pa.string())


def normalize_text(text: Column | str) -> Column:
    """Compatibility decomposition to ASCII, lower case, letters, digits and single spaces; null gives ''.

    Only the decomposition runs in Python; the rest stays in generated code.
    """
    plain = F.regexp_replace(F.lower(_ascii(_col(text))), r"[^a-z0-9\s]", "")
    return F.coalesce(F.trim(F.regexp_replace(plain, r"\s+", " ")), F.lit(""))


def glue(normalized: Column | str) -> Column:
    """A normalised title without its spaces."""
    return F.replace(_col(normalized), F.lit(" "), F.lit(""))


#: Separates the items of a list while it goes through a string function.
_ITEM = "\n"


def normalize_list(names: Column | str) -> Column:
    """N1 over every item; null gives an empty list. One Python call a row, whatever the number of items."""
    names = _col(names)
    joined = F.array_join(F.transform(names, lambda n: F.regexp_replace(F.coalesce(n, F.lit("")), r"\s+", " ")), _ITEM)
    plain = F.regexp_replace(F.lower(_ascii(joined)), r"[^a-z0-9\s]", "")
    items = F.transform(F.split(plain, _ITEM), lambda n: F.trim(F.regexp_replace(n, r"\s+", " ")))
    return F.when(F.size(names) > 0, items).otherwise(F.array().cast("array<string>"))


def format_authors(authors: Column | str) -> Column:
    """N4: 'keyname forenames' of every author struct; null gives an empty list, authors without a name drop out."""
    shown = F.transform(_col(authors), lambda a: F.trim(F.concat_ws(" ", F.nullif(F.trim(a["keyname"]), F.lit("")), F.nullif(F.trim(a["forenames"]), F.lit("")))))
    return F.coalesce(F.filter(shown, lambda n: n != ""), F.array().cast("array<string>"))


_AUTHOR = "struct<keyname:string,forenames:string>"


def author_items(json: Column | str) -> Column:
    """The authors in a JSON text, which may be a list of objects, one object, a bare name or nothing."""
    json = F.trim(_col(json))
    one = lambda kind: F.from_json(json, kind)
    bare = F.array(F.struct(F.regexp_replace(json, '^"|"$', "").alias("keyname"), F.lit(None).cast("string").alias("forenames")))
    listed = F.filter(one(f"array<{_AUTHOR}>"), lambda a: a.isNotNull())
    items = F.when(F.startswith(json, F.lit("[")), listed).when(F.startswith(json, F.lit("{")), F.array(one(_AUTHOR))).when((json != "") & (json != "null"), bare)
    return F.coalesce(items, F.array().cast(f"array<{_AUTHOR}>"))


def normalize_name(name: Column | str) -> Column:
    """Marks dropped, lower case; anything but letters, digits, '-' and apostrophe becomes a space."""
    kept = F.regexp_replace(F.lower(_unmarked(_col(name))), r"[^0-9a-z\-']", " ")
    return F.coalesce(F.trim(F.regexp_replace(kept, r"\s+", " ")), F.lit(""))


def normalize_reference(entry: Column | str) -> Column:
    """Brackets and punctuation as spaces, lower case; accents stay."""
    return F.lower(F.trim(F.regexp_replace(F.regexp_replace(_col(entry), r"""[\[\]().,;:"<>]""", " "), _WHITE, " ")))


def checksum(text: Column | str) -> Column:
    """SHA-256 of the UTF-8 bytes, in hex."""
    return F.sha2(_col(text), 256)


def uuid5(name: Column | str, namespace: str = NAMESPACE_DNS) -> Column:
    """The version-5 UUID of a string, computed without Python."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace)), F.encode(_col(name), "utf-8")))
    variant = F.substring(F.lit("89ab"), F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4 + 1, F.lit(1))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


def chunk_id(checksum_: Column | str, position: Column | str) -> Column:
    """A repeatable id in place of a random one, from the content and its place."""
    return uuid5(F.concat_ws(":", _col(checksum_), _col(position).cast("string")))


#: The default tokenizer, words and single signs; a plug-in may take its place.
TOKEN = r"\w+|[^\w\s]"


def tokens(text: Column | str) -> Column:
    return F.regexp_extract_all(F.coalesce(_col(text), F.lit("")), F.lit(f"(?U)({TOKEN})"), F.lit(1))


def token_count(text: Column | str) -> Column:
    """Number of tokens, 0 for null."""
    return F.size(tokens(text))


def clean_whitespace(text: Column | str) -> Column:
    """Runs of white space as one space, trimmed; null stays null."""
    return F.trim(F.regexp_replace(_col(text), _WHITE, " "))


def clean_section(text: Column | str) -> Column:
    """Entities resolved, spaces before line ends dropped, at most one empty line."""
    plain = F.regexp_replace(_unescaped(_col(text)), r"(?U)\s+\n", "\n")
    return F.regexp_replace(plain, r"\n{3,}", "\n\n")


#: Characters a file name can't have.
UNSAFE = r'[<>:"/\\|?*]'


def file_name(identifier: Column | str, title: Column | str) -> Column:
    """From the identifier (150 characters) or else the title (100)."""
    identifier, title = _col(identifier), _col(title)
    safe = lambda c, n: F.concat(F.substring(F.regexp_replace(c, UNSAFE, ""), 1, n), F.lit(".pdf"))
    return F.when(identifier.isNotNull() & (identifier != ""), safe(identifier, 150)).otherwise(safe(title, 100))


def title_or_default(title: Column | str, display: Column | str) -> Column:
    """The first of title and display name that isn't empty, else 'Untitled'."""
    return F.coalesce(F.nullif(_col(title), F.lit("")), F.nullif(_col(display), F.lit("")), F.lit("Untitled"))


#: An identifier in a URL, and C28: identifiers in a text. The id alone is N20.
URL_ID = r"arxiv\.org/(?:pdf|abs)/([0-9]{4}\.[0-9]{4,5}(?:v[0-9]+)?|[A-Za-z\-]+/[0-9]{7}(?:v[0-9]+)?)"
LABELLED_ID = r"(?i)(arXiv:\s*[0-9]{4}\.[0-9]{4,5}(?:v[0-9]+)?)"
LINKED_ID = r"https?://arxiv\.org/abs/([0-9]{4}\.[0-9]{4,5}(?:v[0-9]+)?)"
PLAIN_ID = r"([0-9]{4}\.[0-9]{4,5}(?:v[0-9]+)?)"


def id_in_url(url: Column | str) -> Column:
    """The identifier in a link to an abstract or PDF, new style or old; null without one."""
    return F.nullif(F.regexp_extract(_col(url), URL_ID, 1), F.lit(""))


def clean_id(reference: Column | str) -> Column:
    """The first new-style identifier, with its version; null without one."""
    return F.nullif(F.regexp_extract(_col(reference), PLAIN_ID, 1), F.lit(""))


def references_in_text(text: Column | str) -> Column:
    """Distinct labelled and linked identifiers."""
    text = _col(text)
    return F.array_union(F.regexp_extract_all(text, F.lit(LABELLED_ID), F.lit(1)), F.regexp_extract_all(text, F.lit(LINKED_ID), F.lit(1)))


def id_from_path(path: Column | str) -> Column:
    """The last part of a path or URL without its extension; '_' stands for '/'."""
    return F.replace(F.regexp_replace(F.element_at(F.split(_col(path), "/"), -1), r"\.[A-Za-z]+$", ""), F.lit("_"), F.lit("/"))


def base_id(identifier: Column | str) -> Column:
    """Q10/Q24: an identifier without label, surrounding space and version."""
    return F.regexp_replace(F.regexp_replace(F.trim(_col(identifier)), r"(?i)^arXiv:\s*", ""), r"v[0-9]+$", "")


def parse_date(value: Column | str, fallback: Column | None = None) -> Column:
    """An ISO day, or the day of an ISO time stamp, else the fallback (today)."""
    value = _col(value)
    day = lambda c: F.when(c.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), F.try_to_date(c, "yyyy-MM-dd"))
    return F.coalesce(day(value), day(F.split_part(value, F.lit("T"), F.lit(1))), F.current_date() if fallback is None else fallback)

