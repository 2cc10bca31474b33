"""TEI documents: sections, references, bibliographies.

The service that makes TEI from a PDF is a plug-in ``(endpoint, bytes, params) -> (status, bytes)``;
everything here works on a column of TEI, so each document is sent and parsed once.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholia.functions.text import clean_section

REFERENCE = "struct<id:int,raw:string,xml:string,title:string,year:string,doi:string,venue:string,authors_teiled:array<string>,authors_raw_str:string,authors_raw_list:array<string>>"
SECTION = "struct<section_title:string,section_text:string>"
#: services' endpoints, and the containers a bibliography may be in, in order of preference.
FULL_TEXT, REFERENCES_ONLY, ONE_CITATION = "/api/processFulltextDocument", "/api/processReferences", "/api/processCitationList"
CONTAINERS = ("listBibl", "div[@type='references']", "div[@type='bibliography']", "back", "div[@type='references-list']", "note[@type='references']")
_SPLIT = re.compile(r"\n{2,}|\r{2,}|\n\s*\d+\.\s+")


def _local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def _text(element, joiner: str = "") -> str:
    if element is None:
        return ""
    return re.sub(r"\s+", " ", joiner.join(t for t in element.itertext())).strip()


def _all(root, name: str) -> list:
    return [e for e in root.iter() if _local(e.tag) == name]


def _first(root, name: str):
    return next((e for e in root.iter() if _local(e.tag) == name and e is not root), None)


def parse(tei: str | bytes):
    root = ElementTree.fromstring(tei)
    for e in root.iter():  # namespaces don't matter here
        if isinstance(e.tag, str):
            e.tag = _local(e.tag)
    return root


def sections(tei: str | bytes) -> list[dict]:
    """(title, text) of every div, paragraphs joined by empty lines; a text without divs is one 'Document'."""
    root = parse(tei)
    body = _first(root, "body")
    area = body if body is not None else root
    out = []
    for div in _all(area, "div"):
        head = _first(div, "head")
        paragraphs = [t for p in _all(div, "p") if (t := _text(p, " "))]
        title = _text(head, " ")
        if title or paragraphs:
            out.append({"section_title": title, "section_text": "\n\n".join(paragraphs)})
    if not out:
        paragraphs = [t for p in _all(area, "p") if (t := _text(p, " "))]
        whole = "\n\n".join(paragraphs) or _text(area, " ")
        if whole:
            out.append({"section_title": "Document", "section_text": whole})
    return out


def persons(item) -> list[dict]:
    """Forename, surname and raw text of every person named in an item."""
    return [{"forename": _text(p.find("forename")), "surname": _text(p.find("surname")), "raw": _text(p)} for p in _all(item, "persName")]


def names(people: list[dict]) -> list[str]:
    """C19: 'forename surname', or whichever there is, or the raw text; broken names stay apart (Q20)."""
    shown = (" ".join(x for x in (p["forename"], p["surname"]) if x) or p["raw"] for p in people)
    return [n for n in shown if n]


#: What stands before the year of an entry, and what parts its names.
_BEFORE_YEAR = re.compile(r"^(.+?)(?:\.\s*(?:19|20)\d{2}|\s*\((?:19|20)\d{2}\))")
_NAME_SPLIT = re.compile(r"\s+and\s+|;\s*|(?<=\w),\s+(?=[A-Z][a-z])")


def _raw_authors(raw: str) -> str | None:
    """The names before the year, else a first sentence of two to eight words."""
    if found := _BEFORE_YEAR.match(raw):
        return found[1].strip()
    sentence = raw.split(".", 1)[0].strip()
    return sentence if 2 <= len(sentence.split()) <= 8 else None


def _entries(root) -> list:
    """The items of the reference lists: those of a division of references if there is one; an empty list is an item."""
    lists = [e for d in _all(root, "div") if d.get("type") == "references" for e in _all(d, "listBibl")] or _all(root, "listBibl")
    return [item for one in dict.fromkeys(lists) for item in (list(one) or [one])]


def references(tei: str | bytes) -> list[dict]:
    """C20: the references of a document's lists, numbered from 1; the document's own record is none of them."""
    out = []
    for number, item in enumerate(_entries(parse(tei)), 1):
        note = next((n for n in _all(item, "note") if n.get("type") == "raw_reference"), None)
        raw = _text(item if note is None else note)
        title, when, venue = _first(item, "title"), _first(item, "date"), next((t for m in _all(item, "monogr") if (t := m.find("title")) is not None), None)
        ids = [((e.get("type") or "").lower(), _text(e)) for e in _all(item, "idno")]
        labelled = next((v for kind, v in ids if "doi" in kind), None)
        likely = next((v for _, v in ids if "abs/" in v or re.search("arxiv|corr", v, re.I)), None)
        said = _raw_authors(raw)
        listed = [n for part in _NAME_SPLIT.split(said or "") if (n := part.strip().rstrip(","))]
        out.append({
            "id": number, "raw": raw, "xml": ElementTree.tostring(item, encoding="unicode"), "title": None if title is None else _text(title),
            "year": None if when is None else when.get("when") or _text(when), "doi": likely if labelled is None else labelled,
            "venue": next((v for _, v in ids if v), None) if venue is None else _text(venue),
            "authors_teiled": names(persons(item)) or listed, "authors_raw_str": said, "authors_raw_list": listed,
        })
    return out


#: Elements of given and family names in the answer to a single citation.
_GIVEN, _FAMILY = ("forename", "initial", "forenameInitial", "given"), ("surname", "family")


def _own(element) -> str:
    return (element.text or "").strip()


def _person(element) -> str:
    """The name parts of a person in order, else the person's own text."""
    parts = [t for e in element if e.tag in _GIVEN + _FAMILY and (t := _own(e))]
    return " ".join(parts) or _own(element)


def _author(element) -> str:
    """The name of an author without a person inside: given names before the family name, else whatever text there is."""
    if (inner := element.find("persName")) is not None:
        return _person(inner)
    given = [t for e in element if e.tag in _GIVEN if (t := _own(e))]
    family = [t for e in element if e.tag in _FAMILY if (t := _own(e))]
    return " ".join(given + family[-1:]) or "".join(e.text or "" for e in element).strip() or _own(element)


def citation(tei: str | bytes) -> list[dict]:
    """Title and authors of every item in the answer to a single citation; none if it can't be parsed."""
    try:
        root = parse(tei)
    except ElementTree.ParseError:
        return []
    out = []
    for item in _all(root, "biblStruct"):
        title = next((t for e in _all(item, "title") if (t := _own(e))), "")
        people = [n for p in _all(item, "persName") if (n := _person(p))] or [n for a in _all(item, "author") if (n := _author(a))]
        out.append({"title": title, "authors_teiled": list(dict.fromkeys(people))})
    return out


def bibliography(tei: str | bytes) -> list[str]:
    """The distinct entries of the first container that has any, in order."""
    root = parse(tei)
    entries: list[str] = []
    for path in CONTAINERS:
        for container in root.findall(f".//{path}"):
            items = [e for e in container.iter() if e.tag in ("biblStruct", "bibl", "listItem", "li", "item")] or _all(container, "p")
            entries += [_text(e, " ") for e in items] if items else [p.strip() for p in _SPLIT.split("".join(container.itertext())) if len(p.strip()) > 20]
        if entries:
            break
    else:
        entries = [_text(e, " ") for e in root.iter() if e.tag in ("biblStruct", "bibl")]
    return list(dict.fromkeys(re.sub(r"\s+", " ", e).strip() for e in entries if e.strip()))


def _parsed(kind: str, parse_one: Callable[[str], list]):
    @F.arrow_udf(f"struct<items:array<{kind}>,error:string>")
    def run(column: pa.Array) -> pa.Array:
        rows = []
        for tei in column.to_pylist():
            try:
                rows.append({"items": parse_one(tei) if tei else [], "error": None})
            except Exception as e:  # a broken document is a row with an error, not a failed job
                rows.append({"items": [], "error": f"{type(e).__name__}: {e}"})
        return pa.array(rows, type=_ARROW[kind])

    return run


_REF_ARROW = pa.struct([("id", pa.int32()), *((n, pa.string()) for n in ("raw", "xml", "title", "year", "doi", "venue")), ("authors_teiled", pa.list_(pa.string())), ("authors_raw_str", pa.string()), ("authors_raw_list", pa.list_(pa.string()))])
_SEC_ARROW = pa.struct([("section_title", pa.string()), ("section_text", pa.string())])
_ARROW = {k: pa.struct([("items", pa.list_(t)), ("error", pa.string())]) for k, t in ((REFERENCE, _REF_ARROW), (SECTION, _SEC_ARROW), ("string", pa.string()))}


def _exploded(rows: DataFrame, key: str, tei: str, kind: str, parse_one) -> DataFrame:
    return rows.select(F.col(key), _parsed(kind, parse_one)(tei).alias("_r")).select(key, F.posexplode_outer("_r.items").alias("pos", "item"), "_r.error")


def section_table(rows: DataFrame, key: str, tei: str = "tei") -> DataFrame:
    """(key, pos, section_title, section_text), entities resolved."""
    each = _exploded(rows, key, tei, SECTION, sections).filter("item IS NOT NULL")
    return each.select(key, "pos", "item.section_title", clean_section("item.section_text").alias("section_text"))


def reference_table(rows: DataFrame, key: str, tei: str = "tei") -> DataFrame:
    """(key, the reference's fields, error); a document that can't be read is one row with its error."""
    each = _exploded(rows, key, tei, REFERENCE, references)
    return each.filter("item IS NOT NULL OR error IS NOT NULL").select(key, "item.*", "error")


def bibliography_table(rows: DataFrame, key: str, tei: str = "tei") -> DataFrame:
    """(key, pos, entry)."""
    return _exploded(rows, key, tei, "string", bibliography).filter("item IS NOT NULL").select(key, "pos", F.col("item").alias("entry"))


def with_tei(files: DataFrame, call: Callable[[str, bytes, dict], tuple[int, bytes]], start_page: int | None = None, end_page: int | None = None) -> DataFrame:
    """``files`` (path, content) with TEI from the service: the full text, or on 204, 503 or an empty answer
    the references alone; and the error where both fail. Called once a file."""
    params = {"consolidateCitations": "0"} | ({"start": str(start_page)} if start_page else {}) | ({"end": str(end_page)} if end_page else {})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            teis, errors = [], []
            for data in batch.column("content").to_pylist():
                tei, error = None, None
                try:
                    for endpoint in (FULL_TEXT, REFERENCES_ONLY):
                        status, body = call(endpoint, data, params)
                        if status == 200 and body:
                            tei = body.decode("utf-8", "replace")
                            break
                        error = f"status {status}"
                        if status not in (200, 204, 503):
                            break
                except Exception as e:
                    error = f"{type(e).__name__}: {e}"
                teis.append(tei), errors.append(None if tei is not None else error)
            yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array(teis, pa.string()), pa.array(errors, pa.string())], ["path", "tei", "error"])

    return files.select("path", "content").mapInArrow(run, "path string, tei string, error string")


_CITATION = "original_citation string, title string, authors_teiled array<string>, error string"


def citation_table(citations: DataFrame, text: str, call: Callable[[str, str, dict], tuple[int, bytes]]) -> DataFrame:
    """(original_citation, title, authors_teiled, error): each distinct citation string, parsed by the service.

    One call a distinct string. A call that fails, or an answer without an item, is a row with an error,
    an empty title and no authors. Nulls drop out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for asked in batch.column(0).to_pylist():
                found, error = [], "no item in the answer"
                try:
                    status, body = call(ONE_CITATION, asked, {"citations": asked})
                    if status == 200:
                        found = citation(body)
                    else:
                        error = f"status {status}"
                except Exception as e:  # one failed call must not end the job
                    error = f"{type(e).__name__}: {e}"
                rows += [{"original_citation": asked, "error": None} | f for f in found] or [{"original_citation": asked, "title": "", "authors_teiled": [], "error": error}]
            kind = pa.schema([("original_citation", pa.string()), ("title", pa.string()), ("authors_teiled", pa.list_(pa.string())), ("error", pa.string())])
            yield from pa.Table.from_pylist(rows, kind).to_batches()

    return citations.select(text).filter(F.col(text).isNotNull()).distinct().mapInArrow(run, _CITATION)
