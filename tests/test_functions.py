import difflib
import uuid

import pytest
from pyspark.sql import functions as F

from scholia.functions import citations as C
from scholia.functions import names as N
from scholia.functions import text as X
from scholia.operators.references import references_of


def value(spark, column, **cells):
    schema = ", ".join(f"{k} {'array<string>' if isinstance(v, list) else 'string'}" for k, v in cells.items())
    return spark.createDataFrame([tuple(cells.values())], schema).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize("raw, want", [("Sébastien  Jean!", "sebastien jean"), ("M.-T Luong", "mt luong"), (None, ""), ("", ""), ("ﬁne\xa0Ünit", "fine unit"), ("łódź", "odz")])
def test_normalize_text(spark, raw, want):
    assert value(spark, X.normalize_text("c"), c=raw) == want


def test_normalize_name_keeps_hyphens(spark):
    assert value(spark, X.normalize_name("c"), c="M.-T Luong") == "m -t luong"
    assert value(spark, X.normalize_name("c"), c="O'Neill, Zoë") == "o'neill zoe"


def test_normalize_list(spark):
    assert value(spark, X.normalize_list("c"), c=["Jéan\nX", None, "B-C"]) == ["jean x", "", "bc"]
    assert value(spark, X.normalize_list("c"), c=[]) == []


def test_uuid5_equals_python(spark):
    for name in ("1706.03762", "", "é…"):
        assert value(spark, X.uuid5("c"), c=name) == str(uuid.uuid5(uuid.NAMESPACE_DNS, name))
    assert value(spark, X.uuid5("c"), c="1706.03762") == "0fb90b8d-1beb-546a-ae87-17dfd8d15dbd"


@pytest.mark.parametrize("raw, want", [("arXiv: 2401.12345v2", "2401.12345v2"), ("none", None), ("x 0911.3009 y", "0911.3009")])
def test_clean_id(spark, raw, want):
    assert value(spark, X.clean_id("c"), c=raw) == want


def test_ids_in_urls_text_and_paths(spark):
    assert value(spark, X.id_in_url("c"), c="http://arxiv.org/pdf/hep-th/9901001v2") == "hep-th/9901001v2"
    assert value(spark, X.references_in_text("c"), c="arXiv:2401.12345 and ARXIV: 2401.12345v1, https://arxiv.org/abs/2401.99999") == ["arXiv:2401.12345", "ARXIV: 2401.12345v1", "2401.99999"]
    assert value(spark, X.id_from_path("c"), c="/data/hep-th_9901001.pdf") == "hep-th/9901001"
    assert value(spark, X.file_name("c", "t"), c=None, t='a/b: "c"?') == "ab c.pdf"


def test_format_authors(spark):
    df = spark.sql("SELECT array(named_struct('keyname', 'Luong', 'forenames', 'Minh-Thang'), named_struct('keyname', 'Doe', 'forenames', NULL), named_struct('keyname', '', 'forenames', '')) AS a")
    assert df.select(X.format_authors("a").alias("v")).first()["v"] == ["Luong Minh-Thang", "Doe"]


def test_parse_date(spark):
    none = F.lit(None).cast("date")
    assert str(value(spark, X.parse_date("c", none), c="2020-02-03T10:00:00Z")) == "2020-02-03"
    assert value(spark, X.parse_date("c", none), c="2020-13-03") is None and value(spark, X.parse_date("c"), c="x") is not None


@pytest.mark.parametrize("raw, want", [("[5,6]", [("[5,6]", [5, 6])]), ("[4,[7][8]", [("[4,[7]", [4, 7]), ("[8]", [8])]), ("[1-3] [3-1] [abc]", [("[1-3]", [1, 2, 3]), ("[3-1]", []), ("[abc]", [])]), ("[1–3]", [("[1–3]", [1, 3])]), ("none", [])])
def test_markers(spark, raw, want):
    found = value(spark, C.markers("c"), c=raw)
    assert [(m["marker"], [n for r in m["ranges"] for n in range(r["low"], r["high"] + 1)]) for m in found] == want
    assert all([r["at"] for r in m["ranges"]] == [sum(s["high"] - s["low"] + 1 for s in m["ranges"][:k]) for k in range(len(m["ranges"]))] for m in found)


@pytest.mark.parametrize("entry, want", [("[3] Some title", "numeric"), ("12. Title", "numeric"), ("Smith and Doe. Title. 2004", "author_year"), ("x et al. 1999", "author_year"), ("no year here", "ambiguous")])
def test_entry_kinds(spark, entry, want):
    assert value(spark, C.entry_kind("c"), c=entry) == want


def decision(spark, **counts):
    names = ("bib", "numeric", "author_year_entries", "bracket", "author_year", "superscript", "body_bracket", "body_author_year", "body_superscript")
    df = spark.createDataFrame([tuple(counts.get(n, 0) for n in names)], ", ".join(f"{n} int" for n in names))
    r = df.select(C.style_decision(*(F.col(n) for n in names)).alias("d")).first()["d"]
    return r["numbered"], r["reason"]


@pytest.mark.parametrize(
    "counts, want",
    [
        ({"bib": 10, "numeric": 6}, (True, "bibliography_majority_numeric")), ({"bib": 10, "numeric": 5, "author_year_entries": 6}, (False, "bibliography_majority_author_year")),
        ({"author_year": 3, "bracket": 1}, (False, "sections_author_year_strong")), ({"bracket": 2, "superscript": 2}, (True, "sections_bracket_strong")),
        ({"superscript": 4}, (True, "sections_superscript_strong")), ({"author_year": 5, "bracket": 3, "superscript": 1}, (False, "sections_author_year_dominate")),
        ({"body_bracket": 5, "body_superscript": 3}, (True, "body_bracket_fallback")), ({"body_author_year": 8}, (False, "body_author_year_fallback")),
        ({"bib": 4, "numeric": 4}, (False, "conservative_default_no_clear_numeric_evidence")),
    ],
)
def test_style_rules(spark, counts, want):
    assert decision(spark, **counts) == want


def test_reference_lists(spark):
    text = "See [1].\nReferences\nold\nREFERENCES\n[1] A. Title arXiv:2001.00001 end.\n[2] B.\n second line\n3. C third\n[1] repeated"
    tail = value(spark, C.reference_tail("c"), c=text)
    assert tail.startswith("REFERENCES\n[1]")
    docs = spark.createDataFrame([("d", text), ("mixed", "References\n1. dot first\n[1] bracket first\n2. x arxiv:1 y"), ("loose", "References: see [7] Seven\n\n[8] Eight"), ("none", "nothing"), ("null", None)], "k string, t string")
    got = {}
    for r in references_of(docs, "k", "t").collect():
        got.setdefault(r["k"], {})[r["number"]] = r["reference"]
    assert got["d"] == {"1": "A. Title end.", "2": "B. second line", "3": "C third"} and got["mixed"] == {"1": "bracket first", "2": "x y"}
    assert set(got) == {"d", "mixed", "loose"} and got["loose"]["8"] == "Eight"
    assert len(value(spark, C.reference_tail("c", 10), c="x" * 50)) == 10


def test_short_and_full_entries(spark):
    assert value(spark, C.short_surnames("c"), c="D. Bahdanau et al.2015]") == ["bahdanau"]
    assert value(spark, C.is_full_entry("c"), c="Maclaurin") is True  # a known quirk: a venue's name inside a word
    assert value(spark, C.is_full_entry("c"), c="Fraser and Marcu2007]") is False
    assert value(spark, C.raw_authors("c"), c="Smith, J. and Doe, A. (2001) Title") == "Smith, J. and Doe, A."
    assert value(spark, C.split_authors("c"), c="John Smith, Anna Doe and Bo Li; Cy Ng,") == ["John Smith", "Anna Doe", "Bo Li", "Cy Ng"]


def test_name_functions(spark):
    assert value(spark, N.same_name("a", "b"), a="Jean  Dupont", b="dupont JEAN") is True
    assert value(spark, N.tokens_match(N.author_tokens("a"), N.author_tokens("b")), a="Luong, M.", b="minh thang") is True
    assert value(spark, N.tokens_match(N.author_tokens("a"), N.author_tokens("b")), a="Luong", b="minh") is False
    assert value(spark, N.literal_list("c"), c='{"Doe, A",B}') == ["Doe, A", "B"]
    assert value(spark, N.surname_candidates("c"), c="D. Bahdanau Kim J.") == ["kim", "bahdanau", "j", "kim j"]
    assert difflib.SequenceMatcher(None, "bahdanau", "bahdanu").ratio() > 0.92


def test_identifiers_in_any_case(spark):
    found = value(spark, X.references_in_text("c"), c="see ARXIV: 2101.12345V2 and arXiv:2101.1234")
    assert found == ["ARXIV: 2101.12345V2", "arXiv:2101.1234"] and value(spark, X.base_id("c"), c="ARXIV:2101.12345v2") == "2101.12345"
