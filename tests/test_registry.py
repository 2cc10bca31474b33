"""Every registered query with SQL gives DuckDB's rows on the smallest test tables."""

import hashlib
import importlib.util
import math
import os
import re
import unicodedata
from collections import Counter
from pathlib import Path

import pyarrow.parquet as pq
import pytest

import __spark_entry__
from scholia.functions import citations as C
from scholia.plans import registry

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER) or importlib.util.find_spec("duckdb") is None, reason="needs the test tables and DuckDB")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for path in Path(FOLDER).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


def shown(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "NULL"
    if isinstance(v, float):
        return f"{v:.5f}" if v != int(v) else str(int(v))
    return str(v)[:19] if hasattr(v, "isoformat") else str(v)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_against_sql(spark, duck, name):
    df = registry.QUERIES[name](spark, FOLDER)
    columns = sorted(df.columns)
    got = sorted(tuple(shown(r[c]) for c in columns) for r in df.collect())
    cursor = duck.execute(registry.ORACLE_SQL[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    assert got == sorted(tuple(shown(r[names.index(c)]) for c in columns) for r in cursor.fetchall())


def whole(name):
    return pq.read_table(f"{FOLDER}/{name}.parquet").to_pylist()


def py_reference_lists():
    """The entries of every composed list by Python's own expressions; the first entry of a number counts."""
    lists = {}
    for r in sorted(whole("citations"), key=lambda r: r["citation_id"]):
        shown = [x for x in (None if r["authors_str"] is None else ", ".join(a for a in r["authors_str"] if a is not None), r["title"]) if x is not None]
        lists.setdefault(r["chunk_seq"], []).append(". ".join(shown))
    out = set()
    for chunk, items in lists.items():
        tail = "References\n" + "\n".join(f"[{i}] {t}" for i, t in enumerate(items, 1))
        tail = tail[max(tail.lower().rfind(h) for h in C.HEADINGS) :]
        found = {}
        for pattern in (C.BRACKET_ENTRY, C.DOT_ENTRY):
            for m in re.finditer(pattern, tail):
                found.setdefault(m[1], m[2])
        for number, text in found.items():
            text = re.sub(C.ARXIV_MENTION, " ", " ".join(text.split()))
            out.add((chunk, number, re.sub(r"\s{2,}", " ", text).strip()))
    return out


def py_exact_titles():
    glued = lambda t: "".join(c for c in unicodedata.normalize("NFKD", t or "").encode("ascii", "ignore").decode().lower() if c.isalnum())
    papers = {}
    for r in whole("papers"):
        papers.setdefault(glued(r["title"]), set()).add(r["id"])
    return {r["id"]: papers[glued(r["title"])] for r in whole("works") if glued(r["title"]) in papers and glued(r["title"])}


def py_sections():
    """Every paper's text with its white space gone, in order."""
    out = {}
    for r in sorted(whole("chunks"), key=lambda r: r["chunk_num"]):
        out.setdefault(r["chunk_paper_id"], []).append(r["chunk_text"] or "")
    return {p: sorted("".join(t.split()) for t in texts if t) for p, texts in out.items()}


def check_reference_lists(rows):
    assert {(r["chunk_seq"], r["number"], r["reference"]) for r in rows} == py_reference_lists() and len(rows) > 100


def check_title_cascade(rows):
    exact = py_exact_titles()
    for r in rows:
        assert (r["id"] in exact[r["query_id"]]) if r["stage"] == "exact" else r["query_id"] not in exact
    assert len({r["query_id"] for r in rows}) == len(rows) > 10 and {r["stage"] for r in rows} <= {"exact", "trigram"}


def check_section_merge_fold(rows):
    texts = {}
    for r in sorted(rows, key=lambda r: r["pos"]):
        texts[r["chunk_paper_id"]] = texts.get(r["chunk_paper_id"], "") + "".join(r["section_text"].split())
    for paper, pieces in py_sections().items():
        assert len(texts.get(paper, "")) == sum(map(len, pieces)) and all(t in texts[paper] for t in pieces)


def check_authors_in_text(rows):
    cited = {(r["chunk_seq"], a) for r in whole("citations") for a in r["authors_str"] or ()}
    texts = {r["chunk_seq"]: r["chunk_text"].lower() for r in whole("chunks")}
    assert rows and len({(r["chunk_seq"], r["author"]) for r in rows}) == len(rows)
    for r in rows:
        assert (r["chunk_seq"], r["author"]) in cited and r["method"] in ("citation", "surname", "fullname", "fuzzy")
        if r["method"] in ("citation", "surname") and texts[r["chunk_seq"]].isascii():
            assert re.search(rf"(?<![0-9a-z]){re.escape(r['details']['candidate'])}(?![0-9a-z])", re.sub(r"[^0-9a-z'-]+", " ", texts[r["chunk_seq"]]))


def check_reference_norm_checksum_all(rows):
    texts = {r["doc_id"]: r["text"] for r in whole("documents")}
    assert {r["doc_id"]: r["checksum"] for r in rows} == {k: None if t is None else hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for k, t in texts.items()}
    assert all(r["norm"] is None or not re.search(r'[\[\]().,;:"<>]|\s\s', r["norm"]) for r in rows)


def check_concept_clusters(rows):
    assert sorted(r["vec_id"] for r in rows) == sorted(r["vec_id"] for r in whole("embeddings")) and 1 < len({r["concept"] for r in rows}) <= 10


def check_hybrid_topk(rows):
    asked = {int(r["id"][1:]) for r in whole("works") if r["title"] is not None and int(r["id"][1:]) % 100 == 0}
    held = {r["chunk_seq"] for r in whole("chunks") if r["chunk_text"] is not None}
    for q in asked:
        mine = sorted((r for r in rows if r["query_id"] == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in mine] == list(range(1, 11)) and [r["score"] for r in mine] == sorted((r["score"] for r in mine), reverse=True) and {r["id"] for r in mine} <= held
    assert {r["query_id"] for r in rows} == asked


def check_enrich_papers(rows):
    n = Counter(r["chunk_paper_id"] for r in whole("chunks") if r["chunk_paper_id"] is not None)
    assert Counter(r["paper_id"] for r in rows) == n and all(r["is_citation_context"] == bool(r["cited"]) for r in rows)
    cited = {r["arxiv_id"] for r in whole("papers")}
    assert any(r["cited"] for r in rows) and all(set(r["cited"]) <= cited for r in rows)


CHECKS = {n.removeprefix("check_"): f for n, f in globals().items() if n.startswith("check_")}


def test_every_query_has_sql_or_a_check():
    assert set(CHECKS) == set(registry.QUERIES) - set(registry.ORACLE_SQL)


@pytest.mark.parametrize("name", sorted(CHECKS))
def test_without_sql(spark, name):
    CHECKS[name](registry.QUERIES[name](spark, FOLDER).collect())


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_nothing_else_imports_the_training_data_package():
    root = Path(registry.__file__).resolve().parents[1]
    for source in root.rglob("*.py"):
        if "llm" not in source.relative_to(root).parts:
            assert "scholia.llm" not in source.read_text()
