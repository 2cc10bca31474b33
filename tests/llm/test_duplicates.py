import json
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from scholia.llm import suffix_index
from scholia.llm.batch_dedup import TextHistory, arxiv_key, banded_distance, repeated_keys, repeated_texts
from scholia.llm.suffix_index import Files
from scholia.llm.format_duplicates import canonical_record, collapse_format_duplicates
from scholia.llm.survivors import best_values, survivors

PAPERS = "id long, title string, title_and_authors string, other string"
def canon():
    return canonical_record(F.col("title_and_authors"), F.col("title"))



def classes(df, **options):
    return sorted((r["id"], r["first_id"], r["copies"]) for r in collapse_format_duplicates(df, canon(), **options).collect())


ROWS = [
    (1, "On a, b", "On a, b | smith j, doe a", "x"),
    (2, "On a b", "ON A B || Doe A; Smith J", "x"),
    (3, "on a,b", "doe a,smith j | on a,b ", "x"),
    (4, "On a, b, part 2", "On a, b, part 2 | smith j, doe a", "x"),
    (5, "On a, b", "On a, b | smith j", "x"),
    (6, None, None, "x"),
    (7, None, None, "x"),
    (8, "", "", "x"),
    (9, "!", " | ", "x"),
    (10, "On-a b", "On-a b | smith j,doe a", "x"),
]
EXPECTED = [(1, 1, 4), (2, 1, 4), (3, 1, 4), (4, 4, 1), (5, 5, 1), (6, 6, 1), (7, 7, 1), (8, 8, 2), (9, 8, 2), (10, 1, 4)]


@pytest.mark.parametrize("limit", [1 << 28, 1])
def test_format_duplicates(spark, limit):
    assert classes(spark.createDataFrame(ROWS, PAPERS).repartition(3), max_filter_bytes=limit) == EXPECTED


def test_format_duplicates_of_an_empty_table_and_one_class(spark):
    assert classes(spark.createDataFrame([], PAPERS)) == []
    many = spark.range(2000).select("id", F.lit("T").alias("title"), F.concat(F.lit("T | a"), F.repeat(F.lit(" "), (F.col("id") % 5).cast("int"))).alias("title_and_authors")).repartition(6)
    got = classes(many)
    assert {(f, n) for _, f, n in got} == {(0, 2000)} and len(got) == 2000


META = "id long, title_and_authors string, metadata string, group_id string"


def meta(**fields):
    return json.dumps({k.replace("_", "-"): v for k, v in fields.items()})


def test_best_values(spark):
    rows = [
        (1, "g", meta(created="2020-01-01", abstract="Whole text.", doi="10.1/x", license="TBD"), "z"),
        (2, "g", meta(created="2021-01-01", updated="n/a", abstract="Cut te…", doi=" "), "z"),
        (3, "g", meta(created="2019-01-01", updated="3 Mar 2022", abstract="Cut without a mark bec", doi="unknown", comments="5 pages"), "z"),
        (4, "g", meta(created="2022/03/03", doi="10.1/y"), "z"),
        (5, "g", None, "z"),
        (6, "g", "not json", "z"),
        (7, "single", meta(created="2020-01-01", doi="10.1/z"), "z"),
        (8, None, meta(doi="10.1/q"), "z"),
        (9, None, meta(doi="10.1/q"), "z"),
        (10, "ties", meta(created="2020-01-01", doi="a"), "z"),
        (11, "ties", meta(created="2020-01-01", doi="b"), "z"),
        (12, "undated", meta(doi="a"), "z"),
        (13, "undated", meta(created="2001-01-01T00:00:00Z", doi="b"), "z"),
    ]
    df = spark.createDataFrame(rows, META)
    got = {(r["group_id"], r["field"]): r["row_id"] for r in best_values(df).collect()}
    assert got == {(1, "abstract"): 1, (1, "doi"): 4, (1, "comments"): 3, (10, "doi"): 11, (12, "doi"): 13}
    assert {r["group_id"]: r["doi"] for r in survivors(df).collect()} == {1: "10.1/y", 10: "b", 12: "b"}
    assert {r["group_id"]: (r["row_id"], r["n_usable"]) for r in survivors(df).collect()} == {1: (1, 2), 10: (11, 1), 12: (13, 1)}
    trusted = {(r["group_id"], r["field"]): r["row_id"] for r in best_values(df, trust=F.when(F.col("id").isin(10, 1), 1)).collect()}
    assert trusted[1, "doi"] == 1 and trusted[10, "doi"] == 10 and trusted[1, "comments"] == 3
    assert best_values(df.limit(0)).count() == 0 and survivors(df.limit(0)).count() == 0


def brute(a, b):
    prev = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            row.append(min(prev[j] + 1, row[j - 1] + 1, prev[j - 1] + (x != y)))
        prev = row
    return prev[-1]


def test_banded_distance_is_exact_up_to_its_limit():
    rng = np.random.default_rng(3)
    a = [rng.integers(0, 4, rng.integers(0, 14)).astype(np.uint32) for _ in range(400)]
    b = [rng.integers(0, 4, rng.integers(0, 14)).astype(np.uint32) for _ in range(400)]
    limit = rng.integers(0, 7, 400)
    got = banded_distance(a, b, limit)
    for x, y, k, d in zip(a, b, limit, got, strict=True):
        true = brute(x.tolist(), y.tolist())
        assert (d == true) if true <= k else d > k


def test_repeated_texts_against_brute_force(spark):
    rng = random.Random(11)
    words = [f"w{k}" for k in range(60)]
    rows, key = [], 0

    def add(batch, text):
        nonlocal key
        key += 1
        rows.append((key, batch, text, key))

    base = [[rng.choice(words) for _ in range(n)] for n in (0, 1, 2, 3, 5, 8, 13, 20, 23, 24, 25, 30, 60, 90) for _ in range(3)]
    for t in base:
        add(0, " ".join(t))
    add(0, None)
    for batch in (1, 2, 3):
        for t in base[batch::2]:
            changed = list(t)
            for _ in range(rng.randint(0, max(1, len(t) // 6))):
                if changed:
                    p, op = rng.randrange(len(changed)), rng.randrange(3)
                    if op == 0:
                        changed[p] = rng.choice(words)
                    elif op == 1:
                        del changed[p]
                    else:
                        changed.insert(p, rng.choice(words))
            add(batch, " ".join(changed).upper() + ".")
        add(batch, None)
        half = base[-1][:45] + [rng.choice(words) for _ in range(45)]
        add(batch, " ".join(half))
    df = spark.createDataFrame(rows, "key long, batch int, text string, doc long").repartition(3)
    got = {r["key"] for r in repeated_texts(df, "key", "batch", "text").collect()}
    norm = {k: (t.lower().replace(".", "").split() if t is not None else None) for k, _, t, _ in rows}
    want = set()
    for k, b, t, _ in rows:
        if b and t is not None and any(norm[o] is not None and brute(norm[k], norm[o]) <= int(0.125 * max(len(norm[k]), len(norm[o]))) for o, *_ in rows if o < k):
            want.add(k)
    assert got == want and 10 < len(want) < len(rows)


def test_a_later_run_opens_the_index(spark, tmp_path, monkeypatch):
    rng = random.Random(5)
    words = [f"w{k}" for k in range(3000)]
    text = lambda: " ".join(rng.choice(words) for _ in range(60))
    old = [(k, 0, text()) for k in range(1, 601)] + [(2000, 1, text())]
    near = old[3][2].split()
    near[30] = "other"
    new = [(3000, 2, " ".join(near)), (3001, 2, old[9][2].upper()), (3002, 2, text()), (3003, 2, old[-1][2]), (1500, 2, old[-1][2] + " end"), (3004, 2, None)]
    schema, path = "key long, batch int, text string", f"file://{tmp_path}/index"
    first = repeated_texts(spark.createDataFrame(old, schema), "key", "batch", "text", history=TextHistory(spark, path))
    assert first.count() == 0
    again = TextHistory(spark, path)
    assert again.index.loads == 2 and sum(s["rows"]["digest"] for s in again.index.segments) == 601
    got = {r["key"] for r in repeated_texts(spark.createDataFrame(new, schema), "key", "batch", "text", history=again).collect()}
    assert got == {3000, 3001, 3003, 2000}  # 2000 is older, but 1500 has the smaller key
    # Remote files are read by ranges: the pages that a few fingerprints lead to.
    segment = max(again.index.segments, key=lambda s: s["rows"]["suffix"])
    ranged, mapped = Files(path, ranged=True), Files(path)
    monkeypatch.setattr(suffix_index, "PAGE", 64)
    rows = np.sort(np.random.default_rng(1).choice(np.asarray(mapped.array(f"{segment['id']}/suffix-0-0", "h")), 5))
    ranged.write("probe", {"h": mapped.array(f"{segment['id']}/suffix-0-0", "h"), "fence": mapped.array(f"{segment['id']}/suffix-0-0", "h")[::64]})
    assert all((a == b).all() for a, b in zip(ranged.spans("probe", rows), mapped.spans(f"{segment['id']}/suffix-0-0", rows), strict=True))
    assert ranged.bytes_read < 8 * len(mapped.array("probe", "h")) / 5
    os.remove(f"{tmp_path}/index/{segment['id']}/suffix-0-0.h")
    with pytest.raises(Exception, match="suffix-0-0"):
        repeated_texts(spark.createDataFrame([(9000, 3, text())], schema), "key", "batch", "text", history=TextHistory(spark, path)).collect()


def test_repeated_texts_of_few_rows(spark):
    schema = "key long, batch int, text string"
    assert repeated_texts(spark.createDataFrame([], schema), "key", "batch", "text").count() == 0
    rows = [(1, 0, "The esti-\nmate of x"), (2, 1, "the estimate, of X"), (3, 1, ""), (4, 2, " "), (5, 1, "one"), (6, 5, "one"), (7, None, "one")]
    assert {r["key"] for r in repeated_texts(spark.createDataFrame(rows, schema), "key", "batch", "text").collect()} == {2, 4, 6}


def test_arxiv_keys(spark):
    rows = [(1, 0, "0911.30092"), (2, 1, "arXiv: 0911.30092v3"), (3, 1, "http://x.example/pdf/hep-th_0102001v1.pdf"), (4, 2, "hep-th/0102001"), (5, 2, None), (6, 3, ""), (7, 3, None), (8, 3, "HEP-TH/0102001v2"), (9, 4, "0911.30093")]
    df = spark.createDataFrame(rows, "id long, batch_no int, arxiv_id string")
    assert {r["key"] for r in repeated_keys(df, "id", "batch_no", arxiv_key(F.col("arxiv_id"))).collect()} == {2, 4, 8}
