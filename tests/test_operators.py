import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from scholia.operators import catalog as cat
from scholia.operators import chunking, graph, references, resolve, style, trigrams, vectors
from scholia.plans import pipelines


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_insert_keeps_the_first_and_counts(spark):
    schema = "id long, arxiv_id string, title string"
    old = spark.createDataFrame([(1, "k0", "x")], schema)
    new = spark.createDataFrame([(2, "k1", "a"), (3, "k1", "b"), (4, "k0", "c"), (5, " ", "d"), (6, None, "e")], schema)
    assert rows(cat.insert_if_absent(old, new, "arxiv_id", [F.asc("id")])) == [(2, "k1", "a")]
    assert rows(cat.insert_summary(old, new, "arxiv_id")) == [(1, 2, 2)]
    assert rows(cat.insert_summary(old, new.limit(0), "arxiv_id")) == [(0, 0, 0)]


def test_last_update_wins_and_zeros_are_skipped(spark):
    target = spark.createDataFrame([("k1", 1), ("k2", 2), ("k3", None)], "k string, n int")
    updates = spark.createDataFrame([("k1", 5, 1), ("k1", 7, 2), ("k2", 0, 3), (None, 9, 4), ("k9", 9, 5)], "k string, v int, line int")
    assert sorted(rows(cat.update_by_key(target, "k", "n", updates, "v", "line")), key=str) == [("k1", 7), ("k2", 2), ("k3", None)]
    assert rows(cat.update_summary(target, "k", updates, "v")) == [(1, 2, 1)]


def test_catalog_projection(spark):
    df = spark.sql("SELECT 'X' AS i, 'Ünit  Test' AS t, array(named_struct('keyname', 'Zed', 'forenames', 'A.'), named_struct('keyname', 'Äb', 'forenames', 'B')) AS a, '2020-01-02' AS c")
    r = cat.derive(df, F.col("i"), F.col("t"), F.col("a"), F.col("c")).first()
    assert (r["normalized_title"], r["glued_normalized_title"], r["title_and_authors"]) == ("unit test", "unittest", "Ünit  Test | zed a, ab b")


def py_trigrams(s):
    s = f"  {s} "
    return {s[i : i + 3] for i in range(len(s) - 2)}


def test_trigram_join_against_brute_force(spark):
    rng = random.Random(3)
    base = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 25))) for _ in range(40)]
    cat_rows = [(i, t, 100 - i) for i, t in enumerate(base + ["", base[0]])]
    q_rows = [(f"q{i}", (t[: rng.randint(0, len(t))] + rng.choice("abc") + t[len(t) // 2 :]) if i % 3 else t) for i, t in enumerate(base)] + [("e", "")]
    c = spark.createDataFrame(cat_rows, "id long, glued string, created_date int")
    q = spark.createDataFrame(q_rows, "query_id string, glued string")
    got = {(r["query_id"], r["id"]): r["similarity"] for r in resolve.trigram_candidates(q, c).collect()}
    want = {}
    for k, t in q_rows:
        for i, u, _ in cat_rows:
            a, b = py_trigrams(t), py_trigrams(u)
            if t and u and len(a & b) / len(a | b) >= 0.3:
                want[k, i] = len(a & b) / len(a | b)
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    word = spark.createDataFrame([(1, "word", 0)], "id long, glued string, created_date int")
    assert resolve.trigram_candidates(spark.createDataFrame([("q", "words")], "query_id string, glued string"), word).first()["similarity"] == pytest.approx(4 / 7)


def test_trigram_search_in_blocks_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(trigrams, "BLOCK", 16)
    monkeypatch.setattr(trigrams, "HELD", 5)
    rng = random.Random(5)
    texts = ["".join(rng.choice("abcdé𝒳") for _ in range(rng.choice((1, 2, 3, 8, 20, 70)))) for _ in range(60)] + ["aa" * 9, "Straße", ""]
    cat_rows = [(i, rng.choice(texts), 5) for i in rng.sample(range(1000), 90)]
    q_rows = [(f"q{i // 2 if i < 20 else i}", rng.choice(texts) if i % 2 else rng.choice(texts)[:9] + rng.choice(texts)[:30]) for i in range(70)]  # some ids twice
    found = resolve.trigram_candidates(spark.createDataFrame(q_rows, "query_id string, glued string"), spark.createDataFrame(cat_rows, "id long, glued string, created_date int"), limit=4)
    got = sorted((r["query_id"], r["cand_rank"], r["id"], r["similarity"]) for r in found.collect())
    want = []
    for k in {k for k, _ in q_rows}:
        near = []
        for t in (t for q, t in q_rows if q == k and t):
            for i, u, _ in cat_rows:
                a, b = py_trigrams(t), py_trigrams(u)
                if u and len(a & b) / len(a | b) >= 0.3:
                    near.append((-len(a & b) / len(a | b), i))
        want += [(k, n + 1, i, -s) for n, (s, i) in enumerate(sorted(near)[:4])]
    assert got == sorted(want) and len(want) > 100


def test_trigram_search_shuffles_texts_not_pairs(spark):
    rng = random.Random(7)
    words = ["learning", "network", "quantum", "model", "robust", "graph", "theory", "deep"]
    rows = [(i, "".join(rng.sample(words, 5)) + str(i), i) for i in range(1500)]
    c = spark.createDataFrame(rows, "id long, glued string, created_date int")
    q = spark.createDataFrame([(str(i), t[3:]) for i, t, _ in rows], "query_id string, glued string")
    context = spark.sparkContext._jsc.sc()

    def shuffled():
        context.listenerBus().waitUntilEmpty()
        return context.statusStore().executorList(True).head().totalShuffleWrite()

    before = shuffled()
    assert resolve.trigram_candidates(q, c).count() > 70_000
    assert shuffled() - before < 4 * 2 * sum(len(t) for _, t, _ in rows)


def test_authors_compared_in_the_search(spark):
    rng = random.Random(11)
    names = ["A. Smith", "smith anna", "Doe, J.", "j doe", "kim bo", "B Kim", "li", "", "{Li} Wei", "x", "Xu Á. Ł."]
    some = lambda: rng.choice([None, *([rng.choice([*names, None]) for _ in range(n)] for n in (0, 1, 2, 3))])
    c = spark.createDataFrame([(i, "deeplearning"[: rng.randint(6, 12)], some(), rng.choice([None, 1, 2])) for i in range(80)], "id long, glued string, authors array<string>, created_date int")
    q = spark.createDataFrame([(f"q{i}", "deeplearningx"[: rng.randint(5, 13)], some()) for i in range(60)], "query_id string, glued string, authors array<string>")
    want = resolve.best_by_authors(resolve.trigram_candidates(q, c, limit=30), q, c)
    got = sorted(resolve._near_by_authors(q, c, 0.3, 30).collect())
    assert got == sorted(want.collect()) and len(got) > 30


def test_cascade(spark):
    catalog = spark.createDataFrame(
        [(1, "deeplearning", ["li wei"], "2001-01-01"), (2, "deeplearning", ["smith anna", "doe j"], "2002-01-01"), (3, "deeplearnings", ["kim bo"], "2003-01-01"), (4, "deeplearning", [], "2004-01-01")],
        "id long, glued string, authors array<string>, created_date string",
    )
    queries = spark.createDataFrame(
        [("best", "deeplearning", ["A. Smith", "Doe, J."]), ("blocked", "deeplearning", ["kim bo"]), ("near", "deeplearningsx", ["kim"]), ("noauthors", "deeplearning", []), ("empty", "", ["kim"]), ("none", "zzzzzz", ["kim"])],
        "query_id string, glued string, authors array<string>",
    )
    got = {r["query_id"]: (r["id"], r["stage"]) for r in resolve.resolve(queries, catalog).collect()}
    assert got == {"best": (2, "exact"), "near": (3, "trigram"), "noauthors": (4, "exact")}


def py_without_repeats(entries):
    import re

    full = lambda e: bool(re.search(r"\b(19|20)\d{2}\.\s+[A-Za-z]", e)) or any(w in e.lower() for w in (" in ", "iclr", "acl", "nips", "emnlp", "in proceedings", "computational")) or len(e) > 60
    norm = lambda e: " ".join(re.sub(r'[\[\]().,;:"<>]', " ", e).split()).lower()
    year = lambda e: (re.search(r"(19|20)\d{2}", e) or [None])[0]
    kept, seen = [], set()
    for e in entries:
        if full(e):
            if norm(e) not in seen:
                seen.add(norm(e))
                kept.append(e)
        elif not (year(e) and ("et al" in e or " and " in e) and any(full(f) and year(f) == year(e) and re.split(r" et al| and ", e)[0].split()[-1].lower() in f.lower() for f in entries)):
            kept.append(e)
    return kept


def test_short_entries_go_where_a_full_one_explains_them(spark):
    entries = [
        "Bahdanau et al. 2015]", "Bahdanau, Cho, Bengio. 2015. Neural machine translation by jointly learning.", "Fraser and Marcu2007]", "Fraser, Marcu. 2007. Measuring word alignment quality in practice",
        "bahdanau, cho, bengio. 2015. neural machine translation by jointly learning", "Unknown et al. 1999", "Something without year", "Bahdanau et al. 2016",
    ]
    df = spark.createDataFrame([("p", i, e) for i, e in enumerate(entries)], "paper string, pos int, entry string")
    got = [r["entry"] for r in sorted(references.without_repeats(df, "paper", "entry", "pos").collect(), key=lambda r: r["pos"])]
    assert got == py_without_repeats(entries) and len(got) == 5


def test_markers_and_missing_references(spark):
    texts = spark.createDataFrame([(1, "as [1,2] and [1,2] or [9]"), (2, None)], "k long, t string")
    refs = spark.createDataFrame([(1, 1, "A"), (1, 2, "B")], "k long, number int, reference string")
    got = rows(references.match_markers(texts, "k", "t", refs).select("k", "marker", "number", "reference"))
    assert got == [(1, "[1,2]", 1, "[1] A"), (1, "[1,2]", 2, "[2] B"), (1, "[9]", 9, "[9] Reference not found")]
    wide = spark.createDataFrame([(1, "[1-200000] [12345678901] [5,2-3]"), (2, "[99999999999999999999]")], "k long, t string")
    found = references.expand_markers(wide, "k", "t")
    assert found.count() == 200_004 and rows(found.filter("marker_pos = 2").select("num_pos", "number")) == [(0, 5), (1, 2), (2, 3)]
    assert rows(found.filter("marker_pos = 1").select("number")) == [(12345678901,)]


def test_authors_in_text(spark):
    text = "Work of Luong et al. (2015) and of Manning, with Kalchbrener nearby; naïve Sutskever said so."
    names = ["Minh-Thang Luong", "Christopher D. Manning", "Nal Kalchbrenner", "Ilya Sutskever", "Kyunghyun Cho", "Person Unknown"]
    texts = spark.createDataFrame([(1, text)], "k long, t string")
    authors = spark.createDataFrame([(1, n) for n in names], "k long, a string")
    got = dict(rows(references.authors_in_text(texts, "k", "t", authors, "a").select("author", "method")))
    assert got == {"Minh-Thang Luong": "citation", "Christopher D. Manning": "surname", "Nal Kalchbrenner": "fuzzy", "Ilya Sutskever": "surname"}
    detail = {r["author"]: r["details"] for r in references.authors_in_text(texts, "k", "t", authors, "a").collect()}
    assert detail["Nal Kalchbrenner"]["matched_word"] == "kalchbrener" and detail["Nal Kalchbrenner"]["score"] > 0.92 and detail["Minh-Thang Luong"]["candidate"] == "luong"


def py_fold(sections, threshold, count):
    out, title, text = [], "", ""
    for t, x in sections:
        if not text:
            title, text = t, x
        else:
            title = f"{title} — {t}" if title and t else title or t
            text = text + "\n\n" + x
        if count(text) >= threshold:
            out.append((title, text))
            title = text = ""
    return [*out, (title, text)] if text else out


def test_fold_against_python(spark):
    import re

    rng = random.Random(8)
    count = lambda t: len(re.findall(r"\w+|[^\w\s]", t))
    data = [("p", i, rng.choice(["", "A", "B b", "Methods"]), " ".join(["w"] * rng.choice([0, 1, 50, 160, 300, 20]))) for i in range(60)]
    df = spark.createDataFrame(data, "paper string, pos int, title string, text string").repartition(3)
    got = [(r["section_title"], r["section_text"]) for r in sorted(chunking.merge_sections(df, "paper", "pos", "title", "text").collect(), key=lambda r: r["pos"])]
    assert got == py_fold([(t, x) for _, _, t, x in data], 200, count)
    sizes = spark.createDataFrame([("q", i, "t", " ".join(["w"] * n)) for i, n in enumerate([50, 160, 300, 20])], "paper string, pos int, title string, text string")
    assert [len(r["section_text"].split()) for r in sorted(chunking.merge_sections(sizes, "paper", "pos", "title", "text").collect(), key=lambda r: r["pos"])] == [210, 300, 20]


@pytest.mark.parametrize("n, most, want", [(9, 4, [3, 3, 3]), (10, 4, [4, 4, 2]), (1025, 1024, [513, 512]), (0, 4, [0]), (1, 1024, [1])])
def test_balanced_split(spark, n, most, want):
    df = spark.createDataFrame([("p", 0, " ".join(map(str, range(n)))), ("q", 0, None)], "paper string, pos int, text string")
    made = sorted(chunking.split_chunks(df, "paper", "pos", "text", most).collect(), key=lambda r: r["chunk_num"])
    assert [r["token_len"] for r in made] == want and " ".join(r["chunk_text"] for r in made).split() == list(map(str, range(n)))


def test_style_of_papers(spark):
    sections = spark.createDataFrame([("p", 1, "Introduction", "[1] [2, 3] [4]"), ("p", 2, "Other", "[5]"), ("q", 1, "", "(Smith, 2001)"), ("q", 2, "Odd", "(Doe et al., 1999) (Li, 2000) (Ng, 2001)")], "paper string, pos int, head string, t string")
    counts = style.section_counts(sections, "paper", "pos", "head", "t")
    got = {r["paper"]: (r["bracket"], r["body_bracket"], r["author_year"], r["numbered"], r["reason"]) for r in style.decide_style(counts, "paper").collect()}
    assert got["p"][:2] == (3, 4) and got["q"][2] == 3 and got["q"][3:] == (False, "sections_author_year_strong")
    entries = spark.createDataFrame([("p", f"[{i}] T{i}") for i in range(6)], "paper string, entry string")
    assert style.decide_style(counts, "paper", style.bibliography_counts(entries, "paper", "entry")).filter("paper = 'p'").first()["reason"] == "bibliography_majority_numeric"


def test_exact_search_against_numpy(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 64))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(900, None), (901, [0.0] * 64), (902, [1.0])], "vec_id long, vector array<float>")
    asked = df.filter("vec_id % 100 = 0").withColumnRenamed("vec_id", "query_id")
    got = {}
    for r in vectors.cosine_topk(asked, df, 5, block=64).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = r["vec_id"]
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    for q in (0, 100, 200):
        assert [got[q][k] for k in range(1, 6)] == np.argsort(-(u @ u[q]))[:5].tolist()
    assert set(got) == {0, 100, 200}


def test_vector_store(spark):
    papers = spark.createDataFrame([("a", "T", "x"), ("b", "U", None), ("b", "U", None)], "arxiv_id string, title string, abstract string")
    chunks = spark.createDataFrame([("a", "c1", "one"), ("b", "c2", "two"), ("b", "c2", "two"), ("b", "c3", "three")], "chunk_paper_id string, checksum string, chunk_text string")
    stored_p, stored_c = papers.filter("arxiv_id = 'a'"), chunks.filter("checksum = 'c3'")
    p, c = pipelines.load_vectors(papers, chunks, stored_p, stored_c)
    assert [r["arxiv_id"] for r in p.collect()] == ["b"] and [(r["checksum"], len(r["vector"])) for r in c.collect()] == [("c2", 64)]
    plan = c._jdf.queryExecution().executedPlan().toString()
    assert plan.index("ArrowEvalPython") < plan.index("LeftAnti"), "the embedder must come after the anti join"
    again = vectors.upsert(c, c.withColumn("chunk_text", F.lit("new")), "checksum")
    assert [r["chunk_text"] for r in again.collect()] == ["new"]
    embedder = vectors.HashingEmbedder()
    embedder.shutdown()
    with pytest.raises(RuntimeError):
        embedder.batch_encode(["x"])


def test_bm25_against_python(spark):
    docs = {1: "red green blue", 2: "red red red", 3: "green tea", 4: ""}
    df = spark.createDataFrame(list(docs.items()), "id long, t string")
    asked = spark.createDataFrame([("q", "red tea")], "query_id string, text string")
    got = {r["id"]: r["score"] for r in vectors.bm25(df, "id", "t", asked).collect()}
    avg = sum(len(t.split()) for t in docs.values()) / 4
    want = {}
    for term in ("red", "tea"):
        n = sum(term in t.split() for t in docs.values())
        for i, t in docs.items():
            tf, size = t.split().count(term), len(t.split())
            if tf:
                want[i] = want.get(i, 0) + math.log(1 + (4 - n + 0.5) / (n + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * size / avg))
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-5 for k in want)
    first = spark.createDataFrame([("q", 1, 1), ("q", 2, 2)], "query_id string, id long, rank int")
    second = spark.createDataFrame([("q", 2, 1), ("q", 3, 2)], "query_id string, id long, rank int")
    assert [r["id"] for r in vectors.fuse_ranks(first, second, "id").orderBy("rank").collect()] == [2, 1, 3]


def test_graph(spark):
    papers = spark.createDataFrame([("p", "old", ["a", "b"], ["cs"], 1), ("p", "new", ["a"], None, 2), ("q", "Q", None, ["cs", ""], 1), (None, "N", ["z"], ["m"], 1)], "id string, title string, authors array<string>, categories array<string>, order int")
    cites = spark.createDataFrame([("p", "q"), ("p", "q"), ("p", "p"), ("p", "missing"), (None, "q")], "src string, dst string")
    nodes, edges = graph.scholarly_graph(papers, cites)
    assert ("p", "Paper", "new") in [tuple(r)[:3] for r in nodes.collect()] and nodes.filter("label = 'Author'").count() == 3
    assert rows(edges.filter("type = 'CITES'")) == [("p", "q", "CITES")]
    _, found = pipelines.citation_graph(papers, spark.createDataFrame([("p", "see arXiv:2401.00001")], "id string, text string"))
    assert found.filter("type = 'CITES'").count() == 0


def test_answers(spark):
    catalog = spark.createDataFrame([(1, "a1", "deeplearning", "2001"), (2, "a2", "graphtheory", "2002")], "id long, arxiv_id string, glued string, created_date string")
    texts = spark.createDataFrame([("a1", "the text")], "arxiv_id string, text string")
    assert pipelines.answer(catalog, texts, "Deep Learning?") == "the text"
    assert pipelines.answer(catalog, texts, "Graph theory") == "The paper has no text." and pipelines.answer(catalog, texts, "  ") == pipelines.NO_ANSWER


def test_build_catalog_and_enrichment(spark):
    schema = "id long, arxiv_id string, title_and_authors string, created_date string"
    old = spark.createDataFrame([(1, "a", "T | x", "2001")], schema)
    new = spark.createDataFrame([(2, "b", "T | x", "2002"), (3, "a", "U | x", "2003")], schema)
    merged, counts = pipelines.build_catalog(old, new, dry_run=False)
    assert rows(merged.select("id")) == [(2,)] and rows(counts) == [(1, 0, 1, 1)]
    catalog = spark.createDataFrame([(7, "x7", "Deep Learning", "deeplearning", ["Luong Minh"], "2001-01-01", 5)], "id long, arxiv_id string, title string, glued string, authors array<string>, created_date string, citation_count int")
    sections = spark.createDataFrame([("p", 1, "Intro", "As Luong Minh said"), ("p", 2, "End", "nothing")], "paper_id string, pos int, section_title string, section_text string")
    refs = spark.createDataFrame([("p", "r1", "Deep learning", ["Minh Luong"])], "paper_id string, query_id string, title string, authors array<string>")
    got = {r["pos"]: (r["is_citation_context"], len(r["citations"] or [])) for r in pipelines.enrich_papers(sections, refs, catalog).collect()}
    assert got == {1: (True, 1), 2: (False, 0)}


def test_enrichment_by_markers_and_by_authors(spark):
    catalog = spark.createDataFrame(
        [(1, "x1", "Deep Learning", "deeplearning", ["luong minh"], "2001-01-01", 5), (2, "x2", "Graph Theory", "graphtheory", ["cho kyunghyun"], "2002-01-01", 6), (3, "x3", "Short", "short", ["jean sebastien"], "2003-01-01", 7)],
        "id long, arxiv_id string, title string, glued string, authors array<string>, created_date string, citation_count int",
    )
    sections = spark.createDataFrame(
        [("m", 0, "Introduction", "We saw [2] and [1, 2] [3] [4]."), ("m", 1, "End", "Nobody of the list; [1-2] [9]"), ("m", 2, "Rest", "Luong said so."),
         ("a", 0, "Introduction", "After Luong Minh and Jean (2003)."), ("a", 1, "End", "As [1] says, in one place.")],
        "paper_id string, pos int, section_title string, section_text string",
    )
    refs = spark.createDataFrame(
        [("m", "m1", "Deep learning", ["Minh Luong"], 1, "M. Luong. Deep learning."), ("m", "m2", "Graph theory", ["Cho Kyunghyun"], 2, "K. Cho. Graph theory."), ("m", "m3", "Unknown words", ["Nobody"], 3, "Unknown"),
         ("a", "a1", "Deep learning", ["Minh Luong"], 1, "Minh Luong. 2001. Deep learning. In Proceedings"), ("a", "a2", "Short", ["Jean Sebastien"], 2, "Jean et al. 2003"),
         ("a", "a3", "Other", ["S. Jean"], 3, "S. Jean. 2003. Another one that explains it. In Proceedings")],
        "paper_id string, query_id string, title string, authors array<string>, number int, raw string",
    )
    got = {(r["paper_id"], r["pos"]): r for r in pipelines.enrich_papers(sections, refs, catalog).collect()}
    cited = {k: [c["arxiv_id"] for c in r["citations"] or []] for k, r in got.items()}
    assert cited == {("m", 0): ["x2", "x1"], ("m", 1): ["x1", "x2"], ("m", 2): [], ("a", 0): ["x1"], ("a", 1): []}
    assert {k: (r["uses_markers"], r["is_citation_context"], r["chunk_num"]) for k, r in got.items()} == {k: (k[0] == "m", bool(cited[k]), k[1] + 1) for k in got}


def test_similar_edges_filter_and_approximate_search(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(11, 64))
    x = centres[np.arange(240) % 11] + 0.35 * rng.normal(size=(240, 64))
    x[7] = x[19]  # equal vectors: an edge goes both ways, none to itself
    df = spark.createDataFrame([(i, v.tolist(), i % 2) for i, v in enumerate(x)] + [(900, None, 0)], "vec_id long, vector array<float>, side int")
    u = x.astype(np.float32).astype(float)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    sims = u @ u.T
    np.fill_diagonal(sims, -2)
    want = {(i, int(j)) for i in range(240) for j in np.argsort(-np.round(sims[i], 12), kind="stable")[:3] if sims[i, j] >= 0.7}
    made = graph.similar_edges(df, "vec_id", "vector", 3, 0.7).collect()
    assert {(r["src"], r["dst"]) for r in made} == want and (7, 19) in want and (19, 7) in want and {r["type"] for r in made} == {"SIMILAR_TO"}
    asked = df.filter("vec_id < 40").withColumnRenamed("vec_id", "query_id")
    exact = vectors.cosine_topk(asked, df, 5, where=F.col("side") == 1).collect()
    odd = [j for j in range(240) if j % 2]
    full = u @ u.T
    for q in range(40):
        got = [r["vec_id"] for r in sorted(exact, key=lambda r: r["rank"]) if r["query_id"] == q]
        assert got == sorted(odd, key=lambda j: (-round(full[q, j], 12), j))[:5]
    near = vectors.approx_topk(asked, df, 5, where=F.col("side") == 1).collect()
    best = {(r["query_id"], r["vec_id"]) for r in exact}
    assert all(r["vec_id"] % 2 and abs(r["similarity"] - full[r["query_id"], r["vec_id"]]) < 1e-9 for r in near)
    assert len(best & {(r["query_id"], r["vec_id"]) for r in near}) >= 0.95 * len(best)
