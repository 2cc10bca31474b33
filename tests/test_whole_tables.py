import hashlib
import math
import re

from scholia.functions import citations as C
from scholia.plans import registry


def tables(spark, folder, **given):
    for name, (rows, schema) in given.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def test_author_year_counts_read_the_text(spark, tmp_path):
    texts = [
        "As (Smith et al., 2001) and Jones et al. (1999) say; Brown, 2001. Not (smith, 2001) nor (Smith, 1801).", None, "", "No citation in 2001.",
        "Árvíz (Nagy and Kovács, 2004) és Müller et al. (2010), Zoë Lee, 1987 [3]", "Long Names Of Many Words " * 300 + "et al. (2003)", "A B C " * 500, "Bahdanau\net al. (2015)\n(Li, 2000)(Ng, 2001)",
    ]
    d = tables(spark, tmp_path, documents=(list(enumerate(texts)), "doc_id long, text string"))
    got = {r["doc_id"]: r["author_year"] for r in registry.QUERIES["author_year_counts_in_text"](spark, d).collect()}
    want = {i: len(re.findall(C.AUTHOR_YEAR, t or "", re.ASCII)) for i, t in enumerate(texts)}
    assert got == want and want[0] == 3 and want[5] == 1


def test_norms_and_checksums_of_every_document(spark, tmp_path):
    texts = ["Plain (text), 2001.", "Élan «Vital»; ÀÉÎ\u00a0Öß [3]", "ΣΊΣΥΦΟΣ: ΟΔΟΣ.", "İstanbul IĞDIR", "", "  \n ", None, "数学、Ｆｕｌｌ “x”", "$\\Omega_{1}$ ≤ Ω\u2003µ ﬁn"]
    d = tables(spark, tmp_path, documents=(list(enumerate(texts)), "doc_id long, text string"))
    got = {r["doc_id"]: (r["norm"], r["checksum"]) for r in registry.QUERIES["reference_norm_checksum_all"](spark, d).collect()}
    norm = lambda t: re.sub(r"\s+", " ", re.sub(r"""[\[\]().,;:"<>]""", " ", t)).strip().lower()
    assert got == {i: (None, None) if t is None else (norm(t), hashlib.sha256(t.encode()).hexdigest()) for i, t in enumerate(texts)}


def test_ids_are_searched_in_documents_without_an_id(spark, tmp_path):
    rows = [(1, "see arXiv:2401.00001 and https://arxiv.org/abs/2402.00002v3", None), (2, "nothing", None), (3, None, "2403.00003"), (4, None, None)]
    d = tables(spark, tmp_path, documents=(rows, "doc_id long, text string, arxiv_id string"))
    got = sorted((r["doc_id"], r["ref"]) for r in registry.QUERIES["ids_in_text"](spark, d).collect())
    assert got == [(1, "2402.00002v3"), (1, "arXiv:2401.00001"), (3, "2403.00003"), (3, "arXiv: 2403.00003"), (3, "arXiv:2403.00003v2")]


def test_all_five_counts_and_every_name(spark, tmp_path):
    texts = ["[1, 2] (3) (Smith et al., 2001) x² 45", None, "Brown, 1999 [4-6] in 7 or 2001 cases"]
    names = [(1, ["li wei", "doe jane q", "wei wei li"]), (2, []), (3, None)]
    d = tables(spark, tmp_path, chunks=(list(enumerate(texts)), "chunk_seq long, chunk_text string"), papers=(names, "id long, normalized_authors array<string>"))
    kinds = ("bracket", "paren", "author_year", "superscript", "raw_numeric")
    got = {r["chunk_seq"]: tuple(r[k] for k in kinds) for r in registry.QUERIES["citation_style_counts_all"](spark, d).collect()}
    assert got == {0: (1, 1, 1, 1, 4), 1: (0, 0, 0, 0, 0), 2: (1, 0, 1, 0, 3)}
    sets = sorted(tuple(r) for r in registry.QUERIES["name_token_sets_all"](spark, d).select("id", "pos", "words").collect())
    assert sets == [(1, 0, "li wei"), (1, 1, "doe jane q"), (1, 2, "li wei")]


def test_searches_index_the_text_of_chunks(spark, tmp_path):
    texts = {1: "A quiet preamble. " * 20 + "Then the zebra graph appears, zebra again.", 2: "graph theory of graph minors", 3: "unrelated words only", 4: None, 5: "zebra"}
    works = [("W100", "Zebra graph"), ("W101", "unrelated"), ("W200", None)]
    papers = [(1, "Zebra graph"), (2, "unrelated")]
    d = tables(spark, tmp_path, chunks=(list(texts.items()), "chunk_seq long, chunk_text string"), works=(works, "id string, title string"), papers=(papers, "id long, title string"))
    docs = {i: re.findall(r"\w+|[^\w\s]", t.lower()) for i, t in texts.items() if t}
    mean = sum(map(len, docs.values())) / len(docs)
    want = {}
    for term in ("zebra", "graph"):
        n = sum(term in w for w in docs.values())
        for i, w in docs.items():
            if f := w.count(term):
                want[i] = want.get(i, 0) + math.log(1 + (len(docs) - n + 0.5) / (n + 0.5)) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * len(w) / mean))
    made = registry.QUERIES["bm25_topk"](spark, d).collect()
    got = {r["id"]: r["score"] for r in made}
    assert {r["query_id"] for r in made} == {"W100"} and got.keys() == want.keys() == {1, 2, 5} and all(abs(got[i] - want[i]) < 1e-5 for i in want)
    assert {r["id"] for r in registry.QUERIES["hybrid_topk"](spark, d).collect()} == {1, 2, 3, 5}
