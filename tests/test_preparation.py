"""From files to final documents: both citation styles, resumption, stores."""

from pyspark.sql import functions as F

from scholia.functions.text import author_items, format_authors, glue, normalize_text
from scholia.operators import catalog as cat
from scholia.plans import pipelines
from scholia.sources import tei

BODY = "<TEI><text><body>{}</body><back><listBibl>{}</listBibl></back></text></TEI>"
DIV = "<div><head>{}</head><p>{}</p></div>"
NUMBERED = BODY.format(DIV.format("Introduction", "As in [1] and [2], [1] again, [9]. More [1], [2], [3].") + DIV.format("End", "Nothing here."), "")
NAMED = BODY.format(
    DIV.format("Introduction", "Doe et al. showed it."),
    "<biblStruct><analytic><title>Graph kernels at scale</title><author><persName><forename>Ann</forename><surname>Doe</surname></persName></author></analytic><note type='raw_reference'>Ann Doe. 2001. Graph kernels at scale.</note></biblStruct>",
)
LIST = "Text\fReferences\n[1] Doe, A. Graph kernels at scale.\n[2] Roe, B. Unknown work entirely.\n"


def service():
    numbered, named, listed, one = NUMBERED.encode(), NAMED.encode(), LIST.encode(), tei.ONE_CITATION

    def call(endpoint, data, params):
        if endpoint == one:
            title = "Graph kernels at scale" if "Graph" in data else "Unknown work entirely"
            return 200, f"<TEI><biblStruct><title>{title}</title><author><persName><forename>A</forename><surname>Doe</surname></persName></author></biblStruct></TEI>".encode()
        return (200, numbered) if data == listed else (200, named) if data == b"named" else (500, b"")

    return call


def catalog(spark):
    meta = '[{"keyname": "Doe", "forenames": "Ann"}]'
    rows = [(1, "2001.00001", "Graph kernels at scale", ["doe ann"], "2001-01-01", 7, meta, "A."), (2, "p1", "The first paper", ["me"], "2002-01-01", None, '{"keyname": "Me"}', "B."), (3, "p2", "The second paper", ["us"], "2003-01-01", 1, '"Us"', None)]
    df = spark.createDataFrame(rows, "id long, arxiv_id string, title string, authors array<string>, created_date string, citation_count int, a string, abstract string")
    return df.withColumns({"glued": glue(normalize_text("title")), "author_items": author_items("a"), "created": F.col("created_date"), "updated": F.lit(None).cast("string")}).drop("a")


def test_files_become_documents(spark):
    files = spark.createDataFrame([("/d/p1.pdf", LIST.encode()), ("/d/p2.pdf", b"named"), ("/d/p3.pdf", b"bad"), ("/d/p4.pdf", b"done")], "path string, content binary")
    done = spark.createDataFrame([("/d/p4.pdf",)], "path string")
    call = service()
    sections, refs, entries, failed = pipelines.prepare_papers(files, call, call, done=done)
    assert [tuple(r) for r in failed.collect()] == [("/d/p3.pdf", "status 500")]
    got = {(r["paper_id"], r["number"]): (r["title"], r["authors"]) for r in refs.collect()}
    assert got == {("p1", 1): ("Graph kernels at scale", ["A Doe"]), ("p1", 2): ("Unknown work entirely", ["A Doe"]), ("p2", 1): ("Graph kernels at scale", ["Ann Doe"])}
    docs = {r["arxiv_id"]: r for r in pipelines.process_papers(sections, refs, catalog(spark), entries).collect()}
    assert set(docs) == {"p1", "p2"}
    for name, marked in (("p1", True), ("p2", False)):
        d = docs[name]
        assert [c["chunk_num"] for c in d["chunks"]] == list(range(1, len(d["chunks"]) + 1)) and all(c["uses_markers"] is marked for c in d["chunks"])
        cited = [[i["arxiv_id"] for i in c["citations"] or []] for c in d["chunks"]]
        assert cited[0] == ["2001.00001"] and all(not c for c in cited[1:]) and d["chunks"][0]["is_citation_context"]
        assert d["chunks"][0]["citations"][0]["authors_str"] == ["Doe Ann"] and [i["title"] for i in d["references"]] == ["Graph kernels at scale"]
    assert (docs["p1"]["authors_str"], docs["p2"]["authors_str"], docs["p1"]["abstract"], docs["p1"]["updated"], docs["p2"]["citation_count"]) == (["Me"], ["Us"], "B.", "", 1)
    again = pipelines.process_papers(sections, refs, catalog(spark), entries, emitted=spark.createDataFrame([("p1",)], "arxiv_id string"))
    assert [r["arxiv_id"] for r in again.collect()] == ["p2"]


def test_authors_in_any_form(spark):
    df = spark.createDataFrame([('{"keyname": "A", "forenames": "B"}',), ('[{"keyname": "C"}, null]',), ('"D E"',), ("F",), ("null",), ("",), (None,)], "j string")
    assert [r["x"] for r in df.select(format_authors(author_items("j")).alias("x")).collect()] == [["A B"], ["C"], ["D E"], ["F"], [], [], []]


def test_vectors_are_ingested_once(spark, tmp_path):
    source, store = str(tmp_path / "in"), str(tmp_path / "store")
    rows = spark.createDataFrame([("p", "c1", 1, "S", "one", 1, "k1"), ("p", "c2", 2, "S", "two", 1, "k2"), ("p", "c3", 3, "S", "two", 1, "k2")], "chunk_paper_id string, chunk_id string, chunk_num int, section_title string, chunk_text string, token_len int, checksum string")
    rows.write.parquet(source)
    run = lambda: pipelines.ingest_vectors(spark.readStream.schema(rows.schema).parquet(source), "chunks", store, str(tmp_path / "offsets"))
    run()
    rows.withColumn("checksum", F.when(F.col("chunk_id") == "c1", "k3").otherwise(F.col("checksum"))).write.mode("append").parquet(source)
    run()
    held = spark.read.parquet(store)
    assert sorted(r["checksum"] for r in held.collect()) == ["k1", "k2", "k3"] and held.filter("size(vector) <> 64 OR uuid IS NULL").count() == 0
    assert tuple(pipelines.store_totals(rows.limit(0), held).first()) == (0, 3)


def test_compaction_and_statistics(spark, tmp_path):
    spark.range(100).selectExpr("id", "IF(id < 10, NULL, 'x') AS s").repartition(7).write.parquet(str(tmp_path / "a"))
    got = {r["column"]: (r["n"], r["nulls"], r["distinct"]) for r in cat.compact(spark, str(tmp_path / "a"), str(tmp_path / "b")).collect()}
    assert got["s"] == (100, 10, 1) and got["id"][:2] == (100, 0) and abs(got["id"][2] - 100) < 15
    assert spark.read.parquet(str(tmp_path / "b")).count() == 100 and len(list((tmp_path / "b").glob("*.parquet"))) == 1
