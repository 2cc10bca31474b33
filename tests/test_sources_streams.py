import json
from datetime import UTC, datetime

import pytest
from pyspark.sql import functions as F

from scholia.sources import files, oai, tei, works_api
from scholia.streaming import ingest


def test_json_lines(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"a": 1}\n\n{"a": 2, "b": "x"}\n{broken\n   \n')
    good, bad = files.json_lines(spark, str(tmp_path / "a.jsonl"), "a int, b string")
    assert sorted(r["a"] for r in good.collect()) == [1, 2] and [r["line"] for r in bad.collect()] == ["{broken"]
    files.append_lines(good, str(tmp_path / "out"))
    files.append_lines(good, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 4
    files.replace_lines(good, str(tmp_path / "out2"))
    assert spark.read.json(str(tmp_path / "out2")).count() == 2


def test_json_array(spark, tmp_path):
    (tmp_path / "c.json").write_text('[{"a": 1, "b": "x"}, {"a": 2}]')
    assert [r["a"] for r in files.json_array(spark, str(tmp_path / "c.json"), "a int, b string", ["a", "b"])[0].collect()] == [1]
    assert files.json_array(spark, str(tmp_path / "missing.json"), "a int", ["a"])[0].count() == 0
    (tmp_path / "broken.json").write_text('[{"a": 1, "b": "x"}, {"a": 2')
    items, quarantined = files.json_array(spark, str(tmp_path / "*.json"), "a int, b string", ["a", "b"])
    assert [r["a"] for r in items.collect()] == [1] and [r["path"].split("/")[-1] for r in quarantined.collect()] == ["broken.json"]


def test_documents_and_names(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "x.pdf").write_bytes(b"one\ftwo")
    (tmp_path / "y.PDF").write_bytes(b"no")
    found = files.documents(spark, str(tmp_path))
    assert [r["text"] for r in files.extracted(found, files.plain_pages).collect()] == ["one\ntwo"]

    def failing(data):
        raise ValueError("bad")

    assert files.extracted(found, failing).first()["error"] == "ValueError: bad"
    done = spark.createDataFrame([("x.pdf",)], "path string")
    assert files.not_processed(found, done).count() == 0
    names = spark.createDataFrame([(1, "a.pdf"), (2, "a.pdf"), (3, "b"), (4, "a.pdf")], "i int, n string")
    assert [r["unique_name"] for r in files.unique_names(names, "n", F.col("i")).orderBy("i").collect()] == ["a.pdf", "a_1.pdf", "b", "a_2.pdf"]
    clash = spark.createDataFrame([(1, "x.pdf"), (2, "x.pdf"), (3, "x_1.pdf"), (4, "x.pdf"), (5, "x_3.pdf")], "i long, n string")
    assert [r["unique_name"] for r in files.unique_names(clash, "n", F.col("i")).orderBy("i").collect()] == ["x.pdf", "x_2.pdf", "x_1.pdf", "x_4.pdf", "x_3.pdf"]


def work(i, **more):
    return {"id": f"W{i}", "title": f"T{i}", "cited_by_count": 100 - i, "ids": {}, "locations": [{"source": {"id": "https://x/S1"}, "pdf_url": "no"}, {"source": {"id": "https://x/S4306400194"}, "pdf_url": f"http://arxiv.org/pdf/2401.0000{i}v1"}]} | more


def test_paged_source(spark, tmp_path):
    pages = {"start": ([work(1), work(2)], "c2"), "c2": ([work(2), work(3, title="", display_name="Shown", ids={"arxiv": "x"}), work(4, locations=[])], None)}
    for name, (results, following) in pages.items():
        (tmp_path / f"{name}.json").write_text(json.dumps({"results": results, "meta": {"next_cursor": following}}))
    spark.dataSource.register(works_api.WorksSource)
    raw = spark.read.format("works_api").option("path", str(tmp_path)).load()
    got = {r["id"]: (r["title"], r["filename"], r["citations"], r["arxiv_id"]) for r in works_api.works(raw).collect()}
    assert got == {"W1": ("T1", "2401.00001v1.pdf", 99, "2401.00001v1"), "W2": ("T2", "2401.00002v1.pdf", 98, "2401.00002v1"), "W3": ("Shown", "x.pdf", 97, "x")}
    assert [r["id"] for r in works_api.top_cited(works_api.works(raw), 2).collect()] == ["W1", "W2"]
    assert spark.read.format("works_api").option("path", str(tmp_path)).option("limit", 1).load().count() == 1
    stream = spark.readStream.format("works_api").option("path", str(tmp_path)).load()
    query = stream.writeStream.foreachBatch(ingest.append_unseen(str(tmp_path / "out"), "id", F.col("payload"))).option("checkpointLocation", str(tmp_path / "ck")).start()
    query.processAllAvailable()
    query.stop()
    assert sorted(r["id"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["W1", "W2", "W3", "W4"]


def test_retries():
    class Flaky:
        calls = 0

        def page(self, cursor):
            self.calls += 1
            if self.calls == 1:
                raise works_api.TooManyRequests
            if self.calls == 2:
                raise OSError("net")
            return {"results": []}

    waits = []
    assert works_api.fetch(Flaky(), "*", sleep=waits.append) == {"results": []} and waits == [10.0, 5.0]


PAGE = b"""<OAI-PMH xmlns="http://x"><ListRecords>
<record><header><identifier>o:1</identifier><datestamp>2020-01-01</datestamp><setSpec>cs</setSpec><setSpec>math</setSpec></header>
<metadata><arXiv><id>1</id><authors><author><keyname>A</keyname></author><author><keyname>B</keyname></author></authors></arXiv></metadata></record>
<record><header status="deleted"><identifier>o:2</identifier><datestamp>2020-01-02</datestamp></header></record>
%s</ListRecords></OAI-PMH>"""


def test_oai(spark, tmp_path):
    got = list(oai.records(PAGE % b""))
    assert got[0][:3] == ("o:1", "2020-01-01", ["cs", "math"]) and json.loads(got[0][3])["authors"]["author"] == [{"keyname": "A"}, {"keyname": "B"}] and got[1][3] is None
    token, info = oai.resumption(PAGE % b'<resumptionToken expirationDate="2020-01-01T00:00:00Z">t2</resumptionToken>')
    assert token == "t2" and oai.expired(info) and not oai.expired({"expirationDate": "?"}) and not oai.expired(info, datetime(2019, 1, 1, tzinfo=UTC))
    (tmp_path / "start.xml").write_bytes(PAGE % b"<resumptionToken>t2</resumptionToken>")
    (tmp_path / "t2.xml").write_bytes((PAGE % b"<resumptionToken/>").replace(b"o:1", b"o:3"))
    spark.dataSource.register(oai.OaiSource)
    stream = spark.readStream.format("oai_pmh").option("path", str(tmp_path)).load()
    query = stream.writeStream.foreachBatch(ingest.append_unseen(str(tmp_path / "out"), "identifier", F.col("datestamp"))).option("checkpointLocation", str(tmp_path / "ck")).start()
    query.processAllAvailable()
    query.stop()
    assert sorted(r["identifier"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["o:1", "o:2", "o:3"]


TEI = """<TEI xmlns="http://www.tei-c.org/ns/1.0"><text><body><div><head>Intro</head><p>One &amp;amp; two.</p><p>Three.</p></div></body>
<back><div type="references"><listBibl><biblStruct><analytic><title>First</title><author><persName><forename>Ann</forename><surname>Doe</surname></persName></author></analytic>
<monogr><title>Venue</title><imprint><date when="2001"/></imprint></monogr><idno type="DOI">10.1/x</idno><note type="raw_reference">Ann Doe. First. 2001.</note></biblStruct></listBibl></div></back></text></TEI>"""


def test_tei(spark):
    df = spark.createDataFrame([("p", TEI), ("bad", "<x"), ("none", None), ("flat", "<TEI><text><body><p>Only text</p></body></text></TEI>")], "k string, tei string")
    sections = sorted((r["k"], r["section_title"], r["section_text"]) for r in tei.section_table(df, "k").collect())
    assert sections == [("flat", "Document", "Only text"), ("p", "Intro", "One & two.\nThree.")]
    refs = {r["k"]: r for r in tei.reference_table(df, "k").collect()}
    assert (refs["p"]["title"], refs["p"]["year"], refs["p"]["doi"], refs["p"]["venue"], refs["p"]["authors_teiled"]) == ("First", "2001", "10.1/x", "Venue", ["Ann Doe"]) and refs["bad"]["error"]
    assert [r["entry"] for r in tei.bibliography_table(df, "k").collect() if r["k"] == "p"][0].startswith("First")


def test_tei_service_falls_back(spark):
    def call(endpoint, data, params):
        return (503, b"") if "Fulltext" in endpoint and data == b"b" else (200, b"<TEI/>") if data != b"c" else (500, b"")

    df = spark.createDataFrame([("a", bytearray(b"a")), ("b", bytearray(b"b")), ("c", bytearray(b"c"))], "path string, content binary")
    assert {r["path"]: (r["tei"], r["error"]) for r in tei.with_tei(df, call, 1, 3).collect()} == {"a": ("<TEI/>", None), "b": ("<TEI/>", None), "c": (None, "status 500")}


def test_quarantine_and_resume(spark, tmp_path):
    df = spark.createDataFrame([(1, "x"), (2, None)], "id int, v string")
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    ingest.run_available(stream, ingest.split_bad(str(tmp_path / "ok"), str(tmp_path / "bad"), F.col("v").isNotNull()), str(tmp_path / "ck"))
    assert spark.read.parquet(str(tmp_path / "ok")).count() == spark.read.parquet(str(tmp_path / "bad")).count() == 1
    done = spark.createDataFrame([("a", "2020-01-01"), ("b", "2020-01-02")], "k string, day string")
    rows = spark.createDataFrame([("b", "2020-01-02"), ("c", "2020-01-02"), ("old", "2019-01-01"), ("d", "2020-02-01"), ("d", "2020-02-01")], "k string, day string")
    assert sorted(r["k"] for r in ingest.resume_from(rows, done, "day", "k").collect()) == ["c", "d"]
    assert ingest.resume_from(rows, done.limit(0), "day", "k").count() == 4


def test_download_skips_and_reports(spark):
    from scholia.sources.download import download

    def fetch(url):
        if url == "u3":
            raise OSError("net")
        return (200, "application/pdf", b"x") if url == "u1" else (404, "text/html", b"")

    wanted = spark.createDataFrame([("a", "u1"), ("a", "u1"), ("b", "u2"), ("c", "u3"), ("d", "u4")], "key string, url string")
    stored = spark.createDataFrame([("d",)], "key string")
    got = {r["key"]: (r["content"], r["error"]) for r in download(wanted, stored, fetch, 0).collect()}
    assert got == {"a": (bytearray(b"x"), None), "b": (None, "status 404, text/html"), "c": (None, "OSError: net")}


def test_tool_loop(spark):
    from scholia.plans import agent

    replies = iter([{"tool": "find", "argument": "x"}, {"tool": "missing"}, {"text": "done"}])
    seen = []
    assert agent.run_loop(lambda m: seen.append(m[-1]["text"]) or next(replies), {"find": lambda a: f"found {a}"}, "q?") == "done"
    assert seen == ["q?", "found x", "Error: there is no tool missing."]
    assert agent.run_loop(lambda m: {"tool": "find"}, {}, "q", steps=2).startswith("Error") and agent.run_loop(None, {}, " ") == agent.NO_ANSWER
    agent.register_functions(spark)
    assert spark.sql("SELECT scholia_ascii('Zoë') AS a").first()["a"] == "Zoe"


HEADED = """<TEI xmlns="http://www.tei-c.org/ns/1.0"><teiHeader><biblStruct><analytic><title>The paper itself</title></analytic></biblStruct></teiHeader><text><back>
<listBibl><biblStruct><analytic><title>Elsewhere</title></analytic></biblStruct></listBibl><div type="references"><listBibl>
<biblStruct><monogr><title>A Book</title><imprint><date>1999</date></imprint></monogr><idno type="arXiv">arXiv:1901.00001</idno></biblStruct>
<bibl>Ann Doe and Bob Roe. 2003. Title here.</bibl>
<biblStruct><analytic><title>T</title><author><persName><forename>C</forename><surname>Poe</surname></persName></author></analytic><monogr><title>V</title></monogr><idno>x/abs/1</idno><idno type="DOI">10.1/y</idno><note type="raw_reference">Poe, C. (2001) T</note></biblStruct>
</listBibl></div></back></text></TEI>"""


def test_references_leave_out_the_paper_itself():
    first, second, third = tei.references(HEADED)
    assert (first["id"], first["title"], first["venue"], first["year"], first["doi"], first["authors_teiled"]) == (1, "A Book", "A Book", "1999", "arXiv:1901.00001", ["A Book1999arXiv:1901"])
    assert second["authors_raw_list"] == second["authors_teiled"] == ["Ann Doe", "Bob Roe"] and second["title"] is None and second["authors_raw_str"] == "Ann Doe and Bob Roe"
    assert (third["authors_teiled"], third["doi"], third["venue"], third["raw"], third["authors_raw_str"]) == (["C Poe"], "10.1/y", "V", "Poe, C. (2001) T", "Poe, C.") and "biblStruct" in third["xml"]


def test_single_citations(spark):
    def call(endpoint, text, params):
        if "down" in text:
            raise OSError("no route")
        return (200, b"<TEI><biblStruct><title>T</title><author><persName><forename>A</forename><surname>B</surname></persName></author></biblStruct></TEI>") if text == "[1] good" else (200, b"<x") if text == "odd" else (500, b"")

    df = spark.createDataFrame([("[1] good",), ("[1] good",), ("down",), ("odd",), ("[2] bad",), (None,)], "c string")
    got = {r["original_citation"]: (r["title"], r["authors_teiled"], r["error"]) for r in tei.citation_table(df, "c", call).collect()}
    assert got == {"[1] good": ("T", ["A B"], None), "down": ("", [], "OSError: no route"), "odd": ("", [], "no item in the answer"), "[2] bad": ("", [], "status 500")}


def test_a_busy_or_failing_harvest_waits():
    waits, answers = [], [oai.Busy("7"), oai.Busy(), OSError(), OSError(), b"page"]

    class Service:
        def list(self, token, since):
            a = answers.pop(0) if answers else OSError()
            if isinstance(a, Exception):
                raise a
            return a

    assert oai.fetch(Service(), "t", "2020-01-01", waits.append) == b"page" and waits == [7, 10, 2.0, 4.0]
    waits.clear()
    assert oai.fetch(Service(), "t", "2020-01-01", waits.append) is None and waits == [2.0, 4.0, 8.0, 16.0, 32.0]
    with pytest.raises(OSError):
        oai.fetch(Service(), None, None, waits.append)


def test_a_harvest_begun_anew_skips_what_it_has(tmp_path):
    page = PAGE % b""
    (tmp_path / "start.xml").write_bytes(page)
    reader = oai.OaiStream({"path": str(tmp_path)})
    rows, end = reader.read(reader.initialOffset())
    rows = list(rows)
    again, _ = reader.read({"token": "", "since": "2020-01-01", "last": rows[0][0], "stuck": 0, "done": 0})
    assert end["last"] == rows[-1][0] and list(again) == rows[1:]
