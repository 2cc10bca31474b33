"""Whole pipelines over tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scholia.functions.text import checksum, chunk_id, format_authors, glue, id_from_path, normalize_list, normalize_text, references_in_text, token_count
from scholia.operators import catalog as cat
from scholia.operators import chunking, graph, references, resolve, style, vectors
from scholia.session import materialize
from scholia.sources import tei
from scholia.sources.files import extracted, not_processed, plain_pages

NO_ANSWER = "<NO_ANSWER_POSSIBLE>"


def build_catalog(existing: DataFrame, records: DataFrame, dry_run: bool = True) -> tuple[DataFrame, DataFrame]:
    """(catalog, one row of counts). New records join the catalog; duplicates go unless it's a dry run."""
    order = [F.asc("id")]
    merged = existing.unionByName(cat.insert_if_absent(existing, records, "arxiv_id", order), allowMissingColumns=True)
    counts = cat.insert_summary(existing, records, "arxiv_id").crossJoin(cat.count_duplicates(merged, "title_and_authors"))
    kept = merged if dry_run else cat.keep_latest(merged, "title_and_authors", [F.desc("created_date"), F.desc("id")])
    return kept, counts


def prepare_queries(refs: DataFrame, key: str, title: str, authors: str, citation: str | None = None, raw: str | None = None) -> DataFrame:
    """(query_id, original_citation, glued, authors) of extracted references."""
    pieces = [F.col(c) for c in (citation, raw) if c]
    original = F.coalesce(*(F.nullif(p, F.lit("")) for p in pieces), F.lit(""))
    return refs.select(F.col(key).alias("query_id"), original.alias("original_citation"), glue(normalize_text(title)).alias("glued"), normalize_list(authors).alias("authors"))


def prepare_papers(files: DataFrame, call, cite, extract=plain_pages, done: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(sections, refs, entries, failed) of the files (path, content) that aren't among ``done`` (path).

    ``call`` and ``cite`` are the TEI service for documents and for single citations (`sources.tei`),
    ``extract`` reads the pages of a file. Papers with numbered citations: the numbers their sections
    name, looked up in the list at the end of the file's text; each distinct reference is parsed once.
    The others: the references of their TEI. ``refs`` and ``entries`` are what `enrich_papers` takes;
    ``failed``: (path, error), files the service couldn't read, which a later run tries again.
    """
    fresh = files if done is None else not_processed(files, done)
    read = materialize(tei.with_tei(fresh, call).withColumn("paper_id", id_from_path("path")), "tei")
    good = read.filter("tei IS NOT NULL").select("paper_id", "tei")
    sections = materialize(tei.section_table(good, "paper_id"), "sections")
    entries = materialize(tei.bibliography_table(good, "paper_id").select("paper_id", "pos", "entry"), "entries")
    styles = materialize(decide_styles(sections, entries).select("paper_id", "numbered"), "styles")
    numbered = styles.filter("numbered").select("paper_id")

    texts = extracted(fresh, extract).select(id_from_path("path").alias("paper_id"), "text").join(numbered, "paper_id", "left_semi")
    held = references.references_of(texts, "paper_id", "text")
    marked = sections.join(numbered, "paper_id", "left_semi").withColumn("_key", F.struct("paper_id", "pos"))
    named = references.match_markers(marked, "_key", "section_text", held, "paper_id").select("paper_id", "number", "reference").distinct()
    cited = materialize(named.join(held.select("paper_id", F.col("number").try_cast("bigint").alias("number"), F.col("reference").alias("raw")), ["paper_id", "number"]), "cited")
    parsed = tei.citation_table(cited, "reference", cite).groupBy(F.col("original_citation").alias("reference")).agg(F.min(F.struct("title", F.col("authors_teiled").alias("authors"))).alias("_p"))
    by_number = cited.join(parsed, "reference").select("paper_id", "number", "raw", "_p.title", "_p.authors")
    found = tei.reference_table(good.join(numbered, "paper_id", "left_anti"), "paper_id").filter("error IS NULL")
    by_name = found.select("paper_id", F.col("id").cast("bigint").alias("number"), "raw", "title", F.col("authors_teiled").alias("authors"))
    refs = by_number.unionByName(by_name).withColumn("query_id", F.concat_ws("#", "paper_id", F.lpad(F.col("number").cast("string"), 6, "0")))
    return sections, refs, entries, read.filter("tei IS NULL").select("path", "error")


def process_papers(sections: DataFrame, refs: DataFrame, catalog: DataFrame, entries: DataFrame | None = None, emitted: DataFrame | None = None) -> DataFrame:
    """One final document a paper that the catalog knows and ``emitted`` (arxiv_id) doesn't hold.

    ``catalog`` as for `enrich_papers`, with author_items (array of keyname and forenames), abstract,
    created and updated. Chunks and references come in order; what isn't known is null or empty.
    """
    if emitted is not None:
        gone = emitted.select(F.col("arxiv_id").alias("paper_id")).distinct()
        sections = sections.join(gone, "paper_id", "left_anti")
    chunks, resolved = enrich(sections, refs, catalog, entries)
    own = cat.first_per_key(catalog.filter("arxiv_id IS NOT NULL"), "arxiv_id", [F.desc("id")])
    main = own.select(
        "arxiv_id", "title", F.col("author_items").alias("authors"), format_authors("author_items").alias("authors_str"), "abstract", "created", F.coalesce("updated", F.lit("")).alias("updated"), "citation_count"
    )
    part = F.struct("chunk_num", "chunk_id", "section_title", "chunk_text", "token_len", "is_citation_context", "citations", "checksum", "uses_markers", F.lit("").alias("chunk_embedding_id"))
    listed = chunks.groupBy(F.col("paper_id").alias("arxiv_id")).agg(F.array_sort(F.collect_list(part), lambda x, y: x["chunk_num"] - y["chunk_num"]).alias("chunks"))
    cited = resolved.select("paper_id", "id").distinct().join(catalog.select("id", _citation_item(catalog).alias("_i")), "id")
    cited = cited.groupBy(F.col("paper_id").alias("arxiv_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("id", "_i"))), lambda x: x["_i"]).alias("references"))
    made = main.join(listed, "arxiv_id").join(cited, "arxiv_id", "left")
    return made.withColumns({"references": F.coalesce("references", F.array().cast(made.schema["references"].dataType)), "paper_embedding_id": F.lit("")})


def _citation_item(catalog: DataFrame) -> Column:
    """What a citation says of a catalog row; with authors where the catalog has author_items."""
    people = [F.col("author_items").alias("authors"), format_authors("author_items").alias("authors_str")] if "author_items" in catalog.columns else []
    return F.struct("arxiv_id", "title", *people, "citation_count")


def enrich_papers(sections: DataFrame, refs: DataFrame, catalog: DataFrame, entries: DataFrame | None = None) -> DataFrame:
    """Every section of every paper as a chunk with the citations resolved to the catalog; see `enrich`."""
    return enrich(sections, refs, catalog, entries)[0]


def enrich(sections: DataFrame, refs: DataFrame, catalog: DataFrame, entries: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(chunks, resolved): the sections with their citations, and (paper_id, query_id, id, ...) of the references found.

    ``sections``: (paper_id, pos, section_title, section_text); ``refs``: (paper_id, query_id, title,
    authors) and, where known, number (its place in the paper's list, which markers name) and raw (its
    text); ``catalog``: (id, arxiv_id, title, glued, authors, created_date, citation_count) and, where
    citations shall have authors, author_items; ``entries``: (paper_id, entry), the bibliography that
    helps to decide the style. Papers with numbered citations go by their markers, the others by first
    authors named in the text. One plan over all papers: references resolved once a distinct query.
    """
    styles = materialize(decide_styles(sections, entries).select("paper_id", F.col("numbered").alias("uses_markers")), "styles")
    number = F.col("number").cast("bigint") if "number" in refs.columns else F.lit(None).cast("bigint")
    raw = F.coalesce("raw", F.lit("")) if "raw" in refs.columns else F.lit("")
    listed = refs.select("paper_id", "query_id", "title", "authors", number.alias("number"), raw.alias("raw")).join(styles, "paper_id")
    texts = sections.join(styles, "paper_id").withColumn("_key", F.struct("paper_id", "pos"))
    marked_texts, named_texts = texts.filter("uses_markers"), texts.filter("NOT uses_markers")
    numbered, named = listed.filter("uses_markers AND number IS NOT NULL"), listed.filter("NOT uses_markers")

    held = numbered.groupBy("paper_id", "number").agg(F.min_by("raw", "query_id").alias("reference"))
    marked = materialize(references.match_markers(marked_texts, "_key", "section_text", held, "paper_id"), "markers")
    cited = numbered.join(marked.select("paper_id", "number"), ["paper_id", "number"], "left_semi")
    kept = references.without_repeats(named.select("paper_id", "raw", "number", "query_id"), "paper_id", "raw", "number").select("paper_id", "raw").distinct()
    searched = materialize(cited.unionByName(named.join(kept, ["paper_id", "raw"], "left_semi").select(*cited.columns)), "searched")
    found = resolve.resolve(prepare_queries(searched, "query_id", "title", "authors", raw="raw"), catalog)
    resolved = materialize(searched.select("paper_id", "query_id", "number", "raw", "uses_markers").join(found.select("query_id", "id"), "query_id"), "resolved")
    shown = catalog.select("id", _citation_item(catalog).alias("_item"))
    item = F.col("_item")
    section = F.struct("paper_id", F.col("section").alias("pos"))

    by_text = resolved.filter("uses_markers").groupBy("paper_id", references.numbered_text("number", "raw").alias("reference")).agg(F.min_by("id", "query_id").alias("id"))
    said = marked.select("paper_id", F.col("_key.pos").alias("section"), F.struct("marker_pos", "num_pos").alias("place"), "reference")
    links = references.cite_by_marker(said, by_text, "paper_id").join(shown, "id").withColumn("_key", section)
    by_marker = chunking.regroup_citations(marked_texts, links, "_key", "place", item)

    asked = named.select("paper_id", F.try_element_at("authors", F.lit(1)).alias("author")).filter("author IS NOT NULL").distinct()
    asked = named_texts.select("_key", "paper_id").join(asked, "paper_id").select("_key", "author")
    said = references.authors_in_text(named_texts, "_key", "section_text", asked, "author").select("_key.paper_id", F.col("_key.pos").alias("section"), normalize_text("author").alias("author"))
    first = resolved.filter("NOT uses_markers").join(catalog.select("id", F.try_element_at("authors", F.lit(1)).alias("first_author")), "id").filter("first_author IS NOT NULL")
    links = references.cite_by_first_author(said, first.select("paper_id", "id", normalize_text("first_author").alias("first_author")), "paper_id")
    by_author = chunking.regroup_citations(named_texts, links.join(shown, "id").withColumn("_key", section), "_key", "id", item)

    both = by_marker.unionByName(by_author).drop("_key").withColumn("chunk_text", F.col("section_text"))
    order = F.row_number().over(Window.partitionBy("paper_id").orderBy("pos"))
    chunks = both.withColumns({"chunk_num": order, "token_len": token_count("chunk_text"), "checksum": checksum("chunk_text")})
    return chunks.withColumn("chunk_id", chunk_id(F.concat_ws("|", "paper_id", "checksum"), "chunk_num")), resolved


def paper_documents(papers: DataFrame, chunks: DataFrame, refs: DataFrame) -> DataFrame:
    """One nested document a paper with its chunks and references in order."""
    c = chunks.groupBy("paper_id").agg(F.array_sort(F.collect_list(F.struct("chunk_num", "chunk_text", "checksum"))).alias("chunks"))
    r = refs.groupBy("paper_id").agg(F.array_sort(F.collect_set(F.struct("arxiv_id", "title"))).alias("references"))
    joined = papers.join(c, "paper_id", "left").join(r, "paper_id", "left")
    return joined.withColumns({"updated": F.coalesce("updated", F.lit("")), "paper_embedding_id": F.lit("")})


def decide_styles(sections: DataFrame, entries: DataFrame | None = None) -> DataFrame:
    """C7 over all papers: sections (paper_id, pos, section_title, section_text), entries (paper_id, entry)."""
    counts = style.section_counts(sections, "paper_id", "pos", "section_title", "section_text")
    return style.decide_style(counts, "paper_id", None if entries is None else style.bibliography_counts(entries, "paper_id", "entry"))


def load_vectors(papers: DataFrame, chunks: DataFrame, stored_papers: DataFrame, stored_chunks: DataFrame, make=vectors.HashingEmbedder, order: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The papers and chunks to add, embedded; whatever is stored drops out before the embedder runs."""
    p, c = vectors.new_papers_and_chunks(papers, chunks, stored_papers, stored_chunks, order=order)
    text = F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("abstract", F.lit("")))
    return vectors.embed(p, text, make).withColumn("uuid", vectors.uuid5("arxiv_id")), vectors.embed(c, F.col("chunk_text"), make).withColumn("uuid", vectors.uuid5("checksum"))


def ingest_vectors(stream: DataFrame, kind: str, store: str, checkpoint: str, make=vectors.HashingEmbedder) -> None:
    """V4/V6: a stream of papers or chunks (``kind``) into the vector store at ``store``, a micro-batch at a time.

    Each batch is checked against the store, embedded and appended; a batch that runs again appends
    nothing that is there. The store is a table of the kind's schema (K13).
    """
    schema, key = (vectors.PAPER_SCHEMA, "arxiv_id") if kind == "papers" else (vectors.CHUNK_SCHEMA, "checksum")

    def append(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        spark.createDataFrame([], schema).write.mode("append").parquet(store)  # the schema step: there is a table from now on
        held = spark.read.schema(schema).parquet(store)
        text = F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("abstract", F.lit(""))) if kind == "papers" else F.col("chunk_text")
        made = vectors.embed(vectors.not_stored(batch, held, key), text, make).withColumn("uuid", vectors.uuid5(key))
        materialize(made.select(*held.columns), "vectors").write.mode("append").parquet(store)

    stream.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def store_totals(papers: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row with the number of papers and chunks in two tables (all that is stored, or what was added)."""
    n = lambda rows, name: rows.agg(F.count("*").alias(name))
    return n(papers, "papers").crossJoin(n(chunks, "chunks"))  # two rows of one


def citation_graph(papers: DataFrame, texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges with CITES taken from the identifiers in each paper's text (id, text)."""
    from scholia.functions.text import clean_id

    found = texts.select("id", F.explode(references_in_text("text")).alias("ref")).select(F.col("id").alias("src"), clean_id("ref").alias("dst"))
    return graph.scholarly_graph(papers, found)


def answer(catalog: DataFrame, texts: DataFrame, question: str) -> str:
    """The text of the paper whose title is nearest to the question, or why there's none."""
    if not question or not question.strip():
        return NO_ANSWER
    spark = catalog.sparkSession
    glued = spark.createDataFrame([(question,)], "q string").select(glue(normalize_text("q")).alias("g")).first()["g"]
    best = resolve.search_title(catalog, glued).join(catalog.select("id", "arxiv_id"), "id").select("arxiv_id").first()
    if best is None:
        return "No paper was found for this question."
    text = texts.filter(F.col("arxiv_id") == best["arxiv_id"]).select("text").first()
    if text is None:
        return "The paper has no text."
    return text["text"] or "The text of the paper is empty."
