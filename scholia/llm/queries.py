"""The registered queries of this subpackage, each over its whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scholia.session import spread, table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    from scholia.llm.names import variant_pairs

    papers = table(spark, d, "papers").select(F.explode("normalized_authors").alias("name"))
    cited = table(spark, d, "citations").select(F.explode("authors_str").alias("name"))
    return variant_pairs(papers.unionByName(cited))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    from scholia.llm.survivors import best_values

    return best_values(table(spark, d, "papers")).select("group_id", "field", "row_id")


def p2_survivors(spark: SparkSession, d: str) -> DataFrame:
    """The built record of each group of duplicates and its best whole row."""
    from scholia.llm.survivors import survivors

    return survivors(table(spark, d, "papers"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    from scholia.llm.neighbours import neighbour_pairs

    pairs = neighbour_pairs(table(spark, d, "chunks"), "chunk_seq", "vector")
    return pairs.select(F.col("a").alias("chunk_seq_a"), F.col("b").alias("chunk_seq_b"))


def p4_matches(spark: SparkSession, d: str) -> DataFrame:
    """Matches of papers and works with their confidence."""
    from scholia.llm.record_match import match_records

    col = F.col
    found = match_records(
        table(spark, d, "papers"), table(spark, d, "works"), (col("id"), col("title"), col("normalized_authors"), col("created_date")), (col("id"), col("title"), col("authors"), col("publication_date"))
    )
    return found.select(col("a").cast("long").alias("paper_id"), col("b").alias("work_id"), "confidence")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return p4_matches(spark, d).select("paper_id", "work_id")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    from scholia.llm.batch_dedup import arxiv_key, repeated_keys, repeated_texts

    texts = repeated_texts(table(spark, d, "chunks"), "chunk_seq", "batch_no", "chunk_text")
    papers = repeated_keys(table(spark, d, "papers"), "id", "batch_no", arxiv_key(F.col("arxiv_id")))
    named = lambda rows, src: rows.select(F.lit(src).alias("src"), F.col("key").alias("row_key"))
    return named(texts, "chunks").unionByName(named(papers, "papers"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    from scholia.llm.format_duplicates import canonical_record, repeats_of

    return repeats_of(table(spark, d, "papers"), canonical_record(F.col("title_and_authors"), F.col("title")))


def p6_copies(spark: SparkSession, d: str) -> DataFrame:
    """Number of copies of every record of papers, by title_and_authors; title tells where its title ends."""
    from scholia.llm.format_duplicates import canonical_record, collapse_format_duplicates

    rows = collapse_format_duplicates(table(spark, d, "papers"), canonical_record(F.col("title_and_authors"), F.col("title")))
    return rows.filter("id = first_id").select("first_id", "copies")


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    from scholia.llm.bpe import encode_corpus

    return encode_corpus(table(spark, d, "documents")).select("doc_id", "ids")


def p8_containers(spark: SparkSession, d: str) -> DataFrame:
    from scholia.llm.bpe import bpe_count
    from scholia.llm.packing import pack_items

    sized = spread(table(spark, d, "documents")).select("doc_id", bpe_count("text").alias("n_tokens"))
    return pack_items(sized, "doc_id", "n_tokens", 1024)


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    from scholia.llm.encoding_repair import repair

    return repair(table(spark, d, "documents").select("doc_id", "text")).filter("garbled").select("doc_id")


def p9_restored(spark: SparkSession, d: str) -> DataFrame:
    """Every document with the text it should have."""
    from scholia.llm.encoding_repair import repair

    return repair(table(spark, d, "documents").select("doc_id", "text")).select("doc_id", "restored", "garbled", "whole")


QUERIES = {f.__name__: f for f in (p1_found, p2_found, p2_survivors, p3_found, p4_matches, p4_found, p5_found, p6_found, p6_copies, p7_ids, p8_containers, p9_found, p9_restored)}
ORACLE_SQL: dict[str, str] = {}
