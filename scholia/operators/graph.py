"""Property graph of papers, authors and categories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scholia.operators import vectors as V


def nodes(rows: DataFrame, key: Column, properties: dict[str, Column], order: Column) -> DataFrame:
    """One node a key, with the properties of the last row by ``order``. Null keys make no node."""
    packed = F.struct(order.alias("_o"), *(c.alias(n) for n, c in properties.items()))
    last = rows.filter(key.isNotNull()).groupBy(key.alias("id")).agg(F.max(packed).alias("_p"))
    return last.select("id", *(F.col("_p")[n].alias(n) for n in properties))


def distinct_values(rows: DataFrame, items: Column) -> DataFrame:
    """The nodes of a list column."""
    return rows.select(F.explode(items).alias("id")).filter("id IS NOT NULL AND id <> ''").distinct()


def edges(rows: DataFrame, src: Column, dst: Column, kind: str) -> DataFrame:
    """Distinct (src, dst, type) without null ends and loops."""
    return rows.select(src.alias("src"), dst.alias("dst")).filter("src IS NOT NULL AND dst IS NOT NULL AND src <> dst").distinct().withColumn("type", F.lit(kind))


def between(edges_: DataFrame, sources: DataFrame, targets: DataFrame) -> DataFrame:
    """Only the edges both of whose ends exist."""
    return edges_.join(sources.select(F.col("id").alias("src")), "src", "left_semi").join(targets.select(F.col("id").alias("dst")), "dst", "left_semi").select("src", "dst", "type")


#: G1: the properties of a paper's node, and their types.
PAPER_PROPERTIES = {"title": "string", "doi": "string", "published": "date", "updated": "date", "summary": "string", "url": "string"}


def arxiv_result(rows: DataFrame, entry: Column, updated: Column, published: Column) -> DataFrame:
    """``rows`` with entry_id (the last part of the entry's address) and both dates as yyyy-MM-dd."""
    shown = lambda c: F.date_format(c, "yyyy-MM-dd")
    return rows.withColumns({"entry_id": F.element_at(F.split(entry, "/"), -1), "updated": shown(updated), "published": shown(published)})


def scholarly_graph(papers: DataFrame, citations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) from papers (id, authors, categories, order and any of PAPER_PROPERTIES) and citations (src, dst).

    Nodes have id, label and all PAPER_PROPERTIES, null where there's none.
    """
    own = {n: (F.col(n) if n in papers.columns else F.lit(None)).cast(t) for n, t in PAPER_PROPERTIES.items()}
    none = [F.lit(None).cast(t).alias(n) for n, t in PAPER_PROPERTIES.items()]
    paper = nodes(papers, F.col("id"), own, F.col("order")).select("id", F.lit("Paper").alias("label"), *own)
    author = distinct_values(papers, F.col("authors")).select("id", F.lit("Author").alias("label"), *none)
    category = distinct_values(papers, F.col("categories")).select("id", F.lit("Category").alias("label"), *none)
    wrote = edges(papers.select(F.explode("authors").alias("a"), "id"), F.col("a"), F.col("id"), "WROTE")
    within = edges(papers.select("id", F.explode("categories").alias("c")), F.col("id"), F.col("c"), "IN_CATEGORY")
    cites = between(edges(citations, F.col("src"), F.col("dst"), "CITES"), paper, paper)
    return paper.unionByName(author).unionByName(category), wrote.unionByName(within).unionByName(cites)


def similar_edges(rows: DataFrame, key: str, vector: str, k: int = 5, least: float = 0.0) -> DataFrame:
    """(src, dst, type, similarity): SIMILAR_TO from each row to its ``k`` nearest others of at least ``least`` cosine.

    The search is exact, so its work grows with the square of the rows.
    """
    stored = rows.select(F.col(key).alias("vec_id"), F.col(vector).alias("vector"))
    found = V.cosine_topk(stored.withColumnRenamed("vec_id", "query_id"), stored, k + 1).filter("query_id <> vec_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))
    kept = found.withColumn("_rn", rank).filter((F.col("_rn") <= k) & (F.col("similarity") >= least))
    return kept.select(F.col("query_id").alias("src"), F.col("vec_id").alias("dst"), F.lit("SIMILAR_TO").alias("type"), "similarity")


def concept_clusters(vectors: DataFrame, key: str, vector: str, k: int, seed: int = 7) -> DataFrame:
    """(key, concept) by k-means over the vectors (Spark ML, distributed)."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    rows = vectors.filter(F.col(vector).isNotNull()).select(F.col(key), array_to_vector(F.col(vector).cast("array<double>")).alias("features"))
    return KMeans(k=k, seed=seed, maxIter=10).fit(rows).transform(rows).select(key, F.col("prediction").alias("concept"))


def concept_labels(assigned: DataFrame, texts: DataFrame, key: str, text: str, top: int = 5) -> DataFrame:
    """(concept, term, weight, rank): the words that mark a concept, by tf-idf over concepts."""
    from pyspark.sql import Window

    words = texts.select(key, F.explode(F.regexp_extract_all(F.lower(text), F.lit("([a-z]{4,})"), F.lit(1))).alias("term"))
    tf = words.join(assigned, key).groupBy("concept", "term").agg(F.count("*").alias("tf"))
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    n = assigned.select("concept").distinct().agg(F.count("*").alias("n"))
    scored = tf.join(df, "term").crossJoin(F.broadcast(n)).withColumn("weight", F.round(F.col("tf") * F.log((F.col("n") + 1.0) / F.col("df")), 6))
    rank = F.row_number().over(Window.partitionBy("concept").orderBy(F.desc("weight"), F.asc("term")))
    return scored.withColumn("rank", rank).filter(F.col("rank") <= top).select("concept", "term", "weight", "rank")
