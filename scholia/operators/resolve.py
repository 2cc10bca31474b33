"""Resolving citations to the catalog: exact title, then trigram similarity, then author scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scholia.functions.names import author_tokens, tokens_match
from scholia.functions.text import once
from scholia.operators.trigrams import search

#: Candidates a query keeps, and the least trigram similarity.
CANDIDATES, SIMILARITY = 50, 0.3


def trigrams(text: Column | str) -> Column:
    """Distinct trigrams of one word padded by two spaces before and one after; none for an empty text."""
    text = F.col(text) if isinstance(text, str) else text
    padded = F.concat(F.lit("  "), text, F.lit(" "))
    grams = F.transform(F.sequence(F.lit(1), F.length(padded) - 2), lambda i: F.substring(padded, i, F.lit(3)))
    return F.when(F.length(text) > 0, F.array_distinct(grams)).otherwise(F.array().cast("array<string>"))


def exact_candidates(queries: DataFrame, catalog: DataFrame, limit: int = CANDIDATES) -> DataFrame:
    """Catalog rows with the query's glued title, the newest ``limit`` a query. Empty titles match nothing.

    Both sides have query_id/glued and id/glued/created_date; the rank orders candidates from 1.
    """
    hits = queries.filter(F.col("glued") != "").select("query_id", "glued").join(catalog.filter(F.col("glued") != "").select("glued", "id", "created_date"), "glued")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("created_date"), F.asc("id")))
    return hits.withColumn("cand_rank", rank).filter(F.col("cand_rank") <= limit).select("query_id", "id", "created_date", "cand_rank")


def trigram_candidates(queries: DataFrame, catalog: DataFrame, threshold: float = SIMILARITY, limit: int = CANDIDATES) -> DataFrame:
    """Catalog rows whose trigram similarity to the query reaches ``threshold``, the most similar first.

    Exact: each text's trigrams are counted in every title (see `trigrams`).
    """
    return search(queries.select("query_id", "glued"), catalog.select("id", "glued", "created_date"), threshold, limit)


def _near_by_authors(queries: DataFrame, catalog: DataFrame, threshold: float, limit: int) -> DataFrame:
    """`best_by_authors` of `trigram_candidates`; authors are compared where candidates are found, so that only
    candidates with a fitting author leave the search.

    Two names fit (`tokens_match`) if they share a word, or one's single letter begins a word of the other. A name's
    words, "^" with a beginning and "*" with a single letter make keys that fitting names, and only those, share.
    """
    words = lambda names: F.transform(F.coalesce(names, F.array().cast("array<string>")), author_tokens)
    single = lambda t: F.filter(t, lambda w: F.length(w) == 1)
    signed = lambda t, sign: F.transform(t, lambda w: F.concat(F.lit(sign), F.substring(w, 1, 1)))
    keys = lambda t, begins, letters: F.transform(F.array_distinct(F.concat(t, signed(begins, "^"), signed(letters, "*"))), lambda k: F.xxhash64(k))
    names = F.filter(F.array_distinct(words(F.col("authors"))), lambda t: F.size(t) > 0)
    asked = F.transform(names, lambda t: keys(t, single(t), t))
    held = once(F.flatten(words(F.col("authors"))), lambda t: keys(t, t, single(t)))
    found = search(queries.select("query_id", "glued", asked.alias("asked")), catalog.select("id", "glued", "created_date", held.alias("keys")), threshold, limit)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc_nulls_last("created_date"), F.asc("cand_rank"))
    return found.withColumn("_rn", F.row_number().over(order)).filter("_rn = 1").select("query_id", "id", "score")


def best_by_authors(candidates: DataFrame, queries: DataFrame, catalog: DataFrame) -> DataFrame:
    """A4: one candidate a query, by the number of distinct query authors it has, then date, then rank.

    Without query authors (or any usable word in them) the first candidate counts; with them a
    candidate none of them fits drops out.
    """
    asked = queries.select("query_id", F.array_distinct("authors").alias("authors"))
    words = F.filter(F.transform(F.coalesce("authors", F.array().cast("array<string>")), author_tokens), lambda t: F.size(t) > 0)
    asked = asked.select("query_id", F.array_distinct(words).alias("qa"))
    held = catalog.select("id", F.transform(F.coalesce("authors", F.array().cast("array<string>")), author_tokens).alias("ca"))
    rows = candidates.join(asked, "query_id").join(held, "id")
    score = F.size(F.filter("qa", lambda q: F.exists("ca", lambda c: tokens_match(q, c))))
    scored = rows.withColumn("score", F.when(F.size("qa") == 0, F.lit(0)).otherwise(score))
    usable = scored.filter((F.size("qa") == 0) | (F.col("score") > 0))
    newest = F.when(F.size("qa") > 0, F.col("created_date"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc_nulls_last(newest), F.asc("cand_rank"))
    return usable.withColumn("_rn", F.row_number().over(order)).filter("_rn = 1").select("query_id", "id", F.col("score").cast("int").alias("score"))


def resolve(queries: DataFrame, catalog: DataFrame, threshold: float = SIMILARITY, limit: int = CANDIDATES) -> DataFrame:
    """(query_id, id, score, stage). Exact candidates without a fitting author end the search (Q6)."""
    exact = exact_candidates(queries, catalog, limit)
    rest = queries.join(exact.select("query_id").distinct(), "query_id", "left_anti")
    first = best_by_authors(exact, queries, catalog).withColumn("stage", F.lit("exact"))
    return first.unionByName(_near_by_authors(rest, catalog, threshold, limit).withColumn("stage", F.lit("trigram")))


def lookup(ids: DataFrame, catalog: DataFrame, key: str = "arxiv_id") -> DataFrame:
    """The catalog rows of a list of ids."""
    return catalog.join(ids.select(key).distinct(), key, "left_semi")


def search_title(catalog: DataFrame, glued: str, limit: int = 1) -> DataFrame:
    """The most similar titles to one query string, by one scan: (query_id, id, created_date, cand_rank, similarity).

    Titles that share no trigram with it aren't similar; ties go to the smaller id.
    """
    padded = f"  {glued} "
    asked = sorted({padded[i : i + 3] for i in range(len(padded) - 2)}) if glued else []
    grams = catalog.select("id", "created_date", trigrams("glued").alias("_g"))
    shared = F.size(F.array_intersect("_g", F.array(*map(F.lit, asked)).cast("array<string>")))
    found = grams.select("id", "created_date", F.size("_g").alias("_n"), shared.alias("_s")).filter("_s > 0")
    scored = found.select(F.lit(0).cast("long").alias("query_id"), "id", "created_date", (F.col("_s") / (len(asked) + F.col("_n") - F.col("_s"))).alias("similarity"))
    best = scored.orderBy(F.desc("similarity"), "id").limit(limit)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("similarity"), "id"))  # of at most ``limit`` rows
    return best.select("query_id", "id", "created_date", rank.alias("cand_rank"), "similarity")
