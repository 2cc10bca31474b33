"""Vector store operators: existence checks, embedding, upsert, exact and hybrid search."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import Protocol

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scholia.functions.text import tokens, uuid5
from scholia.session import materialize

PAPER_SCHEMA = "arxiv_id string, title string, abstract string, vector array<float>, uuid string"
CHUNK_SCHEMA = "chunk_paper_id string, chunk_id string, chunk_num int, section_title string, chunk_text string, token_len int, checksum string, vector array<float>, uuid string"


class Embedder(Protocol):
    """V1: turns texts into vectors; made once in each worker."""

    def batch_encode(self, texts: Sequence[str]) -> np.ndarray: ...

    def shutdown(self) -> None: ...


class HashingEmbedder:
    """V2, offline: signed counts of hashed words, as a unit vector."""

    def __init__(self, dim: int = 64) -> None:
        self.dim, self.open = dim, True

    def batch_encode(self, texts: Sequence[str]) -> np.ndarray:
        if not self.open:
            raise RuntimeError("the embedder was shut down")
        out = np.zeros((len(texts), self.dim), np.float32)
        import xxhash

        for row, text in enumerate(texts):
            for word in text.lower().split():
                h = xxhash.xxh64_intdigest(word)
                out[row, (h >> 1) % self.dim] += 1.0 if h & 1 else -1.0
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.maximum(norm, 1e-12)

    def shutdown(self) -> None:
        self.open = False


def embed(rows: DataFrame, text: Column, make=HashingEmbedder, batch: int = 256) -> DataFrame:
    """``rows`` with a vector for ``text``; a null text counts as empty. One embedder a task, shut down at its end."""

    @F.arrow_udf("array<float>")
    def encode(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        embedder = make()
        try:
            for column in columns:
                texts = [t or "" for t in column.to_pylist()]
                parts = [embedder.batch_encode(texts[k : k + batch]) for k in range(0, len(texts), batch)]
                flat = np.concatenate(parts) if parts else np.empty((0, 1), np.float32)
                yield pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1) * flat.shape[1], pa.int32()), pa.array(flat.ravel(), pa.float32()))
        finally:
            embedder.shutdown()

    return rows.withColumn("vector", encode(text))


def not_stored(incoming: DataFrame, stored: DataFrame, key: str, order: str | None = None) -> DataFrame:
    """Rows whose key isn't stored, one row a key (the first by ``order``, else any); before anything costly is done to them."""
    keyed = incoming.filter(F.col(key).isNotNull())
    if order is None:
        one = keyed.dropDuplicates([key])
    else:
        others = [c for c in incoming.columns if c != key]
        one = keyed.groupBy(key).agg(F.min_by(F.struct(*others), order).alias("_r")).select(*(c if c == key else F.col("_r")[c].alias(c) for c in incoming.columns))
    return one.join(stored.select(key), key, "left_anti")


def new_papers_and_chunks(papers: DataFrame, chunks: DataFrame, stored_papers: DataFrame, stored_chunks: DataFrame, old_papers_too: bool = False, order: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Papers that aren't stored, and of their chunks (or of all) those whose checksum isn't."""
    fresh = not_stored(papers, stored_papers, "arxiv_id")
    of_fresh = chunks if old_papers_too else chunks.join(fresh.select(F.col("arxiv_id").alias("chunk_paper_id")), "chunk_paper_id", "left_semi")
    return fresh, not_stored(of_fresh, stored_chunks, "checksum", order)


def upsert(stored: DataFrame, incoming: DataFrame, key: str, order: Column | None = None) -> DataFrame:
    """The stored rows with those of ``incoming`` in place of rows of equal uuid (version 5, from ``key``).

    Of incoming rows with one uuid the last counts, by ``order`` or else as they come.
    """
    place = F.monotonically_increasing_id() if order is None else order
    marked = incoming.withColumns({"uuid": uuid5(key), "_o": place})
    last = marked.groupBy("uuid").agg(F.max_by(F.struct(*(c for c in incoming.columns if c != "uuid")), "_o").alias("_r"))
    new = last.select("uuid", *(F.col("_r")[c].alias(c) for c in incoming.columns if c != "uuid"))
    return stored.join(new.select("uuid"), "uuid", "left_anti").unionByName(new.select(*stored.columns))


def by_property(stored: DataFrame, column: str, value: str, limit: int = 1) -> DataFrame:
    """Rows with a property, at most ``limit``."""
    return stored.filter(F.col(column) == value).limit(limit)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine_topk(queries: DataFrame, stored: DataFrame, k: int = 5, dim: int = 64, block: int = 2048, where: Column | None = None) -> DataFrame:
    """V7, exact: (query_id, vec_id, similarity, rank) of the k most similar stored vectors of each query.

    Queries x stored is a grid of blocks, each one matrix product in one task whose k best a query
    are kept; blocks are bounded, so neither side has to fit anywhere. Vectors of another length,
    with a value that isn't finite, or all zero take no part. Ties go to the smaller id. ``where``, a
    condition on the columns of ``stored``, picks the rows that are searched before the search.
    """
    unit = _unit(dim)
    stored = stored if where is None else stored.filter(where)
    q = queries.select(F.col("query_id").cast("long").alias("id"), "vector").mapInArrow(unit, "id long, v binary")
    s = stored.select(F.col("vec_id").cast("long").alias("id"), "vector").mapInArrow(unit, "id long, v binary")
    n_q, n_s = (max(1, -(-rows.count() // block)) for rows in (queries, stored))
    side = lambda rows, seed, own, n_own, other, n_other, tag: rows.select(
        F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(n_own)).cast("int").alias(own), F.explode(F.sequence(F.lit(0), F.lit(n_other - 1))).alias(other), F.lit(tag).alias("is_query"), "id", "v"
    )
    grid = side(q, 1, "qb", n_q, "sb", n_s, True).unionByName(side(s, 2, "sb", n_s, "qb", n_q, False))
    best = grid.groupBy("qb", "sb").applyInArrow(_block_topk(k, dim), "query_id long, vec_id long, similarity double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("similarity"), F.asc("vec_id")))
    return best.withColumn("rank", rank).filter(F.col("rank") <= k)


def _unit(dim: int):
    def unit(batches):
        for batch in batches:
            ids, keep, out = batch.column(0).to_pylist(), [], []
            for i, v in zip(ids, batch.column(1).to_pylist(), strict=True):
                if v is None or len(v) != dim or any(x is None for x in v):
                    continue
                x = np.asarray(v, np.float64)
                norm = np.linalg.norm(x)
                if np.isfinite(norm) and norm > 0:
                    keep.append(i), out.append((x / norm).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(keep, pa.int64()), pa.array(out, pa.binary())], ["id", "v"])

    return unit


def _block_topk(k: int, dim: int):
    def topk(key: tuple[pa.Scalar, ...], tab: pa.Table) -> pa.Table:
        ids, is_query = tab["id"].to_numpy(), tab["is_query"].to_numpy(zero_copy_only=False).astype(bool)
        x = np.frombuffer(b"".join(tab["v"].to_pylist()), np.float64).reshape(-1, dim)
        order = np.argsort(ids[~is_query], kind="stable")
        m, members = ids[~is_query][order], x[~is_query][order]
        q = ids[is_query]
        if not len(m) or not len(q):
            return pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "similarity": pa.array([], pa.float64())})
        sims = np.round(x[is_query] @ members.T, 12)
        top = np.argsort(-sims, axis=1, kind="stable")[:, :k]  # stable: ties by id
        return pa.table({"query_id": pa.array(np.repeat(q, top.shape[1]), pa.int64()), "vec_id": pa.array(m[top].ravel(), pa.int64()), "similarity": pa.array(np.take_along_axis(sims, top, 1).ravel(), pa.float64())})

    return topk


def approx_topk(queries: DataFrame, stored: DataFrame, k: int = 5, dim: int = 64, tables: int = 24, bits: int = 8, seed: int = 7, where: Column | None = None) -> DataFrame:
    """V7, approximate: as `cosine_topk`, but only vectors that share a bucket with the query are compared.

    A bucket is the side of ``bits`` random planes a vector is on, in each of ``tables`` draws; the
    similarity of those that meet is exact.
    """
    unit, planes = _unit(dim), np.random.default_rng(seed).normal(size=(tables * bits, dim))
    weights = 1 << np.arange(bits)

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in unit(batches):
            x = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.float64).reshape(-1, dim)
            codes = ((x @ planes.T > 0).reshape(-1, tables, bits) * weights).sum(2) + (np.arange(tables) << bits)
            buckets = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * tables, pa.int32()), pa.array(codes.ravel(), pa.int32()))
            vectors = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * dim, pa.int32()), pa.array(x.ravel(), pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), vectors, buckets], ["id", "v", "b"])

    schema = "id long, v array<double>, b array<int>"
    q = queries.select(F.col("query_id").cast("long").alias("id"), "vector").mapInArrow(signed, schema)
    s = (stored if where is None else stored.filter(where)).select(F.col("vec_id").cast("long").alias("id"), "vector").mapInArrow(signed, schema)
    met = q.select(F.col("id").alias("query_id"), F.explode("b").alias("b")).join(s.select(F.col("id").alias("vec_id"), F.explode("b").alias("b")), "b").select("query_id", "vec_id").distinct()
    pairs = met.join(q.select(F.col("id").alias("query_id"), F.col("v").alias("_q")), "query_id").join(s.select(F.col("id").alias("vec_id"), F.col("v").alias("_s")), "vec_id")
    scored = pairs.select("query_id", "vec_id", F.round(dot(F.col("_q"), F.col("_s")), 12).alias("similarity"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("similarity"), F.asc("vec_id")))
    return scored.withColumn("rank", rank).filter(F.col("rank") <= k)


def term_index(documents: DataFrame, key: str, text: str) -> DataFrame:
    """Postings (key, length, term, tf) of a text column."""
    terms = documents.select(F.col(key), tokens(F.lower(text)).alias("_t"))
    return terms.select(key, F.size("_t").alias("length"), F.explode("_t").alias("term")).groupBy(key, "length", "term").agg(F.count("*").alias("tf"))


#: Queries that are answered in one pass over the documents.
QUERY_BLOCK = 1024


def bm25(documents: DataFrame, key: str, text: str, queries: DataFrame, k: int = 10, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """V7: (query_id, key, score, rank) of the k best documents of each query by BM25; ties go to the smaller key.

    ``queries``: (query_id, text). A document is scored against a block of queries where it is read, and
    only the best of a batch leave the task: neither postings nor scores of all pairs are shuffled, and
    frequent words cost no more than rare ones. One pass counts, one scores; more than QUERY_BLOCK
    queries take a pass of each for every further block.
    """
    asked = materialize(queries.select("query_id", F.array_distinct(tokens(F.lower("text"))).alias("terms")).filter(F.size("terms") > 0), "queries")
    blocks = max(1, -(-asked.count() // QUERY_BLOCK))
    lists = documents.select(F.col(key).alias("key"), tokens(F.lower(text)).alias("t"))
    kinds = {"query_id": asked.schema["query_id"].dataType, "key": lists.schema["key"].dataType}
    out = None
    for n in range(blocks):
        block = asked.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == n).sort("query_id").collect()  # QUERY_BLOCK rows, about
        found = _bm25_block(lists, block, kinds, k, k1, b)
        out = found if out is None else out.unionByName(found)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("key")))
    return out.withColumn("rank", rank).filter(F.col("rank") <= k).withColumnRenamed("key", key)


def _term_counts(column: pa.Array, vocabulary: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(rows, terms, counts) of the vocabulary's terms in lists of tokens, and the lengths of the lists."""
    lengths = np.diff(column.offsets.to_numpy()).astype(np.int64)
    code = pa.compute.index_in(column.flatten(), value_set=vocabulary)
    row = np.repeat(np.arange(len(lengths)), lengths)
    known = code.is_valid().to_numpy(zero_copy_only=False)
    at = row[known] * len(vocabulary) + code.drop_null().to_numpy()
    at, count = np.unique(at, return_counts=True)
    return at // max(1, len(vocabulary)), at % max(1, len(vocabulary)), count, lengths


def _bm25_block(lists: DataFrame, block: list, kinds: dict, k: int, k1: float, b: float) -> DataFrame:
    words = sorted({t for r in block for t in r["terms"]})
    number = {w: i for i, w in enumerate(words)}
    weight = np.zeros((len(words), len(block)))
    for q, r in enumerate(block):
        weight[[number[t] for t in r["terms"]], q] = 1.0

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, df, n, total = pa.array(words, pa.string()), np.zeros(len(words), np.int64), 0, 0
        for batch in batches:
            _, term, _, lengths = _term_counts(batch.column("t"), vocabulary)
            df += np.bincount(term, minlength=len(words))
            n, total = n + len(lengths), total + int(lengths.sum())
        yield pa.RecordBatch.from_arrays([pa.array([*range(len(words)), -1, -2], pa.int32()), pa.array([*df.tolist(), n, total], pa.int64())], ["term", "n"])

    counts = {r["term"]: r["n"] for r in lists.select("t").mapInArrow(count, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()}  # a row a query term
    n_docs, length = counts.get(-1, 0), counts.get(-2, 0)
    df = np.array([counts.get(i, 0) for i in range(len(words))], np.float64)
    idf = np.log(1.0 + (n_docs - df + 0.5) / (df + 0.5))
    average = max(length / max(1, n_docs), 1e-12)
    ids = [r["query_id"] for r in block]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = pa.array(words, pa.string())
        for whole in batches:
            for start in range(0, whole.num_rows, 1024):
                batch = whole.slice(start, 1024)
                row, term, tf, lengths = _term_counts(batch.column("t"), vocabulary)
                part = np.zeros((batch.num_rows, len(words)))
                part[row, term] = idf[term] * tf * (k1 + 1) / (tf + k1 * (1 - b + b * lengths[row] / average))
                scores = np.round(part @ weight, 6)
                least = np.partition(scores, len(scores) - k, axis=0)[len(scores) - k] if len(scores) > k else np.zeros(len(ids))
                doc, q = np.nonzero((scores >= least) & (scores > 0))  # with all ties of the last
                yield pa.RecordBatch.from_arrays([pa.array([ids[i] for i in q], batch_types[0]), batch.column("key").take(pa.array(doc)), pa.array(scores[doc, q], pa.float64())], ["query_id", "key", "score"])

    from pyspark.sql.pandas.types import to_arrow_type

    batch_types = [to_arrow_type(kinds["query_id"])]
    return lists.mapInArrow(score, f"query_id {kinds['query_id'].simpleString()}, key {kinds['key'].simpleString()}, score double")


def fuse_ranks(first: DataFrame, second: DataFrame, key: str, k: int = 10, constant: int = 60) -> DataFrame:
    """V7, hybrid: reciprocal rank fusion of two rankings (query_id, key, rank)."""
    both = first.select("query_id", key, "rank").unionByName(second.select("query_id", key, "rank"))
    total = both.groupBy("query_id", key).agg(F.round(F.sum(1.0 / (constant + F.col("rank"))), 9).alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc(key)))
    return total.withColumn("rank", rank).filter(F.col("rank") <= k)


def centroids(rows: DataFrame, label: str, vector: str) -> DataFrame:
    """(label, dim, value): the mean vector of each label, a row a dimension."""
    return rows.select(label, F.posexplode(vector).alias("dim", "x")).groupBy(label, "dim").agg(F.avg(F.col("x").cast("double")).alias("value"))


def assign_nearest(rows: DataFrame, key: str, vector: str, centres: Sequence[Sequence[float]]) -> DataFrame:
    """(key, label): the nearest of a fixed, small list of centres by cosine."""
    c = np.asarray(centres, np.float64)
    c = c / np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)

    @F.arrow_udf("int")
    def nearest(column: pa.Array) -> pa.Array:
        return pa.array([None if v is None or len(v) != c.shape[1] else int(np.argmax(c @ np.asarray(v, np.float64))) for v in column.to_pylist()], pa.int32())

    return rows.select(key, nearest(vector).alias("label"))
