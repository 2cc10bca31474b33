"""The k most similar vectors of every vector, over balanced posting lists.

Centroids are fitted on a bounded sample and searched by an in-memory graph in the workers. A vector
is stored in its nearest list and, if it lies near a boundary, in further ones; the lists a query
reads are picked by the same distance ratio. A list that holds too many gets centroids of its own,
fitted in a task on a sample of its members and kept in a file that workers read, and so on until all
are small: lists stay balanced and their number grows with the vectors, while no task and not the
driver holds more than one level of one list. A list is then one block product of its queries with
its members, and a query's partial results are merged.
Equal directions are one representative with its first few row ids, so a group of copies of any
share of the rows costs as much as a single vector.
"""

from __future__ import annotations

import os
import uuid
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholia.session import local_path, materialize, scratch_path

#: Members a list has on average, and members (or queries) a block of a list has at most.
LIST_SIZE = 128
MAX_BLOCK = 2048
#: Vectors the first centroids are fitted on, at most, and so many of them a centroid at least; every vector is
#: indexed whatever the sample.
MAX_SAMPLE, SAMPLE_PER_LIST = 100_000, 16
#: A list of more than so many times the average is divided, into so many parts at most at a time.
CROWDED, MAX_PARTS = 8, 1024
#: Members of one list that one task divides, about.
TASK_ROWS = 100_000
#: A list is read (stored in) if its distance is at most this ratio of the nearest list's, up to so many lists.
READ_RATIO, MAX_READ = 1.15, 3
STORE_RATIO, MAX_STORE = 1.05, 2


class CentroidGraph:
    """Centroids with links to their nearest ones, entered through hubs; a search is a beam over the links."""

    def __init__(self, centroids: np.ndarray, degree: int = 24, seed: int = 7) -> None:
        n = len(centroids)
        self.centroids = centroids
        hubs = max(1, int(round(np.sqrt(n))))
        # Every hub links to about four times its share, so that hubs overlap and no list is out of reach.
        self.degree, hub_links = min(degree, n), min(max(48, 4 * hubs), n)
        self.hubs = _fit(centroids, hubs, 4, seed)
        self.entry = np.argsort(-(self.hubs @ centroids.T), axis=1)[:, :hub_links].astype(np.int32)
        self.links = np.empty((n, self.degree), np.int32)
        for a in range(0, n, 2048):
            near = centroids[a : a + 2048] @ centroids.T
            self.links[a : a + 2048] = np.argpartition(-near, self.degree - 1, axis=1)[:, : self.degree]

    def search(self, x: np.ndarray, k: int, beam: int = 4) -> tuple[np.ndarray, np.ndarray]:
        """(lists, similarities) of the k nearest centroids of each row of x, best first."""
        k = min(k, len(self.centroids))
        lists, sims = np.empty((len(x), k), np.int32), np.empty((len(x), k), np.float32)
        for a in range(0, len(x), 1024):
            lists[a : a + 1024], sims[a : a + 1024] = self._search(x[a : a + 1024], k, beam)
        return lists, sims

    def _search(self, x: np.ndarray, k: int, beam: int) -> tuple[np.ndarray, np.ndarray]:
        first = np.argpartition(-(x @ self.hubs.T), min(beam, len(self.hubs)) - 1, axis=1)[:, :beam]
        found = self.entry[first].reshape(len(x), -1)
        found, sims = self._best(x, found, max(k, beam))
        links = self.links[found[:, :beam]].reshape(len(x), -1)
        found, sims = self._best(x, np.concatenate([found, links], axis=1), k)
        return found, sims

    def _best(self, x: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        ids = np.sort(ids, axis=1)
        sims = np.einsum("nkd,nd->nk", self.centroids[ids], x)
        sims[:, 1:][ids[:, 1:] == ids[:, :-1]] = -9
        k = min(k, ids.shape[1])
        best = np.argsort(-sims, axis=1)[:, :k]
        return np.take_along_axis(ids, best, 1), np.take_along_axis(sims, best, 1)


def _fit(x: np.ndarray, k: int, rounds: int, seed: int) -> np.ndarray:
    """Spherical k-means; lists that run empty restart in the fullest ones, which balances them."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        own = np.concatenate([np.argmax(x[a : a + 8192] @ c.T, axis=1) for a in range(0, len(x), 8192)])
        order = np.argsort(own, kind="stable")
        begin = np.searchsorted(own[order], np.arange(len(c)))
        size = np.diff(np.append(begin, len(x)))
        full = size > 0
        sums = np.zeros_like(c)
        sums[full] = np.add.reduceat(x[order], begin[full], axis=0)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        c = np.where(norm > 1e-12, sums / np.maximum(norm, 1e-12), c)
        if (empty := np.flatnonzero(~full)).size:
            crowd = np.argsort(-size)[: len(empty)]
            c[empty[: len(crowd)]] = x[order[begin[crowd] + rng.integers(0, size[crowd])]]
    return np.ascontiguousarray(c, np.float32)


def _unit(dim: int):
    def unit(batches):
        """Usable vectors as unit vectors, with a key that equal directions share."""
        for batch in batches:
            ids, lists = batch.column(0), batch.column(1)
            size = np.diff(lists.offsets.to_numpy()) if isinstance(lists, pa.ListArray) else None
            ok = (size == dim) & ~lists.is_null().to_numpy(zero_copy_only=False)
            keep = lists.filter(pa.array(ok))
            flat = keep.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
            good = np.isfinite(flat).all(axis=1)
            flat = np.where(good[:, None], flat, 0)
            scale = np.abs(flat).max(axis=1, initial=0)
            good &= scale > 0
            x = flat[good] / scale[good][:, None]  # scaled first: squares of tiny or huge numbers leave the range
            x /= np.linalg.norm(x, axis=1, keepdims=True)
            x = x.astype(np.float32)
            yield pa.RecordBatch.from_arrays(
                [ids.filter(pa.array(ok)).filter(pa.array(good)), pa.array(list(map(bytes, np.round(x * 32767).astype(np.int16))), pa.binary()), pa.array([v.tobytes() for v in x], pa.binary())],
                ["id", "key", "vector"],
            )

    return unit


def _matrix(column, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()) if isinstance(column, (pa.Array, pa.ChunkedArray)) else b"".join(column), np.float32).reshape(-1, dim)


def _choose(graph: CentroidGraph, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, list, whether it's stored there) of the lists each row of x reads, by the ratio of distances."""
    lists, sims = graph.search(x, MAX_READ)
    distance = np.sqrt(np.maximum(0, 2 - 2 * sims))
    ratio = distance / np.maximum(distance[:, :1], 1e-6)
    rank = np.arange(lists.shape[1])
    read = (ratio <= READ_RATIO) | (rank == 0)
    stored = ((ratio <= STORE_RATIO) & (rank < MAX_STORE)) | (rank == 0)
    row, at = np.nonzero(read | stored)
    return row, lists[row, at], stored[row, at]


_POSTS = "list long, rep long, vector binary, stored boolean"


def _postings(centroids: np.ndarray, dim: int):
    def postings(batches):
        """A row for each list a vector reads; `stored` says whether it's a member there too."""
        graph = CentroidGraph(centroids)
        for batch in batches:
            x = _matrix(batch.column(1), dim)
            if not len(x):
                continue
            row, lists, stored = _choose(graph, x)
            take = pa.array(row)
            yield pa.RecordBatch.from_arrays([pa.array(lists, pa.int64()), batch.column(0).take(take), batch.column(1).take(take), pa.array(stored)], ["list", "rep", "vector", "stored"])

    return postings


def _write_centroids(root: str, name: str, centroids: np.ndarray) -> None:
    """Whole or not at all, so a repeated task does no harm."""
    data = centroids.astype(np.float32).tobytes()
    if root.startswith(("file:", "/")):
        folder = local_path(root)
        os.makedirs(folder, exist_ok=True)
        part = f"{folder}/.{name}-{uuid.uuid4().hex}"
        with open(part, "wb") as out:
            out.write(data)
        os.replace(part, f"{folder}/{name}")
        return
    from pyarrow import fs

    files, path = fs.FileSystem.from_uri(root)
    files.create_dir(path, recursive=True)
    with files.open_output_stream(f"{path}/.{name}-{(mark := uuid.uuid4().hex)}") as out:
        out.write(data)
    files.move(f"{path}/.{name}-{mark}", f"{path}/{name}")


@lru_cache(maxsize=4)
def _graph_of(root: str, name: str, dim: int) -> CentroidGraph:
    if root.startswith(("file:", "/")):
        with open(f"{local_path(root)}/{name}", "rb") as file:
            data = file.read()
    else:
        from pyarrow import fs

        files, path = fs.FileSystem.from_uri(root)
        with files.open_input_stream(f"{path}/{name}") as file:
            data = file.read()
    return CentroidGraph(np.frombuffer(data, np.float32).reshape(-1, dim))


def _fit_lists(root: str, dim: int):
    def fit(key: tuple[pa.Scalar, ...], tab: pa.Table) -> pa.Table:
        """Centroids of one crowded list, from the sample of its members, as a file; how many there are."""
        x = _matrix(tab["vector"], dim)
        made = _fit(x, min(tab["parts"][0].as_py(), len(x)), 6, 11)
        # Parts that would hold few are left to their neighbours, so that whoever reads one finds enough in it.
        size = np.bincount(np.concatenate([np.argmax(x[a : a + 8192] @ made.T, axis=1) for a in range(0, len(x), 8192)]), minlength=len(made))
        made = made[large] if (large := size >= SAMPLE_PER_LIST // 2).any() else made
        _write_centroids(root, str(key[0].as_py()), made)
        return pa.table({"list": pa.array([key[0].as_py()], pa.int64()), "made": pa.array([len(made)], pa.int32())})

    return fit


def _divide(root: str, dim: int):
    def divide(batches):
        """The postings of crowded lists (sorted by list) as postings of their parts; who only reads, only reads there."""
        for batch in batches:
            lists = batch.column("list").to_numpy()
            x, stored = _matrix(batch.column("vector"), dim), batch.column("stored").to_numpy(zero_copy_only=False)
            for a in np.flatnonzero(np.diff(lists, prepend=-1)):
                b = a + int(np.searchsorted(lists[a:], lists[a], "right"))
                row, part, kept = _choose(_graph_of(root, str(lists[a]), dim), x[a:b])
                take = pa.array(a + row)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(lists[a] * MAX_PARTS + part, pa.int64()), batch.column("rep").take(take), batch.column("vector").take(take), pa.array(kept & stored[a + row])],
                    ["list", "rep", "vector", "stored"],
                )

    return divide


def _scan(k: int, dim: int):
    def scan(key: tuple[pa.Scalar, ...], tab: pa.Table) -> pa.Table:
        """The k best members of this block for each of its queries."""
        rep, is_query, is_member = (tab[c].to_numpy(zero_copy_only=False) for c in ("rep", "is_query", "is_member"))
        x = _matrix(tab["vector"], dim)
        q, m = np.flatnonzero(is_query), np.flatnonzero(is_member)
        out_q, out_m, out_s = [], [], []
        for a in range(0, len(q) if len(m) else 0, 1024):
            part = q[a : a + 1024]
            sims = x[part] @ x[m].T
            sims[rep[part][:, None] == rep[m][None, :]] = -9
            top = np.argpartition(-sims, min(k, len(m)) - 1, axis=1)[:, :k]
            value = np.take_along_axis(sims, top, 1)
            row, col = np.nonzero(value > -8)
            out_q.append(rep[part[row]]), out_m.append(rep[m[top[row, col]]]), out_s.append(value[row, col])
        cat = lambda parts, t: np.concatenate(parts) if parts else np.empty(0, t)
        return pa.table({"q": pa.array(cat(out_q, np.int64), pa.int64()), "m": pa.array(cat(out_m, np.int64), pa.int64()), "s": pa.array(cat(out_s, np.float32), pa.float32())})

    return scan


def nearest(vectors: DataFrame, id_col: str, vector_col: str, k: int = 5, dim: int = 64, list_size: int = LIST_SIZE, max_sample: int = MAX_SAMPLE) -> DataFrame:
    """(id, neighbour, similarity): the k most similar other rows of each usable row, by cosine.

    Usable: ``dim`` finite numbers, not all zero. Unusable and null vectors neither ask nor answer.
    Ties go to the smaller id; rows of equal direction are each other's neighbours at similarity 1.
    With fewer than k+1 usable rows there are fewer neighbours; an empty table gives none.
    Approximate: recall is measured against brute force in the tests (0.9 is required).
    """
    spark = vectors.sparkSession
    unit = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<float>").alias("v")).mapInArrow(_unit(dim), "id long, key binary, vector binary")
    # One representative a direction, with the k+1 smallest ids that share it: no result needs more of them.
    unit = materialize(unit, "unit")
    member = unit.select("id", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"))
    groups = unit.groupBy(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2")).agg(F.min("id").alias("rep"), F.count("*").alias("n"))
    total, repeated = groups.agg(F.count("*"), F.sum(F.when(F.col("n") > 1, 1).otherwise(0))).first()
    if not total:
        return spark.createDataFrame([], "id long, neighbour long, similarity float")
    copies = materialize(member.join(groups.filter("n > 1"), ["h1", "h2"]).select("id", "rep", "n"), "copies") if repeated else None
    reps = unit if copies is None else unit.join(copies.filter("id <> rep").select("id"), "id", "left_anti")
    lists = max(1, min(round(total / list_size), max_sample // SAMPLE_PER_LIST))
    sample = reps.select("id", "vector")
    if total > max_sample:
        sample = sample.filter(_share(F.xxhash64("id", F.lit(3)), F.lit(max_sample / total)))
    fitted = [r for r in sample.limit(2 * max_sample).sort("id").toArrow().column(1).combine_chunks().to_pylist()]
    points = np.frombuffer(b"".join(fitted), np.float32).reshape(-1, dim)
    centroids = _fit(points, min(lists, len(points)), 6, 11)
    posts = reps.select(F.col("id").alias("rep"), "vector").mapInArrow(_postings(centroids, dim), _POSTS)
    # Ids of lists have room for a further level each time: a part's is its list's times MAX_PARTS and its number.
    found = _search_lists(_balanced(materialize(posts, "postings"), dim, list_size), k, dim)
    best = _top(found, "q", k)
    if copies is None:
        return best.select(F.col("q").alias("id"), F.col("m").alias("neighbour"), F.col("s").alias("similarity"))
    return _expand(best, copies, k)


def _share(hashed, share):
    """A condition that holds for about this share of the hashes."""
    return F.pmod(hashed, F.lit(1_000_000_007)) < share * 1_000_000_007


def _balanced(posts: DataFrame, dim: int, list_size: int, levels: int = 5) -> DataFrame:
    """``posts`` with every crowded list divided, again and again; what can't be divided is left to the grid of blocks."""
    spark = posts.sparkSession
    done: list[DataFrame] = []
    for _ in range(levels):
        sizes = posts.groupBy("list").agg(F.sum(F.col("stored").cast("long")).alias("members"))
        parts = F.least(F.ceil(F.col("members") / list_size), F.lit(MAX_PARTS)).cast("int")
        crowded = materialize(sizes.filter(F.col("members") > CROWDED * list_size).select("list", "members", parts.alias("parts")), "crowded")
        if not crowded.head(1):
            break
        root = scratch_path(spark, "centroids")
        within = posts.join(crowded, "list")
        share = F.col("parts") * SAMPLE_PER_LIST / F.col("members")
        sample = within.filter("stored").filter(_share(F.xxhash64("rep", F.lit(9)), share)).select("list", "parts", "vector")
        made = materialize(sample.groupBy("list").applyInArrow(_fit_lists(root, dim), "list long, made int").filter("made > 1"), "fitted")
        # A list of many rows goes to several tasks, each of which reads its centroids once.
        moving = within.join(made.select("list"), "list", "left_semi").repartition("list", F.pmod(F.xxhash64("rep"), F.ceil(F.col("members") / TASK_ROWS))).sortWithinPartitions("list")
        done.append(posts.join(made.select("list"), "list", "left_anti"))
        posts = materialize(moving.select("list", "rep", "vector", "stored").mapInArrow(_divide(root, dim), _POSTS), "divided")
    for rest in done:
        posts = posts.unionByName(rest)
    return materialize(posts, "balanced") if done else posts


def _search_lists(posts: DataFrame, k: int, dim: int) -> DataFrame:
    sizes = posts.groupBy("list").agg(F.sum(F.col("stored").cast("int")).alias("members"), F.count("*").alias("reads"))
    large = sizes.filter((F.col("members") > MAX_BLOCK) | (F.col("reads") > 4 * MAX_BLOCK)).select("list", F.ceil(F.col("members") / MAX_BLOCK).cast("int").alias("mb"), F.ceil(F.col("reads") / (4 * MAX_BLOCK)).cast("int").alias("qb"))
    # A large list is a grid of blocks: members by column, queries by row. The lists are few: at most one a list_size vectors.
    cut = posts.join(large, "list", "left").withColumn("mb", F.greatest(F.coalesce("mb", F.lit(1)), F.lit(1))).withColumn("qb", F.greatest(F.coalesce("qb", F.lit(1)), F.lit(1)))
    salt = lambda n, seed: F.pmod(F.xxhash64("rep", F.lit(seed)), F.col(n)).cast("int")
    one = cut.filter("mb = 1 AND qb = 1").select("list", F.lit(0).alias("mi"), F.lit(0).alias("qi"), "rep", "vector", F.lit(True).alias("is_query"), F.col("stored").alias("is_member"))
    as_query = cut.filter("mb > 1 OR qb > 1").select("list", F.explode(F.sequence(F.lit(0), F.col("mb") - 1)).alias("mi"), salt("qb", 5).alias("qi"), "rep", "vector", F.lit(True).alias("is_query"), F.lit(False).alias("is_member"))
    as_member = cut.filter("stored AND (mb > 1 OR qb > 1)").select("list", salt("mb", 6).alias("mi"), F.explode(F.sequence(F.lit(0), F.col("qb") - 1)).alias("qi"), "rep", "vector", F.lit(False).alias("is_query"), F.lit(True).alias("is_member"))
    blocks = one.unionByName(as_query).unionByName(as_member)
    return blocks.groupBy("list", "mi", "qi").applyInArrow(_scan(k, dim), "q long, m long, s float")


def _top(found: DataFrame, by: str, k: int) -> DataFrame:
    """The k best distinct m of each `by`; every input has at most k rows a list read, so a key has few rows."""
    order = F.array_sort(F.collect_set(F.struct((-F.col("s")).alias("d"), F.col("m"))))
    # Equal pairs from two lists can differ in the last bit of their similarity: distinct by m comes first.
    pairs = found.groupBy(by, "m").agg(F.max("s").alias("s"))
    top = pairs.groupBy(by).agg(F.slice(order, 1, k).alias("t"))
    return top.select(by, F.explode("t").alias("t")).select(by, F.col("t.m").alias("m"), (-F.col("t.d")).alias("s"))


def _expand(best: DataFrame, copies: DataFrame, k: int) -> DataFrame:
    """Neighbours of rows from neighbours of representatives: equal directions first, then others, smallest ids first."""
    from pyspark.sql import Window

    first = copies.withColumn("_r", F.row_number().over(Window.partitionBy("rep").orderBy("id"))).filter(F.col("_r") <= k + 1)
    first = first.groupBy("rep").agg(F.array_sort(F.collect_list("id")).alias("ids"))  # at most k+1 ids
    near = best.join(first.withColumnRenamed("rep", "m"), "m", "left").select("q", F.explode(F.coalesce("ids", F.array("m"))).alias("m"), "s")
    own = first.select(F.col("rep").alias("q"), F.explode("ids").alias("m"), F.lit(2.0).cast("float").alias("s"))
    wide = _top(near.unionByName(own), "q", k + 1).groupBy("q").agg(F.collect_list(F.struct("s", "m")).alias("t"))
    rows = wide.join(copies.select(F.col("rep").alias("q"), "id"), "q", "left").withColumn("id", F.coalesce("id", "q"))
    ranked = F.slice(F.array_sort(F.transform(F.filter("t", lambda x: x["m"] != F.col("id")), lambda x: F.struct((-x["s"]).alias("d"), x["m"].alias("m")))), 1, k)
    return rows.select("id", F.explode(ranked).alias("r")).select("id", F.col("r.m").alias("neighbour"), F.least(-F.col("r.d"), F.lit(1.0)).cast("float").alias("similarity"))


def neighbour_pairs(vectors: DataFrame, id_col: str, vector_col: str, k: int = 5, dim: int = 64) -> DataFrame:
    """(a, b) with a < b: pairs of rows of which at least one is among the other's k nearest; each once."""
    near = nearest(vectors, id_col, vector_col, k, dim)
    return near.select(F.least("id", "neighbour").alias("a"), F.greatest("id", "neighbour").alias("b")).distinct()
