"""Trigram search by counting: bitmaps of a catalog's trigrams are added up for the texts asked.

A block of catalog rows has for each trigram the rows that hold it. Bitwise adders sum a text's trigrams
for 64 rows at once, so each row's number of shared trigrams is counted, none is guessed, and no pair is
shuffled: a task holds some queries and reads block after block. Rows stand in the order of their texts;
eight neighbours are counted as one row with the trigrams of all (an upper bound), and only where those
share enough is each of the eight counted. Work grows with the product of both sides, disk with their sum.
"""

from __future__ import annotations

from collections import defaultdict
from functools import partial
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from scholia.session import materialize, read_shared, scratch_path

#: Catalog rows a block; a trigram that one in so many of them has is kept as a bitmap, others as lists of rows.
BLOCK, RARE = 1 << 17, 256
#: Queries a task holds at once; words of eight rows a bit that are added up at once.
HELD, WORDS = 20_000, 1024
_INDEX = pa.schema([("block", pa.int32()), ("gram", pa.string()), ("n", pa.int32()), ("places", pa.binary())])


def grams_of(text: str) -> set[str]:
    """`resolve.trigrams` of one text."""
    padded = f"  {text} "
    return {padded[i : i + 3] for i in range(len(padded) - 2)}


def _pack(flags: np.ndarray) -> np.ndarray:
    """Bits of 64 rows a word."""
    packed = np.zeros(-(-len(flags) // 64) * 8, np.uint8)
    bits = np.packbits(flags, bitorder="little")
    packed[: len(bits)] = bits
    return packed.view("<u8")


def postings(texts: list[str]):
    """(trigram, rows in order that have it) of each trigram of the texts."""
    points = np.frombuffer("".join(f"  {t} " for t in texts).encode("utf-32-le", "surrogatepass"), "<u4")
    row = np.repeat(np.arange(len(texts)), np.fromiter((len(t) + 3 for t in texts), np.int64, len(texts)))
    used = np.zeros(0x110000, bool)
    used[points] = True
    alphabet = np.flatnonzero(used)
    letter = (np.cumsum(used) - 1)[points]
    code = (letter[:-2] * len(alphabet) + letter[1:-1]) * len(alphabet) + letter[2:]
    whole = row[:-2] == row[2:]
    code, row = code[whole], row[:-2][whole]
    known = None
    if len(alphabet) ** 3 * len(texts) >= 2**63:
        known, code = np.unique(code, return_inverse=True)
    code *= len(texts)
    code += row
    code.sort()
    code = code[np.diff(code, prepend=-1) > 0]
    gram, row = np.divmod(code, len(texts))
    begin = np.flatnonzero(np.diff(gram, prepend=-1))
    first = gram[begin] if known is None else known[gram[begin]]
    a, b, c = (alphabet[x].tolist() for x in (first // len(alphabet) ** 2, first // len(alphabet) % len(alphabet), first % len(alphabet)))
    for x, y, z, rows in zip(a, b, c, np.split(row, begin[1:]), strict=True):
        yield chr(x) + chr(y) + chr(z), rows


def index_of(texts: list[str]):
    """Rows of the index of a block: its trigrams with their bitmap, or the places where they are few; the places are
    the rows in the order of their texts. "order" tells the row of each place, "sizes" its number of trigrams."""
    order = sorted(range(len(texts)), key=texts.__getitem__)
    sizes = np.zeros(len(texts), np.int32)
    for gram, at in postings([texts[i] for i in order]):
        sizes[at] += 1
        if len(at) * RARE >= len(texts):
            flags = np.zeros(len(texts), bool)
            flags[at] = True
            yield gram, len(at), _pack(flags).tobytes()
        else:
            yield gram, len(at), at.astype("<i4").tobytes()
    yield "order", len(texts), np.array(order, "<i4").tobytes()
    yield "sizes", len(texts), sizes.astype("<i4").tobytes()


def _index_blocks(rows: str, batches):
    for batch in batches:
        for block in batch.column(0).to_pylist():
            out = []
            for entry in index_of(read_shared(f"{rows}/block={block}")["glued"].to_pylist()):
                out.append((block, *entry))
                if len(out) == 256 or entry[0] == "sizes":
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _INDEX, strict=True)], schema=_INDEX)
                    out = []


def _sum_bits(level: np.ndarray) -> list[np.ndarray]:
    """Binary digits, the lowest first, of how many rows of ``level`` (overwritten) have each bit."""
    planes = []
    while len(level):
        carries = []
        while len(level) > 1:
            k = max(1, len(level) // 3)
            a, b, c = level[:k], level[k : 2 * k], level[2 * k : 3 * k]
            carry = a & b
            a ^= b
            if len(c):
                carry |= a & c
                a ^= c
            left = level[3 * k :]
            level[k : k + len(left)] = left
            level = level[: k + len(left)]
            carries.append(carry)
        planes.append(level[0])
        level = np.concatenate(carries) if carries else level[:0]
    return planes


def _reached(planes: list[np.ndarray], lacking: list[np.ndarray]) -> np.ndarray:
    """Bits where the number in ``planes`` is at least the one whose inverted digits are ``lacking``: the carry of their sum and 1."""
    enough = ~np.zeros_like(planes[0])
    for k, off in enumerate(lacking):
        enough = ((planes[k] | off) & enough) | (planes[k] & off) if k < len(planes) else enough & off
    return enough


class Block:
    """The index of one block of rows."""

    def __init__(self, grams: list[str], counts: list[int], places: list) -> None:
        at = dict(zip(grams, places, strict=True))
        self.order, self.sizes = (np.frombuffer(at[k], "<i4").astype(np.int64) for k in ("order", "sizes"))
        self.total = len(self.order)
        words = -(-self.total // 64)
        often = [g for g, n in zip(grams, counts, strict=True) if len(g) == 3 and n * RARE >= self.total]
        self.common = {g: i for i, g in enumerate(often)}
        self.none = len(often)  # a row without bits
        fine = np.zeros((len(often) + 1, words * 8), np.uint8)
        for g, i in self.common.items():
            fine[i] = np.frombuffer(at[g], np.uint8)
        self.fine, self.width = fine.reshape(-1), words * 8
        self.coarse = np.array([_pack(row != 0) for row in fine])
        self.rare = {g: np.frombuffer(at[g], "<i4") for g, n in zip(grams, counts, strict=True) if len(g) == 3 and n * RARE < self.total}
        self._bytes: dict[str, tuple] = {}
        self._least: tuple = (None, [], [])

    def _places(self, gram: str) -> tuple[np.ndarray, ...]:
        """Places and values of the bytes of a rare trigram's bitmap that aren't 0, and the same of its coarse bitmap."""
        if (made := self._bytes.get(gram)) is None:
            made = ()
            at = self.rare[gram].astype(np.int64)
            for _ in range(2):
                part = at >> 3
                begin = np.flatnonzero(np.diff(part, prepend=-1))
                made += part[begin], np.bitwise_or.reduceat((1 << (at & 7)).astype(np.uint8), begin)
                at = part[begin]
            self._bytes[gram] = made
        return made

    def _lacking(self, n: int, threshold: float) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """The least number of shared trigrams that reaches the threshold, inverted, of eight rows together and of each row."""
        if self._least[0] != (n, threshold):
            m = np.arange(self.sizes.max() + 1)
            least = np.maximum(np.floor((n + m) * threshold / (1 + threshold)).astype(np.int64) - 1, 1)
            for _ in range(4):
                least += least / np.maximum(n + m - least, 1) < threshold
            least = np.minimum(least, n + 1).astype(np.int32)[self.sizes]  # more than n is never reached
            eight = np.append(least, np.full(-len(least) % 8, n + 1, np.int32)).reshape(-1, 8).min(axis=1)
            digits = range(int(n + 1).bit_length())
            self._least = (n, threshold), [_pack((eight >> k) & 1 == 0) for k in digits], [_pack((least >> k) & 1 == 0).view(np.uint8) for k in digits]
        return self._least[1:]

    def similar(self, asked: list[set[str]], threshold: float) -> list[tuple[np.ndarray, np.ndarray]]:
        """(rows, their similarity) of all rows that reach the threshold, for each of ``asked``, which are of one size."""
        n, many, wide = len(asked[0]), len(asked), self.coarse.shape[1]
        coarse_off, fine_off = self._lacking(n, threshold)
        lists = [list(g) for g in asked]
        index = np.array([[self.common.get(g, self.none) for g in x] for x in lists]).T
        rare = [(i, b, *self._places(g)) for b, x in enumerate(lists) for i, g in enumerate(x) if g in self.rare]
        bits = np.empty((n * many, wide), "<u8")
        np.take(self.coarse, index.reshape(-1), axis=0, out=bits, mode="clip")
        if rare:
            bits.reshape(-1).view(np.uint8)[np.concatenate([at + (i * many + b) * wide * 8 for i, b, _, _, at, _ in rare])] = np.concatenate([x[5] for x in rare])
        enough = _reached([p.reshape(many, wide) for p in _sum_bits(bits.reshape(n, many * wide))], coarse_off).reshape(-1)
        word = np.flatnonzero(enough)
        at = np.flatnonzero(np.unpackbits(enough[word].view(np.uint8), bitorder="little").view(bool))
        at = word[at >> 6] * 64 + (at & 63)
        owner, eight = np.divmod(at, wide * 64)
        index *= self.width
        index = np.take(index, owner, axis=1)
        index += eight
        bits = np.take(self.fine, index)
        if rare:
            where = np.full((many, self.width), -1, np.int32)
            where[owner, eight] = np.arange(len(eight))
            size = [len(x[2]) for x in rare]
            column = where[np.repeat([x[1] for x in rare], size), np.concatenate([x[2] for x in rare])]
            met = np.flatnonzero(column >= 0)
            bits[np.repeat([x[0] for x in rare], size)[met], column[met]] = np.concatenate([x[3] for x in rare])[met]
        planes = _sum_bits(bits)
        at = np.flatnonzero(np.unpackbits(_reached(planes, [off[eight] for off in fine_off]), bitorder="little").view(bool))
        i, bit, shared = at >> 3, at & 7, np.zeros(len(at), np.int64)
        for k, plane in enumerate(planes):
            shared += ((plane[i] >> bit.astype(np.uint8)) & 1).astype(np.int64) << k
        place = eight[i] * 8 + bit
        similarity, rows = shared / (n + self.sizes[place] - shared), self.order[place]
        edge = np.searchsorted(owner[i], np.arange(many + 1))
        return [(rows[a:b], similarity[a:b]) for a, b in zip(edge[:-1], edge[1:], strict=True)]


def _best(rows: list[np.ndarray], similarity: list[np.ndarray], limit: int) -> tuple[np.ndarray, np.ndarray]:
    """The most similar ``limit`` rows; of equal ones those that come first."""
    r, s = (rows[0], similarity[0]) if len(rows) == 1 else (np.concatenate(rows), np.concatenate(similarity))
    if len(s) > 4 * limit:
        least = np.partition(s, len(s) - limit)[len(s) - limit]
        r, s = r[s >= least], s[s >= least]
    order = np.lexsort((r, -s))[:limit]
    return r[order], s[order]


def _scores(asked: list[np.ndarray], at: np.ndarray, offsets: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """How many of the asked authors share a key with each of the rows ``at``."""
    begin, size = offsets[at], offsets[at + 1] - offsets[at]
    owner = np.repeat(np.arange(len(at)), size)
    held = keys[np.arange(len(owner)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(begin, size)]
    score = np.zeros(len(at), np.int64)
    for author in asked:
        hit = np.zeros(len(at), bool)
        hit[owner[np.isin(held, author)]] = True
        score += hit
    return score


def _search(rows: str, index: str, blocks: list[tuple[int, int]], threshold: float, limit: int, most: int, schema: pa.Schema, batches):
    held: list[pa.RecordBatch] = []
    one: dict[int, Block] = {}  # a single block is read once

    def block(number: int) -> Block:
        if number not in one:
            one.clear()
            made = read_shared(f"{index}/block={number}")
            one[number] = Block(made["gram"].to_pylist(), made["n"].to_pylist(), made["places"].to_pylist())
        return one[number]

    def answer(queries: pa.Table):
        texts = defaultdict(list)
        for i, text in enumerate(queries["glued"].to_pylist()):
            texts[text].append(i)
        asked = sorted(((grams_of(t), i) for t, i in texts.items()), key=lambda x: len(x[0]))
        found: list[tuple] = [(np.empty(0, np.int64), np.empty(0))] * len(asked)
        begin = 0
        for number, size in blocks:
            together = max(1, WORDS * 512 // size)
            for _, equal in groupby(range(len(asked)), key=lambda k: len(asked[k][0])):
                equal = list(equal)
                for a in range(0, len(equal), together):
                    part = equal[a : a + together]
                    for k, (at, similarity) in zip(part, block(number).similar([asked[k][0] for k in part], threshold), strict=True):
                        if len(at):
                            found[k] = _best([found[k][0], at + begin], [found[k][1], similarity], limit)
            begin += size
        of_row = {i: k for k, (_, owners) in enumerate(asked) for i in owners}
        ids: dict = defaultdict(list)
        for i, q in enumerate(queries["query_id"].to_pylist()):
            ids[q].append(i)
        q, at, rank, similarity = [], [], [], []
        for owners in ids.values():
            r, s = found[of_row[owners[0]]]
            if len(owners) > 1:
                r, s = _best([found[of_row[i]][0] for i in owners], [found[of_row[i]][1] for i in owners], limit)
            for i in owners if "asked" in queries.column_names else owners[:1]:
                q.append(np.full(len(r), i))
                at.append(r)
                rank.append(np.arange(1, len(r) + 1))
                similarity.append(s)
        q, at, rank, similarity = (np.concatenate(x) for x in (q, at, rank, similarity))
        begin = 0
        for number, size in blocks:
            here = np.flatnonzero((at >= begin) & (at < begin + size))
            if len(here):
                yield from emit(queries, number, q[here], at[here] - begin, rank[here], similarity[here])
            begin += size

    def emit(queries, number, q, at, rank, similarity):
        held_rows = read_shared(f"{rows}/block={number}").combine_chunks()
        extra = []
        if "asked" in queries.column_names:
            lists, keys = queries["asked"].to_pylist(), held_rows["keys"].combine_chunks()
            offsets, keys = keys.offsets.to_numpy().astype(np.int64), keys.values.to_numpy()
            score, edges = np.zeros(len(q), np.int64), np.flatnonzero(np.diff(q, prepend=-1, append=-1))
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                mine = lists[q[a]]
                # Without authors the first candidate counts.
                score[a:b] = _scores([np.array(x, np.int64) for x in mine], at[a:b], offsets, keys) if mine else np.where(rank[a:b] == 1, 0, -1)
                if mine:
                    score[a:b][score[a:b] == 0] = -1
            use = np.flatnonzero(score >= 0)
            q, at, rank, similarity, extra = q[use], at[use], rank[use], similarity[use], [score[use].astype(np.int32)]
        for a in range(0, len(q), 50_000):
            part = slice(a, a + 50_000)
            columns = [queries["query_id"].take(pa.array(q[part])), held_rows["id"].take(pa.array(at[part])), held_rows["created_date"].take(pa.array(at[part]))]
            columns = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in columns] + [pa.array(x[part]) for x in (rank.astype(np.int32), similarity, *extra)]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    for batch in batches:
        held.append(batch)
        # Rows come in order of query_id; those of one id stay together.
        while sum(b.num_rows for b in held) > most:
            queries = pa.Table.from_batches(held)
            ids = queries["query_id"].to_pylist()
            cut = most
            while cut < len(ids) and ids[cut] == ids[cut - 1]:
                cut += 1
            if cut == len(ids):
                break
            yield from answer(queries.slice(0, cut).combine_chunks())
            held = queries.slice(cut).combine_chunks().to_batches()
    if held and sum(b.num_rows for b in held):
        yield from answer(pa.Table.from_batches(held).combine_chunks())


def search(queries: DataFrame, catalog: DataFrame, threshold: float, limit: int) -> DataFrame:
    """(query_id, id, created_date, cand_rank, similarity): the most similar ``limit`` rows a query that reach the
    threshold, of equal ones the smaller id first.

    Queries have query_id and glued, the catalog id, glued and created_date. With the queries' ``asked`` (key numbers
    of each author) and the catalog's ``keys`` a column ``score`` tells how many of the authors share a key; then rows
    without any are left out, and for queries without authors all but the first.
    """
    spark = queries.sparkSession
    rows = materialize(catalog.filter(F.col("glued") != ""), "titles")
    total = rows.count()
    many = max(1, -(-total // BLOCK))
    ordered = rows.repartitionByRange(many, "id").withColumn("block", F.spark_partition_id()).sortWithinPartitions("block", "id")
    path = _write_blocks(ordered, "rows")
    sizes = sorted((r["block"], r["count"]) for r in spark.read.parquet(path).groupBy("block").count().collect()) if total else []
    schema = T.StructType([T.StructField("query_id", queries.schema["query_id"].dataType), rows.schema["id"], rows.schema["created_date"], T.StructField("cand_rank", T.IntegerType()), T.StructField("similarity", T.DoubleType())])
    if "asked" in queries.columns:
        schema = schema.add("score", T.IntegerType())
    if not sizes:
        return spark.createDataFrame([], schema)
    numbers = spark.createDataFrame([(b,) for b, _ in sizes], "block int").repartition(len(sizes), "block")
    index = _write_blocks(numbers.mapInArrow(partial(_index_blocks, path), "block int, gram string, n int, places binary"), "grams")
    parts = spark.sparkContext.defaultParallelism
    # Written first, else the tasks are those of the plan before, few where its rows are small.
    asked = materialize(queries.filter(F.col("glued") != ""), "queries").repartition(2 * parts, "query_id").sortWithinPartitions("query_id")
    return asked.mapInArrow(partial(_search, path, index, sizes, threshold, limit, HELD, to_arrow_schema(schema)), schema)


def _write_blocks(df: DataFrame, label: str) -> str:
    path = scratch_path(df.sparkSession, label)
    df.write.partitionBy("block").parquet(path)
    return path
