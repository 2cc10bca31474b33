"""Records that differ only in white space, letter case, punctuation or field order.

Canonical hashes go into Bloom filters of once- and repeatedly-seen values, one pair a partition,
merged segment by segment. Only rows whose hash the merged filter of repeats may hold are shuffled
for exact grouping; all others are singletons and never move.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scholia.session import materialize, read_shared, scratch_path

BITS_PER_ROW = 16
PROBES = 3
SEGMENT_BITS = 1 << 20
#: The largest filter a worker holds (a pair of them while one is built). Beyond it, that is beyond some
#: 67 million records, the 8-byte hashes are counted by a shuffle instead.
MAX_FILTER_BYTES = 128 << 20


def glued(text: Column) -> Column:
    """Letters and digits only, in lower case."""
    return F.regexp_replace(F.lower(text), r"[^\p{L}\p{M}\p{N}]+", "")


def canonical_record(record: Column, title: Column, separator: str = "|", names: str = "[,;]") -> Column:
    """One string for all ways to write ``record``: fields split at ``separator``, in any order.

    The field that spells ``title`` stays whole (its commas are punctuation); the others are lists
    of names whose order doesn't count. If no field spells the title, the first one is taken for it.
    Null stays null.
    """
    # Each item of the outer arrays holds what later steps need, so that nothing is normalised twice.
    item = lambda f: F.struct(glued(f).alias("glue"), F.transform(F.split(f, names), glued).alias("people"))
    fields = F.filter(F.transform(F.split(record, f"[{separator}]"), item), lambda f: f["glue"] != "")
    start = F.struct(F.lit("").alias("head"), F.array().cast("array<string>").alias("people"), F.lit("").alias("first"), F.array().cast("array<string>").alias("first_people"), F.lit(False).alias("found"))

    def step(state: Column, f: Column) -> Column:
        # The title's field becomes the head; the first field waits aside, for the case that none is the title's.
        hit = ~state["found"] & (f["glue"] == state["title"])
        is_first = state["first"] == ""
        return F.struct(
            state["title"].alias("title"),
            F.when(hit, f["glue"]).otherwise(state["head"]).alias("head"),
            F.when(hit | is_first, state["people"]).otherwise(F.concat(state["people"], f["people"])).alias("people"),
            F.when(is_first, f["glue"]).otherwise(state["first"]).alias("first"),
            F.when(is_first & ~hit, f["people"]).otherwise(state["first_people"]).alias("first_people"),
            (state["found"] | hit).alias("found"),
        )

    def finish(state: Column) -> Column:
        people = F.when(state["found"], F.concat(state["first_people"], state["people"])).otherwise(state["people"])
        head = F.when(state["found"], state["head"]).otherwise(state["first"])
        return F.concat_ws("\x1f", head, F.array_join(F.array_sort(F.filter(people, lambda n: n != "")), "\x1f"))

    begin = F.struct(F.coalesce(glued(title), F.lit("")).alias("title"), *(start[c].alias(c) for c in ("head", "people", "first", "first_people", "found")))
    return F.when(record.isNotNull(), F.aggregate(fields, begin, step, finish))


def _positions(hashes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(segment, positions in it as rows of PROBES) of the hashes; a hash stays within one segment."""
    h = hashes.view(np.uint64)
    segments = np.uint64(max(1, bits // SEGMENT_BITS))
    width = np.uint64(min(bits, SEGMENT_BITS))
    with np.errstate(over="ignore"):
        segment = (h >> np.uint64(40)) % segments
        step = (h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(20) | np.uint64(1)
        at = np.stack([(h + np.uint64(k) * step) % width for k in range(PROBES)], axis=1)
    return segment.astype(np.int64), at.astype(np.int64)


def _set(packed: np.ndarray, at: np.ndarray) -> None:
    at = at.ravel()
    np.bitwise_or.at(packed, at >> 3, (1 << (at & 7)).astype(np.uint8))


def _test(packed: np.ndarray, at: np.ndarray) -> np.ndarray:
    return ((packed[at >> 3] >> (at & 7).astype(np.uint8)) & 1).all(axis=1)


def _build(bits: int):
    """Per partition: the once-seen and the repeatedly-seen filter of each segment, compressed."""
    import zlib


    width = min(bits, SEGMENT_BITS)

    def build(batches):
        once: dict[int, np.ndarray] = {}
        twice: dict[int, np.ndarray] = {}
        for batch in batches:
            values, counts = np.unique(batch.column(0).to_numpy(), return_counts=True)
            segment, at = _positions(values, bits)
            for s in np.unique(segment):
                mine = segment == s
                if int(s) not in once:
                    once[int(s)], twice[int(s)] = np.zeros(width // 8, np.uint8), np.zeros(width // 8, np.uint8)
                seen, again, rows = once[int(s)], twice[int(s)], at[mine]
                _set(again, rows[(counts[mine] > 1) | _test(seen, rows)])
                _set(seen, rows)
        for s, seen in once.items():
            pack = [zlib.compress(x.tobytes(), 1) for x in (seen, twice[s])]
            yield pa.RecordBatch.from_arrays([pa.array([s], pa.int64()), pa.array([pack[0]], pa.binary()), pa.array([pack[1]], pa.binary())], ["segment", "once", "twice"])

    return build


def _merge(key, pdf):
    """Bits set in two partitions, or repeated in one, are set in the merged filter of repeats."""
    import zlib

    import pandas as pd

    seen = again = None
    for once, twice in zip(pdf["once"], pdf["twice"], strict=True):
        a, b = (np.frombuffer(zlib.decompress(x), np.uint8) for x in (once, twice))
        if seen is None:
            seen, again = a.copy(), b.copy()
        else:
            again |= b | (seen & a)
            seen |= a
    return pd.DataFrame({"segment": [key[0]], "bits": [again.tobytes()]})


def _may_repeat(path: str, bits: int):

    state: dict = {}

    @F.arrow_udf("boolean")
    def may_repeat(column: pa.Array) -> pa.Array:
        if not state:
            tab = read_shared(path)
            state["bits"] = {s: np.frombuffer(b, np.uint8) for s, b in zip(tab["segment"].to_pylist(), tab["bits"].to_pylist(), strict=True)}
        hashes = column.to_numpy(zero_copy_only=False).astype(np.int64)
        segment, at = _positions(hashes, bits)
        out = np.zeros(len(hashes), bool)
        for s in np.unique(segment):
            if (own := state["bits"].get(int(s))) is not None:
                mine = segment == s
                out[mine] = _test(own, at[mine])
        return pa.array(out)

    return may_repeat


def collapse_format_duplicates(records: DataFrame, canonical: Column, row_id: str = "id", max_filter_bytes: int = MAX_FILTER_BYTES) -> DataFrame:
    """(id, first_id, copies): every record, the smallest id of its class and the size of the class.

    A record whose canonical form is null is a class of its own; equal empty forms are one class.
    Row ids are assumed unique; an empty table gives an empty table, and extra columns are ignored.
    A class of any share of the rows is counted by partial aggregation before the shuffle, and the
    join that brings the result back to its rows splits skewed keys (adaptive execution).
    """
    spark = records.sparkSession
    form = records.select(F.col(row_id).alias("_id"), canonical.alias("_canonical"))
    # The canonical form is made once; what's kept of it has a fixed size.
    base = materialize(form.select("_id", F.when(F.col("_canonical").isNotNull(), F.xxhash64("_canonical")).alias("_hash"), F.unhex(F.sha2("_canonical", 256)).alias("_key")), "canonical")
    hashed = base.filter("_hash IS NOT NULL")
    bits = 1 << max(13, int(np.ceil(np.log2(max(1, base.count()) * BITS_PER_ROW))))
    if bits // 8 <= max_filter_bytes:
        path = scratch_path(spark, "repeats")
        built = hashed.select("_hash").mapInArrow(_build(bits), "segment long, once binary, twice binary")
        built.groupBy("segment").applyInPandas(_merge, "segment long, bits binary").write.parquet(path)
        flagged = hashed.withColumn("_maybe", _may_repeat(path, bits)(F.col("_hash")))
    else:
        repeats = hashed.groupBy("_hash").count().filter("count > 1").select("_hash", F.lit(True).alias("_maybe"))
        flagged = hashed.join(repeats, "_hash", "left").withColumn("_maybe", F.coalesce("_maybe", F.lit(False)))
    suspects = flagged.filter("_maybe").select("_id", "_key")
    classes = suspects.groupBy("_key").agg(F.min("_id").alias("first_id"), F.count("*").alias("copies"))
    grouped = suspects.join(classes, "_key").select(F.col("_id").alias("id"), "first_id", "copies")
    single = flagged.filter("NOT _maybe").select("_id").unionByName(base.filter("_hash IS NULL").select("_id"))
    return grouped.unionByName(single.select(F.col("_id").alias("id"), F.col("_id").alias("first_id"), F.lit(1).cast("long").alias("copies")))


def repeats_of(records: DataFrame, canonical: Column, row_id: str = "id") -> DataFrame:
    """(first_id, id): the rows that repeat the first row of their class."""
    return collapse_format_duplicates(records, canonical, row_id).filter("id <> first_id").select("first_id", "id")
