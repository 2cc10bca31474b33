"""Catalog of papers: derivation, insert-if-absent, update by key, duplicates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scholia.functions.text import base_id, format_authors, glue, normalize_list, normalize_text, parse_date


def derive(records: DataFrame, arxiv_id: Column, title: Column, authors: Column, created: Column, fallback: Column | None = None) -> DataFrame:
    """The catalog's derived columns. ``authors`` is an array of (keyname, forenames); names are sorted as
    formatted, then normalised. A missing title counts as empty, a missing date as ``fallback`` (today)."""
    people = normalize_list(F.array_sort(format_authors(authors)))
    base = records.withColumns({"arxiv_id": arxiv_id, "title": F.coalesce(title, F.lit("")), "normalized_authors": people, "created_date": parse_date(created, fallback)})
    named = base.withColumn("normalized_title", normalize_text("title"))
    return named.withColumns(
        {"glued_normalized_title": glue("normalized_title"), "title_and_authors": F.concat("title", F.lit(" | "), F.array_join("normalized_authors", ", "))}
    )


def first_per_key(rows: DataFrame, key: str, order: Sequence[Column]) -> DataFrame:
    """The first row of each key; only one row a key and map task is shuffled (window with a limit)."""
    return rows.withColumn("_rn", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter("_rn = 1").drop("_rn")


def insert_if_absent(existing: DataFrame, incoming: DataFrame, key: str, order: Sequence[Column]) -> DataFrame:
    """K5: the rows of ``incoming`` that would be inserted: key not blank, not there yet, first of its key."""
    named = incoming.filter(F.col(key).isNotNull() & (F.trim(key) != ""))
    new = named.join(existing.select(key), key, "left_anti")
    return first_per_key(new, key, order).select(*incoming.columns)


def insert_summary(existing: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """A5: one row of counts: inserted, skipped_blank, already_there (repeats within the input included)."""
    blank = F.col(key).isNull() | (F.trim(key) == "")
    known = existing.select(F.col(key).alias("_known")).distinct()
    marked = incoming.select(F.col(key), blank.alias("_blank")).join(known, F.col(key) == F.col("_known"), "left")
    return marked.agg(
        F.count_distinct(F.when(~F.col("_blank") & F.col("_known").isNull(), F.col(key))).alias("inserted"),
        F.coalesce(F.sum(F.col("_blank").cast("long")), F.lit(0)).alias("skipped_blank"),
        F.count("*").alias("rows"),
    ).select("inserted", "skipped_blank", (F.col("rows") - F.col("inserted") - F.col("skipped_blank")).alias("already_there"))


def update_by_key(target: DataFrame, key: str, column: str, updates: DataFrame, value: str, order: str, skip_zeros: bool = True) -> DataFrame:
    """K6/A3: ``target`` with ``column`` set to the last update of its key; others stay. Zeros are skipped (Q5)."""
    usable = updates.filter(F.col(key).isNotNull() & F.col(value).isNotNull())
    if skip_zeros:
        usable = usable.filter(F.col(value) != 0)
    last = usable.groupBy(key).agg(F.max(F.struct(F.col(order), F.col(value).alias("_new"))).alias("_u")).select(key, "_u._new")
    return target.join(last, key, "left").withColumn(column, F.coalesce("_new", column)).select(*target.columns)


def update_summary(target: DataFrame, key: str, updates: DataFrame, value: str) -> DataFrame:
    """Distinct keys with a usable update, how many of them the target has, and how many not."""
    usable = updates.filter(F.col(key).isNotNull() & (F.col(value) != 0)).select(key).distinct()
    there = target.select(F.col(key).alias("_k")).distinct()
    return (
        usable.join(there, F.col(key) == F.col("_k"), "left")
        .agg(F.count("*").alias("total"), F.count("_k").alias("matched"))
        .select("matched", "total", (F.col("total") - F.col("matched")).alias("unmatched"))
    )


def duplicate_rank(rows: DataFrame, key: str, order: Sequence[Column]) -> DataFrame:
    """``rn`` numbers the rows of each key, the row to keep being 1. A null key is a key like any other."""
    return rows.withColumn("rn", F.row_number().over(Window.partitionBy(key).orderBy(*order)))


def keep_latest(rows: DataFrame, key: str, order: Sequence[Column]) -> DataFrame:
    return first_per_key(rows, key, order)


def deleted_ids(rows: DataFrame, key: str, row_id: str, order: Sequence[Column]) -> DataFrame:
    """K7: the ids of all rows but the kept one of each key.

    The kept ids come from a pre-aggregated window, so a key that fills a third of the table isn't
    sorted in one task; the rest is an anti join on the unique row id.
    """
    kept = first_per_key(rows.select(key, row_id, *[c for c in rows.columns if c not in (key, row_id)]), key, order).select(row_id)
    return rows.select(row_id).join(kept, row_id, "left_anti")


def count_duplicates(rows: DataFrame, key: str) -> DataFrame:
    """A1: the dry run: how many rows would go."""
    return rows.groupBy(key).count().agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("duplicates"))


def posting_table(catalog: DataFrame, key: str, text: str) -> DataFrame:
    """K9: trigram -> key, the distributed counterpart of a trigram index; write it bucketed by ``gram``."""
    from scholia.operators.resolve import trigrams

    return catalog.select(F.col(key), F.explode(trigrams(text)).alias("gram"))


def describe_table(catalog: DataFrame) -> DataFrame:
    """The columns and types of a table as rows."""
    spark = catalog.sparkSession
    return spark.createDataFrame([(i, f.name, f.dataType.simpleString()) for i, f in enumerate(catalog.schema)], "position int, column string, type string")


def compact(spark: SparkSession, path: str, target: str, rows_per_file: int = 1_000_000) -> DataFrame:
    """The table at ``path`` written to ``target`` in full files, and its statistics: (column, n, nulls, distinct).

    Distinct counts are approximate (within 5 %); the old files stay until the caller drops them.
    """
    rows = spark.read.parquet(path)
    total = rows.count()
    rows.coalesce(max(1, -(-total // rows_per_file))).write.option("maxRecordsPerFile", rows_per_file).parquet(target)
    made = spark.read.parquet(target)
    each = F.array(*(F.struct(F.lit(c).alias("column"), F.count("*").alias("n"), F.count_if(F.col(c).isNull()).alias("nulls"), F.approx_count_distinct(c).alias("distinct")) for c in made.columns))
    return made.agg(each.alias("_s")).select(F.explode("_s").alias("_s")).select("_s.*")


def add_column(catalog: DataFrame, name: str, kind: str) -> DataFrame:
    """K8: the table with a null column of this name, unless it has one."""
    return catalog if name in catalog.columns else catalog.withColumn(name, F.lit(None).cast(kind))


def id_with_version(identifier: str = "arxiv_id") -> tuple[Column, Column]:
    """Q10: base id and version (null without one)."""
    plain = base_id(identifier)
    return plain, F.nullif(F.regexp_extract(F.col(identifier), r"v([0-9]+)$", 1), F.lit("")).cast("int")
