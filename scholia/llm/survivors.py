"""The best available record of each group of duplicates, field by field."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FIELDS = ("abstract", "categories", "comments", "doi", "journal-ref", "license")
#: Fields of running text: a usable value ends as a sentence does.
PROSE = ("abstract",)
#: What people write for "no value", in lower case.
NO_VALUE = (
    "", "-", "--", "---", ".", "...", "?", "??", "???", "/", "n/a", "n.a.", "na", "nan", "nil", "none", "null", "not available",
    "not applicable", "tba", "tbd", "to be announced", "to be determined", "undefined", "unknown", "unspecified", "void", "missing", "no value", "(none)", "(null)", "xxx",
)
#: Notations of a day, tried in this order.
DAY_FORMATS = ("yyyy-MM-dd", "yyyy/MM/dd", "yyyy.MM.dd", "d MMM yyyy", "d MMMM yyyy", "MMM d, yyyy", "MMMM d, yyyy", "dd.MM.yyyy", "yyyyMMdd")


def usable(value: Column, prose: bool = False) -> Column:
    """True where ``value`` is there, says something and isn't cut short; never null."""
    text = F.regexp_replace(value, r"(?U)^\s+|\s+$", "")
    cut = text.rlike(r"(?i)(\.\.\.|…|\[\s*(\.\.\.|…)\s*\]|\[(truncated|cut|more)\]|\((truncated|cut|more)\))$")
    if prose:  # cut anywhere, a text rarely ends where a sentence does
        cut = cut | ~text.rlike(r"""(?U)[.!?。！？۔।]["'”’»)\]}$]*$""") | text.rlike(r"(?i)\b(al|i\.e|e\.g|cf|vs|fig|figs|sec|eq|eqs)\.$")
    return F.coalesce(~F.lower(text).isin(*NO_VALUE) & ~cut, F.lit(False))


def day(value: Column) -> Column:
    """The DATE in ``value`` in any of DAY_FORMATS or as an ISO timestamp, else null."""
    text = F.trim(value)
    date = F.coalesce(*(F.try_to_timestamp(text, F.lit(f)).cast("date") for f in DAY_FORMATS))
    iso = F.regexp_extract(text, r"^(\d{4}-\d{2}-\d{2})[T ]\d{2}:\d{2}", 1)
    return F.coalesce(date, F.try_to_timestamp(F.nullif(iso, F.lit("")), F.lit("yyyy-MM-dd")).cast("date"))


def best_values(papers: DataFrame, key: str = "title_and_authors", row_id: str = "id", metadata: str = "metadata", fields: Sequence[str] = FIELDS, trust: Column | None = None) -> DataFrame:
    """(group_id, field, row_id, value): for each group of rows with equal ``key`` and each field, its best usable value.

    Values are ranked by completeness (unusable ones drop out), then by ``trust``, a column that is larger
    for rows of better sources (null counts as least; all alike by default), then by the day of revision.
    A row's revision day is ``updated``, or ``created`` where ``updated`` holds no date; rows without
    either come last, and ties go to the larger id, the later arrival. Groups of one row and rows
    whose key is null give nothing; a null or malformed ``metadata`` counts as one without fields; a
    field nobody in the group has a usable value for gives no row. Extra columns are ignored.

    Ranking is a window with a row limit of one: Spark keeps one row a group and field in every map
    task before it shuffles, so a group of any share of the rows stays small. Groups are keyed by the
    SHA-256 of the key; long titles aren't shuffled.
    """
    base, groups = _groups(papers, key, row_id, metadata, fields, trust)
    long = base.select("_key", "_id", "_trust", "_day", F.explode(F.filter("_values", lambda x: x["value"].isNotNull())).alias("_f"))
    long = long.select("_key", "_id", "_trust", "_day", F.col("_f.field").alias("field"), F.col("_f.value").alias("value"))
    rank = F.row_number().over(Window.partitionBy("_key", "field").orderBy(*_best_first()))
    best = long.withColumn("_rank", rank).filter("_rank = 1")
    return best.join(groups, "_key").select("group_id", "field", F.col("_id").alias("row_id"), "value")


def _best_first() -> list[Column]:
    """Trust, then recency, then the later arrival."""
    return [F.desc_nulls_last("_trust"), F.desc_nulls_last("_day"), F.desc("_id")]


def _groups(papers: DataFrame, key: str, row_id: str, metadata: str, fields: Sequence[str], trust: Column | None) -> tuple[DataFrame, DataFrame]:
    """The rows with a key (_key, _id, _trust, _day, _values: field and usable value or null), and the groups of two and more."""
    schema = ", ".join(f"`{f}` STRING" for f in dict.fromkeys([*fields, "created", "updated"]))
    base = papers.filter(F.col(key).isNotNull()).select(
        F.unhex(F.sha2(F.col(key), 256)).alias("_key"), F.col(row_id).cast("long").alias("_id"), F.from_json(F.col(metadata), schema).alias("_m"), (F.lit(0) if trust is None else trust).alias("_trust")
    )
    groups = base.groupBy("_key").agg(F.min("_id").alias("group_id"), F.count("*").alias("_n")).filter("_n > 1")
    revised = F.coalesce(day(F.col("_m")["updated"]), day(F.col("_m")["created"]))
    values = F.array(*(F.struct(F.lit(f).alias("field"), F.when(usable(F.col("_m")[f], f in PROSE), F.col("_m")[f]).alias("value")) for f in fields))
    return base.select("_key", "_id", "_trust", revised.alias("_day"), values.alias("_values")), groups


def survivors(papers: DataFrame, key: str = "title_and_authors", row_id: str = "id", metadata: str = "metadata", fields: Sequence[str] = FIELDS, trust: Column | None = None) -> DataFrame:
    """One built record a group: group_id, row_id, n_usable and one column a field (null where no row has a usable value).

    ``row_id`` is the group's best whole row: the most complete one (``n_usable`` fields), then the most
    trusted, the most recently revised, the latest; the fields are the best values of `best_values`.
    """
    base, groups = _groups(papers, key, row_id, metadata, fields, trust)
    counted = base.select("_key", "_id", "_trust", "_day", F.size(F.filter("_values", lambda x: x["value"].isNotNull())).alias("n_usable"))
    rank = F.row_number().over(Window.partitionBy("_key").orderBy(F.desc("n_usable"), *_best_first()))
    rows = counted.withColumn("_rank", rank).filter("_rank = 1").join(groups, "_key").select("group_id", F.col("_id").alias("row_id"), "n_usable")
    built = best_values(papers, key, row_id, metadata, fields, trust).groupBy("group_id").pivot("field", list(fields)).agg(F.first("value"))
    return rows.join(built, "group_id", "left")
