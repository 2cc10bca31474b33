"""Citation style of papers from section counts and bibliography entries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scholia.functions.citations import SECTION_WORDS, entry_kind, style_counts, style_decision

KINDS = ("bracket", "paren", "author_year", "superscript", "raw_numeric")


def section_counts(sections: DataFrame, paper: str, position: str, title: str, text: str) -> DataFrame:
    """A row a section with its counts; ``selected`` says whether the decision looks at it.

    Sections whose heading has one of the known words; if a paper has none, its first three headed ones.
    """
    head = F.lower(F.coalesce(F.col(title), F.lit("")))
    known = F.lit(False)
    for word in SECTION_WORDS:
        known = known | F.contains(head, F.lit(word))
    counted = sections.select(paper, position, F.col(title).alias("head"), (known & (head != "")).alias("_known"), style_counts(text).alias("_n"))
    wide = counted.select(paper, position, "head", "_known", *(F.col("_n")[k].alias(k) for k in KINDS))
    any_known = F.max(F.col("_known").cast("int")).over(Window.partitionBy(paper))
    headed = F.coalesce(F.col("head"), F.lit("")) != ""
    place = F.sum(headed.cast("int")).over(Window.partitionBy(paper).orderBy(position).rowsBetween(Window.unboundedPreceding, 0))
    selected = F.when(any_known == 1, F.col("_known")).otherwise(headed & (place <= 3))
    return wide.withColumn("selected", selected).drop("_known")


def bibliography_counts(entries: DataFrame, paper: str, entry: str) -> DataFrame:
    """(paper, bib_count, bib_numeric, bib_author_year) over the distinct entries of a paper."""
    kinds = entries.select(paper, F.trim(F.regexp_replace(entry, r"\s+", " ")).alias("_e")).distinct().withColumn("_k", entry_kind("_e"))
    return kinds.groupBy(paper).agg(
        F.count("*").cast("int").alias("bib_count"), F.count_if(F.col("_k") == "numeric").cast("int").alias("bib_numeric"), F.count_if(F.col("_k") == "author_year").cast("int").alias("bib_author_year")
    )


def decide_style(counts: DataFrame, paper: str, bibliography: DataFrame | None = None, min_bib: int = 5, ratio: float = 0.6) -> DataFrame:
    """(paper, counts, numbered, reason) from `section_counts` and `bibliography_counts`."""
    chosen = lambda k: F.coalesce(F.sum(F.when(F.col("selected"), F.col(k))), F.lit(0)).cast("int").alias(k)
    body = lambda k: F.sum(k).cast("int").alias(f"body_{k}")
    totals = counts.groupBy(paper).agg(*(chosen(k) for k in KINDS), *(body(k) for k in KINDS))
    if bibliography is None:
        joined = totals.withColumns({k: F.lit(0) for k in ("bib_count", "bib_numeric", "bib_author_year")})
    else:
        joined = totals.join(bibliography, paper, "left").fillna(0, ["bib_count", "bib_numeric", "bib_author_year"])
    c = F.col
    decision = style_decision(c("bib_count"), c("bib_numeric"), c("bib_author_year"), c("bracket"), c("author_year"), c("superscript"), c("body_bracket"), c("body_author_year"), c("body_superscript"), min_bib, ratio)
    return joined.withColumn("_d", decision).select("*", "_d.numbered", "_d.reason").drop("_d")
