"""Sections and chunks: ordered fold of short sections, balanced split, regrouping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scholia.functions.text import checksum, chunk_id, once, token_count, tokens

#: Tokens below which a section is merged with the next, and tokens a chunk has at most.
MERGE_BELOW, MAX_TOKENS = 200, 1024


def fold_sections(sections: Column, threshold: int = MERGE_BELOW, count=None) -> Column:
    """An ordered array of (section_title, section_text) with neighbours merged up to ``threshold`` tokens.

    Titles join with an em dash, texts with an empty line; the merged text is counted anew. A
    remainder below the threshold stays as the last section. A threshold of 0 or less merges nothing.
    """
    count = count or token_count
    if threshold <= 0:
        return F.transform(sections, lambda s: F.struct(F.coalesce(s["section_title"], F.lit("")).alias("section_title"), F.coalesce(s["section_text"], F.lit("")).alias("section_text")))
    item = "struct<section_title:string,section_text:string>"
    start = F.struct(F.array().cast(f"array<{item}>").alias("done"), F.lit("").alias("title"), F.lit("").alias("text"))

    def step(state: Column, s: Column) -> Column:
        title, text = F.coalesce(s["section_title"], F.lit("")), F.coalesce(s["section_text"], F.lit(""))
        fresh = state["text"] == ""
        both = (state["title"] != "") & (title != "")
        new_title = F.when(fresh, title).when(both, F.concat(state["title"], F.lit(" — "), title)).when(state["title"] != "", state["title"]).otherwise(title)
        new_text = F.when(fresh, text).otherwise(F.concat(state["text"], F.lit("\n\n"), text))
        merged = F.struct(new_title.alias("section_title"), new_text.alias("section_text"))
        full = count(new_text) >= threshold
        return F.struct(
            F.when(full, F.concat(state["done"], F.array(merged.cast(item)))).otherwise(state["done"]).alias("done"),
            F.when(full, F.lit("")).otherwise(new_title).alias("title"),
            F.when(full, F.lit("")).otherwise(new_text).alias("text"),
        )

    def finish(state: Column) -> Column:
        rest = F.struct(state["title"].alias("section_title"), state["text"].alias("section_text")).cast(item)
        return F.when(state["text"] != "", F.concat(state["done"], F.array(rest))).otherwise(state["done"])

    return F.aggregate(sections, start, step, finish)


def ordered_sections(rows: DataFrame, paper: str, position: str, title: str, text: str) -> DataFrame:
    """(paper, sections) with the sections as an array in order of ``position``."""
    item = F.struct(F.col(position).alias("pos"), F.col(title).alias("section_title"), F.col(text).alias("section_text"))
    ordered = F.transform(F.array_sort(F.collect_list(item)), lambda s: F.struct(s["section_title"], s["section_text"]))
    return rows.groupBy(paper).agg(ordered.alias("sections"))


def merge_sections(rows: DataFrame, paper: str, position: str, title: str, text: str, threshold: int = MERGE_BELOW) -> DataFrame:
    """C24 over a table: (paper, pos, section_title, section_text), pos from 1."""
    grouped = ordered_sections(rows, paper, position, title, text)
    merged = grouped.select(paper, F.posexplode(fold_sections(F.col("sections"), threshold)).alias("pos", "s"))
    return merged.select(paper, (F.col("pos") + 1).alias("pos"), "s.section_title", "s.section_text")


def balanced_pieces(token_list: Column, maximum: int = MAX_TOKENS) -> Column:
    """The tokens in ceil(T/max) pieces of equal size but the last; no tokens make one empty piece."""

    def cut(t: Column) -> Column:
        n = F.size(t)
        parts = F.greatest(F.ceil(n / maximum).cast("int"), F.lit(1))
        size = F.greatest(F.ceil(n / parts).cast("int"), F.lit(1))
        return F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)), size), lambda o: F.slice(t, o + 1, size))

    return once(token_list, cut)


def split_chunks(rows: DataFrame, paper: str, position: str, text: str, maximum: int = MAX_TOKENS, tokenize=None) -> DataFrame:
    """Every chunk cut into balanced pieces, other columns copied to each; null texts drop out.

    Adds chunk_num (1-based within the paper, by position and piece), piece, chunk_text, token_len,
    checksum and chunk_id (repeatable, from content and place). ``tokenize`` maps a text column to an
    array of tokens that joined by spaces give the text back; words of white space by default.
    """
    tokenize = tokenize or (lambda t: F.filter(F.split(t, r"\s+"), lambda w: w != ""))
    pieces = rows.filter(F.col(text).isNotNull()).select("*", F.posexplode(balanced_pieces(tokenize(F.col(text)), maximum)).alias("_piece", "_tokens"))
    shown = pieces.withColumns({"chunk_text": F.array_join("_tokens", " "), "token_len": F.size("_tokens"), "piece": F.col("_piece") + 1}).drop("_piece", "_tokens")
    from pyspark.sql import Window

    number = F.row_number().over(Window.partitionBy(paper).orderBy(position, "piece"))
    summed = shown.withColumn("chunk_num", number).withColumn("checksum", checksum("chunk_text"))
    return summed.withColumn("chunk_id", chunk_id(F.concat_ws("|", F.col(paper), "checksum"), "chunk_num"))


def regroup_citations(chunks: DataFrame, citations: DataFrame, chunk: str, order: str, item: Column) -> DataFrame:
    """Chunks with their distinct citations in order, and whether there are any.

    Repeated citations are dropped before the shuffle's lists are built, so a chunk's list holds
    distinct items only.
    """
    each = citations.select(F.col(chunk), F.col(order).alias("_o"), item.alias("_i"))
    first = each.groupBy(chunk, "_i").agg(F.min("_o").alias("_o"))
    listed = first.groupBy(chunk).agg(F.transform(F.array_sort(F.collect_list(F.struct("_o", "_i"))), lambda x: x["_i"]).alias("citations"))
    joined = chunks.join(listed, chunk, "left")
    return joined.withColumn("is_citation_context", F.coalesce(F.size("citations") > 0, F.lit(False)))


def retokenize(text: Column | str) -> Column:
    return tokens(text)
