"""Reference lists: markers, resolution per section, short and full entries, authors in text."""

from __future__ import annotations

import difflib
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scholia.functions.citations import block_numbers, entry_text, find_year, is_full_entry, markers, numbered_entries, range_blocks, reference_tail, short_surnames
from scholia.functions.names import given_tokens, is_initial, name_tokens, surname_candidates, token_set, words_with_positions
from scholia.functions.text import normalize_name, normalize_reference


def expand_markers(texts: DataFrame, key: str, text: str) -> DataFrame:
    """C11: a row a marker and number: (key, marker_pos, marker, num_pos, number); markers without numbers drop out.

    Ranges become rows a block at a time, so a range of any length is no large array.
    """
    each = texts.select(F.col(key), F.posexplode(markers(text)).alias("marker_pos", "m"))
    ranges = each.select(key, "marker_pos", F.col("m.marker").alias("marker"), F.explode("m.ranges").alias("_r"))
    blocks = ranges.select(key, "marker_pos", "marker", "_r", F.explode(range_blocks(F.col("_r.low"), F.col("_r.high"))).alias("_first"))
    numbers = blocks.select(key, "marker_pos", "marker", "_r", F.explode(block_numbers(F.col("_first"), F.col("_r.high"))).alias("number"))
    return numbers.select(key, "marker_pos", "marker", (F.col("_r.at") + F.col("number") - F.col("_r.low")).alias("num_pos"), "number")


def numbered_text(number: str, reference: str) -> Column:
    """The citation string of an entry of a numbered list, or the words that say it's missing."""
    return F.concat(F.lit("["), F.col(number).cast("string"), F.lit("] "), F.coalesce(reference, F.lit("Reference not found")))


def match_markers(texts: DataFrame, key: str, text: str, references: DataFrame, owner: str | None = None) -> DataFrame:
    """Every number of a text's markers with its reference, or the words that say it's missing.

    ``references``: (owner, number, reference), where ``owner`` is the text's column that says whose list
    it is, the key by default. Only the first occurrence of a marker in a text counts.
    """
    first = expand_markers(texts, key, text)
    firsts = first.groupBy(key, "marker").agg(F.min("marker_pos").alias("marker_pos"))
    once = first.join(firsts, [key, "marker", "marker_pos"], "left_semi")
    if owner:
        once = once.join(texts.select(key, owner), key)
    kept = [key, *([owner] if owner else []), "marker", "marker_pos", "num_pos", "number"]
    listed = references.withColumn("number", F.col("number").cast("string"))
    joined = once.withColumn("_n", F.col("number").cast("string")).join(listed.withColumnRenamed("number", "_n"), [owner or key, "_n"], "left")
    return joined.select(*kept, numbered_text("number", "reference").alias("reference"))


def references_of(documents: DataFrame, key: str, text: str) -> DataFrame:
    """(key, number, reference) of every document's numbered list, a number as it's written; its first entry counts."""
    each = documents.select(F.col(key), F.posexplode(numbered_entries(reference_tail(text))).alias("_pos", "_e"))
    first = each.groupBy(key, F.col("_e.num").alias("number")).agg(F.min_by("_e.text", "_pos").alias("_t"))
    return first.select(key, "number", entry_text("_t").alias("reference"))


def without_repeats(entries: DataFrame, key: str, entry: str, position: str) -> DataFrame:
    """A paper's entries in order, without repeated full ones and without short ones a full one explains.

    A short entry (a year, 'et al' or 'and') goes if a full entry of the paper has its year and one
    of its family names somewhere.
    """
    low = F.lower(entry)
    marked = entries.withColumns({"_full": is_full_entry(entry), "_year": find_year(entry), "_norm": normalize_reference(entry)})
    first = F.row_number().over(Window.partitionBy(key, "_norm").orderBy(position))
    full = marked.filter("_full").withColumn("_rn", first).filter("_rn = 1").drop("_rn")
    short = marked.filter("NOT _full")
    likely = F.col("_year").isNotNull() & (F.contains(low, F.lit("et al")) | (F.contains(low, F.lit(" and ")) & (F.length(entry) < 80)))
    asked = short.filter(likely).select(key, position, "_year", F.explode(short_surnames(entry)).alias("_name"))
    held = full.select(key, "_year", low.alias("_text"))
    gone = asked.join(held, [key, "_year"]).filter(F.contains("_text", F.col("_name"))).select(key, position).distinct()
    return full.unionByName(short.join(gone, [key, position], "left_anti")).select(*entries.columns)


_FOUND = pa.struct(
    [("author", pa.string()), ("method", pa.string()), ("candidate", pa.string()), ("given", pa.string()), ("positions", pa.list_(pa.int32())), ("score", pa.float64()), ("matched_word", pa.string())]
)


def authors_in_text(texts: DataFrame, key: str, text: str, authors: DataFrame, author: str, threshold: float = 0.92, window: int = 5) -> DataFrame:
    """(key, author, method, details) for each author named in a text.

    Tried in this order: 'citation' (a family name before "et al"), 'surname', 'fullname' (a given name
    within ``window`` words of it) and 'fuzzy' (the best ratio of a family name and a word reaches
    ``threshold``). ``details`` (E22): the candidate that matched, the given name and both positions, or
    the score and the word. ``authors``: (key, author), the names to look for in each text. The names of
    a text are brought together first, so a text is read once whatever their number.
    """
    given = given_tokens("author", F.lower(F.try_element_at(F.filter(name_tokens("author"), lambda t: ~is_initial(t)), F.lit(-1))))
    names = authors.select(F.col(key), F.col(author).alias("author")).distinct()
    names = names.withColumns({"_c": F.filter(F.transform(surname_candidates("author"), F.trim), lambda c: c != ""), "_g": given})
    listed = names.groupBy(key).agg(F.collect_list(F.struct("author", "_c", "_g")).alias("_names"))
    # The join's own partitioning, but with a number that isn't lowered for small tables: the search is costly.
    parts = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    asked = texts.select(F.col(key), normalize_name(text).alias("_t")).repartition(parts, key).join(listed, key)

    @F.arrow_udf("array<struct<author:string,method:string,candidate:string,given:string,positions:array<int>,score:double,matched_word:string>>")
    def find(column: pa.Array, lists: pa.Array) -> pa.Array:
        return pa.array([_named_in(t, people, threshold, window) for t, people in zip(column.to_pylist(), lists.to_pylist(), strict=True)], pa.list_(_FOUND))

    found = asked.select(key, F.explode(find("_t", "_names")).alias("_f"))
    return found.select(key, "_f.author", "_f.method", F.struct(*(F.col(f"_f.{n}") for n in ("candidate", "given", "positions", "score", "matched_word"))).alias("details"))


def _named_in(text: str, people: list[dict], threshold: float, window: int) -> list[dict]:
    # Words end where a letter or digit does; hyphens and apostrophes end them too, and are words' own signs elsewhere.
    plain = f" {_BETWEEN.sub(' ', text)} "
    place: dict[str, list[int]] = {}
    for i, w in enumerate(_WORDS.findall(text)):
        place.setdefault(w, []).append(i)
    sized: dict[int, list[str]] = {}
    for w in place:
        sized.setdefault(len(w), []).append(w)
    out = []
    for p in people:
        hit = _tier(p["_c"], p["_g"] or (), plain, place, sized, threshold, window)
        if hit:
            out.append({"author": p["author"]} | hit)
    return out


_BETWEEN, _WORDS = re.compile("[^0-9a-z]+"), re.compile(r"[0-9a-zA-Z'\-]+")


def _tier(candidates, given, plain: str, place: dict[str, list[int]], sized: dict[int, list[str]], threshold: float, window: int) -> dict | None:
    bare = [(c, f" {_BETWEEN.sub(' ', c)} ") for c in candidates]
    for method, rest in (("citation", "et al "), ("surname", "")):
        for c, word in bare:
            if word.strip() and word + rest in plain:
                return {"method": method, "candidate": c}
    for c in candidates:
        for g in given:
            for i in place.get(c, ()):
                near = next((j for j in place.get(g, ()) if abs(i - j) <= window), None)
                if near is not None:
                    return {"method": "fullname", "candidate": c, "given": g, "positions": [near, i]}
    best, matcher = (0.0, None, None), difflib.SequenceMatcher(None, "", "")
    for c in candidates:
        # The ratio is at most 2*min/(sum of lengths): words of other lengths need no comparison.
        fit = [n for n in sized if min(n, len(c)) >= 3 and 2 * min(n, len(c)) >= threshold * (n + len(c))]
        for w in (w for n in sorted(fit) for w in sized[n]):
            # Both ends unlike cost two characters at least, which short words can't afford.
            if threshold > 0.9 and c[0] != w[0] and c[-1] != w[-1] and max(len(w), len(c)) < 12:
                continue
            matcher.set_seqs(c, w)
            if matcher.quick_ratio() >= max(threshold, best[0]) and (score := matcher.ratio()) > best[0]:
                best = (score, c, w)
    return {"method": "fuzzy", "candidate": best[1], "score": best[0], "matched_word": best[2]} if best[0] >= threshold else None


def cite_by_marker(markers_: DataFrame, resolved: DataFrame, key: str) -> DataFrame:
    """(key, section, citation) distinct, for markers whose reference text was resolved."""
    return markers_.join(resolved, [key, "reference"]).drop("reference").distinct()


def cite_by_first_author(named: DataFrame, resolved: DataFrame, key: str) -> DataFrame:
    """Sections in which the first author of a resolved paper was found, by equal word sets.

    ``named``: (key, section, author); ``resolved``: (key, id, first_author).
    """
    left = named.withColumn("_set", token_set("author")).select(key, "section", "_set").distinct()
    right = resolved.withColumn("_set", token_set("first_author"))
    return left.join(right, [key, "_set"]).select(key, "section", "id").distinct()


def positions(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, pos, word)."""
    return texts.select(F.col(key), F.explode(words_with_positions(text)).alias("w")).select(key, "w.pos", "w.word")
