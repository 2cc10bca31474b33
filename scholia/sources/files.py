"""File sources and sinks: JSON lines, JSON arrays, binary documents, unique names."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

CORRUPT = "_corrupt"


def json_lines(spark: SparkSession, path: str, schema: str | T.StructType) -> tuple[DataFrame, DataFrame]:
    """(good rows, malformed lines). Blank lines are neither. One scan of text serves both."""
    lines = spark.read.text(path).filter(F.trim("value") != "")
    return parse_lines(lines, "value", schema)


def parse_lines(lines: DataFrame, column: str, schema: str | T.StructType) -> tuple[DataFrame, DataFrame]:
    kind = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    full = T.StructType([*kind.fields, T.StructField(CORRUPT, T.StringType())])
    parsed = lines.withColumn("_row", F.from_json(column, full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}))
    bad = F.col("_row").isNull() | F.col(f"_row.{CORRUPT}").isNotNull()
    others = [c for c in lines.columns if c != column]
    good = parsed.filter(~bad).select(*others, *(F.col("_row")[f.name].alias(f.name) for f in kind.fields if f.name not in others))
    return good, parsed.filter(bad).select(*others, F.col(column).alias("line"))


def json_array(spark: SparkSession, path: str, schema: str | T.StructType, needed: list[str]) -> tuple[DataFrame, DataFrame]:
    """(items, quarantined): the items of JSON-array checkpoints that have all the needed fields; files that can't be read.

    ``quarantined``: (path, reason). A missing file is two empty tables; items without a needed field drop out.
    """
    from pyspark.errors import AnalysisException

    kind = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    try:
        whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    except AnalysisException:
        return spark.createDataFrame([], kind), spark.createDataFrame([], "path string, reason string")
    parsed = whole.withColumn("_items", F.from_json("value", T.ArrayType(kind), {"mode": "PERMISSIVE"}))
    # A broken array is read up to its fault, so the end of the text decides as well.
    sound = F.col("_items").isNotNull() & F.trim("value").rlike(r"(?s)^\s*\[.*\]\s*$") & F.try_parse_json("value").isNotNull()
    items = parsed.filter(sound).select(F.explode("_items").alias("_i")).select("_i.*").dropna(subset=needed)
    return items, parsed.filter(~sound).select("path", F.lit("not a JSON array").alias("reason"))


def documents(spark: SparkSession, folder: str, pattern: str = "*.pdf") -> DataFrame:
    """All files below a folder whose name fits (case-sensitive), with their bytes."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(folder)


def extracted(files: DataFrame, extract: Callable[[bytes], list[str]], joiner: str = "\n") -> DataFrame:
    """(path, text, error): the pages of each file joined; a file that fails has '' and the reason."""

    @F.arrow_udf("struct<text:string,error:string>")
    def run(content: pa.Array) -> pa.Array:
        texts, errors = [], []
        for data in content.to_pylist():
            try:
                texts.append(joiner.join(extract(data)) if data is not None else "")
                errors.append(None)
            except Exception as e:  # one bad file must not end the job
                texts.append("")
                errors.append(f"{type(e).__name__}: {e}")
        return pa.StructArray.from_arrays([pa.array(texts, pa.string()), pa.array(errors, pa.string())], ["text", "error"])

    return files.withColumn("_r", run("content")).select("path", "_r.text", "_r.error")


def plain_pages(data: bytes) -> list[str]:
    """An extractor for plain text with form feeds between pages, used where no PDF library is installed."""
    return data.decode("utf-8", "replace").split("\f")


def not_processed(files: DataFrame, done: DataFrame, path: str = "path") -> DataFrame:
    """P10: files whose path isn't among the processed ones, by whole path or by base name."""
    name = lambda c: F.element_at(F.split(c, "/"), -1)
    by_path = files.join(done.select(path).distinct(), path, "left_anti")
    bare = done.filter(~F.contains(path, F.lit("/"))).select(name(F.col(path)).alias("_name")).distinct()
    return by_path.withColumn("_name", name(F.col(path))).join(bare, "_name", "left_anti").drop("_name")


def unique_names(rows: DataFrame, name: str, order: Column) -> DataFrame:
    """Equal file names get _1, _2 … before the extension, the first one none.

    A number that would give a name some row has itself is left out, so all names are distinct.
    """
    stem, ext = F.regexp_extract(name, r"^(.*?)(\.[^.]*)?$", 1), F.regexp_extract(name, r"^(.*?)(\.[^.]*)?$", 2)
    own = Window.partitionBy(name).orderBy(order)
    marked = rows.withColumns({"_n": F.row_number().over(own) - 1, "_stem": stem, "_ext": ext})
    # Numbers taken by rows that are called so: (stem, ext) -> numbers, only where such names exist.
    taken = rows.select(F.regexp_extract(name, r"^(.*)_([1-9][0-9]*)(\.[^.]*)?$", 1).alias("_stem"), F.regexp_extract(name, r"^(.*)_([1-9][0-9]*)(\.[^.]*)?$", 2).try_cast("int").alias("_t"), F.regexp_extract(name, r"^(.*)_([1-9][0-9]*)(\.[^.]*)?$", 3).alias("_ext"))
    held = taken.filter("_t IS NOT NULL").groupBy("_stem", "_ext").agg(F.array_sort(F.collect_set("_t")).alias("_taken"))
    free = F.aggregate(F.coalesce("_taken", F.array().cast("array<int>")), F.col("_n"), lambda n, t: F.when(t <= n, n + 1).otherwise(n))
    numbered = F.concat("_stem", F.lit("_"), free.cast("string"), "_ext")
    return marked.join(held, ["_stem", "_ext"], "left").withColumn("unique_name", F.when(F.col("_n") == 0, F.col(name)).otherwise(numbered)).select(*rows.columns, "unique_name")


def append_lines(rows: DataFrame, path: str) -> None:
    """K1: append as JSON lines."""
    rows.write.mode("append").json(path)


def replace_lines(rows: DataFrame, path: str) -> None:
    """K2-K4: write all rows anew; readers see the old files or the new ones (output committer)."""
    rows.write.mode("overwrite").json(path)
