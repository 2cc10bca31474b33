"""The question interface: a bounded tool loop around a pluggable model, and a command line.

The model is ``messages -> {"text": ...}`` or ``{"tool": name, "argument": ...}``; none is shipped.
Run: ``python -m scholia.plans.agent --tables DIR --query "..."`` answers from the catalog alone.
"""

from __future__ import annotations

import argparse
from collections.abc import Callable

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from scholia.functions.text import glue, normalize_text
from scholia.plans.pipelines import NO_ANSWER, answer
from scholia.session import build_session, table

STEPS = 5


def run_loop(model: Callable[[list[dict]], dict], tools: dict[str, Callable[[str], str]], question: str, system: str = "", steps: int = STEPS) -> str:
    """Lets the model call tools up to ``steps`` times; an unknown or failing tool is told to the model."""
    if not question or not question.strip():
        return NO_ANSWER
    messages = [{"role": "system", "text": system}, {"role": "human", "text": question}]
    for _ in range(steps):
        reply = model(messages)
        if "tool" not in reply:
            return reply.get("text") or NO_ANSWER
        name = reply["tool"]
        try:
            result = tools[name](reply.get("argument", "")) if name in tools else f"Error: there is no tool {name}."
        except Exception as e:
            result = f"Error: {type(e).__name__}: {e}"
        messages += [{"role": "ai", "text": f"{name}({reply.get('argument', '')})"}, {"role": "tool", "text": result}]
    return "Error: the limit of steps was reached."


def register_functions(spark: SparkSession) -> None:
    """Unicode normalisation for SQL text: ``scholia_ascii`` (N1's first step) and ``scholia_unmarked`` (N5's)."""
    from scholia.functions import text

    spark.udf.register("scholia_ascii", text._ascii)
    spark.udf.register("scholia_unmarked", text._unmarked)


def catalog_tables(spark: SparkSession, tables: str):
    papers = table(spark, tables, "papers")
    catalog = papers.select("id", "arxiv_id", glue(normalize_text("title")).alias("glued"), "created_date")
    texts = papers.select("arxiv_id", F.get_json_object("metadata", "$.abstract").alias("text"))
    return catalog, texts


def main() -> None:
    parser = argparse.ArgumentParser(description="Answer a question from the catalog.")
    parser.add_argument("--query", required=True)
    parser.add_argument("--tables", required=True, help="folder of the Parquet tables")
    options = parser.parse_args()
    spark = build_session("question")
    print(answer(*catalog_tables(spark, options.tables), options.query))
    spark.stop()


if __name__ == "__main__":
    main()
