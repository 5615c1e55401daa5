"""SQL text as an entry point: only a single SELECT is run, over temporary views of a folder's tables."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def register(spark: SparkSession, sf_dir: str, names: list[str] = TABLES) -> None:
    for name in names:
        spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(name)


def select_only(text: str) -> str:
    """The statement without fences and a final semicolon; anything but a SELECT is an error."""
    text = re.sub(r"^```\w*\s*|\s*```$", "", text.strip()).rstrip(";").strip()
    if not re.match(r"\s*SELECT\b", text, re.IGNORECASE):
        raise ValueError("only SELECT is allowed")
    return text


def run_select(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    register(spark, sf_dir)
    return spark.sql(select_only(text))
