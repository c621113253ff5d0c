"""Word-norm source: a table of words with a concreteness rating."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Cells that count as missing in a spreadsheet or CSV of norms.
MISSING_CELLS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)


def clean_norms(rows: DataFrame, word: str, score: str, position: Column) -> DataFrame:
    """``token, score``: words lower-cased, missing cells dropped, the last duplicate kept."""
    present = F.col(word).isNotNull() & ~F.col(word).isin(*MISSING_CELLS)
    return (
        rows.select(F.col(word), F.col(score).cast("string").alias("_score"), position.alias("_position"))
        .where(present & F.col("_score").isNotNull() & ~F.col("_score").isin(*MISSING_CELLS))
        .select(F.lower(word).alias("token"), F.col("_score").cast("double").alias("score"), "_position")
        .groupBy("token")
        .agg(F.max_by("score", "_position").alias("score"))
    )


def read_norms_csv(spark: SparkSession, path: str, word: str = "Word", score: str = "Conc.M") -> DataFrame:
    """Norms from a CSV file with a header; file order decides between duplicates."""
    rows = spark.read.option("header", "true").option("nullValue", "").csv(path)
    rows = rows.select(
        F.col(f"`{word}`").alias("_word"),
        F.col(f"`{score}`").alias("_rating"),
        F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id()).alias("_row"),
    )
    return clean_norms(rows, "_word", "_rating", F.col("_row"))
