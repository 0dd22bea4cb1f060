"""A vocabulary that follows a stream of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiloom.functions.text import corpus


def running_counts(stream: DataFrame, text_col: str = "text", lower: bool = True, digit: bool = True) -> DataFrame:
    """(word, freq) so far; write it in update or complete mode. The state is one count for each word."""
    docs = stream.select(F.lit(0).alias("doc_id"), F.col(text_col).alias("text"))
    return corpus(docs, lower=lower, digit=digit).select(F.explode("toks").alias("word")).groupBy("word").agg(F.count("*").alias("freq"))
