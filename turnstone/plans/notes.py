"""Ranked keyword search over the note library."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.notes import best_excerpt, extract_title, heading, keyword_score, matched_keywords
from ..session import evaluated_once
from ..sources.notes import CATEGORIES


def score_notes(notes: DataFrame, keywords: list[str]) -> DataFrame:
    """Notes with at least one keyword hit and their score."""
    titled = notes.withColumn("_heading", heading("content"))
    rated = titled.withColumn("score", keyword_score(keywords, "stem", "_heading", "content"))
    return evaluated_once(rated).filter("score > 0")


def notes_search(notes: DataFrame, keywords: list[str], limit: int = 5) -> DataFrame:
    """Best notes; equal scores in folder order, then by path. Excerpts are cut for the winners."""
    rank = F.array_position(F.array(*map(F.lit, CATEGORIES)), F.col("category"))
    order = [F.desc("score"), "_category", "rel_path"]
    return (
        score_notes(notes, keywords)
        .withColumn("_category", rank)
        .orderBy(*order)
        .limit(limit)
        .select(
            "rel_path",
            extract_title("content", "stem").alias("title"),
            "score",
            best_excerpt("content", keywords).alias("excerpt"),
            matched_keywords(keywords, "stem", "_heading", "content").alias("matched_keywords"),
            "_category",
        )
        .orderBy(*order)
        .drop("_category")
    )
