"""Parsed lines -> readable turns. One narrow pass: no shuffle, no Python."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.content import extract_text, parent_if_string, string_if_string, tool_use_names
from ..functions.redact import Rule, redact
from ..functions.text import strip
from ..session import evaluated_once

# fixed values: line types and roles that are kept
LINE_TYPES = ["user", "assistant"]
ROLES = ["user", "assistant"]


def _kept_type() -> Column:
    return F.coalesce(F.try_variant_get("v", "$.type", "string").isin(LINE_TYPES), F.lit(False))


def _valid_message() -> Column:
    kind = F.schema_of_variant(F.try_variant_get("v", "$.message", "variant"))
    return F.coalesce(kind.startswith("OBJECT"), F.lit(False)) & string_if_string("v", "$.uuid").isNotNull()


def _known_role() -> Column:
    return F.coalesce(F.try_variant_get("v", "$.message.role", "string").isin(ROLES), F.lit(False))


def keep_line_types(raw: DataFrame) -> DataFrame:
    return raw.filter(_kept_type())


def valid_message(raw: DataFrame) -> DataFrame:
    return raw.filter(_valid_message())


def route_role(raw: DataFrame) -> DataFrame:
    """The role of the message counts, not the type of the line."""
    return raw.filter(_known_role())


def parse_lines(raw: DataFrame, rules: list[Rule] | None = None) -> DataFrame:
    """Everything later steps need from a line, secrets already redacted.

    All lines stay: metadata counts for the session even where the line is no turn. Unusable
    lines keep their redacted text together with the ``problem``.
    """
    usable = _kept_type() & _valid_message() & _known_role()
    role = F.try_variant_get("v", "$.message.role", "string")
    content = F.try_variant_get("v", "$.message.content", "variant")
    text = F.when(usable, strip(extract_text(content)))
    seen = evaluated_once(
        raw.withColumn("_usable", F.coalesce(usable, F.lit(False)))
        .withColumn("_text", text)
        .withColumn("is_turn", F.col("_usable") & (F.coalesce("_text", F.lit("")) != ""))
    )
    return (
        seen.select(
            "project_slug",
            "transcript",
            "pos",
            string_if_string("v", "$.timestamp").alias("timestamp"),
            string_if_string("v", "$.sessionId").alias("raw_session"),
            F.nullif(string_if_string("v", "$.gitBranch"), F.lit("")).alias("git_branch"),
            F.nullif(string_if_string("v", "$.cwd"), F.lit("")).alias("cwd"),
            "is_turn",
            F.when(F.col("is_turn"), string_if_string("v", "$.uuid")).alias("uuid"),
            F.when(F.col("is_turn"), parent_if_string("v")).alias("parent_uuid"),
            F.when(F.col("is_turn"), role).alias("role"),
            redact(
                F.when(F.col("is_turn"), F.col("_text")).when(F.col("problem").isNotNull(), F.col("value")),
                rules,
            ).alias("content"),
            F.when(F.col("_usable") & (role == "assistant"), tool_use_names(content))
            .otherwise(F.array().cast("array<string>"))
            .alias("tools"),
            "problem",
        )
    )


def quarantined(lines: DataFrame) -> DataFrame:
    return lines.filter(F.col("problem").isNotNull()).select(
        "project_slug", "transcript", "pos", "problem", F.col("content").alias("line")
    )


def turns(lines: DataFrame, sessions: DataFrame) -> DataFrame:
    """Kept turns with the session id of their transcript, duplicates included."""
    ids = sessions.select("project_slug", "transcript", "session_id")
    return (
        lines.filter("is_turn")
        .join(ids, ["project_slug", "transcript"])
        .select(
            "uuid",
            "session_id",
            "parent_uuid",
            F.coalesce("timestamp", F.lit("")).alias("timestamp"),
            "role",
            "content",
            "pos",
            "transcript",
            "project_slug",
        )
    )
