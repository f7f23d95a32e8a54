"""Typed access to the loosely typed parts of a transcript line (VARIANT columns)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import _c, strip

# fixed values: the block types that matter
TEXT_BLOCK = "text"
TOOL_BLOCK = "tool_use"


def string_if_string(variant, path: str = "$") -> Column:
    """The string at ``path``; NULL when it is absent or of another JSON type."""
    variant = _c(variant)
    kind = F.schema_of_variant(F.try_variant_get(variant, path, "variant"))
    return F.when(kind == "STRING", F.try_variant_get(variant, path, "string"))


def parent_if_string(variant) -> Column:
    return string_if_string(variant, "$.parentUuid")


def blocks(content) -> Column:
    """Content as an array of blocks; NULL when it is not an array."""
    return F.try_variant_get(_c(content), "$", "array<variant>")


def _texts(parts: Column) -> Column:
    found = F.transform(
        F.filter(parts, lambda b: F.try_variant_get(b, "$.type", "string") == TEXT_BLOCK),
        lambda b: string_if_string(b, "$.text"),
    )
    return F.filter(found, lambda t: t.isNotNull() & (strip(t) != ""))


def extract_text(content) -> Column:
    """A string as it is; the text blocks of an array joined by a blank line; else ``""``."""
    content = _c(content)
    parts = blocks(content)
    return (
        F.when(parts.isNotNull(), F.array_join(_texts(parts), "\n\n"))
        .when(F.schema_of_variant(content) == "STRING", F.try_variant_get(content, "$", "string"))
        .otherwise(F.lit(""))
    )


def tool_use_names(content) -> Column:
    """Names of the tool-use blocks, in order, one per use."""
    used = F.filter(
        blocks(content), lambda b: F.try_variant_get(b, "$.type", "string") == TOOL_BLOCK
    )
    names = F.filter(
        F.transform(used, lambda b: string_if_string(b, "$.name")), lambda n: n.isNotNull()
    )
    return F.coalesce(names, F.array().cast("array<string>"))
