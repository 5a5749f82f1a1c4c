"""Canonical JSON text and SHA-256 digests built from columns.

Numbers are rendered as text before they get here, keys are written in sorted order and NULLs are
kept, so equal content gives equal text whatever order the data arrived in.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def quoted(text: Column) -> Column:
    """JSON string literal of a text column (null stays null in the output)."""
    wrapped = F.to_json(F.struct(text.alias("v")))
    inner = F.substring(wrapped, F.lit(6), F.length(wrapped) - 6)
    return F.when(text.isNull(), "null").otherwise(inner)


def json_object(fields: dict[str, Column]) -> Column:
    """Object with sorted keys; values are already JSON text."""
    parts: list[Column] = []
    for i, name in enumerate(sorted(fields)):
        parts += [F.lit(("," if i else "") + f'"{name}":'), F.coalesce(fields[name], F.lit("null"))]
    return F.concat(F.lit("{"), *parts, F.lit("}"))


def json_map(column: Column) -> Column:
    """String map as an object with sorted keys; a NULL map is an empty object."""
    entries = F.array_sort(F.map_entries(column))
    rendered = F.transform(
        entries,
        lambda e: F.concat(quoted(e.getField("key")), F.lit(":"), quoted(e.getField("value"))),
    )
    return F.coalesce(
        F.concat(F.lit("{"), F.array_join(rendered, ","), F.lit("}")), F.lit("{}")
    )


def json_list(items: Column) -> Column:
    """Array of ready JSON texts."""
    return F.concat(F.lit("["), F.array_join(items, ","), F.lit("]"))


def digest(text: Column) -> Column:
    return F.sha2(text, 256)


def row_digest(columns: list[str]) -> Column:
    """Digest of a row by its sorted column names, values as text."""
    return digest(json_object({c: quoted(F.col(c).cast("string")) for c in columns}))
