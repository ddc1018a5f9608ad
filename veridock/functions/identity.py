"""Content-derived identifiers over canonical JSON.

Canonical JSON has sorted keys, no blanks, nulls kept.  Shapes that are known
are assembled natively; open values go through :func:`canonical_json`.
"""

from __future__ import annotations

import dataclasses
import hashlib
import json
import math
from collections.abc import Mapping
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def stable_id(prefix: str, canonical: Column) -> Column:
    """``prefix_`` and the SHA-256 of the canonical JSON."""
    return F.concat(F.lit(prefix + "_"), F.sha2(escape_controls(canonical), 256))


def with_stable_id(df: DataFrame, name: str, prefix: str, canonical: Column) -> DataFrame:
    """Adds :func:`stable_id` as a column; the JSON is made once, in a column of its own."""
    return df.withColumn("__json", canonical).withColumn(name, stable_id(prefix, F.col("__json"))).drop("__json")


def escape_controls(json_text: Column) -> Column:
    """A JSON text without the control characters that :func:`json_string` leaves; they
    can only stand inside its strings, so it is done once for a whole text."""
    one = lambda c: F.when(c < " ", F.concat(F.lit("\\u"), F.lpad(F.lower(F.hex(F.ascii(c))), 4, "0"))).otherwise(c)
    others = F.array_join(F.transform(F.regexp_extract_all(json_text, F.lit("(?s)."), F.lit(0)), one), "")
    return F.when(json_text.rlike(r"[\x00-\x1f]"), others).otherwise(json_text)


def json_string(value: Column) -> Column:
    """A JSON string literal, or ``null``.  Control characters without a short form are
    left to :func:`escape_controls`, which a finished text goes through."""
    escaped = F.regexp_replace(F.regexp_replace(value, r"\\", r"\\\\"), '"', r'\\"')
    for raw, short in (("\n", "n"), ("\t", "t"), ("\r", "r"), ("\b", "b"), ("\f", "f")):
        escaped = F.replace(escaped, F.lit(raw), F.lit("\\" + short))
    return F.coalesce(F.concat(F.lit('"'), escaped, F.lit('"')), F.lit("null"))


def json_number(value: Column) -> Column:
    return F.coalesce(value.cast("string"), F.lit("null"))


def json_array(items: Column) -> Column:
    """From an array of JSON texts."""
    return F.concat(F.lit("["), F.array_join(items, ","), F.lit("]"))


def json_object(**fields: Column) -> Column:
    """From JSON texts by key; keys are sorted here."""
    parts: list[Column] = []
    for k, name in enumerate(sorted(fields)):
        parts += [F.lit(("," if k else "{") + f'"{name}":'), fields[name]]
    return F.concat(*parts, F.lit("}"))


@F.pandas_udf(StringType())
def canonical_json(text: pd.Series) -> pd.Series:
    """Canonical form of any JSON text; NaN and infinities are refused."""
    import json

    def refuse(name):
        raise ValueError(f"{name} is not allowed")

    return text.map(lambda t: None if t is None else json.dumps(json.loads(t, parse_constant=refuse), sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False))


def to_plain(value: Any) -> Any:
    """Records, mappings, sequences and scalars as JSON values.  Keys must be texts;
    sets, other objects and numbers that aren't finite are refused."""
    if value is None or isinstance(value, (str, bool, int)):
        return value
    if isinstance(value, float):
        if not math.isfinite(value):
            raise ValueError("a JSON number must be finite")
        return value
    if dataclasses.is_dataclass(value) and not isinstance(value, type):
        return {f.name: to_plain(getattr(value, f.name)) for f in dataclasses.fields(value)}
    if hasattr(value, "asDict"):
        return to_plain(value.asDict())
    if isinstance(value, Mapping):
        if any(not isinstance(k, str) for k in value):
            raise ValueError("a JSON key must be a text")
        return {k: to_plain(v) for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return [to_plain(v) for v in value]
    raise ValueError(f"{type(value).__name__} is no JSON value")


def canonical_dumps(value: Any) -> str:
    """Canonical JSON of a driver-side value."""
    return json.dumps(to_plain(value), sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def stable_text_id(prefix: str, identity: Any) -> str:
    """:func:`stable_id` of a driver-side value."""
    import re

    if not re.fullmatch(r"[a-z][a-z0-9_-]*", prefix):
        raise ValueError("an id's prefix is lower-case letters, digits, _ and -, a letter first")
    return f"{prefix}_{hashlib.sha256(canonical_dumps(identity).encode()).hexdigest()}"
