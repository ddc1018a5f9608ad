"""Strict reading of JSON records: declared fields only, types as declared, and
every violation with its line."""

from __future__ import annotations

import json
import math
from collections.abc import Iterable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DataType, DoubleType, IntegerType, LongType, MapType, StringType, StructType

VERSION = "1.0"


def _problems(kind: DataType, value: Any, nullable: bool, path: str, required: frozenset[str]) -> Iterator[str]:
    if value is None:
        if not nullable:
            yield f"{path} is missing"
        return
    if isinstance(kind, StringType):
        if not isinstance(value, str):
            yield f"{path} must be a text"
        elif path in required and not value.strip():
            yield f"{path} is blank"
    elif isinstance(kind, BooleanType):
        if not isinstance(value, bool):
            yield f"{path} must be true or false"
    elif isinstance(kind, (LongType, IntegerType)):
        if not isinstance(value, int) or isinstance(value, bool):
            yield f"{path} must be a whole number"
    elif isinstance(kind, DoubleType):
        if not isinstance(value, (int, float)) or isinstance(value, bool):
            yield f"{path} must be a number"
        elif not math.isfinite(value):
            yield f"{path} must be finite"
    elif isinstance(kind, ArrayType):
        if not isinstance(value, list):
            yield f"{path} must be a list"
        else:
            for k, x in enumerate(value):
                yield from _problems(kind.elementType, x, kind.containsNull, f"{path}[{k}]", required)
    elif isinstance(kind, MapType):
        if not isinstance(value, dict):
            yield f"{path} must be an object"
    elif isinstance(kind, StructType):
        if not isinstance(value, dict):
            yield f"{path or 'the record'} must be an object"
            return
        dot = f"{path}." if path else ""
        for name in sorted(set(value) - set(kind.names)):
            yield f"unknown field {dot}{name}"
        for f in kind.fields:
            yield from _problems(f.dataType, value.get(f.name), f.nullable, dot + f.name, required)


def violations(text: str, kind: StructType, required: Iterable[str] = ()) -> list[str]:
    """What is wrong with one JSON record; nothing for a good one.  Fields that the
    schema declares not null must be there, texts in ``required`` not be blank,
    and a declared schema_version be known."""

    def refuse(name: str) -> float:
        raise ValueError(f"{name} is no JSON number")

    try:
        value = json.loads(text, parse_constant=refuse)
    except ValueError as e:
        return [f"no JSON: {e}"]
    found = list(_problems(kind, value, False, "", frozenset(required)))
    if isinstance(value, dict) and "schema_version" in kind.names and value.get("schema_version") != VERSION:
        found.append(f"schema_version {value.get('schema_version')!r} isn't known")
    return found


def read_records(rows: DataFrame, kind: StructType, required: Iterable[str] = (), path_col: str = "path", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(records, problems) of JSON lines files, one row of (path, text) each.

    Records have the declared columns with path and line; problems are (path,
    line, problem), every one of every line.  Blank lines count as lines and are
    no records; lines with a problem are no records either.
    """
    needed = tuple(required)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple[str, int, str, list[str]]] = []
            for path, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                out += [(path, n, line, violations(line, kind, needed)) for n, line in enumerate((text or "").splitlines(), 1) if line.strip()]
            columns = list(zip(*out, strict=True)) or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.string()), pa.array(columns[3], pa.list_(pa.string()))], ["path", "line", "json", "problems"])

    checked = rows.select(F.col(path_col).alias("path"), F.col(text_col).alias("text")).mapInArrow(run, "path string, line int, json string, problems array<string>")
    loose = StructType.fromJson(json.loads(json.dumps(kind.jsonValue()).replace('"nullable": false', '"nullable": true')))
    records = checked.where(F.size("problems") == 0).select("path", "line", F.from_json("json", loose).alias("r")).select("path", "line", "r.*")
    return records, checked.select("path", "line", F.explode("problems").alias("problem"))


def require(rows: DataFrame, checks: dict[str, Any], id_col: str) -> DataFrame:
    """(id, violation) of a table's rows by named conditions that must hold; an unknown
    (null) outcome is a violation."""
    found = F.array_compact(F.array(*[F.when(~F.coalesce(test, F.lit(False)), F.lit(name)) for name, test in checks.items()]))
    return rows.select(F.col(id_col).alias("id"), F.explode(found).alias("violation"))
