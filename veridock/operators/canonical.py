"""Canonical claims: equivalent source claims under one content-derived id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veridock.functions import identity as J
from veridock.functions import text as T

#: Optional scope fields of a claim with their types; missing ones count as null.
SCOPE = {"population": "string", "geography": "string", "temporal_scope": "string", "time_horizon": "string", "outcome_metric": "string", "outcome_direction": "string", "assumptions": "array<string>"}


def with_scope(claims: DataFrame) -> DataFrame:
    """Adds the scope fields that ``claims`` lacks."""
    for name, kind in SCOPE.items():
        if name not in claims.columns:
            claims = claims.withColumn(name, F.lit(None).cast(kind))
    return claims


def _norm_json(c: str) -> Column:
    return J.json_string(T.normalized(F.col(c)))


def semantics_json() -> Column:
    """Canonical JSON of everything that can change a claim's scope."""
    condition = lambda c: J.json_object(field=F.lit('"context"'), operator=J.json_string(T.normalized(c["operator"])), value=J.json_string(T.normalized(c["value"])))
    none = F.array().cast("array<string>")
    conditions = F.array_sort(F.transform("conditions", condition))
    assumptions = F.transform(F.array_sort(F.array_distinct(F.transform(F.coalesce("assumptions", none), T.normalized))), J.json_string)
    definitions = F.when(F.col("definition").isNull(), F.lit("{}")).otherwise(J.json_object(governing_definition=_norm_json("definition")))
    outcome_parts = F.array_compact(F.array(*[F.when(F.col(f"outcome_{k}").isNotNull(), F.concat(F.lit(f'"{k}":'), _norm_json(f"outcome_{k}"))) for k in ("direction", "metric")]))
    return J.json_object(
        assumptions=J.json_array(assumptions), conditions=J.json_array(conditions), definitions=definitions, geography=_norm_json("geography"),
        modality=_norm_json("modality"), object_or_value=_norm_json("object"), objective=_norm_json("objective"),
        outcome=F.concat(F.lit("{"), F.array_join(outcome_parts, ","), F.lit("}")), polarity=J.json_string(F.col("polarity")), population=_norm_json("population"),
        quantifier=_norm_json("quantifier"), relation=_norm_json("relation"), subject=_norm_json("subject"), temporal_scope=_norm_json("temporal_scope"), time_horizon=_norm_json("time_horizon"),
    )


def _exact(claims: DataFrame) -> DataFrame:
    """Claims whose texts are folded for any Unicode text (compatibility form, full
    case folding) before the native normal form is taken of them."""
    own = claims
    for c in ("subject", "relation", "object", "quantifier", "modality", "definition", "objective", *[k for k, kind in SCOPE.items() if kind == "string"]):
        own = own.withColumn(c, T.folded_exact(F.col(c)))
    values = T.folded_all_exact(F.transform("conditions", lambda c: c["value"]))
    own = own.withColumn("conditions", F.zip_with("conditions", values, lambda c, v: F.struct(c["operator"].alias("operator"), v.alias("value"))))
    return own.withColumn("assumptions", T.folded_all_exact(F.col("assumptions"))).withColumn("__folded", T.folded_exact(F.col("proposition")))


def keyed(claims: DataFrame, exact: bool = False, distinct: bool = False) -> DataFrame:
    """Source claims with canonical_id, semantics_json and the normal form of the
    proposition.

    Repeated rows of a claim id count once; different content under one id is an
    error.  A claim without subject, relation, and object or outcome is an
    abstention: it stays alone, whatever its wording.  ``exact`` folds any
    Unicode text; the native form is exact for text in NFKC whose only special
    case fold is the sharp s.  ``distinct`` promises that no claim id repeats:
    then no row moves.
    """
    rows = with_scope(claims)
    rows = _exact(rows) if exact else rows.withColumn("__folded", F.col("proposition"))
    filled = lambda c: F.coalesce(F.col(c) != "", F.lit(False))
    structured = filled("subject") & filled("relation") & (F.col("object").isNotNull() | F.col("outcome_metric").isNotNull() | F.col("outcome_direction").isNotNull())
    base = {"claim_type": J.json_string(F.col("claim_type")), "semantics": F.col("semantics_json")}
    alone = base | {"normalized_proposition": _norm_json("__folded"), "incomplete_source_claim_id": J.json_string(F.col("claim_id"))}
    rows = rows.withColumn("semantics_json", semantics_json())
    rows = J.with_stable_id(rows, "canonical_id", "canonical_claim", F.when(structured, J.json_object(**base)).otherwise(J.json_object(**alone)))
    rows = rows.withColumn("structured", structured).withColumn("norm", T.normalized(F.col("__folded"))).drop("__folded")
    if distinct:
        # a filter on it would be pushed below all patterns, whose expressions then repeat without end
        return rows.withColumn("structured", F.col("structured") & (F.monotonically_increasing_id() >= 0))
    content = F.xxhash64("canonical_id", "proposition")
    # one aggregate a column, so that columns nobody asks for aren't computed
    others = [c for c in rows.columns if c != "claim_id"]
    merged = rows.withColumn("__content", content).groupBy("claim_id").agg(F.min("__content").alias("__lo"), F.max("__content").alias("__hi"), *[F.first(c).alias(c) for c in others])
    one = F.when(F.col("__lo") == F.col("__hi"), F.col("canonical_id")).otherwise(F.raise_error(F.concat(F.lit("different content under claim id "), F.col("claim_id"))))
    return merged.withColumn("canonical_id", one).select(*rows.columns)


_KEPT = ["claim_type", "semantics_json", "subject", "relation", "object", "polarity", "quantifier", "modality", "definition", "conditions", "objective", *SCOPE]


def classes(keyed_claims: DataFrame, group_col: str = "source_id") -> DataFrame:
    """One row per canonical claim with counts in place of lists: canonical_id,
    proposition (the smallest by normal form), n_members, n_sources and the
    semantics.  Every aggregate combines before the shuffle, however frequent a
    claim is; the members are the rows of ``keyed_claims``."""
    order = F.struct("norm", F.trim("proposition"), "claim_id")
    per_group = keyed_claims.groupBy("canonical_id", F.col(group_col).alias("g")).agg(
        F.min(order).alias("first"), F.count("*").alias("n"), F.min(F.struct("claim_id", F.struct("structured", *_KEPT).alias("s")))["s"].alias("s"), F.min("claim_id").alias("c")
    )
    merged = per_group.groupBy("canonical_id").agg(F.min("first")["col2"].alias("proposition"), F.sum("n").alias("n_members"), F.count("g").alias("n_sources"), F.min_by("s", "c").alias("s"))
    return merged.select("canonical_id", "proposition", "n_members", "n_sources", "s.*")


def key(canonical_id: Column) -> Column:
    """The hash of a canonical id in 32 bytes, to group by."""
    return F.unhex(F.substring(canonical_id, -64, 64))


def forms() -> list[Column]:
    """Type, normal forms and polarity: what the claims of a canonical claim have in common."""
    return [F.col("claim_type"), *[T.normalized(F.col(c)).alias(c) for c in ("subject", "relation", "object")], F.col("polarity")]


def tallies(keyed_claims: DataFrame, group_col: str = "source_id") -> DataFrame:
    """:func:`classes` with the :func:`forms` alone, and a proposition: what it
    shuffles per claim is a hash, the forms and the wording."""
    own = ("claim_type", "subject", "relation", "object", "polarity")
    rows = keyed_claims.select(key(F.col("canonical_id")).alias("k"), F.col(group_col).alias("g"), *forms(), F.struct("norm", F.trim("proposition").alias("raw")).alias("first"))
    per_group = rows.groupBy("k", "g", *own).agg(F.min("first").alias("first"), F.count("*").alias("n"))
    merged = per_group.groupBy("k", *own).agg(F.min("first")["raw"].alias("proposition"), F.sum("n").alias("n_members"), F.count("g").alias("n_sources"))
    return merged.select(*own, "n_members", "n_sources", "proposition")


def canonicalize(claims: DataFrame, group_col: str = "source_id", exact: bool = False) -> DataFrame:
    """Groups claims by type and full semantics (see :func:`keyed`).

    Returns canonical_id, claim_type, proposition, members, variants, sources and
    the semantics columns.  The lists make a row as long as its claim is
    frequent; :func:`keyed` and :func:`classes` hold the same as two tables.
    """
    rows = keyed(claims, exact)
    order = F.struct("norm", F.trim("proposition"), "claim_id")
    first = F.min_by(F.struct(*_KEPT), F.col("claim_id"))
    grouped = rows.groupBy("canonical_id").agg(
        first.alias("s"),
        F.min_by(F.trim("proposition"), order).alias("proposition"),
        F.array_sort(F.collect_set("claim_id")).alias("members"),
        F.transform(F.array_sort(F.collect_set(F.struct("norm", F.trim("proposition").alias("raw")))), lambda x: x["raw"]).alias("variants"),
        F.array_sort(F.collect_set(F.col(group_col).cast("string"))).alias("sources"),
    )
    return grouped.select("canonical_id", "proposition", "members", "variants", "sources", "s.*")
