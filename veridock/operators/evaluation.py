"""Rubric evaluation: weighted means over what was assessed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F



def evaluate(targets: DataFrame, rubric: DataFrame, assessments: DataFrame, target_type: str | None = None) -> DataFrame:
    """(target, aggregate_score, n_assessed, components) per target.

    ``rubric`` has (dimension_id, weight, missing_policy, minimum, maximum), ``assessments``
    (target, dimension_id, score, status).  A dimension without an assessment
    takes its policy: ``unknown`` and ``not_applicable`` count for nothing,
    ``fail`` is an error, as are scores outside the scale, repeated
    assessments and assessments of dimensions that the rubric lacks.  No
    weight left gives a null score, not 0.  With ``target_type``, a rubric for
    other targets (its column target_type) is refused.
    """
    if target_type is not None and "target_type" in rubric.columns and rubric.where(~F.col("target_type").eqNullSafe(target_type)).limit(1).count():
        raise ValueError(f"the rubric isn't for {target_type}")
    dims = rubric.select("dimension_id", "weight", "missing_policy", "minimum", "maximum")
    own = assessments.groupBy("target", "dimension_id").agg(F.count("*").alias("n"), F.max("score").alias("score"), F.max("status").alias("status"))
    # what was assessed, and per target what its dimensions' policies leave
    met = own.join(dims.withColumn("known", F.lit(True)), "dimension_id", "left")
    low, high = F.col("score") < F.col("minimum"), F.col("score") > F.col("maximum")
    wrong = (
        F.when(F.col("known").isNull(), "an assessment of an unknown dimension").when(F.col("n") > 1, "repeated assessment")
        .when((F.col("status") == "assessed") & F.coalesce(low | high, F.lit(False)), "score outside its scale").when((F.col("status") != "assessed") & (F.col("missing_policy") == "fail"), "a required assessment is missing")
    )
    used = F.when(wrong.isNotNull(), F.raise_error(wrong).cast("double")).when(F.col("status") == "assessed", F.col("score"))
    rows = met.withColumn("used", used).withColumn("w", F.when(F.col("used").isNotNull(), F.coalesce("weight", F.lit(1.0))))
    per = rows.groupBy("target").agg(
        F.sum(F.col("w") * F.col("used")).alias("sum"), F.sum("w").alias("w"), F.count("used").alias("assessed"), F.array_join(F.array_sort(F.collect_list(F.when(F.col("used").isNotNull(), F.col("dimension_id")))), ",").alias("parts"),
        F.count_if(F.col("missing_policy") == "fail").alias("required"),
    )
    required = dims.agg(F.count_if(F.col("missing_policy") == "fail").alias("r")).first().r
    out = targets.select("target").join(per, "target", "left")
    missing = F.coalesce("required", F.lit(0)) < required
    score = F.when(missing, F.raise_error(F.lit("a required assessment is missing")).cast("double")).otherwise(F.try_divide(F.col("sum"), F.nullif("w", F.lit(0.0))))
    return out.select("target", score.alias("aggregate_score"), F.coalesce("assessed", F.lit(0)).cast("long").alias("n_assessed"), F.coalesce("parts", F.lit("")).alias("components"))


def unknown_dimensions(rubric: DataFrame, assessments: DataFrame) -> DataFrame:
    """Assessments of dimensions that the rubric doesn't have."""
    return assessments.join(rubric.select("dimension_id"), "dimension_id", "left_anti")


def provenance_structure_rubric(spark) -> DataFrame:
    """Two dimensions weighted 0.6 and 0.4."""
    return spark.createDataFrame([("provenance", 0.6, "not_applicable", 0.0, 1.0), ("structure", 0.4, "unknown", 0.0, 1.0)], "dimension_id string, weight double, missing_policy string, minimum double, maximum double")


def structure_checks(assertions: DataFrame, clustered: DataFrame, disputes: DataFrame, relations: DataFrame, known_notes: list[str], notes: list[str]) -> DataFrame:
    """(name, passed): five checks of a synthesis's structure: assertions exist, all
    belong to a topic, every conflict has a dispute, disputes that aren't settled
    say so, and the notes on coverage are there."""
    conflicts = relations.where(F.col("relation_type").isin("alternative", "conditional_disagreement", "contradiction", "tension")).select(F.array_sort(F.array("l", "r")).alias("positions")).distinct()
    empty = lambda df: df.limit(1).count() == 0
    rows = [
        ("assertions exist", not empty(assertions)), ("assertions have topics", empty(assertions.join(clustered.select("assertion_id"), "assertion_id", "left_anti"))),
        ("conflicts have disputes", empty(conflicts.join(disputes.select("positions"), "positions", "left_anti"))), ("statuses are known", empty(disputes.where(~F.col("status").isin("reconciled_conditionally", "unresolved")))),
        ("coverage is noted", set(known_notes) <= set(notes)),
    ]
    return assertions.sparkSession.createDataFrame(rows, "name string, passed boolean")


def evaluate_synthesis(assertions: DataFrame, resolved: DataFrame, checks: DataFrame) -> DataFrame:
    """(provenance, structure, aggregate_score): resolved share of assertions (null
    without assertions), passed share of structural checks (name, passed), weighted.
    Resolved ids that no assertion has are refused."""
    if resolved.select("canonical_id").join(assertions.select("canonical_id"), "canonical_id", "left_anti").limit(1).count():
        raise ValueError("a resolved id isn't an assertion's")
    p = assertions.select("canonical_id").join(resolved.select("canonical_id", F.lit(1).alias("ok")).distinct(), "canonical_id", "left").agg(F.avg(F.coalesce("ok", F.lit(0))).alias("provenance"))
    s = checks.agg(F.avg(F.col("passed").cast("int")).alias("structure"))
    both = p.withColumn("one", F.lit(1)).join(s.withColumn("one", F.lit(1)), "one").drop("one")
    weight = F.when(F.col("provenance").isNotNull(), 0.6).otherwise(0.0) + F.when(F.col("structure").isNotNull(), 0.4).otherwise(0.0)
    total = F.coalesce(F.col("provenance") * 0.6, F.lit(0.0)) + F.coalesce(F.col("structure") * 0.4, F.lit(0.0))
    return both.withColumn("aggregate_score", F.try_divide(total, F.nullif(weight, F.lit(0.0))))
