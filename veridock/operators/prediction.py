"""Registered predictions: eligibility, registration, lifecycle, outcomes, scores, gates.

A spec row has spec_id, canonical_id, target_metric, rule, forecast, benchmark,
threshold, direction, cutoff, window_start, window_end, data_source, status and
version; an observation row has spec_id, observation_id, observed_at, value and
source.  Columns that a table lacks count as null, a missing status as frozen.
Categorical forecasts and outcomes are strings in forecast_label,
benchmark_label and label.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veridock.functions import identity as J

#: Spellings of comparison directions, after lower case, trimming, and ``_`` for ``-`` and blanks.
DIRECTIONS = {
    "gt": ["above", "exceeds", "greater_than", "more_than"],
    "ge": ["at_least", "at_or_above", "greater_than_or_equal", "greater_than_or_equal_to"],
    "lt": ["below", "less_than", "under"],
    "le": ["at_most", "at_or_below", "less_than_or_equal", "less_than_or_equal_to"],
    "eq": ["equal", "equal_to", "equals"],
    "ne": ["not_equal", "not_equal_to"],
}
RULES = ["absolute_error", "accuracy", "brier", "squared_error"]
#: (status, event) to the next status; all others are refused.
TRANSITIONS = {("draft", "freeze"): "frozen", ("frozen", "await"): "awaiting_outcome", ("awaiting_outcome", "resolve"): "resolved", ("frozen", "resolve"): "resolved", ("frozen", "void"): "unresolvable", ("awaiting_outcome", "void"): "unresolvable"}
UNPREDICTABLE = ["definitional", "normative", "procedural"]
#: Keys of an outcome that can bound it in time.
TIME_KEYS = ["deadline", "evaluation_window", "evaluation_window_end", "temporal_scope", "time_horizon", "window", "window_end"]
#: What a later version may change.
MATERIAL = ["benchmark", "cutoff", "data_source", "direction", "forecast", "population", "resolution_rule", "rule", "target_metric", "threshold", "unit", "window_end", "window_start"]
#: What a registration binds.
REGISTERED = ["canonical_id", "spec_id", "supersedes", "version", *MATERIAL]
SCORING_VERSION = "builtin-deterministic-v1"

_OPTIONAL = {
    "canonical_id": "string", "target_metric": "string", "population": "string", "unit": "string", "resolution_rule": "string", "supersedes": "string", "status_reason": "string", "status": "string",
    "version": "int", "forecast": "double", "benchmark": "double", "threshold": "double", "direction": "string", "forecast_label": "string", "benchmark_label": "string", "has_offset": "boolean", "registered_at": "timestamp",
}


def _full(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.lit(None).cast(_OPTIONAL.get(n, "string")) for n in names if n not in df.columns})


def _fail(message: str, kind: str = "boolean") -> Column:
    return F.raise_error(F.lit(message)).cast(kind)


def finite(x: Column) -> Column:
    """Whether a number is there and neither NaN nor infinite."""
    return F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))


def number(x: Column, name: str) -> Column:
    """The number; a missing, NaN or infinite one is refused."""
    return F.when(finite(x), x.cast("double")).otherwise(_fail(f"{name} must be a finite number", "double"))


def probability(x: Column, name: str) -> Column:
    """The number if it lies in [0, 1]; others are refused."""
    return F.when(finite(x) & x.between(0, 1), x.cast("double")).otherwise(_fail(f"{name} must be between 0 and 1", "double"))


def nonempty(text: Column) -> Column:
    """Whether a text is there and not blank."""
    return F.coalesce(F.trim(text) != "", F.lit(False))


def direction(raw: Column) -> Column:
    """Canonical direction of any known spelling, else null."""
    word = F.translate(F.lower(F.trim(raw)), "- ", "__")
    out = F.lit(None).cast("string")
    for name, spellings in DIRECTIONS.items():
        out = F.when(word.isin(spellings), name).otherwise(out)
    return out


def event(value: Column, threshold: Column, raw_direction: Column) -> Column:
    """1.0 or 0.0: whether an observed value meets the prediction.

    Without direction and threshold only the values 0 and 1 are outcomes.  One
    without the other, an unknown direction and numbers that aren't finite are
    refused.
    """
    d = direction(raw_direction)
    v, t = number(value, "an outcome"), number(threshold, "a threshold")
    hit = F.when(d == "gt", v > t).when(d == "ge", v >= t).when(d == "lt", v < t).when(d == "le", v <= t).when(d == "eq", v == t).when(d == "ne", v != t).otherwise(_fail("unsupported direction"))
    bare = F.when(value.isin(0.0, 1.0), value).otherwise(_fail("not a binary outcome", "double"))
    both, none = raw_direction.isNotNull() & threshold.isNotNull(), raw_direction.isNull() & threshold.isNull()
    return F.when(none, bare).when(both, hit.cast("double")).otherwise(_fail("direction and threshold belong together", "double"))


def scaled(threshold: Column, raw_direction: Column) -> Column:
    """Whether outcomes are measured against a threshold."""
    return threshold.isNotNull() | raw_direction.isNotNull()


def outcome(rule: Column, value: Column, threshold: Column, raw_direction: Column) -> Column:
    """The event of an observation, for the rules that need one (else null)."""
    return F.when((rule == "brier") | ((rule == "accuracy") & scaled(threshold, raw_direction)), event(value, threshold, raw_direction))


def loss(rule: Column, forecast: Column, value: Column, happened: Column, measured: Column, forecast_label: Column | None = None, label: Column | None = None) -> Column:
    """Score of one observation by rule; an unknown rule is refused.

    ``happened`` is its :func:`outcome`, ``measured`` whether that has a
    threshold.  Accuracy compares a probability of at least one half with the
    event, and anything but probabilities and binary outcomes by equality.
    """
    none = F.lit(None).cast("string")
    forecast_label, label = none if forecast_label is None else forecast_label, none if label is None else label
    error = F.when(finite(forecast) & finite(value), forecast - value).otherwise(_fail("an error needs two finite numbers", "double"))
    chance = F.when(finite(forecast) & forecast.between(0, 1), forecast).otherwise(_fail("a forecast must be between 0 and 1", "double"))
    binary = F.coalesce(finite(forecast) & forecast.between(0, 1) & value.isin(0.0, 1.0) & forecast_label.isNull() & label.isNull(), F.lit(False))
    said = F.when(measured, chance).when(binary, forecast) >= 0.5
    equal = F.coalesce(forecast_label, forecast.cast("string")).eqNullSafe(F.coalesce(label, value.cast("string")))
    right = F.when(measured | binary, said.cast("double") == F.when(measured, happened).otherwise(value)).otherwise(equal)
    return (
        F.when(rule == "brier", F.pow(chance - happened, 2))
        .when(rule == "absolute_error", F.abs(error))
        .when(rule == "squared_error", F.pow(error, 2))
        .when(rule == "accuracy", right.cast("double"))
        .otherwise(_fail("a scoring rule without a built-in scorer", "double"))
    )


def eligibility(claims: DataFrame, *keep: str) -> DataFrame:
    """(canonical_id, status, reasons): reasons, in order, why a claim can't be predicted,
    with the columns of ``claims`` to ``keep``.

    The metric is outcome_metric, else ``metric`` or ``target_metric`` of the map
    ``outcome``, and mustn't be blank; the time is time_horizon, temporal_scope
    or one of ``TIME_KEYS`` in the map.
    """
    have = _full(claims, "status", "review_status", "outcome_metric", "time_horizon", "temporal_scope")
    if "outcome" not in have.columns:
        have = have.withColumn("outcome", F.lit(None).cast("map<string,string>"))
    key = lambda k: F.nullif(F.try_element_at("outcome", F.lit(k)), F.lit(""))
    metric = F.coalesce(F.nullif("outcome_metric", F.lit("")), key("metric"), key("target_metric"))
    dated = F.coalesce(F.nullif("time_horizon", F.lit("")), F.nullif("temporal_scope", F.lit("")), *[F.nullif(key(k), F.lit("{}")) for k in TIME_KEYS])
    checks = [
        (F.col("claim_type").isin(UNPREDICTABLE), "claim_type"), (F.col("claim_type") == "historical_observation", "historical"),
        (F.coalesce("status", F.lit("")) == "deprecated", "deprecated"), (F.coalesce("review_status", F.lit("")) == "rejected", "rejected"),
        (~nonempty(metric), "no_metric"), (dated.isNull(), "no_time"),
    ]
    reasons = F.array_compact(F.array(*[F.when(test, F.lit(reason)) for test, reason in checks]))
    return have.select("canonical_id", F.when(F.size(reasons) == 0, "eligible").otherwise("ineligible").alias("status"), reasons.alias("reasons"), *keep)


def configuration_violations() -> Column:
    """Reasons, in order, why a spec can't be scored as it is configured."""
    c = F.col
    scaled = c("rule").isin("brier", "accuracy") & (c("direction").isNotNull() | c("threshold").isNotNull())
    chance = (c("rule") == "brier") | ((c("rule") == "accuracy") & scaled)
    error = c("rule").isin("absolute_error", "squared_error")
    share = lambda x: finite(c(x)) & c(x).between(0, 1)
    checks = [
        (c("rule") == "log_loss", "log_loss has no clipping policy"), (c("rule") == "custom", "custom rules need an external scorer"), (~c("rule").isin([*RULES, "log_loss", "custom"]) | c("rule").isNull(), "unknown rule"),
        (scaled & (c("direction").isNull() | c("threshold").isNull()), "direction and threshold belong together"), (scaled & c("direction").isNotNull() & direction(c("direction")).isNull(), "unsupported direction"),
        (scaled & c("threshold").isNotNull() & ~finite(c("threshold")), "threshold"), (chance & ~share("forecast"), "forecast is no probability"), (chance & c("benchmark").isNotNull() & ~share("benchmark"), "benchmark is no probability"),
        (error & ~finite(c("forecast")), "forecast"), (error & c("benchmark").isNotNull() & ~finite(c("benchmark")), "benchmark"),
    ]
    return F.array_compact(F.array(*[F.when(F.coalesce(test, F.lit(False)), F.lit(name)) for test, name in checks]))


def order_violations() -> Column:
    """Times of a spec in the wrong order: the cutoff must lie before its window, the
    window's start not after its end, the registration not after the cutoff."""
    c = F.col
    checks = [(c("cutoff") >= c("window_start"), "cutoff not before the window"), (c("window_start") > c("window_end"), "window ends before it starts"), (c("registered_at") > c("cutoff"), "registered after the cutoff")]
    return F.array_compact(F.array(*[F.when(F.coalesce(test, F.lit(False)), F.lit(name)) for test, name in checks]))


def content_hash(specs: DataFrame, fields: list[str] = REGISTERED) -> DataFrame:
    """Adds ``content_hash``: SHA-256 of the canonical JSON of the registered fields
    and the time of registration."""
    full = _full(specs, *fields, "registered_at")
    return full.withColumn("content_hash", F.sha2(J.json_object(**{f: J.json_string(F.col(f).cast("string")) for f in [*fields, "registered_at"]}), 256))


def freeze(specs: DataFrame, claims: DataFrame, registered_at: Column, strict: bool = True) -> DataFrame:
    """Drafts checked against their claims and registered: status ``frozen``,
    registered_at and content_hash.

    Refused are specs that aren't drafts or whose claim is missing, ineligible
    or has another metric, and those with a wrong configuration or order of
    times.  ``strict`` raises for them; else they keep their status, and the
    reasons are in ``violations``.
    """
    full = _full(specs, "status", "direction", "threshold", "benchmark", "target_metric", *MATERIAL, "supersedes", "version").withColumn("registered_at", registered_at.cast("timestamp"))
    metric = F.coalesce(F.nullif("outcome_metric", F.lit("")), F.lit(None)) if "outcome_metric" in claims.columns else F.lit(None).cast("string")
    judged = eligibility(claims).join(claims.select("canonical_id", metric.alias("claim_metric")), "canonical_id").select("canonical_id", F.col("reasons").alias("claim_reasons"), "claim_metric")
    joined = full.join(judged, "canonical_id", "left")
    own = F.array_compact(F.array(
        F.when(~F.col("status").eqNullSafe("draft"), F.lit("not a draft")), F.when(F.col("claim_reasons").isNull(), F.lit("no such claim")), F.when(F.size("claim_reasons") > 0, F.lit("ineligible claim")),
        F.when(F.col("claim_reasons").isNotNull() & ~F.col("target_metric").eqNullSafe(F.col("claim_metric")), F.lit("another metric than the claim's")),
    ))
    joined = joined.withColumn("violations", F.concat(own, configuration_violations(), order_violations())).drop("claim_reasons", "claim_metric")
    good = F.size("violations") == 0
    allowed = F.when(good, True).otherwise(F.raise_error(F.concat_ws("; ", F.col("spec_id"), "violations")).cast("boolean")) if strict else good
    out = content_hash(joined.withColumn("frozen", allowed))
    keep = lambda c: F.when(F.col("frozen"), F.col(c))
    return out.withColumn("status", F.when(F.col("frozen"), "frozen").otherwise(F.col("status"))).withColumn("registered_at", keep("registered_at")).withColumn("content_hash", keep("content_hash")).drop("frozen")


def new_versions(specs: DataFrame, changes: DataFrame) -> DataFrame:
    """Drafts that succeed registered specs.  ``changes`` has spec_id, new_id and any
    of ``MATERIAL`` (null: unchanged).  A draft's successor, a repeated id, an
    unknown spec and a version without a change are refused."""
    fields = [c for c in changes.columns if c not in ("spec_id", "new_id")]
    unknown = sorted(set(fields) - set(MATERIAL))
    if unknown or not fields:
        raise ValueError(f"can't change {unknown}" if unknown else "a version needs a change")
    new = changes.select(F.col("spec_id").alias("old_id"), "new_id", *[F.col(c).alias(f"new_{c}") for c in fields])
    full = _full(specs, "status", "version", "supersedes", "status_reason", "registered_at", "content_hash", *fields)
    joined = new.join(full, F.col("old_id") == F.col("spec_id"), "left")
    problem = F.when(F.col("spec_id").isNull(), "no such spec").when(F.col("status") == "draft", "a draft needs no successor").when(F.col("new_id") == F.col("old_id"), "a version needs an id of its own").when(F.coalesce(*[F.col(f"new_{c}").cast("string") for c in fields]).isNull(), "a version needs a change")
    ok = F.when(problem.isNull(), F.col("new_id")).otherwise(F.raise_error(problem))
    values = {c: F.coalesce(F.col(f"new_{c}"), F.col(c)) for c in fields} | {
        "supersedes": F.col("spec_id"), "spec_id": ok, "version": (F.coalesce("version", F.lit(1)) + 1).cast("int"), "status": F.lit("draft"),
        "status_reason": F.lit(None).cast("string"), "registered_at": F.lit(None).cast("timestamp"), "content_hash": F.lit(None).cast("string"),
    }
    return joined.select(*[values.get(c, F.col(c)).alias(c) for c in full.columns])


def advance(specs: DataFrame, events: DataFrame) -> DataFrame:
    """Next status of each spec for its event (spec_id, event, and optionally reason,
    which a void needs); an illegal step is refused."""
    step = F.lit(None).cast("string")
    for (status, name), target in TRANSITIONS.items():
        step = F.when((F.col("status") == status) & (F.col("event") == name), target).otherwise(step)
    given = _full(events, "reason").select("spec_id", "event", "reason")
    joined = _full(specs, "status_reason").join(given, "spec_id", "left")
    legal = F.when(F.col("event").isNull(), F.col("status")).otherwise(F.coalesce(step, F.raise_error(F.concat(F.lit("illegal step from "), F.col("status")))))
    return joined.withColumn("status_reason", F.when(F.col("event") == "void", F.col("reason")).otherwise(F.col("status_reason"))).withColumn("status", legal).drop("event", "reason")


def resolve(specs: DataFrame, observations: DataFrame) -> DataFrame:
    """Specs with at least one valid observation become ``resolved``; a spec without
    one, or in a status that can't be resolved, is refused."""
    valid = outcomes(specs, observations).where("reason IS NULL").select("spec_id").distinct().withColumn("seen", F.lit(True))
    legal = F.col("status").isin("frozen", "awaiting_outcome") & F.coalesce("seen", F.lit(False))
    return specs.join(valid, "spec_id", "left").withColumn("status", F.when(legal, "resolved").otherwise(F.raise_error(F.concat(F.lit("can't resolve "), F.col("spec_id"))))).drop("seen")


def has_offset(text: Column) -> Column:
    """Whether an ISO time names its offset from UTC.  Times that do and times that
    don't can't be compared."""
    return text.rlike(r"(?:[Zz]|[+-]\d{2}:?\d{2})$")


def outcomes(specs: DataFrame, observations: DataFrame) -> DataFrame:
    """Every observation with ``reason``, the first one why it may not count (null:
    it counts), and with the spec's columns.

    In order: the spec is a draft, unresolvable, or missing; the source isn't the
    registered one; times differ in notation (has_offset); the time lies before
    the cutoff or outside the window, whose ends belong to it; one id has
    several contents.
    """
    s = _full(specs, "status", "has_offset", *MATERIAL, "forecast_label", "benchmark_label")
    s = s.withColumn("known", F.lit(True)).withColumnRenamed("has_offset", "spec_offset")
    o = _full(observations, "label", "has_offset").withColumnRenamed("has_offset", "own_offset")
    content = F.xxhash64("observed_at", "value", "source", "label")
    conflicts = o.groupBy("spec_id", "observation_id").agg(F.min(content).alias("lo"), F.max(content).alias("hi")).where("lo != hi").select("spec_id", "observation_id", F.lit(True).alias("conflict"))
    joined = o.join(s, "spec_id", "left").join(conflicts, ["spec_id", "observation_id"], "left")
    c = F.col
    reason = (
        F.when(c("status") == "draft", "draft").when(c("status") == "unresolvable", "unresolvable").when(c("known").isNull(), "no_spec")
        .when(~c("source").eqNullSafe(c("data_source")), "source").when(c("own_offset") != c("spec_offset"), "time_notation")
        .when(c("observed_at") < c("cutoff"), "before_cutoff").when(~c("observed_at").between(c("window_start"), c("window_end")), "outside_window").when(c("conflict"), "conflict")
    )
    return joined.withColumn("reason", reason).drop("known", "conflict", "own_offset", "spec_offset")


def rejected_outcomes(specs: DataFrame, observations: DataFrame) -> DataFrame:
    """(spec_id, observation_id, reason) of the observations that may not count."""
    return outcomes(specs, observations).where("reason IS NOT NULL").select("spec_id", "observation_id", "reason").distinct()


def score(specs: DataFrame, observations: DataFrame, scored_at: Column | None = None, strict: bool = False) -> DataFrame:
    """(spec_id, metric, status, n, value, benchmark_value, standard_error, reason)
    for every spec.

    Valid observations count once by id (see :func:`outcomes`); with ``strict``
    any other one raises, else it is left out.  A spec without observations
    awaits its outcome, an unresolvable one gives its reason, and neither has
    numbers; one observation has no standard error.  A draft, and a score dated
    before an observation, are refused.
    """
    specs = _full(specs, "status", "status_reason", "benchmark_label", "forecast_label", "benchmark", "threshold", "direction")
    judged = outcomes(specs, observations)
    if strict:
        judged = judged.where(F.when(F.col("reason").isNull(), True).otherwise(F.raise_error(F.concat_ws(": ", "observation_id", "reason")).cast("boolean")))
    used = judged.where("reason IS NULL").dropDuplicates(["spec_id", "observation_id"])
    if scored_at is not None:
        used = used.where(F.when(scored_at.cast("timestamp") >= F.col("observed_at"), True).otherwise(_fail("scored before an observation")))
    used = used.withColumn("happened", outcome(F.col("rule"), F.col("value"), F.col("threshold"), F.col("direction")))
    one = lambda forecast: loss(F.col("rule"), F.col(forecast), F.col("value"), F.col("happened"), scaled(F.col("threshold"), F.col("direction")), F.col(f"{forecast}_label"), F.col("label"))
    known = F.col("benchmark").isNotNull() | F.col("benchmark_label").isNotNull()
    scored = used.withColumn("x", one("forecast")).withColumn("b", F.when(known, one("benchmark")))
    agg = scored.groupBy("spec_id").agg(F.count("*").alias("n"), F.avg("x").alias("v"), F.avg("b").alias("bv"), F.when(F.count("*") > 1, F.stddev_samp("x") / F.sqrt(F.count("*"))).alias("se"))
    out = specs.select("spec_id", "rule", F.col("status").alias("spec_status"), "status_reason").join(agg, "spec_id", "left")
    status = F.when(F.col("spec_status") == "draft", F.raise_error(F.lit("a draft can't be scored"))).when(F.col("spec_status") == "unresolvable", "unresolvable").when(F.col("n").isNull(), "awaiting_outcome").otherwise("resolved")
    reason = F.when(F.col("spec_status") == "unresolvable", F.col("status_reason")).when(F.col("n").isNull(), "no valid outcome observation")
    return out.select("spec_id", F.col("rule").alias("metric"), status.alias("status"), F.coalesce("n", F.lit(0)).cast("long").alias("n"), F.col("v").alias("value"), F.col("bv").alias("benchmark_value"), F.col("se").alias("standard_error"), reason.alias("reason"))


def score_ids(scores: DataFrame, used: DataFrame, scored_at: str, run_id: str, version: str = SCORING_VERSION) -> DataFrame:
    """Adds ``score_id``, the content-derived id of each score.  ``used`` has the
    (spec_id, observation_id) that counted; the id names them all, so that a
    spec's list is as long as its observations."""
    ids = used.select("spec_id", F.col("observation_id").cast("string").alias("o")).groupBy("spec_id").agg(F.array_sort(F.collect_set("o")).alias("ids"))
    joined = scores.join(ids, "spec_id", "left")
    listed = J.json_array(F.transform(F.coalesce("ids", F.array().cast("array<string>")), J.json_string))
    payload = J.json_object(prediction_spec_id=J.json_string(F.col("spec_id")), outcome_observation_ids=listed, status=J.json_string(F.col("status")), scored_at=J.json_string(F.lit(scored_at)), run_id=J.json_string(F.lit(run_id)), scoring_method_version=J.json_string(F.lit(version)))
    return joined.withColumn("score_id", J.stable_id("predictive-score", payload)).drop("ids")


def aggregate(scores: DataFrame, minimum: int = 30, *by: str) -> DataFrame:
    """Counts, and means and standard error over resolved specs; below ``minimum`` of
    them (of those with a benchmark, for its mean) only the counts.

    A group with several metrics or several scores of one spec is refused.
    """
    if minimum < 2:
        raise ValueError("the minimum is 2 at least")
    full = scores if "metric" in scores.columns else scores.withColumn("metric", F.lit(None).cast("string"))
    is_ = lambda s: F.col("status") == s
    ok = is_("resolved")
    value = F.when(ok, F.col("value"))
    per_spec = full.groupBy(*by, "spec_id").agg(F.count("*").alias("n_scores"), *[F.first(c).alias(c) for c in ("status", "metric", "value", "benchmark_value", "n")])
    agg = per_spec.groupBy(*by).agg(
        F.count("*").alias("specs"), F.count_if(ok).alias("resolved"), F.count_if(is_("awaiting_outcome")).alias("awaiting"), F.count_if(is_("unresolvable")).alias("unresolvable"),
        F.coalesce(F.sum(F.when(ok, F.col("n"))), F.lit(0)).alias("observations"), F.count_if(ok & F.col("benchmark_value").isNotNull()).alias("benchmarks"), F.max("metric").alias("metric"),
        F.avg(value).alias("m"), F.avg(F.when(ok, F.col("benchmark_value"))).alias("b"), (F.stddev_samp(value) / F.sqrt(F.count(value))).alias("se"),
        F.min("metric").alias("other_metric"), F.max("n_scores").alias("most"),
    )
    passed = F.col("resolved") >= minimum
    checked = F.when(F.col("most") > 1, _fail("several scores of one spec")).when(F.col("metric") != F.col("other_metric"), _fail("several metrics")).otherwise(passed)
    agg = agg.withColumn("gate_passed", checked)
    return agg.select(
        *by, "metric", F.when(F.col("gate_passed"), "aggregated").otherwise("insufficient_sample").alias("status"), "specs", "resolved", "awaiting", "unresolvable", "observations", "benchmarks",
        F.when(F.col("gate_passed"), F.col("m")).alias("mean_value"), F.when(F.col("gate_passed") & (F.col("benchmarks") >= minimum), F.col("b")).alias("mean_benchmark"),
        F.when(F.col("gate_passed"), F.col("se")).alias("standard_error"), "gate_passed",
    )


def latest(specs: DataFrame, key: str, version: str) -> DataFrame:
    """The newest version of each spec."""
    return specs.groupBy(key).agg(F.max_by(F.struct(*[c for c in specs.columns if c != key]), F.col(version)).alias("s")).select(key, "s.*")
