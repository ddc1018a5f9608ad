"""Relations between canonical claims: retrieval by blocking keys, scope, ladder."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veridock.functions import identity as J
from veridock.functions import text as T

NEGATIONS = ["never", "no", "none", "not", "without"]
UNIVERSAL = ["always", "all", "each", "every"]
NEGATIVE_UNIVERSAL = ["never", "no", "none"]
EXISTENTIAL = ["a", "an", "any", "some", "at least one"]
UP = ["above", "build", "gain", "greater", "higher", "improve", "increase", "outperform", "positive", "rise"]
DOWN = ["below", "decline", "decrease", "fall", "lower", "negative", "reduce", "underperform", "worsen"]
DECISIONS = ["comparative", "normative", "procedural"]
HEDGES = ["sometimes", "might", "may", "could", "can", "tends"]


def features(claims: DataFrame) -> DataFrame:
    """Per-claim normal forms, computed once before any pair is made."""
    n = lambda c: T.normalized(F.col(c))
    direction = n("outcome_direction")
    conditions = F.array_sort(F.array_distinct(F.transform("conditions", lambda c: F.concat_ws("\u0001", T.normalized(c["operator"]), T.normalized(c["value"])))))
    assumptions = F.array_sort(F.array_distinct(F.transform(F.coalesce("assumptions", F.array().cast("array<string>")), T.normalized)))
    neg = F.array(*[F.lit(w) for w in NEGATIONS])
    words = T.content_tokens(n("proposition"))
    return claims.select(
        F.col("canonical_id").alias("id"), F.col("claim_type").alias("type"), "members", "semantics_json", "polarity", n("proposition").alias("prop"),
        *[n(c).alias(c) for c in ("subject", "relation", "object", "quantifier", "modality", "definition", "objective", "population", "geography", "temporal_scope", "time_horizon")],
        n("outcome_metric").alias("metric"),
        F.when(direction.isin(UP), "positive").when(direction.isin(DOWN), "negative").otherwise(direction).alias("direction"),
        conditions.alias("conditions"), assumptions.alias("assumptions"),
        T.soft_keys(n("subject")).alias("subject_keys"), T.soft_keys(n("population")).alias("population_keys"), T.soft_keys(n("temporal_scope")).alias("temporal_keys"),
        F.arrays_overlap(words, neg).alias("denies"), F.array_except(words, neg).alias("others"), T.soft_keys(n("proposition")).alias("prop_keys"),
    )


def candidate_score(f: DataFrame, pairs: DataFrame) -> DataFrame:
    """``pairs`` with their score: 6 for one subject, else 3 for subjects that share a
    word softly; 3 for one relation and for one metric; 2 for one object and for
    wordings that share a word softly.  Pairs from 3 on are :func:`candidates`."""
    own = f.select("id", "subject", "relation", "metric", "object", "subject_keys", "prop_keys")
    side = lambda c: own.select(*[F.col(x).alias(f"{c}_{x}") for x in own.columns])
    d = pairs.join(side("l"), F.col("l") == F.col("l_id")).join(side("r"), F.col("r") == F.col("r_id"))
    same = lambda c: (F.col(f"l_{c}") == F.col(f"r_{c}")) & (F.col(f"l_{c}") != "")
    points = lambda test, n: F.when(F.coalesce(test, F.lit(False)), n).otherwise(0)
    subject = F.when(F.coalesce(same("subject"), F.lit(False)), 6).otherwise(points(F.arrays_overlap("l_subject_keys", "r_subject_keys"), 3))
    total = subject + points(same("relation"), 3) + points(same("metric"), 3) + points(F.col("l_object") == F.col("r_object"), 2) + points(F.arrays_overlap("l_prop_keys", "r_prop_keys"), 2)
    return d.select("l", "r", total.alias("score"))


def candidates(f: DataFrame) -> DataFrame:
    """(l, r) pairs of claims worth comparing, l < r.

    The score of subject, relation, metric, object and wording reaches its
    threshold exactly if the claims share a subject, a soft subject word, a
    relation, a metric, or an object together with a word: a union of
    equi-joins on those keys.  Keys that one claim holds are dropped first; a
    frequent key is an AQE skew join.  The result is as large as the hottest
    key's claims squared, by definition of the relation graph.
    """
    key = lambda tag, c: F.when(c.isNotNull() & (c != ""), F.concat(F.lit(tag), c))
    both = F.transform(F.when(F.col("object").isNotNull(), F.col("prop_keys")), lambda k: F.concat_ws("\u0001", F.lit("o"), F.col("object"), k))
    keys = F.concat(
        F.array(key("s", F.col("subject")), key("r", F.col("relation")), key("m", F.col("metric"))),
        F.transform("subject_keys", lambda k: F.concat(F.lit("k"), k)),
        F.coalesce(both, F.array().cast("array<string>")),
    )
    exploded = f.select("id", F.explode(F.array_distinct(F.array_compact(keys))).alias("key"))
    shared = exploded.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    held = exploded.join(shared, "key")
    return held.select("key", F.col("id").alias("l")).join(held.select("key", F.col("id").alias("r")), "key").where("l < r").select("l", "r").distinct()


def _one_sided(a: Column, b: Column) -> Column:
    return a.isNull() != b.isNull()


def _overlap(a: Column, b: Column, keys_a: Column, keys_b: Column) -> Column:
    return F.when(a.isNull() | b.isNull(), "unknown").when(a == b, "same").when(F.arrays_overlap(keys_a, keys_b), "partial").otherwise("disjoint")


def _any_of(*tests: Column) -> Column:
    return reduce(lambda a, b: a | b, [F.coalesce(t, F.lit(False)) for t in tests])


def _all_of(*tests: Column) -> Column:
    return reduce(lambda a, b: a & b, [F.coalesce(t, F.lit(False)) for t in tests])


def classify(f: DataFrame, pairs: DataFrame) -> DataFrame:
    """One relation per pair: type, direction, scope, conflict dimensions, support
    and a content-derived id.  The first rung that holds decides; where scope is
    missing on one side the answer is ``insufficient_information``."""
    d = judged(pairs.join(_side(f, "l"), F.col("l") == F.col("l_id")).join(_side(f, "r"), F.col("r") == F.col("r_id")))
    c = F.col
    strings = lambda a: J.json_array(F.transform(a, J.json_string))
    shown = lambda a: J.json_array(F.transform(a, lambda x: J.json_object(field=F.lit('"context"'), operator=J.json_string(F.split(x, "\u0001")[0]), value=J.json_string(F.split(x, "\u0001")[1]))))
    scope = J.json_object(
        term_definition_alignment=J.json_string(c("definition_alignment")), population_overlap=J.json_string(c("population_overlap")), temporal_overlap=J.json_string(c("temporal_overlap")),
        condition_overlap=J.json_string(c("condition_overlap")), objective_alignment=J.json_string(c("objective_alignment")),
        shared_conditions=shown("shared_conditions"), left_only_conditions=shown("left_only_conditions"), right_only_conditions=shown("right_only_conditions"),
    )
    payload = J.json_object(left_claim_id=J.json_string(c("l")), right_claim_id=J.json_string(c("r")), relation_type=J.json_string(c("relation_type")), directionality=J.json_string(c("directionality")), scope_analysis=scope, conflict_dimensions=strings("conflict_dimensions"))
    return J.with_stable_id(d, "relation_id", "claim_relation", payload).select(
        "relation_id", "l", "r", "relation_type", "directionality", "rung", "conflict_dimensions", "condition_overlap", "population_overlap", "temporal_overlap",
        F.col("definition_alignment"), "objective_alignment", F.array_sort(F.array_union("l_members", "r_members")).alias("supporting"),
    )


def _side(f: DataFrame, name: str) -> DataFrame:
    return f.select(*[F.col(c).alias(f"{name}_{c}") for c in f.columns])


def kinds(f: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(claims, kinds): ``f`` with the ``kind`` of each claim, and one row per kind with
    a number ``no``, its ``size`` and the features.  Claims of a kind have all
    features in common, so that any two claims relate as their kinds do."""
    own = [c for c in f.columns if c not in ("id", "members")]
    named = f.withColumn("kind", F.sha2(F.to_json(F.struct(*own)), 256))
    rows = named.groupBy("kind").agg(F.count("*").alias("size"), F.first(F.struct(*own)).alias("s"))
    return named, rows.select(F.monotonically_increasing_id().alias("no"), "kind", "size", "s.*")


def between_kinds(k: DataFrame, *more: str) -> DataFrame:
    """Relations between kinds (a written table): l and r are their numbers, l <= r,
    ``n`` is how many pairs of claims relate so, ``more`` names features of both
    sides to keep (as ``l_`` and ``r_``).  Those pairs are the same as
    :func:`candidates` followed by :func:`classify`, but for the direction.

    Every block of kinds meets every other; pairs are judged as they come and
    never stored, so only a block is in memory.
    """
    blocks = max(4, min(96, -(-k.count() // 1024)))
    rows = k.repartition(blocks)
    same = lambda c: F.coalesce((F.col(f"l_{c}") == F.col(f"r_{c}")) & (F.col(f"l_{c}") != ""), F.lit(False))
    share = lambda c: F.coalesce(F.arrays_overlap(f"l_{c}", f"r_{c}"), F.lit(False))
    worth = same("subject") | same("relation") | same("metric") | share("subject_keys") | (F.coalesce(F.col("l_object") == F.col("r_object"), F.lit(False)) & share("prop_keys"))
    apart = (F.col("l_no") < F.col("r_no")) | ((F.col("l_no") == F.col("r_no")) & (F.col("l_size") > 1))
    pairs = _side(rows, "l").hint("shuffle_replicate_nl").join(_side(rows, "r"), apart & worth)
    n = F.when(F.col("l_no") == F.col("r_no"), F.expr("l_size * (l_size - 1) div 2")).otherwise(F.col("l_size") * F.col("r_size"))
    return judged(pairs).select(
        F.col("l_no").alias("l"), F.col("r_no").alias("r"), n.alias("n"), "relation_type", "rung", "conflict_dimensions", "condition_overlap", "population_overlap", "temporal_overlap",
        "definition_alignment", "objective_alignment", *[f"{side}_{c}" for side in "lr" for c in more],
    )


def judged(d: DataFrame) -> DataFrame:
    """Adds scope, rung, relation type, direction and conflict dimensions to pairs of
    claims with their features (``l_`` and ``r_``)."""
    L, R = (lambda c: F.col(f"l_{c}")), (lambda c: F.col(f"r_{c}"))
    same = lambda c: L(c).isNotNull() & (L(c) != "") & L(c).eqNullSafe(R(c))
    within = lambda c, values: F.coalesce(c.isin(values), F.lit(False))

    core = same("subject") & same("relation")
    obj = L("object").eqNullSafe(R("object"))
    opposite = L("polarity").isin("positive", "negative") & R("polarity").isin("positive", "negative") & (L("polarity") != R("polarity"))
    differs = opposite | ~obj
    lq, rq = L("quantifier"), R("quantifier")
    counter = (
        F.when((within(lq, UNIVERSAL) & within(rq, EXISTENTIAL)) | (within(rq, UNIVERSAL) & within(lq, EXISTENTIAL)), differs)
        .when(within(lq, NEGATIVE_UNIVERSAL) & within(rq, EXISTENTIAL), R("polarity") != "negative")
        .when(within(rq, NEGATIVE_UNIVERSAL) & within(lq, EXISTENTIAL), L("polarity") != "negative")
        .otherwise(False)
    )
    outcomes = _all_of(L("metric") == R("metric"), L("direction") != R("direction"), L("direction").isin("positive", "negative"), R("direction").isin("positive", "negative"))
    both = F.size(F.array_intersect(L("others"), R("others")))
    union = F.size(L("others")) + F.size(R("others")) - both  # their words are distinct
    surface = (L("denies") != R("denies")) & (union > 0) & (both / F.greatest(union, F.lit(1)) >= 0.6)
    decision = L("type").isin(DECISIONS) | R("type").isin(DECISIONS)
    d = d.withColumns({"core": core, "obj": obj, "opposite": opposite, "counter": counter, "outcomes": outcomes, "surface": surface})
    c = F.col
    opp = F.when(~c("core"), c("outcomes") | c("surface")).otherwise((c("opposite") & c("obj")) | c("counter") | c("outcomes") | (~c("obj") & decision) | c("surface"))
    hedged = (within(L("modality"), HEDGES) | within(R("modality"), HEDGES)) & ~L("modality").eqNullSafe(R("modality"))
    direct = F.when(~c("core"), c("outcomes") | c("surface")).when(c("counter") | c("outcomes"), True).when(within(lq, EXISTENTIAL) & within(rq, EXISTENTIAL), False).when(hedged, False).otherwise((c("obj") & c("opposite")) | c("surface"))
    lc, rc = L("conditions"), R("conditions")
    empty = lambda x: F.size(x) == 0
    definition = F.when(L("definition").isNull() & R("definition").isNull(), "aligned").when(_one_sided(L("definition"), R("definition")), "unknown").when(same("definition"), "aligned").otherwise("divergent")
    objective = F.when(L("objective").isNull() & R("objective").isNull(), "aligned").when(_one_sided(L("objective"), R("objective")), "unknown").when(L("objective") == R("objective"), "aligned").otherwise("divergent")
    condition = F.when(lc == rc, "same").when(empty(lc) | empty(rc), "unknown").when(F.arrays_overlap(lc, rc), "partial").otherwise("disjoint")
    d = d.withColumns({
        "opp": opp, "direct": direct, "definition_alignment": definition, "objective_alignment": objective, "condition_overlap": condition,
        "population_overlap": _overlap(L("population"), R("population"), L("population_keys"), R("population_keys")),
        "temporal_overlap": _overlap(L("temporal_scope"), R("temporal_scope"), L("temporal_keys"), R("temporal_keys")),
        "shared_conditions": F.array_intersect(lc, rc), "left_only_conditions": F.array_except(lc, rc), "right_only_conditions": F.array_except(rc, lc),
    })
    types_equal = L("type") == R("type")
    material = ~_all_of(L("assumptions") == R("assumptions"), L("geography").eqNullSafe(R("geography")), L("time_horizon").eqNullSafe(R("time_horizon")), L("modality").eqNullSafe(R("modality")))
    apart = lambda name: c(name).isin("partial", "disjoint")
    known = [*UNIVERSAL, *NEGATIVE_UNIVERSAL, *EXISTENTIAL]
    foreign = lambda q: q.isNotNull() & ~within(q, known)
    both_differ = lambda name: _all_of(L(name).isNotNull(), R(name).isNotNull(), L(name) != R(name))
    missing = _any_of(_one_sided(L("definition"), R("definition")), empty(lc) != empty(rc), empty(L("assumptions")) != empty(R("assumptions")), _one_sided(L("geography"), R("geography")), decision & _one_sided(L("objective"), R("objective")))
    scoped = _any_of(apart("condition_overlap"), apart("population_overlap"), apart("temporal_overlap"), ~empty(L("assumptions")) & ~empty(R("assumptions")) & (L("assumptions") != R("assumptions")), both_differ("geography"), both_differ("time_horizon"))
    agree = c("core") & types_equal & c("obj") & (L("polarity") == R("polarity"))
    l_more, r_more = F.size("left_only_conditions") > 0, F.size("right_only_conditions") > 0
    rung = (
        F.when(types_equal & (L("semantics_json") == R("semantics_json")) & (L("prop") == R("prop")), 1)
        .when(c("opp") & ~types_equal, 2)
        .when(c("opp") & _any_of(*[_one_sided(L(x), R(x)) for x in ("population", "temporal_scope", "time_horizon")]), 3)
        .when(c("opp") & (foreign(lq) | foreign(rq)), 4)
        .when(c("opp") & missing, 5)
        .when(c("opp") & (c("definition_alignment") == "divergent"), 6)
        .when(c("objective_alignment") == "divergent", 7)
        .when(c("opp") & scoped, 8)
        .when(agree & (l_more != r_more), 9)
        .when(c("direct") & types_equal & (c("definition_alignment") == "aligned") & (c("condition_overlap") == "same") & (c("objective_alignment") == "aligned") & ~material, 10)
        .when(agree & ~material, 11)
        .when(same("subject") & L("relation").isNotNull() & R("relation").isNotNull() & (L("relation") != R("relation")) & ~c("opp"), 12)
        .when(c("core") & ~c("obj") & L("type").isin(DECISIONS) & R("type").isin(DECISIONS), 13)
        .otherwise(14)
    )
    names = ["equivalent", *["insufficient_information"] * 4, "tension", "alternative", "conditional_disagreement", "qualification", "contradiction", "agreement", "orthogonal", "alternative", "insufficient_information"]
    label = lambda test, name: F.when(F.coalesce(test, F.lit(False)), F.lit(name))
    unequal = lambda x: ~L(x).eqNullSafe(R(x))
    dimensions = F.array_compact(F.array(
        label(L("assumptions") != R("assumptions"), "assumptions"), label(~types_equal, "claim_type"), label(apart("condition_overlap"), "conditions"),
        label(c("definition_alignment") == "divergent", "definition"), label(unequal("geography"), "geography"), label(~c("obj"), "object_or_value"),
        label(c("objective_alignment") == "divergent", "objective"), label(c("outcomes"), "outcome_direction"), label(L("polarity") != R("polarity"), "polarity"),
        label(apart("population_overlap"), "population"), label(unequal("quantifier"), "quantifier"), label(apart("temporal_overlap"), "temporal_scope"), label(unequal("time_horizon"), "time_horizon"),
    ))
    d = d.withColumn("rung", rung).withColumn("conflict_dimensions", dimensions)
    d = d.withColumn("relation_type", F.element_at(F.array(*[F.lit(x) for x in names]), F.col("rung")))
    return d.withColumn("directionality", F.when(c("rung") == 9, F.when(l_more, "left_to_right").otherwise("right_to_left")).otherwise("symmetric"))


def override(relations: DataFrame, overrides: DataFrame) -> DataFrame:
    """Applies reviewed corrections (relation_id, new_type, reviewer, reason, at):
    the type is replaced under a new id, the former type is kept, and the review
    status becomes ``corrected``.  Corrections that change nothing are refused."""
    o = overrides.select("relation_id", "new_type", "reviewer", "reason", "at")
    joined = relations.join(o, "relation_id", "left")
    checked = F.when(F.col("new_type").isNull() | (F.col("new_type") != F.col("relation_type")), F.col("new_type")).otherwise(F.raise_error(F.lit("an override must change the type")))
    joined = joined.withColumn("new_type", checked)
    payload = J.json_object(prior=J.json_string(F.col("relation_id")), new_type=J.json_string(F.col("new_type")), reviewer=J.json_string(F.col("reviewer")), reason=J.json_string(F.col("reason")), at=J.json_string(F.col("at").cast("string")))
    changed = F.col("new_type").isNotNull()
    return (
        joined.withColumn("prior_relation_id", F.when(changed, F.col("relation_id")))
        .withColumn("prior_type", F.when(changed, F.col("relation_type")))
        .withColumn("relation_id", F.when(changed, J.stable_id("claim_relation_override", payload)).otherwise(F.col("relation_id")))
        .withColumn("relation_type", F.coalesce("new_type", "relation_type"))
        .withColumn("review_status", F.when(changed, "corrected").otherwise("unreviewed"))
        .drop("new_type")
    )
