"""Synthesis of the claim graph: assertions, topics, disputes, gaps, and the artifact of all of them."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veridock.functions import identity as J
from veridock.functions import text as T
from veridock.plans.components import connected_components

SUPPORT = ["agreement", "equivalent", "refinement", "support"]
OPPOSE = ["contradiction", "tension"]
CONDITIONAL = ["alternative", "conditional_disagreement", "qualification", "refinement"]
CONFLICT = ["alternative", "conditional_disagreement", "contradiction", "tension"]


RATIONALE = {
    "consensus": "Independent groups support it and nothing recorded opposes it; this is no measure of truth.",
    "contested": "A recorded conflict or a tension of definitions opposes it.",
    "conditional": "It holds under conditions, beside a recorded alternative, qualification or conditional disagreement.",
    "minority_view": "Fewer independent groups support it than an opposing position; it is kept, and no winner is chosen.",
    "unresolved": "What is recorded doesn't suffice for consensus, conflict or conditions.",
}
NOTES = ["Each assertion names its canonical and source claims, which lead to exact places.", "A status describes recorded relations; it is no measure of truth, confidence, evidence or prediction."]
NOTE_NO_GROUPS = "Independence of sources wasn't given, so neither consensus nor minority was inferred."
NOTE_UNMAPPED = "Consensus and minority were withheld where independence is only partly known."


def rationale(status: Column) -> Column:
    """Why an assertion has its status."""
    out = F.lit(None).cast("string")
    for name, text in RATIONALE.items():
        out = F.when(status == name, text).otherwise(out)
    return out


def incident(relations: DataFrame) -> DataFrame:
    """(id, other, relation_type) for both ends of every relation."""
    both = relations.select(F.col("l").alias("id"), F.col("r").alias("other"), "relation_type")
    return both.unionAll(relations.select(F.col("r").alias("id"), F.col("l").alias("other"), "relation_type"))


def condition_summary() -> F.Column:
    parts = F.transform("conditions", lambda c: F.concat(F.lit("context "), c["operator"], F.lit(" "), J.json_string(T.normalized(c["value"]))))
    extra = [F.when(F.col(c) != "", F.concat(F.lit(f"{label}: "), F.col(c))) for c, label in (("objective", "objective"), ("population", "population"), ("temporal_scope", "temporal scope"), ("time_horizon", "time horizon"))]
    return F.nullif(F.array_join(F.concat(F.array_sort(parts), F.array_compact(F.array(*extra))), "; "), F.lit(""))


def status(minority: Column, shared: Column) -> Column:
    """Status of a claim from its flags (opposed, conditional, open, clean), whether a
    position with more groups opposes it and whether two groups support it."""
    false = F.lit(False)
    return (
        F.when(F.coalesce("opposed", false), F.when(minority, "minority_view").otherwise("contested"))
        .when(F.coalesce("conditional", false), "conditional")
        .when(F.coalesce("open", false), "unresolved")
        .when(F.coalesce("clean", F.lit(True)) & shared, "consensus")
        .otherwise("unresolved")
    )


def kind_statuses(claims: DataFrame, relations: DataFrame, groups: DataFrame) -> DataFrame:
    """(canonical_id, status) as :func:`assertions` has it, from relations between kinds.

    ``claims`` are (canonical_id, no of its kind, members), ``groups`` as
    there.  A pair adds to counts and extremes alone, so that no list grows
    with the claims: two groups are different iff their smallest and largest
    numbers are.
    """
    numbered = groups.select("grp").where("grp IS NOT NULL").distinct().select("grp", F.row_number().over(Window.orderBy("grp")).alias("g"))
    members = claims.select("canonical_id", "no", F.explode("members").alias("claim_id"))
    mapped = members.join(groups.select("claim_id", "grp"), "claim_id", "left").join(numbered, "grp", "left")
    counted = mapped.groupBy("canonical_id", "no").agg((F.count("g") == F.count("*")).alias("mapped"), F.countDistinct("g").alias("groups"), F.min("g").alias("lo"), F.max("g").alias("hi"))
    per_kind = counted.groupBy("no").agg(F.bool_and("mapped").alias("mapped"), F.max(F.when(F.col("mapped"), F.col("groups"))).alias("groups"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    t = F.col("relation_type")
    end = lambda own, other: F.struct(F.col(own).alias("id"), F.col(other).alias("other"))
    ends = relations.select("relation_type", F.explode(F.array(end("l", "r"), end("r", "l"))).alias("e")).select("e.id", "e.other", "relation_type")
    near = ends.join(F.broadcast(per_kind.withColumnRenamed("no", "other")), "other")
    oppose, support = t.isin(OPPOSE), t.isin(SUPPORT)
    flags = near.groupBy("id").agg(
        F.bool_or(oppose).alias("opposed"), F.bool_or(t.isin(CONDITIONAL)).alias("conditional"), F.bool_or(t == "insufficient_information").alias("open"), F.bool_and(t.isin([*SUPPORT, "orthogonal"])).alias("clean"),
        F.bool_and(F.col("mapped") | ~oppose).alias("known"), F.max(F.when(oppose, F.col("groups"))).alias("largest"),
        F.bool_and(F.col("mapped") | ~support).alias("support_known"), F.min(F.when(support, F.col("lo"))).alias("support_lo"), F.max(F.when(support, F.col("hi"))).alias("support_hi"),
    )
    joined = counted.join(flags.withColumnRenamed("id", "no"), "no", "left")
    minority = F.col("known") & (F.col("groups") < F.col("largest")) & F.col("mapped")
    shared = F.col("mapped") & F.coalesce("support_known", F.lit(True)) & (F.least("lo", "support_lo") < F.greatest("hi", "support_hi"))
    return joined.select("canonical_id", status(minority, shared).alias("status"))


def assertions(claims: DataFrame, relations: DataFrame, groups: DataFrame | None = None) -> DataFrame:
    """One assertion per canonical claim: status, supporting and opposing members.

    ``groups`` maps (claim_id, grp) source claims to independent groups; a claim
    with any unmapped member has an unknown number of groups, which never
    counts as consensus.  Claims without relations stay, as unresolved.
    """
    members = claims.select("canonical_id", F.explode("members").alias("claim_id"))
    if groups is None:
        counted = claims.select("canonical_id", F.lit(None).cast("array<string>").alias("groups"))
    else:
        mapped = members.join(groups.select("claim_id", "grp"), "claim_id", "left").groupBy("canonical_id")
        counted = mapped.agg(F.when(F.count("grp") == F.count("*"), F.array_sort(F.collect_set("grp"))).alias("groups"))
    near = incident(relations).join(counted.withColumnRenamed("canonical_id", "other"), "other").join(claims.select(F.col("canonical_id").alias("other"), F.col("members").alias("other_members")), "other")
    t = F.col("relation_type")
    flags = near.groupBy("id").agg(
        F.bool_or(t.isin(OPPOSE)).alias("opposed"), F.bool_or(t.isin(CONDITIONAL)).alias("conditional"), F.bool_or(t == "insufficient_information").alias("open"),
        F.bool_and(t.isin([*SUPPORT, "orthogonal"])).alias("clean"),
        F.bool_and(F.col("groups").isNotNull() | ~t.isin(OPPOSE)).alias("known"),
        F.max(F.when(t.isin(OPPOSE), F.size("groups"))).alias("largest"),
        F.flatten(F.collect_list(F.when(t.isin(SUPPORT), F.col("other_members")))).alias("support"),
        F.flatten(F.collect_list(F.when(t.isin(OPPOSE), F.col("other_members")))).alias("oppose"),
        F.bool_and(F.col("groups").isNotNull() | ~t.isin(SUPPORT)).alias("support_known"),
        F.array_distinct(F.flatten(F.collect_list(F.when(t.isin(SUPPORT), F.col("groups"))))).alias("support_groups"),
    )
    joined = claims.join(counted, "canonical_id").join(flags.withColumnRenamed("id", "canonical_id"), "canonical_id", "left")
    none = F.array().cast("array<string>")
    all_groups = F.when(F.col("groups").isNotNull() & F.coalesce("support_known", F.lit(True)), F.array_union("groups", F.coalesce("support_groups", none)))
    minority = F.col("known") & (F.size("groups") < F.col("largest")) & F.col("groups").isNotNull()
    out = joined.withColumn("status", status(minority, F.size(all_groups) >= 2))
    support = F.array_sort(F.array_distinct(F.concat("members", F.coalesce("support", none))))
    oppose = F.array_sort(F.array_distinct(F.coalesce("oppose", none)))
    out = out.select("canonical_id", F.col("proposition").alias("text"), "status", support.alias("supporting"), oppose.alias("opposing"), F.when(F.col("status") == "conditional", condition_summary()).alias("condition_summary"))
    strings = lambda a: J.json_array(F.transform(a, J.json_string))
    payload = J.json_object(canonical_claim_ids=strings(F.array("canonical_id")), status=J.json_string(F.col("status")), supporting_source_claim_ids=strings("supporting"), opposing_source_claim_ids=strings("opposing"), condition_summary=J.json_string(F.col("condition_summary")))
    return out.withColumn("rationale", rationale(F.col("status"))).withColumn("assertion_id", J.stable_id("synthesis_assertion", payload))


def clusters(claims: DataFrame, relations: DataFrame, cut: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """(cluster_id, topic, canonical_ids, n_claims): connected components of the
    relation graph, isolated claims kept; the topic is the smallest subject,
    else the smallest proposition."""
    parts = connected_components(relations.select("l", "r"), cut, "l", "r")
    placed = claims.join(parts, claims["canonical_id"] == parts["node"], "left").withColumn("component", F.coalesce("component", "canonical_id"))
    subject = F.nullif(T.normalized(F.col("subject")), F.lit(""))
    grouped = placed.groupBy("component").agg(F.coalesce(F.min(subject), F.min(T.normalized(F.col("proposition")))).alias("topic"), F.array_sort(F.collect_set("canonical_id")).alias("canonical_ids"))
    payload = J.json_object(topic=J.json_string(F.col("topic")), canonical_claim_ids=J.json_array(F.transform("canonical_ids", J.json_string)))
    return grouped.select(J.stable_id("topic_cluster", payload).alias("cluster_id"), "topic", "canonical_ids", F.size("canonical_ids").cast("long").alias("n_claims"))


def clustered(clusters: DataFrame, assertions: DataFrame) -> DataFrame:
    """(cluster_id, assertion_id) of every topic: its claims' assertions."""
    held = clusters.select("cluster_id", F.explode("canonical_ids").alias("canonical_id"))
    return held.join(assertions.select("canonical_id", "assertion_id"), "canonical_id").select("cluster_id", "assertion_id")


def assumptions(left: Column, right: Column) -> tuple[Column, Column]:
    """Sorted normal forms of assumptions that two claims share, and of those that only one has."""
    none = F.array().cast("array<string>")
    l, r = (F.array_distinct(F.transform(F.coalesce(x, none), T.normalized)) for x in (left, right))  # noqa: E741
    return F.array_sort(F.array_intersect(l, r)), F.array_sort(F.array_union(F.array_except(l, r), F.array_except(r, l)))


def reconciliation(settled: Column, variables: Column) -> Column:
    """How positions that differ in their scope can both be applied; null for open conflicts."""
    named = F.when(F.size(variables) > 0, F.array_join(variables, ", ")).otherwise("recorded scope")
    return F.when(settled, F.concat(F.lit("Apply each position under its own conditions and objective; compare: "), named, F.lit(".")))


def described_disputes(relations: DataFrame, claims: DataFrame) -> DataFrame:
    """:func:`disputes` with topic, shared and differing assumptions, and reconciliation."""
    side = lambda c: claims.select(F.col("canonical_id").alias(c), F.col("assumptions").alias(f"{c}_assumptions"), F.nullif(T.normalized(F.col("subject")), F.lit("")).alias(f"{c}_subject"), T.normalized(F.col("proposition")).alias(f"{c}_text"))
    found = disputes(relations)
    rows = found.withColumn("a", F.col("positions")[0]).withColumn("b", F.col("positions")[1]).join(side("a"), "a").join(side("b"), "b")
    shared, differing = assumptions(F.col("a_assumptions"), F.col("b_assumptions"))
    topic = F.coalesce(F.array_min(F.array_compact(F.array("a_subject", "b_subject"))), F.least("a_text", "b_text"))
    settled = F.col("status") == "reconciled_conditionally"
    return rows.select(*found.columns, topic.alias("topic"), shared.alias("shared_assumptions"), differing.alias("differing_assumptions"), reconciliation(settled, F.col("key_variables")).alias("reconciliation"))


def conflicts(relations: DataFrame) -> DataFrame:
    """The conflicting relations, with conflict_type and status."""
    has = lambda *names: F.arrays_overlap("conflict_dimensions", F.array(*[F.lit(n) for n in names]))
    t = F.col("relation_type")
    kind = (
        F.when(t == "contradiction", "direct")
        .when(t == "conditional_disagreement", t)
        .when(has("definition"), "definition_mismatch")
        .when(has("objective"), "objective_mismatch")
        .when(has("population"), "population_mismatch")
        .when(has("temporal_scope", "time_horizon"), "temporal_mismatch")
        .when(t == "alternative", "scope_mismatch")
        .otherwise("unresolved")
    )
    settled = t.isin("alternative", "conditional_disagreement")
    return relations.where(t.isin(CONFLICT)).withColumn("conflict_type", kind).withColumn("status", F.when(settled, "reconciled_conditionally").otherwise("unresolved"))


def disputes(relations: DataFrame) -> DataFrame:
    """One dispute per conflicting relation: kind, key variables, status."""
    rows = conflicts(relations).withColumn("positions", F.array_sort(F.array("l", "r")))
    strings = lambda a: J.json_array(F.transform(a, J.json_string))
    payload = J.json_object(position_claim_ids=strings("positions"), conflict_type=J.json_string(F.col("conflict_type")), key_variables=strings("conflict_dimensions"))
    return rows.select(J.stable_id("dispute", payload).alias("dispute_id"), "positions", "conflict_type", F.col("conflict_dimensions").alias("key_variables"), "status")


def gaps(claims: DataFrame, relations: DataFrame) -> DataFrame:
    """Pairs whose scope is insufficient, and claims that nothing compares to."""
    open_pairs = relations.where("relation_type = 'insufficient_information'").select(F.lit("insufficient_scope").alias("kind"), F.array_sort(F.array("l", "r")).alias("claim_ids"))
    alone = claims.select("canonical_id").join(incident(relations).select(F.col("id").alias("canonical_id")), "canonical_id", "left_anti").select(F.lit("no_comparator").alias("kind"), F.array("canonical_id").alias("claim_ids"))
    payload = J.json_object(kind=J.json_string(F.col("kind")), claim_ids=J.json_array(F.transform("claim_ids", J.json_string)))
    return open_pairs.unionAll(alone).withColumn("gap_id", J.stable_id("synthesis_gap", payload)).dropDuplicates(["gap_id"])


@dataclass
class Synthesis:
    """The tables of one synthesis, its notes and its content-derived id."""

    id: str
    corpus_id: str
    assertions: DataFrame
    clusters: DataFrame
    members: DataFrame  # cluster_id, assertion_id
    disputes: DataFrame
    gaps: DataFrame
    notes: list[str]


def notes(members: DataFrame, groups: DataFrame | None) -> list[str]:
    """Coverage notes; ``members`` has the claim_id of every source claim."""
    if groups is None:
        return [*NOTES, NOTE_NO_GROUPS]
    unmapped = members.select("claim_id").join(groups.select("claim_id"), "claim_id", "left_anti").limit(1).count()
    return [*NOTES, NOTE_UNMAPPED] if unmapped else list(NOTES)


def _digest(ids: DataFrame, column: str) -> str:
    """A hash of a table's ids that doesn't depend on their order, without gathering them: the count,
    and sums of the halves of each id's SHA-256 modulo 2**61."""
    half = lambda k: F.conv(F.substring(F.sha2(column, 256), k, 15), 16, 10).cast("decimal(20,0)")
    r = ids.agg(F.count("*").alias("n"), *[F.coalesce(F.sum(half(k)), F.lit(0)).cast("decimal(38,0)").alias(f"s{k}") for k in (1, 16, 31, 46)]).first()
    return ":".join(str(int(x)) for x in r)


def synthesize(corpus_id: str, claims: DataFrame, source_claims: DataFrame, relations: DataFrame, cut: Callable[[DataFrame, str], DataFrame], groups: DataFrame | None = None) -> Synthesis:
    """Assertions, topics, disputes and gaps of a claim graph whose references have
    been checked, as one artifact.

    The tables are written by ``cut``.  The id depends on the corpus, the ids of
    all parts and the notes, whatever their order.  No groups and an empty table
    of groups give the same statuses and different notes.
    """
    from veridock.functions.identity import stable_text_id

    if not corpus_id.strip():
        raise ValueError("a synthesis needs a corpus id")
    problems = reference_problems(claims, source_claims, relations).limit(3).collect()
    if problems:
        raise ValueError("; ".join(f"{r.id}: {r.problem}" for r in problems))
    own = cut(assertions(claims, relations, groups), "assertions")
    topics = cut(clusters(claims, relations, cut), "clusters")
    conflicts, open_ends = cut(described_disputes(relations, claims), "disputes"), cut(gaps(claims, relations), "gaps")
    text = notes(claims.select(F.explode("members").alias("claim_id")), groups)
    identity = {
        "corpus_id": corpus_id, "topic_clusters": _digest(topics, "cluster_id"), "assertions": _digest(own, "assertion_id"),
        "disputes": _digest(conflicts, "dispute_id"), "gaps": _digest(open_ends, "gap_id"), "coverage_notes": text,
    }
    return Synthesis(stable_text_id("synthesis", identity), corpus_id, own, topics, clustered(topics, own), conflicts, open_ends, text)


def reference_problems(claims: DataFrame, source_claims: DataFrame, relations: DataFrame) -> DataFrame:
    """(id, problem): members without a source claim or span, relation ends and
    supports that don't exist."""
    known = source_claims.select("claim_id", ((F.col("end_offset") > F.col("start_offset")) & (F.col("start_offset") >= 0)).alias("placed"))
    members = claims.select(F.col("canonical_id").alias("id"), F.explode("members").alias("claim_id")).join(known, "claim_id", "left")
    bad = members.where(~F.coalesce("placed", F.lit(False))).select("id", F.when(F.col("placed").isNull(), F.concat(F.lit("no source claim "), F.col("claim_id"))).otherwise(F.concat(F.lit("no place of "), F.col("claim_id"))).alias("problem"))
    ends = relations.select(F.col("relation_id").alias("id"), F.explode(F.array("l", "r")).alias("canonical_id")).join(claims.select("canonical_id"), "canonical_id", "left_anti").select("id", F.concat(F.lit("no claim "), F.col("canonical_id")).alias("problem"))
    support = relations.select(F.col("relation_id").alias("id"), F.explode("supporting").alias("claim_id")).join(known.select("claim_id"), "claim_id", "left_anti").select("id", F.concat(F.lit("no source claim "), F.col("claim_id")).alias("problem"))
    return bad.unionAll(ends).unionAll(support)


def independent_groups(claims: DataFrame) -> DataFrame:
    """(claim_id, grp) from source claims, the source being the group."""
    return claims.select("claim_id", F.col("source_id").cast("string").alias("grp")).distinct()
