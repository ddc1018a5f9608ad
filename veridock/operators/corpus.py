"""Gates, run records and state of a corpus build, and the build itself."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veridock.functions import identity as J
from veridock.functions import text as T
from veridock.operators import canonical, claims, provenance, relations, store, synthesis
from veridock.plans.scratch import materialise
from veridock.sources.artifacts import ArtifactStore

VERSION = "veridock-corpus-1"
EXTRACTOR_VERSION = "veridock-claims-1"
MAX_CLAIMS = 100_000


class GateError(ValueError):
    """A build that would not be a synthesis of several sources."""


def eligible(source_claims: DataFrame) -> DataFrame:
    """Claims that may be synthesised: all but the rejected (instruction-shaped) ones."""
    return source_claims.where(F.coalesce("review_status", F.lit("")) != "rejected")


def claim_counts(source_claims: DataFrame) -> DataFrame:
    """(source_id, claims, rejected, eligible) of every source."""
    bad = F.coalesce("review_status", F.lit("")) == "rejected"
    return source_claims.groupBy("source_id").agg(F.count("*").alias("claims"), F.count_if(bad).alias("rejected"), F.count_if(~bad).alias("eligible"))


def gate(sources: DataFrame, source_claims: DataFrame, max_claims: int = MAX_CLAIMS) -> list[str]:
    """Limitations of a corpus; raises :class:`GateError` if fewer than two sources
    were read or have eligible claims, or there are too many claims."""
    read = sources.select("source_id").distinct().count()
    if read < 2:
        raise GateError("fewer than two sources were read")
    r = claim_counts(source_claims).agg(F.coalesce(F.sum("rejected"), F.lit(0)).alias("rejected"), F.coalesce(F.sum("claims"), F.lit(0)).alias("claims"), F.count_if(F.col("eligible") > 0).alias("sources")).first()
    if r.claims > max_claims:
        raise GateError(f"over budget: {r.claims} claims")
    if r.sources == 0:
        raise GateError("no eligible claims")
    if r.sources < 2:
        raise GateError("fewer than two sources have eligible claims")
    return [f"{r.rejected} source claims have the shape of instructions and were left out"] if r.rejected else []


def exclusions(assertions: DataFrame, source_claims: DataFrame) -> DataFrame:
    """(assertion_id, reasons) of assertions that aren't rendered: one that rests on a
    rejected claim, or whose text has the shape of an instruction."""
    used = assertions.select("assertion_id", F.explode(F.concat("supporting", "opposing")).alias("claim_id"))
    rejected = used.join(source_claims.where("review_status = 'rejected'").select("claim_id"), "claim_id", "left_semi").select("assertion_id", F.lit("rejected-source-claim").alias("reason"))
    unsafe = assertions.select("assertion_id", F.explode(T.safety_rules(F.col("text"))).alias("rule")).select("assertion_id", F.concat(F.lit("unsafe-synthesis-text:"), "rule").alias("reason"))
    return rejected.unionAll(unsafe).groupBy("assertion_id").agg(F.array_sort(F.collect_set("reason")).alias("reasons"))


def integrity(sources: DataFrame, source_claims: DataFrame, canonical_claims: DataFrame, rels: DataFrame, s: synthesis.Synthesis, traces: DataFrame) -> DataFrame:
    """(part, id, missing): every reference of a build that leads nowhere.

    Claims to sources, canonical claims and relations to claims, assertions,
    topics, disputes and gaps to what they name, and assertions without any
    place.
    """
    own = source_claims.select("claim_id")
    known = canonical_claims.select("canonical_id")

    def lost(part: str, rows: DataFrame, key: str, parent: DataFrame, parent_key: str) -> DataFrame:
        return store.orphans(rows, parent, key, parent_key).select(F.lit(part).alias("part"), F.col("id").cast("string").alias("id"), F.col(key).cast("string").alias("missing"))

    each = lambda df, ident, array, name: df.select(F.col(ident).alias("id"), F.explode(array).alias(name))
    positions = own.select(F.col("claim_id").alias("any")).unionAll(known.select("canonical_id"))
    parts = [
        lost("source claim", source_claims.select(F.col("claim_id").alias("id"), "source_id"), "source_id", sources, "source_id"),
        lost("canonical claim", each(canonical_claims, "canonical_id", "members", "claim_id"), "claim_id", own, "claim_id"),
        lost("relation", each(rels, "relation_id", F.array("l", "r"), "canonical_id"), "canonical_id", known, "canonical_id"),
        lost("relation", each(rels, "relation_id", "supporting", "claim_id"), "claim_id", own, "claim_id"),
        lost("assertion", s.assertions.select(F.col("assertion_id").alias("id"), "canonical_id"), "canonical_id", known, "canonical_id"),
        lost("assertion", each(s.assertions, "assertion_id", F.concat("supporting", "opposing"), "claim_id"), "claim_id", own, "claim_id"),
        lost("topic", each(s.clusters, "cluster_id", "canonical_ids", "canonical_id"), "canonical_id", known, "canonical_id"),
        lost("dispute", each(s.disputes, "dispute_id", "positions", "any"), "any", positions, "any"),
        lost("gap", each(s.gaps, "gap_id", "claim_ids", "any"), "any", positions, "any"),
        lost("trace", s.assertions.select(F.col("assertion_id").alias("id"), "canonical_id"), "canonical_id", traces, "canonical_id"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out


# -- runs, drift, caches --------------------------------------------------------


def configuration_hash(manifest: dict[str, Any], **versions: str) -> str:
    return J.stable_text_id("configuration", {"manifest": manifest, "version": VERSION, "extractor": EXTRACTOR_VERSION, **versions}).partition("_")[2]


def run_record(stage: str, configuration: str, inputs: str, clock: Callable[[], str], status: str = "completed", limitations: list[str] = ()) -> dict[str, Any]:
    """What a stage did: an id from its stage, configuration and inputs, and its time."""
    at = clock()
    return {"id": J.stable_text_id("run", {"stage": stage, "configuration": configuration, "inputs": inputs}), "stage": stage, "version": VERSION, "configuration_hash": configuration, "inputs": inputs, "started_at": at, "completed_at": at, "status": status, "limitations": list(limitations)}


def fingerprints(entries: DataFrame, files: DataFrame, root: str) -> DataFrame:
    """(source_id, fingerprint) of a manifest's entries: the content's checksum,
    ``missing``, or ``invalid-path``."""
    ref = F.regexp_replace(F.regexp_replace(F.col("path"), r"^file:/+", "/"), "^" + root.rstrip("/") + "/", "")
    sums = files.select(ref.alias("input_ref"), F.concat(F.lit("sha256:"), F.sha2("content", 256)).alias("sum"))
    safe = ~(T.is_absolute_ref(F.col("input_ref")) | F.col("input_ref").rlike(r"(^|[/\\])\.\.([/\\]|$)"))
    return entries.join(sums, "input_ref", "left").select("source_id", F.when(~safe, "invalid-path").otherwise(F.coalesce("sum", F.lit("missing"))).alias("fingerprint"))


def drifted(before: DataFrame, after: DataFrame) -> DataFrame:
    """(source_id, before, after) of sources that changed between two reads."""
    a, b = before.withColumnRenamed("fingerprint", "before"), after.withColumnRenamed("fingerprint", "after")
    return a.join(b, "source_id", "full_outer").where("NOT (before <=> after)")


def with_cache_key(sources: DataFrame, configuration: str) -> DataFrame:
    """Adds cache_key: a source's content and the configuration that read it."""
    return sources.withColumn("cache_key", F.concat(F.substring(F.sha2("record_id", 256), 1, 16), F.lit("-" + configuration[:16])))


def checkpoint(out: ArtifactStore, corpus_id: str, configuration: str, stage: str, clock: Callable[[], str], status: str = "in_progress") -> None:
    """Records how far a build has come, to resume or to inspect it."""
    out.write_json("artifacts/recovery-checkpoint.json", {"schema_version": "1.0", "corpus_id": corpus_id, "version": VERSION, "configuration_hash": configuration, "status": status, "last_completed_stage": stage, "updated_at": clock()})


def resume_from(out: ArtifactStore, configuration: str) -> str | None:
    """The last completed stage of an earlier run with the same configuration."""
    ref = "artifacts/recovery-checkpoint.json"
    state = out.read_json(ref) if out.exists(ref) else {}
    return state.get("last_completed_stage") if state.get("configuration_hash") == configuration else None


def cache_state(out: ArtifactStore, configuration: str, sources: DataFrame, reused: int, usage: dict[str, int]) -> None:
    out.write_json("artifacts/cache-state.json", {"schema_version": "1.0", "configuration_hash": configuration, "reused_sources": reused, "usage": usage, "sources": sources.count()})


def snapshot(corpus_id: str, canonical_claims: DataFrame, rels: DataFrame, run_id: str) -> dict[str, Any]:
    """The claim graph by the ids of its parts (counts and order-free digests)."""
    parts = {"claims": synthesis._digest(canonical_claims, "canonical_id"), "relations": synthesis._digest(rels, "relation_id")}
    return {"id": J.stable_text_id("claim-graph", {"corpus_id": corpus_id, **parts}), "corpus_id": corpus_id, "run_id": run_id, **parts}


@dataclass
class Build:
    """A finished build: its tables, records and summary."""

    sources: DataFrame
    source_claims: DataFrame
    canonical_claims: DataFrame
    relations: DataFrame
    synthesis: synthesis.Synthesis
    graph: dict[str, Any]
    manifest: dict[str, Any]
    runs: list[dict[str, Any]]
    limitations: list[str]
    summary: dict[str, int]


def build(spark: SparkSession, manifest: dict[str, Any], sources: DataFrame, out: ArtifactStore, clock: Callable[[], str], groups: DataFrame | None = None, prose: bool = False) -> Build:
    """A corpus from its read sources to the written skill.

    ``sources`` has source_id, record_id, title, media, checksum, text and error;
    those with an error are a limitation.  Sources whose record and configuration
    were built before reuse their claims.  Gates fail before anything is
    synthesised; every stage's table is written to ``out``, provenance and
    references are verified, and the build's manifest is written last.
    """
    from veridock.plans.compile import compile_skill

    configuration = configuration_hash(manifest)
    out.claim(manifest["id"], manifest)

    def cut(stage: str) -> Callable[[DataFrame, str], DataFrame]:
        def write(df: DataFrame, label: str) -> DataFrame:
            if label == "edges":  # rounds of connected components, not part of the build
                return materialise(df, label)
            out.write_ledger(f"artifacts/{stage}-{label}", df)
            return out.read_ledger(f"artifacts/{stage}-{label}")

        return write

    limitations = [f"{r.source_id}: {r.error}" for r in sources.where("text IS NULL").select("source_id", "error").orderBy("source_id").toLocalIterator()]
    read = cut("ingest")(with_cache_key(sources.where("text IS NOT NULL"), configuration), "sources")
    checkpoint(out, manifest["id"], configuration, "ingest", clock)
    ledger = "artifacts/claims-cache"
    if out.exists(ledger):
        cached = out.read_ledger(ledger)
        reuse, extract = store.incremental(cached.select("cache_key").distinct(), read, ["cache_key"])
        reused = reuse.count()
        fresh = claims.source_claims(extract, "source_id", "text", prose).join(read.select("source_id", "cache_key"), "source_id")
        own = cached.join(read.select("cache_key"), "cache_key", "left_semi").unionByName(fresh)
    else:
        reused, own = 0, claims.source_claims(read, "source_id", "text", prose).join(read.select("source_id", "cache_key"), "source_id")
    source_claims = cut("extract")(own, "source-claims")
    out.write_ledger(ledger, source_claims)
    checkpoint(out, manifest["id"], configuration, "extract", clock)
    limitations += gate(read, source_claims)
    active = eligible(source_claims)
    known = cut("normalize")(canonical.canonicalize(active), "canonical-claims")
    checkpoint(out, manifest["id"], configuration, "normalize", clock)
    f = relations.features(known)
    rels = cut("relate")(relations.classify(f, relations.candidates(f)), "relations")
    checkpoint(out, manifest["id"], configuration, "relate", clock)
    made = synthesis.synthesize(manifest["id"], known, active, rels, cut("synthesize"), groups)
    checkpoint(out, manifest["id"], configuration, "synthesize", clock)
    runs = [
        run_record("ingest", configuration, synthesis._digest(read, "record_id"), clock, "partial" if limitations else "completed", limitations), run_record("extract", configuration, synthesis._digest(read, "cache_key"), clock),
        run_record("normalize", configuration, synthesis._digest(active, "claim_id"), clock), run_record("relate", configuration, synthesis._digest(known, "canonical_id"), clock), run_record("synthesize", configuration, synthesis._digest(rels, "relation_id"), clock),
    ]
    graph = snapshot(manifest["id"], known, rels, runs[3]["id"])
    out.write_json("artifacts/claim-graph.json", graph)
    out.write_json("artifacts/runs.json", runs)
    wrong = provenance.verify_spans(active, read, "source_id", "text").where("verdict != 'ok'").limit(3).collect()
    if wrong:
        raise ValueError("; ".join(f"{r.claim_id}: {r.verdict}" for r in wrong))
    build_manifest = compile_skill(manifest, read, source_claims, known, rels, made, out, configuration, clock, limitations)
    usage = {"sources": read.count(), "source_claims": source_claims.count()}
    cache_state(out, configuration, read, reused, usage)
    checkpoint(out, manifest["id"], configuration, "compile", clock, "completed")
    summary = usage | {"canonical_claims": known.count(), "relations": rels.count(), "reused_sources": reused, "limitations": len(limitations)}
    return Build(read, source_claims, known, rels, made, graph, build_manifest, runs, limitations, summary)
