"""Compiles a synthesis into a folder of documents: a skill with its topics,
disputes, quick references, sources and lineage.

Every document is assembled from rows (path, place, line), so the order of
inputs doesn't matter and no document is built on the driver.  A document is
one text in the end; the budget of claims bounds it.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veridock.functions import identity as J
from veridock.functions import text as T
from veridock.operators import corpus, provenance, store, synthesis
from veridock.plans import render
from veridock.sources.artifacts import ArtifactStore, checksums

VERSION = "veridock-compiler-1"
LABELS = {"consensus": "Consensus", "conditional": "Conditional", "contested": "Contested", "minority_view": "Minority view", "unresolved": "Unresolved"}
RELATION_PATTERNS = ["alternative", "conditional_disagreement", "contradiction", "insufficient_information", "qualification", "refinement", "tension"]
PATH_RULE = r"(?:^|(?<=[\s(\"'`=]))(?:/(?:[\w.@+-]+/)*[\w.@+-]+|~/[\w./-]+|[A-Za-z]:\\[\w.\\ -]+|file:/\S+)"
OMITTED_PATH = "[absolute path omitted]"


def plain(text: Column, fallback: str = "[withheld: unsafe source text]") -> Column:
    """Text fit for a document, without mark-up escapes: no invisible characters,
    one line, no absolute paths, and withheld where it has the shape of an
    instruction."""
    clean = F.regexp_replace(T.collapse(T.sanitize(text)), PATH_RULE, OMITTED_PATH.replace("[", r"[").replace("$", r"\$"))
    return F.when(F.size(T.safety_rules(clean)) > 0, F.lit(fallback)).otherwise(clean)


def markdown(text: Column, fallback: str = "[withheld: unsafe source text]") -> Column:
    """:func:`plain` text with mark-up escaped."""
    return T.escape_markdown(plain(text, fallback))


def findings(texts: DataFrame) -> dict[str, Any]:
    """What :func:`plain` meets in a column of texts: rules, absolute paths, invisible characters."""
    t = F.col("text")
    r = texts.agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_set(T.safety_rules(T.collapse(T.sanitize(t))))))).alias("rules"),
        F.coalesce(F.sum(F.regexp_count(t, F.lit(PATH_RULE))), F.lit(0)).alias("paths"), F.coalesce(F.sum(T.removed_invisible(t)), F.lit(0)).alias("invisible"),
    ).first()
    return {"rules": list(r.rules), "paths": int(r.paths), "invisible": int(r.invisible)}


def conditions_of(claims: DataFrame, assertions: DataFrame) -> DataFrame:
    """(canonical_id, conditions): an assertion's summary and its claim's conditions,
    assumptions and scope, distinct and in this order."""
    stated = F.transform("conditions", lambda c: F.concat(F.lit("context "), F.replace(c["operator"], F.lit("_"), F.lit(" ")), F.lit(" "), plain(c["value"])))
    assumed = F.transform(F.coalesce("assumptions", F.array().cast("array<string>")), lambda a: F.concat(F.lit("Assumption: "), plain(a)))
    scope = [F.when(F.col(c) != "", F.concat(F.lit(f"{label}: "), plain(F.col(c)))) for c, label in (("objective", "Objective"), ("population", "Population"), ("geography", "Geography"), ("temporal_scope", "Temporal scope"), ("time_horizon", "Time horizon"))]
    rows = claims.join(assertions.select("canonical_id", "condition_summary"), "canonical_id")
    every = F.concat(F.array_compact(F.array(plain(F.col("condition_summary")))), stated, assumed, F.array_compact(F.array(*scope)))
    return rows.select("canonical_id", F.transform(F.array_distinct(every), T.escape_markdown).alias("conditions"))


def places(assertions: DataFrame, source_claims: DataFrame) -> DataFrame:
    """(canonical_id, role, claim_id, source_id, place) of every claim an assertion rests on."""
    own = source_claims.select("claim_id", F.col("source_id").cast("string").alias("source_id"), render.locator(markdown(F.col("section")), F.col("paragraph"), F.col("start_offset"), F.col("end_offset")).alias("place"))
    roles = [assertions.select("canonical_id", F.lit(role).alias("role"), F.explode(role).alias("claim_id")) for role in ("supporting", "opposing")]
    return roles[0].unionAll(roles[1]).join(own, "claim_id")


def _located(rows: DataFrame, *by: str) -> DataFrame:
    """The places of each group as one text, sorted."""
    shown = F.concat(T.escape_markdown(F.col("source_id")), F.lit(" ("), "place", F.lit(")"))
    sort = F.array_sort(F.collect_set(F.struct("source_id", "claim_id", shown.alias("shown"))))
    return rows.groupBy(*by).agg(F.array_join(F.transform(sort, lambda x: x["shown"]), "; ").alias("places"), F.array_join(F.array_sort(F.collect_set(T.escape_markdown(F.col("source_id")))), ", ").alias("sources"))


class _Document:
    """Rows (path, section, key, n, line) of all documents."""

    def __init__(self, spark: SparkSession):
        self.spark, self.fixed, self.tables = spark, [], []

    def say(self, path: str, section: int, *lines: str) -> None:
        self.fixed += [(path, section, "", n, line) for n, line in enumerate(lines)]

    def add(self, rows: DataFrame, path: str | Column, section: int | Column, key: Column, lines: Column) -> None:
        """``lines``, an array for each row, in a section, sorted by key."""
        at = F.lit(path) if isinstance(path, str) else path
        s = F.lit(section) if isinstance(section, int) else section
        self.tables.append(rows.select(at.alias("path"), s.cast("int").alias("section"), key.cast("string").alias("key"), F.posexplode(lines).alias("n", "line")))

    def texts(self) -> DataFrame:
        """(path, text, sha256)."""
        rows = self.spark.createDataFrame(self.fixed, "path string, section int, key string, n int, line string")
        rows = reduce(DataFrame.unionByName, self.tables, rows)
        body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("section", "key", "n", "line"))), lambda x: x["line"]), "\n")
        return rows.groupBy("path").agg(F.concat(F.rtrim(body), F.lit("\n")).alias("text")).withColumn("sha256", F.sha2("text", 256))


def _count(df: DataFrame) -> int:
    return df.limit(1).count()


def limitation_lines(source_claims: DataFrame, notes: list[str], seen: dict[str, Any]) -> list[str]:
    """Coverage notes and what safety rules removed."""
    bad = source_claims.where("review_status = 'rejected'")
    r = bad.agg(F.count("*").alias("n"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("safety_findings")))).alias("rules")).first()
    lines = [f"- {n}" for n in notes]
    if r.n:
        lines.append(f"- {r.n} rejected source claims were left out of all prose.")
    rules = sorted({*(r.rules or []), *seen["rules"]})
    if rules:
        lines.append("- Safety rules met: " + ", ".join(rules) + ".")
    if seen["paths"]:
        lines.append("- Absolute paths were left out.")
    if seen["invisible"]:
        lines.append("- Invisible characters were removed.")
    return lines or ["- Nothing else is known to be missing."]


def assertion_blocks(claims: DataFrame, assertions: DataFrame, source_claims: DataFrame, excluded: DataFrame) -> DataFrame:
    """Assertions with rendered (whether they may be), reasons, conditions, sources and ``block``, their lines."""
    held = places(assertions, source_claims)
    both = {role: _located(held.where(F.col("role") == role), "canonical_id") for role in ("supporting", "opposing")}
    rows = assertions.join(conditions_of(claims, assertions), "canonical_id").join(excluded, "assertion_id", "left")
    rows = rows.join(both["supporting"].withColumnsRenamed({"places": "supporting_places"}), "canonical_id", "left").join(both["opposing"].select("canonical_id", F.col("places").alias("opposing_places")), "canonical_id", "left")
    label = F.create_map(*[F.lit(x) for pair in LABELS.items() for x in pair])[F.col("status")]
    applies = F.when(F.size("conditions") > 0, F.concat(F.lit("  - Applies when: "), F.array_join("conditions", "; "))).when(F.col("status") == "conditional", F.lit("  - Applies when: the conditions are only partly recorded; review before use."))
    block = F.array_compact(F.array(
        F.concat(F.lit("- **"), label, F.lit(":** "), markdown(F.col("text"))), applies, F.concat(F.lit("  - Supporting sources: "), "supporting_places"), F.concat(F.lit("  - Opposing sources: "), "opposing_places"),
        F.concat(F.lit("  - Trace: assertion "), T.escape_markdown(F.col("assertion_id")), F.lit("; canonical claim "), T.escape_markdown(F.col("canonical_id"))), F.lit(""),
    ))
    return rows.withColumns({"rendered": F.col("reasons").isNull(), "label": label, "rank": render.status_rank(F.col("status")), "block": block})


def chapter_paths(clusters: DataFrame) -> DataFrame:
    """Topics with the path of their chapter: two digits or more by topic and id, and
    the topic's slug."""
    named = render.number_rows(clusters.withColumn("sort_topic", T.collapse(F.lower("topic"))).withColumn("slug", T.slug("topic")), ["sort_topic", "cluster_id"])
    digits = F.when(F.col("number") < 100, F.lpad(F.col("number").cast("string"), 2, "0")).otherwise(F.col("number").cast("string"))
    return named.select("cluster_id", "topic", "canonical_ids", F.concat(F.lit("chapters/"), digits, F.lit("-"), "slug", F.lit(".md")).alias("chapter"), "number")


def _json_list(rows: DataFrame, key: str, item: Column) -> str:
    """A JSON array of every row's object, sorted by key (one document)."""
    r = rows.agg(F.concat_ws(",", F.transform(F.array_sort(F.collect_list(F.struct(F.col(key).cast("string").alias("k"), J.escape_controls(item).alias("j")))), lambda x: x["j"])).alias("j")).first()
    return f"[{r.j}]"


def traceability(corpus_id: str, blocks: DataFrame, source_claims: DataFrame, claims: DataFrame, relations: DataFrame, s: synthesis.Synthesis, rendered_in: DataFrame) -> str:
    """The lineage of every assertion, rendered or not, as one JSON document."""
    strings = lambda a: J.json_array(F.transform(F.coalesce(a, F.array().cast("array<string>")), J.json_string))
    text, num = (lambda c: J.json_string(F.col(c).cast("string"))), (lambda c: J.json_number(F.col(c)))
    own = source_claims.select("claim_id", "source_id", "review_status", "section", "paragraph", "start_offset", "end_offset", "excerpt_checksum")
    roles = blocks.select("canonical_id", F.posexplode(F.array(F.struct(F.lit("supporting").alias("role"), F.col("supporting").alias("ids")), F.struct(F.lit("opposing").alias("role"), F.col("opposing").alias("ids")))).alias("n", "x"))
    used = roles.select("canonical_id", "n", "x.role", F.explode("x.ids").alias("claim_id")).join(own, "claim_id")
    locator = J.json_object(section=text("section"), paragraph=num("paragraph"), start_offset=num("start_offset"), end_offset=num("end_offset"), excerpt_checksum=text("excerpt_checksum"))
    one = J.json_object(role=text("role"), source_claim_id=text("claim_id"), source_record_id=text("source_id"), review_status=text("review_status"), verified=F.when(F.col("role") == "supporting", "true").otherwise("false"), locators=J.json_array(F.array(locator)))
    lists = used.groupBy("canonical_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "claim_id", one.alias("j")))), lambda x: x["j"]), ",").alias("claims"))
    rows = blocks.join(lists, "canonical_id", "left").join(rendered_in, "assertion_id", "left")
    item = J.json_object(
        assertion_id=text("assertion_id"), status=text("status"), rendered=F.col("rendered").cast("string"), rendered_text=J.json_string(F.when(F.col("rendered"), plain(F.col("text")))), exclusion_reasons=strings(F.col("reasons")),
        condition_summary=J.json_string(F.when(F.col("rendered"), plain(F.col("condition_summary")))), canonical_claim_ids=strings(F.array("canonical_id")), source_claims=F.concat(F.lit("["), F.coalesce("claims", F.lit("")), F.lit("]")), rendered_in=strings(F.col("paths")),
    )
    parts = {
        "assertions": _json_list(rows, "assertion_id", item),
        "canonical_claims": _json_list(claims, "canonical_id", J.json_object(canonical_claim_id=text("canonical_id"), claim_type=text("claim_type"), member_source_claim_ids=strings(F.col("members")))),
        "claim_relations": _json_list(relations, "relation_id", J.json_object(relation_id=text("relation_id"), left_claim_id=text("l"), right_claim_id=text("r"), relation_type=text("relation_type"), directionality=text("directionality"), conflict_dimensions=strings(F.col("conflict_dimensions")), supporting_source_claim_ids=strings(F.col("supporting")))),
        "disputes": _json_list(s.disputes, "dispute_id", J.json_object(dispute_id=text("dispute_id"), status=text("status"), conflict_type=text("conflict_type"), position_claim_ids=strings(F.col("positions")))),
        "gaps": _json_list(s.gaps, "gap_id", J.json_object(gap_id=text("gap_id"), related_claim_ids=strings(F.col("claim_ids")))),
        "topic_clusters": _json_list(s.clusters, "cluster_id", J.json_object(cluster_id=text("cluster_id"), topic=J.json_string(plain(F.col("topic"))), canonical_claim_ids=strings(F.col("canonical_ids")))),
    }
    fixed = {"schema_version": "1.0", "corpus_id": corpus_id, "synthesis_artifact_id": s.id}
    every = {k: J.canonical_dumps(v) for k, v in fixed.items()} | parts
    return "{" + ",".join(f'"{k}":{every[k]}' for k in sorted(every)) + "}\n"


def source_registry(manifest: dict[str, Any], sources: DataFrame) -> str:
    """Portable metadata and checksums of the sources, as one JSON document."""
    text = lambda c: J.json_string(plain(F.col(c).cast("string")))
    item = J.json_object(source_record_id=J.json_string(F.col("record_id")), source_id=J.json_string(F.col("source_id")), title=text("title"), media_type=text("media"), content_checksum=J.json_string(F.col("checksum")), extracted_text_checksum=J.json_string(F.sha2("text", 256)))
    entries = []
    for e in sorted(manifest["source_entries"], key=lambda e: e["source_id"]):
        ref = e["input_ref"]
        unsafe = ref.startswith(("/", "~", "\\")) or ref[1:3] in (":\\", ":/") or ".." in ref.replace("\\", "/").split("/") or ref.lower().startswith("file:")
        entries.append({"source_id": e["source_id"], "input_ref": None if unsafe else ref, "input_ref_omitted": unsafe, "media_type": e.get("media_type")})
    fixed = {"schema_version": "1.0", "corpus_id": manifest["id"], "corpus_name": manifest["name"], "manifest_created_at": manifest.get("created_at"), "manifest_sources": entries}
    every = {k: J.canonical_dumps(v) for k, v in fixed.items()} | {"source_records": _json_list(sources, "record_id", item)}
    return "{" + ",".join(f'"{k}":{every[k]}' for k in sorted(every)) + "}\n"


def documents(manifest: dict[str, Any], sources: DataFrame, source_claims: DataFrame, claims: DataFrame, relations: DataFrame, s: synthesis.Synthesis, limitations: list[str]) -> tuple[DataFrame, dict[str, str], DataFrame]:
    """(path, text, sha256) of the prose documents, the JSON documents by path, and
    the assertions' blocks."""
    from veridock.plans.scratch import materialise

    spark = claims.sparkSession
    blocks = materialise(assertion_blocks(claims, s.assertions, source_claims, corpus.exclusions(s.assertions, source_claims)), "blocks")
    shown = blocks.where("rendered")
    chapters = materialise(chapter_paths(s.clusters), "chapters")
    held = materialise(chapters.select("chapter", "cluster_id", F.explode("canonical_ids").alias("canonical_id")).join(blocks, "canonical_id"), "held")
    texts = reduce(DataFrame.unionAll, [
        sources.select(F.col("title").alias("text")), s.assertions.select("text"), s.assertions.select("condition_summary"), s.clusters.select("topic"), claims.select("definition"), claims.select("objective"),
        claims.select("population"), claims.select(F.explode("conditions.value")), claims.select(F.explode("assumptions")), spark.createDataFrame([(manifest["name"],)], "text string"),
    ])
    limits = limitation_lines(source_claims, [*s.notes, *limitations], findings(texts))
    safe_name = spark.range(1).select(markdown(F.lit(manifest["name"]), "Compiled corpus").alias("m"), plain(F.lit(manifest["name"]), "the compiled corpus").alias("p"), T.slug(F.lit(manifest["name"])).alias("s")).first()
    doc = _Document(spark)

    # topics
    doc.add(chapters, F.col("chapter"), 0, F.lit(""), F.array(F.concat(F.lit("# "), markdown(F.col("topic"))), F.lit(""), F.concat(F.lit("Topic `"), T.escape_markdown(F.col("cluster_id")), F.lit("`")), F.lit(""), F.lit("Read each item by its status; consensus is no measure of truth."), F.lit("")))
    own = held.where("rendered")
    doc.add(own.select("chapter", "rank", "label").distinct(), F.col("chapter"), F.col("rank") * 2 - 1, F.lit(""), F.array(F.concat(F.lit("## "), "label"), F.lit("")))
    doc.add(own, F.col("chapter"), F.col("rank") * 2, F.col("assertion_id"), F.col("block"))
    left_out = held.where("NOT rendered")
    doc.add(left_out.select("chapter").distinct(), F.col("chapter"), 90, F.lit(""), F.array(F.lit("## Left out"), F.lit(""), F.lit("These records are in the traceability map only:"), F.lit("")))
    listed = F.array(F.concat(F.lit("- `"), T.escape_markdown(F.col("assertion_id")), F.lit("` ("), F.array_join("reasons", ", "), F.lit(")")))
    doc.add(left_out, F.col("chapter"), 91, F.col("assertion_id"), listed)

    # entry document
    head = f"Guidance from {safe_name.p} with its evidence. Covers its topics, decision conditions, disputes and gaps."
    doc.say("SKILL.md", 0, "---", f"name: {safe_name.s}", "description: " + J.canonical_dumps(head), "---", "", f"# {safe_name.m}", "", "Repetition is no proof, and recorded dissent isn't settled here.", "", "## How to use it", "",
            "1. Scope and limits: [sources and method](chapters/00-sources-and-method.md).", "2. Open the topic that fits, and apply what has its conditions met.", "3. Before recommending anything, read [disputes and gaps](chapters/99-disputes-and-gaps.md).", "4. Places and lineage: [traceability](traceability.json).", "", "## Topics", "")
    doc.add(chapters, "SKILL.md", 1, F.lpad(F.col("number").cast("string"), 12, "0"), F.array(F.concat(F.lit("- ["), markdown(F.col("topic")), F.lit("]("), "chapter", F.lit(")"))))
    if not _count(chapters):
        doc.say("SKILL.md", 1, "- No topics were found; see the gaps.")
    doc.say("SKILL.md", 2, "", "## Quick references", "", "- [Cheatsheet](cheatsheet.md)", "- [Patterns](patterns.md)", "- [Glossary](glossary.md)", "- [Source registry](source-registry.json)", "- [Build manifest](build-manifest.json)")

    # sources and method
    path = "chapters/00-sources-and-method.md"
    doc.say(path, 0, "# Sources and method", "", f"Corpus `{manifest['id']}` ({safe_name.m}), by status and with evidence; no truth score is given, and nothing is predicted.", "", "## Sources", "", "| Record | Title | Type |", "| --- | --- | --- |")
    doc.add(sources, path, 1, F.col("record_id"), F.array(F.concat(F.lit("| "), T.escape_markdown(F.col("record_id")), F.lit(" | "), markdown(F.col("title"), "Withheld title"), F.lit(" | "), markdown(F.col("media")), F.lit(" |"))))
    doc.say(path, 2, "", "## Method", "", "1. Sources are read and their texts checksummed.", "2. Atomic claims are taken out with exact places.", "3. Equivalent claims are joined; variants and conditions are kept.", "4. Relations are classified; what can't be told stays open.", "5. Assertions get a status.", "6. Every assertion is traced to its places before anything is written.", "", "## Coverage and limits", "", *limits,
            "- The number of sources is no proof, and views that repeat each other aren't promoted.", "", "## Updating", "", "Add a source to the manifest and build again; sources that didn't change reuse their claims.")

    # disputes and gaps
    path = "chapters/99-disputes-and-gaps.md"
    doc.say(path, 0, "# Disputes and gaps", "", "More sources don't make a winner. Reconciliations hold under their conditions.", "", "# Disputes", "")
    spots = _located(s.disputes.select("dispute_id", F.explode("positions").alias("canonical_id")).join(claims.select("canonical_id", F.explode("members").alias("claim_id")), "canonical_id").join(places(s.assertions, source_claims).select("claim_id", "source_id", "place").distinct(), "claim_id"), "dispute_id")
    shown_list = lambda label, c: F.when(F.size(c) > 0, F.concat(F.lit(f"- {label}: "), F.array_join(F.transform(c, lambda x: markdown(x)), "; ")))
    d = s.disputes.join(spots, "dispute_id", "left")
    doc.add(d, path, 1, F.col("dispute_id"), F.array_compact(F.array(
        F.concat(F.lit("## "), markdown(F.col("topic"))), F.lit(""), F.concat(F.lit("- Dispute: `"), T.escape_markdown(F.col("dispute_id")), F.lit("`")), F.concat(F.lit("- Status: "), F.replace("status", F.lit("_"), F.lit(" "))), F.concat(F.lit("- Conflict: "), F.replace("conflict_type", F.lit("_"), F.lit(" "))),
        F.concat(F.lit("- Positions: "), F.array_join(F.transform("positions", T.escape_markdown), ", ")), shown_list("Shared assumptions", F.col("shared_assumptions")), shown_list("Differing assumptions", F.col("differing_assumptions")), shown_list("Key variables", F.col("key_variables")),
        F.concat(F.lit("- Reconciliation: "), markdown(F.col("reconciliation"))), F.concat(F.lit("- Places: "), "places"), F.lit(""),
    )))
    if not _count(s.disputes):
        doc.say(path, 1, "None was recorded.", "")
    doc.say(path, 2, "# Assertions without consensus", "")
    doubtful = shown.where(F.col("status").isin("contested", "minority_view", "unresolved"))
    doc.add(doubtful, path, 3, F.concat(F.lpad(F.col("rank").cast("string"), 2, "0"), "assertion_id"), F.col("block"))
    loose = shown.join(held.select("assertion_id").distinct(), "assertion_id", "left_anti").where(~F.col("status").isin("contested", "minority_view", "unresolved"))
    doc.add(loose.select(F.lit(1)).distinct(), path, 4, F.lit(""), F.array(F.lit("# Assertions without a topic"), F.lit("")))
    doc.add(loose, path, 5, F.concat(F.lpad(F.col("rank").cast("string"), 2, "0"), "assertion_id"), F.col("block"))
    doc.say(path, 6, "# Gaps", "")
    doc.add(s.gaps, path, 7, F.col("gap_id"), F.array(F.concat(F.lit("- **"), T.escape_markdown(F.col("gap_id")), F.lit(":** "), F.replace("kind", F.lit("_"), F.lit(" ")), F.lit("; claims "), F.array_join(F.transform("claim_ids", T.escape_markdown), ", "))))
    if not _count(s.gaps):
        doc.say(path, 7, "- None was recorded.")
    dropped = blocks.where("NOT rendered")
    doc.add(dropped.select(F.lit(1)).distinct(), path, 8, F.lit(""), F.array(F.lit(""), F.lit("# Left out"), F.lit("")))
    doc.add(dropped, path, 9, F.col("assertion_id"), listed)
    doc.say(path, 10, "", "# Limits of coverage", "", *limits)

    # glossary
    doc.say("glossary.md", 0, "# Glossary", "", "Definitions decide whether claims agree; different ones stay apart.", "")
    defined = claims.where("definition IS NOT NULL")
    if not _count(defined):
        doc.say("glossary.md", 1, "No definition was recorded.")
    term = T.normalized(F.col("definition"))
    doc.add(defined.select(term.alias("term")).distinct(), "glossary.md", 1, F.concat("term", F.lit("\u0000")), F.array(F.concat(F.lit("## "), markdown(F.col("term"))), F.lit("")))
    where = _located(places(s.assertions, source_claims).where("role = 'supporting'"), "canonical_id").select("canonical_id", "places")
    entry = F.concat(F.lit("- "), markdown(F.col("proposition")), F.lit(" (canonical claim `"), T.escape_markdown(F.col("canonical_id")), F.lit("`"), F.coalesce(F.concat(F.lit("; sources "), "places"), F.lit("")), F.lit(")"))
    doc.add(defined.join(where, "canonical_id", "left"), "glossary.md", 1, F.concat(term, F.lit("\u0001"), "canonical_id"), F.array(entry, F.lit("")))

    # patterns
    doc.say("patterns.md", 0, "# Patterns", "", "They hold under conditions.", "", "## Conditional assertions", "")
    conditional = shown.where((F.col("status") == "conditional") | (F.size("conditions") > 0))
    doc.add(conditional, "patterns.md", 1, F.concat(F.lpad(F.col("rank").cast("string"), 2, "0"), "assertion_id"), F.col("block"))
    if not _count(conditional):
        doc.say("patterns.md", 1, "None was found.", "")
    doc.say("patterns.md", 2, "## Relations", "")
    told = relations.where(F.col("relation_type").isin(RELATION_PATTERNS))
    doc.add(told, "patterns.md", 3, F.col("relation_id"), F.array_compact(F.array(
        F.concat(F.lit("- **"), F.replace("relation_type", F.lit("_"), F.lit(" ")), F.lit(":** `"), T.escape_markdown(F.col("l")), F.lit("` and `"), T.escape_markdown(F.col("r")), F.lit("`")), F.when(F.size("conflict_dimensions") > 0, F.concat(F.lit("  - Differ in: "), F.array_join("conflict_dimensions", "; "))),
    )))
    if not _count(told):
        doc.say("patterns.md", 3, "None was found.")

    # cheatsheet
    doc.say("cheatsheet.md", 0, "# Cheatsheet", "", "Check conditions and disputes before using an item.", "")
    doc.add(shown.select("rank", "label").distinct(), "cheatsheet.md", F.col("rank") * 2 - 1, F.lit(""), F.array(F.concat(F.lit("## "), "label"), F.lit("")))
    under = F.when(F.size("conditions") > 0, F.concat(F.lit(" (if: "), F.array_join("conditions", "; "), F.lit(")"))).otherwise("")
    doc.add(shown, "cheatsheet.md", F.col("rank") * 2, F.col("assertion_id"), F.array(F.concat(F.lit("- "), markdown(F.col("text")), under, F.lit(" [sources: "), F.coalesce("sources", F.lit("none")), F.lit("]"))))
    doc.say("cheatsheet.md", 90, "", "Minority views, open variables and limits: [disputes and gaps](chapters/99-disputes-and-gaps.md).")

    topic_paths = held.where("rendered").select("assertion_id", F.col("chapter").alias("path"))
    rendered_in = topic_paths.unionAll(doubtful.unionByName(loose).select("assertion_id", F.lit(path).alias("path"))).groupBy("assertion_id").agg(F.array_sort(F.collect_set("path")).alias("paths"))
    json = {"traceability.json": traceability(manifest["id"], blocks, source_claims, claims, relations, s, rendered_in), "source-registry.json": source_registry(manifest, sources)}
    return doc.texts(), json, blocks


def compile_skill(manifest: dict[str, Any], sources: DataFrame, source_claims: DataFrame, claims: DataFrame, relations: DataFrame, s: synthesis.Synthesis, out: ArtifactStore, configuration: str, clock: Callable[[], str], limitations: list[str] = ()) -> dict[str, Any]:
    """Writes ``skill/<slug>/`` and returns its build manifest, which is written last.

    References are checked first, and files that an earlier build wrote and this
    one doesn't go if they are unchanged; a changed one is an error before
    anything is written.
    """
    import hashlib
    import re

    if not re.fullmatch(r"[0-9a-fA-F]{64}", configuration):
        raise ValueError("a configuration hash is a SHA-256")
    if s.corpus_id != manifest["id"]:
        raise ValueError("the synthesis belongs to another corpus")
    traces = provenance.trace(s.assertions, claims, source_claims).where("source_id IS NOT NULL").select("canonical_id").distinct()
    lost = corpus.integrity(sources, source_claims, claims, relations, s, traces).limit(3).collect()
    if lost:
        raise ValueError("; ".join(f"{r.part} {r.id}: no {r.missing}" for r in lost))
    prose, json, blocks = documents(manifest, sources, source_claims, claims, relations, s, list(limitations))
    spark = claims.sparkSession
    root = "skill/" + spark.range(1).select(T.slug(F.lit(manifest["name"])).alias("s")).first().s
    named = prose.withColumn("path", F.concat(F.lit(f"{root}/"), "path"))
    texts = named.unionByName(spark.createDataFrame([(f"{root}/{p}", t, hashlib.sha256(t.encode()).hexdigest()) for p, t in json.items()], "path string, text string, sha256 string"))
    from veridock.plans.scratch import materialise

    texts = materialise(texts, "documents")
    marker = f"{root}/build-manifest.json"
    stale = None
    if out.exists(marker):
        before = out.read_json(marker)
        if before.get("corpus_id") == manifest["id"]:
            declared = spark.createDataFrame(sorted(before["output_checksums"].items()), "path string, sha256 string")
            stale = [r.path for r in render.stale_outputs(declared, texts, checksums(out, sorted(before["output_checksums"]))).collect()]
    written = out.write_documents(texts)
    for path in stale or []:
        out.delete(path)
    included = blocks.where("rendered").select("canonical_id")
    open_disputes = [r.dispute_id for r in s.disputes.where("status != 'reconciled_conditionally'").select("dispute_id").orderBy("dispute_id").toLocalIterator()]
    body = {"corpus_id": manifest["id"], "synthesis_artifact_id": s.id, "included_claims": synthesis._digest(included, "canonical_id"), "unresolved_dispute_ids": open_disputes, "compiler_version": VERSION, "configuration_hash": configuration.lower(), "output_checksums": written}
    build = {"id": J.stable_text_id("skill-build", body), **body, "generated_at": clock(), "domain_profile": manifest.get("domain_profile")}
    out.write_json(marker, build)
    return build


__all__ = ["compile_skill", "documents", "store"]
