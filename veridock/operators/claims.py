"""Claims out of text: lines, atomic sentences, semantics, identifiers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veridock.functions import identity as J
from veridock.functions import text as T
from veridock.functions.lines import lines

_SENTENCE = r"(?U)(?<=[.!?])[\s\x1c-\x1f]+(?=[A-Z0-9])"
_VERB = r"(?:should|must|may|can|will|is|are|[a-z]+s)"
_CLAUSE = r"(?iU),\s+(?:but|and)\s+(?=[A-Z][\p{L}\p{N}_ -]{1,60}\s+" + _VERB + r"\b)"
_BULLET = r"(?U)^\s*(?:[*+-]|\d+[.)])\s+(\S.*)$"
_EXPLICIT = r"(?iU)^\s*(?:assertion|claim)\s*:\s*(\S.*)$"
_NAME = r"[a-z][\p{L}\p{N}_-]*"
MODAL = r"(?iU)^(.+?)\s+(should|must|may|can|will|tends\s+to)\s+(not\s+)?(" + _NAME + r")\s+(.+)$"
COPULA = r"(?iU)^(.+?)\s+(is|are)\s+(not\s+)?(.+)$"
DESCRIPTIVE = r"(?iU)^(.+?)\s+(" + _NAME + r"(?:s|es))\s+(.+)$"
QUANTIFIERS = ("all", "some", "no", "most", "few")
CAUSAL = ("cause", "lead", "increase", "decrease", "reduce")


def marked_body(line: Column) -> Column:
    """Body of a bullet or an explicit claim line; null for other lines."""
    body = T.first_of(F.nullif(F.regexp_extract(line, _BULLET, 1), F.lit("")), F.nullif(F.regexp_extract(line, _EXPLICIT, 1), F.lit("")))
    return F.trim(body)


def atomic(body: Column) -> Column:
    """Atomic assertions of a claim line: sentences, then independent clauses, of three words at least."""
    clauses = F.flatten(F.transform(F.split(body, _SENTENCE), lambda s: F.split(s, _CLAUSE)))
    return F.filter(F.transform(clauses, lambda c: F.btrim(c, F.lit(" ,"))), lambda c: T.word_count(c) >= 3)


def sentences(docs: DataFrame, id_col: str, text_col: str, prose: bool = True) -> DataFrame:
    """(id, line_no, ord, assertion, start_offset, end_offset, paragraph, section).

    With ``prose`` every non-blank line is read as an explicit claim; else only
    bullets and lines that start with ``Claim:`` or ``Assertion:`` are.  An
    assertion lies in its document exactly at its offsets.
    """
    body = F.trim("line") if prose else marked_body(F.col("line"))
    found = lines(docs, id_col, text_col).withColumn("body", F.nullif(body, F.lit(""))).where("body IS NOT NULL")
    # each assertion is found from the end of the one before it
    places = F.expr(
        "aggregate(assertions, named_struct('at', 1, 'places', cast(array() as array<int>)), "
        "(acc, x) -> named_struct('at', locate(x, line, acc.at) + length(x), 'places', concat(acc.places, array(locate(x, line, acc.at)))), acc -> acc.places)"
    )
    split = found.withColumn("assertions", atomic(F.col("body"))).withColumn("places", places)
    rows = split.select("id", "line_no", "line", "start_offset", "paragraph", "section", F.posexplode(F.arrays_zip("assertions", "places")).alias("ord", "x"))
    start = F.col("start_offset") + F.col("x.places") - 1
    return rows.select("id", "line_no", "ord", F.col("x.assertions").alias("assertion"), start.alias("start_offset"), (start + F.length("x.assertions")).alias("end_offset"), "paragraph", "section")


def _groups(df: DataFrame, name: str, text: str, test: Column, pattern: str, n: int) -> DataFrame:
    """Adds the ``n`` groups (from 1) of a pattern that matches whole texts; null where
    it doesn't match.  Only texts that pass ``test`` are tried, once each."""
    marked = F.when(test, F.regexp_replace(text, pattern, "\u0001" + "\u0001".join(f"${k}" for k in range(1, n + 1))))
    return df.withColumn("__marked", marked).withColumn(name, F.when(F.startswith("__marked", F.lit("\u0001")), F.split("__marked", "\u0001"))).drop("__marked")


def semantics(df: DataFrame, proposition: str = "proposition", tidied: bool = False) -> DataFrame:
    """Adds claim_type, subject, relation, object, polarity, quantifier, modality,
    definition, conditions (operator and value) and objective.

    Each pattern is matched once, and only on texts that hold its key words.
    Control characters U+0001 in a proposition count as blanks.  ``tidied``
    propositions are those of :func:`text.tidy`: their only white space is the
    blank, so that patterns need no Unicode classes; the result is the same.
    """
    plain = (lambda pattern: pattern.replace(r"\s", " ")) if tidied else (lambda pattern: pattern)
    clean = T.tidy if not tidied else lambda c: F.when(c.contains("  "), T.tidy(c)).otherwise(T.tidy_words(c))
    low = lambda c: F.lower(clean(c))
    # key words stand between blanks; a text with a long s, which folds to an s, is always tried
    apart = lambda w: f" {w} " if tidied else w
    hint = lambda *words: reduce(lambda a, b: a | b, [F.col("__low").contains(w) for w in (*words, "ſ")])
    df = df.withColumn("__p", F.replace(proposition, F.lit("\u0001"), F.lit(" "))).withColumn("__low", F.lower("__p"))
    df = _groups(df, "__aim", "__p", hint("objective"), plain(r"(?iU)^(.*?)\s+if\s+(.+?)\s+is\s+the\s+objective$"), 2)
    df = df.withColumn("__w", F.when(F.col("__aim").isNotNull(), F.trim(F.col("__aim")[1])).otherwise(F.col("__p")))
    df = _groups(df, "__if", "__w", hint(apart("if")), plain(r"(?iU)^(.*?)\s+if\s+(.+)$"), 2)
    df = df.withColumn("__w", F.when(F.col("__if").isNotNull(), F.trim(F.col("__if")[1])).otherwise(F.col("__w")))
    df = _groups(df, "__mark", "__w", hint(*map(apart, ("when", "during", "under", "unless"))), plain(r"(?iU)^(.*?)\s+(when|during|under|unless)\s+(.+)$"), 3)
    df = df.withColumn("__w", F.when(F.col("__mark").isNotNull(), F.trim(F.col("__mark")[1])).otherwise(F.col("__w")))
    condition = lambda mark, value: F.struct(mark.alias("operator"), low(value).alias("value"))
    both = F.array(F.when(F.col("__if").isNotNull(), condition(F.lit("applies_when"), F.col("__if")[2])), F.when(F.col("__mark").isNotNull(), condition(F.concat(F.lit("applies_"), F.lower(F.col("__mark")[2])), F.col("__mark")[3])))
    df = df.withColumn("conditions", F.array_sort(F.array_compact(both))).withColumn("objective", low(F.col("__aim")[2]))
    definition = F.nullif(F.regexp_extract("__p", r"(?iU)\bunder\s+(?:an?\s+)?(.+?)\s+definition\b", 1), F.lit(""))
    df = df.withColumn("definition", F.when(F.col("__low").contains("definition"), low(definition)))
    w = F.col("__w")
    # all three forms as mark, subject, verb, negation, object, modality
    form = lambda mark, g, *at: F.array(F.lit(mark), *[F.lit(None).cast("string") if k is None else g[k] for k in at])
    df = _groups(df, "__m", "__w", hint(*map(apart, ("should", "must", "may", "can", "will", "tends"))), plain(MODAL), 5)
    df = _groups(df, "__c", "__w", F.col("__m").isNull() & hint(apart("is"), apart("are")), plain(COPULA), 4)
    df = _groups(df, "__d", "__w", F.col("__m").isNull() & F.col("__c").isNull() & (hint("s ") if tidied else w.rlike(r"(?iU)s\s")), plain(DESCRIPTIVE), 3)
    kind = F.when(F.col("__m").isNotNull(), form("modal", F.col("__m"), 1, 4, 3, 5, 2)).when(F.col("__c").isNotNull(), form("copula", F.col("__c"), 1, 2, 3, 4, None)).when(F.col("__d").isNotNull(), form("descriptive", F.col("__d"), 1, 2, None, 3, None))
    df = df.withColumn("__f", kind)
    f = lambda k: F.col("__f")[k]
    df = df.withColumn("subject", low(f(1))).withColumn("object", low(f(4)))
    df = df.withColumn("relation", F.when(f(0) == "copula", F.lower(f(2))).otherwise(T.lemma(f(2)))).withColumn("modality", T.collapse(F.lower(f(5))))
    negated = F.when(f(0).isin("modal", "copula"), f(3) != "").otherwise(w.rlike(r"(?iU)(?=n)\b(?:no|not|never)\b"))  # the first letter is tried before the costly \b
    df = df.withColumn("polarity", F.when(negated, "negative").otherwise("positive"))
    first = F.regexp_extract("subject", rf"(?iU)\b({'|'.join(QUANTIFIERS)})\b", 1)  # any of them; then the first in the list's order
    df = df.withColumn("quantifier", F.when(first != "", T.first_of(*[F.when(F.col("subject").rlike(rf"(?iU)\b{q}\b"), q) for q in QUANTIFIERS])))
    low_w = F.lower(w)
    base = F.when(f(0) == "modal", F.when(F.col("modality").isin("should", "must"), "normative").when(F.col("modality") == "will", "predictive").otherwise("descriptive"))
    base = base.when((f(0) == "copula") & (low_w.contains("defined as") | F.col("definition").isNotNull()), "definitional").otherwise("descriptive")
    causal = F.coalesce(F.col("relation").isin(*CAUSAL), F.lit(False)) | low_w.contains(" because ")
    return df.withColumn("claim_type", F.when(causal, "causal").otherwise(base)).drop("__p", "__aim", "__w", "__if", "__mark", "__m", "__c", "__d", "__f", "__low")


def source_claims(docs: DataFrame, id_col: str, text_col: str, prose: bool = True, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per claim with id, exact span, excerpt and checksum, semantics,
    safety findings, confidence and review status.  Instruction-shaped claims
    are kept but rejected, with confidence 0.  ``keep`` names columns of the
    document that its claims keep."""
    if keep:
        docs = docs.select(F.struct(F.col(id_col).alias("id"), *keep).alias("id"), F.col(text_col))
        rows = sentences(docs, "id", text_col, prose)
        rows = rows.select(F.col("id.id").alias("id"), *[F.col("id")[c].alias(c) for c in keep], *rows.columns[1:])
    else:
        rows = sentences(docs, id_col, text_col, prose)
    rows = rows.withColumn("proposition", T.tidy(F.col("assertion")))
    rows = semantics(rows, tidied=True)
    payload = J.json_object(source_id=J.json_string(F.col("id").cast("string")), start_offset=J.json_number(F.col("start_offset")), end_offset=J.json_number(F.col("end_offset")), proposition=J.json_string(F.lower("proposition")))
    findings = T.safety_rules(F.col("assertion"))
    rows = J.with_stable_id(rows, "claim_id", "source-claim", payload).withColumn("safety_findings", findings)
    short = F.length("assertion") <= 280
    hit = F.size("safety_findings") > 0
    return (
        rows.withColumn("excerpt", F.when(short, F.col("assertion")))
        .withColumn("excerpt_checksum", F.when(short, F.sha2("assertion", 256)))
        .withColumn("confidence", F.when(hit, 0.0).otherwise(0.72))
        .withColumn("review_status", F.when(hit, "rejected").otherwise("unreviewed"))
        .withColumnRenamed("id", "source_id")
    )
