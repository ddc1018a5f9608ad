import datetime as dt

import pytest
from pyspark.sql import functions as F

from veridock.functions import identity as J
from veridock.operators import evaluation, prediction, store

SPEC = "spec_id string, rule string, forecast double, benchmark double, threshold double, direction string, cutoff timestamp, window_start timestamp, window_end timestamp, data_source string"
OBS = "spec_id string, observation_id long, observed_at timestamp, value double, source string"
T0 = dt.datetime(2024, 1, 1)
DAY = dt.timedelta(days=1)


def spec(name, rule, forecast, benchmark):
    return (name, rule, forecast, benchmark, 10.0, "at least", T0, T0 + DAY, T0 + 2 * DAY, "src")


def test_scores(spark):
    specs = spark.createDataFrame([spec("b", "brier", 0.8, 0.5), spec("a", "absolute_error", 10.0, 9.0), spec("s", "squared_error", 10.0, 9.0), spec("c", "accuracy", 0.8, 0.2), spec("none", "brier", 0.5, None)], SPEC)
    obs = [("b", 1, T0 + DAY, 12.0, "src"), ("b", 1, T0 + DAY, 12.0, "src"), ("b", 2, T0 + 2 * DAY, 8.0, "src"), ("b", 3, T0 + 3 * DAY, 8.0, "src"), ("b", 4, T0 + DAY, 8.0, "other")]
    obs += [(n, k, T0 + DAY, v, "src") for n in "as" for k, v in ((1, 8.0), (2, 13.0))] + [("c", 1, T0 + DAY, 12.0, "src")]
    o = spark.createDataFrame(obs, OBS)
    got = {r.spec_id: r for r in prediction.score(specs, o).collect()}
    near = pytest.approx
    assert (got["b"].n, got["b"].value, got["b"].benchmark_value, got["b"].standard_error) == (2, near(0.34), near(0.25), near(0.30))
    assert (got["a"].value, got["a"].benchmark_value) == (2.5, 2.5) and (got["s"].value, got["s"].benchmark_value) == (6.5, 8.5)
    assert (got["c"].value, got["c"].benchmark_value, got["c"].standard_error) == (1.0, 0.0, None)
    assert (got["none"].status, got["none"].n, got["none"].value) == ("awaiting_outcome", 0, None)
    assert {(r.observation_id, r.reason) for r in prediction.rejected_outcomes(specs, o).collect()} == {(3, "outside_window"), (4, "source")}
    scores = prediction.score(specs, o)
    with pytest.raises(Exception, match="several metrics"):
        prediction.aggregate(scores, 30).collect()
    with pytest.raises(Exception, match="source|outside_window"):
        prediction.score(specs, o, strict=True).collect()
    with pytest.raises(Exception, match="scored before"):
        prediction.score(specs, o, F.lit(T0)).collect()
    assert prediction.score(specs, o, F.lit(T0 + 5 * DAY)).count() == 5


def test_aggregate(spark):
    rows = [(f"s{k}", "resolved", float(k), 1.0 if k < 2 else None, 2) for k in range(4)] + [("w", "awaiting_outcome", None, None, 0), ("u", "unresolvable", None, None, 0)]
    scores = spark.createDataFrame([("brier", *r) for r in rows], "metric string, spec_id string, status string, value double, benchmark_value double, n int")
    low, high = (prediction.aggregate(scores, k).first() for k in (5, 4))
    assert (low.status, low.resolved, low.awaiting, low.unresolvable, low.observations, low.benchmarks, low.mean_value, low.standard_error) == ("insufficient_sample", 4, 1, 1, 8, 2, None, None)
    assert (high.status, high.mean_value, high.mean_benchmark) == ("aggregated", 1.5, None)
    assert high.standard_error == pytest.approx((5 / 3) ** 0.5 / 2)
    assert prediction.aggregate(scores, 2).first().mean_benchmark == 1.0
    with pytest.raises(ValueError):
        prediction.aggregate(scores, 1)
    with pytest.raises(Exception, match="several scores"):
        prediction.aggregate(scores.unionAll(scores), 4).collect()
    ids = prediction.score_ids(scores, spark.createDataFrame([("s0", "b"), ("s0", "a")], "spec_id string, observation_id string"), "2024", "run")
    got = {r.spec_id: r.score_id for r in ids.collect()}
    import hashlib

    want = '{"prediction_spec_id":"s0","outcome_observation_ids":["a","b"],"status":"resolved","scored_at":"2024","run_id":"run","scoring_method_version":"builtin-deterministic-v1"}'
    import json

    canonical = json.dumps(json.loads(want), sort_keys=True, separators=(",", ":"))
    assert got["s0"] == "predictive-score_" + hashlib.sha256(canonical.encode()).hexdigest() and len(set(got.values())) == 6


def test_directions_and_events(spark):
    def one(value, threshold, direction):
        df = spark.createDataFrame([(value, threshold, direction)], "v double, t double, d string")
        return df.select(prediction.event(F.col("v"), F.col("t"), F.col("d")).alias("e")).first().e

    spelled = {"More than": (4, 5, 6), "at-or-above": (4, 5, 6), " UNDER ": (4, 5, 6), "at most": (4, 5, 6), "equal_to": (4, 5, 6), "not equal": (4, 5, 6)}
    want = {"More than": [0, 0, 1], "at-or-above": [0, 1, 1], " UNDER ": [1, 0, 0], "at most": [1, 1, 0], "equal_to": [0, 1, 0], "not equal": [1, 0, 1]}
    for d, values in spelled.items():
        assert [one(float(v), 5.0, d) for v in values] == want[d]
    assert one(1.0, None, None) == 1.0
    for bad in ((1.0, 5.0, "roughly"), (1.0, 5.0, None), (1.0, None, "above"), (float("nan"), 5.0, "above"), (0.5, None, None), (1.0, float("inf"), "above")):
        with pytest.raises(Exception, match="direction|finite|binary"):
            one(*bad)
    df = spark.createDataFrame([("accuracy", None, None, "rain", "rain"), ("accuracy", None, None, "rain", "sun"), ("accuracy", 0.7, 1.0, None, None), ("accuracy", 3.0, 3.0, None, None)], "r string, f double, v double, fl string, l string")
    got = [r.x for r in df.select(prediction.loss(F.col("r"), F.col("f"), F.col("v"), F.lit(None).cast("double"), F.lit(False), F.col("fl"), F.col("l")).alias("x")).collect()]
    assert got == [1.0, 0.0, 1.0, 1.0]
    with pytest.raises(Exception, match="between 0 and 1"):
        prediction.score(spark.createDataFrame([spec("b", "brier", 1.7, 0.5)], SPEC), spark.createDataFrame([("b", 1, T0 + DAY, 12.0, "src")], OBS)).collect()


CLAIMS = "canonical_id string, claim_type string, outcome_metric string, time_horizon string, status string, outcome map<string,string>"


def test_eligibility_reasons(spark):
    rows = [
        ("a", "historical_observation", "m", "2025", None, None), ("b", "predictive", "  ", "2025", None, None), ("c", "predictive", None, None, "deprecated", {"target_metric": "m", "deadline": "2025"}),
        ("d", "predictive", "m", None, None, {"window": "{}"}), ("e", "predictive", "m", "", None, {"window_end": "2025"}), ("f", "procedural", None, None, None, None),
    ]
    got = {r.canonical_id: r.reasons for r in prediction.eligibility(spark.createDataFrame(rows, CLAIMS)).collect()}
    assert got == {"a": ["historical"], "b": ["no_metric"], "c": ["deprecated"], "d": ["no_time"], "e": [], "f": ["claim_type", "no_metric", "no_time"]}


def test_registration(spark):
    claims = spark.createDataFrame([("k", "predictive", "m", "2025", None, None), ("old", "historical_observation", "m", "2025", None, None)], CLAIMS)
    columns = SPEC + ", status string, canonical_id string, target_metric string, version int"
    make = lambda name, status="draft", claim="k", metric="m", rule="brier", forecast=0.8, direction="at least": (*spec(name, rule, forecast, 0.5)[:5], direction, *spec(name, rule, forecast, 0.5)[6:], status, claim, metric, 1)
    rows = [make("ok"), make("done", status="frozen"), make("none", claim="zz"), make("hist", claim="old"), make("metric", metric="x"), make("log", rule="log_loss"), make("p", forecast=1.5), make("d", direction="roughly"), make("half", direction=None)]
    specs = spark.createDataFrame(rows, columns)
    out = {r.spec_id: r for r in prediction.freeze(specs, claims, F.lit(T0 - DAY), strict=False).collect()}
    assert {k: r.violations for k, r in out.items()} == {
        "ok": [], "done": ["not a draft"], "none": ["no such claim"], "hist": ["ineligible claim"], "metric": ["another metric than the claim's"], "log": ["log_loss has no clipping policy"],
        "p": ["forecast is no probability"], "d": ["unsupported direction"], "half": ["direction and threshold belong together"],
    }
    assert out["ok"].status == "frozen" and len(out["ok"].content_hash) == 64 and out["d"].status == "draft" and out["d"].content_hash is None
    late = prediction.freeze(specs.where("spec_id = 'ok'"), claims, F.lit(T0 + DAY), strict=False).first()
    assert late.violations == ["registered after the cutoff"]
    with pytest.raises(Exception, match="ineligible"):
        prediction.freeze(specs.where("spec_id = 'hist'"), claims, F.lit(T0)).collect()
    frozen = prediction.freeze(specs.where("spec_id = 'ok'"), claims, F.lit(T0 - DAY)).drop("violations")
    new = prediction.new_versions(frozen, spark.createDataFrame([("ok", "ok2", 0.9)], "spec_id string, new_id string, forecast double")).first()
    assert (new.spec_id, new.supersedes, new.version, new.status, new.forecast, new.threshold, new.content_hash, new.registered_at) == ("ok2", "ok", 2, "draft", 0.9, 10.0, None, None)
    for bad, problem in ((("ok", "ok", 0.9), "own"), (("ok", "n", None), "change"), (("zz", "n", 0.1), "no such")):
        with pytest.raises(Exception, match=problem):
            prediction.new_versions(frozen, spark.createDataFrame([bad], "spec_id string, new_id string, forecast double")).collect()
    with pytest.raises(ValueError):
        prediction.new_versions(frozen, spark.createDataFrame([("ok", "n", "x")], "spec_id string, new_id string, owner string"))


def test_outcome_reasons(spark):
    specs = spark.createDataFrame([(*spec("s", "brier", 0.8, None), "frozen", True), (*spec("d", "brier", 0.8, None), "draft", True), (*spec("u", "brier", 0.8, None), "unresolvable", True)], SPEC + ", status string, has_offset boolean")
    at = T0 + DAY
    rows = [("s", 1, at, 1.0, "src", True), ("s", 2, at, 1.0, "x", True), ("s", 3, at, 1.0, "src", False), ("s", 4, T0 - DAY, 1.0, "src", True), ("s", 5, T0 + 9 * DAY, 1.0, "src", True), ("s", 6, at, 1.0, "src", True), ("s", 6, at, 2.0, "src", True), ("d", 7, at, 1.0, "src", True), ("u", 8, at, 1.0, "src", True), ("q", 9, at, 1.0, "src", True)]
    o = spark.createDataFrame(rows, OBS + ", has_offset boolean")
    got = {r.observation_id: r.reason for r in prediction.rejected_outcomes(specs, o).collect()}
    assert got == {2: "source", 3: "time_notation", 4: "before_cutoff", 5: "outside_window", 6: "conflict", 7: "draft", 8: "unresolvable", 9: "no_spec"}
    offsets = spark.createDataFrame([("2024-01-01T00:00:00Z",), ("2024-01-01T00:00:00+02:00",), ("2024-01-01T00:00:00",)], "t string")
    assert [r.h for r in offsets.select(prediction.has_offset(F.col("t")).alias("h")).collect()] == [True, True, False]
    assert {r.spec_id: (r.status, r.reason) for r in prediction.score(specs.where("status != 'draft'"), o).collect()}["u"] == ("unresolvable", None)
    assert prediction.resolve(specs.where("spec_id = 's'"), o).first().status == "resolved"
    with pytest.raises(Exception, match="can't resolve"):
        prediction.resolve(specs.where("spec_id = 'u'"), o).collect()


def test_lifecycle(spark):
    specs = spark.createDataFrame([("1", "draft"), ("2", "resolved")], "spec_id string, status string")
    step = lambda s, e: prediction.advance(specs, spark.createDataFrame([(s, e)], "spec_id string, event string"))
    assert {r.spec_id: r.status for r in step("1", "freeze").collect()} == {"1": "frozen", "2": "resolved"}
    with pytest.raises(Exception, match="illegal step"):
        step("2", "freeze").collect()
    claims = spark.createDataFrame([("a", "normative", None, None), ("b", "descriptive", "m", "2025")], "canonical_id string, claim_type string, outcome_metric string, time_horizon string")
    assert {r.canonical_id: (r.status, r.reasons) for r in prediction.eligibility(claims).collect()} == {"a": ("ineligible", ["claim_type", "no_metric", "no_time"]), "b": ("eligible", [])}


RUBRIC = [("q", 3.0, "unknown", 0.0, 1.0), ("s", 1.0, "not_applicable", 0.0, 1.0)]
RUBRIC_SCHEMA = "dimension_id string, weight double, missing_policy string, minimum double, maximum double"
MARKS = "target string, dimension_id string, score double, status string"


def test_evaluation(spark):
    targets = spark.createDataFrame([("a",), ("b",), ("c",)], "target string")
    marks = spark.createDataFrame([("a", "q", 1.0, "assessed"), ("a", "s", 0.0, "assessed"), ("b", "s", 1.0, "assessed")], MARKS)
    rubric = spark.createDataFrame(RUBRIC, RUBRIC_SCHEMA)
    got = {r.target: (r.aggregate_score, r.n_assessed, r.components) for r in evaluation.evaluate(targets, rubric, marks).collect()}
    assert got == {"a": (0.75, 2, "q,s"), "b": (1.0, 1, "s"), "c": (None, 0, "")}
    strict = spark.createDataFrame([("q", 1.0, "fail", 0.0, 1.0)], RUBRIC_SCHEMA)
    with pytest.raises(Exception, match="required assessment"):
        evaluation.evaluate(targets, strict, marks.where("dimension_id = 'q'")).collect()
    with pytest.raises(Exception, match="outside its scale"):
        evaluation.evaluate(targets, rubric, spark.createDataFrame([("a", "q", 2.0, "assessed")], MARKS)).collect()
    assert evaluation.unknown_dimensions(strict, marks).count() == 2


def test_store(spark):
    rows = lambda *x: spark.createDataFrame(list(x), "id string, v string")
    assert store.deduplicated(rows(("a", "1"), ("a", "1"), ("b", None)), ["id"]).count() == 2
    with pytest.raises(Exception, match="different content"):
        store.deduplicated(rows(("a", "1"), ("a", "2")), ["id"]).collect()
    assert [r.id for r in store.to_insert(rows(("a", "1")), rows(("a", "1"), ("c", "3")), ["id"]).collect()] == ["c"]
    with pytest.raises(Exception, match="collision"):
        store.to_insert(rows(("a", "1")), rows(("a", "9")), ["id"]).collect()
    assert store.collisions(rows(("a", "1"), ("a", "2"), ("b", "1")), ["id"]).first().id == "a"
    assert [r.id for r in store.query(rows(("b", None), ("a", None), ("c", "x")), "id", v=None).collect()] == ["a", "b"]
    with pytest.raises(KeyError):
        store.query(rows(("a", "1")), "id", w=1)
    reuse, new = store.incremental(rows(("a", "1")), rows(("a", "1"), ("b", "2")), ["id"])
    assert (reuse.count(), new.first().id) == (1, "b")
    file = lambda *x: spark.createDataFrame(list(x), "path string, sha string")
    gone, kept = store.prunable(file(("x", "1"), ("y", "2"), ("z", "3")), file(("x", "1")), file(("y", "2"), ("z", "9")))
    assert [r.path for r in gone.collect()] == ["y"] and {r.path for r in kept.collect()} == {"x", "z"}


def test_identity(spark):
    import hashlib
    import json

    df = spark.createDataFrame([('a "q" \\ \n é', 3, None)], "s string, n long, z string")
    text = J.json_object(b=J.json_string(F.col("s")), a=J.json_number(F.col("n")), c=J.json_string(F.col("z")))
    want = json.dumps({"b": 'a "q" \\ \n é', "a": 3, "c": None}, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    got = df.select(text.alias("t"), J.stable_id("x", text).alias("i"), J.canonical_json(F.lit('{"b": 1.0, "a": [true, null]}')).alias("c")).first()
    assert got.t == want and got.i == "x_" + hashlib.sha256(want.encode()).hexdigest() and got.c == '{"a":[true,null],"b":1.0}'
    with pytest.raises(Exception):
        df.select(J.canonical_json(F.lit("[NaN]"))).collect()


def test_evaluation_refusals(spark):
    targets = spark.createDataFrame([("a",)], "target string")
    rubric = spark.createDataFrame(RUBRIC, RUBRIC_SCHEMA)
    mark = lambda *rows: spark.createDataFrame([*rows], MARKS)
    for rows, problem in (([("a", "zz", 1.0, "assessed")], "unknown dimension"), ([("a", "q", 1.0, "assessed")] * 2, "repeated"), ([("a", "q", 2.0, "assessed")], "outside")):
        with pytest.raises(Exception, match=problem):
            evaluation.evaluate(targets, rubric, mark(*rows)).collect()
    with pytest.raises(ValueError):
        evaluation.evaluate(targets, rubric.withColumn("target_type", F.lit("skill")), mark(("a", "q", 1.0, "assessed")), "corpus")
    wide = spark.createDataFrame([(f"d{k}", 1.0, "unknown", 0.0, 1.0) for k in range(1500)], RUBRIC_SCHEMA)
    assert evaluation.evaluate(targets, wide, mark(("a", "d7", 0.5, "assessed"))).first().aggregate_score == 0.5
    a = spark.createDataFrame([("1",), ("2",)], "canonical_id string")
    checks = spark.createDataFrame([("x", True), ("y", False)], "name string, passed boolean")
    assert evaluation.evaluate_synthesis(a, a.limit(1), checks).first().aggregate_score == pytest.approx(0.5)
    with pytest.raises(ValueError):
        evaluation.evaluate_synthesis(a, spark.createDataFrame([("9",)], "canonical_id string"), checks)


def test_strict_records(spark):
    from pyspark.sql.types import ArrayType, DoubleType, LongType, StringType, StructField, StructType

    from veridock.functions import records

    kind = StructType([StructField("schema_version", StringType(), False), StructField("id", StringType(), False), StructField("n", LongType()), StructField("x", DoubleType()), StructField("tags", ArrayType(StringType(), False))])
    good = '{"schema_version":"1.0","id":"a","n":1,"x":2,"tags":["t"]}'
    lines = [good, "", '{"schema_version":"1.0","id":" ","n":true,"x":"1","extra":0}', '{"schema_version":"2.0","id":"a","tags":[null]}', "{", '{"schema_version":"1.0","id":"a","x":NaN}', "[]"]
    rows = spark.createDataFrame([("f", "\n".join(lines))], "path string, text string")
    found, problems = records.read_records(rows, kind, ["id"])
    assert [(r.line, r.id, r.n, r.x, r.tags) for r in found.collect()] == [(1, "a", 1, 2.0, ["t"])]
    got = {}
    for r in problems.collect():
        got.setdefault(r.line, []).append(r.problem)
    assert got[3] == ["unknown field extra", "id is blank", "n must be a whole number", "x must be a number"] and got[4] == ["tags[0] is missing", "schema_version '2.0' isn't known"]
    assert got[5][0].startswith("no JSON") and got[6][0].startswith("no JSON") and got[7] == ["the record must be an object"] and set(got) == {3, 4, 5, 6, 7}
    table = spark.createDataFrame([("a", 1), ("b", None)], "id string, n int")
    assert [(r.id, r.violation) for r in records.require(table, {"n is positive": F.col("n") > 0}, "id").collect()] == [("b", "n is positive")]


def test_identity_values(spark):
    import json

    texts = ["a\tb", 'q"\\', "\b\f\x01\x1f\x0b", "é😀\x00😀", None]
    got = [r.j for r in spark.createDataFrame([(t,) for t in texts], "t string").select(J.escape_controls(J.json_string(F.col("t"))).alias("j")).collect()]
    assert got == [json.dumps(t, ensure_ascii=False) for t in texts]
    assert J.canonical_dumps({"b": (1, 2.5), "a": None}) == '{"a":null,"b":[1,2.5]}'
    for bad in ({1: 2}, {1, 2}, float("nan"), object()):
        with pytest.raises(ValueError):
            J.canonical_dumps(bad)
    with pytest.raises(ValueError):
        J.stable_text_id("Bad prefix", {})


def test_ports(spark):
    from veridock import ports

    docs = spark.createDataFrame([("a", "- Teams should use small queues.")], "source_id string, text string")
    assert isinstance(ports.LineClaims(), ports.ClaimExtractor) and isinstance(ports.BuiltInPrediction(), ports.PredictivePower)
    assert ports.extract(ports.LineClaims(), docs).first().proposition == "Teams should use small queues"

    class Empty:
        version = "0"

        def extract_claims(self, sources, id_col, text_col):
            return sources

    with pytest.raises(ValueError, match="must give"):
        ports.extract(Empty(), docs)
    targets = spark.createDataFrame([("t",)], "target string")
    out = ports.assess(targets, spark.createDataFrame(RUBRIC, RUBRIC_SCHEMA), lambda grid: grid.where("dimension_id = 'q'").withColumn("score", F.lit(0.5)).withColumn("status", F.lit("assessed")))
    assert out.first().aggregate_score == 0.5
