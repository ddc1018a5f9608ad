"""Nulls, empty and very long texts, ties, repeated rows, empty tables and
clashing column names, for every operator and every pipeline stage."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from veridock.llm import decontam, langid, mixing, neardup, op3, op4, op7, op10, substrings, tokencount, topk, urlfilter

LABELS = "doc_id long, quality int, toxic int"


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("sf")
    spark.createDataFrame([(4, 1, 0), (6, 0, 1), (6, 0, 1), (7, None, None), (None, 1, 1), (99, 1, 0)], LABELS).write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, "a b c d e"), (2, None), (3, ""), (4, "word"), (4, "word")], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return str(d)


def ids(df, col="doc_id"):
    return sorted((r[0] for r in df.select(col).collect()), key=lambda x: (x is None, x))


@pytest.mark.parametrize("extra", [False, True])
def test_one_row_per_row(spark, make_docs, odd_rows, tables, extra):
    docs = make_docs(odd_rows, extra)
    labels = spark.read.parquet(f"{tables}/labels.parquet")
    want = ids(docs)
    for out in (op4.scored(docs, labels), op10.scored(docs, labels), op7.identified(docs), tokencount.count_tokens(docs, op3.tokenizer_file()), substrings.dedup(docs), neardup.near_duplicates(docs), mixing.mix(docs, {"s": 2})):
        assert ids(out) == want, out.columns


def test_empty_tables(spark, make_docs, tables):
    docs = make_docs([])
    labels = spark.read.parquet(f"{tables}/labels.parquet").limit(0)
    items = spark.read.parquet(f"{tables}/benchmark.parquet").limit(0)
    for out in (op4.scored(docs, labels), op10.scored(docs, labels), op7.identified(docs), tokencount.count_tokens(docs, op3.tokenizer_file()), substrings.dedup(docs), neardup.near_duplicates(docs), mixing.mix(docs, {}), decontam.contaminations(docs, items)):
        assert out.count() == 0
    vectors = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert topk.top_k(vectors, vectors).count() == 0
    pages = spark.createDataFrame([], "page_id long, url string")
    assert urlfilter.judge(pages, urlfilter.Rules.of([])).count() == 0


def test_text_results(make_docs, odd_rows):
    docs = make_docs(odd_rows)
    tokens = {r.doc_id: (r.n_bytes, r.n_tokens) for r in tokencount.count_tokens(docs, op3.tokenizer_file()).collect() if r.doc_id}
    assert tokens[1] == tokens[2] == (0, 0) and tokens[4] == (4, 1) and tokens[8][0] == len("é ß 日本 😀".encode())
    near = {r.doc_id: r for r in neardup.near_duplicates(docs).collect() if r.doc_id}
    assert near[1].n_shingles == near[3].n_shingles == 0 and near[1].kept and near[3].component_id == 3
    assert near[4].n_shingles == 1 and near[7].component_id == 6 and not near[7].kept and near[5].kept
    assert [(r.component_id, r.kept) for r in neardup.near_duplicates(docs).where("doc_id is null").collect()] == [(None, True)] * 2
    cut = {r.doc_id: r for r in substrings.dedup(docs).collect() if r.doc_id}
    assert cut[1].n_words == 0 and cut[5].n_removed == 0 and cut[5].n_words == 60_000
    lang = {r.doc_id: r for r in langid.identify(docs, langid.train({"en": ["the word is here"], "fr": ["le mot est ici"]})).collect() if r.doc_id}
    assert lang[1].lang_pred == lang[3].lang_pred == "und" and lang[4].lang_pred == "en" and 0 <= lang[4].score <= 1


@pytest.mark.parametrize("extra", [False, True])
def test_stages(spark, make_docs, odd_rows, tables, extra):
    docs = make_docs(odd_rows, extra)
    for name, stage in corpus_pipeline.STAGES:
        for rows in (docs, docs.limit(0)):
            out = stage(spark, rows, tables)
            assert out.columns[: len(docs.columns)] == docs.columns, name
            out.collect()


def test_stages_keep_clashing_columns(spark, make_docs, tables):
    """Columns named like those that the stages use inside keep their values."""
    docs = make_docs([(1, "a b c", "en", None), (2, "d e f"), (2, "d e f"), (None, None)])
    for c in ("__n", "__kept", "__number", "__cut_id", "cut_id", "cut_h", "own_number", "own_key", "MIX_SLOT", "digest", "key"):
        docs = docs.withColumn(c, F.lit("mine"))
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, tables)
        assert out.columns[: len(docs.columns)] == docs.columns, name
        for r in out.collect():
            assert all(r[c] == "mine" for c in docs.columns[5:]), name


def test_stage_decisions(spark, make_docs, tables):
    stages = dict(corpus_pipeline.STAGES)
    docs = make_docs([(1, "x a b c d e y"), (2, "x y z"), (3, "x y z"), (None, None), (4, "")])
    assert ids(stages["decontamination"](spark, docs, tables)) == [2, 3, 4, None]
    assert ids(stages["near_dedup"](spark, docs, tables)) == [1, 2, 4, None]
    passage = " ".join(f"p{i}" for i in range(60))
    long_docs = make_docs([(1, f"one {passage}"), (2, f"two  {passage}\nend")])
    out = {r.doc_id: (r.text, r.n_chars) for r in stages["substring_dedup"](spark, long_docs, tables).collect()}
    assert out == {1: (f"one {passage}", len(passage) + 4), 2: ("two end", 7)}
    mixed = stages["mixing"](spark, make_docs([(1, "a"), (1, "a"), (2, "b", "en", None)]), tables)
    assert sorted((r.doc_id, r.mix_place) for r in mixed.collect()) == [(1, 0), (1, 1), (2, 0)]
    assert mixed.select(F.countDistinct("mix_slot", "mix_place")).first()[0] == 3


def test_vectors(spark):
    rows = [(1, [1.0, -1.0]), (1, [1.0, -1.0]), (2, [1.0, -1.0]), (3, [-1.0, None]), (4, None), (5, []), (None, [1.0, 1.0]), (6, [float("nan"), 1.0, 2.0])]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("q", F.lit(1)).withColumn("code", F.lit(2))
    out = topk.top_k(v, v.where("vec_id = 1"), 3)
    assert [(r.query_id, r["rank"], r.vec_id, r.distance) for r in out.orderBy("rank").collect()] == [(1, 1, 1, 0), (1, 2, 2, 0), (1, 3, 3, 1)]


def test_urls(spark):
    rules = urlfilter.Rules.of([("block", "net", "/"), ("allow", "example.net", "/en/")])
    urls = [None, "", "no scheme", "HTTP://A.Example.NET/en/x?y", "http://example.net", "http://net/a#b", "http://xnet/a", "x://a?b://c/d", "http://EXAMPLE.net/de"]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls)] + [(None, urls[3])] * 2, "page_id long, url string").withColumn("rule", F.lit(0)).withColumn("host", F.lit(0))
    out = urlfilter.judge(pages, rules)
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in out.collect()}
    for i, u in enumerate(urls):
        assert got[i][:2] == urlfilter.split_url(u)
    assert [got[i][2] for i in range(len(urls))] == [None, None, None, "example.net/en/", None, "net/", None, None, "net/"]
    assert got[3][3] == "allow" and got[5][3] == "block" and out.count() == len(urls) + 2
