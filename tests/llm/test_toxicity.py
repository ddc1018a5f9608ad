"""Compression distances against brute force, and held-out recall by language."""

import random

import numpy as np
import pyarrow as pa
import pytest

from veridock.llm import op10, toxicity
from veridock.llm.langid import normalise
from veridock.llm.samples import excerpt


@pytest.fixture(scope="module")
def samples():
    rng = random.Random(5)
    part = ["ba", "do", "ki", "lem", "nor", "pus", "tri", "vex"]
    word = lambda: "".join(rng.choice(part) for _ in range(rng.randint(1, 4)))
    out = []
    for k in range(400):
        own = [word() if rng.random() < 0.9 else rng.choice(["krumblox", "asnarkla"]) for _ in range(rng.randint(20, 120))]
        if k % 4 == 0:
            for _ in range(rng.randint(2, 5)):
                own[rng.randrange(len(own))] = rng.choice(["grumblor", "snarkle", "wurzel" + rng.choice(part)])
        elif k % 9 == 0:
            own[rng.randrange(len(own))] = "snarkle"
        out.append((" ".join(own), int(k % 4 == 0)))
    return out


def test_values_equal_brute_force(samples):
    model = toxicity.train(samples[:300])
    assert model.ordinary and any(model.toxic) and not set(model.ordinary.split()) & set(b" ".join(model.toxic).split())
    texts = [t for t, _ in samples[300:]] + ["", "!!! 12", "GRUMBLOR", "x" * 50_000, "é ß snarkle" * 2000]
    got = model.values(pa.array(texts, pa.large_string()))
    tools = [toxicity._compressor(c) for c in (model.ordinary, *model.toxic)]
    for text, value in zip(texts, got.tolist(), strict=True):
        words = normalise(np.frombuffer(text.encode(), np.uint8)).tobytes().split()
        best = run = 0.0
        for k in range(0, len(words), toxicity.WINDOW):
            body = toxicity._HEAD + b" ".join(words[k : k + toxicity.WINDOW]) + b" " + toxicity._TAIL
            base, *others = (len(t.compress(body)) for t in tools)
            step = [min(max(base - x - model.first + 1, 0), toxicity._BINS - 1) for x in others]
            at = step[0] or (step[1] + toxicity._BINS - 1 if step[1] else 0)
            run = max(run + model.ratios[at], 0.0)
            best = max(best, run)
        assert value == pytest.approx(best, abs=1e-9), text[:80]


def test_unseen_words_and_held_out(samples):
    model = toxicity.train(samples[:300])
    label = np.array([y for _, y in samples[300:]])
    found = model.score(pa.array([t for t, _ in samples[300:]], pa.large_string())) >= 0.5
    assert found[label == 1].mean() >= 0.9 and found[label == 0].mean() <= 0.05
    unseen = "bado wurzelopp kilem wurzelimm nor"
    assert not any(w in b" ".join(model.toxic).split() for w in unseen.encode().split())
    assert model.score(pa.array([unseen], pa.large_string()))[0] >= 0.5


def test_degenerate_training():
    for samples in ([], [("a b", 1)], [("a b", 0)], [("", 1), ("", 0)], [("same words here", 1), ("same words here", 0)]):
        assert (toxicity.train(samples).score(pa.array(["same words", None, ""])) < 0.5).all()


def test_held_out_recall_by_language(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    out = op10.scored(docs, labels).where("held_out").join(labels.select("doc_id", "toxic"), "doc_id").join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    bad, clean = out[out.toxic == 1], out[out.toxic == 0]
    assert bad.predicted.mean() >= 0.85 and clean.predicted.mean() <= 0.03
    for lang in ("en", "fr", "de", "es"):
        assert bad[bad.lang == lang].predicted.mean() >= 0.75 and clean[clean.lang == lang].predicted.mean() <= 0.05, lang


def test_excerpts_come_from_everywhere(spark):
    text = "".join(f"{i:04d}" for i in range(10_000))
    a, b = spark.createDataFrame([(text,), ("short",)], "t string").select(excerpt("t", 5_000).alias("e")).collect()
    pieces = a.e.split(" ")
    assert b.e == "short" and len(pieces) == 5 and all(len(p) == 1000 and p in text for p in pieces)
    assert [text.index(p) for p in pieces] == sorted(text.index(p) for p in pieces) and text.index(pieces[-1]) > 10_000
