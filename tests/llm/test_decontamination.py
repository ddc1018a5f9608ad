"""Decontamination against brute-force weighted Jaccard of all item-sized windows."""

import math
import random
import re
from collections import Counter

import pyarrow as pa
import pytest

from veridock.llm import decontam

PLAIN = re.compile(r"[^\W_]+")


def pairs(words):
    return set(zip(words, words[1:]))


def brute(docs, items, threshold=0.6):
    """(doc, item) -> (first word, similarity) by the definition; items of 4 words and more."""
    own = [(i, PLAIN.findall(t.lower())) for i, t in items]
    times = Counter(p for _, w in own for p in pairs(w))
    weight = lambda ps: math.fsum(1 / (1 + math.log(times[p])) if p in times else 1.0 for p in ps)
    out = {}
    for d, text in docs:
        w = PLAIN.findall((text or "").lower())
        for i, item in own:
            for s in range(1 - len(item), len(w)):
                window, want = pairs(w[max(s, 0) : s + len(item)]), pairs(item)
                if len(window & want) and (like := weight(window & want) / weight(window | want)) >= threshold:
                    if (d, i) not in out or like > out[d, i][1] + 1e-8:
                        out[d, i] = (max(s, 0), like)
    return out


def edited(rng, words, n):
    own = list(words)
    for k in rng.sample(range(len(own)), n):
        own[k] = f"new{rng.randrange(10**6)}"
    return own


def same(got, want):
    assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()}
    assert all(got[k][1] == pytest.approx(want[k][1], abs=1e-8) for k in want)


@pytest.mark.parametrize("places", [4_000_000, 50])
def test_edited_passages_are_found(monkeypatch, places):
    monkeypatch.setattr(decontam, "PLACES", places, raising=False)
    rng = random.Random(11)
    items = [(i, " ".join(f"i{i}w{rng.randrange(500)}" for _ in range(n))) for i, n in enumerate([30, 60, 100] * 4)]
    docs = []
    for d in range(150):
        words = items[d % 12][1].split()
        own = edited(rng, words, {30: 3, 60: 7, 100: 12}[len(words)])
        if d % 5 == 0:
            own[10:10] = ["put", "in"]
        filler = [f"f{rng.randrange(50)}" for _ in range(rng.randrange(40))]
        docs.append((d, " ".join(filler + own + filler)))
    docs.append((150, ""))
    want = brute(docs, items)
    assert sum(like <= 0.75 for _, like in want.values()) > 100
    found = decontam.match(decontam.build_index(items), pa.array([t for _, t in docs]), 0.6)
    same({(d, i): (first, like) for d, i, first, like in found}, want)


def test_shared_words_and_runs_without_anchor():
    rng = random.Random(2)
    words = [f"w{k}" for k in range(6)]
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(4, 14)))) for i in range(25)]
    docs = [(d, " ".join(rng.choice(words) for _ in range(rng.randint(1, 60)))) for d in range(60)]
    found = decontam.match(decontam.build_index(items), pa.array([t for _, t in docs]), 0.6)
    same({(d, i): (first, like) for d, i, first, like in found}, brute(docs, items))


def test_blocks_of_items_change_nothing(spark, make_docs, monkeypatch):
    rng = random.Random(4)
    template = [f"t{k}" for k in range(13)]
    items = [(i, " ".join(template + [f"i{i}w{k}" for k in range(17)])) for i in range(10)]
    texts = [(d, " ".join(template + items[d % 10][1].split()[13 : 13 + rng.randint(8, 17)])) for d in range(20)]
    docs, table = make_docs(texts), spark.createDataFrame([(i, t) for i, t in items] + items[:3], "item_id long, text string")
    seen = []
    for size in (1, 4, 1024):
        monkeypatch.setattr(decontam, "ITEM_BLOCK", size)
        rows = {tuple(r) for r in decontam.contaminations(docs, table).collect()}
        left = {r.doc_id for r in decontam.clean(docs, table).select("doc_id").collect()}
        assert left == {d for d, _ in texts} - {d for d, *_ in rows}
        seen.append(rows)
    assert seen[0] == seen[1] == seen[2]
    same({(d, i): (first, like) for d, i, first, like in seen[0]}, brute(texts, items))
