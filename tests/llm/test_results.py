"""Results against brute force, exact round trips and held-out accuracy."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from veridock.llm import decontam, kernel, langid, mixing, neardup, op3, op4, op5, op7, quality, registry, substrings, tokencount, topk, url_samples, urlfilter
from veridock.plans.components import connected_components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def texts_like(rng, n, vocabulary=40, longest=90):
    """Texts with shared passages, near copies and copies."""
    words = [f"w{i}" for i in range(vocabulary)] + ["Éa", "b,", "C"]
    out = []
    for _ in range(n):
        kind = rng.random()
        if out and kind < 0.25:
            own = (rng.choice(out) or "x").split()
            for _ in range(rng.randint(0, 4)):
                own[rng.randrange(len(own))] = rng.choice(words)
            out.append("  ".join(own))
        elif out and kind < 0.5:
            a, b = rng.choice(out) or "y", rng.choice(out) or "z"
            out.append(f"{rng.choice(words)} {a}\n{b}")
        else:
            out.append(" ".join(rng.choice(words) for _ in range(rng.randint(1, longest))))
    return out


def brute_windows(rows, width):
    first = {}
    for d, t in sorted(rows):
        w = WORD.findall(t or "")
        for k in range(len(w) - width + 1):
            first.setdefault(tuple(w[k : k + width]), d)
    out = {}
    for d, t in rows:
        w = WORD.findall(t or "")
        gone = set()
        for k in range(len(w) - width + 1):
            if first[tuple(w[k : k + width])] < d:
                gone.update(range(k, k + width))
        left = " ".join(x for k, x in enumerate(w) if k not in gone)
        out[d] = (len(w), len(gone), hashlib.sha256(left.encode()).hexdigest())
    return out


@pytest.mark.parametrize("hot", [2000, 1])
def test_substrings(make_docs, hot):
    rng = random.Random(hot)
    rows = list(enumerate(texts_like(rng, 120)))
    out = substrings.dedup(make_docs(rows), width=12, anchor=3, hot=hot)
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in out.collect()} == brute_windows(rows, 12)


def brute_components(rows, percent=75):
    sets = {}
    for d, t in rows:
        w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        sets[d] = {tuple(w)} if len(w) == 1 else set(zip(w, w[1:]))
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b]:
                common = len(sets[a] & sets[b])
                if 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
                    x, y = sorted((find(a), find(b)))
                    parent[y] = x
    return {d: (len(sets[d]), find(d), find(d) == d) for d in sets}


def test_near_duplicates(make_docs):
    rng = random.Random(5)
    rows = list(enumerate(texts_like(rng, 150, vocabulary=300, longest=60)))
    base = [f"v{i}" for i in range(100)]
    for i in range(30):  # a drifting family: neighbours are linked, ends are not
        rows.append((200 + i, " ".join(base[: 100 - i] + [f"n{j}" for j in range(i)])))
    out = neardup.near_duplicates(make_docs(rows))
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in out.collect()} == brute_components(rows)


def test_sketch_follows_similarity():
    base = [f"v{i}" for i in range(400)]
    texts = [" ".join(base), " ".join(base[:380] + [f"x{i}" for i in range(20)]), " ".join(f"y{i}" for i in range(400))]
    run = neardup._profile(2)
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2, 3]), pa.array([1, 2, 3]), pa.array(texts)], ["id", "h", "text"])
    sketch = np.array(next(run([batch])).column("sketch").to_pylist(), np.int64)
    near, far = (int(np.bitwise_count((sketch[0] ^ sketch[k]).view(np.uint64)).sum()) for k in (1, 2))
    assert near <= 60 and far > neardup.SKETCH_LIMIT > near


def test_components(spark):
    from veridock.llm.scratch import materialise

    edges = [(i, i + 1) for i in range(0, 40) if i % 10 != 9] + [(100, 101), (101, 100), (7, 7), (None, 3)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long"), materialise).collect()}
    assert got == {i: i // 10 * 10 for i in range(41) if i != 40} | {100: 100, 101: 100}


def test_tokens(spark, make_docs, sf_dir):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(op3.tokenizer_file())
    rng = random.Random(1)
    alphabet = "a'strevlmd  \n\t 1é!.日 '\u00a0\u3000"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40))) for _ in range(500)]
    texts += ["<|endoftext|>", "a <|endoftext|> b<|endoftext|>", "'s 'll''re don't", "x" * 5000, " " * 300]
    texts += [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    out = tokencount.count_tokens(make_docs(list(enumerate(texts))), op3.tokenizer_file())
    want = {i: (len(t.encode()), len(tok.encode(t, add_special_tokens=False).ids)) for i, t in enumerate(texts)}
    assert {r.doc_id: (r.n_bytes, r.n_tokens) for r in out.collect()} == want


def brute_top(vectors, queries, k):
    out = set()
    for q, code in queries:
        ranked = sorted((sum(a != b for a, b in zip(code, c, strict=True)), v) for v, c in vectors)[:k]
        out |= {(q, r + 1, v, d) for r, (d, v) in enumerate(ranked)}
    return out


@pytest.mark.parametrize("dims,hot", [(20, 20_000), (64, 20_000), (150, 5)])
def test_top_k(spark, dims, hot, monkeypatch):
    monkeypatch.setattr(topk, "HOT", hot)
    rng = np.random.default_rng(dims)
    centre = rng.standard_normal((5, dims))
    rows = [(i, (centre[i % 5] + rng.standard_normal(dims) * 0.7).tolist()) for i in range(300)] + [(1000 + i, [1.0] * dims) for i in range(40)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    out = topk.top_k(v, v.where("vec_id % 50 = 0"), 7)
    codes = [(i, [x > 0 for x in e]) for i, e in rows]
    assert {(r.query_id, r["rank"], r.vec_id, r.distance) for r in out.collect()} == brute_top(codes, [c for c in codes if c[0] % 50 == 0], 7)


@pytest.mark.parametrize("weights", [{"a": 1}, {"a": 3, "b": 2, "c": 2}, {"a": 50, "b": 1, "c": 7, "d": 19, "e": 1}, {f"s{i}": 1 + i % 4 for i in range(30)}])
def test_schedule_deviates_less_than_a_block(weights):
    slots = mixing.period(weights)
    total = sum(weights.values())
    assert sorted(t for s in slots.values() for t in s) == list(range(total))
    for s, w in weights.items():
        done = 0
        for t in range(1, total + 1):
            done += (t - 1) in slots[s]
            assert abs(done - w * t / total) < 1


def test_mix_numbers_every_row_once(spark, make_docs):
    rows = [(i, "x", "en", "hot" if i % 3 else f"s{i % 7}") for i in range(500)]
    out = mixing.mix(make_docs(rows), {"hot": 3}, block_rows=8).collect()
    assert len({(r.slot, r.place) for r in out}) == 500
    for s in {r.source for r in out}:
        own = sorted((r.slot, r.place, r.block, r.doc_id) for r in out if r.source == s)
        assert [x[3] for x in own] == sorted(x[3] for x in own)
        assert [x[2] * 8 + x[1] for x in own] == list(range(len(own)))


def test_leaks(make_docs):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghijkl") for _ in range(rng.randint(2, 8)))
    items = [(i, " ".join(word() for _ in range(rng.randint(14, 59)))) for i in range(60)]
    rows, want = [], set()
    for d in range(120):
        filler = [word() for _ in range(rng.randint(0, 200))]
        if d % 2:
            i, text = items[rng.randrange(60)]
            own = text.upper().split() if d % 3 == 0 else text.split()
            if d % 5 == 0:
                own[len(own) // 2] = word()
            filler[len(filler) // 2 : len(filler) // 2] = [f"{w}***" for w in own]
            want.add((d, i))
        rows.append((d, " ".join(filler)))
    docs = make_docs(rows)
    index = decontam.build_index(items)
    got = {(docs_row, i) for docs_row, i, _, likeness in decontam.match(index, pa.array([t for _, t in rows]), 0.6) if likeness >= 0.6}
    assert got == want


def held_out(out, truth, column):
    rows = [(r, truth[r.doc_id]) for r in out.collect() if r.held_out and r.doc_id in truth]
    return np.mean([r[column] == t for r, t in rows]), len(rows)


def test_classifiers_hold_out(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    quality = {r.doc_id: r.quality for r in labels.collect()}
    lang = {r.doc_id: r.lang for r in docs.collect()}
    for share, least in ((held_out(op4.scored(docs, labels), quality, "predicted"), 0.95), (held_out(op7.identified(docs), lang, "lang_pred"), 0.97)):
        assert share[1] > 50 and share[0] >= least, share


def test_suffix_automaton_parses_greedily():
    model = langid.train({"x": ["abcabcabd the end of it"], "y": ["zzz yyy xxx"]})
    text = "abcab dabd the of zq end"
    sample = langid.normalise(np.frombuffer(b"abcabcabd the end of it", np.uint8)).tobytes()
    own = langid.normalise(np.frombuffer(text.encode(), np.uint8)).tobytes()
    ended, at, open_phrase = 0, 0, False
    while at < len(own):
        k = at
        while k < len(own) and own[at : k + 1] in sample:
            k += 1
        open_phrase = k == len(own)
        ended, at = ended + (not open_phrase), max(k, at + 1)
    pieces = model.classes[np.frombuffer(own, np.uint8)].astype(np.int32)[:, None]
    assert int(model.phrases(pieces, model.languages[0])[0]) == ended


def test_url_model_hold_out():
    """Hosts, not only URLs, are held out."""
    host = lambda u: urlfilter.split_url(u)[0]
    hosts = {h: k for k, h in enumerate(sorted({host(u) for u, _ in url_samples.LABELLED_URLS}))}
    for fold in range(3):
        train = [(u, y) for u, y in url_samples.LABELLED_URLS if hosts[host(u)] % 3 != fold]
        rest = [(u, y) for u, y in url_samples.LABELLED_URLS if hosts[host(u)] % 3 == fold]
        model = urlfilter.train(train)
        parts = [urlfilter.split_url(u) for u, _ in rest]
        odds = model.log_odds(urlfilter._framed(h for h, _ in parts), urlfilter._framed(p for _, p in parts))
        label = np.array([y for _, y in rest])
        assert (odds >= 0)[label == 1].mean() > 0.75 and (odds < 0)[label == 0].mean() > 0.9


def test_quality_score_by_definition():
    """Mean of word values plus means of 3- and 4-gram values, one at a time."""
    rng = np.random.default_rng(4)
    model = quality.QualityModel(rng.standard_normal((3, 1 << quality.BITS)).astype(np.float32), 0.3)
    texts = ["", "word word other", "a", "ab", "é日本 x  y\n日", "the the the end", None, "z" * 400]

    def bucket(gram):
        code = int.from_bytes(gram, "little") * 0x9E3779B1 & 0xFFFFFFFF
        code = (code ^ code >> 15) * 0x85EBCA6B & 0xFFFFFFFF
        return code >> (32 - quality.BITS)

    want = []
    for t in texts:
        data = (t or "").encode()
        words = data.split()
        z = model.bias
        values = []
        for k, w in enumerate(words):
            one = kernel.range_hashes(np.frombuffer(w, np.uint8), np.array([0]), np.array([len(w)]))[0]
            values.append(model.tables[0][1 if k and words[k - 1] == w else int(one) >> (64 - quality.BITS)])
        z += np.mean(values) if values else 0
        for kind, n in ((1, 3), (2, 4)):
            grams = [model.tables[kind][bucket(data[k : k + n])] for k in range(len(data) - n + 1)]
            z += np.mean(grams) if grams else 0
        want.append(1 / (1 + np.exp(-z)))
    assert np.allclose(model.score(pa.array(texts, pa.large_string())), want, atol=1e-5)


def test_language_by_definition():
    """Fewest greedy phrases of each piece wins."""
    model = langid.train({"aa": ["the cat sat on the mat and the dog"], "bb": ["le chat est sur le tapis et le chien"]})
    samples = {"aa": b"the cat sat on the mat and the dog", "bb": b"le chat est sur le tapis et le chien"}
    texts = ["the dog sat on the cat", "le chien est le chat", "sur le mat", "12 !", None, "the " * 200 + "le", "CHAT CAT"]
    names, scores = model.predict(pa.array(texts, pa.large_string()))
    for text, name, score in zip(texts, names, scores, strict=True):
        if not text or not any(c.isalpha() for c in text):
            assert (name, score) == ("und", 0)
            continue
        own = langid.normalise(np.frombuffer(text.encode(), np.uint8)).tobytes()
        counts = {}
        for lang, sample in samples.items():
            total = 0
            for s in range(0, len(own), langid.PIECE):
                piece, at = own[s : s + langid.PIECE], 0
                total += 1
                while at < len(piece):
                    k = at
                    while k < len(piece) and piece[at : k + 1] in sample:
                        k += 1
                    total += k < len(piece)
                    at = max(k, at + 1)
            counts[lang] = total
        assert counts[name] == min(counts.values()) and 0 < score <= 1


def test_large_schedules(spark, make_docs, monkeypatch):
    """Beyond the driver's bounds one task schedules, with the same result; common factors cancel out."""
    docs = make_docs([(i, "x", "en", f"s{i % 5}") for i in range(200)])
    want = mixing.mix(docs, {"s0": 3, "s1": 2}, block_rows=4).collect()
    monkeypatch.setattr(mixing, "DRIVER_PERIOD", 3)
    assert sorted(mixing.mix(docs, {"s0": 6, "s1": 4}, 2, block_rows=4).collect()) == sorted(want)


def test_url_query_matches_brute_force(spark, sf_dir):
    out = {r.page_id: r for r in op5.op5_url_filter(spark, sf_dir).collect()}
    rules = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
    for p in spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url").collect():
        host, path = urlfilter.split_url(p.url)
        fits = [(len(h + s), h + s, v) for v, h, s in rules if (host == h or host.endswith("." + h)) and path.startswith(s)]
        r = out[p.page_id]
        assert (r.host, r.path) == (host, path)
        assert (r.rule, r.verdict) == max(fits)[1:] if fits else r.rule is None and r.verdict in ("allow", "block")


def test_queries_are_registered():
    names = list(registry.queries())
    assert [int(n[2:].split("_")[0]) for n in names] == list(range(1, 11))
    assert set(registry.oracle_sql()) <= set(names)


def test_pipeline_equals_its_stages(spark, sf_dir):
    out = corpus_pipeline.run(spark, sf_dir)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    good = {r.doc_id for r in op4.scored(docs, labels).where("predicted = 1").collect()}
    parts = brute_components([(d, rows[d].text) for d in good])
    kept = {d for d in good if parts[d][2]}
    cut = brute_windows([(d, rows[d].text) for d in kept], 50)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    got = {r.doc_id: r for r in out.collect()}
    assert set(got) <= kept and out.select(F.countDistinct("mix_slot", "mix_place")).first()[0] == len(got)
    for d in got:
        assert hashlib.sha256(" ".join(WORD.findall(got[d].text)).encode()).hexdigest() == cut[d][2]
    lost = kept - set(got)
    plain = lambda t: " ".join(re.findall(r"[^\W_]+", t.lower()))
    assert lost == {d for d in kept if any(f" {plain(t)} " in f" {plain(rows[d].text)} " for _, t in items)} - {d for d in got}
