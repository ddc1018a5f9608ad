"""Near duplicates: repeated ids, templates that link nothing, late links."""

import random

from test_results import brute_components

from veridock.llm import neardup


def test_template_of_unlinked_classes(make_docs):
    """Texts that share a template and so many bands, but are no duplicates, with a few that are."""
    rng = random.Random(1)
    template = [f"t{i}" for i in range(260)]
    rows = [(i, " ".join(template + [f"u{i}x{j}" for j in range(110)])) for i in range(300)]
    for i in range(0, 40, 4):  # near copies of some, under late ids
        own = rows[i][1].split()
        for _ in range(6):
            own[rng.randrange(len(own))] = f"c{rng.randrange(10**6)}"
        rows.append((1000 + i, " ".join(own)))
    out = neardup.near_duplicates(make_docs(rows)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in out} == brute_components(rows)
    assert sum(not r.kept for r in out) == 10


def test_repeated_ids(make_docs):
    rng = random.Random(2)
    text = lambda: " ".join(f"w{rng.randrange(10**6)}" for _ in range(80))
    rows, want = [], {}
    for i in range(30):  # an id with two texts, each with one near copy of its own
        a, b = text(), text()
        rows += [(i, a), (i, b), (100 + i, a + " x"), (200 + i, b + " y"), (i, a)]
        want |= {i: i, 100 + i: i, 200 + i: i}
    docs = make_docs(rows)
    got = [(r.doc_id, r.component_id, r.kept) for r in neardup.near_duplicates(docs).collect()]
    assert sorted(got) == sorted((d, want[d], d == want[d]) for d, _ in rows)
    kept = neardup.one_of_each(docs).collect()
    assert sorted((r.doc_id, r.text) for r in kept) == sorted(set(rows) & {(r[0], r[1]) for r in rows if r[0] < 100})


def test_clashing_names_and_odd_rows(make_docs, odd_rows):
    docs = make_docs(odd_rows, True).withColumnRenamed("slot", "KEY").withColumnRenamed("part", "digest")
    out = neardup.one_of_each(docs)
    assert out.columns == docs.columns
    assert sorted(((r.doc_id, r.text[:5] if r.text else r.text) for r in out.collect()), key=str) == sorted(
        [(1, None), (2, ""), (3, " \n\t "), (4, "word"), (5, "w0 w1"), (6, "a b c"), (8, "é ß 日"), (9, None), (None, "a b c"), (None, None)], key=str
    )
