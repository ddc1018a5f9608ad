"""Lines cut inside the row against Python's own splitting."""

import random

import pyarrow as pa
import pytest

from veridock.functions import lines as L
from veridock.operators import claims, provenance
from veridock.plans import session


def brute(texts):
    out = []
    for i, t in enumerate(texts):
        if t is None:
            continue
        at = paragraph = 0
        section = None
        kept = t.splitlines(keepends=True)
        if not kept or kept[-1].splitlines()[0] != kept[-1]:
            kept.append("")  # what follows the last break
        for n, line in enumerate(kept):
            body = line.splitlines()[0] if line else ""
            paragraph += bool(body.strip())
            if body.strip().startswith("#") and body.strip().strip("#").strip():
                section = " ".join(body.strip().strip("#").strip().split())
            out.append((i, n, body, at, paragraph, section))
            at += len(line)
    return out


def texts(seed, n=300):
    rng = random.Random(seed)
    parts = ["\n", "\r\n", "\r", "\x0b", "\x0c", "\x1c", "\x1e", "\x85", " ", " ", "a", "é", "日本", "# Head", "## two words ", "#", " ", "\t", "x y", "😀", "　"]
    return ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(n)] + [None, "", "\r\n", "\n\r\n", "a\r", "\nb"]


@pytest.mark.parametrize("seed", range(4))
def test_numbered(seed):
    own = texts(seed)
    for offset in (0, 3):
        batch = pa.RecordBatch.from_arrays([pa.array(range(len(own))), pa.array(own)], ["id", "text"]).slice(offset)
        got = list(zip(*(c.to_pylist() for c in L.numbered(batch).columns), strict=True))
        assert got == [r for r in brute(own) if r[0] >= offset]


def test_lines_need_no_shuffle(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(session, "SPLIT_BYTES", 0)  # a scan of any size as a large one
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    plan = L.lines(docs, "doc_id", "text")._jdf.queryExecution().toString()
    assert "Exchange" not in plan and "Window" not in plan


def test_crlf_and_repeated_ids(spark):
    one = "First words here now.\r\n\r\n- Teams should use small queues.\r\n- Caches can reduce latency a lot.\r\n"
    two = "# Other\nOperators must drop requests. Queues are always short."
    docs = spark.createDataFrame([(1, one), (2, two)], "id int, text string")
    own = claims.source_claims(docs, "id", "text")
    assert {r.verdict for r in provenance.verify_spans(own, docs, "id", "text").collect()} == {"ok"}
    twice = spark.createDataFrame([(1, one), (1, two), (1, one)], "id int, text string")
    rows = [(r.line, r.start_offset, r.paragraph, r.section) for r in L.lines(twice, "id", "text").collect()]
    assert sorted(map(str, rows)) == sorted(str(r[2:]) for r in brute([one, two, one]))


def test_structural_headings(spark):
    docs = [(1, "# A\n~~~\n# no\n~~~\nT\n==\n"), (1, "~~~\n# no\n"), (2, "x\r\n---\r\n"), (3, "---\nlong title\n--\n=== 5 no ==="), (4, None)]
    found = L.structural_headings(spark.createDataFrame(docs, "id int, text string"), "id", "text").collect()
    assert sorted((r.id, r.depth, r.title) for r in found) == [(1, 1, "a"), (1, 1, "t"), (2, 2, "x")]
