"""The language sample comes from whole texts, not from their beginnings."""

import random

import pyarrow as pa

from veridock.llm import langid


def words(rng, letters, n):
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(3, 9))) for _ in range(n))


def test_texts_that_share_an_opening_are_learned_beyond_it():
    rng = random.Random(1)
    banner = words(rng, "klmnopqrst", 60)
    assert len(banner) > 300
    texts = {"x": [f"{banner} {words(rng, 'abcdefé', 200)}" for _ in range(250)], "y": [words(rng, "uvwxyzghe", 200) for _ in range(250)]}
    model = langid.train(texts)
    docs = [words(rng, "abcdefé", 80) for _ in range(20)]
    assert model.predict(pa.array(docs))[0] == ["x"] * 20


def test_sample_is_bounded_spread_and_whole_if_it_fits():
    texts = ["é" * 5000 + f" middle{i} " + "ü" * 5000 + f" end{i}" for i in range(30)]
    sample = langid._sample(texts, 6000)
    assert len(sample) <= 6000
    sample.decode()
    assert any(f"middle{i}".encode() in sample for i in range(30)) and any(f"end{i}".encode() in sample for i in range(30))
    assert langid._sample(["ab c", "d"], 6) == b"ab c d"
    assert 0 < len(langid._sample(["abcdefgh" * 100, "y"], 6)) <= 6
