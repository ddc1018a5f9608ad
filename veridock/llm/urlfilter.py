"""URL filters: host and path rules, else logistic regression.

The regression sees hashed character 3- to 5-grams of the host and, in buckets
of their own, of the path; it is trained in numpy from a small labelled table
of URLs.  Rules come first: a rule names a host and the start of a path, holds
for the host and all its subdomains, and the longest rule that fits decides.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veridock.llm import kernel
from veridock.llm.url_samples import LABELLED_URLS

BITS = 16
_SIZES = (3, 4, 5)


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path as :func:`host_column` and :func:`path_column` give them."""
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min((k for k in map(rest.find, "/?#") if k >= 0), default=len(rest))
    path_end = min((k for k in (rest.find(c, end) for c in "?#") if k >= 0), default=len(rest))
    return rest[:end].translate({c: c + 32 for c in range(65, 91)}), rest[end:path_end]


def _rest(url: Column) -> Column:
    at = F.locate("://", url)
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def host_column(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    host = F.regexp_extract(_rest(url), r"^([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_column(url: Column) -> Column:
    """From the host's end up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def _features(texts: pa.Array, salt: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all n-grams with their text, and the number of each text's n-grams."""
    buf, offsets = kernel.utf8(texts)
    base = int(offsets[0])
    at = offsets - base
    buf = buf[base : int(offsets[-1])].astype(np.uint64)
    codes, owners = [], []
    for n in _SIZES:
        m = max(len(buf) - n + 1, 0)
        owner = np.searchsorted(at, np.arange(m), side="right") - 1
        inside = np.arange(m) + n <= at[owner + 1] if m else np.zeros(0, bool)
        code = np.full(m, n + 16 * salt, np.uint64)
        for k in range(n):
            code = code * np.uint64(257) + buf[k : k + m]
        codes.append((kernel.mix(code[inside]) >> np.uint64(64 - BITS)).astype(np.int64))
        owners.append(owner[inside])
    owner = np.concatenate(owners)
    return np.concatenate(codes), owner, np.bincount(owner, minlength=len(texts))


@dataclass
class UrlModel:
    weights: np.ndarray  # (2, buckets): host, path
    bias: float

    def log_odds(self, hosts: pa.Array, paths: pa.Array) -> np.ndarray:
        """Log-odds that a URL is to be blocked."""
        z = np.full(len(hosts), self.bias)
        for part, texts in enumerate((hosts, paths)):
            bucket, owner, n = _features(texts, part)
            z += np.bincount(owner, self.weights[part][bucket], len(texts)) / np.sqrt(np.maximum(n, 1))
        return z


def _framed(values: Iterable[str]) -> pa.Array:
    return pa.array([f"^{v}$" for v in values], pa.large_string())


def train(urls: Sequence[tuple[str | None, int]], rounds: int = 300, rate: float = 20.0, decay: float = 1e-5) -> UrlModel:
    """Full-batch gradient descent with weight decay."""
    parts = [split_url(u) for u, _ in urls]
    y = np.array([label for _, label in urls], np.float64)
    model = UrlModel(np.zeros((2, 1 << BITS)), 0.0)
    if not len(y):
        return model
    rows = [_features(_framed(p[k] for p in parts), k) for k in range(2)]
    for _ in range(rounds):
        z = np.full(len(y), model.bias)
        for k, (bucket, owner, n) in enumerate(rows):
            z += np.bincount(owner, model.weights[k][bucket], len(y)) / np.sqrt(np.maximum(n, 1))
        error = (1 / (1 + np.exp(-z)) - y) / len(y)
        model.bias -= rate * error.sum()
        for k, (bucket, owner, n) in enumerate(rows):
            model.weights[k] -= rate * (np.bincount(bucket, (error / np.sqrt(np.maximum(n, 1)))[owner], 1 << BITS) + decay * model.weights[k])
    return model


@dataclass
class Rules:
    """Rules by host; of those that fit, the longest host and path together, then the longer host."""

    by_host: dict[str, list[tuple[str, str]]]

    @classmethod
    def of(cls, rules: Iterable[tuple[str, str, str]]) -> Rules:
        """From (verdict, host, start of path)."""
        by_host: dict[str, list[tuple[str, str]]] = {}
        for verdict, host, path in rules:
            by_host.setdefault(host, []).append((path, verdict))
        return cls({h: sorted(r, key=lambda x: -len(x[0])) for h, r in by_host.items()})

    def find(self, host: str, path: str) -> tuple[str | None, str | None]:
        """(rule, verdict), or nulls."""
        best, found = (-1, -1), (None, None)
        suffix = host
        while suffix:
            for start, verdict in self.by_host.get(suffix, ()):
                if path.startswith(start):
                    if (len(suffix) + len(start), len(suffix)) > best:
                        best, found = (len(suffix) + len(start), len(suffix)), (suffix + start, verdict)
                    break
            _, _, suffix = suffix.partition(".")
        return found


def judge(pages: DataFrame, rules: Rules, model: UrlModel | None = None, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(id, host, path, rule, verdict, score) for every row of ``pages``.

    ``score`` is the regression's probability that the URL is to be blocked; it
    decides (from 0.5 on) where no rule fits.  A null URL, or one without
    ``://``, has an empty host and path, which no rule of a named host fits.
    Repeated rows and null ids are rows like any other; other columns aren't
    read.
    """
    shared = pages.sparkSession.sparkContext.broadcast((rules, model or train(LABELLED_URLS)))  # a rule list and 2**17 floats

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_rules, own_model = shared.value
        for b in batches:
            hosts, paths = b.column(1).to_pylist(), b.column(2).to_pylist()
            odds = own_model.log_odds(_framed(hosts), _framed(paths))
            found = [own_rules.find(h, p) for h, p in zip(hosts, paths, strict=True)]
            verdict = [v or ("block" if z >= 0 else "allow") for (_, v), z in zip(found, odds.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([r for r, _ in found], pa.string()), pa.array(verdict, pa.string()), pa.array(1 / (1 + np.exp(-odds)))], ["id", "host", "path", "rule", "verdict", "score"])

    url = F.col(url_col).cast("string")
    rows = pages.select(F.col(id_col).cast("long").alias("id"), host_column(url).alias("host"), path_column(url).alias("path"))
    return rows.mapInArrow(run, "id long, host string, path string, rule string, verdict string, score double").withColumnRenamed("id", id_col)
