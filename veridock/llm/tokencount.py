"""Token counts of a byte-level BPE tokenizer without materialising ids.

Byte-level BPE never merges across pre-tokens, so a text's token count is the
sum over its pre-tokens.  Texts are cut into pre-tokens with array operations;
each chunk of texts yields, for every distinct pre-token, the texts it occurs
in and how often, packed by bucket of the pre-token's hash.  All chunks' rows
of a bucket meet in one partition, where each distinct pre-token is tokenised
once and joined to those frequencies; the sums travel back to the chunk.  A
bucket gets one row from a chunk, whatever is frequent, so none becomes hot.

The cutting rule is that of the byte-level pre-tokenizer with its own regular
expression: contractions, runs of letters, of digits and of other characters,
each with one space before it, and runs of white space.
"""

from __future__ import annotations

import json
import os
import pickle
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veridock.llm import kernel
from veridock.llm.scratch import materialise
from veridock.plans.session import spread

_CHUNK_BYTES = 8_000_000
_CHUNK_TEXTS = 60_000
_KNOWN = 1_500_000
#: Most buckets: a chunk has some 100,000 distinct pre-tokens, and a blob of its own for each bucket.
MAX_BUCKETS = 1024
_OTHER, _LETTER, _NUMBER, _SPACE = range(4)
_WHITE = [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


@cache
def _classes() -> np.ndarray:
    import regex

    table = np.zeros(0x110000, dtype=np.uint8)
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    for pattern, cls in ((r"\p{L}", _LETTER), (r"\p{N}", _NUMBER)):
        table[np.frombuffer("".join(regex.findall(pattern, every)).encode("utf-32-le"), np.uint32)] = cls
    table[_WHITE] = _SPACE
    return table


@cache
def _special_strings(path: str) -> tuple[str, ...]:
    """Added tokens of the tokenizer file; raises if its pre-tokens differ from
    what this module computes."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    pre = spec.get("pre_tokenizer") or {}
    if pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True) or spec.get("normalizer"):
        raise ValueError("only byte-level tokenizers without a normalizer are supported")
    added = spec.get("added_tokens") or []
    if any(t.get("lstrip") or t.get("rstrip") or t.get("single_word") for t in added):
        raise ValueError("added tokens that strip or need word borders are not supported")
    return tuple(t["content"] for t in added)


@cache
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def pretokens(buf: np.ndarray, text_at: np.ndarray, special: tuple[str, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends and text of each pre-token, and per text the number
    of special strings in it (their bytes belong to no pre-token)."""
    n = len(text_at) - 1
    extra = np.zeros(n, np.int64)
    first_byte = np.flatnonzero((buf & 0xC0) != 0x80)
    size = len(first_byte)
    byte_at = np.append(first_byte, len(buf))
    char_at = np.searchsorted(first_byte, text_at)
    if not size:
        empty = np.zeros(0, np.int64)
        return empty, empty, empty, extra
    data = buf.tobytes()
    chars = np.frombuffer(data.decode().encode("utf-32-le"), np.uint32)
    edge = np.zeros(size + 1, bool)
    edge[char_at] = True
    dropped = []
    if any(s.encode() in data for s in special):
        import regex

        finder = regex.compile("|".join(regex.escape(s) for s in sorted(special, key=len, reverse=True)))
        for t in range(n):
            own = data[text_at[t] : text_at[t + 1]]
            if any(s.encode() in own for s in special):
                for m in finder.finditer(own.decode()):
                    a, b = int(char_at[t]) + m.start(), int(char_at[t]) + m.end()
                    edge[[a, b]] = True
                    dropped.append((a, b))
                    extra[t] += 1
    cls = _classes()[chars]
    start = edge.copy()
    start[1:size] |= cls[1:] != cls[:-1]
    # the last character of white space before something else goes with it if it is a space, or stands alone
    before = np.flatnonzero(start[1:size] & ~edge[1:size] & (cls[:-1] == _SPACE))
    start[before] = True
    start[before[chars[before] == 0x20] + 1] = False
    # contractions
    mark = np.flatnonzero((chars == 0x27) & start[:size])
    for tails in (("s", "t", "m", "d"), ("re", "ve", "ll")):
        k = len(tails[0])
        m = mark[mark + k < size]
        inside = np.ones(len(m), bool)
        for j in range(1, k + 1):
            inside &= ~edge[m + j]
        hit = np.zeros(len(m), bool)
        for tail in tails:
            same = inside.copy()
            for j, c in enumerate(tail, 1):
                same &= chars[m + j] == ord(c)
            hit |= same
        start[m[hit] + 1] = False
        start[m[hit] + 1 + k] = True
    at = np.flatnonzero(start[:size])
    end = np.append(at[1:], size)
    if dropped:
        gone = np.zeros(size, bool)
        for a, b in dropped:
            gone[a:b] = True
        at, end = at[~gone[at]], end[~gone[at]]
    return byte_at[at], byte_at[end], np.searchsorted(char_at, at, side="right") - 1, extra


_SCHEMA = "bucket int, chunk long, blob binary, ids array<long>, sizes array<long>, base array<long>"
_ARROW = pa.schema([("bucket", pa.int32()), ("chunk", pa.int64()), ("blob", pa.binary()), ("ids", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64())), ("base", pa.list_(pa.int64()))])


def _planes(values: np.ndarray) -> bytes:
    """Bytes of equal weight side by side, which compress far better."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(len(values), -1).T).tobytes()


def _unplaned(data: bytes, dtype: type) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(size, -1).T).view(dtype).ravel()


def _frequencies(path: str, buckets: int):
    """For each chunk of texts one row with its ids, sizes and special strings, and
    one row for each bucket of pre-tokens: their bytes, lengths and numbers of
    texts, and the texts (places in the chunk) and times of each."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        special = _special_strings(path)
        pack = zstandard.ZstdCompressor(level=3).compress
        chunk = TaskContext.get().partitionId() << 32
        for b in batches:
            buf, offsets = kernel.utf8(b.column(1))
            for whole_lo, whole_hi in kernel.slices(offsets, _CHUNK_BYTES):
                for lo in range(whole_lo, whole_hi, _CHUNK_TEXTS):
                    hi = min(whole_hi, lo + _CHUNK_TEXTS)
                    text_at = offsets[lo : hi + 1] - offsets[lo]
                    own = buf[offsets[lo] : offsets[hi]]
                    start, end, text, extra = pretokens(own, text_at, special)
                    n = hi - lo
                    code, first, piece = np.unique(kernel.range_hashes(own, start, end), return_index=True, return_inverse=True)
                    key, times = np.unique(piece * n + text, return_counts=True)
                    cuts = np.searchsorted(key, np.arange(len(first) + 1) * n)
                    length = (end - start)[first]
                    piece_at = np.concatenate([[0], np.cumsum(length)])
                    data = own[np.arange(int(piece_at[-1])) - np.repeat(piece_at[:-1] - start[first], length)]
                    texts, times = (key % n).astype(np.uint16), times.astype(np.uint32)
                    bucket = ((code >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)  # ascends with the code
                    used, at = np.unique(bucket, return_index=True)
                    blobs = []
                    for s, e in zip(at.tolist(), [*at[1:].tolist(), len(first)], strict=True):
                        fields = (data[piece_at[s] : piece_at[e]].tobytes(), _planes(length[s:e].astype(np.uint32)), _planes(np.diff(cuts[s : e + 1]).astype(np.uint32)), _planes(texts[cuts[s] : cuts[e]]), _planes(times[cuts[s] : cuts[e]]))
                        blobs.append(pack(pickle.dumps((n, *fields))))
                    none = pa.nulls(len(used), pa.list_(pa.int64()))
                    yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(np.full(len(used), chunk)), pa.array(blobs, pa.binary()), none, none, none], schema=_ARROW)
                    yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int32()), pa.array([chunk]), pa.nulls(1, pa.binary()), pa.array([b.column(0)[lo:hi].to_pylist()], pa.list_(pa.int64())), pa.array([np.diff(text_at)], pa.list_(pa.int64())), pa.array([extra], pa.list_(pa.int64()))], schema=_ARROW)
                    chunk += 1

    return run


def _bucket_sums(path: str):
    """Joins the distinct pre-tokens of a bucket, each tokenised once, to the
    frequencies of every chunk; yields tokens per text of the chunk.

    A bucket has 1/buckets of the corpus's distinct pre-tokens; should they
    exceed ``_KNOWN`` all the same, counts are forgotten and made again.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _tokenizer(path)
        encode = getattr(tokenizer, "encode_batch_fast", None) or tokenizer.encode_batch
        pack, unpack = zstandard.ZstdCompressor(level=3).compress, zstandard.ZstdDecompressor().decompress
        known: dict[bytes, int] = {}
        for b in batches:
            sums = []
            for blob in b.column(1):
                n, data, length, uses, texts, times = pickle.loads(unpack(blob.as_py()))
                ends = np.cumsum(_unplaned(length, np.uint32)).tolist()
                pieces = [data[s:e] for s, e in zip([0, *ends], ends, strict=False)]
                new = [p for p in pieces if p not in known]
                if len(known) + len(new) > _KNOWN:
                    known.clear()
                    new = pieces
                for k in range(0, len(new), 2000):
                    part = new[k : k + 2000]
                    known.update(zip(part, (len(e.ids) for e in encode([p.decode() for p in part], add_special_tokens=False)), strict=True))
                tokens = np.fromiter(map(known.__getitem__, pieces), np.int64, len(pieces))
                tokens = np.repeat(tokens, _unplaned(uses, np.uint32)) * _unplaned(times, np.uint32)
                total = np.bincount(_unplaned(texts, np.uint16), tokens, n).astype(np.uint64)
                sums.append(pack(_planes(total)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sums, pa.binary())], ["chunk", "sums"])

    return run


def _totals(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by chunk, the chunk's ids first: one row per text."""
    chunk, ids, sizes, total = None, None, None, None
    names = ["id", "n_bytes", "n_tokens"]
    unpack = zstandard.ZstdDecompressor().decompress

    def result() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([ids, sizes, pa.array(total)], names)

    for b in batches:
        for i in range(b.num_rows):
            if b.column(1)[i].as_py() is not None:
                if ids is not None:
                    yield result()
                chunk, ids, sizes = b.column(0)[i].as_py(), b.column(1)[i].values, b.column(2)[i].values
                total = b.column(3)[i].values.to_numpy().copy()
            else:
                if chunk != b.column(0)[i].as_py():
                    raise RuntimeError("a chunk's ids are missing")
                total += _unplaned(unpack(b.column(4)[i].as_py()), np.uint64).astype(np.int64)
    if ids is not None:
        yield result()


def count_tokens(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", buckets: int | None = None) -> DataFrame:
    """(id, n_bytes, n_tokens) for every row of ``docs``: UTF-8 bytes and tokens of
    the whole text as the tokenizer file gives them, without added special
    tokens.  A special string inside a text is one token, as is the library's
    default.  A null or empty text has no bytes and no tokens.  One output row
    per input row, repeated rows and null ids included; other columns aren't
    read.  ``tokenizer_path`` must be readable on every executor; ``buckets``
    (of pre-tokens) is the session's number of shuffle partitions, at most
    ``MAX_BUCKETS``.
    """
    _special_strings(tokenizer_path)
    buckets = buckets or min(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), MAX_BUCKETS)
    rows = spread(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")))
    table = materialise(rows.mapInArrow(_frequencies(tokenizer_path, buckets), _SCHEMA), "pieces")
    uses = table.where("bucket >= 0").select("bucket", "chunk", "blob").repartition(buckets, "bucket").sortWithinPartitions("bucket")
    partial = uses.select("chunk", "blob").mapInArrow(_bucket_sums(tokenizer_path), "chunk long, sums binary")
    heads = table.where("bucket < 0").select("chunk", "ids", "sizes", "base", F.lit(None).cast("binary").alias("sums"))
    none = F.lit(None).cast("array<long>")
    both = heads.unionByName(partial.select("chunk", none.alias("ids"), none.alias("sizes"), none.alias("base"), "sums"))
    sorted_rows = both.repartition("chunk").sortWithinPartitions("chunk", F.col("ids").isNull())
    return sorted_rows.mapInArrow(_totals, "id long, n_bytes long, n_tokens long").withColumnRenamed("id", id_col)
