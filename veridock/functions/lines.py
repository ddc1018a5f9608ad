"""Lines of texts with their places, inside the row: no shuffle, no sort.

Works on the UTF-8 buffers of Arrow string columns.  A line ends at any of the
breaks that Unicode text uses (``\\r\\n`` is one break), and places count
characters.  Nothing depends on ids, so rows that repeat an id stay apart.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veridock.plans.session import spread

_ONE = np.zeros(256, bool)
_ONE[[0x0A, 0x0B, 0x0C, 0x0D, 0x1C, 0x1D, 0x1E]] = True
_SPACES = " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85                 　"
_SLICE = 16_000_000


def _buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    column = pc.fill_null(column, "").cast(pa.large_string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64, len(column) + 1, 8 * column.offset) if len(column) else np.zeros(1, np.int64)
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return buf, at


def _breaks(buf: np.ndarray, text_end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First byte and byte behind each line break."""
    one = np.flatnonzero(_ONE[buf])
    wide = np.flatnonzero(buf == 0xC2)
    wide = wide[wide + 1 < len(buf)]
    next_line = wide[buf[wide + 1] == 0x85]
    wide = np.flatnonzero(buf == 0xE2)
    wide = wide[wide + 2 < len(buf)]
    separators = wide[(buf[wide + 1] == 0x80) & ((buf[wide + 2] == 0xA8) | (buf[wide + 2] == 0xA9))]
    start = np.concatenate([one, next_line, separators])
    end = np.concatenate([one + 1, next_line + 2, separators + 3])
    order = np.argsort(start)
    start, end = start[order], end[order]
    # a line feed right behind a carriage return of the same text belongs to its break
    pair = np.zeros(len(start), bool)
    if len(start) > 1:
        pair[1:] = (buf[start[1:]] == 0x0A) & (buf[start[:-1]] == 0x0D) & (start[1:] == end[:-1]) & ~np.isin(start[1:], text_end)
        first = np.flatnonzero(pair) - 1
        end[first] = end[first + 1]
    return start[~pair], end[~pair]


def cut(column: pa.Array) -> dict[str, np.ndarray | pa.Array]:
    """text (row of the column), line_no, line and start (characters before it) of every line.

    A null text has no line; one that ends in a break has an empty last line.
    """
    buf, at = _buffer(column)
    base = int(at[0])
    buf, at = buf[base : int(at[-1])], at - base
    real = np.flatnonzero(~np.asarray(column.is_null()))
    start, end = _breaks(buf, at[1:-1])
    own = np.searchsorted(at[1:], start, side="right")
    # lines begin at texts and behind breaks, and end at breaks and texts' ends
    text = np.concatenate([real, own])
    begin = np.concatenate([at[real], end])
    order = np.lexsort((begin, text))
    text, begin = text[order], begin[order]
    stop = np.concatenate([at[real + 1], start])
    stop_text = np.concatenate([real, own])
    is_end = np.concatenate([np.ones(len(real), np.int8), np.zeros(len(own), np.int8)])
    stop = stop[np.lexsort((is_end, stop, stop_text))]
    chars = np.append(0, np.cumsum((buf & 0xC0) != 0x80))
    first = np.searchsorted(text, np.arange(len(column)))
    size = stop - begin
    data = buf[np.arange(int(size.sum())) + np.repeat(begin - (np.cumsum(size) - size), size)]
    line = pa.LargeStringArray.from_buffers(len(size), pa.py_buffer(np.append(0, np.cumsum(size)).astype(np.int64)), pa.py_buffer(data))
    return {"text": text, "line_no": np.arange(len(text)) - first[text], "line": line, "start": chars[begin] - chars[at[text]]}


def _last(text: np.ndarray, marked: np.ndarray) -> np.ndarray:
    """For each line the last marked line of its text so far, or -1."""
    place = np.maximum.accumulate(np.where(marked, np.arange(len(text)), -1)) if len(text) else np.zeros(0, np.int64)
    return np.where((place >= 0) & (text[place] == text), place, -1)


def numbered(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Lines of an (id, text) batch with paragraph and section."""
    parts = cut(batch.column(1))
    text, line = parts["text"], parts["line"]
    trimmed = pc.utf8_trim(line, _SPACES)
    full = pc.not_equal(trimmed, "").to_numpy(zero_copy_only=False)
    so_far = np.cumsum(full)
    first = np.searchsorted(text, np.arange(batch.num_rows))
    paragraph = so_far - (so_far - full)[np.minimum(first[text], max(len(text) - 1, 0))] if len(text) else so_far
    heads = pc.starts_with(trimmed, "#").to_numpy(zero_copy_only=False)
    at = np.flatnonzero(heads)
    titles = pc.utf8_trim(pc.utf8_trim(trimmed.take(pa.array(at)), "#"), _SPACES)
    titles = pc.replace_substring_regex(titles, f"[{_SPACES}]+", " ")
    good = pc.not_equal(titles, "").to_numpy(zero_copy_only=False)
    place = np.full(len(text), -1)
    place[at[good]] = np.flatnonzero(good)
    marked = np.zeros(len(text), bool)
    marked[at[good]] = True
    last = _last(text, marked)
    section = titles.take(pa.array(np.where(last >= 0, place[last], 0), mask=last < 0)) if len(titles) else pa.nulls(len(text), pa.large_string())
    i32 = lambda x: pa.array(x.astype(np.int32))
    return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(text)), i32(parts["line_no"]), line.cast(pa.string()), i32(parts["start"]), i32(paragraph), section.cast(pa.string())], ["id", "line_no", "line", "start_offset", "paragraph", "section"])


def _pieces(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The batch in parts of at most ``_SLICE`` bytes of text, or one text."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(1)), 0)).astype(np.int64)
    at, total = 0, 0
    for k, size in enumerate(sizes.tolist()):
        if total and total + size > _SLICE:
            yield batch.slice(at, k - at)
            at, total = k, 0
        total += size
    yield batch.slice(at)


def lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, line_no, line, start_offset, paragraph, section) for every line.

    Offsets count characters of the whole text, line ends as long as they are;
    paragraphs are the non-blank lines so far; the section is the last heading
    with a title.  A null text has no lines.  Each text is cut where it lies.
    """
    kind = docs.select(F.col(id_col)).schema[0].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in _pieces(b):
                yield numbered(part)

    return spread(docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))).mapInArrow(run, f"id {kind}, line_no int, line string, start_offset int, paragraph int, section string")


def _matches(column: pa.Array, pattern: str) -> np.ndarray:
    return pc.match_substring_regex(column, pattern).to_numpy(zero_copy_only=False).astype(bool)


def structural(batch: pa.RecordBatch) -> pa.RecordBatch:
    """(id, line_no, depth, title) of the marked and underlined headings of an
    (id, text) batch, outside fenced code."""
    parts = cut(batch.column(1))
    text = parts["text"]
    s = pc.utf8_trim(parts["line"], _SPACES)
    fence = _matches(s, "^(?:```|~~~)")
    so_far = np.cumsum(fence)
    first = np.searchsorted(text, np.arange(batch.num_rows))
    inside = (so_far - (so_far - fence)[np.minimum(first[text], max(len(text) - 1, 0))]) % 2 == 1 if len(text) else fence
    atx = _matches(s, r"^(?:#{1,6}|={1,6})\s+\S") & ~fence & ~inside
    under = _matches(s, r"^(?:={2,}|-{2,})$")
    size = pc.utf8_length(s).to_numpy()
    above = np.arange(len(text)) - 1
    near = (above >= 0) & (text[above] == text)
    free = np.where(near, ~fence[above] & ~inside[above] & ~atx[above] & ~under[above] & (size[above] > 0) & (size >= size[above]), False)
    lined = under & ~fence & ~inside & free
    at = np.flatnonzero(atx | lined)
    own = s.take(pa.array(np.where(lined[at], above[at], at)))
    marks = pc.utf8_length(pc.replace_substring_regex(s.take(pa.array(at)), r"^(#{1,6}|={1,6}).*$", r"\1")).to_numpy()
    title = pc.replace_substring_regex(pc.replace_substring_regex(own, r"^(?:#{1,6}|={1,6})\s+", ""), r"\s*#*$", "")
    title = pc.utf8_lower(pc.if_else(pa.array(lined[at]), own, title))
    depth = np.where(lined[at], np.where(pc.starts_with(s.take(pa.array(at)), "=").to_numpy(zero_copy_only=False), 1, 2), marks)
    good = lined[at] | (_matches(title, r"[\pL\pN_]") & ~_matches(title, r"^\p{Nd}"))
    at, depth, title = at[good], depth[good], title.filter(pa.array(good))
    row = pa.array(text[at])
    return pa.RecordBatch.from_arrays([batch.column(0).take(row), pa.array(parts["line_no"][at].astype(np.int32)), pa.array(depth.astype(np.int32)), title.cast(pa.string())], ["id", "line_no", "depth", "title"])


def structural_headings(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    kind = docs.select(F.col(id_col)).schema[0].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in _pieces(b):
                yield structural(part)

    return spread(docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))).mapInArrow(run, f"id {kind}, line_no int, depth int, title string")
