"""Language identification by cross-parsing entropy.

A suffix automaton is built over a bounded sample of labelled text for each
language.  A new text is parsed greedily: from each phrase start the automaton
is followed as long as the text occurs in the language's sample; where it no
longer does, a new phrase starts.  Few long phrases mean familiar text, so the
language that needs the fewest phrases per byte of text wins.

The automaton with its restart rule is a complete transition table, hence the
parse of many pieces of text advances in lockstep with one table lookup per
byte and language.  Texts are cut into pieces of ``PIECE`` bytes, the same for
every language, and all pieces of a text count.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veridock.llm import kernel
from veridock.llm.samples import texts_by_class
from veridock.plans.session import spread

PIECE = 192
#: Bytes of a piece of a training text (up to 3 more, to end with a character).
SAMPLE_PIECE = 240
UNDETERMINED = "und"
_SPACE = 32


def normalise(buf: np.ndarray) -> np.ndarray:
    """Lower-case A-Z and the Latin-1 letters in UTF-8; other ASCII that isn't a
    letter becomes a space."""
    table = kernel.LOWER.copy()
    ascii_other = [b for b in range(128) if not chr(b).isalpha()]
    table[ascii_other] = _SPACE
    out = table[buf]
    if len(out) > 1:
        second = np.zeros(len(out), dtype=bool)
        second[1:] = (buf[:-1] == 0xC3) & (buf[1:] >= 0x80) & (buf[1:] <= 0x9E) & (buf[1:] != 0x97)
        out[second] += 0x20
    return out


def suffix_automaton(text: bytes) -> list[dict[int, int]]:
    """Transitions of the suffix automaton of ``text``; state 0 is the start."""
    nxt: list[dict[int, int]] = [{}]
    link, length = [-1], [0]
    last = 0
    for c in text:
        cur = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p != -1 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p != -1:
            q = nxt[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                clone = len(nxt)
                nxt.append(dict(nxt[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p != -1 and nxt[p].get(c) == q:
                    nxt[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    return nxt


@dataclass
class Language:
    name: str
    #: table[state * width + class] = next state * width, plus the phrases that end with this byte (0 to 2).
    table: np.ndarray


@dataclass
class LanguageModel:
    languages: list[Language]
    classes: np.ndarray  # class of each byte
    width: int  # classes, rounded up to a multiple of 4

    def phrases(self, pieces: np.ndarray, language: Language) -> np.ndarray:
        """Phrases of each column of a (steps, pieces) matrix of byte classes;
        class 0 is padding, which stays where it is and ends no phrase.  The
        phrase that a piece ends in isn't counted."""
        state = np.zeros(pieces.shape[1], dtype=np.int32)
        ended = np.zeros(pieces.shape[1], dtype=np.int32)
        for row in pieces:
            step = language.table[state + row]
            over = step & 3
            ended += over
            state = step - over
        return ended

    def predict(self, column: pa.Array) -> tuple[list[str], np.ndarray]:
        n = len(column)
        names = [x.name for x in self.languages]
        buf, offsets = kernel.utf8(column)
        letters = pc.fill_null(pc.match_substring_regex(column, r"\p{L}"), False).to_numpy(zero_copy_only=False)
        best = [UNDETERMINED] * n
        score = np.zeros(n)
        if not names:
            return best, score
        for lo, hi in kernel.slices(offsets, 4_000_000):
            text = normalise(buf[offsets[lo] : offsets[hi]])
            at = offsets[lo : hi + 1] - offsets[lo]
            sizes = np.diff(at)
            count = -(-sizes // PIECE)
            owner = np.repeat(np.arange(hi - lo), count)
            place = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
            start = at[owner] + place * PIECE
            length = np.minimum(PIECE, at[owner + 1] - start)
            cls = np.append(self.classes[text], 0)
            matrix = np.empty((PIECE, len(owner)), dtype=np.int32)
            for k in range(PIECE):
                matrix[k] = cls[np.where(k < length, start + k, len(text))]
            rates = np.empty((len(names), hi - lo))
            for i, language in enumerate(self.languages):
                total = np.bincount(owner, self.phrases(matrix, language), hi - lo)
                rates[i] = (total + count) / np.maximum(sizes, 1)
            win = rates.argmin(0)
            weight = np.exp(-40.0 * (rates - rates.min(0)))
            top = (1 / weight.sum(0))
            for t in np.flatnonzero(letters[lo:hi]):
                best[lo + t] = names[win[t]]
                score[lo + t] = top[t]
        return best, score


def _sample(texts: list[str], limit: int) -> bytes:
    """All texts if they fit in ``limit`` bytes, else those of their distinct pieces
    that come first by hash, from anywhere in the texts and in the texts' order."""
    whole = [t.encode() for t in texts]
    if sum(map(len, whole)) + len(whole) - 1 <= limit:
        return b" ".join(whole)
    width = max(1, min(SAMPLE_PIECE, limit // 4))
    pieces: dict[bytes, tuple[int, int]] = {}
    for k, text in enumerate(whole):
        at = 0
        while at < len(text):
            end = min(at + width, len(text))
            while end < len(text) and text[end] & 0xC0 == 0x80:  # inside a character
                end += 1
            pieces.setdefault(text[at:end], (k, at))
            at = end
    chosen, size = [], 0
    for piece in sorted(pieces, key=lambda x: (hashlib.blake2b(x).digest(), x)):
        if size + len(piece) > limit:
            break
        chosen.append((*pieces[piece], piece))
        size += len(piece) + 1
    out, after = [], None
    for k, at, piece in sorted(chosen):
        out += [b" "] * (bool(out) and (k, at) != after) + [piece]
        after = k, at + len(piece)
    return b"".join(out)


def train(texts: dict[str, list[str]], sample_bytes: int = 60_000, total_bytes: int = 1_200_000) -> LanguageModel:
    """One automaton for each language over at most ``sample_bytes`` of its texts:
    all of them if they fit, else distinct pieces of ``SAMPLE_PIECE`` bytes chosen
    by hash from everywhere in every text.  All languages together have at most
    ``total_bytes``, which bounds the broadcast tables: beyond 20 languages each
    has ``total_bytes`` divided by their number."""
    raw = {}
    sample_bytes = min(sample_bytes, total_bytes // max(len(texts), 1))
    for name, own in sorted(texts.items()):
        raw[name] = normalise(np.frombuffer(_sample(own, sample_bytes), dtype=np.uint8))
    seen = np.unique(np.concatenate(list(raw.values()) or [np.zeros(0, np.uint8)]))
    # class 0 is padding, class 1 any byte that no sample has
    classes = np.ones(256, dtype=np.int32)
    classes[seen] = np.arange(2, 2 + len(seen))
    width = -(-(2 + len(seen)) // 4) * 4
    languages = []
    for name, sample in raw.items():
        nxt = suffix_automaton(sample.tobytes())
        table = np.full((len(nxt), width), -1, dtype=np.int32)
        for s, moves in enumerate(nxt):
            if moves:
                table[s, classes[list(moves)]] = list(moves.values())
        # where a phrase breaks, the byte starts the next one; a byte unknown to the language is a phrase of its own
        root = np.maximum(table[0], 0)
        ended = np.where(table >= 0, 0, 1 + (table[0] < 0)[None, :])
        ended[0] = table[0] < 0
        full = np.where(table >= 0, table, root[None, :]) * width + ended
        full[:, 0] = np.arange(len(nxt)) * width
        languages.append(Language(name, full.astype(np.int32).ravel()))
    return LanguageModel(languages, classes, width)


def fit(docs: DataFrame, where: Column, id_col: str = "doc_id", text_col: str = "text", class_col: str = "lang", per_language: int = 250, max_chars: int = 4_000) -> LanguageModel:
    """Learn from at most ``per_language`` texts of each language that pass
    ``where`` (a condition on ``id``); of texts longer than ``max_chars``
    characters that many from everywhere in them."""
    return train(texts_by_class(docs, id_col, text_col, class_col, where, per_language, max_chars))


def identify(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score) for every row's whole text.

    ``und`` with score 0 if the text is null or has no letter, or nothing was
    learned; ties go to the alphabetically first language.  One output row per
    input row; other columns aren't read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by sample_bytes a language

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names, score = shared.value.predict(b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(names, pa.string()), pa.array(score)], ["id", "lang_pred", "score"])

    rows = spread(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")))
    return rows.mapInArrow(run, "id long, lang_pred string, score double").withColumnRenamed("id", id_col)
