"""Chapters, headings and tables of contents in text."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from veridock.functions import text as T
from veridock.functions import lines as L
from veridock.functions.lines import lines

_CHAPTER = "chapter|chapitre|kapitel|cap[ií]tulo|capitolo|hoofdstuk|ch\\.?"
_UPPER = r"A-ZÀ-Þ0-9\"“("
_EXPLICIT = r"(?iU)^(?:" + _CHAPTER + r")\s*(\d{1,2}|[ivxlcdm]{1,7})\b(.*)$"
_TAIL = rf"^\s*$|^\s*[-.:—–]|^\s+[{_UPPER}]"
_ROMAN_LINE = rf"^([IVXLCDM]+)\s*[.:]\s+[{_UPPER}]"
_ROMAN_MARKED = r"^#{1,6}\s+([ivxlcdm]+)\s*[.:]\s+[A-Za-zÀ-Þ\"“(]"
_HAN = "〇零一二两三四五六七八九十百千"
_HAN_UNITS = "[章回卷节篇讲]"
_HAN_LINE = rf"^第\s*([0-9０-９{_HAN}]+)\s*{_HAN_UNITS}"
_HAN_MARKED = rf"^#{{1,6}}\s+第?\s*([０-９{_HAN}]+)\s*(?:{_HAN_UNITS}|[·、.:：])"
_THAI = r"(?U)^(?:#{1,6}\s+)?(?:ภาคที่|ตอนที่|บทที่|ภาค|ตอน|บท)\s*([0-9๐-๙]+)\b"
_KOREAN = r"^(?:#{1,6}\s+)?제\s*([0-9]+)\s*[관절편장](?:\s*의\s*[0-9]+)?(?:\s+\S|[-.:]|\s*$)"
_MARKER = r"^(?:#{1,6}|={1,6})\s+"
_CONTENTS = ["inhoudsopgave", "sommario", "indice", "inhaltsverzeichnis", "table des matières", "目次", "目錄", "目录", "sumário", "índice", "contents", "table of contents"]
CONTENTS_LINE = r"(?imU)^\s*(?:" + "|".join(_CONTENTS) + r")\s*$"


def _roman(n: int) -> str:
    out = ""
    for value, sign in ((100, "C"), (90, "XC"), (50, "L"), (40, "XL"), (10, "X"), (9, "IX"), (5, "V"), (4, "IV"), (1, "I")):
        out += sign * (n // value)
        n %= value
    return out


def _han(n: int) -> set[str]:
    """Spellings of 1 to 999."""
    digits = "〇一二三四五六七八九"
    h, t, u = n // 100, n // 10 % 10, n % 10
    heads = [""] if not h else [digits[h] + "百"] + (["百"] if h == 1 else [])
    tens = [""] if not t else [digits[t] + "十"] + (["十"] if t == 1 else [])
    zeros = ["", "零", "〇"] if h and not t and u else [""]
    tails = [digits[u]] if u else [""]
    spelled = {a + z + b + c for a in heads for z in zeros for b in tens for c in tails}
    return spelled | {s.replace("二", "两") for s in spelled} | {s for s in [str(n)]}


ROMAN = {_roman(n): n for n in range(1, 201)}
HAN = {s: n for n in range(1, 1000) for s in _han(n)}


_CANDIDATE = r"(?iU)^\s*(?:(?:#{1,6}|={1,6})\s|(?:" + _CHAPTER + r")\s*[\divxlcdm]|[ivxlcdm]+\s*[.:]\s|第|บท|ตอน|ภาค|제)"


def _number_of(line: str) -> int | None:
    import re

    if len(line) > 80:
        return None
    m = re.match(_EXPLICIT.replace("(?iU)", "(?i)"), line)
    if m and re.search(_TAIL, m.group(2)):
        return int(m.group(1)) if m.group(1).isdigit() else ROMAN.get(m.group(1).upper())
    m = re.match(_ROMAN_LINE, line) or re.match(_ROMAN_MARKED, line)
    if m:
        return ROMAN.get(m.group(1).upper())
    m = re.match(_HAN_LINE, line) or re.match(_HAN_MARKED, line)
    if m:
        digits = m.group(1)
        return (int(digits) if 1 <= int(digits) <= 999 else None) if digits.isdigit() else HAN.get(digits)
    m = re.match(_THAI.replace("(?U)", ""), line) or re.match(_KOREAN, line)
    return int(m.group(1)) if m else None


def chapter_number_of(line: str) -> int | None:
    """Number of the chapter that a line is the heading of, else None.  Eight
    languages' chapter words with Arabic or Roman numbers, Roman heads, Chinese,
    Thai and Korean headings, with or without a heading mark."""
    import re

    s = line.strip()
    found = _number_of(s)
    return found if found is not None or not re.match(_MARKER, s) else _number_of(re.sub(_MARKER, "", s, count=1))


@F.pandas_udf(LongType())
def _numbers(lines: pd.Series) -> pd.Series:
    return lines.map(lambda x: None if x is None else chapter_number_of(x)).astype("Int64")


def chapter_lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, line_no, line, number) of the chapter headings.  Only lines that start
    like a heading leave the JVM."""
    rows = lines(docs, id_col, text_col).select("id", "line_no", "line").where(F.col("line").rlike(_CANDIDATE))
    return rows.withColumn("number", _numbers("line")).where("number IS NOT NULL")


def has_contents(text: Column) -> Column:
    """A table-of-contents heading among the first 30,000 characters."""
    return F.coalesce(F.substring(text, 1, 30_000).rlike(CONTENTS_LINE), F.lit(False))


def contents_block(front: Column) -> Column:
    """Front matter from its contents heading on; all of it where there is none."""
    at = F.regexp_instr(front, F.lit(CONTENTS_LINE))
    return F.when(at > 0, F.substring(front, at, F.length(front))).otherwise(front)


def structural_headings(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, line_no, depth, title) of marked and underlined headings outside fenced
    code, found where each text lies."""
    return L.structural_headings(docs, id_col, text_col)


def detect(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, chapters, headings, has_contents): distinct chapter numbers, else the
    distinct headings of the shallowest depth with two of them, else all headings;
    the first ten chapter headings in order.  Null text has none of them."""
    numbered = chapter_lines(docs, id_col, text_col).groupBy("id").agg(F.countDistinct("number").alias("numbered"), F.slice(F.array_sort(F.collect_list(F.struct("line_no", F.trim("line").alias("t")))), 1, 10).alias("heads"))
    by_depth = structural_headings(docs, id_col, text_col).groupBy("id", "depth").agg(F.countDistinct("title").alias("n"))
    level = by_depth.groupBy("id").agg(F.min_by(F.when(F.col("n") >= 2, F.col("n")), F.when(F.col("n") >= 2, F.col("depth"))).alias("shallow"), F.sum("n").alias("all"))
    base = docs.select(F.col(id_col).alias("id"), has_contents(F.col(text_col)).alias("has_contents"))
    out = base.join(numbered, "id", "left").join(level, "id", "left")
    chapters = F.coalesce("numbered", "shallow", "all", F.lit(0)).cast("long")
    return out.select(F.col("id").alias(id_col), chapters.alias("chapters"), F.coalesce(F.transform("heads", lambda h: h["t"]), F.array().cast("array<string>")).alias("headings"), "has_contents")


def discovery_cost(docs: DataFrame, id_col: str, text_col: str, core: int = 4000, chapter: int = 1000) -> DataFrame:
    """Tokens to read everything, the best segment, or a compiled extract.

    Segments start at chapter headings, segment 0 being what comes before.
    Returns (id, dump, front, best, loop, compiled, ratio)."""
    order = Window.partitionBy("id").orderBy("line_no")
    heads = chapter_lines(docs, id_col, text_col).select("id", "line_no", F.lit(1).alias("head"))
    rows = lines(docs, id_col, text_col).join(heads, ["id", "line_no"], "left").withColumn("segment", F.sum(F.coalesce("head", F.lit(0))).over(order))
    words = rows.groupBy("id", "segment").agg(F.sum(T.word_count(F.col("line"))).alias("w")).withColumn("tokens", F.floor(F.col("w") / F.lit(0.75)).cast("long"))
    per = words.groupBy("id").agg(
        F.floor(F.sum("w") / F.lit(0.75)).cast("long").alias("dump"), F.coalesce(F.max(F.when(F.col("segment") == 0, F.col("tokens"))), F.lit(0)).alias("front"),
        F.coalesce(F.max_by(F.struct("segment", "tokens"), F.struct("tokens", -F.col("segment"))), F.struct(F.lit(0).cast("long").alias("segment"), F.lit(0).cast("long").alias("tokens"))).alias("target"),
    )
    best = F.col("front") + F.col("target.tokens")
    return per.select(F.col("id").alias(id_col), "dump", "front", best.alias("best"), (best + F.col("target.tokens")).alias("loop"), F.lit(core + chapter).cast("long").alias("compiled"), F.round(F.col("dump") / F.lit(core + chapter), 1).alias("ratio"))
