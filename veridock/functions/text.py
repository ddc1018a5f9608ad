"""Column functions for text: sanitising, normal form, tokens, safety rules.

Patterns are Java regular expressions.  ``U`` makes classes Unicode-aware, and
words are ``[\\p{L}\\p{N}_]`` because Java's own ``\\w`` differs from it.
"""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

WORD = r"[\p{L}\p{N}_]"
SPACE = r"(?U)[\s\x1c-\x1f]+"
STOP_WORDS = ("the a an and or of in on at to from for by with as is are be it that can under").split()
_INVISIBLE = (
    r"\x{00AD}\x{034F}\x{180E}\x{200B}-\x{200D}\x{2060}-\x{2064}\x{FEFF}"  # zero width
    r"\x{061C}\x{200E}\x{200F}\x{202A}-\x{202E}\x{2066}-\x{2069}"  # direction
    r"\x{115F}\x{1160}\x{3164}\x{FFA0}\x{E0000}-\x{E007F}"  # fillers, tags
)
_CJK = r"[\x{3000}-\x{30FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{AC00}-\x{D7A3}\x{F900}-\x{FAFF}\x{FF00}-\x{FFEF}]"


def sanitize(text: Column) -> Column:
    """Text without invisible, direction and tag characters."""
    return F.regexp_replace(text, f"[{_INVISIBLE}]", "")


def removed_invisible(text: Column) -> Column:
    """Number of characters that :func:`sanitize` drops."""
    return F.length(text) - F.length(sanitize(text))


def collapse(text: Column) -> Column:
    """White space runs to one blank, none at the ends."""
    return F.trim(F.regexp_replace(text, SPACE, " "))


def tidy(text: Column) -> Column:
    """Claim wording: trimmed, final marks dropped, white space collapsed."""
    return collapse(F.regexp_replace(collapse(text), r"[.!?]+$", ""))


def tidy_words(text: Column) -> Column:
    """:func:`tidy` of words that single blanks part."""
    return F.trim(F.rtrim(F.trim(text), F.lit(".!?")))


def normalized(text: Column) -> Column:
    """Case-folded words joined by blanks.  Native form: exact for text in NFKC
    whose only special fold is the sharp s; :func:`normalized_exact` has the rest."""
    folded = F.replace(F.lower(text), F.lit("ß"), F.lit("ss"))
    return F.trim(F.regexp_replace(folded, r"[^\p{L}\p{N}_]+", " "))


@F.pandas_udf(StringType())
def normalized_exact(text: pd.Series) -> pd.Series:
    """As :func:`normalized` for any Unicode text (compatibility form, full folding)."""
    import unicodedata

    import regex

    gap = regex.compile(r"[^\w]+")
    return text.map(lambda t: None if t is None else gap.sub(" ", unicodedata.normalize("NFKC", t).casefold()).strip())


@F.pandas_udf(StringType())
def folded_exact(text: pd.Series) -> pd.Series:
    """Compatibility form with full case folding of any Unicode text."""
    import unicodedata

    return text.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t).casefold())


@F.pandas_udf(ArrayType(StringType()))
def folded_all_exact(texts: pd.Series) -> pd.Series:
    """:func:`folded_exact` of every text of an array."""
    import unicodedata

    return texts.map(lambda own: None if own is None else [None if t is None else unicodedata.normalize("NFKC", t).casefold() for t in own])


def content_tokens(normal: Column) -> Column:
    """Distinct words of a normal form without stop words; none for null."""
    words = F.array_except(F.array_distinct(F.split(F.coalesce(normal, F.lit("")), " ")), F.array(*[F.lit(w) for w in [*STOP_WORDS, ""]]))
    return words


def soft_keys(normal: Column) -> Column:
    """Two token sets overlap softly iff these keys do: short words whole, others by four letters."""
    return F.array_distinct(F.transform(content_tokens(normal), lambda t: F.when(F.length(t) < 4, t).otherwise(F.left(t, F.lit(4)))))


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"(?U)[^\s\x1c-\x1f]+"))


def estimate_tokens(text: Column) -> Column:
    """Words at 0.75 a token; CJK characters at 1.5 a token beside the other words."""
    cjk = F.regexp_count(text, F.lit(_CJK))
    latin = word_count(F.regexp_replace(text, _CJK, " "))
    estimate = F.when(cjk == 0, F.floor(word_count(text) / F.lit(0.75))).otherwise(F.floor(latin / F.lit(0.75) + cjk / F.lit(1.5)))
    return F.coalesce(estimate, F.lit(0)).cast("long")


def plain_estimate(text: Column) -> Column:
    """Words at 0.75 a token, whatever the script."""
    return F.coalesce(F.floor(word_count(text) / F.lit(0.75)), F.lit(0)).cast("long")


#: (rule, pattern): instruction-shaped text.
SAFETY_RULES: tuple[tuple[str, str], ...] = (
    ("prompt.chat_template", r"<\|\s*im_start\s*\|>|\[\s*INST\s*\]"),
    ("prompt.disregard_system", r"\bdisregard\s+(?:the\s+)?(?:system|developer)\b"),
    ("prompt.fake_message_prefix", r"^\s*(?:system|developer|assistant)\s*:"),
    ("prompt.ignore_previous", r"\bignore\s+(?:(?:all|any|the)\s+)?(?:previous|prior)\s+(?:instruction|prompt|rule|message)s?\b"),
    ("prompt.role_reassignment", r"\byou\s+are\s+now\b"),
    ("prompt.system_tag", r"<\s*/?\s*system\b[^>]*>"),
    ("prompt.tool_control", r"\btool[-_ ]?call\b"),
)
OUTBOUND = r"https?://|\b(?:curl|wget|send|post|upload|transmit)\b"
SENSITIVE = r"\bapi[-_ ]?keys?\b|\bcredentials?\b|\bsecrets?\b|\.env\b"


def safety_rules(text: Column) -> Column:
    """Sorted ids of the safety rules that a text meets."""
    hits = [F.when(text.rlike("(?iU)" + p), F.lit(rule)) for rule, p in SAFETY_RULES]
    leak = F.when(text.rlike("(?iU)" + OUTBOUND) & text.rlike("(?iU)" + SENSITIVE), F.lit("tool.exfiltration_shape"))
    return F.filter(F.array(*hits, leak), lambda x: x.isNotNull())


def lemma(verb: Column) -> Column:
    """Third-person endings dropped: -ies to -y, -es, -s (by length)."""
    v, n = F.lower(verb), F.length(verb)
    return F.when(v.endswith("ies") & (n > 4), F.concat(F.substring(v, F.lit(1), n - 3), F.lit("y"))).when(v.endswith("es") & (n > 4), F.substring(v, F.lit(1), n - 2)).when(v.endswith("s") & (n > 3), F.substring(v, F.lit(1), n - 1)).otherwise(v)


@F.pandas_udf(StringType())
def slug(text: pd.Series) -> pd.Series:
    """ASCII slug of at most 64 characters; a hashed one where nothing is left."""
    import hashlib
    import re
    import unicodedata

    def one(t):
        if t is None:
            return None
        ascii_text = unicodedata.normalize("NFKD", t).encode("ascii", "ignore").decode().lower()
        s = re.sub(r"[^a-z0-9]+", "-", ascii_text).strip("-")[:64].rstrip("-")
        return s or "item-" + hashlib.sha256(t.encode()).hexdigest()[:12]

    return text.map(one)


def is_absolute_ref(ref: Column) -> Column:
    return ref.rlike(r"^(?:[/\\~]|[A-Za-z]:[/\\])") | F.lower(ref).startswith("file:")


def portable_ref(ref: Column) -> Column:
    """A reference fit for publication: no user part, query or fragment; absolute
    or climbing paths are null."""
    uri = ref.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://")
    bare = F.regexp_replace(ref, r"[?#].*$", "")
    unsafe = is_absolute_ref(ref) | ref.rlike(r"(^|[/\\])\.\.([/\\]|$)")
    return F.when(uri, F.when(~ref.rlike(r"^[^/]*//[^/]*@"), bare)).when(~unsafe, ref)


def escape_markdown(text: Column) -> Column:
    return F.regexp_replace(text, r"([\\`*_{}\[\]<>#|])", r"\\$1")


def first_of(*candidates: Column) -> Column:
    return reduce(lambda a, b: F.coalesce(a, b), candidates)
