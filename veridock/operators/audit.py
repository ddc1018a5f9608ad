"""Scans of generated document trees: unsafe text, front matter, tool grants, cost."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veridock.functions import text as T
from veridock.functions.lines import lines

MAX_FILES, MAX_BYTES, MAX_TOTAL = 1000, 2 << 20, 20 << 20
#: Rules for finished documents; they differ from those for sources in that list
#: marks may stand before a message prefix, and answers may be quoted.
SCAN_RULES: tuple[tuple[str, str], ...] = (
    ("prompt.ignore_previous", T.SAFETY_RULES[3][1]),
    ("prompt.disregard_system", T.SAFETY_RULES[1][1]),
    ("prompt.role_reassignment", T.SAFETY_RULES[4][1]),
    ("prompt.fake_system_prefix", r"^\s*(?:[-*]\s*)?(?:system|developer)\s*:"),
    ("prompt.system_tag", T.SAFETY_RULES[5][1]),
    ("prompt.chat_template_tag", T.SAFETY_RULES[0][1]),
    ("prompt.tool_call_tag", T.SAFETY_RULES[6][1]),
)
EXFILTRATION = r"\bexfiltrat(?:e|es|ed|ing|ion)\b"
SENSITIVE = T.SENSITIVE + r"|\bbase64\b"
_FULL_TOOLS = ["Bash", "Edit", "Glob", "Grep", "NotebookEdit", "Read", "Task", "TodoWrite", "WebFetch", "WebSearch", "Write"]
_KEYS = ["allowed-tools", "description", "license", "name"]
#: What a host knows: tools, front matter keys, words that names mustn't hold, its shells, and how it takes unknown tools.
LENSES = {
    "strict": {"tools": _FULL_TOOLS, "keys": _KEYS, "reserved": ["anthropic", "claude"], "shells": ["Bash"], "unknown_is_error": True},
    "tokens": {"tools": ["bash", "shell", "write"], "keys": _KEYS, "reserved": [], "shells": ["bash", "shell"], "unknown_is_error": False},
    "mixed": {"tools": [*_FULL_TOOLS, "shell_command"], "keys": [*_KEYS, "argument-hint", "compatibility"], "reserved": [], "shells": ["Bash", "shell_command"], "unknown_is_error": False},
}
#: Fewest and most tokens of a generated unit, by content and depth.
UNIT_BUDGETS = {("text", "reference"): (800, 1200), ("text", "study"): (1000, 1800), ("technical", "reference"): (1200, 1800), ("technical", "study"): (2000, 3000)}
#: Tokens of a unit that the cost of a generation is estimated with.
UNIT_TOKENS = {"text": 1000, "technical": 1800}


def findings(files: DataFrame, path_col: str = "path", text_col: str = "text") -> DataFrame:
    """(path, line, rule) for every line that meets a scan rule, holds invisible
    characters or sensitive outbound talk, or, in front matter, grants tools or
    lets a model invoke the document.  Sort by lower-case path, line and rule to
    report."""
    own = lines(files, path_col, text_col).select(F.col("id").alias("path"), (F.col("line_no") + 1).alias("line"), F.col("line").alias("s"))
    head = files.select(F.col(path_col).alias("path"), F.size(F.split(F.regexp_extract(text_col, r"(?s)\A\s*---[ \t]*\r?\n(.*?\n)?[ \t]*---[ \t]*(?:\r?\n|\z)", 1), r"\r?\n")).alias("n"), F.col(text_col).rlike(r"(?s)\A\s*---[ \t]*\r?\n(.*?\n)?[ \t]*---[ \t]*(?:\r?\n|\z)").alias("has"))
    rows = own.join(head, "path")
    within = F.col("has") & (F.col("line") >= 2) & (F.col("line") <= F.col("n"))
    s = F.col("s")
    meets = lambda p: s.rlike("(?iU)" + p)
    rules = [F.when(meets(p), F.lit(rule)) for rule, p in SCAN_RULES] + [
        F.when(T.removed_invisible(s) > 0, F.lit("unicode.invisible")),
        F.when(meets(EXFILTRATION) | (meets(T.OUTBOUND) & meets(SENSITIVE)), F.lit("tool.exfiltration_shape")),
        F.when(within & meets(r"^\s*allowed-tools\s*:"), F.lit("frontmatter.allowed_tools")),
        F.when(within & meets(r"^\s*disable-model-invocation\s*:\s*[\"']?(?:false|no|0)[\"']?\s*(?:#.*)?$"), F.lit("frontmatter.model_invocation_enabled")),
    ]
    return rows.select("path", "line", F.explode(F.array_compact(F.array(*rules))).alias("rule"))


def report_order(found: DataFrame) -> DataFrame:
    """Findings in the order of a report."""
    return found.orderBy(F.lower("path"), "line", "rule")


def check_limits(files: DataFrame) -> None:
    """Raises if a tree has too many or too large files (path, length)."""
    r = files.agg(F.count("*").alias("n"), F.max("length").alias("m"), F.sum("length").alias("t")).first()
    if r.n > MAX_FILES or (r.m or 0) > MAX_BYTES or (r.t or 0) > MAX_TOTAL:
        raise ValueError(f"too large to scan: {r.n} files, largest {r.m}, total {r.t} bytes")


def _listed(block: Column) -> Column:
    """Granted tools: a list under the key, else the words behind it."""
    under = F.regexp_extract(block, r"(?m)^allowed-tools:[ \t]*\r?\n((?:[ \t]*-[ \t]*.+(?:\r?\n|\z))+)", 1)
    items = F.regexp_extract_all(under, F.lit(r"(?m)^[ \t]*-[ \t]*(.+?)[ \t]*$"), F.lit(1))
    inline = F.regexp_replace(F.regexp_extract(block, r"(?m)^allowed-tools:[ \t]*(\S.*?)[ \t]*$", 1), r"^[\"']|[\"']$", "")
    return F.when(under != "", items).when(inline != "", F.split(inline, r"\s+")).otherwise(F.array().cast("array<string>"))


def front_matter(files: DataFrame, lens: str = "strict") -> DataFrame:
    """(path, level, problem) of the front matter of each text, seen by one kind of
    host: name and description, granted tools against what the body runs, keys
    that the host ignores, and length."""
    rules = LENSES[lens]
    found = r"(?s)\A---\r?\n(.*?)\r?\n?---"
    rows = files.select("path", "text", F.when(F.col("text").rlike(found), F.regexp_extract("text", found, 1)).alias("block"), F.regexp_replace("text", found, "").alias("body"))
    scalar = lambda key: F.nullif(F.regexp_replace(F.trim(F.regexp_extract("block", rf"(?m)^{key}:[ \t]*(.*?)[ \t]*$", 1)), r"^[\"']+|[\"']+$", ""), F.lit(""))
    texts = lambda values: F.array(*[F.lit(v) for v in values]).cast("array<string>")
    rows = rows.withColumns({"name": scalar("name"), "description": scalar("description"), "grants": _listed(F.col("block")), "keys": F.regexp_extract_all("block", F.lit(r"(?m)^([A-Za-z][\w-]*):"))})
    bases = F.transform("grants", lambda t: F.trim(F.split(t, r"\(")[0]))
    rows = rows.withColumn("bases", bases).withColumn("known", F.array_intersect("bases", texts(rules["tools"]))).withColumn("foreign", F.array_except("bases", texts(rules["tools"])))
    have = F.col("block").isNotNull()
    runs = F.col("body").contains("```bash") | F.col("body").contains("python3 ")
    granted = F.size("grants") > 0
    reserved = F.lit(False)
    for word in rules["reserved"]:
        reserved = reserved | F.lower("name").contains(word)
    problem = lambda test, level, text: F.when(F.coalesce(test, F.lit(False)), F.struct(F.lit(level).alias("level"), F.lit(text).alias("problem")))
    found_problems = [
        problem(~have, "error", "no front matter"), problem(have & F.col("name").isNull(), "error", "no name"), problem(F.length("name") > 64, "error", "name too long"),
        problem(~F.col("name").rlike("^[a-z0-9-]+$"), "error", "name has other characters"), problem(reserved, "error", "name has a reserved word"),
        problem(have & F.col("description").isNull(), "error", "no description"), problem(F.length("description") > 1024, "error", "description too long"),
        problem(have & granted & runs & ~F.arrays_overlap("bases", texts(rules["shells"])), "error", "tools leave out the shell that the body needs"),
        problem(have & granted & (F.size("known") == 0) & F.lit(rules["unknown_is_error"]), "error", "no known tool is granted"), problem(have & (F.size("foreign") > 0), "warning", "unknown tool"),
        problem(have & (F.size(F.array_except("keys", texts(rules["keys"]))) > 0), "warning", "unknown key"), problem(have & (F.size(F.split("text", r"\r\n|[\n\r]")) > 500), "warning", "more than 500 lines"),
    ]
    return rows.select("path", F.explode(F.array_compact(F.array(*found_problems))).alias("f")).select("path", "f.level", "f.problem")


def unit_budget(content: Column, depth: Column) -> Column:
    """(fewest, most) tokens of a generated unit by its content and depth; null for unknown ones."""
    out = F.lit(None).cast("struct<fewest:int,most:int>")
    for (c, d), (low, high) in UNIT_BUDGETS.items():
        out = F.when((content == c) & (depth == d), F.struct(F.lit(low).alias("fewest"), F.lit(high).alias("most"))).otherwise(out)
    return out


def generation_cost(tokens: DataFrame, units: int, technical: bool = False, input_price: float = 3.0, output_price: float = 15.0) -> DataFrame:
    """Input and output tokens and price of a generation from one row per source."""
    each = UNIT_TOKENS["technical" if technical else "text"]
    sums = tokens.agg(F.sum("tokens").alias("t")).select(F.ceil(F.col("t") * 1.3).alias("input_tokens"), F.lit(units * each + 4000 + 4500).cast("long").alias("output_tokens"))
    return sums.withColumn("price", F.round(F.col("input_tokens") / 1e6 * input_price + F.col("output_tokens") / 1e6 * output_price, 4))
