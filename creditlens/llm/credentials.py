"""Secret scans: fixed patterns, and weak candidates that are reported where the parts of one credential meet.

Base spans (assign, access, hex) come from fixed patterns with a check of length and always stay. Each of them, and each weak candidate, is a part
of a credential with a role:

* identifier: access keys (strong); values after words for users, accounts and client ids (weak);
* secret: assignments and long hex runs (strong); values after words for passes and keys, and long runs of mixed letters and digits (weak);
* endpoint: addresses with a scheme, values after words for hosts (weak).

Scopes are the stretches of a text between blank lines. An interval join inside scopes finds which roles lie within ``REACH`` characters of a weak
candidate, and it is reported only when complementary parts co-occur: an identifier needs a secret, a secret an identifier, an
endpoint both; and one of the parts that meet must be strong, or all three roles be there.

The interval join is linear. Parts are cut into bins of ``REACH`` characters, and a bin keeps one row per role: the least start and the largest stop of
its parts decide exactly whether one of them is in reach of a candidate in a neighbouring bin, so no pairs of parts are made, however many
a scope holds. All of it is DataFrame work; patterns are possessive and begin where a run begins, so texts are read once per pattern.

Edge cases: a null or empty text has no spans; repeated rows and rows without id are told apart by file and row number, and get equal spans;
a text without a weak candidate costs no shuffle of parts; an empty table gives an empty result; other columns are not used and may have any name.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from creditlens.llm.text import match_spans, with_row_key
from creditlens.session import write_stage

KEY = ["row_file", "row_no"]
REACH = 400
_VALUE = "[A-Za-z0-9+/_.=-]"
_SET = r"""["']?+\x20*+[:=]\x20*+["']?+"""
_BLOB = "[A-Za-z0-9+/_=-]"
ASSIGN = rf"((?i:password|passwd|secret|token|api_?+key)){_SET}({_VALUE}++)"
# A match begins at the first AKIA of a run, whatever comes before it.
ACCESS = "AKIA[A-Z0-9]++"
HEX = "[0-9a-f]++"
USER = rf"(?<![A-Za-z])(?i:user(?:[_-]?+(?:name|id))?|login|account(?:[_-]?+id)?|client[_-]?+id|(?:access[_-]?+)?key[_-]?+id){_SET}[A-Za-z0-9._@+-]{{3,}}+"
LABELLED = rf"(?<![A-Za-z])(?i:pass(?:code|phrase)?|pwd|pw|(?:access|private|account|shared|signing)[_-]?+key|credentials?|bearer){_SET}[^\s\"',;]{{6,}}+"
# Whole runs with a digit, a small and a capital letter: mixed() checks the rest.
BLOB = rf"(?<!{_BLOB}){_BLOB}{{20,}}+"
ENDPOINT = (
    r"(?<![A-Za-z0-9+.-])[A-Za-z][A-Za-z0-9+.-]*+://[^\s\"'<>]++"
    rf"|(?<![A-Za-z])(?i:host(?:name)?|server|endpoint|url){_SET}[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++(?::[0-9]++)?+"
)
BLANK_LINE = r"\n[\x20\t\r]*+(?=\n)"

PATTERNS = {"assign": ASSIGN, "access": ACCESS, "hex": HEX, "user": USER, "labelled": LABELLED, "blob": BLOB, "endpoint": ENDPOINT}
KINDS = tuple(PATTERNS)
BASE = KINDS[:3]
IDENTIFIER, SECRET, END = "identifier", "secret", "endpoint"
ROLES = {"assign": SECRET, "access": IDENTIFIER, "hex": SECRET, "user": IDENTIFIER, "labelled": SECRET, "blob": SECRET, "endpoint": END}

# What a text must contain for a pattern to be tried.
_HINTS = {"assign": "[:=]", "access": "AKIA", "hex": "[0-9a-f]{24}", "user": "[:=]", "labelled": "[:=]", "blob": rf"{_BLOB}{{20}}", "endpoint": "://|[:=]"}


def _mixed(found: Column) -> Column:
    return found.rlike("[0-9]") & found.rlike("[a-z]") & found.rlike("[A-Z]")


_CHECKS = {
    "assign": lambda s: F.length(F.regexp_extract(s["found"], ASSIGN, 2)) >= 6,
    "access": lambda s: F.length(s["found"]) >= 20,
    "hex": lambda s: F.length(s["found"]) >= 24,
    "blob": lambda s: _mixed(s["found"]),
}


def _in_order(*spans: Column) -> Column:
    order = lambda a, b: F.when((a["start"] < b["start"]) | ((a["start"] == b["start"]) & (a["kind"] < b["kind"])), -1).otherwise(1)
    return F.array_sort(F.concat(*spans), order)


def with_parts(docs: DataFrame, text: str = "text", row_id: str = "doc_id") -> DataFrame:
    """(row_file, row_no, id, base, weak, breaks) of each row: checked base spans, weak candidates and blank lines."""
    rows = with_row_key(docs.select(F.col(row_id).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("whole")))
    none = F.array().cast("array<string>")
    for name, pattern in PATTERNS.items():
        hint = F.contains("whole", F.lit(_HINTS[name])) if name == "access" else F.col("whole").rlike(_HINTS[name])
        rows = rows.withColumn(f"m_{name}", F.when(hint, F.regexp_extract_all("whole", F.lit(pattern), 0)).otherwise(none))
    weak_matches = reduce(lambda a, b: a | b, [F.size(f"m_{k}") > 0 for k in KINDS if k not in BASE])
    rows = rows.withColumn("m_break", F.when(weak_matches, F.regexp_extract_all("whole", F.lit(BLANK_LINE), 0)).otherwise(none))
    spans = {k: match_spans(F.col("whole"), F.col(f"m_{k}"), p, KINDS.index(k)) for k, p in PATTERNS.items()}
    breaks = match_spans(F.col("whole"), F.col("m_break"), BLANK_LINE, len(KINDS))
    found = rows.select(*KEY, "id", *[s.alias(f"s_{k}") for k, s in spans.items()], breaks.alias("breaks"))
    checked = {k: F.filter(f"s_{k}", _CHECKS[k]) if k in _CHECKS else F.col(f"s_{k}") for k in KINDS}
    return found.select(
        *KEY, "id", _in_order(*[checked[k] for k in BASE]).alias("base"), _in_order(*[checked[k] for k in KINDS if k not in BASE]).alias("weak"), "breaks",
    )


def _scoped(parts: DataFrame) -> DataFrame:
    """(key, scope, start, stop, kind, found) of the base spans and of the weak candidates apart from them, of rows with a candidate.

    The parts of one text are put in order; that is no more than the text itself, which is one value.
    """
    each = parts.filter(F.size("weak") > 0).select(*KEY, F.explode(F.concat("base", "weak", "breaks")).alias("p")).select(*KEY, "p.*")
    order = Window.partitionBy(*KEY).orderBy("start", "stop", "kind")
    so_far, to_come = order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(0, Window.unboundedFollowing)
    is_base, is_break = F.col("kind") < len(BASE), F.col("kind") == len(KINDS)
    placed = each.select(
        "*", F.count(F.when(is_break, 1)).over(so_far).alias("scope"),
        F.max(F.when(is_base, F.col("stop"))).over(so_far).alias("base_stop"), F.min(F.when(is_base, F.col("start"))).over(to_come).alias("base_start"),
    )
    apart = (F.coalesce("base_stop", F.lit(0)) <= F.col("start")) & (F.coalesce("base_start", "stop") >= F.col("stop"))
    return placed.filter(~is_break & (is_base | apart)).drop("base_stop", "base_start")


def _named(kinds: dict) -> Column:
    """The value of ``kinds`` for the kind of a row."""
    return F.element_at(F.array(*[F.lit(kinds[k]) for k in KINDS]), F.col("kind") + 1)


def linked(parts: DataFrame, reach: int = REACH) -> DataFrame:
    """The weak candidates among ``parts`` (key, scope, start, stop, kind, found) that complementary parts are in reach of."""
    bin_of = lambda place: F.floor(place / F.lit(reach)).cast("long")
    ready = parts.select("*", _named(ROLES).alias("role"), (F.col("kind") < len(BASE)).alias("strong"))
    # Every part is in all bins that it covers.
    present = (
        ready.withColumn("bin", F.explode(F.sequence(bin_of(F.col("start")), bin_of(F.col("stop") - 1))))
        .groupBy(*KEY, "scope", "bin", "role", "strong").agg(F.min("start").alias("least"), F.max("stop").alias("most"))
    )
    weak = ready.filter("NOT strong").drop("strong").withColumnRenamed("role", "own")
    first, last = bin_of(F.col("start")), bin_of(F.col("stop") - 1)
    asked = weak.withColumn("bin", F.explode(F.sequence(first - 1, last + 1)))
    near = asked.join(present, [*KEY, "scope", "bin"]).filter(
        (F.col("role") != F.col("own"))
        & ((F.col("bin") >= first) | (F.col("start") - F.col("most") < reach)) & ((F.col("bin") <= last) | (F.col("least") - F.col("stop") < reach))
    )
    has = {r: F.max(F.when(F.col("role") == r, F.col("strong").cast("int"))) for r in (IDENTIFIER, SECRET, END)}
    met = near.groupBy(*KEY, "start", "stop", "kind", "found", "own").agg(*[c.alias(f"has_{r}") for r, c in has.items()])
    seen = {r: F.col(f"has_{r}").isNotNull() for r in has}
    strong = (F.coalesce(f"has_{IDENTIFIER}", F.lit(0)) + F.coalesce(f"has_{SECRET}", F.lit(0))) > 0
    rule = (
        F.when(F.col("own") == IDENTIFIER, seen[SECRET] & (strong | seen[END]))
        .when(F.col("own") == SECRET, seen[IDENTIFIER] & (strong | seen[END]))
        .otherwise(seen[IDENTIFIER] & seen[SECRET])
    )
    return met.filter(rule).select(*KEY, "start", "stop", "kind", "found")


def find(docs: DataFrame, text: str = "text", row_id: str = "doc_id", reach: int = REACH) -> DataFrame:
    """(row_file, row_no, id, base, spans) of each row of ``docs``; arrays of (start, stop, kind, found) by start and kind, kind a place in ``KINDS``."""
    parts = write_stage(with_parts(docs, text, row_id), "credential-parts")
    added = linked(write_stage(_scoped(parts), "credential-scopes"), reach)
    added = added.groupBy(*KEY).agg(F.collect_list(F.struct("start", "stop", "kind", "found")).alias("added"))
    joined = parts.select(*KEY, "id", "base").join(added, KEY, "left")
    return joined.select(*KEY, "id", "base", F.when(F.col("added").isNull(), F.col("base")).otherwise(_in_order("base", "added")).alias("spans"))


def listed(spans: Column) -> Column:
    """kind:start:end of the spans, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["stop"])))
