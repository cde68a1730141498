"""Personal data: fixed patterns, and further spans by weak supervision.

Base spans (email, ip, card, phone) come from fixed patterns with checks. Further candidates, strings with digits outside the base spans,
are labelled by voters that may abstain: patterns of their shape, a gazetteer of words before them, and their context. Expectation
maximisation estimates how often each voter says what about personal data and about other strings; the resulting
probabilities train a naive Bayes classifier on features of the span, and its verdict adds spans of the kinds secret and contact. What
reaches the driver is one row per combination of votes and features that occur, a number bounded by their definition.

Everything per document is SQL expressions, over whole texts and without a shuffle. Patterns are possessive and anchored so that no text makes
them recurse or scan a run of characters more than a fixed number of times.

Edge cases: a null or empty text has no spans; repeated rows get equal spans; without any candidate nothing is added; an empty
table gives an empty result; columns of the input named like the added ones are replaced.
"""

from __future__ import annotations

import math
from collections import defaultdict

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from creditlens.llm.text import SPAN, match_spans

LOCAL = "[A-Za-z0-9._%+-]"
# A match begins where a run begins or where the last match ended; elsewhere in a run it fails as it did at its begin.
EMAIL = rf"(?:(?<!{LOCAL})|\G){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
# Runs of 12 to 19 digits with single separators; longer and shorter runs are no cards.
CARD = r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?+[0-9]){11,18}+(?![ -]?[0-9])"
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
KINDS = ("email", "ip", "card", "phone", "secret", "contact")

_LOCAL_PHONE = r"(?<![0-9+(])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])"
_BODY = "[A-Za-z0-9_+/-]"
# Whole runs of any length with a digit: looked at only where a run begins, once up to its first digit and once to its end.
CANDIDATE = rf"{_LOCAL_PHONE}|(?<!{_BODY})(?=[A-Za-z_+/-]*+[0-9]){_BODY}{{8,}}+"
LEFT_CHARS = 32

VOTERS = ("shape_key", "shape_phone", "gazetteer", "context", "mixture")
FEATURES = ("length", "digits", "letters", "quoted", "named")
ACCEPT = 0.9


def _digits(found: Column) -> Column:
    return F.regexp_replace(found, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether the check sum of a card number fits."""
    places = F.sequence(F.lit(1), F.length(digits))
    backwards = F.reverse(digits)

    def add(total, i):
        d = F.substr(backwards, i, F.lit(1)).cast("int")
        doubled = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return total + F.when(i % 2 == 0, doubled).otherwise(d)

    return F.aggregate(places, F.lit(0), add) % 10 == 0


_CHECKS = {
    "email": lambda s: F.lit(True),
    "ip": lambda s: F.forall(F.split(s["found"], r"\.", -1), lambda x: x.cast("double") <= 255),
    "card": lambda s: _luhn(_digits(s["found"])),
    "phone": lambda s: F.length(_digits(s["found"])).between(9, 15),
}


def with_spans(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with base (checked spans by start and kind) and candidates (spans outside of base)."""
    whole = F.coalesce(F.col(text), F.lit(""))
    has_digit, has_at = whole.rlike("[0-9]"), F.contains(whole, F.lit("@"))
    patterns = {"email": EMAIL, "ip": IP, "card": CARD, "phone": PHONE, "candidate": CANDIDATE}
    none = F.array().cast("array<string>")
    out = docs.select("*", *[
        F.when(has_at if k == "email" else has_digit, F.regexp_extract_all(whole, F.lit(p), 0)).otherwise(none).alias(f"_{k}") for k, p in patterns.items()
    ])
    out = out.select(*docs.columns, *[
        match_spans(whole, F.col(f"_{k}"), p, KINDS.index(k) if k in KINDS else len(KINDS)).alias(f"_{k}") for k, p in patterns.items()
    ])
    checked = [F.filter(f"_{k}", check) for k, check in _CHECKS.items()]
    order = lambda a, b: F.when((a["start"] < b["start"]) | ((a["start"] == b["start"]) & (a["kind"] < b["kind"])), -1).otherwise(1)
    out = out.select(*docs.columns, F.array_sort(F.concat(*checked), order).alias("base"), F.col("_candidate").alias("candidates"))
    apart = F.filter("candidates", lambda c: ~F.exists("base", lambda b: (b["start"] < c["stop"]) & (c["start"] < b["stop"])))
    return out.withColumn("candidates", apart)


def _described(text: Column, span: Column) -> Column:
    """Votes (1 personal, 0 not, null abstains) and features of a candidate."""
    found = span["found"]
    length, digits = F.length(found), F.length(_digits(found))
    letters = F.length(F.regexp_replace(found, "[^A-Za-z]", ""))
    left_from = F.greatest(span["start"] - LEFT_CHARS, F.lit(0))
    left = F.lower(F.substr(text, (left_from + 1).cast("int"), (span["start"] - left_from).cast("int")))
    key_shape = found.rlike("^(?:[0-9a-f]{32,}|[0-9A-F]{32,})$")
    phone_shape = found.rlike(rf"^{_LOCAL_PHONE}$")
    named = left.rlike(r"(?:token|secret|api.?key|passw(?:or)?d|bearer|auth|tel|phone|mobile|call|ssn|iban|account)[^a-z0-9]{0,6}$")
    plain = left.rlike(r"(?:figure|table|page|chapter|section|version|year|isbn|item|line)[^a-z0-9]{0,6}$|https?://\S*$")
    quoted = left.rlike("""[=:]\\s*["']$""")
    votes = {
        "shape_key": F.when(key_shape, 1).when(length < 16, 0),
        "shape_phone": F.when(phone_shape, 1).when((digits == length) & (length <= 11), 0),
        "gazetteer": F.when(named, 1).when(plain, 0),
        "context": F.when(quoted, 1).when(~left.rlike("""[=:"']\\s*$"""), 0),
        "mixture": F.when((length >= 20) & (digits >= 4) & (letters >= 4), 1).when((digits <= 4) & (length < 16), 0),
    }
    features = {
        "length": F.when(length < 12, 0).when(length < 20, 1).when(length < 32, 2).otherwise(3),
        "digits": F.when(4 * digits < length, 0).when(4 * digits < 3 * length, 1).otherwise(2),
        "letters": F.when(letters == 0, 0).when(found.rlike("[G-Zg-z]"), 2).otherwise(1),
        "quoted": quoted.cast("int"), "named": named.cast("int"),
    }
    return F.struct(
        *[votes[v].alias(v) for v in VOTERS], *[features[f].alias(f"f_{f}") for f in FEATURES], phone_shape.alias("phone"),
    )


def estimate(rows: list[tuple[tuple, tuple, int]], rounds: int = 50) -> dict | None:
    """Classifier from (votes, features, number of candidates) per combination: log-odds, in total and per feature value.

    Expectation maximisation: from the share of votes for it each combination gets a probability; the rates of each voter's
    answers in both classes follow, and from these the probabilities again.
    """
    if not rows:
        return None
    chance = [(sum(v == 1 for v in votes) + 0.5) / (sum(v is not None for v in votes) + 1) for votes, _, _ in rows]
    for _ in range(rounds):
        size = [1.0, 1.0]
        said = [[defaultdict(lambda: 0.5) for _ in VOTERS] for _ in range(2)]
        for (votes, _, n), p in zip(rows, chance):
            for kind, share in ((1, p), (0, 1 - p)):
                size[kind] += n * share
                for i, v in enumerate(votes):
                    said[kind][i][v] += n * share
        for k, (votes, _, _) in enumerate(rows):
            odds = math.log(size[1] / size[0])
            for i, v in enumerate(votes):
                if v is not None:
                    odds += math.log((said[1][i][v] / (size[1] + 1.5)) / (said[0][i][v] / (size[0] + 1.5)))
            chance[k] = 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))
    size = [1.0, 1.0]
    seen = [[defaultdict(lambda: 0.5) for _ in FEATURES] for _ in range(2)]
    values = [set() for _ in FEATURES]
    for (_, features, n), p in zip(rows, chance):
        for kind, share in ((1, p), (0, 1 - p)):
            size[kind] += n * share
            for i, v in enumerate(features):
                values[i].add(v)
                seen[kind][i][v] += n * share
    return {
        "prior": math.log(size[1] / size[0]),
        "features": [{v: math.log((seen[1][i][v] / size[1]) / (seen[0][i][v] / size[0])) for v in sorted(values[i])} for i in range(len(FEATURES))],
    }


def train(docs: DataFrame, text: str = "text") -> dict | None:
    """The span classifier from the candidates of all ``docs``."""
    whole = F.coalesce(F.col(text), F.lit(""))
    found = with_spans(docs.select(text), text).filter(F.size("candidates") > 0)
    described = found.select(F.explode(F.transform("candidates", lambda s: _described(whole, s))).alias("d"))
    counts = described.groupBy(*[F.col(f"d.{v}").alias(v) for v in VOTERS], *[F.col(f"d.f_{f}").alias(f"f_{f}") for f in FEATURES]).count()
    rows = [
        (tuple(r[v] for v in VOTERS), tuple(r[f"f_{f}"] for f in FEATURES), r["count"])
        for r in counts.collect()
    ]
    return estimate(sorted(rows, key=str))


def _accepted(d: Column, model: dict) -> Column:
    odds = F.lit(model["prior"])
    for name, values in zip(FEATURES, model["features"]):
        part = F.lit(0.0)
        for v, x in values.items():
            part = F.when(d[f"f_{name}"] == v, F.lit(x)).otherwise(part)
        odds = odds + part
    return odds >= math.log(ACCEPT / (1 - ACCEPT))


def find(docs: DataFrame, model: dict | None, text: str = "text") -> DataFrame:
    """``docs`` with base and spans, both arrays of (start, stop, kind, found) by start and kind; kind is a place in ``KINDS``."""
    whole = F.coalesce(F.col(text), F.lit(""))
    out = with_spans(docs.drop(*[c for c in ("base", "spans", "candidates") if c != text]), text)
    if model is None:
        return out.withColumn("spans", F.col("base")).drop("candidates")
    named = F.transform("candidates", lambda s: F.struct(s.alias("span"), _described(whole, s).alias("d")))
    added = F.transform(
        F.filter(named, lambda x: _accepted(x["d"], model)),
        lambda x: F.struct(
            x["span"]["start"].alias("start"), x["span"]["stop"].alias("stop"),
            F.when(x["d"]["phone"], KINDS.index("contact")).otherwise(KINDS.index("secret")).alias("kind"), x["span"]["found"].alias("found"),
        ),
    )
    out = out.withColumn("added", F.when(F.size("candidates") > 0, added).otherwise(F.array()).cast(SPAN))
    order = lambda a, b: F.when((a["start"] < b["start"]) | ((a["start"] == b["start"]) & (a["kind"] < b["kind"])), -1).otherwise(1)
    return out.withColumn("spans", F.array_sort(F.concat("base", "added"), order)).drop("candidates", "added")


def listed(spans: Column) -> Column:
    """kind:start:end of the spans, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["stop"])))
