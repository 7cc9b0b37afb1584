"""Measures of answers and of what was found, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from chronoloom.functions.keys import tokens

#: Ours: words that ask for a sum or a count.
SUM_WORDS = ["total", "altogether", "sum", "how much"]
COUNT_WORDS = ["how many", "count", "number of", "how often"]


def _asks(text: Column, phrases: list[str]) -> Column:
    padded = F.concat(F.lit(" "), F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+", " "), F.lit(" "))
    out = F.lit(False)
    for p in phrases:
        out = out | F.contains(padded, F.lit(f" {p} "))
    return out


def is_aggregate(text: Column) -> Column:
    return _asks(text, SUM_WORDS + COUNT_WORDS)


def question_shape(text: Column) -> Column:
    """sum before count; other questions have neither."""
    return F.when(_asks(text, SUM_WORDS), "sum").when(_asks(text, COUNT_WORDS), "count").otherwise("other")


def article(node_id: Column) -> Column:
    """The document of a chunk's id: no kind before it, no place after it."""
    return F.regexp_replace(F.regexp_replace(node_id, "#.*$", ""), "^(ep|obj)_", "")


def plain_amount(raw: Column) -> Column:
    v = F.regexp_replace(raw, "[,$ ]", "")
    return F.regexp_replace(F.regexp_replace(v, r"(\.[0-9]*[1-9])0+$", "$1"), r"\.0*$", "")


def amounts(text: Column) -> Column:
    """Sums of money of a text, as plain numbers, each once in order."""
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"\$ ?[0-9][0-9,]*(?:\.[0-9]+)?|[0-9][0-9,]*(?:\.[0-9]+)? ?dollars"), F.lit(0))
    return F.array_distinct(F.transform(found, lambda x: plain_amount(F.regexp_replace(x, " ?dollars", ""))))


def evidence_share(expected: Column, text: Column, digits: int = 3) -> Column:
    """The share of the expected answer's tokens, of two letters at least, that a text has; null without any."""
    want = F.array_distinct(F.filter(tokens(F.coalesce(expected, F.lit(""))), lambda t: F.length(t) > 1))
    return F.when(F.size(want) > 0, F.round(F.size(F.array_intersect(want, tokens(F.coalesce(text, F.lit(""))))) / F.size(want), digits))


def response_proxy(answer: Column, expected: Column) -> Column:
    """Whether an answer has the expected number, and which share of the expected words."""
    number = lambda c: F.regexp_extract(c, "[0-9]+(?:\\.[0-9]+)?", 0)
    numeric = F.trim(expected).rlike("^[0-9]+(\\.[0-9]+)?$")
    return F.struct(F.when(numeric, number(answer).try_cast("double") == number(expected).try_cast("double")).alias("number_right"), evidence_share(expected, answer).alias("recall"))


def usage_fields(given: Column, cached: Column, written: Column) -> Column:
    """Input tokens without what was read from or written to the cache."""
    none = lambda c: F.greatest(F.lit(0), F.coalesce(c, F.lit(0)))
    return F.struct(F.greatest(F.lit(0), none(given) - none(cached) - none(written)).alias("fresh"), none(cached).alias("cached"), none(written).alias("written"))


def triage(found: Column, in_context: Column, in_pool: Column, correct: Column) -> Column:
    """Where a question went wrong, the first step that did."""
    return F.when(correct.isNull(), "unscored").when(correct, "ok").when(~in_pool, "not_found").when(~in_context, "not_in_context").when(found < 1, "partial").otherwise("reader")


def matches(name: Column, label: Column, amount: Column) -> Column:
    """Whether a node's name is an occurrence: the same sum, a substring either way, or half of the label's tokens."""
    a, b = F.lower(name), F.lower(label)
    own, want = F.array_distinct(tokens(a)), F.array_distinct(tokens(b))
    same_sum = F.array_contains(amounts(name), amount) & amount.isNotNull()
    return F.coalesce(same_sum, F.lit(False)) | ((b != "") & (F.contains(a, b) | ((a != "") & F.contains(b, a)))) | ((F.size(want) > 0) & (2 * F.size(F.array_intersect(own, want)) >= F.size(want)))
