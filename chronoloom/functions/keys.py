"""Match keys of surfaces, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that carry no content inside a relation, in text order.
FUNCTION_WORDS = "is are am was were be been being a an the of with to from in on at for as that who whom which into onto and".split()
#: Relations with one value at a time, and those without direction.
FUNCTIONAL = "lives_in located_in employed_by born_in died_in based_in headquartered_in capital_of ceo_of president_of spouse_of married_to moved_to".split()
SYMMETRIC = "works_with collaborates_with married_to spouse_of sibling_of friend_of is_friend_of friends_with colleague_of partnered_with co_founder_of".split()
#: Names for oneself.
FIRST_PERSON = ["i", "me", "my", "mine", "myself"]
PUNCTUATION = r"[^\p{L}\p{N}_\s]"


def cut(w: Column, n: int) -> Column:
    return F.substring(w, 1, F.length(w) - n)


def singular(w: Column) -> Column:
    return (
        F.when(F.length(w) <= 4, w)
        .when(w.endswith("ies"), F.concat(cut(w, 3), F.lit("y")))
        .when(w.endswith("es") & ~w.endswith("ses") & ~w.endswith("zes"), cut(w, 2))
        .when(w.endswith("s") & ~w.endswith("ss"), cut(w, 1))
        .otherwise(w)
    )


def verb_stem(w: Column) -> Column:
    stem = F.when((F.length(w) > 5) & w.endswith("ing"), cut(w, 3)).when((F.length(w) > 4) & w.endswith("ed"), cut(w, 2)).otherwise(w)
    return singular(stem)


def spaced(s: Column) -> Column:
    plain = F.regexp_replace(F.lower(F.coalesce(s, F.lit(""))), PUNCTUATION, " ")
    return F.trim(F.regexp_replace(plain, r"\s+", " "))


def surface_key(s: Column) -> Column:
    """Lower case, no punctuation, the last token in the singular."""
    words = F.split(spaced(s), " ")
    last = singular(F.element_at(words, -1))
    return F.when(F.size(words) == 1, last).otherwise(F.concat(F.array_join(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))), " "), F.lit(" "), last))


def proper(name: Column, kind: Column) -> Column:
    first = F.substring(F.ltrim(name), 1, 1)
    return F.coalesce(kind.isin("person", "place", "org") & (first == F.upper(first)) & (first != F.lower(first)), F.lit(False))


def entity_key(name: Column, kind: Column) -> Column:
    return F.when(proper(name, kind), spaced(name)).otherwise(surface_key(name))


def relation_name(s: Column) -> Column:
    plain = F.trim(F.regexp_replace(F.lower(F.coalesce(s, F.lit(""))), PUNCTUATION, " "))
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(plain, r"[\s-]+", "_"), "_+", "_"), "^_|_$", "")


def relation_key(s: Column) -> Column:
    """Stems of the content words, with the closing function word."""
    name = relation_name(s)
    words = F.filter(F.split(name, "_"), lambda t: t != "")
    content = F.transform(F.filter(words, lambda t: ~t.isin(FUNCTION_WORDS)), verb_stem)
    last = F.element_at(words, -1)
    closing = F.when(last.isin(FUNCTION_WORDS), F.array(last)).otherwise(F.array().cast("array<string>"))
    return F.when(name == "", F.lit("")).when(F.size(content) == 0, name).otherwise(F.array_join(F.concat(content, closing), "_"))


def char_entropy(s: Column) -> Column:
    """Shannon bits of the characters."""
    chars = F.filter(F.split(F.lower(F.coalesce(s, F.lit(""))), ""), lambda c: c != "")
    n = F.size(chars).cast("double")
    share = F.transform(F.sort_array(F.array_distinct(chars)), lambda c: F.size(F.filter(chars, lambda x: x == c)) / n)
    return -F.aggregate(share, F.lit(0.0), lambda a, p: a + p * F.log2(p))


def idf(total: Column, df: Column) -> Column:
    return F.when(df > 0, F.log(1 + total / df)).otherwise(F.lit(1.0))


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def tokens(s: Column) -> Column:
    return F.regexp_extract_all(F.lower(s), F.lit("[a-z0-9]+"), F.lit(0))
