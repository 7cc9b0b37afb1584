"""Labels, cues, types and surfaces of extractions, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from chronoloom.functions import keys as K
from chronoloom.functions.text import trimmed, words

#: Words before a relation that say it is over.
ENDED_PREFIX = "former|formerly|ex|no longer|used to"
#: Ours: relations that may follow "past" or "once". A caller may give their own.
ONCE_RELATIONS = ["employee of", "works at", "lives in", "member of", "economy", "standard", "promo"]
WEEKDAYS = ["monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday"]
#: Ours: words and patterns of a text worth a closer look, by kind.
CUES = {
    "termination": "(stopped|quit|ended|cancelled|divorced|resigned|no longer|used to|moved out|broke up)",
    "rel_date": "(yesterday|tomorrow|last (week|month|year)|next (week|month|year)|[0-9]+ (days|weeks|months|years) ago)",
    "identity": "(my name is|i am called|nickname|also known as|i go by)",
    "quantity": "([0-9]+([.,][0-9]+)? ?(kg|km|miles|hours|minutes|dollars|euros|percent|%)|[$€][0-9]+)",
}
CUES = {k: f"(^|[^a-z0-9]){v}($|[^a-z0-9])" for k, v in CUES.items()}  # whole words
PRONOUNS = ["i", "me", "my", "you", "he", "she", "it", "we", "they", "him", "her", "us", "them", "user", "assistant"]
#: Pairs of relations that are never one.
OPPOSITES = [("parent", "child"), ("buy", "sell"), ("bought", "sold"), ("love", "hate"), ("like", "dislike"), ("teach", "learn"), ("lend", "borrow"), ("send", "receive"), ("hire", "fire"), ("join", "leave"), ("before", "after"), ("above", "below")]


def coerced_labels(labels: Column, single: Column) -> Column:
    """The labels, each once in order; without any the single one."""
    kept = F.array_distinct(F.filter(F.transform(F.coalesce(labels, F.array().cast("array<string>")), trimmed), lambda x: x != ""))
    alone = F.when(F.trim(single) != "", F.array(F.trim(single))).otherwise(F.array().cast("array<string>"))
    return F.when(F.size(kept) > 0, kept).otherwise(alone)


def base_relation(label: Column, once: list[str] | None = None) -> Column:
    """A label without a prefix that says it is over; "past" and "once" count before known relations only."""
    flat = F.trim(F.regexp_replace(F.lower(label), "[ _-]+", " "))
    bare = F.regexp_replace(flat, f"^({ENDED_PREFIX}) ", "")
    rest = F.regexp_replace(flat, "^(past|once) ", "")
    return F.when(bare != flat, bare).when((rest != flat) & rest.isin(ONCE_RELATIONS if once is None else once), rest).otherwise(flat)


def is_ended(label: Column, once: list[str] | None = None) -> Column:
    return base_relation(label, once) != F.trim(F.regexp_replace(F.lower(label), "[ _-]+", " "))


def status_of(given: Column, ended: Column) -> Column:
    """Retracted before ended before asserted."""
    return F.when(F.lower(given) == "retracted", "retracted").when((F.lower(given) == "ended") | ended, "ended").otherwise("asserted")


def compound_parts(value: Column) -> Column:
    """The parts of a list of weekdays or numbers; all else is one part."""
    flat = F.trim(value)
    parts = F.transform(F.split(flat, r"\s*,\s*|\s+and\s+"), trimmed)
    small = F.forall(parts, lambda p: (p != "") & (F.size(F.split(p, " ")) <= 2) & (F.lower(p).isin(WEEKDAYS) | p.rlike("^[0-9]+( [a-z]+)?$")))
    return F.when((F.size(parts) > 1) & small & (F.size(F.array_distinct(parts)) == F.size(parts)), parts).otherwise(F.array(flat))


def cue_kinds(text: Column) -> Column:
    """Which kinds of cues a text has, in the order of their names."""
    low = F.lower(F.coalesce(text, F.lit("")))
    found = F.array(*[F.when(low.rlike(CUES[k]), F.lit(k)) for k in sorted(CUES)])
    return F.filter(found, lambda k: k.isNotNull())


def has_cue(text: Column) -> Column:
    return F.size(cue_kinds(text)) > 0


def denoised(text: Column) -> Column:
    """A chat without its session header and the speakers' names at line starts."""
    plain = F.regexp_replace(F.coalesce(text, F.lit("")), r"^\[chat session[^\]]*\]\n?", "")
    return F.trim(F.regexp_replace(plain, r"(?m)^(User|Assistant|System): ", ""))


def quantity_text(value: Column, unit: Column) -> Column:
    """A number without empty decimals and its unit."""
    number = F.regexp_replace(value.cast("string"), r"\.0$", "")
    return F.trim(F.concat(number, F.lit(" "), F.coalesce(unit, F.lit(""))))


def embed_surface(kind: Column, title: Column, text: Column, description: Column, long: int = 6000, head: int = 2000) -> Column:
    """What stands for an item in vector space: links and media by their description, long texts by their beginning."""
    return (
        F.when(kind == "link", F.concat_ws("\n", title, description)).when(kind == "media", description)
        .when((description != "") & (kind == "captioned"), F.concat_ws("\n", text, description))
        .when(F.length(text) > long, F.substring(text, 1, head)).otherwise(text)
    )


def modality(path: Column) -> Column:
    low = F.lower(path)
    return F.when(low.rlike(r"\.(png|jpe?g|gif|webp|bmp)$"), "image").when(low.rlike(r"\.pdf$"), "pdf").otherwise("file")


def repo_description(readme: Column, name: Column) -> Column:
    """The first line of a readme that says something, else a plain sentence."""
    first = F.get(F.filter(F.transform(F.split(F.coalesce(readme, F.lit("")), "\n"), lambda x: F.trim(F.regexp_replace(x, "^[# ]+", ""))), lambda x: x != ""), F.lit(0))
    return F.coalesce(first, F.concat(F.lit("A code project named "), name, F.lit(".")))


# ---- relations and entities as keys


def trailing_marker(relation: Column) -> Column:
    """The closing function word of a relation's key, or nothing."""
    last = F.element_at(F.split(K.relation_key(relation), "_"), -1)
    return F.when(last.isin(K.FUNCTION_WORDS) | (last == "by"), last).otherwise("")


def merge_vetoed(a: Column, b: Column, opposites: list[tuple[str, str]] | None = None) -> Column:
    """Whether two relations may not be one: one is empty, only one is passive, they close with other words, or they are opposites."""
    pairs = F.array(*[F.struct(F.lit(p).alias("p"), F.lit(q).alias("q")) for p, q in (OPPOSITES if opposites is None else opposites)])
    forms = lambda v: F.array(v, K.verb_stem(v), K.verb_stem(F.concat(v, F.lit("s"))))
    closing = lambda w: F.when(F.element_at(w, -1).isin([*K.FUNCTION_WORDS, "by"]), F.element_at(w, -1)).otherwise("")

    def rule(k: Column) -> Column:
        wx, wy = F.split(k["x"], "_"), F.split(k["y"], "_")
        opposite = F.exists(pairs, lambda o: (F.arrays_overlap(wx, forms(o["p"])) & F.arrays_overlap(wy, forms(o["q"]))) | (F.arrays_overlap(wx, forms(o["q"])) & F.arrays_overlap(wy, forms(o["p"]))))
        return (k["x"] == "") | (k["y"] == "") | (k["x"].endswith("_by") != k["y"].endswith("_by")) | (closing(wx) != closing(wy)) | opposite

    # an array of one binds the keys, so that each is computed once
    return F.get(F.transform(F.array(F.struct(K.relation_key(a).alias("x"), K.relation_key(b).alias("y"))), rule), F.lit(0))


def types_compatible(existing: Column, incoming: Column) -> Column:
    """Unknown types go with all; others only with themselves."""
    return existing.isNull() | incoming.isNull() | (existing == "other") | (incoming == "other") | (existing == incoming)


def ordered_union(a: Column, b: Column) -> Column:
    none = F.array().cast("array<string>")
    return F.array_distinct(F.concat(F.coalesce(a, none), F.coalesce(b, none)))


def surfaces(text: Column, most: int = 3) -> Column:
    """The first runs of one to ``most`` words of a question, as keys to look up."""
    w = words(F.lower(text))

    def runs_of(n: int) -> Column:
        return F.transform(F.sequence(F.lit(1), F.size(w) - (n - 1)), lambda i: F.array_join(F.slice(w, i, F.lit(n)), " "))

    grams = [runs_of(n) for n in range(1, most + 1)]
    parts = [F.when(F.size(w) >= n, g).otherwise(F.array().cast("array<string>")) for n, g in enumerate(grams, 1)]
    return F.array_distinct(F.concat(*parts))
