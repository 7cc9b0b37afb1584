"""Notes, links, paths, pages and times, as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from chronoloom.functions.text import trimmed

IMAGE = r"\.(png|jpe?g|gif|webp|svg|bmp)$"
#: Ours: what counts as source code, and paths that never do. A caller may give their own.
SOURCE_SUFFIXES = "py js ts jsx tsx java kt scala go rs c h cc cpp hpp cs rb php swift m mm sh bash sql r jl lua pl hs ml ex exs erl clj dart vue svelte html css scss proto toml yaml yml".split()
NOT_SOURCE = r"(^|/)(node_modules|vendor|third_party|dist|build|\.git)/|\.min\.(js|css)$|(^|/)[^/]*lock(\.json|\.yaml)?$"


def _filled(s: Column) -> Column:
    return F.coalesce(s, F.lit(""))


def list_field(value: Column) -> Column:
    """A list field of a note's head, given as text: parts between commas or blanks, without brackets, quotes and #."""
    parts = F.split(F.regexp_replace(_filled(value), r"[\[\]\"']", ""), r"[,\s]+")
    return F.filter(F.transform(parts, lambda p: F.regexp_replace(p, "^#+", "")), lambda p: p != "")


def without_code(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(_filled(text), r"(?s)```.*?```", " "), r"`[^`\n]*`", " ")


def inline_tags(text: Column) -> Column:
    """#tags that begin with a letter, not inside words, paths or code; each once in order."""
    marked = F.regexp_replace(without_code(text), r"(^|[^\p{L}\p{N}_#/])#([\p{L}])", "$1\x01$2")
    found = F.regexp_extract_all(marked, F.lit("\x01([\\p{L}][\\p{L}\\p{N}_/-]*)"), F.lit(1))
    return F.array_distinct(found)


def wikilinks(text: Column) -> Column:
    """Targets of [[target#heading|alias]]; embedded images are no links."""
    marked = F.regexp_replace(_filled(text), r"!\[\[", "\x01")
    inner = F.regexp_extract_all(marked, F.lit(r"\[\[([^\[\]]+)\]\]"), F.lit(1))
    targets = F.transform(inner, lambda x: F.trim(F.element_at(F.split(F.element_at(F.split(x, r"\|"), 1), "#"), 1)))
    return F.filter(targets, lambda t: (t != "") & ~F.lower(t).rlike(IMAGE))


def image_embeds(text: Column) -> Column:
    """Paths of embedded images in both notations, without remote and inline ones."""
    one = F.regexp_extract_all(_filled(text), F.lit(r"!\[\[([^\]|#]+)[^\]]*\]\]"), F.lit(1))
    two = F.regexp_extract_all(_filled(text), F.lit(r"!\[[^\]]*\]\(([^)\s]+)[^)]*\)"), F.lit(1))
    return F.filter(F.transform(F.concat(one, two), trimmed), lambda p: ~F.lower(p).rlike("^(https?:|data:)"))


def case_distinct(items: Column) -> Column:
    """The first spelling of each item, whatever the case, in order."""
    low = F.transform(items, F.lower)
    return F.filter(items, lambda x, i: F.array_position(low, F.lower(x)) == i + 1)


def urls(text: Column) -> Column:
    """Web addresses, without closing punctuation, each once in order."""
    found = F.regexp_extract_all(_filled(text), F.lit(r"https?://[^\s<>\"')\]}]+"), F.lit(0))
    return F.array_distinct(F.transform(found, lambda u: F.regexp_replace(u, "[.,;:!?]+$", "")))


def is_source_path(path: Column) -> Column:
    suffix = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    return suffix.isin(SOURCE_SUFFIXES) & ~F.lower(path).rlike(NOT_SOURCE)


def note_id(path: Column) -> Column:
    return F.concat(F.lit("obs_"), F.substring(F.sha1(path), 1, 16))


def instant(value: Column) -> Column:
    """A time from seconds since 1970 as a number or text, or an ISO text; null for anything else."""
    v = F.trim(value)
    number = F.when(v.rlike(r"^-?[0-9]+(\.[0-9]+)?$"), F.timestamp_micros((v.try_cast("double") * 1000000).cast("long")))
    return F.coalesce(number, F.when(v.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}"), F.try_to_timestamp(v)))


def note_date(field: Callable[[str], Column], fallback: Column) -> Column:
    """The first head field with a date that isn't empty, without quotes, or the fallback."""
    return F.coalesce(*[F.nullif(F.regexp_replace(field(n), "[\"']", ""), F.lit("")) for n in ("date", "created", "created_at", "date created")], fallback)


def header_date(at: Column) -> Column:
    return F.date_format(at, "yyyy/MM/dd (EEE) HH:mm")


def stripped(html: Column) -> Column:
    """Text of a piece of HTML: tags as blanks, the common entities as characters, blanks at the ends gone."""
    out = F.regexp_replace(_filled(html), "<[^>]*>", " ")
    for name, char in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("#39", "'"), ("nbsp", " "), ("amp", "&")):
        out = F.replace(out, F.lit(f"&{name};"), F.lit(char))
    return F.trim(out)


def visible_text(html: Column) -> Column:
    """What a reader sees of a page, its parts joined by blanks."""
    bare = F.regexp_replace(F.regexp_replace(_filled(html), "(?is)<(script|style|noscript|template|svg|head)[^>]*>.*?</\\1\\s*>", " "), "(?s)<!--.*?-->", " ")
    return F.trim(F.regexp_replace(stripped(bare), r"\s+", " "))


def page_kind(n_chars: Column, n_lines: Column, image_share: Column) -> Column:
    """scanned, mixed, slide or text, by how much text and picture a page has."""
    return F.when((n_chars < 40) & (image_share > 0.2), "scanned").when((image_share >= 0.04) & (n_chars >= 40), "mixed").when((n_chars <= 500) & (n_lines <= 12), "slide").otherwise("text")


def image_type(name: Column, head: Column) -> Column:
    """A picture's MIME type by its suffix, else by its first bytes; null if it is none we know."""
    low, magic = F.lower(name), F.hex(F.substring(head, 1, 12))
    by_name = F.when(low.endswith(".png"), "image/png").when(low.rlike(r"\.jpe?g$"), "image/jpeg").when(low.endswith(".gif"), "image/gif").when(low.endswith(".webp"), "image/webp")
    by_bytes = F.when(magic.startswith("89504E47"), "image/png").when(magic.startswith("FFD8FF"), "image/jpeg").when(magic.startswith("474946"), "image/gif").when(magic.rlike("^52494646.{8}57454250"), "image/webp")
    return F.coalesce(by_name, by_bytes)
