"""Folders of Markdown notes: parsing, links between notes, pictures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronoloom.functions import notes as N


def is_vault(spark: SparkSession, path: str) -> bool:
    """Whether a folder holds notes."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").load(path)
    return not files.select("path").isEmpty()


def load_notes(spark: SparkSession, path: str) -> DataFrame:
    """path (relative), raw and ctime of all notes that aren't in hidden folders."""
    root = path.rstrip("/")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").load(root)
    # what follows the folder's own name
    rel = F.element_at(F.split(F.col("path"), F.lit(root.rsplit("/", 1)[-1] + "/"), 2), -1)
    raw = F.try_validate_utf8("content") if hasattr(F, "try_validate_utf8") else F.decode("content", "UTF-8")
    return files.select(rel.alias("path"), raw.cast("string").alias("raw"), F.col("modificationTime").alias("ctime")).where("raw is not null").where(~F.col("path").rlike(r"(^|/)\."))


def parsed(notes: DataFrame) -> DataFrame:
    """Notes with head fields, body, title, date, tags, aliases, links and pictures. A head that isn't closed is text."""
    head = F.regexp_extract("raw", r"(?s)\A---\r?\n(.*?)\r?\n---[ \t]*(?:\r?\n|\z)", 1)
    body = F.regexp_replace("raw", r"(?s)\A---\r?\n.*?\r?\n---[ \t]*(?:\r?\n|\z)", "")
    field = lambda names: F.trim(F.regexp_extract(head, rf"(?im)^({names}):[ \t]*(.*)$", 2))
    name = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.md$", "")
    title = F.trim(F.regexp_extract(body, r"(?m)^# +(.+)$", 1))
    date = N.note_date(field, F.date_format("ctime", "yyyy-MM-dd"))
    return notes.select(
        N.note_id(F.col("path")).alias("id"), "path", body.alias("body"), F.when(title != "", title).otherwise(name).alias("title"), date.alias("date"),
        N.case_distinct(F.concat(N.list_field(field("tags?")), N.inline_tags(body))).alias("tags"), N.list_field(field("aliases|alias")).alias("aliases"),
        N.wikilinks(body).alias("links"), N.image_embeds(body).alias("images"),
    )


def link_targets(notes: DataFrame) -> DataFrame:
    """One note for each name (kind, key, path): by path, by basename (the shallowest) and by alias."""
    path = F.lower(F.regexp_replace("path", r"\.md$", ""))
    base = notes.select("path", path.alias("p"), F.element_at(F.split(path, "/"), -1).alias("b"), "aliases")
    rank = F.struct(F.size(F.split("path", "/")).alias("depth"), F.col("path").alias("path"))
    by_path = base.select(F.lit("path").alias("kind"), F.col("p").alias("key"), "path")
    by_name = base.groupBy(F.col("b").alias("key")).agg(F.min(rank).alias("m")).select(F.lit("name").alias("kind"), "key", "m.path")
    by_alias = base.select(F.explode("aliases").alias("a"), "path").groupBy(F.lower("a").alias("key")).agg(F.min(rank).alias("m")).select(F.lit("alias").alias("kind"), "key", "m.path")
    return by_path.unionByName(by_name).unionByName(by_alias)


def resolved_links(links: DataFrame, targets: DataFrame) -> DataFrame:
    """Links (src, target) with the note they mean, or null: those with folders by path, then by basename; bare ones by basename, alias, path."""
    key = F.lower(F.regexp_replace("target", r"\.md$", ""))
    asked = links.select("src", "target", key.alias("full"), F.element_at(F.split(key, "/"), -1).alias("bare"), F.contains(key, F.lit("/")).alias("deep"))
    kind = lambda k, c: targets.where(F.col("kind") == k).select(F.col("key").alias(c), F.col("path").alias(f"by_{k}"))
    j = asked.join(kind("path", "full"), "full", "left").join(kind("name", "bare"), "bare", "left").join(kind("alias", "full"), "full", "left")
    return j.select("src", "target", F.when(F.col("deep"), F.coalesce("by_path", "by_name")).otherwise(F.coalesce("by_name", "by_alias", "by_path")).alias("dst"))


def asset_index(files: DataFrame) -> DataFrame:
    """One path for each file name, whatever the case; the first by path."""
    return files.groupBy(F.lower(F.element_at(F.split("path", "/"), -1)).alias("name")).agg(F.min("path").alias("path"))


def note_items(notes: DataFrame) -> DataFrame:
    """Notes as items; pictures are named in place."""
    shown = F.regexp_replace(F.regexp_replace("body", r"!\[\[([^\]|#]+)[^\]]*\]\]", "[image: $1]"), r"!\[[^\]]*\]\(([^)\s]+)[^)]*\)", "[image: $1]")
    return notes.select("id", F.lit("note").alias("kind"), "title", shown.alias("text"), F.col("date").alias("created_at"), "tags", "links")


def first_of_each_name(items: DataFrame, key: str, order: list[str]) -> DataFrame:
    return items.withColumn("_n", F.row_number().over(Window.partitionBy(F.lower(key)).orderBy(*order))).where("_n = 1").drop("_n")
