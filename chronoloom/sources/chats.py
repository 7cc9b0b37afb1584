"""Chat exports as conversations of messages, and conversations as dated sessions."""

from __future__ import annotations

import io
import json
import zipfile
from collections.abc import Iterator
from itertools import groupby, islice

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from chronoloom.errors import InvalidInput
from chronoloom.functions.notes import header_date

MESSAGES = "conv_id string, pos int, role string, text string, created_at string, media array<string>"
NAMES = ("conversations.json", "chats.json", "messages.json", "activity.json")
HIDDEN_TYPES = ("tether_browsing", "tether_quote", "system_error")
ROLES = {"assistant": "assistant", "model": "assistant", "user": "user", "human": "user", "system": "system", "tool": "tool"}
VERBS = ("Prompted ", "Asked ", "Searched for ", "Said ")



def sniff(data: object) -> str:
    """tree, list or activity, by the first twenty records of an export."""
    rows = [r for r in (data if isinstance(data, list) else [data])[:20] if isinstance(r, dict)]
    if any(isinstance(r.get("mapping"), dict) for r in rows):
        return "tree"
    if any(isinstance(r.get("chat_messages"), list) for r in rows):
        return "list"
    if any(isinstance(r.get("time"), str) and ("title" in r or "titleUrl" in r) for r in rows):
        return "activity"
    raise InvalidInput("neither a tree, a list of messages nor an activity log")


def active_path(mapping: dict, current: str | None) -> list[str]:
    """Node ids from the root to the current node; without a usable one all nodes, parents before children."""
    path: list[str] = []
    node, seen = current, set()
    while node in mapping and node not in seen:
        seen.add(node)
        path.append(node)
        node = mapping[node].get("parent")
    if path:
        return path[::-1]
    out: list[str] = []
    stack = [k for k in reversed(list(mapping)) if mapping[k].get("parent") not in mapping]
    while stack:
        k = stack.pop()
        if k in mapping and k not in out:
            out.append(k)
            stack += reversed(mapping[k].get("children") or [])
    return out


def _tree_message(m: dict | None) -> tuple[str, str, list[str]] | None:
    """role, text and media of a tree's message; null for what a reader never sees."""
    if not m or (m.get("metadata") or {}).get("is_visually_hidden_from_conversation"):
        return None
    content, role = m.get("content") or {}, (m.get("author") or {}).get("role") or "user"
    kind = content.get("content_type") or "text"
    if kind.startswith(HIDDEN_TYPES) or role == "tool" and (m.get("author") or {}).get("name") in ("browser", "web"):
        return None
    parts = content.get("parts") or ([content["text"]] if content.get("text") else [])
    text = "\n".join(p for p in parts if isinstance(p, str) and p.strip())
    media = [p["asset_pointer"].split("://")[-1] for p in parts if isinstance(p, dict) and p.get("content_type") == "image_asset_pointer"]
    if kind in ("code", "execution_output") and text:
        text = f"[{kind}]\n{text}"
    return (ROLES.get(role, "user"), text, media) if text or media else None


def _list_message(m: dict) -> tuple[str, str, list[str]] | None:
    parts = [m.get("text") or "\n".join(c.get("text", "") for c in m.get("content") or [] if isinstance(c, dict))]
    media = []
    for a in (m.get("attachments") or []) + (m.get("files") or []):
        name = a.get("file_name") or ""
        if a.get("extracted_content"):
            parts.append(a["extracted_content"])
        elif name.lower().endswith((".png", ".jpg", ".jpeg", ".gif", ".webp")):
            media.append(name)
        elif name:
            parts.append(f"[attachment: {name}]")
    text = "\n".join(p for p in parts if p and p.strip())
    return (ROLES.get(m.get("sender") or m.get("role") or "", "user"), text, media) if text or media else None


def messages_of(data: object, kind: str) -> Iterator[tuple]:
    """Rows of MESSAGES; conversations without a message give none."""
    rows = data if isinstance(data, list) else [data]
    for n, c in enumerate(rows):
        if kind == "tree":
            found = [(m, node.get("message")) for k in active_path(c["mapping"], c.get("current_node")) if (m := _tree_message((node := c["mapping"][k]).get("message")))]
            for i, ((role, text, media), raw) in enumerate(found):
                yield f"tree-{c.get('conversation_id') or c.get('id') or n}", i, role, text, None if raw.get("create_time") is None else str(raw["create_time"]), media
        elif kind == "list":
            found = [(x, m) for m in c.get("chat_messages") or [] if (x := _list_message(m))]
            for i, ((role, text, media), raw) in enumerate(found):
                yield f"list-{c.get('uuid') or n}", i, role, text, raw.get("created_at"), media
        else:
            said = c.get("title") or ""
            for verb in VERBS:
                said = said.removeprefix(verb)
            reply = c.get("subtitles") or c.get("description") or c.get("snippet") or ""
            reply = " ".join(s.get("name", "") for s in reply) if isinstance(reply, list) else reply
            for i, (role, text) in enumerate([x for x in (("user", said), ("assistant", reply)) if x[1].strip()]):
                yield f"activity-{n:06d}", i, role, text, c.get("time"), []


def _documents(content: bytes, path: str) -> Iterator[bytes]:
    """The JSON texts of an export: the file itself, or the first known name within a zip."""
    if path.lower().endswith(".zip"):
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            names = {n.rsplit("/", 1)[-1]: n for n in z.namelist() if ".." not in n}
            for wanted in NAMES:
                if wanted in names:
                    yield z.read(names[wanted])
                    return
    elif path.rsplit("/", 1)[-1] in NAMES or path.lower().endswith(".json"):
        yield content


def load_chats(spark: SparkSession, path: str, kind: str = "auto") -> DataFrame:
    """Messages of all exports at a path: JSON files, folders of them, zips. Files are read on executors, one at a time."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            for p, content in zip(pdf["path"], pdf["content"], strict=True):
                for body in _documents(bytes(content), p):
                    data = json.loads(body)
                    yield pd.DataFrame(list(messages_of(data, sniff(data) if kind == "auto" else kind)), columns=[c.split()[0] for c in MESSAGES.split(", ")])

    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "content").mapInPandas(run, MESSAGES)


# ---- sessions


def with_sessions(messages: DataFrame, conv: str, order: list[str], at: str, gap_seconds: int = 4 * 3600) -> DataFrame:
    """Messages with the number of their session: a new one after a pause longer than the gap since the last message with a time. One without a time belongs to the session it stands in."""
    w = Window.partitionBy(conv).orderBy(*order)
    seconds = F.unix_micros(F.col(at).cast("timestamp")) / 1000000
    before = F.last(seconds, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.when(seconds.isNotNull() & before.isNotNull() & (seconds - before > gap_seconds), 1).otherwise(0)
    return messages.withColumn("_new", fresh).withColumn("session", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)) + 1).drop("_new")


def session_starts(messages: DataFrame, conv: str, pos: str, at: str) -> DataFrame:
    """The first time that a session's messages have."""
    return messages.groupBy(conv, "session").agg(F.min_by(at, F.when(F.col(at).isNotNull(), F.col(pos))).alias("start"))


def rendered_sessions(messages: DataFrame, conv: str, pos: str, at: str) -> DataFrame:
    """A session as text: a header with its date and a line for each message that says something; sessions of none are left out."""
    lines = F.transform(F.array_sort(F.collect_list(F.when(F.trim("text") != "", F.struct(pos, "role", "text")))), lambda m: F.concat(F.initcap(m["role"]), F.lit(": "), F.trim(m["text"])))
    each = messages.groupBy(conv, "session").agg(F.min_by(at, F.when(F.col(at).isNotNull(), F.col(pos))).alias("start"), lines.alias("lines")).where(F.size("lines") > 0)
    head = F.when(F.col("start").isNull(), "[chat session]").otherwise(F.concat(F.lit("[chat session — "), header_date(F.col("start")), F.lit("]")))
    return each.select(conv, "session", "start", F.concat(head, F.lit("\n"), F.array_join("lines", "\n")).alias("text"))


def session_items(sessions: DataFrame, conv: str) -> DataFrame:
    """Items of sessions: a conversation with one keeps its id, others get #s01, #s02, ..."""
    n = F.count("*").over(Window.partitionBy(conv))
    place = F.row_number().over(Window.partitionBy(conv).orderBy("session"))
    name = F.col(conv).cast("string")
    return sessions.withColumn("id", F.when(n == 1, name).otherwise(F.concat(name, F.format_string("#s%02d", place)))).withColumn("source_ref", F.concat(F.lit("import:"), name))


def path_to_root(nodes: DataFrame, starts: DataFrame) -> DataFrame:
    """Ancestors of start nodes (conv_id, id) over nodes (conv_id, id, parent), with their distance; cycles end where they close. A conversation is walked where its nodes come together, however deep it is."""
    kinds = dict(nodes.dtypes)
    out = f"conv_id {kinds['conv_id']}, id {kinds['id']}, up int"
    target = to_arrow_schema(StructType.fromDDL(out))
    rows = nodes.select("conv_id", "id", F.col("parent").cast(kinds["id"]).alias("parent"), F.lit(False).alias("start"))
    rows = rows.unionByName(starts.select("conv_id", "id", F.lit(None).cast(kinds["id"]).alias("parent"), F.lit(True).alias("start")))

    def walk(conv: object, group: Iterator[dict]) -> Iterator[tuple]:
        above: dict = {}
        first = []
        for r in group:
            if r["start"]:
                first.append(r["id"])
            elif conv is not None and r["id"] is not None and r["parent"] is not None:
                above.setdefault(r["id"], []).append(r["parent"])
        for id_ in first:
            here = [(id_, 0, {id_})]
            while here:
                at, up, seen = here.pop()
                yield conv, at, up
                onward = [p for p in above.get(at, ()) if p not in seen]
                here += [(p, up + 1, seen | {p} if len(onward) > 1 else seen) for p in onward]
                if len(onward) == 1:
                    seen.add(onward[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream = (r for b in batches for r in b.to_pylist())
        walked = (x for conv, group in groupby(stream, key=lambda r: r["conv_id"]) for x in walk(conv, group))
        while part := list(islice(walked, 10_000)):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*part, strict=True), target, strict=True)], schema=target)

    return rows.repartition("conv_id").sortWithinPartitions("conv_id").mapInArrow(run, out)


def role_of(role: Column) -> Column:
    low = F.lower(role)
    return F.when(low.isin("assistant", "model"), "assistant").when(low.isin("system", "tool"), low).otherwise("user")
