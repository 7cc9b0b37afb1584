"""The ordered merge of statements into facts, in batch and as a stream."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from itertools import groupby, islice

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from chronoloom.operators.facts import GATE
from chronoloom.operators.graph import components

STATE = "src string, rel string, dst string, valid_at string, invalid_at string, confidence double, belief string, episode_id string, created_at string, closed_by string, confirmed_by array<string>, disputed_by array<string>"
ACTIONS = "seq long, src string, rel string, dst string, action string"
_NAMES = [f.split()[0] for f in STATE.split(", ")]


class Merge:
    """Facts of one group of statements; open ones are found by key, so a statement costs what it touches."""

    def __init__(self, functional: bool = False, symmetric: bool = False, margin: float = GATE, facts: list[dict] | None = None) -> None:
        self.functional, self.symmetric, self.margin = functional, symmetric, margin
        self.facts: list[dict] = []
        self.same: dict[tuple, list[int]] = {}
        self.open: dict[tuple, dict[int, None]] = {}
        for f in facts or []:
            self._add(f)

    def _ends(self, f: dict) -> list[tuple]:
        return [(f["src"], f["rel"]), (f["dst"], f["rel"])] if self.symmetric else [(f["src"], f["rel"])]

    def _add(self, f: dict) -> None:
        i = len(self.facts)
        self.facts.append(f)
        self.same.setdefault((f["src"], f["rel"], f["dst"]), []).append(i)
        if not f["invalid_at"] and f["belief"] == "asserted":
            for end in self._ends(f):
                self.open.setdefault(end, {})[i] = None

    def _shut(self, i: int) -> None:
        for end in self._ends(self.facts[i]):
            self.open.get(end, {}).pop(i, None)

    def _strong(self, i: int, r: dict, action: str) -> bool:
        f = self.facts[i]
        if r["confidence"] >= f["confidence"] - self.margin:
            return True
        if (note := f"{r['episode_id']}:{action}") not in f["disputed_by"]:
            f["disputed_by"].append(note)
        return False

    def _new(self, r: dict, src: str, dst: str, start: str, end: str, belief: str = "asserted", closed_by: str = "") -> None:
        self._add({"src": src, "rel": r["rel"], "dst": dst, "valid_at": start, "invalid_at": end, "confidence": r["confidence"], "belief": belief, "episode_id": r["episode_id"], "created_at": r["at"], "closed_by": closed_by, "confirmed_by": [], "disputed_by": []})

    def apply(self, r: dict) -> str:
        """Take in one statement and say what it did."""
        src, dst, rel = r["src"], r["dst"], r["rel"]
        if not src or not dst or not rel or src == dst:
            return "skip"
        if self.symmetric and src > dst:
            src, dst = dst, src
        at, ep = r["at"], r["episode_id"]
        first, until, status = r.get("valid_from") or "", r.get("valid_to") or "", r.get("status") or "asserted"
        believed = [i for i in self.same.get((src, rel, dst), []) if self.facts[i]["belief"] == "asserted"]
        open_ = [i for i in believed if not self.facts[i]["invalid_at"]]
        if status == "retracted":
            if not believed:
                self._new(r, src, dst, first, until, "retracted")
                return "retract_new"
            flipped = [i for i in believed if self._strong(i, r, "retract")]
            for i in flipped:
                self.facts[i]["belief"] = "retracted"
                self._shut(i)
            return "retract" if flipped else "dispute"
        if status == "ended":
            if not open_:
                self._new(r, src, dst, first, until or at, closed_by=ep)
                return "open_closed"
            closed = [i for i in open_ if self._strong(i, r, "close")]
            for i in closed:
                self.facts[i].update(invalid_at=until or at, closed_by=ep)
                self._shut(i)
            return "close" if closed else "dispute"
        start = first or at
        if self.functional:
            touched = {i for end in ([(src, rel), (dst, rel)] if self.symmetric else [(src, rel)]) for i in self.open.get(end, {})}
            for i in sorted(touched):
                f = self.facts[i]
                if (f["src"], f["dst"]) != (src, dst) and self._strong(i, r, "supersede"):
                    f.update(invalid_at=start, closed_by=ep)
                    self._shut(i)
        fresh = not self.functional and not self.symmetric and first and all(self.facts[i]["valid_at"] not in ("", first) for i in open_)
        if open_ and not fresh:
            f = self.facts[open_[0]]
            f["confidence"] = max(f["confidence"], r["confidence"])
            if first:
                f["valid_at"] = min(x for x in (f["valid_at"], first) if x)
            if until and not f["invalid_at"]:
                f["invalid_at"] = until
                self._shut(open_[0])
            if ep not in f["confirmed_by"]:
                f["confirmed_by"].append(ep)
            return "confirm"
        for i in believed:
            if self.facts[i]["invalid_at"] and not self.facts[i]["valid_at"]:
                self.facts[i]["valid_at"] = start
                return "backfill"
        self._new(r, src, dst, start, until)
        return "open"


class Bounded(Merge):
    """The merge over connected nodes that keeps only facts a later statement can open, close or date: those open, and those closed without a start.

    The others leave by ``drain``. Only a retraction can still change them, if they are closed, so retractions leave too, in order, for ``_retracted``.
    """

    def __init__(self, margin: float = GATE) -> None:
        super().__init__(True, True, margin)
        self.facts: dict[int, dict] = {}
        self.next = self.place = 0
        self.maybe: list[int] = []
        self.out: list[dict] = []

    def _add(self, f: dict) -> None:
        i, self.next = self.next, self.next + 1
        self.facts[i] = f
        self.same.setdefault((f["src"], f["rel"], f["dst"]), []).append(i)
        self.maybe.append(i)
        if not f["invalid_at"] and f["belief"] == "asserted":
            for end in self._ends(f):
                self.open.setdefault(end, {})[i] = None

    def _shut(self, i: int) -> None:
        for end in self._ends(self.facts[i]):
            at = self.open.get(end, {})
            at.pop(i, None)
            if not at:
                self.open.pop(end, None)
        self.maybe.append(i)

    def _give(self, f: dict, op: int) -> None:
        self.out.append(f | {"place": self.place, "op": op})
        self.place += 1

    def apply(self, r: dict) -> str:
        src, dst = sorted((r["src"], r["dst"])) if r["src"] and r["dst"] else ("", "")
        pair = (src, r["rel"], dst)
        if src and r["rel"] and src != dst and r.get("status") == "retracted":
            known = any(self.facts[i]["belief"] == "asserted" for i in self.same.get(pair, []))
            said = super().apply(r) if known else ""
            self._give({"src": src, "rel": r["rel"], "dst": dst, "valid_at": r.get("valid_from") or "", "invalid_at": r.get("valid_to") or "", "confidence": r["confidence"], "belief": "retracted", "episode_id": r["episode_id"], "created_at": r["at"], "closed_by": "", "confirmed_by": [], "disputed_by": []}, 2 if known else 1)
        else:
            said = super().apply(r)
            if said == "backfill":
                self.maybe += self.same[pair]
        for i in self.maybe:
            f = self.facts.get(i)
            if f and (f["belief"] == "retracted" or f["invalid_at"] and f["valid_at"]):
                self._leave(i)
        self.maybe.clear()
        return said

    def _leave(self, i: int) -> None:
        f = self.facts.pop(i)
        key = (f["src"], f["rel"], f["dst"])
        self.same[key].remove(i)
        if not self.same[key]:
            del self.same[key]
        self._give(f, 0)

    def drain(self) -> list[dict]:
        out, self.out = self.out, []
        return out


def _retracted(rows: Iterator[dict], margin: float) -> Iterator[dict]:
    """Facts (op 0) of one pair and the retractions that met none (1) or some (2) still held, in order: each retraction on the facts before it."""
    believed: list[dict] = []
    for r in rows:
        if not r["op"]:
            if r["belief"] == "asserted":
                believed.append(r)
            else:
                yield r
            continue
        if not believed and r["op"] == 1:
            yield r
        left = []
        for f in believed:
            if r["confidence"] >= f["confidence"] - margin:
                yield f | {"belief": "retracted"}
                continue
            if (note := f"{r['episode_id']}:retract") not in f["disputed_by"]:
                f["disputed_by"].append(note)
            left.append(f)
        believed = left
    yield from believed


def _batches(rows: Iterator[dict], target: pa.Schema) -> Iterator[pa.RecordBatch]:
    while part := list(islice(rows, 5_000)):
        yield pa.RecordBatch.from_arrays([pa.array([r[f.name] for r in part], f.type) for f in target], schema=target)


def _merge_connected(statements: DataFrame, margin: float) -> DataFrame:
    """``merge_facts`` where a group is all nodes connected by a relation: facts leave the fold as soon as only retractions can change them, and meet those by pair."""
    keyed, key = _keyed(statements, True, True)
    named = keyed.withColumn("_key", F.concat_ws("\x02", *[F.coalesce(F.col(k), F.lit("")) for k in key]))
    schema = f"{STATE}, place long, op int"
    held, final = (to_arrow_schema(StructType.fromDDL(x)) for x in (schema, STATE))

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[dict]:
            for _, group in groupby((r for b in batches for s in range(0, b.num_rows, 1000) for r in b.slice(s, 1000).to_pylist()), key=lambda r: r["_key"]):
                merge = Bounded(margin)
                for r in group:
                    merge.apply(r)
                    yield from merge.drain()
                for i in list(merge.facts):
                    merge._leave(i)
                    yield from merge.drain()

        yield from _batches(rows(), held)

    def retract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream = (r for b in batches for s in range(0, b.num_rows, 1000) for r in b.slice(s, 1000).to_pylist())
        yield from _batches((f for _, group in groupby(stream, key=lambda r: (r["src"], r["rel"], r["dst"])) for f in _retracted(group, margin)), final)

    hot = named.repartition("_key").sortWithinPartitions("_key", "at", "seq").mapInArrow(fold, schema)
    return hot.repartition("src", "rel", "dst").sortWithinPartitions("src", "rel", "dst", "place").mapInArrow(retract, STATE)


def _keyed(statements: DataFrame, functional: bool, symmetric: bool) -> tuple[DataFrame, list[str]]:
    """Statements with the least key that their effects stay in."""
    if functional and symmetric:  # a statement touches facts of either end: connected nodes of a relation go together
        pinned = statements.where("src <> '' and dst <> '' and src <> dst").select(F.concat("rel", F.lit("\x01"), "src").alias("src"), F.concat("rel", F.lit("\x01"), "dst").alias("dst"))
        part = components(pinned).withColumnRenamed("component", "_part")
        keyed = statements.withColumn("id", F.concat("rel", F.lit("\x01"), "src")).join(part, "id", "left").drop("id")
        return keyed.withColumn("_part", F.coalesce("_part", F.lit(""))), ["rel", "_part"]
    if functional:
        return statements, ["src", "rel"]
    if symmetric:
        return statements.withColumns({"_lo": F.least("src", "dst"), "_hi": F.greatest("src", "dst")}), ["_lo", "_hi", "rel"]
    return statements, ["src", "dst", "rel"]


def _folded(statements: DataFrame, functional: bool, symmetric: bool, schema: str, fold: Callable[[Iterator[dict]], list[tuple]]) -> DataFrame:
    """``fold`` over each group's statements in order. Groups follow each other in sorted partitions, so thousands of small ones cost no more than their rows."""
    keyed, key = _keyed(statements, functional, symmetric)
    named = keyed.withColumn("_key", F.concat_ws("\x02", *[F.coalesce(F.col(k), F.lit("")) for k in key]))
    target = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream = (r for b in batches for r in b.to_pylist())
        out: list[tuple] = []
        for _, group in groupby(stream, key=lambda r: r["_key"]):
            out += fold(group)
            if len(out) >= 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), target, strict=True)], schema=target)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), target, strict=True)], schema=target)

    return named.repartition("_key").sortWithinPartitions("_key", "at", "seq").mapInArrow(run, schema)


def merge_facts(statements: DataFrame, functional: bool = False, symmetric: bool = False, margin: float = GATE) -> DataFrame:
    """Statements (src, rel, dst, at, seq, confidence, episode_id, and where there status, valid_from, valid_to) folded into
    facts in order of (at, seq): confirm, supersede, close, backfill, retract, dispute."""
    if functional and symmetric:
        return _merge_connected(statements, margin)

    def fold(group: Iterator[dict]) -> list[tuple]:
        merge = Merge(functional, symmetric, margin)
        for r in group:
            merge.apply(r)
        return [tuple(f[n] for n in _NAMES) for f in merge.facts]

    return _folded(statements, functional, symmetric, STATE, fold)


def merge_actions(statements: DataFrame, functional: bool = False, symmetric: bool = False, margin: float = GATE) -> DataFrame:
    """What each statement does: skip, retract, retract_new, close, open_closed, dispute, confirm, backfill or open."""

    def fold(group: Iterator[dict]) -> list[tuple]:
        merge = Merge(functional, symmetric, margin)
        return [(r["seq"], r["src"], r["rel"], r["dst"], merge.apply(r)) for r in group]

    return _folded(statements, functional, symmetric, ACTIONS, fold)


def stream_actions(statements: DataFrame, functional: bool = False, margin: float = GATE) -> DataFrame:
    """``merge_actions`` over a stream: the facts of a key are its state, and nothing expires, since silence never ends a fact.

    Within a micro-batch statements go in order of (at, seq); between batches in order of arrival.
    """
    key = ["src", "rel"] if functional else ["src", "dst", "rel"]

    def run(_: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        merge = Merge(functional, False, margin, json.loads(state.get[0]) if state.exists else None)
        pdf = pd.concat(list(parts)).sort_values(["at", "seq"])
        rows = [(r["seq"], r["src"], r["rel"], r["dst"], merge.apply(r)) for r in pdf.to_dict("records")]
        state.update((json.dumps(merge.facts),))
        yield pd.DataFrame(rows, columns=[f.split()[0] for f in ACTIONS.split(", ")])

    return statements.groupBy(*key).applyInPandasWithState(run, ACTIONS, "facts string", "append", "NoTimeout")
