"""The decision table of the merge, statement by statement, and its stream."""

import pytest

from chronoloom.operators.fact_merge import Merge, merge_actions, merge_facts, stream_actions


def say(src, dst, at, **more):
    return {"src": src, "rel": "r", "dst": dst, "at": at, "confidence": 0.8, "episode_id": f"e{at}", **more}


def run(statements, **how):
    m = Merge(**how)
    return [m.apply(s) for s in statements], [(f["src"], f["dst"], f["valid_at"], f["invalid_at"], f["belief"]) for f in m.facts], m


def test_skip():
    assert run([say("a", "a", "1"), say("", "b", "1"), say("a", "", "1")])[0] == ["skip"] * 3


def test_retract():
    did, facts, _ = run([say("a", "b", "1"), say("a", "b", "2", status="retracted"), say("a", "c", "3", status="retracted", valid_from="0")])
    assert did == ["open", "retract", "retract_new"]
    assert facts == [("a", "b", "1", "", "retracted"), ("a", "c", "0", "", "retracted")]


def test_weak_statements_dispute():
    did, facts, m = run([say("a", "b", "1", confidence=0.9), say("a", "b", "2", status="retracted", confidence=0.5), say("a", "b", "3", status="ended", confidence=0.5), say("a", "b", "3", status="ended", confidence=0.5)])
    assert did == ["open", "dispute", "dispute", "dispute"] and facts == [("a", "b", "1", "", "asserted")]
    assert m.facts[0]["disputed_by"] == ["e2:retract", "e3:close"]


def test_end():
    did, facts, m = run([say("a", "b", "1"), say("a", "b", "2", status="ended"), say("a", "b", "4", status="ended", valid_to="3")])
    assert did == ["open", "close", "open_closed"]
    assert facts == [("a", "b", "1", "2", "asserted"), ("a", "b", "", "3", "asserted")] and m.facts[0]["closed_by"] == "e2"


def test_backfill():
    did, facts, _ = run([say("a", "b", "5", status="ended"), say("a", "b", "6", valid_from="2")])
    assert did == ["open_closed", "backfill"] and facts == [("a", "b", "2", "5", "asserted")]


def test_confirm_widens():
    did, facts, m = run([say("a", "b", "5", valid_from="4"), say("a", "b", "6", valid_from="4", valid_to="9", confidence=0.95)])
    assert did == ["open", "confirm"] and facts == [("a", "b", "4", "9", "asserted")] and m.facts[0]["confidence"] == 0.95 and m.facts[0]["confirmed_by"] == ["e6"]


def test_repeatable():
    did, facts, _ = run([say("a", "b", "1", valid_from="1"), say("a", "b", "2", valid_from="2"), say("a", "b", "3")])
    assert did == ["open", "open", "confirm"] and len(facts) == 2


def test_functional():
    did, facts, _ = run([say("a", "b", "1"), say("a", "c", "2"), say("a", "c", "3", valid_from="1"), say("a", "d", "4", confidence=0.1)], functional=True)
    assert did == ["open", "open", "confirm", "open"]
    assert facts == [("a", "b", "1", "2", "asserted"), ("a", "c", "1", "", "asserted"), ("a", "d", "4", "", "asserted")]


def test_functional_symmetric():
    did, facts, _ = run([say("a", "b", "1"), say("c", "d", "2"), say("d", "a", "3"), say("b", "a", "4")], functional=True, symmetric=True)
    assert did == ["open", "open", "open", "open"]
    assert facts == [("a", "b", "1", "3", "asserted"), ("c", "d", "2", "3", "asserted"), ("a", "d", "3", "4", "asserted"), ("a", "b", "4", "", "asserted")]


COLUMNS = "src string, rel string, dst string, at string, confidence double, episode_id string, seq long"


def rows(n=200):
    return [(f"n{i * 7 % 5}", "r", f"n{i * 3 % 7}", f"2024-01-{i % 28 + 1:02d}", 0.5 + i % 3 / 10, f"e{i}", i) for i in range(n)]


@pytest.mark.parametrize("functional,symmetric", [(False, False), (True, False), (False, True), (True, True)])
def test_groups_equal_one_fold(spark, functional, symmetric):
    df = spark.createDataFrame(rows(), COLUMNS).repartition(3)
    names = [c.split()[0] for c in COLUMNS.split(", ")]
    m = Merge(functional, symmetric)
    want = {r[6]: m.apply(dict(zip(names, r))) for r in sorted(rows(), key=lambda r: (r[3], r[6]))}
    assert {r.seq: r.action for r in merge_actions(df, functional, symmetric).collect()} == want
    got = sorted((r.src, r.dst, r.valid_at, r.invalid_at, r.belief) for r in merge_facts(df, functional, symmetric).collect())
    assert got == sorted((f["src"], f["dst"], f["valid_at"], f["invalid_at"], f["belief"]) for f in m.facts)


def test_stream(spark, tmp_path):
    parts = [rows()[i : i + 50] for i in range(0, 200, 50)]
    m, names, want = Merge(True), [c.split()[0] for c in COLUMNS.split(", ")], {}
    for i, part in enumerate(parts):
        spark.createDataFrame(part, COLUMNS).coalesce(1).write.mode("append").json(f"{tmp_path}/in/{i}")
        want |= {r[6]: m.apply(dict(zip(names, r))) for r in sorted(part, key=lambda r: (r[3], r[6]))}
    source = spark.readStream.schema(COLUMNS).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).json(f"{tmp_path}/in")
    q = stream_actions(source, functional=True).writeStream.format("memory").queryName("did").outputMode("append").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None
    assert {r.seq: r.action for r in spark.table("did").collect()} == want
