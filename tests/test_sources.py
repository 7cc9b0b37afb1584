"""Importers, vaults, repositories, the inbox and snapshots on fixtures of our own."""

import json
import subprocess
import zipfile

import pytest
from pyspark.sql import functions as F

from chronoloom.config import Config
from chronoloom.errors import ConfigError
from chronoloom.functions.notes import is_source_path
from chronoloom.operators.snapshots import Store, cache_key, restored
from chronoloom.sources import chats, corpus, vault
from chronoloom.sources import repositories as R
from chronoloom.streaming import inbox

TREE = [{
    "id": "c1", "current_node": "d", "mapping": {
        "a": {"parent": None, "children": ["b"], "message": None},
        "b": {"parent": "a", "children": ["c", "x"], "message": {"author": {"role": "user"}, "create_time": 1704450030, "content": {"content_type": "text", "parts": ["hi"]}}},
        "x": {"parent": "b", "children": [], "message": {"author": {"role": "assistant"}, "content": {"content_type": "text", "parts": ["other branch"]}}},
        "c": {"parent": "b", "children": ["d"], "message": {"author": {"role": "tool", "name": "browser"}, "content": {"content_type": "tether_quote", "parts": ["hidden"]}}},
        "d": {"parent": "c", "children": [], "message": {"author": {"role": "assistant"}, "content": {"content_type": "multimodal_text", "parts": ["see", {"content_type": "image_asset_pointer", "asset_pointer": "file-service://file-1"}]}}},
    },
}]
LIST = [{"uuid": "u1", "chat_messages": [{"sender": "human", "text": "q", "created_at": "2024-01-01T00:00:00Z", "attachments": [{"file_name": "a.txt", "extracted_content": "inside"}, {"file_name": "p.png"}, {"file_name": "z.bin"}, {}]}, {"sender": "assistant", "text": " "}]}, {"uuid": "u2", "chat_messages": []}]
LOG = [{"title": "Asked where", "time": "2024-01-01T00:00:00Z", "subtitles": [{"name": "there"}]}, {"title": "", "time": "x"}]


def test_sniff():
    assert [chats.sniff(x) for x in (TREE, LIST, LOG)] == ["tree", "list", "activity"]
    with pytest.raises(ValueError):
        chats.sniff([{"a": 1}])


def test_paths_of_trees():
    m = TREE[0]["mapping"]
    assert chats.active_path(m, "d") == ["a", "b", "c", "d"]
    assert chats.active_path(m, None) == ["a", "b", "c", "d", "x"]
    assert chats.active_path({"a": {"parent": "b"}, "b": {"parent": "a"}}, "a") == ["b", "a"]


def test_load_chats(spark, tmp_path):
    (tmp_path / "one").mkdir()
    (tmp_path / "one" / "conversations.json").write_text(json.dumps(TREE))
    with zipfile.ZipFile(tmp_path / "two.zip", "w") as z:
        z.writestr("export/conversations.json", json.dumps(LIST))
    (tmp_path / "three.json").write_text(json.dumps(LOG))
    got = sorted((r.conv_id, r.pos, r.role, r.text, list(r.media)) for r in chats.load_chats(spark, str(tmp_path)).collect())
    assert got == [
        ("activity-000000", 0, "user", "where", []), ("activity-000000", 1, "assistant", "there", []),
        ("list-u1", 0, "user", "q\ninside\n[attachment: z.bin]", ["p.png"]), ("tree-c1", 0, "user", "hi", []), ("tree-c1", 1, "assistant", "see", ["file-1"]),
    ]


def test_cycles_end(spark):
    n = spark.createDataFrame([(1, "a", "b"), (1, "b", "a")], "conv_id long, id string, parent string")
    got = chats.path_to_root(n, n.where("id = 'a'")).collect()
    assert sorted((r.up, r.id) for r in got) == [(0, "a"), (1, "b")]


def test_vault(spark, tmp_path):
    root = tmp_path / "notes"
    (root / "sub").mkdir(parents=True)
    (root / ".hidden").mkdir()
    (root / "A.md").write_text("---\ntags: [x, '#y']\ndate: 2024-01-05\naliases: First\n---\n# Title\nsee [[b]] #Y #z ![[p.png]]")
    (root / "sub" / "B.md").write_text("no head [[first]] [[sub/B]] [[gone]]")
    (root / ".hidden" / "c.md").write_text("no")
    (root / "bad.md").write_bytes(b"\xff\xfe bad")
    notes = vault.parsed(vault.load_notes(spark, str(root))).persist()
    got = {r.path: r for r in notes.collect()}
    assert set(got) == {"A.md", "sub/B.md"} and vault.is_vault(spark, str(root))
    a = got["A.md"]
    assert (a.title, a.date, a.tags, a.aliases, a.links, a.images) == ("Title", "2024-01-05", ["x", "y", "z"], ["First"], ["b"], ["p.png"])
    assert got["sub/B.md"].title == "B"
    links = notes.select(F.col("path").alias("src"), F.explode("links").alias("target"))
    assert sorted((r.src, r.target, r.dst) for r in vault.resolved_links(links, vault.link_targets(notes)).collect()) == [("A.md", "b", "sub/B.md"), ("sub/B.md", "first", "A.md"), ("sub/B.md", "gone", None), ("sub/B.md", "sub/B", "sub/B.md")]
    assert "[image: p.png]" in vault.note_items(notes).where("title = 'Title'").first().text


@pytest.fixture
def repo(tmp_path):
    at = str(tmp_path / "repo")
    run = lambda *a: subprocess.run(["git", "-C", at, "-c", "user.name=n", "-c", "user.email=e@x", *a], check=True, capture_output=True)
    subprocess.run(["git", "init", "-q", at], check=True)
    steps = [("a.py", "x = 1\n", "first step"), ("README.md", "hello\n", "docs: readme"), ("a.py", "x = 2\n", "change x")]
    for name, text, subject in steps:
        with open(f"{at}/{name}", "w") as f:
            f.write(text)
        run("add", "-A")
        run("commit", "-q", "-m", subject)
    run("mv", "a.py", "b.py")
    run("commit", "-q", "-m", "move")
    return at


def test_git(spark, repo):
    commits, changes, files = (R.load(spark, repo, t) for t in ("commits", "changes", "files"))
    assert [r.subject for r in commits.orderBy("place").collect()] == ["first step", "docs: readme", "change x", "move"]
    assert [r.subject for r in R.salient(commits, changes, is_source_path(F.col("path"))).orderBy("place").collect()] == ["first step", "change x", "move"]
    new, gone = R.changed_paths(changes)
    assert {r.path for r in new.collect()} == {"a.py", "b.py", "README.md"} and {r.path for r in gone.collect()} == {"a.py"}
    assert {r.path: r.content for r in files.collect()} == {"b.py": "x = 2\n", "README.md": "hello\n"}
    shas = [r.sha for r in commits.orderBy("place").collect()]
    assert R.is_ancestor(repo, shas[0], "HEAD") and not R.is_ancestor(repo, shas[3], shas[0])
    assert "+x = 2" in R.diff(repo, shas[2], ["a.py"], 4000) and len(R.diff(repo, shas[2], ["a.py"], 5)) == 5
    assert R.load(spark, repo, "commits", base=shas[1]).count() == 2


def test_libraries():
    got = R.libraries({"package.json": '{"dependencies": {"A": "1"}}', "requirements.txt": "a==1\nb>2\n# c", "go.mod": "require x.org/y v1", "Cargo.toml": "[dependencies]\nserde = 1\n[x]\nno = 1", "Gemfile": "gem 'rails'", "bad/package.json": "{"})
    assert got == ["serde", "rails", "x.org/y", "A", "b"]


def test_inbox(spark, tmp_path):
    box, ledger = str(tmp_path / "in"), str(tmp_path / "ledger")
    a = inbox.spool(box, "one", "2024-01-02", ["ok.png", "../no.png", "/etc/x"])
    b = inbox.spool(box, "two", "2024-01-01")
    assert [r.id for r in inbox.pending(spark, box, ledger).collect()] == [b, a]
    seen = []
    for _ in range(2):
        inbox.take_in(spark, box, ledger, str(tmp_path / "cp"), lambda df: seen.extend(df.collect())).awaitTermination(60)
    assert sorted((r.id, tuple(r.media)) for r in seen) == sorted([(a, ("ok.png",)), (b, ())])
    waiting, receipts = inbox.status(spark, box, ledger)
    assert waiting == 0 and [r.id for r in receipts.collect()] == [a, b]


def test_store(spark, tmp_path):
    s = Store(spark, str(tmp_path / "store"))
    assert s.read("nodes").count() == 0
    cache = spark.createDataFrame([("h", "n")], "content_hash string, node_id string")
    assert s.save(hash_cache=cache) == 1 and s.save(hash_cache=cache.unionByName(cache)) == 2
    assert s.read("hash_cache").count() == 2 and s.read("hash_cache", 1).count() == 1 and s.versions() == [1, 2]
    key = cache_key("i", ["a"], {"x": 1})
    assert key == cache_key("i", ["a"], {"x": 1}) != cache_key("i", ["b"], {"x": 1})
    assert restored(spark, str(tmp_path / "cache"), key, str(tmp_path / "w")) is None
    Store(spark, f"{tmp_path}/cache/{key}").save(hash_cache=cache)
    assert restored(spark, str(tmp_path / "cache"), key, str(tmp_path / "w")).read("hash_cache").count() == 1


def test_corpus(spark, tmp_path):
    rows = [{"question_id": f"q{i % 2}", "session_id": f"s{i}", "created_at": f"2024-01-0{9 - i}", "text": "t", "is_evidence": i != 1} for i in range(4)]
    (tmp_path / "e.jsonl").write_text("\n".join(map(json.dumps, rows)))
    p = str(tmp_path / "e.jsonl")
    assert corpus.episodes(spark, p).count() == 4 and corpus.episodes(spark, p, "q1").count() == 2 and corpus.episodes(spark, p, limit=0).count() == 0
    assert {r.question_id: r.sessions for r in corpus.evidence(corpus.episodes(spark, p)).collect()} == {"q0": ["s2", "s0"], "q1": ["s3"]}


def test_config():
    assert Config().override("knn=9").knn == 9 and Config().override("ppr_alpha=0.7").ppr_alpha == 0.7
    for bad in ("nope=1", "knn=x", "knn"):
        with pytest.raises(ConfigError):
            Config().override(bad)
