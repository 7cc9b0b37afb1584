"""Graph tables: nodes (id, ntype, name, valid), edges (src, dst, etype, rel, confidence, weight, episode_id) and facts, stored and read."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoloom.operators.facts import active
from chronoloom.operators.graph import both_ways, hops
from chronoloom.operators.ranking import overlaps

# ---- nodes and edges


def add_nodes(base: DataFrame, delta: DataFrame) -> DataFrame:
    """The nodes with those of delta added, or in place of the ones with their id."""
    return base.join(delta.select("id"), "id", "left_anti").unionByName(delta)


def remove_nodes(nodes: DataFrame, edges: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes without the given ids, and edges without those that touch them."""
    left = edges.join(ids.select(F.col("id").alias("src")), "src", "left_anti").join(ids.select(F.col("id").alias("dst")), "dst", "left_anti")
    return nodes.join(ids, "id", "left_anti"), left


def edge_key(etype: Column, rel: Column, valid_at: Column, seq: Column) -> Column:
    """What tells parallel edges of a pair apart."""
    return F.concat_ws("|", etype, rel, F.coalesce(valid_at, F.lit("")), F.coalesce(seq.cast("string"), F.lit("")))


def pair_relations(facts: DataFrame) -> DataFrame:
    return facts.groupBy("src", "dst").agg(F.array_join(F.array_sort(F.collect_set("rel")), ",").alias("rels"))


def nodes_of_type(nodes: DataFrame, ntype: str, valid_only: bool = True) -> DataFrame:
    found = nodes.where(F.col("ntype") == ntype)
    return found.where("valid") if valid_only else found


def invalidate(nodes: DataFrame, ids: DataFrame) -> DataFrame:
    marked = nodes.join(ids.select("id").distinct().withColumn("_gone", F.lit(True)), "id", "left")
    return marked.withColumn("valid", F.col("valid") & F.col("_gone").isNull()).drop("_gone")


def relation_rows(relations: DataFrame, least: float = 0.1, most: int = 3) -> DataFrame:
    """A row for each of a relation's first labels; weak relations and loops are left out."""
    return relations.where((F.col("confidence") >= least) & (F.col("src") != F.col("dst"))).withColumn("label", F.explode(F.slice("labels", 1, most)))


def repaired(raw: Column, fallback: Column) -> Column:
    return F.coalesce(F.when(raw != "", raw), fallback)


def media_paths(episodes: DataFrame, ledger: DataFrame) -> DataFrame:
    """Each episode's media path: by its id, else by date and text."""
    by_id = ledger.groupBy(F.col("episode_id").alias("id")).agg(F.min("path").alias("_a"))
    by_text = ledger.groupBy("day", "text").agg(F.min("path").alias("_b"))
    return episodes.join(by_id, "id", "left").join(by_text, ["day", "text"], "left").select("id", F.coalesce("_a", "_b").alias("media"))


def wire_tags(rows: DataFrame) -> DataFrame:
    """TAGGED_AS pairs from (episode_id, tag), once each, with how many episodes have the tag."""
    pairs = rows.select("episode_id", F.lower(F.trim("tag")).alias("tag")).distinct()
    df = pairs.groupBy("tag").agg(F.count("*").alias("df"))
    return pairs.join(df, "tag").select(F.col("episode_id").alias("src"), F.concat(F.lit("tag_"), "tag").alias("dst"), "df")


def wire_links(links: DataFrame, names: DataFrame) -> DataFrame:
    """HYPERLINKS_TO edges for links (src, target) whose target has a name (target, dst); no loops, each pair once."""
    return links.join(names, "target").where("src <> dst").select("src", "dst", F.lit("HYPERLINKS_TO").alias("etype")).distinct()


def latest_versions(versions: DataFrame) -> DataFrame:
    """The id of each base's latest version: the base itself, or base_vN."""
    top = versions.groupBy("base").agg(F.max("version").alias("v"))
    return top.select("base", F.when(F.col("v") == 0, F.col("base")).otherwise(F.concat("base", F.lit("_v"), F.col("v").cast("string"))).alias("latest"))


def latest_members(members: DataFrame, most: int) -> DataFrame:
    """Each hub's latest members (hub, member, seen), ties by the greater id."""
    order = Window.partitionBy("hub").orderBy(F.desc("seen"), F.desc("member"))
    return members.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= most).select("hub", "member")


def mention_star(edges: DataFrame) -> DataFrame:
    """entity_id, episode_id pairs over mentions."""
    at = edges.where("etype = 'MENTIONED_IN'").select("src", F.col("dst").alias("episode_id"))
    to = edges.where("etype = 'RESOLVES_TO'").select("src", F.col("dst").alias("entity_id"))
    return at.join(to, "src").select("entity_id", "episode_id").distinct()


def episode_hubs(edges: DataFrame) -> DataFrame:
    """Tags and entities of each episode."""
    tags = edges.where("etype = 'TAGGED_AS'").select(F.col("src").alias("episode_id"), F.col("dst").alias("hub"))
    return tags.unionByName(mention_star(edges).select("episode_id", F.col("entity_id").alias("hub"))).distinct()


def object_graph(members: DataFrame, kinds: dict[str, float], block: int = 65536) -> DataFrame:
    """Undirected pairs of members (id, and for each type of edge an array of hubs) that share a hub, with the weights summed over shared hubs and the edge types.

    Blocks of members meet in cells, and a cell sums a member's pairs before it gives them out: only members are dealt, n / block times, never pairs.
    """
    names = sorted(kinds)
    v = members.where("id is not null").select(F.col("id").cast("long").alias("id"), *names)
    n = v.count()
    m = max(1, min(8, -(-n // 512)), -(-n // block))
    own, other = F.pmod(F.xxhash64("id"), F.lit(m)).alias("own"), F.explode(F.sequence(F.lit(0), F.lit(m - 1)).cast("array<long>")).alias("other")
    dealt = v.select("id", *names, own).select("*", other).select("id", *names, "own", (F.least("own", "other") * m + F.greatest("own", "other")).alias("cell"))

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(list(batches))
        first, second = divmod(t["cell"][0].as_py(), m)
        ids, place = np.unique(t["id"].to_numpy(), return_inverse=True)
        mine = np.zeros(len(ids), np.int64)
        mine[place] = t["own"].to_numpy()
        right = np.flatnonzero(mine == second)
        column = np.full(len(ids), -1, np.int64)
        column[right] = np.arange(len(right))
        hubs_of, starts, members_of = [], [], []
        for k in names:
            lists = t[k].combine_chunks()
            code = lists.flatten().dictionary_encode()
            size = max(1, len(code.dictionary))
            held_by = np.unique(place[pc.list_parent_indices(lists).to_numpy()] * size + code.indices.to_numpy())
            who, hub = held_by // size, held_by % size
            hubs_of.append((hub, np.searchsorted(who, np.arange(len(ids) + 1))))
            there = mine[who] == second
            order = np.argsort(hub[there], kind="stable")
            members_of.append(column[who[there]][order])
            starts.append(np.searchsorted(hub[there][order], np.arange(size + 1)))
        count = np.zeros((len(names), len(right)), np.int32)
        out, rows = [], 0
        for a in np.flatnonzero(mine == first):
            for k, (hub, at) in enumerate(hubs_of):
                for h in hub[at[a] : at[a + 1]]:
                    near = members_of[k][starts[k][h] : starts[k][h + 1]]
                    count[k, near[np.searchsorted(near, column[a], "right") :] if first == second else near] += 1
            hit = np.flatnonzero(count.any(axis=0))
            if len(hit):
                b = ids[right[hit]]
                out.append((np.minimum(ids[a], b), np.maximum(ids[a], b), count[:, hit]))
                count[:, hit] = 0
                rows += len(hit)
            if rows >= 100_000:
                yield batch(out)
                out, rows = [], 0
        if out:
            yield batch(out)

    def batch(out: list[tuple]) -> pa.RecordBatch:
        n_shared = np.concatenate([o[2] for o in out], axis=1)
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate([o[i] for o in out])) for i in (0, 1)] + [pa.array(c) for c in n_shared], names=["src", "dst", *names])

    found = dealt.repartition(m * (m + 1) // 2, "cell").groupBy("cell").applyInArrow(pairs, "src long, dst long, " + ", ".join(f"`{k}` int" for k in names))
    weight = sum((F.col(k) * F.lit(kinds[k]) for k in names[1:]), F.col(names[0]) * F.lit(kinds[names[0]]))
    return found.select("src", "dst", F.round(weight, 4).alias("weight"), F.concat_ws(",", *[F.when(F.col(k) > 0, k) for k in names]).alias("etypes"))


def live_edges(edges: DataFrame, valid: DataFrame) -> DataFrame:
    """Edges whose ends, and the episode they come from, are valid nodes."""
    left = edges.join(valid.select(F.col("id").alias("src")), "src", "left_semi").join(valid.select(F.col("id").alias("dst")), "dst", "left_semi")
    return left.where("episode_id = ''").unionByName(left.where("episode_id <> ''").join(valid.select(F.col("id").alias("episode_id")), "episode_id", "left_semi"))


# ---- lexical


def composite_document(*columns: str) -> Column:
    """What is searched of an episode: its parts that are there, joined by blanks."""
    return F.concat_ws(" ", *columns)


def overlap_search(docs: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Documents by how many of their tokens a query has; ties by id."""
    return overlaps(docs, queries, k)


# ---- reading


def believed() -> Column:
    return F.col("belief") == "asserted"


def _by_entity(facts: DataFrame) -> DataFrame:
    return facts.withColumn("entity", F.explode(F.array_distinct(F.array("src", "dst"))))


def facts_for(facts: DataFrame, as_of: str | None, most: int = 30) -> DataFrame:
    """Facts that hold at a date (None: now) for each entity at either end, once each, the first by order of entry."""
    held = _by_entity(facts.where(believed() & active(as_of))).groupBy("entity", "src", "rel", "dst", "valid_at").agg(F.min("seq").alias("seq"))
    return held.withColumn("_n", F.row_number().over(Window.partitionBy("entity").orderBy("seq"))).where(F.col("_n") <= most).select("entity", "src", "rel", "dst", "valid_at")


def entity_fact_rows(facts: DataFrame, as_of: str | None, include_closed: bool) -> DataFrame:
    rows = facts.where(believed())
    if not include_closed:
        rows = rows.where(active(as_of))
    return _by_entity(rows).select("entity", "src", "rel", "dst", "valid_at", "invalid_at", F.when(F.col("invalid_at") == "", "active").otherwise("closed").alias("status")).distinct()


def named_facts(facts: DataFrame, names: DataFrame) -> DataFrame:
    """Facts with the names of their ends (the id where there is none) and a line of text."""
    a, b = names.select(F.col("id").alias("src"), F.col("name").alias("src_name")), names.select(F.col("id").alias("dst"), F.col("name").alias("dst_name"))
    joined = facts.join(a, "src", "left").join(b, "dst", "left").withColumns({"src_name": F.coalesce("src_name", "src"), "dst_name": F.coalesce("dst_name", "dst")})
    rel = F.coalesce(F.when(F.col("rel") != "", F.col("rel")), F.lit("related_to"))
    return joined.withColumn("line", F.concat("src_name", F.lit(" --"), rel, F.lit("--> "), "dst_name"))


def surface_keys(nodes: DataFrame) -> DataFrame:
    """One id for each lower-case name: of an entity, else of a tag."""
    keys = nodes.where("ntype in ('entity', 'tag') and valid").select(F.lower("name").alias("key"), F.struct(F.when(F.col("ntype") == "entity", 0).otherwise(1).alias("prio"), "id").alias("at"))
    return keys.groupBy("key").agg(F.min("at").alias("at")).select("key", "at.id")


def resolve_surfaces(asked: DataFrame, keys: DataFrame) -> DataFrame:
    """Surfaces looked up whatever their case; ``resolved`` is false for unknown ones."""
    return asked.withColumn("key", F.lower("surface")).join(keys, "key", "left").withColumn("resolved", F.col("id").isNotNull())


def profile_facts(facts: DataFrame, top: int) -> DataFrame:
    """The newest open facts of each subject, in order of time."""
    newest = facts.where(believed() & (F.col("invalid_at") == "")).withColumn("_n", F.row_number().over(Window.partitionBy("src").orderBy(F.desc("valid_at"), F.desc("seq")))).where(F.col("_n") <= top)
    return newest.select("src", "rel", "dst", "valid_at", F.row_number().over(Window.partitionBy("src").orderBy("valid_at", "seq")).cast("long").alias("place"))


def vocabulary(rows: DataFrame, top: int) -> DataFrame:
    """The most frequent names of each type (entity_type, name, doc_id), ties by name."""
    df = rows.groupBy("entity_type", "name").agg(F.countDistinct("doc_id").alias("df"))
    order = Window.partitionBy("entity_type").orderBy(F.desc("df"), "name")
    return df.withColumn("place", F.row_number().over(order).cast("long")).where(F.col("place") <= top)


def source_of(edges: DataFrame) -> DataFrame:
    return edges.where("etype = 'PART_OF'").groupBy(F.col("src").alias("episode_id")).agg(F.min("dst").alias("source_id"))


def episode_cards(episodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Valid episodes with the source they are part of."""
    return episodes.where("valid").join(source_of(edges).withColumnRenamed("episode_id", "id"), "id", "left")


def grounded_facts(facts: DataFrame, seeds: DataFrame) -> DataFrame:
    """Believed facts that an episode gave about its seeds (episode_id, id)."""
    f = facts.where(believed()).select("episode_id", "src", "rel", "dst")
    ends = f.withColumn("id", F.explode(F.array_distinct(F.array("src", "dst"))))
    return ends.join(seeds, ["episode_id", "id"], "left_semi").drop("id").distinct()


def category(entity_type: Column) -> Column:
    """Person, place or thing."""
    return F.when(entity_type.isin("person", "place"), entity_type).otherwise("thing")


def episode_entities(edges: DataFrame, types: DataFrame) -> DataFrame:
    named = mention_star(edges).join(types.withColumnRenamed("id", "entity_id"), "entity_id")
    return named.select("episode_id", "name", category(F.col("entity_type")).alias("category")).distinct()


def display_neighbours(edges: DataFrame, facts: DataFrame) -> DataFrame:
    """Episodes and entities over mentions, and entities over believed facts, both ways."""
    pairs = mention_star(edges).select(F.col("entity_id").alias("src"), F.col("episode_id").alias("dst")).unionByName(facts.where(believed()).select("src", "dst"))
    return both_ways(pairs).select(F.col("src").alias("node"), F.col("dst").alias("neighbour")).distinct()


def episode_graph(facts: DataFrame) -> DataFrame:
    """How many entities and pairs the believed facts of each episode have."""
    f = facts.where(believed()).withColumn("x", F.explode(F.array("src", "dst")))
    return f.groupBy("episode_id").agg(F.countDistinct("x").alias("n_nodes"), F.countDistinct(F.concat("src", "dst")).alias("n_pairs"))


def raw_neighbourhood(edges: DataFrame, like: str, most: int) -> DataFrame:
    """The first neighbours of nodes by any edge type, with those types."""
    b = both_ways(edges.select("src", "dst", "etype")).where(F.col("src").like(like))
    near = b.groupBy(F.col("src").alias("node"), F.col("dst").alias("other")).agg(F.array_join(F.array_sort(F.collect_set("etype")), ",").alias("etypes"))
    return near.withColumn("place", F.row_number().over(Window.partitionBy("node").orderBy("other")).cast("long")).where(F.col("place") <= most)


def inspect(edges: DataFrame, like: str, most: int) -> DataFrame:
    b = both_ways(edges.select("src", "dst", "etype", "rel")).where(F.col("src").like(like)).distinct()
    placed = b.withColumn("place", F.row_number().over(Window.partitionBy("src").orderBy("dst", "etype", "rel")).cast("long")).where(F.col("place") <= most)
    return placed.select(F.col("src").alias("node"), F.col("dst").alias("other"), "etype", "rel", "place")


def store_stats(nodes: DataFrame, edges: DataFrame, facts: DataFrame) -> DataFrame:
    """Counts of nodes and edges by type, and of facts by state; retracted ones only if there are any."""
    state = F.when(F.col("belief") == "retracted", "facts_retracted").when(F.col("invalid_at") == "", "facts_open").otherwise("facts_closed")
    none = nodes.sparkSession.createDataFrame([("facts_open", 0), ("facts_closed", 0)], "kind string, n long")
    by_state = facts.groupBy(state.alias("kind")).agg(F.count("*").alias("n")).unionByName(none).groupBy("kind").agg(F.sum("n").alias("n"))
    return nodes.groupBy(F.col("ntype").alias("kind")).agg(F.count("*").alias("n")).unionByName(edges.groupBy(F.col("etype").alias("kind")).agg(F.count("*").alias("n"))).unionByName(by_state)


def fact_rows(facts: DataFrame) -> DataFrame:
    """Facts as rows for a reader: open ends are null, the state spelled out."""
    status = F.when(F.col("belief") == "retracted", "retracted").when(F.col("invalid_at") == "", "active").otherwise("closed")
    return facts.select(
        "seq", "src", "rel", "dst", "valid_at", F.nullif("invalid_at", F.lit("")).alias("invalid_at"), "belief", "episode_id", "confidence",
        status.alias("status"), F.col("valid_at").alias("created_at"), F.col("confidence").alias("weight"), F.substring("valid_at", 1, 4).alias("year"),
    )


def focused_subgraph(facts: DataFrame, keep: DataFrame) -> DataFrame:
    """Believed facts within a set of nodes, the relations of each ordered pair as one label."""
    ids = keep.select("id").distinct()
    inner = facts.where(believed()).join(ids.select(F.col("id").alias("src")), "src", "left_semi").join(ids.select(F.col("id").alias("dst")), "dst", "left_semi")
    return inner.groupBy("src", "dst").agg(F.array_join(F.array_sort(F.collect_set("rel")), "/").alias("label"))


# ---- erasing


def erase_targets(episodes: DataFrame, ids: list[str], literal: str | None) -> DataFrame:
    """Episodes (id, base, text) named by id or base, or that hold the literal, whatever its case."""
    hit = F.col("id").isin(ids) | F.col("base").isin(ids)
    if literal:
        hit = hit | F.contains(F.lower("text"), F.lit(literal.lower()))
    return episodes.where(hit).select("id")


def retract_edges(edges: DataFrame, episodes: DataFrame) -> DataFrame:
    """Edges of the given episodes invalid; those that are facts retracted."""
    marked = edges.join(episodes.distinct().withColumn("_gone", F.lit(True)), "episode_id", "left").withColumn("valid", F.col("_gone").isNull())
    return marked.withColumn("belief", F.when(F.col("etype") == "RELATED_TO", F.when(F.col("valid"), "asserted").otherwise("retracted"))).drop("_gone")


def artifacts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """What was extracted from each episode: mentions, tags and facts."""
    names = nodes.select("id", "name")
    strip = lambda c: F.regexp_replace(c, "^entity_", "entity_")
    facts = edges.where("etype = 'RELATED_TO'").select("episode_id", F.lit("fact").alias("kind"), F.concat_ws("|", strip(F.col("src")), "rel", strip(F.col("dst"))).alias("surface"))
    mentions = edges.where("etype = 'MENTIONED_IN'").join(names, F.col("src") == F.col("id")).select("episode_id", F.lit("mention").alias("kind"), F.col("name").alias("surface"))
    tags = edges.where("etype = 'TAGGED_AS'").join(names, F.col("dst") == F.col("id")).select("episode_id", F.lit("tag").alias("kind"), F.col("name").alias("surface"))
    return facts.unionByName(mentions).unionByName(tags)


def delete_episodes(nodes: DataFrame, edges: DataFrame, ids: DataFrame) -> DataFrame:
    """What becomes invalid with the given episodes: they, and tags and sources that no other valid edge touches."""
    gone = ids.select("id").distinct()
    live = edges
    for column in ("src", "dst", "episode_id"):
        live = live.join(gone.select(F.col("id").alias(column)), column, "left_anti")
    touched = live.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    orphans = nodes.where("ntype in ('tag', 'source')").join(touched, "id", "left_anti").select("id", "ntype")
    return orphans.unionByName(gone.select("id", F.lit("episode").alias("ntype")))


# ---- projections


def self_like(entities: DataFrame, anchor: str, names: list[str]) -> DataFrame:
    return entities.where((F.col("id") == anchor) | F.lower("name").isin(names)).select("id", "name")


def adjacency_rows(pairs: DataFrame) -> DataFrame:
    """Each node's neighbours and weights in order, as one text."""
    near = both_ways(pairs).groupBy("src").agg(F.array_sort(F.collect_list(F.struct("dst", F.round("w", 4).alias("w")))).alias("near"))
    return near.select("src", F.array_join(F.transform("near", lambda x: F.concat(x["dst"], F.lit(":"), x["w"].cast("string"))), ",").alias("row"))


def bfs_scores(pairs: DataFrame, seeds: DataFrame, most: int = 2) -> DataFrame:
    """Each node's summed mass / (1 + hops) over the seeds (id, mass) that reach it in at most ``most`` hops."""
    out = None
    for seed in seeds.toLocalIterator():  # seeds of one question: a few
        start = pairs.sparkSession.createDataFrame([(seed["id"],)], "id string")
        part = hops(pairs, start, most).select("id", (F.lit(float(seed["mass"])) / (1 + F.col("hop"))).alias("score"))
        out = part if out is None else out.unionByName(part)
    return out.groupBy("id").agg(F.sum("score").alias("score"))


def community_summaries(rows: DataFrame, top: int = 8) -> DataFrame:
    """The most frequent tags of each community (comm, tag), ties by tag."""
    counts = rows.groupBy("comm", "tag").agg(F.count("*").alias("n"))
    best = counts.withColumn("place", F.row_number().over(Window.partitionBy("comm").orderBy(F.desc("n"), "tag"))).where(F.col("place") <= top)
    return best.groupBy("comm").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "tag"))), lambda x: x["tag"]), ", ").alias("summary"))


def hub_stats(facts: DataFrame, top: int) -> DataFrame:
    """The nodes with most facts: degree, share of all ends, rank with ties."""
    degree = facts.select(F.explode(F.array("src", "dst")).alias("id")).groupBy("id").agg(F.count("*").alias("degree"))
    total = degree.agg(F.sum("degree").alias("_t"))
    # the rank is cut to those that can be among the first: ties of the last place included
    floor = degree.orderBy(F.desc("degree")).limit(top).agg(F.min("degree").alias("_f"))
    best = degree.crossJoin(F.broadcast(floor)).where("degree >= _f").drop("_f")
    ranked = best.withColumn("place", F.rank().over(Window.orderBy(F.desc("degree"))).cast("long")).where(F.col("place") <= top)
    return ranked.crossJoin(F.broadcast(total)).select("id", "degree", F.round(F.col("degree") / F.col("_t"), 6).alias("share"), "place")
