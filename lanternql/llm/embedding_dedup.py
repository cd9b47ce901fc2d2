"""Embedding near-duplicates by NN-descent.

A neighbour graph starts from vectors that fall next to each other in a few tables sorted
by random hyperplane signs.  Each round compares the neighbours of a vector, its own and
those that name it, with one another, and keeps the best found, whatever their cosine, until
few lists change.  All edges found at the threshold connect groups, also those a list has no room for.  A group may hold more links than a neighbour list: its lists are then
enlarged to the whole group, compared in blocks, so links and counts within it are exact.
Recall is audited on a bounded draw of query vectors against all rows, each query with
links counted once; while it is short of the target, further tables and rounds are added,
and where the last pass is short of it too, all vectors of a label are compared in blocks.

Only vectors with a label, an id, and finite components not all zero take part; others
stand alone.  Equal vectors of a label are one node.  Vectors of different length are
never compared.  Null ids: such a row links with nothing and its component is null.
Repeated rows count each.  Empty table: empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from lanternql.llm.common import discard, materialize
from lanternql.llm.grouping import LINKED, connected_components, gathered, in_blocks, linker, shortened, whole_runs, with_least

COSINE = 0.93
TABLES = 10
BESIDE = 4
NEIGHBOURS = 10
#: Rounds go on until fewer of the list entries than this are new.
SETTLED = 0.01
MOST_ROUNDS = 12
BLOCK = 1024
#: Drawn nodes with links that are enough, nodes drawn at first, and at most.
AUDIT = 400
FIRST_DRAWN = 4096
MOST_DRAWN = 65536
RECALL = 0.97
MOST_PASSES = 4
SEED = 977

EDGE = "a binary, b binary, cosine double"


def matrix(column) -> np.ndarray:
    """Unit rows of a column of equally long lists, in double precision."""
    x = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    v = x.flatten().to_numpy().astype(np.float64).reshape(len(x), -1)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def signs(n_tables: int, bits: int, seed: int):
    """(id, label, vector) -> a row for each table: place, the hyperplane signs as a number."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            column = batch.column(2)
            length = np.asarray(column.value_lengths())
            place = np.zeros((batch.num_rows, n_tables), dtype=np.int64)
            for width in np.unique(length):
                rows = np.flatnonzero(length == width)
                v = matrix(column.take(pa.array(rows)))
                planes = np.random.default_rng([seed, int(width)]).standard_normal((int(width), n_tables * bits))
                side = (v @ planes > 0).reshape(len(rows), n_tables, bits)
                place[rows] = side @ (1 << np.arange(bits, dtype=np.int64))
            at = np.repeat(np.arange(batch.num_rows), n_tables)
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(i).take(pa.array(at)) for i in range(3)], pa.array(np.tile(np.arange(n_tables), batch.num_rows), pa.int32()), pa.array(place.ravel())], ["id", "label", "vector", "table", "place"]
            )

    return run


def adjacent(batches):
    """Edges between rows at most BESIDE apart in the sorted order of a task."""
    held = None
    for batch in batches:
        t = pa.Table.from_batches([batch])
        if held is not None:
            t = pa.concat_tables([held, t])
        if t.num_rows < 2:
            held = t
            continue
        t = t.combine_chunks()
        ids = t.column("id").combine_chunks()
        v = matrix(t.column("vector"))
        block = t.column("block").to_numpy()
        for k in range(1, BESIDE + 1):
            if len(v) <= k:
                break
            cosine = np.einsum("ij,ij->i", v[:-k], v[k:])
            near = np.flatnonzero(block[:-k] == block[k:])
            if len(near):
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(near)).cast(pa.binary()), ids.take(pa.array(near + k)).cast(pa.binary()), pa.array(cosine[near])], ["a", "b", "cosine"])
        held = t.slice(max(0, t.num_rows - BESIDE))


def first_edges(nodes: DataFrame, n_tables: int, seed: int, bits: int) -> DataFrame:
    """One width at a time: widths are few, and a task's rows then form one matrix."""
    placed = nodes.select("id", "label", "vector").mapInArrow(signs(n_tables, bits, seed), "id binary, label string, vector array<double>, table int, place long")
    keyed = placed.withColumn("width", F.size("vector")).withColumn("block", F.xxhash64("label", "width", "table"))
    widths = [r["width"] for r in nodes.select(F.size("vector").alias("width")).distinct().collect()]
    out = None
    for width in widths:
        ordered = keyed.filter(F.col("width") == width).repartitionByRange("table", "label", "place", "id").sortWithinPartitions("table", "label", "place", "id")
        edges = ordered.select("id", "vector", "block").mapInArrow(adjacent, EDGE)
        out = edges if out is None else out.union(edges)
    return nodes.sparkSession.createDataFrame([], EDGE) if out is None else out


def best(edges: DataFrame, most: int) -> DataFrame:
    """The best ``most`` of every node, its edges taken both ways.  Each task ranks its own
    edges before they are dealt, so no node brings all its edges to one task."""
    both = edges.select("a", "b", "cosine", "born").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "cosine", "born"))
    # an edge found many times has one rank
    rank = F.dense_rank().over(W.Window.partitionBy("a").orderBy(F.desc("cosine"), "b"))
    ranked = both.withColumn("_rank", rank).filter(F.col("_rank") <= most)
    return ranked.groupBy("a", "b").agg(F.max("cosine").alias("cosine"), F.min("born").alias("born"))


def by_width(t: pa.Table):
    """Rows of one length of vector at a time: they form one matrix."""
    width = pc.list_value_length(t.column("vector")).to_numpy()
    for w in np.unique(width):
        yield t.take(pa.array(np.flatnonzero(width == w))).combine_chunks()


def local_join(batches):
    """Of the members around a node, the pairs not compared before that improve the list of
    one end or are links."""
    for t in (part for t in whole_runs(batches, "pivot") for part in by_width(t)):
        ids, pivot = t.column("id").combine_chunks(), t.column("pivot").to_numpy()
        v, fresh, worst = matrix(t.column("vector")), t.column("fresh").to_numpy(), t.column("worst").to_numpy()
        cuts = np.flatnonzero(np.r_[True, pivot[1:] != pivot[:-1], True])
        out = []
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            s = v[a:b] @ v[a:b].T
            i, j = np.nonzero(np.triu((fresh[a:b, None] | fresh[None, a:b]) & ((s > np.minimum(worst[a:b, None], worst[None, a:b])) | (s >= COSINE)), 1))
            out.append((i + a, j + a, s[i, j]))
        i, j, cosine = (np.concatenate(x) for x in zip(*out, strict=True))
        if len(i):
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(i)).cast(pa.binary()), ids.take(pa.array(j)).cast(pa.binary()), pa.array(cosine)], ["a", "b", "cosine"])


def links_of(edges: DataFrame) -> DataFrame:
    """All edges at the threshold, whatever the lists have room for, as fewer with the same components."""
    return materialize(shortened(edges.filter(F.col("cosine") >= COSINE).select("a", "b")), "links")


def refine(lists: DataFrame, nodes: DataFrame, turn: int) -> tuple[DataFrame, DataFrame]:
    """Neighbours of neighbours: the lists of a node, and the nodes that have it in theirs
    (of these at most NEIGHBOURS, the nearest, as their own lists hold the rest).
    Gives the new lists, and the links among all edges found."""
    around = best(lists, 2 * NEIGHBOURS).select(F.col("a").alias("pivot"), F.col("b").alias("id"), (F.col("born") == turn - 1).alias("fresh"))
    moved = around.filter("fresh").select("pivot").distinct()
    bound = lists.groupBy(F.col("a").alias("id")).agg(F.when(F.count(F.lit(1)) >= NEIGHBOURS, F.min("cosine")).otherwise(-2.0).alias("worst"))
    members = around.join(moved, "pivot", "left_semi").join(nodes.select("id", "vector").join(bound, "id"), "id")
    found = materialize(gathered(members.select("id", "vector", "fresh", "worst", "pivot"), "pivot").mapInArrow(local_join, EDGE).withColumn("cosine", F.round("cosine", 12)), "found")
    new = materialize(best(lists.union(found.withColumn("born", F.lit(turn))), NEIGHBOURS), "lists")
    links = links_of(found)
    discard(found)
    return new, links


def similar_vectors(unit: pa.Table) -> np.ndarray:
    v = matrix(unit.column("vector"))
    return v @ v.T >= COSINE


def auditor(keys, own, components, vectors):
    """For each query vector the links it has among the rows (key, id, component, vector),
    all by numbers, and how many of them its group holds."""
    groups = {k: np.flatnonzero(keys == k) for k in np.unique(keys)}

    def run(batches):
        links, found = np.zeros(len(keys), dtype=np.int64), np.zeros(len(keys), dtype=np.int64)
        for batch in batches:
            key, ids, comp = (batch.column(i).to_numpy() for i in range(3))
            for k in np.unique(key):
                rows = np.flatnonzero(key == k)
                if k not in groups:
                    continue
                v, queries = matrix(batch.column(3).take(pa.array(rows))), groups[k]
                for q in (queries[a : a + BLOCK] for a in range(0, len(queries), BLOCK)):
                    near = (v @ np.array([vectors[x] for x in q]).T >= COSINE) & (ids[rows][:, None] != own[q])
                    links[q] += near.sum(axis=0)
                    found[q] += (near & (comp[rows][:, None] == components[q])).sum(axis=0)
        some = np.flatnonzero(links)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(links[some]), pa.array(found[some])], ["query", "links", "found"])

    return run


def audit(nodes: DataFrame, groups: DataFrame, seed: int) -> float:
    """Share of its links, against all rows, that the group of a drawn node holds: the mean
    over drawn nodes that have links, each counted once.  More are drawn until AUDIT of
    them have links, or all or MOST_DRAWN are drawn."""
    known = nodes.select("id", "label", "vector").join(groups, "id", "left").withColumn("component", F.coalesce("component", "id"))
    numbers = known.select(F.xxhash64("label", F.size("vector")).alias("key"), F.xxhash64("id").alias("own"), F.xxhash64("component").alias("component"), "vector", F.xxhash64("id", F.lit(seed)).alias("draw"))
    size = FIRST_DRAWN
    while True:
        drawn = numbers.orderBy("draw", "own").limit(size).drop("draw").toArrow()
        if not drawn.num_rows:
            return 1.0
        keys, own, components = (drawn.column(i).to_numpy() for i in range(3))
        vectors: list = [None] * len(keys)
        width = pc.list_value_length(drawn.column("vector")).to_numpy()
        for w in np.unique(width):
            rows = np.flatnonzero(width == w)
            for i, v in zip(rows, matrix(drawn.column("vector").take(pa.array(rows))), strict=True):
                vectors[i] = v
        each = numbers.select("key", "own", "component", "vector").mapInArrow(auditor(keys, own, components, vectors), "query int, links long, found long").groupBy("query").agg((F.sum("found") / F.sum("links")).alias("share"))
        total = each.agg(F.count(F.lit(1)).alias("linked"), F.avg("share").alias("share")).first()
        if total["linked"] >= AUDIT or len(keys) < size or size >= MOST_DRAWN:
            return 1.0 if not total["linked"] else total["share"]
        size *= 4


def descend(nodes: DataFrame, lists: DataFrame | None, links: DataFrame | None, turn: int, bits: int, born: int = 0) -> tuple[DataFrame, DataFrame, int]:
    """One pass: edges from tables, then rounds until few list entries are new.  An entry
    has the number of the round it was found in."""
    new = materialize(first_edges(nodes, TABLES * 2**turn, SEED + turn, bits).withColumn("cosine", F.round("cosine", 12)).withColumn("born", F.lit(born)), "found")
    lists = materialize(best(new if lists is None else lists.union(new), NEIGHBOURS), "lists")
    links = links_of(new) if links is None else links.union(links_of(new))
    discard(new)
    for _ in range(MOST_ROUNDS):
        count = lists.agg(F.count(F.lit(1)).alias("all"), F.count_if(F.col("born") == born).alias("new")).first()
        if count["new"] <= SETTLED * count["all"]:
            break
        born += 1
        old = lists
        lists, more = refine(old, nodes, born)
        links = links.union(more)
        discard(old)
    return lists, links, born + 1


def near_duplicates(rows: DataFrame) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row (vec_id, embedding, label)."""
    vector = F.col("embedding").cast("array<double>")
    fine = F.coalesce(
        F.col("vec_id").isNotNull() & F.col("label").isNotNull() & (F.size("vector") > 0) & F.forall("vector", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists("vector", lambda v: v != 0), F.lit(False)
    )
    digest = F.unhex(F.md5(F.concat_ws("|", F.col("label").cast("string"), F.array_join(F.transform("vector", lambda v: v.cast("string")), ","))))
    all_rows = materialize(rows.select("vec_id", F.col("label").cast("string").alias("label"), vector.alias("vector")).withColumn("id", F.when(fine, digest)), "vectors")
    nodes = materialize(
        all_rows.filter("id is not null").groupBy("id").agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("weight"), F.first("label").alias("label"), F.first("vector").alias("vector")), "nodes"
    )
    n = nodes.count()
    # enough to order nearly all rows: what is beside one then has the longest beginning in common, not the next id
    bits = min(48, math.ceil(math.log2(max(2, n))) + 4)
    lists, links, groups, born = None, None, None, 0
    for turn in range(MOST_PASSES):
        lists, links, born = descend(nodes, lists, links, turn, bits, born)
        groups = connected_components(links)
        if audit(nodes, groups, turn) >= RECALL:
            members, group = nodes.select("id", "vector", "weight").join(groups, "id"), "component"
            break
    else:  # the passes miss too much: all vectors that could be linked are compared
        members, group = nodes.select("id", "vector", "weight", F.xxhash64("label", F.size("vector")).alias("all")), "all"
    units = in_blocks(members, group, BLOCK, least=64)
    linked = materialize(gathered(units.select("id", "vector", "unit", "side", "both", "weight")).mapInArrow(linker(similar_vectors), LINKED), "linked")
    result = with_least(nodes.select("id", "least", "weight"), linked, "least", "component_id").drop("least")
    component = F.coalesce("component_id", "vec_id").alias("component_id")
    return all_rows.select("vec_id", "id").join(result, "id", "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component, F.coalesce(component == F.col("vec_id"), F.lit(True)).alias("kept"))
