"""Groups over links: connected components, and whole groups compared in blocks.

Node ids are binary digests.  A group of any size is cut into blocks of bounded size and
every pair of blocks is one unit of work, so no task holds an unbounded group and no pair
of members is ever written as a row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from lanternql.llm.common import discard, materialize


def shortened(edges: DataFrame) -> DataFrame:
    """The same components with fewer edges: every node keeps one edge, to the least node it
    is linked down to, and its other ends are linked to that one, once for all nodes."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a != b").distinct()
    lowest = down.withColumn("low", F.min("b").over(W.Window.partitionBy("a")))
    return lowest.select("a", F.col("low").alias("b")).union(lowest.select(F.col("b").alias("a"), F.col("low").alias("b"))).filter("a != b").distinct()


#: A key of more than this share of the rows is hot; so at most a thousand keys are.
HOT_SHARE = 0.001
HOT_ROWS = 256
SALTS = 32


def hot_keys(rows: DataFrame, key: str) -> list:
    """The keys that hold more than HOT_SHARE of the rows: counted where the rows are."""
    counts = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n")).head()[0] or 0
    return [r[0] for r in counts.filter(F.col("n") > max(HOT_ROWS, HOT_SHARE * total)).select(key).collect()]


def spread_join(left: DataFrame, right: DataFrame, key: str, by: str, how: str = "inner", hot: list | None = None) -> DataFrame:
    """Join to ``right``, of one row per key.  The rows of hot keys are spread over SALTS tasks
    by ``by``, and only their rows of ``right`` are repeated."""
    hot = hot_keys(left, key) if hot is None else hot
    if not hot:
        return left.join(right, key, how)
    salt = lambda made: F.when(F.col(key).isin(*hot), made)
    salted = left.withColumn("_salt", salt(F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int")).otherwise(0))
    repeated = right.withColumn("_salt", F.explode(salt(F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))))
    return salted.join(repeated, [key, "_salt"], how).drop("_salt")


def connected_components(edges: DataFrame) -> DataFrame:
    """(id, component) for every end of ``edges`` (a, b): component is the least id reachable.

    Least labels travel along edges and then jump to their own label, so the rounds grow
    with the logarithm of a group's diameter rather than with its size.  The node that a large
    group hangs on is a hot key of both joins.
    """
    few = shortened(edges)
    both = materialize(few.union(few.select(F.col("b").alias("a"), F.col("a").alias("b"))), "links")
    hubs = hot_keys(both, "b")
    labels = materialize(both.groupBy("a").agg(F.min("b").alias("low")).select(F.col("a").alias("id"), F.least("a", "low").alias("component")), "labels")
    while True:
        near = spread_join(both, labels.withColumnRenamed("id", "b"), "b", "a", hot=hubs).groupBy(F.col("a").alias("id")).agg(F.min("component").alias("near"))
        step = labels.join(near, "id").select("id", F.col("component").alias("old"), F.least("component", "near").alias("component"))
        goal = step.select(F.col("id").alias("component"), F.col("component").alias("further"))
        # a component is hot before a step as after it, or comes of hot ones and hubs
        hot = list(dict.fromkeys([*hubs, *hot_keys(labels, "component")]))
        new = materialize(spread_join(step, goal, "component", "id", hot=hot).select("id", "old", F.least("component", "further").alias("component")), "labels")
        done = not new.filter("old != component").head(1)
        discard(labels)
        labels = new.select("id", "component")
        if done:
            discard(both)
            return labels


def in_blocks(members: DataFrame, group: str, block: int, *, least: int | None = None) -> DataFrame:
    """``members`` (with id and ``group``) dealt to units of work: adds unit, side and the
    flag ``both`` (the unit compares two different blocks).

    A member of one of n blocks goes to n units; sizes come from a count, so a large group
    is spread before it is gathered.  With ``least``, a group is cut into up to eight blocks of
    that size or more, so that many tasks share it.
    """
    sizes = members.groupBy(group).agg(F.count(F.lit(1)).alias("_n"))
    blocks = F.ceil(F.col("_n") / block)
    if least is not None:
        blocks = F.greatest(blocks, F.least(F.lit(8), F.ceil(F.col("_n") / least)))
    dealt = spread_join(members, sizes, group, "id").withColumn("_blocks", blocks.cast("int")).withColumn("_own", F.pmod(F.xxhash64("id"), "_blocks").cast("int"))
    other = dealt.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    low, high = F.least("_own", "_other"), F.greatest("_own", "_other")
    return other.withColumn("unit", F.xxhash64(F.col(group), low, high)).withColumn("side", (F.col("_own") > F.col("_other")).cast("int")).withColumn("both", low != high).drop("_n", "_blocks", "_own", "_other")


def gathered(frame: DataFrame, key: str = "unit") -> DataFrame:
    """All rows of a key in one task, next to each other; keys must be of bounded size."""
    return frame.repartition(F.col(key)).sortWithinPartitions(key)


def runs(batches, key: str = "unit") -> Iterator[pa.Table]:
    """The rows of each key from batches sorted by it."""
    rest = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        if rest is not None:
            table = pa.concat_tables([rest, table])
        if not table.num_rows:
            continue
        keys = table.column(key).to_numpy()
        cuts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            yield table.slice(a, b - a)
        rest = table.slice(cuts[-1])
    if rest is not None and rest.num_rows:
        yield rest


def whole_runs(batches, key: str) -> Iterator[pa.Table]:
    """Tables of whole keys, many at a time, from batches sorted by ``key``."""
    rest = None
    for batch in batches:
        t = pa.Table.from_batches([batch])
        t = t if rest is None else pa.concat_tables([rest, t])
        if not t.num_rows:
            continue
        keys = t.column(key).to_numpy()
        cut = int(np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])[-1])
        if cut:
            yield t.slice(0, cut).combine_chunks()
        rest = t.slice(cut)
    if rest is not None and rest.num_rows:
        yield rest.combine_chunks()


def roots(near: np.ndarray) -> np.ndarray:
    """For a symmetric matrix of links: the least index reachable from each."""
    n = len(near)
    root = np.full(n, -1)
    for i in range(n):
        if root[i] >= 0:
            continue
        root[i] = i
        front = [i]
        while front:
            hit = np.flatnonzero(near[front].any(axis=0) & (root < 0))
            root[hit] = i
            front = hit.tolist()
    return root


def linker(matrix_of: Callable[[pa.Table], np.ndarray], key: str = "unit"):
    """For each unit: (id, links, root) with links the weight of its linked members on the
    other side, root the least member reachable within the unit."""

    def run(batches):
        for unit in runs(batches, key):
            if unit.num_rows < 2:
                continue
            near = matrix_of(unit)
            np.fill_diagonal(near, False)
            if unit.column("both")[0].as_py():
                side = unit.column("side").to_numpy()
                near &= side[:, None] != side[None, :]
            links = near @ unit.column("weight").to_numpy().astype(np.int64)
            root = roots(near)
            ids = unit.column("id").combine_chunks()
            some = np.flatnonzero(links > 0)
            if len(some):
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(some)).cast(pa.binary()), pa.array(links[some], pa.int64()), ids.take(pa.array(root[some])).cast(pa.binary())], ["id", "links", "root"])

    return run


LINKED = "id binary, links long, root binary"


def with_least(nodes: DataFrame, linked: DataFrame, number: str, least: str) -> DataFrame:
    """``nodes`` (id, weight, ``number``) with n_links and ``least``, the least ``number`` of
    the node's group; most nodes are alone and keep their own."""
    links, exact = settle(linked)
    lowest = exact.join(nodes.select("id", number), "id").groupBy("component").agg(F.min(number).alias(least))
    each = nodes.join(links, "id", "left").join(exact, "id", "left").withColumn("component", F.coalesce("component", "id"))
    found = spread_join(each, lowest, "component", "id", "left")
    return found.withColumn("n_links", F.coalesce("links", F.lit(0)) + F.col("weight") - 1).withColumn(least, F.coalesce(least, number)).drop("links", "component", "weight")


def settle(linked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Units' findings -> (id, links) and (id, component)."""
    return linked.groupBy("id").agg(F.sum("links").alias("links")), connected_components(linked.select(F.col("id").alias("a"), F.col("root").alias("b")))
