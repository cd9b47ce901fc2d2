"""Mixing sources to target weights by Sainte-Laguë apportionment.

Sizes are words.  Target shares become integer numbers of equal-token blocks, first
for sources and then for shards of a source, always by the highest quotients
w/1, w/3, w/5...  The words of a shard, along a seeded order of its documents, are cut into
blocks; the quota takes the blocks of least seeded hash, all of them round after round where it
exceeds the shard.  A document is taken as far as its words lie in blocks taken.

Nulls: a null text has size 0 and is never taken; null sources form one source, last
in order.  Ties and repeated rows: the seeded order falls back on doc_id and the text's
hash; equal rows may swap their parts, so the result is the same set of rows.  Very long texts:
one row of many blocks.  Empty table: empty result.  Extra columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import window as W

from lanternql.llm.common import SPACE, WORD, carried, materialize, text_or_empty

WEIGHTS = (5.0, 2.0, 1.0)
MOST_REPEATS = 3
BLOCK_WORDS = 64
SHARD_WORDS = 200_000
MOST_SHARDS = 8192


def sainte_lague(weights: Sequence[float], seats: int) -> np.ndarray:
    """Seats by highest quotients w/(2k+1); the earlier entry wins a tie.

    Rounding w/D takes exactly the quotients of at least D/2, so a rounding near the
    right divisor is a prefix of the quotient order; the few seats over or missing
    are then removed from or added to its end.
    """
    w = np.asarray(weights, dtype=float)
    total = w.sum()
    if seats <= 0 or total <= 0:
        return np.zeros(len(w), dtype=np.int64)
    got = np.floor(w / (total / seats) + 0.5).astype(np.int64)
    over = int(got.sum()) - seats
    if over > 0:
        heap = [(w[i] / (2 * got[i] - 1), -i) for i in np.flatnonzero(got)]
        heapq.heapify(heap)
        for _ in range(over):
            _, i = heapq.heappop(heap)
            got[-i] -= 1
            if got[-i]:
                heapq.heappush(heap, (w[-i] / (2 * got[-i] - 1), i))
    elif over < 0:
        heap = [(-w[i] / (2 * got[i] + 1), i) for i in np.flatnonzero(w > 0)]
        heapq.heapify(heap)
        for _ in range(-over):
            _, i = heapq.heappop(heap)
            got[i] += 1
            heapq.heappush(heap, (-w[i] / (2 * got[i] + 1), i))
    return got


def capped_targets(sizes: Sequence[int], weights: Sequence[float], most: int = MOST_REPEATS) -> np.ndarray:
    """Share the sum of sizes by weight; a target stops at ``most`` times its size and
    what is over goes to the others by weight, until none is above."""
    size, w = np.asarray(sizes, dtype=float), np.asarray(weights, dtype=float)
    target, free, left = np.zeros(len(size)), np.ones(len(size), dtype=bool), size.sum()
    while free.any():
        share = left * w / w[free].sum()
        above = free & (share > most * size)
        if not above.any():
            target[free] = share[free]
            break
        target[above] = most * size[above]
        left -= target[above].sum()
        free &= ~above
    return target


def mix(docs: DataFrame, *, weights: Sequence[float] = WEIGHTS, most_repeats: int = MOST_REPEATS, block_words: int = BLOCK_WORDS, shard_words: int = SHARD_WORDS, most_shards: int = MOST_SHARDS, seed: int = 17) -> DataFrame:
    """doc_id, size, source_size, target, taken for every row of ``docs``.

    The driver sees one row per source and one per shard; there are at most
    ``most_shards`` shards besides one for each source.
    """
    spark = docs.sparkSession
    sized = materialize(
        docs.select(
            "doc_id",
            "source",
            F.regexp_count(text_or_empty(), F.lit(WORD)).cast("long").alias("size"),
            F.xxhash64(F.lit(seed), "doc_id", text_or_empty()).alias("draw"),
        ),
        "sizes",
    )
    sources = sized.groupBy("source").agg(F.sum("size").alias("size")).collect()
    sources.sort(key=lambda r: (r["source"] is None, r["source"] or ""))
    sizes = np.array([r["size"] for r in sources], dtype=np.int64)
    all_words = int(sizes.sum())
    targets = capped_targets(sizes, [weights[i % len(weights)] for i in range(len(sources))], most_repeats)
    block = max(1, min(block_words, all_words // (256 * max(1, len(sources)))))
    seats = sainte_lague(targets, round(all_words / block))
    per_shard = max(shard_words, all_words // most_shards)
    n_shards = np.maximum(1, -(-sizes // per_shard))

    plan_type = T.StructType([T.StructField("source", T.StringType()), T.StructField("source_size", T.LongType()), T.StructField("target", T.DoubleType()), T.StructField("n_shards", T.LongType())])
    plan = spark.createDataFrame([(r["source"], int(s), float(t), int(n)) for r, s, t, n in zip(sources, sizes, targets, n_shards, strict=True)], plan_type)
    dealt = (
        sized.alias("d")
        .join(plan.alias("p"), F.col("d.source").eqNullSafe(F.col("p.source")))
        .select("doc_id", "d.source", "size", "draw", "source_size", "target", F.pmod(F.xxhash64("draw"), "n_shards").alias("shard"))
    )
    at = {r["source"]: i for i, r in enumerate(sources)}
    by_source: dict[int, list] = {}
    for r in dealt.groupBy("source", "shard").agg(F.sum("size").alias("size")).collect():
        by_source.setdefault(at[r["source"]], []).append((r["shard"], r["size"]))
    quotas = []
    for i, shards in by_source.items():
        shards.sort()
        for (shard, size), n in zip(shards, sainte_lague([s for _, s in shards], int(seats[i])), strict=True):
            quotas.append((sources[i]["source"], shard, min(int(n), most_repeats * -(-size // block)), -(-size // block)))
    quota = spark.createDataFrame(quotas, "source string, shard long, quota long, blocks long")
    # of the blocks beside whole rounds, those of least hash: up to the hash of the last one
    of_block = lambda j: F.xxhash64(F.lit(seed), "source", "shard", j)
    rest = F.expr("CASE WHEN blocks > 0 THEN quota % blocks ELSE 0 END")
    last = F.when(rest > 0, F.element_at(F.array_sort(F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), of_block)), rest.cast("int")))
    quota = quota.select("source", "shard", F.expr("CASE WHEN blocks > 0 THEN quota div blocks ELSE 0 END").alias("rounds"), last.alias("last"))
    along = W.Window.partitionBy("d.source", "d.shard").orderBy("draw", "doc_id", "size").rowsBetween(W.Window.unboundedPreceding, 0)
    placed = (
        dealt.alias("d")
        .withColumn("begin", F.sum("size").over(along) - F.col("size"))
        .join(quota.alias("q"), F.col("d.source").eqNullSafe(F.col("q.source")) & (F.col("d.shard") == F.col("q.shard")))
        .select("doc_id", "d.source", "d.shard", "size", "source_size", "target", "draw", "begin", "rounds", "last")
    )
    inside = lambda j: F.least(F.col("begin") + F.col("size"), (j + 1) * block) - F.greatest("begin", j * block)
    own_blocks = F.sequence(F.expr(f"begin div {block}"), F.expr(f"(begin + size - 1) div {block}"))
    part = F.aggregate(F.filter(own_blocks, lambda j: of_block(j) <= F.col("last")), F.lit(0).cast("long"), lambda a, j: a + inside(j))
    taken = F.col("rounds") * F.col("size") + F.when(F.col("last").isNotNull() & (F.col("size") > 0), part).otherwise(0)
    return placed.select("doc_id", "size", "source_size", "target", taken.cast("long").alias("taken"), "draw")


def apply_mix(docs: DataFrame, **options) -> DataFrame:
    """The mixed rows: a document appears once for each whole time it is taken; a part
    taken is its first words, joined by blanks.  Equal rows share what they take evenly, the
    first of them one word more where it does not divide.  Columns as in ``docs``; n_chars
    follows the text."""
    seed = options.get("seed", 17)
    taken = mix(docs, **options).groupBy("doc_id", "draw").agg(F.first("size").alias("size"), F.sum("taken").alias("all"), F.count(F.lit(1)).alias("rows")).filter(F.col("all") > 0)
    # keys without nulls, so that the window and the join deal the rows once
    keys = lambda draw: (F.coalesce("doc_id", F.lit(0)).alias("_k"), F.col("doc_id").isNull().alias("_n"), draw.alias("_draw"))
    keyed = carried(docs, "doc_id", "text").select("_row", "text", *keys(F.xxhash64(F.lit(seed), "doc_id", text_or_empty())))
    keyed = keyed.withColumn("_nth", F.row_number().over(W.Window.partitionBy("_k", "_n", "_draw").orderBy("_k")))
    share = F.expr("CAST(`all` div rows AS BIGINT)") + (F.col("_nth") <= F.expr("`all` % rows")).cast("long")
    joined = keyed.join(taken.select(*keys(F.col("draw")), "size", "all", "rows"), ["_k", "_n", "_draw"]).select("_row", "text", "size", share.alias("taken"))
    whole = F.array_repeat(F.col("size"), F.expr("taken div size").cast("int"))
    part = F.when(F.expr("taken % size > 0"), F.array(F.expr("taken % size"))).otherwise(F.array().cast("array<bigint>"))
    rows = joined.select("_row", "text", "size", F.explode(F.concat(whole, part)).alias("words"))
    words = F.split(F.regexp_replace("text", f"^{SPACE}", ""), SPACE)
    text = F.when(F.col("words") == F.col("size"), F.col("text")).otherwise(F.array_join(F.slice(words, 1, F.col("words").cast("int")), " "))
    row = F.col("_row").withField("text", F.col("mixed"))
    if "n_chars" in docs.columns:
        row = row.withField("n_chars", F.length("mixed").cast("long"))
    return rows.withColumn("mixed", text).select(row.alias("_row")).select("_row.*")
