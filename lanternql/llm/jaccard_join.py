"""N-gram Jaccard join by chosen paths.

Texts are sets of five-word shingles.  Equal texts form a class, kept as one node.  Each
run splits the nodes on a sampled shared token (the least shingle under the run's hash);
buckets that stay large are split again on further sampled tokens, and small ones are compared
whole on short sketches.  What MOST_DEPTH levels leave large is compared whole too, in blocks.  Passes of runs are repeated, each twice as large as the one before, until
the recall on a bounded draw of texts, held against all texts, meets the target.  What the
runs connect is then compared exactly on its full shingle sets, all members with all, in blocks.

Null, empty texts and texts without words: no shingles, linked with nothing but equal
texts.  Fewer than five words: the words together are the one shingle.  Null ids: such a
row is counted, its class_id comes from the others.  Repeated rows count as documents of
their own.  Ties: the least id names a class.  Very long texts: whole; a task holds the
shingles of one text at a time beside those of a block.  Empty table: empty result.  Extra
columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanternql.llm.common import carried, materialize, text_or_empty
from lanternql.llm.grouping import LINKED, connected_components, gathered, in_blocks, linker, spread_join, with_least

SHINGLE = 5
SIMILARITY = 0.8
#: Links that the runs of a pass are meant to find, and that the audit asks for.
RECALL = 0.999
AUDITED = 0.995
#: Texts drawn for the audit.
DRAWN = 256
COORDINATES = 96
SLACK = 0.14
SMALL = 200
TYPICAL_DEPTH = 2
MOST_DEPTH = 3
BLOCK = 256
SEED = 20240


def sketch_recall(similarity: float = SIMILARITY) -> float:
    """How likely sketches of a pair at the threshold agree in enough places, bytes of unlike
    tokens agreeing by chance left out."""
    need = math.ceil((similarity - SLACK) * COORDINATES)
    return sum(math.comb(COORDINATES, k) * similarity**k * (1 - similarity) ** (COORDINATES - k) for k in range(need, COORDINATES + 1))


def runs_needed(similarity: float = SIMILARITY, recall: float = RECALL, depth: int = TYPICAL_DEPTH) -> int:
    """Runs of the first pass: a pair at the threshold survives a path of this depth with
    similarity**depth, and agrees in its sketch with ``sketch_recall``."""
    return max(1, math.ceil(math.log(1 - min(recall / sketch_recall(similarity), 1 - 1e-6)) / math.log(1 - similarity**depth)))


def shingle_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all shingles, shingles of each text), in order."""
    import xxhash

    words = [t.encode().split() for t in texts]
    n = np.array([len(w) for w in words], dtype=np.int64)
    total = int(n.sum())
    h = np.fromiter((xxhash.xxh3_64_intdigest(w) for ws in words for w in ws), dtype=np.uint64, count=total)
    factor = np.uint64(0x9E3779B97F4A7C15)
    count = np.where(n >= SHINGLE, n - SHINGLE + 1, (n > 0).astype(np.int64))
    starts = np.cumsum(n) - n
    at = np.repeat(starts - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
    last = np.repeat(starts + n, count)
    out = np.zeros(len(at), dtype=np.uint64)
    for k in range(SHINGLE):
        inside = at + k < last
        out = out * factor + np.where(inside, h[np.minimum(at + k, max(0, total - 1))], np.uint64(k + 1)) if total else out
    out ^= out >> np.uint64(32)
    return out * np.uint64(0xD6E8FEB86659FD93), count


def constants(n: int, turn: int) -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng([SEED, turn])
    return r.integers(1 << 62, size=n, dtype=np.uint64) * np.uint64(2) + np.uint64(1), r.integers(1 << 62, size=n, dtype=np.uint64)


def sketcher(n_runs: int, turn: int):
    """(doc_id, id, text) -> (doc_id, id, paths, sketch): whole least hashes of the first
    coordinates, and a byte of each of the others."""
    n = n_runs + COORDINATES

    def run(batches):
        multiply, add = constants(n, turn)
        for batch in batches:
            texts = batch.column(2).to_pylist()
            for a in range(0, len(texts), 128):
                part = texts[a : a + 128]
                h, count = shingle_hashes(part)
                least = np.zeros((len(part), n), dtype=np.uint64)
                some = np.flatnonzero(count)
                if len(some):
                    starts = (np.cumsum(count) - count)[some]
                    for j in range(n):
                        least[some, j] = np.minimum.reduceat(h * multiply[j] + add[j], starts)
                sketch = (least[:, n_runs:] >> np.uint64(56)).astype(np.uint8) ^ (least[:, n_runs:] >> np.uint64(17)).astype(np.uint8)
                paths = pa.ListArray.from_arrays(pa.array(np.arange(0, len(part) * n_runs + 1, n_runs), pa.int32()), pa.array(least[:, :n_runs].ravel().view(np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, len(part)), batch.column(1).slice(a, len(part)), pa.array(count > 0), paths, pa.array([r.tobytes() for r in sketch], pa.binary())], ["doc_id", "id", "some", "paths", "sketch"]
                )

    return run


def similar_sketches(unit: pa.Table) -> np.ndarray:
    s = np.frombuffer(b"".join(unit.column("sketch").to_pylist()), dtype=np.uint8).reshape(unit.num_rows, -1)
    need = (SIMILARITY - SLACK) * s.shape[1]
    return np.stack([(row == s).sum(axis=1) >= need for row in s])


def similar_sets(unit: pa.Table) -> np.ndarray:
    """Exact Jaccard similarity of the shingle sets of all rows."""
    h, count = shingle_hashes(unit.column("text").to_pylist())
    n = len(count)
    pair = np.unique(np.stack([np.repeat(np.arange(n), count).astype(np.uint64), h]), axis=1) if len(h) else np.zeros((2, 0), np.uint64)
    owner = pair[0].astype(np.int64)
    size = np.bincount(owner, minlength=n)
    _, token, often = np.unique(pair[1], return_inverse=True, return_counts=True)
    shared = often[token] > 1
    owner, token = owner[shared], np.unique(token[shared], return_inverse=True)[1]
    both = np.zeros((n, n))
    order = np.argsort(token, kind="stable")
    owner, token = owner[order], token[order]
    width = 4096
    for first in range(0, int(token[-1]) + 1 if len(token) else 0, width):
        a, b = np.searchsorted(token, [first, first + width])
        hits = np.zeros((n, width), dtype=np.float32)
        hits[owner[a:b], token[a:b] - first] = 1
        both += hits @ hits.T
    union = size[:, None] + size[None, :] - both
    return (both >= SIMILARITY * union - 1e-9) & (union > 0)


def chosen_paths(nodes: DataFrame) -> DataFrame:
    """(a, b): links between nodes that share a leaf and have similar sketches."""
    level = nodes.filter("some").select("id", "sketch", F.posexplode("paths").alias("run", "least")).select("id", "sketch", "run", F.xxhash64("run", "least").alias("bucket"))
    found = None
    for depth in range(1, MOST_DEPTH + 1):
        often = level.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
        shared = materialize(spread_join(level, often, "bucket", "id"), "buckets")
        leaf = shared if depth == MOST_DEPTH else shared.filter(F.col("n") <= SMALL)
        units = in_blocks(leaf.select("id", "sketch", "bucket"), "bucket", SMALL).withColumn("weight", F.lit(1).cast("long"))
        links = gathered(units.select("id", "sketch", "unit", "side", "both", "weight")).mapInArrow(linker(similar_sketches), LINKED).select(F.col("id").alias("a"), F.col("root").alias("b")).filter("a != b")
        found = links if found is None else found.union(links)
        if depth < MOST_DEPTH:
            # the next token of the path: a byte of the sketch, at a place drawn by run and depth
            place = F.pmod(F.col("run") * 31 + depth * 17, F.lit(COORDINATES)).cast("int") + 1
            level = shared.filter(F.col("n") > SMALL).select("id", "sketch", "run", F.xxhash64("bucket", F.substring("sketch", place, F.lit(1))).alias("bucket"))
    return materialize(found.distinct(), "candidates")


def partner_finder(queries: list[bytes], texts: list[str]):
    """(id, text) -> (id, queries): which of the drawn texts a text is linked to, by number."""

    def run(batches):
        h, count = shingle_hashes(texts)
        n = len(texts)
        pair = np.unique(np.stack([h, np.repeat(np.arange(n), count).astype(np.uint64)]), axis=1) if len(h) else np.zeros((2, 0), np.uint64)
        token, owner = pair[0], pair[1].astype(np.int64)
        known = np.unique(token)
        size = np.bincount(owner, minlength=n)
        for batch in batches:
            all_ids, all_texts = batch.column(0).to_pylist(), batch.column(1)
            ids, found = [], []
            for at in range(0, len(all_ids), 128):
                mine, number = shingle_hashes(all_texts.slice(at, 128).to_pylist())
                place = np.searchsorted(known, mine)
                shared = known[np.minimum(place, len(known) - 1)] == mine if len(known) else np.zeros(len(mine), bool)
                ends = np.cumsum(number)
                for i in np.flatnonzero(np.add.reduceat(np.r_[shared, False], np.minimum(ends - number, len(mine))) * (number > 0)):
                    own = np.unique(mine[ends[i] - number[i] : ends[i]])
                    a, b = np.searchsorted(token, own), np.searchsorted(token, own, side="right")
                    both = np.bincount(np.concatenate([owner[a[k] : b[k]] for k in np.flatnonzero(b > a)]), minlength=n)
                    near = [q for q in np.flatnonzero((both > 0) & (both >= SIMILARITY * (size + len(own) - both) - 1e-9)) if queries[q] != all_ids[at + i]]
                    if near:
                        ids.append(all_ids[at + i])
                        found.append(near)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.binary()), pa.array(found, pa.list_(pa.int32()))], ["id", "queries"])

    return run


def audit(rows: DataFrame, nodes: DataFrame, groups: DataFrame, turn: int) -> float:
    """Share of its links, against all texts, that the group of a drawn text holds: the mean
    over those of DRAWN texts that have links.  Texts of over a million characters are held
    against the drawn ones but not drawn.  Only ids are shuffled."""
    picked = nodes.filter("some and copy_id is not null").select("id", "copy_id").orderBy(F.xxhash64("id", F.lit(turn)), "id").limit(DRAWN).collect()
    of = F.col("doc_id").isin(*[r["copy_id"] for r in picked]) & F.col("id").isin(*[bytes(r["id"]) for r in picked]) & (F.length("text") < 1_000_000)
    drawn = {bytes(r[0]): r[1] for r in rows.filter(of).select("id", "text").dropDuplicates(["id"]).collect()} if picked else {}
    if not drawn:
        return 1.0
    order = sorted(drawn)
    own = {bytes(i): bytes(c) for i, c in groups.filter(F.col("id").isin(*order)).select("id", "component").collect()}
    components = [own.get(i, i) for i in order]
    partners = rows.select("id", "text").mapInArrow(partner_finder(order, [drawn[i] for i in order]), "id binary, queries array<int>").dropDuplicates(["id"])
    held = partners.join(groups, "id", "left").select(F.coalesce("component", "id").alias("component"), F.explode("queries").alias("query"))
    mine = F.element_at(F.array(*[F.lit(bytearray(c)) for c in components]), F.col("query") + 1)
    each = held.groupBy("query").agg(F.avg((F.col("component") == mine).cast("int")).alias("share"))
    share = each.agg(F.avg("share")).head()[0]
    return 1.0 if share is None else share


def join(docs: DataFrame) -> DataFrame:
    """doc_id, class_id (least id of its group of linked documents), n_links (other
    documents of similarity >= 0.8, copies included), copy_id (least id of equal texts), kept,
    recall (of the candidate search, as audited); and id, the digest of the text."""
    digest = F.unhex(F.md5(text_or_empty())).alias("id")
    rows = docs.select("doc_id", digest, text_or_empty().alias("text"))
    n_runs, turn, found, recall = runs_needed(), 0, None, 0.0
    while recall < AUDITED:
        sketched = materialize(rows.mapInArrow(sketcher(n_runs << turn, turn), "doc_id long, id binary, some boolean, paths array<long>, sketch binary"), "sketches")
        nodes = materialize(
            sketched.groupBy("id").agg(F.min("doc_id").alias("copy_id"), F.count(F.lit(1)).alias("weight"), F.first("some").alias("some"), F.first("paths").alias("paths"), F.first("sketch").alias("sketch")), "nodes"
        )
        ids = sketched.select("doc_id", "id")
        edges = chosen_paths(nodes)
        found = edges if found is None else found.union(edges)
        groups = connected_components(found)
        recall = audit(rows, nodes, groups, turn)
        turn += 1
    members = nodes.select(F.col("id").alias("_id"), "copy_id", "weight").join(groups.withColumnRenamed("id", "_id"), "_id")
    texts = rows.join(members, (F.col("id") == F.col("_id")) & F.col("doc_id").eqNullSafe(F.col("copy_id"))).select("id", "text", "weight", "component").dropDuplicates(["id"])
    units = in_blocks(texts, "component", BLOCK)
    linked = materialize(gathered(units.select("id", "text", "unit", "side", "both", "weight")).mapInArrow(linker(similar_sets), LINKED), "linked")
    result = with_least(nodes.select("id", "copy_id", "weight"), linked, "copy_id", "class_id")
    kept = F.coalesce(F.col("doc_id") == F.col("class_id"), F.col("class_id").isNull()).alias("kept")
    return spread_join(ids, result, "id", "doc_id").select("doc_id", "class_id", "n_links", "copy_id", kept, F.lit(recall).alias("recall"), "id")


def drop_copies(docs: DataFrame) -> DataFrame:
    """One document of each group stays, the one of least id; columns as in ``docs``."""
    stay = join(docs).filter("kept").select(F.col("doc_id").alias("_doc_id"), F.col("id").alias("_id")).distinct()
    keyed = carried(docs, "doc_id", F.unhex(F.md5(text_or_empty())).alias("_key"))
    left = keyed.join(stay, F.col("doc_id").eqNullSafe(F.col("_doc_id")) & (F.col("_key") == F.col("_id")), "left_semi")
    return left.dropDuplicates(["doc_id", "_key"]).select("_row.*")
