"""Mixing, packing, joins, near-duplicates and models against brute force on small tables."""

import collections
import functools
import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lanternql.llm import embedding_dedup, grouping, jaccard_join, lm_scoring, mixing, packing, toxicity
from lanternql.llm.common import vocabulary
from tests.llm.conftest import prose


def highest_quotients(weights, seats):
    got = [0] * len(weights)
    for _ in range(seats):
        best = max(range(len(weights)), key=lambda i: (weights[i] / (2 * got[i] + 1), -i))
        got[best] += 1
    return got


@pytest.mark.parametrize("weights, seats", [([5, 2, 1], 7), ([1, 1, 1, 1], 6), ([0.3, 100, 40, 7, 7], 53), ([0, 3], 2), ([2, 1], 0), ([1e-9, 1], 5)])
def test_sainte_lague(weights, seats):
    assert mixing.sainte_lague(weights, seats).tolist() == highest_quotients(weights, seats)


def test_targets():
    t = mixing.capped_targets([10, 1000, 100], [5, 2, 1])
    assert t[0] == 30 and t.sum() == pytest.approx(1110) and t[2] == 300 and t[1] == pytest.approx(780)
    assert mixing.capped_targets([0, 0], [5, 2]).tolist() == [0, 0]


def test_mix(docs, texts):
    rows = mixing.mix(docs).collect()
    assert len(rows) == len(texts)
    by_target = collections.defaultdict(int)
    for r in rows:
        assert 0 <= r["taken"] <= 3 * r["size"]
        by_target[(r["source_size"], round(r["target"], 6))] += r["taken"]
    for (size, target), taken in by_target.items():
        assert abs(taken - target) <= max(64, 0.02 * target) and target <= 3 * size + 1e-6
    again = mixing.mix(docs.repartition(5)).collect()
    key = lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["size"], r["taken"])
    assert sorted(map(key, rows)) == sorted(map(key, again))


def test_mix_takes_the_blocks_of_least_hash(spark):
    """What is taken, block by block, by a plain loop over the documents of every shard."""
    rows = [(i, "w " * (1 + i * 37 % 200), "ab"[i % 2]) for i in range(120)] + [(500 + i, "same " * 30, "a") for i in range(4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    seed, block, per_shard = 17, 16, 1500
    got = mixing.mix(df, block_words=block, shard_words=per_shard).collect()
    keyed = df.select("doc_id", "source", F.xxhash64(F.lit(seed), "doc_id", "text").alias("draw")).withColumn("h", F.xxhash64("draw")).collect()
    size = {i: len(t.split()) for i, t, _ in rows}
    sources = sorted({r["source"] for r in keyed})
    sums = [sum(size[r["doc_id"]] for r in keyed if r["source"] == s) for s in sources]
    targets = mixing.capped_targets(sums, mixing.WEIGHTS[: len(sources)])
    seats = highest_quotients(targets.tolist(), round(sum(sums) / block))
    want = []
    for s, total, target, n in zip(sources, sums, targets, seats, strict=True):
        n_shards = max(1, -(-total // per_shard))
        shards = [[r for r in keyed if r["source"] == s and r["h"] % n_shards == k] for k in range(n_shards)]
        shards = [(k, x) for k, x in enumerate(shards) if x]
        sizes = [sum(size[r["doc_id"]] for r in x) for _, x in shards]
        for (k, x), words, quota in zip(shards, sizes, highest_quotients(sizes, n), strict=True):
            blocks = -(-words // block)
            quota = min(quota, 3 * blocks)
            hashes = [r[0] for r in spark.range(blocks).orderBy("id").select(F.xxhash64(F.lit(seed), F.lit(s), F.lit(k).cast("long"), "id")).collect()]
            chosen = set(sorted(range(blocks), key=hashes.__getitem__)[: quota % blocks])
            at = 0
            for r in sorted(x, key=lambda r: (r["draw"], r["doc_id"])):
                n_words = size[r["doc_id"]]
                want.append((r["doc_id"], n_words, total, round(float(target), 6), quota // blocks * n_words + sum(j // block in chosen for j in range(at, at + n_words))))
                at += n_words
    assert sorted((r["doc_id"], r["size"], r["source_size"], round(r["target"], 6), r["taken"]) for r in got) == sorted(want)


def test_apply_mix(docs):
    mixed = mixing.apply_mix(docs)
    assert mixed.columns == docs.columns
    words = F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+"))
    taken, kept = mixing.mix(docs).agg(F.sum("taken")).head()[0], mixed.agg(F.sum(words)).head()[0]
    assert kept == taken
    assert mixed.filter("n_chars <> length(text)").count() == 0


def test_packing(docs, texts, spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    rows = texts + [(3000, "a<|endoftext|>b"), (3001, prose(5, 4000))]
    ids = collections.defaultdict(list)
    for i, x in rows:
        ids[i].append(t.encode(x or "", add_special_tokens=False).ids + [1])
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = packing.pack(df, vocabulary("byte_bpe_50k.json"), open_windows=4, fan_in=2).collect()
    assert sum(r["length"] for r in got) == sum(len(x) for v in ids.values() for x in v)
    sequences = collections.defaultdict(list)
    for r in got:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
        part = lambda x: zlib.crc32(np.array(x[r["start"] : r["start"] + r["length"]], dtype="<u4").tobytes())  # noqa: E731, B023
        assert any(len(x) == r["doc_tokens"] and part(x) == r["ids_crc32"] for x in ids[r["doc_id"]])
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(sequences) <= 1 + math.ceil(1.1 * sum(r["length"] for r in got) / 2048)


def shingles(text):
    words = text.encode().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def groups_of(n, linked):
    root = list(range(n))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for a, b in linked:
        root[find(a)] = find(b)
    return [find(i) for i in range(n)]


def test_jaccard_join(spark, texts):
    r = np.random.default_rng(3)
    base = prose(77, 120).split()
    crowd = []
    for i in range(300):  # one group too large for a bucket, similarities about the threshold
        words = list(base)
        for j in r.choice(len(words), 2, replace=False):
            words[j] = f"w{i}x{j}"
        crowd.append((5000 + i, " ".join(words)))
    rows = texts + crowd
    df = spark.createDataFrame([(*x, 0) for x in rows], "doc_id long, text string, id int").repartition(4)
    sets = [shingles(t or "") for _, t in rows]
    linked = []
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if (rows[i][1] or "") == (rows[j][1] or "") or both and both >= 0.8 * (len(sets[i]) + len(sets[j]) - both):
                linked.append((i, j))
    n_links = collections.Counter(x for pair in linked for x in pair)
    root = groups_of(len(rows), linked)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[root[k]] = min(least.get(root[k], 1 << 60), i)
    want = sorted((str(i), n_links[k], str(least.get(root[k]))) for k, (i, _) in enumerate(rows))
    got = jaccard_join.join(df).collect()
    assert {x["recall"] for x in got} == {1.0}
    assert sorted((str(x["doc_id"]), x["n_links"], str(x["class_id"])) for x in got) == want
    stay = jaccard_join.drop_copies(df)
    assert stay.columns == df.columns
    assert stay.count() == len(set(root))


def test_jaccard_runs_are_repeated_until_the_audit_is_met(spark, monkeypatch):
    """A pass that finds nothing is followed by a larger one."""
    passes, whole = [], jaccard_join.chosen_paths

    def first_finds_nothing(nodes):
        passes.append(nodes.select(F.size("paths")).head()[0])
        return whole(nodes) if len(passes) > 1 else whole(nodes.limit(0))

    monkeypatch.setattr(jaccard_join, "chosen_paths", first_finds_nothing)
    rows = [(i, prose(i // 2, 80) + (" one more" if i % 2 else "")) for i in range(40)]
    got = jaccard_join.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {x["doc_id"]: x["class_id"] for x in got} == {i: i - i % 2 for i in range(40)}
    assert len(passes) == 2 and passes[1] == 2 * passes[0]


def test_jaccard_of_large_buckets(spark, monkeypatch):
    """Buckets split on, down to the last level and then in blocks, lose no link of the whole."""
    monkeypatch.setattr(jaccard_join, "SMALL", 3)
    common = prose(1, 60)
    rows = [(i, common + " " + prose(100 + i // 3, 40) + (f" x{i}" if i % 3 else "")) for i in range(90)]
    got = jaccard_join.join(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert {x["doc_id"]: (x["class_id"], x["n_links"]) for x in got} == {i: (i - i % 3, 2) for i in range(90)}


def test_spread_join_repeats_hot_keys_alone(spark, monkeypatch):
    monkeypatch.setattr(grouping, "HOT_ROWS", 20)
    left = spark.createDataFrame([(b"hot" if i % 2 else b"%d" % i, i) for i in range(200)], "k binary, v int")
    right = left.select("k").distinct().withColumn("w", F.lit(1))
    assert [bytes(k) for k in grouping.hot_keys(left, "k")] == [b"hot"]
    assert grouping.spread_join(left, right, "k", "v").count() == 200
    assert grouping.spread_join(left, right.filter("k <> binary('hot')"), "k", "v", "left").filter("w is null").count() == 100


def test_components(spark):
    chain = [(f"{i:03}".encode(), f"{i + 1:03}".encode()) for i in range(40)] + [(b"x", b"y"), (b"y", b"x")]
    got = dict(map(tuple, grouping.connected_components(spark.createDataFrame([(bytearray(a), bytearray(b)) for a, b in chain], "a binary, b binary")).collect()))
    assert {bytes(v) for k, v in got.items() if bytes(k) not in (b"x", b"y")} == {b"000"} and len(got) == 43


def test_embeddings(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "BLOCK", 16)
    r = np.random.default_rng(5)
    rows, n = [], 0
    for c in range(12):
        centre = r.normal(size=16)
        for _ in range(1 + 5 * (c % 3) + (40 if c == 11 else 0)):
            rows.append((n, (centre + 0.12 * r.normal(size=16)).tolist(), c % 2))
            n += 1
    rows += [(n + i, rows[3][1], rows[3][2]) for i in range(3)]
    odd = [None, [], [0.0] * 16, [None] + [1.0] * 15, [math.nan] * 16, [math.inf] * 16]
    rows += [(n + 10 + i, v, 0) for i, v in enumerate(odd)] + [(n + 20, rows[0][1], None), (None, rows[0][1], 0), (n + 21, rows[0][1][:8], 0)]
    got = embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    fine = [k for k, (i, v, g) in enumerate(rows) if i is not None and g is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    linked = []
    for a in fine:
        for b in fine:
            if a < b and rows[a][2] == rows[b][2] and len(rows[a][1]) == len(rows[b][1]):
                x, y = np.array(rows[a][1]), np.array(rows[b][1])
                if x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.93:
                    linked.append((a, b))
    n_links, root = collections.Counter(x for p in linked for x in p), groups_of(len(rows), linked)
    least = {}
    for k, (i, _, _) in enumerate(rows):
        if i is not None:
            least[root[k]] = min(least.get(root[k], 1 << 60), i)
    want = sorted((str(i), n_links[k], str(least.get(root[k]))) for k, (i, _, _) in enumerate(rows))
    assert sorted((str(x["vec_id"]), x["n_links"], str(x["component_id"])) for x in got) == want


def test_embeddings_links_beyond_the_lists(spark):
    """Two groups of 40, each tight, linked across: no list of 10 has room for a link across."""
    r = np.random.default_rng(8)
    unit = lambda v: v / np.linalg.norm(v)
    a = unit(r.normal(size=64))
    side = r.normal(size=64)
    side = unit(side - (side @ a) * a)
    b = 0.953 * a + math.sqrt(1 - 0.953**2) * side
    x = np.array([unit(c + 0.0085 * r.normal(size=64)) for c in (a, b) for _ in range(40)])
    near = x @ x.T >= 0.93
    assert near[:40, 40:].sum() > 1000 and (x @ x.T)[:40, :40].min() > 0.985
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)]
    got = embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    assert {g["vec_id"]: (g["n_links"], g["component_id"]) for g in got} == {i: (int(near[i].sum()) - 1, 0) for i in range(80)}


def test_embeddings_pairs_among_unlike_vectors(spark, monkeypatch):
    """Pairs that two tables mostly miss meet through neighbours, though none of these is near."""
    monkeypatch.setattr(embedding_dedup, "TABLES", 2)
    monkeypatch.setattr(embedding_dedup, "audit", lambda *_: 1.0)  # one pass only
    r = np.random.default_rng(9)
    unit = lambda v: v / np.linalg.norm(v, axis=-1, keepdims=True)
    x = unit(r.normal(size=(3000, 64)))
    aside = r.normal(size=(100, 64))
    aside = unit(aside - (aside * x[:100]).sum(axis=1, keepdims=True) * x[:100])
    cosine = r.uniform(0.932, 0.95, size=(100, 1))
    x = np.concatenate([x, cosine * x[:100] + np.sqrt(1 - cosine**2) * aside])
    near = np.triu(x @ x.T >= 0.6, 1)
    assert near.sum() <= 110  # nothing but the pairs
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)]
    got = embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    assert sum(g["n_links"] for g in got) / 200 >= 0.97


def scattered_pairs(seed, pairs, crowd):
    """One group of ``crowd`` near vectors, and pairs."""
    r = np.random.default_rng(seed)
    centres = np.concatenate([np.repeat(r.normal(size=(1, 64)), crowd, axis=0), np.repeat(r.normal(size=(pairs, 64)), 2, axis=0)])
    return [(i, v.tolist(), 0) for i, v in enumerate(centres + 0.1 * r.normal(size=centres.shape))]


def test_embeddings_audit_counts_each_node_once(spark):
    rows = scattered_pairs(10, 40, 300)
    nodes = spark.createDataFrame([(bytearray(b"%05d" % i), v, str(g)) for i, v, g in rows], "id binary, vector array<double>, label string")
    crowd = spark.createDataFrame([(bytearray(b"%05d" % i), bytearray(b"00000")) for i in range(300)], "id binary, component binary")
    assert embedding_dedup.audit(nodes, crowd, 0) == pytest.approx(300 / 380)  # all pairs are missed
    assert embedding_dedup.audit(nodes.limit(0), crowd, 0) == 1.0


def test_embeddings_exact_where_passes_miss(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "BLOCK", 32)
    monkeypatch.setattr(embedding_dedup, "MOST_PASSES", 1)
    monkeypatch.setattr(embedding_dedup, "first_edges", lambda nodes, *_: nodes.sparkSession.createDataFrame([], embedding_dedup.EDGE))
    got = embedding_dedup.near_duplicates(spark.createDataFrame(scattered_pairs(11, 30, 50), "vec_id long, embedding array<double>, label int")).collect()
    want = {i: (49, 0) for i in range(50)} | {i: (1, i - i % 2) for i in range(50, 110)}
    assert {g["vec_id"]: (g["n_links"], g["component_id"]) for g in got} == want


def katz(rows, order=3):
    """The model by plain dictionaries: results and probabilities."""
    tokens = {k: [*(t or "").encode().lower().split(), 0] for k, (_, t) in enumerate(rows)}
    held = {k: i is not None and zlib.crc32(str(i).encode()) % 5 == 1 for k, (i, _) in enumerate(rows)}
    one, two, three = (collections.Counter() for _ in range(3))
    after1, after2 = collections.defaultdict(set), collections.defaultdict(set)
    for k, ws in tokens.items():
        u = v = 1
        for w in [] if held[k] else ws:
            one[w] += 1
            two[v, w] += 1
            three[u, v, w] += 1
            after1[v].add(w)
            after2[u, v].add(w)
            u, v = v, w
    hist1, hist2 = collections.Counter(), collections.Counter()
    for (v, _), c in two.items():
        hist1[v] += c
    for (u, v, _), c in three.items():
        hist2[u, v] += c
    numbers = lambda c: [sum(x == r for x in c.values()) for r in range(1, lm_scoring.K + 2)]
    d1, d2, d3 = (lm_scoring.discounts(numbers(c)) for c in (one, two, three))
    cut = lambda c, d: c * (d[c - 1] if c <= lm_scoring.K else 1)
    n, spare = sum(one.values()), lm_scoring.HELD
    unknown = (sum(c - cut(c, d1) for c in one.values()) + spare) / (n + spare)
    p1 = lambda w: cut(one[w], d1) / (n + spare) if one[w] else unknown

    @functools.cache
    def a1(v):
        free = (sum(two[v, w] - cut(two[v, w], d2) for w in after1[v]) + spare) / (hist1[v] + spare)
        return free / max(1 - sum(p1(w) for w in after1[v]), unknown)

    def p2(w, v):
        if order < 2 or not hist1[v]:
            return p1(w)
        return cut(two[v, w], d2) / (hist1[v] + spare) if two[v, w] else a1(v) * p1(w)

    @functools.cache
    def a2(u, v):
        free = (sum(three[u, v, w] - cut(three[u, v, w], d3) for w in after2[u, v]) + spare) / (hist2[u, v] + spare)
        return free / max(1 - sum(p2(w, v) for w in after2[u, v]), a1(v) * unknown)

    def p(w, u, v):
        if order < 3 or not hist2[u, v]:
            return p2(w, v)
        return cut(three[u, v, w], d3) / (hist2[u, v] + spare) if three[u, v, w] else a2(u, v) * p2(w, v)

    out = []
    for k, ws in tokens.items():
        score = base = known = 0
        u = v = 1
        for w in ws:
            score += math.log10(p(w, u, v))
            base += math.log10((one[w] + 0.5) / (n + 0.5 * (len(one) + 1)))
            known += one[w] > 0
            u, v = v, w
        out.append((str(rows[k][0]), held[k], len(ws), known, n, base, score))
    return out, p, one, hist2


def same_scores(got, want):
    assert len(got) == len(want)
    for a, b in zip(sorted((str(x[0]), *x[1:]) for x in got), sorted(want), strict=True):
        assert a[:5] == b[:5]
        assert a[5:] == pytest.approx(b[5:], rel=1e-9)
        assert a[6] <= 0


@pytest.mark.parametrize(("flush", "part", "ways"), [(1 << 20, 2 << 20, 2048), (300, 4000, 2048), (700, 300, 5)])
def test_katz(spark, texts, monkeypatch, flush, part, ways):
    """One flush and part; many, with hot words spread over parts; and messages dealt twice."""
    for name, value in (("FLUSH_TOKENS", flush), ("PART_TOKENS", part), ("WAYS", ways), ("GROUP_DOCS", 9)):
        monkeypatch.setattr(lm_scoring, name, value)
    rows = texts + [(7000 + i, " ".join(["the same words again"] * (i + 1))) for i in range(25)]
    rows += [(7100 + i, rows[i][1]) for i in range(20)]  # the same texts, some held out
    want, p, one, hist = katz(rows)
    for u, v in [(1, 1), (b"the", b"same"), *list(hist)[5:8]]:
        assert sum(p(w, u, v) for w in [*one, b"never seen"]) == pytest.approx(1, abs=1e-9)
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, part int, flush string").repartition(3)
    same_scores(lm_scoring.score(df).collect(), want)


@pytest.mark.parametrize("order", [1, 2])
def test_katz_lower_orders(spark, texts, order):
    want, *_ = katz(texts, order)
    same_scores(lm_scoring.score(spark.createDataFrame(texts, "doc_id long, text string").repartition(2), order).collect(), want)


def test_katz_where_little_is_left(spark):
    """Histories whose continuations hold nearly all mass, and no training text at all."""
    held = [i for i in range(200) if zlib.crc32(str(i).encode()) % 5 == 1]
    train = [i for i in range(200) if i not in held]
    rows = [(i, "a a a a") for i in train[:40]] + [(held[0], "a b"), (held[1], "b b a"), (held[2], "a a a a"), (held[3], None)]
    want, p, one, _ = katz(rows)
    for u, v in [(1, 1), (1, b"a"), (b"a", b"a")]:
        assert sum(p(w, u, v) for w in [*one, b"never seen"]) == pytest.approx(1, abs=1e-9)
    same_scores(lm_scoring.score(spark.createDataFrame(rows, "doc_id long, text string")).collect(), want)
    none = [(held[0], "x y"), (held[1], "")]
    same_scores(lm_scoring.score(spark.createDataFrame(none, "doc_id long, text string")).collect(), katz(none)[0])


def test_discounts_fall_back():
    assert lm_scoring.discounts([0] * 6).tolist() == [0.5, 0.75, 2.5 / 3, 0.875, 0.9]


def test_toxicity(spark):
    r = np.random.default_rng(2)
    rows, labels = [], []
    for i in range(900):
        text, bad = prose(i, 60), i % 4 == 0
        if bad:
            words = text.split()
            for j in r.choice(60, 3):
                words[j] = r.choice(["idiot", "moron", f"zurgle{r.integers(99)}", f"zurgle{r.integers(99)}"])
            text = " ".join(words)
        rows.append((i, text))
        labels.append((i, int(bad)))
    rows += [(10_000, None), (10_001, ""), (10_002, "x" * 5000), (None, "no id"), (3, rows[3][1])]
    labels += [(5, None), (None, 1), (4, 1), (20_000, 1)]
    docs_, labels_ = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    got = toxicity.toxicity(docs_, labels_).collect()
    assert len(got) == len(rows)
    hits = [(x["predicted"] == (x["doc_id"] % 4 == 0)) for x in got if x["held_out"] and x["doc_id"] < 900]
    assert len(hits) > 200 and sum(hits) / len(hits) > 0.97
    assert all(0 <= x["score"] <= 1 and x["predicted"] == (x["score"] >= 0.7) for x in got)
    none = toxicity.toxicity(docs_, labels_.filter("false")).agg(F.max("score")).head()[0]
    assert none < 0.7


def test_toxicity_sample_is_bounded(spark):
    """One row of an id, however often documents repeat it."""
    docs_ = spark.createDataFrame([(i % 20, f"text {i % 3}") for i in range(400)], "doc_id long, text string")
    labels_ = spark.createDataFrame([(i, i % 2) for i in range(20)], "doc_id long, toxic int")
    rows = toxicity.training_rows(docs_, labels_, F.lit(True), 3).collect()
    assert len(rows) == len({r["doc_id"] for r in rows}) == 3


def test_near_second_person_at_every_length():
    lexicon = {0: frozenset(["zurgle"]), **{k: frozenset() for k in toxicity.STEMS}}
    r = np.random.default_rng(4)
    for n_du in (3, 999, 1000, 2500):
        words = ["du"] * n_du + ["wort"] * 2000
        r.shuffle(words)
        words += ["wort"] * 10 + ["zurgle", "wort", "zurgle", "wort", "wort", "wort", "du"]
        for j in r.choice(len(words) - 20, 30, replace=False):
            words[j] = "zurgle"
        you = [j for j, w in enumerate(words) if w == "du"]
        want = sum(any(abs(i - j) <= 4 for j in you) for i, w in enumerate(words) if w == "zurgle")
        assert toxicity.features(" ".join(words), lexicon)[toxicity.NAMES.index("near")] == want


def test_no_rows(spark, no_docs):
    assert mixing.mix(no_docs).count() == 0
    assert mixing.apply_mix(no_docs).count() == 0
    assert packing.pack(no_docs, vocabulary("byte_bpe_50k.json")).count() == 0
    assert jaccard_join.join(no_docs).count() == 0
    assert jaccard_join.drop_copies(no_docs).count() == 0
    assert lm_scoring.score(no_docs).count() == 0
    assert embedding_dedup.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0
    assert toxicity.toxicity(no_docs, spark.createDataFrame([], "doc_id long, toxic int")).count() == 0
