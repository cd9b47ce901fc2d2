"""Language-model scoring: Katz backoff up to three words.

Counts come from the training documents alone.  Good-Turing discounts apply to counts up to
K; what they free after a history goes to the words not seen after it, in proportion to the
next lower model, by a weight that makes the history's probabilities sum to one:

    P3(w | u v) = d3(c) c(u v w) / (c(u v) + HELD)   if u v w was seen
                = a(u v) P2(w | v)                   if only u v was seen
                = P2(w | v)                          otherwise
    P2(w | v)   = d2(c) c(v w) / (c(v) + HELD)       if v w was seen
                = a(v) P1(w)                         if only v was seen
                = P1(w)                              otherwise
    P1(w)       = d1(c) c(w) / (N + HELD), or the rest for all unknown words together

HELD, a hundredth of a count, is held back at every level, so a history whose continuations
are all frequent can still back off and the rest for unknown words is never zero.  As unknown
words are never seen after anything, what is left beside the seen words of a history is at
least their share: no weight divides by zero, and no probability exceeds one.

Words are known by numbers from a vocabulary of the whole corpus, so two words are never
taken for one.  A document's text passes through four stages, each of which holds a bounded
number of tokens in a task:

* flushes of FLUSH_TOKENS tokens: distinct words, and the tokens as places among them;
* parts of the vocabulary count the words of all flushes and number them;
* parts of the n-grams count the trigrams of the training documents of all flushes.  A part holds all trigrams
  around a middle word, so it knows c(u v w), c(u v), c(v w), c(v) and both weights.  Words of
  more than a part's tokens are spread over all parts by the word before; for these,
  c(v w) and a(v) are added up across parts first;
* the same parts, with the trigrams of the other documents too, give sums by document.

Between stages travel rows of integer arrays (``packed``), one for each flush and part, at most
WAYS parts at a time: beyond that, messages go to groups of parts and are dealt again there.

Null text: as empty, one token (the end).  Null ids: training rows.  Repeated rows count
each.  Very long texts: a document is one flush of its own.  No training rows: every word is
unknown.  Empty table: empty result.  Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lanternql.llm.common import discard, in_hash_bucket, materialize
from lanternql.llm.grouping import spread_join

K = 5
HELD = 0.01
ORDER = 3
FLUSH_TOKENS = 1 << 20
PART_TOKENS = 2 << 20
#: Most parts that messages of one flush are dealt to at once.
WAYS = 2048
GROUP_DOCS = 500_000
END = b""
#: Number of the mark before a document; words are numbered from 1.
START = 0

TOKENS = "flush long, doc_ids array<long>, held array<boolean>, n array<int>, ids binary, parts array<int>, words array<binary>, train array<binary>"
WORDS = "kind string, part int, flush long, words binary, ids binary, counts binary, sums array<long>"
NUMBERED = "flush long, doc_ids array<long>, held array<boolean>, n array<int>, known array<int>, base array<double>, ids binary, names binary, totals binary"
MESSAGE = "part int, kind string, flushes array<long>, names binary, totals binary, v binary, u binary, w binary, times binary, at binary, docs binary"
COUNTS = "kind string, part int, flushes array<long>, names binary, totals binary, v binary, u binary, w binary, c3 binary, c2 binary, times binary, at binary, docs binary, keys array<long>, seconds array<long>, thirds array<long>, counts array<long>"
#: Sums by document; and for bigrams of hot words, what to add to a document's sum if the
#: bigram was seen (score, beside its discounted count) and if not (unseen, beside the weight).
RESULTS = "kind string, group int, flush array<long>, doc array<int>, score array<double>, v array<long>, w array<long>, unseen array<double>"


# integers on the way


def packed(a: np.ndarray) -> bytes:
    """Non-negative integers: one byte for their width, then zstd of their bytes, first bytes first."""
    import zstandard

    a = np.asarray(a)
    most = int(a.max()) if len(a) else 0
    width = next(k for k in (1, 2, 4, 8) if most < 1 << (8 * k))
    planes = a.astype(f"<u{width}").view(np.uint8).reshape(-1, width).T
    return bytes([width]) + zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def unpacked(b: bytes) -> np.ndarray:
    import zstandard

    width = b[0]
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(b[1:]), dtype=np.uint8).reshape(width, -1)
    return np.ascontiguousarray(planes.T).view(f"<u{width}").ravel().astype(np.int64)


def batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "binary": pa.binary(), "string": pa.string(), "boolean": pa.bool_()}
    fields = [f.split(" ") for f in schema.split(", ")]
    types = [pa.list_(kinds[k[6:-1]]) if k.startswith("array<") else kinds[k] for _, k in fields]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], [n for n, _ in fields])


def rows_of(batches):
    """Rows as dicts, one at a time; array columns as numpy arrays where they hold numbers."""
    for b in batches:
        columns = {n: b.column(i) for i, n in enumerate(b.schema.names)}
        for i in range(b.num_rows):
            out = {}
            for n, c in columns.items():
                v = c[i]
                if not v.is_valid:
                    out[n] = None
                elif pa.types.is_list(c.type) and c.type.value_type in (pa.int32(), pa.float64()) or pa.types.is_list(c.type) and c.type.value_type == pa.int64() and not v.values.null_count:
                    out[n] = v.values.to_numpy()
                else:
                    out[n] = v.as_py()
            yield out


def runs_of(rows, key: str):
    """(key, iterator of its rows) from rows sorted by it."""
    import itertools

    for k, own in itertools.groupby(rows, lambda r: r[key]):
        yield k, own


def mixed(x: np.ndarray) -> np.ndarray:
    """Numbers spread over all 64 bits."""
    h = x.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def ascending(a: np.ndarray) -> bytes:
    """Numbers in order: their steps are packed."""
    return packed(np.diff(a, prepend=0) if len(a) else a)


def stepped(outer: np.ndarray, inner: np.ndarray) -> bytes:
    """Numbers in order wherever ``outer`` stays the same: steps within, whole ones at each start."""
    if not len(inner):
        return packed(inner)
    same = np.r_[False, outer[1:] == outer[:-1]]
    return packed(np.where(same, inner - np.r_[0, inner[:-1]], inner))


def unstepped(outer: np.ndarray, steps: np.ndarray) -> np.ndarray:
    if not len(steps):
        return steps
    whole = np.cumsum(steps)
    start = np.flatnonzero(np.r_[True, outer[1:] != outer[:-1]])
    before = whole[start] - steps[start]
    return whole - np.repeat(before, np.diff(np.r_[start, len(steps)]))


def words_packed(words: list[bytes]) -> bytes:
    """Words hold no white space, so it parts them; one more stands first, as END is empty."""
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(b" " + b" ".join(words))


def words_unpacked(b: bytes) -> list[bytes]:
    import zstandard

    return zstandard.ZstdDecompressor().decompress(b)[1:].split(b" ")


# words


def runs_in(a: np.ndarray):
    """(from, to) of the runs of equal values."""
    if not len(a):
        return []
    cut = np.flatnonzero(np.r_[True, a[1:] != a[:-1], True])
    return list(zip(cut[:-1], cut[1:], strict=True))


class Places(dict):
    """Keys by the order they came in."""

    def __missing__(self, key):
        self[key] = n = len(self)
        return n


def flusher(n_parts: int):
    """(doc_id, held, text) -> a row for each flush: its distinct words by part of the
    vocabulary, their counts in training documents, and the tokens as places among them."""

    def flush_row(number: int, docs: list[tuple]) -> tuple:
        import xxhash

        place = Places()
        flat: list[bytes] = []
        for _, _, ws in docs:
            flat += ws
            flat.append(END)
        tokens = np.fromiter(map(place.__getitem__, flat), dtype=np.int64, count=len(flat))
        n = np.array([len(ws) + 1 for _, _, ws in docs], dtype=np.int32)
        held = np.array([h for _, h, _ in docs], dtype=bool)
        words = list(place)
        part = np.fromiter((xxhash.xxh3_64_intdigest(w) % n_parts for w in words), dtype=np.int64, count=len(words))
        order = np.argsort(part, kind="stable")
        new = np.empty_like(order)
        new[order] = np.arange(len(order))
        tokens = new[tokens]
        train = np.bincount(tokens[np.repeat(~held, n)], minlength=len(words))
        own = part[order]
        cuts = [(int(own[a]), a, b) for a, b in runs_in(own)]
        words = [words[i] for i in order]
        return (number, [d for d, _, _ in docs], held, n, packed(tokens), [p for p, _, _ in cuts], [words_packed(words[a:b]) for _, a, b in cuts], [packed(train[a:b]) for _, a, b in cuts])

    def run(batches):
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        docs, size = [], 0
        for b in batches:
            for doc_id, held, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                # lower case and white space of ASCII alone
                words = (text.as_py() or "").encode().lower().split()
                if docs and size + len(words) > FLUSH_TOKENS:
                    yield batch([flush_row(number, docs)], TOKENS)
                    docs, size, number = [], 0, number + 1
                docs.append((doc_id, held, words))
                size += len(words) + 1
        if docs:
            yield batch([flush_row(number, docs)], TOKENS)

    return run


def word_counter(n_parts: int):
    """A part of the vocabulary: words are numbered by falling count, and every flush gets the
    numbers and counts of its words back, in its own order."""

    def run(batches):
        for part, rows in runs_of(rows_of(batches), "part"):
            place, asked = Places(), []
            counts = np.zeros(1024, dtype=np.int64)
            for r in rows:
                words = words_unpacked(r["words"])
                at = np.fromiter(map(place.__getitem__, words), dtype=np.int64, count=len(words))
                if len(place) > len(counts):
                    counts = np.concatenate([counts, np.zeros(2 * len(place), dtype=np.int64)])
                counts[at] += unpacked(r["train"])
                asked.append((r["flush"], at))
            counts = counts[: len(place)]
            order = np.argsort(-counts, kind="stable")
            number = np.empty_like(order)
            number[order] = np.arange(len(order)) * n_parts + part + 1
            for flush, at in asked:
                yield batch([("answer", part, flush, None, packed(number[at]), packed(counts[at]), None)], WORDS)
            yield batch([("word", part, None, words_packed([w for w in place]), packed(number), packed(counts), None)], WORDS)
            sums = [int(counts.sum()), int((counts > 0).sum()), *[int((counts == r).sum()) for r in range(1, K + 2)]]
            yield batch([("stats", part, None, None, None, None, sums)], WORDS)

    return run


class Unigrams:
    """What every task needs to know of all words: a few sums."""

    def __init__(self, stats: list[int]):
        self.tokens, self.types = stats[0], stats[1]
        self.d = discounts(stats[2:])
        freed = sum(r * n * (1 - d) for r, n, d in zip(range(1, K + 1), stats[2:], self.d, strict=False))
        self.unknown = (freed + HELD) / (self.tokens + HELD)

    def probability(self, count: np.ndarray) -> np.ndarray:
        return np.where(count > 0, discounted(count, self.d) / (self.tokens + HELD), self.unknown)

    def base(self, count: np.ndarray) -> np.ndarray:
        return np.log10((count + 0.5) / (self.tokens + 0.5 * (self.types + 1)))


def discounts(of_count: list[int]) -> np.ndarray:
    """d(1..K) of Good-Turing after Katz, from the numbers of types with count 1..K+1.
    Where these are too few to give a ratio in (0, 1), half a count is taken off."""
    n = [0, *of_count]
    out = []
    common = (K + 1) * n[K + 1] / n[1] if n[1] else 1.0
    for r in range(1, K + 1):
        d = ((r + 1) * n[r + 1] / (r * n[r]) - common) / (1 - common) if n[r] and common < 1 else 0.0
        out.append(d if 0 < d < 1 else (r - 0.5) / r)
    return np.array(out)


def discounted(count: np.ndarray, d: np.ndarray) -> np.ndarray:
    return count * np.concatenate([[0.0], d, [1.0]])[np.minimum(count, K + 1)]


def numberer(uni: Unigrams):
    """A flush with the answers to it: tokens as places among the numbers of its words, the
    frequent ones first, and by document the known tokens and the base score."""

    def run(batches):
        for _, rows in runs_of(rows_of(batches), "flush"):
            own = next(rows)
            answers = list(rows)  # by part, as the words are
            names, totals = (np.concatenate([unpacked(r[k]) for r in answers]) for k in ("ids", "counts"))
            order = np.argsort(-totals, kind="stable")
            place = np.empty_like(order)
            place[order] = np.arange(len(order))
            tokens = unpacked(own["blob"])
            n = own["n"]
            c = totals[tokens]
            first = np.cumsum(n) - n
            known = np.add.reduceat((c > 0).astype(np.int32), first)
            base = np.add.reduceat(uni.base(c), first)
            yield batch([(own["flush"], list(own["doc_ids"]), list(own["held"]), n, known, base, packed(place[tokens]), packed(names[order]), packed(totals[order]))], NUMBERED)

    return run


# trigrams


class Dealer:
    """Where trigrams go: by the middle word, or by the first two where it is hot."""

    def __init__(self, n_parts: int, hot: int):
        self.n_parts, self.hot = n_parts, hot

    def part(self, names: np.ndarray, totals: np.ndarray, v: np.ndarray, u: np.ndarray) -> np.ndarray:
        h = mixed(names)
        own = np.where(totals[v] > self.hot, mixed((h[v] ^ (h[u] >> np.uint64(1))).astype(np.uint64)), h[v])
        return (own % np.uint64(self.n_parts)).astype(np.int64)


def trigrams(row: dict, start_total: int, training: bool):
    """names, totals, u, v, w and document of the tokens of a flush, of training or other documents."""
    names, totals, tokens = unpacked(row["names"]), unpacked(row["totals"]), unpacked(row["ids"])
    names, totals = np.append(names, START), np.append(totals, start_total)
    n, mark = row["n"].astype(np.int64), len(names) - 1
    doc = np.repeat(np.arange(len(n)), n)
    at = np.arange(len(tokens)) - np.repeat(np.cumsum(n) - n, n)
    v = np.where(at > 0, np.r_[mark, tokens[:-1]], mark)
    u = np.where(at > 1, np.r_[mark, mark, tokens[:-2]][: len(tokens)], mark)
    keep = np.asarray(row["held"], dtype=bool)[doc] != training
    return names, totals, u[keep], v[keep], tokens[keep], doc[keep]


def messages(names, totals, u, v, w, at, docs, flushes, part):
    """Rows of MESSAGE from trigram occurrences (sorted here): a dictionary of the words in
    each, and the distinct trigrams with the documents they occur in."""
    width = np.int64(len(names))
    by_name = np.argsort(names, kind="stable")
    rank = np.empty_like(by_name)
    rank[by_name] = np.arange(len(by_name))
    names, totals = names[by_name], totals[by_name]
    u, v, w = rank[u], rank[v], rank[w]
    if width < 1 << 20 and part.max(initial=0) < 1 << 16:
        order = np.argsort((v * width + u) * width + w)
        order = order[np.argsort(part[order].astype(np.uint16), kind="stable")]
    else:
        order = np.lexsort((w, u, v, part))
    u, v, w, part = u[order], v[order], w[order], part[order]
    new = np.flatnonzero(np.r_[True, (part[1:] != part[:-1]) | (v[1:] != v[:-1]) | (u[1:] != u[:-1]) | (w[1:] != w[:-1])]) if len(u) else np.zeros(0, np.int64)
    number, docs, at = np.diff(np.r_[new, len(u)]), docs[order], at[order]
    u, v, w = u[new], v[new], w[new]
    own = part[new]
    seen = np.zeros(len(names), dtype=bool)
    local = np.empty(len(names), dtype=np.int64)
    out = []
    for a, b in runs_in(own):
        seen[u[a:b]] = seen[v[a:b]] = seen[w[a:b]] = True
        used = np.flatnonzero(seen)
        seen[used] = False
        local[used] = np.arange(len(used))
        i, j = new[a], new[b] if b < len(new) else len(docs)
        lv, lu, lw = local[v[a:b]], local[u[a:b]], local[w[a:b]]
        out.append((int(own[a]), "look", flushes, ascending(names[used]), packed(totals[used]), ascending(lv), stepped(lv, lu), stepped(lv * len(used) + lu, lw), packed(number[a:b]), packed(at[i:j]), packed(docs[i:j])))
    return out


def sender(dealer: Dealer, start_total: int, training: bool, ways: int):
    """The trigrams of a flush, to parts, or to groups of parts where these are many."""

    def run(batches):
        for r in rows_of(batches):
            names, totals, u, v, w, doc = trigrams(r, start_total, training)
            if not len(u):
                continue
            out = messages(names, totals, u, v, w, np.zeros(len(u), dtype=np.int64), doc, [r["flush"]], dealer.part(names, totals, v, u) // ways)
            for a in range(0, len(out), 64):
                yield batch(out[a : a + 64], MESSAGE)

    return run


def opened(r: dict):
    """names, totals, v, u, w of a row."""
    names, v = np.cumsum(unpacked(r["names"])), np.cumsum(unpacked(r["v"]))
    u = unstepped(v, unpacked(r["u"]))
    return names, unpacked(r["totals"]), v, u, unstepped(v * len(names) + u, unpacked(r["w"]))


class Pile:
    """Messages opened and put together, under one dictionary."""

    def __init__(self, with_docs: bool = True):
        self.with_docs = with_docs
        self.parts: list[list[np.ndarray]] = [[] for _ in range(8 if with_docs else 6)]
        self.flushes: list[int] = []
        self.size, self.words = 0, 0

    def add(self, r: dict) -> None:
        names, totals, v, u, w = opened(r)
        # places and times in four bytes: a pile is bounded, and most of a task's memory
        got = [names, totals, *((x + self.words).astype(np.int32) for x in (v, u, w)), unpacked(r["times"]).astype(np.int32)]
        if self.with_docs:
            got += [unpacked(r["at"]) + len(self.flushes), unpacked(r["docs"])]
            self.flushes += list(r["flushes"])
        for held, more in zip(self.parts, got, strict=False):
            held.append(more)
        self.words += len(names)
        self.size += int(got[5].sum())

    def opened(self):
        """names (sorted), totals, v, u, w, times, at, docs."""
        cat = [np.concatenate(p) if p else np.zeros(0, np.int64) for p in self.parts]
        names, first, place = np.unique(cat[0], return_index=True, return_inverse=True)
        place = place.astype(np.int32)
        self.parts = []
        return (names, cat[1][first], *(place[x] for x in cat[2:5]), *cat[5:])


def redealer(dealer: Dealer):
    """Messages of a group of parts, a pile at a time, to the parts."""

    def dealt(pile: Pile):
        names, totals, v, u, w, times, at, docs = pile.opened()
        u, v, w = (np.repeat(x, times).astype(np.int64) for x in (u, v, w))
        return messages(names, totals, u, v, w, at, docs, pile.flushes, dealer.part(names, totals, v, u))

    def run(batches):
        pile = Pile()
        for r in rows_of(batches):
            pile.add(r)
            if pile.size >= FLUSH_TOKENS:
                yield batch(dealt(pile), MESSAGE)
                pile = Pile()
        if pile.size:
            yield batch(dealt(pile), MESSAGE)

    return run


def counter(hot: int):
    """All training trigrams of a part, counted: a row "table" of parallel arrays; each message
    again as a row "seen", its trigrams by their places in the table; a row "spread" of the
    bigrams of hot middle words, which other parts hold too; count-of-counts."""

    def run(batches):
        for part, rows in runs_of(rows_of(batches), "part"):
            pile, sent = Pile(with_docs=False), []
            for r in rows:
                pile.add(r)
                sent.append((len(pile.parts[5][-1]), r["flushes"], r["times"], r["at"], r["docs"]))
            names, totals, v, u, w, times = pile.opened()
            width = np.int64(len(names))
            # a trigram as one number, or, where the words are too many for that, its place among them
            key = v.astype(np.int64) * width + u
            histories = None
            if width >= 1 << 20:
                histories, key = np.unique(key, return_inverse=True)
            key = key * width + w
            del v, u, w
            order = np.argsort(key)
            key = key[order]
            new = np.r_[True, key[1:] != key[:-1]]
            place = np.empty(len(order), dtype=np.int32)
            place[order] = np.cumsum(new) - 1
            c3 = np.add.reduceat(times[order].astype(np.int64), np.flatnonzero(new))
            key = key[new]
            del order, new, times
            w, key = key % width, key // width
            key = key if histories is None else histories[key]
            v, u = key // width, key % width
            del key
            pair, of = np.unique(v * width + w, return_inverse=True)
            total = np.bincount(of, c3).astype(np.int64)
            spread = totals[pair // width] > hot
            yield batch([("table", part, None, ascending(names), packed(totals), ascending(v), stepped(v, u), stepped(v * width + u, w), packed(c3), packed(total[of]), *[None] * 7)], COUNTS)
            at = 0
            for n, flushes, *blobs in sent:
                yield batch([("seen", part, flushes, None, None, ascending(place[at : at + n]), *[None] * 4, *blobs, *[None] * 4)], COUNTS)
                at += n
            if spread.any():
                keys, seconds = pair[spread] // width, pair[spread] % width
                yield batch([("spread", part, *[None] * 11, names[keys], names[seconds], totals[seconds], total[spread])], COUNTS)
            stats = [[int((x == r).sum()) for r in range(1, K + 2)] for x in (c3, total[~spread])]
            yield batch([("stats", part, *[None] * 11, None, None, stats[0], stats[1])], COUNTS)

    return run


class Table:
    """The counts of a part, with weights: looks up trigrams."""

    def __init__(self, row: dict, fixes: list[dict], uni: Unigrams, d2: np.ndarray, d3: np.ndarray, hot: int, order: int):
        self.names, self.totals, v, u, w = opened(row)
        c3, c2 = unpacked(row["c3"]), unpacked(row["c2"])
        self.uni, self.d2, self.d3, self.hot, self.order = uni, d2, d3, hot, order
        self.width = width = np.int64(len(self.names))
        self.pair, first, of = np.unique(v * width + w, return_index=True, return_inverse=True)
        self.c2 = c2[first]
        a2_hot: dict[int, float] = {}
        for f in fixes:  # what all parts together know of hot words
            if f["kind"] == "fix":
                at = np.searchsorted(self.pair, np.searchsorted(self.names, f["keys"]) * width + np.searchsorted(self.names, f["seconds"]))
                self.c2[at] = f["counts"]
            else:
                a2_hot |= dict(zip(np.searchsorted(self.names, f["keys"]).tolist(), f["weights"], strict=True))
        # weights of middle words
        heads = self.pair // width
        self.a2 = np.ones(len(self.names))
        known, start = np.unique(heads, return_index=True)
        if len(known):
            seen = self.c2
            p1 = uni.probability(self.totals[self.pair % width])
            free = np.add.reduceat(seen - discounted(seen, d2), start) + HELD
            self.a2[known] = free / (self.totals[known] + HELD) / np.maximum(1 - np.add.reduceat(p1, start), uni.unknown)
        for i, weight in a2_hot.items():
            self.a2[i] = weight
        p2 = discounted(self.c2, d2) / (self.totals[heads] + HELD) if len(heads) else np.zeros(0)
        # weights of the first two words
        both = v * width + u
        start = np.flatnonzero(np.r_[True, both[1:] != both[:-1]]) if len(both) else np.zeros(0, np.int64)
        self.history = both[start]
        self.tri, self.c3 = both * width + w, c3
        if width >= 1 << 21:  # such numbers do not fit: the place of the history stands for it
            self.tri = np.searchsorted(self.history, both) * width + w
        self.wide = width >= 1 << 21
        self.c12 = self.a3 = self.own = np.zeros(0)
        if len(self.history):
            self.c12 = np.add.reduceat(c3, start)
            free = np.add.reduceat(c3 - discounted(c3, d3), start) + HELD
            number = np.diff(np.r_[start, len(c3)])
            self.own = np.log10(discounted(c3, d3)) - np.repeat(np.log10(self.c12 + HELD), number)
            least = self.a2[self.history // width] * uni.unknown
            self.a3 = free / (self.c12 + HELD) / np.maximum(1 - np.add.reduceat(p2[of], start), least)

    def scored_alone(self, row: dict, at_once: int = 200_000) -> np.ndarray:
        """log10 P of the table's own trigrams by a lower model, some at a time."""
        names, totals, v, u, w = opened(row)
        return np.concatenate([self.log_probability(names, totals, v[a : a + at_once], u[a : a + at_once], w[a : a + at_once])[0] for a in range(0, max(1, len(v)), at_once)])

    def log_probability(self, names, totals, v, u, w):
        """log10 P of each trigram; and of those whose bigram other parts must tell: their places,
        log10 P1 of the last word, and the count of the middle one."""
        at = np.searchsorted(self.names, names)
        at = np.where((at < len(self.names)) & (self.names[np.minimum(at, len(self.names) - 1)] == names), at, -1) if len(self.names) else np.full(len(names), -1)
        width = self.width

        def place(keys, wanted, fine):
            i = np.searchsorted(keys, wanted)
            return np.where(fine & (i < len(keys)) & (keys[np.minimum(i, max(0, len(keys) - 1))] == wanted), i, -1) if len(keys) else np.full(len(wanted), -1)

        tv, tu, tw = at[v], at[u], at[w]
        out = np.zeros(len(v))
        if self.order > 2:
            h = place(self.history, tv * width + tu, (tv >= 0) & (tu >= 0))
            t = place(self.tri, (h if self.wide else tv * width + tu) * width + tw, (h >= 0) & (tw >= 0))
            seen = t >= 0
            out[seen] = np.log10(discounted(self.c3[t[seen]], self.d3)) - np.log10(self.c12[h[seen]] + HELD)
            back = ~seen & (h >= 0)
            out[back] = np.log10(self.a3[h[back]])
            rest = np.flatnonzero(~seen)
        else:
            rest = np.arange(len(v))
        cv, cw = totals[v[rest]], totals[w[rest]]
        p1 = np.log10(self.uni.probability(cw))
        if self.order < 2:
            out[rest] += p1
            return out, None
        p = place(self.pair, tv[rest] * width + tw[rest], (tv[rest] >= 0) & (tw[rest] >= 0))
        weight = np.where((cv > 0) & (tv[rest] >= 0), np.log10(self.a2[tv[rest]]) if len(self.names) else 0.0, 0.0)
        unseen = weight + p1
        two = p >= 0
        known = unseen.copy()
        known[two] = np.log10(discounted(self.c2[p[two]], self.d2)) - np.log10(cv[two] + HELD)
        # a hot word's bigram and weight may be known to other parts alone
        ask = ~two & (cv > self.hot)
        out[rest[~ask]] += known[~ask]
        if not ask.any():
            return out, None
        return out, (rest[ask], p1[ask], cv[ask])


def evaluator(uni: Unigrams, d2, d3, hot: int, order: int, n_groups: int):
    """Sums of log10 probabilities by document, from the trigrams of all documents and the
    tables of their parts: a table's own trigrams are computed once, others looked up."""

    def run(batches):
        for _, rows in runs_of(rows_of(batches), "part"):
            table, own_scores, fixes, sums, size = None, None, [], [], 0
            for r in rows:
                if r["kind"] in ("fix", "weight"):
                    fixes.append(r)
                    continue
                if r["kind"] == "table":
                    table = Table(r, fixes, uni, d2, d3, hot, order)
                    own_scores = table.own if order > 2 else table.scored_alone(r)
                    continue
                if table is None:  # no training text has come here
                    table = Table({k: packed(np.zeros(0, np.int64)) for k in ("names", "totals", "v", "u", "w", "c3", "c2")}, [], uni, d2, d3, hot, order)
                times, at, docs = (unpacked(r[k]) for k in ("times", "at", "docs"))
                if r["kind"] == "seen":
                    score, ask = own_scores[np.cumsum(unpacked(r["v"]))], None
                else:
                    names, totals, v, u, w = opened(r)
                    score, ask = table.log_probability(names, totals, v, u, w)
                flushes = np.asarray(r["flushes"])
                most = int(docs.max()) + 1
                total = np.bincount(at * most + docs, np.repeat(score, times))
                some = np.flatnonzero(np.bincount(at * most + docs))
                sums.append((flushes[some // most], some % most, total[some]))
                size += len(some)
                if ask is not None:
                    places, unseen, cv = ask
                    number = times[places]
                    own = np.repeat((np.cumsum(times) - times)[places] - (np.cumsum(number) - number), number) + np.arange(int(number.sum()))
                    yield ("ask", 0, flushes[at[own]], docs[own], np.repeat(-np.log10(cv + HELD), number), np.repeat(names[v[places]], number), np.repeat(names[w[places]], number), np.repeat(unseen, number))
                if size > 1 << 20:
                    yield from grouped(sums)
                    sums, size = [], 0
            if sums:
                yield from grouped(sums)

    def grouped(sums: list) -> list[tuple]:
        flush, doc, total = (np.concatenate(x) for x in zip(*sums, strict=True))
        group = ((flush >> 32) * 31 + (flush & 0xFFFFFFFF)) % n_groups
        order = np.argsort(group, kind="stable")
        group, flush, doc, total = group[order], flush[order], doc[order], total[order]
        cut = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
        return [("sums", int(group[a]), flush[a:b], doc[a:b], total[a:b], None, None, None) for a, b in zip(cut, np.r_[cut[1:], len(group)], strict=True)]

    return lambda batches: (batch([row], RESULTS) for row in run(batches))


def finisher(batches):
    """The sums of a group of flushes, in a fixed order, beside what is known of their documents."""
    for _, rows in runs_of(rows_of(batches), "group"):
        own: dict[int, dict] = {}
        for r in rows:
            if r["kind"] == "docs":
                own[int(r["flush"][0])] = r | {"score": np.zeros(len(r["n"]))}
                continue
            order = np.argsort(r["flush"], kind="stable")
            flush, doc, score = r["flush"][order], r["doc"][order], r["score"][order]
            cut = np.flatnonzero(np.r_[True, flush[1:] != flush[:-1]])
            for a, b in zip(cut, np.r_[cut[1:], len(flush)], strict=True):
                held = own[int(flush[a])]["score"]
                held += np.bincount(doc[a:b], score[a:b], minlength=len(held))
        for flush in sorted(own):
            r = own[flush]
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(r["doc_ids"]), pa.int64()), pa.array(list(r["held"]), pa.bool_()), pa.array(r["n"].astype(np.int64)), pa.array(r["known"].astype(np.int64)), pa.array(r["base"]), pa.array(r["score"])],
                ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"],
            )


def discounted_column(count: Column, d: np.ndarray) -> Column:
    factor = F.lit(1.0)
    for r in range(K, 0, -1):
        factor = F.when(count == r, float(d[r - 1])).otherwise(factor)
    return count * factor


def hot_weights(bigrams: DataFrame, uni: Unigrams, d2: np.ndarray) -> DataFrame:
    """(v, weight) of the words whose bigrams many parts hold."""
    p1 = discounted_column(F.col("cw"), uni.d) / (uni.tokens + HELD)
    sums = bigrams.groupBy("v").agg(F.sum("c").alias("all"), F.sum(F.col("c") - discounted_column(F.col("c"), d2)).alias("free"), F.sum(p1).alias("mass"))
    return sums.select("v", ((F.col("free") + HELD) / (F.col("all") + HELD) / F.greatest(1 - F.col("mass"), F.lit(uni.unknown))).alias("weight"))


def by(frame: DataFrame, n: int, key: str, *then: str) -> DataFrame:
    """Rows of a numbered key together, dealt evenly over at most ``n`` tasks, in order."""
    return frame.repartitionById(n, F.pmod(F.col(key), F.lit(n)).cast("int")).sortWithinPartitions(key, *then)


def added(rows: DataFrame, kind: str, column: str, n: int) -> list[int]:
    """Sums over parts of a short array of counts, made where the parts are."""
    sums = rows.filter(F.col("kind") == kind).select(*[F.sum(F.col(column)[i]) for i in range(n)]).head()
    return [x or 0 for x in sums]


def score(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row.
    ``order``: words of the longest n-gram, 1 to 3."""
    if order not in (1, 2, 3):
        raise ValueError("order must be 1, 2 or 3")
    held = F.coalesce(in_hash_bucket("doc_id", 5, 1), F.lit(False)).alias("held")
    rows = docs.select("doc_id", held, "text")
    n_words = max(8, rows.rdd.getNumPartitions())

    tokens = materialize(rows.mapInArrow(flusher(n_words), TOKENS), "tokens")
    asked = tokens.select("flush", F.inline(F.arrays_zip("parts", "words", "train"))).withColumnRenamed("parts", "part")
    vocabulary = materialize(by(asked, n_words, "part", "flush").mapInArrow(word_counter(n_words), WORDS), "unigrams")
    uni = Unigrams(added(vocabulary, "stats", "sums", K + 3))
    size = tokens.select(F.aggregate("n", F.lit(0).cast("long"), lambda a, x: a + x).alias("all"), F.size("n").alias("docs"), F.size(F.filter("held", lambda h: ~h)).alias("train")).agg(F.sum("all"), F.sum("docs"), F.sum("train")).head()
    all_tokens, n_docs, train_docs = (int(x or 0) for x in size)
    n_parts, n_groups = max(8, -(-all_tokens // PART_TOKENS)), max(8, -(-n_docs // GROUP_DOCS))
    hot = PART_TOKENS
    dealer = Dealer(n_parts, hot)
    ways = 1 if n_parts <= WAYS else -(-n_parts // WAYS)

    nothing = lambda kind: F.lit(None).cast(kind)
    flushes = tokens.select("flush", F.lit(-1).alias("part"), "doc_ids", "held", "n", F.col("ids").alias("blob"), nothing("binary").alias("ids"), nothing("binary").alias("counts"))
    answers = vocabulary.filter("kind = 'answer'").select("flush", "part", nothing("array<long>"), nothing("array<boolean>"), nothing("array<int>"), nothing("binary"), "ids", "counts")
    together = flushes.union(answers)
    numbered = materialize(together.repartition(n_words, "flush").sortWithinPartitions("flush", "part").mapInArrow(numberer(uni), NUMBERED), "numbered")
    discard(tokens)

    def delivered(training: bool) -> DataFrame:
        sent = numbered.select("flush", "held", "n", "ids", "names", "totals").mapInArrow(sender(dealer, train_docs, training, ways), MESSAGE)
        if ways > 1:
            sent = by(sent, WAYS, "part").mapInArrow(redealer(dealer), MESSAGE)
        return sent

    counts = materialize(by(delivered(True), n_parts, "part").mapInArrow(counter(hot), COUNTS), "ngrams")
    d3, d2_counts = discounts(added(counts, "stats", "thirds", K + 1)), added(counts, "stats", "counts", K + 1)
    spread = counts.filter("kind = 'spread'").select("part", F.inline(F.arrays_zip("keys", "seconds", "thirds", "counts"))).toDF("part", "v", "w", "cw", "c")
    bigrams = None
    if counts.filter("kind = 'spread'").head(1):
        bigrams = materialize(spread.groupBy("v", "w").agg(F.sum("c").alias("c"), F.first("cw").alias("cw")), "bigrams")
        more = bigrams.filter(F.col("c") <= K + 1).groupBy("c").count().collect()
        for r in more:
            d2_counts[r["c"] - 1] += r["count"]
    d2 = discounts(d2_counts)

    parts = counts.filter("kind in ('table', 'seen')").select("part", "kind", F.when(F.col("kind") == "table", 1).otherwise(2).alias("_order"), "names", "totals", "v", "u", "w", "c3", "c2", "times", "at", "docs", "flushes", "keys", "seconds", "counts", nothing("array<double>").alias("weights"))
    blank = lambda **given: [given.get(f.name, nothing(f.dataType)).alias(f.name) for f in parts.schema]
    look = delivered(False).select(*blank(**{k: F.col(k) for k in ("part", "kind", "names", "totals", "v", "u", "w", "times", "at", "docs", "flushes")}, _order=F.lit(2)))
    everything = parts.union(look)
    if bigrams is not None:
        column = lambda name: F.transform("all", lambda x: x[name])
        whole = spread.select("part", "v", "w").join(bigrams.select("v", "w", "c"), ["v", "w"]).groupBy("part").agg(F.collect_list(F.struct("v", "w", "c")).alias("all"))
        fix = whole.select(*blank(part=F.col("part"), kind=F.lit("fix"), _order=F.lit(0), keys=column("v"), seconds=column("w"), counts=column("c")))
        weights = hot_weights(bigrams, uni, d2)
        own = spread.select("part", "v").distinct().join(weights, "v").groupBy("part").agg(F.collect_list(F.struct("v", "weight")).alias("all"))
        weight = own.select(*blank(part=F.col("part"), kind=F.lit("weight"), _order=F.lit(0), keys=column("v"), weights=column("weight")))
        everything = everything.union(fix).union(weight)
    results = materialize(by(everything, n_parts, "part", "_order").drop("_order").mapInArrow(evaluator(uni, d2, d3, hot, order, n_groups), RESULTS), "sums")
    sums = results.filter("kind = 'sums'").select("group", "flush", "doc", "score")
    if bigrams is not None:
        asks = results.filter("kind = 'ask'").select(F.inline(F.arrays_zip("flush", "doc", "score", "v", "w", "unseen")))
        told = spread_join(asks.join(bigrams.select("v", "w", "c"), ["v", "w"], "left"), weights, "v", "flush")
        value = F.coalesce(F.log10(discounted_column(F.col("c"), d2)) + F.col("score"), F.log10("weight") + F.col("unseen"))
        each = told.groupBy("flush", "doc").agg(F.sum(value).alias("score"))
        sums = sums.union(each.groupBy("flush").agg(F.collect_list(F.struct("doc", "score")).alias("all")).select(group_of(F.col("flush"), n_groups), F.transform("all", lambda x: F.col("flush")), F.transform("all", lambda x: x["doc"]), F.transform("all", lambda x: x["score"])))
    known = numbered.select(group_of(F.col("flush"), n_groups).alias("group"), F.lit(0).alias("_order"), F.lit("docs").alias("kind"), F.array("flush").alias("flush"), nothing("array<int>").alias("doc"), nothing("array<double>").alias("score"), "doc_ids", "held", "n", "known", "base")
    rest = sums.select("group", F.lit(1), F.lit("sums"), "flush", "doc", "score", *[nothing(k) for k in ("array<long>", "array<boolean>", "array<int>", "array<int>", "array<double>")])
    # sums come in one order, so that reruns give the same last digit
    ended = by(known.union(rest), n_groups, "group", "_order", "flush", "doc").drop("_order").mapInArrow(finisher, "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return ended.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(uni.tokens).cast("long").alias("train_tokens"), "base_score", "score")


def group_of(flush: Column, n_groups: int) -> Column:
    """The group that ends a flush; evaluator has the same."""
    return ((F.shiftright(flush, 32) * 31 + flush.bitwiseAND(F.lit(0xFFFFFFFF))) % n_groups).cast("int")
