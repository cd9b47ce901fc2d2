"""Secret scans over a trigram inverted index.

Each rule's regular expression is turned into a Boolean query over the trigrams any match
must contain: pieces that must all be there, each of alternatives, each of trigrams that must
all be there.  The index has a bitmap for each document, a bit for each trigram that occurs in
some query; it lies beside the document, so postings meet where the text is.  Intersecting the
bits with a query's gives the rules a document is a candidate for, and only these are run on
its text.  A rule without mandatory trigrams scans every text.

Main path: DataFrame operations only, and no shuffle: a common trigram makes no hot group.

Null text: as empty.  Null or repeated ids, repeated rows and ties: each row is scanned alike,
by its text alone.  Very long texts: whole, in time that follows their length.  Extra columns,
also of the names used here, are carried along.  Empty table: empty result.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lanternql.llm.common import carried, let, text_or_empty
from lanternql.llm.spans import find_spans, written

try:
    from re import _constants as sre_constants
    from re import _parser as sre_parser
except ImportError:  # before Python 3.11
    import sre_constants
    import sre_parse as sre_parser


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    least: int  # characters of the group that counts
    group: int = 0
    base: bool = False


# The rules, base kinds first.
RULES = (
    Rule("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 8, 1, True),
    Rule("access", r"AKIA[A-Z0-9]+", 16, 0, True),
    Rule("hex", r"[0-9a-f]{32,}", 32, 0, True),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}", 40),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}", 15),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 29),
    Rule("private_key", r"-----BEGIN (?:RSA |EC |DSA |OPENSSH |ENCRYPTED )?PRIVATE KEY-----", 27),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}", 39),
    Rule("live_key", r"[sr]k_live_[A-Za-z0-9]{16,}", 24),
)
MOST_STRINGS = 24


def grams(text: str) -> frozenset[str]:
    return frozenset(text[i : i + 3] for i in range(len(text) - 2))


def mandatory_trigrams(pattern: str) -> list[list[frozenset[str]]] | None:
    """The lower-cased trigrams that matches contain: pieces that must all be met, each by any
    of its alternatives, whose trigrams must all be there; None if some match may contain none.

    The pattern is read from left to right into the exact strings it may spell.  Where
    these become unknown or too many, a new piece begins.
    """

    def strings_of(op, arg) -> list[str] | None:
        if op is sre_constants.LITERAL:
            return [chr(arg).lower()]
        if op is sre_constants.IN:
            listed = []
            for o, a in arg:
                if o is sre_constants.LITERAL:
                    listed.append(chr(a).lower())
                elif o is sre_constants.RANGE and a[1] - a[0] < MOST_STRINGS:
                    listed += [chr(c).lower() for c in range(a[0], a[1] + 1)]
                else:
                    return None
            return sorted(set(listed)) if len(set(listed)) <= MOST_STRINGS else None
        if op is sre_constants.SUBPATTERN:
            return sequence_strings(arg[-1])
        if op is sre_constants.BRANCH:
            parts = [sequence_strings(x) for x in arg[1]]
            return None if None in parts else sorted({s for p in parts for s in p})
        if op in (sre_constants.MAX_REPEAT, sre_constants.MIN_REPEAT) and arg[1] == 1:
            inner = sequence_strings(arg[2])
            return None if inner is None else sorted({*inner, *([""] if arg[0] == 0 else [])})
        return None

    def sequence_strings(nodes) -> list[str] | None:
        out = [""]
        for op, arg in nodes:
            more = strings_of(op, arg)
            if more is None or len(out) * len(more) > MOST_STRINGS:
                return None
            out = [a + b for a in out for b in more]
        return out

    pieces, current = [], [""]
    for op, arg in sre_parser.parse(pattern):
        more = strings_of(op, arg)
        if more is not None and len(current) * len(more) <= MOST_STRINGS:
            current = [a + b for a in current for b in more]
            continue
        pieces.append(current)
        current = more if more is not None and len(more) <= MOST_STRINGS else [""]
    pieces.append(current)
    queries = [[grams(s) for s in piece] for piece in pieces]
    # an alternative that asks for more than another one adds nothing
    queries = [sorted({g for g in q if not any(o < g for o in q)}, key=sorted) for q in queries if all(q)]
    return queries or None


#: Bits of one bitmap; more trigrams take more of them.
BITS = 62


def rarest(trigrams: frozenset[str], most: int = 2) -> frozenset[str]:
    """The trigrams of an alternative that are the least common in prose: fewer are looked for,
    and what they let pass is verified anyway."""
    common = "etaoinshrdlu"
    return frozenset(sorted(trigrams, key=lambda g: (sum(common.index(c) + 1 if c in common else 20 for c in g), g), reverse=True)[:most])


class Index:
    """Bits of the trigrams of some queries: of documents, and of the queries themselves."""

    def __init__(self, queries: dict[str, list[list[frozenset[str]]]]):
        self.queries = {kind: [[rarest(g) for g in piece] for piece in pieces] for kind, pieces in queries.items()}
        self.trigrams = sorted({t for pieces in self.queries.values() for piece in pieces for g in piece for t in g})

    def of(self, text: Column) -> Column:
        """The bitmaps of a text."""

        def maps(low: Column) -> Column:
            bits = [F.when(F.contains(low, F.lit(t)), F.lit(1 << i % BITS)).otherwise(F.lit(0)).cast("long") for i, t in enumerate(self.trigrams)]
            sums = [bits[a : a + BITS] for a in range(0, len(bits), BITS)]
            return F.array(*[reduce(lambda x, y: x + y, part) for part in sums])

        return let(F.lower(text), maps)

    def met(self, postings: Column, kind: str) -> Column:
        """Whether a document with these bitmaps is a candidate for a rule."""

        def holds(trigrams: frozenset[str]) -> Column:
            need: dict[int, int] = {}
            for t in trigrams:
                i = self.trigrams.index(t)
                need[i // BITS] = need.get(i // BITS, 0) | 1 << i % BITS
            return reduce(lambda x, y: x & y, [postings[m].bitwiseAND(F.lit(bits)) == bits for m, bits in need.items()])

        return reduce(lambda x, y: x & y, [reduce(lambda x, y: x | y, map(holds, piece)) for piece in self.queries[kind]])


def spans_of(text: Column, rule: Rule) -> Column:
    found = find_spans(text, rule.pattern)
    if rule.group:
        keep = lambda s: F.length(F.regexp_extract(s["body"], rule.pattern, rule.group)) >= rule.least
    else:
        keep = lambda s: s["end"] - s["start"] >= rule.least
    return F.filter(found, keep)


def labelled(spans: Column, rank: int, rule: Rule) -> Column:
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), s["end"].alias("end"), F.lit(rule.kind).alias("kind"), F.lit(rule.base).alias("base")))


def count_of(found: Column, kind: str) -> Column:
    return F.size(F.filter(found, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """A struct _row of all columns of ``docs``, its text, and found: array of (start, rank,
    end, kind, base) in that order."""
    index = Index({r.kind: q for r in rules if (q := mandatory_trigrams(r.pattern)) is not None})
    text = F.col("text")
    none = F.array().cast("array<struct<start:int,rank:int,end:int,kind:string,base:boolean>>")

    def verified(postings: Column) -> Column:
        parts = []
        for rank, rule in enumerate(rules):
            spans = labelled(spans_of(text, rule), rank, rule)
            parts.append(F.when(index.met(postings, rule.kind), spans).otherwise(none) if rule.kind in index.queries else spans)
        return F.array_sort(F.concat(*parts))

    found = let(index.of(text), verified) if index.queries else verified(F.array())
    return carried(docs, text_or_empty().alias("text")).withColumn("found", found)


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, counts of the base kinds, base_sha256 and spans."""
    found = F.col("found")
    counts = [count_of(found, kind) for kind in ("assign", "access", "hex")]
    base = written(F.filter(found, lambda s: s["base"]))
    return scan(docs.select("doc_id", "text")).select("_row.doc_id", *counts, F.sha2(base.cast("binary"), 256).alias("base_sha256"), written(found).alias("spans"))


def masked(docs: DataFrame, mask: str = "[SECRET]") -> DataFrame:
    """``docs`` with every found span replaced by ``mask``; n_chars follows the text."""
    text = F.col("text")
    # spans in order of start; what a span shares with those before it is cut once
    state = "struct<at:int,out:array<string>>"

    def step(acc, s):
        fresh = s["end"] > acc["at"]
        gap = F.when(s["start"] >= acc["at"], F.concat(F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit(mask))).otherwise(F.lit(""))
        return F.struct(F.when(fresh, s["end"]).otherwise(acc["at"]).alias("at"), F.when(fresh, F.concat(acc["out"], F.array(gap))).otherwise(acc["out"]).alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out")).cast(state)
    clean = F.aggregate("found", start, step, lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(text, acc["at"] + 1, F.length(text))))
    out = scan(docs).withColumn("clean", F.when(F.size("found") > 0, clean).otherwise(F.col("_row.text")))
    row = F.col("_row").withField("text", F.col("clean"))
    if "n_chars" in docs.columns:
        row = row.withField("n_chars", F.length("clean").cast("long"))
    return out.select(row.alias("_row")).select("_row.*")
