"""Places of regular-expression matches, as column expressions.

``split`` gives what lies between the matches that ``regexp_extract_all`` gives, so the
start of a match is the sum of the lengths before it.  Lengths are code points.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lanternql.llm.common import let

BLOCK = 64
SPAN = "array<struct<start:int,end:int,body:string>>"


def total(lengths: Column) -> Column:
    return F.aggregate(lengths, F.lit(0), lambda a, b: a + b)


def running_sums(lengths: Column) -> Column:
    """Sums of the first 1, 2, ... elements of a non-empty array; sums of blocks keep
    the work near n for thousands of elements."""

    def whole(n_blocks):
        return F.transform(F.sequence(F.lit(0), n_blocks), lambda b: total(F.slice(lengths, b * BLOCK + 1, F.lit(BLOCK))))

    def within(blocks):
        before = F.transform(blocks, lambda _, b: total(F.slice(blocks, F.lit(1), b)))
        return let(before, lambda x: F.transform(lengths, lambda _, i: x[F.floor(i / BLOCK).cast("int")] + total(F.slice(lengths, i - i % BLOCK + 1, i % BLOCK + 1))))

    return let(whole(F.floor((F.size(lengths) - 1) / BLOCK).cast("int")), within)


def running_max(values: Column) -> Column:
    """The largest of the first 1, 2, ... elements of a non-empty array, by blocks."""
    n_blocks = F.floor((F.size(values) - 1) / BLOCK).cast("int")
    blocks = F.transform(F.sequence(F.lit(0), n_blocks), lambda b: F.array_max(F.slice(values, b * BLOCK + 1, F.lit(BLOCK))))

    def within(blocks: Column) -> Column:
        before = F.transform(blocks, lambda _, b: F.array_max(F.slice(blocks, F.lit(1), b)))
        own = lambda i: F.array_max(F.slice(values, i - i % BLOCK + 1, i % BLOCK + 1))
        return let(before, lambda x: F.transform(values, lambda _, i: F.greatest(own(i), x[F.floor(i / BLOCK).cast("int")])))

    return let(blocks, within)


def find_spans(text: Column, pattern: str) -> Column:
    """All leftmost non-overlapping matches as array of (start, end, body)."""

    def placed(found: Column) -> Column:
        gaps = F.transform(F.split(text, pattern, -1), F.length)
        before = let(gaps, lambda g: F.transform(found, lambda _, i: g[i] + F.when(i > 0, F.length(found[i - 1])).otherwise(0)))
        starts = let(before, running_sums)
        spans = let(starts, lambda s: F.transform(found, lambda m, i: F.struct(s[i].alias("start"), (s[i] + F.length(m)).alias("end"), m.alias("body"))))
        return F.when(F.size(found) > 0, spans).otherwise(F.array().cast(SPAN))

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), placed)


def written(spans: Column) -> Column:
    """kind:start:end, comma-joined, of an array of structs."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
