"""Bounded-space online packing of documents into fixed windows.

Each task keeps ``open_windows`` windows.  A document goes, whole, to the window it
fills best; when it fits nowhere the fullest window is emitted (a gap of more than
``most_gap`` tokens is first filled by a cut of that document).  What remains open when
a task ends is merged in rounds, ``fan_in`` tasks into one, until one task is left.

Null text: as empty, one token (the end id).  Repeated rows are packed each.  Empty
table: empty result.  Extra columns are ignored.  A document longer than the window
fills whole windows with its first tokens.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanternql.llm.bpe import IdCache, splitter
from lanternql.llm.common import materialize, worker_memory

WINDOW = 2048
OPEN_WINDOWS = 32
MOST_GAP = 16
FAN_IN = 32
END_ID = 1

PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, open boolean"
NAMES = [f.split()[0] for f in PIECE.split(", ")]
TYPES = [pa.int64()] * 7 + [pa.bool_()]


class Windows:
    """The open windows of one task; emits rows of PIECE."""

    def __init__(self, task: int, window: int, most_open: int):
        self.window, self.most_open = window, most_open
        self.fill: list[int] = []
        self.held: list[list] = []
        self.next_id = task << 32
        self.rows: list[tuple] = []

    def best(self, length: int) -> int | None:
        fits = [(f, i) for i, f in enumerate(self.fill) if f + length <= self.window]
        return max(fits)[1] if fits else None

    def put(self, i: int, piece: tuple, length: int) -> None:
        self.held[i].append((piece, self.fill[i]))
        self.fill[i] += length
        if self.fill[i] == self.window:
            self.emit(i, False)

    def emit(self, i: int, still_open: bool) -> None:
        self.rows += [(*piece, self.next_id, offset, still_open) for piece, offset in self.held[i]]
        self.next_id += 1
        del self.held[i], self.fill[i]

    def fullest(self) -> int:
        return max(range(len(self.fill)), key=self.fill.__getitem__)

    def open_new(self) -> int:
        self.fill.append(0)
        self.held.append([])
        return len(self.fill) - 1

    def close(self) -> None:
        while self.fill:
            self.emit(0, True)

    def taken_rows(self):
        rows, self.rows = self.rows, []
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 8, TYPES, strict=True)], NAMES)


def packer(vocabulary: str, window: int, most_open: int, most_gap: int):
    end = np.array([END_ID], dtype="<u4").tobytes()

    def pack(batches):
        from pyspark import TaskContext

        cache = worker_memory(f"ids {vocabulary}", lambda: IdCache(vocabulary))
        split, ids_of = splitter(), cache.__getitem__
        encode = lambda text: b"".join(map(ids_of, split(text)))
        special = {t: np.array([i], dtype="<u4").tobytes() for t, i in cache.special.items()}
        around = re.compile("(" + "|".join(re.escape(t) for t in sorted(special, key=len, reverse=True)) + ")") if special else None

        def ids_in(text: str) -> bytes:
            """Special strings in a text are their ids, as the library has it."""
            if around is None or not any(t in text for t in special):
                return encode(text)
            return b"".join(special.get(part) or encode(part) for part in around.split(text) if part)

        open_ = Windows(TaskContext.get().partitionId(), window, most_open)
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                text = text or ""
                ids = ids_in(text) + end
                total, start = len(ids) // 4, 0

                def piece(a, b):
                    return (doc_id, a, b - a, zlib.crc32(ids[4 * a : 4 * b]), total)  # noqa: B023

                while total - start >= window:
                    open_.put(open_.open_new(), piece(start, start + window), window)
                    start += window
                while start < total:
                    length = total - start
                    i = open_.best(length)
                    if i is None and len(open_.fill) < open_.most_open:
                        i = open_.open_new()
                    if i is not None:
                        open_.put(i, piece(start, total), length)
                        start = total
                        continue
                    i = open_.fullest()
                    gap = window - open_.fill[i]
                    if gap > most_gap:
                        open_.put(i, piece(start, start + gap), gap)
                        start += gap
                    else:
                        open_.emit(i, False)
            yield open_.taken_rows()
        open_.close()
        yield open_.taken_rows()

    return pack


def merger(window: int, most_open: int, task_base: int, last: bool):
    """Packs the pieces of open windows again; nothing is cut here."""

    def merge(batches):
        from pyspark import TaskContext

        open_ = Windows(task_base + TaskContext.get().partitionId(), window, most_open)
        for batch in batches:
            for piece in zip(*(c.to_pylist() for c in batch.columns[:5]), strict=True):
                length = piece[2]
                i = open_.best(length)
                if i is None and len(open_.fill) >= open_.most_open:
                    open_.emit(open_.fullest(), False)
                if i is None:
                    i = open_.open_new()
                open_.put(i, piece, length)
            yield open_.taken_rows()
        open_.close()
        yield open_.taken_rows()

    return merge


def pack(docs: DataFrame, vocabulary: str, *, window: int = WINDOW, open_windows: int = OPEN_WINDOWS, most_gap: int = MOST_GAP, fan_in: int = FAN_IN) -> DataFrame:
    """One row per piece; ``vocabulary``: a tokenizers .json file of byte-level BPE that every
    executor has at this path."""
    first = docs.select("doc_id", "text")
    tasks = first.rdd.getNumPartitions()
    pieces = materialize(first.mapInArrow(packer(vocabulary, window, open_windows, most_gap), PIECE), "pieces")
    done, left, base, used = pieces.filter("not open"), pieces.filter("open"), 1 << 24, [pieces]
    while tasks > 1:
        tasks = -(-tasks // fan_in)
        level = left.withColumn("_to", F.expr(f"(sequence_id >> 32) % {tasks}")).repartition(tasks, "_to") if tasks > 1 else left.coalesce(1)
        # long pieces first: each task's input is bounded by its fan-in times the open windows
        merged = materialize(level.sortWithinPartitions(F.desc("length"), "doc_id", "start").select(*NAMES).mapInArrow(merger(window, open_windows, base, tasks == 1), PIECE), "merged")
        done, left, base = done.union(merged.filter("not open")), merged.filter("open"), base + (1 << 24)
    return done.union(left).drop("open")
