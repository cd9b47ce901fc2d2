"""Token counts by rank-synchronous array merging.

Texts are split into pre-tokens; those not counted before in this worker are held as
ragged arrays, each sequence's lowest-rank pair is merged everywhere at once, and the
surviving symbols are counted.

Null text: as empty, 0 tokens.  Empty table: empty result.  Repeated rows: each is counted.
Lone surrogates cannot occur in Spark strings.  Extra columns are ignored.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame

from lanternql.llm.bpe import MergeTable, splitter
from lanternql.llm.common import worker_memory

LIMIT = 1024
MOST_REMEMBERED = 400_000


def counter(vocabulary: str, limit: int):
    def count(batches):
        merges = worker_memory(f"merges {vocabulary}", lambda: MergeTable(vocabulary))
        known = worker_memory(f"counts {vocabulary}", dict)
        split, special = splitter(), [s for s in merges.special if s]
        for batch in batches:
            ids = batch.column(0)
            texts = [t or "" for t in batch.column(1).to_pylist()]
            n_bytes, n_tokens = [], []
            for start in range(0, len(texts), 256):
                found, extra = [], []
                for text in texts[start : start + 256]:
                    n_bytes.append(len(text.encode()))
                    parts, n = [text], 0
                    for s in special:
                        if s in text:
                            n += sum(p.count(s) for p in parts)
                            parts = [x for p in parts for x in p.split(s)]
                    found.append([t for p in parts for t in split(p)] if n else split(text))
                    extra.append(n)
                new = list(set().union(*found).difference(known))
                if new:
                    if len(known) + len(new) > MOST_REMEMBERED:
                        known.clear()
                        new = list(set().union(*found))
                    known.update(zip(new, merges.count(new).tolist(), strict=True))
                n_tokens += [n + sum(map(known.__getitem__, tokens)) for tokens, n in zip(found, extra, strict=True)]
            yield pa.RecordBatch.from_arrays([ids.cast(pa.int64()), pa.array(n_bytes, pa.int64()), pa.array(n_tokens, pa.int64()), pa.array([n > limit for n in n_tokens], pa.bool_())], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return count


def token_counts(docs: DataFrame, vocabulary: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit; ``vocabulary``: a byte-level BPE .json file
    that every executor has at this path."""
    return docs.select("doc_id", "text").mapInArrow(counter(vocabulary, limit), "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
