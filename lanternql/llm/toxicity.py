"""Toxicity: gradient-boosted trees over dense features, with isotonic calibration.

Labelled training rows fall in two parts by a hash of the id.  From the first comes a
lexicon: words and word beginnings that occur in toxic documents nearly alone, so that
inflected forms of a term count too.  From the second come the trees (four fifths) and
the calibration (one fifth).  Each part is a bounded sample, the rows of least hash; the
bound is ``most_rows``.  Scoring reads every text whole.

Null and empty texts: features of no words, scored like any text.  Labels: null ones are
left out, several for a document count by their largest.  No labelled rows: score 0.
Repeated rows are scored each.  Extra columns are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lanternql.llm import boosting
from lanternql.llm.common import in_hash_bucket, text_or_empty

MOST_ROWS = 20_000
MOST_TERMS = 400
LEAST_DOCS = 6
LEAST_SHARE = 0.85
STEMS = (4, 5, 6)
THRESHOLD = 0.7

# Plain insults, and words that address the reader.
INSULTS = frozenset("asshole bastard bitch clown crap cretin disgusting dumb fool fuck fucking garbage hate idiot idiots imbecile jerk kill loser losers moron morons pathetic pig retard scum shit shut stupid trash ugly vermin whore worthless dumm idiotisch abschaum arschloch trottel dreck imbécile connard salaud débile ordure idiota estúpido estúpida imbécil basura escoria payaso".split())
SECOND_PERSON = frozenset("you your yours yourself u ur du dich dir dein deine euch euer ihr tu toi ton vous votre vos tú ti tus usted ustedes vosotros".split())
NAMES = ("words", "hits", "density", "terms", "insults", "near", "capitals", "shouted", "exclaims", "questions", "symbols", "obfuscated", "digits", "long_runs")
OBFUSCATED = re.compile(r"[a-z]+[0-9@$*!]+[a-z]+|\b(?:[a-z][ .*_-]){3,}[a-z]\b")
RUNS = re.compile(r"([a-z])\1\1")
WORDS = re.compile(r"[^\W_]+")
PLAIN = str.maketrans("0134578@$", "oieastbas")


def training_rows(docs: DataFrame, labels: DataFrame, part: Column, most_rows: int) -> DataFrame:
    """doc_id, text, toxic of a bounded sample: at most ``most_rows`` labels, and of documents
    that repeat an id the text of least hash."""
    picked = (
        labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~in_hash_bucket("doc_id", 3, 1) & part)
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(most_rows)
    )
    labelled = docs.select("doc_id", text_or_empty().alias("text")).join(F.broadcast(picked), "doc_id")
    return labelled.groupBy("doc_id").agg(F.min_by("text", F.xxhash64("text")).alias("text"), F.first("toxic").alias("toxic"))


def learn_lexicon(rows: DataFrame) -> dict[int, frozenset[str]]:
    """Terms by length of the beginning; 0: whole words."""
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)))

    def beginnings(k: int) -> Column:
        return F.transform(F.filter("w", lambda w: F.length(w) >= k), lambda w: F.concat(F.lit(f"{k}:"), F.substring(w, 1, k)))

    keys = F.array_distinct(F.concat(F.transform("w", lambda w: F.concat(F.lit("0:"), w)), *[beginnings(k) for k in STEMS]))
    toxic, all_ = F.sum(F.col("toxic").cast("long")), F.count(F.lit(1))
    found = (
        rows.select("toxic", words.alias("w"))
        .select("toxic", F.explode(keys).alias("key"))
        .groupBy("key")
        .agg(toxic.alias("p"), all_.alias("n"))
        .filter((F.col("p") >= LEAST_DOCS) & (F.col("p") >= LEAST_SHARE * F.col("n")))
        .orderBy(F.desc("p"), "key")
        .limit(MOST_TERMS)
        .collect()
    )
    out: dict[int, set[str]] = {0: set(), **{k: set() for k in STEMS}}
    for r in found:
        k, _, term = r["key"].partition(":")
        out[int(k)].add(term)
    return {k: frozenset(v) for k, v in out.items()}


def near_any(places: list[int], others: list[int], most: int = 4) -> int:
    """How many of ``places`` have one of ``others`` at most ``most`` away; both in order."""
    if not places or not others:
        return 0
    at, other = np.array(places), np.array(others)
    after = np.searchsorted(other, at)
    right = np.abs(other[np.minimum(after, len(other) - 1)] - at)
    left = np.abs(at - other[np.maximum(after - 1, 0)])
    return int((np.minimum(left, right) <= most).sum())


def features(text: str, lexicon: dict[int, frozenset[str]]) -> list[float]:
    lowered = text.lower()
    words = WORDS.findall(lowered)
    n, kinds = len(words), set(words)
    bad = kinds & lexicon[0] | kinds & INSULTS
    for k in STEMS:
        if lexicon[k] and (stems := {w[:k] for w in kinds} & lexicon[k]):
            bad |= {w for w in kinds if w[:k] in stems}
    hidden = OBFUSCATED.findall(lowered) if not text.isalpha() else []
    hidden_bad = sum(1 for h in hidden if re.sub(r"[^a-z]", "", h.translate(PLAIN)) in INSULTS)
    places = [i for i, w in enumerate(words) if w in bad] if bad else []
    you = [i for i, w in enumerate(words) if w in SECOND_PERSON] if places and kinds & SECOND_PERSON else []
    near = near_any(places, you)
    raw = np.bincount(np.frombuffer(text.encode(), dtype=np.uint8), minlength=256)
    size, letters = max(1, int(raw.sum())), max(1, int(raw[65:91].sum() + raw[97:123].sum()))
    hits = len(places) + hidden_bad
    return [
        float(n), float(hits), hits / max(1, n), float(len(bad)), float(sum(1 for i in places if words[i] in INSULTS)), float(near),
        raw[65:91].sum() / letters, len(re.findall(r"\b[A-Z]{3,}\b", text)) / max(1, n), raw[33] / size, raw[63] / size,
        raw[[35, 36, 37, 38, 42, 60, 62, 124]].sum() / size, len(hidden) / max(1, n), raw[48:58].sum() / size, len(RUNS.findall(lowered)) / size,
    ]


def featuring(lexicon):
    names = [f"f{i}" for i in range(len(NAMES))]

    def run(batches):
        for batch in batches:
            rows = [features(t or "", lexicon) for t in batch.column(1).to_pylist()]
            columns = list(zip(*rows, strict=True)) if rows else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int32()), *[pa.array(c, pa.float64()) for c in columns]], ["toxic", *names])

    return run, "toxic int, " + ", ".join(f"{n} double" for n in names)


def scoring(lexicon, model, curve, threshold):
    def run(batches):
        for batch in batches:
            x = np.array([features(t or "", lexicon) for t in batch.column(2).to_pylist()]).reshape(-1, len(NAMES))
            score = boosting.calibrated(curve, boosting.log_odds(model, x))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score, pa.float64()), pa.array((score >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return run


def train(docs: DataFrame, labels: DataFrame, most_rows: int = MOST_ROWS):
    """(lexicon, trees, calibration curve)."""
    first = F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0
    lexicon = learn_lexicon(training_rows(docs, labels, first, most_rows))
    run, schema = featuring(lexicon)
    table = training_rows(docs, labels, ~first, most_rows).orderBy("doc_id").select("toxic", "text").mapInArrow(run, schema).toPandas().to_numpy(dtype=float)
    y, x = (table[:, 0] > 0).astype(float), table[:, 1:]
    aside = np.arange(len(y)) % 5 == 4
    model = boosting.fit(x[~aside], y[~aside])
    part = aside if aside.any() else ~aside
    return lexicon, model, boosting.isotonic(boosting.log_odds(model, x[part]), y[part])


def toxicity(docs: DataFrame, labels: DataFrame, *, most_rows: int = MOST_ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``."""
    lexicon, model, curve = train(docs, labels, most_rows)
    held_out = F.coalesce(in_hash_bucket("doc_id", 3, 1), F.lit(False)).alias("held_out")
    return docs.select("doc_id", held_out, "text").mapInArrow(scoring(lexicon, model, curve, threshold), "doc_id long, held_out boolean, score double, predicted int")
