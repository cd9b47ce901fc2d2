"""Personal data: candidate gradient boosting.

Base kinds are found by their patterns and checks.  High-recall generators then propose
further spans, which may overlap, also single formats in a run of numbers; boosted trees judge each by its format and by the words
before it.  Of those above the calibrated threshold of their kind, the strongest is taken
first, then the next that overlaps nothing taken, and so on; base spans stand before all.

Main path: DataFrame operations only.  The trees are trained on candidates of known truth,
made from templates with a fixed seed (``MADE_ROWS`` of one number and a quarter as many of
several side by side, the bound of the sample), and
enter the plan as CASE expressions.

Null text: as empty.  Repeated rows: each is searched.  Ties: the earlier span, then the
earlier kind.  Very long texts: whole; only spans that overlap in a chain are compared with one
another.  Extra columns, also of the names used here, are carried along.  Empty table: empty result.
"""

from __future__ import annotations

import json
import random
import re
from functools import cache

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lanternql.llm import boosting
from lanternql.llm.common import carried, let, text_or_empty
from lanternql.llm.spans import SPAN, find_spans, running_max, written

BASE = ("email", "ip", "card", "phone")
ADDED = ("mail_like", "number_like", "account_like")
KINDS = BASE + ADDED
CONTEXT = 40
MADE_ROWS = 2400
PRECISION = 0.97
NUMBER_DIGITS = (7, 19)

# Patterns.  Starts are tied to the start of a run (or the end of the last
# match) and runs are possessive, so a long run is read once;
# groups repeat without recursion or a bounded number of times.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]+\.[0-9]+\.[0-9]+",
    "card": r"[0-9]++(?:[\x20-][0-9]++)*+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "mail_like": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++\x20?(?:@|\(at\)|\[at\]|\{at\})\x20?[A-Za-z0-9-]++(?:\x20?(?:\.|\(dot\)|\[dot\]|\{dot\})\x20?[A-Za-z0-9-]++)++",
    "number_like": r"\(?[0-9][0-9().\x20/-]{5,}[0-9]",
    "account_like": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2}(?:\x20?[A-Z0-9]{4})*+(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
}
#: Single formats within a run that number_like takes as one: numbers may stand next to each other.
PARTS = (
    r"(?<![0-9().-])\(?[0-9][0-9().-]{5,}[0-9](?![0-9])",  # what stands between blanks or slashes
    r"(?<![0-9])(?:\([0-9]{3}\)\x20?|[0-9]{3}[.\x20/-])[0-9]{3}[.\x20-][0-9]{4}(?![0-9])",
    r"(?<![0-9])0[0-9]{2,4}[\x20/-][0-9]{6,8}(?![0-9])",
    r"(?<![0-9])[0-9]{2}(?:\x20[0-9]{2}){4}(?![0-9])",
    r"(?<![0-9])[0-9]{3}[\x20-][0-9]{2}[\x20-][0-9]{4}(?![0-9])",
    r"(?<![0-9])[0-9]{4}(?:[\x20-][0-9]{4}){3}(?![0-9])",
    r"(?<![0-9])[0-9]{4}[\x20-][0-9]{6}[\x20-][0-9]{5}(?![0-9])",
)
#: What a text must contain for a pattern to be tried at all.
NEEDS = {"email": "@", "phone": "+"}

#: Of a candidate c with kind, body and before.
FEATURES = {
    "is_mail": "if(c.kind = 'mail_like', 1, 0)",
    "is_account": "if(c.kind = 'account_like', 1, 0)",
    "length": "length(c.body)",
    "digits": "length(regexp_replace(c.body, '[^0-9]+', ''))",
    "groups": "size(regexp_extract_all(c.body, '[0-9]+', 0))",
    "dots": "length(c.body) - length(replace(c.body, '.', ''))",
    "dashes": "length(c.body) - length(replace(c.body, '-', ''))",
    "blanks": "length(c.body) - length(replace(c.body, ' ', ''))",
    "slashes": "length(c.body) - length(replace(c.body, '/', ''))",
    "bracket": "if(c.body rlike '^[(][0-9]{2,5}[)]', 1, 0)",
    "date": "if(c.body rlike '^([0-9]{4}[-/.][0-9]{1,2}[-/.][0-9]{1,2}|[0-9]{1,2}[-/.][0-9]{1,2}[-/.]([0-9]{2}|[0-9]{4}))$', 1, 0)",
    "phone_format": "if(c.body rlike '^([(][0-9]{3}[)] ?|[0-9]{3}[-. /])[0-9]{3}[-. ][0-9]{4}$', 1, 0)",
    "three_two_four": "if(c.body rlike '^[0-9]{3}[- ][0-9]{2}[- ][0-9]{4}$', 1, 0)",
    "decimal": "if(c.body rlike '^[0-9]+[.][0-9]+$', 1, 0)",
    "spelled_at": "if(c.body rlike '[(\\\\[{]at[)\\\\]}]', 1, 0)",
    "in_account": "if(c.kind = 'number_like' and c.before rlike '(?<![A-Za-z0-9])[A-Z]{2}([0-9]{2}(\\\\x20?[A-Z0-9]{4})*\\\\x20?)?$', 1, 0)",
    "says_phone": "if(c.before rlike '(?i)(phone|telefon|tel[:. ]|call|mobile|movil|fax|cell|whatsapp|dial|handy)', 1, 0)",
    "says_mail": "if(c.before rlike '(?i)(mail|contact|write to|reach)', 1, 0)",
    "says_id": "if(c.before rlike '(?i)(ssn|social security|passport|tax id|national id|insurance)', 1, 0)",
    "says_card": "if(c.before rlike '(?i)(card|visa|credit|payment)', 1, 0)",
    "says_bank": "if(c.before rlike '(?i)(iban|account|bank|konto|compte|cuenta)', 1, 0)",
    "says_other": "if(c.before rlike '(?i)(version|order|invoice|isbn|page|room|part|serial|score|year|total|ratio|section)', 1, 0)",
}


def digits_of(body: Column) -> Column:
    return F.regexp_replace(body, r"[^0-9]+", "")


def luhn(digits: Column) -> Column:
    """Digit string -> whether its check digit is right."""

    def term(d, i, n):
        v = d.cast("int")
        doubled = 2 * v
        return F.when((n - i) % 2 == 0, doubled - F.when(doubled > 9, 9).otherwise(0)).otherwise(v)

    each = F.filter(F.split(digits, ""), lambda x: x != "")
    return let(each, lambda ds: F.aggregate(F.transform(ds, lambda d, i: term(d, i, F.size(ds))), F.lit(0), lambda a, b: a + b) % 10 == 0)


def base_check(kind: str, body: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(body, r"\."), lambda p: F.length(F.regexp_replace(p, "^0+", "")).between(0, 3) & (F.coalesce(F.substring(F.regexp_replace(p, "^0+", ""), 1, 4).try_cast("int"), F.lit(0)) <= 255))
    digits = F.length(digits_of(body))
    if kind == "card":
        return digits.between(13, 19) & luhn(digits_of(body))
    if kind == "phone":
        return digits.between(9, 15)
    return F.lit(True)


def raw_spans(text: Column, kind: str) -> Column:
    found = find_spans(text, PATTERNS[kind])
    if kind in NEEDS:
        found = F.when(F.contains(text, F.lit(NEEDS[kind])), found).otherwise(F.array().cast(SPAN))
    return found


def parts_of(runs: Column) -> Column:
    """Spans of single formats inside runs, other than a whole run."""

    def inside(run):
        found = F.array_distinct(F.concat(*[find_spans(run["body"], p) for p in PARTS]))
        shorter = F.filter(found, lambda s: F.length(s["body"]) < F.length(run["body"]))
        return F.transform(shorter, lambda s: F.struct((run["start"] + s["start"]).alias("start"), (run["start"] + s["end"]).alias("end"), s["body"].alias("body")))

    return F.flatten(F.transform(runs, inside))


def labelled(spans: Column, kind: str) -> Column:
    return F.transform(spans, lambda s: F.struct(F.lit(KINDS.index(kind)).alias("rank"), s["start"].alias("start"), s["end"].alias("end"), F.lit(kind).alias("kind"), s["body"].alias("body")))


def checked(text: Column, kind: str) -> Column:
    return labelled(F.filter(raw_spans(text, kind), lambda s: base_check(kind, s["body"])), kind)


def proposals(text: Column) -> Column:
    """Spans of all generators with the text before them."""

    def with_context(s):
        begin = F.greatest(s["start"] - CONTEXT, F.lit(0))
        return F.struct(s["rank"].alias("rank"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"), s["body"].alias("body"), F.substring(text, begin + 1, s["start"] - begin).alias("before"))

    plausible = lambda s: (s["kind"] != "number_like") | F.length(digits_of(s["body"])).between(*NUMBER_DIGITS)
    numbers = let(raw_spans(text, "number_like"), lambda runs: F.concat(runs, parts_of(runs)))
    return F.transform(F.filter(F.concat(*[labelled(numbers if k == "number_like" else raw_spans(text, k), k) for k in ADDED]), plausible), with_context)


def made_candidates(seed: int = 7, rows: int = MADE_ROWS) -> list[dict]:
    """Texts with one candidate each, and whether it is personal."""
    r = random.Random(seed)
    d = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    word = lambda: "".join(r.choice("aeioubcdlmnrst") for _ in range(r.randint(3, 8)))
    plain = lambda: " ".join(word() for _ in range(4)) + " "
    say = lambda *c: plain() + r.choice(c) + r.choice([" ", ": ", " is ", " no. "])
    phone = lambda: r.choice([f"({d(3)}) {d(3)}-{d(4)}", f"{d(3)}-{d(3)}-{d(4)}", f"{d(3)}.{d(3)}.{d(4)}", f"0{d(3)} {d(7)}", f"{d(2)} {d(2)} {d(2)} {d(2)} {d(2)}"])
    kinds = [
        (lambda: say("phone", "tel:", "call", "mobile", "fax") + phone(), 1),
        (lambda: say("ssn", "social security", "tax id", "passport") + r.choice([f"{d(3)}-{d(2)}-{d(4)}", d(9)]), 1),
        (lambda: plain() + r.choice([f"({d(3)}) {d(3)}-{d(4)}", f"{d(3)}-{d(3)}-{d(4)}"]), 1),
        (lambda: say("card", "visa", "credit card") + " ".join(d(4) for _ in range(4)), 1),
        (lambda: r.choice([plain(), say("mail", "contact", "reach")]) + f"{word()}.{word()} (at) {word()} (dot) com", 1),
        (lambda: r.choice([plain(), say("mail", "contact")]) + f"{word()}[at]{word()}.org", 1),
        (lambda: say("iban", "account", "bank") + f"{r.choice(['DE', 'FR', 'ES', 'GB'])}{d(2)} " + " ".join(d(4) for _ in range(4)), 1),
        (lambda: say("version", "section", "score") + f"{d(2)}.{d(2)}.{d(2)}", 0),
        (lambda: say("order", "invoice", "isbn", "serial", "part") + r.choice([d(10), f"{d(4)}-{d(4)}-{d(2)}", f"{d(3)}-{d(10)}", d(16)]), 0),
        (lambda: plain() + r.choice([f"20{d(2)}-{r.randint(1, 12):02d}-{r.randint(1, 28):02d}", f"{r.randint(1, 28)}/{r.randint(1, 12)}/20{d(2)}", f"{d(4)}.{d(6)}"]), 0),
        (lambda: say("total", "year", "ratio", "page") + r.choice([f"{d(4)}.{d(3)}", f"{d(4)} {d(4)}", f"{d(4)}-{d(4)}", d(8)]), 0),
        (lambda: plain() + r.choice([d(7), d(9), d(12), d(16), f"{d(5)} {d(6)} {d(3)}", f"{d(3)} {d(3)} {d(3)}", f"{d(4)}-{d(2)}-{d(2)} {d(2)}"]), 0),
        (lambda: say("serial", "part", "order") + f"{r.choice(['AB', 'XK', 'QT'])}{d(2)} {word().upper()[:4]:X<4} {d(4)} {d(4)}", 0),
        (lambda: plain() + f"{word()} @ {word()} . {word()}", 0),
    ]
    out = []
    for i in range(rows):
        make, label = kinds[i % len(kinds)]
        text = make()
        # of an account number only the whole is personal, not the digits in it
        account = re.search(PATTERNS["account_like"], text) if label else None
        out.append({"id": i, "text": text, **({"truth": [account[0]]} if account else {"label": label})})
    ssn = lambda: f"{d(3)}-{d(2)}-{d(4)}"
    card = lambda: " ".join(d(4) for _ in range(4))
    date = lambda: f"20{d(2)}-{r.randint(1, 12):02d}-{r.randint(1, 28):02d}"
    other = lambda: r.choice([date(), f"{d(4)}-{d(4)}-{d(2)}", f"{d(4)}.{d(6)}", f"{d(2)}.{d(2)}.{d(2)}"])
    ip = lambda: ".".join(str(r.randint(1, 255)) for _ in range(4))
    for i in range(rows, rows + rows // 4):  # numbers side by side: each is personal, the run is not
        make, lead = r.choice([(phone, ("phone", "tel:", "call")), (ssn, ("ssn", "tax id")), (card, ("card", "visa")), (other, ("order", "version", "section"))])
        each = [make() for _ in range(r.randint(2, 4))]
        before = r.choice([plain(), say(*lead)]) + r.choice(["", "", "", ip() + " ", date() + " "])
        out.append({"id": i, "text": before + r.choice([" ", " ", " / "]).join(each), "truth": [] if make is other else each})
    return out


@cache
def trained(seed: int = 7):
    """(trees as SQL, thresholds on the log-odds by kind); features come from the same expressions
    as in the main path, so both see the same numbers."""
    spark = SparkSession.getActiveSession()
    made = spark.range(1).select(F.explode(F.from_json(F.lit(json.dumps(made_candidates(seed))), "array<struct<id:int,text:string,label:int,truth:array<string>>>")).alias("m"))
    rows = made.select("m.id", "m.label", "m.truth", F.explode(proposals(F.col("m.text"))).alias("c")).withColumn("label", F.coalesce("label", F.array_contains("truth", F.col("c.body")).cast("int")))
    table = rows.orderBy("id", "c.start", "c.end", "c.rank").select("id", "label", "c.kind", *[F.expr(e).cast("double").alias(n) for n, e in FEATURES.items()]).collect()
    x = np.array([list(r)[3:] for r in table], dtype=float)
    y = np.array([r["label"] for r in table], dtype=float)
    aside = np.array([r["id"] // 14 % 3 == 2 for r in table])
    model = boosting.fit(x[~aside], y[~aside], trees=24, depth=3, rate=0.3)
    score, truth, kinds = boosting.log_odds(model, x[aside]), y[aside], np.array([r["kind"] for r in table])[aside]

    def threshold(own: np.ndarray) -> float:
        """The lowest from which on the share of true ones is high enough."""
        order = np.argsort(-score[own], kind="stable")
        precise = np.cumsum(truth[own][order]) / np.arange(1, len(order) + 1) >= PRECISION
        return max(float(score[own][order][np.flatnonzero(precise)[-1]]) if precise.any() else float("inf"), 0.0)

    return model, {k: threshold(np.flatnonzero(kinds == k)) for k in ADDED}


def judged(proposed: str) -> Column:
    """Of the column of proposals, those above the threshold, with their log-odds."""
    (start, trees), thresholds = trained()
    features = "named_struct(" + ", ".join(f"'{n}', {e}" for n, e in FEATURES.items()) + ")"
    names = [f"x.f.{n}" for n in FEATURES]
    score = " + ".join([f"{start!r}D", *[boosting.as_sql(t, names) for t in trees]])
    scored = f"transform(transform({proposed}, c -> struct(c AS c, {features} AS f)), x -> struct(x.c.rank AS rank, x.c.start AS start, x.c.end AS end, x.c.kind AS kind, {score} AS score))"
    least = " ".join(f"WHEN '{k}' THEN {'double(\'infinity\')' if t == float('inf') else f'{t!r}D'}" for k, t in thresholds.items())
    return F.expr(f"filter({scored}, s -> s.score >= CASE s.kind {least} END)")


def overlaps(a: Column, b: Column) -> Column:
    return (a["start"] < b["end"]) & (b["start"] < a["end"])


def chains(spans: Column) -> Column:
    """Spans in order of start, cut where none reaches over: an array of arrays."""

    def cut(s: Column) -> Column:
        def starts(reach: Column) -> Column:
            first = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | (s[i]["start"] >= F.get(reach, i - 1)))
            return let(first, lambda at: F.transform(at, lambda i, k: F.slice(s, i + 1, F.coalesce(F.get(at, k + 1), F.size(s)) - i)))

        return let(running_max(F.transform(s, lambda x: x["end"])), starts)

    return F.when(F.size(spans) > 0, let(spans, cut)).otherwise(F.array().cast(f"array<{CHOSEN}>"))


CHOSEN = "array<struct<start:int,rank:int,end:int,kind:string,score:double>>"


def picked(chain: Column) -> Column:
    """Of spans that overlap in a chain: those of the base, then the strongest that is free."""
    base = F.filter(chain, lambda s: s["score"].isNull())
    added = F.array_sort(F.transform(F.filter(chain, lambda s: s["score"].isNotNull()), lambda s: F.struct((-s["score"]).alias("weak"), s.alias("s"))))
    take = lambda acc, x: F.when(F.exists(acc, lambda o: overlaps(o, x["s"])), acc).otherwise(F.concat(acc, F.array(x["s"])))
    return F.when(F.size(chain) == 1, chain).otherwise(F.aggregate(added, base, take))


def search(docs: DataFrame) -> DataFrame:
    """A struct _row of all columns of ``docs``, and found: array of (rank, start, end, kind)
    in that order."""
    text = F.col("text")
    plain = lambda s: F.struct(s["rank"].alias("rank"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))
    weighed = lambda s, score: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["end"].alias("end"), s["kind"].alias("kind"), score.cast("double").alias("score"))
    every = F.array_sort(F.concat(F.transform("base", lambda s: weighed(s, F.lit(None))), F.transform("good", lambda s: weighed(s, s["score"]))))
    chosen = F.flatten(F.transform(chains(every), picked))
    return (
        carried(docs, text_or_empty().alias("text"))
        .withColumn("base", F.concat(*[checked(text, k) for k in BASE]))
        .withColumn("proposed", proposals(text))
        .withColumn("good", F.when(F.size("proposed") > 0, judged("proposed")))
        .select("_row", F.array_sort(F.transform(F.when(F.coalesce(F.size("good"), F.lit(0)) > 0, chosen).otherwise(F.transform("base", lambda s: weighed(s, F.lit(None)))), plain)).alias("found"))
    )


def count_of(found: Column, kind: str) -> Column:
    return F.size(F.filter(found, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, counts of the base kinds, base_sha256 and spans."""
    found = F.col("found")
    base = written(F.filter(found, lambda s: s["rank"] < len(BASE)))
    return search(docs.select("doc_id", "text")).select("_row.doc_id", *[count_of(found, k) for k in BASE], F.sha2(base.cast("binary"), 256).alias("base_sha256"), written(found).alias("spans"))
