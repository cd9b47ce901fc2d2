"""Quality rules: distribution divergence against language references.

A document's histogram of character classes and its histogram of common words are
compared with those of its language by Jensen-Shannon distance (base 2).  A histogram
of n draws from the reference itself lies about sqrt(bins/n) away, so the limits fall
with the length of the document, and very short documents are not judged at all.

Everything is a row-local column expression: no shuffle, no Python.

Null text: no words.  Unknown or null language: the nearest reference counts, the first of
equals.  Repeated rows are judged each alike.  Very long texts: time and memory follow their
length.  Extra columns, also of the names used here, are carried along.  Empty table: empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lanternql.llm.common import SPACE, carried, let, text_or_empty

LEAST_WORDS = 50
MOST_REPEATED_PERCENT = 50
LEAST_CHARS_JUDGED = 200
LEAST_WORDS_JUDGED = 50
CHAR_LIMIT = (0.10, 1.20)  # limit + slope / sqrt(n words)
WORD_LIMIT = (0.14, 1.15)

#: Character classes; what is in none of them is the last bin.
SYMBOLS = "#*$%&|<>"
CLASSES = ("a-z", "A-Z", "0-9", r"\x20\x09-\x0D", r".,;:!?'\"()\-", SYMBOLS)

# Shares of the character classes, common words, and their shares (last bin:
# all other words), measured on documents labelled good.
REFERENCES = {
    "en": (
        (0.7938, 0.0144, 0.0010, 0.1663, 0.0244, 0.0000, 0.0001),
        ("the", "of", "and", "to", "a", "in", "is", "that", "it", "for", "was", "on"),
        (0.0556, 0.0287, 0.0238, 0.0172, 0.0136, 0.0118, 0.0106, 0.0090, 0.0082, 0.0078, 0.0069, 0.0066, 0.8002),
    ),
    "de": (
        (0.7717, 0.0126, 0.0008, 0.1545, 0.0221, 0.0000, 0.0383),
        ("der", "die", "und", "in", "den", "von", "zu", "das", "mit", "sich", "ist", "nicht"),
        (0.0542, 0.0286, 0.0228, 0.0169, 0.0143, 0.0113, 0.0098, 0.0096, 0.0079, 0.0076, 0.0051, 0.0047, 0.8072),
    ),
    "fr": (
        (0.7065, 0.0109, 0.0019, 0.1662, 0.0244, 0.0000, 0.0900),
        ("de", "la", "le", "et", "les", "des", "en", "un", "du", "une", "que", "est"),
        (0.0544, 0.0297, 0.0219, 0.0164, 0.0134, 0.0123, 0.0118, 0.0095, 0.0084, 0.0071, 0.0066, 0.0061, 0.8024),
    ),
    "es": (
        (0.7232, 0.0128, 0.0009, 0.1616, 0.0237, 0.0000, 0.0778),
        ("de", "la", "que", "el", "en", "y", "a", "los", "del", "las", "un", "por"),
        (0.0557, 0.0278, 0.0225, 0.0161, 0.0144, 0.0113, 0.0103, 0.0085, 0.0072, 0.0095, 0.0068, 0.0050, 0.8049),
    ),
}
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def single_spaced(text: Column) -> Column:
    """The words, joined by single blanks."""
    return F.trim(F.regexp_replace(text, SPACE, " "))


def number_of_words(spaced: Column) -> Column:
    return F.when(spaced == "", 0).otherwise(F.octet_length(spaced) - F.octet_length(F.replace(spaced, F.lit(" "), F.lit(""))) + 1)


def duplicate_lines(text: Column) -> Column:
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long"))


def repeated_words(spaced: Column) -> Column:
    """Words that lie in a 3-word window found twice or more."""
    windows = F.regexp_extract_all(F.concat(F.lit(" "), spaced), F.lit(" (?=([^ ]+ [^ ]+ [^ ]+))"), F.lit(1))

    def exact(g: Column) -> Column:
        # windows in order of text and place: equal ones are neighbours
        ordered = F.array_sort(F.transform(g, lambda x, i: F.struct(x.alias("g"), i.alias("i"))))

        def hit(s: Column) -> Column:
            twice = F.filter(s, lambda x, j: F.coalesce(x["g"] == F.get(s, j - 1)["g"], F.lit(False)) | F.coalesce(x["g"] == F.get(s, j + 1)["g"], F.lit(False)))
            return F.size(F.array_distinct(F.flatten(F.transform(twice, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)))))

        return let(ordered, hit)

    return let(windows, lambda g: F.when(F.size(F.array_distinct(g)) < F.size(g), exact(g)).otherwise(0)).cast("long")


def class_counts(text: Column) -> Column:
    """Counts of CLASSES in their order and of all other characters; what one class takes
    away the next need not read."""

    def peeled(rest: Column, classes: tuple[str, ...], counts: list[Column]) -> Column:
        if not classes:
            return F.array(*counts, F.length(rest))
        return let(F.regexp_replace(rest, f"[{classes[0]}]+", ""), lambda less: peeled(less, classes[1:], [*counts, F.length(rest) - F.length(less)]))

    return peeled(text, CLASSES, [])


def word_counts(spaced: Column, n_words: Column, common: tuple[str, ...]) -> Column:
    """Counts of the common words in their order and of all other words."""
    # every word between blanks of its own, so that neighbours do not share one
    apart = F.concat(F.lit(" "), F.replace(F.lower(spaced), F.lit(" "), F.lit("  ")), F.lit(" "))

    def counted(p: Column) -> Column:
        counts = F.array(*[((F.octet_length(p) - F.octet_length(F.replace(p, F.lit(f" {c} "), F.lit("")))) / (len(c.encode()) + 2)).cast("int") for c in common])
        return let(counts, lambda x: F.concat(x, F.array(n_words - F.aggregate(x, F.lit(0), lambda a, b: a + b))))

    return let(apart, counted)


def js_distance(counts: Column, reference: tuple[float, ...]) -> Column:
    q = F.array(*map(F.lit, reference))

    def part(a, m):
        return F.when(a > 0, a * F.log2(a / m)).otherwise(0.0)

    def distance(c: Column) -> Column:
        n = F.aggregate(c, F.lit(0), lambda a, b: a + b)
        terms = F.zip_with(c, q, lambda x, y: let(x / n, lambda p: part(p, (p + y) / 2) + part(y, (p + y) / 2)))
        return F.when(n > 0, F.sqrt(F.greatest(F.lit(0.0), F.aggregate(terms, F.lit(0.0), lambda a, b: a + b) / 2)))

    return let(counts, distance)


def by_language(lang: Column, measure) -> Column:
    """``measure`` with the reference of the language, or the least over all."""
    chosen = F.when(F.lit(False), F.lit(None).cast("double"))
    for name, reference in REFERENCES.items():
        chosen = chosen.when(lang == name, measure(reference))
    return chosen.otherwise(F.least(*[measure(r) for r in REFERENCES.values()]))


def verdict(m: Column) -> Column:
    """The measures with base_failed and kept."""
    base = (m["n_words"] < LEAST_WORDS) | (100 * m["n_repeat_words"] > MOST_REPEATED_PERCENT * m["n_words"])
    root = F.sqrt(m["n_words"].cast("double"))
    strange = F.lit(False)
    for name, (limit, slope), guard in (("char_distance", CHAR_LIMIT, m["chars"] >= LEAST_CHARS_JUDGED), ("word_distance", WORD_LIMIT, m["n_words"] >= LEAST_WORDS_JUDGED)):
        strange = strange | (guard & F.coalesce(m[name] > limit + slope / root, F.lit(False)))
    return F.struct(*[m[n].alias(n) for n in MEASURES], base.alias("base_failed"), (~base & ~strange).alias("kept"))


def judge(docs: DataFrame) -> DataFrame:
    """A struct _row of all columns of ``docs``, and a struct _quality of the measures,
    base_failed and kept.

    The row number, always true here, makes it an expression that no filter is moved through:
    moved down, its costly parts would be computed again for every mention.
    """
    text = text_or_empty()

    def measures(spaced: Column, counts: Column) -> Column:
        n = number_of_words(spaced)
        return F.struct(
            n.cast("long").alias("n_words"),
            F.length(F.replace(spaced, F.lit(" "), F.lit(""))).cast("long").alias("word_chars"),
            counts[CLASSES.index(SYMBOLS)].cast("long").alias("n_symbols"),
            duplicate_lines(text).alias("n_dup_lines"),
            repeated_words(spaced).alias("n_repeat_words"),
            by_language(F.col("lang"), lambda r: js_distance(counts, r[0])).alias("char_distance"),
            by_language(F.col("lang"), lambda r: js_distance(word_counts(spaced, n, r[1]), r[2])).alias("word_distance"),
            F.length(text).alias("chars"),
        )

    judged = let(single_spaced(text), lambda s: let(class_counts(text), lambda c: let(measures(s, c), verdict)))
    return carried(docs, "text", "lang").select("_row", F.when(F.monotonically_increasing_id() >= 0, judged).alias("_quality"))


def quality(docs: DataFrame) -> DataFrame:
    return judge(docs.select("doc_id", "text", "lang")).select("_row.doc_id", *[F.col(f"_quality.{n}") for n in (*MEASURES, "base_failed", "kept")])


def keep_good(docs: DataFrame) -> DataFrame:
    """The documents kept, with their own columns."""
    return judge(docs).filter("_quality.kept").select("_row.*")
