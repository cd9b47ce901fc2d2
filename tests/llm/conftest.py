import pytest


def prose(seed: int, n: int) -> str:
    """n words, no two texts alike, common words in their usual shares among made ones."""
    import random

    from lanternql.llm.quality import REFERENCES

    r = random.Random(seed)
    _, common, shares = REFERENCES["en"]
    made = lambda: "".join(r.choice("aeioubcdlmnrst") for _ in range(r.randint(3, 9))) + r.choice(["", "", "", "", ".", ","])
    return " ".join(w or made() for w in r.choices([*common, ""], shares, k=n))


#: Null, empty, blank, very long, repeated and tied texts.
ODD = [(900, None), (901, ""), (902, " \n\t "), (903, "x"), (904, "word " * 3000), (905, "y" * 20000), (906, "é日本 " * 50), (907, "a\x00b   c\x1cd"), (None, "no id at all"), (None, "no id at all"), (908, "same row"), (908, "same row")]


@pytest.fixture(scope="session")
def texts():
    out = [(i, prose(i, 20 + 7 * i)) for i in range(40)]
    out += [(100 + i, out[i][1]) for i in range(6)]  # copies
    out += [(200 + i, out[20 + i][1] + " and one more") for i in range(6)]  # near copies
    return out + ODD


@pytest.fixture(scope="session")
def docs(spark, texts):
    langs, sources = ["en", "de", None, "xx"], ["a", "b", "a", None, "a"]
    rows = [(i, t, langs[k % 4], sources[k % 5], None if t is None else len(t), "extra", 1.5) for k, (i, t) in enumerate(texts)]
    # further columns with names that operators use inside
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, found string, size double").repartition(3).cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
