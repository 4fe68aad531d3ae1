import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
VOCAB = {
    "en": ["the", "thing", "over", "river", "house", "water", "green", "light", "morning", "walked", "under", "with", "stone", "bridge"],
    "de": ["der", "und", "straße", "schön", "wasser", "häuser", "grün", "licht", "morgen", "ging", "unter", "mit", "stein", "brücke"],
    "fr": ["le", "et", "rivière", "maison", "été", "verte", "lumière", "matin", "marchait", "sous", "avec", "pierre", "pont", "où"],
}


def prose(rng, lang, n):
    words = [rng.choice(VOCAB[lang]) + (str(rng.randrange(40)) if rng.random() < 0.4 else "") for _ in range(n)]
    return "\n".join(" ".join(words[i : i + 12]) + "." for i in range(0, n, 12))


@pytest.fixture(scope="session")
def rows():
    """Prose in three languages, copies, near copies, short and odd texts, null columns, repeated rows."""
    rng = random.Random(8)
    out = []
    for i in range(90):
        lang = ("en", "de", "fr")[i % 3]
        out.append((i, prose(rng, lang, rng.randrange(60, 200)), lang, f"src{i % 4 if i % 2 else 0}"))
    for i in range(90, 100):
        out.append((i, out[5][1], "en", "src0"))  # exact copies
    for i in range(100, 112):
        words = out[7][1].split(" ")
        words[rng.randrange(len(words))] = f"new{i}"
        out.append((i, " ".join(words), "de", "src0"))  # near copies
    for i, odd in enumerate(["", " ", "\n\n", "word", "12 34", "a b", "x" * 5000, "　é中\U0001f600", "a\x1cb c\x1fd", "same same same same same same"]):
        out.append((120 + i, odd, "en", "src1"))
    out.append((140, None, "en", "src1"))
    out.append((141, out[3][1], None, None))
    out.append((None, out[4][1], "fr", "src2"))
    out.append((142, " ".join(rng.choice(VOCAB["en"]) for _ in range(20_000)), "en", "src3"))  # very long
    out.append(out[9][:4])  # a repeated row
    return [(d, t, lang, s, None if t is None else len(t)) for d, t, lang, s in out]


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def clashing(docs):
    """The same documents under more columns, named as operators might name their own."""
    from pyspark.sql import functions as F

    names = ["size", "copies", "rate", "row", "pos", "n", "removed", "digest", "bands", "parity", "gone", "_doc", "target", "place", "shard", "kept", "score", "id", "key"]
    return docs.select("*", *[F.lit(f"own {n}").alias(n) for n in names])


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(i, int(i % 5 != 0), int(i % 6 == 0)) for i in range(0, 90)] + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
