import pytest

#: Names that the operators use inside.
CLASHING = ["digest", "kept", "score", "bundle", "fp", "id_key", "text_key", "size", "group", "key", "label", "copies"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(
    f"{c} string" for c in CLASHING
)


def corpus(spark, rows, parts=3):
    """Documents from (doc_id, text, lang, source), with columns whose names clash."""
    filled = [(i, t, lang, source, None if t is None else len(t), *["x"] * len(CLASHING)) for i, t, lang, source in rows]
    return spark.createDataFrame(filled, SCHEMA).repartition(parts)


@pytest.fixture(scope="session")
def make(spark):
    return lambda rows, parts=3: corpus(spark, rows, parts)


@pytest.fixture(scope="session")
def odd(make):
    """Nulls in every column, empty, blank and very long texts, repeated rows, one id twice."""
    words = " ".join(f"w{i % 977} and" for i in range(30_000))
    return make([
        (1, None, None, None), (2, "", "en", "a"), (3, " \t\n\x0b\x0c\r ", "en", "a"), (None, "no id here at all", None, "b"),
        (5, words, "en", "b"), (6, "x" * 200_000, "de", None), (7, "same row", "fr", "c"), (7, "same row", "fr", "c"),
        (8, "éÉ ß İ   ​ 𝔘 ñ", "es", "c"), (9, "one id, first text", "en", "a"), (9, "one id, second text", "en", "a"),
    ])


@pytest.fixture(scope="session")
def none(make):
    return make([], 1)
