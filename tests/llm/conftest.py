import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, n_hit string, class_id string, shard string, start string, notices string, lang_pred string"


@pytest.fixture(scope="session")
def frame(spark):
    """Documents from (doc_id, text) or (doc_id, text, lang), with extra columns of clashing names."""

    def make(rows):
        full = [(r[0], r[1], r[2] if len(r) > 2 else None, None, None if r[1] is None else len(r[1]), "s", "h", "c", "x", "b", "n", "l") for r in rows]
        return spark.createDataFrame(full, SCHEMA)

    return make


@pytest.fixture(scope="session")
def edge(frame):
    """Null id, null and empty texts, no words, one word, ties, repeated rows, a very long text."""
    long = " ".join(f"word{i % 977} and{i % 13}" for i in range(60_000))
    return frame([
        (1, None), (2, ""), (3, "!!! ... ???"), (4, "one"), (5, "same text here for ties and more"), (6, "same text here for ties and more"),
        (7, "repeated row of some words"), (7, "repeated row of some words"), (None, "no id but a text of words"), (None, None), (8, long), (9, "ünï çödé ñ 日本語 текст"), (10, "\n\t \u0000"),
    ])
