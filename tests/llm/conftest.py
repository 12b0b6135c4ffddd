import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, size long, kept boolean, h long, id long, label int, part int, v string"


def rows_of(spark, rows):
    """Documents from (doc_id, text, lang, source), with further columns whose names clash with ours."""
    return spark.createDataFrame([(i, t, lang, s, len(t or ""), 0.5, 7, True, 3, 9, 1, 2, "x") for i, t, lang, s in rows], SCHEMA)


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in any column, empty, blank and very long texts, ties and repeated rows."""
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(300)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    rows = [(i, text(rng.randint(1, 60)), rng.choice(["en", "de", None]), rng.choice(["a", "b", None])) for i in range(40)]
    rows += [(None, "no id here", "en", "a"), (None, None, None, None), (100, None, "en", "a"), (101, "", "de", None), (102, " \n\t ", "en", "b"), (103, "123 !!", "en", "b"), (104, text(20_000), "en", "a"), (105, "same", "en", "a"), (105, "same", "en", "a"), (105, "other", "en", "a"), (106, "ÄÖ 中文 <|endoftext|> 😀", None, "b")]
    rows += [rows[3], rows[3]]
    return rows_of(spark, rows), rows


@pytest.fixture(scope="session")
def none(spark):
    return rows_of(spark, [])


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, int(i % 3 == 0)) for i in range(40)] + [(None, 1, 1), (1, None, None), (1, 0, 0)], "doc_id long, quality int, toxic int")
