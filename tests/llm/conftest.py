import pytest

#: Rows with every odd case: nulls in any column, empty and long texts, ties and repeated rows, columns whose names clash.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size int, block string, row string, words string, h string, key string, ids string, fp string, target string"
LONG = "lorem ipsum dolor sit amet consectetur " * 4000


def odd_rows():
    more = (None,) * 9
    base = [
        (1, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu\nCommon Line\n", "en", "a"),
        (2, "Alpha Beta gamma delta epsilon zeta eta theta iota kappa lambda mu\n common line \nother", "en", "a"),
        (3, None, "en", "b"),
        (4, "", None, None),
        (5, " \t\n\x0b\x0c\r ", "de", "b"),
        (6, LONG, "en", "a"),
        (7, LONG, "en", "c"),
        (7, LONG, "en", "c"),
        (7, "same id, other text entirely different from the first one here", "en", "c"),
        (None, "a row without an id that still has some words to count in it", None, None),
        (8, "naïve café – ünïcödé ▁ ☃ 世界 words", "fr", ""),
    ]
    rows = [(i, t, lang, s, None if t is None else len(t), *more) for i, t, lang, s in base]
    return rows + [rows[0][:1] and (20 + k, f"Text number {k} stands alone with {k} own words\nCOMMON LINE", "en", "a", 1, *more) for k in range(12)]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def texts():
    return [(r[0], r[1]) for r in odd_rows()]
