import pytest

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, key string, score string, n_words string, t string, label string"

#: Texts that every operator must get through: absent, empty, blank, odd and very long ones, ties and repeated rows.
TEXTS = [
    (1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "same words in the same order here"), (6, "same words in the same order here"), (6, "same words in the same order here"),
    (6, "another text under an id that is taken"), (None, "a text without an id is still a text"), (None, None), (7, "éè \U0001f600 日本語 <|endoftext|> İΣ \x00 \x85   x"),
    (8, "word " * 30000), (9, "x" * 200_000), (10, "1 2-3 4 5" * 5000), (11, "@" * 3000 + "a@b.c"), (12, "\n" * 5000), (13, "token = \"" + "ab1" * 20 + "\" " * 3), (14, "unique" + " filler" * 40),
    (0, "The zero id has twelve words in it so that it passes all base rules"), (-5, "A negative id is an id"),
]


@pytest.fixture(scope="session")
def odd(spark):
    rows = [(i, x, "en", None if k % 3 else f"s{k % 4}", None, "k", "s", "w", "t", "l") for k, (i, x) in enumerate(TEXTS)]
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def labels(spark):
    rows = [(4, 1, 0), (5, 1, 0), (6, 0, 1), (6, 1, 0), (None, 1, 1), (7, None, None), (8, 0, 1), (14, 1, 0), (0, 1, 1), (99, 1, 1)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


@pytest.fixture(scope="session")
def no_labels(spark):
    return spark.createDataFrame([], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")
