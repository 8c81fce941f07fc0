import pytest

from telemill.llm.shared import prepare

SF = "/root/testdata/sf0.001"

#: Null, empty, blank, short, repeated and long texts; ties in doc_id; names that clash with added columns.
LONG = " ".join(f"wort{i % 977}" for i in range(30_000))
EDGE_ROWS = [
    (None, "a text without an id but with words enough to be looked at", "x", 1, "h"),
    (1, None, None, None, None), (2, "", "en", 0, ""), (3, "   \n\t ", "en", 6, " "), (4, "Wort", "de", 4, "w"),
    (5, "Ein Satz, der zweimal vorkommt und lang genug ist, um aufzufallen: 12345.", "de", 70, "s"),
    (5, "Ein Satz, der zweimal vorkommt und lang genug ist, um aufzufallen: 12345.", "de", 70, "s"),
    (5, "Ein anderer Text mit derselben Nummer.", "de", 40, "t"),
    (7, "Ein Satz, der zweimal vorkommt und lang genug ist, um aufzufallen: 12345.", None, 70, "u"),
    (8, "naïve café 日本語 😀 ẞ İ Σ\x1c end", "xx", 20, "v"), (9, LONG, "xx", len(LONG), "l"),
]
EDGE_SCHEMA = "doc_id long, text string, words string, n_words long, hits string"


@pytest.fixture(scope="session", autouse=True)
def _prepared(spark):
    prepare(spark)


@pytest.fixture(scope="session")
def edge(spark):
    return spark.createDataFrame(EDGE_ROWS, EDGE_SCHEMA)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], EDGE_SCHEMA)


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def texts(documents):
    return {r.doc_id: r.text or "" for r in documents.select("doc_id", "text").collect()}
