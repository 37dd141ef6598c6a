import glob

import pytest

SF = "/root/testdata/sf0.001"

#: Names that results of the operators have as well.
CLASHING = ("document", "score", "n_words", "place", "bucket", "node", "component_id", "ids", "dropped", "searched")

LONG = "".join(f"word{i % 977} " for i in range(60_000))

EDGES = [
    (0, None, "en", "a", 0),
    (1, "", "en", "a", 0),
    (2, "short", None, None, 5),
    (3, "One line that is here twice.\nAnother line stays\n\nOne line that is here twice.", "en", "b", None),
    (3, "One line that is here twice.\nAnother line stays\n\nOne line that is here twice.", "en", "b", None),
    (4, "one line that is here twice.\nAnother line stays\n\nOne line that is here twicé.", "fr", "b", 3),
    (None, "A text without an id, but with quite a few words in it.", "en", None, 1),
    (None, None, None, None, None),
    (6, LONG, "en", "c", len(LONG)),
    (7, LONG + "tail", "en", "c", len(LONG) + 4),
    (8, " \n\t ¿¡ 12345 ... ", "es", "c", 9),
    (9, "ÀÉ ß İ ſ 東京 \U0001f469‍\U0001f680 é \u0000\u001c\u0085 end", "de", "d", 9),
]


@pytest.fixture(scope="session")
def edges(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(
        f"`{name}` string" for name in CLASHING
    )
    return spark.createDataFrame([(*row, *CLASHING) for row in EDGES], schema).repartition(3)


@pytest.fixture(scope="session")
def nothing(edges):
    return edges.filter("false")


@pytest.fixture(scope="session")
def tables():
    if not glob.glob(f"{SF}/*.parquet"):
        pytest.skip("test tables missing")
    return SF


@pytest.fixture(scope="session")
def texts(spark, tables):
    """Id and whole text of every document, by id."""
    rows = spark.read.parquet(f"{tables}/documents.parquet").select("doc_id", "text").collect()
    return sorted((row.doc_id, row.text or "") for row in rows)
