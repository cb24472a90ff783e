import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words string, kept int, score string, id int, text_hash int"


@pytest.fixture(scope="session")
def docs_of(spark):
    """Rows (doc_id, text) as a documents table with extra columns that clash with computed ones."""

    def make(rows, schema=SCHEMA):
        return spark.createDataFrame([(i, t, None, "s", len(t) if t is not None else None, "x", 7, None, None, 1) for i, t in rows], schema).repartition(3)

    return make


@pytest.fixture(scope="session")
def sample(spark, sf):
    """The small documents table as {doc_id: text}."""
    return {r[0]: r[1] for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}


LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(60_000))


@pytest.fixture(scope="session")
def awkward():
    """Nulls, empties, white space, one huge text, repeated rows, repeated texts, null ids."""
    return [
        (1, None), (2, ""), (3, " \n\t "), (4, LONG), (5, "one two three four five six seven eight nine ten"), (5, "one two three four five six seven eight nine ten"),
        (6, "one two three four five six seven eight nine ten"), (None, "one two three four five six seven eight nine ten"), (7, "x" * 200_000), (8, "É é ß 漢字 \U0001f600 ok"), (9, "!!! ... ###"), (10, "two words"),
    ]
