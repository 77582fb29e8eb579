import pytest

SMALL = "/root/testdata/sf0.001"
SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, id string, k string, row string, "
          "name string, component string, class string, size string, node string, label string, __row string, __doc string, "
          "__k string, __cuts string, _n_lines string, __x string, __text string, _id string, _slot string")


@pytest.fixture(scope="session")
def documents(spark):
    """Rows (doc_id, text[, lang, source, n_chars]) with further columns whose names operators use inside."""
    def make(rows):
        full = [(*r, *([None] * (5 - len(r))), *("x",) * 18) for r in rows]
        return spark.createDataFrame(full, SCHEMA)

    return make


@pytest.fixture(scope="session")
def small(spark):
    """The smallest documents table: rows (doc_id, text, lang)."""
    table = spark.read.parquet(f"{SMALL}/documents.parquet")
    return [(r["doc_id"], r["text"], r["lang"]) for r in table.select("doc_id", "text", "lang").collect()]


LONG = " ".join(f"word{i % 977} x{i}" for i in range(60_000))
EDGES = [(None, None), (900_001, None), (900_002, ""), (900_003, " \n\t "), (None, "a lone text without any id at all"),
         (900_004, "one"), (900_005, "ein Text"), (900_006, LONG)]


@pytest.fixture(scope="session")
def edges():
    """Null ids and texts, blank, tiny and very long texts."""
    return list(EDGES)
