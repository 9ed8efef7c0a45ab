import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _id string, _row string, key int, kept int, score int"

LONG = " ".join(f"word{i % 997}x{i}" for i in range(6000))
PROSE = " ".join(f"w{i}" for i in range(80))


@pytest.fixture(scope="session")
def edge_rows():
    """Nulls everywhere, empty and blank texts, a very long one, copies, ties and repeated rows."""
    texts = [None, "", " \n\t ", "one", "One", "ONE", "one two three four five", LONG, LONG.upper(), PROSE, PROSE + " tail",
             "Mail a.b@c.example.com or +1 (555) 123-4567, card 4111 1111 1111 1111, host 10.0.0.1.", "don't  stop now 　x́ \U0001F600 <|endoftext|>",
             "é" * 50, "a" * 300, "'s 'll  ", "x\x00y", "\x1c\x85"]
    rows = [(k, t, "en", f"src{k % 3}" if k % 5 else None, len(t or ""), "i", None, k, 1, 2) for k, t in enumerate(texts)]
    rows.append((None, "text without id", None, None, None, None, None, None, None, None))
    rows.append((None, None, None, None, None, None, None, None, None, None))
    rows += [rows[9], rows[9], (9, "another text under a used id", "en", "src0", 1, None, None, None, None, None)]
    return rows


@pytest.fixture(scope="session")
def edge(spark, edge_rows):
    """Extra columns bear names that the operators use inside."""
    return spark.createDataFrame(edge_rows, SCHEMA).repartition(3).persist()


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def small_docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet").persist()


@pytest.fixture(scope="session")
def small_rows(small_docs):
    return sorted((r["doc_id"], r["text"]) for r in small_docs.collect())
