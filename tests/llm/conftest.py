import pytest

PASSAGE = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty"
ROWS = [
    (1, "the the cat sat on the mat", "en", "a", 1),
    (2, None, None, None, None),
    (3, "", "en", "a", 0),
    (4, "the the cat sat on the mat", "de", None, 26),
    (4, "the the cat sat on the mat", "de", None, 26),
    (5, "   \n\t  ", "en", "b", 6),
    (6, "é́ ﬁ 日本語 \U0001f600 ▁▁x <|endoftext|> </s>[INST] \\ \\\\ <\\|", "fr", "c", 40),
    (7, "word " * 5000 + "x" * 3000, "en", "a", 28000),
    (8, PASSAGE, "en", "a", None),
    (9, PASSAGE + " extra", "en", "b", None),
    (None, "no key at all", "en", "b", 5),
    (10, "\x00\x01 \x1c\x1f\x85  . ," + "9" * 300, "xx", "d", 7),
]
CLASHES = ["size", "shard", "slot", "key", "block", "severity", "ids", "b", "x", "n", "text_crc32", "kept", "media", "sources"]


@pytest.fixture(scope="session")
def edge(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, and columns named as the operators' own."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASHES)
    return spark.createDataFrame([(*r, *[f"{c} {k}" if k % 3 else None for c in CLASHES]) for k, r in enumerate(ROWS)], schema)


@pytest.fixture(scope="session")
def empty(edge):
    return edge.where("false")


@pytest.fixture(scope="session")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="session")
def texts(documents):
    return {r.doc_id: r.text for r in documents.select("doc_id", "text").collect()}
