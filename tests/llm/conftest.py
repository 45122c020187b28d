import public_tokenizers
import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, variant string, key long, row string, rate double, parts int"


@pytest.fixture(scope="session")
def tokenizer():
    return public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty and very long texts, ties, repeated rows, odd characters."""
    long = " ".join(f"w{i % 977}x{i % 31}" for i in range(60_000))
    texts = [None, "", " \n\t ", "a", "one two", "The same text here, twice.", "The same text here, twice.", long, long + " end", "Éa 日本 🙂\r\nline\x0btwo", 'say "x" <|endoftext|>', "idiot. fine day", "x" * 30_000]
    rows = [(i, t, None if i % 3 else "en", None if i % 4 == 0 else f"s{i % 2}", None, "v", i, "r", 0.5, 1) for i, t in enumerate(texts)]
    rows += [rows[3], rows[5]]  # repeated rows
    rows += [(None, "no id", None, "s0", 5, None, None, None, None, None), (None, None, None, None, None, None, None, None, None, None)]
    return rows


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def real(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
