import pytest

from veridelta.llm.common import tokenizer  # noqa: F401  tests need the library

#: Names that meet those inside the operators.
ODD = ["fp", "h", "rank", "id", "tie", "block", "position", "__key", "__id", "__th", "__x", "x", "key", "row", "th", "epoch", "copy", "n_tokens", "mix_key"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{name} long" for name in ODD)


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in any column, empty, blank and very long texts, ties, repeated rows, and extra columns whose names clash with inner ones."""
    long = " ".join(f"word{i % 977}" for i in range(30000))
    near = " ".join(f"near{i}" for i in range(400))
    texts = [
        (1, "The same text, word for word, in two documents of the table."), (2, "The same text, word for word, in two documents of the table."), (3, None), (4, ""), (5, " \n\t "), (6, long), (7, long + " end"), (8, near), (9, near.replace("near399", "other")),
        (None, "a row without an id"), (10, "one"), (11, "two words"), (12, "don't <|endoftext|> split 'll  this\n\n text"), (13, "Größe naïve Ünïcode 日本語 😀 x\u0085y　z"), (2, "The same text, word for word, in two documents of the table."), (14, "a"),
    ]
    return spark.createDataFrame([(i, t, None, f"s{(i or 0) % 3}" if i != 5 else None, None, *range(len(ODD))) for i, t in texts], SCHEMA)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
