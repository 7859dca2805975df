import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make(spark):
    """Documents from (doc_id, text[, lang[, source]]) with columns whose names operators might use themselves."""

    def docs(rows, extra=True):
        rows = [(*r, *([None] * (4 - len(r)))) for r in rows]
        df = spark.createDataFrame([(*r, len(r[1]) if r[1] is not None else None) for r in rows], SCHEMA)
        if extra:
            for name in ("size", "fp", "t", "row", "rank", "score", "key", "kept", "shard", "rng", "n", "y", "id", "speaker"):
                df = df.withColumn(name, df["doc_id"] % 3)
        return df

    return docs


@pytest.fixture(scope="session")
def odd():
    """Null, empty and blank texts, repeated rows, ties, a null id and source, a very long text, text of many scripts."""
    long = " ".join(f"word{i % 700} thing{i % 11}." for i in range(30_000))
    return [
        (1, "the quick brown fox jumps over it.\nsecond line here", "en", "a"),
        (1, "the quick brown fox jumps over it.\nsecond line here", "en", "a"),
        (2, None, "en", "a"),
        (3, "", None, "b"),
        (4, " \t\n\x0b\r\x0c ", "de", None),
        (None, "text without an id", "en", "c"),
        (5, long, "en", "a"),
        (6, "ÀÉÎ 你好 한국어 😀 <|endoftext|> don't Σας İ", "fr", "\U0001f600"),
        (7, "The Quick brown fox jumps OVER it.\nsecond line here", "en", "b"),
        (8, "x" * 20_000, None, "￿"),
        (9, "one", "en", "c"),
        (10, "1234 567 !?", "en", "c"),
    ]
