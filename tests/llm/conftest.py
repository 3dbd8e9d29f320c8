import pytest

WORDS = [f"w{i}x{i * 7 % 13}" for i in range(400)]


def prose(start: int, n: int) -> str:
    return " ".join(WORDS[(start + i) % len(WORDS)] for i in range(n))


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty and long texts, repeated rows, ties and columns whose names clash with outputs."""
    rows = [
        (1, prose(0, 100), "en", "a"), (1, prose(0, 100), "en", "a"), (2, prose(0, 100), "en", "b"), (3, prose(0, 97) + " q1 q2 q3", "en", None),
        (4, None, None, "a"), (5, "", "en", "b"), (6, " \n\t ", "de", "b"), (7, prose(200, 3), "de", None), (None, prose(150, 60), "en", "a"), (None, None, None, None),
        (8, "A" * 5000 + " token = \"abcdef\" é漢 " + prose(50, 4000), "de", "c"), (9, prose(300, 60).upper(), "en", "c"), (10, "....,;! 1234", None, "c"),
    ]
    full = [(*r, 7, "shard?", 0.5, 1, "k", 3) for r in rows]
    return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, shard string, score double, slot int, key string, size int")


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)
