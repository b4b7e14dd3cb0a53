import pytest

TABLE = "doc_id long, text string, lang string, source string, n_chars long, row string, key string, n int, id int, token string, size int, spans string, g int, start int"


@pytest.fixture(scope="session")
def frame(spark):
    """Documents with many columns whose names operators use themselves."""

    def make(rows):
        """rows: (doc_id, text[, source])."""
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or ""), "r", "k", 1, 2, "t", 3, "s", 4, 5) for r in rows]
        return spark.createDataFrame(full, TABLE)

    return make


LONG = " ".join(f"word{i % 977}{i % 13}" for i in range(9000))
ODD = [(1, None), (2, ""), (3, " \t\n"), (4, "x"), (5, "é ü İ K \U0001f600"), (None, "no id at all"), (7, LONG), (8, "same text here"), (8, "same text here"), (9, "same text here"), (10, "a" * 700)]


@pytest.fixture(scope="session")
def odd():
    """Nulls, empty and very long texts, ties and repeated rows."""
    return list(ODD)
