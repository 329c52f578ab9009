import pytest

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
EXTRA = (
    "doc_id bigint, text string, lang string, source string, n_chars bigint, score string, key string, block string,"
    " bucket string, fp string, hits string, words string, w string, p string, root string, held_out string, _id string"
)


@pytest.fixture(scope="session")
def docs(spark):
    """Documents from rows of (doc_id, text[, lang])."""

    def make(rows, extra=False):
        full = [(r[0], r[1], r[2] if len(r) > 2 else None, None, None if r[1] is None else len(r[1])) for r in rows]
        if extra:
            return spark.createDataFrame([(*r, *["x"] * 12) for r in full], EXTRA)
        return spark.createDataFrame(full, DOCS)

    return make


@pytest.fixture(scope="session")
def edge_rows():
    """NULLs, empty, blank and long texts, repeated rows, ids that repeat or are missing."""
    long = " ".join(f"word{i % 97} of{i % 31}" for i in range(3_000))
    return [
        (1, "Ein kurzer Text, dann noch einer."), (2, None), (3, ""), (4, " \t\n "), (5, long), (5, long), (6, long + " tail"),
        (None, "without an id"), (None, None), (7, "a"), (7, "another text under the same id"), (8, "ÀÉ é 中文 😀 don't"), (9, "x" * 5_000),
    ]
