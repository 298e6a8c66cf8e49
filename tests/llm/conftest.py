import pytest

#: Columns whose names the operators use themselves, or once did, and what each row holds in them.
CLASH = {
    "row long": 1,
    "key string": "k",
    "fp long": 2,
    "hash long": 3,
    "label int": 4,
    "n long": 5,
    "words int": 6,
    "spans string": "x",
    "salt int": 7,
    "later long": 8,
    "lines string": "y",
    "n_lines int": 9,
    "lines_gone int": 10,
    "__x string": None,
    "__row long": 11,
    "__lines int": 12,
    "__gone int": 13,
    "__spans int": 14,
}


@pytest.fixture(scope="session")
def documents(spark):
    """Rows (doc_id, text) as a frame of documents with clashing extra columns."""

    def make(texts, ids=None):
        ids = list(range(len(texts))) if ids is None else ids
        rows = [(i, t, "en", "s", None if t is None else len(t), *CLASH.values()) for i, t in zip(ids, texts, strict=True)]
        return spark.createDataFrame(rows, f"doc_id long, text string, lang string, source string, n_chars long, {', '.join(CLASH)}")

    return make


@pytest.fixture(scope="session")
def clash():
    return {k.split()[0]: v for k, v in CLASH.items()}
