import random

import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def words(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefghij") for _ in range(r.randint(2, 7))) for _ in range(n))


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, an empty and a long text, copies, near copies, a repeated row."""
    base = words(1, 200)
    near = base.split()
    near[100] = "changed"
    rows = [(0, base), (1, base), (2, " ".join(near)), (3, words(2, 120)), (4, ""), (5, None), (6, " \t\n"), (7, words(3, 30_000)), (8, "one two"), (9, base.upper()), (None, words(4, 80)), (3, words(2, 120)), (10, "é ü " * 70)]
    full = [(i, t, None if i == 3 else ("en", "de")[k % 2], None if i == 8 else f"src{k % 3}", None if t is None else len(t)) for k, (i, t) in enumerate(rows)]
    return spark.createDataFrame(full, SCHEMA).cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture
def folder(tmp_path, odd_docs):
    odd_docs.write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


@pytest.fixture
def empty_folder(tmp_path, no_docs):
    no_docs.write.parquet(f"{tmp_path}/none/documents.parquet")
    return f"{tmp_path}/none"
