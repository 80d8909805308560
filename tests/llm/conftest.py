import os

import pytest

from tests.conftest import SF_MID, SF_SMALL  # noqa: F401

LONG = " ".join(f"w{k % 977}x{k % 31}" for k in range(30_000))
PASSAGE = " ".join(f"passage{k}" for k in range(60))
ORDINARY = ("The river rises in the northern hills and runs for forty miles through farms and "
            "small towns before it meets the sea near the old harbour wall. Boats still land there.")


def edge_rows():
    """doc_id, text, lang, source, n_chars, __words: nulls, empty, blank and
    very long texts, ties, repeated rows and a clashing extra column."""
    texts = [None, "", "  \n\t ", "one", ORDINARY, ORDINARY, ORDINARY.replace("forty", "fifty"), LONG,
             PASSAGE + " alpha beta gamma", "delta epsilon " + PASSAGE, "a a a a a a a a a a a a a a a a a a a a a",
             "\n".join(["Menu", "Home", ORDINARY]), "ümläut 漢字 😀 \x1c\x85 text\xa0here"]
    rows = [(i, t, "en" if i % 2 else None, None if i == 3 else f"s{i % 2}",
             None if t is None else len(t), f"extra{i}") for i, t in enumerate(texts)]
    return rows + [rows[5]]


SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, __words string"


@pytest.fixture(scope="session")
def edges(spark):
    return spark.createDataFrame(edge_rows(), SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def duck():
    import duckdb

    from tools.compare import TABLES
    con = duckdb.connect()
    for t in TABLES:
        p = f"{SF_SMALL}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con
