from pathlib import Path

import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def documents(spark):
    """Build a documents table with an extra column from ``(doc_id, text)`` pairs."""
    def make(rows, lang="en", source="s"):
        return spark.createDataFrame(
            [(i, t, lang, source, len(t or ""), "extra") for i, t in rows],
            "doc_id long, text string, lang string, source string, n_chars long, size string")
    return make


@pytest.fixture(scope="session")
def sf_dir():
    if not Path(SF).exists():
        pytest.skip("test tables are not here")
    return SF


@pytest.fixture(scope="session")
def vocabulary():
    return pytest.importorskip("public_tokenizers").path("piece_bpe_32k.model")
