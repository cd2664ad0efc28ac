import os

import pytest


@pytest.fixture(scope="session")
def llm_dir():
    """Tables that the queries are compared with brute force on; another folder by LLM_TEST_DIR."""
    return os.environ.get("LLM_TEST_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def odd_docs(spark):
    """NULLs, empty and long texts, repeated rows, and columns whose names the operators use themselves."""
    rows = [
        (1, None), (2, ""), (3, " \n\t "), (4, "word"), (4, "word"), (None, "no id at all"), (None, None), (5, "x" * 70_000), (6, "Straße ça — ok\n" * 4000),
        (7, "all rights reserved. " * 3), (8, "\U0001f600 é \x00 end"), (-9, "some words that repeat " * 50), (10, "some words that repeat " * 50),
    ]
    rows = [(*r, "fp", 1, "k", 2.0, 3, "w") for r in rows]
    return spark.createDataFrame(rows, "doc_id long, text string, fp string, y int, key string, score double, length long, low string")


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string")
