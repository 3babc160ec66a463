import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, target double, fp long, k long, h long, o long, score double, component_id long, uid long, copies long, stats string, ids string, base string, block int, tile long"


def row(doc_id, text, source="a"):
    return (doc_id, text, "en", source, len(text or ""), 7, 0.5, 1, 2, 3, 4, 0.1, 5, 6, 8, "x", "y", "z", 1, 2)


def sentence(rng, n):
    return " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9))) for _ in range(n))


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls in any column, empty, blank and very long texts, repeated rows, equal texts, and clashing extra columns."""
    rng = random.Random(3)
    long_text = "\n".join(sentence(rng, 12) for _ in range(3000))
    rows = [row(1, None), row(2, ""), row(3, " \n\t \n"), row(None, "no id here"), row(4, long_text, None), row(5, "same text in two rows"), row(5, "same text in two rows"), row(6, "same text in two rows", "b"), row(7, "ünï códe \u2028 and 😀 emoji", None), row(None, None, None)]
    return rows + [row(100 + i, sentence(rng, 80), rng.choice("abc")) for i in range(20)]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, SCHEMA)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
