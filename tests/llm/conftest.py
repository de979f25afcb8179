import random

import pytest

DOCS_DDL = "doc_id long, text string, lang string, source string, n_chars long, node string, w0 string, `key` string, piece int, spans string"


def words(rng: random.Random, n: int) -> str:
    syllables = ["ti", "on", "re", "ha", "st", "éa", "nd", "wh", "ou", "qu"]
    return " ".join("".join(rng.choice(syllables) for _ in range(rng.randint(1, 4))) for _ in range(n))


def corpus() -> list[tuple[int | None, str | None]]:
    """Nulls, empty and long texts, copies, near copies, a shared passage, repeated rows."""
    rng = random.Random(5)
    texts: list[str | None] = [words(rng, rng.randint(3, 260)) for _ in range(24)]
    passage = words(rng, 90)
    texts += [texts[0], texts[0], texts[1] + " " + passage, passage + "\n" + texts[2], words(rng, 20) + " " + passage]
    near = texts[3].split() if len(texts[3].split()) > 60 else words(rng, 200).split()
    texts += [" ".join(near), " ".join([*near[:-1], "odd"]), None, None, "", " \t\n", "one", "x" * 9000, "tiré… 日本　語 don't!!", words(rng, 6000)]
    rows: list[tuple[int | None, str | None]] = list(enumerate(texts))
    return [*rows, rows[4], rows[4], (None, "a text without an id"), (None, texts[5])]


@pytest.fixture(scope="session")
def docs(spark):
    rows = [(i, t, "en", "src0", None if t is None else len(t), "a", "b", "c", 1, "d") for i, t in corpus()]
    return spark.createDataFrame(rows, DOCS_DDL).repartition(3).cache()


@pytest.fixture(scope="session")
def no_docs(docs):
    return docs.where("false")
