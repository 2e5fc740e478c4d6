import pytest


@pytest.fixture
def docs(spark):
    """Documents with every awkward case, and columns whose names the operators use themselves."""

    def build(texts, ids=None):
        ids = range(len(texts)) if ids is None else ids
        rows = [(i, t, "xx", "src", -1) for i, t in zip(ids, texts, strict=True)]
        return spark.createDataFrame(rows, "doc_id long, text string, key string, row string, block int")

    return build


PROSE = "the quick brown fox jumps over the lazy dog while seven wizards brew potions under pale moons and nobody asks why the river runs uphill on tuesdays in this small valley of ours".split()


@pytest.fixture
def passage():
    """A passage of n words that starts at word k of an endless text."""
    return lambda k, n: " ".join(f"{PROSE[(i * 7 + i // 11) % len(PROSE)]}{i % 97}" for i in range(k, k + n))
