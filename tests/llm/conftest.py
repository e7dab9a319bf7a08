import pytest


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and long texts, repeated rows, and further columns with names that operators use inside."""
    long = " ".join(f"w{i % 977}x{i}" for i in range(30_000))
    rows = [
        (1, "The quick brown fox jumps over the lazy dog.", "en", "a", 44),
        (1, "The quick brown fox jumps over the lazy dog.", "en", "a", 44),
        (2, None, None, None, None),
        (3, "", "en", "a", 0),
        (4, " \t\n ", "en", None, 4),
        (None, "No id here at all", "en", "b", 17),
        (5, long, "en", "b", len(long)),
        (6, "ÄÖ ß 𝔘nicode <b>&amp;</b> 東京 İ", "de", "c", 30),
    ]
    names = ["score", "fp", "key", "n", "size", "target", "taken", "copies", "p", "chunk", "seed", "k1", "k2", "spans", "word", "pair", "root", "node", "held_out"]
    return spark.createDataFrame(
        [(*r, *(["clash"] * len(names))) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n}` string" for n in names)
    )


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.where("false")
