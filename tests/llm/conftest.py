import pytest

#: Columns whose names operators use themselves.
CLASHES = ("size", "kept", "n_words", "key", "row", "words", "draw", "hash", "text_hash", "component_id", "score", "label", "n_lines", "_doc", "shard", "run", "copy")


@pytest.fixture
def odd(spark):
    """Documents with nulls everywhere, empty, blank and long texts, ties, repeated rows, and columns with clashing names."""
    long = " ".join(f"word{i % 700} thing{i}" for i in range(6000))
    body = "\n".join(f"line {i} of a passage that several documents share word for word" for i in range(12))
    rows = [
        (1, body + "\nand one more line that is its own", "en", "a"),
        (2, body, "en", "a"),
        (2, body, "en", "a"),
        (3, body, None, None),
        (4, None, "en", "b"),
        (5, "", "en", "b"),
        (6, " \n\t\r\x0b\x0c ", "fr", None),
        (7, long, "fr", "b"),
        (8, "Ünïcödé 日本語 text 🙂 MIT License here", "de", "é"),
        (None, "no id at all, licensed under the Apache License, Version 2.0", "de", "a"),
        (None, None, None, None),
        (9, "a", "en", "a"),
        (10, "\n\n\n", "en", "a"),
        (-5, body + "\nGNU General Public License", "en", "c"),
    ]
    found = spark.createDataFrame([(*r, len(r[1]) if r[1] else None, *range(len(CLASHES))) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} int" for c in CLASHES))
    return found.repartition(3)


@pytest.fixture
def none(odd):
    return odd.limit(0)
