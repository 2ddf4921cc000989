import pytest


@pytest.fixture(scope="session")
def hard(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, clashing extra columns."""
    words = [f"w{i}x" for i in range(400)]
    base = " ".join(words[:120])
    near = " ".join([*words[:60], "changed", *words[61:120]])
    rows = [
        (1, base, "en", "a", 5), (2, base, "en", "a", 5), (3, near, "fr", "b", 5), (4, None, "en", None, None), (5, "", None, "a", 0),
        (6, " \n\t\r\n ", "en", "b", 6), (7, "one", "en", "c", 3), (7, "one", "en", "c", 3), (None, "null id here", "en", "a", 12),
        (None, "null id here", "en", "a", 12), (8, "x" * 5000, "en", "a", 5000), (9, " ".join(words) + " " + " ".join(reversed(words)), "en", None, 1),
        (10, "A\nA\nB b\n\nA\nB b", "de", "d", 3), (11, "a b c d", "en", "d", 7), (12, "A B c d", "en", "d", 7), (13, "ünïcödé ☃ 日本語 😀 text here <|endoftext|> tail", "ja", "é", 9),
        (14, " ".join(["rep eat ed"] * 40), "en", "a", 1), (15, "line one is here now\n" + base, "en", "zz", 1), (16, base[:-4], "en", "zz", 1),
    ]
    df = spark.createDataFrame([(*r, f"t{i}", i, "x", 1.5) for i, r in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long, _rest string, h long, _row string, score double")
    return df.selectExpr("*", "h as node", "h as key", "h as band", "_row as _text", "h as ids", "h as component", "h as copies", "h as n_words", "h as n_lines", "h as `a.b`").cache()


@pytest.fixture(scope="session")
def empty(hard):
    return hard.where("doc_id < 0")
