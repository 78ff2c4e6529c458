import pytest

LONG = "alpha beta gamma delta epsilon " * 4000


@pytest.fixture(scope="session")
def odd(spark):
    """Null, empty and very long texts, ties, repeated rows, null ids, columns with names that operators use themselves."""
    rows = [
        (1, "the quick brown fox jumps over the lazy dog again and again", "en"),
        (1, "the quick brown fox jumps over the lazy dog again and again", "en"),
        (2, None, None),
        (3, "", "en"),
        (4, "   \n\t ", "fr"),
        (5, LONG, "en"),
        (6, "ein kurzer text mit umlauten äöüß und mehr wörtern", "de"),
        (7, "x", None),
        (None, "no id here but a text", "en"),
        (8, "日本語 テスト 😀 ÀÉ", "fr"),
        (9, "the quick brown fox jumps over the lazy dog again and again", "fr"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    for name in ("n", "h", "class", "found", "mark", "id", "k", "part", "word", "label", "toxic", "score", "n_chars", "row"):
        df = df.selectExpr("*", f"'clash' as `{name}`" if name != "n_chars" else "cast(length(text) as long) as n_chars")
    return df.cache()


@pytest.fixture(scope="session")
def none(odd):
    return odd.filter("false")
