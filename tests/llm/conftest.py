import pytest

#: Texts that every operator on documents must take: null, empty, blank, no letters, long, repeated, odd characters.
ODD = [
    (None, "an id that is null", "en"),
    (1, None, None),
    (2, "", "en"),
    (3, " \n\t ", "fr"),
    (4, "%% 12 !!", "de"),
    (5, "word " * 3000, "en"),
    (6, "the same words again and again in this text for all to see", "en"),
    (6, "the same words again and again in this text for all to see", "en"),
    (7, "the same words again and again in this text for all to see", None),
    (8, "<|endoftext|> 日本語 \x1c é  <|im_end|>", "en"),
    (-9, "x" * 20_000, "en"),
    (10, "Two", "fr"),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Awkward documents, with extra columns whose names operators might use themselves."""
    rows = [(i, t, lang, "s", len(t or ""), "x", 1, 2.0) for i, t, lang in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, cls string, score int, kept double").repartition(3)


@pytest.fixture(scope="session")
def none(odd):
    return odd.filter("false")
