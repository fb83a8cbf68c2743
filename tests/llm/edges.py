"""Rows that every operator has to stand."""

# Nulls, empty texts, no words, no letters, equal rows, equal
# ids, characters of several bytes, a letter whose lower case is ASCII, a very long text.
EDGES = [
    (1, None, "en", "a", None),
    (2, "", None, "a", 0),
    (3, " \t\n ", "en", None, 4),
    (4, "... !!! ---", "de", "b", 11),
    (None, "no id at all but some plain words in a row", "en", "a", 42),
    (None, "no id at all but some plain words in a row", "en", "a", 42),
    (5, "word", "en", "a", 4),
    (6, "same row twice over", "en", "b", 19),
    (6, "same row twice over", "en", "b", 19),
    (7, "same id, other text", "en", "b", 19),
    (7, "same id, another text", "en", "b", 21),
    (8, "Ünïcödé wörds été Kelvin and 日本語 😀 İstanbul", "fr", "c", 45),
    (9, "long " * 30_000 + "tail of a very long text", "en", "c", 150_024),
    (10, "long " * 30_000 + "tail of a very long text", "en", "c", 150_024),
    (11, "nul \x00 and \x1f control \x85 next", "en", "c", 26),
]
