"""Documents with nulls, empty and very long texts, ties, repeated rows and columns whose names clash with inner ones."""

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, hash string, row string, size string, batch string, rate double, key string"
LONG = "alpha beta gamma " * 40_000


def odd_rows(spark):
    rows = [
        (1, None, None, None, None),
        (2, "", "en", "b", 0),
        (3, LONG, "en", "a", None),
        (4, "Same text here\nand there", "en", "a", 1),
        (4, "Same text here\nand there", "en", "a", 1),
        (5, "Same text here\nand there", None, None, 1),
        (6, "\x00\x01 \t\n\u0085 é漢字 🙂 <|endoftext|> idiot", "xx", "b", 1),
        (None, "no id", "en", "c", 5),
    ]
    return spark.createDataFrame([(*r, "h", "r", "s", "b", 0.5, "k") for r in rows], SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
