"""Small tables with the awkward cases: nulls, empty and long texts, ties, repeated rows, extra columns."""

ROWS = [
    (0, "One two three four five six seven. Don't stop!\nA second line, 42 words?", "en", "src0", 10),
    (1, None, "en", "src0", 0),
    (2, "", None, None, None),
    (3, " \n\t ", "en", "src1", 4),
    (4, "Été ßtraße İstanbul naïve ½ 你好 世界 ​ x y é <|endoftext|> 😀", "fr", "src1", 30),
    (5, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu " * 900, "en", "src0", 1),
    (6, "same text twice in the table", "en", "src0", 1),
    (7, "same text twice in the table", "en", "src2", 1),
    (8, "repeated row", "en", "src2", 1),
    (8, "repeated row", "en", "src2", 1),
    (9, "x" * 30_000, "en", "src2", 1),
    (None, "a row without an id", "en", "src2", 1),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, part int, node string, score double, bin string, hash string"


def table(spark, rows=None):
    """With extra columns whose names operators might use themselves."""
    return spark.createDataFrame([(*r, 1, "n", 0.5, "b", "h") for r in (ROWS if rows is None else rows)], SCHEMA)
