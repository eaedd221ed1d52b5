"""Small tables with the odd rows every operator must take."""

DOCS = "doc_id long, text string, lang string, source string, n_chars int, row string, text_sha256 string, kept int"


def documents(spark, rows, schema=DOCS):
    """Rows of ``(doc_id, text[, lang])`` in a table whose further columns clash with names the operators use."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else None, "s", 1, "x", "y", 0) for r in rows]
    return spark.createDataFrame(full, schema)


LONG = " ".join(f"w{i % 977} x{i % 31}" for i in range(20_000))
ODD = [(None, None), (1, None), (2, ""), (3, " \n\t "), (4, "a"), (5, "a"), (5, "a"), (6, LONG), (7, LONG), (None, "a b c d e f g"), (8, "é 😀 ▁   ß")]
