"""Small tables with nulls, empty and long texts, ties, repeats and clashing columns."""

LONG = " ".join(f"word{i % 701} tail{i % 13}" for i in range(30000))
TEXTS = [
    (1, "The quick brown fox jumps over the lazy dog near the old river bank.\nA second line that is rather ordinary."),
    (2, None),
    (3, ""),
    (4, " \n\t\n"),
    (5, LONG),
    (6, "The quick brown fox jumps over the lazy dog near the old river bank.\nA third line about something else entirely."),
    (7, "naïve café — ünïcödé 日本語 \U0001f600 text"),
    (7, "naïve café — ünïcödé 日本語 \U0001f600 text"),
    (8, "x"),
    (None, "row without an id"),
    (9, "The quick brown fox jumps over the lazy dog near the old river bank.\nA second line that is rather ordinary."),
]


def documents(spark, rows=TEXTS):
    """doc_id, text, source and columns whose names operators use for themselves."""
    data = [(i, t, None if k % 4 == 3 else f"s{k % 3}", "kept", k) for k, (i, t) in enumerate(rows)]
    return spark.createDataFrame(data, "doc_id long, text string, source string, score string, size long")


def empty(spark):
    return documents(spark).limit(0)
