"""Small tables with every awkward case."""

SCHEMA = ("doc_id bigint, text string, lang string, source string, n_chars bigint, judged int, "
          "_key string, `found.x` string, spans int, first string")

LONG = " ".join(f"word{i % 977}" for i in range(20_000))


def awkward(spark, more=()):
    """Nulls, empty and very long texts, repeated rows and ids, clashing columns."""
    texts = [
        (1, "The cat sat on the mat and the cat slept. Then it woke up again and ran away."),
        (1, "The cat sat on the mat and the cat slept. Then it woke up again and ran away."),
        (2, "The cat sat on the mat and the cat slept. Then it woke up again and ran away."),
        (3, None), (4, ""), (5, "   \n\t "), (None, None), (None, "null id text"), (6, LONG),
        (7, LONG + " end"), (8, "12345 67890"), (9, "é😀 ß \x00   x"), (10, "a"), *more,
    ]
    rows = [(i, t, None if i == 3 else "en", None if i == 4 else "s", None, 1, "k", "y", 2, "f")
            for i, t in texts]
    return spark.createDataFrame(rows, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
