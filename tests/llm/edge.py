"""Hard rows for the operators on documents."""

LONG = " ".join(f"w{i % 977}x{i // 977}" for i in range(30_000))
PASSAGE = " ".join(f"passage{i}" for i in range(60))
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, did long, fp string, length string, h int, `a.b` string, key string"


def rows():
    same = "the same short text of nine words once more"
    texts = [
        (None, "row without an id " + PASSAGE), (1, None), (2, ""), (3, LONG), (4, same), (4, same), (5, same),
        (6, "start " + PASSAGE + " middle " + PASSAGE + " end"), (7, PASSAGE), (8, " \t\n "), (9, "one"), (10, LONG), (11, "ünï çödé ñandú " * 30),
        (12, "A B\u00a0C\x1cD"), (13, "You stupid l0ser <|endoftext|> it's"), (14, "x" * 5000),
    ]
    return [(i, t, None if i == 5 else "en", None if i == 7 else "s", None if i in (3, 9) else len(t or ""), 1, "a", "b", 2, "c", "d") for i, t in texts]


def table(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
