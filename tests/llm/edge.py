"""Awkward tables that every operator must take."""

import random

CLASHES = "rep int, n int, cid int, block int, key string, a int, b int, doc int, component int, logit int, m int, part int, t int, norm string, slot int, share int, host_rate int, kept int, score int, id int"


def words(n, seed, vocabulary=400):
    r = random.Random(seed)
    return " ".join("w" + str(r.randrange(vocabulary)) for _ in range(n))


def documents(spark, rows=None, extra=True):
    """doc_id, text, lang, source, n_chars and columns whose names operators may use inside."""
    base = words(120, 1)
    rows = rows if rows is not None else [
        (1, base, "en", "s"), (2, base, "en", "s"), (3, base + " tail", "en", None), (4, None, None, "s"), (5, "", "en", "s"),
        (6, " \n\t ", "en", "q"), (7, "one", "fr", "q"), (8, words(30_000, 2, 10_000), "fr", "q"), (9, words(60, 3), "de", "s"), (9, words(60, 3), "de", "s"), (None, words(50, 4), "de", "s"), (10, words(70, 5) + " " + base, "en", "z"),
        (11, "Licensed under the Apache License, Version 2.0.", "en", "z"), (12, "é" * 5_000, "xx", "z"), (13, "a\u0000b <|endoftext|> \U0001f600", "en", "z"),
    ]
    n = len(CLASHES.split(","))
    pad = (None,) * n if extra else ()
    schema = "doc_id long, text string, lang string, source string, n_chars long" + (", " + CLASHES if extra else "")
    return spark.createDataFrame([(*r, len(r[1]) if r[1] else None, *pad) for r in rows], schema)


def labels(spark, rows=None):
    rows = rows if rows is not None else [(1, 1, 0), (2, 0, 1), (7, None, None), (None, 1, 1), (99, 1, 0), (1, 1, 0)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
