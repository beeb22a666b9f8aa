"""Small tables of documents with the awkward cases every operator must take."""

import random

SCHEMA = "doc_id long, text string"
CLASH = "doc_id long, text string, n_words int, size int, shard string, score string, part int, word string, start int, length int"


def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def clashing(spark, rows):
    """The same documents with further columns named as operators name their own."""
    return spark.createDataFrame([(*r, 1, 2, "x", "y", 3, "w", 4, 5) for r in rows], CLASH)


def awkward(seed=1, n=40):
    """Nulls, empty and blank texts, repeated rows and ids, odd white space, one very long text."""
    rng = random.Random(seed)
    words = ["the", "of", "Idiot", "straße", "año", "x1", "don't", "…", "日本語", "a", "12345", "😀", "ok."]
    gaps = [" ", " ", " ", "  ", "\n", "\t", "\n\n", " \n", "\n ", " ", "\x1c", "\x85", "\r\n"]
    rows = [(0, None), (1, ""), (2, " \n\t "), (3, "one"), (3, "one"), (None, "null id text here"), (4, "same text"), (5, "same text")]
    for i in range(n):
        rows.append((10 + i, "".join(rng.choice(words) + rng.choice(gaps) for _ in range(rng.randrange(1, 120)))))
    rows.append((900, "long " * 30000 + "x" * 5000))
    rows.append((901, rows[10][1]))
    return rows
