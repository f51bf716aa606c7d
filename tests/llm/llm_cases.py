"""Odd rows that every operator must take."""

import random

WORDS = [f"{a}{b}" for a in "the of and in to that word house river light stone green paper".split() for b in ("", "s", "er")]
SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, size string, shard string, "
          "node string, label string, path string, _row string, score string")


def prose(seed, n=120):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + ("." if r.random() < 0.1 else "") for _ in range(n))


def documents(n=40):
    """Plain documents and, behind them, nulls, empty and long texts, repeated rows and ids."""
    clash = ("a", "b", "c", "d", "e", "f", None)
    rows = [(i, prose(i), "en" if i % 2 else "de", f"s{i % 3}", None, *clash) for i in range(n)]
    rows += [(100, None, "en", "s0", 1, *clash), (101, "", None, None, None, *clash), (102, " \n\t", "en", "s1", 0, *clash),
             (103, prose("long", 60_000), "en", "s0", 9, *clash), (104, "Über ßtraße żółw 漢字", "de", "s2", 2, *clash),
             (105, prose(1), "en", "s1", 5, *clash), (105, prose(1), "en", "s1", 5, *clash),
             (106, prose(2), None, "s1", 5, *clash), (106, prose(3), "en", None, 5, *clash),
             (None, prose(4), "en", "s1", 5, *clash), (None, None, None, None, None, *clash), (107, "one two", "en", "s1", 7, *clash)]
    return rows


def frame(spark, rows, schema=SCHEMA):
    return spark.createDataFrame(rows, schema)
