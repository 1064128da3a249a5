"""A small table with every awkward case, and plain-Python rules to hold results against."""

import re
import string

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
# Columns whose names the operators use inside.
SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, id long, size int, score string, row int, h long, "
          "of string, key string, w string, label string, rep long, part string, prints long")
BASE = "the quick brown fox jumps over the lazy dog near the old stone bridge while seven birds watch from the tall dark pines "


def rows():
    long = " ".join(f"w{i % 997}" for i in range(30_000))
    texts = [(1, BASE * 3), (2, BASE * 3), (3, (BASE * 3).upper()), (4, BASE * 2 + "one more"), (5, None), (6, ""), (7, " \n\t"),
             (8, long), (9, "short"), (9, "short"), (10, "Ünïcode wörds ÉCOLE École"), (None, BASE * 3), (None, None), (11, "short"),
             (12, "first line here\nshared long line of text\n\nSHARED LONG LINE OF TEXT  \nlast"),
             (13, "shared long line of text\nother\nshared long line of text"), (14, "token = abcdef123456 and AKIA" + "A1B2" * 5),
             (15, "work under CC-BY license. All rights reserved. cc by"), (15, "another text with the same id"), (0, "zero")]
    sources = ["a", "b", None, "", "a", "é", "z"]
    return [(i, t, "en", sources[n % 7], len(t or ""), 99, 1, "x", 3, 7, "o", "k", "w", "l", 5, "p", 8) for n, (i, t) in enumerate(texts)]


def table(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def spaced(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def alnum(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
