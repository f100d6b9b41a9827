"""Small tables and plain versions of the corpus operators."""

import re

WORDS = re.compile("[^\x20\x09-\x0d]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

# NULLs, empty and blank texts, repeated rows and ids, and a column whose name is used inside.
ODD = [
    (7, "The same words again and again and again", "x"),
    (7, "The same words again and again and again", "x"),
    (7, "another text with the same id", None),
    (None, "a text without an id", "y"),
    (None, None, None),
    (1, None, "z"),
    (2, "", "z"),
    (3, " \n\t ", "z"),
    (4, "Ünïcödé 漢字 🙂 and 'quotes'", "z"),
    (5, "w" * 30_000, "z"),
    (6, "word " * 8_000, "z"),
]


def docs_of(spark, rows, clash="tag"):
    """A table of (doc_id, text) rows and a third column named ``clash``."""
    rows = [r if len(r) == 3 else (*r, "c") for r in rows]
    return spark.createDataFrame(rows, f"doc_id long, text string, `{clash}` string")


def words(text):
    return WORDS.findall(text or "")


def components(links, nodes):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}
