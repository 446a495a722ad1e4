"""Small documents with every awkward case, and the words of the contracts."""

import re

from pyspark.sql import types as T

WORD = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
CLASHING = ["id", "row", "text_", "k1", "k2", "v", "label", "kept", "size", "shard", "part",
            "slot", "n", "n_words", "words", "bands", "ids", "score"]

PASSAGE = " ".join(f"passage{i} word{i % 7}" for i in range(40))
BASE = " ".join(f"plain{i}" for i in range(120))


def words(text):
    table = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return WORD.findall((text or "").translate(table))


def texts():
    """(doc_id, text) pairs."""
    rows = [
        (None, "no id here"), (None, "no id here"), (None, None), (1, None), (2, ""),
        (3, "\n\n"), (4, "  \t "), (5, "Ünïcode É ſ K \U0001F600 é"), (6, "!!! ???"),
        (7, "one"), (8, "a b c d"), (9, "x" * 30_000), (10, "ab " * 12_000),
        (11, BASE), (12, BASE), (12, BASE), (13, BASE.upper()), (14, BASE + " tail"),
        (15, BASE.replace("plain5 ", "other ")), (16, BASE.replace("plain90", "more")),
        (17, f"start {PASSAGE} end"), (18, f"Another {PASSAGE}, yes"), (19, PASSAGE),
        (20, "Licensed under the Apache License, Version 2.0.\nMIT License"),
        (21, "cc by cc by"), (22, "GNU General Public License v3 or later"),
    ]
    rows += [(100 + i, f"  Shared LINE \nown line {i}\n\nshared line\nx{i}") for i in range(12)]
    rows += [(200, "Shared Line"), (201, "é\n" * 3)]
    return rows


def documents(spark, rows=None):
    """With null cells and further columns whose names an operator might use."""
    rows = texts() if rows is None else rows
    fields = [("doc_id", T.LongType()), ("text", T.StringType()), ("lang", T.StringType()),
              ("source", T.StringType()), ("n_chars", T.LongType())]
    fields += [(name, T.StringType()) for name in CLASHING]
    schema = T.StructType([T.StructField(n, t) for n, t in fields])
    extra = [None if i % 2 else "x" for i in range(len(CLASHING))]
    data = [(i, t, None, "src0", None if t is None else len(t), *extra) for i, t in rows]
    return spark.createDataFrame(data, schema).repartition(3)
