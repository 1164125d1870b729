"""Small documents with every awkward case, and plain versions of the definitions."""

import re
import zlib

from pyspark.sql import functions as F

PROSE = ("the river ran down past the old mill and over the stones where children used to play before the war came and took the "
         "young men away from their fields and their songs and left the mill wheel standing still in the water for many long years").split()
CLASHES = ("row", "n", "node", "at", "comp", "token", "key", "score", "held_out", "pii", "lang_pred", "spans", "word", "times", "place", "__pii", "__host")


def text(start, n):
    return " ".join(PROSE[(start * 7 + k * (1 + start % 5)) % len(PROSE)] + (str(start) if k % 9 == 0 else "") for k in range(n))


def documents(spark, rows, extra=True):
    """(doc_id, text[, lang]) rows with columns whose names clash with those the operators use."""
    full = [(*r, None)[:3] for r in rows]
    df = spark.createDataFrame(full, "doc_id long, text string, lang string")
    return df.withColumns({c: F.lit(f"own {c}") for c in CLASHES}) if extra else df


#: null and empty texts, blanks, a row without id, repeated rows, one id twice, a very long word, a very long text
AWKWARD = [(0, None), (1, ""), (2, " \n\t"), (None, text(1, 30)), (3, text(2, 40)), (3, text(2, 40)), (4, text(3, 12)), (4, text(4, 50)),
           (5, "x" * 30_000), (6, text(5, 9_000)), (7, "Ünï cödé 漢字 😀 a▁b\x00c"), (8, "one two three"), (9, "ONE two three"), (10, "!!! ... 42")]


def lower(s):
    return re.sub("[A-Z]", lambda m: m.group().lower(), s or "")


def blank_words(s):
    return re.findall(r"[^\x20\x09-\x0D]+", lower(s))


def bucket(doc_id, n):
    return 0 if doc_id is None else zlib.crc32(str(doc_id).encode()) % n


def tuples(df, *names):
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr)
