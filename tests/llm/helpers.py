"""Brute-force helpers shared by the operator tests."""

import hashlib
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
EDGE_TEXTS = [None, "", " \t\n", "one", "a b c d", "Ünïcödé wörds \u3000 here", "x " * 3000, "same line\nsame line\n\n  \nsame line", "#*$%&|<> # <", "\x00 nul \x00 nul", "end\u2028of\u0085line", "😀 emoji 😀 emoji"]


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def documents(spark, texts, **extra):
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


def save(df, folder, table):
    df.write.mode("overwrite").parquet(f"{folder}/{table}.parquet")
    return str(folder)


def twins(n=11):
    """Two words of 2**n letters over a and b, each the other with the letters exchanged: any polynomial in a base gives
    them one hash modulo 2**64."""
    s = "a"
    for _ in range(n):
        s += s.translate(str.maketrans("ab", "ba"))
    return s, s.translate(str.maketrans("ab", "ba"))
