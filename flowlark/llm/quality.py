"""Quality rules: one threshold table compiled into one Spark projection, without user functions.

The statistics of a text are arrays of its words and lines, so the whole operator is a narrow projection: no shuffle, no
Python. Thresholds are data (``RULES``); ``compile_rules`` turns them into a boolean column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A few very common words of the corpus' languages (fixed values).
STOP_WORDS = (
    "the of and to a in is that for on with as are this be an by from it",
    "der die das und ist von zu den mit ein eine auf im für dem nicht",
    "le la les de des du et un une est en que dans pour qui sur",
    "el la los las de del y en que un una es por con para se",
)
#: (statistic, least, most): a text is kept if each statistic lies within its bounds; None: no bound.
RULES = (
    ("mean_word_chars", 1.5, 30.0),
    ("symbol_ratio", None, 0.20),
    ("dup_line_ratio", None, 0.50),
    ("stop_ratio", 0.01, None),
)
SYMBOLS = "#*$%&|<>"
SPACE = " \t\n\u000b\f\r"


def statistics(df: DataFrame, text_col: str = "text", width: int = 5) -> DataFrame:
    """``df`` with the statistics of its texts (null: none) as columns; whatever the rules may refer to.

    ``n_repeat_words`` counts the words that lie in a run of ``width`` words found twice or more in the text, the first
    place included. Runs are compared by a 64-bit hash: sorted (hash, place) pairs put equal runs side by side, and the
    places with an equal neighbour, sorted again, cover ``width`` words each, less what the next place covers too.
    Columns of ``df`` whose names clash with a statistic's are replaced. Null and empty texts have zeros, very long ones are
    counted whole, repeated rows each; an empty table gives an empty one.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    stop = sorted({w for line in STOP_WORDS for w in line.split()})
    names = ("_words", "_lines", "_runs", "_next", "_places")
    words, lines, runs, near, places = (F.col(x) for x in names)
    n = F.size(words)
    spread = F.transform(
        F.sequence(F.lit(1), n - (width - 1)),
        lambda i: F.struct(F.xxhash64(*[F.get(words, i + (j - 1)) for j in range(width)]).alias("h"), i.alias("i")),
    )
    none = F.array().cast("array<struct<h:bigint,i:int>>")
    return (
        df.withColumns(
            {
                "_words": F.filter(F.split(text, "[\\x20\\x09-\\x0D]+"), lambda x: x != ""),
                "_lines": F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(SPACE)) != ""),
            }
        )
        .withColumns(
            {
                "n_words": n.cast("long"),
                "word_chars": F.length(F.translate(text, SPACE, "")).cast("long"),
                "n_symbols": (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long"),
                "n_lines": F.size(lines).cast("long"),
                "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
                "n_stop_words": F.size(F.filter(words, lambda x: F.lower(x).isin(stop))).cast("long"),
                "_runs": F.when(n > width, F.array_sort(spread)).otherwise(none),
            }
        )
        # _next[k]: does run k equal run k + 1 in the sorted order; the sentinel closes the list
        .withColumn(
            "_next",
            F.zip_with(
                runs,
                F.concat(F.slice(runs, 2, F.greatest(F.size(runs), F.lit(1))), none),
                lambda a, b: F.coalesce(a["h"] == b["h"], F.lit(False)),
            ),
        )
        .withColumn(
            "_places",
            F.sort_array(
                F.filter(
                    F.zip_with(
                        F.transform(runs, lambda x: x["i"]),
                        F.zip_with(near, F.concat(F.array(F.lit(False)), near), lambda a, b: F.coalesce(a, F.lit(False)) | b),
                        lambda i, hit: F.when(hit, i),
                    ),
                    lambda i: i.isNotNull(),
                )
            ),
        )
        .withColumn(
            "n_repeat_words",
            F.aggregate(
                F.zip_with(
                    places,
                    F.slice(places, 2, F.greatest(F.size(places), F.lit(1))),
                    lambda p, q: F.least(F.lit(width), F.coalesce(q - p, F.lit(width))),
                ),
                F.lit(0).cast("long"),
                lambda a, x: a + x,
            ),
        )
        .drop(*names)
    )


RATIOS = {
    "mean_word_chars": "try_divide(word_chars, n_words)",
    "symbol_ratio": "try_divide(n_symbols, word_chars)",
    "dup_line_ratio": "try_divide(n_dup_lines, n_lines)",
    "stop_ratio": "try_divide(n_stop_words, n_words)",
}


def compile_rules(rules=RULES) -> Column:
    """One boolean column from a threshold table of (statistic, least, most); a ratio without a base counts as 0."""
    verdict = F.lit(True)
    for name, least, most in rules:
        x = F.coalesce(F.expr(RATIOS.get(name, name)).cast("double"), F.lit(0.0))
        if least is not None:
            verdict = verdict & (x >= least)
        if most is not None:
            verdict = verdict & (x <= most)
    return verdict


def quality_rules(df: DataFrame, text_col: str = "text", rules=RULES) -> DataFrame:
    """``df`` with the statistics and ``base_failed`` and ``kept``.

    Null and empty texts have no words and fail; very long texts are judged whole; repeated rows and equal ids are judged
    each by its own text; an empty table gives an empty one; other columns pass through, except those named like a result, which are replaced.
    """
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return (
        statistics(df, text_col)
        .withColumn("base_failed", failed)
        .withColumn("kept", ~F.col("base_failed") & compile_rules(rules))
    )
