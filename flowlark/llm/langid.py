"""Language identification by error-correcting output codes.

Each language has a codeword. One binary classifier per bit, linear in hashed character trigrams, tells the languages
with a 1 in that bit from those with a 0: its weights are log ratios of the two sides' smoothed trigram frequencies.
A text's margins are decoded by loss: each bit's logistic loss, weighted by how often that bit was right on training
texts of the language, adds up to the distance to a codeword. The nearest codeword wins; a runner-up that is nearly as
near flags the text as ambiguous.

Trigram counts and the bits' accuracies cover every training text of the ``LANGUAGES`` most frequent languages (sums per
language and bucket or bit, so nothing that grows with the input leaves the executors).
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import chunks, in_chunks
from .ngrams import grams, letters, per_text

BITS = 16
WIDTH = 3
CHUNK = 1 << 18
#: Languages up to which all distinct splits are used as bits; beyond, a fixed dense code.
EXHAUSTIVE = 6
#: A score gap to the runner-up below this is ambiguous.
AMBIGUOUS = 0.2
#: At most so many languages are learnt, the most frequent ones; it bounds what the driver holds.
LANGUAGES = 64
NO_LANGUAGE = "und"


@dataclass
class Model:
    langs: list[str]
    code: np.ndarray  # languages x bits, -1 and 1
    weights: np.ndarray  # buckets x bits
    trust: np.ndarray  # languages x bits, rows sum to 1


def codewords(n: int, seed: int = 7) -> np.ndarray:
    """Codewords of n languages as rows of -1 and 1; every column has both, no two columns split alike."""
    if n < 2:
        return np.ones((n, 0), np.int8)
    if n <= EXHAUSTIVE:
        columns = [(1, *rest) for rest in itertools.product((1, -1), repeat=n - 1) if -1 in rest]
        return np.array(columns, np.int8).T
    rng, want, columns = np.random.default_rng(seed), min(12 * int(np.ceil(np.log2(n))), 1 << (n - 2)), {}
    while len(columns) < want:
        c = rng.choice((-1, 1), n)
        if abs(c.sum()) <= max(3, n // 4):
            columns[tuple(c * c[0])] = c * c[0]
    return np.array(list(columns.values()), np.int8).T


def _margins(texts: list, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Each text's margins, and how many trigrams it has; a text with a letter has one at least."""
    codes, starts = letters(texts)
    places, h = grams(codes, WIDTH, BITS)
    first = per_text(places, starts)
    n = np.diff(first)
    out = np.zeros((len(texts), model.weights.shape[1]), np.float64)
    full = np.flatnonzero(n)
    if len(full) and out.shape[1]:
        # Texts of a chunk follow each other, so the sums between the full ones' starts are whole texts.
        out[full] = np.add.reduceat(model.weights[h], first[:-1][full], axis=0, dtype=np.float64)
        out[full] /= np.sqrt(n[full])[:, None]
    return out, n


def _decode(margins: np.ndarray, model: Model) -> np.ndarray:
    """Texts x languages: the share of each codeword, from its weighted loss."""
    z = np.clip(margins, -30, 30)
    loss = np.stack([(np.logaddexp(0, -z * model.code[k]) * model.trust[k]).sum(axis=1) for k in range(len(model.langs))], axis=1)
    p = np.exp(-(loss - loss.min(axis=1, keepdims=True)))
    return p / p.sum(axis=1, keepdims=True)


def fit(train: DataFrame, text_col: str = "text", lang_col: str = "lang", most: int = LANGUAGES) -> Model:
    """Learns from the rows with a language; rows without a text count for nothing. Of more than ``most`` languages those
    with the most rows are learnt, of equally many the first in the alphabet."""
    train = train.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")
    )
    frequent = [r["lang"] for r in train.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(most).collect()]
    train = train.where(F.col("lang").isin(frequent))

    def count(batches):
        sums: dict[str, np.ndarray] = {}
        rows: dict[str, int] = {}
        for part in chunks(batches, most=CHUNK):
            langs = part.column("lang").to_pylist()
            codes, starts = letters(part.column("text").to_pylist())
            places, h = grams(codes, WIDTH, BITS)
            of = np.searchsorted(starts, places, side="right") - 1
            names, which = np.unique(np.array(langs, object).astype(str), return_inverse=True)
            for k, name in enumerate(names.tolist()):
                sums[name] = sums.get(name, 0) + np.bincount(h[which[of] == k], minlength=1 << BITS)
                rows[name] = rows.get(name, 0) + int((which == k).sum())
        for name, total in sums.items():
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * (len(at) + 1), pa.string()), pa.array(np.append(at, -1), pa.int32()), pa.array(np.append(total[at], rows[name]), pa.int64())],
                ["lang", "bucket", "n"],
            )

    table = train.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(table["lang"].unique().tolist())
    counts = np.zeros((len(langs), 1 << BITS))
    table = table[table["bucket"] >= 0]
    counts[np.searchsorted(langs, table["lang"].to_numpy(str)) if langs else [], table["bucket"].to_numpy(int)] = table["n"].to_numpy(float)
    share = (counts + 0.5) / (counts + 0.5).sum(axis=1, keepdims=True)
    code = codewords(len(langs))
    sides = [(share[c > 0].mean(axis=0), share[c < 0].mean(axis=0)) for c in code.T]
    weights = np.stack([np.log(a) - np.log(b) for a, b in sides], axis=1).astype(np.float32) if sides else np.zeros((1 << BITS, 0), np.float32)
    model = Model(langs, code, weights, np.full(code.shape, 1 / max(1, code.shape[1])))
    if code.shape[1]:
        model.trust = _trust(train, model)
    return model


def _trust(train: DataFrame, model: Model) -> np.ndarray:
    held = train.sparkSession.sparkContext.broadcast(model)

    def right(batches):
        m = held.value
        for part in chunks(batches, most=CHUNK):
            margins, n = _margins(part.column("text").to_pylist(), m)
            lang = np.searchsorted(m.langs, part.column("lang").to_pylist())
            hit = (margins * m.code[lang] > 0) & (n > 0)[:, None]
            for k in np.unique(lang[n > 0]).tolist():
                mine = (lang == k) & (n > 0)
                for b in range(m.code.shape[1]):
                    yield pa.RecordBatch.from_pydict({"k": [k], "b": [b], "n": [int(mine.sum())], "hits": [int(hit[mine, b].sum())]})

    rows = train.mapInArrow(right, "k long, b long, n long, hits long").groupBy("k", "b").agg(F.sum("n").alias("n"), F.sum("hits").alias("hits")).toPandas()
    rate = np.full(model.code.shape, 0.5)
    rate[rows["k"], rows["b"]] = (rows["hits"] + 1) / (rows["n"] + 2)
    return rate / rate.sum(axis=1, keepdims=True)


def share_column(spark, model: Model, text: Column) -> Column:
    """The nearest codeword's share as a column, null where the language is ``und`` (null, empty and letterless texts); for
    filters. Very long texts are read whole, repeated rows each; an empty table stays empty."""
    held = spark.sparkContext.broadcast(model)

    def share(texts: list) -> np.ndarray:
        m = held.value
        margins, n = _margins(texts, m)
        return np.where((n > 0) & bool(m.langs), _decode(margins, m).max(axis=1) if m.langs else 0.0, np.nan)

    @F.arrow_udf("double")
    def shared(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array(in_chunks(share, texts, CHUNK))

    return F.nanvl(shared(text), F.lit(None))


def identify(df: DataFrame, model: Model, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Per row: the id, lang_pred, score (0 to 1), runner_up, ambiguous.

    ``und`` with score 0 for null, empty and letterless texts, and for all if no language was learnt; with a single
    language every text with a letter is that language's. Equal texts get equal results; ties go to the language first
    in the alphabet. Very long texts are read whole. Repeated ids are rows of their own; an empty table gives no rows;
    other columns are not read.
    """
    held = df.sparkSession.sparkContext.broadcast(model)
    src = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = src.schema["doc_id"].dataType.simpleString()

    def predict(batches):
        m = held.value
        names = np.array([*m.langs, NO_LANGUAGE], object)
        for part in chunks(batches, most=CHUNK):
            margins, n = _margins(part.column("text").to_pylist(), m)
            known = (n > 0) & bool(m.langs)
            p = _decode(margins, m) if m.langs else np.zeros((len(n), 1))
            order = np.argsort(-p, axis=1, kind="stable")
            first = np.where(known, order[:, 0], len(m.langs))
            second = np.where(known & (len(m.langs) > 1), order[:, min(1, order.shape[1] - 1)], len(m.langs))
            top, next_ = (np.take_along_axis(p, np.minimum(x, p.shape[1] - 1)[:, None], 1)[:, 0] for x in (first, second))
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id"),
                    pa.array(names[first], pa.string()),
                    pa.array(np.where(known, top, 0.0), pa.float64()),
                    pa.array(names[second], pa.string()),
                    pa.array(known & (len(m.langs) > 1) & (top - next_ < AMBIGUOUS)),
                ],
                ["doc_id", "lang_pred", "score", "runner_up", "ambiguous"],
            )

    return src.mapInArrow(predict, f"doc_id {kind}, lang_pred string, score double, runner_up string, ambiguous boolean")
