"""Operator 8: quality classifier by regularised quadratic discriminant analysis.

Every document becomes a few transformed statistics of its text. Class means and covariances
come from sums that Spark adds up; each covariance is shrunk towards the pooled one and towards
its own diagonal. A score is the difference of two Mahalanobis log-densities, from Cholesky
factors computed once.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegate.llm.arrow import map_blocks
from tidegate.session import cut_lineage

#: Weights of the pooled covariance and of the diagonal, and the least variance.
TOWARDS_POOLED, TOWARDS_DIAGONAL, LEAST_VARIANCE = 0.6, 0.1, 1e-4
#: Log-density differences are divided by this before the logistic function, which keeps
#: scores apart that would else all be 0 or 1; the sign, and so the prediction, stays.
TEMPERATURE = 4.0

WHITE = np.zeros(256, dtype=bool)
WHITE[[9, 10, 11, 12, 13, 32]] = True
UPPER = np.zeros(256, dtype=bool)
UPPER[65:91] = True
DIGIT = np.zeros(256, dtype=bool)
DIGIT[48:58] = True
LETTER = np.zeros(256, dtype=bool)
LETTER[65:91] = LETTER[97:123] = LETTER[128:] = True
STOP = np.zeros(256, dtype=bool)
STOP[[ord(c) for c in ".,;:"]] = True
SYMBOL = ~(WHITE | DIGIT | LETTER | STOP)
STATISTICS = (
    "words", "word_length", "upper", "digits", "symbols", "stops", "repeats", "distinct",
    "lines", "symbol_words", "long_words",
)


def statistics(text: str | None) -> list[float]:
    """Transformed statistics; a null or empty text has zeros.

    Shares go through a square root and counts through a logarithm, which brings skewed
    distributions nearer to normal ones.
    """
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    if not words:
        return [0.0] * len(STATISTICS)
    count = np.bincount(np.frombuffer(raw, dtype=np.uint8), minlength=256)
    visible, letters, n = count[~WHITE].sum(), max(1, count[LETTER].sum()), len(words)
    share = lambda mask, of: float(np.sqrt(count[mask].sum() / of))
    repeats = sum(map(bytes.__eq__, words, words[1:]))
    return [
        float(np.log1p(n)), float(np.log(visible / n)), share(UPPER, letters), share(DIGIT, visible),
        share(SYMBOL, visible), share(STOP, visible), float(np.sqrt(repeats / n)),
        # distinct words follow a power of the length, so their exponent does not depend on it
        float(np.log(len(set(words))) / np.log(n)) if n > 1 else 1.0,
        float(np.sqrt((raw.count(b"\n") + 1) / n)),
        float(np.sqrt(sum(not w.isalnum() and SYMBOL[w[-1]] for w in words) / n)),
        float(np.sqrt(sum(len(w) > 24 for w in words) / n)),
    ]


def document_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id_col, stats array<double>)`` of every whole text; other columns are not read."""
    key = docs.schema[id_col].dataType.simpleString()

    def make():
        return lambda keys, texts: {"k": keys, "stats": [statistics(t) for t in texts]}

    out = map_blocks(docs.select(F.col(id_col), F.col(text_col)), f"k {key}, stats array<double>", make)
    return out.withColumnRenamed("k", id_col)


@dataclass(frozen=True)
class Discriminant:
    """Two classes: log priors, means, inverse Cholesky factors and log determinants."""

    parts: tuple[tuple[float, np.ndarray, np.ndarray, float], ...] | None
    #: The score of every document where a class has too few rows to have a covariance.
    constant: float = 0.5

    def scores(self, stats: np.ndarray) -> np.ndarray:
        """From 0 to 1, higher where label 1 is likelier."""
        if self.parts is None:
            return np.full(len(stats), self.constant)
        logs = [
            prior - 0.5 * (((stats - mean) @ inverse.T) ** 2).sum(axis=1) - 0.5 * logdet
            for prior, mean, inverse, logdet in self.parts
        ]
        return 1.0 / (1.0 + np.exp(-np.clip((logs[1] - logs[0]) / TEMPERATURE, -500, 500)))


def fold_of(id_column: Column) -> Column:
    """crc32 of the identifier as text, modulo 3; a null identifier counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(id_column.cast("string"), F.lit(""))), F.lit(3))


def fit(stats: DataFrame, labels: DataFrame, id_col: str = "doc_id") -> Discriminant:
    """Learn from labelled documents outside fold 1; all of them, by sums.

    Rows without a quality of 0 or 1 do not count; of several labels of a document the largest
    does. With fewer than two documents of a class the score is a constant, the share of label
    1 among the labelled (one half if there are none).
    """
    marked = (
        labels.select(F.col(id_col).alias("labelled_id"), F.col("quality").alias("mark"))
        .where("mark in (0, 1)").groupBy("labelled_id").agg(F.max("mark").alias("mark"))
    )
    rows = (
        stats.where(fold_of(F.col(id_col)) != 1)
        .join(marked, F.col(id_col) == F.col("labelled_id"))
    )
    d = len(STATISTICS)
    pairs = [(i, j) for i in range(d) for j in range(i, d)]
    at = lambda i: F.element_at("stats", i + 1)
    sums = rows.groupBy("mark").agg(
        F.count(F.lit(1)).alias("n"),
        *[F.sum(at(i)).alias(f"s{i}") for i in range(d)],
        *[F.sum(at(i) * at(j)).alias(f"p{i}_{j}") for i, j in pairs],
    ).collect()  # two rows
    by_mark = {row["mark"]: row for row in sums}
    n = {m: by_mark[m]["n"] if m in by_mark else 0 for m in (0, 1)}
    if min(n.values()) < 2:
        return Discriminant(None, n[1] / sum(n.values()) if sum(n.values()) else 0.5)
    means, scatters = {}, {}
    for m, row in by_mark.items():
        means[m] = np.array([row[f"s{i}"] for i in range(d)]) / n[m]
        products = np.zeros((d, d))
        for i, j in pairs:
            products[i, j] = products[j, i] = row[f"p{i}_{j}"]
        scatters[m] = products - n[m] * np.outer(means[m], means[m])
    total = sum(n.values())
    pooled = (scatters[0] + scatters[1]) / (total - 2)
    parts = []
    for m in (0, 1):
        shrunk = (1 - TOWARDS_POOLED) * scatters[m] / (n[m] - 1) + TOWARDS_POOLED * pooled
        shrunk = (1 - TOWARDS_DIAGONAL) * shrunk + TOWARDS_DIAGONAL * np.diag(np.diag(shrunk))
        factor = np.linalg.cholesky(shrunk + LEAST_VARIANCE * np.eye(d))
        parts.append((
            float(np.log(n[m] / total)), means[m], np.linalg.inv(factor),
            2 * float(np.log(np.diag(factor)).sum()),
        ))
    return Discriminant(tuple(parts))


def score(stats: DataFrame, model: Discriminant, id_col: str = "doc_id") -> DataFrame:
    """``(id_col, score double)`` of every row of ``document_statistics``."""
    key = stats.schema[id_col].dataType.simpleString()

    def make():
        return lambda keys, rows: {"k": keys, "score": model.scores(np.array(rows, dtype=float)).tolist()}

    return map_blocks(stats.select(id_col, "stats"), f"k {key}, score double", make, 4096).withColumnRenamed("k", id_col)


def score_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fit on ``labels`` and score every document: ``(id_col, held_out, score, predicted int)``."""
    stats = cut_lineage(document_statistics(docs, id_col, text_col))
    return score(stats, fit(stats, labels, id_col), id_col).select(
        id_col, (fold_of(F.col(id_col)) == 1).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` with a score of one half or more, with their columns."""
    stats = cut_lineage(document_statistics(docs, id_col, text_col))
    model = fit(stats, labels, id_col)
    names = [f"c{i}" for i in range(len(docs.columns))]
    text = names[docs.columns.index(text_col)]
    ddl = ", ".join(f"{n} {f.dataType.simpleString()}" for n, f in zip(names, docs.schema))

    def make():
        def run(*columns):
            values = dict(zip(names, columns))
            keep = model.scores(np.array([statistics(t) for t in values[text]], dtype=float)) >= 0.5
            return {n: [v for v, k in zip(column, keep) if k] for n, column in values.items()}

        return run

    return map_blocks(docs.toDF(*names), ddl, make).toDF(*docs.columns)
