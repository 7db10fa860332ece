"""Quality rules (operator 9): text statistics and robust multivariate outliers.

:func:`text_statistics` counts words, symbols, repeated lines and repeated
word windows of every whole text.  :func:`quality_verdicts` rejects rows that
fail a base rule or whose transformed statistic vector lies far from the
minimum-covariance-determinant (MCD) estimate of its language and source.

The estimate is computed by Spark aggregates only.  Vectors are fixed-point
integers, so sums are exact and reruns agree.  A concentration step takes for
each cell the rows with the smallest Mahalanobis distances: distances fall
into fine bins, one aggregation sums counts and moments per (cell, start,
bin), and the bins up to the wanted share give the next mean and covariance.
A cell with a third of all rows is therefore summed map-side like any other,
and what meets in one group is at most ``BINS`` rows of sums per start.

Cells: a (language, source) pair with at least ``min_rows`` rows; smaller
pairs are pooled per language, and where that pool is small too, in one pool
of the rest.  Rows of a rest that is still too small are judged by an estimate
over all rows of the table; a table under ``min_rows`` rows has no estimate.

Special cases: null text has zero counts and fails the base rule (fewer than
10 words), null language or source is a value of its own, repeated rows are
judged each alike, an empty table gives an empty result.  Input columns other
than those read are not carried.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recentlake.llm.common import (
    SPACE_BYTES, byte_set, per_row, random64, run_hashes, runs, saved, text_blocks, windows,
)

SYMBOLS = b"#*$%&|<>"
WINDOW_WORDS = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20

#: Fixed-point steps of a transformed statistic.
SCALE = 1024
#: Smallest standard deviation of each transformed statistic that counts: the
#: share of words, of symbols, repeated lines and repeated windows are exactly
#: constant in many cells, where any covariance would be singular.
FLOORS = (0.30, 0.045, 0.40, 0.45, 0.45)
P = len(FLOORS)
#: Share of a cell's rows that the estimate must cover, and its smallest size.
SUBSET_SHARE = 0.75
MIN_ROWS = 60
#: The cell of rows that are judged by all rows.
ALL = "all"
STEPS = 4
#: Squared robust distance above which a row is rejected.
CUT = 60.0
#: Bins of the squared distance: 16 to a factor of two.
BINS_PER_OCTAVE, BINS = 16, 640
#: Median of the chi-squared distribution with P degrees of freedom.
CHI2_MEDIAN = P * (1 - 2 / (9 * P)) ** 3

STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_NOT_NEWLINE = byte_set(b"\n")
_IS_SYMBOL = byte_set(SYMBOLS)


def count_block(data: np.ndarray, offs: np.ndarray) -> list[np.ndarray]:
    """The five statistics of each row of a block, in the order of STATS."""
    starts, ends, firsts = runs(data, offs)
    n_words = np.diff(firsts)
    row_of_word = np.repeat(np.arange(len(n_words)), n_words)
    chars = per_row(((data & 0xC0) != 0x80) & ~SPACE_BYTES[data], offs)
    symbols = per_row(_IS_SYMBOL[data], offs)

    line_starts, line_ends, line_firsts = runs(data, offs, _NOT_NEWLINE)
    has_word = np.searchsorted(starts, line_starts) < np.searchsorted(starts, line_ends)
    line_rows = np.repeat(np.arange(len(n_words)), np.diff(line_firsts))
    salt = random64(len(n_words), 5)
    keys = (run_hashes(data, line_starts, line_ends) ^ salt[line_rows])[has_word]
    _, first_at = np.unique(keys, return_index=True)
    again = np.ones(len(keys), bool)
    again[first_at] = False
    dup_lines = np.bincount(line_rows[has_word][again], minlength=len(n_words))

    keys, ok = windows(run_hashes(data, starts, ends), firsts, WINDOW_WORDS)
    at = np.flatnonzero(ok)
    keys = keys[at] ^ salt[row_of_word[at]]
    order = np.argsort(keys)
    keys = keys[order]
    same = np.zeros(len(keys), bool)
    if len(keys):
        equal = keys[1:] == keys[:-1]
        same[1:] |= equal
        same[:-1] |= equal
    marks = np.zeros(len(starts) + WINDOW_WORDS + 1, np.int64)
    twice = at[order[same]]
    np.add.at(marks, twice, 1)
    np.add.at(marks, twice + WINDOW_WORDS, -1)
    covered = np.cumsum(marks)[:len(starts)] > 0
    return [n_words, chars, symbols, dup_lines, per_row(covered, firsts)]


def text_statistics(docs: DataFrame, keys: tuple[str, ...] = ("doc_id", "lang", "source")) -> DataFrame:
    """``keys`` and the five statistics of every row's whole text."""
    picked = docs.select(*keys, F.col("text").cast("string").alias("text"))
    schema = ", ".join([*(f"`{k}` {dict(picked.dtypes)[k]}" for k in keys), *(f"{s} bigint" for s in STATS)])

    def measure(batches):
        for batch in batches:
            parts = [count_block(data, offs) for _, _, data, offs in text_blocks(batch.column("text"))]
            columns = [np.concatenate(c) if c else np.zeros(0, np.int64) for c in zip(*parts, strict=True)] \
                if parts else [np.zeros(0, np.int64)] * len(STATS)
            yield pa.RecordBatch.from_arrays(
                [batch.column(k) for k in keys] + [pa.array(c, pa.int64()) for c in columns], [*keys, *STATS])

    return picked.mapInArrow(measure, schema)


def vector_columns() -> list:
    """The transformed statistics as fixed-point integers."""
    words = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    chars = F.greatest(F.col("word_chars"), F.lit(1)).cast("double")
    values = [
        F.log1p(F.col("n_words").cast("double")),
        F.log(chars / words),
        F.log1p(200.0 * F.col("n_symbols") / chars),
        F.log1p(200.0 * F.col("n_dup_lines") / words),
        F.log1p(20.0 * F.col("n_repeat_words") / words),
    ]
    return [F.round(v * SCALE).cast("long").alias(f"x{i}") for i, v in enumerate(values)]


def base_failed_column():
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def with_cells(stats: DataFrame, min_rows: int) -> DataFrame:
    """Adds ``cell``: the pair, the language, the small pools' rest or, for
    what is still too small, ``ALL`` rows; null in a table under ``min_rows``.

    The counts have one row per language and source; they come back by joins
    on that key, which Spark broadcasts or splits by measured size.
    """
    pair = F.struct("lang", "source")
    sizes = stats.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("__n"))
    small = F.col("__n") < min_rows
    by_lang = sizes.where(small).groupBy(F.col("lang").alias("__lang")).agg(F.sum("__n").alias("__nl"))
    pooled = sizes.join(by_lang, F.col("lang").eqNullSafe(F.col("__lang")), "left").withColumn("__one", F.lit(1))
    rest = pooled.where(small & (F.col("__nl") < min_rows)).groupBy("__one").agg(F.sum("__n").alias("__nr"))
    whole = sizes.groupBy(F.lit(1).alias("__one")).agg(F.sum("__n").alias("__na"))
    cells = pooled.join(rest, "__one", "left").join(whole, "__one", "left").select(
        F.col("lang").alias("__l"), F.col("source").alias("__s"),
        F.when(~small, F.concat(F.lit("pair "), F.to_json(pair)))
        .when(F.col("__nl") >= min_rows, F.concat(F.lit("language "), F.to_json(F.struct("lang"))))
        .when(F.col("__nr") >= min_rows, F.lit("rest"))
        .when(F.col("__na") >= min_rows, F.lit(ALL)).alias("cell"))
    return stats.join(cells, F.col("lang").eqNullSafe(F.col("__l")) & F.col("source").eqNullSafe(F.col("__s")), "left") \
        .drop("__l", "__s")


def _distance():
    """Squared Mahalanobis distance by an estimate's mean ``mu`` and precision ``prec``."""
    gap = [F.col(f"x{i}") / F.lit(float(SCALE)) - F.col("mu")[i] for i in range(P)]
    total = F.lit(0.0)
    for i in range(P):
        for j in range(i, P):
            total = total + gap[i] * gap[j] * F.col("prec")[i * P + j] * F.lit(1.0 if i == j else 2.0)
    return F.greatest(total, F.lit(0.0))


def _bin(distance):
    return F.least(F.floor(F.log2(1.0 + distance) * BINS_PER_OCTAVE), F.lit(BINS - 1)).cast("int")


_ESTIMATE = "cell string, start int, n long, mu array<double>, prec array<double>, logdet double"


def _estimate(n: float, mean: np.ndarray, cov: np.ndarray, scale: float = 1.0) -> tuple:
    """An estimate with the covariance kept above FLOORS in every direction:
    in units of the floors no eigenvalue is under one."""
    floor = np.array(FLOORS)
    unit = cov * scale / np.outer(floor, floor)
    w, v = np.linalg.eigh((unit + unit.T) / 2)
    w = np.maximum(w, 1.0)
    prec = (v / w) @ v.T / np.outer(floor, floor)
    return int(n), mean.tolist(), prec.ravel().tolist(), float(np.log(w).sum())


def _first_estimates(key, frame: pd.DataFrame) -> pd.DataFrame:
    """Two starts of a cell, from its value counts: median and MAD; midpoint
    and half width of the shortest half."""
    medians, mads, mids, halves, n = [], [], [], [], 0
    for i in range(P):
        part = frame[frame["dim"] == i].sort_values("value")
        values, counts = part["value"].to_numpy(float) / SCALE, part["n"].to_numpy(np.int64)
        total = np.cumsum(counts)
        n = int(total[-1])
        median = values[np.searchsorted(total, (n + 1) // 2)]
        gaps = np.abs(values - median)
        order = np.argsort(gaps, kind="stable")
        mad = gaps[order][np.searchsorted(np.cumsum(counts[order]), (n + 1) // 2)]
        upto = np.searchsorted(total, total - counts + (n + 1) // 2)
        ok = upto < len(values)
        widths = values[upto[ok]] - values[ok]
        k = int(np.argmin(widths))
        medians.append(median)
        mads.append(1.4826 * mad)
        mids.append((values[ok][k] + values[upto[ok]][k]) / 2)
        halves.append(1.4826 * widths[k] / 2)
    rows = [(key[0], s, *_estimate(n, np.array(m), np.diag(np.square(w))))
            for s, (m, w) in enumerate(((medians, mads), (mids, halves)))]
    return pd.DataFrame(rows, columns=["cell", "start", "n", "mu", "prec", "logdet"])


def _next_estimates(share: float, final: bool):
    def step(key, frame: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for start, part in frame.sort_values("bin").groupby("start"):
            counts = part["n"].to_numpy(np.int64)
            total = np.cumsum(counts)
            n = int(total[-1])
            k = int(np.searchsorted(total, int(np.ceil(share * n)))) + 1
            m = float(total[k - 1])
            mean = np.array([sum(map(int, part[f"s{i}"][:k])) for i in range(P)], float) / m
            cov = np.zeros((P, P))
            for i in range(P):
                for j in range(i, P):
                    cov[i, j] = cov[j, i] = sum(map(int, part[f"s{i}{j}"][:k])) / m - mean[i] * mean[j]
            scale = 1.0
            if final:  # the subset is too narrow: make the median distance that of the normal law
                middle = 2.0 ** ((part["bin"].to_numpy()[np.searchsorted(total, (n + 1) // 2)] + 0.5) / BINS_PER_OCTAVE) - 1
                scale = max(1.0, middle / CHI2_MEDIAN)
            rows.append((key[0], int(start), *_estimate(n, mean / SCALE, cov / SCALE ** 2, scale)))
        if final:
            rows = [min(rows, key=lambda r: (r[5], r[1]))]
        return pd.DataFrame(rows, columns=["cell", "start", "n", "mu", "prec", "logdet"])

    return step


def mcd_estimates(vectors: DataFrame, steps: int = STEPS, share: float = SUBSET_SHARE) -> DataFrame:
    """One MCD estimate for each ``cell`` of ``vectors`` (cell, x0..x4)."""
    placed = vectors.where(F.col("cell").isNotNull())
    values = F.explode(F.array(*(F.struct(F.lit(i).alias("dim"), F.col(f"x{i}").alias("value")) for i in range(P))))
    counts = placed.select("cell", values.alias("v")).groupBy("cell", "v.dim", "v.value") \
        .agg(F.count(F.lit(1)).alias("n")).toDF("cell", "dim", "value", "n")
    estimates = saved(counts.groupBy("cell").applyInPandas(_first_estimates, _ESTIMATE), "mcd")
    for k in range(steps):
        binned = placed.join(estimates, "cell").withColumn("bin", _bin(_distance()))
        sums = [F.count(F.lit(1)).alias("n"), *(F.sum(f"x{i}").alias(f"s{i}") for i in range(P)),
                *(F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"s{i}{j}") for i in range(P) for j in range(i, P))]
        bins = binned.groupBy("cell", "start", "bin").agg(*sums)
        estimates = saved(bins.groupBy("cell").applyInPandas(_next_estimates(share, k == steps - 1), _ESTIMATE), "mcd")
    return estimates


def quality_verdicts(docs: DataFrame, min_rows: int = MIN_ROWS, cut: float = CUT, extra: tuple[str, ...] = ()) -> DataFrame:
    """Every row's statistics, ``base_failed``, ``distance`` and ``kept``."""
    keys = ("doc_id", "lang", "source", *extra)
    stats = text_statistics(docs, keys)
    vectors = saved(stats.select("*", base_failed_column().alias("base_failed"), *vector_columns()), "statistics")
    vectors = with_cells(vectors, min_rows)
    best = mcd_estimates(vectors.where(F.col("cell") != ALL)).select("cell", "mu", "prec")
    if vectors.where(F.col("cell") == ALL).limit(1).count():
        best = best.unionByName(mcd_estimates(vectors.withColumn("cell", F.lit(ALL))).select("cell", "mu", "prec"))
    return vectors.join(best, "cell", "left").withColumn("distance", _distance()).select(
        "doc_id", *extra, *STATS, "base_failed", "cell", "distance",
        F.when(F.col("base_failed"), F.lit(False)).otherwise(F.coalesce(F.col("distance") <= cut, F.lit(True))).alias("kept"))


def kept_documents(docs: DataFrame, min_rows: int = MIN_ROWS, cut: float = CUT) -> DataFrame:
    """The rows of ``docs`` that no rule rejects, unchanged."""
    key = F.xxhash64("lang", "source", "text")
    keyed = docs.withColumn("__key", key)
    gone = quality_verdicts(keyed, min_rows, cut, extra=("__key",)).where(~F.col("kept")) \
        .select(F.col("doc_id").alias("__d"), F.col("__key").alias("__k")).distinct()
    return keyed.join(gone, F.col("doc_id").eqNullSafe(F.col("__d")) & (F.col("__key") == F.col("__k")), "left_anti").drop("__key")
