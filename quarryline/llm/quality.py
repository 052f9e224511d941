"""Quality rules with a robust multivariate outlier test per language and source.

Each text becomes a vector of transformed statistics. For every (language, source) group the minimum-covariance-determinant
estimate is found by concentration steps: mean and covariance of the ``SUPPORT`` share of rows with the smallest distances,
distances from these, and so on. Three starts are concentrated: from the medians with usual spreads, from the medians with the group's own median
deviations, and from the mean and covariance of all rows. The one whose covariance has the smallest determinant is concentrated further, and a last step takes all
rows within its 97.5 % ellipsoid. Every step is a grouped
aggregate of sums, so a source with a third of all rows is pre-aggregated in every task; medians and the limits of the nearest rows come from counts of
values in fine steps (``VALUE_STEP``, and ``LIMITS_PER_DOUBLING`` of a distance), so results do not depend on how rows are dealt.

Groups under ``MIN_GROUP`` texts that pass the base rules use the estimate of all such groups of their language together: with seven statistics, fewer rows
give no estimate of their own. A group that grows to ``MIN_GROUP`` is from then on judged by itself. A spread below the least one of its statistic, which is about what
one more symbol, mark or repetition makes in a text of ``MIN_WORDS`` words, is raised to it, so that a group in which a statistic never varies does not reject
the first text in which it does.

Null texts have no words and fail the base rules. Null languages and sources are groups of their own; a table without one of these columns is judged as if it were null
everywhere. Further columns do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarryline.llm.batches import flat_bytes, slices, text_rows
from quarryline.session import shared_dir, write_through

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
SUPPORT = 0.75
#: Concentration steps of every start, and of the best one after that.
STEPS, LAST_STEPS = 2, 2
VALUE_STEP = 0.001
LIMITS_PER_DOUBLING = 512
MIN_GROUP = 60
SALTS = 64
#: Transformed statistics and the least spread of each; larger spreads stay as they are.
FLOORS = {"log_words": 0.1, "word_length": 0.05, "symbols": 0.25, "dup_lines": 0.7, "repeats": 0.05, "upper": 0.02, "marks": 0.03}
#: Spreads of the first distances, from the medians.
START = {"log_words": 0.6, "word_length": 0.25, "symbols": 0.5, "dup_lines": 0.8, "repeats": 0.12, "upper": 0.08, "marks": 0.08}
#: Chi-square quantiles of the verdict and of the rows that the last estimate takes.
CUTOFF_P, REWEIGHT_P = 0.999, 0.975
BLANKS = b" \t\n\x0b\x0c\r"
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_marks"]


def chi2_quantile(p: float, dims: int) -> float:
    """Wilson and Hilferty's approximation."""
    from statistics import NormalDist

    c = 2 / (9 * dims)
    return dims * (1 - c + NormalDist().inv_cdf(p) * c**0.5) ** 3


def _table(chars: bytes) -> np.ndarray:
    out = np.zeros(256, np.int64)
    out[list(chars)] = 1
    return out


_BLANK, _SYMBOL, _UPPER, _MARK = _table(BLANKS), _table(b"#*$%&|<>"), _table(bytes(range(65, 91))), _table(b"!?#*$%&|<>")
_CODE_POINT = np.array([(b & 0xC0) != 0x80 for b in range(256)], np.int64)


def repeated_words(words: list[list[bytes]]) -> np.ndarray:
    """Per text, the words that lie in a 3-word window found twice or more in that text."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes)
    flat = pa.array([w for ws in words for w in ws], pa.binary()).dictionary_encode()
    ids = flat.indices.to_numpy().astype(np.uint64)
    if len(ids) < 3:
        return np.zeros(len(words), np.int64)
    doc = np.repeat(np.arange(len(words), dtype=np.uint64), sizes)
    at = np.flatnonzero(doc[2:] == doc[:-2])
    key = np.uint64(0)
    for part in (ids[at], ids[at + 1], ids[at + 2], doc[at]):
        key = (key ^ part) * np.uint64(0x9E3779B97F4A7C15)
        key = key ^ (key >> np.uint64(29))
    order = np.argsort(key, kind="stable")
    same = np.concatenate([[False], key[order][1:] == key[order][:-1], [False]])
    twice = at[order[same[1:] | same[:-1]]]
    change = np.zeros(len(ids) + 1, np.int64)
    np.add.at(change, twice, 1)
    np.add.at(change, twice + 3, -1)
    covered = np.concatenate([[0], np.cumsum(np.cumsum(change[:-1]) > 0)])
    return covered[ends] - covered[ends - sizes]


def text_counts(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``lang``, ``source`` and the counts of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            column = batch.column("text")
            data, ends = flat_bytes(column)
            texts = column.to_pylist()

            def total(table: np.ndarray, data=data, ends=ends) -> np.ndarray:
                return np.diff(np.concatenate([[0], np.cumsum(table[data])])[ends])

            words = [t.split() for t in texts]
            lines = [[x for x in t.split(b"\n") if x.strip(BLANKS)] for t in texts]
            counts = [
                np.fromiter(map(len, words), np.int64, len(words)),
                total(_CODE_POINT) - total(_BLANK),
                total(_SYMBOL),
                np.array([len(x) - len(set(x)) for x in lines], np.int64),
                repeated_words(words),
                np.fromiter(map(len, lines), np.int64, len(lines)),
                total(_UPPER),
                total(_MARK),
            ]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("doc_id", "lang", "source")] + [pa.array(c) for c in counts], names=["doc_id", "lang", "source", *COUNTS])

    own = {c.lower() for c in docs.columns}
    rows = text_rows(docs, *((F.col(c) if c in own else F.lit(None)).cast("string").alias(c) for c in ("lang", "source")))
    return rows.mapInArrow(run, "doc_id long, lang string, source string, " + ", ".join(f"{c} long" for c in COUNTS))


def statistics(counts: DataFrame) -> DataFrame:
    """Adds ``base_failed`` and the transformed vector ``x``."""
    n = F.greatest("n_words", F.lit(1)).cast("double")
    vector = [
        F.log1p(F.col("n_words").cast("double")),
        F.col("word_chars") / n,
        F.log1p(100.0 * F.col("n_symbols") / n),
        F.log1p(100.0 * F.col("n_dup_lines") / F.greatest("n_lines", F.lit(1))),
        F.col("n_repeat_words") / n,
        F.sqrt(F.col("n_upper") / F.greatest("word_chars", F.lit(1))),
        F.sqrt(F.col("n_marks") / F.greatest("word_chars", F.lit(1))),
    ]
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return counts.withColumns({"base_failed": failed, "x": F.array(*vector)})


def _groups(rows: DataFrame) -> DataFrame:
    """``g``: the group whose estimate judges a row."""
    lang = F.coalesce(F.concat(F.lit("="), "lang"), F.lit("-"))
    own = F.concat_ws("|", lang, F.coalesce(F.concat(F.lit("="), "source"), F.lit("-")))
    rows = rows.withColumns({"own": own, "pool": lang})
    sizes = rows.filter(~F.col("base_failed")).groupBy("own").agg(F.count("*").alias("n_own"))
    large = sizes.filter(F.col("n_own") >= MIN_GROUP).select("own", F.lit(True).alias("large"))
    return _joined(rows, large, "own", "left").withColumn("g", F.when(F.col("large"), F.col("own")).otherwise(F.col("pool"))).drop("own", "pool", "large")


def _joined(rows: DataFrame, table: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """``rows`` with a table of one row per group; a group's rows are dealt to ``SALTS`` places by their id, as one may hold a third of all."""
    salted = rows.withColumn("__salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)))
    copies = table.withColumn("__salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    return salted.join(copies, [key, "__salt"], how).drop("__salt")


def _moments(rows: DataFrame, dims: int) -> DataFrame:
    """Count, sums and sums of products per group and start: all that a mean and a covariance need."""
    sums = [F.sum(F.col("x")[i]).alias(f"s{i}") for i in range(dims)]
    products = [F.sum(F.col("x")[i] * F.col("x")[j]).alias(f"p{i}_{j}") for i in range(dims) for j in range(i + 1)]
    return rows.groupBy("g", "k").agg(F.count("*").alias("n"), *sums, *products)


def _whitened(moments: DataFrame, floors: list[float], scale: float) -> DataFrame:
    """Per group and start the mean ``m``, the inverse Cholesky factor ``l`` (row by row) of the floored covariance and ``det``, the logarithm of its determinant."""
    d = len(floors)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:  # one row per group
            out = []
            for r in pdf.to_dict("records"):
                mean = np.array([r[f"s{i}"] for i in range(d)]) / r["n"]
                cov = np.zeros((d, d))
                for i in range(d):
                    for j in range(i + 1):
                        cov[i, j] = cov[j, i] = r[f"p{i}_{j}"] / r["n"] - mean[i] * mean[j]
                cov *= scale
                cov += np.diag(np.maximum(np.square(floors) - np.diag(cov), 0) + 1e-6 * np.square(floors))  # the last against rounding
                root = np.linalg.cholesky(cov)
                out.append((r["g"], r["k"], mean.tolist(), np.linalg.inv(root).ravel().tolist(), 2 * float(np.log(np.diag(root)).sum())))
            yield pd.DataFrame(out, columns=["g", "k", "m", "l", "det"])

    return moments.mapInPandas(run, "g string, k int, m array<double>, l array<double>, det double")


def _distance(d: int):
    """Squared Mahalanobis distance of ``x`` from ``m`` under ``l``, as one expression."""
    centred = [F.col("x")[i] - F.col("m")[i] for i in range(d)]
    total = F.lit(0.0)
    for i in range(d):
        row = sum((F.col("l")[i * d + j] * centred[j] for j in range(1, i + 1)), F.col("l")[i * d] * centred[0])
        total = total + row * row
    return total


def _share_value(counts: DataFrame, keys: list[str], value: str, share: float) -> DataFrame:
    """Per group the smallest value up to which ``share`` of the rows lie, from counts ``n`` per value."""
    upto = F.sum("n").over(Window.partitionBy(*keys).orderBy(value))
    total = F.sum("n").over(Window.partitionBy(*keys))
    reached = counts.select(*keys, value, (upto >= F.ceil(total * share)).alias("reached"))
    return reached.filter("reached").groupBy(*keys).agg(F.min(value).alias(value))


def _medians(rows: DataFrame, values: Column, dims: int) -> DataFrame:
    """Per group the array ``m`` of the medians of an array column, to ``VALUE_STEP``."""
    each = rows.select("g", F.posexplode(values).alias("i", "v"))
    counts = each.groupBy("g", "i", F.round(F.col("v") / VALUE_STEP).cast("long").alias("v")).agg(F.count("*").alias("n"))
    found = _share_value(counts, ["g", "i"], "v", 0.5)
    return found.groupBy("g").agg(*(F.max(F.when(F.col("i") == i, F.col("v") * VALUE_STEP)).alias(f"v{i}") for i in range(dims))).select("g", F.array(*(f"v{i}" for i in range(dims))).alias("m"))


def _starts(shaping: DataFrame, floors: list[float], start: list[float]) -> DataFrame:
    """The parameters (``g``, ``k``, ``m``, ``l``) of three first distances."""
    d = len(floors)
    spark = shaping.sparkSession
    centres = write_through(_medians(shaping, F.col("x"), d), shared_dir(spark))
    away = _joined(shaping, centres, "g").withColumn("a", F.array(*(F.abs(F.col("x")[i] - F.col("m")[i]) for i in range(d)))).drop("m")
    spread = _medians(away, F.col("a"), d).withColumnRenamed("m", "s")
    diagonal = lambda of: F.array(*(of(i) if i == j else F.lit(0.0) for i in range(d) for j in range(d)))
    usual = centres.select("g", F.lit(0).alias("k"), "m", diagonal(lambda i: F.lit(1 / start[i])).alias("l"))
    own = centres.join(spread, "g").select("g", F.lit(1).alias("k"), "m", diagonal(lambda i: 1 / F.greatest(F.col("s")[i] * 1.4826, F.lit(floors[i]))).alias("l"))
    every = _whitened(_moments(shaping.withColumn("k", F.lit(2)), d), floors, 1.0).select("g", "k", "m", "l")
    return write_through(usual.union(own).union(every), shared_dir(spark))


def outliers(rows: DataFrame, floors: list[float], start: list[float], support: float = SUPPORT, steps: int = STEPS, last_steps: int = LAST_STEPS) -> DataFrame:
    """``rows`` (``g``, ``x``, ``base_failed``) with ``distance``, the squared robust distance from its group.

    Only rows that pass the base rules shape the estimates. Groups without any have a null distance.
    """
    d = len(floors)
    spark = rows.sparkSession
    shaping = write_through(rows.filter(~F.col("base_failed")).select("doc_id", "g", "x"), shared_dir(spark))
    dist = _distance(d)
    consistency = lambda p: p / _chi2_share(chi2_quantile(p, d), d + 2)
    params = _starts(shaping, floors, start)

    def measured(params: DataFrame) -> DataFrame:
        packed = params.groupBy("g").agg(F.collect_list(F.struct("k", "m", "l")).alias("starts"))  # three of them at most
        each = _joined(shaping, packed, "g").select("doc_id", "g", "x", F.explode("starts").alias("s"))
        return each.select("doc_id", "g", "x", F.col("s.k").alias("k"), F.col("s.m").alias("m"), F.col("s.l").alias("l")).withColumn("q", dist).drop("m", "l")

    def concentrated(params: DataFrame) -> DataFrame:
        level = F.ceil(F.log2(F.greatest("q", F.lit(1e-9))) * LIMITS_PER_DOUBLING).cast("long")
        seen = measured(params).withColumn("level", level)
        limits = _share_value(seen.groupBy("g", "k", "level").agg(F.count("*").alias("n")), ["g", "k"], "level", support)
        packed = limits.groupBy("g").agg(F.map_from_entries(F.collect_list(F.struct("k", "level"))).alias("limit"))
        inside = _joined(seen, packed, "g").filter(F.col("level") <= F.col("limit")[F.col("k")])
        return write_through(_whitened(_moments(inside.select("g", "k", "x"), d), floors, consistency(support)), shared_dir(spark))

    for step in range(steps + last_steps):
        params = concentrated(params)
        if step == steps - 1:  # the smallest determinant, of equal ones the first start
            best = params.groupBy("g").agg(F.min_by(F.struct("k", "m", "l"), F.struct("det", "k")).alias("b"))
            params = write_through(best.select("g", "b.k", "b.m", "b.l"), shared_dir(spark))
    # Reweighting: all rows that are no outliers by the concentrated estimate.
    inside = measured(params).filter(F.col("q") <= chi2_quantile(REWEIGHT_P, d))
    params = write_through(_whitened(_moments(inside.select("g", "k", "x"), d), floors, consistency(REWEIGHT_P)), shared_dir(spark)).select("g", "m", "l")
    return _joined(rows, params, "g", "left").withColumn("distance", dist).drop("m", "l")


def _chi2_share(x: float, dims: int) -> float:
    """Distribution function by the inverse of the same approximation."""
    from statistics import NormalDist

    c = 2 / (9 * dims)
    return NormalDist().cdf(((x / dims) ** (1 / 3) - 1 + c) / c**0.5)


def judge(spark: SparkSession, docs: DataFrame, cutoff_p: float = CUTOFF_P) -> DataFrame:
    """Counts, ``base_failed``, ``distance`` and ``kept`` of every document."""
    rows = write_through(statistics(text_counts(docs)), shared_dir(spark))
    floors = list(FLOORS.values())
    measured = outliers(_groups(rows), floors, list(START.values()))
    near = F.coalesce(F.col("distance") <= chi2_quantile(cutoff_p, len(floors)), F.lit(True))
    return measured.withColumn("kept", ~F.col("base_failed") & near)
