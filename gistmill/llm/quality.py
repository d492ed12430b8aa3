"""Quality rules: base statistics and robust multivariate outliers.

Per language and source, the minimum covariance determinant (MCD) gives a
centre and scatter that a contaminated quarter of the documents cannot move; a
document whose transformed statistics lie too far from it, by Mahalanobis
distance, is rejected.

The fit covers all documents. From three starts per group (medians with median
absolute deviations, medians with the guards, plain mean and covariance)
concentration steps run until the determinant falls no more, and the smallest
one wins. A
step needs the covariance of the ``h`` documents nearest to the present centre:
distances go to a fixed logarithmic grid, each (group, grid cell) is summed with
map-side combine, and the cells up to the h-th document make the next estimate.
Statistics are held as integers (1/1024 steps), so that sums are exact and the
result does not depend on the order of rows. A group's cells are at most
``CELLS`` rows, so a group that holds a third of all documents is no larger a
task than another.

Every group has its own estimate, whatever its size. Centre and scatter are
shrunk towards the mean of those of the language's groups, with the weight of
``SHRINK`` documents, and these in turn towards the mean of all groups: large
groups decide by themselves, tiny ones by their language.

A statistic that is the same in nearly all documents has no spread of its own;
``GUARD`` is the least that is assumed. A document is rejected by a single
statistic where that is beyond about five spreads: with the guards, 27 % of
lines repeated, 17 % of words in repeated windows, 2.5 % of symbols, or words
29 % longer or shorter than usual.

Defined cases: null texts count as empty; null languages and sources are groups
of their own; repeated rows and ids each keep a row; texts are taken whole; an
empty table gives an empty table; other columns play no part.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gistmill.llm._util import cut, masked
from gistmill.llm.token_counts import _slices

SYMBOLS = "#*$%&|<>"
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
STEP = 1024
#: Least spread of each statistic, in its transformed unit.
GUARD = {"x_words": 0.25, "x_length": 0.05, "x_symbols": 0.03, "x_lines": 0.10, "x_repeats": 0.08}
X = tuple(GUARD)
P = len(X)
PAIRS = [(i, j) for i in range(P) for j in range(i, P)]
CELLS = 1024
#: Documents that the estimate of the next wider group counts for.
SHRINK = 50
#: Concentration steps at most; they nearly always end in far fewer.
STEPS = 30
#: 0.9999 quantile and median of chi-square with five degrees of freedom.
CHI2_CUT, CHI2_MEDIAN = 25.745, 4.351


def text_statistics(text: str | None) -> tuple[int, int, int, int, int]:
    """The five counts of BASE for one whole text."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()  # bytes: exactly space and \x09-\x0D
    n = len(words)
    chars = len(text) - sum(text.count(c) for c in " \t\n\x0b\x0c\r")
    symbols = sum(text.count(c) for c in SYMBOLS)
    lines = [x for x in raw.split(b"\n") if x and not x.isspace()]
    repeated = 0
    if n > 3:
        number: dict[bytes, int] = {}
        ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n)
        m = len(number)
        if m < 2_000_000:
            key = (ids[:-2] * m + ids[1:-1]) * m + ids[2:]
        else:
            pair = np.unique(ids[:-2] * m + ids[1:-1], return_inverse=True)[1]
            key = pair * m + ids[2:]
        order = np.argsort(key, kind="stable")
        same = key[order[1:]] == key[order[:-1]]
        twice = np.zeros(len(key) + 2, bool)
        at = np.concatenate((order[1:][same], order[:-1][same]))
        for d in range(3):
            twice[at + d] = True
        repeated = int(twice.sum())
    return n, chars, symbols, len(lines) - len(set(lines)), repeated


def statistics(
    df: DataFrame, id_col: str | None = "doc_id", text_col: str = "text", group_cols: tuple[str, ...] = ("lang", "source"), carry: tuple[str, ...] = (),
) -> DataFrame:
    """(id, group columns as g0.., carried columns, the five counts, n_lines): one row per row of ``df``."""
    cols = ([df[id_col].alias("id")] if id_col else []) + [df[c].alias(f"g{i}") for i, c in enumerate(group_cols)] + [df[c] for c in carry]
    rows = df.select(*cols, df[text_col].cast("string").alias("__text"))
    schema = T.StructType([*rows.schema.fields[:-1], *[T.StructField(c, T.LongType()) for c in (*BASE, "n_lines")]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a, b in _slices(whole.column(whole.num_columns - 1)):
                batch = whole.slice(a, b - a)
                texts = batch.column(batch.num_columns - 1).to_pylist()
                found = [(*text_statistics(t), (t or "").count("\n") + 1) for t in texts]
                counts = [pa.array(list(c), pa.int64()) for c in zip(*found, strict=True)]
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *counts], names=schema.names)

    return rows.mapInArrow(run, schema)


def transformed(rows: DataFrame) -> DataFrame:
    """Adds the integer (1/1024) transformed statistics X; words must be present."""
    w, c = F.col("n_words"), F.col("word_chars")
    x = {
        "x_words": F.log1p(w),
        "x_length": F.log(c / w),
        "x_symbols": F.sqrt(F.col("n_symbols") / c),
        "x_lines": F.sqrt(F.col("n_dup_lines") / F.col("n_lines")),
        "x_repeats": F.sqrt(F.col("n_repeat_words") / w),
    }
    return rows.withColumns({k: F.round(F.when(w > 0, v).otherwise(0.0) * STEP).cast("long") for k, v in x.items()})


LEAST = np.array([(STEP * g) ** 2 for g in GUARD.values()])


def guarded(cov: np.ndarray) -> np.ndarray:
    """A covariance whose variances are no less than the guards', with correlations taken down by a hundredth, so that it can be inverted."""
    own = np.diag(np.diag(cov))
    return 0.99 * cov + np.diag(np.maximum(np.diag(own), LEAST)) - 0.99 * own


def _estimate(mean: np.ndarray, cov: np.ndarray) -> dict:
    held = guarded(cov)
    return {
        "mean": mean.round(6).tolist(), "cov": [round(cov[i, j], 6) for i, j in PAIRS], "inverse": np.linalg.inv(held).round(15).ravel().tolist(),
        "logdet": round(float(np.linalg.slogdet(held)[1]), 9),
    }


def full(cov) -> np.ndarray:
    """The matrix of its upper triangle."""
    out = np.zeros((P, P))
    for (i, j), c in zip(PAIRS, cov, strict=True):
        out[i, j] = out[j, i] = c
    return out


def _moments(part: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    m = float(part["n"].sum())
    mean = np.array([int(part[f"s{i}"].sum()) for i in range(P)], float) / m
    return mean, full([int(part[f"q{i}_{j}"].sum()) / m - mean[i] * mean[j] for i, j in PAIRS])


def _concentrated(cells: pd.DataFrame, share: float) -> dict:
    """The estimate of a group's nearest documents, cell by cell up to the h-th."""
    cells = cells.sort_values("cell")
    n = int(cells["n"].sum())
    h = max(math.ceil(share * n), min(n, P + 1))
    end = int(np.searchsorted(cells["n"].cumsum().to_numpy(), h)) + 1
    return {"n": n} | _estimate(*_moments(cells.iloc[:end]))


def _distance(rows: DataFrame) -> DataFrame:
    """Adds d2, the squared Mahalanobis distance, and its grid cell."""
    d = [F.col(x) - F.col("mean")[i] for i, x in enumerate(X)]
    d2 = sum((F.col("inverse")[i * P + j] * d[i] * d[j] * (1 if i == j else 2) for i, j in PAIRS), F.lit(0.0))
    return rows.withColumn("d2", d2).withColumn("cell", _cell(F.col("d2")))


def _cell(d2):
    return F.greatest(F.lit(0), F.least(F.lit(CELLS - 1), F.floor(F.log2(F.greatest(d2, F.lit(1e-9))) * 16 + CELLS // 2))).cast("int")


def _sums(rows: DataFrame, *by: str) -> DataFrame:
    sums = [F.sum(x).alias(f"s{i}") for i, x in enumerate(X)]
    sums += [F.sum(F.col(X[i]) * F.col(X[j])).alias(f"q{i}_{j}") for i, j in PAIRS]
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *sums)


MODEL = "grp string, start int, n long, mean array<double>, cov array<double>, inverse array<double>, logdet double"


def starts(rows: DataFrame) -> DataFrame:
    """MODEL rows: three first estimates of every group of ``rows(grp, X...)``."""
    # 1/64 steps are fine enough for a start, and keep what the exact percentiles count small
    coarse = rows.select("grp", *[F.floor(F.col(x) / 16).alias(x) for x in X])
    low = lambda c: F.floor(F.percentile(c, 0.5))
    med = cut(coarse.groupBy("grp").agg(*[low(F.col(x)).alias(f"m{i}") for i, x in enumerate(X)]), "medians")
    away = coarse.join(med, "grp").groupBy("grp").agg(*[low(F.abs(F.col(x) - F.col(f"m{i}"))).alias(f"d{i}") for i, x in enumerate(X)])
    seed = cut(med.join(away, "grp").join(_sums(rows, "grp"), "grp"), "seeds")

    def begin(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for k in range(len(pdf)):
                r = pdf.iloc[k]
                middle = np.array([r[f"m{i}"] * 16.0 + 8 for i in range(P)])
                mad = np.diag([(1.4826 * 16 * r[f"d{i}"]) ** 2 for i in range(P)])
                for number, (mean, cov) in enumerate(((middle, mad), (middle, np.zeros((P, P))), _moments(pdf.iloc[k : k + 1]))):
                    out.append({"grp": r["grp"], "start": number, "n": int(r["n"])} | _estimate(mean, cov) | {"logdet": np.inf})
            yield pd.DataFrame(out, columns=["grp", "start", "n", "mean", "cov", "inverse", "logdet"])

    return seed.mapInPandas(begin, MODEL)


def models(rows: DataFrame, share: float = 0.75, steps: int = STEPS) -> DataFrame:
    """MODEL rows: the MCD estimate of every group of ``rows(grp, X...)``."""
    names = ["grp", "start", "n", "mean", "cov", "inverse", "logdet"]

    def refit(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([{"grp": pdf["grp"].iloc[0], "start": pdf["start"].iloc[0]} | _concentrated(pdf, share)], columns=names)

    model = cut(starts(rows), "starts")
    settled = []
    for _ in range(steps):
        new = _sums(_distance(rows.join(model, "grp")), "grp", "start", "cell").groupBy("grp", "start").applyInPandas(refit, MODEL)
        old = model.select("grp", "start", F.struct(*names).alias("old"))
        new = cut(new.select("grp", "start", F.struct(*names).alias("new")).join(old, ["grp", "start"]), "model")
        less = F.col("new.logdet") < F.col("old.logdet") - 1e-9
        settled.append(new.where(~less).select("old.*"))
        model = new.where(less).select("new.*")
        if model.isEmpty():
            break
    whole = reduce(DataFrame.unionByName, settled, model)
    best = F.min_by(F.struct(*names), F.struct("logdet", "start")).alias("m")
    return cut(whole.groupBy("grp").agg(best).select("m.*"), "mcd")


def shrunk(model: DataFrame, names: DataFrame, weight: float = SHRINK) -> DataFrame:
    """(grp, mean, inverse): the estimates with what the language's groups and all groups lend them."""
    flat = model.join(names.select("grp", "lang").distinct(), "grp").select("grp", "lang", "n", *[F.col("mean")[i].alias(f"v{i}") for i in range(P)], *[F.col("cov")[k].alias(f"v{P + k}") for k in range(len(PAIRS))])
    values = [f"v{i}" for i in range(P + len(PAIRS))]
    mean = lambda c: F.round(F.sum(F.col(c) * F.col("n")) / F.sum("n"), 6)  # noqa: E731  rounded, as the order of addition is open
    mixed = lambda c: (F.col(c) * F.col("n") + F.col(f"w{c}") * weight) / (F.col("n") + weight)
    every = flat.agg(*[mean(c).alias(f"w{c}") for c in values])  # one row
    lang = flat.groupBy("lang").agg(F.sum("n").alias("n"), *[mean(c).alias(c) for c in values]).withColumn("one", F.lit(1)).join(F.broadcast(every.withColumn("one", F.lit(1))), "one")
    lang = lang.select("lang", *[mixed(c).alias(f"w{c}") for c in values])
    whole = flat.join(lang, "lang").select("grp", F.array(*[mixed(c) for c in values]).alias("v"))

    def invert(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = [{"grp": g} | {k: x for k, x in _estimate(np.array(v[:P]), full(v[P:])).items() if k in ("mean", "inverse")} for g, v in zip(pdf["grp"], pdf["v"], strict=True)]
            yield pd.DataFrame(out, columns=["grp", "mean", "inverse"])

    return cut(whole.mapInPandas(invert, "grp string, mean array<double>, inverse array<double>"), "shrunk")


def scaled(rows: DataFrame, model: DataFrame) -> DataFrame:
    """Adds scale to ``model``: the median squared distance of ordinary documents is made that of chi-square, in small groups by less."""
    cells = _distance(rows.join(model, "grp")).groupBy("grp", "cell").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("grp")
    middle = (
        cells.withColumn("to", F.sum("n").over(w.orderBy("cell"))).withColumn("all", F.sum("n").over(w))
        .where("2 * to >= all").groupBy("grp").agg(F.pow(F.lit(2.0), (F.min("cell") + 1 - CELLS // 2) / 16).alias("middle"), F.first("all").alias("n"))
    )
    scale = F.pow(F.greatest(F.lit(1.0), F.col("middle") / CHI2_MEDIAN), F.col("n") / (F.col("n") + SHRINK))
    return cut(model.join(middle, "grp").withColumn("scale", scale), "model")


def _failed():
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def fitted(rows: DataFrame, share: float = 0.75) -> tuple[DataFrame, DataFrame]:
    """Group names (h0, h1, grp, lang) and models (grp, mean, inverse, scale) for ``rows(g0, g1, BASE, n_lines)``."""
    fit = transformed(rows).where(~_failed())
    text = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-"))  # noqa: E731  null differs from any value
    names = cut(fit.select("g0", "g1").distinct().select(F.col("g0").alias("h0"), F.col("g1").alias("h1"), F.concat_ws("/", text("g0"), text("g1")).alias("grp"), text("g0").alias("lang")), "groups")
    x = cut(_named(fit, names, "inner").select("grp", *X), "fit")
    return names, scaled(x, shrunk(models(x, share), names))


def _named(rows: DataFrame, names: DataFrame, how: str) -> DataFrame:
    return rows.join(names, F.col("g0").eqNullSafe(F.col("h0")) & F.col("g1").eqNullSafe(F.col("h1")), how)


def _verdict(rows: DataFrame, names: DataFrame, model: DataFrame, cutoff: float) -> DataFrame:
    """Adds base_failed, d2 and kept."""
    far = _distance(_named(transformed(rows), names, "left").join(model, "grp", "left")).withColumn("d2", F.col("d2") / F.col("scale"))
    return far.withColumn("base_failed", _failed()).withColumn("kept", ~F.col("base_failed") & ~F.coalesce(F.col("d2") > cutoff, F.lit(False)))


def judge(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", share: float = 0.75, cutoff: float = CHI2_CUT,
) -> DataFrame:
    """(id, BASE, base_failed, d2, kept): the verdict on every row of ``df``."""
    rows = cut(statistics(df, id_col, text_col, (lang_col, source_col)), "statistics")
    return _verdict(rows, *fitted(rows, share), cutoff).select("id", *BASE, "base_failed", "d2", "kept")


def keep_good(
    df: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", share: float = 0.75, cutoff: float = CHI2_CUT,
) -> DataFrame:
    """The rows of ``df`` that are kept, with all their columns.

    Counts twice, once to fit and once to filter, so that texts are never
    shuffled; the fitted table has a row per group and is joined as the planner
    sees fit for its measured size.
    """
    fit = cut(statistics(df, None, text_col, (lang_col, source_col)), "statistics")
    names, model = fitted(fit, share)
    rows, inner, back = masked(df)
    rows = rows.withColumn("__text", F.col(inner[text_col]).cast("string"))
    counted = statistics(rows, None, "__text", (inner[lang_col], inner[source_col]), tuple(back))
    return _verdict(counted, names, model, cutoff).where("kept").select(*back).withColumnsRenamed(back)
