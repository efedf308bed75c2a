"""Fitted preparation steps: median imputation, class weights, scaling,
mutual-information feature ranking (A3, A4, A20, A21, A24, L5).

Fitting is one aggregate job whose result is a handful of numbers per
column (or per class); applying it is a plain column expression, so no
join is added to the plan.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import chain

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cindergrid.operators.quantiles import FEATURE, VALUE, column_quantiles, quantiles_long, unpivot_numeric


# ----------------------------------------------------------------- imputation
def fit_medians(df: DataFrame, cols: Sequence[str]) -> dict:
    """Exact median per column (all-null column -> None)."""
    return column_quantiles(df, cols, 0.5)


def apply_fill(df: DataFrame, values: dict) -> DataFrame:
    """Fill nulls with fitted values; columns whose value is None are left alone."""
    usable = {c: float(v) for c, v in values.items() if v is not None}
    return df.fillna(usable) if usable else df


def impute_train_median(train: DataFrame, test: DataFrame,
                        cols: Sequence[str]) -> tuple[DataFrame, DataFrame, dict]:
    """A3: medians from the training rows (taken before any target-null drop,
    as the reference does), applied to both frames."""
    med = fit_medians(train, cols)
    return apply_fill(train, med), apply_fill(test, med), med


def impute_all_rows(df: DataFrame, cols: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """A4 (``scope="all"``): medians over every row, only for columns that
    contain nulls; returns the filled column list.  Uses test rows too - the
    reference's leak, kept as an explicit option."""
    nulls = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in cols]).first()
    with_nulls = [c for c in cols if nulls[c] > 0]
    if not with_nulls:
        return df, []
    return apply_fill(df, fit_medians(df, with_nulls)), with_nulls


# -------------------------------------------------------------- class weights
def class_counts(df: DataFrame, label: str) -> dict:
    """Rows per non-null class, one small row per class of a model's label."""
    rows = df.filter(F.col(label).isNotNull()).groupBy(label).count().collect()
    return {r[label]: int(r["count"]) for r in rows}


def class_weights(counts: dict) -> dict:
    """A20 as numbers: ``n / (k * n_class)`` per class."""
    n, k = sum(counts.values()), len(counts)
    return {c: n / (k * m) for c, m in counts.items()}


def balanced_weights(df: DataFrame, label: str, out: str = "weight") -> DataFrame:
    """``n / (k * n_class)`` per row (sklearn ``class_weight='balanced'``).

    A join with the table of class counts, so any number of classes will do.
    Rows with a null class get a null weight.
    """
    counts = df.filter(F.col(label).isNotNull()).groupBy(F.col(label).alias("__cg_class")).agg(
        F.count(F.lit(1)).alias("__cg_m"))
    total = counts.agg(F.sum("__cg_m") / F.count(F.lit(1))).scalar()
    weights = counts.select("__cg_class", (total / F.col("__cg_m")).cast("double").alias(out))
    return df.join(weights, F.col(label) == F.col("__cg_class"), "left").drop("__cg_class")


# ----------------------------------------------------------------- standardise
def fit_scaler(train: DataFrame, cols: Sequence[str]) -> dict:
    """A21 fit: mean and population std (ddof 0) per column; std 0 -> 1."""
    row = train.agg(*chain.from_iterable(
        (F.avg(F.col(c).cast("double")).alias(f"m_{i}"), F.stddev_pop(F.col(c).cast("double")).alias(f"s_{i}"))
        for i, c in enumerate(cols))).first()
    params = {}
    for i, c in enumerate(cols):
        mean, std = row[f"m_{i}"], row[f"s_{i}"]
        params[c] = (mean if mean is not None else 0.0, std if std not in (None, 0.0) else 1.0)
    return params


def apply_scaler(df: DataFrame, params: dict, suffix: str = "") -> DataFrame:
    """A21 apply: ``(x - mean) / std`` with the fitted literals."""
    cols = []
    for c in df.columns:
        if c in params:
            mean, std = params[c]
            e = (F.col(c).cast("double") - F.lit(mean)) / F.lit(std)
            cols.append(e.alias(c + suffix))
            if suffix:
                cols.append(F.col(c))
        else:
            cols.append(F.col(c))
    return df.select(*cols)


# ---------------------------------------------------------- mutual information
def mutual_information(df: DataFrame, features: Sequence[str], label: str, bins: int = 10,
                       binning: str = "width") -> DataFrame:
    """MI (nats) of each feature with a discrete label, on equal-width bins.

    Deterministic, unlike the reference's noisy nearest-neighbour estimator.
    Uses ``MI = (sum n_xy ln n_xy - sum n_x ln n_x - sum n_y ln n_y) / n + ln n``:

    1. per-feature min/max (one aggregate, one row per feature) -> literal
       bin edges, so binning is a column expression, not a join;
       ``binning="quantile"`` instead cuts at the exact k/bins quantiles of
       each feature (bin = number of cut points <= value);
    2. one ``groupingSets`` aggregate over (feature, bin, label) yields the
       joint counts, both marginals and the totals in a single exchange
       (partial aggregation map-side, so a hot bin is no problem);
    3. a signed sum per feature.

    Rows where the feature or the label is null are left out for that feature.
    """
    long = unpivot_numeric(df.filter(F.col(label).isNotNull()), features, ids=[label])
    spark = df.sparkSession
    pos = spark.createDataFrame([(f, i) for i, f in enumerate(features)], f"{FEATURE} string, position int")
    f = F.col(FEATURE)
    if binning == "quantile":
        probs = [k / bins for k in range(1, bins)]
        qs = quantiles_long(df.filter(F.col(label).isNotNull()), features, probs).collect()
        if not qs:
            return pos.withColumn("mi", F.lit(0.0))
        names = [c for c in qs[0].asDict() if c not in (FEATURE, "n")]
        cuts = {r[FEATURE]: [float(r[c]) for c in names] for r in qs}          # (bins - 1) per feature
        cut_m = F.create_map(*chain.from_iterable(
            (F.lit(k), F.array(*[F.lit(x) for x in v])) for k, v in cuts.items()))
        v = F.col(VALUE)
        binned = long.select(FEATURE, label, F.size(F.filter(cut_m[f], lambda e: e <= v)).cast("int").alias("bin"))
    elif binning == "width":
        edges = long.groupBy(FEATURE).agg(F.min(VALUE).alias("lo"), F.max(VALUE).alias("hi")).collect()
        if not edges:
            return pos.withColumn("mi", F.lit(0.0))
        lo = {r[FEATURE]: float(r["lo"]) for r in edges}
        width = {r[FEATURE]: (float(r["hi"]) - float(r["lo"])) / bins if r["hi"] > r["lo"] else 1.0 for r in edges}
        lo_m = F.create_map(*[F.lit(x) for x in chain.from_iterable(lo.items())])
        w_m = F.create_map(*[F.lit(x) for x in chain.from_iterable(width.items())])
        binned = long.select(FEATURE, label, F.least(F.floor((F.col(VALUE) - lo_m[f]) / w_m[f]),
                                                     F.lit(bins - 1)).cast("int").alias("bin"))
    else:
        raise ValueError(f"unknown binning {binning!r}")
    sets = [[FEATURE, "bin", label], [FEATURE, "bin"], [FEATURE, label], [FEATURE]]
    g = binned.groupingSets(sets, FEATURE, "bin", label).agg(
        F.count(F.lit(1)).cast("double").alias("cnt"), F.grouping_id().alias("gid"))
    # grouping_id bits over (feature, bin, label): 0 joint, 1 per bin, 2 per label, 3 per feature
    term = F.col("cnt") * F.log(F.col("cnt"))
    signed = F.when(F.col("gid") == 0, term).when(F.col("gid").isin(1, 2), -term).otherwise(F.lit(0.0))
    mi = g.groupBy(FEATURE).agg(F.sum(signed).alias("s"), F.max(F.when(F.col("gid") == 3, F.col("cnt"))).alias("n"))
    mi = mi.select(FEATURE, (F.col("s") / F.col("n") + F.log(F.col("n"))).alias("mi"))
    # ``pos`` holds one row per requested feature: a proven bound
    return F.broadcast(pos).join(mi, FEATURE, "left").select(FEATURE, "position",
                                                             F.coalesce("mi", F.lit(0.0)).alias("mi"))


def select_k_best(scores: DataFrame, k: int, score: str = "mi", position: str = "position") -> DataFrame:
    """Top ``k`` by score (ties -> earlier position), returned in original column order."""
    top = scores.orderBy(F.desc(score), F.asc(position)).limit(k)
    return top.orderBy(position)
