"""Composite jobs over the reference's own file formats.

These read the reference's CSV/JSON inputs (see ``sources.readers``);
the driver-table stand-ins live in ``driver_*`` modules.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cindergrid.functions.scalars import abbreviate_list, coerce_int, leading_code, lookup, year_from_text
from cindergrid.models import experiments as ex
from cindergrid.operators import clean, joins, panel, prep, report, stats
from cindergrid.plans import presets as P
from cindergrid.plans.wildfire import HistoryPanelSpec, history_panel, history_panel_single_scan
from cindergrid.session import materialize
from cindergrid.sources import readers, writers


# ------------------------------------------------------------------ W0 (file)
def wildfire_spec() -> HistoryPanelSpec:
    return HistoryPanelSpec(
        entity="zip", period="Year",
        measures={"avg_tmax_c": F.avg("avg_tmax_c"), "avg_tmin_c": F.avg("avg_tmin_c"),
                  "tot_prcp_mm": F.sum("tot_prcp_mm")},
        measure_inputs=["avg_tmax_c", "avg_tmin_c", "tot_prcp_mm"],
        grid_periods=P.WILDFIRE_GRID_YEARS, train_periods=P.WILDFIRE_TRAIN_YEARS, test_periods=P.WILDFIRE_VAL_YEARS,
        label="fire_event", count="fire_count", cumulative="cumulative_fire_count", ever="ever_had_fire",
        derived={"temp_range": F.col("avg_tmax_c") - F.col("avg_tmin_c")},
        measure_specs={"avg_tmax_c": ("avg", "avg_tmax_c"), "avg_tmin_c": ("avg", "avg_tmin_c"),
                       "tot_prcp_mm": ("sum", "tot_prcp_mm")})


def wildfire_dataset(raw: DataFrame, spec: HistoryPanelSpec | None = None, method: str = "single_scan") -> DataFrame:
    """W0 on the mixed weather/fire file.

    ``single_scan`` (default): P6, then one aggregate over both row kinds
    (P7 as a predicate, period from ``year_month`` for weather rows and from
    ``Year`` for fire rows) and range-frame history features.
    ``grid``: the step-by-step form P6 -> P7 -> P8/P9 -> A1, A2, J1 -> J6, J2,
    N5, N6, P15 -> J3 -> P17 -> P12.
    """
    spec = spec or wildfire_spec()
    df = clean.normalise_key(raw, "zip")
    is_fire = F.col("OBJECTID").isNotNull()
    if method == "single_scan":
        rows = df.withColumn("Year", F.when(is_fire, coerce_int("Year")).otherwise(year_from_text("year_month")))
        return history_panel_single_scan(rows, is_fire, spec)
    weather, fire = clean.split_row_kinds(df, is_fire)
    weather = weather.withColumn("Year", year_from_text("year_month"))
    fire = clean.coerce_int_column(fire, "Year")
    return history_panel(weather, fire, spec)


# ---------------------------------------------------------------- W1 / W2
def category_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c.startswith("Category_")]


def premium_panel(raw: DataFrame, risk: DataFrame | None = None, risk_col: str | None = None,
                  entity: list[str] | None = None, order: list[str] | None = None,
                  strategy: str = "window") -> DataFrame:
    """P1 -> P3 -> P5 -> N7 -> J4.

    Lags run over ``entity`` ordered by ``order``.  The default entity is the
    full grain (ZIP + category one-hots), ordered by Year, so a lag is the
    same category one year back.  The reference's row-lag form (T1) is
    ``entity=["ZIP"], order=["Year", <tie-break columns>]``; pass
    ``strategy="ranged"`` there so a ZIP with many rows is spread over tasks.
    """
    df = clean.drop_present(raw, P.PREMIUM_DROP_COLS)
    df = clean.clip_target(df, P.PREMIUM_TARGET)
    df = clean.encode_booleans(df)
    ent = entity or ["ZIP", *category_columns(df)]
    ordr = order or ["Year"]
    losses = [c for c in P.PREMIUM_LOSS_COLS if c in df.columns]
    exposure = P.PREMIUM_EXPOSURE if P.PREMIUM_EXPOSURE in df.columns else None
    feats = panel.premium_features(df, [f"`{c}`" for c in ent], [f"`{c}`" for c in ordr], f"`{P.PREMIUM_TARGET}`",
                                   loss_cols=[f"`{c}`" for c in losses], exposure=f"`{exposure}`" if exposure else None,
                                   strategy=strategy)
    if "premium_per_exposure_lag1" in feats.columns:
        feats = feats.withColumnRenamed("premium_per_exposure_lag1", "prem_per_exp_lag1")
    if risk is not None and risk_col:
        adapted = risk.select(coerce_int("ZIP").alias("ZIP"), F.col("wildfire_risk_prob").alias(risk_col))
        feats = joins.merge_score(feats, adapted, ["ZIP"], risk_col)
    return feats


def clean_data(raw: DataFrame, features: list[str], risk: DataFrame | None = None,
               risk_col: str | None = None) -> tuple[DataFrame, DataFrame, list[str]]:
    """W1 (``get_clean_data``): P1, P3, P5, J4, A4 (all-row medians), P12."""
    df = clean.drop_present(raw, P.PREMIUM_DROP_COLS)
    df = clean.clip_target(df, P.PREMIUM_TARGET)
    df = clean.encode_booleans(df)
    if risk is not None and risk_col:
        adapted = risk.select(coerce_int("ZIP").alias("ZIP"), F.col("wildfire_risk_prob").alias(risk_col))
        df = joins.merge_score(df, adapted, ["ZIP"], risk_col)
    present = [c for c in features if c in df.columns]
    df, filled = prep.impute_all_rows(df, present)
    train, test = clean.train_test(df, "Year", P.PREMIUM_TRAIN_YEARS, [P.PREMIUM_TEST_YEAR])
    return train, test, filled


# ---------------------------------------------------- runs from file to result
def premium_experiments(raw: DataFrame, risks: Mapping[str, DataFrame] | None = None, out_dir: str | None = None,
                        feature_sets: Mapping[str, list[str]] | None = None, **kw) -> dict[str, DataFrame]:
    """Experiments A-D from the raw premium panel: W2 -> J4 per risk column -> P12 -> P2 -> M9 -> K1.

    ``risks`` maps a risk column to its ``(ZIP, wildfire_risk_prob)`` scores.
    Returns the metric rows of each set; with ``out_dir`` each is also
    written to ``experiment_<code>_metrics``, the folders W5 reads.
    """
    df = premium_panel(raw)
    for column, scores in (risks or {}).items():
        adapted = scores.select(coerce_int("ZIP").alias("ZIP"), F.col("wildfire_risk_prob").alias(column))
        df = joins.merge_score(df, adapted, ["ZIP"], column)
    train, test = clean.train_test(materialize(df), "Year", P.PREMIUM_TRAIN_YEARS, [P.PREMIUM_TEST_YEAR])
    found = {}
    for name, wanted in (feature_sets or P.FEATURE_SETS).items():
        rows, _ = ex.run_experiment(train, test, [c for c in wanted if c in df.columns], P.PREMIUM_TARGET, name, **kw)
        rows = rows.select(F.col("experiment").alias("Experiment"), F.col("model").alias("Model"), "MAE", "RMSE", "R2", "MAPE")
        if out_dir:
            writers.save_metrics(rows, f"{out_dir}/experiment_{name[0]}_metrics")
        found[name] = rows
    return found


def classical_run(dataset: DataFrame, out: str | None = None, features: list[str] | None = None, label: str = "fire_event",
                  key: list[str] | None = None, source: str = "wildfire_weather.csv", forest_trees: int = 300,
                  boost_rounds: int = 300, n_landmarks: int = 800, seed: int = 42) -> DataFrame:
    """The classical baselines over W0's panel: M4, M5, M6 and M7, and their full run log (K5).

    The log has the fields that W3 reads; with ``out`` it is appended there.
    """
    feats, key = list(features or P.WILDFIRE_CANDIDATE_FEATURES), key or ["zip", "Year"]
    panel_df = materialize(dataset)
    train, valid = (panel_df.filter(F.col("split") == x) for x in ("train", "validation"))
    runs = {
        "logistic_regression": (ex.logistic_classifier(train, valid, feats, label),
                                {"max_iter": 1000, "class_weight": "balanced"}),
        "random_forest": (ex.evaluate(ex.fit_forest_classifier(train, feats, label, key, forest_trees, seed), valid, label),
                          {"n_estimators": forest_trees, "class_weight": "balanced"}),
        "gradient_boosting": (ex.evaluate(ex.fit_boosted_classifier(train, feats, label, key, boost_rounds, seed), valid,
                                          label),
                              {"n_estimators": boost_rounds, "learning_rate": 0.05, "max_depth": 4, "subsample": 0.8,
                               "class_weight": "balanced (via sample_weight)"}),
        "svm_rbf": (ex.landmark_classifier(train, valid, feats, label, key, kind="rbf", n_landmarks=n_landmarks, seed=seed,
                                           scale_on=train), {"kernel": "rbf", "class_weight": "balanced"}),
    }
    rows = report.stack_frames([
        met.select(F.lit(name).alias("key"), *[F.bround(c, 4).alias(to) for c, to in (
            ("roc_auc", "roc_auc"), ("average_precision", "pr_auc"), ("f1", "f1"), ("precision", "precision"),
            ("recall", "recall"), ("train_runtime_s", "train_runtime_s"))])
        for name, ((met, _, _), _) in runs.items()])
    sizes = {r["split"]: r for r in panel_df.groupBy("split").agg(
        F.count(F.lit(1)).alias("n"), F.avg(label).alias("rate"), F.sort_array(F.collect_set("Year")).alias("years")).collect()}
    tr, va = sizes["train"], sizes["validation"]
    data = F.struct(
        F.lit(source).alias("source_file"), F.array(*map(F.lit, tr["years"])).alias("train_years"),
        F.array(*map(F.lit, va["years"])).alias("val_years"), F.lit(tr["n"]).alias("train_samples"),
        F.lit(va["n"]).alias("val_samples"), F.lit(False).alias("subsampled"),
        F.struct(F.lit(round(tr["rate"], 4)).alias("train_fire_rate"),
                 F.lit(round(va["rate"], 4)).alias("val_fire_rate")).alias("class_balance"))
    used = F.struct(F.array(*map(F.lit, feats)).alias("all_features_used"),
                    F.lit("StandardScaler (fit on train)").alias("scaler"),
                    F.lit("balanced (sample_weight for GradientBoosting)").alias("class_weight"))
    log = report.run_log(rows, "key", "classical_baselines_wildfire", seed, data=data, features=used,
                         params={name: settings for name, (_, settings) in runs.items()})
    if out:
        writers.write_run_log(log, out, partition_by=None)
    return log


def risk_scores(dataset: DataFrame, features: list[str] | None = None, label: str = "fire_event", entity: str = "zip",
                period: str = "Year", **kw) -> DataFrame:
    """M12 over W0's panel: both risk scores of every validation entity, in the K4 shape."""
    panel_df = materialize(dataset)
    train, valid = (panel_df.filter(F.col("split") == x) for x in ("train", "validation"))
    return ex.score_generator(train, valid, list(features or P.WILDFIRE_CANDIDATE_FEATURES), label, [entity],
                              [entity, period], **kw)


def premium_with_scores(raw: DataFrame, scores: DataFrame, score: str = "classical_risk_prob",
                        risk_col: str = P.CLASSICAL_RISK_COL) -> DataFrame:
    """Scores of M12 -> P16 adapter -> W2 with J4: the premium panel with the scorer's own risk column."""
    return premium_panel(raw, clean.adapt_scores(scores, "zip", score, "ZIP", "wildfire_risk_prob"), risk_col)


# ------------------------------------------------------------------ W3 / W4
def _fmt_features(c: Column) -> Column:
    return abbreviate_list(c, P.FEATURE_ABBREV)


def _latest_kernel_run(runs: DataFrame) -> DataFrame:
    non_vqc = runs.filter(~readers.file_name_matches("vqc"))
    return readers.pick_latest(non_vqc, F.col("quantum_4qubit").isNotNull() & F.col("quantum_6qubit").isNotNull())


def _latest_vqc_run(runs: DataFrame) -> DataFrame:
    return readers.pick_latest(runs.filter(readers.file_name_matches(r"_vqc\.json$")))


def _str(c: Column) -> Column:
    return c.cast("string")


def comparison_report(baseline_doc: DataFrame, runs: DataFrame) -> DataFrame:
    """Classical, kernel and VQC rows in one table, canonical order, rounded."""
    m = baseline_doc.select(F.explode("models").alias("key", "m"), F.col("data.train_samples").alias("ts"),
                            F.col("features.all_features_used").alias("feats"))
    classical = m.filter(F.col("key").isin(list(P.CLASSICAL_DISPLAY))).select(
        lookup("key", P.CLASSICAL_DISPLAY).alias("Model"), F.lit("Classical").alias("Type"), F.lit("-").alias("Qubits"),
        _fmt_features(F.col("feats")).alias("Features"), F.col("m.roc_auc").alias("ROC-AUC"),
        F.col("m.pr_auc").alias("PR-AUC"), F.col("m.f1").alias("F1"), F.col("m.precision").alias("Precision"),
        F.col("m.recall").alias("Recall"), F.col("m.train_runtime_s").alias("Runtime_s"),
        F.col("ts").alias("Train_samples"), lookup("key", P.CLASSICAL_NOTES).alias("Notes"))

    qk = _latest_kernel_run(runs)
    kernel_rows = []
    for key, display, fmap in P.KERNEL_RUN_KEYS:
        q = F.col(key)
        kernel_rows.append(qk.filter(q.isNotNull()).select(
            F.lit(display).alias("Model"), F.lit("Quantum Kernel").alias("Type"), _str(q["num_qubits"]).alias("Qubits"),
            _fmt_features(q["selected_features"]).alias("Features"), q["roc_auc"].alias("ROC-AUC"),
            q["pr_auc"].alias("PR-AUC"), q["f1"].alias("F1"), q["precision"].alias("Precision"),
            q["recall"].alias("Recall"), F.bround(q["kernel_runtime_s"] + q["svm_train_runtime_s"], 4).alias("Runtime_s"),
            F.col("data.train_samples").alias("Train_samples"),
            F.format_string("FidelityStatevectorKernel; %s reps=2; circuit_depth=%d; class_weight=balanced",
                            F.lit(fmap), q["circuit_depth"]).alias("Notes")))

    vq = _latest_vqc_run(runs)
    c, r = F.col("vqc_config"), F.col("vqc_results")
    vqc = vq.select(
        F.lit(P.VQC_DISPLAY).alias("Model"), F.lit("Quantum VQC").alias("Type"), _str(c["num_qubits"]).alias("Qubits"),
        _fmt_features(F.col("feature_engineering.selected_features")).alias("Features"), r["roc_auc"].alias("ROC-AUC"),
        r["pr_auc"].alias("PR-AUC"), r["f1"].alias("F1"), r["precision"].alias("Precision"),
        r["recall"].alias("Recall"), c["train_runtime_s"].alias("Runtime_s"),
        F.col("data.train_samples").alias("Train_samples"),
        F.format_string("%s; %s; depth=%d; %d params; COBYLA iters=%d; WeightedCrossEntropyLoss",
                        c["feature_map"], c["ansatz"], c["full_circuit_depth"], c["num_parameters"],
                        c["iterations_run"]).alias("Notes"))

    rows = report.stack_frames([classical, *kernel_rows, vqc])
    rows = clean.round_columns(rows, {**{k: 4 for k in P.COMPARISON_METRICS}, "Runtime_s": 4}, half_even=True)
    ranked = rows.withColumn("_order", report.canonical_rank("Model", P.MODEL_ORDER))
    return ranked.orderBy("_order").select(*P.COMPARISON_COLUMNS, "_order")


def best_models(comparison: DataFrame) -> DataFrame:
    """A25 over the comparison table."""
    return report.best_per_metric(comparison, "Model", P.COMPARISON_METRICS, "_order")


def feature_sets(comparison: DataFrame) -> DataFrame:
    """The first model for each distinct feature string."""
    return report.first_per_group(comparison.select("Features", "Model", "_order"), ["Features"], ["_order"])


def resource_report(runs: DataFrame) -> DataFrame:
    """Kernel-build and total times, circuit sizes ('-' where not applicable)."""
    qk = _latest_kernel_run(runs)
    reps = F.coalesce(F.col("shared_config.reps"), F.col("shared_config.zz_reps"))
    rows = []
    for key, display, _ in P.KERNEL_RUN_KEYS:
        q = F.col(key)
        k_time, s_time = F.bround(q["kernel_runtime_s"], 4), F.bround(q["svm_train_runtime_s"], 4)
        rows.append(qk.filter(q.isNotNull()).select(
            F.lit(display).alias("Model"), _str(q["num_qubits"]).alias("Qubits"),
            _str(q["circuit_depth"]).alias("Circuit Depth"),
            F.format_string("%s (reps=%d)", F.coalesce(q["feature_map_name"], F.lit("ZZFeatureMap")), reps)
            .alias("Feature Map"),
            F.col("shared_config.shots").alias("Shots"), F.col("shared_config.backend").alias("Backend"),
            _str(F.col("data.train_samples")).alias("Train Samples"), _str(k_time).alias("Kernel Build Time (s)"),
            _str(F.bround(k_time + s_time, 4)).alias("Total Runtime (s)"), F.lit("-").alias("Trainable Parameters"),
            q["roc_auc"].alias("Best ROC-AUC"), F.lit(len(rows)).alias("_order")))
    vq = _latest_vqc_run(runs)
    c = F.col("vqc_config")
    rows.append(vq.select(
        F.lit(P.VQC_DISPLAY).alias("Model"), _str(c["num_qubits"]).alias("Qubits"),
        _str(c["full_circuit_depth"]).alias("Circuit Depth"),
        F.concat_ws(" + ", c["feature_map"], c["ansatz"]).alias("Feature Map"), c["sampler"].alias("Shots"),
        F.lit(P.VQC_BACKEND).alias("Backend"), _str(F.col("data.train_samples")).alias("Train Samples"),
        F.lit("-").alias("Kernel Build Time (s)"), _str(c["train_runtime_s"]).alias("Total Runtime (s)"),
        _str(c["num_parameters"]).alias("Trainable Parameters"), F.col("vqc_results.roc_auc").alias("Best ROC-AUC"),
        F.lit(len(rows)).alias("_order")))
    return report.stack_frames(rows).orderBy("_order").select(*P.RESOURCE_COLUMNS)


def build_reports(spark, baseline_path: str, runs_path: str, out_dir: str | None = None) -> dict:
    """W3 + W4 + K7: read logs, build both tables, optionally write them."""
    base = readers.read_json_docs(spark, baseline_path)
    runs = readers.read_json_docs(spark, runs_path)
    comp = comparison_report(base, runs)
    res = resource_report(runs)
    if out_dir:
        writers.write_report(comp.drop("_order"), f"{out_dir}/model_comparison")
        writers.write_report(res, f"{out_dir}/quantum_resources")
    return {"comparison": comp, "resources": res, "best": best_models(comp), "feature_sets": feature_sets(comp)}


# ---------------------------------------------------------------------- W5
def results_summary(spark, metrics_folder: str, combined_out: str | None = None, pattern: str = "*.csv") -> dict:
    """S4 + U1 -> K6 (to another folder, T13) -> P18 -> J7.

    ``pattern="*/*.csv"`` reads what :func:`premium_experiments` writes.
    """
    allm = readers.read_metric_folder(spark, metrics_folder, pattern=pattern)
    if combined_out:
        writers.write_combined(allm.drop(readers.SOURCE_FILE), combined_out)
    model = allm.filter(F.col("Model") == P.SUMMARY_MODEL) \
        .withColumn("Label", leading_code("Experiment", P.EXPERIMENT_CODE_PATTERN))
    imp = report.improvement_vs_baseline(model, "Experiment", "MAE",
                                         F.col("Experiment").startswith(P.BASELINE_PREFIX))
    return {"all": allm, "model": model, "improvement": imp}


# ---------------------------------------------------------------------- W6
def data_audit(df: DataFrame, target: str = P.PREMIUM_TARGET, period: str = "Year", entity: str = "ZIP",
               clip_at: float = 2e6, risk_col: str = P.FIRE_RISK_COL) -> dict:
    """Rows per period, distinct entities, exact describe of the target
    and of the fire-risk score (where the panel has one) with its null
    count, null profile, null/negative target counts, histograms, split sizes."""
    t = F.col(f"`{target}`")
    tgt = df.select(t.cast("double").alias("target"))
    risk = df.select(F.col(f"`{risk_col}`").cast("double").alias("risk")) if risk_col in df.columns else None
    split = clean.temporal_split(df.select(period), period, P.PREMIUM_TRAIN_YEARS, [P.PREMIUM_TEST_YEAR],
                                 labels=("train", "test"))
    return {
        "rows_per_period": stats.value_counts(df, period),
        "distinct_entities": stats.distinct_count(df, entity),
        "target_describe": stats.describe_exact(tgt, ["target"]),
        **({} if risk is None else {
            "risk_describe": stats.describe_exact(risk, ["risk"]),
            "risk_nulls": risk.agg(F.count_if(F.col("risk").isNull()).alias("n_null_risk"))}),
        "null_profile": stats.null_profile(df.select(*[F.col(f"`{c}`").alias(c) for c in df.columns]), top=20),
        "target_counts": tgt.agg(F.count_if(F.col("target").isNull()).alias("n_null_target"),
                                 F.count_if(F.col("target") < 0).alias("n_negative_target")),
        "histogram": stats.histogram(tgt, clean.clip_range("target", lower=0.0, upper=clip_at), bins=60),
        "histogram_log1p": stats.histogram(tgt, F.log1p(clean.clip_range("target", lower=0.0)), bins=60),
        "split_rows": split.groupBy("split").agg(F.count(F.lit(1)).alias("n_rows")),
    }

