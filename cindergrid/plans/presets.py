"""Presets for the reference's own datasets and reports.

Everything below is a FIXED VALUE that must equal the reference for its
datasets and reports to come out the same: column names of the premium
panel, the experiment feature sets, year splits, and the display names,
notes, orders and abbreviations of the comparison/resource reports.
Operators never hard-code these; they are passed in from here.
"""

from __future__ import annotations

# ---------------------------------------------------------------- fixed values
# Premium panel (insurance x census x fire, one row per ZIP x Year x category).
PREMIUM_TRAIN_YEARS = [2018, 2019, 2020]
PREMIUM_TEST_YEAR = 2021
PREMIUM_TARGET = "Earned Premium"
PREMIUM_DROP_COLS = [
    "OBJECTID", "AGENCY", "UNIT_ID", "FIRE_NAME", "INC_NUM",
    "ALARM_DATE", "CONT_DATE", "CAUSE", "C_METHOD", "OBJECTIVE",
    "GIS_ACRES", "COMMENTS", "COMPLEX_NA", "FIRE_NUM", "COMPLEX_ID",
    "DECADES", "Shape__Are", "Shape__Len", "latitude", "longitude",
    "Alarm_Date2", "year_month", "AGENCY_ID", "FIRE_NAME_ID",
    "avg_tmax_c", "avg_tmin_c", "tot_prcp_mm", "station",
]
PREMIUM_BASE_FEATURES = [
    "Earned Exposure",
    "Avg PPC",
    "Cov A Amount Weighted Avg",
    "Cov C Amount Weighted Avg",
    "CAT Cov A Fire -  Incurred Losses",
    "CAT Cov A Fire -  Number of Claims",
    "CAT Cov A Smoke -  Incurred Losses",
    "CAT Cov A Smoke -  Number of Claims",
    "Non-CAT Cov A Fire -  Incurred Losses",
    "Non-CAT Cov A Fire -  Number of Claims",
    "Non-CAT Cov A Smoke -  Incurred Losses",
    "Non-CAT Cov A Smoke -  Number of Claims",
    "CAT Cov C Fire -  Incurred Losses",
    "Non-CAT Cov C Fire -  Incurred Losses",
    "Number of Very High Fire Risk Exposure",
    "Number of High Fire Risk Exposure",
    "Number of Moderate Fire Risk Exposure",
    "Number of Low Fire Risk Exposure",
    "Number of Negligible Fire Risk Exposure",
    "Category_HO",
    "Category_CO",
    "Category_DO",
    "Category_DT",
    "Category_MH",
    "Category_RT",
    "total_population",
    "median_income",
    "total_housing_units",
    "average_household_size",
    "housing_value",
    "median_monthly_housing_costs",
    "owner_occupied_housing_units",
    "renter_occupied_housing_units",
    "poverty_status",
]
PREMIUM_LAG_FEATURES = [
    "premium_lag1",
    "premium_lag2",
    "premium_yoy_change",
    "premium_pct_change",
    "loss_ratio_lag1",
    "prem_per_exp_lag1",
]
PREMIUM_LOSS_COLS = [
    "CAT Cov A Fire -  Incurred Losses",
    "Non-CAT Cov A Fire -  Incurred Losses",
    "CAT Cov A Smoke -  Incurred Losses",
    "Non-CAT Cov A Smoke -  Incurred Losses",
]
PREMIUM_EXPOSURE = "Earned Exposure"
FIRE_RISK_COL = "Avg Fire Risk Score"
CLASSICAL_RISK_COL = "classical_wildfire_risk"
QUANTUM_RISK_COL = "quantum_wildfire_risk"
FEATURE_SETS = {
    "A - No Wildfire Risk": PREMIUM_BASE_FEATURES + PREMIUM_LAG_FEATURES,
    "B - Provided Fire Risk Score": PREMIUM_BASE_FEATURES + PREMIUM_LAG_FEATURES + [FIRE_RISK_COL],
    "C - Classical Wildfire Risk": PREMIUM_BASE_FEATURES + PREMIUM_LAG_FEATURES + [CLASSICAL_RISK_COL],
    "D - Quantum Wildfire Risk": PREMIUM_BASE_FEATURES + PREMIUM_LAG_FEATURES + [QUANTUM_RISK_COL],
}

# Wildfire event panel (ZIP x Year from the mixed weather/fire file).
WILDFIRE_TRAIN_YEARS = [2018, 2019, 2020]
WILDFIRE_VAL_YEARS = [2021]
WILDFIRE_GRID_YEARS = [2016, 2017]
WILDFIRE_CANDIDATE_FEATURES = [
    "avg_tmax_c",
    "avg_tmin_c",
    "tot_prcp_mm",
    "temp_range",
    "fire_count_lag1",
    "fire_count_lag2",
    "cumulative_fire_count",
    "ever_had_fire",
]

# Comparison report.
COMPARISON_COLUMNS = [
    "Model", "Type", "Qubits", "Features",
    "ROC-AUC", "PR-AUC", "F1", "Precision", "Recall",
    "Runtime_s", "Train_samples", "Notes",
]
FEATURE_ABBREV = {
    "avg_tmax_c": "tmax",
    "avg_tmin_c": "tmin",
    "tot_prcp_mm": "prcp",
    "temp_range": "range",
    "fire_count_lag1": "lag1",
    "fire_count_lag2": "lag2",
    "cumulative_fire_count": "cum_fire",
    "ever_had_fire": "ever_fire",
}
CLASSICAL_DISPLAY = {
    "logistic_regression": "Logistic Regression",
    "random_forest": "Random Forest",
    "gradient_boosting": "Gradient Boosting",
    "svm_rbf": "Classical SVM (RBF)",
}
CLASSICAL_NOTES = {
    "logistic_regression": "max_iter=1000; class_weight=balanced",
    "random_forest": "n_estimators=300; class_weight=balanced",
    "gradient_boosting": "n_estimators=300; lr=0.05; balanced via sample_weight",
    "svm_rbf": "RBF kernel; class_weight=balanced",
}
KERNEL_RUN_KEYS = [
    ("quantum_4qubit", "Quantum Kernel SVM (4q)", "ZZFeatureMap"),
    ("quantum_6qubit", "Quantum Kernel SVM (6q)", "ZZFeatureMap"),
    ("quantum_pauli_4qubit", "Quantum Kernel SVM (Pauli-4q)", "PauliFeatureMap"),
]
VQC_DISPLAY = "VQC (4q)"
MODEL_ORDER = [
    "Logistic Regression",
    "Random Forest",
    "Gradient Boosting",
    "Classical SVM (RBF)",
    "Quantum Kernel SVM (4q)",
    "Quantum Kernel SVM (6q)",
    "Quantum Kernel SVM (Pauli-4q)",
    "VQC (4q)",
]
COMPARISON_METRICS = ["ROC-AUC", "PR-AUC", "F1", "Precision", "Recall"]

# Resource report.
RESOURCE_COLUMNS = [
    "Model",
    "Qubits",
    "Circuit Depth",
    "Feature Map",
    "Shots",
    "Backend",
    "Train Samples",
    "Kernel Build Time (s)",
    "Total Runtime (s)",
    "Trainable Parameters",
    "Best ROC-AUC",
]
VQC_BACKEND = "statevector_simulator"

# Results summary.
SUMMARY_MODEL = "Random Forest"
EXPERIMENT_CODE_PATTERN = "^([A-D])"
BASELINE_PREFIX = "A"
