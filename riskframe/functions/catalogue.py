"""Feature-set catalogue: the card-transaction feature sets as data.

A set is a :class:`FeatureSet` spec; :func:`build_feature_set` turns it into
ONE projection over a frame with ``Time`` (seconds), ``V1..V28`` and
``Amount`` (crosses use the unscaled amount and norm), then applies the
fitted scalers.  Fitting happens on the training frame only.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskframe.functions import features as fx

V_ALL = [f"V{i}" for i in range(1, 29)]


@dataclass(frozen=True)
class FeatureSet:
    name: str
    keep_raw: bool = True                 # keep Time and Amount
    log_amount: str | None = None         # output name of log1p(Amount)
    second_cyclic: bool = False           # sin/cos of the second of day (P8)
    hour: str | None = None               # "Hour" = (Time % 86400) // 3600 (P7)
    hour_sin: bool = False                # sin of the integer hour (P9)
    hour_cos: bool = False
    amount_cross: tuple[str, ...] = ()    # log1p(Amount) * V (P10)
    amount_cross_name: str = "Amount_x_{v}"
    norm: bool = False                    # V_norm over V1..V28 (P11)
    norm_powers: tuple[int, ...] = ()     # P12
    norm_cross: tuple[str, ...] = ()      # V_norm * V (P13)
    pairs: tuple[str, ...] = ()           # i<j products (P14)
    squares: tuple[str, ...] = ()         # P15
    amount_bin: bool = False              # decile code of Amount (W4)
    amount_zscore: bool = False           # A11 on the frame's own stats
    scale: tuple[str, ...] = ()           # robust-scaled after construction (A12)
    extra: dict = field(default_factory=dict)


# The column lists of the reference's feature sets, stated as
# used there (set, V columns crossed with the log amount / the norm, pairs,
# squares, scaled columns).
CATALOGUE = {
    "T1_eng": FeatureSet(
        "T1_eng", keep_raw=False, log_amount="log_amount", second_cyclic=True, hour="hour",
        amount_cross=("V1", "V2", "V3", "V4", "V10", "V11", "V12", "V14", "V17"),
        amount_cross_name="{v}_x_logamt"),
    "T1_raw": FeatureSet("T1_raw", keep_raw=False),
    "T2": FeatureSet(
        "T2", keep_raw=False, log_amount="log_amount", second_cyclic=True, hour="hour",
        amount_cross=("V1", "V2", "V3", "V4", "V10", "V11", "V12", "V14", "V17"),
        amount_cross_name="{v}_x_logamt", amount_zscore=True),
    "T3": FeatureSet(
        "T3", log_amount="Log_Amount", hour="Hour", hour_sin=True, hour_cos=True, amount_bin=True,
        amount_cross=("V14", "V12", "V10", "V17"), norm=True,
        scale=("Time", "Amount", "Log_Amount", "V_norm", "Hour")),
    "T4": FeatureSet(
        "T4", norm=True, hour="Hour", hour_sin=True,
        amount_cross=("V14", "V4", "V17", "V16", "V11", "V12", "V10"), amount_cross_name="Amt_x_{v}",
        pairs=("V14", "V4", "V17", "V16", "V11"), squares=("V14", "V4", "V17", "V16", "V11"),
        scale=("Time", "Amount", "V_norm", "Hour")),
    "T5_A": FeatureSet(
        "T5_A", log_amount="Log_Amount", norm=True, hour="Hour", hour_sin=True,
        amount_cross=("V14", "V12", "V10", "V17"), amount_cross_name="Amt_x_{v}",
        scale=("Time", "Amount", "Log_Amount", "V_norm", "Hour")),
    "T5_B": FeatureSet(
        "T5_B", log_amount="Log_Amount", norm=True, hour="Hour", hour_sin=True,
        amount_cross=("V14", "V4", "V17", "V16", "V11", "V12", "V10"), amount_cross_name="Amt_x_{v}",
        pairs=("V14", "V4", "V17", "V16", "V11"), squares=("V14", "V4", "V17", "V16", "V11"),
        scale=("Time", "Amount", "Log_Amount", "V_norm", "Hour")),
    "T6_A": FeatureSet(
        "T6_A", norm=True, hour="Hour",
        amount_cross=("V14", "V12", "V10", "V17", "V4", "V3", "V1", "V9", "V11"), amount_cross_name="Amt_x_{v}",
        norm_cross=("V4", "V14"), scale=("Time", "Amount", "V_norm", "Hour")),
    "T6_B": FeatureSet(
        "T6_B", log_amount="Log_Amount", norm=True, hour="Hour", hour_sin=True,
        amount_cross=("V14", "V4", "V17", "V16", "V11", "V12", "V10", "V3", "V1", "V9"), amount_cross_name="Amt_x_{v}",
        pairs=("V14", "V4", "V17", "V16", "V11"), squares=("V14", "V4", "V17", "V16", "V11", "V3", "V1", "V9"),
        scale=("Time", "Amount", "Log_Amount", "V_norm", "Hour")),
    "T7_A": FeatureSet(
        "T7_A", norm=True,
        amount_cross=("V14", "V12", "V17", "V4", "V3", "V1", "V9", "V11", "V13", "V24", "V23", "V8"),
        amount_cross_name="Amt_x_{v}", norm_cross=("V4", "V14", "V3", "V11", "V12", "V13"),
        scale=("Time", "Amount", "V_norm")),
    "T7_B": FeatureSet(
        "T7_B", log_amount="Log_Amount", norm=True, hour="Hour", hour_sin=True,
        amount_cross=("V14", "V4", "V17", "V16", "V11", "V12", "V10", "V3", "V1", "V9", "V13", "V24", "V23", "V8"),
        amount_cross_name="Amt_x_{v}", norm_cross=("V4", "V14", "V3", "V11", "V12", "V13"),
        pairs=("V14", "V4", "V17", "V16", "V11", "V13"),
        squares=("V14", "V4", "V17", "V16", "V11", "V13", "V24", "V8"),
        scale=("Time", "Amount", "Log_Amount", "V_norm", "Hour")),
    "T8_A": FeatureSet(
        "T8_A", norm=True,
        amount_cross=("V14", "V12", "V17", "V4", "V3", "V1", "V9", "V11", "V13", "V24", "V23", "V8"),
        amount_cross_name="Amt_x_{v}", norm_cross=("V4", "V14", "V3", "V11", "V12", "V13"),
        scale=("Time", "Amount", "V_norm")),
    "T8_B": FeatureSet(
        "T8_B", log_amount="Log_Amount", norm=True, hour="Hour", hour_sin=True,
        amount_cross=("V14", "V4", "V17", "V16", "V11", "V12", "V10", "V3", "V1", "V9", "V13", "V24", "V23", "V8"),
        amount_cross_name="Amt_x_{v}", pairs=("V14", "V4", "V17", "V16", "V11", "V13"),
        squares=("V14", "V4", "V17", "V16", "V11", "V13", "V24", "V8"),
        scale=("Time", "Amount", "Log_Amount", "V_norm", "Hour")),
    "T9_A": FeatureSet(
        "T9_A", norm=True, norm_powers=(2, 3), amount_cross=tuple(V_ALL), amount_cross_name="Amt_x_{v}",
        norm_cross=tuple(V_ALL), scale=("Time", "Amount", "V_norm")),
    "T9_B": FeatureSet(
        "T9_B", log_amount="Log_Amount", norm=True, norm_powers=(2,), hour="Hour", hour_sin=True,
        amount_cross=tuple(V_ALL), amount_cross_name="Amt_x_{v}",
        norm_cross=("V10", "V16", "V26", "V15", "V4", "V12", "V18", "V14", "V9", "V11", "V13", "V3", "V1",
                    "V17", "V27"),
        pairs=("V14", "V4", "V17", "V16", "V11", "V13"),
        squares=("V14", "V4", "V17", "V16", "V11", "V13", "V10", "V26"),
        scale=("Time", "Amount", "Log_Amount", "V_norm", "Hour")),
}


@dataclass(frozen=True)
class SegmentSet:
    """The customer-segmentation features: log1p of skewed columns, ratios of
    the logged columns (P16), correlated columns dropped, all scaled."""
    skewed: tuple[str, ...]
    ratios: tuple[tuple[str, str, str], ...]
    drop: tuple[str, ...]


# The columns of the reference's segmentation set.
SEGMENTS = SegmentSet(
    skewed=("BALANCE", "PURCHASES", "ONEOFF_PURCHASES", "INSTALLMENTS_PURCHASES", "CASH_ADVANCE", "PAYMENTS",
            "MINIMUM_PAYMENTS", "CREDIT_LIMIT"),
    ratios=(("PURCHASE_TO_LIMIT_RATIO", "PURCHASES", "CREDIT_LIMIT"), ("CASH_ADVANCE_RATIO", "CASH_ADVANCE", "CREDIT_LIMIT"),
            ("PAYMENT_TO_BALANCE_RATIO", "PAYMENTS", "BALANCE"), ("INSTALLMENT_RATIO", "INSTALLMENTS_PURCHASES", "PURCHASES")),
    drop=("ONEOFF_PURCHASES", "PURCHASES_INSTALLMENTS_FREQUENCY", "CASH_ADVANCE_TRX"))


def build_segment_set(df: DataFrame, spec: SegmentSet = SEGMENTS, fit_on: DataFrame | None = None,
                      keep: tuple[str, ...] = ("row_id",)) -> tuple[DataFrame, list[str]]:
    """The segmentation features of ``df`` (other numeric columns stay);
    ``fit_on``, raw like ``df``, supplies the scaler."""
    from riskframe.operators import stats as st

    def project(d: DataFrame) -> DataFrame:
        logged = {c: fx.log_amount(c) if c in spec.skewed else F.col(c) for c in d.columns}
        out = [v.alias(c) for c, v in logged.items() if c not in spec.drop]
        return d.select(*out, *[fx.safe_ratio(logged[a], logged[b]).alias(n) for n, a, b in spec.ratios])
    built = project(df)
    feats = [c for c in built.columns if c not in keep]
    base = built if fit_on is None else project(fit_on)
    return st.apply_robust_scaler(built, st.fit_robust_scaler(base, feats), feats), feats


def build_feature_set(df: DataFrame, spec: FeatureSet, fit_on: DataFrame | None = None,
                      keep: tuple[str, ...] = ("row_id", "Class")) -> tuple[DataFrame, list[str]]:
    """Apply one catalogue set; returns ``(frame, feature names)``.

    ``fit_on`` (the training frame, raw like ``df``) supplies every fitted
    statistic: z-score, bin edges and robust scaler; by default ``df`` does."""
    from riskframe.operators import rank as rk
    from riskframe.operators import stats as st
    fit_on = df if fit_on is None else fit_on
    built = _project(df, spec, fit_on, keep)
    base = built if fit_on is df else _project(fit_on, spec, fit_on, keep)
    if spec.amount_bin:
        edges = rk.fit_quantile_bins(base, "Amount", 10)
        built = rk.apply_quantile_bins(built, "Amount", edges, "Amount_bin")
    if spec.scale:
        cols = [c for c in spec.scale if c in built.columns]
        built = st.apply_robust_scaler(built, st.fit_robust_scaler(base, cols), cols)
    feats = [c for c in built.columns if c not in keep]
    return built, feats


def _project(df: DataFrame, spec: FeatureSet, fit_on: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    """The set's columns before binning and scaling, as one projection."""
    from riskframe.operators import stats as st
    la = fx.log_amount("Amount")
    out = [F.col(c) for c in keep if c in df.columns]
    out += [F.col(v) for v in V_ALL]
    if spec.keep_raw:
        out += [F.col("Time"), F.col("Amount")]
    if spec.log_amount:
        out.append(la.alias(spec.log_amount))
    if spec.second_cyclic:
        s, c = fx.cyclic_time("Time")
        out += [s.alias("time_sin"), c.alias("time_cos")]
    hour = fx.hour_of_day("Time")
    if spec.hour:
        out.append(hour.alias(spec.hour))
    if spec.hour_sin or spec.hour_cos:
        s, c = fx.cyclic_hour(hour)
        if spec.hour_sin:
            out.append(s.alias("Time_sin"))
        if spec.hour_cos:
            out.append(c.alias("Time_cos"))
    out += [(la * F.col(v)).alias(spec.amount_cross_name.format(v=v)) for v in spec.amount_cross]
    norm = fx.row_norm(V_ALL)
    if spec.norm:
        out.append(norm.alias("V_norm"))
        names = {2: "V_norm_sq", 3: "V_norm_cube"}
        out += [F.pow(norm, F.lit(float(k))).alias(names.get(k, f"V_norm_pow{k}")) for k in spec.norm_powers]
        out += [(norm * F.col(v)).alias(f"Vnorm_x_{v}") for v in spec.norm_cross]
    out += fx.pairwise_products(list(spec.pairs))
    out += fx.squares(list(spec.squares))
    if spec.amount_zscore:
        out.append(st.zscore_of("Amount", st.fit_zscore(fit_on, "Amount")).alias("amt_zscore"))
    return df.select(*out)
