"""Freeze fitted statistics and apply them to a streaming frame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskframe.functions.features import clip


def freeze_stats(stats: DataFrame, key: str = "feature") -> dict[str, dict[str, float]]:
    """Collect a small fitted-stats frame (one row per column, e.g. from
    ``fit_robust_scaler`` / ``fit_quantile_cap``) into a dict.  Bounded by
    the number of columns; streaming plans then carry plain literals."""
    out = {}
    for r in stats.collect():
        d = r.asDict()
        name = d.pop(key)
        out[name] = {k: (None if v is None else float(v)) for k, v in d.items()}
    return out


def apply_frozen(df: DataFrame, caps: dict | None = None, scaler: dict | None = None) -> DataFrame:
    """Upper caps (A9) then robust scaling (A12) as literal expressions;
    works the same on batch and streaming frames."""
    exprs = []
    for c in df.columns:
        col = F.col(c)
        if caps and c in caps and caps[c].get("cap") is not None:
            col = clip(col, hi=caps[c]["cap"])
        if scaler and c in scaler:
            iqr = scaler[c]["iqr"] or 1.0
            col = (col - F.lit(scaler[c]["median"])) / F.lit(iqr)
        exprs.append(col.alias(c))
    return df.select(*exprs)


def score_stream(stream: DataFrame, caps: dict | None, scaler: dict | None, model=None,
                 features: list[str] | None = None, keep: list[str] | None = None) -> DataFrame:
    """A streaming frame of scores: frozen transforms, then (optionally) a
    fitted ``pyspark.ml`` model's positive-class probability."""
    out = apply_frozen(stream, caps, scaler)
    if model is None:
        return out
    from riskframe.operators.models import predict_proba
    return predict_proba(model, out, features, keep=keep)
