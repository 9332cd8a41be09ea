"""A3 / A4: exact quantiles (linear interpolation, NULL skipped) and IQR
fences for many columns at once.

A fit is an artefact: ``quantiles`` runs its jobs when called and returns a
small local frame (columns x probabilities).  Whatever is built on it reads
literals, so plans of composed fits do not grow with the fits below them.

``method="exact"`` (default) narrows rank brackets, on one path at every size:

1. one scan sketches each column and gives, for each wanted rank, a bracket
   of values that should hold it;
2. one scan counts the rows below and in each bracket.  The counts are exact,
   so a bracket that misses its rank is opened on that side and counted anew,
   and one that still holds more than ``LEAVE`` rows is cut further by a
   sketch of only its rows;
3. one scan builds the histogram of the rows in the brackets (about 1 in 400)
   and picks the ranks.

No task ever holds a whole column.  ``method="approx"`` uses
``percentile_approx`` (bounded memory, rank error ``1/accuracy``).
"""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Accuracy of the first sketch; a bracket spans a few of its rank errors.
SKETCH = 2000
#: Rows of a bracket that the last scan may turn into a histogram.
LEAVE = 4_000_000
#: Cuts of a bracket that holds more.
CUTS = 200


def to_long(df: DataFrame, cols: list[str], keep: list[str] | None = None) -> DataFrame:
    """``(keep..., feature, value double)``, one row per non-null cell."""
    keep = list(keep or [])
    cells = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value"))
                      for c in cols])
    return (df.select(*keep, F.inline(cells))
              .where(F.col("value").isNotNull()))


def local_frame(spark, rows: list[tuple], fields: list[tuple[str, str]]) -> DataFrame:
    """A small local relation (no job, no task reads it from Python)."""
    kinds = {"string": pa.string(), "double": pa.float64(), "bigint": pa.int64(), "int": pa.int32()}
    return spark.createDataFrame(pa.table({
        name: pa.array([r[i] for r in rows], kinds[kind]) for i, (name, kind) in enumerate(fields)}))


def quantiles(df: DataFrame, cols: list[str], probs: list[float], method: str = "exact",
              accuracy: int = 10000) -> DataFrame:
    """Long local frame ``(feature string, p double, q double)``; ``q`` is
    NULL for an all-null column."""
    if method not in ("exact", "approx"):
        raise ValueError(f"unknown method {method}")
    probs = [float(p) for p in probs]
    if method == "approx":
        found = _sketch(df, cols, probs, accuracy)[1]
        rows = [(c, p, None if q is None else q[i]) for c, q in zip(cols, found) for i, p in enumerate(probs)]
    else:
        rows = _exact(df, cols, probs)
    return local_frame(df.sparkSession, rows, [("feature", "string"), ("p", "double"), ("q", "double")])


def _sketch(df: DataFrame, cols: list[str], at: list[float], accuracy: int) -> tuple[list[int], list]:
    """Per column its count of values and approximate quantiles ``at``."""
    grid = F.array(*[F.lit(p) for p in at])
    aggs = [a for c in cols for a in (F.count(c), F.percentile_approx(F.col(c).cast("double"), grid, accuracy))]
    row = df.agg(*aggs).first()
    return list(row[0::2]), list(row[1::2])


@dataclass(frozen=True)
class Bracket:
    """Values ``lo`` to ``hi`` (None: open) that should hold the ranks
    ``first`` and ``last``; ``below`` and ``inside`` are exact row counts."""
    col: str
    first: int
    last: int
    lo: float | None
    hi: float | None
    below: int = 0
    inside: int = 0

    def under(self) -> Column:
        return F.lit(False) if self.lo is None else F.col(self.col).cast("double") < F.lit(self.lo)

    def holds(self) -> Column:
        v = F.col(self.col).cast("double")
        ends = ([v >= F.lit(self.lo)] if self.lo is not None else []) + ([v <= F.lit(self.hi)] if self.hi is not None else [])
        return ends[0] & ends[1] if len(ends) == 2 else ends[0] if ends else v.isNotNull()


def _counted(df: DataFrame, brackets: list[Bracket]) -> list[Bracket]:
    """The brackets with their counts (one scan), opened until each holds its
    ranks."""
    out, todo = {}, dict(enumerate(brackets))
    while todo:
        row = df.agg(*[F.count_if(x) for b in todo.values() for x in (b.under(), b.holds())]).first()
        again = {}
        for (i, b), below, inside in zip(todo.items(), row[0::2], row[1::2]):
            lo = b.lo if below <= b.first else None
            hi = b.hi if b.last < below + inside else None
            if (lo, hi) == (b.lo, b.hi):
                out[i] = replace(b, below=below, inside=inside)
            else:
                again[i] = replace(b, lo=lo, hi=hi)
        todo = again
    return [out[i] for i in range(len(brackets))]


def _merged(brackets: list[Bracket]) -> list[tuple[Bracket, list[int]]]:
    """Overlapping brackets of a column as one, each with the numbers of its
    parts; in no two of them lies the same value."""
    out: list[tuple[Bracket, list[int]]] = []
    low = lambda b: (b.col, -math.inf if b.lo is None else b.lo, b.lo is not None)
    for i, b in sorted(enumerate(brackets), key=lambda x: low(x[1])):
        if out and (last := out[-1][0]).col == b.col and (last.hi is None or b.lo is None or b.lo <= last.hi):
            end = max(last.below + last.inside, b.below + b.inside)
            hi = None if last.hi is None or b.hi is None else max(last.hi, b.hi)
            out[-1] = replace(last, hi=hi, inside=end - last.below), [*out[-1][1], i]
        else:
            out.append((b, [i]))
    return out


def _cells(df: DataFrame, brackets: list[Bracket]) -> DataFrame:
    """``(_b, value)``: the values in each of the disjoint brackets.  One cell
    a column, filtered once it is generated: a filter on the columns
    themselves would be pushed into what computes them, whose constraints
    double with each of its columns."""
    cells = []
    for c in dict.fromkeys(b.col for b in brackets):
        code = F.lit(None).cast("int")
        for i, b in enumerate(brackets):
            code = F.when(b.holds(), F.lit(i)).otherwise(code) if b.col == c else code
        cells.append(F.struct(code.alias("_b"), F.col(c).cast("double").alias("value")))
    return df.select(F.inline(F.array(*cells))).where(F.col("_b").isNotNull())


def _narrowed(df: DataFrame, brackets: list[Bracket]) -> list[Bracket]:
    """Cut brackets of more than ``LEAVE`` rows until none can be cut."""
    while wide := [(m, parts) for m, parts in _merged(brackets) if m.inside > LEAVE and m.lo != m.hi]:
        grid = F.array(*[F.lit(k / CUTS) for k in range(CUTS + 1)])
        cuts = dict(_cells(df, [m for m, _ in wide]).groupBy("_b").agg(F.percentile_approx("value", grid, 10 * CUTS)).collect())
        new = {}
        for k, (m, parts) in enumerate(wide):
            for i in parts:
                b = brackets[i]
                at = CUTS * (b.first - m.below) / m.inside, CUTS * (b.last - m.below) / m.inside
                new[i] = replace(b, lo=cuts[k][max(0, math.floor(at[0]) - 1)], hi=cuts[k][min(CUTS, math.ceil(at[1]) + 1)])
        new = dict(zip(new, _counted(df, list(new.values()))))
        less = any(n.inside < brackets[i].inside for i, n in new.items())
        brackets = [new.get(i, b) for i, b in enumerate(brackets)]
        if not less:    # what is left is ties: its histogram is short
            break
    return brackets


def _exact(df: DataFrame, cols: list[str], probs: list[float]) -> list[tuple]:
    margin = 2.5 / SKETCH
    ends = sorted({min(1.0, max(0.0, p + d)) for p in probs for d in (-margin, margin)})
    counts, found = _sketch(df, cols, ends, SKETCH)
    brackets, of = [], {}
    for c, n, q in zip(cols, counts, found):
        for p in probs if n else []:
            h = (n - 1) * p
            lo, hi = (q[ends.index(min(1.0, max(0.0, p + d)))] for d in (-margin, margin))
            of[c, p] = len(brackets), h
            brackets.append(Bracket(c, math.floor(h), math.ceil(h), None if p <= margin else lo, None if p >= 1 - margin else hi))
    brackets = _narrowed(df, _counted(df, brackets)) if brackets else []

    # a bracket of one value needs no histogram
    picked = {(i, r): b.lo for i, b in enumerate(brackets) if b.lo is not None and b.lo == b.hi for r in (b.first, b.last)}
    todo = [i for i, b in enumerate(brackets) if (i, b.first) not in picked]
    if todo:
        merged = _merged([brackets[i] for i in todo])
        hist = _cells(df, [m for m, _ in merged]).groupBy("_b", "value").agg(F.count(F.lit(1)).alias("n"))
        w = Window.partitionBy("_b").orderBy("value").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        cum = hist.withColumn("_cum", F.sum("n").over(w))
        # the wanted ranks of each merged bracket, counted from its start
        wanted = [sorted({r - m.below for k in parts for b in (brackets[todo[k]],) for r in (b.first, b.last)}) for m, parts in merged]
        ranks = F.array(*[F.array(*[F.lit(r).cast("long") for r in rs]) for rs in wanted])
        hit = F.filter(ranks[F.col("_b")], lambda r: (r >= F.col("_cum") - F.col("n")) & (r < F.col("_cum")))
        found = {(j, r): v for j, v, rs in cum.select("_b", "value", hit.alias("r")).where(F.size("r") > 0).collect() for r in rs}
        for j, (m, parts) in enumerate(merged):
            for i in (todo[k] for k in parts):
                picked |= {(i, r): found[j, r - m.below] for r in (brackets[i].first, brackets[i].last)}
    rows = []
    for c in cols:
        for p in probs:
            if (c, p) not in of:
                rows.append((c, p, None))
                continue
            i, h = of[c, p]
            lo, hi = picked[i, brackets[i].first], picked[i, brackets[i].last]
            rows.append((c, p, lo if lo == hi else lo + (hi - lo) * (h - math.floor(h))))
    return rows


def quantile_row(df: DataFrame, cols: list[str], p: float, method: str = "exact") -> DataFrame:
    """One-row frame with one column per input column holding its p-quantile."""
    got = {f: q for f, _, q in quantiles(df, cols, [p], method).collect()}
    return local_frame(df.sparkSession, [tuple(got[c] for c in cols)], [(c, "double") for c in cols])


def iqr_fences(df: DataFrame, cols: list[str], k: float = 1.5, method: str = "exact") -> DataFrame:
    """A4: ``(feature, q1, q3, iqr, lower, upper)``, one row per column."""
    got = {(f, p): q for f, p, q in quantiles(df, cols, [0.25, 0.75], method).collect()}
    rows = []
    for c in dict.fromkeys(cols):
        q1, q3 = got[c, 0.25], got[c, 0.75]
        rows.append((c, q1, q3, q3 - q1, q1 - k * (q3 - q1), q3 + k * (q3 - q1)) if q1 is not None else (c, *[None] * 5))
    return local_frame(df.sparkSession, rows, [("feature", "string"), *[(n, "double") for n in ("q1", "q3", "iqr", "lower", "upper")]])


def stats_literals(stats: DataFrame, key: str, fields: list[str], cols: list[str]) -> dict[str, dict[str, Column]]:
    """``s[col][field]`` as literals, from a fitted frame of one row a column
    (columns x fields numbers: bounded).  Row expressions read them without
    a join or a subquery; a column without a row has NULLs."""
    kinds = {f: stats.schema[f].dataType for f in fields}
    got = {r[key]: r for r in stats.select(key, *fields).collect()}
    return {c: {f: F.lit(got[c][f] if c in got else None).cast(kinds[f]) for f in fields} for c in cols}
