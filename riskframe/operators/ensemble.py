"""Score tables and ensembles: U1, J1, J2, E1-E7, F4.

Scores are long ``(row_id, model, y, score)``.  Blends that only combine a
row's own scores are a ``groupBy(row_id)`` (or a plain expression on a
wide frame); the weight search writes distinct score tuples once, as blocks
that tasks read again for their candidates.
"""

from __future__ import annotations

import itertools

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from riskframe.operators.metrics import ranking_metrics
from riskframe.operators.quantiles import local_frame
from riskframe.operators.rank import average_rank
from riskframe.session import materialise


def stack_scores(wide: DataFrame, models: dict[str, str], keep: list[str] | None = None) -> DataFrame:
    """Wide ``(row_id, y, <score cols>)`` -> long ``(row_id, y, model, score)``
    by a generator (no shuffle)."""
    keep = keep or ["row_id", "y"]
    rows = F.array(*[F.struct(F.lit(m).alias("model"), F.col(c).cast("double").alias("score"))
                     for m, c in models.items()])
    return wide.select(*keep, F.inline(rows))


def union_scores(frames: dict[str, DataFrame]) -> DataFrame:
    """U1 for per-model frames ``(row_id, y, score)``: ``unionByName``."""
    out = None
    for m, f in frames.items():
        f = f.select("row_id", "y", F.lit(m).alias("model"), F.col("score").cast("double"))
        out = f if out is None else out.unionByName(f)
    return out


def align_by_row(left: DataFrame, right: DataFrame, key: str = "row_id") -> DataFrame:
    """1:1 alignment on an explicit row key (inner equi-join)."""
    return left.join(right, key, "inner")


def apply_scalar_stats(df: DataFrame, stats: DataFrame) -> DataFrame:
    """Attach a one-row stats frame to every row as columns of a scalar
    subquery (bounded literal; no join)."""
    s = stats.select(F.struct(*stats.columns).alias("s")).scalar()
    return df.select("*", *[s[c].alias(c) for c in stats.columns])


def mean_blend(scores: DataFrame, name: str = "score") -> DataFrame:
    """Equal-weight mean across models per row."""
    return scores.groupBy("row_id").agg(F.first("y").alias("y"), F.avg("score").alias(name))


def weighted_blend(scores: DataFrame, weights: dict[str, float], normalise: bool = True,
                   name: str = "score") -> DataFrame:
    """``sum(w * score)`` per row; weights normalised to sum 1.

    The weights are a plan-time literal map (one entry per model)."""
    src = scores.where(F.col("model").isin(list(weights)))
    return src.groupBy("row_id").agg(F.first("y").alias("y"),
                                     F.sum(_weight_of(weights, normalise)[F.col("model")] * F.col("score")).alias(name))


def _weight_of(weights: dict[str, float], normalise: bool = True) -> Column:
    tot = sum(weights.values())
    ws = {m: (w / tot if normalise and tot else w) for m, w in weights.items()}
    return F.create_map(*[x for m, w in ws.items() for x in (F.lit(m), F.lit(float(w)))])


def rank_blend(scores: DataFrame, weights: dict[str, float] | None = None, name: str = "score",
               per_n: bool = True) -> DataFrame:
    """Mean (or weighted mean) of per-model ``rank / n`` (W1,
    computed once; ``per_n=False`` blends raw average ranks)."""
    r = model_ranks(scores, per_n)
    if weights is None:
        return mean_blend(r, name)
    return weighted_blend(r, weights, True, name)


def model_ranks(scores: DataFrame, per_n: bool = True) -> DataFrame:
    """``(row_id, y, model, score)`` with W1's per-model ``rank / n`` (or raw
    average rank) in place of the score."""
    ranked = average_rank(scores, "score", ["model"], "rank_pct", per_n)
    return ranked.select("row_id", "y", "model", F.col("rank_pct").alias("score"))


def rank_blends(scores: DataFrame, blends: dict[str, dict[str, float] | None], per_n: bool = True) -> DataFrame:
    """Several ``rank_blend`` of the same scores, ``(row_id, y, score,
    model=<blend>)``: ranked once, all blends in one ``groupBy(row_id)``."""
    parts = []
    for i, (blend, weights) in enumerate(blends.items()):
        if weights is None:
            on, score = F.lit(True), F.avg("score")
        else:
            on = F.col("model").isin(list(weights))
            score = F.sum(F.when(on, _weight_of(weights)[F.col("model")] * F.col("score")))
        parts += [score.alias(f"_s{i}"), F.max(on).alias(f"_in{i}")]
    wide = model_ranks(scores, per_n).groupBy("row_id").agg(F.first("y").alias("y"), *parts)
    rows = F.array(*[F.struct(F.col(f"_s{i}").alias("score"), F.lit(b).alias("model"), F.col(f"_in{i}").alias("_in"))
                     for i, b in enumerate(blends)])
    return wide.select("row_id", "y", F.inline(rows)).where("_in").drop("_in")


# ---- E5 weight search ------------------------------------------------------

def simplex_grid(n_models: int, steps: int) -> list[tuple[float, ...]]:
    """Lattice points of the weight simplex with spacing ``1/steps``."""
    pts = []
    for c in itertools.product(range(steps + 1), repeat=n_models - 1):
        if sum(c) <= steps:
            pts.append(tuple(x / steps for x in c) + ((steps - sum(c)) / steps,))
    return pts


def random_simplex(n_models: int, n: int, seed: int = 42) -> list[tuple[float, ...]]:
    """Seeded normalised uniform draws (all-zero draws give zero weights)."""
    rng = np.random.default_rng(seed)
    out = []
    for w in rng.uniform(0.0, 1.0, size=(n, n_models)):
        t = w.sum()
        out.append(tuple(float(x / t) if t else 0.0 for x in w))
    return out


def sequential_simplex(n: int, seed: int = 42) -> list[tuple[float, float, float]]:
    """Seeded 3-model draws: ``w1 ~ U(0, 1)``, ``w2 ~ U(0, 1 - w1)``,
    ``w3 = 1 - w1 - w2`` (the sequential-remainder scheme)."""
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(n):
        w1 = float(rng.uniform(0.0, 1.0))
        w2 = float(rng.uniform(0.0, 1.0 - w1))
        out.append((w1, w2, 1.0 - w1 - w2))
    return out


def line_grid(n: int) -> list[tuple[float, float]]:
    """2-model blends ``(w, 1 - w)`` for ``n`` evenly spaced ``w`` in [0, 1]."""
    return [(float(w), float(1.0 - w)) for w in np.linspace(0.0, 1.0, n)]


#: Distinct tuples of a candidate that are ranked at a time, about.
SLICE_ROWS = 1 << 22
#: Rows of the sample whose blends bound the slices, about.
BOUND_ROWS = 20_000
#: Scores (rows x candidates) that a task holds, about.
CELLS = 3 << 23
#: Tuples of a block, and of those that are cut into blocks together.
BLOCK_ROWS, CUT_ROWS = 1 << 14, 1 << 20
#: Tuples that a block gives to the sample.
BLOCK_SAMPLE = 16
#: Scans of the blocks in one job.
SCANS = 64


def weight_search(wide: DataFrame, cols: list[str], candidates: list[tuple[float, ...]],
                  y: str = "y") -> DataFrame:
    """E5: ROC-AUC of ``sum_i w_i * s_i`` for every candidate weight vector,
    ``(candidate, weights array<double>, roc_auc)``, exact with ties.

    Rows are first reduced to distinct ``(y, s_1..s_k)`` tuples with counts:
    the only shuffle, whatever the number of candidates.  The tuples are
    written once, as blocks of near ones with their bounds.  A task then reads
    the blocks for a few candidates and one score slice of each, and passes
    over a block whose bounds put it elsewhere; it blends, sorts and ranks
    what is left, and returns three numbers a candidate.  The AUC adds up from
    slices and the counts below them.  So neither scores nor copies of tuples
    are shuffled or written; tasks read the blocks about ``n / SLICE_ROWS``
    times a group of candidates.  Slices are bounded by a sample of blends,
    which only balances them; where a hot score fills a slice, equal scores
    become one entry.  Rows without a score or label are skipped.  Runs when
    it is called."""
    spark = wide.sparkSession
    weights = np.array([list(w) for w in candidates], dtype=np.float64).reshape(len(candidates), len(cols))
    ok = F.col(y).isNotNull()
    for c in cols:
        ok = ok & F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double"))
    src = wide.where(ok).select(F.col(y).cast("int").alias("y"), *[F.col(c).cast("double").alias(f"s{i}") for i, c in enumerate(cols)])
    scores = [f"s{i}" for i in range(len(cols))]
    tuples = src.groupBy("y", *scores).agg(F.count(F.lit(1)).alias("n"))
    blocks = materialise(tuples.select("n", "y", *scores).mapInArrow(
        _tuple_blocks, "size long, some array<double>, lo array<double>, hi array<double>, kind string, p binary, q binary, s binary"),
        "score-blocks")
    n, n_blocks = blocks.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count(F.lit(1))).first()
    n_slices = max(1, -(-n // SLICE_ROWS))
    bounds = np.full((len(weights), n_slices + 1), np.inf)
    if n_slices > 1:
        share = min(1.0, BOUND_ROWS / BLOCK_SAMPLE / n_blocks)
        some = blocks.sample(share, seed=7).select("some").limit(2 * BOUND_ROWS // BLOCK_SAMPLE).collect()
        some = np.concatenate([np.array(r[0], dtype=np.float64) for r in some] or [np.zeros(0)]).reshape(-1, len(cols))
        at = [k / n_slices for k in range(1, n_slices)]
        if len(some):
            bounds[:, 1:-1] = [np.quantile(_blend(some, w), at, method="nearest") for w in weights]

    # a task: some candidates, one slice of each
    few = max(1, min(CELLS // max(1, min(n, SLICE_ROWS)), -(-len(weights) // spark.sparkContext.defaultParallelism)))
    tasks = [(np.arange(lo, min(lo + few, len(weights))), j) for j in range(n_slices) for lo in range(0, len(weights), few)] if n else []
    ranked = []
    for lo in range(0, len(tasks), SCANS):
        scans = [blocks.drop("some").coalesce(1).mapInArrow(
            _slice_ranker(of, j, n_slices, weights[of], bounds[of, j], bounds[of, j + 1]),
            "candidate int, slice int, pos long, neg long, inner double") for of, j in tasks[lo:lo + SCANS]]
        # a union of frames would put scans of one partition each into one task
        ranked += spark.sparkContext.union([scan.rdd for scan in scans]).collect()     # one row a (candidate, slice)
    aucs = [None] * len(weights)
    for c, parts in itertools.groupby(sorted(ranked), lambda r: r.candidate):
        pos, neg, area = 0, 0, 0.0
        for r in parts:
            area += r.inner + float(r.pos) * neg
            pos, neg = pos + r.pos, neg + r.neg
        aucs[c] = area / (float(pos) * neg) if pos * neg else None
    # a draw whose weights are all zero scores 0 (it defines no blend)
    table = local_frame(spark, [(i, *map(float, w), a if any(w) else 0.0) for i, (w, a) in enumerate(zip(candidates, aucs))],
                        [("candidate", "int"), *[(f"w{i}", "double") for i in range(len(cols))], ("roc_auc", "double")])
    return table.where(F.lit(bool(tasks))).select("candidate", F.array(*[f"w{i}" for i in range(len(cols))]).alias("weights"), "roc_auc")


def _near_pieces(s: np.ndarray, rows: np.ndarray):
    """``rows`` in pieces of at most ``BLOCK_ROWS``, cut at the median of the
    widest column of ``s`` each time."""
    if len(rows) <= BLOCK_ROWS:
        yield rows
        return
    part = s[:, rows]
    with np.errstate(invalid="ignore"):
        wide = np.nan_to_num(np.ptp(part, axis=1), nan=np.inf).argmax()
    order = np.argpartition(part[wide], len(rows) // 2)
    yield from _near_pieces(s, rows[order[:len(rows) // 2]])
    yield from _near_pieces(s, rows[order[len(rows) // 2:]])


def _tuple_blocks(batches):
    """Tuples ``(n, y, s_1..s_k)`` as blocks: ``size`` rows, ``some`` of their
    scores, each score's bounds, then weights of positives and negatives
    (numbers of the type ``kind``) and scores, column by column, as bytes."""
    import pyarrow as pa
    kinds = {"size": pa.int64(), "some": pa.list_(pa.float64()), "lo": pa.list_(pa.float64()), "hi": pa.list_(pa.float64()),
             "kind": pa.string(), "p": pa.binary(), "q": pa.binary(), "s": pa.binary()}

    def cut(held):
        t = pa.Table.from_batches(held)
        num = t["n"].to_numpy()
        pos = t["y"].to_numpy() * num
        neg = num - pos
        s = np.stack([t.column(i).to_numpy() for i in range(2, t.num_columns)])
        rng = np.random.default_rng(7)
        out = []
        for rows in _near_pieces(s, np.arange(len(num))):
            p, q, part = pos[rows], neg[rows], np.ascontiguousarray(s[:, rows])
            kind = "u1" if min(p.min(), q.min()) >= 0 and max(p.max(), q.max()) < 256 else "i8"
            some = part[:, rng.integers(0, len(rows), BLOCK_SAMPLE)].T.ravel()
            out.append((len(rows), some, part.min(axis=1), part.max(axis=1), kind, p.astype(kind).tobytes(), q.astype(kind).tobytes(), part.tobytes()))
        for r in out:
            yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(r, kinds.values())], names=list(kinds))

    held = []
    for b in batches:
        if b.num_rows:
            held.append(b)
        if sum(x.num_rows for x in held) >= CUT_ROWS:
            yield from cut(held)
            held = []
    if held:
        yield from cut(held)


def _slice_ranker(of: np.ndarray, j: int, n_slices: int, weights: np.ndarray, above: np.ndarray, upto: np.ndarray):
    """Ranks the tuples of all blocks whose blends for the candidates ``of``
    lie in their slice ``j``, above ``above`` and up to ``upto``."""
    first, last = j == 0, j == n_slices - 1

    def held_as_one(parts):
        v = np.concatenate([x[0] for x in parts])
        v, at = np.unique(v, return_inverse=True)
        return [(v, *(np.bincount(at, weights=np.concatenate([x[i] for x in parts])).astype(np.int64) for i in (1, 2)))]

    def rank(batches):
        import pyarrow as pa
        held, size, most = [[] for _ in of], np.zeros(len(of), dtype=np.int64), np.full(len(of), 4 * SLICE_ROWS)
        for b in batches:
            for r in range(b.num_rows):
                lo, hi = (np.array(b.column(c)[r].as_py(), dtype=np.float64) for c in ("lo", "hi"))
                p, q = (np.frombuffer(b.column(c)[r].as_buffer(), dtype=b.column("kind")[r].as_py()) for c in ("p", "q"))
                s = np.frombuffer(b.column("s")[r].as_buffer(), dtype=np.float64).reshape(len(lo), -1).T
                with np.errstate(invalid="ignore", over="ignore"):
                    # rounding keeps the order, so the corners' blends bound those between
                    least, largest = (_blend_each(np.where(weights >= 0, x, z), weights) for x, z in ((lo, hi), (hi, lo)))
                    for c in np.flatnonzero(~((least > upto) & ~last | (largest <= above) & ~first)):
                        v = _blend(s, weights[c])
                        inside = None
                        if not first and not least[c] > above[c]:
                            inside = ~(v <= above[c])
                        if not last and not largest[c] <= upto[c]:
                            inside = (v <= upto[c]) if inside is None else inside & (v <= upto[c])
                        held[c].append((v, p, q) if inside is None else (v[inside], p[inside], q[inside]))
                        size[c] += len(held[c][-1][0])
                        if size[c] > most[c]:
                            held[c] = held_as_one(held[c])
                            size[c] = len(held[c][0][0])
                            most[c] = max(most[c], 2 * size[c])
        out = []
        for c, parts in enumerate(held):
            held[c] = None
            if size[c]:
                out.append((int(of[c]), j, *_ranked(*(np.concatenate([x[i] for x in parts]) for i in range(3)))))
        if out:
            kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], k) for i, k in enumerate(kinds)],
                                             names=["candidate", "slice", "pos", "neg", "inner"])
    return rank


def _ranked(v: np.ndarray, p: np.ndarray, q: np.ndarray) -> tuple[int, int, float]:
    """Weights of positives and of negatives, and the pairs of both in which
    the positive is above, a tie counting half.  NaN are equal and last."""
    v = v + 0.0     # one zero
    if np.isnan(v).any():
        v[np.isnan(v)] = np.nan
    if p.min() >= 0 and q.min() >= 0 and p.sum(dtype=np.int64) + q.sum(dtype=np.int64) <= 2 * len(v):
        # few repeat: rows of one label each, which goes with the score as its last bit
        if not np.all((p | q == 1) & (p != q)):
            n = [x.sum(dtype=np.int64) for x in (p, q)]
            v, p = np.concatenate([np.repeat(v, p), np.repeat(v, q)]), np.repeat(np.array([1, 0], dtype=np.uint8), n)
        key = v.view(np.int64)
        key = key ^ ((key >> 63) & np.int64(0x7FFFFFFFFFFFFFFF))
        key = key.view(np.uint64) - key.min().view(np.uint64)
        if key.max() < 1 << 63:
            key = (key << np.uint64(1)) | p.astype(np.uint64)
            key.sort()
            pos = (key & np.uint64(1)).astype(bool)
            below = np.cumsum(~pos)
            n = int(below[-1])
            inner = float(below[pos].sum())
            key >>= np.uint64(1)
            tied = np.flatnonzero(key[1:] == key[:-1])
            if len(tied):
                # positives come after equal negatives, which count half
                runs = np.flatnonzero(np.diff(tied, prepend=-2) > 1)
                starts = tied[runs]
                ends = tied[np.append(runs[1:], len(tied)) - 1] + 1
                negs = below[ends] - below[starts] + ~pos[starts]
                inner -= float((negs * (ends - starts + 1 - negs)).sum()) / 2
            return len(key) - n, n, inner
        q = 1 - p.astype(np.int64)
    order = np.argsort(v)
    v, p, q = v[order], p[order].astype(np.int64), q[order].astype(np.int64)
    starts = np.append(0, np.flatnonzero((v[1:] != v[:-1]) & ~np.isnan(v[:-1])) + 1)
    p, q = np.add.reduceat(p, starts), np.add.reduceat(q, starts)
    below = np.cumsum(q) - q
    return int(p.sum()), int(q.sum()), float((p * (below + q / 2.0)).sum())


def _blend_each(s: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """``_blend`` of row ``i`` of ``s`` by row ``i`` of ``weights``."""
    out = weights[:, 0] * s[:, 0]
    for i in range(1, weights.shape[1]):
        out = out + weights[:, i] * s[:, i]
    return out


def _blend(s: np.ndarray, w: np.ndarray) -> np.ndarray:
    """``w_1 s_1 + w_2 s_2 + ...``, added in that order."""
    out = w[0] * s[:, 0]
    for i in range(1, len(w)):
        out = out + w[i] * s[:, i]
    return out


def best_candidate(search: DataFrame) -> DataFrame:
    """T3 over E5: highest AUC, ties to the first candidate."""
    return search.agg(F.min_by(F.struct("candidate", "weights", "roc_auc"),
                               F.struct((-F.col("roc_auc")).alias("m"), F.col("candidate"))).alias("b")).select("b.*")


# ---- E6 / E7 / F4 ------------------------------------------------------------

def pick_method(results: DataFrame, metric: str = "roc_auc", priority: str = "priority") -> DataFrame:
    """The row with the higher metric; ties go to the lower ``priority``."""
    return results.agg(F.min_by(F.struct(*results.columns),
                                F.struct((-F.col(metric)).alias("m"), F.col(priority))).alias("b")).select("b.*")


def goal_check(df: DataFrame, metric: str, target: float | Column, name: str = "goal_met") -> DataFrame:
    """Flag, difference and relative change against a target/previous best."""
    t = target if isinstance(target, Column) else F.lit(float(target))
    return df.select("*", (F.col(metric) >= t).cast("int").alias(name),
                     (F.col(metric) - t).alias("delta"),
                     F.try_divide((F.col(metric) - t) * 100.0, t).alias("delta_pct"))


def qualify_models(scores: DataFrame, min_auc: float) -> DataFrame:
    """keep the scores of models whose ROC-AUC >= ``min_auc`` (left-semi
    join against the per-model AUC table, which has one row per model)."""
    aucs = ranking_metrics(scores, ["model"])
    keep = aucs.where(F.col("roc_auc") >= min_auc).select("model")
    return scores.join(F.broadcast(keep), "model", "left_semi")


def qualified_rank_blend(scores: DataFrame, min_auc: float, on_empty: str = "none") -> DataFrame:
    """F4 + E3: rank-average only the models with ROC-AUC >= ``min_auc``.

    With no survivor, ``on_empty="none"`` yields no rows (no ensemble) and
    ``"zeros"`` yields a 0.0 score for every row; one survivor is its own
    rank score."""
    blend = rank_blend(qualify_models(scores, min_auc))
    if on_empty == "none":
        return blend
    rows = scores.groupBy("row_id").agg(F.first("y").alias("y"))
    return (rows.join(blend.select("row_id", F.col("score").alias("_s")), "row_id", "left")
            .select("row_id", "y", F.coalesce("_s", F.lit(0.0)).alias("score")))


def ensemble_name(models: DataFrame, col: str = "model") -> Column:
    """Sorted model keys joined by ``_`` (one aggregate over the model list)."""
    return models.agg(F.array_join(F.sort_array(F.collect_set(col)), "_")).scalar()
