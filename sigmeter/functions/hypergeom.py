"""Hypergeometric draws by inversion, vectorised over Arrow batches.

Shuffling the labels inside a block matters to a confusion count only through how many of the
block's positives land on its predicted rows, which is hypergeometric in the block's counts.
One draw per (permutation, block) therefore replaces one shuffle of every row. SQL has no such
draw and a higher-order fold costs a boxed row per step, so this is a small numpy helper.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F


def invert(u: np.ndarray, total: np.ndarray, good: np.ndarray, drawn: np.ndarray) -> np.ndarray:
    """Number of ``good`` among ``drawn`` of ``total``, at uniform ``u``.

    The mass is walked by its ratio recurrence from a start far in the lower tail, so no
    factorials are needed. The walk spans 12 standard deviations either side of the mean
    (below double precision beyond), hence its length grows with the root of the block size;
    finished elements leave the loop, so one large block does not slow a batch of small ones.
    """
    n, k, d = (np.asarray(v, dtype=float) for v in (total, good, drawn))
    u = np.asarray(u, dtype=float)
    share = np.divide(k, n, out=np.zeros_like(n), where=n > 0)
    shrink = np.divide(n - d, n - 1, out=np.zeros_like(n), where=n > 1)
    reach = 12 * np.sqrt(np.maximum(d * share * (1 - share) * shrink, 0)) + 12
    lo = np.maximum(np.maximum(0, d + k - n), np.floor(d * share - reach))
    hi = np.maximum(lo, np.minimum(np.minimum(d, k), np.ceil(d * share + reach)))

    def walk(limit: np.ndarray | None) -> np.ndarray:
        """Total mass, or with ``limit`` the first value whose running mass exceeds it."""
        out = np.zeros(len(n)) if limit is None else hi.copy()
        live = np.arange(len(n))
        x, w, s = lo.copy(), np.ones(len(n)), np.zeros(len(n))
        while live.size:
            s = s + w
            if limit is None:
                stop = x >= hi[live]
                out[live[stop]] = s[stop]
            else:
                found = s > limit[live]
                out[live[found]] = x[found]
                stop = found | (x >= hi[live])
            go = ~stop
            live, x, w, s = live[go], x[go], w[go], s[go]
            kk, dd, nn = k[live], d[live], n[live]
            w = w * (kk - x) * (dd - x) / ((x + 1) * (nn - kk - dd + x + 1))
            x = x + 1
        return out

    return walk(u * walk(None)).astype(np.int64)


def shuffled_true_positives(u1: Column, u2: Column, u3: Column) -> Column:
    """(tp, btp) of a block's shuffled labels from its counts n, p, pp, bp and q11.

    The cells (predicted by both, by the model alone, by the baseline alone) receive the
    block's positives one after the other.
    """
    @F.pandas_udf("tp long, btp long")
    def draw(a: pd.Series, b: pd.Series, c: pd.Series, n: pd.Series, p: pd.Series, pp: pd.Series, bp: pd.Series,
             q11: pd.Series) -> pd.DataFrame:
        n, p, pp, bp, q = (v.to_numpy(dtype=float) for v in (n, p, pp, bp, q11))
        both = invert(a.to_numpy(), n, p, q)
        model = invert(b.to_numpy(), n - q, p - both, pp - q)
        base = invert(c.to_numpy(), n - pp, p - both - model, bp - q)
        return pd.DataFrame({"tp": both + model, "btp": both + base})

    return draw(u1, u2, u3, F.col("n"), F.col("p"), F.col("pp"), F.col("bp"), F.col("q11"))


def random_prefix_errors(steps: Column, uniforms: Column) -> Column:
    """Mean risk over the seeds at each prefix of a random order.

    ``steps`` holds the prefix lengths and ``uniforms`` as many uniforms per level as there are steps. Column
    n counts all samples; column wrong counts those wrong for all seeds, for all but one, and so on down
    to one seed.
    """
    @F.pandas_udf("array<double>")
    def curve(ks: pd.Series, us: pd.Series, n: pd.Series, wrong: pd.Series) -> pd.Series:
        k = np.array(ks.tolist(), dtype=float)
        rows, width = k.shape
        u = np.array(us.tolist(), dtype=float).reshape(rows, -1, width)
        left, rest = n.to_numpy(dtype=float), np.array(wrong.tolist(), dtype=float)
        seeds = rest.shape[1]
        done, errors = np.zeros(rows), np.zeros(rows)
        out = np.empty_like(k)
        for i in range(width):
            take = k[:, i] - done
            pool, want = left.copy(), take.copy()
            for level in range(seeds):
                x = invert(u[:, level, i], pool, rest[:, level], want)
                errors += x * (seeds - level) / seeds
                pool, want = pool - rest[:, level], want - x
                rest[:, level] -= x
            left, done = left - take, k[:, i]
            out[:, i] = errors / k[:, i]
        return pd.Series(list(out))

    return curve(steps, uniforms, F.col("n"), F.col("wrong"))
