"""Classification metrics as expressions over four integer sums.

``n`` rows, ``p`` positives, ``pp`` predicted positives, ``tp`` true positives. Every other
count follows from these, so one hash aggregate feeds every metric.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .scalar import col, ratio

SUMS = ["n", "p", "pp", "tp", "bp", "btp", "q11"]


def row_sums(y: str = "y_true", yhat: str = "y_pred", base: str | None = "base_pred") -> list[Column]:
    """Aggregates to take once; with ``base`` also the baseline and joint counts."""
    out = [F.count(F.lit(1)).alias("n"), F.sum(y).alias("p"), F.sum(yhat).alias("pp"),
           F.sum(F.col(y) * F.col(yhat)).alias("tp")]
    if base:
        out += [F.sum(base).alias("bp"), F.sum(F.col(y) * F.col(base)).alias("btp"),
                F.sum(F.col(yhat) * F.col(base)).alias("q11")]
    return out


def resum(cols: list[str] = SUMS) -> list[Column]:
    return [F.sum(c).alias(c) for c in cols]


def macro_f1(n="n", p="p", pp="pp", tp="tp") -> Column:
    n, p, pp, tp = col(n), col(p), col(pp), col(tp)
    up = F.coalesce(ratio(2 * tp, p + pp), F.lit(0.0))
    tn = n - p - pp + tp
    down = F.coalesce(ratio(2 * tn, 2 * n - p - pp), F.lit(0.0))
    return F.when(n > 0, (up + down) / 2)


def base_f1(n="n", p="p", bp="bp", btp="btp") -> Column:
    return macro_f1(n, p, bp, btp)


def delta_f1() -> Column:
    return macro_f1() - base_f1()


def constant_f1(constant: Column | int, n="n", p="p") -> Column:
    """Macro-F1 of always predicting ``constant``; needs supports only."""
    n, p = col(n), col(p)
    up, down = macro_f1(n, p, n, p), macro_f1(n, p, 0 * n, 0 * p)
    if isinstance(constant, int):
        return up if constant == 1 else down
    return F.when(constant == 1, up).otherwise(down)


def accuracy(n="n", p="p", pp="pp", tp="tp") -> Column:
    n, p, pp, tp = col(n), col(p), col(pp), col(tp)
    return ratio(n - p - pp + 2 * tp, n)


def balanced_accuracy(n="n", p="p", pp="pp", tp="tp") -> Column:
    """Mean recall over the classes present in y_true."""
    n, p, pp, tp = col(n), col(p), col(pp), col(tp)
    up, down = ratio(tp, p), ratio(n - p - pp + tp, n - p)
    return F.when(p == 0, down).when(p == n, up).otherwise((up + down) / 2)


def mcc(n="n", p="p", pp="pp", tp="tp") -> Column:
    """Null when y_true has one class; 0 when the predictions have one class."""
    n, p, pp, tp = (c.cast("double") for c in (col(n), col(p), col(pp), col(tp)))
    cov = n * tp - p * pp
    spread = F.sqrt(p * (n - p)) * F.sqrt(pp * (n - pp))
    return (F.when((p == 0) | (p == n), F.lit(None).cast("double"))
            .when((pp == 0) | (pp == n), F.lit(0.0)).otherwise(F.try_divide(cov, spread)))


def precision_up(pp="pp", tp="tp") -> Column:
    return F.coalesce(ratio(tp, pp), F.lit(0.0))


def recall_up(p="p", tp="tp") -> Column:
    return F.coalesce(ratio(tp, p), F.lit(0.0))
