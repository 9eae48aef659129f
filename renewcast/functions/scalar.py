"""Column -> Column scalar functions (all JVM-side, codegen friendly).

ANSI mode is on in Spark 4: division by zero and malformed casts raise, so
every ratio is guarded and every parse uses the ``try_`` variants.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnOrName = Column | str


def _c(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


def parse_yyyymmdd(c: ColumnOrName) -> Column:
    """int or text ``yyyyMMdd`` -> DATE; malformed text gives null."""
    return F.try_to_date(_c(c).cast("string"), "yyyyMMdd")


def parse_iso_date(c: ColumnOrName) -> Column:
    """ISO text (``yyyy-MM-dd``, optionally with a time part) -> DATE; bad text gives null."""
    s = _c(c).cast("string")
    return F.try_to_date(F.substring(s, 1, 10), "yyyy-MM-dd")


def membership_start(expire: ColumnOrName, plan_days: ColumnOrName) -> Column:
    """Period start = expiry - plan days."""
    return F.date_sub(_c(expire), _c(plan_days).cast("int"))


def discount_ratio(list_price: ColumnOrName, paid: ColumnOrName) -> Column:
    """(list - paid) / list when list is non-zero, else 0 (a null list price gives 0)."""
    lp, pd_ = _c(list_price), _c(paid)
    return F.when(lp != 0, (lp - pd_) / lp).otherwise(F.lit(0.0))


def sum_songs(*counts: ColumnOrName) -> Column:
    """Sum of play counts; null if any count is null (plain ``+``)."""
    cols = [_c(x) for x in counts]
    out = cols[0]
    for x in cols[1:]:
        out = out + x
    return out


def guarded_ratio(num: ColumnOrName, den: ColumnOrName) -> Column:
    """num / den, 0 when den = 0, null when den is null."""
    n, d = _c(num), _c(den)
    return F.when(d == 0, F.lit(0.0)).otherwise(n / d)


def smoothed_ratio(a: ColumnOrName, b: ColumnOrName, eps: float = 0.01) -> Column:
    """0 when a = 0, else (a + eps) / (b + eps); a zero denominator gives null."""
    x, y = _c(a), _c(b)
    return F.when(x == 0, F.lit(0.0)).otherwise(F.try_divide(x + F.lit(eps), y + F.lit(eps)))


def days_between(later: ColumnOrName, earlier: ColumnOrName) -> Column:
    """Whole days from ``earlier`` to ``later`` (int)."""
    return F.datediff(_c(later), _c(earlier))


def plan_days(start: ColumnOrName, expire: ColumnOrName) -> Column:
    return F.datediff(_c(expire), _c(start))


def account_age(period_start: ColumnOrName, registered: ColumnOrName) -> Column:
    """Days from registration to period start (negative allowed)."""
    return F.datediff(_c(period_start), _c(registered))


def clamp_non_negative(c: ColumnOrName) -> Column:
    """Negative -> 0; null stays null (``greatest`` would turn null into 0)."""
    x = _c(c)
    return F.when(x < 0, F.lit(0)).otherwise(x)


def churn_flag(days_diff: ColumnOrName, grace: int = 5, never_returned: int = 0) -> Column:
    """1 when the gap exceeds ``grace``; a member who never returned gets ``never_returned``."""
    d = _c(days_diff)
    return (
        F.when(d.isNull(), F.lit(never_returned))
        .when(d > grace, F.lit(1))
        .otherwise(F.lit(0))
        .cast("int")
    )


def bin_by_edges(c: ColumnOrName, edges: Sequence[float], labels: Sequence) -> Column:
    """Right-closed bins (e0, e1] -> labels[0], (e1, e2] -> labels[1] ...; outside -> null."""
    if len(labels) != len(edges) - 1:
        raise ValueError("need len(edges) - 1 labels")
    x = _c(c)
    out = None
    for lo, hi, lab in zip(edges[:-1], edges[1:], labels):
        cond = x > lo
        if hi != float("inf"):
            cond = cond & (x <= hi)
        out = F.when(cond, F.lit(lab)) if out is None else out.when(cond, F.lit(lab))
    return out


def map_rare(c: ColumnOrName, keep: Iterable[str], other: str = "99") -> Column:
    """Keep listed categories, anything else (null included) -> ``other``."""
    x = _c(c)
    keep = list(keep)
    return F.when(x.isin(keep), x).otherwise(F.lit(other))


def binarize(score: ColumnOrName, threshold: float | Column) -> Column:
    """score >= threshold -> 1 else 0 (null score stays null)."""
    t = threshold if isinstance(threshold, Column) else F.lit(threshold)
    return (_c(score) >= t).cast("int")


def fill_missing(df, values: dict):
    """null -> constant per column (``gender`` -> 'na' in the member layer)."""
    return df.fillna(values)
