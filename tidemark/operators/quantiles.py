"""Exact quantiles of many columns without gathering the values of a column in one place."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SKETCH_ACCURACY = 10_000
FINAL_VALUES = 200_000
START = 4 / SKETCH_ACCURACY


@dataclass
class _Bracket:
    """Where a column's wanted ranks lie: ``below`` values are less than ``low``, ``inside`` lie between."""

    total: int
    first: int
    last: int
    below: int
    inside: int
    between: int
    low: float
    high: float
    margin: float = START

    def ends(self) -> list[float]:
        """The positions inside the bracket between which the sketch is asked to look."""
        middle = ((self.first + self.last) / 2 - self.below) / max(self.inside - 1, 1)
        return [max(middle - self.margin, 0.0), min(middle + self.margin, 1.0)]

    def narrow(self, lo: float, hi: float, less: int, held: int, strictly: int) -> bool:
        """Take the narrower bracket if the counts prove it; else widen the next one."""
        proved = self.below + less <= self.first and self.last < self.below + less + held
        if proved and strictly < self.between:
            self.low, self.high, self.between, self.margin = lo, hi, strictly, START
            self.below, self.inside = self.below + less, held
            return True
        self.margin *= 4
        return False


def _value(column: str) -> Column:
    """A column's values as doubles; NaN counts as missing."""
    v = F.col("`" + column.replace("`", "``") + "`").cast("double")
    return F.when(~F.isnan(v), v)


def _row(df: DataFrame, exprs: list[Column]) -> list:
    return list(df.agg(*[e.alias(str(i)) for i, e in enumerate(exprs)]).first()) if exprs else []


def exact_quantiles(df: DataFrame, columns: list[str], p: float, final_values: int = FINAL_VALUES) -> dict[str, float | None]:
    """The interpolated quantile of the non-null values of every column.

    A sketch of bounded size brackets the wanted ranks, counting the values below and inside proves the
    brackets, and they are narrowed the same way until few values lie between their ends. Only these come to
    the driver, each with its count, so a value held by any share of the rows is one row there. Every step is
    one scan for all columns together, with a map-side part: three scans where the first brackets are narrow
    enough, which they are up to about a thousand times ``final_values`` rows, and two more for each narrowing.
    """
    columns = list(dict.fromkeys(columns))
    v = [_value(c) for c in columns]
    guess = [max(p - START, 0.0), min(p + START, 1.0)]
    seen = _row(df, [e for x in v for e in (F.count(x), F.min(x), F.max(x), F.percentile_approx(x, guess, SKETCH_ACCURACY))])
    out: dict[str, float | None] = {}
    open_: dict[int, _Bracket] = {}
    asked: dict[int, list[float]] = {}
    for i, c in enumerate(columns):
        total, low, high, ends = seen[4 * i : 4 * i + 4]
        out[c] = None
        if total:
            rank = (total - 1) * p
            open_[i] = _Bracket(total, math.floor(rank), math.ceil(rank), 0, total, total, low, high)
            asked[i] = ends
    done: dict[int, _Bracket] = {}
    while open_:
        done |= {i: b for i, b in open_.items() if b.between <= final_values or b.low >= b.high}
        open_ = {i: b for i, b in open_.items() if i not in done}
        if not open_:
            break
        if not asked:
            exprs = [F.percentile_approx(F.when(v[i].between(b.low, b.high), v[i]), b.ends(), SKETCH_ACCURACY) for i, b in open_.items()]
            asked = dict(zip(open_, _row(df, exprs)))
        exprs = []
        for i, b in open_.items():
            lo, hi = asked[i]
            exprs += [
                F.count_if(v[i].between(b.low, b.high) & (v[i] < lo)), F.count_if(v[i].between(lo, hi)), F.count_if((v[i] > lo) & (v[i] < hi)),
            ]
        counts = _row(df, exprs)
        for n, (i, b) in enumerate(open_.items()):
            margin = b.margin
            if not b.narrow(*asked[i], *counts[3 * n : 3 * n + 3]) and margin >= 1:
                raise ArithmeticError(f"The values of {columns[i]} cannot be bracketed")
        asked = {}
    return out | _between(df, columns, v, done, p)


def _between(df: DataFrame, columns: list[str], v: list[Column], brackets: dict[int, _Bracket], p: float) -> dict[str, float]:
    """The quantiles from the values left in the brackets: one grouped count for all columns."""
    if not brackets:
        return {}
    left = F.array(*[F.struct(F.lit(i).alias("i"), F.when(v[i].between(b.low, b.high), v[i]).alias("v")) for i, b in brackets.items()])
    rows = df.select(F.explode(left).alias("x")).select("x.*").where("v is not null").groupBy("i", "v").count().collect()
    values: dict[int, list[tuple[float, int]]] = {i: [] for i in brackets}
    for r in rows:
        values[r["i"]].append((r["v"], r["count"]))
    out = {}
    for i, b in brackets.items():
        rank, passed, at_first = (b.total - 1) * p, b.below, None
        for value, n in sorted(values[i]):
            passed += n
            if at_first is None and passed > b.first:
                at_first = value
            if passed > b.last:
                out[columns[i]] = at_first if value == at_first else at_first + (value - at_first) * (rank - b.first)
                break
    return out


def exact_quantile(df: DataFrame, column: str, p: float, final_values: int = FINAL_VALUES) -> float | None:
    """The quantile of one column."""
    return exact_quantiles(df, [column], p, final_values)[column]
