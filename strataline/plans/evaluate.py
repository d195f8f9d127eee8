"""Turn panel expressions into one staged DataFrame plan.

Plain form: every window shares ``partitionBy(instrument).orderBy(datetime)``,
so a query of any width costs one exchange and one sort; nested windows become
successive projections over the same partitioning.

Blocked form, where it is declared that one instrument may hold more rows than
a task should sort: rows get their exact position from per-range counts, are cut into
fixed-length position blocks, and each block receives the few rows of history
its expressions look back on.  Running accumulators combine block totals.
Both forms give the same rows.
"""

from __future__ import annotations

import math
from collections.abc import Mapping
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataline.operators.orderstats import average_rank
from strataline.plans.arrays import array_windows, in_arrays
from strataline.plans.expr import Expr, field
from strataline.plans.sizing import row_limit, settle, skew_proof, split_points, with_range_bucket

PAST, NOW, FUTURE = Window.unboundedPreceding, Window.currentRow, Window.unboundedFollowing


@dataclass
class Panel:
    """A DataFrame keyed by (instrument, datetime).

    ``blocked`` declares whether one instrument may hold more rows than a task
    should sort; where it is left open, the session's setting decides.
    ``arrays``: in the plain form, row windows are computed in arrays, where
    an instrument's rows fit a task's memory.
    """

    df: DataFrame
    blocked: bool | None = None
    arrays: bool = False

    def is_hot(self) -> bool:
        return self.blocked if self.blocked is not None else skew_proof(self.df)


class Frame:
    """Window specifications for one partitioning of the panel."""

    def __init__(self, part: list[str], order: str, position: str | None = None):
        self.part, self.order, self._pos = part, order, position
        self.time = F.col("datetime")
        self._w = Window.partitionBy(*part).orderBy(order)

    def ordered(self): return self._w
    def rows(self, n: int): return self._w.rowsBetween(-(n - 1), NOW)
    def so_far(self): return self._w.rowsBetween(PAST, NOW)

    def reversed_so_far(self, *extra):
        """Everything from the row onward, read backwards: a running frame instead of a re-scanned one."""
        return Window.partitionBy(*self.part, *extra).orderBy(F.desc(self.order)).rowsBetween(PAST, NOW)

    def span(self, us: int):
        return (Window.partitionBy(*self.part).orderBy(F.unix_micros(self.time.cast("timestamp")))
                .rangeBetween(-(us - 1), 0))

    def within(self, block: Column):
        return Window.partitionBy(*self.part, block).orderBy(self.order).rowsBetween(PAST, NOW)

    def previous(self, block: Column):
        return Window.partitionBy(*self.part).orderBy(block).rangeBetween(-1, -1)

    def _day(self):
        return Window.partitionBy(*self.part, F.to_date(self.time)).orderBy(self.order)

    def whole_day(self): return self._day().rowsBetween(PAST, FUTURE)
    def day_so_far(self): return self._day().rowsBetween(PAST, NOW)
    def minute_of_day(self): return F.hour(self.time) * 60 + F.minute(self.time)

    def position(self) -> Column:
        return F.col(self._pos) if self._pos else F.row_number().over(self._w)


def _running(kind: str, f: Frame, c: Column) -> Column:
    if kind == "head":
        return F.first(c).over(f.so_far())
    if kind == "next":
        return F.last(c, True).over(f.reversed_so_far())
    fn = {"sum": F.sum, "count": F.count, "min": F.min, "max": F.max,
          "last": lambda x: F.last(x, True), "first": lambda x: F.first(x, True)}[kind]
    return fn(c).over(f.so_far())


def _series_rank_plain(c: Column, part: list[str]) -> Column:
    whole = Window.partitionBy(*part)
    r = (F.rank().over(whole.orderBy(c.asc_nulls_last()))
         + (F.count(c).over(Window.partitionBy(*part, c)) - 1) / F.lit(2.0)) / F.count(c).over(whole)
    return F.when(c.isNotNull(), r)


def _column(e: Expr, done: Mapping[str, str]) -> Column:
    if e.key in done:
        return F.col(done[e.key])
    if e.kind == "field":
        return F.col(f"`{e.params[0]}`")
    if e.kind == "const":
        return F.lit(e.params[0])
    return e.make(*[_column(a, done) for a in e.args])


# ---------------------------------------------------------------- sums over spans of time

SPAN_SUMS = {"sum": "double", "count": "long", "mean": "double"}
DAY = 86_400_000_000
LEAST = -(1 << 61)      # the time of rows without one: they are each other's window, as in a range frame


def _span_sum(v: pa.ChunkedArray, first: np.ndarray, end: np.ndarray, at: np.ndarray, op: str) -> pa.Array:
    """Sum, count or mean of the rows ``first`` to ``end`` in the order ``at``, as differences of running sums."""
    over = lambda x: (c := np.concatenate([[0], np.cumsum(x)]))[end] - c[first]
    known = v.is_valid().to_numpy()[at]
    n = over(known.astype(np.int64))
    if op == "count":
        return pa.array(n)
    x = np.where(known, v.to_numpy()[at].astype(np.longdouble), 0)
    total = over(np.where(np.isfinite(x), x, 0)).astype(float)
    for odd in (np.inf, -np.inf):
        total += np.where(over((x == odd).astype(np.int64)) > 0, odd, 0.0)
    total[over(np.isnan(x).astype(np.int64)) > 0] = np.nan
    if op == "mean":
        total /= np.maximum(n, 1)
    return pa.array(total, mask=n == 0)


def _span_sums(df: DataFrame, part: list[str], wanted: list[tuple[str, str, str, int]]) -> DataFrame:
    """Add ``out = op(column)`` over the last ``us`` microseconds, for (out, op, column, us).

    A sliding range frame reads its whole window again for every row.  Here series are cut into slots of time, each with the rows
    that its windows reach before it, and a row costs two look-ups in running sums, however many rows its window holds.  A task
    has the rows of a slot at once: of a day, but not of fewer than 4 or more than 256 spans.
    """
    us = max(w[-1] for w in wanted)
    slot = max(4 * us, min(DAY, 256 * us))
    kept = df.columns
    t = F.coalesce(F.unix_micros(F.col("datetime").cast("timestamp")), F.lit(LEAST))
    own = F.expr(f"(__t - pmod(__t, {slot}L)) div {slot}L")
    after = F.when(F.expr(f"pmod(__t, {slot}L)") > slot - us, own + 1)
    home = F.explode(F.array_compact(F.array(own, after)))
    near = df.withColumn("__t", t).select("*", home.alias("__slot")).withColumn("__here", F.col("__slot") == own)

    def add(table: pa.Table) -> pa.Table:
        t = table.column("__t").to_numpy()
        at = np.argsort(t, kind="stable")
        t, here = t[at], table.column("__here").to_numpy()[at]
        end, mine = np.searchsorted(t, t[here], "right"), at[here]
        out = table.select(kept).take(pa.array(mine))
        for name, op, column, span in wanted:
            out = out.append_column(name, _span_sum(table.column(column), np.searchsorted(t, t[here] - span, "right"), end, at, op))
        return out

    schema = df.schema
    for name, op, *_ in wanted:
        schema = schema.add(name, SPAN_SUMS[op])
    return near.groupBy(*part, "__slot").applyInArrow(add, schema)


def stage(df: DataFrame, exprs: Mapping[str, Expr], frame: Frame) -> DataFrame:
    """Add the expressions as columns, one projection per nesting level of windows."""
    done: dict[str, str] = {}
    todo: dict[int, dict[str, Expr]] = {}
    for e in exprs.values():
        for n in e.nodes():
            if n.kind in ("win", "acc", "series"):
                todo.setdefault(n.level, {}).setdefault(n.key, n)
    arr = {n.key: n for level in todo.values() for n in level.values() if n.op.startswith("arr_")}
    if not any(m.key in arr for level in todo.values() for n in level.values() for a in n.args for m in a.nodes()):
        # no window needs another's array: all are made in one pass, after the other windows
        for level in todo.values():
            for key in arr:
                level.pop(key, None)
        todo[max(todo, default=0) + 1] = arr
    serial = 0
    temps: list[str] = []
    for level in sorted(todo):
        new: dict[str, Column] = {}
        ready: dict[str, str] = {}
        spans: list[tuple[str, str, str, int]] = []
        arrays: list[tuple[str, Expr, list[str]]] = []
        given: dict[str, str] = {}
        for key, n in todo[level].items():
            args = [_column(a, done) for a in n.args]
            if n.op.startswith("arr_"):
                for a, c in zip(n.args, args):
                    if a.key not in given:
                        given[a.key] = f"__s{serial}"
                        new[given[a.key]] = c.cast("double")
                        serial += 1
                ready[key] = f"__s{serial}"
                serial += 1
                arrays.append((ready[key], n, [given[a.key] for a in n.args]))
                continue
            if n.kind == "acc":
                c = _running(n.params[0], frame, args[0])
            elif n.kind == "series":
                c = _series_rank_plain(args[0], frame.part)
            elif n.span_us and n.op in SPAN_SUMS:
                c = args[0].cast("double")
            else:
                c = n.make(frame, *args)
            name = f"__s{serial}"
            serial += 1
            new[name], ready[key] = c, name
            if n.span_us and n.op in SPAN_SUMS:
                ready[key] = f"{name}_w"
                spans.append((ready[key], n.op, name, n.span_us))
        df = df.withColumns(new) if new else df
        if spans:
            df = _span_sums(df, frame.part, spans).drop(*[s[2] for s in spans])
        if arrays:
            df = array_windows(df, frame.part, frame.order, arrays)
        temps += [c for c in (*new, *[s[0] for s in (*spans, *arrays)]) if c in df.columns]
        done.update(ready)
    keep = [c for c in df.columns if c not in temps and c not in exprs]
    return df.select(*keep, *[_column(e, done).alias(name) for name, e in exprs.items()])


# ---------------------------------------------------------------- blocked form

def with_positions(df: DataFrame) -> DataFrame:
    """Exact 1-based row position per instrument without sorting an instrument in one task."""
    t = df.withColumn("__us", F.unix_micros(F.col("datetime").cast("timestamp")).cast("double"))
    parts = math.ceil(df.count() / max(1, row_limit(df) // 4))
    ranged = with_range_bucket(t, "__us", split_points(t, "__us", parts), "__rng")
    counts = ranged.groupBy("instrument", "__rng").agg(F.count(F.lit(1)).alias("__n"))
    w = Window.partitionBy("instrument").orderBy("__rng").rowsBetween(PAST, -1)
    shift = counts.select("instrument", "__rng", F.coalesce(F.sum("__n").over(w), F.lit(0)).alias("__shift"))
    inside = Window.partitionBy("instrument", "__rng").orderBy("datetime")
    return (ranged.join(shift, ["instrument", "__rng"])
            .withColumn("__pos", F.col("__shift") + F.row_number().over(inside))
            .drop("__us", "__rng", "__shift"))


def _replace(e: Expr, names: Mapping[str, str]) -> Expr:
    if e.key in names:
        return field(names[e.key])
    if not e.args:
        return e
    return Expr(e.kind, e.op, [_replace(a, names) for a in e.args], e.params, e.make,
                e.own_back, e.own_ahead, e.boolean, e.span_us)


def _depth(e: Expr) -> int:
    own = e.kind in ("acc", "series") or e.own_back == math.inf
    return own + max([_depth(a) for a in e.args], default=0)


def _rows_per_span(df: DataFrame, us: int) -> int:
    """Most rows any window of ``us`` microseconds can hold, from per-slot counts."""
    slot = F.floor(F.unix_micros(F.col("datetime").cast("timestamp")) / us)
    top = df.groupBy("instrument", slot.alias("_slot")).count().agg(F.max("count")).first()[0]
    return 2 * (top or 0)


def _bounded_blocked(df: DataFrame, exprs: Mapping[str, Expr]) -> DataFrame:
    """Evaluate finite-extent expressions on (instrument, block) groups with borrowed history."""
    back = max(e.back for e in exprs.values())
    ahead = max(e.ahead for e in exprs.values())
    us = max(e.reach_us for e in exprs.values())
    if us:
        back += _rows_per_span(df, us)
    size = max(row_limit(df) // 2, back, ahead, 1)
    at = (F.col("__pos") - 1) % size
    own = F.floor((F.col("__pos") - 1) / size)
    homes = [F.struct(own.alias("b"), F.lit(True).alias("own"))]
    if back:
        homes.append(F.when(at >= size - back, F.struct((own + 1).alias("b"), F.lit(False).alias("own"))))
    if ahead:
        homes.append(F.when(at < ahead, F.struct((own - 1).alias("b"), F.lit(False).alias("own"))))
    copies = (df.withColumn("__home", F.explode(F.array_compact(F.array(*homes))))
              .withColumn("__block", F.col("__home.b")).withColumn("__own", F.col("__home.own")).drop("__home"))
    out = stage(copies, exprs, Frame(["instrument", "__block"], "__pos", "__pos"))
    return out.where("__own").drop("__block", "__own")


_TOTAL = {
    "sum": lambda v, p: F.sum(v), "count": lambda v, p: F.count(v),
    "min": lambda v, p: F.min(v), "max": lambda v, p: F.max(v),
    "last": lambda v, p: F.max_by(v, F.when(v.isNotNull(), p)),
    "first": lambda v, p: F.min_by(v, F.when(v.isNotNull(), p)),
    "next": lambda v, p: F.min_by(v, F.when(v.isNotNull(), p)),
    "head": lambda v, p: F.min_by(F.struct(v.alias("v")), p),
}


def _prior(kind: str, total: Column, w) -> Column:
    before, after = w.rowsBetween(PAST, -1), w.rowsBetween(1, FUTURE)
    if kind == "count":
        return F.coalesce(F.sum(total).over(before), F.lit(0))
    if kind in ("sum", "min", "max"):
        return {"sum": F.sum, "min": F.min, "max": F.max}[kind](total).over(before)
    if kind == "last":
        return F.last(total, True).over(before)
    if kind == "next":
        return F.first(total, True).over(after)
    return F.first(total, True).over(before)


def _merge(kind: str, carried: Column, here: Column, here_head: Column) -> Column:
    if kind == "count":
        return carried + here
    if kind == "sum":
        return F.coalesce(carried + here, carried, here)
    if kind == "min":
        return F.least(carried, here)
    if kind == "max":
        return F.greatest(carried, here)
    if kind in ("last", "next"):
        return F.coalesce(here, carried)
    if kind == "first":
        return F.coalesce(carried, here)
    return F.coalesce(carried, here_head)["v"]


def _accumulate_blocked(df: DataFrame, accs: dict[str, tuple[str, str]]) -> DataFrame:
    """Running accumulators ``out -> (kind, column)``: block totals carried forward plus in-block runs."""
    size = max(1, row_limit(df) // 2)
    b = df.withColumn("__block", F.floor((F.col("__pos") - 1) / size))
    p = F.col("__pos")
    totals = b.groupBy("instrument", "__block").agg(
        *[_TOTAL[k](F.col(c), p).alias(f"__t{i}") for i, (k, c) in enumerate(accs.values())])
    w = Window.partitionBy("instrument").orderBy("__block")
    carry = totals.select("instrument", "__block", *[
        _prior(k, F.col(f"__t{i}"), w).alias(f"__c{i}") for i, (k, _) in enumerate(accs.values())])
    f = Frame(["instrument", "__block"], "__pos", "__pos")
    joined = b.join(carry, ["instrument", "__block"])
    runs = {}
    for i, (k, c) in enumerate(accs.values()):
        v = F.col(c)
        runs[f"__r{i}"] = _running(k, f, F.struct(v.alias("v")) if k == "head" else v)
    joined = joined.withColumns(runs)
    outs = [_merge(k, F.col(f"__c{i}"), F.col(f"__r{i}"), F.col(f"__r{i}")).alias(name)
            for i, (name, (k, _)) in enumerate(accs.items())]
    return joined.select(*df.columns, *outs)


def evaluate_blocked(df: DataFrame, exprs: Mapping[str, Expr]) -> DataFrame:
    base = list(df.columns)
    cur = settle(with_positions(df))
    exprs = dict(exprs)
    serial = 0
    while max(_depth(e) for e in exprs.values()):
        layer: dict[str, Expr] = {}
        for e in exprs.values():
            for n in e.nodes():
                if _depth(n) == 1 and (n.kind in ("acc", "series") or n.own_back == math.inf):
                    layer.setdefault(n.key, n)
        names = {k: f"__u{serial + i}" for i, k in enumerate(layer)}
        serial += len(layer)
        inner = {f"{names[k]}_{j}": a for k, n in layer.items() for j, a in enumerate(n.args)}
        cur = _bounded_blocked(cur, inner)
        accs = {names[k]: (n.params[0], f"{names[k]}_0") for k, n in layer.items() if n.kind == "acc"}
        if accs:
            cur = _accumulate_blocked(cur, accs)
        for k, n in layer.items():
            if n.kind == "series":
                cur = average_rank(cur, ["instrument"], f"{names[k]}_0", names[k], pct=True, hot=True)
        # growing order statistics and day windows keep their own (whole-series or per-day) frames
        rest = {names[k]: Expr(n.kind, n.op, [field(f"{names[k]}_{j}") for j in range(len(n.args))], n.params,
                               n.make, n.own_back, n.own_ahead, n.boolean, n.span_us)
                for k, n in layer.items() if n.kind == "win"}
        if rest:
            cur = stage(cur, rest, Frame(["instrument"], "__pos", "__pos"))
        cur = settle(cur.drop(*inner))
        exprs = {name: _replace(e, names) for name, e in exprs.items()}
    out = _bounded_blocked(cur, exprs)
    return out.select(*[c for c in base if c not in exprs], *exprs)


# ---------------------------------------------------------------- the panel query

def with_columns(panel: Panel, exprs: Mapping[str, Expr]) -> DataFrame:
    """All panel columns plus one per expression."""
    if panel.is_hot():
        return evaluate_blocked(panel.df, exprs)
    if panel.arrays:
        exprs = {name: in_arrays(e) for name, e in exprs.items()}
    return stage(panel.df, exprs, Frame(["instrument"], "datetime"))


def features(panel: Panel, exprs: Mapping[str, Expr], start=None, end=None, universe: DataFrame | None = None,
             instruments: list[str] | None = None, calendar: DataFrame | None = None,
             keep_rows: Expr | None = None) -> DataFrame:
    """The panel query: one row per (instrument, datetime), one column per expression.

    Windows see rows outside the requested range and outside universe spans; the
    result does not contain them.  ``calendar`` may be given when every instrument
    has a row on every calendar date of its life: then the scan is cut to the
    rows the expressions can reach.
    """
    wanted = dict(exprs)
    if keep_rows is not None:
        wanted["__keep"] = keep_rows
    cols = sorted(set().union(*[e.fields() for e in wanted.values()]))
    df = panel.df
    if instruments is not None:
        df = df.where(F.col("instrument").isin(list(instruments)))
    df = df.select("instrument", "datetime", *[c for c in cols if c not in ("instrument", "datetime")])
    t = F.col("datetime")
    lo, hi = _reach(wanted, start, end, calendar)
    if lo is not None:
        df = df.where(t >= F.lit(lo))
    if hi is not None:
        df = df.where(t <= F.lit(hi))
    out = with_columns(Panel(df, panel.blocked, panel.arrays), wanted)
    if start is not None:
        out = out.where(t >= F.lit(start))
    if end is not None:
        out = out.where(t <= F.lit(end))
    if keep_rows is not None:
        out = out.where(F.col("__keep"))
    if universe is not None:
        out = in_spans(out, universe)
    return out.select("instrument", "datetime", *exprs)


def _reach(exprs, start, end, calendar):
    """First and last datetime the expressions can need; None means no bound."""
    back = max(e.back for e in exprs.values())
    ahead = max(e.ahead for e in exprs.values())
    open_ended = any(e.unbounded or e.reach_us for e in exprs.values())
    whole = any(n.kind == "series" or n.op in ("acc_next", "day_last")
                for e in exprs.values() for n in e.nodes())
    hi = end if (end is not None and ahead == 0 and not whole) else None
    if calendar is None or open_ended:
        return None, hi
    lo = None
    if start is not None:
        lo = start if back == 0 else (calendar.where(F.col("datetime") < F.lit(start))
                                      .orderBy(F.desc("datetime")).limit(int(back))
                                      .agg(F.min("datetime")).first()[0]) or start
    if end is not None and ahead > 0:
        hi = (calendar.where(F.col("datetime") > F.lit(end)).orderBy("datetime").limit(int(ahead))
              .agg(F.max("datetime")).first()[0]) or end
    return lo, hi


def in_spans(df: DataFrame, universe: DataFrame) -> DataFrame:
    """Rows whose (instrument, datetime) lies inside any universe span."""
    u = universe.select(F.col("instrument").alias("_i"), F.col("start").alias("_a"), F.col("end").alias("_b"))
    hit = (F.col("instrument") == F.col("_i")) & F.col("datetime").between(F.col("_a"), F.col("_b"))
    return df.join(u, hit, "left_semi")


def on_instrument(panel: Panel, other: str, exprs: Mapping[str, Expr]) -> Panel:
    """Add expressions evaluated on another instrument, aligned on time."""
    side = panel.df.where(F.col("instrument") == other)
    vals = with_columns(Panel(side, blocked=panel.blocked), exprs).select("datetime", *exprs)
    return Panel(panel.df.join(vals, "datetime", "left").select(*panel.df.columns, *exprs),
                 panel.blocked)
