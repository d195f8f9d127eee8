"""Composable panel expressions.

An ``Expr`` is a small description of one output column of a panel query:
fields, constants, element-wise maps, per-instrument windows and running
accumulators.  Users combine them with Python operators and the functions in
this module; :mod:`strataline.plans.evaluate` turns a dict of them into one
staged DataFrame plan.  Every expression knows how many rows it looks back and
ahead, which is what range push-down and row blocking need.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from strataline.functions import scalar as S

FLAT_STD = 2e-5  # fixed value: windows with a smaller spread have no correlation


class Expr:
    """One node: ``kind`` is field, const, map, win, acc or series."""

    def __init__(self, kind, op, args=(), params=(), make=None, back=0, ahead=0,
                 boolean=False, span_us=0):
        self.kind = kind
        self.op = op
        self.args: tuple[Expr, ...] = tuple(args)
        self.params = tuple(params)
        self.make: Callable | None = make
        self.boolean = boolean
        self.own_back, self.own_ahead, self.span_us = back, ahead, span_us
        self.key = f"{op}({','.join([a.key for a in self.args] + [repr(p) for p in self.params])})"
        self.level = max([a.level for a in self.args], default=0) + (kind in ("win", "acc", "series"))

    # looking distance of the whole tree, in rows of the instrument
    @property
    def back(self) -> int:
        return self.own_back + max([a.back for a in self.args], default=0)

    @property
    def ahead(self) -> int:
        return self.own_ahead + max([a.ahead for a in self.args], default=0)

    @property
    def unbounded(self) -> bool:
        return self.kind in ("acc", "series") or self.own_back == math.inf or any(a.unbounded for a in self.args)

    @property
    def reach_us(self) -> int:
        """Time the tree looks back: spans of nested windows add up."""
        return self.span_us + max([a.reach_us for a in self.args], default=0)

    def fields(self) -> set[str]:
        if self.kind == "field":
            return {self.params[0]}
        return set().union(*[a.fields() for a in self.args]) if self.args else set()

    def nodes(self):
        for a in self.args:
            yield from a.nodes()
        yield self

    def __add__(self, o): return add(self, o)
    def __radd__(self, o): return add(o, self)
    def __sub__(self, o): return sub(self, o)
    def __rsub__(self, o): return sub(o, self)
    def __mul__(self, o): return mul(self, o)
    def __rmul__(self, o): return mul(o, self)
    def __truediv__(self, o): return div(self, o)
    def __rtruediv__(self, o): return div(o, self)
    def __pow__(self, o): return power(self, o)
    def __rpow__(self, o): return power(o, self)
    def __gt__(self, o): return gt(self, o)
    def __ge__(self, o): return ge(self, o)
    def __lt__(self, o): return lt(self, o)
    def __le__(self, o): return le(self, o)
    def __and__(self, o): return and_(self, o)
    def __or__(self, o): return or_(self, o)
    def __invert__(self): return not_(self)
    def __neg__(self): return mul(self, -1.0)

    def __repr__(self):
        return self.key


# ---------------------------------------------------------------- leaves

def field(name: str) -> Expr:
    return Expr("field", "field", params=(name,))


def const(value) -> Expr:
    return Expr("const", "const", params=(value,), boolean=isinstance(value, bool))


POS = Expr("win", "pos", make=lambda f: f.position())
"""1-based row number of the row within its instrument."""


def as_expr(x) -> Expr:
    if isinstance(x, Expr):
        return x
    return const(x if isinstance(x, (bool, str)) else float(x))


def _num(x) -> Expr:
    e = as_expr(x)
    return _map("num", lambda c: c.cast("double"), e) if e.boolean else e


def _map(op, make, *args, params=(), boolean=False) -> Expr:
    return Expr("map", op, args, params, make, boolean=boolean)


def _win(op, make, *args, params=(), back=0, ahead=0, boolean=False, span_us=0) -> Expr:
    return Expr("win", op, args, params, make, back, ahead, boolean, span_us)


def _acc(kind, x) -> Expr:
    """Running accumulator over everything up to the current row."""
    return Expr("acc", f"acc_{kind}", (x,), (kind,))


def column_map(op: str, fn: Callable[..., Column], *args, boolean=False) -> Expr:
    """Extension hook: any Column function of other expressions."""
    return _map(op, fn, *[as_expr(a) for a in args], boolean=boolean)


# ---------------------------------------------------------------- element-wise

def _unary(op, fn, x, boolean=False):
    return _map(op, fn, x if boolean == "keep" else _num(x), boolean=bool(boolean))


def abs_(x): return _unary("abs", F.abs, x)
def sign(x): return _unary("sign", F.signum, x)
def log(x): return _unary("log", S.safe_log, x)
def not_(x): return _map("not", lambda c: ~c, as_expr(x), boolean=True)
def is_null(x): return _map("is_null", lambda c: c.isNull(), as_expr(x), boolean=True)
def is_inf(x): return _map("is_inf", S.is_inf, _num(x), boolean=True)
def exp(x): return _unary("exp", F.exp, x)
def sqrt(x): return _unary("sqrt", lambda c: F.when(c >= 0, F.sqrt(c)), x)
def log1p(x): return _unary("log1p", lambda c: S.safe_log(c + 1), x)


def _binary(op, fn, a, b):
    return _map(op, fn, _num(a), _num(b))


def power(a, b): return _binary("power", S.safe_pow, a, b)
def add(a, b): return _binary("add", lambda x, y: x + y, a, b)
def sub(a, b): return _binary("sub", lambda x, y: x - y, a, b)
def mul(a, b): return _binary("mul", lambda x, y: x * y, a, b)
def div(a, b):
    b = as_expr(b)
    if b.kind == "const" and b.params[0]:
        return _binary("div", lambda x, y: x / y, a, b)
    return _binary("div", S.safe_div, a, b)


def greater(a, b): return _binary("greater", S.both_max, a, b)
def less(a, b): return _binary("less", S.both_min, a, b)


def _compare(op, fn, a, b, if_missing=False):
    return _map(op, lambda x, y: F.coalesce(fn(x, y), F.lit(if_missing)), _num(a), _num(b), boolean=True)


def gt(a, b): return _compare("gt", lambda x, y: x > y, a, b)
def ge(a, b): return _compare("ge", lambda x, y: x >= y, a, b)
def lt(a, b): return _compare("lt", lambda x, y: x < y, a, b)
def le(a, b): return _compare("le", lambda x, y: x <= y, a, b)
def eq(a, b): return _compare("eq", lambda x, y: x == y, a, b)
def ne(a, b): return _compare("ne", lambda x, y: x != y, a, b, if_missing=True)
def and_(a, b): return _map("and", lambda x, y: x & y, as_expr(a), as_expr(b), boolean=True)
def or_(a, b): return _map("or", lambda x, y: x | y, as_expr(a), as_expr(b), boolean=True)


def if_(cond, a, b) -> Expr:
    """Choose by condition; a missing numeric condition counts as true."""
    c = as_expr(cond)
    if not c.boolean:
        c = _map("truthy", lambda v: F.coalesce(v != 0, F.lit(True)), c, boolean=True)
    a, b = as_expr(a), as_expr(b)
    if not (a.boolean and b.boolean):
        a, b = _num(a), _num(b)
    return _map("if", lambda p, x, y: F.when(p, x).otherwise(y), c, a, b, boolean=a.boolean)


def where(cond, x) -> Expr:
    """``x`` where the condition holds, else missing (used with ``keep_rows``)."""
    return _map("where", lambda p, v: F.when(p, v), as_expr(cond), as_expr(x), boolean=as_expr(x).boolean)


# ---------------------------------------------------------------- windows

def _frame(n):
    """Row frame for ``n`` > 0."""
    return lambda f: f.rows(int(n))


def _rolling(op, agg: Callable[..., Column], n, *args) -> Expr:
    """``agg`` over the trailing n rows (an int) or a time span such as '3s'."""
    if isinstance(n, str):
        us = span_micros(n)
        return _win(op, lambda f, *c: agg(*c).over(f.span(us)), *args, params=(n,), span_us=us)
    n = int(n)
    if n >= LONG_WINDOW and op in _JOINED:
        return _long_window(op, agg, n, args[0])
    return _win(op, lambda f, *c: agg(*c).over(f.rows(n)), *args, params=(n,), back=n - 1)


LONG_WINDOW = 100  # rows from which a sliding frame costs more than running frames
_JOINED = {
    "sum": lambda a, b: F.coalesce(a + b, a, b), "count": lambda a, b: F.coalesce(a + b, a, b),
    "max": F.greatest, "min": F.least,
}
_JOINED["mean"] = _JOINED["sum"]


def _long_window(op, agg, n, x):
    """A trailing window as (tail of the previous n-row block) + (head of this block).

    Both parts are running frames, so a row costs the same for any n, and each
    result only combines rows of its own window: nothing drifts.
    """
    if op == "mean":
        return div(_long_window("sum", F.sum, n, x), _num(_long_window("count", F.count, n, x)))
    blk = _map("long_block", lambda p: F.floor((p - 1) / n), POS, params=(n,))
    head = _win(f"{op}_head", lambda f, c, b, p: agg(c).over(f.within(b)), x, blk, POS, params=(n,), back=n - 1)
    tail = _win(f"{op}_tail", lambda f, c, b, p: agg(c).over(f.reversed_so_far(b)), x, blk, POS, params=(n,))
    older = _map("older", lambda t, p: F.when(p % n != 0, t), ref(tail, n - 1), POS, params=(n,))
    return _map(f"{op}_joined", _JOINED[op], older, head)


# ---------------------------------------------------------------- mergeable moments

LADDER = 100      # rows from which moments are merged from parts; shorter sliding frames cost less
RUNG, STEP = 8, 8   # rows of the smallest parts (5 where the window is a multiple), and how many parts a larger one is made of


def _rungs(n: int) -> list[int]:
    """Widths of the parts that a window of n rows is made of, ascending."""
    widths = [5 if n % 5 == 0 else RUNG]
    while widths[-1] * STEP <= n:
        widths.append(widths[-1] * STEP)
    return widths


FIELDS = {"one": ["n", "a", "aa"], "two": ["n", "a", "b", "aa", "bb", "ab"], "high": ["n", "a", "aa", "a3", "a4"]}


def _part(n: int, xs: tuple, kind: str) -> Expr:
    """Count, mean and centred moments (each divided by the count) of a short window in one struct; of two series over
    complete pairs, or of one up to the fourth."""
    def make(f, *c):
        w = f.rows(n)
        if kind == "two":
            x, y = F.when(c[1].isNotNull(), c[0]), F.when(c[0].isNotNull(), c[1])
            return F.struct(F.count(x).over(w).alias("n"), F.avg(x).over(w).alias("a"), F.avg(y).over(w).alias("b"), F.var_pop(x).over(w).alias("aa"),
                            F.var_pop(y).over(w).alias("bb"), F.covar_pop(x, y).over(w).alias("ab"))
        aa = F.var_pop(c[0]).over(w)
        cells = [F.count(c[0]).over(w).alias("n"), F.avg(c[0]).over(w).alias("a"), aa.alias("aa")]
        if kind == "high":
            cells += [(S.nan_to_null(F.skewness(c[0]).over(w)) * aa * F.sqrt(aa)).alias("a3"), ((S.nan_to_null(F.kurtosis(c[0]).over(w)) + 3) * aa * aa).alias("a4")]
        return F.struct(*cells)
    return _win("moments", make, *xs, params=(n, kind), back=n - 1)


def _merged(kind: str, *parts: dict) -> dict[str, Column]:
    """The moments of disjoint parts together.

    Values are taken relative to one part's mean, which lies inside the window, so the sums lose no more digits than the
    window's own values do, and no value from outside the window takes part.
    """
    def added(values):
        return sum(values[1:], values[0])
    n = [p["n"] for p in parts]
    count = added(n)
    base, shift, mean = {}, {}, {}
    for v in "ab" if kind == "two" else "a":
        base[v] = F.coalesce(*[p[v] for p in parts])
        shift[v] = [F.coalesce(p[v] - base[v], F.lit(0.0)) for p in parts]
        mean[v] = S.null_div(added([k * d for k, d in zip(n, shift[v])]), count)
    out = {"n": count} | {v: base[v] + mean[v] for v in mean}
    own = lambda p, v: F.coalesce(p[v], F.lit(0.0))
    for v in ("aa", "bb", "ab") if kind == "two" else ("aa",):
        x, y = v
        out[v] = S.null_div(added([k * (own(p, v) + d * e) for k, p, d, e in zip(n, parts, shift[x], shift[y])]), count) - mean[x] * mean[y]
    if kind == "high":
        m, d = mean["a"], shift["a"]
        s2 = S.null_div(added([k * (own(p, "aa") + e * e) for k, p, e in zip(n, parts, d)]), count)
        s3 = S.null_div(added([k * (own(p, "a3") + 3 * e * own(p, "aa") + e * e * e) for k, p, e in zip(n, parts, d)]), count)
        s4 = S.null_div(added([k * (own(p, "a4") + 4 * e * own(p, "a3") + 6 * e * e * own(p, "aa") + e * e * e * e) for k, p, e in zip(n, parts, d)]), count)
        out |= {"a3": s3 - 3 * m * s2 + 2 * m * m * m, "a4": s4 - 4 * m * s3 + 6 * m * m * s2 - 3 * m * m * m * m}
    return {k: out[k] for k in FIELDS[kind]}


def _moments(n: int, *xs: Expr, high: bool = False) -> Expr:
    """Moments of the trailing n rows, in a struct of FIELDS: parts of a few rows, merged by lags.

    A window of any length costs a few lags for each power of STEP in it; windows of several lengths share their parts.
    """
    kind = "two" if len(xs) == 2 else "high" if high else "one"
    if n < LADDER:
        return _part(n, xs, kind)
    widths = _rungs(n)
    built = {widths[0]: _part(widths[0], xs, kind)}

    def merge(parts):
        if len(parts) == 1:
            return parts[0]

        def make(f, *cols):
            # before the first row a part is missing, which is a part of no rows
            cells = [{k: F.coalesce(c[k], F.lit(0)) if k == "n" else c[k] for k in FIELDS[kind]} for c in cols]
            return F.struct(*[v.alias(k) for k, v in _merged(kind, *cells).items()])
        # a column of its own (as windows are): what follows names its fields many times
        return _win("merged", make, *parts, params=(kind,))

    for w in widths[1:]:
        built[w] = merge([built[w // STEP] if k == 0 else ref(built[w // STEP], k * (w // STEP)) for k in range(STEP)])
    parts, at = [], 0
    for w in reversed(widths):
        while n - at >= w:
            parts.append(ref(built[w], at) if at else built[w])
            at += w
    if n > at:
        parts.append(ref(_part(n - at, xs, kind), at))
    return merge(parts)


def _moment(op, fn, m: Expr) -> Expr:
    return _map(op, fn, m)


_UNITS = {"us": 1, "ms": 1_000, "s": 1_000_000, "min": 60_000_000, "h": 3_600_000_000, "d": 86_400_000_000}


def span_micros(text: str) -> int:
    num = text.rstrip("abcdefghijklmnopqrstuvwxyz")
    return int(num or 1) * _UNITS[text[len(num):]]


def _decays(n) -> bool:
    return isinstance(n, float) and 0 < n < 1


def rolling(x, n, func: str, *extra) -> Expr:
    """Generic trailing window by function name."""
    return _ROLLING[func](x, n, *extra)


def mean(x, n):
    x = _num(x)
    if _decays(n):
        return ema(x, n)
    if n == 0:
        return div(_acc("sum", x), _acc("count", x))
    return _rolling("mean", F.avg, n, x)


def sum_(x, n):
    x = _num(x)
    if _decays(n):
        return ema(x, n)
    return _acc("sum", x) if n == 0 else _rolling("sum", F.sum, n, x)


def count(x, n):
    x = _num(x)
    if _decays(n):
        return ema(x, n)
    c = _acc("count", x) if n == 0 else _rolling("count", F.count, n, x)
    return _map("num", lambda v: v.cast("double"), c)


def max_(x, n):
    x = _num(x)
    if _decays(n):
        return ema(x, n)
    return _acc("max", x) if n == 0 else _rolling("max", F.max, n, x)


def min_(x, n):
    x = _num(x)
    if _decays(n):
        return ema(x, n)
    return _acc("min", x) if n == 0 else _rolling("min", F.min, n, x)


def _laddered(n) -> bool:
    return isinstance(n, (int, float)) and n >= LADDER


def _centred(x):
    """x minus the first value of its series, to keep running power sums accurate."""
    return sub(x, first_value(x))


def _running_moments(x, upto):
    d = _centred(x)
    n = _map("num", lambda v: v.cast("double"), _acc("count", x))
    sums, p = [], d
    for _ in range(upto):
        sums.append(_acc("sum", p))
        p = mul(p, d)
    return [n] + sums


def var(x, n):
    x = _num(x)
    if _decays(n):
        return ema(x, n)
    if n == 0:
        # an infinite value makes the sums NaN, which is missing here
        def f(c, s, q):
            v = S.nan_to_null((q - s * s / c) / (c - 1))
            return F.when((c > 1) & v.isNotNull(), F.greatest(v, F.lit(0.0)))
        return _map("var0", f, *_running_moments(x, 2))
    if _laddered(n):
        return _moment("var_of", lambda m: S.nan_to_null(F.when(m["n"] > 1, F.greatest(m["aa"], F.lit(0.0)) * m["n"] / (m["n"] - 1))), _moments(int(n), x))
    return _rolling("var", F.var_samp, n, x)


def std(x, n):
    x = _num(x)
    if _decays(n):
        return ema(x, n)
    return sqrt(var(x, n)) if n == 0 or _laddered(n) else _rolling("std", F.stddev_samp, n, x)


def _central(c, s1, s2, s3, s4=None):
    m = s1 / c
    m2 = s2 / c - m * m
    m3 = s3 / c - 3 * m * s2 / c + 2 * m * m * m
    m4 = None if s4 is None else s4 / c - 4 * m * s3 / c + 6 * m * m * s2 / c - 3 * m * m * m * m
    return m2, m3, m4


def skew(x, n):
    x = _num(x)
    if n != 0 and not n >= 3:
        raise ValueError("skew needs n = 0 or n >= 3")
    if n == 0:
        def f(c, s1, s2, s3):
            m2, m3, _ = _central(c, s1, s2, s3)
            return S.nan_to_null(S.sample_skew(F.when(m2 > 0, m3 / F.pow(m2, F.lit(1.5))), c))
        return _map("skew0", f, *_running_moments(x, 3))
    if _laddered(n):
        return _moment("skew_of", lambda m: S.nan_to_null(S.sample_skew(F.when(m["aa"] > 0, m["a3"] / F.pow(m["aa"], F.lit(1.5))), m["n"])), _moments(int(n), x, high=True))
    return _map("skew_fix", S.sample_skew, _rolling("skew_pop", F.skewness, n, x), count(x, n))


def kurt(x, n):
    x = _num(x)
    if n != 0 and not n >= 4:
        raise ValueError("kurt needs n = 0 or n >= 4")
    if n == 0:
        def f(c, s1, s2, s3, s4):
            m2, _, m4 = _central(c, s1, s2, s3, s4)
            return S.nan_to_null(S.sample_kurt(F.when(m2 > 0, m4 / (m2 * m2) - 3), c))
        return _map("kurt0", f, *_running_moments(x, 4))
    if _laddered(n):
        return _moment("kurt_of", lambda m: S.nan_to_null(S.sample_kurt(F.when(m["aa"] > 0, m["a4"] / (m["aa"] * m["aa"]) - 3), m["n"])), _moments(int(n), x, high=True))
    return _map("kurt_fix", S.sample_kurt, _rolling("kurt_pop", F.kurtosis, n, x), count(x, n))


def ref(x, n: int):
    """Value n rows ago (n < 0: ahead); n = 0 gives the first row of the series."""
    x = as_expr(x)
    if n == 0:
        return Expr("acc", "acc_head", (x,), ("head",), boolean=x.boolean)
    return _win("ref", lambda f, c: F.lag(c, n).over(f.ordered()), x, params=(n,),
                back=max(n, 0), ahead=max(-n, 0), boolean=x.boolean)


def delta(x, n: int):
    return sub(x, ref(x, n))


def first_value(x):
    """First non-missing value of the series so far."""
    return _acc("first", _num(x))


def ffill(x):
    return _acc("last", as_expr(x))


def bfill(x):
    return _acc("next", as_expr(x))


def _sorted_window(x, n):
    return _win("sorted", lambda f, c: F.array_sort(F.collect_list(c).over(f.rows(int(n)))), x,
                params=(n,), back=n - 1)


def quantile(x, n, q: float):
    x = _num(x)
    if _decays(n):
        return ema(x, n)
    if n == 0:
        return _win("quantile0", lambda f, c: F.percentile(c, F.lit(q)).over(f.so_far()), x,
                    params=(q,), back=math.inf)
    return _map("quantile", lambda a: S.sorted_quantile(a, q), _sorted_window(x, n), params=(q,))


def med(x, n):
    return quantile(x, n, 0.5)


def _listed(x, n):
    if n == 0:
        return _win("list0", lambda f, c: F.collect_list(c).over(f.so_far()), x, back=math.inf)
    return _sorted_window(x, n)


def mad(x, n):
    """Mean absolute deviation around the window mean."""
    def f(a):
        m = F.aggregate(a, F.lit(0.0), lambda s, v: s + v) / F.size(a)
        return F.when(F.size(a) > 0, F.aggregate(
            F.transform(a, lambda v: F.abs(v - m)), F.lit(0.0), lambda s, v: s + v) / F.size(a))
    return _map("mad", f, _listed(_num(x), n))


def rank(x, n):
    """Percentile rank of the newest value in its window, ties averaged."""
    def f(v, a):
        below = F.aggregate(a, F.lit(0.0), lambda s, e: s + F.when(e < v, 1.0).when(e == v, 0.5).otherwise(0.0))
        return F.when(v.isNotNull(), (below + 0.5) / F.size(a))
    x = _num(x)
    return _map("rank", f, x, _listed(x, n))


def _idx(op, n, x, pick, order):
    x = _num(x)

    def arg(f, c, p):
        w = f.so_far() if n == 0 else f.rows(int(n))
        return pick(p, F.when(c.isNotNull(), order(c, p))).over(w)

    at = _win(op, arg, x, POS, params=(n,), back=math.inf if n == 0 else n - 1)
    start = POS if n == 0 else _map("win_start", lambda p: F.greatest(p - n + 1, F.lit(1)), POS, params=(n,))
    if n == 0:
        return _map("num", lambda a: a.cast("double"), at)
    return _map("offset", lambda a, s: (a - s + 1).cast("double"), at, start)


def idxmax(x, n):
    """1-based place of the first maximum inside the (possibly short) window."""
    return _idx("idxmax", n, x, F.max_by, lambda c, p: F.struct(c, -p))


def idxmin(x, n):
    return _idx("idxmin", n, x, F.min_by, lambda c, p: F.struct(c, p))


# regression on the row position --------------------------------------------

def _running_regression(x):
    d = _centred(x)
    t = _map("pos_of", lambda p, c: F.when(c.isNotNull(), p.cast("double")), POS, x)
    n, sx = _running_moments(x, 1)
    return n, sx, _acc("sum", mul(d, d)), _acc("sum", t), _acc("sum", mul(t, t)), _acc("sum", mul(t, d)), d


def slope(x, n):
    x = _num(x)
    if n == 0:
        c, sx, _, st, stt, stx, _ = _running_regression(x)
        return _map("slope0", lambda c, sx, st, stt, stx: S.null_div(stx - st * sx / c, stt - st * st / c),
                    c, sx, st, stt, stx)
    return _line_slope(x, n)


def _line_slope(x, n):
    if _laddered(n):
        return _moment("slope_of", lambda m: S.nan_to_null(S.null_div(m["ab"], m["bb"])), _moments(int(n), x, _clock()))
    return _map("nn", S.nan_to_null, _rolling("slope", F.regr_slope, n, x, POS))


def _clock() -> Expr:
    return _map("clock", lambda p: p.cast("double"), POS)


def rsquare(x, n):
    x = _num(x)
    if n == 0:
        c, sx, sxx, st, stt, stx, _ = _running_regression(x)
        return _map("rsq0", lambda c, sx, sxx, st, stt, stx: S.null_div(
            F.pow(stx - st * sx / c, F.lit(2.0)), (stt - st * st / c) * (sxx - sx * sx / c)),
            c, sx, sxx, st, stt, stx)
    if _laddered(n):
        square = _moment("rsq_of", lambda m: S.null_div(m["ab"] * m["ab"], m["aa"] * m["bb"]), _moments(int(n), x, _clock()))
    else:
        square = _rolling("rsq", F.regr_r2, n, x, POS)
    return _map("rsq_mask", lambda r, s: F.when((s > FLAT_STD) | s.isNull(), S.nan_to_null(r)), square, std(x, n))


def resi(x, n):
    """Residual of the newest row against its window's line."""
    x = _num(x)
    if n == 0:
        c, sx, _, st, stt, stx, d = _running_regression(x)
        return _map("resi0", lambda d, p, c, sx, st, stt, stx: d - (
            sx / c + S.null_div(stx - st * sx / c, stt - st * st / c) * (p - st / c)),
            d, POS, c, sx, st, stt, stx)
    if _laddered(n):
        return _map("resi_of", lambda v, p, m: v - (m["a"] + S.nan_to_null(S.null_div(m["ab"], m["bb"])) * (p - m["b"])), x, POS, _moments(int(n), x, _clock()))
    t = _map("pos_of", lambda p, c: F.when(c.isNotNull(), p.cast("double")), POS, x)
    return _map("resi", lambda v, p, m, b, pm: v - (m + S.nan_to_null(b) * (p - pm)),
                x, POS, mean(x, n), _rolling("slope", F.regr_slope, n, x, POS), mean(t, n))


def wma(x, n, normalize=False):
    """Linearly weighted mean; by default divided by the non-missing count as well."""
    x = _num(x)

    def f(a):
        size = F.size(a)
        total = F.aggregate(F.transform(a, lambda s, i: s["v"] * (i + 1)), F.lit(0.0),
                            lambda acc, v: acc + F.coalesce(v, F.lit(0.0)))
        valid = F.size(F.filter(a, lambda s: s["v"].isNotNull()))
        weights = size * (size + 1) / F.lit(2.0)
        if normalize:
            weights = F.aggregate(F.transform(a, lambda s, i: F.when(s["v"].isNotNull(), i + 1.0)), F.lit(0.0),
                                  lambda acc, v: acc + F.coalesce(v, F.lit(0.0)))
            return F.when(valid > 0, total / weights)
        return F.when(valid > 0, total / weights / valid)

    def win(fr, c):
        return F.collect_list(F.struct(c.alias("v"))).over(fr.so_far() if n == 0 else fr.rows(int(n)))

    return _map("wma", f, _win("structs", win, x, params=(n,), back=math.inf if n == 0 else n - 1),
                params=(normalize,))


def ema(x, n, adjust=True):
    """Exponentially weighted mean; span n >= 1, or alpha n in (0, 1), or n = 0.

    The weighted sums are running sums inside short position blocks, rescaled
    to the block start, plus the previous block's total.  Blocks are long
    enough for anything older to weigh under 1e-100, so it equals the full
    recurrence in double precision without a Python worker.  ``adjust=False``
    gives the first value its full weight and assumes no gaps after it.
    """
    x = _num(x)
    if n == 0:
        return _ema_growing(x)
    alpha = float(n) if n < 1 else 2.0 / (n + 1.0)
    if alpha >= 1.0:
        return ffill(x)
    d = 1.0 - alpha
    length = max(16, int(230.0 / -math.log(d)))
    blk = _map("ema_block", lambda p: F.floor((p - 1) / length), POS, params=(length,))
    off = _map("ema_off", lambda p: ((p - 1) % length).cast("double"), POS, params=(length,))
    if adjust:
        wt = _map("ema_w", lambda c: F.when(c.isNotNull(), 1.0).otherwise(0.0), x)
    else:
        seen = _acc("count", x)
        wt = _map("ema_w0", lambda c, s: F.when(c.isNull(), 0.0).when(s == 1, 1.0).otherwise(alpha), x, seen,
                  params=(alpha,))
    scale = _map("ema_scale", lambda w, o: w * F.pow(F.lit(d), -o), wt, off, params=(d,))
    term = _map("ema_term", lambda s, c: s * F.coalesce(c, F.lit(0.0)), scale, x)

    def total(f, t, b, p):
        return F.sum(t).over(f.within(b))

    def carry(f, t, b, p):
        return F.sum(t).over(f.previous(b))

    def parts(e):
        return (_win("ema_in", total, e, blk, POS, params=(length,), back=length),
                _win("ema_carry", carry, e, blk, POS, params=(length,), back=2 * length))

    (ni, nc), (di, dc) = parts(term), parts(scale)

    def ratio(ni, nc, di, dc, o):
        decay, older = F.pow(F.lit(d), o), F.pow(F.lit(d), o + length)
        num = decay * ni + F.coalesce(older * nc, F.lit(0.0))
        den = decay * di + F.coalesce(older * dc, F.lit(0.0))
        return F.when(den > 0, num / den)

    # a missing input repeats the last average, however long the gap is
    return ffill(_map("ema_at", lambda c, *r: F.when(c.isNotNull(), ratio(*r)), x, ni, nc, di, dc, off,
                      params=(d, length)))


def _ema_growing(x):
    def f(a):
        n = F.size(a)
        g = 1.0 - 2.0 / (1.0 + n)
        w = F.transform(a, lambda s, i: F.pow(g, (n - 1 - i).cast("double")))
        num = F.aggregate(F.zip_with(a, w, lambda s, k: F.coalesce(s["v"], F.lit(0.0)) * k), F.lit(0.0),
                          lambda acc, v: acc + v)
        some = F.exists(a, lambda s: s["v"].isNotNull())
        return F.when(some, num / F.aggregate(w, F.lit(0.0), lambda acc, v: acc + v))
    return _map("ema0", f, _win("structs", lambda fr, c: F.collect_list(F.struct(c.alias("v"))).over(fr.so_far()),
                                x, params=(0,), back=math.inf))


# pairs ------------------------------------------------------------------------

def _paired(a, b):
    """Both sides restricted to rows where the other one exists."""
    keep = lambda x, y: _map("paired", lambda u, v: F.when(v.isNotNull(), u), x, y)
    return keep(a, b), keep(b, a)


def cov(a, b, n):
    a, b = _num(a), _num(b)
    if n == 0:
        p, q = _paired(a, b)
        c, sp = _running_moments(p, 1)
        _, sq = _running_moments(q, 1)
        spq = _acc("sum", mul(_centred(p), _centred(q)))
        return _map("cov0", lambda c, sp, sq, spq: S.nan_to_null(F.when(c > 1, (spq - sp * sq / c) / (c - 1))), c, sp, sq, spq)
    if _laddered(n):
        return _moment("cov_of", lambda m: S.nan_to_null(F.when(m["n"] > 1, m["ab"] * m["n"] / (m["n"] - 1))), _moments(int(n), a, b))
    return _rolling("cov", F.covar_samp, n, a, b)


def corr(a, b, n):
    """Pairwise-complete correlation, missing where either side is flat."""
    a, b = _num(a), _num(b)
    if n == 0:
        p, q = _paired(a, b)
        return _map("corr0", lambda c, x, y: F.when((x > FLAT_STD) & (y > FLAT_STD), c / (x * y)),
                    cov(a, b, 0), std(p, 0), std(q, 0))
    p, q = _paired(a, b)
    flat = lambda s: (s > FLAT_STD) | s.isNull()
    if _laddered(n):
        ratio = _moment("corr_of", lambda m: S.nan_to_null(F.try_divide(m["ab"], F.sqrt(m["aa"]) * F.sqrt(m["bb"]))), _moments(int(n), a, b))
        return _map("corr_mask", lambda r, s, t: F.when(flat(s) & flat(t), r), ratio, std(a, n), std(b, n))
    ratio = _map("corr", lambda c, u, v: S.nan_to_null(F.try_divide(c, u * v)), cov(a, b, n), std(p, n), std(q, n))
    return _map("corr_mask", lambda r, s, t: F.when(flat(s) & flat(t), r), ratio, std(a, n), std(b, n))


def full_window(e: Expr, x, n: int) -> Expr:
    """Keep ``e`` only where the last n rows hold n non-missing ``x``."""
    return _map("full", lambda v, c: F.when(c == n, v), e, count(x, n), params=(n,))


# calendar-day windows -----------------------------------------------------------

def day_last(x):
    """Last non-missing value of the row's day."""
    return _win("day_last", lambda f, c: F.last(c, True).over(f.whole_day()), _num(x),
                back=math.inf)


def day_cumsum(x, first_minute: int, last_minute: int):
    """Running sum within [first, last] minute of the day; zero outside."""
    x = _num(x)

    def f(fr, c):
        m = fr.minute_of_day()
        inside = m.between(first_minute, last_minute)
        return F.when(inside, F.sum(F.when(inside, c)).over(fr.day_so_far())).otherwise(F.lit(0.0))

    return _win("day_cumsum", f, x, params=(first_minute, last_minute), back=math.inf)


def date_of() -> Expr:
    return _win("date", lambda f: F.to_date(f.time))


def series_rank(x) -> Expr:
    """Percentile rank of each value within its instrument's whole history."""
    return Expr("series", "series_rank", (_num(x),))


_ROLLING = {
    "mean": mean, "sum": sum_, "std": std, "var": var, "skew": skew, "kurt": kurt, "max": max_,
    "min": min_, "count": count, "median": med, "mad": mad, "rank": rank, "quantile": quantile,
    "wma": wma, "ema": ema, "slope": slope,
}
