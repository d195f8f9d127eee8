"""Row windows of a panel in arrays: a task takes the rows of an instrument.

Spark's sliding frames update every aggregate row by row for every row of the window; the same sums over arrays cost a
fraction.  A window of n rows is merged from two windows of half its length, which other windows share, so its cost grows
with the logarithm of n, and all columns that need the same statistics are merged at once.  Declared per panel
(``Panel(df, arrays=True)``), for series that fit a task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame

from strataline.plans.expr import LONG_WINDOW, Expr

ROWS = 2048      # rows whose windows are in memory at once
PLAIN = ("sum", "count", "mean", "max", "min", "std", "cov", "slope", "rsq")


def _short(n) -> bool:
    return isinstance(n, int) and 0 < n < LONG_WINDOW


def in_arrays(e: Expr) -> Expr:
    """The tree with its short row windows as nodes ``arr_…`` that :func:`array_windows` computes."""
    if e.op == "quantile" and e.args[0].op == "sorted" and _short(e.args[0].params[0]):
        return _node("arr_quantile", e.args[0].args, (e.args[0].params[0], *e.params))
    if e.op == "rank" and e.args[1].op == "sorted" and _short(e.args[1].params[0]):
        return _node("arr_rank", e.args[:1], e.args[1].params)
    if e.op == "offset" and e.args[0].op in ("idxmax", "idxmin") and _short(e.args[0].params[0]):
        return _node(f"arr_{e.args[0].op}", e.args[0].args[:1], e.args[0].params)
    if e.op == "resi" and e.args[3].op == "slope" and _short(e.args[3].params[0]):
        return _node("arr_resi", e.args[:1], e.args[3].params)
    if e.kind == "win" and e.op in PLAIN and len(e.params) == 1 and _short(e.params[0]):
        return _node(f"arr_{e.op}", e.args[:1] if e.op in ("slope", "rsq") else e.args, e.params)
    if not e.args:
        return e
    return Expr(e.kind, e.op, [in_arrays(a) for a in e.args], e.params, e.make, e.own_back, e.own_ahead, e.boolean, e.span_us)


def _node(op: str, args, params) -> Expr:
    return Expr("win", op, [in_arrays(a) for a in args], params, back=params[0] - 1)


KINDS = {"count": "sums", "sum": "sums", "mean": "sums", "std": "moments", "slope": "line", "rsq": "line", "resi": "line",
         "max": "top", "idxmax": "top", "min": "low", "idxmin": "low"}


class _Merged:
    """Statistics of trailing windows of the rows lo … hi, of several columns at once; merged from halves, each made once.

    An array of windows of n rows ends with the window of the last row and begins with the first whole one; the rows of
    ``x`` (columns x rows, missing as NaN) begin ``reach`` rows before lo, missing ones where the series has none.
    """

    def __init__(self, ns: list[int], x: np.ndarray, second: np.ndarray | None = None):
        self.ns, self.x, self.second, self.made = ns, x, second, {}

    def split(self, n: int) -> int:
        """The older part's rows: windows that are wanted anyway, else halves."""
        whole = [a for a in self.ns if n - a in self.ns]
        return n // 2 if n // 2 in whole or not whole else max(whole)

    def of(self, kind: str, n: int) -> tuple[np.ndarray, ...]:
        if (kind, n) not in self.made:
            if n == 1:
                out = getattr(self, f"_{kind}_one")()
            else:
                a = self.split(n)
                older = [v[:, :self.x.shape[1] - n + 1] for v in self.of(kind, a)]
                newer = [v[:, a:] for v in self.of(kind, n - a)]
                out = getattr(self, f"_{kind}_two")(older, newer, a)
            self.made[kind, n] = out
        return self.made[kind, n]

    def _sums_one(self):
        known = ~np.isnan(self.x)
        return known.astype(float), np.where(known, self.x, 0.0)

    def _sums_two(self, a, b, size):
        return a[0] + b[0], a[1] + b[1]

    def _moments_one(self):
        """Count, mean and squares about it."""
        return *self._sums_one(), np.zeros(self.x.shape)

    def _moments_two(self, a, b, size):
        k = a[0] + b[0]
        d, share = b[1] - a[1], b[0] / np.maximum(k, 1.0)
        return k, a[1] + d * share, a[2] + b[2] + d * d * (a[0] * share)

    def _line_one(self):
        """Moments, and of the places in the window: mean, squares and products with the values."""
        return *self._moments_one(), *[np.zeros(self.x.shape) for _ in range(3)]

    def _line_two(self, a, b, size):
        k = a[0] + b[0]
        d, share = b[1] - a[1], b[0] / np.maximum(k, 1.0)
        w = a[0] * share
        t = np.where(b[0] > 0, b[3] + size - a[3], 0.0)
        return k, a[1] + d * share, a[2] + b[2] + d * d * w, a[3] + t * share, a[4] + b[4] + t * t * w, a[5] + b[5] + d * t * w

    def _pair_one(self):
        """Of rows where both values are known: count, means and products."""
        both = ~np.isnan(self.x) & ~np.isnan(self.second)
        return both.astype(float), np.where(both, self.x, 0.0), np.where(both, self.second, 0.0), np.zeros(self.x.shape)

    def _pair_two(self, a, b, size):
        k = a[0] + b[0]
        x, y, share = b[1] - a[1], b[2] - a[2], b[0] / np.maximum(k, 1.0)
        return k, a[1] + x * share, a[2] + y * share, a[3] + b[3] + x * y * (a[0] * share)

    def _top_one(self):
        """Best value and its first place in the window."""
        return self.x, np.zeros(self.x.shape)

    def _top_two(self, a, b, size, better=np.greater):
        later = better(b[0], a[0]) | np.isnan(a[0])
        return np.where(later, b[0], a[0]), np.where(later, b[1] + size, a[1])

    _low_one = _top_one

    def _low_two(self, a, b, size):
        return self._top_two(a, b, size, np.less)


def _ranks(x: np.ndarray, ns: list[int], rows: int) -> dict[int, np.ndarray]:
    """Per window length: rows below the last one, half of those equal to it, and a half."""
    v = np.lib.stride_tricks.sliding_window_view(x, rows)[-max(ns):]       # back from the last line, the rows one before
    twice = 2 * (v < v[-1]).view(np.int8) + (v == v[-1]).view(np.int8)
    return {n: twice[-n:].sum(0, dtype=np.int16) / 2 + 0.5 for n in ns}


def _infinite(q: np.ndarray) -> np.ndarray:
    """Windows with an infinite value have no deviation."""
    return np.where(np.isinf(q), np.nan, q)


def _values(columns: dict[str, np.ndarray], lo: int, hi: int, calls: list[tuple]) -> dict[str, np.ndarray]:
    """The values of each call (name, operator, columns, parameters) at the rows lo … hi, missing ones as NaN."""
    reach, rows = max(p[0] for *_, p in calls) - 1, hi - lo
    short = max(0, reach - lo)
    x = {c: np.concatenate([np.full(short, np.nan), v[max(0, lo - reach):hi]]) for c, v in columns.items()}
    sets: dict[str, list] = {}
    for _, op, cs, _ in calls:
        kind = "pair" if op == "cov" else KINDS.get(op, "sums")
        for one in ([tuple(cs)] if op == "cov" else [cs[0]]):
            if one not in (own := sets.setdefault(kind, [])):
                own.append(one)
    if "sums" in sets or "line" in sets or "moments" in sets:      # one set of sums for all columns
        sets["sums"] = sorted({c for k in ("sums", "moments", "line", "top", "low") for c in sets.get(k, [])})
    ns = sorted({p[0] for *_, p in calls})
    merged = {k: _Merged(ns, np.stack([x[c] for c in cs])) if k != "pair" else
              _Merged(ns, np.stack([x[a] for a, _ in cs]), np.stack([x[b] for _, b in cs])) for k, cs in sets.items()}
    at = {k: {c: i for i, c in enumerate(cs)} for k, cs in sets.items()}
    got = lambda kind, n, c: [v[at[kind][c], -rows:] for v in merged[kind].of(kind, n)]
    ranks, sort, done, out = {}, {}, {}, {}
    none = lambda ok, v: np.where(ok, v, np.nan)

    def whole(kind, n, make):
        """What is made for all columns of a set at once."""
        if (kind, n, make) not in done:
            done[kind, n, make] = make(*[v[:, -rows:] for v in merged[kind].of(kind, n)])
        return done[kind, n, make]

    def of(op, cs, params):
        n, c = params[0], cs[0]
        if op in WHOLE:
            kind = KINDS[op]
            return whole(kind, n, WHOLE[op])[at[kind][c]]
        if op in ("max", "min"):
            return got(KINDS[op], n, c)[0]
        if op in ("idxmax", "idxmin"):
            best, place = got(KINDS[op], n, c)
            return none(~np.isnan(best), place + 1.0 - np.maximum(n - 1 - np.arange(lo, hi), 0))
        if op == "cov":
            k, _, _, xy = got("pair", n, tuple(cs))
            return none(k > 1, _infinite(xy) / (k - 1))
        k = got("sums", n, c)[0]
        if op == "quantile":
            if (c, n) not in sort:
                sort[c, n] = np.sort(np.lib.stride_tricks.sliding_window_view(x[c], n)[-rows:], 1)      # missing ones last
            s, r = sort[c, n], np.arange(rows)
            q = np.maximum(k - 1, 0) * params[1]
            low = np.floor(q).astype(int)
            a, b = s[r, low], s[r, np.minimum(low + 1, np.maximum(k - 1, 0).astype(int))]
            return a + (b - a) * (q - low)
        if op == "rank":
            if c not in ranks:
                ranks[c] = _ranks(x[c], sorted({p[0] for _, o, d, p in calls if o == "rank" and d[0] == c}), rows)
            return none(~np.isnan(x[c][-rows:]), ranks[c][n] / k)
        if op == "resi":
            k, mean, _, place, tt, st = got("line", n, c)
            return none(k > 1, x[c][-rows:] - (mean + _infinite(st) / tt * (n - 1 - place)))
        raise ValueError(op)

    for name, op, cs, params in calls:
        out[name] = of(op, cs, params)
    return out


WHOLE = {
    "count": lambda k, s: k, "sum": lambda k, s: np.where(k > 0, s, np.nan), "mean": lambda k, s: s / k,
    "std": lambda k, m, q: np.where(k > 1, np.sqrt(_infinite(q) / (k - 1)), np.nan),
    "slope": lambda k, m, q, t, tt, st: np.where(k > 1, _infinite(st) / tt, np.nan),
    "rsq": lambda k, m, q, t, tt, st: np.where(k > 1, np.where(q == 0, 1.0, st * st / (tt * _infinite(q))), np.nan),
}


def array_windows(df: DataFrame, part: list[str], order: str, wanted: list[tuple[str, Expr, list[str]]]) -> DataFrame:
    """Add ``out`` for each (out, node, columns of its arguments)."""
    calls = [(name, e.op.removeprefix("arr_"), cs, e.params) for name, e, cs in wanted]
    used = sorted({c for _, _, cs, _ in calls for c in cs})
    kept = [c for c in df.columns if c not in used]

    def add(table: pa.Table) -> pa.Table:
        table = table.take(pa.compute.sort_indices(table, [(order, "ascending")]))
        columns = {c: table.column(c).to_numpy().astype(float) for c in used}
        pieces = []
        with np.errstate(all="ignore"):
            for lo in range(0, table.num_rows, ROWS):
                pieces.append(_values(columns, lo, min(lo + ROWS, table.num_rows), calls))
        one = pieces[0] if len(pieces) == 1 else {name: np.concatenate([p[name] for p in pieces]) for name, *_ in calls}
        found = np.stack([one[name] for name, *_ in calls])
        known = np.packbits(~np.isnan(found), axis=1, bitorder="little")
        lists = [pa.Array.from_buffers(pa.float64(), table.num_rows, [pa.py_buffer(k), pa.py_buffer(v)]) for k, v in zip(known, found)]
        return pa.table([*[table.column(c) for c in kept], *lists], names=[*kept, *[name for name, *_ in calls]])

    schema = df.select(*kept).schema
    for name, *_ in calls:
        schema = schema.add(name, "double")
    return df.groupBy(*part).applyInArrow(add, schema)
