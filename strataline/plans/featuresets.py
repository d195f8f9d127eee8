"""Ready-made feature sets, as dicts of expressions."""

from __future__ import annotations

from strataline.plans import expr as E
from strataline.plans.expr import Expr, field

O, H, L, C, V, VW = (field(n) for n in ("open", "high", "low", "close", "volume", "vwap"))
TINY = 1e-12

# ------------------------------------------------------------ 158 factors

WINDOWS = (5, 10, 20, 30, 60)


def kbar() -> dict[str, Expr]:
    """Shape of the bar: body, range, shadows and balance, over open and over range."""
    top, bottom, span = E.greater(O, C), E.less(O, C), H - L + TINY
    # fixed values: names and formulas of the published set
    return {
        "KMID": (C - O) / O,
        "KLEN": (H - L) / O,
        "KMID2": (C - O) / span,
        "KUP": (H - top) / O,
        "KUP2": (H - top) / span,
        "KLOW": (bottom - L) / O,
        "KLOW2": (bottom - L) / span,
        "KSFT": (2 * C - H - L) / O,
        "KSFT2": (2 * C - H - L) / span,
    }


def _up_down(x):
    """Positive moves, negative moves and absolute moves of a series."""
    p = E.ref(x, 1)
    return E.greater(x - p, 0), E.greater(p - x, 0), E.abs_(x - p)


def _balance(x, n):
    up, down, move = (E.sum_(m, n) for m in _up_down(x))
    base = move + TINY
    return up / base, down / base, (up - down) / base


def _moves(n):
    return E.abs_(C / E.ref(C, 1) - 1) * V


# fixed values, the published families: family -> (column prefix, factor for a window)
ROLLING = {
    "ROC": ("ROC", lambda n: E.ref(C, n) / C),
    "MA": ("MA", lambda n: E.mean(C, n) / C),
    "STD": ("STD", lambda n: E.std(C, n) / C),
    "BETA": ("BETA", lambda n: E.slope(C, n) / C),
    "RSQR": ("RSQR", lambda n: E.rsquare(C, n)),
    "RESI": ("RESI", lambda n: E.resi(C, n) / C),
    "MAX": ("MAX", lambda n: E.max_(H, n) / C),
    "LOW": ("MIN", lambda n: E.min_(L, n) / C),
    "QTLU": ("QTLU", lambda n: E.quantile(C, n, 0.8) / C),
    "QTLD": ("QTLD", lambda n: E.quantile(C, n, 0.2) / C),
    "RANK": ("RANK", lambda n: E.rank(C, n)),
    "RSV": ("RSV", lambda n: (C - E.min_(L, n)) / (E.max_(H, n) - E.min_(L, n) + TINY)),
    "IMAX": ("IMAX", lambda n: E.idxmax(H, n) / n),
    "IMIN": ("IMIN", lambda n: E.idxmin(L, n) / n),
    "IMXD": ("IMXD", lambda n: (E.idxmax(H, n) - E.idxmin(L, n)) / n),
    "CORR": ("CORR", lambda n: E.corr(C, E.log(V + 1), n)),
    "CORD": ("CORD", lambda n: E.corr(C / E.ref(C, 1), E.log(V / E.ref(V, 1) + 1), n)),
    "CNTP": ("CNTP", lambda n: E.mean(C > E.ref(C, 1), n)),
    "CNTN": ("CNTN", lambda n: E.mean(C < E.ref(C, 1), n)),
    "CNTD": ("CNTD", lambda n: E.mean(C > E.ref(C, 1), n) - E.mean(C < E.ref(C, 1), n)),
    "SUMP": ("SUMP", lambda n: _balance(C, n)[0]),
    "SUMN": ("SUMN", lambda n: _balance(C, n)[1]),
    "SUMD": ("SUMD", lambda n: _balance(C, n)[2]),
    "VMA": ("VMA", lambda n: E.mean(V, n) / (V + TINY)),
    "VSTD": ("VSTD", lambda n: E.std(V, n) / (V + TINY)),
    "WVMA": ("WVMA", lambda n: E.std(_moves(n), n) / (E.mean(_moves(n), n) + TINY)),
    "VSUMP": ("VSUMP", lambda n: _balance(V, n)[0]),
    "VSUMN": ("VSUMN", lambda n: _balance(V, n)[1]),
    "VSUMD": ("VSUMD", lambda n: _balance(V, n)[2]),
}


def factors158(windows=WINDOWS, price_fields=("open", "high", "low", "vwap"), price_lags=(0,),
               volume_lags=(), include=None, exclude=()) -> dict[str, Expr]:
    """Bar shape, relative prices and the rolling families over ``windows``."""
    out = kbar()
    for f in price_fields:
        for k in price_lags:
            out[f"{f.upper()}{k}"] = (E.ref(field(f), k) if k else field(f)) / C
    for k in volume_lags:
        out[f"VOLUME{k}"] = (E.ref(V, k) if k else V) / (V + TINY)
    for family, (prefix, make) in ROLLING.items():
        if family in exclude or (include is not None and family not in include):
            continue
        for n in windows:
            out[f"{prefix}{n}"] = make(n)
    return out


def lags360(depth: int = 60) -> dict[str, Expr]:
    """The last ``depth`` values of six fields relative to the current close and volume."""
    out = {}
    for f in ("close", "open", "high", "low", "vwap", "volume"):
        base = V + TINY if f == "volume" else C
        for k in range(depth - 1, -1, -1):
            out[f"{f.upper()}{k}"] = (E.ref(field(f), k) if k else field(f)) / base
    return out


def forward_label(price: str = "close", horizon: int = 1) -> Expr:
    """Return from the next row to ``horizon`` rows after it."""
    p = field(price)
    return E.ref(p, -1 - horizon) / E.ref(p, -1) - 1


# ------------------------------------------------------------ minute sets

def _known(p: Expr) -> Expr:
    """The price, or the close where it is missing."""
    return E.if_(E.is_null(p), C, p)


def minute_features(day_rows: int = 240, quotes: bool = False, volume_mean_days: int = 30) -> dict[str, Expr]:
    """Prices over yesterday's close near the end of day, and volume over its long mean.

    Rows are kept where ``trading`` holds (see :func:`trading`).
    """
    base = E.day_last(E.ref(E.ffill(C), day_rows + 3))
    fields = {"open": O, "high": H, "low": L, "close": C, "vwap": VW}
    if quotes:
        fields["vwap"] = E.if_(E.is_inf(VW), C, VW)
        fields |= {"bid": field("bid"), "ask": field("ask")}
    out = {}
    for lag, tag in ((0, ""), (day_rows, "_1")):
        for name, p in fields.items():
            v = _known(p)
            out[name + tag] = E.ffill((E.ref(v, lag) if lag else v) / base)
    long_mean = E.ref(E.day_last(E.mean(V, day_rows * volume_mean_days)), day_rows)
    for lag, tag in ((0, ""), (day_rows, "_1")):
        ratio = (E.ref(V, lag) if lag else V) / long_mean
        ratio = E.if_(E.is_null(ratio), 0.0, ratio)
        out["volume" + tag] = E.if_(ratio >= 0, ratio, 0.0)
    return out


def minute_backtest_fields() -> dict[str, Expr]:
    """Close, vwap, volume and factor with missing values resolved."""
    zero = lambda n: E.if_(E.is_null(field(n)), 0.0, field(n))
    filled = E.ffill(C)
    return {"close0": filled, "vwap0": E.if_(E.is_null(VW), filled, VW), "volume0": zero("volume"), "factor0": zero("factor")}


def trading(field_name: str = "paused_num") -> Expr:
    """Row condition: at least the second row since trading resumed."""
    return field(field_name) > 1.001


def realised_volatility(window: int) -> Expr:
    """Sample standard deviation of log returns from their sum and sum of squares."""
    lr = E.log(C / E.ref(C, 1))
    return (E.sum_(lr ** 2.0, window) / (window - 1) - E.sum_(lr, window) ** 2.0 / (window * (window - 1.0))) ** 0.5


def one_row_return(price: str = "close") -> Expr:
    return field(price) / E.ref(field(price), 1) - 1


def benchmark_fields(window: int = 252) -> dict[str, Expr]:
    """What to evaluate on the benchmark itself before :func:`beta_and_excess`."""
    return {"bench_ret": one_row_return(), "bench_var": E.var(one_row_return(), window)}


def beta_and_excess(window: int = 252) -> dict[str, Expr]:
    """Rolling beta, beta-adjusted and plain excess return against the benchmark columns."""
    ret, mkt = one_row_return(), field("bench_ret")
    beta = E.cov(ret, mkt, window) / field("bench_var")
    return {"beta": beta, "excess": ret - beta * mkt, "excess_unit": ret - mkt}


# ------------------------------------------------------------ technical sets

def _full(f, x, n):
    return E.full_window(f(x, n), x, n)


def _change(x, k=1):
    return x / E.ref(x, k) - 1


def crypto_technical(fast=12, slow=26, signal=9, rsi_len=14, long=96, ema_short=48, ema_long=96, bands=5) -> dict[str, Expr]:
    """Returns, 96-bar volatility and volume ratios, RSI, MACD, EMAs, bands and next direction."""
    ret, d = _change(C), E.delta(C, 1)
    gain, loss = E.ema(E.greater(d, 0), 1.0 / rsi_len), E.ema(E.greater(0.0 - d, 0), 1.0 / rsi_len)
    macd = E.ema(C, fast) - E.ema(C, slow)
    mid = _full(E.mean, C, bands)
    width = 2 * _full(E.std, C, bands) * ((bands - 1) / bands) ** 0.5
    vol_ma = _full(E.mean, V, long)
    return {
        "returns": ret, "log_returns": E.log1p(ret), "volatility": _full(E.std, ret, long), "volume_ma": vol_ma,
        "volume_std": _full(E.std, V, long), "volume_ratio": V / vol_ma, "rsi": 100 - 100 / (1 + gain / loss),
        "macd": macd, "macd_signal": E.ema(macd, signal), "ema_12": E.ema(C, ema_short), "ema_24": E.ema(C, ema_long),
        "bb_upper": mid + width, "bb_middle": mid, "bb_lower": mid - width, "target": E.ref(ret, -1) > 0,
    }


def _rsi_simple(n=14):
    d = E.delta(C, 1)
    gain, loss = E.if_(d > 0, d, 0.0), E.if_(d < 0, 0.0 - d, 0.0)
    return 100 - 100 / (1 + E.full_window(E.mean(gain, n), gain, n) / E.full_window(E.mean(loss, n), loss, n))


def crypto_alphas(groups=("price", "volume", "momentum", "volatility")) -> dict[str, Expr]:
    """Twenty alphas in four groups; ranks run over each series' whole history."""
    rk = E.series_rank
    ret, d = _change(C), E.delta(C, 1)
    std20, mean20 = _full(E.std, C, 20), _full(E.mean, C, 20)
    typical = (H + L + C) / 3
    shocked = E.if_(ret < 0, _full(E.std, ret, 20), C) ** 2.0
    corr = lambda a, b, n: _pair_full(E.corr(a, b, n), a, b, n)
    ts_rank = lambda x, n: _full(E.rank, x, n)
    d7 = E.delta(C, 7)
    prev = E.ref(C, 1)
    true_range = E.greater(H - L, E.greater(E.abs_(H - prev), E.abs_(L - prev)))
    # fixed values: names and formulas of the published alphas
    every = {
        "price": {
            "alpha001": rk(_full(E.idxmax, shocked, 5) - 1) - 0.5,
            "alpha002": -corr(rk(E.delta(E.log(V), 2)), rk((C - O) / O), 6),
            "alpha003": -corr(rk(H), rk(V), 5),
            "alpha004": -ts_rank(rk(L), 9),
            "alpha005": rk(O - _full(E.sum_, typical, 10) / 10) * (-E.abs_(rk(C - typical))),
        },
        "volume": {
            "alpha101": -corr(O, V, 10),
            "alpha102": E.if_(_full(E.mean, V, 20) < V, -ts_rank(E.abs_(d7), 10) * E.sign(d7), -1.0),
            "alpha103": rk(_change(V, 5)),
            "alpha104": corr(_change(V, 5), _change(C, 5), 10),
            "alpha105": rk(_full(E.sum_, C * V, 10) / _full(E.sum_, V, 10)),
        },
        "momentum": {
            "alpha201": rk(_rsi_simple()),
            "alpha202": rk(E.ema(C, 12, adjust=False) - E.ema(C, 26, adjust=False)),
            "alpha203": rk(d + E.delta(C, 2) + E.delta(C, 3)),
            "alpha204": E.if_(C > mean20, 1.0, -1.0),
            "alpha205": -rk(E.delta(C, 5)),
        },
        "volatility": {
            "alpha301": rk(_full(E.mean, true_range, 14)),
            "alpha302": (C - mean20) / (2 * std20),
            "alpha303": E.if_(C > mean20 + 2 * std20, 1.0, 0.0),
            "alpha304": ts_rank(std20, 10),
            "alpha305": -rk(std20),
        },
    }
    return {k: v for g in groups for k, v in every[g].items()}


def _pair_full(e, a, b, n):
    return E.full_window(e, E.where(~E.is_null(a) & ~E.is_null(b), 1.0), n)


def technical2() -> dict[str, Expr]:
    """Full-window moving averages, simple RSI, log-return volatility and bar ratios."""
    logret = E.log1p(_change(C))
    out = {}
    for n in (5, 10, 20, 60):
        out[f"ma_{n}"], out[f"ma_vol_{n}"] = _full(E.mean, C, n), _full(E.mean, V, n)
    out["rsi"] = _rsi_simple()
    for n in (5, 20):
        out[f"volatility_{n}"] = _full(E.std, logret, n)
    return out | {"hl_ratio": H / L, "co_ratio": C / O, "vol_ratio": V / out["ma_vol_20"]}
