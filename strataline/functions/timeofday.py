"""Trading-session minutes, session buckets and fiscal periods."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: sessions as [open, close) minutes of the day
SESSIONS = {
    "cn": [(9 * 60 + 30, 11 * 60 + 30), (13 * 60, 15 * 60)],
    "us": [(9 * 60 + 30, 16 * 60)],
    "tw": [(9 * 60, 13 * 60 + 30)],
}


def minute_of_day(ts: Column) -> Column:
    return F.hour(ts) * 60 + F.minute(ts)


def session_index(ts: Column, region: str = "cn") -> Column:
    """Minutes since the open, sessions joined end to end; NULL outside."""
    m, out, base = minute_of_day(ts), None, 0
    for a, b in SESSIONS[region]:
        hit = (m >= a) & (m < b)
        out = F.when(hit, m - a + base) if out is None else out.when(hit, m - a + base)
        base += b - a
    return out


def session_minutes(region: str, every: int = 1) -> list[int]:
    """Minutes of the day on which a session bar of ``every`` minutes starts."""
    return [m for a, b in SESSIONS[region] for m in range(a, b)][::every]


def index_range(start: str, end: str, every: int = 1, region: str = "cn") -> tuple[int, int]:
    """First and last bar index inside a closed time range of the day."""
    def minute(t):
        h, m = t.split(":")[:2]
        return int(h) * 60 + int(m)
    bars = session_minutes(region, every)
    inside = [i for i, m in enumerate(bars) if minute(start) <= m <= minute(end)]
    first = sum(m < minute(start) for m in bars)
    return (inside[0], inside[-1]) if inside else (first, first - 1)


def session_bucket(ts: Column, every: int, region: str = "cn") -> Column:
    """Start of the session bar holding ``ts``; before the open it is the day's last bar."""
    m = minute_of_day(ts)
    starts = session_minutes(region, every)
    at = F.lit(starts[-1])
    base, spans = 0, []
    for a, b in SESSIONS[region]:
        own = [s for s in starts if a <= s < b]
        if own:
            spans.append((own[0], own[-1]))
    pick = F.when(m < spans[0][0], at)
    for (first, last), nxt in zip(spans, spans[1:] + [(None, None)]):
        inside = F.least(F.lit(first) + F.floor((m - first) / every).cast("int") * every, F.lit(last))
        cond = (m >= first) if nxt[0] is None else (m >= first) & (m < nxt[0])
        pick = pick.when(cond, inside)
    return (F.date_trunc("day", ts) + F.make_dt_interval(mins=pick)).cast("timestamp_ntz")


def period_index(period: Column, quarterly: bool) -> Column:
    """Consecutive integer of YYYY or YYYYQQ."""
    return F.floor(period / 100) * 4 + period % 100 - 1 if quarterly else period


def period_from_index(idx: Column, quarterly: bool) -> Column:
    return (F.floor(idx / 4) * 100 + idx % 4 + 1).cast("int") if quarterly else idx.cast("int")


def period_offset(first_year: Column, period: Column, quarterly: bool) -> Column:
    base = first_year * 4 if quarterly else first_year
    return period_index(period, quarterly) - base


def periods_between(first: Column, last: Column, quarterly: bool) -> Column:
    """Array of every period from first to last, both included."""
    ids = F.sequence(period_index(first, quarterly), period_index(last, quarterly))
    return F.transform(ids, lambda i: period_from_index(i, quarterly))


def quarter_of(date: Column) -> Column:
    return F.year(date) * 100 + F.quarter(date)
