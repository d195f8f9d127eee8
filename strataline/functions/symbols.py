"""Instrument code forms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: device names that cannot be file names on some systems
RESERVED = ["CON", "PRN", "AUX", "NUL"] + [f"{d}{i}" for d in ("COM", "LPT") for i in range(10)]
ESCAPE = "_sym_"


def _cased(c: Column, upper: bool) -> Column:
    return F.upper(c) if upper else F.lower(c)


def suffix_to_prefix(symbol: Column, upper: bool = True) -> Column:
    """600000.SS or 600000.SH -> SH600000; other exchanges keep their name."""
    code, exch = F.substring_index(symbol, ".", 1), F.substring_index(symbol, ".", -1)
    home = F.when(F.lower(exch).isin("sh", "ss"), F.lit("sh")).otherwise(exch)
    return _cased(F.concat(home, code), upper)


def prefix_to_suffix(symbol: Column, upper: bool = True) -> Column:
    """Split the last two characters off after a dot."""
    n = F.length(symbol)
    return _cased(F.concat(F.substring(symbol, F.lit(1), n - 2), F.lit("."), F.substring(symbol, n - 1, F.lit(2))), upper)


def escape_reserved(symbol: Column) -> Column:
    return F.when(F.upper(symbol).isin(RESERVED), F.concat(F.lit(ESCAPE), symbol)).otherwise(symbol)


def unescape_reserved(name: Column) -> Column:
    return F.regexp_replace(name, f"^{ESCAPE}", "")
