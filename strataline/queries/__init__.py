"""Registered queries: each operator on data derived from the given tables."""

from __future__ import annotations

import importlib

MODULES = ("q_elements", "q_timeseries", "q_featuresets", "q_universe", "q_processors", "q_sets", "q_quality",
           "q_sources", "q_pit", "q_sequence", "q_signals", "q_portfolio", "q_orders", "q_risk", "q_models",
           "q_streams")


def load_all():
    from strataline.queries import common

    for m in MODULES:
        try:
            importlib.import_module(f"strataline.queries.{m}")
        except ModuleNotFoundError as e:
            if m not in str(e):
                raise
    return common.QUERIES, common.ORACLE
