"""All queries of the library by name, and the SQL that each must agree with."""

from __future__ import annotations

from .plans import axis_plans, host_plans, log_plans, search_plans, series_plans, view_plans

PLANS = search_plans.PLANS | series_plans.PLANS | view_plans.PLANS | log_plans.PLANS | host_plans.PLANS | axis_plans.PLANS
flagship = view_plans.flagship


def queries():
    return {name: run for name, (run, _) in PLANS.items()}


def oracle_sql():
    return {name: sql for name, (_, sql) in PLANS.items() if sql}
