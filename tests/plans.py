"""What Spark is about to run: of intermediate tables and of a query's result."""

from __future__ import annotations

from lumatwin.stage import Stage


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def all_plans(monkeypatch, query):
    """The plans of all tables that a query writes on its way, and of its result."""
    seen, write = [], Stage.write

    def noted(self, df, name):
        seen.append(plan_of(df))
        return write(self, df, name)

    monkeypatch.setattr(Stage, "write", noted)
    last = plan_of(query())
    return [*seen, last]
