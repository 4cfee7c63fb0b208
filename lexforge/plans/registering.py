"""Collections of registered queries and their SQL over derived views."""

from __future__ import annotations

from .fixtures import view, with_sql


class Register:
    """Queries by name, each a job over a function from view name to frame, and their SQL."""

    def __init__(self):
        self.queries: dict = {}
        self.sql: dict[str, str] = {}

    def __call__(self, name: str, job, sql: str | None = None) -> None:
        self.queries[name] = lambda spark, sf_dir: job(lambda table: view(spark, sf_dir, table))
        if sql:
            self.sql[name] = with_sql(sql)
