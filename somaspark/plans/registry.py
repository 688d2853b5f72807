"""A module's queries and their SQL, filled by a decorator."""

from __future__ import annotations


class Registry:
    def __init__(self):
        self.queries, self.sql = {}, {}

    def __call__(self, name: str, sql: str | None = None):
        def put(f):
            self.queries[name] = f
            if sql:
                self.sql[name] = sql
            return f

        return put
