"""How a module of plans registers its queries."""

from __future__ import annotations


class Registry(dict):
    """name -> (query, SQL or None)"""

    def query(self, name: str, sql: str | None = None):
        def add(f):
            self[name] = (f, sql)
            return f

        return add
