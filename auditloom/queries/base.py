"""Registration of queries with their SQL twins."""

from __future__ import annotations


class Area:
    def __init__(self):
        self.queries: dict = {}
        self.oracle: dict[str, str] = {}

    def query(self, name: str, oracle: str | None = None):
        def add(fn):
            self.queries[name] = fn
            if oracle is not None:
                self.oracle[name] = oracle
            return fn
        return add
