"""How a module of operators registers its queries together with their SQL."""

from collections.abc import Callable


def family() -> tuple[dict, dict, Callable]:
    """Two empty registers, of queries and of SQL, and the decorator that fills them under a function's name."""
    queries: dict = {}
    oracles: dict = {}

    def query(sql: str | None):
        def add(f):
            queries[f.__name__] = f
            if sql:
                oracles[f.__name__] = sql
            return f

        return add

    return queries, oracles, query
