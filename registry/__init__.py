"""Queries checked against DuckDB, and their SQL."""


def all_queries():
    from registry import core, learning, models, properties, trades  # noqa: F401

    return dict(core.QUERIES)


def all_sql():
    from registry import sql

    known = all_queries()
    return {name: sql.build(text) for name, text in sql.Q.items() if name in known}
