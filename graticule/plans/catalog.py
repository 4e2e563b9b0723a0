"""Registry that ties an operator id to its query and its checking SQL."""

import functools

from graticule.session import ship_package

QUERIES = {}
SQL = {}

# Table expressions shared by the checking SQL, each with what it builds on.
VIEWS = {}


def view(name, body, needs=()):
    VIEWS[name] = (tuple(needs), body)


def with_views(names, body):
    """Prefix ``body`` with the named table expressions in dependency order."""
    done = []

    def add(name):
        if name in done:
            return
        for need in VIEWS[name][0]:
            add(need)
        done.append(name)

    for name in names:
        add(name)
    if not done:
        return body
    parts = [f"{name} as ({VIEWS[name][1]})" for name in done]
    if body.lstrip().lower().startswith("with "):
        rest = body.lstrip()[5:]
        if rest.lower().startswith("recursive "):
            return "with recursive " + ", ".join(parts) + ", " + rest[10:]
        return "with " + ", ".join(parts) + ", " + rest
    return "with " + ", ".join(parts) + " " + body


def query(name, sql=None, views=()):
    """Register ``fn(spark, sf_dir) -> DataFrame`` under an operator id."""

    def register(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")

        @functools.wraps(fn)
        def run(spark, folder):
            ship_package(spark)
            return fn(spark, folder)

        QUERIES[name] = run
        if sql is not None:
            SQL[name] = with_views(views, sql)
        return fn

    return register
