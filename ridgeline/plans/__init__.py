"""Plans: the engine's named queries, each with its SQL where SQL can express it."""


def all_queries():
    """(queries, SQL) of every module of plans."""
    from ridgeline.plans import details, growth, health, matching, places, serving, visitors  # noqa: F401
    from ridgeline.plans.registry import QUERIES, SQL

    return QUERIES, SQL
