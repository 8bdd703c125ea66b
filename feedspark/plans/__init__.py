"""Registered queries over the shared tables, each with its SQL twin."""

from feedspark.plans.registry import Registry


def all_queries() -> Registry:
    from feedspark.plans import documents, extraction, hierarchy, markup, relational, scalars, watching

    registry = Registry()
    for module in (relational, scalars, hierarchy, documents, extraction, markup, watching):
        registry.include(module.R)
    return registry
