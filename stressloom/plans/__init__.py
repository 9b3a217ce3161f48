"""Registered queries, one module per operator family."""

from importlib import import_module

MODULES = ["basics", "scalars", "aggregations", "windowing", "joins", "evaluation", "composition", "models", "streams"]


def load_catalogue():
    from stressloom.plans.registry import CATALOGUE

    for m in MODULES:
        import_module(f"stressloom.plans.{m}")
    return dict(sorted(CATALOGUE.items()))
