"""Registered queries."""
from importlib import import_module

MODULES = ["core", "tables", "text", "searching", "datasets", "streams"]


def load() -> None:
    """Import the plan modules, which register their queries."""
    for name in MODULES:
        import_module(f"quiremill.plans.{name}")
