"""Composite plans: the registered queries and the mapping of the provided tables to facts."""

MODULES = ("business", "temporal", "writing", "graphs", "relational", "profiles", "matching", "documents", "stored", "further", "records", "files")


def load():
    """The query registry, with every module of queries imported."""
    import importlib

    for module in MODULES:
        importlib.import_module(f"factloom.plans.{module}")
    from factloom.plans import registry

    return registry
