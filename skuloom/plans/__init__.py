"""Registered queries, grouped by the part of the pipeline they belong to."""


def load() -> None:
    import importlib

    for name in MODULES:
        importlib.import_module(f"skuloom.plans.{name}")


MODULES = ("rows", "export", "lookup", "state", "pages", "documents", "streams")
