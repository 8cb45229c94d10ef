"""DuckDB statements that re-state every SQL-expressible query independently of Spark."""


def load() -> dict[str, str]:
    import importlib

    out: dict[str, str] = {}
    for name in ("rows", "export", "lookup", "state", "pages", "documents", "streams"):
        out.update(importlib.import_module(f"oracle.{name}").SQL)
    return out
