"""Rule catalogue, table adapters and the registered queries."""

from importlib import import_module

QUERY_MODULES = ["page_queries", "log_queries", "search_queries", "graph_queries", "text_queries", "run_queries"]


def load_queries() -> None:
    for name in QUERY_MODULES:
        import_module(f"{__name__}.{name}")
