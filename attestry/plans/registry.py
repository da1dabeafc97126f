"""All queries of the library and their SQL, by name."""

import importlib
import importlib.util
from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable:
    """Registers f(spark, sf_dir), and SQL that may name the views of fixtures."""
    from attestry.plans.fixtures import oracle

    def register(f: Callable) -> Callable:
        QUERIES[name] = f
        if sql:
            ORACLES[name] = oracle(sql)
        return f

    return register


for _module in ("trust_queries", "policy_queries", "ledger_queries", "html_queries", "edit_queries", "layout_queries", "generic_queries", "stream_queries"):
    if importlib.util.find_spec(f"attestry.plans.{_module}"):
        importlib.import_module(f"attestry.plans.{_module}")
