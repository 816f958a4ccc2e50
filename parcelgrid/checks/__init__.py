"""Every operator as a query over the given tables, with SQL for its expected rows."""
from importlib import import_module

MODULES = ("scalars", "market", "quality", "spatial", "places", "training", "extraction",
           "storage", "valuation", "streams")


def load_all() -> None:
    for name in MODULES:
        import_module(f"parcelgrid.checks.{name}")
