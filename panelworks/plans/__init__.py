"""Registered queries and the SQL they are checked against."""

from importlib import import_module

MODULES = ("factors", "vocabulary", "research", "signals", "learning", "scoring", "decisions")


def load() -> None:
    """Import every query module so that its queries register themselves."""
    for name in MODULES:
        import_module(f"{__name__}.{name}")
