"""Query catalogue, one module per operator family."""

from importlib import import_module

FAMILIES = ("bars", "series", "features", "labels", "study", "factors", "trades", "diagnostics", "entry", "feeds", "streams")


def load() -> None:
    for name in FAMILIES:
        import_module(f"{__name__}.{name}")
