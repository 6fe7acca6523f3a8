"""Named operators by kind, and user-made sources, sinks and samplers."""

from collections.abc import Callable

_registry: dict[str, dict[str, Callable]] = {}


def register(kind: str, name: str, init: Callable) -> None:
    """Add a plugin; ``init`` runs at once and makes the object used later. A kind has each name once."""
    named = _registry.setdefault(kind, {})
    if name in named:
        raise ValueError(f"duplicate plugin {kind}/{name}")
    named[name] = init()


def by_kind(kind: str) -> dict[str, object]:
    return dict(_registry.get(kind, {}))


def register_functions(spark) -> None:
    """Register every ``function`` plugin with the session under its name, for use in rules and SQL."""
    for name, function in by_kind("function").items():
        spark.udf.register(name, function)


def register_data_sources(spark) -> None:
    """Register every ``source`` plugin, each a Python ``DataSource`` class."""
    for source in by_kind("source").values():
        spark.dataSource.register(source)
