"""Registered queries, grouped by topic."""

from importlib import import_module
from importlib.util import find_spec

_TOPICS = (
    "q_sources", "q_grid", "q_joins", "q_windows", "q_features", "q_quality",
    "q_supervised", "q_metrics", "q_conformal", "q_dispatch", "q_streaming",
)


def load_all() -> None:
    for topic in _TOPICS:
        name = f"{__name__}.{topic}"
        if find_spec(name):
            import_module(name)
