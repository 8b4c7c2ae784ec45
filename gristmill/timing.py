"""Wall-clock times of named stages, kept per thread."""

from __future__ import annotations

import threading
import time
from collections.abc import Iterator
from contextlib import contextmanager

_state = threading.local()


@contextmanager
def stage(name: str) -> Iterator[None]:
    began = time.perf_counter()
    try:
        yield
    finally:
        spent = _state.__dict__.setdefault("spent", {})
        spent[name] = spent.get(name, 0.0) + time.perf_counter() - began


def snapshot(clear: bool = False) -> dict[str, float]:
    """Seconds by stage so far, longest first."""
    spent = dict(sorted(_state.__dict__.get("spent", {}).items(), key=lambda x: -x[1]))
    if clear:
        _state.__dict__.pop("spent", None)
    return spent
