"""Small helpers on the driver."""

from __future__ import annotations

import signal
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

import numpy as np


def swap_chars(text: str, i: int, j: int) -> str:
    """``text`` with the characters at i and j exchanged."""
    out = list(text)
    out[i], out[j] = out[j], out[i]
    return "".join(out)


def descending(values: Sequence[float]) -> np.ndarray:
    return -np.sort(-np.asarray(values))


def descending_order(values: Sequence[float]) -> np.ndarray:
    """Indices that sort values from the largest down; ties keep their order."""
    return np.argsort(-np.asarray(values), kind="stable")


def _same(a: object, b: object) -> bool:
    return bool(np.array_equal(a, b)) if isinstance(a, np.ndarray) or isinstance(b, np.ndarray) else a == b


def equal_settings(a: dict, b: dict) -> bool:
    return a.keys() == b.keys() and all(_same(a[k], b[k]) for k in a)


def conflicting(a: dict, b: dict) -> dict:
    """Keys of both with different values: key -> (value in a, value in b)."""
    return {k: (a[k], b[k]) for k in sorted(a.keys() & b.keys(), key=str) if not _same(a[k], b[k])}


@contextmanager
def time_limit(seconds: int) -> Iterator[None]:
    """Raises TimeoutError in the main thread when the block takes longer."""

    def stop(*_: object) -> None:
        raise TimeoutError(f"took more than {seconds} s")

    before = signal.signal(signal.SIGALRM, stop)
    signal.alarm(seconds)
    try:
        yield
    finally:
        signal.alarm(0)
        signal.signal(signal.SIGALRM, before)
