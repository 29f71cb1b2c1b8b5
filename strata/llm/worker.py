"""State that a Python worker keeps from task to task."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

_HELD: list[tuple[str, Any, Any]] = []


def held(owner: str, key: Any, make: Callable[[], Any]) -> Any:
    """The state that ``make`` made for ``owner`` and ``key`` in this worker.

    A worker serves one operator after another and outlives them, so it keeps
    the state of one owner only: another owner's, or another key's, is dropped.
    """
    if _HELD:
        who, what, state = _HELD[0]
        if who == owner and (what is key or (isinstance(key, str) and what == key)):
            return state
        _HELD.clear()
    state = make()
    _HELD.append((owner, key, state))
    return state
