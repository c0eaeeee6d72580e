"""Per-row steps of the order-dependent operators, shared by batch and stream.

A step takes (state, row values) and returns (new state, output values). States
are JSON-serialisable, so they can be handed between chunks and micro-batches.
"""

from __future__ import annotations

from collections.abc import Iterable


def state_transitions(allowed: Iterable[tuple[str, str]], initial: str):
    """Accept a change only when (current, new) is allowed; row: (new state,)."""
    pairs = frozenset(allowed)

    def step(state, row):
        current, new = state[0], row[0]
        ok = (current, new) in pairs
        return [new if ok else current], (ok, current, new if ok else current)

    return step, [initial]
