"""Declared events in a bounded stream, and their counts."""

from __future__ import annotations

from collections import Counter, deque

from .errors import Refused

# The closed vocabulary of events.
KINDS = frozenset(
    """routing.redirect durability.write-refused subscribe.purge-incomplete erasure.stripe-reconstructed
    lease.writer-fenced-out admit.queue-withdrawn admit.queue-rejoined admit.fleet-withdrawn
    durability.leaf-below-floor hlc.clock-skew-refused""".split()
)


class Stream:
    """Keeps the first size events until they are taken; the others are dropped and counted."""

    def __init__(self, size: int):
        self.size, self.events, self.dropped, self.counts = size, deque(), 0, Counter()

    def emit(self, kind: str, detail: object = None) -> None:
        if kind not in KINDS:
            raise Refused(f"{kind} is not a declared event")
        self.counts[kind] += 1
        if len(self.events) >= self.size:
            self.dropped += 1
        else:
            self.events.append((kind, detail))

    def take(self) -> list[tuple[str, object]]:
        out = list(self.events)
        self.events.clear()
        return out
