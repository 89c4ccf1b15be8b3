"""A hybrid logical clock and the transaction ids it mints; one writer's state, on the driver."""

from __future__ import annotations

import threading
from collections.abc import Callable

from .errors import SkewTooLarge
from .model import TxId


class Clock:
    def __init__(self, physical: Callable[[], int]):
        self.physical, self.wall, self.logical = physical, 0, 0

    def _read(self) -> None:
        now = self.physical()
        if now > self.wall:
            self.wall, self.logical = now, 0
        else:
            self.logical += 1

    def now(self) -> tuple[int, int]:
        self._read()
        return self.wall, self.logical

    def merge(self, wall: int, logical: int) -> tuple[int, int]:
        """Goes past another clock's reading."""
        now = self.physical()
        most = max(now, self.wall, wall)
        if most == self.wall == wall:
            self.logical = max(self.logical, logical) + 1
        elif most == self.wall:
            self.logical += 1
        elif most == wall:
            self.logical = logical + 1
        else:
            self.logical = 0
        self.wall = most
        return self.wall, self.logical

    def admit(self, wall: int, logical: int, skew: int) -> tuple[int, int]:
        """Like merge, but a reading too far ahead is refused before it is absorbed."""
        if wall - self.physical() > skew:
            raise SkewTooLarge(f"the reading is {wall - self.physical()} ahead; {skew} is allowed")
        return self.merge(wall, logical)


class Minter:
    """Transaction ids of one leaf, each greater than all before and all observed."""

    def __init__(self, clock: Clock, leaf_prefix: bytes = b"", leaf_depth: int = 0):
        self.clock, self.leaf_prefix, self.leaf_depth, self.seq = clock, leaf_prefix, leaf_depth, 0
        self._lock = threading.Lock()

    def mint(self) -> TxId:
        with self._lock:
            wall, logical = self.clock.now()
            self.seq += 1
            return TxId(wall, logical, self.leaf_prefix, self.leaf_depth, self.seq)

    def observe(self, seen: TxId) -> None:
        """Makes later ids greater than one that was read from a store."""
        with self._lock:
            self.clock.merge(seen.wall, seen.logical)
            self.seq = max(self.seq, seen.seq)
