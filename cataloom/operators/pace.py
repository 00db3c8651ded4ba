"""A limit on calls a minute, kept by all tasks of a job together without any of them asking another."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Protocol


class Client(Protocol):
    def complete(self, prompt: str) -> str: ...


def quotas(per_minute: int, partitions: int) -> list[int]:
    """Calls a minute of each partition; their sum is per_minute. There are no more partitions than calls."""
    n = max(1, min(partitions, per_minute))
    return [per_minute // n + (i < per_minute % n) for i in range(n)]


@dataclass
class Bucket:
    """A token bucket of one token: calls are 60 / quota seconds apart at least, so any minute has quota of them at most.

    The first call waits for its share of an interval, so that buckets of one job don't all begin at once.
    """

    quota: int
    place: float = 0.0
    clock: Callable[[], float] = time.monotonic
    sleep: Callable[[float], None] = time.sleep
    free: float | None = field(default=None, init=False)

    def take(self) -> None:
        now = self.clock()
        if self.free is None:
            self.free = now + self.place * 60 / self.quota
        if self.free > now:
            self.sleep(self.free - now)
        self.free = max(self.free, self.clock()) + 60 / self.quota


@dataclass
class Paced:
    """A client whose calls take a token first, repeated ones too."""

    client: Client
    bucket: Bucket

    def complete(self, prompt: str) -> str:
        self.bucket.take()
        return self.client.complete(prompt)
