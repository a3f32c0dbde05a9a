"""A memo bounded in bytes that keeps what is asked for often."""

from __future__ import annotations

from collections.abc import Callable, Hashable
from typing import Any

#: What an entry takes beside its key and a value of about the key's length.
ENTRY = 180


class Memo:
    """Values of `make`, remembered in two generations of at most `limit` bytes each; keys longer than `longest` never are.

    When the young generation is full it becomes the old one, whose values come back as they are asked for.
    """

    def __init__(self, make: Callable[[Hashable], Any], limit: int = 12 << 20, longest: int = 64):
        self.make, self.limit, self.longest = make, limit, longest
        self.young: dict = {}
        self.old: dict = {}
        self.size = 0

    def _turn(self) -> None:
        if self.size >= self.limit:
            self.old, self.young, self.size = self.young, {}, 0

    def one(self, key):
        value = self.young.get(key)
        if value is None:
            value = self.old.get(key)
            if value is None:
                value = self.make(key)
            if len(key) <= self.longest:
                self.young[key] = value
                self.size += 2 * len(key) + ENTRY
                self._turn()
        return value

    def many(self, keys: list) -> list:
        """The values of all keys, in order; the young generation may grow by the keys of one call."""
        young, old, make, size = self.young, self.old, self.make, 0
        out = list(map(young.get, keys))
        if None in out:
            longest, last = self.longest, old.get
            for i in [i for i, value in enumerate(out) if value is None]:
                k = keys[i]
                value = young.get(k)  # it may have come further up in the same call
                if value is None:
                    value = last(k)
                    if value is None:
                        value = make(k)
                    n = len(k)
                    if n <= longest:
                        young[k] = value
                        size += 2 * n + ENTRY
                out[i] = value
            self.size += size
            self._turn()
        return out
