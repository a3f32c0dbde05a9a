"""State of the conversion alert: blocks of consecutive scans for each store."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import date, timedelta
from typing import NamedTuple

from pyspark.sql import Row
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

EPOCH = date(1970, 1, 1)
DAY_MS = 86_400_000


class Block(NamedTuple):
    """Consecutive scans of a store: number, day and flag of the first and the last one."""

    first: int
    first_day: int
    first_verified: bool
    last: int
    last_day: int
    last_verified: bool


BLOCK = "first long, first_day int, first_verified boolean, last long, last_day int, last_verified boolean"


def joined(one: Block, two: Block) -> Block:
    return Block(*one[:3], *two[3:])


class Conversions(StatefulProcessor):
    """Pairs each scan with its neighbours by number, whichever comes first.

    The newest block is a value. Blocks before a gap are kept in a map, by their last scan, so that a scan that comes late
    finds its neighbours; a timer releases them once the watermark has passed the first day of a later block, when
    whatever belongs before that block would be dropped as too late.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.newest = handle.getValueState("newest", BLOCK)
        self.earlier = handle.getMapState("earlier", "last long", BLOCK)

    def _blocks(self) -> dict[int, Block]:
        return {k[0]: Block(*v) for k, v in self.earlier.iterator()}

    def _open(self, block: Block) -> None:
        self.handle.registerTimer((block.first_day + 1) * DAY_MS)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        def alert(one: Block, two: Block) -> list[Row]:
            if one.last_verified or not two.first_verified:
                return []
            days = (EPOCH + timedelta(one.last_day), EPOCH + timedelta(two.first_day))
            return [Row(domain=key[0], prior_scan_date=days[0], scan_date=days[1])]

        newest = Block(*self.newest.get()) if self.newest.exists() else None
        recorded, earlier = newest, None
        for r in sorted(rows, key=lambda r: (r.scan_seq, r.scan_date)):
            half = (r.scan_seq, (r.scan_date - EPOCH).days, bool(r.verified))
            scan = Block(*half, *half)
            if newest is None or scan.first > newest.last + 1:
                if newest is not None:
                    self.earlier.updateValue((newest.last,), tuple(newest))
                    if earlier is not None:
                        earlier[newest.last] = newest
                newest = scan
                self._open(scan)
            elif scan.first == newest.last + 1:
                yield from alert(newest, scan)
                newest = joined(newest, scan)
            elif scan.first < newest.first:
                earlier = self._blocks() if earlier is None else earlier
                if any(b.first <= scan.first <= b.last for b in earlier.values()):
                    continue
                left = earlier.pop(scan.first - 1, None)
                right = next((b for b in [newest, *earlier.values()] if b.first == scan.last + 1), None)
                if left is not None:
                    self.earlier.removeKey((left.last,))
                    yield from alert(left, scan)
                if right is not None:
                    yield from alert(scan, right)
                if left is None and right is None:
                    self._open(scan)
                whole = joined(left or scan, right or scan)
                if right is newest:
                    newest = whole
                else:
                    self.earlier.updateValue((whole.last,), tuple(whole))
                    earlier[whole.last] = whole
        if newest is not None and newest != recorded:
            self.newest.update(tuple(newest))

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        passed = timerValues.getCurrentWatermarkInMs()
        blocks = self._blocks()
        closed = [b.first for b in [*blocks.values(), Block(*self.newest.get())] if (b.first_day + 1) * DAY_MS <= passed]
        for last in blocks:
            if last < max(closed, default=0):
                self.earlier.removeKey((last,))
        return iter(())

    def close(self) -> None:
        pass
