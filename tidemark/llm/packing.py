"""Best-fit packing of token sequences, improved by a swap-based local search.

Texts are tokenised where they lie; only pieces (id, number, length, checksum) move. The pieces
are dealt in turn to groups of bounded size, and each group is packed on its own: best fit by
falling length, then local search among the bins that are not full, until no exchange helps.
Mixed lengths leave about one partly filled sequence a group; where lengths of about a third of a
sequence prevail, a few percent of the room stay empty.
"""

from __future__ import annotations

import bisect
import collections
import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import tokens
from tidemark.llm.common import staged

SEQUENCE = 2048
END = 0
GROUP_PIECES = 40_000

PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, lane int, at bigint"
PLACED = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint"


def _pieces(batches: Iterator[pa.RecordBatch], size: int, path: str | None) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    lane, at = TaskContext.get().partitionId(), 0
    for batch in batches:
        owner, number, start, length, crc = [], [], [], [], []
        for row, text in enumerate(batch.column("text")):
            ids = np.append(tokens.encode_array(text.as_py(), path, special=True), np.uint32(END)).astype("<u4")
            head = len(ids) % size or size
            cuts = [0, *range(head, len(ids), size), len(ids)]
            for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                owner.append(row)
                number.append(k)
                start.append(a)
                length.append(b - a)
                crc.append(zlib.crc32(ids[a:b].tobytes()))
        n = len(owner)
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id").take(pa.array(owner, pa.int64())), pa.array(number, pa.int32()),
                pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64()),
                pa.array([lane] * n, pa.int32()), pa.array(range(at, at + n), pa.int64()),
            ],
            names=[c.split()[0] for c in PIECES.split(", ")],
        )
        at += n


def pieces(docs: DataFrame, size: int = SEQUENCE, vocabulary: str | None = None) -> DataFrame:
    """Pieces of each document: its ids and an end id, cut into ``size`` tokens, the rest first.

    Ids are those of the tokenizer file: an end-of-text marker in a text is one id. Texts of any
    length are encoded whole, runs of white space of any length too.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(lambda batches: _pieces(batches, size, vocabulary), PIECES)


def best_fit(lengths: list[int], size: int) -> list[list[int]]:
    """Bins of item numbers: each item, longest first, goes to the fullest bin that takes it."""
    bins: list[list[int]] = []
    by_room: list[list[int]] = [[] for _ in range(size + 1)]
    rooms: list[int] = []  # sorted rooms for which a bin is open
    for item in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        need = lengths[item]
        k = bisect.bisect_left(rooms, need)
        if k < len(rooms):
            room = rooms[k]
            slot = by_room[room].pop()
            if not by_room[room]:
                rooms.pop(k)
        else:
            room, slot = size, len(bins)
            bins.append([])
        bins[slot].append(item)
        left = room - need
        if left:
            if not by_room[left]:
                bisect.insort(rooms, left)
            by_room[left].append(slot)
    return bins


class _Loose:
    """Bins that are not full, indexed by what one item or two items of a bin add up to."""

    def __init__(self, bins: list[list[int]], lengths: list[int], size: int):
        self.bins, self.lengths, self.size = bins, lengths, size
        self.fill = [sum(lengths[i] for i in b) for b in bins]
        self.version = [0] * len(bins)
        # By sum: heaps of (fill, bin, version, items); entries of an earlier version are void.
        self.sums: list[list[tuple]] = [[] for _ in range(size + 1)]
        for k in range(len(bins)):
            self._enter(k)

    def _sums(self, k: int) -> Iterator[tuple[int, list[int]]]:
        """What one item or two items of a bin add up to; of equal lengths two items count."""
        by_length: dict[int, list[int]] = {}
        for i in self.bins[k]:
            by_length.setdefault(self.lengths[i], []).append(i)
        own = list(by_length.items())
        for n, (x, items) in enumerate(own):
            yield x, items[:1]
            if len(items) > 1:
                yield 2 * x, items[:2]
            for y, others in own[n + 1 :]:
                yield x + y, [items[0], others[0]]

    def _enter(self, k: int) -> None:
        if not 0 < self.fill[k] < self.size:
            return
        for total, items in self._sums(k):
            heapq.heappush(self.sums[total], (self.fill[k], k, self.version[k], items))

    def _emptiest(self, total: int, but: int) -> tuple | None:
        """Entry of the emptiest bin, other than ``but``, that can give ``total`` tokens."""
        heap, own = self.sums[total], []
        while heap and (heap[0][2] != self.version[heap[0][1]] or heap[0][1] == but):
            entry = heapq.heappop(heap)
            if entry[1] == but and entry[2] == self.version[but]:
                own.append(entry)
        found = heap[0] if heap else None
        for entry in own:
            heapq.heappush(heap, entry)
        return found

    def best(self, high: int) -> tuple[int, list[int], list[int]] | None:
        """Bin, its items and those of ``high`` of the exchange that fills ``high`` the most.

        An exchange moves m tokens more than it takes back. The sum of squared fills rises if the
        giver was less full than ``high`` is afterwards. Of equal ones the emptiest bin gives.
        """
        takes = list({0: [], **dict(self._sums(high))}.items())
        for m in range(self.size - self.fill[high], 0, -1):
            found = None
            for take, back in takes:
                if take + m > self.size or not self.sums[take + m]:
                    continue
                entry = self._emptiest(take + m, high)
                if entry and entry[0] < self.fill[high] + m and (found is None or entry[0] < found[0]):
                    found = entry[0], entry[1], entry[3], back
            if found:
                return found[1:]
        return None

    def exchange(self, high: int, low: int, give: list[int], take: list[int]) -> None:
        for k, gone, come in ((low, give, take), (high, take, give)):
            for i in gone:
                self.bins[k].remove(i)
            self.bins[k] += come
            self.fill[k] += sum(self.lengths[i] for i in come) - sum(self.lengths[i] for i in gone)
            self.version[k] += 1
            self._enter(k)


def improve(bins: list[list[int]], lengths: list[int], size: int) -> list[list[int]]:
    """Local search: bins that are not full get items of emptier ones until no exchange helps.

    Each exchange (one or two items for none, one or two) increases the sum of squared fills, so the
    search ends; bins that lose their last item go. A bin without an exchange is set aside, and all
    are tried again after a pass with exchanges. Full bins are left alone, and nothing is left to
    gain once the bins are as few as their tokens need.
    """
    least, changed = -(-sum(lengths) // size), True
    while changed and len(bins) > least:
        loose, changed = _Loose([list(b) for b in bins], lengths, size), False
        work = collections.deque(sorted(range(len(bins)), key=lambda k: -loose.fill[k]))
        waiting, left = set(work), len(bins)
        while work and left > least:
            high = work.popleft()
            waiting.discard(high)
            while 0 < loose.fill[high] < size and left > least and (found := loose.best(high)):
                low, give, take = found
                loose.exchange(high, low, give, take)
                changed = True
                if not loose.bins[low]:
                    left -= 1
                elif low not in waiting:
                    waiting.add(low)
                    work.append(low)
        bins = [b for b in loose.bins if b]
    return bins


def pack_lengths(lengths: list[int], size: int = SEQUENCE) -> list[list[int]]:
    return improve(best_fit(lengths, size), lengths, size)


def _pack(group: pa.Table, size: int) -> pa.Table:
    group = group.sort_by([("lane", "ascending"), ("at", "ascending")])
    lengths = group.column("length").to_pylist()
    sequence = np.zeros(len(lengths), dtype="int64")
    offset = np.zeros(len(lengths), dtype="int64")
    base = group.column("group_id")[0].as_py() << 32
    for k, items in enumerate(pack_lengths(lengths, size)):
        place = 0
        for i in items:
            sequence[i], offset[i] = base + k, place
            place += lengths[i]
    placed = group.append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset))
    return placed.select([c.split()[0] for c in PLACED.split(", ")])


def pack(docs: DataFrame, size: int = SEQUENCE, vocabulary: str | None = None) -> DataFrame:
    """Place of every piece: ``sequence_id`` and ``offset`` in it, without gaps.

    A null or empty text is a document of the end id alone; a null doc_id stays null; repeated
    rows are packed each on its own; other columns are not read. An empty table gives no row.
    """
    cut = staged(pieces(docs, size, vocabulary), "pieces")
    # Dealt in turn: place in the task, shifted by the task, spreads any order and any hot id.
    groups = max(1, -(-cut.count() // GROUP_PIECES))
    dealt = cut.withColumn("group_id", F.pmod(F.col("at") + F.hash("lane"), F.lit(groups)))
    return dealt.groupBy("group_id").applyInArrow(lambda group: _pack(group, size), PLACED)
