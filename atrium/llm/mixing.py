"""Operator 2: mixing sources to target weights by Pfair scheduling."""

from __future__ import annotations

import heapq
import math
from collections import OrderedDict
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .exact_dedup import ranked

BLOCK = 64
#: Slots that are scheduled at a time.
FRAME = 1024
#: Slots of an open period that are looked at together.
PIECE = 1 << 16
#: Frames that a worker keeps.
KEPT_FRAMES = 512
FINE_ROWS = 1000


def whole_weights(weights: dict) -> dict:
    """Integers in exactly the proportion of the weights; a float counts as the decimal it is written as."""
    if any(not 0 < w < math.inf for w in weights.values()):
        raise ValueError("weights must be positive and finite")
    exact = {s: Fraction(str(w)) for s, w in weights.items()}
    common = math.lcm(*(x.denominator for x in exact.values()))
    whole = {s: int(x * common) for s, x in exact.items()}
    shared = math.gcd(*whole.values())
    return {s: x // shared for s, x in whole.items()}


@dataclass(frozen=True)
class Phase:
    """A stretch of slots with the same sources: their weights out of ``total``, and their first block's number.

    Block k of weight p/total is released at floor(k*total/p) and due at
    ceil((k+1)*total/p), counted from the phase's first slot.
    """

    start: int
    length: int
    total: int
    sources: tuple[int, ...]
    weights: tuple[int, ...]
    first: tuple[int, ...]

    def release(self, i: int, k: int) -> int:
        return k * self.total // self.weights[i]

    def due(self, i: int, k: int) -> int:
        return -(-(k + 1) * self.total // self.weights[i])

    def done(self, t: int) -> list[int]:
        """Blocks of each source that the schedule has placed before slot t.

        All blocks due by t are placed. Of those open at t (released before, due
        after) the schedule has placed as many as slots are left, the earliest due
        first, as far as they fit: for every x, blocks released at or after x fit
        into the slots from x to t. So any slot's state is known without the
        slots before it.
        """
        placed = [t * p // self.total for p in self.weights]
        is_open = [i for i, p in enumerate(self.weights) if t * p % self.total]
        left = t - sum(placed)
        if not left:
            return placed
        releases = sorted({self.release(i, placed[i]) for i in is_open})
        room = [min(self.least_room(placed, t, at, min(z + 1, at + PIECE)) for at in range(y + 1, z + 1, PIECE)) for y, z in zip([releases[0] - 1, *releases], releases)]
        for _, i in sorted((self.due(i, placed[i]), i) for i in is_open):
            upto = [j for j, x in enumerate(releases) if x <= self.release(i, placed[i])]
            if left and all(room[j] > 0 for j in upto):
                for j in upto:
                    room[j] -= 1
                placed[i] += 1
                left -= 1
        return placed

    def least_room(self, placed: list[int], t: int, start: int, end: int) -> int:
        """The least room of an x from start up to end, after the blocks that are due by t; Python's integers where products may not fit."""
        x = np.arange(start, end, dtype=np.int64 if t * self.total < 1 << 62 else object)
        room = t - x
        for n, p in zip(placed, self.weights, strict=True):
            room = room - np.maximum(0, n + (-x * p) // self.total)
        return int(room.min())

    def frame(self, number: int, size: int = FRAME) -> dict[tuple[int, int], int]:
        """{(source of this phase, block): slot} of one frame: each slot goes to the released block that is due first."""
        t = number * size
        at = self.done(t)
        waiting = [(self.release(i, k), i) for i, k in enumerate(at)]
        heapq.heapify(waiting)
        ready: list[tuple[int, int]] = []
        out = {}
        for slot in range(t, min(self.length, t + size)):
            while waiting and waiting[0][0] <= slot:
                i = heapq.heappop(waiting)[1]
                heapq.heappush(ready, (self.due(i, at[i]), i))
            i = heapq.heappop(ready)[1]
            out[i, at[i]] = slot
            at[i] += 1
            heapq.heappush(waiting, (self.release(i, at[i]), i))
        return out


def phases(weights: list[int], blocks: list[int]) -> list[Phase]:
    """The schedule of sources with these numbers of blocks: when one runs out, the others go on in their proportion."""
    out, start, first = [], 0, [0] * len(blocks)
    while live := [i for i, n in enumerate(blocks) if first[i] < n]:
        w = [weights[i] for i in live]
        total = sum(w)
        length = min(-(-(blocks[i] - first[i]) * total // weights[i]) for i in live)
        now = Phase(start, length, total, tuple(live), tuple(w), tuple(first[i] for i in live))
        out.append(now)
        for i, n in zip(live, now.done(length), strict=True):
            first[i] += n
        start += length
    return out


class Slots:
    """Looks up blocks' slots; frames that were needed last are kept."""

    def __init__(self, plan: list[Phase]):
        self.plan = plan
        self.frames: OrderedDict[tuple[int, int], dict] = OrderedDict()

    def frame(self, phase: int, number: int) -> dict:
        if (phase, number) not in self.frames:
            self.frames[phase, number] = self.plan[phase].frame(number)
            if len(self.frames) > KEPT_FRAMES:
                self.frames.popitem(last=False)
        self.frames.move_to_end((phase, number))
        return self.frames[phase, number]

    def of(self, source: int, block: int) -> int:
        for n, p in enumerate(self.plan):
            if source not in p.sources:
                break
            i = p.sources.index(source)
            k = block - p.first[i]
            for number in range(p.release(i, k) // FRAME, (min(p.due(i, k), p.length) - 1) // FRAME + 1):
                slot = self.frame(n, number).get((i, k))
                if slot is not None:
                    return p.start + slot
        raise ValueError(f"block {block} of source {source} has no slot")


def source_weights(sizes: dict, power: float = 0.5) -> dict:
    """Target weights from the sources' sizes, tempered by ``power`` (1: as they come, 0: all equal), as whole numbers."""
    return {s: max(1, round(n**power)) for s, n in sizes.items()}


def mix(docs: DataFrame, weights: dict | None = None, source_col: str = "source", id_col: str = "doc_id", block: int = BLOCK) -> DataFrame:
    """Interleaves the sources' documents: adds block_no, slot and mix_position to all columns of docs.

    A source's rows, ordered by a hash of the id (then id), are cut into blocks
    of ``block`` rows. With the weight w as the source's exact share, block k gets
    the release time floor(k/w) and the deadline ceil((k+1)/w), and each slot goes
    to the released block that is due first. So after any number of slots every
    source is less than one block from its share. When a source runs out, the
    others go on in their proportion, counted from there. Schedules are computed
    frame by frame where rows need them: the state at a frame's start follows from
    the weights alone. ``mix_position`` orders the stream; it is unique, with gaps
    where a block is not full; at the end of each source one slot may stay empty.

    All rows are kept. A null source is a source of its own. Rows with equal
    ids, null ids too, are ordered among themselves by all columns' hash. Without
    weights, source sizes to the power 0.5 are taken. Sources without a given
    weight are an error; weights of sources that do not occur are left out. The
    sources' names and sizes are gathered in the driver. Columns of docs named
    block_no, slot or mix_position are replaced. An empty table gives an empty
    result.
    """
    docs = docs.drop("block_no", "slot", "mix_position")
    sizes = {r[0]: r[1] for r in docs.groupBy(source_col).count().collect()}
    weights = source_weights(sizes) if weights is None else weights
    if missing := [s for s in sizes if s not in weights]:
        raise ValueError(f"no weight for {missing[:5]}")
    names = sorted(sizes, key=lambda s: (s is not None, s))
    whole = whole_weights({s: weights[s] for s in names}) if names else {}
    plan = phases([whole[s] for s in names], [-(-sizes[s] // block) for s in names])
    fine = max(1, sum(sizes.values()) // FINE_ROWS)
    order = docs.withColumn("__order", F.xxhash64(F.lit(2), F.col(id_col))).withColumn("__tie", F.xxhash64(*[F.col(c) for c in docs.columns]))
    numbered = ranked(order, source_col, ["__order", id_col, "__tie"], fine, name="__rank").withColumn("block_no", F.floor(F.col("__rank") / block))
    slots = Slots(plan)
    index = {s: i for i, s in enumerate(names)}

    @F.arrow_udf("long")
    def slot(source: pa.Array, number: pa.Array) -> pa.Array:
        at: dict = {}
        blocks = list(zip(source.to_pylist(), number.to_pylist(), strict=True))
        for s, k in sorted(set(blocks), key=lambda b: b[1]):
            at[s, k] = slots.of(index[s], k)
        return pa.array([at[b] for b in blocks], pa.int64())

    out = numbered.withColumn("slot", slot(F.col(source_col), F.col("block_no")))
    return out.withColumn("mix_position", F.col("slot") * block + F.col("__rank") % block).select(*docs.columns, "block_no", "slot", "mix_position")
