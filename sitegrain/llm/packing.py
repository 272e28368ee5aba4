"""Operator 3 — best-fit packing by bin completion.

Documents are tokenised and cut only where longer than a sequence. What the
packing needs of a corpus is how many pieces there are of each length: at
most ``capacity`` numbers, whatever the size of the corpus. ``plan`` packs
that histogram on the driver by bin completion: around the largest remaining
piece it enumerates undominated fillings, branches over them, prunes by bounds
on waste, and starts from a best-fit solution as the incumbent; one filling
is used for as many sequences at once as its lengths allow, so the plan's
size depends on the distinct lengths only. The pieces then take their places
by rank among pieces of their length: rank inside the task that cut them,
plus a prefix sum over tasks.

The search is limited to ``NODES`` choices, ``FILLINGS`` fillings at a branch
and ``STEPS`` steps of an enumeration; beyond them the best solution so far
stands. No piece is ever left out.

Defined results: a null text is an empty document (one piece, the end id);
repeated rows are packed each; pieces of equal length take their places in the
order in which tasks cut them; a text of any length is cut into pieces of the
capacity and a last one; an empty table gives an empty result. Only id and
text are read, so further columns of any name don't matter.
"""

from __future__ import annotations

import bisect
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, table, text_batches
from .word_bpe import encoder, tokenizer_path

CAPACITY = 2048
END = 0
NODES = 400  # choices that one search may open after its incumbent; levels with one choice are free
FILLINGS = 4  # fillings tried at a branch
STEPS = 3000  # steps of one depth-first enumeration of fillings


# --- planning ---------------------------------------------------------------


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """The larger of the size bound and Martello and Toth's L2 over the histogram."""
    sizes = np.array(sorted(counts), np.int64)
    n = np.array([counts[s] for s in sizes.tolist()], dtype=object)
    total = int((sizes.astype(object) * n).sum()) if len(sizes) else 0
    best = -(-total // capacity)
    for a in [0, *(int(s) for s in sizes if 2 * s <= capacity)]:
        big = [(s, c) for s, c in counts.items() if s > capacity - a]
        mid = [(s, c) for s, c in counts.items() if capacity - a >= s and 2 * s > capacity]
        small = sum(s * c for s, c in counts.items() if a <= s and 2 * s <= capacity)
        free = sum(c * (capacity - s) for s, c in mid)
        bound = sum(c for _, c in big) + sum(c for _, c in mid) + max(0, -(-(small - free) // capacity))
        best = max(best, bound)
    return best


class _Left:
    """Counts by length with the largest length not above a bound in one step."""

    def __init__(self, counts: dict[int, int], capacity: int) -> None:
        self.n = np.zeros(capacity + 1, np.int64)
        for s, c in counts.items():
            self.n[s] = c
        self._own = np.arange(capacity + 1)
        self._refit()

    def _refit(self) -> None:
        self.floor = np.maximum.accumulate(np.where(self.n > 0, self._own, 0))

    def take(self, filling: dict[int, int], times: int) -> None:
        """Removes (or, with negative times, gives back) a filling."""
        change = False
        for s, c in filling.items():
            was = self.n[s]
            self.n[s] = was - c * times
            change |= (was > 0) != (self.n[s] > 0)
        if change:
            self._refit()

    def times(self, filling: dict[int, int]) -> int:
        return min(int(self.n[s]) // c for s, c in filling.items())

    def pairs(self, room: int) -> tuple[np.ndarray, np.ndarray]:
        """Every length that fits, and the largest second one beside it (0 if none)."""
        a = np.flatnonzero(self.n[1 : room + 1]) + 1
        second = self.floor[np.minimum(a, room - a)]
        twice = (second == a) & (self.n[a] < 2)
        second[twice] = self.floor[a[twice] - 1]
        return a, second


def _topped_up(left: _Left, items: list[int], room: int) -> list[int]:
    """Best fit: always the largest piece that still fits."""
    used = Counter(items)
    top = room
    while top > 0 and (s := int(left.floor[min(top, room)])):
        if left.n[s] > used[s]:
            items = [*items, s]
            used[s] += 1
            room -= s
            top = room
        else:
            top = s - 1
    return items


def _dominates(g: tuple[int, ...], f: tuple[int, ...]) -> bool:
    """Whether the pieces of f can stand in the places of g's: then g in its stead never needs more sequences.

    Best fit looks for the places; where it finds none, f is kept, which is safe.
    """
    room = sorted(g)
    for x in f:
        at = bisect.bisect_left(room, x)
        if at == len(room):
            return False
        bisect.insort(room, room.pop(at) - x)
    return True


def fillings(left: _Left, largest: int, capacity: int, limit: int = FILLINGS) -> list[dict[int, int]]:
    """Undominated ways to fill the sequence that holds ``largest``, least waste first."""
    room = capacity - largest
    left.take({largest: 1}, 1)
    try:
        if room and left.n[room]:
            return [dict(Counter([largest, room]))]  # an exact fit by one piece dominates every other filling
        found: dict[tuple[int, ...], None] = {}

        def add(rest: list[int]) -> None:
            found[tuple(sorted(_topped_up(left, rest, room - sum(rest)), reverse=True))] = None

        add([])
        a, b = left.pairs(room)
        if len(a):
            for i in np.lexsort((-a, -(a + b)))[: 2 * limit].tolist():  # pairs, the second as large as fits
                add([x for x in (int(a[i]), int(b[i])) if x])
            if (a + b).max() < room:  # triples around the largest pieces
                for first in a[::-1][: 8 * limit].tolist():
                    left.take({first: 1}, 1)
                    x, y = left.pairs(room - first)
                    if len(x):
                        i = int((x + y).argmax())
                        third = [first, *(int(v) for v in (x[i], y[i]) if v)]
                    left.take({first: 1}, -1)
                    if len(x):
                        add(third)
        if limit > 1:  # larger sets, depth first from the largest pieces
            stack, steps = [([], room, room)], 0
            while stack and steps < STEPS:
                items, free, top = stack.pop()
                steps += 1
                s = int(left.floor[min(top, free)])
                if not s:
                    add(items)
                    continue
                if s > 1:
                    stack.append((items, free, s - 1))
                if left.n[s] > items.count(s):
                    stack.append(([*items, s], free - s, s))
    finally:
        left.take({largest: 1}, -1)
    out: list[tuple[int, ...]] = []
    for f in sorted(found, key=lambda f: (-sum(f), tuple(-x for x in f))):
        if not any(_dominates(g, f) for g in out):
            out.append(f)
        if len(out) == limit:
            break
    return [dict(Counter([largest, *f])) for f in out]


Plan = list[tuple[int, dict[int, int]]]


def _sequences(plan_: Plan) -> int:
    return sum(m for m, _ in plan_)


def _best_fit(left: _Left, capacity: int) -> Plan:
    """Greedy from here on: the first filling of the largest piece left, as often as it can be used."""
    out: Plan = []
    while largest := int(left.floor[capacity]):
        f = fillings(left, largest, capacity, 1)[0]
        out.append((m := left.times(f), f))
        left.take(f, m)
    for m, f in out:
        left.take(f, -m)
    return out


def branch_and_bound(counts: dict[int, int], capacity: int, incumbent: Plan, nodes: int = NODES) -> Plan:
    """Bin completion: depth first over the fillings of the largest piece left, pruned by waste.

    Partial paths are completed by best fit, from upper branches and at every
    16th choice, so that solutions are found however deep the leaves are.
    """
    best, fewest, bound = incumbent, _sequences(incumbent), lower_bound(counts, capacity)
    total = sum(s * c for s, c in counts.items())
    left = _Left(counts, capacity)
    path: list[tuple[int, dict[int, int], int]] = []  # times, filling, waste

    def options() -> list[tuple[int, dict[int, int]]]:
        found = fillings(left, int(left.floor[capacity]), capacity)
        out = []
        for f in found:
            most = left.times(f)
            out += [(m, f) for m in dict.fromkeys((most, (most + 1) // 2, 1))] if len(found) > 1 else [(most, f)]
        return out[::-1]

    stack, opened, wasted = ([options()] if counts else []), 0, 0
    choices = [len(stack[0])] if stack else []  # options of each level on the stack at first
    while stack and opened < nodes and fewest > bound:
        if not stack[-1]:
            stack.pop()
            choices.pop()
            if path:
                m, f, waste = path.pop()
                wasted -= waste
                left.take(f, -m)
            continue
        m, f = stack[-1].pop()
        waste = m * (capacity - sum(s * c for s, c in f.items()))
        if wasted + waste > (fewest - 1) * capacity - total:  # no better solution wastes so much
            continue
        choice = choices[-1] > 1
        opened += choice
        left.take(f, m)
        path.append((m, f, waste))
        wasted += waste
        if left.floor[capacity]:
            if choice and (len(stack) <= 8 or opened % 16 == 0):
                rest = _best_fit(left, capacity)
                if (n := sum(m for m, *_ in path) + _sequences(rest)) < fewest:
                    fewest, best = n, [*((m, f) for m, f, _ in path), *rest]
            stack.append(options())
            choices.append(len(stack[-1]))
            continue
        if (n := sum(m for m, *_ in path)) < fewest:
            fewest, best = n, [(m, f) for m, f, _ in path]
        path.pop()
        wasted -= waste
        left.take(f, -m)
    return best


def plan(counts: dict[int, int], capacity: int = CAPACITY, nodes: int = NODES) -> Plan:
    """``[(sequences, {length: pieces})]`` for a histogram of lengths, in as few sequences as found.

    The best-fit incumbent's fullest sequences are fixed and the others packed
    anew by branch and bound, for growing shares, up to all of them.
    """
    counts = {s: c for s, c in counts.items() if c}
    if any(not 0 < s <= capacity for s in counts):
        raise ValueError("lengths must be between 1 and the capacity")
    best = _best_fit(_Left(counts, capacity), capacity)
    bound = lower_bound(counts, capacity)
    share = 8
    while _sequences(best) > bound:
        best.sort(key=lambda e: capacity - sum(s * c for s, c in e[1].items()))
        tail: Counter = Counter()
        for m, f in best[-share:]:
            tail.update({s: m * c for s, c in f.items()})
        again = branch_and_bound(dict(tail), capacity, best[-share:], nodes)
        best = [*best[:-share], *again]
        if share >= len(best):
            break
        share *= 2
    return best


# --- pieces and places --------------------------------------------------------


def _pieces(path: str, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, task, ranks = encoder(path), TaskContext.get().partitionId(), Counter()
        for b in batches:
            ids, cols = b.column(0), [[] for _ in range(6)]
            for row, raw in enumerate(enc.encode(b.column(1).to_pylist())):
                tokens = np.append(np.frombuffer(raw, "<u2"), np.uint16(END)).astype("<u4")
                for piece, at in enumerate(range(0, len(tokens), capacity)):
                    part = tokens[at : at + capacity]
                    n = len(part)
                    for c, v in zip(cols, (row, piece, at, n, zlib.crc32(part.tobytes()), ranks[n])):
                        c.append(v)
                    ranks[n] += 1
            rows, *rest = cols
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [ids.take(pa.array(rows, pa.int32())), *(pa.array(v, t) for v, t in zip(rest, kinds)), pa.array([task] * len(rows), pa.int32())],
                ["id", "piece", "start", "length", "ids_crc32", "task_rank", "task"],
            )

    return run


def cut_pieces(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a piece of at most ``capacity`` tokens, written once: id, piece, start, length, ids_crc32, task, task_rank."""
    text_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, task_rank bigint, task int"
    return materialise(
        docs.select(F.col(id_col), F.col(text_col)).mapInArrow(_pieces(tokenizer or tokenizer_path(), capacity), schema), "pieces"
    )


def _places(plan_: Plan):
    """Rows (length, first rank, times, pieces a sequence, first sequence, offset), bounded by the plan."""
    used: Counter = Counter()
    first, out = 0, {}
    for times, f in plan_:
        offset = 0
        for s in sorted(f, reverse=True):
            out.setdefault(s, []).append((used[s], f[s], first, offset))
            used[s] += times * f[s]
            offset += s * f[s]
        first += times
    return {s: tuple(np.array(c, np.int64) for c in zip(*rows)) for s, rows in out.items()}


def pack(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str | None = None) -> DataFrame:
    """Pieces of all documents with their sequence and place in it."""
    pieces = cut_pieces(docs, capacity, tokenizer)
    counts = pieces.groupBy("length", "task").agg(F.count("*").alias("n"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    places = _places(plan(histogram, capacity))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("length", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    ranked = pieces.join(bases, ["length", "task"]).select(
        "id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("task_rank")).alias("rank")
    )

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = (b.column(i).to_numpy() for i in (3, 5))
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for s in np.unique(length).tolist():
                at = np.flatnonzero(length == s)
                first_rank, each, first, off = places[s]
                k = np.searchsorted(first_rank, rank[at], side="right") - 1
                nth = rank[at] - first_rank[k]
                sequence[at] = first[k] + nth // each[k]
                offset[at] = off[k] + nth % each[k] * s
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:5], pa.array(sequence), pa.array(offset)],
                ["id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    kind = pieces.schema["id"].dataType.simpleString()
    return ranked.mapInArrow(
        place, f"id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint"
    )


def op3_packing(spark, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 2048 tokens."""
    return pack(table(spark, sf_dir, "documents").select("doc_id", "text")).withColumnRenamed("id", "doc_id")
