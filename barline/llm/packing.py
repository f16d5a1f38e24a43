"""Packing of tokenised documents into windows by non-negative least squares.

Full windows of a document are sequences of their own; what is left of it is a piece of less than a window. Lengths of these pieces, in
steps of a few tokens, are a histogram; combinations of few lengths that fill a window are enumerated, and least squares without negative
counts say how often to repeat each. Rounded counts take pieces by their ranks within a length. Pieces that are left over go to
combinations greedily while any fits; the rest are laid end to end and cut at the windows' bounds, so that nothing of it is padded.

The histogram and the plan are bounded by the window alone. All else is ranks and running sums in two levels, by blocks of rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barline.llm._spark import written
from barline.llm._text import slices, text_bytes
from barline.llm.tokens import packed, unpacked
from barline.llm.word_tokens import codec

#: Rows of a block are those of one written partition that share row >> BLOCK_BITS.
BLOCK_BITS = 16
#: Bytes of ids that a task hands on at once.
SENT = 4 << 20


class Params(NamedTuple):
    """window: tokens of a sequence, a power of two. depth: most pieces in a combination; short pieces that would need more go end to end, where
    few of them are cut. step: lengths are rounded up to multiples of it, so that a planned sequence is padded by depth * (step - 1) tokens at
    most and by half of that on average."""

    window: int = 2048
    step: int = 8
    depth: int = 3


def combinations(units: int, depth: int = 3) -> list[Counter]:
    """All multisets of up to `depth` lengths that add up to units."""
    found = set()

    def grow(left: int, most: int, held: tuple[int, ...]) -> None:
        if left == 0:
            found.add(held)
        elif len(held) < depth:
            for k in range(min(most, left), 0, -1):
                grow(left - k, k, (*held, k))

    grow(units, units, ())
    return [Counter(x) for x in sorted(found, key=lambda x: (len(x), [-k for k in x]))]


def nonnegative(a: np.ndarray, b: np.ndarray, most: int | None = None) -> np.ndarray:
    """The x >= 0 with the least |a x - b|, by an active set: columns enter by gradient, and leave where the least squares of those at hand
    would turn negative."""
    n = a.shape[1]
    x, free, scale = np.zeros(n), np.zeros(n, bool), max(float(np.abs(b).max(initial=0)), 1.0)
    target = b / scale
    for _ in range(most or 3 * a.shape[0]):
        gradient = a.T @ (target - a @ x)
        gradient[free] = -np.inf
        enters = int(np.argmax(gradient))
        if gradient[enters] <= 1e-10:
            break
        free[enters] = True
        while True:
            at = np.flatnonzero(free)
            held = a[:, at]
            s = np.linalg.lstsq(held, target, rcond=None)[0] if len(at) > a.shape[0] else np.linalg.solve(held.T @ held + 1e-12 * np.eye(len(at)), held.T @ target)
            if (s > 1e-12).all():
                x[:] = 0
                x[at] = s
                break
            low = at[s <= 1e-12]
            cut = s[s <= 1e-12]
            step = (x[low] / np.maximum(x[low] - cut, 1e-300)).min()
            x[at] += step * (s - x[at])
            gone = at[(x[at] <= 1e-12) & (s <= 1e-12)]
            if not len(gone):
                gone = low[np.argmin(x[low])][None]
            x[gone] = 0
            free[gone] = False
            if enters in gone:
                break
    return x * scale


def plan(histogram: np.ndarray, p: Params) -> list[tuple[Counter, int]]:
    """How often to repeat each combination; histogram[k]: pieces of k steps (none at 0). Never takes more pieces than there are."""
    units = p.window // p.step
    every = combinations(units, p.depth)
    usable = [c for c in every if all(histogram[k] for k in c)]
    if not usable:
        return []
    a = np.zeros((units + 1, len(usable)))
    for j, c in enumerate(usable):
        for k, times in c.items():
            a[k, j] = times
    wanted = nonnegative(a[1:], histogram[1:].astype(float))
    left, repeats = histogram.astype(np.int64).copy(), np.zeros(len(usable), np.int64)

    def take(j: int, most: int) -> None:
        times = min([most, *(int(left[k]) // n for k, n in usable[j].items())])
        if times > 0:
            repeats[j] += times
            for k, n in usable[j].items():
                left[k] -= n * times

    for j in np.argsort(-wanted, kind="stable").tolist():
        take(j, int(wanted[j] + 0.5))
    for j in range(len(usable)):
        take(j, int(left.max()))
    return [(usable[j], int(n)) for j, n in enumerate(repeats.tolist()) if n]


class Slots:
    """A plan by lengths: pieces of a length are taken in order of rank, so many in a row for each place in a combination."""

    def __init__(self, made: list[tuple[Counter, int]], units: int):
        keys, first_rank, first_sequence, places, counts = [], [], [], [], []
        used, sequences = [0] * (units + 1), 0
        for combination, repeats in made:
            place = 0
            for k in sorted(combination, reverse=True):
                for _ in range(combination[k]):
                    keys.append(k)
                    first_rank.append(used[k])
                    first_sequence.append(sequences)
                    places.append(place)
                    counts.append(repeats)
                    used[k] += repeats
                    place += 1
            sequences += repeats
        order = np.lexsort((np.array(first_rank, np.int64), np.array(keys, np.int64)))
        take = lambda x: np.array(x, np.int64)[order]
        self.keys, self.first_rank, self.first_sequence, self.places, self.counts = map(take, (keys, first_rank, first_sequence, places, counts))
        self.at = np.searchsorted(self.keys, np.arange(units + 2))
        self.sequences = sequences

    def find(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequence (-1: not planned) and place in it of the pieces of these lengths in steps and ranks."""
        sequence, place = np.full(len(rank), -1), np.zeros(len(rank), np.int64)
        for k in np.unique(length).tolist():
            mine, (a, b) = np.flatnonzero(length == k), self.at[k : k + 2]
            slot = a + np.searchsorted(self.first_rank[a:b], rank[mine], "right") - 1
            good = slot >= a
            mine, slot = mine[good], slot[good]
            within = rank[mine] - self.first_rank[slot]
            good = within < self.counts[slot]
            sequence[mine[good]] = self.first_sequence[slot[good]] + within[good]
            place[mine[good]] = self.places[slot[good]]
        return sequence, place


def _encoded(path: str, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            data, offsets = text_bytes(batch.column("text"))
            for a, b in slices(offsets):
                sizes, held = [], []
                for k in range(a, b):
                    ids = np.append(c.ids(data[offsets[k] : offsets[k + 1]].tobytes()), np.uint32(end))
                    sizes.append(len(ids))
                    held.append(packed(ids))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), pa.array(sizes, pa.int64()), pa.array(held, pa.binary())], ["doc_id", "n", "ids"])

    return run


def _planned(slots: Slots):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sequence, place = slots.find(*(batch.column(c).to_numpy() for c in ("steps", "rank")))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sequence, pa.int64()), pa.array(place, pa.int64())], [*batch.schema.names, "sequence", "place"])

    return run


def _sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pieces of each document's ids, a few MB at once or one document."""
    names = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
    for batch in batches:
        pieces, held = batch.column("pieces"), batch.column("ids")
        edges = pieces.offsets.to_numpy()
        start, length, sequence, offset = (x.slice(edges[0], edges[-1] - edges[0]) for x in pieces.values.flatten())
        edges = edges - edges[0]
        spans = list(zip(start.to_pylist(), length.to_pylist(), strict=True))
        cut, sizes, size, first = [], [], 0, 0
        for row in range(batch.num_rows):
            ids = unpacked(held[row].as_py()).astype("<u4", copy=False)
            sizes.append(len(ids))
            size += ids.nbytes
            raw = ids.tobytes()
            cut += [raw[4 * s : 4 * (s + n)] for s, n in spans[edges[row] : edges[row + 1]]]
            if size >= SENT or row == batch.num_rows - 1:
                a, b = edges[first], edges[row + 1]
                own = np.repeat(np.arange(first, row + 1), np.diff(edges[first : row + 2]))
                part = [x.slice(a, b - a) for x in (start, length, sequence, offset)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(own)), *part[:2], pa.array(cut, pa.binary()), pa.array(np.array(sizes)[own - first]), *part[2:]], names)
                cut, sizes, size, first = [], [], 0, row + 1


def _before(sums: DataFrame, value: str, keys: list[str]) -> DataFrame:
    """sums with `before`: the running sum of value over blocks before, within keys; a row for each block, not for each document."""
    by = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    return sums.withColumn("before", F.coalesce(F.sum(value).over(by.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long")))


def pack(docs: DataFrame, path: str, end: int = 1, p: Params = Params()) -> DataFrame:
    """docs: doc_id, text (others ignored); path: a lower-casing BPE file of the tokenizers library with word ends; `end` follows each document.
    Returns a row for each piece: doc_id, start, length, ids (binary: little-endian unsigned 32-bit), doc_tokens, sequence_id, offset.

    Every id lies in one piece. Sequences hold `window` tokens at most; the laid-out rest ends in sequences of falling powers of two, which need no
    padding. Null and empty texts are one id, `end`. Rows of one doc_id, or of none, are documents of their own; equal lengths are taken in order of
    rows as they were written. Very long texts are full windows and one piece of less. No rows: no rows.
    """
    w = p.window
    coded = docs.select("doc_id", "text").mapInArrow(_encoded(path, end), "doc_id long, n long, ids binary")
    coded = written(coded.select(F.monotonically_increasing_id().alias("row"), "*"), "packing_ids")
    lengths = coded.select("row", F.shiftright("row", BLOCK_BITS).alias("block"), "n", F.expr(f"n div {w}").alias("full"), F.ceil(F.expr(f"n % {w}") / p.step).cast("long").alias("steps"))
    sums = lengths.groupBy("block", "steps").agg(F.count(F.lit(1)).alias("pieces"), F.sum("full").alias("full"))
    histogram, whole = np.zeros(w // p.step + 1, np.int64), 0
    for r in sums.groupBy("steps").agg(F.sum("pieces").alias("pieces"), F.sum("full").alias("full")).collect():  # at most a row for each step of the window
        histogram[r.steps] = r.pieces
        whole += r.full
    histogram[0] = 0
    slots = Slots(plan(histogram, p), w // p.step)

    inside = Window.partitionBy("block", "steps").orderBy("row")
    lengths = lengths.withColumn("k", F.row_number().over(inside) - 1)
    ranked = lengths.join(_before(sums.select("block", "steps", "pieces"), "pieces", ["steps"]), ["block", "steps"])
    ranked = ranked.select("row", "block", "n", "full", "steps", (F.col("k") + F.col("before")).alias("rank"))
    placed = written(ranked.mapInArrow(_planned(slots), "row long, block long, n long, full long, steps long, rank long, sequence long, place long"), "packing_places")

    def laid(rows: DataFrame, value: str) -> DataFrame:
        """rows with `at`: the running sum of value before each row."""
        own = F.sum(value).over(Window.partitionBy("block").orderBy("row").rowsBetween(Window.unboundedPreceding, 0)) - F.col(value)
        starts = _before(rows.groupBy("block").agg(F.sum(value).alias("sum")), "sum", []).select("block", "before")
        return rows.withColumn("at", own).join(starts, "block").withColumn("at", F.col("at") + F.col("before")).drop("before")

    # full windows: sequences 0, 1, ...
    windows = laid(placed.where("full > 0").select("row", "block", "full"), "full").select("row", "at", F.explode(F.sequence(F.lit(0).cast("long"), F.col("full") - 1)).alias("k"))
    windows = windows.select("row", (F.col("k") * w).alias("start"), F.lit(w).cast("long").alias("length"), (F.col("at") + F.col("k")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    # planned pieces follow them
    piece = [F.expr(f"full * {w}").alias("start"), F.expr(f"n % {w}").alias("length")]
    order = Window.partitionBy("sequence").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    grouped = placed.where("sequence >= 0").select("row", "sequence", "place", *piece).withColumn("offset", F.sum("length").over(order) - F.col("length"))
    grouped = grouped.select("row", "start", "length", (F.col("sequence") + whole).alias("sequence_id"), "offset")
    # the rest end to end
    rest = placed.where("sequence < 0 and steps > 0").select("row", "block", *piece)
    total = rest.agg(F.sum("length")).first()[0] or 0
    last, bounds = total - total % w, [total - total % w]
    for bit in range(w.bit_length() - 2, -1, -1):
        if total >> bit & 1:
            bounds.append(bounds[-1] + (1 << bit))
    ends = F.array(*(F.lit(x).cast("long") for x in bounds))
    first, final = F.expr(f"at div {w} + 1"), F.expr(f"(at + length - 1) div {w}")
    full = F.when(first <= final, F.transform(F.sequence(first, final), lambda k: k * w)).otherwise(F.array().cast("array<long>"))
    inner = F.array_distinct(F.concat(full, F.filter(ends, lambda x: (x > F.col("at")) & (x < F.col("at") + F.col("length")))))
    edges = F.array_sort(F.concat(F.array("at"), inner, F.array(F.col("at") + F.col("length"))))
    cut = laid(rest, "length").withColumn("edges", edges).select("row", "start", "at", "edges", F.explode(F.sequence(F.lit(0), F.size("edges") - 2)).alias("k"))
    here, there = F.get("edges", F.col("k")), F.get("edges", F.col("k") + 1)
    base = whole + slots.sequences
    held = F.filter(ends, lambda x: x <= here)  # of the last window the bounds up to this piece
    number = F.when(here < last, F.floor(here / w)).otherwise(last // w + F.size(held) - 1)
    begin = F.when(here < last, F.floor(here / w) * w).otherwise(F.array_max(held))
    cut = cut.select("row", (F.col("start") + here - F.col("at")).alias("start"), (there - here).alias("length"), (number + base).cast("long").alias("sequence_id"), (here - begin).cast("long").alias("offset"))

    pieces = windows.unionByName(grouped).unionByName(cut).groupBy("row").agg(F.sort_array(F.collect_list(F.struct("start", "length", "sequence_id", "offset"))).alias("pieces"))
    met = coded.select("row", "doc_id", "ids").join(pieces, "row").select("doc_id", "ids", "pieces")
    return met.mapInArrow(_sliced, "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")
