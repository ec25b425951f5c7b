"""Variable-capacity best-fit packing of documents into training sequences.

Best fit depends on lengths only, so the plan is made on the histogram of lengths, which has
at most ``max(capacities)`` rows however many documents there are: lengths in falling order,
each into the open bins with the least room that fits, equal bins together. Where none
fits, a bin of the least-cost permitted size is opened. The opening rules of all sizes are
tried jointly on the histogram, every bin is finally downsized to the least permitted
size that holds its contents, and the rule with the least total cost wins. Each
piece then finds its bin from its rank among the pieces of its length; ranks come from
counts per written part, so no group of equal lengths meets in one task.

Defined results: ``pack_tokens``, which the queries use, takes the number of tokens of the given vocabulary
and an end mark as the length, and ``pack`` any length, by default words and an end mark; so a null or empty text
has length 1; a document longer than the largest size becomes several pieces, all of
them packed; repeated rows and rows without ``doc_id`` are packed like others; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from noteframe.llm.native import NOT_WHITE
from noteframe.llm.sentence_pieces import token_sizes
from noteframe.session import cut


def training_cost(size: int) -> float:
    """Relative cost of one sequence: linear layers and attention."""
    return size + size * size / 32_768


@dataclass(frozen=True)
class Packing:
    capacities: tuple[int, ...] = (512, 1024, 2048, 4096, 8192)
    cost: Callable[[int], float] = field(default=training_cost)


PLAN = Packing()


@dataclass(frozen=True)
class Bins:
    """``count`` bins with the same contents: ``(length, copies)`` in order."""

    count: int
    contents: tuple[tuple[int, int], ...]
    room: int

    @property
    def used(self) -> int:
        return sum(length * copies for length, copies in self.contents)


def best_fit(histogram: dict[int, int], opens: Callable[[int], int]) -> list[Bins]:
    """Best-fit decreasing over counted lengths; ``opens(length)`` is the size of a new bin."""
    open_by_room: dict[int, list[Bins]] = {}
    rooms: list[int] = []

    def put(bins: Bins) -> None:
        if bins.count:
            if bins.room not in open_by_room:
                insort(rooms, bins.room)
                open_by_room[bins.room] = []
            open_by_room[bins.room].append(bins)

    def take(length: int) -> Bins:
        """The first bins with the least room that fits, or no end of new ones."""
        k = bisect_left(rooms, length)
        if k == len(rooms):
            return Bins(0, (), opens(length))
        room = rooms[k]
        bins = open_by_room[room].pop(0)
        if not open_by_room[room]:
            del open_by_room[room], rooms[k]
        return bins

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            bins = take(length)
            each = bins.room // length
            full = left // each if not bins.count else min(bins.count, left // each)
            some = left % each if full < bins.count or not bins.count else 0
            put(Bins(full, (*bins.contents, (length, each)), bins.room - each * length))
            if some:
                put(Bins(1, (*bins.contents, (length, some)), bins.room - some * length))
            if bins.count:
                put(Bins(bins.count - full - bool(some), bins.contents, bins.room))
            left -= full * each + some
    return [bins for room in rooms for bins in open_by_room[room]]


def downsized(bins: Bins, sizes: Iterable[int]) -> int:
    return min(s for s in sizes if s >= bins.used)


def opening_rules(plan: Packing) -> list[Callable[[int], int]]:
    """One rule per size (that size where it fits, else the next one), and the least cost per filled place."""
    sizes = sorted(plan.capacities)

    def usual(size: int) -> Callable[[int], int]:
        return lambda length: next(s for s in sizes if s >= max(size, length))

    def least_cost(length: int) -> int:
        return min((s for s in sizes if s >= length), key=lambda s: plan.cost(s) / (s // length * length))

    return [*map(usual, sizes), least_cost]


def plan_bins(histogram: dict[int, int], plan: Packing = PLAN) -> list[tuple[Bins, int]]:
    """The cheapest packing over all opening rules, with the final size of each bin."""
    best: tuple[float, list[tuple[Bins, int]]] | None = None
    for rule in opening_rules(plan):
        packed = [(b, downsized(b, plan.capacities)) for b in best_fit(histogram, rule)]
        cost = sum(b.count * plan.cost(size) for b, size in packed)
        if best is None or cost < best[0]:
            best = (cost, packed)
    return best[1]


_RANK_BITS = 44


def _slots(packed: list[tuple[Bins, int]]) -> dict[str, np.ndarray]:
    """One row per length and group of equal bins: which ranks of the length go where."""
    rows, next_rank, first_bin = [], {}, 0
    for bins, size in packed:
        place = 0
        for length, copies in bins.contents:
            rank = next_rank.get(length, 0)
            rows.append(((length << _RANK_BITS) + rank, rank, first_bin, copies, place, size, bins.used))
            next_rank[length] = rank + copies * bins.count
            place += length * copies
        first_bin += bins.count
    names = ("key", "rank", "first_bin", "copies", "place", "size", "used")
    table = np.array(sorted(rows), np.int64).reshape(-1, len(names))
    return dict(zip(names, table.T, strict=True))


def word_length(text: Column) -> Column:
    """Words of a text and an end mark."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(NOT_WHITE + "+")).cast("long") + 1


def pack(docs: DataFrame, plan: Packing = PLAN, length: Column | None = None) -> DataFrame:
    """One row per piece: ``doc_id, piece, first, last`` (its tokens of the document),
    ``length, bin_id, position`` (its start in the bin), ``bin_size`` and ``bin_used``."""
    spark = docs.sparkSession
    top = max(plan.capacities)
    sized = docs.select("doc_id", (word_length(F.col("text")) if length is None else length).alias("n"))
    starts = F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(top).cast("long"))
    pieces = sized.where("n > 0").select("doc_id", "n", F.posexplode(starts).alias("piece", "first"))
    pieces = pieces.withColumn("last", F.least(F.col("first") + top, F.col("n")))
    items = cut(
        pieces.select(
            "doc_id",
            "piece",
            "first",
            "last",
            (F.col("last") - F.col("first")).alias("length"),
            F.spark_partition_id().alias("part"),
            F.monotonically_increasing_id().alias("pos"),
        )
    )
    counts = cut(items.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n")))
    totals = counts.groupBy("length").agg(F.sum("n").alias("n")).toArrow().to_pydict()  # one row per length
    slots = spark.sparkContext.broadcast(_slots(plan_bins(dict(zip(totals["length"], totals["n"], strict=True)), plan)))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("length", "part").orderBy("pos")
    ranked = items.withColumn("own", F.row_number().over(inside) - 1).join(offsets, ["length", "part"])
    ranked = ranked.select(
        "doc_id", "piece", "first", "last", "length", (F.col("own") + F.col("offset")).cast("long").alias("rank")
    )

    def place(batches):
        t = slots.value
        for batch in batches:
            size, rank = batch.column(4).to_numpy(), batch.column(5).to_numpy()
            row = np.searchsorted(t["key"], (size << _RANK_BITS) + rank, "right") - 1
            nth = rank - t["rank"][row]
            found = [
                t["first_bin"][row] + nth // t["copies"][row],
                t["place"][row] + nth % t["copies"][row] * size,
                t["size"][row],
                t["used"][row],
            ]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], *map(pa.array, found)], names)

    names = ["doc_id", "piece", "first", "last", "length", "bin_id", "position", "bin_size", "bin_used"]
    kinds = dict(ranked.dtypes)
    schema = ", ".join(f"{n} {kinds.get(n, 'bigint')}" for n in names)
    return ranked.mapInArrow(place, schema)


def pack_tokens(docs: DataFrame, model_path: str, plan: Packing = PLAN) -> DataFrame:
    """``pack`` by tokens: lengths, and where pieces begin and end, count the ids of the vocabulary at ``model_path``."""
    return pack(token_sizes(docs, model_path), plan, F.col("n_tokens") + 1)
