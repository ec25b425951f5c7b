"""Near-duplicate documents by SuperMinHash, banding, verification and union-find.

Texts with one shingle set form a class; the class goes on as its smallest
``doc_id``. SuperMinHash gives every element a random permutation of the signature's slots, so
that the ranks of one element are correlated and each slot is taken once; an element
stops as soon as its next rank can lower no slot. Bands of the signature put classes into
buckets. In a bucket each class is compared with the smallest one only; links are confirmed on
the full sets and merged. Buckets that still hold several groups are finished
exactly by a prefix join over differences from a common reference (see ``_leftover``).
So no bucket is paired with itself and nothing is capped.

Defined results: a null or wordless text has an empty set and links with nothing; a text
with fewer words than a shingle is one shingle; a row without ``doc_id`` links with
nothing and has no component; rows that share a ``doc_id`` are one document; an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noteframe.llm import arrowtext as at
from noteframe.llm.groups import components
from noteframe.llm.native import packed
from noteframe.llm.rowset import maybe_in, within, without
from noteframe.session import cut


@dataclass(frozen=True)
class NearDup:
    """Shingle size, least similarity in percent, and the bands of the signature.

    A pair at the limit shares a band with probability ``1 - (1 - 0.8 ** 5) ** 26`` = 0.99997.
    """

    words: int = 4
    percent: int = 80
    bands: int = 26
    rows: int = 5


BLOCK = 1 << 16  # elements whose permutations are held at once

CONTRACT = NearDup()
PIPELINE = NearDup(words=5)


def superminhash(values: np.ndarray, owner: np.ndarray, texts: int, slots: int) -> np.ndarray:
    """One signature per text over hashed elements; equal entries mean equal minima.

    Rank ``j`` of an element lies in ``[j, j + 1)`` and goes to slot ``j`` of its own
    Fisher-Yates permutation. After rank ``j`` a text is done when all its slots are below ``j + 1``.
    Minima do not depend on the order of the elements, so these go through in blocks of ``BLOCK``: the permutations
    of a block are ``BLOCK * slots`` numbers, however many texts come at once.
    """
    low = np.full((texts, slots), np.inf)
    for start in range(0, len(values), BLOCK):
        part = owner[start : start + BLOCK]
        first = part.min()
        _lower(low[first : part.max() + 1].reshape(-1), values[start : start + BLOCK], part - first, slots)
    return low


def _lower(low: np.ndarray, values: np.ndarray, owner: np.ndarray, slots: int) -> None:
    """Take the ranks of one block of elements into the slots ``low`` of its texts."""
    texts = len(low) // slots
    step = np.uint64(0x9E3779B97F4A7C15)
    order = np.empty((0, slots), np.uint8 if slots <= 256 else np.uint16)
    for j in range(slots):
        seed = values + np.uint64((2 * j + 1) * int(step) & 0xFFFFFFFFFFFFFFFF)
        rank = j + (at.mix(seed) >> np.uint64(11)).astype(np.float64) / 2.0**53
        pick = j + (at.mix(seed + step) % np.uint64(slots - j)).astype(np.int64)
        if j == 0:
            slot = pick
        else:
            rows = np.arange(len(values))
            slot = order[rows, pick].astype(np.int64)
            order[rows, pick] = order[:, j]
            order[:, j] = slot
        np.minimum.at(low, owner * slots + slot, rank)
        open_text = low.reshape(texts, slots).max(axis=1) > j + 1
        stay = open_text[owner]
        if not stay.any():
            break
        if j == 0:
            order = np.tile(np.arange(slots, dtype=order.dtype), (int(stay.sum()), 1))
            rows, first = np.arange(len(order)), pick[stay]
            order[rows, first] = 0
            order[:, 0] = first
        else:
            order = order[stay]
        values, owner = values[stay], owner[stay]


def _signed(texts: pa.Array, plan: NearDup):
    """Set size, two set digests and band keys of every text."""
    for _, _, data, offsets in at.chunks(texts):
        sets = list(at.shingles(data, offsets, plan.words))
        sizes = np.array([len(s) for s in sets], np.int64)
        values = np.concatenate(sets)
        owner = np.repeat(np.arange(len(sets)), sizes)
        low = superminhash(values, owner, len(sets), plan.bands * plan.rows)
        bits = np.ascontiguousarray(low).view(np.uint64).reshape(len(sets), plan.bands, plan.rows)
        keys = np.zeros((len(sets), plan.bands), np.uint64) + at.mix(np.arange(1, plan.bands + 1, dtype=np.uint64))
        for r in range(plan.rows):
            keys = at.mix(keys + bits[:, :, r])
        digests = []
        for salt in (1, 2):
            total = np.zeros(len(sets), np.uint64)
            np.add.at(total, owner, at.mix(values + np.uint64(salt)))
            digests.append(total.view(np.int64))
        yield sizes, *digests, keys.view(np.int64)


def _sign(plan: NearDup):
    def run(batches):
        for batch in batches:
            parts = list(_signed(batch.column(1), plan)) if len(batch) else []
            if parts:
                sizes, one, two, keys = (np.concatenate(x) for x in zip(*parts, strict=True))
                bands = pa.ListArray.from_arrays(
                    np.arange(0, keys.size + 1, plan.bands, dtype=np.int32), pa.array(keys.ravel())
                )
                arrays = [batch.column(0), pa.array(sizes), pa.array(one), pa.array(two), bands]
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_shingles", "one", "two", "bands"])

    return run


def _sets(plan: NearDup):
    def run(batches):
        for batch in batches:
            for a, b, data, offsets in at.chunks(batch.column(1)):
                sets = list(at.shingles(data, offsets, plan.words))
                flat = np.concatenate(sets).view(np.int64)
                ends = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.ListArray.from_arrays(ends, pa.array(flat))], ["id", "set"]
                )

    return run


def _alike(a: Column, b: Column, plan: NearDup) -> Column:
    """Whether two set sizes allow the similarity at all."""
    return 100 * F.least(a, b) >= plan.percent * F.greatest(a, b)


def _confirmed(pairs: DataFrame, sets: DataFrame, plan: NearDup) -> DataFrame:
    """The pairs ``a, b`` whose full sets are similar enough."""
    both = pairs.join(sets.select(F.col("id").alias("b"), F.col("set").alias("sb")), "b")
    both = both.join(sets.select(F.col("id").alias("a"), F.col("set").alias("sa")), "a")
    shared = F.size(F.array_intersect("sa", "sb"))
    union = F.size("sa") + F.size("sb") - shared
    return both.where(100 * shared >= plan.percent * union).select("a", "b")


def _leftover(members: DataFrame, found: DataFrame, sets: DataFrame, plan: NearDup) -> DataFrame:
    """Links still missing where a bucket holds several groups.

    All members of such a bucket are written as differences from one reference set ``p``,
    the smallest group's first document. With ``c`` shingles of ``x`` in ``p``, two sets reach the
    similarity only if their differences share ``R = a (|x| + |y|) + |p| - c_x - c_y`` shingles, where
    ``a = t / (1 + t)``. So they share one of the ``|difference| - R + 1`` rarest of each. Bounds of ``R`` that hold for
    every possible partner: one outside the reference's group is not similar to ``p``, which
    gives ``R > a |x| + (1 - a) |p| - c``; for any partner the sizes and ``c_y <= c_x + |y - x|`` give the
    other. Members inside the group are not paired with each other, and the edits that
    near copies have on their own are rare, so a large group pairs little.
    """
    t = plan.percent
    group = F.coalesce("component", "id").alias("group")
    grouped = members.where("n_members > 2").join(found.withColumnRenamed("node", "id"), "id", "left")
    grouped = grouped.select("key", "id", group)
    mixed = grouped.groupBy("key").agg(F.min("group").alias("ref"), F.max("group").alias("last")).where("ref <> last")
    against = cut(grouped.join(mixed.select("key", "ref"), "key").select("id", "group", "ref").distinct())
    taking_part = against.select("id").unionByName(against.select(F.col("ref").alias("id"))).distinct()
    sets = sets.where(maybe_in([F.col("id")], taking_part))  # the others are not moved
    both = against.join(sets, "id").join(sets.select(F.col("id").alias("ref"), F.col("set").alias("p")), "ref")
    both = both.withColumn("c", F.size(F.array_intersect("set", "p")))
    n, m, c = F.size("set"), F.size("p"), F.col("c")
    near = 100 * c >= t * (n + m - c)
    inside = near | (F.col("group") == F.col("ref"))
    outer = F.floor((t * n + 100 * m - (100 + t) * c) / (100 + t)) + 1
    any_partner = F.greatest(
        F.lit(1),
        F.ceil((t * n - 100 * c) / 100),
        F.ceil((t * (2 * n + m - 2 * c) - 100 * n) / t),
        F.ceil((t * (n + m - c) - 100 * n) / t),
    )
    different = F.concat(F.array_except("set", "p"), F.array_except("p", "set"))
    far = cut(
        both.select(
            "id",
            "ref",
            n.alias("n"),
            (near & (F.col("id") != F.col("ref"))).alias("near"),
            inside.alias("inside"),
            F.when(inside, F.col("ref")).otherwise(F.col("group")).alias("group"),
            (F.size(different) - outer + 1).cast("int").alias("short"),
            (F.size(different) - F.when(inside, outer).otherwise(any_partner) + 1).cast("int").alias("long"),
            different.alias("different"),
        )
    )
    flat = far.where("long > 0").select("id", "ref", F.explode("different").alias("shingle"), "group")
    often = flat.groupBy("ref", "shingle").agg(
        F.count(F.lit(1)).alias("df"), (F.min("group") != F.max("group")).alias("mixed")
    )
    listed = flat.join(often, ["ref", "shingle"]).groupBy("ref", "id")
    listed = listed.agg(F.sort_array(F.collect_list(F.struct("df", "shingle", "mixed"))).alias("listed"))
    rare = far.drop("different").join(listed, ["ref", "id"])
    rare = rare.select(
        "id", "ref", "n", "inside", "group", "short", F.posexplode(F.slice("listed", F.lit(1), F.col("long"))).alias("at", "e")
    )
    rare = rare.where("e.mixed").select(
        "ref", F.col("e.shingle").alias("shingle"), "id", "n", "inside", "group", (F.col("at") < F.col("short")).alias("early")
    )
    keys, rest = ["ref", "shingle"], ["id", "n", "inside", "group", "early"]
    left = rare.where("NOT inside").select(*keys, *[F.col(x).alias(f"a_{x}") for x in rest])
    right = rare.select(*keys, *[F.col(x).alias(f"b_{x}") for x in rest])
    fits = F.expr("a_group <> b_group AND (b_inside OR (a_early AND b_early AND a_id > b_id))")
    pairs = left.join(right, keys).where(fits & _alike(F.col("a_n"), F.col("b_n"), plan))
    pairs = pairs.select(F.col("a_id").alias("a"), F.col("b_id").alias("b")).distinct()
    to_ref = far.where("near").select(F.col("id").alias("a"), F.col("ref").alias("b"))
    return _confirmed(pairs, sets, plan).unionByName(to_ref)


def near_duplicates(docs: DataFrame, plan: NearDup = CONTRACT) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept``, one row per row of ``docs``."""
    signed = cut(
        docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
            _sign(plan), "doc_id long, n_shingles long, one long, two long, bands array<long>"
        )
    )
    same_set = ["n_shingles", "one", "two"]
    usable = signed.where("doc_id IS NOT NULL AND n_shingles > 0")
    classes = cut(usable.groupBy(*same_set).agg(F.min("doc_id").alias("id"), F.first("bands").alias("bands")))
    spread = classes.select("id", F.col("n_shingles").alias("n"), F.explode("bands").alias("key"))
    buckets = spread.groupBy("key").agg(F.min(F.struct("id", "n")).alias("pivot"), F.count(F.lit(1)).alias("n_members"))
    members = cut(spread.join(buckets.where("n_members > 1"), "key"))
    wanted = cut(members.select(F.col("id").alias("doc_id")).distinct())
    # Most texts share no bucket; these are told where they stand, and only the others are moved to their ids.
    sets = cut(
        docs.select(F.col("doc_id").cast("long"), "text")
        .where(maybe_in([F.col("doc_id")], wanted))
        .join(wanted, "doc_id", "left_semi")
        .dropDuplicates(["doc_id", "text"])
        .mapInArrow(_sets(plan), "id long, set array<long>")
        .where(F.size("set") > 0)
    )
    stars = (
        members.where((F.col("id") != F.col("pivot.id")) & _alike(F.col("n"), F.col("pivot.n"), plan))
        .select(F.col("id").alias("a"), F.col("pivot.id").alias("b"))
        .distinct()
    )
    links = cut(_confirmed(stars, sets, plan))
    found = cut(components(links))
    rest = cut(_leftover(members, found, sets, plan))
    final = components(found.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(rest))
    named = (
        classes.select(*same_set, "id")
        .join(final.withColumnRenamed("node", "id"), "id", "left")
        .select(*same_set, F.coalesce("component", "id").alias("component_id"))
    )
    out = signed.select("doc_id", *same_set).join(named, same_set, "left")
    component = F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    component = F.when(F.col("doc_id").isNotNull(), component)
    return out.select(
        "doc_id",
        "n_shingles",
        component.alias("component_id"),
        F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"),
    )


def _fresh_ids(ids: DataFrame) -> Column:
    """Ids that no row has, larger than all where there is room."""
    low, high = ids.agg(F.min("doc_id"), F.max("doc_id")).first()
    if high is None or high < 1 << 62:
        return F.monotonically_increasing_id() + F.lit(max(0, -1 if high is None else high) + 1)
    if low > -(1 << 62):
        return F.lit(min(0, low) - 1) - F.monotonically_increasing_id()
    raise ValueError("doc_id takes up the whole range of a long")


def keep_one(docs: DataFrame, plan: NearDup = PIPELINE) -> DataFrame:
    """One document of each group, that of the smallest ``doc_id``, with its own columns.

    Texts decide. Rows that share ``doc_id`` and text are one document, of which one row stays. Rows without ``doc_id``, and
    rows whose ``doc_id`` other texts have too, are judged by their text under an id of their own, which comes after
    all given ones. Texts without words are like nothing. An empty table stays empty. Whole texts are not moved, but for rows of
    the kinds just named.
    """
    key = F.struct(F.xxhash64("text"), F.coalesce(F.length("text"), F.lit(-1)))
    rows = cut(docs.select(F.col("doc_id").cast("long").alias("doc_id"), key.alias("key")))
    named = rows.where("doc_id IS NOT NULL").groupBy("doc_id")
    named = named.agg(F.count(F.lit(1)).alias("n"), (F.min("key") != F.max("key")).alias("torn")).where("n > 1")
    named = cut(named)
    torn, twice = (cut(named.where(cond).select("doc_id")) for cond in ("torn", "NOT torn"))
    with_id = docs.where(F.col("doc_id").isNotNull())
    doc_id = {"doc_id": F.col("row.doc_id").cast("long")}
    odd = docs.where(F.col("doc_id").isNull())
    texts = with_id
    if not torn.isEmpty():
        odd, texts = odd.unionByName(within(with_id, doc_id, torn)), without(with_id, doc_id, torn)
    odd = cut(packed(odd).withColumn("id", _fresh_ids(rows)))
    texts = texts.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    verdict = near_duplicates(texts.unionByName(odd.select(F.col("id").alias("doc_id"), "row.text")), plan)
    gone = cut(verdict.where("NOT kept").select("doc_id").distinct())
    out = without(with_id, doc_id, gone.unionByName(torn).unionByName(twice).distinct())
    if not twice.isEmpty():
        several = within(with_id, doc_id, twice.join(gone, "doc_id", "left_anti"))
        out = out.unionByName(several.dropDuplicates(["doc_id"]))
    return out.unionByName(odd.join(gone, odd["id"] == gone["doc_id"], "left_anti").select("row.*"))
