"""Trie of the turn sequences of conversations, as a node table with minimal perfect hashes.

Messages become narrow rows first: conversation, turn, a digest of role and text, and the size of the text. A prefix digest is a
polynomial of the turn digests modulo a 127-bit prime, so digests of parts add up: conversations are ranged over tasks by id
and turn, each task sums its part, and the sums of the tasks before are added afterwards, wherever a long conversation was cut. Rebuilding
(head of one conversation, rest of another) is arithmetic on these sums.

Distinct prefix digests are the nodes. Their shards are whole subtrees: a node whose subtree spans more than ``subtree_rows``
prefixes belongs to the crown, every subtree below the crown goes to one shard with others, so no shard is larger than intended by more than
one subtree. A shard gives each digest its slot by a minimal perfect hash, verified against the digest kept in the slot,
scatters the counts into flat arrays and adds them up through the parents' slots, deepest first. What the
tops of the shards hold is summed by parent; the crown is done in the same way, in bands of depth where it exceeds ``band_nodes``.

Defined results: messages without ``conv_id`` belong to no conversation; a null turn comes first; equal turns are in the order
of their digests, repeated rows are turns of their own; null roles and texts are empty; for a negative id the conversation that lends its
head is the next lower multiple of five; an empty table has no nodes; other columns are ignored. Two sequences with one
digest stop the job with an error.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noteframe.llm.arrowtext import mix
from noteframe.operators.skew import spread_join
from noteframe.session import cut

PRIME = (1 << 127) - 1
BASE = 0x2F6B8D5A3C91E7740D1B6E59A2C4F813
EMPTY = hashlib.sha256(b"").hexdigest()
_LOW = (1 << 64) - 1


@dataclass(frozen=True)
class PrefixTrie:
    family: int = 5  # conversations that share the head of the first of them
    heads: int = 9  # head lengths 0 .. 8
    subtree_rows: int = 4_096
    shard_nodes: int = 1_024
    band_nodes: int = 1_000_000
    hot_rows: int = 65_536  # keys of more rows are salted in joins
    page: int = 4_096  # span of ids in one piece of an id list


PLAN = PrefixTrie()


def _pairs(numbers: list[int]) -> list[pa.Array]:
    """128-bit numbers as two signed longs."""
    high = np.array([x >> 64 for x in numbers], np.uint64).view(np.int64)
    low = np.array([x & _LOW for x in numbers], np.uint64).view(np.int64)
    return [pa.array(high), pa.array(low)]


def _numbers(high, low) -> list[int]:
    high, low = (np.asarray(x, np.int64).view(np.uint64).tolist() for x in (high, low))
    return [a << 64 | b for a, b in zip(high, low, strict=True)]


# Order inside a conversation


def narrow(messages: DataFrame) -> DataFrame:
    """``conv_id, turn, digest, n``: no text goes further than this."""
    role, text = (F.coalesce(c, F.lit("")) for c in ("role", "text"))
    whole = F.concat(F.length(role).cast("string"), F.lit(":"), role, text)
    return messages.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"),
        "turn",
        F.substring(F.unhex(F.sha2(whole, 256)), 1, 16).alias("digest"),
        F.octet_length(text).cast("long").alias("n"),
    )


_SCANNED = ["part", "conv_id", "r", "qa", "qb", "ta", "tb", "n", "last"]


def _scan(batches) -> Iterator[pa.RecordBatch]:
    """Rank and polynomial of each message among those of its conversation in this task."""
    part = TaskContext.get().partitionId()
    conv, rank, sums, power, held = None, 0, 0, 1, None

    def rows(block: list, last: bool) -> pa.RecordBatch:
        convs, ranks, sums, turns, sizes = zip(*block, strict=True)
        n = len(block)
        columns = [np.full(n, part), np.array(convs), np.array(ranks)]
        columns = [pa.array(c, pa.int64()) for c in columns] + _pairs(list(sums)) + _pairs(list(turns))
        flags = np.zeros(n, bool)
        flags[-1] = last
        return pa.RecordBatch.from_arrays([*columns, pa.array(sizes, pa.int64()), pa.array(flags)], _SCANNED)

    for batch in batches:
        block = [held] if held else []
        for c, digest, n in zip(*(batch.column(k).to_pylist() for k in (0, 2, 3)), strict=True):
            if c != conv:
                conv, rank, sums, power = c, 0, 0, 1
            turn = int.from_bytes(digest)
            rank, power = rank + 1, power * BASE % PRIME
            sums = (sums + turn * power) % PRIME
            block.append((c, rank, sums, turn, n))
        held = block.pop() if block else None
        if block:
            yield rows(block, False)
    if held:
        yield rows([held], True)


def _shifted(before: dict[int, tuple[int, int, int]]):
    """Adds what a conversation had in the tasks before."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part, conv, rank, *_ = (c.to_numpy() for c in batch.columns[:3])
            sums = _numbers(batch["qa"], batch["qb"])
            rank = rank.copy()
            for p in np.unique(part).tolist():
                carried, count, start = before.get(p, (None, 0, 0))
                at = np.flatnonzero((part == p) & (conv == carried)) if carried is not None else np.zeros(0, int)
                step = pow(BASE, count, PRIME)
                for k in at.tolist():
                    sums[k] = (start + step * sums[k]) % PRIME
                rank[at] += count
            columns = [batch["conv_id"], pa.array(rank), *_pairs(sums), batch["ta"], batch["tb"], batch["n"]]
            yield pa.RecordBatch.from_arrays(columns, ["conv_id", "r", "qa", "qb", "ta", "tb", "n"])

    return run


def placed(messages: DataFrame) -> DataFrame:
    """``conv_id, r, qa, qb, ta, tb, n``: every message with its place and the digest of the prefix it ends."""
    # The row number parts copies of one message, so that any number of them can be ranged over tasks.
    rows = narrow(messages).withColumn("row", F.monotonically_increasing_id())
    keys = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("digest"), F.col("row")]
    rows = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).select("conv_id", "turn", "digest", "n")
    kinds = "part long, conv_id long, r long, qa long, qb long, ta long, tb long, n long, last boolean"
    scanned = cut(rows.mapInArrow(_scan, kinds))
    before, carried = {}, None  # one row for each task, not for each conversation
    for row in scanned.where("last").select("part", "conv_id", "r", "qa", "qb").orderBy("part").collect():
        if carried:
            before[row["part"]] = carried
        (sums,), count = _numbers([row["qa"]], [row["qb"]]), row["r"]
        if carried and carried[0] == row["conv_id"]:
            sums, count = (carried[2] + pow(BASE, carried[1], PRIME) * sums) % PRIME, count + carried[1]
        carried = (row["conv_id"], count, sums)
    return scanned.mapInArrow(_shifted(before), "conv_id long, r long, qa long, qb long, ta long, tb long, n long")


# Rebuilt conversations


def rebuilt(rows: DataFrame, plan: PrefixTrie = PLAN) -> DataFrame:
    """``conv_id, own, h, head, g, length, ha, hb, oa, ob`` for every conversation.

    ``head`` holds the ``g`` turns lent by the first conversation of the family, ``ha, hb`` is their digest; ``oa, ob`` is that of the own
    turns which they replace; ``length`` counts all turns.
    """
    start = F.when(F.col("r") < plan.heads, F.struct("r", "qa", "qb", "ta", "tb", "n"))
    convs = rows.groupBy("conv_id").agg(F.max("r").alias("own"), F.sort_array(F.collect_list(start)).alias("start"))
    h = F.crc32(F.col("conv_id").cast("string")) % plan.heads
    convs = cut(convs.withColumn("h", h.cast("int")))
    lent = convs.select(F.col("conv_id").alias("lender"), F.col("start").alias("lent"))
    lender = F.try_subtract("conv_id", F.pmod("conv_id", F.lit(plan.family)))
    convs = convs.withColumn("lender", lender).join(lent, "lender", "left")
    convs = convs.withColumn("head", F.expr("slice(coalesce(lent, filter(start, x -> false)), 1, h)"))
    convs = convs.withColumn("g", F.size("head").cast("long"))

    def digest(turns: str, place: str, half: str):
        return F.expr(f"coalesce(try_element_at({turns}, nullif(int({place}), 0)).{half}, 0L)")

    return convs.select(
        "conv_id", "own", "h", "head", "g",
        (F.col("g") + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("length"),
        digest("head", "g", "qa").alias("ha"), digest("head", "g", "qb").alias("hb"),
        digest("start", "h", "qa").alias("oa"), digest("start", "h", "qb").alias("ob"),
    )


_PREFIX = "conv_id long, depth long, length long, da long, db long, ta long, tb long, n long"
_PREFIX_NAMES = [c.split()[0] for c in _PREFIX.split(", ")]


def _moved(batches) -> Iterator[pa.RecordBatch]:
    """Digests of own turns behind the head that was lent."""
    steps = {k: pow(BASE, k, PRIME) for k in range(-16, 1)}
    for batch in batches:
        column = dict(zip(batch.schema.names, batch.columns, strict=True))
        sums, head, own = (_numbers(column[f"{x}a"], column[f"{x}b"]) for x in "qho")
        late = pa.compute.subtract(column["g"], column["h"])
        found = [(a + steps[k] * (q - o)) % PRIME for a, k, q, o in zip(head, late.to_pylist(), sums, own, strict=True)]
        depth = pa.compute.add(column["r"], late)
        columns = [column["conv_id"], depth, column["length"], *_pairs(found), column["ta"], column["tb"], column["n"]]
        yield pa.RecordBatch.from_arrays(columns, _PREFIX_NAMES)


def prefixes(rows: DataFrame, convs: DataFrame, plan: PrefixTrie = PLAN) -> DataFrame:
    """One row for each conversation and each depth of at least one: the digest of the prefix and its last turn."""
    heads = convs.select("conv_id", "length", F.explode("head").alias("turn")).select(
        "conv_id", F.col("turn.r").alias("depth"), "length", F.col("turn.qa").alias("da"), F.col("turn.qb").alias("db"),
        "turn.ta", "turn.tb", "turn.n",
    )
    behind = convs.where("own > h").select("conv_id", F.col("h").cast("long").alias("h"), "g", "length", "ha", "hb", "oa", "ob")
    own = spread_join(rows, behind, "conv_id", salt_by=["r"], hot_rows=plan.hot_rows).where("r > h")
    return heads.unionByName(own.mapInArrow(_moved, _PREFIX))


# Nodes


def _with_parents(batches) -> Iterator[pa.RecordBatch]:
    """The parent's digest: the node's own less its last turn."""
    for batch in batches:
        column = dict(zip(batch.schema.names, batch.columns, strict=True))
        if not all(pa.compute.all(pa.compute.equal(column[c], column[f"{c}_most"])).as_py() in (True, None) for c in ("depth", "ta", "tb")):
            raise ValueError("two turn sequences share one digest")
        found = _numbers(column["da"], column["db"])
        turns = _numbers(column["ta"], column["tb"])
        parents = [
            (d - t * pow(BASE, k, PRIME)) % PRIME for d, t, k in zip(found, turns, column["depth"].to_pylist(), strict=True)
        ]
        yield pa.RecordBatch.from_arrays(
            [*(column[c] for c in ("conv_id", "depth", "da", "db")), *_pairs(parents), *(column[c] for c in ("n_convs", "n", "spans"))],
            _NODE_NAMES,
        )


_NODE = "conv_id long, depth long, da long, db long, pa long, pb long, n_convs long, n long, spans long"
_NODE_NAMES = [c.split()[0] for c in _NODE.split(", ")]


def nodes(prefix_rows: DataFrame) -> DataFrame:
    """The distinct prefixes: smallest member, members, size of the last text, and ``spans``, the prefixes of members below."""
    held = prefix_rows.groupBy("da", "db").agg(
        F.min("conv_id").alias("conv_id"),
        F.count(F.lit(1)).alias("n_convs"),
        *[F.min(c).alias(c) for c in ("depth", "ta", "tb", "n")],
        *[F.max(c).alias(f"{c}_most") for c in ("depth", "ta", "tb")],
        F.sum(F.col("length") - F.col("depth") + 1).alias("spans"),
    )
    return held.mapInArrow(_with_parents, _NODE)


class PerfectHash:
    """A minimal perfect hash of distinct 128-bit keys: every key has one slot of ``0 .. n - 1``, kept and compared."""

    def __init__(self, a: np.ndarray, b: np.ndarray):
        self.a, self.b = np.zeros(len(a), np.uint64), np.zeros(len(a), np.uint64)
        self.levels: list[tuple[int, np.ndarray, np.ndarray]] = []
        rest, used = np.arange(len(a)), 0
        while len(rest):
            if len(self.levels) > 200:
                raise ValueError("two nodes share one digest")
            size = 2 * len(rest) + 1
            at = self._place(a[rest], b[rest], len(self.levels), size)
            alone = np.bincount(at, minlength=size) == 1  # keys that meet go on to the next level
            slots = used + np.cumsum(alone) - 1
            placed = alone[at]
            self.a[slots[at[placed]]], self.b[slots[at[placed]]] = a[rest[placed]], b[rest[placed]]
            self.levels.append((size, alone, slots))
            used += int(placed.sum())
            rest = rest[~placed]

    @staticmethod
    def _place(a: np.ndarray, b: np.ndarray, level: int, size: int) -> np.ndarray:
        seed = np.uint64((level + 1) * 0x9E3779B97F4A7C15 & _LOW)
        return (mix(mix(a ^ seed) + b) % np.uint64(size)).astype(np.int64)

    def slots(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The slot of each key, -1 for keys that the slot does not confirm."""
        out = np.full(len(a), -1, np.int64)
        rest = np.arange(len(a))
        for level, (size, alone, slots) in enumerate(self.levels):
            at = self._place(a[rest], b[rest], level, size)
            held = alone[at]
            out[rest[held]] = slots[at[held]]
            rest = rest[~held]
        wrong = out >= 0
        wrong[wrong] = (self.a[out[wrong]] != a[wrong]) | (self.b[out[wrong]] != b[wrong])
        out[wrong] = -1
        return out


_DONE = (
    "conv_id long, depth long, da long, db long, pa long, pb long, parent_conv_id long, top boolean, n_convs long, "
    "n_children long, n_leaves long, saved_tokens long"
)


def accumulated(table: pa.Table) -> pa.Table:
    """The node table of one shard: counts scattered to slots and added up through the parents' slots, deepest first.

    ``n_children``, ``n_leaves`` and ``saved`` come in with what the shards below have sent; ``up`` is the parent's
    conversation where the parent is in another shard.
    """
    column = {name: table[name].to_numpy() for name in ("conv_id", "depth", "n_convs", "n", "n_children", "n_leaves", "saved")}
    da, db, pa_, pb = (table[name].to_numpy().view(np.uint64) for name in ("da", "db", "pa", "pb"))
    table_of = PerfectHash(da, db)
    slot = table_of.slots(da, db)
    size = len(slot)

    def scattered(values):
        out = np.zeros(size, np.int64)
        out[slot] = values
        return out

    parent = scattered(table_of.slots(pa_, pb))
    depth, conv = scattered(column["depth"]), scattered(column["conv_id"])
    children, leaves, members = (scattered(column[c]) for c in ("n_children", "n_leaves", "n_convs"))
    saved = scattered(column["saved"] + (column["n_convs"] - 1) * column["n"])
    parent[parent == np.arange(size)] = -1  # the root is its own parent
    deepest = np.argsort(-depth, kind="stable")
    for at in np.split(deepest, np.flatnonzero(np.diff(depth[deepest])) + 1):
        leaves[at] += children[at] == 0
        at = at[parent[at] >= 0]
        np.add.at(children, parent[at], 1)
        np.add.at(leaves, parent[at], leaves[at])
        np.add.at(saved, parent[at], saved[at])
    top = parent < 0
    above = pa.array(np.where(top, 0, conv[parent]), mask=top)
    above = pa.compute.coalesce(above.take(pa.array(slot)), table["up"].combine_chunks())
    columns = [table[c] for c in ("conv_id", "depth", "da", "db", "pa", "pb")]
    columns += [above, pa.array(top[slot]), *(pa.array(x[slot]) for x in (members, children, leaves, saved))]
    return pa.table(dict(zip((c.split()[0] for c in _DONE.split(", ")), columns, strict=True)))


def _sent(done: DataFrame) -> DataFrame:
    """What tops of shards add to their parents."""
    sums = done.where("top").groupBy(F.col("pa").alias("da"), F.col("pb").alias("db"))
    return sums.agg(
        F.count(F.lit(1)).alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved")
    )


def _subtrees(light: DataFrame, heavy: DataFrame, prefix_rows: DataFrame, plan: PrefixTrie) -> DataFrame:
    """The nodes below the crown, each shard a set of whole subtrees."""
    crown = heavy.select(F.col("da").alias("pa"), F.col("db").alias("pb"), F.col("conv_id").alias("up"))
    tops = spread_join(light.select("da", "db", "pa", "pb"), crown, ["pa", "pb"], hot_rows=plan.hot_rows)
    tops = tops.select("da", "db", "up")
    # A path enters one subtree at most; so does every node, along the path of its smallest member.
    entered = prefix_rows.select("conv_id", "da", "db").join(tops, ["da", "db"])
    entered = entered.select("conv_id", F.xxhash64("da", "db").alias("subtree"), "up")
    shards = light.agg(F.ceil(F.count(F.lit(1)) / plan.shard_nodes)).first()[0]
    zero = F.lit(0).cast("long")
    held = light.join(entered, "conv_id").select(
        *_NODE_NAMES, "up", F.pmod("subtree", F.lit(max(1, shards))).alias("shard"),
        zero.alias("n_children"), zero.alias("n_leaves"), zero.alias("saved"),
    )
    return held.groupBy("shard").applyInArrow(accumulated, _DONE)


def _crown(heavy: DataFrame, sent: DataFrame, plan: PrefixTrie) -> list[DataFrame]:
    """The nodes of the crown in bands of depth, the deepest first; nearly always one band."""
    parents = heavy.select(F.col("da").alias("pa"), F.col("db").alias("pb"), F.col("conv_id").alias("up"))
    heavy = cut(heavy.join(parents, ["pa", "pb"], "left"))
    span = 1_024  # depths that are never parted; keeps the list below short for very deep tries
    depths = heavy.groupBy(F.floor(F.col("depth") / span).alias("at")).count().orderBy(F.desc("at")).collect()
    bands, room = [], 0
    for row in depths:
        if row["count"] > room or not bands:
            bands.append([row["at"], row["at"]])
            room = plan.band_nodes
        bands[-1][0] = row["at"]
        room -= row["count"]
    out = []
    for low, high in bands:
        held = heavy.where(F.col("depth").between(low * span, (high + 1) * span - 1)).join(sent, ["da", "db"], "left")
        held = held.fillna(0, ["n_children", "n_leaves", "saved"])
        out.append(cut(held.withColumn("band", F.lit(low)).groupBy("band").applyInArrow(accumulated, _DONE)))
        sent = sent.unionByName(_sent(out[-1])).groupBy("da", "db")
        sent = sent.agg(*[F.sum(c).alias(c) for c in ("n_children", "n_leaves", "saved")])
    return out


# Conversations that end at a node


def _hashed(batches) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the id lists of each node, from sorted pieces; a list may be longer than a batch."""
    node, state = None, None

    def rows(done: list) -> pa.RecordBatch:
        columns = [pa.array(c, t) for c, t in zip(zip(*done, strict=True), (pa.int64(), pa.int64(), pa.string()), strict=True)]
        return pa.RecordBatch.from_arrays(columns, ["da", "db", "ends_sha256"])

    for batch in batches:
        done = []
        for da, db, ids in zip(*(batch[c].to_pylist() for c in ("da", "db", "ids")), strict=True):
            if (da, db) == node:
                state.update(b",")
            else:
                if node:
                    done.append((*node, state.hexdigest()))
                node, state = (da, db), hashlib.sha256()
            state.update(ids.encode())
        if done:
            yield rows(done)
    if node:
        yield rows([(*node, state.hexdigest())])


def ends(prefix_rows: DataFrame, convs: DataFrame, plan: PrefixTrie = PLAN) -> DataFrame:
    """``da, db, ends_sha256`` of the nodes at which a conversation ends.

    Pieces of lists are built wherever; only the hash of one list, a sequential function, reads its pieces in one task, one at a time.
    """
    last = prefix_rows.where("depth = length").select("conv_id", "da", "db")
    zero = F.lit(0).cast("long")
    last = last.unionByName(convs.where("length = 0").select("conv_id", zero.alias("da"), zero.alias("db")))
    page = F.floor(F.col("conv_id") / plan.page).alias("page")
    ids = F.array_sort(F.collect_list("conv_id"))
    pages = last.groupBy("da", "db", page).agg(F.array_join(F.transform(ids, lambda x: x.cast("string")), ",").alias("ids"))
    pages = pages.repartition("da", "db").sortWithinPartitions("da", "db", "page")
    return pages.mapInArrow(_hashed, "da long, db long, ends_sha256 string")


OUT = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def trie(messages: DataFrame, plan: PrefixTrie = PLAN) -> DataFrame:
    """One row per node: ``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256``."""
    rows = placed(messages)
    convs = cut(rebuilt(rows, plan))
    prefix_rows = cut(prefixes(rows, convs, plan))
    found = cut(nodes(prefix_rows))
    zero = F.lit(0).cast("long")
    root = convs.agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).where("n_convs > 0")
    root = root.select(
        "conv_id", *[zero.alias(c) for c in ("depth", "da", "db", "pa", "pb")], "n_convs", zero.alias("n"), zero.alias("spans")
    )
    heavy = cut(found.where(F.col("spans") > plan.subtree_rows).unionByName(root))
    light = found.where(F.col("spans") <= plan.subtree_rows)
    below = cut(_subtrees(light, heavy, prefix_rows, plan))
    out = below
    for band in _crown(heavy, _sent(below), plan):
        out = out.unionByName(band)
    out = out.join(ends(prefix_rows, convs, plan), ["da", "db"], "left")
    parent = F.when(F.col("depth") > 0, F.col("parent_conv_id")).alias("parent_conv_id")
    return out.withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(EMPTY))).select(
        *[parent if c == "parent_conv_id" else c for c in OUT]
    )
