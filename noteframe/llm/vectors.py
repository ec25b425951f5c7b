"""Near-duplicate vectors by an inverted multi-index.

Two codebooks, one per half of the vector, form a grid of cells. Every vector is indexed in its home cell
and visits cells in the order of the multi-sequence traversal, nearest first, until the target
recall: the traversal stops at the distance within which that share of pairs finds one another, both of pairs made at the similarity limit
and of the true pairs that a sample of at most ``queries`` classes has among all classes, compared in blocks. What is visited is verified in double precision. Equal vectors are one class with a
weight; tasks return counts and the spanning forest of what they verified, never pairs.

Only the codebooks and the stopping distance are fitted on a sample, of at most ``sample`` classes;
all vectors are indexed and searched. Cells are dealt to blocks of bounded size, so no task holds a
whole cell.

Defined results: vectors that are null, empty, all zero, or hold null or non-finite parts link with
nothing, nor do vectors of different length; rows without ``vec_id`` link with nothing and have no
component; rows that share a ``vec_id`` are one node; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noteframe.llm.groups import components, roots
from noteframe.session import cut


@dataclass(frozen=True)
class MultiIndex:
    cosine: float = 0.9
    recall: float = 0.995  # share of pairs at the limit that the traversal must reach
    sample: int = 20_000  # bound of the classes that codebooks and stopping distance are fitted on
    cell_rows: int = 256  # intended classes per cell; sets the size of the grid
    queries: int = 1_000  # bound of the classes whose true pairs among all classes set the stopping distance
    block_rows: int = 1_024
    rounds: int = 12


PLAN = MultiIndex()


@dataclass(frozen=True)
class Index:
    """Codebooks of both halves and how much farther than the home cell a traversal goes."""

    first: np.ndarray
    second: np.ndarray
    reach: float
    width: int

    def distances(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Squared distances of both halves to all centres."""
        half = self.width // 2
        out = []
        for part, book in ((vectors[:, :half], self.first), (vectors[:, half:], self.second)):
            far = (part**2).sum(1)[:, None] - 2 * part @ book.T + (book**2).sum(1)
            out.append(np.maximum(far, 0))
        return out[0], out[1]


def traverse(first: np.ndarray, second: np.ndarray, reach: float):
    """Multi-sequence traversal: cells ``(i, j)`` by growing distance, to ``reach`` beyond the nearest."""
    a, b = np.argsort(first, kind="stable"), np.argsort(second, kind="stable")
    x, y = first[a].tolist(), second[b].tolist()
    stop = x[0] + y[0] + reach
    heap, pushed = [(x[0] + y[0], 0, 0)], {(0, 0)}
    while heap and heap[0][0] <= stop:
        _, i, j = heapq.heappop(heap)
        yield int(a[i]), int(b[j])
        for p, q in ((i + 1, j), (i, j + 1)):
            if p < len(x) and q < len(y) and (p, q) not in pushed:
                pushed.add((p, q))
                heapq.heappush(heap, (x[p] + y[q], p, q))


def _codebook(points: np.ndarray, size: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    """Centres by Lloyd's rounds from distinct starting points."""
    points = np.unique(points, axis=0)
    centres = points[rng.permutation(len(points))[:size]].copy()
    for _ in range(rounds):
        near = ((centres**2).sum(1) - 2 * points @ centres.T).argmin(axis=1)
        counts = np.bincount(near, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, near, points)
        full = counts > 0
        centres[full] = sums[full] / counts[full, None]
    return centres


def fit(sample: np.ndarray, classes: int, plan: MultiIndex = PLAN) -> Index:
    """Codebooks from unit vectors, and the reach from pairs made exactly as similar as the limit."""
    rng = np.random.default_rng(7)
    width = sample.shape[1]
    size = int(np.clip(np.sqrt(classes / plan.cell_rows), 1, max(1, len(sample) // 8)))
    half = width // 2
    index = Index(
        _codebook(sample[:, :half], size, plan.rounds, rng), _codebook(sample[:, half:], size, plan.rounds, rng), 0, width
    )
    x = sample[rng.permutation(len(sample))[:4_000]]
    aside = rng.normal(size=x.shape)
    aside -= (aside * x).sum(1)[:, None] * x
    aside /= np.maximum(np.linalg.norm(aside, axis=1), 1e-12)[:, None]
    y = plan.cosine * x + np.sqrt(1 - plan.cosine**2) * aside
    (x1, x2), (y1, y2) = index.distances(x), index.distances(y)
    rows = np.arange(len(x))

    def beyond(d1, d2, e1, e2):
        return d1[rows, e1.argmin(1)] + d2[rows, e2.argmin(1)] - d1.min(1) - d2.min(1)

    need = np.minimum(beyond(x1, x2, y1, y2), beyond(y1, y2, x1, x2))
    return Index(index.first, index.second, float(np.quantile(need, plan.recall)) + 1e-9, width)


def _unit(column: pa.Array, width: int) -> np.ndarray:
    """Unit vectors in double precision; shorter ones are filled with zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    out = np.zeros((len(column), width))
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    out /= np.abs(out).max(axis=1, keepdims=True)  # so that no square overflows
    return out / np.linalg.norm(out, axis=1, keepdims=True)


_STEPS = 1_000  # resolution of distances beyond the home cell


def _beyond(index: Index, ids: np.ndarray, sizes: np.ndarray, queries: np.ndarray, plan: MultiIndex):
    """``query, step, n``: how far beyond its home cell a query or its partner has to go, for every true pair of a sampled query."""
    (gq, hq) = index.distances(queries)
    near_q = gq.argmin(1), hq.argmin(1)
    least_q = gq.min(1) + hq.min(1)

    def run(batches):
        for batch in batches:
            for k in range(0, len(batch), 2_000):
                part = batch.slice(k, 2_000)
                y = _unit(part.column(1), index.width)
                row, q = np.nonzero(y @ queries.T >= plan.cosine)
                keep = (part.column(0).to_numpy()[row] != ids[q]) & (part.column(2).to_numpy()[row] == sizes[q])
                row, q = row[keep], q[keep]
                gy, hy = index.distances(y)
                out = gq[q, gy.argmin(1)[row]] + hq[q, hy.argmin(1)[row]] - least_q[q]
                back = gy[row, near_q[0][q]] + hy[row, near_q[1][q]] - (gy.min(1) + hy.min(1))[row]
                steps = np.ceil(np.minimum(out, back) * _STEPS).astype(np.int64)
                found, n = np.unique(np.column_stack([q, steps]), axis=0, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1]), pa.array(n)], ["query", "step", "n"])

    return run


def reach_of(query: np.ndarray, step: np.ndarray, n: np.ndarray, recall: float) -> float:
    """The distance within which ``recall`` of all pairs lie, and of the pairs of the average query."""
    if not len(step):
        return 0.0
    order = np.argsort(step, kind="stable")
    out = 0.0
    for weight in (n.astype(float), n / np.bincount(query, n)[query]):
        share = np.cumsum(weight[order]) / weight.sum()
        out = max(out, float(step[order][np.searchsorted(share, min(recall, share[-1]))]) / _STEPS)
    return out


def _widened(index: Index, classes: DataFrame, drawn: pa.Table, plan: MultiIndex) -> Index:
    """The index with the stopping distance that the true pairs of the sampled queries ask for."""
    asked = drawn.slice(0, plan.queries)
    ids, sizes = asked["id"].to_numpy(), asked["size"].to_numpy()
    beyond = _beyond(index, ids, sizes, _unit(asked["v"], index.width), plan)
    needs = classes.select("id", "v", "size").mapInArrow(beyond, "query long, step long, n long")
    needs = needs.groupBy("query", "step").agg(F.sum("n").alias("n")).toArrow()
    reach = reach_of(*(needs[c].to_numpy() for c in ("query", "step", "n")), plan.recall)
    return replace(index, reach=max(index.reach, reach + 1e-9))


def _placed(index: Index):
    """Each class as a member of its home cell and a visitor of all cells it traverses."""

    def run(batches):
        for batch in batches:
            first, second = index.distances(_unit(batch.column(1), index.width))
            row, cell, member = [], [], []
            for k in range(len(batch)):
                for n, (i, j) in enumerate(traverse(first[k], second[k], index.reach)):
                    where = i * len(index.second) + j
                    for role in (True, False) if n == 0 else (False,):
                        row.append(k)
                        cell.append(where)
                        member.append(role)
            for k in range(0, len(row), 5_000):
                part = slice(k, k + 5_000)
                taken = batch.take(pa.array(row[part], pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [*taken.columns, pa.array(cell[part], pa.int64()), pa.array(member[part], pa.bool_())], names
                )

    names = ["id", "v", "size", "weight", "cell", "member"]
    return run


def _verified(index: Index, plan: MultiIndex):
    """Links between the visitors and the members of one block, as counts and a forest."""

    def run(table: pa.Table) -> pa.Table:
        member = table["member"].to_numpy()
        inside, guests = table.filter(pa.array(member)), table.filter(pa.array(~member))
        out = [np.zeros((0, 3), np.int64)]
        if len(inside) and len(guests):
            x, y = _unit(guests["v"], index.width), _unit(inside["v"], index.width)
            xi, yi = guests["id"].to_numpy(), inside["id"].to_numpy()
            xw, yw = guests["weight"].to_numpy(), inside["weight"].to_numpy()
            a, b = np.nonzero(x @ y.T >= plan.cosine)
            a, b = a[xi[a] != yi[b]], b[xi[a] != yi[b]]
            # A member that does not visit the guest's home would not count this link itself.
            (gx, hx), (gy, hy) = index.distances(x), index.distances(y)
            stop = gy.min(1) + hy.min(1) + index.reach
            missed = gy[b, gx.argmin(1)[a]] + hy[b, hx.argmin(1)[a]] > stop[b]
            for ids, n in ((xi, np.bincount(a, yw[b], len(xi))), (yi, np.bincount(b[missed], xw[a[missed]], len(yi)))):
                has = n > 0
                out.append(np.column_stack([np.zeros(has.sum(), np.int64), ids[has], n[has].astype(np.int64)]))
            u, v = roots(xi[a], yi[b])
            out.append(np.column_stack([np.ones(len(u), np.int64), u, v]))
        kind, left, right = np.concatenate(out).T
        return pa.table({"kind": kind, "a": left, "b": right})

    return run


def near_vectors(rows: DataFrame, plan: MultiIndex = PLAN) -> DataFrame:
    """``vec_id, n_links, component_id, kept``, one row per row of ``rows``."""
    spark = rows.sparkSession
    good = F.col("vec_id").isNotNull() & F.exists("embedding", lambda x: x != 0)
    good = good & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    given = rows.select("vec_id", F.when(F.coalesce(good, F.lit(False)), F.col("embedding")).alias("v"))
    # No negative zeros, so that equal vectors are one class.
    given = given.withColumn("v", F.transform("v", lambda x: x + F.lit(0).cast("float")))
    classes = given.where("v IS NOT NULL").groupBy("v")
    classes = classes.agg(F.min("vec_id").cast("long").alias("id"), F.count(F.lit(1)).alias("weight"))
    classes = cut(classes.select("id", "v", F.size("v").alias("size"), "weight"))
    count, width = classes.agg(F.count(F.lit(1)), F.max("size")).first()
    own = classes.select(F.col("v").alias("w"), F.col("id").alias("node"), (F.col("weight") - 1).alias("copies"))
    if count:
        drawn = classes.orderBy(F.xxhash64("id"), "id").limit(plan.sample).select("id", "v", "size").toArrow()
        index = _widened(fit(_unit(drawn["v"], width), count, plan), classes, drawn, plan)
        placed = cut(
            classes.mapInArrow(
                _placed(index), "id long, v array<float>, size int, weight long, cell long, member boolean"
            )
        )
        counts = placed.groupBy("size", "cell").agg(
            F.ceil(F.count_if("member") / plan.block_rows).alias("m"),
            F.ceil(F.count_if(~F.col("member")) / plan.block_rows).alias("g"),
        )
        # Members are dealt to m shares and repeated for the g shares of the visitors, and the other way round.
        share = lambda n: F.pmod(F.xxhash64("id"), F.greatest(F.col(n), F.lit(1)))
        every = lambda n: F.sequence(F.lit(0).cast("long"), F.greatest(F.col(n), F.lit(1)) - 1)
        dealt = placed.join(counts.where("m > 0 AND g > 0"), ["size", "cell"])
        dealt = dealt.withColumn("other", F.explode(F.when(F.col("member"), every("g")).otherwise(every("m"))))
        dealt = dealt.select(
            "id", "v", "weight", "member", "size", "cell",
            F.when(F.col("member"), share("m")).otherwise(F.col("other")).alias("mine"),
            F.when(F.col("member"), F.col("other")).otherwise(share("g")).alias("theirs"),
        )
        found = cut(
            dealt.groupBy("size", "cell", "mine", "theirs").applyInArrow(_verified(index, plan), "kind long, a long, b long")
        )
        links = found.where("kind = 0").groupBy(F.col("a").alias("node")).agg(F.sum("b").alias("links"))
        joined = components(found.where("kind = 1").select("a", "b"))
        own = own.join(links, "node", "left").join(joined, "node", "left")
    else:
        own = own.withColumn("links", F.lit(0).cast("long")).withColumn("component", F.col("node"))
    own = own.select("w", (F.col("copies") + F.coalesce("links", F.lit(0))).alias("n"), F.coalesce("component", "node").alias("c"))
    out = given.join(own, given["v"] == own["w"], "left")
    component = F.coalesce("c", F.col("vec_id").cast("long"))
    component = F.when(F.col("vec_id").isNotNull(), component)
    return out.select(
        "vec_id",
        F.coalesce("n", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"),
    )
