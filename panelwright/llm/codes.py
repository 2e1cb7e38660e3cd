"""Short codes of vectors: a codebook for each part, found with metric trees over the parts."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, StructType

from .common import give_back, rows_of_a_batch, written

#: Components count as at most this far from zero, so that squared distances are exact in 64 bits.
FARTHEST = 1 << 24
#: Balls of so many different points or fewer aren't divided.
LEAF = 64


def complete(vec: Column) -> Column:
    """Not null, and no component null or not finite."""
    return F.coalesce(~F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), F.lit(False))


def whole(vectors: np.ndarray) -> np.ndarray:
    """floor(256 * x) of each component."""
    return np.clip(np.floor(256.0 * vectors.astype(np.float64)), -FARTHEST, FARTHEST).astype(np.int64)


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distance of each point of ``a`` to each of ``b``."""
    total = np.zeros((len(a), len(b)), np.int64)
    for i in range(a.shape[1]):
        gap = a[:, i, None] - b[None, :, i]
        total += gap * gap
    return total


@dataclass
class Tree:
    """Balls of points in flat arrays; the points of a ball stand together, children stand after their ball.

    Each ball keeps its centre, squared radius, the number and sum of its points, repeats counted, and its children (-1: none).
    """

    points: np.ndarray
    repeats: np.ndarray
    centre: np.ndarray
    radius2: np.ndarray
    span: np.ndarray
    count: np.ndarray
    total: np.ndarray
    children: np.ndarray

    def packed(self) -> dict[str, bytes]:
        nodes = np.hstack([self.centre, self.radius2[:, None], self.span, self.count[:, None], self.total, self.children])
        return {"points": self.points.astype(np.int32).tobytes(), "repeats": self.repeats.astype(np.int32).tobytes(), "nodes": nodes.astype(np.int64).tobytes()}

    @staticmethod
    def read(packed: dict[str, bytes], width: int) -> Tree:
        points = np.frombuffer(packed["points"], np.int32).reshape(-1, width).astype(np.int64) if width else np.zeros((1, 0), np.int64)
        n = np.frombuffer(packed["nodes"], np.int64).reshape(-1, 2 * width + 6)
        w = width
        return Tree(points, np.frombuffer(packed["repeats"], np.int32).astype(np.int64), n[:, :w], n[:, w], n[:, w + 1 : w + 3], n[:, w + 3], n[:, w + 4 : 2 * w + 4], n[:, 2 * w + 4 :])


def anchors(points: np.ndarray, most: int) -> np.ndarray:
    """The anchor of each point: up to ``most`` points, each the farthest from its own anchor when it became one.

    A new anchor only looks at points that stand farther from their own than half the way between the two anchors.
    """
    owner = np.zeros(len(points), np.int64)
    gap = points - points[0]
    far = (gap * gap).sum(axis=1)
    pivots = [points[0]]
    while len(pivots) < most:
        new = int(np.argmax(far))
        if not far[new]:
            break
        away = np.array([((p - points[new]) ** 2).sum() for p in pivots]) if len(pivots) < 8 else ((np.array(pivots) - points[new]) ** 2).sum(axis=1)
        look = np.flatnonzero(4 * far > away[owner])
        gap = points[look] - points[new]
        d = (gap * gap).sum(axis=1)
        won = d < far[look]
        owner[look[won]], far[look[won]] = len(pivots), d[won]
        pivots.append(points[new])
    return owner


def grown(points: np.ndarray, repeats: np.ndarray) -> tuple[Tree, np.ndarray]:
    """A tree from the middle out, and the order in which it keeps the points.

    About as many anchors as the square root of the points; balls around them are put together by pairs, the one with the smallest
    common ball first, up to the root; each anchor's own points are divided in the same way.
    """
    balls: list[tuple[int, int] | np.ndarray] = []

    def divide(which: np.ndarray) -> int:
        if len(which) > LEAF:
            owner = anchors(points[which], int(np.ceil(np.sqrt(len(which)))))
            groups = [which[owner == k] for k in range(int(owner.max()) + 1)]
            if len(groups) > 1:
                return joined([divide(g) for g in groups], groups)
        balls.append(which)
        return len(balls) - 1

    def joined(nodes: list[int], groups: list[np.ndarray]) -> int:
        weight = np.array([float(len(g)) for g in groups])
        centre = np.array([points[g].mean(axis=0) for g in groups])
        radius = np.array([np.sqrt(((points[g] - c) ** 2).sum(axis=1).max()) for g, c in zip(groups, centre)])
        apart = np.sqrt(((centre[:, None] - centre[None]) ** 2).sum(axis=2))
        cost = np.maximum((apart + radius[:, None] + radius[None]) / 2, np.maximum(radius[:, None], radius[None]))
        np.fill_diagonal(cost, np.inf)
        nodes = list(nodes)
        for _ in range(len(nodes) - 1):
            a, b = divmod(int(np.argmin(cost)), len(nodes))
            balls.append((nodes[a], nodes[b]))
            nodes[a] = len(balls) - 1
            radius[a] = cost[a, b]
            centre[a] = (centre[a] * weight[a] + centre[b] * weight[b]) / (weight[a] + weight[b])
            weight[a] += weight[b]
            cost[b], cost[:, b] = np.inf, np.inf
            open_ = np.isfinite(cost[a])
            d = np.sqrt(((centre - centre[a]) ** 2).sum(axis=1))
            cost[a] = np.where(open_, np.maximum((d + radius + radius[a]) / 2, np.maximum(radius, radius[a])), np.inf)
            cost[:, a] = cost[a]
            last = a
        return nodes[last]

    stack, order, centre, radius2, span, count, total, children = [(divide(np.arange(len(points))), -1, 0)], [], [], [], [], [], [], []
    at = 0
    members: dict[int, np.ndarray] = {}
    for k, ball in enumerate(balls):
        members[k] = ball if isinstance(ball, np.ndarray) else np.concatenate([members[ball[0]], members[ball[1]]])
    while stack:
        ball, parent, side = stack.pop()
        which, me = members[ball], len(centre)
        sums = (points[which] * repeats[which, None]).sum(axis=0)
        n = int(repeats[which].sum())
        middle = sums // n
        gap = points[which] - middle
        centre.append(middle)
        radius2.append(int((gap * gap).sum(axis=1).max()))
        count.append(n)
        total.append(sums)
        span.append((at, at + len(which)))
        children.append([-1, -1])
        if parent >= 0:
            children[parent][side] = me
        if isinstance(balls[ball], np.ndarray):
            order.append(which)
            at += len(which)
        else:
            stack += [(balls[ball][1], me, 1), (balls[ball][0], me, 0)]
    kept = np.concatenate(order)
    tree = Tree(points[kept], repeats[kept], np.array(centre), np.array(radius2), np.array(span), np.array(count), np.array(total), np.array(children))
    return tree, kept


def owned(tree: Tree, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The nearest entry of each point, the first among equals, and each entry's number and sum of points.

    All balls of a level go down together, each with the entries that its parent left: one goes if another is strictly nearer to all that the
    ball can hold. A ball with one entry left is its own as a whole, by its cached number and sum; points are looked at only in leaves that
    several entries share.
    """
    k = len(entries)
    code = np.empty(len(tree.points), np.int64)
    n, total = np.zeros(k, np.int64), np.zeros((k, entries.shape[1]), np.int64)
    between = np.sqrt(squared(entries, entries).astype(np.float64))
    ball, left = np.zeros(1, np.int64), np.ones((1, k), bool)
    far = np.iinfo(np.int64).max
    while len(ball):
        d = squared(tree.centre[ball], entries)
        best = np.where(left, d, far).argmin(axis=1)
        lead = d - d[np.arange(len(ball)), best][:, None]
        left = left & ~(lead > 2 * np.sqrt(tree.radius2[ball].astype(np.float64))[:, None] * between[best] * (1 + 1e-9))
        single = left.sum(axis=1) == 1
        for b, e in zip(ball[single], best[single]):
            code[tree.span[b, 0] : tree.span[b, 1]] = e
        np.add.at(n, best[single], tree.count[ball[single]])
        np.add.at(total, best[single], tree.total[ball[single]])
        leaf = ~single & (tree.children[ball, 0] < 0)
        for b, some in zip(ball[leaf], left[leaf]):
            at, to = tree.span[b]
            which = np.flatnonzero(some)
            e = which[squared(tree.points[at:to], entries[which]).argmin(axis=1)]
            code[at:to] = e
            np.add.at(n, e, tree.repeats[at:to])
            np.add.at(total, e, tree.points[at:to] * tree.repeats[at:to, None])
        down = ~single & ~leaf
        ball, left = tree.children[ball[down]].ravel(), np.repeat(left[down], 2, axis=0)
    return code, n, total


def cuts(dim: int, parts: int) -> list[slice]:
    """Consecutive parts of equal width, or of widths one apart."""
    return [slice(p * dim // parts, (p + 1) * dim // parts) for p in range(parts)]


def planted(base: DataFrame, kept: list[str], spans: list[slice], block: int) -> DataFrame:
    """Rows of ``_vec`` in blocks: the columns ``kept``, and for each part a tree and where each row's point is in it."""
    fields = StructType(base.select(*kept).schema.fields)
    struct = to_arrow_schema(fields)
    tree_type = "struct<points:binary,repeats:binary,nodes:binary,row_of:binary>"
    schema = StructType.fromDDL(f"_trees array<{tree_type}>")
    schema.add("_rows", ArrayType(fields))
    arrow = to_arrow_schema(schema)

    def tree_of(x: np.ndarray) -> dict[str, bytes]:
        points, row_of, repeats = np.unique(x, axis=0, return_inverse=True, return_counts=True)
        tree, order = grown(points, repeats)
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        return tree.packed() | {"row_of": place[row_of.ravel()].astype(np.int32).tobytes()}

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            while held and sum(b.num_rows for b in held) + batch.num_rows > block:
                yield made(held)
                held = []
            for at in range(0, batch.num_rows, block):
                held.append(batch.slice(at, block))
                if len(held) > 1 and batch.num_rows > block:
                    yield made(held[:-1])
                    held = held[-1:]
        if held:
            yield made(held)
        give_back()

    def made(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held).combine_chunks()
        x = whole(np.array(table.column("_vec").to_pylist(), dtype=np.float64).reshape(table.num_rows, -1))
        trees = [tree_of(x[:, s]) for s in spans]
        cols = [table.column(c).combine_chunks().cast(f.type) for c, f in zip(kept, struct)]
        cols = [c.chunk(0) if isinstance(c, pa.ChunkedArray) else c for c in cols]
        rows = pa.ListArray.from_arrays(pa.array([0, table.num_rows], pa.int32()), pa.StructArray.from_arrays(cols, fields=list(struct)))
        return pa.RecordBatch.from_arrays([pa.array([trees], arrow.field(0).type), rows.cast(arrow.field(1).type)], schema=arrow)

    return base.mapInArrow(blocks, schema)


def codebooks_of(trees: DataFrame, books: list[np.ndarray], rounds: int) -> list[np.ndarray]:
    """The books after some rounds of assigning every part and taking the means, rounded down, of what each entry got.

    A task adds up its balls; what is shuffled and fetched has a row for each task, part and entry.
    """
    spark = trees.sparkSession
    widths = [b.shape[1] for b in books]
    widest = max(widths)
    fields = ", ".join(["part int", "entry int", "n long", *[f"s{i} long" for i in range(widest)]])
    arrow = to_arrow_schema(StructType.fromDDL(fields))
    for _ in range(rounds):
        sent = spark.sparkContext.broadcast(books)

        def sums(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            n = [np.zeros(len(b), np.int64) for b in sent.value]
            total = [np.zeros((len(b), widest), np.int64) for b in sent.value]
            for batch in batches:
                for trees in batch.column("_trees"):
                    for p, (tree, book) in enumerate(zip(trees.as_py(), sent.value)):
                        _, m, s = owned(Tree.read(tree, widths[p]), book)
                        n[p] += m
                        total[p][:, : widths[p]] += s
            rows = [(p, e, n[p][e], *total[p][e]) for p in range(len(n)) for e in np.flatnonzero(n[p])]
            yield pa.RecordBatch.from_arrays([pa.array([int(r[i]) for r in rows], f.type) for i, f in enumerate(arrow)], schema=arrow)
            give_back()

        found = trees.select("_trees").mapInArrow(sums, fields).groupBy("part", "entry").agg(*[F.sum(c).alias(c) for c in ["n", *[f"s{i}" for i in range(widest)]]])
        books = [b.copy() for b in books]
        for r in found.collect():
            books[r["part"]][r["entry"]] = [r[f"s{i}"] // r["n"] for i in range(widths[r["part"]])]
    return books


def compress(
    vectors: DataFrame, *, keep: list[str], id_col: str = "vec_id", vec_col: str = "embedding", parts: int = 16, entries: int = 64, rounds: int = 2, block: int = 4096,
) -> tuple[DataFrame, list[np.ndarray]]:
    """The columns ``keep`` with ``_code binary`` (a byte for each part) and ``_error`` (squared distance to what the code stands for), and the codebooks.

    Components are rounded down to whole 256ths. A part's codebook starts as that part of the ``entries`` vectors with the smallest ids (ties by the
    vector, null ids last), fewer if there are no more. Vectors that are null or hold null or non-finite components, and those of another length than
    most have (the shorter of two equally common ones), are dropped; repeated rows and null ids count each for itself. Components count as at most
    65,536 from zero. Without vectors, the result is empty and so are the codebooks. At most 256 entries.

    Trees are grown once, over blocks of about ``block`` rows, and kept in the shared folder; each round and the last assignment walk them.
    """
    if not 1 <= entries <= 256:
        raise ValueError("a code has one byte for each part")
    spark = vectors.sparkSession
    kept = [f"_in_{c}" for c in keep]
    base = vectors.select(*[F.col(c).alias(k) for c, k in zip(keep, kept)], F.col(id_col).alias("_id"), F.col(vec_col).cast("array<double>").alias("_vec")).where(complete(F.col("_vec")))
    lengths = base.groupBy(F.size("_vec").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    fields = StructType([*[f for f in vectors.select(*keep).schema.fields], *StructType.fromDDL("_code binary, _error long").fields])
    if not lengths:
        return spark.createDataFrame([], fields), []
    base = base.where(F.size("_vec") == lengths[0]["n"])
    first = base.orderBy(F.col("_id").asc_nulls_last(), "_vec").select("_vec").limit(entries).collect()
    start = whole(np.array([r["_vec"] for r in first]).reshape(len(first), -1))
    spans = cuts(start.shape[1], parts)
    trees = written(planted(base.drop("_id"), kept, spans, block))
    arrow = to_arrow_schema(fields)

    def assigned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for trees, rows in zip(batch.column("_trees"), batch.column("_rows")):
                rows = rows.values
                code, error = np.empty((len(rows), parts), np.uint8), np.zeros(len(rows), np.int64)
                for p, (packed, book) in enumerate(zip(trees.as_py(), sent.value)):
                    tree = Tree.read(packed, book.shape[1])
                    entry, _, _ = owned(tree, book)
                    gap = tree.points - book[entry]
                    row_of = np.frombuffer(packed["row_of"], np.int32)
                    code[:, p], error = entry[row_of], error + (gap * gap).sum(axis=1)[row_of]
                made = [*[rows.field(i).cast(arrow.field(i).type) for i in range(len(keep))], pa.array([c.tobytes() for c in code], pa.binary()), pa.array(error)]
                yield pa.RecordBatch.from_arrays(made, schema=arrow)
        give_back()

    with rows_of_a_batch(spark, 4):
        books = codebooks_of(trees, [start[:, s] for s in spans], rounds)
        sent = spark.sparkContext.broadcast(books)
        found = written(trees.mapInArrow(assigned, fields))
    return found, books
