"""Vector codes: a codebook for each part of the vectors, fitted by Lloyd rounds over trees of parts and of entries."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from demoflux.llm.common import discard, store
from demoflux.llm.topk import usable

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024.0
LEAF = 32  # parts in a leaf of their tree, at most
CELLS = 1 << 19  # components of a block of vectors
EXACT = 1 << 53  # whole numbers that doubles hold exactly


def bound_of(length: int) -> int:
    """The largest component for which the squared distance of two vectors fits a long; it fits 32 bits as well."""
    return int((((1 << 62) // max(1, length)) ** 0.5) / 2)


def tree_order(points: np.ndarray, depth: int) -> np.ndarray:
    """An order of the points in which every node of a balanced tree is a stretch; nodes are cut at the median of their widest side.

    Node k of a level with 2**level nodes is the stretch from n * k >> level to n * (k + 1) >> level.
    """
    n, order = len(points), np.arange(len(points))
    for level in range(depth):
        for k in range(1 << level):
            begin, middle, end = (n * x >> (level + 1) for x in (2 * k, 2 * k + 1, 2 * k + 2))
            inside = points[order[begin:end]]
            widest = (inside.max(axis=0) - inside.min(axis=0)).argmax()
            order[begin:end] = order[begin:end][np.argpartition(inside[:, widest], middle - begin)]
    return order


class Tree:
    """Boxes, sums and sizes of all nodes of a balanced tree over points that are in its order."""

    def __init__(self, points: np.ndarray, depth: int):
        self.points, self.depth = points, depth
        self.cuts = len(points) * np.arange((1 << depth) + 1) >> depth
        at = self.cuts[:-1]
        levels = [(np.minimum.reduceat(points, at), np.maximum.reduceat(points, at), np.add.reduceat(points, at))]
        for _ in range(depth):
            low, high, total = levels[-1]
            levels.append((np.minimum(low[::2], low[1::2]), np.maximum(high[::2], high[1::2]), total[::2] + total[1::2]))
        self.low, self.high, self.total = zip(*levels[::-1])

    def stretch(self, level: int, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the points of the nodes begin and end."""
        step = self.depth - level
        return self.cuts[nodes << step], self.cuts[(nodes + 1) << step]


def tree_depth(n: int, leaf: int) -> int:
    depth = 0
    while n >> depth > leaf:
        depth += 1
    return depth


class Codebook:
    """The entries of one part, and the tree over them."""

    def __init__(self, entries: np.ndarray):
        depth = tree_depth(len(entries), 1)
        self.entries = entries
        self.order = tree_order(entries, depth)
        self.tree = Tree(entries[self.order], depth)
        self.sizes = np.diff(self.tree.cuts)


def nearest(points: Tree, book: Codebook) -> tuple[list[tuple[np.ndarray, np.ndarray, np.ndarray]], list[tuple[int, int, np.ndarray]]]:
    """The nearest entry of every point, ties to the lower index: of whole nodes, and of single points in uncertain leaves.

    Both trees are walked down together, level by level. A pair of nodes is dropped when the boxes are further apart than the
    points' node can be from some entry. A node with one entry left takes it as a whole: given as (level, nodes, entries).
    Leaves that keep several entries are compared point by point, in whole numbers: given as (begin, end, entries).
    """
    whole, single = [], []
    entries = book.tree
    p, e, level, below = np.zeros(1, np.int64), np.zeros(1, np.int64), 0, 0
    while len(p):
        low, high = points.low[level][p], points.high[level][p]
        apart = np.maximum(np.maximum(entries.low[below][e] - high, low - entries.high[below][e]), 0)
        some = entries.points[entries.stretch(below, e)[0]]
        furthest = np.maximum(high - some, some - low)
        firsts = np.flatnonzero(np.append(True, p[1:] != p[:-1]))
        limit = np.minimum.reduceat((furthest * furthest).sum(axis=1), firsts)
        sizes = np.diff(np.append(firsts, len(p)))
        kept = (apart * apart).sum(axis=1) <= np.repeat(limit, sizes)
        p, e = p[kept], e[kept]
        firsts = np.flatnonzero(np.append(True, p[1:] != p[:-1]))
        alone = np.repeat(np.diff(np.append(firsts, len(p))) == 1, np.diff(np.append(firsts, len(p))))
        if below == entries.depth:
            done = alone & (book.sizes[e] == 1)
            whole.append((np.full(done.sum(), level), p[done], book.order[entries.cuts[e[done]]]))
            p, e = p[~done], e[~done]
            if level == points.depth:
                _compare(points, book, p, e, single)
                break
        if below < entries.depth:
            p, e, below = np.repeat(p, 2), np.ravel(np.stack([2 * e, 2 * e + 1], axis=1)), below + 1
        if level < points.depth:
            p, e, level = np.concatenate([2 * p, 2 * p + 1]), np.concatenate([e, e]), level + 1
            at = np.argsort(p, kind="stable")
            p, e = p[at], e[at]
    return whole, single


def _compare(points: Tree, book: Codebook, p: np.ndarray, e: np.ndarray, single: list) -> None:
    """The nearest entries of the points in uncertain leaves. Products are made in doubles while these are exact whole numbers."""
    if not len(p):
        return
    largest = max(int(np.abs(points.points).max(initial=0)), int(np.abs(book.entries).max(initial=0)), 1)
    exact = 4 * points.points.shape[1] * largest ** 2 < EXACT
    entries = book.entries.astype(np.float64) if exact else book.entries
    own = points.points.astype(np.float64) if exact else points.points
    squares = (entries * entries).sum(axis=1)
    firsts = np.flatnonzero(np.append(True, p[1:] != p[:-1]))
    begins, ends = points.stretch(points.depth, p[firsts])
    for first, after, begin, end in zip(firsts, np.append(firsts[1:], len(p)), begins, ends):
        nodes = e[first:after]
        low, high = book.tree.cuts[nodes], book.tree.cuts[nodes + 1]
        if high[-1] - low[0] == len(nodes):
            found = np.sort(book.order[low[0]:high[-1]])
        else:
            found = np.sort(np.concatenate([book.order[a:b] for a, b in zip(low, high)]))
        distance = squares[found] - 2 * (own[begin:end] @ entries[found].T)
        single.append((begin, end, found[distance.argmin(axis=1)]))


def block_codes(points: Tree, book: Codebook) -> np.ndarray:
    """The entry of every point, in the tree's order."""
    codes = np.zeros(len(points.points), np.int64)
    whole, single = nearest(points, book)
    for levels, nodes, entries in whole:
        if len(nodes):
            begins, ends = points.stretch(int(levels[0]), nodes)
            sizes = ends - begins
            codes[np.repeat(begins - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())] = np.repeat(entries, sizes)
    for begin, end, entries in single:
        codes[begin:end] = entries
    return codes


def block_sums(points: Tree, book: Codebook) -> tuple[np.ndarray, np.ndarray]:
    """Sum and number of the points of every entry. Nodes that one entry takes give their stored sums."""
    k, d = book.entries.shape
    sums, counts = np.zeros((k, d), np.int64), np.zeros(k, np.int64)
    whole, single = nearest(points, book)
    for levels, nodes, entries in whole:
        if len(nodes):
            begins, ends = points.stretch(int(levels[0]), nodes)
            np.add.at(sums, entries, points.total[int(levels[0])][nodes])
            np.add.at(counts, entries, ends - begins)
    if single:
        rows = np.concatenate([np.arange(begin, end) for begin, end, _ in single])
        entries = np.concatenate([found for _, _, found in single])
        order = np.argsort(entries, kind="stable")
        firsts = np.flatnonzero(np.append(True, np.diff(entries[order]) != 0))
        used = entries[order][firsts]
        sums[used] += np.add.reduceat(points.points[rows[order]], firsts)
        counts += np.bincount(entries, minlength=k)
    return sums, counts


def whole_numbers(vectors: pa.Array, scale: float, length: int) -> np.ndarray:
    """floor(scale * x) of vectors of one length. What lies beyond `bound_of` is set to that bound."""
    flat = np.floor(scale * vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
    limit = float(bound_of(length))
    return np.clip(flat, -limit, limit).astype(np.int64).reshape(-1, length)


def _plant(length: int, parts: int, scale: float, labels: pa.DataType):
    """Task: vectors in blocks, each with the parts in the order of their trees."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = max(1, CELLS // length)
        held, waiting = [], 0
        for batch in batches:
            for begin in range(0, batch.num_rows, rows):
                piece = batch.slice(begin, rows)
                held.append((piece.column(0), piece.column(1), whole_numbers(piece.column(2), scale, length)))
                waiting += piece.num_rows
                if waiting >= rows:
                    yield plant(held)
                    held, waiting = [], 0
        if waiting:
            yield plant(held)

    def plant(held: list) -> pa.RecordBatch:
        ids, marks = (pa.concat_arrays([h[i] for h in held]) for i in (0, 1))
        matrix = np.concatenate([h[2] for h in held])
        orders, points = [], []
        for part in np.split(matrix, parts, axis=1):
            order = tree_order(part, tree_depth(len(part), LEAF))
            orders.append(order.astype(np.int32).tobytes())
            points.append(part[order].astype(np.int32).tobytes())
        one = lambda values, inner: pa.array([values], pa.list_(inner))
        return pa.RecordBatch.from_arrays(
            [pa.array([len(ids)], pa.int64()), one(ids.to_pylist(), pa.int64()), one(marks.to_pylist(), labels),
             one(orders, pa.binary()), one(points, pa.binary())], names=["n", "ids", "labels", "orders", "points"])

    return run


def _trees(batch: pa.RecordBatch, i: int) -> Iterator[Tree]:
    n = batch.column(0)[i].as_py()
    for points in batch.column("points")[i].as_py():
        yield Tree(np.frombuffer(points, np.int32).reshape(n, -1).astype(np.int64), tree_depth(n, LEAF))


def _sum_up(entries: list[np.ndarray]):
    """Task: sums and numbers of the parts that are nearest to each entry, over all blocks of the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = [Codebook(e) for e in entries]
        sums, counts = np.zeros((len(books), *entries[0].shape), np.int64), np.zeros((len(books), len(entries[0])), np.int64)
        for batch in batches:
            for i in range(batch.num_rows):
                for part, points in enumerate(_trees(batch, i)):
                    some = block_sums(points, books[part])
                    sums[part] += some[0]
                    counts[part] += some[1]
        part, entry = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(part), pa.array(entry), pa.array(counts[part, entry]), pa.array(list(sums[part, entry]), pa.list_(pa.int64()))],
            names=["part", "entry", "n", "total"])

    return run


def _encode(entries: list[np.ndarray], names: list[str], labels: pa.DataType):
    """Task: every vector's code and squared distance."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = [Codebook(e) for e in entries]
        width = max(2, len(f"{len(entries[0]) - 1:x}"))
        for batch in batches:
            for i in range(batch.num_rows):
                n = batch.column(0)[i].as_py()
                codes, error = np.zeros((n, len(books)), np.int64), np.zeros(n, np.int64)
                orders = batch.column("orders")[i].as_py()
                for part, points in enumerate(_trees(batch, i)):
                    order, found = np.frombuffer(orders[part], np.int32), block_codes(points, books[part])
                    off = points.points - entries[part][found]
                    codes[order, part] = found
                    error[order] += (off * off).sum(axis=1)
                text = ["".join(f"{c:0{width}x}" for c in row) for row in codes.tolist()]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("ids")[i].values, pa.array(text), pa.array(error), batch.column("labels")[i].values.cast(labels)],
                    names=names)

    return run


def first_entries(rows: DataFrame, parts: int, entries: int, scale: float) -> list[np.ndarray]:
    """The parts of the vectors with the smallest keys; as many rows as a codebook has entries reach the driver."""
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "vector").limit(entries).select("vector").toArrow()
    vectors = first.column(0).combine_chunks()
    if not len(vectors):
        return []
    length = len(vectors[0])
    return np.split(whole_numbers(vectors, scale, length), parts, axis=1)


def improved(entries: list[np.ndarray], index: DataFrame) -> list[np.ndarray]:
    """The codebooks after one round: each entry becomes the floored mean of the parts nearest to it, an unused one stays."""
    partial = index.mapInArrow(_sum_up(entries), "part bigint, entry bigint, n bigint, total array<bigint>")
    places = partial.select("part", "entry", "n", F.posexplode("total").alias("place", "total"))
    sums = places.groupBy("part", "entry", "place").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
    following = [e.copy() for e in entries]
    for row in sums.collect():  # one row for each component of the codebooks
        following[row["part"]][row["entry"], row["place"]] = row["total"] // row["n"]
    return following


def compress(
    vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: float = SCALE,
    key: str = "vec_id", vector: str = "embedding", label: str = "label",
) -> tuple[DataFrame, list[np.ndarray]]:
    """(vec_id, code, error, label_error) of every usable row, and the final codebook of each part.

    Components become floor(scale * x), vectors are cut into `parts` equal parts. A codebook starts as that part of the rows
    with the smallest keys. Each round assigns every part to its nearest entry by squared distance, ties to the lower
    index, and replaces each entry by the floored mean of its parts; then all parts are assigned once more. `code` holds the
    entries' indexes in hex digits, two for each part at least; error is the squared distance from the entries, label_error
    its sum over all rows of the same label, missing labels together.

    Blocks of vectors with their trees are written once and read in every round. A round sends the codebooks to the tasks
    and gets one sum per entry and component back, so neither depends on the number of vectors.

    Rows without vector or with a missing or non-finite component take no part, nor do empty vectors and those whose length
    is not that of the row with the smallest key or can't be cut evenly. Components are limited to `bound_of`. Rows that
    repeat a key are rows of their own, the smaller vector first; a missing key comes last. With fewer rows than `entries`
    the codebooks are as short. An empty table gives an empty result. Other columns are ignored.
    """
    rows = vectors.filter(usable(vector)).select(
        F.col(key).cast("bigint").alias("vec_id"), F.col(label).alias("label"), F.col(vector).alias("vector"))
    rows = rows.filter((F.size("vector") > 0) & (F.size("vector") % parts == 0))
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "vector").select(F.size("vector")).head()
    length = first[0] if first else parts
    rows = rows.filter(F.size("vector") == length)
    books = first_entries(rows, parts, entries, scale)
    kind = rows.schema["label"].dataType
    if not books:
        return rows.select("vec_id", F.lit("").alias("code"), F.lit(0).cast("bigint").alias("error"), F.lit(0).cast("bigint").alias("label_error")), []
    arrow = rows.select("label").limit(0).toArrow().schema.field("label").type
    index = store(rows.select("vec_id", "label", "vector").mapInArrow(
        _plant(length, parts, scale, arrow),
        f"n bigint, ids array<bigint>, labels array<{kind.simpleString()}>, orders array<binary>, points array<binary>"), "trees")
    for _ in range(rounds):
        books = improved(books, index)
    codes = store(index.mapInArrow(
        _encode(books, ["vec_id", "code", "error", "label"], arrow),
        f"vec_id bigint, code string, error bigint, label {kind.simpleString()}"), "codes")
    discard(index)
    errors = store(codes.groupBy("label").agg(F.sum("error").alias("label_error")), "errors")
    of_label = errors.withColumnRenamed("label", "other")
    joined = codes.join(of_label, F.col("label").eqNullSafe(F.col("other")))
    return joined.select("vec_id", "code", "error", "label_error"), books


def digest(books: list[np.ndarray]) -> str:
    """SHA-256 of all components by part, entry and place, as decimals between commas."""
    return hashlib.sha256(",".join(str(x) for book in books for x in book.ravel().tolist()).encode()).hexdigest()


def codes_query(vectors: DataFrame) -> DataFrame:
    codes, books = compress(vectors)
    return codes.withColumn("codebooks_sha256", F.lit(digest(books)))


def _codes_sql(rounds: int) -> str:
    """Plain rounds over long tables of components."""
    steps = []
    for i in range(rounds + 1):
        steps.append(f"""
d{i} as materialized (
  select vec_id, p.part, entry, sum((v - c) * (v - c)) as far from points p join book{i} b on p.part = b.part and p.place = b.place group by all
), a{i} as materialized (
  select vec_id, part, arg_min(entry, (far, entry)) as entry, min(far) as far from d{i} group by all
)""")
        if i < rounds:
            steps.append(f"""
m{i} as (
  select a.part, a.entry, p.place, floor_div(sum(v), count(*)) as mean from a{i} a join points p on a.vec_id = p.vec_id and a.part = p.part group by all
), book{i + 1} as materialized (
  select b.part, b.entry, b.place, coalesce(mean, c)::bigint as c from book{i} b left join m{i} using (part, entry, place)
)""".replace("floor_div(sum(v), count(*))", "(sum(v) - (((sum(v) % count(*)) + count(*)) % count(*))) // count(*)"))
    return f"""
with kept as materialized (
  select vec_id, label, embedding, row_number() over (order by vec_id) - 1 as nth from embeddings
  where embedding is not null and not coalesce(list_bool_or(list_transform(embedding, lambda x: x is null or not isfinite(x))), false)
), flat as (
  select vec_id, nth, unnest(range(len(embedding))) as i, unnest(embedding) as x, len(embedding) // 4 as width from kept
), points as materialized (
  select vec_id, nth, i // width as part, i % width as place, floor(1024 * x::double)::bigint as v from flat
), book0 as materialized (
  select part, nth as entry, place, v as c from points where nth < 256
),{",".join(steps)}, coded as (
  select vec_id, string_agg(printf('%02x', entry), '' order by part) as code, sum(far)::bigint as error from a{rounds} group by vec_id
), errors as (
  select label, sum(error)::bigint as label_error from coded join kept using (vec_id) group by label
), digest as (
  select sha256(string_agg(c::varchar, ',' order by part, entry, place)) as codebooks_sha256 from book{rounds}
)
select coded.vec_id, code, error, label_error, codebooks_sha256
from coded join kept using (vec_id) join errors on kept.label is not distinct from errors.label, digest
"""


CODES_SQL = _codes_sql(ROUNDS)
