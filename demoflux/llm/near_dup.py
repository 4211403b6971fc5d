"""Near-duplicates by weighted MinHash: hashed darts, banded buckets, checked links, classes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from demoflux.llm.common import discard, release, store, tasks

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 32, 4
DOUBT = 0.2  # by how much a signature of 128 coordinates may fall short; over five standard deviations at 0.8
CACHED_WORDS = 300_000
CELLS_AT_ONCE = 50_000
BLOCK = 1024  # members of a bucket that meet at once
BEST_ROUNDS = 2  # rounds in which outsiders are checked against their best partner

_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))  # odd multipliers


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit numbers over all bits."""
    x = (x ^ (x >> np.uint64(30))) * _B
    x = (x ^ (x >> np.uint64(27))) * _C
    return x ^ (x >> np.uint64(31))


def unit(x: np.ndarray) -> np.ndarray:
    """Numbers in (0, 1] from the upper bits."""
    return ((x >> np.uint64(11)).astype(np.float64) + 1.0) / float(1 << 53)


def shingles(words: np.ndarray, size: int = SHINGLE) -> np.ndarray:
    """Hashes of all runs of `size` words, given the words' hashes; a shorter text has one, of all its words."""
    size = min(size, len(words))
    if not size:
        return np.zeros(0, np.uint64)
    n = len(words) - size + 1
    total = np.zeros(n, np.uint64)
    for i in range(size):
        total = total * _A + words[i:i + n]
    return mixed(total)


def weighted(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    elements, counts = np.unique(hashes, return_counts=True)
    return elements, counts.astype(float)


def unit_cells(elements: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each element's weight cut into cells of one: hashes that are equal for equal (element, number), and the filled part."""
    parts = np.ceil(weights).astype(np.int64)
    owner = np.repeat(np.arange(len(elements)), parts)
    number = np.arange(len(owner)) - np.repeat(np.cumsum(parts) - parts, parts)
    return mixed(elements[owner] + (number.astype(np.uint64) + np.uint64(1)) * _A), np.minimum(1.0, weights[owner] - number)


def dart_signatures(texts: list[tuple[np.ndarray, np.ndarray]], size: int) -> np.ndarray:
    """Weighted MinHash signatures, one row per text, each given as (elements, weights).

    Coordinates of two texts agree with the probability of their weighted Jaccard similarity. Darts fall on the plane of
    weight and rank over every element, one per unit of area, at places that a hash fixes for all texts alike. A text owns
    the darts below its weight. Each dart belongs to one coordinate, which keeps the dart of the earliest rank. Ranks are
    looked at up to a limit that gives size * (ln(size) + 3) darts whatever the text's length, so a long text has few
    darts per element; for texts where a coordinate stays empty, the limit is doubled.
    """
    signatures = np.zeros((len(texts), size), np.uint64)
    parts = [unit_cells(*t) for t in texts]
    limits = np.array([size * (np.log(size) + 3) / t[1].sum() for t in texts])
    todo = np.arange(len(texts))
    while len(todo):
        seed = np.concatenate([parts[i][0] for i in todo])
        part = np.concatenate([parts[i][1] for i in todo])
        owner = np.repeat(np.arange(len(todo)), [len(parts[i][0]) for i in todo])
        limit = limits[todo][owner]
        rank = np.zeros(len(seed))
        found = []
        while len(seed):
            seed = mixed(seed + _A)
            rank = rank - np.log(unit(seed))
            near = rank <= limit
            seed, part, rank, owner, limit = seed[near], part[near], rank[near], owner[near], limit[near]
            dart = mixed(seed ^ _C)
            owned = unit(mixed(dart + _B)) <= part
            found.append((rank[owned], owner[owned] * size + (dart[owned] % np.uint64(size)).astype(np.int64), dart[owned]))
        rank, place, dart = (np.concatenate(c) for c in zip(*found))
        last_wins = np.argsort(-rank, kind="stable")
        place, dart = place[last_wins], dart[last_wins]
        rows, given = np.zeros(len(todo) * size, np.uint64), np.zeros(len(todo) * size, bool)
        rows[place] = dart
        given[place] = True
        full = given.reshape(-1, size).all(axis=1)
        signatures[todo[full]] = rows.reshape(-1, size)[full]
        todo = todo[~full]
        limits[todo] *= 2
    return signatures


def band_hashes(signatures: np.ndarray, bands: int, rows: int) -> np.ndarray:
    total = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) * _B, (len(signatures), bands))
    cut = signatures.reshape(len(signatures), bands, rows)
    for i in range(rows):
        total = mixed(total * _A + cut[:, :, i])
    return total.view(np.int64)


class WordHashes:
    """64-bit hashes of a text's words in lower case, each word hashed once."""

    def __init__(self):
        from xxhash import xxh3_64_intdigest

        self.digest, self.known = xxh3_64_intdigest, {}

    def __call__(self, text: str) -> np.ndarray:
        words = text.lower().split()
        new = set(words).difference(self.known)
        if len(self.known) + len(new) > CACHED_WORDS:
            self.known.clear()
            new = set(words)
        self.known.update((w, self.digest(w)) for w in new)
        known = self.known
        return np.array([known[w] for w in words], np.uint64)


def text_hash(words: np.ndarray) -> int:
    """A hash of the word sequence; 0 for none."""
    if not len(words):
        return 0
    from xxhash import xxh3_64_intdigest

    code = xxh3_64_intdigest(words.tobytes()) or 1
    return code - (1 << 64) if code >> 63 else code


def _sketch(shingle: int, bands: int, rows: int):
    def sketched(codes: list[int], texts: list, keys: list, ids: list) -> pa.RecordBatch:
        filled = [i for i, t in enumerate(texts) if t is not None]
        signatures = dart_signatures([texts[i] for i in filled], bands * rows)
        buckets, short = [None] * len(texts), [None] * len(texts)
        cut = signatures >> np.uint64(48)
        for i, b, c in zip(filled, band_hashes(cut, bands, rows), cut.astype(np.uint16)):
            buckets[i], short[i] = b, c.tobytes()
        return pa.RecordBatch.from_arrays(
            [pa.array(keys, pa.int64()), pa.array(ids, pa.int64()), pa.array(codes, pa.int64()),
             pa.array(buckets, pa.list_(pa.int64())), pa.array(short, pa.binary())],
            names=["row", "doc_id", "node", "bands", "signature"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            waiting, held = ([], [], [], []), 0
            for row, text, doc_id in zip(*batch.columns):
                words = hashes(text.as_py() or "")
                held += len(words)
                values = text_hash(words), weighted(shingles(words, shingle)) if len(words) else None, row.as_py(), doc_id.as_py()
                for column, value in zip(waiting, values):
                    column.append(value)
                if held >= CELLS_AT_ONCE:
                    yield sketched(*waiting)
                    waiting, held = ([], [], [], []), 0
            if waiting[0]:
                yield sketched(*waiting)

    return run


def _cells(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            rows = [
                unit_cells(*weighted(shingles(hashes(text.as_py() or ""), shingle)))[0].view(np.int64) for text in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.int64()))], names=["node", "payload"])

    return run


def _agreement(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Share of equal signature coordinates of each pair."""
    for batch in batches:
        one, two = (
            np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint16).reshape(batch.num_rows, -1) if batch.num_rows else
            np.zeros((0, 1)) for i in (2, 3))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array((one == two).mean(axis=1), pa.float64())], names=["a", "b", "estimate"])


def components(links: DataFrame) -> DataFrame:
    """(node, class) of every node that has links (a, b): the smallest node that they connect it with.

    Every round each node takes the smallest class among its neighbours, and then the class of that class, so
    long chains halve. What a hot node receives is combined before the shuffle.
    """
    both = store(links.select("a", "b").unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    state = store(both.select(F.col("a").alias("node")).distinct().withColumn("class", F.col("node")), "classes")
    while True:
        heard = both.join(state, both["b"] == state["node"]).groupBy("a").agg(F.min("class").alias("heard"))
        nearer = state.join(heard, state["node"] == heard["a"], "left").select(
            "node", F.col("class").alias("old"), F.least("class", "heard").alias("class"))
        lookup = state.select(F.col("node").alias("class"), F.col("class").alias("root"))
        jumped = nearer.join(lookup, "class", "left").select(
            "node", "old", F.least("class", F.coalesce("root", "class")).alias("class"))
        following = store(jumped, "classes")
        changed = following.filter("class <> old").limit(1).count()
        discard(state)
        state = following.select("node", "class")
        state.stored_at = following.stored_at
        if not changed:
            discard(both)
            return state


def united(classes: DataFrame, links: DataFrame) -> DataFrame:
    """The classes (node, class) after further links: those that the links connect become the smallest of them.

    Only links between different classes are followed, as links of the classes themselves.
    """
    ends = classes.select(F.col("node").alias("a"), F.col("class").alias("low")), classes.select(
        F.col("node").alias("b"), F.col("class").alias("high"))
    between = store(links.select("a", "b").join(ends[0], "a").join(ends[1], "b").filter("low <> high").select(
        F.col("low").alias("a"), F.col("high").alias("b")).distinct(), "between")
    roots = components(between).select(F.col("node").alias("class"), F.col("class").alias("root"))
    found = store(classes.join(roots, "class", "left").select("node", F.coalesce("root", "class").alias("class")), "classes")
    discard(between)
    return found


def estimated(pairs: DataFrame, sketches: DataFrame) -> DataFrame:
    """Pairs (a, b) with the share of signature coordinates in which they agree."""
    signatures = sketches.select("node", "signature")
    one = pairs.join(signatures.select(F.col("node").alias("b"), F.col("signature").alias("second")), "b")
    both = one.join(signatures.select(F.col("node").alias("a"), F.col("signature").alias("first")), "a")
    return both.select("a", "b", "first", "second").mapInArrow(_agreement, "a bigint, b bigint, estimate double")


def similar(pairs: DataFrame, texts: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """Pairs (a, b) whose exact weighted Jaccard similarity of shingles reaches the limit."""
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    cells = store(texts.join(wanted, "node", "left_semi").select("node", "text").mapInArrow(
        _cells(shingle), "node bigint, payload array<bigint>"), "cells")
    one = pairs.select("a", "b").join(cells.select(F.col("node").alias("b"), F.col("payload").alias("second")), "b")
    both = one.join(cells.select(F.col("node").alias("a"), F.col("payload").alias("first")), "a")
    shared = F.size(F.array_intersect("first", "second"))
    found = store(both.filter(
        shared >= F.lit(similarity) * (F.size("first") + F.size("second") - shared)).select("a", "b"), "similar")
    discard(cells)
    return found


def by_block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each block, from batches that are sorted by block. A block's size is bounded."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        keys = batch.column(0).to_numpy()
        cuts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else []
        for begin, end in zip(cuts, [*cuts[1:], len(keys)]):
            if held and held[0].column(0)[0].as_py() != keys[begin]:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(begin, end - begin))
    if held:
        yield pa.Table.from_batches(held)


def first_meetings(rows: pa.Table, bands: int) -> tuple[np.ndarray, ...]:
    """A block's members (node, class, signature), the places of its outsiders and of its members inside, and which of
    them are pairs of two classes that share no earlier band, so that each pair is looked at in one bucket only."""
    nodes, classes, outside, inside = (rows.column(i).to_numpy() for i in range(1, 5))
    signatures = np.frombuffer(b"".join(rows.column("signature").to_pylist()), np.uint16).reshape(len(nodes), -1)
    hashes = band_hashes(signatures.astype(np.uint64), bands, signatures.shape[1] // bands)
    ours, theirs = np.flatnonzero(outside), np.flatnonzero(inside)
    earlier = np.flatnonzero(hashes[0] == rows.column("bucket")[0].as_py())[0]
    fresh = classes[ours][:, None] != classes[theirs][None, :]
    for band in range(earlier):
        fresh &= hashes[ours, band][:, None] != hashes[theirs, band][None, :]
    return nodes, classes, signatures, ours, theirs, fresh


def _likely(least: float, bands: int):
    """Task: each outsider's best partner of another class among those it meets in a block, if they agree enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in by_block(batches):
            nodes, _, signatures, ours, theirs, fresh = first_meetings(rows, bands)
            bucket = rows.column("bucket")[0].as_py()
            asking = np.flatnonzero(fresh.any(axis=1))
            for i in range(0, len(asking), 64):
                some = asking[i:i + 64]
                x, y = np.nonzero(fresh[some])
                agree = np.zeros((len(some), len(theirs)))
                agree[x, y] = (signatures[ours[some[x]]] == signatures[theirs[y]]).mean(axis=1)
                estimate, best = agree.max(axis=1), theirs[agree.argmax(axis=1)]
                found = estimate >= least
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(found.sum(), bucket)), pa.array(nodes[ours[some[found]]]), pa.array(nodes[best[found]]),
                     pa.array(estimate[found])], names=["bucket", "node", "other", "estimate"])

    return run


def _linked(similarity: float, bands: int):
    """Task: of each outsider in a block the links to other classes, one for each class, by whole shingles.

    Shared shingles are counted for a few outsiders at a time, from the sorted shingles of the members they meet.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in by_block(batches):
            nodes, classes, _, ours, theirs, fresh = first_meetings(rows, bands)
            asking, asked = fresh.any(axis=1), fresh.any(axis=0)
            if not asking.any():
                continue
            ours, theirs, fresh = ours[asking], theirs[asked], fresh[asking][:, asked]
            cells = [np.asarray(c.values) for c in rows.column("cells")]
            sizes = np.array([len(c) for c in cells])
            have = np.concatenate([cells[i] for i in theirs])
            holder = np.repeat(np.arange(len(theirs)), sizes[theirs])
            order = np.argsort(have, kind="stable")
            have, holder = have[order], holder[order]
            for i in range(0, len(ours), 16):
                some = ours[i:i + 16]
                wanted = np.concatenate([cells[j] for j in some])
                asker = np.repeat(np.arange(len(some)), sizes[some])
                low = np.searchsorted(have, wanted, "left")
                n = np.searchsorted(have, wanted, "right") - low
                at = np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())
                shared = np.bincount(np.repeat(asker, n) * len(theirs) + holder[at], minlength=len(some) * len(theirs))
                shared = shared.reshape(len(some), len(theirs))
                whole = sizes[some][:, None] + sizes[theirs][None, :] - shared
                x, y = np.nonzero((shared >= similarity * whole) & fresh[i:i + 16])
                _, first = np.unique(np.stack([x, classes[theirs[y]]]), axis=1, return_index=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(nodes[some[x[first]]]), pa.array(nodes[theirs[y[first]]])], names=["a", "b"])

    return run


def in_blocks(members: DataFrame, classes: DataFrame, payload: DataFrame) -> DataFrame:
    """(block, node, class, outside, inside, bucket) and the columns of `payload`, sorted by block: where members outside the class that most
    members of their bucket have, the outsiders, meet all members of the bucket.

    Of two members of different classes, one at least is an outsider. Large buckets are cut into blocks of bounded size,
    one for every slice of outsiders and every slice of members. Buckets of one class have nothing left to compare.
    """
    spark = members.sparkSession
    placed = members.select("bucket", "node").join(classes, "node")
    shares = placed.groupBy("bucket", "class").agg(F.count("*").alias("n"))
    sizes = shares.groupBy("bucket").agg(
        F.max_by("class", F.struct("n", "class")).alias("own"), F.sum("n").alias("n"),
        (F.sum("n") - F.max("n")).alias("n_out")).filter("n_out > 0")
    placed = placed.join(sizes, "bucket").withColumn("outside", F.col("class") != F.col("own")).join(payload, "node")
    rows, columns = F.ceil(F.col("n_out") / BLOCK), F.ceil(F.col("n") / BLOCK)
    spread = F.xxhash64("node")
    # a member stands in one column of blocks, an outsider in one row of blocks as well
    own_row, own_column = F.pmod(spread, rows), F.pmod(spread, columns)
    as_member = F.transform(F.sequence(F.lit(0), rows - 1), lambda r: F.struct(
        r.alias("r"), own_column.alias("c"), (F.col("outside") & (r == own_row)).alias("out"), F.lit(True).alias("in")))
    as_outsider = F.when(F.col("outside"), F.transform(F.sequence(F.lit(0), columns - 1), lambda c: F.struct(
        own_row.alias("r"), c.alias("c"), F.lit(True).alias("out"), F.lit(False).alias("in")))).otherwise(
        F.array().cast("array<struct<r:bigint,c:bigint,out:boolean,in:boolean>>"))
    # where row and column of an outsider cross, it stands once, as both
    cells = F.concat(as_member, F.filter(as_outsider, lambda x: x["c"] != own_column))
    dealt = placed.withColumn("cell", F.explode(cells)).select(
        F.xxhash64("bucket", "cell.r", "cell.c").alias("block"), "node", "class", F.col("cell.out").alias("outside"),
        F.col("cell.in").alias("inside"), "bucket", *[c for c in payload.columns if c != "node"])
    return dealt.repartition(tasks(spark), "block").sortWithinPartitions("block")


def near_duplicates(
    docs: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS,
) -> DataFrame:
    """(doc_id, class_id, class, row) for every row of `docs` (doc_id, text).

    class_id is the smallest doc_id of the row's class; class names the class and row the row by hashes.

    Two texts are linked if the weighted Jaccard similarity of their shingles (runs of words in lower case,
    weighted by how often they occur) is at least `similarity`; classes are what links connect. Texts of
    equal words are one node from the start. Candidates share one of `bands` bands of the signature, and
    every link is checked on the texts' whole shingles. With 32 bands of 4, a pair at 0.8 shares no band
    in 5 of 100 million cases; its signatures agree in less than 0.6, below which pairs are not checked, in 8 of 100
    million, a pair at 0.85 in 2 of a trillion.

    A bucket never gives all its pairs. First its members meet its smallest node, the leader, which joins a group of copies
    of any size to one class. Then members outside the bucket's most frequent class meet the bucket's members, in blocks
    of bounded size and by their signatures, each pair in the first bucket it shares. Of the likely pairs, each outsider's
    best is checked first, then the best with each class, and at last all that still connect different classes. So each
    pair that shares a band is in one class or has been looked at, while a large group needs few checks.

    A missing or empty text is a class of its own: class is NULL and class_id the row's doc_id. Repeated rows
    share a class. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    # rows are told apart by a hash of doc_id and text, since a doc_id may be missing or repeated
    keyed = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text")).withColumn("row", F.xxhash64("doc_id", "text"))
    sketches = store(keyed.select("row", "text", "doc_id").mapInArrow(
        _sketch(shingle, bands, rows), "row bigint, doc_id bigint, node bigint, bands array<bigint>, signature binary"), "sketches")
    nodes = store(sketches.filter("node <> 0").groupBy("node").agg(
        F.first("bands").alias("bands"), F.first("signature").alias("signature"), F.min("row").alias("row"),
        F.min("doc_id").alias("doc_id")), "nodes")
    release(spark)
    in_bucket = nodes.select("node", F.explode("bands").alias("bucket"))
    leaders = in_bucket.groupBy("bucket").agg(F.min("node").alias("leader"), F.count("*").alias("members")).filter("members > 1")
    members = store(in_bucket.join(leaders, "bucket"), "members")
    release(spark)
    texts = keyed.select("row", "text").join(nodes.select("row", "node"), "row").select("node", "text")

    met = members.filter("node <> leader").select(F.col("leader").alias("a"), F.col("node").alias("b")).distinct()
    likely = store(estimated(met, nodes).filter(F.col("estimate") >= similarity - DOUBT).select("a", "b"), "likely")
    links = similar(likely, texts, shingle, similarity)
    release(spark)
    alone = members.select("node").distinct().withColumn("class", F.col("node"))
    classes = united(alone, links)
    members = members.filter("members > 2")
    signatures = nodes.select("node", "signature")
    for _ in range(BEST_ROUNDS):
        near = store(in_blocks(members, classes, signatures).mapInArrow(
            _likely(similarity - DOUBT, bands), "bucket bigint, node bigint, other bigint, estimate double"), "near")
        best = near.groupBy("node").agg(F.max_by("other", F.struct("estimate", "other")).alias("other"))
        fresh = best.select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).distinct()
        fresh = store(fresh.join(likely, ["a", "b"], "left_anti"), "fresh")
        release(spark)
        if fresh.isEmpty():
            break
        likely = likely.unionAll(fresh)
        classes = united(classes, similar(fresh, texts, shingle, similarity))
        release(spark)
    # what is still apart is compared by whole shingles, without making pairs
    still = members.join(near.select("bucket").distinct(), "bucket", "left_semi")
    cells = store(texts.join(still, "node", "left_semi").select("node", "text").mapInArrow(
        _cells(shingle), "node bigint, payload array<bigint>"), "cells")
    whole = signatures.join(cells.withColumnRenamed("payload", "cells"), "node")
    last = store(in_blocks(still, classes, whole).mapInArrow(_linked(similarity, bands), "a bigint, b bigint"), "last")
    discard(cells)
    if not last.isEmpty():
        classes = united(classes, last)
        release(spark)
    named = nodes.select("node", "doc_id").join(classes, "node", "left").select(
        "node", "doc_id", F.coalesce("class", "node").alias("class"))
    names = named.groupBy("class").agg(F.min("doc_id").alias("class_id"))
    by_node = named.select("node", "class").join(names, "class")
    return sketches.select("row", "doc_id", "node").join(by_node, "node", "left").select(
        "row", "doc_id", "class", F.coalesce("class_id", "doc_id").alias("class_id"))


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of `docs`, with all their columns, less all but one of each class of near-duplicates.

    The row with the smallest doc_id stays, or the smallest hash of doc_id and text. Empty texts stay. Of rows that repeat
    a doc_id with the same text one stays.
    """
    found = near_duplicates(docs)
    first = found.filter("class is not null").groupBy("class").agg(F.min("doc_id").alias("doc_id"))
    of_first = found.join(first.withColumnRenamed("doc_id", "first_id"), "class").filter(F.col("doc_id").eqNullSafe(F.col("first_id")))
    kept = of_first.groupBy("class").agg(F.min("row").alias("__row")).select("__row").unionAll(
        found.filter("class is null").select("row")).distinct()
    keyed = docs.withColumn("__row", F.xxhash64(F.col("doc_id").cast("bigint"), F.col("text")))
    return keyed.join(kept, "__row", "left_semi").dropDuplicates(["__row"]).select(*docs.columns)


def near_dup_query(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs).select("doc_id", "class_id")


NEAR_DUP_SQL = r"""
with recursive t as (
  select doc_id, regexp_extract_all(lower(coalesce(text, '')), '[^\x09-\x0D\x1C-\x20\x{85}\p{Z}]+') as words from documents),
n as (select min(doc_id) as node, words from t where len(words) > 0 group by words),
c as (
  select node, shingle, count(*) as n
  from (select node, unnest(list_transform(range(1, greatest(len(words) - 4, 1) + 1), lambda i: array_to_string(words[i:i + 4], ' '))) as shingle from n)
  group by node, shingle),
z as (select node, sum(n) as size from c group by node),
m as (
  select a.node as one, b.node as two, sum(least(a.n, b.n)) as common
  from c a join c b on a.shingle = b.shingle and a.node < b.node group by a.node, b.node),
l as (
  select one, two from m join z x on x.node = one join z y on y.node = two
  where 5 * common >= 4 * (x.size + y.size - common)),
e as (select one, two from l union all select two, one from l),
r as (select node, node as other from n union select r.node, e.two from r join e on e.one = r.other),
k as (select node, min(other) as class_id from r group by node)
select t.doc_id, coalesce(k.class_id, t.doc_id) as class_id
from t left join n on t.words = n.words left join k using (node)
"""
