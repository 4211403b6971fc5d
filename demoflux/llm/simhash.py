"""Near-duplicates by SimHash: an inverted index of bytes at their places, and links checked by the bytes that pairs share."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, islice, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from demoflux.llm.common import discard, store
from demoflux.llm.near_dup import components
from demoflux.llm.words import BLANKS, word_pieces, word_table

SHINGLE = 3
SEED = 42
BYTES = 8  # of a fingerprint
LIMIT = 2  # differing bits of a link
SHARED = BYTES - LIMIT  # bytes that linked fingerprints share at least
POSTING = 4  # bytes that an entry of the index names
BLOCK = 2048  # fingerprints of a posting that are tallied at once; more are split by two further bytes
HOT = 256  # fingerprints that hold more than 1 / HOT of all rows
LINKS = 1 << 18  # links that are reduced at once

#: Fixed value: separators of words, in texts whose A-Z are small.
TABLE = word_table(BLANKS)


def mask_of(places: tuple[int, ...]) -> int:
    """The bytes at the given places, the first being the lowest, as a signed 64-bit number."""
    mask = sum(0xFF << (8 * p) for p in places)
    return mask - (1 << 64) if mask >> 63 else mask


PAIRS = [tuple(range(p, p + 2)) for p in range(0, BYTES, 2)]
#: Two differing bytes lie in two of the four pairs at most, so linked fingerprints share one of these six entries.
ENTRIES = [a + b for a, b in combinations(PAIRS, 2)]
#: Every choice of as many bytes as linked fingerprints share at least.
CHOICES = list(combinations(range(BYTES), SHARED))


def fingerprint(text: bytes, shingle: int = SHINGLE) -> np.uint64:
    """A bit is set if it is set in over half of the hashes of all runs of `shingle` words; a shorter text is one run."""
    from xxhash import xxh64_intdigest

    total, n, before = np.zeros(64, np.int64), 0, []
    for words in word_pieces(text, TABLE):
        words = before + words
        runs = map(b" ".join, zip(*(islice(words, i, None) for i in range(shingle))))
        hashes = np.fromiter(map(xxh64_intdigest, runs, repeat(SEED)), np.uint64)
        for begin in range(0, len(hashes), 1 << 16):
            some = hashes[begin:begin + (1 << 16)]
            total += np.unpackbits(some.view(np.uint8).reshape(-1, BYTES), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        n += len(hashes)
        before = words[-(shingle - 1):] if shingle > 1 else []
    if not n and before:
        return np.uint64(xxh64_intdigest(b" ".join(before), SEED))
    return np.packbits(2 * total > n, bitorder="little").view(np.uint64)[0]


def _fingerprints(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.zeros(batch.num_rows, np.uint64)
            for i, text in enumerate(batch.column(1)):
                buffer = text.as_buffer()
                if buffer is not None:
                    found[i] = fingerprint(buffer.to_pybytes(), shingle)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], names=["doc_id", "print"])

    return run


def smallest_links(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n places the smallest place that the links connect it with."""
    low = np.arange(n)
    while len(a):
        ends = np.minimum(low[a], low[b])
        np.minimum.at(low, low[a], ends)
        np.minimum.at(low, low[b], ends)
        while len(np.flatnonzero(low[low] != low)):
            low = low[low]
        apart = low[a] != low[b]
        a, b = a[apart], b[apart]
    return low


def tallied_links(keys: np.ndarray, prints: np.ndarray) -> np.ndarray:
    """For sorted keys the place of the smallest print of each connected group in a posting.

    Neighbours at a distance of one, two, ... places are compared in all postings at once. A pair's shared bytes are
    tallied, pairs that share fewer than linked ones must are dropped, and the rest are checked by their bits.
    """
    n = len(keys)
    low, a, b, waiting = np.arange(n), [], [], 0
    octets = prints.view(np.uint8).reshape(n, BYTES)
    left = np.arange(n - 1)
    for step in range(1, n):
        left = left[left < n - step]
        left = left[keys[left] == keys[left + step]]
        if not len(left):
            break
        shared = np.zeros(len(left), np.int8)
        for place in range(BYTES):
            shared += octets[left, place] == octets[left + step, place]
        near = left[shared >= SHARED]
        near = near[np.bitwise_count(prints[near] ^ prints[near + step]) <= LIMIT]
        a.append(near)
        b.append(near + step)
        waiting += len(near)
        if waiting > LINKS:
            low = smallest_links(n, np.concatenate([np.arange(n), *a]), np.concatenate([low, *b]))
            a, b, waiting = [], [], 0
    return smallest_links(n, np.concatenate([np.arange(n), *a]), np.concatenate([low, *b]))


def flipped_links(prints: np.ndarray) -> np.ndarray:
    """As `tallied_links` for one posting of six equal bytes: the free bytes have 65,536 values, so each print looks its neighbours up."""
    octets = prints.view(np.uint8).reshape(-1, BYTES)
    free = np.argsort((octets != octets[0]).any(axis=0), kind="stable")[SHARED:]
    value = octets[:, free[0]].astype(np.int64) | octets[:, free[1]].astype(np.int64) << 8
    at = np.full(1 << 16, -1)
    at[value] = np.arange(len(prints))
    low = np.arange(len(prints))
    bits = [1 << i for i in range(16)]
    for flip in [*bits, *(x | y for x, y in combinations(bits, 2))]:
        other = at[value ^ flip]
        mine = np.flatnonzero(other >= 0)
        low = smallest_links(len(prints), np.concatenate([np.arange(len(prints)), mine]), np.concatenate([low, other[mine]]))
    return low


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Task: links within postings, from rows (entry, octets, print) sorted by entry and octets, one to the smallest print of each group."""

    def linked(table: pa.Table) -> pa.RecordBatch:
        entry, octets, prints = (table.column(i).to_numpy() for i in range(3))
        prints = prints.view(np.uint64)
        new = np.append(True, (entry[1:] != entry[:-1]) | (octets[1:] != octets[:-1]))
        posting = np.cumsum(new) - 1
        sizes = np.bincount(posting)
        large = sizes > BLOCK
        low = np.arange(len(prints))
        rows = np.flatnonzero(~large[posting] & (sizes[posting] > 1))
        if len(rows):
            low[rows] = rows[tallied_links(posting[rows], prints[rows])]
        for begin in np.flatnonzero(new)[large]:
            end = begin + sizes[posting[begin]]
            low[begin:end] = begin + flipped_links(prints[begin:end])
        linked = np.flatnonzero(low != np.arange(len(low)))
        signed = prints.view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(signed[low[linked]]), pa.array(signed[linked])], names=["a", "b"])

    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        entry, octets = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        # the last posting may go on in the next batch
        same = (entry == entry[-1]) & (octets == octets[-1])
        cut = int(np.argmax(same))
        if held and (cut > 0 or (held[-1].column(0)[0].as_py(), held[-1].column(1)[0].as_py()) != (entry[-1], octets[-1])):
            yield linked(pa.Table.from_batches([*held, batch.slice(0, cut)]))
            held = []
        elif cut:
            yield linked(pa.Table.from_batches([batch.slice(0, cut)]))
        held.append(batch.slice(cut))
    if held:
        yield linked(pa.Table.from_batches(held))


def index_of(prints: DataFrame, choices: list[tuple[int, ...]], among: str | None = None) -> DataFrame:
    """(entry, octets, print): each fingerprint under every choice of places, with its bytes there.

    `among` names a column with the places (as a mask) that a choice must contain.
    """
    masks = F.array(*[F.struct(F.lit(i).alias("entry"), F.lit(mask_of(c)).cast("bigint").alias("mask")) for i, c in enumerate(choices)])
    if among:
        masks = F.filter(masks, lambda m: m["mask"].bitwiseAND(F.col(among)) == F.col(among))
    placed = prints.withColumn("at", F.explode(masks))
    return placed.select("at.entry", F.col("print").bitwiseAND(F.col("at.mask")).alias("octets"), "print")


def links_of(prints: DataFrame, block: int = BLOCK) -> DataFrame:
    """Links (a, b) that connect exactly the distinct fingerprints (print) which differences of `LIMIT` bits connect.

    An entry of the index names four bytes and their places; six entries are enough for any two linked fingerprints to share one.
    Within a posting the bytes shared by each pair are tallied, no pair is written, and one link leads from each
    fingerprint to its group's smallest. A posting with more than `block` fingerprints is split: its members are entered again
    by six bytes, the number that linked fingerprints must share, so no posting can exceed 65,536.
    """
    index = index_of(prints, ENTRIES)
    large = store(index.groupBy("entry", "octets").count().filter(F.col("count") > block).select("entry", "octets"), "large")
    usual = index.join(large, ["entry", "octets"], "left_anti")
    masks = F.create_map(*[F.lit(x) for i, c in enumerate(ENTRIES) for x in (i, mask_of(c))])
    crowded = index.join(large, ["entry", "octets"], "left_semi").select("print", masks[F.col("entry")].alias("within"))
    split = index_of(crowded, CHOICES, "within").distinct().withColumn("entry", F.col("entry") + len(ENTRIES))
    dealt = usual.unionAll(split).repartition("entry", "octets").sortWithinPartitions("entry", "octets", "print")
    return dealt.mapInArrow(_postings, "a bigint, b bigint")


def simhash_duplicates(docs: DataFrame, shingle: int = SHINGLE, block: int = BLOCK) -> DataFrame:
    """(doc_id, print, component_id) for every row of `docs` (doc_id, text).

    The fingerprint of a text has a bit set if it is set in over half the XXH64 hashes (seed 42) of its runs of
    `shingle` words, repeats included, in small letters A-Z. Texts are linked if their fingerprints differ in two bits at most; component_id is
    the smallest doc_id that links lead to. Only distinct fingerprints enter the index, so copies cost nothing there.

    A missing or empty text has the fingerprint 0 and is linked like any other. A text with fewer words is one run. Repeated rows share a
    component. Rows without doc_id take part, but are no component's smallest; with none in it component_id is NULL. An
    empty table gives an empty result. Other columns are ignored.
    """
    rows = store(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(
        _fingerprints(shingle), "doc_id bigint, print bigint"), "prints")
    nodes = store(rows.groupBy("print").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("n")), "nodes")
    links = store(links_of(nodes.select("print"), block).distinct(), "links")
    classes = components(links)
    named = nodes.join(classes.withColumnRenamed("node", "print"), "print", "left").select(
        "print", "doc_id", "n", F.coalesce("class", "print").alias("class"))
    names = named.groupBy("class").agg(F.min("doc_id").alias("component_id"))
    found = store(named.join(names, "class").select("print", "n", "component_id"), "named")
    discard(links, classes)
    # a fingerprint with many rows is looked up in a table of at most HOT rows, so its rows stay where they are
    least = rows.count() / HOT
    hot = F.broadcast(found.filter(F.col("n") > least).select("print", F.struct("component_id").alias("known")))
    looked = rows.join(hot, "print", "left")
    usual = looked.filter("known is null").select("doc_id", "print").join(found.filter(F.col("n") <= least).drop("n"), "print")
    return usual.select("doc_id", "print", "component_id").unionAll(
        looked.filter("known is not null").select("doc_id", "print", "known.component_id"))


def simhash_query(docs: DataFrame) -> DataFrame:
    return simhash_duplicates(docs).select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")
