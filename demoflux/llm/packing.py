"""Packing tokenized documents into sequences of fixed length, shortest pack first, over the length histogram."""

from __future__ import annotations

import json
import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from demoflux.llm.common import store, tasks

#: Fixed value: the pattern by which byte-level vocabularies split a text into words.
WORDS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
PIECES = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint"


def byte_values() -> dict[str, int]:
    """Byte-level vocabularies write each byte as a printable character: itself, or the next free one from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


def encoder(vocabulary: str) -> Callable[[str], bytes]:
    """A function from a text to its token ids, as little-endian unsigned 32-bit numbers.

    The ids are those of the `tokenizers` file. Where its merges are listed in the order of their ids, a merge's
    rank is its id, so `tiktoken` gives the same ids from the same vocabulary in a quarter of the time. Texts
    that hold a special token, and vocabularies of another kind, are encoded by `tokenizers`.
    """
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(vocabulary)
    special = [t.content for t in tokenizer.get_added_tokens_decoder().values()]

    def plain(text: str) -> bytes:
        return np.array(tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    described = json.loads(tokenizer.to_str())
    model, before = described["model"], described["pre_tokenizer"] or {}
    merges = [m if isinstance(m, list) else m.split(" ") for m in model.get("merges", [])]
    vocab = {t: i for t, i in model.get("vocab", {}).items() if t not in special}
    byte_level = (before.get("type"), before.get("add_prefix_space"), before.get("use_regex")) == ("ByteLevel", False, True)
    if not byte_level or described["normalizer"] or len(vocab) != 256 + len(merges) or any(
            vocab.get(a + b) != 256 + i for i, (a, b) in enumerate(merges)):
        return plain

    import tiktoken

    values = byte_values()
    ranks = {bytes(values[c] for c in t): i for t, i in vocab.items()}
    fast = tiktoken.Encoding("vocabulary", pat_str=WORDS, mergeable_ranks=ranks, special_tokens={})

    def encode(text: str) -> bytes:
        if any(s in text for s in special):
            return plain(text)
        return fast.encode_to_numpy(text, disallowed_special=()).astype("<u4").tobytes()

    return encode


def _cut(vocabulary: str, limit: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary)
        for batch in batches:
            out: list[tuple] = []
            for doc_id, text in zip(batch.column(0), batch.column(1)):
                data = encode(text.as_py() or "") + end_id.to_bytes(4, "little")
                total = len(data) // 4
                key = doc_id.as_py()
                for start in range(0, total, limit):
                    part = data[4 * start:4 * (start + limit)]
                    out.append((key, start, len(part) // 4, zlib.crc32(part), total))
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[i] for r in out], pa.int64()) for i in range(5)],
                names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return run


def cut_documents(docs: DataFrame, vocabulary: str, limit: int = 1024, end_id: int = 0) -> DataFrame:
    """Token ids of every whole text and an end id, cut after every `limit` ids. One row per piece."""
    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(_cut(vocabulary, limit, end_id), PIECES)


def pack_histogram(histogram: Mapping[int, int], limit: int) -> list[tuple[tuple[int, ...], int]]:
    """Packing patterns and how often each is used.

    Lengths are placed from the longest to the shortest. As many pieces of a length as possible go, one
    each, to the shortest packs, that is those with the most room, if they fit there; the rest
    start packs of their own. Packs of one pattern are counted, not listed, so the work depends on
    the number of lengths alone.
    """
    by_total: dict[int, list[list]] = defaultdict(list)
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            total = min((t for t, packs in by_total.items() if packs), default=limit)
            if total + length > limit:
                by_total[length].append([(length,), left])
                break
            pattern, count = by_total[total].pop()
            used = min(left, count)
            if used < count:
                by_total[total].append([pattern, count - used])
            by_total[total + length].append([(*pattern, length), used])
            left -= used
    return [(tuple(p), n) for total in sorted(by_total) for p, n in by_total[total]]


def slots(patterns: list[tuple[tuple[int, ...], int]]) -> dict[int, list[tuple[int, int, int]]]:
    """For each length, by rising rank: (first rank, first sequence, offset) of the places that patterns have for it."""
    places: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
    given: dict[int, int] = defaultdict(int)
    sequence = 0
    for pattern, count in patterns:
        offset = 0
        for length in pattern:
            places[length].append((given[length], sequence, offset))
            given[length] += count
            offset += length
        sequence += count
    return places


def pack(pieces: DataFrame, limit: int = 1024, key: str = "doc_id") -> DataFrame:
    """The pieces with `sequence_id` and `offset`, packed into sequences of at most `limit`.

    Only the histogram of lengths, at most `limit` rows, reaches the driver; the places go back as a table
    of as many rows, which is the one that is broadcast. A piece finds its place by its rank among those
    of its length. Ranks are counted in many small groups by a hash of the key, with the group
    sums added, so a length that a third of all pieces share is still ranked by many tasks. Repeated
    rows are packed each; an empty table gives an empty result. Columns named like the results are replaced.
    """
    spark = pieces.sparkSession
    pieces = store(pieces.drop("sequence_id", "offset"), "pieces")
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    places = slots(pack_histogram(histogram, limit))
    table = spark.createDataFrame(
        [(length, *map(list, zip(*rows))) for length, rows in places.items()],
        "length bigint, ranks array<bigint>, sequences array<bigint>, offsets array<bigint>")
    grouped = pieces.withColumn("__group", F.pmod(F.xxhash64(key, "start"), F.lit(4 * tasks(spark))))
    sums = grouped.groupBy("length", "__group").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("__group").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("length", "__group", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__before"))
    own = Window.partitionBy("length", "__group").orderBy(key, "start")
    ranked = grouped.withColumn("__own", F.row_number().over(own) - 1).join(sums, ["length", "__group"])
    ranked = ranked.withColumn("__rank", F.col("__before") + F.col("__own")).join(F.broadcast(table), "length")
    at = F.size(F.filter("ranks", lambda r: r <= F.col("__rank")))
    return ranked.withColumn("__at", at).select(
        *[F.col(c) for c in pieces.columns],
        (F.element_at("sequences", F.col("__at")) + F.col("__rank") - F.element_at("ranks", F.col("__at"))).alias("sequence_id"),
        F.element_at("offsets", F.col("__at")).alias("offset"))


def packing_query(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """A missing text is empty, so its document has the end id alone."""
    if vocabulary is None:
        import public_tokenizers

        vocabulary = public_tokenizers.path("byte_bpe_50k.json")
    return pack(cut_documents(docs, vocabulary))
