"""Repeated passages across texts, by a sparse suffix array that is sorted in ranges."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from demoflux.llm.common import release, store, tasks

LENGTH = 200  # bytes of a passage that count as a repeat
ANCHOR = 100  # bytes of the strings by which passages are found
SEGMENT = (1 << 20) - 4096  # places that are hashed at once

BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
#: One random odd 64-bit number per byte value, from a fixed seed.
BYTE_CODES = np.random.default_rng(200).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class Fingerprints:
    """64-bit fingerprints of any stretches of a text, from prefix sums of byte codes times powers."""

    powers = np.ones(1, np.uint64)
    inverses = np.ones(1, np.uint64)

    def __init__(self, data: np.ndarray):
        n = len(data) + 1
        if n > len(Fingerprints.powers):
            size = max(n, 2 * len(Fingerprints.powers))
            for name, factor in (("powers", BASE), ("inverses", INVERSE)):
                steps = np.full(size, factor, np.uint64)
                steps[0] = 1
                setattr(Fingerprints, name, np.cumprod(steps))
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(BYTE_CODES[data] * self.powers[:n - 1])])

    def every(self, length: int) -> np.ndarray:
        """Of the stretch of `length` bytes at each place."""
        n = len(self.sums) - length
        return mixed((self.sums[length:] - self.sums[:n]) * self.inverses[:n])

    def between(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mixed((self.sums[ends] - self.sums[starts]) * self.inverses[starts])


def least_of(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every `width` neighbours, by doubling."""
    step = 1
    while 2 * step <= width:
        values = np.minimum(values[:-step], values[step:])
        step *= 2
    rest = width - step
    return np.minimum(values[:len(values) - rest], values[rest:]) if rest else values


def blocks(data: np.ndarray, length: int, anchor: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Cut a text's passages (one at each place) into runs that share an anchor.

    A passage's anchor is the string of `anchor` bytes in it with the smallest hash, the first of equals. It
    depends on the passage alone, so equal passages have equal anchors at equal places in them.
    Gives, by segment: hashes of the anchors and of the runs' whole bytes, the runs' starts and sizes.
    """
    for begin in range(0, len(data) - length + 1, SEGMENT):
        part = data[begin:begin + SEGMENT + length - 1]
        prints = Fingerprints(part)
        codes = prints.every(anchor)
        places = np.arange(len(codes), dtype=np.uint64)
        ordered = (codes & ~np.uint64((1 << 20) - 1)) | places
        chosen = least_of(ordered, length - anchor + 1) & np.uint64((1 << 20) - 1)
        starts = np.flatnonzero(np.concatenate([[True], chosen[1:] != chosen[:-1]]))
        ends = np.append(starts[1:], len(chosen))
        yield codes[chosen[starts].astype(np.int64)], prints.between(starts, ends + length - 1), starts + begin, ends - starts


def _bytes(text: pa.Scalar) -> np.ndarray:
    buffer = text.as_buffer()
    return np.frombuffer(buffer, np.uint8) if buffer is not None else np.zeros(0, np.uint8)


def _arrow(names: list[str], columns: list[np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names)


RUNS = "anchor bigint, content bigint, row bigint, start bigint, size bigint"


def _find_blocks(length: int, anchor: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in RUNS.split(", ")]
        for batch in batches:
            found, waiting = [], 0
            for row, text in zip(batch.column(0).to_numpy(), batch.column(1)):
                for anchors, contents, starts, sizes in blocks(_bytes(text), length, anchor):
                    found.append((anchors.view(np.int64), contents.view(np.int64), np.full(len(starts), row, np.int64), starts, sizes))
                    waiting += len(starts)
                if waiting > 200_000:
                    yield _arrow(names, [np.concatenate(c) for c in zip(*found)])
                    found, waiting = [], 0
            if found:
                yield _arrow(names, [np.concatenate(c) for c in zip(*found)])

    return run


def _whole(batches: Iterator[pa.RecordBatch], columns: int) -> list[np.ndarray]:
    """The rows of a sorted range, as arrays."""
    parts = [[c.to_numpy(zero_copy_only=False) for c in b.columns] for b in batches if b.num_rows]
    return [np.concatenate(c) for c in zip(*parts)] if parts else [np.zeros(0, np.int64)] * columns


def _same_as_before(*columns: np.ndarray) -> np.ndarray:
    n = len(columns[0])
    same = np.zeros(n, bool)
    if n > 1:
        same[1:] = np.logical_and.reduce([c[1:] == c[:-1] for c in columns])
    return same


def _compare_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Neighbours in a sorted range of runs.

    Runs of an anchor that lies inside the range are decided here: `whole` ones have the bytes of another run; `partial` ones are to be
    looked at passage by passage, where the anchor has runs of different bytes: one run of each content, `alone` if no other
    run has it. The runs of the first and the last anchor of the range, which may go on in the next one, are given with `edge`, and
    `copies` as the number of equal runs, at the first of them and 0 at the others.
    """
    anchor, content, row, start, size = _whole(batches, 5)
    n = len(anchor)
    if not n:
        return
    edge = (anchor == anchor[0]) | (anchor == anchor[-1])
    same = _same_as_before(anchor, content)
    first = np.flatnonzero(~same)
    equal = np.diff(np.append(first, n))
    copies = np.zeros(n, np.int64)
    copies[first] = equal
    # the contents of each anchor
    begins = np.flatnonzero(~_same_as_before(anchor[first]))
    variants = np.repeat(np.diff(np.append(begins, len(first))), np.diff(np.append(begins, len(first))))
    whole = np.repeat(equal > 1, equal)
    partial = np.zeros(n, bool)
    partial[first] = variants > 1
    keep = edge | whole | partial
    # what names the bytes is needed at the edges only
    yield _arrow(["anchor", "content", "row", "start", "size", "copies", "edge", "whole", "partial", "alone"], [
        c[keep] for c in (np.where(edge, anchor, 0), np.where(edge, content, 0), row, start, size, copies, edge, whole & ~edge, partial & ~edge, copies == 1)])


# `spot` is twice the place of a passage, and one more if it is open
SUFFIXES = "lead bigint, print bigint, row bigint, spot bigint"


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Task: texts packed for the way to the runs of their row."""
    from zstandard import ZstdCompressor

    pack = ZstdCompressor(level=3).compress
    for batch in batches:
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([pack(_bytes(t)) for t in batch.column(1)], pa.binary())], names=["row", "text"])


def _suffixes(length: int):
    """Task: every passage of the given runs, with its first eight bytes and its fingerprint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from zstandard import ZstdDecompressor

        unpack = ZstdDecompressor().decompress
        names = [c.split()[0] for c in SUFFIXES.split(", ")]
        for batch in batches:
            for row, text, wanted in zip(batch.column(0).to_numpy(), batch.column(1), batch.column(2)):
                data = np.frombuffer(unpack(text.as_py()), np.uint8)
                runs = wanted.as_py()
                for begin in range(0, len(data) - length + 1, SEGMENT):
                    inside = [r for r in runs if begin <= r["start"] < begin + SEGMENT]
                    if not inside:
                        continue
                    part = data[begin:begin + SEGMENT + length - 1]
                    prints = Fingerprints(part)
                    sizes = np.array([r["size"] for r in inside])
                    first = np.array([r["start"] for r in inside]) - begin
                    places = np.repeat(first - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
                    eight = np.lib.stride_tricks.sliding_window_view(part, 8)[places]
                    lead = np.ascontiguousarray(eight).view(">u8").ravel().astype(np.uint64).view(np.int64)
                    yield _arrow(names, [
                        lead, prints.between(places, places + length).view(np.int64), np.full(len(places), row, np.int64),
                        2 * (places + begin) + np.repeat([int(r["open"]) for r in inside], sizes)])

    return run


def _compare_suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Neighbours in a sorted range of passages: `equal` ones, and those at the ends of the range."""
    lead, code, row, spot = _whole(batches, 4)
    n = len(lead)
    if not n:
        return
    same = _same_as_before(lead, code)
    equal = same | np.append(same[1:], False)
    at_end = np.zeros(n, bool)
    at_end[[0, -1]] = True
    wanted = spot % 2 == 1
    keep = (equal & wanted) | at_end
    yield _arrow(["lead", "print", "row", "start", "open", "equal", "at_end"], [c[keep] for c in (
        np.where(at_end, lead, 0), np.where(at_end, code, 0), row, spot // 2, wanted, equal, at_end)])


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What is left of each text without the given spans, which may overlap."""
    for batch in batches:
        out: list[tuple] = []
        for doc_id, text, starts, ends in zip(*batch.columns):
            data = _bytes(text)
            begins, stops = (np.array(c.as_py() or [], np.int64) for c in (starts, ends))
            order = np.argsort(begins, kind="stable")
            begins, stops = begins[order], np.maximum.accumulate(stops[order]) if len(stops) else stops
            opens = np.concatenate([[True], begins[1:] > stops[:-1]])[:len(begins)]
            begins = begins[opens]
            stops = stops[np.append(np.flatnonzero(opens)[1:] - 1, len(stops) - 1)] if len(stops) else stops
            digest, at = hashlib.sha256(), 0
            for begin, stop in zip(begins.tolist(), stops.tolist()):
                digest.update(data[at:begin])
                at = stop
            digest.update(data[at:])
            out.append((doc_id.as_py(), len(data), int((stops - begins).sum()), len(begins), digest.hexdigest(), list(map(int, begins)), list(map(int, stops))))
        kinds = [pa.int64()] * 4 + [pa.string()] + [pa.list_(pa.int64())] * 2
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)],
            names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "starts", "ends"])


def sorted_in_ranges(df: DataFrame, *keys: str) -> DataFrame:
    """Rows in order, in ranges between sampled splitters.

    The last keys tell all rows apart, so even rows that are equal in the first ones are dealt over several tasks.
    """
    return df.repartitionByRange(tasks(df.sparkSession), *keys).sortWithinPartitions(*keys)


def repeated_spans(docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR) -> DataFrame:
    """(row, start, end): stretches of the texts' bytes that are covered by repeated passages. They may overlap.

    `docs` has `row`, a key, and `text`. A passage is a string of `length` bytes inside one text; it is repeated if it
    starts anywhere else too. The suffix array is sparse: suffixes are first sorted at the anchors of passages
    only, one for some fifty bytes, by anchor and by the run of passages around it. Runs with equal bytes are
    repeats. Passages of runs that share an anchor, but not all bytes, are sorted one by one, by
    their first eight bytes and a 64-bit fingerprint of the rest. Neighbours are compared in each range; only what
    lies at the ends of the ranges is grouped and joined.
    """
    spark = docs.sparkSession
    found = docs.select("row", "text").mapInArrow(_find_blocks(length, anchor), RUNS)
    runs = store(sorted_in_ranges(found, "anchor", "content", "row", "start").mapInArrow(
        _compare_runs, RUNS + ", copies bigint, edge boolean, whole boolean, partial boolean, alone boolean"), "runs", "zstd")
    release(spark)
    # anchors at the ends of ranges: their equal runs are counted over all ranges
    edges = runs.filter("edge")
    contents = store(edges.filter("copies > 0").groupBy("anchor", "content").agg(F.sum("copies").alias("total")), "contents")
    shared = contents.groupBy("anchor").agg(F.count("*").alias("variants")).filter("variants > 1").select("anchor")
    # one run of each content, and all runs whose content is met once, are looked at passage by passage
    singles = edges.filter("copies > 0").join(contents, ["anchor", "content"])
    whole = runs.filter("whole").select("row", "start", "size").unionAll(
        edges.filter("copies <> 1").select("row", "start", "size")).unionAll(
        singles.filter("copies = 1 and total > 1").select("row", "start", "size"))
    partial = runs.filter("partial").select("row", F.struct("start", "size", F.col("alone").alias("open")).alias("run")).unionAll(
        singles.join(shared, "anchor", "left_semi").select("row", F.struct(
            "start", "size", (F.col("total") == 1).alias("open")).alias("run")))
    wanted = partial.groupBy("row").agg(F.collect_list("run").alias("wanted"))
    suffixes = docs.select("row", "text").mapInArrow(_packed, "row bigint, text binary").join(wanted, "row").select("row", "text", "wanted").mapInArrow(_suffixes(length), SUFFIXES)
    passages = store(sorted_in_ranges(suffixes, "lead", "print", "row", "spot").mapInArrow(
        _compare_suffixes, "lead bigint, print bigint, row bigint, start bigint, open boolean, equal boolean, at_end boolean"), "passages", "zstd")
    release(spark)
    # an end of a range is repeated if a neighbouring range ends with an equal passage
    across = passages.filter("at_end").groupBy("lead", "print").agg(F.count("*").alias("n")).filter("n > 1")
    late = passages.filter("at_end and open and not equal").join(across, ["lead", "print"], "left_semi")
    single = passages.filter("open and equal").select("row", "start").unionAll(late.select("row", "start"))
    return whole.select("row", "start", (F.col("start") + F.col("size") + (length - 1)).alias("end")).unionAll(
        single.select("row", "start", (F.col("start") + length).alias("end")))


def remove_repeats(docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR) -> DataFrame:
    """Every row's text without its repeated passages: sizes, the removed spans, and the SHA-256 of what is left.

    `docs` has doc_id and text. Texts are UTF-8 bytes, a missing one is empty; passages never cross texts. Of a passage that
    occurs twice both are removed, as all are judged on the input. Rows are told apart by a 64-bit hash of
    doc_id and text; rows that are repeated whole are repeats of each other. A text shorter than `length` is
    left alone. An empty table gives an empty result. Other columns are ignored.
    """
    keyed = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    keyed = keyed.withColumn("row", F.xxhash64("doc_id", "text"))
    spans = repeated_spans(keyed, length, anchor).groupBy("row").agg(
        F.collect_list("start").alias("starts"), F.collect_list("end").alias("ends"))
    return keyed.join(spans, "row", "left").select("doc_id", "text", "starts", "ends").mapInArrow(
        _remove, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, "
        "starts array<bigint>, ends array<bigint>")


def repeats_query(docs: DataFrame) -> DataFrame:
    return remove_repeats(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


REPEATS_SQL = """
with d as (select row_number() over () as id, doc_id, hex(encode(coalesce(text, ''))) as digits from documents),
n as (select *, (length(digits) // 2)::bigint as n_bytes from d),
w as (select id, n_bytes, place, substr(digits, 2 * place + 1, 2 * (1024 + 199)) as part
  from (select *, unnest(range(0, n_bytes - 199, 1024)) as place from n where n_bytes >= 200)),
s as (select id, place + k as start, md5_number(substr(part, 2 * k + 1, 400)) as code
  from (select *, unnest(range(0, least(1024, n_bytes - 199 - place))) as k from w)),
r as (select id, start from s qualify count(*) over (partition by code) > 1),
b as (select id, start, coalesce(start - lag(start) over (partition by id order by start) > 200, true) as opens from r),
i as (select id, start, count(*) filter (opens) over (partition by id order by start) as span from b),
p as (select id, span, min(start) as begin_at, max(start) + 200 as end_at from i group by id, span),
q as (select *, coalesce(lag(end_at) over (partition by id order by begin_at), 0) as free_from from p),
k as (
  select n.id, count(*) as n_spans, sum(end_at - begin_at) as n_removed,
    string_agg(substr(digits, 2 * free_from + 1, 2 * (begin_at - free_from)), '' order by begin_at)
      || substr(any_value(digits), 2 * max(end_at) + 1) as kept
  from q join n using (id) group by n.id)
select doc_id, n_bytes, coalesce(n_removed, 0)::bigint as n_removed, coalesce(n_spans, 0)::bigint as n_spans,
  sha256(unhex(coalesce(kept, digits))) as kept_sha256
from n left join k using (id)
"""
