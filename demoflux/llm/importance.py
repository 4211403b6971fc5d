"""Importance resampling towards a target text set: hashed n-gram weights, and draws above a threshold found by bisection."""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import islice
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from demoflux.llm.common import store
from demoflux.llm.words import MARKS, word_pieces, word_table
from demoflux.operators.numbering import numbered

BUCKETS = 10_000
SHARE = (25, 100)  # of the documents that are long enough
LEAST_WORDS = 20
SEED = 7
HALVINGS = 3  # halvings of the range that one count job decides
LAST = (1 << 63) - 1

#: Fixed value: characters that are no part of a word, in texts whose A-Z are small.
TABLE = word_table(MARKS)


def feature_codes(text: bytes) -> Iterator[tuple[int, np.ndarray]]:
    """By piece of the text: its number of words, and the CRC-32 of its words and of its runs of two words.

    A run's code continues its first word's code, so words are never joined.
    """
    last = None
    for words in word_pieces(text, TABLE):
        codes = list(map(crc32, words))
        runs = list(map(crc32, map(b" ".__add__, islice(words, last is None, None)), codes if last is None else [last, *codes]))
        last = codes[-1]
        yield len(words), np.array(codes + runs, np.int64)


def _text(value: pa.Scalar) -> bytes:
    buffer = value.as_buffer()
    return buffer.to_pybytes() if buffer is not None else b""


def _count(buckets: int):
    """Task: how often each bucket occurs in the task's texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for text in batch.column(0):
                for _, codes in feature_codes(_text(text)):
                    total += np.bincount(codes % buckets, minlength=buckets)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["bucket", "n"])

    return run


def bucket_counts(texts: DataFrame, buckets: int) -> np.ndarray:
    """Features per bucket over all texts. What reaches the driver is one number per bucket."""
    counted = texts.mapInArrow(_count(buckets), "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))
    total = np.zeros(buckets, np.int64)
    for row in counted.collect():
        total[row["bucket"]] = row["n"]
    return total


def gains_of(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * log ratio) of each bucket's smoothed shares in the target and in the source."""
    buckets, all_source, all_target = len(source), int(source.sum()), int(target.sum())
    return np.array([
        math.floor(1000 * math.log((int(t) + 1) * (all_source + buckets) / ((int(s) + 1) * (all_target + buckets))))
        for s, t in zip(source, target)], np.int64)


def _weigh(gains: np.ndarray):
    """Task: each text's words, features, and floored mean gain."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.zeros((batch.num_rows, 3), np.int64)
            for i, text in enumerate(batch.column(1)):
                n_words = n_features = total = 0
                for n, codes in feature_codes(_text(text)):
                    n_words += n
                    n_features += len(codes)
                    total += int(gains[codes % len(gains)].sum())
                found[i] = n_words, n_features, total // n_features if n_features else 0
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(found[:, i]) for i in range(3))], names=["doc_id", "n_words", "n_features", "weight"])

    return run


def noise(key: Column, seed: int) -> Column:
    """A whole number from a Gumbel distribution times 1000, fixed by the key: highest sums are draws without replacement."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))


def smallest_reaching(rows: DataFrame, column: str, wanted: int, halvings: int = HALVINGS) -> int:
    """The smallest whole number v so that at least `wanted` rows have column <= v; there must be that many.

    By bisection: each job counts the rows exactly at the cut points that the next halvings may need, so it reads
    one column and gives a few numbers, however many rows tie.
    """
    low, high = rows.agg(F.min(column), F.max(column)).first()
    while low < high:
        cuts = sorted({low + (high - low) * i // (1 << halvings) for i in range(1, 1 << halvings)})
        counts = rows.agg(*[F.count(F.when(F.col(column) <= F.lit(c), 1)) for c in cuts]).first()
        for cut, n in zip(cuts, counts):
            low, high = (low, min(high, cut)) if n >= wanted else (max(low, cut + 1), high)
    return low


def resample(
    docs: DataFrame, targets: DataFrame, share: tuple[int, int] = SHARE, least_words: int = LEAST_WORDS,
    buckets: int = BUCKETS, seed: int = SEED,
) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) for every row of `docs` (doc_id, text), all long.

    Features are words and runs of two words, hashed into buckets. A bucket's gain is the log ratio of its smoothed shares
    in `targets` (text) and in `docs`; a text's weight is its mean gain, its score the weight plus noise that the
    doc_id fixes. Of the rows with at least `least_words` words the given share with the highest scores is
    drawn, ties to the smaller doc_id; rank is their order, NULL for all others.

    Scores are stored once. The cut-off is found by counts over them, first of the score, then of doc_id among the
    rows that tie at it; only drawn rows are sorted, in ranges.

    A missing text is an empty one, and has no features and weight 0. Rows without doc_id are scored as one with an empty id
    and come last among ties. Repeated rows are each scored and drawn; where rows of one doc_id tie at the cut, the heavier
    and then the longer ones are drawn. An empty table gives an empty result, empty targets have no features. Other columns are ignored.
    """
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text"))
    gains = gains_of(bucket_counts(texts.select("text"), buckets), bucket_counts(targets.select("text"), buckets))
    weighed = texts.mapInArrow(_weigh(gains), "doc_id bigint, n_words bigint, n_features bigint, weight bigint")
    scored = store(weighed.select(
        "doc_id", "n_features", "weight", (F.col("weight") + noise(F.col("doc_id"), seed)).alias("score"),
        (F.col("n_words") >= least_words).alias("long_enough")), "scores")
    able = scored.filter("long_enough").select(
        "*", (-F.col("score")).alias("behind"), F.coalesce("doc_id", F.lit(LAST)).alias("tie"))
    wanted = able.count() * share[0] // share[1]
    columns = ["doc_id", "n_features", "weight", "score"]
    if not wanted:
        return scored.select(*columns, F.lit(None).cast("bigint").alias("rank"))
    cut = smallest_reaching(able, "behind", wanted)
    rest = wanted - able.filter(F.col("behind") < cut).count()
    last = smallest_reaching(able.filter(F.col("behind") == cut), "tie", rest)
    drawn = F.col("long_enough") & (
        (F.col("score") > -cut) | ((F.col("score") == -cut) & (F.coalesce("doc_id", F.lit(LAST)) <= last)))
    ranked = numbered(
        scored.filter(drawn).select(*columns),
        [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("weight").desc(), F.col("n_features").desc()], "rank")
    # rows of one doc_id and score may exceed the number that is wanted
    ranked = ranked.withColumn("rank", F.when(F.col("rank") <= wanted, F.col("rank")))
    return ranked.unionAll(scored.filter(~drawn).select(*columns, F.lit(None).cast("bigint").alias("rank")))


def resample_query(docs: DataFrame, targets: DataFrame) -> DataFrame:
    return resample(docs, targets)


#: The CRC-32 of a feature is computed byte by byte, from a table that follows from its polynomial.
RESAMPLE_SQL = r"""
with crc as materialized (
  select list_transform(range(256), lambda i: list_reduce(list_prepend(i::bigint, list_transform(range(8), lambda k: k::bigint)),
    lambda a, b: case when a & 1 = 1 then xor(a >> 1, 3988292384) else a >> 1 end)) as steps
), texts as (
  select 0 as kind, doc_id, text from documents union all select 1, item_id, text from benchmark
), split as (
  select kind, doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
  from texts
), listed as (
  select kind, doc_id, len(w) as n_words, list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) as f from split
), features as (
  select kind, doc_id, unnest(f) as feature from listed
), coded as (
  select feature, hex(encode(feature)) as h from (select distinct feature from features)
), hashed as materialized (
  select feature, xor(list_reduce(
    list_prepend(4294967295, list_transform(range(len(h) // 2), lambda i:
      (instr('0123456789ABCDEF', h[2 * i + 1]) - 1) * 16 + instr('0123456789ABCDEF', h[2 * i + 2]) - 1)),
    lambda a, b: xor(steps[(xor(a, b) & 255) + 1], a >> 8)), 4294967295) % 10000 as bucket
  from coded, crc
), counts as (
  select bucket, count(*) filter (kind = 0) as s, count(*) filter (kind = 1) as t from features join hashed using (feature) group by bucket
), gains as (
  select bucket, floor(1000 * ln(((t + 1) * ((select sum(s) from counts) + 10000))::double
    / ((s + 1) * ((select sum(t) from counts) + 10000))::double))::bigint as gain
  from counts
), sums as (
  select doc_id, sum(gain) as total from features join hashed using (feature) join gains using (bucket) where kind = 0 group by doc_id
), weights as (
  select doc_id, n_words, len(f)::bigint as n_features, coalesce(floor(total::double / nullif(len(f), 0)), 0)::bigint as weight,
    ('0x' || sha256('7:' || doc_id)[1:8])::bigint as h
  from listed left join sums using (doc_id) where kind = 0
), scores as (
  select *, weight + floor(-1000 * ln(-ln((h + 0.5)::double / 4294967296)))::bigint as score from weights
), ranked as (
  select doc_id, row_number() over (order by score desc, doc_id) as rank, count(*) over () * 25 // 100 as wanted from scores where n_words >= 20
)
select s.doc_id, n_features, weight, score, case when rank <= wanted then rank end as rank from scores s left join ranked using (doc_id)
"""
