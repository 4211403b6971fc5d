"""Quality rules: base counts of each text, and lines that many documents of a host share."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from demoflux.llm.common import WORD, store

SYMBOLS = "#*$%&|<>"  # fixed value
MAX_SHARE = 0.05  # part of a host's distinct texts that may share a line
MAX_DOCS = 10  # so many may at least, which is what counts for hosts of under 200 texts
KEPT_SHARE = 0.5  # part of a text's words that must be left
COUNTED = (
    "doc_id bigint, host string, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, "
    "n_repeat_words bigint, lines array<bigint>, words array<int>, text_hash bigint")


def repeated_words(words: list[str], span: int = 3) -> int:
    """Words that lie in a window of `span` words which the text has twice or more."""
    n = len(words) - span + 1
    if n < 2:
        return 0
    seen: dict[str, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))
    codes = ids[:n]
    for i in range(1, span):
        _, codes = np.unique(codes * (len(seen) + 1) + ids[i:n + i], return_inverse=True)
    again = np.bincount(codes)[codes] > 1
    covered = np.zeros(len(words), bool)
    for i in range(span):
        covered[i:n + i] |= again
    return int(covered.sum())


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from xxhash import xxh3_64_intdigest

    find_words = re.compile(WORD).findall
    digits, blanks = re.compile(r"\d+"), re.compile(r"\s+")
    blank = " \t\n\x0b\x0c\r"
    signed = lambda h: h - (1 << 64) if h >> 63 else h
    for batch in batches:
        out: list[list] = [[] for _ in range(10)]
        for doc_id, text, host in zip(*batch.columns):
            text, host = text.as_py() or "", host.as_py()
            words = find_words(text)
            lines = [line for line in text.split("\n") if line.strip(blank)]
            counts: dict[int, int] = {}
            prefix = f"{host}\n" if host is not None else "\n\n"
            for line in lines:
                normal = blanks.sub(" ", digits.sub("0", line.lower())).strip()
                code = signed(xxh3_64_intdigest(prefix + normal))
                counts[code] = counts.get(code, 0) + len(find_words(line))
            row = (
                doc_id.as_py(), host, len(words), sum(map(len, words)), sum(map(text.count, SYMBOLS)),
                len(lines) - len(set(lines)), repeated_words(words), list(counts), list(counts.values()),
                signed(xxh3_64_intdigest(text)))
            for column, value in zip(out, row):
                column.append(value)
        kinds = [pa.int64(), pa.string(), *[pa.int64()] * 5, pa.list_(pa.int64()), pa.list_(pa.int32()), pa.int64()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(out, kinds)],
            names=[part.split()[0] for part in COUNTED.split(", ")])


def quality_rules(
    docs: DataFrame, host: str = "source", max_docs: int = MAX_DOCS, kept_share: float = KEPT_SHARE,
    max_share: float = MAX_SHARE,
) -> DataFrame:
    """Counts, verdicts and the line rule for every document (columns doc_id, text and the host).

    Lines are compared in lower case, with digit runs as one 0 and white space as one blank. A line that more
    than `max_share` of its host's distinct texts hold, and more than `max_docs` of them, is removed wherever it
    stands there, so that a host's size does not decide what an ordinary line is; a document that
    keeps less than `kept_share` of its words is depleted and rejected. Verbatim copies of a text count
    once, since they say nothing about its lines. A missing text counts as empty, a missing host
    as a host of its own, lines and rows are told apart by 64-bit hashes. Repeated rows are judged each;
    an empty table gives an empty result.

    Texts are read once. Line hashes are summed before the shuffle, so a line in a third of all
    documents is a handful of rows when it meets itself.
    """
    counted = store(docs.select(F.col("doc_id").cast("bigint"), "text", F.col(host).cast("string").alias("host")).mapInArrow(
        _count, COUNTED), "counted")
    # hosts by a hash too, which a missing one has as well
    hosts = counted.select(F.xxhash64("host").alias("host_key"), "host", "text_hash").distinct().groupBy("host_key").agg(
        F.count("*").alias("n_texts"))
    distinct = counted.groupBy("host", "text_hash").agg(F.first("lines").alias("lines"))
    shared = distinct.select(F.xxhash64("host").alias("host_key"), F.explode("lines").alias("line")).groupBy("host_key", "line").agg(
        F.count("*").alias("n_docs")).filter(F.col("n_docs") > max_docs)
    frequent = shared.join(hosts, "host_key").filter(F.col("n_docs") > F.lit(max_share) * F.col("n_texts")).select("line")
    # rows that are repeated whole would be added up, so each is divided by their number
    row = F.xxhash64("doc_id", "host", "text_hash").alias("row")
    own = counted.select(row, F.explode(F.arrays_zip("lines", "words")).alias("entry")).select(
        "row", F.col("entry.lines").alias("line"), F.col("entry.words").alias("words"))
    copies = counted.groupBy(row).agg(F.count("*").alias("copies")).filter("copies > 1")
    removed = own.join(frequent, "line").groupBy("row").agg(F.sum("words").alias("all_removed"), F.count("*").alias("all_lines"))
    totals = removed.join(copies, "row", "left").selectExpr(
        "row", "cast(all_removed / coalesce(copies, 1) as bigint) as n_removed_words",
        "cast(all_lines / coalesce(copies, 1) as bigint) as n_removed_lines")
    joined = counted.drop("lines", "words").withColumn("row", row).join(totals, "row", "left")
    gone = F.coalesce("n_removed_words", F.lit(0))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    depleted = (F.col("n_words") - gone) < F.lit(kept_share) * F.col("n_words")
    return joined.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"),
        (~failed & ~depleted).alias("kept"), gone.cast("long").alias("n_removed_words"),
        F.coalesce("n_removed_lines", F.lit(0)).cast("long").alias("n_removed_lines"))


def quality_query(docs: DataFrame) -> DataFrame:
    return quality_rules(docs)


QUALITY_SQL = r"""
with d as (select row_number() over () as id, doc_id, source as host, coalesce(text, '') as body from documents),
w as (select id, regexp_extract_all(body, '[^\x20\x09-\x0D]+') as words from d),
v as (
  select id, i, concat_ws(' ', words[i], words[i + 1], words[i + 2]) as window3
  from (select id, words, unnest(range(1, len(words) - 1)) as i from w)),
a as (select id, i from v qualify count(*) over (partition by id, window3) > 1),
r as (select id, count(distinct place) as n_repeat_words from (select id, unnest([i, i + 1, i + 2]) as place from a) group by id),
l as (
  select id, line, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) as n,
    regexp_replace(regexp_replace(regexp_replace(lower(line), '\p{Nd}+', '0', 'g'),
      '[\x09-\x0D\x1C-\x20\x{85}\p{Z}]+', ' ', 'g'), '^ | $', '', 'g') as normal
  from (select id, unnest(string_split(body, chr(10))) as line from d)
  where regexp_matches(line, '[^\x20\x09-\x0D]')),
u as (select id, count(*) - count(distinct line) as n_dup_lines from l group by id),
e as (select id, normal, sum(n) as n from l group by id, normal),
t as (select host, count(distinct body) as n_texts from d group by host),
f as (
  select d.host, e.normal from e join d using (id) group by d.host, e.normal
  having count(distinct d.body) > 10 and count(distinct d.body) > 0.05 * (
    select n_texts from t where t.host is not distinct from d.host)),
g as (
  select e.id, sum(e.n) as words, count(*) as lines from e join d using (id)
  join f on f.host is not distinct from d.host and f.normal = e.normal group by e.id),
c as (
  select d.doc_id, len(w.words)::bigint as n_words, length(array_to_string(w.words, ''))::bigint as word_chars,
    length(regexp_replace(d.body, '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols, coalesce(u.n_dup_lines, 0)::bigint as n_dup_lines,
    coalesce(r.n_repeat_words, 0)::bigint as n_repeat_words, coalesce(g.words, 0)::bigint as n_removed_words,
    coalesce(g.lines, 0)::bigint as n_removed_lines
  from d join w using (id) left join u using (id) left join r using (id) left join g using (id))
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed,
  not (n_words < 50 or 100 * n_repeat_words > 50 * n_words) and 2 * (n_words - n_removed_words) >= n_words as kept,
  n_removed_words, n_removed_lines
from c
"""
