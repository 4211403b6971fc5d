"""Language identification: word frequencies first, and ever shorter character n-grams for unseen words."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from demoflux.llm.common import discard, store, tasks

TRAIN_DOCS = 20_000  # documents that the model is fitted on, about
MAX_WORDS = 60_000  # known words of the model
MAX_GRAMS = 120_000  # n-grams of the model
LONGEST = 5
CACHED_WORDS = 300_000

letters = regex.compile(r"\p{L}+")


def grams(word: str, n: int) -> list[str]:
    marked = f"_{word}_"
    return [marked[i:i + n] for i in range(len(marked) - n + 1)]


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[str, Counter] = {}
    for batch in batches:
        for lang, text in zip(batch.column(0), batch.column(1)):
            counts.setdefault(lang.as_py(), Counter()).update(text.as_py().lower().split())
    for lang, tokens in counts.items():
        words: Counter = Counter()
        for token, n in tokens.items():
            for word in letters.findall(token):
                words[word] += n
        yield pa.RecordBatch.from_arrays(
            [pa.array([lang] * len(words), pa.string()), pa.array(list(words), pa.string()), pa.array(list(words.values()), pa.int64())],
            names=["lang", "unit", "n"])


def _count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found: Counter = Counter()
        for lang, word, n in zip(*(c.to_pylist() for c in batch.columns)):
            for size in range(1, LONGEST + 1):
                for gram in grams(word, size):
                    found[lang, gram] += n
        yield pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k in found], pa.string()), pa.array([k[1] for k in found], pa.string()),
             pa.array(list(found.values()), pa.int64())], names=["lang", "unit", "n"])


@dataclass
class LanguageModel:
    """Log frequencies by language, less their mean over languages: one row of `table` per known word and n-gram."""

    langs: list[str]
    words: dict[str, int]
    grams: dict[str, int]
    table: np.ndarray

    def rows(self, word: str) -> list[int]:
        """The row of a known word, or those of an unseen word's longest n-grams that are known; their mean is its score."""
        at = self.words.get(word)
        if at is not None:
            return [at]
        for size in range(LONGEST, 0, -1):
            found = [at for g in grams(word, size) if (at := self.grams.get(g)) is not None]
            if found:
                return found
        return []

    def token_scores(self, tokens: list[str]) -> np.ndarray:
        """Summed scores of the words in each token, and in the last column their number."""
        places, shares, owners, counts = [], [], [], []
        for i, token in enumerate(tokens):
            found = letters.findall(token)
            counts.append(len(found))
            for word in found:
                rows = self.rows(word)
                places += rows
                shares += [1 / len(rows)] * len(rows) if rows else []
                owners += [i] * len(rows)
        scores = np.zeros((len(tokens), len(self.langs) + 1))
        scores[:, -1] = counts
        values = self.table[np.array(places, np.int64)] * np.array(shares, float)[:, None]
        for lang in range(len(self.langs)):
            scores[:, lang] = np.bincount(np.array(owners, np.int64), values[:, lang], len(tokens))
        return scores


def _log_table(rows: list[tuple[str, str, int]], langs: list[str], totals: dict) -> dict[str, np.ndarray]:
    place = {lang: i for i, lang in enumerate(langs)}
    counts: dict[str, np.ndarray] = {}
    for lang, unit, n in rows:
        counts.setdefault(unit, np.zeros(len(langs)))[place[lang]] += n
    table = {}
    for unit, c in counts.items():
        total = np.array([totals.get((lang, len(unit) if totals.get("by_size") else 0), 0) for lang in langs], float)
        logs = np.log((c + 0.5) / (total + 1.0))
        table[unit] = logs - logs.mean()
    return table


def fit_language_model(
    docs: DataFrame, lang: str = "lang", text: str = "text", key: str = "doc_id", train_docs: int = TRAIN_DOCS,
    max_words: int = MAX_WORDS, max_grams: int = MAX_GRAMS,
) -> LanguageModel:
    """Fit on about `train_docs` labelled documents, picked by a hash of the key.

    That number, and the numbers of known words and n-grams (the most frequent ones of each language), bound the model that
    the driver holds and sends to the tasks. All three are dealt evenly to the languages: a small language
    gives all its documents, and a large one takes no other's places. Rows without text or language are left out.
    """
    spark = docs.sparkSession
    rows = docs.filter(F.col(lang).isNotNull() & F.col(text).isNotNull())
    sizes = {r[0]: r["count"] for r in rows.groupBy(F.col(lang).cast("string")).count().collect()}
    places = max(1, len(sizes))
    share = F.create_map(*[F.lit(x) for name, n in sizes.items() for x in (name, min(1.0, train_docs / places / n))]) if sizes else None
    limit = share[F.col(lang).cast("string")] * (1 << 40) if sizes else F.lit(0)
    picked = rows.filter(F.pmod(F.xxhash64(F.col(key), F.lit("lang")), F.lit(1 << 40)) < limit)
    counted = picked.select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text")).mapInArrow(
        _count_words, "lang string, unit string, n bigint")
    words = counted.groupBy("lang", "unit").agg(F.sum("n").alias("n"))
    words = store(words, "words")
    sums = words.groupBy("lang").agg(F.sum("n").alias("n")).collect()
    langs = sorted(r["lang"] for r in sums)
    first = Window.partitionBy("lang").orderBy(F.desc("n"), "unit")
    top = lambda df, limit: df.withColumn("nth", F.row_number().over(first)).filter(F.col("nth") <= -(-limit // places)).select("unit").distinct()
    fetch = lambda df, limit: [tuple(r) for r in df.join(top(df, limit), "unit", "left_semi").select("lang", "unit", "n").collect()]
    known = fetch(words.filter("n > 1"), max_words)
    found = words.repartition(tasks(spark)).mapInArrow(_count_grams, "lang string, unit string, n bigint").groupBy("lang", "unit").agg(
        F.sum("n").alias("n"))
    found = store(found, "grams")
    by_size = {(r["lang"], r["size"]): r["n"] for r in found.groupBy("lang", F.length("unit").alias("size")).agg(F.sum("n").alias("n")).collect()}
    parts = fetch(found.filter("n > 2"), max_grams)
    discard(words, found)
    of_words = _log_table(known, langs, {(r["lang"], 0): r["n"] for r in sums})
    of_grams = _log_table(parts, langs, by_size | {"by_size": True})
    table = np.array([*of_words.values(), *of_grams.values()], float).reshape(len(of_words) + len(of_grams), len(langs))
    return LanguageModel(
        langs, {w: i for i, w in enumerate(of_words)}, {g: len(of_words) + i for i, g in enumerate(of_grams)}, table)


def _predict(model: LanguageModel):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places: dict[str, int] = {}
        table = np.zeros((CACHED_WORDS + 1, len(model.langs) + 1))  # scores of a token, and the words in it
        for batch in batches:
            langs, scores = [], []
            for text in batch.column(1):
                tokens = Counter((text.as_py() or "").lower().split())
                total = np.zeros(len(model.langs) + 1)
                names, counts = list(tokens), np.fromiter(tokens.values(), float, len(tokens))
                for i in range(0, len(names), CACHED_WORDS):
                    part = names[i:i + CACHED_WORDS]
                    new = [t for t in part if t not in places]
                    if len(places) + len(new) > CACHED_WORDS:
                        places.clear()
                        new = part
                    if new:
                        table[len(places):len(places) + len(new)] = model.token_scores(new)
                        places.update(zip(new, range(len(places), len(places) + len(new))))
                    at = np.fromiter((places[t] for t in part), np.int64, len(part))
                    total += counts[i:i + CACHED_WORDS] @ table[at]
                if not model.langs or not total[-1]:
                    langs.append("und")
                    scores.append(0.0)
                    continue
                logits = total[:-1] / math.sqrt(total[-1])
                odds = np.exp(logits - logits.max())
                langs.append(model.langs[int(np.argmax(logits))])
                scores.append(float(odds.max() / odds.sum()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "lang_pred", "score"])

    return run


def identify(docs: DataFrame, model: LanguageModel, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, lang_pred, score) of every whole text; `und` with score 0 where there is no letter, or no model.

    The score is the softmax over languages of the summed log scores over the root of the number of words. Ties go
    to the first language by name. Repeated rows repeat the result; other columns are ignored.
    """
    return docs.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).alias("text")).mapInArrow(
        _predict(model), "doc_id bigint, lang_pred string, score double")


def language_query(docs: DataFrame) -> DataFrame:
    """Documents whose hash leaves 2 by 4 are held out of the fit."""
    held_out = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(4)) == 2
    model = fit_language_model(docs.filter(~held_out))
    return identify(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
