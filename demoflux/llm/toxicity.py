"""Toxicity by weak supervision: many voters, a label model that weighs them, and a linear classifier."""

from __future__ import annotations

import re
import string
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from demoflux.llm.common import discard, store

TRAIN_DOCS = 20_000  # labelled documents that lexicons and classifier are fitted on, about; half of them of each label
MAX_FEATURES = 1024
FOLDS = 4  # lexicon voters of each kind
LEAST_HITS, LEAST_SHARE = 5, 0.015  # toxic documents that a lexicon entry must occur in, as number and as share
PRECISION = 0.97  # part of an entry's documents that must be toxic, by the weights of the labels
CACHED_TOKENS = 300_000
START = -3.0  # the classifier's constant before fitting: without examples nothing is toxic

#: Common insults in four languages, as published word lists have them.
INSULTS = (
    "idiot idiots moron morons stupid loser losers scum trash pathetic worthless disgusting clown dumb imbecile jerk bastard "
    "fool ugly filthy vermin "
    "idioten dumm dummkopf blöd arschloch trottel abschaum versager schwein dreckig widerlich "
    "idiote idiots stupide connard imbécile crétin salaud ordure minable dégoûtant pourriture "
    "idiota estúpido estúpida imbécil basura asqueroso cabrón gilipollas inútil escoria payaso"
).split()
#: Pattern voters: a word with masked letters, several exclamation marks, a text in capitals.
MASKED = re.compile(r"[^\W\d_][*#@$]{2,}[^\W\d_]")


def features(token: str) -> list[str]:
    """A word and its beginnings of four to six letters, marked as such."""
    word = token.strip(string.punctuation)
    return [word, *(f"{word[:n]}-" for n in (4, 5, 6) if len(word) > n)] if word else []


def patterns(text: str) -> int:
    """Votes of the pattern voters, as bits."""
    return bool(MASKED.search(text)) | ("!!!" in text) << 1 | text.isupper() << 2


PATTERNS = 3


@dataclass
class Voters:
    """Lexicons by entry: the voters, as bits, that an entry makes vote; and the classifier's features."""

    lexicon: dict[str, int]
    feature: dict[str, int]
    count: int = field(default=PATTERNS + 1 + 2 * FOLDS)

    def token(self, token: str) -> tuple[int, tuple[int, ...]]:
        votes, found = 0, []
        for f in features(token):
            votes |= self.lexicon.get(f, 0)
            if f in self.feature:
                found.append(self.feature[f])
        return votes, tuple(found)


def read_text(voters: Voters, known: dict[str, tuple | None], text: str) -> tuple[int, set[int]]:
    """Votes on a text, and the features that it has."""
    tokens = set(text.lower().split())
    new = tokens.difference(known)
    if len(known) + len(new) > CACHED_TOKENS:
        known.clear()
        new = tokens
    for token in new:
        entry = voters.token(token)
        known[token] = entry if entry[0] or entry[1] else None
    votes, found = patterns(text), set()
    for hit in [h for t in tokens if (h := known[t]) is not None]:
        votes |= hit[0]
        found.update(hit[1])
    return votes, found


def _count_features(labels: dict[int, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = Counter(), Counter()
        split: dict[str, list[str]] = {}
        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1)):
                label = labels.get(doc_id.as_py())
                if label is None:
                    continue
                tokens = set((text.as_py() or "").lower().split())
                if len(split) > CACHED_TOKENS:
                    split.clear()
                found: set[str] = set()
                for t in tokens:
                    if t not in split:
                        split[t] = features(t)
                    found.update(split[t])
                counts[label].update(found)
                counts[label][""] += 1  # no feature is empty: the number of rows, which may repeat
        names = list(counts[0].keys() | counts[1].keys())
        yield pa.RecordBatch.from_arrays(
            [pa.array(names, pa.string()), *[pa.array([c[n] for n in names], pa.int64()) for c in counts]],
            names=["feature", "clean", "toxic"])

    return run


def contrast(clean: Column, toxic: Column, n_clean: int, n_toxic: int) -> Column:
    """How many standard deviations the rates of a feature in toxic and clean documents are apart."""
    apart = F.abs((toxic + 0.5) / (n_toxic + 1) - (clean + 0.5) / (n_clean + 1))
    pooled = (toxic + clean + 1) / (n_toxic + n_clean + 2)
    return apart / F.sqrt(pooled * (1 - pooled) * (1 / (n_toxic + 1) + 1 / (n_clean + 1)))


def is_entry(clean: Column, toxic: Column, n_toxic: int, weights: tuple[float, float]) -> Column:
    """Whether a feature may stand in a lexicon: it is in enough toxic documents and in hardly any clean ones."""
    heavy = toxic * F.lit(weights[1])
    return (toxic >= F.lit(max(LEAST_HITS, LEAST_SHARE * n_toxic))) & (heavy >= F.lit(PRECISION) * (heavy + clean * F.lit(weights[0])))


def build_voters(entries: list[str], seen: list[str]) -> Voters:
    """Lexicons of the entries, dealt into voters by a hash, and the features that the classifier sees."""
    lexicon = {w: 1 << PATTERNS for w in INSULTS}
    for name in entries:
        fold = xxh3_64_intdigest(name) % FOLDS + (FOLDS if name.endswith("-") else 0)
        lexicon[name] = lexicon.get(name, 0) | 1 << (PATTERNS + 1 + fold)
    return Voters(lexicon, {name: i for i, name in enumerate(seen)})


@dataclass
class LabelModel:
    """P(toxic | votes) from each voter's rates in either class, with voters that repeat each other weighed down."""

    prior: float
    rates: np.ndarray  # of votes: row 0 in clean documents, row 1 in toxic ones
    correlation: np.ndarray  # of voters within the classes
    weight: np.ndarray
    shift: float = 0.0
    scale: float = 1.0

    def log_odds(self, votes: np.ndarray) -> np.ndarray:
        clean, toxic = self.rates
        ratio = votes @ (self.weight * np.log(toxic / clean)) + (1 - votes) @ (self.weight * np.log((1 - toxic) / (1 - clean)))
        return np.log(self.prior / (1 - self.prior)) + ratio

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.shift + self.scale * self.log_odds(votes), -500, 500)))


def as_votes(masks: np.ndarray, voters: int) -> np.ndarray:
    return ((masks[:, None] >> np.arange(voters)) & 1).astype(float)


def fit_label_model(masks: np.ndarray, labels: np.ndarray, counts: np.ndarray, voters: int, rounds: int = 50) -> LabelModel:
    """Expectation-maximisation over distinct vote vectors.

    `labels` is 0, 1, or -1 where no label is known; known labels stay fixed. In each round the class rates
    and the correlations of voters within a class are estimated, and a voter counts 1 / (1 + the sum
    of its correlations with the others), so that copies of a voter together count once.
    """
    votes = as_votes(masks, voters)
    known = labels >= 0
    toxic = (counts * (labels == 1)).sum()
    prior = float((toxic + 1) / ((counts * known).sum() + 2))
    model = LabelModel(prior, np.stack([np.full(voters, 0.02), np.full(voters, 0.4)]), np.eye(voters), np.ones(voters))
    for _ in range(rounds):
        p = np.where(known, labels, model.posterior(votes))
        share = np.stack([(1 - p) * counts, p * counts])
        totals = share.sum(axis=1, keepdims=True)
        rates = (share @ votes + np.array([[0.01], [0.5]])) / (totals + 1.0)
        spread = sum((share[c][:, None] * (votes - rates[c])).T @ (votes - rates[c]) for c in (0, 1)) / max(1.0, totals.sum())
        scale = np.sqrt(np.maximum(np.diag(spread), 1e-12))
        correlation = np.clip(spread / np.outer(scale, scale), -1, 1)
        weight = 1 / (1 + np.clip(correlation - np.eye(voters), 0, 1).sum(axis=1))
        moved = np.abs(rates - model.rates).max()
        model = LabelModel(prior, np.clip(rates, 1e-6, 1 - 1e-6), correlation, weight)
        if moved < 1e-7:
            break
    return model


def calibrated(model: LabelModel, masks: np.ndarray, labels: np.ndarray, counts: np.ndarray, rounds: int = 50) -> LabelModel:
    """The model with its log odds shifted and scaled to the known labels.

    Weighing voters down by all their correlations leaves a text with few votes too doubtful. A logistic curve over
    the distinct labelled vote vectors sets that right; a weak pull to the uncalibrated odds holds where labels say little.
    """
    known = labels >= 0
    odds = np.clip(model.log_odds(as_votes(masks[known], len(model.weight))), -30, 30)
    design = np.stack([np.ones(len(odds)), odds], axis=1)
    start = at = np.array([0.0, 1.0])
    pull = 0.1 * np.eye(2)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(design @ at, -500, 500)))
        gradient = design.T @ (counts[known] * (labels[known] - p)) - pull @ (at - start)
        curvature = (design * (counts[known] * p * (1 - p))[:, None]).T @ design + pull
        step = np.linalg.solve(curvature, gradient)
        at = at + step / max(1.0, np.abs(step).max())
        if np.abs(step).max() < 1e-8:
            break
    if at[1] <= 0:  # labels that contradict the voters: leave the order of the posteriors alone
        at = start
    return LabelModel(model.prior, model.rates, model.correlation, model.weight, float(at[0]), float(at[1]))


def fit_classifier(
    rows: list[list[int]], target: np.ndarray, importance: np.ndarray, size: int, penalty: float = 1e-4, rounds: int = 300,
) -> np.ndarray:
    """Weights of a logistic regression on present features, the constant last, with an L1 penalty on all but the constant.

    Accelerated proximal gradient steps on soft targets; `importance` is the number of documents that a row stands for.
    """
    n = len(rows)
    importance = importance / importance.mean() if n else importance
    lengths = np.array([len(r) for r in rows], np.int64)
    columns = np.fromiter((c for r in rows for c in r), np.int64, lengths.sum())
    owner = np.repeat(np.arange(n), lengths)
    usual = np.average(lengths, weights=importance) if n else 0.0
    step = 4.0 / (1.0 + usual + np.sqrt(np.average((lengths - usual) ** 2, weights=importance))) if n else 1.0
    weights = ahead = np.append(np.zeros(size), START)
    momentum = 1.0
    for _ in range(rounds if n else 0):
        logits = np.bincount(owner, ahead[columns], n) + ahead[-1]
        error = importance * (1 / (1 + np.exp(-np.clip(logits, -500, 500))) - target)
        gradient = np.append(np.bincount(columns, error[owner], size), error.sum()) / n
        following = ahead - step * gradient
        following[:-1] = np.sign(following[:-1]) * np.maximum(np.abs(following[:-1]) - step * penalty, 0)
        faster = (1 + np.sqrt(1 + 4 * momentum ** 2)) / 2
        ahead = following + (momentum - 1) / faster * (following - weights)
        weights, momentum = following, faster
    return weights


def _vote(voters: Voters, labels: dict[int, int]):
    """Task: votes on each text, and its features where it has a label."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict = {}
        for batch in batches:
            masks, marks, rows = [], [], []
            for doc_id, text in zip(batch.column(0), batch.column(1)):
                votes, found = read_text(voters, known, text.as_py() or "")
                label = labels.get(doc_id.as_py(), -1)
                masks.append(votes)
                marks.append(label)
                rows.append(sorted(found) if label >= 0 else None)
            yield pa.RecordBatch.from_arrays(
                [pa.array(masks, pa.int32()), pa.array(marks, pa.int32()), pa.array(rows, pa.list_(pa.int32()))],
                names=["mask", "label", "features"])

    return run


@dataclass
class ToxicityModel:
    voters: Voters
    label_model: LabelModel
    weights: np.ndarray


def label_shares(n_clean: int, n_toxic: int, train_docs: int) -> tuple[float, float]:
    """The parts of the clean and of the toxic documents to learn from: half of the places each, and what the other leaves."""
    places = train_docs / 2
    of_clean = min(n_clean, max(places, train_docs - n_toxic))
    of_toxic = min(n_toxic, max(places, train_docs - n_clean))
    return of_clean / max(1, n_clean), of_toxic / max(1, n_toxic)


def fit_toxicity(
    docs: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS, max_features: int = MAX_FEATURES,
) -> ToxicityModel:
    """Fit voters, label model and classifier on `docs` (doc_id, text) and `labels` (doc_id, toxic).

    Lexicons and classifier are fitted on about `train_docs` labelled rows, picked by a hash of doc_id: that
    parameter bounds what the driver holds. Half of the places go to each label, and what one label leaves goes to the other,
    so rare toxic rows are learned on a corpus of any size. A picked row weighs what it stands for: the label's documents
    over those picked of it. Every feature that qualifies is a lexicon entry; there are few, as each is in 1.5 % of the picked
    toxic rows. The classifier sees the `max_features` of highest contrast. The label model sees the votes on every row of `docs`, as
    counts of distinct vote vectors, of which there are at most 2 to the number of voters. A doc_id that has
    several labels counts as toxic if one of them says so; rows without doc_id or label teach nothing.
    """
    spark = docs.sparkSession
    marked = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).groupBy(
        F.col("doc_id").cast("bigint").alias("doc_id")).agg((F.max("toxic") > 0).alias("toxic"))
    sizes = {r["toxic"]: r["count"] for r in marked.groupBy("toxic").count().collect()}
    shares = label_shares(sizes.get(False, 0), sizes.get(True, 0), train_docs)
    limit = F.when(F.col("toxic"), F.lit(int(shares[1] * (1 << 40)))).otherwise(F.lit(int(shares[0] * (1 << 40))))
    picked = F.pmod(F.xxhash64("doc_id", F.lit("toxic")), F.lit(1 << 40)) < limit
    known = {r["doc_id"]: int(r["toxic"]) for r in marked.filter(picked).collect()}
    picked_toxic = sum(known.values())
    weights = sizes.get(False, 0) / max(1, len(known) - picked_toxic), sizes.get(True, 0) / max(1, picked_toxic)
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    # as many ids as `train_docs` bounds
    ids = F.broadcast(spark.createDataFrame([(i,) for i in known], "doc_id bigint"))
    counted = texts.join(ids, "doc_id", "left_semi").mapInArrow(_count_features(known), "feature string, clean bigint, toxic bigint")
    counts = store(counted.groupBy("feature").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")), "features")
    rows = counts.filter("feature = ''").first()
    n_clean, n_toxic = (rows["clean"], rows["toxic"]) if rows else (0, 0)
    told = counts.filter("feature <> ''")
    apart = contrast(F.col("clean"), F.col("toxic"), n_clean, n_toxic)
    seen = [r["feature"] for r in told.orderBy(apart.desc(), "feature").limit(max_features).select("feature").collect()]
    entries = [r["feature"] for r in told.filter(is_entry(F.col("clean"), F.col("toxic"), n_toxic, weights)).select("feature").collect()]
    discard(counts)
    voters = build_voters(entries, seen)
    votes = store(texts.mapInArrow(_vote(voters, known), "mask int, label int, features array<int>"), "votes")
    vectors = np.array([tuple(r) for r in votes.groupBy("mask", "label").count().collect()], np.int64).reshape(-1, 3)
    vectors = vectors[:, 0], vectors[:, 1], vectors[:, 2] * np.array([*weights, 1.0])[vectors[:, 1]]
    label_model = calibrated(fit_label_model(*vectors, voters.count), *vectors)
    sample = votes.filter("label >= 0").select("mask", "label", "features").collect()
    target = label_model.posterior(as_votes(np.array([r["mask"] for r in sample], np.int64), voters.count))
    importance = np.array([weights[r["label"]] for r in sample], float)
    fitted = fit_classifier([r["features"] for r in sample], target, importance, len(voters.feature))
    discard(votes)
    return ToxicityModel(voters, label_model, fitted)


def toxicity_score(model: ToxicityModel, text: str = "text") -> Column:
    """The classifier's probability that a whole text is toxic; a missing text scores as an empty one."""
    weights, constant = model.weights[:-1], float(model.weights[-1])
    voters = Voters({}, {name: i for name, i in model.voters.feature.items() if weights[i]})

    @F.pandas_udf("double")
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known: dict = {}
        for part in texts:
            logits = [constant + float(weights[sorted(read_text(voters, known, t or "")[1])].sum()) for t in part]
            yield pd.Series(1 / (1 + np.exp(-np.clip(np.array(logits, float), -500, 500))))

    return score(text)


def score_toxicity(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """The rows of `docs` with `score`, from the whole text alone, and `predicted`, 1 for a score of at least a half.

    Columns of these names are replaced, others are left alone. Repeated rows repeat the result; an empty table gives an
    empty one.
    """
    return docs.withColumn("score", toxicity_score(model)).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def held_out() -> Column:
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(5)) == 0


def query_model(docs: DataFrame, labels: DataFrame) -> ToxicityModel:
    """The model of the query and the pipeline: rows whose hash leaves 0 by 5 are held out of all fitting."""
    return fit_toxicity(docs.filter(~held_out()), labels.filter(~held_out()))


def toxicity_query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    scored = score_toxicity(docs.select("doc_id", "text"), query_model(docs, labels))
    return scored.select("doc_id", held_out().alias("held_out"), "score", "predicted")
