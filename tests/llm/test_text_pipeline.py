"""The pipeline on the small tables, and the SQL checks."""

import duckdb
from pyspark.sql import functions as F

import corpus_pipeline
from demoflux.llm import mixing, secret_scan
from demoflux.llm.queries import CHECKS, QUERIES


def test_stages_keep_columns_and_take_effect(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.store(stage(spark, docs, folder), name)
        assert docs.columns == columns
        counts.append(docs.count())
    assert counts == sorted(counts, reverse=True) and counts[-1] > 0
    assert docs.select("text").distinct().count() == docs.count()
    left = secret_scan.scan_secrets(docs).filter("size(secret_spans) > 0").count()
    assert left == 0
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, folder)
    assert packed.select("doc_id").distinct().count() == docs.count()


def test_mixing_stage_meets_share_and_margins_without_repeats(spark):
    # most of the tokens come from one source, so small sources would be wanted more than once
    def row(i):
        text = "one two three four" + (" ***" if i % 40 == 0 else " five")
        return i, text, "de" if i % 7 == 0 else "en", "hot" if i % 20 else f"s{i // 20 % 3}", 20

    rows = [row(i) for i in range(12000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    kept = corpus_pipeline.mix_sources(spark, docs, "").toPandas()
    assert kept.doc_id.is_unique
    assert abs(len(kept) / 12000 - 0.8) < 0.01
    weights = mixing.query_mix(docs, once=True).toPandas()
    weights["expected"] = weights.mix_weight * mixing.SHARE * weights.n_tokens
    assert (weights.mix_weight * mixing.SHARE <= 1 + 1e-9).all()
    total = weights.n_tokens.sum()
    assert abs(weights.expected.sum() / total - 0.8) < 1e-6
    for margin, alpha in mixing.MARGINS.items():
        natural = weights.groupby(margin).n_tokens.sum() / total
        target = natural ** alpha / (natural ** alpha).sum()
        goal = (target * 0.8).clip(upper=natural)
        while 0.8 - goal.sum() > 1e-12:  # what used up values can't give, the others give by their targets
            free = goal < natural
            goal[free] = (target[free] * (0.8 - goal[~free].sum()) / target[free].sum()).clip(upper=natural[free])
        found = weights.groupby(margin).expected.sum() / total
        assert (found - goal).abs().max() < 1e-3
        drawn = weights[weights.copies > 0].groupby(margin).n_tokens.sum() / total
        assert (drawn - goal).abs().max() < 0.01
    assert set(kept.doc_id) == set(weights[weights.copies > 0].doc_id)


def test_stages_on_odd_rows_and_clashing_columns(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(60)
    names = ["topic", "n_tokens", "masked", "secret_spans", "base_spans", "score", "predicted", "copies", "mix_weight", "class", "row"]
    odd = spark.createDataFrame(
        [(None, None, None, None, None), (900001, "", "en", None, 0), (900002, "w " * 60_000, None, "s", 120_000),
         (900003, "same text here for all of us", "en", "s", 28), (900003, "same text here for all of us", "en", "s", 28),
         (900004, "password = abcdEFGH12345678", "en", "s", 27)], docs.schema)
    rows = docs.unionAll(odd).withColumns({n: F.concat(F.lit(f"{n}-"), F.coalesce("doc_id", F.lit(-1)).cast("string")) for n in names})
    columns, kept = rows.columns, {r["doc_id"]: r for r in rows.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        rows = corpus_pipeline.store(stage(spark, rows, folder), name)
        assert rows.columns == columns
        found = rows.collect()
        assert all(r[n] == kept[r["doc_id"]][n] for r in found for n in names)
        if name == "near_dedup":
            assert sum(r["doc_id"] == 900003 for r in found) == 1 and {None, 900001, 900002} <= {r["doc_id"] for r in found}
        if name == "secrets":
            masked = [r for r in found if r["doc_id"] == 900004][0]
            assert "abcd" not in masked["text"] and masked["n_chars"] == len(masked["text"])
    empty = spark.createDataFrame([], spark.read.parquet(f"{folder}/documents.parquet").schema)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, folder).count() == 0


def test_sql_checks(spark, folder):
    connection = duckdb.connect()
    for name in ("embeddings", "pages", "documents", "benchmark"):
        connection.execute(f"create view {name} as select * from read_parquet('{folder}/{name}.parquet')")
    for name, sql in CHECKS.items():
        got = QUERIES[name](spark, folder)
        expected = connection.execute(sql).fetchall()
        places = [d[0] for d in connection.description]
        assert sorted(map(repr, map(tuple, got.select(*places).collect()))) == sorted(map(repr, expected))
