"""The engine's queries over the test tables; each reads its tables whole.

The mapping of roles to tables: documents are the articles and ``lang`` their
class, ``labels`` covers part of them, embeddings are dense vectors, events are
calls with a latency, an outcome and a time, conversations are requests.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from signpost.functions import text as tx
from signpost.functions import vectors as vx
from signpost.operators import articles as ar
from signpost.operators import costs as co
from signpost.operators import distances as di
from signpost.operators import embed as em
from signpost.operators import inference as inf
from signpost.operators import quality as qu
from signpost.operators import ranking as rk
from signpost.operators import retries
from signpost.operators import routes as ro
from signpost.operators import routing as rt
from signpost.operators import runs as ru
from signpost.operators import thresholds as th
from signpost.functions.scoring import token_cost
from signpost.operators.lookup import rows_by_id
from signpost.plans import batch_inference as bi
from signpost.plans import router as pr
from signpost.plans import saved_runs as sr
from signpost.plans.comparison import compare_stored_runs
from signpost.session import materialize, shared_folder, spread
from signpost.sources import articles as sa
from signpost.sources import route_store as rs
from signpost.sources import run_store as st
from signpost.sources import vector_cache as vc
from signpost.sources.run_catalogue import read_catalogue

CLASSES = ["en", "de", "es", "fr"]
SAMPLES = 50
THRESHOLD = 0.6
BATCH = 10
OVERRIDES = {"en": 0.57, "de": 0.65, "FR": 0.5, "xx": 0.4}
DENSE_SAMPLES = 20
BALL_CELLS = 2_000  # so few that the index is used at every scale
DENSE_THRESHOLDS = {"avg": 0.95, "min": 0.66}

# one model per document source or language, the last one not in the catalogue
SOURCE_MODELS = [m[0] for m in co.MODELS] + ["house-embedder"]
LANG_MODELS = {
    "en": "text-embedding-3-small",
    "fr": "text-embedding-3-large",
    "de": "sentence-transformers/all-MiniLM-L6-v2",
    "es": "house-embedder",
}

MESSAGES = [
    "Rate limit reached for requests",
    "HTTP 429 timeout while waiting",
    "Request timed out after 30 s",
    "Connection reset by peer",
    "Network is unreachable",
    "upstream returned 503",
    "prompt has max 1500 tokens",
    "401 Unauthorized",
    "HTTP 404 no such model",
    "could not parse reply",
    "Invalid JSON in reply",
    "something odd happened",
]


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _documents(spark: SparkSession, sf: str) -> DataFrame:
    """Documents for work that is heavy per row."""
    return spread(_table(spark, sf, "documents"), "doc_id")


def _rounded(df: DataFrame, digits: int, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, digits) for n in names})


# -- article preparation ---------------------------------------------------------


def labeled_articles(spark: SparkSession, sf: str) -> DataFrame:
    articles = _table(spark, sf, "documents").withColumnRenamed("doc_id", "article_id")
    labels = _table(spark, sf, "labels").select(
        F.col("doc_id").alias("article_id"),
        F.when(F.col("quality") == 1, "good").otherwise("poor").alias("label"),
    )
    return ar.labeled_articles(articles, labels)


def dedupe_text(spark: SparkSession, sf: str) -> DataFrame:
    return ar.dedupe_text(_table(spark, sf, "documents")).select(
        "doc_id", "lang", "source", "n_chars"
    )


def stratified_split(spark: SparkSession, sf: str) -> DataFrame:
    unique = ar.dedupe_text(_table(spark, sf, "documents")).select("doc_id", "lang")
    # three narrow passes follow; the digests are made once
    return ar.stratified_split(materialize(unique)).select("doc_id", "lang", "split")


def sample_per_class(spark: SparkSession, sf: str) -> DataFrame:
    return ar.sample_per_class(_table(spark, sf, "documents"), SAMPLES)


def fixed_batches(spark: SparkSession, sf: str) -> DataFrame:
    return ar.fixed_batches(_table(spark, sf, "documents"), BATCH)


def reference_text(spark: SparkSession, sf: str) -> DataFrame:
    return ar.reference_texts(_table(spark, sf, "documents"))


def token_estimate(spark: SparkSession, sf: str) -> DataFrame:
    return _documents(spark, sf).select(
        "doc_id",
        tx.word_count(F.col("text")).alias("words"),
        tx.token_estimate(F.col("text")).alias("tokens"),
    )


# -- embedding, routes, routing --------------------------------------------------


def embed_hashed(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(em.vector_rows(em.embed_hashed(_documents(spark, sf))), 9, "v")


def _references(spark: SparkSession, sf: str) -> DataFrame:
    return ro.route_references(_table(spark, sf, "documents"), SAMPLES)


def route_centroids(spark: SparkSession, sf: str) -> DataFrame:
    embedded = em.embed_hashed(_references(spark, sf), "ref_text")
    return _rounded(ro.centroid_rows(embedded), 9, "v")


def route_summary(spark: SparkSession, sf: str) -> DataFrame:
    return ro.route_summary(
        _table(spark, sf, "documents"), _references(spark, sf), THRESHOLD
    ).select(
        "route",
        "total",
        "references_count",
        "threshold",
        F.col("metadata")["samples_count"].alias("samples_count"),
    )


def threshold_overrides(spark: SparkSession, sf: str) -> DataFrame:
    routes = ro.route_summary(_table(spark, sf, "documents"), _references(spark, sf), THRESHOLD)
    before = routes.withColumn("old_threshold", F.col("threshold"))
    changed = ro.override_thresholds(before, ro.overrides_frame(spark, OVERRIDES))
    return changed.select("route", "old_threshold", F.col("threshold").alias("new_threshold"))


def _routed(spark: SparkSession, sf: str, agg: str) -> DataFrame:
    docs = _documents(spark, sf)
    routes = pr.train_router(_table(spark, sf, "documents"), SAMPLES, THRESHOLD, agg)
    return pr.classify(docs, routes, CLASSES)


def _route_columns(df: DataFrame) -> DataFrame:
    return _rounded(
        df.select("doc_id", "lang", "prediction", "distance", "confidence", "is_fallback"),
        9,
        "confidence",
    )


def route_avg(spark: SparkSession, sf: str) -> DataFrame:
    return _route_columns(_routed(spark, sf, "avg"))


def route_min(spark: SparkSession, sf: str) -> DataFrame:
    return _route_columns(_routed(spark, sf, "min"))


def unrouted_articles(spark: SparkSession, sf: str) -> DataFrame:
    docs = em.embed_hashed(_documents(spark, sf))
    routes = pr.train_router(_table(spark, sf, "documents"), SAMPLES, THRESHOLD)
    return rt.unrouted(rt.with_best_route(di.candidate_routes(docs, routes)))


def _dense_articles(spark: SparkSession, sf: str) -> DataFrame:
    vectors = spread(_table(spark, sf, "embeddings"), "vec_id")
    return vectors.select("vec_id", vx.unit_dense(F.col("embedding")).alias("vec"))


def _dense_routes(spark: SparkSession, sf: str, agg: str, threshold: float) -> DataFrame:
    """The first vectors of each label by id are its references."""
    vectors = _table(spark, sf, "embeddings")
    picked = materialize(
        rk.top_n_per_group(
            vectors.select("vec_id", "label"), ["label"], [F.col("vec_id")], DENSE_SAMPLES
        )
    )
    references = rows_by_id(vectors, picked.select("vec_id"), "vec_id").select(
        F.col("label").cast("string").alias("route"),
        F.col("vec_id").alias("ref_id"),
        vx.unit_dense(F.col("embedding")).alias("vec"),
    )
    return ro.build_dense_routes(references, threshold, agg)


def route_dense(spark: SparkSession, sf: str) -> DataFrame:
    def routed(agg: str) -> DataFrame:
        routes = _dense_routes(spark, sf, agg, DENSE_THRESHOLDS[agg])
        best = rt.with_best_route(
            di.candidate_routes(_dense_articles(spark, sf), routes, "vec_id", sparse=False)
        )
        return best.select(
            "vec_id",
            F.lit(agg).alias("agg"),
            "route",
            "distance",
            F.round(F.coalesce(vx.confidence(F.col("distance")), F.lit(0.0)), 9).alias(
                "confidence"
            ),
        ).withColumn("confidence", F.when(rt.is_matched(), F.col("confidence")).otherwise(0.0))

    return routed("avg").unionByName(routed("min"))


def topk_routes(spark: SparkSession, sf: str) -> DataFrame:
    routes = _dense_routes(spark, sf, "avg", DENSE_THRESHOLDS["avg"])
    ranked = di.candidate_routes(
        _dense_articles(spark, sf), routes, "vec_id", k=3, within_threshold=False, sparse=False
    )
    return rt.top_routes(ranked)


def prediction_fallback(spark: SparkSession, sf: str) -> DataFrame:
    """Predictions in mixed case, missing, "na" and unknown."""
    raw = (
        F.when(F.col("quality").isNull(), F.lit(None).cast("string"))
        .when(F.col("toxic") == 1, "NA")
        .when(F.col("quality") == 0, F.col("source"))
        .otherwise(F.initcap("lang"))
    )
    rows = (
        _table(spark, sf, "documents")
        .select("doc_id", "lang", "source")
        .join(_table(spark, sf, "labels"), "doc_id", "left")
        .withColumn("raw", raw)
    )
    return rt.apply_fallback(rows, CLASSES, "raw", F.lit(0.9)).select(
        "doc_id", "raw", "prediction", "confidence", "is_fallback"
    )


def _sides(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The train side (doc_id, lang), the validation side with its texts, and the ids that count.

    Documents are marked in place. Duplicates among the validation texts are left out after
    their distances are taken, so no text is moved for it.
    """
    unique = materialize(ar.dedupe_text(_table(spark, sf, "documents")).select("doc_id", "lang"))
    cuts = ar.split_cuts(unique)
    train = ar.mark_split(unique, cuts).filter(F.col("split") == "train").drop("split")
    marked = ar.mark_split(_documents(spark, sf), cuts).filter(F.col("split") == "validation")
    return train, marked, unique.select("doc_id")


def _calibration_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Distances of the validation side to routes sampled from the train side."""
    train, validation, unique = _sides(spark, sf)
    routes = pr.train_router(train, SAMPLES, THRESHOLD, texts=_table(spark, sf, "documents"))
    rows = di.distance_rows(em.embed_hashed(validation), routes, keep=["lang"])
    return rows.join(unique, "doc_id", "left_semi")


def threshold_sweep(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(
        th.threshold_sweep(_calibration_rows(spark, sf), "lang"), 9, "precision", "recall", "f1"
    )


def best_thresholds(spark: SparkSession, sf: str) -> DataFrame:
    sweep = th.threshold_sweep(_calibration_rows(spark, sf), "lang")
    return _rounded(th.best_thresholds(sweep), 9, "f1")


def trained_thresholds(spark: SparkSession, sf: str) -> DataFrame:
    """Training as a whole: split, sample, embed, calibrate, override."""
    train, validation, unique = _sides(spark, sf)
    routes = pr.train_router(
        train,
        SAMPLES,
        THRESHOLD,
        calibration=validation,
        overrides=OVERRIDES,
        texts=_table(spark, sf, "documents"),
        calibration_ids=unique,
    )
    return routes.select("route", "threshold")


def exact_thresholds(spark: SparkSession, sf: str) -> DataFrame:
    """Per route the best of all thresholds, not of a hundred steps."""
    counts = th.exact_counts(_calibration_rows(spark, sf), "lang")
    return _rounded(th.best_thresholds(counts.filter("threshold <= 1")), 9, "f1")


def nearest_references(spark: SparkSession, sf: str) -> DataFrame:
    """The three nearest of all vectors, each a route of its own, for every vector; by the index of balls."""
    every = _dense_articles(spark, sf)
    name = F.lpad(F.col("vec_id").cast("string"), 12, "0")
    routes = materialize(every.select(name.alias("route"), F.lit(2.0).alias("threshold"), "vec"))
    ranked = di.candidate_routes(
        every, routes, "vec_id", k=3, within_threshold=False, sparse=False, max_cells=BALL_CELLS
    )
    return rt.top_routes(ranked)


def router_info(spark: SparkSession, sf: str) -> DataFrame:
    info = ro.router_info(pr.train_router(_table(spark, sf, "documents"), SAMPLES, THRESHOLD, "min"))
    return info.select(
        "route",
        "references_count",
        "threshold",
        F.col("metadata")["category"].alias("category"),
        F.col("metadata")["samples_count"].alias("samples_count"),
    )


def _store(spark: SparkSession) -> str:
    """A new folder in the shared folder."""
    return f"{shared_folder(spark)}/signpost/store-{uuid.uuid4().hex}"


def stored_routes(spark: SparkSession, sf: str) -> DataFrame:
    """A route table written twice: who loaded the first snapshot still reads it after the second write."""
    path = f"{_store(spark)}/routes"
    routes = pr.train_router(_table(spark, sf, "documents"), SAMPLES, THRESHOLD, "min")
    rs.save_routes(routes, path)
    first = rs.load_routes(spark, path)
    rs.save_routes(ro.override_thresholds(first, ro.overrides_frame(spark, OVERRIDES)), path)
    now = rs.load_routes(spark, path)
    both = first.withColumn("snapshot", F.lit("first")).unionByName(now.withColumn("snapshot", F.lit("current")))
    return both.groupBy("snapshot", "route").agg(
        F.max("threshold").alias("threshold"), F.sum("references_count").alias("references_count")
    )


def _letter_embedder():
    """A model by rule: how often a text has a, e, n and a blank, and one."""

    def embed(texts):
        import numpy as np

        return np.array([[1, *(t.count(c) for c in "aen ")] for t in texts], dtype="float64")

    return embed


def cached_embeddings(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors of all documents by content: every different text is embedded once, then looked up."""
    path = f"{_store(spark)}/vectors"
    texts = _table(spark, sf, "documents").select("doc_id", "text")
    embedded = vc.embed_cached(texts, lambda: _letter_embedder(), path, "letters")
    rows = embedded.select("doc_id", F.posexplode("vec").alias("dim", "v"))
    return _rounded(rows.withColumn("dim", F.col("dim").cast("bigint")), 9, "v")


# -- batches of model calls ------------------------------------------------------


def prompt_batches(spark: SparkSession, sf: str) -> DataFrame:
    return inf.ordered_prompts(_table(spark, sf, "documents"), BATCH, CLASSES).drop("article_ids")


def _reply_members(spark: SparkSession, sf: str) -> DataFrame:
    docs = _table(spark, sf, "documents")
    return ar.fixed_batches(docs, BATCH).join(
        docs.select("doc_id", "lang", "source", "n_chars"), "doc_id"
    )


def _reply_text(members: Column) -> Column:
    """Replies of six kinds, by batch: both forms, repeats, gaps, broken and free text."""

    def objects(render: Callable[[Column], Column], kept: Column = members) -> Column:
        return F.array_join(F.transform(kept, render), ", ")

    def quoted(text: Column) -> Column:
        return F.concat(F.lit('"'), text, F.lit('"'))

    def form_a(m: Column, category: Column) -> Column:
        return F.concat(
            F.lit('{"article_id": '), m["doc_id"].cast("string"), F.lit(', "category": '),
            quoted(category), F.lit("}"),
        )

    def form_b(m: Column, category: Column) -> Column:
        return F.concat(
            F.lit('{ "category": '), category, F.lit(', "article_id": '),
            m["doc_id"].cast("string"), F.lit("}"),
        )

    def listed(body: Column, end: str) -> Column:
        return F.concat(F.lit('Here:\n{"classifications": ['), body, F.lit(end))

    kind = F.col("batch_id") % 6
    long_text = lambda m: m["n_chars"] > 2000
    return (
        F.when(kind == 0, F.concat(F.lit("Done.\n"), objects(lambda m: form_a(m, m["lang"]))))
        .when(
            kind == 1, listed(objects(lambda m: form_b(m, quoted(F.upper(m["lang"])))), "]}\nEnd")
        )
        .when(
            kind == 2,
            F.concat(
                objects(
                    lambda m: form_a(m, F.when(long_text(m), "unknown").otherwise(m["lang"]))
                ),
                F.lit("\n"),
                objects(lambda m: form_a(m, F.lit("fr"))),
            ),
        )
        .when(kind == 3, listed(objects(lambda m: form_b(m, quoted(m["lang"]))), ""))
        .when(kind == 4, F.lit("No category fits these articles."))
        .otherwise(
            listed(
                objects(
                    lambda m: form_b(
                        m, F.when(long_text(m), F.lit("null")).otherwise(quoted(m["lang"]))
                    ),
                    F.filter(members, lambda m: m["source"] != "src3"),
                ),
                "]}",
            )
        )
    )


def _replies(members: DataFrame) -> DataFrame:
    grouped = members.groupBy("batch_id").agg(
        F.sort_array(F.collect_list(F.struct("idx", "doc_id", "lang", "source", "n_chars"))).alias(
            "members"
        )
    )
    return grouped.select("batch_id", _reply_text(F.col("members")).alias("reply"))


def llm_reply_parse(spark: SparkSession, sf: str) -> DataFrame:
    return inf.parse_replies(_replies(_reply_members(spark, sf)))


def llm_reply_join(spark: SparkSession, sf: str) -> DataFrame:
    members = _reply_members(spark, sf)
    parsed = inf.parse_replies(_replies(members))
    asked = members.select("batch_id", F.col("doc_id").alias("article_id"))
    return inf.join_replies(asked, parsed, CLASSES)


def _stand_in_model(classes: list[str]) -> Callable[[], inf.Complete]:
    """A model that answers by rule: the class is the id modulo five (the fifth
    is no class), and calls for some batches fail."""
    names = [*classes, "xx"]

    def factory() -> inf.Complete:
        import re

        def complete(prompt):
            ids = [int(i) for i in re.findall(r"\n\[end of text (\d+)\]", prompt)]
            if ids[0] % 70 == 30:
                raise RuntimeError("connection lost")
            reply = "\n".join(
                f'{{"article_id": {i}, "category": "{names[i % 5]}"}}' for i in ids
            )
            return reply, len(prompt.split()) * 13 // 10, len(reply.split()) * 13 // 10

        return complete

    return factory


def llm_classify(spark: SparkSession, sf: str) -> DataFrame:
    replies = bi.reply_batches(
        _table(spark, sf, "documents"), CLASSES, _stand_in_model(CLASSES), BATCH, max_retries=1
    )
    return bi.classify_with_model(replies, CLASSES).select(
        "batch_id",
        "article_id",
        "prediction",
        "is_fallback",
        "status",
        "prompt_tokens",
        "completion_tokens",
    )


def llm_run_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """All metrics of a model run but its latency, which is measured."""
    docs = _table(spark, sf, "documents")
    replies = bi.reply_batches(docs, CLASSES, _stand_in_model(CLASSES), BATCH, max_retries=1)
    labels = docs.select(F.col("doc_id").alias("article_id"), F.col("lang").alias("true_label"))
    predicted = bi.classify_with_model(replies, CLASSES).withColumn(
        "confidence", F.lit(None).cast("double")
    )
    classified = materialize(
        predicted.join(labels, "article_id").select(
            "true_label", "prediction", "confidence", "status"
        )
    )
    metrics = pr.run_metrics(bi.reply_metrics_input(replies, 0.001, 0.005), classified)
    return _rounded(metrics.filter(F.col("category") != "latency_metrics"), 9, "value")


# -- cost ------------------------------------------------------------------------


def embedding_cost(spark: SparkSession, sf: str) -> DataFrame:
    number = F.substring("source", 4, 10).cast("int")
    model = F.element_at(F.array(*[F.lit(m) for m in SOURCE_MODELS]), number % 6 + 1)
    docs = _documents(spark, sf).select("text", model.alias("model"))
    return _rounded(
        co.embedding_cost(docs), 12, "total_cost", "cost_per_text", "avg_tokens_per_text"
    )


def cost_ledger(spark: SparkSession, sf: str) -> DataFrame:
    models = F.create_map(*[F.lit(x) for pair in LANG_MODELS.items() for x in pair])
    training = co.usage_rows(
        _references(spark, sf).withColumn("model", models[F.col("route")]), "training", "ref_text"
    )
    routing = co.usage_rows(
        _documents(spark, sf).withColumn("model", models[F.col("lang")]), "classification"
    )
    return _rounded(
        co.cost_ledger(training.unionByName(routing)), 12, "cost", "avg_cost_per_call"
    )


# -- metrics ---------------------------------------------------------------------


def _event_batches(spark: SparkSession, sf: str) -> DataFrame:
    """Calls of one user and outcome form a batch; the error batches failed."""
    k = F.get_json_object("props", "$.k").cast("bigint")
    grouped = (
        _table(spark, sf, "events")
        .groupBy("user_id", "event_type")
        .agg(
            F.count(F.lit(1)).alias("batch_size"),
            F.sum("value").alias("total_latency"),
            F.sum(k).alias("prompt_tokens"),
        )
    )
    return grouped.select(
        F.concat_ws("-", F.col("user_id").cast("string"), "event_type").alias("batch_id"),
        F.when(F.col("event_type") == "error", qu.FAILED).otherwise(qu.SUCCESS).alias("status"),
        "batch_size",
        "total_latency",
        (F.col("prompt_tokens") * F.lit(0.003) / F.lit(1000.0)).alias("total_cost"),
        "prompt_tokens",
        F.col("batch_size").alias("completion_tokens"),
        (F.col("prompt_tokens") + F.col("batch_size")).alias("total_tokens"),
    )


_RATES = [
    "success_rate",
    "avg_batch_latency",
    "avg_latency_per_article",
    "cost_per_article",
    "avg_prompt_tokens_per_article",
    "avg_completion_tokens_per_article",
    "avg_tokens_per_article",
]


def batch_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(
        qu.batch_metrics(_event_batches(spark, sf)), 6, "total_latency", "total_cost", *_RATES
    )


def metric_categories(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(ru.metric_rows(qu.batch_metrics(_event_batches(spark, sf))), 6, "value")


def per_batch_rates(spark: SparkSession, sf: str) -> DataFrame:
    """A conversation is a request: its assistant turns are the answer.

    The role of a turn is the prediction, its place in the turn order the label.
    """
    turns = (
        _table(spark, sf, "conversations")
        .withColumnRenamed("conv_id", "batch_id")
        .withColumn("tokens", tx.token_estimate(F.col("text")))
        .withColumn("true_label", F.when(F.col("turn") % 2 == 0, "user").otherwise("assistant"))
        .withColumn("prediction", F.col("role"))
    )
    answer = F.col("role") == "assistant"
    spent = turns.groupBy("batch_id").agg(
        F.count(F.lit(1)).alias("batch_size"),
        F.sum(F.when(~answer, F.col("tokens")).otherwise(0)).alias("prompt_tokens"),
        F.sum(F.when(answer, F.col("tokens")).otherwise(0)).alias("completion_tokens"),
    )
    batches = spent.withColumn("total_latency", F.col("completion_tokens") * 0.02).withColumn(
        "total_cost",
        (F.col("prompt_tokens") * 0.003 + F.col("completion_tokens") * 0.015) / 1000.0,
    )
    return _rounded(
        qu.per_batch_rates(batches, turns),
        9,
        "total_latency",
        "total_cost",
        "avg_latency_per_article",
        "cost_per_article",
        "accuracy",
    )


def accuracy(spark: SparkSession, sf: str) -> DataFrame:
    labelled = _table(spark, sf, "labels").select("doc_id", F.lit(True).alias("labelled"))
    routed = _routed(spark, sf, "avg").select("doc_id", "lang", "prediction", "confidence")
    classified = routed.join(labelled, "doc_id", "left").withColumn(
        "true_label", F.when(F.col("labelled"), F.col("lang"))
    )
    return _rounded(qu.accuracy(classified), 9, "accuracy", "avg_confidence")


def confusion_matrix(spark: SparkSession, sf: str) -> DataFrame:
    return qu.confusion_matrix(_routed(spark, sf, "avg"), "lang")


def class_report(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(
        qu.class_report(confusion_matrix(spark, sf)), 9, "precision", "recall", "f1"
    )


def averaged_metrics(spark: SparkSession, sf: str) -> DataFrame:
    means = qu.averaged_metrics(qu.class_report(confusion_matrix(spark, sf)))
    return _rounded(means, 9, *means.columns)


def router_run_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """All metrics of a router run: routing, cost, quality, by category."""
    routed = _routed(spark, sf, "avg").withColumn("model", F.lit("text-embedding-3-small"))
    classified = materialize(
        co.with_token_cost(routed).select("lang", "prediction", "confidence", "tokens", "cost")
    )
    batch = pr.router_batch(classified, 0.0, classified)
    return _rounded(pr.run_metrics(batch, classified, "lang"), 9, "value")


# -- runs ------------------------------------------------------------------------


def _error_message() -> Column:
    k = F.get_json_object("props", "$.k").cast("int")
    return F.element_at(F.array(*[F.lit(m) for m in MESSAGES]), k % len(MESSAGES) + 1)


def _errors(spark: SparkSession, sf: str) -> DataFrame:
    return (
        _table(spark, sf, "events")
        .filter(F.col("event_type") == "error")
        .select("event_id", _error_message().alias("error"))
    )


def classification_report_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Routed documents in batches; a batch failed if the event of its number is an error."""
    docs = _table(spark, sf, "documents")
    # what is moved of a text is as much as the preview looks at
    routed = _routed(spark, sf, "avg").select(
        F.col("doc_id").alias("article_id"),
        "prediction",
        "lang",
        F.substring("text", 1, 101).alias("text"),
    )
    batches = ar.fixed_batches(docs, BATCH).select(
        F.col("doc_id").alias("article_id"), "batch_id"
    )
    errors = _errors(spark, sf).withColumnRenamed("event_id", "batch_id")
    labelled = _table(spark, sf, "labels").select(
        F.col("doc_id").alias("article_id"), F.lit(True).alias("labelled")
    )
    classified = (
        routed.join(batches, "article_id")
        .join(labelled, "article_id", "left")
        .join(errors, "batch_id", "left")
        .withColumn("true_label", F.when(F.col("labelled"), F.upper("lang")))
        .withColumn(
            "status", F.when(F.col("error").isNull(), qu.SUCCESS).otherwise(F.lit(qu.FAILED))
        )
    )
    return ru.classification_rows(classified)


def _event_runs(spark: SparkSession, sf: str) -> DataFrame:
    return (
        _table(spark, sf, "events")
        .groupBy(F.col("event_type").alias("result_type"), "user_id")
        .agg(F.max("ts").alias("modified_at"))
        .select(
            "result_type",
            ru.run_id(F.col("modified_at"), F.col("user_id").cast("string")).alias("run_id"),
            "modified_at",
        )
    )


def run_listing(spark: SparkSession, sf: str) -> DataFrame:
    return ru.run_listing(_event_runs(spark, sf))


def latest_run(spark: SparkSession, sf: str) -> DataFrame:
    return ru.latest_run(_event_runs(spark, sf))


_COMPARED = [
    "accuracy",
    "f1_macro",
    "f1_weighted",
    "precision_macro",
    "recall_macro",
    "total_latency",
    "avg_latency_per_article",
    "total_cost",
    "cost_per_article",
    "success_rate",
]
_TRACKED_EVENTS = [
    "total_articles",
    "success_rate",
    "total_latency",
    "avg_batch_latency",
    "avg_latency_per_article",
    "total_cost",
    "cost_per_article",
    "total_tokens",
]


def run_comparison(spark: SparkSession, sf: str) -> DataFrame:
    """The router on all references with a dear model against the one on centroids.

    The references are sampled once, and the documents are embedded once, for both. A measured
    latency is another in every run, so it is modelled: one microsecond per vector that an
    article is compared with, counted in the routes. ``stored_comparison`` has measured ones.
    """
    references = materialize(_references(spark, sf))
    narrow = _documents(spark, sf).withColumn("tokens", tx.token_estimate(F.col("text")))
    embedded = materialize(em.embed_hashed(narrow).select("doc_id", "lang", "tokens", "vec"))

    def metrics(agg: str, model: str) -> DataFrame:
        routes = ro.build_routes(references, THRESHOLD, agg)
        routed = rt.route_articles(embedded, routes, CLASSES)
        priced = routed.withColumn("cost", token_cost(F.col("tokens"), co.price_of(F.lit(model))))
        classified = materialize(priced.select("lang", "prediction", "confidence", "tokens", "cost"))
        batch = pr.router_batch(classified, 0.0, classified).withColumn(
            "total_latency", F.col("batch_size") * F.lit(routes.count()) / F.lit(1e6)
        )
        return pr.run_metrics(batch, classified, "lang")

    compared = ru.compare_runs(
        metrics("min", "text-embedding-3-large"), metrics("avg", "text-embedding-3-small"), _COMPARED
    )
    return _rounded(compared, 9, *[c for c in compared.columns if c != "metric"])


def _stored_event_runs(spark: SparkSession, sf: str) -> dict[str, str]:
    """Two committed runs: calls of users with even and with odd numbers, with their own latency and cost."""
    base = _store(spark)
    batches = _event_batches(spark, sf).withColumn(
        "_odd", F.substring_index("batch_id", "-", 1).cast("bigint") % 2
    )
    bases = {}
    for odd, result_type in enumerate(("baseline", "semantic")):
        bases[result_type] = f"{base}/{result_type}"
        metrics = ru.metric_rows(qu.batch_metrics(batches.filter(F.col("_odd") == odd)))
        folder = st.save_metrics(metrics, bases[result_type], "run")
        st.save_run_info(spark, bases[result_type], "run", written={"metrics": folder})
    return bases


def stored_comparison(spark: SparkSession, sf: str) -> DataFrame:
    """Two stored runs compared, the comparison saved and read back."""
    bases = _stored_event_runs(spark, sf)
    out = _store(spark)
    compare_stored_runs(
        spark, bases["baseline"], bases["semantic"], tracked=_TRACKED_EVENTS, save_to=out
    )
    back = spark.read.json(f"{out}/comparison")
    numbers = ["baseline", "semantic", "improvement_ratio", "improvement_pct", "speedup", "savings_pct"]
    return back.select("metric", *[F.round(F.col(c).cast("double"), 6).alias(c) for c in numbers])


def run_summary_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Metrics of one of two stored runs, from the catalogue, which opens that run alone."""
    runs = read_catalogue(spark, _stored_event_runs(spark, sf))
    asked = runs.filter("result_type = 'semantic' AND run_id = 'run'")
    return _rounded(
        asked.select("result_type", "run_id", "has_classifications", "category", "metric", "value"), 6, "value"
    )


def _run_rows(spark: SparkSession, base: str, run: str) -> DataFrame:
    """What a stored run says, as (part, name, value), without what was measured in time."""
    metrics = st.read_metrics(spark, base, run).filter("category <> 'latency_metrics'")
    info = st.read_run_info(spark, base, run)
    facts = info.select(F.explode("facts").alias("name", "value")).filter("name <> 'seconds'")
    rows = st.read_classifications(spark, base, run)
    status = F.when(F.col("prediction").isNull(), "none").otherwise(F.col("prediction"))
    counts = rows.groupBy(status.alias("name")).agg(F.count(F.lit(1)).cast("double").alias("value"))
    return _rounded(
        metrics.select(F.col("category").alias("part"), F.col("metric").alias("name"), "value")
        .unionByName(facts.select(F.lit("facts").alias("part"), "name", "value"))
        .unionByName(counts.select(F.lit("rows").alias("part"), "name", "value")),
        9,
        "value",
    )


def saved_router_run(spark: SparkSession, sf: str) -> DataFrame:
    """Routes trained and stored, loaded again with overrides, every document routed, the run read back."""
    base = _store(spark)
    rs.save_routes(pr.train_router(_table(spark, sf, "documents"), SAMPLES, THRESHOLD), f"{base}/routes")
    run = sr.run_router(
        _documents(spark, sf),
        f"{base}/routes",
        CLASSES,
        base,
        overrides=OVERRIDES,
        model="text-embedding-3-small",
    )
    info = st.read_run_info(spark, base, run)
    route = "map<string,struct<references_count:double,distance_threshold:double>>"
    routes = info.select(
        F.explode(F.from_json(F.get_json_object("classifier_config", "$.routes"), route)).alias("name", "r")
    )
    return (
        _run_rows(spark, base, run)
        .unionByName(routes.select(F.lit("thresholds").alias("part"), "name", F.col("r.distance_threshold").alias("value")))
        .unionByName(routes.select(F.lit("references").alias("part"), "name", F.col("r.references_count").alias("value")))
    )


def saved_model_run(spark: SparkSession, sf: str) -> DataFrame:
    """The stand-in model asked about every batch, the run read back."""
    base = _store(spark)
    run = sr.run_model(
        _table(spark, sf, "documents"),
        CLASSES,
        _stand_in_model(CLASSES),
        base,
        batch_size=BATCH,
        prompt_price=0.001,
        completion_price=0.005,
        max_retries=1,
    )
    return _run_rows(spark, base, run)


def all_batches(spark: SparkSession, sf: str) -> DataFrame:
    """Calls that succeeded, with what they cost, and calls that failed, with their number."""
    batches = _event_batches(spark, sf)
    ok = batches.filter(F.col("status") == qu.SUCCESS).select("batch_id", "batch_size", "total_latency")
    failed = batches.filter(F.col("status") == qu.FAILED).select(
        "batch_id", "batch_size", F.concat(F.lit("failed calls: "), F.col("batch_size")).alias("error")
    )
    return _rounded(qu.all_batches(ok, failed), 6, "total_latency")


def _article_files(spark: SparkSession, sf: str) -> str:
    """The documents as article files."""
    path = f"{_store(spark)}/articles"
    _table(spark, sf, "documents").select(
        F.col("doc_id").alias("ArticleId"), F.col("text").alias("Text"), F.col("lang").alias("Category")
    ).write.option("header", True).option("escape", '"').csv(path)
    return path


def article_files(spark: SparkSession, sf: str) -> DataFrame:
    """Texts and labels read from files, as they stand there."""
    return sa.read_articles(spark, _article_files(spark, sf), strip=False)


def written_split(spark: SparkSession, sf: str) -> DataFrame:
    """The split that is written once, both sides read back; a second call keeps it."""
    path = f"{_store(spark)}/split"
    articles = sa.read_articles(spark, _article_files(spark, sf), strip=False)
    sa.ensure_split(articles, path)
    sa.ensure_split(articles.limit(0), path)
    sides = [
        sa.read_split(spark, path, side).withColumn("split", F.lit(side)) for side in ("train", "validation")
    ]
    return sides[0].unionByName(sides[1])


def model_catalogue(spark: SparkSession, sf: str) -> DataFrame:
    """What embedding all documents costs with each model of the catalogue."""
    tokens = _documents(spark, sf).agg(F.sum(tx.token_estimate(F.col("text"))).alias("t"))
    models = co.model_catalogue(spark).withColumn("total_tokens", tokens.scalar())
    priced = models.withColumn("total_cost", token_cost(F.col("total_tokens"), F.col("price_per_1k")))
    return _rounded(priced, 9, "total_cost")


def error_taxonomy(spark: SparkSession, sf: str) -> DataFrame:
    return retries.error_taxonomy(_errors(spark, sf))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        labeled_articles,
        dedupe_text,
        stratified_split,
        sample_per_class,
        fixed_batches,
        reference_text,
        embed_hashed,
        route_centroids,
        route_summary,
        threshold_overrides,
        route_avg,
        route_min,
        route_dense,
        topk_routes,
        unrouted_articles,
        prediction_fallback,
        threshold_sweep,
        best_thresholds,
        trained_thresholds,
        prompt_batches,
        llm_reply_parse,
        llm_reply_join,
        llm_classify,
        llm_run_metrics,
        token_estimate,
        embedding_cost,
        cost_ledger,
        batch_metrics,
        per_batch_rates,
        accuracy,
        confusion_matrix,
        class_report,
        averaged_metrics,
        router_run_metrics,
        classification_report_rows,
        metric_categories,
        run_listing,
        latest_run,
        run_comparison,
        error_taxonomy,
        exact_thresholds,
        nearest_references,
        router_info,
        stored_routes,
        cached_embeddings,
        stored_comparison,
        run_summary_rows,
        saved_router_run,
        saved_model_run,
        all_batches,
        article_files,
        written_split,
        model_catalogue,
    )
}
