"""Data work around a model call per batch: prompts, calls, replies, predictions."""

from __future__ import annotations

import math
import re
import time
from collections.abc import Callable, Iterator, Sequence
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from signpost.checks import positive
from signpost.functions import scoring
from signpost.functions.errors import ERROR_RULES
from signpost.operators.quality import FAILED, SUCCESS
from signpost.operators.ranking import global_index
from signpost.session import materialize

# The two reply formats. Form A is any number of objects
# {"article_id": 7, "category": "x"} with exactly these keys in this order;
# form B is one object that holds a list under "classifications".
REPLY_OBJECT = r'\{"article_id":\s*\d+,\s*"category":\s*"[^"]+"\}'
REPLY_LIST = r'(?s)(\{.*"classifications".*\})'

_ENTRY = "struct<article_id:bigint,category:string>"


class Prompt(NamedTuple):
    """What a prompt says. ``{classes}`` and ``{count}`` may stand in ``head`` and ``tail``,
    ``{id}``, ``{number}`` (from 1) and ``{text}`` in ``item``, which is repeated for every article.
    Whatever a template says, replies are read in the two formats above."""

    head: str = "The labels are: {classes}."
    item: str = "\n\n[text {id}]\n{text}\n[end of text {id}]"
    tail: str = (
        "\n\nGive each of the {count} texts the label that suits it as a whole. Print nothing but "
        'one line per text, with its id and the label in lower case: {"article_id": 12, "category": "label"}'
    )


# complete(prompt) -> (reply, prompt tokens, completion tokens)
Complete = Callable[[str], tuple[str, int, int]]


def _filled(template: str, **values: Column) -> Column:
    """A template with columns in place of the names in braces that it may hold."""
    parts = re.split("(" + "|".join(re.escape("{%s}" % name) for name in values) + ")", template)
    return F.concat(*[values[p[1:-1]] if i % 2 else F.lit(p) for i, p in enumerate(parts)])


def _rendered(grouped: DataFrame, classes: Sequence[str], template: Prompt) -> DataFrame:
    """Prompts of batches whose ``_members`` (idx, article_id, text) lie in order in their row."""
    size = F.size("_members").cast("bigint")
    whole = {"classes": F.lit(", ".join(scoring.valid_classes(classes))), "count": size.cast("string")}
    items = F.transform(
        "_members",
        lambda m, i: _filled(
            template.item,
            id=m["article_id"].cast("string"),
            number=(i + 1).cast("string"),
            text=m["text"],
        ),
    )
    return grouped.select(
        "batch_id",
        size.alias("n_articles"),
        F.transform("_members", lambda m: m["article_id"]).alias("article_ids"),
        F.concat(
            _filled(template.head, **whole), F.array_join(items, ""), _filled(template.tail, **whole)
        ).alias("prompt"),
    )


def _member(id_col: str, text_col: str) -> Column:
    body = F.coalesce(F.col(text_col), F.lit("")).alias("text")
    return F.struct("idx", F.col(id_col).alias("article_id"), body)


def prompt_batches(
    articles: DataFrame,
    batches: DataFrame,
    classes: Sequence[str],
    id_col: str = "doc_id",
    text_col: str = "text",
    partitions: int | None = None,
    template: Prompt = Prompt(),
) -> DataFrame:
    """One prompt per batch of the caller's own: (batch_id, n_articles, article_ids, prompt).

    ``batches`` holds (id, idx, batch_id); a batch is as large as its batch
    size, so collecting it is bounded. Texts move for the join and for the batches; for
    batches of consecutive ids ``ordered_prompts`` moves them once.
    """
    joined = batches.select(id_col, "idx", "batch_id").join(
        articles.select(id_col, text_col), id_col
    )
    if partitions is not None:
        # the grouping below finds its key partitioned already and adds no shuffle
        positive("partitions", partitions)
        joined = joined.repartition(partitions, "batch_id")
    grouped = joined.groupBy("batch_id").agg(
        F.sort_array(F.collect_list(_member(id_col, text_col))).alias("_members")
    )
    return _rendered(grouped, classes, template)


def _part_of(key: Column, cuts: Column, most: int) -> Column:
    """How many of the sorted ``cuts``, at most ``most``, lie at or below a key: a binary search in the row."""
    whole = F.struct(F.lit(0).alias("lo"), F.size(cuts).alias("hi"))

    def halve(at: Column, _: Column) -> Column:
        mid = F.floor((at["lo"] + at["hi"]) / 2).cast("int")
        upper = F.struct((mid + 1).alias("lo"), at["hi"].alias("hi"))
        lower = F.struct(at["lo"].alias("lo"), mid.alias("hi"))
        return F.when(at["lo"] >= at["hi"], at).when(F.get(cuts, mid) <= key, upper).otherwise(lower)

    steps = F.sequence(F.lit(1), F.lit(math.ceil(math.log2(most + 1)) + 1))
    return F.aggregate(steps, whole, halve, lambda at: at["lo"])


def ordered_prompts(
    articles: DataFrame,
    batch_size: int,
    classes: Sequence[str],
    id_col: str = "doc_id",
    text_col: str = "text",
    partitions: int | None = None,
    template: Prompt = Prompt(),
) -> DataFrame:
    """One prompt per ``batch_size`` articles in id order: (batch_id, n_articles, article_ids, prompt).

    Ids must be unique and of a type that has an order; null texts count as empty. A pass over the
    ids alone finds the ids at which each of ``partitions`` parts of whole batches begins.
    Every article then finds its part in its own row, the texts move once, to their
    part, and are numbered there: nothing is joined by id.
    """
    positive("batch_size", batch_size)
    index = global_index(articles.select(id_col), id_col)
    batches = math.ceil(index.count() / batch_size)
    if partitions is None:
        partitions = int(articles.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    positive("partitions", partitions)
    rows = batch_size * max(1, math.ceil(batches / partitions))
    cuts = index.filter(F.col("idx") % rows == 0).agg(F.sort_array(F.collect_list(id_col)).alias("c"))
    part = _part_of(F.col(id_col), F.col("_cuts"), partitions)
    placed = (
        articles.select(id_col, text_col)
        .withColumn("_cuts", cuts.scalar())
        .withColumn("_part", F.greatest(F.lit(0), part - 1).cast("bigint"))
        .drop("_cuts")
        .repartition(partitions, "_part")
    )
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(id_col))
    numbered = placed.withColumn("idx", F.col("_part") * rows + inside - 1).withColumn(
        "batch_id", F.call_function("div", "idx", F.lit(batch_size))
    )
    # grouped by the part as well, by which the rows are partitioned already
    grouped = numbered.groupBy("_part", "batch_id").agg(
        F.sort_array(F.collect_list(_member(id_col, text_col))).alias("_members")
    )
    return _rendered(grouped, classes, template)


def model_replies(
    prompts: DataFrame,
    factory: Callable[[], Complete],
    max_retries: int = 3,
    max_concurrent: int | None = None,
) -> DataFrame:
    """``called``, written: a plan that is evaluated twice never calls twice."""
    return materialize(called(prompts, factory, max_retries, max_concurrent))


def called(
    prompts: DataFrame,
    factory: Callable[[], Complete],
    max_retries: int = 3,
    max_concurrent: int | None = None,
) -> DataFrame:
    """Call a model once per prompt; the other columns of ``prompts`` stay, ``prompt`` goes.

    Adds (status, error, reply, prompt_tokens, completion_tokens, total_latency in
    seconds, total_tokens). ``factory`` runs once per task and returns the call. A
    retryable error is tried again up to ``max_retries`` times; a batch whose call fails
    for good is kept with status ``failed``. ``max_concurrent`` bounds the tasks that
    call at the same time. Calls are dear: write the result before anything reads it.
    """
    if max_retries < 0:
        raise ValueError(f"max_retries must not be negative, got {max_retries}")
    rules, ok, failed = ERROR_RULES, SUCCESS, FAILED
    if max_concurrent is not None:
        positive("max_concurrent", max_concurrent)
        prompts = prompts.coalesce(max_concurrent)

    def call(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        complete = factory()

        def retryable(message: str) -> bool:
            for _, again, needles in rules:
                if any(needle in message.lower() for needle in needles):
                    return again
            return True

        def one(prompt: str):
            message, start = "", time.perf_counter()
            for _ in range(max_retries + 1):
                try:
                    reply, asked, answered = complete(prompt)
                    took = time.perf_counter() - start
                    return ok, None, reply, int(asked), int(answered), took
                except Exception as error:
                    message = str(error)
                    if not retryable(message):
                        break
            return failed, message, None, 0, 0, time.perf_counter() - start

        for frame in frames:
            made = pd.DataFrame(
                [one(p) for p in frame["prompt"]],
                columns=[
                    "status",
                    "error",
                    "reply",
                    "prompt_tokens",
                    "completion_tokens",
                    "total_latency",
                ],
            )
            kept = frame.drop(columns="prompt").reset_index(drop=True)
            made["total_tokens"] = made["prompt_tokens"] + made["completion_tokens"]
            yield pd.concat([kept, made], axis=1)

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in prompts.schema if f.name != "prompt")
    return prompts.mapInPandas(
        call,
        f"{kept}, status string, error string, reply string, prompt_tokens bigint, "
        "completion_tokens bigint, total_latency double, total_tokens bigint",
    )


def _entries(reply: Column) -> Column:
    objects = F.regexp_extract_all(reply, F.lit(REPLY_OBJECT), F.lit(0))
    # each object by itself: a broken one costs its own entry and no other
    strict = {"allowSingleQuotes": "false"}
    form_a = F.filter(
        F.transform(objects, lambda o: F.from_json(o, _ENTRY, strict)),
        lambda e: e["article_id"].isNotNull(),
    )
    # as the only element of an array, so that nothing may follow the object; parsed
    # as a whole first, since from_json keeps what it read before an error
    listed = F.concat(F.lit("["), F.regexp_extract(reply, REPLY_LIST, 1), F.lit("]"))
    entries = F.from_json(listed, f"array<struct<classifications:array<{_ENTRY}>>>", strict)
    form_b = F.when(
        F.try_parse_json(listed).isNotNull(), F.get(entries, F.lit(0))["classifications"]
    )
    return F.when(F.size(objects) > 0, form_a).otherwise(form_b)


def parse_replies(
    replies: DataFrame, batch_col: str = "batch_id", reply_col: str = "reply"
) -> DataFrame:
    """One row per entry of a reply in reply order: (batch_id, pos, article_id, category).

    Form A wins if it matches anywhere; otherwise form B is read, and text that
    is neither, or broken JSON, yields no row. Categories keep their case.
    """
    # the outer form, so that the reply is not parsed once more for a pushed filter
    return (
        replies.select(
            batch_col, F.posexplode_outer(_entries(F.col(reply_col))).alias("pos", "_e")
        )
        .filter(F.col("pos").isNotNull())
        .select(
            batch_col,
            F.col("pos").cast("bigint").alias("pos"),
            F.col("_e.article_id").alias("article_id"),
            F.col("_e.category").alias("category"),
        )
    )


def join_replies(
    members: DataFrame,
    parsed: DataFrame,
    classes: Sequence[str],
    batch_col: str = "batch_id",
) -> DataFrame:
    """Prediction of every article of every batch: (batch_id, article_id, prediction, is_fallback).

    The first entry for an article counts. A missing entry, a missing category
    or one outside ``classes`` becomes the first class; only that article falls
    back. Entries for the same article are reduced before the join.
    """
    first = (
        parsed.filter(F.col("article_id").isNotNull())
        .groupBy(batch_col, "article_id")
        .agg(F.min(F.struct("pos", "category")).alias("_first"))
        .select(batch_col, "article_id", F.col("_first.category").alias("category"))
    )
    valid = scoring.is_valid_class(F.col("category"), classes)
    return (
        members.select(batch_col, "article_id")
        .join(first, [batch_col, "article_id"], "left")
        .select(
            batch_col,
            "article_id",
            F.when(valid, F.lower("category"))
            .otherwise(F.lit(scoring.valid_classes(classes)[0]))
            .alias("prediction"),
            (~valid).alias("is_fallback"),
        )
    )


def classify_batches(replies: DataFrame, classes: Sequence[str]) -> DataFrame:
    """Predictions from written replies, with the other columns of their batch.

    A reply and the ids it answers lie in one row, so each id picks its first
    entry inside the row: the rule of ``join_replies`` without its shuffle.
    Failed batches keep fallback predictions and say so in their status.
    """
    picked = F.transform(
        "article_ids",
        lambda i: F.struct(
            i.alias("article_id"),
            F.get(F.filter("_parsed", lambda e: e["article_id"] == i), F.lit(0))["category"].alias(
                "category"
            ),
        ),
    )
    rows = (
        replies.withColumn("_parsed", _entries(F.col("reply")))
        .withColumn("_picked", picked)
        .drop("reply", "article_ids", "_parsed")
        .withColumn("_one", F.explode_outer("_picked"))
        .select("*", "_one.article_id", "_one.category")
        .drop("_one", "_picked")
    )
    valid = scoring.is_valid_class(F.col("category"), classes)
    return (
        rows.withColumn("is_fallback", ~valid)
        .withColumn(
            "prediction",
            F.when(~F.col("is_fallback"), F.lower("category")).otherwise(
                F.lit(scoring.valid_classes(classes)[0])
            ),
        )
        .drop("category")
    )
