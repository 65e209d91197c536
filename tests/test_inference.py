import pytest
from pyspark.sql import functions as F

from signpost.operators import inference as inf
from signpost.operators.articles import fixed_batches
from signpost.operators.quality import batch_metrics
from signpost.plans import batch_inference as bi
from tests.conftest import plan_of

CLASSES = ["alpha", "beta"]
REPLIES = {
    # form A in prose, mixed case, with a repeat whose first entry counts
    0: 'ok {"article_id": 1, "category": "Beta"} and {"article_id":2,"category":"alpha"}\n'
    '{"article_id": 1, "category": "alpha"}',
    # form B, keys in the other order, over lines
    1: 'text {"classifications":\n [{"category": "beta", "article_id": 1}]} more',
    # form A wins over a list if an object has its exact form
    2: '{"classifications": [{"article_id": 1, "category": "beta"}]} '
    '{"article_id": 2, "category": "beta"}',
    # space after the brace: not form A, and no list either
    3: '{ "article_id": 1, "category": "beta"}',
    # another key: not form A
    4: '{"article_id": 1, "category": "beta", "why": "x"}',
    # broken list
    5: '{"classifications": [{"category": "beta", "article_id": 1}',
    6: "no braces, classifications only",
    7: "",
    8: None,
    # null category falls back for that article only
    9: '{"classifications": [{"category": null, "article_id": 1}, '
    '{"category": "beta", "article_id": 2}]}',
    10: '{"article_id": 1, "category": "gamma"} {"article_id": 2, "category": "BETA"}',
    11: '{"classifications": []}',
}
WANT = {
    0: [("beta", False), ("alpha", False)],
    1: [("beta", False), ("alpha", True)],
    2: [("beta", False), ("beta", False)],
    9: [("alpha", True), ("beta", False)],
    10: [("alpha", True), ("beta", False)],
}
BOTH_FALL_BACK = [("alpha", True), ("alpha", True)]


@pytest.fixture(scope="module")
def replies(spark):
    return spark.createDataFrame(
        [(b, [1, 2], r) for b, r in REPLIES.items()],
        "batch_id bigint, article_ids array<bigint>, reply string",
    )


def collected(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["batch_id"], {})[r["article_id"]] = (r["prediction"], r["is_fallback"])
    return {b: [v[1], v[2]] for b, v in out.items()}


def test_replies_are_read_by_the_rules(replies):
    want = {b: WANT.get(b, BOTH_FALL_BACK) for b in REPLIES}
    members = replies.select("batch_id", F.explode("article_ids").alias("article_id"))
    joined = inf.join_replies(members, inf.parse_replies(replies), CLASSES)
    assert collected(joined) == want
    # the same answer without a join
    assert collected(inf.classify_batches(replies, CLASSES)) == want


def test_parsed_order(replies):
    rows = inf.parse_replies(replies).filter("batch_id = 0").orderBy("pos").collect()
    assert [(r["pos"], r["article_id"], r["category"]) for r in rows] == [
        (0, 1, "Beta"), (1, 2, "alpha"), (2, 1, "alpha"),
    ]


ARTICLES = [(30, "third"), (10, "first"), (20, None), (40, "fourth")]
PLAIN = inf.Prompt("{classes}|", "{number}:{id}:{text};", "|{count} {not a name}")


def test_prompts_hold_every_article_in_order(spark):
    articles = spark.createDataFrame(ARTICLES, "doc_id bigint, text string")
    own = inf.prompt_batches(articles, fixed_batches(articles, 3), [*CLASSES, "na"], template=PLAIN)
    ordered = inf.ordered_prompts(articles, 3, [*CLASSES, "na"], template=PLAIN)
    for prompts in (own, ordered):
        got = {r["batch_id"]: (r["n_articles"], r["article_ids"], r["prompt"]) for r in prompts.collect()}
        assert got == {
            0: (3, [10, 20, 30], "alpha, beta|1:10:first;2:20:;3:30:third;|3 {not a name}"),
            1: (1, [40], "alpha, beta|1:40:fourth;|1 {not a name}"),
        }


def test_the_prompt_says_what_is_asked(spark):
    articles = spark.createDataFrame(ARTICLES, "doc_id bigint, text string")
    prompt = inf.ordered_prompts(articles, 3, CLASSES).orderBy("batch_id").first()["prompt"]
    places = [prompt.index(s) for s in ("alpha, beta.", "[text 10]\nfirst\n", "[text 20]\n\n", "third", "3 texts")]
    assert places == sorted(places)


@pytest.mark.parametrize("rows,size,partitions", [(1, 1, 1), (40, 4, 3), (41, 4, 100), (97, 10, 7), (97, 200, 4)])
def test_batches_of_ids_of_any_order_and_type(spark, rows, size, partitions):
    """Ids with gaps, as numbers and as strings: batches are consecutive ids whatever the partitions."""
    ids = [f"{(i * 37) % 101:03d}x" for i in range(rows)]
    for kind, cast in (("string", str), ("bigint", lambda x: int(x[:-1]))):
        articles = spark.createDataFrame([(cast(i), f"t{i}") for i in ids], f"doc_id {kind}, text string")
        got = inf.ordered_prompts(articles, size, CLASSES, partitions=partitions, template=PLAIN).collect()
        want = sorted(map(cast, ids))
        assert {r["batch_id"]: r["article_ids"] for r in got} == {
            b: want[b * size : (b + 1) * size] for b in range(-(-rows // size))
        }
        assert all(f"t{i}" in r["prompt"] for r in got for i in map(str, r["article_ids"])) or kind == "bigint"


def test_no_articles_no_prompts(spark):
    assert inf.ordered_prompts(spark.createDataFrame([], "doc_id int, text string"), 5, CLASSES).count() == 0


def test_texts_move_once(spark):
    articles = spark.createDataFrame([(i, f"t{i}") for i in range(4000)], "doc_id bigint, text string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        prompts = inf.ordered_prompts(articles, 4, CLASSES, partitions=3)
        plan = prompts._jdf.queryExecution().explainString(
            prompts.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
        )
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    plan = plan.split("===== Subqueries")[0]
    moved = [p for p in plan.split("\n\n") if "Exchange" in p.split("\n")[0] and "text#" in p]
    assert len(moved) == 1 and "Join" not in plan
    assert prompts.count() == 1000


def test_prompts_are_shuffled_once_for_their_tasks(spark):
    articles = spark.range(40).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    batches = fixed_batches(articles, 4)
    prompts = inf.prompt_batches(articles, batches, CLASSES, partitions=3)
    assert plan_of(prompts).count("hashpartitioning(batch_id") == 1
    assert prompts.rdd.getNumPartitions() == 3
    assert prompts.count() == 10


def test_classify_with_a_model_that_fails_at_times(spark, tmp_path):
    calls = str(tmp_path)

    def factory():
        import os
        import re
        import uuid

        def complete(prompt):
            first = re.search(r"\[text (\d+)\]", prompt).group(1)
            open(os.path.join(calls, f"{first}-{uuid.uuid4().hex}"), "w").close()
            tries = len([f for f in os.listdir(calls) if f.startswith(f"{first}-")])
            if first == "0" and tries < 3:
                raise RuntimeError("429 too many requests")
            if first == "10":
                raise RuntimeError("401 unauthorized")
            if first == "20":
                raise RuntimeError("something unknown")
            ids = re.findall(r"\[text (\d+)\]", prompt)
            return "".join(f'{{"article_id": {i}, "category": "beta"}}' for i in ids), 7, 3

        return complete

    articles = spark.range(35).select(
        F.col("id").alias("doc_id"), F.lit("some text").alias("text")
    )
    replies = bi.reply_batches(articles, CLASSES, factory, 10, max_retries=2, max_concurrent=2)
    classified = bi.classify_with_model(replies, CLASSES)
    assert classified.count() == 35
    assert classified.count() == 35  # read again: no call is made again

    import os

    made = [f.split("-")[0] for f in os.listdir(calls)]
    # retried until it worked, given up at once, given up after all retries, worked at once
    assert {k: made.count(k) for k in set(made)} == {"0": 3, "10": 1, "20": 3, "30": 1}
    status = {r["batch_id"]: (r["status"], r["error"]) for r in replies.collect()}
    assert status == {
        0: ("success", None),
        1: ("failed", "401 unauthorized"),
        2: ("failed", "something unknown"),
        3: ("success", None),
    }
    for r in classified.collect():
        failed = r["batch_id"] in (1, 2)
        assert (r["prediction"], r["is_fallback"]) == (("alpha", True) if failed else ("beta", False))
    m = batch_metrics(bi.reply_metrics_input(replies, 1.0, 2.0)).first()
    assert (m["successful_articles"], m["failed_articles"]) == (15, 20)
    assert m["total_cost"] == pytest.approx(2 * (7 + 6) / 1000)
    assert m["total_latency"] > 0


def test_arguments_are_checked(spark):
    prompts = spark.createDataFrame([], "batch_id bigint, n_articles bigint, prompt string")
    with pytest.raises(ValueError):
        inf.model_replies(prompts, lambda: None, max_retries=-1)
    with pytest.raises(ValueError):
        inf.model_replies(prompts, lambda: None, max_concurrent=0)


def _counting_model(folder):
    """Writes one file per call; a call for the text "break" waits for the others and ends its task."""

    def factory():
        import os
        import re
        import time
        import uuid

        def complete(prompt):
            ids = re.findall(r"\[text (\d+)\]", prompt)
            if "break me" in prompt and os.path.exists(os.path.join(folder, "broken")):
                time.sleep(4)
                raise SystemExit("executor lost")
            open(os.path.join(folder, f"call-{ids[0]}-{uuid.uuid4().hex}"), "w").close()
            if ids[0] == "30":
                raise RuntimeError("401 unauthorized")
            return "".join(f'{{"article_id": {i}, "category": "beta"}}' for i in ids), 7, 3

        return complete

    return factory


def test_a_broken_run_goes_on_where_it_was(spark, tmp_path):
    """Over a run that breaks and one that goes on, every prompt is asked for once."""
    import os

    folder = str(tmp_path / "calls")
    os.mkdir(folder)
    marker = os.path.join(folder, "broken")
    open(marker, "w").close()
    articles = spark.range(60).select(
        F.col("id").alias("doc_id"), F.when(F.col("id") == 25, "break me").otherwise("t").alias("text")
    )
    ledger = str(tmp_path / "ledger")

    def run(**how):
        prompts = bi.planned_prompts(articles, CLASSES, 10, calls_per_task=1)
        return bi.resumed_replies(prompts, _counting_model(folder), ledger, max_retries=0, **how)

    def calls():
        return sorted(int(f.split("-")[1]) for f in os.listdir(folder) if f.startswith("call-"))

    with pytest.raises(Exception):
        run()
    before = calls()
    assert 0 < len(before) < 6 and 20 not in before
    os.remove(marker)
    replies = run()
    assert calls() == [0, 10, 20, 30, 40, 50]
    assert sorted((r["batch_id"], r["status"], r["article_ids"][0]) for r in replies.collect()) == [
        (0, "success", 0), (1, "success", 10), (2, "success", 20), (3, "failed", 30), (4, "success", 40),
        (5, "success", 50),
    ]
    assert run().count() == 6 and len(calls()) == 6  # all there: nothing is asked
    assert run(retry_failed=True).count() == 6 and calls().count(30) == 2
    # a text that changed is another prompt
    articles = articles.withColumn("text", F.when(F.col("doc_id") == 0, "new").otherwise(F.col("text")))
    assert run().count() == 6 and calls().count(0) == 2 and len(calls()) == 8
    assert bi.classify_with_model(run(), CLASSES).filter("prediction = 'beta'").count() == 50
