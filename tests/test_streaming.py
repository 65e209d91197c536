from signpost.operators.routes import build_routes
from signpost.plans.router import classify
from signpost.streaming.routing import route_stream


def test_stream_routes_like_a_batch(spark, tmp_path):
    refs = spark.createDataFrame(
        [("a", 1, "apple pear"), ("b", 2, "bolt nut")],
        "route string, ref_id bigint, ref_text string",
    )
    routes = build_routes(refs, 0.8)
    source = str(tmp_path / "in")
    rows = [(1, "apple pie"), (2, "a nut"), (3, "zebra"), (4, None)]
    for k in range(2):
        spark.createDataFrame(rows[2 * k : 2 * k + 2], "article_id bigint, text string").coalesce(
            1
        ).write.mode("append").parquet(source)
    articles = (
        spark.readStream.schema("article_id bigint, text string")
        .option("maxFilesPerTrigger", 1)
        .parquet(source)
    )
    query = route_stream(
        articles, routes, ["a", "b"], str(tmp_path / "out"), str(tmp_path / "check")
    )
    query.awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out")).drop("epoch")
    want = classify(
        spark.read.parquet(source), routes, ["a", "b"], "article_id"
    ).drop("text")
    assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(
        map(tuple, want.collect())
    )
    assert got.count() == 4
