from pyspark.sql import functions as F

from signpost.functions import text as tx

TEXTS = [
    "",
    "   \t\r\n ",
    "x" * 100,
    "x" * 101,
    "y" * 500,
    "y" * 501,
    "a\r\nb  c\x0bd",
    "  éà ü ß z  ",
    ("wort " * 120) + "end",
    "\U0001f600" * 501,
    "a\x1cb\x85c",
]


def prepared(text):
    cut = text[:500] + ("..." if len(text) > 500 else "")
    return " ".join(cut.split())


def test_text_functions_follow_python(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "id int, t string")
    rows = df.select(
        "id",
        tx.strip(F.col("t")).alias("strip"),
        tx.word_count(F.col("t")).alias("words"),
        tx.token_estimate(F.col("t")).alias("tokens"),
        tx.reference_text(F.col("t")).alias("reference"),
        tx.preview(F.col("t")).alias("preview"),
    ).collect()
    for r in rows:
        t = TEXTS[r["id"]]
        assert r["strip"] == t.strip()
        assert r["words"] == len(t.split())
        assert r["tokens"] == int(len(t.split()) * 1.3)
        assert r["reference"] == prepared(t)


PREVIEWS = {
    "": "",
    "short": "short",
    "a\r\nb  c\x0bd": "a  b  c\x0bd",
    "0123456789" * 10: "0123456789" * 10,
    "0123456789" * 10 + "\n": "0123456789" * 10 + "...",
    "12345678\r\n" * 11: "12345678  " * 10 + "...",
    "\U0001f600" * 101: "\U0001f600" * 100 + "...",
}


def test_previews(spark):
    df = spark.createDataFrame([(t,) for t in PREVIEWS], "t string")
    assert {r["t"]: r["p"] for r in df.select("t", tx.preview(F.col("t")).alias("p")).collect()} == PREVIEWS


def test_white_space_set_is_pythons():
    assert set(tx.WHITESPACE_CHARS) == {chr(c) for c in range(0x110000) if chr(c).isspace()}


def test_null_text_stays_null(spark):
    row = spark.sql("select cast(null as string) t").select(
        tx.reference_text(F.col("t")), tx.preview(F.col("t")), tx.token_estimate(F.col("t"))
    ).first()
    assert list(row) == [None, None, None]


def test_token_estimate_has_no_float_edge(spark):
    df = spark.range(1, 400).select("id", F.repeat(F.lit("w "), F.col("id").cast("int")).alias("t"))
    got = df.select("id", tx.token_estimate(F.col("t")).alias("n")).collect()
    assert all(r["n"] == 13 * r["id"] // 10 == int(1.3 * r["id"]) for r in got)
