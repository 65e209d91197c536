"""Personal data and the terms that give it away.

Base kinds (email, ip, card, phone) are found by pattern. Information theory finds
the rest: an entity is one protected value (an address, a number), and a term in
its company discloses it as far as the corpus says. With the share of documents
that hold an entity c, a term t, or both,

    PMI(c; t) = log p(c, t) / (p(c) p(t)),   IC(c) = -log p(c),

the ratio PMI / IC is the part of the entity's information the term reveals: 1 for a
term met only with the entity, 0 for one met everywhere alike. A term above
``remove_at`` is removed, above ``generalise_at`` generalised to its kind, everywhere
in the documents that hold the entity and nowhere else. The company of an entity are
all terms of its documents outside base spans. Equal texts count once, and a pair needs
``min_together`` different texts, so exact copies prove nothing.

All of it is DataFrame operations: patterns and positions as array functions inside
the row, co-occurrence as joins and partial aggregates keyed by (entity, term) and
by term. A document is searched for a pattern only if it has the character without
which the pattern can't match.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from signpost.llm.exprs import let
from signpost.session import materialize

KINDS = ("email", "ip", "card", "phone")
TERM = "term"
# The four patterns. Possessive runs and the look-behind keep the same
# matches (nothing that follows could use what a run gives back, and a match starts
# where its run starts or the last match ended) and the time linear in the text.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# No match without this in the text.
NEEDS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": "[0-9][0-9 -]{12}", "phone": r"\+[0-9]"}
LETTERS = r"\p{L}+"
# Shorter terms are left alone unless ``min_letters`` says otherwise; op4_pii and the pipeline take all.
MIN_LETTERS = 4
SPAN = "array<struct<s:int,k:int,e:int>>"


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """The check sum of card numbers holds."""

    def total(d: Column) -> Column:
        n = F.length(d)
        each = F.transform(
            F.sequence(F.lit(1), n),
            lambda i: let(
                F.substring(d, n - i + 1, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1),
                lambda x: F.when(x > 9, x - 9).otherwise(x),
            ),
        )
        return F.aggregate(each, F.lit(0), lambda a, b: a + b)

    return F.when(F.length(digits) > 0, let(digits, total) % 10 == 0).otherwise(F.lit(False))


def _holds(kind: str, value: Column) -> Column:
    """What a match must satisfy besides its pattern."""
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda p: p.rlike("^0*(25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})$"))
    if kind == "card":
        return let(
            _digits(value),
            lambda d: F.when(F.length(d).between(14, 19), luhn(d)).otherwise(F.lit(False)),
        )
    if kind == "phone":
        return F.length(_digits(value)).between(10, 15)
    return F.lit(True)


def kind_spans(text: Column, kind: str) -> Column:
    """Spans (start, kind, end; code points) of a kind's matches that hold, in order.

    The pieces between matches and the matches themselves alternate; their lengths
    add up to the places.
    """
    k = KINDS.index(kind)

    def of(parts: Column) -> Column:
        def step(acc: Column, x: Column) -> Column:
            start = acc["at"] + x["gap"]
            end = start + F.length(x["m"])
            span = F.struct(start.alias("s"), F.lit(k).alias("k"), end.alias("e"))
            kept = F.when(_holds(kind, x["m"]), F.concat(acc["out"], F.array(span))).otherwise(acc["out"])
            return F.struct(end.alias("at"), kept.alias("out"))

        pairs = F.transform(
            parts["m"], lambda m, i: F.struct(F.length(F.get(parts["p"], i)).alias("gap"), m.alias("m"))
        )
        zero = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("out"))
        return F.aggregate(pairs, zero, step, lambda acc: acc["out"])

    pattern = PATTERNS[kind]
    found = let(
        F.struct(
            F.split(text, pattern, -1).alias("p"),
            F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"),
        ),
        of,
    )
    return F.when(text.rlike(NEEDS[kind]), found).otherwise(F.array().cast(SPAN))


def base_spans(text: Column) -> Column:
    """All base spans of a non-null text, by start, then kind."""
    return F.sort_array(F.concat(*[kind_spans(text, kind) for kind in KINDS]))


def span_text(spans: Column, names: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    return F.array_join(
        F.transform(
            spans,
            lambda x: F.concat_ws(":", F.get(names, x["k"]), x["s"].cast("string"), x["e"].cast("string")),
        ),
        ",",
    )


def _names() -> Column:
    return F.array(*[F.lit(k) for k in (*KINDS, TERM)])


def find_base(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``_id``, ``_tie`` (hash of the text), ``_text``, ``_spans``; null texts count as empty."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return df.select(F.col(id_col).alias("_id"), text.alias("_text")).select(
        "_id",
        "_text",
        F.xxhash64("_text").alias("_tie"),
        base_spans(F.col("_text")).alias("_spans"),
    )


def _entity(text: Column, span: Column) -> Column:
    """A span's kind and value."""
    value = F.lower(F.substring(text, span["s"] + 1, span["e"] - span["s"]))
    return F.concat_ws(":", F.get(_names(), span["k"]), value)


def _terms(text: Column, spans: Column) -> Column:
    """The different runs of letters outside the spans, lower-cased."""
    blank = F.transform(spans, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), F.lit(" ").alias("mask")))
    runs = F.regexp_extract_all(masked(text, blank), F.lit(LETTERS), F.lit(0))
    # each run by itself: a letter's lower case may hold marks that are no letters
    return F.array_distinct(F.transform(runs, F.lower))


def _ties(df: DataFrame, text_col: str) -> DataFrame:
    """``_tie`` (hash) of every different text and ``_rows``, how many rows have it."""
    tie = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    return df.groupBy(tie.alias("_tie")).agg(F.count("*").alias("_rows"))


def term_counts(
    df: DataFrame, ties: DataFrame, text_col: str = "text", min_letters: int = MIN_LETTERS
) -> DataFrame:
    """``term``, ``n_t``: the number of different texts that have the term.

    All rows are counted, folded before the shuffle, and what copies add to the count
    is taken off again: only texts that occur twice or more meet their hash's rows.
    """
    texts = df.select(F.coalesce(F.col(text_col), F.lit("")).alias("_t"))

    def spread(rows: DataFrame, *keep: str) -> DataFrame:
        terms = F.array_distinct(F.transform(F.split("_t", r"\P{L}+"), F.lower))
        return rows.select(*keep, F.explode(terms).alias("term")).filter(F.length("term") >= min_letters)

    every = spread(texts).groupBy("term").agg(F.count("*").alias("n"))
    copied = ties.filter("_rows > 1")
    hashed = texts.withColumn("_tie", F.xxhash64("_t")).join(copied, "_tie")
    surplus = spread(hashed, "_tie", "_rows").distinct().groupBy("term").agg((-F.sum(F.col("_rows") - 1)).alias("n"))
    return every.unionByName(surplus).groupBy("term").agg(F.sum("n").alias("n_t"))


def disclosures(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_together: int = 2,
    generalise_at: float = 0.6,
    remove_at: float = 0.9,
    min_letters: int = MIN_LETTERS,
) -> DataFrame:
    """Terms that give an entity away: ``_tie``, ``term``, ``ratio``, ``action``.

    One row per text (by its hash) with an entity and per term to change in it, with
    the largest ratio over the text's entities. Counts are numbers of different
    texts over the whole corpus; terms are lower-cased runs of letters.
    """
    # the few texts that hold an entity; equal texts give equal rows, which count once
    private = find_base(df, id_col, text_col).filter(F.size("_spans") > 0)
    held = materialize(
        private.select(
            "_tie",
            F.array_distinct(F.transform("_spans", lambda x: _entity(F.col("_text"), x))).alias("_entities"),
            _terms(F.col("_text"), F.col("_spans")).alias("_terms"),
        ).dropDuplicates(["_tie"])
    )
    entities = held.select("_tie", F.explode("_entities").alias("entity"))
    # an entity met in one text only has no company to judge by
    entity_n = entities.groupBy("entity").agg(F.count("*").alias("n_c")).filter(F.col("n_c") >= min_together)
    known = materialize(entities.join(entity_n, "entity"))
    company = (
        known.join(held.select("_tie", "_terms"), "_tie")
        .select("_tie", "entity", "n_c", F.explode("_terms").alias("term"))
        .filter(F.length("term") >= min_letters)
    )
    pairs = materialize(
        company.groupBy("entity", "n_c", "term")
        .agg(F.count("*").alias("n_ct"))
        .filter(F.col("n_ct") >= min_together)
    )
    ties = materialize(_ties(df, text_col))
    n = F.lit(float(max(2, ties.count())))
    term_n = term_counts(df, ties, text_col, min_letters).join(pairs.select("term").distinct(), "term", "left_semi")
    pmi = F.log(F.col("n_ct") * n / (F.col("n_c") * F.col("n_t")))
    ratio = pmi / F.log(n / F.col("n_c"))
    telling = (
        pairs.join(term_n, "term")
        .filter(F.col("n_c") < n)
        .withColumn("ratio", ratio)
        .filter(F.col("ratio") >= generalise_at)
        .select("entity", "term", "ratio")
    )
    # met by (entity, term), whatever the number of terms an entity has or of texts that hold it
    return (
        company.join(materialize(telling), ["entity", "term"])
        .select("_tie", "term", "ratio")
        .groupBy("_tie", "term")
        .agg(F.max("ratio").alias("ratio"))
        .withColumn("action", F.when(F.col("ratio") >= remove_at, "remove").otherwise("generalise"))
    )


def term_spans(private: DataFrame, telling: DataFrame, min_letters: int = MIN_LETTERS) -> DataFrame:
    """``_tie``, ``_terms``: spans of the terms to change, in order, clear of base spans.

    Runs of letters are laid out one per row and added up by a window per text.
    """
    some = private.join(telling.select("_tie").distinct(), "_tie", "left_semi")
    parts = some.select(
        "_tie",
        "_spans",
        F.posexplode(
            F.arrays_zip(
                F.split("_text", LETTERS, -1).alias("p"),
                F.regexp_extract_all("_text", F.lit(LETTERS), F.lit(0)).alias("m"),
            )
        ).alias("i", "x"),
    ).select("_tie", "_spans", "i", F.col("x.p").alias("p"), F.col("x.m").alias("m"))
    upto = Window.partitionBy("_tie").orderBy("i")
    width = F.length("p") + F.coalesce(F.length("m"), F.lit(0))
    placed = (
        parts.withColumn("e", F.sum(width).over(upto).cast("int"))
        .filter(F.length("m") >= min_letters)
        .withColumn("s", F.col("e") - F.length("m"))
        .withColumn("term", F.lower("m"))
    )
    clear = ~F.exists("_spans", lambda b: (b["s"] < F.col("e")) & (b["e"] > F.col("s")))
    return (
        placed.join(telling, ["_tie", "term"])
        .filter(clear)
        .groupBy("_tie")
        .agg(
            F.sort_array(
                F.collect_list(F.struct("s", F.lit(len(KINDS)).alias("k"), "e", "action"))
            ).alias("_terms")
        )
    )


def find_private(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_together: int = 2,
    generalise_at: float = 0.6,
    remove_at: float = 0.9,
    min_letters: int = MIN_LETTERS,
) -> DataFrame:
    """Per row of ``df``: id, base (spans), terms (spans with their action).

    Spans are (s, k, e) in code points, end exclusive, k the number of the kind.
    Null texts count as empty and have none. Equal texts get equal spans, whatever
    their ids; repeated rows stay rows; an empty table gives an empty result; other
    columns are not looked at.
    """
    found = find_base(df, id_col, text_col)
    telling = materialize(disclosures(df, id_col, text_col, min_together, generalise_at, remove_at, min_letters))
    private = found.filter(F.size("_spans") > 0).select("_tie", "_text", "_spans").dropDuplicates(["_tie"])
    terms = materialize(term_spans(private, telling, min_letters))
    none = F.array().cast("array<struct<s:int,k:int,e:int,action:string>>")
    return found.select("_id", "_tie", "_spans").join(terms, "_tie", "left").select(
        F.col("_id").alias(id_col),
        F.col("_spans").alias("base"),
        F.coalesce("_terms", none).alias("terms"),
    )


MASKS = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]"}


def masked(text: Column, spans: Column) -> Column:
    """``text`` with all that spans of (s, e, mask) cover replaced.

    Of spans with one start the longest counts; one that begins inside those before it
    and ends later has its mask stand for the rest.
    """
    ordered = F.sort_array(
        F.transform(
            spans,
            lambda x: F.struct(x["s"].alias("s"), (-x["e"]).alias("r"), x["e"].alias("e"), x["mask"].alias("mask")),
        )
    )

    def step(acc: Column, x: Column) -> Column:
        gap = F.substring(text, acc["at"] + 1, F.greatest(x["s"] - acc["at"], F.lit(0)))
        return F.when(x["e"] <= acc["at"], acc).otherwise(
            F.struct(x["e"].alias("at"), F.concat(acc["out"], F.array(gap, x["mask"])).alias("out"))
        )

    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    rest = F.aggregate(
        ordered,
        zero,
        step,
        lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(text, acc["at"] + 1, F.length(text))),
    )
    return F.when(F.size(spans) == 0, text).otherwise(rest)


def sanitised(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_letters: int = MIN_LETTERS, **thresholds: float
) -> DataFrame:
    """``df`` with personal data masked in its text; all columns and all rows stay.

    Base spans become their kind's mask, terms to generalise ``[TERM]``, terms to
    remove nothing. A text without personal data, also a null one, is left as it is.
    """
    telling = materialize(disclosures(df, id_col, text_col, min_letters=min_letters, **thresholds))
    found = find_base(df, id_col, text_col)
    private = found.filter(F.size("_spans") > 0).select("_tie", "_text", "_spans").dropDuplicates(["_tie"])
    terms = materialize(term_spans(private, telling, min_letters))
    text = F.coalesce(F.col(text_col), F.lit(""))
    masks = F.array(*[F.lit(MASKS[k]) for k in KINDS])
    packed = df.select(F.struct("*").alias("_doc"), text.alias("_text")).withColumn("_tie", F.xxhash64("_text"))
    base = F.transform(
        base_spans(F.col("_text")),
        lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), F.get(masks, x["k"]).alias("mask")),
    )
    extra = F.transform(
        F.coalesce("_terms", F.array().cast("array<struct<s:int,k:int,e:int,action:string>>")),
        lambda x: F.struct(
            x["s"].alias("s"),
            x["e"].alias("e"),
            F.when(x["action"] == "remove", F.lit("")).otherwise(F.lit("[TERM]")).alias("mask"),
        ),
    )
    joined = packed.join(terms.withColumnRenamed("_tie", "_tt"), F.col("_tie") == F.col("_tt"), "left")
    spans = F.sort_array(F.concat(base, extra))
    new = F.when(
        F.col(f"_doc.`{text_col}`").isNotNull(),
        let(spans, lambda s: masked(F.col("_text"), s)),
    )
    return joined.select(F.col("_doc").withField(f"`{text_col}`", new).alias("_doc")).select("_doc.*")
