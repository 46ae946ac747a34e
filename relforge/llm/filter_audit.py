"""Filter interaction audit by direct relational replay.

Every document is judged by all filters once; its failures are the bits of one number. The documents' flags are
crossed with all orders of the filters (120 for five, broadcast), each order's steps are exploded, and the first step
whose filter the document fails is where that order removes it. Conditional counts by part, order and step do the
rest: they are combined in every task before they move, so what is shuffled is a row for each part, order and step.

Copies are told by the SHA-256 of the whole text. A text's least id is a minimum that is combined in every task; only
texts that occur again are joined back, and a text that a third of all documents hold is one row there.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import saved, table

#: The filters' letters in their natural order, and the white space between words.
FILTERS = "ABCDE"
SPACE = r"[\x20\x09-\x0D]+"
#: Rows of fixed width (at most some 100 bytes) that are sent to every executor; more of them are joined by a shuffle.
BROADCAST_ROWS = 100_000


def failures(text: Column) -> dict[str, Column]:
    """The failure conditions that a text alone decides (null: empty): A under 200 words, B fewer than half of the
    words distinct, C more than 3 % of the characters in A-Z, D one of the characters #$%&*|."""
    t = F.coalesce(text, F.lit(""))
    words = F.array_remove(F.split(t, SPACE), "")
    return {
        "A": F.size(words) < 200,
        "B": F.size(F.array_distinct(words)) * 100 < F.size(words) * 50,
        "C": (F.length(t) - F.length(F.regexp_replace(t, "[A-Z]+", ""))) * 100 > F.length(t) * 3,
        "D": t.rlike(r"[#$%&*|]"),
    }


def _beside(rows: DataFrame, facts: DataFrame, key: str) -> DataFrame:
    """rows with what is known of their key. Large tables are joined by a shuffle, where Spark splits a hot key."""
    facts = saved(facts, "facts")
    return rows.join(F.broadcast(facts) if facts.count() <= BROADCAST_ROWS else facts, key, "left")


def flagged(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """part, flags (bit i: filter i of FILTERS fails), good and toxic, a row for each document.

    E fails if a smaller key anywhere in the table has the same text (null: empty); a null key has none smaller and
    is smaller than none, and rows that share key and text don't fail by each other. A null part is the empty string.
    A key with several labels is good or toxic if any of them says so; one without is neither.
    """
    own = failures(F.col(text))
    bits = sum((F.when(own[c], F.lit(1 << i)).otherwise(F.lit(0)) for i, c in enumerate(FILTERS[:-1])), F.lit(0))
    digest = F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256))
    slim = saved(docs.select(F.col(key).alias("_key"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), bits.cast("int").alias("own"), digest.alias("digest")), "flags")
    repeated = slim.groupBy("digest").agg(F.min("_key").alias("least"), F.count("*").alias("n")).where("n > 1").drop("n")
    says = lambda c: F.max(F.coalesce(F.col(c) == 1, F.lit(False)))
    known = labels.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("_key")).agg(says("quality").alias("good"), says("toxic").alias("toxic")).where("good OR toxic")
    rows = _beside(_beside(slim, repeated, "digest"), known, "_key")
    copy = F.coalesce(F.col("_key") > F.col("least"), F.lit(False))
    flags = F.col("own") + F.when(copy, F.lit(1 << (len(FILTERS) - 1))).otherwise(F.lit(0))
    return rows.select("part", flags.alias("flags"), *[F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic")])


def replay(rows: DataFrame, filters: str = FILTERS) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost and shapley for every
    part of rows (part, flags, good, toxic) and every order of the filters; an empty table has no parts.

    kept: documents that pass this step and all before it; removed: those whose first failure it is; redundant: those
    that fail it and an earlier one; unique_fails: those that fail it alone; shapley: the filter's removed of all
    orders, at whatever step.
    """
    n = len(filters)
    orders = [(k, "".join(o), [(s, 1 << filters.index(c)) for s, c in enumerate(o, 1)]) for k, o in enumerate(permutations(filters))]
    names = rows.sparkSession.createDataFrame([(k, o) for k, o, _ in orders], "k int, filter_order string")
    steps = rows.sparkSession.createDataFrame([(k, s) for k, _, s in orders], "k int, steps array<struct<step:int,bit:int>>")
    fails = lambda bit: F.col("flags").bitwiseAND(bit) != 0
    first = F.lit(n + 1)
    for s in range(n, 0, -1):
        first = F.when(fails(F.col("steps")[s - 1]["bit"]), F.lit(s)).otherwise(first)
    crossed = rows.crossJoin(F.broadcast(steps)).withColumn("first", first)
    each = crossed.select("part", "flags", "good", "toxic", "k", "first", F.explode("steps").alias("s")).select("*", "s.*")
    count = lambda c: F.count(F.when(c, 1))
    here = F.col("first") == F.col("step")
    counts = each.groupBy("part", "k", "step", "bit").agg(
        count(F.col("first") > F.col("step")).alias("kept"), count(here).alias("removed"), count((F.col("first") < F.col("step")) & fails(F.col("bit"))).alias("redundant"),
        count(F.col("flags") == F.col("bit")).alias("unique_fails"), count(here & F.col("good")).alias("good_lost"), count(here & F.col("toxic")).alias("toxic_lost"),
    )
    shapley = F.sum("removed").over(Window.partitionBy("part", "bit"))  # a row for each order
    return counts.withColumn("shapley", shapley).join(F.broadcast(names), "k").select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def op12_filter_audit(spark, sf_dir: str) -> DataFrame:
    """The five filters over all documents, in all their orders, by language."""
    return replay(flagged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


_ORDERS = ", ".join(f"('{''.join(o)}')" for o in permutations(FILTERS))
ORACLE = rf"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
        CASE WHEN len(w) < 200 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 'B' ELSE '' END
        || CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t) THEN 'C' ELSE '' END || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END
        || CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 'E' ELSE '' END AS failed
      FROM d LEFT JOIN l USING (doc_id)),
o AS (SELECT o AS filter_order FROM (VALUES {_ORDERS}) v(o)),
r AS (SELECT f.*, filter_order, coalesce(list_min(list_transform(string_split(nullif(failed, ''), ''), lambda x: instr(filter_order, x))), 6) AS first FROM f, o),
c AS (SELECT part, filter_order, CAST(s AS INT) AS step, substr(filter_order, s, 1) AS filter, count(*) FILTER (first > s) AS kept, count(*) FILTER (first = s) AS removed,
        count(*) FILTER (first < s AND contains(failed, substr(filter_order, s, 1))) AS redundant, count(*) FILTER (failed = substr(filter_order, s, 1)) AS unique_fails,
        count(*) FILTER (first = s AND good) AS good_lost, count(*) FILTER (first = s AND toxic) AS toxic_lost
      FROM r, (VALUES (1), (2), (3), (4), (5)) v(s) GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, filter) AS BIGINT) AS shapley FROM c
"""
