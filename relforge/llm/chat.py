"""Chat formatting by quotation linking.

A message's lines carry a quote level: the number of leading ``>`` signs. Neighbouring lines of one level are a
passage, so quotes nest as levels do. A passage is normalised (lines joined, lower case, white space to one blank) and
hashed as a whole, and so are its lines and its sentences; a quotation that was wrapped anew or takes one sentence
keeps some of these hashes. They are joined to what messages wrote themselves. The original of a passage is the message
that covers the largest share of its words, of all earlier ones in the conversation and, for passages of FAR_WORDS
words or more, of all in others; a message replies to the original that most of its first-level words come from.
Messages are put in reply order and lose their quotes.

Shares are counted before anything is picked, but not for each pair of messages. Messages that wrote the same of what
is quoted anywhere are one class, equal passages are one too, and passages meet classes by the hashes that at most HOT
classes have. Hashes of more classes are few; there, passages and classes are compared by which of these they have.
Only then the places of the classes that cover enough are looked up.

DataFrame functions only. Places meet within blocks of a conversation's turns, so neither a line that stands in
every message nor a conversation of any length needs one task; across conversations a class is one row. Messages are
numbered in ranges (see ``scratch.numbered``), without their texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from relforge.sources.scratch import numbered

from .shared import saved, table

#: Words from which a passage is also looked for in other conversations, and the share of its words that an original
#: has to cover.
FAR_WORDS, LEAST_SHARE = 5, 0.5
#: Turns of a conversation whose places are sorted together, and classes of messages that a hash meets one by one.
TURNS, HOT = 4096, 200
_QUOTE = r"^[ \t]*(>[> \t]*)"
_HAS_QUOTE = r"(^|[\r\n])[ \t]*>"


def _normal(c):
    return F.trim(F.regexp_replace(F.lower(c), r"\s+", " "))


def passages(messages: DataFrame) -> DataFrame:
    """message, conv_id, turn, p (number of the passage), level, total (its words), kind, hash and words: the units of
    every run of lines of one level without a blank line: the whole (kind 0), its lines (1) and its sentences (2)."""
    each = messages.select("message", "conv_id", "turn", F.posexplode(F.split(F.coalesce("text", F.lit("")), r"\r\n|\r|\n", -1)).alias("i", "raw"))
    level = F.length(F.regexp_replace(F.regexp_extract("raw", _QUOTE, 1), "[^>]", ""))
    each = each.withColumn("level", level).withColumn("line", _normal(F.when(F.col("level") > 0, F.regexp_replace("raw", _QUOTE, "")).otherwise(F.col("raw"))))
    order = Window.partitionBy("message").orderBy("i")  # the lines of one text
    begins = ~F.lag("level").over(order).eqNullSafe(F.col("level")) | (F.lag("line").over(order) == "")
    runs = each.withColumn("begins", begins.cast("int")).withColumn("p", F.sum("begins").over(order)).where("line <> ''")
    lists = runs.groupBy("message", "conv_id", "turn", "p", "level").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "line"))), lambda x: x["line"]).alias("lines"))
    whole = lists.withColumn("whole", F.array_join("lines", " "))
    sentences = F.filter(F.transform(F.split("whole", "[.!?]+ "), lambda x: F.regexp_replace(x, "[.!?]+$", "")), lambda x: x != "")
    words = lambda x: F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit(""))) + 1
    unit = lambda kind: lambda x: F.struct(F.lit(kind).alias("kind"), F.xxhash64(x).alias("hash"), words(x).alias("words"))
    units = F.concat(F.transform(F.array("whole"), unit(0)), F.transform("lines", unit(1)), F.transform(sentences, unit(2)))
    return whole.select("message", "conv_id", "turn", "p", "level", words(F.col("whole")).alias("total"), F.explode(units).alias("u")).select("message", "conv_id", "turn", "p", "level", "total", "u.*")


def _nearest(asked: DataFrame, places: DataFrame) -> DataFrame:
    """conv_id, turn, group and near: for every asked place the latest earlier turn of the conversation of that group."""
    block = F.floor(F.col("turn") / TURNS).alias("block")
    both = asked.select("conv_id", "group", "turn", block, F.lit(None).cast("long").alias("wrote")).unionByName(places.select("conv_id", "group", "turn", block, F.col("turn").cast("long").alias("wrote")))
    before = Window.partitionBy("conv_id", "group", "block").orderBy("turn").rangeBetween(Window.unboundedPreceding, -1)  # TURNS turns at most
    inside = both.withColumn("near", F.max("wrote").over(before)).where("wrote IS NULL")
    tops = both.groupBy("conv_id", "group", "block").agg(F.max("wrote").alias("top"))
    blocks = Window.partitionBy("conv_id", "group").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # a row for TURNS turns
    earlier = tops.select("conv_id", "group", "block", F.max("top").over(blocks).alias("earlier"))
    return inside.join(earlier, ["conv_id", "group", "block"]).select("conv_id", "group", "turn", F.coalesce("near", "earlier").alias("near"))


def _farthest(places: DataFrame) -> DataFrame:
    """group, first and second: the first places of the two first conversations of it."""
    per = saved(places.groupBy("group", "conv_id").agg(F.min("turn").alias("turn")), "by_conversation")
    first = saved(per.groupBy("group").agg(F.min(F.struct("conv_id", "turn")).alias("first")), "first")
    second = per.join(first, "group").where("conv_id <> first.conv_id").groupBy("group").agg(F.min(F.struct("conv_id", "turn")).alias("second"))
    return first.join(second, "group", "left")


def _named(items, tag: str):
    """A name for a sorted list, of fixed width; lists of different tags have different ones."""
    return F.unhex(F.sha2(F.concat(F.lit(tag), F.to_json(items)).cast("binary"), 256))


def _shares(contents: DataFrame, sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(content, group and share, for the groups of messages that cover LEAST_SHARE of a content or more; group, class).

    contents: content, total, kind, hash, words; sets: class and hashes. A group is a class, or all classes with the
    same hot hashes; a class that shares rarer hashes with a content has its whole share as a class.
    """
    has = saved(sets.select("class", F.explode("hashes").alias("hash")), "has")
    hot = saved(has.groupBy("hash").agg(F.count("*").alias("n")).where(F.col("n") > HOT).select("hash", F.lit(True).alias("hot")), "hot")
    mark = lambda df: df.join(hot, "hash", "left").withColumn("hot", F.coalesce("hot", F.lit(False)))
    has, contents = saved(mark(has), "has"), saved(mark(contents), "contents")
    rare = contents.where("NOT hot").join(has.where("NOT hot").select("class", "hash"), "hash").groupBy("content", "total", "kind", "class").agg(F.sum("words").alias("rare"))
    asks = contents.where("hot").groupBy("content", "total").agg(F.array_sort(F.collect_list(F.struct("kind", "hash", "words"))).alias("x"))
    asks = saved(asks.withColumn("asked", _named(F.col("x"), "asked")), "asks")
    holds = has.where("hot").groupBy("class").agg(F.array_sort(F.collect_list("hash")).alias("x"))
    holds = saved(holds.withColumn("held", _named(F.col("x"), "held")), "holds")
    left = asks.groupBy("asked").agg(F.first("x").alias("x")).select("asked", F.explode("x").alias("u")).select("asked", "u.*")
    right = holds.groupBy("held").agg(F.first("x").alias("x")).select("held", F.explode("x").alias("hash"))
    common = saved(left.join(right, "hash").groupBy("asked", "kind", "held").agg(F.sum("words").alias("common")), "common")
    whole = rare.join(asks.select("content", "asked"), "content", "left").join(holds.select("class", "held"), "class", "left").join(common, ["asked", "kind", "held"], "left")
    whole = whole.select("content", F.col("class").alias("group"), ((F.col("rare") + F.coalesce("common", F.lit(0))) / F.col("total")).alias("share"))
    only = asks.select("content", "total", "asked").join(common, "asked").select("content", F.col("held").alias("group"), (F.col("common") / F.col("total")).alias("share"))
    enough = whole.unionByName(only).where(F.col("share") >= LEAST_SHARE).groupBy("content", "group").agg(F.max("share").alias("share"))
    groups = sets.select(F.col("class").alias("group"), "class").unionByName(holds.select(F.col("held").alias("group"), "class"))
    return saved(enough, "shares"), groups


def link(messages: DataFrame) -> DataFrame:
    """message, reply_conv, reply_turn, n_quoted (quoted passages) and n_linked (those with an original).

    messages: message (its own id), conv_id, turn (a number), text. Only messages with quoted passages are listed. A
    candidate is a place that wrote a unit of the passage: an earlier turn of the conversation, or, for FAR_WORDS words
    or more, any of another. The one with the largest share wins, then one of the same conversation, there the latest,
    else the first conversation's first. A passage quoted two levels deep is looked up by its words like any other, so
    it leads to the message that wrote it; only first-level passages decide whom a message replies to, unless none of
    them has an original.
    """
    units = saved(passages(messages), "units")
    quoted = units.where("level > 0").groupBy("message", "conv_id", "turn", "p", "level", "total", "kind", "hash").agg(F.sum("words").alias("words"))
    listed = quoted.groupBy("message", "conv_id", "turn", "p", "level", "total").agg(F.array_sort(F.collect_list(F.struct("kind", "hash", "words"))).alias("x"))  # units of one passage
    listed = saved(listed.withColumn("content", _named(F.col("x"), "content")), "listed")
    contents = listed.groupBy("content", "total").agg(F.first("x").alias("x")).select("content", "total", F.explode("x").alias("u")).select("content", "total", "u.*")
    wanted = saved(quoted.select("hash").distinct(), "hashes")
    own = units.where("level = 0").join(wanted, "hash", "left_semi")
    written = own.groupBy("conv_id", "turn").agg(F.array_sort(F.collect_set("hash")).alias("hashes"))  # units of one turn
    written = saved(written.withColumn("class", _named(F.col("hashes"), "class")), "written")
    shares, groups = _shares(contents, written.groupBy("class").agg(F.first("hashes").alias("hashes")))
    needed = saved(shares.select("group").distinct().join(groups, "group"), "needed")
    places = saved(written.select("conv_id", "turn", "class").join(needed, "class").select("group", "conv_id", "turn"), "places")
    occurrences = saved(listed.select("message", "conv_id", "turn", "p", "level", "total", "content").join(shares, "content"), "occurrences")
    near = saved(_nearest(occurrences.select("conv_id", "turn", "group").distinct(), places), "near")
    far = saved(_farthest(places), "far")
    each = occurrences.join(near, ["conv_id", "turn", "group"], "left").join(far, "group", "left")
    other = F.when(F.col("first.conv_id") != F.col("conv_id"), F.col("first")).otherwise(F.col("second"))
    place = lambda same, conv, turn: F.struct((~F.lit(same)).alias("other"), F.when(F.lit(same), -turn).otherwise(F.lit(0)).cast("long").alias("back"), conv.alias("reply_conv"), turn.cast("long").alias("reply_turn"))
    each = each.withColumn("other", F.when(F.col("total") >= FAR_WORDS, other))
    found = F.array(F.when(F.col("near").isNotNull(), place(True, F.col("conv_id"), F.col("near"))), F.when(F.col("other").isNotNull(), place(False, F.col("other.conv_id"), F.col("other.turn"))))
    best = each.select("message", "p", "level", "total", "share", F.explode(F.filter(found, lambda x: x.isNotNull())).alias("at"))
    best = best.groupBy("message", "p", "level", "total").agg(F.min(F.struct((-F.col("share")).alias("less"), "at.*")).alias("best"))
    votes = best.groupBy("message", (~F.col("best.other")).alias("same"), "best.reply_conv", "best.reply_turn").agg(F.sum(F.when(F.col("level") == 1, F.col("total")).otherwise(0)).alias("direct"), F.sum("total").alias("all"), F.count("*").alias("n"))
    chosen = votes.groupBy("message").agg(F.max(F.struct("direct", "all", "same", "reply_turn", "reply_conv")).alias("c"), F.sum("n").alias("n_linked"))
    counts = quoted.select("message", "p").distinct().groupBy("message").agg(F.count("*").alias("n_quoted"))
    return counts.join(chosen, "message", "left").select("message", F.col("c.reply_conv").alias("reply_conv"), F.col("c.reply_turn").alias("reply_turn"), "n_quoted", F.coalesce("n_linked", F.lit(0)).alias("n_linked"))


def conversations(table_of: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per message: conv_id, turn, position (in reply order, from 0), role, content (without quotes),
    reply_conv, reply_turn, n_quoted, n_linked.

    A message without a linked quote replies to the message before it (reply_turn null for the first). Reply
    order puts each message behind what it replies to: by the turn it replies to within the conversation when it
    quotes, and by its own turn. Messages of one turn come in the order of their role and text's digest; repeated rows
    count each. A null text is empty; rows with a null conversation or turn keep their place (null first) and are
    linked with nothing. Lines that are quotes go, blank and unlinked ones too, and blank lines at either end with
    them. Other columns are ignored.
    """
    rows = table_of.select(F.monotonically_increasing_id().alias("message"), F.col(conv).alias("conv_id"), F.col(turn).alias("turn"), F.col(role).alias("role"), F.col(text).alias("text"))
    rows = saved(rows, "messages")
    known = rows.where("conv_id IS NOT NULL AND turn IS NOT NULL")
    quoting = known.where(F.col("text").rlike(_HAS_QUOTE))
    links = link(known) if not quoting.isEmpty() else rows.where("false").select("message", F.col("conv_id").alias("reply_conv"), F.col("turn").alias("reply_turn"), F.lit(0).cast("long").alias("n_quoted"), F.lit(0).cast("long").alias("n_linked"))
    tie = [F.asc_nulls_first("role"), F.col("digest")]
    slim = rows.select("message", "conv_id", "turn", "role", F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("digest"))
    by_turn = saved(numbered(slim, [F.asc_nulls_first("turn"), *tie], "k", ["conv_id"]), "turns")
    before = by_turn.select(F.col("conv_id").alias("c"), (F.col("k") + 1).alias("j"), F.col("turn").alias("before"))
    placed = by_turn.join(before, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("k") == F.col("j")), "left").join(links, "message", "left")
    linked_here = F.col("reply_turn").isNotNull() & (F.col("reply_conv") == F.col("conv_id"))
    placed = placed.withColumn("after", F.when(linked_here, F.col("reply_turn")).otherwise(F.coalesce("before", "turn")))
    placed = placed.select("message", "conv_id", "turn", "role", "digest", "before", "after", "reply_conv", "reply_turn", "n_quoted", "n_linked")
    ordered = numbered(placed, [F.asc_nulls_first("after"), F.asc_nulls_first("turn"), *tie], "position", ["conv_id"], start=0)
    kept = F.filter(F.split(F.coalesce("text", F.lit("")), r"\r\n|\r|\n", -1), lambda x: ~x.rlike(r"^[ \t]*>"))
    content = F.rtrim(F.regexp_replace(F.array_join(kept, "\n"), r"\A[ \t\n]*\n", ""), F.lit(" \t\n"))
    whole = rows.select("message", F.when(F.col("text").rlike(_HAS_QUOTE), content).otherwise(F.coalesce("text", F.lit(""))).alias("content"))
    return ordered.join(whole, "message").select(
        *("conv_id", "turn", "position", "role", "content"),
        F.coalesce("reply_conv", F.when(F.col("before").isNotNull(), F.col("conv_id"))).alias("reply_conv"),
        F.coalesce("reply_turn", "before").alias("reply_turn"),
        F.coalesce("n_quoted", F.lit(0)).alias("n_quoted"),
        F.coalesce("n_linked", F.lit(0)).alias("n_linked"),
    )


def op6_chat(spark, sf_dir: str) -> DataFrame:
    """Every message in reply order, without quotes and with what it replies to (-1: nothing)."""
    return conversations(table(spark, sf_dir, "conversations")).fillna(-1, ["reply_conv", "reply_turn"])


ORACLE = r"""
WITH m AS (SELECT row_number() OVER () AS message, conv_id, turn, role, coalesce(text, '') AS text FROM conversations),
l AS (SELECT message, conv_id, turn, unnest(parts) AS raw, generate_subscripts(parts, 1) AS i FROM (SELECT *, regexp_split_to_array(text, '\r\n|\r|\n') AS parts FROM m)),
h AS (SELECT message, conv_id, turn, i, length(regexp_replace(regexp_extract(raw, '^[ \t]*(>[> \t]*)', 1), '[^>]', '', 'g')) AS level,
             trim(regexp_replace(lower(regexp_replace(raw, '^[ \t]*>[> \t]*', '')), '\s+', ' ', 'g')) AS line FROM l),
b AS (SELECT *, CASE WHEN lag(level) OVER w IS DISTINCT FROM level OR lag(line) OVER w = '' THEN 1 ELSE 0 END AS begins FROM h WINDOW w AS (PARTITION BY message ORDER BY i)),
r AS (SELECT *, sum(begins) OVER (PARTITION BY message ORDER BY i) AS p FROM b),
g AS (SELECT message, conv_id, turn, p, level, string_agg(line, ' ' ORDER BY i) AS whole, list(line ORDER BY i) AS lines FROM r WHERE line <> '' GROUP BY ALL),
s AS (SELECT *, len(string_split(whole, ' ')) AS total, list_filter(list_transform(regexp_split_to_array(whole, '[.!?]+ '), lambda x: regexp_replace(x, '[.!?]+$', '')), lambda x: x <> '') AS sentences FROM g),
u AS (SELECT message, conv_id, turn, p, level, total, 0 AS kind, whole AS u FROM s UNION ALL SELECT message, conv_id, turn, p, level, total, 1, unnest(lines) FROM s UNION ALL SELECT message, conv_id, turn, p, level, total, 2, unnest(sentences) FROM s),
q AS (SELECT row_number() OVER () AS id, *, len(string_split(u, ' ')) AS words FROM u WHERE level > 0),
o AS (SELECT DISTINCT conv_id, turn, u FROM u WHERE level = 0),
covered AS (SELECT q.message, q.conv_id, q.p, q.level, q.total, q.kind, o.conv_id AS reply_conv, o.turn AS reply_turn, sum(q.words) / any_value(q.total) AS share
            FROM q JOIN o ON o.u = q.u AND ((o.conv_id = q.conv_id AND o.turn < q.turn) OR (o.conv_id <> q.conv_id AND q.total >= 5)) GROUP BY ALL),
best AS (SELECT message, p, level, total, CAST(conv_id = reply_conv AS INT) AS same, reply_conv, reply_turn FROM covered WHERE share >= 0.5
         QUALIFY row_number() OVER (PARTITION BY message, p ORDER BY share DESC, conv_id = reply_conv DESC, CASE WHEN conv_id = reply_conv THEN -reply_turn ELSE 0 END, reply_conv, reply_turn) = 1),
votes AS (SELECT message, same, reply_conv AS rc, reply_turn AS rt, sum(CASE WHEN level = 1 THEN total ELSE 0 END) AS direct, sum(total) AS words, count(*) AS n FROM best GROUP BY ALL),
chosen AS (SELECT message, rc, rt, sum(n) OVER (PARTITION BY message) AS n_linked FROM votes QUALIFY row_number() OVER (PARTITION BY message ORDER BY direct DESC, words DESC, same DESC, rt DESC, rc DESC) = 1),
tally AS (SELECT message, count(DISTINCT p) AS n_quoted FROM q GROUP BY message),
j AS (SELECT m.*, rc, rt, coalesce(n_quoted, 0) AS n_quoted, coalesce(n_linked, 0) AS n_linked,
             lag(m.turn) OVER (PARTITION BY m.conv_id ORDER BY m.turn NULLS FIRST, m.role NULLS FIRST, md5(m.text)) AS before
      FROM m LEFT JOIN chosen USING (message) LEFT JOIN tally USING (message)),
p AS (SELECT *, CASE WHEN rt IS NOT NULL AND rc = conv_id THEN rt ELSE coalesce(before, turn) END AS after FROM j)
SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY after NULLS FIRST, turn NULLS FIRST, role NULLS FIRST, md5(text)) - 1 AS position, role,
       CASE WHEN NOT regexp_matches(text, '(^|[\r\n])[ \t]*>') THEN text ELSE rtrim(regexp_replace(array_to_string(list_filter(regexp_split_to_array(text, '\r\n|\r|\n'), lambda x: NOT regexp_matches(x, '^[ \t]*>')), chr(10)), '\A[ \t\n]*\n', ''), ' ' || chr(9) || chr(10)) END AS content,
       coalesce(rc, CASE WHEN before IS NOT NULL THEN conv_id END, -1) AS reply_conv, coalesce(rt, before, -1) AS reply_turn,
       CAST(n_quoted AS BIGINT) AS n_quoted, CAST(n_linked AS BIGINT) AS n_linked
FROM p
"""
