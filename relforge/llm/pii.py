"""Personal data: base patterns, and identifiers found by bootstrapped contextual extraction.

Base entities (e-mail, IP address, card number, phone number) come from patterns that run in time linear in the
text. They are also the seeds of the bootstrap, as are candidates whose form alone tells (SHAPES). The one to three
tokens to the left and to the right of a value, words and marks alike, are lexical patterns if a word is among them
(``token = "``). Patterns and the values beside them form a graph; a pattern's score is the share of all its
occurrences in the corpus, beside whatever, that stand beside a trusted value, and a value's score is the chance that
one of its patterns is right. The scores are computed in a fixed number of rounds; candidates (tokens with digits
that are no base entity) beside high-scoring patterns become spans of kind ``id``. In every round the contexts of all
values trusted by then are patterns, so identifiers found by one pattern lead to others.

DataFrame functions only. Texts are scanned once for entities and candidates and once for the patterns' counts;
what moves are matches with a few characters around them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import saved, table

KINDS = ("email", "ip", "card", "phone", "id")
#: Tokens of a pattern at most, and characters beside a value in which they are looked for.
CONTEXT = 3
BESIDE = 64
MIN_SEEDS = 3
ROUNDS = 3
CONFIDENCE = 0.5
#: Patterns up to this number go to the executors for counting; more are joined by a shuffle.
BROADCAST_PATTERNS = 500_000

#: Stand-ins for a dot (separator) that the pattern can't use; the same character in a text becomes the other one.
_OUT, _OTHER = "\u0002", "\u0003"
_EMAIL = rf"(?:(?<![A-Za-z0-9._%+\-{_OUT}])|\G)[A-Za-z0-9._%+\-{_OUT}]++@[A-Za-z0-9-]++\.[A-Za-z0-9.-]++"
_EMAIL_DOTS = r"\.(?![A-Za-z0-9-])|(?<![A-Za-z0-9-])\."
_IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
_CARD = r"[0-9][0-9 -]{11,}+"
_CARD_GAPS = r"[ -](?![0-9])|(?<![0-9])[ -]"
_PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
_CANDIDATE = r"(?<![A-Za-z0-9_-])(?=[A-Za-z_-]*+[0-9])[A-Za-z0-9][A-Za-z0-9_-]{5,}+"
_TOKEN = r"[\p{L}\p{N}_]+|[^\s\p{L}\p{N}_]"
#: Forms (in small letters) of candidates that are seeds: keys and digests in hexadecimal digits, and
#: the published prefixes of access keys, tokens and web tokens.
SHAPES = (r"(?=[0-9]*[a-f])(?=[a-f]*[0-9])[0-9a-f]{32,}", r"akia[0-9a-z]{16}", r"gh[opsur]_[0-9a-z]{36}", r"xox[abprs]-[0-9a-z-]{10,}", r"sk-[0-9a-z_-]{20,}", r"eyj[0-9a-z_-]{20,}")


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether the check digit of up to 19 digits is right."""
    figures = F.transform(F.split(F.reverse(digits), ""), lambda d, i: d.cast("int") * (1 + i % 2))
    return F.aggregate(figures, F.lit(0), lambda a, d: a + d - F.when(d > 9, 9).otherwise(0)) % 10 == 0


def _valid(kind: Column, value: Column) -> Column:
    part = lambda p: (F.length(F.regexp_replace(p, "^0+", "")) <= 3) & (F.coalesce(F.substring(F.regexp_replace(p, "^0+", ""), 1, 3).try_cast("int"), F.lit(0)) <= 255)
    n = F.length(_digits(value))
    return (
        F.when(kind == "ip", F.forall(F.split(value, r"\."), part))
        .when(kind == "card", F.when(n.between(12, 19), _luhn(_digits(value))).otherwise(False))
        .when(kind == "phone", n.between(9, 15))
        .otherwise(True)
    )


def _pieces(text: Column, pattern: str) -> Column:
    """What lies before each match, the match, and what lies behind it; the last has no match."""
    gaps = F.split(text, pattern, -1)
    return F.arrays_zip(gaps.alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("value"), F.slice(gaps, F.lit(2), F.size(gaps)).alias("next"))


def _tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(_TOKEN), F.lit(0))


def _patterns(left: Column, right: Column) -> Column:
    """The patterns beside a value: the side, and one to CONTEXT tokens that hold a word; left and right are tokens."""
    grams = []
    for k in range(1, CONTEXT + 1):
        grams += [F.when(F.size(left) >= k, F.struct(F.lit("left").alias("side"), F.array_join(F.slice(left, -k, k), " ").alias("gram")))]
        grams += [F.when(F.size(right) >= k, F.struct(F.lit("right").alias("side"), F.array_join(F.slice(right, 1, k), " ").alias("gram")))]
    return F.filter(F.array(*grams), lambda g: g.isNotNull() & g["gram"].rlike(r"[\p{L}\p{N}]"))


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """row, key, text_hash, kind, start, stop, value and patterns for every base entity and every
    candidate (kind ``id``) of every text, and a row with a null kind for a text that has none. Positions are code
    points, from 0, the end exclusive."""
    t = F.coalesce(F.col(text), F.lit(""))
    clean = F.translate(t, _OUT, _OTHER)
    kinds = {
        "email": (F.contains(t, F.lit("@")), F.regexp_replace(clean, _EMAIL_DOTS, _OUT), _EMAIL),
        "ip": (F.col("_t").rlike(_IP), F.col("_t"), _IP),
        "card": (F.col("_t").rlike(_CARD), F.regexp_replace(clean, _CARD_GAPS, _OUT), _CARD),
        "phone": (F.contains(t, F.lit("+")), F.col("_t"), _PHONE),
        "id": (F.col("_t").rlike("[0-9]"), F.col("_t"), _CANDIDATE),
    }
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("key"), F.col(text)).withColumns({"_t": t, "text_hash": F.xxhash64(t)})
    found = F.array(*[F.struct(F.lit(k).alias("kind"), F.when(test, _pieces(where, pattern)).alias("pieces")) for k, (test, where, pattern) in kinds.items()])
    found = F.filter(found, lambda f: F.size(f["pieces"]) > 1)
    each = rows.select("row", "key", "text_hash", F.explode_outer(found).alias("f")).select("row", "key", "text_hash", "f.kind", F.posexplode_outer("f.pieces").alias("i", "p"))
    each = each.select(
        *("row", "key", "text_hash", "kind", "i"),
        F.length("p.gap").alias("gap"),
        F.translate(F.right("p.gap", F.lit(BESIDE)), _OUT, ".").alias("before"),
        F.translate(F.left("p.next", F.lit(BESIDE)), _OUT, ".").alias("behind"),
        F.translate("p.value", _OUT, ".").alias("value"),
    )
    upto = Window.partitionBy("row", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    stop = F.sum(F.col("gap") + F.coalesce(F.length("value"), F.lit(0))).over(upto)
    each = each.withColumn("stop", stop).where("kind IS NULL OR value IS NOT NULL OR i = 0")  # the first stays for its text
    good = F.col("value").isNotNull() & _valid(F.col("kind"), F.col("value"))
    return each.select(
        *("row", "key", "text_hash"),
        F.when(good, F.col("kind")).alias("kind"),
        F.when(good, F.col("stop") - F.length("value")).alias("start"),
        F.when(good, F.col("stop")).alias("stop"),
        F.when(good, F.lower("value")).alias("value"),
        F.when(good, _patterns(_tokens(F.col("before")), _tokens(F.col("behind")))).alias("patterns"),
    )


def _apart(found: DataFrame) -> DataFrame:
    """found without the candidates that overlap a base entity of their text."""
    order = Window.partitionBy("row").orderBy("start", "stop")
    base = F.col("kind") != "id"
    ended = F.max(F.when(base, F.col("stop"))).over(order.rowsBetween(Window.unboundedPreceding, 0))
    begins = F.min(F.when(base, F.col("start"))).over(order.rowsBetween(0, Window.unboundedFollowing))
    marked = found.withColumns({"_ended": ended, "_begins": begins})
    clash = (F.col("kind") == "id") & (F.coalesce(F.col("_ended") > F.col("start"), F.lit(False)) | F.coalesce(F.col("_begins") < F.col("stop"), F.lit(False)))
    return marked.where(~clash).drop("_ended", "_begins")


def _seed() -> Column:
    return (F.col("kind") != "id") | F.col("value").rlike(f"^(?:{'|'.join(SHAPES)})$")


def _run_of(k: int):
    """A token with the k tokens behind it; null near the end."""
    return lambda x, i: F.concat(x, *[c for j in range(1, k + 1) for c in (F.lit(" "), F.get("t", i + j))])


def _grams(texts: DataFrame) -> DataFrame:
    """gram: every run of one to CONTEXT tokens of the texts (a single column)."""
    tokens = texts.select(_tokens(F.col(texts.columns[0])).alias("t"))
    runs = [F.col("t")]
    for k in range(1, CONTEXT):
        runs.append(F.filter(F.transform("t", _run_of(k)), lambda g: g.isNotNull()))
    return tokens.select(F.explode(F.concat(*runs)).alias("gram"))


def bootstrap(docs: DataFrame, found: DataFrame, text: str = "text") -> DataFrame:
    """side, gram, confidence: the lexical patterns whose confidence reaches CONFIDENCE after ROUNDS rounds.

    found: what scan() gives, without overlaps. A pattern takes part from the round in which MIN_SEEDS different
    values beside it are trusted (seeds, and values whose belief reaches CONFIDENCE). Patterns with fewer values
    beside them can't; all others are counted in the texts once.
    """
    pattern = ["side", "gram"]
    each = found.where("kind IS NOT NULL").select("value", _seed().alias("seed"), F.explode("patterns").alias("p")).select("p.*", "value", "seed")
    edges = saved(each.groupBy(*pattern, "value").agg(F.count("*").alias("n"), F.max("seed").alias("seed")), "edges")
    wide = saved(edges.groupBy(*pattern).agg(F.count("*").alias("values")).where(F.col("values") >= MIN_SEEDS).select(*pattern), "patterns")
    grams = saved(wide.select("gram").distinct(), "grams")
    every = _grams(docs.select(text))
    if grams.count() <= BROADCAST_PATTERNS:
        totals = every.join(F.broadcast(grams), "gram", "left_semi").groupBy("gram").agg(F.count("*").alias("total"))
    else:  # counted before they move, so that a common word is one row of each task
        totals = every.groupBy("gram").agg(F.count("*").alias("total")).join(grams, "gram", "left_semi")
    graph = saved(edges.join(wide, pattern, "left_semi").join(saved(totals, "totals"), "gram"), "graph")
    trust = F.when(F.col("seed"), F.lit(1.0)).otherwise(F.lit(0.0))
    scored = graph.withColumn("trust", trust)
    for last in range(ROUNDS - 1, -1, -1):
        confidence = F.least(F.sum(F.col("n") * F.col("trust")) / F.greatest(F.max("total"), F.sum("n")), F.lit(1.0))
        trusted = F.count(F.when(F.col("trust") > 0, 1))
        by_pattern = saved(scored.groupBy(*pattern).agg(confidence.alias("confidence"), trusted.alias("trusted")).where(F.col("trusted") >= MIN_SEEDS).drop("trusted"), "confidence")
        if last:
            doubt = F.exp(F.sum(F.log(F.greatest(1 - F.col("confidence"), F.lit(1e-9)))))
            by_value = graph.join(by_pattern, pattern).groupBy("value").agg((1 - doubt).alias("belief"))
            belief = F.when(F.col("seed"), 1.0).when(F.col("belief") >= CONFIDENCE, F.col("belief")).otherwise(0.0)
            scored = saved(graph.join(by_value, "value", "left").withColumn("trust", belief).drop("belief"), "trust")
    return by_pattern.where(F.col("confidence") >= CONFIDENCE)


def spans(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """row, key, text_hash, kind, start, stop: every base entity and every discovered identifier, and a row
    with a null kind for each text (so that texts without a span are there too).

    A null or empty text has no spans; repeated rows have their spans each; other columns are ignored.
    """
    found = saved(scan(docs, key, text), "entities")
    apart = saved(_apart(found.where("kind IS NOT NULL")), "apart")
    good = bootstrap(docs, apart, text).select("side", "gram")
    columns = ["row", "key", "text_hash", "kind", "start", "stop"]
    new = apart.where("kind = 'id'").select(*columns, F.explode("patterns").alias("p")).select(*columns, "p.*").join(good, ["side", "gram"], "left_semi").select(columns).distinct()
    none = found.select("row", "key", "text_hash").distinct().select("*", F.lit(None).cast("string").alias("kind"), F.lit(None).cast("long").alias("start"), F.lit(None).cast("long").alias("stop"))
    known = apart.where("kind <> 'id'").select(columns)
    return known.unionByName(new).unionByName(none)


def _listed(all_kinds: bool) -> Column:
    rank = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    named = F.struct("start", rank.alias("rank"), F.concat_ws(":", "kind", "start", "stop").alias("s"))
    rows = F.collect_list(F.when(F.col("kind").isNotNull() & (F.lit(all_kinds) | (F.col("kind") != "id")), named))
    return F.concat_ws(",", F.transform(F.array_sort(rows), lambda x: x["s"]))


def redact(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with every span replaced by its kind in capitals and brackets; overlapping spans merge under the
    first one's name. Null texts stay null; all rows and columns stay."""
    found = spans(docs, key, text).where("kind IS NOT NULL").select("key", "text_hash", "kind", "start", "stop").distinct()
    rank = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    order = Window.partitionBy("key", "text_hash").orderBy("start", rank, "stop")
    before = F.max("stop").over(order.rowsBetween(Window.unboundedPreceding, -1))
    groups = found.withColumn("before", before).withColumn("g", F.sum(F.when(F.coalesce(F.col("start") < F.col("before"), F.lit(False)), 0).otherwise(1)).over(order))
    merged = groups.groupBy("key", "text_hash", "g").agg(F.min("start").alias("start"), F.max("stop").alias("stop"), F.min_by("kind", F.struct("start", rank)).alias("kind"))
    lists = saved(merged.groupBy("key", "text_hash").agg(F.array_sort(F.collect_list(F.struct("start", "stop", "kind"))).alias("_spans")).withColumnsRenamed({"key": "_key", "text_hash": "_text_hash"}), "spans")
    size = lists.select(F.sum(F.size("_spans"))).first()[0] or 0
    body = F.col(text)
    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))
    step = lambda a, s: F.struct(s["stop"].alias("at"), F.concat(a["out"], F.substring(body, (a["at"] + 1).cast("int"), (s["start"] - a["at"]).cast("int")), F.lit("["), F.upper(s["kind"]), F.lit("]")).alias("out"))
    done = F.aggregate("_spans", start, step, lambda a: F.concat(a["out"], F.substring(body, (a["at"] + 1).cast("int"), F.length(body))))
    joined = docs.join(F.broadcast(lists) if size <= 500_000 else lists, F.col(key).eqNullSafe(F.col("_key")) & (F.xxhash64(F.coalesce(body, F.lit(""))) == F.col("_text_hash")), "left")
    return joined.select(*[F.when(F.col("_spans").isNull() | body.isNull(), body).otherwise(done).alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns])


def op9_pii(spark, sf_dir: str) -> DataFrame:
    """Counts of base entities, their digest, and all spans of every document."""
    found = spans(table(spark, sf_dir, "documents"))
    counts = [F.count(F.when(F.col("kind") == k, 1)).alias(f"n_{k}") for k in KINDS[:4]]
    out = found.groupBy("row", "key").agg(*counts, F.sha2(_listed(False), 256).alias("base_sha256"), _listed(True).alias("spans"))
    return out.select(F.col("key").alias("doc_id"), "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans")
