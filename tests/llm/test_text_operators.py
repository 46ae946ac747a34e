"""Decontamination, near-duplicates, personal data and chats against brute-force versions, with odd rows."""

import re
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from relforge.llm import chat, decontamination, near_dedup, pii

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omikron pi rho sigma tau upsilon".split()


def text_of(seed, n):
    return " ".join(WORDS[(seed * 7 + i * (seed + 3)) % 20] + str((seed + i) % 11) for i in range(n))


# Decontamination


def windows_of(text):
    w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    k = min(10, len(w))
    return w, {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if k else set()


def brute_overlap(docs, items):
    out = []
    for _, text in docs:
        w, _ = windows_of(text)
        hit, found = set(), set()
        for item, t in items:
            for win in windows_of(t)[1]:
                for i in range(len(w) - len(win) + 1):
                    if tuple(w[i : i + len(win)]) == win:
                        hit |= set(range(i, i + len(win)))
                        found.add(str(item))
        out.append((len(w), len(hit), sorted(found)))
    return out


def test_overlap_equals_brute_force(spark):
    items = [(1, text_of(1, 14)), (2, "Two words"), (3, "one"), (4, ""), (5, None), (6, text_of(1, 14)), (None, text_of(9, 12))]
    docs = [(1, f"x {text_of(1, 14).upper()}, y"), (2, "two-WORDS two, words"), (3, None), (4, ""), (5, text_of(2, 30)), (None, "one"), (7, " ".join(text_of(1, 14).split()[:9])), (8, f"{text_of(1, 14)} {text_of(1, 14)}"), (8, "one"), (9, "é One ü")]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", F.lit(1)).withColumn("n_words", F.lit("x"))
    b = spark.createDataFrame(items, "item_id long, text string")
    got = sorted(((r["n_words"], r["n_hit"], sorted(i for i in r["items"])) for r in decontamination.overlap(d, b).collect()), key=str)
    want = [(n, h, [i for i in f if i != "None"]) for n, h, f in brute_overlap(docs, items)]
    assert got == sorted(want, key=str)


def test_a_window_of_many_items(spark):
    from pyspark.sql import functions as F

    passage = text_of(1, 10)
    b = spark.range(10_000).select(F.col("id").alias("item_id"), F.lit(passage).alias("text"))
    d = spark.createDataFrame([(i, f"x{i} {passage} {passage} y") for i in range(50)] + [(99, "clean")], "doc_id long, text string")
    got = decontamination.overlap(d, b).select("doc_id", "n_hit", "n_items", F.size("items").alias("listed"), F.size("hits").alias("hits")).collect()
    assert sorted(map(tuple, got)) == [(i, 20, 10_000, 10_000, 2) for i in range(50)] + [(99, 0, 0, 0, 0)]


def test_overlap_of_empty_tables(spark):
    d = spark.createDataFrame([], "doc_id long, text string")
    b = spark.createDataFrame([], "item_id long, text string")
    assert decontamination.overlap(d, b).count() == 0
    one = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert [tuple(r) for r in decontamination.overlap(one, b).select("n_words", "n_hit", "contaminated").collect()] == [(2, 0, False)]


def test_blocks_give_the_same(spark, monkeypatch):
    d = spark.createDataFrame([(i, text_of(i % 5, 40)) for i in range(8)], "doc_id long, text string")
    b = spark.createDataFrame([(i, text_of(i, 13)) for i in range(6)], "item_id long, text string")
    key = lambda rows: sorted((r["doc_id"], r["n_words"], r["n_hit"], tuple(r["items"])) for r in rows)
    whole = key(decontamination.overlap(d, b).collect())
    monkeypatch.setattr(decontamination, "WINDOWS_PER_BLOCK", 9)
    assert key(decontamination.overlap(d, b).collect()) == whole


# Near duplicates


def shingles(text, k):
    w = [x for x in re.split("[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if x]
    n = min(k, len(w))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if n else set()


def brute_components(docs, k):
    sets = {i: shingles(t, k) for i, t in docs}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in combinations(sorted(sets), 2):
        x, y = sets[a], sets[b]
        if x and y and 100 * len(x & y) >= 80 * len(x | y):
            ra, rb = find(a), find(b)
            root[max(ra, rb)] = min(ra, rb)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def near_copies():
    base = [f"{WORDS[i % 20]}{i}" for i in range(80)]
    docs = [(0, " ".join(base)), (1, " ".join(base).upper()), (2, "  ".join(base) + "\n")]
    for i in range(3, 60):  # more and more edits, some shared
        w = list(base)
        for e in range(i % 9):
            w[(e * 17 + i // 9) % 80] = f"edit{i % 4}x{e}"
        docs.append((i, " ".join(w)))
    return docs + [(60, ""), (61, None), (62, "one two"), (63, "One  two"), (64, "one two three"), (65, "x " * 30_000)]


def test_components_equal_brute_force(spark):
    docs = near_copies()
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("id", F.lit("clash")).withColumn("rep", F.lit(1))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dedup.near_duplicates(df, shingle=4).collect()}
    assert got == brute_components(docs, 4)


def test_null_and_repeated_ids(spark):
    df = spark.createDataFrame([(None, "a b c d e f"), (1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f")], "doc_id long, text string")
    got = sorted(((r["doc_id"], r["component_id"], r["kept"]) for r in near_dedup.near_duplicates(df).collect()), key=str)
    assert got == [(1, 1, True), (1, 1, True), (2, 1, False), (None, None, True)]
    assert near_dedup.near_duplicates(df.limit(0)).count() == 0


def test_rows_of_one_key_keep_their_links(spark):
    texts = {c: " ".join(f"{c}{i}" for i in range(60)) for c in "ABC"}
    near = {c: " ".join([*t.split()[:-1], "x"]) for c, t in texts.items()}
    rows = [(5, texts["A"]), (5, texts["B"]), (6, near["A"]), (7, near["B"]), (8, texts["C"]), (9, texts["B"]), (9, near["C"]), (9, near["C"])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r["doc_id"], r["component_id"]) for r in near_dedup.near_duplicates(df, shingle=4).collect()}
    assert got == {(i, 5) for i in range(5, 10)}
    parted = df.where("doc_id <> 9")
    assert {(r["doc_id"], r["component_id"]) for r in near_dedup.near_duplicates(parted, shingle=4).collect()} == {(5, 5), (6, 5), (7, 5), (8, 8)}


def test_many_places_of_one_bucket(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "GROWTH", 2)
    docs = near_copies()
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dedup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), shingle=4).collect()}
    assert got == brute_components(docs, 4)


def test_struct_keys(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(near_copies(), "doc_id long, text string").select(F.struct("doc_id", F.xxhash64("text").alias("h")).alias("key"), "text")
    got = {r["key"]["doc_id"]: r["component_id"]["doc_id"] for r in near_dedup.near_duplicates(df, shingle=4, key="key").collect()}
    assert got == {i: c for i, (_, c) in brute_components(near_copies(), 4).items()}


def test_chains_of_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    got = {r["v"]: r["root"] for r in near_dedup.components(edges).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


# Personal data

PATTERNS = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)"), ("card", r"[0-9](?:[\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]
TEXTS = [
    "a@b.c.d_x@y.z, a..b@c.d.. x@a..b.c q@.b.c r@b @b.c é@x.yé m@n.o-p.q", "1.2.3.4.5.6.7.8 999.1.1.1 01.002.0003.255 1.2.3", "4111 1111 1111 1111 and 4111-1111-1111-1111  5500 0000 0000 0004 4111  1111 1111 1111 1",
    "+1 (555) 123-4567 +12 +1 23.. +123456789012345678 ++49 (0) 30 1234567", "4111111111111111-a 4111 1111 1111 1111-2 - 4 1 1 1 1 1 1 1 1 1 1 1 1 1 1 1", "", None, "\u0002a\u0002b@c.d 1\u00032.3.4.5 x\u0002@y.z", "é 4012888888881881 ü@ b@c.de\nf@g.h",
    "1 2 " * 3000, "a." * 3000 + "x@" + "b." * 3000 + "c", "9" * 5000,
]


def luhn(s):
    return sum((x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x)) for i, x in enumerate(map(int, reversed(s)))) % 10 == 0


def brute_spans(text):
    out = []
    for rank, (kind, pattern) in enumerate(PATTERNS):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            good = {"email": True, "ip": kind == "ip" and all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")), "card": 12 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]
            if good:
                out.append((m.start(), rank, f"{kind}:{m.start()}:{m.end()}"))
    return [s for _, _, s in sorted(out)]


def test_base_spans_equal_brute_force(spark):
    docs = [(i, t) for i, t in enumerate(TEXTS)] + [(None, "a@b.c"), (1, TEXTS[1])]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("kind", F.lit("clash")).withColumn("row", F.lit(1))
    found = pii.spans(df).groupBy("row", "key").agg(pii._listed(False).alias("base"))
    got = sorted(((r["key"], r["base"]) for r in found.collect()), key=str)
    assert got == sorted(((i, ",".join(brute_spans(t))) for i, t in docs), key=str)


def test_contexts_find_unseen_identifiers(spark):
    seeds = [f"reach me, contact: user{i}@mail{i}.org today" for i in range(6)]
    docs = [*seeds, "please contact: AB-1234-567 soon", "the AB-9999-111 is a part", "see the user7@mail.org", "the end of the road and the sea"]
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    found = {(r["key"], docs[r["key"]][r["start"] : r["stop"]]) for r in pii.spans(df).where("kind = 'id'").collect()}
    assert found == {(6, "AB-1234-567")}
    clean = {r["doc_id"]: r["text"] for r in pii.redact(df).collect()}
    assert clean[6] == "please contact: [ID] soon" and clean[0] == "reach me, contact: [EMAIL] today" and clean[9] == docs[9]


def test_found_identifiers_lead_to_new_contexts(spark):
    docs = [*[f"contact: user{i}@mail{i}.org" for i in range(8)], *[f"contact: AB-{i}234-567" for i in range(3)], *[f"ref= AB-{i}234-567" for i in range(3)], "ref= ZZ-9999-111", "part= QQ-1111-222"]
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    found = {r["key"] for r in pii.spans(df).where("kind = 'id'").collect()}
    assert found == set(range(8, 15))


def test_planted_secrets_are_found(spark):
    import hashlib
    import random

    rng = random.Random(4)
    prose = lambda: " ".join(rng.choices(WORDS, k=30))
    docs, want = [], set()
    for i in range(200):
        secret = hashlib.sha1(str(i).encode()).hexdigest() if i % 20 else f"odd-form-{i}-{i * 7919}"  # some unseen forms
        if i % 2:
            docs.append(f"{prose()} reach a{i}@b{i}.org or {'%d' % (10**15 + i)} {prose()}")
        else:
            line = f'token = "{secret}"'
            docs.append(f"{prose()}\n{line if i % 8 else line.upper()}\n{prose()} part-{i}00 {prose()}")
            want.add((i, (secret if i % 8 else secret.upper())))
    found = {(r["key"], docs[r["key"]][r["start"] : r["stop"]]) for r in pii.spans(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")).where("kind = 'id'").collect()}
    assert len(found & want) >= 0.9 * len(want) and len(found & want) >= 0.95 * len(found)


@pytest.mark.parametrize("unseen_in", [2, 4])
def test_unseen_forms_are_found(spark, unseen_in):
    """Recall on identifiers whose form is no seed's only: one in `unseen_in` of the values beside three contexts."""
    import hashlib
    import random

    rng = random.Random(7)
    prose = lambda: " ".join(rng.choices(WORDS, k=20))
    forms = [lambda i: f"AB-{i * 37 % 10000:04d}-{i:03d}", lambda i: f"user{i}x{i % 7}", lambda i: f"{i * 7919:09d}Q", lambda i: f"k_{i}_{i * i}"]
    contexts = ['token = "{}"', "api key: {} .", "secret is {} ,"]
    docs, want, other = [], set(), set()
    for i in range(240):
        unseen = i % unseen_in == 0
        value = forms[(i // unseen_in) % 4](i) if unseen else hashlib.sha1(str(i).encode()).hexdigest()
        docs.append(f"{prose()} {contexts[i % 3].format(value)} {prose()} part-{i}00 of lot{i * 3}z")
        if unseen:
            want.add((i, value))
        other |= {(i, f"part-{i}00"), (i, f"lot{i * 3}z")}
    found = {(r["key"], docs[r["key"]][r["start"] : r["stop"]]) for r in pii.spans(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")).where("kind = 'id'").collect()}
    assert len(found & want) >= 0.9 * len(want) and not found & other


def test_long_identifiers_go_whole(spark):
    long, late = "k1" + "ab3" * 40, "x" * 50 + "7"
    docs = [*[f"contact: user{i}@mail{i}.org" for i in range(6)], f"contact: {long}Z end", f"contact: {late}"]
    clean = {r["doc_id"]: r["text"] for r in pii.redact(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")).collect()}
    assert clean[6] == "contact: [ID] end" and clean[7] == "contact: [ID]"


def test_redaction_of_odd_rows(spark):
    df = spark.createDataFrame([(1, None), (None, "a@b.c"), (2, ""), (2, "x 1.2.3.4 +1 555 123 4567."), (2, "x 1.2.3.4 +1 555 123 4567.")], "doc_id long, text string").withColumn("key", F.lit(0))
    got = sorted("null" if r["text"] is None else r["text"] for r in pii.redact(df).collect())
    assert got == sorted(["null", "[EMAIL]", "", "x [IP] [PHONE].", "x [IP] [PHONE]."])
    assert pii.redact(df.limit(0)).count() == 0


# Chats


MESSAGES = [
    (1, 0, "user", "Hello there\nhow are you?"), (1, 1, "bot", "> Hello there\n> how ARE  you?\n\nFine, thank you very much.\n\n"), (1, 2, "user", ">> hello there\n> Fine, thank you very much.\nGood."), (1, 3, "bot", "> Hello there\nanother"),
    (2, 0, "user", "> Fine, thank you very much.\nx"), (2, 1, "bot", None), (2, 2, "user", "> unknown\ny"), (None, None, None, ""), (3, 0, "user", ">" * 9000),
    # wrapped anew, one sentence of a paragraph, and a short line that many have
    (4, 0, "user", "One long line of words. It has a second sentence here.\nAnd more of it follows."), (4, 1, "bot", "> one long line\n> of words. it has a second\n> sentence here. and more of it follows.\nTrue."),
    (4, 2, "user", "> It has a second sentence here.\nThanks."), (5, 0, "user", "> Thanks.\nnothing far for one word"), (5, 1, "bot", "Thanks."), (5, 2, "bot", "Thanks."), (5, 2, "bot", "Thanks."), (5, 3, "user", "> Thanks.\n>\n> one long line of words. it has a second sentence here. and more of it follows.\nboth"),
]


def test_quotes_and_reply_order(spark):
    df = spark.createDataFrame(MESSAGES, "conv_id long, turn long, role string, text string").withColumn("message", F.lit("clash"))
    got = {(r["conv_id"], r["turn"]): r for r in chat.conversations(df).collect()}
    assert [t for c, t in sorted((k for k in got if k[0] == 1), key=lambda k: got[k]["position"])] == [0, 1, 3, 2]
    assert got[1, 1]["content"] == "Fine, thank you very much." and got[1, 2]["reply_turn"] == 1 and got[1, 3]["reply_turn"] == 0
    assert (got[2, 0]["reply_conv"], got[2, 0]["reply_turn"]) == (1, 1) and got[2, 2]["n_linked"] == 0 and got[2, 2]["content"] == "y"
    assert got[3, 0]["content"] == "" and (got[4, 1]["reply_turn"], got[4, 2]["reply_turn"]) == (0, 0)
    assert got[5, 0]["n_linked"] == 0 and (got[5, 3]["n_quoted"], got[5, 3]["n_linked"], got[5, 3]["reply_conv"]) == (2, 2, 4)
    assert chat.conversations(df.limit(0)).count() == 0


def test_the_largest_share_wins(spark):
    """A later message, or a conversation before, that has some of the quoted words only is not the original."""
    words = lambda tag, n: " ".join(f"{tag}{i}" for i in range(n))
    a, b, c = f"{words('a', 6)}.", f"{words('b', 4)}.", f"{words('c', 3)}."
    rows = [(1, 1, "u", f"{a} {b} {c}"), (1, 2, "u", f"{a} {words('x', 5)}."), (1, 3, "u", f"> {a} {b}\nyes")]
    rows += [(7, 0, "u", f"{words('d', 9)}."), (8, 0, "u", f"{words('d', 9)}. {words('e', 4)}."), (9, 0, "u", f"> {words('d', 9)}. {words('e', 4)}.\nyes")]
    rows += [(10, 0, "u", f"{words('d', 9)}. {words('e', 4)}."), (10, 1, "u", f"> {words('d', 9)}. {words('e', 4)}.\nyes")]
    got = {(r["conv_id"], r["turn"]): (r["reply_conv"], r["reply_turn"]) for r in chat.conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert got[1, 3] == (1, 1) and got[9, 0] == (8, 0) and got[10, 1] == (10, 0)


@pytest.mark.parametrize("hot", [200, 2])
def test_partial_quotes_that_share_sentences(spark, monkeypatch, hot):
    """Originals share many sentences with others; quotes take most of one: nine in ten lead to it at least."""
    import random

    monkeypatch.setattr(chat, "HOT", hot)
    rng = random.Random(3)
    common = [" ".join(rng.choices(WORDS, k=6)) + "." for _ in range(6)]
    rows, want = [], {}
    for c in range(60):
        said = []
        for t in range(4):
            said.append([*rng.sample(common, 3), *[" ".join(rng.choices(WORDS, k=9)) + f" {c} {t} {k}." for k in range(3)]])
            rows.append((c, t, "u", " ".join(said[-1])))
        far = c >= 30 and c % 2 == 0
        at = rng.randrange(4)
        part = said[at][:]
        part.pop(rng.randrange(6))
        rows.append((c + 1000 if far else c, 4, "u", "> " + " ".join(part) + "\nyes"))
        want[rows[-1][0], 4] = (c, at)
    got = {(r["conv_id"], r["turn"]): (r["reply_conv"], r["reply_turn"]) for r in chat.conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert sum(got[k] == v for k, v in want.items()) >= 0.9 * len(want)


@pytest.mark.parametrize("hot", [200, 2, 0])
def test_chats_equal_sql(spark, tmp_path, monkeypatch, hot):
    import random

    import duckdb

    monkeypatch.setattr(chat, "HOT", hot)
    rng = random.Random(8)
    rows = [m for m in MESSAGES if m[0] is not None]
    said = [f"{' '.join(rng.choices(WORDS, k=rng.choice([1, 3, 7])))}." for _ in range(40)]
    for c in range(10, 40):
        for t in range(8):
            quote = [("> " * rng.choice([1, 1, 2])).strip() + " " + rng.choice(said).upper() for _ in range(rng.choice([0, 1, 2]))]
            rows += [(c, t, rng.choice(["a", "b"]), "\n".join([*quote, rng.choice(["", "\n"]) + " ".join(rng.choices(said, k=2))]))] * rng.choice([1, 1, 1, 2])
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    want = duckdb.connect().execute(chat.ORACLE.replace("FROM conversations", f"FROM '{tmp_path}/conversations.parquet/*.parquet'")).df()
    got = chat.op6_chat(spark, str(tmp_path)).toPandas()[list(want.columns)]
    assert sorted(map(tuple, got.astype(str).values)) == sorted(map(tuple, want.astype(str).values)) and (got.n_linked > 0).sum() > 20


def test_one_long_conversation(spark, monkeypatch):
    monkeypatch.setattr(chat, "TURNS", 64)
    n = 20_000
    df = spark.range(n).select(F.lit(1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.lit("u").alias("role"), F.when(F.col("id") % 7 == 3, F.lit("> the same line in every message\nyes")).otherwise(F.lit("the same line in every message")).alias("text"))
    got = chat.conversations(df).toPandas()
    assert sorted(got.position) == list(range(n))
    quoting = got[got.turn % 7 == 3]
    assert (quoting.reply_turn == quoting.turn - 1).all() and (got[got.turn > 0].reply_turn == got[got.turn > 0].turn - 1).all()
