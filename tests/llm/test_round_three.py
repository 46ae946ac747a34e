"""The conversation trie, the filter audit and the quality classifier against brute force."""

import hashlib
import itertools
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from relforge.llm import filter_audit, quality, trie

CONV = "conv_id long, turn long, role string, text string"


def brute_trie(rows):
    """{(depth, conv_id): the other columns} by following every prefix."""
    turns = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()
            turns.setdefault(conv, []).append(((turn is not None, turn or 0, digest), (role, text)))
    own = {c: [t for _, t in sorted(x)] for c, x in turns.items()}
    made = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 6
        made[c] = own.get(c - c % 100, [])[:h] + own[c][h:]
    members = {}
    for c, t in made.items():
        for d in range(len(t) + 1):
            members.setdefault(tuple(t[:d]), []).append(c)
    out = {}
    for p, cs in members.items():
        under = [q for q in members if q[: len(p)] == p]
        ends = ",".join(str(c) for c in sorted(c for c in cs if len(made[c]) == len(p)))
        parent = min(members[p[:-1]]) if p else None
        kids = sum(len(q) == len(p) + 1 for q in under)
        leaves = sum(not any(len(x) == len(q) + 1 and x[: len(q)] == q for x in members) for q in under)
        tokens = sum((len(members[q]) - 1) * len(q[-1][1]) for q in under if q)
        out[len(p), min(cs)] = (parent, len(cs), kids, leaves, tokens, hashlib.sha256(ends.encode()).hexdigest())
    return out


def trie_of(spark, rows):
    got = trie.prefix_trie(*trie.rebuilt(spark.createDataFrame(rows, CONV))).collect()
    found = {(r["depth"], r["conv_id"]): (r["parent_conv_id"], r["n_convs"], r["n_children"], r["n_leaves"], r["saved_tokens"], r["ends_sha256"]) for r in got}
    assert len(found) == len(got)
    return found


def odd_conversations(seed):
    """Few different turns, copies of long conversations, missing bases, repeated turns, nulls."""
    rng = random.Random(seed)
    rows = []
    long = [(rng.choice("ab"), rng.choice(["x", "yy", "zä"])) for _ in range(23)]
    for c in rng.sample(range(0, 700), 60):
        if rng.random() < 0.3:
            cut = rng.randint(0, 23)
            said = long[:cut] + [("a", str(rng.randint(0, 2))) for _ in range(rng.randint(0, 2))]
        else:
            said = [(rng.choice(["a", "b", None]), rng.choice(["x", "", None])) for _ in range(rng.randint(1, 9))]
        rows += [(c, i, *t) for i, t in enumerate(said)]
    rows += [(7, None, "a", "first"), (7, 1, "a", "tie"), (7, 1, "b", "tie"), (7, 1, "b", "tie"), (None, 0, "a", "gone")]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("seed", "longest"), [(1, 64), (2, 1), (3, 4)])
def test_trie_equals_brute_force(spark, monkeypatch, seed, longest):
    monkeypatch.setattr(trie, "LONGEST", longest)
    monkeypatch.setattr(trie, "IDS", 2)
    if seed == 3:
        monkeypatch.setattr(trie, "BROADCAST_ROWS", 0)
    rows = odd_conversations(seed)
    assert trie_of(spark, rows) == brute_trie(rows)


def test_trie_of_few_conversations(spark):
    assert trie_of(spark, []) == {}
    one = [(300, 0, "u", "a"), (300, 1, "u", "b")]
    assert trie_of(spark, one) == brute_trie(one)
    copies = [(c, t, "u", str(t)) for c in range(400, 500) for t in range(8)]
    assert trie_of(spark, copies) == brute_trie(copies)


def test_trie_ignores_other_columns(spark):
    rows = [Row(conv_id=1, turn=0, role="u", text="a", c=5, d=9, k=1), Row(conv_id=1, turn=1, role="u", text="b", c=5, d=9, k=1)]
    assert trie.prefix_trie(*trie.rebuilt(spark.createDataFrame(rows))).count() == len(brute_trie([(1, 0, "u", "a"), (1, 1, "u", "b")]))


DOCS, LABELS = "doc_id long, text string, lang string", "doc_id long, quality int, toxic int"


def audited(docs, labels):
    """The audit by a walk through every document and order."""
    def failed(i, text):
        words = [w for w in re.split("[\x20\x09-\x0d]+", text) if w]
        own = [len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * sum("A" <= c <= "Z" for c in text) > 3 * len(text), any(c in "#$%&*|" for c in text)]
        copy = i is not None and any(j is not None and j < i and (t or "") == text for j, t, _ in docs)
        return {c for c, f in zip("ABCDE", [*own, copy], strict=True) if f}

    said = {}
    for i, q, t in labels:
        old = said.get(i, (False, False))
        said[i] = (old[0] or q == 1, old[1] or t == 1)
    out = {}
    for i, text, lang in docs:
        bad = failed(i, text or "")
        good, toxic = said.get(i, (False, False)) if i is not None else (False, False)
        for o in itertools.permutations("ABCDE"):
            at = next((k for k, c in enumerate(o, 1) if c in bad), 6)
            for k, c in enumerate(o, 1):
                r = out.setdefault((lang or "", "".join(o), k), [0] * 6)
                for j, hit in enumerate((at > k, at == k, at < k and c in bad, bad == {c}, at == k and good, at == k and toxic)):
                    r[j] += hit
    shapley = {}
    for (part, o, k), r in out.items():
        shapley[part, o[k - 1]] = shapley.get((part, o[k - 1]), 0) + r[1]
    return {key: (*r, shapley[key[0], key[1][key[2] - 1]]) for key, r in out.items()}


def odd_documents():
    long = " ".join(f"w{i}" for i in range(210))
    texts = [long, long, None, "", "short", long.upper(), "a " * 300, f"{long} #1", " \t\n", long + "\x0b", "Ünïcode " * 201, long]
    docs = [(i, t, ["en", None, "", "de"][i % 4]) for i, t in enumerate(texts)]
    docs += [(3, "", "en"), (None, long, "en"), (None, None, None), (11, long, "de"), (-5, "a " * 300, "fr")]
    labels = [(0, 1, 0), (1, None, 1), (1, 1, None), (2, 0, 0), (6, 1, 1), (None, 1, 1), (99, 1, 1), (6, 0, 0)]
    return docs, labels


@pytest.mark.parametrize("broadcast", [filter_audit.BROADCAST_ROWS, 0])
def test_audit_equals_a_walk(spark, monkeypatch, broadcast):
    monkeypatch.setattr(filter_audit, "BROADCAST_ROWS", broadcast)
    docs, labels = odd_documents()
    flags = filter_audit.flagged(spark.createDataFrame([(*d, 1, "x") for d in docs], DOCS + ", flags int, good string"), spark.createDataFrame(labels, LABELS))
    names = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    found = {(r["part"], r["filter_order"], r["step"]): tuple(r[c] for c in names) for r in filter_audit.replay(flags).collect()}
    assert found == audited(docs, labels)


def test_audit_of_empty_tables(spark):
    docs, labels = spark.createDataFrame([], DOCS), spark.createDataFrame([], LABELS)
    assert filter_audit.replay(filter_audit.flagged(docs, labels)).count() == 0
    some = spark.createDataFrame([(1, "a", "en")], DOCS)
    assert filter_audit.replay(filter_audit.flagged(some, labels)).count() == 600


def test_audit_and_trie_equal_sql(spark, tmp_path):
    docs, labels = odd_documents()
    for name, rows, schema in (("documents", docs, DOCS), ("labels", labels, LABELS), ("conversations", odd_conversations(4), CONV)):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
    con = duckdb.connect()
    for name in ("documents", "labels", "conversations"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    for query, sql in ((filter_audit.op12_filter_audit, filter_audit.ORACLE), (trie.op11_prefix_trie, trie.ORACLE)):
        mine = query(spark, str(tmp_path))
        theirs = con.execute(f"SELECT {', '.join(mine.columns)} FROM ({sql})").fetchall()
        assert sorted(map(repr, theirs)) == sorted(repr(tuple(r)) for r in mine.collect())


def test_dual_descent_reaches_the_optimum():
    """Primal and dual values meet, multipliers stay in bounds, and the weights are those of the multipliers."""
    rng = np.random.default_rng(1)
    rows = [np.sort(rng.choice(40, rng.integers(1, 12), replace=False)) for _ in range(120)]
    values, sign = rng.normal(size=40), rng.choice([-1.0, 1.0], 120)
    c = rng.uniform(0.1, 2, 120)
    w, bias, alpha = quality.dual_descent(rows, values, sign, c, passes=2000)
    x = np.zeros((120, 41))
    for i, r in enumerate(rows):
        x[i, r], x[i, 40] = values[r], 1
    full = np.append(w, bias)
    assert np.allclose(full, (alpha * sign) @ x) and (alpha >= 0).all() and (alpha <= c + 1e-12).all()
    primal = full @ full / 2 + (c * np.maximum(0, 1 - sign * (x @ full))).sum()
    dual = alpha.sum() - full @ full / 2
    assert primal - dual < 1e-3 * primal


def test_ratios_and_grams_by_hand():
    rows = [np.array([1, 2]), np.array([1]), np.array([2]), np.array([1, 3])] * 3
    y = np.array([1, 1, 0, 1] * 3)
    r = quality.ratios(rows, y)
    ones, zeros = np.array([9 + 1, 3 + 1, 3 + 1]), np.array([0 + 1, 3 + 1, 0 + 1])
    assert np.allclose(r[1:4], np.log((ones / ones.sum()) / (zeros / zeros.sum()))) and not r[4:].any() and not r[0]
    texts = [b"", b"A b\tA b", b" ", "é".encode(), b"ab", b"A b\tA b"]
    found = quality.grams(np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)]))
    alone = [quality.grams(np.frombuffer(t, np.uint8), np.array([0, len(t)]))[0] for t in texts]
    assert all(np.array_equal(a, b) for a, b in zip(found, alone, strict=True)) and not len(found[0]) and not len(found[2])
    assert (np.diff(found[1]) > 0).all()


def quality_tables(spark, n=400):
    rng = random.Random(5)
    docs, labels = [], []
    for i in range(n):
        words = ["".join(rng.choice(["the", "on", "er", "sha", "ti"]) for _ in range(rng.randint(1, 3))) for _ in range(60)]
        good = rng.random() < 0.8
        if not good:
            words = [w.upper() + "!!" for w in words] if i % 2 else [f"{w} |" for w in words]
        docs.append((i, " ".join(words), str(good)))
        labels.append((i, int(good), 0))
    docs += [(n, None, "x"), (n + 1, "", None), (None, "words of nobody", "x"), (3, "another text of a key", "x")]
    labels += [(None, 1, 0), (n + 50, 1, 0), (5, None, 1)]
    return spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS), labels


def test_quality_of_held_out_rows(spark):
    docs, labels, known = quality_tables(spark)
    truth = {i: q for i, q, _ in known if i is not None and q is not None}
    rows = quality.score(docs, quality.fit(docs, labels), ["doc_id", "lang"]).withColumn("held", quality.held_out(F.col("doc_id"))).collect()
    assert len(rows) == docs.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert {r["doc_id"] for r in rows if r["held"] and r["doc_id"] is not None} == {i for i in range(402) if zlib.crc32(str(i).encode()) % 5 == 0}
    held = [r for r in rows if r["held"] and r["doc_id"] in truth and r["doc_id"] != 3]
    assert len(held) > 40 and np.mean([(r["score"] >= quality.THRESHOLD) == truth[r["doc_id"]] for r in held]) > 0.97


def test_quality_learns_from_training_rows_only(spark):
    """Turned labels of held-out rows change no score."""
    docs, labels, known = quality_tables(spark, 150)
    turned = spark.createDataFrame([(i, 1 - q if i is not None and q is not None and zlib.crc32(str(i).encode()) % 5 == 0 else q, t) for i, q, t in known], LABELS)
    both = [sorted((r["doc_id"] is None, r["doc_id"] or 0, r["score"]) for r in quality.score(docs, quality.fit(docs, x), ["doc_id"]).collect()) for x in (labels, turned)]
    assert both[0] == both[1]


def test_quality_without_labels(spark):
    docs, labels, _ = quality_tables(spark, 5)
    none = labels.where("false")
    assert {r["score"] for r in quality.score(docs, quality.fit(docs, none), ["doc_id"]).collect()} == {0.5}
    assert quality.score(docs.where("false"), quality.fit(docs.where("false"), labels), ["doc_id"]).count() == 0
    ones = labels.where("quality = 1")
    assert {r["score"] for r in quality.score(docs, quality.fit(docs, ones), ["doc_id"]).collect()} == {0.99}
