"""The stages on a small corpus with planted cases, against what has to happen to each."""

import random

import pytest

import corpus_pipeline as cp


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("corpus")
    words = [f"{a}{b}{c}" for a in "bcdfgl" for b in "aeiou" for c in "mnrst"]
    plain = lambda s, n: " ".join(random.Random(s).choices(words, k=n))
    docs = [(i, plain(i, 60)) for i in range(120)]
    docs += [(200 + i, plain(500 + i, 30) + (" idiot moron trash" if i % 2 else "")) for i in range(60)]
    docs += [(300, docs[3][1]), (301, docs[4][1].upper()), (302, docs[5][1] + " more"), (303, None), (304, ""), (None, "lonely row without an id"), (305, f"x {plain(900, 20)} y"), (306, "write to a.b@c.org now"), (7, docs[7][1]), (8, docs[9][1]), (8, plain(777, 50)), (None, docs[10][1]), (None, plain(778, 50)), (None, plain(778, 50) + " x")]
    labels = [(200 + i, 1, i % 2) for i in range(60)] + [(i, 1, 0) for i in range(100)]
    rows = [(i, t, "en", "s", len(t or "")) for i, t in docs]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    spark.createDataFrame([(1, plain(900, 20))], "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")
    return str(root)


def test_stages(spark, folder):
    docs, seen = spark.read.parquet(f"{folder}/documents.parquet"), []
    columns = docs.columns
    for name, stage in cp.STAGES[:-1]:
        docs = cp.saved(stage(spark, docs, folder), name)
        assert docs.columns == columns
        seen.append(docs.toPandas())
    ids = [set(s.doc_id.dropna().astype(int)) for s in seen]
    everything = set(range(120)) | set(range(200, 260)) | set(range(300, 307))
    toxic = {200 + i for i in range(60) if i % 2}
    assert everything - ids[0] == toxic
    assert ids[0] - ids[1] == {9, 300, 301, 302} and (seen[1].doc_id == 7).sum() == 1
    assert (seen[1].doc_id == 8).sum() == 3 and seen[1].doc_id.isna().sum() == 2  # a copy of 9 goes, of two alike one
    assert ids[1] - ids[2] == {305}
    assert ids[3] == ids[2] and seen[3].doc_id.isna().sum() == 2
    last = seen[3].set_index("doc_id").loc[306]
    assert last.text == "write to [EMAIL] now" and last.n_chars == len(last.text)
    out = cp.encode(spark, docs, folder).toPandas()
    assert len(out) == len(seen[3]) and out.round_trip.all() and (out.n_pieces == out.ids.map(len)).all()


def test_run_gives_the_last_stage(spark, folder):
    got = cp.run(spark, folder).toPandas()
    assert got.round_trip.all() and 303 in set(got.doc_id) and 305 not in set(got.doc_id)
