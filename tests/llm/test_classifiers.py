"""The classifiers' parts, held-out accuracy, and the pipeline."""

import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import learning, mixing, quality, toxicity

SF = "/root/testdata/sf0.01"
EDGE = [(1, None), (2, ""), (3, " \n "), (4, "x"), (4, "x"), (None, "x y"), (5, "word " * 30_000)]


def test_folds_are_crc32_of_the_id_as_text(spark):
    df = spark.createDataFrame([(i,) for i in (0, 7, -3, 123456789012)] + [(None,)], "doc_id long")
    for r in df.select("doc_id", learning.in_fold(4, 2).alias("f")).collect():
        assert r["f"] == (zlib.crc32(b"" if r["doc_id"] is None else str(r["doc_id"]).encode()) % 4 == 2)


def test_isotonic_rises_and_pools_ties():
    x, y = np.array([1.0, 2, 2, 3, 4]), np.array([0.0, 1, 0, 0, 1])
    kx, ky = learning.isotonic(x, y)
    assert (np.diff(ky) >= 0).all() and ky[0] == 0 and ky[-1] == 1 and ky[2] == pytest.approx(1 / 3)
    assert 0 <= learning.calibrated(np.array([-99.0, 2.0, 99.0]), (kx, ky)).min()


def test_random_features_approximate_the_kernel():
    rng = np.random.default_rng(0)
    m = quality.Model(np.zeros(6), np.ones(6), 20_000)
    a = rng.normal(size=(8, 6))
    z = m.features(a)[:, :-1]
    want = np.exp(-((a[:, None] - a[None]) ** 2).sum(-1) / (4 * 6))
    assert np.abs(z @ z.T - want).max() < 0.05


def held_out(spark, scored, label):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rows = scored.where("held_out").join(labels, "doc_id").select("score", "predicted", F.col(label).alias("y")).toPandas()
    rank = rows["score"].rank().to_numpy()
    pos = rows["y"].to_numpy() == 1
    auc = (rank[pos].sum() - pos.sum() * (pos.sum() + 1) / 2) / (pos.sum() * (~pos).sum())
    return auc, (rows["predicted"] == rows["y"]).mean()


def test_quality_on_the_held_out_fold(spark):
    out = quality.op5_quality(spark, SF).cache()
    auc, accuracy = held_out(spark, out, "quality")
    assert auc > 0.95 and accuracy > 0.93 and out.where("score < 0 or score > 1").count() == 0


def test_toxicity_on_the_held_out_fold(spark):
    out = toxicity.op3_toxicity(spark, SF).cache()
    auc, accuracy = held_out(spark, out, "toxic")
    assert auc > 0.85 and accuracy > 0.88 and out.where("score < 0 or score > 1").count() == 0


@pytest.mark.parametrize("op", [quality, toxicity])
def test_reruns_and_edges(spark, op):
    label = "quality" if op is quality else "toxic"
    docs = spark.createDataFrame(EDGE + [(100 + i, ("good prose here " if i % 2 else "@@@ !!! bad ") * (i + 1)) for i in range(80)], "doc_id long, text string").withColumn("score", F.lit("clash"))
    labels = spark.createDataFrame([(100 + i, i % 2) for i in range(80)] + [(None, 1), (4, None), (777, 1)], f"doc_id long, {label} int")
    model = op.fit(docs, labels)
    one, two = (sorted(map(str, op.score(docs.repartition(n), model).collect())) for n in (1, 5))
    assert one == two and len(one) == 87
    assert op.score(docs.where("false"), model).count() == 0
    none = op.fit(docs, labels.where("false"))
    assert all(abs(r["score"] - 0.5) < 0.01 for r in op.score(docs, none).collect())


def test_swapped_identity_terms_move_the_score_less():
    rng = np.random.default_rng(1)
    # feature 0 is a slur, 1 and 2 name groups; group 1 is named in toxic texts more often
    x, y, swaps = [], [], []
    for i in range(400):
        toxic = i % 4 == 0
        own = {0} if toxic and rng.random() < 0.8 else set()
        own |= {1} if rng.random() < (0.7 if toxic else 0.1) else {2} if rng.random() < 0.2 else set()
        x.append(np.array(sorted(own), dtype=np.int32))
        y.append(float(toxic))
        if 1 in own or 2 in own:
            swaps.append(np.array([3, -2] if 1 in own else [2, -3], dtype=np.int32))
    free, _ = toxicity.descend(x, np.array(y), swaps, 3, counterfactual=0.0)
    tied, _ = toxicity.descend(x, np.array(y), swaps, 3, counterfactual=10.0)
    assert abs(tied[1] - tied[2]) < 0.3 * abs(free[1] - free[2]) and tied[0] > 1
    assert (b"women", b"men") in set(toxicity.counterfactuals({b"women", b"x"}, toxicity.others_of()))


def test_swaps_change_what_the_swapped_text_changes():
    """Against the difference of whole texts' features, also where other words share the term's features."""
    others = toxicity.others_of()
    for words in ({b"woman", b"women", b"x"}, {b"man", b"mankind", b"old"}, {b"muslim", b"muslims"}, {b"x"}, "männer mann".encode().split()):
        words = set(words)
        whole = lambda ws: Counter(f for w in ws for f in toxicity.features_of(w))
        want = sorted(sorted([*(f + 1 for f in whole(words - {a} | {b}) - whole(words)), *(-f - 1 for f in whole(words) - whole(words - {a} | {b}))]) for a, b in toxicity.counterfactuals(words, others))
        index = {f: i for i, f in enumerate(sorted(whole(words | {b for a in words for b in others.get(a, [])})))}
        got = toxicity.swap_changes(words, lambda w: [index[f] for f in toxicity.features_of(w)], others)
        back = {i: f for f, i in index.items()}
        assert sorted(sorted(back[v - 1] + 1 if v > 0 else -back[-v - 1] - 1 for v in own.tolist()) for own in got) == want


def test_the_penalty_spares_neutral_mentions(spark):
    """Toxic texts name one group far more often; neutral texts of the held-out kind that name it are flagged less."""
    rng = np.random.default_rng(7)
    word = lambda: "".join(rng.choice(list("aeiouklmnrst"), 6))
    slurs, plain = ["zzidiot", "zzscum", "zzvile", "zzliar"], [word() for _ in range(300)]
    rows, labels = [], []
    for i in range(1200):
        toxic = i % 5 == 0
        own = list(rng.choice(plain, 25))
        own += list(rng.choice(slurs, rng.integers(0, 3))) if toxic else []
        own += ["muslims"] if rng.random() < (0.8 if toxic else 0.04) else ["christians"] if rng.random() < 0.3 else []
        rows.append((i, " ".join(own)))
        labels.append((i, int(toxic)))
    mentions = [(10_000 + i, " ".join([*rng.choice(plain, 25), "muslims"])) for i in range(200)]
    insults = [(20_000 + i, " ".join([*rng.choice(plain, 25), *rng.choice(slurs, 2)])) for i in range(200)]
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    test = spark.createDataFrame(mentions + insults, "doc_id long, text string")
    flagged = {}
    for strength in (0.0, 20.0):
        scored = toxicity.score(test, toxicity.fit(docs, labels, counterfactual=strength)).toPandas()
        hit = scored["score"] >= toxicity.FLAG
        flagged[strength] = hit[scored["doc_id"] < 20_000].mean(), hit[scored["doc_id"] >= 20_000].mean()
    print(flagged)
    assert flagged[20.0][0] < 0.5 * flagged[0.0][0] and flagged[20.0][1] > 0.9


def test_one_rule_at_every_size(spark, monkeypatch):
    """The same number of fits below and above any number of labelled rows; two fits give the same scores."""
    calls, own = [], toxicity.descend
    monkeypatch.setattr(toxicity, "EPOCHS", 2)
    monkeypatch.setattr(toxicity, "descend", lambda x, *a, **b: calls.append(len(x)) or own(x, *a, **b))
    docs = spark.range(9000).selectExpr("id as doc_id", "concat('w', id % 97, ' v', id % 89, if(id % 3 = 0, ' bad', '')) as text")
    labels = docs.selectExpr("doc_id", "cast(doc_id % 3 = 0 as int) as toxic")
    models = []
    for n in (400, 9000, 9000):
        calls.clear()
        models.append(toxicity.fit(docs.where(f"doc_id < {n}"), labels))
        assert len(calls) == 5 and calls[-1] > max(calls[:4]) > 0.74 * calls[-1]
    assert models[1].weights == models[2].weights and models[1].intercept == models[2].intercept


def test_quality_refits_alike(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    one, two = quality.fit(docs, labels), quality.fit(docs.repartition(3), labels)
    texts = [r["text"].encode() for r in docs.limit(200).collect()]
    assert np.abs(one.score(texts) - two.score(texts)).max() < 1e-6


def test_rejected_documents_go_and_columns_stay(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = quality.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    kept = quality.keep_good(docs, model)
    want = quality.score(docs, model).where(F.col("score") >= quality.ACCEPT).count()
    assert kept.columns == docs.columns and kept.count() == want < docs.count()


def test_pipeline_stages_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, n = docs.columns, docs.count()
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, SF).cache()
        m = docs.count()
        assert 0 < m <= (2 * n if k == 3 else n)
        if k < 4:
            assert docs.columns == columns
        if k in (0, 1, 2):
            assert m < n and docs.select("doc_id").distinct().count() == m
        n = m
    assert {"shard", "slot", "size", *columns} == set(docs.columns) and docs.select("shard").distinct().count() == 40


ODD = [(901, None, "a"), (902, "", None), (905, "T " + "one of two texts under this id " * 30, "a"), (906, "T " + "one of two texts under this id " * 30, "b"), (905, "another text of its own, with other words in it " * 20, "a"), (None, "a row without an id keeps its place " * 10, "c"), (907, "repeated row " * 20, "c"), (907, "repeated row " * 20, "c"), (908, "word " * 40_000, "d"), (909, "é ü ß " * 50, None)]


def test_pipeline_on_odd_rows_and_empty_tables(spark, tmp_path):
    """Nulls, repeated ids and rows, a very long text, names that operators use for themselves, and no rows at all."""
    own = ("id", "k", "row", "h", "d", "line", "rank", "range", "mix_id", "mix_copy", "key_id", "copies", "copy", "source_size", "uid", "again_id", "drop_id", "bytes")
    plain = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "source")
    odd = spark.createDataFrame(ODD, "doc_id long, text string, source string")
    for rows in (odd.unionByName(plain), odd, odd.where("false")):
        docs = rows.withColumns({c: F.lit(f"own {c}") for c in own})
        columns, texts = docs.columns, {(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()}
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            path = str(tmp_path / f"{id(rows)}-{k}")
            stage(spark, docs, "/root/testdata/sf0.001").write.parquet(path)
            docs = spark.read.parquet(path)
            assert docs.columns == columns if k < 4 else set(docs.columns) == {*columns, "size", "shard", "slot"}
            if k == 1:  # the copy goes, the other text of its id stays
                kept = {(r["doc_id"], r["text"][:1]) for r in docs.where("doc_id in (905, 906)").select("doc_id", "text").collect()}
                assert kept <= {(905, "T"), (905, "a")} and docs.where("doc_id = 907").count() <= 1
        got = docs.collect()
        assert all(r[c] == f"own {c}" for r in got for c in own) and {(r["doc_id"], r["text"]) for r in got} <= texts


def test_no_cross_imports():
    import subprocess

    hits = subprocess.run(["grep", "-rlE", r"tessera\.llm|from \.llm|import llm", "tessera", "--include=*.py"], cwd=corpus_pipeline.__file__.rsplit("/", 1)[0], capture_output=True, text=True).stdout.split()
    assert all(h.startswith("tessera/llm/") for h in hits)
    assert mixing.SHARE == 1.5
