"""Exact and near dedup, sharding and mixing against brute force, with the edge cases of their docstrings."""

import random
import re
from collections import defaultdict

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tessera.llm import exact_dedup, line_dedup, mixing, near_dedup, sharding, simhash

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, source string"
EDGE = [(1, None, "a"), (2, "", "a"), (3, " \t\n", None), (4, "A b\tc", "a"), (5, "Ab c", "b"), (6, "x", "b"), (6, "x", "b"), (None, "x", "b"), (7, "word " * 30_000, "c"), (8, "é ü", "c")]


def frame(spark, rows, schema=DOCS):
    """Rows with an extra column and one whose name clashes with a result's."""
    return spark.createDataFrame(rows, schema).withColumns({"size": F.lit("clash"), "h": F.lit(0), "lang": F.lit("xx")})


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_exact_dedup_edges(spark):
    out = {r["doc_id"]: r for r in exact_dedup.assign(frame(spark, EDGE)).collect()}
    assert {out[i]["group_size"] for i in (1, 2, 3)} == {3} and out[3]["keep_id"] == 3 and not out[1]["kept"]  # 3 has the most code points
    assert out[4]["keep_id"] == out[5]["keep_id"] == 4 and out[8]["group_size"] == 1
    assert out[6]["group_size"] == 3 and out[6]["keep_id"] == 6 and out[None]["keep_id"] == 6
    assert exact_dedup.assign(frame(spark, [])).count() == 0
    assert exact_dedup.deduplicate(frame(spark, EDGE)).where("doc_id = 6").count() == 1


REPEATED = [(5, "one two three four five six"), (2, "one two three four five six"), (5, "another text of its own words"), (None, "lonely words of a row without an id"), (None, "lonely words of a row without an id"), (None, "yet other words, no id either"), (7, "same"), (7, "same"), (7, "sa me"), (7, None)]
CLASHES = ("id", "k", "row", "uid", "h", "d", "line", "rank", "first", "range", "before", "row_hash", "bytes_before", "rows_before", "k2", "drops", "mix_id", "mix_source", "mix_hash", "mix_copy", "key_id", "key_k", "sha", "order", "drop_id", "again_id", "bucket", "norm", "n")


def clashing(spark, rows, schema="doc_id long, text string"):
    """Rows with a source, a column for every name an operator might use, and a map."""
    df = spark.createDataFrame(rows, schema).withColumn("source", F.lit("s"))
    return df.withColumns({c: F.lit(f"own {c}") for c in CLASHES} | {"facts": F.create_map(F.lit("a"), F.lit(1))})


def owned(df):
    """The rows' ids and texts, once their extra columns are found to be as they were."""
    rows = df.collect()
    assert all(r[c] == f"own {c}" for r in rows for c in CLASHES) and all(r["facts"] == {"a": 1} for r in rows)
    return sorted(((r["doc_id"], r["text"]) for r in rows), key=str)


def test_dedup_keeps_other_texts_of_an_id_and_all_columns(spark):
    df = clashing(spark, REPEATED)
    out = exact_dedup.deduplicate(df)
    assert out.columns == df.columns
    assert owned(out) == sorted([(2, REPEATED[0][1]), (5, REPEATED[2][1]), (None, REPEATED[3][1]), (None, REPEATED[5][1]), (7, "sa me"), (7, None)], key=str)
    out = near_dedup.keep_one(df)
    assert out.columns == df.columns
    assert owned(out) == sorted([(2, REPEATED[0][1]), (5, REPEATED[2][1]), (None, REPEATED[3][1]), (None, REPEATED[5][1]), (7, "same"), (7, "sa me"), (7, None)], key=str)
    assert exact_dedup.deduplicate(clashing(spark, [])).count() == 0


def test_exact_dedup_chains_colliding_hashes(spark, documents):
    """A hash of 11 values, spread over the leading bits: every chain holds many texts, told apart by their bytes."""
    few = lambda c: F.pmod(F.xxhash64(c), F.lit(11)) * F.lit(0x1234567890ABCDE)
    plain, chained = (sorted(map(str, exact_dedup.assign(documents, 3, h).collect())) for h in (F.xxhash64, few))
    assert plain == chained


def test_exact_dedup_is_decided_by_the_pages(spark, documents, monkeypatch):
    monkeypatch.setattr(exact_dedup, "owners", lambda chained, buckets, own=exact_dedup.owners: own(chained, buckets).limit(0))
    assert exact_dedup.assign(documents).where("not kept").count() == 0


def test_exact_dedup_matches_sql_with_a_deep_directory(spark, documents):
    c = duckdb.connect()
    c.sql(f"create view documents as select * from '{SF}/documents.parquet'")
    want = sorted(c.sql(exact_dedup.ORACLE).fetchall())
    for capacity in (3, 50_000):
        got = exact_dedup.assign(documents, capacity).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")
        assert sorted(map(tuple, got.collect())) == want


def test_directory_doubles_only_where_it_must():
    g, slots = exact_dedup.directory([(0, 10), (7, 1)], 3, 5)
    assert g == 3 and len(slots) == 8 and slots[4:] == [slots[4]] * 4  # the light half stays one bucket
    assert exact_dedup.directory([], 3, 5) == (0, [0])


def brute_fingerprint(text, n=4):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + n]) for i in range(len(words) - n + 1)] or ([" ".join(words)] if words else [])
    counts = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for b in range(64):
            counts[b] += h >> b & 1
    return sum(1 << b for b in range(64) if counts[b] * 2 > len(shingles))


def brute_components(prints):
    ids, f = zip(*sorted(prints.items()), strict=True)
    near = np.bitwise_count(np.array(f, dtype=np.uint64)[:, None] ^ np.array(f, dtype=np.uint64)[None, :]) <= 4
    label = np.array(ids)
    while not np.array_equal(new := np.where(near, label[None, :], 1 << 60).min(1), label):
        label = new
    return dict(zip(ids, label.tolist(), strict=True))


def test_simhash_matches_brute_force(spark, documents):
    texts = dict(documents.select("doc_id", "text").collect())
    prints = {i: brute_fingerprint(t) for i, t in texts.items()}
    rows = simhash.op1_simhash(spark, SF).collect()
    assert {r["doc_id"]: r["fingerprint"] for r in rows} == {i: f"{f:016x}" for i, f in prints.items()}
    assert {r["doc_id"]: r["component_id"] for r in rows} == brute_components(prints)


def test_ball_hashing_links_all_within_four_bits_and_none_beyond(spark):
    rng = random.Random(3)
    prints = {i: rng.getrandbits(64) for i in range(300)}
    for i in range(300, 600):  # chains and clusters around earlier ones
        prints[i] = prints[rng.randrange(i)] ^ sum(1 << b for b in rng.sample(range(64), rng.choice([0, 1, 2, 3, 4, 5, 6])))
    df = spark.createDataFrame([(i, f - (1 << 64) if f >> 63 else f) for i, f in prints.items()], "doc_id long, fp long")
    got = {r["doc_id"]: r["component_id"] for r in simhash.cluster(df).collect()}
    assert got == brute_components(prints)


@pytest.mark.parametrize("n", [300, 10_000, 1_000_000, 10_000_000, 1_000_000_000])
def test_ball_words_take_eight_bytes_at_any_size(n):
    """Words packed for n fingerprints hold their fingerprints; what a row has besides is less than a byte a word."""
    depth, group_bits, block = simhash.plan(n)
    prints = np.random.default_rng(n).integers(0, 2**64, 256, dtype=np.uint64)
    masks, lo = simhash.ball(2), (1 << depth) // 8 * 3
    words, ends = simhash.packed_words(prints, masks, depth, lo, lo + (1 << depth) // 8)
    starts = np.r_[0, ends[:-1]]
    for k in np.flatnonzero(ends - starts)[:50].tolist():
        packed = words[starts[k] : ends[k]]
        back = (simhash.unpacked(lo + k, packed, depth) * np.uint64(simhash._INVERSE)) ^ masks[(packed & simhash._MASK).astype(int)]
        assert np.isin(back, prints).all()
    assert words.nbytes == 8 * len(words) and abs(len(words) / (256 * 2081 / 8) - 1) < 0.02
    assert 48 / (block * 2081 / 2**depth) < 0.8 and 2 ** (depth - group_bits) * simhash.GROUP_BYTES >= 0.5 * n * 2081 * 8


@pytest.mark.parametrize("task_edges", [10**6, 50])
def test_components_match_union_find(spark, task_edges):
    """Chains, stars and random graphs, in one task and by star steps over many."""
    rng = random.Random(8)
    edges = [(i, i + 1) for i in range(1000, 1150)] + [(0, i) for i in range(1, 200)] + [(rng.randrange(2000, 2600), rng.randrange(2000, 2600)) for _ in range(300)] + [(5, 5)]
    a, b = simhash.forest(*(np.array(c) for c in zip(*edges, strict=True)))
    got = {tuple(r) for r in simhash.components(spark.createDataFrame(edges, "a long, b long").repartition(3), task_edges).collect()}
    assert got == set(zip(a.tolist(), b.tolist(), strict=True))


def test_simhash_edges(spark):
    prints = simhash.fingerprints(frame(spark, EDGE))
    out = simhash.cluster(prints).collect()
    assert len(out) == len(EDGE) and {r["component_id"] for r in out if r["fp"] == 0} == {1}
    assert {r["component_id"] for r in out if r["doc_id"] in (6, None)} == {6}
    assert simhash.cluster(simhash.fingerprints(frame(spark, []))).count() == 0


def jaccard_groups(texts):
    sets = {}
    for i, t in texts.items():
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in sets:
        for j in sets:
            if i < j and 5 * len(both := sets[i] & sets[j]) >= 4 * (len(sets[i]) + len(sets[j]) - len(both)):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {find(i) for i in sets}


def test_near_copies_leave_one_of_each_group(spark, documents):
    kept = {r["doc_id"] for r in near_dedup.keep_one(documents).select("doc_id").collect()}
    assert kept == jaccard_groups(dict(documents.select("doc_id", "text").collect()))


def test_near_dedup_edges_keep_columns(spark):
    df = frame(spark, EDGE)
    out = near_dedup.keep_one(df)
    assert out.columns == df.columns
    assert sorted(r["doc_id"] for r in out.collect()) == [1, 4, 5, 6, 7, 8]
    assert near_dedup.keep_one(frame(spark, [])).count() == 0


def variants(n, words, edits, seed):
    """n copies of one text, each with 2, 4, ... random words replaced."""
    rng = random.Random(seed)
    base = [f"w{rng.randrange(10**6)}" for _ in range(words)]
    out = []
    for _ in range(n):
        text = list(base)
        for i in rng.sample(range(words), rng.choice(edits)):
            text[i] = f"x{rng.randrange(10**6)}"
        out.append(" ".join(text))
    return out


def near_classes(spark, texts, small=near_dedup.SMALL):
    """Units that stay of texts in one candidate component, and the pairs compared."""
    _, _, _, minima, bands = near_dedup._print_block([t.encode() for t in texts])
    units = spark.createDataFrame([(i, [int(x) for x in m], b) for i, (m, b) in enumerate(zip(minima, bands.view(np.int64).tolist(), strict=True))], "uid long, minima array<long>, bands array<long>")
    own = near_dedup.buckets(units, units.select("uid", F.lit(0).cast("long").alias("root")))
    rows = spark.createDataFrame([(i, t.encode()) for i, t in enumerate(texts)], "uid long, bytes binary")
    root = dict(near_dedup.joined(own, rows.mapInArrow(near_dedup._shingled, "uid long, shingles binary"), small).collect())
    return {i for i in range(len(texts)) if i not in root}


def test_near_dedup_joins_families_as_brute_force_does(spark):
    """Sixty families of thirty variants: the groups are those of all pairs. Four hundred variants of one text, none of
    them its middle and few of them 0.8 alike: at most 2 % of the links are missed, and none is made that is not there."""
    texts = [t for f in range(20) for t in variants(30, 120, (1, 2, 3), f)]
    assert near_classes(spark, texts) == jaccard_groups(dict(enumerate(texts)))
    texts = variants(400, 200, (2, 4, 6), 400)
    exact, kept = jaccard_groups(dict(enumerate(texts))), near_classes(spark, texts)
    assert exact <= kept and len(texts) - len(kept) >= 0.98 * (len(texts) - len(exact)) > 150
    assert near_classes(spark, texts[:60], 100) == jaccard_groups(dict(enumerate(texts[:60])))


@pytest.mark.parametrize("most", [near_dedup.CHUNK, 60])
def test_near_dedup_loses_no_link_of_a_large_family(spark, monkeypatch, most):
    """Variants without their middle, few of them 0.8 alike: the groups are those of all pairs, in one block and in many."""
    monkeypatch.setattr(near_dedup.joined, "__defaults__", (near_dedup.SMALL, most))
    for n, seed in ((400, 400), (250, 7)):
        texts = variants(n, 200, (2, 4, 6), seed)
        assert near_classes(spark, texts) == jaccard_groups(dict(enumerate(texts)))


def test_near_dedup_candidates_hold_short_and_hard_pairs():
    """Pairs at 0.8 or more, most of them short or near 0.8, share a band."""
    rng, found, of = random.Random(5), 0, 0
    for words in (20, 30, 45, 60, 150, 400):
        for _ in range(150):
            a, b = variants(1, words, (0,), rng.random())[0].split(), None
            b = list(a)
            for i in rng.sample(range(words), max(1, round(words * rng.choice((0.01, 0.015, 0.02))))):
                b[i] = "y"
            pair = [" ".join(a), " ".join(b)]
            if len(jaccard_groups(dict(enumerate(pair)))) == 1:
                bands = near_dedup._print_block([t.encode() for t in pair])[4]
                found, of = found + bool((bands[0] == bands[1]).any()), of + 1
    assert of > 300 and found >= 0.998 * of


def waterfill(sizes):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, left, open_ = {}, 1.5 * sum(sizes.values()), set(order)
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] >= 2 * sizes[s]}
        if not full:
            return target | {s: level * weight[s] for s in open_}
        for s in full:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
        open_ -= full
    return target


def test_mix_meets_targets(spark):
    rng = random.Random(1)
    rows = [(i, "w " * rng.randrange(1, 60), rng.choice(["a", "b", "c", "d", "é", None])) for i in range(3000)]
    out = mixing.mix(frame(spark, rows), block_rows=64, fan_in=4).collect()
    assert len(out) == 3000
    sizes, taken, goal = defaultdict(int), defaultdict(int), {}
    for r in out:
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["size"] * r["copies"]
        goal[r["source"]] = r["target"]
        assert 0 <= r["copies"] <= 2
    want = waterfill(dict(sizes))
    for s in sizes:
        assert goal[s] == pytest.approx(want[s]) and abs(taken[s] - goal[s]) <= 60
    again = mixing.mix(frame(spark, rows).repartition(7), block_rows=64, fan_in=4).collect()
    assert sorted((r["doc_id"], r["copies"]) for r in again) == sorted((r["doc_id"], r["copies"]) for r in out)


def test_mix_edges(spark):
    out = {r["doc_id"]: r for r in mixing.mix(frame(spark, EDGE)).collect()}
    assert len(out) == 9 and out[1]["size"] == 0 and out[1]["copies"] == 0
    assert mixing.mix(frame(spark, [])).count() == 0
    assert mixing.mix(frame(spark, [(1, None, "a"), (2, " ", None)])).count() == 2
    df = frame(spark, EDGE)
    rows = mixing.materialise(df)
    assert rows.columns == df.columns and rows.where("text is null").count() == 0
    total = sum(r["copies"] for r in mixing.mix(df).collect())
    assert rows.count() == total


def test_expectations_survive_rounding():
    size, p = np.array([3, 5, 8, 13, 2, 7]), np.array([0.3, 0.5, 0.25, 0.4, 0.9, 0.6])
    runs = []
    for k in range(4000):
        q = p.copy()
        held = mixing.round_block(size, q, ("t", k))
        assert abs((q * size).sum() - (p * size).sum()) < 1e-6 and (held >= 0) == bool(((q > 0) & (q < 1)).any())
        runs.append(q)
    assert np.abs(np.mean(runs, axis=0) - p).max() < 0.03


def test_shards_are_even_and_gapless(spark, documents):
    rows = sharding.op10_sharding(spark, SF).collect()
    by = defaultdict(list)
    for r in rows:
        by[r["shard"]].append(r)
        assert r["law"] == "bytes" and r["grown_shard"] is None
    for own in by.values():
        assert sorted(r["slot"] for r in own) == list(range(len(own)))
    sizes = {k: sum(r["size"] for r in v) for k, v in by.items()}
    share, most = sum(sizes.values()) / 40, max(r["size"] for r in rows)
    assert max(sizes.values()) <= share + most and len(rows) == documents.count()


def reference_shards(texts, shards):
    """(shard, slot) by sorting everything: hash of the text, id; the place of a record's middle on the line of all bytes."""
    rows = sorted((xxhash.xxh64_intdigest((t or "").encode(), 42), d, len((t or "").encode()) + 16) for d, t in texts)
    rows.sort(key=lambda r: (r[0] - (1 << 64) if r[0] >> 63 else r[0], r[1]))
    total, at, out, used = sum(r[2] for r in rows), 0, {}, defaultdict(int)
    for _, d, size in rows:
        shard = min(shards - 1, int((at + size / 2) * shards / total))
        out[d] = shard, used[shard]
        at, used[shard] = at + size, used[shard] + 1
    return out


def test_shards_match_a_sort_of_everything(spark, documents, monkeypatch):
    got = {r["doc_id"]: (r["shard"], r["slot"]) for r in sharding.op10_sharding(spark, SF).collect()}
    texts = [tuple(r) for r in documents.select("doc_id", "text").collect()]
    assert got == reference_shards(texts, 40)
    monkeypatch.setattr(sharding, "SAMPLED", 1)  # a sample that leaves ranges overfull
    hot = [(i, "hot" if i % 3 == 0 else f"text {i} " * (1 + i % 7)) for i in range(2000)]
    out = sharding.shard(clashing(spark, hot), 7)
    assert {r["doc_id"]: (r["shard"], r["slot"]) for r in out.collect()} == reference_shards(hot, 7)


def test_overfull_ranges_are_cut_to_the_end(spark, monkeypatch):
    """Keys of which a third are one key: in the end no range but of single keys holds more than its share allows."""
    monkeypatch.setattr(sharding, "SAMPLED", 1)
    keys = spark.range(3000).selectExpr("if(id % 3 = 0, 0, id * 7919 % 4001) as h", "if(id % 3 = 0, 5, id) as d", "100L as size")
    bounds = sharding.splitters(keys, 3000, 300_000, 10)
    rows = [(r["h"], r["d"]) for r in keys.collect()]
    of = sharding._range_of(*(np.array(c, dtype=np.int64) for c in zip(*rows, strict=True)), *(np.array(c, dtype=np.int64) for c in zip(*bounds, strict=True)))
    held = defaultdict(list)
    for k, r in zip(of.tolist(), rows, strict=True):
        held[k].append(r)
    assert all(len(v) * 100 <= sharding.OVERFULL * 300_000 / 40 + 100 or len(set(v)) == 1 for v in held.values())


def test_all_columns_come_through(spark):
    rows = REPEATED + [(20 + i, f"some text {i}\nshared line") for i in range(20)]
    df = clashing(spark, rows)
    want = sorted(((d, t) for d, t in rows), key=str)
    assert owned(sharding.shard(df, 3)) == want and set(sharding.shard(df, 3).columns) == {*df.columns, "size", "shard", "slot"}
    for most in (1_000_000, 0):
        out = line_dedup.strip_boilerplate(df, 1, broadcast_lines=most)
        assert out.columns == [*df.columns, "n_lines", "n_removed", "clean_text"] and owned(out) == want
    mixed = mixing.materialise(df)
    assert mixed.columns == df.columns and set(owned(mixed)) <= set(want)


def test_repeated_rows_spread_over_blocks(spark):
    """Rows that agree in everything are numbered and mixed like others, and reruns agree."""
    rows = [(1, "same words here", "a")] * 5000 + [(None, "no id", "a")] * 3000 + [(i, "w " * (i % 9 + 1), "b") for i in range(3000)]
    out = mixing.numbered(mixing.with_sizes(frame(spark, rows)))
    assert out.count() == len(rows) and out.where("doc_id = 1").select("number").distinct().count() == 5000
    one, two = (mixing.mix(frame(spark, rows).repartition(n), block_rows=256).groupBy("doc_id", "copies").count().collect() for n in (2, 5))
    assert sorted(map(str, one)) == sorted(map(str, two))
    took = mixing.mix(frame(spark, rows), block_rows=256).groupBy("source").agg(F.sum(F.col("copies") * F.col("size")).alias("t"), F.first("target").alias("target")).collect()
    assert all(abs(r["t"] - r["target"]) <= 10 for r in took)


def test_a_hot_text_is_cut_between_its_documents(spark, monkeypatch):
    monkeypatch.setattr(sharding, "SAMPLED", 4)
    rows = [(i, "same text", "s") for i in range(3000)] + [(i, f"text {i}", "s") for i in range(3000, 6000)]
    out = sharding.shard(frame(spark, rows), 10)
    n = {r["shard"]: (r["b"], r["n"]) for r in out.groupBy("shard").agg(F.sum("size").alias("b"), F.count(F.lit(1)).alias("n")).collect()}
    total = sum(b for b, _ in n.values())
    assert len(n) == 10 and all(abs(b - total / 10) <= 60 for b, _ in n.values())
    assert out.where("text = 'same text'").select("shard").distinct().count() <= 6


def test_shard_edges(spark):
    out = sharding.shard(frame(spark, EDGE), 3)
    assert out.count() == len(EDGE) and out.where("text is null").first()["size"] == 16 and "lang" in out.columns
    assert sharding.shard(frame(spark, [])).count() == 0
