"""Decontamination, licenses, line dedup and token counts against brute force and planted cases."""

import random
import re
from collections import defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import decontamination as D
from tessera.llm import licenses, line_dedup, token_counts

SF = "/root/testdata/sf0.001"
EDGE = [(1, None, "a"), (2, "", None), (3, " \n ", "a"), (4, "x", "b"), (4, "x", "b"), (None, "x y z", "b"), (5, "word " * 30_000, "c"), (6, "é\nü", "c")]


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({"n_lines": F.lit("clash"), "score": F.lit("clash"), "item_id": F.lit("clash")})


def smith_waterman(a, b):
    h = np.zeros((len(a) + 1, len(b) + 1), dtype=int)
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            h[i, j] = max(0, h[i - 1, j - 1] + (2 if a[i - 1] == b[j - 1] else -1), h[i - 1, j] - 1, h[i, j - 1] - 1)
    return int(h.max())


def test_alignment_scores_like_the_full_table():
    rng = np.random.default_rng(2)
    for _ in range(60):
        a, b = rng.integers(0, 5, rng.integers(1, 25)), rng.integers(0, 5, rng.integers(1, 15))
        score, lo, hi = D.align(a, b)
        assert score == smith_waterman(a, b)
        assert score == 0 or smith_waterman(a[lo:hi], b) == score


def test_planted_leaks_are_found_and_clean_documents_left(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    items = [[word() for _ in range(40)] for _ in range(8)] + [["only", "three", "words"]]
    rows, want = [], set()
    for d in range(120):
        text = [word() for _ in range(200)]
        if d % 4 == 0:
            k = rng.randrange(8)
            copy = [word() if d % 8 and i % 5 == 2 else w for i, w in enumerate(items[k])]  # every fifth word replaced in half of them
            text[50:50] = copy
            want.add((d, k))
        rows.append((d, " ".join(text).title() if d % 3 else " ".join(text), "s"))
    rows += [(d, " ".join(items[0]), "s") for d in range(1000, 1400)]  # a common item keeps its seeds
    want |= {(d, 0) for d in range(1000, 1400)}
    bench = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)] + [(99, None)], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in D.leaks(frame(spark, rows), bench).collect()}
    assert got == want
    clean = D.decontaminate(frame(spark, rows), bench)
    assert {r["doc_id"] for r in clean.select("doc_id").collect()} == {r[0] for r in rows} - {d for d, _ in want}


def test_leaks_match_the_full_table_over_all_pairs(spark):
    """Every document against every item by the whole Smith-Waterman table: copies with replaced words, cut ones, ones
    with long insertions, and documents made of the items' own words. Pairs of enough score that share no run of three
    words have no seed; there are none here."""
    rng = random.Random(11)
    vocabulary = [f"w{i}" for i in range(60)]
    items = [[rng.choice(vocabulary) for _ in range(rng.choice((5, 9, 20, 45, 100)))] for _ in range(14)]
    docs = []
    for d in range(90):
        text = [rng.choice(vocabulary + ["x", "y"]) for _ in range(rng.randrange(0, 60))]
        if d % 3:
            copy = list(rng.choice(items))
            if d % 3 == 1:
                at = rng.randrange(len(copy))
                copy[at:at] = ["z"] * rng.choice((0, 3, 15, 40))
            copy = [w if rng.random() > rng.choice((0, 0.1, 0.25)) else "q" for w in copy][rng.choice((0, 0, 7)) :]
            text[len(text) // 2 : len(text) // 2] = copy
        docs.append((d, " ".join(text)))
    bench = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["score"] for r in D.leaks(spark.createDataFrame(docs, "doc_id long, text string"), bench).collect()}
    want = {}
    for d, text in docs:
        for i, item in enumerate(items):
            score = smith_waterman(text.split(), item)
            if score >= D.needed(len(item)):
                want[d, i] = score / (2 * len(item))
    assert got == pytest.approx(want) and len(want) > 25


def test_decontamination_in_blocks_of_items(spark, monkeypatch):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    one = sorted(map(tuple, D.leaks(docs, bench).collect()))
    monkeypatch.setattr(D, "ITEM_WORDS", 300)
    assert sorted(map(tuple, D.leaks(docs, bench).collect())) == one and one


def test_decontamination_edges(spark):
    bench = spark.createDataFrame([(1, "x y z"), (2, "x"), (3, "")], "item_id long, text string")
    got = sorted(((r["doc_id"] is None, r["doc_id"] or 0, r["item_id"]) for r in D.leaks(frame(spark, EDGE), bench).collect()))
    assert got == [(False, 4, 2), (False, 4, 2), (True, 0, 1), (True, 0, 2)]
    assert D.leaks(frame(spark, []), bench).count() == 0 and D.leaks(frame(spark, EDGE), bench.where("item_id > 9")).count() == 0
    df = frame(spark, EDGE)
    assert D.decontaminate(df, bench).columns == df.columns and D.decontaminate(df, bench).count() == 5


def brute_license(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    at, labels = [], set()
    for phrase, label in licenses.PHRASES.items():
        p = phrase.split()
        places = [i for i in range(len(words) - len(p) + 1) if words[i : i + len(p)] == p]
        at += places
        labels |= {label} if places else set()
    best, more = 0.0, set()
    for label, template in licenses.TEMPLATES.items():
        t = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", template.lower())
        for k in range(max(1, len(words))):
            share = len(set(t) & set(words[k : k + 2 * len(t)])) / len(set(t))
            if share >= 0.8 - 1e-9:
                more.add(label)
                best = max(best, share)
    return len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels)), ",".join(sorted(labels | more)), 1.0 if labels else best


def license_rows(spark):
    rng = random.Random(9)
    filler = [w for t in licenses.TEMPLATES.values() for w in t.split()] + ["alpha", "beta"]
    rows = [(i, " ".join(rng.choice(filler) for _ in range(rng.randrange(0, 120))), "s") for i in range(150)]
    for i, t in enumerate(licenses.TEMPLATES.values()):
        cut = t.split()
        rows.append((200 + i, "pre " * rng.randrange(40) + " ".join(w for j, w in enumerate(cut) if j % 7 != 3) + " post", "s"))
        for k in range(6):  # 12 % of the words replaced, 60 % inserted, at any offset
            text = ["pre"] * rng.randrange(3 * len(cut))
            for w in cut:
                text += ["other"] * (rng.random() < 0.6) + [w if rng.random() > 0.12 else "else"]
            rows.append((400 + 10 * i + k, " ".join(text), "s"))
    return rows + [(i + 1000 if i is not None else None, t, s) for i, t, s in EDGE] + [(300, "CC-BY cc by; the MIT License", "s")]


def test_licenses_match_brute_force(spark):
    rows = license_rows(spark)
    got = sorted(((str(r["doc_id"]), *list(r)[1:]) for r in licenses.scan(frame(spark, rows)).collect()), key=str)
    want = sorted(((str(i), *brute_license(t)) for i, t, _ in rows), key=str)
    assert [g[:7] for g in got] == [w[:7] for w in want]
    assert [g[7] for g in got] == pytest.approx([w[7] for w in want])
    assert licenses.scan(frame(spark, [])).count() == 0


def test_lines_match_sql_by_both_ways(spark):
    c = duckdb.connect()
    c.sql(f"create view documents as select * from '{SF}/documents.parquet'")
    want = sorted(c.sql(line_dedup.ORACLE).fetchall())
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "source")
    for most in (1_000_000, 0):
        out = line_dedup.strip_boilerplate(docs, broadcast_lines=most).select(F.sha2("clean_text", 256).alias("clean_sha256"), "doc_id", "n_lines", "n_removed")
        got = [(r["doc_id"], r["n_lines"], r["n_removed"], r["clean_sha256"]) for r in out.collect()]
        names = [d[0] for d in c.sql(line_dedup.ORACLE).description]
        assert sorted(got) == sorted(tuple(dict(zip(names, w, strict=True))[k] for k in ("doc_id", "n_lines", "n_removed", "clean_sha256")) for w in want)


def test_boilerplate_counts_sites_near_the_threshold_exactly(spark):
    rows = [(i * 100 + s, f"  line {i}\nown {i} {s}\n", f"site{s}") for i in range(7, 14) for s in range(i)] + EDGE
    for most in (1_000_000, 0):
        out = {r["doc_id"]: r for r in line_dedup.strip_boilerplate(frame(spark, rows), broadcast_lines=most).collect() if r["doc_id"] is not None and r["doc_id"] >= 700}
        assert all(r["n_removed"] == (d // 100 >= 10) for d, r in out.items())
        assert out[700]["clean_text"].startswith("  line 7") and out[1000]["clean_text"] == "own 10 0\n"
    assert line_dedup.strip_boilerplate(frame(spark, EDGE)).count() == len(EDGE) and line_dedup.strip_boilerplate(frame(spark, [])).count() == 0


def vocabulary():
    with open(token_counts.VOCABULARY, "rb") as f:
        return f.read()


def test_token_spans_tile_the_text_and_round_trip():
    v = vocabulary()
    encoder, _ = token_counts.encoding(v)
    for text in ("", "Hello, world!", "é ü\n\n  ß — 日本語 🎉 ok", "a\n\nb\n", "x" * 3000):
        first, end = token_counts.token_spans(text.encode(), v)
        ids = encoder.encode_ordinary(text)
        assert encoder.decode(ids) == text and len(first) == len(ids)
        if ids:
            assert first[0] == 0 and end[-1] == len(text) and (np.diff(first) >= 0).all()


def test_sections_are_lines():
    assert token_counts.line_spans("ab\ncé\n".encode()).tolist() == [0, 3, 6]
    assert token_counts.line_spans(b"").tolist() == [0, 0] and token_counts.line_spans(b"\n\nx").tolist() == [0, 1, 2, 3]


def ill_formed(spark):
    return spark.sql("select 1L as doc_id, cast(x'61ff620a63' as string) as text, 's' as source union all select 2L, cast(x'610ae282' as string), 's'")


def test_ill_formed_utf8_has_defined_results(spark):
    rows = sorted((r["doc_id"], r["section"], r["first_char"], r["end_char"]) for r in token_counts.count(ill_formed(spark)).collect())
    assert rows == [(1, 0, 0, 4), (1, 1, 4, 5), (2, 0, 0, 2), (2, 1, 2, 3)]
    for most in (1_000_000, 0):
        out = line_dedup.strip_boilerplate(ill_formed(spark), broadcast_lines=most).select("doc_id", F.hex("text").alias("a"), F.hex("clean_text").alias("b"), "n_lines").collect()
        assert len(out) == 2 and all(r["a"] == r["b"] and r["n_lines"] == 2 for r in out)
    bench = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    assert D.decontaminate(ill_formed(spark), bench).count() == 2 and D.leaks(ill_formed(spark), bench).count() == 0
    assert licenses.scan(ill_formed(spark)).count() == 2


def test_fields_share_one_encoding(spark):
    df = spark.createDataFrame([(1, "A title", "the body of it", "x"), (2, None, "só", "y"), (3, "", "", "z")], "doc_id long, title string, text string, section string")
    v = vocabulary()
    encoder, sizes = token_counts.encoding(v)
    got = defaultdict(list)
    for r in token_counts.count_fields(df, ["title", "text"]).collect():
        got[r["doc_id"]].append((r["section"], r["first_char"], r["end_char"], r["tokens"]))
    for i, whole, cut in ((1, "A title\nthe body of it", 8), (2, "\nsó", 1), (3, "\n", 1)):
        first, _ = token_counts.token_spans(whole.encode(), v)
        assert len(first) == len(encoder.encode_ordinary(whole))
        assert sorted(got[i]) == sorted([("title", 0, cut, float((first < cut).sum())), ("text", cut, len(whole), float((first >= cut).sum()))])


def test_rules_allocate_crossing_tokens():
    first, end, edges = np.array([0, 2, 5]), np.array([2, 5, 9]), np.array([0, 3, 9])
    assert token_counts.attribute(first, end, edges).tolist() == [2, 1]
    assert token_counts.attribute(first, end, edges, "majority").tolist() == [1, 2]
    assert token_counts.attribute(first, end, edges, "split").tolist() == pytest.approx([1 + 1 / 3, 2 - 1 / 3])


def test_counts_match_brute_force(spark):
    v = vocabulary()
    encoder, sizes = token_counts.encoding(v)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {}
    for r in token_counts.op7_token_counts(spark, SF).collect():
        got[r["doc_id"], r["section"]] = (r["first_char"], r["end_char"], r["tokens"])
    for d, text in docs.select("doc_id", "text").collect():
        lines = [x for x in re.split(r"(?<=\n)", text) if x] or [""]
        at, n, byte = 0, [0] * len(lines), 0
        ends = np.cumsum([len(x.encode()) for x in lines])
        for t in encoder.encode_ordinary(text):
            n[int(np.searchsorted(ends, byte, "right"))] += 1
            byte += int(sizes[t])
        for k, line in enumerate(lines):
            assert got.pop((d, k)) == (at, at + len(line), n[k])
            at += len(line)
    assert not got


def test_token_edges(spark):
    out = token_counts.count(frame(spark, EDGE))
    assert out.where("doc_id in (1, 2)").select("section", "tokens").distinct().collect() == [(0, 0.0)]
    assert out.where("doc_id = 4").count() == 2 and token_counts.count(frame(spark, [])).count() == 0
    with pytest.raises(ValueError):
        token_counts.count(frame(spark, EDGE), rule="other")
