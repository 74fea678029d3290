import itertools

import numpy as np
from hypothesis import given
from hypothesis import strategies as st

from tessera.functions import text as T
from tessera.operators.assign import assign


def test_mention_forms():
    assert T.mention_form("Joe's Pizza") == "joes pizza"
    assert T.mention_form("The  Matrix!") == "matrix"
    assert T.mention_form("Straße") == "strasse"
    assert T.mention_form("a the x") == "the x"
    assert T.mention_form(None) == ""


def test_name_forms_keep_marks():
    assert T.name_form("  @The   Band-Name ") == "band-name"
    assert T.name_form("a thing") == "a thing"


def test_token_set_ratio():
    assert T.token_set_ratio("joes pizza", "that pizza spot joes") == 100
    assert T.token_set_ratio("dune", "dune part two") == 100
    assert round(T.token_set_ratio("sourdoughh", "sourdough"), 2) == 94.74
    assert T.token_set_ratio("central park", "hyde park") < 90
    assert T.token_set_ratio("", "x") == 0


@given(st.text("ab c", max_size=12), st.text("ab c", max_size=12))
def test_token_set_ratio_is_symmetric_and_bounded(a, b):
    r = T.token_set_ratio(a, b)
    assert 0 <= r <= 100 and abs(r - T.token_set_ratio(b, a)) < 1e-9


@given(st.integers(1, 5), st.integers(1, 5), st.integers(0, 10_000))
def test_assignment_is_optimal(n, m, seed):
    rng = np.random.default_rng(seed)
    w = rng.random((n, m)) * (rng.random((n, m)) < 0.6)
    x = w if n <= m else w.T
    best = max(sum(x[i, p[i]] for i in range(len(x))) for p in itertools.permutations(range(x.shape[1]), len(x)))
    got = assign(w)
    assert abs(sum(w[i, j] for i, j in got) - best) < 1e-9
    assert len(got) == min(n, m) == len({i for i, _ in got}) == len({j for _, j in got})


def test_columns_agree_with_python(spark):
    names = ["Joe's  Pizza", "Ｆｕｌｌ ＷＩＤＴＨ", "Straße ΣΊΣΥΦΟΣ", "@The Cat", "the dog", "An Apple a day", "", "don't-stop"]
    rows = spark.createDataFrame([(x,) for x in names], "s string")
    for r in rows.select("s", T.normalize_mention("s").alias("m"), T.normalize_name("s").alias("n")).collect():
        assert r["m"] == T.mention_form(r["s"])
        assert r["n"] == T.name_form(r["s"])


def test_opaque_ids_and_sealing(spark):
    key = T.derive_key("pw", b"salt", 1000)
    df = spark.createDataFrame([("secret",)], "s string")
    r = df.select(T.opaque_id(key)("s").alias("i"), T.opened(T.sealed(df["s"], key), key).alias("o")).first()
    assert len(r["i"]) == 43 and r["o"] == "secret"
