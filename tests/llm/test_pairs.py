"""Co-occurrence, set similarity: against brute force, and the defined cases."""

import itertools
import random
from collections import Counter, defaultdict

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tessela.llm import cooccurrence, set_similarity


def test_basket_pairs_are_those_of_every_basket(spark):
    rng = random.Random(1)
    baskets = {b: set(rng.sample(range(60), n)) for b, n in enumerate([1, 2, 5, 13, 40, 60])}
    df = spark.createDataFrame([(b, i) for b, items in baskets.items() for i in items], "basket int, item int")
    expected = Counter(p for items in baskets.values() for p in itertools.combinations(sorted(items), 2))
    for chunk in (4, 7, 128):
        got = Counter((r["a"], r["b"]) for r in cooccurrence.basket_pairs(df, chunk).collect())
        assert got == expected


def test_scores_nulls_repeats_and_clashing_columns(spark):
    rows = [(o, p, "x", 1) for o in range(30) for p in ((1, 2) if o < 6 else (3, o))]
    rows += [(0, 1, "y", 2), (None, 1, "", 0), (2, None, "", 0)]
    df = spark.createDataFrame(rows, "basket_id int, product int, item string, n int")
    got = {(r["item_a"], r["item_b"]): r for r in cooccurrence.frequent_pairs(df, "basket_id", "product").collect()}
    assert set(got) == {(1, 2)}
    r = got[1, 2]
    assert (r["n"], r["n_a"], r["n_b"], r["n_baskets"], r["lift"], r["jaccard"]) == (6, 6, 6, 30, 5.0, 1.0)
    assert cooccurrence.frequent_pairs(df.where("n > 99"), "basket_id", "product").count() == 0


def records(spark, sets):
    return spark.createDataFrame([(t, i, sorted(s)) for t, i, s in sets], "table string, id int, tokens array<string>")


def brute(sets, threshold):
    out = set()
    for (ta, ia, a), (tb, ib, b) in itertools.combinations(sets, 2):
        if (ta, ia) != (tb, ib) and len(a & b) >= threshold * len(a | b) - 1e-9:
            out.add((*min((ta, ia), (tb, ib)), *max((ta, ia), (tb, ib))))
    return out


def test_similar_sets_equal_brute_force(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(40)]
    sets = []
    for i in range(120):
        base = set(rng.choices(words, weights=[30 if j < 3 else 1 for j in range(40)], k=rng.randint(5, 9))) if i % 3 or not sets else set(sets[rng.randrange(len(sets))][2])
        if i % 4 == 0:
            base ^= {rng.choice(words)}
        if len(base) >= 2:
            sets.append(("a" if i % 2 else "b", i, frozenset(base)))
    for block in (3, 512):
        classes, pairs = set_similarity.similar_sets(records(spark, sets), 0.6, block)
        by = defaultdict(list)
        for r in classes.collect():
            by[r["set_id"]].append((r["table"], r["id"]))
        got = {(*min(x, y), *max(x, y)) for p in pairs.collect() for x in by[p["set_a"]] for y in by[p["set_b"]]}
        got |= {(*min(x, y), *max(x, y)) for members in by.values() for x, y in itertools.combinations(members, 2)}
        assert got == brute(sets, 0.6)
    assert {tuple(r) for r in set_similarity.similar_records(records(spark, sets), 0.6).collect()} == brute(sets, 0.6)
    degree = Counter(x for p in brute(sets, 0.6) for x in (p[:2], p[2:]))
    assert {(r["table"], r["id"]): r["links"] for r in set_similarity.similarity_degrees(records(spark, sets), 0.6).collect()} == {s[:2]: degree[s[:2]] for s in sets}


def test_normalised_sets(spark):
    rows = [(1, ["A ", " a", None, "", "b", "c", "d", "e"], "x"), (2, None, "x"), (3, [], "x"), (None, ["a", "b", "c", "d", "e"], "x"), (4, ["a", "b", "c", "d"], "x"), (1, ["A ", " a", None, "", "b", "c", "d", "e"], "y")]
    df = spark.createDataFrame(rows, "id int, kw array<string>, tokens string")
    assert [(r["id"], r["tokens"]) for r in set_similarity.normalised_sets(df, "id", "kw", 5).collect()] == [(1, ["a", "b", "c", "d", "e"])]
    empty = set_similarity.normalised_sets(df.where("id > 99"), "id", "kw", 5).selectExpr("'t' AS table", "*")
    assert set_similarity.similar_records(empty, 0.6).count() == 0


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.frozensets(st.sampled_from("abcdefgh"), min_size=2), min_size=2, max_size=12))
def test_any_sets(spark, sets):
    named = [("t", i, s) for i, s in enumerate(sets)]
    assert {tuple(r) for r in set_similarity.similar_records(records(spark, named), 0.6).collect()} == brute(named, 0.6)


def test_hot_items_and_large_baskets_change_nothing(spark, monkeypatch):
    rng = random.Random(7)
    baskets = [[1, *rng.sample(range(2, 30), 4)] for _ in range(60)] + [list(range(1, 60))] * 2
    df = spark.createDataFrame([(b, i) for b, items in enumerate(baskets) for i in items], "b int, i int")
    plain = {tuple(r) for r in cooccurrence.frequent_pairs(df, "b", "i", 3, 0.5).collect()}
    monkeypatch.setattr(cooccurrence, "HOT", 10)
    assert {tuple(r) for r in cooccurrence.frequent_pairs(df, "b", "i", 3, 0.5, chunk=7).collect()} == plain and plain
