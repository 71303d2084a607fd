import random

from tessela.operators.hierarchy import descendants, expand_hierarchy


def brute(pairs):
    parent = {}
    for i, p in pairs:
        if i is not None:
            parent.setdefault(i, []).append(p)
    parent = {i: min((p for p in ps if p in parent), default=None) for i, ps in ((i, [p for p in ps if p is not None]) for i, ps in parent.items())}
    out, below = {}, dict.fromkeys(parent, 0)
    for i in parent:
        walk, x = [], i
        while x is not None and x not in walk:
            walk.append(x)
            x = parent[x]
        for y in walk[1:]:
            below[y] += 1
        if x is None:
            out[i] = (walk[-1], len(walk) - 1, "/".join(map(str, walk[::-1])), 0)
        else:
            at = walk.index(x)
            out[i] = (min(walk[at:]), at, "/".join(map(str, walk[: at + 1][::-1])), 1)
    return {i: (*v[:3], below[i], v[3]) for i, v in out.items()}


def check(spark, pairs):
    df = spark.createDataFrame([(i, p, "x", 1) for i, p in pairs], "c int, p int, id string, depth int")
    full = expand_hierarchy(df, "c", "p")
    got = {r["id"]: (r["root_id"], r["depth"], r["path"], r["n_descendants"], r["in_loop"]) for r in full.collect()}
    assert got == brute(pairs)
    return full


def test_trees_loops_repeats_and_nulls(spark):
    pairs = [(1, None), (2, 1), (2, 1), (3, 2), (4, 99), (5, 5), (6, 5), (7, 8), (8, 9), (9, 7), (10, 9), (11, 10), (None, 1), (12, 1)]
    full = check(spark, pairs)
    found = {tuple(r) for r in descendants(full, full.where("id IN (1, 10)")).collect()}
    assert found == {(1, 2), (1, 3), (1, 12), (10, 11)}


def test_descendants_of_circles_are_whole(spark):
    pairs = [(1, 2), (2, 3), (3, 1), (4, 1), (5, 4), (6, 2), (7, 7), (8, 7), (9, 10), (10, 9), (11, None), (12, 11)]
    full = check(spark, pairs)
    found = [tuple(r) for r in descendants(full, full, stretch=2).collect()]
    ring = {(a, b) for a in (1, 2, 3) for b in range(1, 7) if a != b}
    assert len(found) == len(set(found)) and set(found) == ring | {(4, 5), (7, 8), (9, 10), (10, 9), (11, 12)}


def test_long_chain_and_star(spark):
    check(spark, [(i, i - 1 if i else None) for i in range(130)] + [(1000 + i, 50) for i in range(40)])


def test_random_forests(spark):
    rng = random.Random(5)
    check(spark, [(i, rng.choice([None, rng.randrange(120), max(0, i - 1)])) for i in range(120)])


def test_only_loops_and_empty(spark):
    check(spark, [(1, 2), (2, 3), (3, 4), (4, 1), (5, 6), (6, 5)])
    assert expand_hierarchy(spark.createDataFrame([], "c int, p int"), "c", "p").count() == 0


def test_hot_parents_and_long_ids(spark, monkeypatch):
    from tessela.operators import hierarchy

    monkeypatch.setattr(hierarchy, "HOT", 5)
    big = 1 << 40
    df = spark.createDataFrame([(big, None), *[(big + i, big) for i in range(1, 30)], *[(big + i, big + 1) for i in range(30, 50)]], "c long, p long")
    full = expand_hierarchy(df, "c", "p")
    got = {r["id"] - big: (r["depth"], r["n_descendants"], r["root_id"] - big) for r in full.collect()}
    assert got[0] == (0, 49, 0) and got[1] == (1, 20, 0) and got[40] == (2, 0, 0) and len(got) == 50
    assert descendants(full, full.where(f"id = {big}"), stretch=7).count() == 49
