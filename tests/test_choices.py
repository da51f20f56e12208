"""Choices that depend on earlier ones against sequential loops."""

import random

from pyspark.sql import functions as F

from lectern.operators import greedy as G


def test_first_independent_matches_loop(spark):
    r = random.Random(2)
    pairs = [(i, i + 1) for i in range(40)] + [(r.randrange(100, 200), r.randrange(100, 200)) for _ in range(250)] + [(300, 300), (7, 6)]
    near = {}
    for x, y in pairs:
        near.setdefault(x, set()).add(y)
        near.setdefault(y, set()).add(x)
    taken, gone = [], {}
    for k in sorted(near):
        by = [t for t in taken if t in near[k] and t != k]
        if by:
            gone[k] = min(by)
        else:
            taken.append(k)
    got = {x.key: x.by for x in G.first_independent(spark.createDataFrame(pairs, "x long, y long")).collect()}
    assert got == gone
    assert G.first_independent(spark.createDataFrame([], "x long, y long")).collect() == []


def test_unlike_titles(spark):
    rows = [(1, "a", "red green blue"), (2, "b", "red green blue"), (3, "a", "Blue green red"), (4, "a", "red green"), (5, "a", "red green"), (6, None, "red green blue"), (7, None, "blue, green; red"), (8, "a", None), (9, "a", "red green blue gold pink"), (10, "a", "red green blue gold")]
    df = spark.createDataFrame(rows, "id long, kind string, title string")
    got = {x.id: (x.taken, x.by) for x in G.unlike_titles(df, "id", "kind", "title", ["the"], 0.7).collect()}
    assert got == {1: (True, None), 2: (True, None), 3: (False, 1), 4: (True, None), 5: (True, None), 6: (True, None), 7: (False, 6), 8: (True, None), 9: (True, None), 10: (False, 1)}


def test_title_pairs_of_a_kind_are_compared_whole_only_after_they_met(spark):
    """Against a loop; and what is tested for each two titles with a word in common is numbers, not sets."""
    from lectern.operators.reconcile import near_title_pairs

    r = random.Random(4)
    rows = [(i, r.choice(["x", "y", None]), " ".join(r.choice("abcdefghijklmnopqrst") * 3 for _ in range(r.randint(3, 18)))) for i in range(200)]
    sets = {}
    for k, kind, t in rows:
        if len(set(t.split())) >= 3:
            sets.setdefault((kind, frozenset(t.split())), k)
    want = {(k, m): round(len(a & b) / len(a | b), 9) for (g, a), k in sets.items() for (h, b), m in sets.items() if g == h and k < m and len(a & b) >= 3 and 2 * len(a & b) >= len(a | b)}
    pairs = near_title_pairs(spark.createDataFrame(rows, "k long, kind string, t string"), "k", "t", [], 0.5, 3, "kind")
    got = pairs.collect()
    assert want and len(got) == len(want) and {(x.x, x.y): x.similarity for x in got} == want
    joins = [line for line in pairs._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join Inner" in line]
    assert joins and not any("array_intersect" in line for line in joins)


def loop_quota(cells):
    own = {b: min(t, n) for b, n, t in cells}
    lack = sum(t for _, _, t in cells) - sum(own.values())
    for b, n, _ in cells:
        more = min(n - own[b], lack)
        own[b] += more
        lack -= more
    return own


def test_refilled_quota_and_picks_match_loop(spark):
    r = random.Random(6)
    cells = [(d, b, r.choice([0, 3, 10, 40]), r.choice([0, 5, 12])) for d in range(12) for b in range(3)]
    df = spark.createDataFrame(cells, "d int, b int, n int, target int")
    got = G.refilled_quota(df, ["d"], F.col("b"), "n", "target")
    want = {(d, b): k for d in range(12) for b, k in loop_quota([c[1:] for c in cells if c[0] == d]).items()}
    assert {(x.d, x.b): x.allocation for x in got.collect()} == want
    rows = [(d, b, r.randrange(9), i) for d, b, n, _ in cells for i in range(n)]
    picks = G.first_of_cells(spark.createDataFrame(rows, "d int, b int, w int, i int"), ["d", "b"], ["w", "i"], got).collect()
    for d, b, _, _ in cells:
        first = sorted((w, i) for x, y, w, i in rows if (x, y) == (d, b))[: want[(d, b)]]
        assert sorted((x.w, x.i, x["rank"]) for x in picks if (x.d, x.b) == (d, b)) == [(*f, k + 1) for k, f in enumerate(first)]


def loop_repair(n, v, t):
    v, t, moved = list(v), list(t), 0
    for b in range(len(n)):
        while v[b] + t[b] > n[b]:
            a = t if t[b] >= v[b] else v
            if a[b] == 0:
                a = v if a is t else t
            free = [c for c in range(len(n)) if c != b and v[c] + t[c] < n[c]]
            if not free:
                return None
            a[b] -= 1
            a[free[0]] += 1
            moved += 1
    return v, t, moved


def test_overdraw_matches_loop(spark):
    r = random.Random(1)
    rows, want = [], {}
    for d in range(60):
        n, v, t = ([r.randrange(k) for _ in range(3)] for k in (9, 6, 6))
        rows += [(d if d else None, b, n[b], v[b], t[b]) for b in range(3)]
        want[d if d else None] = (loop_repair(n, v, t), v, t)
    got = {}
    for x in G.without_overdraw(spark.createDataFrame(rows, "d int, b int, n int, val long, test long"), ["d"], F.col("b"), "n", "val", "test").collect():
        got.setdefault(x.d, {})[x.b] = (x.val, x.test, x.moved)
    assert any(w[0] is None for w in want.values()) and any(w[0] and w[0][2] > 1 for w in want.values())
    for d, (w, v, t) in want.items():
        assert [got[d][b] for b in range(3)] == ([(w[0][b], w[1][b], w[2]) for b in range(3)] if w else [(v[b], t[b], None) for b in range(3)])


def test_median_picks_match_loop(spark):
    r = random.Random(3)
    for trial in range(2):
        rows = [(i, r.choice("ab"), r.choice(["s", "m"]), r.choice([None, 1, 2, 3, 4])) for i in range(9 + 30 * trial)]
        plan = [(d, b) for _ in range(3) for d in "abz" for b in "smx"][:12]
        order = lambda x: (x[3] is not None, x[3] or 0, x[0])
        used, want = set(), []
        for d, b in plan:
            pick = (d, b, None, None)
            for level, f in (("cell", lambda x: x[1:3] == (d, b)), ("domain", lambda x: x[1] == d), ("bucket", lambda x: x[2] == b), ("any", lambda x: True)):  # noqa: B023
                left = sorted((x for x in rows if f(x) and x[0] not in used), key=order)
                if left:
                    pick = (d, b, left[len(left) // 2][0], level)
                    used.add(pick[2])
                    break
            want.append(pick)
        got = G.median_picks(spark.createDataFrame(rows, "id long, d string, b string, w int"), plan, "d", "b", "id", ["w", "id"])
        assert got == want
