"""Choices that depend on earlier ones, as rounds over tables, prefix sums over cells, or folds over a cell's few numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectern.functions.paragraphs import bound
from lectern.operators.reconcile import near_title_pairs, token_set
from lectern.operators.sequences import number_rows, settled


def first_independent(pairs: DataFrame) -> DataFrame:
    """key, by: which keys of a graph a pass in the order of keys leaves out, and the first taken key that each is next to.

    pairs: x < y, next to each other. The pass takes a key unless it has taken one next to it. Each round takes
    all keys that no smaller undecided one is next to and leaves out those next to them, until no pair is left:
    as many rounds as the longest chain of decisions, each a few joins over the pairs that are left.
    """
    every = left = settled(pairs.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).where("x <> y").distinct())
    out = left.select("y").limit(0)
    while left.limit(1).count():
        taken = left.select("x").distinct().join(left.select(F.col("y").alias("x")).distinct(), "x", "left_anti")
        gone = settled(left.join(taken, "x").select("y").distinct())
        out = out.unionAll(gone)
        rest = left.join(gone.select(F.col("y").alias("x")), "x", "left_anti").join(gone, "y", "left_anti")
        left = settled(rest.select("x", "y"))
    out = settled(out)
    first = every.join(out.select(F.col("y").alias("x")), "x", "left_anti").groupBy("y").agg(F.min("x").alias("by"))
    return out.join(first, "y").select(F.col("y").alias("key"), "by")


def unlike_titles(df: DataFrame, key: str, kind: str, title: str, stop: list[str], least: float = 0.8, shared: int = 3) -> DataFrame:
    """key, kind, taken, by: rows taken one after the other in the order of key, unless the title is like that of one of
    the same kind that was taken; by is the first such one.

    Titles are alike as in `near_title_pairs`; a title with fewer than `shared` words is like none. Of rows of a kind
    with the same set of words only the first can be taken, so only these meet; the others go by it.
    """
    d = df.select(key, kind, F.array_sort(token_set(F.col(title), stop)).alias("w"))
    some = d.where(F.size("w") >= shared)
    first = settled(some.groupBy(kind, "w").agg(F.min(key).alias("first")))
    pairs = near_title_pairs(first.select(F.col("first").alias(key), kind, F.array_join("w", " ").alias("title")), key, "title", stop, least, shared, kind)
    gone = first_independent(pairs).select(F.col("key").alias("first"), F.col("by").alias("first_by"))
    known = first.join(gone, "first", "left").withColumnsRenamed({kind: "__kind", "w": "__w"})
    d = d.join(known, F.expr(f"`{kind}` <=> __kind and w = __w"), "left")
    by = F.coalesce("first_by", F.when(F.col("first") != F.col(key), F.col("first")))
    return d.select(key, kind, by.isNull().alias("taken"), by.alias("by"))


def refilled_quota(cells: DataFrame, by: list[str], priority: Column, count: str, target: str) -> DataFrame:
    """cells with allocation: each cell's target as far as its count goes, and what its group then lacks from the spare
    rows of the group's cells in the order of priority.

    The rows that a cell gives beyond its target are what is lacking less all that cells before it can give:
    running sums over a group's cells, no loop.
    """
    w = Window.partitionBy(*by)
    own = F.least(F.col(count), F.col(target))
    d = cells.withColumns({"__own": own, "__spare": F.col(count) - own, "__p": priority})
    lack = F.sum(F.col(target) - F.col("__own")).over(w)
    before = F.coalesce(F.sum("__spare").over(w.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    d = d.withColumn("__more", F.least(F.col("__spare"), F.greatest(F.lit(0), lack - before)))
    return d.withColumn("allocation", F.col("__own") + F.col("__more")).drop("__own", "__spare", "__p", "__more")


def first_of_cells(df: DataFrame, cell: list[str], order: list[str], cells: DataFrame) -> DataFrame:
    """df's first rows of each cell in a unique order, as many as the cell's `allocation`; with rank from 1.

    Rows are numbered by range partitions and prefix sums, so a cell with most of the rows isn't one task.
    """
    d = number_rows(df, order, cell, "__number").join(cells.select(*cell, "allocation"), cell)
    return d.where(F.col("__number") < F.col("allocation")).withColumn("rank", F.col("__number") + 1).drop("__number", "allocation")


def without_overdraw(cells: DataFrame, by: list[str], order: Column, count: str, val: str, test: str) -> DataFrame:
    """cells with val and test of which no cell has more together than rows, and moved, the records that its group moved.

    Cells are looked at in order. While one is overdrawn, a record of the split that has more there (test if equal,
    the other if it has none) goes to the first other cell with a row left. A group that has no such cell keeps its
    numbers, and moved is null. A fold over the few cells of a group, a step for each record that is moved.
    """
    cell = F.struct(order.alias("o"), F.col(count).cast("long").alias("n"), F.struct(F.col(val).cast("long").alias("v"), F.col(test).cast("long").alias("t")).alias("s"))
    g = cells.groupBy(*by).agg(F.array_sort(F.collect_list(cell)).alias("c"))

    def used(s):
        return s["v"] + s["t"]

    def step(n):
        def move(acc, _):
            a = acc["a"]
            over = F.array_position(F.zip_with(a, n, lambda s, m: used(s) > m), F.lit(True)).cast("int") - 1

            def to(i):
                free = F.array_position(F.transform(F.zip_with(a, n, lambda s, m: used(s) < m), lambda x, k: x & (k != i)), F.lit(True)).cast("int") - 1

                def moved(j):
                    here = a[F.greatest(i, F.lit(0))]
                    test_ = F.when(here["t"] >= here["v"], here["t"] > 0).otherwise(here["v"] == 0)
                    dv, dt = F.when(test_, 0).otherwise(1), F.when(test_, 1).otherwise(0)

                    def of(s, k):
                        d = F.when(k == i, -1).when(k == j, 1).otherwise(0)
                        return F.struct((s["v"] + d * dv).cast("long").alias("v"), (s["t"] + d * dt).cast("long").alias("t"))

                    changed = F.struct(F.transform(a, of).alias("a"), (acc["moved"] + 1).cast("long").alias("moved"))
                    stuck = F.struct(a.alias("a"), F.lit(-1).cast("long").alias("moved"))
                    return F.when((i < 0) | (acc["moved"] < 0), acc).when(j < 0, stuck).otherwise(changed)

                return bound(free, moved)

            return bound(over, to)

        return move

    start = F.struct(F.transform("c", lambda x: x["s"]).alias("a"), F.lit(0).cast("long").alias("moved"))
    n = F.transform("c", lambda x: x["n"])
    times = F.aggregate("c", F.lit(0).cast("long"), lambda a, x: a + F.greatest(used(x["s"]) - x["n"], F.lit(0)))
    steps = F.when(times > 0, F.sequence(F.lit(1).cast("long"), times)).otherwise(F.array().cast("array<bigint>"))
    done = g.withColumn("n", n).withColumn("r", F.aggregate(steps, start, step(F.col("n"))))
    ok = F.col("r.moved") >= 0  # below where a group can't be mended
    done = done.select(*by, F.when(ok, F.col("r.moved")).alias("moved"), F.explode(F.zip_with("c", F.col("r.a"), lambda c, s: F.struct(c["o"].alias("o"), F.when(ok, s).otherwise(c["s"]).alias("s")))).alias("x"))
    done = done.select(*[F.col(b).alias(f"__{b}") for b in by], F.col("x.o").alias("__o"), "x.s", "moved")
    same = F.lit(True)
    for b in by:
        same = same & F.col(b).eqNullSafe(F.col(f"__{b}"))
    out = cells.withColumn("__order", order).join(done, same & (F.col("__order") == F.col("__o")))
    return out.select(*[c for c in cells.columns if c not in (val, test)], F.col("s.v").alias(val), F.col("s.t").alias(test), "moved")


def median_picks(df: DataFrame, plan: list[tuple[str, str]], domain: str, bucket: str, key: str, order: list[str]) -> list[tuple[str, str, object, str | None]]:
    """For each (domain, bucket) of the plan in turn the median of the rows not picked yet, by a unique order that ends with key:
    (domain, bucket, key, level).

    Candidates are the cell's rows; if none is left those of the domain, then of the bucket, then any: level says
    which, null if no row is left. Of n candidates the one with n // 2 before it is picked. As at most
    len(plan) rows are picked, a pick stands within len(plan) of the middle of its whole group, so only those
    few rows of each group come to the driver; groups are numbered by range, however large.
    """
    levels = {"cell": [domain, bucket], "domain": [domain], "bucket": [bucket], "any": []}
    rows = settled(df.select(*dict.fromkeys([domain, bucket, *order])))  # read for each level more than once
    near: dict[tuple, list] = {}
    size: dict[tuple, int] = {}
    for level, by in levels.items():
        n = rows.groupBy(*by).agg(F.count("*").alias("__n"))
        numbered = number_rows(rows, order, by, "__number")
        d = numbered.join(n, by) if by else numbered.crossJoin(F.broadcast(n))  # one row
        for r in d.where(F.abs(F.col("__number") - F.floor(F.col("__n") / 2)) <= len(plan) + 1).toLocalIterator():
            group = (level, *[r[b] for b in by])
            size[group] = r["__n"]
            near.setdefault(group, []).append((tuple((r[c] is not None, r[c]) for c in order), r["__number"], r[domain], r[bucket]))
    out, picked = [], []
    for d, b in plan:
        choice = None
        for group in (("cell", d, b), ("domain", d), ("bucket", b), ("any",)):
            level = group[0]
            mine = [x for x in picked if (level not in ("cell", "domain") or x[2] == d) and (level not in ("cell", "bucket") or x[3] == b)]
            left = size.get(group, 0) - len(mine)
            if left > 0:  # as many rows stand before it, without those picked already
                free = [x for x in near[group] if all(x[0] != y[0] for y in mine)]
                choice = next(x for x in free if x[1] - sum(y[0] < x[0] for y in mine) == left // 2)
                picked.append(choice)
                break
        out.append((d, b, choice[0][-1][1] if choice else None, level if choice else None))
    return out
