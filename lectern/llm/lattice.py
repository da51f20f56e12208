"""Near-duplicate vectors by E8 lattice hashing with probing of neighbouring cells."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import connected_components, link_forest, mix64, seeds, spill

#: Most vectors of one cell that a task compares at a time; fuller cells go in pairs of blocks.
BLOCK = 1024
TABLES, LATTICES, PROBES, SCALE = 10, 2, 4, 0.48


def decode_e8(x: np.ndarray) -> np.ndarray:
    """Twice the nearest point of the E8 lattice to each row of x (n x 8).

    E8 is the integer points with an even sum, and the same shifted by one half in each component:
    round to either, mend an odd sum at the component with the greatest rounding error, take the nearer.
    """
    best, dist = None, None
    for shift in (0.0, 0.5):
        y = x - shift
        r = np.rint(y)
        err = y - r
        odd = np.flatnonzero(r.sum(1).astype(np.int64) & 1)
        at = np.abs(err[odd]).argmax(1)
        r[odd, at] += np.where(err[odd, at] >= 0, 1.0, -1.0)
        p = r + shift
        d = ((x - p) ** 2).sum(1)
        if best is None:
            best, dist = p, d
        else:
            near = d < dist
            best[near] = p[near]
    return np.rint(2 * best).astype(np.int64)


def _minimal() -> np.ndarray:
    """The 240 shortest vectors of E8: +-e_i +-e_j, and all (+-1/2) with an even number of minus signs."""
    out = []
    for i in range(8):
        for j in range(i + 1, 8):
            for a in (1, -1):
                for b in (1, -1):
                    v = np.zeros(8)
                    v[i], v[j] = a, b
                    out.append(v)
    for m in range(256):
        signs = [1 - 2 * (m >> i & 1) for i in range(8)]
        if signs.count(-1) % 2 == 0:
            out.append(np.array(signs) / 2)
    return np.array(out)


MINIMAL = _minimal()


def cells(unit: np.ndarray, tables: int = TABLES, lattices: int = LATTICES, probes: int = PROBES, scale: float = SCALE) -> np.ndarray:
    """Keys of the home cell and of the `probes` next cells of unit vectors: n x tables x (1 + probes).

    A table projects to `lattices` blocks of 8 dimensions with a fixed Gaussian matrix and joins their
    lattice points. The cells to probe change one block by the shortest vector that costs least.
    """
    n, dim = unit.shape
    rng = np.random.default_rng(20240711)
    out = np.zeros((n, tables, 1 + probes), np.uint64)
    mult = seeds(8 * lattices, 9)
    with np.errstate(over="ignore"):
        for t in range(tables):
            x = (unit @ rng.standard_normal((dim, 8 * lattices))) * scale + rng.random(8 * lattices)
            points, costs = [], []
            for c in range(lattices):
                y = x[:, 8 * c : 8 * c + 8]
                p = decode_e8(y)
                points.append(p)
                costs.append(2 - 2 * (y - p / 2) @ MINIMAL.T)  # how much farther than the home point
            home = np.concatenate(points, 1)
            cost = np.concatenate(costs, 1)
            nearest = np.argsort(cost, axis=1, kind="stable")[:, :probes]

            def key(p, t=t):
                return mix64((p.astype(np.uint64) * mult).sum(1, dtype=np.uint64) + np.uint64(t + 1))

            out[:, t, 0] = key(home)
            for j in range(probes):
                c, v = np.divmod(nearest[:, j], 240)
                moved = home.copy().reshape(n, lattices, 8)
                moved[np.arange(n), c] += np.rint(2 * MINIMAL[v]).astype(np.int64)
                out[:, t, 1 + j] = key(moved.reshape(n, -1))
    return out.view(np.int64)


def _unit(col: pa.ChunkedArray | pa.Array) -> np.ndarray:
    flat = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    v = np.asarray(flat.flatten(), np.float64).reshape(len(flat), -1)
    return v / np.sqrt((v * v).sum(1))[:, None]


def _codes(batches):
    """rep, label, embedding, copies, dim, codes: the keys of a vector's cells, table by table."""
    for batch in batches:
        lengths = np.asarray(pc.list_value_length(batch.column("embedding")), np.int64)
        for dim in np.unique(lengths):
            part = batch.filter(pa.array(lengths == dim))
            for a in range(0, len(part), 4096):
                p = part.slice(a, 4096)
                c = cells(_unit(p.column("embedding")))
                codes = pa.FixedSizeListArray.from_arrays(pa.array(c.ravel()), c.shape[1] * c.shape[2]).cast(pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([*p.columns, pa.array(np.full(len(p), dim, np.int32)), codes], names=[*p.schema.names, "dim", "codes"])


def _collides(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For pairs, tables: whether one's home is the other's home or probe."""
    return (a[:, :, :1] == b).any(2) | (b[:, :, :1] == a).any(2)


def _pairs(sizes: np.ndarray, first: np.ndarray):
    """Pairs of positions i < j within groups of consecutive positions, some thousands at a time."""
    for g in np.unique(sizes):
        i, j = np.triu_indices(g, 1)
        at = first[sizes == g]
        step = max(1, 200_000 // max(1, len(i)))
        for a in range(0, len(at), step):
            base = at[a : a + step, None]
            for z in range(0, len(i), 200_000):
                yield (base + i[z : z + 200_000]).ravel(), (base + j[z : z + 200_000]).ravel()


def _links(threshold: float):
    """A function for mapInArrow over rows sorted by (t, cell, i, j): links counted in those groups.

    A pair counts in the first table where it collides, there at the cell that is its smaller
    vector's home if the other lives in or probes it, else at the other's home. So each link counts
    once over all groups, and no row is made for it: only each vector's count and a spanning forest.
    """

    def of(table: pa.Table) -> pa.RecordBatch:
        rep, home, mult, block = (np.asarray(table.column(c).combine_chunks()) for c in ("rep", "home", "copies", "block"))
        t, cell, bi, bj = (np.asarray(table.column(c).combine_chunks()) for c in ("t", "cell", "i", "j"))
        unit = _unit(table.column("embedding"))
        own = np.asarray(table.column("codes").combine_chunks().flatten()).reshape(len(rep), TABLES, 1 + PROBES)
        gid = _group_starts(table)
        first = np.flatnonzero(gid)
        sizes = np.diff(np.append(first, len(rep)))
        count, starts, ends = np.zeros(len(rep), np.int64), [], []
        for p, q in _pairs(sizes, first):
            ok = (home[p] | home[q]) & ((bi[p] == bj[p]) | (block[p] != block[q]))
            p, q = p[ok], q[ok]
            ok = np.einsum("ij,ij->i", unit[p], unit[q]) >= threshold
            p, q = p[ok], q[ok]
            low = rep[p] < rep[q]
            p, q = np.where(low, p, q), np.where(low, q, p)
            at_t = t[p]
            c = _collides(own[p], own[q])
            at = np.where((own[q, at_t] == own[p, at_t, :1]).any(1), own[p, at_t, 0], own[q, at_t, 0])
            ok = (c.argmax(1) == at_t) & (at == cell[p])
            p, q = p[ok], q[ok]
            count += np.bincount(p, mult[q], len(rep)).astype(np.int64) + np.bincount(q, mult[p], len(rep)).astype(np.int64)
            keep = link_forest(p, q, len(rep)) if len(p) else p
            starts.append(p[keep])
            ends.append(q[keep])
        p, q = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (starts, ends))
        keep = link_forest(p, q, len(rep))
        some = np.flatnonzero(count)
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate([rep[some], rep[p[keep]]])), pa.concat_arrays([pa.array(count[some]), pa.nulls(len(keep), pa.int64())]), pa.concat_arrays([pa.nulls(len(some), pa.int64()), pa.array(rep[q[keep]])])], names=["rep", "n", "other"])

    def run(batches):
        held: list = []
        for batch in batches:
            if not len(batch):
                continue
            held.append(batch)
            table = pa.Table.from_batches(held)
            cut = int(np.flatnonzero(_group_starts(table))[-1])
            if cut >= 2000:
                yield from whole(table.slice(0, cut))
                held = table.slice(cut).combine_chunks().to_batches()
        if held:
            yield from whole(pa.Table.from_batches(held))

    def whole(table: pa.Table):
        dims = np.asarray(table.column("dim").combine_chunks())
        for dim in np.unique(dims):
            yield of(table.filter(pa.array(dims == dim)))

    return run


def _group_starts(table: pa.Table) -> np.ndarray:
    """Whether each row begins a group of equal keys."""
    new = np.zeros(len(table), bool)
    new[0] = True
    for c in ("label", "dim", "t", "cell", "i", "j"):
        v = np.asarray(table.column(c).combine_chunks())
        new[1:] |= v[1:] != v[:-1]
    return new


def near_duplicate_vectors(vectors: DataFrame, threshold: float = 0.93) -> DataFrame:
    """vec_id, n_links (other vectors linked directly), component_id (smallest reachable), kept.

    vectors: vec_id, embedding (array of float or double), label. Vectors link when their labels are
    equal and not null, they have as many components, and their cosine in double precision is at
    least threshold. Vectors that are null, empty, zero or hold null or non-finite components link
    with nothing. Equal vectors of a label collapse first and count as links of each other.

    Rows with a null vec_id are dropped; rows repeating a vec_id give a row each where they differ.
    Candidates come from E8 cells in TABLES tables: of pairs at cosine 0.93, 99 of 100 are found, of
    those above 0.95 all but one in 10,000 (measured in the tests). Cells with more than BLOCK
    vectors are dealt out as pairs of blocks. Other columns are ignored; no rows give no rows.
    """
    v = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"), F.col("label").cast("long").alias("label")).where("vec_id is not null")
    fine = "label is not null and size(embedding) > 0 and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(embedding, x -> x <> 0)"
    v = v.withColumn("fine", F.coalesce(F.expr(f"embedding is not null and {fine}"), F.lit(False))).distinct()
    good = v.where("fine")
    same = good.groupBy("label", "embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"))
    reps = spill(same.select("rep", "label", "embedding", "copies").mapInArrow(_codes, "rep long, label long, embedding array<double>, copies long, dim int, codes array<long>"))
    keys = ["label", "dim", "t", "cell"]
    width = 1 + PROBES
    at = reps.select("rep", "label", "dim", F.posexplode("codes").alias("p", "cell"))
    at = at.select("rep", "label", "dim", F.expr(f"cast(p div {width} as int)").alias("t"), "cell", (F.col("p") % width == 0).alias("home"))
    full = at.groupBy(keys).agg(F.count("*").alias("n"), F.max("home").alias("lived")).where("n > 1 and lived").select(*keys, F.ceil(F.col("n") / BLOCK).cast("long").alias("m"))
    met = at.join(full, keys).withColumn("block", F.when(F.col("m") > 1, F.pmod(F.xxhash64("rep"), F.col("m"))).otherwise(F.lit(0).cast("long")))
    met = met.withColumn("o", F.explode(F.expr("sequence(0L, m - 1)"))).withColumn("i", F.least("block", "o")).withColumn("j", F.greatest("block", "o"))
    rows = met.join(reps.select("rep", "embedding", "copies", "codes"), "rep").select(*keys, "i", "j", "rep", "home", "block", "copies", "embedding", "codes")
    order = [*keys, "i", "j"]
    rows = rows.repartition(*order).sortWithinPartitions(*order)
    found = spill(rows.mapInArrow(_links(threshold), "rep long, n long, other long"))
    comp = connected_components(found.where("other is not null").select(F.col("rep").alias("a"), F.col("other").alias("b")))
    count = found.where("n is not null").groupBy("rep").agg(F.sum("n").alias("n"))
    of = reps.join(count, "rep", "left").join(comp.withColumnRenamed("id", "rep"), "rep", "left")
    of = of.select("label", "embedding", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).cast("long").alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    out = good.select("vec_id", "label", "embedding").join(of, ["label", "embedding"]).select("vec_id", "n_links", "component_id")
    alone = v.where("not fine").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.unionAll(alone).withColumn("kept", F.col("vec_id") == F.col("component_id"))
