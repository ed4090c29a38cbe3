"""Near-duplicate embeddings by a pivot-permutation index.

A bounded sample of vectors serves as reference points (pivots).  Every vector
is described by the pivots nearest to it, in order of nearness.  An inverted
list per label and pivot holds the vectors that have the pivot among their
first few; two vectors are a candidate pair if they meet in such a list and
their longer prefixes share enough pivots.  Candidates are verified by their
cosine in double precision.  A pair that meets in several lists is counted in
that of their smallest common pivot only.

The index covers every vector; only the choice of pivots uses a sample.  Equal
vectors are one entry with a weight, so copies never meet each other.  A list
too long for a task is cut into blocks, and every pair of blocks is a unit of
work of its own; units give back link counts and a spanning star per class, so
pairs are never written out.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reitlens.llm.common import connected, release, ship, sized, stored

MIN_COSINE = 0.93
#: Vectors looked at to choose pivots, and bounds of the number of pivots: one for so many vectors of the largest label.
SAMPLE, FEWEST, MOST, PER_PIVOT = 4096, 64, 2048, 64
#: Inverted lists that hold a vector, length of the described prefix, and shared pivots that a candidate needs.
LISTS, PREFIX, SHARED = 4, 16, 5
#: Entries of a list in a unit of work (some 5 MB a side), and pairs looked at together.
BLOCK, TILE = 1 << 14, 1 << 10
NODE_BYTES = 16


def matrix(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(values one after another as double, offsets, usable): a vector is usable unless it is null, empty, zero or holds a null or non-finite component."""
    size = np.asarray(column.value_lengths().fill_null(0)).astype(np.int64)
    offsets = np.concatenate([[0], np.cumsum(size)])
    flat = column.flatten()
    values = flat.cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False)
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(values))])
    some = np.concatenate([[0], np.cumsum(values != 0)])
    ok = (bad[offsets[1:]] == bad[offsets[:-1]]) & (some[offsets[1:]] > some[offsets[:-1]])
    return values, offsets, ok


class Pivots:
    """Unit reference vectors by dimension, numbered through."""

    def __init__(self, vectors: list[np.ndarray], most: int, apart: float = MIN_COSINE):
        """The first vectors of each dimension in turn, up to ``most`` in all, none closer than ``apart`` to one before it."""
        chosen: dict[int, list[np.ndarray]] = {}
        left = most
        for v in vectors:
            if not left:
                break
            u = unit(v[None])[0]
            mine = chosen.setdefault(len(v), [])
            if not mine or np.max(np.stack(mine) @ u) < apart:
                mine.append(u)
                left -= 1
        self.by_size, number = {}, 0
        for size, rows in sorted(chosen.items()):
            self.by_size[size] = (number, np.stack(rows).astype(np.float32))
            number += len(rows)

    def describe(self, rows: np.ndarray, lists: int = LISTS, prefix: int = PREFIX) -> tuple[np.ndarray, np.ndarray]:
        """(lists, prefix) of the vectors ``rows`` of one dimension: numbers of the nearest pivots in order, -1 where there are no more.

        Vectors of a dimension that the sample has not met all share the list numbered below zero by the dimension.
        """
        out = np.full((len(rows), prefix), -1, np.int16)
        first, pivots = self.by_size.get(rows.shape[1], (0, None))
        if pivots is None:
            names = np.full((len(rows), lists), -1, np.int32)
            names[:, 0] = -1 - rows.shape[1]
            return names, out
        nearness = unit(rows).astype(np.float32) @ pivots.T
        k = min(prefix, len(pivots))
        near = np.argpartition(-nearness, k - 1, axis=1)[:, :k]
        near = np.take_along_axis(near, np.argsort(-np.take_along_axis(nearness, near, 1), axis=1, kind="stable"), 1) + first
        out[:, :k] = near
        names = np.full((len(rows), lists), -1, np.int32)
        names[:, :min(lists, k)] = near[:, :lists]
        return names, out

    def shared(self, size: int, wanted: int = SHARED) -> int:
        """Shared pivots that a candidate pair needs: none but the list's own while prefixes are a large part of all pivots."""
        return wanted if size in self.by_size and len(self.by_size[size][1]) >= FEWEST else 0


def unit(rows: np.ndarray) -> np.ndarray:
    """Rows scaled to length one (by the largest component first, so that squares neither overflow nor vanish)."""
    rows = rows / np.max(np.abs(rows), axis=1, keepdims=True)
    return rows / np.sqrt(np.einsum("ij,ij->i", rows, rows))[:, None]


def node_of(label, values: np.ndarray) -> bytes:
    """Name of all equal vectors of a label (128 bits of BLAKE2; minus zero is zero)."""
    return hashlib.blake2b(f"{label}:".encode() + (values + 0.0).tobytes(), digest_size=NODE_BYTES).digest()


def described(vectors: DataFrame, pivots, payload: bool) -> DataFrame:
    """(vec_id, label, node, lists[, payload]) of (vec_id, label, vector); the payload is node, prefix and vector in one binary.

    Rows that link with nothing have a null node.
    """
    ids = vectors.schema["vec_id"].dataType.simpleString()

    def run(batches):
        index = pivots.value
        for batch in batches:
            for s in range(0, batch.num_rows, TILE):
                b = batch.slice(s, TILE)
                values, offsets, ok = matrix(b.column("vector"))
                label = b.column("label").to_pylist()
                ok &= np.array([x is not None for x in label], bool)
                node, data, lists = [None] * b.num_rows, [None] * b.num_rows, [None] * b.num_rows
                size = np.diff(offsets)
                for d in np.unique(size[ok]).tolist():
                    at = np.flatnonzero(ok & (size == d))
                    rows = values[offsets[at][:, None] + np.arange(d)]
                    names, prefix = index.describe(rows)
                    for i, row, x, p in zip(at.tolist(), rows, names, prefix):
                        node[i] = node_of(label[i], row)
                        lists[i] = x[x != -1].tolist()
                        if payload:
                            data[i] = node[i] + p.tobytes() + row.astype(np.float32 if single else np.float64).tobytes()
                cols = {"vec_id": b.column("vec_id"), "label": b.column("label"), "node": pa.array(node, pa.binary()), "lists": pa.array(lists, pa.list_(pa.int32()))}
                if payload:
                    cols["payload"] = pa.array(data, pa.binary())
                yield pa.RecordBatch.from_pydict(cols)

    single = is_single(vectors)
    return vectors.select("vec_id", "label", "vector").mapInArrow(run, f"vec_id {ids}, label string, node binary, lists array<int>" + (", payload binary" if payload else ""))


def is_single(vectors: DataFrame) -> bool:
    return vectors.schema["vector"].dataType.elementType.typeName() == "float"


def unpack(payload: list[bytes], single: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(nodes, prefixes, unit vectors) of distinct entries of one dimension."""
    flat = np.frombuffer(b"".join(payload), np.uint8).reshape(len(payload), -1)
    node = np.ascontiguousarray(flat[:, :NODE_BYTES]).view(f"V{NODE_BYTES}").ravel()
    prefix = np.ascontiguousarray(flat[:, NODE_BYTES:NODE_BYTES + 2 * PREFIX]).view(np.int16)
    rows = np.ascontiguousarray(flat[:, NODE_BYTES + 2 * PREFIX:]).view(np.float32 if single else np.float64).astype(np.float64)
    return node, prefix, unit(rows)


def candidates(a: np.ndarray, b: np.ndarray, pivot: int, needed: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of the prefixes ``a`` and ``b`` that share ``needed`` pivots, and none below ``pivot`` among their first ``LISTS``.

    The prefixes are inverted: every pivot adds one to the count of the pairs that both have it.
    """
    if needed:
        count = np.zeros((len(a), len(b)), np.uint8)
        for rows, columns in zip(*(inverted(x, np.intersect1d(a, b)) for x in (a, b))):
            count[np.ix_(rows, columns)] += 1
        i, j = np.nonzero(count >= needed)
    else:
        i, j = (x.ravel() for x in np.indices((len(a), len(b))))
    earlier = np.zeros(len(i), bool)
    for x in range(min(LISTS, a.shape[1])):
        mine = a[i, x]
        lower = (mine >= 0) & (mine < pivot)
        for y in range(min(LISTS, b.shape[1])):
            earlier |= lower & (mine == b[j, y])
    return i[~earlier], j[~earlier]


def inverted(prefix: np.ndarray, pivots: np.ndarray) -> list[np.ndarray]:
    """Rows of ``prefix`` that have each of the sorted ``pivots``."""
    pivots = pivots[pivots >= 0]
    flat = prefix.ravel()
    order = np.argsort(flat, kind="stable")
    ends = np.searchsorted(flat[order], [pivots, pivots + 1])
    row = order // prefix.shape[1]
    return [row[s:e] for s, e in ends.T.tolist()]


def unit_links(pivot: int, left: tuple, right: tuple | None, weight_left: np.ndarray, weight_right: np.ndarray, needed: int, least: float) -> tuple[np.ndarray, np.ndarray]:
    """(linked weight, root) of the entries of left then right: verified links counted, and the smallest entry of each class."""
    own = right is None
    other = left if own else right
    n, shift = len(left[0]), 0 if own else len(left[0])
    weight = weight_left if own else np.concatenate([weight_left, weight_right])
    links = np.zeros(len(weight), np.int64)
    root = np.arange(len(weight))
    for s in range(0, n, TILE):
        for t in range(s if own else 0, len(other[0]), TILE):
            i, j = candidates(left[1][s:s + TILE], other[1][t:t + TILE], pivot, needed)
            i, j = i + s, j + t
            if own:
                later = i < j
                i, j = i[later], j[later]
            for c in range(0, len(i), 1 << 16):
                x, y = i[c:c + (1 << 16)], j[c:c + (1 << 16)]
                near = np.einsum("ij,ij->i", left[2][x], other[2][y]) >= least
                x, y = x[near], y[near] + shift
                np.add.at(links, x, weight[y])
                np.add.at(links, y, weight[x])
                root = united(root, x, y)
    return links, root


def united(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``root`` (smallest place per class) after also uniting the pairs a, b."""
    while True:
        ra, rb = root[a], root[b]
        apart = ra != rb
        if not apart.any():
            return root
        a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
        while (root[root] != root).any():
            root = root[root]


def choose_pivots(vectors: DataFrame, largest: int, total: int) -> Pivots:
    """Pivots from at most ``SAMPLE`` distinct vectors, those with the smallest hashes; their number grows with the largest label."""
    share = min(1.0, 4.0 * SAMPLE / max(total, 1))
    hash_ = F.xxhash64(F.lit(7), "vector")
    some = vectors.where(F.col("label").isNotNull() & (F.size("vector") > 0)).select("vector", hash_.alias("h"))
    some = some.where(F.pmod("h", F.lit(1 << 30)) <= int(share * (1 << 30))).groupBy("h").agg(F.first("vector").alias("vector"))
    rows = some.orderBy("h").limit(SAMPLE).select("vector").toArrow()
    values, offsets, ok = matrix(rows.column("vector").combine_chunks()) if rows.num_rows else (np.zeros(0), np.zeros(1, int), np.zeros(0, bool))
    return Pivots([values[offsets[i]:offsets[i + 1]] for i in np.flatnonzero(ok)], int(np.clip(largest // PER_PIVOT, FEWEST, MOST)))


def linked(vectors: DataFrame, least: float = MIN_COSINE) -> tuple[DataFrame, DataFrame]:
    """Of (vec_id, label, vector): the rows with the node of each (null: links with nothing), and (node, n, n_linked, component, first_id) of nodes that have links or copies."""
    spark = vectors.sparkSession
    ship(spark)
    sizes = vectors.groupBy("label").count().agg(F.max("count"), F.sum("count")).first()
    pivots = spark.sparkContext.broadcast(choose_pivots(vectors, sizes[0] or 0, sizes[1] or 0))
    rows = stored(described(vectors, pivots, payload=False).select("vec_id", "node", "label", "lists"), "pivot-rows")
    nodes = rows.where("node is not null").groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.min("vec_id").alias("first_id"), F.first("label").alias("label"), F.first("lists").alias("lists"))
    nodes = stored(nodes, "pivot-nodes")
    long = stored(nodes.select("label", F.explode("lists").alias("pivot")).groupBy("label", "pivot").count().where(F.col("count") > BLOCK)
                  .select("label", "pivot", F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks")), "pivot-long-lists")

    # rows whose hash is alone are entries as they are; those of repeated hashes become one entry per vector
    mark = F.xxhash64("label", "vector")
    several = stored(vectors.groupBy(mark.alias("mark")).count().where("count > 1").select("mark"), "pivot-several")
    marked, several = vectors.withColumn("mark", mark), sized(several)
    alone = described(marked.join(several, "mark", "left_anti"), pivots, True).select("label", "lists", "payload", F.lit(1).cast("long").alias("n"))
    copies = described(marked.join(several, "mark", "left_semi"), pivots, True).groupBy("node").agg(
        F.first("label").alias("label"), F.first("lists").alias("lists"), F.first("payload").alias("payload"), F.count(F.lit(1)).alias("n"))
    entries = alone.unionByName(copies.select("label", "lists", "payload", "n")).where("payload is not null")
    placed = entries.select("label", F.explode("lists").alias("pivot"), "payload", "n")
    units = in_units(placed.join(sized(long), ["label", "pivot"], "left"))
    found = stored(units.groupBy("label", "pivot", "lo", "hi").applyInArrow(unit_join(pivots, is_single(vectors), least), "node binary, n_linked long, root binary"), "pivot-links")
    release(spark)

    edges = found.where("node <> root").select("node", "root").distinct()
    comp = stored(connected(edges, "node", "root"), "pivot-components") if not edges.isEmpty() else None
    total = found.groupBy("node").agg(F.sum("n_linked").alias("n_linked"))
    if comp is not None:
        total = total.join(comp, "node", "left")
    else:
        total = total.withColumn("component", F.lit(None).cast("binary"))
    both = nodes.select("node", "n", "first_id").join(total, "node", "left").where("n > 1 or n_linked is not null")
    out = stored(both.select("node", "n", F.coalesce("n_linked", F.lit(0)).alias("n_linked"), F.coalesce("component", "node").alias("component"), "first_id"), "pivot-linked")
    pivots.destroy()
    return rows, out


def in_units(placed: DataFrame) -> DataFrame:
    """Entries with the units (label, pivot, lo, hi) that they take part in: their own block with every block of the list."""
    g = F.coalesce("blocks", F.lit(1))
    own = F.pmod(F.xxhash64("payload"), g).cast("int")
    cut = placed.select("label", "pivot", "payload", "n", own.alias("own"), F.explode(F.sequence(F.lit(0), g - 1)).alias("with"))
    return cut.select("label", "pivot", F.least("own", "with").alias("lo"), F.greatest("own", "with").alias("hi"), "own", "payload", "n")


def unit_join(pivots, single: bool, least: float):
    """The function of a unit: its table of entries to (node, n_linked, root) of those with links."""
    def join(key, table):
        _, pivot, lo, hi = (k.as_py() for k in key)
        own, n = (np.asarray(table.column(c).combine_chunks()) for c in ("own", "n"))
        payload = table.column("payload").to_pylist()
        out = {"node": pa.array([], pa.binary()), "n_linked": pa.array([], pa.int64()), "root": pa.array([], pa.binary())}
        at = [np.flatnonzero(own == k) for k in ([lo] if lo == hi else [lo, hi])]
        if any(len(i) == 0 for i in at):
            return pa.table(out)
        sides = [unpack([payload[i] for i in side], single) for side in at]
        needed = pivots.value.shared(sides[0][2].shape[1])
        links, root = unit_links(pivot, sides[0], sides[1] if lo != hi else None, n[at[0]], n[at[-1]], needed, least)
        name = np.concatenate([s[0] for s in sides])
        some = np.flatnonzero(links)
        if len(some):
            out = {"node": pa.array([x.tobytes() for x in name[some]], pa.binary()), "n_linked": pa.array(links[some]), "root": pa.array([x.tobytes() for x in name[root[some]]], pa.binary())}
        return pa.table(out)
    return join


def classes(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", least: float = MIN_COSINE) -> DataFrame:
    """(vec_id, n_links, component_id, kept), a row per row of ``vectors``.

    Rows are linked if their labels are equal and not null and the cosine of
    their vectors is ``least`` or more; a vector that is null, empty, zero or
    holds a null or non-finite component links with nothing, as do vectors of
    different dimensions.  Repeated rows and equal vectors are linked with each
    other.  ``component_id`` is the smallest id reachable (a null id is larger
    than any other), ``kept`` whether the row's own id is that.  Other columns are
    not read.  An empty table gives an empty result.
    """
    src = vectors.select(F.col(vec_id).alias("vec_id"), F.col(label).cast("string").alias("label"), F.col(vector).alias("vector"))
    rows, found = linked(src, least)
    lowest = found.groupBy("component").agg(F.min("first_id").alias("component_id"))
    named = found.join(lowest, "component").select("node", (F.col("n") - 1 + F.col("n_linked")).alias("n_links"), "component_id")
    out = rows.select("vec_id", "node").join(sized(stored(named, "pivot-named")), "node", "left")
    component = F.when(F.col("n_links").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), _same("vec_id", component).alias("kept"))


def _same(column: str, other: Column) -> Column:
    return F.col(column).eqNullSafe(other)
