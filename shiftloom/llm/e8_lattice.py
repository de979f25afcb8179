"""Embedding near-duplicates by E8 lattice hashing (op2).

Vectors of length 1 are projected at random to ``BLOCKS`` times eight coordinates in each of ``TABLES`` tables, and
each eight are decoded to the nearest point of the E8 lattice. The points together are the vector's home cell;
it also visits the ``PROBES`` neighbouring cells got by moving the points to their next nearest ones. Rows that
meet, at least one of them at home, are sifted by the signs of further projections, and what is left is compared
by cosine in double precision.

Equal vectors are one node with a size. Cells name nodes and their signs; vectors are fetched only for nodes that
have a partner after the sifting. A pair can meet in many cells; it counts in the first: least table, then least cell,
worked out from both vectors. A task gives out counts and, for components, each node with the least one it is
connected to there, never pairs. A cell with very many nodes is dealt out to pairs of its blocks.

Null vectors, zero vectors and those with null or non-finite components link with nothing; vectors of different
lengths don't link. A null vec_id can't name a component unless no other is there. Repeated rows: nodes with
that size. Empty table: no rows. Columns other than vec_id and embedding are not read.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batch_of, read_table, write_shared
from .components import components, unite
from .simhash_trie import distance, expand, mix, split_by

TABLES, BLOCKS, PROBES, COSINE, SEED = 12, 2, 8, 0.9, 8
#: Root mean square distance, in the lattice, of the projections of two vectors at the least cosine.
REACH = 0.6
HOT_CELL = 4096
#: Vectors whose cells are worked out at once: all their distances to lattice neighbours are held.
ROWS = 512
#: Signs of so many projections go along with a cell's rows. Pairs that differ in more than ``SIGNS_APART`` aren't
#: compared; at the least cosine 18 differ on average, with a deviation of 4, and 64 between unrelated vectors.
SIGNS, SIGNS_APART = 128, 42


@functools.cache
def projections(dim: int, cosine: float = COSINE) -> np.ndarray:
    scale = REACH / np.sqrt(8 * (2 - 2 * cosine))
    return np.random.default_rng((SEED, dim)).standard_normal((dim, TABLES * BLOCKS * 8)) * scale


def _nearest_d8(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest point with an even sum, and the rounding error of each coordinate."""
    point = np.rint(x)
    error = x - point
    odd = point.sum(-1).astype(np.int64) & 1 == 1
    worst = np.abs(error).argmax(-1)
    rows = np.flatnonzero(odd)
    w = worst[rows]
    point[rows, w] += np.where(error[rows, w] >= 0, 1, -1)
    return point, x - point


def decode(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(twice the nearest E8 point as integers, x less that point) for rows of eight."""
    a, ea = _nearest_d8(x)
    b, eb = _nearest_d8(x - 0.5)
    nearer = (eb**2).sum(-1) < (ea**2).sum(-1)
    point = np.where(nearer[:, None], 2 * b + 1, 2 * a).astype(np.int64)
    return point, np.where(nearer[:, None], eb, ea)


@functools.cache
def roots() -> np.ndarray:
    """The 240 shortest vectors, doubled."""
    out = [[2 * s if k == i else 2 * t if k == j else 0 for k in range(8)] for i in range(8) for j in range(i) for s in (1, -1) for t in (1, -1)]
    out += [[1 if m >> k & 1 else -1 for k in range(8)] for m in range(256) if (8 - bin(m).count("1")) % 2 == 0]
    return np.array(out, np.int64)


def cell_keys(unit: np.ndarray, cosine: float = COSINE) -> tuple[np.ndarray, np.ndarray]:
    """(home cells (rows, TABLES), visited cells (rows, TABLES, PROBES)) as 64-bit keys, some rows at a time."""
    parts = [_cell_keys(unit[at : at + ROWS], cosine) for at in range(0, len(unit), ROWS)]
    return np.concatenate([h for h, _ in parts]), np.concatenate([v for _, v in parts])


def _cell_keys(unit: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    n, dim = unit.shape
    x = (unit @ projections(dim, cosine)).reshape(-1, 8)
    point, rest = decode(x)
    each = PROBES // BLOCKS
    # A root r brings the point nearer to x the larger rest.r is (all roots are equally long).
    near = rest @ (roots().T / 2)
    best = np.argpartition(-near, each, axis=1)[:, :each]
    coefficients = np.random.default_rng(SEED + 1).integers(0, 1 << 62, (BLOCKS, 8), np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
    point = point.reshape(n, TABLES, BLOCKS, 8).astype(np.uint64)
    table = mix(np.arange(1, TABLES + 1, dtype=np.uint64) + np.uint64(dim << 8))[None, :]
    sums = (point * coefficients).sum(-1, dtype=np.uint64)  # (n, tables, blocks)
    total = sums.sum(-1, dtype=np.uint64)
    moved = roots()[best].reshape(n, TABLES, BLOCKS, each, 8).astype(np.uint64)
    step = (moved * coefficients[:, None, :]).sum(-1, dtype=np.uint64)
    visits = (total[:, :, None, None] + step).reshape(n, TABLES, PROBES)
    return mix(total ^ table), mix(visits ^ table[:, :, None])


def meet(one_home, one_visits, two_home, two_visits) -> tuple[np.ndarray, np.ndarray]:
    """Whether pairs meet in a table, and the least cell where they do."""
    at_two = (one_visits == two_home[:, None]).any(1)
    at_one = (two_visits == one_home[:, None]).any(1)
    same = one_home == two_home
    top = np.uint64(0xFFFFFFFFFFFFFFFF)
    cell = np.where(same, one_home, np.minimum(np.where(at_one, one_home, top), np.where(at_two, two_home, top)))
    return same | at_one | at_two, cell


def matrix_of(column: pa.Array) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    x = values.reshape(len(column), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # so that no square is too large or too small
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def signs(unit: np.ndarray) -> np.ndarray:
    """(rows, 2) words of the signs of ``SIGNS`` projections."""
    draw = np.random.default_rng((SEED + 2, unit.shape[1])).standard_normal((unit.shape[1], SIGNS))
    return np.packbits(unit @ draw > 0, axis=1).view(np.int64)


CELLS = pa.schema([("cell", pa.int64()), ("tbl", pa.int16()), ("home", pa.bool_()), ("node", pa.int64()), ("s0", pa.int64()), ("s1", pa.int64())])
CELLS_DDL = "cell long, tbl short, home boolean, node long, s0 long, s1 long"
SIFTED_DDL = "cell long, pair int, tbl short, home boolean, node long, block int"
FOUND = pa.schema([("node", pa.int64()), ("links", pa.int64()), ("root", pa.int64())])


def by_dimension(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    sizes = pc.fill_null(pc.list_value_length(batch.column(batch.schema.get_field_index(column))), 0).to_numpy(zero_copy_only=False)
    for size in np.unique(sizes):
        if size:
            yield batch.take(pa.array(np.flatnonzero(sizes == size)))


def by_cell(batches: Iterator[pa.RecordBatch], work: Callable[[pa.Table], Iterator[pa.RecordBatch]], enough: int = 16384) -> Iterator[pa.RecordBatch]:
    """``work`` on whole cells (rows sorted by the first two columns), some ``enough`` rows at a time."""
    waiting: list[pa.RecordBatch] = []
    size = 0
    for whole in batches:
        for at in range(0, len(whole), 2048):
            part = whole.slice(at, 2048)
            if size >= enough:
                last = [waiting[-1].column(c)[len(waiting[-1]) - 1].as_py() for c in (0, 1)]
                new = np.flatnonzero((part.column(0).to_numpy() != last[0]) | (part.column(1).to_numpy() != last[1]))
                if len(new):
                    stop = int(new[0])
                    yield from work(pa.Table.from_batches([*waiting, part.slice(0, stop)]))
                    part, waiting, size = part.slice(stop), [], 0
            waiting.append(part)
            size += len(part)
    if size:
        yield from work(pa.Table.from_batches(waiting))


def cell_order(cell: np.ndarray, pair: np.ndarray, home: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order of the rows: cell by cell, homes first; first row and end of each cell)."""
    order = np.lexsort((node, ~home, pair, cell))
    cell, pair = cell[order], pair[order]
    new = np.flatnonzero(np.concatenate([[True], (cell[1:] != cell[:-1]) | (pair[1:] != pair[:-1])]))
    return order, new, np.append(new[1:], len(cell))


def candidate_pairs(home: np.ndarray, node: np.ndarray, block: np.ndarray, new: np.ndarray, end: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows that meet, a part at a time: each home with every later row of its cell (homes come first). In a
    pair of two blocks, only rows of different ones."""
    across = np.repeat(np.maximum.reduceat(block, new) != np.minimum.reduceat(block, new), end - new)
    start = np.flatnonzero(home)
    stop = np.repeat(end, np.add.reduceat(home.astype(np.int64), new))
    for some in split_by(np.arange(len(start)), stop - start, 1 << 15):
        a, b = expand(start[some], start[some] + 1, start[some] + 1, stop[some])
        keep = (node[a] != node[b]) & (~across[a] | (block[a] != block[b]))
        yield a[keep], b[keep]


def find_links(nodes: DataFrame, cosine: float = COSINE, hot_cell: int = HOT_CELL) -> DataFrame:
    """(node, links, root) in parts: links (sizes of linked nodes, each pair counted in one part) and a connected node."""
    spark = nodes.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, len(whole), 1024):
                for batch in by_dimension(whole.slice(at, 1024), "embedding"):
                    unit = matrix_of(batch.column(batch.schema.get_field_index("embedding")))
                    home, visits = cell_keys(unit, cosine)
                    node = batch.column(batch.schema.get_field_index("node")).to_numpy()
                    sign = signs(unit)
                    table = np.broadcast_to(np.arange(TABLES, dtype=np.int16), home.shape).ravel()
                    for keys, each, at_home in ((home, 1, True), (visits, PROBES, False)):
                        many = TABLES * each
                        yield batch_of(CELLS, keys.ravel().view(np.int64), np.repeat(table, each), np.full(keys.size, at_home), np.repeat(node, many), np.repeat(sign[:, 0], many), np.repeat(sign[:, 1], many))

    cells = write_shared(nodes.select("node", "embedding").mapInArrow(place, CELLS_DDL), "cells")
    hot = write_shared(cells.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > hot_cell), "hot-cells")
    if hot.isEmpty():
        rows = cells.withColumn("block", F.lit(0)).withColumn("pair", F.lit(0))
    else:
        blocks = F.coalesce(F.ceil(F.col("n") / hot_cell), F.lit(1)).cast("int")
        rows = cells.join(hot, "cell", "left").withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
        rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        rows = rows.withColumn("pair", F.least("block", "other") * F.col("blocks") + F.greatest("block", "other"))
    rows = rows.select("cell", "pair", "tbl", "home", "node", "block", "s0", "s1").repartition(parts, "cell", "pair").sortWithinPartitions("cell", "pair")

    def sift_rows(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        cell, pair, table, home, node, block, s0, s1 = (rows.column(i).to_numpy() for i in range(8))
        order, new, end = cell_order(cell, pair, home, node)
        sign = np.column_stack([s0, s1])[order]
        alive = np.zeros(len(cell), bool)
        for a, b in candidate_pairs(home[order], node[order], block[order], new, end):
            near = distance(sign[a], sign[b]) <= SIGNS_APART
            alive[a[near]] = alive[b[near]] = True
        left = rows.select(range(6)).take(pa.array(order[alive])).combine_chunks()
        yield from left.to_batches()

    sifted = rows.mapInArrow(lambda batches: by_cell(batches, sift_rows), SIFTED_DDL)
    rows = sifted.join(nodes.select("node", "size", "embedding"), "node")

    def links_in(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        # A key might stand for cells of two dimensions; these are taken apart.
        for batch in by_dimension(rows.combine_chunks().to_batches()[0], "embedding"):
            unit = matrix_of(batch.column(7))
            cell, pair, table, home, node, block, weight = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(7))
            order, new, end = cell_order(cell, pair, home, node)
            unit, cell, table, home, node, block, weight = (x[order] for x in (unit, cell, table, home, node, block, weight))
            distinct, which = np.unique(node, return_inverse=True)
            parent, links = np.arange(len(distinct)), np.zeros(len(distinct), np.int64)
            first_of = np.zeros(len(distinct), np.int64)
            first_of[which] = np.arange(len(node))
            home_keys, visit_keys = cell_keys(unit[first_of], cosine)
            for a, b in candidate_pairs(home, node, block, new, end):
                near = np.einsum("ij,ij->i", unit[a], unit[b]) >= cosine
                a, b = a[near], b[near]
                i, j = which[a], which[b]
                parent = unite(parent, i, j)
                # The pair counts here only if it meets in no lesser table, nor in a lesser cell of this one.
                own = table[a]
                for t in range(int(own.max(initial=-1)) + 1):
                    met_here, least = meet(home_keys[i, t], visit_keys[i, t], home_keys[j, t], visit_keys[j, t])
                    counts = np.where(own > t, ~met_here, (own < t) | (least == cell[a].view(np.uint64)))
                    a, b, i, j, own = a[counts], b[counts], i[counts], j[counts], own[counts]
                np.add.at(links, i, weight[b])
                np.add.at(links, j, weight[a])
            linked = np.flatnonzero((links > 0) | (parent != np.arange(len(distinct))))
            yield batch_of(FOUND, distinct[linked], links[linked], distinct[parent[linked]])

    ordered = rows.select("cell", "pair", "tbl", "home", "node", "block", "size", "embedding").repartition(parts, "cell", "pair").sortWithinPartitions("cell", "pair")
    return ordered.mapInArrow(lambda batches: by_cell(batches, links_in), "node long, links long, root long")


def near_vectors(vectors: DataFrame, cosine: float = COSINE, hot_cell: int = HOT_CELL) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of ``vectors`` (vec_id, embedding)."""
    vectors = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    some = F.exists("embedding", lambda x: x != 0)
    sound = F.coalesce(finite & some, F.lit(False))
    named = vectors.withColumn("node", F.when(sound, F.xxhash64("embedding"))).withColumn("check", F.when(sound, F.xxhash64(F.lit(1), "embedding")))
    nodes = write_shared(
        named.where("node IS NOT NULL").groupBy("node", "check").agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("size"), F.first("embedding").alias("embedding")), "vectors"
    )
    found = write_shared(find_links(nodes, cosine, hot_cell), "vector-links")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    groups = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    rooted = nodes.select("node", "check", "least", "size").join(links, "node", "left").join(groups, "node", "left").withColumn("root", F.coalesce("root", "node"))
    names = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    answers = rooted.join(names, "root").select("node", "check", (F.col("size") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id")
    out = named.select("vec_id", "node", "check").join(answers, ["node", "check"], "left")
    component = F.coalesce(F.col("component_id"), F.col("vec_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), component.eqNullSafe(F.col("vec_id")).alias("kept"))


def op2_e8_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(read_table(spark, sf_dir, "embeddings"))
