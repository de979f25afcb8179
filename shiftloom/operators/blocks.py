"""Work on pairs of vectors, dealt by pairs of blocks: a task multiplies two matrices of at most ``BLOCK`` rows or so,
whatever the size of a group, and gives out sums or best partners, never pairs. Where all pairs of a group are needed
(``against_all``), a block is one row and tasks read parts of the table of blocks, so what is moved doesn't grow with the
number of pairs."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .sums import DDL, blocks_of, merged, placed

BLOCK = 1024


def block_pairs(rows: DataFrame, keys: list[str], item: str, block: int = BLOCK) -> DataFrame:
    """Every row of a group once as left and once as right (``side`` 0, 1) of each pair of blocks (``bi``, ``bj``)."""
    sizes = rows.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
    placed = (rows.join(sizes, keys) if keys else rows.crossJoin(F.broadcast(sizes))).withColumn("own", F.pmod(F.xxhash64(item), F.col("blocks")).cast("int"))
    each = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("side", F.explode(F.array(F.lit(0), F.lit(1))))
    left = F.col("side") == 0
    return each.withColumn("bi", F.when(left, F.col("own")).otherwise(F.col("other"))).withColumn("bj", F.when(left, F.col("other")).otherwise(F.col("own"))).drop("blocks", "own", "other")


def matrix(table: pa.Table, column: str = "vec") -> np.ndarray:
    values = table.column(column).combine_chunks()
    return values.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(values), -1)


def sides(table: pa.Table) -> tuple[pa.Table, pa.Table]:
    side = table.column("side").to_numpy()
    return table.take(np.flatnonzero(side == 0)), table.take(np.flatnonzero(side == 1))


def over_blocks(pairs: DataFrame, keys: list[str], work: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    """``work`` on (left, right) of each pair of blocks."""

    def run(table: pa.Table) -> pa.Table:
        return work(*sides(table))

    return pairs.groupBy(*keys, "bi", "bj").applyInArrow(run, schema)


#: Bytes of vectors that a task meets as its right side, and cells of a product that are worked on at a time.
HELD, CELLS = 1 << 26, 1 << 19


def packed(rows: DataFrame, keys: list[str], item: str, block: int) -> DataFrame:
    """(keys, block, data): the rows of a group in blocks of about ``block`` by hash, each block as one row of bytes."""
    sizes = rows.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("_blocks"))
    placed = (rows.join(sizes, keys) if keys else rows.crossJoin(F.broadcast(sizes))).withColumn("block", F.pmod(F.xxhash64(item), F.col("_blocks")).cast("int")).drop("_blocks")
    names = [c for c in rows.columns if c not in keys]
    schema = ", ".join([*(f"{k} {rows.schema[k].dataType.simpleString()}" for k in keys), "block int, data binary"])

    def run(table: pa.Table) -> pa.Table:
        inner, sink = table.select(names).combine_chunks(), pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, inner.schema) as out:
            out.write_table(inner)
        return pa.table({c: table.column(c).slice(0, 1) for c in [*keys, "block"]} | {"data": pa.array([sink.getvalue().to_pybytes()], pa.binary())})

    return placed.groupBy(*keys, "block").applyInArrow(run, schema)


def opened(data: pa.BinaryScalar) -> pa.Table:
    return pa.ipc.open_stream(data.as_buffer()).read_all()


def parts_of(rows: DataFrame, block: int, held: int) -> tuple[int, int]:
    """How many parts the left and the right side of all pairs of ``rows`` (.., vec) have: right ones of ``held`` bytes, and as many left
    ones as give each task some pairs."""
    many, dims = rows.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("vec")), F.lit(0))).first()
    right = max(1, -(-many * max(1, dims) * 8 // held))
    return max(1, min(-(-many // block), -(-2 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")) // right))), right


def against_all(rows: DataFrame, keys: list[str], item: str, start: Callable[[pa.Table], object], schema: str, parts: tuple[int, int], block: int) -> DataFrame:
    """What each block of ``rows`` makes of all blocks of its group: ``start(left)`` meets them by ``add(right)`` and gives ``result()``,
    a table of ``schema``, once for each right part. Blocks are moved once to either side; a task then reads one part of either
    (a product of partitions), so nothing is copied by the number of blocks."""
    blocks = packed(rows, keys, item, block)
    left = blocks.withColumnRenamed("data", "left").repartition(parts[0])
    right = blocks.select(*keys, F.col("data").alias("right")).repartition(parts[1]).hint("shuffle_replicate_nl")
    pairs = (left.join(right, keys) if keys else left.crossJoin(right)).select(*keys, "block", "left", "right")
    many = len(keys) + 1
    fields = [f"{k} {rows.schema[k].dataType.simpleString()}" for k in keys]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None

        def result() -> Iterator[pa.RecordBatch]:
            out = state.result()
            held = [pa.repeat(k, len(out)) for k in now[:-1]]
            yield from pa.table([*held, *out.columns], names=[*keys, *out.column_names]).to_batches(1 << 14)

        for batch in batches:
            for k in range(len(batch)):
                own = [batch.column(c)[k] for c in range(many)]
                if now is None or own != now:
                    if now is not None:
                        yield from result()
                    now, state = own, start(opened(batch.column(many)[k]))
                state.add(opened(batch.column(many + 1)[k]))
        if now is not None:
            yield from result()

    return pairs.mapInArrow(run, ", ".join([*fields, schema]))


def of_same(left: np.ndarray, right: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (left, right) of equal items, those of the first, second, .. equal one on the right."""
    order = np.argsort(right, kind="stable")
    first, last = (np.searchsorted(right[order], left, side) for side in ("left", "right"))
    for k in range(int((last - first).max(initial=0))):
        rows = np.flatnonzero(last - first > k)
        yield rows, order[first[rows] + k]


class Distances:
    """Sums of the Euclidean distances of a block's vectors to each model's."""

    def __init__(self, left: pa.Table) -> None:
        self.left, a = left, matrix(left)
        self.a = np.hstack([-2 * a, (a * a).sum(1)[:, None], np.ones((len(a), 1))])
        self.i = left.column("vec_row").to_numpy()
        self.sums: dict[str, tuple[int, np.ndarray]] = {}

    def add(self, right: pa.Table) -> None:
        b, n, sizes = matrix(right), right.column("n").to_numpy(), right.column("size").to_numpy()
        squares = np.hstack([b, np.ones((len(b), 1)), (b * b).sum(1)[:, None]]).T
        models = right.column("model").combine_chunks().dictionary_encode()
        code, names = models.indices.to_numpy(), models.dictionary.to_pylist()
        share = np.where(code[:, None] == np.arange(len(names))[None, :], n[:, None], 0).astype(np.float64)
        totals, step = np.zeros((len(self.a), len(names))), max(1, CELLS // len(b))
        same = np.hstack([np.zeros((2, 0), np.int64), *(np.vstack(x) for x in of_same(self.i, right.column("vec_row").to_numpy()))])
        for at in range(0, len(self.a), step):
            d = self.a[at : at + step] @ squares
            np.sqrt(np.maximum(d, 0.0, out=d), out=d)
            here = same[:, (same[0] >= at) & (same[0] < at + step)]
            d[here[0] - at, here[1]] = 0.0
            totals[at : at + step] = d @ share
        for k, o in enumerate(names):
            self.sums[o] = (sizes[code == k][0], totals[:, k] + (self.sums[o][1] if o in self.sums else 0.0))

    def result(self) -> pa.Table:
        many, left = len(self.left), [self.left.column(c) for c in ("model", "vec_row", "n")]
        return pa.concat_tables([pa.table([*left, pa.repeat(o, many), pa.repeat(pa.scalar(int(so), pa.int64()), many), pa.array(t)], names=["m", "i", "ni", "o", "so", "t"]) for o, (so, t) in sorted(self.sums.items())])


def distance_sums(rows: DataFrame, keys: list[str], block: int = BLOCK, held: int = HELD) -> DataFrame:
    """(keys, m, i, ni, o, so, t): for each distinct vector i of model m the sum of its Euclidean distances to model o's
    vectors. ``rows``: keys, model, vec_row, n (how many have the vector), size (of the model), vec."""
    given = rows.select(*keys, "model", "vec_row", "n", "size", "vec")
    sums = against_all(given, keys, "vec_row", Distances, "m string, i long, ni long, o string, so long, t double", parts_of(given, block, held), block)
    return sums.groupBy(*keys, "m", "i", "ni", "o", "so").agg(F.sum("t").alias("t"))


def nearest(vectors: DataFrame, item: str, k: int, places: int = 9) -> DataFrame:
    """(anchor, item): the ``k`` items of greatest cosine (rounded, then by item), the anchor among them."""
    pairs = block_pairs(vectors.select(item, "vec"), [], item)
    kind = vectors.schema[item].dataType.simpleString()

    def work(left: pa.Table, right: pa.Table) -> pa.Table:
        a, b = matrix(left), matrix(right)
        norm = lambda x: np.sqrt((x * x).sum(1))
        sim = np.round((a @ b.T) / (norm(a)[:, None] * norm(b)[None, :]), places)
        to = right.column(item).to_numpy()
        best = np.lexsort((np.broadcast_to(to, sim.shape), -sim), axis=1)[:, :k]
        many = best.shape[1]
        return pa.table({"anchor": pa.array(np.repeat(left.column(item).to_numpy(), many)), item: pa.array(to[best].ravel()), "sim": pa.array(np.take_along_axis(sim, best, 1).ravel())})

    return over_blocks(pairs, [], work, f"anchor {kind}, {item} {kind}, sim double")


def bits(table: pa.Table, many: int) -> np.ndarray:
    """``second`` (bytes) of each row as so many truth values."""
    return np.unpackbits(np.frombuffer(b"".join(table.column("second").to_pylist()), np.uint8).reshape(len(table), -1), axis=1, count=many).astype(bool)


class BestPartners:
    """For each of a block's items and each permutation that has it in group 0, its best product in group 1. Only a product above
    the least of an item's bests so far can better one, so few are looked at after the first block. Permutation 0, whose
    groups may follow the vectors, has a maximum of its own."""

    def __init__(self, left: pa.Table, many: int) -> None:
        self.many, self.a, self.id = many, matrix(left), left.column("id").to_numpy()
        self.first = ~bits(left, many)
        self.best = np.full((len(self.a), many), -np.inf)

    def floor(self, rows: np.ndarray) -> np.ndarray:
        return np.where(self.first[rows, 1:], self.best[rows, 1:], np.inf).min(1, initial=np.inf)

    def add(self, right: pa.Table) -> None:
        b, second = matrix(right), bits(right, self.many)
        same = np.hstack([np.zeros((2, 0), np.int64), *(np.vstack(x) for x in of_same(self.id, right.column("id").to_numpy()))])
        step = max(1, CELLS // len(b))
        for at in range(0, len(self.a), step):
            sim = self.a[at : at + step] @ b.T
            here = same[:, (same[0] >= at) & (same[0] < at + step)]
            sim[here[0] - at, here[1]] = -np.inf
            rows = np.arange(at, at + len(sim))
            own = np.where(self.first[rows, 0], sim[:, second[:, 0]].max(1, initial=-np.inf), -np.inf)
            self.best[rows, 0] = np.maximum(self.best[rows, 0], own)
            self.better(rows, sim, second)

    def better(self, rows: np.ndarray, sim: np.ndarray, second: np.ndarray) -> None:
        floor = self.floor(rows)
        row, column = np.nonzero(sim > floor[:, None])
        value = sim[row, column]
        order = np.lexsort((-value, row))
        column, value = column[order], value[order]
        count = np.bincount(row, minlength=len(rows))
        start, live = np.cumsum(count) - count, np.flatnonzero(count)
        place = 0
        while True:
            live = live[place < count[live]]
            live = live[value[start[live] + place] > floor[live]]
            if not len(live):
                return
            at = start[live] + place
            own, v = rows[live], value[at][:, None]
            now = self.best[own, 1:]
            now = np.where(self.first[own, 1:] & second[column[at], 1:] & (now < v), v, now)
            self.best[own, 1:] = now
            floor[live] = self.floor(own)
            place += 1

    def result(self) -> pa.Table:
        return pa.table({"a": pa.array(self.id, pa.int64()), "m": pa.array([x.tobytes() for x in self.best], pa.binary())})


def best_across(items: DataFrame, many: int, block: int = BLOCK, held: int = HELD) -> DataFrame:
    """(perm, value): for each of ``many`` permutations, the mean over its group 0 of each item's best product in group 1. ``items``:
    id (long), vec, second (bits: whether the item is in group 1 of each permutation)."""
    spark = items.sparkSession
    parts = parts_of(items, block, held)
    best = against_all(items, [], "id", lambda left: BestPartners(left, many), "a long, m binary", parts, block)
    if parts[1] > 1:
        best = best.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "a").sortWithinPartitions("a")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, now, held_ = np.zeros((many, 2)), None, None  # an item's parts come one after the other

        def close() -> None:
            has = held_ > -np.inf
            total[has] += np.stack([held_[has], np.ones(has.sum())], 1)

        for batch in batches:
            for a, m in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                x = np.frombuffer(m.as_buffer(), np.float64)
                if now is not None and a != now:
                    close()
                held_ = x if a != now else np.maximum(held_, x)
                now = a
        if now is not None:
            close()
        yield from blocks_of(total)

    total = placed(merged(best.mapInArrow(run, DDL)), (many, 2))
    return spark.createDataFrame([(p, float(s / n)) for p, (s, n) in enumerate(total) if n], "perm int, value double")


#: Dimensions whose signs deal rows to blocks that lie near each other.
SIGNS = 4


def similar_pairs(left: DataFrame, right: DataFrame, keys: list[str], least: float, block: int = BLOCK) -> DataFrame:
    """(keys, source, target, sim) of all pairs of ``left`` and ``right`` rows (keys, item, vec) of the same keys whose product is at
    least ``least``. Rows are dealt to blocks by the signs of their first components, and by hash where such a block would be
    larger than ``block``. A pair of blocks with centres c, d and radii r, s has no product above c d + r |d| + s |c| + r s:
    where that is too little, neither block is sent. The others meet in a task that multiplies two matrices."""
    kind = left.schema["item"].dataType.simpleString()

    def dealt(df: DataFrame) -> DataFrame:
        signs = F.aggregate(F.slice("vec", 1, SIGNS), F.lit(0), lambda s, x: s * 2 + (x > 0).cast("int"))
        rows = df.select(*keys, "item", F.transform("vec", lambda x: x.cast("double")).alias("vec")).withColumn("_signs", signs)
        sizes = rows.groupBy(*keys, "_signs").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("_many"))
        return rows.join(sizes, [*keys, "_signs"]).withColumn("_block", F.struct("_signs", F.pmod(F.xxhash64("item"), F.col("_many")).cast("int").alias("part"))).drop("_signs", "_many")

    def measured(rows: DataFrame, c: str, r: str, b: str) -> DataFrame:
        each = rows.select(*keys, "_block", F.posexplode("vec").alias("dim", "x")).groupBy(*keys, "_block", "dim").agg(F.avg("x").alias("m"))
        centre = each.groupBy(*keys, "_block").agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "m"))), lambda s: s["m"]).alias(c))
        far = F.sqrt(F.aggregate(F.zip_with("vec", c, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))
        return rows.join(centre, [*keys, "_block"]).groupBy(*keys, "_block").agg(F.first(c).alias(c), F.max(far).alias(r)).withColumnRenamed("_block", b)

    first, second = dealt(left), dealt(right)
    pairs = measured(first, "_c", "_r", "_bi").join(measured(second, "_d", "_s", "_bj"), keys)
    dot_ = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    norm = lambda a: F.sqrt(dot_(a, a))
    bound = dot_("_c", "_d") + F.col("_r") * norm("_d") + F.col("_s") * norm("_c") + F.col("_r") * F.col("_s")
    asked = pairs.where(bound >= least - 1e-9).select(*keys, "_bi", "_bj")
    sent = [asked.join(rows.withColumnRenamed("_block", own), [*keys, own]).select(*keys, F.col("_bi").alias("bi"), F.col("_bj").alias("bj"), "item", "vec", F.lit(side).alias("side")) for side, rows, own in ((0, first, "_bi"), (1, second, "_bj"))]
    schema = ", ".join([*(f"{k} {left.schema[k].dataType.simpleString()}" for k in keys), f"source {kind}, target {kind}, sim double"])

    def work(a: pa.Table, b: pa.Table) -> pa.Table:
        none = not len(a) or not len(b)
        sim = np.zeros((0, 0)) if none else matrix(a) @ matrix(b).T
        i, j = np.nonzero(sim >= least)
        out = a if none else b
        return pa.table([out.column(k).take(pa.array(i if out is a else j)) for k in keys] + [a.column("item").take(pa.array(i)), b.column("item").take(pa.array(j)), pa.array(sim[i, j], pa.float64())], names=[*keys, "source", "target", "sim"])

    return over_blocks(sent[0].unionByName(sent[1]), keys, work, schema)
