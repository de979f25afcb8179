"""Repair of the structure of conversations (op13).

A conversation's role initials must be ``(s?(ua)+)?``. Each row's first fault counts: blank (nothing but white space),
duplicate (role and text seen earlier), truncated (the last character that isn't white space is none of ``.!?``). Edits:
Keep (0), Rerole to user or assistant (1), Delete (2; a must for blank and duplicate rows), Insert a user or assistant
turn without text (5); a truncated row that stays adds 5. The cheapest edits are a shortest path on the lattice of nodes
(rows taken, state of the grammar), which is never built: Dijkstra's search opens a node's edges as it pops it. Its key
is (cost, audit), the audit being the edits' initials so far, so the first end node popped that the grammar accepts has
the cheapest edits and, among these, the least audit. As the grammar says at each point which of user and assistant may
come, the audit alone gives the repaired turns.

Rows are dealt by ranges of (conversation, turn), not by conversation, so that one conversation may hold any share of
them. A task packs neighbouring rows of a conversation to parts of at most ``PART_ROWS`` rows and about ``PART_BYTES``.
A conversation that lies whole in one part is searched there, from the start to the first accepting end. In the others
each part is searched from each of the four states to each; the best ways through the parts follow one another, with
ties settled by the whole audits, and each part is then repaired by its piece of the audit. What a part must know of
earlier ones (texts seen there) meets it in a window by (conversation, hash of role and text). Only the results of a
conversation's parts come together, in order, in one task, as they are one row of the result.

null turn: sorted first, and not a turn for ``gaps``. null role or text: as one space (the query), as empty (the
operator). A null conv_id is a conversation of its own. Rows of one turn: by role, then by text (32 characters, then
a hash); equal rows are duplicates after the first. Roles other than system, user and assistant can't be kept unless they begin as these do. A
conversation without rows left: zeros, an empty audit, no turns. Empty table: no rows. Other columns are not read, and
their names don't matter. Texts are compared by 128-bit hashes across parts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from heapq import heappop, heappush

import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import read_table, write_shared

PART_ROWS, PART_BYTES = 512, 1 << 20
BLANK = " \t\n\x0b\x0c\r"
#: States of the grammar: nothing yet, after s, after u, after a; what may come next, and the state after it.
NEXT = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
NAMES = {"u": "user", "a": "assistant"}
ACCEPTED = (0, 3)
INSERT, DELETE, REROLE, TRUNCATED = 5, 2, 1, 5

PART_DDL = "ckey string, part long, whole boolean, turns array<long>, roles array<string>, texts array<string>"
STATS_DDL = "n_rows long, first_turn long, last_turn long, n_turns long, blank long, duplicate long, truncated long, illegal long, first_role string, last_role string"
MENDED_DDL = f"ckey string, part long, {STATS_DDL}, cost long, audit string, roles array<string>, texts array<string>"
DIGEST_DDL = "ckey string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string, n_turns long"


def schema_of(ddl: str) -> pa.Schema:
    kinds = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_(), "int": pa.int32(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64()), "array<string>": pa.list_(pa.string()), "array<binary>": pa.list_(pa.binary())}
    return pa.schema([(name, kinds[kind]) for name, kind in (x.split() for x in ddl.split(", "))])


def batches_of(rows: Iterable[tuple], ddl: str, size: int = 256) -> Iterator[pa.RecordBatch]:
    schema, held = schema_of(ddl), []

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)

    for row in rows:
        held.append(row)
        if len(held) == size:
            yield batch()
            held = []
    if held:
        yield batch()


def rows_in(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def digest_of(role: str, text: str) -> bytes:
    return xxhash.xxh128_digest(f"{len(role)}:{role}{text}".encode())


def fault(role: str, text: str, seen: set[bytes]) -> str:
    """The row's first fault: ``b``, ``d``, ``t`` or none; ``seen`` takes the row in."""
    last = text.rstrip(BLANK)[-1:]
    key = digest_of(role, text)
    again = key in seen
    seen.add(key)
    return "b" if not last else "d" if again else "" if last in ".!?" else "t"


def search(rows: list[tuple[str, str]], entry: int, whole: bool) -> dict[int, tuple[int, str]]:
    """Cheapest (cost, audit) through rows (role initial, fault) from state ``entry``, by the state at the end; of a ``whole``
    conversation only the first accepted end."""
    out: dict[int, tuple[int, str]] = {}
    done = set()
    queue = [(0, "", 0, entry)]
    while queue and len(out) < len(NEXT):
        cost, audit, i, state = heappop(queue)
        if (i, state) in done:
            continue
        done.add((i, state))
        if i == len(rows):
            if not whole or state in ACCEPTED:
                out[state] = (cost, audit)
                if whole:
                    break
        else:
            initial, why = rows[i]
            heappush(queue, (cost + DELETE, audit + "D", i + 1, state))
            if why not in ("b", "d"):
                more = TRUNCATED if why == "t" else 0
                if initial in NEXT[state]:
                    heappush(queue, (cost + more, audit + "K", i + 1, NEXT[state][initial]))
                for turn in NEXT[state].keys() & NAMES:
                    heappush(queue, (cost + more + REROLE, audit + "R", i + 1, NEXT[state][turn]))
        for turn in NEXT[state].keys() & NAMES:
            heappush(queue, (cost + INSERT, audit + "I", i, NEXT[state][turn]))
    return out


def rewritten(roles: list[str], texts: list[str], audit: str, state: int) -> tuple[list[str], list[str]]:
    """The turns that an audit makes of rows, from ``state`` on."""
    out: tuple[list[str], list[str]] = ([], [])
    i = 0
    for edit in audit:
        turn = next(iter(NEXT[state].keys() & NAMES))
        if edit == "K":
            turn = roles[i][:1]
        if edit != "D":
            out[0].append(roles[i] if edit == "K" else NAMES[turn])
            out[1].append("" if edit == "I" else texts[i])
            state = NEXT[state][turn]
        i += edit != "I"
    return out


def packed(rows: DataFrame, part_rows: int = PART_ROWS) -> DataFrame:
    """Parts of neighbouring rows. ``rows``: conv_id, turn, role, text, gone (the row only tells of its conversation)."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        number, k, held, size, begun = TaskContext.get().partitionId(), 0, None, 0, False
        for ckey, turn, role, text, gone in rows_in(batches):
            if held is not None and ckey != held[0]:
                yield held[0], (number << 33) + k, not held[4], *held[1:4]
                k, held, begun = k + 1, None, True
            elif held is not None and (len(held[1]) >= part_rows or size >= PART_BYTES):
                yield held[0], (number << 33) + k, False, *held[1:4]
                k, held = k + 1, [ckey, [], [], [], True]
                size = 0
            if held is None:  # the first conversation may have begun in the task before
                held, size = [ckey, [], [], [], not begun], 0
            if not gone:
                held[1].append(turn)
                held[2].append(role or "")
                held[3].append(text or "")
                size += len(role or "") + len(text or "")
        if held is not None:  # and the last go on in the next one
            yield held[0], (number << 33) + k, False, *held[1:4]

    keyed = rows.select(F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("ckey"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"), "gone")
    keyed = keyed.withColumns({"head": F.substring("text", 1, 32), "tie": F.xxhash64("text"), "row": F.monotonically_increasing_id()})
    order = ["ckey", "turn", "role", "head", "tie", "row"]
    ranges = keyed.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    return ranges.select("ckey", "turn", "role", "text", "gone").mapInArrow(lambda b: batches_of(run(b), PART_DDL, 64), PART_DDL)


def with_seen(parts: DataFrame) -> DataFrame:
    """Parts of conversations that have several, with the hashes of those of their rows that earlier parts hold too."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for ckey, part, roles, texts in rows_in(batches):
            for key in {digest_of(r, t) for r, t in zip(roles, texts, strict=True)}:
                yield ckey, part, key

    ddl = "ckey string, part long, key binary"
    each = parts.select("ckey", "part", "roles", "texts").mapInArrow(lambda b: batches_of(keys(b), ddl, 4096), ddl)
    first = F.min("part").over(Window.partitionBy("ckey", "key"))
    earlier = each.withColumn("first", first).where("first < part").groupBy("ckey", "part").agg(F.collect_list("key").alias("seen"))
    return parts.join(earlier, ["ckey", "part"], "left")


def faults_of(roles: list[str], texts: list[str], earlier: list[bytes] | None) -> list[tuple[str, str]]:
    seen = set(earlier or ())
    return [(r[:1], fault(r, t, seen)) for r, t in zip(roles, texts, strict=True)]


def stats(turns: list, marks: list[tuple[str, str]]) -> tuple:
    known = [t for t in turns if t is not None]
    count = [sum(f == x for _, f in marks) for x in "bdt"]
    initials = [r for r, _ in marks]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
    return len(turns), min(known, default=None), max(known, default=None), len(set(known)), *count, illegal, *((initials[0], initials[-1]) if initials else (None, None))


def mended_whole(parts: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for ckey, part, turns, roles, texts in rows_in(batches):
            marks = faults_of(roles, texts, None)
            ((cost, audit),) = search(marks, 0, True).values()
            yield ckey, part, *stats(turns, marks), cost, audit, *rewritten(roles, texts, audit, 0)

    return parts.select("ckey", "part", "turns", "roles", "texts").mapInArrow(lambda b: batches_of(run(b), MENDED_DDL, 64), MENDED_DDL)


class Way:
    """A way through a conversation's parts so far."""

    __slots__ = ("cost", "before", "entry", "piece")

    def __init__(self, cost: int, before: Way | None, entry: int, piece: tuple[int, int, str]) -> None:
        self.cost, self.before, self.entry, self.piece = cost, before, entry, piece

    def less(self, other: Way) -> bool:
        """Whether this way comes before one through the same parts: by cost, then by audit since the ways parted."""
        if self.cost != other.cost:
            return self.cost < other.cost
        a, b, mine, theirs = self, other, [], []
        while a is not b and a is not None and b is not None:
            mine.append(a.piece[2])
            theirs.append(b.piece[2])
            a, b = a.before, b.before
        return "".join(reversed(mine)) < "".join(reversed(theirs))


def planned(parts: DataFrame) -> DataFrame:
    """Entry state, cost and audit of each part on its conversation's best way."""
    out_ddl, way_ddl = "ckey string, part long, entry int, cost long, audit string", "ckey string, part long, costs array<long>, audits array<string>"
    tasks = int(parts.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def through(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for ckey, part, roles, texts, seen in rows_in(batches):
            marks = faults_of(roles, texts, seen)
            ways = [search(marks, s, False) for s in range(len(NEXT))]
            flat = [ways[s].get(t, (None, None)) for s in range(len(NEXT)) for t in range(len(NEXT))]
            yield ckey, part, [c for c, _ in flat], [a for _, a in flat]

    def best(ways: dict[int, Way], ckey: str) -> Iterator[tuple]:
        last = None
        for state in ACCEPTED:
            if state in ways and (last is None or ways[state].less(last)):
                last = ways[state]
        while last is not None:
            yield ckey, last.piece[0], last.entry, last.piece[1], last.piece[2]
            last = last.before

    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        now, ways = None, None
        for ckey, part, costs, audits in rows_in(batches):
            if ckey != now:
                if now is not None:
                    yield from best(ways, now)
                now, ways = ckey, None
            after: dict[int, Way] = {}
            for s in [0] if ways is None else ways:
                for t in range(len(NEXT)):
                    if (c := costs[len(NEXT) * s + t]) is not None:
                        way = Way(c + (ways[s].cost if ways else 0), ways[s] if ways else None, s, (part, c, audits[len(NEXT) * s + t]))
                        if t not in after or way.less(after[t]):
                            after[t] = way
            ways = after
        if now is not None:
            yield from best(ways, now)

    each = parts.select("ckey", "part", "roles", "texts", "seen").mapInArrow(lambda b: batches_of(through(b), way_ddl, 64), way_ddl)
    return each.repartition(tasks, "ckey").sortWithinPartitions("ckey", "part").mapInArrow(lambda b: batches_of(follow(b), out_ddl), out_ddl)


def mended_parts(parts: DataFrame, plan: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for ckey, part, turns, roles, texts, seen, entry, cost, audit in rows_in(batches):
            yield ckey, part, *stats(turns, faults_of(roles, texts, seen)), cost, audit, *rewritten(roles, texts, audit, entry)

    both = parts.join(plan, ["ckey", "part"]).select("ckey", "part", "turns", "roles", "texts", "seen", "entry", "cost", "audit")
    return both.mapInArrow(lambda b: batches_of(run(b), MENDED_DDL, 64), MENDED_DDL)


def mended(rows: DataFrame, part_rows: int = PART_ROWS) -> tuple[DataFrame, DataFrame]:
    """Repaired parts: of conversations in one part, and of the others."""
    parts = write_shared(packed(rows, part_rows), "parts")
    some = write_shared(with_seen(parts.where("NOT whole")), "parts-seen")
    return mended_whole(parts.where("whole")), mended_parts(some, planned(some))


def repaired_turns(rows: DataFrame, part_rows: int = PART_ROWS) -> DataFrame:
    """The repaired conversations' turns: ckey (conv_id as text), part and position (their order), role, text."""
    if "gone" not in rows.columns:
        rows = rows.select("conv_id", "turn", "role", "text", F.lit(False).alias("gone"))
    whole, others = mended(rows, part_rows)
    both = whole.unionByName(others)
    return both.select("ckey", "part", F.posexplode(F.arrays_zip("roles", "texts")).alias("position", "x")).select("ckey", "part", "position", F.col("x.roles").alias("role"), F.col("x.texts").alias("text"))


def summed(parts: DataFrame) -> DataFrame:
    """One row a conversation, from its repaired parts in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        now = None

        def row() -> tuple:
            gaps = 0 if low is None else high - low + 1 - distinct
            return now, gaps, *count, illegal, cost, "".join(audits), said.hexdigest(), turns

        for ckey, _, n, first, last, n_turns, b, d, t, wrong, head, tail, c, audit, roles, texts in rows_in(batches):
            if ckey != now:
                if now is not None:
                    yield row()
                now, low, high, distinct, count, illegal, cost, audits, said, turns, before = ckey, None, None, 0, [0, 0, 0], 0, 0, [], hashlib.sha256(), 0, None
            if first is not None:  # turns rise from part to part
                distinct += n_turns - (high is not None and first == high)
                low, high = first if low is None else low, last
            count = [x + y for x, y in zip(count, (b, d, t), strict=True)]
            illegal += wrong + (n > 0 and before is not None and before + head not in ("su", "ua", "au"))
            before = tail if n else before
            cost += c
            audits.append(audit)
            for role, text in zip(roles, texts, strict=True):
                said.update(f"\n{role}:{text}".encode() if turns else f"{role}:{text}".encode())
                turns += 1
        if now is not None:
            yield row()

    return parts.mapInArrow(lambda b: batches_of(run(b), DIGEST_DDL), DIGEST_DDL)


def repair_report(rows: DataFrame, part_rows: int = PART_ROWS) -> DataFrame:
    """Per conversation (ckey: its conv_id as text, null: empty): faults, cost, audit and a digest of the repaired turns."""
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    whole, others = mended(rows, part_rows)
    return summed(whole).unionByName(summed(others.repartition(tasks, "ckey").sortWithinPartitions("ckey", "part")))


def damaged(rows: DataFrame) -> DataFrame:
    """The query's damage to (conv_id, turn, role, text), by a draw on conversation and turn."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    draw = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn"))) % 20
    text = F.when(F.col("draw") == 1, "").when(F.col("draw") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    out = rows.select("conv_id", "turn", space("role").alias("role"), space("text").alias("text"), draw.alias("draw"))
    out = out.select("conv_id", "turn", F.when(F.col("draw") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), (F.col("draw") == 0).alias("gone"), F.when(F.col("draw") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))).alias("copies"))
    return out.select("conv_id", "turn", "role", "text", "gone", F.explode("copies")).drop("col")


def op13_lattice_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    out = repair_report(damaged(rows))
    conv_id = F.when(F.col("ckey") != "", F.col("ckey")).cast(rows.schema["conv_id"].dataType)
    return out.select(conv_id.alias("conv_id"), *[c for c in out.columns if c not in ("ckey", "n_turns")])
