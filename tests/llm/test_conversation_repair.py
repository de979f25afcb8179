import itertools
import random

import pytest

from shiftloom.llm import conversation_repair as repair

from . import plain

DDL = "conv_id long, turn long, role string, text string, part string, cost string"


def conversations():
    rng = random.Random(3)
    rows = []
    for conv in range(60):
        said = ["Ay.", "no", "So!", "", "  \n", "Why? ", "Ay.", "x" * 40]
        rows += [(conv, t if conv % 7 else rng.choice([None, 3, t]), rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None]), rng.choice([*said, f"Text {t}."])) for t in range(rng.randint(0, 9))]
    rows += [(None, 0, "user", "Hm."), (None, 1, "assistant", "Yes."), (77, 2, None, None)]
    rows += [(99, t, ("user", "assistant")[t % 2 if t % 11 else 0], f"Turn {t % 45}" + ".!, "[t % 4]) for t in range(150)]
    return rows


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame([(*r, "p", "c") for r in conversations()], DDL).repartition(5).cache()


@pytest.mark.parametrize("part_rows", [repair.PART_ROWS, 1, 4])
def test_equals_all_edits_however_it_is_cut(rows, part_rows):
    got = {r.ckey: tuple(r)[1:9] for r in repair.repair_report(repair.damaged(rows), part_rows).collect()}
    kept = plain.damaged(conversations())
    assert set(got) == {"" if c is None else str(c) for c in kept}
    for conv, turns in kept.items():
        ordered = sorted(turns, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        assert got["" if conv is None else str(conv)] == plain.repaired(ordered), conv


def test_parts_agree_with_whole(rows):
    report = lambda n: sorted(tuple(r) for r in repair.repair_report(repair.damaged(rows), n).collect())
    assert report(repair.PART_ROWS) == report(1) == report(3)


def test_turns_come_back_repaired(spark, rows):
    turns = repair.repaired_turns(rows.where("conv_id < 40"), 3).orderBy("ckey", "part", "position").collect()
    for _, group in itertools.groupby(turns, lambda r: r.ckey):
        initials = "".join(r.role[0] for r in group)
        assert initials.removeprefix("s").replace("ua", "") == "" and initials != "s"
    fixed = spark.createDataFrame([(1, 0, "user", "Hi."), (1, 1, "user", "Still?"), (1, 2, "assistant", "Yes.")], "conv_id long, turn long, role string, text string")
    assert [(r.role, r.text) for r in repair.repaired_turns(fixed).orderBy("part", "position").collect()] == [("user", "Still?"), ("assistant", "Yes.")]


def test_empty_table_and_ties(rows):
    assert repair.repair_report(repair.damaged(rows.where("false"))).count() == 0
    # Deleting both (4), or rerolling the second (1): the cheaper; among equals D before I before K before R.
    assert repair.search([("u", ""), ("u", "")], 0, True) == {3: (1, "KR")}
    assert repair.search([("a", "")], 0, True) == {0: (2, "D")} and repair.search([], 0, True) == {0: (0, "")}
