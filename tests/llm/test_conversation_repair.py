import hashlib
import itertools
import random
import re
import zlib

import pytest

from caseweave.llm import conversation_repair as R

COST = {"K": 0, "R": 2, "D": 3, "I": 2}


def all_repairs(rows, budget):
    """Every (cost, audit, roles and texts) within the budget, by trying all edits."""
    found = []

    def go(k, cost, audit, out):
        if cost > budget:
            return
        if k == len(rows):
            if re.fullmatch("(s?(ua)+)?", "".join(r[:1] or "?" for r, _ in out)):
                found.append((cost, audit, tuple(out)))
        else:
            role, text, forced, cut = rows[k]
            if not forced:
                go(k + 1, cost + cut, audit + "K", [*out, (role, text)])
                for other in ("user", "assistant"):
                    go(k + 1, cost + 2 + cut, audit + "R", [*out, (other, text)])
            go(k + 1, cost + 3, audit + "D", out)
        for other in ("user", "assistant"):
            go(k, cost + 2, audit + "I", [*out, (other, "")])

    go(0, 0, "", [])
    return found


def plain(conv, rows):
    """The contract read literally: rows are (turn, role, text) before the damage."""
    live = []
    for turn, role, text in rows:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind != 0:
            row = (turn, "user" if kind == 4 else role, "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text)
            live += [row] * (2 if kind == 3 else 1)
    live.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    if not live:
        return (conv, 0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())
    seen, faults, marked = set(), [], []
    for _, role, text in live:
        solid = text.strip(" \t\n\x0b\x0c\r")
        fault = "blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else ""
        seen.add((role, text))
        faults.append(fault)
        marked.append((role, text, fault in ("blank", "duplicate"), int(fault == "truncated")))
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(live, live[1:]))
    budget = 0
    while not (found := all_repairs(marked, budget)):
        budget += 1
    cost, audit, out = min(found, key=lambda f: f[:2])
    turns = {t for t, _, _ in live if t is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    sha = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest()
    return (conv, gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal, cost, audit, sha)


def test_cells_equal_all_edits():
    for n in range(5):
        for codes in itertools.product("uasoUd" if n < 4 else "usAd", repeat=n):
            rows = [({"u": "user", "a": "assistant", "s": "system", "o": "tool", "d": "user"}[c.lower()], "x", c == "d", int(c.isupper())) for c in codes]
            budget = 0
            while not (found := all_repairs(rows, budget)):
                budget += 1
            assert R.best(R.span("".join(codes))) == min(f[:2] for f in found)


def test_a_span_may_be_split_anywhere():
    draw = random.Random(2)
    for _ in range(100):
        codes = "".join(draw.choice("uasoUASd") for _ in range(draw.randint(2, 40)))
        at = draw.randrange(1, len(codes))
        assert R.combine(R.span(codes[:at]), R.span(codes[at:])) == R.span(codes)


@pytest.fixture(scope="module")
def table(spark):
    draw = random.Random(7)
    rows = []
    for conv in [None, *range(60)]:
        for turn in draw.sample([None, 0, 0, 1, 1, 2, 3, 5], draw.randint(1, 5)):
            role = draw.choice(["user", "assistant", "system", "tool", "", None, "user", "assistant"])
            rows.append((conv, turn, role, draw.choice(["Yes.", "No", "Yes.", " ", "", None, "Why?\n", "End. x"])))
    rows += [(99, 7, "user", "same."), (99, 7, "user", "same."), (99, 8, "user", "same.")]
    return rows


def _frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, copies string, digest int")


def _want(rows):
    convs = {}
    for conv, *row in rows:
        convs.setdefault(conv, []).append(row)
    return {conv: plain(conv, of) for conv, of in convs.items()}


@pytest.mark.parametrize("partitions", [1, 4, 30])
def test_rows_equal_plain_reading(spark, table, partitions):
    """Many small partitions cut conversations into several spans."""
    before = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = R.repair(R.damaged(_frame(spark, table))).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before[0])
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before[1])
    want = _want(table)
    assert len(got) == len(want)
    for row in got:
        assert tuple(row) == want[row.conv_id]


def test_one_conversation_over_many_partitions(spark):
    rows = [(1, t, ("user", "assistant")[t % 2], f"line {t}." if t % 7 else "same.") for t in range(400)]
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        (row,) = R.repair(R.as_they_are(_frame(spark, rows))).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    # two roles, so two first ones; a repeated row of either role goes
    assert (row.gaps, row.duplicate, row.truncated, row.illegal) == (0, 56, 0, 0)
    seen, codes = set(), ""
    for _, _, role, text in rows:
        codes += "d" if (role, text) in seen else role[0]
        seen.add((role, text))
    assert (row.cost, row.audit) == R.best(R.span(codes))


def test_empty_table(spark):
    assert R.repair(R.damaged(_frame(spark, []))).count() == 0
