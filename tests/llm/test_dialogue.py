"""Repair of conversations against a shortest-path search over whole edit sequences."""

import hashlib
import heapq
import random
import re
import zlib

import pytest

from evenkeel.llm import dialogue

SCHEMA = "conv_id long, turn long, role string, text string"


def digest(conv, row):
    return hashlib.md5(f"{' ' if conv is None else conv}:{len(row[1])}:{row[1]}:{row[2]}".encode()).digest()


def harmed(conv, rows):
    out = []
    for turn, role, text in rows:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return out


def cheapest(rows, fault):
    heap, done, follow = [(0, "", 0, "0", ())], set(), {"0": "u", "s": "u", "u": "a", "a": "u"}
    while True:
        cost, edits, i, at, out = heapq.heappop(heap)
        if (i, at) in done:
            continue
        done.add((i, at))
        if i == len(rows) and at in "0a":
            return cost, edits, out
        new = follow[at]
        name = {"u": "user", "a": "assistant"}[new]
        heapq.heappush(heap, (cost + 3, edits + "I", i, new, (*out, (name, ""))))
        if i < len(rows):
            _, role, text = rows[i]
            heapq.heappush(heap, (cost + 4, edits + "D", i + 1, at, out))
            if fault[i] not in ("b", "d"):
                more = 3 * (fault[i] == "t")
                heapq.heappush(heap, (cost + 3 + more, edits + "R", i + 1, new, (*out, (name, text))))
                if role[:1] == new or (role[:1] == "s" and at == "0"):
                    heapq.heappush(heap, (cost + more, edits + "K", i + 1, role[:1], (*out, (role, text))))


def plain(rows):
    convs, out = {}, {}
    for conv, *row in rows:
        convs.setdefault(conv, []).append(tuple(row))
    for conv, some in convs.items():
        made = sorted(harmed(conv, some), key=lambda r: (r[0] is not None, r[0] or 0, digest(conv, r)))
        turns, seen, fault = [r[0] for r in made if r[0] is not None], set(), []
        for _, role, text in made:
            words = text.rstrip(" \t\n\x0b\x0c\r")
            fault.append("b" if not words else "d" if (role, text) in seen else "" if words[-1] in ".!?" else "t")
            seen.add((role, text))
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(made, made[1:]))
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        cost, edits, kept = cheapest(made, fault)
        sha = hashlib.sha256("\n".join(f"{a}:{b}" for a, b in kept).encode()).hexdigest()
        out[conv] = (gaps, *[fault.count(x) for x in "bdt"], illegal, cost, edits, sha)
    return out


def made_up(seed, many):
    rnd, rows = random.Random(seed), []
    roles, texts = ["user", "assistant", "assistant", "system", "tool", "", None, "user"], ["A b.", "", "Hello!", "no end", "x?  ", "  \n", None, "y.", "z."]
    for conv in [None, *range(many)]:
        for j in range(rnd.choice([1, 2, 3, 5, 8, 13, 40])):
            rows.append((conv, rnd.choice([None, j, j, j, rnd.randint(0, 6)]), rnd.choice(roles), rnd.choice(texts)))
    return rows


@pytest.mark.parametrize("block", [dialogue.BLOCK, 5])
def test_random_conversations(spark, block):
    rows = made_up(7, 120)
    got = {r.conv_id: tuple(r)[1:] for r in dialogue.repair_damaged(spark.createDataFrame(rows, SCHEMA), block).collect()}
    assert got == plain(rows)


def test_given_conversations(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    rows = [tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()]
    assert {r.conv_id: tuple(r)[1:] for r in dialogue.repair_damaged(df).collect()} == plain(rows)


def test_one_conversation_of_many_equal_and_long_rows(spark):
    rows = [(1, i % 50, "user", "same.") for i in range(4000)] + [(1, 60 + i, "assistant" if i % 3 else "user", f"t{i} " * 50 + ".") for i in range(200)]
    rows += [(2, 0, "user", "word " * 50000 + "?")]
    df = spark.createDataFrame(rows, SCHEMA)
    for block in (dialogue.BLOCK, 64):
        got = {r.conv_id: tuple(r)[1:] for r in dialogue.repair_damaged(df, block).collect()}
        assert got == plain(rows)


def test_turns_of_the_repair_give_its_hash(spark):
    rows = made_up(9, 30)
    df = dialogue.damaged(spark.createDataFrame(rows, SCHEMA))
    kept = {}
    for r in sorted(dialogue.repaired_turns(df).collect(), key=lambda r: r.place):
        kept.setdefault(r.conv_id, []).append(f"{r.role}:{r.text}")
        assert r.place == len(kept[r.conv_id]) - 1 and (r.edit != "I" or r.text == "")
    for r in dialogue.repair_report(df).collect():
        assert r.repaired_sha256 == hashlib.sha256("\n".join(kept.get(r.conv_id, [])).encode()).hexdigest()


def test_all_rows_dropped_clashing_columns_and_empty_table(spark):
    conv = next(c for c in range(10**6) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    df = spark.createDataFrame([(conv, 0, "user", "Hi.", "x", 3)], SCHEMA + ", digest string, copies int")
    empty = hashlib.sha256(b"").hexdigest()
    assert [tuple(r) for r in dialogue.repair_damaged(df).collect()] == [(conv, 0, 0, 0, 0, 0, 0, "", empty)]
    assert dialogue.repair_damaged(spark.createDataFrame([], SCHEMA)).collect() == []


def test_spans_divide_anywhere():
    """Cells by halves equal cells by every division of every span."""
    import numpy as np

    rnd = random.Random(1)
    for n in (1, 2, 3, 6, 9):
        symbols = [rnd.randrange(12) for _ in range(n)]
        cell = {(i, i + 1, p, q): (int(dialogue.UNIT_COST[s, p, q]), dialogue.CODES[dialogue.UNIT_CODE[s, p, q]]) for i, s in enumerate(symbols) for p in range(4) for q in range(4) if dialogue.UNIT_COST[s, p, q] < dialogue.FAR}
        for size in range(2, n + 1):
            for i in range(n - size + 1):
                for p in range(4):
                    for q in range(4):
                        ways = [(a[0] + b[0], a[1] + b[1]) for k in range(i + 1, i + size) for r in range(4) if (a := cell.get((i, k, p, r))) and (b := cell.get((k, i + size, r, q)))]
                        if ways:
                            cell[i, i + size, p, q] = min(ways)
        chart = dialogue.Chart(np.array(symbols), np.array([n]))
        for p in range(4):
            for q in range(4):
                want = cell.get((0, n, p, q))
                if want is None:
                    assert chart.cost[0, p, q] >= dialogue.FAR
                else:
                    assert (int(chart.cost[0, p, q]), chart.edits(np.array([0]), np.array([p]), np.array([q]))[0]) == want
