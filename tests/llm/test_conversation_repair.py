"""Conversation repair against a search over all edit lists, and odd input."""

import hashlib
import heapq
import itertools
import random
import re
import zlib

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quire.llm import conversation_repair as R
from quire.llm.queries import QUERIES

SCHEMA = "conv_id long, turn long, role string, text string"


def faults(rows):
    seen, out = set(), []
    for role, text in rows:
        blank = not re.search(r"[^\x20\x09-\x0D]", text)
        again = (role, text) in seen
        seen.add((role, text))
        cut = not re.search(r"[.!?][\x20\x09-\x0D]*\Z", text)
        out.append("blank" if blank else "duplicate" if again else "truncated" if cut else None)
    return out


def cheapest(rows):
    """Uniform-cost search over (rows used, roles so far): the first allowed end is
    the cheapest, and of equals the ASCII-least list leaves the queue first."""
    marks = faults(rows)
    queue, done = [(0, "", 0, "", ())], set()
    while queue:
        cost, audit, i, last, out = heapq.heappop(queue)
        if i == len(rows) and last in ("", "a"):
            return cost, audit, out
        if (i, last) in done:
            continue
        done.add((i, last))
        follows = {"": "su", "s": "u", "u": "a", "a": "u"}[last]
        for r in follows.replace("s", ""):
            name = {"u": "user", "a": "assistant"}[r]
            heapq.heappush(queue, (cost + 3, audit + "I", i, r, out + ((name, ""),)))
        if i < len(rows):
            role, text = rows[i]
            heapq.heappush(queue, (cost + 4, audit + "D", i + 1, last, out))
            if marks[i] in (None, "truncated"):
                more = 3 if marks[i] else 0
                if role[:1] and role[:1] in follows:
                    heapq.heappush(queue, (cost + more, audit + "K", i + 1, role[:1], out + ((role, text),)))
                for r in follows.replace("s", ""):
                    name = {"u": "user", "a": "assistant"}[r]
                    heapq.heappush(queue, (cost + 3 + more, audit + "R", i + 1, r, out + ((name, text),)))


def expected(rows):
    """rows: (turn, role, text) of one conversation in order."""
    pairs = [(r, t) for _, r, t in rows]
    marks = faults(pairs)
    turns = [t for t, _, _ in rows if t is not None]
    cost, audit, out = cheapest(pairs)
    initials = [r[:1] for r, _ in pairs]
    return {"gaps": max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
            "blank": marks.count("blank"), "duplicate": marks.count("duplicate"), "truncated": marks.count("truncated"),
            "illegal": sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])),
            "cost": cost, "audit": audit,
            "repaired": "\n".join(f"{r}:{t}" for r, t in out)}


def repaired(spark, rows, schema=SCHEMA, **kw):
    work = R.Repair(spark.createDataFrame(rows, schema), **kw)
    audits = {r["conv_id"]: r.asDict() for r in work.audits().collect()}
    texts = {}
    for r in work.turns().orderBy("conv_id", "position").collect():
        texts.setdefault(r["conv_id"], []).append(f"{r['role']}:{r['text']}")
    for c, a in audits.items():
        a["repaired"] = "\n".join(texts.get(c, []))
    digests = {r["conv_id"]: r["repaired_sha256"] for r in R.digests(work.turns()).collect()}
    assert digests == {c: hashlib.sha256("\n".join(t).encode()).hexdigest() for c, t in texts.items()}
    return audits


def random_conversations(n, seed, longest=7):
    rng, out = random.Random(seed), {}
    for c in range(n):
        rows, turn = [], 0
        for _ in range(rng.randint(1, longest)):
            turn += rng.choice([1, 1, 2])
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", " "])
            rows.append((turn, role, rng.choice(["Hi.", "Yes!", "no end", " \t", "", "so?\n"])))
        out[c] = rows
    return out


@pytest.mark.parametrize("block_rows", [2, R.BLOCK_ROWS])
def test_blocks_against_search(block_rows):
    rows_of = random_conversations(150, 1)
    for rows in rows_of.values():
        blocks = []
        block = R.Block(0, 0, 0, 0, 1)
        for (turn, role, text), mark in zip(rows, faults([(r, t) for _, r, t in rows])):
            if block.rows >= block_rows:
                blocks.append(block.row())
                block = R.Block(0, 0, block.no + 1, 0, 4)
            block.add(turn, role[:1], mark == "blank", mark == "duplicate", mark == "truncated")
        blocks.append(block.row())
        want = expected(rows)
        schema = R.to_arrow_schema(R.StructType.fromDDL(
            "conv long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, "
            "pieces array<struct<part: int, at: long, state: int, out: long, edits: string>>"))
        got = list(R._composed(schema)(iter([pa.RecordBatch.from_pylist(blocks)])))[0].to_pylist()[0]
        for name in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"):
            assert got[name] == want[name], (name, rows)
        assert "".join(p["edits"] for p in got["pieces"]) == want["audit"]


def test_spark_against_search(spark):
    rows_of = random_conversations(200, 2)
    got = repaired(spark, [(c, *r) for c, rows in rows_of.items() for r in rows])
    assert len(got) == len(rows_of)
    for c, rows in rows_of.items():
        want = expected(rows)
        assert {k: got[c][k] for k in want} == want, rows


def test_long_conversation_spans_tasks(spark):
    rng = random.Random(5)
    rows = [(t, rng.choice(["user", "assistant", "system"]), rng.choice(["a.", "b", f"{t}!", f"x{t}"]))
            for t in range(1500)]
    got = repaired(spark, [(7, *r) for r in rows] + [(8, 0, "user", "Hi."), (8, 1, "assistant", "Ho.")])
    want = expected(rows)
    assert {k: got[7][k] for k in want} == want
    assert got[8]["audit"] == "KK"


def test_ties_take_the_least_list():
    for rows in itertools.product(["user", "assistant", "system"], repeat=4):
        best = [(0, R.Trail()), None, None, None]
        for i, role in enumerate(rows):
            best = R.step(best, role[0], False, False)
        cost, trail = R.ended(best)
        assert (cost, trail.text()) == cheapest([(r, f"{i}.") for i, r in enumerate(rows)])[:2]


def test_collisions_are_verified(monkeypatch):
    """With hashes modulo 3 nearly all unequal lists collide; the audits stay right."""
    monkeypatch.setattr(R, "_MOD", 3)
    rng = random.Random(3)
    for _ in range(300):
        a, b = ("".join(rng.choice("DIKR") for _ in range(rng.randint(1, 12))) for _ in range(2))
        x = y = R.Trail()
        for ch in a:
            x = R.Trail(x, ch)
        for at in range(0, len(b), 3):
            y = R.Trail(y, b[at:at + 3])
        assert R.before(x, y) == (a < b) and R.before(y, x) == (b < a)
    for rows in random_conversations(100, 4).values():
        best = [(0, R.Trail()), None, None, None]
        for (_, role, text), mark in zip(rows, faults([(r, t) for _, r, t in rows])):
            best = R.step(best, role[:1], mark in ("blank", "duplicate"), mark == "truncated")
        assert R.ended(best)[1].text() == expected(rows)["audit"]


def test_nulls_repeated_rows_and_long_texts(spark):
    long_text = "word " * 200_000 + "end."
    rows = [(None, 1, "user", "Q?"), (None, None, "assistant", "A."), (1, None, None, None), (1, None, None, None),
            (2, 5, "user", "Q?"), (2, 5, "user", "Q?"), (2, 9, "assistant", long_text), (3, 0, "assistant", "")]
    got = repaired(spark, rows)
    want = expected([(None, "assistant", "A."), (1, "user", "Q?")])
    assert {k: got[None][k] for k in want} == want
    want = expected([(None, " ", " "), (None, " ", " ")])
    assert {k: got[1][k] for k in want} == want and got[1]["gaps"] == 0 and got[1]["audit"] == "DD"
    assert got[2]["audit"] == "KDK" and got[2]["gaps"] == 3 and got[2]["repaired"].endswith(long_text)
    assert got[3] == {"conv_id": 3, "gaps": 0, "blank": 1, "duplicate": 0, "truncated": 0, "illegal": 0, "cost": 4,
                      "audit": "D", "repaired": ""}


def test_empty_table_and_clashing_columns(spark):
    assert repaired(spark, [], SCHEMA) == {}
    rows = [(1, 0, "user", "Q?", 9, 9, "z"), (1, 1, "assistant", "A.", 9, 9, "z")]
    got = repaired(spark, rows, SCHEMA + ", part int, conv int, digest string")
    assert got[1]["audit"] == "KK"


def test_damage(spark):
    rows = [(c, t, "assistant", "One. Two! Three?") for c in range(60) for t in range(3)] + [(5, None, None, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    want = []
    for c, t, role, text in rows:
        role, text = role or " ", text or " "
        case = zlib.crc32(f"{c}:{' ' if t is None else t}".encode()) % 20
        text = "" if case == 1 else re.sub("[.!?]", "", text) if case == 2 else text
        want += [(c, t, "user" if case == 4 else role, text)] * {0: 0, 3: 2}.get(case, 1)
    got = [tuple(r) for r in R.damaged(df.withColumn("extra", F.lit(1))).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_query_over_whole_table(spark, sf_dir):
    got = {r["conv_id"]: r.asDict() for r in QUERIES["op11_conversation_structure_repair"](spark, sf_dir).collect()}
    rows_of = {}
    source = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    for r in R.damaged(source).orderBy("conv_id", "turn", "role").collect():
        rows_of.setdefault(r["conv_id"], []).append((r["turn"], r["role"], r["text"]))
    assert set(got) == {r["conv_id"] for r in source.select("conv_id").distinct().collect()}
    for c, rows in rows_of.items():
        want = expected(rows)
        want["repaired_sha256"] = hashlib.sha256(want.pop("repaired").encode()).hexdigest()
        assert {k: got[c][k] for k in want} == want
