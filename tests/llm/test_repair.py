"""Repair of conversations against a plain search over all edit sequences."""

import hashlib
import random
import re
import sys
import zlib
from functools import cache

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tidemark.llm import op12
from tidemark.llm.conversation_repair import BLOCK, DELETED, LATE, ROLES, repaired, reports, solve

sys.setrecursionlimit(20_000)  # the plain search descends once a turn
SPACE = " \t\n\x0b\x0c\r"


def plain(turns):
    """(cost, audit, roles of what is left) of turns (initial, must be deleted, breaks off), by the least (cost, audit) from each place and state on."""
    fits = {"": "su", "s": "u", "u": "a", "a": "u"}

    @cache
    def best(i, last, inserted):
        out = [(0, "", ())] if i == len(turns) and last in ("", "a") else []

        def add(cost, letter, rest, *role):
            if rest is not None:
                out.append((cost + rest[0], letter + rest[1], (*role, *rest[2])))

        own = "u" if last in ("", "s", "a") else "a"
        if inserted < 3:
            add(3, "I", best(i, own, inserted + 1), own)
        if i < len(turns):
            initial, gone, late = turns[i]
            add(4, "D", best(i + 1, last, 0))
            if not gone:
                if initial in fits[last]:
                    add(3 * late, "K", best(i + 1, initial, 0), initial)
                add(3 + 3 * late, "R", best(i + 1, own, 0), own)
        return min(out, default=None)

    return best(0, "", 0)


def codes(turns):
    return bytes((ROLES.index(i) if i in "sua" and i else 0) | DELETED * gone | LATE * late for i, gone, late in turns)


def test_solve():
    rng = random.Random(5)
    for n in [*range(9)] * 60 + [BLOCK - 1, BLOCK, BLOCK + 1, 2 * BLOCK + 7] * 4:
        turns = [(rng.choice("uuuaaast"), gone := rng.random() < 0.15, not gone and rng.random() < 0.2) for _ in range(n)]
        assert solve(codes(turns)) == plain(turns)[:2]
    assert solve(codes([("u", False, False), ("a", False, False)] * 5000)) == (0, "K" * 10000)


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        fate = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = role or (" " if role is None else ""), " " if text is None else text
        text = "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text
        out += [(conv, turn, "user" if fate == 4 else role, text)] * (0 if fate == 0 else 2 if fate == 3 else 1)
    return out


def expected(rows):
    """The contract's row of one conversation from its turns after damage."""
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
    seen, turns, count = set(), [], dict.fromkeys(("blank", "duplicate", "truncated"), 0)
    for _, _, role, text in rows:
        solid = text.rstrip(SPACE)
        fault = "blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else None
        seen.add((role, text))
        if fault:
            count[fault] += 1
        turns.append((role[:1] if role[:1] in ("s", "u", "a") else "t", fault in ("blank", "duplicate"), fault == "truncated"))
    illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    numbers = [r[1] for r in rows if r[1] is not None]
    cost, audit, roles = plain(tuple(turns))
    left, it, at = [], iter(roles), 0
    for letter in audit:
        row = None if letter == "I" else rows[at]
        at += letter != "I"
        if letter == "D":
            continue
        role = {"s": "system", "u": "user", "a": "assistant"}[next(it)]
        left.append(f"{row[2] if letter == 'K' else role}:{row[3] if row else ''}")
    gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
    return (gaps, *count.values(), illegal, cost, audit, hashlib.sha256("\n".join(left).encode("utf-8")).hexdigest())


COLUMNS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def made():
    rng, rows = random.Random(8), []
    for conv in [*range(150), None]:
        for turn in range(rng.choice((1, 2, 3, 6, 8))):
            text = rng.choice(("Yes.", "No?", "Well", " \n", "", None, "Fine! \t", "漢字。", "A long one. " * 30))
            role = rng.choice(("user", "assistant", "user", "assistant", "system", "tool", None, ""))
            rows += [(conv, rng.choice((turn, turn, turn, None, 3)), role, text)] * rng.choice((1, 1, 1, 2))
    rows += [(conv, 0, "user", "Hm.") for conv in range(600, 2600, 19)]
    rows += [(500, i, "user" if i % 2 == 0 else "assistant", f"Turn {i}.") for i in range(300)]
    return rows


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    path = tmp_path_factory.mktemp("turns")
    conv, turn, role, text = zip(*made(), strict=True)
    pq.write_table(pa.table({"conv_id": pa.array(conv, pa.int64()), "turn": pa.array(turn, pa.int64()), "role": pa.array(role), "text": pa.array(text), "cost": pa.array(range(len(conv)))}), path / "conversations.parquet")
    return str(path)


def test_query(spark, folder):
    got = {r["conv_id"]: tuple(r[c] for c in COLUMNS) for r in op12.query(spark, folder).collect()}
    rows, after = made(), damaged(made())
    assert set(got) == {r[0] for r in rows}
    for conv in got:
        assert got[conv] == expected([r for r in after if r[0] == conv]), conv
    assert any(not v[6] for v in got.values()) and got[500][6].count("K") > 200


def test_rows(spark, folder):
    """What ``repaired`` leaves reads as the grammar says and gives the report's hash and audit."""
    turns = op12.damaged(spark.read.parquet(f"{folder}/conversations.parquet"))
    here = F.col("here")
    held = {}
    for r in repaired(turns, here=here).collect():
        held.setdefault(r["conv_id"], []).append(r)
    for r in reports(turns, here=here).collect():
        rows = held.get(r["conv_id"], [])
        kept = [x for x in rows if x["edit"] != "D"]
        assert "".join(x["edit"] for x in rows) == r["audit"] and [x["place"] for x in kept] == list(range(len(kept)))
        assert re.fullmatch("(s?(ua)+)?", "".join(x["role"][:1] for x in kept))
        assert hashlib.sha256("\n".join(f"{x['role']}:{x['text']}" for x in kept).encode()).hexdigest() == r["repaired_sha256"]


def test_empty(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert reports(none).collect() == [] and repaired(none).collect() == []
