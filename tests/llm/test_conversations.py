"""Repair of conversations against an exhaustive search and against SQL."""

import hashlib
import itertools
import random
import zlib

import duckdb
import pytest

from vouchlake.llm import conversation_repair as repair
from vouchlake.llm import queries

SPACES = " \t\n\x0b\x0c\r"
SCHEMA = "conv_id long, turn long, role string, text string, copies string, seen string"


def made(n, seed, most=5):
    rng = random.Random(seed)
    roles, texts = ["user", "assistant", "system", "usher", None, "", "tool"], ["Yes.", "No", "", "  ", None, "a.b!", "　", "x?\n"]
    return [
        (c if c % 17 else None, None if rng.random() < 0.05 else rng.choice([k, k, k, k + 3]), rng.choice(roles[:3] if rng.random() < 0.8 else roles), rng.choice(texts))
        for c in range(n) for k in range(rng.randint(1, most))
    ]


def damaged(rows):
    out = {}
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if kind == 1 else "".join(c for c in text if c not in ".!?") if kind == 2 else text
        out.setdefault(conv, []).extend([(turn, "user" if kind == 4 else role, text)] * {0: 0, 3: 2}.get(kind, 1))
    for v in out.values():
        v.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    return out


def judged(rows):
    seen, out = set(), []
    for _, role, text in rows:
        end = text.rstrip(SPACES)[-1:]
        out.append("blank" if not end else "duplicate" if (role, text) in seen else "truncated" if end not in ".!?" else "")
        seen.add((role, text))
    return out


def exhaustive(rows):
    """Every sequence of edits with at most two inserts in each gap."""
    kinds, best = judged(rows), (4 * len(rows), "D" * len(rows), "")
    inserts = [(), ("user",), ("assistant",), ("user", "assistant"), ("assistant", "user")]
    for gaps in itertools.product(inserts, repeat=len(rows) + 1):
        for acts in itertools.product(("K", "user", "assistant", "D"), repeat=len(rows)):
            cost, audit, out = 0, "", []
            for k in range(len(rows) + 1):
                for role in gaps[k]:
                    cost, audit = cost + 3, audit + "I"
                    out.append((role, ""))
                if k == len(rows):
                    break
                _, role, text = rows[k]
                if cost > best[0]:
                    break
                if acts[k] == "D":
                    cost, audit = cost + 4, audit + "D"
                    continue
                if kinds[k] in ("blank", "duplicate"):
                    break
                cost += 3 * (kinds[k] == "truncated") + 3 * (acts[k] != "K")
                audit += "K" if acts[k] == "K" else "R"
                out.append((role if acts[k] == "K" else acts[k], text))
            else:
                k = len(rows)
            if k < len(rows):
                continue
            shape = "".join(r[:1] or "-" for r, _ in out)
            rest = shape[1:] if shape[:1] == "s" else shape
            if (shape and not rest) or rest != "ua" * (len(rest) // 2):
                continue
            if best is None or (cost, audit) < best[:2]:
                best = (cost, audit, "\n".join(f"{r}:{t}" for r, t in out))
    return best


def expected(rows, edits):
    out = []
    for conv, mine in damaged(rows).items():
        kinds, turns = judged(mine), [t for t, _, _ in mine if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(x[1][:1] + y[1][:1] not in ("su", "ua", "au") for x, y in zip(mine, mine[1:]))
        cost, audit, text = edits(mine)
        sums = [kinds.count(k) for k in ("blank", "duplicate", "truncated")]
        out.append((conv, gaps, *sums, illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=str)


def run(spark, rows):
    table = spark.createDataFrame([(*r, "clash", "clash") for r in rows], SCHEMA)
    return sorted(map(tuple, repair.repair(spark, repair.damage(table)).collect()), key=str)


def test_small_conversations_by_trying_all_edits(spark):
    rows = made(200, 1, 3)
    short = {c for c, v in damaged(rows).items() if len(v) <= 3}
    mine = [r for r in rows if r[0] in short]
    assert len(short) > 120
    assert run(spark, mine) == expected(mine, exhaustive)


def by_sql(rows):
    db = duckdb.connect()
    db.execute("CREATE TABLE conversations(conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    db.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    got = db.execute(f"SELECT conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 FROM ({queries.ORACLE_SQL['op11_conversation_repair']})")
    return sorted(got.fetchall(), key=str)


@pytest.mark.parametrize("chunk", [1, 3, 2048])
def test_any_cut_into_chunks_gives_what_sql_gives(spark, monkeypatch, chunk):
    monkeypatch.setattr(repair, "CHUNK", chunk)
    rows = made(40, 2, 9) + [(7, k % 90, random.Random(k).choice(["user", "assistant", "system"]), f"t{k % 50}" + "." * (k % 3)) for k in range(200)]
    rows += [(8, 1, "user", "Again.")] * 60
    assert run(spark, rows) == by_sql(rows)


def test_repaired_turns_are_those_of_the_hash(spark):
    rows = spark.createDataFrame([(*r, "clash", "clash") for r in made(60, 3, 8)], SCHEMA)
    texts = {}
    for r in sorted(repair.repaired_turns(spark, repair.damage(rows)).collect(), key=lambda r: r["place"]):
        texts.setdefault(r["conv_id"], []).append(f"{r['role']}:{r['text']}")
    for r in repair.repair(spark, repair.damage(rows)).collect():
        assert hashlib.sha256("\n".join(texts.get(r["conv_id"], [])).encode()).hexdigest() == r["repaired_sha256"]


def test_nothing_and_all_dropped(spark):
    assert run(spark, []) == []
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:1".encode()) % 20 == 0)
    assert run(spark, [(gone, 1, "user", "Hello.")]) == [(gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
