"""Repaired conversations against a search over all edits, written out from the contract."""

import functools
import hashlib
import itertools
import random
import re
import zlib

from pyspark.sql import functions as F

from graticule.llm import turn_repair
from graticule.llm.queries import QUERIES

SPACE = " \t\n\x0b\x0c\r"


def search(codes):
    """Cheapest (cost, audit) over every edit sequence."""
    after = [{"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2}]

    @functools.cache
    def go(i, state, inserted):
        out = [(0, "")] if i == len(codes) and state in (0, 3) else []
        if inserted < 3:
            cost, audit = go(i, 3 if state == 2 else 2, inserted + 1)
            out.append((cost + 2, "I" + audit))
        if i < len(codes):
            cost, audit = go(i + 1, state, 0)
            out.append((cost + 3, "D" + audit))
            role, late = codes[i].lower(), codes[i].isupper()
            if codes[i] != "-":
                for symbol, following in after[state].items():
                    if symbol == role or symbol != "s":
                        cost, audit = go(i + 1, following, 0)
                        out.append((cost + late + 2 * (symbol != role), "RK"[symbol == role] + audit))
        return min(out, default=(10 ** 9, ""))

    for i in range(len(codes), 0, -1):  # from the end, so that the recursion stays flat
        for state in range(4):
            go(i, state, 0)
    return go(0, 0, 0)


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        key = ":".join(" " if x is None else str(x) for x in (conv, turn))
        k = zlib.crc32(key.encode()) % 20
        if k == 0:
            continue
        text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
        out += [(conv, turn, "user" if k == 4 else role, text)] * (2 if k == 3 else 1)
    return out


def expected(rows, damage=True):
    ids = {r[0] for r in rows}
    left = damaged(rows) if damage else [(c, t, r or " ", x or " ") for c, t, r, x in rows]
    result = {}
    for conv in ids:
        turns = sorted((r for r in left if r[0] == conv),
                       key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
        numbers = {r[1] for r in turns if r[1] is not None}
        gaps = max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0
        seen, codes, n = set(), "", dict.fromkeys(("blank", "duplicate", "truncated"), 0)
        for _, _, role, text in turns:
            shown = text.strip(SPACE)
            fault = ("blank" if not shown else "duplicate" if (role, text) in seen else
                     "truncated" if shown[-1] not in ".!?" else None)
            seen.add((role, text))
            if fault:
                n[fault] += 1
            code = role[:1] if role[:1] in ("s", "u", "a") else "x"
            codes += "-" if fault in ("blank", "duplicate") else code.upper() if fault else code
        initials = [r[2][:1] for r in turns]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        cost, audit = search(codes)
        kept, i = [], 0
        for edit in audit:
            if edit in "KRD":
                _, _, role, text = turns[i]
                i += 1
            if edit == "D":
                continue
            last = kept[-1][0][:1] if kept else ""
            made = "assistant" if last == "u" else "user"
            kept.append((role, text) if edit == "K" else (made, text if edit == "R" else ""))
        text = "\n".join(f"{r}:{t}" for r, t in kept)
        result[conv] = (gaps, n["blank"], n["duplicate"], n["truncated"], illegal, cost, audit,
                        hashlib.sha256(text.encode()).hexdigest())
    return result


def found(df):
    rows = df.collect()
    result = {r["conv_id"]: tuple(r)[1:] for r in rows}
    assert len(result) == len(rows)
    return result


def test_all_short_conversations():
    for n in range(5):
        for codes in itertools.product("suax-SUAX", repeat=n):
            assert turn_repair.repair_one("".join(codes)) == search(codes), codes
    rng = random.Random(1)
    for _ in range(60):
        codes = "".join(rng.choice("suaaaauuuu-AUx") for _ in range(rng.randint(5, 30)))
        assert turn_repair.repair_one(codes) == search(codes), codes


def test_given_table(spark, small):
    rows = [tuple(r) for r in spark.read.parquet(f"{small}/conversations.parquet").select(
        "conv_id", "turn", "role", "text").collect()]
    assert found(QUERIES["op11_turn_repair"](spark, small)) == expected(rows)


def odd_rows():
    rng = random.Random(5)
    rows = [(None, None, None, None), (None, 3, "user", "Hi."), (None, 4, "assistant", "Yes."),
            (7, None, "user", "a."), (7, None, "user", "a."), (7, 2, "", "x"), (8, 1, "system", "s."),
            (9, 1, "tool", "t!"), (9, 1, "assistant", "v?"), (9, 9, "unknown", "é😀 "),
            (10, 0, "user", "\n\t"), (11, -2, "System", "Q."), (12, 0, "user", "x" * 300_000)]
    for i in range(400):  # one conversation that holds most rows
        role = rng.choice(["user", "assistant"]) if i % 9 == 0 else ("user", "assistant")[i % 2]
        rows.append((1, i, "system" if i == 0 else role, rng.choice(["Yes.", f"Text {i}.", f"cut {i}", ""])))
    return rows


def test_nulls_ties_and_one_long_conversation(spark):
    rows = odd_rows()
    df = spark.createDataFrame(
        [(*r, "x", 1) for r in rows],
        "conv_id bigint, turn bigint, role string, text string, _row string, fault int")
    for damage in (True, False):
        turns = turn_repair.damage(df) if damage else df
        # a few rows to a task and a segment: the long conversation spans many of both
        for per_task, most in ((20, 7), (100_000, 32)):
            assert found(turn_repair.audit(turns, df, per_task, most)) == expected(rows, damage)


def test_empty(spark):
    df = spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")
    assert turn_repair.audit(turn_repair.damage(df), df).count() == 0
    one = spark.createDataFrame([(5,)], "conv_id bigint")
    empty = hashlib.sha256(b"").hexdigest()
    assert found(turn_repair.audit(df, one)) == {5: (0, 0, 0, 0, 0, 0, "", empty)}


def test_segments_hold_repaired_turns(spark):
    df = spark.createDataFrame(
        [(1, 0, "user", "Hi."), (1, 1, "user", "Still here?"), (1, 2, "assistant", "Yes.")],
        "conv_id bigint, turn bigint, role string, text string")
    row = turn_repair.repair(turn_repair.faults(df)).select(
        "audit", F.expr("transform(turns, t -> t.role || ':' || t.text)").alias("t")).first()
    assert row["audit"] == "KIKK"
    assert row["t"] == ["user:Hi.", "assistant:", "user:Still here?", "assistant:Yes."]
