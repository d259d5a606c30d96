import hashlib
import itertools
import random
import re
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from massloom.llm import op11_conversation_repair as op
from massloom.llm.op11_conversation_repair import ORACLE_SQL, Steps, beginning, chained, conversation_digests, edits_of, ending, op11_conversation_repair, repair_conversations, with_made_damage

SF = "/root/testdata/sf0.01"
SCHEMA = "conv_id long, turn long, role string, text string"


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        draw = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if draw == 0:
            continue
        text = "" if draw == 1 else re.sub("[.!?]", "", text) if draw == 2 else text
        out += [(conv, turn, "user" if draw == 4 else role, text)] * (2 if draw == 3 else 1)
    return out


def classed(rows):
    """Of one conversation's rows: in order, each with its fault."""
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.sha256(r[3].encode()).hexdigest()))
    seen, out = set(), []
    for _, turn, role, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]", text)
        fault = "blank" if not words else "duplicate" if (role, text) in seen else None if words[-1] in ".!?" else "truncated"
        seen.add((role, text))
        out.append((turn, role, text, fault))
    return out


def search(turns):
    """(cost, audit, repaired) over whole strings, by a table of the best audit per turn and last role."""
    best = {"": (0, "", ())}
    for k in range(len(turns) + 1):
        # inserts, relaxed until nothing changes
        while True:
            before = dict(best)
            for last, (cost, audit, out) in before.items():
                role = "assistant" if last == "u" else "user"
                option = (cost + 3, audit + "I", (*out, f"{role}:"))
                best[role[0]] = min(option, best.get(role[0], option))
            if best == before:
                break
        if k == len(turns):
            break
        _, role, text, fault = turns[k]
        further = {}
        for last, (cost, audit, out) in best.items():
            options = [(last, (cost + 4, audit + "D", out))]
            if fault not in ("blank", "duplicate"):
                more = 3 if fault else 0
                new = "assistant" if last == "u" else "user"
                options.append((new[0], (cost + 3 + more, audit + "R", (*out, f"{new}:{text}"))))
                if role[:1] == new[0] or role[:1] == "s" and last == "":
                    options.append((role[0], (cost + more, audit + "K", (*out, f"{role}:{text}"))))
            for to, option in options:
                further[to] = min(option, further.get(to, option), key=lambda o: o[:2])
        best = further
    cost, audit, out = min((best[e] for e in ("", "a") if e in best), key=lambda o: o[:2])
    return cost, audit, "\n".join(out)


def brute(rows):
    """Every conversation's row by plain loops."""
    out, every = [], {r[0] for r in rows}
    rows = damage(rows)
    for conv in every:
        turns = classed([r for r in rows if r[0] == conv])
        numbers = {t for t, *_ in turns if t is not None}
        initials = [role[:1] for _, role, _, _ in turns]
        cost, audit, repaired = search(turns)
        assert re.fullmatch(r"(s?(ua)+)?", "".join(x[0] for x in repaired.split("\n")) if "\n" not in "".join(t[2] for t in turns) and repaired else "")
        faults = [f for *_, f in turns]
        out.append((conv, max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(initials)), cost, audit, hashlib.sha256(repaired.encode()).hexdigest()))
    return sorted(out, key=str)


def run(spark, rows):
    found = conversation_digests(repair_conversations(with_made_damage(spark.createDataFrame(rows, SCHEMA))))
    return sorted(map(tuple, found.collect()), key=str)


def test_query_equals_brute_force_and_sql(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = sorted(map(tuple, op11_conversation_repair(spark, SF).collect()), key=str)
    assert got == brute(rows)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{SF}/conversations.parquet')")
    assert sorted(con.execute(ORACLE_SQL).fetchall(), key=str) == got


def made(seed, convs=40, most=14):
    rng = random.Random(seed)
    role = lambda: rng.choice(["user", "assistant", "system", "tool", "", None, "User", "u", "ä"])
    text = lambda: rng.choice(["Yes.", "No!", "cut", "", None, " \n", "Why?\n", "a b", "end. ", "x\x0b", "done. ", "ü"])
    return [(None if c == 0 else c, rng.choice([None, *range(8)]), role(), text()) for c in range(convs) for _ in range(rng.randint(1, most))]


def test_made_conversations_equal_brute_force_and_sql(spark, tmp_path):
    for seed in range(3):
        rows = made(seed)
        got = run(spark, rows)
        want = [r for r in brute(rows) if r[0] in {x[0] for x in damage(rows)}]
        assert got == want
        folder = str(tmp_path / str(seed))
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{folder}/conversations.parquet")
        assert sorted(map(tuple, op11_conversation_repair(spark, folder).collect()), key=str) == brute(rows)


def test_sql_equals_on_made_rows(spark, tmp_path):
    # turns of one number tie by role and sha256; SQL counts repeats in that order, too
    rows = made(7)
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(str(tmp_path / "c"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{tmp_path}/c/*.parquet')")
    assert sorted(con.execute(ORACLE_SQL).fetchall(), key=str) == brute(rows)


@pytest.mark.parametrize("part_rows", [1, 40])
def test_a_conversation_over_many_partitions(spark, monkeypatch, part_rows):
    # with so many partitions most hold a part of one conversation, and pieces are tiny
    monkeypatch.setattr(op, "PART_BYTES", 60 if part_rows == 1 else 2000)
    monkeypatch.setattr(op, "PIECE_BYTES", 5)
    rng = random.Random(part_rows)
    rows = [(5, rng.randint(0, 300), rng.choice(["user", "assistant", "assistant", "tool", "system"]), rng.choice(["Yes.", f"No {k}!", f"cut {k}", "", f"q{k}?"])) for k in range(500)]
    rows += [(c, t, ("user", "assistant")[t % 2], f"t {c} {t}.") for c in (3, 7) for t in range(6)] + [(9, None, "user", "same.")] * 30
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        assert run(spark, rows) == brute(rows)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_edits_make_the_repaired_conversation(spark):
    rows = [(1, 0, "system", "S."), (1, 1, "assistant", "A."), (1, 2, "assistant", "B"), (1, 3, "user", "C."), (1, 3, "user", "C."), (2, 0, "tool", " ")]
    edits = repair_conversations(spark.createDataFrame(rows, SCHEMA)).orderBy("conv", "piece", "place").collect()
    assert "".join(e["edit"] for e in edits if e["conv"] == 1) == search(classed(rows[:5]))[1]
    kept = "".join(e["role"][0] for e in edits if e["conv"] == 1 and e["edit"] != "D")
    assert re.fullmatch("s?(ua)+", kept)
    assert [(e["edit"], e["fault"]) for e in edits if e["conv"] == 2] == [("D", "blank")]


def test_parts_chain_to_the_whole():
    rng = random.Random(3)
    steps = Steps()
    for _ in range(200):
        turns = [(rng.choice("suaxt"), rng.choice([None, None, "blank", "duplicate", "truncated"])) for _ in range(rng.randint(1, 12))]
        whole = edits_of(steps, turns)
        at = rng.randint(0, len(turns))
        layer, backs = beginning(""), []
        for part in (turns[:at], turns[at:]):
            inner, total = beginning("", "s", "u", "a"), 0
            for t in part:
                inner, paid, _ = steps(inner, *t)
                total += paid
            layer, back = chained(layer, tuple((s, e, c + total, r) for s, e, c, r in inner))
            backs.append(back)
        end = ending(layer)
        between = backs[1][end]
        assert edits_of(steps, turns[:at], "", between) + edits_of(steps, turns[at:], between, end) == whole
    assert len(steps.known) < 2000


def test_odd_and_empty_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert repair_conversations(empty).count() == 0 and conversation_digests(repair_conversations(empty)).count() == 0
    rows = [(1, 0, "user", "x " * 200_000 + "."), (1, 1, "assistant", "ok."), (None, None, None, None), (2, None, "user", "a."), (2, None, "user", "a.")]
    clash = spark.createDataFrame(rows, SCHEMA).selectExpr("conv_id AS conv", "turn AS row", "role AS sha", "text AS own", "'m' AS first", "1 AS `a.b`", "2 AS text", "3 AS conv_id", "4 AS role")
    got = conversation_digests(repair_conversations(clash, "conv", "row", "sha", "own")).collect()
    assert {(r["conv"], r["audit"], r["blank"], r["duplicate"]) for r in got} == {(1, "KK", 0, 0), (None, "D", 1, 0), (2, search(classed(rows[3:]))[1], 0, 1)}
    ints = spark.createDataFrame([("c", 1, "user", "a."), ("c", 2, "assistant", "b.")], "conv_id string, turn int, role string, text string")
    assert [(r["conv"], r["audit"], r["gaps"]) for r in conversation_digests(repair_conversations(ints)).collect()] == [("c", "KK", 0)]


def test_dropped_conversations_stay(spark, tmp_path):
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    spark.createDataFrame([(gone, 0, "user", "a."), (gone, None, "user", "b.")], SCHEMA).where(F.col("turn").isNotNull()).write.parquet(str(tmp_path / "conversations.parquet"))
    assert list(map(tuple, op11_conversation_repair(spark, str(tmp_path)).collect())) == [(gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
