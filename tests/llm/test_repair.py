"""Conversation repair (operator 11): tables against a search of all edits, odd rows."""

import hashlib
import random
from functools import lru_cache

import pytest
from compare import compare

from lumisweep.llm import repair as R
from lumisweep.llm.oracle import ORACLE_SQL
from lumisweep.llm.queries import QUERIES

SCHEMA = "conv_id long, turn long, role string, text string, pos int, chunk int, symbol string"
EDITS = str.maketrans(R.SCRIPT, R.EDITS)
AFTER = {"": "u", "s": "u", "u": "a", "a": "u"}


def cheapest(symbols: str) -> tuple[int, str]:
    """Least cost and, of its edits, the ASCII-least letters, by trying all edits."""
    @lru_cache(None)
    def go(i, state, inserted):
        ways = []

        def way(cost, letter, rest):
            if rest is not None:
                ways.append((cost + rest[0], letter + rest[1]))

        if i == len(symbols) and state in ("", "a"):
            ways.append((0, ""))
        if inserted < 3:
            way(3, "I", go(i, AFTER[state], inserted + 1))
        if i < len(symbols):
            way(4, "D", go(i + 1, state, 0))
            if symbols[i] != "-":
                extra = 3 if symbols[i].isupper() else 0
                own = symbols[i].lower()
                if own == AFTER[state] or (own == "s" and state == ""):
                    way(extra, "K", go(i + 1, own, 0))
                way(3 + extra, "R", go(i + 1, AFTER[state], 0))
        return min(ways, default=None)
    return go(0, "", 0)


def _tables_say(symbols):
    known = R.tables()
    vector, cost = known.summary(symbols)
    script, state = known.trace(symbols, 0, 0)
    return (int(cost[0]) + known.vectors[vector[0]][0],
            (script + R._TAIL[state]).translate(EDITS))


def test_tables_find_the_least_of_the_cheapest_edits():
    rng = random.Random(1)
    for length in range(1, 14):
        for _ in range(150):
            symbols = "".join(rng.choice(R.SYMBOLS[1:]) for _ in range(length))
            assert _tables_say(symbols) == cheapest(symbols)
            assert R.plain_cost(symbols) == cheapest(symbols)[0]
    assert R.reachable() < 100


def _table(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, "x") for r in rows], SCHEMA)


def _report(spark, rows):
    table = _table(spark, rows)
    return {r["conv_id"]: r for r in R.digests(*R.repair(table), table).collect()}


def _sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


ODD = [
    (1, 0, "user", "Hi."), (1, 1, "assistant", "Yes."), (1, 1, "assistant", "Yes."),
    (2, None, "system", "Be."), (2, 3, "user", "open end"), (2, 9, "assistant", None),
    (3, 0, None, "Who?"), (3, 1, "", "I."),
    (4, 0, None, None), (4, None, "user", " \t\n"),
    (None, 5, "user", "Lone."), (None, 7, "assistant", "Two."),
    (5, 2, "user", "x" * 200_000 + "."), (5, 3, "assistant", "Ok!\n"),
    (6, 1, "sailor", "é."), (6, 1, "usher", "B."), (6, 1, "aunt", "A."),
]


def test_odd_rows(spark):
    found = _report(spark, ODD)
    assert found[1]["duplicate"] == 1 and found[1]["audit"] == "KKD"
    assert found[1]["repaired_sha256"] == _sha("user:Hi.\nassistant:Yes.")
    # The system row stays, the cut-off row and the blank one go or are completed.
    assert (found[2]["gaps"], found[2]["truncated"], found[2]["blank"]) == (5, 1, 1)
    assert found[2]["cost"] == 3 + 4 + 3 and sorted(found[2]["audit"]) == list("DIKK")
    assert (found[3]["illegal"], found[3]["audit"], found[3]["cost"]) == (1, "RR", 6)
    assert found[3]["repaired_sha256"] == _sha("user:Who?\nassistant:I.")
    assert (found[4]["blank"], found[4]["audit"]) == (2, "DD")
    assert found[4]["repaired_sha256"] == _sha("")
    assert (found[None]["gaps"], found[None]["audit"]) == (1, "KK")
    assert found[5]["audit"] == "KK"
    # One turn: rows by role; aunt, sailor, usher.
    assert found[6]["illegal"] == 1 and found[6]["audit"] == _tables_say("asu")[1]


@pytest.mark.parametrize("size", [1, 3, 4096])
def test_chunks_do_not_change_the_result(spark, monkeypatch, size):
    rng = random.Random(2)
    rows = [(c, t, rng.choice(["user", "assistant", "system", "tool"]),
             rng.choice(["A.", "B", "C!", "", "D?"]) * rng.randint(1, 3))
            for c in range(4) for t in range(40 if c else 200)]
    whole = _report(spark, rows)
    monkeypatch.setattr(R, "CHUNK", size)
    assert _report(spark, rows) == whole
    for c in range(4):
        one, seen, symbols = [r for r in rows if r[0] == c], set(), ""
        for _, _, role, text in one:
            letter = role[0] if role[0] in "sua" else "o"
            if not text or (role, text) in seen:
                letter = "-"
            elif text[-1] not in ".!?":
                letter = letter.upper()
            seen.add((role, text))
            symbols += letter
        assert (whole[c]["cost"], whole[c]["audit"]) == _tables_say(symbols)


def test_repaired_rows(spark):
    rows, _ = R.repair(_table(spark, [(1, 0, "assistant", "A."), (1, 1, "user", "B.")]))
    found = rows.orderBy("conv_id", "pos", "nth").collect()
    assert [(r["edit"], r["role"], r["text"]) for r in found] == [
        ("I", "user", ""), ("K", "assistant", "A."), ("K", "user", "B."), ("I", "assistant", "")]


def test_dropped_conversations_and_empty_table(spark, tmp_path):
    """A conversation of which damage leaves nothing still has its row; SQL agrees on odd rows."""
    import duckdb
    rows = ODD + [(c, t, "user", f"Text {t}.") for c in range(100, 160) for t in (0, None)]
    table = _table(spark, rows)
    table.toPandas().to_parquet(tmp_path / "c.parquet")
    connection = duckdb.connect()
    connection.execute("CREATE VIEW conversations AS SELECT conv_id::BIGINT conv_id, turn::BIGINT "
                       f"turn, role, text FROM '{tmp_path}/c.parquet'")
    table.write.parquet(str(tmp_path / "conversations.parquet"))
    result = QUERIES["op11_conversation_repair"](spark, str(tmp_path))
    ok, note = compare(result, connection, ORACLE_SQL["op11_conversation_repair"])
    assert ok, note
    assert result.where("audit = ''").count() > 0
    assert _report(spark, []) == {}
