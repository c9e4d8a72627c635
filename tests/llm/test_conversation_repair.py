import hashlib
import itertools
import re
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from checks.compare import connect, difference
from titlegauge.llm import conversation_repair as m
from titlegauge.llm.role_grammar import ROLE_GRAMMAR, LRTable, Repair, Replay

TABLE = LRTable()
GRAMMAR = re.compile(r"(s?(ua)+)?")
COLUMNS = "conv_id long, turn long, role string, text string"


def _brute(symbols, must_go, truncated):
    """The least (cost, audit) over all edits, by growing whole strings and matching the grammar."""
    n, best = len(symbols), None
    options = []
    for i in range(n):
        ways = [("D", "", 4)]
        if not must_go[i]:
            extra = 3 * truncated[i]
            ways += [("K", symbols[i], extra), ("R", "u", 3 + extra), ("R", "a", 3 + extra)]
        options.append(ways)
    gaps = [("", ""), ("I", "u"), ("I", "a"), ("II", "ua"), ("II", "au")]
    for rows in itertools.product(*options):
        for inserts in itertools.product(gaps, repeat=n + 1):
            audit = "".join(g[0] + r[0] for g, r in zip(inserts, rows)) + inserts[n][0]
            made = "".join(g[1] + r[1] for g, r in zip(inserts, rows)) + inserts[n][1]
            if GRAMMAR.fullmatch(made):
                way = (sum(r[2] for r in rows) + 3 * audit.count("I"), audit)
                best = way if best is None else min(best, way)
    return best


@settings(deadline=None, max_examples=60)
@given(st.lists(st.tuples(st.sampled_from("suat "), st.booleans(), st.booleans()), max_size=3))
def test_repair_equals_all_edits(rows):
    repair = Repair(TABLE, m.Costs())
    for symbol, gone, cut in rows:
        repair.row(symbol, gone, cut and not gone)
    want = _brute([r[0] for r in rows], [r[1] for r in rows], [r[2] and not r[1] for r in rows])
    assert repair.finish() == want


@settings(deadline=None, max_examples=100)
@given(st.text(alphabet="suax", max_size=40))
def test_an_audit_replays_to_the_grammar(symbols):
    repair = Repair(TABLE, m.Costs())
    for symbol in symbols:
        repair.row(symbol, False, False)
    cost, audit = repair.finish()
    replay, made = Replay(TABLE, audit, m.FREE_ROLES), ""
    for symbol in symbols:
        made += "".join(r[0] for r in replay.inserted())
        role = replay.row(symbol)[1]
        made += role[:1] if role else ""
    made += "".join(r[0] for r in replay.inserted())
    assert GRAMMAR.fullmatch(made)
    assert cost == 3 * audit.count("I") + 3 * audit.count("R") + 4 * audit.count("D")


def test_a_legal_talk_costs_nothing_and_ambiguity_is_refused():
    repair = Repair(TABLE, m.Costs())
    for symbol in "suauaua":
        repair.row(symbol, False, False)
    assert repair.finish() == (0, "K" * 7)
    with pytest.raises(ValueError):
        LRTable((*ROLE_GRAMMAR, ("Pairs", ("Pairs", "Pairs"))))


def test_a_very_long_conversation_is_linear():
    repair = Repair(TABLE, m.Costs())
    for i in range(30_000):
        repair.row("ua"[i % 2] if i % 7 else "s", i % 11 == 0, i % 5 == 0)
    cost, audit = repair.finish()
    assert len(audit) >= 30_000 and cost > 0 and len(repair.back) == 30_000 * TABLE.n_states


def _plain(conversations):
    """The contract in plain Python, with the repair itself from ``Repair`` (tested above)."""
    talks = {}
    for conv, turn, role, text in conversations:
        talks.setdefault(conv, [])
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        talks[conv] += [(turn is not None, turn or 0, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    out = []
    for conv, rows in talks.items():
        rows.sort()
        seen, count, repair, faults = set(), {"b": 0, "d": 0, "t": 0, "": 0}, Repair(TABLE, m.Costs()), []
        for _, _, role, text in rows:
            body = text.strip(m.WHITE_SPACE)
            fault = "b" if not body else "d" if (role, text) in seen else "" if body[-1] in ".!?" else "t"
            seen.add((role, text))
            count[fault] += 1
            faults.append(fault)
            repair.row(role[:1], fault in ("b", "d"), fault == "t")
        cost, audit = repair.finish()
        made, at = [], 0
        for letter in audit:
            row = None if letter == "I" else rows[at]
            at += row is not None
            if letter != "D":
                free = "assistant" if made and made[-1][0][:1] == "u" else "user"
                made.append((row[2] if letter == "K" else free, row[3] if row else ""))
        turns = [t for known, t, _, _ in rows if known]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in made).encode()).hexdigest()
        out.append((conv, gaps, count["b"], count["d"], count["t"], illegal, cost, audit, digest))
    return sorted(out, key=repr)


def _got(df):
    columns = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def odd_conversations():
    long_text = "word " * 200_000 + "end."
    rows = [(c, t, ["system", "user", "assistant"][min(2, t % 3)], f"Text {c} {t % 4}.") for c in range(60) for t in range(c % 9)]
    return rows + [
        (100, None, None, None), (100, 3, "", "x"), (100, 3, "tool", "y."), (None, 1, "user", "Hi."), (None, 2, "assistant", "Yes"),
        (None, None, "user", ""), (101, 1, "user", long_text), (101, 2, "assistant", long_text), (101, 3, "user", long_text),
        (102, 5, "user", "same."), (102, 5, "user", "same."), (102, -9, "system", " \n\t"), (103, 7, "Été", "é!"),
        (104, -(1 << 62), "user", "a."), (104, (1 << 62) + (1 << 61), "assistant", "b."),
    ]


def test_odd_rows_with_clashing_names_equal_plain_python(spark):
    rows = odd_conversations()
    extra = ", audit string, place long, fault string, dropped boolean, cost string"
    df = spark.createDataFrame([(*r, "x", 7, "x", True, "x") for r in rows], COLUMNS + extra)
    got = _got(m.contract_reports(df.repartition(5)))
    want = _plain(rows)
    assert [r[:1] + r[2:] for r in got] == [r[:1] + r[2:] for r in want]
    assert [r[1] for r in got] == [min(r[1], m.LARGEST) for r in want]


def test_equal_rows_and_many_turns_of_one_conversation(spark):
    rows = [(1, 4, "user", "Hello.")] * 2_000 + [(2, t, "ua"[t % 2] + "x", f"t{t}.") for t in range(3_000)]
    df = spark.createDataFrame(rows, COLUMNS)
    assert _got(m.contract_reports(df)) == _plain(rows)


def test_repaired_rows(spark):
    rows = [(1, 0, "system", "Rules."), (1, 1, "assistant", "Hi."), (1, 2, "user", "  "), (2, 0, "user", "Q?"), (2, 1, "user", "R?")]
    got = m.repaired_rows(spark.createDataFrame(rows, COLUMNS)).orderBy("conv_id", "position").collect()
    assert [tuple(r) for r in got] == [
        (1, 1, "K", "system", "Rules."), (1, 2, "I", "user", ""), (1, 3, "K", "assistant", "Hi."),
        (2, 1, "K", "user", "Q?"), (2, 2, "R", "assistant", "R?"),
    ]


def test_empty_table(spark):
    none = spark.createDataFrame([], COLUMNS)
    assert m.contract_reports(none).collect() == [] and m.repaired_rows(none).collect() == []


def test_sql(spark, small_dir):
    got = m.contract_reports(spark.read.parquet(f"{small_dir}/conversations.parquet"))
    assert difference(got, connect(small_dir), m.ORACLE) is None
