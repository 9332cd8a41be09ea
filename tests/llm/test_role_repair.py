"""Conversation repair against a brute-force search over all edits."""

import hashlib
import re
import zlib

import numpy as np
import pytest

from riskframe.llm import role_repair as rr
from riskframe.llm.queries import QUERIES
from tests.conftest import SF001

SCHEMA = "conv_id long, turn long, role string, text string"
FINE = re.compile(r"(s?(ua)+)?\Z")


def _brute(syms):
    """The least (cost, audit, roles) over all edits, by trying them in
    order of cost; at most two inserts in a row help."""
    best = None

    def go(i, cost, audit, roles, run):
        nonlocal best
        if best and cost > best[0]:
            return
        if i == len(syms):
            if FINE.match(roles) and (best is None or (cost, audit) < best[:2]):
                best = (cost, audit, roles)
        else:
            role, fault = syms[i]
            late = 3 if fault == "t" else 0
            go(i + 1, cost + 4, audit + "D", roles, 0)
            if fault not in "bd":
                go(i + 1, cost + late, audit + "K", roles + role, 0)
                for r in "ua":
                    go(i + 1, cost + 3 + late, audit + "R", roles + r, 0)
        if run < 3:
            for r in "ua":
                go(i, cost + 3, audit + "I", roles + r, run + 1)
    go(0, 0, "", "", 0)
    return best


def test_stack_finds_the_least_cost_and_audit():
    table, rng = rr.lr_table(), np.random.default_rng(5)
    for _ in range(400):
        syms = [(rng.choice(list("suao"), p=[.15, .4, .4, .05]), rng.choice(list("-tbd"), p=[.6, .2, .1, .1]))
                for _ in range(rng.integers(0, 6))]
        stack = rr.Stack(table)
        for r, f in syms:
            stack.read(r, f)
        cost, audit, roles = _brute(syms)
        assert stack.best() == (cost, audit), syms
        acts, tail = rr.edits([(r + f, 1) for r, f in syms], audit)
        got = "".join(re.sub("[DKR]", "", a) if "K" not in a else a[:-1] + s[0] for a, s in zip(acts, syms)) + "".join(tail)
        assert got == roles, (syms, audit)


def test_copies_count_as_deleted_rows():
    table = rr.lr_table()
    for syms in ([("u", "-", 3), ("a", "-", 1)], [("a", "-", 2), ("a", "t", 4)], [("s", "b", 2), ("u", "-", 5)]):
        one, many = rr.Stack(table), rr.Stack(table)
        for r, f, n in syms:
            one.read(r, f, n)
            many.read(r, f)
            for _ in range(n - 1):
                many.read(r, "b" if f == "b" else "d")
        assert one.best() == many.best()


def test_long_conversations_share_what_their_audits_begin_with():
    table, rng = rr.lr_table(), np.random.default_rng(1)
    stack = rr.Stack(table)
    n = 30_000
    for i in range(n):
        stack.read("ua"[i % 2] if rng.random() < 0.9 else rng.choice(list("suao")), rng.choice(list("--tbd")))
    cost, audit = stack.best()
    assert sum(x != "I" for x in audit) == n and cost > 0
    assert max(len(p.tail) for p in stack.tops.values()) < 2000


def _reference(rows):
    """Per conversation the contract's values, in plain Python."""
    said = lambda x: " " if x is None else str(x)
    convs = {}
    for c, turn, role, text in rows:
        mine = convs.setdefault(c, [])
        kind = zlib.crc32(f"{said(c)}:{said(turn)}".encode()) % 20
        role, text = said(role), said(text)
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        mine += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    out = {}
    for c, mine in convs.items():
        mine.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, syms, n = set(), [], dict.fromkeys("bdt-", 0)
        for _, role, text in mine:
            core = text.strip(" \t\n\x0b\x0c\r")
            f = "b" if not core else "d" if (role, text) in seen else "t" if core[-1] not in ".!?" else "-"
            seen.add((role, text))
            n[f] += 1
            syms.append((role[:1] if role[:1] in ("s", "u", "a") else "o", f))
        turns = [t for t, _, _ in mine if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(syms, syms[1:]))
        cost, audit, roles = _brute(syms)
        lines, i, j = [], 0, 0
        for x in audit:
            full = {"u": "user", "a": "assistant"}
            if x == "I":
                lines.append(full[roles[j]] + ":")
            elif x != "D":
                lines.append((mine[i][1] if x == "K" else full[roles[j]]) + ":" + mine[i][2])
            j += x != "D"
            i += x != "I"
        out[c] = (gaps, n["b"], n["d"], n["t"], illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


COLUMNS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def _run(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA + ", pos long, block int, n string, sym int") \
        if rows and len(rows[0]) > 4 else spark.createDataFrame(rows, SCHEMA)
    return rr.repair_report(df, rr.damage(df)).collect()


def test_query_matches_brute_force_on_odd_rows(spark):
    rng = np.random.default_rng(9)
    texts = ["Yes.", "No", "", "  \t", None, "What?", "Ende\x85", "so.\x0b ", "a\nb!", "Z. x"]
    rows = [(int(rng.integers(0, 120)) if rng.random() > 0.02 else None, int(rng.integers(0, 9)) if rng.random() > 0.1 else None,
             str(rng.choice(["user", "assistant", "system", "tool", "u", ""])) if rng.random() > 0.05 else None,
             texts[rng.integers(0, len(texts))]) for _ in range(330)]
    rows += [(1000, t, None, None) for t in range(3)] + [(1001, None, "user", "Hi.")] * 4
    rows += [(2000 + i, 0, "user", "x" * 100_000 + ".") for i in range(25)]       # some lose their only row
    want = {c: v for c, v in _reference(rows).items()}
    got = _run(spark, [(*r, 7, 7, "x", 7) for r in rows])                         # columns of clashing names
    assert len(got) == len(want) == len({r.conv_id for r in got})
    for r in got:
        assert tuple(r[c] for c in COLUMNS) == want[r.conv_id], r
    assert any(v[6] == "" for v in want.values())


def test_blocks_of_a_conversation_meet(spark, monkeypatch):
    monkeypatch.setattr(rr, "BLOCK", 2)
    rows = [(c, t, ["user", "assistant"][t % 2] if t != 3 else "user", f"t{t}.") for c in range(12) for t in range(6)]
    want = _reference(rows)
    for r in _run(spark, rows):
        assert tuple(r[c] for c in COLUMNS) == want[r.conv_id], r


def test_repaired_rows(spark):
    rows = [(1, 0, "assistant", "A."), (1, 1, "user", "B?"), (1, 1, "user", "B?"), (1, 5, "tool", "C.")]
    repaired, report = rr.repair(spark.createDataFrame(rows, SCHEMA))
    got = [(r.turn, r.role, r.text, r.action) for r in repaired.orderBy("pos", "sub").collect()]
    r = report.first()
    assert (r.gaps, r.duplicate, r.cost) == (3, 1, 10)
    assert got == [(None, "user", "", "insert"), (0, "assistant", "A.", "keep"), (1, "user", "B?", "keep"),
                   (5, "assistant", "C.", "rerole")]


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert rr.repair_report(df, rr.damage(df)).collect() == []


def test_query_on_the_table(spark):
    got = {r.conv_id: r for r in QUERIES["op13_role_repair"](spark, SF001).collect()}
    rows = [tuple(r) for r in spark.read.parquet(f"{SF001}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    short = [c for c in got if sum(r[0] == c for r in rows) <= 5]
    want = _reference([r for r in rows if r[0] in set(short)])
    assert len(got) == len({r[0] for r in rows}) and len(short) >= 10
    for c in short:
        assert tuple(got[c][k] for k in COLUMNS) == want[c]
