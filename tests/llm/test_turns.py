"""Conversation repair against a plain search over all edits."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from functools import cache

import pyarrow as pa
import pytest

from quarryline.llm import turns

SPACE = " \t\n\x0b\x0c\r"
SCHEMA = "conv_id long, turn long, role string, text string, cost string, audit int"


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        k = zlib.crc32(":".join(" " if x is None else str(x) for x in (conv, turn)).encode()) % 20
        if k == 1:
            text = ""
        if k == 2:
            text = re.sub("[.!?]", "", text)
        if k == 4:
            role = "user"
        out += [(conv, turn, role, text)] * (0 if k == 0 else 2 if k == 3 else 1)
    return out


def plain(rows, conversations):
    """The contract, from the last turn to the first."""
    by = defaultdict(list)
    for conv, turn, role, text in rows:
        by[conv].append((turn is not None, turn or 0, role, text))
    out = {}
    for conv in conversations:
        own, seen, faults = sorted(by[conv]), set(), []
        for *_, role, text in own:
            bare = text.rstrip(SPACE)
            faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "" if bare[-1] in ".!?" else "truncated")
            seen.add((role, text))

        @cache
        def best(i, legal, inserted=0, own=own, faults=faults):
            """Cheapest (cost, audit, turns) from turn i on, after role initials ``legal`` shortened to what counts."""
            found = []
            if i == len(own):
                if legal in ("", "ua"):
                    found.append((0, "", ()))
            if inserted < 2:
                role = "assistant" if legal == "u" else "user"
                cost, audit, rest = best(i, "ua" if legal == "u" else "u", inserted + 1)
                found.append((cost + 5, "I" + audit, ((role, ""), *rest)))
            if i < len(own):
                *_, role, text = own[i]
                cost, audit, rest = best(i + 1, legal)
                found.append((cost + 2, "D" + audit, rest))
                if faults[i] not in ("blank", "duplicate"):
                    more = 5 * (faults[i] == "truncated")
                    for new, price, letter in ((role, 0, "K"), ("user", 1, "R"), ("assistant", 1, "R")):
                        x = new[:1]
                        if x == "s" and legal == "" and letter == "K":
                            after = "s"
                        elif x == "u" and legal in ("", "s", "ua"):
                            after = "u"
                        elif x == "a" and legal == "u":
                            after = "ua"
                        else:
                            continue
                        cost, audit, rest = best(i + 1, after)
                        found.append((cost + price + more, letter + audit, ((new, text), *rest)))
            return min(found, default=(10**9, "", ()))

        cost, audit, kept = best(0, "")
        known = [t for there, t, *_ in own if there]
        pairs = [a[2][:1] + b[2][:1] for a, b in zip(own, own[1:])]
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        count = Counter(faults)
        text = "\n".join(f"{r}:{t}" for r, t in kept)
        out[conv] = (gaps, count["blank"], count["duplicate"], count["truncated"], sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256(text.encode()).hexdigest()), list(kept)
    return out


def conversations(n=250, seed=1):
    rnd = random.Random(seed)
    rows = []
    for conv in range(n):
        at = 0
        for _ in range(rnd.choice([1, 2, 3, 5, 8, 12])):
            role = rnd.choice(["user", "assistant", "user", "assistant", "system", "tool", None, "", "User"])
            text = rnd.choice(["Yes.", "no", "Why?  \n", "", " \t", None, "é!", "a\x0b", "x .", "．", "ok. ", "long " * 50 + "."]) if rnd.random() < 0.6 else f"t{rnd.random()}."
            rows.append((conv, rnd.choice([at, at, at, None]), role, text))
            at += rnd.choice([0, 1, 1, 1, 3])
    return rows + [(None, 0, "user", "hi."), (None, 1, "assistant", "ho."), (n + 7, None, None, None), rows[3], rows[3]]


def held(spark, rows, given, want, **kw):
    frame = lambda rs: spark.createDataFrame([(*r, "x", 0) for r in rs], SCHEMA)
    source = frame(rows)
    repair = turns.Repair(spark, turns.damage(source) if given is None else frame(given), conversations=source)
    got = repair.digest()
    assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    got = got.collect()
    assert len(got) == len(want)
    wrong = [(r.conv_id, tuple(r[1:]), want[r.conv_id][0]) for r in got if tuple(r[1:]) != want[r.conv_id][0]]
    assert not wrong, wrong[:3]
    kept = defaultdict(list)
    for r in repair.turns().orderBy("n").collect():
        kept[r.conv_id].append((r.role, r.text))
        assert r.n == len(kept[r.conv_id]) - 1
    assert dict(kept) == {c: v[1] for c, v in want.items() if v[1]}


def test_repair(spark):
    rows = conversations()
    want = plain(damaged(rows), {r[0] for r in rows})
    held(spark, rows, None, want)
    assert {x for v in want.values() for x in v[0][6]} == set("KRD") and any(not v[0][6] for v in want.values())  # taking out a neighbour is cheaper than an insertion
    for _, kept in want.values():
        assert re.fullmatch("(s?(ua)+)?", "".join(r[:1] for r, _ in kept))


@pytest.mark.parametrize("bits", [1, 2])
def test_units_of_a_few_turns_give_the_same(spark, monkeypatch, bits):
    """Conversations over many units and several levels of matrices."""
    monkeypatch.setattr(turns, "UNIT_BITS", bits)
    monkeypatch.setattr(turns, "BATCH_ROWS", 100)
    rows = conversations(60, seed=bits)
    held(spark, rows, None, plain(damaged(rows), {r[0] for r in rows}))


def test_a_long_conversation(spark):
    """A conversation with a third of all rows is walked in units; equal rows are duplicates."""
    rnd = random.Random(9)
    rows = [(1, t, rnd.choice(["user", "assistant", "tool"]), rnd.choice(["same.", "", "cut", f"t{t}."])) for t in range(300)]
    rows += [(2, 0, "user", "again.")] * 150 + [(3 + i, t, "user" if t % 2 == 0 else "assistant", f"t{t}.") for i in range(50) for t in range(4)]
    held(spark, rows, rows, plain(rows, {r[0] for r in rows}))


def test_no_rows(spark):
    none = spark.createDataFrame([], SCHEMA)
    repair = turns.Repair(spark, none)
    assert repair.digest().count() == 0 and repair.turns().count() == 0
    lost = turns.Repair(spark, none, conversations=spark.createDataFrame([(5, 1, "user", "x", "", 1)], SCHEMA)).digest().first()
    assert tuple(lost) == (5, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_insertions_where_they_pay(spark, monkeypatch):
    """With dear deletions; matrices, walk and editor follow."""
    monkeypatch.setattr(turns, "DELETE", 9)
    monkeypatch.setattr(turns, "EDITS", turns.edits())
    rows = [(1, 0, "user", "a."), (2, 0, "system", "s."), (3, 0, "assistant", "x."), (3, 1, "assistant", "y."), (3, 2, "assistant", "z."), (4, 0, "user", "")]
    repair = turns.Repair(spark, spark.createDataFrame([(*r, "", 0) for r in rows], SCHEMA))
    assert {r.conv_id: (r.cost, r.audit) for r in repair.report.collect()} == {1: (5, "KI"), 2: (6, "IR"), 3: (6, "IKRK"), 4: (9, "D")}
    kept = {(r.conv_id, r.n): (r.role, r.text) for r in repair.turns().collect()}
    assert kept[3, 0] == ("user", "") and kept[3, 2] == ("user", "y.") and kept[1, 1] == ("assistant", "")


def test_edits_are_all_that_matter():
    """Moves from every state: deletion, keeping where the grammar wants the initial, another role, each with one insertion or none."""
    assert sorted({r[5] for r in turns.EDITS}) == ["D", "IK", "IR", "K", "R"]
    assert ("s", False, turns.START, turns.SYSTEM, 0, "K") in turns.EDITS and not [r for r in turns.EDITS if r[0] == "s" and "K" in r[5] and r[2] != turns.START]
    one = pa.table({"conv": ["c"], "unit": [0], "position": [0], "initial": ["u"], "blank": [False], "duplicate": [False], "truncated": [False], "head": [True]})
    assert sorted(map(tuple, (r.values() for r in turns.walk_turns(one, turns.EDITS).to_pylist()))) == [("c", 0, 0, 0, 2, "D"), ("c", 0, 0, 2, 0, "K"), ("c", 0, 0, 3, 6, "IR")]
