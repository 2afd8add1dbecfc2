import hashlib
import random
import zlib

import pytest

from procweave.llm import conversations as cv

SPACES = "\t\n\x0b\x0c\r "


def closure(states):
    out = dict(states)
    for _ in range(2):
        for s, (c, a) in list(out.items()):
            option = c + 3, a + "I"
            end = 3 if s == 2 else 2
            if end not in out or option < out[end]:
                out[end] = option
    return out


def relax(turns, begin=0):
    """Cheapest edits to every state of the grammar by plain relaxation over states."""
    states = {begin: (0, "")}
    for t in turns:
        reached = {}

        def offer(s, cost, audit):
            if s not in reached or (cost, audit) < reached[s]:
                reached[s] = cost, audit

        for s, (c, a) in closure(states).items():
            offer(s, c + 4, a + "D")
            if t != "x":
                cost, end = c + (3 if t.isupper() else 0), 3 if s == 2 else 2
                offer(end, cost + 3, a + "R")
                if t.lower() == ("a" if end == 3 else "u"):
                    offer(end, cost, a + "K")
                if s == 0 and t.lower() == "s":
                    offer(1, cost, a + "K")
        states = reached
    return closure(states)


def test_blocks_equal_relaxation():
    rng = random.Random(1)
    for _ in range(1500):
        turns = "".join(rng.choice("uauauasoxUASO") for _ in range(rng.randrange(0, 13)))
        for whole in (False, True):
            got = {(b, e): (c, a) for b, e, c, a in cv.ways(turns, whole)}
            for b in (0,) if whole else range(4):
                want = relax(turns, b)
                for e in (0, 3) if whole else range(4):
                    assert got.get((b, e)) == want.get(e)


def brute(rows):
    """rows (conv, turn, role, text) after damage; per conversation the contract's columns."""
    out, by = {}, {}
    for conv, turn, role, text in rows:
        by.setdefault(conv, []).append((turn is not None, turn or 0, hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest(), role, text))
    for conv, turns in by.items():
        turns.sort(key=lambda r: r[:3])
        seen, codes, faults = set(), "", []
        for _, _, _, role, text in turns:
            shown = text.rstrip(SPACES)
            fault = "b" if not shown else "d" if (role, text) in seen else "t" if shown[-1] not in ".!?" else "-"
            seen.add((role, text))
            letter = role[:1] if role[:1] in ("s", "u", "a") else "o"
            codes += "x" if fault in "bd" else letter.upper() if fault == "t" else letter
            faults.append(fault)
        initials = [r[3][:1] for r in turns]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        ends = relax(codes)
        cost, audit = min(ends[s] for s in (0, 3) if s in ends)
        lines, state, at = [], 0, 0
        for edit in audit:
            role, text = (None, "") if edit == "I" else turns[at][3:]
            at += edit != "I"
            if edit == "D":
                continue
            if state == 0 and edit == "K" and role[:1] == "s":
                state = 1
            else:
                state = 3 if state == 2 else 2
                role = role if edit == "K" else "user" if state == 2 else "assistant"
            lines.append(f"{role}:{text}")
        told = [r[1] for r in turns if r[0]]
        gaps = max(told) - min(told) + 1 - len(set(told)) if told else 0
        digest = hashlib.sha256("\n".join(lines).encode()).hexdigest()
        out[conv] = (gaps, *(faults.count(f) for f in "bdt"), illegal, cost, audit, digest, lines)
    return out


def damage(rows):
    for conv, turn, role, text in rows:
        case = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if case == 1:
            text = ""
        elif case == 2:
            text = text.translate({ord(c): None for c in ".!?"})
        elif case == 4:
            role = "user"
        yield from [(conv, turn, role, text)] * (0 if case == 0 else 2 if case == 3 else 1)


def sample():
    rng = random.Random(9)
    rows = []
    for conv in range(60):
        for turn in range(rng.randrange(1, 12)):
            role = rng.choice(["system", "user", "assistant", "user", "assistant", "tool", "", None, "USER"]) if rng.random() < 0.3 else ("user", "assistant")[turn % 2]
            text = rng.choice(["Yes.", "No!", "Why?", " \t\n", "", None, "cut off", "Ünï. \r\n", "é", "x" * 50_000 + "."]) if rng.random() < 0.5 else f"Turn {turn} of {conv}."
            rows.append((conv if conv else None, None if rng.random() < 0.05 else turn + rng.choice([0, 0, 0, 5]), role, text))
    rows += rows[:40]
    # One conversation with as many rows as the others together, over several blocks and ranges, and many copies of one turn.
    rows += [(1000, t // 2, ("user", "assistant", "assistant", "system")[t * 7 % 11 % 4], f"Text {t % 90}" + "."[t % 3 == 0 :]) for t in range(500)]
    rows += [(1000, 77, "user", "Again.")] * 300
    return rows


FIELDS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("conv") / "conversations.parquet")
    rows = [(*r, "clash", 1) for r in sample()]
    random.Random(1).shuffle(rows)
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, kind string, n int").repartition(5).write.parquet(path)
    return spark.read.parquet(path)


def test_damaged_conversations_equal_brute_force(stored):
    ids = {r[0] for r in sample()}
    want = {c: r[:-1] for c, r in brute(list(damage(sample()))).items()}
    empty = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    got = cv.report(cv.damaged(stored), stored.selectExpr("conv_id AS conv")).collect()
    assert len(got) == len(ids)
    assert {r["conv"]: tuple(r[f] for f in FIELDS) for r in got} == {i: want.get(i, empty) for i in ids}


def test_repaired_turns(stored):
    plain = [(c, t, r or "", x or "") for c, t, r, x in sample()]
    want = {c: r[-1] for c, r in brute(plain).items() if r[-1]}
    got = {}
    for r in sorted(cv.repaired(cv.as_turns(stored)).collect(), key=lambda r: r["position"]):
        got.setdefault(r["conv"], []).append(f"{r['role']}:{r['text']}")
    assert got == want


def test_empty(spark, stored):
    none = stored.filter("conv_id < -5")
    assert cv.report(cv.damaged(none), none.selectExpr("conv_id AS conv")).count() == 0
