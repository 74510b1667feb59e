import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from veilframe.llm import repair

SCHEMA = "conv_id long, turn long, role string, text string, cost string"
BLANKS = " \t\n\x0b\x0c\r"


def brute_edits(rows):
    """(cost, audit, repaired rows) by a plain DP over suffixes that carries whole edit lists; rows are (role, text, fault)."""
    steps = {("start", "s"): "sys", ("start", "u"): "user", ("sys", "u"): "user", ("user", "a"): "done", ("done", "u"): "user"}
    states, other = ("start", "sys", "user", "done"), {"u": "user", "a": "assistant"}

    def inserted(best):
        for _ in range(4):
            for s in states:
                for initial in "ua":
                    to = steps.get((s, initial))
                    if to in best:
                        c, audit, out = best[to]
                        new = (c + 5, "I" + audit, ((other[initial], ""), *out))
                        if s not in best or new[:2] < best[s][:2]:
                            best[s] = new
        return best

    best = inserted({"start": (0, "", ()), "done": (0, "", ())})
    for role, text, fault in reversed(rows):
        now = {}
        for s in states:
            found = []
            if s in best:
                c, audit, out = best[s]
                found.append((c + 2, "D" + audit, out))
            if fault in ("", "truncated"):
                more = 5 if fault else 0
                to = steps.get((s, role[:1]))
                if to in best:
                    c, audit, out = best[to]
                    found.append((c + more, "K" + audit, ((role, text), *out)))
                for initial, name in other.items():
                    to = steps.get((s, initial))
                    if to in best:
                        c, audit, out = best[to]
                        found.append((c + 1 + more, "R" + audit, ((name, text), *out)))
            if found:
                now[s] = min(found, key=lambda x: x[:2])
        best = inserted(now)
    return best["start"]


def faults_of(rows):
    seen, out = set(), []
    for role, text in rows:
        kept = text.strip(BLANKS)
        fault = "blank" if not kept else "duplicate" if (role, text) in seen else "" if kept[-1] in ".!?" else "truncated"
        seen.add((role, text))
        out.append(fault)
    return out


def brute(rows):
    conversations = {}
    for conv, turn, role, text, *_ in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kept = conversations.setdefault(conv, [])
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind == 0:
            continue
        given = role
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        role = "user" if kind == 4 else role
        for _ in range(2 if kind == 3 else 1):
            kept.append((turn is not None, turn or 0, given, hashlib.sha256(text.encode()).hexdigest(), role, text))
    out = []
    for conv, kept in conversations.items():
        kept.sort()
        said = [(r, t) for *_, r, t in kept]
        faults = faults_of(said)
        turns = [k[1] for k in kept if k[0]]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(said, said[1:]))
        cost, audit, repaired = brute_edits([(r, t, f) for (r, t), f in zip(said, faults)])
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in repaired).encode()).hexdigest()
        out.append((conv, gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, digest))
    return sorted(out, key=str)


def got(df):
    made = repair.repaired_conversations(df)
    assert [t for _, t in made.dtypes] == ["bigint"] * 7 + ["string"] * 2
    return sorted((tuple(r) for r in made.collect()), key=str)


def conversations(seed, n, longest=9):
    choose = random.Random(seed)
    rows = []
    for c in range(n):
        for t in range(choose.randrange(1, longest)):
            rows.append((c, choose.choice([t, t, t, t, t + 3, None]), choose.choice(["user", "assistant", "user", "assistant", "system", "tool", None, "", "unit"]),
                         choose.choice([f"one {t}.", f"two {t}?", f"cut {t}", "Yes!", " \t", "end. \n", None, "é。", "…!"]), "x"))
    return rows


@pytest.mark.parametrize("seed", range(2))
def test_equals_brute_force(frame, seed):
    rows = conversations(seed, 150)
    assert got(frame(rows, SCHEMA, 4)) == brute(rows)


def test_long_conversation_in_many_blocks(frame, monkeypatch):
    """Blocks of 8 rows: products are carried over blocks, and states into them."""
    monkeypatch.setattr(repair, "BLOCK_BITS", 3)
    choose = random.Random(5)
    rows = [(7, t, choose.choice(["user", "assistant", "system"]), choose.choice([f"so {t}.", f"cut {t}", "Yes!", f"well {t}?"]), "x") for t in range(400)]
    rows += [(8, t, "user" if t % 2 == 0 else "assistant", f"fine {t}.", "x") for t in range(60)]
    assert got(frame(rows, SCHEMA, 3)) == brute(rows)


def test_odd_tables(frame):
    assert got(frame([], SCHEMA)) == []
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    assert got(frame([(gone, 0, "user", "a.", "x")], SCHEMA)) == [(gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
    rows = [(None, None, None, None, None)] * 3 + [(3, 1, "user", "same.", "x")] * 20 + [(4, None, "user", "z" * 3_000_000 + ".", "x"), (4, None, "assistant", "ok.", "x")]
    assert got(frame(rows, SCHEMA)) == brute(rows)


def test_solve_from_every_state():
    """Blocks of random rows, from each state, against the plain DP."""
    choose = random.Random(9)
    roles, states = ("system", "user", "assistant", "tool"), ((), ("system",), ("user",), ("user", "assistant"))
    for _ in range(60):
        rows = [(choose.choice(roles), f"{i}.", choose.choice(["", "", "", "blank", "duplicate", "truncated"])) for i in range(choose.randrange(0, 7))]
        code = np.array([roles.index(r) if r != "tool" else 3 for r, _, _ in rows], np.int64)
        fault = np.array([["", "blank", "duplicate", "truncated"].index(f) for *_, f in rows], np.int64)
        made = repair.solve([(code, fault, repair.ACCEPTING, True)] * 2)
        assert made[0] == made[1]
        assert made[0][0][0] == brute_edits(rows)[1]
        assert len(states) == len(made[0]) and all(leaves in (repair.START, repair.ANSWERED) for _, leaves in made[0])
