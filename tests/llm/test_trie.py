import hashlib
import random
import zlib

import pytest

from veilframe.llm import trie

SCHEMA = "conv_id long, turn long, role string, text string, n_convs string"


def content(role, text):
    return hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()


def brute(rows):
    """All rebuilt sequences, written out, and every node by looking at all of them."""
    own = {}
    for conv, turn, role, text, *_ in rows:
        if conv is not None:
            own.setdefault(conv, []).append((turn is not None, turn or 0, role or "", content(role or "", text or ""), text or ""))
    own = {c: [(r, t) for *_, r, _, t in sorted(x)] for c, x in own.items()}
    sequences = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (c % 100 if c >= 0 else -(-c % 100))
        sequences[c] = tuple(own.get(base, [])[:h] + turns[h:])
    members = {}
    for c, s in sequences.items():
        for d in range(len(s) + 1):
            members.setdefault(s[:d], set()).add(c)
    out = []
    for node, convs in members.items():
        d = len(node)
        below = [n for n in members if n[:d] == node]
        ends = ",".join(map(str, sorted(c for c in convs if len(sequences[c]) == d)))
        out.append((min(convs), d, min(members[node[:-1]]) if node else None, len(convs), sum(len(n) == d + 1 for n in below),
                    sum(not any(m[:-1] == n and m for m in members) for n in below),
                    sum((len(members[n]) - 1) * len(n[-1][1]) for n in below if n), hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def got(df):
    made = trie.prefix_trie(df)
    assert all(t in ("bigint", "string") for _, t in made.dtypes)
    return sorted((tuple(r) for r in made.collect()), key=str)


def conversations(seed, n, turns=9, words=("ok", "go on", "why", "")):
    choose = random.Random(seed)
    rows = []
    for c in choose.sample(range(-150, 450), n):
        for t in range(choose.randrange(1, turns)):
            rows.append((c, choose.choice([t, t, t, None]), choose.choice(["user", "assistant", None]), choose.choice([*words, None, f"text {choose.randrange(4)} é"]), "x"))
    return rows


@pytest.mark.parametrize("seed", range(3))
def test_equals_brute_force(frame, seed):
    rows = conversations(seed, 60)
    assert got(frame(rows, SCHEMA, 4)) == brute(rows)


def test_conversation_over_many_partitions_and_copies(frame):
    """One conversation with most rows, and copies of one another that share all nodes."""
    rows = [(100, t, "user" if t % 2 else "assistant", f"turn {t % 7}", "x") for t in range(300)]
    rows += [(c, t, "user", f"same {t}", "x") for c in range(101, 140) for t in range(12)]
    assert got(frame(rows, SCHEMA, 6)) == brute(rows)


def test_repeated_rows_and_rows_of_no_conversation(frame):
    rows = [(5, 1, "user", "a", None)] * 7 + [(None, 1, "user", "a", None), (6, None, None, None, None), (7, 2, "user", "a", "y"), (7, 2, "assistant", "a", "y")]
    assert got(frame(rows, SCHEMA)) == brute(rows)


def test_turnless_conversation_is_a_member_of_the_root(frame):
    short = next(c for c in range(101, 200) if zlib.crc32(str(c).encode()) % 6 > 1)  # its base, 100, is absent
    rows = [(short, 0, "user", "lost", "x")]
    assert got(frame(rows, SCHEMA)) == [(short, 0, None, 1, 0, 1, 0, hashlib.sha256(str(short).encode()).hexdigest())] == brute(rows)


def test_empty_table(frame):
    assert got(frame([], SCHEMA)) == []


def test_equal_fingerprints_are_seen_and_made_anew(frame, monkeypatch):
    """With a base of 0 only the last turn counts: unlike conversations share nodes until other bases are taken."""
    bases = trie._bases
    tried = []

    def weak(attempt):
        tried.append(attempt)
        return (PRIME_ROOT, PRIME_ROOT) if attempt == 0 else bases(attempt)

    PRIME_ROOT = trie.PRIME - 1  # of order two: a turn's place counts only as odd or even
    monkeypatch.setattr(trie, "_bases", weak)
    free = [c for c in range(1000, 3000) if zlib.crc32(str(c).encode()) % 6 == 0]
    one, two = free[:2]
    rows = [(one, t, "user", x, "x") for t, x in enumerate("abc")] + [(two, t, "user", x, "x") for t, x in enumerate("cba")]
    assert got(frame(rows, SCHEMA)) == brute(rows)
    assert tried == [0, 1]
