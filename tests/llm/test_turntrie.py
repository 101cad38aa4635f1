"""The trie against plain prefixes in Python, long conversations cut into paths, shared shards, and odd rows."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from panelgrid.llm import turntrie
from panelgrid.llm.turntrie import DoubleArray, prefix_trie

SCHEMA = "conv_id long, turn int, role string, text string"


def brute(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            code = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()[:16]
            own[c].append(((turn is not None, turn or 0, code), (role, text)))
    turns = {c: [t for _, t in sorted(v)] for c, v in own.items()}
    paths = {}
    for c in turns:
        h, base = zlib.crc32(str(c).encode()) % 6, c - int(abs(c) % 100 * (1 if c >= 0 else -1))
        paths[c] = tuple(turns.get(base, [])[:h] + turns[c][h:])
    members = defaultdict(list)
    for c, p in paths.items():
        for d in range(len(p) + 1):
            members[p[:d]].append(c)
    children = defaultdict(set)
    for p in members:
        if p:
            children[p[:-1]].add(p)

    def below(p):
        todo = [p]
        while todo:
            p = todo.pop()
            yield p
            todo += children[p]

    out = set()
    for p, m in members.items():
        sub = list(below(p))
        ends = ",".join(map(str, sorted(c for c in m if len(paths[c]) == len(p))))
        out.add((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(children[p]), sum(not children[s] for s in sub),
                 sum((len(members[s]) - 1) * len(s[-1][1]) for s in sub if s), hashlib.sha256(ends.encode()).hexdigest()))
    return out


def result(frame):
    rows = [tuple(r) for r in frame.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def rows_of(seed, conversations, longest):
    pick = random.Random(seed)
    texts = ["", "a", "bé", "c d", "e" * 30]
    for i in range(conversations):
        c = pick.choice([i, i * 7, 100 * (i % 9)]) if i % 3 else i
        for turn in range(pick.randint(1, longest)):
            yield c, turn, "user" if turn % 2 == 0 else "assistant", texts[0 if pick.random() < 0.7 else pick.randrange(5)]


@pytest.mark.parametrize("path,shard", [(64, 100_000), (3, 20)])
def test_equals_plain_prefixes(spark, monkeypatch, path, shard):
    monkeypatch.setattr(turntrie, "PATH", path)
    monkeypatch.setattr(turntrie, "SHARD", shard)
    monkeypatch.setattr(turntrie, "PIECE", 4)
    rows = list(rows_of(5, 260, 11))
    assert result(prefix_trie(spark.createDataFrame(rows, SCHEMA))) == brute(rows)


def test_many_copies_and_a_long_conversation(spark, monkeypatch):
    monkeypatch.setattr(turntrie, "SHARD", 200)
    rows = [(1000 + i, t, "user", f"turn {t}") for i in range(400) for t in range(3)]
    rows += [(9, t, "user", f"turn {t % 5}") for t in range(500)]
    assert result(prefix_trie(spark.createDataFrame(rows, SCHEMA))) == brute(rows)


def test_odd_rows(spark):
    rows = [(1, None, None, None), (1, 0, "user", None), (1, 0, "user", None), (1, 0, None, "x"), (None, 0, "user", "lost"), (-150, 0, "a", "b"), (-100, 0, "q", "r"), (-100, 1, "q", "s"),
            (205, 3, "user", "only one turn"), (100, 0, "long", "ü" * 100_000), (101, 0, "long", "ü" * 100_000), (101, 1, "", "")]
    frame = spark.createDataFrame([(*r, "k", 7) for r in rows], f"{SCHEMA}, key string, depth int")
    got = result(prefix_trie(frame))
    assert got == brute(rows) and any(r[2] is None and r[1] == 0 for r in got)
    assert prefix_trie(frame.limit(0)).count() == 0
    alone = result(prefix_trie(spark.createDataFrame([(5, 0, "u", "t")], SCHEMA)))
    assert alone == brute([(5, 0, "u", "t")])


def test_double_array():
    pick = random.Random(1)
    paths = sorted({(0, *(pick.randrange(40) + 1 for _ in range(pick.randint(0, 5)))) for _ in range(500)})
    trie = DoubleArray([list(p) for p in paths], 41)
    states = {}
    for p in paths:
        for d, state in enumerate(trie.walk(list(p))):
            assert states.setdefault(state, p[: d + 1]) == p[: d + 1]
    assert len(states) == len({p[: d + 1] for p in paths for d in range(len(p))})
    with pytest.raises(KeyError):
        trie.walk([0, 41, 41, 41, 41, 41, 41])
