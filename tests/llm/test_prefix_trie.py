"""The node table against a plain trie, its hash, long conversations and edge cases."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from noteframe.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, depth string, part int, r int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, 2) for r in rows], SCHEMA)


def plain_trie(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()[:16]
            own[conv].append((turn is not None, turn or 0, digest, role, text))
    own = {c: [(x[3], x[4]) for x in sorted(turns)] for c, turns in own.items()}
    members, last = defaultdict(list), defaultdict(list)
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        whole = tuple(own.get(c - c % 5, [])[:h] + own[c][h:])
        for d in range(len(whole) + 1):
            members[whole[:d]].append(c)
        last[whole].append(c)
    children = defaultdict(set)
    for node in members:
        if node:
            children[node[:-1]].add(node)
    leaves, saved = defaultdict(int), defaultdict(int)
    for node in sorted(members, key=len, reverse=True):
        leaves[node] = sum(leaves[k] for k in children[node]) if children[node] else 1
        size = len(node[-1][1].encode()) if node else 0
        saved[node] = sum(saved[k] for k in children[node]) + (len(members[node]) - 1) * size
    return sorted(
        (
            min(held), len(node), min(members[node[:-1]]) if node else None, len(held), len(children[node]), leaves[node], saved[node],
            hashlib.sha256(",".join(map(str, sorted(last[node]))).encode()).hexdigest(),
        )
        for node, held in members.items()
    )


def got(spark, rows, plan=prefix_trie.PLAN):
    found = prefix_trie.trie(frame(spark, rows), plan)
    assert found.columns == prefix_trie.OUT
    return sorted(map(tuple, found.collect()), key=lambda r: (r[0], r[1]))


def made(seed, convs, turns):
    random.seed(seed)
    words = ["a", "b", "é", "dd", ""]
    rows = []
    for c in convs:
        for t in range(random.randint(1, turns)):
            rows.append((c, t, random.choice(["user", "bot"]), random.choice(words) * random.randint(1, 2)))
    random.shuffle(rows)
    return rows


TIGHT = prefix_trie.PrefixTrie(subtree_rows=4, shard_nodes=8, band_nodes=40, hot_rows=10, page=8)


@pytest.mark.parametrize("plan", [prefix_trie.PLAN, TIGHT])
def test_equals_plain_trie(spark, plan):
    rows = made(1, [c for c in range(150) if c % 7], 12)
    assert got(spark, rows, plan) == plain_trie(rows)


def test_hot_conversation_and_hot_start(spark):
    long = [(1, t, "user", f"t{t % 3}") for t in range(2_500)]
    same = [(c, t, "bot", "same") for c in range(10, 110) for t in range(4)]
    tight = prefix_trie.PrefixTrie(subtree_rows=300, shard_nodes=100, band_nodes=700, hot_rows=100, page=16)
    assert got(spark, long + same, tight) == plain_trie(long + same)


def test_odd_rows(spark):
    rows = [(0, None, None, None), (0, 1, "user", "x"), (0, 1, "user", "x"), (0, 1, "bot", "y"), (None, 1, "user", "lost")]
    rows += [(7, 0, "u", "only"), (3, 5, "user", "z" * 200_000), (3, None, "user", "日本"), (2**62, 1, "a", "b"), (2**62, 1, "ab", "")]
    rows += [(-3, 1, "user", "m"), (-5, 0, "user", "n"), (-5, 1, None, "o")]
    assert got(spark, rows) == plain_trie(rows)
    assert got(spark, []) == []
    assert got(spark, [(None, 1, "user", "x")]) == []
    turnless = next(c for c in range(1, 500) if zlib.crc32(str(c).encode()) % 9 == 8 and c % 5)
    assert got(spark, [(turnless, 0, "user", "x")]) == plain_trie([(turnless, 0, "user", "x")])


def test_perfect_hash_is_minimal_and_verified():
    rng = np.random.default_rng(3)
    for n in (0, 1, 2, 5_000):
        a, b = rng.integers(0, 2**63, (2, n)).astype(np.uint64)
        table = prefix_trie.PerfectHash(a, b)
        assert sorted(table.slots(a, b).tolist()) == list(range(n))
        assert (table.slots(b, a) == -1).all()
    with pytest.raises(ValueError):
        prefix_trie.PerfectHash(np.array([1, 1], np.uint64), np.array([2, 2], np.uint64))
