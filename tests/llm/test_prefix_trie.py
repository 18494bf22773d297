"""Operator 11 against a trie built node by node."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from lumenry.llm import prefix_trie


def plain_trie(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(v, key=lambda t: t[:2])] for c, v in own.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        seq = tuple(own.get(c - c % 5, [])[:h] + own[c][h:])
        for d in range(len(seq) + 1):
            members[seq[:d]].append(c)
        ends[seq].append(c)
    children, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for node in members:
        if node:
            children[node[:-1]] += 1
    for node in members:
        gain = (len(members[node]) - 1) * len(node[-1][1].encode()) if node else 0
        for d in range(len(node) + 1):
            saved[node[:d]] += gain
            leaves[node[:d]] += not children[node]
    out = []
    for node, own_members in members.items():
        sha = hashlib.sha256(",".join(map(str, sorted(ends.get(node, [])))).encode()).hexdigest()
        out.append((min(own_members), len(node), min(members[node[:-1]]) if node else None, len(own_members), children[node], leaves[node], saved[node], sha))
    return sorted(out, key=str)


def nodes(spark, rows, folder):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("depth", F.lit(1)).withColumn("cum", F.lit("x"))
    df.write.mode("overwrite").parquet(f"{folder}/conversations.parquet")
    out = prefix_trie.op11(spark, str(folder))
    assert out.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted(map(tuple, out.collect()), key=str)


def made(rng, convs, texts, longest=7):
    rows = []
    for c in range(convs):
        if rng.random() < 0.9:
            rows += [(c, t, rng.choice(["u", "a", None]) if texts > 3 else "u", rng.choice(["é" * k if k else None for k in range(texts)])) for t in range(rng.randint(1, longest))]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("block", "seed", "texts"), [(2, 1, 2), (7, 2, 2), (7, 3, 4), (4096, 4, 3)])
def test_nodes_equal_the_plain_trie(spark, tmp_path, monkeypatch, block, seed, texts):
    monkeypatch.setattr(prefix_trie, "BLOCK_ROWS", block)
    monkeypatch.setattr(prefix_trie, "CHUNK_IDS", 3)
    rng = random.Random(seed)
    rows = made(rng, 90, texts)
    rows += [(1000 + 5 * k, t, "u", f"copy {t}") for k in range(25) for t in range(12)]
    rows += [(2001, 0, "u", "alone, its base is missing"), (None, 1, "u", "nobody's"), (2005, None, None, None), (2005, 3, "u", "later"), (2010, 1, "u", "x" * 100_000)]
    rows += [(2015, t, "u", "same") for t in (1, 1, 1)] + [(-7, 0, "u", "below nought")]
    assert nodes(spark, rows, tmp_path) == plain_trie(rows)


def test_few_conversations(spark, tmp_path):
    assert nodes(spark, [], tmp_path) == []
    empty = hashlib.sha256(b"").hexdigest()
    turnless = next(c for c in range(1, 100) if c % 5 and zlib.crc32(str(c).encode()) % 9 >= 1)
    assert nodes(spark, [(turnless, 0, "u", "gone")], tmp_path) == [(turnless, 0, None, 1, 0, 1, 0, hashlib.sha256(str(turnless).encode()).hexdigest())]
    one = nodes(spark, [(5, 0, "u", "a"), (5, 1, "u", "b")], tmp_path)
    assert [r[:7] for r in one] == [(5, 0, None, 1, 1, 1, 0), (5, 1, 5, 1, 1, 1, 0), (5, 2, 5, 1, 0, 1, 0)] and one[0][7] == one[1][7] == empty


def test_smaller_values_by_search():
    rng = random.Random(1)
    for _ in range(300):
        lcp = [-1] + [rng.randint(0, 4) for _ in range(rng.randint(0, 20))] if rng.random() < 0.5 else [rng.randint(0, 4) for _ in range(rng.randint(1, 20))]
        tree, of = prefix_trie.smaller_values(lcp)
        for i, v in enumerate(lcp):
            value, left, right, *_ = tree[of[i]]
            assert value == v
            assert left == max((k for k in range(i) if lcp[k] < v), default=None) and right == min((k for k in range(i + 1, len(lcp)) if lcp[k] < v), default=None)
