"""The trie of conversations against plain Python."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest

from gridlens.llm import prefix_trie, queries
from gridlens.llm.prefix_trie import SpillingQueue, conversation_trie
from tests.llm.conftest import SF

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows):
    convs = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            convs[conv].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(t)] for c, t in convs.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c, t in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (c % 20 if c >= 0 else -(-c % 20))  # as SQL divides
        rebuilt = tuple(own.get(base, [])[:h] + t[h:])
        for d in range(len(rebuilt) + 1):
            members[rebuilt[:d]].append(c)
        ends[rebuilt].append(c)
    children, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for node in sorted(members, key=len, reverse=True):
        saved[node] += (len(members[node]) - 1) * len(WORD.findall(node[-1][1] if node else ""))
        leaves[node] = leaves[node] or 1
        if node:
            children[node[:-1]] += 1
            leaves[node[:-1]] += leaves[node]
            saved[node[:-1]] += saved[node]
    return sorted(
        (
            min(m), len(node), min(members[node[:-1]]) if node else None, len(m), children[node], leaves[node], saved[node],
            hashlib.sha256(",".join(map(str, sorted(ends[node]))).encode()).hexdigest(), *(node[-1] if node else (None, None)),
        )
        for node, m in members.items()
    )


def found(df, **how):
    out = conversation_trie(df, keep_text=True, **how)
    assert out.columns == [*prefix_trie.OUTPUTS, "role", "text"]
    return sorted(tuple(r) for r in out.collect())


def planted(seed, convs=60, longest=12):
    """Conversations that share stretches of turns, with null and empty cells and missing bases."""
    rng = random.Random(seed)
    rows = []
    for c in range(convs):
        if rng.random() < 0.15:
            continue
        source = random.Random(rng.randrange(6))
        for turn in range(rng.choice([1, 2, 3, 5, longest])):
            text = source.choice(["hello there", "", "a b  c\n d", "yes", None]) if rng.random() < 0.9 else f"own {c}"
            rows.append((c, turn if turn or rng.random() < 0.7 else None, source.choice(["user", "assistant", None]), text))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("how", [{}, {"shard_nodes": 3, "queued": 2}])
def test_planted_conversations(spark, how):
    rows = planted(1) + [(None, 0, "user", "nobody's"), (-5, 0, "user", "minus"), (0, 40, "user", "late")]
    df = spark.createDataFrame([(*r, 5) for r in rows], "conv_id long, turn long, role string, text string, Depth int")
    assert found(df, **how) == brute(rows)


def test_hot_prefix_and_long_conversation(spark, monkeypatch):
    """Copies, a bush below one long shared start, and one conversation with a third of all turns."""
    monkeypatch.setattr(prefix_trie, "CHUNK_TURNS", 16)
    rows = [(c, t, "user", f"shared {t}") for c in range(0, 400, 20) for t in range(9)]
    rows += [(c, 9 + t, "assistant", f"of {c} {t}") for c in range(0, 400, 20) for t in range(5)]
    rows += [(c, t, "user", "copy copy") for c in range(1000, 1030) for t in range(4)]
    rows += [(7, t, "user", f"turn {t} of many") for t in range(70)]
    rows += [(40, None, "user", "first of all")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    wanted = brute(rows)
    assert found(df) == wanted
    assert found(df, shard_nodes=20, queued=5) == wanted


def test_repeated_rows_and_ties(spark):
    rows = [(3, 0, "user", "a"), (3, 0, "user", "a"), (3, 1, "user", "b"), (23, 0, "user", "a"), (23, 0, "user", "a")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert found(df) == brute(rows)
    tied = spark.createDataFrame([(20, 0, "user", x) for x in "dcab"], "conv_id long, turn long, role string, text string")
    again = found(tied.repartition(3))
    assert found(tied) == again and len(again) == 5


def test_no_conversations(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert conversation_trie(df).count() == 0
    nobody = spark.createDataFrame([(None, 1, "user", "x")], df.schema)
    assert conversation_trie(nobody).count() == 0


def test_spilled_messages_come_in_order():
    rng = random.Random(2)
    messages = [(-rng.randrange(5), rng.randrange(-3, 3), rng.randrange(3), 1, rng.randrange(100)) for _ in range(5_000)]
    queue = SpillingQueue(100)
    for m in messages:
        queue.push(m)
    assert queue.spills > 40 and len(queue.heap) <= 100
    for key in sorted({m[:3] for m in messages}):
        own = [m for m in messages if m[:3] == key]
        assert queue.take(key) == (len(own), len(own), sum(m[4] for m in own))
    assert not queue.heap and not queue.runs


def test_op13_equals_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = sorted(tuple(r) for r in queries.op13_conversation_trie(spark, SF).collect())
    assert got == sorted(r[:8] for r in brute(rows))
