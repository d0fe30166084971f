"""The conversation trie against sequences that are really rebuilt."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from textweir.llm import prefixtrie
from textweir.llm import queries as q

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
SCHEMA = "conv_id bigint, turn bigint, role string, text string, depth string, at int, part double"


def brute(rows):
    """Rows (conv_id, turn, role, text) to the nodes, with every rebuilt sequence in full."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            tie = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
            own[c].append(((turn is not None, turn or 0, tie), (role, text)))
    own = {c: [t for _, t in sorted(x)] for c, x in own.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        built[c] = tuple(own.get(c - c % 5, [])[:h] + turns[h:])
    members = defaultdict(list)
    for c, seq in built.items():
        for d in range(len(seq) + 1):
            members[seq[:d]].append(c)
    kids, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for seq in members:
        if seq:
            kids[seq[:-1]] += 1
    for seq, cs in members.items():
        for d in range(len(seq) + 1):
            leaves[seq[:d]] += not kids[seq]
            saved[seq[:d]] += (len(cs) - 1) * len(seq[-1][1].encode()) if seq else 0
    return sorted((min(cs), len(seq), min(members[seq[:-1]]) if seq else None, len(cs), kids[seq], leaves[seq], saved[seq],
                   hashlib.sha256(",".join(map(str, sorted(c for c in cs if built[c] == seq))).encode()).hexdigest())
                  for seq, cs in members.items())


def found(trie):
    return sorted(tuple(r) for r in trie.select(*COLUMNS).collect())


def table(spark, rows, parts=3):
    return spark.createDataFrame([(*r, "x", 1, 0.5) for r in rows], SCHEMA).repartition(parts)


def some_rows(seed, convs=120, most=14):
    """Conversations of many lengths with common heads, copies, ties, nulls and repeated rows."""
    rng = random.Random(seed)
    heads = [[(rng.choice(["user", "assistant", None]), rng.choice(["a", "b", "", None, "ünï", "long " * 40])) for _ in range(12)]
             for _ in range(4)]
    out = []
    for c in rng.sample(range(4 * convs), convs):
        turns = list(rng.choice(heads)[:rng.randint(0, 12)])
        turns += [(rng.choice(["user", "system"]), rng.choice("abc")) for _ in range(rng.randint(0, most - len(turns)))]
        for i, (role, text) in enumerate(turns):
            out.append((c, rng.choice([i, i, i, i // 2, None]), role, text))
            if rng.random() < 0.05:
                out.append(out[-1])
    return out + [(None, 0, "user", "x"), (None, None, None, None)]


@pytest.mark.parametrize("seed", range(4))
def test_nodes_of_random_conversations(spark, seed):
    rows = some_rows(seed)
    assert found(prefixtrie.prefix_trie(table(spark, rows))) == brute(rows)


def test_one_conversation_over_many_partitions(spark, monkeypatch):
    monkeypatch.setattr(prefixtrie, "BATCH", 7)
    monkeypatch.setattr(prefixtrie, "CHUNK", 11)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = [(10, i, "u", f"t{i % 40}") for i in range(900)]
        rows += [(c, i, "u", f"t{i % 40}") for c in range(10, 60) for i in range(1, 12)]
        assert found(prefixtrie.prefix_trie(table(spark, rows))) == brute(rows)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_small_tables(spark):
    assert prefixtrie.prefix_trie(table(spark, [(None, 1, "u", "x")])).collect() == []
    absent_base = next(c for c in range(1, 99) if c % 5 and zlib.crc32(str(c).encode()) % 9 > 2)
    turnless = [(absent_base, 0, "u", "x")]  # nothing of the base, and all own turns are before the suffix
    assert found(prefixtrie.prefix_trie(table(spark, turnless))) == brute(turnless)
    assert len(brute(turnless)) == 1
    long = [(0, 0, "u", "w " * 400_000), (5, 0, "u", "w " * 400_000)]
    assert found(prefixtrie.prefix_trie(table(spark, long))) == brute(long)


def test_references_lead_to_the_last_turn(spark):
    rows = [(c, i, "u", f"{i}-{c % 2}") for c in range(20) for i in range(10)]
    for r in prefixtrie.prefix_trie(table(spark, rows)).collect():
        if r.depth:
            h, base = zlib.crc32(str(r.conv_id).encode()) % 9, r.conv_id - r.conv_id % 5
            assert (r.ref_turn - 1, r.ref_conv % 2) == (r.depth - 1, base % 2 if r.depth <= h else r.conv_id % 2)


def test_equal_fingerprints_of_different_turns_are_found_out(spark, monkeypatch):
    rows = some_rows(9, convs=30)
    lanes, tries = prefixtrie._lanes, []

    def blind(draw):
        tries.append(draw.base)
        return [c * 0 for c in lanes(draw)] if draw.base == prefixtrie.Draw.number(0).base else lanes(draw)

    monkeypatch.setattr(prefixtrie, "_lanes", blind)
    assert found(prefixtrie.prefix_trie(table(spark, rows))) == brute(rows)
    assert len(set(tries)) == 2


def test_query(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert found(q.op11_prefix_trie(spark, sf_dir)) == brute(rows)
