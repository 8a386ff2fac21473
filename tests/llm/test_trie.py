"""The prefix trie against a dictionary of prefixes."""

import hashlib
import random
import zlib

import pytest

from tongueprint.llm import trie

SCHEMA = "conv_id long, turn int, role string, text string, depth string, k1 int, conv string, place int"


def brute(rows, span=100, most=5):
    convs = {}
    for c, turn, role, text, *_ in rows:
        if c is not None:
            role, text = role or "", text or ""
            mark = hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest()
            convs.setdefault(c, []).append(((turn is not None, turn or 0), mark, (role, text)))
    own = {c: [t for *_, t in sorted(ts, key=lambda x: x[:2])] for c, ts in convs.items()}
    whole = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % (most + 1)
        parent = c - (c % span if c >= 0 else -(-c % span))
        whole[c] = tuple(own.get(parent, [])[:h] + turns[h:])
    members = {}
    for c, turns in whole.items():
        for d in range(len(turns) + 1):
            members.setdefault(turns[:d], []).append(c)
    children = {}
    for node in members:
        if node:
            children.setdefault(node[:-1], []).append(node)
    out = set()
    for node, convs_of in members.items():
        below = [v for v in members if v[:len(node)] == node]
        ends = ",".join(map(str, sorted(c for c in convs_of if whole[c] == node)))
        out.add((
            min(convs_of), len(node), min(members[node[:-1]]) if node else None, len(convs_of), len(children.get(node, [])),
            sum(v not in children for v in below), sum((len(members[v]) - 1) * len(v[-1][1]) for v in below if v),
            hashlib.sha256(ends.encode()).hexdigest(),
        ))
    return out


def check(spark, rows, **settings):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    found = [tuple(r) for r in trie.nodes(trie.rebuilt(trie.ordered_turns(df), **settings)).collect()]
    assert len(found) == len(set(found))
    assert set(found) == brute(rows, **settings)


def made(seed, convs, longest):
    """Conversations with few distinct turns, many of them copies, plus columns named as the operator's own."""
    rng, rows = random.Random(seed), []
    script = [("user", "hé"), ("assistant", "b\nc"), ("user", None), (None, "d" * 7)]
    for c in convs:
        rows += [(c, t, *rng.choice(script[:1 + t % 4]), "x", 1, "y", 2) for t in range(rng.randint(1, longest))]
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_trie_equals_a_dictionary_of_prefixes(spark, seed):
    check(spark, made(seed, [*range(90, 130), 200, 201, 305, -3, -150], 6))


def test_nulls_ties_repeats_and_turnless(spark):
    rows = [
        (None, 0, "user", "lost", "", 0, "", 0), (7, None, "user", "first", "", 0, "", 0), (7, 0, "user", "b", "", 0, "", 0),
        (7, 0, "user", "b", "", 0, "", 0), (7, 0, "user", "a", "", 0, "", 0), (8, 5, None, None, "", 0, "", 0), (9, 1, "", "", "", 0, "", 0),
        (450, 0, "u", "x" * 30_000, "", 0, "", 0),
    ]
    # 457 has no first conversation of its block besides itself; ids with h over their own length are left without turns.
    rows += [(c, 0, "u", "short", "", 0, "", 0) for c in range(901, 912)]
    check(spark, rows)


def test_empty_table(spark):
    check(spark, [])


def test_one_conversation_over_many_tasks(spark):
    """A conversation with most of the rows is ranked and summed in pieces."""
    rows = [(100, t, "user", f"t{t % 3}", "", 0, "", 0) for t in range(700)] + made(3, range(101, 110), 3)
    df = spark.createDataFrame(rows, SCHEMA)
    ranked = trie.running(df, "conv_id", ["turn"], {"nth": trie.F.lit(1).cast("long")}, "test")
    assert {r["turn"]: r["nth"] for r in ranked.where("conv_id = 100").collect()} == {t: t + 1 for t in range(700)}
    nodes = trie.nodes(trie.rebuilt(trie.ordered_turns(df)))
    assert nodes.agg(trie.F.max("depth")).first()[0] == 700
    assert nodes.where("depth = 0").first()["n_convs"] == 10


def test_end_lists_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(trie, "PIECE", 8)
    check(spark, [(c, 0, "u", "same", "", 0, "", 0) for c in [*range(0, 60), -1, -9, 1000]])
