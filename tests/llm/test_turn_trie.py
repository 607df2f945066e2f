"""Against a trie of nested dictionaries."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from clausecut.llm import queries as Q
from clausecut.llm import sql
from clausecut.llm import turn_trie as T
from tests.llm import brute

SCHEMA = "conv_id long, turn long, role string, text string"


def brute_nodes(rows):
    turns = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            turns[c].append((turn is not None, turn or 0, hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest(), (role, text)))
    own = {c: [x[3] for x in sorted(t)] for c, t in turns.items()}
    members = defaultdict(list)
    for c in own:
        h = zlib.crc32(str(c).encode()) % 4
        seq = tuple(own.get(c - c % 20 if c >= 0 else c + -c % 20, [])[:h] + own[c][h:])
        for d in range(len(seq) + 1):
            members[seq[:d]].append((c, d == len(seq)))
    children = defaultdict(list)
    for seq in members:
        if seq:
            children[seq[:-1]].append(seq)
    out, totals = [], {}
    for seq in sorted(members, key=len, reverse=True):
        n = len(members[seq])
        leaves = sum(totals[x][0] for x in children[seq]) or 1
        saved = (n - 1) * (len(brute.words(seq[-1][1])) if seq else 0) + sum(totals[x][1] for x in children[seq])
        totals[seq] = leaves, saved
        ends = ",".join(str(c) for c in sorted(c for c, last in members[seq] if last))
        out.append((min(members[seq])[0], len(seq), min(members[seq[:-1]])[0] if seq else None, n, len(children[seq]), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def talk(seed, many):
    """Conversations that share beginnings, copies of one, long ones and one-turn ones."""
    rng = random.Random(seed)
    rows = []
    for k in range(many):
        c = k if k % 9 else k + 10_000
        if k % 3 == 0:
            turns = [("user", "the same first words"), ("assistant", "and the same answer")]
        elif k % 7 == 1:
            turns = [("user", f"line {j} of them all") for j in range(rng.choice([1, 5, 5, 40]))]
        else:
            turns = [(rng.choice(["user", "assistant", None]), rng.choice(["a b", "a", "", None, "b c d"])) for _ in range(rng.randrange(1, 5))]
        turns += [("user", rng.choice(["x", "y z", "x"])) for _ in range(rng.randrange(3))]
        rows += [(c, j, *t) for j, t in enumerate(turns)]
    rng.shuffle(rows)
    return rows


def got(df, **parameters):
    return sorted((tuple(r) for r in T.nodes(df, **parameters).collect()), key=str)


@pytest.mark.parametrize("local", [1, 3, 40, 5000])
def test_nodes(spark, local):
    rows = talk(local, 260)
    assert got(spark.createDataFrame(rows, SCHEMA).repartition(5), local=local) == brute_nodes(rows)


def test_copies_over_blocks(spark, monkeypatch):
    """Members of a group of copies come in many blocks, and their hash is that of the whole list."""
    monkeypatch.setattr(T, "BLOCK", 8)
    rows = [(c, j, "user", f"t{j}") for c in range(-40, 400) for j in range(3)]
    assert got(spark.createDataFrame(rows, SCHEMA).repartition(7), local=4) == brute_nodes(rows)


def test_numbers_of_the_dictionary(spark, monkeypatch):
    """Frequent turns come by broadcast and the others by a shuffle, with the same numbers."""
    rows = talk(9, 90)
    df = spark.createDataFrame(rows, SCHEMA)
    want = brute_nodes(rows)
    for hot in (1, 5, 10**6):
        monkeypatch.setattr(T, "HOT", hot)
        assert got(df, local=10) == want


def test_odd_rows(spark):
    rows = [(None, 1, "user", "x"), (20, None, None, None), (20, None, "", ""), (20, 3, "user", "a b"), (20, 3, "user", "a b"), (20, 3, "user", "A"), (21, 1, None, "z"), (2**60, 1, "1:", "a"), (2**60 + 1, 1, "1", ":a"), (-7, 1, "user", "q"), (45, 0, "user", "only"), (46, 0, "user", "only")]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], f"{SCHEMA}, ids string, no int")
    assert got(df) == got(df, local=1) == brute_nodes(rows)
    empty = T.nodes(spark.createDataFrame([], SCHEMA))
    assert empty.count() == 0 and empty.columns == [f.split()[0] for f in T.NODE.split(", ")]
    long = [(c, j, "user", f"w{j % 50} x") for c in (1, 2) for j in range(6000 + c)]  # as deep as the turns
    assert got(spark.createDataFrame(long, SCHEMA), local=1) == brute_nodes(long)


def test_query_and_sql(spark, sf):
    duckdb = pytest.importorskip("duckdb")
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    want = brute_nodes(rows)
    assert sorted((tuple(r) for r in Q.op13_conversation_trie(spark, sf).collect()), key=str) == want
    with duckdb.connect() as con:
        con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{sf}/conversations.parquet'")
        assert sorted(con.execute(sql.TRIE).fetchall(), key=str) == want
