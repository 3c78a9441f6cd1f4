"""Repair of conversations and the prefix trie against plain versions."""

import itertools
import random

import numpy as np
import pytest

from gridlake.llm import conversation_repair as cr
from gridlake.llm import prefix_trie as pt
from tests.llm import brute

SF = "/root/testdata/sf0.01"
SCHEMA = "conv_id long, turn long, role string, text string"


def talks():
    rng, rows = random.Random(6), []
    said = ["Yes.", "no", " ", "", "Why?", "So it is!  \n", "One. two", "\x1f", None]
    roles = ["user", "assistant", "system", "user", "assistant", "", "tool", "U", "sage", None]
    for conv in range(160):
        for turn in range(rng.choice([0, 1, 2, 4, 7, 9, 15])):
            rows.append((conv, rng.choice([turn, turn, turn, turn + 2, None, -turn]), rng.choice(roles), rng.choice(said)))
    rows += [(None, 1, "user", "A."), (None, 2, "assistant", "B."), (7000, None, None, None)]
    # a conversation of long runs
    return rows + [(500, t, "user" if t % 900 else "assistant", f"t{t % 1300}.") for t in range(4000)]


def columns(r):
    return (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256)


def found(told):
    got = cr.digests(cr.repair(cr.damage(told), told.select("conv_id"))).collect()
    assert len(got) == len({r.conv_id for r in got})
    return {r.conv_id: columns(r) for r in got}


def test_repair(spark):
    rows = talks()
    told = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'x' AS kind", "1 AS n", "'y' AS place", "0 AS symbols").repartition(7)
    assert found(told) == brute.repaired(rows)


def test_repair_of_the_table(spark):
    told = spark.read.parquet(f"{SF}/conversations.parquet")
    rows = [tuple(r) for r in told.select("conv_id", "turn", "role", "text").collect()]
    assert found(told) == brute.repaired(rows)


def test_repaired_turns(spark):
    rows = [(1, 0, "assistant", "Hello."), (1, 1, "user", "Hi."), (1, 2, "user", ""), (1, 3, "user", "Hi."), (2, 0, "system", "S.")]
    told = spark.createDataFrame(rows, SCHEMA)
    got = cr.repair(told).where("position > 0").orderBy("conv_id", "position").collect()
    assert [(r.conv_id, r.position, r.edit, r.role, r.text) for r in got] == [
        (1, 1, "I", "user", ""), (1, 2, "K", "assistant", "Hello."), (1, 3, "K", "user", "Hi."), (1, 4, "I", "assistant", "")]


def test_repair_of_nothing(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert cr.digests(cr.repair(none, none)).collect() == []
    got = cr.digests(cr.repair(none, spark.createDataFrame([(4,), (4,)], "conv_id long"))).collect()
    assert [(r.conv_id, *columns(r)) for r in got] == [(4, 0, 0, 0, 0, 0, 0, "", cr.hashlib.sha256().hexdigest())]


@pytest.mark.parametrize("piece", [cr.PIECE, 3])
def test_audits(piece, monkeypatch):
    """Every short sequence of symbols, and long runs, against the plain version."""
    monkeypatch.setattr(cr, "PIECE", piece)  # runs are cut on the driver here
    repair, names = cr.Repair(), {0: "x", cr.SYSTEM: "system", cr.USER: "user", cr.ASSISTANT: "assistant"}

    def plain(symbols):
        rows = []
        for n, s in enumerate(symbols):
            kind, fault = s & 3, s >> 2
            rows.append((n, names[kind], ["good %d." % n, "cut %d" % n, None, " "][fault]))
        return rows

    faults = [cr.GOOD, cr.CUT, cr.BLANK]
    every = [k + 4 * f for k in range(4) for f in faults if k or f == cr.GOOD]
    cases = [list(c) for n in range(4) for c in itertools.product(every, repeat=n)]
    rng = random.Random(3)
    cases += [[s for _ in range(6) for s in [rng.choice(every)] * rng.randint(1, 40)] for _ in range(60)]
    for symbols in cases:
        want = brute.repair(plain(symbols))
        assert repair.audit(bytes(symbols)) == (want[5], want[6]), symbols


def shared_talks():
    """Conversations with common beginnings, copies, nulls, ties and a long one."""
    rng, rows = random.Random(2), []
    said = ["a", "b", "é", "", None]
    base = [[(rng.choice(["user", "assistant", None]), rng.choice(said)) for _ in range(rng.randint(1, 14))] for _ in range(9)]
    for conv in list(range(120)) + [-7, -5, -3, 1000, 1001, 1004]:
        turns = list(rng.choice(base))
        if rng.random() < 0.5:
            turns = turns[:rng.randint(0, len(turns))] + [("user", rng.choice(said)) for _ in range(rng.randint(0, 4))]
        rows += [(conv, rng.choice([n, n, n, None]), *t) for n, t in enumerate(turns)]
    rows += [(conv, n, "user", f"long {n % 40}") for conv in (300, 301, 302, 305) for n in range(90 if conv % 5 else 130)]
    rows += [(None, 1, "user", "x"), (77, 3, "user", "same"), (77, 3, "user", "same"), (77, 3, "user", "other")]
    return rows


def trie_rows(told, **sizes):
    got = pt.with_ends(pt.build(told, **sizes)).collect()
    return sorted((r.conv_id, r.depth, -1 if r.parent_conv_id is None else r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves,
                   r.saved_tokens, r.ends_sha256) for r in got)


@pytest.mark.parametrize("sizes", [{}, {"piece": 3, "shard": 40}, {"piece": 1, "shard": 1}, {"piece": 7, "shard": 400}])
def test_trie(spark, sizes):
    rows = shared_talks()
    told = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'x' AS one", "1 AS depth", "2 AS shard", "3 AS place").repartition(6)
    assert trie_rows(told, **sizes) == brute.trie(rows)


def test_trie_of_the_table(spark):
    told = spark.read.parquet(f"{SF}/conversations.parquet")
    assert trie_rows(told) == brute.trie([tuple(r) for r in told.select("conv_id", "turn", "role", "text").collect()])


def test_trie_of_nothing(spark):
    assert trie_rows(spark.createDataFrame([], SCHEMA)) == []
    assert trie_rows(spark.createDataFrame([(None, 1, "user", "x")], SCHEMA)) == []


def test_perfect_table():
    rng = np.random.default_rng(0)
    for n in (0, 1, 2, 1000, 30000):
        one, two = (rng.integers(0, 1 << 20, 2 * n).astype(np.uint64) for _ in range(2))
        first = pt.distinct(one, two)
        one, two = one[first], two[first]
        table = pt.PerfectTable(one, two)
        assert sorted(table.slots(one, two).tolist()) == list(range(len(one)))
        assert (table.slots(one, two + np.uint64(1 << 30)) == -1).all()
