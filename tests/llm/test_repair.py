"""Conversation repair against trying every edit, and long conversations against short ones."""

from __future__ import annotations

import hashlib
import heapq
import random
import re
import zlib

import pytest

from kapspark.llm import turn_repair
from kapspark.llm.turn_repair import Costs, cheapest, joined_in_pairs, repair, table_of, walk

SCHEMA = "conv_id long, turn long, role string, text string"
NAMES = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
PATTERN = re.compile("(s?(ua)+)?")


def every_edit(nodes, costs, most):
    """(cost, audit, roles) of the cheapest edits: all of them are tried, the pattern is asked of the whole result."""
    best = None
    queue = [(0, "", "", 0)]
    while queue:
        cost, audit, roles, at = heapq.heappop(queue)
        if best and cost > best[0]:
            break
        if at == len(nodes):
            if PATTERN.fullmatch(roles) and (best is None or (cost, audit) < best[:2]):
                best = (cost, audit, roles)
        else:
            initial, removable, truncated = nodes[at]
            heapq.heappush(queue, (cost + costs.delete, audit + "D", roles, at + 1))
            if not removable:
                extra = costs.truncated if truncated else 0
                heapq.heappush(queue, (cost + extra, audit + "K", roles + (initial or "?"), at + 1))
                for r in "ua":
                    heapq.heappush(queue, (cost + extra + costs.rerole, audit + "R", roles + r, at + 1))
        if audit.count("I") < most:
            for r in "ua":
                heapq.heappush(queue, (cost + costs.insert, audit + "I", roles + r, at))
    return best


COSTS = [Costs(), Costs(insert=1), Costs(rerole=3, delete=2, insert=2, truncated=1), Costs(rerole=0, delete=1, insert=1, truncated=0)]


@pytest.mark.parametrize("costs", COSTS)
def test_cheapest_edits_against_all_edits(costs):
    rnd = random.Random(repr(costs))
    for _ in range(60):
        nodes = [(rnd.choice("ssuuaa x"), rnd.random() < 0.2, rnd.random() < 0.3) for _ in range(rnd.randint(0, 4))]
        most = costs.insertions(len(nodes))
        want = every_edit(nodes, costs, min(4, len(nodes) + 1))
        cost, audit = cheapest(table_of(nodes, costs, [0], most), len(nodes))
        assert (cost, audit) == want[:2], nodes
        lines, _ = walk(0, audit, [(n[0], n[0], "") for n in nodes])
        assert "".join(line[0] for line in lines) == want[2]


@pytest.mark.parametrize("costs", COSTS)
def test_tables_of_pieces_join_to_the_whole(costs, monkeypatch):
    rnd = random.Random(3)
    for _ in range(20):
        nodes = [(rnd.choice("suax"), rnd.random() < 0.2, rnd.random() < 0.3) for _ in range(rnd.randint(0, 14))]
        most = min(6, costs.insertions(len(nodes)))
        whole = table_of(nodes, costs, [0], most)
        cuts = sorted(rnd.sample(range(len(nodes) + 1), min(3, len(nodes) + 1)))
        pieces = [nodes[a:b] for a, b in zip([0, *cuts], [*cuts, len(nodes)])]
        tables = [(len(p), table_of(p, costs, range(4), most)) for p in pieces]
        n, found = joined_in_pairs(tables, most)
        assert n == len(nodes)
        assert {k: v for k, v in found.items() if k[0] == 0} == whole
        monkeypatch.setattr(turn_repair, "DIRECT_ROWS", 2)
        assert table_of(nodes, costs, [0], most) == whole
        monkeypatch.undo()


def plain(rows):
    """The contract in plain Python, with all edits of short conversations tried."""
    out = {}
    for conv in {r[0] for r in rows}:
        kept = []
        for c, turn, role, text in rows:
            if c != conv:
                continue
            key = f"{' ' if c is None else c}:{' ' if turn is None else turn}"
            role, text = " " if role is None else role, " " if text is None else text
            kind = zlib.crc32(key.encode()) % 20
            if kind == 0:
                continue
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            kept += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
        kept.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2][:64], hashlib.sha256(r[2].encode()).hexdigest()))
        faults, nodes = [], []
        for k, (_, role, text) in enumerate(kept):
            solid = re.sub(r"[\x20\x09-\x0D]", "", text)
            fault = (
                "blank" if not solid
                else "duplicate" if (role, text) in [x[1:] for x in kept[:k]]
                else "truncated" if solid[-1] not in ".!?"
                else None
            )
            faults.append(fault)
            nodes.append((role[:1], fault in ("blank", "duplicate"), fault == "truncated"))
        initials = [n[0] for n in nodes]
        turns = [r[0] for r in kept if r[0] is not None]
        cost, audit, roles = every_edit(nodes, Costs(), 1)
        written, lines, at = iter(roles), [], 0
        for letter in audit:
            if letter == "D":
                at += 1
                continue
            role = {"u": "user", "a": "assistant"}.get(next(written))
            if letter == "I":
                lines.append(f"{role}:")
                continue
            lines.append(f"{kept[at][1] if letter == 'K' else role}:{kept[at][2]}")
            at += 1
        out[conv] = (
            max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
            *(faults.count(f) for f in ("blank", "duplicate", "truncated")),
            sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])),
            cost,
            audit,
            hashlib.sha256("\n".join(lines).encode()).hexdigest(),
        )
    return out


def conversations(seed, convs, longest):
    rnd = random.Random(seed)
    rows = []
    for c in convs:
        for t in range(rnd.randint(1, longest)):
            turn = rnd.choice([t, t, t, t + 3, None])
            role = rnd.choice(["system", "user", "user", "assistant", "assistant", "tool", "", None])
            text = rnd.choice(["Hello.", "Fine!", "cut off", "Why? ", "Ok.\n", "\t \x0b", "", None, f"Text {t}.", "é…", "𝄞."])
            rows.append((c, turn, role, text))
    return rows


def got(df):
    return {r["conv_id"]: tuple(r[n] for n in NAMES) for r in df.collect()}


@pytest.mark.parametrize("chunk_rows", [20_000, 3, 1])
def test_repair_against_the_contract_in_plain_python(spark, chunk_rows):
    rows = conversations(chunk_rows, [*range(50), None], 7)
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'x' as chunk", "1 as conv", "true as gone", "0 as kind", "'n' as audit")
    out = repair(df.repartition(3), chunk_rows=chunk_rows)
    found = got(out)
    assert out.count() == len(found)
    assert found == plain(rows)


def test_a_long_conversation_in_chunks(spark):
    rows = conversations(9, range(400), 9)
    rows = [(1 if k % 3 else c, k, r, t) for k, (c, _, r, t) in enumerate(rows)]  # one with most of the rows
    rows += [(1, 50, "user", "same.")] * 40  # and equal rows of one turn
    df = spark.createDataFrame(rows, SCHEMA)
    assert got(repair(df, chunk_rows=37)) == got(repair(df, chunk_rows=10**6))


def test_cheap_insertions_through_chunks(spark):
    costs = Costs(insert=1)
    rows = [(c, t, r, x) for c, t, r, x in conversations(4, range(12), 6)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert got(repair(df, costs=costs, chunk_rows=2)) == got(repair(df, costs=costs))


def test_edges(spark):
    empty = hashlib.sha256(b"").hexdigest()
    gone = next(t for t in range(1000) if zlib.crc32(f"5:{t}".encode()) % 20 == 0)
    plain_turn = [t for t in range(1000) if zlib.crc32(f"6:{t}".encode()) % 20 > 4]
    long_text = "a" * 300_000 + "."
    rows = [(5, gone, "user", "Hi."), (6, plain_turn[0], "user", long_text), (6, plain_turn[1], "assistant", "Yes.")]
    found = got(repair(spark.createDataFrame(rows, SCHEMA)))
    assert found[5] == (0, 0, 0, 0, 0, 0, "", empty)
    sha = hashlib.sha256(f"user:{long_text}\nassistant:Yes.".encode()).hexdigest()
    assert found[6] == (plain_turn[1] - plain_turn[0] - 1, 0, 0, 0, 0, 0, "KK", sha)
    assert repair(spark.createDataFrame([], SCHEMA)).collect() == []
