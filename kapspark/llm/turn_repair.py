"""Repair of conversations whose turns lost their order of roles.

A conversation's rows are walked once, by turn. Each row is kept, given another role
or deleted, and empty turns may be inserted, so that the roles read ``(s?(ua)+)?``: an
optional system turn, then pairs of user and assistant, or nothing. The edits form a
graph: a node is a place in the rows, the role last written (one of four states) and
the number of inserted turns; an edge is an edit. An edge's weight is one big integer:
its high digits are the edit's cost, its low digits have a fixed width, one digit for
each place of the audit, and the edit's letter stands at its place (D, I, K, R as 1 to 4,
nothing as 0 behind the end). Weights add up along a path without carries, so the
smallest integer is the cheapest path and, of equally cheap ones, the one with the
ASCII-least audit. One minimum over integers decides everything.

Inserted turns: a solution never costs more than deleting all rows, so there are at most
rows * DELETE // INSERT of them; and where an insertion costs more than two deletions
there is none at all, since taking it out together with the row it is paired with (and
with a system turn, if no pair is left) is cheaper.

Scale. Rows are range-partitioned by conversation and turn, so a long conversation is cut
into chunks of about ``CHUNK_ROWS`` rows. Conversations inside one chunk are repaired where
they meet. Of the others each chunk gives the smallest weights from every state to every
state; these tables join like matrices, and a conversation's tables are joined in pairs.
Then each chunk is told its part of the audit and writes its piece of the repaired text;
a digest runs over the pieces in order and holds one at a time. A conversation's audit is
one value by contract, so what the joining step holds grows with it (a few bits a letter).

Defined cases: in the damage's key, in roles and in texts null counts as one space; null
turns come first and do not count in gaps; rows of one turn stand in the order of role, the
text's first 64 code points and its SHA-256; a null conversation id is a conversation like others; an empty table gives
an empty result; other columns are left out; a text of any length is one value.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import staged

CHUNK_ROWS = 20_000
CHUNK_CHARS = 32_000_000
DIRECT_ROWS = 256
LETTERS = " DIKR"  # a letter's place is its digit
BITS = 3  # a digit
# States: nothing written, after a system turn, after a user turn, after an assistant turn.
START, SYSTEM, USER, ASSISTANT = range(4)
NEEDS = ("u", "u", "a", "u")  # the user or assistant turn that may follow
AFTER = {"s": SYSTEM, "u": USER, "a": ASSISTANT}
ROLES = {"u": "user", "a": "assistant"}
ENDS = (START, ASSISTANT)
LEGAL = {"su", "ua", "au"}
BLANKS = " \t\n\x0b\x0c\r"
DROP, EMPTY, UNSTOP, REPEAT, AS_USER = range(5)  # kinds of damage
ORDER_CHARS = 64
OUT = (
    "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
)


@dataclass(frozen=True)
class Costs:
    rerole: int = 1
    delete: int = 2
    insert: int = 5
    truncated: int = 5

    def insertions(self, rows: int) -> int:
        """No cheapest solution for so many rows inserts more turns."""
        return 0 if self.insert > 2 * self.delete else rows * self.delete // max(1, self.insert)


# --- the graph ---------------------------------------------------------------
# A row is (initial, removable only: bool, truncated: bool). A table of a run of rows is
# {(state before, state after, turns inserted): smallest weight}; the weight of a path
# with n letters is (cost << BITS * n) + letters.

Table = dict[tuple[int, int, int], int]


def _put(table: dict, key, weight: int) -> None:
    if key not in table or weight < table[key]:
        table[key] = weight


def _direct(rows: Sequence[tuple[str, bool, bool]], costs: Costs, starts: Sequence[int], most: int) -> Table:
    """The table of a run of rows, node by node; weights have their places from the run's beginning."""
    width = len(rows) + most
    cost_unit = 1 << BITS * width
    out: Table = {}
    for start in starts:
        now: dict[tuple[int, int], int] = {(start, 0): 0}
        for at in range(len(rows) + 1):
            # insertions before the row, or behind the last one
            for done in range(most):
                place = 1 << BITS * (width - 1 - at - done)
                for state in range(4):
                    if (state, done) in now:
                        weight = now[state, done] + costs.insert * cost_unit + LETTERS.index("I") * place
                        _put(now, (AFTER[NEEDS[state]], done + 1), weight)
            if at == len(rows):
                break
            initial, removable, truncated = rows[at]
            then: dict[tuple[int, int], int] = {}
            for (state, done), weight in now.items():
                place = 1 << BITS * (width - 1 - at - done)
                _put(then, (state, done), weight + costs.delete * cost_unit + LETTERS.index("D") * place)
                if removable:
                    continue
                extra = costs.truncated if truncated else 0
                need = NEEDS[state]
                if initial == need or (initial == "s" and state == START):
                    _put(then, (AFTER[initial], done), weight + extra * cost_unit + LETTERS.index("K") * place)
                _put(then, (AFTER[need], done), weight + (extra + costs.rerole) * cost_unit + LETTERS.index("R") * place)
            now = then
        for (state, done), weight in now.items():
            # behind the last letter the places are empty
            out[start, state, done] = weight >> BITS * (most - done)
    return out


def joined(first: Table, first_rows: int, second: Table, second_rows: int, most: int) -> Table:
    """The table of a run of rows followed by another."""
    out: Table = {}
    for (a, b, i), x in first.items():
        width_x = BITS * (first_rows + i)
        cost_x, low_x = x >> width_x, x & ((1 << width_x) - 1)
        for (c, d, j), y in second.items():
            if b != c or i + j > most:
                continue
            width_y = BITS * (second_rows + j)
            weight = (cost_x << width_x + width_y) + (low_x << width_y) + y
            # y's cost stands above its letters, where x's letters begin: lift it
            cost_y = y >> width_y
            weight += (cost_y << width_x + width_y) - (cost_y << width_y)
            _put(out, (a, d, i + j), weight)
    return out


def table_of(rows: Sequence[tuple[str, bool, bool]], costs: Costs, starts: Sequence[int], most: int) -> Table:
    """The table of a run of rows of any length: halves are joined, so integers stay short for most of the work."""
    if len(rows) <= DIRECT_ROWS:
        return _direct(rows, costs, starts, most)
    half = len(rows) // 2
    return joined(table_of(rows[:half], costs, starts, most), half, table_of(rows[half:], costs, range(4), most), len(rows) - half, most)


def joined_in_pairs(tables: list[tuple[int, Table]], most: int) -> tuple[int, Table]:
    """The table of all runs one after the other."""
    while len(tables) > 1:
        paired = []
        for k in range(0, len(tables) - 1, 2):
            (n, x), (m, y) = tables[k], tables[k + 1]
            paired.append((n + m, joined(x, n, y, m, most)))
        tables = paired + (tables[-1:] if len(tables) % 2 else [])
    return tables[0]


def cheapest(table: Table, rows: int) -> tuple[int, str]:
    """Cost and audit of the smallest weight from the beginning to an allowed end."""
    ends = {(i, w) for (a, b, i), w in table.items() if a == START and b in ENDS}
    longest = max(i for i, _ in ends)
    # empty places behind shorter audits make all weights equally wide
    best = min(w << BITS * (longest - i) for i, w in ends)
    width = rows + longest
    return best >> BITS * width, letters_of(best, width)


def letters_of(weight: int, width: int) -> str:
    if not width:
        return ""
    digits = f"{weight & ((1 << BITS * width) - 1):0{width}o}"  # a digit has three bits
    return digits.translate({ord(str(k)): letter for k, letter in enumerate(LETTERS)}).rstrip()


def walk(state: int, audit: str, rows: Sequence[tuple[str, str, str]]) -> tuple[list[str], int]:
    """`role:text` of the turns that an audit leaves of rows (initial, role, text), and the state behind them."""
    lines, taken = [], iter(rows)
    for letter in audit:
        if letter == "I":
            written = NEEDS[state]
            lines.append(f"{ROLES[written]}:")
        else:
            initial, role, text = next(taken)
            if letter == "D":
                continue
            written = initial if letter == "K" else NEEDS[state]
            lines.append(f"{role if letter == 'K' else ROLES[written]}:{text}")
        state = AFTER[written]
    return lines, state


# --- rows --------------------------------------------------------------------


def damaged(rows: DataFrame, id_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """(conv, turn, role, text, gone): the damaged rows; dropped ones stay as marks without a text."""
    blank = F.lit(" ")
    key = F.concat_ws(":", *[F.coalesce(F.col(f"`{c}`").cast("string"), blank) for c in (id_col, turn_col)])
    named = rows.select(
        F.col(f"`{id_col}`").alias("conv"),
        F.col(f"`{turn_col}`").cast("long").alias("turn"),
        F.coalesce(F.col(f"`{role_col}`"), blank).alias("role"),
        F.coalesce(F.col(f"`{text_col}`"), blank).alias("text"),
        (F.crc32(key.cast("binary")) % 20).cast("int").alias("kind"),
    )
    kind, gone = F.col("kind"), F.col("kind") == DROP
    text = (
        F.when(gone | (kind == EMPTY), F.lit(""))
        .when(kind == UNSTOP, F.translate("text", ".!?", ""))
        .otherwise(F.col("text"))
    )
    copies = F.array_repeat(F.lit(0), F.when(kind == REPEAT, 2).otherwise(1))
    return named.select(
        "conv",
        "turn",
        F.when(kind == AS_USER, F.lit("user")).when(gone, F.lit("")).otherwise(F.col("role")).alias("role"),
        text.alias("text"),
        gone.alias("gone"),
        F.explode(copies).alias("copy"),
    ).drop("copy")


def _digest(text: str) -> bytes:
    return hashlib.sha256(text.encode()).digest()


def _in_order(rows: list[tuple]) -> list[tuple]:
    """(turn, role, text, digest, seen in an earlier chunk) by turn."""
    return sorted(
        rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2][:ORDER_CHARS].encode(), r[3])
    )


def _turns(table: pa.Table) -> list[tuple]:
    """The rows of one conversation that are not gone, in order."""
    columns = (table.column(c).to_pylist() for c in ("turn", "role", "text", "gone", "earlier"))
    return _in_order([(t, r, x, _digest(x), e) for t, r, x, g, e in zip(*columns) if not g])


def judged(rows: Sequence[tuple]) -> tuple[list[tuple[str, bool, bool]], dict]:
    """Nodes of the rows, and what is counted of them."""
    seen: set[tuple[str, bytes]] = set()
    nodes, counts = [], {"blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0}
    for _, role, text, digest, earlier in rows:
        stripped, own = text.rstrip(BLANKS), (role, digest)
        fault = None
        if not stripped:
            fault = "blank"
        elif earlier or own in seen:
            fault = "duplicate"
        elif stripped[-1] not in ".!?":
            fault = "truncated"
        seen.add(own)
        if fault:
            counts[fault] += 1
        initial = role[:1]
        if nodes and nodes[-1][0] + initial not in LEGAL:
            counts["illegal"] += 1
        nodes.append((initial, fault in ("blank", "duplicate"), fault == "truncated"))
    turns = {t for t, *_ in rows if t is not None}
    counts["turns"] = len(turns)
    counts["first_turn"], counts["last_turn"] = (min(turns), max(turns)) if turns else (None, None)
    return nodes, counts


def _gaps(first: int | None, last: int | None, turns: int) -> int:
    return 0 if first is None else last - first + 1 - turns


def _sha(lines: Sequence[str]) -> str:
    return hashlib.sha256("\n".join(lines).encode()).hexdigest()


def _whole(costs: Costs):
    """Repair all conversations that lie in one chunk."""
    names = [f.split()[0] for f in OUT.split(", ")]
    kinds = [pa.int64()] * 6 + [pa.string()] * 2

    def one(rows: list[tuple]) -> tuple:
        nodes, counts = judged(rows)
        most = costs.insertions(len(nodes))
        cost, audit = cheapest(table_of(nodes, costs, [START], most), len(nodes))
        lines, _ = walk(START, audit, [(n[0], r[1], r[2]) for n, r in zip(nodes, rows)])
        gaps = _gaps(counts["first_turn"], counts["last_turn"], counts["turns"])
        return (gaps, *(counts[c] for c in ("blank", "duplicate", "truncated", "illegal")), cost, audit, _sha(lines))

    def run(table: pa.Table) -> pa.Table:
        found: dict = {}
        columns = (table.column(c).to_pylist() for c in ("conv", "turn", "role", "text", "gone"))
        for conv, turn, role, text, gone in zip(*columns):
            held = found.setdefault(conv, [])
            if not gone:
                held.append((turn, role, text, _digest(text), False))
        values = zip(*(one(_in_order(rows)) for rows in found.values()))
        return pa.table(
            {"conv": pa.array(list(found), table.schema.field("conv").type)}
            | {n: pa.array(v, k) for n, v, k in zip(names, values, kinds)}
        )

    return run


CHUNK = (
    "chunk long, n long, blank long, duplicate long, truncated long, illegal long, turns long, first_turn long, "
    "last_turn long, first_role string, last_role string, weights array<struct<a:int,b:int,i:int,w:binary>>"
)


def _chunk(costs: Costs):
    """What a chunk of a longer conversation adds to it."""

    def run(table: pa.Table) -> pa.Table:
        nodes, counts = judged(_turns(table))
        found = table_of(nodes, costs, range(4), costs.insertions(table.column("conv_rows")[0].as_py()))
        weights = [{"a": a, "b": b, "i": i, "w": w.to_bytes(w.bit_length() // 8 + 1, "big")} for (a, b, i), w in found.items()]
        values = {"n": len(nodes)} | {c: counts[c] for c in ("blank", "duplicate", "truncated", "illegal", "turns", "first_turn", "last_turn")}
        kind = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32()), ("i", pa.int32()), ("w", pa.binary())]))
        return pa.table(
            {"conv": table.column("conv").slice(0, 1), "chunk": table.column("chunk").slice(0, 1)}
            | {c: pa.array([v], pa.int64()) for c, v in values.items()}
            | {
                "first_role": pa.array([nodes[0][0] if nodes else None], pa.string()),
                "last_role": pa.array([nodes[-1][0] if nodes else None], pa.string()),
                "weights": pa.array([weights], kind),
            }
        )

    return run


def _table_of_row(weights: list[dict]) -> Table:
    return {(w["a"], w["b"], w["i"]): int.from_bytes(w["w"], "big") for w in weights}


def _parts_of(audit: str, sizes: Sequence[int]) -> Iterator[str]:
    """The audit cut behind each chunk's last row (insertions behind it go to the next; the last takes all)."""
    at = 0
    for k, size in enumerate(sizes):
        if k == len(sizes) - 1:
            yield audit[at:]
            return
        end, left = at, size
        while left:
            left -= audit[end] != "I"
            end += 1
        yield audit[at:end]
        at = end


def _combine(costs: Costs):
    """A longer conversation's figures (with its first chunk), and each chunk's part of the audit."""

    def run(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["chunk"])
        most = costs.insertions(sum(r["n"] for r in rows))
        total, found = joined_in_pairs([(r["n"], _table_of_row(r["weights"])) for r in rows], most)
        cost, audit = cheapest(found, total)
        sums = {c: sum(r[c] for r in rows) for c in ("blank", "duplicate", "truncated", "illegal", "turns")}
        full = [r for r in rows if r["n"]]
        for before, after in zip(full, full[1:]):
            sums["illegal"] += before["last_role"] + after["first_role"] not in LEGAL
        dated = [r for r in full if r["first_turn"] is not None]
        for before, after in zip(dated, dated[1:]):
            sums["turns"] -= before["last_turn"] == after["first_turn"]
        gaps = _gaps(dated[0]["first_turn"], dated[-1]["last_turn"], sums["turns"]) if dated else 0
        n, parts = len(rows), list(_parts_of(audit, [r["n"] for r in rows]))
        figures = {"gaps": gaps} | {c: sums[c] for c in ("blank", "duplicate", "truncated", "illegal")} | {"cost": cost}
        return pa.table(
            {"conv": pa.chunked_array([table.column("conv").combine_chunks().take(pa.array([0] * n))])}
            | {"chunk": pa.array([r["chunk"] for r in rows], pa.int64())}
            | {c: pa.array([v, *[None] * (n - 1)], pa.int64()) for c, v in figures.items()}
            | {
                "audit": pa.array([audit, *[None] * (n - 1)], pa.string()),
                "part": pa.array(parts, pa.string()),
                "state": pa.array(_states(parts), pa.int32()),
            }
        )

    return run


def _states(parts: Sequence[str]) -> list[int]:
    """The state in which each part of an audit begins.

    Turns are written in pairs, so an odd number of them means that a system turn is the first.
    """
    written = [len(p) - p.count("D") for p in parts]
    first, out, at = sum(written) % 2, [], 0
    for n in written:
        behind = at - first  # pairs' turns written so far
        out.append(START if at == 0 else SYSTEM if behind == 0 and first else ASSISTANT if behind % 2 == 0 else USER)
        at += n
    return out


def _pieces(rows: pa.Table, parts: pa.Table) -> pa.Table:
    """A chunk's piece of the repaired text."""
    state, part = parts.column("state")[0].as_py(), parts.column("part")[0].as_py()
    lines, _ = walk(state, part, [(r[1][:1], r[1], r[2]) for r in _turns(rows)])
    piece = pa.array(["\n".join(lines) if lines else None], pa.string())
    return pa.table({"conv": parts.column("conv"), "chunk": parts.column("chunk"), "piece": piece})


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each conversation's pieces, which come in order."""
    conv, running, any_line, kind = None, None, False, pa.int64()

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([conv], kind), pa.array([running.hexdigest()])], names=["conv", "repaired_sha256"]
        )

    for batch in batches:
        kind = batch.schema.field("conv").type
        for i in range(batch.num_rows):
            own, piece = batch.column("conv")[i].as_py(), batch.column("piece")[i].as_py()
            if running is None or own != conv:
                if running is not None:
                    yield out()
                conv, running, any_line = own, hashlib.sha256(), False
            if piece is not None:
                running.update((("\n" if any_line else "") + piece).encode())
                any_line = True
    if running is not None:
        yield out()


def _same(left: DataFrame, right: DataFrame, columns: Sequence[str]) -> Column:
    """Null-safe equality of columns that `right` has with an underscore before the name."""
    match = F.lit(True)
    for c in columns:
        match = match & left[c].eqNullSafe(right[f"_{c}"])
    return match


def repair(
    rows: DataFrame,
    id_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    costs: Costs = Costs(),
    chunk_rows: int = CHUNK_ROWS,
    chunk_chars: int = CHUNK_CHARS,
) -> DataFrame:
    """Faults, cheapest edits and the repaired text's digest of each conversation after the damage."""
    broken = damaged(rows, id_col, turn_col, role_col, text_col)
    n, chars = broken.agg(F.count(F.lit(1)), F.sum(F.length("text").cast("long"))).first()
    spark = rows.sparkSession
    fewest = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = max(-(-n // chunk_rows), -(-(chars or 0) // chunk_chars), min(fewest, n), 1)
    text = F.col("text")
    ranged = broken.withColumn("_row", F.monotonically_increasing_id()).repartitionByRange(
        parts, "conv", F.col("turn").asc_nulls_first(), "role", F.left(text, F.lit(ORDER_CHARS)), F.sha2(text.cast("binary"), 256), "_row"
    )
    turns = staged(ranged.withColumn("chunk", F.spark_partition_id().cast("long")).drop("_row"), "turns")
    # a border splits one conversation at most: not more rows than chunks
    split = staged(
        turns.groupBy(F.col("conv").alias("_conv"))
        .agg(F.min("chunk").alias("low"), F.max("chunk").alias("high"), F.count_if(~F.col("gone")).alias("conv_rows"))
        .filter("low < high")
        .select("_conv", "conv_rows"),
        "split-conversations",
    )
    id_type = rows.schema[id_col].dataType.simpleString()
    whole = turns.join(split, _same(turns, split, ["conv"]), "left_anti")
    done = whole.groupBy("chunk").applyInArrow(_whole(costs), f"conv {id_type}, {OUT}")

    longer = staged(turns.join(split, _same(turns, split, ["conv"])).drop("_conv"), "split-turns")
    named = longer.withColumn("own", F.sha2(F.concat_ws(":", F.length("role").cast("string"), "role", "text"), 256))
    first = staged(
        named.filter(~F.col("gone"))
        .groupBy(F.col("conv").alias("_conv"), F.col("own").alias("_own"))
        .agg(F.min("chunk").alias("first")),
        "first-turns",
    )
    marked = staged(
        named.join(first.hint("shuffle_merge"), _same(named, first, ["conv", "own"]), "left").select(
            *longer.columns, F.coalesce(F.col("first") < F.col("chunk"), F.lit(False)).alias("earlier")
        ),
        "marked-turns",
    )
    tables = marked.groupBy("conv", "chunk").applyInArrow(_chunk(costs), f"conv {id_type}, {CHUNK}")
    figures = ", ".join(f for f in OUT.split(", ") if not f.startswith("repaired"))
    settled = staged(
        tables.groupBy("conv").applyInArrow(
            _combine(costs), f"conv {id_type}, chunk long, {figures}, part string, state int"
        ),
        "audits",
    )
    pieces = (
        marked.groupBy("conv", "chunk")
        .cogroup(settled.select("conv", "chunk", "part", "state").groupBy("conv", "chunk"))
        .applyInArrow(_pieces, f"conv {id_type}, chunk long, piece string")
    )
    hashed = (
        pieces.repartition("conv")
        .sortWithinPartitions("conv", "chunk")
        .mapInArrow(_digests, f"conv {id_type}, repaired_sha256 string")
        .withColumnRenamed("conv", "_conv")
    )
    heads = settled.filter("audit is not null").drop("chunk", "part", "state")
    of_longer = heads.join(hashed, _same(heads, hashed, ["conv"])).drop("_conv")
    return done.unionByName(of_longer).withColumnRenamed("conv", id_col)
