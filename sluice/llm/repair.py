"""Conversation structure repair by block tables (operator 13).

A conversation's roles must read `(s?(ua)+)?`. Each turn may be kept, reroled or deleted, and turns may
be inserted; the cheapest edits are wanted, of equally cheap ones those whose letters come first.

The cost to go from a place in a conversation is a vector with one cost per state of the grammar. Less
its least cost it is one of a few dozen vectors, so a turn (its symbol: role and fault) is a step between
numbered vectors plus an offset, and so is any run of turns. The table of all blocks of BLOCK symbols is
made once; a conversation is read from its end, a block per lookup. To trace the edits, each block is
expanded backward into the vectors between its turns, and the letters are taken from the front, least
first, wherever the costs to go allow it: so ties fall as asked without keeping any alternative.

A run of turns being a map of numbered vectors, long conversations need no single task: they are cut
into pieces, each piece's map is found on its own, the maps are chained, and each piece is traced on its
own between the vector at its end and the state at its start.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import saved, table, tune

KEEP, REROLE, DELETE, INSERT, FAULT = 0, 3, 4, 3, 3
#: States: nothing yet, after system, after user, after assistant.
NEXT = {"s": (1, None, None, None), "u": (2, 2, None, 2), "a": (None, None, 3, None), "o": (None,) * 4}
ASKED = ((2, "u"), (2, "u"), (3, "a"), (2, "u"))  # the one role that may be inserted in a state
SYMBOLS = "DsuaoSUAO"  # deleted by force; whole and truncated turns by role
BLOCK = 4
#: Turns and bytes of a piece of a conversation.
TURNS, BYTES = 1024, 1 << 20
ROLES = {"u": "user", "a": "assistant"}
PIECE = "conv_id long, part int, k int, edge boolean, n int, turns int, low long, high long, first string, last string, illegal long, roles array<string>, texts array<string>, keys array<binary>, repeats array<boolean>"


def _closed(v: list[int]) -> list[int]:
    """v with insertions: two rounds, as no more than two in a row are ever useful."""
    for _ in range(2):
        v = [min(c, INSERT + v[ASKED[q][0]]) for q, c in enumerate(v)]
    return v


def _moves(symbol: str, q: int) -> list[tuple[str, int, int]]:
    """(letter, cost, state after) of the edits of a turn in state q, by letter."""
    out = [("D", DELETE, q)]
    if symbol != "D":
        extra = FAULT * symbol.isupper()
        kept = NEXT[symbol.lower()][q]
        if kept is not None:
            out.append(("K", KEEP + extra, kept))
        out.append(("R", REROLE + extra, ASKED[q][0]))
    return out


class BlockTables:
    """Vectors of costs to go, numbered, and what every symbol and every block of symbols does to them.

    step[v, s] and gain[v, s]: number and offset of the vector before a turn s, v being that after it;
    block_step, block_gain: the same for blocks, numbered by their symbols read as digits, last first.
    taken[s][v][q]: the letters of a turn s in state q with v after it, and the state that they lead to.
    """

    def __init__(self, size: int = BLOCK):
        self.size = size
        end = tuple(_closed([0, 1 << 20, 1 << 20, 0]))
        self.vectors, number, todo = [end], {end: 0}, [end]
        step, gain = [], []
        while todo:
            v, row, off = todo.pop(0), [], []
            for s in SYMBOLS:
                before = _closed([min(cost + v[to] for _, cost, to in _moves(s, q)) for q in range(4)])
                least = min(before)
                before = tuple(c - least for c in before)
                if before not in number:
                    number[before] = len(self.vectors)
                    self.vectors.append(before)
                    todo.append(before)
                row.append(number[before])
                off.append(least)
            step.append(row)
            gain.append(off)
        self.step, self.gain = np.array(step), np.array(gain)
        n = len(self.vectors)
        block_step, block_gain = np.arange(n)[:, None], np.zeros((n, 1), np.int64)
        for _ in range(size):
            block_gain = (block_gain[:, :, None] + self.gain[block_step]).reshape(n, -1)
            block_step = self.step[block_step].reshape(n, -1)
        self.block_step, self.block_gain = block_step, block_gain
        self.taken = [[[self._taken(s, v, q) for q in range(4)] for v in self.vectors] for s in SYMBOLS]
        self.ending = ["", "II", "I", ""]  # insertions after the last turn

    @staticmethod
    def _taken(symbol: str, after: tuple[int, ...], q: int) -> tuple[str, int]:
        before = _closed([min(cost + after[to] for _, cost, to in _moves(symbol, p)) for p in range(4)])
        letters = ""
        while True:
            ways = [*_moves(symbol, q), ("I", INSERT, None)]
            for letter, cost, to in sorted(ways, key=lambda w: w[0]):
                if cost + (after[to] if letter != "I" else before[ASKED[q][0]]) == before[q]:
                    break
            letters += letter
            if letter != "I":
                return letters, to
            q = ASKED[q][0]

    def _blocks(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the whole blocks, from the last to the first, and the symbols before them, last first."""
        back = symbols[::-1]
        whole = len(back) // self.size * self.size
        weights = len(SYMBOLS) ** np.arange(self.size - 1, -1, -1)
        return back[:whole].reshape(-1, self.size) @ weights, back[whole:]

    def map(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each vector after the symbols: the vector before them and the offset."""
        at, cost = np.arange(len(self.vectors)), np.zeros(len(self.vectors), np.int64)
        blocks, rest = self._blocks(symbols)
        for tables, numbers in ((self.block_step, self.block_gain), blocks), ((self.step, self.gain), rest):
            for b in numbers:
                at, cost = tables[0][at, b], cost + tables[1][at, b]
        return at, cost

    def before(self, symbols: np.ndarray, after: int) -> tuple[int, int]:
        """Vector before the symbols, and the offset, for one vector after them."""
        blocks, rest = self._blocks(symbols)
        cost = 0
        for b in blocks:
            after, cost = self.block_step[after, b], cost + self.block_gain[after, b]
        for s in rest:
            after, cost = self.step[after, s], cost + self.gain[after, s]
        return int(after), int(cost)

    def trace(self, symbols: np.ndarray, after: int, q: int) -> tuple[list[str], int]:
        """The letters of each turn, given the vector after the last and the state before the first."""
        blocks, _ = self._blocks(symbols)
        bounds = [after]
        for b in blocks:
            bounds.append(self.block_step[bounds[-1], b])
        n, inner = len(symbols), np.empty(len(symbols), np.int64)  # inner[i]: the vector after turn i
        for k, v in enumerate(bounds):
            for i in range(n - 1 - k * self.size, max(-1, n - 1 - (k + 1) * self.size), -1):
                inner[i] = v
                v = self.step[v, symbols[i]]
        out = []
        for s, v in zip(symbols.tolist(), inner.tolist(), strict=True):
            letters, q = self.taken[s][v][q]
            out.append(letters)
        return out, q


@cache
def tables() -> BlockTables:
    return BlockTables()


def symbols_of(roles: list[str], texts: list[str], repeats: list[bool]) -> tuple[np.ndarray, tuple[int, int, int]]:
    """Symbols of turns, and how many are blank, repeated and truncated; the first fault counts."""
    out, counts = [], [0, 0, 0]
    for role, text, again in zip(roles, texts, repeats, strict=True):
        end = text.rstrip(" \t\n\v\f\r")
        kind = role[:1] if role[:1] in ("s", "u", "a") else "o"
        fault = 0 if not end else 1 if again else 2 if end[-1] not in ".!?" else None
        if fault is not None:
            counts[fault] += 1
        out.append(SYMBOLS.index("D" if fault in (0, 1) else kind.upper() if fault == 2 else kind))
    return np.array(out, np.int64), tuple(counts)


def repaired(letters: list[str], roles: list[str], texts: list[str], q: int) -> Iterator[tuple[str, str]]:
    """(role, text) of the turns that stay, reroled and inserted ones included, from state q on."""
    for edits, role, text in zip(letters, roles, texts, strict=True):
        for x in edits:
            to, asked = ASKED[q]
            if x == "K":
                yield role, text
                q = NEXT[role[0]][q]
            elif x != "D":
                yield ROLES[asked], text if x == "R" else ""
                q = to


def _joined(turns: Iterator[tuple[str, str]]) -> str:
    return "\n".join(f"{role}:{text}" for role, text in turns)


def _inserted(q: int) -> Iterator[tuple[str, str]]:
    for _ in tables().ending[q]:
        yield ROLES[ASKED[q][1]], ""
        q = ASKED[q][0]


def damaged(turns: DataFrame) -> DataFrame:
    """`conv_id, turn, role, text, live`: turns with nulls of role and text as one space, damaged by
    crc32 of `conv_id:turn` modulo 20; a dropped turn stays as a row that isn't live."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn")).cast("binary")) % 20
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), text("role").alias("role"), text("text").alias("text"), kind.alias("kind"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    words = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    out = rows.select("conv_id", "turn", role.alias("role"), words.alias("text"), (F.col("kind") != 0).alias("live"), F.explode(F.sequence(F.lit(0), F.when(F.col("kind") == 3, 1).otherwise(0))).alias("copy"))
    return out.drop("copy")


def _key(role: str, text: str) -> bytes:
    return xxhash.xxh3_128_digest(f"{len(role)}:{role}{text}".encode())


def _pieces(turns: DataFrame) -> DataFrame:
    """Runs of turns of one conversation, in order. Rows are dealt by ranges of conversation, turn, role
    and text, so a long conversation lies over several tasks; `edge` marks pieces that may have
    neighbours."""
    schema = turns.sparkSession.createDataFrame([], PIECE).schema
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)

    def piece(part: int, k: int, conv, edge: bool, rows: list[tuple]) -> dict:
        live = [r for r in rows if r[3]]
        roles, texts = [r[1] for r in live], [r[2] for r in live]
        held = [r[0] for r in live if r[0] is not None]
        seen: set[bytes] = set()
        keys = [_key(role, text) for role, text in zip(roles, texts, strict=True)]
        repeats = [key in seen or seen.add(key) is not None for key in keys]
        pairs = sum(a[:1] + b[:1] not in ("su", "ua", "au") for a, b in zip(roles, roles[1:], strict=False))
        ends = (roles[0][:1], roles[-1][:1]) if live else (None, None)
        # Of a conversation that is whole in this piece nothing else needs the keys.
        return dict(zip(arrow.names, (conv, part, k, edge, len(live), len(set(held)), min(held, default=None), max(held, default=None), *ends, pairs, roles, texts, keys if edge else [], repeats), strict=True))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, k, rows, size, at, first = TaskContext.get().partitionId(), 0, [], 0, None, True
        out, held = [], 0

        def cut(edge: bool):
            nonlocal k, rows, size, held
            out.append(piece(part, k, at, edge, rows))
            held += size
            k, rows, size = k + 1, [], 0

        split = False  # the conversation at hand has been cut
        for batch in batches:
            for conv, *row in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if rows and conv != at:
                    cut(first or split)
                    first = split = False
                elif rows and (len(rows) >= TURNS or size >= BYTES):
                    cut(True)
                    split = True
                at = conv
                rows.append(tuple(row))
                size += len(row[2])
                if held >= BYTES or len(out) >= 1000:
                    yield pa.RecordBatch.from_pylist(out, arrow)
                    out, held = [], 0
        if rows:
            cut(True)
        if out:
            yield pa.RecordBatch.from_pylist(out, arrow)

    # The last key only splits equal rows, which may lie in any order.
    keyed = turns.withColumn("at", F.monotonically_increasing_id())
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text"), F.col("at")]
    dealt = keyed.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "turn", "role", "text", "live")
    return saved(dealt.mapInArrow(run, PIECE), "turn-pieces")


RESULT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def _whole(pieces: DataFrame) -> DataFrame:
    """Results of conversations that are one piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = tables()
        for batch in batches:
            rows = []
            for x in batch.to_pylist():
                symbols, counts = symbols_of(x["roles"], x["texts"], x["repeats"])
                vector, cost = block.before(symbols, 0)
                letters, q = block.trace(symbols, 0, 0)
                turns = [*repaired(letters, x["roles"], x["texts"], 0), *_inserted(q)]
                gaps = x["high"] - x["low"] + 1 - x["turns"] if x["turns"] else 0
                rows.append((x["conv_id"], gaps, *counts, x["illegal"], cost + block.vectors[vector][0], "".join(letters) + block.ending[q], _sha(_joined(turns))))
            if rows:
                yield _batch(rows)

    return pieces.mapInArrow(run, RESULT)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    names = [x.strip().split()[0] for x in RESULT.split(",")]
    kinds = [pa.int64()] * 7 + [pa.string()] * 2
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def _spread(pieces: DataFrame) -> DataFrame:
    """Results of conversations that may have several pieces: repeats across pieces by a join on keys,
    the pieces' maps chained, each piece traced by itself, and its text hashed in order as a stream."""
    turn = pieces.select("conv_id", "part", "k", F.posexplode("keys").alias("i", "key"))
    known = turn.groupBy("conv_id", "key").agg(F.min(F.struct("part", "k")).alias("lo")).select(F.col("conv_id").alias("of"), F.col("key").alias("same"), "lo")
    late = turn.join(known, F.col("conv_id").eqNullSafe(F.col("of")) & (F.col("key") == F.col("same"))).where("struct(part, k) > lo")
    late = late.groupBy("conv_id", "part", "k").agg(F.collect_list("i").alias("again"))
    late = late.select("part", "k", "again")  # part and k name a piece
    pieces = saved(pieces.drop("keys").join(late, ["part", "k"], "left"), "turn-spread")

    def flags(x: dict) -> list[bool]:
        again = set(x["again"] or ())
        return [r or i in again for i, r in enumerate(x["repeats"])]

    def maps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = tables()
        for batch in batches:
            rows = []
            for x in batch.to_pylist():
                symbols, counts = symbols_of(x["roles"], x["texts"], flags(x))
                to, cost = block.map(symbols)
                ends = [block.trace(symbols, v, q)[1] for v in range(len(block.vectors)) for q in range(4)]
                rows.append((x["conv_id"], x["part"], x["k"], x["n"], x["turns"], x["low"], x["high"], x["first"], x["last"], x["illegal"], *counts, to.tolist(), cost.tolist(), ends))
            if rows:
                kinds = [pa.int64(), *[pa.int32()] * 4, pa.int64(), pa.int64(), pa.string(), pa.string(), *[pa.int64()] * 4, pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int32())]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    schema = "conv_id long, part int, k int, n int, turns int, low long, high long, first string, last string, illegal long, blank long, duplicate long, truncated long, step array<int>, gain array<long>, ends array<int>"
    names = [x.strip().split()[0] for x in schema.split(",")]
    mapped = pieces.mapInArrow(maps, schema)

    def chain(group: pa.Table) -> pa.Table:
        block = tables()
        rows = sorted(group.to_pylist(), key=lambda x: (x["part"], x["k"]))
        after, cost, q = 0, 0, 0
        for x in reversed(rows):
            x["after"] = after
            cost += x["gain"][after]
            after = x["step"][after]
        total = cost + block.vectors[after][0]
        gaps = illegal = 0
        low = high = last = None
        distinct = 0
        for x in rows:
            x["q"] = q
            q = x["ends"][4 * x["after"] + q]
            illegal += x["illegal"]
            if x["n"]:
                illegal += last is not None and last + x["first"] not in ("su", "ua", "au")
                last = x["last"]
            if x["turns"]:
                distinct += x["turns"] - (x["low"] == high)
                low = x["low"] if low is None else low
                high = x["high"]
        if distinct:
            gaps = high - low + 1 - distinct
        faults = [sum(x[c] for x in rows) for c in ("blank", "duplicate", "truncated")]
        made = [(x["part"], x["k"], x["after"], x["q"], i == len(rows) - 1, gaps, *faults, illegal, total) for i, x in enumerate(rows)]
        kinds = [*[pa.int32()] * 4, pa.bool_(), *[pa.int64()] * 6]
        return pa.table([pa.array(c, k) for c, k in zip(zip(*made, strict=True), kinds, strict=True)], names=[x.strip().split()[0] for x in bounds.split(",")])

    bounds = "part int, k int, after int, q int, final boolean, gaps long, blank long, duplicate long, truncated long, illegal long, cost long"
    chained = mapped.groupBy("conv_id").applyInArrow(chain, bounds)

    def traced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = tables()
        for batch in batches:
            rows = []
            for x in batch.to_pylist():
                symbols, _ = symbols_of(x["roles"], x["texts"], flags(x))
                letters, q = block.trace(symbols, x["after"], x["q"])
                turns = list(repaired(letters, x["roles"], x["texts"], x["q"]))
                audit = "".join(letters)
                if x["final"]:
                    audit += block.ending[q]
                    turns += _inserted(q)
                rows.append((x["conv_id"], x["part"], x["k"], x["final"], x["gaps"], x["blank"], x["duplicate"], x["truncated"], x["illegal"], x["cost"], audit, _joined(iter(turns)), bool(turns)))
            if rows:
                kinds = [pa.int64(), pa.int32(), pa.int32(), pa.bool_(), *[pa.int64()] * 6, pa.string(), pa.string(), pa.bool_()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], [x.strip().split()[0] for x in edits.split(",")])

    edits = "conv_id long, part int, k int, final boolean, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, turns string, some boolean"
    each = pieces.select("conv_id", "part", "k", "roles", "texts", "repeats", "again").join(chained, ["part", "k"]).mapInArrow(traced, edits)

    def streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest, audit, begun = hashlib.sha256(), [], False
        for batch in batches:
            rows = []
            for x in batch.to_pylist():
                audit.append(x["audit"])
                if x["some"]:
                    digest.update(("\n" * begun + x["turns"]).encode())
                    begun = True
                if x["final"]:
                    rows.append((*(x[c] for c in ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost")), "".join(audit), digest.hexdigest()))
                    digest, audit, begun = hashlib.sha256(), [], False
            if rows:
                yield _batch(rows)

    return each.repartition("conv_id").sortWithinPartitions("conv_id", "part", "k").mapInArrow(streamed, RESULT)


def repairs(turns: DataFrame) -> DataFrame:
    """Per conversation the faults of its turns, the least cost, the edits and the digest of the repair.

    turns: `conv_id, turn, role, text, live`; a row that isn't live only names its conversation. Turns
    go by `turn`, nulls first, equal ones by role and text. Roles count by their first character; a
    role that begins with none of s, u, a (an empty one included) can't be kept. Null conv_ids are one
    conversation. Other columns are ignored; an empty table gives no rows. A conversation of any length
    is spread over tasks; only its letters and, as a stream, its repaired text meet in one.
    """
    tune(turns.sparkSession, 500)
    pieces = _pieces(turns)
    return _whole(pieces.where("NOT edge")).union(_spread(pieces.where("edge")))


def op13_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repairs(damaged(table(spark, sf_dir, "conversations")))
