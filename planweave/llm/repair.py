"""Conversation structure repair: generalised LR parsing with weighted edits over a grammar of roles.

A conversation is a word over role initials; the cheapest edits (keep, rerole, delete, insert) that make it a word of the grammar are
found with a graph-structured stack. Parsing goes along sorted partitions: a conversation that spans several of them is parsed in segments,
from each stack that may come before one, and the segments' tables are then composed, so that no conversation has to fit in one task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import groupby

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from planweave.llm.common import stored

#: The language of repaired conversations, (s?(ua)+)?, as rules: an optional system turn, then pairs of user and assistant.
GRAMMAR = (("S", ""), ("S", "B"), ("S", "sB"), ("B", "ua"), ("B", "Bua"))
START = "S"
#: Roles that an edit may give, by initial.
ROLES = {"u": "user", "a": "assistant"}
REROLE, DELETE, INSERT, CUT_OFF = 3, 4, 3, 3
NO_FAULT, BLANK, DUPLICATE, TRUNCATED = range(4)
#: Characters that are no part of a word (fixed by the data contract).
SPACES = "\x20\t\n\x0b\x0c\r"

Stack = tuple  # (state, stack below); the bottom is (0, None). Stacks share what lies below, which makes the set of them a graph.


class Automaton:
    """The LR(0) automaton of a grammar of one-letter symbols; conflicts fork the stack."""

    def __init__(self, rules=GRAMMAR, start: str = START):
        self.rules = (("'", start), *rules)
        self.items = [self._closed({(0, 0)})]
        self.goto: list[dict[str, int]] = []
        for items in self.items:  # grows while it is walked
            moves: dict[str, set] = {}
            for rule, dot in items:
                if dot < len(self.rules[rule][1]):
                    moves.setdefault(self.rules[rule][1][dot], set()).add((rule, dot + 1))
            row = {}
            for symbol, kernel in sorted(moves.items()):
                target = self._closed(kernel)
                if target not in self.items:
                    self.items.append(target)
                row[symbol] = self.items.index(target)
            self.goto.append(row)

    def _closed(self, items: set) -> frozenset:
        todo, seen = list(items), set(items)
        while todo:
            rule, dot = todo.pop()
            right = self.rules[rule][1]
            if dot < len(right):
                new = {(i, 0) for i, (left, _) in enumerate(self.rules) if left == right[dot]} - seen
                seen |= new
                todo += new
        return frozenset(seen)

    def _reduced(self, stack: Stack) -> list[Stack]:
        out = []
        for rule, dot in self.items[stack[0]]:
            left, right = self.rules[rule]
            if rule and dot == len(right):
                below = stack
                for _ in right:
                    below = below[1]
                out.append((self.goto[below[0]][left], below))
        return out

    def settled(self, stack: Stack) -> Stack:
        """The stack after reductions that leave no choice, so that equal tops meet."""
        while len(self.items[stack[0]]) == 1 and (done := self._reduced(stack)):
            stack = done[0]
        return stack

    def _forks(self, stack: Stack) -> set[Stack]:
        todo, seen = [stack], {stack}
        while todo:
            new = set(self._reduced(todo.pop())) - seen
            seen |= new
            todo += new
        return seen

    def shifted(self, stack: Stack, symbol: str) -> list[Stack]:
        """All stacks after a symbol: every fork that can take it does."""
        return sorted({self.settled((self.goto[s[0]][symbol], s)) for s in self._forks(stack) if symbol in self.goto[s[0]]}, key=repr)

    def accepts(self, stack: Stack) -> bool:
        return any((0, 1) in self.items[s[0]] and s[1] == (0, None) for s in self._forks(stack))


AUTOMATON = Automaton()
BOTTOM: Stack = (0, None)


def _all_stacks() -> list[Stack]:
    """Every stack that the grammar can lead to; this grammar's stacks are bounded in depth, so they are few."""
    found = [BOTTOM]
    for stack in found:
        found += [s for symbol in "sua" for s in AUTOMATON.shifted(stack, symbol) if s not in found]
    return found


STACKS = _all_stacks()
SHIFT = {(i, symbol): [STACKS.index(s) for s in AUTOMATON.shifted(stack, symbol)] for i, stack in enumerate(STACKS) for symbol in "sua"}
ACCEPTING = frozenset(i for i, stack in enumerate(STACKS) if AUTOMATON.accepts(stack))

#: Tops of a level: (stack, cost above the cheapest) in the order of their audits.
Tops = tuple[tuple[int, int], ...]
FIRST: Tops = ((0, 0),)


def _with_inserts(tops: Tops) -> list[tuple[int, int, int, str]]:
    """Cheapest ``cost, rank, inserts`` to every stack by inserted turns alone, as ``(stack, cost, rank, inserts)``."""
    best = {stack: (cost, rank, "") for rank, (stack, cost) in enumerate(tops)}
    todo = list(best)
    while todo:
        stack = todo.pop()
        cost, rank, letters = best[stack]
        for symbol in ROLES:
            for after in SHIFT[stack, symbol]:
                new = (cost + INSERT, rank, letters + "I")
                if after not in best or new < best[after]:
                    best[after] = new
                    todo.append(after)
    return [(stack, *value) for stack, value in best.items()]


@lru_cache(maxsize=1 << 14)
def advance(tops: Tops, initial: str, fault: int) -> tuple[int, Tops, tuple[tuple[int, str], ...]]:
    """One row: what the cheapest cost grows by, the new tops, and for each the rank it came from and its letters.

    Equal stacks merge by the least (cost, audit). Audits are compared by the rank of what came before, then by the letters of this row: a row's letters are
    inserts and one of K, R, D, and none of these begins with another, so ranks order whole audits. Only differences of cost matter, so few tops exist and
    a row is one look-up.
    """
    best: dict[int, tuple[int, int, str]] = {}

    def offer(stack: int, cost: int, rank: int, letters: str) -> None:
        if stack not in best or (cost, rank, letters) < best[stack]:
            best[stack] = (cost, rank, letters)

    for stack, cost, rank, letters in _with_inserts(tops):
        offer(stack, cost + DELETE, rank, letters + "D")
        if fault not in (BLANK, DUPLICATE):
            more = cost + CUT_OFF * (fault == TRUNCATED)
            for after in SHIFT.get((stack, initial), ()):
                offer(after, more, rank, letters + "K")
            for symbol in ROLES:
                for after in SHIFT[stack, symbol]:
                    offer(after, more + REROLE, rank, letters + "R")
    ordered = sorted(best.items(), key=lambda e: e[1][1:])
    least = min(cost for _, (cost, _, _) in ordered)
    return least, tuple((s, c - least) for s, (c, _, _) in ordered), tuple((r, letters) for _, (_, r, letters) in ordered)


def parse(rows: list[tuple[str, int]], entry: int = 0) -> list[tuple[int, int, str]]:
    """``(stack, cost, audit)`` in the order of audits: what the rows (initial, fault) lead to from the stack ``entry``."""
    tops, total, back = ((entry, 0),), 0, []
    for initial, fault in rows:
        more, tops, links = advance(tops, initial, fault)
        total += more
        back.append(links)
    out = []
    for at, (stack, cost) in enumerate(tops):
        letters = []
        for links in reversed(back):
            at, step = links[at]
            letters.append(step)
        out.append((stack, total + cost, "".join(reversed(letters))))
    return out


def finish(tops: list[tuple[int, int]]) -> tuple[int, int, str]:
    """``cost, rank, inserts`` of the cheapest end from tops (stack, cost) in the order of their audits."""
    return min((cost, rank, letters) for stack, cost, rank, letters in _with_inserts(tuple(tops)) if stack in ACCEPTING)


def composed(segments: list[list[list[tuple[int, int]]]]) -> tuple[int, str, list[tuple[int, int]]]:
    """Cost, trailing inserts, and the way through segments in order. ``segments[k][entry]`` lists (stack, cost) in the order of audits; the way has (entry, rank) of each."""
    tops: list[tuple[int, int]] = [(0, 0)]
    back = []
    for table in segments:
        best: dict[int, tuple[int, int, int]] = {}
        for rank, (entry, cost) in enumerate(tops):
            for place, (stack, more) in enumerate(table[entry]):
                new = (cost + more, rank, place)
                if stack not in best or new < best[stack]:
                    best[stack] = new
        ordered = sorted(best.items(), key=lambda e: e[1][1:])
        back.append([(tops[rank][0], rank, place) for _, (_, rank, place) in ordered])
        tops = [(stack, cost) for stack, (cost, _, _) in ordered]
    cost, at, inserts = finish(tops)
    way = []
    for links in reversed(back):
        entry, at, place = links[at]
        way.append((entry, place))
    return cost, inserts, way[::-1]


def applied(audit: str, rows: list[tuple[str, str]], expected: str) -> tuple[list[tuple[str, str]], str]:
    """The repaired rows (role, text) that an audit makes of ``rows``, and the initial that edits give next; ``expected`` is that at the beginning."""
    out, source = [], iter(rows)
    for letter in audit:
        if letter == "D":
            next(source)
            continue
        role, text = (ROLES[expected], "") if letter == "I" else next(source)
        out.append((ROLES[expected] if letter == "R" else role, text))
        expected = "a" if out[-1][0][:1] == "u" else "u"
    return out, expected


# The same on Spark.


def _text(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit(" "))


def faults(turns: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text, n, fault`` of each distinct row: ``n`` rows are equal to it, ``fault`` is the first one's first fault.

    Blank: no character of a word. Duplicate: a row of the same role and text comes earlier (by turn, nulls first). Truncated: the last character of a word is no
    ``.``, ``!`` or ``?``. Equal rows are counted before anything is dealt by key; earlier rows are found by the smallest turn of each role and text.
    """
    rows = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), _text("role").alias("role"), _text("text").alias("text"))
    each = rows.groupBy("conv_id", "turn", "role", "text").agg(F.count("*").alias("n")).withColumn("_digest", F.sha2("text", 256))
    order = F.struct(F.col("turn").isNotNull().alias("some"), "turn")
    first = each.groupBy(F.col("conv_id").alias("_c"), F.col("role").alias("_r"), F.col("_digest").alias("_d")).agg(F.min(order).alias("_first"))
    same = F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("role") == F.col("_r")) & (F.col("_digest") == F.col("_d"))
    trimmed = F.rtrim(F.col("text"), F.lit(SPACES))
    fault = (
        F.when(trimmed == "", BLANK)
        .when(~F.col("turn").eqNullSafe(F.col("_first.turn")), DUPLICATE)
        .when(~F.substring(trimmed, -1, 1).isin(".", "!", "?"), TRUNCATED)
        .otherwise(NO_FAULT)
    )
    return each.join(first, same).select("conv_id", "turn", "role", "text", "n", fault.alias("fault"))


_SEGMENT = (
    "conv_id {id}, part int, at int, blank long, duplicate long, truncated long, illegal long, first string, last string, first_turn long, last_turn long, turns long, "
    "entry array<int>, exit array<int>, cost array<long>, audit array<string>, role array<string>, text array<string>"
)


def legal(before: str, after: str) -> bool:
    return before + after in ("su", "ua", "au")


def _segment(rows: list[tuple], entries: range | list[int]) -> tuple:
    initials = [(role[:1], fault) for _, role, _, fault in rows]
    turns = [t for t, *_ in rows if t is not None]
    found = [(entry, *way) for entry in entries for way in parse(initials, entry)]
    count = lambda kind: sum(f == kind for _, f in initials)
    illegal = sum(not legal(a, b) for (a, _), (b, _) in zip(initials, initials[1:], strict=False))
    seen = (turns[0], turns[-1], 1 + sum(a != b for a, b in zip(turns, turns[1:], strict=False))) if turns else (None, None, 0)
    return (count(BLANK), count(DUPLICATE), count(TRUNCATED), illegal, initials[0][0], initials[-1][0], *seen, *map(list, zip(*found, strict=True)), [r[1] for r in rows], [r[2] for r in rows])


def segments(rows: DataFrame) -> DataFrame:
    """Parsed segments of conversations from ``faults``: rows in order are dealt by ranges, so a long conversation is spread over partitions.

    Only a partition's first conversation may have begun before; it is parsed from every stack, the others from the empty one.
    """
    fields = _SEGMENT.format(id=rows.schema["conv_id"].dataType.simpleString())
    head = F.substring("text", 1, 64)
    dealt = rows.repartitionByRange("conv_id", "turn", "role", head).sortWithinPartitions("conv_id", "turn", "role", "text")
    names = [f.split(" ")[0] for f in fields.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made = TaskContext.get().partitionId(), []

        def read() -> Iterator[tuple]:
            for batch in batches:
                yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)

        def flush() -> pa.RecordBatch:
            columns = [pa.array(list(c), t) for c, t in zip(zip(*made, strict=True), types, strict=True)]
            made.clear()
            return pa.RecordBatch.from_arrays(columns, names)

        size = 0
        for at, (conv_id, group) in enumerate(groupby(read(), key=lambda r: r[0])):
            found = []
            for _, turn, role, text, n, fault in group:
                found.append((turn, role, text, fault))
                found += [(turn, role, text, BLANK if fault == BLANK else DUPLICATE)] * (n - 1)
            made.append((conv_id, part, at, *_segment(found, range(len(STACKS)) if at == 0 else [0])))
            size += sum(len(r[2]) for r in found) + 64 * len(found)
            if size > 1 << 22:
                yield flush()
                size = 0
        if made:
            yield flush()

    id_type = pa.schema(_arrow_fields(rows.select("conv_id"))).types[0]
    ints, texts = pa.int64(), pa.string()
    types = [id_type, pa.int32(), pa.int32(), *[ints] * 4, texts, texts, *[ints] * 3, pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(ints), *[pa.list_(texts)] * 3]
    return dealt.mapInArrow(run, fields)


def _arrow_fields(df: DataFrame) -> list[pa.Field]:
    from pyspark.sql.pandas.types import to_arrow_schema

    return list(to_arrow_schema(df.schema))


def _streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(0, batch.num_rows, 256):
            yield from batch.slice(i, 256).to_pylist()


def _table(row: dict) -> list[list[tuple[int, int]]]:
    table: list[list[tuple[int, int]]] = [[] for _ in STACKS]
    for entry, stack, cost in zip(row["entry"], row["exit"], row["cost"], strict=True):
        table[entry].append((stack, cost))
    return table


def repair_conversations(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Cheapest repair of each conversation in ``turns`` (``conv_id, turn, role, text``): a summary and the repaired segments.

    Summary: ``conv_id, gaps, blank, duplicate, truncated, illegal, cost``. Segments: ``conv_id, part, audit, repaired`` (array of role, text), to be read in the
    order of ``part``. Rows are taken by turn (nulls first), then role and text; rows that repeat are next to each other. Nulls in conv_id are one
    conversation, in role and text one space; unknown and empty roles cannot stay. An empty table has no conversations; other columns are not read. Nothing but the small
    tables of a conversation's segments (one per partition that it spans) is held at once.
    """
    parts = stored(segments(faults(turns)), "conversation-segments")
    id_type = turns.schema["conv_id"].dataType.simpleString()
    small = parts.drop("role", "text", "audit")

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = []
        for conv_id, group in groupby(_streamed(batches), key=lambda r: r["conv_id"]):
            rows = list(group)  # one a partition, without texts
            cost, inserts, way = composed([_table(r) for r in rows])
            turns = [r for r in rows if r["turns"]]
            joints = list(zip(turns, turns[1:], strict=False))
            distinct = sum(r["turns"] for r in turns) - sum(a["last_turn"] == b["first_turn"] for a, b in joints)
            gaps = turns[-1]["last_turn"] - turns[0]["first_turn"] + 1 - distinct if turns else 0
            illegal = sum(r["illegal"] for r in rows) + sum(not legal(a["last"], b["first"]) for a, b in zip(rows, rows[1:], strict=False))
            total = [sum(r[c] for r in rows) for c in ("blank", "duplicate", "truncated")]
            for i, (r, (entry, place)) in enumerate(zip(rows, way, strict=True)):
                last = i == len(rows) - 1
                summary = (gaps, *total, illegal, cost) if last else (None,) * 6
                made.append((conv_id, r["part"], r["entry"].index(entry) + place, inserts if last else "", *summary))
            if len(made) > 4096:
                yield batch(made)
        yield batch(made)

    def batch(made: list[tuple]) -> pa.RecordBatch:
        columns = [*zip(*made, strict=True)] or [()] * 10
        types = [arrow_id, pa.int32(), pa.int32(), pa.string(), *[pa.int64()] * 6]
        out = pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], names)
        made.clear()
        return out

    names = ["conv_id", "part", "pick", "inserts", "gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    arrow_id = _arrow_fields(turns.select("conv_id"))[0].type
    fields = f"conv_id {id_type}, part int, pick int, inserts string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long"
    folded = stored(small.repartition("conv_id").sortWithinPartitions("conv_id", "part").mapInArrow(fold, fields), "conversation-ways")
    summary = folded.where("cost IS NOT NULL").drop("part", "pick", "inserts")
    ways = folded.select(F.col("conv_id").alias("_c"), F.col("part").alias("_p"), "pick", "inserts")
    met = parts.join(ways, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("part") == F.col("_p")))
    chosen = met.select("conv_id", "part", F.concat(F.element_at("audit", F.col("pick") + 1), "inserts").alias("audit"), F.col("entry")[F.col("pick")].alias("entry"), "role", "text")
    names_out = ["conv_id", "part", "audit", "repaired"]
    repaired_type = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))

    def rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 256):
                rows = b.slice(i, 256).to_pylist()
                done = [applied(r["audit"], list(zip(r["role"], r["text"], strict=True)), NEXT[r["entry"]])[0] for r in rows]
                listed = pa.array([[{"role": x, "text": t} for x, t in d] for d in done], repaired_type)
                yield pa.RecordBatch.from_arrays([*(b.slice(i, 256).column(k) for k in range(3)), listed], names_out)

    return summary, chosen.mapInArrow(rebuild, f"conv_id {id_type}, part int, audit string, repaired array<struct<role:string,text:string>>")


#: The initial that an edit gives next, by stack: an assistant where one can follow, else a user.
NEXT = ["a" if SHIFT[i, "a"] else "u" for i in range(len(STACKS))]


def digests(repaired: DataFrame) -> DataFrame:
    """``conv_id, audit, repaired_sha256``: a conversation's segments are read in order, one at a time."""
    id_type = repaired.schema["conv_id"].dataType.simpleString()
    arrow_id = _arrow_fields(repaired.select("conv_id"))[0].type

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = []
        for conv_id, group in groupby(_streamed(batches), key=lambda r: r["conv_id"]):
            digest, audit, first = hashlib.sha256(), [], True
            for r in group:
                audit.append(r["audit"])
                for turn in r["repaired"]:
                    digest.update(("" if first else "\n").encode() + f"{turn['role']}:{turn['text']}".encode())
                    first = False
            made.append((conv_id, "".join(audit), digest.hexdigest()))
            if len(made) > 4096:
                yield out(made)
        yield out(made)

    def out(made: list[tuple]) -> pa.RecordBatch:
        columns = [*zip(*made, strict=True)] or [()] * 3
        done = pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, [arrow_id, pa.string(), pa.string()], strict=True)], ["conv_id", "audit", "repaired_sha256"])
        made.clear()
        return done

    return repaired.repartition("conv_id").sortWithinPartitions("conv_id", "part").mapInArrow(run, f"conv_id {id_type}, audit string, repaired_sha256 string")


def damaged(conversations: DataFrame) -> DataFrame:
    """The rows of a table of conversations with the contract's damage: by the checksum of ``conv_id:turn`` a row is dropped, emptied, stripped of its stops, repeated or given to the user."""
    kind = F.crc32(F.concat(_text("conv_id"), F.lit(":"), _text("turn"))) % 20
    text = F.when(kind == 1, F.lit("")).when(kind == 2, F.regexp_replace(_text("text"), "[.!?]", "")).otherwise(_text("text"))
    role = F.when(kind == 4, F.lit("user")).otherwise(_text("role"))
    rows = conversations.where(kind != 0).select("conv_id", "turn", role.alias("role"), text.alias("text"), kind.alias("_kind"))
    return rows.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.when(F.col("_kind") == 3, 2).otherwise(1)))).drop("_kind", "_copy")


def op13_repair_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All damaged conversations, repaired; a conversation of which no row is left has zeros and empty texts."""
    table = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    summary, repaired = repair_conversations(damaged(table))
    every = table.select("conv_id").distinct()
    found = summary.withColumnRenamed("conv_id", "_c")
    texts = digests(repaired).withColumnRenamed("conv_id", "_d")
    met = every.join(found, F.col("conv_id").eqNullSafe(F.col("_c")), "left").join(texts, F.col("conv_id").eqNullSafe(F.col("_d")), "left")
    counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return met.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


QUERIES = {"op13_repair_conversations": op13_repair_conversations}
SQL: dict[str, str] = {}
