"""Conversation structure repair by weighted CYK parsing of intervals.

The rows of a conversation are the terminals.  Role initials must read ``(s?(ua)+)?``;
a row may be kept (K, cost 0), given the role user or assistant (R, 1) or deleted (D, 2),
and a row with an empty text may be inserted anywhere (I, 5).  A blank or duplicate row
must be deleted; a truncated one costs 5 more unless it is.

The repair grammar is in Chomsky normal form.  Its nonterminals ``X(p,q)`` stand for
any span that leads from one of four states to another (nothing yet, after system,
after user, after assistant), and its rules are ``X(p,q) -> X(p,r) X(r,q)`` and those of
a single row.  The cell of a span holds for each nonterminal the least (cost, audit),
closed under insertions on both sides.  Cells are combined bottom-up by span length:
spans of 1, 2, 4, ... rows.  Every cut of a span gives the same cell, because the rules
hold for every middle state and audits of one cost and one span are never prefixes of each
other; so one cut of each span is enough, and a conversation of n rows costs n
combinations and holds log n cells at a time.

Rows are range-sorted by conversation and turn, each partition parses its stretch of a
conversation, and the cells of the stretches are combined again: a conversation of any
number of rows is parsed side by side.  Its audit is one string of a letter a row.

Rows of one turn are taken by role and then by the SHA-256 of role and text; equal rows
are interchangeable.  Null turns come first.  Null roles and texts are one space, a null
conv_id is a conversation like others, other columns are left out.  A role whose first
character is not s, u or a cannot be kept.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from chatledger.llm.common import Scratch

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
#: States between which a row with the initial leads.
MOVES = {
    "s": [(NOTHING, SYSTEM)],
    "u": [(NOTHING, USER), (SYSTEM, USER), (ASSISTANT, USER)],
    "a": [(USER, ASSISTANT)],
}
ENDS = (NOTHING, ASSISTANT)
#: White space of the rules, as characters.
SPACES = " \t\n\x0b\f\r"

Entry = tuple[int, str]
Cell = tuple[Entry | None, ...]

NONTERMINALS = sorted(
    {(p, p) for p in range(4)}
    | {(p, q) for p in range(4) for q in (USER, ASSISTANT)}
    | {(NOTHING, SYSTEM)}
)
_NUMBER = {x: i for i, x in enumerate(NONTERMINALS)}
#: For each nonterminal the pairs of nonterminals it can be split into.
RULES = [
    [(_NUMBER[p, r], _NUMBER[r, q]) for r in range(4) if (p, r) in _NUMBER and (r, q) in _NUMBER]
    for p, q in NONTERMINALS
]


def combine(left: Cell, right: Cell) -> Cell:
    """The cell of two neighbouring spans."""
    out = []
    for options in RULES:
        best = None
        for a, b in options:
            x, y = left[a], right[b]
            if x is None or y is None:
                continue
            cost = x[0] + y[0]
            if best is None or cost < best[0] or (cost == best[0] and x[1] + y[1] < best[1]):
                best = cost, x[1] + y[1]
        out.append(best)
    return tuple(out)


#: Short spans repeat a great deal.
_combine_short = lru_cache(1 << 14)(combine)


def _cell(entries: list[tuple[int, int, int, str]]) -> Cell:
    best: list[Entry | None] = [None] * len(NONTERMINALS)
    for p, q, cost, audit in entries:
        k = _NUMBER[p, q]
        if best[k] is None or (cost, audit) < best[k]:
            best[k] = cost, audit
    return tuple(best)


def _insertions() -> Cell:
    """The closure of insertions: the cell of a span without rows."""
    one = [(p, p, 0, "") for p in range(4)]
    one += [(p, q, INSERT, "I") for i in "ua" for p, q in MOVES[i]]
    cell = step = _cell(one)
    while (wider := combine(cell, step)) != cell:
        cell = wider
    return cell


EMPTY = _insertions()


@lru_cache(64)
def row_cell(initial: str, fault: str | None) -> Cell:
    """The cell of one row, closed under insertions before and after it."""
    entries = [(p, p, DELETE, "D") for p in range(4)]
    if fault not in ("blank", "duplicate"):
        more = TRUNCATED if fault == "truncated" else 0
        entries += [(p, q, KEEP + more, "K") for p, q in MOVES.get(initial, [])]
        entries += [(p, q, REROLE + more, "R") for i in "ua" for p, q in MOVES[i]]
    return combine(combine(EMPTY, _cell(entries)), EMPTY)


class Parser:
    """Combines the cells of rows, given in order, by span length."""

    def __init__(self) -> None:
        self.spans: list[tuple[int, Cell]] = []

    def add(self, cell: Cell) -> None:
        length = 1
        while self.spans and self.spans[-1][0] == length:
            before = self.spans.pop()[1]
            cell = (_combine_short if length <= 4 else combine)(before, cell)
            length *= 2
        self.spans.append((length, cell))

    def cell(self) -> Cell:
        whole = EMPTY
        for _, cell in reversed(self.spans):
            whole = combine(cell, whole)
        return whole


def cheapest(cell: Cell) -> Entry:
    """Least (cost, audit) by which a whole conversation gets right."""
    return min(e for q in ENDS if (e := cell[_NUMBER[NOTHING, q]]) is not None)


def damage(conversations: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text`` with the faults that the checksum of ``conv_id:turn``
    puts in: of every 20 rows about one each is dropped, emptied, freed of ``[.!?]``,
    repeated, or given to the user.  Nulls, but for conv_id and turn, become one space."""
    space = F.lit(" ")
    name = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    kind = F.pmod(F.crc32(name.cast("binary")), F.lit(20))
    text = F.coalesce(F.col("text").cast("string"), space)
    role = F.coalesce(F.col("role").cast("string"), space)
    copies = F.explode(F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    rows = conversations.where(kind != 0).select(
        "conv_id",
        "turn",
        F.when(kind == 4, F.lit("user")).otherwise(role).alias("role"),
        F.when(kind == 1, F.lit("")).when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        copies.alias("copy_"),
    )
    return rows.drop("copy_")


def _order() -> list[Column]:
    return [F.col("turn").asc_nulls_first(), F.col("role"), F.col("digest_"), F.col("at_")]


def numbered(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """The rows as the other steps read them: nulls replaced, digests and row numbers."""
    space = F.lit(" ")
    rows = rows.select(
        "conv_id",
        "turn",
        F.coalesce(F.col("role").cast("string"), space).alias("role"),
        F.coalesce(F.col("text").cast("string"), space).alias("text"),
    )
    both = F.concat(F.char_length("role").cast("string"), F.lit(":"), "role", F.lit(":"), "text")
    rows = rows.withColumn("digest_", F.unhex(F.sha2(both.cast("binary"), 256)))
    return scratch.write(rows.withColumn("at_", F.monotonically_increasing_id()), "rows")


def find_faults(rows: DataFrame) -> DataFrame:
    """``fault`` of each of the numbered rows: ``blank``, ``duplicate`` (role and text were
    there earlier in the conversation), ``truncated`` (ends without ``[.!?]``), or null."""
    kept = F.rtrim("text", F.lit(SPACES))
    narrow = rows.select(
        F.col("conv_id"), "turn", "role", "digest_", "at_",
        (kept == "").alias("blank_"),
        F.substring(kept, -1, 1).isin(".", "!", "?").alias("ended_"),
    )
    # Only texts that occur more than once are looked up: few rows, whatever their copies.
    seen = narrow.groupBy(F.col("conv_id").alias("of_"), F.col("digest_").alias("same_")).agg(
        F.count("*").alias("n_"), F.min(F.struct("turn", "at_")).alias("first_")
    ).where("n_ > 1")
    found = narrow.join(seen, F.col("conv_id").eqNullSafe(F.col("of_")) & (F.col("digest_") == F.col("same_")), "left")
    fault = (
        F.when(F.col("blank_"), "blank")
        .when(F.col("first_.at_") != F.col("at_"), "duplicate")
        .when(~F.col("ended_"), "truncated")
    )
    return found.select("conv_id", "turn", "role", "digest_", "at_", fault.alias("fault"))


LEGAL = ("su", "ua", "au")


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each conversation of a sorted partition: its stretch's cell."""
    part = TaskContext.get().partitionId()
    name: object = None
    parser: Parser | None = None
    first = last = ""
    illegal = 0
    ids: pa.DataType | None = None

    def made(done: list) -> pa.RecordBatch:
        names, firsts, lasts, counts, cells = zip(*done)
        return pa.RecordBatch.from_arrays(
            [
                pa.array(names, ids), pa.array([part] * len(done), pa.int32()), pa.array(firsts, pa.string()),
                pa.array(lasts, pa.string()), pa.array(counts, pa.int64()),
                pa.array([[None if e is None else e[0] for e in c] for c in cells], pa.list_(pa.int64())),
                pa.array([[None if e is None else e[1] for e in c] for c in cells], pa.list_(pa.string())),
            ],
            names=["conv_id", "part", "first", "last", "illegal", "costs", "audits"],
        )

    for batch in batches:
        ids = batch.schema.field("conv_id").type
        done = []
        for conv, initial, fault in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "initial", "fault"))):
            if parser is None or conv != name:
                if parser is not None:
                    done.append((name, first, last, illegal, parser.cell()))
                name, parser, first, illegal = conv, Parser(), initial, 0
            elif last + initial not in LEGAL:
                illegal += 1
            parser.add(row_cell(initial, fault))
            last = initial
        if done:
            yield made(done)
    if parser is not None:
        yield made([(name, first, last, illegal, parser.cell())])


def _combine_stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``conv_id, illegal, cost, audit`` from the stretches of a conversation, in order."""
    name: object = None
    parser: Parser | None = None
    last, illegal = "", 0
    ids: pa.DataType | None = None

    def made(done: list) -> pa.RecordBatch:
        names, counts, entries = zip(*done)
        return pa.RecordBatch.from_arrays(
            [
                pa.array(names, ids), pa.array(counts, pa.int64()),
                pa.array([e[0] for e in entries], pa.int64()), pa.array([e[1] for e in entries], pa.string()),
            ],
            names=["conv_id", "illegal", "cost", "audit"],
        )

    for batch in batches:
        ids = batch.schema.field("conv_id").type
        done = []
        columns = ("conv_id", "first", "last", "illegal", "costs", "audits")
        for conv, begin, end, count, costs, audits in zip(*(batch.column(c).to_pylist() for c in columns)):
            if parser is None or conv != name:
                if parser is not None:
                    done.append((name, illegal, cheapest(parser.cell())))
                name, parser, illegal = conv, Parser(), 0
            elif last + begin not in LEGAL:
                illegal += 1
            parser.add(tuple(None if c is None else (c, a) for c, a in zip(costs, audits)))
            illegal, last = illegal + count, end
        if done:
            yield made(done)
    if parser is not None:
        yield made([(name, illegal, cheapest(parser.cell()))])


def parse(faults: DataFrame) -> DataFrame:
    """``conv_id, illegal, cost, audit`` of every conversation in ``find_faults``' rows."""
    conv = F.col("conv_id").asc_nulls_first()
    rows = faults.repartitionByRange(conv, *_order()).sortWithinPartitions(conv, *_order())
    ids = T.StructField("conv_id", faults.schema["conv_id"].dataType)
    stretch = T.StructType([
        ids, T.StructField("part", T.IntegerType()), T.StructField("first", T.StringType()),
        T.StructField("last", T.StringType()), T.StructField("illegal", T.LongType()),
        T.StructField("costs", T.ArrayType(T.LongType())), T.StructField("audits", T.ArrayType(T.StringType())),
    ])
    initial = F.substring("role", 1, 1).alias("initial")
    stretches = rows.select("conv_id", initial, "fault").mapInArrow(_parse, stretch)
    whole = T.StructType([
        ids, T.StructField("illegal", T.LongType()), T.StructField("cost", T.LongType()), T.StructField("audit", T.StringType()),
    ])
    joined = stretches.repartition("conv_id").sortWithinPartitions(conv, "part")
    return joined.mapInArrow(_combine_stretches, whole)


def _edits(ids: pa.DataType, turns: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        audit, at, state, place, name = "", 0, NOTHING, 0, None
        out: list[tuple] = []

        def put(turn: object, role: str | None, text: str, edit: str) -> None:
            nonlocal state, place
            if role is None:
                role = "assistant" if state == USER else "user"
            state = {"s": SYSTEM, "u": USER, "a": ASSISTANT}[role[0]]
            out.append((name, place, turn, role, text, edit))
            place += 1

        def insertions() -> None:
            nonlocal at
            while at < len(audit) and audit[at] == "I":
                put(None, None, "", "I")
                at += 1

        def made() -> pa.RecordBatch:
            types = [ids, pa.int64(), turns, pa.string(), pa.string(), pa.string()]
            columns = [pa.array(c, t) for c, t in zip(zip(*out), types)]
            out.clear()
            return pa.RecordBatch.from_arrays(columns, names=["conv_id", "place", "turn", "role", "text", "edit"])

        for batch in batches:
            columns = ("conv_id", "kind_", "audit", "turn", "role", "text")
            for conv, kind, plan, turn, role, text in zip(*(batch.column(c).to_pylist() for c in columns)):
                if kind == 0:
                    insertions()
                    audit, at, state, place, name = plan, 0, NOTHING, 0, conv
                    continue
                insertions()
                edit = audit[at]
                at += 1
                if edit != "D":
                    put(turn, role if edit == "K" else None, text, edit)
            if out:
                yield made()
        insertions()
        if out:
            yield made()

    return run


def apply_audits(rows: DataFrame, found: DataFrame) -> DataFrame:
    """``conv_id, place, turn, role, text, edit``: the repaired conversations.  A partition
    holds whole conversations, whose rows follow each other by ``place``.  Texts pass
    through their task one at a time; only the audit of the conversation is held."""
    conv = F.col("conv_id").asc_nulls_first()
    plans = found.select("conv_id", F.lit(0).alias("kind_"), "audit")
    texts = rows.withColumn("kind_", F.lit(1))
    both = plans.unionByName(texts, allowMissingColumns=True)
    both = both.repartition("conv_id").sortWithinPartitions(conv, "kind_", *_order())
    ids, turn = rows.schema["conv_id"].dataType, rows.schema["turn"].dataType
    schema = T.StructType([
        T.StructField("conv_id", ids), T.StructField("place", T.LongType()), T.StructField("turn", turn),
        T.StructField("role", T.StringType()), T.StructField("text", T.StringType()), T.StructField("edit", T.StringType()),
    ])
    return both.select("conv_id", "kind_", "audit", "turn", "role", "text").mapInArrow(
        _edits(to_arrow_type(ids), to_arrow_type(turn)), schema
    )


def _hash_conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    name, digest = None, None
    ids: pa.DataType | None = None

    def made(done: list) -> pa.RecordBatch:
        names, sums = zip(*done)
        return pa.RecordBatch.from_arrays([pa.array(names, ids), pa.array(sums, pa.string())], names=["conv_id", "repaired_sha256"])

    for batch in batches:
        ids = batch.schema.field("conv_id").type
        done = []
        for conv, place, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "place", "role", "text"))):
            if not place:
                if digest is not None:
                    done.append((name, digest.hexdigest()))
                name, digest = conv, hashlib.sha256()
            else:
                digest.update(b"\n")
            digest.update(f"{role}:{text}".encode("utf-8", "surrogatepass"))
        if done:
            yield made(done)
    if digest is not None:
        yield made([(name, digest.hexdigest())])


def digests(repaired: DataFrame) -> DataFrame:
    """``conv_id, repaired_sha256`` of ``apply_audits``' rows, which it takes as they come."""
    schema = T.StructType([repaired.schema["conv_id"], T.StructField("repaired_sha256", T.StringType())])
    return repaired.mapInArrow(_hash_conversations, schema)


def fault_counts(faults: DataFrame) -> DataFrame:
    """``conv_id, gaps, blank, duplicate, truncated`` of every conversation with rows."""
    kinds = ("blank", "duplicate", "truncated")
    turns = faults.groupBy("conv_id", "turn").agg(*[F.count_if(F.col("fault") == k).alias(k) for k in kinds])
    gaps = F.max("turn") - F.min("turn") + 1 - F.count("turn")
    return turns.groupBy("conv_id").agg(
        F.coalesce(gaps, F.lit(0)).cast("long").alias("gaps"), *[F.sum(k).alias(k) for k in kinds]
    )


def repair(conversations: DataFrame, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Repairs ``rows`` of ``conversations`` (``conv_id, turn, role, text``).

    Returns a table of every conv_id of ``conversations`` with what was found and done
    (``gaps, blank, duplicate, truncated, illegal, cost, audit``; zeros and an empty audit
    where no row is left), and the repaired rows, see ``apply_audits``.
    """
    scratch = Scratch(conversations.sparkSession, "conversation-repair")
    written = numbered(rows, scratch)
    faults = scratch.write(find_faults(written), "faults")
    found = scratch.write(parse(faults), "audits")
    every = conversations.select("conv_id").distinct()
    numbers = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    known = every.unionByName(fault_counts(faults), allowMissingColumns=True).unionByName(found, allowMissingColumns=True)
    report = known.groupBy("conv_id").agg(
        *[F.coalesce(F.max(c), F.lit(0)).cast("long").alias(c) for c in numbers],
        F.coalesce(F.max("audit"), F.lit("")).alias("audit"),
    )
    return report, apply_audits(written, found)


def _plus(best: str, cost: int, letters: str) -> str:
    return f"lpad((left({best}, 9)::INT + {cost})::VARCHAR, 9, '0') || substr({best}, 10) || '{letters}'"


def oracle() -> str:
    """DuckDB SQL for the registered query: a walk over each conversation's rows that keeps
    the least (cost, audit) of every state."""
    a, r = [f"a.s{i}" for i in range(4)], "x"
    ok = f"({r}.f IS NULL OR {r}.f = 'truncated')"
    more = f"(CASE WHEN {r}.f = 'truncated' THEN 5 ELSE 0 END)"

    def step(q: int) -> str:
        options = [_plus(a[q], 2, "D")]
        for i, moves in MOVES.items():
            for p, to in moves:
                if to == q:
                    options.append(f"CASE WHEN {ok} AND {r}.i = '{i}' THEN {_plus(a[p], more, 'K')} END")
                    if i != "s":
                        options.append(f"CASE WHEN {ok} THEN {_plus(a[p], f'1 + {more}', 'R')} END")
        return f"least({', '.join(options)})"

    closed = {
        0: a[0],
        1: a[1],
        2: f"least({a[2]}, {', '.join(_plus(a[p], 5, 'I') for p in (0, 1, 3))})",
        3: f"least({a[3]}, {_plus(a[2], 5, 'I')}, {_plus(a[0], 10, 'II')}, {_plus(a[1], 10, 'II')})",
    }
    states = ", ".join(f"s{q} := CASE WHEN x.i IS NULL THEN {closed[q]} ELSE {step(q)} END" for q in range(4))
    start = "struct_pack(s0 := '000000000', s1 := NULL::VARCHAR, s2 := '000000005I', s3 := '000000010II')"
    return rf"""
WITH raw AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    xor(list_reduce(flatten(list_transform(
      string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''),
      lambda c: [ord(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1])),
      lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a >> 1, 3988292384 * (a & 1)) END,
      4294967295::BIGINT), 4294967295) % 20 AS kind
  FROM conversations
), damaged AS (
  SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(CASE kind WHEN 3 THEN [0, 1] ELSE [0] END) AS copy
  FROM raw WHERE kind <> 0
), ordered AS (
  SELECT *, left(role, 1) AS i, row_number() OVER (
    PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(len(role)::VARCHAR || ':' || role || ':' || text), copy) AS n
  FROM damaged
), faults AS (
  SELECT *, CASE
      WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank'
      WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY n) > 1 THEN 'duplicate'
      WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 'truncated' END AS f,
    lag(i) OVER (PARTITION BY conv_id ORDER BY n) AS before
  FROM ordered
), counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
    count(*) FILTER (f = 'blank') AS blank, count(*) FILTER (f = 'duplicate') AS duplicate,
    count(*) FILTER (f = 'truncated') AS truncated,
    count(*) FILTER (before || i NOT IN ('su', 'ua', 'au')) AS illegal,
    list_reduce(flatten(list([struct_pack(i := i, f := f), struct_pack(i := NULL, f := NULL)] ORDER BY n)),
      lambda a, x: struct_pack({states}), {start}) AS s
  FROM faults GROUP BY conv_id
), best AS (SELECT *, least(s.s0, s.s3) AS plan FROM counts),
letters AS (
  SELECT conv_id, substr(plan, 10) AS audit, unnest(range(1, len(plan) - 8)) AS j FROM best
), placed AS (
  SELECT conv_id, j, audit[j] AS edit, len(replace(audit[:j], 'I', '')) AS n, len(replace(audit[:j], 'D', '')) AS m FROM letters
), rows_ AS (
  SELECT p.conv_id, p.j, p.edit, p.m, f.role, f.text, f.i FROM placed p
  LEFT JOIN faults f ON p.edit <> 'I' AND p.conv_id IS NOT DISTINCT FROM f.conv_id AND p.n = f.n
  WHERE p.edit <> 'D'
), shifted AS (
  SELECT *, max(CASE WHEN m = 1 AND edit = 'K' AND i = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id) AS s FROM rows_
), repaired AS (
  SELECT conv_id, sha256(string_agg(
    CASE WHEN edit = 'K' THEN role WHEN (m - s) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN edit = 'I' THEN '' ELSE text END,
    chr(10) ORDER BY j)) AS repaired_sha256
  FROM shifted GROUP BY conv_id
)
SELECT c.conv_id, coalesce(b.gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank,
  coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal,
  coalesce(left(plan, 9)::BIGINT, 0) AS cost, coalesce(substr(plan, 10), '') AS audit,
  coalesce(repaired_sha256, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c
LEFT JOIN best b ON c.conv_id IS NOT DISTINCT FROM b.conv_id
LEFT JOIN repaired r ON c.conv_id IS NOT DISTINCT FROM r.conv_id
"""
