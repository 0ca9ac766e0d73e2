"""Conversation repair against textbook parsing, and its edge cases."""

import hashlib
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from chatledger.llm import conversation_repair as C
from chatledger.llm import queries

SCHEMA = "conv_id long, turn long, role string, text string"
EMPTY_SHA = hashlib.sha256(b"").hexdigest()


def faults(rows):
    """First fault of each ``(role, text)``."""
    seen, out = set(), []
    for role, text in rows:
        kept = text.rstrip(" \t\n\x0b\f\r")
        fault = None
        if not kept:
            fault = "blank"
        elif (role, text) in seen:
            fault = "duplicate"
        elif kept[-1] not in ".!?":
            fault = "truncated"
        seen.add((role, text))
        out.append(fault)
    return out


def every_repair(rows, inserts):
    """Cheapest (cost, audit) by trying every string of edits."""
    found, best = faults(rows), None
    for edits in itertools.product(*[["K", "u", "a", "D"]] * len(rows)):
        cost, letters = 0, []
        for (role, _), fault, edit in zip(rows, found, edits):
            if edit == "D":
                cost += 2
                letters.append(("", "D"))
                continue
            if fault in ("blank", "duplicate"):
                break
            cost += (edit != "K") + 5 * (fault == "truncated")
            letters.append((role[:1] if edit == "K" else edit, "K" if edit == "K" else "R"))
        else:
            for gaps in itertools.product(["", "u", "a", "ua", "au"][: 1 + inserts], repeat=len(rows) + 1):
                initials = audit = gaps[0]
                audit = "I" * len(gaps[0])
                for (initial, letter), gap in zip(letters, gaps[1:]):
                    initials += initial + gap
                    audit += letter + "I" * len(gap)
                if re.fullmatch("(s?(ua)+)?", initials):
                    entry = cost + 5 * audit.count("I"), audit
                    best = min(best or entry, entry)
    return best


def textbook(rows):
    """CYK over all spans and all cuts of the span, with the same cells."""
    found = faults(rows)
    n = len(rows)
    cells = {}
    for i, ((role, _), fault) in enumerate(zip(rows, found)):
        cells[i, i + 1] = C.row_cell(role[:1], fault)
    for length in range(2, n + 1):
        for i in range(n - length + 1):
            options = [C.combine(cells[i, k], cells[k, i + length]) for k in range(i + 1, i + length)]
            cells[i, i + length] = tuple(
                min((o[x] for o in options if o[x] is not None), default=None) for x in range(len(C.NONTERMINALS))
            )
    return C.cheapest(cells[0, n] if n else C.EMPTY)


def damaged(rows):
    """The damage, in Python: ``{conv_id: [(turn, role, text)]}`` in order."""
    out = {}
    for conv, turn, role, text in rows:
        name = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        kind = zlib.crc32(name.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out.setdefault(conv, []).extend([(turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1))

    def order(row):
        turn, role, text = row
        digest = hashlib.sha256(f"{len(role)}:{role}:{text}".encode()).hexdigest()
        return turn is not None, turn or 0, role.encode(), digest

    return {c: sorted(r, key=order) for c, r in out.items()}


def expected(rows):
    out = {}
    for conv, kept in damaged(rows).items():
        pairs = [(role, text) for _, role, text in kept]
        cost, audit = textbook(pairs)
        found, turns = faults(pairs), [t for t, _, _ in kept if t is not None]
        parts, i, last = [], 0, ""
        for letter in audit:
            role, text = (None, "") if letter == "I" else pairs[i]
            i += letter != "I"
            if letter == "D":
                continue
            if letter != "K":
                role = "assistant" if last == "u" else "user"
            parts.append(f"{role}:{text}")
            last = role[0]
        initials = [r[:1] for r, _ in pairs]
        out[conv] = {
            "gaps": max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
            "blank": found.count("blank"),
            "duplicate": found.count("duplicate"),
            "truncated": found.count("truncated"),
            "illegal": sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])),
            "cost": cost,
            "audit": audit,
            "repaired_sha256": hashlib.sha256("\n".join(parts).encode()).hexdigest(),
        }
    return out


def run(spark, rows, tmp_path, extra=False, schema=SCHEMA):
    made = spark.createDataFrame(rows, schema)
    if extra:
        made = made.withColumn("audit", F.lit("x")).withColumn("at_", F.lit(1)).withColumn("fault", F.lit(None))
    made.write.parquet(f"{tmp_path}/conversations.parquet")
    found = queries.op11_conversation_repair(spark, str(tmp_path)).collect()
    assert len({r["conv_id"] for r in found}) == len(found)
    return {r["conv_id"]: {k: v for k, v in r.asDict().items() if k != "conv_id"} for r in found}


def test_cells_find_the_cheapest_of_all_repairs():
    rng = random.Random(3)
    texts = ["a.", "b", "", "c!"]
    for _ in range(60):
        rows = [(rng.choice(["user", "assistant", "system", "tool"]), rng.choice(texts)) for _ in range(rng.randrange(4))]
        parser = C.Parser()
        for (role, _), fault in zip(rows, faults(rows)):
            parser.add(C.row_cell(role[:1], fault))
        assert C.cheapest(parser.cell()) == textbook(rows) == every_repair(rows, 4), rows


def test_long_spans_equal_textbook_parsing():
    rng = random.Random(4)
    for n in (17, 40, 64):
        rows = [(rng.choice(["user", "assistant", "system"]), f"{rng.randrange(n)}" + rng.choice(["", ".", "?"])) for _ in range(n)]
        parser = C.Parser()
        for (role, _), fault in zip(rows, faults(rows)):
            parser.add(C.row_cell(role[:1], fault))
        assert C.cheapest(parser.cell()) == textbook(rows)


@pytest.mark.parametrize("seed", [1, 2])
def test_query_equals_textbook_parsing(spark, tmp_path, seed):
    rng = random.Random(seed)
    rows = []
    for conv in range(40):
        for turn in range(rng.choice([1, 2, 3, 8, 30])):
            role = rng.choice(["user", "assistant"]) if rng.random() < 0.3 else ("user", "assistant")[turn % 2]
            rows.append((conv, turn, "system" if turn == 0 and conv % 3 == 0 else role, f"t{rng.randrange(9)}" + rng.choice(["", ".", "! \n"])))
    assert run(spark, rows, tmp_path) == expected(rows)


def test_one_long_conversation_is_parsed_by_many_tasks(spark, tmp_path):
    rng = random.Random(5)
    rows = [(7, t, rng.choice(["user", "assistant"]), f"w{rng.randrange(70)}.") for t in range(90)]
    scratch = C.Scratch(spark, "test")
    written = C.numbered(spark.createDataFrame(rows, SCHEMA), scratch)
    whole = C.parse(C.find_faults(written)).collect()
    conv = F.col("conv_id")
    spread = C.find_faults(written).repartitionByRange(8, conv, "turn").select(F.spark_partition_id().alias("p"))
    assert spread.distinct().count() > 4
    assert [(r["cost"], r["audit"]) for r in whole] == [textbook([(r, t) for _, _, r, t in rows])]


def test_nulls_ties_repeats_and_odd_roles(spark, tmp_path):
    rows = [
        (1, None, "user", "a."), (1, None, None, None), (1, 5, "assistant", None), (1, 5, "assistant", "x\x00y."),
        (2, 1, "", "a."), (2, 2, "Sam", "b."), (2, 3, "ulf", "c."), (2, 4, "ada", "d…"),
        (None, 1, "user", "hi."), (None, 2, "assistant", "ho."), (None, None, "tool", "t "),
        (3, 1, "user", "same."), (3, 1, "user", "same."), (3, 1, "assistant", "z" * 200_000 + "."), (3, 9, "system", "s."),
        (4, -3, "user", " \t\n"), (4, 10, "user", "é?"),
    ]
    assert run(spark, rows, tmp_path, extra=True) == expected(rows)


def test_conversations_without_rows_and_an_empty_table(spark, tmp_path):
    gone = next((c, 0) for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    found = run(spark, [(*gone, "user", "a.")], tmp_path / "one")
    zeros = dict.fromkeys(("gaps", "blank", "duplicate", "truncated", "illegal", "cost"), 0)
    assert found == {gone[0]: {**zeros, "audit": "", "repaired_sha256": EMPTY_SHA}}
    assert run(spark, [], tmp_path / "none") == {}


def test_repaired_rows(spark):
    rows = [(1, 1, "assistant", "a."), (1, 2, "user", "b."), (1, 3, "user", "c"), (1, 4, "assistant", "d.")]
    made = spark.createDataFrame(rows, SCHEMA)
    report, repaired = C.repair(made, made)
    assert [(r["cost"], r["audit"]) for r in report.collect()] == [(4, "DKDK")]
    found = [tuple(r) for r in repaired.collect()]
    assert found == [(1, 0, 2, "user", "b.", "K"), (1, 1, 4, "assistant", "d.", "K")]
