"""Secrets in texts, with credentials of several parts linked by where they stand.

Strong kinds are always reported: ``assign`` (a secret's name with a value), ``access``
(an access key identifier) and ``hex`` (a long run of hexadecimal digits).  Weak kinds
are ordinary text taken alone: ``key`` (a random-looking token), ``client`` (an account
name) and ``endpoint`` (an address).  They are reported only as parts of a credential:

- a ``key`` within ``REACH`` code points of an identifier (``access`` or ``client``),
- a ``client`` within reach of a secret (``assign``, ``hex`` or ``key``),
- an ``endpoint`` within reach of both an identifier and a secret.

Parts that overlap a strong span are not weak candidates.  The link is an interval
join: parts are dealt into bins of ``REACH`` code points of their text, and parts that
share a bin are compared, so that one text with very many parts is many groups.

Built-in functions only.  A match starts after all that lies between and inside earlier
ones; these sums are taken in runs of ``RUN`` matches.  Null texts count as empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatledger.functions.text import let_sql, sql_string
from chatledger.llm.common import Scratch

REACH = 400
RUN = 256
PLACEHOLDER = "[SECRET]"

STRONG = ("assign", "access", "hex")
WEAK = ("key", "client", "endpoint")
KINDS = STRONG + WEAK
IDENTIFIERS = ("access", "client")
SECRETS = ("assign", "hex", "key")

#: Patterns, a literal that must occur for a match (or none) and the least length of a group.
PATTERNS = {
    "assign": (
        r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        None,
        8,
    ),
    # Runs of the least length or more: shorter runs hold no match, so dropping them
    # first or afterwards comes to the same.
    "access": (r"AKIA[A-Z0-9]{12,}", "AKIA", 0),
    "hex": (r"[0-9a-f]{32,}", None, 0),
    "key": (
        r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_-]*[0-9])(?=[^A-Z]*[A-Z])(?=[^a-z]*[a-z])[A-Za-z0-9+/_-]{20,}={0,2}(?![A-Za-z0-9+/_=-])",
        None,
        0,
    ),
    "client": (
        r"""(?i:user(?:_?name|_?id)?|login|account|client_?id)["']?\x20*[:=]\x20*["']?([A-Za-z0-9@._+-]{3,})""",
        None,
        0,
    ),
    "endpoint": (r"""[a-z][a-z0-9+.-]*://[^\x00-\x20"'<>]+""", "://", 0),
}
SPAN = "struct<start: int, kind: int, end: int>"
NONE = f"CAST(array() AS array<{SPAN}>)"


def spans_sql(text: str, kind: str) -> str:
    """``array<span>`` of one kind, in text order, positions in code points."""
    regex, literal, least = PATTERNS[kind]
    pattern = sql_string(regex)
    group = f"regexp_extract_all({text}, {pattern}, 1)" if least else "whole_"
    # Length of what lies before each match since the last one, and of the match.
    sizes = (
        "transform(whole_, (m_, i_) -> named_struct("
        "'gap', char_length(get(parts_.between, i_)), 'own', char_length(m_), 'value', char_length(get(parts_.value, i_))))"
    )
    total = "aggregate(slice(sizes_, {0}, {1}), 0, (n_, s_) -> n_ + s_.gap + s_.own)"
    runs = (
        f"transform(sequence(0, (size(sizes_) - 1) DIV {RUN}), r_ -> "
        + total.format("1", f"r_ * {RUN}")
        + ")"
    )
    before = "get(runs_, i_ DIV {0}) + ".format(RUN) + total.format(f"(i_ DIV {RUN}) * {RUN} + 1", f"i_ % {RUN}")
    made = (
        f"transform(sizes_, (x_, i_) -> named_struct('at', {before} + x_.gap, 'own', x_.own, 'value', x_.value))"
    )
    if least:
        made = f"filter({made}, x_ -> x_.value >= {least})"
    made = (
        f"transform({made}, x_ -> named_struct('start', x_.at, 'kind', {KINDS.index(kind)}, 'end', x_.at + x_.own))"
    )
    made = let_sql(sizes, "sizes_", let_sql(runs, "runs_", made))
    parts = f"named_struct('between', split({text}, {pattern}, -1), 'value', {group})"
    found = let_sql(
        f"regexp_extract_all({text}, {pattern}, 0)",
        "whole_",
        f"CASE WHEN size(whole_) = 0 THEN {NONE} ELSE {let_sql(parts, 'parts_', made)} END",
    )
    if literal:
        found = f"CASE WHEN contains({text}, {sql_string(literal)}) THEN {found} ELSE {NONE} END"
    return f"CAST({found} AS array<{SPAN}>)"


def _parts(docs: DataFrame) -> DataFrame:
    """``row_, strong, weak`` and the columns of ``docs`` without the text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text_")
    rest = [F.col(c) for c in docs.columns if c != "text"]
    rows = docs.select(F.monotonically_increasing_id().alias("row_"), *rest, text)
    strong = f"concat({', '.join(spans_sql('text_', k) for k in STRONG)})"
    rows = rows.withColumn("strong_", F.expr(strong))
    client = spans_sql("text_", "client")
    rows = rows.withColumn("client_", F.expr(client))
    others = f"concat({spans_sql('text_', 'key')}, client_, {spans_sql('text_', 'endpoint')})"
    # A weak part needs another part near it that is strong or an account name.
    weak = f"CASE WHEN size(strong_) + size(client_) = 0 THEN {NONE} ELSE {others} END"
    clear = "filter({0}, w_ -> NOT exists(strong_, s_ -> s_.start < w_.end AND w_.start < s_.end))"
    return rows.withColumn("weak_", F.expr(let_sql(weak, "all_", clear.format("all_")))).drop("text_", "client_")


def _linked(parts: DataFrame) -> DataFrame:
    """``row_, linked_``: the weak parts of each text that complete a credential."""
    some = parts.where("size(weak_) > 0")
    every = some.select("row_", F.explode(F.concat("strong_", "weak_")).alias("p"))
    weak = some.select("row_", F.explode("weak_").alias("w"))
    first = F.floor((F.col("w.start") - REACH) / REACH)
    last = F.floor((F.col("w.end") + REACH) / REACH)
    weak = weak.select("row_", "w", F.explode(F.sequence(first, last)).alias("bin"))
    every = every.select(
        "row_", "p", F.explode(F.sequence(F.floor(F.col("p.start") / REACH), F.floor(F.col("p.end") / REACH))).alias("bin")
    )
    near = weak.join(every, ["row_", "bin"]).where(
        f"p.start - w.end <= {REACH} AND w.start - p.end <= {REACH} AND p <> w"
    )

    def beside(kinds: tuple[str, ...]) -> Column:
        return F.bool_or(F.col("p.kind").isin(*[KINDS.index(k) for k in kinds]))

    flags = near.groupBy("row_", "w").agg(beside(IDENTIFIERS).alias("name_"), beside(SECRETS).alias("secret_"))
    key, client, endpoint = (KINDS.index(k) for k in WEAK)
    whole = flags.where(
        f"(w.kind = {key} AND name_) OR (w.kind = {client} AND secret_) OR (w.kind = {endpoint} AND name_ AND secret_)"
    )
    return whole.groupBy("row_").agg(F.collect_list("w").alias("linked_"))


def _with_spans(parts: DataFrame) -> DataFrame:
    """``parts`` with all reported spans; only texts with weak parts take part in the join."""
    strong = F.array_sort("strong_")
    spans = F.array_sort(F.concat("strong_", F.coalesce("linked_", F.expr(NONE))))
    some = parts.where("size(weak_) > 0").join(_linked(parts), "row_", "left").withColumn("spans", spans)
    none = parts.where("size(weak_) = 0").withColumn("spans", strong)
    return none.unionByName(some.drop("linked_")).withColumn("strong", strong)


def _text_form(spans: str) -> str:
    names = f"array({', '.join(sql_string(k) for k in KINDS)})"
    return (
        f"array_join(transform({spans}, s_ -> concat_ws(':', get({names}, s_.kind), "
        "CAST(s_.start AS STRING), CAST(s_.end AS STRING))), ',')"
    )


def find_secrets(docs: DataFrame) -> DataFrame:
    """The columns of ``docs`` without ``text``, and ``strong`` and ``spans``: arrays of
    ``(start, kind, end)``, by start and then kind; ``kind`` counts in ``KINDS``.
    ``spans`` holds the linked weak parts too.  A row for a row."""
    docs = docs.drop("row_", "strong", "strong_", "weak_", "spans", "linked_")
    scratch = Scratch(docs.sparkSession, "secret-scan")
    parts = scratch.write(_parts(docs), "parts")
    return _with_spans(parts).select(*[c for c in docs.columns if c != "text"], "strong", "spans")


def digest(found: DataFrame) -> list[Column]:
    """``n_assign, n_access, n_hex, base_sha256, spans`` of what ``find_secrets`` gives."""
    counts = [
        F.expr(f"CAST(size(filter(strong, s_ -> s_.kind = {k})) AS BIGINT)").alias(f"n_{name}")
        for k, name in enumerate(STRONG)
    ]
    return [
        *counts,
        F.expr(f"sha2(CAST({_text_form('strong')} AS BINARY), 256)").alias("base_sha256"),
        F.expr(_text_form("spans")).alias("spans"),
    ]


def redact(docs: DataFrame, placeholder: str = PLACEHOLDER) -> DataFrame:
    """``docs`` with every reported span of ``text`` replaced; texts without one stay as
    they are, null too.  Overlapping spans count as one."""
    rows = docs.drop("row_", "strong", "strong_", "weak_", "spans", "linked_", "copy_")
    columns = rows.columns
    scratch = Scratch(docs.sparkSession, "secret-redact")
    found = _with_spans(scratch.write(_parts(rows.withColumn("copy_", F.col("text"))), "parts"))
    united = (
        "aggregate(spans, CAST(array() AS array<struct<a: int, b: int>>), (u_, s_) -> "
        "CASE WHEN size(u_) > 0 AND s_.start < element_at(u_, -1).b THEN "
        "concat(slice(u_, 1, size(u_) - 1), array(named_struct('a', element_at(u_, -1).a, "
        "'b', greatest(s_.end, element_at(u_, -1).b)))) "
        "ELSE concat(u_, array(named_struct('a', s_.start, 'b', s_.end))) END)"
    )
    between = (
        "transform(sequence(0, size(cuts_)), i_ -> substring(copy_, "
        "coalesce(get(cuts_, i_ - 1).b, 0) + 1, "
        "coalesce(get(cuts_, i_).a, char_length(copy_)) - coalesce(get(cuts_, i_ - 1).b, 0)))"
    )
    text = let_sql(united, "cuts_", f"array_join({between}, {sql_string(placeholder)})")
    text = f"CASE WHEN size(spans) = 0 THEN copy_ ELSE {text} END"
    return found.withColumn("text", F.expr(text)).select(*columns)
