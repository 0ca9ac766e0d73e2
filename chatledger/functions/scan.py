"""Secret scanning and redaction as column expressions.

The rules are unrolled into the plan as literals, so Spark compiles each pattern
once per task and a single pass over the table serves every rule.  One regex looks for
the hint literals of all rules; a rule's own regex only runs on texts that contain one
of its hints, and groups and positions are only looked up where it matched: on
ordinary prose the whole catalogue costs one search.

Functions named ``*_sql`` take and give SQL text (see ``functions.text``).
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace

from pyspark.sql import Column
from pyspark.sql import functions as F

from chatledger.functions.text import (
    column_sql,
    entropy_sql,
    json_quote_sql,
    let_sql,
    sql_string,
    utf16_length_sql,
)
from chatledger.rules import RULES, Rule, java_pattern
from chatledger.schemas import FINDING

FINDINGS = f"array<{FINDING.simpleString()}>"
NO_FINDINGS = f"CAST(array() AS {FINDINGS})"


#: Matches whose lengths are added up one by one; longer runs are added by their sums.
CHUNK = 64


def _least(hints: set[str]) -> list[str]:
    """Hints that hold no other one."""
    return sorted(h for h in hints if not any(o != h and o in h for o in hints))


def _literals(rules: Sequence[Rule]) -> tuple[list[str], list[str]]:
    """Literals of which every match of a rule with hints holds one: those to be found as they
    are, and those in any case."""
    exact = {h for r in rules for h in r.hints if not r.ignore_case or h.lower() == h.upper()}
    return _least(exact), _least({h.lower() for r in rules for h in r.hints if r.ignore_case} - exact)


#: Characters of ordinary text, the most frequent first; any other one is rarer.
_FREQUENT = " etaoinsrhldcumfpgwyb.,v-kATISxjqz"


def _rarest(literal: str) -> int:
    """The place of the character of a literal that ordinary text holds least of."""
    return max(range(len(literal)), key=lambda i: (_FREQUENT.find(literal[i]) % 99, -i))


def _spelled(literal: str, folded: bool) -> list[str]:
    """A literal as a class or character of a regex for each of its characters."""
    return [f"[{c}{c.upper()}]" if folded and c.upper() != c else _escaped(c) for c in literal]


def _any_of(rules: Sequence[Rule]) -> str:
    """One regex for all literals: a text is read once for the whole catalogue.  At nearly all
    places a look at one character is enough: each literal is looked for by its rarest one, and
    what goes before that is looked back at."""
    exact, folded = _literals(rules)
    rest: dict[str, list[str]] = {}
    for literals, fold in ((exact, False), (folded, True)):
        for literal in literals:
            at, spelled = _rarest(literal), _spelled(literal, fold)
            before, after = "".join(spelled[: at + 1]), "".join(spelled[at + 1 :])
            rest.setdefault(spelled[at], []).append(f"(?<={before}){after}" if at else after)
    anchors = "".join(a.strip("[]") for a in rest)
    # The anchor is read twice: by the class, then by its own branch.
    return f"(?=[{anchors}])(?:{'|'.join(f'{a}(?:{chr(124).join(ends)})' for a, ends in rest.items())})"


def _escaped(c: str) -> str:
    return c if c.isalnum() else "\\" + c


def _hinted_by_any_sql(text: str, rules: Sequence[Rule]) -> str:
    """Whether any rule's hint occurs."""
    if not all(r.hints for r in rules):
        return f"({text} IS NOT NULL)"
    return f"coalesce({text} RLIKE {sql_string(_any_of(rules))}, false)"


def _hinted_sql(text: str, rule: Rule) -> str:
    """Whether one of the rule's hints occurs."""
    if not rule.hints:
        return "true"
    exact, folded = _literals([rule])
    found = [f"contains({text}, {sql_string(h)})" for h in exact]
    if folded:
        found.append(f"{text} RLIKE {sql_string(_any_of([replace(rule, hints=tuple(folded))]))}")
    return " OR ".join(found)


def _positions_sql(between: str, whole: str) -> str:
    """Where each match starts, in UTF-16 units: everything between and inside the earlier
    ones, added up by chunks so that a text with many matches costs no more for each."""

    def total(numbers: str) -> str:
        return f"aggregate({numbers}, 0, (sum_, n_) -> sum_ + n_)"

    numbers = f"sequence(0, (size({whole}) - 1) div {CHUNK})"
    lengths = f"transform({whole}, (w_, k_) -> named_struct('gap', {utf16_length_sql(f'get({between}, k_)')}, 'own', {utf16_length_sql('w_')}))"
    steps = "transform(lengths_, l_ -> l_.gap + l_.own)"
    chunks = f"transform({numbers}, c_ -> {total(f'slice(steps_, CAST(c_ AS INT) * {CHUNK} + 1, {CHUNK})')})"
    starts = f"transform({numbers}, c_ -> {total('slice(chunks_, 1, CAST(c_ AS INT))')})"
    rest = total(f"slice(steps_, CAST(k_ div {CHUNK} AS INT) * {CHUNK} + 1, k_ % {CHUNK})")
    places = f"transform(lengths_, (l_, k_) -> get(starts_, CAST(k_ div {CHUNK} AS INT)) + {rest} + l_.gap)"
    return let_sql(lengths, "lengths_", let_sql(steps, "steps_", let_sql(chunks, "chunks_", let_sql(starts, "starts_", places))))


def _rule_sql(text: str, rule: Rule, number: int, notice: str | None, positions: bool) -> str:
    """Findings of one rule in text order, low-entropy values left out."""
    pattern = sql_string(java_pattern(rule))
    label = sql_string(notice or f"[REDACTED:{rule.id.upper()}]")
    group = f"regexp_extract_all({text}, {pattern}, {rule.group})" if rule.group else "whole_"
    place, where = "CAST(NULL AS INT)", "array(0)"
    if positions:
        place, where = "get(parts_.place_, i_)", let_sql(f"split({text}, {pattern}, -1)", "between_", _positions_sql("between_", "whole_"))
    secret = "CASE WHEN get(parts_.group_, i_) = '' THEN m_ ELSE get(parts_.group_, i_) END"
    found = f"transform(whole_, (m_, i_) -> named_struct('secret', {secret}, 'pos', {place}))"
    found = (
        f"transform({found}, h_ -> named_struct('secret', h_.secret, 'pos', h_.pos, "
        f"'bits', {entropy_sql('h_.secret')}))"
    )
    if rule.min_entropy is not None:
        found = f"filter({found}, h_ -> h_.bits >= {rule.min_entropy}D)"
    rows = (
        f"transform({found}, (h_, i_) -> named_struct('rule_no', {number}, "
        f"'rule_id', {sql_string(rule.id)}, 'rule_name', {sql_string(rule.name)}, "
        f"'match_no', i_ + 1, 'matched', h_.secret, 'redacted', {label}, "
        f"'entropy', h_.bits, 'pos', h_.pos))"
    )
    parts = let_sql(f"named_struct('group_', {group}, 'place_', {where})", "parts_", rows)
    return let_sql(
        f"regexp_extract_all({text}, {pattern}, 0)",
        "whole_",
        f"CASE WHEN size(whole_) = 0 THEN {NO_FINDINGS} ELSE CAST({parts} AS {FINDINGS}) END",
    )


def findings_sql(
    text: str, rules: Sequence[Rule] = RULES, notice: str | None = None, positions: bool = True
) -> str:
    """``array<finding>``: by rule in catalogue order, then by position."""
    per_rule = [
        f"CASE WHEN {_hinted_sql(text, rule)} THEN {_rule_sql(text, rule, i, notice, positions)} "
        f"ELSE {NO_FINDINGS} END"
        for i, rule in enumerate(rules, 1)
    ]
    return f"concat({', '.join(per_rule)})"


def scan_sql(text: str, rules: Sequence[Rule] = RULES, notice: str | None = None) -> str:
    """``struct<findings, sanitized>`` of one text; null text becomes empty."""
    # Every occurrence of every matched value goes, in finding order.
    blanked = f"aggregate(f_, {text}, (acc_, x_) -> replace(acc_, x_.matched, x_.redacted))"
    scanned = let_sql(
        findings_sql(text, rules, notice, positions=False),
        "f_",
        f"named_struct('findings', f_, 'sanitized', {blanked})",
    )
    return (
        f"CASE WHEN {_hinted_by_any_sql(text, rules)} THEN {scanned} "
        f"ELSE named_struct('findings', {NO_FINDINGS}, 'sanitized', coalesce({text}, '')) END"
    )


def scan_messages_sql(
    messages: str, rules: Sequence[Rule] = RULES, notice: str | None = None
) -> str:
    """``array<struct<message, findings>>`` with every message's text redacted.

    Plain content is scanned as it is; of multipart content every part's
    ``text`` is scanned and put back into the part's JSON.
    """

    # Only a string ``text`` of an object is scanned.  The part is then written anew
    # from its own keys, so that no other text of it can be taken for this one; a
    # part whose values cannot be told apart keeps its text alone.
    is_object = "coalesce(schema_of_variant(get(kinds_, i_)) LIKE 'OBJECT%', startswith(part_, '{'))"
    is_string = "coalesce(schema_of_variant(from_json(part_, 'text VARIANT').text) = 'STRING', false)"
    value = (
        f"CASE WHEN key_ = 'text' THEN {json_quote_sql('ps_.sanitized')} "
        f"WHEN schema_of_variant(types_[key_]) = 'STRING' THEN {json_quote_sql('values_[key_]')} "
        "ELSE coalesce(values_[key_], 'null') END"
    )
    members = f"transform(array_distinct(json_object_keys(part_)), key_ -> concat({json_quote_sql('key_')}, ':', {value}))"
    rebuilt = let_sql(
        "from_json(part_, 'map<string, variant>')",
        "types_",
        let_sql("from_json(part_, 'map<string, string>')", "values_", f"concat('{{', array_join({members}, ','), '}}')"),
    )
    rebuilt = (
        "CASE WHEN from_json(part_, 'map<string, variant>') IS NULL THEN "
        f"concat('{{\"type\":\"text\",\"text\":', {json_quote_sql('ps_.sanitized')}, '}}') ELSE {rebuilt} END"
    )
    # The texts of a message are scanned by one and the same expression: its content, or what
    # its parts hold, null for a part without.
    is_array = "msg_.is_parts AND from_json(msg_.content, 'array<string>') IS NOT NULL"
    texts = let_sql(
        "from_json(msg_.content, 'array<variant>')",
        "kinds_",
        "transform(from_json(msg_.content, 'array<string>'), (part_, i_) -> "
        f"CASE WHEN {is_object} AND {is_string} THEN from_json(part_, 'text STRING').text END)",
    )
    texts = f"CASE WHEN {is_array} THEN {texts} ELSE array(msg_.content) END"
    scans = f"transform({texts}, t_ -> CASE WHEN t_ IS NOT NULL THEN {scan_sql('t_', rules, notice)} END)"
    other = (
        "CASE WHEN coalesce(schema_of_variant(get(kinds_, i_)) = 'STRING', "
        "part_ IS NOT NULL AND NOT part_ RLIKE '^([\\\\[{]|-?[0-9.eE+-]+$|true$|false$|null$)') "
        f"THEN {json_quote_sql('part_')} "
        "ELSE coalesce(part_, 'null') END"
    )
    part = let_sql(
        "get(scans_, i_)",
        "ps_",
        f"CASE WHEN ps_ IS NULL THEN {other} WHEN size(ps_.findings) > 0 THEN {rebuilt} ELSE part_ END",
    )
    parts = let_sql(
        "from_json(msg_.content, 'array<variant>')",
        "kinds_",
        f"transform(from_json(msg_.content, 'array<string>'), (part_, i_) -> {part})",
    )
    together = (
        f"CASE WHEN NOT ({is_array}) THEN get(scans_, 0).sanitized "
        f"WHEN exists(scans_, s_ -> size(s_.findings) > 0) THEN concat('[', array_join({parts}, ','), ']') "
        "ELSE msg_.content END"
    )
    found = "flatten(transform(filter(scans_, s_ -> s_ IS NOT NULL), s_ -> s_.findings))"
    scanned = let_sql(scans, "scans_", f"named_struct('findings', {found}, 'sanitized', {together})")
    scanned = (
        f"CASE WHEN NOT {_hinted_by_any_sql('msg_.content', rules)} "
        f"THEN named_struct('findings', {NO_FINDINGS}, 'sanitized', msg_.content) ELSE {scanned} END"
    )
    one = let_sql(
        scanned,
        "scan_",
        "named_struct('message', named_struct('role', msg_.role, 'content', scan_.sanitized, "
        "'name', msg_.name, 'tool_call_id', msg_.tool_call_id, 'is_parts', msg_.is_parts), "
        "'findings', scan_.findings)",
    )
    return f"transform({messages}, msg_ -> {one})"


def may_have_secrets(column: str, rules: Sequence[Rule] = RULES) -> Column:
    """Cheap necessary condition for any finding: some rule's hint occurs."""
    return F.expr(_hinted_by_any_sql(column_sql(column), rules))


def find_secrets(column: str, rules: Sequence[Rule] = RULES, notice: str | None = None) -> Column:
    return F.expr(findings_sql(column_sql(column), rules, notice))


def scan(column: str, rules: Sequence[Rule] = RULES, notice: str | None = None) -> Column:
    return F.expr(scan_sql(column_sql(column), rules, notice))


def scan_messages(column: str, rules: Sequence[Rule] = RULES, notice: str | None = None) -> Column:
    return F.expr(scan_messages_sql(column_sql(column), rules, notice))


def masked(value: Column) -> Column:
    """Preview of a secret that is safe to show."""
    return F.concat(F.substring(value, 1, 4), F.lit("****"))
