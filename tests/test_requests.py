from __future__ import annotations

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from chatledger import sources
from chatledger.functions.cost import Prices
from chatledger.functions.text import is_json
from chatledger.operators import requests


def parsed(spark, *bodies):
    rows = [(i, b if isinstance(b, str) or b is None else json.dumps(b)) for i, b in enumerate(bodies)]
    return sources.parse_requests(spark.createDataFrame(rows, "id int, body string"))


def canonical(spark, *bodies):
    rows = requests.canonical_request(parsed(spark, *bodies)).collect()
    return [r.canonical for r in sorted(rows, key=lambda r: r.id)]


def message(content="hello world", **more):
    return {"role": "user", "content": content, **more}


def test_key_order_does_not_matter(spark):
    a = {"model": "gpt-4o", "messages": [message()], "temperature": 0.7}
    b = {"temperature": 0.7, "messages": [message()], "model": "gpt-4o"}
    c = {"model": "gpt-4o", "messages": [message("hello universe")]}
    rows = requests.request_fingerprint(parsed(spark, a, b, c)).collect()
    hashes = {r.id: r.hash for r in rows}
    assert hashes[0] == hashes[1] != hashes[2]
    text = (
        '{"model":"gpt-4o","messages":[{"role":"user","content":"hello world","name":null,'
        '"tool_call_id":null}],"temperature":0.7,"max_tokens":null,"top_p":null,"tools":null,"tool_choice":null}'
    )
    assert hashes[0] == hashlib.sha256(text.encode()).hexdigest()


@pytest.mark.parametrize(
    "temperature, text",
    [("absent", "0.7"), (None, "0"), (0, "0"), (1, "1"), (1.0, "1"), (0.704, "0.7"), (0.705, "0.71"), (0.125, "0.13"), (1.5, "1.5")]
    + [("hot", "null"), ("0.5", "0.5"), (True, "1"), ("", "0"), ([], "null"), ({"a": 1}, "null"), ("1d", "null")],
)
def test_temperature(spark, temperature, text):
    body = {"messages": []} if temperature == "absent" else {"messages": [], "temperature": temperature}
    assert json.loads(canonical(spark, body)[0])["temperature"] == json.loads(text)
    assert f'"temperature":{text},' in canonical(spark, body)[0]


def test_fields_of_the_canonical_form(spark):
    full = {
        "messages": [message("  hi \n", name="", tool_call_id="t1")],
        "max_tokens": 256,
        "top_p": 0.9,
        "tools": [{"b": 1, "a": "x"}],
        "tool_choice": "auto",
        "stream": True,
        "frequency_penalty": 2,
        "unknown": {"k": 1},
    }
    c = json.loads(canonical(spark, full)[0])
    assert c == {
        "model": "",
        "messages": [{"role": "user", "content": "hi", "name": None, "tool_call_id": "t1"}],
        "temperature": 0.7,
        "max_tokens": 256,
        "top_p": 0.9,
        "tools": '[{"b":1,"a":"x"}]',
        "tool_choice": '"auto"',
    }
    assert list(c) == ["model", "messages", "temperature", "max_tokens", "top_p", "tools", "tool_choice"]
    zeros = json.loads(canonical(spark, {"messages": [], "max_tokens": 0, "top_p": 0})[0])
    assert zeros["max_tokens"] is None and zeros["top_p"] is None
    choice = {"type": "function", "function": {"name": "f"}}
    assert json.loads(json.loads(canonical(spark, {"tool_choice": choice})[0])["tool_choice"]) == choice


def test_content_kinds(spark):
    parts = [{"type": "text", "text": "a"}]
    body = {
        "messages": [
            message(parts),
            message("[1]"),
            {"role": "assistant", "content": None, "tool_calls": [{"id": 1}]},
            {"role": "assistant"},
        ]
    }
    m = json.loads(canonical(spark, body)[0])["messages"]
    assert m[0]["content"] == '[{"type":"text","text":"a"}]'
    assert m[1]["content"] == "[1]"
    assert m[2]["content"] == "null"
    assert "content" not in m[3]
    row = parsed(spark, body).first()
    assert [x.is_parts for x in row.messages] == [True, False, False, False]


def test_invalid_json(spark):
    rows = parsed(spark, '{"model":"x"', "not json", None, "", '{"model":"ok"}', "[1]").collect()
    assert [r.invalid_json for r in sorted(rows, key=lambda r: r.id)] == [True, True, True, True, False, False]


def test_estimate_tokens(spark):
    bodies = [
        {"messages": [message("1234567890123456")]},
        {"messages": []},
        {"messages": [message("abc"), message("de")]},
        {"messages": [message([{"type": "text", "text": "12345678"}, {"type": "image_url"}])]},
        {"messages": [message("😀😀😀")]},
    ]
    rows = requests.estimate_tokens(parsed(spark, *bodies)).collect()
    assert [r.est_tokens for r in sorted(rows, key=lambda r: r.id)] == [4, 1, 2, 2, 2]
    turns = spark.createDataFrame([(1, "abc"), (1, "de"), (2, None)], "r int, t string")
    by_turn = {r.r: r.est_tokens for r in requests.estimate_tokens_by_turn(turns, "r", "t").collect()}
    assert by_turn == {1: 2, 2: 1}


def test_duplicates_cost_and_client(spark):
    log = spark.createDataFrame(
        [("a", 1, 10), ("a", 5, 10), ("a", 3, 10), ("b", 2, 7)], "hash string, ts long, est_tokens long"
    )
    row = requests.fingerprint_duplicates(log).collect()
    assert [tuple(r) for r in row] == [("a", 3, 1, 5, 20)]
    used = spark.createDataFrame([(1000, 2000)], "prompt_tokens long, completion_tokens long")
    assert requests.cost_estimate(used).first().cost_usd == pytest.approx(0.035)
    assert requests.cost_estimate(used, prices=Prices(1, 2)).first().cost_usd == pytest.approx(5)
    df = spark.createDataFrame([("f", "p"), ("", "p"), (None, None)], "f string, p string")
    got = df.select(requests.client_key(df.f, df.p).alias("k")).collect()
    assert [r.k for r in got] == ["f", "p", "127.0.0.1"]


def test_usage_resolve(spark):
    def response(usage):
        return json.dumps({"id": "x", "choices": [{"message": {"content": "12345"}}], **usage})

    some, zero = {"usage": {"prompt_tokens": 3, "completion_tokens": 4}}, {"usage": {"prompt_tokens": 0}}
    rows = [(0, response(some), True), (1, response(zero), True), (2, response({}), False)]
    df = spark.createDataFrame([(*r, 9) for r in rows], "id int, response string, is_stream boolean, est_tokens long")
    got = {r.id: (r.prompt_tokens, r.completion_tokens) for r in requests.usage_resolve(df).collect()}
    assert got == {0: (3, 4), 1: (9, 2), 2: (9, -(-len(response({})) // 4))}


def test_bodies_must_be_one_json_value(spark):
    bodies = {
        '{"model":"m"} x': None,
        "{'model':'m'}": None,
        '{"model":"m"}],[{}': None,
        '{"model":"m"},{"model":"n"}': None,
        '{"model":NaN}': None,
        "": None,
        ' {"model":"m"} ': "m",
        '{"model":"a","model":"b"}': "b",
    }
    rows = sources.parse_requests(spark.createDataFrame([(b,) for b in bodies], "body string").withColumn("raw", F.col("body")))
    got = {r.raw: (r.invalid_json, r.model) for r in rows.collect()}
    assert got == {b: (m is None, m) for b, m in bodies.items()}


def test_numbers_are_written_as_in_javascript(spark):
    from chatledger.functions.text import json_number

    texts = {1.0: "1", 0.7: "0.7", 1e20: "1" + "0" * 20, 1e21: "1e+21", 1e25: "1e+25", 1.5e-5: "0.000015", 1e-6: "0.000001",
             1e-7: "1e-7", 1.25e-9: "1.25e-9", -2.5: "-2.5", 123456.789: "123456.789", float("inf"): "null"}
    rows = spark.createDataFrame([(x,) for x in texts], "x double").select("x", json_number(F.col("x")).alias("t"))
    assert {r.x: r.t for r in rows.collect()} == texts


def test_messages_written_at_once_are_the_same_text(spark):
    """Messages with all fields are written together, and ends are only trimmed where needed."""
    whole = [message("\u3000 a\u00e9 \"b\"\n\\ \ufeff", name="", tool_call_id="t"), message(""), message("\U0001f600")]
    bodies = [{"model": "m", "messages": m} for m in (whole, [*whole, {"content": "x"}])]
    at_once, singly = canonical(spark, *bodies)
    assert json.loads(at_once)["messages"][0] == {"role": "user", "content": "a\u00e9 \"b\"\n\\", "name": None, "tool_call_id": "t"}
    assert singly == at_once.replace(']', ',{"content":"x","name":null,"tool_call_id":null}]', 1)
    plan = requests.canonical_request(parsed(spark, *bodies))._jdf.queryExecution().optimizedPlan().toString()
    assert "ignoreNullFields" in plan


def test_json_objects_are_passed_over_and_the_rest_is_read(spark):
    good = ["{}", " {} ", '{"a":[1,{"b":null}],"a":2}', '{"-end-":true}', '{"a":"-end-"}', "5", '"x"', "[{}]", '{"é":"日本😀"}']
    bad = [
        "", "{", '{"a":1}}', "{} {}", '{},{"-end-":true}', '{},{"-end-":true}] x', '{"a":tru}', '{"a":NaN}', "{'a':1}",
        '{"a":"\t"}', '{"a":"\\x"}', '{"a":1,}', None,
    ]
    rows = spark.createDataFrame([(t, i < len(good)) for i, t in enumerate(good + bad)], "t string, good boolean")
    wrong = rows.where(is_json(F.col("t")) != F.col("good"))
    assert [r.t for r in wrong.collect()] == []
    # Only what is no object, or holds the mark, is copied.
    plan = rows.select(is_json(F.col("t")))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("StructField(-end-") < plan.index("ArrayType(StringType")
