from __future__ import annotations

import json

from chatledger import sources
from chatledger.operators import sse


def chunk(content=None, **more):
    delta = {} if content is None else {"content": content}
    choice = {"index": 0, "delta": delta, "finish_reason": more.pop("finish", None)}
    return "data: " + json.dumps({"id": "c1", "model": "gpt-4o", "choices": [choice], **more})


def lines(spark, **streams):
    rows = [(int(k[1:]), "\n\n".join(v) + "\n\n") for k, v in streams.items()]
    return sources.sse_lines(spark.createDataFrame(rows, "stream_id long, text string"))


def reassembled(spark, per_chunk=4096, **streams):
    got = sse.sse_reassemble(lines(spark, **streams), lines_per_chunk=per_chunk).collect()
    return {r.stream_id: r for r in got}


def test_two_chunks(spark):
    est = spark.createDataFrame([(1, 15)], "stream_id long, est_tokens long")
    df = lines(spark, s1=[chunk("Hello"), chunk(" world!"), "data: [DONE]"])
    r = sse.sse_reassemble(df, est).first()
    assert (r.content, r.model, r.prompt_tokens, r.completion_tokens) == ("Hello world!", "gpt-4o", 15, 3)
    assert (r.response_id, r.finish_reason) == ("c1", "stop")


def test_odd_streams(spark):
    streams = {
        "s1": ["event: x", 'data: {"id":"broken","mod', chunk("a"), "data: [DONE]", chunk("late"), "data: [DONE]"],
        "s2": [chunk("never ends")],
        "s3": ["data: [DONE]"],
        "s4": [chunk("a", usage={"prompt_tokens": 9, "completion_tokens": 0}), chunk("b", finish="length"), chunk(""), "data:[DONE]"],
        "s5": ['data: {"choices":[]}', 'data: 5', "data: [DONE]"],
    }
    for per_chunk in (4096, 2):
        got = reassembled(spark, per_chunk, **streams)
        assert set(got) == {1, 3, 4, 5}
        assert got[1].content == "a" and got[1].response_id == "c1"
        assert (got[3].content, got[3].model, got[3].completion_tokens) == ("", "unknown", 1)
        assert (got[4].content, got[4].finish_reason, got[4].prompt_tokens) == ("ab", "length", 9)
        assert got[4].completion_tokens == 1
        assert got[5].content == ""


def test_unended_last_line(spark):
    df = spark.createDataFrame([(1, chunk("a") + "\ndata: [DONE]"), (2, chunk("b"))], "stream_id long, text string")
    got = [(r.stream_id, r.seq, r.line) for r in sources.sse_lines(df).collect()]
    assert got == [(1, 0, chunk("a")), (1, 1, "data: [DONE]")]


def test_replay_round_trip(spark):
    texts = ["Cached answer", "", 'q"\\\n\té 😀  /']
    body = [
        json.dumps({"id": f"r{i}", "created": 5, "model": "m", "choices": [{"message": {"content": t}}]})
        for i, t in enumerate(texts)
    ]
    df = spark.createDataFrame(list(enumerate(body)), "stream_id long, response string")
    replay = sse.sse_replay(df)
    rows = [r for r in replay.collect() if r.stream_id == 0]
    assert len(rows) == 4 and rows[3].line == "data: [DONE]" and "Cached answer" in rows[1].line
    first = json.loads(rows[0].line[6:])
    assert first == {
        "id": "r0", "object": "chat.completion.chunk", "created": 5, "model": "m",
        "choices": [{"index": 0, "delta": {"role": "assistant"}, "finish_reason": None}],
    }
    back = {r.stream_id: r for r in sse.sse_reassemble(replay).collect()}
    assert [back[i].content for i in range(3)] == texts
    assert back[1].completion_tokens == 1 and back[1].finish_reason == "stop"
