"""The chat template, the line protocol, logs with bad bytes, end tokens."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from quernel import queries
from quernel.functions import text as X
from quernel.operators import hooks, logs, rewards
from quernel.streaming.windows import follow_log, serve_requests
from tests.compare import same_rows

M = "struct<role:string,content:string,tool_calls:array<struct<name:string,arguments:string>>>"


@pytest.mark.parametrize("name", ["chat_template", "chat_markup_parse", "reward_service", "eos_rules"])
def test_at_the_size_of_the_driver(spark, name):
    sf_dir = "/root/testdata/sf0.01"
    same_rows(queries.queries()[name](spark, sf_dir), queries.oracle_sql()[name], sf_dir)


def prompt(spark, messages, tools=None, **how):
    df = spark.createDataFrame([(messages, tools)], f"m array<{M}>, t array<string>").coalesce(1)
    return df.select(X.chat_prompt(F.col("m"), tools=None if tools is None else F.col("t"), calls=True, **how)).first()[0]


def test_chat_template(spark):
    system = "<|im_start|>system\nYou are a helpful assistant<|im_end|>\n"
    assert prompt(spark, [("user", "a", None)]) == system + "<|im_start|>user\na<|im_end|>\n"
    assert prompt(spark, [("user", None, None)], generate=True) == system + "<|im_start|>user\n<|im_end|>\n<|im_start|>assistant\n"
    assert prompt(spark, [], generate=True, thinking=False) == system + "<|im_start|>assistant\n<think>\n\n</think>\n\n"
    assert prompt(spark, None) is None
    assert prompt(spark, [("system", "s", None), ("system", "t", None), ("other", "x", None)]) == "<|im_start|>system\ns<|im_end|>\n<|im_start|>system\nt<|im_end|>\n"


def test_chat_template_with_tools(spark):
    calls = [("f", '{"x": 1}'), ("g", "{}")]
    messages = [("user", "q", None), ("assistant", "", calls), ("tool", "1", None), ("tool", "2", None), ("assistant", "done", calls[1:])]
    got = prompt(spark, messages, ['{"a": 1}', '{"b": 2}'])
    head, turns = got.split("<|im_end|>\n", 1)
    assert head == "<|im_start|>system\n" + X.TOOLS_LEAD + '\n{"a": 1}\n{"b": 2}' + X.TOOLS_TAIL
    assert turns == (
        "<|im_start|>user\nq<|im_end|>\n"
        '<|im_start|>assistant\n<tool_call>\n{"name": "f", "arguments": {"x": 1}}\n</tool_call>\n<tool_call>\n{"name": "g", "arguments": {}}\n</tool_call><|im_end|>\n'
        "<|im_start|>user\n<tool_response>\n1\n</tool_response>\n<tool_response>\n2\n</tool_response><|im_end|>\n"
        '<|im_start|>assistant\ndone\n<tool_call>\n{"name": "g", "arguments": {}}\n</tool_call><|im_end|>\n'
    )
    assert prompt(spark, [("system", "s", None)], ["{}"]).startswith("<|im_start|>system\ns\n\n# Tools")
    assert prompt(spark, [("user", "q", None)], []).startswith("<|im_start|>system\nYou are")


def _factory():
    print("loading")  # must not reach the answers
    return lambda turns: len(turns[-1]["content"])


def test_line_protocol(spark, tmp_path):
    ask = json.dumps({"conversation": [{"role": "user", "content": "四字"}]})
    lines = [ask, "", "{}", '{"conversation": []}', "[", ask]
    df = spark.createDataFrame([(i, x) for i, x in enumerate([*lines, None])], "i int, value string")
    got = {r["i"]: json.loads(r["response"]) for r in hooks.answer_lines(df, _factory).collect()}
    assert got[0] == got[5] == {"score": 2.0} and all(list(got[i]) == ["error"] for i in (1, 2, 3, 4, 6))
    assert got[2]["error"] == "KeyError: 'conversation'" and got[3]["error"].startswith("IndexError: ")
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1.jsonl").write_text("\n".join([ask, "x", ask]) + "\n", encoding="utf-8")
    q = serve_requests(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "c"), _factory)
    q.awaitTermination(120)
    answers = [json.loads(r[0]) for r in spark.read.text(str(tmp_path / "out")).collect()]
    assert sorted(map(str, answers)) == sorted(map(str, [{"score": 2.0}, {"score": 2.0}, {"error": "JSONDecodeError: Expecting value: line 1 column 1 (char 0)"}]))


def test_logs_with_bad_bytes_and_in_batches(spark, tmp_path):
    folder = tmp_path / "logs"
    folder.mkdir()
    (folder / "a.log").write_bytes(b"\xff\xfe loss:2.0\nloss:1.5 \xe4\xb8\n")
    lines = logs.decoded(spark.read.text(str(folder)))
    assert sorted(r[0] for r in lines.collect()) == ["loss:1.5 \ufffd", "\ufffd\ufffd loss:2.0"]
    seen = []
    follow_log(spark, str(folder), str(tmp_path / "c"), seen.append).awaitTermination(120)
    (folder / "b.log").write_text("loss:0.5\n", encoding="utf-8")
    follow_log(spark, str(folder), str(tmp_path / "c"), seen.append).awaitTermination(120)
    assert [s["n"] for s in seen] == [2, 3] and seen[1]["max_loss"] == 2.0 and seen[1]["min_loss"] == 0.5


def test_fit_is_where_clipped_steps_end(spark):
    """Against an ascent by small steps, without and with weights at the clip."""
    rows = [(i, [1.0, ((i * 37) % 11 - 4) / 10, ((i * 17) % 7 - 3) / 5 + (0.3 if i % 3 else -0.4)]) for i in range(200)]
    df = spark.createDataFrame(rows, "n int, diff array<double>").repartition(5)
    d = np.array([r[1] for r in rows])[:160]
    for clip in (10.0, 0.5, 0.01):
        w = np.zeros(3)
        for _ in range(3000):
            w = np.clip(w + 0.5 * ((1 - 1 / (1 + np.exp(-d @ w))) @ d / len(d) - 0.1 * w), -clip, clip)
        fitted = rewards.fit_pairwise(df, "n", clip=clip)
        assert fitted["weights"] == pytest.approx(w.tolist(), abs=1e-8)
        assert fitted["train_accuracy"] == ((d @ w) > 0).mean() and fitted["train_pairs"] == 160 and fitted["val_pairs"] == 40
    assert rewards.fit_pairwise(df.limit(0), "n")["weights"] == []


def test_end_tokens(spark):
    df = spark.createDataFrame([([1, 2],), ([2, 1],), ([1, 1],), ([],), ([2],)], "i array<int>").coalesce(1)
    i = F.col("i")
    got = df.select(rewards.ends_normally(i, 2), rewards.without_last_eos(i, 2), rewards.before_first_eos(i, 2), rewards.finish_reason(rewards.ends_normally(i, 2)), rewards.ids_in_range(i, 2)).collect()
    assert [tuple(r) for r in got] == [(True, [1], [1], "eos", False), (False, [2, 1], [], "length", False), (False, [1, 1], [1, 1], "length", True), (False, [], [], "length", False), (True, [], [], "eos", False)]
