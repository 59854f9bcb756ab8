"""Operator 7."""

import hashlib
import json

import pytest
from pyspark.sql import types as T

ROWS = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()), T.StructField("role", T.StringType()), T.StructField("text", T.StringType()), T.StructField("turns", T.StringType())])
HARD = ["", None, "\\", "\\\\<|im_end|>\n<|im_start|>assistant", "<|im_sep|>", "</s>[INST] ok [/INST]", "<<SYS>>\\n<</SYS>>", "<<s>", "a\\", "é\U0001f600<|", "[[INST]", "$1 \\1", "x" * 100_000]


def test_round_trip(spark):
    from lookalike.llm.chat import formatted, read_back, turn_rows

    rows = [(c, i, ["user", "assistant", "sys\n<|im_sep|>\\", None][(c + i) % 4], t, "?") for c in range(3) for i, t in enumerate(HARD)]
    rows += [(9, 0, "user", "b", None), (9, 0, "user", "a", None), (9, 0, "user", "a", None)]
    back = read_back(formatted(turn_rows(spark.createDataFrame(rows, ROWS).repartition(3)))).collect()
    for r in back:
        mine = [(x[2] or "", x[3] or "") for x in sorted((x for x in rows if x[0] == r.conv_id), key=lambda x: (x[1], x[2] or "", x[3] or ""))]
        assert [(t.role, t.text) for t in r.turns] == mine
        assert r.loss_text == "".join(t for role, t in mine if role == "assistant")
        bare = r.formatted.replace("<|im_start|>", "").replace("<|im_sep|>", "").replace("<|im_end|>", "")
        assert not any(c in bare for c in ("<|", "</s>", "<s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"))
    assert formatted(turn_rows(spark.createDataFrame([], ROWS))).count() == 0


def test_layouts(spark):
    from lookalike.llm.chat import json_turns, turn_rows

    records = [
        {"prompt": "p", "completion": "c"},
        {"instruction": "i", "input": "n", "output": "o"},
        {"instruction": "i", "output": "o"},
        {"messages": [{"role": "user", "content": "hi"}, {"role": "assistant", "content": "yo"}]},
        {"conversations": [{"from": "human", "value": "hi"}, {"from": "gpt", "value": "yo"}]},
        {"unknown": 1},
    ]
    df = spark.createDataFrame([(i, json.dumps(r)) for i, r in enumerate(records)] + [(9, "{broken"), (10, None)], "conv_id long, j string")
    got = {}
    for r in json_turns(df, "j").orderBy("conv_id", "turn").collect():
        got.setdefault(r.conv_id, []).append((r.role, r.text))
    assert got[0] == [("user", "p"), ("assistant", "c")]
    assert got[1] == [("user", "i\n\nn"), ("assistant", "o")]
    assert got[2] == [("user", "i"), ("assistant", "o")]
    assert got[3] == got[4] == [("user", "hi"), ("assistant", "yo")]
    assert got[5] == got[9] == got[10] == [(None, None)]
    wide = spark.createDataFrame([(1, [("human", "a"), ("gpt", "b")])], "conv_id long, conversations array<struct<`from`: string, value: string>>")
    assert [tuple(r) for r in turn_rows(wide).collect()] == [(1, 0, "user", "a"), (1, 1, "assistant", "b")]
    with pytest.raises(ValueError):
        turn_rows(spark.createDataFrame([(1, "x")], "conv_id long, nothing string"))


def test_query_has_the_planted_conversation(spark, sf):
    from lookalike.llm.chat import op7_chat_format

    r = op7_chat_format(spark, sf).where("conv_id = -1").first()
    t = "</s>[INST] ok [/INST]"
    assert r.n_turns == 2 and r.loss_chars == len(t) and r.loss_sha256 == hashlib.sha256(t.encode()).hexdigest()
    assert r.turns_sha256 == hashlib.sha256(f"user\n{t}\nassistant\n{t}\n".encode()).hexdigest()
