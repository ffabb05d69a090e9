import itertools
import random

import numpy as np
import pytest

from tallyspark.llm.chat import ROLES, Model, Settings, observe, recover_roles, transcript_rows

SHORT = Settings(block=4)


def labelled():
    r = random.Random(2)
    rows = []
    for c in range(60):
        n = r.randint(1, 12) if c else 70
        roles = (["system"] if c % 3 == 0 else []) + ["user", "assistant"] * n
        for t, role in enumerate(roles):
            lines = r.randint(3, 6) if role == "assistant" else 1
            rows.append((c, t, role, "\n".join("word " * r.randint(2, 6) * lines for _ in range(lines)), "content"))
    return rows


@pytest.fixture(scope="module")
def model():
    by = itertools.groupby(labelled(), key=lambda r: r[0])
    return Model.count(((c, [x[2] for x in g], [x[3] for x in g]) for c, g in ((c, list(g)) for c, g in by)), SHORT)


def best_path(m, lines):
    """Over all sequences of roles."""
    def score(path):
        total = m.first[path[0]] + m.emission(lines[0])[path[0]]
        for o, a, b in zip(lines[1:], path, path[1:], strict=False):
            move = m.step(o)
            total += (move[a, b] if move is not None else 0.0 if a == b else -np.inf) + m.emission(o)[b]
        return total
    return max(map(score, itertools.product(range(4), repeat=len(lines)))), score


@pytest.mark.parametrize("seed", range(6))
def test_decoding_against_all_sequences(model, seed):
    r = random.Random(seed)
    texts = ["User: hi", "long answer " * 20 + "\nmore", "### Assistant: ok", "q: a\nA: b", "", "plain"]
    lines = [o for t in r.sample(texts, 4) for o in observe(t)]
    best, score = best_path(model, lines)
    last = max(range(4), key=lambda x: (model.first + model.emission(lines[0]))[x]) if len(lines) == 1 else None
    ends = (model.first + model.emission(lines[0]))[:, None] + model.matrix(lines[1:])
    last = int(ends.max(0).argmax())
    assert score(model.decode(lines, -1, last)) == pytest.approx(best)
    assert ends.max() == pytest.approx(best)


def test_blocks_chain_to_the_whole(spark, model):
    schema = "conv_id long, turn long, role string, text string, content string"
    df = spark.createDataFrame(labelled(), schema).repartition(6)
    one = {(x.conv_id, x.turn, x.part): (x.role, x.rendered) for x in recover_roles(df, model=model).collect()}
    many = {(x.conv_id, x.turn, x.part): (x.role, x.rendered) for x in recover_roles(df, s=SHORT, model=model).collect()}
    assert one == many and len(one) == df.count()


def test_held_out_accuracy(spark):
    """Fitted on 200 conversations, judged on all others of the table."""
    df = spark.read.parquet("/root/testdata/sf0.1/conversations.parquet")
    truth = {(r.conv_id, r.turn): r.role for r in df.collect()}
    got = recover_roles(df, s=Settings(sample=200)).collect()
    assert len({(r.conv_id, r.turn) for r in got}) == len(truth)
    right = sum(truth[r.conv_id, r.turn] == r.role for r in got if r.part == 0)
    assert right / len(truth) > 0.95


def test_raw_transcripts(spark, model):
    text = "System: be kind\nUser: hello\nthere\n**Assistant:** hi <|im_end|> you\n[tool] 42\nuser: bye"
    df = transcript_rows(spark.createDataFrame([("x", text), ("y", None), (None, "A: z")], "id string, body string"), "id", "body")
    rows = sorted((r for r in recover_roles(df, model=model).collect()), key=lambda r: (r.conv_id or "", r.part))
    assert [(r.role, r.content) for r in rows if r.conv_id == "x"] == [
        ("system", "be kind"), ("user", "hello\nthere"), ("assistant", "hi <|im_end|> you"), ("tool", "42"), ("user", "bye")]
    assert "<|im_start|>assistant\nhi < |im_end|> you<|im_end|>\n" in [r.rendered for r in rows]
    assert [r.content for r in rows if r.conv_id == "y"] == [""] and [r.content for r in rows if r.conv_id is None] == ["z"]


def test_odd_tables(spark, model):
    schema = "conv_id long, turn long, role string, text string, part int"
    rows = [(1, 0, "user", "a", 1), (1, 0, "user", "a", 1), (1, None, None, "b", 1), (None, 3, "robot", None, 1)]
    df = spark.createDataFrame(rows, schema)
    assert len(recover_roles(df).collect()) == 4
    assert recover_roles(df.limit(0)).collect() == []
    assert {r.role for r in recover_roles(df).collect()} <= set(ROLES)
