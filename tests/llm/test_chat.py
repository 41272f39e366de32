import hashlib
import random

from codeloom.llm import chat

COLS = "conv_id long, turn int, role string, text string, _s string, t int"


def test_round_trip_of_odd_turns(spark):
    r, marks = random.Random(5), ["</s>", "<s>", "[INST]", "[/INST]", "<|im_start|>", "<|im_end|>", "<|im_cont|>", "<\\/s>", "<\\\\|im_end|>", "[[INST]", "<<SYS>>", "\\", "\n", "ok", "é", "<|im_", "end|>", ""]
    rows = []
    for c in range(60):
        for t in range(r.randint(1, 8)):
            rows.append((c, t, r.choice(["user", "assistant", "assistant", "system", "a\\n\nb", None]), r.choice([None, *("".join(r.choices(marks, k=r.randint(0, 6))) for _ in range(5))])))
    rows += [(100, 1, "user", "tie"), (100, 1, "assistant", "tie"), (100, 1, "assistant", "tie"), (100, None, "user", "first"), (None, 1, "user", "x"), (None, 2, "assistant", "y"), (101, 1, "assistant", "long " * 60_000)]
    turns = spark.createDataFrame([(*x, "extra", 1) for x in rows], COLS)
    got = {x.conv_id: x for x in chat.digests(chat.format_chats(turns)).collect()}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    assert got.keys() == {x[0] for x in rows}
    for c, x in got.items():
        own = sorted(((t is not None, t or 0, role or "", text or "") for i, t, role, text in rows if i == c))
        loss = "".join(text for _, _, role, text in own if role == "assistant")
        assert (x.n_turns, x.loss_chars, x.loss_sha256) == (len(own), len(loss), sha(loss))
        assert x.turns_sha256 == sha("".join(f"{role}\n{text}\n" for _, _, role, text in own))


def test_blocks_and_empty_table(spark):
    turns = spark.createDataFrame([(1, 1, "user", "a"), (1, 2, "assistant", "b"), (1, 3, "assistant", "c")], "conv_id long, turn int, role string, text string")
    x = chat.format_chats(turns).collect()[0]
    assert x.formatted == "<|im_start|>user\na<|im_end|>\n<|im_start|>assistant\nb<|im_cont|>c<|im_end|>\n" and x.n_blocks == 2
    assert [s.text for s in x.segments if s.loss] == ["b", "c"] and "".join(s.text for s in x.segments) == x.formatted
    assert chat.digests(chat.format_chats(turns.limit(0))).count() == 0
