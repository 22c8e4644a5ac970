import hashlib
import random
from itertools import groupby

from docloom.llm import chat, queries


def expected(turns):
    said = "".join(f"{r or ''}\n{t or ''}\n" for r, t in turns)
    loss = "".join(t or "" for r, t in turns if r == "assistant")
    return len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()


def test_whole_table_reads_back(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()] + queries.PROBE
    got = {r.conv_id: r for r in queries.op8_chat(spark, sf_dir).collect()}
    for conv, turns in groupby(sorted(rows), key=lambda r: r[0]):
        r = got.pop(conv)
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == expected([t[2:] for t in turns])
    assert not got


def test_escapes_are_reversible_and_hide_control_strings():
    rng = random.Random(1)
    pieces = ["\\", "#", "###", "### ", "</turn>", "</turn>\n", "<", "/turn>", "\n", ": ", "a", "é😀", "### user: "]
    for _ in range(2000):
        text = "".join(rng.choice(pieces) for _ in range(rng.randint(0, 12)))
        role = "".join(rng.choice(pieces) for _ in range(rng.randint(0, 3)))
        hidden = chat.escape(text)
        assert chat.unescape(hidden) == text
        assert "###" not in hidden and "</turn>" not in hidden
        formatted, _ = chat.format_window([(role, text), ("assistant", text)], 0)
        assert chat.read_window(formatted) == [(role, text), ("assistant", text)]


def test_windows_keep_the_budget_and_the_system_turn():
    rng = random.Random(3)
    turns = [("system", "be kind")] + [(r, "w " * rng.randint(0, 40)) for r in ("user", "assistant") * 60] + [("user", "w " * 500), ("assistant", "ok")]
    tokens = lambda t: chat.simple_tokens(t) + chat.MARKS
    seen, targets = [], []
    for _, number, text, repeated, loss in chat.windows(((1, r, t) for r, t in turns), 200, 60):
        read = chat.read_window(text)
        assert read[0] == turns[0]
        new = read[repeated:]
        assert new and (sum(tokens(t) for _, t in read) <= 200 or len(new) == 1)
        if number:
            assert sum(tokens(t) for _, t in read[1:repeated]) <= 60
            assert read[1:repeated] == seen[len(seen) - repeated + 1 :]  # the turns just before
        seen += new
        targets += [chat.unescape(text[a:b]) for a, b in loss]
    assert seen == turns
    assert targets == [t for r, t in turns if r == "assistant" and t]


def test_windows_keep_a_budget_of_vocabulary_tokens():
    from tokenizers import Tokenizer

    count, slow = chat.vocabulary_tokens(*queries.public_tokenizer()), Tokenizer.from_file(queries.public_tokenizer()[0])
    turns = [(r, f"antidisestablishmentarianism {i} ### </turn> 你好 " * (i % 7)) for i in range(40) for r in ("user", "assistant")]
    made = list(chat.windows(((1, r, t) for r, t in turns), 400, 100, count))
    assert len(made) > 10
    for _, _, text, repeated, _ in made:
        assert len(slow.encode(text).ids) <= 400 or len(chat.read_window(text)) - repeated == 1


def test_edge_rows(spark):
    rows = [(1, 0, "user", None), (1, 0, "user", None), (1, None, None, "first"), (None, 5, "assistant", ""), (2, 1, "assistant", "x " * 50_000), (2, 0, "system", "s")]
    df = spark.createDataFrame([(*r, "z") for r in rows], "conv_id long, turn long, role string, text string, window string")
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.read_back(chat.format_chats(df)).collect()}
    assert got == {1: expected([(None, "first"), ("user", None), ("user", None)]), None: expected([("assistant", "")]), 2: expected([("system", "s"), ("assistant", "x " * 50_000)])}
    assert chat.read_back(chat.format_chats(df.limit(0))).collect() == []
