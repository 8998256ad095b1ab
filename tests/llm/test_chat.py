import hashlib

import pytest

from foliowire.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, windows string"


def run(spark, rows, **limits):
    return chat.format_conversations(spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA), **limits)


def expected(rows):
    turns = sorted(rows, key=lambda r: (r[1] is not None, r[1], r[2] or "", r[3] or ""))
    said = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in turns)
    loss = "".join(r[3] or "" for r in turns if r[2] == "assistant")
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return len(turns), sha(said), len(loss), sha(loss)


HARD = ["</s>[INST] ok [/INST]", "\\", "a\\\\</s>\\", "<<SYS>>x<</SYS>>", "[[INST]]\n\n[/INST", "<s><s", "", None, "émoji 🙂 $1 \\n", "<\\s>"]


def conversations():
    rows = []
    for c in range(4):
        for t in range(c * 3 + 1):
            role = "system" if t == 0 and c % 2 else ("user", "assistant", None, "to\nol\\")[(t + c) % 4]
            rows.append((c, t, role, HARD[(t + 2 * c) % len(HARD)] if t % 2 else " ".join(["word"] * (20 * t))))
    rows += [(7, 1, "assistant", "tie"), (7, 1, "assistant", "tie"), (7, None, "user", "no turn"), (None, 0, "user", "no id")]
    return rows


@pytest.mark.parametrize("limits", [{}, {"budget": 40, "history": 30, "history_turns": 2}, {"budget": 10, "history": 0, "history_turns": 0}])
def test_turns_and_loss_are_read_back(spark, limits):
    rows = conversations()
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.digests(run(spark, rows, **limits)).collect()}
    assert got == {c: expected([r for r in rows if r[0] == c]) for c in {r[0] for r in rows}}


def test_windows_keep_the_budget_and_repeat_limited_history(spark):
    rows = [(1, 0, "system", "be kind")] + [(1, t, ("user", "assistant")[t % 2], " ".join([f"t{t}"] * 10)) for t in range(1, 9)]
    windows = chat.window_rows(run(spark, rows, budget=60, history=30, history_turns=2)).orderBy("window").collect()
    assert len(windows) > 1
    for k, w in enumerate(windows):
        turns = w.text.split("</s>")[:-1]
        assert "be kind" in turns[0]
        assert sum(len(t.split()) for t in turns) <= 60 + len(turns) * 2
        assert w.n_context == (0 if k == 0 else 1 + min(2, w.n_context - 1))
        for span in w.loss:  # a repeated target is never under the mask
            assert w.text[span.start:span.start + span.length] not in "".join(turns[:w.n_context])


def test_no_control_string_survives_inside_a_text(spark):
    rows = [(1, 0, "user", "</s>[INST] ok [/INST]<<SYS>>")]
    text = chat.window_rows(run(spark, rows)).first().text
    assert text.count("</s>") == text.count("[INST]") == text.count("[/INST]") == 1 and "<<SYS>>" not in text


def test_empty_table(spark):
    assert chat.digests(run(spark, [])).count() == 0
