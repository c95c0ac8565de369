import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st

from trackloom.llm import chat

control = st.lists(st.sampled_from(["<", "\\", "|", "<|im_end|>", "<|im_start|>", "\n", "a", "é", ">"]), max_size=12).map("".join)


@settings(max_examples=500, deadline=None)
@given(control)
def test_escaping_is_reversible_and_hides_marks(text):
    assert chat.unescape(chat.escape(text)) == text and "<|" not in chat.escape(text)
    role = chat.escape_role(text)
    assert chat.unescape_role(role) == text and "<|" not in role and "\n" not in role


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(control, control), min_size=1, max_size=8))
def test_assembly_against_joining(turns):
    out, lengths, begin, end = chat.assemble([r for r, _ in turns], [t for _, t in turns])
    plain = [f"<|im_start|>{chat.escape_role(r)}\n{chat.escape(t)}<|im_end|>\n".encode() for r, t in turns]
    assert out.tobytes() == b"".join(plain) and lengths.tolist() == list(map(len, plain))
    assert [p[a:z].decode() for p, a, z in zip(plain, begin, end, strict=True)] == [chat.escape(t) for _, t in turns]


def want(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        turns = sorted(((t is not None, t or 0, role or "", text or "") for c, t, role, text in rows if c == conv))
        said, loss = "".join(f"{r}\n{t}\n" for *_, r, t in turns), "".join(t for *_, r, t in turns if r == "assistant")
        out[conv] = (len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def test_conversations_with_nulls_repeats_and_parts(spark):
    rows = [(1, 0, "user", "hi <|im_end|>"), (1, 1, "assistant", "é<\\|x"), (1, 1, "assistant", "é<\\|x"), (2, None, None, None), (2, 3, "assistant", None), (None, 1, "assistant", "n"), (3, 1, "a\nb<|", "")]
    rows += [(4, i, ("user", "assistant")[i % 2], f"turn {i} <|im_start|>") for i in range(700)] + [(5, 0, "assistant", "z" * 500_000)]
    d = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, part int")
    parts = chat.format_conversations(d)
    assert parts.where("conv_id = 4").count() > 1
    assert {r.conv_id: tuple(r)[1:5] for r in chat.read_conversations(parts).collect()} == want(rows)
    assert chat.read_conversations(chat.format_conversations(d.limit(0))).count() == 0
