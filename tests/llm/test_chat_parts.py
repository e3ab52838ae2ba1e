import hashlib
from collections import Counter, defaultdict

from hypothesis import given
from hypothesis import strategies as st

from brindle.llm import chat_parts as C

ROWS = "conv_id long, turn long, role string, text string, segment string, parts int"


def expected(rows):
    """Digests of the texts themselves; formatted_chars from the escape rules."""
    rows = [*((False, *r) for r in rows), (True, -1, 0, "user", C.CONTROL_TEXT), (True, -1, 1, "assistant", C.CONTROL_TEXT)]
    convs = defaultdict(list)
    for control, conv, turn, role, text in rows:
        convs[control, conv].append((turn is not None, turn or 0, role is not None, role or "", text or ""))
    out = []
    for (_, conv), turns in convs.items():
        turns = [t[3:] for t in sorted(turns)]
        digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
        loss = "".join(t for r, t in turns if r == "assistant")
        wide = sum(len(C.START + C.END) + 2 + len(r) + len(t) + r.count("\n") + sum(x.count("\\") + x.count("<|") for x in (r, t)) for r, t in turns)
        out.append((conv, len(turns), digest("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), digest(loss), wide, 0, 0))
    return Counter(out)


def run(spark, rows):
    return Counter(map(tuple, C.conversations_digest(spark.createDataFrame([(*r, "x", 1) for r in rows], ROWS)).collect()))


def test_digests(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    rows += [(900, 1, "assistant", "a\\<|b|>\\|<\\|"), (900, 0, "user", None), (901, 0, "assistant", "<|im_end|>\n"), (901, 1, "assistant", "🙂 é")]
    rows += [(None, 0, None, "no id"), (902, None, "system", ""), (902, 0, "user", "b"), (903, 5, "user", "b"), (903, 5, "user", "b")]
    rows += [(904, i, "assistant" if i % 2 else "user", f"turn {i} \\") for i in range(20_000)] + [(905, 0, "user", "y" * 300_000)]
    assert run(spark, rows) == expected(rows)


def test_ties_go_by_role_and_text(spark):
    texts = ["a b", "a", "", "a<|", "a<", "a\\", "a\\|", "a\n", "a|", None, "a<|im_end|>", "ab", "a]", "a[", "\\n", "é", "🙂"]
    rows = [(1, 0, "user", t) for t in texts] + [(2, None, r, t) for r in ("b", None, "", "a\nx", "a", "a\\") for t in ("y", "x")]
    assert run(spark, rows) == expected(rows)


def test_stored_conversation_minus_one_has_a_row_of_its_own(spark):
    rows = [(-1, 0, "user", "stored"), (-1, 7, "assistant", C.CONTROL_TEXT)]
    got = run(spark, rows)
    assert got == expected(rows) and sorted(r[:2] for r in got) == [(-1, 2), (-1, 2)] and len(got) == 2


def test_empty_table(spark):
    assert run(spark, []) == expected([])


@given(st.text(alphabet="\\<|>an\n"), st.text(alphabet="\\<|>an\n"))
def test_escapes_are_reversible_and_hide_control_strings(role, text):
    assert "<|" not in C.escape(text) and C.unescape(C.escape(text)) == text
    segment = f"{C.START}{C.escape_role(role)}\n{C.escape(text)}{C.END}\n"
    assert C.parse(segment) == (role, text)


PARTS = st.lists(
    st.one_of(
        st.builds(lambda t: {"type": "text", "text": t}, st.text(alphabet="\\<|>imagedocu:0n ")),
        st.sampled_from([{"type": "image", "ref": "a"}, {"type": "audio", "ref": "b"}, {"type": "document", "ref": None}]),
    )
)


@given(st.text(alphabet="\\<|>an\n"), PARTS)
def test_typed_parts_are_reversible(role, parts):
    visitor = C.Flattener()
    for part in parts:
        visitor.visit(part)
    segment = f"{C.START}{C.escape_role(role)}\n{''.join(visitor.pieces)}{C.END}\n"
    want = []
    for part in parts:
        if part["type"] != "text":
            want.append((part["type"], part["ref"]))
        elif want and isinstance(want[-1], str):
            want[-1] += part["text"]
        elif part["text"]:
            want.append(part["text"])
    got_role, got = C.parse_parts(segment, visitor.attachments)
    assert got_role == role
    assert [p["text"] if p["type"] == "text" else (p["type"], p["ref"]) for p in got] == want


def test_attachments_reach_the_digest(spark):
    image = ("image", None, "a.png", 56, 28, None, None)
    text = lambda t: ("text", t, None, None, None, None, None)
    rows = [(1, 0, "user", [text("see"), image, image]), (1, 1, "assistant", [text("x<|"), image, text("y")]), (2, 0, "user", [text("z")])]
    turns = spark.createDataFrame(rows, f"conv_id int, turn int, role string, parts array<{C.PART}>")
    got = {r.conv_id: r for r in C.read_back(C.format_turns(turns)).collect()}
    assert (got[1].n_attachments, got[1].expanded_tokens, got[1].loss_chars) == (3, 6, 4)
    assert got[1].loss_sha256 == hashlib.sha256(b"x<|y").hexdigest() and got[2].n_attachments == 0


def test_typed_parts(spark):
    image = ("image", None, "a.png", 100, 29, None, None)
    audio = ("audio", None, "b.wav", None, None, 1.5, None)
    document = ("document", None, "c.pdf", None, None, None, 3)
    text = lambda t: ("text", t, None, None, None, None, None)
    rows = [
        (1, 0, "user", [text("see <|image:0|>"), image, text(" and "), audio, document, None]),
        (1, 1, "assistant", [text("done")]),
        (1, 2, "user", None),
        (1, 3, "user", [("image", None, None, None, None, None, None)]),
    ]
    turns = spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts array<{C.PART}>")
    got = {r.turn: r for r in C.format_turns(turns).collect()}
    assert got[0].segment == "<|im_start|>user\nsee <\\|image:0|><|image:0|> and <|audio:1|><|document:2|><|im_end|>\n"
    assert [tuple(a) for a in got[0].attachments] == [
        (0, "image", "a.png", 4 * 2),
        (1, "audio", "b.wav", 38),
        (2, "document", "c.pdf", 768),
    ]
    assert got[0].expanded_tokens == 8 + 38 + 768 and got[0].loss_end == 0
    assert got[1].segment[got[1].loss_start : got[1].loss_end] == "done" and got[1].attachments == []
    assert got[2].segment == "<|im_start|>user\n<|im_end|>\n" and got[3].expanded_tokens == 1
