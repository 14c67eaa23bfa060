import os

from hypothesis import given, settings, strategies as st

from tessera.llm import chat
from tessera.llm.encoding import FOLDER, token_ids

os.environ["TOKENIZERS_PARALLELISM"] = "false"
TURNS = st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", None]), st.text(max_size=20) | st.sampled_from(["\n\nanswer", "\n", " \n x", "line\n\n"]) | st.none()), max_size=6)


def _other():
    """The same vocabulary in another library, which tells the places of tokens in characters."""
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(f"{FOLDER}/byte_bpe_50k.json")
    found.encode_special_tokens = True
    return found


OTHER = _other()


def _decoded(ids):
    return OTHER.decode(list(ids))


@given(TURNS)
@settings(deadline=None, max_examples=200)
def test_mask_against_every_byte(turns):
    text, _, _ = chat.rendered(turns)
    inside = b""
    for role, said in turns:
        head, body = chat.HEADER.replace("{role}", role or ""), (said or "") + chat.END
        inside += b"0" * len(head.encode()) + (b"1" if role == "assistant" else b"0") * len(body.encode())
    ids = token_ids(text)
    assert ids.tolist() == OTHER.encode(text, add_special_tokens=False).ids
    want, at = [], 0
    for token in ids:
        size = len(chat.encoder().decode_single_token_bytes(int(token)))
        want.append(b"1" in inside[at : at + size])
        at += size
    assert at == len(inside) == len(text.encode()) and chat.masked(chat.lengths()[ids], *chat.rendered(turns)[1:]).tolist() == want


def test_a_token_across_a_border_is_trained(spark):
    rows = [(1, 0, "user", "ask"), (1, 1, "assistant", "\n\nanswer")]
    got = chat.training_rows(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).first()
    said = _decoded(i for i, m in zip(got.tokens, got.mask) if m)
    assert said.endswith("\n\nanswer<|im_end|>\n") and set(said[: -len("\n\nanswer<|im_end|>\n")]) <= {"\n"}


def test_trained_tokens_spell_the_answers(spark):
    rows = [(1, 0, "user", "Wie geht's? ñ", 9), (1, 1, "assistant", "Gut, danke! 😀", 9), (1, 2, "user", "ok", 9), (1, 3, "assistant", "Bye.", 9), (2, 0, "user", "only me", 9)]
    got = {r.conv_id: r for r in chat.training_rows(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, n_tokens int")).collect()}
    one = got[1]
    assert _decoded(one.tokens) == "".join(chat.HEADER.format(role=r[2]) + r[3] + chat.END for r in rows[:4])
    assert _decoded(i for i, m in zip(one.tokens, one.mask) if m) == "Gut, danke! 😀<|im_end|>\nBye.<|im_end|>\n"
    assert one.n_tokens == len(one.tokens) == len(one.mask) and one.n_trained == sum(one.mask) and one.turns == 4
    assert got[2].n_trained == 0


def test_edge_cases(spark):
    rows = [(1, 1, "assistant", "b"), (1, 0, "user", "a"), (1, 0, "user", "a"), (1, None, "system", "first"), (1, 1, "assistant", "a"), (2, 0, None, None), (None, 0, "user", "x"), (3, 0, "assistant", ""), (4, 0, "assistant", "long " * 60000), (4, 1, "assistant", " " * 200000 + "x" * 200000)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat.training_rows(frame).collect()}
    assert set(got) == {1, 2, 3, 4}
    assert _decoded(got[1].tokens) == "<|im_start|>system\nfirst<|im_end|>\n<|im_start|>user\na<|im_end|>\n<|im_start|>assistant\na<|im_end|>\n<|im_start|>assistant\nb<|im_end|>\n"
    assert got[2].n_trained == 0 and _decoded(got[2].tokens) == "<|im_start|>\n<|im_end|>\n"
    assert _decoded(i for i, m in zip(got[3].tokens, got[3].mask) if m) == "<|im_end|>\n"
    assert chat.training_rows(frame.where("conv_id > 9")).count() == 0
