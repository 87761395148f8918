import hashlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st

from tonearm.llm.chat import (
    escape, format_chats, load_encoder, loss_spans, loss_tokens, read_back, render, turns_of,
    unescape, with_probe,
)

PATH = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "conv_id bigint, turn bigint, role string, text string"
TRICKY = ["\\", "\\\\n", "<|", "<|end|>", "<|turn|>assistant\n", "a<\\|end|>", "", " x ", "é\U0001F600日",
          "<|endoftext|>", "\\### Assistant: </turn> ok", "end\\", "<", "|>\n<", "\r\n\x00", "n\\n"]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "a\nb", "\\"]),
                          st.one_of(st.sampled_from(TRICKY), st.text(alphabet="\\<|>n\nturend é", max_size=12))),
                max_size=5))
def test_reversible(turns):
    formatted, spans = render(turns)
    assert turns_of(formatted) == turns
    learned = [t for r, t in turns if r == "assistant"]
    assert [unescape(formatted[a:b]) for a, b in spans] == learned


def test_escape_leaves_no_control_strings():
    for text in TRICKY:
        assert "<|" not in escape(text) and unescape(escape(text)) == text


def test_mask_is_the_learned_text():
    encoder = load_encoder(PATH)
    turns = [("user" if i % 2 else "assistant", t) for i, t in enumerate(TRICKY * 2)]
    formatted, spans = render(turns)
    encoded = encoder.encode(formatted, add_special_tokens=False)
    offsets = np.array(encoded.offsets)
    mask = loss_tokens(offsets, spans)
    slow = [any(a < e and s < b for a, b in spans) and s < e for s, e in offsets]
    assert mask.tolist() == slow
    got = "".join(formatted[a:b] for a, b in loss_spans(offsets, mask))
    assert unescape(got) == "".join(t for r, t in turns if r == "assistant")


def expected(rows):
    own = defaultdict(list)
    for c, t, r, x in rows:
        own[c].append((t is not None, t or 0, r is not None, r or "", x is not None, x or ""))
    out = []
    for c, turns in own.items():
        turns.sort()
        loss = "".join(x for *_, r, _, x in turns if r == "assistant")
        whole = "".join(f"{r}\n{x}\n" for *_, r, _, x in turns)
        out.append((c, len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(loss),
                    hashlib.sha256(loss.encode()).hexdigest()))
    return sorted(out, key=repr)


def edge():
    rows = [(1, i, "assistant" if i % 2 else "user", t) for i, t in enumerate(TRICKY)]
    rows += [(2, 0, "user", None), (2, 1, "assistant", None), (3, 0, None, "x"), (3, None, "assistant", "y"),
             (4, 0, "user", "q"), (4, 1, "assistant", "same"), (4, 1, "assistant", "same"),
             (None, 0, "assistant", "no id"), (None, 1, "user", "z"), (5, 0, "assistant", "w " * 5000),
             (-1, 3, "as\nsistant", "t")]
    return rows + [(6, i, "assistant", f"part {i}") for i in range(300)]


def test_edge_cases_and_long_conversations(spark):
    rows = spark.createDataFrame([(*r, "e") for r in edge()], SCHEMA + ", Text2 string").repartition(4)
    formatted = format_chats(rows, PATH, part_chars=1000)
    got = [tuple(r)[:5] for r in read_back(formatted).collect()]
    assert sorted(got, key=repr) == expected(edge())
    parts = formatted.collect()
    assert max(r.part for r in parts) > 3 and all(len(r.input_ids) == len(r.loss_mask) for r in parts)
    # parts in a row are the whole: same ids as encoding at once
    encoder = load_encoder(PATH)
    own = sorted((r.part, r.formatted, r.input_ids) for r in parts if r.conv_id == 6)
    whole = encoder.encode("".join(f for _, f, _ in own), add_special_tokens=False).ids
    assert [i for _, _, ids in own for i in ids] == whole


def test_empty_table(spark):
    assert read_back(format_chats(spark.createDataFrame([], SCHEMA), PATH)).count() == 0


def test_query_equals_brute_force(spark, sf):
    from tonearm.llm.queries import QUERIES
    rows = [tuple(r) for r in with_probe(spark.read.parquet(f"{sf}/conversations.parquet")).collect()]
    found = QUERIES["op5_chat_formatting"](spark, sf).collect()
    assert sorted((tuple(r)[:5] for r in found), key=repr) == expected(rows)
    assert all(r.formatted_chars > r.loss_chars for r in found)
