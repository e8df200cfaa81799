import hashlib

import numpy as np
from hypothesis import given
from hypothesis import strategies as st

from clearpath.llm.chat import ORACLE, blocks, format_turn, op2_chat_formatting, parse_turns, read_blocks
from clearpath.llm.tokens import Encoder, vocabulary

from .oracle import same


def test_against_sql(spark):
    for sf in ("sf0.001", "sf0.01"):
        same(op2_chat_formatting(spark, f"/root/testdata/{sf}"), ORACLE, f"/root/testdata/{sf}")


turns = st.lists(st.tuples(st.text(alphabet="a:\\#< \n", max_size=6), st.text(alphabet="ab\\#<>/turn: \né", max_size=30)), max_size=6)


@given(turns)
def test_escaping_is_reversible(own):
    assert parse_turns("".join(format_turn(r, t)[0] for r, t in own)) == own


def table(spark):
    rows = []
    for c in range(40):  # all begin alike; many share two turns; some are copies
        rows += [(c, 0, "system", "be kind"), (c, 1, "user", f"question {c % 4}"), (c, 2, "assistant", f"answer {c % 8} </turn> ### \\"), (c, 3, "user", "thanks")][: 2 + c % 3]
    rows += [(50, 0, None, None), (50, 0, None, ""), (51, 1, "assistant", "second"), (51, 0, "user", "first"), (51, 1, "assistant", "second"), (None, 0, "user", "no id"), (52, 0, "assistant", "x" * 5000)]
    return spark.createDataFrame([(*r, 1, 2) for r in rows], "conv_id long, turn long, role string, text string, path int, start int").repartition(3)


def test_edges_against_brute_force(spark):
    df = table(spark)
    got = sorted((tuple(r) for r in read_blocks(blocks(df, block_tokens=300, block_conversations=7)).collect()), key=str)
    by = {}
    for r in df.collect():
        by.setdefault(r.conv_id, []).append((r.turn, r.role or "", r.text or ""))
    want = []
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for c, own in by.items():
        own.sort()
        loss = "".join(t for _, r, t in own if r == "assistant")
        want.append((c, len(own), sha("".join(f"{r}\n{t}\n" for _, r, t in own)), len(loss), sha(loss), sum(len(format_turn(r, t)[0]) for _, r, t in own)))
    assert got == sorted(want, key=str)
    assert read_blocks(blocks(df.limit(0))).count() == 0


def test_shared_turns_stand_once(spark):
    df = table(spark).filter("conv_id < 40").coalesce(1)
    (block,) = blocks(df).coalesce(1).collect()
    ids, known = np.frombuffer(block.ids, "<u4"), Encoder(vocabulary("byte_bpe_50k.json")).token_bytes()
    text = lambda a, z: b"".join(known[i] for i in ids[a:z]).decode()
    whole = text(0, len(ids))
    assert whole.count("be kind") == 1 and whole.count("question 2") == 1
    for n in block.turns:
        path, x = [], n
        while True:
            path.insert(0, x)
            if x.parent < 0:
                break
            x = block.turns[x.parent]
        seen = "".join(text(i.start, i.stop) for i in n.attends)
        assert seen == "".join(text(p.start, p.stop) for p in path)
        assert n.position == sum(i.stop - i.start for i in n.attends) - (n.stop - n.start)  # tokens


def test_control_strings_and_very_long_texts(spark):
    words = Encoder(vocabulary("byte_bpe_50k.json"), added_as_text=True)
    long = "é<|endoftext|>\\ " * 40_000
    df = spark.createDataFrame([(1, 0, "user", "<|endoftext|>"), (1, 1, "assistant", long), (2, 0, "a:b", "日本 \x00 語")], "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in read_blocks(blocks(df)).collect()}
    assert got[1].loss_chars == len(long) and got[1].loss_sha256 == hashlib.sha256(long.encode()).hexdigest()
    assert got[2].turns_sha256 == hashlib.sha256("a:b\n日本 \x00 語\n".encode()).hexdigest()
    ids = {int(i) for r in blocks(df).collect() for i in np.frombuffer(r.ids, "<u4")}
    assert words.tokenizer.token_to_id("<|endoftext|>") not in ids
