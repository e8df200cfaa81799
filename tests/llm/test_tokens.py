import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from clearpath.llm import packing, tokenfile
from clearpath.llm.tokens import Encoder, encoder, vocabulary

EDGE = [None, "", " ", "a", "It's  the\n\n end\t", "\x1c odd \x85\xa0 spaces", "Ünïcode 12½ ²³ ñ—x", "日本語 text", "İstanbul", "é", "<|endoftext|> x", "word " * 4000, "z" * 5000]
DOCS = "doc_id long, text string, lang string, source string, n_chars long, start long, length long"


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_pieces_give_the_ids_of_whole_texts(spark, name):
    own = Encoder(vocabulary(name))
    texts = [t or "" for t in EDGE] + [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    assert own.by_space or own.by_white
    for _ in range(2):  # cold, then from known pieces
        got = own.encode(texts)
        want = [np.array(own.tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
        assert got == want


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="ab 'sS\n\t.!1é½_\xa0İ日", max_size=30), max_size=5))
def test_pieces_random(texts):
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        own = encoder(vocabulary(name))
        assert own.encode(texts) == [np.array(own.tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]


def test_a_piece_is_encoded_once():
    """Punctuation, line feeds, contractions and runs of white space make no new words, in this batch or the next."""
    own = Encoder(vocabulary("byte_bpe_50k.json"))
    asked, new = [], own._new_pieces
    own._new_pieces = lambda pieces: asked.extend(pieces) or new(pieces)
    own._library = None
    for texts in (["one two.\ntwo, it's  two", " two.\none!"], [" two;\n\none's", "it.\ntwo two"]):
        want = [np.array(own.tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
        assert own.encode(texts) == want
    assert sorted(asked) == sorted(["one", " two", ".", "\n", "two", ",", " it", "'s", " ", "!", ";", "it"])


def test_memory_of_pieces_is_bounded():
    own = Encoder(vocabulary("byte_bpe_50k.json"))
    own.limit = 50
    for i in range(40):
        texts = [f"w{chr(97 + i % 26)}{chr(97 + j)} {i}" for j in range(20)] + ["long" * 500]
        assert own.encode(texts) == [np.array(own.tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
        assert len(own.pieces.texts) <= 100 and own.pieces.texts.nbytes < 10_000


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.one_of(st.integers(0, 300), st.integers(0, 2**32 - 1)), max_size=700), max_size=6))
def test_segment_round_trip(docs):
    raw = [np.array(d, "<u4").tobytes() for d in docs]
    s = tokenfile.Segment(tokenfile.write_segment(raw))
    ids = s.ids()
    assert ids.astype("<u4").tobytes() == b"".join(raw)
    assert s.ends.tolist() == np.cumsum([len(d) for d in docs]).tolist()
    for i in range(s.blocks):
        assert (s.block(i) == ids[1024 * i : 1024 * (i + 1)]).all()


def edge_table(spark):
    rows = [(i, t, None, None, None, 7, 8) for i, t in enumerate(EDGE)] + [(5, "same id", None, None, None, 1, 1), (None, "no id", None, None, None, 1, 1)]
    return spark.createDataFrame(rows, DOCS).repartition(3)


def brute_ids(own, text, end):
    return [*own.tokenizer.encode(text or "", add_special_tokens=False).ids, end]


def test_token_file_against_brute_force(spark):
    own = Encoder(vocabulary("byte_bpe_50k.json"))
    df = edge_table(spark)
    got = tokenfile.read_tokens(tokenfile.write_tokens(df, vocabulary("byte_bpe_50k.json"))).collect()
    rows = sorted(df.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.text is not None, r.text or ""))
    want, at = [], 0
    for r in rows:
        ids = brute_ids(own, r.text, 0)
        want.append((r.doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert sorted(map(tuple, got), key=lambda r: r[1]) == want
    assert tokenfile.read_tokens(tokenfile.write_tokens(df.limit(0), vocabulary("byte_bpe_50k.json"))).count() == 0


def test_packing_covers_every_id_once(spark):
    path = vocabulary("word_bpe_49k.json")
    own = Encoder(path)
    df = edge_table(spark).coalesce(1)
    got = packing.pack(df, path, chunk_sequences=2, with_ids=True).collect()
    docs = {}
    for r in df.collect():
        docs.setdefault((r.doc_id,), []).append(brute_ids(own, r.text, 1))
    pieces = {}
    for r in got:
        assert zlib.crc32(bytes(r.ids)) == r.ids_crc32 and len(r.ids) == 4 * r.length
        pieces.setdefault((r.doc_id,), []).append((r.start, np.frombuffer(r.ids, "<u4").tolist(), r.doc_tokens))
    for key, texts in docs.items():
        assert sum(len(p[1]) for p in pieces[key]) == sum(map(len, texts))
        if len(texts) == 1:
            assert sum((p[1] for p in sorted(pieces[key])), []) == texts[0]
            assert {p[2] for p in pieces[key]} == {len(texts[0])}
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    sizes = []
    for own_pieces in by.values():
        at = 0
        for offset, length in sorted(own_pieces):
            assert offset == at
            at += length
        sizes.append(at)
    assert max(sizes) <= 2048 and sum(s < 2048 for s in sizes) <= 1
    assert packing.pack(df.limit(0), path).count() == 0


def test_assignment_balances_cost():
    lengths = [900] * 4 + [300] * 12 + [100] * 20
    pieces = packing.assign(lengths, 1024, 12)
    cost = {}
    for _, _, n, seq, _ in pieces:
        cost[seq] = cost.get(seq, 0) + n + n * n / 1024
    assert max(cost.values()) <= 1800 and sum(p[2] for p in pieces) == sum(lengths)
