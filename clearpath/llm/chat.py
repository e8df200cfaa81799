r"""Chat formatting as prefix trees of conversations.

A turn is formatted as ``### Role: text</turn>`` and a line feed. ``\``, ``#`` and
``<`` inside a text, and ``:`` besides inside a role, get a backslash before them, so
no text can hold a marker, and taking the backslashes away gives it back. Role, text and
marks are encoded one by one with a byte-level vocabulary, in which strings of control
tokens are plain text, so every token lies inside one of them and decodes to it.

Conversations are sorted by the hashes of their turns, so those that share initial
turns are neighbours. A task walks its range in that order and builds *blocks*: a
block is the depth-first stream of the trees' turns, in which a shared turn stands
once, and for each turn

    start, stop       its place in the stream (tokens)
    position          the position id of its first token, counted along its own
                      conversation; those after it follow one by one
    parent            the turn before it, or -1
    attends           the intervals of the stream that it may attend to: its
                      ancestors and itself (causally), neighbours joined
    loss_start/_stop  the assistant's text in the stream (equal: no loss)

and for each conversation its last turn. One conversation is read back from its last
turn's intervals alone. Equal conversations share their last turn.

Scale: one shuffle by conversation, one range shuffle by (path, conv_id), so even
copies of one conversation, or all that begin with one turn, are dealt over tasks; both
are JVM-side. A block ends after ``BLOCK_TOKENS`` or ``BLOCK_CONVERSATIONS``; the next
one repeats only the turns that are open at the cut. A task holds a block.

Rows of a conversation are ordered by turn, then role, then text. Null role or text:
empty. Null conv_id: one conversation. Repeated rows are turns of their own. Empty
table: no blocks, empty result. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, table
from .tokens import Encoder, encoder, vocabulary

BLOCK_TOKENS, BLOCK_CONVERSATIONS, AT_ONCE = 1_000_000, 20_000, 512
VOCABULARY = "byte_bpe_50k.json"
LOSS_ROLE = "assistant"
EXTRA = (-7, r"\### Assistant: </turn> ok")

_TEXT, _ROLE, _BACK = re.compile(r"[\\#<]"), re.compile(r"[\\#<:]"), re.compile(r"\\(.)", re.S)
_TURN = re.compile(r"### ((?:\\.|[^\\:])*): ((?:\\.|[^\\<])*)</turn>\n", re.S)
_NODE = pa.struct([("start", pa.int64()), ("stop", pa.int64()), ("position", pa.int64()), ("parent", pa.int32()), ("attends", pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))), ("loss_start", pa.int64()), ("loss_stop", pa.int64())])
_LEAF = pa.struct([("conv_id", pa.int64()), ("node", pa.int32())])
BLOCK_SCHEMA = "ids binary, turns array<struct<start:long,stop:long,position:long,parent:int,attends:array<struct<start:long,stop:long>>,loss_start:long,loss_stop:long>>, conversations array<struct<conv_id:long,node:int>>"
SCHEMA = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def format_turn(role: str, text: str) -> tuple[str, int, int]:
    """The formatted turn, and where its text stands in it."""
    head = f"### {_ROLE.sub(r'\\\g<0>', role)}: "
    body = _TEXT.sub(r"\\\g<0>", text)
    return f"{head}{body}</turn>\n", len(head), len(head) + len(body)


def unescape(text: str) -> str:
    return _BACK.sub(r"\1", text)


def parse_turns(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of all turns of one formatted conversation."""
    out, at = [], 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if not m:
            raise ValueError(f"not a turn: {formatted[at : at + 40]!r}")
        out.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    return out


class Block:
    """The stream that a task is building."""

    def __init__(self):
        self.parts: list[bytes] = []
        self.tokens, self.nodes, self.leaves = 0, [], []

    def add(self, role: str, encoded: tuple[bytes, bytes, bytes], parent: int) -> int:
        before, own, after = (len(x) // 4 for x in encoded)
        start, stop = self.tokens, self.tokens + before + own + after
        position, attends = 0, []
        if parent >= 0:
            above = self.nodes[parent]
            position, attends = above["position"] + above["stop"] - above["start"], above["attends"]
        if attends and attends[-1]["stop"] == start:
            attends = [*attends[:-1], {"start": attends[-1]["start"], "stop": stop}]
        else:
            attends = [*attends, {"start": start, "stop": stop}]
        loss = (start + before, start + before + own) if role == LOSS_ROLE else (start, start)
        self.nodes.append({"start": start, "stop": stop, "position": position, "parent": parent, "attends": attends, "loss_start": loss[0], "loss_stop": loss[1]})
        self.parts += encoded
        self.tokens = stop
        return len(self.nodes) - 1

    def batch(self) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([b"".join(self.parts)]), pa.array([self.nodes], pa.list_(_NODE)), pa.array([self.leaves], pa.list_(_LEAF))], names=["ids", "turns", "conversations"])


def encode_turns(turns: list[tuple[str, str]], words: Encoder) -> dict[tuple[str, str], tuple[bytes, bytes, bytes]]:
    """Ids of what stands before the text, of the text, and after it, of distinct turns."""
    own, parts = list(dict.fromkeys(turns)), []
    for turn in own:
        formatted, a, z = format_turn(*turn)
        parts += [formatted[:a], formatted[a:z], formatted[z:]]
    ids = words.encode(parts)
    return {turn: tuple(ids[3 * i : 3 * i + 3]) for i, turn in enumerate(own)}


def blocks(conversations: DataFrame, block_tokens: int = BLOCK_TOKENS, block_conversations: int = BLOCK_CONVERSATIONS, vocabulary_path: str | None = None) -> DataFrame:
    """Write all conversations (conv_id, turn, role, text) as blocks; returns the dataset."""
    vocabulary_path = vocabulary_path or vocabulary(VOCABULARY)

    def build(batches):
        block, open_ = Block(), []  # open_: (turn, node) from the root to the last turn
        words = encoder(vocabulary_path, added_as_text=True)
        for batch in batches:
            for at in range(0, len(batch), AT_ONCE):
                ids, lists = (c.to_pylist() for c in batch.slice(at, AT_ONCE).columns)
                lists = [[(t["role"], t["text"]) for t in turns] for turns in lists]
                encoded = encode_turns([t for turns in lists for t in turns], words)
                for conv_id, turns in zip(ids, lists, strict=True):
                    if block.tokens >= block_tokens or len(block.leaves) >= block_conversations:
                        yield block.batch()
                        block, open_ = Block(), []
                    same = 0
                    while same < min(len(open_), len(turns)) and open_[same][0] == turns[same]:
                        same += 1
                    del open_[same:]
                    for turn in turns[same:]:
                        open_.append((turn, block.add(turn[0], encoded[turn], open_[-1][1] if open_ else -1)))
                    block.leaves.append({"conv_id": conv_id, "node": open_[-1][1]})
        if block.leaves:
            yield block.batch()

    text = lambda c: F.coalesce(c, F.lit(""))
    turns = F.sort_array(F.collect_list(F.struct("turn", text("role").alias("role"), text("text").alias("text"))))
    whole = conversations.select("conv_id", "turn", "role", "text").groupBy("conv_id").agg(turns.alias("turns"))
    whole = whole.withColumn("path", F.transform("turns", lambda t: F.xxhash64(t["role"], t["text"])))
    order = whole.repartitionByRange("path", "conv_id").sortWithinPartitions("path", "conv_id")
    return materialize(order.select("conv_id", "turns").mapInArrow(build, BLOCK_SCHEMA), "chat-blocks")


def read_blocks(written: DataFrame, vocabulary_path: str | None = None) -> DataFrame:
    """What the contract asks of each conversation, from the ids of blocks alone."""
    vocabulary_path = vocabulary_path or vocabulary(VOCABULARY)

    def run(batches):
        known_bytes = encoder(vocabulary_path, added_as_text=True).token_bytes()
        for batch in batches:
            for raw, nodes, leaves in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ids = np.frombuffer(raw, "<u4")
                decode = lambda spans, ids=ids: b"".join(known_bytes[i] for a, z in spans for i in ids[a:z].tolist()).decode()
                rows, known = [], {}
                for leaf in leaves:
                    at = leaf["node"]
                    if at not in known:
                        formatted = decode([(x["start"], x["stop"]) for x in nodes[at]["attends"]])
                        turns = parse_turns(formatted)
                        path = []
                        while at >= 0:
                            path.append(nodes[at])
                            at = nodes[at]["parent"]
                        loss = "".join(unescape(decode([(x["loss_start"], x["loss_stop"])])) for x in reversed(path))
                        digest = hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
                        known = {leaf["node"]: (len(turns), digest, len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(formatted))}  # copies are neighbours
                    rows.append((leaf["conv_id"], *known[leaf["node"]]))
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return written.select("ids", "turns", "conversations").mapInArrow(run, SCHEMA)


def op2_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    conv_id, text = EXTRA
    extra = spark.createDataFrame([(conv_id, 0, "user", text), (conv_id, 1, "assistant", text)], "conv_id long, turn long, role string, text string")
    return read_blocks(blocks(rows.unionByName(extra)))


ORACLE = rf"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT {EXTRA[0]}, 0, 'user', '{EXTRA[1]}' UNION ALL SELECT {EXTRA[0]}, 1, 'assistant', '{EXTRA[1]}'),
g AS (
  SELECT conv_id, count(*)::BIGINT AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS t,
    coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '') AS l,
    sum(len(role) + len(text) + 14 + len(regexp_replace(role, '[^\\#<:]', '', 'g')) + len(regexp_replace(text, '[^\\#<]', '', 'g')))::BIGINT AS f
  FROM c GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(t) AS turns_sha256, len(l)::BIGINT AS loss_chars, sha256(l) AS loss_sha256, f AS formatted_chars FROM g
"""
