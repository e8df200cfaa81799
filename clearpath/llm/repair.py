"""Repair of conversations: the cheapest edits that give a conversation its grammar.

A conversation's roles shall read ``(s?(ua)+)?`` by their initials (system, user,
assistant). Its rows, in order of their turn, and the grammar's four states make a
lattice of nodes (rows passed, state). An edit leads from node to node: Keep costs 0,
Rerole 3, Delete 4 (the only edit of a blank or duplicate row), Insert of an empty user or
assistant turn 3; a truncated row that stays costs 3 more. The lattice is never built:
Dijkstra's search makes a node's edges as it pops the node. Its priority is (cost, audit),
the audit being the edits' initials so far, and it stops at the first end node popped in an
accepting state; so of repairs that cost the same the one with the ASCII-least audit is
taken. (At one node no audit of the least cost is the beginning of another, since that would
take a free cycle of inserts; so what follows never changes which is less.)

A long conversation is searched ``SEGMENT`` rows at a time: the best audit of every state
at a segment's end begins the search in the next one, and what these audits begin with in
common is settled and leaves memory. The result is that of one search.

Scale: one shuffle of the rows by conversation, sorted by Spark, which spills. Searches see
(initial, fault, turn) only, a conversation at a time from a stream of rows, and give an
edit a row; edits join rows by (conversation, place); digests read the repaired rows as a
stream too. So a conversation of any length, as that of all rows without an id, passes
through a task in bounded memory for its texts; its audit is one string, as asked for.

Defined cases: null role or text is one space; null turns come first; rows of one turn
follow in order of role, text; repeated rows are duplicates; rows without an id are one
conversation, whose id is null; an empty text is blank; an empty role has no initial and cannot be kept. Other columns are not read. An empty
table gives an empty result.
"""

from __future__ import annotations

import hashlib
import heapq
import os

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, table

#: Rows of a conversation that one search sees.
SEGMENT = 256
SPACE = " \t\n\x0b\f\r"
#: (state, initial) -> state. 0: nothing yet; 1: system; 2: user; 3: assistant. Ends: 0, 3.
NEXT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
#: The role that an inserted or changed turn must have in a state.
WANTED = ["u", "u", "a", "u"]
ENDS = (0, 3)
FINE, BLANK, DUPLICATE, TRUNCATED = range(4)
EMPTY = hashlib.sha256(b"").hexdigest()


def search(rows: list[tuple[str, int]], starts: dict[int, tuple[int, str]], last: bool) -> dict[int, tuple[int, str]]:
    """``rows``: (initial, fault). ``starts``: state -> (cost, audit) before them. The same
    behind them: of the first accepting end node popped if ``last``, else of every state."""
    heap = [(cost, audit, 0, state) for state, (cost, audit) in starts.items()]
    heapq.heapify(heap)
    done, ends = set(), {}
    while heap:
        cost, audit, at, state = heapq.heappop(heap)
        if (at, state) in done:
            continue
        done.add((at, state))
        if at == len(rows):
            if last and state in ENDS:
                return {state: (cost, audit)}
            ends[state] = (cost, audit)
        wanted = WANTED[state]
        moves = [(3, "I", at, NEXT[state, wanted])]
        if at < len(rows):
            initial, fault = rows[at]
            moves.append((4, "D", at + 1, state))
            if fault not in (BLANK, DUPLICATE):
                stays = 3 if fault == TRUNCATED else 0
                moves.append((3 + stays, "R", at + 1, NEXT[state, wanted]))
                if (state, initial) in NEXT:
                    moves.append((stays, "K", at + 1, NEXT[state, initial]))
        for more, letter, to, then in moves:
            if (to, then) not in done:
                heapq.heappush(heap, (cost + more, audit + letter, to, then))
    return ends


def repair(rows: list[tuple[str, int]], segment: int = SEGMENT) -> tuple[int, str]:
    """Cost and audit of the cheapest repair of one conversation."""
    settled, ends = [], {0: (0, "")}
    for at in range(0, max(1, len(rows)), segment):
        ends = search(rows[at : at + segment], ends, at + segment >= len(rows))
        common = os.path.commonprefix([audit for _, audit in ends.values()])
        settled.append(common)
        ends = {state: (cost, audit[len(common) :]) for state, (cost, audit) in ends.items()}
    ((cost, audit),) = ends.values()
    return cost, "".join([*settled, audit])


def edits(rows: list[tuple[str, int]], audit: str) -> list[tuple[str, str]]:
    """The audit dealt to the rows: (edits, role initials they give; - for none) of each row
    with the inserts before it, and at the end of the inserts behind the last."""
    out, state, letters, given, at = [], 0, "", "", 0
    for letter in audit:
        role = "-" if letter == "D" else rows[at][0] if letter == "K" else WANTED[state]
        state = state if letter == "D" else NEXT[state, role]
        letters, given = letters + letter, given + role
        if letter != "I":
            out.append((letters, given))
            letters, given, at = "", "", at + 1
    return [*out, (letters, given)]


REPORT = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
EDITS = pa.schema([("conv_id", pa.int64()), ("at", pa.int64()), ("edit", pa.string()), ("roles", pa.string()), *((name, pa.int64()) for name in REPORT)])


def _repaired(segment: int):
    """Rows in order of conversation and place -> a row for each with its edits, and one for
    each conversation (place 0) with its whole audit, counts and cost."""

    def told(conv: int | None, rows: list[tuple[str, int]], turns: tuple[int, int, int] | None) -> list[tuple]:
        cost, audit = repair(rows, segment)
        gaps = min(turns[1] - turns[0] + 1 - turns[2], 2**63 - 1) if turns else 0
        faults = [fault for _, fault in rows]
        illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
        whole = (conv, 0, audit, "", gaps, *(faults.count(x) for x in (BLANK, DUPLICATE, TRUNCATED)), illegal, cost)
        own = [(conv, i + 1, e, r, *[None] * len(REPORT)) for i, (e, r) in enumerate(edits(rows, audit)) if e]
        return [whole, *own]

    def run(batches):
        conv, rows, turns, out = None, [], None, []
        for batch in batches:
            for c, turn, initial, fault in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if rows and c != conv:
                    out += told(conv, rows, turns)
                    rows, turns = [], None
                    if len(out) >= 10_000:
                        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out, strict=True), EDITS, strict=True)], schema=EDITS)
                        out = []
                conv = c
                rows.append((initial, fault))
                if turn is not None:  # turns come in order
                    turns = (turns[0], turn, turns[2] + (turn != turns[1])) if turns else (turn, turn, 1)
        if rows:
            out += told(conv, rows, turns)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out, strict=True), EDITS, strict=True)], schema=EDITS)

    return run


def in_order(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role and text with each row's place in its conversation and fault."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), space("role"), space("text"))
    own = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "role", "text")
    rows = rows.withColumn("at", F.row_number().over(own))
    seen = F.row_number().over(Window.partitionBy("conv_id", "role", "text").orderBy("at")) > 1
    words = F.rtrim("text", F.lit(SPACE))
    fault = F.when(words == "", BLANK).when(seen, DUPLICATE).when(~F.right(words, F.lit(1)).isin(".", "!", "?"), TRUNCATED).otherwise(FINE)
    return rows.withColumn("fault", fault)


def repair_conversations(conversations: DataFrame, segment: int = SEGMENT) -> tuple[DataFrame, DataFrame]:
    """``conversations``: conv_id, turn, role, text. Two tables: the repaired conversations
    (conv_id, position from 1, role, text, edit, turn; an inserted row has no turn), and a report (conv_id,
    gaps, blank, duplicate, truncated, illegal, cost, audit)."""
    rows = materialize(in_order(conversations), "turns")
    slim = rows.select("conv_id", "turn", F.left("role", F.lit(1)).alias("initial"), F.col("fault").cast("int"), "at")
    stream = slim.repartition("conv_id").sortWithinPartitions("conv_id", "at").select("conv_id", "turn", "initial", "fault")
    done = materialize(stream.mapInArrow(_repaired(segment), "conv_id long, at long, edit string, roles string, " + ", ".join(f"{n} long" for n in REPORT)), "edits")
    report = done.filter("at = 0").select("conv_id", *REPORT, F.col("edit").alias("audit"))

    own = rows.select("conv_id", "at", "turn", "role", "text")
    steps = done.filter("at > 0").select(F.col("conv_id").alias("_conv"), F.col("at").alias("_at"), "edit", "roles")
    pairs = steps.join(own, F.col("_conv").eqNullSafe(F.col("conv_id")) & (F.col("_at") == F.col("at")), "left")
    each = pairs.select(F.col("_conv").alias("conv_id"), "_at", "turn", "role", "text", F.posexplode(F.arrays_zip(F.split("edit", "").alias("edit"), F.split("roles", "").alias("given"))).alias("_k", "step"))
    role = F.when(F.col("step.edit") == "K", F.col("role")).otherwise(F.when(F.col("step.given") == "u", "user").otherwise("assistant"))
    added = F.col("step.edit") == "I"
    kept = each.filter("step.edit <> 'D'").select("conv_id", "_at", "_k", role.alias("role"), F.when(added, "").otherwise(F.col("text")).alias("text"), F.col("step.edit").alias("edit"), F.when(~added, F.col("turn")).alias("turn"))
    position = F.row_number().over(Window.partitionBy("conv_id").orderBy("_at", "_k"))
    return kept.select("conv_id", position.alias("position"), "role", "text", "edit", "turn"), report


def _digest(batches):
    """Rows in order -> conv_id and the digest of a conversation's ``role:text`` lines."""
    conv, said, ids, digests = None, None, [], []
    for batch in batches:
        for c, role, text in zip(*(x.to_pylist() for x in batch.columns), strict=True):
            if said is None or c != conv:
                if said is not None:
                    ids.append(conv)
                    digests.append(said.hexdigest())
                conv, said = c, hashlib.sha256(f"{role}:{text}".encode("utf-8", "surrogatepass"))
            else:
                said.update(f"\n{role}:{text}".encode("utf-8", "surrogatepass"))
        if len(ids) >= 10_000:
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(digests, pa.string())], names=["conv_id", "repaired_sha256"])
            ids, digests = [], []
    if said is not None:
        ids.append(conv)
        digests.append(said.hexdigest())
    if ids:
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(digests, pa.string())], names=["conv_id", "repaired_sha256"])


def damaged(conversations: DataFrame) -> DataFrame:
    """What the query repairs: a row's crc32 of ``conv_id:turn`` modulo 20 decides whether it
    is dropped (0), emptied (1), loses its full stops (2), is repeated (3) or becomes the
    user's (4)."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = conversations.select("conv_id", "turn", said("role").alias("role"), said("text").alias("text"))
    kind: Column = F.crc32(F.concat_ws(":", said("conv_id"), said("turn"))) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.explode(F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    out = rows.filter(kind != 0).select("conv_id", "turn", F.when(kind == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), copies.alias("copy"))
    return out.drop("copy")


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    repaired, report = repair_conversations(damaged(rows))
    stream = repaired.select("conv_id", "role", "text", "position").repartition("conv_id").sortWithinPartitions("conv_id", "position").select("conv_id", "role", "text")
    digest = stream.mapInArrow(_digest, "conv_id long, repaired_sha256 string")
    every = rows.select("conv_id").distinct()
    own = lambda d, name: d.withColumnRenamed("conv_id", name)
    out = every.join(own(report, "_r"), F.col("conv_id").eqNullSafe(F.col("_r")), "left").join(own(digest, "_d"), F.col("conv_id").eqNullSafe(F.col("_d")), "left")
    return out.select("conv_id", *(F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in REPORT), F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(EMPTY)).alias("repaired_sha256"))


#: The same by a table of the best audit of each state after each row. At most two inserts
#: between rows are ever worth while; ``crc32`` is worked out byte by byte.
ORACLE = r"""
WITH RECURSIVE crcs AS (SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
said AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS name FROM conversations),
keyed AS (SELECT *, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, len(name) + 1), lambda i: ascii(substr(name, i, 1))::BIGINT)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS kind FROM said, crcs),
damaged AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE WHEN kind = 3 THEN [0, 1] ELSE [0] END) AS copy FROM keyed WHERE kind <> 0),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS place_ FROM damaged),
judged AS (SELECT *, rtrim(text, E' \t\n\x0b\f\r') AS words, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY place_) > 1 AS seen FROM placed),
faulty AS (SELECT conv_id, turn, role, text, place_, role[1] AS initial, CASE WHEN words = '' THEN 'b' WHEN seen THEN 'd' WHEN words[-1] NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS fault, lag(role[1]) OVER (PARTITION BY conv_id ORDER BY place_) AS before FROM judged),
counts AS (SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated,
  count(*) FILTER (place_ > 1 AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal FROM faulty GROUP BY conv_id),
inserts(state, cost, letters, roles, then_) AS (VALUES (0, 0, '', '', 0), (1, 0, '', '', 1), (2, 0, '', '', 2), (3, 0, '', '', 3), (0, 3, 'I', 'u', 2), (1, 3, 'I', 'u', 2), (2, 3, 'I', 'a', 3), (3, 3, 'I', 'u', 2), (0, 6, 'II', 'ua', 3), (1, 6, 'II', 'ua', 3)),
legal(state, initial, then_) AS (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)),
best AS (
  SELECT conv_id, 0::BIGINT AS place_, 0 AS state, {'cost': 0, 'audit': '', 'lines': ''} AS x FROM counts
  UNION ALL
  SELECT conv_id, place_, state, min(x) FROM (
    SELECT b.conv_id, f.place_, e.state, {'cost': b.x.cost + i.cost + e.cost, 'audit': b.x.audit || i.letters || e.letter,
      'lines': b.x.lines || replace(replace(i.roles, 'u', E'\nuser:'), 'a', E'\nassistant:') || CASE e.letter WHEN 'D' THEN '' WHEN 'K' THEN E'\n' || f.role || ':' || f.text ELSE E'\n' || e.role || ':' || f.text END} AS x
    FROM best b JOIN inserts i ON b.state = i.state JOIN faulty f ON f.conv_id IS NOT DISTINCT FROM b.conv_id AND f.place_ = b.place_ + 1,
    LATERAL (SELECT i.then_ AS state, 4 AS cost, 'D' AS letter, '' AS role UNION ALL
      SELECT l.then_, CASE WHEN f.fault = 't' THEN 3 ELSE 0 END, 'K', '' FROM legal l WHERE l.state = i.then_ AND l.initial = f.initial AND f.fault NOT IN ('b', 'd') UNION ALL
      SELECT l.then_, CASE WHEN f.fault = 't' THEN 6 ELSE 3 END, 'R', CASE l.initial WHEN 'u' THEN 'user' ELSE 'assistant' END FROM legal l WHERE l.state = i.then_ AND l.initial <> 's' AND f.fault NOT IN ('b', 'd')) e
  ) GROUP BY conv_id, place_, state
),
ends AS (SELECT b.conv_id, min({'cost': b.x.cost + i.cost, 'audit': b.x.audit || i.letters, 'lines': b.x.lines || replace(replace(i.roles, 'u', E'\nuser:'), 'a', E'\nassistant:')}) AS x
  FROM best b JOIN counts c ON c.conv_id IS NOT DISTINCT FROM b.conv_id AND c.n = b.place_ JOIN inserts i ON i.state = b.state WHERE i.then_ IN (0, 3) GROUP BY b.conv_id)
SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal,
  coalesce(x.cost, 0)::BIGINT AS cost, coalesce(x.audit, '') AS audit, sha256(coalesce(x.lines[2:], '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN ends e ON e.conv_id IS NOT DISTINCT FROM o.conv_id
"""
