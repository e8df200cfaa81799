import hashlib
import random
import re
import zlib

from clearpath.llm.registry import ORACLE_SQL
from clearpath.llm.repair import edits, op13_conversation_repair, repair, repair_conversations

from .oracle import same

INITIALS = {"user": "u", "assistant": "a"}


def brute(rows):
    """Best (cost, audit, lines) by trying every edit, at most two inserts in a row, without any search order."""
    best = {("", 0): (0, "", ())}
    for i in range(len(rows) + 1):
        todo = [(r, v) for (r, at), v in best.items() if at == i]
        for _ in range(2):
            new = [(r + x, (c + 3, a + "I", t + ((role, ""),))) for r, (c, a, t) in todo for role, x in INITIALS.items()]
            todo += new
        for r, v in todo:
            if (r, i) not in best or v[:2] < best[r, i][:2]:
                best[r, i] = v
        if i == len(rows):
            break
        role, text, fault = rows[i]
        for (r, at), (c, a, t) in list(best.items()):
            if at != i:
                continue
            steps = [(r, c + 4, a + "D", t)]
            if fault not in ("blank", "duplicate"):
                more = 3 if fault == "truncated" else 0
                steps += [(r + role[:1], c + more, a + "K", t + ((role, text),))] if role else []
                steps += [(r + x, c + more + 3, a + "R", t + ((new, text),)) for new, x in INITIALS.items()]
            for key, *v in steps:
                if re.fullmatch("(s?(ua)*u?)?", key) and ((key, i + 1) not in best or tuple(v[:2]) < best[key, i + 1][:2]):
                    best[key, i + 1] = tuple(v)
    return min(v for (r, at), v in best.items() if at == len(rows) and re.fullmatch("(s?(ua)+)?", r))


def faults(rows):
    seen, out = set(), []
    for role, text in rows:
        words = text.rstrip(" \t\n\x0b\x0c\r")
        out.append((role, text, "blank" if not words else "duplicate" if (role, text) in seen else "truncated" if words[-1] not in ".!?" else ""))
        seen.add((role, text))
    return out


def expected(rows):
    """The query's columns for damaged rows (turn, role, text) of one conversation."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    told = faults([r[1:] for r in rows])
    cost, audit, lines = brute(told)
    turns = [r[0] for r in rows if r[0] is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    count = lambda f: sum(x[2] == f for x in told)
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
    return gaps, count("blank"), count("duplicate"), count("truncated"), illegal, cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in lines).encode()).hexdigest()


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = {1: "", 2: re.sub("[.!?]", "", text)}.get(kind, text)
        if kind:
            out += [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def test_search_against_every_edit():
    rnd = random.Random(1)
    for _ in range(400):
        rows = [(rnd.choice(["user", "user", "assistant", "system", "tool", " "]), rnd.choice(["a.", "b.", "c", " ", "d?"])) for _ in range(rnd.randint(0, 5))]
        told = faults(rows)
        kinds = {"": 0, "blank": 1, "duplicate": 2, "truncated": 3}
        slim = [(r[:1], kinds[f]) for r, _, f in told]
        cost, audit = repair(slim)
        assert (cost, audit) == brute(told)[:2]
        assert "".join(e for e, _ in edits(slim, audit)) == audit


def test_pieces_are_one_search():
    rnd = random.Random(2)
    for _ in range(100):
        rows = [(rnd.choice("uuaasx"), rnd.choice([0, 0, 0, 1, 2, 3])) for _ in range(rnd.randint(0, 60))]
        assert repair(rows, 3) == repair(rows, 1) == repair(rows, 1000)
    assert len(repair([("u", 0), ("u", 3)] * 20_000)[1]) >= 40_000


def test_query(spark, tmp_path):
    rnd = random.Random(3)
    texts = ["Fine.", "Fine.", "cut off", "", None, "\t \x0b", "Really?", "Ä lot! ", "x" * 50_000 + "."]
    rows = [(c, t, rnd.choice(["user", "assistant", "system", None, "", "tool"]), rnd.choice(texts)) for c in [*range(60), None] for t in [None, *range(rnd.randint(0, 7))] if rnd.random() < 0.8]
    rows += rnd.sample(rows, 30)  # repeated rows
    rows += [(100, t, "user" if t % 2 else "assistant", f"Turn {t}.") for t in range(700)]  # one long conversation
    spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, at int, edit string").repartition(3).write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.conv_id: tuple(r)[1:] for r in op13_conversation_repair(spark, str(tmp_path)).collect()}
    hurt = damage(rows)
    assert set(got) == {r[0] for r in rows}
    for conv in got:
        own = [r[1:] for r in hurt if r[0] == conv]
        if conv != 100:
            assert got[conv] == expected(own), conv
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    empty.write.parquet(f"{tmp_path}/none/conversations.parquet")
    assert op13_conversation_repair(spark, f"{tmp_path}/none").count() == 0


def test_repaired_rows(spark):
    rows = [(1, 0, "user", "Hi."), (1, 1, "user", "Still there?"), (1, 2, "assistant", "Yes."), (1, 3, "assistant", "Yes."), (2, 0, "system", "Be kind.")]
    repaired, report = repair_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    assert [(r.conv_id, r.position, r.role, r.text, r.edit, r.turn) for r in repaired.orderBy("conv_id", "position").collect()] == [
        (1, 1, "user", "Hi.", "K", 0), (1, 2, "assistant", "", "I", None), (1, 3, "user", "Still there?", "K", 1), (1, 4, "assistant", "Yes.", "K", 2),
    ]
    assert {r.conv_id: (r.cost, r.audit, r.duplicate) for r in report.collect()} == {1: (7, "KIKKD", 1), 2: (4, "D", 0)}


def test_against_sql(spark):
    sf = "/root/testdata/sf0.01"
    same(op13_conversation_repair(spark, sf), ORACLE_SQL["op13_conversation_repair"], sf)
