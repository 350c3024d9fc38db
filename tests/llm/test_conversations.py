"""Conversation repair against an exhaustive search of edits, and the query against a plain reading of its contract."""

import hashlib
import itertools
import random
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

pytest.importorskip("tracklens.llm")
from tracklens.llm import conversations, queries  # noqa: E402

DATA = "/root/testdata/sf0.001"
GRAMMAR = re.compile(r"(s?(ua)+)?")
NAMES = {"u": "user", "a": "assistant"}


def fault_list(rows):
    out, seen = [], set()
    for role, text in rows:
        said = re.findall(r"[^\x20\x09-\x0D]", text)
        out.append("blank" if not said else "duplicate" if (role, text) in seen else "truncated" if said[-1] not in ".!?" else None)
        seen.add((role, text))
    return out


def exhaustive(rows):
    """Every choice for every row with up to three turns inserted at each place: the least (cost, audit, repaired)."""
    faults = fault_list(rows)
    best = None
    choices = [["D"] if f in ("blank", "duplicate") else ["D", "K", "Ru", "Ra"] for f in faults]
    inserts = [list(x) for n in range(3) for x in itertools.product("ua", repeat=n)]
    # turn by turn, keeping only what the grammar may still accept: the cut is by the grammar, never by cost
    partial = {("", 0, "", ())}
    for k in range(len(rows) + 1):
        grown = set()
        for said, cost, audit, kept in partial:
            for more in inserts:
                grown.add((said + "".join(more), cost + 3 * len(more), audit + "I" * len(more), kept + tuple((NAMES[x], "") for x in more)))
        grown = {g for g in grown if re.fullmatch(r"s?(ua)*u?", g[0])}
        if k == len(rows):
            partial = grown
            break
        partial = set()
        (role, text), extra = rows[k], 3 * (faults[k] == "truncated")
        for said, cost, audit, kept in grown:
            for c in choices[k]:
                if c == "D":
                    partial.add((said, cost + 4, audit + "D", kept))
                elif c == "K":
                    if role[:1]:
                        partial.add((said + role[0], cost + extra, audit + "K", (*kept, (role, text))))
                else:
                    partial.add((said + c[1], cost + extra + 3, audit + "R", (*kept, (NAMES[c[1]], text))))
        partial = {g for g in partial if re.fullmatch(r"s?(ua)*u?", g[0])}
    best = min((cost, audit, kept) for said, cost, audit, kept in partial if GRAMMAR.fullmatch(said))
    return best


def viterbi(rows):
    """(cost, audit, repaired) as the operator finds it, with UNDECIDED as it is."""
    c = conversations.Conversation()
    edits = [e for (role, text), f in zip(rows, fault_list(rows)) for e in c.add(None, role, text, f)]
    edits += list(c.finish())
    return c.cost, "".join(c.audit), tuple((role, text) for e, _, role, text in edits if e != "D")


def test_cheapest_edits_are_those_of_an_exhaustive_search(monkeypatch):
    rng = random.Random(3)
    roles = ["system", "user", "assistant", "user", "assistant", "tool", " ", "agent"]
    for undecided in (1, 64):
        monkeypatch.setattr(conversations, "UNDECIDED", undecided)
        for n in (0, 1, 2, 2, 3, 3, 3, 4):
            for _ in range(12):
                rows = [(rng.choice(roles), rng.choice(["Hi.", "Yes!", "cut", "", " \t", "Hi.", "more.  "])) for _ in range(n)]
                assert viterbi(rows) == exhaustive(rows), rows


def dynamic(rows):
    """The same by one table over all rows that is never cut: for longer conversations."""
    step, follows = {"": "u", "s": "u", "u": "a", "a": "u"}, {"": "su", "s": "u", "u": "a", "a": "u"}
    best = {"": (0, "")}

    def closed(t):
        for _ in range(4):
            for s in list(t):
                c = (t[s][0] + 3, t[s][1] + "I")
                if step[s] not in t or c < t[step[s]]:
                    t[step[s]] = c
        return t

    best = closed(best)
    for (role, _), f in zip(rows, fault_list(rows)):
        new = defaultdict(list)
        for s, (c, p) in best.items():
            new[s].append((c + 4, p + "D"))
            if f not in ("blank", "duplicate"):
                extra = 3 * (f == "truncated")
                if role[:1] and role[0] in follows[s]:
                    new[role[0]].append((c + extra, p + "K"))
                new[step[s]].append((c + extra + 3, p + "R"))
        best = closed({s: min(v) for s, v in new.items()})
    return min(best[""], best["a"])


def test_long_conversations_stream():
    rng = random.Random(9)
    for pattern in (["user"], ["assistant"], ["system"], ["assistant", "user"], ["user", "assistant"], ["system", "user", "assistant", "tool"]):
        rows = [(pattern[k % len(pattern)] if rng.random() < 0.8 else rng.choice(["user", "assistant", "system"]), f"turn {k}" + rng.choice([".", "", "!"])) for k in range(1500)]
        cost, audit, _ = viterbi(rows)
        assert (cost, audit) == dynamic(rows)
    c, most = conversations.Conversation(), 0
    for k in range(20_000):
        list(c.add(k, "user" if k % 3 else "assistant", f"{k}.", None))
        most = max(most, len(c.waiting))
    assert most <= 2 * conversations.UNDECIDED


def wanted(rows):
    """op13 by its contract, in plain Python."""
    convs = defaultdict(list)
    for conv, turn, role, text in rows:
        here = convs[conv]
        blank = lambda x: " " if x is None else str(x)
        kind = zlib.crc32(f"{blank(conv)}:{blank(turn)}".encode()) % 20
        role, text = blank(role), blank(text)
        role = "user" if kind == 4 else role
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        here += [(turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    out = {}
    for conv, here in convs.items():
        here.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        said = [(r[1], r[2]) for r in here]
        turns = {r[0] for r in here if r[0] is not None}
        f = fault_list(said)
        cost, audit = dynamic(said)
        state, left, k = "", [], 0
        for e in audit:
            if e == "I":
                state = "a" if state == "u" else "u"
                left.append(NAMES[state] + ":")
                continue
            role, text = said[k]
            k += 1
            if e == "K":
                state = role[0]
                left.append(f"{role}:{text}")
            elif e == "R":
                state = "a" if state == "u" else "u"
                left.append(f"{NAMES[state]}:{text}")
        pairs = [a[0][:1] + b[0][:1] for a, b in itertools.pairwise(said)]
        out[conv] = (max(turns) - min(turns) + 1 - len(turns) if turns else 0, *(f.count(x) for x in ("blank", "duplicate", "truncated")), sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256("\n".join(left).encode()).hexdigest())
    return out


COLUMNS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def test_query_on_given_tables(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{DATA}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = {r.conv_id: tuple(r[c] for c in COLUMNS) for r in queries.op13_conversations(spark, DATA).collect()}
    assert got == wanted(rows)


def test_odd_rows(spark, tmp_path):
    rng = random.Random(4)
    rows = [(None, None, None, None), (None, 3, "user", "Null key."), (1, None, "user", "Null turn."), (1, None, "assistant", None), (1, 5, None, "No role."), (1, 5, "user", "Tie."), (1, 5, "assistant", "Tie."), (1, 5, "user", "Tie.")]
    rows += [(2, 7, "user", "x" * 300_000 + "."), (3, 0, "", "Empty role."), (4, 0, "user", " "), (5, -3, "system", "Odd.  ")]
    rows += [(rng.randint(6, 60), rng.choice([None, 0, 1, 1, 2, 3, 9]), rng.choice(["user", "assistant", "system", "tool", None]), rng.choice(["A.", "B!", "C", "", None, "D?\n", "\U0001f600."])) for _ in range(600)]
    rows += [(100, 7, "user", "All dropped.")] if zlib.crc32(b"100:7") % 20 == 0 else []
    k = next(k for k in range(1000) if zlib.crc32(f"200:{k}".encode()) % 20 == 0)
    rows.append((200, k, "user", "All dropped."))
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumn("fault", F.lit(1)).withColumn("present", F.lit("x"))
    df.repartition(5).write.parquet(str(tmp_path / "conversations.parquet"))
    got = {r.conv_id: tuple(r[c] for c in COLUMNS) for r in queries.op13_conversations(spark, str(tmp_path)).collect()}
    assert got == wanted(rows)
    assert got[200] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    none = spark.createDataFrame([], df.schema)
    assert conversations.report(none).count() == conversations.repair(none).count() == 0


def test_repaired_turns(spark):
    df = spark.createDataFrame([(1, 0, "assistant", "Hello."), (1, 1, "user", "Hm"), (1, 2, "user", "Hm"), (1, 3, "assistant", "Yes.")], "c int, n int, who string, what string")
    got = conversations.repair(df, "c", "n", "who", "what").orderBy("position").collect()
    assert "".join(r.edit for r in got) == conversations.report(df, "c", "n", "who", "what").first().audit == "IKKDK"
    assert [(r.turn, r.role, r.text) for r in got if r.edit != "D"] == [(None, "user", ""), (0, "assistant", "Hello."), (1, "user", "Hm"), (3, "assistant", "Yes.")]
