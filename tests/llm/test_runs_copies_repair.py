"""Periodic runs, exact copies and conversation repair against versions that know nothing of trees, names or blocks."""

import collections
import hashlib
import itertools
import os
import random
import re
import zlib

import pandas as pd
import pytest
from pyspark.sql import functions as F

from quillstream.llm import conversations, copies, queries, runs

SF = "/root/testdata/sf0.01"
here = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
SPACE = "\x20\x09\x0a\x0b\x0c\x0d"


# -- 11: periodic runs


def brute_runs(w, shortest):
    """Stretches that agree with themselves a period on, period by period."""
    found = {}
    for p in range(1, len(w) // 2 + 1):
        i = 0
        while i + p < len(w):
            first = i
            while i + p < len(w) and w[i] == w[i + p]:
                i += 1
            if i + p - first >= max(shortest, 2 * p):
                found.setdefault((first, i + p), p)
            i += i == first
    return sorted((a, b - a, p) for (a, b), p in found.items())


def brute_run_report(doc_id, text):
    w = [x for x in re.split(f"[{SPACE}]+", text or "") if x]
    n = len(w)
    if doc_id is not None and (h := zlib.crc32(str(doc_id).encode())) % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = brute_runs(w, 12)
    gone = {i for a, length, p in found for i in range(a + p, a + length)}
    top = min(((-length, a, p) for a, length, p in found), default=None)
    longest = (top[1], -top[0], top[2], -1000 * top[0] // top[2]) if top else (None,) * 4
    listed = "".join(f"{a},{length},{p}\n" for a, length, p in sorted(found, key=lambda r: (r[0], r[2])))
    return (doc_id, len(found), *longest, sha(listed), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


RUN_COLUMNS = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def test_runs_of_random_words():
    r = random.Random(3)
    for _ in range(300):
        texts = []
        for _ in range(r.randint(1, 6)):
            w = [b"%d" % r.randint(0, r.choice([0, 1, 2, 5])) for _ in range(r.randint(0, 60))]
            if len(w) > 10 and r.random() < 0.5:
                a, p = r.randrange(len(w) // 2), r.randint(1, len(w) // 2)
                w = [w[i] if i < a + p else w[a + (i - a) % p] for i in range(len(w))]
            texts.append(w)
        shortest = r.choice([2, 3, 4, 5, 8, 12])
        for w, found in zip(texts, runs.runs_of(texts, shortest), strict=True):
            assert sorted(map(tuple, found.tolist())) == brute_runs(w, shortest)


def test_runs_of_words_that_repeat_in_many_ways():
    a, b = [b"a"], [b"a", b"b"]
    while len(b) < 700:
        a, b = b, b + a
    for w in (b, [b"x"] * 400, [b"x", b"y"] * 150 + [b"z"] + [b"x", b"y"] * 150, list(map(bytes, itertools.chain.from_iterable(itertools.repeat((b"p", b"q", b"r"), 100))))):
        assert sorted(map(tuple, runs.runs_of([w], 12)[0].tolist())) == brute_runs(w, 12)


def test_run_report_of_odd_rows(spark):
    pair = "one two " * 20
    rows = [(i, t) for i, t in enumerate(["", None, " \n ", "a", pair, pair + "three", "ğ ü " * 9 + "\x85 \xa0 x", "w " * 11, "w " * 12, "a b c d e f " * 2])]
    rows += [(4, pair), (None, pair), (None, None)] + [(i, "u v w x y z " * 4 + f"{i} {i + 1}") for i in range(100, 160)] + [(i, " " if i % 2 else "") for i in range(200, 240)]
    got = runs.run_report(spark.createDataFrame(rows, "doc_id long, text string")).select(RUN_COLUMNS).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(repr(brute_run_report(*r)) for r in rows)


def test_runs_keep_other_columns_and_empty_tables(spark):
    df = spark.createDataFrame([(1, "a b " * 10, "x", "old")], "doc_id long, text string, `Start` string, runs string")
    row = runs.find_runs(df).collect()[0]
    assert (row.Start, [tuple(r) for r in row.runs], row.collapsed, row.n_words) == ("x", [(0, 20, 2)], "a b", 20)
    assert runs.find_runs(df.limit(0)).collect() == [] and runs.run_report(df.limit(0)).collect() == []


def test_runs_of_a_text_of_several_megabytes(spark):
    text = " ".join(f"w{i % 50000}" for i in range(400_000)) + " q" * 100_000
    row = runs.find_runs(spark.createDataFrame([(1, text), (2, "a b")], "doc_id long, text string")).where("doc_id = 1").collect()[0]
    assert [tuple(r) for r in row.runs] == [(0, 400_000, 50_000), (400_000, 100_000, 1)] and row.collapsed.count(" ") == 50_000


@here
def test_run_query_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").where("length(text) < 6000").collect()
    got = {r.doc_id: tuple(r[c] for c in RUN_COLUMNS) for r in queries.op11_periodic_runs(spark, SF).collect()}
    assert len(got) == 1000 and sum(r[1] > 0 for r in got.values()) > 50
    for d in docs:
        assert got[d.doc_id] == brute_run_report(d.doc_id, d.text)


# -- 12: exact copies


def brute_copies(rows):
    groups = collections.defaultdict(list)
    for i, t in rows:
        groups[re.sub(f"[{SPACE}]+", " ", t or "")].append(i)
    out = []
    for t, ids in groups.items():
        first, *rest = sorted(ids, key=lambda i: (i is None, i))
        out += [(first, first, len(ids), True, sha(t))] + [(i, first, len(ids), False, sha(t)) for i in rest]
    return sorted(map(repr, out))


def copied(df, **options):
    return sorted(repr(tuple(r)) for r in copies.exact_copies(df, **options).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect())


def odd_texts():
    r = random.Random(8)
    texts = [None, "", " ", "\n\t", "a", "a", " a", "a\n", "a  b", "a\r\nb", "a b", "ğ" * 9, "ğ" * 9 + "x", "😀" * 8, "😀" * 16, "aaaaaaaab" * 3, "aaaaaaaa" + "b" * 8, "b" * 8 + "aaaaaaaa"]
    texts += ["".join(r.choice("ab ") for _ in range(r.choice([7, 8, 9, 15, 16, 17, 31, 33, 64, 65]))) for _ in range(60)]
    texts += ["abcdefgh" * k + end for k in (1, 2, 3, 4, 7, 8) for end in ("", "a", "abcdefg", "x")] * 2
    return texts


@pytest.mark.parametrize("size,bits", [(8, 64), (8, 3), (1, 64), (4096, 0)])
def test_copies_of_odd_texts(spark, size, bits):
    """Few bits make unlike blocks share a hash, so that whole blocks decide."""
    texts = odd_texts() if size > 1 else odd_texts()[:30]
    rows = [(i if i % 11 else None, t) for i, t in enumerate(texts)] + [(3, "a"), (3, "a"), (3, "b")]
    assert copied(spark.createDataFrame(rows, "doc_id long, text string"), size=size, bits=bits) == brute_copies(rows)


def test_names_are_of_texts(spark):
    """Level and name agree where texts do, and only there."""
    texts = sorted({re.sub(f"[{SPACE}]+", " ", t or "") for t in odd_texts()})
    found = copies.identities(spark.createDataFrame([(k, t) for i, t in enumerate(texts) for k in (i, i + 1000)], "row long, t string"), 8).collect()
    by = collections.defaultdict(set)
    for r in found:
        by[r.level, r.name].add(r.row % 1000)
    assert len(found) == 2 * len(texts) and len(by) == len(texts) and all(len(x) == 1 for x in by.values())


def test_copies_keep_other_columns_and_empty_tables(spark):
    df = spark.createDataFrame([(1, "a", "x", "k"), (2, "a", "y", "l")], "doc_id long, text string, `Row` string, Kept string")
    assert [(r.doc_id, r.Row, r.kept) for r in copies.exact_copies(df).orderBy("doc_id").collect()] == [(1, "x", True), (2, "y", False)]
    assert copies.exact_copies(df.limit(0)).collect() == []


def test_copies_of_long_texts(spark):
    long = "".join(chr(97 + i * i % 26) for i in range(100_000)) * 30
    rows = [(1, long), (2, long), (3, long + "x"), (4, "x" + long), (5, long[:-1])]
    assert copied(spark.createDataFrame(rows, "doc_id long, text string")) == brute_copies(rows)


def test_copies_use_no_python(spark):
    plan = copies.copy_report(spark.createDataFrame([(1, "a")], "doc_id long, text string"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan and "BroadcastNestedLoop" not in plan


# -- 13: conversation repair


def every_repair(rows):
    """The cheapest edits of (initial, fresh, truncated, n) rows of all there are, by trying them."""
    turns = [x for i, fresh, cut, n in rows for x in [(i, fresh, cut)] + [(i, False, False)] * (n - 1)]
    best = None

    def go(k, roles, cost, edits):
        nonlocal best
        for new in ("", "u", "a", "ua", "au"):
            c, e, r = cost + 3 * len(new), edits + "I" * len(new), roles + new
            if best and c > best[0]:
                continue
            if k == len(turns):
                if re.fullmatch("(s?(ua)+)?", r) and (best is None or (c, e) < best):
                    best = (c, e)
                continue
            initial, fresh, cut = turns[k]
            go(k + 1, r, c + 4, e + "D")
            for role, edit, more in ((initial, "K", 0), ("u", "R", 3), ("a", "R", 3)) if fresh else ():
                if role and re.match("^s?(ua)*u?$", r + role):
                    go(k + 1, r + role, c + more + 3 * cut, e + edit)

    go(0, "", 0, "")
    return best


def test_edits_are_the_cheapest_and_first_of_all():
    r = random.Random(5)
    for _ in range(400):
        rows = [(r.choice("suauaux") if r.random() < 0.95 else "", r.random() < 0.8, r.random() < 0.3, r.choice([1, 1, 1, 2])) for _ in range(r.randint(1, 4))]
        rows = [(i, f, c and f, n) for i, f, c, n in rows]
        cut = r.randint(0, len(rows))
        frame = pd.DataFrame([("k", int(k >= cut), k, *x) for k, x in enumerate(rows)], columns=["key", "seg", "place", "initial", "fresh", "truncated", "n"])
        out = pd.concat(list(conversations.joined(conversations.solved(iter([frame])))))
        last = out.iloc[-1]
        assert (last["cost"], last["audit"]) == every_repair(rows)
        assert ("".join(out["part"]) + last["tail"]).upper() == last["audit"]


def plain_report(table):
    """Turn by turn, with the text of what is left beside the edits."""
    by = collections.defaultdict(list)
    for c, t, role, text in table:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        rows = by[c]
        if kind == 1:
            text = ""
        if kind == 2:
            text = re.sub("[.!?]", "", text)
        if kind == 4:
            role = "user"
        rows += [(t, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    out = []
    follow = {"": {"s": "", "u": "", "a": "u"}, "s": {"u": "", "a": "u"}, "u": {"u": "a", "a": ""}, "a": {"u": "", "a": "u"}}
    name = {"u": "user", "a": "assistant"}
    for c, rows in by.items():
        rows.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2]))
        turns = [x[0] for x in rows if x[0] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
        seen, faults, states = set(), collections.Counter(), {"": (0, "", ())}
        for _, role, text in rows:
            bare = text.strip(SPACE)
            fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else ""
            seen.add((role, text))
            faults[fault] += 1
            new = {x: (n + 4, e + "D", ls) for x, (n, e, ls) in states.items()}
            for before, (n, e, ls) in states.items() if fault in ("", "truncated") else ():
                for to, edit, more in ((role[:1], "K", 0), ("u", "R", 3), ("a", "R", 3)):
                    if to in follow[before]:
                        add = follow[before][to]
                        said = role if edit == "K" else name[to]
                        option = (n + more + 3 * len(add) + 3 * (fault == "truncated"), e + "I" * len(add) + edit, (*ls, *(f"{name[x]}:" for x in add), f"{said}:{text}"))
                        if to not in new or option[:2] < new[to][:2]:
                            new[to] = option
            states = new
        ends = {"": "", "s": "ua", "u": "a", "a": ""}
        cost, audit, lines = min((n + 3 * len(ends[x]), e + "I" * len(ends[x]), (*ls, *(f"{name[y]}:" for y in ends[x]))) for x, (n, e, ls) in states.items())
        out.append((c, gaps, faults["blank"], faults["duplicate"], faults["truncated"], illegal, cost, audit, sha("\n".join(lines))))
    return sorted(map(repr, out))


REPAIR_COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
CONVERSATION = "conv_id long, turn long, role string, text string"


def reported(df):
    return sorted(repr(tuple(r)) for r in conversations.repair_report(df).select(REPAIR_COLUMNS).collect())


def odd_turns(n=60, seed=2):
    r = random.Random(seed)
    roles, texts = ["system", "user", "assistant", "user", "assistant", "tool", "", None], ["Hi.", "So?", "no end", "", " \n", None, "a .", "Yes! \n", "ğ."]
    rows = [(r.choice([None, *range(n)]), r.choice([None, *range(8)]), r.choice(roles), r.choice(texts) if r.random() < 0.5 else f"text {r.random()}{r.choice(['.', ''])}") for _ in range(6 * n)]
    return rows + rows[: n // 2] + [(1000 + i, 0, "user", "Hi.") for i in range(60)]  # of which some lose their only row


def test_repair_of_odd_turns(spark):
    rows = odd_turns()
    assert reported(spark.createDataFrame(rows, CONVERSATION)) == plain_report(rows)


def test_repair_of_a_conversation_of_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(conversations, "BLOCK_BITS", 3)
    r = random.Random(4)
    rows = [(7, i // 2 if i % 5 else i, r.choice(["user", "assistant", "system", "tool"]), r.choice(["same.", f"t{i}.", f"t{i}", ""])) for i in range(700)] + odd_turns(20, 9)
    assert reported(spark.createDataFrame(rows, CONVERSATION)) == plain_report(rows)


def test_repair_of_extremes_and_empty_tables(spark):
    rows = [(1, -(2**63), "user", "a."), (1, 2**63 - 1, "assistant", "b."), (2, None, "user", "x" * 3_000_000 + "."), (2, 1, "assistant", "y.")]
    df = spark.createDataFrame(rows, CONVERSATION).withColumn("Key", F.lit("old")).withColumn("n", F.lit("old"))
    got = {r.conv_id: r for r in conversations.repair(df)[1].collect()}
    assert got[1].gaps is None and got[2].audit == "KK" and len(reported(df)) == 2
    assert conversations.repair_report(df.limit(0)).collect() == []


def test_repaired_turns_are_legal(spark):
    turns, _ = conversations.repair(spark.createDataFrame(odd_turns(), CONVERSATION))
    by = collections.defaultdict(list)
    for r in turns.collect():
        by[r.key].append((r.place, r.step, r.role, r.text))
    assert by
    for rows in by.values():
        assert re.fullmatch("s?(ua)+", "".join(r[2][:1] for r in sorted(rows)))
        assert all(r[3].strip(SPACE) or r[1] != 1 for r in rows)


@here
def test_repair_query_equals_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = sorted(repr(tuple(r[c] for c in REPAIR_COLUMNS)) for r in queries.op13_conversation_repair(spark, SF).collect())
    assert set(plain_report(rows)) <= set(got) and len(got) == 100


# -- in SQL


def test_sql_of_odd_rows(spark):
    """The queries' SQL says the same of rows that the test tables don't have."""
    con = pytest.importorskip("duckdb").connect()
    docs = [(i if i % 9 else None, t) for i, t in enumerate([*odd_texts(), "one two " * 20, "a b c d e f " * 2, *(f"u v w x y z {i} " * 3 for i in range(40))])] + [(7, "x y"), (7, "x y")]
    turns = odd_turns(30, 3)
    con.register("documents", pd.DataFrame(docs, columns=["doc_id", "text"]).astype({"doc_id": "Int64"}))
    con.register("conversations", pd.DataFrame(turns, columns=["conv_id", "turn", "role", "text"]).astype({"conv_id": "Int64", "turn": "Int64"}))
    for name, sql, got in (
        ("runs", runs.RUNS_SQL, runs.run_report(spark.createDataFrame(docs, "doc_id long, text string"))),
        ("copies", copies.COPIES_SQL, copies.copy_report(spark.createDataFrame(docs, "doc_id long, text string"))),
        ("repair", conversations.REPAIR_SQL, conversations.repair_report(spark.createDataFrame(turns, CONVERSATION))),
    ):
        theirs = con.execute(sql).fetchall()
        columns = [d[0] for d in con.description]
        assert set(columns) == set(got.columns), name
        assert sorted(repr(tuple(r[c] for c in columns)) for r in got.collect()) == sorted(map(repr, theirs)), name
