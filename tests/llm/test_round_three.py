"""Prefix trie, repeated strings and structure repair against brute force and their DuckDB forms."""

import collections
import hashlib
import math
import random
import zlib

import duckdb
import numpy as np
import pandas as pd
import pytest

from cordon.llm import conversation_sql, prefix_trie, repair, repeats, suffixes

SCHEMA = "conv_id long, turn long, role string, text string, n long, depth int, base string, gone int, fault string, spans string"


def cells(df):
    df = df[sorted(df.columns)]
    return sorted(tuple("∅" if v is None or (not isinstance(v, str) and pd.isna(v)) else str(v).removesuffix(".0") for v in row) for row in df.itertuples(index=False))


@pytest.fixture(scope="module")
def conversations(spark):
    r = random.Random(3)
    roles, texts = ["user", "assistant", "assistant", "user", "system", None, "", "tool"], ["Hi.", "no", "", None, " \n", "What?! ", "x.y", "é! ", "Same."]
    rows = [(c, r.choice([t, t, t, None, 2]), r.choice(roles), r.choice(texts)) for c in [*range(-12, 80), None] for t in range(r.choice([0, 1, 3, 8, 12]))]
    rows += [(1000 + i, t, "user", f"x{t}") for i in range(30) for t in range(25)] + rows[:20]
    rows = [(*row, 7, 7, "b", 7, "f", "s") for row in rows]
    return spark.createDataFrame(rows, SCHEMA).repartition(4).cache()


@pytest.fixture(scope="module")
def con(conversations):
    c = duckdb.connect()
    frame = conversations.select("conv_id", "turn", "role", "text").toPandas().astype({"conv_id": "Int64", "turn": "Int64"})
    c.execute("CREATE TABLE conversations AS SELECT * FROM frame")
    return c


def nodes(rows):
    """Nodes by whole sequences, in plain Python."""
    own = collections.defaultdict(list)
    for c, t, role, text, *_ in rows:
        if c is not None:
            role, text = role or "", text or ""
            own[c].append(((t is not None, t or 0), role, hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()[:32], text))
    built = {}
    for c, turns in own.items():
        turns.sort()
        base, h = c - int(math.fmod(c, 5)), zlib.crc32(str(c).encode()) % 9
        other = sorted(own.get(base, []))
        built[c] = [(x[1], x[3]) for x in (turns if c == base else other[:h] + turns[h:])]
    members, kids = collections.defaultdict(list), collections.defaultdict(set)
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    for k in members:
        if k:
            kids[k[:-1]].add(k)
    leaves, saved = collections.Counter(), collections.Counter()
    for k, m in members.items():
        for d in range(len(k) + 1):
            leaves[k[:d]] += not kids[k]
            saved[k[:d]] += (len(m) - 1) * len(k[-1][1].encode()) if k else 0
    return sorted(((min(m), len(k), min(members[k[:-1]]) if k else None, len(m), len(kids[k]), leaves[k], saved[k],
                    hashlib.sha256(",".join(map(str, sorted(c for c in m if len(built[c]) == len(k)))).encode()).hexdigest()) for k, m in members.items()), key=str)


@pytest.mark.parametrize("width", [None, 40, 7])
def test_prefix_trie(conversations, con, width):
    got = prefix_trie.trie(conversations, width)
    assert sorted((tuple(r) for r in got.collect()), key=str) == nodes(conversations.collect())
    if width is None:
        assert cells(got.toPandas()) == cells(con.execute(conversation_sql.PREFIX_TRIE).df())
        assert prefix_trie.trie(conversations.limit(0)).count() == 0


def test_repair(conversations, con, monkeypatch):
    rows = repair.damaged(conversations)
    want = cells(con.execute(conversation_sql.REPAIR).df())
    assert cells(repair.audits(rows).toPandas()) == want
    turns = collections.defaultdict(list)
    for r in sorted(repair.repaired(rows).collect(), key=lambda r: r["position"]):
        turns[r["conv_id"]].append(f"{r['role']}:{r['text']}")
    for r in repair.audits(rows).collect():
        assert hashlib.sha256("\n".join(turns[r["conv_id"]]).encode()).hexdigest() == r["repaired_sha256"]
    assert repair.audits(rows.limit(0)).count() == 0 == repair.repaired(rows.limit(0)).count()


def least(rows, start, goals):
    """Cheapest, then least edits by dynamic programming."""
    def widened(b):
        for _ in range(3):
            for q, (c, s) in list(b.items()):
                b[repair.LEADS[q]] = min(b.get(repair.LEADS[q], (1 << 40, "")), (c + 3, s + "I"))
        return b

    best = widened({start: (0, "")})
    for initial, fault in rows:
        found = collections.defaultdict(list)
        for q, (c, s) in best.items():
            found[q].append((c + 4, s + "D"))
            if fault not in (repair.BLANK, repair.DUPLICATE):
                if initial in repair.STEP[q]:
                    found[repair.STEP[q][initial]].append((c + fault, s + "K"))
                found[repair.LEADS[q]].append((c + 3 + fault, s + "R"))
        best = widened({q: min(w) for q, w in found.items()})
    ends = [(*w, q) for q, w in best.items() if q in goals]
    return min(ends) if ends else None


def test_repair_search():
    r = random.Random(1)
    for n in [0, 1, 2, 3, 5, 9, 20]:
        for _ in range(60):
            rows = [(r.choice("suaaux "), r.choice([0, 0, 0, 1, 2, 3])) for _ in range(n)]
            for goals in [repair.ACCEPTING, *[frozenset((s,)) for s in range(4)]]:
                for start in range(4):
                    assert repair.search(rows, start, goals) == least(rows, start, goals)


def test_repair_in_blocks(monkeypatch):
    """A long conversation searched in blocks gives what one search of the whole gives."""
    r = random.Random(5)
    for n in (40, 900):
        rows = [(r.choice(["user", "assistant", "assistant", "system", "x"]), f"t{i}", r.choice([0, 0, 0, 1, 2, 3])) for i in range(n)]
        fold = repair.Fold()
        for i, row in enumerate(rows):
            monkeypatch.setattr(repair, "BLOCK", 7 if n == 40 else 256)
            fold.add(i, *row)
        gaps, *_, cost, audit, digest = fold.result()
        want = least([(role[:1], fault) for role, _, fault in rows], repair.START, repair.ACCEPTING)
        text = "\n".join(f"{role}:{text}" for _, role, text in repair.applied(audit, [x[:2] for x in rows], repair.START))
        assert gaps == 0 and (cost, audit) == want[:2] and digest == hashlib.sha256(text.encode()).hexdigest()


def test_suffix_array():
    r = random.Random(2)
    for n in [1, 2, 3, 5, 8, 20, 100]:
        for _ in range(30):
            t = np.array([r.randrange(1, r.choice([2, 3, 4, 200])) for _ in range(n - 1)] + [0])
            smaller, seeds = suffixes.kinds(t) if n > 1 else (None, None)
            assert suffixes.suffix_array(t, 256).tolist() == sorted(range(n), key=lambda i, t=t: t[i:].tolist())
            if n > 1 and len(seeds):
                ordered = np.array(sorted(seeds.tolist(), key=lambda i, t=t: t[i:].tolist()))
                assert suffixes.induced(t, 256, smaller, ordered).tolist() == suffixes.induced_singly(t, 256, smaller, ordered).tolist()
    for _ in range(100):
        pieces = [bytes(r.choice(b"ab\x00") for _ in range(r.randrange(0, 30))) for _ in range(r.randrange(1, 6))]
        seen = collections.Counter(p[i : i + 4] for p in pieces for i in range(len(p) - 3))
        assert [x.tolist() for x in suffixes.repeated_starts(pieces, 4)] == [[i for i in range(len(p) - 3) if seen[p[i : i + 4]] > 1] for p in pieces]


def without_repeats(rows, length):
    seen = collections.Counter()
    for _, text in rows:
        b = (text or "").encode()
        seen.update(b[p : p + length] for p in range(len(b) - length + 1))
    out = []
    for i, text in rows:
        b = (text or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if seen[b[p : p + length]] > 1:
                gone[p : p + length] = b"\x01" * length
        spans = sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1]))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, y in zip(b, gone, strict=True) if not y)).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("length,gram,shard,width,chunk", [(40, 10, 1 << 18, None, 1 << 20), (40, 16, 3000, None, 50), (40, 10, 200, 8, 1 << 20), (64, 64, 1 << 14, None, 1 << 20)])
def test_repeats(spark, monkeypatch, length, gram, shard, width, chunk):
    """Also where all runs go by digests (a small shard), where the screen proves nothing, and over chunk edges."""
    r = random.Random(4)
    parts = ["th", "on", "er", "ing", "é", "st", "ou", " ", "\n", ". "]

    def some(n):
        return "".join(r.choice(parts) for _ in range(n))

    common = [some(60) for _ in range(6)]
    rows = [(i, some(r.choice([0, 5, 30, 100])) + r.choice(common)[r.randrange(20) :] + some(r.choice([0, 20, 80])) + r.choice(["", r.choice(common)])) for i in range(120)]
    rows += [(200, None), (201, ""), (202, "x" * 3000), (203, "xy" * 900), (204, common[0]), (204, common[0]), (None, common[1] * 3), (205, "y" * 2500 + some(30) + "y" * 40)]
    monkeypatch.setattr(repeats, "CHUNK", chunk)
    docs = spark.createDataFrame([(*row, "k", 1, "m") for row in rows], "doc_id long, text string, key string, start int, mark string").repartition(4)
    got = repeats.removed(docs, length, gram, shard, width).cache()
    assert sorted((tuple(x) for x in got.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()), key=str) == without_repeats(rows, length)
    assert all(sum(s["end"] - s["start"] for s in x["spans"]) == x["n_removed"] and len(x["spans"]) == x["n_spans"] for x in got.collect())
    assert repeats.removed(docs.limit(0)).count() == 0
