"""Conversation repair, the prefix table and periodic runs against plain recomputations."""

import hashlib
import heapq
import random
import re
import zlib

import numpy as np
import pytest

from sondage.llm import periodicity, prefixtable, queries, turns

from . import edge

SMALL = "/root/testdata/sf0.001"
GAP = re.compile("[ \t\n\x0b\x0c\r]+")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def words_of(text):
    return [w for w in GAP.split(text or "") if w]


# ------------------------------------------------------------------ conversations


def plain_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind == 0:
            continue
        if kind == 1:
            text = ""
        if kind == 2:
            text = re.sub("[.!?]", "", text)
        if kind == 4:
            role = "user"
        out += [(conv, turn, role, text)] * (2 if kind == 3 else 1)
    return out


def cheapest(rows):
    """(cost, edits, repaired) by best-first search over all edit strings: least cost, then least string."""
    n = len(rows)
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, edits, i, roles, lines = heapq.heappop(heap)
        if i == n and re.fullmatch("(s?(ua)+)?", roles):
            return cost, edits, lines
        state = (i, roles[-1:] if len(roles) != 1 or roles != "s" else "S")
        if state in done:
            continue
        done.add(state)
        last = roles[-1:]
        other = "a" if last == "u" else "u"
        name = {"u": "user", "a": "assistant"}[other]
        heapq.heappush(heap, (cost + 3, edits + "I", i, roles + other, (*lines, name + ":")))
        if i < n:
            role, text, fault = rows[i]
            heapq.heappush(heap, (cost + 4, edits + "D", i + 1, roles, lines))
            if fault in ("", "truncated"):
                more = 3 if fault else 0
                if role[:1] == other or (role[:1] == "s" and not roles):
                    heapq.heappush(heap, (cost + more, edits + "K", i + 1, roles + role[:1], (*lines, f"{role}:{text}")))
                heapq.heappush(heap, (cost + more + 3, edits + "R", i + 1, roles + other, (*lines, f"{name}:{text}")))
    raise AssertionError


def plain_report(rows):
    out = {r[0]: (0, 0, 0, 0, 0, 0, "", sha("")) for r in rows}
    by = {}
    for conv, turn, role, text in plain_damage(rows):
        by.setdefault(conv, []).append((turn, role, text))
    for conv, turns_ in by.items():
        turns_.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        seen, judged = set(), []
        for _, role, text in turns_:
            core = text.strip("\t\n\x0b\x0c\r ")
            fault = "blank" if not core else "duplicate" if (role, text) in seen else "truncated" if core[-1] not in ".!?" else ""
            seen.add((role, text))
            judged.append((role, text, fault))
        numbers = [t for t, _, _ in turns_ if t is not None]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(judged, judged[1:]))
        cost, edits, lines = cheapest(judged)
        counts = [sum(f == k for _, _, f in judged) for k in ("blank", "duplicate", "truncated")]
        out[conv] = (gaps, *counts, illegal, cost, edits, sha("\n".join(lines)))
    return out


COLUMNS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def check_conversations(spark, rows, schema="conv_id long, turn long, role string, text string, conv string, place int, `a.b` string", more=("x", 1, "y")):
    df = spark.createDataFrame([(*r, *more) for r in rows], schema).repartition(3)
    got = {r["conv_id"]: tuple(r[c] for c in COLUMNS) for r in turns.report(turns.damaged(df), every=df).collect()}
    assert got == plain_report(rows)


def test_conversations_against_search(spark):
    random.seed(5)
    texts = ["Yes.", "No!", "so it goes", " ", "", "a. \n", "What?", "end.\x0b", " ", None, "trailing  "]
    roles = ["user", "assistant", "system", "tool", "", None, "User"]
    rows = [(c, t, random.choices(roles, [6, 6, 2, 1, 1, 1, 1])[0], random.choice(texts)) for c in range(400) for t in range(random.randrange(9))]
    rows += [(None, None, "user", "No id."), (None, 3, "assistant", "Fine."), (900, None, "user", "Hm"), (901, 2, "user", "x" * 200_000), (902, -(2**62), "user", "far."), (902, 2**61, "assistant", "far.")]
    rows += [(903, 1, "user", "same."), (903, 1, "user", "same."), (903, 1, "assistant", "tie."), (903, 1, "assistant", "a tie.")]
    check_conversations(spark, rows)


def test_conversations_empty_and_all_dropped(spark):
    schema = "conv_id long, turn long, role string, text string"
    empty = spark.createDataFrame([], schema)
    assert turns.report(turns.damaged(empty), every=empty).count() == 0
    dropped = [c for c in range(400) if zlib.crc32(f"{c}:0".encode()) % 20 == 0]
    check_conversations(spark, [(c, 0, "user", "Gone.") for c in dropped], schema, ())


def test_giant_conversation_over_many_batches(spark, monkeypatch):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        random.seed(6)
        rows = [(1, t, random.choice(["user", "assistant", "system"]), random.choice(["a.", "b", f"{t}!", ""])) for t in range(300)] + [(2, 0, "user", "Q?")]
        check_conversations(spark, rows, "conv_id long, turn long, role string, text string", ())
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_repaired_rows_match_the_report(spark):
    df = turns.damaged(spark.read.parquet(f"{SMALL}/conversations.parquet"))
    edits = turns.repair(df).toPandas().sort_values(["conv_id", "place"])
    for row in turns.report(df).collect():
        mine = edits[edits["conv_id"] == row["conv_id"]]
        assert "".join(mine["edit"]) == row["audit"] and list(mine["place"]) == list(range(len(mine)))
        kept = mine[mine["edit"] != "D"]
        assert sha("\n".join(f"{r}:{t}" for r, t in zip(kept["role"], kept["text"]))) == row["repaired_sha256"]
        assert re.fullmatch("(s?(ua)+)?", "".join(r[0] for r in kept["role"]))


def test_conversation_query_on_the_whole_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = {r["conv_id"]: tuple(r[c] for c in COLUMNS) for r in queries.op11_conversation_structure_repair(spark, SMALL).collect()}
    assert got == plain_report(rows)


# ------------------------------------------------------------------ prefix table


@pytest.fixture(scope="module")
def model():
    import public_tokenizers
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    return path, sentencepiece.SentencePieceProcessor(model_file=path)


def test_prefix_table_against_the_library(model):
    path, library = model
    table = prefixtable.PrefixTable(path)
    random.seed(7)
    alphabets = ["ab ▁\n", "    a\t", "abcdefgh ", "éàü漢字 😀\x00", "aaeeiinnoorrsstt  ", "01 .,-\n\r　​"]
    texts = ["", " ", " " * 3000, "a" * 3000, "▁ " * 300, "</s><0x41> <unk>", "x﻿"]
    texts += ["".join(random.choice(a) for _ in range(random.randrange(60))) for a in alphabets for _ in range(500)]
    for t in texts:
        ids = library.encode(t, add_eos=True)
        assert list(table.encode(t)) == ids and table.decode(ids) == library.decode(ids), t
    for _ in range(2000):
        ids = [random.randrange(random.choice([300, 32_000])) for _ in range(random.randrange(12))]
        assert table.decode(ids) == library.decode(ids), ids


def test_prefix_table_without_cuts_and_with_little_memory(model, monkeypatch):
    path, library = model
    monkeypatch.setattr(prefixtable, "REMEMBERED", 5)
    table = prefixtable.PrefixTable(path)
    text = "The quick  brown fox\njumps over thirteen lazy dogs, isn't it?   " * 3
    want = library.encode(text, add_eos=True)
    assert list(table.encode(text)) == want
    table.cuts_at_spaces = False
    assert list(table.encode(text)) == want


def test_encode_rows(spark, model):
    path, library = model
    got = [(r["doc_id"], list(r["ids"]), r["text"]) for r in prefixtable.encode(edge.table(spark), path, decoded=True).collect()]
    want = []
    for row in edge.rows():
        ids = library.encode(row[1] or "", add_eos=True)
        want.append((row[0], ids, library.decode(ids)))
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert prefixtable.encode(edge.empty(spark), path).count() == 0
    df = spark.createDataFrame([("a", [1, 2]), ("b", None), ("c", [])], "`k.k` string, ids array<int>")
    assert {r[0]: r[1] for r in prefixtable.decode(df.withColumnRenamed("k.k", "k"), path, key="k").collect()} == {"a": "", "b": "", "c": ""}


def test_codec_query_on_the_whole_table(spark, model):
    _, library = model
    want = {}
    for doc_id, text in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect():
        ids = library.encode(text or "", add_eos=True)
        want[doc_id] = (len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids)))
    got = {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in queries.op12_sentencepiece_codec(spark, SMALL).collect()}
    assert got == want


# ------------------------------------------------------------------ runs


def plain_lyndon(word):
    out = []
    for i in range(len(word)):
        j = i + 1
        while j < len(word) and word[j:] >= word[i:]:
            j += 1
        out.append(j - i)
    return out


def plain_runs(word, least, power):
    n, out = len(word), []
    for q in range(1, n // power + 1):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and word[j] == word[j + q]:
                j += 1
            part = word[i : j + q]
            if j > i and len(part) >= max(least, power * q) and not any(part[d:] == part[:-d] for d in range(1, q)):
                out.append((i, len(part), q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def test_lyndon_arrays():
    random.seed(8)
    for _ in range(1500):
        word = [random.randrange(random.randint(1, 3)) for _ in range(random.randrange(40))]
        assert periodicity.lyndon_array(word) == plain_lyndon(word)
    n = 50_000
    assert periodicity.lyndon_array([0] * n) == [1] * n and periodicity.lyndon_array(list(range(n)))[0] == n


@pytest.mark.parametrize("least,power", [(6, 4), (2, 2), (3, 3)])
def test_runs(least, power):
    random.seed(9)
    for _ in range(500):
        texts = []
        for _ in range(random.randint(1, 4)):
            word = [random.randrange(random.randint(1, 4)) for _ in range(random.randrange(60))]
            if word and random.random() < 0.5:
                a, p = random.randrange(len(word)), random.randint(1, 6)
                word = [w if i < a else word[a + (i - a) % min(p, len(word) - a)] for i, w in enumerate(word)]
            texts.append(word)
        bounds = np.cumsum([0] + [len(t) for t in texts])
        got = periodicity.runs(np.array(sum(texts, []), dtype=np.uint64), bounds, least, power).tolist()
        assert got == [[bounds[i] + s, n, q] for i, t in enumerate(texts) for s, n, q in plain_runs(t, least, power)]


def plain_digest(doc_id, text):
    words = words_of(text)
    n = len(words)
    h = zlib.crc32(str("" if doc_id is None else doc_id).encode())
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    found = plain_runs(words, 6, 4)
    best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
    dropped = {i for s, length, q in found for i in range(s + q, s + length)}
    listed = "".join(f"{s},{length},{q}\n" for s, length, q in found)
    kept = " ".join(w for i, w in enumerate(words) if i not in dropped)
    return (len(found), *(best or (None,) * 3), best and 1000 * best[1] // best[2], sha(listed), sha(kept))


def test_run_query_against_plain_search(spark, tmp_path):
    """All rows of the small table but its longest texts, which the plain search has no time for, hard rows and periodic ones."""
    random.seed(10)
    docs = [(r[0], r[1]) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect() if len(words_of(r[1])) < 1500]
    docs += [(r[0], r[1]) for r in edge.rows() if len(words_of(r[1])) < 1500]
    base = 10_000
    for i in range(300):
        unit = [random.choice("a b c d e".split()) for _ in range(random.randint(1, 9))]
        docs.append((base + i, " \t".join([random.choice("xyz") for _ in range(random.randrange(5))] + unit * random.randint(1, 9) + unit[: random.randrange(4)])))
    spark.createDataFrame([(d, t, 1) for d, t in docs], "doc_id long, text string, runs int").repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    columns = ["n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    got = sorted((str(r["doc_id"]), *[str(r[c]) for c in columns]) for r in queries.op13_periodic_runs(spark, str(tmp_path)).collect())
    assert got == sorted((str(d), *map(str, plain_digest(d, t))) for d, t in docs)


def test_long_periodic_texts_and_empty_table(spark):
    unit = [f"w{i}" for i in range(700)]
    docs = [(3, " ".join(["a"] * 60_000)), (4, " ".join(unit * 50)), (5, " ".join(["a", "b"] * 20_000 + ["c"] + ["b", "a"] * 20_000))]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r["doc_id"]: ([tuple(x) for x in r["runs"]], r["text"]) for r in periodicity.collapse(df).collect()}
    assert got[3] == ([(0, 60_000, 1)], "a")
    assert got[4] == ([(0, 35_000, 700)], " ".join(unit))
    assert got[5] == ([(0, 40_000, 2), (40_001, 40_000, 2)], "a b c b a")
    assert periodicity.collapse(edge.empty(spark)).count() == 0
