"""Near copies, repeated passages and packing against plain one-machine versions."""

import hashlib
import bisect
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from hypothesis import given, settings as hyp, strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sondage.llm import packing, queries, simhash, substring
from sondage.llm.common import Words
from tests.conftest import SMALL
from tests.llm import edge

public_tokenizers = pytest.importorskip("public_tokenizers")
VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


def plain_fingerprint(text, k=4):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    grams = [b" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))]
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_classes(codes, radius):
    group = list(range(len(codes)))
    for i in range(len(codes)):
        for j in range(i):
            if (codes[i] ^ codes[j]).bit_count() <= radius and group[i] != group[j]:
                a, b = group[i], group[j]
                group = [b if g == a else g for g in group]
    return group


def test_simhash_on_edge_rows(spark):
    got = simhash.near_duplicates(edge.table(spark)).collect()
    rows = edge.rows()
    assert len(got) == len(rows)
    codes = [plain_fingerprint(r[1]) for r in rows]
    group = plain_classes(codes, 4)
    least = {}
    for g, r in zip(group, rows):
        least[g] = min([x for x in (least.get(g), r[0]) if x is not None], default=None)
    want = Counter((r[0], c, least[g]) for r, c, g in zip(rows, codes, group))
    assert Counter((r.doc_id, r.fp % (1 << 64), r.component_id) for r in got) == want
    assert simhash.near_duplicates(edge.empty(spark)).count() == 0


def test_simhash_keeps_one_of_each_class(spark):
    kept = simhash.keep_first(edge.table(spark))
    assert kept.columns == edge.table(spark).columns
    ids = sorted(str(r.doc_id) for r in kept.collect())
    assert len(ids) == len(set(ids)) and "5" not in ids and "10" not in ids and {"4", "3", "1"} <= set(ids) and "2" not in ids


@pytest.mark.parametrize("radius,n", [(0, 10), (2, 10**5), (4, 100), (4, 10**7), (4, 10**10)])
def test_masks_miss_no_close_codes(radius, n):
    masks = simhash.masks(radius, n)
    rng = np.random.default_rng(1)
    for _ in range(300):
        flips = sum(1 << int(b) for b in rng.choice(64, radius, replace=False))
        assert any(not flips & m for m in masks)


@hyp(max_examples=30, deadline=None)
@given(st.lists(st.integers(0, 2**12 - 1), min_size=1, max_size=60, unique=True), st.integers(0, 4))
def test_bk_tree_finds_the_classes_of_all_pairs(values, radius):
    codes = np.array(sorted(values), dtype=np.uint64) * np.uint64(0x1000000001)
    label = simhash.bk_labels(codes, radius)
    group = plain_classes([int(c) for c in codes], radius)
    assert len(set(zip(label.tolist(), group))) == len(set(group)) == len(set(label.tolist()))


def test_hot_shards_are_cut_without_losing_links(spark):
    rng = np.random.default_rng(0)
    fp = [int(x) for x in rng.integers(0, 1 << 9, 400)]
    codes = spark.createDataFrame([(x,) for x in sorted(set(fp))], "fp long")
    whole = {tuple(r) for r in simhash.components(simhash.links(codes, 2)).collect()}
    cut = {tuple(r) for r in simhash.components(simhash.links(codes, 2, most=20)).collect()}
    assert whole == cut


def plain_wide(text, shingle=5):
    words = (text or "").encode().lower().split()
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + shingle]), 42) for i in range(max(len(words) - shingle + 1, min(len(words), 1)))]
    out = []
    for w in range(simhash.WIDE):
        own = hashes if w == 0 else [int(x) for x in simhash.scramble(np.array([(h + w * 0x9E3779B97F4A7C15) % (1 << 64) for h in hashes], dtype=np.uint64))]
        out.append(sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in own) > len(own)))
    return out


def test_wide_fingerprints_match_plain_ones():
    for text in ["", " \t", "one", "A b c d e", "the quick brown fox jumps over the lazy dog again " * 3]:
        assert simhash.wide_fingerprint(text.encode()).tolist() == plain_wide(text)


@pytest.mark.parametrize("leaf", [4, 2_048])
def test_wide_tree_finds_the_classes_of_all_pairs(monkeypatch, leaf):
    monkeypatch.setattr(simhash, "_LEAF", leaf)
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, (12, simhash.WIDE)).astype(np.uint64)
    codes = np.unique(np.concatenate([base ^ (np.uint64(1) << rng.integers(0, 64, (12, simhash.WIDE)).astype(np.uint64)) for _ in range(15)]), axis=0)
    whole = [sum(int(x) << (64 * i) for i, x in enumerate(c)) for c in codes]
    for radius in (2, 5, 8):
        label, group = simhash.wide_labels(codes, radius), plain_classes(whole, radius)
        assert len(set(zip(label.tolist(), group))) == len(set(group)) == len(set(label.tolist()))
    ends = np.array([[0] * 4, [(1 << 64) - 1] * 4], dtype=np.uint64)
    assert simhash.wide_labels(ends, 42).tolist() == [0, 1]


def test_similar_documents_are_kept_once(spark):
    rng = np.random.default_rng(9)
    words = [f"word{i}" for i in range(3_000)]
    rows, near, clean = [], set(), set()
    for k in range(300):
        text = rng.choice(words, 250).tolist()
        rows.append((10 * k, " ".join(text)))
        clean.add(10 * k)
        for c in (1, 2):
            other = list(text)
            for at in rng.choice(250, c, replace=False):  # one or two words changed: 0.96 to 0.92 of the shingles stay
                other[at] = "changed"
            rows.append((10 * k + c, " ".join(other)))
            near.add(10 * k + c)
        half = text[:125] + rng.choice(words, 125).tolist()  # a third of all shingles in common
        rows.append((10 * k + 5, " ".join(half)))
        clean.add(10 * k + 5)
    kept = {r.doc_id for r in simhash.keep_similar_first(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert clean <= kept and len(near & kept) <= 0.03 * len(near)


def test_similar_documents_on_edge_rows_and_clashing_names(spark):
    names = ["_keep_id", "_cut", "_quality", "w0", "fp", "bucket", "row", "kept", "keep_id"]
    docs = edge.table(spark).select("*", *[F.lit(i).alias(n) for i, n in enumerate(names)  if n != "fp"])
    for step in (simhash.keep_similar_first, simhash.keep_first, substring.strip_repeats):
        out = step(docs)
        assert out.columns == docs.columns and out.count() > 0
        assert out.select(*[n for n in names if n != "fp"]).distinct().count() == 1
        assert step(docs.limit(0)).count() == 0
    ids = sorted(str(r.doc_id) for r in simhash.keep_similar_first(docs).collect())
    assert len(ids) == len(set(ids)) and "5" not in ids and "10" not in ids and "2" not in ids


def plain_repeats(rows, size=20):
    first, out = {}, []
    key = lambda i: -(1 << 63) if i is None else i
    split = [(key(i), (t or "").encode().split()) for i, t in rows]
    for i, w in split:
        for s in range(len(w) - size + 1):
            k = tuple(w[s : s + size])
            first[k] = min(first.get(k, (i, s)), (i, s))
    for (i, w), (raw, _) in zip(split, rows):
        gone = set()
        for s in range(len(w) - size + 1):
            if first[tuple(w[s : s + size])] < (i, s):
                gone.update(range(s, s + size))
        kept = [x for k, x in enumerate(w) if k not in gone]
        out.append((raw, len(w), len(gone), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return Counter(out)


def test_repeats_on_edge_rows(spark):
    got = substring.without_repeats(edge.table(spark))
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got.collect()) == plain_repeats([r[:2] for r in edge.rows()])
    assert substring.without_repeats(edge.empty(spark)).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_repeats_on_shuffled_passages(spark, seed):
    rng = np.random.default_rng(seed)
    base = [[f"{p}.{i}" for i in range(rng.integers(25, 90))] for p in range(6)]
    rows = []
    for i in range(60):
        words = []
        for _ in range(rng.integers(1, 5)):
            p = base[rng.integers(6)]
            a = rng.integers(0, 15)
            words += p[a : a + rng.integers(15, 80)] + ([f"own{i}"] if rng.random() < 0.6 else [])
        if rng.random() < 0.3:
            words[rng.integers(len(words))] = "edit"
        rows.append((int(rng.permutation(200)[0]) * 100 + i, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = substring.without_repeats(df, texts=False)
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got.collect()) == plain_repeats(rows)


def test_strip_repeats_keeps_columns_and_untouched_texts(spark):
    df = edge.table(spark)
    out = substring.strip_repeats(df)
    assert out.columns == df.columns
    got = {r.doc_id: r for r in out.collect()}
    assert 10 not in got and got[3].text == edge.LONG and got[8].text == " \t\n " and got[1].text is None
    assert got[6].text == "start middle end" and got[6].n_chars == 16
    assert substring.strip_repeats(edge.empty(spark)).count() == 0


@given(st.lists(st.text(alphabet="ab \t\né\u00a0", max_size=12), max_size=8))
@hyp(max_examples=50, deadline=None)
def test_words_are_those_of_split(texts):
    raw = [t.encode() for t in texts]
    offsets = np.cumsum([0, *map(len, raw)])
    words = Words(np.frombuffer(b"".join(raw), dtype=np.uint8), offsets)
    data = b"".join(raw)
    spans = [data[a:z] for a, z in zip(words.starts, words.ends)]
    assert [spans[a:z] for a, z in zip(words.bounds, words.bounds[1:])] == [t.split() for t in raw]
    h = words.hashes()
    assert len(set(h.tolist())) == len(set(spans))


def check_packing(rows, got, size=2048):
    tok = Tokenizer.from_file(VOCABULARY)
    want = Counter()
    for i, t in rows:
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 0], dtype="<u4")
        for k in range(0, len(ids), size):
            want[i, k // size, k, len(ids[k : k + size]), zlib.crc32(ids[k : k + size].tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    sequences = {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= size
    return len(sequences), -(-sum(r.length for r in got) // size)


def test_packing_on_edge_rows(spark):
    check_packing([r[:2] for r in edge.rows()], packing.pack(edge.table(spark), VOCABULARY).collect())
    assert packing.pack(edge.empty(spark), VOCABULARY).count() == 0


def test_packing_of_documents_reaches_the_bound(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    used, bound = check_packing(rows, queries.QUERIES["op5_best_fit_packing"](spark, SMALL).collect())
    assert used <= bound + 1


def test_packing_returns_the_tokens(spark):
    df = spark.createDataFrame([(1, "the cat sat"), (2, "a " * 50)], "doc_id long, text string")
    got = packing.pack(df, VOCABULARY, size=16, ids=True).collect()
    assert all(len(r.ids) == r.length and zlib.crc32(np.array(r.ids, dtype="<u4").tobytes()) == r.ids_crc32 for r in got)


@hyp(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 64), min_size=1, max_size=60))
def test_plan_uses_every_piece_once(lengths):
    histogram = Counter(lengths)
    made = packing.plan(dict(histogram), 64)
    used = Counter()
    for own, times in made:
        assert sum(own) <= 64 and times > 0
        for n in own:
            used[n] += times
    assert used == histogram
    assert sum(t for _, t in made) <= greedy(lengths, 64)


def greedy(lengths, size):
    """Sequences that best-fit decreasing needs, piece by piece."""
    rooms = []
    for n in sorted(lengths, reverse=True):
        i = bisect.bisect_left(rooms, n)
        room = rooms.pop(i) if i < len(rooms) else size
        bisect.insort(rooms, room - n)
    return len(rooms)


@hyp(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 64), min_size=1, max_size=200))
def test_best_fit_over_the_histogram(lengths):
    made = packing.best_fit(dict(Counter(lengths)), 64)
    used = Counter()
    for own, times in made:
        assert sum(own) <= 64 and times > 0
        used.update({n: k * times for n, k in Counter(own).items()})
    assert used == Counter(lengths) and sum(t for _, t in made) == greedy(lengths, 64)


def test_dominated_fillings():
    left = {5: 1, 3: 2, 2: 1, 9: 1}
    assert packing.dominated([(3, 1)], left, [2, 3, 5, 9], 2)  # the 2 fits in besides
    assert packing.dominated([(3, 1), (2, 1)], left, [2, 3, 5, 9], 0)  # the 5 does as well as 3 and 2
    assert not packing.dominated([(5, 1)], left, [2, 3, 5, 9], 0)
    assert packing.dominated([(3, 2)], {3: 2, 7: 1}, [3, 7], 1)
    assert not packing.dominated([(3, 2)], {3: 2, 5: 1}, [3, 5], 1)


@pytest.mark.parametrize("histogram", [{1: 3000}, {1: 5000, 3: 4000, 700: 9}, {2048: 3, 1: 1}, {}])
def test_plans_of_many_short_pieces(histogram):
    made = packing.plan(histogram, 2048)
    used = Counter()
    for own, times in made:
        assert sum(own) <= 2048
        used.update({n: k * times for n, k in Counter(own).items()})
    assert used == Counter(histogram) and sum(t for _, t in made) == packing.least_bins(histogram, 2048)


def test_plans_never_need_more_than_best_fit():
    for low, high, n, seed in ((500, 1100, 3000, 1), (300, 700, 2000, 2), (1, 2048, 2500, 3), (600, 700, 1500, 4)):
        rng = random.Random(seed)
        lengths = [rng.randint(low, high) for _ in range(n)]
        made = packing.plan(dict(Counter(lengths)), 2048)
        used, best = sum(t for _, t in made), greedy(lengths, 2048)
        assert packing.least_bins(Counter(lengths), 2048) <= used <= best


def test_packing_of_five_thousand_empty_texts(spark):
    rows = [(i, None if i % 2 else "") for i in range(5000)] + [(5000, "the cat sat " * 900)]
    used, bound = check_packing(rows, packing.pack(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), VOCABULARY).collect())
    assert used == bound


def test_a_text_of_more_words_than_are_remembered(monkeypatch):
    monkeypatch.setattr(packing, "REMEMBERED", 50)
    known = packing.WordTokens(VOCABULARY)
    texts = ["some words that come first", " ".join(f"w{i}x some" for i in range(200)), "words after the long text"]
    for text in texts:
        data = np.frombuffer(text.encode(), dtype=np.uint8)
        ids, bounds = known.ids(data, np.array([0, len(data)]), 0)
        assert ids.tolist() == [*known.whole(text.encode()).tolist(), 0] and bounds.tolist() == [0, len(ids)]


def test_plain_words_go_to_the_tokenizer_together():
    rng = random.Random(3)
    texts = [" ".join("".join(rng.choices("abcdeßéñÉÀ", k=rng.randint(1, 9))) + "".join(rng.choices(".,!?$*", k=rng.randint(0, 2))) for _ in range(400)) for _ in range(5)] + ["", "... Ab, ab"]
    known = packing.WordTokens(VOCABULARY)
    want = [known.whole(t.encode()).tolist() for t in texts]
    calls, bare = [], known.bare

    class Counted:
        def encode_batch_fast(self, given, **more):
            calls.append(len(given))
            return bare.encode_batch_fast(given, **more)

    known.bare, known.tokenizer = Counted(), None  # words of plain letters and signs need no reading one by one
    data = np.frombuffer("".join(texts).encode(), dtype=np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(t.encode()) for t in texts])])
    ids, bounds = known.ids(data, offsets, 0)
    assert [ids[a : z - 1].tolist() for a, z in zip(bounds, bounds[1:])] == want
    parts = {p for t in texts for w in t.split() for p in (w.rstrip(".,!?$*").encode(), w[len(w.rstrip(".,!?$*")) :].encode()) if p}
    assert sum(calls) <= -(-len(parts) // packing.TOGETHER) < len(parts) / 10


def test_other_words_are_read_as_the_tokenizer_reads_them():
    texts = ["it's 2024 don't \u6f22\u5b57 a<|b x\u0301y caf\u00e9?! caf\u00e9 \u00c9T\u00c9... a!b $$$ \u00d7\u00f7 \u00aa", "", "IT'S <|endoftext|> ?", "\u00c3\u00a9 !\u00e9"]
    got = list(packing.token_ids(pa.array([t.encode() for t in texts], pa.binary()), VOCABULARY, 0))
    whole = packing.WordTokens(VOCABULARY).whole
    assert [g.tolist() for g in got] == [[*whole(t.encode()).tolist(), 0] for t in texts]
