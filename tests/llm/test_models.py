"""Language model, toxicity, quality, urls and mixing."""

import math
import re
import zlib
from collections import Counter
from types import SimpleNamespace

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sondage.llm import mixing, pitmanyor, quality, queries, toxicity, urls
from tests.conftest import SMALL
from tests.llm import edge

MEDIUM = "/root/testdata/sf0.01"


def crc(i, m):
    return zlib.crc32(b"" if i is None else str(i).encode()) % m


# ------------------------------------------------------------------ language model


def plain_base(rows):
    split = [(i, (t or "").encode().lower().split() + [None]) for i, t in rows]
    count = Counter(w for i, ws in split if crc(i, 7) != 2 for w in ws)
    n, v = sum(count.values()), len(count)
    return Counter((i, crc(i, 7) == 2, len(ws), sum(count[w] > 0 for w in ws), n, round(sum(math.log10((count[w] + 1) / (n + v + 1)) for w in ws), 6)) for i, ws in split)


def test_lm_counts_and_base(spark):
    got = pitmanyor.score(edge.table(spark)).collect()
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == plain_base([r[:2] for r in edge.rows()])
    assert all(math.isfinite(r.score) and r.score <= 0 for r in got)
    assert pitmanyor.score(edge.empty(spark)).count() == 0


def test_lm_without_training_rows(spark):
    ids = [i for i in range(200) if crc(i, 7) == 2][:3]
    got = pitmanyor.score(spark.createDataFrame([(i, "some words") for i in ids], "doc_id long, text string")).collect()
    assert [(r.score, r.base_score, r.train_tokens) for r in got] == [(0.0, 0.0, 0)] * 3


def test_lm_beats_the_base_on_held_out_texts(spark):
    rows = [r for r in queries.QUERIES["op3_lm_scoring"](spark, MEDIUM).collect() if r.held_out]
    assert sum(r.score for r in rows) > 0.9 * sum(r.base_score for r in rows)
    assert np.mean([r.score > r.base_score for r in rows]) > 0.8


def test_lm_is_a_distribution(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    corpus = pitmanyor.held(pitmanyor.packed(docs))
    words = pitmanyor.held(pitmanyor.word_rows(corpus).groupBy("h").sum("n").withColumnRenamed("sum(n)", "n"))
    m = pitmanyor.train(corpus, words, share=0.005, sweeps=3, burn=1)
    assert np.allclose((10**m.table).sum(axis=1), 1)
    core = set(m.core.view(np.int64).tolist())
    open_ = np.array([r.n for r in words.where("n > 0").collect() if r.h not in core])
    assert abs((10 ** m.of_open(open_)).sum() + 10**m.unknown - 1) < 1e-6


def trained(n, at=0):
    """Ids of training rows, or of held-out ones (at=2), the first n."""
    return [i for i in range(20 * n) if (crc(i, 7) == 2) == (at == 2)][:n]


@pytest.mark.parametrize("parts", [1, 3])
def test_lm_every_word_is_a_context_and_a_dish(spark, parts):
    # 1,500 rare words, none of a share of 1/1000, each followed by the same other rare word three times
    texts = [f"left{i} right{i}" for i in range(1500)] * 3
    ask = ["left7 right7", "left7 right8", "left1204 right1204", "left1204 right3"]
    rows = [*zip(trained(len(texts)), texts), *zip(trained(len(ask), 2), ask)]
    got = {r.doc_id: r.score for r in pitmanyor.score(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), parts=parts).collect()}
    near, far, near2, far2 = (got[i] for i in trained(len(ask), 2))
    assert near > far + 2 and near2 > far2 + 2


@pytest.mark.parametrize("parts", [1, 3])
def test_lm_of_words_that_come_once_by_hand(spark, parts):
    # every pair and every word once: one table each, so nothing is drawn; the end alone has three contexts
    texts = ["a b c", "d e", "f"]
    ask = ["b c", "q"]
    rows = [*zip(trained(3), texts), *zip(trained(2, 2), ask)]
    got = {r.doc_id: r for r in pitmanyor.score(spark.createDataFrame(rows, "doc_id long, text string"), parts=parts).collect()}
    d = 0.95  # n1 / n1 of the pairs, and of the words but the end: within 0.95
    words, tables = 7, lambda end: 6 + end

    def chain(text, end):
        base, top = 0.5 / words, 9.0  # 9 pairs of one table each
        mass = 1 + d * tables(end)
        p = lambda w: mass * 0.5 / (1 + top) if w == "q" else ((3 - d * end if w is None else 1 - d) + mass * base) / (1 + top)
        pairs = {(a, b) for t in texts for a, b in zip([0, *t.split()], [*t.split(), None])}
        seats = Counter(a for a, _ in pairs)
        return sum(math.log10(((1 - d) * ((a, b) in pairs) + (1 + d * seats[a]) * p(b)) / (1 + seats[a])) for a, b in zip([0, *text.split()], [*text.split(), None]))

    for i, t in [*zip(trained(3), texts), *zip(trained(2, 2), ask)]:
        assert min(chain(t, 1), chain(t, 3)) - 0.05 < got[i].score < max(chain(t, 1), chain(t, 3)) + 0.05


def plain_sampler(train, ask, sweeps, burn):
    """log10 probabilities of texts by a sampler that moves one customer at a time, all pairs in a dictionary."""
    draw = np.random.default_rng(5)
    split = lambda t: [*zip([0, *t.split()], [*t.split(), None])]
    n = Counter(p for t in train for p in split(t))
    seats, words = Counter(), {b for _, b in n}
    for (a, _), m in n.items():
        seats[a] += m
    contexts = Counter(b for _, b in n)
    sizes, tops = Counter(n.values()), Counter(contexts.values())
    d1, d0 = pitmanyor.discount_of(sizes[1], sizes[2]), pitmanyor.discount_of(tops[1], tops[2])
    alone1, alone0 = pitmanyor.alone_table(d1, 200), pitmanyor.alone_table(d0, 400)
    t, top = {p: 1 for p in n}, {w: 1 for w in words}
    tables, c = Counter(a for a, _ in n), Counter(b for _, b in n)
    base = 0.5 / len(words)
    parent = lambda w: (c[w] - d0 * top[w] + (1 + d0 * sum(top.values())) * base) / (1 + sum(c.values()))

    def leave(w):
        if draw.random() < alone0[c[w], top[w]]:
            top[w] -= 1
        c[w] -= 1

    def come(w):
        weight = (1 + d0 * sum(top.values())) * base
        if draw.random() < weight / (weight + max(c[w] - d0 * top[w], 0)):
            top[w] += 1
        c[w] += 1

    sums = Counter()
    for r in range(sweeps):
        for (a, b), m in n.items():
            for _ in range(m):
                if draw.random() < alone1[m, t[a, b]]:
                    t[a, b] -= 1
                    tables[a] -= 1
                    leave(b)
                weight = (1 + d1 * tables[a]) * parent(b)
                if draw.random() < weight / (weight + m - 1 - d1 * t[a, b]):
                    t[a, b] += 1
                    tables[a] += 1
                    come(b)
        if r >= burn:
            for a, b in {p for x in ask for p in split(x)}:
                sums[a, b] += (n.get((a, b), 0) - d1 * t.get((a, b), 0) + (1 + d1 * tables[a]) * parent(b)) / (1 + seats[a]) / (sweeps - burn)
    return [sum(math.log10(sums[p]) for p in split(x)) for x in ask]


@pytest.mark.parametrize("parts", [1, 4])
def test_lm_agrees_with_a_plain_sampler(spark, parts):
    draw = np.random.default_rng(3)
    names = [f"w{i}" for i in range(25)]
    share = 1 / np.arange(1, 26)
    text = lambda: " ".join(draw.choice(names, size=8, p=share / share.sum()))
    train, ask = [text() for _ in range(70)], ["w0 w1 w2", "w20 w3 w24 w24 w0", *[text() for _ in range(20)]]
    ask = [x for x in ask if set(x.split()) <= set(" ".join(train).split())]
    rows = [*zip(trained(len(train)), train), *zip(trained(len(ask), 2), ask)]
    got = {r.doc_id: r.score for r in pitmanyor.score(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), parts=parts).collect()}
    want = plain_sampler(train, ask, 60, 20)
    off = [(got[i] - w) / (len(x.split()) + 1) for i, w, x in zip(trained(len(ask), 2), want, ask)]
    assert abs(np.mean(off)) < 0.015 and max(map(abs, off)) < 0.06


def test_seating_follows_the_exact_distribution():
    # weights of t tables for 4 customers: S(4, t) x^t, from the recursion by hand
    d, x = 0.5, 0.8
    s = {1: (1 - d) * (2 - d) * (3 - d)}
    s[2] = (1 - d) * (2 - d) + (3 - 2 * d) * ((1 - d) + (2 - 2 * d))
    s[3] = ((1 - d) + (2 - 2 * d)) + (3 - 3 * d)
    s[4] = 1.0
    weight = np.array([s[t] * x**t for t in range(1, 5)])
    want = weight @ np.arange(1, 5) / weight.sum()
    n = 40_000
    c, many = np.full(n, 4), np.zeros(n)  # no dish counts towards the total, so x stays fixed
    t = pitmanyor.seat(c, np.ones(n), np.full(n, x), many, d, 1.0, 80, np.random.default_rng(0), pitmanyor.alone_table(d, 1000))
    assert abs(t.mean() - want) < 0.02


# ------------------------------------------------------------------ toxicity


@pytest.fixture(scope="module")
def letters():
    words = "loser idiot pathetic scum worthless moron trash clown disgusting stupid the of that with".split()
    pairs = Counter()
    for w in words:
        pairs.update(map("".join, zip("^" + w, w + "$")))
    return toxicity.Letters.learn(pairs)


@pytest.mark.parametrize("seen,plain", [
    ("l0ser", "loser"), ("1d10t", "idiot"), ("p4thet1c", "pathetic"), ("$cum", "scum"), ("w0rthl3ss", "worthless"), ("m.o.r.o.n", "moron"), ("tr@sh,", "trash"),
    ("clooown", "clown"), ("s-t-u-p-i-d", "stupid"), ("STUUUUPID", "stupid"), ("trash!!", "trash"), ("1234", "1234"), ("the", "the"), ("", ""),
])
def test_disguised_words_are_restored(letters, seen, plain):
    assert toxicity.plain(seen, letters) == plain


@pytest.mark.parametrize("seen,plain", [
    ("m.o.ro.n", "moron"), ("st-u-pid", "stupid"), ("st.u.pid", "stupid"), ("s__c__u__m", "scum"), ("iddiioott", "idiot"), ("the", "the"), ("with/that", "with/that"), ("pass", "pass"),
])
def test_mixed_disguises_are_restored(letters, seen, plain):
    words = {w: 5 for w in "loser idiot pathetic scum worthless moron trash clown disgusting stupid the of that with".split()}
    known = toxicity.Letters(letters.cost, letters.single, words={w: math.log(14) for w in words})
    assert toxicity.plain(seen, known) == plain
    if plain.isalpha():
        assert toxicity.plain(seen, letters) == plain


def test_pieces_between_blanks_and_mixed_disguises_score(spark):
    docs, labels = toxic_tables(spark)
    model = toxicity.learn(docs, labels)
    texts = ["so st u pid word1", "word2 stu pid", "s tu p id", "sst-uu.pid word3", "ssttuuppiidd", "it is of a st word1", "word1 word2"]
    got = toxicity.score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect()
    assert {r.doc_id for r in got if r.score >= 0.7} == {0, 1, 2, 3, 4}
    back = toxicity.restore(spark.createDataFrame([(1, "so st u pid, thing")], "doc_id long, text string"), model).first()
    assert back.restored == "so stupid thing"


def toxic_tables(spark, n=400):
    rng = np.random.default_rng(0)
    words = [f"word{i}" for i in range(50)]
    docs, labels = [], []
    for i in range(n):
        w = list(rng.choice(words, 40))
        if i % 5 == 0:
            w[rng.integers(40)] = "stupid"
        docs.append((i, " ".join(w)))
        labels.append((i, 1, int(i % 5 == 0)))
    hidden = ["you stup1d word1", "what a s t u p i d word2", "so stuuuupid word3 word4", "s.t.u.p.i.d word5"]
    docs += [(10_000 + k, t) for k, t in enumerate(hidden)] + [(20_000, "word1 word2 word3"), (20_001, None), (20_002, ""), (None, "stupid")]
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels + [(None, 1, 1), (5, 1, None)], "doc_id long, quality int, toxic int")


def test_toxicity_catches_disguises_and_spares_clean_texts(spark):
    docs, labels = toxic_tables(spark)
    got = {r.doc_id: r for r in toxicity.toxicity(docs, labels).collect()}
    assert len(got) == docs.count()
    assert all(got[i].predicted == (i % 5 == 0) for i in range(400))
    assert all(got[10_000 + k].predicted == 1 for k in range(4)) and got[None].predicted == 1
    assert all(got[20_000 + k].predicted == 0 and 0 <= got[20_000 + k].score < 0.7 for k in range(3))
    assert all(got[i].held_out == (crc(i, 3) == 1) for i in got)


@pytest.mark.parametrize("every", [2, 3])
def test_toxicity_where_many_labels_are_toxic(spark, every):
    rng = np.random.default_rng(1)
    docs, labels = [], []
    for i in range(600):
        w = list(rng.choice([f"word{k}" for k in range(50)], 40))
        if i % every == 0:
            w[rng.integers(40)] = "stupid"
        elif i % 3 == 1:
            w[rng.integers(40)] = "harmless"
        docs.append((i, " ".join(w)))
        labels.append((i, 1, int(i % every == 0)))
    got = toxicity.toxicity(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    assert sum(r.predicted == (r.doc_id % every == 0) for r in got) >= 590


def test_toxicity_adds_up_moderately_telling_words(spark):
    rng = np.random.default_rng(2)
    docs, labels = [], []
    for i in range(1_500):
        toxic = i % 2 == 0
        told = [w for w in ("nasty", "rotten", "filthy", "dirty", "ugly", "foul") if rng.random() < (0.6 if toxic else 0.3)]
        docs.append((i, " ".join([*rng.choice([f"word{k}" for k in range(50)], 20), *told])))
        labels.append((i, 1, int(toxic)))
    docs += [(9_000, "word1 nasty rotten filthy dirty ugly foul"), (9_001, "word1 nasty"), (9_002, "word1 word2")]
    got = toxicity.toxicity(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).where("doc_id >= 9000")
    score = {r.doc_id: r.score for r in got.collect()}
    assert score[9_000] >= 0.7 and score[9_000] > score[9_001] > score[9_002]


def test_toxicity_on_edge_rows(spark):
    _, labels = toxic_tables(spark)
    assert len(toxicity.toxicity(edge.table(spark), labels).collect()) == len(edge.rows())
    assert toxicity.toxicity(edge.empty(spark), labels).count() == 0
    assert toxicity.toxicity(edge.table(spark), labels.limit(0)).where("predicted = 1").count() == 0


def test_toxicity_held_out_accuracy(spark):
    got = queries.QUERIES["op8_toxicity"](spark, "/root/testdata/sf0.1").where("held_out")
    rows = got.join(spark.read.parquet("/root/testdata/sf0.1/labels.parquet"), "doc_id").collect()
    hit = sum(r.predicted and r.toxic for r in rows)
    assert hit / sum(r.predicted for r in rows) > 0.85 and hit / sum(r.toxic for r in rows) > 0.75


def test_restored_text(spark):
    docs, labels = toxic_tables(spark)
    model = toxicity.learn(docs, labels)
    got = toxicity.restore(spark.createDataFrame([(1, "You stup1d thing!"), (2, None)], "doc_id long, text string"), model).collect()
    assert {r.doc_id: r.restored for r in got} == {1: "You stupid thing!", 2: None}


# ------------------------------------------------------------------ quality


def test_quality_on_labelled_documents(spark):
    got = queries.QUERIES["op2_quality_classifier"](spark, MEDIUM).join(spark.read.parquet(f"{MEDIUM}/labels.parquet"), "doc_id").collect()
    good, bad = [r for r in got if r.quality], [r for r in got if not r.quality]
    assert np.mean([r.accepted for r in good]) > 0.97 and np.mean([r.accepted for r in bad]) < 0.2


def test_quality_on_edge_rows(spark):
    labels = spark.createDataFrame([(3, 1), (4, 0), (None, 1), (5, None)], "doc_id long, quality int")
    df = edge.table(spark)
    scored = quality.with_score(df, quality.learn(df, labels)).collect()
    assert len(scored) == len(edge.rows()) and all(0 <= r.quality_score <= 1 for r in scored)
    assert quality.keep_good(df, labels).columns == df.columns
    assert quality.keep_good(edge.empty(spark), labels).count() == 0
    assert quality.keep_good(df, labels.limit(0), cut=0.0).count() == len(edge.rows())


def test_views_do_not_depend_on_chunks():
    raw = [t.encode() for t in ("Plain words here.\nSecond line", "LOUD!! LOUD!! WORDS!!", "", "a | b | c | d", "same same same same")]
    offsets = np.cumsum([0, *map(len, raw)])
    whole = quality.content(np.frombuffer(b"".join(raw), dtype=np.uint8), offsets)
    for i, t in enumerate(raw):
        assert np.allclose(whole[i], quality.content(np.frombuffer(t, dtype=np.uint8), np.array([0, len(t)]))[0])


# ------------------------------------------------------------------ urls


def plain_url(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host, rest = rest[:cut], rest[cut:]
    path = rest[: min([rest.find(c) for c in "?#" if c in rest] or [len(rest)])]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path


def plain_rule(host, path, rules):
    fit = []
    for _, rule in rules:
        own, _, rest = rule.partition("/")
        if (host == own or host.endswith("." + own)) and path.startswith("/" + rest):
            fit.append(rule)
    return max(fit, key=len, default=None)


URLS = [
    None, "", "no scheme", "http://EXAMPLE.com/en/1", "http://www.example.com/en/", "http://x.com", "https://a.net/es/1", "https://anet/es/1", "http://b.net/fr", "http://net/fr/?x",
    "a://b://c.com/", "http://ÄÖ.com/Pfad", "http://com/", "http://h#f/x", "http://h?q://com/", "http://example.com/EN/", "http://x\ny.com/z\nw?q", "http://long.org/" + "p" * 20_000, "http://a.net/es/1",
]


@pytest.fixture(scope="module")
def url_model(spark):
    return urls.train(urls.seed_urls(spark))


def test_urls_against_plain_rules(spark, url_model):
    rows = [(i, u, "h", "p", 1) for i, u in enumerate(URLS)] + [(0, None, "h", "p", 1), (None, "http://x.com/", "h", "p", 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string, path string, `verdict.x` int")
    model = url_model
    got = urls.judge(pages, queries.URL_RULES, model).collect()
    want = Counter((r[0], *plain_url(r[1]), plain_rule(*plain_url(r[1]), queries.URL_RULES)) for r in rows)
    assert Counter((r.page_id, r.host, r.path, r.rule) for r in got) == want
    given = {text: v for v, text in queries.URL_RULES}
    assert all(r.verdict == (given[r.rule] if r.rule else "block" if r.block_score >= 0.5 else "allow") for r in got)
    assert urls.judge(pages.limit(0), queries.URL_RULES, model).count() == 0
    assert urls.train(urls.seed_urls(spark).where("label = 1")) is None
    assert {r.verdict for r in urls.judge(pages, [], None).collect()} == {"allow"}


def test_url_model_tells_held_out_urls(spark):
    seeds = urls.seed_urls(spark).cache()
    apart = F.crc32(F.col("url").cast("binary")) % 5 == 0
    model = urls.train(seeds.where(~apart))
    got = urls.judge(seeds.where(apart).withColumnRenamed("label", "page_id"), [], model, cut=0.06).collect()
    seeds.unpersist()
    assert np.mean([r.verdict == "block" for r in got if r.page_id == 1]) > 0.9
    assert np.mean([r.verdict == "allow" for r in got if r.page_id == 0]) > 0.85


UNWANTED_HOSTS = ["poker-roulette.test", "www.casino-bonus.test", "shop.cheap-replica.test", "phishing.test", "m.warez-torrent.test"]
PLAIN_HOSTS = ["orchard.test", "www.lakeview-museum.test", "m.brendal.test", "university-library.test"]


def test_url_verdicts_do_not_depend_on_other_pages(spark, url_model, tmp_path):
    asked = [f"http://{h}/en/{n}" for n, h in enumerate(UNWANTED_HOSTS + PLAIN_HOSTS)]
    beside = [f"https://www.plimsol{n}.example.org/de/{n}" for n in range(3_000)]
    pages = spark.createDataFrame(list(enumerate(asked + beside)), "page_id long, url string")
    pages.write.parquet(f"{tmp_path}/pages.parquet")
    within = queries.QUERIES["op1_url_filters"](spark, str(tmp_path)).where(f"page_id < {len(asked)}").collect()
    alone = urls.judge(pages.where(f"page_id < {len(asked)}"), [], url_model, cut=0.06).collect()
    assert {r.page_id: r.verdict for r in within} == {r.page_id: r.verdict for r in alone}
    assert all(r.verdict == "block" for r in alone if r.page_id < len(UNWANTED_HOSTS))


@pytest.mark.xfail(strict=True, reason="known false alarm: www.lakeview-museum.test is blocked at the cut of 0.06")
def test_url_model_allows_plain_hosts(spark, url_model):
    pages = spark.createDataFrame([(n, f"http://{h}/en/{n + 5}") for n, h in enumerate(PLAIN_HOSTS)], "page_id long, url string")
    assert {r.verdict for r in urls.judge(pages, [], url_model, cut=0.06).collect()} == {"allow"}


def test_url_seed_twins_differ_in_their_words_alone(spark):
    rows = urls.seed_urls(spark, frames=2, others=3).collect()
    assert Counter(r.label for r in rows) == {1: 2 * len(urls.UNWANTED), 0: 6 * len(urls.UNWANTED)}
    frame = [re.sub(r"//((?:www|m|blog|shop|en|static)\.)?[^./]+", r"//\1*", r.url) for r in rows]
    assert all(len(set(frame[k : k + 4])) == 1 for k in range(0, len(frame), 4))


# ------------------------------------------------------------------ mixing


def test_mixing_matches_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{MEDIUM}/documents.parquet'")
    got = queries.QUERIES["op4_mixing_to_target_weights"](spark, MEDIUM)
    cursor = con.execute(queries.ORACLES["op4_mixing_to_target_weights"])
    names = [c[0] for c in cursor.description]
    assert Counter(tuple(r) for r in got.select(names).collect()) == Counter(cursor.fetchall())


def test_mixing_on_edge_rows(spark):
    df = edge.table(spark)
    weights = spark.createDataFrame([("s", 3.0), (None, 1.0)], "source string, weight double")
    out = mixing.mix(df, weights, epochs=300.0)
    assert [c for c in out.columns if not c.startswith("_")] == df.columns
    copies = Counter(r.doc_id for r in out.collect())
    rate = {r.source: r.rate for r in mixing.rates(df, weights, epochs=300.0).collect()}
    total = sum(len(t or "") for _, t, *_ in edge.rows())
    assert math.isclose(rate[None], total * 300 / 4 / len(edge.PASSAGE))
    assert abs(copies[7] - rate[None]) < 6 * rate[None] ** 0.5 and copies[4] % 2 == 0 and copies[1] > 0
    assert mixing.mix(edge.empty(spark)).count() == 0
    assert mixing.mix(df, weights.where("weight > 5")).count() == 0


def test_copies_follow_the_poisson_law(spark):
    df = spark.range(20_000).selectExpr("id as doc_id", "'abc' as text", "'s' as source")
    n = np.array([r._copies for r in mixing.replicate(df, mixing.rates(df, epochs=1.7)).select("_copies").collect()])
    assert abs(n.mean() - 1.7) < 0.05 and abs(n.var() - 1.7) < 0.1
    big = np.array([r._copies for r in mixing.replicate(df.limit(500), mixing.rates(df, epochs=1000.0)).select("_copies").collect()])
    assert abs(big.mean() - 1000) < 8 and abs(big.std() - 1000**0.5) < 5


def test_toxicity_learns_from_every_labelled_row(spark):
    labels = spark.range(30_000).selectExpr("id AS doc_id", "1 AS quality", "CAST(id % 2 AS int) AS toxic")
    docs = spark.range(30_000).selectExpr("id AS doc_id", "'a text' AS text")
    taught = toxicity.labelled(docs, labels)
    ids = [i for i in range(30_000) if zlib.crc32(str(i).encode()) % 3 != 1]
    assert taught.count() == len(ids) == taught.agg(F.countDistinct("doc_id")).first()[0] and len(ids) < 20_500
    more = spark.range(60_000).selectExpr("id AS doc_id", "1 AS quality", "CAST(id % 2 AS int) AS toxic")
    assert toxicity.labelled(more.selectExpr("doc_id", "'a text' AS text"), more).count() > 39_000


def test_calibration_of_counted_sums_is_the_plain_fit(spark):
    rng = np.random.default_rng(3)
    x = rng.integers(0, 6, 500) * 0.7
    y = (rng.random(500) < 1 / (1 + np.exp(2 - 1.3 * x))).astype(float)
    sums = spark.createDataFrame([(float(a), int(b)) for a, b in zip(x, y)], "sum double, toxic int").groupBy("sum", "toxic").count()
    start, slope = toxicity.calibrated(sums, 0.3)
    p = 1 / (1 + np.exp(-(start + slope * x)))
    pull = [start - toxicity.log_odds(0.3), slope - 1]  # at the least loss all slopes of it are zero
    assert np.allclose([(p - y).sum() + pull[0], ((p - y) * x).sum() + pull[1]], 0, atol=1e-6)


def test_toxicity_shuffles_labelled_texts_alone(spark, monkeypatch):
    """Labels are not broadcast, however few, and texts without a label stay where they are; a full filter loses no row."""
    docs = spark.range(20_000).selectExpr("id AS doc_id", "concat('text ', id) AS text")
    labels = spark.range(0, 20_000, 10).selectExpr("id AS doc_id", "1 AS quality", "CAST(id % 20 = 0 AS int) AS toxic")
    taught = toxicity.labelled(docs, labels)
    plan = taught._jdf.queryExecution().optimizedPlan()
    both = plan
    while both.nodeName() != "Join":
        both = both.children().head()
    assert "strategy=merge" in both.hint().toString()
    passed = spark._jvm.org.apache.spark.sql.classic.Dataset.ofRows(spark._jsparkSession, both.children().head()).count()
    expected = sorted(tuple(r) for r in taught.collect())
    assert len(expected) <= passed <= 1.05 * len(expected)
    monkeypatch.setattr(toxicity, "LABEL_BITS", 64)  # every bit is set: all texts pass
    assert sorted(tuple(r) for r in toxicity.labelled(docs, labels).collect()) == expected


def test_url_model_has_places_for_met_buckets_alone(spark):
    """Every step of the training brings a number for each place to the driver; the buckets of the table are far fewer than all."""
    seeds = urls.seed_urls(spark, frames=4)
    model = urls.train(seeds, rounds=5)
    rows = urls.split(seeds).select(urls.grams(F.col("_host"), F.col("_path")).alias("_grams"))
    met = urls.bucketed(rows, 1 << 19).select(F.explode("_buckets")).distinct().count()
    assert model.regression.numFeatures == met < 50_000
    unmet = spark.createDataFrame([(1, "")], "page_id long, url string").select("page_id", F.array(F.lit("\u2603\u2603")).alias("_grams"))
    assert model.transform(unmet).first()["_features"].numNonzeros() == 0


def test_plain_words_are_scored_without_reading_them_one_by_one(letters, monkeypatch):
    class Strict(toxicity.Model):
        def of_word(self, word):
            core = word.strip(".,;:!?\"'()")
            if core.isalpha() and not toxicity._DOUBLED.search(core.lower()) or core.lower() in self.letters.words:
                raise ValueError(f"read one by one: {word}")
            return toxicity.Model.of_word(self, word)

    known = toxicity.Letters(letters.cost, letters.single, words={"hello": 1.0, "scum": 5.0, "bottle": 4.0, "été": 3.0, "a": 1.0})
    cues = {"scum$": 3.0, "stup": 2.0, "stupi": 2.5, "éclat": 1.0, "abc$": 0.5, "moro": 1.5}
    texts = ["Scum, (hello) bottle!", "STUPID stupor éclatant Éclats", "sc.um m0ron abc$ abc$d +abc", "", None, "s c u m a été", "hellooo scuum \u00abscum\u00bb", "mor\u00a0on scum\u2003moron a\u0301", "one-two don't 2024 ..."]
    plainly, strict = toxicity.Model(cues, known, -1.0, 1.0), Strict(cues, known, -1.0, 1.0)

    def one(text):  # the cues of a text, word by word
        own = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        found = {plainly.of_word(w)[0] for w in own}
        kind = np.array([toxicity.piece(w, known) for w in own], dtype=np.int8)
        for a, z in toxicity.short_runs(kind, np.array([0, len(own)])) if own else []:
            found.update(plainly.of_pieces(own[a:z]))
        return 1 / (1 + math.exp(1.0 - sum(list(cues.values())[c] for c in found if c >= 0)))

    class Here:  # a batch in this process, where the model can tell what it is asked
        sparkSession = SimpleNamespace(sparkContext=SimpleNamespace(broadcast=lambda v: SimpleNamespace(value=v)))

        def mapInArrow(self, run, kinds):
            batch = pa.record_batch([pa.array(range(len(texts))), pa.array([(t or "").encode() for t in texts], pa.binary())], names=["doc_id", "text"])
            return pa.Table.from_batches(list(run(iter([batch, batch]))))

    monkeypatch.setattr(toxicity, "documents", lambda docs: docs)
    got = toxicity.score(Here(), strict).to_pydict()
    assert got["doc_id"] == [*range(len(texts))] * 2
    run = texts.index("s c u m a été")  # letters set apart are read as a run besides
    assert all(score == pytest.approx(one(texts[i]), rel=1e-12) for i, score in zip(*got.values()) if i != run)


def test_features_in_arrays_are_those_of_words():
    texts = ["Scum, (hello) $tupid ab$cd abcd$ \u00c9clatant! \u00d7 \u6f22\u5b57\u6f22\u5b57\u6f22", "a\u00a0b\u2003c d\x1ce \u00ababc\u00bb \u0130stanbul", "", "... it's don't-stop hello HELLO 2024"]
    data = [t.encode() for t in texts]
    words = toxicity.split(np.frombuffer(b"".join(data), dtype=np.uint8), np.cumsum([0, *map(len, data)]))
    cores = toxicity.Cores(words, toxicity._EDGES)
    odd = np.flatnonzero(~cores.plain)
    cores.put(odd, [toxicity.plain(w.decode(), None) for _, w in cores.texts(odd)])
    row, starts, ends, hashes, table = toxicity.feature_table(cores.row, cores.lo, cores.hi)
    feature = [row[a:z].tobytes().decode() for a, z in zip(starts, ends)]
    assert hashes.tolist() == toxicity.hashed(feature).tolist()
    got = [[{feature[i] for i in table[w] if i >= 0} for w in cores.which[a:z]] for a, z in zip(words.bounds, words.bounds[1:])]
    assert got == [[set(toxicity.features(toxicity.plain(w, None))) for w in t.split()] for t in texts]


def test_counts_of_learning_are_those_of_whole_texts(spark):
    """Words parted by any blank of Unicode, in many documents of a batch, weigh as in a plain count."""
    blanks = [" ", "\u00a0", "\u2003", "\n", "\x1f", "\u3000"]
    docs = [(i, blanks[i % 6].join(["Vile," if i % 4 == 0 else "kind", "person" if i % 2 else "PERSON!", f"n{i % 7}x", "\u00c9t\u00e9"])) for i in range(600)]
    labels = [(i, int(i % 4 == 0)) for i, _ in docs]
    taught = [(t, y) for (i, t), (_, y) in zip(docs, labels) if crc(i, 3) != 1]
    model = toxicity.learn(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"))
    bad, good = Counter(), Counter()
    for t, y in taught:
        (bad if y else good).update({f for w in set(t.split()) for f in toxicity.features(toxicity.plain(w, None))})
    assert set(model.cues) == {"vile$"}
    base = (sum(y for _, y in taught) + 0.5) / (len(taught) + 1)
    assert model.cues["vile$"] == toxicity.weight(bad["vile$"], good["vile$"], base, 10.0, 6.0)
    n = {w[:-1]: bad[w] + good[w] for w in bad | good if w.endswith("$") and w[:-1].isalpha()}
    assert model.letters.words == pytest.approx({w: -math.log(k / sum(n.values())) for w, k in n.items()})
