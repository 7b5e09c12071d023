"""Importance resampling, language identification and periodic runs: brute
force, held-out accuracy, odd rows, empty tables, clashing columns."""
import hashlib
import math
import random
import re
from collections import Counter
from fractions import Fraction
from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F

from segmetrics.llm import language_id, periodic_runs, queries, resampling
from segmetrics.llm.recompression import Grammar
from tests.conftest import SF001


def brute_runs(s, min_words=24, exponent=3):
    """(start, length, period) from the definition, period by period."""
    out = {}
    for q in range(1, len(s) // exponent + 1):
        i = 0
        while i < len(s) - q:
            j = i
            while j < len(s) - q and s[j] == s[j + q]:
                j += 1
            if j > i and j - i + q >= max(min_words, exponent * q):
                out.setdefault((i, j - i + q), q)
            i = j + 1
    return sorted(((a, n, q) for (a, n), q in out.items()), key=lambda r: (r[0], r[2]))


def sequences(rng):
    out = []
    for _ in range(rng.randint(1, 6)):
        k = rng.choice([1, 2, 2, 3, 50])
        s = [rng.randrange(k) for _ in range(rng.randint(0, 60))]
        for _ in range(rng.randint(0, 3)):
            block = [rng.randrange(k) for _ in range(rng.randint(1, 9))]
            s += (block * 20)[:rng.randint(1, 80)]
        out.append(np.array(s, np.int32))
    return sorted(out, key=lambda s: -len(s))


def test_extensions():
    """The grammar's extensions, symbol by symbol, both ways."""
    rng = random.Random(4)
    for _ in range(60):
        g = Grammar(sequences(rng))
        s = g.symbols.tolist()
        pairs = [(i, j) for i, j in ((rng.randrange(len(s) - 1), rng.randrange(len(s) - 1)) for _ in range(60)) if i != j]
        if not pairs:
            continue
        i, j = (np.array(x) for x in zip(*pairs))
        for a, b, f, r in zip(i.tolist(), j.tolist(), g.forward(i, j).tolist(), g.backward(i, j).tolist()):
            k = 0
            while s[a + k] == s[b + k]:
                k += 1
            assert k == f
            k = 0
            while s[a - k] == s[b - k]:
                k += 1
            assert k == r


@pytest.mark.parametrize("min_words,exponent", [(24, 3), (4, 2), (6, 3), (1, 2), (10, 4)])
def test_runs_by_brute_force(min_words, exponent, monkeypatch):
    monkeypatch.setattr(periodic_runs, "CANDIDATES", 64)
    rng = random.Random(min_words)
    for _ in range(60):
        found = sequences(rng)
        if len(found[0]):
            got = periodic_runs.runs_of(found, min_words, exponent)
            assert [[tuple(r) for r in x.tolist()] for x in got] == [brute_runs(s.tolist(), min_words, exponent) for s in found]


def run_row(doc_id, words):
    runs = brute_runs(words)
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if runs else None
    gone = {i for a, n, q in runs for i in range(a + q, a + n)}
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (doc_id, len(runs), *(best or (None, None, None)), 1000 * best[1] // best[2] if best else None,
            digest("".join(f"{a},{n},{q}\n" for a, n, q in runs)),
            digest(" ".join(w for i, w in enumerate(words) if i not in gone)))


def planted(doc_id, words):
    h = crc32(str(doc_id).encode())
    g, n = h // 10, len(words)
    if doc_id is None or h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]


def test_query_runs(spark, tmp_path):
    rows = spark.read.parquet(f"{SF001}/documents.parquet").select("doc_id", "text").collect()
    want = sorted(run_row(i, planted(i, re.findall(r"[^ \t-\r]+", t or ""))) for i, t in rows)
    got = queries.op13_periodic_runs(spark, SF001).drop("n_words").collect()
    assert sorted(tuple(r) for r in got) == want
    assert sum(r[1] > 0 for r in want) >= len(want) // 20  # planted runs are there


def test_query_runs_on_odd_rows(spark, docs, rows, tmp_path):
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.op13_periodic_runs(spark, str(tmp_path)).drop("n_words").collect()
    key = lambda r: tuple((x is None, x or 0) if not isinstance(x, str) else (False, x) for x in r)
    short = [r for r in rows if len(r[1] or "") < 100_000]
    want = Counter(run_row(r[0], planted(r[0], re.findall(r"[^ \t-\r]+", r[1] or ""))) for r in short)
    assert want == Counter(tuple(r) for r in got if r[0] != 1005)
    # two words alternating, 20,000 times each, after one long word
    long = [r for r in got if r[0] == 1005]
    assert len(long) == 1 and long[0][1] == 1 and (long[0].start, long[0].length, long[0].period) in ((1, 40_000, 2), (0, 40_001, 2))
    assert sorted(map(key, got), key=str) == sorted(map(key, queries.op13_periodic_runs(spark, str(tmp_path)).drop("n_words").collect()), key=str)


def test_runs_interface(spark, docs, no_docs):
    out = periodic_runs.find_runs(docs.withColumn("runs", F.lit(1)), ["doc_id", "start", "n"], 6, 2)
    assert out.columns == ["doc_id", "start", "n", "n_words", "runs", "collapsed"]
    assert out.count() == docs.count()
    assert periodic_runs.find_runs(no_docs).collect() == []
    with pytest.raises(ValueError):
        periodic_runs.find_runs(docs, exponent=1)
    text = "a b " * 30 + "c"
    r = periodic_runs.find_runs(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert [tuple(x) for x in r.runs] == [(0, 60, 2)] and r.collapsed == "a b c" and r.n_words == 61


def test_chunks_do_not_matter(monkeypatch):
    rng = random.Random(8)
    texts = [" ".join(map(str, s.tolist())).encode() for _ in range(20) for s in sequences(rng)]
    whole = periodic_runs._batch(texts, 6, 2)
    monkeypatch.setattr(periodic_runs, "CHUNK_BYTES", 50)
    parts = periodic_runs._batch(texts, 6, 2)
    assert whole[1] == parts[1] and all((a == b).all() for a, b in zip(whole[0], parts[0]))


def brute_resample(rows, target, buckets, longest, min_words, percent):
    """Rows in order of (score, doc_id) with ranks, from the definition."""
    def grams(text):
        ws = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        return len(ws), [" ".join(ws[i:i + n]) for n in range(1, longest + 1) for i in range(len(ws) - n + 1)]

    bucket = lambda g: crc32(g.encode()) % buckets
    s = Counter(bucket(g) for _, t in rows for g in grams(t)[1])
    t = Counter(bucket(g) for x in target for g in grams(x)[1])
    total, goal = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (total + buckets) / ((s[b] + 1) * (goal + buckets))))
    out = []
    for i, text in rows:
        n, gs = grams(text)
        w = sum(gain(bucket(g)) for g in gs) // len(gs) if gs else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((i, n, len(gs), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    order = sorted((r for r in out if r[1] >= min_words), key=lambda r: (-r[4], r[0] is None, r[0] or 0, r[2]))
    draw = len(order) * percent // 100
    return Counter((*r, None) for r in out if r[1] < min_words) + Counter(
        (*r, k + 1 if k < draw else None) for k, r in enumerate(order))


@pytest.mark.parametrize("buckets,longest,percent,margin", [(10_000, 1, 10, 0.002), (50, 3, 50, 1e-7), (1, 1, 37, 1e-7), (300, 2, 100, 0.1)])
def test_resample_by_brute_force(spark, docs, rows, monkeypatch, buckets, longest, percent, margin):
    monkeypatch.setattr(resampling, "MARGIN", margin)  # a bracket too narrow is widened
    target = ["amber quill harbor Lantern", "meadow copper, violet", None]
    frame = spark.createDataFrame([(t,) for t in target], "text string")
    found = resampling.resample(docs, frame, buckets, longest, 5, percent)
    want = brute_resample([(r[0], r[1]) for r in rows], target, buckets, longest, 5, percent)
    got = Counter((r.doc_id, r.n_words, r.n_features, r.weight, r.score, r["rank"]) for r in found.collect())
    assert got == want
    drawn = resampling.drawn_documents(docs, frame, buckets=buckets, longest=longest, min_words=5, percent=percent)
    assert drawn.columns == docs.columns
    ranked = Counter(k[0] for k, n in want.items() for _ in range(n) if k[5] is not None)
    assert Counter(r.doc_id for r in drawn.select("doc_id").collect()) == ranked


def test_resample_ties(spark):
    """A third of the scores alike at the cutoff: the smaller ids are drawn."""
    scores = spark.range(3000).select(F.when(F.col("id") < 1000, 7).otherwise(F.col("id") % 11).cast("long").alias("score"))
    for draw in (1, 700, 1100, 2000, 3000):
        want = sorted((r.score for r in scores.collect()), reverse=True)[draw - 1]
        assert resampling.cutoff(scores, 3000, draw) == want


def test_resample_empty(spark, docs, no_docs):
    target = spark.createDataFrame([("amber",)], "text string")
    assert resampling.resample(no_docs, target).collect() == []
    out = resampling.resample(docs, target.where("false"), percent=0).collect()
    assert len(out) == docs.count() and all(r["rank"] is None for r in out)


def test_query_resampling(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF001}/documents.parquet").select("doc_id", "text").collect()]
    target = [r.text for r in spark.read.parquet(f"{SF001}/benchmark.parquet").collect()]
    got = Counter((r.doc_id, r.n_words, r.n_features, r.weight, r.score, r["rank"])
                  for r in queries.op11_importance_resampling(spark, SF001).collect())
    assert got == brute_resample(rows, target, 10_000, 1, 20, 10)


LANGS = {"aa": "the of and river stone amber quill harbor", "bb": "der und fluss stein über straße zwölf grün",
         "cc": "река камень и вода дом улица зелёный"}


def labelled(spark, n=120):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice(LANGS[lang].split()) for _ in range(rng.randint(3, 60))), lang)
            for i, lang in enumerate(rng.choices(list(LANGS), (6, 2, 1), k=n))]
    return spark.createDataFrame(rows + [(None, "grün und", "bb"), (9001, None, "aa"), (9002, "12 %", "aa"), (9003, "quill harbor", None)],
                                 "doc_id long, text string, lang string")


def test_language_by_hand(spark):
    docs = labelled(spark)
    model = language_id.fit(docs, F.col("doc_id") % 4 != 2)
    assert model.languages == ("aa", "bb", "cc")
    out = language_id.identify(docs, model, ["doc_id", "lang", "text"]).collect()
    right = [r.lang_pred == r.lang for r in out if r.doc_id is not None and r.doc_id < 9000 and r.doc_id % 4 == 2]
    assert np.mean(right) > 0.95
    odd = {r.doc_id: r for r in out}
    assert (odd[9001].lang_pred, odd[9001].score, odd[9001].accepted) == ("und", 0.0, False)
    assert (odd[9002].lang_pred, odd[9002].score) == ("und", 0.0) and odd[9003].lang_pred == "aa"
    assert all(0 <= r.score <= 1 for r in out)


def test_language_scores_from_the_model(spark, docs):
    """Probabilities recomputed n-gram by n-gram; batches do not matter."""
    model = language_id.fit(labelled(spark), F.lit(True))
    got = language_id.identify(docs, model, ["doc_id", "text"]).collect()
    for r in got:
        if r.text is None or len(r.text) > 5000:
            continue
        found = language_id._features(r.text)
        if not found.size:
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        z = (model.logits[found].astype(np.int64).sum(0) / language_id.SCALE / found.size + model.bias) / model.temperature
        p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        assert r.lang_pred == model.languages[int(p.argmax())] and abs(r.score - p.max()) < 1e-12
    again = language_id.identify(docs.repartition(7), model, ["doc_id", "text"]).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, again))


def test_subwords_cut_in_blocks(monkeypatch):
    text = "Über die 12 Brücken, la señora élan " * 7
    whole = np.sort(language_id._features(text))
    monkeypatch.setattr(language_id, "BLOCK", 13)
    assert (np.sort(language_id._features(text)) == whole).all()
    words = language_id.letters(text).decode().split()
    assert whole.size == sum(max(0, len(f" {w} ".encode()) - n + 1) for w in words for n in language_id.GRAMS)


def test_language_without_labels(spark, docs, no_docs):
    unlabelled = docs.withColumn("lang", F.lit(None).cast("string"))
    assert language_id.fit(unlabelled, F.lit(True)) is None and language_id.fit(no_docs, F.lit(True)) is None
    out = language_id.identify(unlabelled, None, ["doc_id", "score"])
    assert out.columns == ["doc_id", "score", "lang_pred", "score_", "accepted"]
    assert {(r.lang_pred, r.score_, r.accepted) for r in out.collect()} == {("und", 0.0, False)}
    one = language_id.fit(docs.withColumn("lang", F.lit("xx")), F.lit(True))
    assert {r.lang_pred for r in language_id.identify(docs, one).collect()} == {"xx", "und"}
    assert language_id.identify(no_docs, one).collect() == []


def test_query_language(spark):
    rows = {r.doc_id: r for r in spark.read.parquet(f"{SF001}/documents.parquet").collect()}
    got = queries.op12_language_id(spark, SF001).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.held_out == (crc32(str(r.doc_id).encode()) % 4 == 2)
        assert (r.lang_pred == "und") == (not any(c.isalpha() for c in rows[r.doc_id].text or ""))
    held = [r.lang_pred == rows[r.doc_id].lang for r in got if r.held_out and rows[r.doc_id].lang]
    assert np.mean(held) > 0.9


def test_temperature_and_threshold():
    z, y = np.array([[4.0, 0], [0, 4.0], [3.0, 0], [0.5, 0]] * 10), np.array([0, 1, 0, 1] * 10)
    t = language_id._temperature(z, y)
    assert t > 1  # a quarter is wrong: less sure than the raw scores
    score, right = np.linspace(0, 1, 1000), np.linspace(0, 1, 1000) > 0.3
    assert abs(language_id._threshold(score, right) - 0.3) < 0.02
