"""Mixing, URL filters, embeddings, the classifier and components against
brute force, and the odd cases of each."""
import datetime as dt
import hashlib
import math
import random
import re
import tracemalloc
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from segmetrics.llm import embedding_dedup, mixing, quality_model, url_filters
from segmetrics.llm.common import running_total
from segmetrics.llm.components import components
from segmetrics.llm.hnsw import Graph
from tests.llm.test_text_operators import WORD


def test_components(spark):
    rng = random.Random(4)
    chain = [(i, i + 1) for i in range(100, 160)]
    star = [(500, i) for i in range(501, 580)]
    edges = chain + star + [(rng.randint(0, 60), rng.randint(0, 60)) for _ in range(45)] + [(7, 7), (None, 3), (900, -4), (900, -4)]
    rng.shuffle(edges)
    name = {}

    def find(x):
        while name.setdefault(x, x) != x:
            x = name[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            a, b = find(a), find(b)
            name[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long").repartition(5)).collect()}
    assert got == {x: find(x) for x in list(name)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_running_total(spark):
    rows = [(i % 7, i, i % 5) for i in range(500)]
    got = running_total(spark.createDataFrame(rows, "g int, i int, w int").repartition(6), ["g", "i"], F.col("w"), "before").collect()
    total, want = 0, {}
    for g, i, w in sorted(rows):
        want[g, i] = total
        total += w
    assert {(r.g, r.i): r.before for r in got} == want


def water_fill(sizes, most=3):
    """source -> size, in order of code points, null last -> target."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    total, full = sum(sizes.values()), set()
    while True:
        rest = total - sum(most * sizes[s] for s in full)
        shares = sum(weight[s] for s in names if s not in full)
        target = {s: most * sizes[s] if s in full else rest * weight[s] / shares for s in names}
        over = {s for s in names if s not in full and target[s] > most * sizes[s]}
        if not over:
            return target
        full |= over


def test_mixing(docs, rows):
    got = mixing.sample_copies(docs).collect()
    assert len(got) == len(rows)
    size = lambda t: len(WORD.findall(t or ""))
    sizes = defaultdict(int)
    for r in rows:
        sizes[r[3]] += size(r[1])
    target = water_fill(dict(sizes))
    taken, largest = defaultdict(int), defaultdict(int)
    for r in got:
        assert r.source_size == sizes[r.source]
        assert r.target == pytest.approx(target[r.source])
        assert 0 <= r.copies <= 3
        taken[r.source] += r.copies * r["size"]
        largest[r.source] = max(largest[r.source], r["size"])
    for s in sizes:
        assert abs(taken[s] - target[s]) <= 3 * largest[s]
    again = mixing.sample_copies(docs.repartition(7)).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, again))


def test_mixing_is_close_on_many_documents(spark):
    rng = random.Random(6)
    rows = [(i, "w " * int(rng.paretovariate(1.2) * 5), "ab"[i % 8 == 0]) for i in range(4000)]
    got = mixing.sample_copies(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    for s in "ab":
        own = [r for r in got if r.source == s]
        assert sum(r.copies * r["size"] for r in own) == pytest.approx(own[0].target, rel=0.05, abs=max(r["size"] for r in own))


def test_mix_keeps_columns(docs, rows):
    out = mixing.mix(docs)
    assert out.columns == docs.columns
    copies = Counter()
    for r in mixing.sample_copies(docs).collect():
        copies[r.doc_id, r.source, r["size"]] += r.copies
    got = Counter((r.doc_id, r.source, len(WORD.findall(r.text or ""))) for r in out.collect())
    assert got == Counter({k: v for k, v in copies.items() if v})


def test_mix_does_not_depend_on_row_order(spark):
    """Null ids of one size: which texts are copied is settled by the texts."""
    rows = [(None, f"word {i} here", "en", "s", 3) for i in range(6)] + [(7, "same id", "en", "s", 1), (7, "other", "en", "s", 1)]
    rows += [(i, f"many words in source t number {i}", "en", "t", 1) for i in range(30)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    runs = [Counter(r.text for r in mixing.mix(spark.createDataFrame(x, schema).repartition(n)).collect())
            for x, n in ((rows, 1), (rows[::-1], 1), (rows[3:] + rows[:3], 4))]
    assert runs[0] == runs[1] == runs[2] and sum(runs[0].values()) > 0


def test_mix_empty(no_docs, spark):
    assert mixing.mix(no_docs).count() == 0 and mixing.sample_copies(no_docs).count() == 0
    blank = spark.createDataFrame([(1, None, None), (2, " ", "x")], "doc_id long, text string, source string")
    assert [(r.target, r.copies) for r in mixing.sample_copies(blank).orderBy("doc_id").collect()] == [(0.0, 0), (0.0, 0)]


def day(n):
    return dt.date(2024, 1, 1) + dt.timedelta(days=n)


ENTRIES = [
    ("spam", "bad.example", day(10), True), ("spam", "bad.example", day(50), False), ("spam", "bad.example", day(300), True),
    ("spam", "bad.example", day(10), True), ("games", "play.bad.example", day(0), True), ("games", "play.bad.example", day(0), False),
    ("policy", "site.example/de/", day(20), True), ("policy", "site.example/de/at/", day(5), True),
    ("spam", "Loud.Example.", day(0), True), ("spam", "Loud.Example/Dir/", day(0), True), ("spam", "3.4", day(0), True),
    ("spam", "1.2.3.5", day(0), True), (None, "x", day(0), True), ("spam", None, day(0), True), ("spam", "x", None, True), ("spam", "x", day(0), None),
]
URLS = ["http://bad.example/", "https://WWW.Bad.Example:80/a/b?q=1", "http://u@play.bad.example/x", "http://notbad.example/",
        "http://site.example/de/page", "http://site.example/de", "http://site.example/de/at/x#f", "http://site.example/en/de/",
        "http://1.2.3.4/", "http://1.2.3.5:80/x", "http://a.LOUD.example/", "http://loud.example/Dir/x", "http://loud.example/dir/x",
        "http://[::1]/x", "no url", "", None, "http://example/", "http://bad.example./x", "ftp://bad.example"]


def test_url_filters(spark):
    caps = [(i * 100 + d, u, day(d) if d != 77 else None) for i, u in enumerate(URLS) for d in (0, 5, 10, 49, 50, 77, 200, 300, 365)]
    caps.append(caps[0])
    c = spark.createDataFrame(caps, "page_id long, url string, fetch_day date").withColumn("pattern", F.lit("x")).withColumn(
        "lists", F.lit("y"))
    e = spark.createDataFrame(ENTRIES, "list_name string, pattern string, day date, added boolean")
    got = Counter((r.page_id, r.lists, r.n_matches, r.blocked) for r in url_filters.filter_urls(c, e).collect())

    def active(name, pattern, on):
        when = sorted({x[2] for x in ENTRIES if x[:2] == (name, pattern) and x[2] is not None and x[3] is not None and x[2] <= on})
        if not when:
            return False
        return all(x[3] for x in ENTRIES if x[:3] == (name, pattern, when[-1]))

    def covers(pattern, url):
        rest = (url or "").partition("://")[2]
        host, _, path = rest.partition("/")
        host = host.rpartition("@")[2].partition(":")[0].lower().rstrip(".")
        path = path.partition("?")[0].partition("#")[0]
        p_host, slash, p_path = pattern.partition("/")
        p_host = p_host.lower().rstrip(".")
        if slash:
            return f"{host}/{path}".startswith(f"{p_host}/{p_path}")
        return host == p_host or (not re.fullmatch("[0-9.]+", host) and host.endswith("." + p_host))

    want = Counter()
    for i, u, on in caps:
        hits = [(n, p) for n, p in {x[:2] for x in ENTRIES if x[0] and x[1]}
                if on is not None and covers(p, u) and active(n, p, on)]
        want[i, ",".join(sorted({n for n, _ in hits})), len(hits), bool(hits)] += 1
    assert got == want and sum(k[3] for k in got) > 20


def test_url_filters_empty(spark):
    e = spark.createDataFrame(ENTRIES, "list_name string, pattern string, day date, added boolean")
    c = spark.createDataFrame([(1, "http://bad.example/", day(20))], "page_id long, url string, fetch_day date")
    assert url_filters.filter_urls(c.limit(0), e).count() == 0
    assert url_filters.filter_urls(c, e.limit(0)).first().blocked is False


def clustered(seed=1, n=400, size=16):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(40, size))
    x = centres[rng.integers(0, 40, n)] + rng.normal(scale=rng.choice([0.05, 0.2, 0.6], (n, 1)), size=(n, size))
    return x.astype(np.float32)


def brute_vectors(rows):
    ok = {}
    for k, (_, v) in enumerate(rows):
        if v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            x = np.array(v, np.float64)
            x = x / np.abs(x).max()
            ok[k] = x / np.linalg.norm(x)
    links, name = Counter(), {k: k for k in range(len(rows))}

    def find(x):
        while name[x] != x:
            x = name[x]
        return x

    keys = sorted(ok)
    for i, a in enumerate(keys):
        for b in keys[i + 1:]:
            if len(ok[a]) == len(ok[b]) and float(ok[a] @ ok[b]) >= 0.9:
                links[a] += 1
                links[b] += 1
                p, q = find(a), find(b)
                name[max(p, q)] = min(p, q)
    least = {}
    for k in range(len(rows)):
        if rows[k][0] is not None:
            least[find(k)] = min(rows[k][0], least.get(find(k), rows[k][0]))
    return Counter((rows[k][0], links[k], least.get(find(k)), rows[k][0] == least.get(find(k))) for k in range(len(rows)))


def test_near_vectors(spark):
    x = clustered()
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x)]
    rows += [(1000 + i, rows[3][1]) for i in range(30)]                      # one very common vector
    rows += [(2000, None), (2001, []), (2002, [0.0] * 16), (2003, [float("nan")] + [1.0] * 15), (2004, [None] + [1.0] * 15),
             (2005, [float("inf")] + [1.0] * 15), (2006, [1.0] * 8), (2007, [2.0] * 8), (5, [1e-30] * 16), (5, [1e30] * 16),
             (None, rows[3][1]), (-7, rows[9][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("node", F.lit("x")).repartition(3)
    exact = [(i, None if v is None else [None if c is None else float(np.float32(c)) for c in v]) for i, v in rows]
    got = Counter(map(tuple, embedding_dedup.near_vectors(df, shards=3).collect()))
    assert got == brute_vectors(exact)
    assert embedding_dedup.near_vectors(df.limit(0)).count() == 0


def test_graph_finds_a_large_group():
    rng = np.random.default_rng(5)
    centre = rng.normal(size=24)
    x = np.concatenate([centre + rng.normal(scale=0.02, size=(900, 24)), rng.normal(size=(1500, 24))])
    x = x[rng.permutation(len(x))] / np.linalg.norm(x, axis=1)[:, None].max()
    u = x / np.linalg.norm(x, axis=1)[:, None]
    g = Graph.of(Graph.build(u, 96).arrays())
    q, r = g.within(u[:200].astype(np.float32), 0.9, 16)     # far more neighbours than the beam holds
    true = {(i, j) for i, j in zip(*np.nonzero(u[:200] @ u.T >= 0.9))}
    assert len(true & set(zip(q.tolist(), r.tolist()))) >= 0.98 * len(true)


def test_graph_leaves_no_islands():
    """Tight groups of more vectors than a row has links, near each other."""
    rng = np.random.default_rng(3)
    hub = rng.normal(size=64)
    hub /= np.linalg.norm(hub)
    parts = []
    for _ in range(20):
        d = rng.normal(size=64)
        d -= d @ hub * hub
        centre = np.sqrt(0.925) * hub + np.sqrt(0.075) * d / np.linalg.norm(d)
        parts.append(centre + rng.normal(scale=0.00125, size=(200, 64)))
    u = np.concatenate(parts)
    u = (u / np.linalg.norm(u, axis=1)[:, None])[rng.permutation(4000)].astype(np.float32)
    q, _ = Graph.build(u, 96).within(u[::40], 0.9, 48)
    true = (u[::40] @ u.T >= 0.9).sum(1)
    assert (np.bincount(q, minlength=100) / true).min() > 0.99


def test_search_of_a_large_group_in_bounded_memory():
    """6,000 near vectors searched for 4,096 of them: 24 million pairs."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=16) + 0.05 * rng.normal(size=(6000, 16))
    far = rng.normal(size=(3000, 16))
    u = embedding_dedup._unit(np.concatenate([x, far]))
    graph = Graph.build(u, 96)
    q = u[:4096].astype(np.float32)
    tracemalloc.start()
    counts, largest = np.zeros(len(q), np.int64), 0
    for a, b in graph.near(q, 0.9, 48):
        counts += np.bincount(a, minlength=len(q))
        largest = max(largest, a.size)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    true = np.concatenate([(q[i:i + 256] @ u.T.astype(np.float32) >= 0.9).sum(1) for i in range(0, len(q), 256)])
    assert counts.sum() > 20e6 and (counts == true).mean() > 0.999 and peak < 300e6, peak
    assert largest <= 1 << 22


def test_audit_sees_small_groups(spark):
    """All links of the large group outweigh the lost ones in sum, not in
    the audit; nothing to find passes."""
    true = spark.createDataFrame([(i, 300_000) for i in range(85)] + [(100 + i, 2) for i in range(171)], "node long, links long")
    found = spark.createDataFrame([(0, i, 300_000, 0) for i in range(85)] + [(1, 100, 101, 0)], "kind int, a long, b long, n long")
    assert embedding_dedup.worst_share(found, true) == 0.0
    half = found.union(spark.createDataFrame([(0, 100 + i, 1, 0) for i in range(171)], found.schema))
    assert embedding_dedup.worst_share(half, true) == 0.5
    assert embedding_dedup.worst_share(half.union(half), true) == 1.0
    assert embedding_dedup.worst_share(found, true.withColumn("links", F.lit(0).cast("long"))) == 1.0


def test_audit_grows_with_the_table(spark):
    """One vector in 20 with its true links, whatever block it is in."""
    x = clustered(4, 6000)
    nodes = spark.createDataFrame([(i, 1, [float(c) for c in v], 16) for i, v in enumerate(x)], "node long, n long, vector array<float>, size int")
    ids = np.arange(6000)
    blocks = [(16, k, 1, 0, bytearray(embedding_dedup._blob([ids[k::2], np.ones(3000, int), x[k::2]]))) for k in range(2)]
    graphs = spark.createDataFrame(blocks, "size int, shard int, kind int, part int, blob binary")
    u = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1)[:, None]
    want = (u[::20] @ u.T >= 0.9).sum(1) - 1
    got = {r.node: r.links for r in embedding_dedup._true_links(nodes, graphs, 0.9, 2, 6000).collect()}
    assert got == {20 * i: n for i, n in enumerate(want)}


def labelled(spark, n=240):
    rng = random.Random(9)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(300)]
    good = lambda: " ".join(rng.choice(words) for _ in range(rng.randint(40, 300)))
    bad = lambda: " ".join(rng.choice(words).upper() + rng.choice(["$$$", "###", "!!"]) for _ in range(rng.randint(40, 300)))
    rows = [(i, good() if i % 3 else bad(), int(i % 3 > 0)) for i in range(n)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(9001, None), (9002, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, q) for i, _, q in rows] + [(None, 1), (9999, 0), (5, None)], "doc_id long, quality int")
    return docs.withColumn("score", F.lit("mine")).withColumn("n", F.lit(1)), labels, {i: q for i, _, q in rows}


def test_quality_model_on_held_out_labels(spark):
    docs, labels, truth = labelled(spark)
    learn = F.col("doc_id") % 5 != 0
    model = quality_model.fit(docs, labels, learn)
    got = quality_model.score(docs, model).collect()
    assert len(got) == 242 and all(0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.doc_id % 5 == 0 and r.doc_id in truth]
    assert sum((r.score >= 0.5) == (truth[r.doc_id] == 1) for r in held) >= 0.95 * len(held)
    assert quality_model.fit(docs.repartition(5), labels.repartition(2), learn).weights == model.weights
    kept = quality_model.score(docs, model, docs.columns, "s2")
    assert kept.columns == [*docs.columns[:1], *docs.columns[1:], "s2"] and kept.first()["score"] == "mine"


def test_quality_model_scores_recomputed(spark):
    """Scores from the two dictionaries and the curve, step by step."""
    import zstandard as zstd

    docs, labels, _ = labelled(spark)
    model = quality_model.fit(docs, labels, F.col("doc_id") % 5 != 0)

    def size(text, dictionary):
        d = zstd.ZstdCompressionDict(dictionary)
        c = zstd.ZstdCompressor(level=quality_model.LEVEL, dict_data=d, write_checksum=False, write_content_size=False, write_dict_id=False)
        return sum(len(c.compress(text[at:at + 4096])) for at in range(0, len(text), 4096))

    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    for r in quality_model.score(docs, model).collect():
        data = (texts[r.doc_id] or "").encode()
        good, bad = size(data, model.good), size(data, model.bad)
        x = [(bad - good) / (bad + good), good / len(data), (good / len(data)) ** 2] if data else [0.0, 1.0, 1.0]
        z = model.weights[0] + sum(w * (v - m) / s for w, v, m, s in zip(model.weights[1:], x, model.mean, model.scale))
        assert abs(r.score - 1 / (1 + math.exp(-z))) < 1e-9


def test_quality_model_ignores_held_out_rows(spark):
    docs, labels, _ = labelled(spark)
    learn = F.col("doc_id") % 5 != 0
    flipped = labels.withColumn("quality", F.when(learn, F.col("quality")).otherwise(1 - F.col("quality")))
    assert quality_model.fit(docs, flipped, learn) == quality_model.fit(docs, labels, learn)


def test_quality_model_keeps_class_shares(spark):
    """A sample that holds both classes alike still gives probabilities at
    the labels' shares (80 good to 20 bad in a hundred)."""
    rng = random.Random(10)
    words = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(4000):
        good = i % 5 > 0
        # the classes overlap, so the shares decide much of the score
        usual = words[:40] if good != (rng.random() < 0.25) else words[20:]
        rows.append((i, " ".join(rng.choice(usual) for _ in range(60)), int(good)))
    df = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    docs, labels = df.select("doc_id", "text"), df.select("doc_id", "quality")
    mean = {}
    for n in (300, 600, 3000):  # the last one takes every label
        model = quality_model.fit(docs, labels, F.col("doc_id") < 3000, n)
        mean[n] = quality_model.score(docs.where("doc_id >= 3000"), model).agg(F.avg("score")).first()[0]
    assert all(abs(m - 0.8) < 0.05 for m in mean.values()), mean


def test_quality_model_without_labels(spark, no_docs):
    docs, labels, _ = labelled(spark)
    model = quality_model.fit(docs, labels.limit(0), F.lit(True))
    assert {r.score for r in quality_model.score(docs, model).collect()} == {0.5}
    only = quality_model.fit(docs, labels.where("quality = 1"), F.lit(True))
    assert min(r.score for r in quality_model.score(docs, only).collect()) > 0.9
    assert quality_model.score(no_docs, model).count() == 0


def test_offset_is_fixed(spark):
    df = spark.createDataFrame([("a",), (None,)], "s string")
    got = [r[0] for r in df.select(mixing.random_offset(F.col("s"), 9)).collect()]
    assert got == [int(hashlib.md5(x).hexdigest()[:8], 16) / 2 ** 32 for x in (b"9:sa", b"9:n")]
