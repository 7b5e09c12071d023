"""Line dedup, suffix dedup, SimHash, quality rules, licenses and packing
against brute force on a small corpus with odd rows."""
import hashlib
import random
import time
import tracemalloc
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import xxhash

from segmetrics.llm import licenses, line_dedup, packing, quality_rules, simhash, suffix_dedup
from segmetrics.llm.queries import TOKENIZER

WORD = re.compile("[^\x20\x09-\x0d]+")


def key(i):
    return (i is None, i)


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t)


def order(text):
    """The operator's order of texts that share an id: by their hash."""
    h = xxhash.xxh64_intdigest(text.encode(), 42)
    return h - (1 << 64) if h >> 63 else h


def brute_lines(rows, least=5):
    """(doc_id, text) -> (lines, removed, runs, kept text), without the
    maximal runs that start earlier."""
    out, seen = {}, defaultdict(list)
    for i, text in sorted({(r[0], r[1] or "") for r in rows}, key=lambda x: (key(x[0]), order(x[1]))):
        split = text.split("\n")
        seq = [(k, x, len(WORD.findall(x))) for k, x in enumerate(split) if WORD.search(x)]
        gone = set()
        for a, (_, x, _) in enumerate(seq):
            longest = 0
            for other, b in seen[x]:
                n = 0
                while a + n < len(seq) and b + n < len(other) and seq[a + n][1] == other[b + n][1]:
                    n += 1
                longest = max(longest, n)
            if sum(n for _, _, n in seq[a:a + longest]) >= least:
                gone.update(range(a, a + longest))
            seen[x].append((seq, a))
        places = {seq[a][0] for a in gone}
        out[i, text] = (len(seq), len(gone), sum(a - 1 not in gone for a in gone),
                        "\n".join(x for k, x in enumerate(split) if k not in places))
    return out


def test_line_dedup(docs, rows):
    want = brute_lines(rows)
    got = line_dedup.dedup_lines(docs, report=True).collect()
    assert len(got) == len(rows)
    by_id = defaultdict(list)
    for (i, _), (n, removed, runs, kept) in want.items():
        by_id[i].append((n, removed, runs, hashlib.sha256(kept.encode()).hexdigest()))
    assert sum(x[1] for x in want.values()) > 20
    for r in got:
        assert tuple(r[1:]) in by_id[r.doc_id]
    kept = line_dedup.dedup_lines(docs)
    assert kept.columns == docs.columns
    assert Counter((r.doc_id, r.text or "") for r in kept.collect()) == Counter(
        (r[0], want[r[0], r[1] or ""][3]) for r in rows)


def test_line_dedup_longer_runs(spark):
    """A run of many short lines is found by doubling."""
    run = "\n".join("abcdefghij")
    rows = [(1, "zz\n" + run + "\nyy"), (2, "xx\n" + run), (3, run + "\nww"), (4, "a\nb\nc")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(df, min_words=9).collect()}
    assert got == {1: rows[0][1], 2: "xx", 3: "ww", 4: rows[3][1]}


def test_line_dedup_whole_runs(spark, docs, rows):
    """The short last lines of a repeated run go with it."""
    run = "a line of ten words that stands in two documents\ntwo words"
    some = [(1, run + "\nq"), (2, "x\n" + run + "\ny"), (3, run), (4, "a b c\nd e\nf"), (5, "a b c\nd e\nf\ng"), (6, "two words")]
    df = spark.createDataFrame(some, "doc_id long, text string")
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(df).collect()}
    assert got == {1: some[0][1], 2: "x\ny", 3: "", 4: some[3][1], 5: "g", 6: "two words"}
    rng = random.Random(4)
    lines = [" ".join("abcdefg"[rng.randrange(7)] for _ in range(n)) for n in (1, 1, 1, 2, 2, 3, 4, 5, 9)]
    more = [(i, "\n".join(rng.choice(lines) for _ in range(rng.randint(1, 12)))) for i in range(60)]
    for df, r0 in ((docs, rows), (spark.createDataFrame(more, "doc_id long, text string"), more)):
        want = brute_lines(r0)
        kept = line_dedup.dedup_lines(df).collect()
        assert Counter((r.doc_id, r.text or "") for r in kept) == Counter((r[0], want[r[0], r[1] or ""][3]) for r in r0)


def test_line_dedup_of_many_lines(spark):
    """Two copies of 80,000 short lines: linear in the lines."""
    text = "\n".join(f"a b c {i}" for i in range(80_000))
    df = spark.createDataFrame([(1, text), (2, text + "\nlast one")], "doc_id long, text string")
    start = time.time()
    got = {r.doc_id: (r.n_lines, r.n_removed, r.n_runs) for r in line_dedup.dedup_lines(df, report=True).collect()}
    assert got == {1: (80_000, 0, 0), 2: (80_001, 80_000, 1)} and time.time() - start < 60


def brute_windows(rows, size=50):
    seen, out = {}, {}
    docs = sorted({(r[0], r[1] or "") for r in rows}, key=lambda x: key(x[0]))
    for i, text in docs:
        b = text.encode()
        for a in range(len(b) - size + 1):
            w = b[a:a + size]
            if w not in seen or key(i) < key(seen[w]):
                seen[w] = i
    for i, text in docs:
        b = text.encode()
        gone = np.zeros(len(b), bool)
        for a in range(len(b) - size + 1):
            if key(seen[b[a:a + size]]) < key(i):
                gone[a:a + size] = True
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        out[i, text] = (len(b), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()), kept)
    return out


def as_rows(df):
    return Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256, bytes(r.kept)) for r in df.collect())


def test_suffix_dedup(docs, rows):
    want = brute_windows(rows)
    assert sum(x[1] for x in want.values()) > 500
    expected = Counter((r[0], *w[:3], hashlib.sha256(w[3]).hexdigest(), w[3]) for r in rows for w in [want[r[0], r[1] or ""]])
    assert as_rows(suffix_dedup.remove_repeats(docs, with_kept=True)) == expected
    # every shared anchor counts as hot: the way around large buckets
    assert as_rows(suffix_dedup.remove_repeats(docs, with_kept=True, hot_docs=1)) == expected


def test_suffix_dedup_of_periodic_texts(spark, monkeypatch):
    """Strings without an end, and parts and slices of a few windows."""
    monkeypatch.setattr(suffix_dedup, "SLICE", 40)
    monkeypatch.setattr(suffix_dedup, "PART", 300)
    rng = random.Random(7)
    texts = ["a" * 300, "b" + "a" * 200, "ab" * 150, "xy" + "ab" * 60 + "q" * 90, "q" * 60, "abc" * 80 + "a" * 55, "ab" * 150]
    texts += ["".join(rng.choice("ab") for _ in range(30)) * 6 for _ in range(6)] + ["z" * 49, "z" * 50, "", None]
    rows = [(rng.randrange(1000), t) for t in texts * 2]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    want = brute_windows(rows)
    expected = Counter((r[0], *w[:3], hashlib.sha256(w[3]).hexdigest(), w[3]) for r in rows for w in [want[r[0], r[1] or ""]])
    for hot in (1, 4096):
        assert as_rows(suffix_dedup.remove_repeats(df, with_kept=True, hot_docs=hot)) == expected


def test_suffix_dedup_memory_of_near_copies():
    """Cutting hot strings of 10,000 near copies holds one slice at a time."""
    import pyarrow as pa

    rng = random.Random(3)
    base = [f"word{rng.randrange(900)}" for _ in range(90)]
    texts = []
    for i in range(10_000):
        words = list(base)
        words[rng.randrange(90)] = f"own{i}"
        texts.append(" ".join(words))
    anchors = suffix_dedup.Anchors([t.encode() for t in texts])
    counts = np.bincount(anchors.text, minlength=len(texts))
    marks = [[(np.arange(n, dtype="<u4") | suffix_dedup.HOT_MARK).tobytes()] for n in counts]
    del anchors
    batch = pa.record_batch([pa.array(range(len(texts)), pa.int64()), pa.array(range(len(texts)), pa.int64()), pa.array(texts),
                             pa.array(marks, pa.list_(pa.binary()))], names=["ord", "text_hash", "text", "marks"])
    size = sum(map(len, texts))
    tracemalloc.start()
    n = sum(1 for _ in suffix_dedup._emit_runs(16)(iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert size > 5e6 and n > 3 and peak < 250e6, peak


def fingerprint(text):
    words = WORD.findall(lower(text or ""))
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i:i + 3]).encode(), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints):
    """fingerprints -> fingerprint -> a name of its component."""
    left, name = set(prints), {}
    while left:
        todo = [left.pop()]
        group = set(todo)
        while todo:
            x = todo.pop()
            near = {y for y in left if bin(x ^ y).count("1") <= 3}
            left -= near
            group |= near
            todo += near
        for x in group:
            name[x] = min(group)
    return name


def test_simhash(docs, rows):
    prints = {(r[0], r[1]): fingerprint(r[1]) for r in rows}
    name = brute_components(prints.values())
    least = {}
    for (i, _), x in prints.items():
        c = name[x]
        if i is not None:
            least[c] = min(i, least.get(c, i))
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == len(rows)
    want = Counter((r[0], prints[r[0], r[1]], least.get(name[prints[r[0], r[1]]])) for r in rows)
    assert Counter((r.doc_id, r.fp % (1 << 64), r.component_id) for r in got) == want
    kept = simhash.deduplicate(docs)
    assert kept.columns == docs.columns
    assert Counter(name[fingerprint(r.text)] for r in kept.collect()) == Counter(set(name.values()))


def test_simhash_links(spark):
    """Random fingerprints at 0 to 5 bits, and a bucket over the limit."""
    rng = np.random.default_rng(8)
    base = [int(x) for x in rng.integers(0, 1 << 63, 60)]
    prints = set(base)
    for x in base:
        for bits in range(1, 6):
            y = x
            for b in rng.choice(64, bits, replace=False):
                y ^= 1 << int(b)
            prints.add(y)
    hub = int(rng.integers(0, 1 << 63))
    prints |= {hub ^ (1 << a) ^ (1 << b) for a in range(22) for b in range(22, 30)} | {hub}
    signed = [(x - (1 << 64) if x >> 63 else x,) for x in sorted(prints)]
    links = [(r.a % (1 << 64), r.b % (1 << 64)) for r in
             simhash.fingerprint_links(spark.createDataFrame(signed, "fp long").repartition(4)).collect()]
    assert all(0 < bin(a ^ b).count("1") <= 3 for a, b in links)
    name = {x: x for x in prints}

    def find(x):
        while name[x] != x:
            x = name[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        name[max(a, b)] = min(a, b)
    assert {x: find(x) for x in prints} == brute_components(prints)


def brute_base(text):
    text = text or ""
    words, out = WORD.findall(text), set()
    grams = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    count = Counter(grams)
    for i, g in enumerate(grams):
        if count[g] > 1:
            out |= {i, i + 1, i + 2}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(out),
            len(words) < 50 or 100 * len(out) > 50 * len(words))


def test_quality_rules(docs, rows):
    got = quality_rules.quality_rules(docs, max_docs=1, max_share=0.01).collect()
    base = {(r[0], r[1]): brute_base(r[1]) for r in rows}
    assert Counter(tuple(r[:7]) for r in got) == Counter((r[0], *base[r[0], r[1]]) for r in rows)
    norm = lambda x: " ".join(WORD.findall(x)).lower()
    texts, count = defaultdict(set), defaultdict(set)
    for r in rows:
        texts[r[3]].add(r[1] or "")
        for x in (r[1] or "").split("\n"):
            if WORD.search(x):
                count[r[3], norm(x)].add(r[1])
    want = Counter()
    for r in rows:
        common = [x for x in (r[1] or "").split("\n") if WORD.search(x)
                  and len(count[r[3], norm(x)]) > max(1, 0.01 * len(texts[r[3]]))]
        lost = sum(len(WORD.findall(x)) for x in common)
        want[r[0], len(common), lost, not base[r[0], r[1]][5] and 2 * lost <= base[r[0], r[1]][0]] += 1
    assert Counter((r.doc_id, r.removed_lines, r.removed_words, r.kept) for r in got) == want
    assert sum(k[1] for k in want) > 10


def test_quality_rules_remaining_text(docs, rows):
    got = quality_rules.quality_rules(docs, max_docs=1, max_share=0.01, with_text=True).collect()
    plain = quality_rules.quality_rules(docs, max_docs=1, max_share=0.01).collect()
    assert Counter(tuple(r[:10]) for r in got) == Counter(map(tuple, plain))
    texts = defaultdict(set)
    for r in rows:
        texts[r[0]].add(r[1])
    left = Counter()
    for r in got:
        # the text that has these lines at these places, and loses them alone
        whole = [t for t in texts[r.doc_id] if "\n".join(
            x for k, x in enumerate((t or "").split("\n")) if k not in set(r.removed)) == (r.remaining or "")]
        assert whole and len(r.removed) == r.removed_lines
        lost = [sum(len(WORD.findall((t or "").split("\n")[k])) for k in r.removed) for t in whole]
        assert r.removed_words in lost
        left[r.remaining is None] += 1
    assert left[True] == sum(r[1] is None for r in rows) and any(r.removed for r in got)


def test_repeated_windows(spark):
    texts = ["a b c a b c", "a a a a a", "a b c d", "a b", "a b c x a b c x a b c", ""]
    df = spark.createDataFrame([(i, t, None) for i, t in enumerate(texts)], "doc_id long, text string, source string")
    assert [r.n_repeat_words for r in quality_rules.base_rules(df).orderBy("doc_id").collect()] == [
        brute_base(t)[4] for t in texts]


def test_licenses(spark, docs, rows):
    texts = [
        "Released under the MIT License.", "under the mit license UNDER THE MIT LICENSE", "under the mit licenses",
        "Licensed under the Apache License, Version 2.0.", "Licensed under CC BY-NC 4.0.",
        "This work is licensed under the GNU General Public License, version 3.",
        "This work is licensed under the GNU General Public License, version 4, section 3.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files, to deal in the Software without restriction", "no wording", "", None,
        "licensed under the GNU General Public License as published by the Free Software Foundation, either version 3",
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = licenses.scan_licenses(df).orderBy("doc_id").collect()
    assert [(r.base_labels, r.labels) for r in got] == [
        ("mit", "mit"), ("mit", "mit"), ("", ""), ("apache-2", "apache-2"), ("cc-by-nc", "cc-by-nc"), ("", "gpl-3"), ("", ""),
        ("", "mit"), ("", ""), ("", ""), ("", ""), ("", "gpl-3")]
    assert [(r.n_base, r.first_word, r.last_word) for r in got[:4]] == [(1, 1, 1), (2, 0, 4), (0, None, None), (1, 3, 3)]
    assert got[0].score == licenses.NOTICE and 0 < got[6].score < licenses.NOTICE and got[8].score == 0.0
    word = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    assert Counter((r.doc_id, r.n_words) for r in licenses.scan_licenses(docs).collect()) == Counter(
        (r[0], len(word.findall(lower(r[1] or "")))) for r in rows)


def filled(template, rng, with_optional):
    """A text of a template: regions filled in, marks and case thrown in."""
    text = re.sub(r"\[\[(.*?)\]\]", lambda m: m[1] if with_optional else "", template)
    text = re.sub(r"<<(\d+)-(\d+)>>", lambda m: " ".join(f"Holder{rng.randrange(99)}" for _ in range(rng.randint(int(m[1]), int(m[2])))), text)
    return " ".join(w.upper() if rng.random() < 0.2 else w + rng.choice(["", ",", ".", "\n"]) for w in text.split())


def test_whole_licenses():
    """Each whole text by its own label; with one mandatory word changed or
    gone, or a region too long, no longer whole."""
    rng, scanner = random.Random(5), licenses.Scanner()
    assert len({label for label, _ in licenses.WHOLE_TEXTS}) >= 8
    for label, template in licenses.WHOLE_TEXTS:
        for with_optional in (True, False):
            text = filled(template, rng, with_optional)
            *_, labels, score = scanner.scan("Some words. " + text + " and more")
            assert score == 1.0 and label in labels.split(","), label
            assert "bsd" not in labels.split(",") and (label == "isc" or "isc" not in labels.split(","))
            words = text.split()
            fixed = [i for i, w in enumerate(words) if "holder" not in w.lower()]
            for i in rng.sample(fixed[5:-5], 12):
                for changed in (words[:i] + ["otherwise"] + words[i + 1:], words[:i] + words[i + 1:]):
                    if label in scanner.scan(" ".join(changed))[5].split(","):
                        # an optional word, or what is left is a notice
                        assert scanner.scan(" ".join(changed))[6] in (1.0, licenses.NOTICE)
            long = re.sub(r"(?i)holder\d+", "x " * 20, text, count=1)
            if long != text:
                assert scanner.scan(long)[6] < 1.0
    three = filled(dict(licenses.WHOLE_TEXTS)["bsd-3-clause"], rng, True)
    assert scanner.scan(three)[5] == "bsd-3-clause" and scanner.scan(three.split("either")[0])[5] == "bsd"
    broken = re.sub(r"without\W+warranty", "with warranty", filled(dict(licenses.WHOLE_TEXTS)["mit"], rng, False).lower())
    assert scanner.scan(broken)[5:] == ("mit", licenses.NOTICE)
    gpl = "GNU General Public License, version "
    assert scanner.scan(gpl + "2")[5] == "gpl-2" and scanner.scan(gpl + "2.1")[5] == "" and scanner.scan(gpl + "2.0")[5] == "gpl-2"


def test_license_places_by_brute_force(spark):
    """Base places over words that licenses are made of."""
    rng = random.Random(12)
    words = "under the mit license apache version 2 0 cc by nc MIT License, Version licenses é under the cc by nc".split()
    texts = [rng.choice([" ", "-", ". "]).join(rng.choice(words) for _ in range(rng.randint(0, 400))) for _ in range(150)]
    phrases = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
    word, found = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+"), 0
    got = {r.doc_id: r for r in licenses.scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, text in enumerate(texts):
        ws = word.findall(lower(text))
        places = [(a, label) for p, label in phrases.items() for a in range(len(ws)) if ws[a:a + len(p.split())] == p.split()]
        at = [a for a, _ in places]
        assert (got[i].n_words, got[i].n_base, got[i].first_word, got[i].last_word, got[i].base_labels) == (
            len(ws), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places})))
        found += len(at)
    assert found > 100


def test_license_places_in_linear_time():
    scanner = licenses.Scanner()
    start = time.time()
    n, n_base, first, last, *_ = scanner.scan("cc by nc " * 200_000)
    assert (n, n_base, first, last) == (600_000, 200_000, 0, 599_997) and time.time() - start < 10


def test_template_markup():
    a = licenses.compile_template("x", "one [[two [[three]]]] <<1-2>> four")
    for text, ok in (("one two three z four", True), ("one z four", True), ("one two z y four", True), ("one four", False),
                     ("one three z y x four", False), ("one z z z four", False)):
        assert (a.run(text.encode().split(), 0)[0] is not None) == ok, text
    for bad in ("[[a", "a]]", "<<1-2>>", "a <<2-1>>"):
        try:
            licenses.compile_template("x", bad)
        except ValueError:
            continue
        assert bad is None


def check_pieces(pieces, ids):
    """Pieces -> a fault, or none: every id once, sequences without gaps."""
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
        by_sequence[p.sequence_id].append(p)
    for doc, own in by_doc.items():
        data = [np.array(x, "<u4") for x in ids[doc]]
        assert sum(p.length for p in own) == sum(x.size for x in data)
        if len(data) == 1:
            at = 0
            for p in sorted(own, key=lambda p: p.start):
                assert p.start == at and p.doc_tokens == data[0].size
                assert zlib.crc32(data[0][at:at + p.length].tobytes()) == p.ids_crc32
                at += p.length
    for own in by_sequence.values():
        at = 0
        for p in sorted(own, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 4096 and (at == 4096 or at & (at - 1) == 0)


def test_packing(docs, rows):
    from tokenizers import Tokenizer

    full = Tokenizer.from_file(TOKENIZER)
    ids = defaultdict(list)
    for r in rows:
        ids[r[0]].append(full.encode(r[1] or "", add_special_tokens=False).ids + [2])
    check_pieces(packing.pack_documents(docs, TOKENIZER).collect(), ids)


def test_token_ids():
    from tokenizers import Tokenizer

    full, own = Tokenizer.from_file(TOKENIZER), packing.CachedTokenizer(TOKENIZER, cache=8)
    texts = ["It's a test'sT isn't 've", "<|endoftext|>", "a<|endoftext|>b x", "naïve Straße ÀÉ ẞ İ",
             "  ", "", None, "\x1c\x1d a\x85b\xa0c", "é Éx", "１２ 3", "\U0001f44d\U0001f3fd ok", "ΑΣ ΟΣ.",
             "x" * 5000, "'re're", "don’t 12.5%", "abc​def", "1a2b c--d ###!! ªº×÷", "\x00nul"]
    want = [np.array(full.encode(t or "", add_special_tokens=False).ids + [2], "<u4").tobytes() for t in texts]
    assert list(own.ids(texts)) == want


def test_pack_limits():
    """Every limit holds, all tokens are placed once."""
    rng = np.random.default_rng(2)
    examples = [(int(t), int(rng.integers(0, t + 1))) for t in rng.integers(1, 900, 300)] + [(1, 0)] * 200 + [(5000, 5000), (0, 0)]
    limits = packing.Limits(tokens=512, segments=12, loss=300)
    placed, sequences = defaultdict(list), list(packing.pack(examples, limits))
    for s in sequences:
        assert len(s) <= 12 and sum(p[2] for p in s) <= 512
        assert sum(packing.loss_of(p[1], p[2], *examples[p[0]]) for p in s) <= 300
        for i, start, length in s:
            placed[i].append((start, length))
    for i, (tokens, _) in enumerate(examples):
        at = 0
        for start, length in sorted(placed[i]):
            assert start == at
            at += length
        assert at == tokens


def test_loss_limit_binds():
    """Answers alone would pass the limit: instructions of others fill the
    sequences, which stay full; large examples do not wait for the last."""
    rng = np.random.default_rng(3)
    examples = [(int(t), int(t * 0.93)) for t in rng.integers(20, 900, 4000)] + [(50_000, 49_990)] * 3
    limits, bound = packing.Limits(), 0
    sequences = list(packing.pack(examples, limits))
    for s in sequences[:-1]:
        loss = sum(packing.loss_of(p[1], p[2], *examples[p[0]]) for p in s)
        assert sum(p[2] for p in s) == limits.tokens and loss <= limits.loss
        bound += loss == limits.loss
    assert len(sequences) == -(-sum(t for t, _ in examples) // limits.tokens) and bound > len(sequences) // 4
    assert sum(p[2] for s in sequences for p in s) == sum(t for t, _ in examples)


def test_loss_bearing_tokens():
    """The first line's ids bear no loss, by the tokenizer's own count."""
    from tokenizers import Tokenizer

    full, own = Tokenizer.from_file(TOKENIZER), packing.CachedTokenizer(TOKENIZER)
    texts = ["Say it twice\nit it\nmore", "one line only", "\nanswer", "It's naïve ẞ\n’tis", "", None, "a\n", "\n"]
    for text, (ids, free) in zip(texts, own.examples(texts)):
        first = (text or "").split("\n")[0] if "\n" in (text or "") else ""
        assert free == max(1, len(full.encode(first, add_special_tokens=False).ids)), text
        assert free <= len(ids) // 4


def test_packing_over_batches(spark, docs, rows):
    """Short sequences of a batch go on in the next one: where the loss limit
    is idle, only the last of all is split, into one piece a power of two."""
    from tokenizers import Tokenizer

    full, ids = Tokenizer.from_file(TOKENIZER), defaultdict(list)
    for r in rows:
        ids[r[0]].append(full.encode(r[1] or "", add_special_tokens=False).ids + [2])
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, "3")
    try:
        pieces = packing.pack_documents(docs.coalesce(1), TOKENIZER, with_ids=True).collect()
        idle = packing.pack_documents(docs.coalesce(1), TOKENIZER, packing.Limits(loss=4096)).collect()
    finally:
        spark.conf.set(key, before)
    check_pieces(pieces, ids)
    check_pieces(idle, ids)
    used = defaultdict(int)
    for p in pieces:
        assert len(p.ids) == p.length and 0 <= p.loss_tokens <= p.length
        used[p.sequence_id] += p.loss_tokens
    assert max(used.values()) <= packing.MAX_LOSS
    short = {p.sequence_id for p in idle if p.sequence_tokens < 4096}
    assert len(short) <= 12


def test_empty_tables(no_docs):
    assert line_dedup.dedup_lines(no_docs).columns == no_docs.columns
    for df in (line_dedup.dedup_lines(no_docs, report=True), suffix_dedup.remove_repeats(no_docs), simhash.near_duplicates(no_docs),
               simhash.deduplicate(no_docs), quality_rules.quality_rules(no_docs), licenses.scan_licenses(no_docs),
               packing.pack_documents(no_docs, TOKENIZER)):
        assert df.count() == 0
