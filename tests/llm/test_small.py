"""Operators on small and awkward tables, each against a plain statement of its result."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from sightline.llm import exact_dedup, langid, licenses, mixing, packing, quality_rules, warc, weak_labels
from sightline.llm.workspace import Workspace

from .common import FRENCH, PROSE, WORD, awkward, empty, frame, simple

# ---- 1 ---------------------------------------------------------------------------------


def test_langid_awkward(spark):
    df = frame(spark)
    model = langid.fit(df.filter("lang IS NOT NULL"))
    got = langid.predict(df, model)
    assert got.columns == [c for c in df.columns if c not in ("lang_pred", "score")] + ["lang_pred", "score"]
    rows = got.select("doc_id", "text", "lang_pred", "score").collect()
    assert len(rows) == len(awkward())
    for r in rows:
        letter = any(c.isalpha() for c in r.text or "")
        assert (r.lang_pred == "und") == (not letter) and 0 <= r.score <= 1
    by = {r.doc_id: r.lang_pred for r in rows}
    assert by[1] == "en" and by[4] == "fr" and by[14] == "fr"
    none = langid.predict(df, langid.fit(df.limit(0)))
    assert {r.lang_pred for r in none.collect()} == {"und"}
    assert langid.predict(empty(spark), model).count() == 0


def test_langid_needs_a_letter(spark):
    texts = ["\u0301\u0301", "a\u0301", "\u0661\u0662", "\u20e3", "\U0001f600", "\U00010400", "\u4e2d", "_", "\u00aa"]
    model = langid.fit(frame(spark))
    got = {r.text: r.lang_pred for r in langid.predict(simple(spark, list(enumerate(texts))), model).collect()}
    assert {t for t, x in got.items() if x == "und"} == {t for t in texts if not any(c.isalpha() for c in t)}
    with pytest.raises(ValueError):
        langid.fit(frame(spark), max_langs=1)


def test_langid_scores_are_naive_bayes(spark):
    docs = [(i, (PROSE if i % 2 else FRENCH)[i : i + 40], "en" if i % 2 else "fr") for i in range(40)]
    df = simple(spark, docs)
    model = langid.fit(df, orders=(2,), bits=12)
    table = langid._letters()

    def grams(t):
        (h,), _, _ = langid._ngrams([t], table, (2,), 12)
        return [x for x in h.tolist() if x < 1 << 12]

    counts = {l: Counter(g for _, t, x in docs if x == l for g in grams(t)) for l in ("en", "fr")}
    for r in langid.predict(df, model).collect():
        logs = {l: math.log(0.5) + sum(math.log((counts[l][g] + 0.5) / (counts[l].total() + 0.5 * 4096)) for g in grams(r.text)) for l in counts}
        best = max(sorted(logs), key=logs.get)
        assert r.lang_pred == best
        assert r.score == pytest.approx(1 / sum(math.exp(v - logs[best]) for v in logs.values()), abs=1e-9)


def test_langid_held_out_accuracy(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = langid.query(spark, sf).join(docs.select("doc_id", "lang"), "doc_id").collect()
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
    held = [r for r in got if r.held_out]
    assert sum(r.lang == r.lang_pred for r in held) >= 0.97 * len(held)


# ---- 2 ---------------------------------------------------------------------------------


def test_weak_labels(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = weak_labels.quality(docs).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").collect()
    good, bad = [r.score for r in got if r.quality == 1], [r.score for r in got if r.quality == 0]
    wins = sum(g > b for g in good for b in bad) / (len(good) * len(bad))
    assert wins > 0.95
    assert np.mean([r.kept for r in got if r.quality == 1]) > 0.95
    assert weak_labels.quality(frame(spark)).count() == len(awkward())
    assert weak_labels.quality(empty(spark)).count() == 0


def plain_votes(text):
    """The ten votes in plain words."""
    words = WORD.findall(text)
    n, chars = max(len(words), 1), sum(map(len, words))
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    covered = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    function = sum(w in weak_labels.FUNCTION_WORDS for w in re.findall(r"[^\W\d_]+", text.lower()))
    upper, symbols, marks = sum(c.isupper() for c in text), sum(c in "#*$%&|<>" for c in text), sum(c in "!?|" for c in text)
    runs = len(re.findall(r"([^\w\s])\1\1", text))
    length, duplicate = chars / n, 1 - len(set(lines)) / max(len(lines), 1)
    return [
        -1 if bad else 1 if good else 0
        for good, bad in [
            (symbols < 0.02 * n, symbols > 0.2 * n),
            (3.5 < length < 8, length < 2.5 or length > 12),
            (len(covered) < 0.15 * n, len(covered) > 0.5 * n),
            (not lines or duplicate < 0.05, bool(lines) and duplicate > 0.3),
            (50 <= len(words) <= 50_000, len(words) < 10),
            (upper < 0.25 * chars, upper > 0.5 * chars),
            (marks < 0.1 * n, marks > 0.5 * n),
            (len(set(words)) > 0.2 * n, len(set(words)) < 0.1 * n and len(words) >= 50),
            (runs < 0.01 * n, runs > 0.1 * n),
            (function > 0.06 * n, function < 0.01 * n and len(words) >= 30),
        ]
    ]


def test_votes_are_the_plain_ones():
    rng, ballots = random.Random(4), weak_labels.Ballots()
    parts = ["the", "und", "WORT", "a", "b!", "###", "????", "$", "x|y", "\n", "\n\n", "same line here\n", "\U0001f600" * 3, "\U0001d400", "été", "_", "___", "12", "\x1c", "\xa0", "internationalisation", "one two three"]
    texts = [t or "" for _, t, *_ in awkward() if len(t or "") < 9000]
    for _ in range(400):
        some = rng.sample(parts, rng.randint(1, 6))
        texts.append(rng.choice(["", " "]).join(rng.choice(some) + rng.choice(["", " "]) for _ in range(rng.randint(0, 90))))
    for t in texts:
        assert ballots.votes(t) == plain_votes(t), t


def test_em_brute_force():
    """The same numbers as EM row by row."""
    rng = np.random.default_rng(8)
    votes = [[int(x) for x in r] for r in rng.choice([-1, 0, 1], (60, 3), p=[0.2, 0.3, 0.5])]
    post = {i: 0.02 if min(v) < 0 else 0.9 if max(v) > 0 else 0.5 for i, v in enumerate(votes)}
    weight = 0.05 * len(votes)
    for _ in range(7):
        good = sum(post.values())
        prior, mass = good / len(votes), (len(votes) - good, good)
        rates = [[[(sum((post[i] if c else 1 - post[i]) for i, v in enumerate(votes) if v[k] == x) + weight * weak_labels.BELIEF[c][x + 1]) / (mass[c] + weight) for x in (-1, 0, 1)] for k in range(3)] for c in (0, 1)]
        for i, v in enumerate(votes):
            like = [p * math.prod(rates[c][k][v[k] + 1] for k in range(3)) for c, p in ((0, 1 - prior), (1, prior))]
            post[i] = like[1] / sum(like)
    patterns, inverse, counts = np.unique(np.array(votes), axis=0, return_inverse=True, return_counts=True)
    got, found, p = weak_labels.fit_labels(patterns, counts.astype(float), rounds=7, tolerance=0)
    assert got[inverse.ravel()] == pytest.approx([post[i] for i in range(60)]) and found == pytest.approx(np.array(rates)) and p == pytest.approx(prior)


def test_training_rows_need_no_ids(spark):
    """Rows without id, or all with one id, are drawn like others, about as many as asked for."""
    texts = [(PROSE if i % 4 else "### ??? ") + f" word{i}" for i in range(600)]
    for ids in ([None] * 600, [7] * 600):
        model = weak_labels.learn(simple(spark, list(zip(ids, texts))), train_rows=200)
        assert np.count_nonzero(model.scorer.weights) > 100
        scores = [r.score for r in weak_labels.quality(simple(spark, [(0, PROSE), (1, "### ??? ### ???")]), model=model).orderBy("doc_id").collect()]
        assert scores[0] > scores[1]
    none = weak_labels.learn(simple(spark, list(zip(range(600), texts))), train_rows=0)
    assert not none.scorer.weights.any()


def test_em_finds_the_accurate_labeller():
    rng = np.random.default_rng(3)
    truth = rng.random(4000) < 0.8
    draw = lambda recall, alarm: ~np.where(truth, rng.random(4000) < alarm, rng.random(4000) < recall)
    accurate, loose, third = draw(0.9, 0.01), draw(0.4, 0.05), draw(0.8, 0.02)
    votes = np.stack([accurate, loose, third], 1) * 2 - 1
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    post, rates, prior = weak_labels.fit_labels(patterns, counts.astype(float))
    assert rates[1, 0, 2] > rates[1, 1, 2] and rates[0, 0, 0] > rates[0, 1, 0]
    label = {tuple(p): x for p, x in zip(patterns.tolist(), post)}
    assert np.mean([(label[tuple(v)] > 0.5) == t for v, t in zip(votes.tolist(), truth)]) > 0.95


# ---- 3 ---------------------------------------------------------------------------------


def test_licenses(spark):
    s = licenses.SENTENCES
    cases = [
        ("Text.\n" + s["apache2-short"], ["Apache-2.0"]),
        ("heading\nReleased under the MIT license.\nmore", ["MIT"]),
        (s["bsd-grant"] + "\n" + s["bsd-source"].replace(" ", "\n") + " " + s["bsd-binary"], ["BSD-2-Clause"]),
        (" ".join(s[x] for x in ("bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse")), ["BSD-3-Clause"]),
        (s["mit-grant"] + "\n\n" + s["mit-keep"] + "\n\n" + s["mit-asis"], ["MIT"]),
        (s["bsd-source"], []),
        (s["cc-by-nc-4.0-short"] + " " + s["gpl3-short"], ["GPL-3.0-only", "CC-BY-NC-4.0"]),
        ("licensed under nothing", []),
        ("", []),
        (None, []),
        ("LICENSED under the apache   License -- version 2.0", ["Apache-2.0"]),
        ("*" * 1300 + " Licensed under the MIT License.", ["MIT"]),
        ("Licensed" + " -" * 3000 + " under the MIT License.", ["MIT"]),
        ("# Copyright someone\n#\n# " + s["apache2-notice"].replace("you may", "\n# you may") + "\n#\n#     code", ["Apache-2.0"]),
        ("GNU GENERAL PUBLIC LICENSE\n   Version 3, 29 June 2007\n\n Copyright", ["GPL-3.0"]),
        ("a\n\n  GNU LESSER GENERAL PUBLIC LICENSE\n   Version 2.1, February 1999\n\nb", ["LGPL-2.1"]),
        (s["agpl3-later"] + " " + s["lgpl21-later"], ["LGPL-2.1-or-later", "AGPL-3.0-or-later"]),
        (s["cc-by-nc-sa-3.0-work"], ["CC-BY-NC-SA-3.0"]),
        (" ".join(s[x] for x in ("bsd-grant", "bsd-source", "bsd-binary", "bsd-advert")), ["BSD-4-Clause"]),
    ]
    got = {r.doc_id: r for r in licenses.scan_licenses(simple(spark, list(enumerate(t for t, _ in cases)))).collect()}
    for i, (_, want) in enumerate(cases):
        assert got[i].licenses == want, (i, got[i])
        assert got[i].license == (want[0] if want else None)
    assert licenses.scan_licenses(frame(spark)).count() == len(awkward())
    assert licenses.scan_licenses(empty(spark)).count() == 0


def licenses_of(text):
    """The licences of a text, rule by rule."""
    table, found = licenses.sentence_table(), []
    pieces = lambda t, end: [n for n in map(licenses.normalise, re.split(end, t)) if n]
    known = [[table[n] for n in pieces(text or "", end) if n in table] for end in (licenses.SENTENCE_END, licenses.LINE_END)]

    def occurs(rule):
        want = [table[n] for x in rule for n in pieces(licenses.SENTENCES[x], licenses.SENTENCE_END)]
        return any(ids[i : i + len(want)] == want for ids in known for i in range(len(ids)))

    for k, (name, _, rule) in enumerate(licenses.RULES):
        covered = any(other != name and set(rule) < set(longer) and occurs(longer) for other, _, longer in licenses.RULES[:k])
        if occurs(rule) and not covered and name not in found:
            found.append(name)
    return found


def test_licenses_brute_force(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    rng, known = random.Random(5), list(licenses.SENTENCES.values())
    for i in range(60):
        docs.append((10_000 + i, rng.choice([" ", "\n", "\n#\n# "]).join(rng.choice(known) for _ in range(rng.randint(1, 6)))))
    got = {r.doc_id: r.licenses for r in licenses.scan_licenses(simple(spark, docs)).collect()}
    assert all(got[i] == licenses_of(t) for i, t in docs)


# ---- 4 ---------------------------------------------------------------------------------


def dedup_model(rows):
    groups = defaultdict(list)
    for k, (i, t, *_) in enumerate(rows):
        groups[(t or "").translate(dict.fromkeys(map(ord, " \t\n\x0b\x0c\r")))].append((-len(t or ""), i is None, i or 0, k))
    keep = {}
    for norm, g in groups.items():
        best = min(g)
        for x in g:
            keep[x[3]] = (None if best[1] else best[2], len(g), hashlib.sha256(norm.encode()).hexdigest())
    return keep


@pytest.mark.parametrize("support", [0.001, 0.3])
def test_exact_dedup(spark, support):
    rows = awkward() + [(100 + i, "hot  text", "en", "a", 1, *["clash"] * 11) for i in range(50)]
    got = exact_dedup.exact_dedup(frame(spark, rows), support=support).collect()
    want = Counter((r[0], *dedup_model(rows)[k]) for k, r in enumerate(rows))
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == want
    assert sum(r.kept for r in got) == len({r.text_sha256 for r in got})
    assert all(r.doc_id == r.keep_id for r in got if r.kept)
    kept = exact_dedup.keep_first(frame(spark, rows), support=support)
    assert kept.columns == frame(spark).columns
    assert Counter((r.doc_id, len(r.text or "")) for r in kept.collect()) == Counter((r.doc_id, r.text_length) for r in got if r.kept)
    assert exact_dedup.exact_dedup(empty(spark)).count() == 0 and exact_dedup.keep_first(empty(spark)).count() == 0


# ---- 6 ---------------------------------------------------------------------------------


def test_warc_round_trip(spark):
    big, other = "<p>" + "hé " * 600, "<p>" + "no " * 600
    rows = [(1, "http://a/1", big), (9, "http://a/9\r\nX: y", big), (4, None, big), (2, "u", "small"), (3, "u", "small"), (5, "u", None), (6, "u", ""), (7, "u", other), (None, "u", big), (None, "u", "x" * 2000), (None, "v", "x" * 2000)]
    pages = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, digest string").repartition(3)
    path = Workspace(spark, "test").path("warc")
    warc.write_archives(pages, path, train_bytes=2000)
    got = warc.read_archives(spark, path).collect()
    assert len(got) == len(rows)
    seen = Counter()
    for r in got:
        i = None if r.page_id is None else int(r.page_id)
        mine = [h for p, _, h in rows if p == i]
        sizes = {len((h or "").encode()): h or "" for h in mine}
        assert r.payload_bytes in sizes
        html = sizes[r.payload_bytes]
        assert r.digest == hashlib.sha1(html.encode()).hexdigest()
        revisit = html == big and i != 9
        assert r.warc_type == ("revisit" if revisit else "response") and (r.refers_to_page == "9" if revisit else r.refers_to_page is None)
        assert r.payload is None if revisit else bytes(r.payload).decode() == html
        seen[r.record_id] += 1
    # Archives end at their size: more of them, each with its dictionary or none, all rows as before.
    for size in (1, 3000):
        cut = Workspace(spark, "test").path(f"cut{size}")
        many = pages.crossJoin(spark.range(8).select(F.col("id").alias("k"))).withColumn("page_id", F.col("page_id") * 100 + F.col("k")).withColumn("html", F.concat("html", F.sha2(F.concat("k", F.lit("x")), 512))).coalesce(2)
        warc.write_archives(many, cut, train_bytes=4000, archive_bytes=size)
        files = spark.read.format("binaryFile").load(cut).filter("path LIKE '%part-%'").collect()
        assert len(files) == 8 * len(rows) if size == 1 else len(files) > 2
        for f in files:
            found, head = list(warc._split(f.content)), bytes(f.content[:4])
            assert found and head in (warc.DICTIONARY_MAGIC.to_bytes(4, "little"), b"\x28\xb5\x2f\xfd")
            assert size > 1 or len(found) == 1
        whole = Workspace(spark, "test").path(f"whole{size}")
        warc.write_archives(many, whole)
        kept = ["warc_type", "record_id", "page_id", "refers_to", "digest", "payload_bytes", "payload"]
        assert Counter(map(tuple, warc.read_archives(spark, cut).select(*kept).collect())) == Counter(map(tuple, warc.read_archives(spark, whole).select(*kept).collect()))
    none = Workspace(spark, "test").path("warc0")
    warc.write_archives(pages.limit(0), none)
    assert warc.read_archives(spark, none).count() == 0


def test_warc_file_layout(spark, sf):
    path = Workspace(spark, "test").path("warc")
    warc.write_archives(spark.read.parquet(f"{sf}/pages.parquet").coalesce(1), path)
    raw = bytes(spark.read.format("binaryFile").load(path).filter("path LIKE '%part-%'").orderBy(F.desc("length")).first().content)
    assert int.from_bytes(raw[:4], "little") == warc.DICTIONARY_MAGIC
    n = int.from_bytes(raw[4:8], "little")
    import zstandard

    records = list(warc._split(raw))
    plain = zstandard.ZstdCompressor(level=3)
    with_dictionary = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(raw[8 : 8 + n]))
    assert sum(len(with_dictionary.compress(x)) for x in records) < sum(len(plain.compress(x)) for x in records)
    with pytest.raises(ValueError):
        list(warc._split(raw[:-20]))


# ---- 7 ---------------------------------------------------------------------------------

ODD = ["", "  ", "don't stop's IT'LL", "a<|endoftext|>b", "ÀÉÎ ß straße", "x́ é", "ΑΣ ΣΑΣ.", "İstanbul", "日本語 123 4.5", "tab\there\x0bvt\x1csep nbsp", "😀😀!! ok", "\x00nul", "''' 's", "É!!", "q's"]


def test_words_encode_like_whole_texts():
    e = packing.WordEncoder(packing.default_tokenizer())
    texts = ODD + [t for _, t, *_ in awkward() if t]
    want = [np.array(x.ids, "<u4").tobytes() for x in e.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert e.plain and e.encode(texts) == want
    e.plain = False
    e.known.clear()
    e.known[""] = b""
    assert e.encode(texts) == want


def test_packing(spark):
    rows = awkward()
    got = packing.pack(frame(spark), packing.default_tokenizer(), capacity=256, per_part=5).collect()
    tok = packing.WordEncoder(packing.default_tokenizer()).tokenizer
    want = Counter()
    for i, t, *_ in rows:
        ids = tok.encode(t or "", add_special_tokens=False).ids + [1]
        for p, a in enumerate(range(0, len(ids), 256)):
            want[(i, p, a, np.array(ids[a : a + 256], "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, bytes(r.ids)) for r in got) == want
    by = defaultdict(list)
    for r in got:
        assert len(r.ids) == 4 * r.length
        by[r.sequence_id].append((r.offset, r.length))
    for x in by.values():
        at = 0
        for offset, length in sorted(x):
            assert offset == at
            at += length
        assert at <= 256
    sizes = [r.length for r in got]
    assert len(by) >= packing.lower_bound(*np.unique(sizes, return_counts=True), 256)
    assert len(by) <= packing.best_fit_decreasing(np.array(sizes), 256)[2] + 2
    assert packing.pack(empty(spark), packing.default_tokenizer()).count() == 0


def test_bounds_and_exchange(spark):
    rng = random.Random(4)

    def fewest(sizes, cap):
        best = [len(sizes)]

        def place(i, bins):
            if len(bins) >= best[0]:
                return
            if i == len(sizes):
                best[0] = len(bins)
                return
            for k in range(len(bins)):
                if bins[k] + sizes[i] <= cap:
                    bins[k] += sizes[i]
                    place(i + 1, bins)
                    bins[k] -= sizes[i]
            place(i + 1, bins + [sizes[i]])

        place(0, [])
        return best[0]

    for _ in range(150):
        cap = rng.choice([10, 20, 30])
        sizes = sorted((rng.randint(1, cap) for _ in range(rng.randint(1, 8))), reverse=True)
        assert packing.lower_bound(*np.unique(sizes, return_counts=True), cap) <= fewest(sizes, cap) <= packing.best_fit_decreasing(np.array(sizes), cap)[2]
    items = spark.range(2000).select(F.col("id").alias("uid"), (F.pmod(F.xxhash64("id"), F.lit(90)) + 1).alias("length"))
    sizes = np.array([r.length for r in items.collect()])
    one = packing.plan(items, 100, per_part=60)
    assert one.count() == 2000
    bins = one.select("sequence_id").distinct().count()
    assert bins <= packing.best_fit_decreasing(sizes, 100)[2] * 1.02 + 1
    assert {r.t <= 100 for r in one.join(items, "uid").groupBy("sequence_id").agg(F.sum("length").alias("t")).collect()} == {True}


# ---- 8 ---------------------------------------------------------------------------------


def stats_model(t):
    t = t or ""
    w = WORD.findall(t)
    tri = list(zip(w, w[1:], w[2:]))
    c = Counter(tri)
    covered = {j for i, g in enumerate(tri) if c[g] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(x in "#*$%&|<>" for x in t), len(lines) - len(set(lines)), len(covered)


def test_quality_rules(spark):
    rng = random.Random(1)
    vocab = [f"{a}{b}{c}" for a in "abcde" for b in "lmno" for c in ("ing", "er", "tion")]
    rows = [(i, " ".join(rng.choice(vocab) for _ in range(rng.randint(60, 120))), "en", "a") for i in range(200)]
    junk = [(1000 + i, " ".join(rng.choice(vocab) + "***$$" for _ in range(90)), "en", "a") for i in range(10)]
    same = [(2000, "line one here\nline one here\n \nother line\nline one here", "en", "a"), (2001, "a b c d a b c x a b", None, None)]
    df = simple(spark, rows + junk + same).unionByName(frame(spark))
    got = quality_rules.quality_rules(df.select("doc_id", "text", "lang", "source", "kept"), min_group=30).collect()
    texts = {r[0]: r[1] for r in rows + junk + same}
    for r in got:
        if r.doc_id in texts and (r.doc_id >= 1000 or r.doc_id not in {x[0] for x in awkward()}):
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == stats_model(texts[r.doc_id])
            assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        if r.doc_id is not None and 20 <= r.doc_id < 200:
            assert r.kept
        if r.doc_id is not None and 1000 <= r.doc_id < 2000:
            assert not r.kept and not r.base_failed
    assert len(got) == df.count()
    want = Counter(stats_model(t) for _, t, *_ in awkward())
    mine = Counter(tuple(r[1:]) for r in quality_rules.base_stats(frame(spark).select("doc_id", "text")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words").collect())
    assert mine == want
    assert quality_rules.quality_rules(empty(spark).select("doc_id", "text", "lang", "source")).count() == 0


def test_least_determinant_brute_force(spark):
    """On small groups the estimate is that of the subset of least determinant, found by trying all."""
    rng, xs = np.random.default_rng(6), list(quality_rules.FLOORS)
    groups = {}
    for g in range(6):
        x = rng.normal(0, 0.4, (14, 4)) @ rng.normal(0, 1, (4, 4))
        x[:3] += rng.normal(0, 1, (3, 4)) + 6
        groups[f"g{g}"] = x
    fit = spark.createDataFrame([(g, *map(float, r)) for g, x in groups.items() for r in x], "__sl_grp string, " + ", ".join(f"{x} double" for x in xs))
    got = {r["__sl_grp"]: r for r in quality_rules.robust_estimates(fit, xs, 0.75, 10, 1e-9, Workspace(spark, "t")).collect()}
    floors = np.diag([v**2 for v in quality_rules.FLOORS.values()])
    for g, x in groups.items():
        least = min((np.linalg.slogdet(np.cov(x[list(k)].T, bias=True) + floors)[1], k) for k in itertools.combinations(range(14), 11))
        assert got[g]["__sl_n"] == 11 and got[g]["__sl_logdet"] == pytest.approx(least[0], abs=0.05)
        if got[g]["__sl_logdet"] == pytest.approx(least[0], abs=1e-6):
            assert [got[g][f"m{c}"] for c in xs] == pytest.approx(x[list(least[1])].mean(0).tolist(), abs=1e-9)
    assert quality_rules.robust_estimates(fit.limit(0), xs, 0.75, 10, 1e-9, Workspace(spark, "t")).count() == 0


def test_quality_rules_clashing_columns(spark):
    """Columns named like inner ones come through as they are; groups too small for an estimate keep their rows."""
    names = ["grp", "x_word", "m_x_word", "p_0_0", "edge", "d", "n"]
    rows = [(i, " ".join(f"w{(i * 7 + k) % 50}{'abcdefgh'[k % 8]}" for k in range(60)), "en", "a" if i < 60 else "rare", *[f"own{i}"] * 7) for i in range(65)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, " + ", ".join(f"{x} string" for x in names))
    got = quality_rules.quality_rules(df).collect()
    assert len(got) == 65 and all(r[x] == f"own{r.doc_id}" for r in got for x in names)
    few = quality_rules.quality_rules(df.limit(5)).collect()
    assert all(r.distance is None and r.kept == (not r.base_failed) for r in few) and len(few) == 5


def test_concentration_lowers_the_determinant(spark):
    """The robust centre isn't moved by a fifth of far rows, unlike the plain mean."""
    rng = np.random.default_rng(2)
    rows = [("g", 1000 + int(x), 5000 + int(y), 0, 10, 0, 0, False) for x, y in rng.normal(0, 30, (400, 2))] + [("g", 1000, 30000, 900, 10, 0, 0, False)] * 100
    df = spark.createDataFrame(rows, "lang string, n_words long, word_chars long, n_symbols long, n_lines long, n_dup_lines long, n_repeat_words long, base_failed boolean")
    got = quality_rules.outliers(df, ["lang"]).collect()
    assert sum(r.outlier for r in got if r.n_symbols) == 100 and sum(r.outlier for r in got if not r.n_symbols) <= 4


# ---- 9 ---------------------------------------------------------------------------------


def edf(shares):
    cycle, ran, out = sum(shares.values()), dict.fromkeys(shares, 0), []
    for t in range(cycle):
        ready = [(-(-(ran[s] + 1) * cycle // n), s) for s, n in shares.items() if ran[s] * cycle // n <= t]
        _, s = min(ready)
        out.append((s, ran[s]))
        ran[s] += 1
    return out


def test_period_is_earliest_deadline_first(spark):
    rng = random.Random(2)
    for _ in range(4):
        shares = {f"s{i}": rng.randint(1, 40) for i in range(rng.randint(1, 9))}
        df = spark.createDataFrame(list(shares.items()), "source string, share long")
        got = sorted((r.slot, r.source, r.nth) for r in mixing.period(df).collect())
        assert [(s, n) for _, s, n in got] == edf(shares) and [t for t, *_ in got] == list(range(sum(shares.values())))


def test_mixing(spark):
    rng = random.Random(6)
    rows = [(i, "x" * rng.randint(1, 400), "en", rng.choice("aaaaaabbc")) for i in range(900)]
    df = simple(spark, rows).repartition(5)
    got = mixing.pfair_mix(df, block_size=1000, slots=60).collect()
    assert len(got) == 900
    by = defaultdict(list)
    for r in got:
        by[r.source].append(r)
    cycle = 60
    share = {}
    for s, rs in by.items():
        cum = 0
        for r in sorted(rs, key=lambda r: r.place):
            assert r.block == cum // 1000 and r.release <= r.slot < r.deadline
            cum += r.size
        assert sorted(r.place for r in rs) == list(range(len(rs)))
        top = max(rs, key=lambda r: r.block)
        share[s] = next(n for n in range(1, cycle + 1) if all(r.release == r.block * cycle // n and r.deadline == -(-(r.block + 1) * cycle // n) for r in rs)) if top.block else None
    horizon = max(r.slot for r in got if r.mixed) + 1
    for s, n in share.items():
        if n:
            for t in range(1, horizon + 1):
                done = len({r.slot for r in by[s] if r.slot < t})
                assert done < n * t / cycle + 1
    assert all(r.mixed == (r.slot < horizon) for r in got)
    even = mixing.pfair_mix(df, weights={"a": 1, "b": 1}, block_size=1000).collect()
    assert {r.source for r in even if r.mixed} == {"a", "b"} and all(r.slot is None for r in even if r.source == "c")
    odd = mixing.pfair_mix(frame(spark), block_size=100)
    assert odd.count() == len(awkward())
    assert mixing.pfair_mix(empty(spark)).count() == 0
    kept = mixing.keep_mixture(frame(spark), block_size=100)
    assert kept.columns == frame(spark).columns and 0 < kept.count() <= len(awkward())


def test_mixing_goes_on_without_a_source_that_ran_out(spark):
    rows = [(i, "x" * 100, "en", "ab"[i % 2]) for i in range(800)] + [(9000, "tiny", "en", "rare"), (9001, "null source", "en", None)]
    df = simple(spark, rows).repartition(4)
    got = mixing.pfair_mix(df, block_size=500, slots=20).collect()
    assert all(r.mixed for r in got) and mixing.keep_mixture(df, block_size=500, slots=20).count() == len(rows)
    # After the small sources have left, the others still alternate to their equal weights.
    late = sorted({(r.slot, r.source) for r in got if r.source in ("a", "b")})
    for n in range(len(late)):
        assert abs(sum(s == "a" for _, s in late[:n]) - sum(s == "b" for _, s in late[:n])) <= 2
    strict = mixing.pfair_mix(df, block_size=500, slots=20, strict=True).collect()
    assert 0 < sum(r.mixed for r in strict) < len(rows)


def test_sequences_follow_the_mixture(spark):
    from sightline.llm.workspace import Workspace

    rows = [(i, f"word{i % 50} " * 30, "en", "ab"[i % 2]) for i in range(600)]
    source, ws, share = {r[0]: r[3] for r in rows}, Workspace(spark, "test_mixture"), {}
    for a in (0.9, 0.1):
        kept = mixing.keep_mixture(simple(spark, rows), weights={"a": a, "b": 1 - a}, block_size=400, slots=20)
        docs = ws.store(kept, f"kept{int(10 * a)}")
        assert docs.count() == len(rows)
        stored = docs.select("doc_id", packing.stored_order(docs).alias("at")).orderBy("at").collect()
        got = packing.digest(docs, packing.default_tokenizer(), capacity=512, per_part=100, order=packing.stored_order(docs)).collect()
        assert {r.doc_id for r in got} == set(source)
        for at in ([r.doc_id for r in stored[:200]], [r.doc_id for r in sorted(got, key=lambda r: (r.sequence_id, r.offset))[:100]]):
            share.setdefault(a, []).append(sum(source[i] == "a" for i in at) / len(at))
    assert min(share[0.9]) > 0.7 and max(share[0.1]) < 0.3, share
