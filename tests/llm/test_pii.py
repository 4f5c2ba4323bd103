"""Personal data against plain patterns, disclosing terms against plain counts."""

import hashlib
import math
import random
import re
from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sightline.llm import pii

from .common import SCHEMA, awkward, empty, frame, simple

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(s):
    d = [int(c) for c in s][::-1]
    return (sum(d[::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])) % 10 == 0


def keeps(kind, s):
    digits = re.sub("[^0-9]", "", s)
    return {"email": lambda: True, "ip": lambda: all(int(x) <= 255 for x in s.split(".")), "card": lambda: 16 <= len(digits) <= 19 and luhn(digits), "phone": lambda: 8 <= len(digits) <= 15}[kind]()


def plain(text):
    return [[m.span() for m in re.finditer(p, text) if keeps(k, m.group())] for k, p in PATTERNS.items()]


@settings(max_examples=1500, deadline=None)
@given(st.lists(st.sampled_from(["a", "B.c", "@", "@@", ".", "..", "-", "_", "1", "25", "256", "0004", "4111 1111-1111 1111", "4111111111111111", "378282246310005", "+", "+1", "(", ")", " ", "  ", "\n", "é", "٣", "x@y.z", "%", "10.0.0.1"]), max_size=14).map("".join))
def test_patterns(text):
    assert pii.find(text) == plain(text)


def test_patterns_are_linear():
    for long in ("a" * 300_000, "1" * 300_000, "@" * 100_000, "1." * 150_000, "+1" * 100_000, "1 " * 150_000, "+1" + " " * 300_000, "a@b" * 50_000, "a@" + "b." * 100_000):
        pii.find(long)


def flagged(texts, reach=8, support=3, remove_bits=1.0, general_bits=2.0):
    """By term: what the whole corpus says of it."""
    n_e, n_g, n_t, n_et, windows = (defaultdict(set) for _ in range(5))
    of = {}
    for row, text in enumerate(texts):
        text = text or ""
        spans = plain(text)
        taken = [x for s in spans for x in s]
        words = [(m.start(), m.group().lower()) for m in re.finditer(r"[^\W_]{3,}", text) if not any(m.start() < e and m.end() > s for s, e in taken)]
        for w in {m.lower() for m in re.findall(r"[^\W_]{3,}", text)}:
            n_t[w].add(row)
        for k, kind in enumerate(spans):
            for s, e in kind:
                value, general = pii.entity(k, text[s:e])
                ent, of[k, value] = (k, value), (k, general)
                near = [w for a, w in words if a < s][-reach:] + [w for a, w in words if a >= e][:reach]
                n_e[ent].add(row), n_g[k, general].add(row)
                for w in near:
                    n_et[ent, w].add(row), windows[ent, w].add(tuple(near))
    out = {}
    for (ent, w), rows in n_et.items():
        if len(windows[ent, w]) < support:
            continue
        doubt = math.log2(len(n_t[w])) - math.log2(len(rows))
        told, may = math.log2(len(texts) * len(rows) / (len(n_e[ent]) * len(n_t[w]))), -math.log2(len(n_g[of[ent]]) / len(texts))
        if doubt <= remove_bits:
            out[w] = "removed"
        elif doubt <= general_bits and told > may:
            out.setdefault(w, "general")
    return out


def expected(texts, **kw):
    terms, out = flagged(texts, **kw), []
    for text in texts:
        text = text or ""
        spans = plain(text)
        taken = [x for s in spans for x in s]
        extra = [(terms[m.group().lower()], *m.span()) for m in re.finditer(r"[^\W_]{3,}", text) if m.group().lower() in terms and not any(m.start() < e and m.end() > s for s, e in taken)]
        base = [f"{k}:{s}:{e}" for k, of in zip(PATTERNS, spans) for s, e in of]
        more = [f"{k}:{s}:{e}" for k, s, e in sorted(extra, key=lambda x: (x[0] != "removed", x[1]))]
        out.append((*map(len, spans), hashlib.sha256(",".join(base).encode()).hexdigest(), ",".join(base + more)))
    return out


def corpus(seed):
    rng = random.Random(seed)
    common = [f"common{chr(97 + i)}" for i in range(20)]
    texts = []
    for i in range(240):
        words = [rng.choice(common) for _ in range(rng.randint(0, 30))]
        if i % 6 == 0:
            words.insert(rng.randint(0, len(words)), "write to Zora.Quill@mail.example.org, Zora Quill of Marlow")
        elif i % 6 == 1:
            words.insert(rng.randint(0, len(words)), rng.choice(["Marlow", "other@mail.example.org", "call +49 151 2345678 Brandt", "host 10.1.2.3 gateway7"]))
        elif i % 6 < 4:
            words.append(f"u{i}@mail.example.org")
        elif i % 6 == 4 or i % 12 == 5:
            words.insert(0, "Zora")
        texts.append(" ".join(words))
    return texts + texts[:20] + [None, "", "4111 1111 1111 1111"] * 2


@pytest.mark.parametrize("seed", [1, 2])
def test_terms_equal_plain_counts(spark, seed):
    texts = corpus(seed)
    got = sorted(tuple(r) for r in pii.scan(simple(spark, list(enumerate(texts)))).collect())
    assert got == sorted((i, *x) for i, x in enumerate(expected(texts)))
    actions = set(flagged(texts).values())
    assert actions == {"removed", "general"}


def test_copies_are_one_piece_of_evidence(spark):
    texts = ["mail rare words zzyzx@mail.example.org odd ones here"] * 50 + ["plain text"] * 50
    assert all("removed" not in r.spans and "general" not in r.spans for r in pii.scan(simple(spark, list(enumerate(texts)))).collect())


def test_sanitised_texts(spark):
    texts = corpus(1)
    docs = simple(spark, list(enumerate(texts)))
    out = pii.sanitise(docs)
    assert out.columns == docs.columns
    new = {r.doc_id: r.text for r in out.collect()}
    assert len(new) == len(texts) and new[len(texts) - 3] is None and new[len(texts) - 2] == "" and new[len(texts) - 1] == "[card]"
    for i, (*_, spans) in enumerate(expected(texts)):
        want, at = "", 0
        for s, e, kind in sorted((int(x.split(":")[1]), int(x.split(":")[2]), x.split(":")[0]) for x in spans.split(",") if x):
            if s >= at:
                want += texts[i][at:s] + ("[removed]" if kind == "removed" else "[Name]" if kind == "general" and texts[i][s].isupper() else "[code]" if kind == "general" and "7" in texts[i][s:e] else "[word]" if kind == "general" else f"[{kind}]")
            at = max(at, e)
        assert texts[i] is None or new[i] == want + texts[i][at:]


def test_awkward_rows(spark):
    rows = awkward()
    got = sorted((r[1:] for r in pii.scan(frame(spark)).collect()))
    assert got == sorted(expected([r[1] for r in rows]))
    assert pii.scan(empty(spark)).collect() == [] and pii.sanitise(empty(spark)).collect() == []
    assert pii.sanitise(frame(spark)).schema == SCHEMA
