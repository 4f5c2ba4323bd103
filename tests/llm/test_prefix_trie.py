"""The conversation trie against a plain one."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import pytest

from sightline.llm import prefix_trie as pt

SCHEMA = "conv_id long, turn long, role string, text string, depth string, part string, key string, size string"


def plain(rows):
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            convs[c].append((turn is not None, turn or 0, hashlib.sha256(f"{len(role or '')}:{role or ''}{text or ''}".encode()).digest()[:16], (role or "", text or "")))
    own = {c: [t[3] for t in sorted(ts)] for c, ts in convs.items()}
    built = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        built[c] = own.get(c - c % 5, [])[:h] + ts[h:]
    members, ends = defaultdict(list), defaultdict(list)
    for c, ts in built.items():
        for d in range(len(ts) + 1):
            members[tuple(ts[:d])].append(c)
        ends[tuple(ts)].append(c)
    kids = Counter(n[:-1] for n in members if n)
    leaves, saved = Counter(), Counter()
    for n, m in members.items():
        for d in range(len(n) + 1):
            leaves[n[:d]] += not kids[n]
            saved[n[:d]] += (len(m) - 1) * (len(n[-1][1].encode()) if n else 0)
    return Counter(
        (min(m), len(n), min(members[n[:-1]]) if n else None, len(m), kids[n], leaves[n], saved[n], hashlib.sha256(",".join(map(str, sorted(ends[n]))).encode()).hexdigest())
        for n, m in members.items()
    )


def built(spark, rows, per=20_000):
    df = spark.createDataFrame([(*r, *["clash"] * 4) for r in rows], SCHEMA)
    return Counter(tuple(r) for r in pt.trie(pt.branched(pt.sequences(df)), turns_per_part=per).collect())


def talk(rng, n, longest=12):
    rows = []
    for c in range(n):
        line = rng.randrange(3)
        for t in range(rng.randrange(1, longest)):
            rows.append((c, t, rng.choice(["user", None]) if rng.random() < 0.1 else "user", f"t{line if rng.random() < 0.8 else rng.randrange(9)} é" if t else "same start"))
    return rows


@pytest.mark.parametrize("per", [20_000, 60, 9])
def test_equals_plain_trie(spark, per):
    rows = talk(random.Random(per), 60)
    assert built(spark, rows, per) == plain(rows)


def test_hot_conversation_in_many_ranges(spark):
    rows = [(5 * c, t, "user", f"turn {t}") for c in range(120) for t in range(3)]
    rows += [(1000 + c, t, "user", f"turn {t}" if t < 3 else f"end {c}") for c in range(40) for t in range(4)]
    assert built(spark, rows, 40) == plain(rows)


def test_awkward_rows(spark):
    rows = [(0, None, "user", "first"), (0, 1, None, None), (0, 2, "", ""), (0, 2, "", ""), (1, 0, "user", "x"), (2, 5, "user", None)]
    rows += [(7, 1, "a", "same turn"), (7, 1, "b", "same turn"), (7, 1, "a", "same turn"), (None, 0, "user", "no conversation"), (9, 0, "", "")]
    rows += [(10, t, "user", "long " * 2000 if t % 7 == 0 else "s") for t in range(400)] + [(11, t, "user", "s") for t in range(50)]
    rows += [(1234567, 0, "r", "te"), (1234568, 0, "rt", "e"), (-7, 0, "user", "x"), (-6, 0, "user", "y")]
    for per in (20_000, 30):
        got = built(spark, rows, per)
        # In Spark as in SQL, -7 % 5 is -2.
        odd = [r for r in rows if r[0] is None or r[0] >= 0] + [r for r in rows if r[0] is not None and r[0] < 0]
        assert sum(got.values()) and max(r[1] for r in got) == 400
        assert built(spark, odd, per) == got
    kept = [r for r in rows if r[0] is None or r[0] >= 0]
    assert built(spark, kept, 30) == plain(kept)


def test_turnless_and_empty(spark):
    lone = [(c, 0, "user", "only") for c in (1, 2, 3, 4, 6)]
    assert built(spark, lone) == plain(lone)
    assert built(spark, []) == Counter()


def test_merge_of_runs():
    rng = random.Random(1)
    for k in range(1, 9):
        rows = [(b"".join(bytes([rng.randrange(2)]) * 16 for _ in range(rng.randrange(6))), i, None) for i in range(70)]
        rows = [(key, i, list(range(len(key) // 16))) for key, i, _ in rows]
        runs = [pt._run(rows[i::k], 0) for i in range(k)]
        out = list(pt.merge([pt.Cursor(r) for r in runs]))
        assert [(key, i) for key, i, _, _ in out] == sorted((key, i) for key, i, _ in rows)
        assert all(s == list(range(len(key) // 16)) for key, _, s, _ in out)
        assert [lcp for *_, lcp in out] == [pt.shared_turns(a[0] if n else b"", b[0]) for n, (a, b) in enumerate(zip(out[:1] + out, out))]
