"""Prefix hashes against plain comparisons, and the edited texts by hand."""

import functools
import hashlib
import random

import pytest

from strandline.llm import fingerprints as fp

DOC = "doc_id long, text string, kind string, place int, mark string"


def frame(spark, rows, parts=4):
    """Rows with columns whose names clash with inner ones."""
    return spark.createDataFrame([(i, t, "k", 1, "m") for i, t in rows], DOC).repartition(parts)


def prefixes(text):
    return fp.Prefixes.of(fp.code_points(text))


@functools.lru_cache(None)
def horner(text):
    """The fingerprint from its definition: length and, for each base, the sum of (code + 1) * base ** place."""
    out = f"{len(text)}:"
    for b in fp.BASES:
        h = 0
        for c in reversed(text):
            h = (h * b + ord(c) + 1) % fp.PRIME
        out += f"{h:08x}"
    return out


def plain_likeness(a, b):
    if len(a) > len(b) or (len(a) == len(b) and horner(a) > horner(b)):
        a, b = b, a
    if not b:
        return 1.0
    head = 0
    while head < len(a) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < len(a) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    inner = b[head : len(b) - tail]
    blocks = [a[i : i + fp.BLOCK] for i in range(head, len(a) - tail - fp.BLOCK + 1, fp.BLOCK)]
    return (head + tail + fp.BLOCK * sum(x in inner for x in blocks)) / len(b)


def plain(rows):
    order = sorted(rows, key=lambda r: -r[0])
    out = []
    for k, (i, t) in enumerate(order):
        t, n = t or "", order[(k + 1) % len(order)][1] or ""
        third = len(t) // 3
        edited = t[: len(t) - third] + n[:third]
        out.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), horner(t), horner(edited), plain_likeness(t, edited), plain_likeness(t, n)))
    return sorted(out)


def text(rng, n, letters="ab"):
    return "".join(rng.choice(letters) for _ in range(n))


@pytest.mark.parametrize("seed", range(4))
def test_spans_and_extensions(seed):
    rng = random.Random(seed)
    a, b = text(rng, 300), text(rng, 250)
    b = b[:100] + a[40:180] + b[100:]
    x, y = prefixes(a), prefixes(b)
    for _ in range(400):
        i, j = rng.randrange(len(a) + 1), rng.randrange(len(b) + 1)
        n = rng.randrange(min(len(a) - i, len(b) - j) + 1)
        assert x.same(i, y, j, n) == (a[i : i + n] == b[j : j + n])
        want = 0
        while i + want < len(a) and j + want < len(b) and a[i + want] == b[j + want]:
            want += 1
        assert x.extension(i, y, j) == want
        back = 0
        while back < min(i, j) and a[i - back - 1] == b[j - back - 1]:
            back += 1
        assert x.extension_back(i, y, j, min(i, j)) == back
    assert x.extension(40, y, 100) >= 140


def test_joined_prefixes_are_those_of_the_joined_text():
    rng = random.Random(9)
    a, b = text(rng, 120, "aé漢😀\0"), text(rng, 80, "xyz\U0010ffff")
    for upto, n in ((0, 0), (120, 80), (77, 13), (0, 80), (120, 0)):
        assert (prefixes(a).followed_by(upto, prefixes(b), n).sums == prefixes(a[:upto] + b[:n]).sums).all()
    assert prefixes(a).fingerprint() == horner(a)
    assert prefixes("").fingerprint() == horner("")


def test_likeness():
    rng = random.Random(2)
    a = text(rng, 900, "abcdefghij")
    for b in (a, a[:500] + "x" + a[500:], a[300:] + a[:300], text(rng, 700, "abcdefghij"), "", a[:1], a * 2, a[:200] + text(rng, 60, "xyz") + a[260:600] + "zz" + a[610:]):
        got = fp.likeness(prefixes(a), prefixes(b))
        assert got == fp.likeness(prefixes(b), prefixes(a)) == plain_likeness(a, b)
        assert 0 <= got <= 1 and (got == 1) == (a == b)


def test_edited_texts(spark):
    rng = random.Random(1)
    rows = [(i * 3, text(rng, rng.randrange(0, 400), "abc é漢😀")) for i in range(120)]
    rows += [(1000 + i, rows[7][1]) for i in range(60)] + [(2000, None), (2001, ""), (2002, "x"), (2003, "xyz"), (-5, "a\0b" * 9), (2004, "long " * 9000), (2005, "long " * 8999 + "other")]
    rng.shuffle(rows)
    for parts in (1, 5):
        got = fp.edited_fingerprints(frame(spark, rows, parts))
        assert got.columns == ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
        assert sorted(tuple(r) for r in got.collect()) == plain(rows)


def test_few_odd_and_repeated_rows(spark):
    assert fp.edited_fingerprints(frame(spark, [])).collect() == []
    assert [tuple(r) for r in fp.edited_fingerprints(frame(spark, [(3, "abcdef")])).collect()] == plain([(3, "abcdef")])
    rows = [(5, "aaaaaa"), (5, "aaaaaa"), (5, None), (None, "zzzzzz"), (4, "bbb"), (4, "bbb")]
    got = fp.edited_fingerprints(frame(spark, rows)).collect()
    assert sorted(r.doc_id is None and -1 or r.doc_id for r in got) == [-1, 4, 4, 5, 5, 5]
    by_id = {r.doc_id: r for r in got if r.doc_id is None or r.doc_id == 4}
    assert by_id[None].near_next < 1 and by_id[None].fingerprint == horner("zzzzzz")
    assert {r.fingerprint for r in got if r.doc_id == 5} == {horner("aaaaaa"), horner("")}
    assert sum(r.near_next == 1 for r in got if r.doc_id == 4) == 1


def test_common_extensions(spark):
    rows = [("abcabc", 0, "xabcd", 1, 9), ("abc", 3, "abc", 3, 9), (None, 0, "a", 0, 9), ("abc", 4, "abc", 0, 9), ("abc", None, "abc", 0, 9), ("é漢😀", 1, "漢😀", 0, 9)]
    got = fp.common_extensions(spark.createDataFrame(rows, "left string, at int, right string, there int, kept int"))
    assert [(r.kept, r.common) for r in got.collect()] == [(9, 3), (9, 0), (9, 0), (9, None), (9, None), (9, 2)]
