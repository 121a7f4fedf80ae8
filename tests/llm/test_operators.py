"""Operators against brute force, planted cases and odd rows."""

import hashlib
import math
import random
import re
import time
from bisect import bisect_left, insort
from collections import Counter, defaultdict
from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.llm import media, minhash, mixing, packing, quality, substring, topk, toxicity, urlfilter, warc, webp

DOC = "doc_id long, text string, source string, component string, _rank int"


def docs(spark, rows):
    """Rows of (doc_id, text[, source]) with columns whose names clash with inner ones."""
    return spark.createDataFrame([(r[0], r[1], r[2] if len(r) > 2 else "s", "x", 1) for r in rows], DOC)


def words(rng, n):
    return [rng.choice("abcdefgh") + str(rng.randrange(400)) for _ in range(n)]


def groups(rows, w, similarity):
    sets = {}
    for i, t in rows:
        p = (t or "").encode().lower().split()
        n = min(w, len(p))
        sets[i] = {tuple(p[k : k + n]) for k in range(len(p) - n + 1)} if p else set()
    root = {i: i for i in sets}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= similarity * len(sets[a] | sets[b]):
                x, y = sorted((top(a), top(b)))
                root[y] = x
    return {i: (len(sets[i]), top(i)) for i in sets}


@pytest.mark.parametrize("w,similarity", [(3, 85), (5, 80)])
def test_minhash_matches_brute_force(spark, w, similarity):
    rng = random.Random(w)
    rows, base = [], [words(rng, 80) for _ in range(4)]
    for i in range(160):
        text = list(base[i % 4]) if i % 3 else words(rng, rng.randrange(0, 60))
        for _ in range(rng.randrange(4) if i % 3 else 0):
            text[rng.randrange(len(text))] = "edit" + str(rng.randrange(9999))
        rows.append((i, " ".join(text)))
    rows += [(500, None), (501, "  \t"), (502, "One two"), (503, "one  TWO"), (504, "one"), (505, rows[5][1]), (505, rows[5][1])]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(docs(spark, rows), w, similarity).collect()}
    assert got == groups(dict(rows).items(), w, similarity)


def test_minhash_odd_rows(spark):
    assert minhash.near_duplicates(docs(spark, [])).count() == 0
    got = minhash.keep_first(docs(spark, [(None, "a b c d e f"), (2, "a b c d e f"), (1, "a b c d e f"), (1, "a b c d e f"), (3, None)]))
    assert sorted((r.doc_id or 0) for r in got.collect()) == [0, 1, 1, 3] and got.columns == ["doc_id", "text", "source", "component", "_rank"]


def test_family_links_join_what_all_links_would():
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**60, 100).astype(np.uint64)
    sets = []
    for i in range(150):
        s = base.copy()
        s[rng.choice(100, i % 14, replace=False)] = rng.integers(0, 2**60, i % 14).astype(np.uint64)
        sets.append(np.unique(s))
    ids = np.arange(150)

    def joined(links):
        root = list(range(150))
        for a, b in links:
            a, b = root[a], root[b]
            root = [min(a, b) if x in (a, b) else x for x in root]
        return root

    every = [(i, j) for i in range(150) for j in range(i) if minhash._alike(sets[i], sets[j], 85)]
    assert joined(minhash.linked_within(ids, sets, np.zeros(150, int), 85)) == joined(every)


@pytest.mark.parametrize("chunk", [400, 1 << 16])
def test_families_by_hubs_join_what_all_links_would(spark, monkeypatch, chunk):
    rng = np.random.default_rng(8)
    rows = []
    for family in range(3):
        bases = [rng.integers(0, 2**62, 100) for _ in range(3)]
        for i in range(40):
            s = bases[i % (family + 1)].copy()
            s[rng.choice(100, i % 12, replace=False)] = rng.integers(0, 2**62, i % 12)
            rows.append((family, 100 * family + i, np.unique(s.astype(np.uint64))))
    rows.append((3, 900, rows[0][2]))
    monkeypatch.setattr(minhash, "CHUNK", chunk)
    families = spark.createDataFrame([(f, i) for f, i, _ in rows], "family long, id long")
    sets = spark.createDataFrame([(i, len(s), s.tobytes()) for _, i, s in rows], "id long, n long, shingles binary")

    def joined(links):
        root = {i: i for _, i, _ in rows}
        for a, b in links:
            a, b = root[a], root[b]
            root = {k: min(a, b) if x in (a, b) else x for k, x in root.items()}
        return root

    every = [(i, j) for f, i, s in rows for g, j, t in rows if f == g and i < j and minhash._alike(s, t, 85)]
    got = [(r.u, r.v) for r in minhash.confirm_families(families, sets, 85).collect()]
    known = {i: (f, s) for f, i, s in rows}
    assert all(known[u][0] == known[v][0] and minhash._alike(known[u][1], known[v][1], 85) for u, v in got)
    assert joined(got) == joined(every)


def test_substring_removes_later_passages(spark):
    rng = random.Random(1)
    sentence = lambda: " ".join(words(rng, 8)).capitalize() + "."
    passage = " ".join(sentence() for _ in range(8))
    clean = [" ".join(sentence() for _ in range(6)) for _ in range(6)]
    rows = [(i, f"{c}\n{passage}\n{sentence()}" if i % 2 else c) for i, c in enumerate(clean)]
    rows += [(7, passage), (8, None), (9, ""), (None, passage), (10, "Ok. Ok. Ok."), (11, "Ok. Ok. Ok."), (12, "x " * 5000)]
    got = {r.doc_id: r for r in substring.remove_repeats(docs(spark, rows)).collect()}
    assert passage in got[1].text and all(passage not in got[i].text and got[i].text.startswith(clean[i]) for i in (3, 5))
    assert got[7].text == "" and got[7].first_docs == [1] and got[None].text == passage and got[8].text is None
    assert all(got[i].text == clean[i] for i in (0, 2, 4)) and got[10].text == got[11].text == "Ok. Ok. Ok."
    assert substring.remove_repeats(docs(spark, [])).count() == 0
    inner = ("mark", "row", "cuts", "firsts", "clean", "_mark", "removed_sentences")
    wide = docs(spark, [r for r in rows if r[0] in (1, 3)]).select("*", *[F.lit(f"own {c}").alias(c) for c in inner])
    back = {r.doc_id: r for r in substring.remove_repeats(wide).collect()}
    assert back[3].text == got[3].text and back[3].removed_sentences > 0 and all(r[c] == f"own {c}" for r in back.values() for c in inner[:-1])
    with pytest.raises(ValueError):
        substring.remove_repeats(wide, words=64)


def test_sentences_cover_the_text():
    for text in ("", " ", "\n\nA b. C d!\n\n e", "no mark", "x. " * 9 + "\n", "w " * 300):
        parts = substring.sentences(text)
        assert "".join(text[a:z] for a, z, _ in parts) == (text if parts else "") and [w for _, _, p in parts for w in p] == text.lower().split()


@pytest.mark.parametrize("stop", [0, 12, 40])
def test_every_passage_of_51_words_holds_a_span(stop):
    rng = random.Random(stop)

    def text(n):
        return [w + "." if stop and rng.random() < 1 / stop else w for w in words(rng, n)]

    for size in (51, 60, 75):
        for _ in range(150):
            passage = text(size)
            found = []
            for n in (rng.randrange(90), rng.randrange(90)):
                before = text(n)
                parts = substring.sentences(" ".join(before + passage + text(rng.randrange(90))))
                starts = np.cumsum([0, *(len(w) for _, _, w in parts)])
                value, a, z = substring.spans(parts)
                found.append({v for v, x, y in zip(value.tolist(), a, z) if starts[x] >= n and starts[y + 1] <= n + size})
            assert found[0] & found[1]


def test_substring_finds_passages_without_full_stops(spark):
    rng = random.Random(9)
    rows, want = [], {}
    for i, size in enumerate([51, 60, 75] * 8):
        passage = words(rng, size)
        for copy in (0, 1):
            before, behind = words(rng, rng.randrange(120)), words(rng, rng.randrange(120))
            rows.append((100 * copy + i, " ".join(before + passage + behind)))
            want[100 * copy + i] = (before, behind, size)
    got = {r.doc_id: r for r in substring.remove_repeats(docs(spark, rows)).collect()}
    for i, (before, behind, size) in want.items():
        left = got[i].text.split()
        assert left[: len(before)] == before and left[len(left) - len(behind) :] == behind
        assert (len(left) - len(before) - len(behind) == size) == (i < 100) and (got[i].removed_sentences, got[i].first_docs) == ((0, []) if i < 100 else (1, [i - 100]))


def test_packing_places_every_piece(spark):
    texts = [(i, "word " * n) for i, n in enumerate([0, 1, 5, 700, 2046, 2047, 2048, 5000, 30, 30, 30])] + [(11, None), (None, "x"), (3, "word " * 700), (12, "a<|endoftext|>b"), (13, "z" * 4000)]
    got = packing.pack(packing.token_pieces(docs(spark, texts))).toPandas()
    encode = packing.encoder(packing.VOCABULARY, packing.RANKS)
    assert got.length.sum() == sum(len(encode(t or "")) + 1 for _, t in texts)
    for _, g in got.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert g.offset.tolist() == [0, *np.cumsum(g.length)[:-1]] and g.length.sum() <= 2048
    long = got[got.doc_id == 7].sort_values("piece")
    assert (long.length.iloc[1:] == 2048).all() and long.start.tolist() == [0, *np.cumsum(long.length)[:-1]]
    assert got.sequence_id.nunique() <= -(-got.length.sum() // 2048) + 1
    assert packing.pack(packing.token_pieces(docs(spark, []))).count() == 0


def best_fit_decreasing(lengths, room):
    """Sequences that best fit one by one opens, the longest piece first."""
    gaps, opened = [], 0
    for n in sorted(lengths, reverse=True):
        at = bisect_left(gaps, n)
        free = gaps.pop(at) if at < len(gaps) else room
        opened += free == room
        if free > n:
            insort(gaps, free - n)
    return opened


def sweep_by_hand(pieces, slots):
    """Matching one by one: which pieces find a slot (from the largest down), and
    then (from the smallest up) the smallest slot left that holds each."""
    free, chosen = sorted(slots), []
    for p in sorted(pieces, reverse=True):
        if sum(f >= p for f in free) > len(chosen):
            chosen.append(p)
    out, at = [], 0
    for p in reversed(chosen):
        while free[at] < p:
            at += 1
        out.append((p, at))
        at += 1
    return out


def test_sweep_gives_the_successors_of_a_loop():
    rng = random.Random(2)
    for _ in range(200):
        top = rng.choice([12, 60])
        pieces = [rng.randrange(1, top) for _ in range(rng.randrange(1, 30))]
        free = [rng.randrange(1, top) for _ in range(rng.randrange(0, 30))]
        n, gaps = (sorted(Counter(x).items()) for x in (pieces, free))
        columns = lambda c: [np.array([r[k] for r in c], np.int64) for k in (0, 1)]
        (lengths, at, taken), held, offered = packing.sweep(*columns(n), *columns(gaps))
        each = {f: (s, a) for f, s, a in zip(held["free"].tolist(), held["slots"].tolist(), held["at"].tolist())}
        slots = sorted((f // each[f][0], f) for f in free for _ in range(each[f][0]))
        for f, (s, a) in each.items():
            assert s >= 1 and slots[a] == (f // s, f) and slots.index((f // s, f)) == a
        want = sweep_by_hand(pieces, [s for s, _ in slots])
        got = [(p, a + k) for p, a, t in zip(lengths.tolist(), at.tolist(), taken.tolist()) for k in range(t)]
        assert got == want and offered == len(free)


def test_packing_opens_as_few_sequences_as_best_fit(spark):
    rng = random.Random(5)
    lengths = [rng.choice([rng.randrange(1, 30), rng.randrange(1, 500), rng.randrange(1, 1001), 333]) for _ in range(4000)]
    rows = spark.createDataFrame([(n, i % 7, 1, 2) for i, n in enumerate(lengths)], "length long, seq int, place int, piece int")
    got = packing.pack(rows, 1000).toPandas()
    assert sorted(got.length) == sorted(lengths) and {"seq", "place", "piece"} <= set(got.columns)
    for _, g in got.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert g.offset.tolist() == [0, *np.cumsum(g.length)[:-1]] and g.length.sum() <= 1000
    assert got.sequence_id.nunique() <= 1.005 * best_fit_decreasing(lengths, 1000) + 1
    with pytest.raises(Exception, match="a length is not in"):
        packing.pack(rows.withColumn("length", F.lit(0)), 1000).count()


def test_packing_takes_few_jobs_whatever_the_supersteps(spark):
    rows = spark.range(3000).select((F.pmod(F.xxhash64("id"), F.lit(700)) + 1).alias("length")).cache()
    rows.count()
    sc = spark.sparkContext
    sc.setJobGroup("packing", "packing")
    try:
        got = packing.pack(rows, 2048).count()
    finally:
        jobs = len(sc.statusTracker().getJobIdsForGroup("packing"))
        sc.setLocalProperty("spark.jobGroup.id", None)
        rows.unpersist()
    assert got == 3000 and jobs <= 25


def test_packing_runs_place_each_rank_once():
    rng = random.Random(4)
    for _ in range(100):
        room = rng.choice([7, 60, 1000])
        sizes = [rng.randint(1, rng.choice([room, max(1, room // 3)])) for _ in range(rng.randint(1, 300))]
        lengths, counts = np.unique(np.array(sizes, np.int64), return_counts=True)
        found, ranks, sequences = packing.runs(lengths, counts, room), {}, {}
        for length, first, n, sequence, each, start in zip(*(found[k].tolist() for k in ("length", "first", "n", "sequence", "each", "start"))):
            for i in range(n):
                ranks.setdefault(length, []).append(first + i)
                sequences.setdefault(sequence + i // each, []).append((start + i % each * length, length))
        assert {k: sorted(v) for k, v in ranks.items()} == {int(k): list(range(n)) for k, n in zip(lengths, counts)}
        for places in sequences.values():
            starts, own = zip(*sorted(places))
            assert list(starts) == [0, *np.cumsum(own)[:-1]] and sum(own) <= room
        assert len(sequences) <= 1.02 * best_fit_decreasing(sizes, room) + 2


def test_tokens_equal_the_tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    slow, fast = Tokenizer.from_file(public_tokenizers.path(packing.VOCABULARY)), packing.encoder(packing.VOCABULARY, packing.RANKS)
    for t in ("", "a<|endoftext|>b <|endoftext|>", "é 🤖🏽\n\n  x\t", "a" * 3000, "1234567 " * 9, "don't we'll"):
        assert fast(t).tolist() == slow.encode(t, add_special_tokens=False).ids


def test_tokens_equal_the_tokenizer_on_documents(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    slow, fast = Tokenizer.from_file(public_tokenizers.path(packing.VOCABULARY)), packing.encoder(packing.VOCABULARY, packing.RANKS)
    for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect():
        assert fast(r.text or "").tolist() == slow.encode(r.text or "", add_special_tokens=False).ids


def test_mixing(spark):
    rng = random.Random(3)
    rows = [(i, "w " * rng.randrange(1, 60), None if i % 7 == 0 else "s" if i % 3 else f"t{i % 5}") for i in range(2000)] + [(None, None, "t1"), (5, "a b", "s"), (5, "a b", "s")]
    got = mixing.mix(docs(spark, rows)).toPandas()
    again = mixing.mix(docs(spark, rows).repartition(7)).toPandas()
    assert len(got) == len(rows) and got.sort_values(["doc_id", "size"]).taken.tolist() == again.sort_values(["doc_id", "size"]).taken.tolist()
    assert (got.taken <= 2 * got["size"]).all()
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += len((t or "").split())
    order = sorted((s for s in sizes if s), key=str) + [None]
    weight = {s: (3.0, 1.0, 2.0)[i % 3] for i, s in enumerate(order)}
    target, free = {}, set(order)
    total = 1.5 * sum(sizes.values())
    while True:
        left = total - sum(target.values())
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 2 * sizes[s]}
        if not over:
            target |= share
            break
        target |= {s: 2.0 * sizes[s] for s in over}
        free -= over
    for s, g in got.groupby(got.source.fillna("none")):
        s = None if s == "none" else s
        assert g.target.iloc[0] == pytest.approx(target[s]) and g.taken.sum() == pytest.approx(target[s], abs=130)
    assert mixing.mix(docs(spark, [])).count() == 0


def test_places_of_sources_that_begin_alike(spark):
    names = ["http://" + "".join(random.Random(i).choices("ab\u00e9\U0001f600\uffee", k=6)) + str(i) for i in range(300)] + ["", None]
    random.Random(1).shuffle(names)
    totals = spark.createDataFrame([(n,) for n in names], "source string")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {r.source: r.place for r in mixing._ordinal(totals).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == {n: i for i, n in enumerate([*sorted(n for n in names if n is not None), None])}


def test_top_k(spark):
    rng = np.random.default_rng(1)
    rows = [(int(i), [float(v) for v in rng.normal(size=24)]) for i in range(1200)]
    rows += [(2000, rows[3][1]), (2001, rows[3][1]), (2001, rows[3][1]), (None, rows[0][1]), (2002, None), (2003, [float("nan")] * 24), (2004, [None] * 24), (2005, [1.0]), (2006, [])]
    v = topk.usable(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    kept = [(r.vec_id, tuple(r.vector)) for r in v.collect()]
    for block in (topk.BLOCK_BYTES, 900):
        got = defaultdict(list)
        for r in topk.top_k(v, v.where(topk.query_rows(v, 100)), block_bytes=block).orderBy("query_id", "rank").collect():
            got[r.query_id].append((r.vec_id, r.score))
        q = {i: np.floor(np.array(x) * 1024).astype(int) for i, x in kept if i % 100 == 0}
        for i, x in q.items():
            want = sorted((-int(x @ np.floor(np.array(y) * 1024).astype(int)), j) for j, y in kept if j != i and len(y) == len(x))
            assert got[i] == [(j, -s) for s, j in want[:10]]
    huge = topk.usable(spark.createDataFrame([(0, [3e38, 1.0]), (1, [3e38, 0.0]), (2, [-3e38, 0.0])], "vec_id long, embedding array<float>"))
    assert [r.vec_id for r in topk.top_k(huge, huge.where("vec_id = 0")).orderBy("rank").collect()] == [1, 2]
    assert topk.top_k(v, v.where("vec_id < 0")).count() == 0
    many = topk.usable(spark.createDataFrame([(i, [3e38, float(i)]) for i in range(300)], "vec_id long, embedding array<float>"))
    assert [r.vec_id for r in topk.top_k(many, many.where("vec_id = 0")).orderBy("rank").collect()] == list(range(1, 11))


def test_first_floors_are_scores_of_other_queries(monkeypatch):
    monkeypatch.setattr(topk, "REFERENCES", 40)
    monkeypatch.setattr(topk, "PAIRS", 300)
    rng = np.random.default_rng(4)
    ids, x = np.arange(90) * 100, np.floor(rng.normal(size=(90, 8)) * 1024)
    got = topk.first_floors(ids, x, 10)
    for i in range(90):
        assert got[i] == sorted((float(x[i] @ x[j]) for j in range(40) if j != i), reverse=True)[9]
    assert (topk.first_floors(ids[:10], x[:10], 10) == topk.NONE).all()


def put_image(out, tokens, cache_bits, main):
    """Write pixels given as ("lit", argb), ("copy", length, code) or ("cache", index)."""
    number = lambda v: next((c, v - (c + 1 if c < 4 else ((2 + (c & 1)) << ((c - 2) >> 1)) + 1), 0 if c < 4 else (c - 2) >> 1) for c in range(39, -1, -1) if v >= (c + 1 if c < 4 else ((2 + (c & 1)) << ((c - 2) >> 1)) + 1))
    out.put(1 if cache_bits else 0, 1)
    if cache_bits:
        out.put(cache_bits, 4)
    if main:
        out.put(0, 1)
    symbols = []
    for t in tokens:
        if t[0] == "lit":
            p = t[1]
            symbols.append([(0, p >> 8 & 255), (1, p >> 16 & 255), (2, p & 255), (3, p >> 24)])
        elif t[0] == "copy":
            (a, x, n), (b, y, m) = number(t[1]), number(t[2])
            symbols.append([(0, 256 + a), (None, x, n), (4, b), (None, y, m)])
        else:
            symbols.append([(0, 280 + t[1])])
    sizes = (280 + (1 << cache_bits if cache_bits else 0), 256, 256, 256, 40)
    tables = []
    for k, size in enumerate(sizes):
        lengths = webp.code_lengths(np.bincount([s[1] for row in symbols for s in row if s[0] == k] or [0], minlength=size), 15)
        webp.put_code(out, lengths)
        used, codes = webp.canonical(lengths)
        tables.append({int(s): (int(c), int(lengths[s]) if len(used) > 1 else 0) for s, c in zip(used, codes)})
    for row in symbols:
        for s in row:
            out.put(*(s[1:] if s[0] is None else tables[s[0]][s[1]]))


def stream(width, height, transforms, tokens, cache_bits=0):
    out = webp.BitWriter()
    for value, n in ((0x2F, 8), (width - 1, 14), (height - 1, 14), (0, 4)):
        out.put(value, n)
    for t in transforms:
        t(out)
    out.put(0, 1)
    put_image(out, tokens, cache_bits, True)
    return webp.riff(out.value.to_bytes(-(-out.n // 8), "little"))


def test_webp_back_references_and_cache():
    rng = np.random.default_rng(2)
    a, b, c = (int(x) for x in rng.integers(0, 2**32, 3))
    slot = lambda p: ((0x1E35A7BD * p) & 0xFFFFFFFF) >> 28
    tokens = [("lit", a), ("lit", b), ("lit", c), ("copy", 5, 2), ("copy", 4, 1), ("copy", 3, 120 + 7), ("cache", slot(a)) if slot(a) not in (slot(b), slot(c)) else ("lit", a)]
    want = [a, b, c] + [c] * 5
    for n, d in ((4, 4), (3, 7)):  # code 1 is the pixel above, in rows of four
        for _ in range(n):
            want.append(want[-d])
    want.append(a)
    w, h, got = webp.decode(stream(4, 4, [], tokens, 4))
    assert (w, h) == (4, 4) and got.tolist() == want


@pytest.mark.parametrize("mode", range(14))
def test_webp_predictor(mode):
    rng = np.random.default_rng(mode)
    width, height = 7, 9
    px = rng.integers(0, 256, (height, width, 4)).astype(np.uint8)
    rest = px.copy()
    for y in range(height):
        for x in range(width):
            if x == y == 0:
                p = np.array([0, 0, 0, 255])
            elif y == 0:
                p = px[y, x - 1]
            elif x == 0:
                p = px[y - 1, x]
            else:
                right = px[y - 1, x + 1] if x + 1 < width else px[y, 0]
                p = webp._predict(mode, px[y, x - 1], px[y - 1, x], px[y - 1, x - 1], right)
            rest[y, x] = (px[y, x].astype(int) - p) % 256

    def transform(out):
        for value, n in ((1, 1), (0, 2), (0, 3)):
            out.put(value, n)
        put_image(out, [("lit", 0xFF000000 | mode << 8)] * 6, 0, False)

    got = webp.decode(stream(width, height, [transform], [("lit", int(p)) for p in rest.reshape(-1, 4).view("<u4").ravel()]))[2]
    assert got.tolist() == px.reshape(-1, 4).view("<u4").ravel().tolist()


def test_webp_predictions_by_hand():
    l, t, c, r = (np.array([v] * 4, np.uint8) for v in (10, 21, 40, 7))
    want = {0: 0, 1: 10, 2: 21, 3: 7, 4: 40, 5: (8 + 21) // 2, 6: 25, 7: 15, 8: 30, 9: 14, 10: (25 + 14) // 2, 11: 10, 12: 0, 13: 15 - 12}
    assert {m: int(webp._predict(m, l, t, c, r)[0]) for m in range(14)} == want


def test_webp_cross_colour_and_palette():
    px = np.random.default_rng(3).integers(0, 256, (16, 4)).astype(np.uint8)
    f = {"gr": -37, "gb": 90, "rb": -5}
    s8 = lambda v: int(np.int8(np.uint8(v)))
    rest = px.copy()
    for i, (b, g, r, _) in enumerate(px.astype(int)):
        rest[i, 2] = (r - (f["gr"] * s8(g) >> 5)) % 256
        rest[i, 0] = (b - (f["gb"] * s8(g) >> 5) - (f["rb"] * s8(r) >> 5)) % 256

    def transform(out):
        for value, n in ((1, 1), (1, 2), (0, 3)):
            out.put(value, n)
        put_image(out, [("lit", 0xFF000000 | (f["rb"] & 255) << 16 | (f["gb"] & 255) << 8 | (f["gr"] & 255))], 0, False)

    got = webp.decode(stream(4, 4, [transform], [("lit", int(p)) for p in rest.view("<u4").ravel()]))[2]
    assert got.tolist() == px.view("<u4").ravel().tolist()


def test_media_round_trip(spark):
    rng = np.random.default_rng(4)
    texts = ["", None, "a", "ab" * 300, "\0" * 200, "0123456789abcdef" * 30, "ä€😀" * 99] + ["".join(map(chr, rng.integers(1, k, 900))) for k in (3, 5, 17, 60, 50_000)]
    got = media.store_texts(docs(spark, list(enumerate(texts)))).orderBy("doc_id").collect()
    for t, r in zip(texts, got):
        payload, n = media.to_payload(t)
        assert r.n_bytes == n and media.load(bytes(r.media)).tobytes() == payload
    wide = media.pixel_arrays(spark.createDataFrame([(bytes(got[3].media),), (None,)], "media binary")).collect()
    assert wide[0].width == 192 and len(wide[0].pixels) == 192 * wide[0].height and wide[1].pixels is None
    big = bytes(rng.integers(97, 123, media.FRAME + 192).astype(np.uint8))
    assert media.load(media.store(big)).tobytes() == big
    assert media.round_trip(docs(spark, [])).count() == 0
    with pytest.raises(ValueError):
        webp.decode(bytes(got[3].media)[:60])


def test_media_query_columns(spark):
    rng = random.Random(6)
    lines = [" ".join(words(rng, 12)) for _ in range(40)]
    texts = ["", None, "ab", "x" * 192, "y" * 193, "ä€😀" * 99, "\n".join(lines), "\n".join(rng.choice(lines) for _ in range(500)), " ".join(words(rng, 90_000))]
    rows = [(i, t) for i, t in enumerate(texts)] + [(6, texts[6]), (None, texts[6])]
    got = media.round_trip(docs(spark, rows)).collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id) for r in got) == sorted(-1 if i is None else i for i, _ in rows)
    for r in got:
        raw = (texts[6 if r.doc_id is None else r.doc_id] or "").encode()
        payload = raw + b" " * (max(192, -(-len(raw) // 192) * 192) - len(raw))
        p = [n / len(payload) for n in Counter(payload).values()]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest())
        assert r.tail_crc32 == crc32(payload[-16:])
        stored = media.store(payload)
        assert (r.media_bytes, r.media_sha256) == (len(stored), hashlib.sha256(stored).hexdigest())
        assert f"rows={len(payload) // 192};mean={np.mean(list(payload)):.4f};dev={np.std(list(payload)):.4f};entropy={-sum(x * math.log2(x) for x in p) + 0.0:.4f};" in r.feature
    alone, among = media.store(media.to_payload(texts[7])[0]), media.store_all([media.to_payload(t)[0] for t in texts])[7]
    assert alone == among
    of = {r.doc_id: r for r in got}
    assert of[7].media_bytes < 0.25 * of[7].payload_bytes and of[8].media_bytes > 0.4 * of[8].payload_bytes


def plain_green(data):
    """The kinds of transforms and tokens of a file of ours, read bit by bit."""
    bits = webp.Bits(data[20:])
    bits.read(8 + 14 + 14 + 4)
    kinds = []
    while bits.read(1):
        kinds.append(bits.read(2))
        if kinds[-1] == webp.PREDICTOR:
            bits.read(3)
            webp._image(bits, 2, 8, False)
        elif kinds[-1] == webp.PALETTE:
            webp._image(bits, bits.read(8) + 1, 1, False)
    assert bits.read(2) == 0
    green = webp.read_code(bits, webp.LITERALS + webp.LENGTHS)
    return kinds, bool(green.symbol.max() >= webp.LITERALS)


def test_encoder_uses_what_pays():
    rng = np.random.default_rng(9)
    noise = rng.integers(0, 256, 192 * 40).astype(np.uint8)
    ramp = np.cumsum(rng.integers(0, 3, 192 * 40)).astype(np.uint8)
    tall = np.cumsum(rng.integers(0, 2, (40, 192)), axis=0).astype(np.uint8)
    tall += rng.integers(0, 256, 192).astype(np.uint8)
    twice = np.tile(rng.integers(0, 256, 1000).astype(np.uint8), 8)[: 192 * 40]
    few = np.tile(rng.integers(60, 70, 997).astype(np.uint8), 8)[: 192 * 40]
    P, S, I = webp.PREDICTOR, webp.SUBTRACT_GREEN, webp.PALETTE
    for name, x, kinds, copies in (("noise", noise, [S], False), ("ramp", ramp, [P, S], False), ("tall", tall.ravel(), [P, S], False), ("twice", twice, [S], True), ("few", few, [I], True), ("same", np.full(192 * 3, 7, np.uint8), [I], True)):
        data = webp.encode_samples(x, 192)
        w, h, px = webp.decode(data)
        assert (w, h) == (192, len(x) // 192) and (px & 0xFF000000 == 0xFF000000).all(), name
        assert all(((px >> k) & 255 == x).all() for k in (0, 8, 16)), name
        if name != "same":
            assert plain_green(data) == (kinds, copies), name


def test_green_streams_equal_the_loop(monkeypatch):
    """The reader of all bits at once gives what reading symbol by symbol gives."""
    rng = np.random.default_rng(11)
    files = []
    for _ in range(30):
        base = rng.integers(0, rng.choice([4, 30, 256]), 192 * 4).astype(np.uint8)
        parts = [base[a : a + n] for a, n in zip(rng.integers(0, 600, 30), rng.integers(1, 160, 30))]
        x = np.concatenate(parts)
        files.append((webp.encode_samples(x[: len(x) // 192 * 192], 192), x))
    fast = [webp.decode(f)[2].tolist() for f, _ in files]

    def slow(bits, green, far, width, n):
        out = []
        while len(out) < n:
            s = green.read(bits)
            if s < webp.LITERALS:
                out.append(s)
                continue
            size = webp._number(bits, s - webp.LITERALS)
            code = webp._number(bits, far.read(bits))
            x, y = webp.NEAR[code - 1] if code <= 120 else (code - 120, 0)
            for _ in range(size):
                out.append(out[-max(1, x + y * width)])
        return np.array(out, np.uint8)

    monkeypatch.setattr(webp, "_green_stream", slow)
    assert [webp.decode(f)[2].tolist() for f, _ in files] == fast


def test_warc(spark):
    hidden = "x" * 1200 + "WARC/1.0\r\nContent-Length: 3\r\n\r\nabc\r\n\r\nWARC/1.0\r\nfoo" + "ä" * 40
    rows = [(1, "http://a/\r\nb", hidden), (2, None, None), (3, "q", hidden), (None, "u", "WARC/1.0\r\n" * 3), (None, "v", hidden), (4, "", "WARC/1.0\r\nContent-Length: 4\r\n\r\n"), (5, "s", "short"), (6, "s", "short"), (3, "q", hidden)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        got = warc.round_trip(pages).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert Counter((r.page_id, r.record_type, r.refers_to) for r in got) == Counter({(1, "revisit", 3): 1, (2, "response", None): 1, (3, "response", None): 2, (None, "response", None): 1, (None, "revisit", 3): 1, (4, "response", None): 1, (5, "response", None): 1, (6, "response", None): 1})
    html = {3: hidden, 2: "", 4: rows[5][2], 5: "short"}
    assert all(bytes(r.payload).decode() == html[r.page_id] for r in got if r.page_id in html)
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_chains_by_pointer_jumping(spark):
    rng = random.Random(6)
    starts = sorted(rng.sample(range(1, 5000), 300))
    succ = {s: rng.choice([x for x in [*starts, 6000] if x > s] or [6000]) for s in [0, *starts]}
    want, at = set(), 0
    while at < 5000 and at in succ:
        want.add(at)
        at = succ[at]
    spots = spark.createDataFrame([("f", i, s, succ[s], 6000) for i, s in enumerate([0, *starts])], "file string, line long, start long, succ long, file_size long")
    assert {r.start for r in warc.reachable(spots).collect()} == want


def test_url_filters(spark):
    urls = ["http://example.org/es/x", "http://a.EXAMPLE.org/en/1?q", "https://badexample.org/es/", "http://org", "x://org/?", "ftp://b.com/fr/#z", "http://com/de/", "no scheme", None, "http:///p", "http://example.org/es", "http://example.org/es/x"]
    pages = spark.createDataFrame([(i if i else None, u) for i, u in enumerate(urls)] + [(1, urls[1])], "page_id long, url string")
    got = urlfilter.judge_urls(pages, urlfilter.rules_frame(spark)).collect()
    rule = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in got}
    assert len(got) == len(urls) + 1
    assert rule[None] == ("example.org", "/es/x", "example.org/es/", "block") and rule[1][2:] == ("example.org/en/1", "block") and rule[2][2:] == ("org/", "allow")
    assert rule[3][1:] == ("", None, "allow") and rule[4][2] == "org/" and rule[5][2:] == ("com/fr/", "allow") and rule[6][2:] == ("com/de/", "block") and rule[7][:2] == rule[8][:2] == ("", "")
    assert rule[9][:2] == ("", "/p") and rule[10][2] == "org/"
    limit, urlfilter.BROADCAST_RULES = urlfilter.BROADCAST_RULES, 0
    try:
        assert Counter(map(tuple, urlfilter.judge_urls(pages, urlfilter.rules_frame(spark)).collect())) == Counter(map(tuple, got))
    finally:
        urlfilter.BROADCAST_RULES = limit
    bare = urlfilter.judge_urls(pages, urlfilter.rules_frame(spark, [])).collect()
    assert len(bare) == len(got) and {(r.rule, r.verdict) for r in bare} == {(None, "allow")}


def test_url_filters_with_rules_of_many_shapes(spark):
    rng = random.Random(12)
    host = lambda: ".".join(rng.choices("abc", k=rng.randrange(1, 5)))
    path = lambda: "/" + "".join(rng.choices("xy/", k=rng.randrange(0, 6)))
    rules = [(host(), path()[: rng.randrange(0, 6)], rng.choice(["allow", "block"])) for _ in range(150)] + [("", "", "block"), ("a", None, "block")]
    pages = [(i, f"h://{host()}{path()}", host(), path()) for i in range(400)] + [(400, "h:///x", "", "/x")]
    got = urlfilter.judge_urls(spark.createDataFrame([p[:2] for p in pages], "page_id long, url string"), urlfilter.rules_frame(spark, rules)).collect()
    assert len(got) == len(pages)
    for r in got:
        fits = [(len(h + p), v == "block", h + p, h, v) for h, p, v in rules if p is not None and (r.host == h or r.host.endswith("." + h)) and r.path.startswith(p)]
        best = max(fits, default=(0, False, None, None, "allow"))
        assert (r.rule, r.verdict) == (best[2], best[4]), r


def test_classifiers(spark):
    rng = random.Random(8)
    good = [" ".join(words(rng, 60)) for _ in range(300)]
    bad = [" ".join(w if rng.random() > 0.1 else "grubwort" + str(rng.randrange(3)) for w in words(rng, 60)) for _ in range(300)]
    q = quality.train([*good[:200], *bad[:200]], [1] * 200 + [0] * 200)
    t = toxicity.train([*good[:200], *bad[:200]], [0] * 200 + [1] * 200)
    s = toxicity.Scorer(t)
    assert np.mean([quality.score(q, x) > 0.5 for x in good[200:]] + [quality.score(q, x) < 0.5 for x in bad[200:]]) > 0.95
    assert np.mean([s.score(x) < 0.5 for x in good[200:]] + [s.score(x) >= 0.5 for x in bad[200:]]) > 0.95
    for m, f in ((quality.train([], []), quality.score_texts), (quality.train(["a"], [1]), quality.score_texts), (t, toxicity.score_texts), (toxicity.train(["a"], [1]), toxicity.score_texts)):
        got = f(docs(spark, [(1, None), (2, ""), (None, "x" * 200_000), (1, "a")]), m).collect()
        assert len(got) == 4 and all(0 <= r.score <= 1 for r in got)
    assert toxicity.score_texts(docs(spark, []), t).count() == 0
    held = spark.createDataFrame([(i,) for i in range(50)], "doc_id long").select("doc_id", toxicity.held_out(F.col("doc_id"), 5, 0).alias("h")).collect()
    assert all(r.h == (crc32(str(r.doc_id).encode()) % 5 == 0) for r in held)


def test_toxicity_sees_phrases_of_ordinary_words():
    """Both classes hold the same words; only their order in some phrases differs."""
    rng = random.Random(12)
    insults = [words(rng, 6) for _ in range(5)]

    def text(bad):
        told = [rng.sample(p, 6) if not bad else p for p in rng.sample(insults, 3)]
        parts = [words(rng, 15)] + [p + words(rng, 15) for p in told]
        return " ".join(w for p in parts for w in p)

    rows = [(text(i % 2), i % 2) for i in range(600)]
    s = toxicity.Scorer(toxicity.train([t for t, _ in rows[:400]], [y for _, y in rows[:400]]))
    assert np.mean([(s.score(t) >= 0.5) == y for t, y in rows[400:]]) > 0.9


def test_toxic_words_in_few_rows_count_whatever_the_number_of_rows():
    rng = random.Random(13)
    insults = ["".join(rng.choice("klmnoprstuvwyz") for _ in range(9)) for _ in range(90)]
    rows = [(" ".join(words(rng, 12) + [rng.choice(insults)] * (i % 10 == 0)), int(i % 10 == 0)) for i in range(9000)]
    s = toxicity.Scorer(toxicity.train([t for t, _ in rows], [y for _, y in rows]))
    assert np.mean([s.score(" ".join(words(rng, 12) + [w])) >= 0.5 for w in insults]) > 0.9
    assert np.mean([s.score(" ".join(words(rng, 12))) < 0.5 for _ in range(300)]) > 0.9


def test_toxicity_of_many_texts_at_once_is_that_of_each_window_alone():
    """Against windows cut, compressed and counted one by one."""
    rng = random.Random(14)
    rows = [(" ".join(words(rng, 40) + ["grubwort"] * (i % 2)), i % 2) for i in range(200)]
    m = toxicity.train([t for t, _ in rows], [y for _, y in rows])
    odd = [None, "", " ", "!!! --", "_", "a", "-a- (b--c) 'd'", "\x1cA\x1dB\x85c\u3000D", "\u0130\u00e9\u0301 \u4e2d\u6587 \U0001f600", "\ud800x", "x" * 200_000, *(" ".join(words(rng, n)) for n in range(1, 14))]
    texts = [*odd, *(t for t, _ in rows[:30]), *odd[::-1]]

    def plain(text):
        ws = [w for w in (re.sub(r"^[^\w]+|[^\w]+$", "", x) for x in (text or "").lower().split()) if w]
        size = lambda table, part: len(toxicity._compressor(table).compress(f" {' '.join(part)} ".encode("utf-8", "replace")))
        gain = [size(m.ordinary, [w]) - size(m.toxic, [w]) for w in ws]
        starts = range(0, max(1, len(ws) - 3), 3) if ws else ()
        far = sorted((size(m.ordinary_texts, ws[k : k + 6]) - size(m.toxic_texts, ws[k : k + 6]) for k in starts), reverse=True) or [0]
        at = [sum(g == k or g > k == 7 for g in gain) for k in range(2, 8)]
        x = [1.0, *map(math.log1p, at), math.sqrt(sum(at[1:]) / len(ws)) if ws else 0.0, math.log1p(len(ws)) / 10, far[0] / 10, sum(far[:4]) / len(far[:4]) / 10, sum(far) / len(far) / 10]
        return 1 / (1 + math.exp(-np.clip(np.dot(m.weights, x), -30, 30)))

    assert toxicity.Scorer(m).scores(texts) == pytest.approx([plain(t) for t in texts], rel=1e-12)


def test_toxicity_keeps_the_gains_of_words_at_hand(monkeypatch):
    """Words that every text holds are compressed once, however often the table is full."""
    done = []

    class Counting:
        def __init__(self, content):
            self.inner, self.words = made(content), content == b"words"

        def compress(self, raw):
            done.append(self.words)
            return self.inner.compress(raw)

        def multi_compress_to_buffer(self, parts, threads):
            done.extend([self.words] * len(parts))
            return self.inner.multi_compress_to_buffer(parts, threads=threads)

    made = toxicity._compressor
    monkeypatch.setattr(toxicity, "_compressor", Counting)
    monkeypatch.setattr(toxicity, "MEMO", 50)
    s = toxicity.Scorer(toxicity.ToxicityModel(b"words", b"o", b"t", b"u", [0.0] * (toxicity.LEVELS + 5), 0.5))
    for i in range(20):
        s.score(" ".join([f"common{k}" for k in range(40)] + [f"rare{i}x{k}" for k in range(20)]))
    assert sum(done) == 40 + 20 * 20


def test_toxicity_words_with_long_runs_of_marks():
    start = time.process_time()
    assert toxicity.windows("a" + "!" * 100_000 + "b?") == ["a" + "!" * 100_000 + "b"] and toxicity.windows("!" * 100_000) == []
    assert time.process_time() - start < 2  # in proportion to the text


def test_a_text_over_the_bound_leaves_the_other_rows(spark):
    ids = sorted(range(20), key=lambda i: crc32(str(i).encode()))
    rows = [(i, "x" * (1000 if i in (ids[0], ids[9]) else 10)) for i in ids]
    labels = spark.createDataFrame([(i, i % 2) for i in ids], "doc_id long, toxic int")
    got = toxicity.labelled_rows(docs(spark, rows), labels, "toxic", F.lit(True), most_bytes=500).collect()
    assert sorted(r.doc_id for r in got) == sorted(set(ids) - {ids[0], ids[9]}) and {len(r.text) for r in got} == {10}
