"""SimHash, suffix-array and embedding deduplication against brute force, and their edge cases."""

import os
import random

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import embed_dedup, simhash, suffix_dedup
from tidemark.llm.common import connected_components

TEXT = "doc_id long, text string, lang string, rep long, h long, fp long"  # with columns that clash with inner names


def _docs(spark, rows):
    return spark.createDataFrame([(d, t, "en", 1, 2, 3) for d, t in rows], TEXT)


def _components(nodes, linked):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in nodes:
        for b in nodes:
            if a < b and linked(a, b):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


def test_connected_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1060)] + [(2000, i) for i in range(2001, 2100)]
    found = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    expected = {n: find(n) for n in parent}
    assert {**{n: n for n in parent}, **found} == expected
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 3), st.data())
def test_masks_cover_every_radius(radius, data):
    bits = data.draw(st.sets(st.integers(0, 63), min_size=radius, max_size=radius))
    assert any(all(not m >> b & 1 for b in bits) for m in simhash.covering_masks(radius))
    assert len(simhash.covering_masks(radius)) == 2 ** (radius + 1) - 1


def _fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def test_simhash_components(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgé") for _ in range(5))
    base = [word() for _ in range(300)]
    rows = [(0, None), (1, ""), (2, " \n\t"), (3, "One"), (4, "one"), (5, "two words"), (None, "two words"), (6, " ".join(base)), (7, " ".join(base).upper())]
    for i in range(10, 60):
        w = list(base)
        for _ in range(rng.choice([0, 1, 1, 2, 20])):
            w[rng.randrange(300)] = word()
        rows.append((i, " ".join(w)))
    rows += [(i, " ".join(word() for _ in range(40))) for i in range(60, 90)] + [(60, rows[-1][1])]
    got = simhash.simhash_components(_docs(spark, rows)).collect()
    fps = {d: _fingerprint(t) for d, t in rows if d is not None}
    assert len(got) == len(rows)
    by_row = sorted((r.doc_id is None, r.doc_id, r.fingerprint) for r in got)
    assert by_row == sorted((d is None, d, f"{_fingerprint(t):016x}") for d, t in rows)
    prints = {f for f in map(lambda r: _fingerprint(r[1]), rows)}
    nodes = _components(prints, lambda a, b: bin(a ^ b).count("1") <= 2)
    least = {}
    for d, t in rows:
        if d is not None:
            root = nodes[_fingerprint(t)]
            least[root] = min(d, least.get(root, d))
    assert all(r.component_id == least[nodes[int(r.fingerprint, 16)]] for r in got)
    assert fps[0] == 0 and {r.component_id for r in got if r.doc_id in (0, 1, 2)} == {0}


def test_large_buckets_link_like_small_ones(spark):
    rng = random.Random(7)
    centre = rng.getrandbits(64)
    fps = {centre ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) ^ (rng.choice([0, 0, 1]) << rng.randrange(64)) for _ in range(120)}
    rows = [(simhash._signed(f), i) for i, f in enumerate(sorted(fps))]
    classes = spark.createDataFrame([(0, *r) for r in rows], "nth int, fp long, rep long")
    expected = _components([i for _, i in rows], lambda a, b: bin((rows[a][0] ^ rows[b][0]) & (2**64 - 1)).count("1") <= 2)
    for bucket in (1, 4, 1000):
        found = {r.node: r.root for r in connected_components(simhash.hamming_edges(classes, bucket=bucket)).collect()}
        assert {i: found.get(i, i) for i in expected} == expected
    with pytest.raises(ValueError, match="radius"):
        simhash.hamming_edges(classes, 3)


def test_near_duplicates_are_verified(spark):
    rng = random.Random(11)
    words = [f"w{i}" for i in range(200)]
    near = list(words)
    near[100] = "changed"
    far = [w if rng.random() < 0.6 else w + "x" for w in words]
    rows = [(1, " ".join(words)), (2, " ".join(near)), (3, " ".join(far)), (4, None), (5, " "), (6, " ".join(words)), (7, "short text")]
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(_docs(spark, rows)).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 4, 5: 4, 6: 1, 7: 7}
    assert simhash.near_duplicates(_docs(spark, [])).count() == 0
    assert simhash.simhash_components(_docs(spark, [])).count() == 0


def _similar(a, b):
    x, y = ({tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (a.split(), b.split()))
    return len(x & y) >= 0.8 * len(x | y)


def test_near_duplicates_find_appended_and_truncated_copies(spark):
    rng, rows = random.Random(19), []
    for i in range(60):
        words = [f"w{int(rng.paretovariate(0.6)) % 50000}" for _ in range(rng.choice([80, 200, 600]))]
        n, share = len(words), rng.choice([0.82, 0.86, 0.92])
        other = words[: int(n * share)] if i % 2 else words + [f"w{int(rng.paretovariate(0.6)) % 50000}" for _ in range(int(n / share - n))]
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(other))]
    texts = dict(rows)
    expected = _components(list(texts), lambda a, b: _similar(texts[a], texts[b]))
    assert sum(d != c for d, c in expected.items()) >= 55
    assert {r.doc_id: r.component_id for r in simhash.near_duplicates(_docs(spark, rows)).collect()} == expected


def test_near_duplicates_deal_shingles_of_possible_pairs_only(spark, monkeypatch):
    """Unlike texts around rare passages are candidates; their shingles are neither written nor joined."""
    rng, written = random.Random(29), {}
    rows = [(i, " ".join(f"w{rng.randrange(10**6)}" for _ in range(150)) + "".join(f" p{i // 4}-{j}" for j in range(60))) for i in range(40)]
    rows += [(100, rows[0][1] + " end"), (101, rows[1][1] + " end")]
    materialise = simhash.materialise

    def noted(df, name, **more):
        out = materialise(df, name, **more)
        written.setdefault(name, []).append((out.count(), out._tidemark_path.removeprefix("file:")))
        return out

    monkeypatch.setattr(simhash, "materialise", noted)
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(_docs(spark, rows)).collect()}
    assert got == {**{i: i for i in range(40)}, 100: 0, 101: 1}
    assert written["near-stars"][0][0] + written["near-rest"][0][0] >= 20
    assert sum(n for n, _ in written["shingles"]) <= 8
    assert not any(os.path.exists(path) for name in ("shingles", "near-shared", "near-prefixes", "near-links") for _, path in written[name])


def test_sketches_exclude_no_pair_that_reaches_the_similarity():
    rng = np.random.default_rng(31)
    for n in (1, 2, 40, 63, 64, 65, 500, 1030, 5000):
        x = rng.integers(0, 2**64, n, dtype=np.uint64)
        for kept, added in ((n, 0), (n, n // 4), (n - n // 6, 0), (n - n // 10, n // 10), (0, n)):
            y = np.concatenate([x[:kept], rng.integers(0, 2**64, added, dtype=np.uint64)])
            if len(y):
                far = simhash.sketch_distance(simhash.sketch(x), simhash.sketch(y))
                assert far == simhash.sketch_distance(simhash.sketch(y), simhash.sketch(x)) <= n - kept + added
                assert n < 40 or kept or far > (n + added) / 9  # nothing in common: excluded


def test_shared_entries_in_slices(spark):
    rows = [(simhash._signed(g % 700 * 0x9E3779B97F4A7C15 & (1 << 64) - 1), g) for g in range(1000)]
    entries = spark.createDataFrame(rows, "g long, doc_id long")
    expected = sorted(r for r in rows if r[1] % 700 < 300)
    for dealt in (10_000, 300, 90):
        assert sorted(map(tuple, simhash.shared_entries(entries, dealt).collect())) == expected


def test_near_duplicates_in_a_group_with_an_unlike_first(spark):
    rng = random.Random(23)
    words = [f"w{i}" for i in range(200)]
    halves = [" ".join(words), " ".join(words[100:] + words[:100])]  # alike, and of the same words
    mixed = [" ".join(rng.sample(words, 200)) for _ in range(80)]  # the same words, unlike all others
    rows = [*enumerate(mixed), (100, halves[0]), (101, halves[1])]
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(_docs(spark, rows)).collect()}
    assert got == {**{i: i for i in range(80)}, 100: 100, 101: 100}
    common = [f"c{i}" for i in range(120)]
    rows = [(i, " ".join(rng.sample(common, 120) + common[:20] + [f"x{i // 2}-{j}" for j in range(30)])) for i in range(160)]
    rows += [(500 + i, " ".join([*common, "end", str(i)])) for i in range(5)]
    texts = dict(rows)
    expected = _components(list(texts), lambda a, b: _similar(texts[a], texts[b]))
    assert {r.doc_id: r.component_id for r in simhash.near_duplicates(_docs(spark, rows)).collect()} == expected


def _remove(rows, length):
    seen, out = set(), {}
    for d, t in sorted(rows, key=lambda x: x[0]):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            w = b[p : p + length]
            if w in seen:
                gone[p : p + length] = b"\1" * length
            seen.add(w)
        out[d] = bytes(x for x, g in zip(b, gone, strict=True) if not g)
    return out


@pytest.mark.parametrize("key_segments", [4096, 2])
def test_suffix_dedup(spark, monkeypatch, key_segments):
    monkeypatch.setattr(suffix_dedup, "KEY_SEGMENTS", key_segments)
    rng = random.Random(13)
    prose = lambda n: "".join(rng.choice("abcdeé ") for _ in range(n))
    passage, head = prose(180), prose(120)
    rows = [(0, None), (1, ""), (2, "x" * 99), (3, "a" * 700), (4, "ab" * 300), (5, passage), (6, passage), (7, prose(50) + passage + prose(40)), (8, prose(20) + passage[5:150] + head), (9, head + passage[100:] + head)]
    rows += [(i, prose(rng.randrange(30, 90)) + passage[rng.randrange(40) : 140 + rng.randrange(40)] + prose(60)) for i in range(10, 40)]
    rows += [(40, rows[20][1]), (41, prose(3000) + "b" * 150), (42, "b" * 120)]
    for length in (100, 64):
        got = {r.doc_id: bytes(r.kept) for r in suffix_dedup.remove_repeats(_docs(spark, rows), length).collect()}
        assert got == _remove(rows, length)


def test_suffix_dedup_edges(spark):
    rng = random.Random(17)
    long = "".join(rng.choice("abcdefgh") for _ in range(300))
    rows = [(None, long), (1, long), (1, long), (2, "é" * 40 + long)]
    got = [(r.doc_id, r.kept, len(r.removed)) for r in suffix_dedup.remove_repeats(_docs(spark, rows), as_text=True).collect()]
    assert sorted(got, key=str) == sorted([(None, long, 0), (1, long, 0), (1, long, 0), (2, "é" * 40, 1)], key=str)
    clash = [(1, long), (1, long[100:]), (2, long)]
    assert sorted(r.kept for r in suffix_dedup.remove_repeats(_docs(spark, clash), as_text=True).collect()) == sorted([long, long[100:], long])
    assert suffix_dedup.remove_repeats(_docs(spark, [])).count() == 0
    with pytest.raises(ValueError, match="length"):
        suffix_dedup.remove_repeats(_docs(spark, rows), 10)


@settings(max_examples=50, deadline=None)
@given(st.binary(max_size=60).map(lambda b: bytes(x % 3 for x in b)))
def test_longest_previous_factor(text):
    n = len(text)
    brute = [max([k for j in range(i) for k in range(n - i + 1) if text[j : j + k] == text[i : i + k]], default=0) for i in range(n)]
    assert suffix_dedup.longest_previous_factor(text).tolist() == brute
    order, _ = suffix_dedup.suffix_array(np.frombuffer(text, dtype=np.uint8))
    assert [text[i:] for i in order] == sorted(text[i:] for i in range(n))


VECTOR = "vec_id long, embedding array<float>, label int, links long, rep long, k int, n long"


def _vectors(spark, rows):
    return spark.createDataFrame([(i, v, label, 0, 0, 0, 0) for i, v, label in rows], VECTOR)


def _linked(rows, cosine=0.93):
    def ok(v, label):
        return label is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)

    good = {i: np.array(v, dtype=np.float32).astype(float) for i, v, label in rows if ok(v, label)}
    labels = {i: label for i, _, label in rows}
    cos = lambda a, b: good[a] @ good[b] / np.linalg.norm(good[a]) / np.linalg.norm(good[b])
    pair = lambda a, b: a in good and b in good and labels[a] == labels[b] and len(good[a]) == len(good[b]) and cos(a, b) >= cosine
    ids = [i for i, _, _ in rows]
    links = {i: sum(pair(i, j) for j in ids if j != i) for i in ids}
    roots = _components(ids, pair)
    return {i: (links[i], roots[i], roots[i] == i) for i in ids}


@pytest.mark.parametrize("block", [2048, 16])
def test_embedding_components(spark, monkeypatch, block):
    monkeypatch.setattr(embed_dedup, "BLOCK", block)
    rng = np.random.default_rng(19)
    rows, i = [], 0
    for label in (0, 1, None):
        for _ in range(25):
            v = rng.standard_normal(24)
            for scale in [0, *rng.choice([0, 0.05, 0.1, 0.2, 0.5], size=rng.integers(0, 4))]:
                rows.append((i, (v + scale * rng.standard_normal(24)).tolist(), label))
                i += 1
    rows += [(1000, None, 0), (1001, [], 0), (1002, [0.0] * 24, 0), (1003, [1.0, None] + [0.0] * 22, 0), (1004, [float("nan")] * 24, 0), (1005, [float("inf")] + [0.0] * 23, 0), (1006, [1.0, 0.0], 1), (1007, [2.0, 0.0], 1)]
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embed_dedup.embedding_components(_vectors(spark, rows)).collect()}
    assert got == _linked(rows)


def test_embedding_tables_keep_their_recall(spark, monkeypatch):
    monkeypatch.setattr(embed_dedup, "CELL_VECTORS", 40)
    monkeypatch.setattr(embed_dedup, "WHOLE_VECTORS", 160)
    rng = np.random.default_rng(23)
    rows = []
    for c in range(150):
        v = rng.standard_normal(32)
        rows += [(4 * c + j, (v + 0.15 * j * rng.standard_normal(32)).tolist(), 1) for j in range(4)]
    expected = _linked(rows)
    got = {r.vec_id: r.n_links for r in embed_dedup.embedding_components(_vectors(spark, rows)).collect()}
    assert all(got[i] <= expected[i][0] for i in got)
    assert sum(got.values()) >= 0.97 * sum(x[0] for x in expected.values())
    near, far = embed_dedup.cell_chances(np.sqrt(2 - 2 * 0.93))
    assert 0.5 < far + 0.1 < near < 1


def test_embedding_edges(spark):
    assert embed_dedup.embedding_components(_vectors(spark, [])).count() == 0
    rows = [(5, [1.0, 0.0], 1), (5, [1.0, 0.0], 1), (3, [1.0, 0.0], 1), (None, [0.0, 1.0], 1)]
    got = sorted([tuple(r) for r in embed_dedup.embedding_components(_vectors(spark, rows)).collect()], key=str)
    assert got == sorted([(5, 2, 3, False), (5, 2, 3, False), (3, 2, 3, True), (None, 0, None, False)], key=str)


def test_long_texts_in_parts(monkeypatch):
    """What is read in parts gives what the whole gives."""
    rng = random.Random(12)
    text = " ".join(rng.choice(["Alpha", "be", "gam\tma", "d\n\ne", "é"]) for _ in range(4000)).encode()
    short = [b"", b" ", b"one", b"one two", b"one two three four", b"x" * 3000 + b" y " + b"z" * 3000]
    whole = [(simhash.fingerprint(t, 3), simhash.fingerprint(t, 5, 2, distinct=True), simhash.shingles(t, 5, simhash._WordHashes()).tolist()) for t in [text, *short]]
    monkeypatch.setattr(simhash, "PART", 100)
    monkeypatch.setattr(simhash, "WORDS", 2)
    assert [(simhash.fingerprint(t, 3), simhash.fingerprint(t, 5, 2, distinct=True), simhash.shingles(t, 5, simhash._WordHashes()).tolist()) for t in [text, *short]] == whole


def test_segments_in_parts(monkeypatch):
    """Every window lies in just one segment, with the key that it has in the whole text."""
    import pyarrow as pa

    rng = np.random.default_rng(3)
    texts = {1: bytes(rng.integers(97, 100, 9000).astype(np.uint8)), 2: b"short", 5: b"q" * 700, 4: bytes(rng.integers(97, 123, 2500).astype(np.uint8))}
    texts[7] = texts[4][300:2000]
    batch = pa.RecordBatch.from_arrays([pa.array(list(texts), pa.int64()), pa.array(list(texts.values()), pa.binary())], names=["doc_id", "bytes"])
    monkeypatch.setattr(suffix_dedup, "BLOCK_BYTES", 1024)
    monkeypatch.setattr(suffix_dedup, "JOINED_BLOCKS", 3)
    seen = {}
    for out in suffix_dedup._find_segments(100)(iter([batch])):
        for h, s, d, start, n in zip(*(c.to_pylist() for c in out.columns), strict=True):
            for i in range(start, start + n):
                assert (d, i) not in seen
                seen[d, i] = h if s is not None else None
    for d, t in texts.items():
        keys = suffix_dedup.window_keys(np.frombuffer(t, dtype=np.uint8), 100)[0].view(np.int64).tolist() if len(t) >= 100 else []
        assert sorted(i for x, i in seen if x == d) == list(range(len(keys)))
        assert all(seen[d, i] in (k, None) for i, k in enumerate(keys))


def test_smaller_values():
    rng = random.Random(2)
    for _ in range(200):
        v = np.array([rng.randrange(6) for _ in range(rng.randrange(0, 30))], dtype=np.int32)
        before = [max((j for j in range(i) if v[j] < v[i]), default=-1) for i in range(len(v))]
        after = [min((j for j in range(i + 1, len(v)) if v[j] < v[i]), default=-1) for i in range(len(v))]
        assert suffix_dedup.previous_smaller(v).tolist() == before and suffix_dedup.next_smaller(v).tolist() == after
    down = np.arange(100_000, 0, -1, dtype=np.int32)
    assert (suffix_dedup.previous_smaller(down) == -1).all()
