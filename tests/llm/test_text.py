"""Tokens, packing, segmentations, quality, HTML, WARC and search: round trips, brute force and edges."""

import hashlib
import random
import tempfile
import zlib
from collections import defaultdict
from itertools import product

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import html_text, packing, quality, sentence_pieces, token_counts, topk, warc
from tidemark.llm.common import materialise
from tidemark.llm.pieces import BytePieces, WordPieces

WORDS = public_tokenizers.path("word_bpe_49k.json")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
MODEL = public_tokenizers.path("piece_bpe_32k.model")
TEXTS = ["", " ", "Hello, World's end!!", "l'été ÉTÉ  a\n\n b\tc", "x²³½ 漢字かな Σίσυφος ΣΑΣ İstanbul", "it's they're 12345 _a_b_ a b", "<|endoftext|> and <|startoftext|>", "a" * 3000, "é" * 500 + " 😀👍🏽 é", "\x1c\x1d a b ​\0", "I'M you'LL '' 's 'tis", "ªº µ ŉ ſ ß ÿ × ÷"]


@pytest.fixture(scope="module")
def word_pieces():
    return WordPieces(WORDS)


@pytest.fixture(scope="module")
def byte_pieces():
    return BytePieces(RANKS, public_tokenizers.PATTERN)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from("aAbé '!.,\n\t 1ßÉ's")), max_size=60))
def test_cached_ids_are_the_libraries(word_pieces, byte_pieces, text):
    assert word_pieces.encode(text).tolist() == word_pieces.library.encode(text, add_special_tokens=False).ids
    assert byte_pieces.encode(text).tolist() == byte_pieces.engine.encode_ordinary(text)


@pytest.mark.parametrize("text", TEXTS)
def test_ids_of_odd_texts(word_pieces, byte_pieces, text):
    for _ in range(2):  # from an empty and a filled cache
        assert word_pieces.encode(text).tolist() == word_pieces.library.encode(text, add_special_tokens=False).ids
        assert byte_pieces.encode(text).tolist() == byte_pieces.engine.encode_ordinary(text)


def _docs(spark, rows):
    return spark.createDataFrame([(d, t, 1, 2, "x") for d, t in rows], "doc_id long, text string, start int, length int, __text string")


def test_token_counts(spark, byte_pieces):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(50, None), (None, "no id\nhere"), (51, "same"), (51, "same"), (52, "\n\nab\n" * 3 + "end")]
    for rule in token_counts.RULES:
        got = token_counts.token_counts(_docs(spark, rows), RANKS, public_tokenizers.PATTERN, rule).collect()
        sums = defaultdict(float)
        for r in got:
            sums[r.doc_id] += r.n_tokens
        for d, t in rows:
            if t and d not in (51,):
                assert sums[d] == pytest.approx(len(byte_pieces.engine.encode_ordinary(t)))
        assert sums[51] == 2 * len(byte_pieces.engine.encode_ordinary("same"))
        assert not {0, 50} & set(sums)
    with pytest.raises(ValueError, match="rule"):
        token_counts.token_counts(_docs(spark, rows), RANKS, public_tokenizers.PATTERN, "other")
    assert token_counts.token_counts(_docs(spark, []), RANKS, public_tokenizers.PATTERN).count() == 0


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 5), min_size=1, max_size=12), st.data())
def test_attribution_rules(lengths, data):
    size = sum(lengths)
    starts = sorted({0, *data.draw(st.sets(st.integers(0, size - 1), max_size=5))})
    bounds = [*starts, size]
    expected = {r: [0.0] * len(starts) for r in token_counts.RULES}
    crossing, at = [0] * len(starts), 0
    for n in lengths:
        shares = [max(0, min(bounds[i + 1], at + n) - max(bounds[i], at)) for i in range(len(starts))]
        first = next(i for i, s in enumerate(shares) if s)
        crossing[first] += sum(s > 0 for s in shares) > 1
        expected["first"][first] += 1
        expected["most"][shares.index(max(shares))] += 1
        for i, s in enumerate(shares):
            expected["share"][i] += s / n
        at += n
    for rule in token_counts.RULES:
        tokens, over = token_counts.attribute(np.array(lengths), np.array(starts), rule)
        assert tokens.tolist() == pytest.approx(expected[rule]) and over.tolist() == crossing


def test_field_token_counts(spark, byte_pieces):
    rows = [(1, "A title", "Some body, é and more.", "tail"), (2, None, "", None), (3, "", "only", ""), (None, "x", None, "y"), (1, "A title", "Some body, é and more.", "tail")]
    df = spark.createDataFrame([(*r, "field") for r in rows], "doc_id long, title string, body string, note string, field string")
    for rule in token_counts.RULES:
        got = token_counts.field_token_counts(df, ("title", "body", "note"), RANKS, public_tokenizers.PATTERN, rule).collect()
        assert len(got) == 3 * len(rows)
        for d, *parts in rows:
            text = "\n".join(p or "" for p in parts)
            own = [r for r in got if r.doc_id == d][:3]
            assert sum(r.n_tokens for r in own) == pytest.approx(len(byte_pieces.encode(text)))
            assert [text[r.start : r.stop].rstrip("\n") for r in own] == [p or "" for p in parts]
    assert token_counts.field_token_counts(df.limit(0), ("title",), RANKS, public_tokenizers.PATTERN).count() == 0


def test_packing(spark, word_pieces):
    rng = random.Random(1)
    rows = [(0, None), (1, ""), (2, "one two"), (2, "one two"), (None, "no id")] + [(i, " ".join(rng.choice(["alpha", "be", "gamma!"]) for _ in range(rng.randrange(1, 300)))) for i in range(10, 80)] + [(90, "word " * 5000)]
    size = 64
    got = packing.pack(_docs(spark, rows).repartition(3), WORDS, size).collect()
    pieces, sequences = defaultdict(list), defaultdict(list)
    for p in got:
        pieces[p.doc_id].append(p)
        sequences[p.sequence_id].append(p)
    for d, t in rows:
        ids = np.array([*word_pieces.library.encode(t or "", add_special_tokens=False).ids, 1], dtype="<u4").tobytes()
        own = pieces[d]
        assert all(p.doc_tokens == len(ids) // 4 and p.ids_crc32 == zlib.crc32(ids[4 * p.start : 4 * (p.start + p.length)]) for p in own)
        times = sum(1 for x in rows if x[0] == d)
        assert sorted(i for p in own for i in range(p.start, p.start + p.length)) == sorted(list(range(len(ids) // 4)) * times)
    for s in sequences.values():
        at = 0
        for p in sorted(s, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= size and at & (at - 1) == 0  # nothing is padded
    assert packing.pack(_docs(spark, []), WORDS).count() == 0
    with pytest.raises(ValueError, match="power"):
        packing.pack(_docs(spark, []), WORDS, 100)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 15), min_size=1, max_size=60), st.integers(1, 6))
def test_sum_of_squares_is_least(sizes, most):
    packer = packing.SumOfSquares(16, most)
    placed = []
    for i, s in enumerate(sizes):
        before = packer.count.copy()

        def cost(h, s=s, before=before):
            n = before.copy()
            if h:
                n[h] -= 1
            if h + s < 16:
                n[h + s] += 1
            elif h + s > 16:
                n[h + s - 16] += 1
            return int((n**2).sum())

        options = [h for h in range(1, 16 - s + 1) if before[h]] + [0] * int(before.sum() < most)
        options = options or [h for h in range(1, 16) if before[h]]
        full = packer.place(i, s)
        assert int((packer.count**2).sum()) == min(map(cost, options))
        assert packer.opened == packer.count.sum() <= most
        if full:
            assert sum(n for _, _, n in full) == 16
            placed += full
    cut = [(i, at + k) for i, at, n in placed + packer.rest() for k in range(n)]
    assert sorted(cut) == [(i, k) for i, s in enumerate(sizes) for k in range(s)]


@pytest.mark.parametrize("streams", [1, 8, 32])
def test_most_tokens_are_placed_by_sum_of_squares(streams):
    rng = np.random.default_rng(5)
    sizes = np.minimum(rng.lognormal(6, 0.9, 10_000).astype(int) + 1, 20_000) % 2048
    left = 0
    for part in np.array_split(sizes[sizes > 0], streams):
        packer = packing.SumOfSquares(2048)
        for i, s in enumerate(part.tolist()):
            packer.place(i, s)
        left += sum(n for _, _, n in packer.rest())
    assert left < 0.1 * sizes.sum()


@pytest.fixture(scope="module")
def sampler():
    return sentence_pieces.Sampler(MODEL)


def _paths(sampler, text):
    chunks = sentence_pieces._CHUNKS.findall(sampler.model.normalize(text))

    def walk(steps, at):
        if at == len(steps):
            return [((), 0.0)]
        return [((*ids, *rest), p + q) for p, to, ids in steps[at] for rest, q in walk(steps, to)]

    parts = [walk(sampler.lattice(c)[0], 0) for c in chunks]
    return {tuple(i for x in way for i in x[0]): sum(x[1] for x in way) for way in product(*parts)}


@pytest.mark.parametrize("text", ["", "abc", "a bc", "héé 你"])
def test_segmentations_are_sampled_without_replacement(sampler, text):
    paths = _paths(sampler, text)
    assert sum(np.exp(list(paths.values()))) == pytest.approx(1)
    every = sampler.sample(text, 500, 1)
    assert {tuple(i) for i, _, _ in every} == set(paths) and all(s == 1 for _, _, s in every)
    assert all(p == pytest.approx(paths[tuple(i)]) for i, p, _ in every)
    n, first, inclusion = 1500, defaultdict(int), defaultdict(float)
    for seed in range(n):
        some = sampler.sample(text, 2, seed)
        assert len({tuple(i) for i, _, _ in some}) == len(some) == min(2, len(paths))
        first[tuple(some[0][0])] += 1
        for i, p, s in some:
            inclusion[tuple(i)] += np.exp(p) / s / n
    for path, p in paths.items():
        assert first[path] / n == pytest.approx(np.exp(p), abs=0.05)
        if np.exp(p) > 0.01:
            assert inclusion[path] == pytest.approx(np.exp(p), rel=0.35)


def test_sampled_rows(spark, sampler):
    rows = [(1, 0, "hello world", 9), (1, 1, None, 9), (None, 2, "x", 9), (1, 0, "hello world", 9), (2, 0, "été 漢字 😀 " * 5, 9)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, text string, rank int")
    run = lambda d: [tuple(map(str, r)) for r in sentence_pieces.sample_segmentations(d, ("conv_id", "turn"), MODEL).collect()]
    got = sentence_pieces.sample_segmentations(df, ("conv_id", "turn"), MODEL).collect()
    assert sorted(run(df)) == sorted(run(df.repartition(3)))
    texts = {(c, t): x for c, t, x, _ in rows}
    for r in got:
        assert r.decoded == sampler.decode(sampler.model.encode(texts[r.conv_id, r.turn] or ""))
        assert sampler.decode(r.ids) == r.decoded and 0 < r.inclusion <= 1
    assert sum(r.turn == 1 for r in got) == 1
    assert run(df.limit(0)) == []


def test_quality(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 9)))
    good = lambda: " ".join(word() for _ in range(60)).capitalize() + "."
    bad = lambda: " ".join(word().upper() + "!!" for _ in range(60))
    rows = [(i, bad() if i % 5 == 0 else good()) for i in range(400)] + [(500, None), (501, ""), (None, good()), (3, good())]
    docs = spark.createDataFrame([(d, t, "en", 0.0, "x") for d, t in rows], "doc_id long, text string, lang string, score double, __text string")
    labels = spark.createDataFrame([(i, int(i % 5 != 0), 0) for i in range(400)] + [(1, None, 0), (None, 1, 0), (2, 1, 0), (999, 0, 0)], "doc_id long, quality int, toxic int")
    got = quality.classify(docs, labels).collect()
    assert len(got) == len(rows)
    for r in got:
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7)
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        if r.doc_id is not None and r.doc_id < 400:
            assert r.predicted == int(r.doc_id % 5 != 0)
    flipped = labels.selectExpr("doc_id", "case when crc32(cast(doc_id as string)) % 4 = 2 then 1 - quality else quality end as quality")
    assert {(r.doc_id, r.score) for r in quality.classify(docs, flipped).collect()} == {(r.doc_id, r.score) for r in got}  # held-out labels change nothing
    assert {r.score for r in quality.classify(docs, labels.limit(0)).collect()} == {0.5}
    assert quality.classify(docs.limit(0), labels).count() == 0


def test_votes_by_brute_force():
    """Against the vote written out, with copies at the last neighbour's place and texts like nothing."""
    rng = np.random.default_rng(8)
    texts = [bytes(rng.choice(list(b"abc ABC.,!1\n"), size=rng.integers(0, 60))) for _ in range(60)]
    texts += [texts[0]] * 20 + [b"", b""]
    labels = rng.integers(0, 2, len(texts))
    model = quality.Model(np.array([quality.terms(t) for t in texts]), labels, 10)
    asked = [*texts[:10], b"", b"zz zz zz", b"A. " * 50]
    got = model.score(np.array([quality.terms(t) for t in asked]), 12)
    for t, score in zip(asked, got, strict=True):
        v = model.project(quality.terms(t)[None])[0]
        near = sorted(((round(float(np.float32(v) @ p), 5), int(y)) for p, y in zip(model.points, labels, strict=True)), reverse=True)
        last = near[11][0]
        above, tied = [x for x in near if x[0] > last + 2e-6], [x for x in near if abs(x[0] - last) <= 2e-6]
        share = (12 - len(above)) / len(tied)
        votes = [(max(c, 0) ** quality.POWER, y) for c, y in above] + [(share * max(c, 0) ** quality.POWER, y) for c, y in tied]
        total = sum(w for w, _ in votes)
        assert score == pytest.approx(sum(w * y for w, y in votes) / total if total else 0.5, abs=1e-3)
    order = rng.permutation(len(texts))
    again = quality.Model(np.array([quality.terms(texts[i]) for i in order]), labels[order], 10).score(np.array([quality.terms(t) for t in asked]), 12)
    assert again == pytest.approx(got, abs=1e-3)  # no order of the sample decides


def test_model_takes_little_memory_and_is_that_of_the_whole_sample():
    import tracemalloc

    rng = np.random.default_rng(9)
    features = np.sqrt(rng.random((3000, quality.TERMS), dtype=np.float32) * (rng.random((3000, quality.TERMS)) < 0.1)).astype("<f4")
    features[:, :8] *= np.arange(9, 1, -1, dtype=np.float32) * rng.integers(1, 9, (3000, 1))
    tracemalloc.start()
    model = quality.Model(features, np.arange(3000) % 2, 4)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 4 * features.nbytes
    x = features * (np.log(3001 / (1 + (features > 0).sum(axis=0))) + 0.1)
    x -= x.mean(axis=0)
    v = x @ np.linalg.eigh(x.T @ x)[1][:, ::-1][:, :4]
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    assert np.abs(model.points @ model.points[:50].T - v @ v[:50].T).max() < 1e-3


def test_terms_in_parts(monkeypatch):
    text = b"Aa bb bb cc aa, 12\nAa bb bb cc aa, 12\n\nx" * 40
    whole = quality.terms(text)
    monkeypatch.setattr(quality, "PART", 7)
    assert quality.terms(text) == pytest.approx(whole)
    words = text.split()
    assert whole[-4] ** 2 == pytest.approx(sum(a == b for a, b in zip(words, words[1:], strict=False)) / len(words))
    assert whole[-3] ** 2 == pytest.approx(sum(a == b for a, b in zip(words, words[2:], strict=False)) / len(words))
    assert quality.terms(None)[-1] == 1 and not quality.terms(b"")[:-1].any()


ARTICLE = '<html><head><title>T</title><style>p{}</style></head><body><nav><a>Menu</a></nav><div class="ad">Buy</div><article><h1>Head&amp;line</h1><p><b>One<br>two<p>Three\n  &nbsp;four</p><script>x("</p>")</script><div class="comments"><p>Nice</p></div></article><footer>&copy; us</footer></body></html>'


def test_html_main_text():
    assert html_text.main_text(ARTICLE) == "Head&line\n\nOne two\n\nThree four"
    assert html_text.main_text("") == "" and html_text.main_text("plain < text & more") == "plain < text & more"
    assert html_text.main_text("<p>a<ul><li>b<li>c</ul>d<table><tr><td>e<td>f</table>") == "a\n\nb\n\nc\n\nd\n\ne\n\nf"
    assert html_text.main_text("<main><form><input>go</form>kept<aside>no</aside></main>") == "kept"
    assert html_text.main_text("<div hidden>a</div><div style='display: none'>b</div><p>c<!-- <p>d -->") == "c"
    assert html_text.main_text("<div role=navigation>a</div><section id='cookie-notice'>b</section>c") == "c"
    assert html_text.main_text("<p>" + "<b>" * 5000 + "deep" + "</b>" * 5000) == "deep"


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="<>/ab p=\"'!-&;divlt", max_size=80))
def test_html_never_fails(source):
    root = html_text.parse(source)
    html_text.candidates(root, html_text.subtree_hashes(root))
    html_text.main_text(source)


def test_site_templates(spark):
    page = lambda i, own, extra="": (i, f"http://a.example/{i}?q", f"<body><div>Site of the year<p>All about us</p></div><p>{own}</p>{extra}</body>")
    rows = [page(i, f"text {i}") for i in range(12)] + [(100, "http://b.example/", "<body><div>Site of the year<p>All about us</p></div><p>b</p></body>"), (101, None, None), (102, "http://a.example/x", ""), (None, "http://a.example/n", "<p>no id</p>"), (0, "http://a.example/0?q", rows_0 := page(0, "text 0")[2])]
    assert rows_0
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, host string, article int")
    got = html_text.extract(df).collect()
    assert len(got) == len(rows)
    text = {r.page_id: r.text for r in got}
    assert all(text[i] == f"text {i}" for i in range(12))
    assert text[100] == "Site of the year\n\nAll about us\n\nb" and text[101] == "" and text[102] == "" and text[None] == "no id"
    assert all(r.n_chars == len(r.text) for r in got)
    assert html_text.extract(df.limit(0)).count() == 0
    copies = spark.createDataFrame([(i, "http://c.example/", ARTICLE) for i in range(30)], "page_id long, url string, html string")
    assert {r.text for r in html_text.extract(copies).collect()} == {"Head&line\n\nOne two\n\nThree four"}


def test_templates_by_brute_force(spark):
    """Against templates counted page by page: menus, adverts and boxes in the article, without telling names."""
    rng = random.Random(4)
    words = lambda n: " ".join(rng.choice("abcdefgh") * rng.randrange(1, 5) for _ in range(n))
    menus, boxes = [f"<div>{words(6)}</div>" for _ in range(4)], [f"<section><p>{words(5)}</p></section>" for _ in range(2)]
    rows = []
    for i in range(120):
        body = "".join(f"<p>{words(8)}</p>" for _ in range(3)) + rng.choice(boxes) + "<p>a passage that recurs</p>"
        article = f"<article>{body}</article>" if i % 4 else body
        rows.append((i, f"http://h{i % 40 == 0}.example/{i}", f"<body>{rng.choice(menus)}{article}<div>{rng.choice(menus)}</div></body>"))
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    on = defaultdict(set)
    for i, _, source in rows:
        root = html_text.parse(source)
        article, keys = html_text.candidates(root, html_text.subtree_hashes(root))
        for k in keys:
            on[i % 40 == 0, k].add(article)
    templates = {h: {k for (x, k), a in on.items() if x == h and len(a) >= (8 if k % 2 else 3)} for h in (True, False)}
    got = {r.page_id: r for r in html_text.extract(df).collect()}
    for i, _, source in rows:
        text, deleted = html_text.cleaned(source, templates[i % 40 == 0])
        assert (got[i].text, got[i].template_subtrees) == (text, deleted)
        assert i % 40 == 0 or deleted == 3 and text.endswith("a passage that recurs") and len(text.split("\n\n")) == 4
    assert all(r.template_subtrees == 0 for r in html_text.extract(df.limit(2)).collect())


@pytest.mark.parametrize("version", [1, 2])
def test_arc_conversion(version):
    blocks = [b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n<p>x\n\n</p>", b"plain\nhttp://not.a/header 1 2 3 4\n", b""]
    arc = warc.arc_file_header(version, "20240102030405") + b"".join(warc.arc_record(version, f"http://h/{i} x", "1.2.3.4", "20240102030405", "text/html", b) for i, b in enumerate(blocks))
    records = list(warc.read_arc(arc))
    assert [r.block for r in records] == blocks and {r.version for r in records} == {version} and records[0].url == "http://h/0%20x"
    archive = b"".join(warc.gzip_member(warc.convert(r, warc.record_id(r.url))) for r in records)
    read = list(warc.read_warc(archive))
    assert [h["warc-type"] for h, _ in read] == ["response", "resource", "resource"] and [b for _, b in read] == blocks
    head = read[0][0]
    assert head["warc-date"] == "2024-01-02T03:04:05Z" and head["warc-record-id"].startswith("<urn:uuid:")
    assert head["warc-payload-digest"] == warc.sha1_label(b"<p>x\n\n</p>") and head["warc-block-digest"] == warc.sha1_label(blocks[0])
    with pytest.raises(ValueError, match="passes the end"):
        list(warc.read_arc(arc[: arc.index(b"<p>x")]))
    with pytest.raises(ValueError, match="fields"):
        list(warc.read_arc(warc.arc_file_header(version, "2024") + b"one two 3\nabc"))
    with pytest.raises(ValueError, match="filedesc"):
        list(warc.read_arc(b"http://x 1 2 3 0\n"))
    assert warc.warc_date("1999") == "1999-01-01T00:00:00Z"


def test_archives_of_old_files(spark, tmp_path):
    """A folder of ARC files with broken parts: all records are converted, all else is kept beside them."""
    import gzip

    day, http = "20240102030405", b"HTTP/1.1 200 OK\r\n\r\n"
    record = lambda v, i, b: warc.arc_record(v, f"http://h/{i}", "1.2.3.4", day, "text/html", b)
    one = warc.arc_file_header(1, day) + record(1, 1, http + b"a") + b"http://h/x 1.2.3.4 20240102030405 only-four\nlost\n" + record(1, 2, b"b\nc") + record(1, 3, b"")
    two = warc.arc_file_header(2, day) + record(2, 4, http + b"d") + record(2, 5, b"cut short")[:-6]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.arc").write_bytes(one)
    (tmp_path / "in" / "b.arc.gz").write_bytes(gzip.compress(two))
    (tmp_path / "in" / "c.arc").write_bytes(b"nothing of the kind")
    (tmp_path / "in" / "d.arc.gz").write_bytes(gzip.compress(two)[:20])
    rows = warc.convert_archives(spark, f"file://{tmp_path}/in", f"file://{tmp_path}/out").collect()
    good = [r for r in rows if r.problem is None]
    assert sorted((r.url, r.warc_type, r.length) for r in good) == [("http://h/1", "response", 20), ("http://h/2", "resource", 3), ("http://h/3", "resource", 0), ("http://h/4", "response", 20)]
    assert len({r.record_id for r in good}) == 4 and {r.payload_digest for r in good} >= {hashlib.sha1(x).hexdigest() for x in (b"a", b"b\nc", b"", b"d")}
    problems = sorted(r.problem.split(":")[0] for r in rows if r.problem)
    assert problems == ["4 fields in a header of ARC version 1", "an ARC file begins with a filedesc", "declared length 9 passes the end", "not to be unpacked"]
    archives = [x for x in (tmp_path / "out").iterdir() if x.name.endswith(".warc.gz")]
    assert sorted(h["warc-record-id"] for x in archives for h, _ in warc.read_warc(x.read_bytes())) == sorted(r.record_id for r in good)
    assert b"lost" in b"".join(x.read_bytes() for x in (tmp_path / "out").iterdir() if x.name.endswith(".broken"))


def test_record_ids_are_unique(spark):
    same = "x" * 1200
    rows = [(1, "u", same), (1, "u", same), (2, "v", same), (None, "n", same), (None, "n", same), (None, "m", "short"), (None, "m", "short"), (3, "w", "short")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    folder = "file://" + tempfile.mkdtemp()
    archives = materialise(warc.write_pages(df, folder), "list")
    read = warc.read_records(spark, folder, archives).collect()
    assert len(read) == len(rows) and len({r.record_id for r in read}) == len(rows)
    main = next(r for r in read if r.page_id == 2)
    assert {r.refers_id for r in read if r.payload_bytes == 1200 and r.page_id != 2} == {main.record_id}


def test_archives(spark):
    big, other = "<p>" + "é" * 600 + "</p>", "x" * 1000
    rows = [(1, "http://a/1", big), (9, "http://a/9", big), (4, "http://a b/4", big), (2, "u", "small"), (3, "u", "small"), (5, None, None), (6, "u", ""), (7, "u", other), (7, "u", other), (None, "u", other), (8, "u", "y" * 999), (10, "u", "y" * 999)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, digest string, main int")
    got = sorted([tuple(r) for r in warc.archive_pages(df).collect()], key=str)
    expected = []
    for page, _, html in rows:
        body = (html or "").encode()
        same = [p for p, _, h in rows if (h or "").encode() == body and p is not None]
        main = max(same) if len(body) >= 1000 else page
        kind = "response" if main == page else "revisit"
        expected.append((page, len(body), hashlib.sha1(body).hexdigest(), kind, main if kind == "revisit" else None))
    assert got == sorted(expected, key=str)
    assert warc.archive_pages(df.limit(0)).count() == 0


def test_top_k(spark, monkeypatch):
    monkeypatch.setattr(topk, "SHARD_VALUES", 800)
    monkeypatch.setattr(topk, "CHUNK_VALUES", 24)
    rng = np.random.default_rng(4)
    rows = [(i, rng.standard_normal(8).round(2).tolist()) for i in range(400)] + [(400 + i, [0.5] * 8) for i in range(15)] + [(500, None), (501, [None] * 8), (502, [float("nan")] * 8), (503, [1.0, 2.0]), (600, [3.0, 1.0]), (None, [1.0] * 8), (0, rng.standard_normal(8).round(2).tolist())]
    rows[-1] = (0, rows[0][1])
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, embedding array<float>, rank int, dim int")
    got = sorted(tuple(r) for r in topk.top_k(df, df.where("vec_id % 100 = 0")).collect())
    q = {i: [int(np.floor(1024 * float(np.float32(x)))) for x in v] for i, v in rows if i is not None and v and all(x is not None and x == x for x in v)}
    expected = []
    for a in q:
        if a % 100 == 0:
            best = sorted((-sum(x * y for x, y in zip(q[a], q[b], strict=True)), b) for b in q if b != a and len(q[b]) == len(q[a]))[:10]
            expected += [(a, n, b, -s) for n, (s, b) in enumerate(best, 1)]
    assert got == sorted(expected)
    assert topk.top_k(df.limit(0), df).count() == 0


def test_blocks_are_pruned():
    rng = np.random.default_rng(6)
    docs = np.floor(1024 * (rng.standard_normal((40, 16))[rng.integers(0, 40, 4000)] + 0.1 * rng.standard_normal((4000, 16))))
    index = topk.BlockIndex(np.arange(4000), docs)
    bounds = index.bounds(docs[:20])
    for i in range(20):
        ids, scores = index.search(i, docs[i], bounds[i], 10)
        s = docs @ docs[i]
        s[i] = -np.inf
        order = np.lexsort((np.arange(4000), -s))[:10]
        assert ids.tolist() == order.tolist() and scores.tolist() == s[order].tolist()
    assert index.scored < 0.5 * 20 * 4000
