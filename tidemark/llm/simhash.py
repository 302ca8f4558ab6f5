"""SimHash near-duplicates by covering locality-sensitive hashing, and near-duplicates by exact similarity.

Every fingerprint bit i gets one of the 2^(r+1)-1 non-zero vectors m(i) of r+1 bits.  Table v (each
non-zero vector again) keeps the bits with an odd inner product <v, m(i)>.  For any r or fewer differing
bits some v is orthogonal to all their m(i), so that table's key ignores them: each pair within radius r
meets in at least one table, with no chance involved.

Where the link is the Jaccard index of shingle sets, candidates come from a prefix filter: with all shingles
in one global order, two sets of similarity s share one of their first n - ceil(s n) + 1 shingles, whatever
the order and the edit.  Frequent shingles are put last, so that prefixes hold what few documents share.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import connected_components, forget, join_keys, map_arrow, materialise, release, slices

BITS = 64
#: A table's bucket with more distinct fingerprints than this is linked through one-bit neighbours; up to
#: it, comparing a fingerprint with its bucket costs no more than listing its one-bit changes.
BUCKET = BITS
#: The order of shingles (and nothing else) rests on this many of the most frequent ones, counted in one of
#: so many texts.
FREQUENT, COUNTED = 1 << 16, 16
#: Prefix entries that are dealt by their shingles at once; more are dealt one slice of the shingles after the other.
DEALT = 1 << 26
#: Bytes of a text whose words are held at once.
PART = 1 << 20
#: Hashes of words that are kept for further texts.
WORDS = 1 << 18
_SPACE = re.compile(rb"[\x20\x09-\x0d]")


def covering_masks(radius: int, bits: int = BITS) -> list[int]:
    """The 2^(radius+1)-1 bit masks; any ``radius`` bit positions are all unset in at least one."""
    n = 2 ** (radius + 1) - 1
    return [sum(1 << i for i in range(bits) if bin(v & (i % n + 1)).count("1") % 2) for v in range(1, n + 1)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _mixed(h: np.ndarray, nth: int) -> np.ndarray:
    """Further hashes from one: the hash itself, then finalised sums with odd constants."""
    if nth:
        h = h + np.uint64(nth * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        h = h ^ (h >> np.uint64(31))
    return h


def word_blocks(text: bytes) -> Iterator[list[bytes]]:
    """The lower-cased words of a text, for some of its bytes at a time; words are never parted."""
    if len(text) <= PART:
        yield text.lower().split()
        return
    at = 0
    while at < len(text):
        m = _SPACE.search(text, at + PART)
        stop = m.end() if m else len(text)
        yield text[at:stop].lower().split()
        at = stop


def shingle_blocks(text: bytes, words: int) -> Iterator[list[bytes]]:
    """A text's word shingles, in blocks; a text with fewer words is one shingle, one without words has none."""
    held: list[bytes] = []
    whole = True
    for found in word_blocks(text):
        held += found
        if len(held) >= words:
            whole = False
            yield held if words == 1 else [b" ".join(x) for x in zip(*(held[i:] for i in range(words)), strict=False)]
            held = held[len(held) - words + 1 :]
    if whole and held:
        yield [b" ".join(held)]


def fingerprint(text: bytes | None, words: int, prints: int = 1, seed: int = 42, distinct: bool = False) -> list[int]:
    """``prints`` independent 64-bit SimHashes of a text's word shingles: A-Z lower-cased, words cut at
    ASCII white space, XXH64 per shingle (mixed anew for those after the first); a bit is set if it is set
    in over half of the shingles.  No words: 0."""
    import xxhash

    counts, total, digest = np.zeros((prints, BITS), dtype=np.int64), 0, xxhash.xxh64_intdigest
    seen: set[bytes] = set()
    for found in shingle_blocks(text or b"", words):
        if distinct:
            found = list(set(found) - seen)
            seen.update(found)
        total += len(found)
        for at in range(0, len(found), 4096):
            part = found[at : at + 4096]
            h = np.fromiter([digest(s, seed) for s in part], dtype="<u8", count=len(part))
            for i in range(prints):
                counts[i] += np.unpackbits(_mixed(h, i).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint16)
    return np.packbits(2 * counts > total, axis=1, bitorder="little").view("<u8").ravel().tolist()


def fingerprints(docs: DataFrame, words: int = 3, prints: int = 1, seed: int = 42, distinct: bool = False, extra: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, extra..., fps): an array of signed 64-bit fingerprints of the whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = [[_signed(f) for f in fingerprint(t.as_py(), words, prints, seed, distinct)] for t in b.column(b.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(fps, pa.list_(pa.int64()))], names=[*b.schema.names[:-1], "fps"])

    source = docs.select("doc_id", *extra, F.col("text").cast("binary").alias("text"))
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1])
    return map_arrow(source, run, kept + ", fps array<long>")


def hamming_edges(classes: DataFrame, radius: int = 2, bucket: int = BUCKET) -> DataFrame:
    """(a, b): links between the ``rep`` of distinct ``fp`` values that differ in at most ``radius`` bits,
    among those with an equal ``nth``.

    Small buckets compare their members pair by pair.  In a larger one (radius 2 only) every fingerprint
    is listed under itself and its one-bit changes outside the key; two of them share such a value
    exactly if they differ in two bits or fewer, and at most 65 distinct ones can share one, so links to
    the smallest member of each value join all that belong together without listing all pairs.
    """
    if radius != 2:
        raise ValueError("the linking of large buckets holds for a radius of 2")
    masks = covering_masks(radius)
    keys = classes.select(
        "nth", "fp", "rep", F.explode(F.array(*[F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(m)).cast("long")).alias("k")) for t, m in enumerate(masks)])).alias("x")
    ).select("nth", "fp", "rep", "x.t", "x.k")
    sizes = keys.groupBy("nth", "t", "k").agg(F.count("*").alias("n")).where("n > 1")
    met = materialise(keys.join(sizes, ["nth", "t", "k"]), "simhash-buckets")
    small = met.where(F.col("n") <= bucket)
    x, y = small.alias("x"), small.alias("y")
    near = F.bit_count(F.col("x.fp").bitwiseXOR(F.col("y.fp"))) <= radius
    pairs = x.join(y, (F.col("x.nth") == F.col("y.nth")) & (F.col("x.t") == F.col("y.t")) & (F.col("x.k") == F.col("y.k")) & (F.col("x.rep") < F.col("y.rep")) & near)
    pairs = pairs.select(F.col("x.rep").alias("a"), F.col("y.rep").alias("b"))
    mask_of = F.element_at(F.array(*[F.lit(_signed(m)).cast("long") for m in masks]), F.col("t") + 1)
    flips = F.array(F.lit(0).cast("long"), *[F.lit(_signed(1 << i)).cast("long") for i in range(BITS)])
    large = met.where(F.col("n") > bucket).select("nth", "fp", "rep", F.explode(F.filter(flips, lambda f: f.bitwiseAND(mask_of) == 0)).alias("f"))
    large = materialise(large.select("nth", F.col("fp").bitwiseXOR(F.col("f")).alias("z"), "rep").distinct(), "simhash-changes")
    centres = large.groupBy("nth", "z").agg(F.min("rep").alias("a"), F.count("*").alias("n")).where("n > 1")
    stars = large.join(centres, ["nth", "z"]).where("rep != a").select("a", F.col("rep").alias("b"))
    return pairs.union(stars).distinct()


def simhash_components(docs: DataFrame, words: int = 3, radius: int = 2, seed: int = 42) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of ``docs`` (doc_id, text).

    Null and blank texts have fingerprint 0 and are linked like any other.  A text of any length is read in parts.  Rows with a null doc_id keep
    a fingerprint and join the component of equal fingerprints.  Repeated rows give repeated results.
    """
    fps = materialise(fingerprints(docs, words, seed=seed).select("doc_id", F.col("fps")[0].alias("fp")), "simhash")
    classes = fps.groupBy("fp").agg(F.min("doc_id").alias("rep")).where("rep is not null").withColumn("nth", F.lit(0))
    classes = materialise(classes, "simhash-classes")
    roots = connected_components(hamming_edges(classes, radius))
    named = classes.join(roots, classes.rep == roots.node, "left").select("fp", F.coalesce("root", "rep").alias("component_id"))
    return fps.join(named, "fp", "left").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        self[word] = h = xxhash.xxh64_intdigest(word, 0)
        return h


def shingles(text: bytes | None, words: int, hashes: _WordHashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's word shingles; a text with fewer words is one shingle."""
    blocks: list[np.ndarray] = []
    few: list[bytes] = []
    for found in word_blocks(text or b""):
        few += found[: words - len(few)]
        blocks.append(np.fromiter(map(hashes.__getitem__, found), dtype="<u8", count=len(found)))
        if len(hashes) > WORDS:
            hashes.clear()
    w = np.concatenate(blocks) if blocks else np.zeros(0, dtype="<u8")
    if len(w) < words:
        return np.array([hashes[b" ".join(few)]], dtype="<u8")
    n = len(w) - words + 1
    h = w[:n]
    for i in range(1, words):
        h = _mixed(h, i) + w[i : i + n]
    return np.unique(_mixed(h, words))


def sketch(hashes: np.ndarray) -> bytes:
    """The parities of the numbers of shingle hashes by their low bits, in as many bits as there are hashes, rounded up
    to a power of two.  Two sketches differ in no more bits than the sets have members that the other lacks."""
    bits = max(BITS, 1 << (len(hashes) - 1).bit_length())
    odd = np.bincount((hashes & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def sketch_distance(x: bytes, y: bytes) -> int:
    """The differing bits of two sketches, the longer one folded to the other's length."""
    if len(x) < len(y):
        x, y = y, x
    v, bits = int.from_bytes(x, "little"), 8 * len(x)
    while bits > 8 * len(y):
        bits //= 2
        v = (v >> bits) ^ (v & ((1 << bits) - 1))
    return (v ^ int.from_bytes(y, "little")).bit_count()


def possible_pairs(pairs: DataFrame, prints: DataFrame, similarity: float) -> DataFrame:
    """Those of ``pairs`` (a, b) whose sketches in ``prints`` (doc_id, n, sketch) don't exclude ``similarity``: of sets
    that reach it, at most (1 - s) / (1 + s) of both sizes together are members of one only."""
    apart = (1 - similarity) / (1 + similarity)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes = b.column(2).to_numpy() + b.column(3).to_numpy()
            far = np.fromiter((sketch_distance(x.as_py(), y.as_py()) for x, y in zip(b.column(4), b.column(5), strict=True)), dtype=np.int64, count=b.num_rows)
            yield b.select(["a", "b"]).filter(pa.array(far <= apart * sizes + 1e-6))

    x = prints.select(F.col("doc_id").alias("a"), F.col("n").cast("long").alias("nx"), F.col("sketch").alias("x"))
    y = prints.select(F.col("doc_id").alias("b"), F.col("n").cast("long").alias("ny"), F.col("sketch").alias("y"))
    return map_arrow(pairs.join(x, "a").join(y, "b").select("a", "b", "nx", "ny", "x", "y"), run, "a long, b long").distinct()


def similar_pairs(pairs: DataFrame, prints: DataFrame, docs: DataFrame, words: int, similarity: float) -> DataFrame:
    """Those of ``pairs`` (a, b; a written table) whose documents' distinct word shingles have a Jaccard index of at
    least ``similarity``, for any two of the texts that their ids have.  Sketches leave out what can't reach it, so
    shingles are written and dealt for few other pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hashes = _WordHashes()
            for part in slices(b, 64):
                out = [shingles(t.as_py(), words, hashes).view("<i8") for t in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(out, pa.list_(pa.int64()))], names=["doc_id", "grams"])

    close = materialise(possible_pairs(pairs, prints, similarity), "near-possible")
    wanted = materialise(close.select(F.col("a").alias("doc_id")).union(close.select(F.col("b").alias("doc_id"))).distinct(), "near-wanted")
    texts = join_keys(docs.select("doc_id", F.col("text").cast("binary").alias("text")), wanted, "doc_id", "left_semi")
    grams = materialise(map_arrow(texts, run, "doc_id long, grams array<long>"), "shingles")
    release(docs.sparkSession)
    both = close.join(grams.select(F.col("doc_id").alias("a"), F.col("grams").alias("x")), "a").join(grams.select(F.col("doc_id").alias("b"), F.col("grams").alias("y")), "b")
    shared = F.size(F.array_intersect("x", "y"))
    linked = both.select("a", "b", (shared / (F.size("x") + F.size("y") - shared)).alias("similarity")).where(F.col("similarity") >= similarity)
    linked = materialise(linked.select("a", "b"), "near-links")
    for done in (close, wanted, grams):
        forget(done)
    release(docs.sparkSession)
    return linked


def _parts(arrays: Iterable[np.ndarray], size: int = 1 << 18) -> Iterator[list[np.ndarray]]:
    """The arrays in lists of about ``size`` items."""
    part, total = [], 0
    for a in arrays:
        part.append(a)
        total += len(a)
        if total >= size:
            yield part
            part, total = [], 0
    if part:
        yield part


def frequent_shingles(texts: DataFrame, words: int, one_in: int = COUNTED, most: int = FREQUENT) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent shingles (sorted) of one in ``one_in`` of the ``texts`` (sha, text) and the binary
    order of their counts.  At most ``most`` of them reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hashes = _WordHashes()
            for part in _parts(shingles(t.as_py(), words, hashes) for t in b.column(0)):
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(part).view("<i8"))], names=["g"])

    some = texts.where(F.pmod(F.xxhash64("sha"), F.lit(one_in)) == 0).select("text")
    counts = map_arrow(some, run, "g long").groupBy("g").agg(F.count("*").alias("n")).where("n > 1")
    top = counts.orderBy(F.desc("n"), "g").limit(most).toArrow()
    found, n = (np.asarray(top.column(c).to_numpy(), dtype=np.int64) for c in ("g", "n"))
    found = found.view("<u8")
    order = np.argsort(found)
    return found[order], np.log2(n[order]).astype(np.int64)


def _majority(hashes: np.ndarray) -> int:
    """The SimHash of a set of shingle hashes."""
    counts = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(hashes), 4096):
        counts += np.unpackbits(hashes[at : at + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<i8")[0])


def shared_prefixes(texts: DataFrame, words: int, similarity: float) -> tuple[DataFrame, DataFrame]:
    """For ``texts`` (sha, doc_id, text) in one pass: (g, doc_id, n, at), the shingles of each document's prefix
    that stand in another's prefix too, the number of its shingles, and how many come before this one in the
    global order; and (doc_id, fp, n, sketch), the SimHash, number and sketch of all its shingles."""
    frequent, level = frequent_shingles(texts, words)

    def prefix(text: bytes | None, hashes: _WordHashes, sizes: list[int], prints: list[int], sketches: list[bytes]) -> np.ndarray:
        g = shingles(text, words, hashes)
        sizes.append(len(g))
        prints.append(_majority(g))
        sketches.append(sketch(g))
        if len(frequent):
            near = np.minimum(np.searchsorted(frequent, g), len(frequent) - 1)
            g = g[np.argsort(np.where(frequent[near] == g, level[near], 0), kind="stable")]
        return g[: len(g) - int(np.ceil(similarity * len(g) - 1e-9)) + 1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hashes, sizes, prints, sketches, done = _WordHashes(), [], [], [], 0
            for part in _parts(prefix(t.as_py(), hashes, sizes, prints, sketches) for t in b.column(1)):
                here = slice(done, done + len(part))
                k, n, of = np.array([len(g) for g in part]), np.array(sizes[here], dtype=np.int32), np.arange(done, done + len(part))
                done += len(part)
                # before the entries one row for each document: its fingerprint and sketch, at place -1
                at = np.concatenate([np.full(len(part), -1, dtype=np.int32), *(np.arange(i, dtype=np.int32) for i in k)])
                g = np.concatenate([np.array(prints[here], dtype=np.int64), *(x.view("<i8") for x in part)])
                ids = b.column(0).take(pa.array(np.concatenate([of, np.repeat(of, k)])))
                told = pa.concat_arrays([pa.array(sketches[here], pa.binary()), pa.nulls(int(k.sum()), pa.binary())])
                yield pa.RecordBatch.from_arrays([pa.array(g), ids, pa.array(np.concatenate([n, np.repeat(n, k)])), pa.array(at), told], names=["g", "doc_id", "n", "at", "sketch"])

    entries = materialise(map_arrow(texts.select("doc_id", "text"), run, "g long, doc_id long, n int, at int, sketch binary"), "near-prefixes")
    prints = materialise(entries.where("at < 0").select("doc_id", F.col("g").alias("fp"), "n", "sketch").distinct(), "near-prints")
    met = shared_entries(entries.where("at >= 0").select("g", "doc_id", "n", "at"))
    forget(entries)
    return met, prints


def shared_entries(entries: DataFrame, dealt: int = DEALT) -> DataFrame:
    """The rows of ``entries`` (g, ...; read from a table) whose g recurs.  About ``dealt`` of them are dealt at a time,
    so that the disk that this takes besides its result is bounded."""
    parts, met = max(1, -(-entries.count() // dealt)), None
    for k in range(parts):
        some = entries.where(F.pmod("g", F.lit(parts)) == k) if parts > 1 else entries
        again = materialise(some.groupBy("g").agg(F.count("*").alias("docs")).where("docs > 1").select("g"), "near-again")
        release(entries.sparkSession)
        met = materialise(some.join(again, "g"), "near-shared", onto=met)
        forget(again)
        release(entries.sparkSession)
    return met


def _may_reach(similarity: float) -> Column:
    """Of two prefix entries x, y with the same shingle: whether the sizes, and what is left after the shingle,
    allow ``similarity``, if it is the first that the documents share."""
    x, y = F.col("x.n"), F.col("y.n")
    most = F.least(x - F.col("x.at"), y - F.col("y.at"))
    return (F.least(x, y) >= similarity * F.greatest(x, y) - 1e-6) & (most >= similarity / (1 + similarity) * (x + y) - 1e-6)


def simhash_candidates(prints: DataFrame) -> DataFrame:
    """(a, b): documents of ``prints`` (doc_id, fp) whose fingerprints are equal, or differ in two bits or
    fewer, each through the smallest document of its fingerprint."""
    classes = materialise(prints.groupBy("fp").agg(F.min("doc_id").alias("rep")).withColumn("nth", F.lit(0)), "near-classes")
    release(prints.sparkSession)
    equal = prints.join(classes, "fp").where("doc_id != rep").select(F.col("rep").alias("a"), F.col("doc_id").alias("b"))
    return equal.union(hamming_edges(classes).select(F.least("a", "b"), F.greatest("a", "b")))


def near_duplicates(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """(doc_id, component_id) for every distinct doc_id: documents joined by links of at least ``similarity``.

    Candidates of SimHash (see above) and of the prefix filter are verified on the exact sets of
    ``words``-word shingles.  SimHash finds close copies; the prefix filter finds every other pair that
    reaches ``similarity``, so none is left to chance.  First the documents with a common prefix shingle are
    verified against one of them, the most typical; then all that still are in different components are verified
    with each other, so a group of copies doesn't list its pairs.  Equal texts are one class and are always
    linked.  Texts without words are alike.
    """
    keyed = docs.select("doc_id", F.col("text").cast("binary").alias("text")).withColumn("sha", F.coalesce(F.sha2("text", 256), F.lit("")))
    ids = materialise(keyed.select("doc_id", "sha"), "near-ids")
    reps = materialise(ids.groupBy("sha").agg(F.min("doc_id").alias("doc_id")).where("doc_id is not null"), "near-texts")
    copies = materialise(ids.where("doc_id is not null").join(reps, ["sha", "doc_id"], "left_anti").select("doc_id").distinct().join(reps, "doc_id", "left_anti"), "near-copies")
    different = join_keys(keyed.where("doc_id is not null"), copies, "doc_id", "left_anti")
    met, prints = shared_prefixes(different, words, similarity)
    # of changed copies, their original has the fewest shingles of its own, which come first, before a shared one
    centre = F.min_by(F.struct("doc_id", "n", "at"), F.struct("at", "doc_id"))
    x, y = met.groupBy("g").agg(centre.alias("c")).select("g", "c.*").alias("x"), met.alias("y")
    a, b = F.col("x.doc_id"), F.col("y.doc_id")
    stars = x.join(y, (F.col("x.g") == F.col("y.g")) & (a != b) & _may_reach(similarity)).select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))
    stars = materialise(stars.union(simhash_candidates(prints)).distinct(), "near-stars")
    release(docs.sparkSession)
    linked = similar_pairs(stars, prints, docs, words, similarity)
    roots = connected_components(linked)
    named = materialise(met.join(roots, met.doc_id == roots.node, "left").select("g", "doc_id", "n", "at", F.coalesce("root", "doc_id").alias("root")), "near-roots")
    mixed = named.groupBy("g").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("g")
    open_ = materialise(named.join(mixed, "g"), "near-open")
    x, y = open_.alias("x"), open_.alias("y")
    apart = (a < b) & (F.col("x.root") != F.col("y.root"))
    rest = x.join(y, (F.col("x.g") == F.col("y.g")) & apart & _may_reach(similarity)).select(a.alias("a"), b.alias("b")).distinct()
    rest = materialise(rest.join(stars, ["a", "b"], "left_anti"), "near-rest")
    for done in (met, named, open_, stars):
        forget(done)
    release(docs.sparkSession)
    more = similar_pairs(rest, prints, docs, words, similarity)
    for done in (rest, prints):
        forget(done)
    roots = connected_components(linked.union(more))
    for done in (linked, more):
        forget(done)
    release(docs.sparkSession)
    named = reps.join(roots, reps.doc_id == roots.node, "left").select("sha", F.coalesce("root", "doc_id").alias("component_id"))
    return ids.join(named, "sha", "left").select("doc_id", "component_id").dropDuplicates(["doc_id"])
