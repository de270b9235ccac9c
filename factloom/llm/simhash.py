"""SimHash near-duplicates: fingerprints, and their linking through a Gray-order hierarchical index.

Fingerprints that differ in at most `DISTANCE` bits are linked; a document's component is what its
fingerprint reaches over links. The index has two tiers. Its upper nodes are masked bit patterns:
the 64 bits fall into five segments, and two fingerprints within three bits agree on at least two
of them, so each distinct fingerprint is dealt to the ten patterns of its segment pairs (a pattern
that many share is refined by a part of the remaining bits, of which four parts one must agree).
Under each pattern the fingerprints are sorted by Gray rank and a tree is built over the sorted
run: a node holds the bits its members share. Pairs of nodes are descended together; differences on
newly shared bits add up, and a pair of groups is dropped as soon as they exceed the distance or
all members are linked already. Only one edge per fingerprint leaves a pattern, never all pairs.

`near_copies` links by similarity instead: texts whose shingle sets have Jaccard similarity of at
least a bound. At 0.8 a fingerprint differs in about ten bits, which no masked pattern survives, so
the upper nodes are bands of minimum hashes there; the tree under them drops pairs at a wide
distance, and each pair that is left is decided by its exact sets.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest, xxh64_intdigest

from factloom.llm.batches import WordHashes, mixed, pieces, shingles, signed, texts
from factloom.operators.graph import components
from factloom.session import written

DISTANCE = 3
SHINGLE_WORDS = 3
SEED = 42
#: (first bit, bits) of the five segments.
SEGMENTS = [(0, 13), (13, 13), (26, 13), (39, 13), (52, 12)]
#: Patterns shared by more fingerprints than this are refined.
MOST_UNDER_PATTERN = 4096
#: Bands of minimum hashes, and hashes in each: at similarity 0.8 two sets share a band with probability 0.99994.
BANDS, BAND_HASHES = 32, 6
#: Sets of similarity 0.8 differ in 10 of 64 bits (12 for a few words), five deviations below this.
SIMILAR_DISTANCE = 28
_LEAF, _FAN = 16, 8
_BLOCK = 1 << 16


def fingerprint(words: list[bytes]) -> int:
    """Bit j is 1 if it is set in over half of the hashes of the word shingles, repeats included."""
    if not words:
        return 0
    k = SHINGLE_WORDS
    joined = map(b" ".join, zip(*(words[i:] for i in range(k)), strict=False)) if len(words) >= k else [b" ".join(words)]
    hashes = np.fromiter((xxh64_intdigest(s, SEED) for s in joined), np.uint64)
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), _BLOCK):
        block = hashes[at:at + _BLOCK].view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(block, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp): the fingerprint of each whole text as a signed long.

    A-Z are lower-cased, nothing else. A null or blank text has fingerprint zero; repeated rows and
    null ids give a row each; other columns are ignored.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            values = np.fromiter((fingerprint(t.lower().split()) for t in texts(batch)), np.uint64, batch.num_rows)
            yield pa.record_batch({"doc_id": batch.column("doc_id"), "fp": pa.array(signed(values))})
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        run, "doc_id long, fp long")


def gray_rank(x: np.ndarray) -> np.ndarray:
    """The position of each fingerprint in reflected Gray order: neighbours there differ in few bits."""
    x = x.copy()
    for s in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(s)
    return x


def _tree(x: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(first, end, pattern, mask) of the nodes of each level over the sorted `x`, root level last."""
    levels = []
    bounds = np.arange(0, len(x), _LEAF)
    every, some = np.bitwise_and.reduceat(x, bounds), np.bitwise_or.reduceat(x, bounds)
    while True:
        levels.append((bounds, np.r_[bounds[1:], len(x)], every, ~(every ^ some)))
        if len(bounds) == 1:
            return levels
        up = np.arange(0, len(bounds), _FAN)
        every, some, bounds = np.bitwise_and.reduceat(every, up), np.bitwise_or.reduceat(some, up), bounds[up]


def _merge(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Members `a[i]` and `b[i]` get one label, the smallest; labels are members and point at themselves."""
    while len(a):
        la, lb = label[a], label[b]
        apart = la != lb
        if not apart.any():
            return
        a, b, la, lb = a[apart], b[apart], la[apart], lb[apart]
        np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
        while True:
            up = label[label]
            if (up == label).all():
                break
            label[:] = up


def linked_runs(x: np.ndarray, distance: int = DISTANCE, check: Callable[[int, int], bool] | None = None) -> np.ndarray:
    """For fingerprints in Gray order, the index of each one's linked set: its smallest member index.

    With `check`, pairs of indices within the distance are linked only if it says so.
    """
    label = np.arange(len(x))
    levels = _tree(x)
    whole = np.uint64(0xFFFFFFFFFFFFFFFF)
    # pairs of nodes of one level: (a, b, bits compared so far, differences so far)
    stack = [(len(levels) - 1, np.zeros(1, np.int64), np.zeros(1, np.int64), np.zeros(1, np.uint64), np.zeros(1, np.int64))]
    while stack:
        level, a, b, seen, apart = stack.pop()
        if len(a) > _BLOCK // 16:
            half = len(a) // 2
            stack += [(level, a[half:], b[half:], seen[half:], apart[half:]), (level, a[:half], b[:half], seen[:half], apart[:half])]
            continue
        first, end, pattern, mask = levels[level]
        fresh = mask[a] & mask[b] & (seen ^ whole)
        apart = apart + np.bitwise_count((pattern[a] ^ pattern[b]) & fresh)
        seen = seen | fresh
        low, high = np.minimum.reduceat(label, first), np.maximum.reduceat(label, first)
        keep = (apart <= distance) & ~((low[a] == high[a]) & (low[b] == high[b]) & (low[a] == low[b]))
        a, b, seen, apart = a[keep], b[keep], seen[keep], apart[keep]
        if not len(a):
            continue
        if level:
            below = len(levels[level - 1][0])
            ca, cb = (np.broadcast_to(g, (len(a), _FAN, _FAN)).reshape(-1) for g in (
                (a[:, None] * _FAN + np.arange(_FAN))[:, :, None], (b[:, None] * _FAN + np.arange(_FAN))[:, None, :]))
            ok = (ca < below) & (cb < below) & (ca <= cb)
            stack.append((level - 1, ca[ok], cb[ok], np.repeat(seen, _FAN * _FAN)[ok], np.repeat(apart, _FAN * _FAN)[ok]))
            continue
        i, j = (np.broadcast_to(g, (len(a), _LEAF, _LEAF)).reshape(-1) for g in (
            (first[a][:, None] + np.arange(_LEAF))[:, :, None], (first[b][:, None] + np.arange(_LEAF))[:, None, :]))
        ok = (i < j) & (i < np.repeat(end[a], _LEAF * _LEAF)) & (j < np.repeat(end[b], _LEAF * _LEAF))
        i, j = i[ok], j[ok]
        near = np.bitwise_count(x[i] ^ x[j]) <= distance
        if check is None:
            _merge(label, i[near], j[near])
            continue
        for a, b in zip(i[near].tolist(), j[near].tolist(), strict=True):
            if label[a] != label[b] and check(a, b):
                _merge(label, np.array([a]), np.array([b]))
    return label


def _segment(fp: Column, at: int, bits: int) -> Column:
    return F.shiftrightunsigned(fp, at).bitwiseAND((1 << bits) - 1)


def _patterns(fp: Column) -> Column:
    """The ten (segment pair, pattern) keys of a fingerprint."""
    keys = []
    for n, (a, b) in enumerate(combinations(SEGMENTS, 2)):
        keys.append(F.lit(n << 26) + F.shiftleft(_segment(fp, *a), 13) + _segment(fp, *b))
    return F.array(*keys)


def _refined(fp: Column, key: Column) -> Column:
    """The four finer keys of a pattern: each adds one of four parts of the 38 other bits."""
    cases = None
    for n, pair in enumerate(combinations(SEGMENTS, 2)):
        bits = [b for at, size in SEGMENTS if (at, size) not in pair for b in range(at, at + size)]
        parts = [bits[round(i * len(bits) / 4):round((i + 1) * len(bits) / 4)] for i in range(4)]
        finer = F.array(*(F.struct(F.lit(i + 1).alias("part"), sum(
            (F.shiftleft(F.shiftrightunsigned(fp, b).bitwiseAND(1), p) for p, b in enumerate(part)), F.lit(0).cast("long")).alias("bits"))
            for i, part in enumerate(parts)))
        test = F.shiftright(key, 26) == n
        cases = F.when(test, finer) if cases is None else cases.when(test, finer)
    return cases


def _rank(fp: Column) -> Column:
    """`gray_rank` as an expression, so that the sort is Spark's."""
    for s in (1, 2, 4, 8, 16, 32):
        fp = fp.bitwiseXOR(F.shiftrightunsigned(fp, s))
    return fp


def linked_pairs(distinct: DataFrame) -> DataFrame:
    """(src, dst): edges between distinct fingerprints (fp) that connect exactly what links connect."""
    fp = F.col("fp")
    keyed = distinct.select("fp", F.explode(_patterns(fp)).alias("key"))
    # a pattern held by one fingerprint can link nothing
    shared = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    under = keyed.join(shared, "key")
    plain = under.where(F.col("n") <= MOST_UNDER_PATTERN).select("fp", "key", F.lit(0).alias("part"), F.lit(0).cast("long").alias("bits"))
    hot = under.where(F.col("n") > MOST_UNDER_PATTERN).select("fp", "key", F.explode(_refined(fp, F.col("key"))).alias("f")).select(
        "fp", "key", "f.part", "f.bits")
    nodes = plain.unionByName(hot).select("key", "part", "bits", "fp")
    runs = nodes.repartition("key", "part", "bits").withColumn("rank", _rank(fp)).sortWithinPartitions("key", "part", "bits", "rank").drop("rank")

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        name = None

        def edges(runs: list[np.ndarray]) -> pa.RecordBatch:
            src, dst = [], []
            for x in runs:
                if len(x) == 2:
                    label = np.array([0, 0 if int(x[0] ^ x[1]).bit_count() <= DISTANCE else 1])
                else:
                    label = linked_runs(x)
                moved = np.flatnonzero(label != np.arange(len(x)))
                src.append(x[moved])
                dst.append(x[label[moved]])
            none = [np.empty(0, np.uint64)]
            return pa.record_batch({"src": pa.array(signed(np.concatenate(src or none))), "dst": pa.array(signed(np.concatenate(dst or none)))})

        for batch in batches:
            columns = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "part", "bits")]
            x = batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
            starts = np.flatnonzero(np.r_[True, np.any([c[1:] != c[:-1] for c in columns], axis=0)]) if len(x) else []
            done = []
            for a, b in zip(starts, [*starts[1:], len(x)], strict=True):
                this = tuple(int(c[a]) for c in columns)
                if this != name and held:
                    done.append(np.concatenate(held))
                    held = []
                name = this
                held.append(x[a:b])
            yield edges([x for x in done if len(x) > 1])
        if held:
            yield edges([x for x in [np.concatenate(held)] if len(x) > 1])
    return runs.mapInArrow(link, "src long, dst long").distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, fp, component_id) for every row of `docs` (doc_id, text).

    `component_id` is the smallest doc_id whose fingerprint is reachable over links, the row's own
    included. Rows without a doc_id link like others; a component without any id has a null one.
    An empty table gives no rows.
    """
    prints = written(fingerprints(docs))
    classes = written(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    found = components(linked_pairs(classes.select("fp"))).select(F.col("e").alias("fp"), "root")
    rooted = classes.join(found, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(least, "root").select("fp", "component_id")
    return prints.join(named, "fp").select("doc_id", "fp", "component_id")


def shingle_set(hashes: WordHashes, words: list[bytes], k: int) -> np.ndarray:
    """The sorted hashes of the distinct `k`-word shingles; a shorter text is one shingle, a blank one has none."""
    if 0 < len(words) < k:
        return np.array([xxh64_intdigest(b" ".join(words), SEED)], np.uint64)
    return np.unique(shingles(hashes.of(words), k))


def band_keys(items: np.ndarray) -> np.ndarray:
    """A key for each band: sets that share one agree on all minimum hashes of the band."""
    random = np.random.default_rng(SEED)
    factors = random.integers(0, 1 << 63, BANDS * BAND_HASHES, np.uint64) * np.uint64(2) + np.uint64(1)
    weights = random.integers(0, 1 << 63, BAND_HASHES, np.uint64) * np.uint64(2) + np.uint64(1)
    least = np.full(len(factors), 0xFFFFFFFFFFFFFFFF, np.uint64)
    for at in range(0, len(items), 512):
        np.minimum(least, (items[at:at + 512, None] * factors).min(axis=0), out=least)
    return mixed((least.reshape(BANDS, BAND_HASHES) * weights).sum(axis=1, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64))


def similar(a: np.ndarray, b: np.ndarray, least: float) -> bool:
    """Whether two sets, sorted, have a Jaccard similarity of at least `least`."""
    if min(len(a), len(b)) < least * max(len(a), len(b)):
        return False
    both = np.sort(np.concatenate([a, b]), kind="stable")
    shared = int(np.count_nonzero(both[1:] == both[:-1]))
    return shared >= least * (len(both) - shared)


def _described(docs: DataFrame, k: int) -> DataFrame:
    """(doc_id, name, same, fp, keys): digests of text and shingle set, the set's fingerprint and bands."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in pieces(batches):
            same, prints, keys = [], [], []
            for text in texts(batch):
                items = shingle_set(hashes, text.lower().split(), k)
                counts = np.unpackbits(items.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
                same.append(xxh3_64_intdigest(items.tobytes()))
                prints.append(np.packbits(2 * counts > len(items), bitorder="little").view(np.uint64)[0])
                keys.append(signed(band_keys(items)) if len(items) else np.empty(0, np.int64))
            offsets = np.r_[0, np.cumsum([len(x) for x in keys])].astype(np.int32)
            yield pa.record_batch({"doc_id": batch.column("doc_id"), "name": batch.column("name"), "same": pa.array(signed(np.array(same, np.uint64))),
                                   "fp": pa.array(signed(np.array(prints, np.uint64))), "keys": pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(keys)))})
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), _name(text).alias("name"), text.alias("text")).mapInArrow(
        run, "doc_id long, name string, same long, fp long, keys array<long>")


def _name(text: Column) -> Column:
    return F.md5(F.coalesce(text, F.lit("")).cast("binary"))


def _sets(named: DataFrame, k: int) -> DataFrame:
    """(name, items): the shingle sets of the texts of `named` (name, text)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in pieces(batches):
            items = [signed(shingle_set(hashes, t.lower().split(), k)) for t in texts(batch)]
            offsets = np.r_[0, np.cumsum([len(x) for x in items])].astype(np.int32)
            yield pa.record_batch({"name": batch.column("name"), "items": pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(items)))})
    return named.select("name", "text").mapInArrow(run, "name string, items array<long>")


def similar_pairs(groups: DataFrame, least: float) -> DataFrame:
    """(src, dst): edges that connect what pairs of similarity `least` connect inside each group.

    `groups` is (n, sig, same, fp, items), a group being all rows with one (n, sig).
    """
    runs = groups.repartition("n", "sig").withColumn("rank", _rank(F.col("fp"))).sortWithinPartitions("n", "sig", "rank").select("n", "sig", "same", "fp", "items")

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, held = None, []

        def edges(members: list[tuple[int, int, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
            same, prints = np.array([m[0] for m in members], np.int64), np.array([m[1] for m in members], np.int64).view(np.uint64)
            label = linked_runs(prints, SIMILAR_DISTANCE, lambda a, b: similar(members[a][2], members[b][2], least))
            moved = np.flatnonzero(label != np.arange(len(label)))
            return same[moved], same[label[moved]]

        def batch_of(found: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
            none = [np.empty(0, np.int64)]
            return pa.record_batch({"src": pa.array(np.concatenate([s for s, _ in found] or none)), "dst": pa.array(np.concatenate([d for _, d in found] or none))})

        for batch in batches:
            n, sig, same, prints = (batch.column(c).to_pylist() for c in ("n", "sig", "same", "fp"))
            items, found = batch.column("items"), []
            for i in range(batch.num_rows):
                if (n[i], sig[i]) != name and held:
                    found.append(edges(held))
                    held = []
                name = n[i], sig[i]
                # copied, so that no batch is held for one of its rows
                held.append((same[i], prints[i], items[i].values.to_numpy(zero_copy_only=False).view(np.uint64).copy()))
            yield batch_of(found)
        if held:
            yield batch_of([edges(held)])
    return runs.mapInArrow(link, "src long, dst long").distinct()


def near_copies(docs: DataFrame, words: int, least: float) -> DataFrame:
    """(doc_id, fp, component_id) for every row of `docs` (doc_id, text): `near_duplicates` by similarity.

    Texts are linked whose sets of `words`-word shingles (A-Z lower-cased) have a Jaccard similarity
    of at least `least`; `fp` is the fingerprint of the set. Blank texts are copies of each other.
    """
    rows = written(_described(docs, words))
    classes = written(rows.groupBy("same").agg(F.min("doc_id").alias("least"), F.min(F.struct("name", "fp", "keys")).alias("m")).select("same", "least", "m.*"))
    keyed = classes.select("same", F.explode("keys").alias("key"))
    shared = keyed.groupBy("key").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("same")).alias("sig")).where("n > 1")
    # bands with the same members are one group
    members = written(keyed.join(shared, "key").select("n", "sig", "same").distinct())
    wanted = classes.join(members.select("same").distinct(), "same", "left_semi").select("same", "name", "fp")
    # one row of each text is chosen before texts move, so that the copies of one don't meet in a task
    chosen = rows.groupBy("name").agg(F.min("doc_id").alias("_id")).join(wanted.select("name"), "name", "left_semi").select(
        "name", F.coalesce("_id", F.lit(0)).alias("_id"), F.col("_id").isNull().alias("_none"))
    text, own = F.col("text").cast("string"), F.col("doc_id").cast("long")
    texts_of = docs.select(_name(text).alias("name"), F.coalesce(own, F.lit(0)).alias("_id"), own.isNull().alias("_none"), text.alias("text"))
    named = texts_of.join(chosen, ["name", "_id", "_none"], "left_semi").select("name", "text").dropDuplicates(["name"])
    sets = written(_sets(named, words).join(wanted, "name").select("same", "fp", "items"))
    found = components(similar_pairs(members.join(sets, "same"), least)).select(F.col("e").alias("same"), "root")
    rooted = classes.join(found, "same", "left").select("same", "least", F.coalesce("root", "same").alias("root"))
    first = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return rows.select("doc_id", "fp", "same").join(rooted.join(first, "root").select("same", "component_id"), "same").select("doc_id", "fp", "component_id")


def representatives(docs: DataFrame, near: Callable[[DataFrame], DataFrame] = near_duplicates) -> DataFrame:
    """`docs` with one row of each component that `near` finds: the row of its smallest doc_id.

    Where rows repeat that doc_id, the one with the smallest text stays. Rows without a doc_id are
    all kept, since the rule cannot name them.
    """
    found = near(docs)
    kept = found.where(F.col("doc_id") == F.col("component_id")).select(F.col("doc_id").alias("_id")).distinct()
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("_id"))
    one = rows.join(kept, "_id", "left_semi").groupBy("_id").agg(F.min_by("row", F.struct(F.col("row.text"))).alias("row"))
    return one.select("row.*").unionByName(docs.where("doc_id is null"))
