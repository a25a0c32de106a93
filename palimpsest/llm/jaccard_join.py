"""N-gram Jaccard join by PartEnum signatures.

A document's set holds its distinct five-word shingles.  Sets that are equal form
one class, which takes part once.  For two classes of sizes a <= b with Jaccard
similarity of at least 3/4 the symmetric difference has at most (a + b) / 7
features and b is at most 4a / 3.  Sizes fall into bands.  A band's instance cuts
the feature domain into n parts on a first level and each part into SUBPARTS on a
second.  All subsets of a part that leave one subpart out are enumerated; what a
class holds in such a subset, hashed together, is a signature.  A class signs in the
instance of its own band and, if a partner can be in the band below, in that one too.

Two classes fail to share a signature of a part only if the part has two differing
features at least, or one if all that a class holds of it is in one subpart (then the
subset that leaves this one out is empty and not signed), or none if the class holds
nothing of it.  So a class whose parts bear, by this count, more differences than a
partner may have shares a signature with every partner.  Parts have an order, and those
before the first that gives two partners a common signature bear no more than they differ
in, so no class signs parts after those that bear more.  The few classes that bear too little
sign once more with all their features, and if these are still too few, their empty
subsets as well; two such classes then share a signature in one of all n parts, as
2n is more than they may differ in.

Shingles that very many documents hold would give groups of unrelated classes, so
they are left out of the parts first; that never adds to a difference, and the count
above is made of what is left.  A shingle counts as such if at least COMMON_LEAST
documents and one in COMMON_SHARE hold it, so there are never more than COMMON_SHARE
times the shingles of a mean document, however large the corpus.  Which shingles are
left out changes speed, not results.

Signatures meet by a shuffle.  In each group of classes with one signature the
smallest is paired with the others, the pairs are compared, and links found are
contracted to components.  Two others of a group may link as well; both are partners
of its smallest, so the partners of each class are compared with each other,
component against component, in blocks of bounded size: first the nearest few of
every two components, and once those links are contracted, all.  Before texts are fetched, parities
of feature counts by last bits give a lower bound on the symmetric difference and
drop pairs that cannot link; what remains is counted exactly, on whole texts.  So
every pair with a common signature is compared or already connected.

Defined results: texts without words have no set and link with nothing; fewer
than five words give one shingle; components are made of texts, so rows that repeat an id
get that of their own text, the smallest id of any row of it; rows without an id never link
and have no component; an empty table gives an empty result; texts of any length are read
whole; other columns are not read.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, shuffle_width, table, written

WORDS = 5
SIZES = "least(na, nb) * 100 >= greatest(na, nb) * 75"
TOP, BOTTOM = 75, 100  # two sets link when BOTTOM * intersection >= TOP * union
UPPER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
M1, M2, M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
EMPTY = np.uint64(0x5851F42D4C957F2D)
CHUNK_FEATURES = 1 << 19
BYTES_AT_ONCE, WORDS_AT_ONCE = 1 << 20, 1 << 16
BLOCK = 1024
NEAREST = 4
SUBPARTS = 3
SIGNATURE = np.uint64((1 << 48) - 1)  # what is kept of a signature; equal ones of different content cost a comparison
COMMON_LEAST, COMMON_SHARE = 1_000, 2_500
CENTRE = 1_000  # pairs that share one copy of their first document's text
SALTS = 16


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * M2
    x = (x ^ (x >> np.uint64(27))) * M3
    return x ^ (x >> np.uint64(31))


# A word's hash is the sum of a random number for each byte and its place in the word, cases alike.
PLACES = 64
BYTES = mix(np.arange(PLACES * 256, dtype=np.uint64) * M1 + M2).reshape(PLACES, 256)
BYTES[:, 0x41:0x5B] = BYTES[:, 0x61:0x7B]
BYTES = BYTES.ravel()
BLANK = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of words of ``data``."""
    out = np.empty(len(starts), np.uint64)
    for a in range(0, len(starts), WORDS_AT_ONCE):  # bounds memory
        first, size = starts[a : a + WORDS_AT_ONCE], ends[a : a + WORDS_AT_ONCE] - starts[a : a + WORDS_AT_ONCE]
        n = np.minimum(size, PLACES)
        at = np.cumsum(n) - n
        place = np.arange(int(n.sum())) - np.repeat(at, n)
        out[a : a + WORDS_AT_ONCE] = np.add.reduceat(BYTES[(place << 8) + data[place + np.repeat(first, n)]], at)
        for k in np.flatnonzero(size > PLACES):
            word = data[first[k] : first[k] + size[k]].tobytes().translate(UPPER)
            out[a + k] = xxhash.xxh3_64_intdigest(word)
    return out


def shingle_sets(texts: pa.Array) -> Iterator[np.ndarray]:
    """Sorted distinct hashes of the five-word shingles of each text."""
    texts = pc.fill_null(pc.cast(pc.cast(texts, pa.binary()), pa.large_binary()), b"")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    at = 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + BYTES_AT_ONCE, "right")) - 1)
        bounds = offsets[at : end + 1] - offsets[at]
        at, low = end, offsets[at]
        if not bounds[-1]:
            yield from (np.empty(0, np.uint64) for _ in bounds[1:])
            continue
        data = np.frombuffer(texts.buffers()[2], np.uint8, bounds[-1], low)
        held = ~BLANK[data]
        before, after = np.zeros(len(data), bool), np.zeros(len(data), bool)  # is a byte of the same text, and no blank, next to it?
        before[1:], after[:-1] = held[:-1], held[1:]
        before[bounds[:-1][bounds[:-1] < len(data)]] = False
        after[bounds[1:][bounds[1:] > 0] - 1] = False
        starts, ends = np.flatnonzero(held & ~before), np.flatnonzero(held & ~after) + 1
        words, of = word_hashes(data, starts, ends), np.searchsorted(starts, bounds)
        wide = _shingles(words, WORDS)
        for a, b in zip(of[:-1].tolist(), of[1:].tolist()):
            h = np.sort(wide[a : b - WORDS + 1] if b - a >= WORDS else _shingles(words[a:b], b - a))
            fresh = np.ones(len(h), bool)
            np.not_equal(h[1:], h[:-1], out=fresh[1:])
            yield h[fresh]


def _shingles(words: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all runs of ``width`` words."""
    n = len(words) - width + 1
    if n <= 0 or not width:
        return np.empty(0, np.uint64)
    h = np.full(n, np.uint64(width))
    for k in range(width):
        h = h * M1 + words[k : n + k]
    return mix(h)


def shingle_set(text: bytes | None) -> np.ndarray:
    """The shingles of one text."""
    return next(shingle_sets(pa.array([text], pa.binary())))


def set_class(features: np.ndarray) -> int:
    """Identity of a set."""
    return xxhash.xxh3_64_intdigest(features.tobytes()) - (1 << 63)


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    if min(len(a), len(b)) * BOTTOM < TOP * max(len(a), len(b)) or not len(a):
        return False
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return BOTTOM * shared >= TOP * (len(a) + len(b) - shared)


def sketch(features: np.ndarray) -> bytes:
    """Parities of the numbers of features by their last bits; two to four bits for a feature, 64 at least."""
    q = 1 << max(6, (2 * len(features) - 1).bit_length())
    odd = np.bincount((features & np.uint64(q - 1)).astype(np.int64), minlength=q) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def may_link(a: int, sa: bytes, b: int, sb: bytes) -> bool:
    """False only if the sets, of sizes a and b, differ in more than (a + b) / 7 features."""
    x, y, p, q = int.from_bytes(sa, "little"), int.from_bytes(sb, "little"), 8 * len(sa), 8 * len(sb)
    while p > q:
        p //= 2
        x = (x >> p) ^ (x & ((1 << p) - 1))
    while q > p:
        q //= 2
        y = (y >> q) ^ (y & ((1 << q) - 1))
    return 7 * (x ^ y).bit_count() <= a + b


def possible_pairs(size: np.ndarray, sketches: list[bytes], part: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places (i in left, j in right) of pairs of different parts that may link, each unordered pair at most once, and how far apart they are at least.

    Sketches of one length are rows of a matrix in the order of sizes; partners of a set are a
    stretch of it, or of the next longer ones, folded, or of the next shorter ones.
    """
    def native(k: int) -> np.ndarray:
        return np.frombuffer(sketches[k], np.uint64)

    def folded(m: np.ndarray) -> np.ndarray:
        half = m.shape[-1] // 2
        return m[..., :half] ^ m[..., half:]

    inside = len(left) == len(right) and (left == right).all()
    right = right[np.argsort(size[right], kind="stable")]
    level = np.array([len(sketches[k]) for k in right], np.int64)
    rows = {}
    for q in np.unique(level):
        at = right[level == q]
        m = np.stack([native(k) for k in at])
        rows[int(q)] = (at, size[at], part[at], m, folded(m) if q > 8 else None)
    none = np.empty(0, np.int64)
    out_i, out_j, out_d = [none], [none], [none.astype(float)]
    for i in left:
        n, mine = int(size[i]), native(i)
        # In one block only partners at least as large, ties by place; smaller ones find i from their side.
        least, most = n if inside else -(-n * TOP // BOTTOM), n * BOTTOM // TOP
        for q in (len(sketches[i]) // 2, len(sketches[i]), len(sketches[i]) * 2):
            if q not in rows:
                continue
            at, sizes, parts, m, half = rows[q]
            a, b = np.searchsorted(sizes, least), np.searchsorted(sizes, most, "right")
            if a >= b:
                continue
            x = (m[a:b] if q <= len(sketches[i]) else half[a:b]) ^ (mine if q >= len(sketches[i]) else folded(mine))
            apart = np.bitwise_count(x).sum(1, dtype=np.int64)
            near = (7 * apart <= n + sizes[a:b]) & (parts[a:b] != part[i])
            if inside:
                near &= (sizes[a:b] != n) | (at[a:b] > i)
            k = np.flatnonzero(near)
            if len(k):
                out_i.append(np.full(len(k), i))
                out_j.append(at[a:b][k])
                out_d.append(apart[k] / (n + sizes[a:b][k]))
    return np.concatenate(out_i), np.concatenate(out_j), np.concatenate(out_d)


def nearest_of_parts(part: np.ndarray, i: np.ndarray, j: np.ndarray, far: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the pairs (i, j), the nearest of every two parts."""
    if not len(i):
        return i, j
    x, y = np.minimum(part[i], part[j]), np.maximum(part[i], part[j])
    o = np.lexsort((far, y, x))
    x, y = x[o], y[o]
    start = np.flatnonzero(np.concatenate([[True], (x[1:] != x[:-1]) | (y[1:] != y[:-1])]))
    rank = np.arange(len(o)) - np.repeat(start, np.diff(np.append(start, len(o))))
    o = o[rank < most]
    return i[o], j[o]


# --- signatures ----------------------------------------------------------------------------------------------


def band(size: int) -> int:
    """Bands are [2^j, 2^(j+1))."""
    return int(size).bit_length() - 1


def parts_of(j: int) -> int:
    """First-level parts in the instance of band j: half the most that its sets may differ in, with room for chance."""
    largest = (2 << j) - 1
    return int(np.ceil(0.167 * largest + 0.3 * np.sqrt(largest)))


def roles(size: int) -> list[tuple[int, int]]:
    """(band, most differing features to any partner there) of a set."""
    j = band(size)
    out = [(j, size // 3)]
    below = (1 << j) - 1  # largest size of the band below
    if j and 4 * below >= 3 * size:
        out.append((j - 1, (size + below) // 7))
    return out


def signatures(sets: list[np.ndarray], common: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(signature, number of the set) for every role of every set; ``common`` is sorted."""
    jobs = [(k, j, most) for k, s in enumerate(sets) if len(s) for j, most in roles(len(s))]
    rare = sets
    if len(common):
        rare = []
        for s in sets:
            at = np.minimum(np.searchsorted(common, s), len(common) - 1)
            rare.append(s[common[at] != s])
    sig, who, short = _signed([(rare[k], k, j, most) for k, j, most in jobs], M2, False)
    sig2, who2, _ = _signed([(sets[jobs[i][0]], *jobs[i]) for i in short], M3, True)
    return np.concatenate([sig, sig2]), np.concatenate([who, who2])


def _signed(jobs: list[tuple[np.ndarray, int, int, int]], salt: np.uint64, with_empty: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Signatures of jobs (features, set, band, most differing), and the jobs whose parts bear too few differences."""
    if not jobs:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    most = np.array([m for *_, m in jobs])
    number, bands = np.array([k for _, k, _, _ in jobs]), np.array([j for _, _, j, _ in jobs], np.uint64)
    sizes = np.array([len(f) for f, *_ in jobs])
    n_parts = np.array([parts_of(j) for j in range(int(bands.max()) + 1)], np.uint64)[bands.astype(np.int64)]
    features = np.concatenate([f for f, *_ in jobs])
    job = np.repeat(np.arange(len(jobs), dtype=np.int64), sizes)
    part = ((features >> np.uint64(32)) * n_parts[job]) >> np.uint64(32)  # does not fall within a sorted set
    key = (job.astype(np.uint64) << np.uint64(32)) | part
    fresh = np.empty(len(key), bool)
    fresh[:1] = True
    np.not_equal(key[1:], key[:-1], out=fresh[1:])
    first, group = np.flatnonzero(fresh), np.cumsum(fresh) - 1
    owner, place = job[first], part[first]
    # Contents of the subparts: sums of mixed features, and how many there are.
    sub = (((features & np.uint64(0xFFFFFFFF)) * np.uint64(SUBPARTS)) >> np.uint64(32)).astype(np.int64)
    cell = group * SUBPARTS + sub
    held = np.bincount(cell, minlength=len(first) * SUBPARTS).reshape(-1, SUBPARTS)
    content = np.zeros((len(first), SUBPARTS), np.uint64)
    mixed = mix(features + M1)
    for q in range(SUBPARTS):
        here = np.flatnonzero(sub == q)
        if len(here):
            g = group[here]
            start = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
            content[g[start], q] = np.add.reduceat(mixed[here], start)
    total, n = content.sum(1, dtype=np.uint64), held.sum(1)
    borne = np.where((n[:, None] > held).all(1), 2, 1)
    short = np.flatnonzero(np.bincount(owner, borne, len(jobs)) <= most)
    # Parts after those that bear more differences than a partner may have are not signed.
    upto = np.cumsum(borne) - borne
    begins = np.searchsorted(owner, np.arange(len(jobs)))
    needed = upto - np.append(upto, 0)[begins][owner] <= most[owner]
    where = (bands[owner] << np.uint64(40)) + place * np.uint64(SUBPARTS) + salt
    out, who = [], []
    for q in range(SUBPARTS):
        full = (n > held[:, q]) & (with_empty | needed)
        out.append(mix((total[full] - content[full, q]) ^ mix(where[full] + np.uint64(q))))
        who.append(number[owner[full]])
    for i in short if with_empty else ():
        mine = owner == i
        empty = np.ones((int(n_parts[i]), SUBPARTS), bool)
        empty[place[mine].astype(np.int64)] = n[mine, None] == held[mine]
        at = np.flatnonzero(empty.ravel()).astype(np.uint64)
        out.append(mix(EMPTY ^ mix((bands[i] << np.uint64(40)) + at + salt)))
        who.append(np.full(len(at), number[i]))
    return np.concatenate(out), np.concatenate(who), short


def _texts(column: pa.Array) -> list[bytes | None]:
    return pc.cast(column, pa.binary()).to_pylist()


def document_classes(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """Rows (doc_id, class, n_shingles, sketch, often); class is null for empty sets.

    often, on the first row of a batch only, has the shingles that come again and again in the batch, with counts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = list(shingle_sets(batch.column(1)))
            often: list = [None] * len(sets)
            if sets:
                often[0] = frequent_features(sets)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([set_class(s) if len(s) else None for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int64()),
                                               pa.array([sketch(s) for s in sets], pa.binary()), pa.array(often, pa.list_(pa.struct([("f", pa.int64()), ("n", pa.int64())])))], names=["doc_id", "class", "n_shingles", "sketch", "often"])

    return docs.select(F.col(doc_id).cast("long"), text).mapInArrow(run, "doc_id long, class long, n_shingles long, sketch binary, often array<struct<f:long,n:long>>")


def frequent_features(sets: list[np.ndarray]) -> list[dict]:
    """Features of at least four sets and one in COMMON_SHARE, from parts of the domain one after the other."""
    out, least = [], max(4, len(sets) // COMMON_SHARE)
    for k in range(8):  # an eighth of the domain at a time bounds memory
        lo, hi = np.uint64(k << 61), np.uint64((k << 61) + (1 << 61) - 1)
        some = np.sort(np.concatenate([s[np.searchsorted(s, lo) : np.searchsorted(s, hi, "right")] for s in sets]))
        if len(some) >= least:
            again = np.unique(some[least - 1 :][some[least - 1 :] == some[: len(some) - least + 1]])
            n = np.searchsorted(some, again, "right") - np.searchsorted(some, again)
            out += [{"f": f, "n": c} for f, c in zip(again.view(np.int64).tolist(), n.tolist())]
    return out


def common_features(owned: DataFrame) -> np.ndarray:
    """The features that very many documents hold, sorted; COMMON_SHARE times the mean size of a set at most."""
    least = max(COMMON_LEAST, owned.count() / COMMON_SHARE)
    rows = (owned.where("often IS NOT NULL").select(F.explode("often").alias("o")).groupBy("o.f").agg(F.sum("o.n").alias("n"))
            .where(F.col("n") >= least).select("f").toPandas())
    return np.sort(rows["f"].to_numpy(np.int64).view(np.uint64))


def class_signatures(docs: DataFrame, doc_id: str, text: str, common: np.ndarray) -> DataFrame:
    """Rows (sig, class); a class that several texts of a batch have signs once."""
    shared = docs.sparkSession.sparkContext.broadcast(common)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def packed(sets, ids):
            sig, who = signatures(sets, shared.value)
            return pa.RecordBatch.from_arrays([pa.array((sig & SIGNATURE).view(np.int64)), pa.array(np.array(ids, np.int64)[who])], names=["sig", "class"])

        seen: set[int] = set()
        for batch in batches:
            if len(seen) > 2_000_000:
                seen.clear()
            sets, ids, total = [], [], 0
            for s in shingle_sets(batch.column(0)):
                if len(s) and (c := set_class(s)) not in seen:
                    seen.add(c)
                    sets.append(s)
                    ids.append(c)
                    total += len(s)
                    if total >= CHUNK_FEATURES:
                        yield packed(sets, ids)
                        sets, ids, total = [], [], 0
            if sets:
                yield packed(sets, ids)

    return docs.where(F.col(doc_id).isNotNull()).select(text).mapInArrow(run, "sig long, class long")


def candidate_pairs(sigs: DataFrame) -> DataFrame:
    """Rows (a, b): of every group with one signature, its smallest class a with each other class b."""

    def closed(sig, cls):
        """Pairs of complete groups; rows are sorted by signature, then class."""
        fresh = np.ones(len(sig), bool)
        fresh[1:] = (sig[1:] != sig[:-1]) | (cls[1:] != cls[:-1])
        sig, cls = sig[fresh], cls[fresh]
        starts = np.concatenate([[True], sig[1:] != sig[:-1]])
        first = cls[np.flatnonzero(starts)][np.cumsum(starts) - 1]
        return pairs_once(first[~starts], cls[~starts])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sig, cls = np.empty(0, np.int64), np.empty(0, np.int64)
        a, b = np.empty(0, np.int64), np.empty(0, np.int64)
        for batch in batches:
            sig = np.concatenate([sig, batch.column(0).to_numpy()])
            cls = np.concatenate([cls, batch.column(1).to_numpy()])
            cut = np.searchsorted(sig, sig[-1]) if len(sig) >= 100_000 else 0  # the last group may go on
            if cut:
                x, y = closed(sig[:cut], cls[:cut])
                sig, cls = sig[cut:], cls[cut:]
                a, b = np.concatenate([a, x]), np.concatenate([b, y])
                if len(a) >= 500_000:
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in pairs_once(a, b)], names=["a", "b"])
                    a, b = a[:0], b[:0]
        if len(sig):
            x, y = closed(sig, cls)
            a, b = np.concatenate([a, x]), np.concatenate([b, y])
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in pairs_once(a, b)], names=["a", "b"])

    dealt = sigs.repartition(shuffle_width(sigs.sparkSession), "sig").sortWithinPartitions("sig", "class")
    return dealt.mapInArrow(run, "a long, b long").distinct()


def pairs_once(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(a):
        return a, b
    o = np.lexsort((b, a))
    a, b = a[o], b[o]
    fresh = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
    return a[fresh], b[fresh]


def possible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of pairs with sizes and sketches, those that may link."""
    for batch in batches:
        na, ka, nb, kb = (batch.column(c).to_pylist() for c in ("na", "ka", "nb", "kb"))
        keep = [i for i in range(len(na)) if may_link(na[i], ka[i], nb[i], kb[i])]
        yield batch.select(["a", "b", "ra", "rb"]).take(pa.array(keep, pa.int64()))


def verified(pairs: DataFrame, docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """Of pairs (a, b, ra, rb), classes with the id of a document of each, those that link; only their texts are fetched."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[int, np.ndarray] = {}
        for batch in batches:
            keep = []
            a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            ta = _texts(batch.column(4))
            for i, sb in enumerate(shingle_sets(batch.column(5))):
                if not len(sb) or set_class(sb) != b[i]:  # another row with this id
                    continue
                sa = memo.get(a[i])
                if sa is None:
                    sa = shingle_set(ta[i])
                    if not len(sa) or set_class(sa) != a[i]:
                        continue
                    if len(memo) > 300:
                        memo.clear()
                    memo[a[i]] = sa
                if similar(sa, sb):
                    keep.append(i)
            yield batch.select(["a", "b"]).take(pa.array(keep, pa.int64()))

    ids = written(pairs.select(F.explode(F.array("ra", "rb")).alias("_need")).distinct(), "compared-ids")
    texts = docs.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).cast("long").alias("_id"), F.col(text).alias("_text"))
    texts = written(texts.join(ids, F.col("_id") == F.col("_need"), "left_semi"), "compared-texts")
    # A document with very many pairs gets a copy of its text for every CENTRE of them.
    blocks = pairs.groupBy(F.col("ra").alias("_ra")).agg(F.ceil(F.count(F.lit(1)) / CENTRE).cast("int").alias("_n")).where("_n > 1")
    blocks = written(blocks, "centres")
    salted = blocks.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = pairs.withColumn("_s", F.pmod("rb", F.lit(SALTS)).cast("int"))
    dealt = dealt.join(salted, (F.col("ra") == F.col("_ra")) & (F.col("_s") == F.col("_salt")), "left")
    dealt = dealt.select("a", "b", "ra", "rb", F.pmod(F.xxhash64("rb"), F.coalesce("_n", F.lit(1))).cast("int").alias("_blk"))
    dealt = written(dealt, "dealt-pairs")  # as a file of known size it may be broadcast, and texts stay where they are
    left = texts.join(blocks, F.col("_id") == F.col("_ra"), "left").select("_id", F.col("_text").alias("ta"), F.explode(F.sequence(F.lit(0), F.coalesce("_n", F.lit(1)) - 1)).alias("_b"))
    right = dealt.join(texts.withColumnRenamed("_text", "tb"), F.col("rb") == F.col("_id")).drop("_id")
    both = right.join(left, (F.col("ra") == F.col("_id")) & (F.col("_blk") == F.col("_b"))).select("a", "b", "ra", "rb", "ta", "tb")
    return both.mapInArrow(run, "a long, b long")


def similar_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (doc_id, n_shingles, component_id), one for each row of ``docs``."""
    owned = written(document_classes(docs, doc_id, text), "classes")
    reps = (owned.where("class IS NOT NULL AND doc_id IS NOT NULL").groupBy("class").agg(F.min("doc_id").alias("rep"), F.max("n_shingles").alias("n"), F.max("sketch").alias("sketch")))
    reps = written(reps, "representatives")
    found = written(candidate_pairs(class_signatures(docs, doc_id, text, common_features(owned))), "candidates")
    ra = reps.select(F.col("class").alias("a"), F.col("rep").alias("ra"), F.col("n").alias("na"), F.col("sketch").alias("ka"))
    rb = reps.select(F.col("class").alias("b"), F.col("rep").alias("rb"), F.col("n").alias("nb"), F.col("sketch").alias("kb"))
    stars = written(found.join(ra, "a").join(rb, "b").where(SIZES).mapInArrow(possible, "a long, b long, ra long, rb long"), "stars")
    links = written(verified(stars, docs, doc_id, text), "links")
    parts = written(components(links), "parts")
    for nearest in (NEAREST, None):
        more = written(verified(written(_across(found, parts, reps, nearest), "across"), docs, doc_id, text), "links")
        if not more.isEmpty():
            held = parts.select(F.col("node").alias("a"), F.col("component").alias("b"))
            parts = written(components(held.unionByName(more)), "parts")
    grouped = reps.join(parts, F.col("class") == F.col("node"), "left").select(F.col("class").alias("_c"), "rep", F.coalesce("component", "class").alias("_part"))
    least = grouped.groupBy(F.col("_part").alias("_p")).agg(F.min("rep").alias("_component"))
    label = grouped.join(least, F.col("_part") == F.col("_p")).select("_c", "_component")
    rows = owned.join(label, F.col("class") == F.col("_c"), "left")
    return rows.select("doc_id", "n_shingles", F.when(F.col("class").isNull(), F.col("doc_id")).when(F.col("doc_id").isNotNull(), F.col("_component")).alias("component_id"))


def _across(found: DataFrame, parts: DataFrame, reps: DataFrame, nearest: int | None, block: int = BLOCK) -> DataFrame:
    """Pairs that may link, of partners of one class that links so far do not connect; with ``nearest`` only that many of two parts.

    Of the partners of a class, a chain, a part with more than ``block`` members gets blocks of its
    own, which are not compared with each other; smaller parts share blocks.
    """
    around = found.select(F.col("a").alias("chain"), F.col("b").alias("class")).unionByName(found.select(F.col("a").alias("chain"), F.col("a").alias("class")).distinct())
    part = reps.join(parts, F.col("class") == F.col("node"), "left").select("class", "rep", "n", "sketch", F.coalesce("component", "class").alias("part"))
    members = around.join(part, "class").select("chain", "class", "rep", "n", "sketch", "part")
    count = members.groupBy("chain", "part").agg(F.count(F.lit(1)).alias("size"))
    large = F.col("size") > block
    chains = count.groupBy("chain").agg(
        F.count(F.lit(1)).alias("n_parts"), F.ceil(F.sum(F.when(large, 0).otherwise(F.col("size"))) / block).cast("int").alias("pool"),
        F.collect_list(F.when(large, F.struct(F.col("part").alias("p"), F.ceil(F.col("size") / block).cast("int").alias("blocks")))).alias("large")).where("n_parts > 1")
    chains = chains.select(F.col("chain").alias("_chain"), "pool", "large", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"))
    members = members.withColumn("_s", F.pmod(F.xxhash64("class"), F.lit(SALTS)).cast("int"))
    members = members.join(chains, (F.col("chain") == F.col("_chain")) & (F.col("_s") == F.col("_salt")))
    own = F.filter("large", lambda x: x.p == F.col("part"))
    blk = lambda n: F.pmod(F.xxhash64("class", F.lit(1)), n).cast("int")
    block_of = lambda p, k: F.struct(p.alias("p"), k.alias("k"))
    pool = F.lit(None).cast("long")
    members = members.withColumn("me", F.when(F.size(own) > 0, block_of(F.col("part"), blk(own[0].blocks))).otherwise(block_of(pool, blk(F.col("pool")))))
    pooled = F.transform(F.expr("sequence(0, greatest(pool, 1) - 1)"), lambda k: block_of(pool, k))
    others = F.flatten(F.transform(F.filter("large", lambda x: x.p != F.col("part")), lambda x: F.transform(F.sequence(F.lit(0), x.blocks - 1), lambda k: block_of(x.p, k))))
    members = members.withColumn("other", F.explode(F.concat(F.when(F.col("pool") > 0, pooled).otherwise(F.filter(pooled, lambda x: F.lit(False))), others)))
    members = members.withColumn("lo", F.least("me", "other")).withColumn("hi", F.greatest("me", "other"))
    members = members.select("chain", F.col("lo.p").alias("lp"), F.col("lo.k").alias("lk"), F.col("hi.p").alias("hp"), F.col("hi.k").alias("hk"),
                             (F.col("me") == F.col("lo")).alias("low"), (F.col("me") == F.col("hi")).alias("high"), "class", "rep", "n", "sketch", "part")

    def pairs(key, t):
        size, part = t["n"].to_numpy(), t["part"].to_numpy()
        i, j, far = possible_pairs(size, t["sketch"].to_pylist(), part, np.flatnonzero(t["low"].to_numpy()), np.flatnonzero(t["high"].to_numpy()))
        if nearest:
            i, j = nearest_of_parts(part, i, j, far, nearest)
        cls, rep = t["class"].to_numpy(), t["rep"].to_numpy()
        return pa.table({"a": cls[i], "b": cls[j], "ra": rep[i], "rb": rep[j]})

    return members.groupBy("chain", "lp", "lk", "hp", "hk").applyInArrow(pairs, "a long, b long, ra long, rb long").distinct()


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))
