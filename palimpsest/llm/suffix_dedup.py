"""Repeated passages removed through families of sparse suffix arrays.

Wanted: every byte covered by a ``LENGTH``-byte string that also starts earlier
(in a row with a smaller id, or earlier in the same row), judged on the input.

An index over all suffixes would be many times the corpus, so the arrays are
sparse.  Each window of LENGTH bytes names one suffix, its anchor: the leftmost
of its KMER-grams with the smallest hash.  Equal windows name the same place in
themselves, so they always meet.  Neighbouring windows mostly share an anchor, and
such a run of windows is one entry: (anchor gram, fingerprint of all its bytes,
row, place).

Entries are dealt over tasks by anchor gram.  A task keeps a logarithmic family
of arrays (``SuffixLevels``): a new batch is sorted into an array of its own,
merge-scanned against every level for long matches, and levels of equal size
merge, so each entry is moved a logarithmic number of times.  Of equal entries the
earliest stays and the others are repeats.  Entries that share an anchor gram but
not all bytes may still share windows: for the earliest of each, its bytes are
fetched and its single windows go through a second family in the same way.

Skew: repeats within a batch of rows are found before any shuffle, so a passage
costs a shuffled entry for each batch at most.  An anchor gram that occurs with
very many different surroundings is found by a counting pass; its windows are
dealt one by one, by their own fingerprint.

Order within an array is by fingerprint of the fixed-length prefix instead of
lexicographic: matches of one fixed length need equal prefixes side by side, not
an order.  Fingerprints are 64 bits and compared within one task's share only.

Defined results: null text is empty; texts shorter than LENGTH keep all bytes;
rows without an id come last in the order, by a hash of their text; rows that repeat an
id are ordered by a 64-bit hash of their text, and rows equal in both count as one and get
its result; an empty table gives an empty result; other columns are not read.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import shuffle_width, table, written

LENGTH, KMER = 100, 32
GRAMS = LENGTH - KMER + 1  # grams in a window
PLACE_BITS = 20
STRIDE = (1 << PLACE_BITS) - 512  # windows handled at once
FLUSH = 1_000_000
U = np.uint64
M1, M2, M3 = U(0x9E3779B97F4A7C15), U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB)
LAST_ID = (1 << 63) - 1


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * M2
    x = (x ^ (x >> U(27))) * M3
    return x ^ (x >> U(31))


class Rolling:
    """Polynomial fingerprints modulo 2^64 of any span, from prefix sums."""

    def __init__(self, factor: int):
        n = (1 << PLACE_BITS) + 1
        self.byte = mix(np.arange(1, 257, dtype=U) * U(factor))
        self.power = np.concatenate([np.ones(1, U), np.cumprod(np.full(n, factor, U))])
        self.inverse = np.concatenate([np.ones(1, U), np.cumprod(np.full(n, pow(factor, -1, 1 << 64), U))])

    def prefix(self, data: np.ndarray) -> np.ndarray:
        h = np.zeros(len(data) + 1, U)
        np.cumsum(self.byte[data] * self.power[: len(data)], out=h[1:])
        return h

    def span(self, h: np.ndarray, start: np.ndarray, n) -> np.ndarray:
        return (h[start + n] - h[start]) * self.inverse[start]


_ROLLING: list[Rolling] = []


def rolling() -> list[Rolling]:
    if not _ROLLING:
        _ROLLING.extend([Rolling(0x9FB21C651E98DF25), Rolling(0xD6E8FEB86659FD93)])
    return _ROLLING


def window_prints(data: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Fingerprints of the windows that begin at ``start``."""
    one, two = rolling()
    return mix(one.span(one.prefix(data), start, LENGTH)) ^ mix(two.span(two.prefix(data), start, LENGTH) + M1)


def anchored_runs(data: np.ndarray, last_start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, number of windows, anchor gram, fingerprint) of runs of windows with one anchor.

    ``last_start[s]`` is the last place where a window of the text at s may begin.
    """
    n = len(data) - LENGTH + 1
    if n <= 0:
        return (np.empty(0, np.int64),) * 2 + (np.empty(0, U),) * 2
    one, two = rolling()
    h = one.prefix(data)
    gram = (h[KMER:] - h[:-KMER]) * one.inverse[: len(data) - KMER + 1]
    order = (gram ^ (gram >> U(32))) * M2
    low = (order & ~U((1 << PLACE_BITS) - 1)) | np.arange(len(order), dtype=U)
    for step in (1, 2, 4, 8, 16, 32):
        low = np.minimum(low[:-step], low[step:])
    low = np.minimum(low[: 1 - (GRAMS - 63)], low[GRAMS - 64 :])
    anchor = (low[:n] & U((1 << PLACE_BITS) - 1)).astype(np.int64)
    s = np.flatnonzero(np.arange(n) <= last_start[:n])
    if not len(s):
        return (np.empty(0, np.int64),) * 2 + (np.empty(0, U),) * 2
    a = anchor[s]
    first = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]]))
    start, count, at = s[first], np.diff(np.append(first, len(s))), a[first]
    key = mix(gram[at])
    full = mix(two.span(two.prefix(data), start, count + LENGTH - 1) + count.astype(U)) ^ (key * M3)
    return start, count, key, full


def merged_runs(doc: np.ndarray, th: np.ndarray, start: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
    """Runs of window starts, joined where they touch or overlap."""
    if not len(doc):
        return doc, th, start, n
    o = np.lexsort((start, th, doc))
    doc, th, start, end = doc[o], th[o], start[o], (start + n)[o]
    new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (th[1:] != th[:-1])])
    # Within a row, ends seen so far: rows are kept apart by a large step each.
    step = np.cumsum(new) * (1 << 40)
    reach = np.maximum.accumulate(end + step)
    new[1:] |= (start + step)[1:] > reach[:-1]
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(doc)) - 1
    return doc[first], th[first], start[first], reach[last] - step[last] - start[first]


def pack(th: np.ndarray, start: np.ndarray, n) -> np.ndarray:
    return (th << 39) | (start << 7) | n


def unpack(pos: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return pos >> 39, (pos >> 7) & 0xFFFFFFFF, pos & 127


class SuffixLevels:
    """A logarithmic family of arrays of entries (fp, key, doc, pos), each sorted by fp; the earliest of equal fp stays."""

    def __init__(self):
        self.levels: list[tuple[np.ndarray, ...]] = []

    def add(self, fp: np.ndarray, key: np.ndarray, doc: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Add a batch; gives (doc, pos) of the entries, new or held, that turn out to be repeats."""
        if not len(fp):
            return doc, pos
        gone_doc, gone_pos = [], []
        o = np.lexsort((pos, doc, fp))
        fp, key, doc, pos = fp[o], key[o], doc[o], pos[o]
        again = np.concatenate([[False], fp[1:] == fp[:-1]])
        same = again & np.concatenate([[False], (doc[1:] == doc[:-1]) & (pos[1:] == pos[:-1])])
        gone_doc.append(doc[again & ~same])
        gone_pos.append(pos[again & ~same])
        fp, key, doc, pos = fp[~again], key[~again], doc[~again], pos[~again]
        for lfp, _, ldoc, lpos in self.levels:
            if not len(fp):
                break
            j = np.minimum(np.searchsorted(lfp, fp), len(lfp) - 1)
            met = lfp[j] == fp
            if not met.any():
                continue
            i, j = np.flatnonzero(met), j[met]
            later = (doc[i] > ldoc[j]) | ((doc[i] == ldoc[j]) & (pos[i] > lpos[j]))
            before = (doc[i] < ldoc[j]) | ((doc[i] == ldoc[j]) & (pos[i] < lpos[j]))
            gone_doc += [doc[i[later]], ldoc[j[before]]]
            gone_pos += [pos[i[later]], lpos[j[before]]]
            ldoc[j[before]], lpos[j[before]] = doc[i[before]], pos[i[before]]
            fp, key, doc, pos = fp[~met], key[~met], doc[~met], pos[~met]
        if len(fp):
            self.levels.append((fp, key, doc, pos))
            while len(self.levels) > 1 and len(self.levels[-2][0]) < 2 * len(self.levels[-1][0]):
                self._merge(2)
        return np.concatenate(gone_doc), np.concatenate(gone_pos)

    def _merge(self, n: int) -> None:
        parts, self.levels = self.levels[-n:], self.levels[:-n]
        fp = np.concatenate([p[0] for p in parts])
        o = np.argsort(fp, kind="stable")
        self.levels.append((fp[o], *[np.concatenate([p[k] for p in parts])[o] for k in (1, 2, 3)]))

    def entries(self) -> tuple[np.ndarray, ...]:
        if not self.levels:
            return np.empty(0, U), np.empty(0, U), np.empty(0, np.int64), np.empty(0, np.int64)
        self._merge(len(self.levels))
        return self.levels[0]


def _bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and the places where rows begin and end."""
    a = column.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(a.buffers()[1], np.int64)[a.offset : a.offset + len(a) + 1]
    data = np.frombuffer(a.buffers()[2], np.uint8) if a.buffers()[2] is not None else np.empty(0, np.uint8)
    return data, offsets


def batch_entries(batch: pa.RecordBatch, hot: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """Entries (fp, key, doc, pos) of rows (id, text hash, text); windows of hot anchors one by one."""
    if not len(batch):
        return
    doc, th = batch.column(0).to_numpy(), batch.column(1).to_numpy()
    data, offsets = _bytes_of(batch.column(2))
    for lo in range(int(offsets[0]), int(offsets[-1]), STRIDE):
        part = data[lo : min(lo + STRIDE + LENGTH - 1, int(offsets[-1]))]
        rows = np.arange(np.searchsorted(offsets, lo, "right") - 1, np.searchsorted(offsets, lo + len(part), "left"))
        begin, end = np.maximum(offsets[rows], lo), np.minimum(offsets[rows + 1], lo + len(part))
        owner = np.repeat(rows, end - begin)
        last = np.repeat(offsets[rows + 1] - LENGTH - lo, end - begin)
        start, count, key, fp = anchored_runs(part, last)
        if not len(start):
            continue
        if len(hot):
            j = np.minimum(np.searchsorted(hot, key), len(hot) - 1)
            at = hot[j] == key
            if at.any():
                each = np.repeat(start[at], count[at]) + np.arange(count[at].sum()) - np.repeat(np.cumsum(count[at]) - count[at], count[at])
                own = window_prints(part, each)
                start, count = np.concatenate([start[~at], each]), np.concatenate([count[~at], np.ones(len(each), np.int64)])
                key, fp = np.concatenate([key[~at], mix(own + M2)]), np.concatenate([fp[~at], own])
        row = owner[start]
        yield fp, key, doc[row], pack(th[row], start + lo - offsets[row], count)


def flushed(batches: Iterator[pa.RecordBatch], hot: np.ndarray) -> Iterator[list[np.ndarray]]:
    """Entries of about FLUSH at a time."""
    held, total = [], 0
    for batch in batches:
        for entries in batch_entries(batch, hot):
            held.append(entries)
            total += len(entries[0])
            if total >= FLUSH:
                yield [np.concatenate(c) for c in zip(*held)]
                held, total = [], 0
    if held:
        yield [np.concatenate(c) for c in zip(*held)]


def hot_anchors(rows: DataFrame) -> np.ndarray:
    """Anchor grams with so many different entries that one task would get too many; at most 8 for each shuffle partition."""
    width = shuffle_width(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for fp, key, _, _ in flushed(batches, np.empty(0, U)):
            keys, n = np.unique(key[np.unique(fp, return_index=True)[1]], return_counts=True)
            often = n >= max(16, len(key) / (4 * width))
            yield pa.RecordBatch.from_arrays([pa.array(np.append(keys[often], U(0)).view(np.int64)), pa.array(np.append(n[often], len(key)))], names=["key", "n"])

    counts = rows.mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    counts = written(counts, "anchor-counts")
    total = counts.where("key = 0").agg(F.sum("n")).first()[0] or 0
    often = counts.where((F.col("key") != 0) & (F.col("n") >= max(16, total / (8 * width)))).orderBy(F.desc("n"), "key").select("key").collect()
    return np.sort(np.array([r["key"] for r in often], np.int64).view(U))


FOUND = "kind int, key long, d long, th long, start long, n long"


def found_batch(kind: int, key: np.ndarray, doc: np.ndarray, th: np.ndarray, start: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(doc), kind, np.int32)), pa.array(key.view(np.int64)), pa.array(doc), pa.array(th), pa.array(start), pa.array(n)],
                                      names=["kind", "key", "d", "th", "start", "n"])


def first_matches(rows: DataFrame, hot: np.ndarray) -> DataFrame:
    """Kind 0: runs of windows known to be repeats.  Kind 1: earliest entries whose anchor gram has others beside it."""
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast(hot)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for fp, key, doc, pos in flushed(batches, shared.value):
            local = SuffixLevels()
            gone_doc, gone_pos = local.add(fp, key, doc, pos)
            fp, key, doc, pos = local.entries()
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(fp.view(np.int64)), pa.array(doc), pa.array(pos), pa.array(np.zeros(len(doc), np.int64))], names=["key", "fp", "d", "pos", "n"])
            th, start, n = unpack(gone_pos)
            d, th, start, n = merged_runs(gone_doc, th, start, n)
            spread = mix(d.astype(U) * M1 + start.astype(U))
            yield pa.RecordBatch.from_arrays([pa.array(spread.view(np.int64)), pa.array(np.zeros(len(d), np.int64)), pa.array(d), pa.array(pack(th, start, 0)), pa.array(n)], names=["key", "fp", "d", "pos", "n"])

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels = SuffixLevels()
        for batch in batches:
            key, fp, doc, pos, n = (c.to_numpy() for c in batch.columns)
            known = n > 0
            gone_doc, gone_pos = levels.add(fp[~known].view(U), key[~known].view(U), doc[~known], pos[~known])
            th, start, count = unpack(np.concatenate([gone_pos, pos[known]]))
            count[len(gone_pos) :] = n[known]
            d, th, start, count = merged_runs(np.concatenate([gone_doc, doc[known]]), th, start, count)
            if len(d):
                yield found_batch(0, np.zeros(len(d), U), d, th, start, count)
        fp, key, doc, pos = levels.entries()
        o = np.argsort(key, kind="stable")
        key, doc, pos = key[o], doc[o], pos[o]
        same = key[1:] == key[:-1]
        at = np.flatnonzero(np.concatenate([same, [False]]) | np.concatenate([[False], same])) if len(key) else np.empty(0, np.int64)
        for lo in range(0, len(at), 100_000):
            p = at[lo : lo + 100_000]
            th, start, n = unpack(pos[p])
            yield found_batch(1, key[p], doc[p], th, start, n)

    entries = rows.mapInArrow(emit, "key long, fp long, d long, pos long, n long")
    return entries.repartition(shuffle_width(spark), "key").mapInArrow(match, FOUND)


def window_matches(texts: DataFrame, doubtful: DataFrame) -> DataFrame:
    """Repeated windows (d, th, start, n) among the entries in ``doubtful``."""
    marks = doubtful.groupBy("d", "th").agg(F.collect_list(F.struct("key", "start", "n")).alias("marks"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            data, offsets = _bytes_of(batch.column(2))
            marks = batch.column(3)
            size = np.diff(marks.offsets.to_numpy())
            row = np.repeat(np.arange(len(batch)), size)
            flat = marks.flatten()
            key, start, n = (flat.field(c).to_numpy() for c in ("key", "start", "n"))
            d, th = batch.column(0).to_numpy()[row], batch.column(1).to_numpy()[row]
            at, text = offsets[:-1][row] + start, data.tobytes()
            for lo in range(0, len(at), 20_000):
                p = slice(lo, lo + 20_000)
                pieces = [text[a : a + k + LENGTH - 1] for a, k in zip(at[p].tolist(), n[p].tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(key[p]), pa.array(d[p]), pa.array(pack(th[p], start[p], n[p])), pa.array(pieces, pa.binary())], names=["key", "d", "pos", "bytes"])

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels = SuffixLevels()
        per = STRIDE // (LENGTH + GRAMS)
        for batch in batches:
            for lo in range(0, len(batch), per):
                part = batch.slice(lo, per)
                data, offsets = _bytes_of(part.column(3))
                data, offsets = data[offsets[0] : offsets[-1]], offsets - offsets[0]
                doc, (th, start, n) = part.column(1).to_numpy(), unpack(part.column(2).to_numpy())
                inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                fp = window_prints(data, np.repeat(offsets[:-1], n) + inner)
                gone_doc, gone_pos = levels.add(fp, fp, np.repeat(doc, n), pack(np.repeat(th, n), np.repeat(start, n) + inner, 1))
                th, start, n = unpack(gone_pos)
                d, th, start, n = merged_runs(gone_doc, th, start, n)
                if len(d):
                    yield pa.RecordBatch.from_arrays([pa.array(d), pa.array(th), pa.array(start), pa.array(n)], names=["d", "th", "start", "n"])

    pieces = texts.join(marks.hint("shuffle_hash"), ["d", "th"]).select("d", "th", "text", "marks").mapInArrow(cut, "key long, d long, pos long, bytes binary")
    return pieces.repartition(shuffle_width(texts.sparkSession), "key").mapInArrow(match, "d long, th long, start long, n long")


def keyed_rows(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(d, th, text, doc_id): ``d`` is the place of a row in the order, ``th`` tells apart different texts in one place.

    Of an id that stands for several texts, ``th`` is the rank of a text's 64-bit hash.  Rows
    without an id are spread over the last places by 39 bits of one hash, with 24 of another in ``th``.
    """
    mine = docs.select(F.col(doc_id).cast("long").alias("_id"), F.xxhash64(text).alias("_h"), F.col(text).alias("text"), F.col(doc_id).alias("doc_id"))
    texts = mine.where("_id IS NOT NULL").select("_id", "_h").distinct()
    several = texts.groupBy("_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("_id")
    ranked = texts.join(several, "_id").withColumn("_rank", F.row_number().over(Window.partitionBy("_id").orderBy("_h")))
    ranked = written(ranked.select(F.col("_id").alias("_i"), F.col("_h").alias("_t"), "_rank"), "repeated-ids")
    rows = mine.join(ranked, (F.col("_id") == F.col("_i")) & (F.col("_h") == F.col("_t")), "left")
    last = F.lit(LAST_ID) - F.xxhash64(F.lit(1), "text").bitwiseAND((1 << 39) - 1)
    most = F.assert_true(F.coalesce("_rank", F.lit(0)) < 1 << 24, F.lit("an id stands for more than 16 million texts"))
    th = F.when(F.col("_id").isNull(), F.col("_h").bitwiseAND(0xFFFFFF)).otherwise(F.coalesce("_rank", F.lit(0)).cast("long"))
    return rows.where(most.isNull()).select(F.coalesce("_id", last).alias("d"), th.alias("th"), "text", "doc_id")


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", kept: bool = False) -> DataFrame:
    """One row for each row of ``docs``: id, n_bytes, n_removed, n_spans, kept_sha256, spans; with ``kept`` the remaining bytes."""
    spark = docs.sparkSession
    rows = keyed_rows(docs, doc_id, text)
    bare = rows.select("d", "th", "text")
    found = written(first_matches(bare, hot_anchors(bare)), "suffix-matches")
    texts = rows.repartition(shuffle_width(spark), "d", "th")
    more = window_matches(texts, found.where("kind = 1"))
    runs = found.where("kind = 0").select("d", "th", "start", "n").unionByName(more)
    spans = runs.groupBy("d", "th").agg(F.collect_list(F.struct("start", "n")).alias("runs"))
    joined = texts.join(spans.hint("shuffle_hash"), ["d", "th"], "left").select("doc_id", "text", "runs")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, removed, n_spans, digests, all_spans, rest = [], [], [], [], [], []
            for value, rs in zip(batch.column(1).cast(pa.binary()).to_pylist(), batch.column(2).to_pylist()):
                value = value or b""
                out = cut_spans(rs or ())
                left = b"".join(value[a:b] for a, b in zip([0, *[e for _, e in out]], [*[s for s, _ in out], len(value)]))
                sizes.append(len(value))
                removed.append(len(value) - len(left))
                n_spans.append(len(out))
                digests.append(hashlib.sha256(left).hexdigest())
                all_spans.append([list(x) for x in out])
                rest.append(left)
            columns = [batch.column(0), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(n_spans, pa.int64()), pa.array(digests, pa.string()), pa.array(all_spans, pa.list_(pa.list_(pa.int64())))]
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(rest, pa.binary())] if kept else columns, names=[*names, "kept"] if kept else names)

    kind = dict(docs.dtypes)[doc_id]
    return joined.mapInArrow(finish, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<array<long>>" + (", kept binary" if kept else ""))


def cut_spans(runs) -> list[tuple[int, int]]:
    """Maximal byte spans that runs of windows cover."""
    out: list[tuple[int, int]] = []
    for start, end in sorted((r["start"], r["start"] + r["n"] - 1 + LENGTH) for r in runs):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("spans")
