r"""Collocations: contiguous phrases grown to the right from frequent prefixes, ranked by how far they exceed chance.

A phrase of ``min_count`` occurrences is made of parts with at least as many.  Three scans of the texts use that:

1. words are counted, per language;
2. pairs of words are counted where both are frequent;
3. every place where frequent pairs follow each other is a pointer: the words from there on, up to
   ``longest``, as far as the pairs last.  Equal pointers of a task are counted together, so a very
   common passage is one row of each task.

Pointers are projected on their prefix: they are dealt by their first three words (all that start with a
frequent pair, with a hot pair spread by its third word) and sorted.  Each task walks its
prefixes depth-first, extending to the right, and holds one path of at most ``longest`` words.

Which words and pairs are frequent goes to the scanning tasks as a bitmap of checksums of fixed size
(``BITS``).  It never misses a frequent one; others that share a bit only cost work, as every count is
compared with ``min_count`` itself.

Scores: a cut after the first k words of a phrase that occurs a times, whose parts occur l and r times among n
words, gives floor(1000*a*n / (l*r)), in decimals of 38 digits; the lowest cut counts, ties to the smallest k.

Defined results: a null language is ``und``, a null or empty text has no words; rows are documents of their own,
also where they repeat, and ids are not read; texts and pieces of any length are counted whole, in
overlapping parts; equal scores go by count, then phrase; an empty table gives an empty result; other columns are not read.
"""
from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import shuffle_width, table, written

BREAKS = b".,;:!?\n\x0b\x0c\r"
SEEN_AS = bytes(10 if c in BREAKS else c + 32 if 65 <= c <= 90 else c for c in range(256))
BREAK = b"\xff"  # stands between pieces; no UTF-8 text holds it
BLANK = re.compile(rb"[ \t\n]")
SEGMENT = 1 << 20  # bytes of a text that are cut into words at a time
MOST_WORDS = 1 << 22  # words that a task gathers before it counts
MOST_KNOWN = 500_000  # words that a task remembers
BITS = 26  # a bitmap has 2 ** BITS bits, 8 MB
WALK = 3  # words of the prefixes that tasks share out
SCHEMA = pa.schema([("lang", pa.string()), ("phrase", pa.binary()), ("n", pa.int64())])


def segments(text: str | None) -> Iterator[list[bytes]]:
    """The words of a text in order, with ``BREAK`` between pieces, in lists of bounded size."""
    data, at = (text or "").encode().translate(SEEN_AS), 0
    while at < len(data):
        blank = BLANK.search(data, at + SEGMENT) if at + SEGMENT < len(data) else None
        end = blank.start() if blank else len(data)
        yield data[at:end].replace(b"\n", b" \xff ").split()
        at = end


def set_in(bits: bytes, lang: str, phrase: bytes) -> bool:
    at = crc32(phrase, crc32(lang.encode())) & ((1 << BITS) - 1)
    return bool(bits[at >> 3] >> (at & 7) & 1)


class Places(dict):
    """Numbers of the words of a language that may be frequent, in order of appearance; -1 for others and for breaks."""

    def __init__(self, lang: str, bits: bytes):
        super().__init__({BREAK: -1})
        self.lang, self.bits, self.names = lang, bits, []

    def __missing__(self, word: bytes) -> int:
        self[word] = place = len(self.names) if set_in(self.bits, self.lang, word) else -1
        if place >= 0:
            self.names.append(word)
        return place


def bitmap_of(phrases: DataFrame) -> bytes:
    """The bitmap of (lang, phrase): at most 2 ** (BITS - 15) rows of 4 KB come to the driver."""
    at = F.expr(f"(crc32(concat(encode(lang, 'utf-8'), phrase)) & {(1 << BITS) - 1}) + 1")  # buckets open at 1
    rows = phrases.select(at.alias("at")).groupBy(F.bitmap_bucket_number("at").alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits"))
    out = bytearray(1 << (BITS - 3))
    for r in rows.collect():
        start = (r["b"] - 1) * 4096
        out[start:start + 4096] = r["bits"]
    return bytes(out)


def rows_of(lang: str, phrases: pa.Array, n: np.ndarray) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(n), 50_000):
        part = phrases.slice(at, 50_000)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(part)), part, pa.array(n[at:at + 50_000], pa.int64())], schema=SCHEMA)


def joined(names: list[bytes], columns: list[np.ndarray], ending: bool = False) -> pa.Array:
    """Phrases of the words with these numbers (-1: none), with a blank behind each if ``ending``."""
    words = pa.array(names, pa.binary())
    parts = [words.take(pa.array(c, pa.int64(), mask=c < 0)) for c in columns]
    parts += [pa.array([b""] * len(columns[0]), pa.binary())] if ending else []
    return pc.binary_join_element_wise(*parts, pa.scalar(b" ", pa.binary()), null_handling="skip")


def counted_words(held: dict[str, Counter]) -> Callable:
    """Counts words; an empty one stands for all words of the language."""

    def add(lang: str, text: str | None) -> int:
        mine, before = held.setdefault(lang, Counter()), 0
        for words in segments(text):
            mine.update(words)
            before += len(words)
        breaks = mine.pop(BREAK, 0)
        mine[b""] += before - breaks
        return len(mine)

    return add


def word_counts(docs: DataFrame) -> DataFrame:
    most = MOST_KNOWN

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Counter] = {}
        add = counted_words(held)

        def handed_on() -> Iterator[pa.RecordBatch]:
            for lang, found in held.items():
                yield from rows_of(lang, pa.array(list(found), pa.binary()), np.array(list(found.values()), np.int64))
            held.clear()

        for batch in batches:
            for lang, text in zip(batch.column(0), batch.column(1), strict=True):
                if add(lang.as_py(), text.as_py()) > most:
                    yield from handed_on()
        yield from handed_on()

    rows = docs.mapInArrow(count, "lang string, phrase binary, n long")
    return rows.groupBy("lang", "phrase").agg(F.sum("n").alias("n"))


def pairs_in(lang: str, names: list[bytes], at: np.ndarray, starts: int) -> Iterator[pa.RecordBatch]:
    """Counts of pairs that open at the first ``starts`` places of a row of words."""
    a, b = at[:-1][:starts].astype(np.int64), at[1:][:starts].astype(np.int64)
    good = (a >= 0) & (b >= 0)
    key, n = np.unique(a[good] * len(names) + b[good], return_counts=True)
    if len(key):
        yield from rows_of(lang, joined(names, [key // len(names), key % len(names)]), n)


def pointers_in(lang: str, names: list[bytes], at: np.ndarray, starts: int, bits: bytes, longest: int) -> Iterator[pa.RecordBatch]:
    """Counts of pointers that open at the first ``starts`` places: words as far as each pair of them may be frequent."""
    a, b = at[:-1].astype(np.int64), at[1:].astype(np.int64)
    good = np.flatnonzero((a >= 0) & (b >= 0))
    key, place = np.unique(a[good] * len(names) + b[good], return_inverse=True)
    if not len(key):
        return
    flags = np.array([set_in(bits, lang, p) for p in joined(names, [key // len(names), key % len(names)]).to_pylist()])
    follows = np.zeros(len(at) + longest, bool)  # word i is followed by i + 1 in a frequent pair
    follows[good] = flags[place]
    open_at = np.flatnonzero(follows[:-1] & follows[1:])
    open_at = open_at[open_at < starts]
    if not len(open_at):
        return
    columns, alive, rank = [at[open_at].astype(np.int64)], np.ones(len(open_at), bool), at[open_at].astype(np.int64)
    for d in range(1, longest):
        alive = alive & follows[open_at + d - 1]
        word = np.where(alive, at[np.minimum(open_at + d, len(at) - 1)], -1).astype(np.int64)
        columns.append(word)
        _, rank = np.unique(rank * (len(names) + 1) + word + 1, return_inverse=True)  # equal so far, equal rank
    _, first, n = np.unique(rank, return_index=True, return_counts=True)
    yield from rows_of(lang, joined(names, [c[first] for c in columns], ending=True), n)


def tallied(docs: DataFrame, longest: int, word_bits, counts: Callable) -> DataFrame:
    """(lang, phrase, n): ``counts(lang, names, words, starts)`` over all texts, summed.

    A task gathers the numbers of the words of each language; of a text that is longer than
    what it gathers, the last words are carried over, as phrases open in them.
    """
    most, most_known, carry = MOST_WORDS, MOST_KNOWN, longest - 1

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places: dict[str, Places] = {}
        held: dict[str, list[np.ndarray]] = {}
        size = 0

        def handed_on(going: str | None) -> Iterator[pa.RecordBatch]:
            for lang in list(held):
                at = np.concatenate(held.pop(lang))
                starts = len(at) - carry if lang == going else len(at)
                if starts > 0:
                    yield from counts(lang, places[lang].names, at, starts)
                if lang == going:
                    held[lang] = [at[max(0, starts):]]
            if sum(map(len, places.values())) > most_known:
                going_words = {lang: [places[lang].names[i] if i >= 0 else BREAK for i in held[lang][0]] for lang in held}
                places.clear()
                for lang, words in going_words.items():
                    places[lang] = Places(lang, word_bits.value)
                    held[lang] = [np.array([places[lang][w] for w in words], np.int32)]

        for batch in batches:
            for lang, text in zip(batch.column(0), batch.column(1), strict=True):
                lang = lang.as_py()
                for words in segments(text.as_py()):
                    if lang not in places:
                        places[lang] = Places(lang, word_bits.value)
                    held.setdefault(lang, []).append(np.fromiter(map(places[lang].__getitem__, words), np.int32, len(words)))
                    size += len(words)
                    if size > most:
                        yield from handed_on(lang)
                        size = 0
                if lang in held:
                    held[lang].append(np.array([-1], np.int32))
        yield from handed_on(None)

    rows = docs.mapInArrow(count, "lang string, phrase binary, n long")
    return rows.groupBy("lang", "phrase").agg(F.sum("n").alias("n"))


def grown(pointers: Iterator[tuple[str, bytes, int]], min_count: int) -> Iterator[tuple[str, bytes, int]]:
    """Frequent phrases of ``WALK`` words and more: a depth-first walk over sorted pointers, whose path is all that is held."""
    at, path, counts = None, [], []

    def closed(depth: int) -> Iterator[tuple[str, bytes, int]]:
        while len(path) > depth:
            if len(path) >= WALK and counts[-1] >= min_count:
                yield at, b" ".join(path), counts[-1]
            path.pop()
            counts.pop()

    for lang, pointer, n in pointers:
        words = pointer.split(b" ")[:-1]
        depth = 0
        if lang == at:
            while depth < min(len(path), len(words)) and path[depth] == words[depth]:
                depth += 1
        yield from closed(depth)
        at = lang
        path += words[depth:]
        counts += [0] * (len(words) - depth)
        for i in range(len(words)):
            counts[i] += n
    yield from closed(0)


def grown_phrases(pointers: DataFrame, min_count: int) -> DataFrame:
    """(lang, phrase, n) of frequent phrases of ``WALK`` words and more, from (lang, phrase, n) of pointers."""
    prefix = F.slice(F.split(F.col("phrase").cast("string"), " "), 1, WALK)
    dealt = pointers.repartition(shuffle_width(pointers.sparkSession), F.col("lang"), prefix).sortWithinPartitions("lang", "phrase")

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for r in zip(*[c.to_pylist() for c in b.columns], strict=True))
        held = []
        for r in grown(rows, min_count):
            held.append(r)
            if len(held) >= 20_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), SCHEMA, strict=True)], schema=SCHEMA)
                held = []
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), SCHEMA, strict=True)], schema=SCHEMA)

    return dealt.mapInArrow(walk, "lang string, phrase binary, n long")


def frequent_phrases(docs: DataFrame, min_count: int = 100, longest: int = 5, lang: str = "lang", text: str = "text") -> DataFrame:
    """(lang, phrase, n): all phrases of 1 to ``longest`` words with their occurrences, and the number of all words under an empty phrase."""
    spark = docs.sparkSession
    docs = docs.select(F.coalesce(lang, F.lit("und")).alias("lang"), F.col(text).alias("text"))
    words = written(word_counts(docs).where((F.col("n") >= min_count) | (F.col("phrase") == F.lit(b""))), "words")
    word = spark.sparkContext.broadcast(bitmap_of(words))
    pairs = written(tallied(docs, longest, word, pairs_in).where(F.col("n") >= min_count), "word-pairs")
    out = words.unionByName(pairs)
    if longest >= WALK:
        pair = spark.sparkContext.broadcast(bitmap_of(pairs))
        pointers = tallied(docs, longest, word, lambda lang, names, at, starts: pointers_in(lang, names, at, starts, pair.value, longest))
        out = out.unionByName(grown_phrases(pointers, min_count))
    return written(out.withColumn("phrase", F.col("phrase").cast("string")), "phrases")


def scored_phrases(phrases: DataFrame) -> DataFrame:
    """(lang, phrase, words, a, l, r, n, score) of phrases of two words and more, each by its lowest cut."""
    long = F.col("n").alias("a")
    split = phrases.where("phrase <> ''").withColumn("words", F.split("phrase", " "))
    found = split.where(F.size("words") > 1).select("lang", "phrase", "words", long)
    join = lambda first, size: F.array_join(F.slice("words", first, size), " ")
    cuts = found.withColumn("k", F.explode(F.sequence(F.lit(1), F.size("words") - 1)))
    cuts = cuts.withColumn("_first", join(F.lit(1), F.col("k"))).withColumn("_rest", join(F.col("k") + 1, F.size("words") - F.col("k")))
    count = lambda key, name: phrases.select("lang", F.col("phrase").alias(key), F.col("n").alias(name))
    cuts = cuts.join(count("_first", "l"), ["lang", "_first"]).join(count("_rest", "r"), ["lang", "_rest"])
    cuts = cuts.join(phrases.where("phrase = ''").select("lang", "n"), "lang")
    wide = lambda c: f"CAST({c} AS DECIMAL(19, 0))"
    cuts = cuts.withColumn("score", F.expr(f"({wide('1000L * a')} * {wide('n')}) div ({wide('l')} * {wide('r')})"))
    best = cuts.groupBy("lang", "phrase", "words", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    return best.select("lang", "phrase", "words", "a", "cut.l", "cut.r", "n", "cut.score")


def without_contained(found: DataFrame, share: int = 100) -> DataFrame:
    """Drops a phrase inside a longer one that occurs in ``share`` hundredths of its places or more.

    Counts only fall as phrases grow, so that a longer one by a single word can tell.
    """
    longer = found.where(F.size("words") > 2)
    inner = F.array(F.expr("slice(words, 1, size(words) - 1)"), F.expr("slice(words, 2, size(words) - 1)"))
    parts = longer.select("lang", F.explode(F.transform(inner, lambda w: F.array_join(w, " "))).alias("phrase"), F.col("a").alias("_more"))
    parts = parts.groupBy("lang", "phrase").agg(F.max("_more").alias("_more"))
    joined = found.join(parts, ["lang", "phrase"], "left")
    return joined.where(F.col("_more").isNull() | (100 * F.col("_more") < share * F.col("a"))).drop("_more")


def mine_phrases(docs: DataFrame, min_count: int = 100, longest: int = 5, share: int = 100, k: int = 2000, lang: str = "lang", text: str = "text") -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the first ``k`` phrases of every language."""
    found = without_contained(scored_phrases(frequent_phrases(docs, min_count, longest, lang, text)), share)
    order = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), "phrase")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mine_phrases(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
 '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[ \t]+'), lambda x: x <> '') AS words FROM d),
g AS (SELECT lang, k, array_to_string(words[i:i + k - 1], ' ') AS phrase FROM (SELECT lang, k, words, unnest(range(1, len(words) - k + 2)) AS i FROM w, range(1, 6) AS ks(k))),
f AS (SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY ALL),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, k AS size, phrase, f AS a, string_split(phrase, ' ') AS words FROM f WHERE k > 1 AND f >= 100),
u AS (SELECT c.*, cut, array_to_string(words[1:cut], ' ') AS head, array_to_string(words[cut + 1:], ' ') AS tail FROM c, range(1, 5) AS cs(cut) WHERE cut < size),
s AS (SELECT u.lang, u.phrase, u.words, a, x.f AS l, y.f AS r, n, cut, ((1000::HUGEINT * a * n) // (x.f::HUGEINT * y.f))::BIGINT AS score
 FROM u JOIN f x ON x.lang = u.lang AND x.phrase = head AND x.k = cut JOIN f y ON y.lang = u.lang AND y.phrase = tail AND y.k = size - cut JOIN n ON n.lang = u.lang),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) AS best FROM s) WHERE best = 1),
o AS (SELECT * FROM b WHERE NOT EXISTS (SELECT 1 FROM b m WHERE m.lang = b.lang AND len(m.words) > len(b.words) AND m.a >= b.a AND contains(' ' || m.phrase || ' ', ' ' || b.phrase || ' '))),
k AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank, phrase, a, l, r, n, score FROM o)
SELECT * FROM k WHERE rank <= 2000
"""
