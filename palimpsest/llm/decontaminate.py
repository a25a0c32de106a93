"""Benchmark decontamination as a prefix-filtered set join.

Each benchmark item is cut into windows of ``width`` consecutive words (an item
with fewer words is one window).  A document contains a window only if it holds
every word of it, so one word of each window, its prefix, must occur; the rarest
word in the corpus is taken.  Each place of a prefix word in a document gives
candidate windows; position and length bounds decide whether the window fits
around that place, and all its words are then compared.

Rarity is counted over all documents.  Up to ``sent_windows`` distinct windows are
sent to the tasks, which then scan the documents.  More windows stay a table: places
of prefix words, with the words around them, and windows are joined on the prefix
word, salted, in one pass over the documents; nothing of the benchmark but the set of
prefix words (``sent_words`` at most, else places of all words are joined) leaves the
executors.  Both ways give the same rows.

Defined results: null or wordless texts have no words and are not contaminated; rows
with the same id, or none, and repeated document rows each give a row of their own;
repeated items each count, an item without id as the empty text; an empty benchmark
marks nothing; texts of any length are read whole; other columns never matter.
"""
from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import sent, table, tidy, values, written

WIDTH = 10
SENT_WINDOWS, SENT_WORDS = 200_000, 2_000_000
SALTS = 16
FLUSH = 500_000  # words counted in a task before they are passed on
# A-Z become a-z; bytes of [\x00-\x2F\x3A-\x60\x7B-\x7F] (after that) become spaces.
FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def words(text: str | None) -> list[bytes]:
    return text.encode().translate(FOLD).split() if text else []


def _as_binary(column: pa.Array) -> Iterator[bytes | None]:
    return values(pc.cast(column, pa.binary()))


def item_windows(items: DataFrame, item_id: str = "item_id", text: str = "text", width: int = WIDTH) -> DataFrame:
    """Rows (item, words) for every window of every item; ``item`` is the id as text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, out = [], []
            for item, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                w = words(value)
                for i in range(max(1, len(w) - width + 1) if w else 0):
                    ids.append(item)
                    out.append(b" ".join(w[i : i + width]))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(out, pa.binary())], names=["item", "words"])

    return items.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")), F.col(text)).mapInArrow(run, "item string, words binary")


def word_counts(docs: DataFrame, vocabulary: set[bytes] | None, text: str = "text") -> DataFrame:
    """Rows (word, n): how often each word, of ``vocabulary`` if it is given, occurs in all documents."""
    known = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        keep = None if known.value is None else known.value.__contains__
        for batch in batches:
            for value in _as_binary(batch.column(0)):
                if value:
                    found = value.translate(FOLD).split()
                    total.update(found if keep is None else filter(keep, found))
            if len(total) > FLUSH:
                yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.binary()), pa.array(list(total.values()), pa.int64())], names=["word", "n"])
                total.clear()
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.binary()), pa.array(list(total.values()), pa.int64())], names=["word", "n"])

    return docs.select(text).mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def prefix_index(windows: list[tuple[bytes, ...]], counts: dict[bytes, int]) -> dict[bytes, list[tuple[int, int, int]]]:
    """Rarest word -> [(position in the window, window length, window number)]."""
    index: dict[bytes, list[tuple[int, int, int]]] = {}
    for n, w in enumerate(windows):
        at = min(range(len(w)), key=lambda i: (counts.get(w[i], 0), w[i], i))
        if all(counts.get(x, 0) for x in w):  # a word that no document has: no match
            index.setdefault(w[at], []).append((at, len(w), n))
    return index


def find_hits(doc: list[bytes], index: dict, windows: list[tuple[bytes, ...]]) -> list[tuple[int, int]]:
    """(start, window number) of every occurrence of a window."""
    out = []
    get, size = index.get, len(doc)
    for i, w in enumerate(doc):
        places = get(w)
        if places is not None:
            for at, length, n in places:
                start = i - at
                if start >= 0 and start + length <= size and tuple(doc[start : start + length]) == windows[n]:
                    out.append((start, n))
    return out


def _scan(docs: DataFrame, block: list[tuple[bytes, tuple[str, ...]]], counts: dict[bytes, int], keep: list[str], text: str) -> DataFrame:
    """keep, n_words, spans (start, end of hit runs) and items for one block of windows."""
    windows = [tuple(w.split(b" ")) for w, _ in block]
    owner = [items for _, items in block]
    model = docs.sparkSession.sparkContext.broadcast((prefix_index(windows, counts), windows, owner))
    rows, place = sent(docs, keep, text)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, wins, items_of = model.value
        for batch in batches:
            n_words, spans, items = [], [], []
            for value in _as_binary(batch.column(place)):
                doc = value.translate(FOLD).split() if value else []
                hits = find_hits(doc, index, wins)
                n_words.append(len(doc))
                runs: list[list[int]] = []
                for start, n in sorted(hits):
                    end = start + len(wins[n])
                    if runs and start <= runs[-1][1]:
                        runs[-1][1] = max(runs[-1][1], end)
                    else:
                        runs.append([start, end])
                spans.append(runs)
                items.append(sorted({x for _, n in hits for x in items_of[n]}))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[: len(keep)], pa.array(n_words, pa.int64()), pa.array(spans, pa.list_(pa.list_(pa.int32()))), pa.array(items, pa.list_(pa.string()))],
                names=[*keep, "n_words", "spans", "items"])

    return rows.mapInArrow(tidy(run), schema + ", n_words long, spans array<array<int>>, items array<string>")


def find_contamination(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text",
                       width: int = WIDTH, sent_windows: int = SENT_WINDOWS, sent_words: int = SENT_WORDS, keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns (the id by default) with n_words, spans of hit words, and the items whose windows occur."""
    keep = keep or [doc_id]
    owned = written(item_windows(items, item_id, item_text, width).distinct(), "item-windows")
    if owned.count() > sent_windows:
        return _joined(docs, owned, keep, text, sent_words)
    block = [(bytes(r["words"]), tuple(r["items"])) for r in owned.groupBy("words").agg(F.array_sort(F.collect_list("item")).alias("items")).collect()]
    vocabulary = {w for win, _ in block for w in win.split(b" ")}
    counts = {bytes(r["word"]): r["n"] for r in word_counts(docs, vocabulary, text).collect()} if block else {}
    return _scan(docs, block, counts, keep, text)


def prefixes(windows: DataFrame, counts: DataFrame) -> DataFrame:
    """Rows (words, word, at, m) for windows of m words that all occur: the rarest word and its place."""
    each = windows.select("words", F.posexplode(F.split(F.col("words").cast("string"), " "))).select("words", F.col("pos").alias("at"), F.col("col").cast("binary").alias("word"))
    known = each.join(counts, "word", "left")
    rarest = known.groupBy("words").agg(F.min(F.struct("n", "word", "at")).alias("r"), F.count(F.lit(1)).cast("int").alias("m"), F.count("n").cast("int").alias("seen"))
    return rarest.where("m = seen").select("words", "r.word", "r.at", "m")


def _places(rows: DataFrame, wanted: set[bytes] | None, width: int) -> DataFrame:
    """Rows (row, place, n_words, word, before, around): places of wanted words, with up to width - 1 words on either side."""
    known = rows.sparkSession.sparkContext.broadcast(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep = known.value
        for batch in batches:
            out: list[list] = [[] for _ in range(6)]
            for row, value in zip(batch.column(0).to_pylist(), _as_binary(batch.column(1))):
                doc = value.translate(FOLD).split() if value else []
                for i, w in enumerate(doc):
                    if keep is None or w in keep:
                        first = max(0, i - width + 1)
                        for column, x in zip(out, (row, i, len(doc), w, i - first, b" ".join(doc[first : i + width]))):
                            column.append(x)
                if len(out[0]) > 50_000:
                    yield _place_batch(out)
                    out = [[] for _ in range(6)]
            yield _place_batch(out)

    return rows.select("row", "text").mapInArrow(run, "row long, place int, n_words int, word binary, before int, around binary")


def _place_batch(out: list[list]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.int32(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds)], names=["row", "place", "n_words", "word", "before", "around"])


def _joined(docs: DataFrame, owned: DataFrame, keep: list[str], text: str, sent_words: int) -> DataFrame:
    """The same for a benchmark of any size, by joins; rows meet by a number that is written once."""
    def sized(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = [len(v.translate(FOLD).split()) if v else 0 for v in _as_binary(batch.column(1))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(n, pa.int64())], names=["kept", "text", "n_words"])

    plain = docs.select(F.struct(*keep).alias("kept"), docs[text].alias("text"))
    rows = plain.mapInArrow(sized, f"kept {plain.schema['kept'].dataType.simpleString()}, text string, n_words long").withColumn("row", F.monotonically_increasing_id())
    rows = written(rows, "numbered-documents")
    first = written(prefixes(owned.select("words").distinct(), word_counts(rows, None)), "prefixes")
    asked = first.select("word").distinct()
    wanted = {bytes(r["word"]) for r in asked.collect()} if asked.count() <= sent_words else None
    width = first.agg(F.max("m")).first()[0] or 1
    places = _places(rows, wanted, width).withColumn("salt", F.pmod(F.xxhash64("row", "place"), F.lit(SALTS)).cast("int"))
    salted = first.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    pairs = places.join(salted, ["word", "salt"]).where("place >= at AND place - at + m <= n_words")
    found = F.array_join(F.slice(F.split(F.col("around").cast("string"), " "), F.col("before") - F.col("at") + 1, F.col("m")), " ")
    hits = written(pairs.where(found == F.col("words").cast("string")).select("row", (F.col("place") - F.col("at")).alias("start"), "m", "words"), "hits")
    spans = hits.select("row", F.array(F.col("start"), F.col("start") + F.col("m")).alias("span")).distinct().groupBy("row").agg(F.collect_list("span").alias("spans"))
    named = hits.select("row", "words").distinct().withColumn("salt", F.pmod("row", F.lit(SALTS)).cast("int"))
    owners = owned.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    listed = named.join(owners, ["words", "salt"]).select("row", "item").distinct().groupBy("row").agg(F.array_sort(F.collect_list("item")).alias("items"))
    out = rows.select("row", "kept", "n_words").join(spans, "row", "left").join(listed, "row", "left")
    none = lambda kind: F.array().cast(kind)
    return out.select("kept.*", "n_words", F.coalesce(_merged(F.col("spans")), none("array<array<int>>")).alias("spans"), F.coalesce("items", none("array<string>")).alias("items"))


def _merged(spans):
    """Overlapping or touching spans joined."""
    step = lambda acc, s: F.when(
        (F.size(acc) > 0) & (F.element_at(acc, -1)[1] >= s[0]),
        F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.array(F.element_at(acc, -1)[0], F.greatest(F.element_at(acc, -1)[1], s[1]))))
    ).otherwise(F.concat(acc, F.array(s)))
    return F.aggregate(F.array_sort(spans), F.array().cast("array<array<int>>"), step)


def summarised(found: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s[1] - s[0])
    return found.select(doc_id, "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (hit > 0).alias("contaminated"))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summarised(find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


ORACLE = r"""
WITH dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
iw AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, array_to_string(w[i:i + 9], ' ') AS k, least(len(w), 10) AS m
        FROM (SELECT item_id, w, unnest(range(1, greatest(2, len(w) - 8))) AS i FROM iw WHERE len(w) > 0)),
m AS (SELECT DISTINCT m FROM win),
dwin AS (SELECT doc_id, i, mm AS m, array_to_string(w[i:i + mm - 1], ' ') AS k
         FROM (SELECT doc_id, w, m.m AS mm, unnest(range(1, len(w) - m.m + 2)) AS i FROM dw, m WHERE len(w) >= m.m)),
hit AS (SELECT d.doc_id, d.i, d.m, win.item_id FROM dwin d JOIN win ON d.k = win.k AND d.m = win.m),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS p FROM hit) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS s FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS s FROM hit) GROUP BY doc_id)
SELECT dw.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(its.s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)
"""
