"""Field-weighted BM25 over documents, for any number of queries in one job.

An index is written once: postings in buckets by document, the frequency of every
term, and the corpus statistics, which always cover all documents.  A bucket holds a bounded
number of documents with all their terms, so common terms don't gather in one task.

A search writes the terms it asks for, whose size is then known: while they are small
enough for Spark to broadcast, neither postings nor vocabulary are shuffled, and hits are
summed up and ranked in the bucket of their document; only the best are exchanged.

``MutableIndex`` keeps segments of postings under a folder and takes batches of
additions, replacements and removals.
"""
from __future__ import annotations

import json
import uuid
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palimpsest.functions import scoring, text
from palimpsest.sources.shared import shared_path, written

RAREST = 25
BUCKET = 8192


def weighted_tokens(fields: dict[str, float | Column], tokens=text.tokens) -> Column:
    """Array of (term, w) over the fields of a document."""
    def part(name: str, weight: float | Column) -> Column:
        w = weight if isinstance(weight, Column) else F.lit(float(weight))
        return F.transform(tokens(F.col(name)), lambda t: F.struct(t.alias("term"), w.cast("double").alias("w")))

    return F.concat(*[part(name, weight) for name, weight in fields.items()])


def title_weight(title: str, narrative: str, weight: float = 3.0) -> Column:
    """A title that the narrative opens with counts as body."""
    return F.when(F.startswith(F.coalesce(F.col(narrative), F.lit("")), F.coalesce(F.col(title), F.lit(""))), 1.0).otherwise(weight)


@dataclass(frozen=True)
class Index:
    """Postings (doc_id, len, term, tf, hits), vocabulary (term, df, stem), number of documents and their average length."""

    postings: DataFrame
    vocabulary: DataFrame
    n: int
    average: float | None

    @property
    def frequency(self) -> DataFrame:
        return self.vocabulary.select("term", "df")


def width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def postings(docs: DataFrame, doc_id: str, fields: dict[str, float | Column], dates: str | None = None, cjk: bool = False, parts: int | None = None) -> DataFrame:
    """(doc_id, len, term, tf, hits): weights scale tf only, len and hits count tokens.

    Documents are dealt before they are cut into tokens, so one exchange of whole texts serves the counts; with ``parts``
    into that many.  ``explode_outer`` keeps Spark from testing for tokens, and so cutting every text, before the exchange as well.
    With ``dates``, the terms of a document's day are added with tf 1 and no hits; ``cjk`` cuts runs of
    Han, Kana and Hangul into pairs.
    """
    names = list(dict.fromkeys([*fields, *([dates] if dates else [])]))
    weights = {f"_w{i}": w for i, w in enumerate(fields.values()) if isinstance(w, Column)}
    rows = docs.select(F.col(doc_id).alias("_id"), *[F.col(c) for c in names], *[w.alias(c) for c, w in weights.items()])
    rows = rows.repartition(parts or width(docs.sparkSession), "_id")
    dealt = {name: F.col(f"_w{i}") if isinstance(w, Column) else w for i, (name, w) in enumerate(fields.items())}
    tokens = weighted_tokens(dealt, text.cjk_tokens if cjk else text.tokens)
    all_terms = F.transform(tokens, lambda t: F.struct(t.term.alias("term"), t.w.alias("w"), F.lit(1).alias("hit")))
    if dates:
        days = F.transform(text.date_terms(F.col(dates)), lambda t: F.struct(t.alias("term"), F.lit(1.0).alias("w"), F.lit(0).alias("hit")))
        all_terms = F.concat(all_terms, days)
    rows = rows.select(F.col("_id").alias("doc_id"), all_terms.alias("t"))
    rows = rows.select("doc_id", F.size(F.filter("t", lambda t: t.hit == 1)).alias("len") if dates else F.size("t").alias("len"), F.explode_outer("t").alias("t")).where("t IS NOT NULL")
    return rows.groupBy("doc_id", "len", F.col("t.term").alias("term")).agg(F.sum("t.w").alias("tf"), F.sum(F.col("t.hit").cast("long")).alias("hits"))


def buckets(spark: SparkSession, n: int) -> int:
    """Buckets for n documents: a bounded number of documents each, and work for every core."""
    return max(width(spark), -(-n // BUCKET))


def bucketed(posts: DataFrame, name: str, parts: int) -> DataFrame:
    """Postings written in buckets by document, so what is summed up for a document meets without an exchange."""
    table = f"{name}_{uuid.uuid4().hex}".replace("-", "_")
    path = shared_path(posts.sparkSession, name)
    posts.write.bucketBy(parts, "doc_id").option("path", path).format("parquet").saveAsTable(table)
    return posts.sparkSession.table(table)


def document_frequency(posts: DataFrame) -> DataFrame:
    return posts.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def term_frequency(docs: DataFrame, doc_id: str = "doc_id", column: str = "text") -> DataFrame:
    """(term, df) of documents as ``build_index`` has it, without an index: each term is counted once a document before it is dealt.

    Rows that share an id are one document if they have as many tokens, as in the postings.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(column).alias("text"))
    twice = written(rows.groupBy(F.col("doc_id").alias("_id")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("_id"), "repeated-ids")
    same, tokens = rows["doc_id"].eqNullSafe(twice["_id"]), text.tokens(F.col("text"))
    once = rows.join(twice, same, "left_anti").select(F.explode(F.array_distinct(tokens)).alias("term"))
    more = rows.join(twice, same, "left_semi").select("doc_id", F.size(tokens).alias("len"), F.explode(tokens).alias("term")).distinct().select("term")
    return document_frequency(once.unionByName(more))


def vocabulary(frequency: DataFrame) -> DataFrame:
    """(term, df, stem): the stemmer sees every distinct word once, and none where stems are not asked for."""
    return frequency.select("term", "df", text.stem_column(F.col("term")).alias("stem"))


def build_index(docs: DataFrame, doc_id: str = "doc_id", fields: dict[str, float | Column] | None = None, dates: str | None = None, cjk: bool = False) -> Index:
    """Writes the index of all documents."""
    n = docs.count()
    parts = buckets(docs.sparkSession, n)
    posts = bucketed(postings(docs, doc_id, fields or {"text": 1.0}, dates, cjk, parts), "postings", parts)
    total = posts.agg(F.sum("hits")).first()[0] or 0
    return Index(posts, vocabulary(written(document_frequency(posts), "vocabulary")), n, total / n if n else None)


def query_terms(queries: DataFrame, query_id: str, query: str, cjk: bool = False) -> DataFrame:
    """(query_id, term, w) with stop words gone."""
    terms = F.array_distinct(text.without_stop_words((text.cjk_tokens if cjk else text.tokens)(F.col(query))))
    return queries.select(F.col(query_id).alias("query_id"), F.explode(terms).alias("term"), F.lit(1.0).alias("w"))


def known(terms: DataFrame, frequency: DataFrame) -> DataFrame:
    """(term, df) of the terms asked for that the vocabulary has, written."""
    return written(frequency.select("term", "df").join(terms.select("term").distinct(), "term", "left_semi"), "known-terms")


def rarest(terms: DataFrame, frequency: DataFrame, most: int = RAREST) -> DataFrame:
    """The rarest terms of each query, unseen terms last."""
    order = Window.partitionBy("query_id").orderBy(F.col("df").asc_nulls_last(), "term")
    ranked = terms.join(known(terms, frequency), "term", "left").withColumn("_r", F.row_number().over(order))
    return ranked.where(F.col("_r") <= most).select("query_id", "term", "w", "df")


def prefix_expansions(terms: DataFrame, frequency: DataFrame) -> DataFrame:
    """(query_term, term, df): vocabulary that strictly extends a term asked for.

    The vocabulary lists its own proper prefixes, so this is an equi-join.
    """
    longer = frequency.where(F.char_length("term") > 2).select("term", "df", F.explode(F.transform(
        F.sequence(F.lit(2), F.char_length("term") - 1), lambda n: F.left(F.col("term"), n))).alias("query_term"))
    return longer.join(terms.select(F.col("term").alias("query_term")).distinct(), "query_term")


def search(index: Index | DataFrame, queries: DataFrame, k: int | None = 20, doc_id: str = "doc_id", fields: dict[str, float | Column] | None = None,
           query_id: str = "query_id", query: str = "text", prefix: bool = False, extra_terms: DataFrame | None = None, dates: bool = False, cjk: bool = False) -> DataFrame:
    """(query_id, doc_id, score): the best k documents of each query, by score to 6 places, then id.

    ``index`` may also be a table of documents, whose ``fields`` are indexed first.
    ``extra_terms`` (query_id, term, w) adds weighted terms such as synonyms;
    ``dates`` those of the dates that a query names.  Documents without a token are counted in the statistics and never
    found; queries without a term find nothing.
    """
    index = index if isinstance(index, Index) else build_index(index, doc_id, fields)
    n, average = F.lit(index.n), F.lit(index.average)
    asked = written(rarest(written(query_terms(queries, query_id, query, cjk), "query-terms"), index.frequency), "asked-terms")
    weighted = asked.select("query_id", "term", "w", "df").where("df IS NOT NULL")
    extra = [extra_terms.select("query_id", "term", "w")] if extra_terms is not None else []
    if dates:
        extra.append(queries.select(F.col(query_id).alias("query_id"), F.explode(text.query_date_terms(F.col(query))).alias("term"), F.lit(1.0).alias("w")))
    if extra:
        more = written(reduce(DataFrame.unionByName, extra), "extra-terms")
        more = more.join(known(more, index.frequency), "term").select("query_id", "term", "w", "df")
        weighted = written(weighted.unionByName(more).groupBy("query_id", "term", "df").agg(F.max("w").alias("w")), "weighted-terms")
    found = index.postings.join(weighted, "term").withColumn("score", scoring.bm25(F.col("tf"), F.col("len"), F.col("df"), n, average) * F.col("w"))
    found = found.groupBy("query_id", "doc_id").agg(F.sum("score").alias("score"))
    if prefix:
        # what extends a term is scored once a document, however many queries ask for the term
        longer = written(prefix_expansions(asked, index.frequency), "prefix-terms")
        hits = index.postings.join(longer, "term").withColumn("score", scoring.bm25(F.col("tf"), F.col("len"), F.col("df"), n, average))
        best = hits.groupBy("doc_id", "query_term").agg(F.max("score").alias("score"))
        best = best.join(asked.select("query_id", F.col("term").alias("query_term"), "w"), "query_term")
        found = found.unionByName(best.select("query_id", "doc_id", (0.5 * F.col("score") * F.col("w")).alias("score"))).groupBy("query_id", "doc_id").agg(F.sum("score").alias("score"))
    return top(found.withColumn("score", F.round("score", 6)), k)


def top(hits: DataFrame, k: int | None, by: str = "score", key: str = "query_id", tie: str = "doc_id") -> DataFrame:
    """The best k rows of each key; Spark drops rows beyond k in each task before it shuffles."""
    if k is None:
        return hits
    order = Window.partitionBy(key).orderBy(F.col(by).desc(), F.col(tie))
    return hits.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= k).drop("_r")


def stemmed_search(index: Index | DataFrame, queries: DataFrame, k: int = 20, doc_id: str = "doc_id", column: str = "text",
                   query_id: str = "query_id", query: str = "text", synonym_weight: float = 0.7) -> DataFrame:
    """As ``search`` over stems, where synonyms of a query term count 0.7.

    Only the words of the vocabulary that have an asked stem are looked up in the postings.
    """
    spark = queries.sparkSession
    index = index if isinstance(index, Index) else build_index(index, doc_id, {column: 1.0})
    wanted = written(query_terms(queries, query_id, query).select("query_id", text.stem_column(F.col("term")).alias("term"), "w").distinct(), "query-stems")
    pairs = spark.createDataFrame(text.synonym_pairs(), "term string, other string")
    stems = wanted.select("term").unionByName(wanted.join(pairs, "term").select(F.col("other").alias("term"))).distinct().withColumnRenamed("term", "stem")
    words = written(index.vocabulary.select("term", "stem").join(written(stems, "stems"), "stem"), "words-of-stems")
    posts = index.postings.join(words, "term").groupBy("doc_id", "len", "stem").agg(F.sum("tf").alias("tf")).withColumnRenamed("stem", "term")
    posts = bucketed(posts, "stem-postings", buckets(spark, index.n))
    frequency = written(document_frequency(posts), "stem-frequency")
    asked = rarest(wanted, frequency).select("query_id", "term", "w")
    alike = asked.join(pairs, "term").select("query_id", F.col("other").alias("term"), F.lit(synonym_weight).alias("w"))
    weighted = asked.unionByName(alike).groupBy("query_id", "term").agg(F.max("w").alias("w"))
    weighted = written(weighted.join(known(weighted, frequency), "term"), "weighted-stems")
    hits = posts.join(weighted, "term").withColumn("score", scoring.bm25(F.col("tf"), F.col("len"), F.col("df"), F.lit(index.n), F.lit(index.average)) * F.col("w"))
    return top(hits.groupBy("query_id", "doc_id").agg(F.round(F.sum("score"), 6).alias("score")), k)


# ---------------------------------------------------------------- an index that changes


class MutableIndex:
    """An index of segments under a folder: batches of documents are added, replaced and removed.

    Every batch is a segment (documents with their terms, postings, vocabulary).  A batch that
    names documents of older segments records them as dead there, with their terms, so
    frequencies stay exact without a look at the postings.  Segments of a level merge into one of
    the next as soon as there are ``fanout``, and a segment goes through a merge of its own when half of its documents are
    dead; both drop what is dead.  A version is a manifest, written last, so a change that fails
    leaves the version before it.  One writer at a time.

    Rows without an id are left out; of rows of a batch with one id, that which sorts last by its
    fields stays.  Search results equal those of an index built from the live documents.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, fields: dict[str, float] | None = None, fanout: int = 4):
        self.spark, self.path, self.fields, self.fanout = spark, path or shared_path(spark, "index"), fields or {"text": 1.0}, fanout
        self.version, self.segments, self.dead = 0, [], []

    @classmethod
    def restore(cls, spark: SparkSession, path: str) -> MutableIndex:
        """The last version under a folder."""
        newest = spark.read.text(f"{path}/manifest").orderBy(F.col("version").desc()).first()
        held = json.loads(newest["value"])
        index = cls(spark, path, held["fields"], held["fanout"])
        index.version, index.segments, index.dead = held["version"], held["segments"], held["dead"]
        return index

    def _commit(self) -> None:
        live = {s["id"] for s in self.segments}
        self.dead = [d for d in self.dead if live & set(d["of"])]
        self.version += 1
        state = {"version": self.version, "segments": self.segments, "dead": self.dead, "fields": self.fields, "fanout": self.fanout}
        self.spark.createDataFrame([(json.dumps(state),)], "value string").coalesce(1).write.text(f"{self.path}/manifest/version={self.version}")

    def _number(self) -> str:
        """A new name for files of the next version."""
        return f"{self.version + 1}-{uuid.uuid4().hex[:8]}"

    def _read(self, segment: dict, part: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{part}-{segment['id']}")

    def _dead(self) -> DataFrame | None:
        """(segment, doc_id, len, terms) of dead documents of live segments."""
        return self._gone("dead")

    def _gone(self, part: str = "gone") -> DataFrame | None:
        """(segment, doc_id, ...) of dead documents of live segments; without their terms, so that Spark knows how small it is."""
        ids = [s["id"] for s in self.segments]
        parts = [self.spark.read.parquet(f"{self.path}/{part}-{d['id']}") for d in self.dead]
        return reduce(DataFrame.unionByName, parts).where(F.col("segment").isin(ids)) if parts else None

    def _live(self, part: str, segments: list[dict] | None = None) -> DataFrame:
        """(segment, ...) of all segments, or some, without what belongs to dead documents."""
        rows = reduce(DataFrame.unionByName, [self._read(s, part).withColumn("segment", F.lit(s["id"])) for s in segments or self.segments])
        dead = self._gone()
        return rows if dead is None else rows.join(dead, ["segment", "doc_id"], "left_anti")

    def _retire(self, ids: DataFrame) -> None:
        """Records the live documents of a list of ids as dead in their segments."""
        if not self.segments:
            return
        number = self._number()
        self._live("documents").select("segment", "doc_id").join(ids.select("doc_id"), "doc_id", "left_semi").select("segment", "doc_id").write.parquet(f"{self.path}/gone-{number}")
        found = self._live("documents").join(self.spark.read.parquet(f"{self.path}/gone-{number}"), ["segment", "doc_id"], "left_semi")
        found.select("segment", "doc_id", "len", "terms").write.parquet(f"{self.path}/dead-{number}")
        gone = {r["segment"]: r for r in self.spark.read.parquet(f"{self.path}/dead-{number}").groupBy("segment").agg(F.count(F.lit(1)).alias("n"), F.sum("len").alias("len")).collect()}
        if gone:
            self.segments = [s | {"n": s["n"] - gone[s["id"]]["n"], "len": s["len"] - gone[s["id"]]["len"]} if s["id"] in gone else s for s in self.segments]
            self.dead = [*self.dead, {"id": number, "of": list(gone)}]

    def _segment(self, posts: DataFrame, docs: DataFrame, frequency: DataFrame | None, level: int) -> dict:
        """Writes postings, documents (doc_id, len, terms) and frequencies (term, df) of a segment; without ``frequency`` those of the documents."""
        number = self._number()
        posts.write.parquet(f"{self.path}/postings-{number}")
        docs.write.parquet(f"{self.path}/documents-{number}")
        docs = self.spark.read.parquet(f"{self.path}/documents-{number}")
        frequency = document_frequency(docs.select(F.explode("terms").alias("term"))) if frequency is None else frequency
        frequency.write.parquet(f"{self.path}/vocabulary-{number}")
        n, length = docs.agg(F.count(F.lit(1)), F.sum("len")).first()
        return {"id": number, "level": level, "n": n, "all": n, "len": length or 0}

    def _frequency(self, segments: list[dict]) -> DataFrame:
        """(term, df) of the live documents of segments: what the segments hold less what is dead in them."""
        df = reduce(DataFrame.unionByName, [self._read(s, "vocabulary") for s in segments])
        dead = self._dead()
        if dead is not None:
            gone = dead.where(F.col("segment").isin([s["id"] for s in segments])).select(F.explode("terms").alias("term"), F.lit(-1).cast("long").alias("df"))
            df = df.unionByName(gone)
        return df if len(segments) == 1 and dead is None else df.groupBy("term").agg(F.sum("df").alias("df")).where("df > 0")

    def add(self, docs: DataFrame, doc_id: str = "doc_id") -> None:
        """Adds documents, or puts them in the place of those with their ids."""
        names = list(self.fields)
        one = docs.where(F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("doc_id")).agg(F.max(F.struct(*names)).alias("_v"))
        batch = written(one.select("doc_id", "_v.*"), "batch")
        self._retire(batch)
        tokens = batch.select("doc_id", weighted_tokens(self.fields).alias("t"))
        terms = tokens.select("doc_id", F.size("t").cast("long").alias("len"), F.array_distinct(F.col("t.term")).alias("terms"))
        self.segments = [*self.segments, self._segment(postings(batch, "doc_id", self.fields), terms, None, 0)]
        self._merge()
        self._commit()

    def remove(self, ids: DataFrame, doc_id: str = "doc_id") -> None:
        """Removes documents; ids that are not there change nothing."""
        self._retire(ids.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).alias("doc_id")).distinct())
        self._merge()
        self._commit()

    def clear(self) -> None:
        self.segments, self.dead = [], []
        self._commit()

    def _merge(self) -> None:
        while True:
            levels = sorted({s["level"] for s in self.segments})
            full = next((x for x in ([s for s in self.segments if s["level"] == level] for level in levels) if len(x) >= self.fanout), None)
            worn = next(([s] for s in self.segments if 2 * s["n"] < s["all"]), None)
            some = full or worn
            if some is None:
                return
            rest = [s for s in self.segments if s not in some]
            if any(s["n"] for s in some):
                rest.append(self._segment(self._live("postings", some).drop("segment"), self._live("documents", some).drop("segment"), self._frequency(some), max(s["level"] for s in some) + (1 if full else 0)))
            self.segments = rest

    def index(self) -> Index:
        """The live documents as an index to search."""
        if not self.segments:
            none = self.spark.createDataFrame([], "doc_id long, len int, term string, tf double, hits long")
            return Index(none, vocabulary(document_frequency(none)), 0, None)
        n = sum(s["n"] for s in self.segments)
        return Index(self._live("postings").drop("segment"), vocabulary(self._frequency(self.segments)), n, sum(s["len"] for s in self.segments) / n if n else None)

    def documents(self) -> DataFrame:
        """(doc_id, len) of the live documents."""
        if not self.segments:
            return self.spark.createDataFrame([], "doc_id long, len long")
        return self._live("documents").select("doc_id", "len")
