"""Benchmark decontamination with a distributed positional inverted index, in DataFrame functions only.

Words are runs of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]`` after lower-casing A-Z. Every item is cut into windows of 13 consecutive
words (an item of fewer words is one window).

1. The words of every document are stored once, so that rows keep their numbers, and every token is counted against the terms of the
   windows. Each window orders its terms from the rarest to the most frequent.
2. The lists of the terms that stand among the rarest of any window are stored: a posting is (row, pos, term). An index shard is a
   slice of documents; a frequent term is dealt over all of them.
3. A window starts from the list of its rarest term; the next lists, each moved by its offset, are intersected with what is left, one
   after the other, by joins on (row, pos, term), which no frequent term can skew.
4. The few places left are compared with the stored words, exactly.

Proximity searches meet the same lists within a distance. Lists, windows and candidates are broadcast only up to a counted bound; beyond
it joins shuffle them.

Nulls and empty texts have no words. Items without an id mark words as hit but are not counted. Repeated rows are judged row by
row, equal windows of several items count for each of them. Empty tables give empty results or documents without hits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidespan.llm.scratch import Scratch, aside

#: Words before lower-casing: what becomes a word once A-Z are lower-cased.
TOKEN = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WINDOW = 13
#: Lists of a window that are intersected before what is left is compared with the words.
LISTS = 4
#: Rows up to which windows (some 200 bytes each) or terms are broadcast.
BROADCAST_ROWS = 200_000


def tokens(text: F.Column) -> F.Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN), F.lit(0))


def ascii_lower(text: F.Column) -> F.Column:
    return F.translate(text, UPPER, LOWER)


def _sized(df: DataFrame, n: int) -> DataFrame:
    return F.broadcast(df) if n <= BROADCAST_ROWS else df


def windows_of(items: DataFrame, width: int = WINDOW) -> DataFrame:
    """item_id (string) and terms, the words of each of its windows."""
    words = items.select(F.col("item_id").cast("string").alias("item_id"), tokens(ascii_lower(F.col("text"))).alias("w")).filter("size(w) > 0")
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - (width - 1), F.lit(1)))
    return words.select("item_id", "w", F.explode(starts).alias("s")).select("item_id", F.expr(f"slice(w, s, least({width}, size(w)))").alias("terms")).distinct()


class Index:
    """Words of all documents, and stored positional lists of the terms that are among the ``lists`` rarest of a query phrase.

    Terms are compared by ``lower``, a coarser key than the lower-casing of A-Z; what is left is compared exactly afterwards.
    """

    def __init__(self, docs: DataFrame, phrases: DataFrame, scratch: Scratch, lists: int = LISTS):
        """phrases: item_id (string), terms (array)."""
        self.scratch, self.lists = scratch, lists
        self.words = scratch.keep(docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", tokens(F.col("text")).alias("w")), "words")
        phrases = scratch.keep(phrases.select("item_id", "terms"), "phrases")
        self.phrases = scratch.keep(phrases.select("terms").distinct().select(F.monotonically_increasing_id().alias("phrase"), "terms", F.size("terms").alias("n")), "distinct")
        self.n_phrases = self.phrases.count()
        self.items = scratch.keep(phrases.join(self.phrases.select("phrase", "terms"), "terms").select("phrase", "item_id"), "items")
        self.steps = self._steps()
        self.postings = scratch.keep(self._postings(), "postings")

    def term_counts(self) -> DataFrame:
        """term, times: over every token of every document."""
        terms = self.scratch.keep(self.phrases.select(F.explode("terms").alias("t")).select(F.lower("t").alias("term")).distinct(), "terms")
        seen = self.words.select(F.explode("w").alias("t")).select(F.lower("t").alias("term"))
        return seen.join(_sized(terms, terms.count()), "term").groupBy("term").agg(F.count("*").alias("times"))

    def _steps(self) -> DataFrame:
        """phrase and steps: (times, offset, term) of its rarest terms, the rarest first. Phrases with a term that never occurs are left out."""
        counts = self.scratch.keep(self.term_counts(), "counts")
        each = self.phrases.select("phrase", F.posexplode("terms").alias("offset", "t")).select("phrase", "offset", F.lower("t").alias("term"))
        steps = each.join(counts, "term", "left").groupBy("phrase").agg(F.min(F.coalesce("times", F.lit(0))).alias("least"), F.slice(F.array_sort(F.collect_list(F.struct("times", "offset", "term"))), 1, self.lists).alias("steps"))
        return self.scratch.keep(steps.filter("least > 0").select("phrase", "steps"), "steps")

    def _terms(self, of: str) -> DataFrame:
        terms = self.scratch.keep(self.steps.select(F.expr(f"explode({of})").alias("s")).select("s.term").distinct(), "listed")
        return _sized(terms, terms.count())

    def _postings(self) -> DataFrame:
        """(row, pos, term) of every place of a listed term."""
        return self.words.select("row", F.posexplode("w").alias("pos", "t")).select("row", "pos", F.lower("t").alias("term")).join(self._terms("steps"), "term").select("row", "pos", "term")

    def places(self, reach: int = 0) -> DataFrame:
        """(row, pos, phrase): where the lists of a phrase meet. pos is the place of its first word, or, within ``reach`` words in any order, of its rarest."""
        first = self.steps.select("phrase", F.col("steps")[0]["term"].alias("term"), (F.lit(0) if reach else F.col("steps")[0]["offset"]).alias("offset"))
        left = self.postings.join(_sized(first, self.n_phrases), "term").select("row", (F.col("pos") - F.col("offset")).alias("pos"), "phrase").filter("pos >= 0")
        left = self.scratch.keep(left, "places")
        for i in range(1, self.lists):
            step = self.steps.select("phrase", F.expr(f"get(steps, {i}) as step"))
            wanted = left.join(_sized(step, self.n_phrases), "phrase").select("row", "pos", "phrase", "step.offset", "step.term")
            lists = self.postings.join(self._terms(f"slice(steps, {i + 1}, 1)"), "term", "left_semi")
            if reach:  # postings within reach lie in the same stretch of that many words or in one beside it
                wanted = wanted.withColumn("stretch", F.explode(F.array(*(F.floor(F.col("pos") / reach) + k for k in (-1, 0, 1)))))
                lists = lists.select("row", "term", F.col("pos").alias("other"), F.floor(F.col("pos") / reach).alias("stretch"))
                met = lists.join(_sized(wanted.filter("term is not null"), 3 * left.count()), ["row", "term", "stretch"]).filter(F.abs(F.col("other") - F.col("pos")) < reach)
            else:
                wanted = wanted.withColumn("start", F.col("pos")).withColumn("pos", F.col("start") + F.col("offset"))
                met = lists.join(_sized(wanted.filter("term is not null"), left.count()), ["row", "pos", "term"]).drop("pos").withColumnRenamed("start", "pos")
                wanted = wanted.drop("pos").withColumnRenamed("start", "pos")
            met = met.select("row", "pos", "phrase").distinct()
            short = wanted.filter("term is null").select("row", "pos", "phrase").distinct()  # phrases without further terms
            left, before = self.scratch.keep(met.union(short), "places"), left
            self.scratch.drop(before)
        return left

    def beside(self, places: DataFrame) -> DataFrame:
        """places with the words of their documents (w) and of their phrases (terms, n)."""
        return self.words.select("row", "doc_id", "w").join(_sized(places, places.count()), "row").join(_sized(self.phrases, self.n_phrases), "phrase")

    def matches(self) -> DataFrame:
        """Exact phrase matches: row, doc_id, start, n, phrase."""
        at = F.expr("slice(w, cast(pos + 1 as int), n)")
        same = F.transform(at, lambda x: ascii_lower(x)) == F.col("terms")
        return self.beside(self.places()).filter(same).select("row", "doc_id", F.col("pos").alias("start"), "n", "phrase")


def exact_matches(docs: DataFrame, phrases: DataFrame) -> DataFrame:
    """phrases: item_id, terms (lower-cased words) -> doc_id, start (words from 0), n and item_id of every place where a phrase stands."""
    index = Index(docs, phrases, Scratch(docs.sparkSession, "phrases"))
    return index.matches().join(index.items, "phrase").select("doc_id", "start", "n", "item_id")


def proximity_matches(docs: DataFrame, phrases: DataFrame, span: int) -> DataFrame:
    """doc_id and item_id where all terms of a phrase stand, in any order, within ``span`` consecutive words."""
    index = Index(docs, phrases, Scratch(docs.sparkSession, "proximity"))
    around = F.expr(f"transform(slice(w, cast(greatest(pos - {span - 1}, 0) + 1 as int), cast(least(pos, {span - 1}) as int) + {span}), x -> translate(x, '{UPPER}', '{LOWER}'))")
    inside = F.expr(f"exists(sequence(0, cast(least(pos, {span - 1}) as int)), s -> forall(terms, t -> array_contains(slice(around, s + 1, {span}), t)))")
    return index.beside(index.places(span)).withColumn("around", around).filter(inside).join(index.items, "phrase").select("row", "doc_id", "item_id").distinct().select("doc_id", "item_id")


def contamination(docs: DataFrame, items: DataFrame, percent: int = 5) -> DataFrame:
    """One row per document: row, doc_id, n_words, n_hit, n_items, items_sha256, contaminated (hit words are ``percent`` of all or more)."""
    index = Index(docs, windows_of(items), Scratch(docs.sparkSession, "decontaminate"))
    found = index.scratch.keep(index.matches().select("row", "start", "n", "phrase"), "matches")
    named = found.select("row", "phrase").distinct().join(_sized(index.items, index.items.count()), "phrase").filter("item_id is not null").select("row", "item_id").distinct()
    named = named.groupBy("row").agg(F.sort_array(F.collect_list("item_id")).alias("ids"))
    hits = found.groupBy("row").agg(F.collect_set(F.struct("start", "n")).alias("spans")).join(named, "row", "left").select(
        "row", "ids",
        F.expr("aggregate(array_sort(spans), named_struct('end', 0L, 'hit', 0L), (a, x) -> named_struct('end', greatest(a.end, x.start + x.n), 'hit', a.hit + greatest(0L, x.start + x.n - greatest(a.end, x.start))), a -> a.hit)").alias("hit"),
    )
    rows = index.words.select("row", "doc_id", F.size("w").alias("n_words"))
    n_hit, ids = F.coalesce("hit", F.lit(0)), F.coalesce("ids", F.array().cast("array<string>"))
    return rows.join(hits, "row", "left").select(
        "row", "doc_id", F.col("n_words").cast("long").alias("n_words"), n_hit.cast("long").alias("n_hit"), F.size(ids).cast("long").alias("n_items"),
        F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"), ((n_hit > 0) & (100 * n_hit >= percent * F.col("n_words"))).alias("contaminated"),
    )


def decontaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The documents that are not contaminated, with the columns they came with. Rows are told apart by id and text."""
    docs, back = aside(docs)
    keyed = docs.withColumn("_text_key", F.xxhash64("text")).withColumn("_id_key", F.xxhash64("doc_id"))
    found = contamination(docs.select(F.struct("doc_id", F.xxhash64("text").alias("t")).alias("doc_id"), "text"), items)
    scratch = Scratch(docs.sparkSession, "contaminated")
    bad = scratch.keep(found.filter("contaminated").select(F.xxhash64("doc_id.doc_id").alias("_id_key"), F.col("doc_id.t").alias("_text_key")).distinct(), "bad")
    return keyed.join(_sized(bad, bad.count()), ["_id_key", "_text_key"], "left_anti").select(*docs.columns).withColumnsRenamed(back)
