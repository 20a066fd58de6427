"""Postings, ranked search, snippets and verbatim quotes."""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

GRAM, CHAR_GRAM = 4, 3
SNIPPET_RADIUS = 160
TITLE_WEIGHT, BODY_WEIGHT = 1.0, 0.4
#: Digits to which scores rank: ln 4 + ln 2 and ln 8 are a tie, which the newer document wins.
TIED_DIGITS = 10


# English words that a full-text query leaves out.
QUERY_STOPWORDS = (
    "i", "me", "my", "myself", "we", "our", "ours", "ourselves", "you", "your", "yours", "yourself", "yourselves", "he", "him", "his", "himself",
    "she", "her", "hers", "herself", "it", "its", "itself", "they", "them", "their", "theirs", "themselves", "what", "which", "who", "whom",
    "this", "that", "these", "those", "am", "is", "are", "was", "were", "be", "been", "being", "have", "has", "had", "having", "do", "does",
    "did", "doing", "a", "an", "the", "and", "but", "if", "or", "because", "as", "until", "while", "of", "at", "by", "for", "with", "about",
    "against", "between", "into", "through", "during", "before", "after", "above", "below", "to", "from", "up", "down", "in", "out", "on",
    "off", "over", "under", "again", "further", "then", "once", "here", "there", "when", "where", "why", "how", "all", "any", "both", "each",
    "few", "more", "most", "other", "some", "such", "no", "nor", "not", "only", "own", "same", "so", "than", "too", "very", "s", "t", "can",
    "will", "just", "don", "should", "now")
# Endings and what they become, in turn: plurals, participles behind a vowel, a last e. All forms of a word end alike.
ENDINGS = (("^(.{2,})ies$", "{1}y"), ("(ss|x|ch|sh|zz)es$", "{1}"), ("([^siu])s$", "{1}"), ("^(.*[aeiouy].+)(ing|ed)$", "{1}"), ("^(.{2,})e$", "{1}"))
INDEX_BUCKETS = 256


#: Forms a task remembers, and words it groups before it hands their postings on.
KNOWN_FORMS, HELD_WORDS = 1 << 18, 500_000


def stem(term: str) -> str:
    """One form for a word's singular, plural, participles and gerund."""
    for pattern, put in ENDINGS:
        term = f"regexp_replace({term}, '{pattern}', '{put.replace('{1}', '$1')}')"
    return term


@lru_cache(KNOWN_FORMS)
def form(word: str) -> str:
    """What `stem` says, of one word."""
    if word[-1:] not in "sedg":  # what every ending of ENDINGS ends in
        return word
    for pattern, put in ENDINGS:
        word = re.sub(pattern, put.replace("{1}", r"\1"), word)
    return word


def _by_term(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of (doc_id, entity, subtype, field, words) as rows of a term each, with its places among the words."""
    for batch in batches:
        rows, terms, places, begun = [], [], [], [0]
        last = batch.num_rows - 1
        for row, words in enumerate(batch.column("words")):
            met = defaultdict(list)
            for at, word in enumerate((words.as_py() or "").split()):
                met[form(word)].append(at)
            met.pop("", None)
            for term, found in met.items():
                places += found
                begun.append(len(places))
            terms += met
            rows += [row] * len(met)
            if len(places) >= HELD_WORDS or row == last:
                of = batch.select(["doc_id", "entity", "subtype", "field"]).take(pa.array(rows, pa.int64()))
                ends = np.asarray(begun, "int32")
                yield pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), *of.columns, pa.array(np.diff(ends).astype("int64")),
                                                  pa.ListArray.from_arrays(pa.array(ends), pa.array(places, pa.int32()))], ["term", *of.schema.names, "tf", "positions"])
                rows, terms, places, begun = [], [], [], [0]


def postings(docs: DataFrame, title: str, body: str) -> DataFrame:
    """(term, doc_id, field, tf, positions): the inverted index as a table; positions count words from 0.

    A document's words are grouped where it lies: neither words nor texts move, and a form is looked for once a task.
    """
    word = r"array_join(regexp_extract_all(lower(%s), '[\\p{L}\\p{N}]+', 0), ' ')"
    d = docs.selectExpr("doc_id", "entity", "subtype", f"inline(array(struct('A' AS field, {word % title} AS words), struct('B' AS field, {word % body} AS words)))")
    kept = T.StructType([f for f in d.schema.fields if f.name != "words"])
    schema = T.StructType([T.StructField("term", T.StringType()), *kept.fields, T.StructField("tf", T.LongType()), T.StructField("positions", T.ArrayType(T.IntegerType()))])
    return d.mapInArrow(_by_term, schema)


def write_postings(index: DataFrame, path: str) -> None:
    """Stores the index by term, so that a query opens the buckets of its own terms only."""
    index.withColumn("bucket", F.expr(f"int(pmod(xxhash64(term), {INDEX_BUCKETS}))")).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(path)


def read_postings(spark: SparkSession, path: str, query: str) -> DataFrame:
    """The stored postings of a query's terms: buckets by partition, terms by a filter that reaches the scan."""
    groups, phrases, excluded = parse_query(query)
    words = query_words(groups, phrases, excluded)
    terms = [r.term for r in spark.createDataFrame([(w,) for w in words], "word string").selectExpr(f"{stem('word')} AS term").collect()]
    buckets = spark.createDataFrame([(w,) for w in terms], "term string").selectExpr(f"int(pmod(xxhash64(term), {INDEX_BUCKETS})) AS b").collect()
    return spark.read.parquet(path).filter(F.col("bucket").isin(*{r.b for r in buckets}) & F.col("term").isin(*terms)).drop("bucket")


def parse_query(text: str) -> tuple[list[list[str]], list[str], list[str]]:
    """Web-style query: groups of alternatives that must each match, phrases, excluded words.

    Stop words ask for nothing: they leave groups and exclusions, and a phrase of nothing else goes.
    """
    phrases = [p for p in (x.lower() for x in re.findall(r'"([^"]+)"', text)) if set(p.split()) - set(QUERY_STOPWORDS)]
    rest = re.sub(r'"[^"]*"', " ", text).lower().split()
    groups: list[list[str]] = []
    excluded: list[str] = []
    joined = False
    for w in rest:
        if w == "or":
            joined = True
        elif w.startswith("-") and len(w) > 1:
            excluded.append(w[1:])
        elif joined and groups:
            groups[-1].append(w)
            joined = False
        else:
            groups.append([w])
    told = lambda ws: [w for w in ws if w not in QUERY_STOPWORDS]
    return [g for g in map(told, groups) if g], phrases, told(excluded)


def query_words(groups: list[list[str]], phrases: list[str], excluded: list[str]) -> list[str]:
    return sorted(({w for g in groups for w in g} | {w for p in phrases for w in p.split()} | set(excluded)) - set(QUERY_STOPWORDS))


def phrase_terms(phrase: str) -> list[tuple[str, int]]:
    """A phrase's words with their distances from the first; stop words ask for nothing but keep their places."""
    words = [(w, k) for k, w in enumerate(re.findall(r"[^\W_]+", phrase)) if w not in QUERY_STOPWORDS]
    return [(w, k - words[0][1]) for w, k in words]


def with_phrases(hits: DataFrame, phrases: list[str]) -> DataFrame:
    """doc_id of the documents that hold every phrase, from the hits' positions; no text is opened.

    A position less a word's distance is where its phrase would begin; where all of a phrase's words
    agree on a beginning, the phrase stands there.
    """
    asked = [(p, k, w, off, len(terms)) for p, terms in enumerate(map(phrase_terms, phrases)) for k, (w, off) in enumerate(terms)]
    places = F.broadcast(hits.sparkSession.createDataFrame(asked, "phrase int, k int, word string, off int, size int"))
    spots = hits.join(places, "word").select("doc_id", "field", "phrase", "k", "size", "off", F.explode("positions").alias("at"))
    begun = spots.groupBy("doc_id", "phrase", "field", (F.col("at") - F.col("off")).alias("start")).agg(F.countDistinct("k").alias("n"), F.first("size").alias("size"))
    held = begun.filter("n = size").select("doc_id", "phrase").distinct()
    return held.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") == len(phrases)).select("doc_id")


def search(index: DataFrame, docs: DataFrame, query: str, limit: int | None, entity: str | None = None, subtype: str | None = None) -> DataFrame:
    """doc_id, score, published of documents holding every group, every phrase and no excluded word, ranked by weighted tf.

    `limit` is the length of the page asked for, None for all. Only the query's terms are kept of the index (of a stored one, see read_postings, only they
    are read), and no document is opened.
    """
    groups, phrases, excluded = parse_query(query)
    words = query_words(groups, phrases, excluded)
    lookup = index.sparkSession.createDataFrame([(w,) for w in words], "word string").selectExpr("word", f"{stem('word')} AS term")
    d = index
    if entity is not None:
        d = d.filter(F.col("entity") == entity)
    if subtype is not None:
        d = d.filter(F.col("subtype") == subtype)
    hits = d.join(F.broadcast(lookup), "term")
    must = groups + [[w] for p in phrases for w, _ in phrase_terms(p)]
    has = lambda ws: F.max(F.col("word").isin(*ws).cast("int")) == 1
    weight = F.when(F.col("field") == "A", TITLE_WEIGHT).otherwise(BODY_WEIGHT)
    # summed in order of size, so that equal texts have equal scores whatever order their postings come in
    part = F.when(~F.col("word").isin(*excluded) if excluded else F.lit(True), weight * F.log1p("tf")).otherwise(0.0)
    scored = hits.groupBy("doc_id").agg(
        F.aggregate(F.array_sort(F.collect_list(part)), F.lit(0.0), lambda total, v: total + v).alias("score"),
        *[has(g).alias(f"_m{i}") for i, g in enumerate(must)], *([has(excluded).alias("_x")] if excluded else []))
    for i in range(len(must)):
        scored = scored.filter(F.col(f"_m{i}"))
    if excluded:
        scored = scored.filter(~F.col("_x"))
    if any(len(phrase_terms(p)) > 1 for p in phrases):
        scored = scored.join(with_phrases(hits, phrases), "doc_id", "left_semi")
    ranked = scored.select("doc_id", "score").join(docs.select("doc_id", "published"), "doc_id").orderBy(F.round("score", TIED_DIGITS).desc(), F.col("published").desc(), "doc_id")
    return ranked if limit is None else ranked.limit(limit)


def snippets(docs: DataFrame, query: str, radius: int = SNIPPET_RADIUS) -> DataFrame:
    """doc_id, snippet of each document (doc_id, text): around the first phrase of the query that it holds letter by letter, else
    around the earliest occurrence of a query word that most distinct words follow within `radius` characters; null without any.

    Occurrences are rows, ordered once a document; a frame of `radius` characters slides over them.
    """
    phrases = [p.strip().lower() for p in re.findall(r'"([^"]+)"', query)]
    terms = sorted({w for w in re.findall(r"\w+", query.lower()) if len(w) > 2})
    low = F.lower("text")
    literal = F.coalesce(*[F.nullif(F.instr(low, p), F.lit(0)) for p in phrases], F.lit(None).cast("int"))
    d = docs.select("doc_id", "text", literal.alias("exact"))
    pieces = d.filter("exact IS NULL").select("doc_id", F.explode(F.array(*[
        F.struct(F.lit(w).alias("term"), F.split(low, re.escape(w)).alias("pieces")) for w in terms])).alias("t")).select("doc_id", "t.term", F.posexplode("t.pieces").alias("k", "piece"))
    row = Window.partitionBy("doc_id", "term").orderBy("k")
    spots = pieces.withColumn("at", F.sum(F.length("piece")).over(row) + F.col("k") * F.length("term") + 1).withColumn(
        "last", F.lead("k").over(row).isNull()).filter("NOT last").select("doc_id", "term", F.col("at").cast("int").alias("at"))
    ahead = Window.partitionBy("doc_id").orderBy("at").rangeBetween(0, radius)
    near = sum((F.max(F.when(F.col("term") == w, 1).otherwise(0)).over(ahead) for w in terms), F.lit(0))
    best = spots.withColumn("n", near).groupBy("doc_id").agg((-F.max(F.struct("n", (-F.col("at")).alias("back"))).back).alias("dense"))
    placed = d.join(best, "doc_id", "left").withColumn("at", F.coalesce("exact", "dense") - 1).withColumn(
        "begin", F.greatest(F.col("at") - radius, F.lit(0))).withColumn("end", F.least(F.col("at") + radius, F.length("text")))
    body = F.trim(F.regexp_replace(F.col("text").substr(F.col("begin") + 1, F.col("end") - F.col("begin")), r"(?U)\s+", " "))
    return placed.select("doc_id", F.when(F.col("at").isNotNull(), F.concat(
        F.when(F.col("begin") > 0, "…").otherwise(""), body, F.when(F.col("end") < F.length("text"), "…").otherwise(""))).alias("snippet"))


def quotes_in_source(quotes: DataFrame, docs: DataFrame) -> DataFrame:
    """(quote, document) pairs where the document holds the quote word for word.

    Exact: words strictly inside a quote are whole words of any text holding it, so
    one run of inside words anchors an equi-join and `contains` decides.  Copies of a
    text are matched once.  Shorter quotes anchor on one inside word; a quote of one or
    two words can begin and end inside a word, so it anchors on three of its
    characters, or on fewer where it has no more.
    """
    words = r"filter(split(%s, '\\s+'), w -> w <> '')"
    q = quotes.selectExpr("quote_id", "quote", f"{words % 'quote'} AS w").withColumn("inner", F.expr("slice(w, 2, greatest(size(w) - 2, 0))")).filter("quote <> ''")
    bare = q.filter("size(inner) = 0").selectExpr("quote_id", "quote", f"least({CHAR_GRAM}, length(quote)) AS n").selectExpr("quote_id", "quote", "n", "substring(quote, 1, n) AS piece")
    q = q.filter("size(inner) > 0").selectExpr("quote_id", "quote", f"CASE WHEN size(inner) >= {GRAM} THEN {GRAM} ELSE 1 END AS n", "inner")
    anchor = "array_join(slice(inner, int((size(inner) - n) DIV 2) + 1, n), ' ')"
    anchors = q.selectExpr("quote_id", "quote", f"xxhash64(n, {anchor}) AS gram")
    copies = docs.selectExpr("doc_id", "text", "sha2(text, 256) AS copy")
    texts = copies.select("copy", "text").dropDuplicates(["copy"])
    grams = texts.selectExpr("copy", f"{words % 'text'} AS w").filter("size(w) > 0").selectExpr(
        "copy", "explode(array_distinct(concat(transform(w, x -> xxhash64(1, x)),"
        f" transform(slice(sequence(1, size(w)), 1, greatest(size(w) - {GRAM - 1}, 0)), i -> xxhash64({GRAM}, array_join(slice(w, i, {GRAM}), ' '))))) ) AS gram")
    # every run of one to three characters of a text, once each, for the quotes of one or two words
    lengths = bare.select("n").distinct()
    runs = texts.join(F.broadcast(lengths)).selectExpr("copy", "n", "explode(array_distinct(transform(slice(sequence(1, greatest(length(text), 1)), 1,"
                                                       " greatest(length(text) - n + 1, 0)), i -> substring(text, i, n)))) AS piece")
    met = anchors.join(grams, "gram").select("quote_id", "quote", "copy").unionByName(bare.join(runs, ["n", "piece"]).select("quote_id", "quote", "copy"))
    found = met.join(texts, "copy").filter(F.contains("text", F.col("quote"))).select("quote_id", "copy").distinct()
    return found.join(copies.select("doc_id", "copy"), "copy").select("quote_id", "doc_id")


def _covered_and_longest(quote: list[str], text: list[str], least: int) -> tuple[int, int]:
    """Words of `quote` inside runs of at least `least` words of `text`, and the longest run the two have in common.

    A word lies in such a run where one of the runs of exactly `least` words over it stands in the text. The longest run comes from
    the suffix automaton of the quote, which the text's words drive: states and steps grow with the two lengths, never with their product.
    """
    held = {tuple(text[j:j + least]) for j in range(len(text) - least + 1)}
    inside = {i + k for i in range(len(quote) - least + 1) if tuple(quote[i:i + least]) in held for k in range(least)}
    goes, link, length, last = [{}], [-1], [0], 0
    for w in quote:
        new, at = len(goes), last
        goes.append({}), link.append(0), length.append(length[last] + 1)
        while at >= 0 and w not in goes[at]:
            goes[at][w] = new
            at = link[at]
        if at >= 0:
            met = goes[at][w]
            if length[met] > length[at] + 1:
                goes.append(dict(goes[met])), link.append(link[met]), length.append(length[at] + 1)
                twin = len(goes) - 1
                while at >= 0 and goes[at].get(w) == met:
                    goes[at][w] = twin
                    at = link[at]
                link[met], met = twin, twin
            link[new] = met
        last = new
    at = run = longest = 0
    for w in text:
        while at and w not in goes[at]:
            at = link[at]
            run = length[at]
        if w in goes[at]:
            at, run = goes[at][w], run + 1
        longest = max(longest, run)
    return len(inside), longest


def quote_coverage(pairs: DataFrame, key: str, quote: str, text: str, least: int = GRAM) -> DataFrame:
    """Share of a quote's words inside runs of at least `least` words of its text, and its longest run.

    Pairs are dealt over every task; each is measured where it lies, in time that grows with its own length.
    """
    words = re.compile(r"[^ \t\n\x0b\f\r]+")

    @F.pandas_udf("words int, covered long, longest long")
    def measured(quotes: pd.Series, texts: pd.Series) -> pd.DataFrame:
        rows = []
        for q, t in zip(quotes, texts):
            q = words.findall(q or "")
            rows.append((len(q), *_covered_and_longest(q, words.findall(t or ""), least)))
        return pd.DataFrame(rows, columns=["words", "covered", "longest"])

    tasks = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    d = pairs.select(key, F.col(quote).alias("_q"), F.col(text).alias("_t")).repartition(tasks, key).select(key, measured.asNondeterministic()("_q", "_t").alias("m"))
    return d.select(key, F.col("m.words").alias("quote_words"), F.col("m.longest").alias("longest"), (F.col("m.covered") / F.greatest(F.col("m.words"), F.lit(1))).alias("covered"))


MENTION_DAYS, MENTION_CHARS = 30, 400


def mentions(names: DataFrame, docs: DataFrame, as_of: str, days: int = MENTION_DAYS, min_chars: int = MENTION_CHARS) -> DataFrame:
    """Newest document of each other filer that names an entity as whole words in the days up to `as_of`.

    Names (entity_name, own: the entity's own filer or null) meet documents on their first word;
    words travel without the text, which is opened for the documents that can match.
    """
    word = r"regexp_extract_all(lower(%s), '[\\p{L}\\p{N}]+', 0)"
    n = names.selectExpr("entity_name", "own", f"get({word % 'entity_name'}, 0) AS w").filter("w IS NOT NULL")
    recent = docs.filter(f"published <= date'{as_of}' AND published > date_sub(date'{as_of}', {days}) AND length(text) >= {min_chars}")
    words = recent.selectExpr("doc_id", "entity", f"explode(array_distinct({word % 'text'})) AS w")
    meet = words.join(n, "w").filter("own IS NULL OR own <> entity").select("entity_name", "doc_id")
    whole = F.regexp_like(F.lower("text"), F.concat(F.lit(r"(?<![\p{L}\p{N}])\Q"), F.lower("entity_name"), F.lit(r"\E(?![\p{L}\p{N}])")))
    found = meet.join(recent, "doc_id").filter(whole)
    return found.groupBy("entity_name", F.col("entity").alias("filer")).agg(F.max_by("doc_id", F.struct("published", "doc_id")).alias("doc_id"))


def mention_counts(mentioned: DataFrame) -> DataFrame:
    """How many filers name each entity."""
    return mentioned.groupBy("entity_name").agg(F.count(F.lit(1)).alias("filers"))
