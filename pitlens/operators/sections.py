"""Filing text: sections, paragraphs, diffs between successive filings, rare language.

Sections and paragraphs of one document are array expressions over its own lines, so
they need no shuffle.  Two filings meet in one row, and a paragraph is compared with those of the
other filing that share words with it; nothing is compared across a whole group.
"""

from __future__ import annotations

from collections import defaultdict
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pitlens.functions.text import normalise, vocabulary_terms
from pitlens.operators.feeds import previous_in_order
from pitlens.session import cut_lineage

SIMILARITY_THRESHOLD = 0.75
MIN_LENGTH_RATIO = SIMILARITY_THRESHOLD / (2 - SIMILARITY_THRESHOLD)
MIN_SECTION_LINES, MIN_PARAGRAPH = 20, 120
RARITY_WEIGHT, RAREST_TERMS, MIN_VOCABULARY_ENTITIES, COMMON_TERMS = 0.5, 5, 20, 20_000

# Line patterns of filings.
ITEM_HEADER = r"(?i)^\\s*item\\s+(\\d+[A-C]?)\\s*[.\\-–—:]?\\s*.*$"
PAGE_FOOTER = r"^.{0,80}\\|.{0,60}\\|\\s*\\d+\\s*$"
BARE_NUMBER = r"^\\s*\\d{1,4}\\s*$"
TABLE_OF_CONTENTS = r"(?i)^\\s*table of contents\\s*\\d{0,4}\\s*$"
SENTENCE_END = r"[.?!\"”’]$"


def extract_section(docs: DataFrame, item: str, out: str = "section") -> DataFrame:
    """Longest span from an `Item n` header to the next different item; null under twenty lines.

    Only header positions are materialised: each header of the item looks to the
    first later header of another item.
    """
    # every step is bound once, however often a filter or a later column repeats the whole
    let = lambda value, name, body: f"get(transform(array({value}), {name} -> {body}), 0)"
    heads = f"filter(transform(_l, (x, i) -> struct(i AS at, upper(regexp_extract(x, '{ITEM_HEADER}', 1)) AS item)), h -> h.item <> '')"
    end = f"coalesce(get(filter(_h, g -> g.at > h.at AND g.item <> '{item.upper()}'), 0).at, size(_l))"
    spans = f"transform(filter(_h, h -> h.item = '{item.upper()}'), h -> struct({end} - h.at AS lines, -h.at AS back))"
    keep = f"trim(x) <> '' AND NOT x RLIKE '{PAGE_FOOTER}' AND NOT x RLIKE '{BARE_NUMBER}' AND NOT x RLIKE '{TABLE_OF_CONTENTS}'"
    body = f"array_join(filter(slice(_l, int(2 - _s.back), int(_s.lines - 1)), x -> {keep}), '\\n')"
    found = f"CASE WHEN _s.lines >= {MIN_SECTION_LINES} THEN nullif({body}, '') END"
    return docs.withColumn(out, F.expr(let(r"split(text, '\\r\\n|\\n|\\r')", "_l", let(heads, "_h", let(f"array_max({spans})", "_s", found)))))


def split_paragraphs(text: str, min_chars: int = MIN_PARAGRAPH) -> str:
    """Join lines until one ends a sentence; keep paragraphs of at least `min_chars`."""
    lines = rf"filter(transform(split({text}, '\\n'), x -> trim(x)), x -> x <> '')"
    # a line says itself what follows it, so a text costs its length
    ended = rf"CASE WHEN x RLIKE '{SENTENCE_END}' THEN '\u0001' WHEN endswith(x, '\u0001') THEN '' ELSE ' ' END"
    return rf"filter(split(rtrim(array_join(transform({lines}, x -> concat(x, {ended})), '')), '\u0001'), p -> length(p) >= {min_chars})"


def prepare_text(docs: DataFrame, items: tuple[str, ...] = ("1A", "7")) -> DataFrame:
    """Risk and discussion sections where found, otherwise the whole text with a flag."""
    d = docs
    for i in items:
        d = extract_section(d, i, f"_sec_{i}")
    found = f"concat_ws('\\n', {', '.join(f'_sec_{i}' for i in items)})"
    return d.withColumn("prepared", F.expr(f"CASE WHEN {found} <> '' THEN {found} ELSE text END")).withColumn(
        "whole_text", F.expr(f"{found} = ''")).drop(*[f"_sec_{i}" for i in items])


@F.pandas_udf(T.DoubleType())
def matching_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Matching-block ratio of two normalised paragraphs; nothing in SQL measures it."""
    return pd.Series([SequenceMatcher(None, y, x).ratio() for x, y in zip(a, b)], dtype="float64")


def _grams(paragraph: str) -> set[tuple[str, str]]:
    words = paragraph.split(" ")
    return set(zip(words, words[1:]))


def _best_matches(mine: list[str], theirs: list[str]) -> list[float | None]:
    """Of each normalised paragraph its best matching-block ratio with the other side: 0 without a near one, null where it stands there word for word."""
    held, by_gram, out = set(theirs), defaultdict(list), []
    for at, other in enumerate(theirs):
        for gram in _grams(other):
            by_gram[gram].append(at)
    for norm in mine:
        if norm in held:
            out.append(None)
        elif norm == "":
            out.append(1.0)
        else:
            near = {theirs[at] for gram in _grams(norm) for at in by_gram.get(gram, ())}
            matcher, best = SequenceMatcher(None, "", norm), 0.0
            for other in near:
                if min(len(norm), len(other)) >= MIN_LENGTH_RATIO * max(len(norm), len(other)):
                    matcher.set_seq1(other)
                    if matcher.real_quick_ratio() > best and matcher.quick_ratio() > best:
                        best = max(best, matcher.ratio())
            out.append(best)
    return out


@F.pandas_udf(T.StructType([T.StructField(side, T.ArrayType(T.DoubleType())) for side in ("added", "removed")]))
def best_matches(current: pd.Series, prior: pd.Series) -> pd.DataFrame:
    """How alike the paragraphs of two filings are, both ways."""
    pairs = [(list(c), list(p)) for c, p in zip(current, prior)]
    return pd.DataFrame({"added": [_best_matches(c, p) for c, p in pairs], "removed": [_best_matches(p, c) for c, p in pairs]})


def build_vocabulary(paragraphs: DataFrame, min_entities: int = 2) -> DataFrame:
    """Terms with the number of entities using them; one row per (entity, term) is shuffled."""
    terms = paragraphs.select("entity", F.expr(f"explode({vocabulary_terms('paragraph')})").alias("term"))
    return terms.groupBy("term").agg(F.countDistinct("entity").alias("entities")).filter(F.col("entities") >= min_entities)


def term_rarity(paragraphs: DataFrame, vocabulary: DataFrame, key: str, common: int = COMMON_TERMS) -> DataFrame:
    """(paragraph, term, rarity): log(N / df) / log N, one when never seen, nothing under twenty entities.

    The terms that most entities use are looked up where the paragraph lies; only the others are dealt out to meet the vocabulary.
    """
    n, vocabulary = paragraphs.agg(F.countDistinct("entity").alias("n")), cut_lineage(vocabulary)
    terms = paragraphs.select(key, F.expr(f"explode({vocabulary_terms('paragraph')})").alias("term"))
    known = F.broadcast(vocabulary.orderBy(F.desc("entities"), "term").limit(common))
    rest = terms.join(known.select("term"), "term", "left_anti").join(vocabulary, "term", "left")
    d = terms.join(known, "term").unionByName(rest).join(F.broadcast(n)).filter(F.col("n") >= MIN_VOCABULARY_ENTITIES)
    return d.withColumn("rarity", F.expr("CASE WHEN entities IS NULL THEN 1D ELSE greatest(0D, least(1D, ln(n / entities) / ln(n))) END")).select(key, "term", "rarity")


def paragraph_rarity(rarities: DataFrame, key: str, k: int = RAREST_TERMS) -> DataFrame:
    """Mean of the five rarest terms, and those terms in order."""
    w = Window.partitionBy(key).orderBy(F.col("rarity").desc(), "term")
    top = rarities.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= k)
    return top.groupBy(key).agg(F.avg("rarity").alias("rarity"), F.expr(
        "transform(array_sort(collect_list(struct(r, term))), x -> x.term)").alias("unusual_terms"))


def filing_pairs(filings: DataFrame, bucket: str = "unix_date(published) DIV 90") -> DataFrame:
    """Each filing with the one before it by the same entity and subtype."""
    d = previous_in_order(filings.select("doc_id", "entity", "subtype", "published"), ["entity", "subtype"], "published", ["doc_id"], bucket)
    return d.filter("prior IS NOT NULL").select("entity", "subtype", F.col("doc_id").alias("current_id"), F.col("prior.doc_id").alias("prior_id"))


def diff_filings(paragraphs: DataFrame, pairs: DataFrame) -> DataFrame:
    """Paragraphs of each side of a pair with their best similarity to the other side.

    A filing's paragraphs meet those of the one before in one row, which two filings bound. Paragraphs found
    word for word on the other side leave first; the rest are measured against those that share two words
    in a row with them and whose length lets the ratio reach the threshold, 0 where there is none. A text moves
    twice: to its own number and to that of the filing after it; what its words share is found where the two lie.
    """
    packed = paragraphs.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", "paragraph"))).alias("held"))
    back = pairs.select(F.col("prior_id").alias("doc_id"), "current_id").join(packed, "doc_id").select("current_id", F.col("held").alias("before"))
    both = packed.withColumnRenamed("doc_id", "current_id").join(back.hint("merge"), "current_id")
    norms = lambda c: F.expr(f"transform({c}, x -> {normalise('x.paragraph')})")
    both = both.withColumn("best", best_matches.asNondeterministic()(norms("held"), norms("before"))).join(pairs, "current_id")
    side = lambda name, doc, held: f"transform({held}, (x, i) -> struct('{name}' AS side, {doc} AS doc_id, x.pos AS pos, x.paragraph AS paragraph, best.{name}[i] AS similarity))"
    rows = f"concat({side('added', 'current_id', 'held')}, {side('removed', 'prior_id', 'before')})"
    return both.selectExpr("entity", "subtype", "current_id", "prior_id", f"inline(filter({rows}, x -> x.similarity IS NOT NULL))")


def changed_paragraphs(diffs: DataFrame, rarity: DataFrame | None = None) -> DataFrame:
    """Unmatched paragraphs with their place on their side: newest language and rarest words first."""
    d = diffs.filter(F.col("similarity") < SIMILARITY_THRESHOLD)
    if rarity is not None:
        d = d.join(rarity, ["doc_id", "pos"], "left")
    else:
        d = d.withColumn("rarity", F.lit(None).cast("double"))
    d = d.withColumn("rank_score", 1 - F.col("similarity") + F.coalesce(F.col("rarity") * RARITY_WEIGHT, F.lit(0.0)))
    w = Window.partitionBy("current_id", "side").orderBy(F.col("rank_score").desc(), "pos")
    return d.withColumn("place", F.row_number().over(w))


def similarity_to_prior(paragraphs: DataFrame, pairs: DataFrame, diffs: DataFrame) -> DataFrame:
    """doc_id, pos, similarity of every paragraph of a filing whose filing before has paragraphs: 1 where it stands there word for word."""
    held = paragraphs.select(F.col("doc_id").alias("prior_id")).distinct()
    mine = paragraphs.select("doc_id", "pos").join(pairs.selectExpr("current_id AS doc_id", "prior_id"), "doc_id").join(held, "prior_id", "left_semi")
    changed = diffs.filter("side = 'added'").select("doc_id", "pos", F.col("similarity").alias("_s"))
    return mine.join(changed, ["doc_id", "pos"], "left").select("doc_id", "pos", F.coalesce("_s", F.lit(1.0)).alias("similarity"))


def quote_placements(quotes: DataFrame, paragraphs: DataFrame, similar: DataFrame) -> DataFrame:
    """doc_id, pos, similarity, placed: the first paragraph of its document that holds each quote (doc_id, quote), and whether that
    paragraph is new; null where no paragraph holds the quote or the filing before cannot be read.

    A finding of new language is wrong where its paragraph already stood in the filing before, whatever the quote says.
    """
    norm = lambda c: F.expr(normalise(c))
    held = quotes.select("doc_id", norm("quote").alias("_q")).join(paragraphs.select("doc_id", "pos", norm("paragraph").alias("_p")), "doc_id").filter(
        F.contains("_p", F.col("_q"))).groupBy("doc_id", "_q").agg(F.min("pos").alias("pos"))
    found = quotes.select("doc_id", norm("quote").alias("_q")).join(held, ["doc_id", "_q"], "left").join(similar, ["doc_id", "pos"], "left")
    return found.select("doc_id", "pos", "similarity", (F.col("similarity") < SIMILARITY_THRESHOLD).alias("placed"))


def revalidated(findings: DataFrame, similar: DataFrame) -> DataFrame:
    """Findings of new language (doc_id, pos and what else they carry) with similarity and verdict: stale where their paragraph's twin
    stands in the filing before, sound where it does not, unreconstructible where there is nothing to compare with."""
    verdict = F.when(F.col("similarity").isNull(), "unreconstructible").when(F.col("similarity") >= SIMILARITY_THRESHOLD, "stale").otherwise("sound")
    return findings.join(similar, ["doc_id", "pos"], "left").withColumn("verdict", verdict)
