"""Spelling variants: near words found by a frontier of states over a trie that lies in a table.

The vocabulary's trie is a table of edges (node, label, child), a label being the next STRIDE code points,
padded past a word's end. A node is named by its prefix. A state says how far a word has been read, at which
node, after how many edits. A word reads along its own path without an edit; where another branch
leaves the path, the word may be read on there with one edit, a replaced or deleted code point. Level by level
the frontier of such states is joined with the edges that carry what the word says next; a label
that runs past a word's end closes there, and the word it closes is a neighbour. An inserted code point is the
other word's deleted one.

An edit leaves one half of a word as it is, so two tries are walked at once, of the words
and of the words reversed, each for edits in the second half. Above the halves, where nearly every
branch exists, no state ever stands. What two words differ in is their first difference, so each pair
is met by one state only, and the states of a key number few: they share half a word and a label.

Runs of letters are A-Z, a-z and U+00C0 to U+00FF; null texts have none; a null doc_id is written as an empty string.
Rows alike count each. Without documents there are no words.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitlens.session import cut_lineage, spread

LETTER, LEAST_LENGTH, LEAST_COUNT, TIMES = r"[A-Za-zÀ-ÿ]", 7, 2, 10
#: One occurrence in so many loses a code point before words are counted.
LOSSY = 31
STRIDE = 4
#: Words with more code points are read in one label, as a digest, so that a word's states stay small.
LONG = 200
#: A prefix up to so many code points names its node; a longer one does by its digest.
_NAMED = 32
_PAD = "\x00"


def occurrences(docs: DataFrame, least: int = LEAST_LENGTH, lossy: int = LOSSY) -> DataFrame:
    """word: a row per run of letters of at least `least` code points, one in `lossy` of them less a code point."""
    run = F.translate("text", string.ascii_uppercase, string.ascii_lowercase)
    runs = spread(docs.select("doc_id", "text")).select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc"), F.explode(
        F.regexp_extract_all(run, F.lit(f"({LETTER}{{{least},}})"), 1)).alias("run"))
    h = F.crc32(F.concat("doc", F.lit(":"), "run"))
    at = F.pmod(F.col("h"), F.length("run")).cast("int")
    less = F.concat(F.col("run").substr(F.lit(1), at), F.col("run").substr(at + 2, F.length("run")))
    return runs.withColumn("h", h).select(F.when(F.col("h") % lossy == 0, less).otherwise(F.col("run")).alias("word")).where(F.length("word") >= least)


def vocabulary(words: DataFrame, least_count: int = LEAST_COUNT) -> DataFrame:
    """word, n: the distinct words met at least `least_count` times."""
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count)


def _node(prefix: Column) -> Column:
    return F.when(F.length(prefix) <= _NAMED, prefix).otherwise(F.sha2(prefix, 256))


def _label(start: Column, size: int, whole: Column) -> Column:
    """What a word says from a position on (counted from 0), padded past its end; if `whole`, all the rest of it, as a digest."""
    rest = F.col("w").substr(start + 1, F.col("m"))
    return F.when(whole, F.sha2(rest, 256)).otherwise(F.rpad(rest, size, _PAD))


def _both_ways(vocab: DataFrame) -> DataFrame:
    """side, w, n, m, half: each word and each word reversed, and from where on its edits are looked for."""
    sides = vocab.select("n", F.length("word").alias("m"), F.explode(F.array(
        F.struct(F.lit(0).alias("side"), F.col("word").alias("w")), F.struct(F.lit(1).alias("side"), F.reverse("word").alias("w")))).alias("s"))
    return sides.select("s.side", "s.w", "n", "m", F.when(F.col("s.side") == 0, F.floor(F.col("m") / 2)).otherwise(F.ceil(F.col("m") / 2)).cast("int").alias("half"))


def _meeting(node: Column, says: Column) -> Column:
    """Where states and edges meet: the side, the node and what is said there, as one number; who meets by chance is told apart later."""
    return F.xxhash64("side", node, says)


def edges(words: DataFrame, level: int, first: bool) -> DataFrame:
    """The trie's edges that a state of `level` can meet: meeting (and first, the label's first code point), child, and the word that a label closes."""
    d, whole = F.col("d"), F.col("whole")
    from_ = F.col("half") + level * STRIDE
    at = words.where(from_ <= F.col("m")).withColumn("d", F.explode(F.sequence(from_, F.col("m"))))
    # a word of LONG code points is read in both ways, as a longer word may be one deletion from it
    ways = F.when(F.col("m") > LONG, F.array(F.lit(True))).when((F.col("m") == LONG) & F.lit(first), F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))
    at = at.withColumn("whole", F.explode(ways)).where(F.lit(first) | ~whole)
    closes = whole | (d + STRIDE > F.col("m"))
    says = _label(d + 1, STRIDE - 1, whole) if first else _label(d, STRIDE, whole)
    return at.select(_meeting(_node(F.col("w").substr(F.lit(1), d)), says).alias("meeting"), *([F.col("w").substr(d + 1, F.lit(1)).alias("first")] if first else []),
                     F.when(~closes, _node(F.col("w").substr(F.lit(1), d + STRIDE))).alias("child"),
                     F.when(closes, F.struct("w", "n")).alias("closed")).repartition("meeting").distinct()


def first_edits(words: DataFrame) -> DataFrame:
    """States that leave their word's own path by one edit: side, w, n, pos, node, closed."""
    d, m = F.col("d"), F.col("m")
    whole = m > LONG
    own = words.where("half < m").withColumn("d", F.explode(F.sequence(F.col("half"), m - 1)))
    here, after = F.col("w").substr(d + 1, F.lit(1)), F.col("w").substr(d + 2, F.lit(1))
    node = _node(F.col("w").substr(F.lit(1), d))
    replaced = F.struct(F.lit(False).alias("less"), _meeting(node, _label(d + 1, STRIDE - 1, whole)).alias("meeting"))
    deleted = F.struct(F.lit(True).alias("less"), _meeting(node, _label(d + 2, STRIDE - 1, whole)).alias("meeting"))
    moves = own.select("side", "w", "n", d.cast("int").alias("d"), F.explode(F.when(here == after, F.array(replaced)).otherwise(F.array(replaced, deleted))).alias("move"))
    # a replaced code point turns to any other; a deleted one to the code point after it, the word's end included
    leaves = (F.col("first") != here) & F.when(F.col("less"), F.col("first") == after).otherwise(F.col("first") != "")
    return moves.select("side", "w", "n", "d", "move.*").join(edges(words, 0, True), "meeting").where(leaves).select(
        "side", "w", "n", (d + STRIDE + F.col("less").cast("int")).alias("pos"), F.col("child").alias("node"), "closed")


def near_words(vocab: DataFrame) -> DataFrame:
    """word, n, near, near_n: both ways round, the words of the vocabulary that differ by exactly one inserted, deleted or replaced code point."""
    words = cut_lineage(_both_ways(vocab))
    frontier, met, level = cut_lineage(first_edits(words)), [], 0
    while True:
        met.append(frontier.where(F.col("closed").isNotNull()))
        level += 1
        open_ = frontier.where(F.col("closed").isNull())
        if open_.isEmpty():
            break
        says = _label(F.col("pos"), STRIDE, F.lit(False))
        frontier = cut_lineage(open_.withColumn("m", F.length("w")).withColumn("meeting", _meeting(F.col("node"), says)).drop("m", "node", "closed").join(edges(words, level, False), "meeting").select(
            "side", "w", "n", (F.col("pos") + STRIDE).alias("pos"), F.col("child").alias("node"), "closed"))
    found = met[0]
    for more in met[1:]:
        found = found.unionByName(more)
    turned = lambda c: F.when(F.col("side") == 1, F.reverse(c)).otherwise(F.col(c))
    pairs = found.select("side", F.col("w"), "n", F.col("closed.w").alias("v"), F.col("closed.n").alias("v_n")).select(
        "side", turned("w").alias("word"), "n", turned("v").alias("near"), F.col("v_n").alias("near_n"))
    half = F.floor(F.length("word") / 2).cast("int")
    pairs = pairs.where((F.col("side") == 0) | (F.col("word").substr(F.lit(1), half) != F.col("near").substr(F.lit(1), half)))
    pairs = pairs.where(F.levenshtein("word", "near", 1) == 1)
    # a deletion is met from the longer word alone
    other = F.struct(F.col("near").alias("word"), F.col("near_n").alias("n"), F.col("word").alias("near"), F.col("n").alias("near_n"))
    same = F.struct("word", "n", "near", "near_n")
    return pairs.select(F.explode(F.when(F.length("word") > F.length("near"), F.array(same, other)).otherwise(F.array(same))).alias("p")).select("p.*")


def roots(forms: DataFrame) -> DataFrame:
    """word, root: the end of each word's chain of forms, from word, form. Chains are halved a round; counts grow along them, so they end."""
    known = cut_lineage(forms.select("word", F.col("form").alias("root")))
    while True:
        on = known.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = cut_lineage(known.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        known = step.select("word", "root")
        if step.where("moved").isEmpty():
            return known


def variants(docs: DataFrame, times: int = TIMES) -> DataFrame:
    """word, n, n_near, form, form_n, root of every word of the vocabulary of `docs` (doc_id, text).

    A word's form is its near word of largest n, of equal ones the smallest in code-point order, if that n is at
    least `times` the word's; else null. Its root follows forms to the last, or is the word itself.
    """
    vocab = cut_lineage(vocabulary(occurrences(docs)))
    best = near_words(vocab).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("form"))).alias("best"))
    judged = cut_lineage(vocab.join(best, "word", "left").withColumn("form_n", -F.col("best.less")).withColumn("has", F.coalesce(F.col("form_n") >= F.col("n") * times, F.lit(False))).select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(F.col("has"), F.col("best.form")).alias("form"), F.when(F.col("has"), F.col("form_n")).alias("form_n")))
    return judged.join(roots(judged.where("form IS NOT NULL")), "word", "left").withColumn("root", F.coalesce("root", "word"))
