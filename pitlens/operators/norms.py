"""What documents of a kind usually say: norms by hierarchy, incidence, parity, restatement."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pitlens.functions.findings import ALWAYS_NEW
from pitlens.functions.stats import shrunk_mean
from pitlens.functions.text import figures, jaccard, tokens
from pitlens.session import cut_lineage

PRIOR_WEIGHT = 8.0
MIN_SECTOR_OBSERVATIONS = 10
UNINFORMATIVE_FLOOR = 0.10
RECURRENCE_OVERLAP, RECURRENCE_DISCOUNT = 0.30, 0.25
#: Sets of a side that meet in one task, for one token.
CELL_ROWS = 1_000
INCIDENCE_WEIGHT, MIN_DOCUMENTS = 2.0, 4


def measure_norms(signed: DataFrame) -> dict[str, DataFrame]:
    """Expected sign by type, genre, sector and company, each shrunk to its parent.

    One pass counts the finest level, which is written; every coarser level folds that table,
    so the findings are read once and hot entities arrive pre-aggregated.
    """
    finest = cut_lineage(signed.filter(F.col("sign") != 0).groupBy("entity_id", "sector", "genre", "finding_type").agg(
        F.count(F.lit(1)).alias("n"), F.sum("sign").alias("s")))
    fold = lambda *keys: finest.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    by_type = fold("finding_type").selectExpr("finding_type", "n AS type_n", f"{shrunk_mean('s', 'n', '0D', PRIOR_WEIGHT)} AS type_e")
    by_genre = fold("genre", "finding_type").join(by_type, "finding_type").selectExpr(
        "genre", "finding_type", "n AS genre_n", f"{shrunk_mean('s', 'n', 'type_e', PRIOR_WEIGHT)} AS genre_e")
    by_sector = fold("sector", "genre", "finding_type").filter(
        F.col("sector").isNotNull() & (F.col("n") >= MIN_SECTOR_OBSERVATIONS)).join(by_genre, ["genre", "finding_type"]).selectExpr(
        "sector", "genre", "finding_type", "n AS sector_n", f"{shrunk_mean('s', 'n', 'genre_e', PRIOR_WEIGHT)} AS sector_e")
    by_company = (finest.join(by_genre, ["genre", "finding_type"]).join(by_sector, ["sector", "genre", "finding_type"], "left").selectExpr(
        "entity_id", "genre", "finding_type", "n AS company_n",
        f"{shrunk_mean('s', 'n', 'coalesce(sector_e, genre_e)', PRIOR_WEIGHT)} AS company_e"))
    return {"type": by_type, "genre": by_genre, "sector": by_sector, "company": by_company}


def with_expected(signed: DataFrame, norms: dict[str, DataFrame]) -> DataFrame:
    """Most specific norm available, and the finding's excess over it clamped to [-1, 1]."""
    d = (signed.join(norms["company"], ["entity_id", "genre", "finding_type"], "left")
         .join(norms["sector"], ["sector", "genre", "finding_type"], "left")
         .join(norms["genre"], ["genre", "finding_type"], "left").join(norms["type"], "finding_type", "left"))
    d = d.withColumn("expected", F.coalesce("company_e", "sector_e", "genre_e", "type_e", F.lit(0.0))).withColumn(
        "level", F.expr("CASE WHEN company_e IS NOT NULL THEN 'company' WHEN sector_e IS NOT NULL THEN 'sector'"
                        " WHEN genre_e IS NOT NULL THEN 'genre' WHEN type_e IS NOT NULL THEN 'type' ELSE 'root' END"))
    d = d.withColumn("excess", F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("sign") - F.col("expected"))))
    return d.drop(*[f"{l}_{x}" for l in ("company", "sector", "genre", "type") for x in "en"])


def document_counts(signed: DataFrame) -> DataFrame:
    return signed.groupBy("document_id", "entity_id", "sector", "genre").agg(
        F.count_if(F.col("sign") > 0).alias("positive"), F.count_if(F.col("sign") < 0).alias("negative"))


def measure_incidence(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Directional findings per document by genre and sector, shrunk toward the mean of all documents."""
    finest = cut_lineage(documents.groupBy("sector", "genre").agg(
        F.count(F.lit(1)).alias("docs"), F.sum("positive").alias("p"), F.sum("negative").alias("q")))
    root = finest.agg((F.sum("p") / F.sum("docs")).alias("root_p"), (F.sum("q") / F.sum("docs")).alias("root_q"), F.sum("docs").alias("root_docs"))
    shrink = lambda pp, qq, a, b: [f"{shrunk_mean('p', 'docs', pp, INCIDENCE_WEIGHT)} AS {a}", f"{shrunk_mean('q', 'docs', qq, INCIDENCE_WEIGHT)} AS {b}"]
    genre = finest.groupBy("genre").agg(*[F.sum(c).alias(c) for c in ("docs", "p", "q")])
    # the root is one row: joined as a broadcast of proven size
    genre = genre.join(F.broadcast(root)).selectExpr("genre", "docs AS genre_docs", *shrink("root_p", "root_q", "genre_p", "genre_q"), "root_p", "root_q", "root_docs")
    sector = finest.filter("sector IS NOT NULL").join(genre, "genre").selectExpr(
        "sector", "genre", "docs AS sector_docs", *shrink("genre_p", "genre_q", "sector_p", "sector_q"))
    return genre, sector


def expected_counts(documents: DataFrame, genre: DataFrame, sector: DataFrame) -> DataFrame:
    """Attach what a document of this genre and sector usually holds; thin pools fall back."""
    d = documents.join(sector, ["sector", "genre"], "left").join(genre, "genre", "left")
    level = lambda c: (f"CASE WHEN sector_docs >= {MIN_DOCUMENTS} THEN sector_{c} WHEN genre_docs >= {MIN_DOCUMENTS} THEN genre_{c} ELSE root_{c} END")
    return d.selectExpr("document_id", "entity_id", "sector", "genre", "positive", "negative",
                        f"{level('p')} AS expected_p", f"{level('q')} AS expected_q", f"{level('docs')} AS peer_documents")


def incidence_excess(expected: DataFrame) -> DataFrame:
    """Mean residual per entity over documents that said something and have a trusted norm."""
    raw = "((positive - expected_p) - (negative - expected_q)) / greatest(expected_p + expected_q, 1D)"
    d = expected.filter(f"peer_documents >= {MIN_DOCUMENTS} AND positive + negative > 0").selectExpr(
        "entity_id", f"greatest(-1D, least(1D, {raw})) AS residual")
    return d.groupBy("entity_id").agg(F.avg("residual").alias("residual"), F.count(F.lit(1)).alias("measurable"))


def parity_weights(findings: DataFrame) -> DataFrame:
    """1 / sqrt(findings in the same document), by joining document counts back."""
    counts = findings.groupBy("document_id").agg((1 / F.sqrt(F.count(F.lit(1)))).alias("parity"))
    return findings.join(counts, "document_id")


def _sightings(df: DataFrame, keys: list[str]) -> DataFrame:
    """The two earliest documents that show each key, each with its earliest time: keys, seen (an array of time and document)."""
    per_doc = df.groupBy(*keys, "document_id").agg(F.min("occurred_at").alias("t"))
    top = per_doc.withColumn("r", F.row_number().over(Window.partitionBy(*keys).orderBy("t", "document_id"))).filter("r <= 2")
    return top.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("t", F.col("document_id").alias("doc")))).alias("seen"))


def _prefix(rare: str) -> str:
    """The rarest tokens of which a set as similar as asked must share one."""
    return f"slice({rare}, 1, size({rare}) - int(ceil({RECURRENCE_OVERLAP} * size({rare}))) + 1)"


def similar_sets(probes: DataFrame, index: DataFrame, keys: list[str], cell: int = CELL_ROWS) -> DataFrame:
    """Rows of `probes` (this, rare) and `index` (other, rare, seen) alike in `keys` whose token sets have the overlap asked: this, seen.

    `rare` is a set in one order for all, rarest first. Sets meet through the tokens of their prefixes; of these the
    first that both hold counts, so a pair comes once. Lengths and places bound the overlap
    before sets are compared. A token that many sets of a key share is dealt over a grid: its probes in rows of `cell`, its
    index in columns of `cell`, so that no task meets more than `cell` with `cell`, however hot the key and the token.
    """
    def prefixed(d: DataFrame, name: str) -> DataFrame:
        return d.select(*keys, name, "rare", *([] if name == "this" else ["seen"]), F.expr(f"posexplode({_prefix('rare')}) AS (place, tok)"))

    p, i = prefixed(probes, "this"), prefixed(index, "other")
    sizes = p.groupBy(*keys, "tok").agg(F.count(F.lit(1)).alias("n_p")).join(i.groupBy(*keys, "tok").agg(F.count(F.lit(1)).alias("n_i")), [*keys, "tok"])
    grid = sizes.select(*keys, "tok", F.ceil(F.col("n_p") / cell).cast("int").alias("rows"), F.ceil(F.col("n_i") / cell).cast("int").alias("columns"))
    deal = lambda name, n: F.pmod(F.xxhash64(name), F.col(n)).cast("int")
    all_of = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    p = p.join(grid, [*keys, "tok"]).withColumn("row", deal("this", "rows")).withColumn("column", all_of("columns")).drop("rows", "columns").withColumnsRenamed({"rare": "a", "place": "at"})
    i = i.join(grid, [*keys, "tok"]).withColumn("column", deal("other", "columns")).withColumn("row", all_of("rows")).drop("rows", "columns").withColumnsRenamed({"rare": "b", "place": "bt"})
    need = f"{RECURRENCE_OVERLAP} / (1 + {RECURRENCE_OVERLAP}) * (size(a) + size(b)) - 1e-9"
    met = p.join(i, [*keys, "tok", "row", "column"]).filter(
        f"size(b) >= {RECURRENCE_OVERLAP} * size(a) - 1e-9 AND size(a) >= {RECURRENCE_OVERLAP} * size(b) - 1e-9 AND least(size(a) - at, size(b) - bt) >= {need}")
    return met.filter(f"{jaccard('a', 'b')} >= {RECURRENCE_OVERLAP} AND get(filter(a, x -> array_contains(b, x)), 0) = tok")


def _comparable(findings: DataFrame, keys: list[str], asked: str) -> tuple[DataFrame, bool]:
    """Findings that may restate or be restated, and whether any without a figure asks.

    A statement is only met by one that shows its first figure, so what no one asks for, or one document alone shows, is left
    out before words are read. Without a figure every finding of its keys answers.
    """
    d = findings.filter(~F.col("finding_type").isin(*ALWAYS_NEW)).selectExpr(
        "finding_id", "document_id", "occurred_at", *keys, f"coalesce({asked}, false) AS asks", "summary", f"array_sort({figures('summary')}) AS figs")
    slots = d.select(*keys, "document_id", F.expr("IF(asks, coalesce(get(figs, 0), ''), NULL)").alias("first"), F.expr("explode(array_union(array(''), figs)) AS fig"))
    groups = cut_lineage(slots.groupBy(*keys, "fig").agg(
        F.min("document_id").alias("a"), F.max("document_id").alias("b"), F.max(F.expr("coalesce(first = fig, false)")).alias("sought")).filter("sought AND a <> b").select(*keys, "fig"))
    kept = d.withColumn("fig", F.explode("figs")).join(groups, [*keys, "fig"], "left_semi").drop("fig")
    blank = groups.filter("fig = ''").select(*keys)
    if blank.isEmpty():
        return kept.dropDuplicates(["finding_id", "document_id"]), False
    return kept.unionByName(d.join(blank, keys, "left_semi")).dropDuplicates(["finding_id", "document_id"]), True


def restated(findings: DataFrame, scope: tuple[str, ...] = ("entity_id",), asked: str = "true") -> DataFrame:
    """Findings already said earlier, in another document, with no new figure.

    What is compared are token sets, each once for a (scope, type), however many findings use its words. A finding without
    figures asks when a similar set was seen first, one with a figure when it was seen with that figure, one with more
    figures when with all of them; two earliest documents answer each of these, as one of them is another document.
    All findings answer; those that meet the condition `asked` ask, so a window of findings costs its own sets. Only findings
    that share (scope, type) and the first figure asked for with another document are compared at all.
    """
    keys = [*scope, "finding_type"]
    d, blank = _comparable(findings, keys, asked)
    d = d.withColumn("toks", F.expr(f"array_sort({tokens('summary')})")).drop("summary").filter("size(toks) > 0")
    # 16 bytes name a set or a statement: names are most of what the exchanges below carry
    of = lambda c: f"unhex(md5(concat_ws('|', {', '.join(f'string({k})' for k in keys)}, array_join(toks, ' '){c})))"
    d = cut_lineage(d.withColumn("said", F.expr(of(""))).withColumn("stmt", F.expr(of(", array_join(figs, ' ')"))))
    sets = d.select("said", *keys, "toks").dropDuplicates(["said"])
    df = sets.select(*keys, F.explode("toks").alias("tok")).groupBy(*keys, "tok").agg(F.count(F.lit(1)).alias("df"))
    ordered = cut_lineage(sets.select("said", *keys, F.explode("toks").alias("tok")).join(df, [*keys, "tok"]).groupBy("said", *keys).agg(
        F.expr("transform(array_sort(collect_list(struct(df, tok))), r -> r.tok) AS rare")))
    # what a finding asks: with no figure, with one, or with all of several
    shown = d.select("said", "document_id", "occurred_at", "figs")
    answers = (_sightings(shown.withColumn("fig", F.explode("figs")).withColumn("figs", F.array("fig")).drop("fig"), ["said", "figs"])
               .unionByName(_sightings(shown.filter("size(figs) > 1"), ["said", "figs"])))
    if blank:
        answers = answers.unionByName(_sightings(shown, ["said"]).withColumn("figs", F.array().cast("array<string>")))
    asked = [*keys, "kind", "fig"]
    kind = F.least(F.size("figs"), F.lit(2)).alias("kind")
    index = answers.join(ordered, "said").select(*keys, F.xxhash64("said", "figs").alias("other"), "rare", "figs", "seen", kind,
                                                 F.explode(F.when(F.size("figs") == 0, F.array(F.lit(""))).otherwise(F.col("figs"))).alias("fig"))
    probes = d.filter("asks").select("stmt", "said", *keys, "figs").dropDuplicates(["stmt"]).join(ordered.select("said", "rare"), "said").select(
        *keys, F.struct("stmt", "figs").alias("this"), "rare", kind, F.coalesce(F.get("figs", F.lit(0)), F.lit("")).alias("fig"))
    met = similar_sets(probes, index.select(*asked, "other", "rare", F.struct("figs", "seen").alias("seen")), asked)
    first = met.filter("size(array_except(this.figs, seen.figs)) = 0").select(F.col("this.stmt").alias("stmt"), F.explode("seen.seen").alias("s")).groupBy(
        "stmt", "s.doc").agg(F.min("s.t").alias("t"))
    two = first.withColumn("r", F.row_number().over(Window.partitionBy("stmt").orderBy("t", "doc"))).filter("r <= 2").groupBy("stmt").agg(
        F.max(F.when(F.col("r") == 1, F.col("doc"))).alias("lead_doc"), F.max(F.when(F.col("r") == 1, F.col("t"))).alias("lead_at"), F.max(F.when(F.col("r") == 2, F.col("t"))).alias("outside_at"))
    return d.filter("asks").join(two, "stmt").filter("CASE WHEN lead_doc <> document_id THEN lead_at ELSE outside_at END < occurred_at").select("finding_id")


def finding_weight(with_norms: DataFrame, restated_ids: DataFrame) -> DataFrame:
    """Parity weight, discounted when restated, kept only where the excess is informative."""
    flag = restated_ids.select("finding_id", F.lit(True).alias("is_restated")).distinct()
    d = with_norms.join(flag, "finding_id", "left")
    keep = f"sign IS NOT NULL AND sign <> 0 AND abs(excess) >= {UNINFORMATIVE_FLOOR}"
    return d.withColumn("weight", F.expr(f"CASE WHEN {keep} THEN parity * CASE WHEN is_restated THEN {RECURRENCE_DISCOUNT} ELSE 1D END ELSE 0D END"))
