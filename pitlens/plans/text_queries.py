"""Sections, vocabulary, filing diffs, search and quotes."""

import uuid

from pyspark.sql import functions as F

from pitlens.functions import text as tx
from pitlens.operators import search, sections
from pitlens.plans.registry import query
from pitlens.plans.views import R, view
from pitlens.session import checkpoint_dir, cut_lineage
from pitlens.sources.sinks import exists


def filed(t):
    """Filings laid out as items: the text, one sentence per line, between two item headers."""
    return t.filing_texts.withColumn("text", F.expr(
        r"concat('Item 1A. Risk Factors\nTable of contents 3\n', replace(text, '. ', '.\n'), '\n12\nItem 2. Properties\nnone.')"))


view("filed", r"select doc_id, entity, subtype, published, 'Item 1A. Risk Factors' || chr(10) || 'Table of contents 3' || chr(10) || replace(text, '. ', '.' || chr(10)) || chr(10) || '12' || chr(10) || 'Item 2. Properties' || chr(10) || 'none.' text from filings", "filings")
view("file_lines", r"select doc_id, entity, subtype, unnest(l) x, generate_subscripts(l, 1) - 1 i from (select *, string_split_regex(text, '\r\n|\n|\r') l from filed)", "filed")
view("headers", r"select doc_id, i, upper(regexp_extract(x, '(?i)^\s*item\s+(\d+[A-C]?)\s*[.\-–—:]?\s*.*$', 1)) item from file_lines where regexp_matches(x, '(?i)^\s*item\s+(\d+[A-C]?)\s*[.\-–—:]?\s*.*$')", "file_lines")
view("spans", """select doc_id, i, coalesce((select min(i) from headers g where g.doc_id=h.doc_id and g.i > h.i and g.item <> '1A'), (select max(i) + 1 from file_lines l where l.doc_id=h.doc_id)) e from headers h where item='1A'""", "headers file_lines")
view("span", "select doc_id, arg_max(i, (e - i) * 100000 - i) i, max(e - i) n from spans group by 1 having max(e - i) >= 20", "spans")
view("section_lines", r"""select l.doc_id, l.entity, l.subtype, l.i, l.x from file_lines l join span s on s.doc_id=l.doc_id and l.i > s.i and l.i < s.i + s.n
 where trim(x) <> '' and not regexp_matches(x, '^.{0,80}\|.{0,60}\|\s*\d+\s*$') and not regexp_matches(x, '^\s*\d{1,4}\s*$') and not regexp_matches(x, '(?i)^\s*table of contents\s*\d{0,4}\s*$')""", "file_lines span")
view("paras", r"""select *, row_number() over (partition by doc_id order by g) - 1 pos from (select doc_id, any_value(entity) entity, any_value(subtype) subtype, g, string_agg(trim(x), ' ' order by i) paragraph from (
 select *, coalesce(sum(regexp_matches(trim(x), '[.?!"”’]$')::int) over (partition by doc_id order by i rows between unbounded preceding and 1 preceding), 0) g from section_lines) group by doc_id, g) where length(paragraph) >= 120""", "section_lines")


@query("extract_section", "TXT-01", "select doc_id, count(*) as lines, md5(string_agg(x, chr(10) order by i)) digest from section_lines group by 1", "section_lines")
def _(t):
    d = sections.extract_section(filed(t), "1A").filter("section IS NOT NULL")
    return d.selectExpr("doc_id", r"bigint(size(split(section, '\n'))) AS lines", "md5(section) AS digest")


def paragraphs(t, table=None):
    d = sections.extract_section(filed(t) if table is None else table, "1A").filter("section IS NOT NULL")
    return d.selectExpr("doc_id", "entity", "subtype", "published", f"posexplode({sections.split_paragraphs('section')}) AS (pos, paragraph)")


@query("split_paragraphs", "TXT-02", "select doc_id, pos::int pos, length(paragraph)::int chars, md5(paragraph) digest from paras", "paras")
def _(t):
    return paragraphs(t).selectExpr("doc_id", "pos", "length(paragraph) AS chars", "md5(paragraph) AS digest")


@query("prepare_text", "TXT-03 UDF-07", "select f.doc_id, s.n is null whole_text, case when s.n is null then length(f.text) else s.n end::int chars from filed f left join (select doc_id, length(string_agg(x, chr(10) order by i)) n from section_lines group by 1) s using (doc_id)", "filed section_lines")
def _(t):
    return sections.prepare_text(filed(t)).selectExpr("doc_id", "whole_text", "length(prepared) AS chars")


_stop = str(list(tx.VOCABULARY_STOPWORDS))
view("para_terms", rf"""select doc_id, entity, pos, unnest(list_filter(list_distinct(regexp_extract_all(lower(paragraph), '[a-z][a-z''\-]+')), lambda w: length(w) between 4 and 32 and not list_contains({_stop}, w))) term from paras""", "paras")
view("vocab", "select term, count(distinct entity) entities from para_terms group by 1 having count(distinct entity) >= 2", "para_terms")


@query("vocabulary", "TXT-04", "select term, entities from vocab", "vocab")
def _(t):
    return sections.build_vocabulary(paragraphs(t))


view("para_rarity", """select doc_id, pos, term, case when entities is null then 1.0 else greatest(0.0, least(1.0, ln(n / entities::double) / ln(n::double))) end rarity from para_terms left join vocab using (term),
 (select count(distinct entity) n from paras) where n >= 20""", "para_terms vocab paras")
view("para_rarity_top", "select *, row_number() over (partition by doc_id, pos order by rarity desc, term) r from para_rarity qualify r <= 5", "para_rarity")


def keyed(p):
    return p.withColumn("key", F.concat_ws(":", "doc_id", "pos"))


@query("paragraph_rarity", "TXT-05 TXT-06 UDF-03", f"select doc_id || ':' || pos as key, {R('avg(rarity)', 8)} rarity, string_agg(term, ' ' order by r) unusual_terms from para_rarity_top group by 1", "para_rarity_top")
def _(t):
    p = keyed(paragraphs(t))
    d = sections.paragraph_rarity(sections.term_rarity(p, sections.build_vocabulary(p), "key"), "key")
    return d.select("key", F.round("rarity", 8).alias("rarity"), F.array_join("unusual_terms", " ").alias("unusual_terms"))


def tasks(t):
    return int(t.spark.conf.get("spark.sql.shuffle.partitions", "200"))


def diffs(t):
    """All subsequent filings; text is read once and cut before it is compared both ways."""
    p = cut_lineage(paragraphs(t))
    return p, sections.diff_filings(p, sections.filing_pairs(t.filings))


@query("filing_diff", "TXT-07 TXT-08 JON-16")
def _(t):
    d = sections.changed_paragraphs(diffs(t)[1])
    return d.select("current_id", "prior_id", "side", "place", F.round("similarity", 6).alias("similarity"), F.md5("paragraph").alias("digest"))


@query("filing_changes_with_rarity", "TXT-09")
def _(t):
    p, d = diffs(t)
    k = keyed(p)
    r = sections.paragraph_rarity(sections.term_rarity(k, sections.build_vocabulary(k), "key"), "key")
    r = r.selectExpr("bigint(split(key, ':')[0]) AS doc_id", "int(split(key, ':')[1]) AS pos", "rarity", "unusual_terms")
    top = sections.changed_paragraphs(d, r)
    return top.groupBy("entity", "subtype", "current_id", "side").agg(F.count(F.lit(1)).alias("changed"), F.round(F.max("rank_score"), 6).alias("top_score"),
                                                                     F.max_by(F.array_join("unusual_terms", " "), "rank_score").alias("lead_terms"))


@query("paragraphs_new_word_for_word", "TXT-08", r"""select c.doc_id, count(*) new_paragraphs from (select *, trim(regexp_replace(lower(paragraph), '[^\p{L}\p{N}]+', ' ', 'g')) norm from paras) c
 join (select doc_id, lag(doc_id) over (partition by entity, subtype order by published) prior_id from filings) f on f.doc_id=c.doc_id
 where prior_id is not null and prior_id in (select doc_id from paras) and not exists (select 1 from paras p where p.doc_id=f.prior_id and trim(regexp_replace(lower(p.paragraph), '[^\p{L}\p{N}]+', ' ', 'g')) = c.norm) group by 1""", "paras filings")
def _(t):
    p = paragraphs(t).selectExpr("doc_id", f"{tx.normalise('paragraph')} AS norm")
    pairs = sections.filing_pairs(t.filings).selectExpr("current_id AS doc_id", "prior_id")
    held = p.select(F.col("doc_id").alias("prior_id"), "norm").distinct()
    rows = p.join(pairs, "doc_id").join(held.select("prior_id").distinct(), "prior_id", "left_semi")
    return rows.join(held, ["prior_id", "norm"], "left_anti").groupBy("doc_id").agg(F.count(F.lit(1)).alias("new_paragraphs"))


# ---- search -----------------------------------------------------------------
QUERY = 'tion the anea or erer -thwh "the ing"'


def _stem(w):
    for pattern, put in search.ENDINGS:
        w = f"regexp_replace({w}, '{pattern}', '{put.replace('{1}', chr(92) + '1')}')"
    return w


# Every form of a plain word, written out: what the query's words match, without the rules they are found by.
# A word without a vowel is no stem of a participle, so its forms end in s and e alone.
_FORMS, _BARE = ("", "s", "e", "es", "ed", "ing", "eds", "ings", "eed", "eing", "eeds", "eings"), ("", "s", "e", "es")
_any = lambda *ws: "w in (" + ", ".join(f"'{w}{f}'" for w in ws for f in (_FORMS if set(w) & set("aeiouy") else _BARE)) + ")"
_terms = lambda src: _stem("unnest(regexp_extract_all(lower(" + src + r"), '[\p{L}\p{N}]+'))")
view("postings", f"""select term, doc_id, entity, subtype, field, count(*) tf from (select doc_id, entity, subtype, 'B' field, {_terms('text')} term from filings
 union all select doc_id, entity, subtype, 'A', {_terms('split_part(text, chr(10), 1)')} from filings) where term <> '' group by all""", "filings")


def index(t):
    return search.postings(t.filing_texts.withColumn("title", F.expr(r"substring_index(text, '\n', 1)")), "title", "text")


def stored_index(t):
    """Where the postings of a data directory lie: written by the first query of an application that asks, read by the others."""
    path = f"{checkpoint_dir(t.spark)}/postings-{t.spark.sparkContext.applicationId}-{uuid.uuid5(uuid.NAMESPACE_URL, t.sf_dir).hex}"
    if not exists(t.spark, f"{path}/_SUCCESS"):
        search.write_postings(index(t), path)
    return path


@query("postings_by_document", "TXT-10", "select doc_id, field, count(*) terms, sum(tf)::bigint words from postings group by 1,2", "postings")
def _(t):
    return index(t).groupBy("doc_id", "field").agg(F.count(F.lit(1)).alias("terms"), F.sum("tf").alias("words"))


view("found", f"""select doc_id, published, score, row_number() over (order by score desc, published desc, doc_id) place from (select doc_id, sum(case when base <> 'thwh' then case field when 'A' then 1.0 else 0.4 end * ln(1 + tf) else 0 end) score,
 bool_or(base='tion') a, bool_or(base in ('anea', 'erer')) b, bool_or(base='ing') c, bool_or(base='thwh') x from (select doc_id, field, base, count(*) tf from (select doc_id, field, case when {_any('tion')} then 'tion' when {_any('anea')} then 'anea' when {_any('erer')} then 'erer' when {_any('ing')} then 'ing' else 'thwh' end base from (
 select doc_id, 'B' field, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+')) w from filings union all select doc_id, 'A', unnest(regexp_extract_all(lower(split_part(text, chr(10), 1)), '[\\p{{L}}\\p{{N}}]+')) from filings)
 where {_any('tion', 'anea', 'erer', 'ing', 'thwh')}) group by all) group by 1)
 join filings using (doc_id) where a and b and c and not x qualify place <= 50""", "filings")


@query("text_search", "TXT-11", f"select doc_id, {R('score', 6)} score from found", "found")
def _(t):
    return search.search(search.read_postings(t.spark, stored_index(t), QUERY), t.filings, QUERY, 50).select("doc_id", F.round("score", 6).alias("score"))


# Two phrases, one over a stop word, that many documents hold as passages.
PHRASES = '"attion to thanedble" "anea eriner" -thwh'


def _holds(phrase):
    """Each word of a phrase in any of its forms, one after the other, whatever separates words."""
    forms = lambda w: "(?:" + "|".join(w + f for f in sorted(_FORMS, key=len, reverse=True)) + ")"
    return rf"(?:^|[^\p{{L}}\p{{N}}])" + r"[^\p{L}\p{N}]+".join(r"[\p{L}\p{N}]+" if w in search.QUERY_STOPWORDS else forms(w) for w in phrase.split()) + r"(?:[^\p{L}\p{N}]|$)"


@query("phrase_search", "TXT-11", rf"""select doc_id from filings where regexp_matches(lower(text), '{_holds('attion to thanedble')}') and regexp_matches(lower(text), '{_holds('anea eriner')}')
 and not regexp_matches(lower(text), '(?:^|[^\p{{L}}\p{{N}}])(?:{"|".join("thwh" + f for f in _BARE)})(?:[^\p{{L}}\p{{N}}]|$)')""", "filings")
def _(t):
    d = search.read_postings(t.spark, stored_index(t), PHRASES)
    return search.search(d, t.filings, PHRASES, None).select("doc_id")


view("snippet_words", """select doc_id, term, unnest(spots) spot from (select doc_id, term, list_transform(generate_series(1, len(p) - 1), lambda i: list_sum(list_transform(p[:i], lambda x: length(x))) + (i - 1) * length(term)) spots from (
 select doc_id, term, string_split(lower(text), term) p from (select doc_id, text, unnest(['the', 'ing', 'tion', 'anea', 'erer', 'thwh']) term from found join filings using (doc_id)) where contains(lower(text), term)))""", "found filings")
view("snippet_spots", "select a.doc_id, a.spot, count(distinct b.term) n from snippet_words a join snippet_words b on a.doc_id=b.doc_id and b.spot between a.spot and a.spot + 160 group by 1,2", "snippet_words")


@query("search_snippets", "TXT-12", r"""select doc_id, case when spot > 160 then '…' else '' end || trim(regexp_replace(substring(text, greatest(spot - 160, 0)::int + 1, (least(spot + 160, length(text)) - greatest(spot - 160, 0))::int), '\s+', ' ', 'g'))
 || case when spot + 160 < length(text) then '…' else '' end snippet from (select doc_id, text, coalesce(nullif(instr(lower(text), 'the ing'), 0) - 1, dense) spot from found join filings using (doc_id)
 left join (select doc_id, arg_max(spot, n * 10000000 - spot) dense from snippet_spots group by 1) using (doc_id))""", "found filings snippet_spots")
def _(t):
    hits = search.search(search.read_postings(t.spark, stored_index(t), QUERY), t.filings, QUERY, 50)
    return search.snippets(t.filings.join(F.broadcast(hits.select("doc_id")), "doc_id", "left_semi").select("doc_id", "text"), QUERY)


@query("quotes_in_source", "TXT-13", "select item_id quote_id, doc_id from benchmark b join documents d on contains(d.text, b.text)")
def _(t):
    return search.quotes_in_source(t.benchmark.selectExpr("item_id AS quote_id", "text AS quote"), t.filing_texts)


view("host_names", r"select distinct regexp_extract(url, '//(?:www\.|m\.)?([a-z]+)\.example', 1) entity_name, 'src' || length(regexp_extract(url, '//(?:www\.|m\.)?([a-z]+)\.example', 1)) own from pages where regexp_extract(url, '//(?:www\.|m\.)?([a-z]+)\.example', 1) <> ''")


AS_OF_MENTIONS = "2020-07-01"


@query("mentions_by_filer", "TXT-16 SRC-16", rf"""select entity_name, filer, arg_max(doc_id, doc_id) doc_id from (select entity_name, own, entity filer, doc_id from host_names join (
 select doc_id, entity, unnest(list_distinct(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+'))) w from filings
 where published <= date '{AS_OF_MENTIONS}' and published > date '{AS_OF_MENTIONS}' - 30 and length(text) >= 400) on w=entity_name) where own is distinct from filer group by 1,2""", "host_names filings")
def _(t):
    names = t.pages.selectExpr(r"regexp_extract(url, '//(?:www\\.|m\\.)?([a-z]+)\\.example', 1) AS entity_name").filter("entity_name <> ''").distinct()
    return search.mentions(names.withColumn("own", F.expr("concat('src', length(entity_name))")), t.filing_texts, AS_OF_MENTIONS)


# ---- quotes cited by documents -------------------------------------------------
def cited(t):
    """A quote per filing: its longest line, every third one altered, every third one taken from the filing before."""
    longest = r"array_max(transform(split(text, '\n'), x -> struct(length(x) AS n, x AS x))).x"
    d = t.filing_texts.selectExpr("doc_id", "entity", "subtype", "published", "text", f"{longest} AS line")
    prior = sections.filing_pairs(t.filings).selectExpr("current_id AS doc_id", "prior_id")
    back = d.selectExpr("doc_id AS prior_id", "line AS prior_line", "text AS prior_text")
    d = d.join(prior, "doc_id", "left").join(back, "prior_id", "left")
    return d.withColumn("quote", F.expr("CASE doc_id % 3 WHEN 0 THEN line WHEN 1 THEN coalesce(prior_line, line) ELSE concat(substring(line, 1, 70), ' zz ', substring(line, 71, length(line))) END"))


view("cited", r"""select d.*, p.line prior_line, p.text prior_text, case d.doc_id % 3 when 0 then d.line when 1 then coalesce(p.line, d.line) else substring(d.line, 1, 70) || ' zz ' || substring(d.line, 71) end quote from (
 select f.*, lag(doc_id) over (partition by entity, subtype order by published) prior_id, (select max(struct_pack(n := length(u), x := u)).x from (select unnest(string_split(f.text, chr(10))) u)) line from filings f) d
 left join (select f.doc_id, f.text, (select max(struct_pack(n := length(u), x := u)).x from (select unnest(string_split(f.text, chr(10))) u)) line from filings f) p on p.doc_id=d.prior_id""", "filings")

_dig = "length(regexp_replace(quote, '[^0-9]', '', 'g')) / greatest(length(quote), 1)::double > 0.15"


@query("faithfulness_checks", "DQ-03 TXT-13 FN-27", f"""select kind, chk, count(*) filter (ok) passed, count(*) filter (not ok) failed, count(*) filter (ok is null) not_applicable from (
 select subtype kind, unnest(['quote_verbatim_prose', 'quote_verbatim_tabular', 'provenance_resolvable', 'not_future_dated']) chk,
 unnest([case when length(quote) >= 40 and not ({_dig}) then contains(text, quote) or coalesce(contains(prior_text, quote), false) end,
  case when length(quote) >= 40 and ({_dig}) then contains(text, quote) or coalesce(contains(prior_text, quote), false) end, length(text) > 0, published <= date '2023-06-30']) ok from cited) group by 1,2""", "cited")
def _(t):
    seen = "contains(text, quote) OR coalesce(contains(prior_text, quote), false)"
    tab = tx.is_tabular("quote")
    d = cited(t).selectExpr("subtype AS kind", "inline(array("
                            f"struct('quote_verbatim_prose' AS chk, CASE WHEN length(quote) >= 40 AND NOT {tab} THEN {seen} END AS ok),"
                            f"struct('quote_verbatim_tabular' AS chk, CASE WHEN length(quote) >= 40 AND {tab} THEN {seen} END AS ok),"
                            "struct('provenance_resolvable' AS chk, length(text) > 0 AS ok), struct('not_future_dated' AS chk, published <= date'2023-06-30' AS ok)))")
    return d.groupBy("kind", "chk").agg(F.count_if("ok").alias("passed"), F.count_if(~F.col("ok")).alias("failed"), F.count_if(F.col("ok").isNull()).alias("not_applicable"))


_ws = lambda c: rf"list_filter(string_split_regex({c}, '\s+'), lambda x: x <> '')"
view("misses", f"select doc_id, {_ws('quote')} q, {_ws('text')} t from cited where length(quote) >= 40 and not contains(text, quote) and not coalesce(contains(prior_text, quote), false)", "cited")
view("run_words", """select doc_id, i, count(*) over (partition by doc_id, shift, g) n from (select doc_id, i, j - i shift, i - row_number() over (partition by doc_id, j - i order by i) g from
 (select doc_id, unnest(q) w, generate_subscripts(q, 1) i from misses) join (select doc_id, unnest(t) w, generate_subscripts(t, 1) j from misses) using (doc_id, w))""", "misses")


def misses(t):
    return cited(t).filter("length(quote) >= 40 AND NOT contains(text, quote) AND NOT coalesce(contains(prior_text, quote), false)")


@query("quote_coverage_of_misses", "TXT-14", f"""select doc_id, {R('covered', 6)} covered, covered >= 0.97 accepted from (select doc_id, coalesce(n, 0) / greatest(len(q), 1)::double covered
 from misses left join (select doc_id, count(distinct i) n from run_words where n >= 4 group by 1) using (doc_id))""", "misses run_words")
def _(t):
    d = search.quote_coverage(misses(t), "doc_id", "quote", "text")
    return d.select("doc_id", F.round("covered", 6).alias("covered"), (F.col("covered") >= 0.97).alias("accepted"))


@query("missed_quote_causes", "DQ-06", r"""select doc_id, case when coalesce(contains(prior_text, quote), false) then 'wrong_document' when contains(text, substring(quote, 1, 60)) then 'truncated_tail'
 when contains(text, trim(substring(quote, 1, length(quote) // 2))) and contains(text, trim(substring(quote, length(quote) // 2 + 1))) then 'stitched'
 when len(list_filter(w, lambda x: contains(lower(text), x))) >= 0.5 * len(w) and len(w) > 0 then 'paraphrased' else 'absent' end cause
 from (select *, list_distinct(regexp_extract_all(lower(quote), '[a-z]{4,}')) w from cited) where length(quote) >= 40 and not contains(text, quote)""", "cited")
def _(t):
    miss = cited(t).filter("length(quote) >= 40 AND NOT contains(text, quote)").withColumn("w", F.expr("array_distinct(regexp_extract_all(lower(quote), '[a-z]{4,}', 0))"))
    half = "int(length(quote) DIV 2)"
    return miss.selectExpr("doc_id", "CASE WHEN coalesce(contains(prior_text, quote), false) THEN 'wrong_document' WHEN contains(text, substring(quote, 1, 60)) THEN 'truncated_tail'"
                           f" WHEN contains(text, trim(substring(quote, 1, {half}))) AND contains(text, trim(substring(quote, {half} + 1, length(quote)))) THEN 'stitched'"
                           " WHEN size(w) > 0 AND size(filter(w, x -> contains(lower(text), x))) >= 0.5 * size(w) THEN 'paraphrased' ELSE 'absent' END AS cause")


@query("longest_match_of_misses", "DQ-06", "select doc_id, coalesce(n, 0)::bigint longest, len(q)::int quote_words from misses left join (select doc_id, max(n) n from run_words group by 1) using (doc_id)", "misses run_words")
def _(t):
    return search.quote_coverage(misses(t), "doc_id", "quote", "text").select("doc_id", "longest", "quote_words")


@query("grounded_citations", "TXT-15", r"""select entity, count(*) citations, count(*) filter (contains(body, substring(norm, 1, 80))) verbatim, count(distinct case when contains(body, substring(norm, 1, 80)) then substring(norm, 1, 80) end) unique_findings
 from (select entity, trim(regexp_replace(lower(quote), '\s+', ' ', 'g')) norm, trim(regexp_replace(lower(text), '\s+', ' ', 'g')) body from cited) group by 1""", "cited")
def _(t):
    d = cited(t).selectExpr("entity", r"trim(regexp_replace(lower(quote), '\\s+', ' ')) AS norm", r"trim(regexp_replace(lower(text), '\\s+', ' ')) AS body").withColumn("s", F.substring("norm", 1, 80))
    hit = F.contains("body", F.col("s"))
    return d.groupBy("entity").agg(F.count(F.lit(1)).alias("citations"), F.count_if(hit).alias("verbatim"), F.countDistinct(F.when(hit, F.col("s"))).alias("unique_findings"))


@query("stale_findings_revalidated", "DQ-04")
def _(t):
    """Paragraph findings of the newer filing whose paragraph now matches the one before."""
    d = diffs(t)[1].filter("side = 'added'")
    return d.groupBy("entity", "subtype").agg(F.count(F.lit(1)).alias("paragraphs"), F.count_if(F.col("similarity") >= sections.SIMILARITY_THRESHOLD).alias("stale"))


_norm = lambda c: f"trim(regexp_replace(lower({c}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"
view("para_norms", f"select doc_id, pos, {_norm('paragraph')} norm from paras", "paras")
view("para_priors", """select p.doc_id, p.pos, p.norm, exists (select 1 from para_norms q where q.doc_id=f.prior_id and q.norm=p.norm) verbatim from para_norms p
 join (select doc_id, lag(doc_id) over (partition by entity, subtype order by published) prior_id from filings) f using (doc_id) where prior_id in (select doc_id from para_norms)""", "para_norms filings")


# How alike two paragraphs are has no twin; who is compared, and that a paragraph standing word for word is no new one, has.
@query("quote_placements", "DQ-03", f"""select c.doc_id, h.pos, p.doc_id is not null decided, coalesce(p.verbatim, false) verbatim, case when p.verbatim then false end placed_verbatim from cited c
 left join (select c.doc_id, min(n.pos) pos from cited c join para_norms n on n.doc_id=c.doc_id and contains(n.norm, {_norm('c.quote')}) group by 1) h on h.doc_id=c.doc_id left join para_priors p on p.doc_id=h.doc_id and p.pos=h.pos""", "cited para_norms para_priors")
def _(t):
    p, d = diffs(t)
    got = sections.quote_placements(cited(t).select("doc_id", "quote"), p, sections.similarity_to_prior(p, sections.filing_pairs(t.filings), d))
    return got.select("doc_id", "pos", F.col("placed").isNotNull().alias("decided"), F.coalesce(F.col("similarity") == 1, F.lit(False)).alias("verbatim"),
                      F.when(F.col("similarity") == 1, F.col("placed")).alias("placed_verbatim"))


@query("revalidated_paragraphs", "DQ-04", """select n.doc_id, n.pos, case when p.doc_id is null then 'unreconstructible' when p.verbatim then 'stale' else 'compared' end verdict from para_norms n left join para_priors p using (doc_id, pos)""", "para_norms para_priors")
def _(t):
    p, d = diffs(t)
    got = sections.revalidated(p.select("doc_id", "pos"), sections.similarity_to_prior(p, sections.filing_pairs(t.filings), d))
    return got.select("doc_id", "pos", F.when((F.col("verdict") == "unreconstructible") | (F.col("similarity") == 1), F.col("verdict")).otherwise("compared").alias("verdict"))


@query("direction_checks", "DQ-03", "select finding_id, sign is not distinct from -1.0 consistent from signed where finding_type = 'new_risk_factor'", "signed")
def _(t):
    from pitlens.plans.finding_queries import signed
    # the sign that a kind of finding must have
    want = F.when(F.col("finding_type") == "new_risk_factor", -1.0).when(F.col("finding_type") == "resolved_risk_factor", 1.0)
    return signed(t).withColumn("_want", want).filter("_want IS NOT NULL").select("finding_id", F.col("sign").eqNullSafe(F.col("_want")).alias("consistent"))


@query("text_date_audit", "DQ-02", r"""select doc_id, bool_or(d > published) future_dated, count(*) dates from (select doc_id, published, try_cast(unnest(regexp_extract_all(stamped, '\b\d{4}-\d{2}-\d{2}\b')) as date) d
 from (select *, text || ' filed ' || (published + ((doc_id % 5)::int - 3))::date stamped from filings)) where d is not null group by 1""", "filings")
def _(t):
    d = t.filings.selectExpr("doc_id", "published", "concat(text, ' filed ', date_add(published, int(doc_id % 5) - 3)) AS stamped")
    d = d.selectExpr("doc_id", "published", r"filter(transform(regexp_extract_all(stamped, '\\b\\d{4}-\\d{2}-\\d{2}\\b', 0), x -> try_to_date(x)), x -> x IS NOT NULL) AS ds").filter("size(ds) > 0")
    return d.selectExpr("doc_id", "exists(ds, x -> x > published) AS future_dated", "bigint(size(ds)) AS dates")
