"""Landed payloads rebuilt from the tables, flattened again; sinks shown by their final state."""

import uuid
from functools import reduce

from pyspark.sql import functions as F

from pitlens.functions import text as tx
from pitlens.plans.aggregate_queries import trades
from pitlens.plans.brief_queries import earnings
from pitlens.plans.registry import query
from pitlens.plans.scoring import QUARTERLY, scored
from pitlens.plans.views import R, view
from pitlens.session import checkpoint_dir, cut_lineage, spread
from pitlens.sources import html, landed, sinks


def scratch(t):
    return f"{checkpoint_dir(t.spark)}/tables-{uuid.uuid4().hex}"


def companyfacts(t):
    """One nested document per filer, as a filer's fact file lays it out."""
    concept = "CASE metric " + " ".join(f"WHEN '{m}' THEN '{c[-1]}'" for m, c in landed.CONCEPTS.items()) + f" ELSE '{landed.SHARES_CONCEPT}' END"
    start = "CASE period WHEN 'year' THEN string(trunc(period_end, 'year')) WHEN 'quarter' THEN string(trunc(period_end, 'quarter')) END"
    obs = f"struct({start} AS start, string(period_end) AS end, value AS val, string(filed_on) AS filed, CASE period WHEN 'year' THEN '10-K' ELSE '10-Q' END AS form, concat('a', entity_id) AS accn)"
    d = t.facts.selectExpr("entity_id", "CASE WHEN metric = 'shares_outstanding' THEN 'dei' ELSE 'us-gaap' END AS taxonomy", f"{concept} AS concept", f"{obs} AS o")
    d = d.groupBy("entity_id", "taxonomy", "concept").agg(F.expr("struct(map('USD', collect_list(o)) AS units) AS c"))
    d = d.groupBy("entity_id", "taxonomy").agg(F.expr("map_from_entries(collect_list(struct(concept, c))) AS concepts"))
    return d.groupBy("entity_id").agg(F.expr("to_json(struct(map_from_entries(collect_list(struct(taxonomy, concepts))) AS facts)) AS payload"))


@query("flattened_companyfacts", "SRC-01 SRC-02 UDF-06", f"select entity_id, metric, period, period_end::varchar period_end, filed_on::varchar filed_on, {R('value', 5)} as value from facts where year(filed_on) >= 1996", "facts")
def _(t):
    d = landed.flatten_companyfacts(companyfacts(t), "entity_id", "payload", this_year=2012)
    return d.select("entity_id", "metric", "period", "period_end", "filed_on", F.round("value", 5).alias("value"))


@query("insider_transactions", "SRC-03", f"select finding_id, owner, disposed, case when disposed then -shares else shares end shares, open_market is_open_market, {R('shares * 1000', 2)} value_usd from trades", "trades")
def _(t):
    v = lambda n, x: f"'<{n}><value>', {x}, '</value></{n}>'"
    xml = ("concat('<ownershipDocument><reportingOwner><reportingOwnerId><rptOwnerName>', owner, '</rptOwnerName></reportingOwnerId><reportingOwnerRelationship><isOfficer>1</isOfficer></reportingOwnerRelationship></reportingOwner>"
           "<nonDerivativeTable><nonDerivativeTransaction>', " + v("transactionDate", "string(day)") + ", '<transactionCoding><transactionCode>', CASE WHEN open_market THEN 'S' ELSE 'M' END, '</transactionCode></transactionCoding><transactionAmounts>', "
           + v("transactionShares", "string(shares)") + ", " + v("transactionPricePerShare", "'1000'") + ", " + v("transactionAcquiredDisposedCode", "CASE WHEN disposed THEN 'D' ELSE 'A' END")
           + ", '</transactionAmounts></nonDerivativeTransaction></nonDerivativeTable></ownershipDocument>')")
    d = landed.insider_transactions(trades(t).selectExpr("finding_id", f"{xml} AS xml"), "finding_id", "xml")
    return d.select("finding_id", "owner", "disposed", "shares", "is_open_market", F.round("value_usd", 2).alias("value_usd"))


@query("short_interest_rows", "SRC-04", "select brand, session_date::varchar settled, volume as position, case when volume % 2 = 0 then volume / 2 end days_to_cover from bars where volume % 5 <> 0", "bars")
def _(t):
    line = "concat_ws(',', session_date, CASE WHEN volume % 5 = 0 THEN 'n/a' ELSE string(volume) END, '', CASE WHEN volume % 2 = 0 THEN string(volume / 2) ELSE 'null' END, '1.5')"
    return landed.short_interest(t.bars.selectExpr("brand", f"{line} AS line"), "brand", "line").select("brand", "settled", "position", "days_to_cover")


@query("earnings_event_rows", "SRC-05", "select o_orderkey, report_date::varchar report_date, reported, case when reported and eps_estimate <> 0 then (round((eps_actual - eps_estimate) / abs(eps_estimate) * 100, 2) + 0.0) end surprise_percent, ['before market open', 'after market close', null][o_orderkey % 3 + 1] hour_label from earnings_raw", "earnings_raw")
def _(t):
    d = earnings(t).selectExpr("o_orderkey", "to_json(struct(string(report_date) AS date, eps_estimate AS epsEstimate, eps_actual AS epsActual, element_at(array('bmo', 'AMC', 'x'), int(o_orderkey % 3) + 1) AS hour)) AS payload")
    return landed.earnings_events(d, "o_orderkey", "payload").select("o_orderkey", "report_date", "reported", "surprise_percent", "hour_label")


@query("bars_from_charts", "SRC-06", f"select brand, session_date::varchar session_date, {R('close + 1e-9', 6)} as close, {R('case when volume % 7 = 0 then close else adjusted_close end + 1e-9', 6)} adjusted_close, volume from bars where volume % 11 <> 0", "bars")
def _(t):
    # one document per series and year: a chart is bounded by its calendar
    row = "struct(unix_timestamp(timestamp(session_date)) AS s, CASE WHEN volume % 11 <> 0 THEN close END AS c, CASE WHEN volume % 7 <> 0 THEN adjusted_close END AS a, volume AS v)"
    d = t.bars.groupBy("brand", F.year("session_date").alias("y")).agg(F.expr(f"array_sort(collect_list({row})) AS r")).selectExpr(
        "brand", "to_json(struct(transform(r, x -> x.s) AS timestamp, transform(r, x -> x.c) AS close, transform(r, x -> x.a) AS adjclose, transform(r, x -> x.v) AS volume), map('ignoreNullFields', 'false')) AS payload")
    d = landed.bars_from_chart(d, "brand", "payload")
    return d.select("brand", "session_date", F.round(F.col("close") + 1e-9, 6).alias("close"), F.round(F.col("adjusted_close") + 1e-9, 6).alias("adjusted_close"), "volume")


@query("intraday_change", "SRC-07", f"""select entity_id, count(*) points, {R('arg_max(value, occurred_at) - arg_min(value, occurred_at)', 6)} change, {R('(arg_max(value, occurred_at) / arg_min(value, occurred_at) - 1) * 100', 4)} change_percent from (
 select f.*, row_number() over (partition by entity_id order by occurred_at desc) r from findings f join (select entity_id, max(occurred_at) m from findings group by 1) using (entity_id) where occurred_at > m - interval 5 day) group by 1 having count(*) >= 2""", "findings")
def _(t):
    d = landed.intraday_change(t.findings.select("entity_id", "occurred_at", "value"), "entity_id", "occurred_at", "value", "1W").filter("points >= 2")
    # half-way percents settle on the product in doubles, as in the twin
    return d.select("entity_id", "points", F.round("change", 6).alias("change"), (F.round(F.col("change_percent") * 10_000, 0) / 10_000).alias("change_percent"))


@query("filing_index_rows", "SRC-08 SRC-21", "select entity, form, filed::varchar filed, url from (select entity, subtype form, published filed, 'a' || doc_id || '/d' || doc_id || '.htm' url from filings where subtype in ('en','fr') and doc_id % 9 <> 0 and doc_id not in (select doc_id from labels)) qualify row_number() over (partition by entity order by filed desc, form <> 'en', url) <= 5", "filings")
def _(t):
    row = "struct(published AS d, subtype AS f, concat('a', doc_id) AS a, CASE WHEN doc_id % 9 <> 0 THEN concat('d', doc_id, '.htm') ELSE '' END AS p)"
    d = t.filings.groupBy("entity", F.year("published").alias("y")).agg(F.expr(f"collect_list({row}) AS r")).selectExpr(
        "entity", "to_json(struct(transform(r, x -> x.f) AS form, transform(r, x -> string(x.d)) AS filingDate, transform(r, x -> x.a) AS accessionNumber, transform(r, x -> x.p) AS primaryDocument)) AS payload")
    held = t.labels.selectExpr("concat('a', doc_id, '/d', doc_id, '.htm') AS url")
    return landed.filing_index_rows(d, "entity", "payload", "en", "fr", 5, held).select("entity", "form", "filed", "url")


def page_views(prefix, source, elements):
    """Pages cut into tags and stretches; what an element covers comes from running depths of its name, not from a pattern."""
    tag = html.TAG.replace("'", "''")
    names = ", ".join(f"'{e}'" for e in elements)
    void = ", ".join(f"'{e}'" for e in html.VOID)
    view(f"{prefix}_tags", f"select page_id, unnest(tags) tag, generate_subscripts(tags, 1) - 1 i from (select page_id, regexp_extract_all(html, '{tag}') tags from {source})", source if source != "pages" else "")
    view(f"{prefix}_stretches", f"select page_id, unnest(x) x, generate_subscripts(x, 1) - 1 i from (select page_id, string_split_regex(html, '{tag}') x from {source})", source if source != "pages" else "")
    view(f"{prefix}_marks", rf"""select *, sum(kind) over (partition by page_id, name order by i) depth from (select *, case when name = '' or name in ({void}) then 0 when tag like '</%' then -1 when name in ('script', 'style') and tag like '%</' || name || '>' then 0 else 1 end kind
 from (select page_id, i, tag, lower(regexp_extract(tag, '^</?([a-zA-Z][^\s/>]*)', 1)) name from {prefix}_tags))""", f"{prefix}_tags")
    furniture = rf"regexp_matches(o.tag, '(?i)\s(class|id)=[^>]*({'|'.join(html.NOISE_CLASSES)})')" if elements is html.NOISE else "false"
    view(f"{prefix}_covered", rf"""select o.page_id, o.i a, coalesce(min(c.i), max(o.top) + 1) b from (select *, max(i) over (partition by page_id) top from {prefix}_marks) o left join {prefix}_marks c on c.page_id = o.page_id and c.name = o.name and c.i > o.i and c.depth < o.depth
 where o.kind = 1 and (o.name in ({names}) or regexp_matches(o.tag, '(?i)\s(hidden[\s=/>]|style\s*=\s*"[^"]*display\s*:\s*none)') or {furniture}) group by 1, 2""", f"{prefix}_marks")
    view(f"{prefix}_lines", rf"""select page_id, i, x from (select page_id, i, regexp_replace({_plain("x")}, '^[\s\x{{00a0}}]+|[\s\x{{00a0}}]+$', '', 'g') x from {prefix}_stretches s
 where not exists (select 1 from {prefix}_covered c where c.page_id = s.page_id and s.i > c.a and s.i <= c.b)) where x <> ''""", f"{prefix}_stretches {prefix}_covered")


def _plain(column):
    """The named characters that the pages hold, the ampersand last."""
    for name, sign in (("copy", "©"), ("middot", "·"), ("quot", '"'), ("lt", "<"), ("gt", ">"), ("nbsp", chr(160)), ("amp", "&")):
        column = f"replace({column}, '&{name};', '{sign}')"
    return column


# Blocks that hide others and references of all kinds, put before an article's text, and what shows of them.
_HIDING = '<div hidden><div>menu <div>inner</div></div>secret</div><span style="color:red;display : none"><span>a</span>b</span>'
_FURNITURE = '<div class="x related-links"><div>promo</div>more</div>'
_MARKED, _SHOWN = "<p>it&#x27;s &#128512; caf&eacute; &#937;&hellip;</p>", "<p>it''s 😀 café Ω…</p>"
view("shown_pages", f"select page_id, replace(html, '<article>', '<article>{_SHOWN}') html from pages")
view("furnished_pages", f"select page_id, replace(html, '<article>', '{_FURNITURE}<article>{_SHOWN}') html from pages")
for _prefix, _source, _elements in (("page", "pages", html.DROPPED), ("body", "pages", html.NOISE), ("shown", "shown_pages", html.NOISE), ("furnished", "furnished_pages", html.DROPPED)):
    page_views(_prefix, _source, _elements)


def marked_pages(t, opening, closing):
    return spread(t.pages).select("page_id", F.replace(F.replace("html", F.lit("<article>"), F.lit(opening)), F.lit("</article>"), F.lit(closing)).alias("html"))


_LINES = "select page_id, length(t)::int chars, md5(t) digest from (select page_id, coalesce(t, '') t from pages left join (select page_id, string_agg(x, chr(10) order by i) t from {} group by 1) using (page_id))"


@query("page_texts", "SRC-09", _LINES.format("page_lines"), "page_lines")
def _(t):
    return spread(t.pages).select("page_id", html.html_to_text("html").alias("text")).selectExpr("page_id", "length(text) AS chars", "md5(text) AS digest")


@query("page_texts_nested", "SRC-09", _LINES.format("furnished_lines"), "furnished_lines")
def _(t):
    d = marked_pages(t, f"{_HIDING}{_FURNITURE}<article>{_MARKED}", "</article>")
    return d.select("page_id", html.html_to_text("html").alias("text")).selectExpr("page_id", "length(text) AS chars", "md5(text) AS digest")


def _bodies(prefix):
    """Lines between the article's tags or, without 600 characters there, paragraphs of more than 80."""
    return rf"""select page_id, case when paywalled then 'paywalled' when length(body) >= 600 then 'fetched' else 'too_short' end outcome, case when not paywalled and length(body) >= 600 then md5(body) end digest from (
 select page_id, body, {" or ".join(f"contains(lower(substring(body, 1, 1200)), '{m}')" for m in html.PAYWALL_MARKERS)} paywalled from (select page_id, case when length(article) >= 600 then article else coalesce(paragraphs, '') end body from pages
 left join (select page_id, trim(regexp_replace(string_agg(x, chr(10) order by l.i), '[ \t]+', ' ', 'g')) article from {prefix}_lines l join (
  select o.page_id, o.i a, min(c.i) b from {prefix}_marks o join {prefix}_marks c on c.page_id=o.page_id and c.name='article' and c.i > o.i and c.depth < o.depth where o.name='article' and o.kind=1 group by 1, 2) s using (page_id) where l.i > a and l.i <= b group by 1) using (page_id)
 left join (select page_id, string_agg(x, chr(10) || chr(10) order by p) paragraphs from (select page_id, p, trim(regexp_replace(string_agg(x, ' ' order by i), '[ \t]+', ' ', 'g')) x from (
  select l.page_id, l.i, l.x, max(m.i) p, arg_max(m.kind, m.i) kind from {prefix}_lines l join {prefix}_marks m on m.page_id=l.page_id and m.name='p' and m.i < l.i group by 1, 2, 3) where kind = 1 group by 1, 2) where length(x) > 80 group by 1) using (page_id)))"""


@query("article_bodies", "SRC-19", _bodies("body"), "body_lines body_marks")
def _(t):
    return spread(t.pages).select("page_id", html.article_body("html").alias("a")).selectExpr("page_id", "a.outcome AS outcome", "md5(a.text) AS digest")


@query("article_bodies_by_container", "SRC-19", _bodies("shown"), "shown_lines shown_marks")
def _(t):
    d = marked_pages(t, f"<div data-x='1' itemprop='articleBody'><div>{_HIDING}{_FURNITURE}{_MARKED}", "</div></div>")
    return d.select("page_id", html.article_body("html").alias("a")).selectExpr("page_id", "a.outcome AS outcome", "md5(a.text) AS digest")


@query("assembled_exhibits", "SRC-10", "select conv_id, count(*) exhibits, md5(string_agg(substring(text, 1, greatest(0, 150000 - run + length(text))::int), chr(10) || chr(10) order by turn)) digest from (select *, sum(length(text)) over (partition by conv_id order by turn rows unbounded preceding) run from conversations where role <> 'system') where run - length(text) < 150000 group by 1")
def _(t):
    d = t.conversations.selectExpr("conv_id", "int(turn) AS seq", "CASE role WHEN 'user' THEN 'EX-99.1' WHEN 'assistant' THEN 'EX-99' ELSE 'EX-101.INS' END AS type", "text")
    return landed.assemble_exhibits(d, "conv_id").select("conv_id", "exhibits", F.md5("body").alias("digest"))


@query("filing_items", "SRC-10 SRC-11", "select doc_id, (doc_id % 3 + 1)::varchar || '.02|9.01' items, doc_id % 3 = 1 is_results, 'EX-99.' || doc_id % 4 exhibit from filings", "filings")
def _(t):
    header = r"concat('<TYPE>EX-99.', doc_id % 4, '\n<SEQUENCE>2\n<FILENAME>x.htm\n<ITEMS>', doc_id % 3 + 1, '.02\n<ITEMS>9.01\n')"
    d = t.filings.selectExpr("doc_id", f"{header} AS header").selectExpr("doc_id", f"{landed.filing_items('header')} AS items", f"{landed.exhibit_entries('header')} AS entries")
    return d.selectExpr("doc_id", "array_join(items, '|') AS items", "array_contains(items, '2.02') AS is_results", "entries[0].type AS exhibit")


@query("acceptance_notices", "SRC-12", "select 'acc' || (finding_id // 2) accession, lpad(min(entity_id)::varchar, 10, '0') cik, arg_max(case when finding_id % 2 = 0 then '10-K' else '8-K/A' end, finding_id) form from findings where finding_id // 2 in (select finding_id // 2 from findings group by 1 having count(distinct entity_id) = 1) group by 1", "findings")
def _(t):
    one = t.findings.withColumn("g", F.expr("finding_id DIV 2"))
    keep = one.groupBy("g").agg(F.countDistinct("entity_id").alias("n")).filter("n = 1").select("g")
    d = one.join(keep, "g", "left_semi").selectExpr("concat(CASE WHEN finding_id % 2 = 0 THEN '10-K' ELSE '8-K/A' END, ' - Customer ', entity_id, ' (', lpad(string(entity_id), 10, '0'), ') (Filer)') AS title",
                                                    "concat('/Archives/', entity_id, '/acc', g, '-index.htm') AS link", "string(occurred_at) AS updated", "-finding_id AS at")
    return landed.acceptance_notices(d, "title", "link", "updated", "at").select("accession", "cik", "form")


@query("news_items", "SRC-13 FN-06 FN-07", "select doc_id from filings where n > 0 and length(text) >= 120".replace("n > 0 and ", "doc_id % 4 <> 3 and "), "filings")
def _(t):
    head = "CASE WHEN doc_id % 4 = 3 THEN 'Markets rally' ELSE concat(upper(entity), ' Corp. reports &amp; explains') END"
    d = t.filings.selectExpr("doc_id", f"{tx.core_name('concat(entity, chr(32), chr(67), chr(111), chr(46))')} AS name", "upper(entity) AS ticker",
                             f"to_json(struct({head} AS headline, text AS summary, doc_id AS datetime, 'u' AS url)) AS payload")
    return landed.news_items(d, "doc_id", "payload", F.col("name"), F.col("ticker")).select("doc_id")


@query("peer_frame", "SRC-14", f"select lpad(entity_id::varchar, 10, '0') cik, {R('max(value) filter (metric=$$revenue$$)', 5)} revenue, {R('max(value) filter (metric=$$net_income$$)', 5)} net_income from facts where period='year' and period_end = date '1999-12-31' and metric in ('revenue','net_income') group by 1".replace("$$", "'"), "facts")
def _(t):
    d = landed.peer_frame(t.facts, ["revenue", "net_income"], "year", "1999-12-31")
    return d.select("cik", F.round("revenue", 5).alias("revenue"), F.round("net_income", 5).alias("net_income"))


@query("search_hits", "SRC-15", "select '0-' || doc_id accession, lpad((doc_id % 97)::varchar, 10, '0') cik, (doc_id % 97) || '/0' || doc_id || '/d.htm' path from filings where doc_id % 6 <> 0", "filings")
def _(t):
    d = t.filings.selectExpr("to_json(named_struct('_id', CASE WHEN doc_id % 6 = 0 THEN 'broken' ELSE concat('0-', doc_id, ':d.htm') END, '_source', named_struct('ciks', array(string(doc_id % 97)), 'root_forms', array('10-K'), 'file_date', string(published)))) AS payload")
    return landed.search_hits(d, "payload").select("accession", "cik", "path")


@query("seeded_universe", "SRC-17", "select entity_id::varchar cik, 'T' || entity_id ticker from entities where entity_id % 3 <> 2 and length('T' || entity_id || case when entity_id % 10 = 7 then '-W' else '' end) <= 6 and entity_id % 10 <> 7", "entities")
def _(t):
    # a directory page holds a thousand filers, so the listing is many documents
    row = "array(string(entity_id), name, concat('T', entity_id, CASE WHEN entity_id % 10 = 7 THEN '-W' ELSE '' END), element_at(array('NYSE', 'Nasdaq', 'OTC'), int(entity_id % 3) + 1))"
    d = t.entities.groupBy(F.floor(F.col("entity_id") / 1000).alias("page")).agg(F.expr(f"array_sort(collect_list(struct(entity_id, {row} AS r))) AS rows")).selectExpr(
        "page", "to_json(struct(array('cik', 'name', 'ticker', 'exchange') AS fields, transform(rows, x -> x.r) AS data)) AS payload")
    return landed.seed_universe(d, "page", "payload", ("NYSE", "Nasdaq")).select("cik", "ticker")


_sic = "case " + " ".join(f"when sic between {a} and {b} then '{s}'" for a, b, s in landed.SIC_RANGES) + " end"


@query("backfilled_sectors", "SRC-18 FN-01", f"select entity_id, coalesce(case when entity_id % 4 = 0 then sector end, {_sic}) sector from (select *, 100 + (entity_id * 37) % 8900 sic from entities)", "entities")
def _(t):
    d = t.entities.selectExpr("entity_id", "CASE WHEN entity_id % 4 = 0 THEN sector END AS sector", "string(100 + (entity_id * 37) % 8900) AS sic")
    return d.selectExpr("entity_id", f"coalesce(sector, {landed.sector_for_sic('sic')}) AS sector")


@query("transcript_index", "SRC-20", "select distinct 'ABC' ticker, day::varchar held_on, 'Q' || (entity_id % 4 + 1) || ' 2023' as quarter from findings where entity_id % 2 = 0 and day >= date '2023-12-15'", "findings")
def _(t):
    d = t.findings.selectExpr("CASE WHEN entity_id % 2 = 0 THEN concat('https://example.com/earnings/call-transcripts/', date_format(day, 'yyyy/MM/dd'), '/some-name-abc-q', entity_id % 4 + 1, '-2023-earnings-call-transcript/') ELSE 'https://example.com/about' END AS url")
    return landed.transcript_index(d, "url", 12, "2024-01-31").select("ticker", "held_on", "quarter").distinct()


# ---- sinks ------------------------------------------------------------------------
@query("facts_appended_once", "SNK-01", "select metric, count(*) stored from facts group by 1", "facts")
def _(t):
    path, cols = scratch(t), ["entity_id", "metric", "period", "period_end", "filed_on", "value"]
    facts = cut_lineage(t.facts)
    sinks.append_if_absent(facts.filter("filed_on <= date'1999-01-01'"), path, cols, ["metric"])
    sinks.append_if_absent(facts, path, cols, ["metric"])
    return t.spark.read.parquet(path).groupBy("metric").agg(F.count(F.lit(1)).alias("stored"))


@query("documents_appended_once", "SNK-02 SNK-05", "select entity, md5(text) as hash, 'u' || min(doc_id) url, min(published)::varchar published from filings group by 1, 2", "filings")
def _(t):
    path = scratch(t)
    docs = t.filings.selectExpr("doc_id", "entity", "concat('u', doc_id) AS url", "md5(text) AS hash", "published")
    keys, arrival = [("entity", "url"), ("entity", "hash")], ("published", "doc_id")
    sinks.append_absent_keys(docs.filter("published < date'2021-06-01'"), path, keys, arrival)
    later = sinks.incremental_since(docs, t.spark.read.parquet(path), "entity", "published")
    sinks.append_absent_keys(later, path, keys, arrival)
    return t.spark.read.parquet(path).select("entity", "hash", "url", "published")


# Documents offered one by one to each entity: a url or a hash that an accepted one has turns the next away.
view("offered", "select *, row_number() over (partition by entity order by published, doc_id) k from (select doc_id, entity, published, case when doc_id % 10 < 9 then 'u' || (doc_id * 7 % 61) end url, length(text) % 37 as hash from filings)", "filings")
view("offers_taken", """select entity, k, urls, hashes, taken from (with recursive step as (
 select entity, 0::bigint k, []::varchar[] urls, []::bigint[] hashes, false taken from offered group by 1
 union all select s.entity, o.k, case when ok and o.url is not null then list_append(s.urls, o.url) else s.urls end, case when ok then list_append(s.hashes, o.hash) else s.hashes end, ok
 from (select s.*, o.url, o.hash, o.k nk, not coalesce(list_contains(s.urls, o.url), false) and not list_contains(s.hashes, o.hash) ok from step s join offered o on o.entity = s.entity and o.k = s.k + 1) x
 , lateral (select x.entity, x.urls, x.hashes) s, lateral (select x.url, x.hash, x.nk k) o) select * from step)""", "offered")


@query("documents_first_come", "SNK-02", "select doc_id, entity, url, hash from offered join offers_taken using (entity, k) where taken", "offered offers_taken")
def _(t):
    offered = t.filing_texts.selectExpr("doc_id", "entity", "published", "CASE WHEN doc_id % 10 < 9 THEN concat('u', doc_id * 7 % 61) END AS url", "bigint(length(text) % 37) AS hash")
    return sinks.first_come(offered, [("entity", "url"), ("entity", "hash")], ("published", "doc_id")).select("doc_id", "entity", "url", "hash")


@query("scores_replaced_by_date", "SNK-03", "select as_of::varchar as_of, count(*) as rows from qtr_scored group by 1", "qtr_scored")
def _(t):
    path = scratch(t)
    s = cut_lineage(scored(t, QUARTERLY).select("as_of", "entity_id", "key", "percentile"))
    sinks.replace_as_of(s.withColumn("percentile", F.lit(0.0)), path)
    sinks.replace_as_of(s.filter(f"as_of = date'{QUARTERLY[0]}'"), path)
    return t.spark.read.parquet(path).groupBy("as_of").agg(F.count(F.lit(1)).alias("rows"))


@query("derived_findings_rebuilt", "SNK-04", "select count(*) stored, count(*) filter (finding_id % 13 = 0) kept from findings where event_type='error' or finding_id % 13 = 0", "findings")
def _(t):
    path = scratch(t)
    f = t.findings.select("finding_id", "event_type", (F.col("finding_id") % 13 == 0).alias("touched"))
    sinks.replace_untouched(f, f.filter("event_type = 'error'"), "finding_id", "touched", path)
    return t.spark.read.parquet(path).agg(F.count(F.lit(1)).alias("stored"), F.count_if("touched").alias("kept"))


# every landed table, with a column whose values are summed to compare contents
EXPORTED = {"region": "r_regionkey", "nation": "n_nationkey", "customer": "c_custkey", "supplier": "s_suppkey", "part": "p_partkey", "orders": "o_orderkey",
            "lineitem": "l_orderkey * 8 + l_linenumber", "events": "event_id", "documents": "doc_id + length(text)", "embeddings": "vec_id", "pages": "page_id + length(html)",
            "benchmark": "item_id + length(text)", "labels": "doc_id * 4 + quality * 2 + toxic", "conversations": "conv_id * 64 + turn + length(text)"}


@query("tables_exported_and_imported", "SNK-06", " union all ".join(f"select '{n}' tbl, count(*) as rows, sum({c})::bigint as total from {n}" for n, c in EXPORTED.items()))
def _(t):
    root, target = scratch(t), scratch(t)
    tables = {n: t.read(n) for n in EXPORTED}
    sinks.export_tables(tables, root)
    schemas = {n: ", ".join(f"{c} {ty}" for c, ty in d.dtypes) for n, d in tables.items()}
    sinks.import_tables(t.spark, root, target, schemas)
    sinks.import_tables(t.spark, root, target, schemas)
    parts = [t.spark.read.parquet(f"{target}/{n}").agg(F.count(F.lit(1)).alias("rows"), F.expr(f"bigint(sum({c}))").alias("total")).select(F.lit(n).alias("tbl"), "rows", "total")
             for n, c in EXPORTED.items()]
    return reduce(lambda a, b: a.unionByName(b), parts)


@query("assessments_recorded_once", "SNK-07 FN-26", "select kind, count(*) stored from (select distinct doc_id, kind from (select doc_id, 'quality' kind from labels union all select doc_id, 'toxic' from labels)) group by 1")
def _(t):
    path = scratch(t)
    quotes = t.labels.join(t.documents.select("doc_id", "text"), "doc_id").selectExpr("doc_id", "text AS quote", "stack(2, 'quality', quality, 'toxic', toxic) AS (kind, v)").selectExpr("doc_id", "kind", "quote", "v = 1 AS accepted")
    sinks.record_assessments(quotes, path)
    sinks.record_assessments(quotes.withColumn("quote", F.upper("quote")).withColumn("quote", F.lower("quote")), path)
    return t.spark.read.parquet(path).groupBy("kind").agg(F.countDistinct("doc_id").alias("stored"))


@query("edges_upserted", "SNK-08", "select hub, dependent, case when hub % 2 = 0 then mention_count + 1 else mention_count end mention_count from exposures", "exposures")
def _(t):
    e = t.exposures.withColumn("version", F.lit(1))
    changed = e.filter("hub % 2 = 0").withColumn("mention_count", F.col("mention_count") + 1).withColumn("version", F.lit(2))
    return sinks.upsert(e, changed, ["hub", "dependent"], "version").select("hub", "dependent", "mention_count")


@query("prices_refreshed", "SNK-09", f"select brand, count(*) sessions, min(session_date)::varchar as first_session, max(session_date)::varchar as last_session, {R('sum(close)', 4)} as total_close from bars group by 1", "bars")
def _(t):
    path, bars = scratch(t), cut_lineage(t.bars)
    sinks.append_absent_keys(bars.filter("session_date < date'2000-01-01'"), path, [("brand", "session_date")], ("session_date",))
    sinks.append_absent_keys(bars.filter("session_date >= date'1999-12-01'"), path, [("brand", "session_date")], ("session_date",))
    return t.spark.read.parquet(path).groupBy("brand").agg(F.count(F.lit(1)).alias("sessions"), F.min("session_date").alias("first_session"),
                                                           F.max("session_date").alias("last_session"), F.round(F.sum("close"), 4).alias("total_close"))
