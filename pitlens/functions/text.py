"""Text expressions: tokens, figures, topics, years; all JVM-side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that carry no topic in a finding's summary.
STOPWORDS = (
    "the", "and", "for", "with", "that", "this", "from", "into", "could", "may", "would", "will", "have", "has", "are", "was", "were",
    "its", "their", "which", "company", "companys", "risk", "risks", "increase", "increased", "increasing", "reduce", "reduced",
    "reducing", "impact", "material", "materially", "adverse", "adversely", "affect", "affected", "significant", "significantly",
    "continue", "continued", "results", "operations", "financial", "condition", "business")
# Words left out of the filing vocabulary.
VOCABULARY_STOPWORDS = (
    "that", "this", "with", "from", "have", "has", "been", "were", "was", "are", "its", "their", "which", "would", "could", "may", "might",
    "will", "shall", "such", "other", "these", "those", "than", "then", "there", "into", "upon", "any", "all", "our", "the", "and", "for",
    "not", "but", "his", "her")
# Disclosure topics and the substrings that signal them.
TOPICS = {
    "supply_concentration": ("supplier", "supply chain", "foundry", "concentration", "single source", "sole source", "manufacturing partner"),
    "regulation": ("regulat", "antitrust", "compliance", "legislat", "doj", "ftc", "european union", "government-set"),
    "litigation": ("litigat", "lawsuit", "court", "settlement", "patent infring", "damages"),
    "tax": ("tax", "irs", "deficiency", "transfer pricing"),
    "demand": ("demand", "backlog", "bookings", "order volume", "end market"),
    "margin_cost": ("margin", "input cost", "pricing", "inflation", "cost of goods", "component cost"),
    "capital_spending": ("capital expenditure", "capex", "data center", "infrastructure investment", "build-out", "buildout", "fab "),
    "financing": ("debt", "senior notes", "offering", "issuance", "dilution", "leverage", "refinanc"),
    "leadership": ("chief executive", "resign", "stepping down", "succession", "board member"),
    "competition": ("competit", "open-source", "open source", "displac", "market share", "rival"),
    "cyber": ("cyber", "breach", "data security", "ransomware"),
    "labour": ("labor", "labour", "workforce", "headcount", "union", "layoff", "attrition"),
    "trade": ("tariff", "export control", "trade restriction", "sanction", "geopolit"),
    "guidance": ("guidance", "outlook", "forecast", "full-year expectation"),
}


def sql_list(words) -> str:
    return "array(" + ", ".join(f"'{w}'" for w in words) + ")"


def tokens(text: str, stopwords=STOPWORDS) -> str:
    """Distinct words of four letters or more without the stopwords."""
    return f"array_except(regexp_extract_all(lower({text}), '[a-z]{{4,}}', 0), {sql_list(stopwords)})"


def vocabulary_terms(text: str) -> str:
    """Distinct terms of 4 to 32 characters, hyphens and apostrophes kept."""
    words = f"array_except(regexp_extract_all(lower({text}), '[a-z][a-z\\'\\\\-]+', 0), {sql_list(VOCABULARY_STOPWORDS)})"
    return f"filter({words}, w -> length(w) BETWEEN 4 AND 32)"


def figures(text: str) -> str:
    """Distinct numbers without thousands commas and without a fractional tail of zeros.

    Only a decimal point and the zeros behind it are cut: 100 and 1 stay different.
    """
    raw = f"regexp_extract_all({text}, '\\\\d+(?:[.,]\\\\d+)*', 0)"
    clean = "regexp_replace(regexp_replace(replace(x, ',', ''), '(\\\\.\\\\d*?)0+$', '$1'), '\\\\.$', '')"
    return f"array_distinct(transform({raw}, x -> {clean}))"


def jaccard(a: str, b: str) -> str:
    return (f"(CASE WHEN size({a}) = 0 OR size({b}) = 0 THEN 0D"
            f" ELSE size(array_intersect({a}, {b})) / size(array_union({a}, {b})) END)")


def quoted_years(text: str) -> str:
    raw = f"regexp_extract_all({text}, '\\\\b(?:19|20)\\\\d{{2}}\\\\b', 0)"
    return f"filter(transform({raw}, y -> int(y)), y -> y BETWEEN 1990 AND 2100)"


def topic_hits(text: str) -> str:
    """Per topic the number of its keywords contained in the text, in topic order; the text is worked out once."""
    entries = []
    for topic, words in TOPICS.items():
        hits = " + ".join(f"int(contains(low, '{w}'))" for w in words)
        entries.append(f"struct('{topic}' AS topic, {hits} AS hits)")
    return f"get(transform(array(lower({text})), low -> filter(array({', '.join(entries)}), t -> t.hits > 0)), 0)"


def topics_of(text: str) -> str:
    return f"transform({topic_hits(text)}, t -> t.topic)"


def leading_topic(hits: str) -> str:
    """Most keyword hits; the first listed topic wins a tie."""
    return f"(aggregate({hits}, struct(string(null) AS topic, 0 AS hits), (a, t) -> CASE WHEN t.hits > a.hits THEN t ELSE a END)).topic"


def primary_topic(text: str) -> str:
    return leading_topic(topic_hits(text))


def told_topics(text: str) -> str:
    """Rows of topics (an array) and primary_topic: one of a text with topics, none of another. Keywords are looked for once a text."""
    row = f"named_struct('topics', transform(hits, t -> t.topic), 'primary_topic', {leading_topic('hits')})"
    return f"inline(get(transform(array({topic_hits(text)}), hits -> filter(array({row}), r -> size(r.topics) > 0)), 0))"


def normalise(text: str) -> str:
    """Lower-case letters and digits, single spaces."""
    return f"trim(regexp_replace(lower({text}), '[^\\\\p{{L}}\\\\p{{N}}]+', ' '))"


def fold_quotes(text: str) -> str:
    """Typographic quotes and dashes folded to plain ones, whitespace collapsed, lower case."""
    plain = f"translate({text}, '\\u2018\\u2019\\u201c\\u201d\\u2013\\u2014\\u00a0', '\\'\\'\"\"-- ')"
    return f"trim(lower(regexp_replace({plain}, '\\\\s+', ' ')))"


def is_tabular(text: str) -> str:
    digits = f"length(regexp_replace({text}, '[^0-9]', ''))"
    return f"({digits} / greatest(length({text}), 1) > 0.15 OR contains(lower({text}), 'following table'))"


def title_of(summary: str) -> str:
    """Text before the colon when it reads like a label, else a clip at a word."""
    s = f"trim({summary})"
    head = f"substring_index({s}, ':', 1)"
    clip = f"regexp_replace(substring({s}, 1, 70), ' [^ ]*$', '')"
    tail = lambda x: f"regexp_replace({x}, '[ .,]+$', '')"
    return (f"(CASE WHEN contains({s}, ':') AND length({head}) BETWEEN 3 AND 70 THEN trim({head})"
            f" WHEN length({s}) <= 70 THEN {tail(s)} ELSE concat({tail(clip)}, '…') END)")


def core_name(name: str) -> str:
    """Company name without corporate suffixes and punctuation."""
    # Corporate suffixes.
    suffix = "inc|incorporated|corp|corporation|co|company|ltd|limited|plc|llc|lp|sa|nv|ag|holdings|group|the"
    return f"trim(regexp_replace(regexp_replace(lower({name}), '[^a-z0-9 ]', ' '), '\\\\b({suffix})\\\\b|\\\\s+', ' '))"


def contains_word(text: Column, word: Column) -> Column:
    """Whole-word, case-sensitive containment; the word is quoted as a literal."""
    return F.regexp_like(text, F.concat(F.lit(r"(?<![A-Za-z0-9])\Q"), word, F.lit(r"\E(?![A-Za-z0-9])")))


def is_about(headline: Column, name: Column, ticker: Column) -> Column:
    return F.contains(F.lower(headline), name) | contains_word(headline, ticker)
