"""Text out of web pages by expressions over the markup; no page leaves the JVM.

A page is its tags and the stretches between them, two arrays. Folding over the tags with the depth of the
element being left out gives the spans of tags that go, nested elements and all; what lies between the
spans stays. An element that never closes goes on to the page's end; a paragraph ends where the
next begins, a head where the body begins.
"""

from __future__ import annotations

import json
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

# Elements that are not body text, elements without content, containers and class names of page furniture,
# paywall phrases and length bounds.
DROPPED = ("script", "style", "noscript", "head", "template", "ix:header", "ix:hidden")
NOISE = (*DROPPED, "nav", "header", "footer", "aside", "form", "iframe", "figure", "figcaption", "svg", "button")
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr")
NOISE_CLASSES = ("related", "recommend", "newsletter", "subscribe", "promo", "advert", "social", "share", "comment", "paywall", "cookie", "consent")
NOISE_IDS = ("related", "advert")
BODY_CLASSES = ("article-body", "article__body", "story-body", "post-content", "entry-content")
PAYWALL_MARKERS = ("subscribe to continue", "already a subscriber", "subscribe now to read", "this article is for subscribers",
                   "create an account to read", "sign in to read", "become a member to read", "to continue reading",
                   "unlock this article", "subscription required")
MIN_BODY, MIN_PARAGRAPH, MARKER_SPAN = 600, 80, 1200
# Named characters of the markup standard, those that may go without a semicolon, and what it makes of the C1 controls.
NAMED = {name[:-1]: sign for name, sign in html5.items() if name.endswith(";")}
BARE = sorted((name for name in html5 if not name.endswith(";")), key=lambda n: (-len(n), n))
CONTROLS = [bytes([c]).decode("cp1252", "ignore") or chr(c) for c in range(128, 160)]
_RAW = "|".join(rf"<{name}\b[^>]*>.*?</{name}\s*>" for name in ("script", "style"))
TAG = rf"""(?is)<!--.*?-->|{_RAW}|<[!?][^>]*>|</?[a-z][^>"']*(?:"[^"]*"[^>"']*|'[^']*'[^>"']*)*>|</?[a-z][^>]*>"""
REFERENCE = rf"&(?:#[xX][0-9a-fA-F]+;?|#[0-9]+;?|[A-Za-z][A-Za-z0-9]*;|{'|'.join(BARE)})"


def _sql(text: str) -> str:
    """A string literal, whatever it holds."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _let(value: str, name: str, body: str) -> str:
    """`body` with `name` bound to `value`, which is worked out once."""
    return f"get(transform(array({value}), {name} -> {body}), 0)"


def _attribute(tag: str, name: str) -> str:
    value = rf"""(?is)^<[^\s>]+(?:[^>"']|"[^"]*"|'[^']*')*?\s{name}\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)"""
    return f"regexp_extract({tag}, {_sql(value)}, 1)"


def _any(value: str, parts: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains({value}, '{p}')" for p in parts) + ")"


def _marks(tags: str, noise: bool) -> str:
    """name, kind (1 opens, -1 closes, 0 neither), drop of each tag; with `noise` also which of the body's containers it opens."""
    name = f"lower(regexp_extract(x, {_sql('(?s)^</?([a-zA-Z][^ \t\n\r\f/>]*)')}, 1))"
    kind = (f"CASE WHEN n = '' OR n IN ({', '.join(map(_sql, VOID))}) THEN 0 WHEN startswith(x, '</') THEN -1"
            rf" WHEN n IN ('script', 'style') AND x RLIKE {_sql(r'(?s)</\w+\s*>$')} THEN 0 ELSE 1 END")
    unquoted = f"regexp_replace(x, {_sql(chr(34) + '[^' + chr(34) + ']*' + chr(34) + '|' + chr(39) + '[^' + chr(39) + ']*' + chr(39))}, '_')"
    hidden = f"({_attribute('x', 'style')} RLIKE {_sql(r'(?i)display\s*:\s*none')} OR {unquoted} RLIKE {_sql(r'(?i)\shidden[\s=/>]')})"
    drop = f"n IN ({', '.join(map(_sql, NOISE if noise else DROPPED))}) OR {hidden}"
    into = ""
    if noise:
        style, own = _attribute("x", "class"), _attribute("x", "id")
        drop += f" OR {_any(style, NOISE_CLASSES)} OR {_any(own, NOISE_IDS)}"
        into = (f", 'into', array({_attribute('x', 'itemprop')} RLIKE '^.?articleBody.?$', n = 'article', false, "
                + ", ".join(f"contains({style}, '{c}')" for c in BODY_CLASSES) + f", {_attribute('x', 'data-component')} RLIKE '^.?text-block.?$', n = 'main')")
    return f"transform({tags}, x -> {_let(name, 'n', f'''named_struct('name', n, 'kind', {kind}, 'drop', {drop}{into})''')})"


def _spans(marks: str) -> str:
    """Spans of tags that go, in order, by a fold that keeps the name and depth of the element being left out."""
    def state(skip: str, depth: str, start: str, spans: str = "s.spans") -> str:
        return f"named_struct('i', s.i + 1, 'skip', {skip}, 'depth', {depth}, 'start', {start}, 'spans', {spans})"

    # the stretches that go are those after tag a up to b; the tags are a to c, which leaves tag b where it only implies the end
    ended = lambda last: f"array_append(s.spans, named_struct('a', s.start, 'b', s.i, 'c', {last}))"
    fold = f"""aggregate({marks}, named_struct('i', 0, 'skip', '', 'depth', 0, 'start', 0, 'spans', cast(array() AS array<struct<a: int, b: int, c: int>>)), (s, m) -> CASE
      WHEN s.skip = '' AND m.kind = 1 AND m.drop THEN {state('m.name', '1', 's.i')}
      WHEN s.skip = '' THEN {state("''", '0', '0')}
      WHEN s.skip = 'head' AND m.name = 'body' AND m.kind = 1 THEN {state("''", '0', '0', ended('s.i - 1'))}
      WHEN m.name <> s.skip OR m.kind = 0 THEN {state('s.skip', 's.depth', 's.start')}
      WHEN m.kind = -1 AND s.depth = 1 THEN {state("''", '0', '0', ended('s.i'))}
      WHEN m.kind = -1 THEN {state('s.skip', 's.depth - 1', 's.start')}
      WHEN s.skip = 'p' AND m.drop THEN {state("'p'", '1', 's.i', ended('s.i - 1'))}
      WHEN s.skip = 'p' THEN {state("''", '0', '0', ended('s.i - 1'))}
      ELSE {state('s.skip', 's.depth + 1', 's.start')} END,
      s -> CASE WHEN s.skip = '' THEN s.spans ELSE {ended('s.i - 1')} END)"""
    return f"concat(array(named_struct('a', -1, 'b', -1, 'c', -1)), {fold}, array(named_struct('a', size({marks}), 'b', size({marks}), 'c', size({marks}))))"


_CODE = ("CASE WHEN code = 0 OR code > 1114111 OR code BETWEEN 55296 AND 57343 THEN '\\uFFFD' WHEN code BETWEEN 128 AND 159 THEN get(from_json("
         + _sql(json.dumps(CONTROLS)) + ", 'array<string>'), int(code - 128)) ELSE decode(unhex(lpad(hex(code), 8, '0')), 'UTF-32') END")


def _unescape(text: str) -> str:
    """Character references, named, decimal and hexadecimal, each read once where it stands."""
    number = ("CASE WHEN ref RLIKE '^&#[xX]' THEN " + _let("regexp_extract(ref, '0*([0-9a-fA-F]*);?$', 1)", "hex", "CASE WHEN length(hex) > 6 THEN 1114112L ELSE coalesce(bigint(conv(nullif(hex, ''), 16, 10)), 0L) END")
              + " ELSE " + _let("regexp_extract(ref, '0*([0-9]*);?$', 1)", "dec", "CASE WHEN length(dec) > 7 THEN 1114112L ELSE coalesce(bigint(nullif(dec, '')), 0L) END") + " END")
    sign = f"CASE WHEN startswith(ref, '&#') THEN {_let(number, 'code', _CODE)} ELSE element_at(from_json({_sql(json.dumps(NAMED))}, 'map<string,string>'), rtrim(';', substring(ref, 2, length(ref)))) END"
    refs = f"regexp_extract_all({text}, {_sql(REFERENCE)}, 0)"
    joined = _let(refs, "refs", f"array_join(transform(split({text}, {_sql(REFERENCE)}, -1), (piece, k) -> concat(piece, {_let('get(refs, k)', 'ref', f'''CASE WHEN ref IS NULL THEN '' ELSE coalesce({sign}, ref) END''')})), '')")
    return f"CASE WHEN contains({text}, '&') THEN {joined} ELSE {text} END"


def _lines(stretches: str) -> str:
    """Stretches trimmed, in order; empty ones left out."""
    trimmed = f"regexp_replace({_unescape('x')}, {_sql(r'^[\s ]+|[\s ]+$')}, '')"
    return f"filter(transform({stretches}, x -> {trimmed}), x -> x <> '')"


def _kept(edges: str, stretches: str) -> str:
    """Stretches outside the spans; `edges` are the spans between two that stand for the page's ends."""
    return f"flatten(transform(sequence(1, size({edges}) - 1), e -> slice({stretches}, {edges}[e - 1].b + 2, {edges}[e].a - {edges}[e - 1].b)))"


def _cut(page: str) -> tuple[str, str]:
    return f"regexp_extract_all({page}, {_sql(TAG)}, 0)", f"split({page}, {_sql(TAG)}, -1)"


def html_to_text(page: str) -> Column:
    """Text of a page (a column's name) outside dropped and hidden elements, a line a stretch; null of null."""
    tags, stretches = _cut(page)
    return F.expr(_let(_marks(tags, False), "marks", _let(_spans("marks"), "edges", f"array_join({_lines(_kept('edges', stretches))}, '\\n')")))


def article_body(page: str) -> Column:
    """(text, outcome) of a page (a column's name): the first container of enough text, by how plainly a container says
    that it holds the article, or the page's longer paragraphs; fetched, paywalled or too_short."""
    tags, stretches = _cut(f"coalesce({page}, '')")
    blank = "named_struct('name', '', 'kind', 0, 'drop', false, 'into', array(" + ", ".join(["false"] * 10) + "))"
    kept_marks = (f"flatten(transform(sequence(1, size(edges) - 1), e -> concat(slice(marks, edges[e - 1].c + 2, edges[e].a - edges[e - 1].c - 1),"
                  f" CASE WHEN e < size(edges) - 1 AND edges[e].b = edges[e].c THEN array({blank}) ELSE slice(marks, 1, 0) END)))")
    # from a container's tag to the tag that closes it, or to the page's end
    close = lambda at: (f"aggregate(slice(d.marks, {at} + 1, size(d.marks)), named_struct('i', {at}, 'depth', 0, 'end', -1), (s, m) -> CASE"  # noqa: E731
                        f" WHEN s.end >= 0 OR m.name <> d.marks[{at}].name OR m.kind = 0 THEN named_struct('i', s.i + 1, 'depth', s.depth, 'end', s.end)"
                        " WHEN m.kind = -1 AND s.depth = 1 THEN named_struct('i', s.i + 1, 'depth', 0, 'end', s.i)"
                        " ELSE named_struct('i', s.i + 1, 'depth', s.depth + m.kind, 'end', s.end) END, s -> CASE WHEN s.end < 0 THEN size(d.marks) ELSE s.end END)")
    opened = lambda k: f"array_position(transform(d.marks, m -> m.kind = 1 AND m.into[{k}]), true) - 1"
    within = _let(opened("9"), "at", f"CASE WHEN at < 0 THEN -1L ELSE {_let(close('int(at)'), 'last', '''array_position(transform(d.marks, (m, i) -> m.kind = 1 AND m.name = 'article' AND i > at AND i < last), true) - 1''')} END")
    inner = _let(f"int(CASE WHEN k = 2 THEN {within} ELSE {opened('k')} END)", "at", f"CASE WHEN at < 0 THEN '' ELSE array_join({_lines(f'slice(d.kept, at + 2, {close('at')} - at)')}, '\\n') END")
    tidy = lambda x: f"trim(regexp_replace(regexp_replace({x}, '[ \\t]+', ' '), '\\n{{3,}}', '\\n\\n'))"
    contained = f"aggregate(sequence(0, 9), '', (found, k) -> CASE WHEN length(found) >= {MIN_BODY} THEN found ELSE {tidy(inner)} END)"
    starts = "concat(filter(transform(d.marks, (m, i) -> CASE WHEN m.name = 'p' THEN named_struct('i', i, 'kind', m.kind) END), x -> x IS NOT NULL), array(named_struct('i', size(d.marks), 'kind', 0)))"
    pieces = _let(starts, "ps", f"transform(filter(sequence(0, size(ps) - 1), j -> ps[j].kind = 1), j -> {tidy(f'array_join({_lines('slice(d.kept, ps[j].i + 2, ps[j + 1].i - ps[j].i)')}, {_sql(' ')})')})")
    body = _let(contained, "c", f"CASE WHEN length(c) >= {MIN_BODY} THEN c ELSE array_join(filter({pieces}, x -> length(x) > {MIN_PARAGRAPH}), '\\n\\n') END")
    head = f"lower(substring(body, 1, {MARKER_SPAN}))"
    outcome = f"CASE WHEN {_any(head, PAYWALL_MARKERS)} THEN 'paywalled' WHEN length(body) >= {MIN_BODY} THEN 'fetched' ELSE 'too_short' END"
    result = _let(body, "body", _let(outcome, "o", "named_struct('text', CASE WHEN o = 'fetched' THEN body END, 'outcome', o)"))
    kept = f"named_struct('marks', {kept_marks}, 'kept', {_kept('edges', stretches)})"
    return F.expr(_let(_marks(tags, True), "marks", _let(_spans("marks"), "edges", _let(kept, "d", result))))
