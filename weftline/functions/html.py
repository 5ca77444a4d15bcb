"""Paragraph text, titles and link values of captured HTML as column expressions.

Comments, scripts and tags that never open or close a paragraph go by whole-string regular
expressions. What is left are pieces of text behind block tags; one fold over them keeps the open
elements as its state and so follows the parser: an end tag closes only what is open in its
scope, list items, headings and table parts close their neighbours. A Unicode noncharacter marks
where a paragraph begins.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from html.entities import html5

from pyspark.sql import Column, functions as F

from weftline.functions.text import WHITE, trim_white

_OPEN = "\ufdd0"

# Fixed values of the HTML parsing rules: elements whose start tag closes an open paragraph, parts of
# tables, and elements that bound the search for an open element (a button bounds it for paragraphs only).
PARAGRAPH_CLOSERS = (
    "address|article|aside|blockquote|center|dd|details|dialog|dir|div|dl|dt|fieldset|figcaption|figure|footer|"
    "form|h1|h2|h3|h4|h5|h6|header|hgroup|hr|li|listing|main|menu|nav|ol|p|plaintext|pre|search|section|summary|table|ul|xmp"
)
TABLE_PARTS = "caption|tbody|td|tfoot|th|thead|tr"
SCOPE_BOUNDS = "applet|caption|marquee|object|table|td|template|th"
_FOLDED = "|".join(sorted({*f"{PARAGRAPH_CLOSERS}|{TABLE_PARTS}|{SCOPE_BOUNDS}|button".split("|")}))

_INVISIBLE = (
    r"(?is)<!--.*?(?:-->|$)|<script(?:\s[^>]*)?>.*?(?:</script\s*>|$)|<style(?:\s[^>]*)?>.*?(?:</style\s*>|$)"
)
_ANY_TAG = r"<[a-zA-Z/!?][^>]*(?:>|$)"
_STEP = 64  # pieces that are folded together before they join the text so far


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def strip_invisible(html: Column) -> Column:
    """Remove comments, scripts and style sheets with their content."""
    return F.regexp_replace(F.coalesce(html, F.lit("")), _INVISIBLE, "")


def _names(entities: dict[str, str]) -> dict[str, dict[str, str]]:
    """Entities by first letter, so that a lookup reads few of them."""
    table: dict[str, dict[str, str]] = {}
    for name, chars in sorted(entities.items()):
        table.setdefault(name[0], {})[name] = chars
    return table


_CLOSED = json.dumps(_names({n[:-1]: c for n, c in html5.items() if n.endswith(";")}))
_OPEN_ENDED = {n: c for n, c in html5.items() if not n.endswith(";")}  # names that need no semicolon
_BARE = json.dumps(_names(_OPEN_ENDED))
_BARE_LENGTHS = sorted({len(n) for n in _OPEN_ENDED}, reverse=True)
# numbers 128 to 159 are read as Windows-1252
_WINDOWS = [ord(bytes([c]).decode("cp1252", "ignore") or chr(c)) for c in range(128, 160)]


def _lookup(table: str, name: Column) -> Column:
    by_letter = F.from_json(F.lit(table), "map<string,map<string,string>>")
    return F.try_element_at(F.try_element_at(by_letter, F.substring(name, 1, 1)), name)


def decode_entities(text: Column, attribute: bool = False) -> Column:
    """Replace named and numeric character references in one pass.

    The semicolon may be missing after a number and after the old names; of these the longest that
    fits is taken. In an attribute a name without semicolon stays before a letter, a digit or ``=``.
    """

    def numeric(body: Column) -> Column:
        code = F.when(
            body.rlike("^#[xX]"), F.conv(F.substring(body, F.lit(3), F.length(body)), 16, 10).try_cast("int")
        ).otherwise(F.substring(body, F.lit(2), F.length(body)).try_cast("int"))
        code = F.when(code.between(128, 159), F.element_at(F.array(*map(F.lit, _WINDOWS)), code - 127)).otherwise(code)
        # UTF-32 bytes of the code point; 0 and values beyond Unicode read as U+FFFD
        safe = F.when(code.between(1, 0x10FFFF) & ~code.between(0xD800, 0xDFFF), code).otherwise(F.lit(0xFFFD))
        return F.decode(F.unhex(F.lpad(F.hex(safe), 8, "0")), "UTF-32")

    def bare(piece: Column, body: Column) -> Column:
        """The old name that the body begins with, and what follows it."""
        found = F.lit(None).cast("string")
        for length in reversed(_BARE_LENGTHS):
            prefix = F.substring(body, 1, length)
            here = F.concat(_lookup(_BARE, prefix), F.substring(piece, F.lit(length + 2), F.length(piece)))
            fits = F.length(body) == length if attribute else F.length(body) >= length
            found = F.coalesce(F.when(fits, here), found)
        if attribute:
            after = F.substring(piece, F.length(body) + F.lit(2), F.lit(1))
            found = F.when(after != "=", found)
        return F.coalesce(found, piece)

    def one(piece: Column) -> Column:
        body = F.regexp_extract(piece, r"^&(#[xX][0-9a-fA-F]+|#[0-9]+|[A-Za-z][A-Za-z0-9]*)", 1)
        return _let(body, lambda name: replaced(piece, name))

    def replaced(piece: Column, body: Column) -> Column:
        closed = F.substring(piece, F.length(body) + F.lit(2), F.lit(1)) == ";"
        rest = F.substring(piece, F.length(body) + F.when(closed, 3).otherwise(2), F.length(piece))
        named = (
            F.when(body == "amp", F.lit("&"))
            .when(body == "lt", F.lit("<"))
            .when(body == "gt", F.lit(">"))
            .when(body == "quot", F.lit('"'))
            .when(body == "nbsp", F.lit("\u00a0"))
            .otherwise(_lookup(_CLOSED, body))
        )
        return (
            F.when(body == "", piece)
            .when(body.startswith("#"), F.concat(numeric(body), rest))
            .otherwise(F.coalesce(F.when(closed, F.concat(named, rest)), bare(piece, body)))
        )

    def all_of(whole: Column) -> Column:
        return F.when(
            whole.contains("&"), F.array_join(F.transform(F.split(whole, "(?=&)", -1), one), "")
        ).otherwise(whole)

    return _let(text, all_of)


def _after(open_now: Column, name: Column) -> Column:
    """The elements inside the nearest open ``name``; all of them where none is open."""
    return F.call_function("substring_index", open_now, _tag(name), F.lit(-1))


def _tag(name: Column) -> Column:
    return F.concat(F.lit(";"), name, F.lit(";"))


def _pop(open_now: Column, name: Column) -> Column:
    """The open elements without the nearest ``name`` and what is inside it."""
    kept = F.length(open_now) - F.length(_after(open_now, name)) - F.length(name) - F.lit(2)
    return F.substring(open_now, F.lit(1), kept)


def _closes(open_now: Column, name: Column, bounds: str) -> Column:
    """Whether ``name`` is open with none of the bounds inside it."""
    return open_now.contains(_tag(name)) & ~_after(open_now, name).rlike(f";(?:{bounds});")


def _without_paragraph(open_now: Column) -> Column:
    p = F.lit("p")
    return F.when(_closes(open_now, p, f"{SCOPE_BOUNDS}|button"), _pop(open_now, p)).otherwise(open_now)


def _end(open_now: Column, name: Column) -> Column:
    """Open elements after an end tag (not of a paragraph): any heading's end closes the nearest heading."""
    heading = F.regexp_extract(open_now, ".*;(h[1-6]);", 1)
    target = F.when(name.rlike("^h[1-6]$") & (heading != ""), heading).otherwise(name)
    bounds = F.when(name == "li", _closes(open_now, name, f"{SCOPE_BOUNDS}|ol|ul"))
    bounds = bounds.when(name.rlike(f"^(?:table|{TABLE_PARTS})$"), _closes(open_now, name, "table|template"))
    return _let(target, lambda t: F.when(bounds.otherwise(_closes(open_now, t, SCOPE_BOUNDS)), _pop(open_now, t)).otherwise(open_now))


def _start(open_now: Column, name: Column) -> Column:
    """Open elements after a start tag."""

    def item(nearest: Column) -> Column:
        between = _after(open_now, nearest)
        for passed in (";address;", ";div;", ";p;"):
            between = F.replace(between, F.lit(passed), F.lit(""))
        return F.when((nearest != "") & open_now.contains(_tag(nearest)) & (between == ""), _pop(open_now, nearest)).otherwise(open_now)

    def block(rest: Column) -> Column:
        bare = F.when(name.rlike("^h[1-6]$") & rest.rlike(";h[1-6];$"), F.substring(rest, F.lit(1), F.length(rest) - 4)).otherwise(rest)
        return F.when(name == "hr", bare).otherwise(F.concat(bare, _tag(name)))

    def part(inside: Column) -> Column:
        outer = F.substring(open_now, F.lit(1), F.length(open_now) - F.length(inside))

        def until(*names: str) -> Column:
            rest = inside
            for first in names:
                rest = F.substring_index(rest, f";{first};", 1)
            return rest

        row, cell = until("tr", "caption"), until("td", "th", "caption")
        return F.concat(outer, F.when(name.isin("td", "th"), cell).when(name == "tr", row).otherwise(F.lit("")), _tag(name))

    items = F.when(name == "li", item(name)).when(
        name.isin("dd", "dt"), _let(F.regexp_extract(open_now, ".*;(d[dt]);", 1), item)
    ).otherwise(open_now)
    table = F.lit("table")
    return (
        F.when(
            name.rlike(f"^(?:{TABLE_PARTS})$"),
            F.when(open_now.contains(";table;"), _let(_after(open_now, table), part)).otherwise(open_now),
        )
        .when(
            name == "button",
            F.concat(F.when(_closes(open_now, name, SCOPE_BOUNDS), _pop(open_now, name)).otherwise(open_now), F.lit(";button;")),
        )
        .when(name.rlike(f"^(?:{SCOPE_BOUNDS})$") & (name != "table"), F.concat(open_now, _tag(name)))
        .otherwise(_let(_let(items, _without_paragraph), block))
    )


def _fold(pieces: Column) -> Column:
    """Text of the pieces that lies in a paragraph, with a mark where each paragraph begins."""

    def step(state: Column, piece: Column) -> Column:
        open_now, name, ends = state["open"], piece["name"], piece["ends"]
        is_p, before = name == "p", open_now
        stray = is_p & ends & ~_closes(before, F.lit("p"), f"{SCOPE_BOUNDS}|button")
        after = (
            F.when(name == "", before)
            .when(is_p & ends, _without_paragraph(before))
            .when(ends, _end(before, name))
            .otherwise(_start(before, name))
        )
        mark = F.when((is_p & ~ends) | stray, F.lit(_OPEN)).otherwise(F.lit(""))
        return _let(after, lambda now: F.struct(
            now.alias("open"),
            F.concat(state["text"], mark, F.when(now.contains(";p;"), piece["text"]).otherwise(F.lit(""))).alias("text"),
        ))

    def run(state: Column, some: Column) -> Column:
        done = F.aggregate(some, F.struct(state["open"].alias("open"), F.lit("").alias("text")), step)
        return _let(done, lambda d: F.struct(d["open"].alias("open"), F.concat(state["text"], d["text"]).alias("text")))

    def in_steps(rows: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(rows), F.lit(1)), F.lit(_STEP))
        return F.transform(starts, lambda at: F.slice(rows, at, F.lit(_STEP)))

    none = F.struct(F.lit("").alias("open"), F.lit("").alias("text"))
    return F.aggregate(_let(pieces, in_steps), none, run, lambda state: state["text"])


def _marked(html: Column) -> Column:
    """Text of the paragraphs, each behind a mark; everything outside paragraphs removed."""
    s = F.regexp_replace(strip_invisible(html), _OPEN, "")
    s = F.regexp_replace(s, r"(?is)<title(?:\s[^>]*)?>.*?</title\s*>", "")
    s = F.regexp_replace(s, rf"(?i)(?!</?(?:{_FOLDED})[\s/>]){_ANY_TAG}", "")
    tag = r"^<(/?)([a-zA-Z][a-zA-Z0-9]*)"

    def piece(x: Column) -> Column:
        return F.struct(
            F.lower(F.regexp_extract(x, tag, 2)).alias("name"),
            (F.regexp_extract(x, tag, 1) == "/").alias("ends"),
            F.regexp_replace(x, r"^<[a-zA-Z/][^>]*(?:>|$)", "").alias("text"),
        )

    return _fold(F.transform(F.split(s, rf"(?i)(?=</?(?:{_FOLDED})[\s/>])", -1), piece))


def paragraph_text(html: Column) -> Column:
    """Trimmed text of every paragraph, empty ones dropped, joined by one space."""
    s = decode_entities(_marked(html))
    edge = WHITE[:-1] + _OPEN + "]"
    s = F.regexp_replace(s, f"{edge}*{_OPEN}{edge}*", _OPEN)
    s = F.regexp_replace(s, f"^{edge}+|{edge}+$", "")
    return F.replace(s, F.lit(_OPEN), F.lit(" "))


def paragraph_text_keep_empty(html: Column) -> Column:
    """As ``paragraph_text`` but empty paragraphs keep their joining space."""
    s = decode_entities(_marked(html))
    s = F.regexp_replace(s, f"{WHITE}*{_OPEN}{WHITE}*", _OPEN)
    s = F.regexp_replace(s, f"^{_OPEN}|{WHITE}+$", "")
    return F.replace(s, F.lit(_OPEN), F.lit(" "))


def _first_element(html: Column, tag: str) -> Column:
    end = r"</title\s*>" if tag == "title" else r"</h[1-6][\s/>]|<h[1-6][\s/>]"  # any heading ends a heading
    inner = F.regexp_extract(strip_invisible(html), rf"(?is)<{tag}(?:\s[^>]*)?>(.*?)(?:{end}|$)", 1)
    plain = inner if tag == "title" else F.regexp_replace(inner, _ANY_TAG, "")
    return trim_white(decode_entities(plain))


def page_title(html: Column) -> Column:
    """First ``title``, else first ``h1``, else ``Untitled``."""
    return F.coalesce(
        F.nullif(_first_element(html, "title"), F.lit("")),
        F.nullif(_first_element(html, "h1"), F.lit("")),
        F.lit("Untitled"),
    )


def link_values(html: Column) -> Column:
    """The ``href`` of every ``a`` element in document order, entities decoded."""
    anchors = F.regexp_extract_all(
        strip_invisible(html), F.lit(r"""(?i)(<a\s(?:[^>"']++|"[^"]*+"|'[^']*+')*+>)"""), F.lit(1)
    )
    value = r"""(?is)\shref\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""

    def href(tag: Column) -> Column:
        return F.concat(*[F.regexp_extract(tag, value, group) for group in (1, 2, 3)])

    with_href = F.filter(anchors, lambda tag: tag.rlike(r"(?i)\shref(?:\s*=|[\s/>])"))
    return F.transform(with_href, lambda tag: decode_entities(href(tag), attribute=True))
