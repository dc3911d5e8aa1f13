"""Reading HTML with native regular expressions and higher-order functions.

There is no DOM. An element is found by the pattern of its open tag
(:func:`open_tag`) and closed by counting open and close tags of the same name,
so nested ``div`` containers end where they should. Patterns may be Columns, so
one expression serves every site and the site's rules arrive as data.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterable
from html.entities import html5, name2codepoint

from pyspark.sql import Column
from pyspark.sql import functions as F

from presswork.functions.text import or_empty, strip

# Elements whose content is never article text.
NOISE_TAGS = ["script", "style", "nav", "aside", "header", "footer"]

# Tags that end an open paragraph.
BLOCK_TAGS = (
    "p|div|ul|ol|li|dl|table|h1|h2|h3|h4|h5|h6|section|article|aside|main|nav|"
    "header|footer|form|figure|blockquote|pre|hr"
)
# What follows the name of a tag: attributes, each skipped whole with its value in double,
# single or no quotes, up to the end of the tag. A quote that never closes is no quote.
# Nothing in it is tried twice.
_VALUE = r"""(?:"[^"]*+"|'[^']*+'|[^\s"'>][^\s>]*+)"""
_ATTRIBUTE = rf"[^\s=>/]++(?:\s*+=\s*+{_VALUE}?+)?+"
TAG_END = rf"""(?=[\s/>])(?:[^>"']*+>|(?:[\s/=]++|{_ATTRIBUTE})*+>)"""
PARAGRAPH_OPEN = rf"(?i)<p{TAG_END}"
PARAGRAPH_END = rf"(?i)<(?:/(?:{BLOCK_TAGS}|body|html)\s*>|(?:{BLOCK_TAGS}){TAG_END})"
ANY_TAG = rf"""<(?:[a-zA-Z/!?][^>"']*+>|[a-zA-Z][^\s/>]*+{TAG_END}|[/!?][^>]*+>)"""


def _attribute_before(name: str) -> str:
    """The name of a tag's attribute, with the attributes in front of it skipped whole."""
    return rf"""(?=[\s/])(?:[\s/=]++|(?!{name}\s*=){_ATTRIBUTE})*+(?<=[\s/"']){name}\s*+=\s*+"""


def open_tag(tag: str, attr: str | None = None, op: str = "word", value: str = "") -> str:
    """Pattern of an open tag. ``op``: attribute ``is``, ``has`` or has the ``word``.

    ``tag`` may be ``*`` for any element. Values may have any kind of quotes or none.
    """
    name = "[a-z][a-z0-9]*" if tag == "*" else tag
    if attr is None:
        return rf"(?i)<{name}{TAG_END}"
    v = re.escape(value)

    def inner(other: str) -> str:
        """The value, ``other`` being what else may stand there."""
        return {"is": v, "has": f"{other}*{v}{other}*", "word": rf"(?:{other}*\s)?{v}(?:\s{other}*)?"}[op]

    bare = rf"""[^\s"'>]*{v}[^\s>]*""" if op == "has" else v
    return tag_where(name, attr, inner('[^"]'), inner("[^']"), bare)


def tag_where(name: str, attr: str, double: str, single: str, bare: str) -> str:
    """Pattern of an open tag whose attribute has a value of these patterns, by kind of quotes."""
    values = rf""""{double}"|'{single}'|{bare}(?=[\s>])"""
    return rf"(?i)<{name}{_attribute_before(attr)}(?:{values})(?:[\s/=]++|{_ATTRIBUTE})*+>"


def _col(pattern: str | Column) -> Column:
    return F.lit(pattern) if isinstance(pattern, str) else pattern


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it several times in ``body``."""
    return F.transform(F.array(value), body)[0]


def tail(items: Column) -> Column:
    """All items but the first."""
    return F.slice(items, 2, 1 << 30)


def noise_pattern(tags: Iterable[str]) -> str:
    """Pattern of comments and of whole elements of the given tags."""
    parts = ["!--.*?-->", *(rf"{t}{TAG_END}.*?</{t}\s*>" for t in tags)]
    return f"(?is)<(?:{'|'.join(parts)})"


def without_noise(html: Column, tags: Iterable[str] = tuple(NOISE_TAGS)) -> Column:
    """The page without comments and non-article elements."""
    return F.regexp_replace(html, noise_pattern(tags), "")


def open_tags(html: Column, pattern: str | Column) -> Column:
    """Every open tag that matches, in document order."""
    return F.regexp_extract_all(html, _col(pattern), 0)


# Finds the value of the attribute that is put for the sign.
_ATTRIBUTE_OF = r"(?is)^<[a-z][^\s/>]*+" + _attribute_before("@") + r"""(?:"([^"]*)"|'([^']*)'|([^\s"'>][^\s>]*))"""


def attribute(tag: Column, name: str | Column) -> Column:
    """Value of an attribute of an open tag; '' when absent, null without a tag."""
    pattern = F.replace(F.lit(_ATTRIBUTE_OF), F.lit("@"), _col(name))

    def value(t: Column) -> Column:
        return let(pattern, lambda p: F.when(t.isNotNull(), F.concat(
            *(F.call_function("regexp_extract", t, p, F.lit(group)) for group in (1, 2, 3)))))

    return let(tag, value)


def _tag_name(segment: Column) -> Column:
    return F.lower(F.regexp_extract(segment, "^<([a-zA-Z][a-zA-Z0-9]*)", 1))


def _cut_before(text: Column, pattern: Column, limit: int = -1) -> Column:
    """The text cut in front of every match; the first piece has none.

    The blank put first keeps a match at the very start from becoming it.
    """
    return F.split(F.concat(F.lit(" "), text), F.concat(F.lit("(?="), pattern, F.lit(")")), limit)


def _same_tag_pieces(text: Column, name: Column, limit: int = -1) -> Column:
    """Cut in front of every open or close tag of the given name."""
    return _cut_before(text, F.concat(F.lit("(?i)</?"), name, F.lit(r"[\s/>]")), limit)


def _behind_tag(segment: Column) -> Column:
    """What follows the tag that starts ``segment``."""
    return F.regexp_replace(segment, f"^{ANY_TAG}", "")


def _closes(piece: Column) -> Column:
    return F.startswith(piece, F.lit("</"))


def _balanced(segment: Column) -> Column:
    """struct(inner, closed) of the element whose open tag starts ``segment``.

    When the next tag of the name is a close tag the rest is not looked at.
    """

    def step(acc: Column, piece: Column) -> Column:
        moved = F.when(acc["n"] == 0, 0).when(_closes(piece), -1).otherwise(1)
        depth = acc["depth"] + moved
        kept = acc["n"] + F.when(depth == 0, 0).otherwise(1)
        return F.when(acc["depth"] == 0, acc).otherwise(F.struct(depth.alias("depth"), kept.alias("n")))

    def counted(pieces: Column) -> Column:
        start = F.struct(F.lit(1).alias("depth"), F.lit(0).alias("n"))
        return let(F.aggregate(pieces, start, step), lambda end: F.struct(
            F.array_join(F.slice(pieces, 1, end["n"]), "").alias("inner"),
            (end["depth"] == 0).alias("closed")))

    def flat_or_counted(body: Column) -> Column:
        name = _tag_name(segment)
        return let(_same_tag_pieces(body, name, 2), lambda p: F.when(
            (F.size(p) > 1) & _closes(F.get(p, F.lit(1))),
            F.struct(p[0].alias("inner"), F.lit(True).alias("closed"))
        ).otherwise(let(_same_tag_pieces(body, name), counted)))

    return let(_behind_tag(segment), flat_or_counted)


def _from(segments: Column, i: Column, done: Callable[[Column, Column], Column]) -> Column:
    """The first result of ``done(text, last)`` that is not null, for texts that start with segment ``i``.

    The texts have one, two, four and more segments, so no more is read than twice what
    is needed; ``last`` tells that there are no more.
    """
    size = F.size(segments)
    counts = F.transform(F.sequence(F.lit(0), F.lit(30)), lambda k: F.call_function("shiftleft", F.lit(1), k))
    enough = F.filter(counts, lambda n: (n == 1) | (F.call_function("shiftright", n, F.lit(1)) < size - i))

    def attempt(found: Column, n: Column) -> Column:
        text = F.when(n == 1, F.element_at(segments, i + 1)).otherwise(F.array_join(F.slice(segments, i + 1, n), ""))
        return F.when(found.isNotNull(), found).otherwise(done(text, n >= size - i))

    return F.aggregate(enough, F.lit(None).cast("string"), attempt)


def _element(segments: Column, i: Column) -> Column:
    """Inner HTML of the element that opens segment ``i`` (counted from 0)."""
    return _from(segments, i, lambda text, last: let(
        _balanced(text), lambda b: F.when(b["closed"] | last, b["inner"])))


def _segments(html: Column, pattern: str | Column) -> Column:
    return tail(_cut_before(html, _col(pattern)))


def elements(html: Column, pattern: str | Column) -> Column:
    """Inner HTML of every matching element, in document order."""
    return let(_segments(html, pattern), lambda s: F.transform(s, lambda _, i: _element(s, i)))


def first_element(html: Column, pattern: str | Column) -> Column:
    """Inner HTML of the first matching element, null without one."""
    return let(F.get(_cut_before(html, _col(pattern), 2), F.lit(1)), lambda s: _balanced(s)["inner"])


# Marks of tags are kept in strings of this length.
_MARKS = 256


def without_elements(html: Column, pattern: Column, name: Column) -> Column:
    """The page with every element of the pattern cut out, nested ones included.

    One pass over the tags of the name marks each as outside, inside or closing; marks are
    collected in strings of bounded length, so a page costs the time of its tags.
    """

    def step(acc: Column, piece: Column) -> Column:
        opens = ~F.startswith(piece, F.lit("</"))
        matches = opens & F.regexp(piece, F.concat(F.lit("^"), pattern))
        depth = (
            F.when(acc["depth"] > 0, acc["depth"] + F.when(opens, 1).otherwise(-1))
            .when(matches, 1).otherwise(0))
        mark = F.when(depth > 0, "i").when(acc["depth"] > 0, "c").otherwise("o")
        return let(F.length(acc["marks"]) == _MARKS, lambda full: F.struct(
            depth.alias("depth"), F.when(full, mark).otherwise(F.concat(acc["marks"], mark)).alias("marks"),
            F.when(full, F.concat(acc["full"], F.array(acc["marks"]))).otherwise(acc["full"]).alias("full")))

    def cut(pieces: Column) -> Column:
        start = F.struct(F.lit(0).alias("depth"), F.lit("").alias("marks"), F.array().cast("array<string>").alias("full"))
        marks = F.aggregate(tail(pieces), start, step, lambda acc: F.concat(acc["full"], F.array(acc["marks"])))

        def kept(m: Column) -> Column:
            return F.transform(tail(pieces), lambda p, i: let(
                F.substring(F.get(m, F.floor(i / _MARKS).cast("int")), i % _MARKS + 1, F.lit(1)),
                lambda k: F.when(k == "o", p).when(k == "c", _behind_tag(p)).otherwise("")))

        return F.concat(pieces[0], F.array_join(let(marks, kept), ""))

    cut_out = let(_same_tag_pieces(html, name), cut)
    return F.when(F.regexp(html, pattern), cut_out).otherwise(html)


# Entities replaced one after the other, ``&amp;`` last.
BASIC_ENTITIES = [
    ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&#39;", "'"),
    ("&nbsp;", "\u00a0"), ("&middot;", "·"), ("&copy;", "©"), ("&amp;", "&"),
]


# The names that HTML also reads without a semicolon are those of Python's table without one.
BARE_NAMES = sorted((name for name in html5 if not name.endswith(";")), key=lambda n: (-len(n), n))
BARE_ENTITY = f"^({'|'.join(BARE_NAMES)})"
NAMED_ENTITIES = (
    {name: chr(code) for name, code in name2codepoint.items()} | {"apos": "'"} | {n: html5[n] for n in BARE_NAMES})


def decode_entities(text: Column) -> Column:
    """HTML entities to characters, each decoded once.

    Text with only basic entities takes a chain of plain replacements; other
    named and numeric entities take a split at every ampersand.
    """
    def chain(value: Column) -> Column:
        for entity, char in BASIC_ENTITIES:
            value = F.replace(value, F.lit(entity), F.lit(char))
        return value

    # Folded to one literal map when the plan is optimised.
    names = F.from_json(F.lit(json.dumps(NAMED_ENTITIES)), "map<string,string>")

    def one(piece: Column) -> Column:
        ref = F.regexp_extract(piece, "^(#[0-9]+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*);", 1)
        # Zeros in front don't count; no character has more digits than this.
        digits = F.regexp_extract(ref, "^#0*([0-9]{1,7})$", 1)
        hexed = F.regexp_extract(ref, "^#[xX]0*([0-9a-fA-F]{1,6})$", 1)
        code = F.when(hexed != "", F.conv(hexed, 16, 10)).when(digits != "", digits).cast("long")
        valid = (code > 0) & (code < 0x110000) & ~code.between(0xD800, 0xDFFF)
        numeric = F.when(valid, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32"))
        char = F.when(F.startswith(ref, F.lit("#")), numeric).otherwise(F.try_element_at(names, ref))
        after = F.substring(piece, F.length(ref) + 2, F.length(piece))
        bare = F.regexp_extract(piece, BARE_ENTITY, 1)
        old = F.concat(F.try_element_at(names, bare), F.substring(piece, F.length(bare) + 1, F.length(piece)))
        return F.coalesce(F.concat(char, after), F.when(bare != "", old), F.concat(F.lit("&"), piece))

    def general(value: Column) -> Column:
        return let(F.split(value, "&"), lambda pieces: F.concat(
            pieces[0], F.array_join(F.transform(tail(pieces), one), "")))

    rare = "&(?!(?:lt|gt|quot|apos|#39|nbsp|middot|copy|amp);)(?:#|[A-Za-z])"
    return let(text, lambda t: (
        F.when(~F.contains(t, F.lit("&")), t).when(t.rlike(rare), general(t)).otherwise(chain(t))))


def text_of(fragment: Column) -> Column:
    """Text of a fragment: tags dropped, entities decoded. A ``<`` that starts no tag is text."""
    return decode_entities(F.regexp_replace(fragment, ANY_TAG, ""))


def _upto_end(text: Column) -> Column:
    """Text up to the end of the open paragraph.

    A replacement keeps its compiled pattern from row to row; a split does not.
    """
    return F.regexp_replace(text, f"(?s){PARAGRAPH_END}.*", "")


def paragraphs(fragment: Column) -> Column:
    """Text of every ``p``, stripped. An unclosed ``p`` ends at the next block tag."""
    starts = tail(F.split(fragment, PARAGRAPH_OPEN))
    return F.transform(starts, lambda s: strip(text_of(_upto_end(s))))


def texts_of(fragment: Column, pattern: str | Column) -> Column:
    """Text of every matching element, stripped, nested elements repeated."""

    def paragraph(segments: Column, i: Column) -> Column:
        return _upto_end(_from(segments, i, lambda text, last: let(
            _behind_tag(text), lambda t: F.when(last | t.rlike(PARAGRAPH_END), t))))

    def one(segments: Column) -> Callable[[Column, Column], Column]:
        return lambda segment, i: strip(text_of(F.when(
            _tag_name(segment) == "p", paragraph(segments, i)).otherwise(_element(segments, i))))

    return let(_segments(fragment, pattern), lambda s: F.transform(s, one(s)))


def join_text(parts: Column, min_chars: Column | int = 0) -> Column:
    """Parts longer than ``min_chars``, joined by one blank."""
    return F.array_join(F.filter(parts, lambda t: F.length(t) > min_chars), " ")
