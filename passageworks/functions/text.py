"""Text columns: stripping, blank tests, paths, labels, markup and tables."""

from __future__ import annotations

import json
import re
import string
from collections.abc import Callable
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters Python's ``str.strip`` and ``str.isspace`` treat as white space.
WHITESPACE = "".join(c for c in map(chr, range(0x3001)) if c.isspace())


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once per row.

    A lambda variable is bound once, whatever the optimizer does with projections; written
    directly, an array used inside a lambda would be rebuilt for every element.
    """
    return F.transform(F.array(value), body)[0]


def strip(text: Column) -> Column:
    return F.trim(text, F.lit(WHITESPACE))


def is_blank(text: Column) -> Column:
    """At least one character and only white space; the empty string is not blank."""
    return (text != "") & (strip(text) == "")


def unify_newlines(text: Column) -> Column:
    return F.regexp_replace(text, r"\r\n?", "\n")


def escape_sql_text(text: Column) -> Column:
    r"""Doubled apostrophes, doubled backslashes, then one more ``\`` before each ``\u``."""
    doubled = F.replace(F.replace(text, F.lit("'"), F.lit("''")), F.lit("\\"), F.lit("\\\\"))
    return F.replace(doubled, F.lit("\\u"), F.lit("\\\\u"))


def sha256_hex(text: Column) -> Column:
    return F.sha2(text, 256)


# ---------------------------------------------------------------- paths and names


def local_path(uri: Column) -> Column:
    """Path of a file without the ``file:`` scheme, as a local program would spell it."""
    return F.regexp_replace(uri, r"^file:(//)?(?=/)", "")


def local_root(uri: str) -> str:
    """``local_path`` for one path given as text."""
    return re.sub(r"^file:(//)?(?=/)", "", uri)


def basename(path: Column) -> Column:
    return F.element_at(F.split(F.regexp_replace(path, r"/+$", ""), "/"), -1)


def extension(path: Column) -> Column:
    """Last suffix with its dot; names that only start with dots have none."""
    return F.regexp_extract(path, r"[^/.][^/]*?(\.[^./]*)$", 1)


def relative_to(path: Column, root: str) -> Column:
    prefix = root.rstrip("/") + "/"
    return F.when(
        path.startswith(prefix), F.substring(path, len(prefix) + 1, 1 << 30)
    ).otherwise(path)


def repo_of(path: Column, root: str) -> Column:
    """First path component below ``root``."""
    return F.split(relative_to(path, root), "/")[0]


def cache_name(repo: Column, strategy: Column, file_format: str) -> Column:
    suffixes = {"json": "json", "parquet": "parquet"}
    outside = r"[^\p{L}\p{N}_\-]"
    return F.concat(
        F.lit("embeddings_"),
        F.regexp_replace(repo, outside, "_"),
        F.lit("_"),
        F.regexp_replace(strategy, outside, "_"),
        F.lit("." + suffixes.get(file_format.lower(), "pkl")),
    )


# ---------------------------------------------------------------- HTML

# Named character references whose replacement is not left to the table of HTML 5.
ENTITIES = {
    "&lt;": "<",
    "&gt;": ">",
    "&quot;": '"',
    "&apos;": "'",
    "&nbsp;": " ",
    "&middot;": "·",
    "&copy;": "©",
    "&reg;": "®",
    "&trade;": "™",
    "&hellip;": "…",
    "&ndash;": "–",
    "&mdash;": "—",
    "&lsquo;": "‘",
    "&rsquo;": "’",
    "&ldquo;": "“",
    "&rdquo;": "”",
    "&bull;": "•",
    "&euro;": "€",
}


def _code_point(digits: Column, base: int) -> Column:
    """The character of a number; U+FFFD beyond Unicode, for surrogates and for zero."""
    value = F.conv(digits, base, 10).cast("long")
    valid = ((value > 0) & (value < 0xD800)) | ((value > 0xDFFF) & (value <= 0x10FFFF))
    number = F.conv(F.when(valid, value).otherwise(0xFFFD).cast("string"), 10, 16)
    return F.decode(F.unhex(F.lpad(number, 8, "0")), "UTF-32")


def _numeric_reference(piece: Column) -> Column:
    """A piece of text that followed ``&#``: its leading reference as a character."""
    decimal = F.regexp_extract(piece, r"^0*([0-9]{1,12});", 1)
    hexadecimal = F.regexp_extract(piece, r"^[xX]0*([0-9a-fA-F]{1,12});", 1)
    rest = F.regexp_replace(piece, r"^[xX]?[0-9a-fA-F]+;", "")
    return (
        F.when(decimal != "", F.concat(_code_point(decimal, 10), rest))
        .when(hexadecimal != "", F.concat(_code_point(hexadecimal, 16), rest))
        .otherwise(F.concat(F.lit("&#"), piece))
    )


def _references() -> Column:
    """Name (with its semicolon) to characters: the names of HTML 5, and the fixed ones above."""
    names = {name: found for name, found in html5.items() if name.endswith(";")}
    names |= {name[1:]: found for name, found in ENTITIES.items()}
    return F.from_json(F.lit(json.dumps(names)), "map<string, string>")


def _reference(piece: Column) -> Column:
    """A piece of text that followed ``&``; what is no reference stays as it is."""
    name = F.regexp_extract(piece, r"^([A-Za-z][A-Za-z0-9]{1,31};)", 1)
    found = F.when(name != "", F.try_element_at(_references(), name))
    rest = F.substr(piece, F.char_length(name) + 1)
    return F.when(
        F.startswith(piece, F.lit("#")), _numeric_reference(F.substr(piece, F.lit(2)))
    ).otherwise(F.coalesce(F.concat(found, rest), F.concat(F.lit("&"), piece)))


def unescape_entities(text: Column) -> Column:
    """Numeric and named references as characters, each once, in one pass over the text."""
    return F.when(
        F.contains(text, F.lit("&")),
        let(
            F.split(text, "&", -1),
            lambda parts: F.array_join(
                F.transform(parts, lambda p, i: F.when(i == 0, p).otherwise(_reference(p))), ""
            ),
        ),
    ).otherwise(text)


# Markup is cut at its closing marks first: in each part the opening mark, if any, is looked for
# once, so pages full of elements that never close cost no more than others.


def _parts(text: Column, closing: str, body: Callable[[Column, Column, Column], Column]) -> Column:
    """The parts of a text before each closing mark, changed by ``body(part, i, n)`` and joined."""

    def changed(parts: Column) -> Column:
        n = F.size(parts)
        return F.array_join(F.transform(parts, lambda part, i: body(part, i, n)), "")

    return let(F.split(text, closing, -1), changed)


def _element_contents(text: Column, name: str) -> Column:
    """Contents of the closed elements of a name, from the first opening tag of each."""

    def contents(parts: Column) -> Column:
        opened = F.transform(
            F.slice(parts, F.lit(1), F.size(parts) - 1),
            lambda part: F.regexp_extract(part, rf"(?is)<{name}\b.*", 0),
        )
        return F.transform(
            F.filter(opened, lambda element: element != ""),
            lambda element: F.regexp_replace(element, r"(?s)^<[^>]*>", ""),
        )

    return let(F.split(text, rf"(?i)</{name}\s*>", -1), contents)


def _without_elements(text: Column, name: str) -> Column:
    return _parts(
        text,
        rf"(?i)</{name}\s*>",
        lambda part, i, n: F.when(
            i < n - 1, F.regexp_replace(part, rf"(?is)<{name}\b.*", "")
        ).otherwise(part),
    )


def _without_comments(text: Column) -> Column:
    return _parts(
        text,
        "-->",
        lambda part, i, n: F.when(i == n - 1, part)
        .when(F.contains(part, F.lit("<!--")), F.regexp_replace(part, r"(?s)<!--.*", ""))
        .otherwise(F.concat(part, F.lit("-->"))),
    )


def _without_tags(text: Column) -> Column:
    tag = r"</?[a-zA-Z!?]"
    return _parts(
        text,
        ">",
        lambda part, i, n: F.when(i == n - 1, part)
        .when(part.rlike(tag), F.regexp_replace(part, rf"(?s){tag}.*", ""))
        .otherwise(F.concat(part, F.lit(">"))),
    )


def _without_markup(html: Column) -> Column:
    """Whole script, style and template elements, comments, the doctype and all tags removed.

    Script and style go first because their text may contain closing tags.
    """
    for name in ("script", "style", "template"):
        html = _without_elements(html, name)
    return _without_tags(_without_comments(html))


_TABLE = r"(?i)<table\b"


def _table_depths(parts: Column) -> Column:
    """How many tables are open at the end of each part before a closing tag, its own counted."""
    opened = F.transform(parts, lambda p: F.regexp_count(p, F.lit(_TABLE)))

    def depth(opened: Column) -> Column:
        return F.transform(
            opened,
            lambda _, i: F.aggregate(F.slice(opened, F.lit(1), i + 1), F.lit(0), lambda a, b: a + b) - i,
        )

    return let(opened, depth)


def inline_inner_tables(html: Column) -> Column:
    """A table within a table as text of the cell that holds it: its cells, a space around each.

    So the commas and lines of the outer table stay its own. Each pass takes the innermost tables,
    which are those that no table opens within; there are as many passes as tables are nested deep.
    A page without nested tables is left as it is.
    """

    def one_level(page: Column) -> Column:
        def changed(parts: Column) -> Column:
            n = F.size(parts)
            return let(
                _table_depths(parts),
                lambda depth: F.array_join(
                    F.transform(
                        parts,
                        lambda part, i: F.when(i == n - 1, part)
                        .when((F.get(depth, i) >= 2) & part.rlike(_TABLE), inlined(part))
                        .otherwise(F.concat(part, F.lit("</table>"))),
                    ),
                    "",
                ),
            )

        def inlined(part: Column) -> Column:
            # Greedy, so the last opening tag of the part begins the table.
            before = F.regexp_extract(part, r"(?is)^(.*)<table\b", 1)
            table = F.regexp_extract(part, r"(?is)^.*(<table\b.*)$", 1)
            cells = F.array_join(_element_contents(table, "t[hd]"), " ")
            return F.concat(before, F.lit(" "), cells, F.lit(" "))

        return let(F.split(page, r"(?i)</table\s*>", -1), changed)

    def all_levels(parts: Column) -> Column:
        closed = F.slice(_table_depths(parts), F.lit(1), F.size(parts) - 1)
        return let(
            F.array_max(closed),
            lambda deepest: F.when(
                deepest >= 2,
                F.aggregate(F.sequence(F.lit(2), deepest), html, lambda page, _: one_level(page)),
            ).otherwise(html),
        )

    # Two opening tags without a closing one between; possessive, so a page is read once.
    nested = html.rlike(r"(?i)<table\b(?:[^<]++|<(?!/?table\b))*+<table\b")
    return F.when(nested, let(F.split(html, r"(?i)</table\s*>", -1), all_levels)).otherwise(html)


def linearize_html_table(
    table: Column, indicate_table: bool = True, separator: str = ","
) -> Column:
    """The paragraph that stands for one ``<table>`` element: a line for each row."""
    rows = F.transform(
        _element_contents(table, "tr"),
        lambda row: F.concat(
            F.array_join(_element_contents(row, "t[hd]"), separator), F.lit("\n")
        ),
    )
    head = "<p>Table:\n" if indicate_table else "<p>"
    return F.concat(F.lit(head), F.array_join(rows, ""), F.lit("</p>"))


def replace_html_tables(
    html: Column, indicate_table: bool = True, separator: str = ","
) -> Column:
    """Every table element replaced by its paragraph; a page without one is left as it is.

    Tables within tables become text of the cells that hold them first.
    """
    return let(
        inline_inner_tables(html), lambda flat: _replace_flat_tables(flat, indicate_table, separator)
    )


def _replace_flat_tables(html: Column, indicate_table: bool, separator: str) -> Column:
    opening = r"(?is)<table\b.*"

    def paragraph(part: Column, i: Column, n: Column) -> Column:
        table = F.regexp_extract(part, opening, 0)
        text = linearize_html_table(table, indicate_table, separator)
        return F.when(
            (i < n - 1) & part.rlike(r"(?i)<table\b"),
            F.concat(F.regexp_replace(part, opening, ""), text),
        ).otherwise(part)

    replaced = _parts(html, r"(?i)</table\s*>", paragraph)
    return F.when(html.rlike(r"(?i)</table"), replaced).otherwise(html)


def html_to_text(html: Column, indicate_table: bool = True, separator: str = ",") -> Column:
    bare = _without_markup(replace_html_tables(html, indicate_table, separator))
    return let(bare, unescape_entities)


def linearize_cells(rows: Column, n_columns: Column) -> Column:
    """Text of a word-processor table given as ``array<array<string>>``."""

    def line(row: Column) -> Column:
        cells = F.transform(
            row,
            lambda cell: F.when(
                n_columns > 1, F.replace(cell, F.lit("\n"), F.lit(" "))
            ).otherwise(cell),
        )
        return F.concat(F.array_join(cells, ","), F.lit("\n"))

    return F.concat(F.lit("Table:\n"), F.array_join(F.transform(rows, line), ""))


# ---------------------------------------------------------------- Markdown

# Marks inside code, and escaped ones, are set aside while the line's other marks go: as the 32
# code points that Unicode keeps for use inside a program. A line that holds one is left alone.
_MARKS = string.punctuation
_SET_ASIDE = "".join(chr(0xFDD0 + i) for i in range(len(_MARKS)))
_WORD = r"\p{L}\p{N}_"
_TARGET = r"\([^()]*(?:\([^()]*\)[^()]*)?\)"

# Every pattern stops at the next mark of its kind, so a line is read once, not once per mark.
# None repeats a group: the engine would recurse for each repetition of it on a long line.
_INLINE = [
    (rf"!\[[^\[\]]*\]{_TARGET}", ""),  # images have no text
    (rf"\[([^\[\]]*)\]{_TARGET}", "$1"),  # links keep their label
    (r"\[([^\[\]]*)\]\[[^\[\]]*\]", "$1"),
    (r"<((?:https?|mailto):[^<>\s]*)>", "$1"),
    (r"</?[a-zA-Z][a-zA-Z0-9-]*(?:\s[^<>]*)?/?>", ""),
    (r"(?<!\*)\*(?=[^\s*])([^*]*)(?<!\s)\*(?!\*)", "$1"),
    (r"\*\*(?=[^\s*])([^*]*)(?<!\s)\*\*", "$1"),
    (r"(?<!\*)\*(?=[^\s*])([^*]*)(?<!\s)\*(?!\*)", "$1"),
    (rf"(?<![{_WORD}])_(?=[^\s_])([^_]*)(?<!\s)_(?![{_WORD}])", "$1"),
    (rf"(?<![{_WORD}])__(?=[^\s_])([^_]*)(?<!\s)__(?![{_WORD}])", "$1"),
    (r"~~(?=[^\s~])([^~]*)(?<!\s)~~", "$1"),
]

# Quote marks, heading marks and list marks at the start of a line.
_BLOCK = [
    (r"^ {0,3}>[> ]*", ""),
    (r"^ {0,3}#{1,6}(?:[ \t]+|$)", ""),
    (r"^[ \t]*+(?:[-*+]|[0-9]{1,9}[.)])[ \t]+", ""),
    (r"^[ \t]+", ""),
]
_LIST_MARK = r"(?:[-*+]|[0-9]{1,9}[.)])[ \t]"

# A fence ends at a line of at least as many marks of its kind, or with the text.
_FENCE = (
    r"(?mds)^ {0,3}(?:(`{3,})[^`\n]*|(~{3,})[^\n]*)(?:\n|\z)(.*?)"
    r"(?:^ {0,3}(?:\1`*|\2~*)[ \t]*(?:\n|\z)|\z)"
)
# A run of blank lines, entered at its first character only, up to the last line end in it.
_BLANK_LINES = r"(?<![ \t\n])[ \t]*\n[ \t\n]*\n"


def _replace_all(text: Column, steps: list[tuple[str, str]]) -> Column:
    for pattern, replacement in steps:
        text = F.regexp_replace(text, pattern, replacement)
    return text


def _code_set_aside(line: Column) -> Column:
    """Code spans without their backticks; a line with an odd number of them has none."""

    def by_part(parts: Column) -> Column:
        balanced = F.size(parts) % 2 == 1
        aside = F.transform(
            parts,
            lambda p, i: F.when(i % 2 == 1, F.translate(p, _MARKS, _SET_ASIDE)).otherwise(
                _escapes_set_aside(p)
            ),
        )
        return F.when(balanced, F.array_join(aside, "")).otherwise(_escapes_set_aside(line))

    return F.when(F.contains(line, F.lit("`")), let(F.split(line, "`", -1), by_part)).otherwise(
        _escapes_set_aside(line)
    )


def _aside(mark: str) -> str:
    return _SET_ASIDE[_MARKS.index(mark)]


def _escapes_set_aside(text: Column) -> Column:
    """Marks behind a backslash, without it; a backslash before anything else stays."""

    def by_part(part: Column, i: Column) -> Column:
        first = F.translate(F.left(part, F.lit(1)), _MARKS, _SET_ASIDE)
        escaped = F.concat(first, F.substr(part, F.lit(2)))
        plain = F.when(first == F.left(part, F.lit(1)), F.concat(F.lit("\\"), part))
        return F.when(i == 0, part).otherwise(F.coalesce(plain, escaped))

    # Escaped backslashes go first, so the others stand alone.
    single = F.replace(text, F.lit("\\\\"), F.lit(_aside("\\")))
    joined = let(F.split(single, r"\\", -1), lambda parts: F.array_join(F.transform(parts, by_part), ""))
    return F.when(F.contains(text, F.lit("\\")), joined).otherwise(text)


def _inline_markdown(line: Column) -> Column:
    def without_marks(text: Column) -> Column:
        # An escaped backtick opens no code.
        whole = F.replace(text, F.lit("\\`"), F.lit(_aside("`")))
        plain = _replace_all(_code_set_aside(whole), _INLINE)
        # References are resolved here, so that those inside code stay as they are written.
        resolved = let(plain, unescape_entities)
        return F.translate(resolved, _SET_ASIDE, _MARKS)

    marked = r"^[^\x{FDD0}-\x{FDEF}]*[*_~`\[<&\\][^\x{FDD0}-\x{FDEF}]*$"
    return let(line, lambda x: F.when(x.rlike(marked), without_marks(x)).otherwise(x))


def _is_table_rule(line: Column) -> Column:
    return (
        F.contains(line, F.lit("|"))
        & F.contains(line, F.lit("-"))
        & (F.translate(line, " \t|:-", "") == "")
    )


def _is_horizontal_rule(line: Column) -> Column:
    """Three or more of one mark and nothing else but spaces."""
    marks = F.translate(line, " \t", "")
    same = [F.translate(marks, mark, "") == "" for mark in "*-_"]
    # The pattern lets most lines go at their first character.
    only_marks = line.rlike(r"^[ \t]*[-*_][-*_ \t]*$")
    return only_marks & (F.char_length(marks) >= 3) & (same[0] | same[1] | same[2])


def _table_row(line: Column, separator: str) -> Column:
    """The cells between the outer pipes, joined by the separator; an escaped pipe is text."""
    pipe = r"(?<=(?<!\\)(?:\\\\){0,8})\|"
    inner = strip(line)
    inner = F.regexp_replace(inner, rf"^\||{pipe}$", "")
    cells = F.transform(
        F.split(inner, pipe, -1),
        lambda c: _inline_markdown(F.replace(strip(c), F.lit("\\|"), F.lit("|"))),
    )
    return F.array_join(cells, separator)


def _paragraph_line(line: Column, following: Column) -> Column:
    """A line without block marks, indent, spaces at its end, and the backslash that breaks it."""
    marks = F.char_length(line) - F.char_length(F.rtrim(line, F.lit("\\")))
    ends = following.isNull() | following.rlike(rf"^ {{0,3}}(?:>|#{{1,6}}(?:[ \t]|$)|{_LIST_MARK})")
    broken = (marks % 2 == 1) & ~ends & ~line.rlike(r"^ {0,3}#{1,6}[ \t]")
    whole = F.when(broken, F.left(line, F.char_length(line) - 1)).otherwise(F.rtrim(line, F.lit(" \t")))
    return _inline_markdown(_replace_all(whole, _BLOCK))


def _markdown_lines(part: Column, indicate_tables: bool, separator: str) -> Column:
    def convert(lines: Column) -> Column:
        def line(text: Column, i: Column) -> Column:
            row = _table_row(text, separator)
            if indicate_tables:
                is_head = F.coalesce(_is_table_rule(F.get(lines, i + 1)), F.lit(False))
                row = F.when(is_head, F.concat(F.lit("Table:\n"), row)).otherwise(row)
            bare = strip(text)
            is_row = F.contains(text, F.lit("|")) & bare.startswith("|") & bare.endswith("|")
            is_row = is_row & (F.char_length(bare) > 1)
            # Below a head and its rule, cells need no outer pipes.
            in_table = F.coalesce(_is_table_rule(F.get(lines, F.lit(1))), F.lit(False))
            is_row = is_row | (in_table & F.contains(text, F.lit("|")))
            above = F.coalesce(strip(F.get(lines, i - 1)), F.lit(""))
            underline = (above != "") & text.rlike(r"^ {0,3}=+[ \t]*$")
            definition = text.rlike(r"^ {0,3}\[[^\[\]]+\]:[ \t]*[^ \t]+")
            return (
                F.when(_is_table_rule(text) | underline | definition, F.lit(None).cast("string"))
                .when(_is_horizontal_rule(text), F.lit(""))
                .when(is_row, row)
                .otherwise(_paragraph_line(text, F.get(lines, i + 1)))
            )

        # array_join leaves out the null that stands for a table's rule line.
        return F.array_join(F.transform(lines, line), "\n")

    def block(text: Column) -> Column:
        listed = text.rlike(rf"^[ \t]+{_LIST_MARK}")
        code = text.rlike(r"^(?: {4}|\t)") & ~listed

        def by_kind(parts: Column) -> Column:
            kept = F.regexp_replace(F.when(code, parts[0]), r"(?m)^(?: {4}|\t)", "")
            rest = F.when(code, F.get(parts, F.lit(1))).otherwise(text)
            return F.concat_ws("\n", kept, let(F.split(rest, "\n", -1), convert))

        # Code ends at the first line that is not indented.
        return let(F.split(text, r"\n(?! {4}|\t)", 2), by_kind)

    def section(blocks: Column) -> Column:
        first = F.get(blocks, F.lit(0))
        in_list = first.rlike(rf"(?md)^ {{0,3}}{_LIST_MARK}") & ~_is_horizontal_rule(first)

        def unindented(text: Column, i: Column) -> Column:
            mark = rf"(?mds)\A.*^([ \t]*+{_LIST_MARK}[ \t]*)"
            above = F.char_length(F.regexp_extract(F.get(blocks, i - 1), mark, 1))
            width = F.when(above > 0, above).otherwise(F.char_length(F.regexp_extract(first, mark, 1)))
            indent = F.concat(F.lit(r"(?md)^(?:\t| {0,"), width.cast("string"), F.lit("})"))
            return F.when((i > 0) & in_list, F.regexp_replace(text, indent, F.lit(""))).otherwise(text)

        return F.array_join(F.transform(blocks, lambda b, i: let(unindented(b, i), block)), "\n")

    # Blank lines part blocks: tables, paragraphs, and code that is indented. A section is a block
    # and the indented ones below it, which go on with a list if the block has one.
    sections = F.split(F.regexp_replace(part, r"^\n+", ""), rf"{_BLANK_LINES}(?=[^ \t\n])", -1)
    return F.array_join(
        F.transform(sections, lambda s: let(F.split(s, _BLANK_LINES, -1), section)), "\n"
    )


def markdown_to_text(
    text: Column, indicate_tables: bool = True, table_separator: str = ","
) -> Column:
    """Plain text of a Markdown document, for the common block and inline marks.

    Fenced code is kept as it stands; blank lines between blocks become one line break.
    """


    def plain(part: Column) -> Column:
        lines = _markdown_lines(part, indicate_tables, table_separator)
        return F.regexp_replace(lines, r"\n{2,}", "\n")

    def converted(whole: Column) -> Column:
        code = F.regexp_extract_all(whole, F.lit(_FENCE), F.lit(3))
        parts = F.transform(F.split(whole, _FENCE, -1), plain)
        pairs = F.zip_with(parts, code, lambda p, c: F.concat(p, F.coalesce(c, F.lit(""))))
        return F.regexp_replace(F.array_join(pairs, ""), r"^\n+", "")

    return let(text, converted)
