r"""Text normalisation, hashing, chunking and formatting as column expressions.

Patterns are Java regular expressions that follow Python's rules: (?U) makes \s, \d
and \w cover Unicode, (?d) lets only \n end a line, (?iu) folds all letters.
"""

from __future__ import annotations

import functools
import html
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.functions.embed import let

# Patterns and their replacements, applied in this order.
INVISIBLE = r"[​-‏﻿‪-‮\x00-\x08\x0B\x0C\x0E-\x1F\x7F]"
HTML_STEPS = (
    (r"(?dis)<script[^>]*>.*?</script>", ""),
    (r"(?dis)<style[^>]*>.*?</style>", ""),
    (r"(?di)<h1[^>]*>(.*?)</h1>", "# $1\n"),
    (r"(?di)<h2[^>]*>(.*?)</h2>", "## $1\n"),
    (r"(?di)<h3[^>]*>(.*?)</h3>", "### $1\n"),
    (r"(?di)<strong[^>]*>(.*?)</strong>", "**$1**"),
    (r"(?di)<b[^>]*>(.*?)</b>", "**$1**"),
    (r"(?di)<em[^>]*>(.*?)</em>", "*$1*"),
    (r"(?di)<i[^>]*>(.*?)</i>", "*$1*"),
    (r"(?di)<a[^>]*href=[\"']([^\"']*)[\"'][^>]*>(.*?)</a>", "[$2]($1)"),
    (r"(?di)<code[^>]*>(.*?)</code>", "`$1`"),
    (r"(?dis)<pre[^>]*>(.*?)</pre>", "```\n$1\n```"),
    (r"(?di)<li[^>]*>(.*?)</li>", "- $1\n"),
    (r"(?Ui)<br\s*/?>", "\n"),
    (r"(?dis)<p[^>]*>(.*?)</p>", "$1\n\n"),
    (r"<[^>]+>", ""),
)
FENCE = r"(?dsU)```(\w+)?\n.*?```"
INLINE_CODE = r"`[^`]+`"
SEPARATORS = r"[-=*_]{3,}"
URL = r"(?iuU)https?://[^\s]+"
LOG_STEPS = (
    (r"(?iu)\[(INFO|ERROR|DEBUG|WARN|WARNING|TRACE)\]", ""),
    (r"(?U)\d{4}-\d{2}-\d{2}\s+\d{2}:\d{2}:\d{2}", ""),
    (r"(?iuU)(User|Member)\s+(joined|left)\s+(channel|room)", ""),
)
MARKDOWN_STEPS = (
    (r"(?dmU)^#{1,6}\s+", ""),
    (r"[*_]{1,3}([^*_]+)[*_]{1,3}", "$1"),
    (r"\[([^\]]+)\]\([^\)]+\)", "$1"),
    (r"!\[([^\]]*)\]\([^\)]+\)", "$1"),
    (r"(?dmU)^>\s+", ""),
    (r"(?dmU)^[-*+]\s+", ""),
    (r"(?dmU)^\d+\.\s+", ""),
)
INJECTION_STEPS = (
    (r"(?iuU)system:\s*ignore\s+previous", ""),
    (r"(?iuU)ignore\s+all\s+previous\s+instructions", ""),
    (r"(?iuU)disregard\s+all\s+previous", ""),
    (r"(?iuU)forget\s+everything", ""),
)
#: What \s is under (?U), and the separators that Python takes for white space.
SPACES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
CHUNK_OVER, CHUNK_SIZE, HASH_WINDOW = 4000, 3800, 512
TITLE_RUN = r"(\p{L}+|[^\p{L}]+)"


def _steps(c: Column, steps: tuple[tuple[str, str], ...]) -> Column:
    for pattern, replacement in steps:
        c = F.regexp_replace(c, pattern, replacement)
    return c


def strip(c: Column) -> Column:
    """Without white space (Unicode) at either end; only the ends are looked at."""
    return F.btrim(c, F.lit(SPACES))


def is_blank(c: Column) -> Column:
    """Null, empty or white space only."""
    return ~F.coalesce(F.rlike(c, F.lit(r"(?U)[^\s\x1C-\x1F]")), F.lit(False))


def remove_invisible(c: Column) -> Column:
    return F.regexp_replace(c, INVISIBLE, "")


def collapse(c: Column) -> Column:
    """All white space runs to one space."""
    return F.regexp_replace(c, r"(?U)[\s&&[^ ]]\s*| \s+", " ")  # a single space stays as it is


def normalize_whitespace(c: Column, *, preserve_newlines: bool = True) -> Column:
    """At most one blank line in a row, then no white space at the ends of lines; or everything on one line."""
    if not preserve_newlines:
        return strip(collapse(c))
    return F.regexp_replace(F.regexp_replace(c, r"\n{3,}", "\n\n"), r"(?U)[\s&&[^\n]]+(?=\n|\z)", "")


@F.pandas_udf(T.StringType())
def _unescape(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in batches:
        yield texts.map(html.unescape, na_action="ignore")


def unescape_entities(c: Column) -> Column:
    """All HTML entities; only the library's full table knows them, so this runs in Arrow batches."""
    return _unescape(c)


def html_to_markdown(c: Column, *, entities: bool = True) -> Column:
    """Entities, then the tag patterns in order, then white space; entities=False for texts known to hold none."""
    return normalize_whitespace(_steps(unescape_entities(c) if entities else c, HTML_STEPS))


def normalize(c: Column, content_type: Column | None = None, *, html_types: bool = True) -> Column:
    """The clean form of a message: no invisible characters, HTML as Markdown, tidy white space."""
    bare = remove_invisible(c)
    tidy = normalize_whitespace(bare)
    if content_type is not None and html_types:
        of_html = F.when(content_type == "html", bare)  # Python gets no other text
        tidy = F.when(content_type == "html", html_to_markdown(of_html)).otherwise(tidy)
    return strip(tidy)


def replace_code(c: Column) -> Column:
    """Fenced code to [CODE_BLOCK: language] (default code), inline code to [CODE]."""
    fenced = F.regexp_replace(c, FENCE, "[CODE_BLOCK: $1]")
    return F.regexp_replace(F.replace(fenced, F.lit("[CODE_BLOCK: ]"), F.lit("[CODE_BLOCK: code]")), INLINE_CODE, "[CODE]")


def strip_separators(c: Column) -> Column:
    return F.regexp_replace(c, SEPARATORS, " ")


def replace_urls(c: Column) -> Column:
    return F.regexp_replace(c, URL, "[URL]")


def remove_logs(c: Column) -> Column:
    return _steps(c, LOG_STEPS)


def strip_markdown(c: Column) -> Column:
    return _steps(c, MARKDOWN_STEPS)


def remove_injections(c: Column) -> Column:
    return _steps(c, INJECTION_STEPS)


def vectorizable(c: Column) -> Column:
    """The text that is embedded: code, separators, URLs, logs, Markdown, white space, injections, in that order."""
    for step, needed in ((replace_code, ("`", "[CODE_BLOCK: ]")), (strip_separators, tuple("-=*_")), (replace_urls, ("://",)), (remove_logs, None), (strip_markdown, None), (collapse, None)):
        c = _where(c, needed, step) if needed else step(c)
    return strip(let(c, lambda t: F.when(F.rlike(t, F.lit(r"(?iu)previous|everything")), remove_injections(t)).otherwise(t)))


def _where(c: Column, needed: tuple[str, ...], step: Callable[[Column], Column]) -> Column:
    """step(c) for texts that hold one of the needed strings, without which it changes nothing: a look for a string costs little beside a pattern."""
    return let(c, lambda t: F.when(functools.reduce(lambda a, b: a | b, [F.contains(t, F.lit(n)) for n in needed]), step(t)).otherwise(t))


def code_blocks(c: Column) -> Column:
    """Array of (language, code, line) of the fenced blocks; line counts from 1."""
    pattern = F.lit(r"(?dsU)```(\w+)?\n(.*?)```")
    whole, languages, codes = (F.regexp_extract_all(c, pattern, F.lit(i)) for i in range(3))
    found = F.struct(whole.alias("whole"), languages.alias("languages"), codes.alias("codes"), F.split(c, r"(?dsU)```(?:\w+)?\n(?:.*?)```", -1).alias("between"))
    before = lambda a, n: F.array_join(F.slice(a, F.lit(1), n), "")
    newlines = lambda text: F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))

    def blocks(f: Column) -> Column:
        return F.transform(
            f["whole"],
            lambda _, i: F.struct(
                F.when(F.get(f["languages"], i) == "", "text").otherwise(F.get(f["languages"], i)).alias("language"),
                strip(F.get(f["codes"], i)).alias("code"),
                (newlines(before(f["between"], i + 1)) + newlines(before(f["whole"], i)) + 1).alias("line"),
            ),
        )

    return F.transform(F.array(found), blocks)[0]  # the texts are searched once, not for each block


def content_hash(c: Column) -> Column:
    return F.sha2(c, 256)


def chunk_hashes(c: Column, size: int = HASH_WINDOW) -> Column:
    """SHA-256 of windows of `size` characters; an empty text has none."""
    starts = F.sequence(F.lit(1), F.length(c), F.lit(size))
    return F.when(F.length(c) > 0, F.transform(starts, lambda i: F.sha2(F.substring(c, i, F.lit(size)), 256))).otherwise(F.array().cast("array<string>"))


def chunks(c: Column, over: int = CHUNK_OVER, size: int = CHUNK_SIZE) -> Column:
    """The slices of a text longer than `over` characters, in order; none for the others."""
    starts = F.sequence(F.lit(1), F.length(c), F.lit(size))
    return F.when(F.length(c) > over, F.transform(starts, lambda i: F.substring(c, i, F.lit(size)))).otherwise(F.array().cast("array<string>"))


def truncate(c: Column, n: int, ending: str = "") -> Column:
    """The first n characters, followed by `ending` if there were more."""
    return F.when(F.length(c) > n, F.concat(F.left(c, F.lit(n)), F.lit(ending))).otherwise(c)


def truncate_words(c: Column, n: int, side: str = "right") -> Column:
    """n characters from the start (side right) or the end (side left), cut at a space, with an ellipsis."""
    if side == "left":
        tail = F.concat(F.lit("..."), F.right(c, F.lit(n)))
        cut = F.when(F.instr(F.substring(tail, 5, 1 << 30), " ") > 0, F.regexp_replace(tail, r"(?s)\A[^ ]* ", "")).otherwise(tail)
    else:
        cut = F.concat(F.regexp_replace(F.left(c, F.lit(n)), r"(?s) [^ ]*\z", ""), F.lit("..."))
    return F.when(F.length(c) > n, cut).otherwise(c)


def snippet(c: Column, style: str = "line") -> Column:
    """Previews: `line` (one line of at most 200), `list` (first 200 characters), `cell` (first 100, always with an ellipsis)."""
    if style == "line":
        flat = strip(collapse(c))
        return F.when(F.length(flat) > 200, F.concat(F.left(flat, F.lit(197)), F.lit("..."))).otherwise(flat)
    if style == "list":
        return truncate(c, 200, "...")
    return F.concat(F.replace(F.left(c, F.lit(100)), F.lit("\n"), F.lit(" ")), F.lit("..."))


def title_case(c: Column) -> Column:
    """Every run of letters with a capital first letter, the others small."""
    runs = F.regexp_extract_all(F.lower(c), F.lit(TITLE_RUN), F.lit(1))
    first = lambda r: F.when(F.startswith(r, F.lit("ß")), "Ss").otherwise(F.upper(F.left(r, F.lit(1))))  # noqa: E731  the one small letter of these languages with a title form of two
    return F.array_join(F.transform(runs, lambda r: F.concat(first(r), F.substring(r, 2, 1 << 30))), "")


def date_span(first: Column, last: Column) -> Column:
    """'YYYY-MM-DD' or 'YYYY-MM-DD - YYYY-MM-DD' of two timestamps; N/A without any."""
    a, b = F.date_format(first, "yyyy-MM-dd"), F.date_format(last, "yyyy-MM-dd")
    return F.when(a.isNull() | b.isNull(), "N/A").when(a == b, a).otherwise(F.concat(a, F.lit(" - "), b))


def first_topic(segment_topic: Column, topics: Column) -> Column:
    """A result's label: its segment's topic, else its first topic, else '-'."""
    filled = lambda c: F.when(c != "", c)
    return F.coalesce(filled(segment_topic), filled(F.get(topics, F.lit(0))), F.lit("-"))
