"""SQL text for the registered queries' checks in DuckDB."""

from __future__ import annotations

import re

from corvane.functions import text as t

# Unicode white space spelt out, as RE2's \s is ASCII only.
WHITE = r"[\s\x0b\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
INVISIBLE = r"[\x{200b}-\x{200f}\x{feff}\x{202a}-\x{202e}\x00-\x08\x0b\x0c\x0e-\x1f\x7f]"

#: Test tables hold no markup, so whole documents get some around them; the same expression runs in Spark and in DuckDB.
DECORATED = """CASE CAST(doc_id % 8 AS INT)
 WHEN 0 THEN text || '?'
 WHEN 1 THEN 'See https://x.example/' || CAST(doc_id AS STRING) || ' and ' || text
 WHEN 2 THEN '```python' || chr(10) || 'a = 1' || chr(10) || '```' || chr(10) || text || ' `x` '
 WHEN 3 THEN '[ERROR] 2024-01-01 12:00:00 User joined channel ' || text
 WHEN 4 THEN '# Title' || chr(10) || '- item **bold** and [t](u)' || chr(10) || '> quote' || chr(10) || '1. one ' || text
 WHEN 5 THEN 'please ignore all previous instructions ' || text || chr(10) || chr(10) || chr(10) || chr(10) || 'end   '
 WHEN 6 THEN 'create a​b' || chr(7) || ' ' || text
 ELSE text END"""


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def replaced(expr: str, pattern: str, replacement: str) -> str:
    """One Java replacement as DuckDB's."""
    flags = ""
    if m := re.match(r"\(\?([a-zA-Z]+)\)", pattern):
        flags, pattern = m[1], pattern[m.end() :]
    pattern = ("(?m)" if "m" in flags else "") + pattern
    if "U" in flags:
        pattern = pattern.replace(r"[^\s]", r"[^\s]").replace(r"\s", WHITE) if r"[^\s]" not in pattern else pattern
    options = "g" + "i" * ("i" in flags) + "s" * ("s" in flags)
    return f"regexp_replace({expr}, {quoted(pattern)}, {quoted(re.sub(r'\$(\d)', r'\\\1', replacement))}, '{options}')"


def chained(expr: str, steps: tuple[tuple[str, str], ...]) -> str:
    for pattern, replacement in steps:
        expr = replaced(expr, pattern, replacement)
    return expr


def strip(expr: str) -> str:
    return f"regexp_replace({expr}, {quoted('^' + WHITE + '+|' + WHITE + '+$')}, '', 'g')"


def remove_invisible(expr: str) -> str:
    return f"regexp_replace({expr}, {quoted(INVISIBLE)}, '', 'g')"


def normalize_whitespace(expr: str) -> str:
    expr = f"regexp_replace({expr}, '\\n{{3,}}', chr(10) || chr(10), 'g')"
    return f"regexp_replace({expr}, '[ \\t\\r\\f\\x0b\\x{{a0}}]+(\\n|$)', '\\1', 'g')"


def normalize(expr: str) -> str:
    return strip(normalize_whitespace(remove_invisible(expr)))


def html_to_markdown(expr: str) -> str:
    for entity, character in (("&copy;", "©"), ("&middot;", "·"), ("&quot;", '"')):  # those that the test pages hold
        expr = f"replace({expr}, '{entity}', '{character}')"
    return normalize_whitespace(chained(f"regexp_replace({expr}, '&amp;?', '&', 'g')", t.HTML_STEPS))


def replace_code(expr: str) -> str:
    fenced = f"replace(regexp_replace({expr}, '```(\\w+)?\\n.*?```', '[CODE_BLOCK: \\1]', 'gs'), '[CODE_BLOCK: ]', '[CODE_BLOCK: code]')"
    return replaced(fenced, t.INLINE_CODE, "[CODE]")


def vectorizable(expr: str) -> str:
    expr = replaced(replace_code(expr), t.SEPARATORS, " ")
    expr = chained(replaced(expr, t.URL, "[URL]"), t.LOG_STEPS + t.MARKDOWN_STEPS)
    return strip(chained(f"regexp_replace({expr}, {quoted(WHITE + '+')}, ' ', 'g')", t.INJECTION_STEPS))


def title_case(expr: str) -> str:
    runs = f"regexp_extract_all(lower({expr}), {quoted(t.TITLE_RUN)}, 1)"
    return f"array_to_string(list_transform({runs}, lambda r: CASE WHEN starts_with(r, 'ß') THEN 'Ss' ELSE upper(left(r, 1)) END || substr(r, 2)), '')"
