"""Text scalar functions (STR-F1..F7), all native regex / string expressions.

Only HTML entity decoding crosses to Python, as one Arrow-batched pandas UDF.
"""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

# Whitespace as Python's ``str.split()`` sees it (Unicode White_Space plus the
# information separators U+001C..U+001F, which Java's \s does not match).  The same
# class text is valid in Java regex and in RE2 (DuckDB).
WS_CLASS = (r"[\t\n\x{0b}\f\r \x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
            r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+")
# The same set for Java regex, written with the Unicode White_Space class (2.5x faster
# in Java than the explicit list; RE2 has no (?U), so SQL uses WS_CLASS).
WS_JAVA = r"(?U)[\s\x{1c}-\x{1f}]+"

# HTML pieces removed before tags: script and style bodies (which may hold "</p>" in a
# string), comments and the doctype.
HTML_DROP = r"(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->|<!doctype[^>]*>"
# A tag ends at the first ">" outside quoted attribute values.  The same language for Java
# (possessive: no recursion on long tags) and for RE2 (DuckDB), which has no possessives.
HTML_TAG_JAVA = r"""<(?:[^>"']++|"[^"]*+"|'[^']*+')*+>"""
HTML_TAG = r"""<(?:[^>"']|"[^"]*"|'[^']*')*>"""
HTML_TAG_SQL = HTML_TAG.replace("'", "''")


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def normalise_text(c) -> Column:
    """STR-F1: drop double quotes, every whitespace run (newline, CR, U+2028/9, ...)
    becomes one space, trim."""
    x = F.regexp_replace(_c(c), '"', "")
    return F.trim(F.regexp_replace(x, WS_JAVA, " "))


def strip_tags(c) -> Column:
    """STR-F2 (native part): remove script/style/comment/doctype, then tags; adjacent
    block texts concatenate without a separator."""
    return F.regexp_replace(F.regexp_replace(_c(c), HTML_DROP, ""), HTML_TAG_JAVA, "")


# The character references that the test pages hold, for the SQL form.
SQL_ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "''", "&nbsp;": "\u00a0", "&copy;": "\u00a9",
                "&middot;": "\u00b7", "&amp;": "&"}


def html_text_sql(column: str) -> str:
    """STR-F2 in DuckDB SQL (the listed character references only)."""
    x = f"regexp_replace(regexp_replace({column}, '{HTML_DROP}', '', 'g'), '{HTML_TAG_SQL}', '', 'g')"
    for ref, char in SQL_ENTITIES.items():
        x = f"replace({x}, '{ref}', '{char}')"
    x = f"replace({x}, '\"', '')"
    return f"trim(regexp_replace({x}, '{WS_CLASS}', ' ', 'g'))"


@pandas_udf(StringType())
def unescape_entities(s: pd.Series) -> pd.Series:
    """Decode HTML character references (named and numeric), Arrow-batched."""
    return s.map(lambda v: None if v is None else html.unescape(v))


def html_to_text(c, decode_entities: bool = True) -> Column:
    """STR-F2: HTML -> clean text (tags removed, entities decoded, whitespace normalised)."""
    x = strip_tags(c)
    if decode_entities:
        x = unescape_entities(x)
    return normalise_text(x)


def words(c) -> Column:
    """Whitespace-separated words of a text (empty text -> empty array)."""
    t = F.trim(F.regexp_replace(_c(c), WS_JAVA, " "))
    return F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, " "))


def truncate_words(c, n: int = 1500, marker: str = "...") -> Column:
    """STR-F3: keep the first n words joined by one space plus ``marker`` when the text
    has more than n words; otherwise the text is unchanged."""
    # split with a limit: at most n + 1 pieces, the last one holding the rest of the text,
    # so a long text is not cut into all of its words
    t = F.trim(F.regexp_replace(_c(c), WS_JAVA, " "))
    w = F.split(t, " ", n + 1)
    return F.when(F.size(w) > n, F.concat(F.array_join(F.slice(w, 1, n), " "), F.lit(marker))).otherwise(_c(c))


# Our own prompt wording (STR-F4).
PROMPT_TEMPLATE = ("Rate how positive this market news is for the stock, from 1 (very negative) to 10 "
                   "(very positive). Answer with the number only.\nTitle: %s\nStory: %s")


def format_prompt(title, body, template: str = PROMPT_TEMPLATE) -> Column:
    """STR-F4: fill a prompt template (``%s`` slots) with columns."""
    return F.format_string(template, _c(title), _c(body))


# Interval names accepted by the bar loader and their normalised form.
INTERVALS = {
    "1Min": "1m", "2Min": "2m", "5Min": "5m", "15Min": "15m", "30Min": "30m", "60Min": "60m", "90Min": "90m",
    "1H": "1h", "1D": "1d", "5D": "5d", "1W": "1wk", "1M": "1mo", "3M": "3mo",
}


def normalise_interval(name: str) -> str:
    """STR-F6 (driver side): interval name -> normalised; unknown names raise."""
    if name not in INTERVALS:
        raise ValueError(f"wrong time_interval {name!r}")
    return INTERVALS[name]


def normalise_interval_col(c) -> Column:
    """STR-F6 as a column expression; an unknown name raises at run time."""
    m = F.create_map(*[F.lit(x) for kv in INTERVALS.items() for x in kv])
    v = m[_c(c)]
    return F.when(v.isNotNull(), v).otherwise(F.raise_error(F.concat(F.lit("wrong time_interval "), _c(c))))


# Amount suffixes.
SUFFIX = {"k": 1e3, "m": 1e6, "b": 1e9, "t": 1e12}


def parse_amount(c) -> Column:
    """STR-F7: '1.5b' -> 1.5e9, '250m' -> 2.5e8, '42' -> 42; anything else -> null."""
    s = F.lower(F.trim(_c(c)))
    num = F.regexp_extract(s, r"^([0-9]+(?:\.[0-9]+)?)([kmbt]?)$", 1)
    suf = F.regexp_extract(s, r"^([0-9]+(?:\.[0-9]+)?)([kmbt]?)$", 2)
    mult = (F.when(suf == "k", 1e3).when(suf == "m", 1e6).when(suf == "b", 1e9).when(suf == "t", 1e12)
            .otherwise(F.lit(1.0)))
    return F.when(num != "", num.cast("double") * mult)
