"""Scalar text helpers. Everything here is a built-in expression that stays in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: the characters str.strip() removes
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# fixed values: limits and markers of the rendered blocks
TURN_CHARS = 600
TURN_MARK = " […]"
PREVIEW_CHARS = 200
TOP_TOOLS = 6

_ISO = (
    r"^(\d{4}-\d{2}-\d{2})"
    r"(?:.(\d{2})(?::(\d{2})(?::(\d{2})(?:[.,]\d+)?)?)?"
    r"(?:Z|[+-]\d{2}(?::?\d{2}(?::?\d{2}(?:\.\d+)?)?)?)?)?$"
)


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.col(x)


def strip(text) -> Column:
    return F.btrim(_c(text), F.lit(WHITESPACE))


def rstrip(text) -> Column:
    return F.rtrim(_c(text), F.lit(WHITESPACE))


def _cut(text: Column, n: int) -> Column:
    return F.substring(text, 1, n)


def _iso_part(ts: Column, group: int) -> Column:
    return F.regexp_extract(ts, _ISO, group)


def _iso_valid(ts: Column) -> Column:
    def below(group: int, bound: str) -> Column:
        return (_iso_part(ts, group) == "") | (_iso_part(ts, group) < bound)

    return (
        ts.rlike(_ISO)
        & _iso_part(ts, 1).try_cast("date").isNotNull()
        & below(2, "24")
        & below(3, "60")
        & below(4, "60")
    )


def iso_timestamp(ts) -> Column:
    """The instant an ISO-8601 text names, NULL when it is empty or not parseable."""
    ts = _c(ts)
    return F.when(_iso_valid(ts), F.regexp_replace(ts, ",", ".").try_cast("timestamp"))


def fmt_iso_short(ts) -> Column:
    """``YYYY-MM-DD HH:MM`` in the text's own offset; first 16 characters when unparseable."""
    ts = _c(ts)

    def part(group: int) -> Column:
        value = _iso_part(ts, group)
        return F.when(value == "", F.lit("00")).otherwise(value)

    clock = F.concat(_iso_part(ts, 1), F.lit(" "), part(2), F.lit(":"), part(3))
    return F.when(ts.isNull(), F.lit("")).when(_iso_valid(ts), clock).otherwise(_cut(ts, 16))


def fmt_iso_team(ts) -> Column:
    return F.coalesce(F.replace(_cut(_c(ts), 16), F.lit("T"), F.lit(" ")), F.lit(""))


def trim_turn(text, full, n: int = TURN_CHARS) -> Column:
    text = _c(text)
    full = full if isinstance(full, Column) else F.lit(full)
    short = F.concat(rstrip(_cut(text, n)), F.lit(TURN_MARK))
    return F.when(full | (F.length(text) <= n), text).otherwise(short)


def cap_block(text, n: int, marker: str) -> Column:
    """Cut a block to ``n`` characters and say so on a line of its own."""
    text = _c(text)
    short = F.concat(rstrip(_cut(text, n)), F.lit("\n\n" + marker))
    return F.when(F.length(text) > n, short).otherwise(text)


def preview(text, n: int = PREVIEW_CHARS) -> Column:
    return F.replace(_cut(_c(text), n), F.lit("\n"), F.lit(" "))


def slug_from_cwd(slug, cwd) -> Column:
    """An explicit slug, else one made from the working directory."""
    dashed = F.ltrim(F.translate(_c(cwd), "\\/:", "---"), F.lit("-"))
    return F.coalesce(F.nullif(_c(slug), F.lit("")), F.when(_c(cwd) != "", dashed))


# A transcript is <slug>/<session>.jsonl, or, where Spark wrote it in pieces,
# project_slug=<slug>/transcript=<session>/<piece>.
_PIECES = r"project_slug=([^/]+)/transcript=([^/]+)/[^/]+$"


def _path_part(path, group: int, plain: str) -> Column:
    path = _c(path)
    pieces = F.url_decode(F.regexp_extract(path, _PIECES, group))
    return F.when(path.rlike(_PIECES), pieces).otherwise(F.regexp_extract(path, plain, 1))


def slug_from_path(path) -> Column:
    return _path_part(path, 1, r"([^/]+)/[^/]+$")


def session_from_path(path) -> Column:
    return _path_part(path, 2, r"([^/]+?)(?:\.[^./]*)?$")


def local_path(uri) -> Column:
    """File URI as Spark reports it -> plain decoded path."""
    uri = F.regexp_replace(_c(uri), r"^file:/+", "/")
    # url_decode turns a plus into a blank; a plus in a file name is literal
    return F.url_decode(F.replace(uri, F.lit("+"), F.lit("%2B")))


def slugify(text) -> Column:
    dashed = F.regexp_replace(F.lower(strip(text)), r"[^\p{L}\p{N}]+", "-")
    return F.coalesce(F.nullif(F.btrim(dashed, F.lit("-")), F.lit("")), F.lit("untitled"))


def normalize_user_id(name, default: str | None = "unknown") -> Column:
    dashed = F.regexp_replace(F.lower(strip(name)), r"[^a-z0-9]+", "-")
    user = F.nullif(F.btrim(dashed, F.lit("-")), F.lit(""))
    return user if default is None else F.coalesce(user, F.lit(default))


def _name_order(freq: Column) -> Column:
    return F.array_sort(F.map_entries(freq))


def tool_json(freq) -> Column:
    """Counts as JSON text with sorted keys."""
    entries = _name_order(F.coalesce(_c(freq), F.create_map().cast("map<string,bigint>")))
    return F.to_json(F.map_from_entries(entries))


def top_tools(freq, n: int = TOP_TOOLS) -> Column:
    """The ``n`` most used tools; equal counts in name order."""
    by_use = F.transform(
        F.map_entries(_c(freq)), lambda e: F.struct((-e["value"]).alias("neg"), e["key"].alias("key"))
    )
    return F.transform(
        F.slice(F.array_sort(by_use), 1, n),
        lambda e: F.struct(e["key"].alias("tool"), (-e["neg"]).alias("uses")),
    )


def tools_line(freq, n: int = TOP_TOOLS) -> Column:
    """``Tools used: name ×count, …``; NULL when there are none."""
    freq = _c(freq)
    items = F.transform(
        top_tools(freq, n), lambda t: F.concat(t["tool"], F.lit(" ×"), t["uses"].cast("string"))
    )
    return F.when(F.size(freq) > 0, F.concat(F.lit("Tools used: "), F.array_join(items, ", ")))
