"""URL column expressions (survey X1-X10, F3).

Every function takes column names or Columns and returns a Column, so the
work stays inside whole-stage codegen; nothing here runs Python per row.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from civicspark.functions.text import py_strip


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def normalize_url(url) -> Column:
    """Trim; when the text does not start with ``http`` prefix
    ``https://`` after dropping leading slashes; drop trailing slashes."""
    u = py_strip(_c(url))
    with_scheme = F.when(u.startswith("http"), u).otherwise(
        F.concat(F.lit("https://"), F.ltrim(u, F.lit("/")))
    )
    return F.rtrim(with_scheme, F.lit("/"))


def strip_api_chars(url) -> Column:
    """Remove any trailing run of the *characters* ``/``, ``a``, ``p``,
    ``i`` (character-set semantics, not a suffix match)."""
    return F.rtrim(_c(url), F.lit("/api"))


def topic_table_name(topic) -> Column:
    """Last path part, every ``Get`` removed, lower case."""
    last = F.element_at(F.split(_c(topic), "/"), -1)
    return F.lower(F.replace(last, F.lit("Get"), F.lit("")))


def month_url(base, topic, ano, mes) -> Column:
    """``base/topic?ano=Y&mes=MM`` with a zero-padded month."""
    return F.format_string("%s/%s?ano=%d&mes=%02d", _c(base), _c(topic), _c(ano), _c(mes))


def template_params(template, unit, year) -> Column:
    """X5 parameter part: fill ``{unidadeGestoraId}``, ``{exercicio}`` and
    ``{periodo}`` (always empty), strip, prefix ``?`` when any text is left,
    remove blanks."""
    t = F.coalesce(_c(template), F.lit(""))
    t = F.replace(t, F.lit("{unidadeGestoraId}"), _c(unit).cast("string"))
    t = F.replace(t, F.lit("{exercicio}"), _c(year).cast("string"))
    t = py_strip(F.replace(t, F.lit("{periodo}"), F.lit("")))
    with_mark = F.when(t.startswith("?"), t).otherwise(F.concat(F.lit("?"), t))
    return F.when(t == "", F.lit("")).otherwise(F.replace(with_mark, F.lit(" "), F.lit("")))


def template_url(base, topic, template, unit, year) -> Column:
    """``strip_api_chars(normalize_url(base)) + '/api/' + topic + params``."""
    root = strip_api_chars(normalize_url(base))
    return F.concat(root, F.lit("/api/"), _c(topic), template_params(template, unit, year))


def repair_retry_url(url) -> Column:
    """Normalize, then collapse every run of slashes that does not
    follow a colon (the intent of the reference's ``//``->``/`` repair, which
    also kept ``http://`` intact only for https)."""
    return F.regexp_replace(normalize_url(url), r"([^:])/{2,}", "$1/")


def url_part(url, part: str) -> Column:
    """One of PROTOCOL, AUTHORITY (host:port), HOST, PATH, QUERY; NULL
    when the text is not a URL."""
    return F.try_parse_url(_c(url), F.lit(part))


def query_params(query) -> Column:
    """``k=v&...`` -> array<struct<key,value>> split at the first ``=``;
    parts without ``=`` are skipped; a repeated key keeps its last value
    (Python ``dict`` semantics), in first-seen order of the kept entries."""
    parts = F.filter(F.split(_c(query), "&"), lambda p: F.instr(p, "=") > 0)
    kv = F.transform(
        parts,
        lambda p: F.named_struct(  # named by literals: aliases inside are lost beside a generator
            F.lit("key"), F.substring_index(p, "=", 1),
            F.lit("value"), F.split(p, "=", 2).getItem(1),
        ),
    )
    rev = F.reverse(kv)
    rev_keys = F.transform(rev, lambda x: x["key"])
    last_wins = F.filter(rev, lambda x, i: ~F.array_contains(F.slice(rev_keys, 1, i), x["key"]))
    return F.reverse(last_wins)


def path_after_marker(path, marker: str = "api") -> Column:
    """The path part right after the first ``marker`` part; NULL when
    the marker is absent or is the last part (malformed)."""
    parts = F.split(_c(path), "/")
    pos = F.array_position(parts, F.lit(marker))
    nxt = F.get(parts, pos.cast("int"))  # 0-based get == element after 1-based pos
    return F.when(pos > 0, nxt)


def retry_eligible_tp(url) -> Column:
    """F3 (monthly vendors): the repaired URL carries parameters."""
    return F.instr(_c(url), "?") > 0


def retry_eligible_te(url) -> Column:
    """F3 (yearly vendor): parameters and an ``api`` part followed by a name."""
    return retry_eligible_tp(url) & path_after_marker(url_part(url, "PATH")).isNotNull()


def base_of(url) -> Column:
    """``scheme://authority`` of a URL, lower-cased (hosts are case-insensitive)."""
    return F.lower(F.concat(url_part(url, "PROTOCOL"), F.lit("://"), url_part(url, "AUTHORITY")))
