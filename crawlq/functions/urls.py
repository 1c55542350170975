"""URL splitting, reduction and reference resolution, as Spark SQL expression text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crawlq.functions.text import literal, literals, once, strip, strip_chars

# Schemes whose last path segment may carry `;params`, schemes that
# allow relative references, and schemes that are written with `//authority`.
PARAM_SCHEMES = (
    "", "ftp", "hdl", "prospero", "http", "https", "shttp", "rtsp", "rtspu", "sip", "sips", "mms", "sftp", "tel",
)
RELATIVE_SCHEMES = (
    "", "ftp", "http", "gopher", "nntp", "imap", "wais", "file", "https", "shttp", "mms", "prospero", "rtsp",
    "rtspu", "sftp", "svn", "svn+ssh",
)
AUTHORITY_SCHEMES = RELATIVE_SCHEMES[1:] + ("telnet", "snews", "rsync", "nfs", "git", "git+ssh")

PREFIX_LENGTH = 8
MAX_EXTENSION = 5

PARTS = ("scheme", "netloc", "hostname", "port", "path", "params", "query", "fragment")

_OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_V4 = rf"{_OCTET}(?:\.{_OCTET}){{3}}"
_H = "[0-9a-fA-F]{1,4}"


def _ipv6_pattern() -> str:
    forms = [f"(?:{_H}:){{7}}{_H}", f"(?:{_H}:){{1,7}}:", f":(?::{_H}){{1,7}}", "::"]
    forms += [f"(?:{_H}:){{1,{7 - n}}}(?::{_H}){{1,{n}}}" for n in range(1, 7)]
    forms += [f"(?:{_H}:){{6}}{_V4}", f"::(?:{_H}:){{0,5}}{_V4}"]
    forms += [f"(?:{_H}:){{{n}}}:(?:{_H}:){{0,{5 - n}}}{_V4}" for n in range(1, 6)]
    return "^(?:" + "|".join(forms) + ")$"


IPV4 = f"^{_V4}$"
IPV6 = _ipv6_pattern()

# One pattern per part, so that each part is a single expression on the URL: cheap to filter on.
# "host:80" is a host with a port and no scheme; "http:80" has one.
_SCHEME = r"(?s)^(?:(http(?=:)|[A-Za-z0-9+.\-]+(?=:)(?!:[0-9]+$)):)?"
_NETLOC = _SCHEME + r"(?://([^/?#]*))?"
_HOST = _SCHEME + r"//(?:[^/?#]*@)?(\[[^\]/?#]*\]|[^:/?#]*)"
_PORT = _HOST + r"[^:/?#]*:([0-9]{1,5})(?:[:/?#]|$)"
_PATH = _NETLOC + r"([^?#]*)"
_PATH_PARAMS = _NETLOC + r"((?:[^?#]*/)?[^/?#;]*)(?:;([^/?#]*))?"
_QUERY = r"(?s)^[^?#]*\?([^#]*)"
_FRAGMENT = r"(?s)^[^#]*#(.*)$"


def _extract(text: str, pattern: str, group: int) -> str:
    return f"regexp_extract({text}, {literal(pattern)}, {group})"


def url_part(url: str, part: str) -> str:
    """One part of a URL. A missing part is `''`; a missing host or an unusable port is NULL."""
    u = strip(f"coalesce({url}, '')")
    with_params = f"lower({_extract(u, _SCHEME, 1)}) IN ({literals(PARAM_SCHEMES)})"
    if part == "scheme":
        return f"lower({_extract(u, _SCHEME, 1)})"
    if part == "netloc":
        return _extract(u, _NETLOC, 2)
    if part == "hostname":
        return f"nullif(lower(translate({_extract(u, _HOST, 2)}, '[]', '')), '')"
    if part == "port":
        port = f"try_cast({_extract(u, _PORT, 3)} AS INT)"
        return f"CASE WHEN {port} <= 65535 THEN {port} END"
    if part == "path":
        return f"CASE WHEN {with_params} THEN {_extract(u, _PATH_PARAMS, 3)} ELSE {_extract(u, _PATH, 3)} END"
    if part == "params":
        return f"CASE WHEN {with_params} THEN {_extract(u, _PATH_PARAMS, 4)} ELSE '' END"
    if part == "query":
        return _extract(u, _QUERY, 1)
    if part == "fragment":
        return _extract(u, _FRAGMENT, 1)
    raise ValueError(f"unknown URL part {part!r}")


def host_or_empty(url: str) -> str:
    return f"coalesce({url_part(url, 'hostname')}, '')"


def site(url: str) -> str:
    """`scheme://netloc/`; the case of the netloc is kept."""
    return f"concat({url_part(url, 'scheme')}, '://', {url_part(url, 'netloc')}, '/')"


def with_url_parts(df: DataFrame, url: str, prefix: str = "", parts: tuple[str, ...] = PARTS) -> DataFrame:
    """Add URL parts as columns `<prefix>scheme` … `<prefix>fragment`. Never fails on odd input."""
    return df.withColumns({prefix + part: F.expr(url_part(url, part)) for part in parts})


def is_ipv4(host: str) -> str:
    return f"coalesce({host} RLIKE {literal(IPV4)}, false)"


def is_ipv6(host: str) -> str:
    return f"coalesce({host} RLIKE {literal(IPV6)}, false)"


def host_kind(host: str) -> str:
    """`ipv4`, `ipv6` or `name`; a decimal port may follow, and then IPv6 must be bracketed."""
    colons = f"(length({host}) - length(replace({host}, ':', '')))"
    ported = f"{host} RLIKE ':[0-9]+$'"
    unported = strip_chars(f"regexp_replace({host}, ':[0-9]+$', '')", "[]")
    bracketed = f"contains({host}, '[') AND contains({host}, ']') AND {ported}"
    return f"""CASE WHEN coalesce({host}, '') = '' THEN 'name'
        WHEN {colons} > 1 THEN CASE WHEN ({bracketed} AND {is_ipv6(unported)}) OR (NOT ({bracketed}) AND {is_ipv6(host)})
          THEN 'ipv6' ELSE 'name' END
        WHEN ({colons} = 1 AND {ported} AND {is_ipv4(f"substring_index({host}, ':', 1)")}) OR {is_ipv4(host)} THEN 'ipv4'
        ELSE 'name' END"""


def file_extension(path: str) -> str:
    """Lower-case extension with its dot, or `''`; the dot may not be the first character."""
    return f"lower({_extract(path, rf'(?s).(\.[0-9a-zA-Z]{{1,{MAX_EXTENSION}}})$', 1)})"


def zero_digits(text: str) -> str:
    return strip(f"translate({text}, '123456789', '000000000')")


def path_level(path: str) -> str:
    """Number of non-blank path segments, minus a half unless the path ends in `/`."""
    trimmed = strip(path)
    depth = f"size(filter(split({trimmed}, '/'), s -> {strip('s')} <> ''))"
    return f"CAST({depth} AS DOUBLE) - CASE WHEN endswith({trimmed}, '/') THEN 0D ELSE 0.5D END"


def after(text: str, divider: str) -> str:
    """What follows the first `divider`, `''` without one."""
    head = f"substring_index({text}, {literal(divider)}, 1)"
    return f"substr({text}, length({head}) + {len(divider) + 1})"


def query_pairs(query: str) -> str:
    """`array<struct<k,v>>` of the query, in order; keys and values trimmed, empty keys dropped."""
    key = strip("substring_index(p, '=', 1)")
    pairs = f"transform(split({query}, '&'), p -> named_struct('k', {key}, 'v', {strip(after('p', '='))}))"
    return f"filter({pairs}, p -> p.k <> '')"


def split_last(text: str, divider: str) -> tuple[str, str]:
    """Left and right of the last `divider`; without one, the text itself and `''`."""
    d = literal(divider)
    right = f"substring_index({text}, {d}, -1)"
    found = f"instr({text}, {d}) > 0"
    left = f"CASE WHEN {found} THEN left({text}, length({text}) - length({right}) - {len(divider)}) ELSE {text} END"
    return left, f"CASE WHEN {found} THEN {right} ELSE '' END"


def reduced(url: str, does_trim: bool = False, keep_frag: bool = False) -> str:
    """Host + path + `?` + query, without scheme, port, user info and `;params`."""
    pieces = [host_or_empty(url), url_part(url, "path"), "'?'", url_part(url, "query")]
    if keep_frag:
        mark = f"CASE WHEN contains({url}, '#') THEN concat('#', {url_part(url, 'fragment')}) ELSE '' END"
        pieces.append(mark)
    text = strip(f"concat({', '.join(pieces)})")
    if does_trim:
        cut = strip(f"substring_index({text}, '?', 1)")
        text = f"regexp_replace({cut}, {literal(r'^(?:www\.)+')}, '')"
    return f"coalesce({text}, '')"


def with_reduced(df: DataFrame, url: str, out: str, does_trim: bool = False, keep_frag: bool = False) -> DataFrame:
    """Add `out`: the URL in reduced form."""
    return once(df, {out: reduced(url, does_trim, keep_frag)})


def path_structure(reduced_url: str) -> str:
    """Directory part of a reduced URL as `/d1/d2/`, host and file name dropped."""
    segments = f"split(substring_index({reduced_url}, '?', 1), '/')"
    inner = f"slice({segments}, 2, greatest(size({segments}) - 2, 0))"
    return f"concat('/', array_join(concat({inner}, array('')), '/'))"


def without_filename(reduced_url: str) -> str:
    """A reduced URL up to its last `/` (the query counts as text here)."""
    return f"CASE WHEN instr({reduced_url}, '/') > 0 THEN {split_last(reduced_url, '/')[0]} ELSE '' END"


def file_name(link: str) -> str:
    """Last `/` part of a link, without its query."""
    return f"substring_index(substring_index({link}, '/', -1), '?', 1)"


def _merged_path(base_path: str, path: str) -> str:
    """Relative path on a base path; a `..` with nothing left to remove stays.

    A closing `.` or `..` names a directory; `..` then leaves the directory before it, never the root.
    """
    base_dir = f"split({base_path}, '/')"
    joined = f"concat(slice({base_dir}, 1, size({base_dir}) - 1), split({path}, '/'))"
    final = f"substring_index({path}, '/', -1)"
    steps = f"CASE WHEN {final} IN ('.', '..') THEN slice({joined}, 1, size({joined}) - 1) ELSE {joined} END"
    return f"""aggregate({steps}, CAST(array() AS ARRAY<STRING>),
        (done, seg) -> CASE WHEN seg = '.' THEN done
          WHEN seg = '..' AND coalesce(try_element_at(done, -1), '') NOT IN ('', '..') THEN slice(done, 1, size(done) - 1)
          ELSE concat(done, array(seg)) END,
        done -> array_join(CASE
          WHEN {final} = '..' AND array_join(done, '/') <> '' THEN concat(slice(done, 1, size(done) - 1), array(''))
          WHEN {final} IN ('.', '..') THEN concat(done, array('')) ELSE done END, '/'))"""


def with_resolved(df: DataFrame, base: str, link: str, out: str) -> DataFrame:
    """Add `out`: the link resolved on the base URL; a lone `#` is appended to the base."""
    names = ("scheme", "netloc", "path", "params", "query")
    trimmed = strip(f"coalesce({link}, '')")
    parts = {f"__b_{n}": url_part(base, n) for n in names}
    parts |= {f"__l_{n}": url_part(link, n) for n in (*names, "fragment")}
    df = once(df, {"__res_link": trimmed, **parts})
    inherit = "__l_netloc = '' AND __l_path = '' AND __l_params = ''"
    merged = {
        "__res_scheme": "CASE WHEN __l_scheme = '' THEN __b_scheme ELSE __l_scheme END",
        "__res_netloc": "CASE WHEN __l_netloc <> '' THEN __l_netloc ELSE __b_netloc END",
        "__res_path": f"""CASE WHEN __l_netloc <> '' OR startswith(__l_path, '/') THEN __l_path
            WHEN {inherit} THEN __b_path ELSE {_merged_path('__b_path', '__l_path')} END""",
        "__res_params": f"CASE WHEN {inherit} THEN __b_params ELSE __l_params END",
        "__res_query": f"CASE WHEN {inherit} AND __l_query = '' THEN __b_query ELSE __l_query END",
    }
    df = once(df, merged)
    with_authority = f"""(__res_netloc <> '' OR (__res_scheme IN ({literals(AUTHORITY_SCHEMES)})
        AND NOT startswith(__res_path, '//')))"""
    text = f"""concat(
        CASE WHEN __res_scheme <> '' THEN concat(__res_scheme, ':') ELSE '' END,
        CASE WHEN {with_authority} THEN concat('//', __res_netloc) ELSE '' END,
        CASE WHEN {with_authority} AND __res_path <> '' AND NOT startswith(__res_path, '/') THEN '/' ELSE '' END,
        __res_path,
        CASE WHEN __res_params <> '' THEN concat(';', __res_params) ELSE '' END,
        CASE WHEN __res_query <> '' THEN concat('?', __res_query) ELSE '' END,
        CASE WHEN __l_fragment <> '' THEN concat('#', __l_fragment) ELSE '' END)"""
    whole = f"coalesce({base}, '')"
    resolved = f"""coalesce(CASE WHEN __res_link = '#' THEN concat({whole}, '#')
        WHEN {whole} = '' THEN __res_link
        WHEN __res_link = '' THEN {whole}
        WHEN __res_scheme <> __b_scheme OR __res_scheme NOT IN ({literals(RELATIVE_SCHEMES)}) THEN __res_link
        ELSE {text} END, '')"""
    return once(df, {out: resolved}).drop("__res_link", *parts, *merged)
