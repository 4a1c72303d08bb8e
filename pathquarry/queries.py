"""Every operator of the catalog as a named query over the test tables, with the same result as DuckDB SQL where SQL can say it."""

from __future__ import annotations

import os
import tempfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import derive as D
from .operators import aggregate as A
from .operators import changes as C
from .operators import content as T
from .operators import search as S
from .operators import tree as R
from .plans.compile import apply
from .plans.language import IS_ATTRIBUTE, Options
from .schema import ATTRIBUTE_BITS
from .shared import shared_path
from .sources import filesystem, fixtures, journal
from .sources.synthetic import synthetic

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

_BS = "chr(92)"
_LOW = lambda c: f"translate({c}, '{D.UPPER}', '{D.LOWER}')"
_NAME = "lpad(doc_id::VARCHAR, 8, '0')"
_BASE = f"""base AS (SELECT '/corpus/' || lang || '/' || source || '/' || CASE WHEN doc_id % 17 = 0 THEN 'node_modules/' ELSE '' END
  || CASE WHEN doc_id % 89 = 0 THEN 'd' || {_NAME} || '/README' WHEN doc_id % 97 = 0 THEN 'd' || {_NAME} || '/Makefile' ELSE
    CASE WHEN doc_id % 101 = 0 THEN 'café-' WHEN doc_id % 73 = 0 THEN 'star*-' WHEN doc_id % 79 = 0 THEN 'set[1]-' WHEN doc_id % 83 = 0 THEN 'report-' WHEN doc_id % 11 = 0 THEN 'Report ' ELSE 'file-' END
    || {_NAME} || CASE doc_id % 7 WHEN 0 THEN '.rs' WHEN 1 THEN '.TXT' WHEN 2 THEN '.json' WHEN 3 THEN '.log' WHEN 4 THEN '.md' WHEN 5 THEN '.tar.gz' ELSE '' END END AS path,
  (CASE WHEN doc_id % 59 = 0 THEN 0 WHEN doc_id % 61 = 0 THEN 2147483648 + doc_id WHEN doc_id % 67 = 0 THEN 5368709120 + doc_id WHEN doc_id % 71 = 0 THEN 21474836480 + doc_id
    WHEN doc_id % 13 = 0 THEN n_chars * 1000 ELSE n_chars END)::BIGINT AS size,
  (1706616000 - 3607 * doc_id - 86400 * (doc_id % 30) + 11644473600) * 10000000 AS created, (1706616000 - 3607 * doc_id + 11644473600) * 10000000 AS modified,
  (1706616000 - 3607 * doc_id + 3600 * (doc_id % 5) + 11644473600) * 10000000 AS accessed, false AS is_dir,
  (CASE WHEN doc_id % 19 = 0 THEN 2 WHEN doc_id % 23 = 0 THEN 33 WHEN doc_id % 29 = 0 THEN 4 WHEN doc_id % 31 = 0 THEN 256 WHEN doc_id % 37 = 0 THEN 2048 WHEN doc_id % 41 = 0 THEN 16384
    WHEN doc_id % 43 = 0 THEN 4096 WHEN doc_id % 47 = 0 THEN 1024 WHEN doc_id % 53 = 0 THEN 8192 ELSE 128 END)::BIGINT AS attributes, doc_id::BIGINT AS file_ref, '/' AS volume, text FROM documents)"""
_TREE = """up AS (SELECT b.*, unnest(generate_series(1, len(string_split(path, '/')) - 2)) AS k FROM base b),
dirs AS (SELECT array_to_string(string_split(path, '/')[1:k + 1], '/') AS path, sum(size)::BIGINT AS size, min(modified) AS created, max(modified) AS modified FROM up GROUP BY 1),
entries AS (SELECT path, size, created, modified, accessed, is_dir, attributes, file_ref, volume FROM base UNION ALL
  SELECT path, size, created, modified, modified, true, 16::BIGINT, (1000000000 + row_number() OVER (ORDER BY path))::BIGINT, '/' FROM dirs)"""


def _derived(source: str, name: str) -> str:
    base = rf"regexp_extract(path, '([^\\/]*)$', 1)"
    return rf"""{name} AS (SELECT *, {base} AS name, {_LOW(base)} AS lower_name, {_LOW('path')} AS lower_path,
  CASE WHEN NOT is_dir THEN nullif({_LOW("regexp_extract(path, '^.+[.]([^.\\/]+)$', 1)")}, '') END AS extension,
  regexp_matches({_LOW('path')}, '[\\/](node_modules|[.]git|winsxs|[$]recycle[.]bin|system volume information)([\\/]|$)') AS excluded FROM {source})"""


FILES = f"WITH {_BASE}, {_TREE}, {_derived('entries', 'files')} "
WINDOWS = f"WITH {_BASE}, {_TREE}, wine AS (SELECT 'C:' || replace(path, '/', {_BS}) AS path, * EXCLUDE (path, volume), 'C:' AS volume FROM entries), {_derived('wine', 'files')} "
CONTENTS = f"WITH {_BASE}, {_TREE}, {_derived('entries', 'files')}, contents AS (SELECT {_LOW('path')} AS path_key, text AS body, strlen(text) AS byte_count, modified AS source_modified FROM base) "
CHANGES = f"""WITH {_BASE}, changes AS (SELECT event_id::BIGINT AS seq, (epoch_us(ts) * 10 + 116444736000000000)::BIGINT AS timestamp,
  CASE event_type WHEN 'signup' THEN 'CREATE' WHEN 'click' THEN 'WRITE' WHEN 'view' THEN 'RENAME' WHEN 'purchase' THEN 'RENAME_NEW' WHEN 'error' THEN 'DELETE' END AS reason,
  path, false AS is_dir, file_ref FROM events JOIN base ON file_ref = (event_id // 3) % (SELECT count(*) FROM base)) """


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


# --- filters -------------------------------------------------------------------------------------------------------------

_SHOWN = ("path", "is_dir", "size")


def _filter(name: str, text: str, where: str, windows: bool = False, **options) -> None:
    o = Options(query=text, **options)
    source = fixtures.windows_files if windows else fixtures.files
    QUERIES[name] = lambda spark, sf: apply(source(spark, sf), o).select(*_SHOWN)
    gate = "true" if o.include_all else "NOT excluded"
    ORACLES[name] = f"{WINDOWS if windows else FILES} SELECT path, is_dir, size FROM files WHERE {gate} AND ({where})"


_NOW, _E = fixtures.NOW, 116444736000000000
_ft = lambda unix: (unix + 11_644_473_600) * 10_000_000
_DAY = 86_400
_TODAY = _NOW - _NOW % _DAY
_between = lambda c, a, b: f"{c} >= {_ft(a)} AND {c} < {_ft(b)}"
_in_set = lambda names: "(" + ", ".join(f"'{n}'" for n in names) + ")"

for _n, _q, _w, _o in [
    ("flt_01_substring", "file-000001", "contains(lower_name, 'file-000001')", {}),
    ("flt_02_wildcard", "file-*7.log", "regexp_full_match(lower_name, 'file-[^\\\\]*7[.]log')", {}),
    ("flt_05_any_byte", "caf??-*", "regexp_full_match(lower_name, 'caf[^\\\\]-[^\\\\]*')", {}),
    ("flt_06_digit", "report?#######3.*", "regexp_full_match(lower_name, 'report[^\\\\][0-9]{7}3[.][^\\\\]*')", {}),
    ("flt_07_class", "file-*[1-3x].[jl]*", "regexp_full_match(lower_name, 'file-[^\\\\]*[1-3x][.][jl][^\\\\]*')", {}),
    ("flt_08_negated_class", "file-*[!0-8].md", "regexp_full_match(lower_name, 'file-[^\\\\]*[^0-8][.]md')", {}),
    ("flt_09_escape", r"star\*-*", "regexp_full_match(lower_name, 'star[*]-[^\\\\]*')", {}),
    ("flt_09_escape_bracket", r"*\[1]-*3.*", "regexp_full_match(lower_name, '[^\\\\]*[[]1[]]-[^\\\\]*3[.][^\\\\]*')", {}),
    ("flt_10_starts", "^report", "starts_with(lower_name, 'report')", {}),
    ("flt_11_ends", ".GZ$", "ends_with(lower_name, '.gz')", {}),
    ("flt_12_equals", "^file-00000001.txt$", "lower_name = 'file-00000001.txt'", {}),
    ("flt_13_prefix", "prefix:caf", "starts_with(lower_name, 'caf')", {}),
    ("flt_13_start_with", "start-with:Rep", "starts_with(lower_name, 'rep')", {}),
    ("flt_14_suffix", "suffix:5.tar.gz", "ends_with(lower_name, '5.tar.gz')", {}),
    ("flt_14_end_with", "end-with:.rs", "ends_with(lower_name, '.rs')", {}),
    ("flt_15_not", "!file- not:report", "NOT contains(lower_name, 'file-') AND NOT contains(lower_name, 'report')", {}),
    ("flt_15_not_path", "!en/src file:", "NOT contains(lower_path, 'en/src') AND NOT is_dir", {}),
    ("flt_16_whole_word", "ww:report", "list_contains(regexp_split_to_array(lower_name, '[^A-Za-z0-9_.\\-]'), 'report')", {}),
    ("flt_16_option_whole_word", "00000011.MD", "list_contains(regexp_split_to_array(lower_name, '[^A-Za-z0-9_.\\-]'), '00000011.md')", {"match_whole_word": True}),
    ("flt_17_case", "case:TXT", "contains(name, 'TXT')", {}),
    ("flt_17_option_case", "report", "contains(name, 'report')", {"match_case": True}),
    ("flt_18_regex", r'regex:"^(file|report).*[05]\.(md|log)$"', "regexp_matches(name, '(?i)^(file|report).*[05][.](md|log)$')", {}),
    ("flt_19_option_regex", r"0{6}\d[13]\.", "regexp_matches(name, '(?i)0{6}[0-9][13][.]')", {"regex": True}),
    ("flt_20_match_path", "de/src1", "contains(lower_path, 'de/src1')", {"match_path": True}),
    ("flt_21_exclude_group", "!<file-> file:", "NOT contains(lower_name, 'file-') AND NOT is_dir", {}),
    ("flt_22_path_term", "path:/corpus/en/src1", "lower_path = '/corpus/en/src1' OR starts_with(lower_path, '/corpus/en/src1/')", {}),
    ("flt_23_absolute", "/corpus/fr .md", "(lower_path = '/corpus/fr' OR starts_with(lower_path, '/corpus/fr/')) AND contains(lower_name, '.md')", {}),
    ("flt_24_extensions", "ext:rs,.MD;", "extension = 'rs'", {}),
    ("flt_24_extension_list", "ext:rs,.MD,gz", "extension IN ('rs', 'md', 'gz')", {}),
    ("flt_24_no_extension", "ext:", "false", {}),
    ("flt_25_size_over", "size:>2kb", "size > 2048", {}),
    ("flt_25_size_at_least", "size:>=1.5mb", "size >= 1572864", {}),
    ("flt_25_size_under", "size:<500", "size < 500", {}),
    ("flt_25_size_at_most", "size:<=1kib", "size <= 1024", {}),
    ("flt_25_size_range", "size:1kb..2kb", "size BETWEEN 1024 AND 2048", {}),
    ("flt_25_size_unit", "size:2kb", "size BETWEEN 2048 AND 3071", {}),
    ("flt_25_size_exact", "size:=416", "size = 416", {}),
    *[(f"flt_26_{k}", f"size:{k}", w, {}) for k, w in (("tiny", "size < 1024"), ("small", "size < 1048576"), ("medium", "size < 1073741824"), ("large", "size > 1073741824"),
       ("huge", "size > 4294967296"), ("gigantic", "size > 17179869184"), ("empty", "size = 0"))],
    ("flt_27_metric", "metric: size:>=1mb", "size >= 1000000", {}),
    ("flt_27_metric_glued", "metric:size:2kb", "size BETWEEN 2000 AND 2999", {}),
    ("flt_28_name_length", "len:18..22", "strlen(name) BETWEEN 18 AND 22", {}),
    ("flt_29_file_ref", "frn:100..200", "file_ref BETWEEN 100 AND 200", {}),
    ("flt_30_modified", "dm:2024-01-29", _between("modified", _TODAY - _DAY, _TODAY), {}),
    ("flt_30_created", "dc:2024-01-15", _between("created", _TODAY - 15 * _DAY, _TODAY - 14 * _DAY), {}),
    ("flt_30_accessed", "da:yesterday", _between("accessed", _TODAY - _DAY, _TODAY), {}),
    ("flt_30_offset", "dm:2024-01-29", _between("modified", _TODAY - _DAY - 7200, _TODAY - 7200), {"tz_offset": 7200}),
    ("flt_31_after", "dm:>2024-01-25", f"modified >= {_ft(_TODAY - 4 * _DAY)}", {}),
    ("flt_32_before", "dm:<2024-01-10", f"modified < {_ft(_TODAY - 20 * _DAY)}", {}),
    ("flt_33_range", "dm:2024-01-10..2024-01-20", _between("modified", _TODAY - 20 * _DAY, _TODAY - 10 * _DAY), {}),
    ("flt_34_today", "dm:today", _between("modified", _TODAY, _TODAY + _DAY), {}),
    ("flt_35_last", "dm:last3days", _between("modified", _NOW - 3 * _DAY, _NOW + _DAY), {}),
    ("flt_35_bare", "dm:2weeks", _between("modified", _NOW - 14 * _DAY, _NOW + _DAY), {}),
    ("flt_36_previous", "dm:prev7days", _between("modified", _TODAY - 7 * _DAY, _TODAY), {}),
    ("flt_36_previous_long", "dm:previous7days", _between("modified", _TODAY - 7 * _DAY, _TODAY), {}),
    ("flt_37_hours", "dm:last36hours", _between("modified", _NOW - 36 * 3600, _NOW), {}),
    ("flt_37_bare_minutes", "dm:600minutes", _between("modified", _NOW - 36000, _NOW), {}),
    ("flt_38_this_week", "dm:thisweek", _between("modified", _TODAY - 2 * _DAY, _NOW + _DAY), {}),
    ("flt_38_this_month", "dm:thismonth", _between("modified", _TODAY - 29 * _DAY, _NOW + _DAY), {}),
    ("flt_38_this_year", "dm:thisyear", _between("modified", _TODAY - 29 * _DAY, _NOW + _DAY), {}),
    ("flt_39_last_week", "dm:lastweek", _between("modified", _NOW - 7 * _DAY, _NOW + _DAY), {}),
    ("flt_39_past_month", "dc:pastmonth", _between("created", _NOW - 31 * _DAY, _NOW + _DAY), {}),
    ("flt_40_previous_week", "dm:prevweek", _between("modified", _TODAY - 9 * _DAY, _TODAY - 2 * _DAY), {}),
    ("flt_40_previous_month", "dm:previousmonth", _between("modified", _TODAY - 60 * _DAY, _TODAY - 29 * _DAY), {}),
    ("flt_40_previous_year", "dm:prevyear", _between("modified", _TODAY - (29 + 365) * _DAY, _TODAY - 29 * _DAY), {}),
    ("flt_41_month_to_date", "dm:mtd", _between("modified", _TODAY - 29 * _DAY, _NOW), {}),
    ("flt_41_year_to_date", "dm:ytd", _between("modified", _TODAY - 29 * _DAY, _NOW), {}),
    ("flt_41_quarter_to_date", "dm:qtd", _between("modified", _TODAY - 29 * _DAY, _NOW), {}),
    ("flt_42_month_name", "dm:january", _between("modified", _TODAY - 29 * _DAY, _TODAY + 2 * _DAY), {}),
    ("flt_43_weekday", "dm:mon", _between("modified", _TODAY - _DAY, _TODAY), {}),
    ("flt_44_file", "file: .md", "NOT is_dir AND contains(lower_name, '.md')", {}),
    ("flt_44_folder", "folder:", "is_dir", {}),
    ("flt_44_glued", "folder:src1", "is_dir AND contains(lower_name, 'src1')", {"glued_type_filter": True}),
    ("flt_45_attributes", "attrib:ra", "(attributes & 33) = 33", {}),
    ("flt_45_unknown_attribute", "attrib:q", "false", {}),
    ("flt_46_normal", "attrib:n", "attributes IN (0, 128)", {}),
    ("flt_47_not_attribute", "!attrib:h", "(attributes & 2) = 0", {}),
    ("flt_47_inner_not", "attrib:!h", "(attributes & 2) = 0", {}),
    ("flt_47_both", "!attrib:!h", "(attributes & 2) <> 0", {}),
    *[(f"flt_48_is_{k.replace('-', '_')}", f"is:{k}", "attributes IN (0, 128)" if m == 128 else f"(attributes & {m}) = {m}", {}) for k, m in IS_ATTRIBUTE.items()],
    ("flt_48_is_folder", "is:folder", "is_dir", {}),
    ("flt_48_is_file", "is:file", "NOT is_dir", {}),
    ("flt_48_is_unknown", "is:nothing", "false", {}),
    *[(f"flt_49_invalid{k}", q, "false", {}) for k, q in (("", "size:garbage"), ("_date", "dm:notaday"), ("_attribute", "is:"), ("_length", "len:x"), ("_regex", "regex:("), ("_reference", "frn:abc"))],
    ("flt_50_and", "report .md size:>1kb", "contains(lower_name, 'report') AND contains(lower_name, '.md') AND size > 1024", {}),
    ("flt_51_or", "ext:rs size:>4kb | report or:café", "(extension = 'rs' AND size > 4096) OR contains(lower_name, 'report') OR contains(lower_name, 'café')", {}),
    ("flt_52_and_prefix", "report and:.md", "contains(lower_name, 'report') AND contains(lower_name, '.md')", {}),
    ("flt_53_quotes", '"report 000"', "contains(lower_name, 'report 000')", {}),
    ("flt_54_empty", "", "true", {}),
    ("flt_54_bars", " | | ", "true", {}),
    ("flt_55_include_all", "file:", "NOT is_dir", {"include_all": True}),
    ("flt_56_scope", "file:", "NOT is_dir AND starts_with(lower_path, '/corpus/de/')", {"path": "/corpus/DE/"}),
    ("flt_56_scope_root", "file:", "NOT is_dir", {"path": "/"}),
    ("flt_57_exclude_path", "", "NOT (lower_path = '/corpus/en' OR starts_with(lower_path, '/corpus/en/')) AND NOT (lower_path = '/corpus/de' OR starts_with(lower_path, '/corpus/de/'))", {"exclude_path": "/corpus/en; /corpus/de/"}),
    ("flt_58_exclude_name", "", "NOT regexp_matches(lower_path, '(^|[\\\\/:])src1([\\\\/]|$)')", {"exclude_path": "SRC1"}),
    ("flt_59_allow_list", "", "lower_path IN ('/corpus/en', '/corpus/de')", {"content_paths": ("/corpus/en", "/corpus/de", "/nowhere")}),
    ("flt_60_duplicate_names", "dupe:filename", "lower_name IN (SELECT lower_name FROM files GROUP BY 1 HAVING count(*) > 1)", {}),
    ("flt_negated_extension", "!ext:rs file:", "coalesce(extension, '') <> 'rs' AND NOT is_dir", {}),
    ("flt_negated_size", "!size:>1kb", "NOT size > 1024", {}),
]:
    _filter(_n, _q, _w, **_o)
_filter("flt_03_star", r"?:\corpus\en\s*\file-*.md", r"regexp_full_match(lower_path, 'c:\\corpus\\en\\s[^\\]*\\file-[^\\]*[.]md')", windows=True, match_path=True)
_filter("flt_04_double_star", r"?:\corpus\e**.md", r"regexp_full_match(lower_path, 'c:\\corpus\\e.*[.]md')", windows=True, match_path=True)
_filter("flt_56_windows_scope", "file:", rf"NOT is_dir AND starts_with(lower_path, 'c:\corpus\fr\')", windows=True, path="C:/corpus/FR")
_filter("flt_58_windows_exclude", "", r"NOT regexp_matches(lower_path, '(^|[\\/:])fr([\\/]|$)')", windows=True, exclude_path="fr")

# --- sorting and paging ---------------------------------------------------------------------------------------------------

_ORDERS = {
    "name": "lower_name, lower_path", "name_desc": "lower_name DESC, lower_path", "path": "lower_path", "path_desc": "lower_path DESC",
    "extension": "extension NULLS FIRST, lower_name", "extension_desc": "extension DESC NULLS LAST, lower_name",
}
for _k, _c in (("size", "size"), ("date_modified", "modified"), ("date_created", "created"), ("date_accessed", "accessed")):
    _ORDERS |= {_k: f"{_c} DESC, lower_path", f"{_k}_asc": f"{_c}, lower_path"}


def _ranked(page: DataFrame, sort: str) -> DataFrame:
    """Numbers the rows of one page (at most a few hundred)."""
    return page.withColumn("rank", F.row_number().over(Window.orderBy(*S.order(sort)))).select("rank", "path", "size", "extension")


for _i, _s in enumerate(("name", "name_desc", "path", "path_desc", "size", "size_asc", "date_modified", "date_modified_asc", "date_created", "date_created_asc", "date_accessed", "date_accessed_asc", "extension", "extension_desc"), 1):
    QUERIES[f"srt_{_i:02d}_{_s}"] = lambda spark, sf, s=_s: _ranked(S.find(fixtures.files(spark, sf), Options(sort=s, max_results=200)), s)
    ORACLES[f"srt_{_i:02d}_{_s}"] = f"{FILES} SELECT row_number() OVER (ORDER BY {_ORDERS[_s]}, path) AS rank, path, size, extension FROM files WHERE NOT excluded ORDER BY 1 LIMIT 200"


@query("lim_01_max_results", f"{FILES} SELECT path, size FROM files WHERE NOT excluded ORDER BY lower_name, lower_path, path LIMIT 100")
def _(spark, sf):
    return S.find(fixtures.files(spark, sf), Options()).select("path", "size")


@query("lim_02_offset", f"{FILES} SELECT path, size FROM files WHERE NOT excluded ORDER BY size DESC, lower_path, path LIMIT 25 OFFSET 50")
def _(spark, sf):
    return S.find(fixtures.files(spark, sf), Options(sort="size", max_results=25, offset=50)).select("path", "size")


@query("lim_03_top_k", f"{FILES} SELECT path, size FROM files WHERE NOT excluded AND NOT is_dir ORDER BY size DESC, lower_path, path LIMIT 10")
def _(spark, sf):
    return S.find(fixtures.files(spark, sf), Options(query="file:", sort="size", max_results=10)).select("path", "size")


@query("lim_05_total", f"{FILES} SELECT count(*) AS total FROM files WHERE NOT excluded AND contains(lower_name, 'report')")
def _(spark, sf):
    return S.count(fixtures.files(spark, sf), Options(query="report", max_results=5))


@query("lim_06_keyset", f"{FILES} SELECT path, size FROM files WHERE path > '/corpus/en/src1' ORDER BY path LIMIT 40")
def _(spark, sf):
    return S.after(fixtures.files(spark, sf), "/corpus/en/src1", 40).select("path", "size")


# --- scalar functions -----------------------------------------------------------------------------------------------------


def _function(name: str, columns: dict, sql: str, windows: bool = False) -> None:
    source = fixtures.windows_files if windows else fixtures.files
    QUERIES[name] = lambda spark, sf: source(spark, sf).select("path", *[c().alias(k) for k, c in columns.items()])
    ORACLES[name] = f"{WINDOWS if windows else FILES} SELECT path, {sql} FROM files"


_c = F.col
for _w in (False, True):
    _t = "_windows" if _w else ""
    _function(f"fn_01_basename{_t}", {"x": lambda: D.basename(_c("path"))}, r"regexp_extract(path, '([^\\/]*)$', 1) AS x", _w)
    _function(f"fn_02_split{_t}", {"dir": lambda: D.dirname(_c("path")), "base": lambda: D.basename(_c("path"))}, r"CASE WHEN regexp_matches(path, '[\\/]') THEN regexp_extract(path, '^(.*)[\\/][^\\/]*$', 1) END AS dir, regexp_extract(path, '([^\\/]*)$', 1) AS base", _w)
_function("fn_03_parent", {"parent": lambda: D.parent(_c("path"))}, "CASE WHEN path = '/corpus' THEN '/' ELSE regexp_replace(path, '/[^/]*$', '') END AS parent")
_function("fn_03_parent_windows", {"parent": lambda: D.parent(_c("path"))}, rf"CASE WHEN path = 'C:\corpus' THEN 'C:\' ELSE regexp_replace(path, '\\[^\\]*$', '') END AS parent", True)
_function("fn_04_extension", {"x": lambda: D.extension(_c("path"), _c("is_dir"))}, "extension AS x")
_function("fn_05_content_extension", {"x": lambda: D.content_extension(_c("path"))}, "regexp_extract(regexp_extract(path, '([^/]*)$', 1), '[.]([^.]*)$', 1) AS x")
_function("fn_06_excluded", {"x": lambda: D.is_excluded(_c("lower_path"))}, "contains(lower_path, '/node_modules/') OR ends_with(lower_path, '/node_modules') AS x")
_function("fn_07_key", {"x": lambda: D.canonical_key(_c("path"))}, f"{_LOW('path')} AS x")
_function("fn_10_separators", {"x": lambda: D.normalize_separators(_c("path"), False)}, f"replace(path, {_BS}, '/') AS x", True)
_function("fn_13_drive", {"x": lambda: D.volume_prefix(_c("path"))}, "'C:' AS x", True)
_function("fn_14_name_length", {"x": lambda: D.name_length(_c("name"))}, "strlen(name)::BIGINT AS x")
_function("fn_15_unix", {"x": lambda: D.to_unix(_c("modified")), "y": lambda: D.to_unix(_c("size"))}, f"(modified - {_E}) // 10000000 AS x, 0::BIGINT AS y")
_function("fn_16_iso", {"x": lambda: D.iso(_c("modified")), "y": lambda: D.iso(_c("size"))}, f"strftime(make_timestamp((modified - {_E}) // 10), '%Y-%m-%dT%H:%M:%SZ') AS x, NULL::VARCHAR AS y")
_function("fn_17_rfc3339", {"x": lambda: D.iso_from_unix(_c("file_ref") % 100_000 * 86399)}, "strftime(make_timestamp(file_ref % 100000 * 86399 * 1000000), '%Y-%m-%dT%H:%M:%SZ') AS x")
_function("fn_18_letters", {"x": lambda: D.attribute_letters(_c("attributes")), "y": lambda: D.attribute_letters(_c("file_ref"))}, ", ".join(
    f"CASE WHEN {v} = '' THEN '-' ELSE {v} END AS {k}" for k, c in (("x", "attributes"), ("y", "file_ref")) for v in ["(" + " || ".join(f"CASE WHEN {c} & {b} <> 0 THEN '{x}' ELSE '' END" for x, b in ATTRIBUTE_BITS.items()) + ")"]))
_function("fn_20_calendar", {"x": lambda: D.is_leap(_c("file_ref") % 3000), "d": lambda: D.days_in_month((_c("file_ref") % 3000 + 1).cast("int"), (_c("file_ref") % 12 + 1).cast("int"))},
          "(file_ref % 3000) % 4 = 0 AND ((file_ref % 3000) % 100 <> 0 OR (file_ref % 3000) % 400 = 0) AS x, day(last_day(make_date(file_ref % 3000 + 1, file_ref % 12 + 1, 1))) AS d")
_function("fn_21_day_start", {"x": lambda: D.start_of_day(D.to_unix(_c("modified")))}, f"(modified - {_E}) // 10000000 // 86400 * 86400 AS x")
_function("fn_26_contains", {"x": lambda: D.contains_folded(_c("name"), "RePort"), "y": lambda: D.contains_folded(_c("name"), "")}, "contains(lower_name, 'report') AS x, true AS y")
_function("fn_27_prefix", {"x": lambda: D.starts_with_folded(_c("name"), "FILE-")}, "starts_with(lower_name, 'file-') AS x")
_function("src_07_attributes", {"x": lambda: D.synthesize_attributes(_c("file_ref") % 512, _c("is_dir"), _c("name"))},
          "(CASE WHEN is_dir THEN 16 ELSE 32 END + CASE WHEN starts_with(name, '.') THEN 2 ELSE 0 END + CASE WHEN (file_ref % 512) & 146 = 0 THEN 1 ELSE 0 END)::BIGINT AS x")
_function("src_08_creation_time", {"x": lambda: D.creation_time(_c("file_ref") % 3, _c("file_ref") % 2, _c("size"))}, "coalesce(nullif(file_ref % 3, 0), nullif(file_ref % 2, 0), size) AS x")
_function("src_09_filetime", {"x": lambda: D.from_unix(_c("file_ref"), _c("size") % 1000)}, "(CASE WHEN file_ref = 0 THEN 0 ELSE (file_ref + 11644473600) * 10000000 + (size % 1000) // 100 END)::BIGINT AS x")


@query("fn_08_compose", f"{FILES} SELECT path, lower(nfc_normalize(replace(name, 'é', 'e' || chr(769)))) AS x FROM files")
def _(spark, sf):
    return fixtures.files(spark, sf).select("path", D.canonical_key(F.regexp_replace("name", "é", "e\u0301"), compose=True).alias("x"))


@query("fn_24_name_order", f"{FILES} SELECT path, row_number() OVER (ORDER BY lower_name, path) AS rank FROM files WHERE is_dir")
def _(spark, sf):
    dirs = fixtures.files(spark, sf).where("is_dir")
    return dirs.select("path", F.row_number().over(Window.orderBy(S.fold_key(F.col("name")), "path")).alias("rank"))


@query("fn_28_json", f"{FILES} SELECT path, size, is_dir FROM files")
def _(spark, sf):
    lines = journal.to_lines(fixtures.files(spark, sf).select("path", "size", "is_dir"))
    return journal.from_lines(lines, "path string, size long, is_dir boolean")


@query("fn_29_entry_view", f"{FILES} SELECT path, size, created, modified, accessed, is_dir, attributes, extension FROM files")
def _(spark, sf):
    return D.entry_view(fixtures.files(spark, sf))


_isosql = lambda c: f"strftime(make_timestamp(({c} - {_E}) // 10), '%Y-%m-%dT%H:%M:%SZ')"


@query("fn_30_tool_view", rf"{FILES} SELECT name AS filename, regexp_extract(path, '^(.*)/[^/]*$', 1) AS dir, path, size, {_isosql('created')} AS date_created, {_isosql('modified')} AS date_modified, {_isosql('accessed')} AS date_accessed, "
       "CASE attributes WHEN 2 THEN 'H' WHEN 33 THEN 'AR' WHEN 16 THEN 'D' WHEN 4 THEN 'S' WHEN 256 THEN 'T' WHEN 1024 THEN 'P' WHEN 2048 THEN 'C' WHEN 4096 THEN 'O' WHEN 8192 THEN 'I' WHEN 16384 THEN 'E' ELSE '-' END AS attributes, extension, is_dir FROM files")  # fmt: skip
def _(spark, sf):
    return D.tool_view(fixtures.files(spark, sf))


@query("fn_31_fields", f"{FILES} SELECT size, path FROM files")
def _(spark, sf):
    return D.project_fields(fixtures.files(spark, sf), "size, PATH, unknown")


# --- content --------------------------------------------------------------------------------------------------------------


def _eligible_sql() -> str:
    """Of the names that the fixtures have: .rs, .txt, .json, .log and .md are text, .gz is not; README and Makefile are, and other bare names not."""
    return "NOT is_dir AND size BETWEEN 1 AND 262144 AND NOT excluded AND (extension IN ('rs', 'txt', 'json', 'log', 'md') OR lower_name IN ('readme', 'makefile'))"


@query("opc_02_needles", f"{CONTENTS} SELECT path_key FROM contents WHERE contains({_LOW('body')}, 'license') AND contains({_LOW('body')}, 'this')")
def _(spark, sf):
    return T.matching(fixtures.contents(spark, sf), ["License", "THIS"])


@query("opc_01_content_term", f"{CONTENTS} SELECT path, size FROM files WHERE NOT excluded AND extension = 'md' AND lower_path IN (SELECT path_key FROM contents WHERE contains({_LOW('body')}, 'license'))")
def _(spark, sf):
    return apply(fixtures.files(spark, sf), Options(query='ext:md content:"License"'), fixtures.contents(spark, sf)).select("path", "size")


@query("opc_08_all_groups", f"{CONTENTS} SELECT path FROM files WHERE NOT excluded AND (extension = 'md' OR extension = 'rs') AND lower_path IN (SELECT path_key FROM contents WHERE contains({_LOW('body')}, 'token'))")
def _(spark, sf):
    return apply(fixtures.files(spark, sf), Options(query="ext:md | ext:rs content:token"), fixtures.contents(spark, sf)).select("path")


@query("opc_03_probe", f"{CONTENTS} SELECT coalesce(bool_or(contains({_LOW('body')}, 'the')), false) AS found FROM contents WHERE path_key = '/corpus/en/src1/file-00000001.txt'")
def _(spark, sf):
    return T.contains(fixtures.contents(spark, sf), "/corpus/en/src1/file-00000001.txt", "The")


@query("opc_04_eligible", f"{CONTENTS} SELECT path FROM files WHERE {_eligible_sql()}")
def _(spark, sf):
    return fixtures.files(spark, sf).where(T.eligible(F.col("path"), F.col("size"), F.col("is_dir"))).select("path")


def _greedy(source: str, key: str, size: str, budget: int) -> str:
    """CTEs: t(k, used, took) goes through the rows of `source` in the order of `key`, one by one; `e` has them numbered."""
    return f"""e AS (SELECT *, row_number() OVER (ORDER BY {key}) AS k FROM {source}),
t AS (SELECT 0::BIGINT AS k, 0::BIGINT AS used, false AS took UNION ALL
  SELECT e.k, CASE WHEN t.used + e.{size} <= {budget} THEN t.used + e.{size} ELSE t.used END, t.used + e.{size} <= {budget} FROM t JOIN e ON e.k = t.k + 1)"""


@query("opc_05_budget", f"{CONTENTS.replace('WITH ', 'WITH RECURSIVE ', 1)}, c AS (SELECT path, size FROM files WHERE {_eligible_sql()}), {_greedy('c', 'path', 'size', 200_000)} SELECT path, size FROM e JOIN t ON t.k = e.k WHERE took")
def _(spark, sf):
    rows = fixtures.files(spark, sf).where(T.eligible(F.col("path"), F.col("size"), F.col("is_dir"))).select("path", "size")
    return T.within_budget(rows, 200_000)


@query("opc_05_memory_budget", f"{CONTENTS}, r AS (SELECT path, size, coalesce(sum(size) OVER (ORDER BY path ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS s FROM files WHERE {_eligible_sql()}) SELECT path, least(size, 200000 - s)::BIGINT AS size FROM r WHERE s < 200000")
def _(spark, sf):
    rows = fixtures.files(spark, sf).where(T.eligible(F.col("path"), F.col("size"), F.col("is_dir"))).select("path", "size")
    return T.within_budget(rows, 200_000, memory=True)


_KNOWN = "known AS (SELECT * FROM contents WHERE byte_count % 2 = 0)"


@query("opc_06_candidates", f"{CONTENTS}, {_KNOWN} SELECT path FROM files WHERE {_eligible_sql()} AND path > '/corpus/en' AND NOT EXISTS (SELECT 1 FROM known WHERE path_key = lower_path AND source_modified = modified) ORDER BY path LIMIT 50")
def _(spark, sf):
    known = fixtures.contents(spark, sf).where("byte_count % 2 = 0")
    return T.candidates(fixtures.files(spark, sf), known, "/corpus/en", 50).select("path")


@query("opc_07_stats", f"{CONTENTS} SELECT count(*) AS files, coalesce(sum(byte_count), 0)::BIGINT AS bytes FROM contents")
def _(spark, sf):
    return T.stats(fixtures.contents(spark, sf))


@query("opj_01_semi", f"{CONTENTS} SELECT path FROM files WHERE lower_path IN (SELECT path_key FROM contents WHERE contains({_LOW('body')}, 'license'))")
def _(spark, sf):
    return T.search_files(fixtures.files(spark, sf), fixtures.contents(spark, sf), ["LICENSE"]).select("path")


@query("opj_02_stale_content", f"{CONTENTS}, {_KNOWN} SELECT path FROM files WHERE {_eligible_sql()} AND NOT EXISTS (SELECT 1 FROM known WHERE path_key = lower_path AND source_modified = modified)")
def _(spark, sf):
    return T.stale(fixtures.files(spark, sf), fixtures.contents(spark, sf).where("byte_count % 2 = 0")).select("path")


# --- joins and trees ------------------------------------------------------------------------------------------------------


@query("opj_03_lookup", f"{FILES}, w AS (SELECT DISTINCT event_id AS file_ref FROM events) SELECT w.file_ref::BIGINT AS file_ref, path FROM w LEFT JOIN files ON files.file_ref = w.file_ref")
def _(spark, sf):
    wanted = fixtures.table(spark, sf, "events").select(F.col("event_id").cast("long").alias("file_ref"), F.lit("/").alias("volume")).distinct()
    return R.lookup_refs(fixtures.files(spark, sf), wanted).select("file_ref", "path")


@query("opj_04_resolve_paths", f"{FILES} SELECT file_ref, 'D:' || replace(path, '/', {_BS}) AS path FROM files")
def _(spark, sf):
    files = fixtures.files(spark, sf)
    ids = files.select(F.col("path").alias("parent"), F.col("file_ref").alias("parent_ref"))
    records = files.select("file_ref", F.col("name").alias("own_name"), D.parent(F.col("path")).alias("parent"))
    records = records.join(ids, "parent", "left").select("file_ref", F.coalesce("parent_ref", F.lit(5)).alias("parent_ref"), "own_name")
    return R.resolve_paths(records, "D:").select("file_ref", "path")


@query("opj_05_mounts", f"{FILES} SELECT path, CASE WHEN starts_with(path, '/corpus/en/src1/') OR path = '/corpus/en/src1' THEN '/corpus/en/src1' WHEN starts_with(path, '/corpus/en/') OR path = '/corpus/en' THEN '/corpus/en' ELSE '/' END AS volume FROM files")
def _(spark, sf):
    mounts = spark.createDataFrame([("/",), ("/corpus/en",), ("/corpus/en/src1",), ("/corpus/e",)], "mount string")
    return R.mount_of(fixtures.files(spark, sf).select("path"), mounts)


_PAIRS = "r AS (SELECT *, lag(reason) OVER w AS lr, lag(path) OVER w AS lp FROM changes WHERE reason IN ('RENAME', 'RENAME_NEW', 'DELETE') WINDOW w AS (PARTITION BY file_ref ORDER BY seq))"


@query("opj_06_rename_pairs", f"{CHANGES}, {_PAIRS} SELECT file_ref, lp AS old_path, path AS new_path, seq FROM r WHERE reason = 'RENAME_NEW' AND lr = 'RENAME'")
def _(spark, sf):
    return C.pair_renames(fixtures.changes(spark, sf))


@query("opj_07_last_path", f"{CHANGES} SELECT c.seq, c.reason, b.path AS known_path FROM changes c LEFT JOIN base b ON b.file_ref = c.file_ref WHERE c.reason = 'RENAME_NEW'")
def _(spark, sf):
    return C.with_last_path(fixtures.changes(spark, sf).where("reason = 'RENAME_NEW'"), fixtures.base_files(spark, sf)).select("seq", "reason", "known_path")


@query("opj_08_full_pairing", f"{FILES}, a AS (SELECT coalesce(extension, '') AS k, count(*) AS n FROM files WHERE NOT excluded GROUP BY 1), b AS (SELECT coalesce(extension, '') AS k, count(*) AS n FROM files WHERE excluded AND extension <> 'rs' GROUP BY 1) "
       "SELECT coalesce(a.k, b.k) AS k, a.n AS kept, b.n AS hidden FROM a FULL JOIN b ON a.k = b.k")  # fmt: skip
def _(spark, sf):
    files = fixtures.files(spark, sf).withColumn("k", F.coalesce("extension", F.lit("")))
    a = files.where("not excluded").groupBy("k").agg(F.count("*").alias("kept"))
    b = files.where("excluded and extension <> 'rs'").groupBy("k").agg(F.count("*").alias("hidden"))
    return a.join(b, "k", "full_outer")


@query("agg_07_folder_sizes", f"{FILES} SELECT path, size FROM files")
def _(spark, sf):
    zero = fixtures.files(spark, sf).withColumn("size", F.when(F.col("is_dir"), 0).otherwise(F.col("size")))
    return R.folder_sizes(zero).select("path", F.col("size").cast("long").alias("size"))


@query("agg_08_direct_children", f"{FILES} SELECT regexp_replace(path, '/[^/]*$', '') AS parent, sum(size)::BIGINT AS size FROM files WHERE NOT is_dir GROUP BY 1")
def _(spark, sf):
    return A.direct_children(fixtures.files(spark, sf))


@query("ops_07_rename_prefix", f"{FILES} SELECT CASE WHEN path = '/corpus/en' OR starts_with(path, '/corpus/en/') THEN '/moved/english' || substr(path, 11) ELSE path END AS path, size FROM files")
def _(spark, sf):
    return R.rename_prefix(fixtures.files(spark, sf), "/corpus/en", "/moved/english").select("path", "size")


@query("ops_08_remove_prefix", f"{FILES} SELECT path, size FROM files WHERE NOT (path = '/corpus/en/src1' OR starts_with(path, '/corpus/en/src1/'))")
def _(spark, sf):
    return R.remove_prefix(fixtures.files(spark, sf), "/corpus/en/src1").select("path", "size")


_ANC = "array_to_string(string_split(path, '/')[1:k + 1], '/')"


@query("ops_09_ancestor_deltas", f"{FILES}, x AS (SELECT path, CASE WHEN file_ref % 3 = 0 THEN -size WHEN file_ref % 3 = 1 THEN 10 ELSE 0 END AS d, unnest(generate_series(1, len(string_split(path, '/')) - 2)) AS k FROM files WHERE NOT is_dir) "
       f"SELECT {_ANC} AS path, sum(d)::BIGINT AS delta FROM x GROUP BY 1 HAVING sum(d) <> 0")  # fmt: skip
def _(spark, sf):
    files = fixtures.files(spark, sf).where("not is_dir").select("path", "size", "is_dir", "file_ref")
    after = files.where("file_ref % 3 <> 0").withColumn("size", F.when(F.col("file_ref") % 3 == 1, F.col("size") + 10).otherwise(F.col("size")))
    return R.size_deltas(files, after)


@query("ops_10_directory_upsert", f"{FILES} SELECT path, size + CASE WHEN path IN ('/corpus', '/corpus/en') THEN 5 ELSE 0 END AS size FROM files UNION ALL SELECT '/corpus/en/new', 5 UNION ALL SELECT '/corpus/en/new/a.txt', 5")
def _(spark, sf):
    files = fixtures.entries(spark, sf)
    new = spark.createDataFrame([("/corpus/en/new", 99, True), ("/corpus/en/new/a.txt", 5, False)], "path string, size long, is_dir boolean")
    rest = [F.lit(None).cast(files.schema[c].dataType).alias(c) for c in files.columns if c not in new.columns]
    both = C.upsert(files, new.select("*", *rest).select(*files.columns))
    return R.folder_sizes(both).select("path", F.col("size").cast("long").alias("size"))


# --- aggregates -----------------------------------------------------------------------------------------------------------

_TOTALS = "count(*) AS total, count(*) FILTER (WHERE NOT is_dir) AS files, count(*) FILTER (WHERE is_dir) AS folders, coalesce(sum(size), 0)::BIGINT AS total_size"


@query("agg_01_aggregate", f"{FILES}, f AS (SELECT * FROM files WHERE NOT excluded AND size > 1024), l AS (SELECT path, size, is_dir FROM f ORDER BY size DESC, path LIMIT 5), "
       "e AS (SELECT coalesce(extension, '') AS extension, count(*) AS count, sum(size)::BIGINT AS size FROM f WHERE NOT is_dir GROUP BY 1) "
       f"SELECT (SELECT string_agg(path || ':' || size, ',' ORDER BY size DESC, path) FROM l) AS largest, (SELECT string_agg(extension || ':' || count || ':' || size, ',' ORDER BY count DESC, extension) FROM e) AS by_extension, {_TOTALS} FROM f")  # fmt: skip
def _(spark, sf):
    row = A.aggregate(fixtures.files(spark, sf), Options(query="size:>1kb"), 5)
    join = lambda c, *k: F.array_join(F.transform(c, lambda x: F.concat_ws(":", *[x[n].cast("string") for n in k])), ",").alias(c)
    return row.select("total", "files", "folders", "total_size", join("largest", "path", "size"), join("by_extension", "extension", "count", "size"))


@query("agg_02_totals", f"{FILES} SELECT {_TOTALS} FROM files WHERE NOT excluded")
def _(spark, sf):
    return A.totals(apply(fixtures.files(spark, sf), Options()))


@query("agg_03_saturating_sum", f"{FILES} SELECT 9223372036854775807::BIGINT AS x FROM files LIMIT 1")
def _(spark, sf):
    return fixtures.files(spark, sf).withColumn("size", F.lit(2**62)).agg(A.saturating_sum("size").alias("x"))


@query("agg_04_by_extension", f"{FILES} SELECT coalesce(extension, '') AS extension, count(*) AS count, sum(size)::BIGINT AS size FROM files WHERE NOT excluded AND NOT is_dir GROUP BY 1")
def _(spark, sf):
    return A.by_extension(apply(fixtures.files(spark, sf), Options()))


@query("agg_05_largest", f"{FILES} SELECT path, size, is_dir FROM files WHERE NOT excluded ORDER BY size DESC, path LIMIT 20")
def _(spark, sf):
    return A.largest(apply(fixtures.files(spark, sf), Options()), 0)


@query("agg_06_count", f"{FILES} SELECT count(*) AS total FROM files WHERE NOT excluded AND extension = 'log'")
def _(spark, sf):
    return S.count(fixtures.files(spark, sf), Options(query="ext:log"))


@query("agg_09_size", f"{FILES} SELECT count(*) AS entries FROM files")
def _(spark, sf):
    return fixtures.files(spark, sf).agg(F.count("*").alias("entries"))


@query("agg_10_percentile", f"{FILES}, r AS (SELECT size, row_number() OVER (ORDER BY size) - 1 AS k, count(*) OVER () AS n FROM files) SELECT size AS value FROM r WHERE k = round((n - 1) * 0.95)")
def _(spark, sf):
    return A.nearest_rank(fixtures.files(spark, sf), "size", 0.95)


@query("agg_11_distinct", f"{FILES} SELECT DISTINCT lower_name FROM files WHERE is_dir")
def _(spark, sf):
    return fixtures.files(spark, sf).where("is_dir").select("lower_name").dropDuplicates(["lower_name"])


@query("ext_directory_rollup", f"{FILES} SELECT string_split(path, '/')[3] AS level_2, string_split(path, '/')[2] AS level_1, count(*) AS count, sum(size)::BIGINT AS size, (grouping(string_split(path, '/')[2], string_split(path, '/')[3]))::BIGINT AS grouping FROM files WHERE NOT is_dir "
       "GROUP BY ROLLUP (string_split(path, '/')[2], string_split(path, '/')[3])")  # fmt: skip
def _(spark, sf):
    return A.by_directory_level(fixtures.files(spark, sf))


# --- windows --------------------------------------------------------------------------------------------------------------


@query("opw_01_duplicate_names", f"{FILES} SELECT path FROM files WHERE lower_name IN (SELECT lower_name FROM files GROUP BY 1 HAVING count(*) > 1)")
def _(spark, sf):
    return S.duplicates(fixtures.files(spark, sf)).select("path")


@query("opw_02_last_writer", f"{CHANGES} SELECT path, seq, reason FROM changes QUALIFY row_number() OVER (PARTITION BY path ORDER BY seq DESC) = 1")
def _(spark, sf):
    return R.last_writer(fixtures.changes(spark, sf).select("path", "seq", "reason"))


@query("src_02_hard_links", f"WITH {_BASE} SELECT file_ref, 1::BIGINT AS parent_ref, 'long-' || file_ref AS own_name FROM base UNION ALL SELECT file_ref, 2, 'other' FROM base")
def _(spark, sf):
    link = lambda p, n, s: F.struct(F.lit(p).cast("long").alias("parent_ref"), n.alias("name"), F.lit(s).alias("namespace"))
    ref = F.col("file_ref").cast("string")
    rows = fixtures.base_files(spark, sf).select("file_ref", F.array(link(1, F.concat(F.lit("SHORT~"), ref), 2), link(1, F.concat(F.lit("long-"), ref), 1), link(2, F.lit("other"), 0)).alias("links"))
    return R.explode_links(rows)


# --- sets -----------------------------------------------------------------------------------------------------------------


@query("set_01_union", f"{FILES} SELECT path, volume FROM files UNION ALL SELECT 'C:' || replace(path, '/', {_BS}), 'C:' FROM files")
def _(spark, sf):
    return fixtures.files(spark, sf).unionByName(fixtures.windows_files(spark, sf)).select("path", "volume")


@query("set_02_groups", f"{FILES} SELECT path FROM files WHERE NOT excluded AND (extension = 'md' OR contains(lower_name, '1'))")
def _(spark, sf):
    return apply(fixtures.files(spark, sf), Options(query="ext:md | 1")).select("path")


@query("set_03_intersection", f"{CONTENTS} SELECT path_key FROM contents WHERE contains({_LOW('body')}, 'the ') AND contains({_LOW('body')}, ' of ') AND contains({_LOW('body')}, 'with')")
def _(spark, sf):
    return T.matching(fixtures.contents(spark, sf), ["the ", " of ", "with"])


@query("set_04_difference", f"{FILES} SELECT path FROM files WHERE NOT excluded AND NOT starts_with(lower_path, '/corpus/en/') AND lower_path <> '/corpus/en'")
def _(spark, sf):
    return apply(fixtures.files(spark, sf), Options(exclude_path="/corpus/en")).select("path")


# --- changes --------------------------------------------------------------------------------------------------------------

_SHOW = "seq, timestamp, reason, path"


@query("ops_04_normalize", "SELECT event_id::BIGINT AS seq, CASE WHEN event_id & 512 <> 0 THEN 'DELETE' WHEN event_id & 8192 <> 0 THEN 'RENAME_NEW' WHEN event_id & 4096 <> 0 THEN 'RENAME' WHEN event_id & 256 <> 0 THEN 'CREATE' WHEN event_id & 1 <> 0 THEN 'WRITE' END AS reason FROM events")
def _(spark, sf):
    bits = {"delete": 512, "rename_new": 8192, "rename_old": 4096, "create": 256, "write": 1}
    events = fixtures.table(spark, sf, "events")
    return events.select(F.col("event_id").cast("long").alias("seq"), C.normalize(F.col("event_id"), bits).alias("reason"))


_LAST = "last AS (SELECT path, reason FROM changes QUALIFY row_number() OVER (PARTITION BY path ORDER BY seq DESC) = 1)"


@query("ops_05_apply", f"{CHANGES}, {_LAST} SELECT b.path, CASE WHEN l.path IS NULL THEN size ELSE size + 1 END AS size FROM base b LEFT JOIN last l ON b.path = l.path WHERE l.path IS NULL OR l.reason NOT IN ('DELETE', 'RENAME')")
def _(spark, sf):
    files = fixtures.base_files(spark, sf)
    return C.apply_changes(files, fixtures.changes(spark, sf), files.withColumn("size", F.col("size") + 1)).select("path", "size")


@query("ops_11_history", f"{CHANGES} SELECT {_SHOW} FROM changes ORDER BY seq DESC LIMIT 2500")
def _(spark, sf):
    return C.history(fixtures.changes(spark, sf), 2500).select(*_SHOW.split(", "))


@query("ops_12_recent_changes", f"{CHANGES} SELECT {_SHOW} FROM changes WHERE timestamp > (SELECT min(timestamp) FROM changes) ORDER BY seq DESC LIMIT 100")
def _(spark, sf):
    changes = fixtures.changes(spark, sf)
    since = changes.agg(F.min("timestamp")).first()[0]
    return C.recent(changes, since, 100).select(*_SHOW.split(", "))


for _r, _s in (("deleted", "reason = 'DELETE'"), ("renamed", "reason IN ('RENAME', 'RENAME_NEW')"), ("created", "reason IN ('CREATE', 'WRITE')"), ("Modified, deleted", "reason IN ('CREATE', 'WRITE', 'DELETE')"), (" ", "true")):
    _k = "ops_13_" + ("_".join(_r.lower().replace(",", "").split()) or "all")
    QUERIES[_k] = lambda spark, sf, r=_r: C.recent(fixtures.changes(spark, sf), 0, 0, r).select(*_SHOW.split(", "))
    ORACLES[_k] = f"{CHANGES} SELECT {_SHOW} FROM changes WHERE {_s}"


@query("ops_14_hours", f"{CHANGES}, m AS (SELECT max(timestamp) // 10000000 - 11644473600 AS t FROM changes) SELECT {_SHOW} FROM changes, m WHERE timestamp > (m.t + 11644473600) * 10000000 - 24 * 36000000000")
def _(spark, sf):
    changes = fixtures.changes(spark, sf)
    now = changes.agg(F.max("timestamp")).first()[0] // 10_000_000 - 11_644_473_600
    return C.recent(changes, C.since_hours(24, now)).select(*_SHOW.split(", "))


@query("ext_change_rates", f"{CHANGES} SELECT time_bucket(INTERVAL 1 HOUR, make_timestamp((timestamp - {_E}) // 10)) AS start, CASE WHEN reason = 'DELETE' THEN 'deleted' WHEN reason IN ('RENAME', 'RENAME_NEW') THEN 'renamed' ELSE 'modified' END AS category, count(*) AS n FROM changes GROUP BY ALL")
def _(spark, sf):
    return C.rates(fixtures.changes(spark, sf)).withColumn("start", F.col("start").cast("timestamp_ntz"))


# --- streams, run over what is available ----------------------------------------------------------------------------------


def _change_stream(spark: SparkSession, sf: str) -> tuple[DataFrame, str]:
    """The changes as a stream of JSON files, and a folder for what the stream keeps."""
    root = shared_path(spark, "stream")
    changes = fixtures.changes(spark, sf)
    changes.write.json(f"{root}/in")
    return spark.readStream.schema(changes.schema).json(f"{root}/in"), root


@query("ops_06_rename_stream", f"{CHANGES}, {_PAIRS} SELECT file_ref, CASE WHEN lr = 'RENAME' THEN lp END AS old_path, path AS new_path, seq FROM r WHERE reason = 'RENAME_NEW'")
def _(spark, sf):
    from .streaming import feed

    stream, root = _change_stream(spark, sf)
    out = feed.pair_renames(stream, "3650 days").writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/cp")
    out.trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(feed.PAIRED).parquet(f"{root}/out")


_STEP = lambda c: f"CASE WHEN {c} = '/corpus/fr/src1' OR starts_with({c}, '/corpus/fr/src1/') THEN '/corpus/french/first' || substr({c}, 16) WHEN {c} = '/corpus/fr' OR starts_with({c}, '/corpus/fr/') THEN '/corpus/french' || substr({c}, 11) WHEN {c} = '/corpus/es' OR starts_with({c}, '/corpus/es/') THEN '/moved' || substr({c}, 11) WHEN {c} = '/corpus/de/src2' OR starts_with({c}, '/corpus/de/src2/') THEN NULL ELSE {c} END"
#: Files and directories after fixtures.tree_changes: files by their last event and the late writes, directories with the sums of what is below.
AFTER = f"""{CHANGES}, {_TREE}, last AS (SELECT path, reason FROM changes QUALIFY row_number() OVER (PARTITION BY path ORDER BY seq DESC) = 1),
now AS (SELECT {_STEP('b.path')} AS path, b.text, b.modified, b.path AS was, l.path IS NOT NULL OR (b.path LIKE '/corpus/fr/%' AND file_ref % 50 = 1) AS changed,
    size + CASE WHEN l.path IS NOT NULL OR (b.path LIKE '/corpus/fr/%' AND file_ref % 50 = 1) THEN 1 ELSE 0 END AS size FROM base b LEFT JOIN last l ON b.path = l.path
    WHERE l.path IS NULL OR l.reason NOT IN ('DELETE', 'RENAME') OR (b.path LIKE '/corpus/fr/%' AND file_ref % 50 = 1)),
files_now AS (SELECT path, size FROM now WHERE path IS NOT NULL),
dirs_now AS (SELECT {_STEP('path')} AS path FROM dirs),
all_now AS (SELECT path, size, false AS is_dir FROM files_now UNION ALL
  SELECT d.path, coalesce((SELECT sum(f.size) FROM files_now f WHERE starts_with(f.path, d.path || '/')), 0)::BIGINT, true FROM dirs_now d WHERE d.path IS NOT NULL) """


@query("ops_05_apply_directories", f"{AFTER} SELECT path, size FROM files_now")
def _(spark, sf):
    return C.apply_changes(fixtures.base_files(spark, sf), fixtures.tree_changes(spark, sf), fixtures.present(spark, sf).where("not is_dir")).select("path", "size")


@query("ops_07_rename_directories", f"{FILES} SELECT CASE WHEN path = '/corpus/en' OR starts_with(path, '/corpus/en/') THEN '/b' || substr(path, 11) WHEN path = '/corpus' THEN '/c' WHEN starts_with(path, '/corpus/') THEN '/c' || substr(path, 8) ELSE path END AS path, CASE path WHEN '/corpus/en' THEN 'b' WHEN '/corpus' THEN 'c' ELSE lower_name END AS lower_name FROM files")
def _(spark, sf):
    """Renames that only make sense in turn."""
    renames = [("/corpus/en", "/a"), ("/a", "/b"), ("/corpus", "/c")]
    return C.apply_directory_renames(fixtures.files(spark, sf), renames).select("path", "lower_name")


def _applied_store(spark: SparkSession, sf: str, runs: int = 2, most: int = 0):
    """A store after the stream of tree_changes, run twice: the second run finds every batch applied."""
    from .operators.catalog import Store
    from .streaming import feed

    root = shared_path(spark, "stream")
    changes = fixtures.tree_changes(spark, sf)
    changes.write.json(f"{root}/in")
    stream = spark.readStream.schema(changes.schema).json(f"{root}/in")
    store = Store(spark, f"{root}/store")
    store.replace(fixtures.entries(spark, sf))
    store.insert_content(fixtures.contents(spark, sf).withColumn("indexed_at", F.lit(0).cast("long")))
    now = fixtures.present(spark, sf)
    new = fixtures.contents(spark, sf).withColumn("path_key", D.ascii_lower(fixtures.walked(F.col("path_key")))).where("path_key is not null")

    def bodies(files: DataFrame) -> DataFrame:
        own = files.select(F.col("lower_path") if "lower_path" in files.columns else D.ascii_lower(F.col("path")).alias("lower_path"))
        rows = new.join(own, F.col("path_key") == F.col("lower_path"), "left_semi")
        return rows.select("path_key", F.concat(F.lit("new "), "body").alias("body"), (F.col("byte_count") + 4).alias("byte_count"), F.lit(1).cast("long").alias("indexed_at"), "source_modified")

    for _ in range(runs):
        feed.apply_to_catalog(stream, store, lambda paths: now.join(paths, "path", "left_semi"), f"{root}/cp", bodies=bodies).awaitTermination()
    return store


@query("ops_16_apply_stream", f"{AFTER} SELECT path, size, is_dir FROM all_now")
def _(spark, sf):
    return _applied_store(spark, sf).read().select("path", "size", "is_dir")


@query("ops_18_content_refresh", f"""{AFTER} SELECT {_LOW('path')} AS path_key, (strlen(text) + CASE WHEN changed THEN 4 ELSE 0 END)::BIGINT AS byte_count FROM now
WHERE path IS NOT NULL AND strlen(text) > 0 AND (NOT changed OR (size BETWEEN 1 AND 262144 AND NOT contains(path, '/node_modules/') AND regexp_matches({_LOW('path')}, '([.](rs|txt|json|log|md)|/readme|/makefile)$')))""")
def _(spark, sf):
    return _applied_store(spark, sf, 1).read("contents").select("path_key", "byte_count")


@query("ops_08_pending", "SELECT '/corpus/en/src3' AS path")
def _(spark, sf):
    return _applied_store(spark, sf, 1).read("pending").select("path")


def _journal_of(spark: SparkSession, sf: str) -> str:
    """All changes in a replayable journal of four segments or more, in the folder that driver and executors share."""
    from .sources import replay

    root = _journal_root(spark)
    replay.write_segments(root, fixtures.changes(spark, sf).drop("seq"), [F.col("timestamp"), F.col("path"), F.col("reason")], 4)
    return root


def _journal_root(spark: SparkSession) -> str:
    """A folder as Python opens it: the journal's reader needs one that is mounted."""
    scheme, _, path = shared_path(spark, "journal").rpartition(":")
    if scheme not in ("", "file"):
        raise RuntimeError("the journal needs spark.checkpoint.dir in a mounted file system")
    root = "/" + path.lstrip("/")
    os.makedirs(root, exist_ok=True)
    return root


def _streamed(spark: SparkSession, source: DataFrame) -> DataFrame:
    """What a stream gives now, in two runs of one query."""
    root = shared_path(spark, "replayed")
    for _ in range(2):
        source.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/cp").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(source.schema).parquet(f"{root}/out")


@query("ops_01_replay", f"{CHANGES} SELECT row_number() OVER (ORDER BY timestamp, path, reason) - 1 AS seq, timestamp, reason, path, file_ref FROM changes")
def _(spark, sf):
    from .sources import replay

    return _streamed(spark, replay.stream(spark, _journal_of(spark, sf))).select("seq", "timestamp", "reason", "path", "file_ref")


@query("ops_15_overflow", f"{FILES} SELECT path, size FROM files")
def _(spark, sf):
    """The journal's beginning is gone: the volume is scanned again."""
    from .operators.catalog import Store
    from .sources import replay
    from .streaming import feed

    journal_path, root = _journal_of(spark, sf), shared_path(spark, "overflow")
    os.remove(replay.segments(journal_path)[0][1])
    store, now = Store(spark, root), fixtures.entries(spark, sf)
    store.replace(now.where("is_dir or file_ref % 2 = 0"))
    feed.apply_to_catalog(replay.stream(spark, journal_path), store, lambda paths: now.join(paths, "path", "left_semi"), f"{root}/cp", rescan=lambda v: now).awaitTermination()
    return store.read().select("path", "size")


@query("ops_17_resume", "SELECT * FROM (VALUES ('behind', false), ('none saved', false), ('other journal', false), ('same', true), ('two volumes', false)) t(live, resumes)")
def _(spark, sf):
    from .operators.catalog import Store

    store, schema = Store(spark, shared_path(spark, "store")), "volume string, journal_id long, cursor long"
    rows = lambda *r: spark.createDataFrame(list(r), schema)
    out = [("none saved", store.can_resume(rows(("C:", 1, 10))))]
    store.save_checkpoints(rows(("C:", 1, 10)))
    for name, live in (("same", (("C:", 1, 12),)), ("behind", (("C:", 1, 9),)), ("other journal", (("C:", 2, 12),)), ("two volumes", (("C:", 1, 12), ("D:", 1, 1)))):
        out.append((name, store.can_resume(rows(*live))))
    return spark.createDataFrame(out, "live string, resumes boolean")


@query("ops_19_tail_before_scan", f"{CHANGES}, {_LAST} SELECT b.path, CASE WHEN l.path IS NULL THEN size ELSE size + 1 END AS size FROM base b LEFT JOIN last l ON b.path = l.path WHERE l.path IS NULL OR l.reason NOT IN ('DELETE', 'RENAME')")
def _(spark, sf):
    """Events that arrive during the scan are read from where the journal ended before it; later starts resume."""
    from .operators.catalog import Store
    from .sources import replay
    from .streaming import feed

    journal_path, root = _journal_root(spark), shared_path(spark, "tail")
    replay.write_segment(journal_path, [{"timestamp": 1, "reason": "DELETE", "path": "/before/the/scan", "is_dir": False, "file_ref": 1}])
    store, files = Store(spark, root), fixtures.base_files(spark, sf)
    live = lambda: spark.createDataFrame([("/", 7, replay.tail(journal_path))], "volume string, journal_id long, cursor long")

    def scan() -> DataFrame:
        replay.write_segments(journal_path, fixtures.changes(spark, sf).withColumnRenamed("seq", "event"), [F.col("event")])
        return files

    for _ in range(2):
        start = feed.begin(store, live(), scan).first()["cursor"]
        now = files.withColumn("size", F.col("size") + 1)
        feed.apply_to_catalog(replay.stream(spark, journal_path, cursor=start), store, lambda paths: now.join(paths, "path", "left_semi"), f"{root}/cp").awaitTermination()
    return store.read().select("path", "size")


@query("ops_09_apply_deltas", f"{FILES} SELECT path, greatest(0, size - (SELECT sum(f.size) FROM files f WHERE NOT f.is_dir AND f.file_ref % 3 = 0 AND starts_with(f.path, files.path || '/')))::BIGINT AS size FROM files WHERE is_dir AND path = '/corpus'")
def _(spark, sf):
    files = fixtures.files(spark, sf)
    return R.apply_deltas(files, R.size_deltas(files, files.where("file_ref % 3 <> 0 or is_dir"))).where("path = '/corpus'").select("path", "size")


# --- sources, sinks, control ----------------------------------------------------------------------------------------------


def _tree_of(spark: SparkSession, sf: str, tag: str) -> str:
    """A folder on this machine with one small file for each supplier, below its nation."""
    root = os.path.join(tempfile.mkdtemp(prefix="pathquarry-"), tag)
    for r in fixtures.table(spark, sf, "supplier").select("s_suppkey", "s_nationkey", "s_name").toLocalIterator():
        folder = os.path.join(root, f"n{r.s_nationkey}", f"k{r.s_suppkey % 7}")
        os.makedirs(folder, exist_ok=True)
        with open(os.path.join(folder, f"{r.s_suppkey}.txt"), "w") as f:
            f.write(r.s_name)
    return root


_WALK = """WITH f AS (SELECT '/n' || s_nationkey || '/k' || s_suppkey % 7 AS d, '/n' || s_nationkey AS n, s_suppkey, s_name FROM supplier)
SELECT d || '/' || s_suppkey || '.txt' AS path, strlen(s_name)::BIGINT AS size, false AS is_dir FROM f UNION SELECT d, 0, true FROM f UNION SELECT n, 0, true FROM f UNION SELECT '', 0, true"""


@query("src_03_walk", _WALK)
def _(spark, sf):
    root = _tree_of(spark, sf, "walk")
    return filesystem.scan(spark, root).select(F.substring(F.col("path"), F.lit(len(root) + 1), F.length("path")).alias("path"), "size", "is_dir")


@query("src_11_volumes", f"SELECT v AS volume, t.* FROM ({_WALK}) t, (VALUES ('one'), ('two')) x(v)")
def _(spark, sf):
    roots = [_tree_of(spark, sf, tag) for tag in ("one", "two")]
    rows = filesystem.scan(spark, *roots, "/does/not/exist")
    return rows.select(F.regexp_extract("volume", "([^/]*)$", 1).alias("volume"), F.expr("substring(path, length(volume) + 1)").alias("path"), "size", "is_dir")


@query("src_05_stat", "SELECT s_suppkey, strlen(s_name)::BIGINT AS size, false AS is_dir FROM supplier")
def _(spark, sf):
    root = _tree_of(spark, sf, "stat")
    keys = fixtures.table(spark, sf, "supplier").select("s_suppkey", "s_nationkey").collect()
    rows = [(r[0], filesystem.stat_path(f"{root}/n{r[1]}/k{r[0] % 7}/{r[0]}.txt")) for r in keys]
    return spark.createDataFrame([(k, row[1], row[5]) for k, row in rows], "s_suppkey long, size long, is_dir boolean")


@query("src_16_bodies", "SELECT s_suppkey || '.txt' AS name, s_name AS body, strlen(s_name)::BIGINT AS byte_count FROM supplier")
def _(spark, sf):
    root = _tree_of(spark, sf, "bodies")
    return T.read_bodies(spark, [f"file://{root}/*/*/*.txt"]).select(F.regexp_extract("path_key", "([^/]*)$", 1).alias("name"), "body", "byte_count")


@query("src_06_discover", "SELECT * FROM (VALUES ('/', 'a'), ('/home', 'b')) t(mount, device)")
def _(spark, sf):
    rows = [("a", "/", "ext4"), ("b", "/h", "xfs"), ("b", "/home", "xfs"), ("p", "/proc", "proc")]
    return filesystem.discover(spark.createDataFrame(rows, "device string, mount string, type string"))


@query("src_10_zero_sizes", f"{FILES} SELECT path, size FROM files")
def _(spark, sf):
    files = fixtures.files(spark, sf)
    hollow = files.withColumn("size", F.when(~F.col("is_dir") & (F.col("file_ref") % 5 == 0), 0).otherwise(F.col("size")))
    return filesystem.patch_zero_sizes(hollow, files.where("not is_dir").select("path", "size")).select("path", "size")


@query("src_12_statistics", f"{FILES} SELECT volume, count(*) AS entries FROM files GROUP BY 1")
def _(spark, sf):
    return filesystem.statistics(fixtures.files(spark, sf))


@query("src_13_journal", f"{CHANGES} SELECT timestamp, reason, path, is_dir FROM changes")
def _(spark, sf):
    path = shared_path(spark, "journal")
    journal.append(fixtures.changes(spark, sf), path)
    return journal.read(spark, path, None).select("timestamp", "reason", "path", "is_dir")


@query("src_13_journal_tail", f"{CHANGES} SELECT seq, path FROM changes ORDER BY (seq * 7919) % 10007 DESC, seq DESC LIMIT 500")
def _(spark, sf):
    """Arrival is in another order than time."""
    path, changes = shared_path(spark, "journal"), fixtures.changes(spark, sf)
    journal.append(changes.withColumn("file_ref", F.col("seq")).withColumn("seq", F.col("seq") * 7919 % 10007 * 1_000_000_000 + F.col("seq")), path)
    return journal.read(spark, path, 500).select(F.col("file_ref").alias("seq"), "path")


@query("src_14_candidate_scan", f"{FILES} SELECT path, size FROM files WHERE extension = 'rs' AND size > 1000")
def _(spark, sf):
    from .operators.catalog import Store

    store = Store(spark, shared_path(spark, "store"))
    store.replace(fixtures.entries(spark, sf))
    return store.read().where("extension = 'rs' and size > 1000").select("path", "size")


@query("src_15_synthetic", "WITH g AS (SELECT range AS n FROM range(20000)) SELECT 'C:' || chr(92) || 'benchmark' || chr(92) || 'workspace-' || lpad((n % 50)::VARCHAR, 3, '0') || chr(92) || CASE WHEN n % 17 = 0 THEN 'node_modules' ELSE 'src' END || chr(92) || 'module-' "
       "|| lpad((n % 10000)::VARCHAR, 4, '0') || CASE WHEN n % 97 = 0 THEN '' ELSE chr(92) || CASE WHEN n % 101 = 0 THEN 'café-' ELSE 'file-' END || lpad(n::VARCHAR, 8, '0') || '.' || ['rs', 'txt', 'json', 'log', 'md'][n % 5 + 1] END AS path, "
       "n * 131 % 1048576 AS size, n % 97 = 0 AS is_dir, (CASE WHEN n % 19 = 0 THEN 2 ELSE 128 END)::BIGINT AS attributes FROM g")  # fmt: skip
def _(spark, sf):
    return synthetic(spark, 20_000).select("path", "size", "is_dir", "attributes")


@query("snk_01_replace", f"{FILES} SELECT path, size + CASE WHEN is_dir THEN (SELECT count(*) FROM base b WHERE starts_with(b.path, files.path || '/')) ELSE 1 END AS size, extension, modified + CASE WHEN is_dir THEN 0 ELSE 30 END AS modified FROM files")
def _(spark, sf):
    """Every file four times: the row modified last stays."""
    from .operators.catalog import Store

    store, rows = Store(spark, shared_path(spark, "store")), fixtures.entries(spark, sf)
    files = rows.where("not is_dir").withColumn("k", F.explode(F.array(*map(F.lit, (10, 30, 0, 20)))))
    files = files.withColumn("modified", F.col("modified") + F.col("k")).withColumn("size", F.when(F.col("k") == 30, F.col("size") + 1).otherwise(F.col("k"))).drop("k")
    store.replace(rows.where("is_dir").unionByName(files))
    return store.read().select("path", "size", "extension", "modified")


@query("snk_02_replace_volume", f"{FILES} SELECT path, volume FROM files UNION ALL SELECT 'C:' || chr(92) || 'x.txt', 'C:'")
def _(spark, sf):
    from .operators.catalog import Store

    store = Store(spark, shared_path(spark, "store"))
    store.replace(fixtures.entries(spark, sf).unionByName(fixtures.windows_files(spark, sf).select(*fixtures.entries(spark, sf).columns)))
    store.replace_volume("C:", fixtures.base_files(spark, sf).where("file_ref = 1").withColumn("path", F.lit("C:\\x.txt")).withColumn("volume", F.lit("C:")))
    return store.read().select("path", "volume")


@query("snk_03_upsert", f"WITH {_BASE} SELECT path, CASE WHEN file_ref % 2 = 0 THEN size + 7 ELSE size END AS size FROM base")
def _(spark, sf):
    files = fixtures.base_files(spark, sf)
    return C.upsert(files, files.where("file_ref % 2 = 0").withColumn("size", F.col("size") + 7)).select("path", "size")


@query("snk_05_json", f"{FILES} SELECT path FROM files")
def _(spark, sf):
    return journal.from_lines(journal.to_lines(D.entry_view(fixtures.files(spark, sf))), "path string")


_OLD = "old AS (SELECT path_key, byte_count FROM contents WHERE source_modified // 36070000000 % 4 = 1)"


@query("snk_06_content_insert", f"{CONTENTS.replace('WITH ', 'WITH RECURSIVE ', 1)}, {_OLD}, c AS (SELECT path_key, byte_count FROM contents WHERE path_key NOT IN (SELECT path_key FROM old)), {_greedy('c', 'path_key', 'byte_count', 300_000)} "
       "SELECT path_key, byte_count FROM old UNION ALL SELECT path_key, byte_count FROM e JOIN t ON t.k = e.k WHERE took")  # fmt: skip
def _(spark, sf):
    """A quarter is stored; of the rest goes in what fits, in path order. What is stored stays."""
    from .operators.catalog import Store

    store = Store(spark, shared_path(spark, "store"))
    rows = fixtures.contents(spark, sf).withColumn("indexed_at", F.lit(0).cast("long"))
    old = rows.where("floor(source_modified / 36070000000) % 4 = 1")
    store.insert_content(old)
    used = store.read("contents").agg(F.sum("byte_count")).first()[0] or 0
    store.insert_content(rows.join(old.select("path_key"), "path_key", "left_anti"), used + 300_000)
    return store.read("contents").select("path_key", "byte_count")


@query("snk_08_checkpoints", "SELECT * FROM (VALUES ('C:', 1::BIGINT, 20::BIGINT), ('D:', 2, 30)) t(volume, journal_id, cursor)")
def _(spark, sf):
    from .operators.catalog import Store

    store = Store(spark, shared_path(spark, "store"))
    schema = "volume string, journal_id long, cursor long"
    store.save_checkpoints(spark.createDataFrame([("C:", 1, 10), ("D:", 2, 30)], schema))
    store.save_checkpoints(spark.createDataFrame([("C:", 1, 20)], schema), volumes_only=True)
    return store.read("checkpoints")


@query("snk_04_append", f"{CHANGES} SELECT timestamp, reason, path, is_dir FROM changes")
def _(spark, sf):
    path, changes = shared_path(spark, "journal"), fixtures.changes(spark, sf)
    for k in (0, 1):
        journal.append(changes.where(F.col("seq") % 2 == k), path)
    return journal.read(spark, path, None).select("timestamp", "reason", "path", "is_dir")


@query("snk_07_clear", "SELECT 0::BIGINT AS files, 0::BIGINT AS bytes")
def _(spark, sf):
    from .operators.catalog import Store

    store = Store(spark, shared_path(spark, "store"))
    store.insert_content(fixtures.contents(spark, sf).withColumn("indexed_at", F.lit(0).cast("long")))
    store.clear_content()
    return T.stats(store.read("contents"))


@query("opx_02_status", f"{CONTENTS} SELECT (SELECT count(*) FROM files) AS entries, count(*) AS content_files, sum(byte_count)::BIGINT AS content_bytes FROM contents")
def _(spark, sf):
    from .api import Catalog

    return Catalog(fixtures.files(spark, sf), fixtures.contents(spark, sf)).status().select("entries", "content_files", "content_bytes")


@query("opx_03_find", f"{FILES} SELECT name AS filename, size FROM files WHERE NOT excluded AND contains(lower_name, 'report') ORDER BY size DESC, lower_path, path LIMIT 30")
def _(spark, sf):
    from .api import Catalog

    return Catalog(fixtures.files(spark, sf)).find("report", fields="filename,size", sort="size", max_results=30)


@query("opx_06_validate", "SELECT 0::BIGINT AS null_paths, 0::BIGINT AS negative_sizes, 0::BIGINT AS repeated_paths")
def _(spark, sf):
    from .operators.catalog import Store

    store = Store(spark, shared_path(spark, "store"))
    store.replace(fixtures.entries(spark, sf))
    return store.validate()


@query("snk_03_store_upsert", f"{FILES} SELECT path, CASE WHEN is_dir THEN (SELECT sum(f.size + CASE WHEN f.file_ref % 2 = 0 THEN 7 ELSE 0 END) FROM files f WHERE NOT f.is_dir AND starts_with(f.path, files.path || '/')) WHEN file_ref % 2 = 0 THEN size + 7 ELSE size END::BIGINT AS size FROM files")
def _(spark, sf):
    from .operators.catalog import Store

    store = Store(spark, shared_path(spark, "store"))
    store.replace(fixtures.entries(spark, sf))
    store.upsert(fixtures.base_files(spark, sf).where("file_ref % 2 = 0").withColumn("size", F.col("size") + 7))
    return store.read().select("path", "size")


@query("snk_04_append_stream", f"{CHANGES} SELECT seq, timestamp, reason, path FROM changes")
def _(spark, sf):
    from .streaming import feed

    stream, root = _change_stream(spark, sf)
    for _ in range(2):
        feed.to_journal(stream, f"{root}/journal", f"{root}/cp").awaitTermination()
    return spark.read.schema(fixtures.changes(spark, sf).schema).json(f"{root}/journal").select(*_SHOW.split(", "))


@query("opx_03_count", f"{FILES} SELECT count(*) AS total FROM files WHERE NOT excluded AND contains(lower_name, 'report') AND size > 1024")
def _(spark, sf):
    from .api import Catalog

    return spark.createDataFrame([(Catalog(fixtures.files(spark, sf)).count("report size:>1kb"),)], "total long")


@query("opx_03_aggregate", f"{FILES} SELECT {_TOTALS} FROM files WHERE NOT excluded AND extension IN ('md', 'rs')")
def _(spark, sf):
    from .api import Catalog

    return Catalog(fixtures.files(spark, sf)).aggregate("ext:md,rs", top=3).select("total", "files", "folders", "total_size")


@query("opx_03_recent", f"{CHANGES} SELECT {_SHOW} FROM changes WHERE reason = 'DELETE' ORDER BY seq DESC LIMIT 30")
def _(spark, sf):
    from .api import Catalog

    return Catalog(fixtures.files(spark, sf), changes=fixtures.changes(spark, sf)).recent_changes(limit=30, reasons="deleted").select(*_SHOW.split(", "))


@query("opx_06_validate_damaged", f"{FILES} SELECT 1::BIGINT AS null_paths, count(*) FILTER (WHERE file_ref % 5 = 0 AND NOT is_dir)::BIGINT AS negative_sizes, count(*) FILTER (WHERE file_ref % 3 = 0 AND NOT is_dir)::BIGINT AS repeated_paths FROM files")
def _(spark, sf):
    from .operators.catalog import Store

    store, rows = Store(spark, shared_path(spark, "store")), fixtures.entries(spark, sf)
    rows = rows.withColumn("size", F.when(~F.col("is_dir") & (F.col("file_ref") % 5 == 0), -1).otherwise(F.col("size")))
    twice = rows.where("not is_dir and file_ref % 3 = 0").withColumn("size", F.lit(3).cast("long"))
    none = rows.where("file_ref = 1").withColumn("path", F.lit(None).cast("string"))
    store.write("files", D.derive(rows.unionByName(twice).unionByName(none)))
    return store.validate()


@query("opx_07_quarantine", f"{FILES} SELECT path, size FROM files UNION ALL SELECT 'files:C:', 1")
def _(spark, sf):
    """The files of one volume are damaged: they are put aside, and the other volume stays."""
    from .operators.catalog import Store

    root = shared_path(spark, "store")
    store = Store(spark, root)
    store.replace(fixtures.entries(spark, sf).unionByName(fixtures.windows_files(spark, sf).select(*fixtures.entries(spark, sf).columns)))
    bad = store.manifest().tables["files"]["C:"]
    fs, path = store._fs, store._path
    for s in fs.listStatus(path(bad)):
        if s.getPath().getName().endswith(".parquet"):
            out = fs.create(s.getPath(), True)
            out.write(bytearray(b"no parquet"))
            out.close()
    found = store.quarantine()
    return store.read().select("path", "size").union(spark.createDataFrame([(f"{t}:{p}", 1) for t, p in found], "path string, size long"))


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    """Totals, largest rows and extensions of a filtered catalog."""
    return QUERIES["agg_01_aggregate"](spark, sf)
