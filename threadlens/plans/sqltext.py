"""DuckDB fragments that restate the text definitions for the oracle queries."""

from __future__ import annotations

from threadlens.functions.text import PUNCT_CLASS, SILENT_E, URL_PATTERN, WS


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def str_list(values) -> str:
    return "(" + ", ".join(lit(v) for v in values) + ")"


def strip(c: str) -> str:
    return f"regexp_replace({c}, '^[{WS}]+|[{WS}]+$', '', 'g')"


def clean(c: str) -> str:
    no_url = f"regexp_replace({c}, '{URL_PATTERN}', '', 'g')"
    squeezed = f"regexp_replace({no_url}, '[ \\t]+', ' ', 'g')"
    return f"coalesce({strip(squeezed)}, '')"


def words(c: str) -> str:
    return f"list_filter(regexp_split_to_array({c}, '[{WS}]+'), lambda w: w <> '')"


def sentences(c: str) -> str:
    marked = f"regexp_replace({c}, '([.!?]+)[{WS}]+', '\\1' || chr(1), 'g')"
    return f"list_filter(string_split({marked}, chr(1)), lambda s: regexp_matches(s, '[^{WS}]'))"


def count_class(c: str, char_class: str) -> str:
    return f"len(regexp_extract_all({c}, '{char_class}'))"


PUNCT = PUNCT_CLASS
SILENT = SILENT_E

# Cleaned documents of at least five characters, with their word and sentence lists.
BASE = f"""base AS (
  SELECT doc_id AS id, source AS community, lang, t AS text_clean,
         {words('t')} AS ws, {sentences('t')} AS ss
  FROM (SELECT *, {clean('text')} AS t FROM documents) WHERE length(t) >= 5
)"""


def split_sql(table: str, label: str, id_col: str = "id", seed: int = 42) -> str:
    """The plain full-ranking form of the stratified split: adds ``split`` to ``table``."""
    return f"""(
  SELECT * EXCLUDE (rk, n), CASE
      WHEN rk <= ((n * 30 + 99) // 100 + 1) // 2 THEN 'test'
      WHEN rk <= (n * 30 + 99) // 100 THEN 'val' ELSE 'train' END AS split
  FROM (SELECT *, row_number() OVER (PARTITION BY {label}
                  ORDER BY md5('{seed}-' || {id_col}::VARCHAR), {id_col}) AS rk,
               count(*) OVER (PARTITION BY {label}) AS n FROM {table}) )"""
