"""SQL fragments shared by the DuckDB twins."""

from __future__ import annotations

SPACES = "chr(9)||chr(10)||chr(11)||chr(12)||chr(13)||' '||chr(160)||chr(65279)"


def trim(x: str) -> str:
    return f"trim({x}, {SPACES})"


def empty(x: str) -> str:
    return f"(({x}) IS NULL OR lower({trim(x)}) IN ('','null','none','nan','n/a','na'))"


def useful(x: str) -> str:
    return f"(length({trim(x)}) BETWEEN 1 AND 160 AND lower({trim(x)}) NOT IN ('null','none','nan','n/a'))"


def num(x: str) -> str:
    return f"(CASE WHEN {x} = floor({x}) AND abs({x}) < 1e18 THEN CAST(CAST(floor({x}) AS BIGINT) AS VARCHAR) ELSE CAST({x} AS VARCHAR) END)"


def stable_id(prefix: str, *parts: str) -> str:
    joined = ", ".join(f"coalesce(CAST({p} AS VARCHAR), '')" for p in parts)
    return f"'{prefix}-' || substr(sha256(concat_ws(chr(31), {joined})), 1, 24)"


def short_hash(x: str, n: int = 12) -> str:
    return f"substr(sha256({x}), 1, {n})"


def decode(x: str) -> str:
    for name, char in (("&nbsp;", "' '"), ("&amp;", "'&'"), ("&lt;", "'<'"), ("&gt;", "'>'"), ("&quot;", "'\"'"),
                       ("&#039;", "chr(39)"), ("&apos;", "chr(39)")):
        x = f"replace({x}, '{name}', {char})"
    return x


def clean(x: str) -> str:
    x = f"regexp_replace({decode(x)}, '\\r\\n?', chr(10), 'g')"
    x = f"regexp_replace({x}, '[ \\t]+', ' ', 'g')"
    ws = r"[\t\x0B\f\r \x{A0}\x{FEFF}]"
    x = f"regexp_replace({x}, '(?m)^{ws}+|{ws}+$', '', 'g')"
    return trim(f"regexp_replace({x}, '\\n{{3,}}', chr(10)||chr(10), 'g')")


def pct(x: str) -> str:
    return f"(floor(({x}) * 1000.0 + 0.5) / 10.0)"


def half_up(x: str, d: int) -> str:
    k = 10 ** d
    return f"(floor(({x}) * {k}.0 + 0.5) / {k}.0)"


def fold(x: str) -> str:
    return f"lower(translate(strip_accents({x}), '^`´¨·¸¯', ''))"


def norm_key(x: str) -> str:
    return f"regexp_replace(lower({x}), '[^a-z0-9]+', '', 'g')"


def upper_first(x: str) -> str:
    return f"(upper(substr({x}, 1, 1)) || substr({x}, 2))"


def camel(x: str) -> str:
    return f"regexp_replace({x}, '([a-z])([A-Z])', '\\1 \\2', 'g')"


def capped(x: str) -> str:
    return (f"(CASE WHEN length({x}) > 4000 THEN substr({x}, 1, 4000) || chr(10) || '…(truncated; ' || "
            f"CAST(length({x}) - 4000 AS VARCHAR) || ' chars elided)' ELSE {x} END)")


def mean(x: str) -> str:
    return f"(CAST(sum(CAST({x} AS DECIMAL(28,6))) AS DOUBLE) / count({x}))"


PROSE = r"""(length({x}) >= 80 AND regexp_matches({x}, '[\s\x{{A0}}]') AND NOT regexp_matches({x}, '(?i)^https?://\S+$')
  AND NOT regexp_matches({x}, '(?i)^[0-9a-f]{{8}}-[0-9a-f]{{4}}-[0-9a-f]{{4}}-[0-9a-f]{{4}}-[0-9a-f]{{12}}$')
  AND NOT regexp_matches({x}, '^[^\s@]+@[^\s@]+\.[^\s@]+$') AND NOT regexp_matches({x}, '(?s)^\s*[\[{{].*[\]}}]\s*$')
  AND length(regexp_replace({x}, '[\s\x0B\x{{A0}}]+', '', 'g')) > 0
  AND length(regexp_replace({x}, '[^\p{{L}}]+', '', 'g')) / length(regexp_replace({x}, '[\s\x0B\x{{A0}}]+', '', 'g')) >= 0.5)"""


def prose(x: str) -> str:
    return PROSE.format(x=x)


# Record sets built from the driver tables; the Spark twins are in tables.py.
CUSTOMERS = f"""cust AS (SELECT 'customers.csv' AS source_file, c_custkey + 1 AS source_row, CAST(c_custkey AS VARCHAR) AS id,
  c_name AS name, n_name AS country, c_mktsegment AS segment,
  CASE WHEN c_acctbal < 0 THEN 'N/A' ELSE {num('c_acctbal')} END AS balance
  FROM customer JOIN nation ON c_nationkey = n_nationkey)"""
ORDERS = f"""ord AS (SELECT 'orders.csv' AS source_file, o_orderkey + 1 AS source_row, 'ORD-' || o_orderkey AS code, n_name AS country,
  CAST(year(o_orderdate) AS VARCHAR) AS year, o_orderstatus AS status, {num('o_totalprice')} AS total,
  o_orderpriority AS priority FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"""
TURNS = """turns AS (SELECT q.conv_id || ':' || q.turn AS eval_id, q.text AS prompt, a.text AS answer, q.conv_id, q.turn, a.role AS answer_role
  FROM conversations q JOIN conversations a ON a.conv_id = q.conv_id AND a.turn = q.turn + 1)"""
