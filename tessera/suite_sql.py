"""DuckDB statements equal in result to the queries of ``suite``.

Written independently of the Spark plans (EXISTS / NOT EXISTS, scalar
subqueries, window functions) over the pre-registered table views, so a
match is evidence of correct semantics rather than of a shared formulation.
"""

from __future__ import annotations

# Fixed values, written out here so that a wrong entry of the engine shows:
# rule names in order, each with the parameters it needs ("a|b": one of them).
_RULES = """
    is_not_null column
    is_not_empty column
    is_not_null_and_not_empty column
    is_not_in_future column
    is_in_list column allowed
    is_not_null_and_is_in_list column allowed
    regex_match column regex
    is_equal_to column value
    is_not_equal_to column value
    is_valid_date column
    is_valid_timestamp column
    is_in_range column min_limit|max_limit
    is_not_in_range column min_limit|max_limit
    is_not_less_than column limit
    is_not_greater_than column limit
    sql_expression expression
    is_unique columns
    sql_query query merge_columns
    is_aggr_not_greater_than limit
    is_aggr_not_less_than limit
    is_aggr_equal limit
    is_aggr_not_equal limit
    foreign_key columns ref_table
    has_valid_schema expected_schema
    compare_datasets columns ref_table
"""
REQUIRED = {line.split()[0]: line.split()[1:] for line in _RULES.strip().split("\n")}
L = "TRWAGMYFPDXBNJZSQVHLCKE"
NAMES_26 = "[" + ", ".join(f"'{n}'" for n in [*REQUIRED, "no_such_rule"]) + "]"
NAMES_25 = "[" + ", ".join(f"'{n}'" for n in REQUIRED) + "]"


def _pk(*cols: str) -> str:
    if len(cols) == 1:
        return f"CAST({cols[0]} AS VARCHAR)"
    return " || '|' || ".join(
        f"coalesce(replace(replace(CAST({c} AS VARCHAR), '\\', '\\\\'), '|', '\\|'), '\\N')" for c in cols)


def _ev(vid_expr: str, pk: str, value: str, source: str, where: str) -> str:
    return f"SELECT {vid_expr} AS validation_id, {pk} AS table_pk, {value} AS failed_value FROM {source} WHERE {where}"


def _pv(pk: str, value: str, source: str, where: str) -> str:
    return f"SELECT {pk} AS table_pk, {value} AS failed_value FROM {source} WHERE {where}"


DOCS_LABELS = "(SELECT d.doc_id, l.quality, l.toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id) dl"
PART_BLANKED = ("(SELECT p_partkey, CASE WHEN p_size <= 3 THEN '' WHEN p_size <= 6 THEN NULL "
                "ELSE p_name END AS p_name_d FROM part) pb")
ORDERS_TXT = ("(SELECT o_orderkey, CASE WHEN o_orderpriority = '1-URGENT' THEN CAST(year(o_orderdate) AS VARCHAR) "
              "|| '-02-31' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS txt FROM orders) ot")
EVENTS_TXT = ("(SELECT event_id, CASE WHEN event_type = 'click' THEN strftime(ts, '%Y-%m-%d') || ' 25:' || "
              "strftime(ts, '%M:%S') ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END AS txt FROM events) et")
LI_PK = _pk("l_orderkey", "l_linenumber")

SNAPSHOT = ("(SELECT c_custkey, c_name, c_nationkey, CASE WHEN c_mktsegment = 'BUILDING' THEN c_acctbal + 2000 "
            "ELSE c_acctbal END AS c_acctbal, c_mktsegment FROM customer WHERE c_nationkey <> 0)")

IDS = f"""ids AS (
  SELECT c_custkey, CASE
    WHEN nat = 24 THEN NULL
    WHEN seg = 'BUILDING' AND nat < 8 THEN digits || substr('{L}', CAST((n + 1) % 23 + 1 AS INTEGER), 1)
    WHEN seg = 'MACHINERY' AND nat < 5 THEN substr(digits, 2, 7) || substr('{L}', CAST(n % 23 + 1 AS INTEGER), 1)
    WHEN seg = 'FURNITURE' AND nat < 6 THEN 'X' || substr(digits, 2, 7)
         || substr('{L}', CAST(CAST(substr(digits, 2, 7) AS INTEGER) % 23 + 1 AS INTEGER), 1)
    WHEN seg = 'AUTOMOBILE' AND nat < 4 THEN substr(digits, 1, 1) || 'B' || substr(digits, 3, 6)
         || substr('{L}', CAST(n % 23 + 1 AS INTEGER), 1)
    WHEN seg = 'HOUSEHOLD' AND nat < 5 THEN digits || lower(substr('{L}', CAST(n % 23 + 1 AS INTEGER), 1))
    WHEN seg = 'HOUSEHOLD' AND nat < 8 THEN substr(digits, 1, 4) || 'Y' || substr(digits, 6, 3)
         || substr('{L}', CAST(n % 23 + 1 AS INTEGER), 1)
    ELSE digits || substr('{L}', CAST(n % 23 + 1 AS INTEGER), 1) END AS dni
  FROM (SELECT c_custkey, c_mktsegment AS seg, c_nationkey AS nat, n, lpad(CAST(n AS VARCHAR), 8, '0') AS digits
        FROM (SELECT *, (c_custkey * 7919 + 12345) % 100000000 AS n FROM customer)))"""


def _customer_evidence(source: str) -> str:
    """Evidence of the four customer rules on a snapshot."""
    x = f"(SELECT *, CASE WHEN c_acctbal > 9000 THEN NULL ELSE 'ok' END AS bal_band FROM {source})"
    pk = _pk("c_custkey")
    return " UNION ALL ".join([
        _ev("'C_BAL'", pk, "CAST(c_acctbal AS VARCHAR)", x, "c_acctbal > 8000"),
        _ev("'C_NEG'", pk, "CAST(c_acctbal AS VARCHAR)", x, "c_acctbal < 0"),
        _ev("'C_SEG'", pk, "c_mktsegment", x,
            "c_mktsegment NOT IN ('MACHINERY', 'FURNITURE', 'HOUSEHOLD', 'AUTOMOBILE')"),
        _ev("'C_BAND'", pk, "bal_band", x, "bal_band IS NULL"),
    ])


PERSIST = f"""WITH prev AS ({_customer_evidence('customer')}),
cur AS ({_customer_evidence(SNAPSHOT)}) """
SAME = ("{a}.validation_id = {b}.validation_id AND {a}.table_pk IS NOT DISTINCT FROM {b}.table_pk "
        "AND {a}.failed_value IS NOT DISTINCT FROM {b}.failed_value")
NEW_SQL = f"SELECT DISTINCT validation_id, table_pk, failed_value FROM cur c WHERE NOT EXISTS (SELECT 1 FROM prev p WHERE {SAME.format(a='p', b='c')})"
RESOLVED_SQL = f"SELECT DISTINCT validation_id, table_pk, failed_value FROM prev p WHERE NOT EXISTS (SELECT 1 FROM cur c WHERE {SAME.format(a='p', b='c')})"
PERSISTENT_SQL = f"SELECT DISTINCT validation_id, table_pk, failed_value FROM cur c WHERE EXISTS (SELECT 1 FROM prev p WHERE {SAME.format(a='p', b='c')})"


def _sha(*parts: str) -> str:
    marked = [f"coalesce(replace(replace({p}, '\\', '\\\\'), '#', '\\#'), '\\N')" for p in parts]
    return "sha256(concat_ws('#', " + ", ".join(marked) + "))"


def _comma_list(x: str) -> str:
    return f"list_filter(list_transform(string_split({x}, ','), lambda t: trim(t)), lambda t: t <> '')"


def _num_or_text(key: str, x: str) -> str:
    return (f"CASE WHEN {x} = '' THEN NULL WHEN TRY_CAST({x} AS DOUBLE) IS NOT NULL "
            f"THEN '\"{key}\":' || to_json(TRY_CAST({x} AS DOUBLE)) ELSE '\"{key}\":' || to_json({x}) END")


def _frag(key: str, value: str, cond: str) -> str:
    return f"CASE WHEN {cond} THEN '\"{key}\":' || to_json({value}) END"


BUILD_DEFINITION = f"""
WITH sh AS (
  SELECT 'V' || CAST(p_partkey AS VARCHAR) AS validation_id,
    ({NAMES_26})[CAST((p_size - 1) % 26 + 1 AS INTEGER)] AS tn,
    upper(trim(CASE WHEN p_type = 'PROMO' THEN 'CUSTOM' WHEN p_type = 'SMALL' AND p_size > 40 THEN 'other'
                    ELSE 'BUILT-IN' END)) AS rt,
    CASE WHEN p_type = 'STANDARD' THEN ' p_name, p_brand ,, ' WHEN p_type = 'ECONOMY' THEN '' ELSE 'p_name' END AS cols,
    CASE WHEN p_size % 3 = 0 THEN '' WHEN p_size % 3 = 1 THEN p_brand ELSE CAST(p_retailprice AS VARCHAR) END AS val,
    CASE WHEN p_size > 25 THEN CAST(p_size AS VARCHAR) WHEN p_size > 10 THEN 'abc' ELSE '' END AS vmin,
    CASE WHEN p_size < 30 THEN CAST(p_size * 10 AS VARCHAR) ELSE '' END AS vmax,
    replace(p_name, ' ', ', ') || ', , ' AS vset,
    'p_size > ' || CAST(p_size AS VARCHAR) AS expr,
    'SELECT p_partkey FROM part WHERE p_size = ' || CAST(p_size AS VARCHAR) AS query,
    CASE WHEN p_size % 2 = 0 THEN 'p_partkey' ELSE '' END AS merge
  FROM part),
l AS (SELECT *, {_comma_list('cols')} AS col_list, {_comma_list('vset')} AS set_list,
             {_comma_list('merge')} AS merge_list FROM sh),
f AS (SELECT validation_id, tn, rt,
    {_frag('column', 'col_list[1]', 'len(col_list) > 0')} AS f_first,
    {_frag('columns', 'col_list', 'len(col_list) > 0')} AS f_cols,
    {_frag('column', 'trim(cols)', "trim(cols) <> ''")} AS f_col,
    {_frag('allowed', 'set_list', 'len(set_list) > 0')} AS f_allowed,
    {_frag('regex', 'val', "val <> ''")} AS f_regex,
    {_frag('value', 'val', "val <> ''")} AS f_value,
    {_frag('date_format', 'val', "val <> ''")} AS f_date_format,
    {_frag('timestamp_format', 'val', "val <> ''")} AS f_ts_format,
    {_num_or_text('min_limit', 'vmin')} AS f_min_limit,
    {_num_or_text('max_limit', 'vmax')} AS f_max_limit,
    {_num_or_text('limit', 'vmin')} AS f_limit_min,
    {_num_or_text('limit', 'vmax')} AS f_limit_max,
    {_num_or_text('limit', 'val')} AS f_limit_val,
    {_frag('expression', 'expr', "expr <> ''")} AS f_expression,
    {_frag('aggr_type', 'expr', "expr <> ''")} AS f_aggr,
    {_frag('query', 'query', "query <> ''")} AS f_query,
    {_frag('merge_columns', 'merge_list', 'len(merge_list) > 0')} AS f_merge,
    {_frag('ref_columns', 'merge_list', 'len(merge_list) > 0')} AS f_ref_cols,
    {_frag('ref_table', 'val', "val <> ''")} AS f_ref_table,
    {_frag('row_filter', 'expr', "expr <> ''")} AS f_row_filter,
    {_frag('expected_schema', 'cols', "cols <> ''")} AS f_schema
  FROM l)
SELECT validation_id, '{{' || (CASE
  WHEN rt = 'BUILT-IN' THEN CASE
    WHEN tn IN ('is_not_null', 'is_not_empty', 'is_not_null_and_not_empty', 'is_not_in_future')
      THEN concat_ws(',', f_first)
    WHEN tn = 'is_unique' THEN concat_ws(',', f_cols)
    WHEN tn IN ('is_in_list', 'is_not_null_and_is_in_list') THEN concat_ws(',', f_col, f_allowed)
    WHEN tn = 'regex_match' THEN concat_ws(',', f_col, f_regex)
    WHEN tn IN ('is_equal_to', 'is_not_equal_to') THEN concat_ws(',', f_col, f_value)
    WHEN tn = 'is_valid_date' THEN concat_ws(',', f_col, f_date_format)
    WHEN tn = 'is_valid_timestamp' THEN concat_ws(',', f_col, f_ts_format)
    WHEN tn IN ('is_in_range', 'is_not_in_range') THEN concat_ws(',', f_col, f_min_limit, f_max_limit)
    WHEN tn = 'is_not_less_than' THEN concat_ws(',', f_col, f_limit_min)
    WHEN tn = 'is_not_greater_than' THEN concat_ws(',', f_col, f_limit_max)
    WHEN tn = 'sql_expression' THEN concat_ws(',', f_expression)
    WHEN tn = 'sql_query' THEN concat_ws(',', f_query, f_merge)
    WHEN tn IN ('is_aggr_not_greater_than', 'is_aggr_not_less_than', 'is_aggr_equal', 'is_aggr_not_equal')
      THEN concat_ws(',', f_first, f_aggr, f_limit_val)
    WHEN tn IN ('foreign_key', 'compare_datasets') THEN concat_ws(',', f_cols, f_ref_cols, f_ref_table, f_row_filter)
    WHEN tn = 'has_valid_schema' THEN concat_ws(',', f_schema)
    ELSE '' END
  WHEN rt = 'CUSTOM' THEN concat_ws(',', f_cols)
  ELSE '' END) || '}}' AS validation_definition
FROM f"""

def _problems_sql() -> str:
    checks = []
    for rule, groups in REQUIRED.items():
        for group in groups:
            absent = " AND ".join(f"json_extract(def, '$.{k}') IS NULL" for k in group.split("|"))
            checks.append(f"CASE WHEN tn = '{rule}' AND {absent} THEN 'missing {group}' END")
    builtins = ", ".join(f"'{r}'" for r in REQUIRED)
    return f"""WITH d AS ({BUILD_DEFINITION}),
lib AS (SELECT 'R' || CAST(n_nationkey AS VARCHAR) AS rule_id, ({NAMES_25})[n_nationkey + 1] AS tn,
               'BUILT-IN' AS impl FROM nation),
v AS (SELECT 'V' || CAST(p_partkey AS VARCHAR) AS validation_id, 'R' || CAST(p_size - 1 AS VARCHAR) AS rule_id FROM part),
p AS (SELECT v.validation_id, lib.tn, lib.impl, d.validation_definition AS def
      FROM v JOIN d ON d.validation_id = v.validation_id LEFT JOIN lib ON lib.rule_id = v.rule_id)
SELECT validation_id, problem FROM (
  SELECT validation_id, CASE
    WHEN tn IS NULL THEN 'unknown rule id'
    WHEN impl = 'CUSTOM' AND json_extract(def, '$.columns') IS NULL THEN 'missing columns'
    WHEN impl = 'BUILT-IN' AND tn NOT IN ({builtins}) THEN 'unknown rule'
    WHEN impl = 'BUILT-IN' THEN concat_ws('; ', {', '.join(checks)})
    ELSE '' END AS problem FROM p)
WHERE problem <> ''"""


SHEET_ACTIVE = "CASE WHEN p_size > 10 THEN true WHEN p_size > 5 THEN false ELSE NULL END"

TABLES_T = ("SELECT CAST(s_suppkey AS VARCHAR) AS table_id, s_name AS table_name, s_name AS table_name_tech, "
            "CAST(s_nationkey AS VARCHAR) AS domain, 's_suppkey' AS primary_key, 'stg_' || s_name AS staging FROM supplier")
TABLES_S = ("SELECT CAST(s_suppkey AS VARCHAR) AS table_id, s_name AS table_name, s_name AS table_name_tech, "
            "CASE WHEN s_acctbal < 0 THEN 'negative' ELSE CAST(s_nationkey AS VARCHAR) END AS domain, "
            "'s_suppkey' AS primary_key, 'stg_' || s_name AS staging FROM supplier WHERE s_nationkey <> 0 "
            "UNION ALL SELECT CAST(s_suppkey + 1000000 AS VARCHAR), s_name, s_name, CAST(s_nationkey AS VARCHAR), "
            "'s_suppkey', 'stg_' || s_name FROM supplier WHERE s_nationkey = 1")

STAGED_ORDERS = ("SELECT 'exec-' || substr(o_orderpriority, 1, 1) AS execution_id, 'V_PRIO' AS validation_id, "
                 "CAST(o_orderkey AS VARCHAR) AS table_pk, o_orderpriority AS failed_value FROM orders "
                 "WHERE o_orderpriority NOT IN ('1-URGENT', '2-HIGH')")
STAGED_LINEITEM = (f"SELECT 'exec-' || l_linestatus AS execution_id, 'V_LSTAT' AS validation_id, {LI_PK} AS table_pk, "
                   "l_linestatus AS failed_value FROM lineitem WHERE l_linestatus NOT IN ('O')")

EXECUTIONS = ("SELECT CAST(o_orderkey AS VARCHAR) AS execution_id, CAST(o_custkey AS VARCHAR) AS table_id, "
              "o_orderdate AS execution_timestamp FROM orders WHERE o_orderstatus IN ('F', 'O')")


def _status(f: str) -> str:
    return f"CASE WHEN {f} > 0 THEN 'FAILED' ELSE 'PASSED' END"


SQL = {
    "row_rules_single_pass": " UNION ALL ".join([
        _ev("'E1'", "CAST(event_id AS VARCHAR)", "CAST(value AS VARCHAR)", "events", "value < 1 OR value > 300"),
        _ev("'E2'", "CAST(event_id AS VARCHAR)", "event_type", "events",
            "event_type NOT IN ('view', 'click', 'purchase')"),
        _ev("'E3'", "CAST(event_id AS VARCHAR)", "props", "events",
            "NOT regexp_matches(props, '^\\{\"k\": [0-9]{1,2}\\}$')"),
    ]),
    "is_not_null": _pv(_pk("doc_id"), "CAST(quality AS VARCHAR)", DOCS_LABELS, "quality IS NULL"),
    "is_not_empty": _pv(_pk("p_partkey"), "p_name_d", PART_BLANKED, "p_name_d = ''"),
    "is_not_null_and_not_empty": _pv(_pk("p_partkey"), "p_name_d", PART_BLANKED, "p_name_d IS NULL OR p_name_d = ''"),
    "is_not_in_future": _pv(_pk("o_orderkey"), "CAST(o_orderdate AS VARCHAR)", "orders",
                            "o_orderdate > TIMESTAMP '2001-01-01 00:00:00'"),
    "is_in_list": _pv(_pk("o_orderkey"), "o_orderstatus", "orders", "o_orderstatus NOT IN ('F', 'O')"),
    "is_not_null_and_is_in_list": _pv(_pk("doc_id"), "CAST(toxic AS VARCHAR)", DOCS_LABELS,
                                      "toxic IS NULL OR toxic <> 0"),
    "regex_match": _pv(_pk("p_partkey"), "p_brand", "part", "NOT regexp_matches(p_brand, '^Brand#[0-9]$')"),
    "is_equal_to": _pv(_pk("c_custkey"), "c_mktsegment", "customer", "c_mktsegment <> 'BUILDING'"),
    "is_not_equal_to": _pv(_pk("event_id"), "event_type", "events", "event_type = 'error'"),
    "is_valid_date": _pv(_pk("o_orderkey"), "txt", ORDERS_TXT, "txt IS NOT NULL AND TRY_CAST(txt AS DATE) IS NULL"),
    "is_valid_timestamp": _pv(_pk("event_id"), "txt", EVENTS_TXT,
                              "txt IS NOT NULL AND try_strptime(txt, '%Y-%m-%d %H:%M:%S') IS NULL"),
    "is_in_range": _pv(_pk("event_id"), "CAST(value AS VARCHAR)", "events", "value < 1 OR value > 300"),
    "is_not_in_range": _pv(_pk("p_partkey"), "CAST(p_size AS VARCHAR)", "part", "p_size >= 10 AND p_size <= 20"),
    "is_not_less_than": _pv(_pk("c_custkey"), "CAST(c_acctbal AS VARCHAR)", "customer", "c_acctbal < 0"),
    "is_not_greater_than": _pv(_pk("o_orderkey"), "CAST(o_totalprice AS VARCHAR)", "orders", "o_totalprice > 450000"),
    "sql_expression": _pv(LI_PK, LI_PK, "lineitem JOIN orders ON l_orderkey = o_orderkey",
                          "NOT (l_shipdate >= o_orderdate)"),
    "is_unique": _pv(_pk("doc_id"), "text", "documents d",
                     "EXISTS (SELECT 1 FROM documents e WHERE e.text = d.text AND e.doc_id <> d.doc_id)"),
    "is_unique_composite": _pv(LI_PK, "CAST(l_orderkey AS VARCHAR)", "lineitem",
                               "(l_orderkey, l_linenumber) IN (SELECT (l_orderkey, l_linenumber) FROM lineitem "
                               "GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)"),
    "sql_query": _pv(_pk("c_custkey"), _pk("c_custkey"), "customer",
                     "c_custkey IN (SELECT o_custkey FROM orders GROUP BY o_custkey HAVING count(*) > 15)"),
    "is_aggr_not_greater_than": _pv(_pk("o_orderkey"), "CAST(o_totalprice AS VARCHAR)", "orders",
                                    "o_orderstatus = 'F' AND (SELECT max(o_totalprice) FROM orders "
                                    "WHERE o_orderstatus = 'F') > 450000"),
    "is_aggr_not_less_than": _pv(_pk("event_id"), _pk("event_id"), "events",
                                 "event_type = 'purchase' AND (SELECT count(event_id) FROM events "
                                 "WHERE event_type = 'purchase') < 100000000"),
    "is_aggr_equal": _pv(_pk("c_custkey"), "CAST(c_acctbal AS VARCHAR)", "customer",
                         "(SELECT avg(c_acctbal) FROM customer) <> 4500"),
    "is_aggr_not_equal": _pv(_pk("c_custkey"), "c_mktsegment", "customer",
                             "(SELECT count(DISTINCT c_mktsegment) FROM customer) = 5"),
    "is_aggr_passing": _pv(LI_PK, "CAST(l_linenumber AS VARCHAR)", "lineitem",
                           "(SELECT min(l_linenumber) FROM lineitem) <> 1"),
    "foreign_key": _pv(_pk("o_orderkey"), "CAST(o_custkey AS VARCHAR)", "orders o",
                       "o_orderstatus <> 'P' AND o_custkey IS NOT NULL AND NOT EXISTS (SELECT 1 FROM customer c "
                       "WHERE c.c_mktsegment <> 'BUILDING' AND c.c_custkey = o.o_custkey)"),
    "foreign_key_labels": _pv(_pk("doc_id"), _pk("doc_id"), "documents d",
                              "NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)"),
    "has_valid_schema": _pv(_pk("event_id"), _pk("event_id"), "events", "true"),
    "has_valid_schema_passing": _pv(_pk("event_id"), _pk("event_id"), "events", "false"),
    "compare_datasets": _pv(_pk("c_custkey"), _pk("c_custkey"), "customer c",
                            f"NOT EXISTS (SELECT 1 FROM {SNAPSHOT} s WHERE s.c_custkey = c.c_custkey "
                            "AND s.c_name IS NOT DISTINCT FROM c.c_name AND s.c_nationkey IS NOT DISTINCT FROM "
                            "c.c_nationkey AND s.c_acctbal IS NOT DISTINCT FROM c.c_acctbal AND s.c_mktsegment "
                            "IS NOT DISTINCT FROM c.c_mktsegment)"),
    "national_id_strict": f"""WITH {IDS},
chk AS (SELECT c_custkey, dni, upper(trim(dni)) AS s FROM ids),
chk2 AS (SELECT *, CASE substr(s, 1, 1) WHEN 'X' THEN '0' WHEN 'Y' THEN '1' WHEN 'Z' THEN '2'
                    ELSE substr(s, 1, 1) END || substr(s, 2, 7) AS d, substr(s, 9, 1) AS letter FROM chk)
SELECT CAST(c_custkey AS VARCHAR) AS table_pk, dni AS failed_value FROM chk2
WHERE NOT coalesce(dni IS NOT NULL AND length(s) = 9 AND regexp_full_match(d, '[0-9]{{8}}')
      AND regexp_full_match(letter, '\\p{{L}}')
      AND substr('{L}', CAST(TRY_CAST(d AS BIGINT) % 23 + 1 AS INTEGER), 1) = letter, false)""",
    "national_id_sql": f"""WITH {IDS},
t AS (SELECT c_custkey, dni, trim(dni) AS t FROM ids)
SELECT CAST(c_custkey AS VARCHAR) AS table_pk, dni AS failed_value FROM t
WHERE (CASE WHEN dni IS NULL OR length(t) <> 9 THEN false
       ELSE substr('{L}', CAST(TRY_CAST(replace(replace(replace(upper(substr(t, 1, 8)), 'X', '0'), 'Y', '1'), 'Z', '2')
                   AS INTEGER) % 23 + 1 AS INTEGER), 1) = upper(substr(t, 9, 1)) END) = false""",
    "custom_sql_fn": _pv(_pk("c_custkey"), "c_mktsegment", "customer",
                         "NOT (CASE WHEN c_mktsegment = 'BUILDING' THEN c_acctbal < 9000 ELSE c_acctbal > -500 END)"),
    "perimeter_filter": _pv(_pk("o_orderkey"), "CAST(o_totalprice AS VARCHAR)", "orders",
                            "o_orderpriority = '1-URGENT' AND (o_totalprice < 5000 OR o_totalprice > 400000)"),
    "build_definition": BUILD_DEFINITION,
    "split_tags": """SELECT p_partkey, array_to_string(l, '|') AS tags, CAST(len(l) AS INTEGER) AS n_tags FROM (
  SELECT p_partkey, list_filter(regexp_split_to_array(p_type || ',  ' || p_brand || ',,' || p_name || ', ', ',\\s*'),
                                lambda x: x <> '') AS l FROM part)""",
    "sync_reflect": f"""WITH t AS ({TABLES_T}), s AS ({TABLES_S})
SELECT coalesce(t.table_id, s.table_id) AS table_id,
  CASE WHEN t.table_id IS NULL THEN 'INSERT' WHEN s.table_id IS NULL THEN 'DELETE'
       WHEN t.table_name IS NOT DISTINCT FROM s.table_name AND t.table_name_tech IS NOT DISTINCT FROM s.table_name_tech
        AND t.domain IS NOT DISTINCT FROM s.domain AND t.primary_key IS NOT DISTINCT FROM s.primary_key
        AND t.staging IS NOT DISTINCT FROM s.staging THEN 'UNCHANGED' ELSE 'UPDATE' END AS action
FROM t FULL OUTER JOIN s ON t.table_id = s.table_id""",
    "select_active_validations": """SELECT 'V' || CAST(p_partkey AS VARCHAR) AS validation_id,
  'R' || CAST(p_size - 1 AS VARCHAR) AS rule_id, 'critical' AS severity
FROM part WHERE p_type = 'STANDARD' AND p_size > 10 AND p_size > 30""",
    "validation_plan": f"""SELECT 'V' || CAST(p_partkey AS VARCHAR) AS validation_id, 'R' || CAST(p_size - 1 AS VARCHAR) AS rule_id,
  r.technical_rule_name, r.rule_level
FROM part LEFT JOIN (SELECT 'R' || CAST(n_nationkey AS VARCHAR) AS rule_id,
                            ({NAMES_25})[n_nationkey + 1] AS technical_rule_name,
                            CASE WHEN n_nationkey < 16 THEN 'ROW' ELSE 'DATASET' END AS rule_level FROM nation) r
  ON r.rule_id = 'R' || CAST(p_size - 1 AS VARCHAR)""",
    "config_problems": _problems_sql(),
    "merge_update": """WITH u AS (SELECT CAST(l_orderkey AS VARCHAR) AS execution_id, CAST(count(*) AS INTEGER) AS ve,
                  CAST(count_if(l_linestatus = 'F') AS INTEGER) AS vf
           FROM lineitem WHERE l_returnflag = 'R' GROUP BY l_orderkey)
SELECT CAST(o_orderkey AS VARCHAR) AS execution_id, CAST(o_custkey AS VARCHAR) AS table_id,
  CASE WHEN u.execution_id IS NOT NULL THEN 'FAILED' ELSE 'START' END AS status,
  u.ve AS validations_executed, u.vf AS validations_failed
FROM orders LEFT JOIN u ON u.execution_id = CAST(o_orderkey AS VARCHAR)""",
    "merge_upsert": """WITH t AS (SELECT CAST(c_custkey AS VARCHAR) AS validation_id, 'FAILED' AS status,
                  CAST(c_nationkey AS BIGINT) AS nf, CAST(0 AS BIGINT) AS pf, CAST(0 AS BIGINT) AS rf
           FROM customer WHERE c_mktsegment <> 'BUILDING'),
s AS (SELECT CAST(o_custkey AS VARCHAR) AS validation_id, count(*) AS nf,
             CAST(count_if(o_orderpriority = '1-URGENT') AS BIGINT) AS pf, CAST(0 AS BIGINT) AS rf
      FROM orders WHERE o_orderstatus = 'O' GROUP BY o_custkey)
SELECT coalesce(t.validation_id, s.validation_id) AS validation_id, t.status,
  CASE WHEN s.validation_id IS NOT NULL THEN s.nf ELSE t.nf END AS new_failures,
  CASE WHEN s.validation_id IS NOT NULL THEN s.pf ELSE t.pf END AS persistent_failures,
  CASE WHEN s.validation_id IS NOT NULL THEN s.rf ELSE t.rf END AS resolved_failures
FROM t FULL OUTER JOIN s ON t.validation_id = s.validation_id""",
    "conditional_update": f"""SELECT {LI_PK} AS table_pk, CAST(year(l_shipdate) AS VARCHAR) AS execution_id,
  CASE WHEN CAST(year(l_shipdate) AS VARCHAR) = '1998' THEN false ELSE l_returnflag = 'R' END AS is_new_failure
FROM lineitem""",
    "evidence_projection": f"""SELECT {_sha("'exec-0001'", "'V_PRICE'", 'CAST(o_orderkey AS VARCHAR)', 'CAST(o_totalprice AS VARCHAR)')} AS evidence_id,
  'exec-0001' AS execution_id, 'V_PRICE' AS validation_id, CAST(o_totalprice AS VARCHAR) AS failed_value,
  CAST(o_orderkey AS VARCHAR) AS table_pk, DATE '2024-01-01' AS execution_date
FROM orders WHERE o_totalprice > 450000""",
    "validation_results": f"""WITH c AS (
  SELECT count(*) AS n, CAST(count_if(l_discount < 0 OR l_discount > 0.08) AS BIGINT) AS f1,
    CAST(count_if(l_linestatus = 'F') AS BIGINT) AS p2,
    CAST(count_if(l_linestatus = 'F' AND l_returnflag NOT IN ('A', 'N')) AS BIGINT) AS f2,
    CAST(count_if(NOT (l_tax <= 0.07)) AS BIGINT) AS f3,
    CAST(count_if(l_returnflag = 'R') AS BIGINT) AS p8, avg(l_quantity) FILTER (WHERE l_returnflag = 'R') AS a8
  FROM lineitem),
d AS (SELECT count(*) AS f4 FROM lineitem WHERE (l_orderkey, l_linenumber) IN (
        SELECT (l_orderkey, l_linenumber) FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)),
k AS (SELECT count(*) AS f5 FROM lineitem l WHERE NOT EXISTS (SELECT 1 FROM part p WHERE p.p_partkey = l.l_partkey))
SELECT 'L1' AS validation_id, {_status('f1')} AS status, n AS perimeter, f1 AS failed_records_count FROM c
UNION ALL SELECT 'L2', {_status('f2')}, p2, f2 FROM c
UNION ALL SELECT 'L3', {_status('f3')}, n, f3 FROM c
UNION ALL SELECT 'L4', {_status('f4')}, n, f4 FROM c, d
UNION ALL SELECT 'L5', {_status('f5')}, n, f5 FROM c, k
UNION ALL SELECT 'L6', 'ERROR', n, CAST(0 AS BIGINT) FROM c
UNION ALL SELECT 'L7', 'ERROR', CAST(0 AS BIGINT), CAST(0 AS BIGINT)
UNION ALL SELECT 'L8', CASE WHEN a8 > 20 AND p8 > 0 THEN 'FAILED' ELSE 'PASSED' END, p8,
                 CASE WHEN a8 > 20 THEN p8 ELSE CAST(0 AS BIGINT) END FROM c""",
    "execution_summary": """WITH o AS (
  SELECT (count_if(o_orderstatus NOT IN ('F', 'O', 'P')) > 0)::INT + (count_if(o_totalprice > 450000) > 0)::INT
         + ((SELECT count(*) FROM (SELECT o_orderkey FROM orders GROUP BY o_orderkey HAVING count(*) > 1)) > 0)::INT
         AS failed FROM orders),
c AS (SELECT (count_if(c_acctbal < 0) > 0)::INT
             + (count_if(NOT regexp_matches(c_name, '^Customer#[0-9]{9}$')) > 0)::INT AS failed FROM customer),
p AS (SELECT (count_if(p_size < 1 OR p_size > 50) > 0)::INT
             + (count_if(NOT regexp_matches(p_brand, '^Brand#[0-9]$')) > 0)::INT AS failed FROM part),
t AS (SELECT 'orders' AS table_id, 3 AS ex, failed, 0 AS err FROM o
      UNION ALL SELECT 'customer', 3, failed, 1 FROM c
      UNION ALL SELECT 'part', 2, failed, 0 FROM p)
SELECT table_id, CAST(ex AS BIGINT) AS validations_executed, CAST(failed AS BIGINT) AS validations_failed,
  CAST(err AS BIGINT) AS validations_errors,
  CASE WHEN failed + err > 0 THEN 'FAILED' ELSE 'SUCCESS' END AS status FROM t""",
    "new_failures": PERSIST + NEW_SQL,
    "resolved_failures": PERSIST + RESOLVED_SQL,
    "persistent_failures": PERSIST + PERSISTENT_SQL,
    "persistence_summary": PERSIST + f""", n AS ({NEW_SQL}), r AS ({RESOLVED_SQL}), p AS ({PERSISTENT_SQL}),
v AS (SELECT validation_id FROM cur UNION SELECT validation_id FROM prev)
SELECT v.validation_id,
  (SELECT count(*) FROM n WHERE n.validation_id = v.validation_id) AS new_failures,
  (SELECT count(*) FROM p WHERE p.validation_id = v.validation_id) AS persistent_failures,
  (SELECT count(*) FROM r WHERE r.validation_id = v.validation_id) AS resolved_failures
FROM v""",
    "evidence_flags": PERSIST + f"""SELECT DISTINCT {_sha("'exec-cur'", 'c.validation_id', 'c.table_pk', 'c.failed_value')} AS evidence_id,
  c.validation_id, c.table_pk, c.failed_value,
  NOT EXISTS (SELECT 1 FROM prev p WHERE {SAME.format(a='p', b='c')}) AS is_new_failure
FROM cur c""",
    "first_run_counts": PERSIST + """SELECT 'exec-cur' AS execution_id, validation_id, count(*) AS new_failures,
  CAST(0 AS BIGINT) AS persistent_failures, CAST(0 AS BIGINT) AS resolved_failures FROM cur GROUP BY validation_id""",
    "unify_evidences": f"""WITH so AS ({STAGED_ORDERS}), sl AS ({STAGED_LINEITEM}),
st AS (SELECT * FROM so UNION ALL SELECT * FROM sl)
SELECT DISTINCT execution_id, validation_id, table_pk, failed_value FROM st
WHERE execution_id NOT IN (SELECT execution_id FROM so WHERE execution_id = 'exec-3')""",
    "dedup_evidences": f"""SELECT DISTINCT {_sha('execution_id', 'validation_id', 'table_pk', 'failed_value')} AS evidence_id,
  execution_id, validation_id, table_pk, failed_value FROM ({STAGED_LINEITEM})""",
    "previous_execution": f"""SELECT table_id, execution_id,
  lag(execution_id) OVER (PARTITION BY table_id ORDER BY execution_timestamp, execution_id) AS prev_execution_id
FROM ({EXECUTIONS})""",
    "latest_execution": f"""SELECT table_id, execution_id, execution_timestamp FROM (
  SELECT table_id, execution_id, max(execution_timestamp) OVER (PARTITION BY table_id) AS execution_timestamp,
    row_number() OVER (PARTITION BY table_id ORDER BY execution_timestamp DESC, execution_id DESC) AS rn
  FROM ({EXECUTIONS})) WHERE rn = 1""",
}
