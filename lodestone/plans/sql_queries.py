"""Queries in the engine's SQL dialect with their DuckDB counterparts: name -> (dialect text, parameters, oracle or None for the same text)."""

from __future__ import annotations

Q = dict[str, tuple[str, dict | None, str | None]]

SINGLE: Q = {
    "scan_full": ("SELECT * FROM nation", None, None),
    "scan_project": ("SELECT p_partkey, p_name, p_retailprice FROM part", None, None),
    "scan_filter_num": ("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity > 45 AND l_discount <= 0.02", None, None),
    "scan_filter_str": ("SELECT c_custkey, c_name FROM customer WHERE c_mktsegment = 'BUILDING'", None, None),
    "filter_negative_literal": ("SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal < -500", None, None),
    "filter_text_range": ("SELECT p_partkey, p_brand FROM part WHERE p_brand >= 'Brand#3' AND p_brand <> 'Brand#45'", None, None),
    "filter_between": ("SELECT p_partkey, p_size FROM part WHERE p_size BETWEEN 10 AND 20", None, None),
    "filter_not_between": ("SELECT p_partkey, p_size FROM part WHERE p_size NOT BETWEEN 10 AND 20", None, None),
    "filter_in": ("SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderstatus IN ('F', 'P')", None, None),
    "filter_not_in": ("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus NOT IN ('F', 'P')", None, None),
    "filter_column_column": ("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_discount > l_tax", None, None),
    "logic_tree": ("SELECT p_partkey FROM part WHERE (p_size < 5 OR p_size > 45) AND NOT (p_brand = 'Brand#11' OR p_retailprice > 1500)", None, None),
    "like_prefix": ("SELECT p_partkey, p_name FROM part WHERE p_name LIKE 'a%'", None, None),
    "like_suffix": ("SELECT p_partkey, p_type FROM part WHERE p_type LIKE '%L'", None, None),
    "like_contains": ("SELECT p_partkey, p_name FROM part WHERE p_name LIKE '%re%'", None, None),
    "like_general": ("SELECT p_partkey, p_brand FROM part WHERE p_brand LIKE 'B_a%1'", None, None),
    "not_like": ("SELECT p_partkey, p_brand FROM part WHERE p_brand NOT LIKE 'Brand#1%'", None, None),
    "case_sensitive_like": ("SELECT count(*) AS n FROM part WHERE p_brand LIKE 'brand%'", None, "SELECT CAST(count(*) AS BIGINT) AS n FROM part WHERE p_brand LIKE 'brand%'"),
    "param_filter": ("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > $low AND o_orderstatus = $s", {"low": 200000.0, "s": "O"}, "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 200000.0 AND o_orderstatus = 'O'"),
    "quoted_names": ('SELECT [c_custkey] AS "key no", "c_name" FROM customer WHERE `c_nationkey` = 3', None, 'SELECT c_custkey AS "key no", c_name FROM customer WHERE c_nationkey = 3'),
    "quote_escape": ("SELECT n_name, 'it''s' AS txt FROM nation", None, None),
    "hint_direct": ("DIRECT SELECT n_name FROM nation WHERE n_regionkey = 1", None, "SELECT n_name FROM nation WHERE n_regionkey = 1"),
    "hint_cached": ("CACHED SELECT n_name FROM nation WHERE n_regionkey = 2", None, "SELECT n_name FROM nation WHERE n_regionkey = 2"),
    "hint_jit": ("JIT SELECT n_name FROM nation WHERE n_regionkey = 3", None, "SELECT n_name FROM nation WHERE n_regionkey = 3"),
    "record_id": ("SELECT * FROM customer:7", None, "SELECT * FROM customer WHERE c_custkey = 7"),
    "alias_qualified": ("SELECT c.c_custkey AS id, c.c_name AS label FROM customer AS c WHERE c.c_nationkey = 5", None, None),
    "cast_types": ("SELECT l_orderkey, l_linenumber, CAST(l_quantity AS INT) AS q, CAST(l_orderkey AS STRING) AS k FROM lineitem WHERE l_linenumber = 1", None, "SELECT l_orderkey, l_linenumber, CAST(l_quantity AS INT) AS q, CAST(l_orderkey AS VARCHAR) AS k FROM lineitem WHERE l_linenumber = 1"),
    "match_all_words": ("SELECT doc_id FROM documents WHERE text @@ 'the that'", None, "SELECT doc_id FROM documents WHERE list_contains(regexp_split_to_array(lower(text), '[^a-z0-9_]+'), 'the') AND list_contains(regexp_split_to_array(lower(text), '[^a-z0-9_]+'), 'that')"),
    "match_any_word": ("SELECT doc_id FROM documents WHERE text @OR@ 'idiot clown'", None, "SELECT doc_id FROM documents WHERE list_has_any(regexp_split_to_array(lower(text), '[^a-z0-9_]+'), ['idiot', 'clown'])"),
    "case_when": ("SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity > 40 THEN 'high' WHEN l_quantity > 20 THEN 'mid' ELSE 'low' END AS band FROM lineitem", None, None),
    "case_nested": ("SELECT p_partkey, CASE WHEN p_size > 25 THEN CASE WHEN p_retailprice > 1000 THEN 'big dear' ELSE 'big' END ELSE 'small' END AS label FROM part", None, None),
    "case_arith_div0": (
        "SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN 0 ELSE 100 DIV (p_size % 5) END AS q, -p_size + 2 * 3 AS m FROM part", None,
        "SELECT p_partkey, CAST(CASE WHEN p_size % 5 = 0 THEN 0 ELSE 100 // (p_size % 5) END AS BIGINT) AS q, -p_size + 2 * 3 AS m FROM part"),
    "not_three_valued": ("SELECT c_custkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 400000 WHERE NOT (o_totalprice > 450000)", None, None),
    "is_null_after_left_join": ("SELECT c_custkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 300000 WHERE o_orderkey IS NULL", None, None),
    "is_not_null": ("SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 300000 WHERE o_orderkey IS NOT NULL", None, None),
    "tsql_top": ("SELECT TOP 10 o_orderkey, o_totalprice FROM orders WITH (NOLOCK) WHERE o_orderstatus = N'F' ORDER BY o_totalprice DESC, o_orderkey", None, "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' ORDER BY o_totalprice DESC, o_orderkey LIMIT 10"),
    "tsql_fetch": ("SELECT o_orderkey FROM orders WHERE o_custkey < @c ORDER BY o_orderkey OFFSET 5 ROWS FETCH NEXT 7 ROWS ONLY", {"c": 50}, "SELECT o_orderkey FROM orders WHERE o_custkey < 50 ORDER BY o_orderkey LIMIT 7 OFFSET 5"),
    "json_field": ("SELECT event_id, CAST(get_json_object(props, '$.k') AS BIGINT) AS k FROM events", None, "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events"),
}

AGGREGATE: Q = {
    "agg_global": ("SELECT count(*) AS n, count(o_orderkey) AS k, round(sum(o_totalprice), 2) AS total, round(avg(o_totalprice), 4) AS mean, min(o_orderdate) AS lo, max(o_orderdate) AS hi FROM orders", None, None),
    "agg_group": ("SELECT l_returnflag, l_linestatus, count(*) AS cnt, sum(l_quantity) AS qty, round(avg(l_discount), 6) AS disc FROM lineitem WHERE l_quantity > 10 GROUP BY l_returnflag, l_linestatus ORDER BY l_returnflag, l_linestatus", None, None),
    "agg_having": ("SELECT c_nationkey, count(*) AS n, round(avg(c_acctbal), 4) AS bal FROM customer GROUP BY c_nationkey HAVING count(*) > 5 AND avg(c_acctbal) > 4000", None, None),
    "agg_count_distinct": ("SELECT o_orderstatus, count(DISTINCT o_custkey) AS custs, count(DISTINCT o_orderpriority) AS pris FROM orders GROUP BY o_orderstatus", None, None),
    "agg_empty_global": ("SELECT count(*) AS n, sum(o_totalprice) AS s, avg(o_totalprice) AS a, min(o_orderkey) AS lo FROM orders WHERE o_totalprice < -1", None, None),
    "agg_null_group": ("SELECT o_orderstatus, count(*) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 400000 GROUP BY o_orderstatus", None, None),
    "agg_minmax_text": ("SELECT p_brand, min(p_name) AS lo, max(p_name) AS hi, max(p_size) AS size FROM part GROUP BY p_brand", None, None),
    "group_no_agg": ("SELECT p_brand FROM part GROUP BY p_brand", None, None),
    "select_distinct": ("SELECT DISTINCT c_mktsegment, c_nationkey FROM customer", None, None),
    "distinct_case": ("SELECT DISTINCT CASE WHEN p_size > 25 THEN 'big' ELSE 'small' END AS s, p_brand FROM part", None, None),
    "order_by_aggregate": ("SELECT p_brand, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, p_brand) AS rn FROM part GROUP BY p_brand ORDER BY n DESC, p_brand LIMIT 5", None, None),
    "order_nulls": (
        "SELECT c_custkey, p, row_number() OVER (ORDER BY p DESC, c_custkey) AS rn FROM (SELECT c_custkey, max(o_totalprice) AS p FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 300000 GROUP BY c_custkey) t", None,
        "SELECT c_custkey, p, row_number() OVER (ORDER BY p DESC NULLS FIRST, c_custkey) AS rn FROM (SELECT c_custkey, max(o_totalprice) AS p FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 300000 GROUP BY c_custkey) t"),
    "order_nulls_explicit": ("SELECT c_custkey, row_number() OVER (ORDER BY p DESC NULLS LAST, c_custkey) AS rn FROM (SELECT c_custkey, max(o_totalprice) AS p FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 300000 GROUP BY c_custkey) t", None, None),
    "topn": ("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25", None, None),
    "limit_offset": ("SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderkey LIMIT 20 OFFSET 30", None, None),
    "topn_union": ("SELECT k, name FROM (SELECT c_custkey AS k, c_name AS name FROM customer UNION ALL SELECT s_suppkey, s_name FROM supplier) t ORDER BY name DESC, k LIMIT 15", None, None),
}

JOIN: Q = {
    "join_inner": ("SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey", None, None),
    "join_left": ("SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderstatus = 'P'", None, None),
    "join_right": ("SELECT s_suppkey, n_name FROM supplier RIGHT JOIN nation ON s_nationkey = n_nationkey", None, None),
    "join_full": ("SELECT c_custkey, s_suppkey FROM customer FULL OUTER JOIN supplier ON c_custkey = s_suppkey + 5", None, None),
    "join_cross": ("SELECT r_name, n_name FROM region CROSS JOIN nation", None, None),
    "join_chain3": ("SELECT c_custkey, n_name, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE c_acctbal > 9000", None, None),
    "join_self": ("SELECT a.n_name AS x, b.n_name AS y FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey WHERE a.n_nationkey < b.n_nationkey", None, None),
    "join_int_double": ("SELECT p_partkey, l_orderkey, l_linenumber FROM part JOIN lineitem ON p_size = l_quantity AND p_partkey = l_partkey", None, None),
    "join_residual": ("SELECT o_orderkey, l_linenumber FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE l_extendedprice > o_totalprice * 0.5 AND o_orderstatus = 'O'", None, None),
    "join_pushdown": ("SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'MACHINERY' AND o_totalprice > 250000", None, None),
    "join_order_limit": ("SELECT o_orderkey, c_name, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey ORDER BY o_totalprice DESC, o_orderkey LIMIT 10 OFFSET 5", None, None),
    "join_group": ("SELECT n_name, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name", None, None),
    "join_distinct": ("SELECT DISTINCT n_name, o_orderstatus FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey", None, None),
    "join_star": ("SELECT * FROM nation JOIN region ON n_regionkey = r_regionkey", None, None),
    "join_cte": ("WITH big AS (SELECT o_orderkey, o_custkey FROM orders WHERE o_totalprice > 300000) SELECT c_name, o_orderkey FROM big JOIN customer ON o_custkey = c_custkey", None, None),
    "join_using": ("SELECT c_custkey, o_orderkey FROM customer JOIN (SELECT o_custkey AS c_custkey, o_orderkey FROM orders) o USING (c_custkey)", None, None),
    "join_multi_key": ("SELECT a.l_orderkey, a.l_linenumber FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = b.l_linenumber + 1", None, None),
    "theta_join": ("SELECT a.r_name AS x, b.r_name AS y FROM region a JOIN region b ON a.r_regionkey < b.r_regionkey", None, None),
    "join_hint_merge": ("SELECT /*+ MERGE(o) */ c_custkey, o_orderkey FROM customer c JOIN orders o ON c_custkey = o_custkey WHERE o_totalprice > 350000", None, "SELECT c_custkey, o_orderkey FROM customer JOIN orders ON c_custkey = o_custkey WHERE o_totalprice > 350000"),
    "semi_in": ("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)", None, None),
    "anti_not_in": ("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000)", None, None),
    "exists": ("SELECT n_name FROM nation WHERE EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = n_nationkey)", None, None),
    "not_exists": ("SELECT n_name FROM nation WHERE NOT EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = n_nationkey)", None, None),
    "scalar_subquery": ("SELECT o_orderkey FROM orders WHERE o_totalprice > (SELECT avg(o_totalprice) * 2 FROM orders)", None, None),
}

SETS: Q = {
    "union_all": ("SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier", None, None),
    "union_distinct": ("SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier", None, None),
    "intersect": ("SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier", None, None),
    "except": ("SELECT n_nationkey AS k FROM nation EXCEPT SELECT s_nationkey FROM supplier", None, None),
    "chain_union3": ("SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier UNION ALL SELECT n_nationkey FROM nation", None, None),
    "chain_except_right_assoc": ("SELECT n_nationkey AS k FROM nation EXCEPT (SELECT c_nationkey FROM customer EXCEPT SELECT s_nationkey FROM supplier)", None, None),
    "pipe_union": ("SELECT c_nationkey AS k FROM customer |u SELECT s_nationkey FROM supplier", None, "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier"),
    "pipe_union_all": ("SELECT s_nationkey AS k FROM supplier |a SELECT n_nationkey FROM nation", None, "SELECT s_nationkey AS k FROM supplier UNION ALL SELECT n_nationkey FROM nation"),
    "pipe_intersect": ("SELECT c_nationkey AS k FROM customer |n SELECT s_nationkey FROM supplier", None, "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier"),
    "pipe_except": ("SELECT n_nationkey AS k FROM nation |x SELECT s_nationkey FROM supplier", None, "SELECT n_nationkey AS k FROM nation EXCEPT SELECT s_nationkey FROM supplier"),
    "pipe_exists": ("SELECT n_name FROM nation WHERE |? (SELECT 1 FROM supplier WHERE s_nationkey = n_nationkey)", None, "SELECT n_name FROM nation WHERE EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = n_nationkey)"),
    "set_order_limit": ("SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier ORDER BY k DESC LIMIT 4", None, "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier ORDER BY k DESC NULLS FIRST LIMIT 4"),
    "cte_simple": ("WITH f AS (SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F') SELECT o_orderkey FROM f WHERE o_totalprice > 250000", None, None),
    "cte_chain": ("WITH a AS (SELECT c_custkey, c_nationkey FROM customer WHERE c_acctbal > 5000), b AS (SELECT c_custkey FROM a WHERE c_nationkey < 10) SELECT c_custkey FROM b", None, None),
    "cte_agg": ("WITH t AS (SELECT o_custkey, sum(o_totalprice) AS s FROM orders GROUP BY o_custkey) SELECT count(*) AS n, round(max(s), 2) AS top FROM t", None, None),
    "cte_union_filter": ("WITH a AS (SELECT c_nationkey AS k FROM customer), b AS (SELECT s_nationkey AS k FROM supplier) SELECT k FROM a WHERE k < 5 UNION SELECT k FROM b WHERE k > 20", None, None),
}

WINDOW: Q = {
    "win_rank": ("SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn, rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS rk, dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS dr FROM orders", None, None),
    "win_lag": ("SELECT o_orderkey, lag(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS prev, lead(o_orderkey, 2) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS nxt FROM orders", None, None),
    "win_rows_frame": ("SELECT o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 2) AS s, count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 FOLLOWING) AS n FROM orders", None, None),
    "win_range_frame": ("SELECT l_orderkey, l_linenumber, count(*) OVER (PARTITION BY l_suppkey ORDER BY l_quantity RANGE BETWEEN 5 PRECEDING AND 5 FOLLOWING) AS n FROM lineitem", None, None),
    "win_ntile": ("SELECT c_custkey, ntile(4) OVER (ORDER BY c_acctbal, c_custkey) AS q, first_value(c_custkey) OVER (PARTITION BY c_nationkey ORDER BY c_acctbal, c_custkey) AS f, last_value(c_custkey) OVER (PARTITION BY c_nationkey ORDER BY c_acctbal, c_custkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS l FROM customer", None, None),
    "win_aggregate": ("SELECT c_custkey, round(avg(c_acctbal) OVER (PARTITION BY c_nationkey), 4) AS a, max(c_acctbal) OVER (PARTITION BY c_mktsegment) AS m, min(c_acctbal) OVER () AS lo FROM customer", None, None),
}

ALL: Q = {**SINGLE, **AGGREGATE, **JOIN, **SETS, **WINDOW}
