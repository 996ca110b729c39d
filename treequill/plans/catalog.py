"""Registered queries of the XPath and schema operators, with their SQL oracles.

Every query runs over whole tables. An entry is an expression, the names of its
result's columns, and the DuckDB SQL of the same rows.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treequill.operators import content, facets, identity
from treequill.plans import documents, lineage
from treequill.plans.engine import Engine
from treequill.sources import shred
from treequill.xsd import onepass
from treequill.xsd.schema import compile_schema
from treequill.xsd.validate import validate

#: The columns that give each table's document order.
ORDER = {
    "region": ["r_regionkey"], "nation": ["n_nationkey"], "customer": ["c_custkey"], "supplier": ["s_suppkey"], "part": ["p_partkey"], "orders": ["o_orderkey"],
    "lineitem": ["l_orderkey", "l_linenumber"], "events": ["event_id"], "documents": ["doc_id"], "pages": ["page_id"], "benchmark": ["item_id"], "labels": ["doc_id"], "conversations": ["conv_id", "turn"],
}

LINES, ORDERS, CUSTOMERS, PARTS, DOCS, EVENTS, PAGES = (f"/{t}/row" for t in ("lineitem", "orders", "customer", "part", "documents", "events", "pages"))


def of(path: str, *members: str) -> str:
    """A loop over a path that returns members of each row, ``$r``."""
    return f"for $r in {path} return ({', '.join(members)})"


#: name -> (expression, columns, DuckDB SQL)
XPATH: dict[str, tuple[str, tuple[str, ...], str]] = {
    # Paths and predicates.
    "path_filter": (f"{ORDERS}[o_totalprice > 100000]/o_orderkey", ("o_orderkey",), "SELECT o_orderkey FROM orders WHERE o_totalprice > 100000"),
    "path_two_predicates": (of(f"{LINES}[l_quantity > 45][l_returnflag = 'R' or l_discount >= 0.05]", "$r/l_orderkey", "$r/l_linenumber", "$r/l_quantity"), ("k", "n", "q"),
        "SELECT l_orderkey AS k, l_linenumber::BIGINT AS n, l_quantity AS q FROM lineitem WHERE l_quantity > 45 AND (l_returnflag = 'R' OR l_discount >= 0.05)"),
    "path_existence": (f"{DOCS}[text]/doc_id", ("doc_id",), "SELECT doc_id FROM documents WHERE text IS NOT NULL"),
    "if_then_else": (of(ORDERS, "$r/o_orderkey", "if ($r/o_totalprice > 200000) then 'big' else if ($r/o_totalprice > 100000) then 'middle' else 'small'"), ("k", "size"),
        "SELECT o_orderkey AS k, CASE WHEN o_totalprice > 200000 THEN 'big' WHEN o_totalprice > 100000 THEN 'middle' ELSE 'small' END AS size FROM orders"),
    "range": (of(PARTS, "$r/p_partkey", "sum(1 to $r/p_size)", "count(($r/p_size) to 3)"), ("k", "s", "n"),
        "SELECT p_partkey AS k, (p_size * (p_size + 1) / 2)::DOUBLE AS s, greatest(0, 4 - p_size)::BIGINT AS n FROM part"),
    # Joins.
    "for_join": (f"for $o in {ORDERS}, $c in {CUSTOMERS}[c_custkey = $o/o_custkey] return ($o/o_orderkey, $c/c_name)", ("k", "name"),
        "SELECT o_orderkey AS k, c_name AS name FROM orders JOIN customer ON c_custkey = o_custkey"),
    "for_three_way_join": (f"for $l in {LINES}[l_quantity > 49], $o in {ORDERS}[o_orderkey = $l/l_orderkey], $c in {CUSTOMERS}[c_custkey = $o/o_custkey] return ($l/l_linenumber, $o/o_orderkey, $c/c_mktsegment)", ("n", "k", "seg"),
        "SELECT l_linenumber::BIGINT AS n, o_orderkey AS k, c_mktsegment AS seg FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey WHERE l_quantity > 49"),
    "for_theta_join": ("for $a in /nation/row, $b in /nation/row[n_regionkey = $a/n_regionkey and n_nationkey > $a/n_nationkey] return ($a/n_name, $b/n_name)", ("a", "b"),
        "SELECT a.n_name AS a, b.n_name AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND b.n_nationkey > a.n_nationkey"),
    "some_semi": (f"{CUSTOMERS}[some $o in {ORDERS} satisfies $o/o_custkey = c_custkey and $o/o_totalprice > 300000]/c_custkey", ("c_custkey",),
        "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)"),
    "predicate_semi": (f"{ORDERS}[o_orderkey = {LINES}[l_quantity = 50]/l_orderkey]/o_orderkey", ("o_orderkey",),
        "SELECT o_orderkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity = 50)"),
    "not_anti": (f"{ORDERS}[not(o_orderkey = {LINES}/l_orderkey)]/o_orderkey", ("o_orderkey",),
        "SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)"),
    "every_anti": (f"for $o in {ORDERS}[every $l in {LINES}[l_orderkey = 7 or l_quantity > 49] satisfies $l/l_orderkey != o_orderkey] return $o/o_orderkey", ("o_orderkey",),
        "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_orderkey = 7 OR l_quantity > 49)"),
    "empty_anti": (f"{DOCS}[empty(/labels/row[doc_id = 3])]/doc_id", ("doc_id",), "SELECT doc_id FROM documents WHERE NOT EXISTS (SELECT 1 FROM labels WHERE labels.doc_id = 3)"),
    "correlated_sum": (f"for $c in {CUSTOMERS} return ($c/c_custkey, round(sum({ORDERS}[o_custkey = $c/c_custkey]/o_totalprice) * 100))", ("k", "cents"),
        "SELECT c_custkey AS k, round(coalesce(sum(o_totalprice), 0) * 100) AS cents FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey"),
    # Aggregates.
    "count_rows": (f"count({LINES}[l_shipdate > xs:dateTime('1995-06-01T00:00:00')])", ("n",), "SELECT count(*) AS n FROM lineitem WHERE l_shipdate > TIMESTAMP '1995-06-01'"),
    "aggregates": (f"for $k in distinct-values({ORDERS}/o_orderpriority) return ($k, count({ORDERS}[o_orderpriority = $k]), min({ORDERS}[o_orderpriority = $k]/o_totalprice), max({ORDERS}[o_orderpriority = $k]/o_totalprice), sum({ORDERS}[o_orderpriority = $k]/o_custkey))",
        ("p", "n", "low", "high", "total"), "SELECT o_orderpriority AS p, count(*) AS n, min(o_totalprice) AS low, max(o_totalprice) AS high, sum(o_custkey)::DOUBLE AS total FROM orders GROUP BY 1"),
    "distinct_group": (f"for $s in distinct-values({ORDERS}/o_orderstatus) return ($s, round(sum({ORDERS}[o_orderstatus = $s]/o_totalprice) div 1000))", ("s", "total"),
        "SELECT o_orderstatus AS s, round(sum(o_totalprice) / 1000) AS total FROM orders GROUP BY 1"),
    "distinct_values": (f"distinct-values({EVENTS}/event_type)", ("event_type",), "SELECT DISTINCT event_type FROM events"),
    "avg_integer": (f"for $s in distinct-values({PARTS}/p_brand) return ($s, round-half-to-even(avg({PARTS}[p_brand = $s]/p_size), 6))", ("b", "mean"),
        "SELECT p_brand AS b, round_even(sum(p_size) / count(*), 6)::DOUBLE AS mean FROM part GROUP BY 1"),
    "sum_empty": (f"sum({ORDERS}[o_orderkey < 0]/o_totalprice)", ("total",), "SELECT 0.0::DOUBLE AS total"),
    "string_join": ("for $r in /region/row return ($r/r_name, string-join(/nation/row[n_regionkey = $r/r_regionkey]/n_name, '; '))", ("r", "names"),
        "SELECT r_name AS r, string_agg(n_name, '; ' ORDER BY n_nationkey) AS names FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY 1"),
    # Positions and order.
    "position_top": (of(f"{ORDERS}[position() <= 25]", "$r/o_orderkey", "$r/o_totalprice"), ("k", "p"), "SELECT o_orderkey AS k, o_totalprice AS p FROM orders ORDER BY o_orderkey LIMIT 25"),
    "position_last": (f"{ORDERS}[o_orderstatus = 'F'][last()]/o_orderkey", ("o_orderkey",), "SELECT max(o_orderkey) AS o_orderkey FROM orders WHERE o_orderstatus = 'F'"),
    "position_nth": (f"{CUSTOMERS}[10]/c_name", ("c_name",), "SELECT c_name FROM customer ORDER BY c_custkey LIMIT 1 OFFSET 9"),
    "position_mod": (f"{CUSTOMERS}[position() mod 7 = 0]/c_custkey", ("c_custkey",), "SELECT c_custkey FROM (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) AS p FROM customer) WHERE p % 7 = 0"),
    "subsequence": (f"subsequence({CUSTOMERS}, 5, 10)/c_custkey", ("c_custkey",), "SELECT c_custkey FROM customer ORDER BY c_custkey LIMIT 10 OFFSET 4"),
    # Set operations.
    "set_union": (f"({ORDERS}[o_totalprice > 350000] union {ORDERS}[o_orderstatus = 'P'])/o_orderkey", ("o_orderkey",), "SELECT o_orderkey FROM orders WHERE o_totalprice > 350000 UNION SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P'"),
    "set_intersect": (f"({ORDERS}[o_totalprice > 250000] intersect {ORDERS}[o_orderstatus = 'P'])/o_orderkey", ("o_orderkey",), "SELECT o_orderkey FROM orders WHERE o_totalprice > 250000 INTERSECT SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P'"),
    "set_except": (f"({ORDERS}[o_totalprice > 250000] except {ORDERS}[o_orderstatus = 'P'])/o_orderkey", ("o_orderkey",), "SELECT o_orderkey FROM orders WHERE o_totalprice > 250000 EXCEPT SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P'"),
    "sequence_concat": (f"({ORDERS}[o_totalprice > 400000]/o_orderkey, {CUSTOMERS}[c_acctbal < 0]/c_custkey)", ("item",), "SELECT o_orderkey AS item FROM orders WHERE o_totalprice > 400000 UNION ALL SELECT c_custkey FROM customer WHERE c_acctbal < 0"),
    # Arithmetic and comparison.
    "arithmetic": (of(PARTS, "$r/p_partkey", "$r/p_size + 3", "$r/p_size * 2 - 1", "$r/p_size idiv 7", "(0 - $r/p_size) mod 7", "-$r/p_size"), ("k", "a", "b", "c", "d", "e"),
        "SELECT p_partkey AS k, p_size::BIGINT + 3 AS a, p_size::BIGINT * 2 - 1 AS b, (p_size // 7)::BIGINT AS c, (-p_size) % 7::BIGINT AS d, -p_size::BIGINT AS e FROM part"),
    "integer_div": (of(PARTS, "$r/p_partkey", "round-half-to-even($r/p_size div 7, 12)"), ("k", "q"), "SELECT p_partkey AS k, (p_size::DECIMAL(38, 15) / 7)::DECIMAL(38, 12)::DOUBLE AS q FROM part"),
    "double_arithmetic": (of(f"{LINES}[l_quantity > 30]", "$r/l_orderkey", "$r/l_linenumber", "$r/l_extendedprice * (1 - $r/l_discount)"), ("k", "n", "net"),
        "SELECT l_orderkey AS k, l_linenumber::BIGINT AS n, l_extendedprice * (1 - l_discount) AS net FROM lineitem WHERE l_quantity > 30"),
    "value_comparison": (of(ORDERS, "$r/o_orderkey", "$r/o_orderstatus eq 'F'", "$r/o_totalprice le 150000", "$r/o_orderpriority lt '3'"), ("k", "f", "low", "urgent"),
        "SELECT o_orderkey AS k, o_orderstatus = 'F' AS f, o_totalprice <= 150000 AS low, o_orderpriority < '3' AS urgent FROM orders"),
    "general_comparison": (f"{PARTS}[p_size = (1, 5, 49) or p_brand != ('Brand#11', 'Brand#12')]/p_partkey", ("p_partkey",), "SELECT p_partkey FROM part"),
    "general_in": (f"{PARTS}[p_size = (1, 5, 49)]/p_partkey", ("p_partkey",), "SELECT p_partkey FROM part WHERE p_size IN (1, 5, 49)"),
    "date_arithmetic": (of(ORDERS, "$r/o_orderkey", "xs:date($r/o_orderdate) + xs:dayTimeDuration('P30D')", "xs:date($r/o_orderdate) + xs:yearMonthDuration('P1M')", "days-from-duration(xs:date($r/o_orderdate) - xs:date('1992-01-01'))"), ("k", "a", "b", "n"),
        "SELECT o_orderkey AS k, strftime(o_orderdate::DATE + 30, '%Y-%m-%d') AS a, strftime((o_orderdate::DATE + INTERVAL 1 MONTH)::DATE, '%Y-%m-%d') AS b, datediff('day', DATE '1992-01-01', o_orderdate::DATE)::BIGINT AS n FROM orders"),
    "date_comparison": (f"{ORDERS}[o_orderdate ge xs:dateTime('1996-01-01T00:00:00Z') and o_orderdate lt xs:dateTime('1996-02-01T00:00:00Z')]/o_orderkey", ("o_orderkey",),
        "SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '1996-02-01'"),
    "quantifier_in_row": (of(PARTS, "$r/p_partkey", "some $x in (2, 3, 5) satisfies $r/p_size mod $x = 0", "every $x in (2, 3) satisfies $r/p_size mod $x = 0"), ("k", "any", "all"),
        "SELECT p_partkey AS k, p_size % 2 = 0 OR p_size % 3 = 0 OR p_size % 5 = 0 AS any, p_size % 6 = 0 AS all FROM part"),
    # Casts and types.
    "cast": (of(EVENTS, "$r/event_id", "xs:integer($r/value)", "xs:string($r/user_id)", "xs:boolean($r/user_id)"), ("k", "i", "s", "b"),
        "SELECT event_id AS k, trunc(value)::BIGINT AS i, user_id::VARCHAR AS s, user_id <> 0 AS b FROM events"),
    "castable": (of("/conversations/row", "$r/conv_id", "$r/turn", "$r/text castable as xs:integer", "$r/text castable as xs:double"), ("k", "t", "i", "d"),
        r"SELECT conv_id AS k, turn AS t, coalesce(regexp_full_match(trim(text, ' ' || chr(9) || chr(10) || chr(13)), '[+-]?[0-9]+'), false) AS i, coalesce(regexp_full_match(trim(text, ' ' || chr(9) || chr(10) || chr(13)), '[+-]?([0-9]+([.][0-9]*)?|[.][0-9]+)([eE][+-]?[0-9]+)?|[+-]?INF|NaN'), false) AS d FROM conversations"),
    "instance_of": (of("/region/row", "$r/r_regionkey", "data($r/r_regionkey) instance of xs:integer", "data($r/r_name) instance of xs:decimal", "$r/r_name instance of element()"), ("k", "a", "b", "c"),
        "SELECT r_regionkey::BIGINT AS k, true AS a, false AS b, true AS c FROM region"),
}

def _fn(expr: str, sql: str, path: str = DOCS, key: str = "$r/doc_id", table: str = "documents", key_sql: str = "doc_id") -> tuple[str, tuple[str, ...], str]:
    """A query that applies one function to each row of a table."""
    return of(path, key, expr), ("k", "v"), f"SELECT {key_sql} AS k, {sql} AS v FROM {table}"


def _part(expr: str, sql: str) -> tuple[str, tuple[str, ...], str]:
    return _fn(expr, sql, PARTS, "$r/p_partkey", "part", "p_partkey")


def _order(expr: str, sql: str) -> tuple[str, tuple[str, ...], str]:
    return _fn(expr, sql, ORDERS, "$r/o_orderkey", "orders", "o_orderkey")


def _event(expr: str, sql: str) -> tuple[str, tuple[str, ...], str]:
    return _fn(expr, sql, EVENTS, "$r/event_id", "events", "event_id")


_WS = "chr(9) || chr(10) || chr(13)"
FUNCTIONS = {
    "fn_true_false": _part("if ($r/p_size > 25) then true() else false()", "p_size > 25"),
    "fn_not": _part("not($r/p_size > 25)", "NOT p_size > 25"),
    "fn_boolean": _part("boolean(data($r/p_size) - 25)", "p_size <> 25"),
    "fn_empty": _part("empty(index-of((1, 5, 9), $r/p_size))", "p_size NOT IN (1, 5, 9)"),
    "fn_exists": _part("exists(index-of((1, 5, 9), $r/p_size))", "p_size IN (1, 5, 9)"),
    "fn_count": _part("count((1 to $r/p_size, $r/p_name))", "p_size::BIGINT + 1"),
    "fn_reverse": _part("string-join(reverse((string($r/p_size), 'a', 'b')), '-')", "'b-a-' || p_size"),
    "fn_zero_or_one": _part("zero-or-one($r/p_size)", "p_size::BIGINT"),
    "fn_one_or_more": _part("sum(one-or-more(($r/p_size, 1)))", "(p_size + 1)::DOUBLE"),
    "fn_exactly_one": _part("exactly-one($r/p_name)", "p_name"),
    "fn_distinct_values": _part("count(distinct-values(($r/p_size, 7, 7, 9)))", "CASE WHEN p_size IN (7, 9) THEN 2 ELSE 3 END::BIGINT"),
    "fn_index_of": _part("sum(index-of((7, $r/p_size, 9), 9))", "CASE WHEN p_size = 9 THEN 5 ELSE 3 END::DOUBLE"),
    "fn_remove": _part("sum(remove(($r/p_size, 100, 1000), 2))", "(p_size + 1000)::DOUBLE"),
    "fn_insert_before": _part("string-join(for $x in insert-before((1, 2), 2, $r/p_size) return string($x), ',')", "'1,' || p_size || ',2'"),
    "fn_subsequence": _part("sum(subsequence(($r/p_size, 10, 20, 30), 1, 2))", "(p_size + 10)::DOUBLE"),
    "fn_unordered": _part("sum(unordered(($r/p_size, 1)))", "(p_size + 1)::DOUBLE"),
    "fn_deep_equal": _part("deep-equal(($r/p_size, 1), (9, 1))", "p_size = 9"),
    "fn_sum": _part("sum(($r/p_size, 2, 3))", "(p_size + 5)::DOUBLE"),
    "fn_avg": _part("avg(($r/p_size, $r/p_size + 2))", "(p_size + 1)::DOUBLE"),
    "fn_min": _part("min(($r/p_size, 20))", "least(p_size, 20)::BIGINT"),
    "fn_max": _part("max(($r/p_retailprice, 1000))", "greatest(p_retailprice, 1000)"),
    "fn_concat": _part("concat($r/p_brand, '/', $r/p_size)", "p_brand || '/' || p_size"),
    "fn_string_join": _part("string-join(($r/p_brand, $r/p_type), ' + ')", "p_brand || ' + ' || p_type"),
    "fn_substring": _fn("substring($r/text, 3, 20)", "substr(text, 3, 20)"),
    "fn_string_length": _fn("string-length($r/text)", "length(text)"),
    "fn_normalize_space": _fn("normalize-space($r/text)", f"trim(regexp_replace(translate(coalesce(text, ''), {_WS}, '   '), ' +', ' ', 'g'), ' ')"),
    "fn_normalize_unicode": _fn("normalize-unicode($r/text, 'NFC')", "nfc_normalize(coalesce(text, ''))"),
    "fn_upper_case": _part("upper-case($r/p_name)", "upper(p_name)"),
    "fn_lower_case": _part("lower-case($r/p_brand)", "lower(p_brand)"),
    "fn_translate": _fn("translate($r/text, 'aeiou', 'AE')", "translate(coalesce(text, ''), 'aeiou', 'AE')"),
    "fn_encode_for_uri": _part("encode-for-uri(concat($r/p_brand, ' é'))", "url_encode(p_brand || ' é')"),
    "fn_iri_to_uri": _part("iri-to-uri(concat('http://h/', $r/p_size, '/é?a=b'))", "'http://h/' || p_size || '/%C3%A9?a=b'"),
    "fn_escape_html_uri": _part("escape-html-uri(concat('a b é', $r/p_size))", "'a b %C3%A9' || p_size"),
    "fn_contains": _fn("contains($r/text, 'the')", "contains(text, 'the')"),
    "fn_starts_with": _fn("starts-with($r/text, 'The')", "starts_with(text, 'The')"),
    "fn_ends_with": _fn("ends-with($r/text, '.')", "ends_with(text, '.')"),
    "fn_substring_before": _part("substring-before($r/p_type, ' ')", "CASE WHEN instr(p_type, ' ') > 0 THEN left(p_type, instr(p_type, ' ') - 1) ELSE '' END"),
    "fn_substring_after": _part("substring-after($r/p_brand, '#')", "CASE WHEN instr(p_brand, '#') > 0 THEN substr(p_brand, instr(p_brand, '#') + 1) ELSE '' END"),
    "fn_string_to_codepoints": _fn("sum(string-to-codepoints($r/text))", "coalesce(list_sum([unicode(c) FOR c IN string_split(text, '') IF c <> '']), 0)::DOUBLE"),
    "fn_codepoints_to_string": _part("codepoints-to-string((65 + $r/p_size mod 26, 233, 128512))", "chr(65 + p_size % 26) || 'é😀'"),
    "fn_compare": _part("compare($r/p_brand, 'Brand#3')", "CASE WHEN p_brand < 'Brand#3' THEN -1 WHEN p_brand = 'Brand#3' THEN 0 ELSE 1 END::BIGINT"),
    "fn_codepoint_equal": _part("codepoint-equal($r/p_brand, 'Brand#13')", "p_brand = 'Brand#13'"),
    "fn_abs": _part("abs($r/p_size - 25)", "abs(p_size - 25)::BIGINT"),
    "fn_ceiling": _part("ceiling($r/p_retailprice)", "ceil(p_retailprice)"),
    "fn_floor": _part("floor($r/p_retailprice)", "floor(p_retailprice)"),
    "fn_round": _part("round($r/p_retailprice)", "round(p_retailprice)"),
    "fn_round_half_to_even": _part("round-half-to-even(xs:decimal($r/p_size) div 2)", "round_even(p_size / 2.0, 0)::DOUBLE"),
    "fn_number": _part("number(substring-after($r/p_brand, '#'))", "TRY_CAST(substr(p_brand, instr(p_brand, '#') + 1) AS DOUBLE)"),
    "fn_string": _part("string($r/p_size)", "p_size::VARCHAR"),
    "fn_data": _part("data($r/p_size) + 1", "p_size::BIGINT + 1"),
    "fn_name": _part("concat(name($r), '/', local-name($r/p_size), namespace-uri($r), $r/p_size)", "'row/p_size' || p_size"),
    "fn_year_month_day": _order("year-from-dateTime($r/o_orderdate) * 10000 + month-from-dateTime($r/o_orderdate) * 100 + day-from-dateTime($r/o_orderdate)", "strftime(o_orderdate, '%Y%m%d')::BIGINT"),
    "fn_hours_minutes": _event("hours-from-dateTime($r/ts) * 100 + minutes-from-dateTime($r/ts)", "(hour(ts) * 100 + minute(ts))::BIGINT"),
    "fn_seconds": _event("seconds-from-dateTime($r/ts)", "(epoch_us(ts) % 60000000) / 1e6"),
    "fn_date_parts": _order("year-from-date(xs:date($r/o_orderdate)) + month-from-date(xs:date($r/o_orderdate)) + day-from-date(xs:date($r/o_orderdate))", "(year(o_orderdate) + month(o_orderdate) + day(o_orderdate))::BIGINT"),
    "fn_time_parts": _event("hours-from-time(xs:time($r/ts)) + minutes-from-time(xs:time($r/ts))", "(hour(ts) + minute(ts))::BIGINT"),
    "fn_time_seconds": _event("floor(seconds-from-time(xs:time($r/ts)))", "second(ts)::DOUBLE"),
    "fn_dateTime": _order("dateTime(xs:date($r/o_orderdate), xs:time('10:30:00')) gt xs:dateTime('1996-01-01T00:00:00')", "o_orderdate::DATE + INTERVAL 630 MINUTE > TIMESTAMP '1996-01-01'"),
    "fn_timezone": _order("string(timezone-from-dateTime(adjust-dateTime-to-timezone($r/o_orderdate, xs:dayTimeDuration(concat('-PT', 1 + $r/o_custkey mod 12, 'H')))))", "'-PT' || (1 + o_custkey % 12) || 'H'"),
    "fn_timezone_from_date": _order("string(timezone-from-date(xs:date(concat(substring(string($r/o_orderdate), 1, 10), if ($r/o_custkey mod 2 = 0) then '-05:00' else 'Z'))))", "CASE WHEN o_custkey % 2 = 0 THEN '-PT5H' ELSE 'PT0S' END"),
    "fn_timezone_from_time": _order("string(timezone-from-time(xs:time(concat('10:00:00', if ($r/o_custkey mod 2 = 0) then '+02:30' else 'Z'))))", "CASE WHEN o_custkey % 2 = 0 THEN 'PT2H30M' ELSE 'PT0S' END"),
    "fn_adjust_timezone": _order("string(adjust-dateTime-to-timezone(xs:dateTime(concat(substring(string($r/o_orderdate), 1, 19), 'Z')), xs:dayTimeDuration('PT10H')))", "strftime(o_orderdate + INTERVAL 10 HOUR, '%Y-%m-%dT%H:%M:%S+10:00')"),
    "fn_adjust_date": _order("string(adjust-date-to-timezone(xs:date(concat(substring(string($r/o_orderdate), 1, 10), '-05:00')), xs:dayTimeDuration('-PT10H')))", "strftime(o_orderdate::DATE - 1, '%Y-%m-%d') || '-10:00'"),
    "fn_adjust_time": _event("string(adjust-time-to-timezone(xs:time(concat(substring(string($r/ts), 12, 8), 'Z')), xs:dayTimeDuration('PT2H')))", "strftime(date_trunc('second', ts) + INTERVAL 2 HOUR, '%H:%M:%S') || '+02:00'"),
    "fn_matches": _fn("matches($r/text, '^[A-Z][a-z]+ ')", "regexp_matches(text, '^[A-Z][a-z]+ ')"),
    "fn_replace": _part("replace($r/p_brand, '([A-Za-z]+)#(\\d)', '$2-$1-')", r"regexp_replace(p_brand, '([A-Za-z]+)#(\d)', '\2-\1-', 'g')"),
    "fn_tokenize": _part("count(tokenize($r/p_type, '\\s+'))", r"len(string_split_regex(p_type, '\s+'))::BIGINT"),
    "fn_trace": _part("trace($r/p_size, 'size')", "p_size::BIGINT"),
    "fn_QName": _part("concat(local-name-from-QName(QName(concat('urn:', $r/p_size), concat('p:n', $r/p_size))), prefix-from-QName(QName('urn:a', 'p:b')))", "'n' || p_size || 'p'"),
    "fn_namespace_uri_from_QName": _part("string(namespace-uri-from-QName(QName(concat('urn:', $r/p_size), 'p:n')))", "'urn:' || p_size"),
    "fn_years_from_duration": _part("years-from-duration(xs:yearMonthDuration(concat('P', $r/p_size, 'M')))", "(p_size // 12)::BIGINT"),
    "fn_months_from_duration": _part("months-from-duration(xs:yearMonthDuration(concat('P', $r/p_size, 'M')))", "(p_size % 12)::BIGINT"),
    "fn_minutes_from_duration": _part("minutes-from-duration(xs:dayTimeDuration(concat('PT', $r/p_size * 7, 'M')))", "(p_size * 7 % 60)::BIGINT"),
    "fn_seconds_from_duration": _part("seconds-from-duration(xs:dayTimeDuration(concat('PT', $r/p_size, '.5S')))", "(p_size + 0.5)::DOUBLE"),
    "fn_duration_product": _part("hours-from-duration(xs:dayTimeDuration('PT30M') * $r/p_size)", "(p_size // 2 % 24)::BIGINT"),
    "fn_duration_quotient": _part("xs:dayTimeDuration(concat('PT', $r/p_size, 'H')) div xs:dayTimeDuration('PT30M')", "(p_size * 2)::DOUBLE"),
    "fn_treat_as": _part("($r/p_size treat as item()) + 1", "p_size::BIGINT + 1"),
    "fn_current_date": _order("string(xs:date($r/o_orderdate) + (current-date() - current-date()))", "strftime(o_orderdate, '%Y-%m-%d')"),
    "fn_current_dateTime": _order("$r/o_orderdate lt current-dateTime() and $r/o_custkey > 500", "o_custkey > 500"),
    "fn_current_time": _part("string($r/p_size * (hours-from-time(current-time()) - hours-from-time(current-time())) + $r/p_size)", "p_size::VARCHAR"),
    "fn_implicit_timezone": _part("concat(string(implicit-timezone()), $r/p_size)", "'PT0S' || p_size"),
    "fn_resolve_uri_relative": _part("string(resolve-uri(concat('../p', $r/p_size), 'http://h/a/b/c'))", "'http://h/a/p' || p_size"),
    "fn_default_collation": _part("concat(default-collation(), $r/p_size)", "'http://www.w3.org/2005/xpath-functions/collation/codepoint' || p_size"),
}
FUNCTIONS["fn_duration_parts"] = _order(
    "days-from-duration($r/o_orderdate - xs:dateTime('1990-01-01T01:30:15')) * 100 + hours-from-duration($r/o_orderdate - xs:dateTime('1990-01-01T01:30:15'))",
    "((epoch_us(o_orderdate) - epoch_us(TIMESTAMP '1990-01-01 01:30:15')) // 86400000000 * 100 + (epoch_us(o_orderdate) - epoch_us(TIMESTAMP '1990-01-01 01:30:15')) // 3600000000 % 24)::BIGINT",
)
#: Queries whose rows no SQL gives: name -> (expression, columns).
WITHOUT_SQL = {"fn_resolve_uri": (of(PAGES, "$r/page_id", "resolve-uri('../x', $r/url)"), ("k", "v"))}


def engine_of(spark: SparkSession, sf_dir: str, expression: str = "") -> Engine:
    """An engine over the tables that an expression names."""
    engine = Engine(spark)
    for name, order in ORDER.items():
        if not expression or re.search(rf"/{name}\b", expression):
            engine.table(name, spark.read.parquet(f"{sf_dir}/{name}.parquet"), order)
    return engine


def _xpath(expression: str, columns: tuple[str, ...]):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        engine = engine_of(spark, sf_dir, expression)
        found = engine.query(expression).toDF(columns[0]) if len(columns) == 1 else engine.query(expression, columns)
        # Decimals of 18 places leave as doubles, which any SQL engine can be compared with.
        return found.select(*[F.col(c).cast("double").alias(c) if kind.startswith("decimal") else F.col(c) for c, kind in found.dtypes])

    return run


# Simple types, identity constraints, node tables.


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


SEGMENT = facets.builtin("token").restricted("segment", {"enumeration": ["AUTOMOBILE", "BUILDING", "MACHINERY"]})
NAME = facets.builtin("string").restricted("name", {"pattern": [r"Customer#\d{8}[0-4]"]})
DISCOUNT = facets.builtin("decimal").restricted("discount", {"minInclusive": ["0.01"], "maxExclusive": ["0.07"]})
SHORT = facets.builtin("string").restricted("short", {"minLength": ["8"], "maxLength": ["10"]})
PRICE = facets.builtin("decimal").restricted("price", {"totalDigits": ["3"], "fractionDigits": ["1"]})


def _facet(table: str, column: str, key: str, kind: facets.Simple):
    return lambda spark, d: facets.check_column(_read(spark, d, table), column, kind, [key]).select(key, "code")


def _unique(table: str, fields: list[str], kind: str = "unique"):
    return lambda spark, d: getattr(identity, kind)(_read(spark, d, table), fields).drop("code")


def _keyref(source: tuple[str, str], target: tuple[str, str]):
    return lambda spark, d: identity.keyref(_read(spark, d, source[0]), [source[1]], _read(spark, d, target[0]), [target[1]]).drop("code")


SCHEMA = {
    "facet_enumeration": (_facet("customer", "c_mktsegment", "c_custkey", SEGMENT), "SELECT c_custkey, 'cvc-enumeration-valid' AS code FROM customer WHERE c_mktsegment NOT IN ('AUTOMOBILE', 'BUILDING', 'MACHINERY')"),
    "facet_pattern": (_facet("customer", "c_name", "c_custkey", NAME), "SELECT c_custkey, 'cvc-pattern-valid' AS code FROM customer WHERE NOT regexp_full_match(c_name, 'Customer#[0-9]{8}[0-4]')"),
    "facet_bounds": (
        lambda spark, d: facets.check_column(_read(spark, d, "lineitem").withColumn("v", F.round("l_discount", 2).cast("decimal(4, 2)")), "v", DISCOUNT, ["l_orderkey", "l_linenumber"]).select("l_orderkey", "l_linenumber", "code"),
        "SELECT l_orderkey, l_linenumber, CASE WHEN round(l_discount, 2) < 0.01 THEN 'cvc-minInclusive-valid' ELSE 'cvc-maxExclusive-valid' END AS code FROM lineitem WHERE round(l_discount, 2) < 0.01 OR round(l_discount, 2) >= 0.07",
    ),
    "facet_bounds_column": (
        _facet("lineitem", "l_quantity", "l_orderkey", facets.builtin("double").restricted("few", {"minExclusive": ["2"], "maxInclusive": ["48.5"]})),
        "SELECT l_orderkey, CASE WHEN l_quantity <= 2 THEN 'cvc-minExclusive-valid' ELSE 'cvc-maxInclusive-valid' END AS code FROM lineitem WHERE l_quantity <= 2 OR l_quantity > 48.5",
    ),
    "facet_assertion": (
        _facet("part", "p_size", "p_partkey", facets.builtin("int").restricted("odd", {"assertion": ["$value mod 2 = 1"], "maxInclusive": ["40"]})),
        "SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'cvc-assertion' ELSE 'cvc-maxInclusive-valid' END AS code FROM part WHERE p_size % 2 = 0 OR p_size > 40",
    ),
    "xs_key_fail": (_unique("events", ["user_id"], "key"), "SELECT user_id, count(*) AS n FROM events GROUP BY 1 HAVING count(*) > 1"),
    "facet_length": (_facet("part", "p_name", "p_partkey", SHORT), "SELECT p_partkey, CASE WHEN length(p_name) < 8 THEN 'cvc-minLength-valid' ELSE 'cvc-maxLength-valid' END AS code FROM part WHERE length(p_name) NOT BETWEEN 8 AND 10"),
    "facet_digits": (
        lambda spark, d: facets.check_column(_read(spark, d, "part").withColumn("v", F.col("p_retailprice").cast("decimal(10, 2)")), "v", PRICE, ["p_partkey"]).select("p_partkey", "code"),
        "WITH p AS (SELECT p_partkey, rtrim(rtrim(p_retailprice::DECIMAL(10, 2)::VARCHAR, '0'), '.') AS t FROM part) SELECT p_partkey, CASE WHEN length(replace(t, '.', '')) > 3 THEN 'cvc-totalDigits-valid' ELSE 'cvc-fractionDigits-valid' END AS code FROM p WHERE length(replace(t, '.', '')) > 3 OR length(split_part(t, '.', 2)) > 1",
    ),
    "xs_key_pass": (_unique("orders", ["o_orderkey"], "key"), "SELECT o_orderkey, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) > 1"),
    "xs_unique_fail": (_unique("lineitem", ["l_orderkey", "l_linenumber"]), "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1"),
    "xs_keyref_pass": (_keyref(("lineitem", "l_orderkey"), ("orders", "o_orderkey")), "SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders) GROUP BY 1"),
    "xs_keyref_fail": (_keyref(("orders", "o_orderkey"), ("lineitem", "l_orderkey")), "SELECT o_orderkey, count(*) AS n FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem) GROUP BY 1"),
    "xs_keyref_documents": (_keyref(("documents", "doc_id"), ("labels", "doc_id")), "SELECT doc_id, count(*) AS n FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) GROUP BY 1"),
}


# Node tables.

ROW_SCHEMA = """
<xs:schema xmlns:xs="http://www.w3.org/2001/XMLSchema">
  <xs:element name="row" type="Order"/>
  <xs:complexType name="Order">
    <xs:sequence>
      <xs:element name="o_orderkey" type="xs:nonNegativeInteger"/>
      <xs:element name="o_custkey" type="xs:int"/>
      <xs:element name="o_orderstatus"><xs:simpleType><xs:restriction base="xs:token"><xs:enumeration value="O"/><xs:enumeration value="F"/></xs:restriction></xs:simpleType></xs:element>
      <xs:element name="o_totalprice"><xs:simpleType><xs:restriction base="xs:decimal"><xs:maxInclusive value="300000"/></xs:restriction></xs:simpleType></xs:element>
    </xs:sequence>
  </xs:complexType>
</xs:schema>
"""


def _customers(spark: SparkSession, d: str) -> Engine:
    """An engine over an XML document of each customer."""
    return Engine(spark).documents(shred.from_rows(lineage.spread(_read(spark, d, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment")), "c_custkey"))


def _shredded(spark: SparkSession, d: str) -> DataFrame:
    nodes = shred.shred(shred.from_rows(_read(spark, d, "part"), "p_partkey"))
    return nodes.where("kind = 'element'").groupBy("local").agg(F.count(F.lit(1)).alias("n"), F.max("post").cast("long").alias("last"))


def _axes(spark: SparkSession, d: str) -> DataFrame:
    """Nodes on each axis from the element c_nationkey, over all documents."""
    axes = ("child", "descendant", "self", "descendant-or-self", "following-sibling", "following", "parent", "ancestor", "preceding-sibling", "preceding", "ancestor-or-self")
    counted = _customers(spark, d).query(f"for $d in /self::node() return ({', '.join(f'count($d//c_nationkey/{a}::node())' for a in axes)})", axes)
    totals = counted.agg(*[F.coalesce(F.sum(f"`{a}`"), F.lit(0)).alias(a) for a in axes])
    return totals.select(F.explode(F.array(*[F.struct(F.lit(a).alias("axis"), F.col(f"`{a}`").alias("n")) for a in axes])).alias("r")).select("r.*")


def _malformed(spark: SparkSession, d: str) -> DataFrame:
    return shred.errors(shred.shred(_read(spark, d, "pages"), "page_id", "html")).select(F.col("doc").alias("page_id"))


def _validated(spark: SparkSession, d: str) -> DataFrame:
    rows = _read(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", F.col("o_totalprice").cast("decimal(12, 2)").alias("o_totalprice"))
    nodes = lineage.cut(shred.shred(shred.from_rows(rows, "o_orderkey")))
    return validate(spark, nodes, compile_schema(ROW_SCHEMA)).violations.select(F.col("doc").alias("o_orderkey"), "path", "code")


def _one_pass(spark: SparkSession, d: str) -> DataFrame:
    rows = _read(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", F.col("o_totalprice").cast("decimal(12, 2)").alias("o_totalprice"))
    return onepass.violations(shred.from_rows(rows, "o_orderkey"), compile_schema(ROW_SCHEMA)).select(F.col("doc").alias("o_orderkey"), "path", "code")


def _xpath_1_0(spark: SparkSession, d: str) -> DataFrame:
    """Comparisons of the 1.0 mode go by numbers where a side is one, and for order always."""
    engine = Engine(spark, mode="1.0").table("part", _read(spark, d, "part"), ["p_partkey"])
    return engine.query("/part/row[p_size > '25' and p_brand != 7]/p_partkey").toDF("p_partkey")


def _content(spark: SparkSession, d: str) -> DataFrame:
    model = content.Model.sequence(content.Model.element("F").occurs(1, None), content.Model.element("O").occurs(0, None))
    rows = _read(spark, d, "lineitem").withColumn("status", F.col("l_linestatus"))
    return content.unmatched(rows, "l_orderkey", ["l_linenumber", "l_linestatus"], "status", model)


NODES = {
    "shred_roundtrip": (_shredded, "SELECT l AS local, (SELECT count(*) FROM part) AS n, p::BIGINT AS last FROM (VALUES ('row', 13), ('p_partkey', 3), ('p_name', 5), ('p_brand', 7), ('p_type', 9), ('p_size', 11), ('p_retailprice', 13)) t(l, p)"),
    "axes": (_axes, "SELECT a AS axis, m * (SELECT count(*) FROM customer) AS n FROM (VALUES ('child', 1), ('descendant', 1), ('self', 1), ('descendant-or-self', 2), ('following-sibling', 1), ('following', 2), ('parent', 1), ('ancestor', 2), ('preceding-sibling', 2), ('preceding', 4), ('ancestor-or-self', 3)) t(a, m)"),
    "node_predicate": (lambda spark, d: _customers(spark, d).query("/row[c_mktsegment = 'BUILDING']/c_name").select(F.col("doc").alias("c_custkey"), "value"), "SELECT c_custkey, c_name AS value FROM customer WHERE c_mktsegment = 'BUILDING'"),
    "node_numeric_predicate": (lambda spark, d: _customers(spark, d).query("//c_nationkey[. >= 20]/..").select(F.col("doc").alias("c_custkey")), "SELECT c_custkey FROM customer WHERE c_nationkey >= 20"),
    "node_set_operations": (lambda spark, d: _customers(spark, d).query("//row[c_nationkey < 5] except //row[c_mktsegment = 'BUILDING']").select(F.col("doc").alias("c_custkey")), "SELECT c_custkey FROM customer WHERE c_nationkey < 5 AND c_mktsegment <> 'BUILDING'"),
    "node_return": (lambda spark, d: _customers(spark, d).query("for $r in //row return concat($r/c_name, '|', $r/c_mktsegment, '|', count($r/*))").select(F.col("item").alias("v")), "SELECT c_name || '|' || c_mktsegment || '|4' AS v FROM customer"),
    "malformed_pages": (_malformed, "SELECT page_id FROM pages"),
    "xsd_validate": (_validated, "SELECT o_orderkey, '/row/o_orderstatus' AS path, 'cvc-enumeration-valid' AS code FROM orders WHERE o_orderstatus NOT IN ('O', 'F') UNION ALL SELECT o_orderkey, '/row/o_totalprice', 'cvc-maxInclusive-valid' FROM orders WHERE o_totalprice > 300000"),
    "xsd_one_pass": (_one_pass, "SELECT o_orderkey, '/row/o_orderstatus' AS path, 'cvc-enumeration-valid' AS code FROM orders WHERE o_orderstatus NOT IN ('O', 'F') UNION ALL SELECT o_orderkey, '/row/o_totalprice', 'cvc-maxInclusive-valid' FROM orders WHERE o_totalprice > 300000"),
    "xpath_1_0": (_xpath_1_0, "SELECT p_partkey FROM part WHERE p_size > 25"),
    "content_model": (_content, "SELECT l_orderkey, count(*) AS n, 'cvc-complex-type.2.4' AS code FROM lineitem GROUP BY 1 HAVING NOT regexp_full_match(string_agg(l_linestatus, '' ORDER BY l_linenumber, l_linestatus), 'F+O*')"),
}


def queries() -> dict:
    out = {name: _xpath(expression, columns) for name, (expression, columns, _) in {**XPATH, **FUNCTIONS}.items()}
    return out | {name: run for name, (run, _) in {**SCHEMA, **NODES, **documents.QUERIES}.items()}


def queries_without_sql() -> dict:
    return {name: _xpath(expression, columns) for name, (expression, columns) in WITHOUT_SQL.items()}


def oracle_sql() -> dict:
    return {name: sql for name, (_, _, sql) in {**XPATH, **FUNCTIONS}.items()} | {name: sql for name, (_, sql) in {**SCHEMA, **NODES, **documents.QUERIES}.items()}
