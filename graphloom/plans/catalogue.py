"""Registered queries of the graph engine, each with the SQL that gives the same rows.

QUERIES: name -> (query text, SQL); they run on the test tables lifted to a graph.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import GraphSession

_sessions: dict = {}


def session(spark: SparkSession, sf_dir: str) -> GraphSession:
    """A session on the lifted tables; the graph is immutable, so that it is made once for each folder."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _sessions:
        _sessions.clear()
        _sessions[key] = GraphSession.from_tables(spark, sf_dir).graph
    s = GraphSession(_sessions[key])
    s.register("nations.of", [("region", "INTEGER")], [("name", "STRING")], lambda g, r: g.nodes[("Nation",)].where(F.col("regionkey") == r).select("name"))
    return s


_LINES = "SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS rn FROM lineitem"
_SUPPLIES = "SELECT DISTINCT l_suppkey, l_partkey FROM lineitem"
_NEXT = "SELECT event_id AS a, lead(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events"
_NEXT = f"SELECT * FROM ({_NEXT}) WHERE b IS NOT NULL"

QUERIES: dict[str, tuple[str, str]] = {
    "label_scan_filter": ("MATCH (c:Customer) WHERE c.acctbal > 5000.0 AND c.mktsegment = 'BUILDING' RETURN c.custkey AS k, c.name AS name, c.acctbal AS bal", "SELECT c_custkey AS k, c_name AS name, c_acctbal AS bal FROM customer WHERE c_acctbal > 5000 AND c_mktsegment = 'BUILDING'"),
    "all_nodes_count_by_label": ("MATCH (n) RETURN labels(n)[0] AS label, count(*) AS n", "SELECT 'Region' AS label, count(*) AS n FROM region UNION ALL SELECT 'Nation', count(*) FROM nation UNION ALL SELECT 'Customer', count(*) FROM customer UNION ALL SELECT 'Supplier', count(*) FROM supplier UNION ALL SELECT 'Part', count(*) FROM part UNION ALL SELECT 'Order', count(*) FROM orders UNION ALL SELECT 'Event', count(*) FROM events UNION ALL SELECT 'User', count(DISTINCT user_id) FROM events"),
    "index_range": ("MATCH (o:Order) WHERE 1000.0 <= o.totalprice < 50000.0 RETURN count(*) AS n, max(o.totalprice) AS top", "SELECT count(*) AS n, max(o_totalprice) AS top FROM orders WHERE o_totalprice >= 1000 AND o_totalprice < 50000"),
    "expand_out": ("MATCH (c:Customer)-[:PLACED]->(o:Order) RETURN c.mktsegment AS seg, o.orderpriority AS prio, count(*) AS n", "SELECT c_mktsegment AS seg, o_orderpriority AS prio, count(*) AS n FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY ALL"),
    "expand_in": ("MATCH (r:Region)<-[:IN_REGION]-(n:Nation) RETURN r.name AS r, count(n) AS n, min(n.name) AS first", "SELECT r_name AS r, count(*) AS n, min(n_name) AS first FROM region JOIN nation ON r_regionkey = n_regionkey GROUP BY 1"),
    "expand_either": ("MATCH (e:Event)-[r:NEXT]-(f:Event) RETURN e.event_type AS t, count(r) AS n", f"SELECT event_type AS t, count(*) AS n FROM events JOIN (SELECT a FROM ({_NEXT}) UNION ALL SELECT b FROM ({_NEXT})) ON event_id = a GROUP BY 1"),
    "expand_multi_type": ("MATCH (a)-[r:IN_NATION|IN_REGION]->(b) RETURN type(r) AS t, labels(b)[0] AS l, count(*) AS n", "SELECT 'IN_NATION' AS t, 'Nation' AS l, (SELECT count(*) FROM customer) + (SELECT count(*) FROM supplier) AS n UNION ALL SELECT 'IN_REGION', 'Region', count(*) FROM nation"),
    "edge_type_scan": ("MATCH (:Order)-[r:CONTAINS]->(:Part) WHERE r.quantity > 45.0 RETURN r.returnflag AS f, count(*) AS n, sum(r.quantity) AS q", "SELECT l_returnflag AS f, count(*) AS n, sum(l_quantity) AS q FROM lineitem WHERE l_quantity > 45 GROUP BY 1"),
    "two_hop_building": ("MATCH (c:Customer {mktsegment: 'BUILDING'})-[:PLACED]->(o:Order)-[:CONTAINS]->(p:Part) RETURN o.orderpriority AS priority, count(*) AS n ORDER BY priority", "SELECT o_orderpriority AS priority, count(*) AS n FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON o_orderkey = l_orderkey WHERE c_mktsegment = 'BUILDING' GROUP BY 1"),
    "two_hop_same_part": ("MATCH (a:Order)-[r:CONTAINS]->(p:Part)<-[s:CONTAINS]-(b:Order) RETURN p.brand AS brand, count(*) AS n", f"WITH l AS ({_LINES}) SELECT p_brand AS brand, count(*) AS n FROM l x JOIN l y ON x.l_partkey = y.l_partkey AND (x.l_orderkey, x.rn) <> (y.l_orderkey, y.rn) JOIN part ON p_partkey = x.l_partkey GROUP BY 1"),
    "triangle_cycle": ("MATCH (n:Nation)<-[:IN_NATION]-(c:Customer)-[:PLACED]->(:Order)-[:CONTAINS]->(:Part)<-[:SUPPLIES]-(s:Supplier)-[:IN_NATION]->(n) RETURN n.name AS n, count(*) AS k", f"SELECT n_name AS n, count(*) AS k FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem l ON l.l_orderkey = o_orderkey JOIN ({_SUPPLIES}) s ON s.l_partkey = l.l_partkey JOIN supplier ON s_suppkey = s.l_suppkey JOIN nation ON n_nationkey = c_nationkey WHERE c_nationkey = s_nationkey GROUP BY 1"),
    "cross_join_nations": ("MATCH (a:Nation), (b:Region) RETURN a.name AS a, b.name AS b", "SELECT n_name AS a, r_name AS b FROM nation CROSS JOIN region"),
    "theta_join": ("MATCH (a:Nation), (b:Nation) WHERE a.regionkey = b.regionkey AND a.nationkey < b.nationkey RETURN a.regionkey AS r, count(*) AS n", "SELECT a.n_regionkey::BIGINT AS r, count(*) AS n FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey GROUP BY 1"),
    "optional_match_filtered": ("MATCH (c:Customer) OPTIONAL MATCH (c)-[:PLACED]->(o:Order) WHERE o.totalprice > 200000.0 RETURN c.custkey AS k, count(o) AS n, max(o.totalprice) AS top", "SELECT c_custkey AS k, count(o_orderkey) AS n, max(o_totalprice) AS top FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 200000 GROUP BY 1"),
    "optional_multi_hop": ("MATCH (s:Supplier) OPTIONAL MATCH (s)-[:SUPPLIES]->(p:Part)<-[r:CONTAINS]-(o:Order) WHERE r.quantity > 49.0 RETURN s.suppkey AS k, count(r) AS n", f"SELECT s_suppkey AS k, count(l.l_orderkey) AS n FROM supplier LEFT JOIN (SELECT s.l_suppkey AS sk, i.l_orderkey FROM ({_SUPPLIES}) s JOIN lineitem i ON s.l_partkey = i.l_partkey AND i.l_quantity > 49) l ON l.sk = s_suppkey GROUP BY 1"),
    "semi_pattern": ("MATCH (o:Order) WHERE (o)-[:CONTAINS]->() RETURN o.orderstatus AS s, count(*) AS n", "SELECT o_orderstatus AS s, count(*) AS n FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem) GROUP BY 1"),
    "anti_pattern": ("MATCH (o:Order) WHERE NOT (o)-[:CONTAINS]->() RETURN o.orderkey AS k", "SELECT o_orderkey AS k FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)"),
    "exists_where": ("MATCH (c:Customer) WHERE exists { (c)-[:PLACED]->(o:Order) WHERE o.totalprice > c.acctbal * 50.0 } RETURN c.mktsegment AS s, count(*) AS n", "SELECT c_mktsegment AS s, count(*) AS n FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > c_acctbal * 50) GROUP BY 1"),
    "exists_full_having": ("MATCH (c:Customer) WHERE exists { MATCH (c)-[:PLACED]->(o:Order) WITH c, count(o) AS n WHERE n > 12 RETURN c } RETURN c.custkey AS k", "SELECT c_custkey AS k FROM customer WHERE (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) > 12"),
    "exists_in_or": ("MATCH (c:Customer) WHERE c.acctbal < 0.0 OR (c)-[:PLACED]->(:Order {orderstatus: 'P'}) RETURN count(*) AS n", "SELECT count(*) AS n FROM customer WHERE c_acctbal < 0 OR c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')"),
    "pattern_comprehension": ("MATCH (r:Region) WITH r.name AS r, [(r)<-[:IN_REGION]-(n:Nation) WHERE n.nationkey > 3 | n.name] AS names UNWIND names AS n RETURN r, n, size(names) AS k", "SELECT r_name AS r, n_name AS n, count(*) OVER (PARTITION BY r_name) AS k FROM region JOIN nation ON r_regionkey = n_regionkey WHERE n_nationkey > 3"),
    "var_length_1_3": ("MATCH (a:Event)-[r:NEXT*1..3]->(b:Event) RETURN size(r) AS hops, b.event_type AS t, count(*) AS n", f"WITH RECURSIVE n AS ({_NEXT}), p AS (SELECT b, 1 AS d FROM n UNION ALL SELECT n.b, d + 1 FROM p JOIN n ON p.b = n.a WHERE d < 3) SELECT d::BIGINT AS hops, event_type AS t, count(*) AS n FROM p JOIN events ON b = event_id GROUP BY 1, 2"),
    "var_length_zero": ("MATCH (a:Event {event_type: 'click'})-[:NEXT*0..2]->(b:Event) RETURN b.event_type AS t, count(*) AS n", f"WITH RECURSIVE n AS ({_NEXT}), p AS (SELECT event_id AS b, 0 AS d FROM events WHERE event_type = 'click' UNION ALL SELECT n.b, d + 1 FROM p JOIN n ON p.b = n.a WHERE d < 2) SELECT event_type AS t, count(*) AS n FROM p JOIN events ON b = event_id GROUP BY 1"),
    "var_length_undirected": ("MATCH (a:Nation)-[r:IN_REGION*2..2]-(b:Nation) RETURN a.name AS a, count(b) AS n", "SELECT a.n_name AS a, count(*) AS n FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey <> b.n_nationkey GROUP BY 1"),
    "var_length_rel_list": ("MATCH (a:Order)-[rs:CONTAINS*1..1]->(p:Part) UNWIND rs AS r RETURN r.linestatus AS s, count(*) AS n, sum(r.quantity) AS q", "SELECT l_linestatus AS s, count(*) AS n, sum(l_quantity) AS q FROM lineitem GROUP BY 1"),
    "named_path_length": ("MATCH p = (u:User)-[:DID]->(e:Event)-[:NEXT*1..2]->(f:Event) RETURN u.user_id AS u, length(p) AS l, count(*) AS n, max(size(nodes(p))) AS k", f"WITH RECURSIVE n AS ({_NEXT}), p AS (SELECT a, b, 1 AS d FROM n UNION ALL SELECT p.a, n.b, d + 1 FROM p JOIN n ON p.b = n.a WHERE d < 2) SELECT user_id AS u, (d + 1)::BIGINT AS l, count(*) AS n, (max(d) + 2)::BIGINT AS k FROM p JOIN events ON a = event_id GROUP BY 1, 2"),
    "shortest_path": ("MATCH (a:Nation), (b:Nation) WHERE a.nationkey < b.nationkey MATCH p = shortestPath((a)-[:IN_REGION*..4]-(b)) RETURN a.name AS a, b.name AS b, length(p) AS l", "SELECT a.n_name AS a, b.n_name AS b, CASE WHEN a.n_regionkey = b.n_regionkey THEN 2::BIGINT END AS l FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey"),
    "carried_relationship": ("MATCH (n:Nation)-[r:IN_REGION]->(x:Region) WITH n, r MATCH (n)-[r]->(y:Region) RETURN n.name AS n, y.name AS r", "SELECT n_name AS n, r_name AS r FROM nation JOIN region ON n_regionkey = r_regionkey"),
    "group_count_sum_avg_min_max": ("MATCH (:Order)-[r:CONTAINS]->(:Part) RETURN r.returnflag AS f, r.linestatus AS s, count(*) AS n, round(sum(r.extendedprice)) AS total, round(avg(r.quantity) * 1000.0) AS q, min(r.tax) AS lo, max(r.tax) AS hi", "SELECT l_returnflag AS f, l_linestatus AS s, count(*) AS n, round(sum(l_extendedprice)) AS total, round(avg(l_quantity) * 1000) AS q, min(l_tax) AS lo, max(l_tax) AS hi FROM lineitem GROUP BY 1, 2"),
    "count_distinct": ("MATCH (o:Order)-[r:CONTAINS]->(p:Part) RETURN o.orderstatus AS s, count(DISTINCT p) AS parts, count(DISTINCT r.suppkey) AS supps", "SELECT o_orderstatus AS s, count(DISTINCT l_partkey) AS parts, count(DISTINCT l_suppkey) AS supps FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1"),
    "collect_sorted": ("MATCH (n:Nation)-[:IN_REGION]->(r:Region) WITH r, n ORDER BY n.name RETURN r.name AS r, size(collect(n.name)) AS k, size(collect(DISTINCT n.regionkey)) AS d", "SELECT r_name AS r, count(*) AS k, count(DISTINCT n_regionkey) AS d FROM region JOIN nation ON r_regionkey = n_regionkey GROUP BY 1"),
    "percentile_cont": ("MATCH (c:Customer) RETURN c.mktsegment AS s, round(percentileCont(c.acctbal, 0.3) * 100.0) AS p", "SELECT c_mktsegment AS s, round(quantile_cont(c_acctbal, 0.3) * 100) AS p FROM customer GROUP BY 1"),
    "percentile_disc": ("MATCH (c:Customer) RETURN c.mktsegment AS s, percentileDisc(c.acctbal, 0.3) AS p", "SELECT c_mktsegment AS s, quantile_disc(c_acctbal, 0.3) AS p FROM customer GROUP BY 1"),
    "composed_aggregate": ("MATCH (o:Order) RETURN o.orderstatus AS s, count(*) * 2 + 1 AS a, max(o.totalprice) - min(o.totalprice) AS spread", "SELECT o_orderstatus AS s, count(*) * 2 + 1 AS a, max(o_totalprice) - min(o_totalprice) AS spread FROM orders GROUP BY 1"),
    "global_agg_empty": ("MATCH (n:Nobody) RETURN count(*) AS n, sum(n.x) AS s, size(collect(n.x)) AS c, avg(n.x) AS a", "SELECT 0::BIGINT AS n, 0::BIGINT AS s, 0::BIGINT AS c, NULL::DOUBLE AS a"),
    "with_having": ("MATCH (c:Customer)-[:PLACED]->(o:Order) WITH c, count(o) AS n, sum(o.totalprice) AS total WHERE n > 10 RETURN c.name AS name, n, round(total) AS total", "SELECT c_name AS name, count(*) AS n, round(sum(o_totalprice)) AS total FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey, c_name HAVING count(*) > 10"),
    "with_order_limit_then_match": ("MATCH (c:Customer) WITH c ORDER BY c.acctbal DESC, c.custkey LIMIT 10 MATCH (c)-[:PLACED]->(o:Order) RETURN c.custkey AS k, count(o) AS n", "SELECT c_custkey AS k, count(*) AS n FROM (SELECT * FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 10) JOIN orders ON c_custkey = o_custkey GROUP BY 1"),
    "with_limit_then_where": ("MATCH (c:Customer) WITH c ORDER BY c.custkey LIMIT 20 WHERE c.acctbal > 0.0 RETURN c.custkey AS k", "SELECT c_custkey AS k FROM (SELECT * FROM customer ORDER BY c_custkey LIMIT 20) WHERE c_acctbal > 0"),
    "return_distinct": ("MATCH (p:Part) RETURN DISTINCT p.brand AS b, p.size AS s", "SELECT DISTINCT p_brand AS b, p_size::BIGINT AS s FROM part"),
    "order_nulls": ("MATCH (o:Order) OPTIONAL MATCH (o)-[r:CONTAINS]->(:Part) WHERE r.quantity > 49.5 WITH o.orderkey AS k, max(r.quantity) AS q RETURN k, q ORDER BY q DESC, k LIMIT 25", "SELECT o_orderkey AS k, max(l_quantity) AS q FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey AND l_quantity > 49.5 GROUP BY 1 ORDER BY q DESC NULLS FIRST, k LIMIT 25"),
    "skip_limit_topk": ("MATCH (o:Order) RETURN o.orderkey AS k, o.totalprice AS p ORDER BY p DESC, k SKIP 5 LIMIT 10", "SELECT o_orderkey AS k, o_totalprice AS p FROM orders ORDER BY p DESC, k LIMIT 10 OFFSET 5"),
    "union": ("MATCH (n:Nation) RETURN n.regionkey AS k UNION MATCH (r:Region) RETURN r.regionkey AS k", "SELECT n_regionkey::BIGINT AS k FROM nation UNION SELECT r_regionkey FROM region"),
    "union_all": ("MATCH (n:Nation) RETURN n.name AS k UNION ALL MATCH (r:Region) RETURN r.name AS k", "SELECT n_name AS k FROM nation UNION ALL SELECT r_name FROM region"),
    "unwind_literal": ("UNWIND [1, 2, null, 4] AS x RETURN x, x * x AS y", "SELECT x, x * x AS y FROM (VALUES (1::BIGINT), (2), (NULL), (4)) t(x)"),
    "unwind_collect_roundtrip": ("MATCH (n:Nation)-[:IN_REGION]->(r:Region) WITH r.name AS r, collect(n.nationkey) AS ks UNWIND ks AS k RETURN r, k", "SELECT r_name AS r, n_nationkey::BIGINT AS k FROM nation JOIN region ON n_regionkey = r_regionkey"),
    "list_comprehension": ("MATCH (p:Part) WITH p.partkey AS k, [x IN range(1, p.size) WHERE x % 3 = 0 | x * 10] AS l RETURN k, size(l) AS n, head(l) AS h, last(l) AS t", "SELECT p_partkey AS k, (p_size // 3)::BIGINT AS n, CASE WHEN p_size >= 3 THEN 30::BIGINT END AS h, CASE WHEN p_size >= 3 THEN (p_size // 3 * 30)::BIGINT END AS t FROM part"),
    "quantifiers": ("MATCH (p:Part) WITH p.partkey AS k, range(1, p.size) AS l RETURN k, all(x IN l WHERE x > 0) AS a, any(x IN l WHERE x = 25) AS b, none(x IN l WHERE x > 40) AS c, single(x IN l WHERE x % 20 = 0) AS d", "SELECT p_partkey AS k, true AS a, p_size >= 25 AS b, p_size <= 40 AS c, p_size // 20 = 1 AS d FROM part"),
    "exists_pattern_column": ("MATCH (c:Customer) RETURN exists((c)-[:PLACED]->()) AS has, count(*) AS n", "SELECT c_custkey IN (SELECT o_custkey FROM orders) AS has, count(*) AS n FROM customer GROUP BY 1"),
    "mixed_case": ("MATCH (p:Part) WITH CASE WHEN p.size < 10 THEN 'small' ELSE p.size END AS s RETURN toString(s) AS s, count(*) AS n", "SELECT CASE WHEN p_size < 10 THEN 'small' ELSE p_size::VARCHAR END AS s, count(*) AS n FROM part GROUP BY 1"),
    "mixed_filter": ("MATCH (p:Part) UNWIND [p.size, p.brand] AS v WITH v WHERE v > 40 RETURN count(*) AS n, max(toInteger(v)) AS top", "SELECT count(*) AS n, max(p_size)::BIGINT AS top FROM part WHERE p_size > 40"),
    "maps_of_different_keys": ("UNWIND [{a: 1}, {a: 2, b: 'y'}] AS m RETURN m.a AS a, m.b AS b", "SELECT a, b FROM (VALUES (1::BIGINT, NULL), (2, 'y')) t(a, b)"),
    "list_index_slice": ("MATCH (p:Part) WITH p.partkey AS k, range(0, p.size) AS l RETURN k, l[1] AS a, l[-1] AS b, size(l[2..4]) AS c, l[100] AS d, reverse(l)[0] AS e", "SELECT p_partkey AS k, 1::BIGINT AS a, p_size::BIGINT AS b, least(greatest(p_size + 1 - 2, 0), 2)::BIGINT AS c, NULL::BIGINT AS d, p_size::BIGINT AS e FROM part"),
    "case_simple": ("MATCH (o:Order) RETURN CASE o.orderstatus WHEN 'F' THEN 'finished' WHEN 'O' THEN 'open' ELSE 'other' END AS s, count(*) AS n", "SELECT CASE o_orderstatus WHEN 'F' THEN 'finished' WHEN 'O' THEN 'open' ELSE 'other' END AS s, count(*) AS n FROM orders GROUP BY 1"),
    "case_searched": ("MATCH (p:Part) RETURN CASE WHEN p.size < 10 THEN 1 WHEN p.size < 30 THEN 2 END AS c, count(*) AS n", "SELECT CASE WHEN p_size < 10 THEN 1::BIGINT WHEN p_size < 30 THEN 2 END AS c, count(*) AS n FROM part GROUP BY 1"),
    "string_functions": ("MATCH (n:Nation) RETURN n.name AS n, toUpper(n.name) AS u, toLower(left(n.name, 3)) AS l, right(n.name, 2) AS r, substring(n.name, 1, 3) AS s, replace(n.name, 'A', 'bb') AS p, reverse(n.name) AS v, size(n.name) AS k, split(n.name, '_')[1] AS t, trim('  ' + n.name + ' ') AS w", "SELECT n_name AS n, upper(n_name) AS u, lower(left(n_name, 3)) AS l, right(n_name, 2) AS r, substring(n_name, 2, 3) AS s, replace(n_name, 'A', 'bb') AS p, reverse(n_name) AS v, length(n_name) AS k, string_split(n_name, '_')[2] AS t, n_name AS w FROM nation"),
    "string_predicates": ("MATCH (p:Part) WHERE p.name STARTS WITH 'p' OR p.type CONTAINS 'BRASS' OR p.brand ENDS WITH '3' RETURN count(*) AS n", "SELECT count(*) AS n FROM part WHERE starts_with(p_name, 'p') OR contains(p_type, 'BRASS') OR suffix(p_brand, '3')"),
    "math_functions": ("MATCH (c:Customer) RETURN c.custkey AS k, abs(c.acctbal) AS a, ceil(c.acctbal) AS b, floor(c.acctbal) AS f, round(c.acctbal) AS r, sign(c.acctbal) AS s, c.custkey / 7 AS q, c.custkey % 7 AS m, c.custkey ^ 2 AS p", "SELECT c_custkey AS k, abs(c_acctbal) AS a, ceil(c_acctbal) AS b, floor(c_acctbal) AS f, round(c_acctbal) AS r, sign(c_acctbal)::BIGINT AS s, c_custkey // 7 AS q, c_custkey % 7 AS m, (c_custkey * c_custkey)::DOUBLE AS p FROM customer"),
    "conversions": ("MATCH (p:Part) RETURN p.partkey AS k, toInteger('1.7') AS a, toFloat(toString(p.size)) AS b, toBoolean('TRUE') AS c, toInteger('x') AS d, toString(p.partkey) AS e, coalesce(null, p.size, 0) AS f", "SELECT p_partkey AS k, 1::BIGINT AS a, p_size::DOUBLE AS b, true AS c, NULL::BIGINT AS d, p_partkey::VARCHAR AS e, p_size::BIGINT AS f FROM part"),
    "null_logic": ("UNWIND [true, false, null] AS a UNWIND [true, false, null] AS b RETURN a, b, a AND b AS c, a OR b AS d, a XOR b AS e, NOT a AS f, a = b AS g, a IS NULL AS h", "SELECT a, b, a AND b AS c, a OR b AS d, xor(a::INT, b::INT)::BOOLEAN AS e, NOT a AS f, a = b AS g, a IS NULL AS h FROM (VALUES (true), (false), (NULL)) x(a) CROSS JOIN (VALUES (true), (false), (NULL)) y(b)"),
    "in_list": ("MATCH (o:Order) WHERE o.orderpriority IN ['1-URGENT', '5-LOW'] AND NOT o.orderstatus IN ['P'] RETURN o.orderpriority AS p, count(*) AS n", "SELECT o_orderpriority AS p, count(*) AS n FROM orders WHERE o_orderpriority IN ('1-URGENT', '5-LOW') AND o_orderstatus <> 'P' GROUP BY 1"),
    "date_components": ("MATCH (o:Order) WITH date(o.orderdate) AS d RETURN d.year AS y, d.quarter AS q, d.week AS w, d.dayOfWeek AS dow, count(*) AS n, max(d.ordinalDay) AS doy", "SELECT year(d)::BIGINT AS y, quarter(d)::BIGINT AS q, weekofyear(d)::BIGINT AS w, isodow(d)::BIGINT AS dow, count(*) AS n, max(dayofyear(d))::BIGINT AS doy FROM (SELECT o_orderdate::DATE AS d FROM orders) GROUP BY 1, 2, 3, 4"),
    "date_truncate": ("MATCH (o:Order) RETURN date.truncate('month', date(o.orderdate)) AS m, count(*) AS n", "SELECT date_trunc('month', o_orderdate)::DATE AS m, count(*) AS n FROM orders GROUP BY 1"),
    "duration_add": ("MATCH (o:Order) WITH date(o.orderdate) AS d RETURN d + duration({months: 1, days: 3}) AS e, count(*) AS n", "SELECT (d + INTERVAL 1 MONTH + INTERVAL 3 DAY)::DATE AS e, count(*) AS n FROM (SELECT o_orderdate::DATE AS d FROM orders) GROUP BY 1"),
    "duration_between": ("MATCH (e:Event)-[:NEXT]->(f:Event) WITH duration.inSeconds(e.ts, f.ts) AS d RETURN count(*) AS n, sum(d.seconds) AS s, max(d.hours) AS h", f"SELECT count(*) AS n, sum(floor((epoch_us(y.ts) - epoch_us(x.ts)) / 1000000))::BIGINT AS s, max((epoch_us(y.ts) - epoch_us(x.ts)) // 3600000000)::BIGINT AS h FROM ({_NEXT}) JOIN events x ON x.event_id = a JOIN events y ON y.event_id = b"),
    "label_predicate": ("MATCH (x)-[:IN_NATION]->(n:Nation) WHERE x:Supplier RETURN n.name AS n, count(x) AS k", "SELECT n_name AS n, count(*) AS k FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1"),
    "map_projection_literal": ("MATCH (n:Nation) WITH {name: n.name, k: n.nationkey + 1} AS m RETURN m.name AS name, m['k'] AS k, keys(m)[0] AS first", "SELECT n_name AS name, (n_nationkey + 1)::BIGINT AS k, 'name' AS first FROM nation"),
    "node_properties": ("MATCH (r:Region) WITH r, properties(r) AS p RETURN p.name AS name, size(keys(r)) AS n, r.name IS NOT NULL AS has", "SELECT r_name AS name, 2::BIGINT AS n, true AS has FROM region"),
    "start_end_node": ("MATCH (n:Nation)-[r:IN_REGION]->(x:Region) RETURN n.name AS n, id(startNode(r)) = id(n) AS a, endNode(r) = x AS b", "SELECT n_name AS n, true AS a, true AS b FROM nation"),
    "call_db_labels": ("CALL db.labels() YIELD label, count AS n RETURN label, n", "SELECT 'Region' AS label, count(*) AS n FROM region UNION ALL SELECT 'Nation', count(*) FROM nation UNION ALL SELECT 'Customer', count(*) FROM customer UNION ALL SELECT 'Supplier', count(*) FROM supplier UNION ALL SELECT 'Part', count(*) FROM part UNION ALL SELECT 'Order', count(*) FROM orders UNION ALL SELECT 'Event', count(*) FROM events UNION ALL SELECT 'User', count(DISTINCT user_id) FROM events"),
    "call_db_relationship_types": ("CALL db.relationshipTypes() YIELD relationshipType AS t, count AS n RETURN t, n", f"SELECT 'IN_REGION' AS t, count(*) AS n FROM nation UNION ALL SELECT 'IN_NATION', (SELECT count(*) FROM customer) + (SELECT count(*) FROM supplier) UNION ALL SELECT 'PLACED', count(*) FROM orders UNION ALL SELECT 'CONTAINS', count(*) FROM lineitem UNION ALL SELECT 'DID', count(*) FROM events UNION ALL SELECT 'SUPPLIES', count(*) FROM ({_SUPPLIES}) UNION ALL SELECT 'NEXT', count(*) FROM ({_NEXT})"),
    "call_db_property_keys": ("CALL db.propertyKeys() YIELD propertyKey AS k WHERE k STARTS WITH 'n' RETURN k", "SELECT * FROM (VALUES ('name'), ('nationkey')) t(k)"),
    "shortest_path_events": ("MATCH (a:Event)-[:NEXT*5..5]->(b:Event) MATCH p = shortestPath((a)-[:NEXT*]->(b)) RETURN a.event_id AS a, b.event_id AS b, length(p) AS l, size(nodes(p)) AS k", "SELECT event_id AS a, b, 5::BIGINT AS l, 6::BIGINT AS k FROM (SELECT event_id, lead(event_id, 5) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events) WHERE b IS NOT NULL"),
    "shortest_path_lengths": ("MATCH (a:Event {event_type: 'click'})-[:NEXT]->(b:Event) MATCH p = shortestPath((b)-[:NEXT*]-(a)) RETURN length(p) AS l, count(*) AS n", f"SELECT 1::BIGINT AS l, count(*) AS n FROM ({_NEXT}) JOIN events ON event_id = a WHERE event_type = 'click'"),
    "collect_content": ("MATCH (n:Nation)-[:IN_REGION]->(r:Region) WITH r, n ORDER BY n.name DESC WITH r, collect(n.name) AS l RETURN r.name AS r, l[0] AS a, l[1] AS b, l[-1] AS z, 'NATION_1' IN l AS has", "SELECT r_name AS r, l[1] AS a, l[2] AS b, l[-1] AS z, list_contains(l, 'NATION_1') AS has FROM (SELECT r_name, list(n_name ORDER BY n_name DESC) AS l FROM region JOIN nation ON r_regionkey = n_regionkey GROUP BY 1)"),
    "return_star": ("MATCH (n:Nation) WITH n.name AS name, n.nationkey AS k RETURN *", "SELECT n_name AS name, n_nationkey::BIGINT AS k FROM nation"),
    "sum_types": ("MATCH (p:Part) RETURN p.brand AS b, sum(p.size) AS whole, sum(DISTINCT p.size) AS once, sum(null) AS nothing", "SELECT p_brand AS b, sum(p_size)::BIGINT AS whole, sum(DISTINCT p_size)::BIGINT AS once, 0::BIGINT AS nothing FROM part GROUP BY 1"),
    "list_order_nulls": ("UNWIND [[null], [1], [1, 2], [], [1, null], [0, 9], null] AS l WITH l ORDER BY l WITH collect(size(l)) AS s, collect(l[0]) AS f RETURN s[0] AS a, s[1] AS b, s[2] AS c, s[3] AS d, f[0] AS e, f[3] AS g", "SELECT 0::BIGINT AS a, 2::BIGINT AS b, 1::BIGINT AS c, 2::BIGINT AS d, 0::BIGINT AS e, 1::BIGINT AS g"),
    "list_comparison": ("MATCH (p:Part) WITH [p.size, p.brand = 'Brand#11'] AS x, p RETURN p.partkey AS k, [p.size, 1] = [p.size, 1] AS a, [p.size, null] = [p.size, 1] AS b, [p.size] < [25] AS c, [1, p.size] >= [1, 25, 0] AS d, {a: p.size} = {a: 25} AS e, size(x) AS f", "SELECT p_partkey AS k, true AS a, NULL::BOOLEAN AS b, p_size < 25 AS c, p_size > 25 AS d, p_size = 25 AS e, 2::BIGINT AS f FROM part"),
    "group_by_list": ("MATCH (p:Part) RETURN [p.brand, p.type][0] AS b, [p.size % 3, p.size % 2][1] AS m, count(*) AS n", "SELECT p_brand AS b, (p_size % 2)::BIGINT AS m, count(*) AS n FROM part GROUP BY 1, 2"),
    "list_operators": ("MATCH (p:Part) WITH p, [1, 2] + p.size + [0] AS l RETURN p.partkey AS k, size(l) AS n, l[2] AS s, tail(l)[0] AS t, 2 IN l AS two, -p.size AS neg, sqrt(p.size * p.size) AS q", "SELECT p_partkey AS k, 4::BIGINT AS n, p_size::BIGINT AS s, 2::BIGINT AS t, true AS two, -p_size::BIGINT AS neg, p_size::DOUBLE AS q FROM part"),
    "xor_precedence": ("MATCH (p:Part) WHERE p.size > 10 XOR p.size > 20 AND NOT p.size = 30 OR p.size = 1 RETURN p.size AS s, count(*) AS n", "SELECT p_size::BIGINT AS s, count(*) AS n FROM part WHERE ((p_size > 10) <> (p_size > 20 AND NOT p_size = 30)) OR p_size = 1 GROUP BY 1"),
    "float_text": ("MATCH (o:Order) RETURN o.orderkey AS k, toString(o.totalprice * 100.0 >= 0.0) AS b, toString(1e20) AS big, toString(2.5) AS frac", "SELECT o_orderkey AS k, (o_totalprice >= 0)::VARCHAR AS b, '100000000000000000000' AS big, '2.5' AS frac FROM orders"),
    "datetime_parts": ("MATCH (e:Event) WITH localdatetime(e.ts) AS t RETURN t.year AS y, t.month AS m, t.hour AS h, count(*) AS n, max(t.minute) AS mi, max(t.second) AS s", "SELECT year(ts)::BIGINT AS y, month(ts)::BIGINT AS m, hour(ts)::BIGINT AS h, count(*) AS n, max(minute(ts))::BIGINT AS mi, max(second(ts))::BIGINT AS s FROM events GROUP BY 1, 2, 3"),
    "date_from_map_and_text": ("MATCH (o:Order) WITH date(o.orderdate) AS d WITH d, date({year: d.year, month: d.month, day: 1}) AS a, date(toString(d)) AS b RETURN a AS a, count(*) AS n, min(b) AS lo, max(b) AS hi", "SELECT date_trunc('month', o_orderdate)::DATE AS a, count(*) AS n, min(o_orderdate::DATE) AS lo, max(o_orderdate::DATE) AS hi FROM orders GROUP BY 1"),
    "time_components": ("MATCH (e:Event) WITH localtime(e.ts) AS t RETURN t.hour AS h, count(*) AS n, max(t.minute) AS m, max(t.millisecond) AS ms", "SELECT hour(ts)::BIGINT AS h, count(*) AS n, max(minute(ts))::BIGINT AS m, max((epoch_us(ts) // 1000) % 1000)::BIGINT AS ms FROM events GROUP BY 1"),
    "duration_exact": ("MATCH (e:Event) WITH duration({seconds: 1234567890 + e.event_id, nanoseconds: 1}) AS d RETURN count(*) AS n, min(d.nanosecondsOfSecond) AS lo, max(d.nanosecondsOfSecond) AS hi, max(d.seconds) AS s", "SELECT count(*) AS n, 1::BIGINT AS lo, 1::BIGINT AS hi, (1234567890 + max(event_id))::BIGINT AS s FROM events"),
    "duration_scaled": ("MATCH (o:Order) WITH date(o.orderdate) AS d RETURN d + duration({days: 2}) * 3 - duration('P1D') AS e, count(*) AS n", "SELECT (o_orderdate::DATE + INTERVAL 5 DAY)::DATE AS e, count(*) AS n FROM orders GROUP BY 1"),
    "unwind_nested": ("UNWIND [[1, 2], [], [3]] AS l UNWIND l AS x RETURN x, size(l) AS n", "SELECT x, n FROM (VALUES (1::BIGINT, 2::BIGINT), (2, 2), (3, 1)) t(x, n)"),
    "var_length_row_properties": ("UNWIND [1, 2, 5] AS k MATCH (o:Order)-[rs:CONTAINS*1..2 {linenumber: k}]-(x) RETURN k, size(rs) AS h, count(*) AS n", "WITH l AS (SELECT l_linenumber AS k, l_partkey, count(*) AS n FROM lineitem WHERE l_linenumber IN (1, 2, 5) GROUP BY 1, 2) SELECT k::BIGINT AS k, h, n FROM (SELECT k, 1::BIGINT AS h, sum(n)::BIGINT AS n FROM l GROUP BY 1 UNION ALL SELECT k, 2, sum(n * (n - 1))::BIGINT FROM l GROUP BY 1) WHERE n > 0"),
    "middle_start": ("MATCH (c:Customer)-[:PLACED]->(o:Order {orderstatus: 'F'})-[i:CONTAINS]->(p:Part) RETURN c.mktsegment AS s, p.brand AS b, count(*) AS n, sum(i.quantity) AS q", "SELECT c_mktsegment AS s, p_brand AS b, count(*) AS n, sum(l_quantity) AS q FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey WHERE o_orderstatus = 'F' GROUP BY 1, 2"),
    "date_truncate_units": ("MATCH (o:Order) WITH date(o.orderdate) AS d RETURN date.truncate('week', d) AS w, date.truncate('quarter', d) AS q, date.truncate('year', d) AS y, date.truncate('decade', d) AS e, count(*) AS n", "SELECT date_trunc('week', d)::DATE AS w, date_trunc('quarter', d)::DATE AS q, date_trunc('year', d)::DATE AS y, date_trunc('decade', d)::DATE AS e, count(*) AS n FROM (SELECT o_orderdate::DATE AS d FROM orders) GROUP BY ALL"),
    "datetime_zones": ("MATCH (e:Event) WITH 1 + e.event_id % 12 AS m WITH m, datetime({year: 2020, month: m, day: 1, hour: 12, timezone: 'Europe/Berlin'}) AS t RETURN m, t.offset AS o, t.timezone AS z, t.epochSeconds AS s, count(*) AS n", "SELECT m, CASE WHEN m BETWEEN 4 AND 10 THEN '+02:00' ELSE '+01:00' END AS o, 'Europe/Berlin' AS z, (epoch(make_date(2020, m::INT, 1)) + 3600 * CASE WHEN m BETWEEN 4 AND 10 THEN 10 ELSE 11 END)::BIGINT AS s, n FROM (SELECT (1 + event_id % 12)::BIGINT AS m, count(*) AS n FROM events GROUP BY 1)"),
    "temporal_text": ("MATCH (o:Order) WITH date(o.orderdate) AS d RETURN toString(d) AS t, toString(localdatetime({date: d, hour: 9, minute: 5})) AS l, toString(duration({days: d.day, hours: 2})) AS p, date(toString(d)) = d AS same, count(*) AS n", "SELECT strftime(d, '%Y-%m-%d') AS t, strftime(d, '%Y-%m-%dT09:05') AS l, 'P' || day(d) || 'DT2H' AS p, true AS same, count(*) AS n FROM (SELECT o_orderdate::DATE AS d FROM orders) GROUP BY ALL"),
    "match_rel_list": ("MATCH (a:Event {event_type: 'click'})-[rs:NEXT*2..2]->(b:Event) WITH rs MATCH (x:Event)-[rs:NEXT*]->(y:Event) RETURN x.event_type AS s, y.event_type AS t, count(*) AS n", f"SELECT x.event_type AS s, y.event_type AS t, count(*) AS n FROM ({_NEXT}) f JOIN ({_NEXT}) g ON f.b = g.a JOIN events x ON x.event_id = f.a JOIN events y ON y.event_id = g.b WHERE x.event_type = 'click' GROUP BY 1, 2"),
    "order_by_aggregate": ("MATCH (c:Customer) RETURN c.nationkey AS k, count(*) AS n ORDER BY sum(c.acctbal) DESC, k LIMIT 5", "SELECT c_nationkey::BIGINT AS k, count(*) AS n FROM customer GROUP BY 1 ORDER BY sum(c_acctbal) DESC, k LIMIT 5"),
    "sort_scope": ("MATCH (o:Order) WHERE o.totalprice > 1000 RETURN o.orderkey AS k, o.orderstatus AS totalprice ORDER BY o.totalprice DESC, k LIMIT 10", "SELECT o_orderkey AS k, o_orderstatus AS totalprice FROM orders WHERE o_totalprice > 1000 ORDER BY o_totalprice DESC, k LIMIT 10"),
    "map_comparison": ("MATCH (p:Part) WITH {a: p.size, b: p.brand} AS m RETURN m = {b: 'Brand#11', a: 25} AS e, m <> {a: 25, b: 'Brand#11'} AS d, m = {a: 25} AS f, {a: m.a, b: null} = {a: 25, b: null} AS g, count(*) AS n", "SELECT p_size = 25 AND p_brand = 'Brand#11' AS e, NOT (p_size = 25 AND p_brand = 'Brand#11') AS d, false AS f, CASE WHEN p_size <> 25 THEN false END AS g, count(*) AS n FROM part GROUP BY 1, 2, 4"),
    "unary_signs": ("MATCH (p:Part) RETURN p.partkey AS k, -p.size AS a, +p.size AS b, - -p.size AS c, -p.size ^ 2 AS d, 2 - -p.size * 3 AS e, -(p.size % 7) AS f", "SELECT p_partkey AS k, (-p_size)::BIGINT AS a, p_size::BIGINT AS b, p_size::BIGINT AS c, power(-p_size, 2)::DOUBLE AS d, (2 + p_size * 3)::BIGINT AS e, (-(p_size % 7))::BIGINT AS f FROM part"),
    "mixed_instants": ("MATCH (o:Order) WITH CASE o.orderkey % 3 WHEN 0 THEN date(o.orderdate) WHEN 1 THEN o.orderkey ELSE o.orderstatus END AS x RETURN toString(max(x)) AS hi, toString(min(x)) AS lo, count(DISTINCT x) AS n", "SELECT max(o_orderdate::DATE) FILTER (WHERE o_orderkey % 3 = 0)::VARCHAR AS hi, min(o_orderstatus) FILTER (WHERE o_orderkey % 3 = 2) AS lo, count(DISTINCT CASE o_orderkey % 3 WHEN 0 THEN o_orderdate::DATE::VARCHAR WHEN 1 THEN 'k' || o_orderkey ELSE 's' || o_orderstatus END) AS n FROM orders"),
    "instants_order": ("UNWIND [date('2020-02-01'), 3, 'a', localdatetime('2020-01-01T10:00'), null, true, time('10:00Z'), date('2019-12-31'), localtime('23:59')] AS x WITH x ORDER BY x WITH collect(toString(x)) AS l UNWIND range(0, size(l) - 1) AS i RETURN i, l[i] AS t", "SELECT * FROM (VALUES (0::BIGINT, 'a'), (1, 'true'), (2, '3'), (3, '2019-12-31'), (4, '2020-02-01'), (5, '23:59'), (6, '10:00Z'), (7, '2020-01-01T10:00')) v(i, t)"),
    "time_text": ("MATCH (e:Event) WITH time({hour: e.event_id % 24, minute: 5, second: 7, timezone: '+01:00'}) AS t RETURN toString(t) AS t, t.offsetMinutes AS o, count(*) AS n", "SELECT lpad((event_id % 24)::VARCHAR, 2, '0') || ':05:07+01:00' AS t, 60::BIGINT AS o, count(*) AS n FROM events GROUP BY 1"),
    "tail_and_roots": ("MATCH (p:Part) RETURN p.partkey AS k, tail([p.size, p.partkey, 1])[0] AS a, size(tail([p.size])) AS b, sqrt(p.size * p.size) AS c, last(range(1, p.size, 2)) AS d", "SELECT p_partkey AS k, p_partkey::BIGINT AS a, 0::BIGINT AS b, p_size::DOUBLE AS c, CASE WHEN p_size >= 1 THEN (p_size - (p_size - 1) % 2)::BIGINT END AS d FROM part"),
    "datetime_epoch": ("MATCH (e:Event) WITH datetime.fromepochmillis(1600000000000 + e.event_id) AS t RETURN t.year AS y, t.month AS m, t.day AS d, t.hour AS h, t.minute AS i, count(*) AS n, min(t.epochMillis) AS lo", "SELECT year(t)::BIGINT AS y, month(t)::BIGINT AS m, day(t)::BIGINT AS d, hour(t)::BIGINT AS h, minute(t)::BIGINT AS i, count(*) AS n, min(x)::BIGINT AS lo FROM (SELECT 1600000000000 + event_id AS x, make_timestamp((1600000000000 + event_id) * 1000) AS t FROM events) GROUP BY 1, 2, 3, 4, 5"),
    "path_members": ("MATCH p = (n:Nation)-[:IN_REGION]->(:Region) WITH nodes(p) AS l, relationships(p) AS rs RETURN l[0].name AS a, l[1].name AS b, size(l) AS n, [r IN rs | type(r)][0] AS t", "SELECT n_name AS a, r_name AS b, 2::BIGINT AS n, 'IN_REGION' AS t FROM nation JOIN region ON n_regionkey = r_regionkey"),
    "keys_content": ("MATCH (r:Region) UNWIND keys(r) AS k RETURN k, count(*) AS n", "SELECT k, n FROM (SELECT count(*) AS n FROM region), (VALUES ('name'), ('regionkey')) t(k)"),
    "exists_property": ("MATCH (n:Nation) WITH {name: n.name, low: CASE WHEN n.nationkey < 5 THEN 1 END} AS m, n WHERE exists(n.name) RETURN exists(m.low) AS has, m.low IS NULL AS lacks, count(*) AS n", "SELECT n_nationkey < 5 AS has, n_nationkey >= 5 AS lacks, count(*) AS n FROM nation WHERE n_name IS NOT NULL GROUP BY 1, 2"),
    "call_by_row": ("MATCH (r:Region) CALL nations.of(r.regionkey) YIELD name AS n WHERE n ENDS WITH '1' OR n ENDS WITH '2' RETURN r.name AS r, n", "SELECT r_name AS r, n_name AS n FROM region JOIN nation ON n_regionkey = r_regionkey WHERE right(n_name, 1) IN ('1', '2')"),
}

#: name -> (query text, its parameters, SQL)
WITH_PARAMETERS: dict[str, tuple[str, dict, str]] = {
    "parameters": ("MATCH (c:Customer {mktsegment: $seg}) WHERE c.acctbal > $low AND c.nationkey IN $nations RETURN c.nationkey + $more.add AS k, count(*) AS n SKIP $skip", {"seg": "BUILDING", "low": 100.5, "nations": [1, 2, 3, 24], "more": {"add": 100}, "skip": 0}, "SELECT (c_nationkey + 100)::BIGINT AS k, count(*) AS n FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal > 100.5 AND c_nationkey IN (1, 2, 3, 24) GROUP BY 1"),
    "parameter_rows": ("UNWIND $rows AS w MATCH (n:Nation {nationkey: w.k}) RETURN n.name AS n, w.v AS v", {"rows": [{"k": 3, "v": "three"}, {"k": 3, "v": None}, {"k": 99, "v": "none"}]}, "SELECT n_name AS n, v FROM nation JOIN (VALUES (3, 'three'), (3, NULL), (99, 'none')) t(k, v) ON n_nationkey = k"),
}

#: name -> (writing statements, the query that reads the result, SQL)
WRITES: dict[str, tuple[tuple[str, ...], str, str]] = {
    "create_then_match": (("MATCH (n:Nation) CREATE (n)-[:HAS {w: n.nationkey * 2}]->(:Flag {of: n.name})",), "MATCH (n:Nation)-[h:HAS]->(f:Flag) RETURN n.name AS n, f.of AS f, h.w AS w", "SELECT n_name AS n, n_name AS f, (n_nationkey * 2)::BIGINT AS w FROM nation"),
    "merge_dedup": (("MATCH (c:Customer) MERGE (s:Segment {name: c.mktsegment}) ON CREATE SET s.made = true", "MATCH (c:Customer) MERGE (s:Segment {name: c.mktsegment}) ON MATCH SET s.again = true"), "MATCH (s:Segment) RETURN s.name AS name, s.made AS made, s.again AS again", "SELECT DISTINCT c_mktsegment AS name, true AS made, true AS again FROM customer"),
    "set_remove": (("MATCH (n:Nation) WHERE n.nationkey < 10 SET n.low = true, n:Small REMOVE n.name",), "MATCH (n:Nation) RETURN n.nationkey AS k, n.name AS name, n.low AS low, n:Small AS small", "SELECT n_nationkey::BIGINT AS k, CASE WHEN n_nationkey >= 10 THEN n_name END AS name, CASE WHEN n_nationkey < 10 THEN true END AS low, n_nationkey < 10 AS small FROM nation"),
    "set_maps": (("MATCH (n:Nation) WHERE n.nationkey < 5 SET n += {mark: n.nationkey * 2, name: 'low'}", "MATCH (r:Region) SET r = {label: r.name}"), "MATCH (n:Nation)-[:IN_REGION]->(r:Region) RETURN n.nationkey AS k, n.name AS name, n.mark AS mark, r.label AS label, r.name AS gone", "SELECT n_nationkey::BIGINT AS k, CASE WHEN n_nationkey < 5 THEN 'low' ELSE n_name END AS name, CASE WHEN n_nationkey < 5 THEN (n_nationkey * 2)::BIGINT END AS mark, r_name AS label, NULL::VARCHAR AS gone FROM nation JOIN region ON n_regionkey = r_regionkey"),
    "set_relationship": (("MATCH (:Customer)-[r:PLACED]->(o:Order) WHERE o.totalprice > 100000.0 SET r.large = true, r.price = o.totalprice",), "MATCH (:Customer)-[r:PLACED]->(o:Order) RETURN r.large AS large, count(*) AS n, max(r.price) AS top", "SELECT CASE WHEN o_totalprice > 100000 THEN true END AS large, count(*) AS n, max(CASE WHEN o_totalprice > 100000 THEN o_totalprice END) AS top FROM orders GROUP BY 1"),
    "merge_relationship": (("MATCH (c:Customer)-[:IN_NATION]->(n:Nation) WHERE c.acctbal > 0.0 MERGE (n)-[r:HAS_RICH]->(n2:Tag {name: n.name}) ON CREATE SET r.new = true",), "MATCH (n:Nation)-[r:HAS_RICH]->(t:Tag) RETURN n.name AS n, t.name AS t, r.new AS new, count(*) AS k", "SELECT DISTINCT n_name AS n, n_name AS t, true AS new, 1::BIGINT AS k FROM nation JOIN customer ON c_nationkey = n_nationkey WHERE c_acctbal > 0"),
    "delete_paths": (("MATCH p = (e:Event {event_type: 'click'})-[:NEXT]->(f:Event {event_type: 'click'}) DETACH DELETE p",), "MATCH (e:Event) RETURN e.event_type AS t, count(*) AS n", f"WITH n AS ({_NEXT}), pairs AS (SELECT a, b FROM n JOIN events x ON a = x.event_id JOIN events y ON b = y.event_id WHERE x.event_type = 'click' AND y.event_type = 'click') SELECT event_type AS t, count(*) AS n FROM events WHERE event_id NOT IN (SELECT a FROM pairs UNION ALL SELECT b FROM pairs) GROUP BY 1"),
    "index_then_call": (("CREATE INDEX ON :Customer(custkey)",), "CALL db.indexes() YIELD label, property, unique AS u RETURN label, property, u", "SELECT 'Customer' AS label, 'custkey' AS property, false AS u"),
    "detach_delete": (("MATCH (c:Customer) WHERE c.acctbal < 0.0 DETACH DELETE c",), "MATCH (c:Customer)-[:PLACED]->(o:Order) RETURN c.mktsegment AS s, count(*) AS n", "SELECT c_mktsegment AS s, count(*) AS n FROM customer JOIN orders ON c_custkey = o_custkey WHERE c_acctbal >= 0 GROUP BY 1"),
    "delete_relationships": (("MATCH (o:Order)-[r:CONTAINS]->(:Part) WHERE r.returnflag = 'R' DELETE r",), "MATCH (:Order)-[r:CONTAINS]->(:Part) RETURN r.returnflag AS f, count(*) AS n", "SELECT l_returnflag AS f, count(*) AS n FROM lineitem WHERE l_returnflag <> 'R' GROUP BY 1"),
    "rollback": (("BEGIN", "MATCH (r:Region) DETACH DELETE r", "ROLLBACK"), "MATCH (r:Region) RETURN count(*) AS n", "SELECT count(*) AS n FROM region"),
}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return session(spark, sf_dir).cypher(QUERIES["two_hop_building"][0])


def _read(text: str, params: dict | None = None):
    return lambda spark, sf_dir: session(spark, sf_dir).cypher(text, params)


def _write(statements: tuple[str, ...], text: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        s = session(spark, sf_dir)
        for st in statements:
            s.cypher(st)
        return s.cypher(text)

    return run


def integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return session(spark, sf_dir).graph.check_integrity().groupBy("problem").agg(F.count(F.lit(1)).alias("n"))


def queries() -> dict:
    out = {n: _read(q) for n, (q, _) in QUERIES.items()}
    out |= {n: _read(q, p) for n, (q, p, _) in WITH_PARAMETERS.items()}
    out |= {n: _write(w, q) for n, (w, q, _) in WRITES.items()}
    return out | {"check_integrity": integrity}


def oracle_sql() -> dict[str, str]:
    out = {n: sql for n, (_, sql) in QUERIES.items()} | {n: sql for n, (_, _, sql) in (WITH_PARAMETERS | WRITES).items()}
    return out | {"check_integrity": "SELECT '' AS problem, 0::BIGINT AS n WHERE false"}
