"""The graph engine on small graphs: patterns, values, writes, sessions and errors."""

import datetime as dt

import pytest

from graphloom.errors import CypherArithmeticError, CypherSyntaxError, CypherTypeError, GraphError, MissingParameter, ResourceLimit, SemanticError, UnboundVariable
from graphloom.plans.syntax import parse, split_batch
from graphloom.session import GraphSession


def rows(df):
    return [tuple(r) for r in df.collect()]


@pytest.fixture(scope="module")
def harbour(spark):
    """Ships, the ports they call at in turn, and cargo between ports; berth 7 is empty."""
    s = GraphSession.in_memory(spark)
    s.execute_batch("""
    CREATE (k:Port {code: 'KIE', depth: 12}), (o:Port {code: 'OSL', depth: 15}), (r:Port:Hub {code: 'RIG'}),
      (m:Ship {name: 'Mira', crew: 9}), (n:Ship {name: 'Nord', crew: 14}), (t:Ship:Tanker {name: 'Tara', tons: 4000}),
      (m)-[:CALLS {day: 1}]->(k), (m)-[:CALLS {day: 4}]->(o), (n)-[:CALLS {day: 2}]->(o), (n)-[:CALLS {day: 6}]->(r), (t)-[:CALLS {day: 2}]->(r),
      (k)-[:LANE {miles: 300}]->(o), (o)-[:LANE {miles: 500}]->(r), (r)-[:LANE {miles: 700}]->(k),
      (m)-[:ESCORTS]->(t), (b:Berth {number: 7})
    """)
    return s


def test_reads_of_the_harbour(harbour):
    q = lambda text, **p: rows(harbour.cypher(text, p))
    assert q("MATCH (s:Ship {name: $name})-[c:CALLS]->(p:Port) RETURN p.code AS code, c.day AS day ORDER BY day", name="Mira") == [("KIE", 1), ("OSL", 4)]
    assert q("MATCH (a:Ship)-[:CALLS]->(p)<-[:CALLS]-(b:Ship) WHERE a.name < b.name RETURN p.code AS p, a.name AS a, b.name AS b ORDER BY p") == [("OSL", "Mira", "Nord"), ("RIG", "Nord", "Tara")]
    assert q("MATCH (:Port {code: 'KIE'})-[l:LANE*1..3]->(p) RETURN p.code AS p, size(l) AS m ORDER BY m") == [("OSL", 1), ("RIG", 2), ("KIE", 3)]
    assert q("MATCH (s:Ship) RETURN coalesce(s.crew, s.tons) AS x, s:Tanker AS t ORDER BY x") == [(9, False), (14, False), (4000, True)]
    assert q("MATCH (s:Ship {name: 'Tara'})-[:ESCORTS]-(x) RETURN x.name AS x") == [("Mira",)]
    alone = "MATCH (p:Port) OPTIONAL MATCH (p)<-[c:CALLS]-(s:Ship) WHERE c.day > 3 RETURN p.code AS p, s.name AS s ORDER BY p"
    assert q(alone) == [("KIE", None), ("OSL", "Mira"), ("RIG", "Nord")]
    harbour.begin()
    harbour.cypher("MATCH (s:Ship {name: 'Tara'}), (p:Port {code: 'KIE'}) CREATE (s)-[:CALLS {day: 8}]->(p)")
    assert q(alone) == [("KIE", "Tara"), ("OSL", "Mira"), ("RIG", "Nord")]
    harbour.rollback()
    assert q(alone) == [("KIE", None), ("OSL", "Mira"), ("RIG", "Nord")]


def test_existence_in_the_harbour(harbour):
    who = lambda w: [r[0] for r in rows(harbour.cypher(f"MATCH (s:Ship) WHERE {w} RETURN s.name AS n ORDER BY n"))]
    assert who("exists { (s)-[c:CALLS]->(p) WHERE p.depth > 10 * c.day }") == ["Mira"]
    assert who("exists { MATCH (s)-[:CALLS]->(p) WITH s, count(p) AS n WHERE n > 1 RETURN s }") == ["Mira", "Nord"]
    assert who("NOT (s)-[:ESCORTS]-()") == ["Nord"]
    assert who("(s)-[:CALLS]->(:Hub) OR s.crew = 9") == ["Mira", "Nord", "Tara"]
    assert who("(s)-[:CALLS]->(:Hub)") == ["Nord", "Tara"] and who("NOT (s)-[:CALLS {day: 2}]->()") == ["Mira"]
    assert who("exists { (s)-[c:CALLS]->(:Port {code: 'OSL'}) WHERE c.day < 3 }") == ["Nord"]
    assert rows(harbour.cypher("MATCH (b) WHERE NOT (b)--() RETURN labels(b)[0] AS l, b.number AS n")) == [("Berth", 7)]
    with pytest.raises(UnboundVariable):
        who("(s)-->(unknown)")


def test_direct_joins_in_plans(spark, small):
    s = GraphSession.from_tables(spark, small)
    joins = lambda q: s.cypher(q)._jdf.queryExecution().optimizedPlan().toString().count("Join ")
    assert joins("MATCH (o:Order) WHERE (o)-[:CONTAINS]->() RETURN o.orderkey AS k") == 1
    assert joins("MATCH (c:Customer) OPTIONAL MATCH (c)-[:PLACED]->(o:Order) WHERE o.totalprice > 9.0 RETURN c.custkey AS k, o.orderkey AS o") == 2
    assert joins("MATCH (a:Order)-[:CONTAINS]->(p:Part)<-[:CONTAINS]-(b:Order) RETURN p.brand AS b, count(*) AS n") == 1


def test_a_bound_relationship_tells_where_it_begins(spark, small):
    s = GraphSession.from_tables(spark, small)
    plan = lambda q: s.cypher(q)._jdf.queryExecution().executedPlan().toString()
    lists = "MATCH (a:Event {event_type: 'click'})-[rs:NEXT*2..2]->() WITH rs MATCH "
    single = "MATCH (:Event {event_type: 'click'})-[r:NEXT]->() WITH r MATCH "
    for q in (f"{lists} (x:Event)-[rs:NEXT*]->(y:Event)", f"{lists} (x:Event)<-[rs*1..2]-(y)", f"{lists} (x:Event)-[rs*]-(y)", f"{lists} (u:User)-[:DID]->(x)-[rs*]->(y)", f"{single} (x:Event)-[r]->(y)", f"{single} (x)-[r:NEXT]-(y:Event)"):
        text = plan(f"{q} RETURN x.event_type AS s, count(y) AS n")
        assert "NestedLoop" not in text and "Cartesian" not in text, q

    s = GraphSession.in_memory(spark)
    s.cypher("CREATE (a:N {k: 1})-[:E]->(b:N {k: 2})-[:E]->(c:N:M {k: 3})-[:F]->(d:N {k: 4}), (c)-[:E]->(a), (d)-[:E]->(d), (:Z {k: 9})")
    n = lambda first, p: rows(s.cypher(f"{first} WITH q MATCH {p} RETURN x.k AS x, count(*) AS n ORDER BY x"))
    upto2, one, none = "MATCH ()-[q*0..2]->()", "MATCH ()-[q]->()", "OPTIONAL MATCH (:Z)-[q*1..2]->()"
    assert n(upto2, "(x)-[q*]->(y)") == [(1, 2), (2, 3), (3, 4), (4, 1)] and n(upto2, "(x)<-[q*2..2]-(y)") == []
    assert n(upto2, "(x)-[q*1..1]-(y)") == n(one, "(x)-[q]-(y)") == [(1, 2), (2, 2), (3, 3), (4, 2)]
    assert n(upto2, "(x)-[q*0..]->(y)") == [(1, 7), (2, 8), (3, 9), (4, 6), (9, 5)]  # an empty list begins at any node
    assert n(upto2, "(x:M)-[q*0..1]->(y)") == [(3, 7)] and n(upto2, "(x {k: 2})-[q*]->(y:M)") == [(2, 1)]
    assert n(upto2, "(z)-[:E]->(x)-[q*2..2]->(y)") == [(1, 1), (2, 2), (3, 2)] and n(one, "(x)-[q:E]->(x)") == [(4, 1)]
    assert n(none, "(x)-[q*0..]->(y)") == n(none, "(x)-[q*]-(y)") == []  # no list at all
    assert rows(s.cypher("MATCH (a)-[q*2..2]->(b) OPTIONAL MATCH (x)-[q*]->(y:M) RETURN a.k AS a, b.k AS b, x.k AS x ORDER BY a, b")) == [(1, 3, 1), (2, 1, None), (2, 4, None), (3, 2, None), (3, 4, None)]


def test_degrees_against_all_pairs(spark):
    s = GraphSession.in_memory(spark)
    s.cypher("CREATE (a:N {k: 1})-[:E]->(b:N {k: 2})-[:E]->(c:N {k: 3})-[:E]->(a), (a)-[:E]->(a), (a)-[:E]->(c), (a)-[:F]->(c), (b)-[:F]->(c)")
    for pattern in ("(x)-[:E]->(p)<-[:E]-(y)", "(x)<-[:E]-(p)-[:E]->(y)", "(x)-[:E]->(p)-[:F]->(y)", "(x)-[:E]->(p)<-[:F]-(y)", "(x)-[:E]->(p)-[:E]->(y)", "(x)-[:E|F]->(p)<-[:E|F]-(y)"):
        quick = rows(s.cypher(f"MATCH {pattern} RETURN p.k AS k, count(*) AS n ORDER BY k"))
        pairs = rows(s.cypher(f"MATCH {pattern} WITH p, x, y RETURN p.k AS k, count(x) AS n ORDER BY k"))
        assert quick == pairs, pattern
        assert rows(s.cypher(f"MATCH {pattern} RETURN count(*) AS n")) == [(sum(n for _, n in pairs),)]


def test_shortest_paths_of_any_length(spark):
    s = GraphSession.in_memory(spark)
    s.cypher("UNWIND range(1, 40) AS i CREATE (:N {k: i})")
    s.cypher("MATCH (a:N), (b:N) WHERE b.k = a.k + 1 CREATE (a)-[:E]->(b)")
    s.cypher("MATCH (a:N {k: 5}), (b:N {k: 9}) CREATE (a)-[:E]->(b)")
    got = rows(s.cypher("MATCH (a:N {k: 1}), (b:N) WHERE b.k IN [1, 6, 40] MATCH p = shortestPath((a)-[:E*]->(b)) RETURN b.k AS k, length(p) AS l, size(nodes(p)) AS n ORDER BY k"))
    assert got == [(1, None, None), (6, 5, 6), (40, 36, 37)]
    back = rows(s.cypher("MATCH (a:N {k: 40}), (b:N {k: 38}) MATCH p = shortestPath((a)-[:E*]-(b)) UNWIND nodes(p) AS n RETURN n.k AS k"))
    assert back == [(40,), (39,), (38,)]


def test_trails_and_isomorphism(spark):
    s = GraphSession.in_memory(spark)
    s.cypher("CREATE (a:N {k: 1})-[:E]->(b:N {k: 2})-[:E]->(c:N {k: 3})-[:E]->(a), (a)-[:E]->(a)")
    n = lambda q: rows(s.cypher(q))[0][0]
    assert n("MATCH (x)-[r:E]->(y)-[t:E]->(z) RETURN count(*) AS n") == 5
    assert n("MATCH (x)-[:E]-(x) RETURN count(*) AS n") == 1
    assert n("MATCH (x:N {k: 1})-[:E*]->(y) RETURN count(*) AS n") == 8
    assert n("MATCH p = (x:N {k: 1})-[:E*2..3]->(y) RETURN max(length(p)) AS n") == 3
    assert n("MATCH (x)-[r:E]->(y), (x)-[t:E]->(z) RETURN count(*) AS n") == 2
    assert n("MATCH (x:N {k: 2})-[rs:E*2..2]->(y) WITH x, rs MATCH (x)-[rs*]->(z) RETURN z.k AS n") == 1
    assert n("MATCH (a:N {k: 2}), (b:N {k: 1}) MATCH p = shortestPath((a)-[:E*]->(b)) RETURN length(p) AS n") == 2
    assert n("MATCH (a:N {k: 2}), (b:N {k: 1}) MATCH p = shortestPath((a)-[:E*..1]->(b)) RETURN length(p) AS n") is None


def one(spark, text, **params):
    r = rows(GraphSession.in_memory(spark).cypher(f"RETURN {text} AS x", params))
    assert len(r) == 1
    return r[0][0]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("1 + 2 * 3 ^ 2", 19.0), ("7 / 2", 3), ("-7 % 2", -1), ("7.0 / 2", 3.5), ("1.0 / 0.0", float("inf")), ("2 ^ 3 ^ 2", 64.0),
        ("1 < 2 < 3", True), ("1 < 3 < 2", False), ("1 = 1.0", True), ("1 = 'a'", False), ("null = null", None), ("1 < 'a'", None), ("0.0 / 0.0 = 0.0 / 0.0", False),
        ("[1, 2] = [1, null]", None), ("[1, 2] = [1, 3]", False), ("[1] = [1, 2]", False), ("3 IN [1, null]", None), ("1 IN []", False), ("null IN []", False),
        ("true XOR null", None), ("NOT null", None), ("false AND null", False), ("true OR null", True),
        ("'abc' STARTS WITH 'a'", True), ("'abc' ENDS WITH 1", None), ("'a' + 1", "a1"), ("[1] + [2]", [1, 2]), ("[1] + 2", [1, 2]), ("0 + [1]", [0, 1]),
        ("[1, 2, 3][-1]", 3), ("[1, 2, 3][5]", None), ("[1, 2, 3, 4][1..3]", [2, 3]), ("[1, 2, 3][..-1]", [1, 2]), ("{a: 1, b: 'x'}.b", "x"), ("{a: 1}['a']", 1), ("{a: 1}.c", None),
        ("[x IN [1, 2, 3] WHERE x > 1 | x * 2]", [4, 6]), ("all(x IN [1, null] WHERE x > 0)", None), ("any(x IN [1, null] WHERE x > 0)", True), ("none(x IN [] WHERE x > 0)", True), ("single(x IN [1, 2] WHERE x > 1)", True),
        ("CASE null WHEN null THEN 1 ELSE 2 END", 1), ("CASE WHEN 1 > 2 THEN 'a' END", None), ("coalesce(null, 3)", 3),
        ("toInteger('1.7')", 1), ("toInteger('x')", None), ("toFloat('1.5')", 1.5), ("toBoolean('True')", True), ("toString(12)", "12"), ("size('añb')", 3), ("size([1, 2])", 2),
        ("range(1, 5, 2)", [1, 3, 5]), ("range(5, 1)", []), ("range(3, 1, -1)", [3, 2, 1]), ("head([])", None), ("tail([1, 2, 3])", [2, 3]), ("reverse('abc')", "cba"), ("split('a.b', '.')", ["a", "b"]),
        ("substring('hello', 1, 3)", "ell"), ("left('hello', 2)", "he"), ("right('hello', 2)", "lo"), ("trim('\\t a ')", "a"), ("replace('aXa', 'X', 'b')", "aba"),
        ("round(-2.5)", -3.0), ("ceil(1.2)", 2.0), ("sign(-3)", -1), ("abs(-3)", 3), ("sqrt(4)", 2.0), ("keys({b: 1, a: 2})", ["b", "a"]),
        ("date('2015-W30-2')", dt.date(2015, 7, 21)), ("date('2015-202')", dt.date(2015, 7, 21)), ("date({year: 2015, quarter: 3, dayOfQuarter: 21})", dt.date(2015, 7, 21)), ("date('2015-07-21').week", 30), ("date('2015-07-21').dayOfQuarter", 21),
        ("date.truncate('decade', date('2017-05-05'))", dt.date(2010, 1, 1)), ("date.truncate('week', date('2017-05-05'))", dt.date(2017, 5, 1)), ("date('2020-01-31') + duration('P1M')", dt.date(2020, 2, 29)),
        ("toString(duration('P1Y2M3DT4H5M6.5S'))", "P1Y2M3DT4H5M6.5S"), ("duration({days: 1.5}).hours", 12), ("duration.between(date('2020-01-31'), date('2020-03-01')).months", 1), ("duration.inDays(date('2020-01-01'), date('2020-03-01')).days", 60),
        ("localdatetime('2020-01-02T03:04:05').minute", 4), ("toString(localtime('12:31:14.645876123'))", "12:31:14.645876123"), ("toString(localtime({hour: 12, minute: 5}))", "12:05"), ("toString(time('214032+0100'))", "21:40:32+01:00"), ("time('10:00+01:00') = time('09:00Z')", True), ("time('10:00+01:00') < time('09:30Z')", True),
        ("toString(localtime('23:30') + duration('PT1H'))", "00:30"), ("localtime('12:31:14.645').millisecond", 645), ("time('12:31+01:30').offsetMinutes", 90),
        ("toString(datetime('2015-07-21T21:40:32.142+0100'))", "2015-07-21T21:40:32.142+01:00"), ("toString(datetime('2015-07-21T21:40[Europe/Berlin]'))", "2015-07-21T21:40+02:00[Europe/Berlin]"), ("toString(datetime({year: 2020, month: 1, day: 31, hour: 5, timezone: '-02:00'}) + duration('P1MT3H'))", "2020-02-29T08:00-02:00"),
        ("datetime('2020-01-01T01:00+01:00') = datetime('2020-01-01T00:00Z')", True), ("datetime('2020-01-01T01:00+01:00').epochSeconds", 1577836800), ("datetime('2020-01-01T01:00+01:00').hour", 1), ("toString(datetime.truncate('day', datetime('2020-05-01T13:00+02:00')))", "2020-05-01T00:00+02:00"),
        ("toString(localdatetime('2015-W30-2T214032.142'))", "2015-07-21T21:40:32.142"), ("toString(date(datetime('2020-01-01T23:00-05:00')))", "2020-01-01"), ("toString(datetime.fromepochmillis(1000))", "1970-01-01T00:00:01Z"), ("duration.between(localtime('10:00'), localtime('11:30')).minutes", 90),
        ("toString(localtime.truncate('minute', localtime('10:11:12.5')))", "10:11"), ("toString(time({time: localtime('10:11'), timezone: '+01:00'}))", "10:11+01:00"),
        ("(duration('P1D') + duration('PT1H')).seconds", 3600),
        ("toString(duration('P2012-02-02T14:37:21.545'))", "P2012Y2M2DT14H37M21.545S"), ("toString(duration('P0.5Y'))", "P6M"),
        ("toString(date.truncate('year', date('2017-05-05'), {day: 5}))", "2017-01-05"), ("toString(date.truncate('week', date('2017-05-05'), {dayOfWeek: 2}))", "2017-05-02"), ("toString(localdatetime.truncate('day', localdatetime('2017-05-05T10:11'), {hour: 3, millisecond: 7}))", "2017-05-05T03:00:00.007"),
        ("toString(localtime.truncate('millisecond', localtime('10:11:12.345678'), {nanosecond: 2}))", "10:11:12.345000002"), ("toString(time.truncate('hour', time('10:11+02:00'), {minute: 9}))", "10:09+02:00"),
        ("toString(datetime.truncate('year', datetime('2017-05-05T10:00+02:00'), {day: 2}))", "2017-01-02T00:00+02:00"), ("toString(datetime.truncate('month', datetime('2017-05-05T10:00Z'), {timezone: '+03:00'}))", "2017-05-01T00:00+03:00"), ("toString(datetime.truncate('year', datetime('2017-07-05T10:00[Europe/Berlin]')))", "2017-01-01T00:00+01:00[Europe/Berlin]"),
        ("date.truncate('year', null, {day: 5})", None), ("toString(date({date: date('2015-05-12'), dayOfQuarter: 1}))", "2015-04-01"),
        ("toString(datetime({datetime: datetime('2015-01-01T10:00+03:00'), timezone: 'Europe/Stockholm'}))", "2015-01-01T08:00+01:00[Europe/Stockholm]"), ("toString(datetime({datetime: localdatetime('2015-01-01T10:00'), timezone: '+02:00'}))", "2015-01-01T10:00+02:00"),
        ("toString(time({time: time('10:00+01:00'), timezone: '+03:00'}))", "12:00+03:00"), ("toString(time({time: time('10:00+01:00'), hour: 4}))", "04:00+01:00"),
        ("1 IN [[1]]", False), ("1 IN [true]", False), ("1 IN ['a', 1.0]", True), ("2 IN ['a', 1, null]", None), ("'a' IN [1, [2], 'b']", False),
    ],
)
def test_values(spark, text, want):
    assert one(spark, text) == want


def test_three_valued_truth_table(spark):
    v = {"true": True, "false": False, "null": None}
    for a, x in v.items():
        for b, y in v.items():
            want = False if x is False or y is False else None if None in (x, y) else True
            assert one(spark, f"{a} AND {b}") is want
            want = True if x is True or y is True else None if None in (x, y) else False
            assert one(spark, f"{a} OR {b}") is want


def test_parameters_and_temporal_now(spark):
    assert one(spark, "$x + 1", x=2) == 3 and one(spark, "$l[1]", l=[1, 2]) == 2 and one(spark, "$m.a", m={"a": "b"}) == "b"
    assert one(spark, "date() = date()") is True
    with pytest.raises(MissingParameter):
        one(spark, "$nothing")


def test_aggregates(spark):
    s = GraphSession.in_memory(spark)
    q = lambda text: rows(s.cypher(text))
    assert q("UNWIND [1, 2, 2, null] AS x RETURN count(*) AS a, count(x) AS b, count(DISTINCT x) AS c, sum(x) AS d, avg(x) AS e, min(x) AS f, max(x) AS g, size(collect(x)) AS h") == [(4, 3, 2, 5, 5 / 3, 1, 2, 3)]
    assert sorted(q("UNWIND [2, 1, 2] AS x RETURN collect(x) AS l")[0][0]) == [1, 2, 2]
    assert q("UNWIND [] AS x RETURN count(x) AS a, sum(x) AS b, avg(x) AS c, collect(x) AS d") == [(0, 0.0, None, [])]
    assert q("UNWIND [10, 20, 30] AS x RETURN percentileCont(x, 0.25) AS a, percentileDisc(x, 0.5) AS b") == [(15.0, 20)]
    assert q("UNWIND [1, 2, 3, 4] AS x WITH x % 2 AS k, sum(x) + 1 AS s RETURN k, s ORDER BY k") == [(0, 7), (1, 5)]
    assert q("UNWIND [1, 2, 3] AS x RETURN x % 2 AS k, count(*) AS n ORDER BY max(x) DESC") == [(1, 2), (0, 1)]
    assert q("UNWIND [3, 1, null, 2] AS x RETURN x ORDER BY x") == [(1,), (2,), (3,), (None,)]
    assert q("UNWIND [3, 1, null, 2] AS x RETURN x ORDER BY x DESC SKIP 1 LIMIT 2") == [(3,), (2,)]
    assert q("UNWIND [1, 1, 2] AS x WITH DISTINCT x RETURN sum(x) AS s UNION ALL RETURN 3 AS s") == [(3,), (3,)]


def test_collect_keeps_the_order_of_with(spark):
    s, key = GraphSession.in_memory(spark), "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "false")  # so that the sorted rows are in several partitions
    try:
        got = dict(rows(s.cypher("UNWIND range(1, 3000) AS x WITH x, x % 3 AS k ORDER BY (x * 7919) % 3001 DESC WHERE x <> 5 RETURN k, collect(x) AS l")))
        want = sorted((x for x in range(1, 3001) if x != 5), key=lambda x: -((x * 7919) % 3001))
        assert got == {k: [x for x in want if x % 3 == k] for k in range(3)}
        assert rows(s.cypher("UNWIND [3, null, 1, 3, 2] AS x WITH x ORDER BY x DESC RETURN collect(DISTINCT x) AS l, count(*) AS n")) == [([3, 2, 1], 5)]
        assert rows(s.cypher("UNWIND range(1, 50) AS x WITH x ORDER BY x DESC SKIP 2 LIMIT 4 UNWIND [x, -x] AS y WITH collect(y) AS l UNWIND l AS z RETURN sum(z) AS t, max(z) AS m")) == [(0, 48)]
        assert rows(s.cypher("UNWIND [2, 1] AS x WITH x ORDER BY x WITH * RETURN *")) == [(1,), (2,)]
        assert rows(s.cypher("UNWIND [] AS x WITH x ORDER BY x RETURN collect(x) AS l")) == [([],)]
    finally:
        spark.conf.set(key, before)


def test_writes(spark):
    s = GraphSession.in_memory(spark)
    _, st = s.execute_with_stats("UNWIND [1, 2, 2, 3] AS k MERGE (n:K {k: k}) ON CREATE SET n.new = true")
    assert st.nodes_created == 3
    s.cypher("UNWIND [3, 4] AS k MERGE (n:K {k: k}) ON CREATE SET n.new = false ON MATCH SET n.seen = 1")
    assert rows(s.cypher("MATCH (n:K) RETURN n.k AS k, n.new AS a, n.seen AS b ORDER BY k")) == [(1, True, None), (2, True, None), (3, True, 1), (4, False, None)]
    s.cypher("MATCH (a:K {k: 1}), (b:K {k: 2}) MERGE (a)-[r:T {w: 1}]->(b) MERGE (a)-[q:T {w: 1}]->(b)")
    assert rows(s.cypher("MATCH (:K)-[r:T]->(b) RETURN r.w AS w, b.k AS k, type(r) AS t")) == [(1, 2, "T")]
    with pytest.raises(GraphError):
        s.cypher("MATCH (a:K {k: 1}) DELETE a")
    s.cypher("MATCH (a:K) WHERE a.k < 3 SET a:Low, a += {x: a.k * 10, new: null} REMOVE a.seen")
    assert rows(s.cypher("MATCH (a:Low) RETURN a.k AS k, a.x AS x, size(labels(a)) AS l, keys(a) AS ks ORDER BY k")) == [(1, 10, 2, ["k", "x"]), (2, 20, 2, ["k", "x"])]
    _, st = s.execute_with_stats("MATCH (a:Low) DETACH DELETE a")
    assert (st.nodes_deleted, st.relationships_deleted) == (2, 1)
    assert rows(s.cypher("MATCH (n) RETURN count(*) AS n")) == [(2,)]
    s.cypher("CREATE INDEX ON :K(k) UNIQUE")
    with pytest.raises(GraphError):
        s.cypher("CREATE (:K {k: 3})")
    assert rows(s.cypher("CALL db.indexes()")) == [("K", "k", True)]
    with pytest.raises(SemanticError):
        s.cypher("MERGE (n:K {k: null})")


def test_transactions_batches_and_storage(spark, tmp_path):
    s = GraphSession.in_memory(spark)
    s.execute_batch("BEGIN; CREATE (:A {x: 'a;b'}); COMMIT; BEGIN; CREATE (:A {x: 'c'}); ROLLBACK")
    assert rows(s.cypher("MATCH (a:A) RETURN a.x AS x")) == [("a;b",)]
    s.backup_to(str(tmp_path / "g"))
    assert rows(GraphSession.open(spark, str(tmp_path / "g")).cypher("MATCH (a:A) RETURN a.x AS x")) == [("a;b",)]
    assert s.graph.with_(rels={"R": spark.createDataFrame([(1, 2, 3, "R")], "_id long, _src long, _dst long, _type string")}).check_integrity().count() == 2
    assert s.query_arrow("MATCH (a:A) RETURN a.x AS x").num_rows == 1
    assert [r.x for r in s.execute_streaming("MATCH (a:A) RETURN a.x AS x")] == ["a;b"]
    with pytest.raises(ResourceLimit):
        s.cypher("UNWIND range(1, 10) AS x RETURN x", max_rows=5)


def test_groups_of_statements_and_schema(spark):
    s = GraphSession.in_memory(spark)
    s.execute_batch_grouped("CREATE (:A {x: 1}); CREATE (:A {x: 2}); CREATE (:B:C {y: 'b'})-[:R {w: 1.5}]->(:A {x: 3})", 2)
    with pytest.raises(UnboundVariable):
        s.execute_batch_grouped("CREATE (:A {x: 4}); CREATE (:A {x: 5}); CREATE (:A {x: 6}); RETURN nobody", 2)
    assert rows(s.cypher("MATCH (a:A) RETURN a.x AS x ORDER BY x")) == [(1,), (2,), (3,), (4,), (5,)]
    schema = s.introspect_schema()
    assert schema["labels"] == {"A": {"x": "bigint"}, "B": {"y": "string"}, "C": {"y": "string"}}
    assert schema["relationships"]["R"]["properties"] == {"w": "double"}
    with pytest.raises(GraphError):
        s.execute_batch_grouped("RETURN 1 AS x", 0)


def test_command_line(spark):
    import io

    from graphloom.__main__ import prompt

    out = io.StringIO()
    text = "UNWIND [1, 2, 3]\nAS x RETURN x;\nRETURN y;\n\n.labels\n.schema\n.what\n.help\nRETURN 'a;b' AS s; RETURN 2 AS t;\n.quit\nRETURN 5 AS never;\n"
    prompt(GraphSession.in_memory(spark), 2, io.StringIO(text), out)
    said = out.getvalue()
    assert '{"x":2}' in said and '{"x":3}' not in said and "more than 2 rows" in said
    assert "UnboundVariable" in said and '"labels": {}' in said and "unknown command .what" in said
    assert '{"s":"a;b"}' in said and '{"t":2}' in said and "never" not in said


def test_procedures(spark):
    s = GraphSession.in_memory(spark)
    s.register("my.pair", [("n", "INTEGER")], [("a", "INTEGER"), ("b", "INTEGER")], lambda g, n: g.spark.createDataFrame([(n, n * 2)], "a long, b long"))
    assert rows(s.cypher("CALL my.pair(4)")) == [(4, 8)]
    assert rows(s.cypher("CALL my.pair", {"n": 1})) == [(1, 2)]
    assert rows(s.cypher("UNWIND [1, 2] AS x CALL my.pair(3) YIELD b AS c WHERE c > 5 RETURN x, c ORDER BY x")) == [(1, 6), (2, 6)]
    with pytest.raises(SemanticError):
        s.cypher("CALL no.such()")


def test_procedures_with_arguments_from_rows(spark):
    s = GraphSession.in_memory(spark)
    asked = []

    def up_to(g, n, w):
        asked.append((n, w))
        return g.spark.range(n or 0).selectExpr("id AS k", f"'{w}' AS v")

    s.register("up.to", [("n", "INTEGER"), ("w", "STRING")], [("k", "INTEGER"), ("v", "STRING")], up_to)
    text = "UNWIND [[2, 'a'], [1, 'b'], [2, 'a'], [0, 'c']] AS x WITH toInteger(x[0]) AS n, toString(x[1]) AS w CALL up.to(n, w) YIELD k, v WHERE k < 9 RETURN n, k, v ORDER BY v, k"
    assert rows(s.cypher(text)) == [(2, 0, "a"), (2, 0, "a"), (2, 1, "a"), (2, 1, "a"), (1, 0, "b")]
    assert sorted(asked) == [(0, "c"), (1, "b"), (2, "a")]  # once for each list
    assert rows(s.cypher("UNWIND [1, null] AS n CALL up.to(n, 'x') YIELD k RETURN n, k")) == [(1, 0)]
    assert rows(s.cypher("UNWIND [] AS n CALL up.to(n, 'x') YIELD k RETURN k")) == []
    assert rows(s.cypher("UNWIND [1, 2] AS n CALL up.to(n, 'x') RETURN n ORDER BY n")) == [(1,), (2,)]
    with pytest.raises(ResourceLimit):
        s.cypher("UNWIND range(1, 1001) AS n CALL up.to(n, 'x') YIELD k RETURN k")


def test_point_reads_sizes_and_sinks(harbour):
    ids = {r[0]: r[1] for r in rows(harbour.cypher("MATCH (s:Ship) RETURN s.name AS n, id(s) AS i"))}
    assert harbour.get_node(ids["Mira"]) == {"id": ids["Mira"], "labels": ["Ship"], "properties": {"name": "Mira", "crew": 9}}
    assert harbour.get_node(-5) is None and not harbour.node_exists(-5) and harbour.node_exists(ids["Tara"])
    assert harbour.get_node_property(ids["Tara"], "tons") == 4000 and harbour.get_node_property(ids["Tara"], "crew") is None and harbour.get_node_property(-5, "tons") is None
    lane = rows(harbour.cypher("MATCH (:Port {code: 'KIE'})-[l:LANE]->(o) RETURN id(l) AS l, id(o) AS o"))[0]
    found = harbour.get_relationship(lane[0])
    assert (found["type"], found["dst"], found["properties"]) == ("LANE", lane[1], {"miles": 300})
    assert (harbour.node_count(), harbour.node_count("Ship"), harbour.node_count("Nobody")) == (7, 3, 0)
    assert (harbour.relationship_count(), harbour.relationship_count("LANE")) == (9, 3)
    seen = []
    assert harbour.execute_streaming("UNWIND range(1, 9) AS x RETURN x", sink=lambda r: seen.append(r[0])) == 9 and seen == list(range(1, 10))
    assert harbour.execute_streaming("UNWIND range(1, 9) AS x RETURN x", sink=lambda r: r[0] < 4) == 4


def test_errors_while_rows_are_made(harbour):
    for text in ("MATCH (s:Ship) RETURN 1 / (s.crew - s.crew) AS x", "MATCH (s:Ship) RETURN 9223372036854775807 + s.crew AS x"):
        with pytest.raises(CypherArithmeticError):
            harbour.rows(text)
        with pytest.raises(GraphError):
            harbour.query_arrow(text)
    with pytest.raises(CypherTypeError):
        harbour.rows("UNWIND [1, 'a'] AS x RETURN sum(x) AS s")


def test_explain_of_writes(spark):
    s = GraphSession.in_memory(spark)
    s.cypher("CREATE (:A {x: 1}), (:A {x: 2})")
    text = s.cypher("EXPLAIN MATCH (a:A) WHERE a.x > 1 CREATE (a)-[:R]->(b:B {y: a.x}) WITH b RETURN b.y AS y").first()[0]
    assert text.startswith("NodeScan(a:A)\nWrite(create: a") and "Read(return: b)" in text and "Physical Plan" in text
    assert rows(s.cypher("MATCH (n) RETURN count(*) AS n")) == [(2,)]


def test_properties_of_paths_from_rows(harbour):
    text = "MATCH (p:Port) UNWIND [300, 500] AS m MATCH (p)-[l:LANE*1..2 {miles: m}]-(q:Port) RETURN m, p.code AS p, q.code AS q ORDER BY m, p"
    assert rows(harbour.cypher(text)) == [(300, "KIE", "OSL"), (300, "OSL", "KIE"), (500, "OSL", "RIG"), (500, "RIG", "OSL")]
    with pytest.raises(SemanticError):
        harbour.cypher("UNWIND [1] AS m MATCH p = shortestPath((:Port {code: 'KIE'})-[:LANE*1..3 {miles: m}]->(:Port {code: 'RIG'})) RETURN length(p) AS l")


def test_start_at_a_middle_node_with_properties(harbour):
    text = "MATCH (a:Ship)-[x:CALLS]->(p:Port {code: 'OSL'})<-[y:CALLS]-(b:Ship) RETURN a.name AS a, b.name AS b, x.day AS x ORDER BY a"
    assert rows(harbour.cypher(text)) == [("Mira", "Nord", 4), ("Nord", "Mira", 2)]
    assert harbour.cypher("EXPLAIN " + text).first()[0].startswith("NodeScan(p:Port)")
    path = "MATCH q = (a:Ship)-[:CALLS]->(p:Port {code: 'KIE'})-[:LANE]->(o:Port) RETURN [n IN nodes(q) | coalesce(n.name, n.code)] AS l"
    assert rows(harbour.cypher(path)) == [(["Mira", "KIE", "OSL"],)]


@pytest.mark.parametrize(
    ("text", "error"),
    [
        ("MATCH (n", CypherSyntaxError), ("MATCH (n)", CypherSyntaxError), ("RETURN 1 AS a, 2 AS a", CypherSyntaxError), ("MATCH (n) WITH n.x RETURN 1 AS a", CypherSyntaxError),
        ("RETURN 1 AS a UNION RETURN 2 AS a UNION ALL RETURN 3 AS a", CypherSyntaxError), ("RETURN x", UnboundVariable), ("RETURN nothing(1) AS x", SemanticError), ("RETURN 1 AS a UNION RETURN 2 AS b", SemanticError),
        ("CREATE (a)-[:R|S]->(b)", SemanticError), ("CREATE (a)-[:R]-(b)", SemanticError), ("MATCH (n) WHERE count(n) > 1 RETURN n", SemanticError), ("RETURN 1 + true AS x", CypherTypeError), ("MATCH (n) WHERE 1 RETURN n", CypherTypeError),
        ("RETURN 1 AS x LIMIT -1", CypherTypeError), ("RETURN [1, duration('P1D')] AS x", CypherTypeError), ("RETURN toUpper(DISTINCT 'a') AS x", CypherSyntaxError), ("MATCH (a) RETURN nodes(a) AS x", CypherTypeError), ("RETURN *", SemanticError), ("UNWIND 1 AS x RETURN x", CypherTypeError), ("RETURN count(count(1)) AS x", SemanticError),
    ],
)
def test_errors(spark, text, error):
    with pytest.raises(error):
        GraphSession.in_memory(spark).cypher(text)


def test_parser_never_breaks_on_damaged_text():
    import random

    good = "MATCH p = (a:A {x: 1})-[r:R|S*1..3]->(b) WHERE NOT (a)-->(b) AND a.x IN [1, 2.5, 'c'] WITH a, collect(b) AS l ORDER BY a.x DESC SKIP 1 LIMIT 2 UNWIND l AS y RETURN CASE y.k WHEN 1 THEN [z IN l WHERE z.q | z.w] ELSE {a: $p} END AS o"
    parse(good)
    rng = random.Random(1)
    words = good.split(" ")
    for _ in range(300):
        bad = [w for w in words if rng.random() > 0.15]
        try:
            parse(" ".join(bad))
        except CypherSyntaxError:
            pass
    assert split_batch("RETURN ';' AS a; ; RETURN 2 AS b // c;\n") == ["RETURN ';' AS a", "RETURN 2 AS b // c;"]


def test_plans(spark, small):
    s = GraphSession.from_tables(spark, small)
    plan = rows(s.cypher("EXPLAIN MATCH (c:Customer {mktsegment: 'BUILDING'})-[:PLACED]->(o:Order)-[:CONTAINS]->(p:Part) RETURN o.orderpriority AS p, count(*) AS n"))[0][0]
    assert "no join for (p)" in plan and "EqualTo(c_mktsegment,BUILDING)" in plan
    assert "part.parquet" not in plan and "c_acctbal" not in plan
    plan = rows(s.cypher("EXPLAIN MATCH (:Order)-[r:CONTAINS]->(:Part) RETURN count(r) AS n"))[0][0]
    assert "Join" not in plan
    plan = rows(s.cypher("EXPLAIN MATCH (o:Order) WHERE NOT (o)-[:CONTAINS]->() RETURN count(*) AS n"))[0][0]
    assert "LeftAnti" in plan


def test_members_of_paths_and_ends(harbour):
    q = lambda text: rows(harbour.cypher(text))
    assert q("MATCH p = (a:Port {code: 'OSL'})-[:LANE*0..2]->(x) RETURN [n IN nodes(p) | n.code] AS l, size(relationships(p)) AS k ORDER BY k") == [(["OSL"], 0), (["OSL", "RIG"], 1), (["OSL", "RIG", "KIE"], 2)]
    assert q("MATCH (:Hub)-[l:LANE]->() RETURN startNode(l).code AS a, endNode(l).depth AS b, [x IN [l] | x.miles] AS m") == [("RIG", 12, [700])]
    assert q("MATCH p = (:Ship {name: 'Mira'})-[:ESCORTS]->(b) UNWIND nodes(p) AS n RETURN n.name AS n ORDER BY n") == [("Mira",), ("Tara",)]


def test_builder(harbour):
    from graphloom.builder import Match

    df = Match("(s:Ship)-[c:CALLS]->(p:Port)").where("c.day < $top").returns("p.code AS p", "count(s) AS n").order_by("p").run(harbour, top=5)
    assert rows(df) == [("KIE", 1), ("OSL", 2), ("RIG", 1)]


def test_exact_values(spark):
    assert one(spark, "duration({seconds: 1234567890, nanoseconds: 1}).nanosecondsOfSecond") == 1
    assert one(spark, "toString(duration({days: 1, milliseconds: 1500, nanoseconds: -1}))") == "P1DT1.499999999S"
    assert one(spark, "toString(duration('PT1234567890.000000001S'))") == "PT342935H31M30.000000001S"
    assert one(spark, "toString(duration('PT-0.5S'))") == "PT-0.5S"
    for text, want in (("1e20", "100000000000000000000"), ("1.0", "1"), ("0.1", "0.1"), ("-2.5e-7", "-0.00000025"), ("1.25e9", "1250000000"), ("123456789012.5", "123456789012.5"), ("0.0", "0")):
        assert one(spark, f"toString({text})") == want
    assert one(spark, "'a' + 1e20") == "a100000000000000000000"
    s = GraphSession.in_memory(spark)
    assert rows(s.cypher("UNWIND [[null], [1], [1, 2], [], [1, null]] AS l RETURN l ORDER BY l")) == [([],), ([1],), ([1, 2],), ([1, None],), ([None],)]
    assert rows(s.cypher("UNWIND [[null], [1], [1, 2]] AS l RETURN min(l) AS a, max(l) AS b")) == [([1], [None])]
    assert rows(s.cypher("UNWIND [null] AS x RETURN sum(x) AS s, sum(1.5) AS f")) == [(0, 1.5)] and s.cypher("RETURN sum(null) AS s").dtypes == [("s", "bigint")]
    assert rows(s.cypher("UNWIND [0.5, 3.5, 1.5, 2.5] AS x RETURN percentileDisc(x, 0.0) AS a, percentileDisc(x, 0.5) AS b, percentileDisc(x, 0.51) AS c, percentileDisc(x, 1.0) AS d")) == [(0.5, 1.5, 2.5, 3.5)]


def test_writes_leave_other_tables_alone(spark):
    s = GraphSession.in_memory(spark)
    s.cypher("CREATE (a:A {k: 1})-[:R]->(b:B {k: 2}), (c:C {k: 3})-[:S]->(b), (a)-[:T]->(c)")
    before = s.graph
    s.cypher("MATCH (a:A) SET a.x = 1, a.y = 'two'")
    assert s.graph.nodes[("B",)] is before.nodes[("B",)] and s.graph.rels["R"] is before.rels["R"]
    assert rows(s.cypher("MATCH (a:A) RETURN a.k AS k, a.x AS x, a.y AS y")) == [(1, 1, "two")]
    before = s.graph
    s.cypher("MATCH (c:C) DETACH DELETE c")
    assert s.graph.nodes[("A",)] is before.nodes[("A",)] and s.graph.rels["R"] is before.rels["R"]
    assert rows(s.cypher("MATCH ()-[r]->() RETURN type(r) AS t")) == [("R",)] and s.stats.relationships_deleted == 2 and s.stats.nodes_deleted == 1


def value(s, text, **params):
    """The only value of the first row, variants as Python values."""
    def open_(v):
        return v.toPython() if hasattr(v, "toPython") else [open_(x) for x in v] if isinstance(v, list) else v

    return [open_(r[0]) for r in s.cypher(text, params).collect()]


def test_mixed_types(spark):
    s = GraphSession.in_memory(spark)
    assert value(s, "UNWIND [1, 'a', null, 2.5, true] AS x RETURN x") == [1, "a", None, 2.5, True]
    assert value(s, "UNWIND [1, 'a', null, 2.5, true] AS x RETURN x ORDER BY x DESC") == [None, 2.5, 1, True, "a"]
    assert value(s, "RETURN [1, 'a', null, 2.5] AS l") == [[1, "a", None, 2.5]]
    assert value(s, "RETURN size([1, 'a', true]) AS n") == [3]
    assert value(s, "RETURN [x IN [1, 'a', 2.0, 3] WHERE x > 1] AS l") == [[2.0, 3]]
    assert value(s, "RETURN head([1, 'a']) = 1.0 AS b") == [True]
    assert value(s, "RETURN [1, 'a'] = [1, 'a'] AS b") == [True]
    assert value(s, "RETURN [1, null, 'a'] = [1, 2, 'a'] AS b") == [None]
    assert value(s, "UNWIND [1, 'a', 2.5] AS x RETURN x + 1 AS y") == [2, "a1", 3.5]
    assert value(s, "UNWIND [1, 'x', 'true', 2.5, true] AS x RETURN toString(x) AS y") == ["1", "x", "true", "2.5", "true"]
    assert value(s, "UNWIND [1, '7', true, 2.9] AS x RETURN toInteger(x) AS y") == [1, 7, None, 2]
    assert value(s, "UNWIND [1, 'abc', true] AS x RETURN x STARTS WITH 'a' AS y") == [None, True, None]
    assert value(s, "UNWIND [1, 'a', 1, 'a', null] AS x WITH DISTINCT x RETURN count(x) AS n") == [2]
    assert value(s, "UNWIND [1, 'a', 2.5] AS x RETURN max(x) AS y") == [2.5]
    assert value(s, "UNWIND [1, 'a', 2.5] AS x RETURN min(x) AS y") == ["a"]
    assert value(s, "RETURN coalesce(null, 1, 'a') AS x") == [1]
    assert value(s, "UNWIND [1, 2] AS n RETURN CASE WHEN n > 1 THEN 'many' ELSE n END AS x") == [1, "many"]
    assert value(s, "RETURN 1 AS x UNION RETURN 'a' AS x UNION RETURN 1 AS x") in ([1, "a"], ["a", 1])
    assert value(s, "UNWIND [{a: 1}, {a: 2, b: 'y'}] AS m RETURN m.b AS b") == [None, "y"]
    assert value(s, "UNWIND $rows AS m RETURN m.v AS v", rows=[{"v": 1}, {"v": "x"}]) == [1, "x"]

    assert value(s, "UNWIND [date('2020-02-01'), 3, 'a', null, date('2019-12-31'), true] AS x RETURN x ORDER BY x") == ["a", True, 3, dt.date(2019, 12, 31), dt.date(2020, 2, 1), None]
    assert value(s, "RETURN [date('2020-02-01'), 'a'] AS l") == [[dt.date(2020, 2, 1), "a"]]
    assert value(s, "UNWIND [date('2020-02-01'), localdatetime('2020-02-01T00:00'), time('10:00+01:00'), time('09:00Z'), localtime('09:00')] AS x WITH x ORDER BY x WITH toString(x) AS t RETURN t") != []
    assert value(s, "UNWIND [date('2020-02-01'), 5, '2020-02-01'] AS x RETURN x = date('2020-02-01') AS y") == [True, False, False]
    assert value(s, "UNWIND [date('2020-02-01'), 5, '2020'] AS x RETURN x < date('2020-03-01') AS y") == [True, None, None]
    assert value(s, "UNWIND [date('2020-02-01'), 5, '2020'] AS x RETURN x STARTS WITH '2020' AS y") == [None, None, True]
    assert value(s, "UNWIND [1, date('2020-02-01')] AS x RETURN toString(x) AS y") == ["1", "2020-02-01"]
    with pytest.raises(Exception, match="no \\+"):
        s.cypher("UNWIND [date('2020-02-01'), 5] AS x RETURN x + 1 AS y").collect()

def test_mixed_properties(spark):
    s = GraphSession.in_memory(spark)
    s.cypher("CREATE (:M {t: 'int', year: 1999}), (:M {t: 'float', year: 2000.5})")
    s.cypher("CREATE (:M {t: 'text', year: '2001'}), (:M {t: 'none'})")
    assert value(s, "MATCH (m:M) WHERE m.year > 1990 RETURN m.t AS t ORDER BY t") == ["float", "int"]
    assert value(s, "MATCH (m:M) WHERE m.year = '2001' RETURN m.t AS t") == ["text"]
    assert value(s, "MATCH (m:M) WHERE 1990 <= m.year < 2000 RETURN m.year AS y") == [1999]
    assert value(s, "MATCH (m:M) RETURN m.year AS y ORDER BY y") == ["2001", 1999, 2000.5, None]
    assert value(s, "MATCH (m:M {year: 1999}) RETURN m.t AS t") == ["int"]
    s.cypher("MATCH (m:M {t: 'none'}) SET m.year = true")
    assert value(s, "MATCH (m:M {t: 'none'}) RETURN m.year AS y") == [True]
    s.cypher("CREATE (:K {year: 'k'})")
    assert value(s, "MATCH (n) WHERE n.year = 'k' RETURN labels(n)[0] AS l") == ["K"]
    with pytest.raises(CypherTypeError):
        s.cypher("MATCH (m:M) WITH collect(m.year) AS l RETURN length(l) AS n")


def test_durations_below_zero_and_other_repairs(spark):
    s = GraphSession.in_memory(spark)
    text = lambda e: value(s, f"RETURN toString({e}) AS t")[0]
    assert text("duration.between(localdatetime('2015-07-21T21:40:32.142'), date('2015-06-24'))") == "P-27DT-21H-40M-32.142S"
    assert text("duration({nanoseconds: -1})") == "PT-0.000000001S"
    assert text("duration({seconds: -2, nanoseconds: 1})") == "PT-1.999999999S"
    assert text("duration({seconds: 1, milliseconds: 700}) + duration({milliseconds: 700})") == "PT2.4S"
    assert text("duration.inDays(date('1984-10-11'), time('16:30'))") == "PT0S"
    assert text("duration.inMonths(localtime('14:30'), time('16:30+01:00'))") == "PT0S"
    stockholm = lambda h: f"datetime({{year: 2017, month: 10, day: 29, hour: {h}, timezone: 'Europe/Stockholm'}})"
    assert text(f"duration.inSeconds({stockholm(0)}, {stockholm(4)})") == "PT5H"
    assert text(f"duration.inSeconds({stockholm(0)}, localdatetime('2017-10-29T04:00'))") == "PT5H"
    assert text(f"duration.inSeconds({stockholm(0)}, date('2017-10-30'))") == "PT25H"
    assert text(f"duration.inSeconds(localdatetime('2017-10-29T00:00'), {stockholm(4)})") == "PT5H"
    assert text(f"duration.between({stockholm(0)}, {stockholm(4)})") == "PT5H"
    assert text("duration.between(datetime('2018-03-01T00:00+01:00'), datetime('2018-04-01T00:00+01:00'))") == "P1M"
    assert text("duration.between(datetime('2014-07-21T21:40:36.143+0200'), datetime('2015-07-21T21:40:32.142+0100'))") == "P1YT59M55.999S"
    assert text("duration.between(time('14:30'), time('16:30+0100'))") == "PT1H"
    assert text("duration.between(datetime('2014-07-21T21:40:36.143+0200'), time('16:30+0100'))") == "PT-4H-10M-36.143S"
    assert value(s, "RETURN sum(null) AS n") == [0]
    s.cypher("CREATE (a:A {t: localtime('10:00')})-[:L]->(:B)")
    assert value(s, "MATCH (a:A) RETURN toString(a.t) AS t") == ["10:00"]
    assert sorted(value(s, "MATCH (a) RETURN exists((a)-[:L]->()) AS f")) == [False, True]
    s.cypher("MATCH (a:A) SET a.n = size([(a)-[:L]-(b) | b])")
    assert value(s, "MATCH (a:A) RETURN a.n AS n") == [1]
    s.cypher("MATCH p = (:A)-->() DELETE relationships(p)[0]")
    assert value(s, "MATCH ()-[r]->() RETURN count(r) AS n") == [0]
    for bad in ("MATCH (a)-[a]->(b) RETURN 1 AS x", "MATCH (a)-[r]->(b) MATCH (r)-->(c) RETURN 1 AS x", "MATCH p = (a)-->(p) RETURN 1 AS x", "MATCH (a)-[r]->()-[r]->(b) RETURN 1 AS x", "MATCH (a)-[r*2]->(b), (c)-[r]->(d) RETURN 1 AS x"):
        with pytest.raises(SemanticError):
            s.cypher(bad)
