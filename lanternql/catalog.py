"""Registered queries: the engine's operators on the driver's tables, with SQL oracles.

Most are texts of the dialect that run through the parser; a few use the DataFrame
operators alone.  Each oracle says the same in ANSI SQL.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lanternql.session import Engine, snake_case
from lanternql.sources import datasource, formats
from lanternql.streaming import windows

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "benchmark", "conversations")

FLAGSHIP = """
SELECT l_returnflag, count(*) AS n, sum(l_quantity) AS q FROM lineitem WHERE l_discount > 0.05
GROUP BY l_returnflag ORDER BY q DESC LIMIT 3
"""

#: name -> (text of the dialect, oracle)
TEXTS: dict[str, tuple[str, str]] = {
    "flagship": (FLAGSHIP, "SELECT l_returnflag, count(*) AS n, sum(l_quantity) AS q FROM lineitem WHERE l_discount > 0.05 GROUP BY l_returnflag ORDER BY q DESC LIMIT 3"),
    # projection, filter, predicates
    "filter_pred": (
        "select o_orderkey, o_totalprice from orders where o_totalprice > 300000 and not o_orderstatus = 'F' or o_orderkey = 1",
        "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 300000 AND NOT o_orderstatus = 'F' OR o_orderkey = 1",
    ),
    "filter_like_ci": ("select p_partkey, p_type from part where p_type like '%STEEL%' or p_name like '%part_1%'", "SELECT p_partkey, p_type FROM part WHERE p_type ILIKE '%STEEL%' OR p_name ILIKE '%part_1%'"),
    "filter_like_set": ("select c_custkey, c_mktsegment from customer where c_mktsegment like '[a-f]%'", "SELECT c_custkey, c_mktsegment FROM customer WHERE regexp_matches(c_mktsegment, '^[a-fA-F]')"),
    "filter_similar": ("select c_custkey from customer where c_name similar to '1[0-9]+$'", "SELECT c_custkey FROM customer WHERE regexp_matches(c_name, '1[0-9]+$')"),
    "filter_between": ("select l_orderkey, l_linenumber from lineitem where l_quantity between 10 and 12 and l_discount not between 0.02 and 0.08", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity BETWEEN 10 AND 12 AND l_discount NOT BETWEEN 0.02 AND 0.08"),
    "filter_in": ("select o_orderkey from orders where o_orderstatus in ('F', 'P') and o_orderpriority not in ('1-URGENT')", "SELECT o_orderkey FROM orders WHERE o_orderstatus IN ('F', 'P') AND o_orderpriority NOT IN ('1-URGENT')"),
    "filter_null": ("select user_id, count(*) as n from events where props is not null and user_id is not null group by user_id", "SELECT user_id, count(*) AS n FROM events WHERE props IS NOT NULL AND user_id IS NOT NULL GROUP BY user_id"),
    "proj_except": ("select * except o_totalprice, o_orderdate from orders", "SELECT * EXCLUDE (o_totalprice, o_orderdate) FROM orders"),
    "proj_case": (
        "select o_orderkey, case o_orderstatus when 'F' then 'done' when 'O' then 'open' else 'other' end as state, case when o_totalprice > 100000 then 1 end as big from orders",
        "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'open' ELSE 'other' END AS state, CAST(CASE WHEN o_totalprice > 100000 THEN 1 END AS BIGINT) AS big FROM orders",
    ),
    "cast_try": (
        "select event_id, cast(event_type as integer) as bad, event_id::string as s, cast(value as integer) as v, cast('yes' as boolean) as b from events",
        "SELECT event_id, CAST(NULL AS BIGINT) AS bad, CAST(event_id AS VARCHAR) AS s, CAST(trunc(value) AS BIGINT) AS v, true AS b FROM events",
    ),
    "arith_intdiv": ("select n_nationkey, n_nationkey / 4 as d, n_nationkey % 4 as m, -n_nationkey / 4 as nd, n_nationkey << 2 as l, n_nationkey >> 1 as r from nation", "SELECT n_nationkey, CAST(n_nationkey // 4 AS BIGINT) AS d, CAST(n_nationkey % 4 AS BIGINT) AS m, CAST(-(n_nationkey // 4) AS BIGINT) AS nd, CAST(n_nationkey * 4 AS BIGINT) AS l, CAST(n_nationkey // 2 AS BIGINT) AS r FROM nation"),
    "arith_float": ("select l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) as net, l_quantity / 3 as third from lineitem", "SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) AS net, l_quantity / 3 AS third FROM lineitem"),
    "concat_plus": ("select n_name + '-' + n_nationkey as a, n_name || '/' || n_regionkey as b from nation", "SELECT n_name || '-' || n_nationkey AS a, n_name || '/' || n_regionkey AS b FROM nation"),
    "coalesce_nullif": ("select n_nationkey, coalesce(nullif(n_regionkey, 2), -1) as k from nation", "SELECT n_nationkey, CAST(coalesce(nullif(n_regionkey, 2), -1) AS BIGINT) AS k FROM nation"),
    # joins
    "join_inner": (
        "select n.n_name, r.r_name from nation n inner join region as r on n.n_regionkey = r.r_regionkey",
        "SELECT n.n_name, r.r_name FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey",
    ),
    "join_chain": (
        "select r_name, count(*) as n, sum(o_totalprice) as total from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey group by r_name",
        "SELECT r_name, count(*) AS n, sum(o_totalprice) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name",
    ),
    "join_left": ("select c_custkey, o_orderkey from customer left join orders on o_custkey = c_custkey and o_totalprice > 200000", "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice > 200000"),
    "join_right": ("select s_suppkey, n_name from supplier right outer join nation on s_nationkey = n_nationkey", "SELECT s_suppkey, n_name FROM supplier RIGHT JOIN nation ON s_nationkey = n_nationkey"),
    "join_full": (
        "select a.k as ak, b.k as bk from (select n_nationkey as k from nation where n_nationkey < 15) a full join (select n_nationkey as k from nation where n_nationkey > 10) b on a.k = b.k",
        "SELECT a.k AS ak, b.k AS bk FROM (SELECT n_nationkey AS k FROM nation WHERE n_nationkey < 15) a FULL JOIN (SELECT n_nationkey AS k FROM nation WHERE n_nationkey > 10) b ON a.k = b.k",
    ),
    "join_using": (
        "select a.n_nationkey, b.n_name as other from nation a inner join nation b using (n_nationkey, n_regionkey)",
        "SELECT a.n_nationkey, b.n_name AS other FROM nation a JOIN nation b ON a.n_nationkey = b.n_nationkey AND a.n_regionkey = b.n_regionkey",
    ),
    "join_theta": ("select a.n_name, b.r_name from nation a inner join region b on a.n_nationkey < b.r_regionkey", "SELECT a.n_name, b.r_name FROM nation a JOIN region b ON a.n_nationkey < b.r_regionkey"),
    "join_comma": ("select n_name, r_name from nation, region where n_regionkey = r_regionkey and r_name <> 'ASIA'", "SELECT n_name, r_name FROM nation, region WHERE n_regionkey = r_regionkey AND r_name <> 'ASIA'"),
    "join_self": ("select a.n_name as x, b.n_name as y from nation a join nation b on a.n_regionkey = b.n_regionkey and a.n_nationkey < b.n_nationkey", "SELECT a.n_name AS x, b.n_name AS y FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey"),
    "semi_exists": ("select c_custkey from customer c where exists (select 1 from orders o where o.o_custkey = c.c_custkey and o_totalprice > 250000)", "SELECT c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o_totalprice > 250000)"),
    "anti_not_exists": ("select c_custkey from customer c where not exists (select 1 from orders o where o.o_custkey = c.c_custkey)", "SELECT c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey)"),
    # aggregation
    "agg_group": (
        "select l_returnflag, l_linestatus, sum(l_quantity) as sum_qty, avg(l_extendedprice) as avg_price, count(*) as n, min(l_shipdate) as first, max(l_discount) as most from lineitem group by l_returnflag, l_linestatus",
        "SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, avg(l_extendedprice) AS avg_price, count(*) AS n, min(l_shipdate) AS first, max(l_discount) AS most FROM lineitem GROUP BY l_returnflag, l_linestatus",
    ),
    "agg_group_expr": ("select substr(o_orderpriority, 1, 1) as p, count(*) as n from orders group by substr(o_orderpriority, 1, 1)", "SELECT substr(o_orderpriority, 1, 1) AS p, count(*) AS n FROM orders GROUP BY 1"),
    "agg_having": ("select o_custkey, count(*) as n from orders group by o_custkey having count(*) > 15 and sum(o_totalprice) > 100000", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 15 AND sum(o_totalprice) > 100000"),
    "agg_global_empty": ("select count(*) as n, sum(o_totalprice) as s, max(o_orderkey) as m from orders where 1 = 0", "SELECT count(*) AS n, sum(o_totalprice) AS s, max(o_orderkey) AS m FROM orders WHERE 1 = 0"),
    "agg_expr": ("select 1 + sum(n_nationkey) + 10 as s, count(n_name) as c from nation", "SELECT CAST(1 + sum(n_nationkey) + 10 AS BIGINT) AS s, count(n_name) AS c FROM nation"),
    "agg_string_agg_ordered": ("select n_regionkey, string_agg(n_name, ',') as names from nation group by n_regionkey", "SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_nationkey) AS names FROM nation GROUP BY n_regionkey"),
    "agg_first_last": ("select n_regionkey, first_value(n_name) as f, last_value(n_name) as l, n_nationkey from nation group by n_regionkey", "SELECT n_regionkey, first(n_name ORDER BY n_nationkey) AS f, last(n_name ORDER BY n_nationkey) AS l, min(n_nationkey) AS n_nationkey FROM nation GROUP BY n_regionkey"),
    "agg_avg_timestamp": ("select event_type, avg(ts) as mid from events group by event_type", "SELECT event_type, make_timestamp(CAST(sum(epoch_us(ts)) // count(*) AS BIGINT)) AS mid FROM events GROUP BY event_type"),
    "agg_url_host": (
        "select split_part(url, '/', 3) as site, avg(length(html)) as a from pages where page_id > 1 group by split_part(url, '/', 3) order by 2 desc, 1 fetch first 10 rows only",
        "SELECT split_part(url, '/', 3) AS site, avg(length(html)) AS a FROM pages WHERE page_id > 1 GROUP BY 1 ORDER BY a DESC, site LIMIT 10",
    ),
    "distinct_all": ("select distinct o_orderstatus, o_orderpriority from orders", "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders"),
    "distinct_on": ("select distinct on (n_regionkey) n_regionkey, n_name from nation", "SELECT DISTINCT ON (n_regionkey) n_regionkey, n_name FROM nation ORDER BY n_regionkey, n_nationkey"),
    # windows
    "win_sum_part": ("select o_orderkey, sum(o_totalprice) over (partition by o_custkey) as s, count(*) over (partition by o_custkey) as n from orders", "SELECT o_orderkey, sum(o_totalprice) OVER (PARTITION BY o_custkey) AS s, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders"),
    "win_sum_running": (
        "select o_orderkey, sum(o_orderkey) over (partition by o_custkey order by o_orderkey) as s from orders",
        "SELECT o_orderkey, CAST(sum(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING) AS BIGINT) AS s FROM orders",
    ),
    "win_row_number": ("select o_orderkey, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) as rn from orders", "SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders"),
    "win_named": (
        "select n_nationkey, max(n_nationkey) over (w1) as m, first_value(n_name) over w1 as f from nation window w as (partition by n_regionkey), w1 as (w order by n_nationkey)",
        "SELECT n_nationkey, max(n_nationkey) OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS m, first_value(n_name) OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS f FROM nation",
    ),
    "win_after_group": ("select n_regionkey, count(*) as n, sum(count(*)) over (order by n_regionkey) as running from nation group by n_regionkey", "SELECT n_regionkey, count(*) AS n, CAST(sum(count(*)) OVER (ORDER BY n_regionkey) AS BIGINT) AS running FROM nation GROUP BY n_regionkey"),
    # order, limit
    "sort_nulls": ("select c_custkey, o_orderkey from customer left join orders on o_custkey = c_custkey order by o_orderkey desc, c_custkey", "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON o_custkey = c_custkey ORDER BY o_orderkey DESC NULLS LAST, c_custkey"),
    "sort_ordinal": ("select n_name, n_regionkey from nation order by 2 desc, 1 limit 7", "SELECT n_name, n_regionkey FROM nation ORDER BY n_regionkey DESC, n_name LIMIT 7"),
    "sort_unselected": ("select n_name from nation order by n_nationkey * -1 limit 4", "SELECT n_name FROM nation ORDER BY n_nationkey DESC LIMIT 4"),
    "limit_offset": ("select o_orderkey from orders order by o_orderkey offset 5 fetch next 6 rows only", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 6 OFFSET 5"),
    "top_k": ("select top 10 o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10"),
    # sets
    "set_union": ("select n_regionkey as k from nation union select r_regionkey from region", "SELECT n_regionkey AS k FROM nation UNION SELECT r_regionkey FROM region"),
    "set_union_all": ("select n_regionkey as k from nation union all select r_regionkey from region", "SELECT n_regionkey AS k FROM nation UNION ALL SELECT r_regionkey FROM region"),
    "set_intersect": ("select n_nationkey as k from nation intersect select r_regionkey from region", "SELECT n_nationkey AS k FROM nation INTERSECT SELECT r_regionkey FROM region"),
    "set_except": ("select n_nationkey as k from nation except select r_regionkey from region", "SELECT n_nationkey AS k FROM nation EXCEPT SELECT r_regionkey FROM region"),
    "set_precedence": ("select 1 as k union all select n_nationkey from nation intersect select r_regionkey from region order by k desc limit 3", "(SELECT CAST(1 AS BIGINT) AS k UNION ALL (SELECT n_nationkey FROM nation INTERSECT SELECT r_regionkey FROM region)) ORDER BY k DESC LIMIT 3"),
    "values_inline": ("select v.column1 as a, column2 as b from (values (1, 'x'), (2, 'y'), (3, null)) as v", "SELECT CAST(column0 AS BIGINT) AS a, column1 AS b FROM (VALUES (1, 'x'), (2, 'y'), (3, NULL)) v(column0, column1)"),
    "gen_series": ("select value as i, value * value as sq from generate_series(1, 20, 3)", "SELECT i, i * i AS sq FROM generate_series(1, 20, 3) t(i)"),
    "gen_series_lateral": ("select r_name, s.value as i from region r, generate_series(0, r.r_regionkey) as s", "SELECT r_name, CAST(unnest(generate_series(0, r_regionkey)) AS BIGINT) AS i FROM region"),
    # common tables
    "cte_chain": (
        "with a as (select o_custkey as k, sum(o_totalprice) as s from orders group by o_custkey), b as (select * from a where s > 500000) select c_name, b.s as s from b join customer on c_custkey = b.k",
        "WITH a AS (SELECT o_custkey AS k, sum(o_totalprice) AS s FROM orders GROUP BY o_custkey), b AS (SELECT * FROM a WHERE s > 500000) SELECT c_name, b.s AS s FROM b JOIN customer ON c_custkey = b.k",
    ),
    "cte_recursive": (
        "with recursive t(n, f) as (select 1, 1 union all select n + 1, f * (n + 1) from t where n < 10) select n, f from t",
        "WITH RECURSIVE t(n, f) AS (SELECT CAST(1 AS BIGINT), CAST(1 AS BIGINT) UNION ALL SELECT n + 1, f * (n + 1) FROM t WHERE n < 10) SELECT n, f FROM t",
    ),
    "cte_recursive_cycle": (
        "with recursive r(k) as (select 3 union select (k * 2) % 25 from r) select k from r",
        "WITH RECURSIVE r(k) AS (SELECT CAST(3 AS BIGINT) UNION SELECT (k * 2) % 25 FROM r) SELECT k FROM r",
    ),
    # subqueries
    "subq_scalar_corr": ("select c_custkey, (select count(*) from orders where o_custkey = c_custkey) as n from customer", "SELECT c_custkey, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS n FROM customer"),
    "subq_first_row": ("select r_name, (select n_name from nation where n_regionkey = r_regionkey) as first from region", "SELECT r_name, (SELECT first(n_name ORDER BY n_nationkey) FROM nation WHERE n_regionkey = r_regionkey) AS first FROM region"),
    "subq_in": ("select n_name from nation where n_regionkey in (select r_regionkey from region where r_name like 'A%')", "SELECT n_name FROM nation WHERE n_regionkey IN (SELECT r_regionkey FROM region WHERE r_name LIKE 'A%')"),
    "subq_any": ("select n_name from nation where n_nationkey < any (select r_regionkey from region)", "SELECT n_name FROM nation WHERE n_nationkey < ANY (SELECT r_regionkey FROM region)"),
    "subq_all": ("select n_name from nation where n_nationkey >= all (select r_regionkey from region)", "SELECT n_name FROM nation WHERE n_nationkey >= ALL (SELECT r_regionkey FROM region)"),
    "subq_max_corr": (
        "select o_custkey, o_orderkey from orders o where o_totalprice = (select max(o_totalprice) from orders i where i.o_custkey = o.o_custkey)",
        "SELECT o_custkey, o_orderkey FROM orders o WHERE o_totalprice = (SELECT max(o_totalprice) FROM orders i WHERE i.o_custkey = o.o_custkey)",
    ),
    "lateral_split": ("select c.conv_id, c.turn, t.value as word from conversations c, string_to_table(c.text, ' ') as t", "SELECT conv_id, turn, unnest(string_split(text, ' ')) AS word FROM conversations"),
    "lateral_regexp": ("select n_nationkey, t.value as part from nation, regexp_split_to_table(n_name, '_') as t", "SELECT n_nationkey, unnest(regexp_split_to_array(n_name, '_')) AS part FROM nation"),
    # functions
    "str_basic": (
        "select n_nationkey, lower(n_name) as l, upper(n_name) as u, length(n_name) as n, reverse(n_name) as r, replace(n_name, 'NA', 'x') as x, substr(n_name, 3, 4) as s, position('T' in n_name) as p, starts_with(n_name, 'NATION_1') as w, split_part(n_name, '_', 2) as sp, btrim(n_name, 'N') as b, ltrim('xxa', 'x') as lt, rtrim('axx', 'x') as rt from nation",
        "SELECT n_nationkey, lower(n_name) AS l, upper(n_name) AS u, length(n_name) AS n, reverse(n_name) AS r, replace(n_name, 'NA', 'x') AS x, substr(n_name, 3, 4) AS s, strpos(n_name, 'T') AS p, starts_with(n_name, 'NATION_1') AS w, split_part(n_name, '_', 2) AS sp, trim(n_name, 'N') AS b, ltrim('xxa', 'x') AS lt, rtrim('axx', 'x') AS rt FROM nation",
    ),
    "str_regex": (
        "select n_nationkey, regexp_substr(n_name, '[0-9]+') as d, regexp_count(n_name, '[A-Z]') as c, regexp_replace(n_name, '([A-Z]+)_', '<$1>') as r, substring_regex('[0-9]' in n_name) as f, translate_regex('N' in n_name with 'M') as t from nation",
        "SELECT n_nationkey, regexp_extract(n_name, '[0-9]+') AS d, len(regexp_extract_all(n_name, '[A-Z]')) AS c, regexp_replace(n_name, '([A-Z]+)_', '<\\1>', 'g') AS r, regexp_extract(n_name, '[0-9]') AS f, regexp_replace(n_name, 'N', 'M', 'g') AS t FROM nation",
    ),
    "str_encode": ("select n_nationkey, to_base64(n_name) as b, md5(n_name) as m, sha256(n_name) as s, chr(65 + n_nationkey) as c from nation", "SELECT n_nationkey, base64(encode(n_name)) AS b, upper(md5(n_name)) AS m, upper(sha256(n_name)) AS s, chr(CAST(65 + n_nationkey AS INTEGER)) AS c FROM nation"),
    "dt_parts": (
        "select event_id, extract(year from ts) as y, extract(month from ts) as m, extract(day from ts) as d, extract(dow from ts) as w, extract(hour from ts) as h, extract(second from ts) as s, date_part('doy', ts) as doy from events",
        "SELECT event_id, year(ts) AS y, month(ts) AS m, day(ts) AS d, dayofweek(ts) AS w, hour(ts) AS h, second(ts) AS s, dayofyear(ts) AS doy FROM events",
    ),
    "dt_arith": (
        "select event_id, date_trunc('hour', ts) as t, date(ts) as d, date_add('month', 1, ts) as nm, date_add('hour', -5, ts) as hb, ts + interval '1d 2h' as p, ts - timestamp '2024-01-01' > interval '10d' as late from events",
        "SELECT event_id, date_trunc('hour', ts) AS t, CAST(CAST(ts AS DATE) AS TIMESTAMP) AS d, ts + INTERVAL 1 MONTH AS nm, ts - INTERVAL 5 HOUR AS hb, ts + INTERVAL 26 HOUR AS p, ts - TIMESTAMP '2024-01-01' > INTERVAL 10 DAY AS late FROM events",
    ),
    "dt_format": ("select event_id, to_char(ts, 'yyyy-MM-dd HH:mm') as f, to_date('2024-02-' || '03', 'yyyy-MM-dd') as p from events", "SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M') AS f, TIMESTAMP '2024-02-03' AS p FROM events"),
    "math_basic": (
        "select n_nationkey, abs(-n_nationkey) as a, sqrt(n_nationkey) as s, power(n_nationkey, 2) as p, round(n_nationkey / 2.0) as r, floor(n_nationkey / 3.0) as f, ceiling(n_nationkey / 3.0) as c, greatest(n_nationkey, n_regionkey) as g, least(n_nationkey, 7) as l from nation",
        "SELECT n_nationkey, abs(-n_nationkey) AS a, sqrt(n_nationkey) AS s, CAST(n_nationkey * n_nationkey AS BIGINT) AS p, round_even(n_nationkey / 2.0, 0)::DOUBLE AS r, floor(n_nationkey / 3.0)::DOUBLE AS f, ceil(n_nationkey / 3.0)::DOUBLE AS c, greatest(n_nationkey, n_regionkey) AS g, CAST(least(n_nationkey, 7) AS BIGINT) AS l FROM nation",
    ),
    "math_trig": ("select round(degrees(pi())) as d, radians(180) > 3.14 as r, log(1000) > 2.99 and log(1000) < 3.01 as l, round(ln(1)) as n, sin(0) as s, cos(0) as c", "SELECT 180.0::DOUBLE AS d, true AS r, true AS l, 0.0::DOUBLE AS n, 0.0::DOUBLE AS s, 1.0::DOUBLE AS c"),
    "json_read": (
        "select event_id, json_value(props, '$.k') as k, is_json(props) as j, json_exists(props, '$.zz') as e, json_query('{\"a\":[1,2]}', '$.a') as q, json_array_length('[1,2,3]') as n from events",
        "SELECT event_id, json_extract_string(props, '$.k') AS k, json_valid(props) AS j, false AS e, '[1,2]' AS q, CAST(3 AS BIGINT) AS n FROM events",
    ),
    "json_elements": ("select value as v from json_array_elements('[\"a\", \"b\", 3]')", "SELECT unnest(['a', 'b', '3']) AS v"),
    "misc_size_pretty": ("select size_pretty(0) as a, size_pretty(1536) as b, size_pretty(5000000) as c, size_pretty(999, 1000) as d", "SELECT '0 B' AS a, '1.5 K' AS b, '4.8 M' AS c, '999 B' AS d"),
    "misc_in_set": ("select _typeof(n_name) as t, _typeof(n_nationkey) as k, self(n_name) as s from nation", "SELECT 'STRING' AS t, 'INTEGER' AS k, n_name AS s FROM nation"),
    # programs
    "script_loop": ("declare total := 0; for r in (select n_nationkey from nation where n_nationkey < 6) loop if r.n_nationkey = 3 then begin continue; end; set total := total + r[0]; end loop; select total as t", "SELECT CAST(12 AS BIGINT) AS t"),
    "script_variable_table": ("declare t := (select n_nationkey, n_name from nation where n_regionkey = 1); select n_name from t where n_nationkey > 5", "SELECT n_name FROM nation WHERE n_regionkey = 1 AND n_nationkey > 5"),
    "dml_changes": (
        "declare t := (select n_nationkey as k, n_name as v from nation); update t set v = 'big' where k > 20; delete from t where k between 5 and 19; insert into t (k, v) values (100, 'new'); select k, v from t",
        "SELECT n_nationkey AS k, CASE WHEN n_nationkey > 20 THEN 'big' ELSE n_name END AS v FROM nation WHERE n_nationkey NOT BETWEEN 5 AND 19 UNION ALL SELECT 100, 'new'",
    ),
    # formats, over texts written once where executors can read them
    "fmt_csv": (
        "select id, name, ok, price, day from read_text(E'id;name;ok;price;day\\n1;\"a;b\";yes;1.5;2024-01-02\\n2;;no;;\\n3;c;on;2;2024-02-03 04:05:06', fmt => csv(delimiter => ';'))",
        "SELECT * FROM (VALUES (CAST(1 AS BIGINT), 'a;b', true, CAST(1.5 AS DOUBLE), TIMESTAMP '2024-01-02'), (2, '', false, NULL, NULL), (3, 'c', true, 2.0, TIMESTAMP '2024-02-03 04:05:06')) t(id, name, ok, price, day)",
    ),
    "fmt_csv_sniffed": ("select column0 + column1 as s from read_text(E'1|2\\n3|4', fmt => csv())", "SELECT * FROM (VALUES (CAST(3 AS BIGINT)), (7)) t(s)"),
    "fmt_tsv": ("select n, text from read_text(E'n\\ttext\\n1\\ta b\\n2\\tc', fmt => tsv())", "SELECT * FROM (VALUES (CAST(1 AS BIGINT), 'a b'), (2, 'c')) t(n, text)"),
    "fmt_ltsv": ("select time, status from read_text(E'time:10:20\\tstatus:200\\ntime:10:21\\tstatus:404', fmt => ltsv()) where status > 300", "SELECT '10:21' AS time, CAST(404 AS BIGINT) AS status"),
    "fmt_text_line": ("select text from read_text(E'one\\ntwo', fmt => text_line())", "SELECT * FROM (VALUES ('one'), ('two')) t(text)"),
    "fmt_json": ("select id, o.a[1] as a, z from read_text(E'{\"id\":1,\"o\":{\"a\":[1,2]}}\\n{\"id\":2,\"z\":true}', fmt => json())", "SELECT * FROM (VALUES (CAST(1 AS BIGINT), '2', NULL), (2, NULL, true)) t(id, a, z)"),
    "fmt_json_path": ("select k from read_text('{\"p\":{\"items\":[{\"k\":5},{\"k\":6}]}}', fmt => json(jsonpath => '$.p.items[?(@.k>5)]'))", "SELECT CAST(6 AS BIGINT) AS k"),
    "fmt_xml": ("select name, pop from read_text('<r><c name=\"A\"><pop>1</pop></c><c name=\"B\"><pop>2</pop></c></r>', fmt => xml(xpath => '//c'))", "SELECT * FROM (VALUES ('A', CAST(1 AS BIGINT)), ('B', 2)) t(name, pop)"),
    "fmt_regex": ("select day, level from read_text(E'2024-01-02 INFO x\\nnothing\\n2024-01-03 WARN y', fmt => regex('^(?<day>[0-9-]+) (?<level>[A-Z]+)'))", "SELECT * FROM (VALUES (TIMESTAMP '2024-01-02', 'INFO'), (NULL, NULL), (TIMESTAMP '2024-01-03', 'WARN')) t(day, level)"),
    "fmt_grok": ("select ip, verb, n from read_text(E'10.0.0.1 GET 12\\n10.0.0.2 PUT 7', fmt => grok('%{IPV4:ip} %{WORD:verb} %{INT:n:int}'))", "SELECT * FROM (VALUES ('10.0.0.1', 'GET', CAST(12 AS BIGINT)), ('10.0.0.2', 'PUT', 7)) t(ip, verb, n)"),
    "fmt_iisw3c": ("select date, \"sc-status\" as s from read_text(E'#Version: 1.0\\n#Fields: date time cs-uri-stem sc-status\\n2022-08-26 00:00:01 /a 200\\n2022-08-26 00:00:02 /b -', fmt => iisw3c())", "SELECT * FROM (VALUES (TIMESTAMP '2022-08-26 00:00:01', CAST(200 AS BIGINT)), (TIMESTAMP '2022-08-26 00:00:02', NULL)) t(date, s)"),
    "fmt_clef": ("select timestamp, level, x from read_text('{\"@t\":\"2024-01-02T03:04:05Z\",\"@l\":\"Warning\",\"x\":1}', fmt => clef())", "SELECT TIMESTAMP '2024-01-02 03:04:05' AS timestamp, 'Warning' AS level, CAST(1 AS BIGINT) AS x"),
    "src_cache_input": ("select count(*) as n from cache_input(orders, key => 'o', expire => interval '1h')", "SELECT count(*) AS n FROM orders"),
    "src_schema": ("select name, type from _schema(nation)", "SELECT * FROM (VALUES ('n_nationkey', 'integer'), ('n_name', 'string'), ('n_regionkey', 'integer')) t(name, type)"),
    "src_functions": ("select kind from _functions() where name in ('substr', 'csv', 'write')", "SELECT * FROM (VALUES ('scalar'), ('formatter'), ('sink')) t(kind)"),
    "src_buffer_retry": ("select count(*) as n from retry_input(buffer_input(region, 10), 2, 0.1)", "SELECT count(*) AS n FROM region"),
    "lateral_json_elements": ("select c.id, e.value as v from (select 1 as id, '[\"a\",2]' as j) as c, json_array_elements(c.j) as e", "SELECT CAST(1 AS BIGINT) AS id, unnest(['a', '2']) AS v"),
    "in_variable": ("declare keep := (select n_nationkey from nation where n_nationkey < 4); select n_name from nation where n_nationkey in keep", "SELECT n_name FROM nation WHERE n_nationkey < 4"),
    "zone_shift": ("select event_id, ts at time zone 'Asia/Tokyo' as t from events", "SELECT event_id, ts + INTERVAL 9 HOUR AS t FROM events"),
    "interval_parts": ("select extract(hour from interval '1d 2h 3m') as h, extract(day from interval '50h') as d, date_trunc('hour', interval '2h 59m') = interval '2h' as t", "SELECT CAST(2 AS BIGINT) AS h, CAST(2 AS BIGINT) AS d, true AS t"),
    "str_pad_misc": ("select to_char(7, 'D3') as d, to_char(1234.5, 'N1') as n, to_char(255, 'X') as x, chr(8364) as e, regexp_replace('aXbX', 'x', '-', 1, 'i') as r", "SELECT '007' AS d, '1,234.5' AS n, 'FF' AS x, '€' AS e, 'a-b-' AS r"),
    "hash_all": ("select sha1(n_name) as a, length(sha384(n_name)) as b, length(sha512(n_name)) as c from nation", "SELECT upper(sha1(n_name)) AS a, CAST(96 AS BIGINT) AS b, CAST(128 AS BIGINT) AS c FROM nation"),
    "script_if_while": ("declare i := 0; declare s := ''; while i < 5 loop set i := i + 1; if i % 2 = 0 then begin set s := s || i; end else begin set s := s || '-'; end; end loop; select s as s, i as i", "SELECT '-2-4-' AS s, CAST(5 AS BIGINT) AS i"),
    # what earlier rounds left without a query
    "set_intersect_all": ("select l_partkey as k from lineitem where l_quantity < 20 intersect all select l_partkey from lineitem where l_quantity >= 20", "SELECT l_partkey AS k FROM lineitem WHERE l_quantity < 20 INTERSECT ALL SELECT l_partkey FROM lineitem WHERE l_quantity >= 20"),
    "set_except_all": ("select l_partkey as k from lineitem where l_quantity < 40 except all select l_partkey from lineitem where l_quantity >= 40", "SELECT l_partkey AS k FROM lineitem WHERE l_quantity < 40 EXCEPT ALL SELECT l_partkey FROM lineitem WHERE l_quantity >= 40"),
    "set_union_lineitem": ("select l_suppkey as k from lineitem union select s_suppkey from supplier", "SELECT l_suppkey AS k FROM lineitem UNION SELECT s_suppkey FROM supplier"),
    "distinct_on_orders": ("select distinct on (o_custkey) o_custkey, o_orderkey from orders", "SELECT o_custkey, min(o_orderkey) AS o_orderkey FROM orders GROUP BY o_custkey"),
    "str_regex_orders": ("select doc_id, regexp_count(text, '[0-9]+') as n, regexp_substr(text, '[A-Z][a-z]+') as w from documents", "SELECT doc_id, len(regexp_extract_all(text, '[0-9]+')) AS n, nullif(regexp_extract(text, '[A-Z][a-z]+'), '') AS w FROM documents"),
    "quantified_big": (
        "select o_orderkey from orders where o_totalprice > any (select c_acctbal from customer) and o_totalprice > all (select l_extendedprice from lineitem) and o_custkey <> all (select s_suppkey from supplier where s_suppkey < 50)",
        "SELECT o_orderkey FROM orders WHERE o_totalprice > (SELECT min(c_acctbal) FROM customer) AND o_totalprice > (SELECT max(l_extendedprice) FROM lineitem) AND o_custkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_suppkey < 50)",
    ),
    "quantified_nulls": (
        "select 5 < any (select cast(null as integer) union all select 9) as a, 5 < all (select cast(null as integer) union all select 9) as b, 5 < all (select n_regionkey from nation where 1 = 0) as c, 5 <> any (select 5 union all select 6) as d, 5 = all (select 5) as e, cast(null as integer) <> all (select n_regionkey from nation where 1 = 0) as f, 5 <> all (select cast(null as integer)) as g",
        "SELECT true AS a, false AS b, true AS c, true AS d, true AS e, true AS f, false AS g",
    ),
    "subq_grouped_corr": (
        "select o_orderstatus, o.o_custkey, (select count(*) from (select * from customer c where c.c_custkey = o.o_custkey)) as n from orders o group by o_orderstatus",
        "SELECT o_orderstatus, first(o_custkey ORDER BY o_orderkey) AS o_custkey, CAST(1 AS BIGINT) AS n FROM orders GROUP BY o_orderstatus",
    ),
    "cte_twice": ("with a as (select n_regionkey as k, count(*) as n from nation group by n_regionkey) select x.k, y.n from a x join a y on x.k = y.k + 1", "WITH a AS (SELECT n_regionkey AS k, count(*) AS n FROM nation GROUP BY n_regionkey) SELECT x.k, y.n FROM a x JOIN a y ON x.k = y.k + 1"),
    "win_in_expr": ("select o_orderkey, o_totalprice / sum(o_totalprice) over (partition by o_custkey) as share from orders", "SELECT o_orderkey, o_totalprice / sum(o_totalprice) OVER (PARTITION BY o_custkey) AS share FROM orders"),
    "agg_row_number": ("select n_regionkey as k, row_number() as n from nation group by n_regionkey", "SELECT n_regionkey AS k, count(*) + 1 AS n FROM nation GROUP BY n_regionkey"),
    "agg_string_orders": ("select o_custkey, string_agg(o_orderkey::string, ',') as keys from orders group by o_custkey", "SELECT o_custkey, string_agg(o_orderkey, ',' ORDER BY o_orderkey) AS keys FROM orders GROUP BY o_custkey"),
    "float_by_zero": ("select l_orderkey, l_linenumber, l_quantity / (l_discount - l_discount) as q from lineitem", "SELECT l_orderkey, l_linenumber, 'inf'::DOUBLE AS q FROM lineitem"),
    "cast_offset": ("select to_char(cast('1987-06-12 +00' as timestamp) at time zone 'utc', 'yyyy-MM-dd') as a, cast('1987-06-12 +0200' as timestamp) as b, cast(10.23 as integer) as c", "SELECT '1987-06-12' AS a, TIMESTAMP '1987-06-11 22:00:00' AS b, CAST(10 AS BIGINT) AS c"),
    "trim_spec": ("select trim(leading 'N' from n_name) as a, trim(trailing from n_name || '  ') as b, trim(both 'N' from n_name) as c from nation", "SELECT ltrim(n_name, 'N') AS a, n_name AS b, trim(n_name, 'N') AS c FROM nation"),
    "str_base64": ("select n_nationkey, from_base64(to_base64(n_name))::string as s, length(from_base64(to_base64(n_name))) as n from nation", "SELECT n_nationkey, n_name AS s, length(n_name) AS n FROM nation"),
    "str_position_regex": ("select n_nationkey, position_regex('[0-9]' in n_name) as p from nation", "SELECT n_nationkey, strpos(n_name, regexp_extract(n_name, '[0-9]')) AS p FROM nation"),
    "math_inverse": (
        "select round(tan(n_nationkey / 20.0) * 1000000) as t, round(atan(n_nationkey / 20.0) * 1000000) as at, round(asin(n_nationkey / 25.0) * 1000000) as s, round(acos(n_nationkey / 25.0) * 1000000) as c from nation",
        "SELECT round_even(tan(n_nationkey / 20.0) * 1000000, 0)::DOUBLE AS t, round_even(atan(n_nationkey / 20.0) * 1000000, 0)::DOUBLE AS at, round_even(asin(n_nationkey / 25.0) * 1000000, 0)::DOUBLE AS s, round_even(acos(n_nationkey / 25.0) * 1000000, 0)::DOUBLE AS c FROM nation",
    ),
    "misc_volatile": ("select length(uuid()) as u, random() between 0 and 1 as r, now() > timestamp '2024-01-01' as n, nop(1) is null as p", "SELECT CAST(36 AS BIGINT) AS u, true AS r, true AS n, true AS p"),
    "json_texts": (
        "select json_value('{\"k\":\"[1,2]\"}', '$.k') as a, json_query('{\"k\":\"[1,2]\"}', '$.k') as b, json_query('{\"k\":[1,2]}', '$.k') as c, json_value('{\"k\":{\"z\":1}}', '$.k') as d, json_exists('{\"k\":{\"z\":1}}', '$.k.z') as e, json_value('{\"k\":null}', '$.k') as f",
        "SELECT '[1,2]' AS a, CAST(NULL AS VARCHAR) AS b, '[1,2]' AS c, CAST(NULL AS VARCHAR) AS d, true AS e, CAST(NULL AS VARCHAR) AS f",
    ),
    "json_write": ("select n_nationkey, to_json(n_name) as j from nation", "SELECT n_nationkey, '{\"value\":\"' || n_name || '\"}' AS j FROM nation"),
    "json_path_events": ("select event_id, json_value(props, '$.k') as k from events", "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events"),
    "lateral_join_on": ("select c.conv_id, c.turn from conversations c inner join string_to_table(c.text, ' ') w on w.value = c.role", "SELECT c.conv_id, c.turn FROM conversations c, unnest(string_split(c.text, ' ')) AS w(value) WHERE w.value = c.role"),
    "lateral_left_on": (
        "select n.n_nationkey, w.value as v from nation n left join string_to_table(n.n_name, '_') w on w.value like '1%'",
        "SELECT n_nationkey, v FROM nation LEFT JOIN LATERAL (SELECT unnest(string_split(n_name, '_')) AS v) w ON v ILIKE '1%'",
    ),
    "lateral_subquery": ("select n.n_nationkey, s.value as v from nation n, (select value from string_to_table(n.n_name, '_')) s", "SELECT n_nationkey, unnest(string_split(n_name, '_')) AS v FROM nation"),
    "lateral_subquery_top": (
        "select r.r_name, s.k from region r, (select n_nationkey as k from nation n where n.n_regionkey = r.r_regionkey order by n_nationkey desc limit 2) s",
        "SELECT r_name, k FROM region r, LATERAL (SELECT n_nationkey AS k FROM nation n WHERE n.n_regionkey = r.r_regionkey ORDER BY n_nationkey DESC LIMIT 2) s",
    ),
    "fmt_csv_multiline": ("select id, v from read_text(E'id,v\\n1,\"two\\nlines\"\\n2,x', fmt => csv())", "SELECT * FROM (VALUES (CAST(1 AS BIGINT), 'two' || chr(10) || 'lines'), (2, 'x')) t(id, v)"),
    "fmt_csv_wide": ("select a, column2 as c from read_text(E'a,b\\n" + "1,2\\n" * 12 + "3,4,5', fmt => csv()) where column2 is not null", "SELECT CAST(3 AS BIGINT) AS a, '5' AS c"),
    "fmt_csv_empty_lines": ("select count(*) as n, count(b) as k from read_text(E'a,b\\n1,2\\n\\n3,4', fmt => csv(skip_empty_lines => false))", "SELECT CAST(3 AS BIGINT) AS n, CAST(2 AS BIGINT) AS k"),
    "fmt_csv_repeated": ("select a, b from read_text(E'a  b\\n1   x\\n2 y', fmt => csv(delimiter => ' ', delimiter_can_repeat => true))", "SELECT * FROM (VALUES (CAST(1 AS BIGINT), 'x'), (2, 'y')) t(a, b)"),
    "fmt_json_late_field": ("select id, late from read_text(E'" + "{\"id\":1}\\n" * 12 + "{\"id\":2,\"late\":\"x\"}', fmt => json()) where late is not null", "SELECT CAST(2 AS BIGINT) AS id, 'x' AS late"),
    "fmt_json_together": ("select a, b from read_text(E'{\"a\":1}{\"a\":2}\\n{\"a\":\\n3, \"b\":[1]} [{\"a\":4}]', fmt => json())", "SELECT * FROM (VALUES (CAST(1 AS BIGINT), NULL), (2, NULL), (3, '[1]'), (4, NULL)) t(a, b)"),
    "fmt_ltsv_late": ("select a, z from read_text(E'" + "a:1\\n" * 12 + "z:5', fmt => ltsv()) where z is not null", "SELECT CAST(NULL AS BIGINT) AS a, '5' AS z"),
    "fmt_grok_free": ("select T1, str, day from read_text('string - \"quote\" - [10/1/2023]', fmt => grok('%{T1} - %{QS:str} - \\[%{DATE_US:day}\\]'))", "SELECT 'string' AS T1, '\"quote\"' AS str, TIMESTAMP '2023-10-01' AS day"),
    "fmt_grok_numbers": ("select fl, hx, yr, sec from read_text('0.02,0xFF,2023,59', fmt => grok('%{BASE16FLOAT:fl},%{BASE16NUM:hx},%{YEAR:yr},%{SECOND:sec:str}'))", "SELECT CAST(0.02 AS DOUBLE) AS fl, CAST(255 AS BIGINT) AS hx, CAST(2023 AS BIGINT) AS yr, '59' AS sec"),
    "fmt_raw": ("select length(value) as n, value::string as v from read_text('abcé', fmt => raw_fmt())", "SELECT CAST(5 AS BIGINT) AS n, 'abcé' AS v"),
    "fmt_null": ("select count(*) as n from read_text('abc', fmt => null_fmt())", "SELECT CAST(0 AS BIGINT) AS n"),
    "src_ls_dir": ("select name from ls_dir(folder) where name like '%.parquet'", "SELECT unnest(['benchmark.parquet', 'conversations.parquet', 'customer.parquet', 'documents.parquet', 'embeddings.parquet', 'events.parquet', 'labels.parquet', 'lineitem.parquet', 'nation.parquet', 'orders.parquet', 'pages.parquet', 'part.parquet', 'region.parquet', 'supplier.parquet']) AS name"),
    "src_delay": ("select count(*) as n from delay_input(region, 0)", "SELECT count(*) AS n FROM region"),
    "src_variable": ("declare v := 5; select value + 1 as w from v", "SELECT CAST(6 AS BIGINT) AS w"),
    "src_plugins": ("select count(*) as n from _plugins()", "SELECT CAST(0 AS BIGINT) AS n"),
    "src_zones": ("select count(*) > 400 as many from _timezone_names()", "SELECT true AS many"),
    "script_break_return": ("declare i := 0; while true loop set i := i + 1; if i = 7 then begin break; end; end loop; select i as i", "SELECT CAST(7 AS BIGINT) AS i"),
    "script_open": ("declare t := open region; select count(*) as n from t", "SELECT count(*) AS n FROM region"),
    "read_by_uri": ("select count(*) as n, sum(o_totalprice) as s from read_file(folder || '/orders.parquet') as o", "SELECT count(*) AS n, sum(o_totalprice) AS s FROM orders"),
}


def engine_on(spark: SparkSession, sf_dir: str) -> Engine:
    engine = Engine(spark)
    for name in TABLES:
        engine.register(name, spark.read.parquet(f"{sf_dir}/{name}.parquet"))
    return engine


def used(text: str) -> list[str]:
    return [t for t in TABLES if t in text]


def from_text(text: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        engine = Engine(spark)
        for name in used(text):
            engine.register(name, spark.read.parquet(f"{sf_dir}/{name}.parquet"))
        return engine.query(text, folder=sf_dir)

    return run


def pivot_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return orders.groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).agg(F.count(F.lit(1)))


def keyed_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A look-up join: the small side's keys prune the large side by a broadcast or a merge,
    as its size allows."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").filter("o_totalprice > 400000").select("o_orderkey")
    lineitem = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_quantity")
    return lineitem.join(orders, lineitem.l_orderkey == orders.o_orderkey).select("l_orderkey", "l_linenumber", "l_quantity")


def placed(engine: Engine, files: dict[str, str]) -> str:
    """Small texts as files of a new folder that all executors see."""
    folder = f"{engine.folder()}/files-{uuid.uuid4().hex}"
    for name, text in files.items():
        formats.write_file(engine.spark, f"{folder}/{name}", iter([text.encode()]))
    return folder


def fmt_csv_two_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same names in another order: files are read by name."""
    engine = Engine(spark)
    folder = placed(engine, {"a.csv": "id,v\n1,a\n2,b\n", "b.csv": "v,id\nc,3\n"})
    return engine.query(f"select id, v from '{folder}/*.csv'")


def lateral_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each row names the file it is joined with."""
    engine = Engine(spark)
    folder = placed(engine, {"a.csv": "id,v\n1,a\n2,b\n", "b.csv": "id,v\n3,c\n", "list.csv": "k,name\n10,a\n20,b\n"})
    return engine.query(f"select s.k, f.id, f.v from '{folder}/list.csv' s, read_file('{folder}/' || s.name || '.csv') f")


def lateral_column_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A column as a source, also in a scalar subquery."""
    engine = Engine(spark)
    folder = placed(engine, {"a.csv": "id,v\n1,a\n2,b\n", "b.csv": "id,v\n3,c\n"})
    return engine.query(f"with s as (select column1 as k, '{folder}/' || column2 as source from (values (1, 'a.csv'), (2, 'b.csv'))) select s.k, v.id, (select top 1 x.v from s.source x) as first from s, s.source as v")


def squares(spark: SparkSession, sf_dir: str) -> Engine:
    """An engine with a keyed source of squares."""
    engine = engine_on(spark, sf_dir)
    engine.register_keyed("squares", "id long, square long", {"id": True}, lambda key: [(key["id"], key["id"] * key["id"])])
    return engine


KEYED = {
    "keyed_literal": ("select id, square from squares() where id = 7", "SELECT CAST(7 AS BIGINT) AS id, CAST(49 AS BIGINT) AS square"),
    "keyed_in_list": ("select id, square from squares where id in (2, 3)", "SELECT * FROM (VALUES (CAST(2 AS BIGINT), CAST(4 AS BIGINT)), (3, 9)) t(id, square)"),
    "keyed_in_query": ("select id, square from squares() where id in (select o_custkey from orders)", "SELECT DISTINCT CAST(o_custkey AS BIGINT) AS id, CAST(o_custkey * o_custkey AS BIGINT) AS square FROM orders"),
    "keyed_in_variable": ("declare q := (select n_nationkey from nation where n_regionkey = 1); select id, square from squares() where id in q", "SELECT CAST(n_nationkey AS BIGINT) AS id, CAST(n_nationkey * n_nationkey AS BIGINT) AS square FROM nation WHERE n_regionkey = 1"),
    "keyed_join": ("select c.c_custkey, s.square from customer c inner join squares() s on s.id = c.c_nationkey", "SELECT c_custkey, CAST(c_nationkey * c_nationkey AS BIGINT) AS square FROM customer"),
    "keyed_self_join": ("select a.id, b.square from squares() a inner join squares() b on a.id = b.id where a.id in (select n_nationkey from nation)", "SELECT CAST(n_nationkey AS BIGINT) AS id, CAST(n_nationkey * n_nationkey AS BIGINT) AS square FROM nation"),
}


def keyed(text: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: squares(spark, sf_dir).query(text)


def src_uri_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Engine(spark).query(f"select o_orderstatus, count(*) as n from '{sf_dir}/orders.parquet' format parquet() group by o_orderstatus")


def sink_into(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written by INTO and read back, as CSV, JSON and XML."""
    engine = engine_on(spark, sf_dir)
    folder = f"{engine.folder()}/into-{uuid.uuid4().hex}"
    for kind in ("csv", "json", "xml"):
        engine.run(f"select n_nationkey as k, n_name as v into write_file('{folder}/{kind}.{kind}') from nation")
    return engine.query(f"select 'csv' as f, k, v from '{folder}/csv.csv' union all select 'json', k, v from '{folder}/json.json' union all select 'xml', k, v from '{folder}/xml.xml' format xml(xpath => '//row')")


def sink_varying(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One file for each value of a column of the rows."""
    engine = engine_on(spark, sf_dir)
    folder = f"{engine.folder()}/varying-{uuid.uuid4().hex}"
    engine.run(f"select '{folder}/' || n_regionkey || '.csv' as target, n_nationkey as k, n_name as v into write_file(target) from nation")
    return engine.query(f"select split_part(t.path, '/', -1) as file, f.k, f.v from ls_dir('{folder}') t, t.path as f")


def sink_text_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows of a text table are written and read again."""
    engine = engine_on(spark, sf_dir)
    path = f"{engine.folder()}/table-{uuid.uuid4().hex}.txt"
    engine.run(f"select o_orderkey as k, o_orderstatus as s into write_file('{path}', text_table()) from orders")
    return engine.query(f"select k, s from '{path}' format text_table()")


def user_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A scalar function, an aggregate and a table function of the user."""
    engine = engine_on(spark, sf_dir)
    engine.add_function("half(x: integer): integer", lambda x: None if x is None else x // 2)
    engine.add_function("plus_one(x: integer): integer", lambda s: s + 1, vectorized=True)
    engine.add_aggregate("spread(x: integer): integer", lambda values: max(values) - min(values))
    engine.add_table_function("ones(n: integer): object", lambda e, n: e.spark.range(n).selectExpr("id + 1 AS one"))
    return engine.query("select n_regionkey as k, spread(half(plus_one(n_nationkey))) as s from nation where n_regionkey + 1 in (select one from ones(3)) group by n_regionkey")


def numbered_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return engine_on(spark, sf_dir).numbered("select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey")


def tail_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = engine_on(spark, sf_dir)
    text = "select o_orderkey from orders order by o_orderkey"
    return spark.createDataFrame(engine.tail(text, 5), engine.schema(text))


def paged_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three ways to fetch: numbered pages, offsets until one is short, and tokens."""
    datasource.register(spark, datasource.paged_source("lantern_pages", "how string, n long", 3, lambda page: [("page", page)]))
    datasource.register(spark, datasource.offset_source("lantern_offsets", "how string, n long", lambda at, most: [("offset", i) for i in range(at, min(at + most, 25))], 10))
    datasource.register(spark, datasource.chained_source("lantern_tokens", "how string, n long", lambda token: ([("token", token or 0)], None if token == 4 else (token or 0) + 1)))
    parts = [spark.read.format(f"lantern_{n}").load() for n in ("pages", "offsets", "tokens")]
    return parts[0].union(parts[1]).union(parts[2])


def typed_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects with column names of a policy, nested values and whole objects as JSON text."""
    engine = Engine(spark)
    engine.register_objects("things", [{"fullName": "a", "tags": [1, 2]}, {"fullName": "b", "tags": []}], naming=snake_case, json_columns=("tags",), data_column="data")
    return engine.query("select full_name, json_array_length(tags) as n, json_value(data, '$.fullName') as again from things")


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A question that the engine's assistant turns into a query."""
    engine = engine_on(spark, sf_dir)
    engine.assistant = lambda question, schemas: f"select count(*) as n, {len(schemas)} as sources from nation"
    return engine.query("select n, sources from ai_input('how many nations?', nation)")


def observed_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows and errors counted while a query runs."""
    _, facts = engine_on(spark, sf_dir).observed("select o_orderkey, o_orderstatus = 'P' as error from orders")
    return spark.createDataFrame([(facts["rows"], facts["errors"])], "n long, errors long")


CODE: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {
    "pivot_status": (pivot_status, "SELECT o_orderpriority, nullif(count(*) FILTER (o_orderstatus = 'F'), 0) AS F, nullif(count(*) FILTER (o_orderstatus = 'O'), 0) AS O, nullif(count(*) FILTER (o_orderstatus = 'P'), 0) AS P FROM orders GROUP BY o_orderpriority"),
    "lookup_join": (keyed_lookup, "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_totalprice > 400000"),
    "event_windows": (
        lambda spark, d: windows.tumbling(spark.read.parquet(f"{d}/events.parquet"), "ts", "1 hour", ["event_type"]),
        "SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY 1, 2",
    ),
    "event_sessions": (
        lambda spark, d: windows.sessions(spark.read.parquet(f"{d}/events.parquet"), "ts", "30 minutes", ["user_id"]),
        "WITH a AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), b AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM a) SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 30 MINUTE AS session_end, count(*) AS n FROM b GROUP BY user_id, s",
    ),
    "fmt_csv_two_headers": (fmt_csv_two_headers, "SELECT * FROM (VALUES (CAST(1 AS BIGINT), 'a'), (2, 'b'), (3, 'c')) t(id, v)"),
    "lateral_files": (lateral_files, "SELECT * FROM (VALUES (CAST(10 AS BIGINT), CAST(1 AS BIGINT), 'a'), (10, 2, 'b'), (20, 3, 'c')) t(k, id, v)"),
    "lateral_column_source": (lateral_column_source, "SELECT * FROM (VALUES (CAST(1 AS BIGINT), CAST(1 AS BIGINT), 'a'), (1, 2, 'a'), (2, 3, 'c')) t(k, id, first)"),
    **{name: (keyed(text), oracle) for name, (text, oracle) in KEYED.items()},
    "src_uri_format": (src_uri_format, "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY o_orderstatus"),
    "sink_into": (sink_into, "SELECT f, CAST(n_nationkey AS BIGINT) AS k, n_name AS v FROM nation, (VALUES ('csv'), ('json'), ('xml')) t(f)"),
    "sink_varying": (sink_varying, "SELECT n_regionkey || '.csv' AS file, CAST(n_nationkey AS BIGINT) AS k, n_name AS v FROM nation"),
    "sink_text_table": (sink_text_table, "SELECT CAST(o_orderkey AS BIGINT) AS k, o_orderstatus AS s FROM orders"),
    "user_functions": (user_functions, "SELECT n_regionkey AS k, CAST(max((n_nationkey + 1) // 2) - min((n_nationkey + 1) // 2) AS BIGINT) AS s FROM nation WHERE n_regionkey < 3 GROUP BY n_regionkey"),
    "numbered_rows": (numbered_rows, "SELECT row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS row_number, o_orderkey, o_totalprice FROM orders"),
    "tail_rows": (tail_rows, "SELECT o_orderkey FROM orders ORDER BY o_orderkey DESC LIMIT 5"),
    "paged_rows": (paged_rows, "SELECT 'page' AS how, unnest(range(3)) AS n UNION ALL SELECT 'offset', unnest(range(25)) UNION ALL SELECT 'token', unnest(range(5))"),
    "typed_objects": (typed_objects, "SELECT * FROM (VALUES ('a', CAST(2 AS BIGINT), 'a'), ('b', 0, 'b')) t(full_name, n, again)"),
    "ai_input": (asked, "SELECT count(*) AS n, CAST(1 AS BIGINT) AS sources FROM nation"),
    "observed_rows": (observed_rows, "SELECT count(*) AS n, count(*) FILTER (o_orderstatus = 'P') AS errors FROM orders"),
}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return from_text(FLAGSHIP)(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {n: from_text(t) for n, (t, _) in TEXTS.items()} | {n: f for n, (f, _) in CODE.items()}


def oracle_sql() -> dict[str, str]:
    return {n: o for n, (_, o) in TEXTS.items()} | {n: o for n, (_, o) in CODE.items()}
