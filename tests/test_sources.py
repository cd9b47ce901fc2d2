"""Formats, sniffing, sinks, data sources and follow mode."""

import io

import pytest
from pyspark.sql import functions as F

from lanternql.errors import QueryError
from lanternql.operators.relational import series
from lanternql.sources import grok, sniff
from lanternql.sources.datasource import keyed_source, paged_source, register
from lanternql.streaming import follow, windows


def rows(result):
    return [tuple(r) for r in result.collect()]


def put(tmp_path, name, text):
    path = tmp_path / name
    path.write_text(text)
    return str(path)


def test_sniffing():
    assert sniff.delimiter_of(["a;b;c", "1;2;3,5"]) == ";"
    assert sniff.type_of(["1", "", "2"]) == "integer" and sniff.type_of(["1", "2.5"]) == "float" and sniff.type_of(["yes", "no"]) == "boolean"
    assert sniff.type_of(["2024-01-02", "2024-01-02 03:04:05"]) == "timestamp" and sniff.type_of(["", "NULL"]) == "string"
    assert sniff.has_header([["id", "name"], ["1", "x"]]) and not sniff.has_header([["1", "x"], ["2", "y"]])


def test_csv(engine, tmp_path):
    path = put(tmp_path, "a.csv", 'id,name,on,price,day\n1,"x, ""y""",yes,1.5,2024-01-02\n2,,no,,\nbad,z,maybe,2,2024-02-03 04:05:06\n')
    df = engine.query(f"select * from '{path}' order by name")
    assert df.columns == ["filename", "id", "name", "on", "price", "day"]
    got = rows(engine.query(f"select id, name, price, filename from '{path}' where id = '1'"))
    assert got == [("1", 'x, "y"', 1.5, "a.csv")]  # a bad value among the first rows makes id text
    path = put(tmp_path, "b.csv", "1\t2\n3\t4\n")
    assert rows(engine.query(f"select column0 + column1 as s from '{path}' order by 1")) == [(3,), (7,)]
    assert rows(engine.query(f"select count(*) as n from '{path}??has_header=true'")) == [(1,)]
    put(tmp_path, "c1.csv", "id,v\n1,a\n")
    put(tmp_path, "c2.csv", "id,v\n2,b\n")
    assert rows(engine.query(f"select id, filename from '{tmp_path}/c?.csv' order by id")) == [(1, "c1.csv"), (2, "c2.csv")]
    assert rows(engine.query(f"select count(*) as n from '{tmp_path}/**/c*.csv'")) == [(2,)]


def test_late_bad_value_is_null(engine, tmp_path):
    path = put(tmp_path, "late.csv", "id\n" + "\n".join(map(str, range(30))) + "\noops\n")
    assert rows(engine.query(f"select count(*) as n, count(id) as k from '{path}'")) == [(31, 30)]


def test_other_formats(engine, tmp_path):
    tsv = put(tmp_path, "x.tsv", "n\ttext\n1\ta b\n")
    assert rows(engine.query(f"select n, text from '{tsv}'")) == [(1, "a b")]
    ltsv = put(tmp_path, "x.ltsv", 'time:10:20\tstatus:200\treq:"GET /"\ntime:10:21\tstatus:404\treq:"GET /x"\n')
    assert rows(engine.query(f"select time, status, req from '{ltsv}' where status > 300")) == [("10:21", 404, "GET /x")]
    text = put(tmp_path, "x.txt", "one\ntwo\n")
    assert rows(engine.query(f"select text from '{text}'")) == [("one",), ("two",)]
    lines = put(tmp_path, "x.json", '{"id": 1, "o": {"a": [1, 2]}}\n{"id": 2, "z": true}\n')
    assert rows(engine.query(f"select id, o.a as a, z from '{lines}' order by id")) == [(1, "[1,2]", None), (2, None, True)]
    array = put(tmp_path, "y.json", '[{"id": 1,\n "p": {"items": [{"k": 5}, {"k": 6}]}}]')
    assert rows(engine.query(f"select id from '{array}'")) == [(1,)]
    assert rows(engine.query(f"select sum(k) as s from '{array}' format json(jsonpath => '$[0].p.items[*]')")) == [(11,)]
    xml = put(tmp_path, "x.xml", '<root><c name="A"><pop>1</pop></c><c name="B"><pop>2</pop></c></root>')
    assert rows(engine.query(f"select name, pop from '{xml}' order by 1")) == [("A", 1), ("B", 2)]
    log = put(tmp_path, "x.log", "2024-01-02 INFO start\nnothing here\n2024-01-03 WARN stop\n")
    got = rows(engine.query(f"select day, level from '{log}' format regex('^(?<day>\\S+) (?<level>[A-Z]+) ')"))
    assert [r[1] for r in got] == ["INFO", None, "WARN"]
    iis = put(tmp_path, "u_ex.log", "#Version: 1.0\n#Fields: date time cs-uri-stem sc-status time-taken\n2022-08-26 00:00:01 /a 200 15\n2022-08-26 00:00:02 /b - 7\n")
    assert rows(engine.query(f'select "cs-uri-stem" as u, "sc-status" as s from \'{iis}\' format iisw3c() order by date')) == [("/a", 200), ("/b", None)]
    clef = put(tmp_path, "x.clef", '{"@t":"2024-01-02T03:04:05Z","@l":"Warning","@mt":"hi {x}","x":1}\n')
    assert rows(engine.query(f"select level, message_template, x from '{clef}'")) == [("Warning", "hi {x}", 1)]
    table = put(tmp_path, "x.tab.txt", "| a | b    |\n| - | ---- |\n| 1 | NULL |\n| 2 | y z  |\n")
    assert rows(engine.query(f"select a, b from '{table}' format text_table()")) == [(1, None), (2, "y z")]
    raw = put(tmp_path, "x.bin", "abc")
    assert rows(engine.query(f"select length(value) as n from '{raw}'")) == [(3,)]


def test_grok(engine):
    regex, fields = grok.expand("%{IPV4:ip} %{WORD:verb} %{NUMBER:took:float}")
    assert [f[0] for f in fields] == ["ip", "verb", "took"]
    line = '10.1.1.1 - - [26/May/2017:21:54:26 +0000] "POST /x HTTP/1.1" 200 263'
    got = rows(engine.query(f"""select clientip, verb, response, to_char("timestamp", 'yyyy-MM-dd HH:mm:ss') as t from read_text('{line}', fmt => grok('%{{COMMONAPACHELOG}}'))"""))
    assert got == [("10.1.1.1", "POST", 200.0, "2017-05-26 21:54:26")]
    with pytest.raises(QueryError):
        grok.expand("%{NOSUCH:x}")


def test_sinks(engine, tmp_path):
    assert engine.run(f"select 1 as a, 'x' as b into write_file('{tmp_path}/o.csv')") is None
    assert rows(engine.query(f"select a, b from '{tmp_path}/o.csv'")) == [(1, "x")]
    engine.run(f"select a, b into '{tmp_path}/o.json' from '{tmp_path}/o.csv'")
    assert rows(engine.query(f"select a from '{tmp_path}/o.json'")) == [(1,)]
    engine.run(f"insert into '{tmp_path}/o.csv' (a, b) values (2, 'y')")
    engine.run(f"update '{tmp_path}/o.csv' set b = 'z' where a = 1")
    assert rows(engine.query(f"select a, b from '{tmp_path}/o.csv' order by a")) == [(1, "z"), (2, "y")]
    engine.run(f"delete from '{tmp_path}/o.csv' where a = 2")
    assert rows(engine.query(f"select count(*) as n from '{tmp_path}/o.csv'")) == [(1,)]
    engine.run(f"select '{tmp_path}/' || column1 as target, column2 as v into write_file(target, text_line()) from (values ('p', 1), ('q', 2)) as v")
    assert rows(engine.query(f"select text from '{tmp_path}/q' format text_line()")) == [("2",)]
    out = io.StringIO()
    engine.out = out
    engine.run("select 1 as a, null as b into stdout()")
    assert out.getvalue().splitlines() == ["| a | b    |", "| - | ---- |", "| 1 | NULL |"]
    engine.run("select 1 as a into write_null()")


def test_cache_and_listing(engine, tmp_path):
    path = put(tmp_path, "k.csv", "a,b\n1,2\n")
    assert rows(engine.query(f"select a from cache_input(read_file('{path}'), key => 'k', expire => interval '1h')")) == [(1,)]
    assert "k" in engine.cache
    assert rows(engine.query(f"select name, type from ls_dir('{tmp_path}')")) == [("k.csv", "file")]


def test_keyed_source(spark, engine):
    stock = keyed_source("stocks", "id int, name string, usd int", {"id": True}, lambda given: [(given["id"], f"n{given['id']}", 10 * given["id"])])
    register(spark, stock)
    engine.register("stocks", lambda: spark.read.format("stocks").load())
    assert rows(engine.query("select name from stocks where id in (2, 3) order by 1")) == [("n2",), ("n3",)]
    with pytest.raises(Exception, match="the query must give id"):
        engine.query("select name from stocks").collect()
    register(spark, paged_source("pages3", "page int, row int", 3, lambda n: [(n, i) for i in range(2)]))
    assert spark.read.format("pages3").load().count() == 6


def test_series(spark):
    from pyspark.sql import types as T

    got = spark.range(1).select(series(F.lit(1.0), F.lit(2.0), F.lit(0.5), T.DoubleType()).alias("a"), series(F.lit(5), F.lit(1), F.lit(1), T.LongType()).alias("b")).head()
    assert got["a"] == [1.0, 1.5, 2.0] and got["b"] == [5]


def test_follow(spark, tmp_path):
    path = tmp_path / "grow.log"
    path.write_text("a\nb\nhalf")
    seen = []
    query = follow.start(follow.follow_file(spark, str(path)), lambda df, n: seen.extend(r[0] for r in df.collect()), f"{tmp_path}/cp", "0 seconds")
    query.processAllAvailable()
    with path.open("a") as f:
        f.write(" done\n")
    query.processAllAvailable()
    query.stop()
    assert seen == ["a", "b", "half done"]


def test_stream_windows(spark, tmp_path):
    events = spark.createDataFrame([("2024-01-01 00:00:01", "x"), ("2024-01-01 00:00:59", "x"), ("2024-01-01 00:01:00", "y")], "ts string, k string").select(F.col("ts").cast("timestamp").alias("ts"), "k")
    events.write.parquet(f"{tmp_path}/in")
    stream = windows.tumbling(follow.follow_folder(spark, f"{tmp_path}/in", events.schema, "parquet"), "ts", "1 minute", ["k"], "10 seconds")
    query = stream.writeStream.outputMode("complete").format("memory").queryName("seen").start()
    query.processAllAvailable()
    query.stop()
    assert sorted((str(r[0]), r[1], r[2]) for r in spark.table("seen").collect()) == [("2024-01-01 00:00:00", "x", 2), ("2024-01-01 00:01:00", "y", 1)]
    assert windows.sliding(events, "ts", "2 minutes", "1 minute", ["k"]).count() == 4


def test_names_of_all_rows(engine, tmp_path):
    """Fields, labels and columns first seen after the rows that types are guessed from."""
    many = "\n".join('{"id":%d}' % i for i in range(40))
    path = put(tmp_path, "late.json", many + '\n{"id":99,"late":"x","deep":{"a":1}}\n')
    assert rows(engine.query(f"select id, late, deep from '{path}' where late is not null")) == [(99, "x", '{"a":1}')]
    path = put(tmp_path, "late.ltsv", "a:1\n" * 40 + "z:5\n")
    assert rows(engine.query(f"select z from '{path}' where z is not null")) == [("5",)]
    path = put(tmp_path, "wide.csv", "a,b\n" + "1,2\n" * 40 + '3,"x,y",5\n')
    assert rows(engine.query(f"select a, b, column2 from '{path}' where column2 is not null")) == [(3, None, "5")]  # what is no number is null
    path = put(tmp_path, "path.json", '{"x":[' + ",".join('{"k":%d}' % i for i in range(30)) + ',{"late":1}]}')
    assert rows(engine.query(f"select late from '{path}??$.x[*]' where late is not null")) == [(1,)]


def test_records_over_lines(engine, tmp_path):
    path = put(tmp_path, "lines.csv", 'id,v\r\n1,"two\r\nlines"\r\n2,"a ""b"", c"\r\n')
    assert rows(engine.query(f"select id, v from '{path}' order by id")) == [(1, "two\nlines"), (2, 'a "b", c')]  # Spark reads any line end as \\n
    path = put(tmp_path, "many.json", '{"a":1}{"a":2}\n{"a":\n3, "b":[1]} [{"a":4}, 5]')
    assert sorted(rows(engine.query(f"select a, b, value from '{path}'")), key=repr) == sorted([(1, None, None), (2, None, None), (3, "[1]", None), (4, None, None), (None, None, 5)], key=repr)


def test_files_go_together_by_name(engine, tmp_path):
    put(tmp_path, "h1.csv", "id,v\n1,a\n")
    put(tmp_path, "h2.csv", "V,Id\nb,2\n")
    assert rows(engine.query(f"select id, v, filename from '{tmp_path}/h?.csv' order by id")) == [(1, "a", "h1.csv"), (2, "b", "h2.csv")]
    put(tmp_path, "h3.csv", "id,w\n3,c\n")
    with pytest.raises(QueryError, match="different columns"):
        engine.query(f"select * from '{tmp_path}/h?.csv'")


def test_headers():
    fits = sniff.has_header
    assert fits([["name", "city"], ["Bob", "Rome"], ["Ann", "Oslo"]]) and fits([["id", "on"], ["1", "yes"]]) and fits([["a", "b"], ["", "2"]])
    assert not fits([["name", "name"], ["x", "y"]]) and not fits([["true", "x"], ["false", "y"]]) and not fits([["a", ""], ["1", "2"]])
    assert not fits([["AB-12", "x"], ["CD-34", "x"], ["EF-56", "x"]]) and not fits([["2024-01-02"], ["2024-01-03"]]) and not fits([["a"]])


def test_text_table_has_all_rows(engine):
    out = io.StringIO()
    engine.out = out
    engine.run("select value as n into stdout() from generate_series(1, 1500)")
    assert len(out.getvalue().splitlines()) == 1502


def test_raw_bytes_survive(engine, tmp_path):
    blob = bytes(range(256)) * 3
    (tmp_path / "b.bin").write_bytes(blob)
    engine.run(f"select value into '{tmp_path}/copy.bin' from '{tmp_path}/b.bin'")
    assert (tmp_path / "copy.bin").read_bytes() == blob
    from lanternql.sources.formats import Format

    assert bytes(engine.read_blob(blob, Format("raw_fmt")).head()["value"]) == blob


def test_grok_names():
    assert len(grok.PATTERNS) == 73
    regex, fields = grok.expand("%{free} %{TTY:tty} %{IPV6:ip}")
    assert [f[0] for f in fields] == ["free", "tty", "ip"]
    import re

    assert re.compile(regex.replace(r"\p{Alnum}", "A-Za-z0-9")).groups == 3
    assert "_lantern" not in grok.expand("%{SYSLOGBASE}")[0] and [f[0] for f in grok.expand("%{SYSLOGBASE:line}")[1]] == ["line"]


def test_lateral_errors(engine, tmp_path):
    put(tmp_path, "a.csv", "id\n1\n")
    put(tmp_path, "b.csv", "other\n1\n")
    with pytest.raises(QueryError, match="different columns"):
        engine.query(f"select f.id from (values ('{tmp_path}/a.csv'), ('{tmp_path}/b.csv')) c, c.column1 as f")
    with pytest.raises(QueryError, match="cannot"):
        engine.query(f"select f.id from (values ('{tmp_path}/a.csv')) c right join read_file(c.column1) f on f.id = 1")
    none = engine.query(f"select c.column2 as k, f.id from (values ('{tmp_path}/a.csv', 1), ('{tmp_path}/a.csv', 2)) c left join read_file(c.column1) f on f.id = c.column2")
    assert sorted(rows(none), key=repr) == [(1, 1), (2, None)]


def test_keyed_source_needs_its_keys(engine):
    asked = []
    engine.register_keyed("rates", "day long, land string, rate double", {"day": True, "land": False}, lambda k: asked.append(k) or [(k["day"], k.get("land") or "any", 1.5)])
    with pytest.raises(QueryError, match="must give day"):
        engine.query("select * from rates where land = 'x'")
    assert rows(engine.query("select land, rate from rates() r where r.day = 3 and land = 'de'")) == [("de", 1.5)]
    assert rows(engine.query("select day from rates where day in (1, 2) order by day")) == [(1,), (2,)]


def test_tail_then_follow(spark, tmp_path):
    path = put(tmp_path, "log.txt", "".join(f"line {i}\n" for i in range(50_000)))
    reader = follow.GrowingFileReader(path, 3)
    assert reader.lines(reader.initialOffset()["byte"], None)[0] == [("line 49997",), ("line 49998",), ("line 49999",)]
    assert follow.GrowingFileReader(path, 0).initialOffset()["byte"] == len("".join(f"line {i}\n" for i in range(50_000)))
    assert follow.GrowingFileReader(path, 10**6).initialOffset() == follow.GrowingFileReader(path, None).initialOffset() == {"byte": 0}


def test_observed_errors(engine):
    df, facts = engine.observed("select value as n, value > 7 as error from generate_series(1, 10)")
    assert facts == {"rows": 10, "errors": 3} and df.count() == 10
    with pytest.raises(QueryError, match="3 errors"):
        engine.observed("select value > 7 as error from generate_series(1, 10)", most_errors=2)


def test_plugins(engine, monkeypatch):
    import importlib.metadata

    class Point:
        name = "greeter"

        def load(self):
            return lambda e: e.add_function("greet(x: string): string", lambda x: f"hi {x}")

    monkeypatch.setattr(importlib.metadata, "entry_points", lambda group: [Point()])
    engine.load_plugins()
    assert rows(engine.query("select greet('you') as g")) == [("hi you",)]
    assert rows(engine.query("select name from _plugins()")) == [("greeter",)]
