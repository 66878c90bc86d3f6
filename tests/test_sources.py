"""Feeds as files, and plans that streams keep up to date."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from stockweave.plans import projection as stock
from stockweave.sources import files
from stockweave.streaming import events


@pytest.mark.parametrize(("sep", "name"), [("\t", "feed.tsv"), (";", "feed.csv"), (",", "feed"), ("|", "feed.csv"), ("\t", "feed")])
def test_delimited_feeds_of_any_separator_and_encoding(spark, tmp_path, sep, name):
    rows = [["Item ID", "Qty (pcs)", "Näme"], ["A1", " 5 ", "Öl"], ["", "7"], ["", " ", ""], ["A3", "1", "e", "more"]]
    for encoding in ("utf-8", "latin-1", "utf-8-sig"):
        folder = tmp_path / encoding
        folder.mkdir()
        (folder / name).write_bytes("\n".join(sep.join(r) for r in rows).encode(encoding) + b"\n\n")
        feed = files.read_feed(spark, str(folder / name))
        assert feed.columns == ["Item ID", "Qty (pcs)", "Näme"]
        assert sorted(map(tuple, feed.collect())) == [("", "7", ""), ("A1", "5", "Öl"), ("A3", "1", "e")]
        assert files.renamed(feed).columns == ["item_id", "qty_pcs", "n_me"]


def test_quotes_are_characters_in_tsv_and_quote_in_csv(spark, tmp_path):
    (tmp_path / "a.tsv").write_text('item\tsize\n"x\t5"\n"y"\t"\n')
    assert sorted(map(tuple, files.read_feed(spark, str(tmp_path / "a.tsv")).collect())) == [('"x', '5"'), ('"y"', '"')]
    (tmp_path / "a.csv").write_text('"item","si,ze"\n"x, ""y""",5\n"two\nlines",6\n')
    feed = files.read_feed(spark, str(tmp_path / "a.csv"), multi_line=True)
    assert feed.columns == ["item", "si,ze"] and sorted(map(tuple, feed.collect())) == [("two\nlines", "6"), ('x, "y"', "5")]


@pytest.mark.parametrize(("text", "says"), [("item,Item\n1,2\n", "twice"), ("item,,qty\n1,2,3\n", "empty column at 1"), ("\n \n", "empty")])
def test_headers_that_raise(spark, tmp_path, text, says):
    (tmp_path / "feed.csv").write_text(text)
    with pytest.raises(ValueError, match=says):
        files.read_feed(spark, str(tmp_path / "feed.csv"))


def test_json_feeds_staging_and_payloads(spark, tmp_path):
    text = '[{"item": " a ", "qty": 5, "price": 10000000.0, "rate": 1.50, "due": "1998-02-28", "tags": ["x"], "open": true},\n {"item": "b", "qty": "many", "due": "1998-02-31", "extra": null}]'
    (tmp_path / "a.json").write_text(text)
    (tmp_path / "b.jsonl").write_text("\n".join(json.dumps(x) for x in json.loads(text)).replace("10000000.0", "10000000.0").replace("1.5,", "1.50,"))
    for name in ("a.json", "b.jsonl"):
        feed = files.read_feed(spark, str(tmp_path / name))
        first = feed.where("item = 'a'").first()
        assert (first.price, first.rate, first.open, first.tags) == ("10000000.0", "1.50", "true", '["x"]')
        staged = files.stage(feed, "batch-1")
        got = files.payload(staged, {"item": "string", "qty": "int", "due": "date", "absent": "double"}).orderBy("row_id").collect()
        assert [(r.row_id, r.item, r.qty, str(r.due), r.absent, r.errors) for r in got] == [(1, "a", 5, "1998-02-28", None, []), (2, "b", None, "None", None, ["qty", "due"])]


def test_rows_are_numbered_over_all_files(spark, tmp_path):
    for k in range(3):
        (tmp_path / f"part-{k}.csv").write_text("k,v\n" + "".join(f"{k},{i}\n" for i in range(4 + k)))
    staged = files.stage(files.read_feed(spark, str(tmp_path / "*.csv")), "b")
    rows = sorted((r.row_id, int(r.content["k"]), int(r.content["v"])) for r in staged.collect())
    assert [n for n, *_ in rows] == list(range(1, 16)) and all(a[2] < b[2] for a, b in zip(rows, rows[1:]) if a[1] == b[1])
    known = {r.path.rpartition("/")[2]: (r.length, r.sha256) for r in files.digests(spark, str(tmp_path)).collect()}
    data = (tmp_path / "part-1.csv").read_bytes()
    assert known["part-1.csv"] == (len(data), hashlib.sha256(data).hexdigest())


def test_sniffing():
    assert files.separator_of([]) == "," and files.separator_of(["one"]) == ","
    assert files.separator_of(["a;b,c;d", "1;2;3"]) == ";"
    assert files.format_of("feed", ["  [{"]) == "json" and files.format_of("feed.tsv", ["[1]\t2"]) == "tsv"
    assert files.format_of("dir.x/feed", ["PK\x03\x04..."]) == "xlsx" and files.format_of("feed", ["a\tb"]) == "tsv"


def test_the_sink_and_back(spark, tmp_path):
    rows = spark.createDataFrame([(1, 'a "quoted" word'), (2, None)], "id int, note string")
    files.write_tsv(rows, str(tmp_path / "out.tsv"))
    assert sorted(map(tuple, files.read_feed(spark, str(tmp_path / "out.tsv")).collect())) == [("1", 'a "quoted" word'), ("2", "")]
    with pytest.raises(Exception, match="tab or line end in column note"):
        files.write_tsv(rows.withColumn("note", F.lit("a\tb")), str(tmp_path / "bad.tsv"))


def test_streams_go_on_where_they_stopped(spark, tmp_path):
    rows = lambda days: spark.createDataFrame([(f"2024-01-0{d}", "e", float(d)) for d in days], "ts string, event_type string, value double").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    rows([1, 1, 2]).write.parquet(str(tmp_path / "in"))
    read = lambda: events.window_totals(spark.readStream.schema(rows([1]).schema).parquet(str(tmp_path / "in")))
    first = events.drained(spark, read(), str(tmp_path / "state")).collect()
    assert sorted((str(r.start)[:10], r.n) for r in first) == [("2024-01-01", 2), ("2024-01-02", 1)]
    rows([2, 3]).write.mode("append").parquet(str(tmp_path / "in"))
    again = events.drained(spark, read(), str(tmp_path / "state")).collect()
    assert sorted((str(r.start)[:10], r.n) for r in again) == [("2024-01-01", 2), ("2024-01-02", 2), ("2024-01-03", 1)]


def test_a_plan_kept_by_a_stream_equals_the_plan_made_anew(spark, tmp_path):
    schema = "item_id long, location_id long, kind string, bucket int, qty double"
    lines = [(i, i % 2, k, b, float(i + b + 1)) for i in range(30) for k, b in (("supply", -1), ("order", i % 4), ("supply", 2))]
    added = [(3, 1, "order", 1, 50.0), (4, 0, "supply", 0, 7.0), (99, 1, "order", 0, 1.0)]
    moves = lambda: spark.read.schema(schema).parquet(str(tmp_path / "moves"))
    put = lambda x: spark.createDataFrame(x, schema).write.mode("append").parquet(str(tmp_path / "moves"))
    run = lambda: events.replanned(spark, spark.readStream.schema(schema).parquet(str(tmp_path / "moves")), moves(), str(tmp_path / "plan"), str(tmp_path / "state"), 4, parts=8)
    put(lines)
    assert sorted(run().collect()) == sorted(stock.project(stock.bucket_flows(moves(), 4)).collect())
    stamps = {p: p.stat().st_mtime_ns for p in (tmp_path / "plan").rglob("*.parquet")}
    put(added)
    got = run().collect()
    assert sorted(got) == sorted(stock.project(stock.bucket_flows(moves(), 4)).collect()) and len(got) == 31 * 4
    kept = [p for p, t in stamps.items() if p.exists() and p.stat().st_mtime_ns == t]
    assert kept and len({p.parent for p in kept}) < len({p.parent for p in stamps})
