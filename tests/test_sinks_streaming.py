import os
import csv
import datetime as dt
import glob
import json

import pytest
from pyspark.sql import functions as F

from sitegrid.functions.html import register_sql
from sitegrid.operators import audit as D
from sitegrid.operators import links as L
from sitegrid.sources import sinks
from sitegrid.sources.pages import links_of
from sitegrid.sources import logs as SL
from sitegrid.streaming import jobs

from . import sites


def rows_of(folder):
    return [r for f in sorted(glob.glob(f"{folder}/**/*.csv", recursive=True)) for r in csv.reader(open(f, newline=""))]


def test_exports(spark, tmp_path):
    p = L.with_inbound(sites.broken(spark), links_of(sites.broken(spark))).cache()
    findings, urls = D.run_audit(D.AuditInput(p), near_duplicates=False)
    findings, urls = findings.cache(), urls.cache()
    sinks.write_findings_csv(findings, urls, str(tmp_path / "f"))
    rows = rows_of(tmp_path / "f")
    assert rows[0] == ["Severity", "Phase", "Owner", "Effort", "Title", "Where", "What", "Why", "Fix", "Affected URLs"]
    assert any(" | " in r[-1] for r in rows[1:])
    sinks.write_crawl_csv(p, str(tmp_path / "c"))
    crawl = rows_of(tmp_path / "c")
    assert len(crawl[0]) == 18 and len([r for r in crawl if r[0].startswith("http")]) == 8
    sinks.write_workitem_csv(findings, urls, str(tmp_path / "w"), "Area", "It")
    assert any("<b>Fix:</b>" in r[2] and r[5] == "Area" for r in rows_of(tmp_path / "w"))
    sinks.write_link_graph_csv(L.link_graph_report(sites.broken(spark), links_of(p)), str(tmp_path / "g"))
    assert rows_of(tmp_path / "g")[0][0] == "URL"
    sinks.write_audit_json(D.site_stats(p), findings, p, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j/pages")).count() == 8
    sinks.write_sitemaps(sites.good(spark), str(tmp_path / "s"), per_file=2)
    files = glob.glob(f"{tmp_path}/s/**/*.txt", recursive=True)
    texts = [open(f).read() for f in files]
    assert sum(t.count("<loc>") for t in texts) == 3 and len(files) == 2 and all(t.startswith("<?xml") for t in texts)


def test_redirect_formats(spark, tmp_path):
    m = spark.createDataFrame([("https://o.com/old/a/", "https://n.com/a", "high", 90, "ship"), ("https://o.com/x", "", "none", 0, "choose")],
                              "from_url string, to_url string, confidence string, score int, action string")
    lines = {f: [r.value for r in sinks.redirect_rules(m, f).collect()] for f in ("htaccess", "nginx", "plugin", "json", "csv")}
    assert lines["htaccess"] == ["RewriteRule ^old/a/?$ https://n.com/a [R=301,L]"]
    assert lines["nginx"] == ["rewrite ^/old/a//?$ https://n.com/a permanent;"] and len(lines["csv"]) == 2
    assert lines["json"] == ['{"source":"/old/a/","target":"https://n.com/a","code":301}']
    sinks.write_redirect_rules(m, str(tmp_path / "r"), "plugin")
    assert spark.read.text(str(tmp_path / "r")).count() == 1


def test_snapshots(spark, tmp_path):
    p = sites.good(spark).select("run_id", "site", "url", "title")
    sinks.save_snapshot({"pages": p}, str(tmp_path), "first run!")
    sinks.save_snapshot({"pages": p.limit(1)}, str(tmp_path), "second")
    assert [(r.snapshot, r.rows) for r in sinks.list_snapshots(spark, str(tmp_path)).collect()] == [("second", 1), ("first-run-", 3)]
    assert sinks.load_snapshot(spark, str(tmp_path), "pages", "second").count() == 1
    assert sinks.load_snapshot(spark, str(tmp_path), "pages", "first run!").count() == 3


def test_snapshots_are_published_last(spark, tmp_path):
    root = str(tmp_path)
    p = sites.good(spark).select("run_id", "site", "url", "title")
    assert sinks.list_snapshots(spark, root).collect() == []
    fails = p.withColumn("title", F.raise_error(F.lit("killed")).cast("string"))
    for _ in range(2):  # the second table fails: the first one, written whole, stays invisible
        with pytest.raises(Exception, match="killed"):
            sinks.save_snapshot({"pages": p, "more": fails}, root, "a")
        assert sinks.list_snapshots(spark, root).collect() == []
    with pytest.raises(LookupError):
        sinks.load_snapshot(spark, root, "pages", "a")
    sinks.save_snapshot({"pages": p.limit(2), "more": p.limit(0)}, root, "a")  # overwrites what was left
    assert sinks.load_snapshot(spark, root, "pages", "a").count() == 2 and sinks.load_snapshot(spark, root, "more", "a").count() == 0
    with pytest.raises(Exception, match="killed"):
        sinks.save_snapshot({"pages": p, "more": fails}, root, "a")
    assert [(r.snapshot, r.rows) for r in sinks.list_snapshots(spark, root).collect()] == [("a", 2)]
    sinks.save_snapshot({"pages": p}, root, "a")
    assert sinks.load_snapshot(spark, root, "pages", "a").columns == p.columns
    assert [(r.snapshot, r.rows) for r in sinks.list_snapshots(spark, root).collect()] == [("a", 3)]
    with pytest.raises(ValueError):
        sinks.save_snapshot({"manifest": p}, root, "a")


def test_html_extract_in_sql(spark):
    register_sql(spark)
    r = spark.sql("SELECT html_extract('<title>T</title><h1>H</h1>', 'https://e.com/') AS m").select("m.title", "m.headings").first()
    assert r.title == "T" and r.headings[0].text == "H"


def log(hour, minute, status=200, ip="66.249.1.1"):
    return f'{ip} - - [01/Jan/2026:{hour:02}:{minute:02}:00 +0000] "GET /a HTTP/1.1" {status} 5 "-" "Googlebot/2.1"'


def test_stream_waste_drops_late_rows(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    batches = [[log(1, 5), log(1, 10, 404), "broken"], [log(9, 0)], [log(9, 10)], [log(1, 20), log(9, 30)], [log(20, 0)]]
    for i, b in enumerate(batches):
        (src / f"{i}.log").write_text("\n".join(b))
        os.utime(src / f"{i}.log", (1000 + i, 1000 + i))  # files are read in order of their time
    lines = jobs.stream_log_lines(spark, str(src), files_per_batch=1)
    q = (jobs.stream_crawl_waste(lines, "1 hour", watermark="1 hour").writeStream.outputMode("append").format("memory")
         .queryName("waste").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start())
    q.awaitTermination(300)
    got = {r.window_start.hour: (r.hits, r.errors) for r in spark.sql("select * from waste").collect()}
    assert got[1] == (2, 1) and got[9] == (3, 0)          # the late 01:20 row is dropped


def test_stream_of_files_equals_the_batch(spark, tmp_path):
    """Files of all formats, an IIS one whose header changes and one that goes on in a
    later micro-batch without a header; late rows are counted."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")

    def w3c(hour, minute, swap, status=200):
        parts = [f"/p{minute}", f"2026-01-01 {hour:02}:{minute:02}:00", str(status), "66.249.1.1", "Googlebot/2.1"]
        return " ".join(parts[::-1] if swap else parts)

    a, b = "#Fields: cs-uri-stem date time sc-status c-ip cs(User-Agent)", "#Fields: cs(User-Agent) c-ip sc-status date time cs-uri-stem"
    one = [("iis", 0, [w3c(1, 1, False), a, w3c(1, 2, False), w3c(1, 3, False, 404), b, w3c(1, 4, True)]), ("plain", 0, ["rubbish", log(1, 5), log(1, 6, 404)]),
           ("vhost", 0, ["www.e.com " + log(1, 7)]), ("json", 0, ['{"url":"/j","ip":"66.249.1.1","time":"2026-01-01 01:08:00","status":500,"ua":"Googlebot/2.1"}', "torn"])]
    two = [("iis", 64, [w3c(1, 9, True, 301), a, w3c(9, 10, False)])]
    three = [("plain", 64, [log(12, 0)])]
    four = [("iis", 128, [w3c(1, 11, False), w3c(12, 12, False, 404)])]
    five = [("plain", 128, [log(20, 0)])]
    src, out = tmp_path / "in", str(tmp_path / "hits")
    src.mkdir()
    everything = []
    for i, batch in enumerate([one, two, three, four, five]):
        rows = [{"file": f, "at_block": k, "line": x} for f, k, lines in batch for x in lines]
        everything += [(r["file"], r["at_block"], n, r["line"]) for n, r in enumerate(rows)]
        (src / f"{i}.json").write_text("\n".join(json.dumps(r) for r in rows))
        os.utime(src / f"{i}.json", (1000 + i, 1000 + i))
    lines = spark.readStream.schema("file string, at_block long, line string").option("maxFilesPerTrigger", 1).json(str(src))
    q = (jobs.stream_hits(lines).writeStream.outputMode("append").format("parquet").option("path", out)
         .option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start())
    q.awaitTermination(300)
    table = spark.createDataFrame(everything, "file string, at_block long, i long, line string")
    batch = SL.hits_of(SL.parse_log_lines(table, SL.detect_log_format(table)))
    columns = ["file", "url", "status", "at", "ip", "ua"]

    def rows_of(df):
        return sorted(map(str, df.select(*columns).collect()))

    got = spark.read.parquet(out)
    assert rows_of(got) == rows_of(batch) and got.count() == 13
    hits = spark.readStream.schema(got.schema).option("maxFilesPerTrigger", 1).parquet(out)
    q = (jobs.windowed_waste(hits, "1 hour", watermark="1 hour").writeStream.outputMode("append").format("memory").queryName("filewaste")
         .option("checkpointLocation", str(tmp_path / "cp2")).trigger(availableNow=True).start())
    q.awaitTermination(300)
    seen = {r.window_start.hour: r.hits for r in spark.sql("select * from filewaste").collect()}
    # of the ten hits of that hour, two come after a hit at noon: one window and bot
    assert seen[1] == 8 and seen[9] == 1 and jobs.late_rows(q) == 1


def test_stream_run_alerts(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    src, cp = tmp_path / "in", tmp_path / "cp"
    src.mkdir()

    def put(name, rows):
        spark.createDataFrame([(s, r, dt.datetime(2026, 1, int(r)), rule, sev, 1) for s, r, rule, sev in rows],
                              jobs.RUN_SCHEMA).coalesce(1).write.json(str(tmp_path / name))
        for i, f in enumerate(glob.glob(f"{tmp_path}/{name}/*.json")):
            open(src / f"{name}{i}.json", "w").write(open(f).read())

    def run():
        out = []
        runs = spark.readStream.schema(jobs.RUN_SCHEMA).json(str(src))
        q = (jobs.stream_run_alerts(runs).writeStream.outputMode("append").foreachBatch(lambda df, _: out.extend(df.collect()))
             .option("checkpointLocation", str(cp)).trigger(availableNow=True).start())
        q.awaitTermination(300)
        return {(r.site, r.run_id, r.change, r.rule) for r in out}

    put("a", [("s", "1", "x", "High"), ("s", "1", "y", "Low")])
    assert run() == set()                                  # the first run is the baseline
    put("b", [("s", "2", "x", "Critical"), ("s", "2", "y", "Low"), ("s", "2", "z", "High"), ("s", "2", "w", "Low")])
    assert run() == {("s", "2", "worsened", "x"), ("s", "2", "appeared", "z")}
    put("c", [("s", "3", "x", "Critical")])
    assert run() == set()                                  # known state stays silent after a restart
