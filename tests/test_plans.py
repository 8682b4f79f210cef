import datetime as dt
import json

import duckdb
import pytest
from pyspark.sql import functions as F

from noticeloom import schemas
from noticeloom.functions.places import Gazetteer
from noticeloom.operators import linking
from noticeloom.plans import catalogue, check, job, records
from noticeloom.plans.state import State
from noticeloom.sources.sinks import MemorySink
from noticeloom.streaming import monitor


assert records.QUERIES is catalogue.QUERIES


@pytest.mark.parametrize("name", [n for n in catalogue.QUERIES if n in catalogue.ORACLE_SQL])
def test_query_equals_sql(spark, sf, name):
    import glob
    import os

    db = duckdb.connect()
    for p in glob.glob(f"{sf}/*.parquet"):
        db.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p}')")
    df = catalogue.QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    out = db.sql(catalogue.ORACLE_SQL[name])
    assert sorted(out.columns) == columns
    order = [out.columns.index(c) for c in columns]
    plain = lambda v: round(v, 6) if isinstance(v, float) else v
    left = sorted(repr([plain(v) for v in r]) for r in df.select(*columns).collect())
    assert left == sorted(repr([plain(r[i]) for i in order]) for r in out.fetchall())


def compared(spark, folder, name, **tables):
    """The rows of a query and of its SQL over these tables, sorted."""
    db = duckdb.connect()
    for table, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/{table}.parquet")
        db.sql(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{folder}/{table}.parquet/*.parquet')")
    out = db.sql(catalogue.ORACLE_SQL[name])
    rows = catalogue.QUERIES[name](spark, str(folder)).select(*out.columns).collect()
    return sorted(repr(list(r)) for r in rows), sorted(repr(list(r)) for r in out.fetchall())


def test_readings_of_one_address_and_unfinished_entities(spark, tmp_path):
    """Rows of one address with one title and day are listings of their own; what a parser would complete in a title stays."""
    titles = {1: "Uno &amp; due", 29: "Uno &amp; due", 3: "cut &amp;&amp;&amp", 4: "cut &am", 5: "cut &quot; &amp;quot; &lt"}
    pages = spark.createDataFrame([(k, "https://x.example.org/p", f"<html><title>{t}</title></html>") for k, t in titles.items()], "page_id long, url string, html string")
    left, right = compared(spark, tmp_path, "q_html_source", pages=pages)
    assert left == right and len(left) == 10


def test_whole_texts_are_classified(spark, tmp_path):
    """What a conversation says decides, wherever it says it; a null text says nothing."""
    far = "parola " * 3000
    texts = {
        "La nomina è REVOCATA": ("annullamento", "docente"), far + "errata\ncorrige, personale A.T.A. e ata": ("rettifica", "ata-dsga"), "Nuova integrazione": ("rettifica", "docente"),
        far + "nuova integrazione": ("interpello", "docente"), "Proroga; d.s.g.a.": ("riapertura", "ata-dsga"), "l'èsito": ("esito", "docente"), "preesito, esperto": ("interpello", "altro"),
        None: ("interpello", "docente"), "": ("interpello", "docente"), far + "figure di sistema, individuato ieri": ("esito", "altro"),
    }
    rows = [(i // 3, i % 3, "user", text) for i, text in enumerate(texts)]
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    df = catalogue.QUERIES["q_classify"](spark, str(tmp_path))
    got = {(r["conv_id"], r["turn"]): (r["type"], r["staff"]) for r in df.collect()}
    assert [got[r[:2]] for r in rows] == list(texts.values())
    db = duckdb.connect()
    db.sql(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{tmp_path}/conversations.parquet/*.parquet')")
    out = db.sql(catalogue.ORACLE_SQL["q_classify"])
    assert sorted(map(tuple, df.select(*out.columns).collect())) == sorted(out.fetchall())


@pytest.mark.parametrize("name", [n for n in catalogue.QUERIES if n not in catalogue.ORACLE_SQL])
def test_query_runs(spark, sf, name):
    assert catalogue.QUERIES[name](spark, sf).count() > 0


def test_hot_operators_have_no_nested_loops(spark, sf):
    for name in ("q_digest", "q_match", "q_relation", "q_range_selfjoin"):
        plan = catalogue.QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastNestedLoopJoin" not in plan and "CartesianProduct" not in plan, name


LETTER = "ISTITUTO ROSSI\nVia Roma 75015 Pisticci\nProt. n. 12 del 02/09/2026\nOGGETTO: Interpello supplenza A022\n" + "testo " * 60


def test_notices_link_and_message(spark):
    towns = spark.createDataFrame([("Pisticci", "Pisticci", "Matera", "MT"), ("Bari", "Bari", "Bari", "BA")], "names string, italian string, province_name string, province string")
    now = dt.datetime(2026, 9, 3, 8)
    pubs = spark.createDataFrame([(1, "Interpello A022 Pisticci", now, [("https://x/a.pdf", "Interpello")]), (2, "Interpello A022 Pisticci (MT)", now, [("https://y/b.pdf", "copia")]), (3, "Interpello A011 Liceo, Bari", now, [])],
                                 "publication long, heading string, published timestamp, documents array<struct<url:string,label:string>>")
    docs = spark.createDataFrame([(1, "https://x/a.pdf", 0, "h1", LETTER, None, None, None), (2, "https://y/b.pdf", 0, "h1", LETTER, None, None, None)],
                                 "publication long, url string, place int, hash string, text string, region string, following string, error string")
    extracted = job.notices_of(pubs, docs, Gazetteer(towns)).withColumn("rank", F.col("publication").cast("string")).withColumn("own", F.col("publication")).withColumn("dates", F.array("published"))
    none = extracted.limit(0).select(F.col("own").alias("id"), F.col("rank").alias("order"), *linking.RECORD, "dates")
    bridge = linking.linked(extracted, none, spark.createDataFrame([], "publication long, id long"))
    notices = bridge.where("made").select("rank", "id").join(extracted, "rank")
    got = {r["id"]: r for r in notices.collect()}
    assert set(got) == {1, 3} and got[1]["classes"] == ["A022"] and got[1]["document"] == "h1" and got[3]["province"] == "BA"
    assert sorted((r["publication"], r["id"]) for r in bridge.collect()) == [(1, 1), (2, 1), (3, 3)]
    people = spark.createDataFrame([(1, "a@x.it", True, ["A022"], ["MT"], now, False), (2, "bad@x.it", True, ["A011"], ["BA"], now, True), (3, "c@x.it", False, ["A011"], ["BA"], now, False)],
                                   "recipient long, email string, active boolean, classes array<string>, provinces array<string>, created timestamp, split boolean")
    notices = notices.withColumn("created", F.lit(now)).withColumn("updated", F.lit(now))
    first = bridge.join(pubs.select("publication", "published"), "publication").groupBy("id").agg(F.min("published").alias("published"))
    names = spark.createDataFrame([("A022", "Italiano")], "class string, name string")
    alerts = F.array().cast("array<struct<kind:string,text:string>>")
    messages, _ = job.daily_messages(notices, first, people, schemas.empty(spark, "ledger"), schemas.empty(spark, "digest"), names, alerts, F.array(F.lit("X")), now)
    rows = {r["recipient"]: r for r in messages.collect()}
    assert rows[1]["subject"] == "Interpelli: 1 nuovo (A022) · 3 set 2026" and "A022 · Italiano" in rows[1]["text"] and rows[2]["variant"] == "BA" and set(rows) == {1, 2}
    assert rows[1]["html"].startswith("<!doctype html>")
    said = []
    accepted, failed = job.send(messages, MemorySink(("bad@x.it",)), said.append)
    assert accepted == [(1, None)] and failed == 1 and "bad@x.it" not in said[0]
    ledger = spark.createDataFrame([(1, 1, 1)], "recipient long, id long, digest long")
    again, _ = job.daily_messages(notices, first, people, ledger, schemas.empty(spark, "digest"), names, alerts, F.array(F.lit("X")), now)
    assert {r["recipient"] for r in again.collect()} == {2}


def test_job_command(spark, tmp_path):
    now = dt.datetime(2026, 9, 3, 8)
    pubs = spark.createDataFrame([(1, "s", "k", "u", "Interpello A022 Pisticci", now, [("https://x/a.pdf", "l")], now, now)], schemas.TABLES["publication"])
    pubs.write.parquet(str(tmp_path / "publication"))
    for n in ("document", "publication_document"):
        schemas.empty(spark, n).write.parquet(str(tmp_path / n))
    (tmp_path / "towns.csv").write_text("\n".join([";".join(f"c{i}" for i in range(15)), ";".join(["", "", "", "", "", "Pisticci", "Pisticci", "", "", "", "", "Matera", "", "", "MT"])]))
    assert job.main(["--state", str(tmp_path), "--towns", str(tmp_path / "towns.csv"), "--reread"]) == 0
    assert State(spark, str(tmp_path)).read("notice").first()["town"] == "Pisticci"
    assert job.main(["--state", str(tmp_path / "missing"), "--towns", "x", "--reread"]) == 1
    with pytest.raises(SystemExit) as e:
        job.main(["--state", "x", "--towns", "y", "--reread", "--out", "z"])
    assert e.value.code == 2


def test_job_command_expands_groups(spark, tmp_path):
    now = dt.datetime.now(dt.UTC).replace(tzinfo=None)
    spark.createDataFrame([(1, "s", "k", "u", "Interpello A022 Pisticci", now, [("https://x/a.pdf", "l")], now, now)], schemas.TABLES["publication"]).write.parquet(str(tmp_path / "publication"))
    spark.createDataFrame([(1, "a@x.it", True, now, None, False)], schemas.TABLES["recipient"]).write.parquet(str(tmp_path / "recipient"))
    spark.createDataFrame([(1, "gruppo", "Lettere"), (1, "provincia", "MT")], schemas.TABLES["preference"]).write.parquet(str(tmp_path / "preference"))
    for n in ("document", "publication_document", "ledger", "digest"):
        schemas.empty(spark, n).write.parquet(str(tmp_path / n))
    (tmp_path / "towns.csv").write_text("\n".join([";".join(f"c{i}" for i in range(15)), ";".join(["", "", "", "", "", "Pisticci", "Pisticci", "", "", "", "", "Matera", "", "", "MT"])]))
    (tmp_path / "groups.json").write_text(json.dumps({"Lettere": ["A022", "A012"], "Vuoto": []}))
    command = ["--state", str(tmp_path), "--towns", str(tmp_path / "towns.csv"), "--out", str(tmp_path / "out")]
    assert job.main(command) == 1
    assert job.main([*command, "--groups", str(tmp_path / "groups.json")]) == 0
    assert any("A022" in f.read_text(errors="replace") for f in (tmp_path / "out").rglob("*") if f.is_file())


def test_a_day_and_the_same_day_again(spark, tmp_path, capsys):
    """Two sources and a broken one are read, notices linked, sources watched, messages delivered and recorded; run again, nothing is sent twice."""
    now, api, page = dt.datetime(2026, 9, 24, 10), "https://usp.example.it/posts", "https://ufficio.example.it/decreti"
    post = lambda i, title, content: {"id": i, "date_gmt": "2026-09-24T08:00:00", "link": f"https://usp.example.it/{i}", "title": {"rendered": title}, "content": {"rendered": content}}
    listed = [post(1, "Interpello A022 Liceo Fermi, Pisticci (MT)", '<a href="https://usp.example.it/a.pdf">Avviso</a>'), post(2, "Interpello A011 prot. 5 Liceo, Pisticci", "")]
    html = '<div class="USP-postcontent"><h2>Interpello A022 Liceo Fermi, Pisticci</h2><p>23 Settembre 2026 ore 9:00</p><p><a href="/b.pdf">Decreto</a></p></div>'
    from noticeloom.sources.posts import listing_url

    answers = [{"url": listing_url(api, 1, after, "interpello"), "stato": 200, "intestazioni": {"Content-Type": "application/json"}, "corpo": json.dumps(listed)} for after in ("2026-08-25T10:00:00", "2026-09-17T08:00:00")]
    answers += [{"url": page, "stato": 200, "intestazioni": {"Content-Type": "text/html; charset=utf-8"}, "corpo": html}, {"url": "https://usp.example.it/a.pdf", "stato": 200, "intestazioni": {}, "corpo": "%PDF-1.4 broken"}]
    (tmp_path / "r.json").write_text(json.dumps(answers))
    sources = [{"id": "usp", "nome": "USP", "adapter": "wordpress", "impostazioni": {"api": api, "cerca": "interpello"}}, {"id": "ufficio", "nome": "Ufficio", "adapter": "pagina-decreti", "impostazioni": {"pagina": page}}]
    sources.append({"id": "rotta", "nome": "Rotta", "adapter": "pagina-decreti", "impostazioni": {"pagina": "https://rotta.example.it/x"}})
    (tmp_path / "s.json").write_text(json.dumps(sources))
    (tmp_path / "towns.csv").write_text("\n".join([";".join(f"c{i}" for i in range(15)), ";".join(["", "", "", "", "", "Pisticci", "Pisticci", "", "", "", "", "Matera", "", "", "MT"])]))
    assert check.main(["--sources", str(tmp_path / "s.json"), "--replay", str(tmp_path / "r.json")], now) == 1
    assert "usp: 2 items, 2 with classes, last 2026-09-24" in capsys.readouterr().out
    first, out = tmp_path / "one", tmp_path / "out"
    spark.createDataFrame([(1, "a@x.it", True, now, None, False), (2, "b@x.it", True, now, None, False)], schemas.TABLES["recipient"]).write.parquet(str(first / "recipient"))
    spark.createDataFrame([(1, "classe", "A022"), (1, "provincia", "MT"), (2, "classe", "A099"), (2, "provincia", "MT")], schemas.TABLES["preference"]).write.parquet(str(first / "preference"))
    schemas.empty(spark, "publication").write.parquet(str(first / "publication"))
    command = lambda state: ["--state", str(state), "--towns", str(tmp_path / "towns.csv"), "--sources", str(tmp_path / "s.json"), "--replay", str(tmp_path / "r.json"), "--deliver", str(out)]
    assert job.main(command(first), now) == 0
    said = capsys.readouterr().out
    assert "usp: 2 read, 2 new, 0 updated" in said and "ufficio: 1 read, 1 new, 0 updated" in said and "rotta: " in said and "0 read" not in said
    state = lambda n: State(spark, str(first)).read(n)
    assert state("publication").count() == 3 and {r["source"]: r["problem"] for r in state("source_state").collect()} == {"usp": None, "ufficio": None, "rotta": "errore"}
    assert state("publication_document").count() == 2 and state("document").where("error is not null").count() == 1
    text = (out / "a@x.it.txt").read_text()
    assert "Pagina (USP): https://usp.example.it/1" in text and "Documento: https://usp.example.it/a.pdf" in text and "potrebbe essere lo stesso di: Ufficio" in text and "Rotta non consultabile" in text
    assert "Oggi nessun interpello" in (out / "b@x.it.txt").read_text()
    assert state("digest").count() == 1 and state("ledger").count() == 2 and state("alert").count() == 1
    assert schemas.violations({n: state(n) for n in schemas.TABLES}).count() == 0
    before = State(spark, str(first))
    for f in out.glob("*.*"):
        f.unlink()
    assert job.main(command(first), now) == 0
    assert not list(out.glob("*.*")) and "usp: 2 read, 0 new, 0 updated" in capsys.readouterr().out
    assert state("ledger").count() == 2 and state("digest").count() == 1 and state("alert").count() == 1
    # nothing is extracted twice, and who reads the snapshot of before still does
    assert state("notice").where(F.col("updated") > F.lit(now)).isEmpty() and State(spark, str(first)).number == before.number + 2 and before.read("notice").count() == state("notice").count()


def test_archives_give_way_to_their_parts(spark):
    now = dt.datetime(2026, 9, 3, 8)
    attached = spark.createDataFrame([(1, "u/z.zip", 0, "z", None, now), (1, "u/b", 1, "b", None, now), (1, "u/c", 2, None, "404", now), (2, "u/y.zip", 0, "y", None, now)], schemas.TABLES["publication_document"])
    parts = spark.createDataFrame([("z", 0, "one.pdf", "p"), ("z", 1, "two.pdf", "q"), ("y", 0, "lost.pdf", "gone")], schemas.TABLES["document_part"])
    stored = spark.createDataFrame([(h,) for h in "zbypq"], "hash string")
    got = sorted(tuple(r) for r in job.with_parts(attached, parts, stored).select("publication", "place", "url", "hash").collect())
    assert got == [(1, 0, "u/z.zip#one.pdf", "p"), (1, 1, "u/z.zip#two.pdf", "q"), (1, 2, "u/b", "b"), (1, 3, "u/c", None), (2, 0, "u/y.zip", "y")]


def test_streams(spark, tmp_path):
    source = tmp_path / "in"
    for rows in ([("a", 1, "x", "2026-09-01 08:00:00")], [("a", 1, "y", "2026-09-01 08:00:00"), ("b", 2, None, "2026-09-02 08:00:00")]):
        spark.createDataFrame([(s, k, p, dt.datetime.fromisoformat(t)) for s, k, p, t in rows], "source string, key int, problem string, at timestamp").coalesce(1).write.mode("append").parquet(str(source))
        stream = spark.readStream.schema("source string, key int, problem string, at timestamp").parquet(str(source))
        q = monitor.upsert_each_batch(stream, str(tmp_path / "out"), ["key"], ["at"], str(tmp_path / "cp"))
        q.awaitTermination()
    got = {r["key"]: r["problem"] for r in monitor.upserted_table(spark, str(tmp_path / "out"), ["key"]).collect()}
    assert got == {1: "y", 2: None}
    stream = spark.readStream.schema("source string, key int, problem string, at timestamp").parquet(str(source))
    q = monitor.transitions(stream).writeStream.format("memory").queryName("moves").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp2")).start()
    q.awaitTermination()
    assert {r["transition"] for r in spark.table("moves").collect()} <= {"new", "changed", "recovered"} and spark.table("moves").count() >= 1
    counted = monitor.counts_by_window(spark.readStream.schema("source string, key int, problem string, at timestamp").parquet(str(source)).withColumnRenamed("at", "published"))
    q = counted.writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp3")).start()
    q.awaitTermination()
    assert spark.table("counts").agg(F.sum("n")).first()[0] == 3


def test_entry_contract():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and callable(e.entry)
    json.dumps(e.oracle_sql())
