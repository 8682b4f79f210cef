import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from noticeloom.sources import archives, configuration, listing, posts
from noticeloom.sources.http import Answer, HttpError, PacedClient, TemporaryHttpError
from noticeloom.sources.sinks import FileSink, MemorySink, MessageSink, file_name


def test_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_text('a;b\r\n1;"x;""y""\nz"\r\n\r\n2;w', encoding="utf-8")
    rows = configuration.read_csv(spark, str(tmp_path / "a.csv")).collect()
    assert [tuple(r) for r in rows] == [("1", 'x;"y"\nz'), ("2", "w")]


def test_configuration(spark, tmp_path):
    (tmp_path / "c.json").write_text('{"A011": "Lettere", "A022": "Italiano"}')
    (tmp_path / "g.json").write_text('{"all": ["A011", "A099"], "none": []}')
    classes, groups = configuration.class_names(spark, str(tmp_path / "c.json")), configuration.group_members(spark, str(tmp_path / "g.json"))
    assert classes.count() == 2
    assert {r[0] for r in configuration.configuration_problems(groups, classes).collect()} == {"empty group: none", "unknown class in all: A099"}
    (tmp_path / "s.json").write_text(json.dumps([{"id": "ok", "nome": "A", "adapter": "wordpress", "impostazioni": {"api": "https://x/y", "cerca": "q"}}, {"id": "ok", "nome": " ", "adapter": "x", "impostazioni": {}}, {"id": "p", "nome": "P", "adapter": "pagina-decreti", "impostazioni": {"pagina": "ftp://x"}}]))
    found = [(r["id"], r["problem"]) for r in configuration.source_problems(configuration.source_catalog(spark, str(tmp_path / "s.json"))).collect()]
    assert sorted(found) == sorted([("ok", "no name"), ("ok", "unknown adapter"), ("ok", "id used twice"), ("p", '"pagina" must be a web address')])


def test_posts(spark):
    post = {"id": 7, "date_gmt": "2026-09-24T08:00:00", "link": "https://x/7", "title": {"rendered": "A &amp; B"}, "content": {"rendered": '<a href="https://x/d.pdf">Uno</a> <a href="/rel">no</a> <a class="q" href="https://x/d.pdf">Due</a>'}}
    bodies = spark.createDataFrame([(json.dumps([post]),), ("[]",), ('{"code": "x"}',)], "body string")
    parsed = posts.posts_of(bodies)
    assert parsed.where("corrupt is not null").count() == 1
    row = posts.publications(parsed).collect()
    assert len(row) == 1 and row[0]["key"] == "7" and row[0]["heading"] == "A & B" and str(row[0]["published"]) == "2026-09-24 08:00:00"
    assert [(d["url"], d["label"]) for d in row[0]["documents"]] == [("https://x/d.pdf", "Uno")]


def test_post_data_source(spark, tmp_path):
    api, post = "https://x.it/posts", {"id": 1, "date_gmt": "2026-09-24T08:00:00", "link": "l", "title": {"rendered": "t"}, "content": {"rendered": ""}}
    answers = [{"url": posts.listing_url(api, n, None, "q"), "stato": 200, "intestazioni": {"X-WP-TotalPages": "2"}, "corpo": json.dumps([post | {"id": n}])} for n in (1, 2)]
    (tmp_path / "r.json").write_text(json.dumps(answers))
    spark.dataSource.register(posts.PostSource)
    df = spark.read.format("posts").option("api", api).option("search", "q").option("replay", str(tmp_path / "r.json")).load()
    assert sorted(r["id"] for r in df.collect()) == [1, 2]
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    after = [{**answers[0], "url": posts.listing_url(api, 1, "2026-09-20", "q"), "intestazioni": {}}]
    (tmp_path / "after.json").write_text(json.dumps(after))
    pushed = spark.read.format("posts").option("api", api).option("search", "q").option("pushdown", "true").option("replay", str(tmp_path / "after.json")).load()
    assert [r["id"] for r in pushed.where("date_gmt >= '2026-09-20'").collect()] == [1]
    spark.conf.unset("spark.sql.python.filterPushdown.enabled")
    with pytest.raises(Exception, match="needs search or categories"):
        spark.read.format("posts").option("api", api).load().collect()


PAGE = """<div class="USP-postcontent"><div><h2>Tre</h2></div><p>24 Settembre 2026 ore 10:23|</p><p><a href="/a.pdf">A</a></p>
<div><h2>Due &amp; mezzo</h2></div><p>23 Settembre 2026</p><a href="/a.pdf">A</a><a href="javascript:x">no</a>
<h2>Due &amp; mezzo</h2><p>23 Settembre 2026</p><p><a href='/a.pdf'>A</a></p>
<h2>Uno</h2><p>22 Settembre 2026 ore 9:00</p></div><h2>menu</h2>"""


def test_listing(spark):
    pages = spark.createDataFrame([("https://x.it/p", PAGE), ("https://x.it/q", None)], "page string, html string")
    items = listing.items_of_pages(pages)
    assert [(r["heading"], str(r["published"])) for r in items.orderBy("place").collect()] == [("Tre", "2026-09-24 08:23:00"), ("Due & mezzo", "2026-09-22 22:00:00"), ("Due & mezzo", "2026-09-22 22:00:00"), ("Uno", "2026-09-22 07:00:00")]
    keyed = {r["heading"]: r["key"] for r in listing.keyed(items).collect()}
    assert keyed["Due & mezzo"] == "https://x.it/a.pdf"  # the oldest owns the address
    assert keyed["Tre"].startswith("impronta:") and keyed["Uno"].startswith("impronta:") and len(keyed) == 3
    assert listing.decoded("è".encode("latin-1"), "text/html; charset=ISO-8859-1") == "è" and listing.decoded("è".encode(), "text/html; charset=nope") == "è"


def zipped(files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for n, d in files.items():
            z.writestr(n, d)
    return out.getvalue()


def test_archives(spark):
    deep = zipped({"a.zip": zipped({"b.zip": zipped({"c.zip": zipped({"d.pdf": b"x"})})})})
    rows = [("plain", b"%PDF"), ("zip", zipped({"x.pdf": b"1", "__MACOSX/x": b"", "in.zip": zipped({"y.pdf": b"2"}), "s.xml": b""})), ("deep", deep), ("broken", b"PK\x03\x04nope"), ("empty", zipped({"a.txt": b""})), ("none", None)]
    parts = archives.parts(spark.createDataFrame(rows, "k string, b binary"), "k", "b").collect()
    got = {}
    for r in parts:
        got.setdefault(r["k"], []).append((r["name"], bytes(r["content"]) if r["content"] is not None else None, bool(r["error"])))
    assert got["plain"] == [("", b"%PDF", False)] and sorted(got["zip"]) == [("in.zip/y.pdf", b"2", False), ("x.pdf", b"1", False)]
    assert got["deep"] == [("a.zip/b.zip", None, True)] and got["broken"][0][2] and got["empty"][0][2] and "none" not in got


def test_docx(spark):
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    body = zipped({"word/document.xml": f"<w:document {w}><w:body><w:p><w:r><w:t>{'Prima riga ' * 6}</w:t></w:r></w:p><w:p><w:r><w:t>Seconda</w:t></w:r></w:p></w:body></w:document>"})
    df = spark.createDataFrame([(1, body, None), (2, b"PK", None)], "i int, content binary, error string")
    one, two = archives.read_docx(df).orderBy("i").collect()
    assert one["text"].split("\n")[1] == "Seconda" and one["error"] is None and two["text"] is None and "broken DOCX" in two["error"]


def test_http_retries_and_pacing():
    waits, answers = [], [Answer(503, b""), Answer(200, b"<html>", {"content-type": "application/pdf"}), Answer(200, b"%PDF-", {"content-type": "application/pdf"})]
    client = PacedClient(fetch=lambda url: answers.pop(0), sleep=waits.append, clock=lambda: 0.0)
    assert client.get("https://x/a.pdf", ("application/pdf",)).body == b"%PDF-"
    assert waits == [2.0, 1.0, 4.0, 1.0]
    with pytest.raises(HttpError):
        PacedClient(fetch=lambda url: Answer(404, b""), sleep=waits.append).get("https://x/a")
    with pytest.raises(TemporaryHttpError):
        PacedClient(fetch=lambda url: Answer(429, b""), sleep=lambda s: None).get("https://x/a")


def test_sinks(spark, tmp_path):
    FileSink(str(tmp_path)).send("A b@x.it", "BA", "Oggetto", "testo", "<p>")
    assert (tmp_path / "a_b@x.it.BA.txt").read_text() == "Oggetto\n\ntesto" and file_name("..x@y") == "_x@y"
    spark.dataSource.register(MessageSink)
    df = spark.createDataFrame([("c@x.it", None, "O", "t", "<p>")], "email string, variant string, subject string, text string, html string")
    df.write.format("messages").option("path", str(tmp_path / "out")).mode("append").save()
    assert (tmp_path / "out" / "c@x.it.txt").exists()
    sink = MemorySink(("bad@x.it",))
    with pytest.raises(ConnectionError):
        sink.send("bad@x.it", None, "", "", "")


def test_links_plan_stays_in_the_jvm(spark):
    df = spark.createDataFrame([("<a href='https://x'>y</a>",)], "h string").select(posts.links(F.col("h")))
    assert "Python" not in df._jdf.queryExecution().executedPlan().toString()
