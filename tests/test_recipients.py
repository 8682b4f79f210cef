import datetime as dt
import io
import zipfile

from pyspark.sql import functions as F

from noticeloom import schemas
from noticeloom.operators import extraction, recipients
from noticeloom.plans import recipients as command
from noticeloom.sources import documents

NOW = F.lit("2026-09-24 10:00:00").cast("timestamp")


def state(spark, folder):
    now = dt.datetime(2026, 9, 1)
    people = spark.createDataFrame([(1, "a@x.it", True, now, None, False), (2, "b@x.it", False, now, now, False)], schemas.TABLES["recipient"])
    wanted = spark.createDataFrame([(1, "classe", "A011"), (1, "provincia", "BA"), (2, "gruppo", "all"), (2, "provincia", "MT")], schemas.TABLES["preference"])
    digests = spark.createDataFrame([(10, 1, dt.date(2026, 9, 2), None, now), (11, 2, dt.date(2026, 9, 2), None, now)], schemas.TABLES["digest"])
    ledger = spark.createDataFrame([(1, 5, 10), (2, 5, 11)], schemas.TABLES["ledger"])
    for name, df in (("recipient", people), ("preference", wanted), ("digest", digests), ("ledger", ledger)):
        df.write.parquet(str(folder / name))
    (folder / "c.json").write_text('{"A011": "Lettere", "A022": "Italiano"}')
    (folder / "g.json").write_text('{"all": ["A011"]}')
    (folder / "p.csv").write_text("sigla;nome\nBA;Bari\nMT;Matera\n")
    return ["--state", str(folder), "--classes", str(folder / "c.json"), "--groups", str(folder / "g.json"), "--provinces", str(folder / "p.csv")]


def test_command(spark, tmp_path, capsys):
    base = state(spark, tmp_path)
    assert command.main([*base, "list"]) == 0
    out = capsys.readouterr().out
    assert "a@x.it\n  Classi: A011\n  Province: BA" in out and "b@x.it (disattivato)" in out
    assert command.main([*base, "add", "New@X.it", "--class", "a-22,A011", "--province", "ba", "--split"]) == 0
    row = spark.read.parquet(str(tmp_path / "next" / "recipient")).where("recipient = 3").first()
    assert row["email"] == "new@x.it" and row["split"] and row["active"]
    assert {r["value"] for r in spark.read.parquet(str(tmp_path / "next" / "preference")).where("recipient = 3").collect()} == {"A022", "A011", "BA"}
    assert command.main([*base, "add", "A@x.it", "--class", "A011", "--province", "BA"]) == 1
    assert command.main([*base, "add", "bad", "--class", "A099"]) == 1
    err = capsys.readouterr().err
    assert "indirizzo già presente" in err and "indirizzo non valido" in err and 'sconosciuta: "A099"' in err and "serve almeno una Provincia" in err
    assert command.main([*base, "change", "a@x.it", "--province", "MT"]) == 0
    after = spark.read.parquet(str(tmp_path / "next" / "preference")).where("recipient = 1")
    assert {(r["kind"], r["value"]) for r in after.collect()} == {("classe", "A011"), ("provincia", "MT")}
    assert command.main([*base, "change", "a@x.it", "--email", "b@x.it"]) == 1 and command.main([*base, "change", "zz@x.it"]) == 1
    assert command.main([*base, "forget", "a@x.it"]) == 0
    assert [r["digest"] for r in spark.read.parquet(str(tmp_path / "next" / "ledger")).collect()] == [11]
    assert command.main([*base, "deactivate", "a@x.it"]) == 0
    gone = spark.read.parquet(str(tmp_path / "next" / "recipient"))
    assert gone.where("active").count() == 0 and schemas.violations({"recipient": gone}).count() == 0


def test_deactivating_twice_keeps_the_first_instant(spark):
    df = spark.createDataFrame([(1, "a", False, None, dt.datetime(2026, 1, 1), False)], schemas.TABLES["recipient"])
    assert recipients.deactivated(df, df.select("recipient"), NOW).first()["deactivated"] == dt.datetime(2026, 1, 1)


def test_one_per_subject(spark):
    rows = [(1, 0, "h1", ("I.C. Rossi", "Avviso  A022", None, None)), (1, 1, "h2", ("I.C. ROSSI", "avviso a022", "77", "01/09/2026")), (1, 2, "h3", ("Liceo", "Avviso A022", None, None)), (1, 3, "h1", ("x", "y", "1", None))]
    df = spark.createDataFrame(rows, "publication long, place int, hash string, doc struct<school:string,subject:string,protocol:string,protocol_date:string>")
    got = [(r["hash"], r["doc"]["protocol"], r["doc"]["protocol_date"]) for r in extraction.one_per_subject(df).orderBy("place").collect()]
    assert got == [("h1", "77", "01/09/2026"), ("h3", None, None)]


def test_documents(spark):
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    docx, outer = io.BytesIO(), io.BytesIO()
    with zipfile.ZipFile(docx, "w") as z:
        z.writestr("word/document.xml", f"<w:document {w}><w:p><w:r><w:t>{'riga ' * 20}</w:t></w:r></w:p><w:p><w:r><w:t>Oggetto: avviso</w:t></w:r></w:p></w:document>")
    with zipfile.ZipFile(outer, "w") as z:
        z.writestr("a.docx", docx.getvalue())
        z.writestr("b.pdf", b"%PDF page")
    rows = [("zip", outer.getvalue()), ("pdf", b"%PDF long"), ("scan", b"%PDF scan"), ("bad", b"%PDF bad"), ("7z", b"7z\xbc"), ("none", None)]

    def pdf(body, first, last):
        if b"bad" in body:
            raise ValueError("no pages\nmore")
        return "" if b"scan" in body else f"pagina {first} " * 10 + ("\nOGGETTO: due" if first > 1 else "")

    read = documents.read_documents(spark.createDataFrame(rows, "k string, b binary"), "k", "b", pdf=pdf, scan=lambda body, page: "testo della scansione " * 5)
    got = {(r["key"], r["part"]): r for r in read.collect()}
    assert got["zip", 0]["region"] == "Oggetto: avviso" and got["zip", 1]["text"].startswith("pagina 1") and got["zip", 1]["kind"] == "application/pdf"
    assert got["pdf", 0]["region"] == "OGGETTO: due" and got["scan", 0]["text"].startswith("testo della") and got["scan", 0]["error"] is None
    assert got["bad", 0]["error"].endswith("broken PDF (no pages)") and got["7z", 0]["error"].endswith(": 7z") and ("none", 0) not in got and len(got) == 6
