"""Days of the job in a row: ids last, nothing is sent twice, links follow their publications, broken runs are made good."""

import datetime as dt
import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from noticeloom import schemas
from noticeloom.plans import job
from noticeloom.plans.state import State
from noticeloom.sources import adapters  # noqa: F401  loaded before a test replaces what it imports
from noticeloom.sources.posts import listing_url

API, DAY = "https://usp.example.it/posts", dt.datetime(2026, 9, 24, 10)
TOWN = ";".join(["", "", "", "", "", "Pisticci", "Pisticci", "", "", "", "", "Matera", "", "", "MT"])


def docx(text: str) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", "<w:document xmlns:w='http://schemas.openxmlformats.org/wordprocessingml/2006/main'><w:body>" + "".join(f"<w:p><w:r><w:t>{x}</w:t></w:r></w:p>" for x in text.split("\n")) + "</w:body></w:document>")
    return out.getvalue()


class Office:
    """A source whose posts a test sets day by day, and the job over it."""

    def __init__(self, spark, folder):
        self.spark, self.folder, self.state, self.out, self.documents = spark, folder, str(folder / "state"), folder / "out", {}
        (folder / "towns.csv").write_text("\n".join([";".join(f"c{i}" for i in range(15)), TOWN]))
        (folder / "s.json").write_text(json.dumps([{"id": "usp", "nome": "USP", "adapter": "wordpress", "impostazioni": {"api": API, "cerca": "interpello"}}]))
        spark.createDataFrame([(1, "a@x.it", True, DAY, None, False)], schemas.TABLES["recipient"]).write.parquet(f"{self.state}/recipient")
        spark.createDataFrame([(1, "classe", "A022"), (1, "provincia", "MT")], schemas.TABLES["preference"]).write.parquet(f"{self.state}/preference")
        schemas.empty(spark, "publication").write.parquet(f"{self.state}/publication")

    def day(self, now, posts, monkeypatch, deliver=True):
        """``posts``: ``(number, day of September, title, document names)``. The exit code, and which documents were fetched."""
        from noticeloom.sources import documents as reader

        bodies = [{"id": i, "date_gmt": f"2026-09-{d:02}T08:00:00", "link": f"https://usp.example.it/{i}", "title": {"rendered": t}, "content": {"rendered": "".join(f'<a href="https://usp.example.it/{n}">{n}</a>' for n in names)}} for i, d, t, names in posts]
        known = [r["published"] for r in State(self.spark, self.state).read("publication").select("published").collect()]
        after = (max(known) - dt.timedelta(days=7) if known else now - dt.timedelta(days=30)).strftime("%Y-%m-%dT%H:%M:%S")
        (self.folder / "r.json").write_text(json.dumps([{"url": listing_url(API, 1, after, "interpello"), "stato": 200, "intestazioni": {"Content-Type": "application/json"}, "corpo": json.dumps(bodies)}]))
        asked = []

        def fetched(urls, replay=None, types=()):
            names = [r["url"] for r in urls.collect()]
            asked.extend(n.rpartition("/")[2] for n in names)
            return self.spark.createDataFrame([(n, self.documents[n.rpartition("/")[2]], None, None) for n in names], reader.FETCHED)

        monkeypatch.setattr(reader, "fetched", fetched)
        command = ["--state", self.state, "--towns", str(self.folder / "towns.csv"), "--sources", str(self.folder / "s.json"), "--replay", str(self.folder / "r.json")]
        return job.main(command + (["--deliver", str(self.out)] if deliver else []), now), sorted(asked)

    def __getitem__(self, name):
        return State(self.spark, self.state).read(name)

    def mail(self):
        """What was written since the last look."""
        found = {f.name: f.read_text() for f in self.out.glob("*.txt")}
        for f in self.out.glob("*.*"):
            f.unlink()
        return found


@pytest.fixture
def office(spark, tmp_path):
    return Office(spark, tmp_path)


LETTER = "ISTITUTO FERMI\nVia Roma 75015 Pisticci\nProt. n. {n} del 20/09/2026\nOGGETTO: Interpello supplenza A022\n" + "testo della lettera " * 20


def test_ids_last_over_three_days_and_nothing_is_sent_twice(office, monkeypatch):
    office.documents = {"a.docx": docx(LETTER.format(n=5)), "b.docx": docx(LETTER.format(n=5) + "\n(copia)"), "c.docx": docx(LETTER.format(n=5) + "\nrettificato")}
    one = (1, 22, "Interpello A022 prot. 5 Liceo Fermi, Pisticci (MT)", ["a.docx"])
    assert office.day(DAY, [one], monkeypatch) == (0, ["a.docx"])
    notice = office["notice"].first()["id"]
    assert "A022" in office.mail()["a@x.it.txt"] and office["ledger"].count() == 1
    # an older publication of the same notice arrives later
    older = (2, 20, "Interpello A022 prot. 5 Liceo Fermi, Pisticci (MT)", ["b.docx"])
    assert office.day(DAY + dt.timedelta(days=1), [one, older], monkeypatch) == (0, ["b.docx"])
    assert [r["id"] for r in office["notice"].collect()] == [notice] and office["announcement"].count() == 2
    assert not office.mail()
    # the first one's document is replaced and its heading names another school
    changed = (1, 22, "Interpello A022 prot. 5 Liceo Enrico Fermi, Pisticci (MT)", ["c.docx"])
    assert office.day(DAY + dt.timedelta(days=2), [changed, older], monkeypatch) == (0, ["c.docx"])
    assert [r["id"] for r in office["notice"].collect()] == [notice] and not office.mail()
    assert {r["id"] for r in office["ledger"].collect()} == {notice}
    assert schemas.violations({n: office[n] for n in schemas.TABLES}).count() == 0


def test_removed_and_moved_links_follow_their_publication(office, monkeypatch):
    other = "LICEO VERDI\nVia Po 75015 Pisticci\nProt. n. 9 del 21/09/2026\nOGGETTO: Interpello supplenza A011\n" + "altro testo " * 30
    office.documents = {"a.docx": docx(LETTER.format(n=5)), "d.docx": docx(other)}
    both = (1, 22, "Interpello Pisticci (MT)", ["a.docx", "d.docx"])
    assert office.day(DAY, [both, (3, 22, "Interpello A045 prot. 8, Pisticci (MT)", [])], monkeypatch) == (0, ["a.docx", "d.docx"])
    ids = {r["document"]: r["id"] for r in office["notice"].collect()}
    untouched = office["notice"].where("document is null").first()
    moved = (1, 22, "Interpello Pisticci (MT)", ["d.docx", "a.docx"])
    assert office.day(DAY + dt.timedelta(days=1), [moved], monkeypatch) == (0, [])
    places = {r["url"][-6:]: r["place"] for r in office["publication_document"].collect()}
    assert places == {"d.docx": 0, "a.docx": 1} and {r["document"]: r["id"] for r in office["notice"].collect()} == ids
    assert office.day(DAY + dt.timedelta(days=2), [(1, 22, "Interpello Pisticci (MT)", ["d.docx"])], monkeypatch) == (0, [])
    assert [r["url"][-6:] for r in office["publication_document"].collect()] == ["d.docx"]
    assert {r["document"]: r["id"] for r in office["notice"].collect()} == ids and office["notice"].where("document is null").first() == untouched


def test_an_archive_is_fetched_once_and_old_readings_again(office, spark, monkeypatch):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("uno.docx", docx(LETTER.format(n=7)))
        z.writestr("due.7z", b"7z\xbc\xaf")
    office.documents = {"z.zip": out.getvalue()}
    post = (1, 22, "Interpello A022 Pisticci (MT)", ["z.zip"])
    assert office.day(DAY, [post], monkeypatch, deliver=False) == (0, ["z.zip"])
    assert office["document"].count() == 3
    snapshot = office["notice"].collect()
    assert office.day(DAY + dt.timedelta(hours=1), [post], monkeypatch, deliver=False) == (0, [])
    assert office["notice"].collect() == snapshot
    for column, old in (("error", "formato non ancora letto: zip"), ("following", None)):
        state = State(spark, office.state)
        kind = F.col("text").isNull() & F.col("error").isNull() if column == "error" else F.col("text").isNotNull()
        of_archive = office["document_part"].select(F.col("part").alias("hash"), "archive")
        if column == "error":
            state.stage("document", state.read("document").withColumn("error", F.when(kind, old).otherwise(F.col("error"))))
            state.commit()
            assert office.day(DAY + dt.timedelta(hours=2), [post], monkeypatch, deliver=False) == (0, ["z.zip"])
        assert of_archive.count() == 2
    # rules that changed extract everything again, from what is stored
    monkeypatch.setattr(job, "RULES", "next")
    monkeypatch.setattr(job.extraction_digests, "__defaults__", ("next",))
    assert office.day(DAY + dt.timedelta(hours=3), [post], monkeypatch, deliver=False) == (0, [])
    assert office["notice"].select("id").collect() == [(r["id"],) for r in snapshot]
    assert not office["notice"].where(F.col("updated") == F.lit(DAY + dt.timedelta(hours=3))).isEmpty()


def test_a_run_that_breaks_after_sending_is_made_good(office, monkeypatch):
    post = (1, 22, "Interpello A022 prot. 5 Liceo Fermi, Pisticci (MT)", [])
    kept = job.recorded
    monkeypatch.setattr(job, "recorded", lambda *a: (_ for _ in ()).throw(RuntimeError("killed")))
    assert office.day(DAY, [post], monkeypatch)[0] == 1
    assert "a@x.it.txt" in office.mail()  # sent, and not recorded
    assert State(office.spark, office.state).number == 1 and len(State(office.spark, office.state).open_outboxes()) == 1
    monkeypatch.setattr(job, "recorded", kept)
    assert office.day(DAY + dt.timedelta(minutes=5), [post], monkeypatch)[0] == 0
    assert not office.mail() and office["digest"].count() == 1 and office["ledger"].count() == 1
    assert {r["id"] for r in office["ledger"].collect()} <= {r["id"] for r in office["notice"].collect()}
    assert not State(office.spark, office.state).open_outboxes()


def test_a_run_that_breaks_before_sending_loses_nothing(office, monkeypatch):
    post = (1, 22, "Interpello A022 prot. 5 Liceo Fermi, Pisticci (MT)", [])
    kept = job.delivered
    monkeypatch.setattr(job, "delivered", lambda *a: (_ for _ in ()).throw(RuntimeError("killed")))
    assert office.day(DAY, [post], monkeypatch)[0] == 1 and not office.mail()
    monkeypatch.setattr(job, "delivered", kept)
    assert office.day(DAY + dt.timedelta(minutes=5), [post], monkeypatch)[0] == 0
    assert "a@x.it.txt" in office.mail() and office["ledger"].count() == 1


def test_two_runs_cannot_write_one_snapshot(spark, tmp_path):
    schemas.empty(spark, "publication").write.parquet(f"{tmp_path}/publication")
    one, two = State(spark, str(tmp_path)), State(spark, str(tmp_path))
    one.stage("alias", spark.createDataFrame([(1, 2)], schemas.TABLES["alias"]))
    two.stage("alias", spark.createDataFrame([(3, 4)], schemas.TABLES["alias"]))
    one.commit(["x"])
    with pytest.raises(RuntimeError, match="another run"):
        two.commit()
    assert State(spark, str(tmp_path)).read("alias").collect() == [(1, 2)] and State(spark, str(tmp_path)).settled == ["x"]
