import datetime as dt

import pytest
from pyspark.sql import functions as F

from noticeloom.functions import codes, places, text, times


def values(spark, rows, *columns):
    """Apply columns of ``x`` to each value, in order."""
    df = spark.createDataFrame([(i, x) for i, x in enumerate(rows)], "i int, x string")
    out = df.select("i", *(c.alias(f"c{k}") for k, c in enumerate(columns))).orderBy("i").collect()
    return [r["c0"] if len(columns) == 1 else tuple(r)[1:] for r in out]


X = F.col("x")


def test_clean_text(spark):
    got = values(spark, ["Avviso A011 &#8211; &#8220;Rossi&#8221;,<br/> Bari&nbsp;&amp; <b>poi</b>", "&amp;lt; &unknown; &#x2019;", "", None], text.clean_text(X))
    assert got == ['Avviso A011 - "Rossi", Bari & poi', "&lt; &unknown; '", "", None]


def test_fold_and_key(spark):
    assert values(spark, ["Città È  ß", "Ñandù", None], text.fold(X)) == ["citta e  ß", "nandu", None]
    assert values(spark, ["Forlì-Cesena 2", "L'Aquila"], text.name_key(X)) == ["forli cesena", "l aquila"]


def test_codes(spark):
    assert values(spark, ["A-11", "a11", "B - 17", "AM12", "A011", " a 22 "], codes.class_code(X)) == ["A011", "A011", "B017", "AM12", "A011", "A022"]
    assert values(spark, [" ba "], codes.province_code(X)) == ["BA"]
    assert values(spark, [" X@Y.it "], codes.email(X)) == ["x@y.it"]


@pytest.mark.parametrize(
    ("heading", "found", "inferred"),
    [
        ("Avviso A-11, A22, AM12 e AS2A, ADMM, B-17", ["A011", "A022", "AM12", "AS2A", "ADMM", "B017"], []),
        ("Avviso EEEE posto comune", ["EEEE"], []),
        ("Avviso per la scuola media", [], []),
        ("Cattedra di sostegno nella secondaria di II grado", ["ADSS"], ['ADSS da "sostegno"']),
        ("Avviso sostegno primo grado", ["ADMM"], ['ADMM da "sostegno"']),
        ("Avviso sostegno SS1G", ["ADMM"], ['ADMM da "sostegno"']),
        ("Avviso posto comune scuola primaria", ["EEEE"], ['EEEE da "posto comune"']),
        ("Avviso ADEE sostegno secondo grado", ["ADEE"], []),
        ("XA011 e A0112 non sono codici", [], []),
    ],
)
def test_classes(spark, heading, found, inferred):
    c = codes.classes(X)
    assert values(spark, [heading], c["codes"], c["inferred"]) == [(found, inferred)]


def test_classifiers(spark):
    kinds = {
        "Annullamento avviso prot. 1": "annullamento", "Rettifica avviso": "rettifica", "Proroga avviso ADMM": "riapertura", "Termini prorogati al 30/09": "interpello",
        "ADMM prorogato al 30/09": "riapertura", "ESITO avviso": "esito", "Supplenza A011": "interpello",
    }
    assert values(spark, list(kinds), codes.notice_type(X)) == list(kinds.values())
    people = {"Sostituzione DSGA": "ata-dsga", "Direttore dei Servizi generali": "ata-dsga", "Esperto PNRR": "altro", "A011 Liceo": "docente"}
    assert values(spark, list(people), codes.staff(X)) == list(people.values())


def test_protocol_hours_until(spark):
    p = codes.protocol(F.array(F.lit(None).cast("string"), X))
    assert values(spark, ["Avviso prot. 84 del 24-09-2026", "Prot. n. 12/IV.2", "Allegato"], p["number"], p["date"]) == [("84", "24-09-2026"), ("12", None), (None, None)]
    assert values(spark, ["0008494", "3390/2026", "0"], codes.protocol_number(X)) == ["8494", "3390", "0"]
    assert values(spark, ["per 9 ore", "18h", "nessuna"], codes.hours(X)) == [9, 18, None]
    assert values(spark, ["fino al 30/06/2027", "al termine delle attività", "mai"], codes.until(X)) == ["30/06/2027", "termine delle attività", None]
    assert values(spark, ["scuola PAIS018007.", "PAIS01800"], codes.school_code(X)) == ["PAIS018007", None]


def test_fingerprint(spark):
    body = "OGGETTO: avviso per supplenza su cattedra di 18 ore, classe A033, negli istituti di secondo grado. " * 3
    stamped = "_____\nm_pi.AOOUSPBR.REGISTRO\n UFFICIALE.E.0000799.21-01-2026.h.08:27\n" + body.upper().replace(" ", "  ")
    one, two, other, short, none = values(spark, [body, stamped, body.replace("A033", "A040"), "A033", None], text.fingerprint(X))
    assert one == two != other and one and short is None and none is None


def test_bodies(spark):
    rows = [b"%PDF-1", b"PK\x03\x04", b"7z\xbc", b"Rar!", b"\xd0\xcf\x11", b"text", b""]
    df = spark.createDataFrame([(i, b) for i, b in enumerate(rows)], "i int, b binary")
    assert [r[0] for r in df.orderBy("i").select(text.body_format(F.col("b"))).collect()] == ["pdf", "zip", "7z", "rar", "doc", "sconosciuto", "sconosciuto"]
    assert values(spark, ["a.PDF", "b.docx", "c", "d.exe"], text.type_of_name(X))[0::2] == ["application/pdf", "application/octet-stream"]
    why = text.inconsistent_body(F.col("x").cast("binary"), F.lit("application/pdf"), F.lit("https://x.it/a"), F.array(F.lit("application/pdf")))
    assert values(spark, ["%PDF-1.4", " <html>", "other"], why) == [None, "html page instead of the content", "the body is no PDF"]


def test_rendered_helpers(spark):
    assert values(spark, ["<a href='x'>&\"</a>"], text.escape_html(X)) == ["&lt;a href=&#39;x&#39;&gt;&amp;&quot;&lt;/a&gt;"]
    assert values(spark, ["..A b@x.it", "ok@x.it"], text.safe_file_name(X)) == ["_a_b@x.it", "ok@x.it"]


def test_times(spark):
    instant = F.to_timestamp(X)
    assert [str(v) for v in values(spark, ["2026-09-24 22:30:00"], times.rome_day(instant))] == ["2026-09-25"]
    walls = [("2026-01-15", 43200, "2026-01-15 11:00:00"), ("2026-07-15", 43200, "2026-07-15 10:00:00"), ("2026-10-25", 9000, "2026-10-25 01:30:00"), ("2026-03-29", 9000, "2026-03-29 01:30:00")]
    df = spark.createDataFrame([(i, d, s) for i, (d, s, _) in enumerate(walls)], "i int, d string, s int")
    got = [str(r[0]) for r in df.orderBy("i").select(times.rome_instant(F.to_date("d"), F.col("s"))).collect()]
    assert got == [w for _, _, w in walls]
    assert [str(v) for v in values(spark, ["24 Settembre 2026 ore 10:23|", "oggi", "31 Febbraio 2026"], times.long_date_instant(X))] == ["2026-09-24 08:23:00", "None", "2026-03-02 23:00:00"]
    assert values(spark, ["2026-09-24"], times.long_day(F.to_date(X))) == ["24 set 2026"]


REFERENCE = dt.datetime(2026, 9, 22, 8, tzinfo=dt.UTC)


@pytest.mark.parametrize(
    ("said", "instant"),
    [
        ("inviare la candidatura entro le ore 12:00 del 25/09/2026", "2026-09-25T10:00:00"),
        ("entro e non oltre le ore 13,00 del 22.01.2026", None),
        ("entro le ore 10.00 del\n25/09/2026", "2026-09-25T08:00:00"),
        ("entro le h. 9 del giorno 24-09-26", "2026-09-24T07:00:00"),
        ("entro il 19\nsettembre 2026 ore 11:00", "2026-09-19T09:00:00"),
        ("Termine ultimo: 1° ottobre 2026, ore 14", "2026-10-01T12:00:00"),
        ("ENTRO IL 30 SETT. 2026", "2026-09-30T21:59:59"),
        ("entro le ore 12:00 del 2 5 / 0 9 / 2 0 2 6", "2026-09-25T10:00:00"),
        ("entro le ore 22.00 del 23/09/2025", "2026-09-23T20:00:00"),
        ("entro il giorno 25 settembre", "2026-09-25T21:59:59"),
        ("entro le ore 24:00 del 28/09/2026", "2026-09-28T21:59:00"),
        ("scad. 22/09/2026 ore 11:00 - prorogata al 25/09/2026 ore 09:00", "2026-09-25T07:00:00"),
        ("la presa di servizio avviene entro il 28/09/2026", None),
        ("entro 5 giorni dal 22/09/2026", None),
        ("supplenza scadenza 30/06/2027", None),
        ("entro il 31/13/2026", None),
        ("", None),
        (None, None),
    ],
)
def test_deadline(said, instant):
    found = places.find_deadline(said, REFERENCE)
    assert (found and found.strftime("%Y-%m-%dT%H:%M:%S")) == instant


def test_deadline_column(spark):
    df = spark.createDataFrame([("entro le ore 12:00 del 25/09/2026", dt.datetime(2026, 9, 22)), (None, None)], "t string, p timestamp")
    assert [str(r[0]) for r in df.select(places.deadline("t", "p")).collect()] == ["2026-09-25 10:00:00", "None"]


def test_missing_year_is_the_nearest():
    assert places.find_deadline("entro il 3 gennaio ore 9", dt.datetime(2026, 12, 30, 8, tzinfo=dt.UTC)).year == 2027


TOWNS = [("Bari", "Bari", "Bari", "BA"), ("Valenzano", "Valenzano", "Bari", "BA"), ("Pisticci", "Pisticci", "Matera", "MT"), ("Matera", "Matera", "Matera", "MT"),
         ("Altamura", "Altamura", "Bari", "BA"), ("Sostegno", "Sostegno", "Biella", "BI"), ("Bolzano/Bozen", "Bolzano", "Bolzano/Bozen", "BZ"), ("San Severo", "San Severo", "Foggia", "FG"),
         ("Castro", "Castro", "Lecce", "LE"), ("Castro", "Castro", "Bergamo", "BG")]


@pytest.fixture(scope="module")
def gazetteer(spark):
    return places.Gazetteer(spark.createDataFrame(TOWNS, "names string, italian string, province_name string, province string"))


def test_places(gazetteer):
    def short(t):
        p = gazetteer.place(t)
        return p["town"], p["province"], p["province_from"]

    assert gazetteer.place('A022 I.C. "Rossi", Valenzano (BA)')["school"] == 'I.C. "Rossi"'
    assert short('A022 I.C. "Rossi", Valenzano (BA)') == ("Valenzano", "BA", "sigla")
    assert short("BAT - Avviso ADMM I.C. Manzoni") == (None, "BT", "nome-iniziale")
    assert short("Avviso A026 I.I.S. Fermi, Pisticci, Matera") == ("Pisticci", "MT", "nome-finale")
    assert short("Avviso ADEE 2° CD Garibaldi, Altamura") == ("Altamura", "BA", "comune")
    assert short("Avviso Sostegno") == (None, None, None)
    assert short("Liceo di Bozen") == ("Bolzano", "BZ", "nome-finale") or short("Liceo di Bozen")[0] == "Bolzano"
    assert gazetteer.place("Liceo, Castro: avviso")["ambiguous"] and not gazetteer.place("Liceo, Castro (LE)")["ambiguous"]
    assert gazetteer.place("Liceo, Castro (BA)")["conflict"]
    assert short("scuola a san severo")[0] is None  # towns begin with a capital
