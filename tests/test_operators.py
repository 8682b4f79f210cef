import datetime as dt

import pytest
from pyspark.sql import functions as F

from noticeloom import schemas
from noticeloom.functions import places
from noticeloom.operators import digest, extraction, merging, monitoring, rendering, upserts

T0 = dt.datetime(2026, 1, 21, 13, 45)
NOTICE = "id long, type string, classes array<string>, town string, school_code string, protocol string, document string, fingerprint string, dates array<timestamp>"
BASE = {"type": "interpello", "classes": ["A033"], "town": "Brindisi", "school_code": None, "protocol": "741", "document": None, "fingerprint": None, "dates": [T0]}


def after(days, hours=0):
    return [T0 + dt.timedelta(days=days, hours=hours)]


@pytest.mark.parametrize(
    ("left", "right", "expected"),
    [
        ({"document": "h"}, {"document": "h", "type": "esito", "dates": after(40)}, "stesso"),
        ({"fingerprint": "f"}, {"fingerprint": "f", "classes": ["A011"]}, "stesso"),
        ({}, {"town": "BRINDISI", "classes": ["A033", "A040"], "dates": after(7)}, "stesso"),
        ({}, {"dates": after(7, 1)}, None),
        ({}, {"protocol": "742"}, None),
        ({}, {"town": None}, None),
        ({"classes": []}, {"classes": []}, None),
        ({"school_code": "X"}, {"school_code": "X", "town": None}, "stesso"),
        ({"school_code": "X"}, {"school_code": "Y"}, None),
        ({"school_code": "X"}, {}, "stesso"),
        ({}, {"protocol": None, "dates": after(3)}, "possibile-duplicato"),
        ({"protocol": None}, {"protocol": None}, "possibile-duplicato"),
        ({}, {"protocol": None, "dates": after(3, 1)}, None),
        ({"dates": [*after(-20), T0]}, {"dates": after(5)}, "stesso"),
    ],
)
def test_relation(spark, left, right, expected):
    rows = [(i, *({**BASE, **x}[f] for f in merging.FIELDS)) for i, x in enumerate((left, right))]
    df = spark.createDataFrame(rows, NOTICE)
    a, b = (df.where(f"id = {i}").select(F.struct(*merging.FIELDS).alias(n)) for i, n in enumerate("ab"))
    pair = a.crossJoin(b).select(merging.relation({f: F.col("a")[f] for f in merging.FIELDS}, {f: F.col("b")[f] for f in merging.FIELDS}).alias("r"))
    assert pair.first()["r"] == expected
    found = merging.related_pairs(df).collect()
    assert [(r["a"], r["b"], r["relation"]) for r in found] == ([(0, 1, expected)] if expected else [])


def test_components_of_a_chain_and_a_star(spark):
    nodes = spark.range(200)
    edges = spark.range(99).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")).unionByName(spark.range(101, 150).select(F.lit(100).cast("long").alias("a"), F.col("id").alias("b")))
    got = {r["id"]: r["component"] for r in merging.components(nodes, edges).collect()}
    assert all(got[i] == 0 for i in range(100)) and all(got[i] == 100 for i in range(100, 150)) and all(got[i] == i for i in range(150, 200))


def test_range_join_is_an_equi_join_and_equals_brute_force(spark):
    rows = [(i, i % 3, T0 + dt.timedelta(hours=7 * i * i % 1000)) for i in range(120)]
    a = spark.createDataFrame(rows, "a long, k int, ta timestamp")
    b = spark.createDataFrame(rows, "b long, k int, tb timestamp")
    joined = merging.within_days(a, b, "ta", "tb", 7, ["k"])
    expected = {(x[0], y[0]) for x in rows for y in rows if x[1] == y[1] and abs((x[2] - y[2]).total_seconds()) <= 7 * 86400}
    got = [(r["a"], r["b"]) for r in joined.collect()]
    assert set(got) == expected and len(got) == len(expected)
    assert "NestedLoop" not in joined._jdf.queryExecution().executedPlan().toString()


NOW = F.lit("2026-09-24 10:00:00").cast("timestamp")
STATE = "source string, last_success timestamp, last_error timestamp, message string, problem string, problem_since timestamp, last_alert date, recovered timestamp"


def test_state_machine(spark):
    day = dt.date(2026, 9, 20)
    old = dt.datetime(2026, 9, 19)
    state = spark.createDataFrame(
        [("same", None, old, "x", "errore", old, day, None), ("ended", None, old, "x", "errore", old, day, None), ("quiet-end", None, old, "x", "errore", old, None, None), ("other", None, old, "x", "errore", old, day, None), ("unread", old, None, None, None, None, None, None)],
        STATE,
    )
    found = spark.createDataFrame(
        [("same", "timeout", "errore", "timeout"), ("ended", None, None, None), ("quiet-end", None, None, None), ("other", None, "silenzio", "y"), ("fresh", "boom", "errore", "boom")],
        "source string, error string, problem string, message string",
    )
    got = {r["source"]: r for r in monitoring.transitions(state, found, NOW).collect()}
    assert got["same"]["problem_since"] == old and got["same"]["last_alert"] == day and got["same"]["message"] == "timeout"
    assert got["ended"]["problem"] is None and got["ended"]["recovered"] and got["quiet-end"]["recovered"] is None
    assert got["other"]["problem"] == "silenzio" and got["other"]["last_alert"] is None and got["other"]["problem_since"] > old
    assert got["fresh"]["problem"] == "errore" and got["unread"]["last_success"] == old


def test_problems(spark):
    now = dt.datetime(2026, 9, 24, 10)
    items = [("ok", i, now - dt.timedelta(hours=i), True) for i in range(12)] + [("odd", i, now - dt.timedelta(hours=i), i < 5) for i in range(12)]
    items += [("few", i, now, False) for i in range(9)] + [("edge", 1, now - dt.timedelta(days=7), True)]
    pubs = spark.createDataFrame(items, "source string, id long, published timestamp, has_classes boolean")
    runs = spark.createDataFrame([(s, None) for s in ("ok", "odd", "few", "edge", "none")] + [("bad", "no answer")], "source string, error string")
    got = {r["source"]: (r["problem"], r["message"]) for r in monitoring.problems(runs, pubs, NOW).collect()}
    assert got["ok"] == (None, None) == got["few"]
    assert got["odd"] == ("formato", "5 delle ultime 12 Pubblicazioni per docenti con Classi")
    assert got["edge"] == ("silenzio", "ultima Pubblicazione del 2026-09-17") and got["none"][0] == "silenzio" and got["bad"] == ("errore", "no answer")


def test_announcements(spark):
    rows = [("a", "errore", None, None), ("b", "errore", None, dt.date(2026, 9, 22)), ("c", "errore", None, dt.date(2026, 9, 21)), ("d", None, T0, None), ("e", None, T0, dt.date(2026, 9, 23)), ("f", "errore", None, dt.date(2026, 9, 24))]
    df = spark.createDataFrame(rows, "source string, problem string, recovered timestamp, last_alert date")
    due = monitoring.due_today(F.col("problem"), F.col("recovered"), F.col("last_alert"), F.lit("2026-09-24").cast("date"))
    assert {r["source"]: r["d"] for r in df.select("source", due.alias("d")).collect()} == {"a": True, "b": False, "c": True, "d": True, "e": False, "f": True}


def test_matching(spark):
    notices = spark.createDataFrame(
        [(1, "docente", ["A011", "A022"], "BA", False), (2, "docente", [], "BA", False), (3, "docente", ["A022"], None, False), (4, "docente", [], None, True), (5, "altro", ["A011"], "BA", False), (6, "docente", ["A099"], "BA", False), (7, "docente", ["A011"], "MT", False)],
        "id long, staff string, classes array<string>, province string, unreadable boolean",
    )
    people = spark.createDataFrame([(1, ["A022", "A011"], ["BA"]), (2, ["A022"], ["MT"])], "recipient long, classes array<string>, provinces array<string>")
    got = {(r["recipient"], r["id"]): (r["wanted_classes"], len(r["missing"])) for r in digest.matches(notices, people).collect()}
    assert got == {(1, 1): (["A011", "A022"], 0), (1, 2): ([], 1), (1, 3): (["A022"], 1), (1, 4): ([], 3), (2, 3): (["A022"], 1), (2, 4): ([], 3)}


def test_not_served(spark):
    prepared = spark.createDataFrame([(1, None), (2, "BA"), (3, "BA"), (4, "BA"), (5, None)], "recipient long, province string")
    served = spark.createDataFrame([(1, "BA"), (2, "BA"), (3, "MT"), (4, None)], "recipient long, province string")
    assert sorted((r["recipient"], r["province"]) for r in digest.not_served(prepared, served).collect()) == [(3, "BA"), (5, None)]


def test_admission(spark):
    rows = [(None, None, dt.datetime(2026, 9, 17, 10)), (None, None, dt.datetime(2026, 9, 17, 9, 59)), (None, dt.datetime(2026, 9, 24, 10), dt.datetime(2026, 9, 24)), (dt.datetime(2026, 9, 20), None, dt.datetime(2026, 9, 15)), (dt.datetime(2026, 9, 20), None, dt.datetime(2026, 9, 11))]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, f timestamp, d timestamp, p timestamp")
    ok = digest.admitted(F.col("f"), F.lit("2026-09-16").cast("timestamp"), F.col("d"), F.col("p"), NOW)
    assert [r[0] for r in df.orderBy("i").select(ok).collect()] == [True, False, False, True, False]


def test_upserts(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "k int, v string")
    new = spark.createDataFrame([(2, "c"), (3, None), (4, "d")], "k int, v string")
    assert {r["k"]: r["status"] for r in upserts.statuses(old, new, ["k"], ["v"]).collect()} == {1: "removed", 2: "updated", 3: "unchanged", 4: "new"}
    assert sorted(r["v"] or "" for r in upserts.upserted(old, new, ["k"]).collect()) == ["", "a", "c", "d"]
    assert sorted(r["k"] for r in upserts.ignored_if_known(old, new, ["k"]).collect()) == [1, 2, 3, 4]
    best = upserts.better(spark.createDataFrame([(1, None, 1), (1, "d", 2), (1, "e", 3)], "k int, document string, arrived int"), "k").collect()
    assert [r["document"] for r in best] == ["d"]


LETTER = "\n".join(
    ['ISTITUTO COMPRENSIVO "ROSSI"', "Via Roma, 1 - 75015 Pisticci - Tel. 0835 1", "e-mail: mtic00000x@istruzione.it", "Prot. n. 0001234 del 02/09/2026", "", "Al sito web", "", "OGGETTO: Interpello per supplenza su classe A022", "nella scuola secondaria", "IL DIRIGENTE SCOLASTICO", "VISTO che la classe A028 (prot. n. 999)", "candidature entro le ore 12:00 del 05/09/2026"]
)


def test_document_and_merge(spark):
    towns = spark.createDataFrame([("Pisticci", "Pisticci", "Matera", "MT"), ("Bari", "Bari", "Bari", "BA")], "names string, italian string, province_name string, province string")
    gazetteer = places.Gazetteer(towns)
    rows = [(1, "Interpello A011 Liceo, Bari prot. 55", ["Decreto prot. 1234 del 02/09/2026"], dt.datetime(2026, 9, 2, 8), LETTER, None, None), (2, "Annullamento interpello prot. 7 A011 per 9 ore, Bari", [], dt.datetime(2026, 9, 2, 8), None, None, None)]
    df = spark.createDataFrame(rows, "i int, heading string, labels array<string>, published timestamp, text string, region string, following string")
    one, two = extraction.merged(extraction.document_record(extraction.heading_record(df, gazetteer), gazetteer)).orderBy("i").collect()
    assert one["doc"]["subject"] == "Interpello per supplenza su classe A022 nella scuola secondaria"
    m = one["merged"]
    assert (m["classes"], m["town"], m["province"], m["province_from"]) == (["A022"], "Pisticci", "MT", "documento-codice-meccanografico")
    assert (m["protocol"], m["protocol_date"], m["school_code"], m["school"]) == ("1234", "02/09/2026", "MTIC00000X", 'ISTITUTO COMPRENSIVO "ROSSI"')
    assert str(m["deadline"]) == "2026-09-05 10:00:00"
    assert [d["field"] for d in one["disagreements"]] == ["classes", "town", "province"]
    assert (two["merged"]["type"], two["merged"]["referred_protocol"], two["merged"]["protocol"], two["merged"]["hours"]) == ("annullamento", "7", None, 9)
    assert two["disagreements"] == []


def test_is_notice(spark):
    df = spark.createDataFrame([("Interpello A022", "x.pdf", True), ("MESSA A DISPOSIZIONE per interpello", "x.pdf", False), ("Interpello A022", "allegato-1.pdf", False), (None, "x.pdf", False)], "s string, n string, e boolean")
    assert all(r["e"] == r["g"] for r in df.select("e", extraction.is_notice(F.col("s"), F.col("n")).alias("g")).collect())


def test_rendering(spark):
    row = spark.range(1).select(rendering.title(F.lit(None), F.lit("Bari"), F.lit("BA")).alias("a"), rendering.title(F.lit("X"), F.lit(None), F.lit("BA")).alias("b"), rendering.title(F.lit("X"), F.lit(None), F.lit(None)).alias("c"),
                                rendering.footer(NOW, F.array().cast("array<string>")).alias("f"), rendering.deadline_text(F.lit("2026-09-25 21:59:59").cast("timestamp"), F.lit("interpello")).alias("d"),
                                rendering.deadline_text(F.lit(None).cast("timestamp"), F.lit("esito")).alias("e")).first()
    assert tuple(row) == ("Scuola non indicata — Bari (BA)", "X — provincia di BA", "X", "Generato il 24/09/2026 alle 12:00 · Fonti lette: nessuna", "scade il 25/09", None)


def test_schema_violations(spark):
    good = schemas.empty(spark, "preference").unionByName(spark.createDataFrame([(1, "classe", "A011")], "recipient long, kind string, value string"))
    bad = good.unionByName(good).unionByName(spark.createDataFrame([(9, "other", "x")], "recipient long, kind string, value string"))
    people = schemas.conformed(spark.createDataFrame([(1, "x@y.it", True)], "recipient long, email string, active boolean"), "recipient")
    assert schemas.violations({"preference": good, "recipient": people}).count() == 0
    found = {(r["table"], r["rule"].split()[0]) for r in schemas.violations({"preference": bad, "recipient": people}).collect()}
    assert found == {("preference", "unique"), ("preference", "kind"), ("preference", "recipient")}
