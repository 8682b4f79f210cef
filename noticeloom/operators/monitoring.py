"""The health of sources: resume points, problems, state transitions and what to announce."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from noticeloom import settings
from noticeloom.functions.times import rome_day


def days(n: int) -> Column:
    return F.expr(f"INTERVAL {n} DAYS")


def resume_points(publications: DataFrame, now: Column) -> DataFrame:
    """``source, published`` to ``source, last, since``: read again from some days before the last known item."""
    last = publications.groupBy("source").agg(F.max("published").alias("last"))
    return last.withColumn("since", F.coalesce(F.col("last") - days(settings.OVERLAP_DAYS), now - days(settings.FIRST_READ_DAYS)))


def last_with_classes(publications: DataFrame, last: int = settings.FORMAT_LAST) -> DataFrame:
    """``source, id, published, has_classes`` to ``source, n, with_classes`` over the last items of each source.

    The rank limit runs before the shuffle, so a task sends at most ``last`` rows of a source.
    """
    order = Window.partitionBy("source").orderBy(F.desc("published"), F.desc("id"))
    ranked = publications.withColumn("_place", F.row_number().over(order)).where(F.col("_place") <= last)
    return ranked.groupBy("source").agg(F.count("*").alias("n"), F.sum(F.col("has_classes").cast("long")).alias("with_classes"))


def format_problem(n: Column, with_classes: Column) -> Column:
    return (n >= settings.FORMAT_LEAST) & (with_classes < settings.FORMAT_SHARE * n)


def problems(outcomes: DataFrame, publications: DataFrame, now: Column) -> DataFrame:
    """``source, error`` of a run, and the publications, to ``source, problem, message``."""
    seen = publications.groupBy("source").agg(F.max("published").alias("last"))
    formats = last_with_classes(publications)
    joined = outcomes.join(seen, "source", "left").join(formats, "source", "left")
    silent = F.col("last").isNull() | (F.unix_micros(now) - F.unix_micros("last") >= F.lit(settings.SILENCE_DAYS * 86_400_000_000))
    odd = F.coalesce(format_problem(F.col("n"), F.col("with_classes")), F.lit(False))
    problem = F.when(F.col("error").isNotNull(), "errore").when(silent, "silenzio").when(odd, "formato")
    message = (
        F.when(problem == "errore", F.col("error"))
        .when(problem == "silenzio", F.coalesce(F.concat(F.lit("ultima Pubblicazione del "), rome_day(F.col("last")).cast("string")), F.lit("nessuna Pubblicazione salvata")))
        .when(problem == "formato", F.concat(F.col("with_classes").cast("string"), F.lit(" delle ultime "), F.col("n").cast("string"), F.lit(" Pubblicazioni per docenti con Classi")))
    )
    return joined.select("source", "error", problem.alias("problem"), message.alias("message"))


def transitions(state: DataFrame, found: DataFrame, now: Column) -> DataFrame:
    """The state of all sources after a run: those read, and those that were not read as they were."""
    old = state.select("source", F.struct("last_success", "last_error", "message", "problem", "problem_since", "last_alert", "recovered").alias("old"))
    j = old.join(found.select("source", F.struct("error", "problem", "message").alias("new"), F.lit(True).alias("read")), "source", "full")
    was, now_is = F.col("old.problem"), F.col("new.problem")
    read = F.coalesce("read", F.lit(False))
    changed = read & ~was.eqNullSafe(now_is)
    ended = changed & now_is.isNull()
    announced = F.col("old.last_alert").isNotNull()
    return j.select(
        "source",
        F.when(read & F.col("new.error").isNull(), now).otherwise(F.col("old.last_success")).alias("last_success"),
        F.when(read & F.col("new.error").isNotNull(), now).otherwise(F.col("old.last_error")).alias("last_error"),
        F.when(read, F.col("new.message")).otherwise(F.col("old.message")).alias("message"),
        F.when(read, now_is).otherwise(was).alias("problem"),
        F.when(ended, None).when(changed, now).otherwise(F.col("old.problem_since")).alias("problem_since"),
        F.when(changed, None).otherwise(F.col("old.last_alert")).alias("last_alert"),
        F.when(ended & announced, now).when(changed, None).otherwise(F.col("old.recovered")).alias("recovered"),
    )


def in_recovery(problem: Column, recovered: Column, last_alert: Column, today: Column) -> Column:
    return problem.isNull() & recovered.isNotNull() & (last_alert.isNull() | (last_alert == today))


def due_today(problem: Column, recovered: Column, last_alert: Column, today: Column) -> Column:
    """A problem is announced when it starts and then every few days; a recovery once."""
    reminder = F.datediff(today, last_alert) >= settings.REMINDER_DAYS
    return F.when(problem.isNotNull(), last_alert.isNull() | (last_alert == today) | reminder).otherwise(in_recovery(problem, recovered, last_alert, today))


def problem_sentence(problem: Column, name: Column, since: Column, last: Column, today: Column) -> Column:
    n, silent = F.datediff(today, rome_day(since)), F.datediff(today, rome_day(last))
    ago = F.when(n == 0, "da oggi").when(n == 1, "da ieri").otherwise(F.concat(F.lit("da "), n.cast("string"), F.lit(" giorni")))
    quiet = F.coalesce(F.concat(F.lit("da "), silent.cast("string"), F.lit(" giorni")), F.lit("da oltre 30 giorni"))
    return (
        F.when(problem == "errore", F.concat(name, F.lit(" non consultabile "), ago, F.lit(": eventuali interpelli da questa fonte arriveranno appena torna disponibile.")))
        .when(problem == "silenzio", F.concat(name, F.lit(": nessuna pubblicazione "), quiet, F.lit(", possibile cambio del sito.")))
        .when(problem == "formato", F.concat(name, F.lit(": la fonte ha cambiato formato, alcuni interpelli potrebbero finire in Da verificare.")))
    )


def alerts(state: DataFrame, names: DataFrame, last_seen: DataFrame, today: Column) -> DataFrame:
    """``source, kind, text, due`` of configured sources with a problem or a fresh recovery. ``names``: ``source, name``."""
    j = state.join(names, "source").join(last_seen, "source", "left")
    recovering = in_recovery(F.col("problem"), F.col("recovered"), F.col("last_alert"), today)
    sentence = F.when(F.col("problem").isNotNull(), problem_sentence(F.col("problem"), F.col("name"), F.col("problem_since"), F.col("last"), today)).otherwise(F.concat("name", F.lit(" di nuovo disponibile.")))
    return j.where(F.col("problem").isNotNull() | recovering).select(
        "source", F.coalesce("problem", F.lit("ripresa")).alias("kind"), sentence.alias("text"), due_today(F.col("problem"), F.col("recovered"), F.col("last_alert"), today).alias("due")
    )


def announced(state: DataFrame, today: Column) -> DataFrame:
    due = due_today(F.col("problem"), F.col("recovered"), F.col("last_alert"), today)
    return state.withColumn("last_alert", F.when(due, today).otherwise(F.col("last_alert")))


def source_report(sources: DataFrame, items: DataFrame) -> DataFrame:
    """``source`` and ``source, published, classes`` to a line a source: items, those with classes, the last."""
    counted = items.groupBy("source").agg(F.count("*").alias("n"), F.sum((F.size("classes") > 0).cast("long")).alias("with_classes"), F.max("published").alias("last"))
    return sources.join(counted, "source", "left").select("source", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("with_classes", F.lit(0)).alias("with_classes"), "last")
