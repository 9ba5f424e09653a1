"""What happens to proposals from run to run: recurrence, resolutions, seen keys and the history of targets.

Nothing here is broadcast by hint: seen keys grow with every run, so the planner decides by size.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tracemill import catalog
from tracemill.functions import text as tx


def target_key() -> Column:
    return F.concat_ws(":", "route", "target_name")


def first_of_key(proposals: DataFrame) -> DataFrame:
    """Of proposals with one key the first that was generated."""
    nth = F.row_number().over(W.partitionBy("proposal_key").orderBy("gen_route", "gen_name"))
    return proposals.withColumn("nth", nth).where("nth = 1").drop("nth")


def run_time(run_id: Column) -> Column:
    return F.try_to_timestamp(run_id, F.lit("yyyyMMdd'T'HHmmssX"))


def resolution_table(spark: SparkSession, resolutions: dict[str, dict]) -> DataFrame:
    rows = [(k, r["decision"], r["resolved_at"], r["pr"], r["note"], r["by"]) for k, r in sorted(resolutions.items())]
    table = spark.createDataFrame(rows, "target string, decision string, resolved_at string, pr string, note string, by string")
    return table.withColumn("watermark", tx.parse_time(F.col("resolved_at")))


def history_table(spark: SparkSession, state: dict) -> DataFrame:
    runs = state.get("target_run_history") if isinstance(state.get("target_run_history"), dict) else {}
    return spark.createDataFrame([(t, str(r), n) for t, found in runs.items() for n, r in enumerate(found or [])], "target string, run_id string, nth int")


def recurrence(proposals: DataFrame, history: DataFrame, resolutions: DataFrame) -> DataFrame:
    """Adds recurrence (1 if new), and to the summary in how many earlier runs the target was flagged.

    Runs up to a target's resolution don't count; with a resolution, nor do run ids that are no time.
    """
    marks = resolutions.where("watermark IS NOT NULL").select("target", "watermark")
    counted = history.join(marks, "target", "left").where(F.col("watermark").isNull() | F.coalesce(run_time(F.col("run_id")) > F.col("watermark"), F.lit(False)))
    prior = counted.groupBy("target").agg(F.count("*").alias("prior"))
    out = proposals.withColumn("target", target_key()).join(prior, "target", "left").withColumn("prior", F.coalesce("prior", F.lit(0)))
    more = F.concat(F.lit(" Recurring: also flagged in "), F.col("prior").cast("string"), F.lit(" previous run(s)."))
    return out.withColumns({"recurrence": F.col("prior") + 1, "summary": F.concat("summary", F.when(F.col("prior") > 0, more).otherwise(""))}).drop("prior")



def ranked(proposals: DataFrame) -> DataFrame:
    """Most recurrent first, then most evidence, then as generated."""
    return proposals.orderBy(F.col("recurrence").desc(), F.size("evidence").desc(), "gen_route", "gen_name")


def disposition(proposals: DataFrame, resolutions: DataFrame, seen: DataFrame, include_seen: bool = False, include_resolved: bool = False) -> DataFrame:
    """Adds the resolution and four flags: regression, settled (resolved and no regression), suppressed, emitted.

    Resolutions come before seen keys. A fixed target is a regression if its latest evidence is later than the fix.
    """
    out = proposals.join(resolutions, "target", "left")
    fixed = F.coalesce(F.col("decision") == "fixed", F.lit(False))
    later = F.coalesce(F.date_trunc("second", "latest_evidence_at") > F.col("watermark"), F.lit(False))
    out = out.withColumn("regression", fixed & later).withColumn("settled", F.col("decision").isNotNull() & ~F.col("regression"))
    out = out.withColumn("suppressed", F.col("settled") & ~F.lit(include_resolved))
    out = out.join(seen.select(F.col("key").alias("proposal_key")).distinct().withColumn("seen", F.lit(True)), "proposal_key", "left")
    note = F.concat(F.lit(" Regression after "), F.coalesce(F.nullif(F.col("pr"), F.lit("")), F.lit("recorded fix")), F.lit(" (fixed "), F.col("resolved_at"), F.lit(")."))
    out = out.withColumn("summary", F.concat("summary", F.when(F.col("regression"), note).otherwise("")))
    return out.withColumn("emitted", ~F.col("suppressed") & (F.lit(include_seen) | F.col("seen").isNull())).drop("seen")


def history_after(history: DataFrame, detected: DataFrame, run_id: str, keep: int = catalog.HISTORY_RUNS) -> DataFrame:
    """target, run_id, nth: the run added to each target that was detected and isn't settled; the last ``keep`` runs."""
    new = detected.where("NOT settled").select("target").distinct().withColumns({"run_id": F.lit(run_id), "nth": F.lit(1 << 30)})
    fresh = new.join(history.select("target", "run_id"), ["target", "run_id"], "left_anti")
    touched = history.unionByName(fresh)
    back = F.row_number().over(W.partitionBy("target").orderBy(F.col("nth").desc()))
    kept = touched.withColumn("back", back).where(F.col("back") <= keep)
    return kept.select("target", "run_id", (F.row_number().over(W.partitionBy("target").orderBy("nth")) - 1).alias("nth"))


def trim_history(runs: list[str], resolved_at: dt.datetime) -> list[str]:
    """The runs after a resolution; what is no time goes."""
    out = []
    for run in runs or []:
        try:
            when = dt.datetime.strptime(str(run), "%Y%m%dT%H%M%SZ").replace(tzinfo=dt.timezone.utc)
        except ValueError:
            continue
        if when > resolved_at:
            out.append(run)
    return out


def new_rows(rows: DataFrame, existing: DataFrame, keys: tuple[str, ...] = ("path", "ended_at")) -> DataFrame:
    """Rows whose key is not on record; several new rows of one key all stay."""
    as_text = lambda df: [F.coalesce(F.col(k).cast("string"), F.lit("")).alias(f"_{k}") for k in keys if k in df.columns]
    known = existing.select(*as_text(existing)).distinct()
    return rows.join(known, [F.coalesce(rows[k].cast("string"), F.lit("")) == known[f"_{k}"] for k in keys], "left_anti")
