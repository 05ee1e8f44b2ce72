"""End-to-end batch job: pages and search data in, report out.

Stages are coupled by written tables, as the reference couples its scripts by
files: each stage writes parquet under ``out_dir`` and the next one reads it
back, which cuts lineage: a lost executor recomputes from the last written
stage, not from the raw pages.  With ``resume`` a table that an earlier run
completed is read instead of made again.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contentfit import config
from contentfit.functions import prompts as pr
from contentfit.functions import rules as rl
from contentfit.functions import text as tx
from contentfit.operators import fit as fx
from contentfit.operators import improve as im
from contentfit.operators import report as rp
from contentfit.operators import requests as rq
from contentfit.operators import sections as sx
from contentfit.operators import terms as tm
from contentfit.sources.fit_tables import RANGE, read_fit, write_fit
from contentfit.sources.tables import write_table

SECTION_KEYS = ["page_id", "section", "ordinal"]


@dataclass(frozen=True)
class PipelineConfig:
    top_k: int = config.TOP_K
    cut: float = config.VERDICT_CUT
    band: tuple = (config.BAND_LOW, config.BAND_HIGH)
    delta: float = config.DELTA_MIN
    attempts: int = config.MAX_ATTEMPTS
    tries: int = config.MAX_TRIES
    rollback: bool = False
    pack: rl.RulePack = rl.TURKISH_ADS


def intent_row_key() -> list:
    """Columns that name a row of the intent job, joined by ``|``."""
    return [F.col(c).cast("string") for c in SECTION_KEYS] + [F.col("intent")]


def _intents(queries: DataFrame, labels: DataFrame | None) -> DataFrame:
    """Each query's intent: the supplied label, else that of the
    nearest labelled text, else (without labels) the cleaned query."""
    if labels is None:
        return queries.select("query", "query_id", tx.clean_intent("query").alias("intent"))
    texts = labels.select(tx.label_text("intent").alias("intent")).where("intent <> ''")
    got = fx.assign_labels(queries.select("query_id", "query"), "query_id", "query", labels, texts, "intent")
    return got.select("query", "query_id", tx.clean_intent("intent").alias("intent"))


def run(spark: SparkSession, perf: DataFrame, pages: DataFrame, out_dir: str,
        cfg: PipelineConfig = PipelineConfig(), url: str | None = None, labels: DataFrame | None = None,
        attempts: DataFrame | None = None, resume: bool = False, answers: DataFrame | None = None) -> dict[str, DataFrame]:
    """Run every stage; returns the written tables re-read as DataFrames.

    ``perf``: (query, clicks, impressions); ``pages``: (page_id, url, html);
    ``labels``: (query, intent), may cover some of the queries; ``attempts``:
    generated texts (row_key, attempt, try, raw) for the intent job, whose
    rows are named as in the ``intent_work`` table.  Without it they come from
    ``answers``, (digest, attempt, try, raw), to the requests that this and
    earlier runs wrote (``requests``, see :mod:`contentfit.operators.requests`);
    a row without an answer stays as it is.
    """
    out: dict[str, DataFrame] = {}

    def stage(name: str, make: Callable[[], DataFrame], partition_by=None, scores: str | None = None) -> DataFrame:
        path = f"{out_dir.rstrip('/')}/{name}"
        done = None
        if resume:
            try:
                done = spark.read.parquet(path)
            except AnalysisException:  # not written yet
                pass
        if done is None:
            if scores:
                write_fit(make(), path, scores)
            else:
                write_table(make(), path, partition_by=partition_by)
            done = spark.read.parquet(path)
        out[name] = done = done.drop(RANGE)
        return done

    queries = stage("queries", lambda: tm.priority_terms(perf, cfg.top_k).select("query", "position").withColumn(
        "query_id", F.col("position").cast("long")))
    intents = stage("query_intents", lambda: _intents(queries, labels))
    if url is not None:
        pages = pages.where(F.col("url") == url.strip())
    # Pages are parsed once: what the job reads of a page is written, sections and titles are projections of it.
    arrays = stage("page_texts", lambda: sx.page_arrays(pages).select("page_id", "url", "title", "meta_description", *sx.SECTION_KINDS))
    sections = stage("sections", lambda: sx.sections_of(arrays), ["section"])
    fields = stage("fields", lambda: arrays.select("page_id", "title", "meta_description"))

    # Every section x every intent and query, zeros kept; J3 and J4 for titles and descriptions.
    texts = sections.select(*SECTION_KEYS, "text")
    intent_fit = stage("section_intent_fit", lambda: fx.lexical_all_pairs(
        texts, "text", intents.select("intent").where("intent <> ''").distinct(), "intent", ["intent"], cut=cfg.cut,
        raw_col="raw_score"))
    fit = stage("section_query_fit", lambda: fx.lexical_all_pairs(
        texts, "text", queries.select("query_id", "query"), "query", ["query_id"], cut=cfg.cut, raw_col="raw_score")
        .join(queries.select("query_id", "query"), "query_id"), scores="raw_score")
    stage("field_query_fit", lambda: fx.lexical_all_pairs(
        fields.select("page_id", F.expr("stack(2, 'title', title, 'meta', meta_description) AS (field, text)")), "text",
        queries.select("query_id", "query"), "query", ["query_id"], cut=cfg.cut))
    stage("field_self_fit", lambda: fx.self_fit(fields, "title", "meta_description", cut=cfg.cut))

    # The strict filter keeps the band alone, whose files are read alone.
    in_band = read_fit(spark, f"{out_dir.rstrip('/')}/section_query_fit", *cfg.band)
    work = im.improvable(in_band, "strict", score_col="raw_score", lo=cfg.band[0], hi=cfg.band[1])
    improved = stage("query_improvement", lambda: im.improve_by_rules(
        work, cfg.pack, keys=["page_id", "ordinal", "query_id"], score_col="raw_score", rollback=cfg.rollback,
        section_keys=[*SECTION_KEYS, "text"], query_keys=["query_id"], sections=texts.distinct(), queries=queries.select("query_id", "query")))
    rows = stage("intent_work", lambda: im.improvable(intent_fit, "any", score_col="raw_score", lo=cfg.band[0], hi=cfg.band[1]).select(
        F.concat_ws("|", *intent_row_key()).alias("row_key"), "intent", F.col("text").alias("old_text"), "section",
        F.col("raw_score").alias("old_score")))
    asking = rq.with_request(rows, pr.render(pr.IMPROVE_TEMPLATE, {
        "kullanici_niyeti": "intent", "mevcut_icerik": "old_text", "html_bolumu": "section", "eski_skor": F.round("old_score", 6)}))
    answers = spark.createDataFrame([], rq.ANSWER) if answers is None else answers
    # What generation is asked next for; answers given by digest are dealt to the rows that share them.
    out["requests"] = rq.make_requests(asking, answers, f"{out_dir.rstrip('/')}/requests", max_attempts=cfg.attempts, max_tries=cfg.tries)
    if attempts is None:
        attempts = rq.fan_out(asking, answers)
    chosen = im.attempt_texts(attempts, rows, max_tries=cfg.tries)
    by_intent = stage("intent_improvement", lambda: im.first_improving_attempt(rows, chosen, max_attempts=cfg.attempts))

    report = stage("report_rows", lambda: rp.report_rows(by_intent, "intent", "intent", delta_min=cfg.delta).unionByName(
        rp.report_rows(improved, "query", "query", delta_min=cfg.delta)))
    summary = stage("report_summary", lambda: rp.report_summary(report))
    return out | {"fit": fit, "improved": improved, "report_text": rp.summary_formatted(summary)}


def main(argv=None) -> None:
    """``python -m contentfit.plans.pipeline --pages P --perf Q --out O``.

    ``--pages``: parquet with (page_id, url, html); ``--perf``: CSV, parquet or
    xlsx with (query, clicks, impressions), or the reference's headers; ``--labels``:
    the same for (query, intent); ``--attempts``: parquet with (row_key,
    attempt, try, raw); ``--answers``: parquet with (digest, attempt, try, raw).
    """
    import argparse

    from contentfit.session import get_spark
    from contentfit.sources.compat import from_reference
    from contentfit.sources.tables import read_csv, read_search_performance, require_columns

    ap = argparse.ArgumentParser(description=main.__doc__)
    ap.add_argument("--pages", required=True)
    ap.add_argument("--perf", required=True)
    ap.add_argument("--out", required=True)
    ap.add_argument("--url", default=None, help="score one page only")
    ap.add_argument("--top-k", type=int, default=config.TOP_K)
    ap.add_argument("--cut", type=float, default=config.VERDICT_CUT)
    ap.add_argument("--band", type=float, nargs=2, default=(config.BAND_LOW, config.BAND_HIGH))
    ap.add_argument("--delta", type=float, default=config.DELTA_MIN)
    ap.add_argument("--max-attempts", type=int, default=config.MAX_ATTEMPTS)
    ap.add_argument("--max-tries", type=int, default=config.MAX_TRIES)
    ap.add_argument("--rollback", action="store_true", help="keep a text that its candidates don't improve")
    ap.add_argument("--labels", default=None)
    ap.add_argument("--attempts", default=None)
    ap.add_argument("--answers", default=None)
    ap.add_argument("--resume", action="store_true", help="keep the tables of an earlier run")
    ap.add_argument("--pack", choices=("turkish", "english-test"), default="turkish")
    ap.add_argument("--master", default=None)
    a = ap.parse_args(argv)
    spark = get_spark("contentfit-pipeline", master=a.master)
    if a.perf.endswith(".xlsx"):
        perf = read_search_performance(spark, a.perf, "xlsx")
    else:
        perf = read_csv(spark, a.perf) if a.perf.endswith(".csv") else spark.read.parquet(a.perf)
    perf = require_columns(from_reference(perf), ["query", "clicks", "impressions"]).select(
        "query", F.col("clicks").cast("long"), F.col("impressions").cast("long"))
    pages = require_columns(spark.read.parquet(a.pages), ["page_id", "url", "html"])
    pack = rl.TURKISH_ADS if a.pack == "turkish" else rl.ENGLISH_TEST
    labels = None
    if a.labels:
        labels = read_csv(spark, a.labels) if a.labels.endswith(".csv") else spark.read.parquet(a.labels)
        labels = require_columns(from_reference(labels), ["query", "intent"])
    attempts = require_columns(spark.read.parquet(a.attempts), ["row_key", "attempt", "try", "raw"]) if a.attempts else None
    answers = require_columns(spark.read.parquet(a.answers), ["digest", "attempt", "try", "raw"]) if a.answers else None
    cfg = PipelineConfig(top_k=a.top_k, cut=a.cut, band=tuple(a.band), delta=a.delta, attempts=a.max_attempts,
                         tries=a.max_tries, rollback=a.rollback, pack=pack)
    out = run(spark, perf, pages, a.out, cfg, url=a.url, labels=labels, attempts=attempts, resume=a.resume, answers=answers)
    out["report_text"].show(truncate=False)


if __name__ == "__main__":
    main()
