"""A ledger of generation requests (X1-X3, I2): what is asked, once, and what
came back.

A request is named by the SHA-256 of its text, its attempt and its try; rows
with the same request share it.  :func:`next_requests` says what each row needs
next, as the intent job's loop asks: the first try of the first attempt; after
an answer without the wanted JSON the next try; after a valid answer that
doesn't improve the row, or the last try, the next attempt; nothing after an
improvement or the last attempt.  What the ledger has is not asked again.
Answers are a table ``(digest, attempt, try, raw)`` that some batch inference
job appends to; :func:`fan_out` gives them back to every row that shares them.

Defined cases: answers that were not asked for are left alone; of several
answers to a request the smallest counts; rows with a null key are rows; a null
request text is asked as an empty one; empty tables give empty tables.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from contentfit import config
from contentfit.functions import text as tx
from contentfit.operators import improve as im
from contentfit.operators.fit import _same

REQUEST = "digest string, attempt int, try int, prompt string"
ANSWER = "digest string, attempt int, try int, raw string"


def with_request(rows: DataFrame, prompt: Column) -> DataFrame:
    """``rows`` with ``prompt`` and its ``digest``."""
    return rows.withColumn("prompt", F.coalesce(prompt, F.lit(""))).withColumn("digest", F.sha2("prompt", 256))


def fan_out(rows: DataFrame, answers: DataFrame, row_key: str = "row_key") -> DataFrame:
    """``(row_key, attempt, try, raw)`` of every row, from its request's answers."""
    one = answers.groupBy("digest", "attempt", "try").agg(F.min("raw").alias("raw"))
    return rows.select(row_key, "digest").distinct().join(one, "digest").select(row_key, "attempt", "try", "raw")


def next_requests(rows: DataFrame, answers: DataFrame, ledger: DataFrame, row_key: str = "row_key", required_key: str = "text",
                  max_attempts: int = config.MAX_ATTEMPTS, max_tries: int = config.MAX_TRIES) -> DataFrame:
    """The requests ``(digest, attempt, try, prompt)`` that rows need next and
    the ledger lacks, each once.

    ``rows``: ``with_request`` rows (row_key, intent, old_text, section,
    old_score, prompt, digest).
    """
    raw = fan_out(rows, answers, row_key).where((F.col("attempt") <= max_attempts) & (F.col("try") <= max_tries))
    asked = raw.groupBy(row_key, "attempt").agg(
        F.max("try").alias("tried"), F.max(tx.has_key(tx.first_json("raw"), required_key)).alias("valid"))
    last = asked.groupBy(row_key).agg(F.max(F.struct("attempt", "tried", "valid")).alias("last")).select(
        F.col(row_key).alias("_last"), "last.*")
    texts = im.attempt_texts(raw, rows, row_key, required_key, max_tries)
    better = im.first_improving_attempt(rows.drop("prompt", "digest"), texts, row_key, max_attempts).where("attempt > 0").select(
        F.col(row_key).alias("_better"))
    # Rows that are done leave; the others stand where their last attempt left them.
    waiting = rows.join(better.distinct(), _same([row_key], ["_better"]), "left_anti")
    waiting = waiting.join(last, _same([row_key], ["_last"]), "left")
    again = ~F.col("valid") & (F.col("tried") < max_tries)
    attempt = F.when(F.col("attempt").isNull(), F.lit(1)).when(again, F.col("attempt")).otherwise(F.col("attempt") + 1)
    nth = F.when(F.coalesce(again, F.lit(False)), F.col("tried") + 1).otherwise(F.lit(1))
    wanted = waiting.select("digest", attempt.cast("int").alias("attempt"), nth.cast("int").alias("try"), "prompt")
    wanted = wanted.where(F.col("attempt") <= max_attempts).dropDuplicates(["digest", "attempt", "try"])
    return wanted.join(ledger.select("digest", "attempt", "try"), ["digest", "attempt", "try"], "left_anti")


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """Every request made so far, with the ``run`` that made it."""
    try:
        return spark.read.schema(f"{REQUEST}, run int").parquet(path)
    except AnalysisException:  # none yet
        return spark.createDataFrame([], f"{REQUEST}, run int")


def make_requests(rows: DataFrame, answers: DataFrame, path: str, **limits) -> DataFrame:
    """Append what rows need next to the ledger under ``path``; returns it."""
    spark = rows.sparkSession
    ledger = read_ledger(spark, path)
    run = (ledger.agg(F.max("run")).first()[0] or 0) + 1
    new = next_requests(rows, answers, ledger, **limits).withColumn("run", F.lit(run))
    new.write.mode("append").partitionBy("run").parquet(path)
    return read_ledger(spark, path).where(F.col("run") == run).drop("run")
