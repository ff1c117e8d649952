"""Tally of positions in threads."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein.functions.stances import declarations, positions

#: Least messages of a thread, and the share (in percent) of classified ones, below which counts are withheld.
COVERAGE_MESSAGES, COVERAGE_LEAST = 5, 25


def classified(messages: DataFrame, bare_hash: bool = True) -> DataFrame:
    """One row a message with label, confidence, excerpt, choice and by_sender (messages of the sender in the thread).

    messages: thread, idx, sender, body. The count comes from a join, not a window, so a hot thread isn't sorted in one task.
    """
    own = messages.select("thread", "idx", "sender", positions(F.col("body"), bare_hash).alias("p")).select("thread", "idx", "sender", "p.*")
    per = messages.groupBy("thread", "sender").agg(F.count("*").alias("by_sender"))
    return own.join(per.select(F.col("thread").alias("_t"), F.col("sender").alias("_s"), "by_sender"), F.col("thread").eqNullSafe(F.col("_t")) & F.col("sender").eqNullSafe(F.col("_s"))).drop("_t", "_s")


def tally(labelled: DataFrame) -> DataFrame:
    """V4 to V6: counts by label of each thread, support and oppose by confidence, and coverage (whole percent).

    labelled: thread, label, confidence. In threads of some length with too small a coverage the counts of support,
    oppose and conditional are null and `withheld` is true.
    """
    n = lambda label, sure=None: F.count_if((F.col("label") == label) & (F.lit(True) if sure is None else F.col("confidence") == sure))
    out = labelled.groupBy("thread").agg(
        F.count("*").alias("msgs"), n("no-position").alias("no_position"), n("poll").alias("poll"), n("poll", "low").alias("poll_low"), n("conditional").alias("conditional"),
        *(n(label, sure).alias(f"{label}_{sure}") for label in ("support", "oppose") for sure in ("high", "low")),
    )
    out = out.withColumn("coverage", F.floor(100 * (F.col("msgs") - F.col("no_position")) / F.col("msgs")).cast("int"))
    out = out.withColumn("withheld", (F.col("msgs") >= COVERAGE_MESSAGES) & (F.col("coverage") < COVERAGE_LEAST))
    hidden = ("conditional", "support_high", "support_low", "oppose_high", "oppose_low")
    return out.select("thread", "msgs", "no_position", "poll", "poll_low", "coverage", "withheld", *(F.when(~F.col("withheld"), F.col(c)).alias(c) for c in hidden))


def poll(labelled: DataFrame) -> DataFrame:
    """Responses, weak ones and the number of voters of each choice of a thread, and its place: numbers first, by size, then letters."""
    out = labelled.filter("label = 'poll'").groupBy("thread", "choice").agg(F.count("*").alias("responses"), F.count_if(F.col("confidence") == "low").alias("low"), F.count_distinct("sender").alias("voters"))
    number = F.col("choice").rlike("^[0-9]+$")
    order = Window.partitionBy("thread").orderBy(F.when(number, 0).otherwise(1), F.when(number, F.lpad("choice", 8, "0")).otherwise(F.col("choice")))
    return out.withColumn("place", F.row_number().over(order))


def votes(labelled: DataFrame) -> DataFrame:
    """Each sender's last vote in a thread."""
    return labelled.filter("label = 'poll'").groupBy("thread", "sender").agg(F.max_by("choice", "idx").alias("choice"), F.count("*").alias("times"))


def chair_statements(messages: DataFrame, roles: DataFrame) -> DataFrame:
    """V7: declarations by senders whose role names a chair. messages: thread, idx, sender, body; roles: sender, role."""
    chairs = roles.filter(F.col("role").contains("Chair")).groupBy("sender").agg(F.min("role").alias("role"))
    said = messages.join(chairs, "sender").select("thread", "idx", "sender", "role", declarations(F.col("body")).alias("d"))
    return said.select("thread", "idx", "sender", "role", "d.around", "d.phrase").filter("phrase IS NOT NULL")
