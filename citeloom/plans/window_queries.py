"""Queries over windows, running state and time."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from citeloom.operators import dedupe, evidence, prose
from citeloom.plans.tables import table


def suffix_letters(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.year("o_orderdate").alias("y"), (F.col("o_orderkey") % 97 == 0).alias("bad"))
    return dedupe.letters(orders, ["o_custkey", "y"], ["o_orderkey"], "bad").select("o_orderkey", "letter")


SUFFIX_LETTERS = """
SELECT o_orderkey, CASE WHEN n BETWEEN 2 AND 26 AND NOT bad THEN chr(CAST(96 + rn AS INTEGER)) END AS letter FROM (
  SELECT o_orderkey, count(*) OVER w AS n, bool_or(o_orderkey % 97 = 0) OVER w AS bad, row_number() OVER (PARTITION BY o_custkey, year(o_orderdate) ORDER BY o_orderkey) AS rn
  FROM orders WINDOW w AS (PARTITION BY o_custkey, year(o_orderdate)))
"""


def line_state(spark, sf_dir):
    """Long lines as fences and short ones as headings: lines inside fences and the last section of each document."""
    lines = prose.text_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    marked = lines.withColumn("line", F.when(F.length("line") > 200, "```").when(F.length("line") < 40, "# heading").otherwise(F.col("line")))
    state = prose.line_state(marked)
    return state.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_lines"), F.count_if("in_fence").alias("inside"), F.max("section").alias("sections"))


LINE_STATE = """
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
m AS (SELECT doc_id, i, line, sum(CASE WHEN length(line) > 200 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS part FROM l)
SELECT doc_id, count(*) AS n_lines, CAST(sum(part % 2) AS BIGINT) AS inside, CAST(count(*) FILTER (length(line) < 40 AND part % 2 = 0) AS BIGINT) AS sections FROM m GROUP BY 1
"""


def carry_forward(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    asked = F.last(F.when(F.col("role") == "user", F.md5("text")), ignorenulls=True).over(w)
    return turns.select("conv_id", "turn", "role", asked.alias("asked")).filter("role = 'assistant'").select("conv_id", "turn", "asked")


CARRY_FORWARD = "SELECT conv_id, turn, asked FROM (SELECT conv_id, turn, role, last_value(CASE WHEN role = 'user' THEN md5(text) END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS asked FROM conversations) WHERE role = 'assistant'"


def slot_reservation(spark, sf_dir):
    """Times at which requests may run, 1.1 s apart for each user: the closed form of max(last + 1.1 s, now)."""
    events = table(spark, sf_dir, "events").select("event_id", "user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    n = F.row_number().over(Window.partitionBy("user_id").orderBy("us", "event_id"))
    step = 1_100_000
    w = Window.partitionBy("user_id").orderBy("us", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    each = events.withColumn("n", n)
    return each.withColumn("slot", F.max(F.col("us") - F.col("n") * step).over(w) + F.col("n") * step).select("event_id", "slot", (F.col("slot") - F.col("us")).alias("wait"))


SLOT_RESERVATION = """
WITH e AS (SELECT event_id, user_id, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
s AS (SELECT event_id, us, max(us - n * 1100000) OVER (PARTITION BY user_id ORDER BY us, event_id ROWS UNBOUNDED PRECEDING) + n * 1100000 AS slot FROM e)
SELECT event_id, slot, slot - us AS wait FROM s
"""


def ttl_asymmetric(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_type", "value", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    newest = events.agg(F.max("us").alias("now"))
    age = F.floor((F.col("now") - F.col("us")) / 100_000) * 100  # a second of these events stands for a thousand
    return events.crossJoin(F.broadcast(newest)).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count_if(evidence.fresh(age)).alias("fresh"), F.count_if(evidence.fresh(age, F.col("value") > 20)).alias("fresh_by_verdict"))


TTL_ASYMMETRIC = """
WITH e AS (SELECT event_type, value, CAST(floor((max(epoch_us(ts)) OVER () - epoch_us(ts)) / 100000) AS BIGINT) * 100 AS age FROM events)
SELECT event_type, count(*) AS n, count(*) FILTER (age < 604800) AS fresh, count(*) FILTER (age < CASE WHEN value > 20 THEN 3888000 ELSE 15552000 END) AS fresh_by_verdict FROM e GROUP BY 1
"""


def report_grouping_sets(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_type", F.to_date("ts").cast("string").alias("day"))
    return events.groupingSets([["event_type", "day"], ["event_type"], []], "event_type", "day").agg(F.count(F.lit(1)).alias("n")).select("event_type", "day", "n")


REPORT_GROUPING_SETS = "SELECT event_type, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, count(*) AS n FROM events GROUP BY GROUPING SETS ((event_type, CAST(CAST(ts AS DATE) AS VARCHAR)), (event_type), ())"


def decline_histogram(spark, sf_dir):
    reason = evidence.overwritable_year(F.lit("1995"), F.when(F.col("o_orderstatus") == "F", "book").otherwise("article"), F.year("o_orderdate").cast("string"), F.when(F.col("o_orderkey") % 3 != 0, "print"), F.col("o_orderkey") % 5 != 0)
    return table(spark, sf_dir, "orders").groupBy(reason.alias("reason")).agg(F.count(F.lit(1)).alias("n"))


DECLINE_HISTOGRAM = """
SELECT CASE WHEN year(o_orderdate) = 1995 THEN 'no-change' WHEN o_orderkey % 5 = 0 THEN 'unscoped' WHEN o_orderkey % 3 = 0 THEN 'no-version-of-record-date' WHEN o_orderstatus = 'F' AND year(o_orderdate) > 1995 THEN 'book-year-moved-later' ELSE 'yes' END AS reason, count(*) AS n FROM orders GROUP BY 1
"""


def reference_sort(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", F.lower("c_name").alias("name"), "c_mktsegment")
    return prose.ordered_places(c, "c_nationkey", ["c_mktsegment", "name", "c_custkey"]).select("c_nationkey", "c_custkey", "place")


REFERENCE_SORT = "SELECT c_nationkey, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_mktsegment, lower(c_name), c_custkey) AS place FROM customer"


def overlapping_windows(spark, sf_dir):
    """Words within sixty characters after each `the`: counts for each document."""
    words = prose.positions(table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"), F.regexp_replace("text", r"\s+", " ").alias("text")))
    w = Window.partitionBy("doc_id").orderBy("pos").rangeBetween(1, prose.WINDOW)
    near = words.withColumn("near", F.count(F.lit(1)).over(w)).filter("word = 'the'")
    return near.groupBy("doc_id").agg(F.count(F.lit(1)).alias("hits"), F.sum("near").alias("near"))


OVERLAPPING_WINDOWS = r"""
WITH t AS (SELECT item_id AS doc_id, string_split(regexp_replace(text, '\s+', ' ', 'g'), ' ') AS w FROM benchmark),
u AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM t),
p AS (SELECT *, coalesce(sum(length(word) + 1) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos FROM u),
n AS (SELECT doc_id, word, count(*) OVER (PARTITION BY doc_id ORDER BY pos RANGE BETWEEN 1 FOLLOWING AND 60 FOLLOWING) AS near FROM p)
SELECT doc_id, count(*) AS hits, CAST(sum(near) AS BIGINT) AS near FROM n WHERE word = 'the' GROUP BY 1
"""

def stream_counts(spark, sf_dir):
    """Hourly counts by a stream over the event files (beyond the batch library)."""
    from citeloom.streaming.freshness import event_stream, run_to_table, windowed_counts

    counts = windowed_counts(event_stream(spark, f"{sf_dir}/events.parquet"))
    found = run_to_table(counts.select(F.unix_seconds("window.start").alias("hour"), "event_type", "n"))
    return found.select("hour", "event_type", "n")


STREAM_COUNTS = "SELECT CAST(epoch(date_trunc('hour', ts)) AS BIGINT) AS hour, event_type, count(*) AS n FROM events GROUP BY 1, 2"

QUERIES = {
    "stream_counts": (stream_counts, STREAM_COUNTS),
    "suffix_letters": (suffix_letters, SUFFIX_LETTERS),
    "line_state": (line_state, LINE_STATE),
    "carry_forward": (carry_forward, CARRY_FORWARD),
    "slot_reservation": (slot_reservation, SLOT_RESERVATION),
    "ttl_asymmetric": (ttl_asymmetric, TTL_ASYMMETRIC),
    "report_grouping_sets": (report_grouping_sets, REPORT_GROUPING_SETS),
    "decline_histogram": (decline_histogram, DECLINE_HISTOGRAM),
    "reference_sort": (reference_sort, REFERENCE_SORT),
    "context_window": (overlapping_windows, OVERLAPPING_WINDOWS),
}
