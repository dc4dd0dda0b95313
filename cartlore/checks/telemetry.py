"""Request metrics in batch form."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import sketches
from ..operators import telemetry as tm
from ..operators.indexing import global_index
from ..session import scratch_path
from . import frames as fr
from .base import Checks

checks = Checks()
load, sql = fr.load, fr.sql

BOUNDS = tm.LATENCY_MS
BOUND_ROWS = ", ".join(f"(CAST({b} AS DOUBLE))" for b in "5 10 25 50 100 250 500 1000 2500 'Infinity'".split())
CANDIDATE_ROWS = ", ".join(f"(CAST({b} AS DOUBLE))" for b in "10 25 50 100 200 500 'Infinity'".split())


@checks.add("request_counter", sql("requests", "SELECT service, endpoint, status, count(*) AS n_requests FROM requests GROUP BY ALL"))
def request_counter(spark, sf):
    return tm.request_counter(load(spark, sf, "requests"), ["service", "endpoint", "status"])


@checks.add(
    "session_stats",
    sql(
        "requests",
        """SELECT coalesce(service, 'all') AS service, count(*) AS total, round(avg(latency_ms), 6) AS avg_ms,
                  min(latency_ms) AS best_ms, max(latency_ms) AS worst_ms FROM requests GROUP BY ROLLUP (service)""",
    ),
)
def session_stats(spark, sf):
    return tm.latency_stats(load(spark, sf, "requests")).withColumn("avg_ms", F.round("avg_ms", 6))


def hist_sql(group: str, value: str, bounds: str, source: str) -> str:
    return f"""SELECT {group}, le, (SELECT 1) AS one, count({value}) AS n_values, round(sum({value}), 4) AS value_sum,
                      count(*) FILTER (WHERE {value} <= le) AS cumulative
               FROM {source}, (VALUES {bounds}) b(le) GROUP BY {group}, le"""


@checks.add(
    "fixed_bucket_histogram",
    sql("requests", f"SELECT * EXCLUDE (one, le), CAST(le AS VARCHAR) AS le FROM ({hist_sql('service', 'latency_ms', BOUND_ROWS, 'requests')})"),
)
def fixed_bucket_histogram(spark, sf):
    hist = tm.histogram(load(spark, sf, "requests"), "latency_ms", BOUNDS, ["service"])
    le = F.when(F.col("le") == float("inf"), "inf").otherwise(F.col("le").cast("string"))
    return hist.withColumn("value_sum", F.round("value_sum", 4)).withColumn("le", le)


# buckets of one group as one row per bucket with its predecessor; q * n falls into exactly one
QUANTILE = """
    SELECT {g}, {q} AS q, CASE WHEN isinf(le) THEN prev_le
           ELSE prev_le + (le - prev_le) * coalesce((CAST({q} AS DOUBLE) * n - prev_c) / nullif(cumulative - prev_c, 0), 0) END AS value
    FROM (SELECT *, max(cumulative) OVER (PARTITION BY {g}) AS n,
                 coalesce(lag(le) OVER (PARTITION BY {g} ORDER BY le), 0) AS prev_le,
                 coalesce(lag(cumulative) OVER (PARTITION BY {g} ORDER BY le), 0) AS prev_c FROM {h})
    QUALIFY row_number() OVER (PARTITION BY {g} ORDER BY CASE WHEN cumulative >= CAST({q} AS DOUBLE) * n THEN le END NULLS LAST) = 1"""


@checks.add(
    "histogram_quantile",
    sql("requests", f", h AS ({hist_sql('service', 'latency_ms', BOUND_ROWS, 'requests')}) ")
    + " UNION ALL ".join(
        f"SELECT service, CAST(q AS DOUBLE) AS q, round(value, 6) AS value FROM ({QUANTILE.format(g='service', q=q, h='h')})"
        for q in tm.QUANTILES
    ),
)
def histogram_quantile(spark, sf):
    hist = tm.histogram(load(spark, sf, "requests"), "latency_ms", BOUNDS, ["service"])
    parts = [tm.histogram_quantile(hist, q, ["service"]) for q in tm.QUANTILES]
    merged = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return merged.withColumn("value", F.round("value", 6))


@checks.add(
    "ratio_of_sums",
    sql("requests", "SELECT service, sum(n_sources) / count(*) AS sources_per_request FROM requests GROUP BY service"),
)
def ratio_of_sums(spark, sf):
    return tm.ratio(load(spark, sf, "requests"), F.col("n_sources"), F.lit(1), ["service"], "sources_per_request")


@checks.add(
    "latest_gauge",
    sql("requests", "SELECT service, endpoint, arg_max(latency_ms, (ts, request_id)) AS latency_ms FROM requests GROUP BY ALL"),
)
def latest_gauge(spark, sf):
    return tm.latest_gauge(load(spark, sf, "requests"), ["service", "endpoint"], "latency_ms", "ts", "request_id")


@checks.add("sum_by", sql("requests", "SELECT endpoint, CAST(sum(n_sources) AS BIGINT) AS n_sources FROM requests GROUP BY endpoint"))
def sum_by(spark, sf):
    return tm.sum_by(load(spark, sf, "requests"), ["endpoint"], "n_sources")


@checks.add(
    "count_or_zero",
    sql("requests", "SELECT count(*) AS n, 'error' AS what FROM requests WHERE status = 'error' UNION ALL SELECT count(*), 'timeout' FROM requests WHERE status = 'timeout'"),
)
def count_or_zero(spark, sf):
    requests = load(spark, sf, "requests")
    found = [tm.count_or_zero(requests, F.col("status") == s).withColumn("what", F.lit(s)) for s in ("error", "timeout")]
    return found[0].unionByName(found[1])


# --- range functions ----------------------------------------------------------------


def slide(seconds: int, step: int, by: str, select: str) -> str:
    """Ranges of ``seconds`` starting every ``step``: each row belongs to seconds/step of them."""
    return f"""SELECT {select} FROM (
        SELECT *, (CAST(floor(epoch_us(ts) / {step}000000.0) AS BIGINT) - k) * {step}000 AS start_ms
        FROM requests, (SELECT unnest(range(0, {seconds // step})) AS k)) GROUP BY start_ms, {by}"""


@checks.add(
    "rate_window",
    sql("requests", slide(60, 15, "service", "start_ms, service, count(*) AS n, count(*) / 60 AS rate")),
)
def rate_window(spark, sf):
    rates = tm.rate_window(load(spark, sf, "requests"), "ts", "1 minute", 60, "15 seconds", ["service"])
    return rates.select(fr.epoch_ms("start", "start_ms"), "service", "n", "rate")


@checks.add("tumbling_counts", sql("requests", slide(60, 60, "status", "start_ms, status, count(*) AS n")))
def tumbling_counts(spark, sf):
    counts = tm.counts_per_window(load(spark, sf, "requests"), "ts", "1 minute", ["status"])
    return counts.select(fr.epoch_ms("start", "start_ms"), "status", "n")


WINDOWED = """SELECT start_ms, service, start_ms || service AS g, le, count(*) FILTER (WHERE latency_ms <= le) AS cumulative
    FROM (SELECT *, CAST(floor(epoch_us(ts) / 300000000.0) AS BIGINT) * 300000 AS start_ms FROM requests), (VALUES {b}) b(le)
    GROUP BY start_ms, service, le"""


@checks.add(
    "latency_quantile_window",
    sql("requests", f", h AS ({WINDOWED.format(b=BOUND_ROWS)}), ")
    + ", ".join(f"q{i} AS ({QUANTILE.format(g='start_ms, service', q=q, h='h')})" for i, q in enumerate(tm.QUANTILES))
    + """ SELECT start_ms, service, round(q0.value, 6) AS p50, round(q1.value, 6) AS p95, round(q2.value, 6) AS p99
          FROM q0 JOIN q1 USING (start_ms, service) JOIN q2 USING (start_ms, service)""",
)
def latency_quantile_window(spark, sf):
    found = tm.latency_quantiles(load(spark, sf, "requests"), "ts", "5 minutes", "latency_ms", BOUNDS, ["service"])
    rounded = [F.round(c, 6).alias(c) for c in ("p50", "p95", "p99")]
    return found.select(fr.epoch_ms("start", "start_ms"), "service", *rounded)


@checks.add(
    "counter_increase",
    sql(
        "counter_samples",
        """SELECT series, start_ms, sum(step) AS increase, sum(step) / 60 AS per_second FROM (
             SELECT series, CAST(floor(epoch_us(ts) / 60000000.0) AS BIGINT) * 60000 AS start_ms,
                    CASE WHEN prev IS NULL THEN 0.0::DOUBLE WHEN value < prev THEN value ELSE value - prev END AS step
             FROM (SELECT *, lag(value) OVER (PARTITION BY series ORDER BY ts, value) AS prev FROM counter_samples)) GROUP BY ALL""",
    ),
)
def counter_increase(spark, sf):
    grown = tm.counter_increase(load(spark, sf, "counter_samples"), ["series"], "ts", "value", "1 minute", 60)
    return grown.select("series", fr.epoch_ms("start", "start_ms"), "increase", "per_second")


@checks.add(
    "counter_rate_by",
    """WITH samples AS (SELECT event_type, user_id, ts, CAST(event_id % 997 AS DOUBLE) AS value FROM events),
        steps AS (SELECT *, lag(value) OVER (PARTITION BY event_type, user_id ORDER BY ts, value) AS prev FROM samples)
       SELECT event_type, CAST(floor(epoch_us(ts) / 300000000.0) AS BIGINT) * 300000 AS start_ms,
              round(sum(CASE WHEN prev IS NULL THEN 0 WHEN value < prev THEN value ELSE value - prev END) / 300, 9) AS rate
       FROM steps GROUP BY ALL""",
)
def counter_rate_by(spark, sf):
    """One counter per event type and user, summed by event type."""
    samples = load(spark, sf, "events").select(
        "event_type", "user_id", F.col("ts").cast("timestamp").alias("ts"), (F.col("event_id") % 997).cast("double").alias("value")
    )
    rates = tm.counter_rate_by(samples, ["event_type", "user_id"], ["event_type"], "ts", "value", "5 minutes", 300)
    return rates.select("event_type", fr.epoch_ms("start", "start_ms"), F.round("rate", 9).alias("rate"))


# cumulative bucket counters of four services' processes, which restart every 41 scrapes
SCRAPES = """scrapes AS (
    SELECT event_type AS service, user_id % 2 AS process, CAST(le AS DOUBLE) AS le, CAST(ts AS TIMESTAMP) AS ts,
           CAST(CAST(rn % 41 AS BIGINT) * share AS DOUBLE) AS value
    FROM (SELECT *, row_number() OVER (PARTITION BY event_type, user_id % 2 ORDER BY event_id) AS rn FROM events),
         (VALUES ('5', 1), ('50', 3), ('500', 4), ('Infinity', 5)) b(le, share))"""


@checks.add(
    "counter_bucket_quantile",
    f"""WITH {SCRAPES},
        steps AS (SELECT *, lag(value) OVER (PARTITION BY service, process, le ORDER BY ts, value) AS prev FROM scrapes),
        h AS (SELECT service, CAST(floor(epoch_us(ts) / 300000000.0) AS BIGINT) * 300000 AS start_ms, le,
                     sum(CASE WHEN prev IS NULL THEN 0 WHEN value < prev THEN value ELSE value - prev END) AS cumulative
              FROM steps GROUP BY ALL),
        grown AS (SELECT * FROM h QUALIFY max(cumulative) OVER (PARTITION BY start_ms, service) > 0)
        SELECT start_ms, service, round(value, 6) AS p90 FROM ({QUANTILE.format(g='start_ms, service', q=0.9, h='grown')})""",
)
def counter_bucket_quantile(spark, sf):
    """Growth of each bucket counter with restarts, summed over the processes, then the quantile."""
    bounds = [("5", 1), ("50", 3), ("500", 4), ("Infinity", 5)]
    buckets = F.explode(F.array(*[F.struct(F.lit(le).cast("double").alias("le"), F.lit(n).alias("share")) for le, n in bounds]))
    events = load(spark, sf, "events").withColumn("process", F.col("user_id") % 2).drop("user_id", "value")
    placed = global_index(events, ["event_type", "process", "event_id"], "at")  # before the buckets are made
    starts = placed.groupBy("event_type", "process").agg(F.min("at").alias("start"))
    numbered = placed.join(starts, ["event_type", "process"]).withColumn("rn", F.col("at") - F.col("start") + 1)
    scrapes = numbered.select(
        F.col("event_type").alias("service"), "process", F.col("ts").cast("timestamp").alias("ts"), "rn", buckets.alias("b")
    )
    scrapes = scrapes.select("service", "process", "ts", "b.le", ((F.col("rn") % 41) * F.col("b.share")).cast("double").alias("value"))
    found = tm.counter_bucket_quantiles(scrapes, ["service", "process"], ["service"], "le", "ts", "value", "5 minutes", [0.9])
    return found.select(fr.epoch_ms("start", "start_ms"), "service", F.round("p90", 6).alias("p90")).dropna()


# --- evaluation grids ------------------------------------------------------------------

DAY = ("2024-01-08 00:00:00", "2024-01-09 00:00:00")


@checks.add(
    "latest_gauge_grid",
    sql(
        "requests",
        """, grid AS (SELECT TIMESTAMP '2024-01-08 00:00:00' + to_seconds(60 * i) AS point FROM range(0, 1441) t(i))
           SELECT service, endpoint, epoch_ms(point) AS at_ms, latency_ms FROM grid
           JOIN requests ON ts <= point AND ts > point - INTERVAL 300 SECOND
           QUALIFY row_number() OVER (PARTITION BY service, endpoint, point ORDER BY ts DESC, request_id DESC) = 1""",
    ),
)
def latest_gauge_grid(spark, sf):
    """One day, minute by minute; a latency stands for five minutes."""
    found = tm.gauge_on_grid(load(spark, sf, "requests"), ["service", "endpoint"], "latency_ms", "ts", 60, *DAY, "request_id")
    return found.select("service", "endpoint", fr.epoch_ms("at", "at_ms"), "latency_ms")


@checks.add(
    "rate_window_grid",
    sql(
        "counter_samples",
        """, grid AS (SELECT TIMESTAMP '2024-01-08 00:00:00' + to_seconds(300 * i) AS point FROM range(0, 289) t(i)),
           steps AS (SELECT series, ts, CASE WHEN prev IS NULL THEN 0.0::DOUBLE WHEN value < prev THEN value ELSE value - prev END AS step
                     FROM (SELECT *, lag(value) OVER (PARTITION BY series ORDER BY ts, value) AS prev FROM counter_samples))
           SELECT series, epoch_ms(point) AS at_ms, sum(step) AS increase, sum(step) / 1800 AS rate
           FROM grid JOIN steps ON ts <= point AND ts > point - INTERVAL 1800 SECOND GROUP BY series, point""",
    ),
)
def rate_window_grid(spark, sf):
    """Growth over the last half hour, every five minutes of a day."""
    found = tm.rate_on_grid(load(spark, sf, "counter_samples"), ["series"], "ts", "value", 300, 1800, *DAY)
    return found.select("series", fr.epoch_ms("at", "at_ms"), "increase", "rate")


# --- sketches --------------------------------------------------------------------------


def rank_is_near(rows, found, by: list[str], value: str, qs: list[float]):
    """Whether the rank of each quantile is within the stated error of what was asked for, per group."""
    counts = [F.count("*").alias("n_values")]
    for q in qs:
        p = f"p{round(q * 100)}"
        counts += [F.count_if(F.col(value) < F.col(p)).alias(f"{p}_below"), F.count_if(F.col(value) <= F.col(p)).alias(f"{p}_upto")]
    ranks = rows.join(found, by).groupBy(*by).agg(*counts)
    n = F.col("n_values")
    near = [
        ((F.col(f"p{round(q * 100)}_below") / n <= q + sketches.RANK_ERROR) & (F.col(f"p{round(q * 100)}_upto") / n >= q - sketches.RANK_ERROR))
        .alias(f"p{round(q * 100)}_near")
        for q in qs
    ]
    return ranks.select(*by, "n_values", *near)


@checks.add(
    "latency_quantile_sketch",
    sql(
        "requests",
        """SELECT CAST(floor(epoch_us(ts) / 86400000000.0) AS BIGINT) * 86400000 AS start_ms, service, count(*) AS n_values, form,
                  true AS p50_near, true AS p95_near, true AS p99_near
           FROM requests, (VALUES ('merged'), ('direct')) f(form) GROUP BY ALL""",
    ),
)
def latency_quantile_sketch(spark, sf):
    """Sketches per minute, stored, merged to hours and then to days, next to sketches of whole days: ranks against the data."""
    requests = load(spark, sf, "requests").select("ts", "service", "latency_ms")
    path = scratch_path(spark, "minute-sketches")
    sketches.quantile_sketches(requests, "ts", "latency_ms", "1 minute", ["service"]).write.parquet(path)
    hours = sketches.merge_quantiles(spark.read.parquet(path), "1 hour", ["service"])
    days = {
        "merged": sketches.merge_quantiles(hours, "1 day", ["service"]),
        "direct": sketches.quantile_sketches(requests, "ts", "latency_ms", "1 day", ["service"]),
    }
    rows = requests.withColumn("start", F.window("ts", "1 day").start)
    parts = []
    for form, sketched in days.items():
        found = sketches.read_quantiles(sketched, tm.QUANTILES).drop("n")
        near = rank_is_near(rows, found, ["start", "service"], "latency_ms", tm.QUANTILES)
        parts.append(near.withColumn("start_ms", fr.epoch_ms("start")).drop("start").withColumn("form", F.lit(form)))
    return parts[0].unionByName(parts[1])


@checks.add(
    "count_distinct_sketch",
    sql(
        "reviews",
        """SELECT category, count(DISTINCT user_id) AS exact, true AS near FROM reviews GROUP BY category""",
    ),
)
def count_distinct_sketch(spark, sf):
    """Users per category: one sketch per category and day, stored, the union of all days against the exact count."""
    rows = load(spark, sf, "reviews").withColumn("day", F.floor(F.col("timestamp") / 86_400_000))
    path = scratch_path(spark, "day-sketches")
    sketches.distinct_sketches(rows, ["category", "day"], "user_id").write.parquet(path)
    found = sketches.estimate(sketches.unite(spark.read.parquet(path), ["category"]))
    exact = rows.groupBy("category").agg(F.count_distinct("user_id").alias("exact"))
    near = F.abs(F.col("n_distinct") - F.col("exact")) <= sketches.DISTINCT_ERROR * F.col("exact")
    return exact.join(found, "category").select("category", "exact", near.alias("near"))


@checks.add(
    "distinct_in_both_weeks",
    """WITH u AS (SELECT DISTINCT event_type, user_id, CAST(date_part('day', ts) - 1 AS BIGINT) // 7 AS week FROM events),
            a AS (SELECT event_type, user_id FROM u WHERE week = 0), b AS (SELECT event_type, user_id FROM u WHERE week = 1)
       SELECT event_type, (SELECT count(DISTINCT user_id) FROM u x WHERE x.event_type = t.event_type AND week < 2) AS in_either,
              (SELECT count(*) FROM a JOIN b USING (event_type, user_id) WHERE event_type = t.event_type) AS in_both
       FROM (SELECT DISTINCT event_type FROM u WHERE week < 2) t""",
)
def distinct_in_both_weeks(spark, sf):
    """Users per event type, sketched per day, united per week, then intersected; few enough to be counted exactly."""
    events = load(spark, sf, "events").withColumn("day", F.dayofmonth("ts") - 1).filter("day < 14")
    path = scratch_path(spark, "day-sets")
    sketches.distinct_sketches(events, ["event_type", "day"], "user_id", sets=True).write.parquet(path)
    weeks = sketches.unite(spark.read.parquet(path), ["event_type", F.floor(F.col("day") / 7).alias("week")], sets=True)
    either = sketches.estimate(sketches.unite(weeks, ["event_type"], sets=True), "in_either", sets=True)
    both = sketches.estimate(sketches.intersect(weeks, ["event_type"]), "in_both", sets=True)
    twice = weeks.groupBy("event_type").agg(F.count("*").alias("n"))
    found = either.join(both, "event_type").join(twice, "event_type")
    return found.select("event_type", "in_either", F.when(F.col("n") == 2, F.col("in_both")).otherwise(F.lit(0)).cast("long").alias("in_both"))
