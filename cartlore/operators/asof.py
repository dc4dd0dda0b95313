"""Point-in-time joins: for every spine row the newest feature row not after it."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import fine_tasks, shuffle_partitions, stored

TS, KIND, ROW, BUCKET, SALT, KEY = "_ts", "_kind", "_row", "_bucket", "_salt", "_key"
FEATURE, SPINE = 0, 1  # a feature row sorts before a spine row of the same time
LEAST_HOT_ROWS = 100_000  # fewer rows of a key are always one task's work
NULL_KEY_SALTS = 1_024
TASK_ROWS = 500_000  # rows of both sides that a task sorts, some more or fewer


@dataclass(frozen=True)
class AsOfView:
    """One feature table to join.

    ``columns`` maps feature column to output column. A ``ttl_seconds`` turns
    values older than that, seen from the spine row, into NULL. ``is_table``
    says that ``df`` reads a table; anything else is computed and stored first.
    """

    name: str
    df: DataFrame
    keys: tuple[str, ...]
    ts: str
    columns: dict[str, str]
    ttl_seconds: int | None = None
    is_table: bool = False

    @property
    def payload(self) -> str:
        return f"_payload_{self.name}"

    def events(self) -> DataFrame:
        """Feature rows in the common event shape; rows that cannot match are left out."""
        usable = self.df.dropna(subset=[*self.keys, self.ts])
        values = [F.col(c).alias(out) for c, out in self.columns.items()]
        payload = F.struct(F.col(self.ts).cast("timestamp").alias("_at"), *values)
        return usable.select(*self.keys, F.col(self.ts).cast("timestamp").alias(TS), payload.alias(self.payload))


def _union_events(spine: DataFrame, views: list[AsOfView], keys: list[str]) -> DataFrame:
    """Spine and feature rows below each other, told apart by their kind."""
    events = spine.withColumn(KIND, F.lit(SPINE))
    for view in views:
        rows = view.events().withColumn(KIND, F.lit(FEATURE))
        events = events.unionByName(rows, allowMissingColumns=True)
    # rows without a key can match nothing, so they need not meet in one task
    missing = F.greatest(*[F.col(k).isNull() for k in keys], F.lit(False))
    salt = F.when(missing, F.pmod(F.xxhash64(TS, ROW), F.lit(NULL_KEY_SALTS)) if ROW in spine.columns else F.lit(0))
    return events.withColumn(SALT, F.coalesce(salt, F.lit(0)))


def _carry_forward(events: DataFrame, views: list[AsOfView], group: list[str]) -> DataFrame:
    """Newest payload of each view up to and including every row of its group."""
    order = [F.col(TS), F.col(KIND), *[F.col(v.payload) for v in views]]
    so_far = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    filled = {v.payload: F.last(v.payload, ignorenulls=True).over(so_far) for v in views}
    return events.withColumns(filled).filter(F.col(KIND) == SPINE)


def _outputs(view: AsOfView, ts: Column) -> list[Column]:
    fresh = F.lit(True)
    if view.ttl_seconds is not None:
        oldest = ts - F.make_dt_interval(secs=F.lit(view.ttl_seconds))
        fresh = F.col(f"{view.payload}._at") >= oldest
    return [F.when(fresh, F.col(f"{view.payload}.{out}")).alias(out) for out in view.columns.values()]


def _join_same_key(spine: DataFrame, ts: str, views: list[AsOfView], keys: list[str], tasks: int = 0) -> DataFrame:
    """All views of one entity in a single shuffle: union, sort within key, carry forward. ``tasks`` asks for more tasks than usual."""
    packed = spine.select(*keys, F.col(ts).cast("timestamp").alias(TS), F.struct(*spine.columns).alias(ROW))
    events = _union_events(packed, views, keys)
    if tasks > shuffle_partitions(spine.sparkSession):
        events = events.repartition(tasks, *keys, SALT)
    joined = _carry_forward(events, views, [*keys, SALT])
    values = [c for v in views for c in _outputs(v, F.col(TS))]
    return joined.select(f"{ROW}.*", *values)


def _key_hash(keys: list[str]) -> Column:
    """One number per key; rows without a key have none. Equal numbers of different keys do no harm."""
    missing = F.greatest(*[F.col(k).isNull() for k in keys], F.lit(False))
    return F.when(~missing, F.xxhash64(*keys))


def _hot_keys(spine: DataFrame, groups: list[list[AsOfView]], hot_rows: int | None) -> list[list[int]]:
    """Per group of views, the hashes of keys with more rows than one task should sort.

    One map-side combined count over the key columns of the spine and all views. Without ``hot_rows`` a key is hot
    above an even share, all rows over the number of tasks, so there are never more hot keys than tasks.
    """

    def tagged(df: DataFrame, numbers: list[int]) -> DataFrame:
        pairs = [F.struct(F.lit(g).alias("g"), _key_hash(list(groups[g][0].keys)).alias(KEY)) for g in numbers]
        return df.select(F.explode(F.array(*pairs)).alias("p")).select("p.g", f"p.{KEY}")

    rows = tagged(spine, list(range(len(groups))))
    for number, group in enumerate(groups):
        for view in group:
            rows = rows.unionByName(tagged(view.df, [number]))
    counts = stored(rows.dropna().groupBy("g", KEY).count(), "key-counts")
    if hot_rows is None:
        total = counts.agg(F.sum("count")).first()[0] or 0
        hot_rows = max(LEAST_HOT_ROWS, total // shuffle_partitions(spine.sparkSession))
    found = counts.filter(F.col("count") > hot_rows).collect()
    return [[r[KEY] for r in found if r.g == number] for number in range(len(groups))]


def _time_buckets(events: DataFrame, buckets: int) -> DataFrame:
    """Number the time ranges that hold about equally many rows each."""
    seconds = events.withColumn("_at", F.col(TS).cast("double"))
    share = 1.0 / buckets
    cuts = seconds.approxQuantile("_at", [share * i for i in range(1, buckets)], min(0.01, share / 4))
    splits = [float("-inf"), *sorted(set(cuts)), float("inf")]
    bucketizer = Bucketizer(splits=splits, inputCol="_at", outputCol=BUCKET)
    return bucketizer.transform(seconds).withColumn(BUCKET, F.col(BUCKET).cast("int")).drop("_at")


def _join_hot(spine: DataFrame, ts: str, views: list[AsOfView], keys: list[str], buckets: int) -> DataFrame:
    """The same join for keys too large for one task.

    A lookup depends on key and time only, so equal points are looked up once.
    Points and feature rows are cut into time ranges; within a range the newest
    row is carried forward as usual, and each range starts with the newest row
    of the earlier ones (one summary row per key and range). The points go back
    to the spine by an equi-join, whose skew adaptive execution can split.
    """
    points = spine.select(*keys, F.col(ts).cast("timestamp").alias(TS)).dropna().distinct()
    events = _time_buckets(_union_events(points, views, keys), buckets)
    group = [*keys, BUCKET]
    newest = [
        F.max_by(v.payload, F.when(F.col(v.payload).isNotNull(), F.struct(F.col(TS), F.col(v.payload)))).alias(v.payload)
        for v in views
    ]
    earlier = Window.partitionBy(*keys).orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    carried = events.groupBy(*group).agg(*newest).select(
        *group, *[F.last(v.payload, ignorenulls=True).over(earlier).alias(f"{v.payload}_before") for v in views]
    )
    within = _carry_forward(events, views, group).join(carried, group)
    found = within.withColumns({v.payload: F.coalesce(v.payload, f"{v.payload}_before") for v in views})
    values = [c for v in views for c in _outputs(v, F.col(TS))]
    return (
        spine.withColumn(TS, F.col(ts).cast("timestamp"))
        .join(found.select(*keys, TS, *values), [*keys, TS], "left")
        .select(*spine.columns, *[out for v in views for out in v.columns.values()])
    )


def asof_join(
    spine: DataFrame,
    views: list[AsOfView],
    ts: str = "event_timestamp",
    hot_rows: int | None = None,
    time_buckets: int | None = None,
    count_keys: bool = True,
) -> DataFrame:
    """Left as-of join of the spine with several feature tables.

    The number of spine rows never changes; rows without a match get NULLs.
    Views of the same entity share one shuffle. Of several feature rows with
    equal key and time the one with the largest values is taken. Keys with more
    than ``hot_rows`` rows (by default an even share of all) are joined by time ranges; without ``count_keys`` no key is,
    for inputs known to have none. Counting and joining both read the inputs, so what is not a table is stored first.
    """
    buckets = time_buckets or shuffle_partitions(spine.sparkSession)
    if count_keys:
        with fine_tasks(spine.sparkSession):
            spine = stored(spine, "spine")
            views = [v if v.is_table else replace(v, df=stored(v.df.select(*v.keys, v.ts, *v.columns), "view"), is_table=True) for v in views]
    by_keys: dict[tuple[str, ...], list[AsOfView]] = {}
    for view in views:
        by_keys.setdefault(view.keys, []).append(view)
    groups = list(by_keys.values())
    hot_keys = _hot_keys(spine, groups, hot_rows) if count_keys else [[] for _ in groups]
    # stored tables are counted by their file footers; a join keeps the number of spine rows
    n_spine = spine.count() if count_keys else 0
    for group, hot in zip(groups, hot_keys):
        tasks = (n_spine + sum(v.df.count() for v in group)) // TASK_ROWS if count_keys else 0
        spine = _join_group(spine, ts, group, hot, buckets, tasks)
    return spine


def _join_group(spine: DataFrame, ts: str, views: list[AsOfView], hot: list[int], buckets: int, tasks: int = 0) -> DataFrame:
    """Join the views of one entity: hot keys by time ranges, all others in one pass."""
    keys = list(views[0].keys)
    if not hot:
        return _join_same_key(spine, ts, views, keys, tasks)
    hashes = F.broadcast(spine.sparkSession.createDataFrame([(h,) for h in hot], f"{KEY} long"))  # no more than tasks

    def part(df: DataFrame, how: str) -> DataFrame:
        return df.withColumn(KEY, _key_hash(keys)).join(hashes, KEY, how).drop(KEY)

    def views_of(how: str) -> list[AsOfView]:
        return [replace(v, df=part(v.df, how)) for v in views]

    cold = _join_same_key(part(spine, "left_anti"), ts, views_of("left_anti"), keys, tasks)
    heavy = _join_hot(part(spine, "left_semi"), ts, views_of("left_semi"), keys, buckets)
    return cold.unionByName(heavy)


def interval_join(
    left: DataFrame,
    right: DataFrame,
    keys: list[str],
    left_ts: str,
    right_ts: str,
    lower_seconds: int,
    upper_seconds: int,
) -> DataFrame:
    """All pairs with equal keys and ``left + lower <= right <= left + upper``.

    Time is cut into ranges as long as the interval; a left row visits the two
    ranges its interval can touch, so the join runs on (key, range) and one
    key's history is spread over many tasks.
    """
    width = max(upper_seconds - lower_seconds, 1)
    slot = "_slot"

    def micros(name: str) -> Column:
        return F.unix_micros(F.col(name).cast("timestamp"))

    def range_of(us: Column) -> Column:
        return F.floor(us / F.lit(width * 1_000_000)).cast("long")

    start = micros(left_ts) + lower_seconds * 1_000_000
    end = micros(left_ts) + upper_seconds * 1_000_000
    visits = left.withColumn(slot, F.explode(F.sequence(range_of(start), range_of(end))))
    placed = right.withColumn(slot, range_of(micros(right_ts)))
    joined = visits.join(placed, [*keys, slot])
    gap = micros(right_ts) - micros(left_ts)
    return joined.filter(gap.between(lower_seconds * 1_000_000, upper_seconds * 1_000_000)).drop(slot)
