"""Queue selection, store rows, decisions, counters and freshness."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from beaconry.operators.scan import mark_newest, number_rows, running_sums
from beaconry.session import cut_lineage, small_side

# The collector's word for an item and the store's word for it.
STORE_STATUS = {"queued": "queued", "deferred": "pending", "off-topic": "scored"}
PUBLISH_ORDER = {"queued": 0, "pending": 1, "scored": 2}
WRITES_PER_ROW = 3
STORE_COLUMNS = (
    "collector_id", "content_hash", "fetched_at", "geo_json", "lang", "published_at", "raw_hash", "region",
    "simhash", "source_id", "text", "title", "triage_labels", "triage_score", "triage_status", "url",
)
BATCH_SCHEMA, POINTER_SCHEMA = "batch/1", "batch-pointer/1"
#: A UTC day and the id of a run.
BATCH_ID = re.compile(r"\d{4}-\d{2}-\d{2}-[0-9a-z]{1,32}")


def _mapped(column: str, values: dict) -> Column:
    return F.create_map(*[F.lit(v) for pair in values.items() for v in pair])[F.col(column)]


def age_window(items: DataFrame, now: Column, days: int) -> DataFrame:
    """Drops items published more than ``days`` ago; no date stays, 0 days switches the rule off."""
    if days <= 0:
        return items
    return items.where(F.col("published").isNull() | (F.col("published") >= now - F.make_dt_interval(F.lit(days))))


def grade_gate(items: DataFrame, feeds: DataFrame, floor: str) -> DataFrame:
    """Source grades below the floor are not queued, the floor itself is flagged, no grade passes."""
    graded = items.join(small_side(feeds.select("feed", "grade")), "feed", "left")
    passes = F.col("grade").isNull() | (F.col("grade") <= floor)
    return graded.where(passes).withColumn("low_grade", F.coalesce(F.col("grade") == floor, F.lit(False)))


def feed_gate(items: DataFrame, feeds: DataFrame, mode: str, selected: list[str] | None = None) -> DataFrame:
    """Items of the feeds open in this mode. Explicit selection overrides the gate in queue mode only."""
    gate = F.col("queue") if mode == "queue" else F.col("enabled")
    if selected:
        chosen = F.col("feed").isin(*selected)
        gate = chosen if mode == "queue" else chosen & gate
    return items.join(small_side(feeds.where(gate).select("feed")), "feed", "left_semi")


def select_newest(items: DataFrame, limit: int, key: str) -> DataFrame:
    """``status`` queued for the newest ``limit`` relevant items, deferred for the rest, off-topic otherwise.

    The items are read twice (once for the order, once to be marked), so they are checkpointed: pass
    slim rows, without the texts they were scored on.
    """
    items = cut_lineage(items)
    when = F.coalesce("published", "fetched_at")
    order = [F.col("relevant").desc(), when.desc(), F.col("feed").desc(), F.col("queue_id").desc()]
    marked = mark_newest(items, order, key, limit, "_top")
    status = F.when(~F.col("relevant"), "off-topic").when(F.col("_top"), "queued").otherwise("deferred")
    return marked.withColumn("status", status).drop("_top")


def run_stats(items: DataFrame, group: str) -> DataFrame:
    """Accounting per ``group``: one row per item or per folded set of copies (``copies``), ``stage``
    names what happened to the first of them."""
    stages = ("invalid", "dropped", "stale", "known", "off-topic", "queued", "deferred")
    counted = [F.count_if(F.col("stage") == s).alias(s.replace("-", "_")) for s in stages]
    return items.groupBy(group).agg(F.sum("copies").alias("items"), F.sum(F.col("copies") - 1).alias("duplicates"), *counted)


def signal_rows(candidates: DataFrame) -> DataFrame:
    """Candidates to the sixteen store columns; labels and geo are JSON with sorted keys."""
    labels = F.to_json(
        F.struct(
            "borderline", F.col("status").alias("collector_status"), "feed", "queue_id",
            F.col("flagged").alias("redline_check"), "threshold", "topics",
        )
    )
    precise = F.col("place").isNotNull() | F.col("lat").isNotNull() | F.col("lon").isNotNull()
    geo = F.to_json(F.struct("lat", "lon", "place", "precision", "region"), {"ignoreNullFields": "false"})

    def text_or_null(c: str) -> Column:
        return F.when(F.col(c) != "", F.col(c)).alias(c)

    def stamp(c: str) -> Column:
        return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias(c)

    return candidates.select(
        F.col("content_key").alias("content_hash"), "simhash", "raw_hash", "source_id", F.col("feed").alias("collector_id"), "url",
        text_or_null("lang"), text_or_null("title"), text_or_null("text"), "region", F.when(precise, geo).alias("geo_json"),
        stamp("published_at"), stamp("fetched_at"), _mapped("status", STORE_STATUS).alias("triage_status"),
        F.col("score").alias("triage_score"), labels.alias("triage_labels"),
    )


def promote(stored: DataFrame) -> DataFrame:
    """Review keys of the stored rows that are queued; nothing else is offered to a person."""
    return stored.where("triage_status = 'queued'").select("content_hash")


def _publish_place() -> Column:
    """Rows of an unknown status come last."""
    return F.coalesce(_mapped("triage_status", PUBLISH_ORDER), F.lit(len(PUBLISH_ORDER)))


def publish_rows(rows: DataFrame, order: str, limit: int) -> DataFrame:
    """At most ``limit`` rows, queued first, then pending, then scored, each in arrival order."""
    return rows.orderBy(_publish_place(), F.col(order)).limit(limit)


def _document(fields: list[Column]) -> Column:
    """JSON with the fields in the order given, missing ones as null, without blanks and with a line end: the bytes of a file."""
    return F.concat(F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}), F.lit("\n"))


def publish_batch(rows: DataFrame, order: str, limit: int, batch_id: str, created_at: str, run_url: str | None = None) -> DataFrame:
    """One row: the batch that is published and the pointer a reader fetches first, also when there are no rows.

    ``body`` is the batch file: the rows of ``publish_rows`` in their order, a signature as 16 hex digits, with their counts and the
    number of rows left out, of which it holds nothing else. Keys are in order, so equal rows give equal bytes. ``pointer`` is the pointer
    file: it names the batch file and has the SHA-256 of its bytes and the number of its rows. At most ``limit`` rows come together.
    """
    if limit < 1:
        raise ValueError("a published batch holds at least one row")
    if not BATCH_ID.fullmatch(batch_id):
        raise ValueError(f"a batch id is a day and the id of a run, not {batch_id!r}")
    if run_url is not None and not run_url.startswith("https://"):
        raise ValueError("the url of a run is an https url")
    if sorted(rows.columns) != list(STORE_COLUMNS):
        raise ValueError(f"a published row has exactly the {len(STORE_COLUMNS)} store columns")
    sent = [F.lower(F.lpad(F.hex(c), 16, "0")).alias(c) if c == "simhash" else F.col(c) for c in STORE_COLUMNS]
    chosen = publish_rows(rows, order, limit).select(_publish_place().alias("place"), F.col(order).alias("order"), F.struct(*sent).alias("row"))
    listed = chosen.agg(F.array_sort(F.collect_list(F.struct("place", "order", "row"))).alias("listed"))
    batch = listed.select(F.transform("listed", lambda r: r["row"]).alias("listed")).join(F.broadcast(rows.agg(F.count(F.lit(1)).alias("all"))))  # one-row sides
    statuses = F.array_sort(F.array_distinct("listed.triage_status"))
    numbers = F.transform(statuses, lambda s: F.size(F.filter("listed", lambda r: r["triage_status"] == s)))
    counted = batch.select(
        "listed", F.size("listed").cast("bigint").alias("rows"), F.size(F.filter("listed", lambda r: r["triage_status"] == "queued")).cast("bigint").alias("reviews"),
        (F.col("all") - F.size("listed")).alias("truncated"), F.map_from_arrays(statuses, numbers).alias("by_triage_status"),
    )
    named, at = F.lit(batch_id).alias("batch_id"), F.lit(created_at).alias("created_at")
    counts = F.struct("by_triage_status", "reviews", "rows", "truncated").alias("counts")
    url = F.lit(run_url).cast("string").alias("run_url")
    body = _document([named, counts, at, F.col("listed").alias("rows"), url, F.lit(BATCH_SCHEMA).alias("schema")])
    file = F.lit(f"{batch_id}.json").alias("file")
    written = counted.select("rows", "reviews", "truncated", body.alias("body")).withColumn("sha256", F.sha2("body", 256))
    pointer = _document([named, at, file, F.col("rows"), F.lit(POINTER_SCHEMA).alias("schema"), F.col("sha256")])
    return written.select(named, file, "sha256", "rows", "reviews", "truncated", "body", pointer.alias("pointer"))


def batch_counts(rows: DataFrame, limit: int) -> DataFrame:
    """One row: published, left out, reviews, per status, estimated writes of the published batch."""
    status = F.col("triage_status")
    per = rows.agg(*[F.count_if(status == s).alias(s) for s in PUBLISH_ORDER])
    left, columns = F.lit(limit), []
    for name in PUBLISH_ORDER:
        columns.append(F.least(F.col(name), F.greatest(left, F.lit(0))).alias(name))
        left = left - F.col(name)
    total = sum((F.col(n) for n in PUBLISH_ORDER), F.lit(0))
    published = F.least(total, F.lit(limit))
    return per.select(
        published.alias("rows"), (total - published).alias("truncated"), *columns, columns[0].alias("reviews"),
        ((published + F.least(F.col("queued"), F.lit(limit))) * WRITES_PER_ROW).alias("estimated_writes"),
    )


def queue_join(reviews: DataFrame, signals: DataFrame) -> DataFrame:
    """Queue items with their signal; an item whose signal is missing stays."""
    return reviews.join(signals, "content_hash", "left")


def queue_counts(reviews: DataFrame) -> DataFrame:
    counts = reviews.groupBy("status").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("waiting", F.col("status") == "queued")


def queue_page(reviews: DataFrame, after: tuple[str, int] | None, limit: int) -> DataFrame:
    """The next oldest queued reviews after the keyset cursor (created_at, id)."""
    page = reviews.where("status = 'queued'")
    if after is not None:
        at, last = F.lit(after[0]).cast("timestamp"), F.lit(after[1])
        page = page.where((F.col("created_at") > at) | ((F.col("created_at") == at) & (F.col("id") > last)))
    return page.orderBy("created_at", "id").limit(limit)


def batch_no(rows: DataFrame, target: str, order: list[str], size: int) -> DataFrame:
    numbered = number_rows(rows, [F.col(c) for c in order], [target], "_n")
    return numbered.withColumn("batch", F.floor((F.col("_n") - 1) / size)).drop("_n")


def decisions(reviews: DataFrame, actions: DataFrame) -> DataFrame:
    """Final state per review: the first decision wins; skips before it only leave their last note."""
    chosen = F.col("action").isin("drafted", "dismissed")
    first = actions.where(chosen).groupBy("review_id").agg(F.min(F.struct("ts", "action", "reviewer", "note")).alias("d"))
    skips = actions.where("action = 'skip'").join(first.select("review_id", F.col("d.ts").alias("_until")), "review_id", "left")
    before = skips.where(F.col("_until").isNull() | (F.col("ts") < F.col("_until")))
    last = before.groupBy("review_id").agg(F.max_by(F.concat(F.lit("skipped by reviewer "), F.col("reviewer").cast("string")), "ts").alias("skip_note"))
    joined = reviews.select("review_id").join(first, "review_id", "left").join(last, "review_id", "left")
    return joined.select(
        "review_id", F.coalesce("d.action", F.lit("queued")).alias("status"), F.col("d.reviewer").alias("decided_by"),
        F.col("d.ts").alias("decided_at"), F.coalesce("d.note", "skip_note").alias("note"),
    )


def rate_limit(posts: DataFrame, per_hour: int, per_day: int) -> DataFrame:
    """Earlier posts per channel in the last hour (strictly less, by the second) and on the same UTC day.

    Posts are first counted per (channel, second); windows then run inside (channel, hour) with the
    hour before as context, so a window holds at most 7200 rows however hot the channel is.
    """
    second = F.unix_seconds(F.col("ts"))
    tagged = posts.withColumn("_s", second)
    per_second = tagged.groupBy("channel", "_s").agg(F.count(F.lit(1)).alias("_c"))
    hour = F.floor(F.col("_s") / 3600)
    doubled = per_second.withColumn("_h", F.explode(F.array(hour, hour + 1)))
    last_hour = W.partitionBy("channel", "_h").orderBy("_s").rangeBetween(-3599, 0)
    hourly = doubled.withColumn("hour_n", F.sum("_c").over(last_hour)).where(F.col("_h") == hour)
    day = F.floor(F.col("_s") / 86400)
    day_so_far = W.partitionBy("channel", "_d").orderBy("_s").rangeBetween(W.unboundedPreceding, 0)
    counted = hourly.withColumn("_d", day).withColumn("day_n", F.sum("_c").over(day_so_far)).select("channel", "_s", "hour_n", "day_n")
    out = tagged.join(counted, ["channel", "_s"]).drop("_s")
    out = out.withColumn("hour_n", F.col("hour_n") - 1).withColumn("day_n", F.col("day_n") - 1)
    reason = F.when(F.col("hour_n") >= per_hour, "hour").when(F.col("day_n") >= per_day, "day")
    return out.withColumn("held_by", reason)


def failure_streak(runs: DataFrame, bucket_seconds: int = 3600) -> DataFrame:
    """Consecutive failures up to and including every run of (job, ts, run_id, ok).

    ``group`` numbers the stretches between successes; a second running sum counts inside them. Both
    sums are bucketed by time, so one busy job spreads over many tasks.
    """
    bucket = F.floor(F.unix_seconds(F.col("ts")) / bucket_seconds)
    ordered = running_sums(runs, ["job"], ["ts", "run_id"], bucket, {"_group": F.col("ok").cast("int")})
    failed = running_sums(ordered, ["job", "_group"], ["ts", "run_id"], bucket, {"streak": (~F.col("ok")).cast("int")})
    return failed.drop("_group")


def freshness(rules: DataFrame, runs: DataFrame, now: Column) -> DataFrame:
    """Age of the last success against cadence plus grace; without a readable time the state is unknown."""
    last = runs.groupBy("job").agg(F.max(F.when(F.col("ok"), F.col("ts"))).alias("last_ok"), F.max_by("ok", F.struct("ts", "run_id")).alias("latest_ok"))
    age = F.floor((F.unix_seconds(now) - F.unix_seconds("last_ok")) / 86400)
    state = (
        F.when(F.col("latest_ok").isNull(), "never ran")
        .when(age.isNull(), "?")
        .when(~F.col("latest_ok"), "failed")
        .when(age > F.col("every_days") + F.col("grace_days"), "late")
        .otherwise("ok")
    )
    return rules.join(last, "job", "left").select("job", age.alias("age_days"), state.alias("state"))


def usage_vs_limit(usage: DataFrame) -> DataFrame:
    """Daily units per service against the limit; no limit means neither remaining nor over."""
    daily = usage.groupBy("day", "service").agg(F.sum("units").alias("units"), F.max("daily_limit").alias("daily_limit"))
    return daily.withColumn("remaining", F.col("daily_limit") - F.col("units")).withColumn("over", F.col("units") > F.col("daily_limit"))
