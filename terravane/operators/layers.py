"""Layer catalogues, storage, fetch and response logs, presets and soil."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terravane.functions import classify, geo
from terravane.operators import scan
from terravane.operators.store import kept

# Fixed values of the back-off and of the log limits.
BACKOFF_BASE_MS, BACKOFF_MOST_MS = 2_000, 300_000
KEPT_FAILURES = 50
RAIN_DAYS_S = 259_200
STRIP_HEIGHT, STRIP_WIDTH = 4_100, 15_000


def layer_states(catalogue: DataFrame, preferences: DataFrame, available: DataFrame, calibrations: DataFrame) -> DataFrame:
    """Catalogue (layer_id, title, kind, ord) with what is known of each layer, else defaults, in the user's order, else the catalogue's."""
    active = calibrations.where("active").select("layer_id").distinct().withColumn("calibrated", F.lit(True))
    joined = catalogue.join(preferences, "layer_id", "left").join(available, "layer_id", "left").join(active, "layer_id", "left")
    flag = lambda c, default: F.coalesce(c, F.lit(default)).alias(c)
    return joined.select("layer_id", "title", "kind", flag("visible", False), flag("opacity", 1.0), flag("available", False), flag("calibrated", False), F.coalesce("user_ord", "ord").alias("position")).orderBy("position", "layer_id")


def usable_overlays(states: DataFrame) -> DataFrame:
    return states.where(F.col("visible") & F.col("available") & classify.is_raster(F.col("kind")))


def layer_titles(finds: DataFrame, live: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Finds with the title of their layer: the live one, else the catalogue's, else its id."""
    a = live.select(F.col("layer_id").alias("layer_context_id"), F.col("title").alias("live_title"))
    b = catalogue.select(F.col("layer_id").alias("layer_context_id"), F.col("title").alias("known_title"))
    joined = finds.join(a, "layer_context_id", "left").join(b, "layer_context_id", "left")
    return joined.withColumn("layer_title", F.coalesce("live_title", "known_title", "layer_context_id")).drop("live_title", "known_title")


def storage(catalogue: DataFrame, caches: DataFrame, archives: DataFrame) -> DataFrame:
    """(layer_id, cache_bytes, archive_bytes, orphan): all layers and the caches of layers that are no longer known, largest first."""
    c = caches.groupBy("layer_id").agg(F.sum("bytes").alias("cache_bytes"))
    a = archives.groupBy("layer_id").agg(F.sum("bytes").alias("archive_bytes"))
    zero = lambda n: F.coalesce(n, F.lit(0)).alias(n)
    known = catalogue.select("layer_id").join(c, "layer_id", "left").join(a, "layer_id", "left").select("layer_id", zero("cache_bytes"), zero("archive_bytes"), F.lit(False).alias("orphan"))
    orphans = c.join(catalogue.select("layer_id"), "layer_id", "left_anti").select("layer_id", "cache_bytes", F.lit(0).cast("long").alias("archive_bytes"), F.lit(True).alias("orphan"))
    return known.unionByName(orphans).orderBy(F.desc(F.col("cache_bytes") + F.col("archive_bytes")), "layer_id")


def merge_catalogue(current: DataFrame, current_version: int, defaults: DataFrame, default_version: int) -> DataFrame:
    """The catalogue with the defaults that it lacks, if they are of a newer version."""
    if default_version <= current_version:
        return current
    return current.unionByName(defaults.join(current.select("layer_id"), "layer_id", "left_anti"), allowMissingColumns=True)


def rank_presets(presets: DataFrame, terrain: str | None, soil: str | None) -> DataFrame:
    """Presets by how well they fit, the best first; equal ones stay in the order of ``position``."""
    wanted = F.lit(terrain).cast("string"), F.lit(soil).cast("string")
    scored = presets.withColumn("score", classify.preset_score(F.col("terrain"), F.col("soil"), *wanted)).withColumn("reason", classify.preset_reason(F.col("terrain"), F.col("soil"), *wanted))
    return scored.orderBy(F.desc("score"), "position")


def soil_readings(hours: DataFrame, now_s: int) -> DataFrame:
    """(place, moisture, rain_mm, soil) of hourly rows (place, time, moisture, rain): the last known moisture up to now, and three days' rain; places without either are left out."""
    past = hours.where(F.col("time") <= now_s)
    rain = F.when(F.max(F.col("rain").isNotNull().cast("int")) == 1, F.coalesce(F.sum(F.when(F.col("time") >= now_s - RAIN_DAYS_S, F.col("rain"))), F.lit(0.0)))
    moisture = F.max_by("moisture", F.when(F.col("moisture").isNotNull(), F.col("time")))
    found = past.groupBy("place").agg(moisture.alias("moisture"), rain.alias("rain_mm")).where("moisture IS NOT NULL OR rain_mm IS NOT NULL")
    return found.withColumn("soil", classify.soil_estimate(F.col("moisture"), F.col("rain_mm")))


def running_soil(hours: DataFrame) -> DataFrame:
    """Hours with the last moisture known at each and the rain of the three days up to it.

    The rain of a place is summed up in spans of three days: a row is copied to its own span and to the next one, which may still need it.
    """
    known = scan.last_known(hours.select("place", "time", "moisture", "rain"), ["place"], ["time"], {"moisture": F.col("moisture")})
    span = F.floor(F.col("time") / RAIN_DAYS_S)
    spans = known.withColumn("copy", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("span", span + F.col("copy"))
    w = Window.partitionBy("place", "span").orderBy("time").rangeBetween(-RAIN_DAYS_S, 0)
    return spans.withColumn("rain_mm", F.coalesce(F.sum("rain").over(w), F.lit(0.0))).where("copy = 0").select("place", "time", "moisture", "rain_mm")


def effective_soil(chosen: Column, estimate: Column) -> Column:
    return F.coalesce(chosen, estimate)


def blocked_until(responses: DataFrame) -> DataFrame:
    """Responses (host, id, at_ms, status, retry_after_s) with the host's running streak of refusals and until when it is blocked.

    A streak is the refusals so far less those up to the last accepted response. A refusal is 429 or 503; its pause doubles from two seconds to five minutes,
    or is what the server asked for if that is longer, within the same bound.
    """
    refused = F.coalesce(F.col("status").isin(429, 503), F.lit(False))
    key, order = ["host"], ["at_ms", "id"]
    # refusals so far; at an answer that was accepted, those that no longer count
    led = scan.with_leads(scan.in_ranges(responses.withColumn("refusals", F.when(refused, 1).otherwise(0).cast("long")), key, order), key, order, sums=["refusals"])
    counted = scan.rows_only(led.withColumn("refusals", F.sum("refusals").over(scan.so_far(key, order))))
    counted = kept(counted.withColumn("settled", F.when(~refused, F.col("refusals"))), "refusals")
    settled = F.last("settled", ignorenulls=True).over(scan.so_far(key, order))
    out = scan.rows_only(scan.with_leads(counted, key, order, known=["settled"]).withColumn("settled", settled))
    out = out.withColumn("streak", F.col("refusals") - F.coalesce("settled", F.lit(0))).drop("refusals", "settled", "__range")
    ours = F.least(F.lit(BACKOFF_MOST_MS), F.lit(BACKOFF_BASE_MS) * F.pow(F.lit(2.0), F.least(F.col("streak") - 1, F.lit(20)))).cast("long")
    theirs = F.least(F.lit(BACKOFF_MOST_MS).cast("long"), F.coalesce("retry_after_s", F.lit(0)) * 1000)
    return out.withColumn("blocked_until", F.when(refused, F.col("at_ms") + F.greatest(ours, theirs)))


def daily_usage(log: DataFrame) -> DataFrame:
    """(day, tiles, bytes) of a log (at_ms, bytes), by UTC days."""
    return log.groupBy(F.floor(F.col("at_ms") / 86_400_000).alias("day")).agg(F.count("*").alias("tiles"), F.sum("bytes").alias("bytes"))


def outcomes(log: DataFrame) -> DataFrame:
    return log.groupBy("outcome").agg(F.count("*").alias("n"))


def first_failures(log: DataFrame, most: int = KEPT_FAILURES) -> DataFrame:
    """The first failures of each run, at most ``most``: a report, so the limit is its feature."""
    rank = F.row_number().over(Window.partitionBy("run").orderBy("at_ms", "id"))
    return log.where("outcome = 'failed'").withColumn("rank", rank).where(F.col("rank") <= most)


def endpoint_report(checks: DataFrame) -> DataFrame:
    """(status, n, fails): endpoint checks (priority, status) by status; ``fails`` where one of the first priority is not OK."""
    return checks.groupBy("status").agg(F.count("*").alias("n"), F.bool_or((F.col("priority") == "P1") & (F.col("status") != "OK")).alias("fails"))


def priority_sources(sources: DataFrame, also_unverified: bool = False) -> DataFrame:
    return sources.where((F.col("priority") == "P1") & (F.col("verified") | F.lit(also_unverified)))


def feed_items(items: DataFrame, pattern: str | None = None, box: dict | None = None) -> DataFrame:
    """Feed items (title, url, west, south, east, north) by a pattern in title and url, and by a box where they have one."""
    if pattern:
        items = items.where(F.concat_ws(" ", "title", "url").rlike("(?i)" + pattern))
    if box:
        hit = geo.boxes_intersect({k: F.col(k) for k in ("west", "south", "east", "north")}, {k: F.lit(v) for k, v in box.items()})
        items = items.where(F.col("west").isNull() | hit)
    return items


def reachable_feeds(links: DataFrame, root: str, depth: int = 2) -> DataFrame:
    """(url, depth) of the feeds that links (from_url, to_url) lead to in at most ``depth`` steps, each once. Each step's finds are stored before the next."""
    seen = links.sparkSession.createDataFrame([(root, 0)], "url string, depth int")
    edge = seen
    for k in range(1, depth + 1):
        step = links.hint("merge").join(edge.select(F.col("url").alias("from_url")).hint("merge"), "from_url").select(F.col("to_url").alias("url")).distinct()
        edge = kept(step.hint("merge").join(seen.hint("merge"), "url", "left_anti").withColumn("depth", F.lit(k)), "feeds")
        seen = seen.unionByName(edge)
    return seen


def sheets(catalogue: DataFrame, name: str) -> DataFrame:
    """Sheets by either of their names, without regard to case."""
    return catalogue.where((F.upper("name") == name.upper()) | (F.upper("other_name") == name.upper()))


def scans(catalogue: DataFrame, prefix: str) -> DataFrame:
    return catalogue.where(F.col("name").startswith(prefix)).orderBy("name")


def strips(scans: DataFrame, height: int = STRIP_HEIGHT, width: int = STRIP_WIDTH) -> DataFrame:
    """Scans (scan_id, width, height in pixels; west, south, east, north) cut from top to bottom; scans that are too wide are left out with ``error``."""
    n = F.ceil(F.col("height") / height).cast("int")
    each = scans.withColumn("error", F.when(F.col("width") > width, F.lit("TOO_WIDE"))).withColumn("strip", F.explode_outer(F.when(F.col("error").isNull() & (n > 0), F.sequence(F.lit(0), n - 1))))
    top = F.col("strip") * height
    bottom = F.least(top + height, F.col("height"))
    per_pixel = (F.col("north") - F.col("south")) / F.col("height")
    return each.select("scan_id", "strip", top.alias("top"), (bottom - top).alias("rows"), (F.col("north") - bottom * per_pixel).alias("strip_south"), (F.col("north") - top * per_pixel).alias("strip_north"), "error")


def scan_size(west: Column, south: Column, east: Column, north: Column, metres_per_pixel: float, most: int | None = None) -> Column:
    """struct(width, height) in pixels of a box in metres, shrunk to fit ``most``."""
    w, h = (east - west) / metres_per_pixel, (north - south) / metres_per_pixel
    shrink = F.least(F.lit(1.0), F.lit(float(most)) / F.greatest(w, h)) if most else F.lit(1.0)
    return F.struct(F.greatest(F.lit(1), F.round(w * shrink)).cast("int").alias("width"), F.greatest(F.lit(1), F.round(h * shrink)).cast("int").alias("height"))


def merged_layers(layers: dict[str, DataFrame]) -> DataFrame:
    """Several collections in one, each row with its layer's name."""
    out = None
    for name, df in layers.items():
        one = df.withColumn("layer", F.lit(name))
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out
