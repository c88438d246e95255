"""Filters, nested joins, sorts, statistics, merges and changes of the field log's tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terravane.functions import geo
from terravane.functions.classify import FIND_CATEGORIES, PLACE_TYPES, decode
from terravane.operators.blocks import BLOCK, in_blocks
from terravane.operators.order import numbered

DAY_MS = 86_400_000


def lookup(table: DataFrame, column: str, value) -> DataFrame:
    return table.where(F.col(column) == value)


def gallery(finds: DataFrame, categories: Sequence[str] = (), since: int | None = None, until: int | None = None, favorites: bool = False) -> DataFrame:
    """Finds by category (none named: all), inclusive time bounds and favourites, newest first."""
    if categories:
        finds = finds.where(F.col("category").isin(*categories))
    if since is not None:
        finds = finds.where(F.col("created_at") >= since)
    if until is not None:
        finds = finds.where(F.col("created_at") <= until)
    if favorites:
        finds = finds.where("favorite")
    return newest(finds)


def since_preset(preset: str, now_ms: int) -> Column:
    """Lower bound in epoch milliseconds: ``today`` (midnight of the session's zone), ``7d``, ``30d``; null for ``all``."""
    now = F.timestamp_millis(F.lit(now_ms))
    if preset == "today":
        return F.unix_millis(F.date_trunc("day", now))
    days = {"7d": 7, "30d": 30}.get(preset)
    return F.lit(now_ms - days * DAY_MS) if days else F.lit(None).cast("long")


def places_filter(places: DataFrame, types: Sequence[str] = (), unvisited: bool = False) -> DataFrame:
    if types:
        places = places.where(F.col("type").isin(*types))
    return newest(places.where(~F.col("visited")) if unvisited else places)


def viewport(table: DataFrame, west: float, south: float, east: float, north: float) -> DataFrame:
    return newest(table.where(F.col("lat").between(south, north) & F.col("lon").between(west, east)))


def active_track(tracks: DataFrame) -> DataFrame:
    return tracks.where("ended_at IS NULL").orderBy(F.desc("started_at"), F.desc("id")).limit(1)


def newest(table: DataFrame, column: str = "created_at") -> DataFrame:
    return table.orderBy(*newest_first(column))


# total orders, as lists of Columns for ``orderBy`` or ``order.numbered``


def newest_first(column: str = "created_at") -> list[Column]:
    return [F.desc(column), F.desc("id")]


def of_layers() -> list[Column]:
    """Calibrations: by layer, the newest first."""
    return [F.col("layer_id"), F.desc("updated_at"), F.col("id")]


def of_points(key: str, *then: str) -> list[Column]:
    """Points by their track or set, then as they were taken."""
    return [F.col(key), *map(F.col, then)]


def of_photos() -> list[Column]:
    """Photos by find, the primary one first, then the oldest."""
    return [F.col("find_id"), F.desc("is_primary"), F.col("created_at"), F.col("id"), F.col("uri")]


def of_places(how: str = "newest", lat: float | None = None, lon: float | None = None) -> list[Column]:
    """``nearest`` by whole millimetres, then id (without a position: newest), ``newest`` or ``type``."""
    if how == "nearest" and lat is not None and lon is not None:
        return [F.floor(geo.distance_m(F.lit(lat), F.lit(lon), F.col("lat"), F.col("lon")) * 1000.0 + 0.5), F.col("id")]
    by_type = F.array_position(F.array(*map(F.lit, PLACE_TYPES)), decode(F.col("type"), PLACE_TYPES, "ZAJIMAVOST"))
    return [by_type, *newest_first()] if how == "type" else newest_first()


def nested(parents: DataFrame, children: DataFrame, parent_key: str, child_key: str, order: Sequence[str], into: str, most: int = BLOCK) -> DataFrame:
    """Parents with an array of their children's structs, sorted by the columns ``order``; parents without any get an empty array.

    A parent of more than ``most`` children has several rows, with ``block`` from 0 on, whose arrays follow one another.
    """
    lists = in_blocks(children.withColumnRenamed(child_key, "__key"), "__key", order, into, most)
    joined = parents.hint("merge").join(lists.hint("merge"), F.col(parent_key) == F.col("__key"), "left").drop("__key")
    return joined.withColumns({"block": F.coalesce("block", F.lit(0)), into: F.coalesce(into, F.array().cast(lists.schema[into].dataType))})


def primary_photo(photos: DataFrame) -> DataFrame:
    """(find_id, uri): the first flagged photo, else the oldest."""
    order = F.struct((~F.col("is_primary")).cast("int"), "created_at", "id", "uri")
    return photos.groupBy("find_id").agg(F.min_by("uri", order).alias("uri"))


def detectors_in_order(detectors: DataFrame) -> DataFrame:
    return detectors.orderBy(F.desc("is_default"), "created_at", "id")


def find_stats(finds: DataFrame) -> DataFrame:
    return finds.agg(
        F.count("*").alias("total"),
        F.coalesce(F.sum(F.col("favorite").cast("long")), F.lit(0)).alias("favorites"),
        F.min("created_at").alias("first_at"),
        F.max("created_at").alias("last_at"),
        F.max("depth_cm").alias("deepest_cm"),
    )


def category_histogram(finds: DataFrame) -> DataFrame:
    """Counts by category, unknown names counted with the default one."""
    return finds.groupBy(decode(F.col("category"), FIND_CATEGORIES, "OSTATNI").alias("category")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "category")


def track_stats(tracks: DataFrame) -> DataFrame:
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return tracks.agg(F.count("*").alias("n"), zero("distance_m").alias("distance_m"), zero("duration_ms").alias("duration_ms"))


def area_totals(areas: DataFrame) -> DataFrame:
    done = F.when(F.col("status") == "HOTOVO", F.col("area_ha"))
    return areas.agg(F.coalesce(F.sum("area_ha"), F.lit(0.0)).alias("total_ha"), F.coalesce(F.sum(done), F.lit(0.0)).alias("done_ha"))


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    out = None
    for name, t in tables.items():
        one = t.agg(F.count("*").alias("n")).select(F.lit(name).alias("table"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def last_known(fixes: DataFrame) -> DataFrame:
    """The newest fix of each track, over all providers."""
    rest = [c for c in fixes.columns if c not in ("track_id", "ts")]
    return fixes.groupBy("track_id").agg(F.max(F.struct("ts", *rest)).alias("m")).select("track_id", "m.*")


def new_rows(incoming: DataFrame, existing: DataFrame, key: str = "external_id") -> DataFrame:
    return incoming.join(existing.select(key).distinct(), key, "left_anti")


def known_rows(incoming: DataFrame, existing: DataFrame, key: str = "external_id") -> DataFrame:
    return incoming.join(existing.select(key).distinct(), key, "left_semi")


def insert(table: DataFrame, rows: DataFrame, key: str = "id") -> DataFrame:
    """``table`` and ``rows``; a key that is there already, or twice in ``rows``, fails with a ValueError."""
    if not rows.join(table.select(key), key, "left_semi").isEmpty() or not rows.groupBy(key).count().where("count > 1").isEmpty():
        raise ValueError(f"{key} is taken")
    return table.unionByName(rows)


def update(table: DataFrame, changes: DataFrame, key: str = "id") -> DataFrame:
    """``table`` with the columns of ``changes`` where it has a row for the key; nulls there change nothing."""
    new = {c: F.coalesce(F.col(f"__{c}"), F.col(c)) for c in changes.columns if c != key}
    renamed = changes.select(F.col(key), *[F.col(c).alias(f"__{c}") for c in new])
    return table.join(renamed, key, "left").select(*[new.get(c, F.col(c)).alias(c) for c in table.columns])


def delete(table: DataFrame, keys: DataFrame, key: str = "id") -> DataFrame:
    return table.join(keys.select(key).distinct(), key, "left_anti")


def cascade(children: DataFrame, deleted: DataFrame, child_key: str, key: str = "id") -> DataFrame:
    """Children whose parent is not among ``deleted``."""
    return children.join(deleted.select(F.col(key).alias(child_key)).distinct(), child_key, "left_anti")


def one_default(detectors: DataFrame, default_id: int | None = None) -> DataFrame:
    """Exactly one default: the named one, else the flagged one, else the oldest."""
    wanted = F.col("id") == default_id if default_id is not None else F.lit(False)
    order = F.struct((~wanted).cast("int"), (~F.col("is_default")).cast("int"), "created_at", "id")
    chosen = detectors.agg(F.min_by("id", order).alias("chosen")).first()["chosen"]
    return detectors.withColumn("is_default", F.col("id") == F.lit(chosen))


def one_primary(photos: DataFrame) -> DataFrame:
    """At most one primary photo for each find: the flagged one that comes first, else the oldest."""
    first = F.row_number().over(Window.partitionBy("find_id").orderBy(F.desc("is_primary"), "created_at", "id", "uri"))
    return photos.withColumn("is_primary", first == 1)


def seed_presets(library: DataFrame, names: Sequence[str], detector: str, existing: DataFrame, now_ms: int) -> DataFrame:
    """Presets to add for a detector, at distinct times now + position; none if a detector of that name is there."""
    spark = existing.sparkSession
    wanted = spark.createDataFrame([(detector, list(names))], "detector string, names array<string>")
    fresh = wanted.hint("merge").join(existing.select(F.col("name").alias("detector")).distinct().hint("merge"), "detector", "left_anti")
    rows = fresh.select("detector", F.posexplode("names").alias("pos", "name")).select("detector", "name", (F.lit(now_ms) + F.col("pos")).alias("created_at"))
    return library.unionByName(rows, allowMissingColumns=True)


def upgrade(tables: dict[str, DataFrame], schemas: dict[str, str], spark) -> dict[str, DataFrame]:
    """All tables of ``schemas`` with all their columns: missing tables are empty, missing columns null."""
    out = {}
    for name, ddl in schemas.items():
        empty = spark.createDataFrame([], ddl)
        out[name] = empty.unionByName(tables[name], allowMissingColumns=True).select(*empty.columns) if name in tables else empty
    return out


def merge_import(existing: DataFrame, incoming: DataFrame, key: str = "external_id") -> tuple[DataFrame, DataFrame]:
    """(rows to insert, counts): incoming rows with an unknown external id, each once (the first by id), keep their id where it is free.

    Rows without an external id or an id are no rows to import: they are left out and counted as warnings. The counts (one row):
    incoming, inserted, skipped (known already, or a repetition) and warnings.

    Others get ids above all that are there: the rows whose id is taken are numbered in stored ranges of (old id, external id), whose
    bounds are measured, so sparse ids are no matter.
    """
    usable = incoming.where(F.col(key).isNotNull() & F.col("id").isNotNull())
    fresh = new_rows(usable, existing, key)
    first = F.row_number().over(Window.partitionBy(key).orderBy("id"))
    fresh = fresh.withColumn("__n", first).where("__n = 1").drop("__n")
    twice = F.row_number().over(Window.partitionBy("id").orderBy(key))
    taken = existing.select("id").distinct().withColumn("__taken", F.lit(True))
    fresh = fresh.withColumn("__twice", twice > 1).join(taken, "id", "left")
    fresh = fresh.withColumn("__free", F.col("__taken").isNull() & ~F.col("__twice")).drop("__taken", "__twice")
    top = existing.select("id").union(incoming.select("id")).agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    placed = numbered(fresh.where("NOT __free"), [F.col("id"), F.col(key)], "__place").withColumn("id", F.lit(top) + F.col("__place")).drop("__place")
    out = fresh.where("__free").unionByName(placed).drop("__free")
    flagged = incoming.select(F.col(key), F.col("id"), F.lit(1).alias("__in")).hint("merge").join(existing.select(key).distinct().withColumn("__known", F.lit(1)).hint("merge"), key, "left")
    bad = F.col(key).isNull() | F.col("id").isNull()
    by_key = flagged.groupBy(key, bad.alias("bad"), F.col("__known").isNotNull().alias("known")).agg(F.count("*").alias("n"))
    inserted = F.when(~F.col("bad") & ~F.col("known"), 1).otherwise(0)
    summary = by_key.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("incoming"), F.coalesce(F.sum(inserted), F.lit(0)).alias("inserted"),
        F.coalesce(F.sum(F.when(~F.col("bad"), F.col("n") - inserted)), F.lit(0)).alias("skipped"), F.coalesce(F.sum(F.when(F.col("bad"), F.col("n"))), F.lit(0)).alias("warnings"),
    )
    return out, summary


def reparent(children: DataFrame, parents: DataFrame, resolved: DataFrame, parent_key: str) -> DataFrame:
    """Children with ``parent_key`` set to the id that their parent's external id has in ``resolved``, the lowest of several; children of unknown parents go."""
    resolved = resolved.groupBy("external_id").agg(F.min("id").alias("id"))
    links = parents.select(F.col("id").alias(parent_key), "external_id").join(resolved.select("external_id", F.col("id").alias("__to")), "external_id").select(parent_key, "__to")
    return children.join(links, parent_key).withColumn(parent_key, F.col("__to")).drop("__to")
