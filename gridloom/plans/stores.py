"""Queries over files and stores that are written below the shared folder and read back."""

from pyspark.sql import functions as F

from gridloom.operators.shared import new_path
from gridloom.plans import fixtures as X
from gridloom.sources import archives as A
from gridloom.sources import containers as C
from gridloom.sources import tables
from gridloom.sources import versions as V

_PX = X.SQL_PIXELS
HEIGHT, WIDTH = 96, 192


def _scene_files(s, d):
    """A file for each frame: rain under its own name, its maximum a column, and an axis; the corners of longitude as attributes."""
    path = new_path(s, "scenes")
    lines = C.dense_lines(X.pixels(s, d), ["frame"], HEIGHT, WIDTH)
    name = F.concat(F.lit("day="), F.floor(F.col("frame") / 10).cast("string"), F.lit("/frame_"), F.col("frame").cast("string"), F.lit(".nc")).alias("path")
    n = lambda *k: F.array(*[F.lit(x) for x in k])
    rain = lines.select(name, F.lit("RAIN").alias("variable"), n("y", "x").alias("dims"), n(HEIGHT, WIDTH).alias("shape"), "line", "values")
    frames = lines.select("frame").distinct()
    axis = F.transform(F.sequence(F.lit(0), F.lit(HEIGHT - 1)), lambda k: F.lit(48.0) - k * 0.0625)
    lat = frames.select(name, F.lit("lat"), n("y"), n(HEIGHT), F.lit(0), axis)
    C.write_containers(rain.union(lat), path, attributes={"lon_ul": [20.0], "lon_lr": [20.0 + (WIDTH - 1) * 0.125], "title": "rain by frame"})
    return path


def _frame(path):
    return F.regexp_extract(path, r"frame_(\d+)\.nc$", 1).cast("long").alias("frame")


def _containers(s, d):
    rows = C.read_containers(s, _scene_files(s, d), [["rain", "precipitation", "RAIN"], ["lat"], ["lon"]])
    rain = rows.where("variable = 'rain'").select(_frame("path"), F.col("line").cast("long").alias("i"), F.size(F.filter("values", lambda v: v > 0)).cast("long").alias("n"), F.aggregate("values", F.lit(0.0), lambda a, v: a + v).alias("total"))
    lat = rows.where("variable = 'lat'").select(_frame("path"), F.posexplode("values").alias("i", "lat"))
    east = rows.where("variable = 'lon'").select(_frame("path"), F.element_at("values", -1).alias("east"))
    return rain.join(lat, ["frame", "i"]).join(east, "frame").select("frame", "i", "lat", "east", "n", "total")


def _tiles(s, d):
    """The same files as bytes that Spark reads, decoded to tiles and cut to pixels."""
    tiles = tables.read_rasters(s, _scene_files(s, d), "*.nc", candidates=("rain", "RAIN"), decoder=C.container_decoder, tile=64)
    pixels = tables.tile_pixels(tiles, WIDTH // 64, 64).where("v > 0")
    return pixels.groupBy(_frame("path"), F.floor(F.col("i") / 32).alias("bi"), F.floor(F.col("j") / 32).alias("bj")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("v").cast("double")).alias("total"))


def _zips(s, d):
    """An archive for each hour with events, in folders of year, day of year and hour; a member for each quarter."""
    path = new_path(s, "archives")
    rows = X.strokes(s, d).withColumn("q", F.floor(F.col("s") / 900) * 900)
    lines = rows.groupBy("q").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(",", "id", F.round("current", 2)))), "\n").alias("content"))
    name = F.concat(F.date_format(F.timestamp_seconds("q"), "yyyy/DDD/HH"), F.lit("/events.zip"))
    A.write_archives(lines.select(name.alias("name"), F.concat(F.lit("ev_s"), F.col("q").cast("string"), F.lit(".csv")).alias("member"), "content"), path)
    return A.members(s, path, "*.zip")


def _rows_of(content):
    return content.withColumn("line", F.explode(F.split(F.decode("content", "utf-8"), "\n"))).withColumn("v", F.split_part("line", F.lit(","), F.lit(2)).cast("double"))


def _zip_members(s, d):
    read = _rows_of(A.read_members(_zips(s, d)).where("error IS NULL"))
    folder = F.regexp_extract("path", r"(\d{4}/\d{3}/\d{2})/events\.zip$", 1).alias("folder")
    return read.groupBy(folder, "member").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("v"), 2).alias("total"))


def _time_range(s, d):
    """A reader that is asked for every six hours over the whole time of the data gets the events of the half hour before each."""
    ends = X.strokes(s, d).agg(F.floor(F.min("s") / 21600) * 21600, F.max("s")).first()
    found = A.members_for_times(_zips(s, d), F.regexp_extract("member", r"_s(\d+)\.csv$", 1).cast("long"), A.requested(s, (int(ends[0]), int(ends[1])), 21600, inclusive=True), 1800)
    return _rows_of(A.read_members(found, carry=["t"])).groupBy("t").agg(F.countDistinct("member").alias("files"), F.count(F.lit(1)).alias("n"), F.round(F.sum("v"), 2).alias("total"))


def _versions(s, d):
    """Two jobs that overlap by a half append to one store; what the second finds there already is skipped."""
    rows = X.strokes(s, d).select(F.floor(F.col("s") / 86400).alias("day"), "id", "current")
    log = V.Versions(s, new_path(s, "versions"), rows.schema, ["day", "id"])
    log.append(rows.where("id % 3 < 2"))
    again = log.append(rows.where("id % 3 > 0").withColumn("current", F.lit(0.0)))
    stored = log.read().groupBy("day").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("current"), 3).alias("total"))
    return stored.join(log.read(1).groupBy("day").agg(F.count(F.lit(1)).alias("n_before")), "day", "left").join(again.counts, "day", "left")


_FOLDER = "strftime(to_timestamp(s) AT TIME ZONE 'UTC', '%Y/%j/%H')"
QUERIES = {
    "zip_members": (_zip_members, f"WITH {X.SQL_STROKES} SELECT {_FOLDER} AS folder, 'ev_s' || (s // 900 * 900) || '.csv' AS member, count(*) AS n, round(sum(round(current, 2)), 2) AS total FROM strokes GROUP BY ALL"),
    "time_range": (
        _time_range,
        f"WITH {X.SQL_STROKES}, t AS (SELECT unnest(range(lo, hi + 1, 21600)) AS t FROM (SELECT CAST(min(s) // 21600 * 21600 AS BIGINT) AS lo, max(s) AS hi FROM strokes)), q AS (SELECT s // 900 * 900 AS q, current FROM strokes) SELECT t, count(DISTINCT q) AS files, count(*) AS n, round(sum(round(current, 2)), 2) AS total FROM t JOIN q ON q >= t - 1800 AND q < t GROUP BY t",
    ),
    "versioned_store": (
        _versions,
        f"WITH {X.SQL_STROKES}, r AS (SELECT CAST(s // 86400 AS BIGINT) AS day, id, current FROM strokes) SELECT day, count(*) AS n, round(sum(CASE WHEN id % 3 < 2 THEN current ELSE 0 END), 3) AS total, nullif(count(*) FILTER (id % 3 < 2), 0) AS n_before, CASE WHEN count(*) FILTER (id % 3 > 0) > 0 THEN count(*) FILTER (id % 3 = 2) END AS new, CASE WHEN count(*) FILTER (id % 3 > 0) > 0 THEN count(*) FILTER (id % 3 = 1) END AS skipped FROM r GROUP BY day",
    ),
    "containers": (
        _containers,
        f"WITH {_PX}, g AS (SELECT frame, i FROM (SELECT DISTINCT frame FROM pixels), (SELECT unnest(range(0, {HEIGHT})) AS i)) SELECT g.frame, g.i, 48 - g.i * 0.0625::DOUBLE AS lat, 20 + {(WIDTH - 1) * 0.125}::DOUBLE AS east, count(v) AS n, coalesce(sum(v), 0) AS total FROM g LEFT JOIN pixels p ON p.frame = g.frame AND p.i = g.i GROUP BY ALL",
    ),
    "raster_tiles": (_tiles, f"WITH {_PX} SELECT frame, i // 32 AS bi, j // 32 AS bj, count(*) AS n, sum(v) AS total FROM pixels WHERE v > 0 GROUP BY ALL"),
}
