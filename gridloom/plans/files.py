"""Queries over files of the formats that other programs write, and bundles, stores and reports read back from disk."""

from pyspark.sql import functions as F

from gridloom.operators import sequences as S
from gridloom.operators import verify as V
from gridloom.operators.reports import Registry
from gridloom.operators.selection import shortest_steps
from gridloom.operators.shared import new_path
from gridloom.plans import fixtures as X
from gridloom.sources import bundles as B
from gridloom.sources import containers as C
from gridloom.sources import sinks as K
from gridloom.sources import tables as T

_S, _PX = X.SQL_STROKES, X.SQL_PIXELS
_UTC = "AT TIME ZONE 'UTC'"


def _index_file(s, d):
    """The wide index as CSV, and its active patches again."""
    path = new_path(s, "index")
    active = X.patch_active(s, d).select(F.date_format(F.timestamp_seconds(F.col("slot") * 3600), "yyyy-MM-dd'T'HH:mm").alias("ts_text"), "patch_id")
    wide = K.wide_index(active)
    wide.select(F.substring("ts_text", 1, 10).alias("date"), F.substring("ts_text", 12, 5).alias("time_utc"), F.col("ts_text").alias("iso_timestamp"), *wide.columns[1:]).write.csv(path, header=True)
    return T.read_patch_index(s, path)


def _sequence_file(s, d):
    """Sequences as CSV with lists in cells; read back, patches and their positions at the reference stand side by side."""
    path, hour = new_path(s, "sequences"), lambda k: F.date_format(F.timestamp_seconds((F.col("slot") + k) * 3600), "yyyy-MM-dd'T'HH:mm")
    offsets = ["idx_t-30", "idx_t-15", "idx_t0", "idx_t+15", "idx_t+30", "idx_t+45"]
    rows = K.sequence_rows(S.step_positions(X.patch_active(s, d)), 2, 3, 15)
    n = F.size(F.from_json("patch_numbers", "array<int>"))
    rows.select(F.date_format(F.timestamp_seconds(F.col("slot") * 3600), "yyyy-MM-dd").alias("date"), hour(0).alias("reference_utc"), hour(-2).alias("start_utc"), hour(3).alias("end_utc"), "patch_numbers", *[f"`{c}`" for c in offsets], n.alias("n_qualifying"), n.alias("n_total_active")).write.option("escape", '"').csv(path, header=True)
    read = T.read_sequences(s, path, offsets)
    return read.select("reference_utc", F.col("n_qualifying").cast("long").alias("n"), F.inline(F.arrays_zip(F.col("patch_numbers").alias("patch_id"), F.col("`idx_t0`").alias("pos"), F.col("`idx_t+45`").alias("pos_later"))))


def _archive_file(s, d):
    """Strokes in the archive's pipe-separated form."""
    path = new_path(s, "strokes")
    date = F.concat(F.date_format(F.timestamp_seconds("s"), "dd.MM.yyyy HH:mm:ss"), F.lit(".123456 UTC"))
    rest = [F.lit("0")] * 10
    X.strokes(s, d).select(F.concat_ws("|", date, F.col("lon").cast("double").cast("string"), F.col("lat").cast("double").cast("string"), F.round("current", 2).cast("string"), F.lit("5"), F.lit("1"), "intra", *rest)).write.text(path)
    read = T.read_strokes_archive(s, path)
    return read.groupBy(F.floor(F.unix_timestamp("ts") / 3600).alias("hour"), "intra").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("lon"), 4).alias("lon"), F.round(F.sum("lat"), 4).alias("lat"), F.round(F.sum("current"), 2).alias("current"))


def _feed_file(s, d):
    """Strokes in the live feed's columns."""
    path = new_path(s, "feed")
    X.strokes(s, d).select(F.concat_ws("  ", F.col("lat").cast("double").cast("string"), F.col("lon").cast("double").cast("string"), F.date_format(F.timestamp_seconds("s"), "yyyyMMddHHmmss"), "intra", F.round("current", 2).cast("string"))).write.text(path)
    read = T.read_strokes_feed(s, path)
    return read.groupBy(F.floor(F.unix_timestamp("ts") / 3600).alias("hour"), "intra").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("lon"), 4).alias("lon"), F.round(F.sum("lat"), 4).alias("lat"), F.round(F.sum("current"), 2).alias("current"))


def _strokes_sql():
    return f"WITH {_S} SELECT CAST(s // 3600 AS BIGINT) AS hour, intra, count(*) AS n, round(sum(lon::DOUBLE), 4) AS lon, round(sum(lat::DOUBLE), 4) AS lat, round(sum(round(current, 2)), 2) AS current FROM strokes GROUP BY ALL"


def _time_grid(s, d):
    """Quarters of an hour over the whole time, also those without events."""
    frames = X.strokes(s, d).groupBy((F.floor(F.col("s") / 900) * 900).alias("t")).agg(F.count(F.lit(1)).alias("n"))
    ends = frames.agg(F.min("t"), F.max("t")).first()
    return T.on_time_grid(frames, int(ends[0]), int(ends[1]), 900, ["n"])


def _point_files(s, d):
    """Flashes and events of each day as lists in one container, read as points and counted on a grid."""
    path = new_path(s, "points")
    rows = X.strokes(s, d).select(F.floor(F.col("s") / 86400).alias("day"), "id", F.when(F.col("intra") == "IC", "event").otherwise("flash").alias("kind"), F.col("lat").cast("double").alias("lat"), F.col("lon").cast("double").alias("lon"), F.abs("current").alias("energy"))
    lists = rows.groupBy("day", "kind").agg(F.array_sort(F.collect_list(F.struct("id", "lat", "lon", "energy"))).alias("x"))
    lines = lists.select(F.format_string("points_%d.nc", "day").alias("path"), F.explode(F.array(*[F.struct(F.concat("kind", F.lit(f"_{c}")).alias("variable"), F.col("x")[c].alias("values")) for c in ("lat", "lon", "energy")])).alias("y"), "kind")
    C.write_containers(lines.select("path", "y.variable", F.array(F.concat("kind", F.lit("s"))).alias("dims"), F.array(F.size("y.values")).alias("shape"), F.lit(0).alias("line"), "y.values"), path, dtype="f8")
    points = C.read_points(s, path, ["event", "flash"])
    return points.groupBy("kind", F.floor(F.col("lat")).alias("i"), F.floor(F.col("lon")).alias("j")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("energy"), 4).alias("energy"))


def _bundle_pixels(s, d):
    path = new_path(s, "bundle")
    B.write_patches(X.pixels(s, d), path, 16, 12, F.col("v") > 49, 0.0, 2.0)
    return B.read_patches(s, path).groupBy("frame", "patch_id", "filled").agg(F.count(F.lit(1)).alias("pixels"), F.min("i").alias("i0"), F.max("j").alias("j1"), F.count_if(F.col("v") > 0).alias("n"), F.sum("v").alias("total"))


def _sample_store(s, d):
    path = new_path(s, "samples")
    x = F.transform("embedding", lambda v: v.cast("double"))
    rows = X.table(s, d, "embeddings").select(F.when(F.col("vec_id") % 10 < 7, "train").when(F.col("vec_id") % 10 < 9, "validation").otherwise("test").alias("split"), F.slice(x, 1, 40).alias("radar"), F.slice(x, 41, 24).alias("satellite"), (F.col("vec_id") % 3).cast("int").alias("y"))
    B.write_samples(rows, path, "split", ["radar", "satellite"], "y")
    sums = s.read.parquet(f"{path}/samples").groupBy(F.col("split").cast("string").alias("split")).agg(F.round(F.sum(F.aggregate("satellite", F.lit(0.0), lambda a, v: a + v)), 4).alias("total"))
    facts = B.read_sample_facts(s, path)
    return facts.join(sums, "split").select("split", "n", F.array_join("channels", ",").alias("channels"), F.col("shapes")["radar"].alias("radar"), F.col("shapes")["satellite"].alias("satellite"), "label", "label_type", "positive", "total")


def _evaluation(s, d):
    path = new_path(s, "evaluation")
    B.write_evaluation(V.confusion_sweep(V.with_overall(X.predictions(s, d)), 10, ["lead"]), path)
    return B.read_evaluation(s, path)


def _shortest(s, d):
    rows = X.table(s, d, "lineitem").select((F.col("l_orderkey") % 1000).alias("file"), F.unix_date(F.col("l_shipdate").cast("date")).alias("day"), F.col("l_returnflag").alias("variable"), F.col("l_linenumber").cast("long").alias("step"), F.col("l_quantity").cast("double").alias("v"))
    return shortest_steps(rows, ["file", "day"], ["A", "N", "R"])


def _by_name(s, d):
    """The reader of a product is found by its name, with the settings that it was declared with."""
    path = new_path(s, "named")
    X.strokes(s, d).select("id", F.col("intra").alias("variable"), F.col("current").alias("value")).write.partitionBy("variable").parquet(path)
    readers = Registry("reader")
    readers.declare("currents", "gridloom.sources.tables:read_wide", keys=["id"], variables=["CG", "IC"])
    return readers.get("currents")(s, path).select("id", F.round("CG", 4).alias("cg"), F.round("IC", 4).alias("ic"))


_SPLIT = "CASE WHEN vec_id % 10 < 7 THEN 'train' WHEN vec_id % 10 < 9 THEN 'validation' ELSE 'test' END"
_ISO = f"strftime(to_timestamp(slot * 3600) {_UTC}, '%Y-%m-%dT%H:%M')"
QUERIES = {
    "shortest_steps": (
        _shortest,
        "WITH m AS (SELECT l_orderkey % 1000 AS file, CAST(l_shipdate AS DATE) - DATE '1970-01-01' AS day, l_returnflag AS variable, l_linenumber AS step, l_quantity::DOUBLE AS v FROM lineitem), b AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY file, day, variable ORDER BY step, v) = 1), k AS (SELECT file, day, concat_ws(',', CASE WHEN bool_or(variable = 'A') THEN NULL ELSE 'A' END, CASE WHEN bool_or(variable = 'N') THEN NULL ELSE 'N' END, CASE WHEN bool_or(variable = 'R') THEN NULL ELSE 'R' END) AS missing FROM b GROUP BY ALL) SELECT file, CAST(day AS INT) AS day, missing, variable, CAST(step AS BIGINT) AS step, v FROM b JOIN k USING (file, day)",
    ),
    "reader_by_name": (_by_name, f"WITH {_S} SELECT id, CASE WHEN intra = 'CG' THEN round(current, 4) END AS cg, CASE WHEN intra = 'IC' THEN round(current, 4) END AS ic FROM strokes"),
    "index_file": (_index_file, f"WITH {X.sql_active()} SELECT {_ISO} AS iso_timestamp, CAST(patch_id AS INT) AS patch_id FROM active"),
    "sequence_file": (
        _sequence_file,
        f"WITH {X.sql_active()}, refs AS (SELECT slot, patch_id FROM (SELECT *, count(*) OVER (PARTITION BY patch_id ORDER BY slot RANGE BETWEEN 2 PRECEDING AND 3 FOLLOWING) AS n FROM active) WHERE n = 6), p AS (SELECT slot, patch_id, row_number() OVER (PARTITION BY slot ORDER BY patch_id) - 1 AS pos FROM active) SELECT {_ISO.replace('slot', 'r.slot')} AS reference_utc, count(*) OVER (PARTITION BY r.slot) AS n, CAST(r.patch_id AS INT) AS patch_id, CAST(a.pos AS INT) AS pos, CAST(b.pos AS INT) AS pos_later FROM refs r JOIN p a ON a.slot = r.slot AND a.patch_id = r.patch_id JOIN p b ON b.slot = r.slot + 3 AND b.patch_id = r.patch_id",
    ),
    "stroke_archive_file": (_archive_file, _strokes_sql()),
    "stroke_feed_file": (_feed_file, _strokes_sql()),
    "time_grid": (_time_grid, f"WITH {_S}, f AS (SELECT CAST(s // 900 * 900 AS BIGINT) AS t, count(*) AS n FROM strokes GROUP BY 1), g AS (SELECT unnest(range(lo, hi, 900)) AS t FROM (SELECT min(t) AS lo, max(t) AS hi FROM f)) SELECT g.t, n FROM g LEFT JOIN f USING (t)"),
    "point_files": (_point_files, f"WITH {_S} SELECT CASE intra WHEN 'IC' THEN 'event' ELSE 'flash' END AS kind, CAST(floor(lat::DOUBLE) AS BIGINT) AS i, CAST(floor(lon::DOUBLE) AS BIGINT) AS j, count(*) AS n, round(sum(abs(current)), 4) AS energy FROM strokes GROUP BY ALL"),
    "bundle_pixels": (
        _bundle_pixels,
        f"WITH {_PX}, p AS (SELECT frame, (i // 16) * 12 + j // 16 + 1 AS patch_id, max(v) > 49 AS filled, min(i // 16 * 16) AS i0, max(j // 16 * 16 + 15) AS j1, count(*) AS c, sum(v) AS s FROM pixels GROUP BY ALL) SELECT frame, patch_id, filled, 256 AS pixels, i0, j1, CASE WHEN filled THEN c ELSE 0 END AS n, CASE WHEN filled THEN s ELSE 0 END AS total FROM p",
    ),
    "sample_store": (_sample_store, f"SELECT {_SPLIT} AS split, count(*) AS n, 'radar,satellite' AS channels, 40 AS radar, 24 AS satellite, 'y' AS label, 'int' AS label_type, count(*) FILTER (vec_id % 3 > 0) AS positive, round(sum(list_sum([x::DOUBLE FOR x IN embedding[41:64]])), 4) AS total FROM embeddings GROUP BY 1"),
    "evaluation_json": (
        _evaluation,
        f"WITH {X.SQL_PREDICTIONS}, b AS (SELECT lead, y_true, y_pred FROM predictions UNION ALL SELECT 0, y_true, y_pred FROM predictions), c AS (SELECT lead, CAST(k AS INT) AS k, count(*) FILTER (y_true = 1 AND x >= k) AS tp, count(*) FILTER (y_true = 0 AND x >= k) AS fp, count(*) FILTER (y_true = 1 AND x < k) AS fn, count(*) FILTER (y_true = 0 AND x < k) AS tn FROM (SELECT *, floor(y_pred * 10 + 1e-9) AS x FROM b), (SELECT unnest(range(0, 11)) AS k) GROUP BY ALL), z AS (SELECT *, round(coalesce(tp / nullif(tp + fp + fn, 0)::DOUBLE, 0), 6) AS csi, round(coalesce(tp / nullif(tp + fn, 0)::DOUBLE, 0), 6) AS pod, round(coalesce(fp / nullif(tp + fp, 0)::DOUBLE, 0), 6) AS far FROM c), t AS (SELECT * FROM z QUALIFY row_number() OVER (PARTITION BY lead ORDER BY csi DESC, k) = 1) SELECT c.lead, t.k AS best, t.csi, t.pod, t.far, c.k, c.tp, c.fp, c.fn, c.tn FROM c JOIN t USING (lead)",
    ),
}
