"""Queries over file and folder names; the SQL takes the parts from the columns that the names were made of."""

from pyspark.sql import functions as F

from gridloom.functions import names as N
from gridloom.plans import fixtures as X


def _named(s, d):
    """(id, name columns): names that writers of the five conventions would give to a stroke's time; some are damaged."""
    t = F.timestamp_seconds("s")
    day, time, odd = F.date_format(t, "yyyy-MM-dd"), F.date_format(t, "HHmm"), F.col("id") % 11 == 0
    return X.strokes(s, d).select(
        "id", "s",
        F.concat(F.lit("nc4_"), day, F.lit("-Romania_"), F.when(odd, F.lit("12x4")).otherwise(time), F.lit("_IR_016")).alias("nc4"),
        F.concat(F.lit("a/lightning_"), F.lower("intra"), F.lit("_"), F.date_format(t, "yyyyMMdd"), F.when(odd, "").otherwise("_"), time, F.lit(".nc")).alias("lightning"),
        F.concat(day, F.lit("-Romania")).alias("folder"), F.concat(F.lit("ICON_00_ML_99"), time, F.lit("00.nc")).alias("forecast"),
        F.concat(F.lit("d/S_NWC_"), F.when(F.col("id") % 2 == 0, "CTTH").otherwise("CMIC"), F.lit("_MSG4_"), F.when(F.col("id") % 3 == 0, "MSG-N").otherwise("Europe"), F.lit("-VISIR_"), F.date_format(t, "yyyyMMdd'T'HHmmss"), F.when(odd, ".nc").otherwise("Z.nc")).alias("cloud"),
        F.concat(F.lit("OR_ABI-L1b-RadC-M6C"), F.lpad((F.col("id") % 16 + 1).cast("string"), 2, "0"), F.lit("_G16_s"), F.date_format(t, "yyyyDDDHHmmss"), F.lit("0_e0_c0.nc")).alias("imager"),
        F.concat(F.lit("N0_KXYZ_"), F.when(F.col("id") % 2 == 0, "N0Q").otherwise("DAA"), F.lit("tail_"), F.date_format(t, "yyyyMMddHHmm")).alias("network"),
    )


def _seconds(c):
    return F.unix_timestamp(c)


_S = X.SQL_STROKES
_MINUTE = "s // 60 * 60"
QUERIES = {
    "nc4_names": (lambda s, d: _named(s, d).select("id", _seconds(N.nc4_time(F.col("nc4"))).alias("t"), F.date_format(N.nc4_time(F.col("nc4")), "dd/MM/yyyy").alias("day")), f"WITH {_S} SELECT id, CASE WHEN id % 11 <> 0 THEN {_MINUTE} END AS t, CASE WHEN id % 11 <> 0 THEN strftime(to_timestamp(s) AT TIME ZONE 'UTC', '%d/%m/%Y') END AS day FROM strokes"),
    "lightning_names": (lambda s, d: _named(s, d).select("id", _seconds(N.lightning_time(F.col("lightning"))).alias("t")), f"WITH {_S} SELECT id, CASE WHEN id % 11 <> 0 THEN {_MINUTE} END AS t FROM strokes"),
    "forecast_names": (lambda s, d: _named(s, d).select("id", _seconds(N.forecast_time(F.col("folder"), F.col("forecast"))).alias("t"), N.folder_label(F.date_format(F.timestamp_seconds("s"), "yyyy-MM-dd'T'HH:mm")).alias("label"), N.is_dated_folder(F.col("folder")).alias("dated"), N.is_dated_folder(F.col("nc4")).alias("other")), f"WITH {_S} SELECT id, {_MINUTE} AS t, 'nc4_' || strftime(to_timestamp(s) AT TIME ZONE 'UTC', '%Y-%m-%d') || '-Romania' AS label, true AS dated, false AS other FROM strokes"),
    "cloud_names": (lambda s, d: _named(s, d).select("id", N.cloud_product(F.col("cloud")).alias("c")).select("id", "c.product", "c.satellite", "c.region", "c.sensor", _seconds("c.time").alias("t")), f"WITH {_S} SELECT id, CASE WHEN ok THEN CASE WHEN id % 2 = 0 THEN 'CTTH' ELSE 'CMIC' END END AS product, CASE WHEN ok THEN 'MSG4' END AS satellite, CASE WHEN ok THEN CASE WHEN id % 3 = 0 THEN 'MSG-N' ELSE 'Europe' END END AS region, CASE WHEN ok THEN 'VISIR' END AS sensor, CASE WHEN ok THEN s END AS t FROM (SELECT *, id % 11 <> 0 AS ok FROM strokes)"),
    "imager_names": (lambda s, d: _named(s, d).select("id", N.imager_file(F.col("imager")).alias("a"), N.radar_network_file(F.col("network")).alias("b")).select("id", "a.channel", _seconds("a.time").alias("t"), "b.product", _seconds("b.time").alias("t2")), f"WITH {_S} SELECT id, lpad((id % 16 + 1)::VARCHAR, 2, '0') AS channel, s AS t, CASE WHEN id % 2 = 0 THEN 'N0Q' ELSE 'DAA' END AS product, {_MINUTE} AS t2 FROM strokes"),
    "folder_groups": (  # folders by parsed variable and date, dates in order, those without one first
        lambda s, d: _named(s, d).select(N.clean_name(F.concat(F.lit("nc4_"), F.when(F.col("id") % 5 == 0, "").otherwise(F.col("folder")), F.lit("_1215_"), F.element_at(F.split("cloud", "_"), 3))).alias("variable"), F.when(F.col("id") % 5 != 0, F.substring("folder", 1, 10)).alias("date")).groupBy("variable", "date").agg(F.count(F.lit(1)).alias("n")),
        f"WITH {_S} SELECT CASE WHEN id % 2 = 0 THEN 'ctth' ELSE 'cmic' END AS variable, CASE WHEN id % 5 <> 0 THEN strftime(to_timestamp(s) AT TIME ZONE 'UTC', '%Y-%m-%d') END AS date, count(*) AS n FROM strokes GROUP BY ALL",
    ),
}
