"""Parsing of file and folder names, and times."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.operators.ranks import numbered


#: Items that names are matched against at most.
MOST_KNOWN = 10_000


def radar_time(name: Column) -> Column:
    """Timestamp of ``XXXyyDDDHHMM...`` or ``..._yyyyMMdd_HHmm...`` names; null for others."""
    julian = F.regexp_extract(name, r"^[A-Z]{3}(\d{9})", 1)
    plain = F.concat(F.regexp_extract(name, r"(\d{8})[_T]?(\d{4})", 1), F.regexp_extract(name, r"(\d{8})[_T]?(\d{4})", 2))
    return F.coalesce(F.try_to_timestamp(F.when(julian != "", F.concat(F.lit("20"), julian)), F.lit("yyyyDDDHHmm")), F.try_to_timestamp(F.when(plain != "", plain), F.lit("yyyyMMddHHmm")))


def quarter_hour(name: Column) -> Column:
    """Whether the name's minute is a quarter of an hour; names without a time pass."""
    minute = F.coalesce(F.minute(radar_time(name)), F.lit(0))
    return minute.isin(0, 15, 30, 45)


def slot_of(seconds: Column, start: int, step: int) -> Column:
    """floor((t - start) / step), also for times before the start."""
    return F.floor((seconds - start) / step)


def hhmm(seconds: Column) -> Column:
    minutes = F.pmod(F.floor(seconds / 60), F.lit(1440))
    return F.concat(F.lpad(F.floor(minutes / 60).cast("string"), 2, "0"), F.lpad((minutes % 60).cast("string"), 2, "0"))


def nearest_hour(seconds: Column) -> Column:
    """Start of the nearest hour, half past going up."""
    return F.floor((seconds + 1800) / 3600) * 3600


def hour_block(seconds: Column, hours: int) -> Column:
    if 24 % hours:
        raise ValueError("hours must divide 24")
    return F.floor(F.pmod(seconds, F.lit(86400)) / (3600 * hours)) * hours


# What folder names are stripped of, in this order.
_STRIPPED = ((r"\d{4}-\d{2}-\d{2}", ""), (r"^nc4_", ""), (r"(?i)-(Romania|Hungary|Bulgaria|Serbia)", ""), (r"_\d{4}_", "_"), (r"^[-_]+|[-_]+$", ""), (r"[-_]+", "_"))


def clean_name(name: Column) -> Column:
    """A folder name as a variable's: lower case, 'unknown' if nothing stays."""
    for pattern, new in _STRIPPED:
        name = F.regexp_replace(name, pattern, new)
    return F.when(name == "", "unknown").otherwise(F.lower(name))


def _time(text: Column, form: str) -> Column:
    return F.try_to_timestamp(F.when(text != "", text), F.lit(form))


def nc4_time(name: Column) -> Column:
    """``nc4_<date><country>_<HHMM>_...``: at least four parts, the time exactly four digits; null for others."""
    parts = F.split(name, "_")
    time = F.get(parts, F.lit(2))
    return F.when((F.size(parts) >= 4) & time.rlike(r"^\d{4}$"), _time(F.concat(F.substring(F.get(parts, F.lit(1)), 1, 10), time), "yyyy-MM-ddHHmm"))


def lightning_time(name: Column) -> Column:
    """``lightning_<type>_<yyyyMMdd>_<HHmm>`` below any folder."""
    file = F.substring_index(F.substring_index(name, "/", -1), "\\", -1)
    pattern = r"lightning_\w+_(\d{8})_(\d{4})"
    return _time(F.concat(F.regexp_extract(file, pattern, 1), F.regexp_extract(file, pattern, 2)), "yyyyMMddHHmm")


def forecast_time(folder: Column, file: Column) -> Column:
    """Date from ``yyyy-MM-dd-...`` folders, time from the middle four of the last eight characters before a three-character extension."""
    middle = F.substring(F.right(file, F.lit(11)), 3, 4)
    return _time(F.concat(F.substring(folder, 1, 10), middle), "yyyy-MM-ddHHmm")


def cloud_product(path: Column) -> Column:
    """(product, satellite, region, sensor, time) of ``S_NWC_<product>_<satellite>_<region>-<sensor>_<time>Z.nc``; null for others."""
    file = F.substring_index(path, "/", -1)
    pattern = r"^S_NWC_([A-Z]+)_([A-Z0-9]+)_(.+)_(\d{8}T\d{6})Z\.nc"
    part = lambda k: F.regexp_extract(file, pattern, k)
    where = part(3)
    return F.when(file.rlike(pattern), F.struct(part(1).alias("product"), part(2).alias("satellite"), F.regexp_replace(where, "-[^-]*$", "").alias("region"), F.substring_index(where, "-", -1).alias("sensor"), _time(part(4), "yyyyMMdd'T'HHmmss").alias("time")))


def imager_file(name: Column) -> Column:
    """(channel, time) of ``.._..-..-..-M6C<channel>_..._s<year, day of year, time, tenth>_..``."""
    parts = F.split(name, "_")
    channel = F.right(F.get(F.split(F.get(parts, F.lit(1)), "-"), F.lit(3)), F.lit(2))
    return F.struct(channel.alias("channel"), _time(F.substring(F.get(parts, F.lit(3)), 2, 13), "yyyyDDDHHmmss").alias("time"))


def radar_network_file(name: Column) -> Column:
    """(product, time) of ``.._.._<product..>_..._<yyyyMMddHHmm>``."""
    parts = F.split(name, "_")
    return F.struct(F.substring(F.get(parts, F.lit(2)), 1, 3).alias("product"), _time(F.element_at(parts, -1), "yyyyMMddHHmm").alias("time"))


def folder_label(iso: Column) -> Column:
    """The folder in which files of an ISO time are kept."""
    return F.concat(F.lit("nc4_"), F.substring_index(iso, "T", 1), F.lit("-Romania"))


def is_dated_folder(name: Column) -> Column:
    return name.rlike(r"^\d{4}-\d{2}-\d{2}-Romania$")


def best_match(names: DataFrame, known: DataFrame, most: int = 3) -> DataFrame:
    """For each (name) the first of ``known`` (pos, item) with the least edit distance up to ``most``, else null.

    Names are compared once each, with all known items: a list of variables, which must be short (MOST_KNOWN).
    """
    if known.count() > MOST_KNOWN:
        raise ValueError(f"more than {MOST_KNOWN} known items; an edit-distance match needs a short list")
    distinct = names.select("name").distinct()
    near = distinct.join(F.broadcast(known), F.levenshtein(F.lower("name"), F.lower("item")) <= most)
    best = near.groupBy("name").agg(F.min(F.struct(F.levenshtein(F.lower("name"), F.lower("item")).alias("d"), "pos", "item")).alias("m"))
    return distinct.join(best, "name", "left").select("name", F.col("m.item").alias("item"), F.col("m.d").alias("distance"))


def name_by_size(groups: DataFrame, known: DataFrame) -> DataFrame:
    """Groups (name, n) in order of size take the names of a list in turn; beyond its end a counter is added."""
    total = known.count()
    if total > MOST_KNOWN:
        raise ValueError(f"more than {MOST_KNOWN} known items")
    ranked = numbered(groups.select("name", "n", (-F.col("n")).alias("least")), [], ["least", "name"], "k").withColumn("k", F.col("k") - 1)
    out = ranked.withColumn("pos", F.col("k") % total).join(F.broadcast(known), "pos")
    return out.select("name", "n", F.when(F.col("k") < total, F.col("item")).otherwise(F.concat("item", F.lit("_"), F.floor(F.col("k") / total).cast("string"))).alias("given"))


def path_parts(path: Column) -> Column:
    """(folder, file, stem, extension) of a path or URL."""
    parts = F.filter(F.split(path, "/"), lambda x: x != "")
    file = F.element_at(parts, -1)
    return F.struct(F.try_element_at(parts, F.lit(-2)).alias("folder"), file.alias("file"), F.regexp_replace(file, r"\.[^.]*$", "").alias("stem"), F.regexp_extract(file, r"\.([^.]*)$", 1).alias("extension"))
