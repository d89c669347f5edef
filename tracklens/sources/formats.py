"""Files of the domain: classification and feedback logs, song lengths, playlists, sidecars, checksums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracklens.sources.tables import CLASSIFICATIONS, FEEDBACK


def strict_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Records of all .jsonl files under ``path``; a line that is no JSON fails the job."""
    return spark.read.schema(schema).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.jsonl").option("mode", "FAILFAST").json(path)


def flat_json_lines(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """Records of the .jsonl files of one folder, not of those below; bad lines keep their text in _corrupt."""
    return spark.read.schema(schema).option("columnNameOfCorruptRecord", "_corrupt").json(f"{folder.rstrip('/')}/*.jsonl")


def classification_files(spark: SparkSession, path: str) -> DataFrame:
    """Records of classification_*.jsonl and features_*.jsonl under ``path`` (other files are ignored) with their kind, and the time in
    the file's name where the record has none."""
    stamp = F.regexp_extract(F.col("_metadata.file_name"), r"_(\d{4}-\d{2}-\d{2}(?:T[\d-]+Z?)?)", 1)

    def read(kind: str) -> DataFrame:
        rows = spark.read.schema(CLASSIFICATIONS).option("columnNameOfCorruptRecord", "_corrupt").option("recursiveFileLookup", "true").option("pathGlobFilter", f"{kind}_*.jsonl").json(path)
        return rows.where("_corrupt IS NULL").withColumn("kind", F.lit(kind)).withColumn("classified_at", F.coalesce("classified_at", F.nullif(stamp, F.lit(""))))

    return read("classification").unionByName(read("features"))


def feedback_days(spark: SparkSession, path: str) -> DataFrame:
    """Records of the files named events.jsonl in folders YYYY/MM/DD under ``path``, with that day."""
    rows = spark.read.schema(FEEDBACK).option("columnNameOfCorruptRecord", "_corrupt").json(f"{path.rstrip('/')}/*/*/*/events.jsonl")
    day = F.regexp_replace(F.regexp_extract(F.col("_metadata.file_path"), r"(\d{4}/\d{2}/\d{2})/events\.jsonl$", 1), "/", "-")
    return rows.where("_corrupt IS NULL").withColumn("day", F.to_date(day))


def append_by_day(rows: DataFrame, path: str, zone: str = "UTC") -> None:
    """Appends feedback (ts in UTC) as JSON lines in folders of the local day; song numbers that are not positive are left out."""
    day = F.from_utc_timestamp(F.to_timestamp("ts"), zone)
    parts = {"year": F.date_format(day, "yyyy"), "month": F.date_format(day, "MM"), "day": F.date_format(day, "dd")}
    song = F.when(F.col("song_index") > 0, F.col("song_index"))
    rows.withColumn("song_index", song).withColumns(parts).write.mode("append").partitionBy("year", "month", "day").json(path)


def canonical(row: dict[str, Column]) -> Column:
    """One line of JSON with its keys in order."""
    return F.to_json(F.struct(*[row[name].alias(name) for name in sorted(row)]))


def write_sidecar(rows: DataFrame, path: str) -> int:
    """Writes track_id and features (JSON text) as gzipped JSON lines in order of track_id, and returns how many had bad features ({})."""
    sound = F.coalesce(F.try_parse_json("features").isNotNull() & F.col("features").startswith("{"), F.lit(False))
    marked = rows.select("track_id", F.when(sound, F.col("features")).otherwise("{}").alias("features"), (~sound).alias("bad"))
    line = F.concat(F.lit('{"features":'), "features", F.lit(',"track_id":'), F.to_json(F.array("track_id")).substr(F.lit(2), F.length(F.to_json(F.array("track_id"))) - 2), F.lit("}"))
    marked.orderBy("track_id").select(line.alias("value")).write.option("compression", "gzip").text(path)
    return marked.where("bad").count()


def song_lengths(spark: SparkSession, path: str) -> DataFrame:
    """path, md5, ms (list) from a file of song lengths: a comment with the path before each line ``md5=m:ss.fff ...``."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\\r?\\n")).alias("at", "line"))
    named = F.last(F.when(F.col("line").startswith(";"), F.trim(F.substring("line", 2, 4096))), ignorenulls=True).over(Window.orderBy("at"))  # one file
    rows = lines.withColumn("path", named).where(F.col("line").rlike(r"^[0-9a-fA-F]{32}="))
    parts = F.split(F.trim(F.substring("line", 34, 1 << 20)), r"\s+")

    def ms(text: Column) -> Column:
        number = lambda i: F.regexp_extract(text, r"^(\d+):(\d{2})(?:\.(\d{1,3}))?", i)
        return (number(1).cast("long") * 60 + number(2).cast("long")) * 1000 + F.rpad(number(3), 3, "0").cast("long")

    return rows.select("path", F.lower(F.substring("line", 1, 32)).alias("md5"), F.transform(parts, ms).alias("ms"))


def playlist_lines(rows: DataFrame) -> DataFrame:
    """The lines of an extended M3U playlist of ``rows`` (place, sid_path, seconds), in order: n and value. Unknown length: -1."""
    name = F.element_at(F.split("sid_path", "/"), -1)
    info = F.concat(F.lit("#EXTINF:"), F.coalesce(F.floor("seconds"), F.lit(-1)).cast("string"), F.lit(","), name)
    lines = rows.select("place", F.posexplode(F.array(info, F.col("sid_path"))).alias("k", "value"))
    head = rows.sparkSession.createDataFrame([(0, "#EXTM3U")], "n long, value string")
    return head.unionByName(lines.select((F.col("place") * 2 + F.col("k") - 1).cast("long").alias("n"), "value"))


def checksums(spark: SparkSession, path: str) -> DataFrame:
    """path, sha256, size of every file under ``path``; files without bytes are not listed."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", F.sha2("content", 256).alias("sha256"), F.col("length").alias("size"))


def sid_files(spark: SparkSession, root: str) -> DataFrame:
    """path, title, author, released, songs, start_song, version of the .sid files under ``root``; files without a sound header are left out.

    The header is big-endian and fixed: four letters of magic, version at byte 5, songs at 15, start song at 17, then three texts of 32
    bytes in Latin-1."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.sid").load(root)
    number = lambda at: F.conv(F.hex(F.substring("content", at, 2)), 16, 10).cast("int")
    text = lambda at: F.trim(F.regexp_replace(F.decode(F.substring("content", at, 32), "ISO-8859-1"), "\\x00.*$", ""))
    magic = F.decode(F.substring("content", 1, 4), "US-ASCII")
    rows = files.where(F.col("length") >= 118).select("path", magic.alias("magic"), number(5).alias("version"), number(15).alias("songs"), number(17).alias("start_song"), text(23).alias("title"), text(55).alias("author"), text(87).alias("released"))
    return rows.where("magic IN ('PSID', 'RSID') AND version BETWEEN 1 AND 4 AND songs BETWEEN 1 AND 256 AND start_song BETWEEN 1 AND songs")
