"""Record formats: sectioned VBO text, big-endian KLV blobs, append-only JSON lines, file listings."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Fixed values of the formats.
VIDEO_GLOB = "*.{mp4,mov,m4v,MP4,MOV,M4V}"
KLV_FORMATS = {"b": "b", "B": "B", "s": "h", "S": "H", "l": "i", "L": "I", "f": "f", "d": "d", "j": "q", "J": "Q"}
KLV_SCHEMA = "path string, key string, kind string, ordinal int, row int, numbers array<double>, text string"


def vbo_rows(files: DataFrame, path: str = "path", text: str = "value") -> DataFrame:
    """Data rows of VBO files given whole: ``path``, ``ordinal``, ``utc``, ``fields`` (map of the file's own column names to numbers).

    Sections are lines in brackets; the first column-name line names the data's columns. The date is the one in the
    comments or the header; times are HHMMSS.cc, and one that is earlier than the first has passed midnight. A damaged
    number is null; a file without names or data gives no rows.
    """
    lines = files.select(F.col(path).alias("path"), F.posexplode(F.split(text, r"\r?\n")).alias("_i", "_line"))
    w = Window.partitionBy("path").orderBy("_i").rowsBetween(Window.unboundedPreceding, 0)
    section = F.lower(F.regexp_extract(F.trim("_line"), r"^\[(.*)\]$", 1))
    marked = lines.withColumn("_section", F.last(F.when(section != "", section), ignorenulls=True).over(w)).where((F.trim("_line") != "") & ~F.trim("_line").startswith("["))
    date = F.regexp_extract("_line", r"(\d{2})/(\d{2})/(\d{4})", 0)
    heads = lines.groupBy("path").agg(F.min(F.when(date != "", F.struct("_i", date.alias("d"))))["d"].alias("_date"))
    names = marked.where("_section = 'column names'").groupBy("path").agg(F.min(F.struct("_i", "_line"))["_line"].alias("_names"))
    data = marked.where("_section = 'data'").join(names, "path").join(heads, "path")
    numbers = F.transform(F.split(F.trim("_line"), r"\s+"), lambda x: x.try_cast("double"))
    keys = F.split(F.trim("_names"), r"\s+")
    data = data.select("path", "_i", "_date", keys.alias("_k"), numbers.alias("_v"))
    short = F.least(F.size("_k"), F.size("_v"))
    data = data.withColumn("fields", F.map_from_arrays(F.slice("_k", 1, short), F.slice("_v", 1, short)))
    clock = F.try_element_at("fields", F.lit("time"))
    seconds = F.floor(clock / 10000) * 3600 + F.floor(F.pmod(clock, F.lit(10000.0)) / 100) * 60 + F.pmod(clock, F.lit(100.0))
    order = Window.partitionBy("path").orderBy("_i")
    day = F.unix_timestamp(F.try_to_timestamp("_date", F.lit("dd/MM/yyyy")))
    first = F.first("_s", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    timed = data.withColumn("_s", seconds).withColumn("_first", first)
    utc = day + F.col("_s") + F.when(F.col("_s") < F.col("_first"), F.lit(86400.0)).otherwise(F.lit(0.0))
    return timed.select("path", (F.row_number().over(order) - 1).alias("ordinal"), utc.alias("utc"), "fields")


def read_vbo(spark: SparkSession, path: str) -> DataFrame:
    """``vbo_rows`` of every ``.vbo`` file under a folder."""
    whole = spark.read.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.vbo").text(path)
    return vbo_rows(whole.select(F.input_file_name().alias("path"), "value"))


def klv_items(data: bytes, path: str = "") -> Iterator[tuple[str, str, str, int, int, list[float] | None, str | None]]:
    """Leaves of a key-length-value blob: (path, key, kind, ordinal, row, numbers, text).

    Four letters of key, a kind, a size and a big-endian count; items are padded to four bytes; kind 0 nests. Numbers
    are divided by the scales that their siblings before them state. A truncated item ends its level.
    """
    at, ordinal, scales = 0, 0, []
    while at + 8 <= len(data):
        key, kind, size, count = data[at : at + 4].decode("latin-1"), data[at + 4], data[at + 5], int.from_bytes(data[at + 6 : at + 8], "big")
        body = data[at + 8 : at + 8 + size * count]
        if len(body) < size * count:
            return
        at += 8 + (size * count + 3) // 4 * 4
        if kind == 0:
            yield from klv_items(body, f"{path}/{key}:{ordinal}")
        elif (letter := chr(kind)) in KLV_FORMATS and size:
            unit = struct.calcsize(">" + KLV_FORMATS[letter])
            rows = [list(map(float, struct.unpack(f">{size // unit}{KLV_FORMATS[letter]}", body[i : i + size // unit * unit]))) for i in range(0, len(body), size)]
            if key == "SCAL":
                scales = [x for r in rows for x in r]
            elif scales:
                rows = [[x / ((scales[i] if len(scales) > 1 and i < len(scales) else scales[0]) or 1) for i, x in enumerate(r)] for r in rows]
            for n, r in enumerate(rows):
                yield path, key, letter, ordinal, n, r, None
        else:
            yield path, key, letter, ordinal, 0, None, body.split(b"\0")[0].decode("latin-1")
        ordinal += 1


def klv_rows(blobs: DataFrame, blob_id: str, blob: str) -> DataFrame:
    """``blob_id`` and the leaves of each blob; null and damaged blobs give what can be read of them."""
    kind = blobs.schema[blob_id].dataType.simpleString()

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(i, *x) for i, b in zip(f[blob_id], f[blob]) if b is not None for x in klv_items(bytes(b))]
            yield pd.DataFrame(rows, columns=[blob_id, "path", "key", "kind", "ordinal", "row", "numbers", "text"])

    return blobs.select(blob_id, blob).mapInPandas(read, f"`{blob_id}` {kind}, {KLV_SCHEMA}")


def vote_lines(lines: DataFrame, schema: str, line: str = "value", unique: tuple[str, ...] = ("key", "machine_id", "voted_at", "vote")) -> DataFrame:
    """Rows of JSON lines; damaged and half-written ones are left out, and each vote is taken once."""
    row = F.from_json(line, schema)
    return lines.select(row.alias("_r")).where(F.col("_r").isNotNull() & F.col(f"_r.{unique[0]}").isNotNull()).select("_r.*").dropDuplicates(list(unique))


def list_videos(spark: SparkSession, paths: list[str], exclude: tuple[str, ...] = ()) -> DataFrame:
    """Video files under folders (path, length, time), no hidden ones, none whose path contains an excluded word, each once."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", VIDEO_GLOB).load(paths).select("path", "length", "modificationTime")
    keep: Column = ~F.col("path").rlike(r"/\.|\.fcpbundle/|__AsyncCopying")
    for word in exclude:
        keep = keep & ~F.contains(F.lower("path"), F.lit(word.lower()))
    return files.where(keep).dropDuplicates(["path"])


def write_moments(moments: DataFrame, path: str, by: str = "date_label") -> None:
    """Moments as JSON, a folder for each day."""
    moments.write.mode("overwrite").partitionBy(by).json(path)


def stale(listing: DataFrame, plan: DataFrame, name: str = "name") -> DataFrame:
    """Files that no row of the plan names any more."""
    return listing.join(plan.select(name), name, "left_anti")
