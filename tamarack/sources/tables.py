"""Sources and sinks: sitemap, manifest, cached pages, snapshots, staged cards, images."""

from __future__ import annotations

import struct
import zlib
from datetime import UTC, datetime

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

SITEMAP = "loc string, lastmod string"
MANIFEST = "map<string,struct<lastmod:string,scrapedAt:string,status:string,error:string>>"
CARD = "name string, subtitle string, cookMinutes int, servingCounts array<int>, ingredients array<struct<name:string,byServing:array<struct<quantity:double,unit:string,rawText:string>>>>, steps array<struct<heading:string,text:string,photoFile:string>>"


def sitemap(spark: SparkSession, path: str) -> DataFrame:
    """(url, lastmod) of sitemap files; entries without a location are dropped."""
    rows = spark.read.format("xml").option("rowTag", "url").schema(SITEMAP).load(path)
    return rows.select(F.trim("loc").alias("url"), F.trim("lastmod").alias("lastmod")).filter("url is not null and url <> ''")


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """(url, lastmod, scraped_at, status, error) of a JSON manifest keyed by URL."""
    rows = spark.read.text(path, wholetext=True).select(F.from_json("value", MANIFEST).alias("m"))
    return rows.select(F.explode("m").alias("url", "e")).select("url", "e.lastmod", F.col("e.scrapedAt").alias("scraped_at"), "e.status", "e.error")


def upsert_manifest(old: DataFrame, new: DataFrame) -> DataFrame:
    """Manifest rows with those of ``new`` put in the place of old ones of the same url; of repeated new ones the one scraped last counts."""
    last = new.groupBy("url").agg(F.max_by(F.struct("lastmod", "scraped_at", "status", "error"), F.struct("scraped_at", "status")).alias("e")).select("url", "e.*")
    return old.join(last.select("url"), "url", "left_anti").unionByName(last)


def write_manifest(rows: DataFrame, path: str) -> None:
    """One version of the manifest as lines of JSON, which large ones need; ``manifest_lines`` reads it."""
    rows.select("url", "lastmod", "scraped_at", "status", "error").write.mode("overwrite").json(path)


def manifest_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("url string, lastmod string, scraped_at string, status string, error string").json(path)


def cached_pages(spark: SparkSession, path: str) -> DataFrame:
    """(file, html) of a folder of cached pages; large folders should be packed into Parquet by ``write_pages``."""
    return spark.read.text(path, wholetext=True).select(F.regexp_extract(F.input_file_name(), r"([^/]+)$", 1).alias("file"), F.col("value").alias("html"))


def write_pages(pages: DataFrame, path: str) -> None:
    pages.select("url", "final_url", "html").write.mode("append").parquet(path)


def staged_cards(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(good, rejected) cards of JSON files; a card needs a name, ingredients and steps."""
    rows = spark.read.schema(CARD).option("multiLine", True).json(path).withColumn("file", F.input_file_name())
    good = F.coalesce((F.trim("name") != "") & (F.size("ingredients") > 0) & (F.size("steps") > 0), F.lit(False))
    return rows.filter(good), rows.filter(~good)


def snapshot(tables: dict[str, DataFrame], path: str, version: str | None = None) -> None:
    """A new version of all tables, as Parquet in a folder of its own; versions sort by name, by default the time. An existing one is an error."""
    version = version or datetime.now(UTC).strftime("%Y%m%dT%H%M%S.%f")
    for name, df in tables.items():
        df.write.mode("error").parquet(f"{path}/version={version}/{name}.parquet")


def versions(spark: SparkSession, path: str) -> list[str]:
    """Names of the versions in a folder, oldest first."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in fs.listStatus(root)] if fs.exists(root) else []
    return sorted(n.removeprefix("version=") for n in names if n.startswith("version="))


def restore(spark: SparkSession, path: str, names: list[str], version: str | None = None) -> dict[str, DataFrame]:
    """The named tables of a version, by default the last one."""
    version = version or versions(spark, path)[-1]
    return {n: spark.read.parquet(f"{path}/version={version}/{n}.parquet") for n in names}


def fetched_pages(urls: DataFrame, make_fetch) -> DataFrame:
    """(url, final_url, html, error) of pages; ``make_fetch()`` makes one function for each Python worker, from an address to (final address, text).

    What the function raises is the row's error, and no other row is lost by it. How many pages are
    fetched at once is the number of partitions.
    """

    def run(parts):
        fetch = make_fetch()
        for part in parts:
            rows = []
            for url in part["url"]:
                try:
                    rows.append((url, *fetch(url), None))
                except Exception as x:  # noqa: BLE001
                    rows.append((url, None, None, f"{type(x).__name__}: {x}"))
            yield pd.DataFrame(rows, columns=["url", "final_url", "html", "error"])

    return urls.select("url").filter("url is not null").mapInPandas(run, "url string, final_url string, html string, error string")


# Content types of image files.
CONTENT_TYPES = {"png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "webp": "image/webp"}


def image_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, content, content_type) of all image files below a folder; a type that is not known is PNG."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    types = F.create_map(*[F.lit(x) for kv in CONTENT_TYPES.items() for x in kv])
    return files.select("path", "content", F.coalesce(F.try_element_at(types, F.lower(F.substring_index("path", ".", -1))), F.lit("image/png")).alias("content_type"))


def draft_images(drafts: DataFrame, files: DataFrame, root: str) -> DataFrame:
    """(draft_id, step_no, image_url, text_url): addresses of a draft's step images, null where the file is not there.

    ``drafts``: draft_id, steps (their number); ``files``: draft_id, file (names in the draft's folder).
    """
    step = drafts.filter("steps > 0").select("draft_id", F.explode(F.sequence(F.lit(1), F.col("steps").cast("int"))).alias("step_no"))
    names = files.select("draft_id", F.col("file")).distinct()

    def there(rows: DataFrame, suffix: str, out: str) -> DataFrame:
        found = names.withColumnRenamed("file", "_file")
        rows = rows.withColumn("_file", F.concat(F.lit("step-"), F.col("step_no").cast("string"), F.lit(f"{suffix}.png")))
        marked = rows.join(found.withColumn("_there", F.lit(True)), ["draft_id", "_file"], "left")
        return marked.withColumn(out, F.when(F.col("_there"), F.concat_ws("/", F.lit(root), "draft_id", "_file"))).drop("_there", "_file")

    return there(there(step, "", "image_url"), "-text", "text_url").select("draft_id", "step_no", "image_url", "text_url")


def image_moves(files: DataFrame, commits: DataFrame, drafts_root: str, recipes_root: str) -> DataFrame:
    """(source, target) of every file of a committed draft: cover and step pictures go to the recipe's folder, previews nowhere (target null).

    ``commits``: draft_id, recipe_id; ``files``: draft_id, file. Files of other drafts are not in the result.
    """
    kept = F.col("file").rlike(r"^(cover|step-\d+)\.png$")
    rows = files.select("draft_id", "file").distinct().join(commits.select("draft_id", "recipe_id").distinct(), "draft_id")
    return rows.select(F.concat_ws("/", F.lit(drafts_root), "draft_id", "file").alias("source"), F.when(kept, F.concat_ws("/", F.lit(recipes_root), "recipe_id", "file")).alias("target"))


def step_presence(files: DataFrame) -> DataFrame:
    """(draft_id, last_step, present): greatest number of a step image and the set of those there, rising."""
    no = F.regexp_extract("file", r"^step-(\d+)\.png$", 1).try_cast("int")
    return files.select("draft_id", no.alias("n")).filter("n is not null").groupBy("draft_id").agg(F.max("n").alias("last_step"), F.array_sort(F.collect_set("n")).alias("present"))


def rendered_pages(files: DataFrame, render) -> DataFrame:
    """(path, page_no, image) of documents (path, content); ``render`` makes the images of all pages of one document's bytes."""

    def run(parts):
        for part in parts:
            rows = [(p, n, i) for p, c in zip(part["path"], part["content"], strict=True) for n, i in enumerate(render(c), 1)]
            yield pd.DataFrame(rows, columns=["path", "page_no", "image"])

    return files.select("path", "content").mapInPandas(run, "path string, page_no int, image binary")


def ocr_lines(crops: DataFrame, make_engine) -> DataFrame:
    """Lines of crops (crop_id, image): (crop_id, line_no, text, y, baseline, red).

    ``make_engine()`` makes one engine for each Python worker, a function from image bytes to lines
    (text, y0, y1, baseline (x0, y0, x1, y1) or None). Blank lines are left out, a baseline without width is null, y is the middle.
    """

    def run(parts):
        engine = make_engine()
        for part in parts:
            rows = []
            for crop, image in zip(part["crop_id"], part["image"], strict=True):
                lines = [(t.strip(), y0, y1, b) for t, y0, y1, b in engine(image) if t and t.strip()]
                for n, (text, y0, y1, b) in enumerate(lines):
                    base = dict(zip(("x0", "y0", "x1", "y1"), map(float, b), strict=True)) if b is not None and b[2] > b[0] else None
                    rows.append((crop, n, text, (y0 + y1) / 2, base, is_red(image, base)))
            yield pd.DataFrame(rows, columns=["crop_id", "line_no", "text", "y", "baseline", "red"])

    return crops.select("crop_id", "image").mapInPandas(run, "crop_id string, line_no int, text string, y double, baseline struct<x0: double, y0: double, x1: double, y1: double>, red boolean")


# How far the mean red of a line's box must lie above green and blue; least height of a line.
RED_LEAD, LEAST_HEIGHT = 15, 4


def pixels(image: bytes) -> np.ndarray | None:
    """(height, width, 3) of a PNG of 8 bits a channel without interlacing, grey, RGB or either with alpha; None for anything else."""
    if image[:8] != b"\x89PNG\r\n\x1a\n":
        return None
    at, data, head = 8, [], None
    while at + 8 <= len(image):
        n, kind = struct.unpack(">I4s", image[at : at + 8])
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", image[at + 8 : at + 21])
        elif kind == b"IDAT":
            data.append(image[at + 8 : at + 8 + n])
        at += 12 + n
    channels = {0: 1, 2: 3, 4: 2, 6: 4}.get(head[3]) if head else None
    if channels is None or head[2] != 8 or head[6]:
        return None
    width, height = head[:2]
    rows = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(height, 1 + width * channels)
    out = np.zeros((height, width, channels), np.uint8)
    above = np.zeros((width, channels), np.uint8)
    for y in range(height):
        line = rows[y, 1:].reshape(width, channels)
        if rows[y, 0] == 0:
            out[y] = line
        elif rows[y, 0] == 1:
            out[y] = np.cumsum(line, axis=0, dtype=np.uint8)
        elif rows[y, 0] == 2:
            out[y] = line + above
        else:
            left, corner = np.zeros(channels, np.int32), np.zeros(channels, np.int32)
            for x in range(width):
                up = above[x].astype(np.int32)
                if rows[y, 0] == 3:
                    guess = (left + up) // 2
                else:
                    p = left + up - corner
                    a, b, c = np.abs(p - left), np.abs(p - up), np.abs(p - corner)
                    guess = np.where((a <= b) & (a <= c), left, np.where(b <= c, up, corner))
                left, corner = (line[x] + guess) & 255, up
                out[y, x] = left
        above = out[y]
    colour = out[:, :, :1] if channels < 3 else out[:, :, :3]
    return np.repeat(colour, 3, axis=2) if channels < 3 else colour


def is_red(image: bytes, baseline: dict | None) -> bool:
    """Whether the box around a line is printed in red: its mean red leads green and blue. The box is twice the line's height; false without baseline or pixels."""
    picture = pixels(image) if baseline is not None and image else None
    if picture is None:
        return False
    high = max(LEAST_HEIGHT, baseline["y1"] - baseline["y0"])
    left, top = max(0, round(baseline["x0"])), max(0, round(baseline["y0"] - high))
    box = picture[top : top + max(1, round(2 * high)), left : left + max(1, round(baseline["x1"] - baseline["x0"]))]
    if not box.size:
        return False
    r, g, b = box.reshape(-1, 3).mean(axis=0)
    return bool(r - g > RED_LEAD and r - b > RED_LEAD)


def write_list(lines: DataFrame, path: str) -> None:
    lines.select("line").write.mode("overwrite").text(path)


@F.pandas_udf(StructType([StructField("width", IntegerType()), StructField("height", IntegerType())]))
def image_size(content: pd.Series) -> pd.DataFrame:
    """Width and height from the header of PNG, GIF and JPEG bytes; null where unknown."""

    def size(b: bytes | None) -> tuple[int | None, int | None]:
        if not b:
            return None, None
        if b[:8] == b"\x89PNG\r\n\x1a\n" and len(b) >= 24:
            return struct.unpack(">II", b[16:24])
        if b[:3] == b"GIF" and len(b) >= 10:
            return struct.unpack("<HH", b[6:10])
        i = 2
        while b[:2] == b"\xff\xd8" and i + 9 < len(b) and b[i] == 0xFF:
            if b[i + 1] in range(0xC0, 0xD0) and b[i + 1] not in (0xC4, 0xC8, 0xCC):
                h, w = struct.unpack(">HH", b[i + 5 : i + 9])
                return w, h
            i += 2 + struct.unpack(">H", b[i + 2 : i + 4])[0]
        return None, None

    out = pd.DataFrame([size(b) for b in content], columns=["width", "height"])
    return out.astype("Int32")
