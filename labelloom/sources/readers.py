"""Sources: recogniser dumps, line manifests, registries, stored scans, image files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelloom.functions import geometry
from labelloom.functions.text import visible

REGION = "struct<text:string,score:double,poly:array<array<double>>,engine:string,language:string,alt_text:string,alt_score:double,tl_angle:int,vertical:boolean>"
DUMP = f"source string, ocr_input_shape array<int>, stats struct<upright:struct<turn:int,tilt:double>,ocr_scale:double,regions:int>, regions array<{REGION}>"
MANIFEST = "image_path string, px_per_mm double, fields array<struct<field_id:string,text:string,x:double,y:double,w:double,h:double,cap_height_mm:double>>"


def recogniser_dumps(spark: SparkSession, path: str, encoding: str = "UTF-8") -> DataFrame:
    """Recorded regions as spans: one row per region with visible text.

    (name, region_no, text, x, y, w, h, confidence, source_engine, lang, vertical, angle, variant: what stands between name and ending). The
    schema is fixed, missing keys are null, files that are no JSON give no rows.
    """
    raw = spark.read.schema(DUMP + ", _corrupt_record string").options(multiLine=True, mode="PERMISSIVE", encoding=encoding).json(path)
    file = F.col("_metadata.file_name")
    variant = F.coalesce(F.nullif(F.regexp_extract(file, "^[^.]+[.](.+)[.](?:paddle|lines|dump)[.]json$", 1), F.lit("")), F.lit("default"))
    rows = raw.select(F.regexp_extract(file, "^([^.]+)", 1).alias("name"), variant.alias("variant"), F.posexplode("regions").alias("region_no", "r"))
    b = geometry.polygon_box(F.col("r.poly"))
    spans = rows.select("name", "variant", "region_no", visible(F.col("r.text")).alias("text"), b.alias("b"), F.col("r.score").alias("confidence"), F.col("r.engine").alias("source_engine"), F.col("r.language").alias("lang"), "r.vertical", geometry.polygon_angle(F.col("r.poly")).alias("angle"))
    vertical = F.coalesce("vertical", geometry.is_vertical(F.col("b.w"), F.col("b.h"), F.col("text")))
    return spans.where("text <> ''").select("name", "region_no", "text", "b.x", "b.y", "b.w", "b.h", "confidence", "source_engine", "lang", vertical.alias("vertical"), "angle", "variant")


def line_manifests(spark: SparkSession, path: str, homography: list[list[float]] | None = None) -> DataFrame:
    """Known lines of rendered labels as spans; box corners go through a 3x3 homography if given."""
    rows = spark.read.schema(MANIFEST).option("multiLine", True).json(path).select("image_path", "px_per_mm", F.posexplode("fields").alias("line_no", "f"))
    if homography is None:
        return rows.select("image_path", "px_per_mm", "line_no", "f.*")
    m = homography

    def mapped(x, y):
        z = x * m[2][0] + y * m[2][1] + m[2][2]
        return F.array((x * m[0][0] + y * m[0][1] + m[0][2]) / z, (x * m[1][0] + y * m[1][1] + m[1][2]) / z)

    x, y, w, h = (F.col(f"f.{c}") for c in "xywh")
    box = geometry.polygon_box(F.array(mapped(x, y), mapped(x + w, y), mapped(x + w, y + h), mapped(x, y + h)))
    return rows.select("image_path", "px_per_mm", "line_no", "f.field_id", "f.text", box.alias("b")).select("image_path", "px_per_mm", "line_no", "field_id", "text", "b.*")


def registry(spark: SparkSession, path: str, role: str) -> DataFrame:
    """People of one role from a JSON list of {uid, name, email, status}."""
    return spark.read.schema("uid string, name string, email string, status string").option("multiLine", True).json(path).withColumn("role", F.lit(role))


def stored_scans(spark: SparkSession, path: str) -> DataFrame:
    """The scan store as written by :mod:`labelloom.sources.sinks` (or any parquet of its columns)."""
    return spark.read.parquet(path)


def images(spark: SparkSession, path: str, most_bytes: int = 25_000_000) -> DataFrame:
    """(path, kind, ok, why, sha1) of image files by size and header; the content is not decoded.

    Empty files give no row (Spark's file listing leaves them out). sha1 keys a cache of what was already recognised: an anti-join drops known pictures.
    """
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    head = F.hex(F.substring("content", 1, 12))
    tail = F.hex(F.expr("substring(content, -2, 2)"))
    kind = (
        F.when(head.startswith("FFD8FF"), "jpeg").when(head.startswith("89504E470D0A1A0A"), "png").when(F.substring(head, 9, 8) == "66747970", "heif").when(head.startswith("52494646") & (F.substring(head, 17, 8) == "57454250"), "webp")
    )
    why = (
        F.when(F.col("length") > most_bytes, "too large").when(kind.isNull(), "unknown format").when(kind == "heif", "unsupported format").when((kind == "jpeg") & (tail != "FFD9"), "truncated")
    )
    return f.select("path", kind.alias("kind"), why.isNull().alias("ok"), why.alias("why"), F.sha1("content").alias("sha1"))
