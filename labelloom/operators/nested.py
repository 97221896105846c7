"""Nested scan payloads to related flat tables (problem 4).

One depth-first visit of each payload emits tagged rows: table tag, key, parent key and the
record itself as JSON. The tagged rows are the single intermediate: they can be written
partitioned by tag (:func:`write_tagged`) and every flat table is a filter on the tag plus a
schema (:func:`typed_table`), so a payload is parsed once for all tables that are read from one
such write; a query for a single table has the visitor emit that tag only.

Defined results
    * of several rows with one scan_id the one with the greatest ``ingested_at`` counts (null
      is the smallest; between equal times the greatest payload hash, so repeated rows
      give one result); rows with a null scan_id give no rows;
    * a null, empty or unparsable payload, or one whose root is not an object, gives no rows;
      a root that is a string holding JSON is decoded once more;
    * a null element keeps its position but gives no row; a bare value counts as element 0;
    * an empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelloom.session import table

TAGGED = (
    "scan_id string, child string, parent_child string, parent_pos int, pos int, record string"
)

#: Schemas of the flat tables, by tag; ``value`` stays JSON because writers disagree on its type.
BOX = "struct<x:double,y:double,w:double,h:double>"
SCHEMAS = {
    "declaration": f"field_id string, raw_text string, value string, unit string, bbox {BOX}, extraction_confidence double, present boolean, source string",
    "finding": f"rule_id string, citation string, outcome string, severity string, message string, field_id string, measured_value double, required_value double, unit string, evidence_bbox {BOX}, human_override string, confidence double",
    "span": f"text string, bbox {BOX}, confidence double, source_engine string, language string, ink_bbox {BOX}, photo int",
    "glyph": "cap_height_px double, cap_height_mm double, n_glyphs_measured int, measured_characters string",
    "ocr_photo": "photo int, total_s double, upright struct<turn:int,tilt:double>",
    "ocr_pass": "engine string, regions int, predict_s double",
}


def _elements(value):
    if value is None:
        return
    if isinstance(value, list):
        for i, v in enumerate(value):
            if v is not None:
                yield i, v
    else:
        yield 0, value


def _field(obj, name):
    return obj.get(name) if isinstance(obj, dict) else None


def _root(payload: str | None):
    if not payload:
        return None
    try:
        doc = json.loads(payload)
        if isinstance(doc, str):
            doc = json.loads(doc)
    except (ValueError, RecursionError):
        return None
    return doc if isinstance(doc, dict) else None


def visit(doc: dict) -> Iterator[tuple[str, str | None, int, int, object]]:
    """Depth-first: (tag, parent tag, parent position, position, record)."""
    for i, d in _elements(doc.get("declarations")):
        yield "declaration", None, -1, i, d
        glyph = _field(d, "glyph")
        if glyph is not None:
            yield "glyph", "declaration", i, 0, glyph
        for j, n in _elements(_field(d, "notes")):
            yield "note", "declaration", i, j, n
    for i, f in _elements(doc.get("findings")):
        yield "finding", None, -1, i, f
    for i, s in _elements(doc.get("spans")):
        yield "span", None, -1, i, s
    for i, p in _elements(doc.get("package_photos")):
        yield "package_photo", None, -1, i, p
    for i, p in _elements(_field(doc.get("ocr_stats"), "photos")):
        yield "ocr_photo", None, -1, i, p
        for j, x in _elements(_field(p, "passes")):
            yield "ocr_pass", "ocr_photo", i, j, x


def _text(record) -> str:
    s = record if isinstance(record, str) else json.dumps(record, ensure_ascii=False)
    return s.encode("utf-8", "replace").decode("utf-8")


def _emit(with_record: bool, tags: frozenset[str] | None = None):
    schema = pa.schema(
        [("scan_id", pa.string()), ("child", pa.string()), ("parent_child", pa.string()), ("parent_pos", pa.int32()), ("pos", pa.int32()), ("record", pa.string())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, payloads = b.column("scan_id").to_pylist(), b.column("payload").to_pylist()
            out: list[list] = [[], [], [], [], [], []]
            for scan_id, payload in zip(ids, payloads):
                doc = _root(payload)
                if doc is None:
                    continue
                for tag, parent, parent_pos, pos, record in visit(doc):
                    if tags is not None and tag not in tags:
                        continue
                    row = (scan_id, tag, parent, parent_pos, pos, _text(record) if with_record else None)
                    for column, v in zip(out, row):
                        column.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(out, schema)], schema=schema)

    return run


def latest_scans(scans: DataFrame) -> DataFrame:
    """(scan_id, payload) of the last stored row of each scan.

    The winner is found on narrow rows with a partial aggregate, so one scan stored again
    very often is no hot group; the payloads then move once, keyed by the whole version.
    """
    s = scans.where("scan_id is not null").select(
        "scan_id",
        F.coalesce(F.col("ingested_at").cast("timestamp"), F.timestamp_seconds(F.lit(-62135596800))).alias("_at"),
        F.xxhash64(F.coalesce("payload", F.lit(""))).alias("_h"),
        "payload",
    )
    last = s.groupBy("scan_id").agg(F.max(F.struct("_at", "_h")).alias("_v"))
    last = last.select("scan_id", "_v._at", "_v._h")
    return (
        s.join(last, ["scan_id", "_at", "_h"], "left_semi").dropDuplicates(["scan_id", "_at", "_h"]).select("scan_id", "payload")
    )


def flatten_payloads(scans: DataFrame, with_record: bool = True, tags: list[str] | None = None) -> DataFrame:
    """Child records of the last version of each scan as tagged rows (see ``TAGGED``); with ``tags`` only those, others are not serialised."""
    return latest_scans(scans).mapInArrow(_emit(with_record, frozenset(tags) if tags else None), TAGGED)


def write_tagged(tagged: DataFrame, path: str) -> None:
    """Write the tagged rows partitioned by tag; each tag is then read without the others."""
    tagged.write.mode("overwrite").partitionBy("child").parquet(path)


def typed_table(tagged: DataFrame, tag: str) -> DataFrame:
    """One flat table: key columns, parent key and the fields of the tag's schema."""
    rows = tagged.where(F.col("child") == tag)
    keys = ["scan_id", "parent_pos", "pos"]
    if tag in ("note", "package_photo"):
        return rows.select(*keys, F.col("record").alias("text"))
    rec = F.from_json("record", SCHEMAS[tag], {"mode": "PERMISSIVE"})
    return rows.select(*keys, rec.alias("r")).select(*keys, "r.*")


#: The root record's fields with what an old writer that lacks them means.
ROOT = "inspector_id string, image_path string, context struct<commodity_category:string,package_class:string,barcode:string>, coverage_complete boolean, declarations string, findings string, spans string"


def scan_roots(scans: DataFrame) -> DataFrame:
    """(scan_id, inspector_id, image_path, category, package_class, barcode, coverage_complete, n_declarations, n_findings, n_spans): one row a scan whose payload is an object.

    Missing keys get defaults: the category is other, the class retail, coverage incomplete, absent lists empty.
    """
    p = latest_scans(scans).where("payload is not null").withColumn("payload", F.when(F.col("payload").startswith('"'), F.from_json(F.concat(F.lit('{"x":'), "payload", F.lit("}")), "x string")["x"]).otherwise(F.col("payload")))
    r = p.where(F.trim("payload").startswith("{")).select("scan_id", F.from_json("payload", ROOT, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("r"), F.try_parse_json("payload").isNotNull().alias("ok")).where("ok")
    size = lambda c: F.coalesce(F.json_array_length(f"r.{c}"), F.when(F.col(f"r.{c}").isNotNull(), 1), F.lit(0))
    ctx = lambda c, default=None: F.coalesce(f"r.context.{c}", F.lit(default)).alias(c.removeprefix("commodity_"))
    return r.select("scan_id", "r.inspector_id", "r.image_path", ctx("commodity_category", "other"), ctx("package_class", "retail"), ctx("barcode"), F.coalesce("r.coverage_complete", F.lit(False)).alias("coverage_complete"), size("declarations").alias("n_declarations"), size("findings").alias("n_findings"), size("spans").alias("n_spans"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flatten_payloads(table(spark, sf_dir, "scans"), with_record=False).select("scan_id", "child", "parent_pos", "pos")


def _typed(tag: str):
    def q(spark: SparkSession, sf_dir: str) -> DataFrame:
        return typed_table(flatten_payloads(table(spark, sf_dir, "scans"), tags=[tag]), tag)

    return q


QUERIES = {"p4_found": p4_found} | {f"p4_{t}s": _typed(t) for t in [*SCHEMAS, "note", "package_photo"] if t != "ocr_pass"} | {"p4_ocr_passes": _typed("ocr_pass"), "p4_scans": lambda spark, d: scan_roots(table(spark, d, "scans"))}


def _elements_sql(x: str) -> str:
    return f"CASE json_type({x}) WHEN 'ARRAY' THEN json_extract({x}, '$[*]') WHEN 'NULL' THEN []::JSON[] ELSE [{x}] END"


def _children_sql(source: str, key: str, x: str, child: str, parent: str) -> str:
    inner = f"SELECT scan_id, {parent} parent_pos, {_elements_sql(x)} e FROM {source} WHERE {x} IS NOT NULL"
    return f"SELECT scan_id, '{child}' child, parent_pos, generate_subscripts(e, 1) - 1 pos, unnest(e) v FROM ({inner})"


_LIVE = "WHERE json_type(v) <> 'NULL'"

ORACLE = {
    "p4_found": f"""WITH l AS (SELECT scan_id, payload FROM (SELECT *, row_number() OVER (PARTITION BY scan_id ORDER BY ingested_at DESC) rn FROM scans WHERE scan_id IS NOT NULL) WHERE rn = 1),
 p AS (SELECT scan_id, CASE WHEN json_valid(payload) THEN CASE WHEN json_type(payload) = 'VARCHAR' THEN CASE WHEN json_valid(payload::JSON ->> '$') THEN (payload::JSON ->> '$')::JSON END ELSE payload::JSON END END j FROM l),
 o AS (SELECT * FROM p WHERE json_type(j) = 'OBJECT'),
 d AS (SELECT * FROM ({_children_sql("o", "scan_id", "(j -> '$.declarations')", "declaration", "-1")}) {_LIVE}),
 h AS (SELECT * FROM ({_children_sql("o", "scan_id", "(j -> '$.ocr_stats.photos')", "ocr_photo", "-1")}) {_LIVE}),
 a AS (SELECT scan_id, child, parent_pos, pos FROM d UNION ALL SELECT scan_id, child, parent_pos, pos FROM h
  UNION ALL SELECT scan_id, child, parent_pos, pos FROM ({_children_sql("o", "scan_id", "(j -> '$.findings')", "finding", "-1")}) {_LIVE}
  UNION ALL SELECT scan_id, child, parent_pos, pos FROM ({_children_sql("o", "scan_id", "(j -> '$.spans')", "span", "-1")}) {_LIVE}
  UNION ALL SELECT scan_id, child, parent_pos, pos FROM ({_children_sql("o", "scan_id", "(j -> '$.package_photos')", "package_photo", "-1")}) {_LIVE}
  UNION ALL SELECT scan_id, 'glyph', pos, 0 FROM d WHERE json_type(v -> '$.glyph') <> 'NULL'
  UNION ALL SELECT scan_id, child, parent_pos, pos FROM ({_children_sql("d", "scan_id", "(v -> '$.notes')", "note", "pos")}) {_LIVE}
  UNION ALL SELECT scan_id, child, parent_pos, pos FROM ({_children_sql("h", "scan_id", "(v -> '$.passes')", "ocr_pass", "pos")}) {_LIVE})
SELECT scan_id, child, parent_pos, pos FROM a"""
}
_UPTO = ORACLE["p4_found"].split(",\n a AS (")[0]
_LEN = "CASE json_type(j -> '$.{0}') WHEN 'ARRAY' THEN json_array_length(j -> '$.{0}') WHEN 'NULL' THEN 0 ELSE CASE WHEN (j -> '$.{0}') IS NULL THEN 0 ELSE 1 END END"
_NOTES = _children_sql("d", "scan_id", "(v -> '$.notes')", "note", "pos")
_PHOTOS = _children_sql("o", "scan_id", "(j -> '$.package_photos')", "package_photo", "-1")
_PASSES = _children_sql("h", "scan_id", "(v -> '$.passes')", "ocr_pass", "pos")
_SAID = "CASE json_type(v) WHEN 'VARCHAR' THEN v ->> '$' ELSE CAST(v AS VARCHAR) END AS text"
ORACLE |= {
    "p4_notes": f"{_UPTO} SELECT scan_id, parent_pos, pos, {_SAID} FROM ({_NOTES}) {_LIVE}",
    "p4_package_photos": f"{_UPTO} SELECT scan_id, parent_pos, pos, {_SAID} FROM ({_PHOTOS}) {_LIVE}",
    "p4_ocr_passes": f"{_UPTO} SELECT scan_id, parent_pos, pos, v ->> '$.engine' AS engine, try_cast(v ->> '$.regions' AS INT) AS regions, try_cast(v ->> '$.predict_s' AS DOUBLE) AS predict_s FROM ({_PASSES}) {_LIVE}",
    "p4_glyphs": f"{_UPTO} SELECT scan_id, pos AS parent_pos, 0 AS pos, try_cast(g ->> '$.cap_height_px' AS DOUBLE) AS cap_height_px, try_cast(g ->> '$.cap_height_mm' AS DOUBLE) AS cap_height_mm, try_cast(g ->> '$.n_glyphs_measured' AS INT) AS n_glyphs_measured, g ->> '$.measured_characters' AS measured_characters FROM (SELECT scan_id, pos, v -> '$.glyph' g FROM d) WHERE json_type(g) <> 'NULL'",
    "p4_scans": f"{_UPTO} SELECT scan_id, j ->> '$.inspector_id' AS inspector_id, j ->> '$.image_path' AS image_path, coalesce(j ->> '$.context.commodity_category', 'other') AS category, coalesce(j ->> '$.context.package_class', 'retail') AS package_class, j ->> '$.context.barcode' AS barcode, coalesce(try_cast(j ->> '$.coverage_complete' AS BOOLEAN), false) AS coverage_complete, {_LEN.format('declarations')} AS n_declarations, {_LEN.format('findings')} AS n_findings, {_LEN.format('spans')} AS n_spans FROM o",
}
