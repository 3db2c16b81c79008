"""Entity types, redaction styles and presets as small dimension tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Codes, labels and default styles that results must agree on.
ENTITIES = [
    ("PERSON", "姓名", "people", "label"),
    ("STAFF", "医护", "people", "label"),
    ("ORG", "机构", "org", "label"),
    ("ADDRESS", "地址", "org", "label"),
    ("ID_CARD", "身份证号", "numbers", "label"),
    ("PHONE", "电话", "numbers", "label"),
    ("BANK_CARD", "银行卡号", "numbers", "label"),
    ("USCC", "机构代码", "numbers", "label"),
    ("EMAIL", "邮箱", "numbers", "label"),
    ("PLATE", "车牌", "numbers", "label"),
    ("MEDICAL_ID", "医疗编号", "medical", "label"),
    ("HANDWRITTEN_FIELD", "手写", "handwriting", "background"),
    ("SIGNATURE", "签名", "handwriting", "hatch"),
    ("SEAL", "印章", "handwriting", "background"),
    ("LOGO", "标识", "images", "background"),
    ("QRCODE", "条码", "images", "mosaic"),
    ("WATERMARK", "水印", "images", "background"),
    ("CUSTOM", "已删除", "people", "label"),
]
STYLES = ["label", "background", "replace", "mosaic", "hatch", "inpaint", "black"]
PRESETS = [("audit", "label", {}), ("public", "background", {"QRCODE": "background"}), ("print", "hatch", {}), ("classic", "black", {})]

CODES = [e[0] for e in ENTITIES]


def entities(spark: SparkSession) -> DataFrame:
    """code, label, entity_group, default_style; 18 rows."""
    return spark.createDataFrame(ENTITIES, "code string, label string, entity_group string, default_style string")


def styles(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(s, i) for i, s in enumerate(STYLES)], "style string, ord int")


def presets(spark: SparkSession) -> DataFrame:
    """One row for every preset and entity with the style it gives."""
    rows = [(p, code, overrides.get(code, style)) for p, style, overrides in PRESETS for code in CODES]
    return spark.createDataFrame(rows, "preset string, code string, style string")


def _lookup(code: Column, index: int) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for e in ENTITIES for x in (e[0], e[index])]), code)


def label_of(code: Column) -> Column:
    """Display label of an entity code, the code itself if unknown."""
    return F.coalesce(_lookup(code, 1), code)


def resolve_style(code: Column, chosen: Column, default: Column) -> Column:
    """The type's own style, else the caller's default, else the entity's, else label; unknown styles become label.

    chosen is the style picked for the type; empty strings count as not given.
    """
    empty = F.lit("")
    style = F.coalesce(F.nullif(chosen, empty), F.nullif(default, empty), _lookup(code, 3), F.lit("label"))
    return F.when(style.isin(*STYLES), style).otherwise(F.lit("label"))
