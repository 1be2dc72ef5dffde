"""The text rules as SQL functions, for users who write SQL."""

from __future__ import annotations

from pyspark.sql import SparkSession

from supportlens import constants as C
from supportlens.functions import text as X


def _text(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _list(values: list[str]) -> str:
    return ", ".join(_text(value) for value in values)


def function_bodies() -> dict[str, tuple[str, str]]:
    """Name -> (return type, SQL body over the argument ``t``)."""
    letters = _text(X.VIETNAMESE)
    plain = f"regexp_replace(lower(coalesce(t, '')), {_text(f'{X.PUNCTUATION_OR_DIGIT}+')}, '')"
    words = f"split({plain}, {_text(f'{X.SPACE}+')})"
    category = " ".join(
        "WHEN " + " OR ".join(f"contains(lower(t), {_text(word)})" for word in keywords)
        + f" THEN {_text(label)}"
        for label, keywords in C.KEYWORD_RULES
    )
    products = ", ".join(
        f"CASE WHEN contains(lower(t), {_text(word)}) THEN {_text('PRODUCT_TYPE:' + word)} ELSE '' END"
        for word in C.PRODUCT_TYPES
    )
    order_ids = f"regexp_extract_all(lower(coalesce(t, '')), {_text(C.ORDER_ID_PATTERN)}, 1)"
    return {
        "clean_text": (
            "STRING",
            f"CASE WHEN lower(coalesce(t, '')) RLIKE {letters}"
            f" THEN array_join(filter({words}, w -> w NOT IN ('', {_list(C.VIETNAMESE_STOPWORDS)})), ' ')"
            f" ELSE array_join(filter({words}, w -> w NOT IN ('', {_list(C.ENGLISH_STOPWORDS)})), ' ') END",
        ),
        "detect_language": (
            "STRING",
            f"CASE WHEN t IS NULL THEN 'unknown' WHEN lower(t) RLIKE {letters} THEN 'vi' ELSE 'en' END",
        ),
        "extract_entities": (
            "ARRAY<STRING>",
            f"concat(transform({order_ids}, n -> concat('ORDER_ID:', n)), array_remove(array({products}), ''))",
        ),
        "keyword_category": ("STRING", f"CASE {category} ELSE {_text(C.DEFAULT_CATEGORY)} END"),
    }


def register_functions(spark: SparkSession) -> None:
    """Make the text rules callable from ``spark.sql``."""
    for name, (returns, body) in function_bodies().items():
        spark.sql(
            f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(t STRING) RETURNS {returns} RETURN {body}"
        )
