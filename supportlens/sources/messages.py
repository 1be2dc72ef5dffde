"""Rows derived from products, orders and requests."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F

from supportlens import constants as C


def _fill(template: str, values: dict[str, Column]) -> Column:
    parts = re.split(r"\{(\w+)\}", template)
    return F.concat(*[values[p] if i % 2 else F.lit(p) for i, p in enumerate(parts)])


def expand_product_qa(products: DataFrame) -> DataFrame:
    """Two or three question/answer pairs per product (name, specs, price, category)."""
    values = {c: F.col(c).cast("string") for c in ("name", "specs", "price")}

    def pair(kind: str) -> Column:
        question, answer, category = C.PRODUCT_QUESTIONS[kind]
        return F.struct(
            _fill(question, values).alias("question"),
            _fill(answer, values).alias("answer"),
            F.lit(category).alias("category"),
        )

    category = F.col("category")
    use_case = (
        F.when(category.contains("Gaming"), pair("gaming"))
        .when(category.contains("Workstation"), pair("workstation"))
        .when(category.contains("Budget") | F.col("name").contains("Student"), pair("student"))
    )
    pairs = F.array_compact(F.array(pair("specs"), pair("price"), use_case))
    return products.select(F.inline(pairs)).withColumn("source", F.lit(C.PRODUCT_SOURCE))


def order_message(order_id: str) -> Column:
    return F.format_string(C.ORDER_MESSAGE, F.col(order_id).cast("string"))


def criteria_message(criteria: str) -> Column:
    return F.format_string(C.CRITERIA_MESSAGE, F.col(criteria))


def product_message(product_id: str, product_name: str) -> Column:
    """Message by id, else by name, else null."""

    def given(column: str) -> Column:
        return F.coalesce(F.col(column).cast("string") != "", F.lit(False))

    return F.when(
        given(product_id), F.format_string(C.PRODUCT_ID_MESSAGE, F.col(product_id).cast("string"))
    ).when(given(product_name), F.format_string(C.PRODUCT_NAME_MESSAGE, F.col(product_name)))


def product_messages(requests: DataFrame) -> DataFrame:
    """Accepted product requests with their message."""
    return requests.withColumn("message", product_message("product_id", "product_name")).where(
        F.col("message").isNotNull()
    )


def rejected_product_requests(requests: DataFrame) -> DataFrame:
    """Requests with neither id nor name."""
    return requests.where(product_message("product_id", "product_name").isNull())
