"""Tables of the shapes the operators expect, derived from the given ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from supportlens import constants as C
from supportlens.functions.text import clean_text
from supportlens.operators.conversations import pair_turns
from supportlens.operators.terms import with_terms
from supportlens.session import materialize, spread
from supportlens.sources.messages import criteria_message, order_message

CATEGORY_SQL = (
    "CASE conv_id % 8 WHEN 0 THEN 'order_tracking' WHEN 1 THEN 'product_info' WHEN 2 THEN 'returns'"
    " WHEN 3 THEN 'shipping' WHEN 4 THEN 'payment' WHEN 5 THEN 'account'"
    " WHEN 6 THEN 'product_recommendation' ELSE 'general' END"
)
SOURCE_SQL = (
    "CASE conv_id % 3 WHEN 0 THEN 'twitter_customer_support' WHEN 1 THEN 'ecommerce_faq'"
    " ELSE 'product_database' END"
)
RAW_LABEL_SQL = (
    "CASE o_orderkey % 6 WHEN 0 THEN ' Returns ' WHEN 1 THEN 'Intent: shipping' WHEN 2 THEN 'It is payment.'"
    " WHEN 3 THEN 'Sentiment: NEGATIVE' WHEN 4 THEN 'a: b: account' ELSE 'no idea' END"
)
RAW_SENTIMENT_SQL = (
    "CASE o_orderpriority WHEN '1-URGENT' THEN 'Sentiment: NEGATIVE' WHEN '2-HIGH' THEN ' negative'"
    " WHEN '5-LOW' THEN 'Quite positive.' ELSE 'unclear' END"
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents, for operators that do much work per text."""
    return spread(table(spark, sf_dir, "documents"), "doc_id")


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations")


def qa(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Question/answer pairs: every user turn with the assistant turn after it."""
    return pair_turns(turns(spark, sf_dir)).select(
        (F.col("conv_id") * 100 + F.col("turn")).alias("qa_id"),
        "question",
        "answer",
        F.expr(CATEGORY_SQL).alias("category"),
        F.expr(SOURCE_SQL).alias("source"),
    )


def utterances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages as the service builds them for orders and products, and the user turns."""
    orders = table(spark, sf_dir, "orders").select(
        F.concat(F.lit("o"), "o_orderkey").alias("utt_id"), order_message("o_orderkey").alias("text")
    )
    part = table(spark, sf_dir, "part")
    info = part.select(
        F.concat(F.lit("p"), "p_partkey"),
        F.format_string(C.PRODUCT_ID_MESSAGE, F.col("p_partkey").cast("string")),
    )
    wishes = part.withColumn("criteria", F.concat(F.lit("looks like a "), "p_name")).select(
        F.concat(F.lit("r"), "p_partkey"), criteria_message("criteria")
    )
    user = turns(spark, sf_dir).where("role = 'user'").select(
        F.concat(F.lit("c"), "conv_id", F.lit("_"), "turn"), "text"
    )
    return orders.union(info).union(wishes).union(user)


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Instruction records with whole texts; one source records no response, one no length."""
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("rec_id"),
        F.col("text").alias("instruction"),
        F.when(F.col("source") != "src3", F.col("text")).alias("response"),
        F.col("source").alias("category"),
        F.concat_ws("_", "source", "lang").alias("intent"),
        F.when(F.col("lang") != "en", F.col("lang")).alias("flags"),
        F.when(F.col("source") != "src7", F.col("n_chars").cast("double")).alias("n_chars"),
    )


def feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        "event_id",
        F.col("user_id").alias("session_id"),
        (F.col("event_id") % 6 + 1).cast("int").alias("rating"),
        F.col("event_type").alias("comment"),
        "ts",
    )


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns(spark, sf_dir).select(F.col("conv_id").alias("session_id"))


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document language against a guess that is wrong for some lengths."""
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("pred_id"),
        F.col("lang").alias("actual"),
        F.when(F.col("n_chars") % 5 == 0, "en").otherwise(F.col("lang")).alias("predicted"),
    )


def category_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document source against a guess that is wrong for some lengths."""
    return table(spark, sf_dir, "documents").select(
        F.col("source").alias("actual"), F.when(F.col("n_chars") % 7 == 0, "src0").otherwise(F.col("source")).alias("predicted")
    )


def run_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One run per event type with losses and accuracies per day."""
    return (
        table(spark, sf_dir, "events")
        .groupBy(F.col("event_type").alias("run_id"), F.dayofmonth("ts").alias("epoch"))
        .agg(
            F.round(F.avg("value"), 6).alias("validation_loss"),
            F.round(F.avg("value") / 2, 6).alias("training_loss"),
            F.round(F.avg((F.col("event_id") % 3 == 0).cast("double")) * 100, 6).alias("validation_accuracy"),
            F.round(F.avg((F.col("event_id") % 4 > 0).cast("double")) * 100, 6).alias("training_accuracy"),
        )
    )


def model_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("out_id"),
        F.expr(RAW_LABEL_SQL).alias("raw"),
        F.expr(RAW_SENTIMENT_SQL).alias("raw_sentiment"),
    )


def conversation_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw model answers per conversation."""
    return model_outputs(spark, sf_dir).select(
        F.col("out_id").alias("conv_id"), F.col("raw").alias("raw_intent"), "raw_sentiment"
    )


def measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines with gaps: zero discounts and taxes, and one return flag, count as missing."""
    return table(spark, sf_dir, "lineitem").select(
        "l_quantity",
        "l_extendedprice",
        F.nullif("l_discount", F.lit(0.0)).alias("l_discount"),
        F.nullif("l_tax", F.lit(0.0)).alias("l_tax"),
        F.nullif("l_returnflag", F.lit("N")).alias("l_returnflag"),
        "l_linestatus",
        F.when(F.col("l_returnflag") == "R", F.col("l_linestatus")).alias("return_status"),
    )


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(
        F.col("p_name").alias("name"),
        F.concat(F.col("p_brand"), F.lit(", size "), F.col("p_size")).alias("specs"),
        F.format_string("%.2f", "p_retailprice").alias("price"),
        F.expr(
            "CASE p_type WHEN 'PROMO' THEN 'Gaming' WHEN 'LARGE' THEN 'Workstation'"
            " WHEN 'ECONOMY' THEN 'Budget' ELSE p_type END"
        ).alias("category"),
    )


def product_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests with an id, with a name only, or with neither."""
    return table(spark, sf_dir, "part").select(
        "p_partkey",
        F.when(~F.col("p_type").isin("PROMO", "LARGE"), F.col("p_partkey").cast("string")).alias("product_id"),
        F.when(F.col("p_type") != "LARGE", F.col("p_name")).otherwise("").alias("product_name"),
    )


def cleaned_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return texts(spark, sf_dir).select(
        "doc_id", "lang", "source", clean_text("text").alias("cleaned")
    )


def document_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms of the cleaned texts, written once for operators that read them several times."""
    rows = with_terms(cleaned_documents(spark, sf_dir), "cleaned")
    return materialize(rows.select("doc_id", "terms"), "terms")


def utterance_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = utterances(spark, sf_dir).withColumn("cleaned", clean_text("text"))
    return materialize(with_terms(rows, "cleaned").select("utt_id", "terms"), "terms")
