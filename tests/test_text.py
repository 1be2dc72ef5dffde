import string

import pytest
from pyspark.sql import functions as F

from supportlens import constants as C
from supportlens.functions import text as X
from supportlens.functions.sql import register_functions

TEXTS = [
    "I don't know",
    "$+<=>^",
    "Where is order #12 and ORDER  34, orders 9?",
    "My smartphone and my Laptop",
    "Một đơn hàng của tôi",
    "été",
    "tabs\tand wide　spaces",
    "x ٣٤ 56 y",
    "",
    None,
]


def plain_clean(text):
    """The cleaning rule in plain Python."""
    if text is None:
        return ""
    lowered = text.lower()
    kept = "".join(c for c in lowered if c not in string.punctuation and not c.isdecimal())
    vietnamese = any(c in C.VIETNAMESE_LETTERS for c in kept)
    stop = C.VIETNAMESE_STOPWORDS if vietnamese else C.ENGLISH_STOPWORDS
    return " ".join(w for w in kept.split() if w not in stop)


def one(spark, expression, *values):
    rows = spark.createDataFrame([(v,) for v in values], "t STRING").select(expression.alias("r"))
    return [row.r for row in rows.collect()]


def test_clean_text_follows_the_rule(spark):
    assert one(spark, X.clean_text("t"), *TEXTS) == [plain_clean(t) for t in TEXTS]


@pytest.mark.parametrize("text, cleaned", [("I don't know", "dont know"), ("$+<=>^", ""), (None, "")])
def test_clean_text_examples(spark, text, cleaned):
    assert one(spark, X.clean_text("t"), text) == [cleaned]


def test_every_character_is_classified_as_in_python(spark):
    characters = [chr(c) for c in range(1, 0x10000) if not 0xD800 <= c <= 0xDFFF]
    frame = spark.createDataFrame([(c,) for c in characters], "t STRING")
    found = frame.select(
        "t",
        F.size(X.words("t")).alias("words"),
        (X.strip("t") == "").alias("stripped"),
        F.col("t").rlike(X.PUNCTUATION_OR_DIGIT).alias("dropped"),
        F.col("t").rlike(X.VIETNAMESE).alias("vietnamese"),
        (F.size(X.term_tokens(F.concat("t", "t"))) == 1).alias("word"),
        (F.size(F.regexp_extract_all(F.concat("t", "t"), F.lit(C.WORD_TOKEN), F.lit(0))) == 1).alias("same"),
    ).collect()
    for row in found:
        space = row.t.isspace()
        assert (row.words == 0, row.stripped) == (space, space), hex(ord(row.t))
        assert row.word == row.same, hex(ord(row.t))
        if ord(row.t) < 0x300:
            assert row.word == (row.t.isalnum() or row.t == "_"), hex(ord(row.t))
        assert row.vietnamese == (row.t in C.VIETNAMESE_LETTERS)
        if ord(row.t) < 128:
            assert row.dropped == (row.t in string.punctuation or row.t.isdigit())


def test_word_count_and_language(spark):
    assert one(spark, X.word_count("t"), "a  b\nc", "", None) == [3, 0, 0]
    assert one(spark, X.detect_language("t"), "hello", "ĐƠN hàng", "été", None) == ["en", "vi", "vi", "unknown"]


def test_entities(spark):
    assert one(
        spark, X.extract_entities("t"), "Order #12 and order 34 orders 9", "My smartphone microphone", None
    ) == [["ORDER_ID:12", "ORDER_ID:34"], ["PRODUCT_TYPE:phone"], []]


def test_product_types_keep_list_order(spark):
    assert one(spark, X.extract_product_types("t"), "scanner, Mouse and laptop") == [
        ["PRODUCT_TYPE:laptop", "PRODUCT_TYPE:mouse", "PRODUCT_TYPE:scanner"]
    ]


@pytest.mark.parametrize(
    "question, category",
    [
        ("Where can I track it?", "order_tracking"),
        ("Do you cover return shipping costs?", "returns"),
        ("Shipping to Hanoi?", "shipping"),
        ("I was repaying it", "payment"),
        ("Which is the best laptop?", "product_recommendation"),
        ("Which colours has this item?", "product_info"),
        ("Hello", "general"),
        (None, "general"),
    ],
)
def test_keyword_category_first_rule_wins(spark, question, category):
    assert one(spark, X.keyword_category("t"), question) == [category]


def test_normalize_labels(spark):
    raw = [" Returns ", "Intent: Returns.", "a: b: account", "order_tracking", "no idea", None]
    assert one(spark, X.normalize_intent("t"), *raw) == [
        "returns", "returns", "account", "order_tracking", "general", "general",
    ]
    assert one(spark, X.normalize_sentiment("t"), "Sentiment: NEGATIVE", "very positive", "?") == [
        "negative", "positive", "neutral",
    ]


def test_instruction_document_keeps_the_indent(spark):
    frame = spark.createDataFrame([("a", None, "c", "d ")], "i STRING, r STRING, c STRING, n STRING")
    text = frame.select(X.instruction_document("i", "r", "c", "n")).first()[0]
    gap = "\n" + " " * 16
    assert text == f"Instruction: a{gap}Response: None{gap}Category: c{gap}Intent: d"


def test_sql_functions_agree_with_columns(spark):
    register_functions(spark)
    spark.createDataFrame([(t,) for t in TEXTS], "t STRING").createOrReplaceTempView("texts")
    by_sql = spark.sql(
        "SELECT clean_text(t), detect_language(t), extract_entities(t), keyword_category(t) FROM texts"
    ).collect()
    by_column = spark.table("texts").select(
        X.clean_text("t"), X.detect_language("t"), X.extract_entities("t"), X.keyword_category("t")
    ).collect()
    assert [tuple(r) for r in by_sql] == [tuple(r) for r in by_column]


def test_terms_of_every_character_as_before(spark):
    # Latin-1 is listed one by one, as nested classes are tried character by character, nine times slower.
    ranges = r"[a-zA-Z0-9_[[^\x00-\x7F]&&[\p{L}\p{N}]]]{2,}"
    assert "a-z" not in X.TERM
    points = [p for p in range(0x11000) if not 0xD800 <= p < 0xE000]
    frame = spark.createDataFrame([(chr(p) * 2 + " " + chr(p) + "x",) for p in points], "t STRING")
    found = frame.select(X.term_tokens("t").alias("new"), F.regexp_extract_all("t", F.lit(ranges), F.lit(0)).alias("old"))
    assert found.where("new <> old OR new IS NULL").count() == 0 and found.where("size(new) > 0").count() > 50000
