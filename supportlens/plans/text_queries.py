"""Queries over texts: sources, sinks, row functions and filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from supportlens import constants as C, schemas as S
from supportlens.functions import text as X
from supportlens.operators import aggregates as A, conversations as V, filters as L, lookups as J
from supportlens.operators import profile as P
from supportlens.plans import oracle_text as O, views
from supportlens.plans.profile_queries import DESCRIBED_SQL
from supportlens.plans.registry import query
from supportlens.session import work_folder
from supportlens.sinks import writers as W
from supportlens.sources import json_ranges as JR, messages as M, readers as R

PAIR_TEXT = "id || '|' || question || '|' || coalesce(answer, '') || '|' || source || '|' || category || '|'"


# --- sources and sinks -----------------------------------------------------------------


@query("SELECT question, answer, category, source, '2024-01-31 10:00:00' AS timestamp FROM qa", "qa")
def read_qa_csv(spark, sf_dir):
    return _csv_copy(spark, sf_dir)


@query("SELECT question, answer, category, source, '2024-01-31 10:00:00' AS timestamp FROM qa", "qa")
def write_csv_dated(spark, sf_dir):
    return _csv_copy(spark, sf_dir)


def _csv_copy(spark, sf_dir):
    rows = views.qa(spark, sf_dir).select(
        "question", "answer", "category", "source", F.lit("2024-01-31 10:00:00").alias("timestamp")
    )
    path = W.write_csv_dated(rows, work_folder(spark, "csv"), "20240131")
    return R.read_qa_csv(spark, path)


@query(
    """SELECT question, answer, category, source, '2024-02-01 10:00:00' AS timestamp
       FROM qa WHERE answer IS NOT NULL""",
    "qa",
)
def read_latest_file(spark, sf_dir):
    """Two dated copies are written; the later one has answered questions only."""
    folder = work_folder(spark, "dated")
    rows = views.qa(spark, sf_dir).drop("qa_id").select("question", "answer", "category", "source")
    W.write_csv_dated(rows.withColumn("timestamp", F.lit("2024-01-31 10:00:00")), folder, "20240131")
    answered = rows.where("answer IS NOT NULL").withColumn("timestamp", F.lit("2024-02-01 10:00:00"))
    W.write_csv_dated(answered, folder, "20240201")
    return R.read_latest_csv(spark, folder)


#: Small ranges, so that the small tables are read in several, too.
JSON_RANGE_BYTES = 1 << 20
RECORDS_SQL = "SELECT instruction, response, category, intent, flags FROM records"


def _json_copy(spark, sf_dir):
    rows = views.records(spark, sf_dir).select(*S.INSTRUCTION.fieldNames())
    return R.read_json_records(spark, W.write_json_records(rows, work_folder(spark, "json")))


@query(RECORDS_SQL, "records")
def read_json_records(spark, sf_dir):
    return _json_copy(spark, sf_dir)


@query(RECORDS_SQL, "records")
def write_json_records(spark, sf_dir):
    return _json_copy(spark, sf_dir)


GROUPED_SQL = f"""
    SELECT category, question, answer, source, array_to_string({O.entities('question')}, ',') AS entities
    FROM qa"""


def _grouped_copy(spark, sf_dir):
    grouped = V.group_pairs(views.qa(spark, sf_dir), "qa_id")
    path = W.write_grouped_json(grouped, work_folder(spark, "grouped"), "category", "pairs")
    return R.read_grouped_qa(spark, path).withColumn("entities", F.array_join("entities", ","))


@query(GROUPED_SQL, "qa")
def read_grouped_json(spark, sf_dir):
    return _grouped_copy(spark, sf_dir)


@query(GROUPED_SQL, "qa")
def write_grouped_json(spark, sf_dir):
    return _grouped_copy(spark, sf_dir)


@query(RECORDS_SQL, "records")
def read_json_array(spark, sf_dir):
    """Files of one array each, read in byte ranges."""
    rows = views.records(spark, sf_dir).select(*S.INSTRUCTION.fieldNames())
    path = W.write_json_arrays(rows, work_folder(spark, "arrays"))
    return JR.read_json_array(spark, path, S.INSTRUCTION, JSON_RANGE_BYTES)


@query(GROUPED_SQL, "qa")
def read_json_object(spark, sf_dir):
    """Files of one object each, group -> pairs, read in byte ranges."""
    grouped = V.group_pairs(views.qa(spark, sf_dir), "qa_id")
    path = W.write_json_objects(grouped, work_folder(spark, "objects"), "category", "pairs")
    rows = JR.read_json_groups(spark, path, S.GROUPED_QA.valueType.elementType, JSON_RANGE_BYTES)
    return rows.select(
        F.col("group").alias("category"),
        "item.question",
        "item.answer",
        "item.metadata.source",
        F.array_join(F.coalesce("item.metadata.entities", F.array().cast("array<string>")), ",").alias("entities"),
    )


@query("SELECT intent, instruction FROM records", "records")
def read_grouped_instructions(spark, sf_dir):
    grouped = V.group_examples(views.records(spark, sf_dir), "rec_id")
    path = W.write_grouped_json(grouped, work_folder(spark, "examples"), "intent", "examples")
    return R.read_grouped_instructions(spark, path)


@query(
    """SELECT CAST(session_id AS VARCHAR) AS session_id, rating, comment
       FROM feedback WHERE rating < 6""",
    "feedback",
)
def read_feedback_dir(spark, sf_dir):
    """Ratings of 6 are written as broken lines, which the reader has to skip."""
    rows = views.feedback(spark, sf_dir).select(
        F.col("session_id").cast("string").alias("session_id"),
        "rating",
        F.when(F.col("rating") != 2, F.col("comment")).alias("comment"),
        F.when(F.col("rating") == 2, F.col("comment")).alias("comments"),
    )
    line = F.to_json(F.struct("*"))
    path = work_folder(spark, "feedback")
    rows.select(
        F.when(F.col("rating") == 6, F.concat(F.lit('{"rating": 6, '), "session_id")).otherwise(line)
    ).write.text(path)
    return R.read_feedback(spark, path).select("session_id", "rating", "comment")


@query(
    """
    SELECT section, key, CAST(value AS DOUBLE) AS value FROM (
    SELECT 'missing_values' AS section, c AS key, CAST(n AS BIGINT) AS value FROM (
        SELECT unnest(['l_quantity', 'l_extendedprice', 'l_discount', 'l_tax', 'l_returnflag',
                       'l_linestatus', 'return_status']) AS c,
               unnest([count(*) - count(l_quantity), count(*) - count(l_extendedprice),
                       count(*) - count(l_discount), count(*) - count(l_tax),
                       count(*) - count(l_returnflag), count(*) - count(l_linestatus),
                       count(*) - count(return_status)]) AS n FROM measures)
    UNION ALL SELECT 'records', 'total_records', count(*) FROM measures
    UNION ALL SELECT 'records', 'duplicate_records',
        (SELECT count(*) FROM measures) - (SELECT count(*) FROM (SELECT DISTINCT * FROM measures))
    UNION ALL SELECT 'numeric_features', c, n FROM (
        SELECT unnest(['l_quantity', 'l_extendedprice', 'l_discount', 'l_tax']) AS c,
               unnest([count(l_quantity), count(l_extendedprice), count(l_discount), count(l_tax)]) AS n
        FROM measures)
    UNION ALL SELECT 'categorical_features', c, n FROM (
        SELECT unnest(['l_returnflag', 'l_linestatus', 'return_status']) AS c,
               unnest([count(l_returnflag), count(l_linestatus), count(return_status)]) AS n
        FROM measures))
    UNION ALL SELECT 'numeric_statistics', "column" || '.' || statistic, value FROM (
        SELECT "column", unnest(['count', 'mean', 'std', 'min', 'q25', 'q50', 'q75', 'max']) AS statistic,
               unnest([CAST(count AS DOUBLE), mean, std, "min", q25, q50, q75, "max"]) AS value FROM (
        """
    + DESCRIBED_SQL
    + "))",
    "measures",
)
def write_report(spark, sf_dir):
    report = P.report(views.measures(spark, sf_dir))
    path = W.write_report(report, work_folder(spark, "report"))
    return spark.read.schema("section STRING, key STRING, value DOUBLE").json(path)


@query(
    """SELECT session_id, rating, comment, event_id FROM feedback
       QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY ts DESC, event_id DESC) = 1""",
    "feedback",
)
def upsert_by_session(spark, sf_dir):
    """Store the feedback of one kind first, then commit the rest to the same store."""
    rows = views.feedback(spark, sf_dir)
    folder = work_folder(spark, "feedback")
    clicked = F.col("comment").eqNullSafe("click")
    W.upsert_by_session(rows.where(clicked), folder)
    return W.upsert_by_session(rows.where(~clicked), folder).select("session_id", "rating", "comment", "event_id")


@query("SELECT event_id, session_id, rating, comment FROM feedback", "feedback")
def append_feedback(spark, sf_dir):
    rows = views.feedback(spark, sf_dir).select("event_id", "session_id", "rating", "comment")
    path = work_folder(spark, "log")
    clicked = F.col("comment").eqNullSafe("click")
    W.append_records(rows.where(clicked), path)
    W.append_records(rows.where(~clicked), path)
    return spark.read.schema(rows.schema).json(path)


# --- rows built from products, orders and requests -----------------------------------------


EXPANDED_SQL = """
    SELECT 'What are the specifications of the ' || name || '?' AS question,
           'The ' || name || ' features ' || specs || '. It''s priced at $' || price || '.' AS answer,
           'product_info' AS category, 'product_database' AS source FROM products
    UNION ALL
    SELECT 'How much does the ' || name || ' cost?', 'The ' || name || ' is priced at $' || price || '.',
           'product_info', 'product_database' FROM products
    UNION ALL
    SELECT 'Is the ' || name || ' good for gaming?',
           'Yes, the ' || name || ' is specifically designed for gaming with its ' || specs
           || '. It offers excellent performance for modern games.',
           'product_recommendation', 'product_database' FROM products WHERE contains(category, 'Gaming')
    UNION ALL
    SELECT 'Can I use the ' || name || ' for video editing?',
           'Absolutely! The ' || name || ' is a powerful workstation with ' || specs || ', making it '
           || 'excellent for video editing, 3D modeling, and other demanding creative tasks.',
           'product_recommendation', 'product_database' FROM products
    WHERE NOT contains(category, 'Gaming') AND contains(category, 'Workstation')
    UNION ALL
    SELECT 'Is the ' || name || ' suitable for students?',
           'Yes, the ' || name || ' is an excellent choice for students. It''s affordable at $' || price
           || ' while offering ' || specs || ', which is perfect for schoolwork, research, and everyday tasks.',
           'product_recommendation', 'product_database' FROM products
    WHERE NOT contains(category, 'Gaming') AND NOT contains(category, 'Workstation')
      AND (contains(category, 'Budget') OR contains(name, 'Student'))"""


@query(EXPANDED_SQL, "products")
def expand_product_qa(spark, sf_dir):
    return M.expand_product_qa(views.products(spark, sf_dir))


@query("SELECT o_orderkey, 'I want to track my order #' || o_orderkey AS message FROM orders")
def message_from_order(spark, sf_dir):
    return views.table(spark, sf_dir, "orders").select(
        "o_orderkey", M.order_message("o_orderkey").alias("message")
    )


@query(
    """SELECT p_partkey, CASE WHEN product_id <> '' THEN 'Can you tell me about product #' || product_id || '?'
              ELSE 'Can you tell me about ' || product_name || '?' END AS message
       FROM product_requests WHERE coalesce(product_id, '') <> '' OR coalesce(product_name, '') <> ''""",
    "product_requests",
)
def message_from_product(spark, sf_dir):
    return M.product_messages(views.product_requests(spark, sf_dir)).select("p_partkey", "message")


@query(
    """SELECT p_partkey FROM product_requests
       WHERE coalesce(product_id, '') = '' AND coalesce(product_name, '') = ''""",
    "product_requests",
)
def message_from_product_rejects(spark, sf_dir):
    return M.rejected_product_requests(views.product_requests(spark, sf_dir)).select("p_partkey")


@query(
    """SELECT p_partkey, 'Can you recommend a product that looks like a ' || p_name || '?' AS message
       FROM part"""
)
def message_from_criteria(spark, sf_dir):
    part = views.table(spark, sf_dir, "part").withColumn(
        "criteria", F.concat(F.lit("looks like a "), "p_name")
    )
    return part.select("p_partkey", M.criteria_message("criteria").alias("message"))


# --- row functions -----------------------------------------------------------------------


def _documents(spark, sf_dir):
    return views.table(spark, sf_dir, "documents")


@query(O.clean_table("documents", "doc_id", "text"))
def clean_text(spark, sf_dir):
    return views.texts(spark, sf_dir).select("doc_id", X.clean_text("text").alias("cleaned"))


@query(
    f"SELECT doc_id, CAST(coalesce(len({O.words('text')}), 0) AS INT) AS n_words FROM documents"
)
def word_count(spark, sf_dir):
    return _documents(spark, sf_dir).select("doc_id", X.word_count("text").alias("n_words"))


@query("SELECT doc_id, CAST(length(text) AS INT) AS n FROM documents")
def char_length(spark, sf_dir):
    return _documents(spark, sf_dir).select("doc_id", X.char_length("text").alias("n"))


@query(f"SELECT qa_id, {O.language('question')} AS question_language, {O.language('answer')} AS answer_language FROM qa", "qa")
def detect_language(spark, sf_dir):
    return views.qa(spark, sf_dir).select(
        "qa_id",
        X.detect_language("question").alias("question_language"),
        X.detect_language("answer").alias("answer_language"),
    )


def _joined(column):
    return F.array_join(column, ",")


@query(f"SELECT utt_id, array_to_string({O.order_ids('text')}, ',') AS order_ids FROM utterances", "utterances")
def extract_order_ids(spark, sf_dir):
    return views.utterances(spark, sf_dir).select(
        "utt_id", _joined(X.extract_order_ids("text")).alias("order_ids")
    )


@query(f"SELECT utt_id, array_to_string({O.product_types('text')}, ',') AS product_types FROM utterances", "utterances")
def extract_product_types(spark, sf_dir):
    return views.utterances(spark, sf_dir).select(
        "utt_id", _joined(X.extract_product_types("text")).alias("product_types")
    )


@query(f"SELECT utt_id, array_to_string({O.entities('text')}, ',') AS entities FROM utterances", "utterances")
def extract_entities(spark, sf_dir):
    return views.utterances(spark, sf_dir).select(
        "utt_id", _joined(X.extract_entities("text")).alias("entities")
    )


@query(f"SELECT utt_id, {O.category('text')} AS category FROM utterances", "utterances")
def keyword_category(spark, sf_dir):
    return views.utterances(spark, sf_dir).select("utt_id", X.keyword_category("text").alias("category"))


@query(f"SELECT out_id, {O.intent('raw')} AS intent FROM model_outputs", "model_outputs")
def normalize_label_intent(spark, sf_dir):
    return views.model_outputs(spark, sf_dir).select("out_id", X.normalize_intent("raw").alias("intent"))


@query(f"SELECT out_id, {O.sentiment('raw_sentiment')} AS sentiment FROM model_outputs", "model_outputs")
def normalize_label_sentiment(spark, sf_dir):
    return views.model_outputs(spark, sf_dir).select(
        "out_id", X.normalize_sentiment("raw_sentiment").alias("sentiment")
    )


@query(f"SELECT rec_id, {O.strip('lower(instruction)')} AS instruction FROM records", "records")
def normalize_instruction(spark, sf_dir):
    return views.records(spark, sf_dir).select(
        "rec_id", X.normalize_instruction("instruction").alias("instruction")
    )


@query("SELECT qa_id, question, category FROM qa WHERE category = 'returns'", "qa")
def filter_category_eq(spark, sf_dir):
    return L.filter_category(views.qa(spark, sf_dir), "returns").select("qa_id", "question", "category")


@query(
    f"""SELECT question, answer, category FROM ({EXPANDED_SQL})
        WHERE category IN ('product_recommendation', 'product_info')
          AND (coalesce(contains(lower(question), 'widget'), false)
               OR coalesce(contains(lower(answer), 'widget'), false))""",
    "products",
)
def filter_topic(spark, sf_dir):
    pairs = M.expand_product_qa(views.products(spark, sf_dir))
    return L.filter_topic(pairs, word="widget").select("question", "answer", "category")


@query("SELECT conv_id, turn, text FROM conversations WHERE role = 'user'")
def filter_user_turns(spark, sf_dir):
    return L.filter_user_turns(views.turns(spark, sf_dir)).select("conv_id", "turn", "text")


@query(
    """SELECT CASE WHEN rating BETWEEN 1 AND 5 THEN 'valid' ELSE 'rejected' END AS outcome,
              event_id, session_id, rating FROM feedback""",
    "feedback",
)
def validate_rating(spark, sf_dir):
    rows = views.feedback(spark, sf_dir)
    valid = L.valid_ratings(rows).select(F.lit("valid").alias("outcome"), "event_id", "session_id", "rating")
    rest = L.rejected_ratings(rows).select(F.lit("rejected").alias("outcome"), "event_id", "session_id", "rating")
    return valid.unionByName(rest)


@query(
    """SELECT rec_id, category, intent, flags, n_chars FROM records
       WHERE instruction IS NOT NULL AND response IS NOT NULL AND category IS NOT NULL
         AND intent IS NOT NULL AND flags IS NOT NULL AND n_chars IS NOT NULL""",
    "records",
)
def drop_null_rows(spark, sf_dir):
    return L.drop_null_rows(views.records(spark, sf_dir)).select(
        "rec_id", "category", "intent", "flags", "n_chars"
    )


_INDENT = C.INSTRUCTION_DOCUMENT_INDENT


@query(
    f"""SELECT rec_id, {O.strip(f"'Instruction: ' || instruction || chr(10) || '{_INDENT}Response: ' || coalesce(response, 'None') || chr(10) || '{_INDENT}Category: ' || category || chr(10) || '{_INDENT}Intent: ' || intent")} AS page_content,
               category, intent, coalesce(flags, '') AS flags
        FROM records""",
    "records",
)
def document_text(spark, sf_dir):
    return views.records(spark, sf_dir).select(
        "rec_id",
        X.instruction_document("instruction", "response", "category", "intent").alias("page_content"),
        "category",
        "intent",
        F.coalesce("flags", F.lit("")).alias("flags"),
    )


@query(
    "SELECT qa_id, 'Question: ' || question || chr(10) || 'Answer: ' || coalesce(answer, 'None') AS page_content, category FROM qa",
    "qa",
)
def document_text_qa(spark, sf_dir):
    return views.qa(spark, sf_dir).select(
        "qa_id", X.qa_document("question", "answer").alias("page_content"), "category"
    )


TRANSLATION_STEPS_SQL = """
    SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 'Track Order' WHEN '2-HIGH' THEN 'Contact Support'
               WHEN '3-MEDIUM' THEN 'Payment  Methods' WHEN '5-LOW' THEN 'return policy' ELSE o_orderpriority END AS step,
           CASE o_orderstatus WHEN 'F' THEN 'vi' ELSE 'en' END AS language
    FROM orders"""


@query(
    f"""SELECT o_orderkey, step, s.language AS language, coalesce(t.text, step) AS translated
        FROM ({TRANSLATION_STEPS_SQL}) s
        LEFT JOIN (VALUES {', '.join(f"({O.quote(lang)}, {O.quote(key)}, {O.quote(text)})" for lang, entries in C.TRANSLATIONS.items() for key, text in entries.items())}) t(language, key, text)
          ON t.language = s.language AND t.key = regexp_replace(lower(step), '[{C.WHITESPACE}]+', '_', 'g')"""
)
def translate_label(spark, sf_dir):
    steps = views.table(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.expr(
            "CASE o_orderpriority WHEN '1-URGENT' THEN 'Track Order' WHEN '2-HIGH' THEN 'Contact Support'"
            " WHEN '3-MEDIUM' THEN 'Payment  Methods' WHEN '5-LOW' THEN 'return policy' ELSE o_orderpriority END"
        ).alias("step"),
        F.expr("CASE o_orderstatus WHEN 'F' THEN 'vi' ELSE 'en' END").alias("language"),
    )
    return J.with_translation(steps, "step", "language")


# --- counts ----------------------------------------------------------------------------------


@query("SELECT category, count(*) AS n FROM qa GROUP BY category", "qa")
def group_sizes(spark, sf_dir):
    return A.group_sizes(views.qa(spark, sf_dir), "category")


@query("SELECT flags, count(*) AS n FROM records WHERE flags IS NOT NULL GROUP BY flags", "records")
def value_counts(spark, sf_dir):
    return A.value_counts(views.records(spark, sf_dir), "flags")


@query(
    """SELECT source, n, round(n * 100.0 / sum(n) OVER (), 1) AS percent
       FROM (SELECT source, count(*) AS n FROM documents GROUP BY source)"""
)
def value_shares(spark, sf_dir):
    return A.value_shares(views.table(spark, sf_dir, "documents"), "source")


@query(
    """SELECT intent, n FROM (SELECT intent, count(*) AS n FROM records GROUP BY intent)
       ORDER BY n DESC, intent LIMIT 10""",
    "records",
)
def top_n(spark, sf_dir):
    return A.top_n(A.value_counts(views.records(spark, sf_dir), "intent"), "intent", 10)


@query(
    f"""SELECT intent, count(*) AS n FROM (SELECT {O.intent('raw')} AS intent FROM model_outputs)
        GROUP BY intent ORDER BY n DESC, intent LIMIT 5""",
    "model_outputs",
)
def top_intents(spark, sf_dir):
    rows = views.model_outputs(spark, sf_dir).select(X.normalize_intent("raw").alias("intent"))
    return A.top_n(A.value_counts(rows, "intent"), "intent", 5)


@query(
    f"""SELECT sentiment, count(*) AS n
        FROM (SELECT {O.sentiment('raw_sentiment')} AS sentiment FROM model_outputs)
        GROUP BY sentiment ORDER BY n DESC, sentiment LIMIT 3""",
    "model_outputs",
)
def top_sentiments(spark, sf_dir):
    rows = views.model_outputs(spark, sf_dir).select(X.normalize_sentiment("raw_sentiment").alias("sentiment"))
    return A.top_n(A.value_counts(rows, "sentiment"), "sentiment", 3)


@query(
    """SELECT count(*) AS total_samples, count(DISTINCT category) AS unique_categories,
              count(DISTINCT intent) AS unique_intents, round(avg(length(instruction)), 6) AS avg_text_length,
              CAST(max(length(instruction)) AS INT) AS max_text_length FROM records""",
    "records",
)
def basic_stats(spark, sf_dir):
    return A.basic_stats(views.records(spark, sf_dir))


@query(
    """SELECT 'instruction' AS "column", round(avg(length(instruction)), 6) AS mean_length FROM records
       UNION ALL SELECT 'response', round(avg(length(response)), 6) FROM records""",
    "records",
)
def length_statistics(spark, sf_dir):
    return A.length_statistics(views.records(spark, sf_dir), ["instruction", "response"])


@query(
    f"""SELECT term, count(*) FILTER (contains(lower(question), term)) AS n
        FROM ({EXPANDED_SQL}), (SELECT unnest({O.listing(C.TOPIC_TERMS)}) AS term) GROUP BY term""",
    "products",
)
def topic_term_counts(spark, sf_dir):
    return A.topic_term_counts(M.expand_product_qa(views.products(spark, sf_dir)))


@query(
    f"""SELECT word, count(*) AS n
        FROM (SELECT unnest(string_split(cleaned, ' ')) AS word
              FROM ({O.clean_table('documents', 'doc_id', 'text')}))
        WHERE word <> '' GROUP BY word ORDER BY n DESC, word LIMIT 100"""
)
def word_frequencies(spark, sf_dir):
    return A.word_frequencies(views.cleaned_documents(spark, sf_dir), "cleaned")


_CELLS = (("k", "na", "nb"), ("(na - k)", "na", "(t - nb)"), ("(nb - k)", "(t - na)", "nb"), ("(t - na - nb + k)", "(t - na)", "(t - nb)"))
_RATIO_SQL = " + ".join(f"CASE WHEN {cell} > 0 THEN {cell} * ln({cell} * t / ({row} * {column})) ELSE 0 END" for cell, row, column in _CELLS)
PAIRS_SQL = f"""
    WITH cleaned_words AS (
        SELECT list_filter(string_split(cleaned, ' '), lambda w: w <> '') AS ws FROM ({O.clean_table('documents', 'doc_id', 'text')})),
    single AS (SELECT w, count(*) AS n FROM (SELECT unnest(ws) AS w FROM cleaned_words) GROUP BY w),
    total AS (SELECT CAST(sum(n) AS DOUBLE) AS t FROM single),
    paired AS (SELECT ws[i] AS a, ws[i + 1] AS b, count(*) AS n
               FROM (SELECT ws, unnest(range(1, len(ws))) AS i FROM cleaned_words) GROUP BY ALL),
    cells AS (SELECT a, b, p.n AS n, CAST(p.n AS DOUBLE) AS k, CAST(x.n AS DOUBLE) AS na, CAST(y.n AS DOUBLE) AS nb, t
              FROM paired p JOIN single x ON x.w = a JOIN single y ON y.w = b, total),
    scored AS (SELECT a, b, n, 2 * ({_RATIO_SQL}) AS score FROM cells),
    chosen AS (SELECT a, b, n, score FROM scored WHERE score > 30)
    """


@query(PAIRS_SQL + "SELECT a, b, n, round(score, 3) AS score FROM chosen ORDER BY score DESC, a, b LIMIT 100")
def word_pairs(spark, sf_dir):
    return A.word_pairs(views.cleaned_documents(spark, sf_dir), "cleaned").withColumn("score", F.round("score", 3))


@query(
    PAIRS_SQL
    + """, used AS (SELECT w, sum(n) AS n FROM (SELECT a AS w, n FROM chosen UNION ALL SELECT b, n FROM chosen) GROUP BY w)
    SELECT term, n FROM (
        SELECT a || ' ' || b AS term, n FROM chosen
        UNION ALL SELECT s.w, CAST(s.n - coalesce(u.n, 0) AS BIGINT) FROM single s LEFT JOIN used u ON u.w = s.w)
    WHERE n > 0 ORDER BY n DESC, term LIMIT 100"""
)
def term_frequencies(spark, sf_dir):
    return A.term_frequencies(views.cleaned_documents(spark, sf_dir), "cleaned")


@query(f"SELECT {O.language('text')} AS language, count(*) AS n FROM documents GROUP BY 1")
def language_distribution(spark, sf_dir):
    return A.language_distribution(views.table(spark, sf_dir, "documents"), "text")


@query("SELECT CAST(hour(ts) AS INT) AS hour, count(*) AS n FROM events GROUP BY 1")
def hourly_distribution(spark, sf_dir):
    return A.hourly_distribution(views.table(spark, sf_dir, "events"), "ts")


@query(
    f"""SELECT sentiment, count(*) AS n FROM (
            SELECT {O.sentiment('raw_sentiment')} AS sentiment FROM model_outputs
            ORDER BY md5(CAST(out_id AS VARCHAR)), out_id LIMIT 100)
        GROUP BY sentiment""",
    "model_outputs",
)
def sentiment_sample_distribution(spark, sf_dir):
    sample = L.sample_rows(views.model_outputs(spark, sf_dir), "out_id", 100)
    return sample.groupBy(X.normalize_sentiment("raw_sentiment").alias("sentiment")).agg(
        F.count("*").alias("n")
    )


# --- sampling, splitting, set operations ---------------------------------------------------------


@query("SELECT doc_id, lang, source FROM documents ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id LIMIT 100")
def sample_fixed(spark, sf_dir):
    return L.sample_rows(_documents(spark, sf_dir).select("doc_id", "lang", "source"), "doc_id", 100)


@query(
    """SELECT doc_id, CASE WHEN CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 8) AS BIGINT) % 100 < 20
                           THEN 'test' ELSE 'train' END AS split FROM documents"""
)
def split_train_test(spark, sf_dir):
    return L.split_train_test(_documents(spark, sf_dir).select("doc_id"), "doc_id")


@query("SELECT conv_id, turn, role, text FROM conversations ORDER BY conv_id, turn LIMIT 5")
def head(spark, sf_dir):
    return L.head(views.turns(spark, sf_dir), ["conv_id", "turn"])


@query(
    f"""SELECT question, answer, category, source, CAST(qa_id AS BIGINT) AS qa_id FROM qa
        UNION ALL SELECT question, answer, category, source, NULL FROM ({EXPANDED_SQL})
        UNION ALL SELECT instruction, response, category, 'records', NULL FROM records""",
    "qa products records",
)
def union_sources(spark, sf_dir):
    records = views.records(spark, sf_dir).select(
        F.col("instruction").alias("question"),
        F.col("response").alias("answer"),
        "category",
        F.lit("records").alias("source"),
    )
    products = M.expand_product_qa(views.products(spark, sf_dir))
    return L.union_sources(views.qa(spark, sf_dir), products, records)


@query("SELECT DISTINCT intent FROM records", "records")
def distinct_values(spark, sf_dir):
    return L.distinct_values(views.records(spark, sf_dir), "intent")


@query("SELECT DISTINCT instruction, response FROM records", "records")
def distinct_rows(spark, sf_dir):
    return L.distinct_rows(views.records(spark, sf_dir).select("instruction", "response"))
