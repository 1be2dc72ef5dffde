"""The derived tables once more, as SQL for the independent check."""

from supportlens.plans.views import CATEGORY_SQL, RAW_LABEL_SQL, RAW_SENTIMENT_SQL, SOURCE_SQL

VIEWS = {
    "qa": f"""
        SELECT conv_id * 100 + turn AS qa_id, text AS question,
               CASE WHEN next_role = 'assistant' THEN next_text END AS answer,
               {CATEGORY_SQL} AS category, {SOURCE_SQL} AS source, conv_id, turn
        FROM (SELECT *, LEAD(role) OVER w AS next_role, LEAD(text) OVER w AS next_text
              FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
        WHERE role = 'user'""",
    "utterances": """
        SELECT 'o' || o_orderkey AS utt_id, 'I want to track my order #' || o_orderkey AS text FROM orders
        UNION ALL SELECT 'p' || p_partkey, 'Can you tell me about product #' || p_partkey || '?' FROM part
        UNION ALL SELECT 'r' || p_partkey,
               'Can you recommend a product that looks like a ' || p_name || '?' FROM part
        UNION ALL SELECT 'c' || conv_id || '_' || turn, text FROM conversations WHERE role = 'user'""",
    "records": """
        SELECT doc_id AS rec_id, text AS instruction,
               CASE WHEN source <> 'src3' THEN text END AS response,
               source AS category, source || '_' || lang AS intent,
               CASE WHEN lang <> 'en' THEN lang END AS flags,
               CASE WHEN source <> 'src7' THEN CAST(n_chars AS DOUBLE) END AS n_chars
        FROM documents""",
    "feedback": """
        SELECT event_id, user_id AS session_id, CAST(1 + event_id % 6 AS INT) AS rating,
               event_type AS comment, ts FROM events""",
    "predictions": """
        SELECT doc_id AS pred_id, lang AS actual,
               CASE WHEN n_chars % 5 = 0 THEN 'en' ELSE lang END AS predicted FROM documents""",
    "run_history": """
        SELECT event_type AS run_id, CAST(EXTRACT(DAY FROM ts) AS INT) AS epoch,
               ROUND(AVG(value), 6) AS validation_loss, ROUND(AVG(value) / 2, 6) AS training_loss,
               ROUND(AVG(CASE WHEN event_id % 3 = 0 THEN 1.0 ELSE 0.0 END) * 100, 6) AS validation_accuracy,
               ROUND(AVG(CASE WHEN event_id % 4 > 0 THEN 1.0 ELSE 0.0 END) * 100, 6) AS training_accuracy
        FROM events GROUP BY 1, 2""",
    "category_predictions": """
        SELECT source AS actual, CASE WHEN n_chars % 7 = 0 THEN 'src0' ELSE source END AS predicted FROM documents""",
    "model_outputs": f"""
        SELECT o_orderkey AS out_id, {RAW_LABEL_SQL} AS raw, {RAW_SENTIMENT_SQL} AS raw_sentiment
        FROM orders""",
    "measures": """
        SELECT l_quantity, l_extendedprice, NULLIF(l_discount, 0) AS l_discount,
               NULLIF(l_tax, 0) AS l_tax, NULLIF(l_returnflag, 'N') AS l_returnflag, l_linestatus,
               CASE WHEN l_returnflag = 'R' THEN l_linestatus END AS return_status
        FROM lineitem""",
    "products": """
        SELECT p_name AS name, p_brand || ', size ' || p_size AS specs,
               printf('%.2f', p_retailprice) AS price,
               CASE p_type WHEN 'PROMO' THEN 'Gaming' WHEN 'LARGE' THEN 'Workstation'
                    WHEN 'ECONOMY' THEN 'Budget' ELSE p_type END AS category
        FROM part""",
    "product_requests": """
        SELECT p_partkey,
               CASE WHEN p_type NOT IN ('PROMO', 'LARGE') THEN CAST(p_partkey AS VARCHAR) END AS product_id,
               CASE WHEN p_type <> 'LARGE' THEN p_name ELSE '' END AS product_name
        FROM part""",
}
