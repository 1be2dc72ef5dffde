"""Queries over conversations, feedback, look-ups and label metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from supportlens import constants as C
from supportlens.functions import text as X
from supportlens.operators import aggregates as A, conversations as V, evaluate as E
from supportlens.operators import lookups as J, models, ordered as D
from supportlens.plans import oracle_text as O, views
from supportlens.plans.registry import query
from supportlens.plans.text_queries import _documents
from supportlens.session import work_folder
from supportlens.sources import run_files as RF

LATEST_RATING_SQL = """
    SELECT session_id, rating FROM feedback WHERE rating BETWEEN 1 AND 5
    QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY ts DESC, event_id DESC) = 1"""
LAST_USER_SQL = """
    SELECT conv_id, turn, role, text FROM conversations WHERE role = 'user'
    QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) = 1"""


def _message_lines():
    return F.array_join(
        F.transform("messages", lambda m: F.concat_ws("|", m.turn.cast("string"), m.role, m.text)), "\n"
    )


MESSAGE_LINES_SQL = "string_agg(turn || '|' || role || '|' || text, chr(10) ORDER BY turn)"


# --- conversations -----------------------------------------------------------------------------


@query(LAST_USER_SQL)
def last_user_message(spark, sf_dir):
    return V.last_user_message(views.turns(spark, sf_dir)).select("conv_id", "turn", "role", "text")


@query("SELECT conv_id, turn, question, answer FROM qa", "qa")
def pair_turns(spark, sf_dir):
    return V.pair_turns(views.turns(spark, sf_dir))


@query(
    f"""SELECT conv_id, CAST(turn // 1000 AS BIGINT) AS block, count(*) AS n, {MESSAGE_LINES_SQL} AS messages
        FROM conversations GROUP BY 1, 2"""
)
def export_conversations(spark, sf_dir):
    return V.message_blocks(views.turns(spark, sf_dir)).select(
        "conv_id", "block", F.size("messages").cast("bigint").alias("n"), _message_lines().alias("messages")
    )


@query(
    f"""SELECT conv_id, CAST(turn // 1000 AS BIGINT) AS block, {MESSAGE_LINES_SQL} AS messages
        FROM (SELECT *, max(turn) OVER (PARTITION BY conv_id) AS last_turn FROM conversations)
        WHERE turn < last_turn GROUP BY 1, 2"""
)
def history_before_last(spark, sf_dir):
    return V.history_before_last(views.turns(spark, sf_dir)).select(
        "conv_id", "block", _message_lines().alias("messages")
    )


@query(
    f"""SELECT category, CAST(qa_id // 1000 AS BIGINT) AS block, count(*) AS n,
               string_agg(qa_id || '|' || question || '|' || coalesce(answer, '') || '|' || source || '|'
                          || category || '|' || array_to_string({O.entities('question')}, ','),
                          chr(10) ORDER BY qa_id) AS pairs
        FROM qa GROUP BY 1, 2""",
    "qa",
)
def group_pairs(spark, sf_dir):
    def line(pair):
        return F.concat_ws(
            "|",
            pair.id.cast("string"),
            pair.question,
            F.coalesce(pair.answer, F.lit("")),
            pair.metadata.source,
            pair.metadata.category,
            F.array_join(F.coalesce(pair.metadata.entities, F.array()), ","),
        )

    return V.group_pairs(views.qa(spark, sf_dir), "qa_id").select(
        "category",
        "block",
        F.size("pairs").cast("bigint").alias("n"),
        F.array_join(F.transform("pairs", line), "\n").alias("pairs"),
    )


@query(
    """SELECT intent, CAST(rec_id // 1000 AS BIGINT) AS block, count(*) AS n,
              string_agg(instruction, chr(10) ORDER BY rec_id) AS examples
       FROM records GROUP BY 1, 2""",
    "records",
)
def group_examples(spark, sf_dir):
    return V.group_examples(views.records(spark, sf_dir), "rec_id").select(
        "intent", "block", F.size("examples").cast("bigint").alias("n"),
        F.array_join("examples", "\n").alias("examples"),
    )


@query(
    """SELECT category, qa_id, question, CAST(row_number() OVER (PARTITION BY category ORDER BY qa_id) AS INT) AS rank,
              greatest(count(*) OVER (PARTITION BY category) - 3, 0) AS more
       FROM qa QUALIFY rank <= 3""",
    "qa",
)
def examples_per_category(spark, sf_dir):
    return D.examples_per_category(views.qa(spark, sf_dir), "category", "qa_id").select(
        "category", "qa_id", "question", "rank", "more"
    )


@query(
    f"""SELECT rec_id, instruction FROM (SELECT rec_id, {O.strip('lower(instruction)')} AS instruction FROM records)
        QUALIFY row_number() OVER (PARTITION BY instruction ORDER BY rec_id) = 1""",
    "records",
)
def dedupe_keep_first(spark, sf_dir):
    rows = views.records(spark, sf_dir).select("rec_id", X.normalize_instruction("instruction").alias("instruction"))
    return D.keep_first(rows, ["instruction"], ["rec_id"])


@query(
    f"""SELECT rec_id, instruction, response, category, intent FROM (
            SELECT rec_id, {O.strip('lower(instruction)')} AS instruction, response, category, intent FROM records
            QUALIFY row_number() OVER (PARTITION BY {O.strip('lower(instruction)')} ORDER BY rec_id) = 1)
        WHERE instruction IS NOT NULL AND response IS NOT NULL""",
    "records",
    name="preprocess_records",
)
def preprocess_records(spark, sf_dir):
    """Normalise, keep the first of equal instructions, then drop rows with nulls."""
    rows = views.records(spark, sf_dir).select("rec_id", "instruction", "response", "category", "intent")
    normal = rows.withColumn("instruction", X.normalize_instruction("instruction"))
    return D.keep_first(normal, ["instruction"], ["rec_id"]).na.drop("any")


@query(
    f"""WITH question AS ({O.clean_table('qa', 'qa_id', 'question')}),
             answer AS ({O.clean_table('qa', 'qa_id', 'answer')})
        SELECT qa_id, question, answer, category, source, q.cleaned AS question_clean, a.cleaned AS answer_clean,
               CAST(coalesce(len({O.words('question')}), 0) AS INT) AS question_length,
               CAST(coalesce(len({O.words('answer')}), 0) AS INT) AS answer_length,
               array_to_string({O.entities('question')}, ',') AS entities
        FROM qa JOIN question q USING (qa_id) JOIN answer a USING (qa_id)""",
    "qa",
)
def analyzed_pairs(spark, sf_dir):
    return V.analyze_pairs(views.qa(spark, sf_dir)).withColumn("entities", F.array_join("entities", ","))


def _label_prompt_sql(lines: list[str]) -> str:
    before, after = f"\n{C.LABEL_PROMPT_INDENT}".join(lines).split("{message}")
    return f"{O.quote(before)} || text || {O.quote(after)}"


@query(
    f"""SELECT conv_id, {_label_prompt_sql(C.INTENT_PROMPT_LINES)} AS intent_prompt,
               {_label_prompt_sql(C.SENTIMENT_PROMPT_LINES)} AS sentiment_prompt FROM ({LAST_USER_SQL})"""
)
def build_label_prompts(spark, sf_dir):
    last = V.last_user_message(views.turns(spark, sf_dir))
    return V.label_prompts(last, "text").select("conv_id", "intent_prompt", "sentiment_prompt")


# --- feedback ------------------------------------------------------------------------------------


@query(
    "SELECT * FROM feedback WHERE session_id IN (SELECT conv_id FROM conversations)", "feedback"
)
def feedback_known_sessions(spark, sf_dir):
    return J.known_sessions(views.feedback(spark, sf_dir), views.sessions(spark, sf_dir))


@query(
    "SELECT * FROM feedback WHERE session_id NOT IN (SELECT conv_id FROM conversations)", "feedback"
)
def feedback_orphans(spark, sf_dir):
    return J.orphan_sessions(views.feedback(spark, sf_dir), views.sessions(spark, sf_dir))


@query(
    f"""SELECT session_id, rating, comment, block, messages
        FROM (SELECT * FROM feedback
              QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY ts DESC, event_id DESC) = 1)
        JOIN (SELECT conv_id, CAST(turn // 1000 AS BIGINT) AS block, {MESSAGE_LINES_SQL} AS messages
              FROM conversations GROUP BY 1, 2) ON conv_id = session_id""",
    "feedback",
)
def feedback_with_conversation(spark, sf_dir):
    nested = V.message_blocks(views.turns(spark, sf_dir))
    return J.feedback_with_conversation(views.feedback(spark, sf_dir), nested).select(
        "session_id", "rating", "comment", "block", _message_lines().alias("messages")
    )


@query(f"SELECT round(avg(rating), 6) AS average_rating FROM ({LATEST_RATING_SQL})", "feedback")
def average_rating(spark, sf_dir):
    return V.average_rating(views.feedback(spark, sf_dir))


@query(
    f"""SELECT round(100.0 * count(*) FILTER (rating >= 4) / count(*), 6) AS satisfaction_percent
        FROM ({LATEST_RATING_SQL})""",
    "feedback",
)
def satisfaction_rate(spark, sf_dir):
    return V.satisfaction_rate(views.feedback(spark, sf_dir))


@query(
    f"""SELECT word, count(DISTINCT conv_id) AS sessions FROM (
            SELECT conv_id, unnest(string_split(cleaned, ' ')) AS word FROM (
                {O.clean_table("(SELECT * FROM conversations WHERE role = 'user' AND conv_id IN (SELECT session_id FROM (" + LATEST_RATING_SQL + ") WHERE rating <= 2))", 'conv_id', 'text')}))
        WHERE word <> '' GROUP BY word ORDER BY sessions DESC, word LIMIT 10""",
    "feedback",
)
def common_issues(spark, sf_dir):
    return V.common_issues(views.feedback(spark, sf_dir), views.turns(spark, sf_dir))


@query(
    f"""WITH last AS ({LAST_USER_SQL}),
        labelled AS (SELECT {O.language('text')} AS language,
                            {O.intent("coalesce(raw, '')")} AS intent,
                            {O.sentiment("coalesce(raw_sentiment, '')")} AS sentiment
                     FROM last LEFT JOIN model_outputs ON out_id = conv_id)
        SELECT 'total_conversations' AS metric, 'all' AS key, CAST(count(DISTINCT conv_id) AS DOUBLE) AS value
        FROM conversations
        UNION ALL SELECT 'average_rating', 'all', round(avg(rating), 6)
        FROM ({LATEST_RATING_SQL}) WHERE session_id IN (SELECT conv_id FROM conversations)
        UNION ALL SELECT 'language', language, count(*) FROM labelled GROUP BY language
        UNION ALL SELECT 'intent', intent, count(*) FROM labelled GROUP BY intent
        UNION ALL SELECT 'sentiment', sentiment, count(*) FROM labelled GROUP BY sentiment""",
    "feedback model_outputs",
)
def conversation_analytics(spark, sf_dir):
    return V.conversation_analytics(
        views.turns(spark, sf_dir), views.feedback(spark, sf_dir), views.conversation_outputs(spark, sf_dir)
    )


@query(
    """SELECT count(*) AS answers, round(avg(seconds), 6) AS avg_seconds FROM (
           SELECT event_type, lead(event_type) OVER w AS next_type,
                  (epoch_us(lead(ts) OVER w) - epoch_us(ts)) / 1e6 AS seconds
           FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
       WHERE event_type = 'view' AND next_type = 'click'"""
)
def avg_response_time(spark, sf_dir):
    """Views are read as questions and clicks as answers."""
    kind = F.col("event_type")
    answers = V.response_times(
        views.table(spark, sf_dir, "events"), "user_id", "ts", ["ts", "event_id"], kind == "view", kind == "click"
    )
    return answers.agg(F.count("*").alias("answers"), F.round(F.avg("seconds"), 6).alias("avg_seconds"))


# --- look-ups ---------------------------------------------------------------------------------------


@query(
    f"""SELECT out_id, intent, CASE intent {' '.join(f"WHEN {O.quote(i)} THEN {O.quote(', '.join(a))}" for i, a in C.SUGGESTED_ACTIONS.items())}
               ELSE 'Contact Support' END AS actions
        FROM (SELECT out_id, {O.intent('raw')} AS intent FROM model_outputs)""",
    "model_outputs",
)
def suggested_actions(spark, sf_dir):
    rows = views.model_outputs(spark, sf_dir).select("out_id", X.normalize_intent("raw").alias("intent"))
    return J.with_suggested_actions(rows).select("out_id", "intent", F.array_join("actions", ", ").alias("actions"))


@query(
    f"""SELECT utt_id, u.intent AS intent, u.language AS language, array_to_string(steps, ' / ') AS next_steps
        FROM (SELECT utt_id, {O.category('text')} AS intent, {O.language('text')} AS language FROM utterances) u
        JOIN ({O.next_steps_values()}) s(language, intent, steps)
          ON s.intent = u.intent AND s.language = u.language""",
    "utterances",
)
def next_steps(spark, sf_dir):
    rows = views.utterances(spark, sf_dir).select(
        "utt_id", X.keyword_category("text").alias("intent"), X.detect_language("text").alias("language")
    )
    return J.with_next_steps(rows).select(
        "utt_id", "intent", "language", F.array_join("next_steps", " / ").alias("next_steps")
    )


@query("SELECT source AS label, row_number() OVER (ORDER BY source) - 1 AS class_id FROM (SELECT DISTINCT source FROM documents)")
def label_index(spark, sf_dir):
    return models.label_index(_documents(spark, sf_dir), "source")


@query(
    """SELECT doc_id, class_id, label FROM (
           SELECT doc_id, source AS label, dense_rank() OVER (ORDER BY source) - 1 AS class_id FROM documents)"""
)
def label_decode(spark, sf_dir):
    documents = _documents(spark, sf_dir)
    ids = models.with_label_id(documents, "source").select("doc_id", F.col("source_id").alias("class_id"))
    return J.decode_labels(ids, models.label_index(documents, "source"))


@query(
    """SELECT doc_id, doc_id % 8 AS cluster, CASE doc_id % 8 WHEN 0 THEN 'returns' WHEN 3 THEN 'shipping'
              WHEN 5 THEN 'payment' ELSE 'general' END AS category FROM documents"""
)
def cluster_to_category(spark, sf_dir):
    rows = _documents(spark, sf_dir).select("doc_id", (F.col("doc_id") % 8).alias("cluster"))
    names = spark.createDataFrame(
        [(0, "returns"), (3, "shipping"), (5, "payment")], "cluster BIGINT, category STRING"
    )
    return J.category_of_cluster(rows, names)


# --- label metrics -------------------------------------------------------------------------------------


CONFUSION_SQL = """
    SELECT a.label AS actual, p.label AS predicted, count(pred_id) AS n
    FROM (SELECT actual AS label FROM predictions UNION SELECT predicted FROM predictions) a
    CROSS JOIN (SELECT actual AS label FROM predictions UNION SELECT predicted FROM predictions) p
    LEFT JOIN predictions x ON x.actual = a.label AND x.predicted = p.label
    GROUP BY 1, 2"""
SCORES_SQL = """
    SELECT *, CASE WHEN precision + recall = 0 THEN 0 ELSE 2 * precision * recall / (precision + recall) END AS f1
    FROM (SELECT label, support, CASE WHEN named = 0 THEN 0 ELSE hits / named END AS precision,
                 CASE WHEN support = 0 THEN 0 ELSE hits / support END AS recall, hits
          FROM (SELECT label, (SELECT count(*) FROM predictions WHERE actual = label) AS support,
                       (SELECT count(*) FROM predictions WHERE predicted = label) AS named,
                       (SELECT count(*) FROM predictions WHERE actual = label AND predicted = label) AS hits
                FROM (SELECT actual AS label FROM predictions UNION SELECT predicted FROM predictions)))"""


@query(CONFUSION_SQL, "predictions")
def confusion_matrix(spark, sf_dir):
    return E.confusion_matrix(views.predictions(spark, sf_dir))


@query(
    f"""SELECT c.class_id AS actual_id, d.class_id AS predicted_id, m.actual AS actual, m.predicted AS predicted, m.n AS n
        FROM ({CONFUSION_SQL}) m
        JOIN (SELECT lang AS label, row_number() OVER (ORDER BY lang) - 1 AS class_id FROM (SELECT DISTINCT lang FROM documents)) c
          ON c.label = m.actual
        JOIN (SELECT lang AS label, row_number() OVER (ORDER BY lang) - 1 AS class_id FROM (SELECT DISTINCT lang FROM documents)) d
          ON d.label = m.predicted""",
    "predictions",
)
def confusion_heatmap(spark, sf_dir):
    """The matrix with class names and their positions on the axes."""
    classes = models.label_index(_documents(spark, sf_dir), "lang")
    matrix = E.confusion_matrix(views.predictions(spark, sf_dir))
    rows = classes.select(F.col("label").alias("actual"), F.col("class_id").alias("actual_id"))
    columns = classes.select(F.col("label").alias("predicted"), F.col("class_id").alias("predicted_id"))
    return matrix.join(rows, "actual").join(columns, "predicted").select(
        "actual_id", "predicted_id", "actual", "predicted", "n"
    )


WEIGHTED_SQL = f"""
    SELECT round(sum(hits) / sum(support), 6) AS accuracy,
           round(sum(precision * support) / sum(support), 6) AS precision,
           round(sum(recall * support) / sum(support), 6) AS recall,
           round(sum(f1 * support) / sum(support), 6) AS f1
    FROM ({SCORES_SQL})"""


@query(WEIGHTED_SQL, "predictions")
def weighted_metrics(spark, sf_dir):
    return E.weighted_metrics(views.predictions(spark, sf_dir))


@query(
    f"""WITH s AS ({SCORES_SQL})
        SELECT label, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support FROM s
        UNION ALL SELECT 'macro avg', round(avg(precision), 6), round(avg(recall), 6), round(avg(f1), 6), CAST(sum(support) AS BIGINT) FROM s
        UNION ALL SELECT 'weighted avg', round(sum(precision * support) / sum(support), 6),
               round(sum(recall * support) / sum(support), 6), round(sum(f1 * support) / sum(support), 6), CAST(sum(support) AS BIGINT) FROM s""",
    "predictions",
)
def class_report(spark, sf_dir):
    return E.class_report(views.predictions(spark, sf_dir))


@query(
    f"""WITH found AS (SELECT lang AS actual, {O.language('text')} AS predicted FROM documents),
             labels AS (SELECT actual AS label FROM found UNION SELECT predicted FROM found)
        SELECT a.label AS actual, p.label AS predicted,
               (SELECT count(*) FROM found WHERE actual = a.label AND predicted = p.label) AS n
        FROM labels a CROSS JOIN labels p"""
)
def eval_language_rule(spark, sf_dir):
    rows = _documents(spark, sf_dir).select(
        F.col("lang").alias("actual"), X.detect_language("text").alias("predicted")
    )
    return E.confusion_matrix(rows)


RUN_SUMMARY_SQL = """
    SELECT run_id, max(epoch) AS epochs, arg_max(validation_loss, epoch) AS final_loss,
           arg_max(training_loss, epoch) AS final_training_loss, arg_max(validation_accuracy, epoch) AS final_accuracy,
           arg_max(training_accuracy, epoch) AS final_training_accuracy, min(validation_loss) AS best_loss,
           min(training_loss) AS best_training_loss, max(validation_accuracy) AS best_accuracy,
           max(training_accuracy) AS best_training_accuracy, first(epoch ORDER BY validation_loss, epoch) AS best_epoch
    FROM run_history GROUP BY run_id"""


@query(RUN_SUMMARY_SQL, "run_history")
def run_history_summary(spark, sf_dir):
    return A.run_history_summary(views.run_history(spark, sf_dir))


def _run_files(spark, sf_dir):
    """The histories as result files, one object for each run."""
    history = views.run_history(spark, sf_dir)
    # An epoch per day of a month, so a list is short.
    days = F.array_sort(F.collect_list(F.struct("epoch", *RF.MEASURES)))
    lists = [F.col("days").getField(name).alias(f"{name}_history") for name in RF.MEASURES]
    nested = history.groupBy("run_id").agg(days.alias("days")).select("run_id", *lists)
    path = work_folder(spark, "runs")
    nested.select(F.to_json(F.struct("*"), {"pretty": "true"})).write.option("maxRecordsPerFile", 1).text(path)
    return RF.read_runs(spark, path)


@query(
    """SELECT run_id, CAST(row_number() OVER (PARTITION BY run_id ORDER BY epoch) AS INT) AS epoch,
              training_loss, validation_loss, training_accuracy, validation_accuracy FROM run_history""",
    "run_history",
)
def read_run_files(spark, sf_dir):
    """Lists of nested files as a row per epoch."""
    return RF.histories(_run_files(spark, sf_dir))


@query(WEIGHTED_SQL, "predictions")
def read_run_matrix(spark, sf_dir):
    """Metrics from the matrix of a nested file."""
    cells = E.confusion_matrix(views.predictions(spark, sf_dir))
    # The matrix has a cell per pair of languages.
    rows = cells.groupBy("actual").agg(F.array_sort(F.collect_list(F.struct("predicted", "n"))).alias("cells"))
    matrix = F.array_sort(F.collect_list(F.struct("actual", F.transform("cells", lambda c: c.n).alias("counts"))))
    names = F.transform("matrix", lambda row: row.actual).alias("class_names")
    counts = F.struct(F.transform("matrix", lambda row: row.counts).alias("confusion_matrix")).alias("performance_metrics")
    path = work_folder(spark, "matrix")
    rows.agg(matrix.alias("matrix")).select(names, counts).write.json(path)
    return E.weighted_metrics(RF.confusions(RF.read_runs(spark, path)), n="n")


@query(
    """WITH scores AS (
           SELECT vec_id, i - 1 AS class_id,
                  exp(CAST(embedding[i] AS DOUBLE)) / sum(exp(CAST(embedding[i] AS DOUBLE))) OVER (PARTITION BY vec_id) AS p
           FROM embeddings, (SELECT unnest(range(1, 65)) AS i))
       SELECT vec_id, CAST(row_number() OVER (PARTITION BY vec_id ORDER BY p DESC, class_id) AS INT) AS rank, CAST(class_id AS INT) AS class_id,
              round(p, 6) AS confidence
       FROM scores QUALIFY rank <= 3"""
)
def top3_predictions(spark, sf_dir):
    """The dimensions are read as the logits of as many classes."""
    logits = F.transform("embedding", lambda x: F.exp(x.cast("double")))
    scores = views.table(spark, sf_dir, "embeddings").select("vec_id", logits.alias("e")).select(
        "vec_id",
        F.transform("e", lambda x: x / F.aggregate("e", F.lit(0.0), lambda a, b: a + b)).alias("probabilities"),
    )
    return E.top_labels(scores, "vec_id", "probabilities").withColumn("confidence", F.round("confidence", 6))


@query(
    """SELECT count(*) AS size, count(DISTINCT category) AS categories, count(DISTINCT intent) AS intents,
              round(avg(length(instruction)), 6) AS avg_instruction_length,
              round(avg(length(response)), 6) AS avg_response_length,
              (SELECT round(count(*) FILTER (actual = predicted) / count(*), 6) FROM category_predictions) AS category_accuracy,
              (SELECT round(count(*) FILTER (actual = predicted) / count(*), 6) FROM predictions) AS intent_accuracy
       FROM records""",
    "records predictions category_predictions",
)
def summary_report(spark, sf_dir):
    accuracy = lambda rows: E.weighted_metrics(rows).select("accuracy").scalar()
    return (
        views.records(spark, sf_dir)
        .agg(
            F.count("*").alias("size"),
            F.countDistinct("category").alias("categories"),
            F.countDistinct("intent").alias("intents"),
            F.round(F.avg(F.length("instruction")), 6).alias("avg_instruction_length"),
            F.round(F.avg(F.length("response")), 6).alias("avg_response_length"),
        )
        .withColumn("category_accuracy", accuracy(views.category_predictions(spark, sf_dir)))
        .withColumn("intent_accuracy", accuracy(views.predictions(spark, sf_dir)))
    )
