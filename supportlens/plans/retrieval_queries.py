"""Queries over chunks, vectors, terms and models."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from supportlens import constants as C, schemas
from supportlens.functions import text as X
from supportlens.operators import conversations as V, evaluate as E, models as M
from supportlens.operators import retrieval as R, terms as T, vector_index as I
from supportlens.plans import oracle_text as O, views
from supportlens.plans.registry import query
from supportlens.operators.model_store import LabelDictionary, ModelStore
from supportlens.session import materialize, work_folder
from supportlens.streaming import streams as S

# --- chunks -----------------------------------------------------------------------------------


@query(
    """SELECT doc_id, CAST(i AS INT) AS chunk_no, substr(text, CAST(i * 900 + 1 AS BIGINT), 1000) AS chunk
       FROM (SELECT doc_id, text, unnest(range(1 + CAST(greatest(ceil((length(text) - 1000) / 900.0), 0) AS BIGINT))) AS i
             FROM documents WHERE length(text) > 0)"""
)
def chunk_documents(spark, sf_dir):
    return R.chunk_documents(views.table(spark, sf_dir, "documents"), "doc_id", "text")


@query()
def chunk_at_separators(spark, sf_dir):
    return R.chunk_at_separators(views.texts(spark, sf_dir), "doc_id", "text")


# --- vectors ----------------------------------------------------------------------------------


def _embeddings(spark, sf_dir):
    return views.table(spark, sf_dir, "embeddings")


CATEGORY_OF_LABEL_SQL = (
    "CASE label " + " ".join(f"WHEN {i} THEN '{c}'" for i, c in enumerate(C.CATEGORIES)) + " ELSE 'general' END"
)
NEAREST_SQL = """
    SELECT q.vec_id AS query_id, c.vec_id AS match_id, c.label AS match_label,
           round(power(list_distance(CAST(q.embedding AS DOUBLE[]), CAST(c.embedding AS DOUBLE[])), 2), 6) AS distance
    FROM embeddings q JOIN embeddings c ON q.vec_id <> c.vec_id"""
TOPK_SQL = f"""
    SELECT query_id, match_id, match_label, distance,
           CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, match_id) AS INT) AS rank
    FROM ({NEAREST_SQL}) QUALIFY rank <= 3"""


@query(
    """SELECT vec_id, CAST(i AS INT) AS position, round(x / norm, 6) AS value
       FROM (SELECT vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i,
                    sqrt(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda e: e * e))) AS norm
             FROM (SELECT vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda e: e * (label + 1)) AS embedding
                   FROM embeddings))"""
)
def normalize_vectors(spark, sf_dir):
    """The vectors come with unit length, so they are stretched by their label first."""
    stretched = F.transform(
        F.col("embedding").cast("array<double>"), lambda x: x * (F.col("label") + 1)
    )
    return (
        _embeddings(spark, sf_dir)
        .select("vec_id", F.posexplode(R.normalize_vector(stretched)).alias("position", "value"))
        .select("vec_id", (F.col("position") + 1).alias("position"), F.round("value", 6).alias("value"))
    )


@query(f"SELECT query_id, match_id, distance, rank FROM ({TOPK_SQL})")
def vector_topk(spark, sf_dir):
    """Every vector asks for its nearest others."""
    rows = _embeddings(spark, sf_dir)
    return R.vector_topk(rows, rows, "vec_id", "embedding", skip_self=True)


@query(
    f"""SELECT query_id, match_id, distance, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, match_id) AS INT) AS rank
        FROM ({NEAREST_SQL.replace('FROM embeddings q JOIN embeddings c', f'FROM (SELECT *, {CATEGORY_OF_LABEL_SQL} AS category FROM embeddings) q JOIN (SELECT *, {CATEGORY_OF_LABEL_SQL} AS category FROM embeddings) c')}
              AND (q.category = c.category OR q.category = 'general')) QUALIFY rank <= 3"""
)
def vector_topk_filtered(spark, sf_dir):
    rows = _embeddings(spark, sf_dir).withColumn("category", F.expr(CATEGORY_OF_LABEL_SQL))
    return R.retrieve(rows, rows, "vec_id", "embedding", "category", skip_self=True)


@query(f"SELECT query_id, match_id, match_label AS retrieved_label FROM ({TOPK_SQL}) WHERE rank = 1")
def retrieved_intent(spark, sf_dir):
    rows = _embeddings(spark, sf_dir)
    matches = R.vector_topk(rows, rows, "vec_id", "embedding", k=1, skip_self=True)
    return R.retrieved_labels(matches, rows, "vec_id", "label")


#: The vectors of the tables have no structure, so most lists have to be read.
UNSTRUCTURED_PROBES = 72


def _ann(spark, sf_dir):
    rows = _embeddings(spark, sf_dir)
    index = I.VectorIndex.build(rows, "vec_id", "embedding", 1 + C.RETRIEVED_DOCUMENTS)
    return rows, index, lambda: index.search(
        rows, "vec_id", "embedding", C.RETRIEVED_DOCUMENTS, skip_self=True, probes=UNSTRUCTURED_PROBES
    )


@query()
def ann_topk(spark, sf_dir):
    return _ann(spark, sf_dir)[2]()


@query(
    f"""SELECT (SELECT count(*) FROM embeddings) AS n_queries, count(*) AS n_exact, true AS recall_reached
        FROM ({TOPK_SQL})"""
)
def ann_recall(spark, sf_dir):
    """Whether approximate search finds at least nine tenths of the exact matches of all vectors."""
    rows, _, search = _ann(spark, sf_dir)
    exact = R.vector_topk(rows, rows, "vec_id", "embedding", skip_self=True)
    n_queries = rows.agg(F.count("*")).scalar().alias("n_queries")
    return I.recall(exact, search()).select(n_queries, "n_exact", (F.col("recall") >= 0.9).alias("recall_reached"))


@query()
def ann_work(spark, sf_dir):
    """Recall against exact search, and the shares of all pairs whose codes were read and whose distances were taken."""
    rows, index, search = _ann(spark, sf_dir)
    exact = R.vector_topk(rows, rows, "vec_id", "embedding", skip_self=True)
    work = index.work(rows, "vec_id", "embedding", UNSTRUCTURED_PROBES)
    shares = [work.select(name).scalar().alias(name) for name in work.columns]
    return I.recall(exact, search()).select("n_exact", "recall", *shares)


@query(
    f"""SELECT n.query_id AS query_id, CAST(least(3, (SELECT count(*) - 1 FROM embeddings)) AS BIGINT) AS n_matches, 0 AS wrong_distances,
               0 AS wrong_ranks, true AS none_nearer
        FROM (SELECT DISTINCT query_id FROM ({TOPK_SQL})) n"""
)
def ann_ranks(spark, sf_dir):
    """Per query: matches found, those whose distance or rank is wrong, and whether none is nearer than the nearest."""
    rows, _, search = _ann(spark, sf_dir)
    pairs = search().join(rows.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q")), "query_id").join(
        rows.select(F.col("vec_id").alias("match_id"), F.col("embedding").alias("m")), "match_id"
    )
    gap = F.expr("aggregate(zip_with(q, m, (x, y) -> (double(x) - double(y)) * (double(x) - double(y))), 0D, (t, x) -> t + x)")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "match_id"))
    checked = pairs.withColumns({"true_distance": F.round(gap, 6), "place": place})
    nearest = R.vector_topk(rows, rows, "vec_id", "embedding", k=1, skip_self=True)
    least = nearest.select("query_id", F.col("distance").alias("least"))
    wrong = lambda condition: F.count_if(condition).cast("int")
    return checked.join(least, "query_id").groupBy("query_id").agg(
        F.count("*").alias("n_matches"),
        wrong(F.abs(F.col("distance") - F.col("true_distance")) > 1e-6).alias("wrong_distances"),
        wrong(F.col("rank") != F.col("place")).alias("wrong_ranks"),
        F.every(F.col("distance") >= F.col("least") - 1e-6).alias("none_nearer"),
    )


def _prompt_sql() -> str:
    system = O.quote(f"\n{C.SYSTEM_PROMPT_INDENT}".join(C.SYSTEM_PROMPT_LINES))
    gap = f"chr(10) || '{C.CHAT_PROMPT_INDENT}'"
    blank = f"{gap} || {gap}"
    return f"""
        WITH context AS (
            SELECT query_id, string_agg(text, chr(10) || chr(10) ORDER BY rank) AS context
            FROM ({TOPK_SQL}) JOIN documents ON doc_id = match_id GROUP BY query_id),
        asked AS (
            SELECT vec_id AS query_id, text AS message, {CATEGORY_OF_LABEL_SQL} AS intent,
                   {O.language('text')} AS language, {O.sentiment("coalesce(raw_sentiment, '')")} AS sentiment
            FROM embeddings JOIN documents ON doc_id = vec_id LEFT JOIN model_outputs ON out_id = vec_id)
        SELECT query_id, md5(prompt) AS prompt_md5, CAST(length(prompt) AS INT) AS prompt_length FROM (
            SELECT query_id, 'System: ' || {system}
                   || CASE sentiment WHEN 'negative' THEN chr(10) || {O.quote(C.NEGATIVE_PROMPT_LINE)}
                           WHEN 'positive' THEN chr(10) || {O.quote(C.POSITIVE_PROMPT_LINE)} ELSE '' END
                   || CASE language WHEN 'vi' THEN chr(10) || {O.quote(C.VIETNAMESE_PROMPT_LINE)} ELSE '' END
                   || {blank} || 'Context:' || {gap} || context
                   || {blank} || 'User intent: ' || intent
                   || {blank} || 'User: ' || message
                   || {blank} || 'Assistant:' AS prompt
            FROM asked JOIN context USING (query_id))"""


def _asked(spark, sf_dir):
    """Every embedded document asks, and its three nearest documents are the context."""
    vectors = _embeddings(spark, sf_dir)
    documents = views.table(spark, sf_dir, "documents").select("doc_id", "text")
    matches = R.vector_topk(vectors, vectors, "vec_id", "embedding", skip_self=True)
    context = V.retrieved_context(matches, documents, "doc_id", "text")
    asked = vectors.join(documents, F.col("doc_id") == F.col("vec_id")).select(
        F.col("vec_id").alias("query_id"), F.col("text").alias("message"), "label"
    )
    return asked.join(context, "query_id")


def _digest(prompts):
    return prompts.select(
        "query_id", F.md5("prompt").alias("prompt_md5"), F.length("prompt").alias("prompt_length")
    )


@query(_prompt_sql(), "model_outputs")
def build_prompts(spark, sf_dir):
    outputs = views.model_outputs(spark, sf_dir).select(F.col("out_id").alias("query_id"), "raw_sentiment")
    labelled = (
        _asked(spark, sf_dir)
        .join(outputs, "query_id", "left")
        .withColumns(
            {
                "intent": F.expr(CATEGORY_OF_LABEL_SQL),
                "language": X.detect_language("message"),
                "sentiment": X.normalize_sentiment("raw_sentiment"),
            }
        )
    )
    return _digest(V.prompts(labelled))


def _short_prompt_sql() -> str:
    gap = f"chr(10) || '{C.SHORT_PROMPT_INDENT}'"
    return f"""
        WITH context AS (
            SELECT query_id, string_agg(text, chr(10) ORDER BY rank) AS context
            FROM ({TOPK_SQL}) JOIN documents ON doc_id = match_id GROUP BY query_id)
        SELECT query_id, md5(prompt) AS prompt_md5, CAST(length(prompt) AS INT) AS prompt_length FROM (
            SELECT query_id, {O.quote(C.SHORT_PROMPT_LINES[0])} || {gap} || {gap} || 'Context:' || {gap} || context
                   || {gap} || {gap} || 'User message: ' || text || {gap} || {gap} || 'Response:' AS prompt
            FROM context JOIN documents ON doc_id = query_id)"""


@query(_short_prompt_sql())
def build_prompts_short(spark, sf_dir):
    return _digest(V.short_prompts(_asked(spark, sf_dir)))


# --- terms ------------------------------------------------------------------------------------------


def _weights_sql(table: str, key: str, text: str, size: int = C.MAX_TERMS) -> str:
    """CTEs ending in ``weights`` (key, term, weight)."""
    return f"""
        tokens AS (SELECT {key}, unnest(regexp_extract_all(cleaned, '{C.WORD_TOKEN}')) AS term
                   FROM ({O.clean_table(table, key, text)})),
        vocabulary AS (SELECT term FROM tokens GROUP BY term ORDER BY count(*) DESC, term LIMIT {size}),
        tf AS (SELECT {key}, term, count(*) AS tf FROM tokens JOIN vocabulary USING (term) GROUP BY ALL),
        idf AS (SELECT term, ln((1 + (SELECT count(*) FROM {table})) / (1 + count(*))) + 1 AS idf
                FROM tf GROUP BY term),
        weights AS (SELECT {key}, term,
                           tf * idf / sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY {key})) AS weight
                    FROM tf JOIN idf USING (term))"""


@query(f"WITH {_weights_sql('documents', 'doc_id', 'text')} SELECT doc_id, term, round(weight, 6) AS weight FROM weights")
def tfidf_weights(spark, sf_dir):
    return T.tfidf_weights(views.document_terms(spark, sf_dir), "doc_id").withColumn("weight", F.round("weight", 6))


def _utterance_weights(spark, sf_dir):
    return T.tfidf_weights(views.utterance_terms(spark, sf_dir), "utt_id").select(
        F.substring("utt_id", 1, 1).alias("cluster"), "term", "weight"
    )


TOP_TERMS_SQL = f"""
    SELECT cluster, term, round(sum(weight), 6) AS weight,
           CAST(row_number() OVER (PARTITION BY cluster ORDER BY round(sum(weight), 6) DESC, term) AS INT) AS rank
    FROM (SELECT substr(utt_id, 1, 1) AS cluster, term, weight FROM weights)
    GROUP BY cluster, term QUALIFY rank <= 10"""


@query(f"WITH {_weights_sql('utterances', 'utt_id', 'text')} {TOP_TERMS_SQL}", "utterances")
def top_terms_per_cluster(spark, sf_dir):
    """The kind of an utterance (order, product, wish, chat) stands for its cluster."""
    return T.top_terms_per_cluster(_utterance_weights(spark, sf_dir))


@query(
    f"""WITH {_weights_sql('utterances', 'utt_id', 'text')}, top AS ({TOP_TERMS_SQL})
        SELECT cluster, coalesce(first(category ORDER BY position) FILTER (category IS NOT NULL), 'general') AS category
        FROM top LEFT JOIN (SELECT category, position, unnest(string_split(category, '_')) AS part
                            FROM (SELECT unnest({O.listing(C.CATEGORIES)}) AS category,
                                         unnest(range({len(C.CATEGORIES)})) AS position)) ON part = term
        GROUP BY cluster""",
    "utterances",
)
def name_clusters(spark, sf_dir):
    return T.name_clusters(T.top_terms_per_cluster(_utterance_weights(spark, sf_dir)))


@query()
def cluster_texts(spark, sf_dir):
    clustered, _ = T.cluster_texts(views.document_terms(spark, sf_dir))
    return clustered.select("doc_id", "cluster")


@query()
def cluster_categories(spark, sf_dir):
    return T.cluster_categories(views.utterance_terms(spark, sf_dir)).select("utt_id", "cluster", "category")


@query()
def categorize_pairs(spark, sf_dir):
    """Pairs without a category column, analyzed and then clustered."""
    pairs = views.qa(spark, sf_dir).drop("category")
    return T.categorize_pairs(V.analyze_pairs(pairs)).select("qa_id", "question_clean", "category")


@query()
def pca_features(spark, sf_dir):
    from pyspark.ml.functions import vector_to_array

    projected = T.pca_features(views.document_terms(spark, sf_dir), 50)
    return projected.select(
        "doc_id", F.posexplode(vector_to_array("components")).alias("component", "value")
    )


# --- models -----------------------------------------------------------------------------------------------


FEATURES = ["n_chars", "n_words", "intent_id"]


def _feature_rows(spark, sf_dir):
    """Labelled documents with numeric features; the quality label is the category."""
    documents = views.table(spark, sf_dir, "documents")
    labels = views.table(spark, sf_dir, "labels")
    rows = documents.join(labels, "doc_id").select(
        "doc_id",
        F.col("n_chars").cast("double").alias("n_chars"),
        X.word_count("text").cast("double").alias("n_words"),
        F.col("lang").alias("intent"),
        F.when(F.col("quality") == 1, "good").otherwise("poor").alias("category"),
    )
    stored = materialize(M.with_label_id(rows, "intent"), "features")
    return M.scale_features(stored, FEATURES)


@query()
def rf_classifier(spark, sf_dir):
    model, scored = M.train_category_forest(_feature_rows(spark, sf_dir), "doc_id", FEATURES, "category")
    return M.score_labels(scored, model, "doc_id", "category").select("doc_id", "actual", "predicted", "confidence")


@query()
def feature_importance(spark, sf_dir):
    rows = _feature_rows(spark, sf_dir)
    model, _ = M.train_category_forest(rows, "doc_id", FEATURES, "category")
    return M.feature_importance(model, FEATURES, rows)


@query(
    """SELECT feature, round(importance, 6) AS importance, CAST(row_number() OVER (ORDER BY importance DESC, feature) AS INT) AS rank
       FROM (SELECT p_type AS feature, sum(CAST(round(p_retailprice * 100) AS BIGINT)) / (SELECT sum(CAST(round(p_retailprice * 100) AS BIGINT)) FROM part) AS importance
             FROM part GROUP BY p_type)"""
)
def sort_importance(spark, sf_dir):
    """The kinds of products by their share of all prices."""
    cents = F.round(F.col("p_retailprice") * 100).cast("bigint")
    part = views.table(spark, sf_dir, "part")
    total = part.agg(F.sum(cents)).scalar()
    shares = part.groupBy(F.col("p_type").alias("feature")).agg(F.sum(cents).alias("cents"))
    table = shares.select("feature", (F.col("cents") / total).alias("importance"))
    return M.sort_importance(table).withColumn("importance", F.round("importance", 6))


def _intent_model(spark, sf_dir):
    documents = views.texts(spark, sf_dir).select("doc_id", "text", "lang")
    return documents, *M.train_intent_classifier(documents, "doc_id", "text", "lang")


@query()
def intent_classifier(spark, sf_dir):
    """Scores of the held-out rows, as accuracy and weighted means."""
    _, model, scored = _intent_model(spark, sf_dir)
    return E.weighted_metrics(M.score_labels(scored.where("split = 'test'"), model, "doc_id", "lang"))


@query()
def score_intents(spark, sf_dir):
    """Every document with its most probable label; held-out rows alone give the metrics above."""
    _, model, scored = _intent_model(spark, sf_dir)
    return M.score_labels(scored, model, "doc_id", "lang").select("doc_id", "actual", "predicted", "confidence")


def _stored_model(spark, sf_dir):
    """The intent model, trained here, stored, and loaded by a session that knows nothing of it."""
    documents, model, scored = _intent_model(spark, sf_dir)
    store = ModelStore(spark, work_folder(spark, "models"))
    found = E.weighted_metrics(M.score_labels(scored.where("split = 'test'"), model, "doc_id", "lang")).first()
    version = store.save(model, {"accuracy": found.accuracy})
    return documents, M.score_labels(scored, model, "doc_id", "lang"), ModelStore(spark.newSession(), store.folder.path).load(version)


@query("SELECT doc_id, true AS same_label, true AS same_confidence, lang AS actual, true AS known, 1 AS model_version FROM documents")
def stored_model_scores(spark, sf_dir):
    """Every document scored by the stored model, against the one that was stored."""
    documents, before, scorer = _stored_model(spark, sf_dir)
    after = scorer.score(documents, "label").withColumnRenamed("confidence", "sure")
    known = F.col("label").isin(scorer.labels) & (F.col("sure") > 0) & (F.col("sure") <= 1)
    return after.join(before, "doc_id").select(
        "doc_id",
        (F.col("label") == F.col("predicted")).alias("same_label"),
        (F.abs(F.col("sure") - F.col("confidence")) < 1e-9).alias("same_confidence"),
        "actual",
        known.alias("known"),
        "model_version",
    )


@query("SELECT conv_id, turn, true AS known, 1 AS model_version FROM conversations WHERE role = 'user'")
def stream_stored_model(spark, sf_dir):
    """User turns of a stream scored with the stored version, each once, with a label that it knows."""
    *_, scorer = _stored_model(spark, sf_dir)
    turns = spark.readStream.schema(schemas.CONVERSATION_TURN).parquet(f"{sf_dir}/conversation[s].parquet").where("role = 'user'")
    scored = S.run_append(scorer.score(turns).select("conv_id", "turn", "predicted", "confidence", "model_version"), "model-scores")
    known = F.col("predicted").isin(scorer.labels) & (F.col("confidence") > 0) & (F.col("confidence") <= 1)
    return scored.select("conv_id", "turn", known.alias("known"), "model_version")


@query(
    """WITH labels AS (SELECT source || '/' || lang AS label, min(CASE WHEN lang = 'en' THEN 1 ELSE 2 END) AS since FROM documents
                       WHERE source IS NOT NULL AND lang IS NOT NULL GROUP BY 1)
       SELECT label, row_number() OVER (ORDER BY since, label) - 1 AS class_id, CAST(since AS BIGINT) AS since FROM labels"""
)
def label_dictionary(spark, sf_dir):
    """Labels of English documents first, then of all, then of all once more."""
    documents = views.table(spark, sf_dir, "documents").withColumn("label", F.concat("source", F.lit("/"), "lang"))
    dictionary = LabelDictionary(spark, work_folder(spark, "labels"))
    for batch in (documents.where("lang = 'en'"), documents, documents):
        dictionary.add(batch, "label")
    return dictionary.read()


# --- what results of fitted models have in common --------------------------------------------------


@query("SELECT doc_id, lang AS actual, true AS known, true AS sure FROM documents")
def score_intents_checked(spark, sf_dir):
    """Every document once, with its label, a predicted one that occurs, and a probability."""
    rows = score_intents(spark, sf_dir)
    known = F.col("predicted").isin([r[0] for r in rows.select("actual").distinct().collect()])
    return rows.select("doc_id", "actual", known.alias("known"), F.col("confidence").between(0.2, 1.0).alias("sure"))


@query("SELECT 3 AS n_features, 1.0 AS total, 0 AS negative")
def feature_importance_checked(spark, sf_dir):
    """Importances of all features, none negative, add up to one."""
    return feature_importance(spark, sf_dir).agg(
        F.count("*").cast("int").alias("n_features"),
        F.round(F.sum("importance"), 6).alias("total"),
        F.count_if(F.col("importance") < 0).cast("int").alias("negative"),
    )


@query("SELECT doc_id, true AS in_range FROM documents")
def cluster_texts_checked(spark, sf_dir):
    """Every document in one cluster."""
    clustered = cluster_texts(spark, sf_dir)
    return clustered.select("doc_id", F.col("cluster").between(0, len(C.CATEGORIES) - 1).alias("in_range"))


@query("SELECT doc_id, 50 AS n_components, true AS finite FROM documents")
def pca_features_checked(spark, sf_dir):
    """Every document with all its components."""
    finite = ~F.isnan("value") & (F.abs("value") < 1e6)
    return pca_features(spark, sf_dir).groupBy("doc_id").agg(
        F.count_distinct("component").cast("int").alias("n_components"), F.every(finite).alias("finite")
    )


@query(r"SELECT doc_id, true AS in_order, true AS inside, true AS small FROM documents WHERE regexp_matches(text, '\S')")
def chunk_at_separators_checked(spark, sf_dir):
    """Chunks are numbered from 0, are parts of the text, and no longer than the size."""
    texts = views.texts(spark, sf_dir).select("doc_id", "text")
    chunks = R.chunk_at_separators(texts, "doc_id", "text").join(texts, "doc_id")
    return chunks.groupBy("doc_id").agg(
        (F.count_distinct("chunk_no") == F.max("chunk_no") + 1).alias("in_order"),
        F.every(F.contains("text", "chunk")).alias("inside"),
        (F.max(F.char_length("chunk")) <= C.CHUNK_SIZE).alias("small"),
    )
