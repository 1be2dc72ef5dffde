"""The text rules as DuckDB SQL, written independently of the Spark expressions."""

from supportlens import constants as C


def quote(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def listing(values: list[str]) -> str:
    return "[" + ", ".join(quote(v) for v in values) + "]"


def words(text: str) -> str:
    return f"regexp_extract_all({text}, '[^{C.WHITESPACE}]+')"


def strip(text: str) -> str:
    return f"regexp_replace({text}, '^[{C.WHITESPACE}]+|[{C.WHITESPACE}]+$', '', 'g')"


def vietnamese(text: str) -> str:
    return f"regexp_matches(lower({text}), '[{C.VIETNAMESE_LETTERS}]')"


def clean(text: str) -> str:
    plain = f"regexp_replace(lower(coalesce({text}, '')), '[{C.ASCII_PUNCTUATION}{C.DIGITS}]+', '', 'g')"
    stop = (
        f"CASE WHEN {vietnamese(f'coalesce({text}, {quote(str())})')} THEN {listing(C.VIETNAMESE_STOPWORDS)}"
        f" ELSE {listing(C.ENGLISH_STOPWORDS)} END"
    )
    return (
        f"array_to_string(list_filter({words(plain)}, lambda w: NOT list_contains({stop}, w)), ' ')"
    )


def clean_table(table: str, columns: str, text: str) -> str:
    """Same as ``clean`` for a whole table, with the stopword list chosen once per row."""
    return f"""
        SELECT {columns}, array_to_string(list_filter(ws, lambda w: NOT list_contains(stop, w)), ' ') AS cleaned
        FROM (SELECT *, {words(f"regexp_replace(lower(coalesce({text}, '')), '[{C.ASCII_PUNCTUATION}{C.DIGITS}]+', '', 'g')")} AS ws,
                     CASE WHEN {vietnamese(f"coalesce({text}, '')")} THEN {listing(C.VIETNAMESE_STOPWORDS)}
                          ELSE {listing(C.ENGLISH_STOPWORDS)} END AS stop
              FROM {table})"""


def language(text: str) -> str:
    return f"CASE WHEN {text} IS NULL THEN 'unknown' WHEN {vietnamese(text)} THEN 'vi' ELSE 'en' END"


def order_ids(text: str) -> str:
    found = f"regexp_extract_all(lower(coalesce({text}, '')), '{C.ORDER_ID_PATTERN}', 1)"
    return f"list_transform({found}, lambda n: 'ORDER_ID:' || n)"


def product_types(text: str) -> str:
    return (
        f"list_transform(list_filter({listing(C.PRODUCT_TYPES)}, lambda p: contains(lower(coalesce({text}, '')), p)),"
        f" lambda p: 'PRODUCT_TYPE:' || p)"
    )


def entities(text: str) -> str:
    return f"list_concat({order_ids(text)}, {product_types(text)})"


def category(text: str) -> str:
    cases = " ".join(
        f"WHEN regexp_matches(lower({text}), '{'|'.join(keywords)}') THEN {quote(label)}"
        for label, keywords in C.KEYWORD_RULES
    )
    return f"CASE {cases} ELSE '{C.DEFAULT_CATEGORY}' END"


def normalized(raw: str, labels: list[str], default: str) -> str:
    """Expects ``raw`` to be a plain column name."""
    lowered = f"lower({strip(raw)})"
    answer = f"CASE WHEN contains({lowered}, ':') THEN {strip(f'substr({lowered}, strpos({lowered}, chr(58)) + 1)')} ELSE {lowered} END"
    return (
        f"CASE WHEN list_contains({listing(labels)}, {answer}) THEN {answer} ELSE"
        f" coalesce(list_filter({listing(labels)}, lambda v: contains({answer}, v))[1], '{default}') END"
    )


def intent(raw: str) -> str:
    return normalized(raw, C.CATEGORIES, C.DEFAULT_CATEGORY)


def sentiment(raw: str) -> str:
    return normalized(raw, C.SENTIMENTS, C.DEFAULT_SENTIMENT)


def next_steps_values() -> str:
    return "VALUES " + ", ".join(
        f"({quote(language)}, {quote(intent)}, {listing(steps)})"
        for language, by_intent in C.NEXT_STEPS.items()
        for intent, steps in by_intent.items()
    )
