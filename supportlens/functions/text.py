"""Text functions as column expressions; nothing here leaves the JVM."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from supportlens import constants as C

ColumnOrName = Column | str

# Regex classes in Java form. Characters below 256 are listed one by one, which Java
# looks up in a table; the rare ones are tried only for characters above.
SPACE = (
    r"[\t\n\x0B\f\r\x1C\x1D\x1E\x1F \x85\xA0"
    r"[[^\x00-\xFF]&&[\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]]]"
)
SPACE_CHARACTERS = "\t\n\x0b\f\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(
    map(chr, [*range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000])
)
PUNCTUATION_OR_DIGIT = r"[\p{Punct}\p{Nd}]"
TERM_CHARACTERS = "".join(c for c in map(chr, range(256)) if c.isalnum() or c == "_")
TERM = rf"[{TERM_CHARACTERS}[[^\x00-\xFF]&&[\p{{L}}\p{{N}}]]]{{2,}}"
VIETNAMESE = rf"[[^\x00-\x7F]&&[{C.VIETNAMESE_LETTERS}]]"


def _column(value: ColumnOrName) -> Column:
    return F.col(value) if isinstance(value, str) else value


def words(text: ColumnOrName) -> Column:
    """Whitespace-separated words."""
    return F.array_remove(F.split(_column(text), f"{SPACE}+"), "")


def strip(text: ColumnOrName) -> Column:
    """Remove whitespace of any kind at both ends (a plain ``trim`` knows only blanks)."""
    return F.btrim(_column(text), F.lit(SPACE_CHARACTERS))


def has_vietnamese_letter(text: ColumnOrName) -> Column:
    return F.lower(_column(text)).rlike(VIETNAMESE)


def clean_text(text: ColumnOrName) -> Column:
    """Lower-cased words without ASCII punctuation, digits and stopwords; null gives ''."""
    raw = F.coalesce(_column(text), F.lit(""))
    plain = F.regexp_replace(F.lower(raw), f"{PUNCTUATION_OR_DIGIT}+", "")

    def without(stopwords: list[str]) -> Column:
        dropped = ["", *stopwords]
        kept = F.filter(F.split(plain, f"{SPACE}+"), lambda word: ~word.isin(dropped))
        return F.array_join(kept, " ")

    return F.when(has_vietnamese_letter(raw), without(C.VIETNAMESE_STOPWORDS)).otherwise(
        without(C.ENGLISH_STOPWORDS)
    )


def word_count(text: ColumnOrName) -> Column:
    return F.coalesce(F.size(words(text)), F.lit(0))


def char_length(text: ColumnOrName) -> Column:
    return F.length(_column(text))


def detect_language(text: ColumnOrName) -> Column:
    """``vi`` if a letter of the fixed set occurs, else ``en``; ``unknown`` for null."""
    raw = _column(text)
    return (
        F.when(raw.isNull(), "unknown").when(has_vietnamese_letter(raw), "vi").otherwise("en")
    )


def extract_order_ids(text: ColumnOrName) -> Column:
    lowered = F.lower(F.coalesce(_column(text), F.lit("")))
    return F.transform(
        F.regexp_extract_all(lowered, F.lit(C.ORDER_ID_PATTERN), F.lit(1)),
        lambda number: F.concat(F.lit("ORDER_ID:"), number),
    )


def extract_product_types(text: ColumnOrName) -> Column:
    lowered = F.lower(F.coalesce(_column(text), F.lit("")))
    found = [
        F.when(lowered.contains(word), f"PRODUCT_TYPE:{word}").otherwise("")
        for word in C.PRODUCT_TYPES
    ]
    return F.array_remove(F.array(*found), "")


def extract_entities(text: ColumnOrName) -> Column:
    """Order ids in text order, then product types in list order."""
    return F.concat(extract_order_ids(text), extract_product_types(text))


def keyword_category(question: ColumnOrName) -> Column:
    """Category of the first keyword rule that matches."""
    lowered = F.lower(_column(question))
    result = None
    for category, keywords in C.KEYWORD_RULES:
        hit = lowered.contains(keywords[0])
        for keyword in keywords[1:]:
            hit = hit | lowered.contains(keyword)
        result = F.when(hit, category) if result is None else result.when(hit, category)
    return result.otherwise(C.DEFAULT_CATEGORY)


def normalize_label(raw: ColumnOrName, labels: list[str], default: str) -> Column:
    """Map raw model output to one of ``labels``.

    The text after the first colon counts; if it is no label, the first label it
    contains is taken, else ``default``.
    """
    lowered = F.lower(strip(raw))
    colon = F.instr(lowered, ":")
    answer = F.when(
        colon > 0, strip(F.substr(lowered, colon + F.lit(1)))
    ).otherwise(lowered)
    contained = [F.when(answer.contains(label), label) for label in labels]
    return F.when(answer.isin(labels), answer).otherwise(
        F.coalesce(*contained, F.lit(default))
    )


def normalize_intent(raw: ColumnOrName) -> Column:
    return normalize_label(raw, C.CATEGORIES, C.DEFAULT_CATEGORY)


def normalize_sentiment(raw: ColumnOrName) -> Column:
    return normalize_label(raw, C.SENTIMENTS, C.DEFAULT_SENTIMENT)


def normalize_instruction(text: ColumnOrName) -> Column:
    return strip(F.lower(_column(text)))


def qa_document(question: ColumnOrName, answer: ColumnOrName) -> Column:
    """Text under which a question/answer pair is indexed."""
    template = C.QA_DOCUMENT.replace("{question}", "%s").replace("{answer}", "%s")
    return F.format_string(
        template, F.coalesce(_column(question), F.lit("None")), F.coalesce(_column(answer), F.lit("None"))
    )


def instruction_document(*values: ColumnOrName) -> Column:
    """Text under which an instruction record is indexed; one value per document field."""
    template = f"\n{C.INSTRUCTION_DOCUMENT_INDENT}".join(
        f"{field}: %s" for field in C.INSTRUCTION_DOCUMENT_FIELDS
    )
    parts = [F.coalesce(_column(value), F.lit("None")) for value in values]
    return strip(F.format_string(template, *parts))


def term_tokens(text: ColumnOrName) -> Column:
    """Terms of two or more word characters."""
    return F.regexp_extract_all(_column(text), F.lit(TERM), F.lit(0))
