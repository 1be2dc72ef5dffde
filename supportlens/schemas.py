"""Fixed schemas of the records the library reads and writes."""

from pyspark.sql import types as T


def _strings(*names: str) -> list[T.StructField]:
    return [T.StructField(name, T.StringType()) for name in names]


QA_CSV = T.StructType(_strings("question", "answer", "category", "source", "timestamp"))

INSTRUCTION = T.StructType(_strings("instruction", "response", "category", "intent", "flags"))

MESSAGE = T.StructType(_strings("role", "content"))

FEEDBACK = T.StructType(
    _strings("session_id")
    + [T.StructField("rating", T.IntegerType())]
    + _strings("comment", "comments", "timestamp")
    + [T.StructField("conversation", T.ArrayType(MESSAGE))]
)

TRANSFER = T.StructType(
    _strings("session_id", "reason", "timestamp")
    + [T.StructField("conversation", T.ArrayType(MESSAGE))]
)

GROUPED_QA = T.MapType(
    T.StringType(),
    T.ArrayType(
        T.StructType(
            _strings("question", "answer")
            + [
                T.StructField(
                    "metadata",
                    T.StructType(
                        _strings("source", "category")
                        + [T.StructField("entities", T.ArrayType(T.StringType()))]
                    ),
                )
            ]
        )
    ),
)

GROUPED_INSTRUCTIONS = T.MapType(T.StringType(), T.ArrayType(T.StringType()))

CONVERSATION_TURN = T.StructType(
    [
        T.StructField("conv_id", T.LongType()),
        T.StructField("turn", T.LongType()),
        *_strings("role", "text"),
    ]
)
