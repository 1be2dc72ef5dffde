"""Word lists, lookup tables, patterns and text formats.

These must stay as they are for results to be right.
"""

# --- fixed values: labels -----------------------------------------------------

CATEGORIES = [
    "order_tracking", "product_info", "returns", "shipping", "payment",
    "account", "product_recommendation", "general",
]
SENTIMENTS = ["positive", "neutral", "negative"]
DEFAULT_CATEGORY = "general"
DEFAULT_SENTIMENT = "neutral"

# --- fixed values: text cleaning ------------------------------------------------

# Character classes written so that Java regex and RE2 read them the same way.
WHITESPACE = (
    r"\t-\r\x{1C}-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
    r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
)
ASCII_PUNCTUATION = r"!-/:-@\[-`{-~"
DIGITS = r"\p{Nd}"
WORD_TOKEN = r"[\p{L}\p{N}_]{2,}"

VIETNAMESE_LETTERS = (
    "àáảãạăắằẳẵặâấầẩẫậèéẻẽẹêếềểễệìíỉĩịòóỏõọôốồổỗộơớờởỡợùúủũụưứừửữựỳýỷỹỵđ"
)

ENGLISH_STOPWORDS = """
    a an the and or but if because as what when where how who which this that
    these those then just so than such both through about for is of while during
    to from in out on off again further once here there all any each few more
    most other some no nor not only own same too very can will should now d ll m
    o re ve y ain aren couldn didn doesn hadn hasn haven isn ma mightn mustn needn
    shan shouldn wasn weren won wouldn i me my myself we our ours ourselves you
    your yours yourself yourselves he him his himself she her hers herself it its
    itself they them their theirs themselves
""".split()

VIETNAMESE_STOPWORDS = """
    và của cho là để trong đến với các những được tại có không này khi từ bạn tôi
    chúng mình đã sẽ đang về như nhưng nếu vì một hai ba bốn năm sáu bảy tám chín
    mười
""".split()

# --- fixed values: entity and category rules --------------------------------------

PRODUCT_TYPES = [
    "laptop", "computer", "phone", "tablet", "camera", "headphone",
    "speaker", "monitor", "keyboard", "mouse", "printer", "scanner",
]
ORDER_ID_PATTERN = rf"order[{WHITESPACE}]+#?({DIGITS}+)"

# First rule with a word contained in the lower-cased question wins.
KEYWORD_RULES = [
    ("order_tracking", ["order", "track"]),
    ("returns", ["return", "refund"]),
    ("shipping", ["ship", "deliver"]),
    ("payment", ["pay"]),
    ("product_recommendation", ["recommend", "best", "good"]),
    ("product_info", ["laptop", "product", "item"]),
]

TOPIC_WORD = "laptop"
TOPIC_CATEGORIES = ["product_recommendation", "product_info"]
TOPIC_TERMS = [
    "gaming", "battery", "ram", "memory", "storage", "ssd", "hdd",
    "processor", "cpu", "graphics", "gpu",
]

# --- fixed values: lookup tables -----------------------------------------------------

SUGGESTED_ACTIONS = {
    "order_status": ["Track Order", "View Order History"],
    "product_info": ["View Product Details", "Check Availability"],
    "shipping": ["Check Shipping Status", "Update Shipping Address"],
    "returns": ["Start Return", "View Return Policy"],
    "general": ["Contact Support", "View FAQ"],
}
DEFAULT_ACTIONS = ["Contact Support"]

NEXT_STEPS = {
    "en": {
        "order_tracking": [
            "When will my order arrive?",
            "Can I change my shipping address?",
            "Why hasn't my order shipped yet?",
        ],
        "product_info": [
            "What are the specifications of this product?",
            "Is this product in stock?",
            "Does this product come with a warranty?",
        ],
        "returns": [
            "How do I return a product?",
            "What's your refund policy?",
            "Can I exchange instead of returning?",
        ],
        "shipping": [
            "What shipping methods do you offer?",
            "How much does shipping cost?",
            "Do you ship internationally?",
        ],
        "payment": [
            "What payment methods do you accept?",
            "Is there a problem with my payment?",
            "Can I pay in installments?",
        ],
        "account": [
            "How do I reset my password?",
            "How do I update my account information?",
            "Why can't I log in to my account?",
        ],
        "product_recommendation": [
            "What's the best laptop for students?",
            "Can you recommend a gaming laptop?",
            "Which laptop has the best battery life?",
        ],
        "general": [
            "How can I contact customer support?",
            "What are your business hours?",
            "Do you have any ongoing promotions?",
        ],
    },
    "vi": {
        "order_tracking": [
            "Khi nào đơn hàng của tôi sẽ đến?",
            "Tôi có thể thay đổi địa chỉ giao hàng không?",
            "Tại sao đơn hàng của tôi chưa được gửi đi?",
        ],
        "product_info": [
            "Thông số kỹ thuật của sản phẩm này là gì?",
            "Sản phẩm này còn hàng không?",
            "Sản phẩm này có bảo hành không?",
        ],
        "returns": [
            "Làm thế nào để trả lại sản phẩm?",
            "Chính sách hoàn tiền của bạn là gì?",
            "Tôi có thể đổi hàng thay vì trả lại không?",
        ],
        "shipping": [
            "Bạn cung cấp những phương thức vận chuyển nào?",
            "Chi phí vận chuyển là bao nhiêu?",
            "Bạn có giao hàng quốc tế không?",
        ],
        "payment": [
            "Bạn chấp nhận những phương thức thanh toán nào?",
            "Có vấn đề với thanh toán của tôi không?",
            "Tôi có thể trả góp không?",
        ],
        "account": [
            "Làm thế nào để đặt lại mật khẩu?",
            "Làm thế nào để cập nhật thông tin tài khoản?",
            "Tại sao tôi không thể đăng nhập vào tài khoản?",
        ],
        "product_recommendation": [
            "Laptop nào tốt nhất cho sinh viên?",
            "Bạn có thể giới thiệu laptop chơi game không?",
            "Laptop nào có thời lượng pin tốt nhất?",
        ],
        "general": [
            "Làm thế nào để liên hệ với bộ phận hỗ trợ khách hàng?",
            "Giờ làm việc của bạn là gì?",
            "Bạn có chương trình khuyến mãi nào đang diễn ra không?",
        ],
    },
}

TRANSLATIONS = {
    "en": {
        "next_steps": "Next steps",
        "track_order": "Track my order",
        "product_info": "Product information",
        "return_policy": "Return policy",
        "shipping_info": "Shipping information",
        "payment_methods": "Payment methods",
        "contact_support": "Contact support",
    },
    "vi": {
        "next_steps": "Các bước tiếp theo",
        "track_order": "Theo dõi đơn hàng",
        "product_info": "Thông tin sản phẩm",
        "return_policy": "Chính sách đổi trả",
        "shipping_info": "Thông tin vận chuyển",
        "payment_methods": "Phương thức thanh toán",
        "contact_support": "Liên hệ hỗ trợ",
    },
}

# --- fixed values: message, question and prompt formats ---------------------------------

ORDER_MESSAGE = "I want to track my order #%s"
PRODUCT_ID_MESSAGE = "Can you tell me about product #%s?"
PRODUCT_NAME_MESSAGE = "Can you tell me about %s?"
CRITERIA_MESSAGE = "Can you recommend a product that %s?"

PRODUCT_SOURCE = "product_database"
PRODUCT_QUESTIONS = {
    "specs": (
        "What are the specifications of the {name}?",
        "The {name} features {specs}. It's priced at ${price}.",
        "product_info",
    ),
    "price": (
        "How much does the {name} cost?",
        "The {name} is priced at ${price}.",
        "product_info",
    ),
    "gaming": (
        "Is the {name} good for gaming?",
        "Yes, the {name} is specifically designed for gaming with its {specs}. "
        "It offers excellent performance for modern games.",
        "product_recommendation",
    ),
    "workstation": (
        "Can I use the {name} for video editing?",
        "Absolutely! The {name} is a powerful workstation with {specs}, making it "
        "excellent for video editing, 3D modeling, and other demanding creative tasks.",
        "product_recommendation",
    ),
    "student": (
        "Is the {name} suitable for students?",
        "Yes, the {name} is an excellent choice for students. It's affordable at "
        "${price} while offering {specs}, which is perfect for schoolwork, research, "
        "and everyday tasks.",
        "product_recommendation",
    ),
}

QA_DOCUMENT = "Question: {question}\nAnswer: {answer}"
INSTRUCTION_DOCUMENT_FIELDS = ["Instruction", "Response", "Category", "Intent"]
INSTRUCTION_DOCUMENT_INDENT = " " * 16

SYSTEM_PROMPT_INDENT = " " * 8
SYSTEM_PROMPT_LINES = [
    "You are a helpful customer support assistant for an e-commerce company.",
    "You help customers with their orders, product information, returns, shipping, "
    "payments, and account issues.",
    "You should be polite, helpful, and concise in your responses.",
    "",
    "If the user is speaking in Vietnamese, respond in Vietnamese. Otherwise, respond in English.",
    "",
    "If the user seems frustrated or angry, be extra empathetic and helpful.",
    "",
    "Use the provided context to answer the user's question if relevant.",
    "If the context doesn't contain the information needed, use your general knowledge "
    "but be honest about limitations.",
    "",
    "Do not make up specific order details, product information, or policies that "
    "aren't in the context.",
    "",
]
NEGATIVE_PROMPT_LINE = (
    "The user seems frustrated or upset. Be extra empathetic and helpful in your response."
)
POSITIVE_PROMPT_LINE = (
    "The user seems happy or satisfied. Maintain the positive tone in your response."
)
VIETNAMESE_PROMPT_LINE = "The user is speaking in Vietnamese. Respond in Vietnamese."

CHAT_PROMPT_INDENT = " " * 12
CHAT_PROMPT_LINES = [
    "System: {system}",
    "",
    "Context:",
    "{context}",
    "",
    "User intent: {intent}",
    "",
    "User: {message}",
    "",
    "Assistant:",
]

SHORT_PROMPT_INDENT = " " * 16
SHORT_PROMPT_LINES = [
    "You are a helpful customer support chatbot. Use the following context to answer "
    "the user's question.",
    "",
    "Context:",
    "{context}",
    "",
    "User message: {message}",
    "",
    "Response:",
]

LABEL_PROMPT_INDENT = " " * 12
INTENT_PROMPT_LINES = [
    "You are an intent classifier for a customer support chatbot.",
    "Classify the following message into one of these categories:",
    "- order_tracking: Questions about order status, tracking, or delivery",
    "- product_info: Questions about product details, specifications, or availability",
    "- returns: Questions about returning products, refunds, or exchanges",
    "- shipping: Questions about shipping methods, costs, or times",
    "- payment: Questions about payment methods, issues, or billing",
    "- account: Questions about user accounts, login, or registration",
    "- product_recommendation: Requests for product recommendations or comparisons",
    "- general: General inquiries or greetings",
    "",
    "User message: {message}",
    "",
    "Intent:",
]
SENTIMENT_PROMPT_LINES = [
    "You are a sentiment analyzer for a customer support chatbot.",
    "Analyze the sentiment of the following message and classify it as:",
    "- positive: The user is happy, satisfied, or expressing gratitude",
    "- neutral: The user is asking a question or making a neutral statement",
    "- negative: The user is frustrated, angry, or expressing dissatisfaction",
    "",
    "User message: {message}",
    "",
    "Sentiment:",
]

# --- fixed values: limits and parameters ---------------------------------------------------

RATING_RANGE = (1, 5)
SPARSE_PERCENT = 50.0
IQR_FACTOR = 1.5
IMBALANCE_PERCENT = (20.0, 80.0)
MAX_PLOT_VALUES = 50
HISTOGRAM_BINS = 50
CHUNK_SIZE = 1000
CHUNK_OVERLAP = 100
CHUNK_SEPARATORS = ["\n\n", "\n", " ", ""]
RETRIEVED_DOCUMENTS = 3
MAX_TERMS = 1000
TOP_CLUSTER_TERMS = 10
TEST_PERCENT = 20
SEED = 42
