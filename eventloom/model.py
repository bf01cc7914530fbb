"""Schemas and vocabularies shared by all operators."""

from pyspark.sql import types as T

# The names, bounds and patterns below define the accepted input.
EVENT_TYPES = ["page_view", "product_view", "add_to_cart", "remove_from_cart", "purchase"]
PLANS = ["free", "pro", "enterprise"]
DEVICE_TYPES = ["mobile", "desktop", "tablet"]

# (field, shortest, longest) in characters
TEXT_BOUNDS = [
    ("product_id", 1, 100),
    ("product_name", None, 500),
    ("category", None, 200),
    ("browser", None, 100),
    ("os", None, 100),
    ("source", None, 100),
    ("button_clicked", None, 100),
]
# (field, pattern as reported to the sender)
TEXT_PATTERNS = [
    ("currency", "^[A-Z]{3}$"),
    ("country", "^[A-Z]{2}$"),
    ("device_type", "^(mobile|desktop|tablet)$"),
]
MAX_PRICE = 1_000_000
MAX_QUANTITY = 10_000
MAX_URL = 2083
PROJECT_NAME_BOUNDS = (3, 100)
DURATION_BUCKETS = [0.01, 0.05, 0.1, 0.5, 1.0, 2.5, 5.0, 10.0]
FUNNEL_STEPS = ["page_view", "product_view", "add_to_cart", "purchase"]
# Expected share of each event type, in percent.
TARGET_MIX = {
    "page_view": 50,
    "product_view": 25,
    "add_to_cart": 15,
    "purchase": 7,
    "remove_from_cart": 3,
}
REJECT_STATUS = {
    "InvalidPayloadError": 400,
    "UnauthorizedError": 401,
    "ForbiddenError": 403,
    "NotFoundError": 404,
    "ValidationError": 422,
    "RateLimitExceededError": 429,
    "UnexpectedError": 500,
}
# End of the fixed values.

PROPERTIES = T.StructType(
    [
        T.StructField("page_url", T.StringType()),
        T.StructField("product_id", T.StringType()),
        T.StructField("product_name", T.StringType()),
        T.StructField("category", T.StringType()),
        T.StructField("price", T.LongType()),
        T.StructField("quantity", T.IntegerType()),
        T.StructField("currency", T.StringType()),
        T.StructField("country", T.StringType()),
        T.StructField("browser", T.StringType()),
        T.StructField("os", T.StringType()),
        T.StructField("device_type", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("button_clicked", T.StringType()),
    ]
)
PROPERTY_NAMES = PROPERTIES.fieldNames()

EVENT = T.StructType(
    [
        T.StructField("event_id", T.StringType()),
        T.StructField("project_id", T.StringType()),
        T.StructField("user_id", T.StringType()),
        T.StructField("session_id", T.StringType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("timestamp", T.TimestampType()),
        T.StructField("properties", PROPERTIES),
        T.StructField("created_at", T.TimestampType()),
    ]
)
EVENT_COLUMNS = EVENT.fieldNames()

PROJECT = T.StructType(
    [
        T.StructField("project_id", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("plan", T.StringType()),
        T.StructField("api_key", T.StringType()),
        T.StructField("created_at", T.TimestampType()),
    ]
)

# One HTTP-like request: `kind` is "single" (body is one event) or "batch"
# (body is {"events": [...]}).
REQUEST = T.StructType(
    [
        T.StructField("request_id", T.StringType()),
        T.StructField("kind", T.StringType()),
        T.StructField("api_key", T.StringType()),
        T.StructField("forwarded_for", T.StringType()),
        T.StructField("client_ip", T.StringType()),
        T.StructField("received_at", T.TimestampType()),
        T.StructField("body", T.StringType()),
    ]
)

# One message on the event log.
MESSAGE = T.StructType(
    [
        T.StructField("msg_id", T.StringType()),
        T.StructField("data", T.BinaryType()),
    ]
)

DEAD_LETTER = T.StructType(
    [
        T.StructField("original_msg_id", T.StringType()),
        T.StructField("error", T.StringType()),
        T.StructField("error_type", T.StringType()),
        T.StructField("failed_at", T.TimestampType()),
        T.StructField("raw_data", T.BinaryType()),
    ]
)
