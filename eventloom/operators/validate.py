"""Field, time and consistency rules of a raw event.

`check_events` reads each raw item once and adds, in stages that Spark keeps as
separate projections (fields, kinds, values, rules, lists),

* `event`  - the typed and normalised reading (struct), and
* `errors` - `array<struct<loc, type, msg>>`, empty for a valid event.

Rows only: no shuffle and no Python.
"""

from __future__ import annotations

from functools import cache
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.functions import lax
from eventloom.functions.money import minor_units
from eventloom.functions.urls import with_url
from eventloom.model import (
    EVENT_TYPES,
    MAX_PRICE,
    MAX_QUANTITY,
    MAX_URL,
    PROPERTY_NAMES,
    TEXT_BOUNDS,
    TEXT_PATTERNS,
)
from eventloom.plans.fence import fenced
from eventloom.settings import Settings

TOP_FIELDS = ["user_id", "session_id", "event_type", "timestamp", "properties"]

# Error texts reported to the sender, by error type.
MESSAGES = {
    "missing": "Field required",
    "model_attributes_type": "Input should be a valid dictionary or object to extract fields from",
    "string_type": "Input should be a valid string",
    "enum": "Input should be 'page_view', 'product_view', 'add_to_cart', 'remove_from_cart' or 'purchase'",
    "datetime_type": "Input should be a valid datetime",
    "datetime_parsing": "Input should be a valid datetime",
    "datetime_from_date_parsing": "Input should be a valid datetime or date",
    "float_type": "Input should be a valid number",
    "float_parsing": "Input should be a valid number, unable to parse string as a number",
    "int_type": "Input should be a valid integer",
    "int_parsing": "Input should be a valid integer, unable to parse string as an integer",
    "int_parsing_size": "Unable to parse input string as an integer, exceeded maximum size",
    "int_from_float": "Input should be a valid integer, got a number with a fractional part",
    "finite_number": "Input should be a finite number",
    "url_type": "URL input should be a string or URL",
    "url_parsing": "Input should be a valid URL",
    "url_scheme": "URL scheme should be 'http' or 'https'",
    "url_too_long": f"URL should have at most {MAX_URL} characters",
    "json_invalid": "JSON decode error",
    "list_type": "Input should be a valid list",
}
TOO_NEW = "Value error, timestamp cannot be in the future"
TOO_OLD = "Value error, timestamp is too old (max {days} days)"
# End of the fixed values.

ERROR = "struct<loc:string,type:string,msg:string>"


def failure(loc: str, kind: str, message: str | None = None) -> Column:
    return F.struct(
        F.lit(loc).alias("loc"),
        F.lit(kind).alias("type"),
        F.lit(MESSAGES[kind] if message is None else message).alias("msg"),
    )


def _typed_failure(loc: str, problem: Column) -> Column:
    """The failure of a value that could not be read; its type is known per row only."""
    message = F.element_at(_message_map(), problem)
    return F.when(
        problem.isNotNull(),
        F.struct(F.lit(loc).alias("loc"), problem.alias("type"), message.alias("msg")),
    )


@cache
def _message_map() -> Column:
    return F.create_map(*[F.lit(part) for pair in MESSAGES.items() for part in pair])


# --- one rule per field; each gives an error struct or null -------------------


def _text_rule(loc: str, odd: Column, value: Column, low: int | None, high: int | None) -> Column:
    checks = [F.when(lax.wrong(odd), failure(loc, "string_type"))]
    size = F.length(value)
    if low is not None:
        plural = "" if low == 1 else "s"
        message = f"String should have at least {low} character{plural}"
        checks.append(F.when(size < low, failure(loc, "string_too_short", message)))
    if high is not None:
        message = f"String should have at most {high} characters"
        checks.append(F.when(size > high, failure(loc, "string_too_long", message)))
    return F.coalesce(*checks)


def _pattern_rule(loc: str, odd: Column, value: Column, pattern: str) -> Column:
    # `$` would also match before a final line feed.
    anchored = rf"\A{pattern[1:-1]}\z"
    message = f"String should match pattern '{pattern}'"
    return F.coalesce(
        F.when(lax.wrong(odd), failure(loc, "string_type")),
        F.when(~value.rlike(anchored), failure(loc, "string_pattern_mismatch", message)),
    )


def _url_rule(loc: str, odd: Column, problem: Column) -> Column:
    return F.coalesce(
        F.when(lax.wrong(odd), failure(loc, "url_type")),
        _typed_failure(loc, problem),
    )


def _price_rule(loc: str, odd: Column, value: Column) -> Column:
    above = f"Input should be less than or equal to {MAX_PRICE}"
    return F.coalesce(
        _typed_failure(loc, lax.diagnose_float(odd, value)),
        # NaN orders above every number, so it fails here.
        F.when(value > MAX_PRICE, failure(loc, "less_than_equal", above)),
        F.when(value <= 0, failure(loc, "greater_than", "Input should be greater than 0")),
    )


def _quantity_rule(loc: str, odd: Column, value: Column) -> Column:
    above = f"Input should be less than or equal to {MAX_QUANTITY}"
    below = "Input should be greater than or equal to 1"
    return F.coalesce(
        _typed_failure(loc, lax.diagnose_int(odd, value)),
        F.when(value > MAX_QUANTITY, failure(loc, "less_than_equal", above)),
        F.when(value < 1, failure(loc, "greater_than_equal", below)),
    )


def _event_type_rule(present: Column, value: Column) -> Column:
    return (
        F.when(~present, failure("event_type", "missing"))
        .when(value.isNull() | ~value.isin(EVENT_TYPES), failure("event_type", "enum"))
    )


def time_rule(timestamp: Column, received_at: Column, settings: Settings) -> Column:
    """Bounds of the event time around its receipt; the bounds themselves pass."""
    latest = received_at + F.make_dt_interval(mins=F.lit(settings.max_future_minutes))
    earliest = received_at - F.make_dt_interval(days=F.lit(settings.max_age_days))
    too_old = TOO_OLD.format(days=settings.max_age_days)
    return F.when(timestamp > latest, failure("timestamp", "value_error", TOO_NEW)).when(
        timestamp < earliest, failure("timestamp", "value_error", too_old)
    )


def _timestamp_rule(
    present: Column, odd: Column, value: Column, received_at: Column, settings: Settings
) -> Column:
    return F.when(~present, failure("timestamp", "missing")).otherwise(
        F.coalesce(
            _typed_failure("timestamp", lax.diagnose_time(odd, value)),
            time_rule(value, received_at, settings),
        )
    )


def consistency_rule(event_type: Column, product_id: Column, price: Column, quantity: Column) -> Column:
    """Properties each event type needs; the first missing one is reported."""

    def needs(label: str, name: str) -> Column:
        return failure("", "value_error", f"Value error, {label} requires {name}")

    no_product = product_id.isNull() | (product_id == "")
    rule = F.when(
        event_type == "purchase",
        F.when(no_product, needs("PURCHASE", "product_id"))
        .when(price.isNull(), needs("PURCHASE", "price"))
        .when(quantity.isNull(), needs("PURCHASE", "quantity")),
    )
    for name in ["add_to_cart", "remove_from_cart"]:
        rule = rule.when(
            (event_type == name) & no_product, needs(name, "product_id")
        )
    return rule.when(
        (event_type == "product_view") & no_product, needs("PRODUCT_VIEW", "product_id")
    )


# --- the operator -------------------------------------------------------------


class _Stages(NamedTuple):
    """The columns of each validation stage, in order."""

    fields: dict[str, Column]
    inner: dict[str, Column]
    kinds: dict[str, Column]
    values: dict[str, Column]
    rules: dict[str, Column]
    lists: dict[str, Column]
    errors: Column
    event: Column


@cache
def _stages(settings: Settings) -> _Stages:
    """Built once per settings: there are many expressions, and they never differ.

    An item is read twice, each for what it does best: as a variant, which tells
    kinds and absence apart, and with a schema of texts, which gets all values
    in one pass.
    """
    top_variants = ",".join(f"`{name}`:variant" for name in TOP_FIELDS)
    inner_variants = ",".join(f"`{name}`:variant" for name in PROPERTY_NAMES)
    inner_texts = ",".join(f"`{name}`:string" for name in PROPERTY_NAMES)
    top_texts = ",".join(f"`{name}`:string" for name in TOP_FIELDS[:4])
    texts = f"struct<{top_texts},properties:struct<{inner_texts}>>"
    fields = {
        "_f": F.try_variant_get("item", "$", f"struct<{top_variants}>"),
        "_t": F.from_json("item_text", texts),
    }
    inner_fields = {"_p": F.try_variant_get("_f.properties", "$", f"struct<{inner_variants}>")}

    variants = {name: F.col(f"_f.{name}") for name in TOP_FIELDS[:4]}
    variants |= {name: F.col(f"_p.{name}") for name in PROPERTY_NAMES}
    odd = {"price": lax.odd_for_number, "quantity": lax.odd_for_int}
    odd_kinds = [
        odd.get(name, lax.odd_for_text)(variant).alias(name)
        for name, variant in variants.items()
    ]
    present = F.struct(
        F.col("_f").isNotNull().alias("item"),
        *[F.col(f"_f.{name}").isNotNull().alias(name) for name in TOP_FIELDS[2:]],
        F.col("_p").isNotNull().alias("property_object"),
    )

    readers = {"timestamp": lax.read_time, "price": lax.read_float, "quantity": lax.read_int}
    given_texts = {name: F.col(f"_t.{name}") for name in TOP_FIELDS[:4]}
    given_texts |= {name: F.col(f"_t.properties.{name}") for name in PROPERTY_NAMES}
    values = F.struct(
        *[
            readers.get(name, lax.read_text)(text, F.col(f"_k.{name}")).alias(name)
            for name, text in given_texts.items()
        ]
    )

    def kind(name: str) -> Column:
        return F.col(f"_k.{name}")

    def value(name: str) -> Column:
        return F.col(f"_v.{name}")

    def has(name: str) -> Column:
        return F.col(f"_has.{name}")

    def inner(name: str) -> str:
        return f"properties.{name}"

    of_property = {"page_url": _url_rule(inner("page_url"), kind("page_url"), F.col("_page_url_problem"))}
    for name, low, high in TEXT_BOUNDS:
        of_property[name] = _text_rule(inner(name), kind(name), value(name), low, high)
    for name, pattern in TEXT_PATTERNS:
        of_property[name] = _pattern_rule(inner(name), kind(name), value(name), pattern)
    of_property["price"] = _price_rule(inner("price"), kind("price"), value("price"))
    of_property["quantity"] = _quantity_rule(inner("quantity"), kind("quantity"), value("quantity"))
    no_properties = F.when(~has("properties"), failure("properties", "missing")).when(
        ~has("property_object"), failure("properties", "model_attributes_type")
    )
    rules = [
        _text_rule("user_id", kind("user_id"), value("user_id"), None, None),
        _text_rule("session_id", kind("session_id"), value("session_id"), None, None),
        _event_type_rule(has("event_type"), value("event_type")),
        _timestamp_rule(has("timestamp"), kind("timestamp"), value("timestamp"), F.col("received_at"), settings),
        no_properties,
        *[of_property[name] for name in PROPERTY_NAMES],
    ]

    # A stage of their own, so that the list below computes none twice.  Higher-order
    # functions stay out of it: they would end code generation for the whole stage.
    names = [f"r{n}" for n in range(len(rules))]
    broken = [F.col(f"_r.{name}") for name in names]
    none = F.array().cast(f"array<{ERROR}>")
    field_errors = (
        F.when(~has("item"), F.array(failure("", "model_attributes_type").cast(ERROR)))
        .when(
            F.coalesce(*broken).isNotNull(),
            F.concat(*[F.when(rule.isNotNull(), F.array(rule)).otherwise(none) for rule in broken]),
        )
        .otherwise(none)
    )

    # Cross-field rules run only when every field is fine.
    cross = consistency_rule(
        value("event_type"), value("product_id"), value("price"), value("quantity")
    ).cast(ERROR)
    errors = F.when((F.size("_e") == 0) & cross.isNotNull(), F.array(cross)).otherwise(F.col("_e"))

    converted = {
        "page_url": F.col("_page_url"),
        "price": minor_units(value("price")),
        "quantity": value("quantity").try_cast("int"),
    }
    properties = F.struct(*[converted.get(name, value(name)).alias(name) for name in PROPERTY_NAMES])
    top = [value(name).alias(name) for name in TOP_FIELDS[:4]]
    return _Stages(
        fields=fields,
        inner=inner_fields,
        kinds={"_k": F.struct(*odd_kinds), "_has": present},
        values={"_v": values},
        rules={"_r": F.struct(*[rule.cast(ERROR).alias(name) for name, rule in zip(names, rules)])},
        lists={"_e": field_errors},
        errors=errors.alias("errors"),
        event=F.struct(*top, properties.alias("properties")).alias("event"),
    )


def check_events(items: DataFrame, settings: Settings, computed: tuple[str, ...] = ()) -> DataFrame:
    """Add `event` and `errors` to rows with `item` (variant) and `received_at`.

    `item_text`, the item as JSON text, is taken from `items` where given.
    `computed` names columns of `items` that were derived from the body too, so
    that filters on them do not derive them again.
    """
    stages = _stages(settings)
    kept = [name for name in items.columns if name not in ("item", "item_text")]
    if "item_text" not in items.columns:
        items = items.withColumn("item_text", F.to_json("item"))
    read = (
        items.withColumns(stages.fields)
        .withColumns(stages.inner)
        .withColumns(stages.kinds)
        .withColumns(stages.values)
        .drop("item", "item_text", "_f", "_p", "_t")
    )
    judged = (
        with_url(read, "_v.page_url", "_page_url")
        .withColumns(stages.rules)
        .withColumns(stages.lists)
    )
    return fenced(judged.select(*kept, stages.errors, stages.event), "errors", "event", *computed)


def is_valid() -> Column:
    return F.size("errors") == 0
