"""Requests as rows: JSON bodies are validated, run and answered by column expressions.

A body is a VARIANT, so a value's own type decides, and every violation of a request is collected in ``errors``: a
request with errors keeps its row and is answered with them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.registry import MAX_CONTEXT_CHUNKS, MAX_CONTEXT_DOCS, MAX_INPUTS, MAX_REQUEST_TOKENS, MAX_RERANK_DOCS, ModelRegistry

ERROR = "struct<loc:array<string>,msg:string,type:string>"


def _error(when: Column, loc: list, msg: str | Column, kind: str) -> Column:
    """An error where the condition holds (null counts as not), else null."""
    at = F.array(*(x if isinstance(x, Column) else F.lit(str(x)) for x in loc))
    made = F.struct(at.alias("loc"), (msg if isinstance(msg, Column) else F.lit(msg)).alias("msg"), F.lit(kind).alias("type"))
    return F.when(F.coalesce(when, F.lit(False)), made)


def _list(*errors: Column) -> Column:
    return F.array(*errors).cast(f"array<{ERROR}>")


def _nothing() -> Column:
    return F.array().cast(f"array<{ERROR}>")


class Value:
    """One value of a body, with its type."""

    def __init__(self, variant: Column, kind: Column | None = None) -> None:
        self.v = variant
        self.kind = F.schema_of_variant(variant) if kind is None else kind

    @property
    def missing(self) -> Column:
        return self.v.isNull()

    @property
    def is_string(self) -> Column:
        return self.kind == "STRING"

    @property
    def is_array(self) -> Column:
        return self.kind.startswith("ARRAY")

    @property
    def is_bool(self) -> Column:
        return self.kind == "BOOLEAN"

    @property
    def is_integer(self) -> Column:
        """5.0 is an integer, 5.5 is not; so are only numbers of 32 bits."""
        number = self.kind.rlike("^(BIGINT|DOUBLE|DECIMAL)")
        return number & (self.number == F.floor(self.number)) & self.number.between(-2147483648, 2147483647)

    @property
    def text(self) -> Column:
        return F.when(self.is_string, F.try_variant_get(self.v, "$", "string"))

    @property
    def number(self) -> Column:
        return F.try_variant_get(self.v, "$", "double")

    @property
    def items(self) -> Column:
        return F.when(self.is_array, F.try_variant_get(self.v, "$", "array<variant>"))

    @property
    def size(self) -> Column:
        return F.coalesce(F.size(self.items), F.lit(0))


def _field(name: str) -> Value:
    """A value of the body that ``_parsed`` has taken out."""
    return Value(F.col(f"_body_{name}"), F.col(f"_body_{name}_kind"))


def of_model(registry: ModelRegistry, label: Column, attribute: str, default: object) -> Column:
    """An attribute of the model that a column names."""
    out = F.lit(default)
    for m in registry.models.values():
        value = getattr(m, attribute)
        out = F.when(label == m.label, F.lit(value)).otherwise(out) if value is not None else out
    return out


def _model_errors(registry: ModelRegistry, kind: str) -> tuple[Column, Column]:
    m = _field("model")
    known = m.text.isin(list(registry.models)) if registry.models else F.lit(False)
    right = F.coalesce(known & (of_model(registry, m.text, "kind", "") == kind), F.lit(False))
    return right, _list(
        _error(m.missing, ["body", "model"], "field required", "missing"),
        _error(~m.missing & ~m.is_string, ["body", "model"], "model must be a string", "type_error.string"),
        _error(m.is_string & ~known, ["body", "model"], "value is not a valid enum member for this endpoint", "enum"),
        _error(m.is_string & known & ~right, ["body", "model"], "model is not available on this endpoint", "enum"),
    )


def _shape_errors(registry: ModelRegistry, right: Column) -> tuple[Column, Column, Column]:
    """Encoding, dimensions, and their errors. Without a model: the openai mode, and 128 to 2,560 dimensions."""
    label = _field("model").text
    native = right & (of_model(registry, label, "api", "openai") == "perplexity")
    e, d = _field("encoding_format"), _field("dimensions")
    default = F.when(native, "base64_int8").otherwise("float")
    allowed = F.when(native, e.text.isin("base64_int8", "base64_binary", "float")).otherwise(e.text.isin("float", "base64"))
    encoding = F.when(F.coalesce(allowed, F.lit(False)), e.text).otherwise(default)
    low = F.when(right, of_model(registry, label, "min_dim", 128)).otherwise(128)
    high = F.when(right, of_model(registry, label, "dim", 2560)).otherwise(2560)
    dims = F.when(F.coalesce(d.is_integer, F.lit(False)), d.number.cast("int")).otherwise(high)
    permitted = F.when(native, "value is not a valid enum member; permitted: 'base64_int8', 'base64_binary', 'float'").otherwise("value is not a valid enum member; permitted: 'float', 'base64'")
    return encoding, dims, _list(
        _error(~e.missing & ~e.is_string, ["body", "encoding_format"], "encoding_format must be a string", "type_error.string"),
        _error(e.is_string & ~allowed, ["body", "encoding_format"], permitted, "enum"),
        _error(~d.missing & ~d.is_integer, ["body", "dimensions"], "dimensions must be an integer", "type_error.integer"),
        _error(d.is_integer & ~dims.between(low, high), ["body", "dimensions"], F.format_string("dimensions must be between %d and %d", low, high), "value_error.range"),
        _error((encoding == "base64_binary") & (dims % 8 != 0), ["body", "dimensions"], "dimensions must be divisible by 8 for base64_binary", "value_error.divisible"),
    )


def _strings(items: Column, loc: list, noun: str, what: str) -> Column:
    """Errors of items that are no strings, or empty ones."""
    def one(x: Column, i: Column) -> Column:
        s = Value(x)
        at = [*loc, i.cast("string")]
        wrong = x.isNull() | ~s.is_string
        return F.coalesce(_error(wrong, at, f"{what} must be a string", "type_error.string"), _error(s.text == "", at, f"{noun} must not be empty", "value_error.empty"))

    return F.coalesce(F.transform(items, one), _nothing())


def _collected(*lists: Column) -> Column:
    return F.filter(F.concat(*lists), lambda e: e.isNotNull())


def _parsed(requests: DataFrame, body: str, *fields: str) -> DataFrame:
    """The requests with their fields and their types in columns below the checks: each check would take the whole value out again."""
    parsed = requests.withColumn("_body", F.try_parse_json(body))
    taken = parsed.withColumns({"_body_kind": F.schema_of_variant("_body")} | {f"_body_{f}": F.try_variant_get(F.col("_body"), f"$.{f}", "variant") for f in fields})
    return taken.withColumns({f"_body_{f}_kind": F.schema_of_variant(f"_body_{f}") for f in fields})


def _checked(requests: DataFrame, parsed: DataFrame, columns: dict[str, Column]) -> DataFrame:
    return parsed.withColumns(columns).select(*(c for c in requests.columns if c not in columns and c != "_body"), *columns)


def _with_body(checks: Column) -> Column:
    """A body that is no JSON object has that one error."""
    is_object = F.coalesce(F.col("_body_kind").startswith("OBJECT"), F.lit(False))
    return F.when(is_object, checks).otherwise(_list(_error(F.lit(True), ["body"], "request body must be a JSON object", "value_error.json")))


def validate_embeddings(requests: DataFrame, registry: ModelRegistry, body: str = "body") -> DataFrame:
    """Adds model, inputs, encoding, dims, text_type, errors."""
    right, model = _model_errors(registry, "standard")
    encoding, dims, shape = _shape_errors(registry, right)
    has_query = right & (of_model(registry, _field("model").text, "query", "") != "")
    t, i = _field("text_type"), _field("input")
    text_type = _list(
        _error(right & ~t.missing & ~has_query, ["body", "text_type"], "text_type is only supported for instruction embedding models", "extra_fields"),
        _error(has_query & ~t.missing & ~t.is_string, ["body", "text_type"], "text_type must be a string", "type_error.string"),
        _error(has_query & t.is_string & ~t.text.isin("query", "document"), ["body", "text_type"], "value is not a valid enum member; permitted: 'query', 'document'", "enum"),
    )
    inputs = _list(
        _error(i.missing, ["body", "input"], "field required", "missing"),
        _error(i.text == "", ["body", "input"], "input must not be empty", "value_error.empty"),
        _error(i.is_array & (i.size < 1), ["body", "input"], "input must contain at least 1 item", "value_error.list.min_items"),
        _error(i.is_array & (i.size > MAX_INPUTS), ["body", "input"], f"input must contain at most {MAX_INPUTS} items", "value_error.list.max_items"),
        _error(~i.missing & ~i.is_string & ~i.is_array, ["body", "input"], "input must be a string or an array of strings", "type_error"),
    )
    texts = F.when(i.is_string, F.array(i.text)).otherwise(F.transform(i.items, lambda x: Value(x).text))
    errors = _with_body(_collected(model, shape, text_type, inputs, _strings(i.items, ["body", "input"], "input item", "input item")))
    parsed = _parsed(requests, body, "model", "encoding_format", "dimensions", "text_type", "input")
    return _checked(requests, parsed, {"model": _field("model").text, "inputs": texts, "encoding": encoding, "dims": dims, "text_type": t.text, "errors": errors})


def validate_contextual(requests: DataFrame, registry: ModelRegistry, body: str = "body") -> DataFrame:
    """Adds model, documents (arrays of chunks), encoding, dims, errors."""
    right, model = _model_errors(registry, "contextual")
    encoding, dims, shape = _shape_errors(registry, right)
    i = _field("input")

    def document(x: Column, n: Column) -> Column:
        d, at = Value(x), ["body", "input", n.cast("string")]
        whole = _list(_error(x.isNull() | ~d.is_array, at, "document must be an array of strings", "type_error.array"), _error(d.is_array & (d.size < 1), at, "document must contain at least 1 chunk", "value_error.list.min_items"))
        return F.concat(whole, _strings(d.items, at, "chunk", "chunk"))

    chunks = F.aggregate(F.coalesce(i.items, F.array().cast("array<variant>")), F.lit(0), lambda a, x: a + Value(x).size)
    inputs = _list(
        _error(i.missing, ["body", "input"], "field required", "missing"),
        _error(~i.missing & ~i.is_array, ["body", "input"], "input must be an array of document chunk arrays", "type_error.array"),
        _error(i.is_array & (i.size < 1), ["body", "input"], "input must contain at least 1 document", "value_error.list.min_items"),
        _error(i.is_array & (i.size > MAX_CONTEXT_DOCS), ["body", "input"], f"input must contain at most {MAX_CONTEXT_DOCS} documents", "value_error.list.max_items"),
    )
    many = _list(_error(i.is_array & (chunks > MAX_CONTEXT_CHUNKS), ["body", "input"], f"input must contain at most {MAX_CONTEXT_CHUNKS} chunks", "value_error.list.max_items"))
    documents = F.transform(i.items, lambda x: F.transform(Value(x).items, lambda c: Value(c).text))
    errors = _with_body(_collected(model, shape, inputs, F.coalesce(F.flatten(F.transform(i.items, document)), _nothing()), many))
    parsed = _parsed(requests, body, "model", "encoding_format", "dimensions", "input")
    return _checked(requests, parsed, {"model": _field("model").text, "documents": documents, "encoding": encoding, "dims": dims, "errors": errors})


def validate_rerank(requests: DataFrame, registry: ModelRegistry, body: str = "body") -> DataFrame:
    """Adds model, query, documents, top_n, return_documents, errors."""
    _, model = _model_errors(registry, "late")
    q, d, n, k, r = map(_field, ("query", "documents", "top_n", "top_k", "return_documents"))
    checks = _list(
        _error(q.missing, ["body", "query"], "field required", "missing"),
        _error(~q.missing & ~q.is_string, ["body", "query"], "query must be a string", "type_error.string"),
        _error(q.text == "", ["body", "query"], "query must not be empty", "value_error.empty"),
        _error(d.missing, ["body", "documents"], "field required", "missing"),
        _error(~d.missing & ~d.is_array, ["body", "documents"], "documents must be an array of strings", "type_error.array"),
        _error(d.is_array & (d.size < 1), ["body", "documents"], "documents must contain at least 1 item", "value_error.list.min_items"),
        _error(d.is_array & (d.size > MAX_RERANK_DOCS), ["body", "documents"], f"documents must contain at most {MAX_RERANK_DOCS} items", "value_error.list.max_items"),
    )
    top = Value(F.coalesce(n.v, k.v))
    name = F.when(n.missing, "top_k").otherwise("top_n")
    tops = _list(
        _error(~n.missing & ~k.missing, ["body", "top_n"], "top_n and top_k are aliases; provide only one", "value_error.conflict"),
        _error(~top.missing & ~top.is_integer, ["body", name], "top_n must be an integer", "type_error.integer"),
        _error(top.is_integer & ~top.number.between(1, d.size), ["body", name], "top_n must be between 1 and the number of documents", "value_error.range"),
        _error(~r.missing & ~r.is_bool, ["body", "return_documents"], "return_documents must be a boolean", "type_error.bool"),
    )
    errors = _with_body(_collected(model, checks, _strings(d.items, ["body", "documents"], "document", "document"), tops))
    wanted = F.when(F.coalesce(top.is_integer, F.lit(False)), top.number.cast("int")).otherwise(d.size)
    return _checked(requests, _parsed(requests, body, "model", "query", "documents", "top_n", "top_k", "return_documents"), {
        "model": _field("model").text, "query": q.text, "documents": F.transform(d.items, lambda x: Value(x).text), "top_n": wanted,
        "return_documents": F.coalesce(F.when(r.is_bool, F.try_variant_get(r.v, "$", "boolean")), F.lit(False)), "errors": errors,
    })


def over_request_limit(n_tokens: Column, field: str, limit: int = MAX_REQUEST_TOKENS) -> Column:
    return _error(n_tokens > limit, ["body", field], "request exceeds the request token limit", "value_error.context_length")


def error_response(errors: Column) -> Column:
    """The body of a 422 answer; numbers in a location are numbers again."""
    text = F.to_json(F.struct(errors.alias("detail")))
    return F.regexp_replace(text, r'(?<=[\[,])"(\d+)"(?=[,\]])', "$1")
