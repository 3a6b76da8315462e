"""Column functions on replies of language models and on tool calls."""

from pyspark.sql import Column, functions as F

from stacklore import constants as K
from stacklore.functions.text import col


def whole_json(text) -> Column:
    """The text when all of it is one JSON value, else null.

    The parser stops after the first value, so the text must also be the one element of
    a list and the one value of an object: what follows a value breaks one of the two.
    """
    def whole(t):
        listed = F.try_parse_json(F.concat(F.lit("["), t, F.lit("]")))
        named = F.try_parse_json(F.concat(F.lit('{"v":'), t, F.lit("}")))
        return (F.try_variant_get(listed, "$[0]", "variant").isNotNull()
                & F.try_variant_get(listed, "$[1]", "variant").isNull() & named.isNotNull())

    # A filter over a list of one evaluates the text once, however long its expression is.
    return F.get(F.filter(F.array(col(text)), whole), 0)


def response_json(reply) -> Column:
    """The JSON object of a reply, else null.

    It is the outermost ``{...}``; failing that the reply, or its first fenced block, as
    an object or a list that starts with one.
    """
    reply = col(reply)
    braces = whole_json(F.nullif(F.regexp_extract(reply, r"(?s)\{.*\}", 0), F.lit("")))
    fenced = F.regexp_extract(reply, r"(?s)```(?:json)?\s*(.+?)\s*```", 1)
    return F.coalesce(braces, *[_first_object(whole_json(F.trim(x))) for x in (reply, fenced)])


def _first_object(text) -> Column:
    first = F.transform(F.array(text), lambda t: F.when(
        F.ltrim(t).startswith("["), F.get_json_object(t, "$[0]")).otherwise(t))
    return F.get(F.filter(first, lambda t: F.ltrim(t).startswith("{")), 0)


def _is_number(kind) -> Column:
    return kind.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT|BOOLEAN)")


def _as_int(variant) -> Column:
    flag = F.try_variant_get(variant, "$", "boolean").cast("int")
    number = F.try_variant_get(variant, "$", "double").cast("int")
    return F.when(F.schema_of_variant(variant) == "BOOLEAN", flag).otherwise(number)


def score_coerce(json_text) -> Column:
    """The ``score`` of a reply as an integer.

    Numbers are cut to integers, numeric strings are read, and an object gives
    its first numeric value in the order written. Everything else is 0.
    """
    parsed = F.try_parse_json(col(json_text))
    score = F.try_variant_get(parsed, "$.score", "variant")
    kind = F.schema_of_variant(score)
    from_text = F.try_variant_get(score, "$", "string").try_cast("double").cast("int")
    # A map keeps the written order of the keys, which a variant object does not.
    fields = F.from_json(F.get_json_object(col(json_text), "$.score"), "map<string,variant>")
    numeric = F.filter(F.map_values(fields), lambda v: _is_number(F.schema_of_variant(v)))
    return F.coalesce(
        F.when(_is_number(kind), _as_int(score))
        .when(kind == "STRING", from_text)
        .when(kind.startswith("OBJECT"), _as_int(F.get(numeric, 0))),
        F.lit(0),
    )


def reliability_tier(score) -> Column:
    score = col(score)
    return F.when(score >= 80, "high").when(score >= 50, "medium").otherwise("low")


def blend_score(static_score, reply_json) -> Column:
    """Mean of the static and the model score, cut to an integer.

    A reply without a score counts as 50; without JSON, or with a score that is
    no number, the static score stands.
    """
    score = F.try_variant_get(F.try_parse_json(col(reply_json)), "$.score", "variant")
    kind = F.schema_of_variant(score)
    model = F.when(score.isNull(), F.lit(50.0)).when(
        _is_number(kind), F.try_variant_get(score, "$", "double"))
    blended = ((col(static_score) + model) / 2).cast("int")
    return F.when(col(reply_json).isNotNull() & model.isNotNull(), blended).otherwise(
        col(static_score).cast("int"))


def draft_from_reply(reply_json, query, language) -> Column:
    """Draft fields from a reply; null when the reply holds no code."""
    parsed = F.try_parse_json(col(reply_json))

    def field(name):
        return F.try_variant_get(parsed, f"$.{name}", "string")

    has_code = F.try_variant_get(parsed, "$.code", "variant").isNotNull()
    described = F.coalesce(
        field("description"), F.concat(F.lit("Draft implementation for "), col(query)))
    return F.when(has_code, F.struct(
        field("name").alias("name"),
        field("code").alias("code"),
        F.concat(F.lit(K.DRAFT_MARK + " "), described).alias("description"),
        F.coalesce(field("language"), col(language)).alias("language"),
        F.lit(True).alias("is_draft"),
    ))


def tool_calls(calls_json) -> Column:
    """array<struct<name, args>> with lower-case names and normal argument keys."""
    calls = F.from_json(col(calls_json), "array<struct<name:string,args:map<string,string>>>")
    named = F.filter(calls, lambda c: F.coalesce(c["name"], F.lit("")) != "")
    return F.transform(named, lambda c: F.struct(
        F.lower(c["name"]).alias("name"),
        normal_arguments(F.coalesce(c["args"], F.from_json(F.lit("{}"), "map<string,string>")))
        .alias("args"),
    ))


def normal_arguments(args) -> Column:
    """Rename known wrong keys; the first present wins and none is overwritten."""
    args = col(args)
    targets = {}
    for alias, target in K.ARGUMENT_ALIASES:
        targets.setdefault(target, []).append(alias)
    for target, aliases in targets.items():
        has_target = F.map_contains_key(args, target)
        used = F.coalesce(*[
            F.when(F.map_contains_key(args, a), F.lit(a)) for a in aliases])
        renamed = F.map_concat(
            F.map_filter(args, lambda k, v: k != used),
            F.create_map(F.lit(target), args[used]))
        args = F.when(has_target | used.isNull(), args).otherwise(renamed)
    return args


def ranking_ids(reply) -> Column:
    """Ids of the first ``[2, 0, 1]`` list in a reply; null when there is none."""
    listed = F.regexp_extract(col(reply), r"\[[\d,\s]+\]", 0)
    return F.from_json(F.nullif(listed, F.lit("")), "array<int>")


def all_integers(reply) -> Column:
    found = F.regexp_extract_all(col(reply), F.lit(r"(\d+)"), F.lit(1))
    return F.transform(found, lambda x: x.try_cast("int"))
