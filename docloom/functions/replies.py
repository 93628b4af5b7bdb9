"""What JSON replies of services say, read tolerantly."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parsed(body: Column) -> Column:
    """Null for what is no JSON."""
    return F.try_parse_json(body)


def _number(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "int")


def business_code(body: Column) -> Column:
    """The first positive of error.code, code and msgCode."""
    v = parsed(body)
    positive = lambda c: F.when(c > 0, c)
    return F.coalesce(positive(_number(v, "$.error.code")), positive(_number(v, "$.code")), positive(_number(v, "$.msgCode")))


def error_code(body: Column) -> Column:
    """error.code, or -1."""
    return F.coalesce(_number(parsed(body), "$.error.code"), F.lit(-1))


def error_text(body: Column) -> Column:
    """error.message, else message, else the start of the reply."""
    v = parsed(body)
    said = lambda path: F.nullif(F.try_variant_get(v, path, "string"), F.lit(""))
    return F.coalesce(said("$.error.message"), said("$.message"), F.left(F.coalesce(body, F.lit("")), F.lit(200)))


def short_error(text: Column) -> Column:
    return F.coalesce(F.left(text, F.lit(200)), F.lit("unknown"))


def content(body: Column) -> Column:
    """The first choice's content; parts of a list are joined; null without choices."""
    v = parsed(body)
    has = F.size(F.try_variant_get(v, "$.choices", "array<variant>")) > 0
    parts = F.try_variant_get(v, "$.choices[0].message.content", "array<variant>")
    of = lambda x: F.coalesce(F.try_variant_get(x, "$.text", "string"), F.try_variant_get(x, "$.content", "string"), F.when(F.try_variant_get(x, "$", "map<string,variant>").isNull(), F.try_variant_get(x, "$", "string")), F.lit(""))
    plain = F.try_variant_get(v, "$.choices[0].message.content", "string")
    return F.when(has, F.when(parts.isNotNull(), F.array_join(F.transform(parts, of), "")).otherwise(F.coalesce(plain, F.lit(""))))


def payload(text: Column, target_lang: str, model: str, prompt: str, temperature: float = 0.7, top_p: float = 0.9) -> Column:
    """A chat request as JSON."""
    message = lambda role, said: F.struct(F.lit(role).alias("role"), said.alias("content"))
    return F.to_json(F.struct(F.lit(model).alias("model"), F.array(message("system", F.lit(prompt.format(target_lang=target_lang))), message("user", text)).alias("messages"), F.lit(temperature).alias("temperature"), F.lit(top_p).alias("top_p")))
