"""Parsing of JSON answers from a text-enrichment service."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelgrid import fixed_values as V
from parcelgrid.functions.common import col, null_if_empty, once


def strip_fences(text) -> Column:
    """Drops a leading ``` line and, when present, a closing ``` line."""
    text = col(text)
    inside = F.regexp_extract(text, r"(?s)^\s*```[^\n]*\n(.*?)(?:\n?[ \t]*```)?\s*$", 1)
    return F.coalesce(null_if_empty(inside), text)


def response_fields(with_images: bool = False) -> dict[str, str]:
    return {**V.RESPONSE_TEXT_FIELDS, **(V.RESPONSE_IMAGE_FIELDS if with_images else {})}


def parse_llm_response(text, with_images: bool = False) -> Column:
    """Struct of the known keys, scores held to 1..5; NULL for anything unusable.

    A value of an unexpected type becomes NULL; the record itself is kept.  The text
    is stripped and parsed once.
    """
    fields = response_fields(with_images)
    schema = ", ".join(f"{name} {dtype}" for name, dtype in fields.items())

    def tidy(rec):
        return F.struct(*[
            (F.when(rec[n].isNotNull(), F.greatest(F.lit(1), F.least(F.lit(5), rec[n]))).cast(t)
             if n in V.CLAMPED_SCORES else rec[n]).alias(n) for n, t in fields.items()])

    def parse(body):
        known = F.arrays_overlap(F.json_object_keys(body), F.array(*[F.lit(n) for n in fields]))
        return F.when(F.coalesce(known, F.lit(False)), once(F.from_json(body, schema), tidy))

    return once(strip_fences(text), parse)


def with_text_features(df: DataFrame, text_col: str, out: str = "text",
                       with_images: bool = False) -> DataFrame:
    return df.withColumn(out, parse_llm_response(text_col, with_images))
