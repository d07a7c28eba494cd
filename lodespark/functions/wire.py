"""JSON, server-sent events, media types and data URLs as Spark columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Media types of the image files that are accepted.
MEDIA_TYPES = {".png": "image/png", ".jpg": "image/jpeg", ".jpeg": "image/jpeg", ".webp": "image/webp"}


def suffix(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, "(\\.[^./\\\\]+)$", 1))


def media_type(name: Column, strict: bool = True) -> Column:
    """The media type of an image file; an unknown suffix is an error, or null where not strict."""
    table = F.create_map(*[F.lit(x) for pair in MEDIA_TYPES.items() for x in pair])
    found = F.try_element_at(table, suffix(name))
    return F.coalesce(found, F.raise_error(F.concat(F.lit("unsupported image file: "), name)).cast("string")) if strict else found


def data_url(content: Column, media: Column) -> Column:
    """base64() puts a line break every 76 characters, depending on the session; they are taken out."""
    return F.concat(F.lit("data:"), media, F.lit(";base64,"), F.regexp_replace(F.base64(content), "[\\r\\n]", ""))


def is_text_upload(name: Column) -> Column:
    return F.lower(name).rlike("\\.(md|txt)$")


def upload_status(name: Column, content: Column) -> Column:
    """200, 415 for a file that isn't .md or .txt, 422 for one that isn't UTF-8."""
    return F.when(~is_text_upload(name), 415).when(~F.is_valid_utf8(content.cast("string")), 422).otherwise(200)


def json_objects(x: Column) -> Column:
    """array<string>: the objects of the JSON array between the first [ and the last ], as JSON; anything broken gives none."""
    start = F.instr(x, "[")
    end = F.length(x) - F.instr(F.reverse(x), "]") + 1
    cut = F.when((start > 0) & (F.instr(x, "]") > 0) & (end > start), F.substring(x, start, end - start + 1))
    items = F.try_variant_get(F.try_parse_json(cut), "$", "array<variant>")
    objects = F.filter(items, lambda v: F.schema_of_variant(v).startswith("OBJECT"))
    return F.coalesce(F.transform(objects, lambda v: F.to_json(v)), F.array().cast("array<string>"))


def sse(event: Column, data: Column) -> Column:
    return F.concat(F.lit("event: "), event, F.lit("\ndata: "), data, F.lit("\n\n"))


def sse_deltas(body: Column) -> Column:
    """array<string>: the text deltas of a chat stream. Only data lines count, up to [DONE]; those without choices or text are skipped."""
    data = F.transform(F.filter(F.split(body, "\\r\\n|\\n"), lambda x: x.startswith("data:")), lambda x: F.trim(F.substring(x, 6, F.length(x))))
    stop = F.array_position(data, "[DONE]").cast("int")
    data = F.when(stop > 0, F.slice(data, F.lit(1), F.greatest(stop - 1, F.lit(0)))).otherwise(data)
    deltas = F.transform(data, lambda x: F.get_json_object(x, "$.choices[0].delta.content"))
    return F.filter(deltas, lambda d: d.isNotNull() & (d != ""))
