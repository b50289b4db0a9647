"""Text and page expressions, all as built-in columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"(?U)\s+"
#: File extensions that are indexed, and words that are no tags.
EXTENSIONS = ("jpg", "jpeg", "png", "webp", "bmp", "pdf")
STOPWORDS = (
    "a an the of on in at by to is are was were be been being and or but with for from as it its this that these those there their they them"
    " he she his her you your we our i over under near next two one some"
).split()
MIN_TEXT = 40
#: Every line end: carriage returns, form feeds, separators and the Unicode ones.
LINE_END = "\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"


def strip(c: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def is_blank(c: Column) -> Column:
    return F.coalesce(strip(c), F.lit("")) == ""


def tokens(c: Column) -> Column:
    """Lower-case words between white space."""
    return F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), SPACE), lambda x: x != "")


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def is_indexable(path: Column) -> Column:
    return extension(path).isin(*EXTENSIONS)


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def visual_input(caption: Column, tags: Column, labels: Column) -> Column:
    """Caption, tags and labels without empty parts, joined by a space; recognised text is never part of it."""
    parts = F.concat(F.array(F.coalesce(caption, F.lit(""))), F.coalesce(tags, F.array().cast("array<string>")), F.coalesce(labels, F.array().cast("array<string>")))
    return F.array_join(F.filter(parts, lambda p: p != ""), " ")


def derive_tags(caption: Column, limit: int = 8) -> Column:
    """First distinct words of three letters or more that are no stopwords."""
    words = F.regexp_extract_all(F.lower(caption), F.lit("([A-Za-z]{3,})"), 1)
    return F.slice(F.array_distinct(F.filter(words, lambda w: ~w.isin(*STOPWORDS))), 1, limit)


def parse_response(response: Column) -> Column:
    """struct(caption, tags) of a model's answer: the last ``caption:`` and ``tags:`` lines, or else its first line that isn't blank and tags derived from that."""
    lines = F.split(strip(response), LINE_END)
    last = lambda key: F.try_element_at(F.filter(lines, lambda x: F.lower(strip(x)).startswith(key)), F.lit(-1))
    after = lambda x: strip(F.regexp_replace(x, r"(?s)^[^:]*:", ""))
    first = F.try_element_at(F.filter(lines, lambda x: strip(x) != ""), F.lit(1))
    caption = F.coalesce(F.nullif(after(last("caption:")), F.lit("")), F.substring(F.coalesce(strip(first), F.lit("")), 1, 300))
    listed = F.filter(F.transform(F.split(after(last("tags:")), "[,;]"), strip), lambda x: x != "")
    return F.struct(caption.alias("caption"), F.when(F.size(listed) > 0, listed).otherwise(derive_tags(caption)).alias("tags"))


def flatten_blocks(blocks: Column) -> Column:
    """struct(full_text, has_text) of recognised text blocks."""
    text = F.array_join(blocks, "\n")
    return F.struct(text.alias("full_text"), (~is_blank(text)).alias("has_text"))


def flatten_ocr(blocks: Column) -> Column:
    """struct(full_text, text_blocks, has_text) of recognised text blocks."""
    text = F.array_join(blocks, "\n")
    return F.struct(text.alias("full_text"), blocks.alias("text_blocks"), (~is_blank(text)).alias("has_text"))


def page_type(text_len: Column, n_images: Column) -> Column:
    return (
        F.when(text_len >= MIN_TEXT, F.when(n_images >= 1, "mixed").otherwise("born_digital_text"))
        .when(n_images >= 2, "figure")
        .when(n_images == 1, "scanned")
        .otherwise("born_digital_text")
    )


def crop_box(box: Column, page_height: Column, scale: Column, width: Column, height: Column) -> Column:
    """Page points (left, bottom-up y0, right, y1) to clamped pixels; null if nothing is left."""
    px = lambda v: F.floor(v * scale).cast("int")
    x0, x1 = F.greatest(F.lit(0), px(box["x0"])), F.least(width, px(box["x1"]))
    y0, y1 = F.greatest(F.lit(0), px(page_height - box["y1"])), F.least(height, px(page_height - box["y0"]))
    return F.when((x1 > x0) & (y1 > y0), F.struct(x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1")))


def entity(vec_id: Column) -> Column:
    """struct(entity, doc, page) of a vector id ``doc#pI#rJ``."""
    parts = F.split(vec_id, "#")
    paged = F.size(parts) > 1
    return F.struct(
        F.when(paged, F.concat_ws("#", parts[0], F.try_element_at(parts, F.lit(2)))).otherwise(vec_id).alias("entity"),
        parts[0].alias("doc"),
        F.when(paged & F.try_element_at(parts, F.lit(2)).rlike("^.[0-9]+$"), F.substring(F.try_element_at(parts, F.lit(2)), 2, 20).try_cast("int")).alias("page"),
    )
