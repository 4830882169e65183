"""Text: HTML stripping, block markers, labels, splitting. Whitespace is Unicode whitespace throughout."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed order: the entities decoded.
ENTITIES = [("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&"), ("&quot;", '"')]
#: Layout labels and their categories.
LABELS = {
    "text": "Text", "title": "Title", "table": "Table", "figure": "Picture", "image": "Picture", "header": "Header", "footer": "Footer",
    "seal": "Seal", "stamp": "Seal", "formula": "Formula", "list": "List",
}
#: Fixed pattern: a marked block, closed by its own number or by the end of the text.
MARKED = r"(?sUd)\[#([0-9]{3})\]\s*(.*?)(?:\s*\[/#\1\]|\s*$)"
#: Fixed pattern: sentence boundaries.
SENTENCE = r"(?<=[.!?])\s+(?=[A-ZЀ-ӿĀ-ſ])|(?<=[.!?])\s*$|(?<=\n)\s*"
_DIV = '<div style="text-align: center;">'


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?Ud)^\s+|\s+\z", "")


def collapse(c: Column) -> Column:
    """Runs of whitespace become one blank, none at the ends."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def strip_html(html: Column) -> Column:
    """Plain text: tags are blanks, heading marks and the five entities go, whitespace collapses. Null is empty."""
    t = F.regexp_replace(F.coalesce(html, F.lit("")), "<[^>]+>", " ")
    t = F.regexp_replace(t, r"(?mdU)^#+\s*", "")
    for entity, char in ENTITIES:
        t = F.replace(t, F.lit(entity), F.lit(char))
    return collapse(t)


def extract_blocks(marked: Column) -> Column:
    """map<int,string> of marker number to plain text; blank blocks are left out, of equal numbers the last counts."""
    numbers, bodies = F.regexp_extract_all(marked, F.lit(MARKED), F.lit(1)), F.regexp_extract_all(marked, F.lit(MARKED), F.lit(2))
    pairs = F.zip_with(numbers, bodies, lambda n, x: F.struct(n.cast("int").alias("n"), strip_html(strip(x)).alias("t")))
    none = F.create_map().cast("map<int,string>")

    def step(acc: Column, x: Column) -> Column:
        others = F.map_filter(acc, lambda k, _: k != x["n"])
        return F.when(x["t"] == "", acc).otherwise(F.map_concat(others, F.create_map(x["n"], x["t"])))

    return F.aggregate(pairs, none, step)


def strip_markers(marked: Column) -> Column:
    t = F.regexp_replace(F.coalesce(marked, F.lit("")), r"(?U)\[#[0-9]{3}\]\s*", "")
    t = F.regexp_replace(t, r"(?U)\s*\[/#[0-9]{3}\]", "")
    return strip(F.regexp_replace(t, r"\n{3,}", "\n\n"))


def image_name(bbox: Column) -> Column:
    named = F.concat(F.lit("imgs/img_in_image_box_"), F.array_join(F.slice(bbox, 1, 4).cast("array<string>"), "_"), F.lit(".jpg"))
    return F.when(F.size(bbox) >= 4, named).otherwise("imgs/unknown_image.jpg")


def image_percent(bbox: Column, page_width: Column) -> Column:
    pct = ((F.get(bbox, F.lit(2)) - F.get(bbox, F.lit(0))) / page_width * 100).cast("int")
    return F.when((F.size(bbox) >= 4) & (page_width > 0), F.greatest(F.lit(10), F.least(F.lit(100), pct))).otherwise(50)


def wrap_block(block_id: Column, label: Column, content: Column, bbox: Column, page_width: Column) -> Column:
    """A block between its markers, laid out by label."""
    number = F.lpad(block_id.cast("string"), F.greatest(F.lit(3), F.length(block_id.cast("string"))), F.lit("0"))
    label, content = F.lower(F.coalesce(F.nullif(label, F.lit("")), F.lit("text"))), strip(F.coalesce(content, F.lit("")))
    img = F.concat(F.lit(f'{_DIV}<img src="'), image_name(bbox), F.lit('" alt="Image" width="'), image_percent(bbox, page_width).cast("string"), F.lit('%" />'))
    image = F.concat(img, F.when(content != "", F.concat(F.lit("<p>"), content, F.lit("</p>"))).otherwise(""), F.lit("</div>"))
    as_table = F.when(F.lower(content).contains("<table"), F.concat(F.lit(_DIV), content, F.lit("</div>")))
    as_table = as_table.when(content != "", content).otherwise("<!-- TABLE: no content extracted -->")
    title = F.when(content != "", F.concat(F.lit("## "), content))
    body = F.when(label == "image", image).when(label == "table", as_table).when(label.isin("title", "paragraph_title"), title).otherwise(F.nullif(content, F.lit("")))
    return F.concat_ws("\n", F.concat(F.lit("[#"), number, F.lit("]")), body, F.concat(F.lit("[/#"), number, F.lit("]")))


def category_of(label: Column) -> Column:
    """The category of a layout label; others get a capital, none is Unknown."""
    key = F.lower(strip(label))
    known = F.create_map(*(F.lit(x) for kv in LABELS.items() for x in kv))
    other = F.concat(F.upper(F.left(key, F.lit(1))), F.substr(key, F.lit(2)))
    return F.when(F.coalesce(label, F.lit("")) == "", "Unknown").otherwise(F.coalesce(F.try_element_at(known, key), other))


def sentences(t: Column) -> Column:
    return F.filter(F.transform(F.split(t, SENTENCE, -1), strip), lambda x: x != "")
