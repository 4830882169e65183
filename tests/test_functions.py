"""Functions against plain Python versions of the written rules."""

import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quire.functions import chunk, fulltext, geometry, imaging, languages, paths
from quire.functions import text as X
from quire.operators.filters import check_mode, check_search
from quire.operators.scalars import parse_mode, stable_json


def one(spark, column, **values):
    """Value of a column over one row of literals."""
    row = spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items())) if values else spark.range(1)
    return row.select(column.alias("r")).first().r


# chunks


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab .!?\nÉ", max_size=300), st.integers(1, 40))
def test_chunks_fit_and_lose_nothing(t, n):
    got = chunk.chunks_of(t, n)
    assert all(0 < len(c) <= n for c in got)
    assert "".join("".join(got).split()) == "".join(t.split())


def test_chunks_by_level():
    assert chunk.chunks_of(" short ", 50) == ["short"]
    assert chunk.chunks_of("aa\n\nbb\n\ncc", 6) == ["aa\n\nbb", "cc"]
    assert chunk.chunks_of("One two. Three four. Five.", 11) == ["One two.", "Three four.", "Five."]
    assert chunk.chunks_of("One two. Three four. Five.", 10) == ["One two.", "Three", "four.", "Five."]
    assert chunk.chunks_of("abcdefghij", 4) == ["abcd", "efgh", "ij"]
    assert chunk.chunks_of(None, 5) == chunk.chunks_of("  \n", 5) == []
    with pytest.raises(ValueError):
        chunk.chunks_of("x", 0)


def test_chunks_are_not_cut_by_whole_batches(spark):
    cut = spark.range(3).select(chunk.chunks(F.repeat(F.lit("ab cd\n\n"), F.col("id").cast("int")), F.lit(8)).alias("c"))
    assert [r.c for r in cut.collect()] == [[], ["ab cd"], ["ab cd", "ab cd"]]
    assert "ArrowEvalPython" not in cut._jdf.queryExecution().executedPlan().toString()


def test_sentences_split_like_python(spark):
    texts = ["A b. C d! e? F\nG  h.", "Fin. École. Il.", "x. Привет. Ō. 1. Z", "", " . A", "end.  "]
    d = spark.createDataFrame([(t,) for t in texts], "t string").select("t", X.sentences(F.col("t")).alias("s"))
    for r in d.collect():
        assert r.s == [p.strip() for p in re.split(X.SENTENCE, r.t) if p and p.strip()]


# markers and HTML


def test_markers_round_trip(spark):
    blocks = [(1, "text", "Hello  world"), (2, "title", "Head"), (3, "image", "inside"), (4, "table", "<TABLE><td>x</td></TABLE>"), (5, "table", ""), (6, "text", " ")]
    d = spark.createDataFrame(blocks, "id int, label string, content string")
    bbox = F.array(*map(F.lit, (0, 5, 1000, 20)))
    m = {r.id: r.m for r in d.select("id", X.wrap_block(F.col("id"), F.col("label"), F.col("content"), bbox, F.lit(2000)).alias("m")).collect()}
    assert m[1] == "[#001]\nHello  world\n[/#001]" and m[2] == "[#002]\n## Head\n[/#002]"
    assert m[3] == '[#003]\n<div style="text-align: center;"><img src="imgs/img_in_image_box_0_5_1000_20.jpg" alt="Image" width="50%" /><p>inside</p></div>\n[/#003]'
    assert m[4].startswith('[#004]\n<div style="text-align: center;"><TABLE>') and m[5] == "[#005]\n<!-- TABLE: no content extracted -->\n[/#005]" and m[6] == "[#006]\n[/#006]"
    page = "\n\n".join(m[k] for k in sorted(m))
    assert one(spark, X.extract_blocks(F.lit(page))) == {1: "Hello world", 2: "Head", 3: "inside", 4: "x"}


@pytest.mark.parametrize(
    ("marked", "want"),
    [
        ("[#001]a[/#001]\n[#002]b", {1: "a", 2: "b"}), ("[#001]a\n[#002]b[/#002]", {1: "a [#002]b[/#002]"}), ("[#001]a[/#001][#001]b[/#001]", {1: "b"}), ("[#1000]a[/#1000]", {}),
        ("[#001] [/#001]", {}), ("[#001] x [/#001]", {1: "x"}), ("[#001]a[/#001][#001] [/#001]", {1: "a"}), ("", {}),
    ],
)
def test_extraction(spark, marked, want):
    assert one(spark, X.extract_blocks(F.lit(marked))) == want


def test_markers_are_stripped(spark):
    assert one(spark, X.strip_markers(F.lit("[#001]\na\n[/#001]\n\n\n\n[#002]b[/#002] "))) == "a\n\nb"
    assert one(spark, X.strip_markers(F.lit(None).cast("string"))) == ""


def test_html_is_stripped_like_python(spark):
    def plain(h):
        t = re.sub(r"(?m)^#+\s*", "", re.sub("<[^>]+>", " ", h))
        for e, c in X.ENTITIES:
            t = t.replace(e, c)
        return re.sub(r"\s+", " ", t).strip()

    for h in ["<p>a</p>\n## b\n&amp;lt; &nbsp;x&quot;", "", "#  x\n\n# y", "<a\nb>z", "1 < 2 > 3"]:
        assert one(spark, X.strip_html(F.lit(h))) == plain(h)


def test_labels(spark):
    for raw, want in {"": "Unknown", None: "Unknown", " Stamp ": "Seal", "doc_title": "Doc_title", "TABLE": "Table", "image": "Picture"}.items():
        assert one(spark, X.category_of(F.lit(raw).cast("string"))) == want


# geometry


def covered(boxes):
    return len({(x, y) for a, b, c, d in boxes for x in range(a, c) for y in range(b, d)})


def test_union_area_by_counting_cells(spark):
    rng = random.Random(1)
    rows = []
    for i in range(40):
        boxes = []
        for _ in range(rng.randint(0, 6)):
            x, y = rng.randint(0, 12), rng.randint(0, 12)
            boxes.append((x, y, x + rng.randint(0, 8), y + rng.randint(0, 8)))
        rows.append((i, [list(map(float, b)) for b in boxes], covered(boxes)))
    d = spark.createDataFrame(rows, "i int, boxes array<array<double>>, want int")
    assert d.filter(geometry.union_area(F.col("boxes")) != F.col("want")).count() == 0


def test_iou_and_boxes(spark):
    b = geometry.box
    assert one(spark, geometry.iou(b(0, 0, 1, 1), b(0, 0, 1, 1))) == 1.0
    assert one(spark, geometry.iou(b(0, 0, 1, 1), b(2, 2, 3, 3))) == 0.0
    assert one(spark, geometry.iou(b(0, 0, 1, 1), b(0, 0, 0.5, 0.5))) == 0.25
    assert one(spark, geometry.iou(b(0, 0, 0, 0), b(0, 0, 0, 0))) == 0.0
    for box in ([100, 200, 400, 600], [0, 0, 2481, 3508]):
        n = geometry.normalised(F.array(*map(F.lit, box)), F.lit(2481), F.lit(3508))
        assert one(spark, geometry.denormalised(n, F.lit(2481), F.lit(3508))) == box
    assert one(spark, geometry.crop_bounds(b(0, 0, 0.5, 0.5), F.lit(100), F.lit(100))) == [0, 0, 50, 50]
    assert one(spark, geometry.crop_bounds(b(0.8, 0.8, 1.5, 1.5), F.lit(100), F.lit(100))) == [80, 80, 100, 100]
    spans = F.array(*(F.array(F.lit(float(x)), F.lit(float(y))) for x, y in ((5, 6), (0, 2), (2, 3), (1, 1.5))))
    assert one(spark, geometry.merged_intervals(spans)) == [[0.0, 3.0], [5.0, 6.0]] and one(spark, geometry.merged_length(spans)) == 4.0


def test_resolutions(spark):
    assert [one(spark, imaging.clamp(F.lit(v))) for v in (1, 200, 9999)] == [150, 200, 600]
    assert one(spark, imaging.pdf_dpi(F.lit(595.0), F.lit(842.0))) == 300
    assert one(spark, imaging.pdf_dpi(F.lit(3000.0), F.lit(3000.0))) == 150
    assert one(spark, imaging.pdf_dpi(F.lit(1500.0), F.lit(1500.0))) == 240
    none = F.lit(None).cast("double")
    assert one(spark, imaging.raster_dpi(F.lit(200.0), F.lit(10), F.lit(10))) == 200
    assert one(spark, imaging.raster_dpi(none, F.lit(2481), F.lit(3508))) == 300
    assert one(spark, imaging.raster_dpi(F.lit(0.0), F.lit(1), F.lit(1))) == 300


# paths, languages, modes


def test_paths(spark):
    assert one(spark, paths.from_uri(F.lit("output:///documents/a b.pdf"))) == "documents/a b.pdf"
    assert one(spark, paths.from_uri(F.lit("output://documents/000000042/SOURCEFILE/doc.pdf"))) == "documents/000000042/SOURCEFILE/doc.pdf"
    assert one(spark, paths.from_uri(F.lit("output:///a%20b+c"))) == "a b+c"
    for bad in ("http://x/y", "output://", "", "output:///../../etc/passwd"):
        with pytest.raises(Exception, match="USER_RAISED|Not an|Malformed|escapes"):
            one(spark, paths.from_uri(F.lit(bad)))
    assert one(spark, paths.page_dir(F.lit(123456789), F.lit(3))) == "documents/123456789/0003"
    assert one(spark, paths.page_image(F.lit(1), F.lit(1000), "jpg")) == "documents/000000001/1000/p1000_source.jpg"
    with pytest.raises(Exception, match="page_number"):
        one(spark, paths.page_dir(F.lit(1), F.lit(0)))
    now = F.lit("2024-06-15 10:30:45").cast("timestamp")
    assert one(spark, paths.document_key(F.lit("report.pdf"), now)) == "20240615T103045_report.pdf"
    assert one(spark, paths.document_key(F.lit(""), now)) == "20240615T103045_document"
    assert [one(spark, paths.accepted(F.lit(n))) for n in ("a.PDF", "b.png", "c.tiff", "d.docx", "e")] == [True, True, True, False, False]
    assert [one(spark, paths.kind(F.lit(n))) for n in ("a.pdf", "b.bmp", "c.txt")] == ["pdf", "image", "unknown"]


def test_languages(spark):
    arr = lambda *x: F.array(*map(F.lit, x)).cast("array<string>")
    for langs, want in ((("en", "fr", "nl"), "eng+fra+nld"), (("xx",), "xx"), ((), "eng"), (("en", "en", "fr"), "eng+fra")):
        assert one(spark, languages.ocr_argument(arr(*langs))) == want
    for raw, want in (("Latin", "Latn"), ("han", "Hani"), ("Thai", "Thai"), (" ", None), (None, None)):
        assert one(spark, languages.script_code(F.lit(raw).cast("string"))) == want
    limits = {("google/translategemma-12b", "gemma"): 7392, ("opus_fr", "ct2"): 1575, ("facebook/nllb-200", "x"): 3800, ("other", "vllm"): 7680, ("other", "ct2"): 1575}
    for (m, b), want in limits.items():
        assert one(spark, languages.most_characters(languages.limit_of(F.lit(m), F.lit(b)))) == want
    assert one(spark, languages.model_of(F.lit("sr-Cyrl"))) == "opus_sh_en_ct2"
    assert one(spark, languages.language_fallback(F.lit(""), F.lit(None).cast("string"), arr())) == "en"


def test_arguments():
    assert [parse_mode(m) for m in ("default", "repair", "redo")] == ["default", "repair", "redo"]
    for bad in ("unknown", "", "DEFAULT"):
        with pytest.raises(ValueError):
            parse_mode(bad)
    check_search("q", "both", "page", 50)
    for args in (("", "both", "page", 1), ("q", "all", "page", 1), ("q", "mt", "doc", 1), ("q", "mt", "page", 51)):
        with pytest.raises(ValueError):
            check_search(*args)
    with pytest.raises(ValueError):
        check_mode(4)
    assert stable_json({"b": 1, "a": [2]}) == stable_json({"a": [2], "b": 1})


# full text


def test_matching(spark):
    texts = [("The cat, and the DOG", True), ("cat", False), (None, False), ("dog-cat", True), ("dogs cat", False)]
    for t, want in texts:
        assert one(spark, fulltext.matches(F.lit(t).cast("string"), "Dog cat")) == want
    assert one(spark, fulltext.matches(F.lit("x"), " .,")) is False


def test_headline(spark):
    t = " ".join(f"w{i}" for i in range(200)).replace("w50 ", "Hit, ").replace("w150 ", "hit ")
    h = one(spark, fulltext.headline(F.lit(t), "hit", 40, 15))
    a, b = h.split(" … ")
    assert len(a.split()) == len(b.split()) == 40 and a.split()[7] == "<b>Hit,</b>" and b.split()[7] == "<b>hit</b>"
    assert one(spark, fulltext.headline(F.lit("a b c"), "zz", 40, 2)) == "a b"
