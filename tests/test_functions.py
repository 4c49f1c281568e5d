import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from hazardry import config
from hazardry.functions import geometry, text
from hazardry.operators.matching import iou_matrix


def _one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


def _box(*v):
    return F.array(*[F.lit(float(x)) for x in v])


def test_iou(spark):
    row = _one(spark, a=geometry.iou(_box(0, 0, 200, 200), _box(100, 100, 300, 300)), b=geometry.iou(_box(5, 5, 5, 5), _box(5, 5, 5, 5)), c=geometry.iou(_box(100, 100, 300, 400), _box(110, 110, 290, 390)))
    assert row.a == pytest.approx(1 / 7) and row.b == 0 and row.c == pytest.approx(0.84)


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(0, 100), min_size=8, max_size=8))
def test_iou_is_symmetric_and_bounded(v):
    import numpy as np

    a, b = np.array([[min(v[0], v[2]), min(v[1], v[3]), max(v[0], v[2]), max(v[1], v[3])]], float), np.array([[min(v[4], v[6]), min(v[5], v[7]), max(v[4], v[6]), max(v[5], v[7])]], float)
    x, y = iou_matrix(a, b)[0, 0], iou_matrix(b, a)[0, 0]
    assert x == y and 0 <= x <= 1


def test_repair(spark):
    fixed = lambda *v: list(_one(spark, x=geometry.repaired(_box(*v))).x)
    assert fixed(500, 900, 100, -5) == [100, 0, 500, 900]
    assert fixed(1000, 10, 1200, 10) == [1000, 10, 1000, 11]
    assert fixed(0.5, 1.5, 2.5, 3.5) == [0, 2, 2, 4]


def test_letterbox_and_flip(spark):
    row = _one(spark, a=geometry.letterbox(_box(0, 0, 1600, 900), F.lit(1600), F.lit(900), 672, 448), b=geometry.flipped(_box(10, 20, 30, 40), F.lit(100.0)))
    assert row.a == pytest.approx([0, 35, 672, 35 + 378]) and row.b == [70, 20, 90, 40]


def test_projection(spark):
    level, none = _box(1, 0, 0, 0), _box(0, 0, 0)
    camera = F.array(_box(800, 0, 800), _box(0, 800, 450), _box(0, 0, 1))
    corners = lambda z: F.array(*[_box(x, y, z) for x in (-1, 1) for y in (-1, 1)])
    project = lambda c: geometry.projected_box(c, none, level, none, level, camera, F.lit(1600), F.lit(900))
    row = _one(spark, a=project(corners(8)), b=project(corners(-8)))
    assert row.a == [438, 389, 562, 611] and row.b is None
    turned = F.array(*[F.lit(v) for v in (0.7071067811865476, 0.0, 0.7071067811865476, 0.0)])  # quarter turn about y: z' of the sensor is x of the world
    seen = geometry.projected_box(F.array(_box(8, 0, 0)), none, turned, none, level, camera, F.lit(1600), F.lit(900))
    assert _one(spark, a=seen).a == [500, 500, 500, 500]


def test_keywords(spark):
    c = lambda s: F.lit(s)
    row = _one(
        spark, a=text.classify(c("Heavy RAIN at night"), text.WEATHER), b=text.classify(c("dark road"), text.WEATHER), n=text.classify(F.lit(None).cast("string"), text.WEATHER),
        lot=text.classify(c("a lot of cars"), text.ROAD_TYPE), words=text.classify(c("a lottery"), text.ROAD_TYPE, whole_words=True), train=text.keyword_any(c("a train"), ["rain"]),
        whole=text.keyword_any(c("a train"), ["rain"], whole_words=True), first=text.first_keyword(c("fog and rain"), ["rain", "fog"]), none=text.first_keyword(c("x"), ["rain"]),
    )
    assert tuple(row) == ("rain", "night", "clear", "parking", "urban", True, False, "rain", "")


def test_json_answers(spark):
    get = lambda s, **k: _one(spark, x=text.json_object(F.lit(s), **k)).x
    assert get('```json\n{"a": 1}\n```') == '{"a":1}' and get('so: {"a": {"b": 2}} ok') == '{"a":{"b":2}}'
    assert get("[1, 2]") is None and get("no") is None and get("") is None
    assert _one(spark, x=text.judged_score(F.lit('x "score": 4 y'))).x == 4 and _one(spark, x=text.judged_score(F.lit("x"))).x == 1


def test_small_texts(spark):
    row = _one(spark, a=text.zfill(F.lit(" 7 "), 3), b=text.zfill(F.lit("1234"), 3), c=text.safe_name(F.lit("a/b é.c")), d=text.with_scheme(F.lit("/x")), e=text.with_scheme(F.lit("https://x")))
    assert tuple(row) == ("007", "1234", "a_b_é_c", "file:///x", "https://x")


def test_config(tmp_path):
    (tmp_path / "a.yaml").write_text("p: {x: 1, y: '${NO_SUCH:z}/w'}\n")
    (tmp_path / "b.yaml").write_text("p: {x: 2}\n")
    assert config.load(tmp_path / "a.yaml", tmp_path / "b.yaml") == {"p": {"x": 2, "y": "z/w"}}
    assert config.choose(0, 3) == 0 and config.choose(None, 3) == 3


def test_label_masks_takes_texts_of_any_length(spark, tmp_path):
    from hazardry.plans import registry

    texts = [None, "", "a", "ab", "b" * 150 + " t" + "c" * 700, "d" * 401]
    spark.createDataFrame([(k, 0, t) for k, t in enumerate(texts)], "conv_id long, turn int, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = {r.conv_id: (r.n, r.start) for r in registry.queries()["label_masks"](spark, str(tmp_path)).collect()}
    assert got == {0: (None, None), 1: (0, 0), 2: (1, 1), 3: (2, 2), 4: (852, 152), 5: (401, 401)}
