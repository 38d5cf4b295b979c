import json

import pytest
from pyspark.sql import functions as F, types as T

from callscope.functions import jsontext as J, rules as R, scalars as S
from callscope.packs import ANALYSIS_DEFAULTS

C = F.col("t")


def _rules(spark, text, chars=80):
    row = spark.createDataFrame([(text,)], "t string").select(*[c.alias(n) for n, c in R.rule_analysis(C, summary_chars=chars).items()]).first()
    return row.asDict()


def test_rule_analysis(spark):
    got = _rules(spark, "我要投诉，太贵了，\n降档")
    assert got == {
        "downgrade_related": True, "primary_reason": "服务体验差", "secondary_reason": "", "summary": "我要投诉，太贵了， 降档",
        "confidence": 0.8, "text_emotion": "不满", "bad_tone": True, "emotion_score": 0.8,
    }
    got = _rules(spark, "每月79，想换电信")
    assert (got["primary_reason"], got["confidence"], got["text_emotion"], got["emotion_score"]) == ("价格敏感", 0.5, "焦急", 0.5)
    got = _rules(spark, "x" * 100)
    assert (len(got["summary"]), got["primary_reason"], got["confidence"], got["emotion_score"]) == (80, "其他", 0.3, 0.2)
    assert _rules(spark, None)["summary"] == ""
    assert len(_rules(spark, "x" * 100, None)["summary"]) == 100


def test_empty_packs(spark):
    from callscope.functions.base import contains_any, first_contained
    from callscope.functions.keywords import KeywordIndex

    frame = spark.createDataFrame([("abc",)], "t string")
    index = KeywordIndex({"none": (), "some": ("b",)})
    row = frame.select(contains_any(C, ()).alias("a"), first_contained(C, {}).alias("b"), index.count(index.masks(C), "none").alias("n"), index.count(index.masks(C), "some").alias("s")).first()
    assert tuple(row) == (False, None, 0, 1)


def test_explicit_nulls_of_a_model_stay_null(spark):
    from callscope.operators.models import enrich

    answers = ['{"caller_intent": "x", "sentiment": null, "sentiment_score": null}', '{"caller_intent": "x"}']
    frame = spark.createDataFrame([(0, "a"), (1, "b")], "doc_id int, t string")
    rows = enrich(frame, "doc_id", "t", lambda: lambda texts: [answers["ab".index(t)] for t in texts]).orderBy("doc_id").collect()
    assert [(r["text_emotion"], r["emotion_score"]) for r in rows] == [("未知", 0.0), ("平静", 0.25)]


@pytest.mark.parametrize("score,expected", [("1", 0.0), ("-1", 1.0), ("0", 0.5), ("5", 0.0), ("x", 0.0), (None, 0.0), ("-0.3", 0.65)])
def test_normalize_score(one, score, expected):
    assert one(R.normalize_score(C), row=(score,)) == expected


@pytest.mark.parametrize("reason,expected", [
    ("太贵", "价格敏感"), ("信号差", "服务体验差"), ("unknown", "其他"), ("", "其他"), (None, "其他"),
    ("x，合约到期、太贵", "账户或设备变化"),
])
def test_map_reason(one, reason, expected):
    assert one(R.map_reason(C), row=(reason,)) == expected


def test_map_emotion(one):
    assert [one(R.map_emotion(C), row=(s,)) for s in ("negative", "positive", "neutral", "odd", None)] == ["不满", "平静", "平静", "未知", "未知"]


def test_acoustic(spark):
    rows = [("x", 0.31), ("x", 0.01), ("投诉", 0.1), ("搬家", None), ("x", None)]
    df = spark.createDataFrame(rows, "t string, rms double")
    got = [r[0] for r in df.select(R.acoustic_emotion(C, F.col("rms"))).collect()]
    assert got == ["ANGRY", "SAD", "ANGRY", "SAD", "NEUTRAL"]


def test_fill_defaults(spark):
    schema = ", ".join(f"{n} {'boolean' if isinstance(v, bool) else 'double' if isinstance(v, float) else 'string'}" for n, v in ANALYSIS_DEFAULTS.items())
    row = spark.createDataFrame([(None,) * 8], schema).withColumns(R.fill_defaults()).first()
    assert row.asDict() == ANALYSIS_DEFAULTS


def test_model_columns(spark):
    answer = F.from_json(F.lit(json.dumps({"caller_intent": "销户", "switch_reason": "x、信号差", "sentiment": "negative", "sentiment_score": -0.6, "summary": "s"})),
                         "caller_intent string, switch_reason string, sentiment string, sentiment_score string, summary string")
    row = spark.range(1).select(answer.alias("a"), F.lit("我要投诉").alias("t"))
    got = row.select(*[c.alias(n) for n, c in R.model_columns(F.col("a"), C).items()]).first().asDict()
    assert got == {
        "downgrade_related": True, "primary_reason": "服务体验差", "secondary_reason": "", "summary": "s", "confidence": 0.85,
        "text_emotion": "不满", "bad_tone": True, "emotion_score": 0.8,
    }


@pytest.mark.parametrize("raw,expected", [
    ('{"a": 1}', '{"a": 1}'), ('```json\n{"a": 1}\n```', '{"a": 1}'), ('say {"a": {"b": 2}} end', '{"a": {"b": 2}}'),
    ('{"a": ', None), (None, None), ("```\n[1]\n```", "[1]"), ("```json\nno\n``` {\"a\": 1}", '{"a": 1}'),
])
def test_rescue(one, raw, expected):
    assert one(J.rescue_json(C), row=(raw,)) == expected


@pytest.mark.parametrize("raw,expected", [('{"a": 1}', True), ("[1]", False), ("x {\"a\": 1}", False), ("```json\n{}\n```", True), (None, False)])
def test_strict(one, raw, expected):
    assert (one(J.strict_json(C), row=(raw,)) is not None) is expected


def test_parse_struct(one):
    schema = T.StructType([T.StructField("a", T.LongType())])
    assert one(J.parse_struct(C, schema), row=("{bad",)) is None
    assert one(J.parse_struct(C, schema), row=('{"a": 3}',))["a"] == 3
    for odd in ('[{"a": 1}]', "[]", "5", "null", '"x"', None):
        assert one(J.parse_struct(C, schema), row=(odd,)) is None
    assert one(J.parse_struct(C, schema), row=('{"a": "x"}',))["a"] is None


GOOD = {
    "has_face": True, "is_blurry": False, "is_face_blurry": False, "is_avatar": True, "clarity_confidence": 0.9,
    "avatar_confidence": 1, "reason": " fine ",
}


@pytest.mark.parametrize("change,error", [
    ({}, None), ({"reason": None}, "reason"), ({"reason": "  "}, "reason"), ({"reason": 3}, "reason"), ({"more": 1}, "fields"),
    ({"has_face": "true"}, "boolean"), ({"has_face": 1}, "boolean"), ({"clarity_confidence": 1.5}, "number"),
    ({"clarity_confidence": "0.5"}, "number"), ({"avatar_confidence": True}, "number"), ({"has_face": False}, "contradiction"),
    ({"is_blurry": True}, "contradiction"), ({"is_face_blurry": True}, "contradiction"),
])
def test_contract(one, change, error):
    got = one(J.validate_response(C), row=(json.dumps({**GOOD, **change}),))
    assert got["error"] == error
    if error is None:
        assert got["value"]["reason"] == "fine" and got["value"]["avatar_confidence"] == 1.0
    else:
        assert got["value"] is None


def test_contract_other_shapes(one):
    missing = {k: v for k, v in GOOD.items() if k != "reason"}
    assert one(J.validate_response(C), row=(json.dumps(missing),))["error"] == "fields"
    assert one(J.validate_response(C), row=("[1]",))["error"] == "not_object"
    assert one(J.validate_response(C), row=("not json",))["error"] == "not_object"
    assert one(J.validate_response(C), row=(None,))["error"] == "not_object"


def test_blobs(spark):
    rows = [(b"RIFFxxxx",), (b"ID3x",), (b"\xff\xfbx",), (b"\xff\xf3x",), ("文本".encode(),), (b"\xff\xfe",), (b"",), (None,)]
    df = spark.createDataFrame(rows, "b binary")
    got = df.select(S.is_audio(F.col("b")), S.blob_text(F.col("b"))).collect()
    assert [r[0] for r in got] == [True, True, True, True, False, False, False, False]
    assert [r[1] for r in got][4:] == ["文本", "", "", ""]


def test_scalars(spark, one):
    assert one(S.mask_id(C), row=("13812341234",)) == "138****1234"
    at = F.lit("2024-01-02 03:04:05").cast("timestamp")
    assert one(S.call_id_or_default(C, at), row=("",)) == "call_20240102_030405"
    assert one(S.guess_mime(C), row=("a/b.JPG",)) == "image/jpeg"
    assert one(S.guess_mime(C), row=("noext",)) == "application/octet-stream"
    assert one(S.guess_mime(C, F.lit("x/y")), row=("b.jpg",)) == "x/y"
    good, bad = S.split_blank(spark.createDataFrame([(" a　",), ("  ",), (None,)], "t string"), "t")
    assert [r["t"] for r in good.collect()] == ["a"] and bad.count() == 2


def test_rendered(spark):
    df = spark.sql("SELECT date'2024-01-02' AS d, timestamp_ntz'2024-01-02 03:04:05' AS n, timestamp'2024-01-02 03:04:05.5' AS s, X'61FF' AS b, array(1) AS a")
    assert tuple(S.rendered(df).first()) == ("2024-01-02", "2024-01-02T03:04:05", "2024-01-02T03:04:05.500000", "a�", [1])
