import json

import pytest
from pyspark.sql import functions as F

from callscope.functions import text as X
from callscope.functions.keywords import KeywordIndex, keyword_scores
from callscope.operators import calls as C
from callscope.schemas import MODEL_ANALYSIS
from callscope.packs import TELECOM

T = F.col("t")

# Transcripts with the analysis that the dictionaries give by hand.
GOLDEN = [
    ("g1", "用户：我要转网，因为套餐太贵了而且信号也差。", "转网/携号转网", "high", "资费过高、信号差", "negative", -0.4, 30),
    (
        "g2", "你好，我想办理携号转网，把号码转到中国电信，现在的套餐太贵了，信号还不好。",
        "转网/携号转网", "high", "资费过高、信号差", "neutral", 0.0, 30,
    ),
    (
        "g3",
        "客服: 您好，请问有什么可以帮您？\n用户: 我要投诉！你们乱扣我费用！\n客服: 不好意思，您能说具体一点吗？\n"
        "用户: 我这个月话费多了50块钱，我查了半天发现是开了个什么彩铃业务，我从来没开过！你们就是坑钱的！\n"
        "客服: 我帮您查一下业务开通记录...\n用户: 你们这样我要投诉到工信部去！",
        "投诉", "high", "服务不满意、客服体验差", "negative", -0.4, 48,
    ),
    (
        "g4",
        "客服: 您好，请问有什么可以帮您？\n用户: 我想问一下有没有适合老人的套餐，我爸妈打电话比较多但不会用流量。\n"
        "客服: 有的，我们有孝心套餐，月费39，含500分钟通话。\n用户: 那还不错，帮我办一个。",
        "业务咨询", "low", "客服体验差", "positive", 0.4, 33,
    ),
    ("g5", "", "其他/未识别", "low", "未明确说明", "neutral", 0.0, 30),
    ("g6", None, "其他/未识别", "low", "未明确说明", "neutral", 0.0, 30),
    ("g7", "差垃圾坑骗气无语不想算了不用了", "销户", "medium", "服务不满意", "negative", -1.0, 30),
]


def test_golden_calls(spark):
    df = spark.createDataFrame([r[:2] for r in GOLDEN], "call_id string, transcript string")
    got = {r["call_id"]: r for r in C.analyze_calls(df).collect()}
    for key, text, intent, risk, reason, mood, score, seconds in GOLDEN:
        row = got[key]
        assert row["switch_reason"] == reason, key
        assert (row["caller_intent"], row["risk_level"], row["sentiment"]) == (intent, risk, mood), key
        assert row["sentiment_score"] == pytest.approx(score), key
        assert row["duration_seconds"] == seconds, key


def test_summary_and_action(spark):
    df = spark.createDataFrame([("a", GOLDEN[0][1]), ("b", GOLDEN[3][1])], "call_id string, transcript string")
    a, b = C.analyze_calls(df).orderBy("call_id").collect()
    assert a["summary"] == "用户致电意图：【转网/携号转网】；转网原因：资费过高、信号差；情绪倾向：negative（-0.40）；风险等级：HIGH"
    assert b["summary"] == "用户致电意图：【业务咨询】；情绪倾向：positive（0.40）；风险等级：LOW"
    assert a["suggested_action"] == TELECOM.actions["资费过高"]
    assert b["suggested_action"] == TELECOM.actions["客服体验差"]


def test_ties_follow_dictionary_order(spark, one):
    pack = {"b": ("x", "y"), "a": ("x", "z"), "c": ("q",)}
    got = one(keyword_scores(T, pack), row=("X y z",))
    assert [(r["category"], r["score"]) for r in got] == [("b", 2), ("a", 2)]


def test_keyword_counts_once_per_text_and_keywords_keep_their_case(one):
    got = one(keyword_scores(T, {"a": ("ab", "AB")}), row=("ab ab AB",))
    assert [(r["category"], r["score"]) for r in got] == [("a", 1)]


def test_more_keywords_than_one_mask_word(one):
    pack = {f"c{i}": tuple(f"k{i}_{j}_" for j in range(20)) for i in range(8)}
    assert KeywordIndex(pack).words == 3
    text = " ".join(f"k{i}_{j}_" for i in range(8) for j in range(i + 1))
    got = one(keyword_scores(T, pack), row=(text,))
    assert [(r["category"], r["score"]) for r in got] == [(f"c{i}", i + 1) for i in reversed(range(8))]


def test_entities(one):
    text = "我在北京上海，套餐199元，１９９元，20GB流量，500分钟，合约还有2个月到期，电话13812345678，联通和广电"
    got = json.loads(one(F.to_json(X.entities(T)), row=(text,)))
    assert got == {
        "amount_yuan": "199", "data_gb": "20", "minutes": "500", "months": "2", "phone": "13812345678",
        "has_contract": True, "contract_expiring": True, "competitors": ["联通", "广电"], "location": "北京",
    }
    assert one(F.to_json(X.entities(T)), row=("nothing",)) == "{}"
    assert json.loads(one(F.to_json(X.entities(T)), row=("１９９元",)))["amount_yuan"] == "１９９"


def test_turn_analysis_equals_transcript_analysis(spark):
    turns = [
        (key, n, "customer" if line.startswith("用户") else "agent", line[4:])
        for key, text in (("g3", GOLDEN[2][1]), ("g4", GOLDEN[3][1]))
        for n, line in enumerate(text.split("\n"))
    ]
    df = spark.createDataFrame(turns, "call_id string, turn int, role string, text string").repartition(4)
    from callscope.packs import TELECOM_ENTITIES

    by_turn = C.analyze_turns(df, "call_id", "role", "text", turn="turn", rules=TELECOM_ENTITIES)
    whole = C.analyze_calls(
        C.assemble(df, "call_id", "turn", "role", "text"), "call_id", "transcript"
    ).drop("transcript")
    columns = whole.columns
    key = lambda r: r["call_id"]
    assert sorted(by_turn.select(columns).collect(), key=key) == sorted(whole.collect(), key=key)


def test_first_entity_in_turn_order(spark):
    from callscope.packs import TELECOM_ENTITIES

    rows = [("c", 2, "customer", "30元"), ("c", 1, "customer", "联通"), ("c", 10, "customer", "50元 电信"), ("c", 3, "agent", "到期")]
    df = spark.createDataFrame(rows, "c string, turn int, role string, text string").repartition(3)
    got = C.analyze_turns(df, "c", "role", "text", turn="turn", rules=TELECOM_ENTITIES).first()["key_entities"]
    assert (got["amount_yuan"], got["competitors"], got["contract_expiring"]) == ("30", ["联通", "电信"], True)


def test_speaker_only(spark):
    rows = [("c", "agent", "可以投诉"), ("c", "customer", "我要销户")]
    df = spark.createDataFrame(rows, "c string, role string, text string")
    assert C.analyze_turns(df, "c", "role", "text").first()["caller_intent"] == "投诉"
    assert C.analyze_turns(df, "c", "role", "text", speaker="customer").first()["caller_intent"] == "销户"


def test_split_and_assemble(spark):
    text = "客服: 您好 \n\n用户:  我要 \nno prefix\n用户:"
    df = spark.createDataFrame([("a", text)], "id string, t string")
    turns = C.split_turns(df, "id", "t")
    got = [(r["turn"], r["role"], r["text"]) for r in turns.orderBy("turn").collect()]
    assert got == [(0, "agent", "您好"), (1, "customer", "我要"), (2, "agent", "no prefix")]
    back = C.assemble(turns, "id", "turn", "role", "text").first()
    assert back["transcript"] == "客服: 您好\n用户: 我要\n客服: no prefix"


def test_long_call_is_assembled_in_parts(spark):
    df = spark.range(2500).selectExpr("'hot' AS c", "id AS turn", "'agent' AS role", "cast(id AS string) AS t")
    parts = C.assemble(df, "c", "turn", "role", "t", part_turns=1000).orderBy("part").collect()
    assert [p["part"] for p in parts] == [0, 1, 2]
    lines = [line for p in parts for line in p["transcript"].split("\n")]
    assert lines == [f"客服: {i}" for i in range(2500)]


def test_redaction(one):
    card, phone = "11010519900307123X", "13812345678"
    assert one(X.redact(T), row=(f"a{card}b{phone}c",)) == "a[ID_REDACTED]b[PHONE_REDACTED]c"
    inside = "9138123456789"
    assert one(X.redact(T), row=(inside,)) == inside
    assert one(X.redact(T, boundaries=False), row=(inside,)) == "9[PHONE_REDACTED]9"
    assert one(X.redact(T), row=(f"{card} {phone}",)) == "[ID_REDACTED] [PHONE_REDACTED]"


def test_duration(one):
    assert one(X.duration(T), row=("abcd\nefghij",)) == 2.5
    assert one(X.duration(T), row=(None,)) == 0.0
    assert one(X.duration(T, F.lit(12.34)), row=("abc",)) == 12.3
    assert one(X.duration(T, F.lit(None)), row=("a" * 5,)) == 1.2  # 1.25, half to even


def test_reason_tags(one):
    tags = lambda reason, intent: one(
        X.reason_tags(F.col("a"), F.col("b"), TELECOM.unknown_reason, "其他"), "a string, b string", (reason, intent)
    )
    assert tags("资费过高、信号差", "投诉") == ["资费过高", "信号差"]
    assert tags("a， b,/c", None) == ["a", "b", "c"]
    assert tags("未明确说明", "投诉") == ["投诉"]
    assert tags("搬家/换地区", "x") == ["搬家", "换地区"]
    assert tags(None, None) == ["其他"]
    assert tags("", "") == ["其他"]


def test_bigrams(one):
    assert one(X.bigrams(T), row=("我要转网，太贵 12",)) == ["我要", "要转", "转网", "网太", "太贵"]
    assert one(X.bigrams(T), row=("好。",)) == ["好"]
    assert one(X.bigrams(T), row=("12 ！",)) == []
    assert one(X.bigrams(T), row=("a😀b",)) == ["a😀", "😀b"]


def test_emotion_vote(one):
    vote = lambda text: one(X.emotion_vote(T), row=(text,))
    assert vote("<|SAD|>a<|ANGRY|>b<|SAD|>") == "SAD"
    assert vote("<|HAPPY|>a<|SAD|>") == "HAPPY"
    assert vote("<|NEUTRAL|><|EMO_UNKNOWN|>") == "NEUTRAL"
    assert vote("none") == "NEUTRAL"
    assert vote(None) == "NEUTRAL"
    assert vote("<|NEUTRAL|><|NEUTRAL|><|FEARFUL|>") == "FEARFUL"


def test_prompts(one):
    got = one(X.call_prompt(T), row=("你好",))
    assert got.endswith("The call:\n你好") and '{"amount_yuan"' in got and "{{" not in got
    assert all(f"\n{name} (" in got for name in ("caller_intent", "switch_reason", "sentiment", "risk_level", "key_entities", "suggested_action", "summary"))
    got = one(X.quality_prompt(T, F.lit("")), row=("你好",))
    assert "The call:\n你好\n" in got and "heard as NEUTRAL" in got and "价格敏感、套餐不匹配" in got
    assert all(f"\n{f.name}: " in got for f in MODEL_ANALYSIS.fields)
    own = one(X.call_prompt(T, "a {{b}} {transcript} c"), row=(None,))
    assert own == "a {b}  c"


def test_agreement(spark):
    cols = "call_id string, caller_intent string, switch_reason string, sentiment string, risk_level string, suggested_action string"
    a = spark.createDataFrame([("1", "i", "r", "s", "k", "x"), ("2", "i", None, "s", "k", "x"), ("3", "i", "r", "s", "k", "x")], cols)
    b = spark.createDataFrame([("1", "i", "r", "s", "k", "y"), ("2", "i", None, "z", "k", "y"), ("3", "q", "r", "q", "q", "q")], cols)
    scored = C.agreement(a, b)
    got = {r["call_id"]: (r["matches"], r["band"]) for r in scored.collect()}
    assert got == {"1": (4, "high"), "2": (2, "partial"), "3": (1, "low")}
    assert C.agreement_rates(scored).first()["switch_reason_rate"] == pytest.approx(2 / 3)


def test_two_packs_in_one_pass(spark):
    import dataclasses

    other = dataclasses.replace(TELECOM, intents={k: v[:1] for k, v in TELECOM.intents.items()})
    df = spark.createDataFrame([(g[0], g[1]) for g in GOLDEN] + [("n", None)], "call_id string, transcript string")
    joined = C.agreement(C.analyze_calls(df, rules=None), C.analyze_calls(df, pack=other, rules=None))
    once = C.compare_packs(df, "call_id", "transcript", TELECOM, other)
    assert sorted(once.collect()) == sorted(joined.collect())
    assert "Join" not in once._jdf.queryExecution().executedPlan().toString()
