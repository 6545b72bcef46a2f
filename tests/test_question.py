from pyspark.sql import functions as F

from sparkfolio.functions import question as qn
from sparkfolio.functions import text as tx

CASES = {
    "STM32智能浇花系统如何控制土壤湿度？": {"intent": "procedure"},
    "《基于STM32单片机的智能浇花系统设计》这篇论文的硬件组成有哪些？":
        {"intent": "composition", "requested_title": "基于STM32单片机的智能浇花系统设计"},
    "智能浇花系统如何控制土壤湿度？；补充要求：详细一点": {"wants_detailed": True},
    "总结这篇论文，不要英文摘要和英文关键词": {"intent": "summary", "avoids_english": True},
    "土壤湿度传感器和温湿度传感器有什么区别？": {"compare_subjects": ["土壤湿度传感器", "温湿度传感器"]},
    "继续，详细一点": {"is_follow_up": True},
    "智能浇花系统如何控制土壤湿度？": {"is_follow_up": False},
}


def test_profiles(spark):
    df = qn.with_profile(spark.createDataFrame([(q,) for q in CASES], "question string"))
    rows = {r["question"]: r.asDict() for r in df.collect()}
    for q, want in CASES.items():
        for k, v in want.items():
            assert rows[q][k] == v, (q, k, rows[q][k])
    assert "stm32" in rows["STM32智能浇花系统如何控制土壤湿度？"]["focus_terms"]
    assert all("详细一点" not in t for t in rows["智能浇花系统如何控制土壤湿度？；补充要求：详细一点"]["focus_terms"])


def test_tokens_and_follow_up(spark):
    df = spark.createDataFrame([("STM32 智能浇花 a 开",)], "t string")
    assert df.select(tx.tokens(F.col("t"))).first()[0] == ["stm32", "智能浇花", "智能", "能浇", "浇花"]
    h = spark.createDataFrame(
        [("继续，详细一点", "智能浇花如何控制？", "采用 PWM 控制，ESP-01S 模块上传数据"), ("你好", "x y", "")],
        "q string, p string, a string",
    )
    got = [r[0] for r in h.select(qn.normalized_question(F.col("q"), F.col("p"), F.col("a"))).collect()]
    assert got[0].startswith("智能浇花如何控制？；补充要求：继续，详细一点。重点关注：")
    assert "PWM" in got[0] and got[1] == ""
