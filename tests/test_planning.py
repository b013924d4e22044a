from pyspark.sql import functions as F

from corvane.functions.planning import align_targets, keyword_query


def test_keyword_queries(spark):
    rows = [(0, "如何 备份 “数据” 恢复 校验 归档", ""), (1, "A or  OR B OR", "部署手册中的备份"), (2, "如何 说明", None), (3, "旧词 x", ""), (4, "部署手册", "部署手册中的备份"), (5, " ", "a中的b"), (6, None, None), (7, "x", "目标：手册 一中的备份中的y")]
    df = spark.createDataFrame(rows, "i int, q string, g string")
    got = {r.i: r.k for r in df.select("i", keyword_query(F.col("q"), F.col("g"), ["如何", "说明"], {"旧词": "新词"}).alias("k")).collect()}
    assert got == {0: "备份 数据 恢复 校验", 1: "A OR B OR 部署手册", 2: "如何", 3: "新词 x", 4: "部署手册", 5: None, 6: None, 7: "x OR 手册 一"}


def test_targets_go_to_their_goals(spark):
    rows = [(0, ["备份策略", "权限模型"], ["说明权限模型", "解释备份策略"]), (1, ["a"], []), (2, ["手册中的备份", "规范中的审计", "x"], ["x y", "审计", "备份手册"]), (3, ["q"], ["z"])]
    df = spark.createDataFrame(rows, "i int, t array<string>, g array<string>")
    got = {r.i: r.o for r in df.select("i", align_targets(F.col("t"), F.col("g")).alias("o")).collect()}
    assert got == {0: ["权限模型", "备份策略"], 1: None, 2: ["x", "规范中的审计", "手册中的备份"], 3: ["q"]}
