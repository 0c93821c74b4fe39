"""Rules of sources on small papers in their forms."""

import datetime

from folio_spark.operators import metadata as Y


def facts(spark, rows):
    docs = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id int, source string, title string, text string, column string, channel string")
    return [tuple(r)[1:] for r in Y.infer_metadata(docs).orderBy("doc_id").collect()]


def test_rules_of_sources(spark):
    day = datetime.date
    rows = [
        ("court_main", "最高人民法院、最高人民检察院关于办理某某案件的规定", "法释〔2020〕5号\n自2020年3月1日起施行", None, None),
        ("court_main", "两高一部关于某事的意见", None, None, None),
        ("court_main", "某次会议", "新闻导语。关于审理的批复……", None, None),
        ("spp_gov_cn", "两高关于办理案件的复函", "自 2019年 5月 6日 起施行", None, "sfjs"),
        ("spp_gov_cn", "工作情况", "", None, "gfwj"),
        ("spp_gov_cn", "最高人民法院 最高人民检察院 公安部 司法部办法", "", None, None),
        ("csrc_gov_cn", "甲办法", "证监会令第12号 原证监会令第 034 号\n2021年1月2日 自公布之日起施行", None, None),
        ("csrc_gov_cn", "乙指引", "证监会公告〔2022〕07号，自 2022年3月4日起施行。2022年2月1日", None, None),
        ("csrc_gov_cn", "【第 9号令】丙规定", "", "规章", None),
        ("csrc_gov_cn", "【第9号令】丙规定", "", None, None),
        ("gov_xzfgk", "丁条例", "中华人民共和国国务院令 第 588 号 2011年1月8日公布 自 2011年2月1日起施行", None, None),
        ("gov_xzfgk", "戊办法", "中国银监会令 2010 年 第 3 号", None, None),
        (None, "公司法", "2023年13月40日通过", None, None),
        (None, None, None, None, None),
    ]
    assert facts(spark, rows) == [
        ("最高人民法院、最高人民检察院", "judicial_interpretation", "法释〔2020〕5号", day(2020, 3, 1), day(2020, 3, 1)),
        ("最高人民法院、最高人民检察院、公安部", "judicial_policy", None, None, None),
        ("最高人民法院", "judicial_interpretation", None, None, None),
        ("最高人民法院 最高人民检察院", "judicial_interpretation", None, None, day(2019, 5, 6)),
        ("最高人民检察院", "judicial_policy", None, None, None),
        ("最高人民法院 最高人民检察院 公安部 司法部", "other", None, None, None),
        ("中国证券监督管理委员会", "department_rule", "证监会令第34号", day(2021, 1, 2), day(2021, 1, 2)),
        ("中国证券监督管理委员会", "other", "中国证券监督管理委员会公告〔2022〕7号", day(2022, 2, 1), day(2022, 3, 4)),
        ("中国证券监督管理委员会", "department_rule", None, None, None),
        ("中国证券监督管理委员会", "department_rule", "证监会令第9号", None, None),
        ("国务院", "admin_regulation", "国务院令第588号", day(2011, 1, 8), day(2011, 2, 1)),
        ("中国银行业监督管理委员会", "department_rule", "中国银监会令2010年第3号", None, None),
        (None, "law", None, None, None),
        (None, "other", None, None, None),
    ]


def test_own_numbers(spark):
    cases = [
        ("法释〔2020〕1号\n第一条 法释〔1999〕8号", "法释〔2020〕1号"),
        ("《旧规定》（法释〔2001〕9号）的说明", None),
        ("《旧规定》（法释〔2001〕9号）修改为法释〔2020〕2号", "法释〔2020〕2号"),
        ("根据法发〔2010〕3号，制定本规定。", None),
        ("为正确理解和适用有关规定，按照法发〔2010〕3号的要求\n法发〔2011〕4号", "法发〔2011〕4号"),
        ("说明。公告 法发〔2012〕 5 号", "法发〔2012〕5号"),
        (None, None),
    ]
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "doc_id int, text string")
    got = {r["doc_id"]: r["docnum"] for r in Y.own_docnum(docs).collect()}
    assert got == {i: n for i, (_, n) in enumerate(cases) if n}


def test_amending_decisions(spark):
    new = "第一条 新条文。"
    cases = [
        ("关于修改《关于审理某类案件的解释》的决定", "新闻稿。\n《关于修改的决定》已通过，现予公布，自公布之日起施行。\n对《关于审理某类案件的解释》（法释〔2012〕6号）作如下修改。\n根据本决定，《关于审理某类案件的解释》作相应修改后重新公布。\n" + new),
        ("关于修改《甲解释》等十八件解释的决定", "现予公布。\n根据本决定，《关于甲的解释》等十八件司法解释作相应修改后重新公布。\n" + new),
        ("关于修改《关于乙的规定》的决定", "决定如下。\n一、改。\n关于乙的\n规定\n（2010年公布 根据2020年《关于修改的决定》修正）\n" + new),
        ("关于修改《丙规定》的决定", "决定改第三条。"),
        ("丙规定", "根据本决定，《丙丙规定》重新公布。\n" + new),
        (None, None),
    ]
    docs = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "doc_id int, title string, text string")
    got = [tuple(r)[1:] for r in Y.split_amendments(docs).orderBy("doc_id").collect()]
    assert got[0][0] and got[0][1] == "法释〔2012〕6号" and got[0][2].startswith("《关于修改的决定》已通过") and got[0][2].endswith("重新公布。") and got[0][3:] == ("关于审理某类案件的解释", new, False)
    assert got[1][1] is None and got[1][4] == new and got[1][5]
    assert got[2][2] == "决定如下。\n一、改。" and got[2][3] == "关于乙的规定" and got[2][4].startswith("关于乙的\n规定\n（2010") and not got[2][5]
    assert got[3] == (True, None, "决定改第三条。", None, None, False)
    assert got[4][0] is False and got[4][4] is None and got[4][2] == cases[4][1] and got[5][0] is False
