import pytest

from veinstone.llm import residue as R

CASES = [
    "Dear {{ customer_name }}, your application was received.", "合同编号${contract_no}，担保金额@@AMOUNT@@。", "The cover for <enter branch> starts on [Insert date here].", "尊敬的【请填写客户名称】：您好。",
    "Vertrag [Vertragsnummer einfügen] zwischen uns.", "＿＿＿＿（金额）", "兹确认[签发日期待补充]的授信额度。", "[AMOUNT – to be completed]", "%(issueDate)s", "__CONTRACT_NO__", "<%= holder %>", "#{plan.rate}",
    "Lorem ipsum dolor sit amet.", "Estor ipsen quenti quenti tolum suntem vinum consel lorda oblu mirat.", "Your text goes here.", "这里是正文占位内容。这里是正文占位内容。", "Mustertext, bitte ersetzen.", "TBD – content pending.",
    "404 Not Found", "HTTP Status 500 – Internal Server Error", "系统繁忙，请稍后再试。", "Das Formular wurde nicht gefunden.", "The page you asked for is no longer here.", '{"code":500,"message":"internal error","traceId":"d31c"}', "Your session has expired.",
    "Please enable JavaScript to view this page.", "您的浏览器禁用了脚本，页面无法显示。", "Zum Anzeigen dieser Inhalte müssen Skripte erlaubt sein.", "noscript: content hidden because scripting is off",
    "A real sentence about loans.\n\n内容待补充。\n\nAnother real sentence.",
]
TRAPS = [
    "The fee band is {low, middle, high}; see [Annex B] and [4.1] for the table.", "费率档位为{低、中、高}，参见【附件二】与[4.1]。", "The price is $410 per file, and f(x) = {x : x > 3} is set by the committee.", '{"plan":"ZE-6599","rate":31.7,"term":25}',
    "Each letter template holds a placeholder for the amount, which the system fills before dispatch.", "上季度“系统繁忙”提示共出现424次，主要原因是会话超时。", "When the plan number is unknown, the gateway answers with status 404 and the caller shows the search form instead.",
    "Clerks who see a blank page should turn on JavaScript in the browser settings before they ring the help desk.", "The training unit uses sample text only in courses, never in letters to applicants.", "Card numbers are shown as 4111 **** **** 1111 on every printout.",
    "In the syntax of the letters a variable is written as {{name}}.\nThe rest of the manual tells at length how letters are made, checked, signed and sent, and who answers for them in the end.",
    "Use ```{{ name }}``` in code.", "Session time-outs were the most frequent cause of internal server errors in the spring report.", "", None,
]


@pytest.mark.parametrize("t", CASES)
def test_cases(t):
    assert R.kinds_of(t)[0]


@pytest.mark.parametrize("t", TRAPS)
def test_traps(t):
    assert not R.kinds_of(t)[0]


def test_invisible_and_foreign_characters_in_between():
    assert R.kinds_of("系统​繁忙，请稍后再试。")[0] == {"error"}
    assert R.kinds_of("Your text goesメモ here.")[0] == {"filler"}


def test_frames(spark):
    rows = [(1, CASES[0], "a"), (2, TRAPS[0], "b"), (3, None, "c"), (4, "", "d"), (1, CASES[0], "a"), (5, "word " * 40_000 + "\n404 Not Found", "e"), (None, "404 Not Found", "f")]
    df = spark.createDataFrame(rows, "doc_id long, text string, kinds string")
    got = R.find_residue(df, "doc_id", "text")
    assert sorted(r["doc_id"] or 0 for r in got.collect()) == [0, 1, 1, 5]
    assert sorted(r["doc_id"] or 0 for r in R.without_residue(df, "doc_id", "text").collect()) == [0, 2, 3, 4]
    assert R.find_residue(df.where("doc_id < 0"), "doc_id", "text").count() == 0


@pytest.mark.parametrize(
    "t, kind",
    [(x, "error") for x in ("This page does not exist.", "The page is not available.", "The file has been deleted.", "404 Gone", "访问被拒绝", "该文件未找到")]
    + [(x, "filler") for x in ("Your paragraph goes here.", "test test test", "Sample paragraph, replace before release.")] + [("请启用JS", "script")],
)
def test_short_texts_of_residue_alone(t, kind):
    assert R.kinds_of(t) == ({kind}, 1.0)


@pytest.mark.parametrize("text", ["该服务器无响应。", "服务器无响应。", "文档未找到。", "请求被拒绝。", "test test test", "This page does not exist.", "404 Gone", "请启用JS", "Your paragraph goes here."])
def test_short_messages_are_judged_without_any_hint_of_words(text):
    assert R.kinds_of(text)[0]


def test_what_a_delimiter_holds_may_be_long():
    name = "Name of the very long contracting party and its legal successors in all branches of the group"
    for text in (f"Between [{name} – to be completed] and us.", f"Between [insert {name} here] and us.", f"Dear [Your {name}], thank you."):
        assert "placeholder" in R.kinds_of(text)[0]
    assert not R.kinds_of(f"Between ({name}, the bank – which decides) and us.")[0]


def test_placeholders_are_discounted_by_what_surrounds_them():
    prose = "The mail service fills in what it knows about each reader before it sends the letter. " * 6
    assert "placeholder" in R.kinds_of(prose + "Dear {{ customer.name }}, welcome.")[0]
    assert not R.kinds_of(prose + "```\nDear {{ customer.name }}, welcome.\n```\n" + prose)[0]
    assert not R.kinds_of(prose + "A variable such as {{ customer.name }} is looked up.")[0]
    assert not R.kinds_of(prose + "The syntax for example is as follows:\n{{ customer.name }}\n" + prose)[0]
    assert "placeholder" in R.kinds_of("The syntax is {{ a }} {{ b }} {{ c }} {{ d }}")[0]  # dense


def test_every_grammar_is_tried_where_its_sentence_can_begin():
    """The table by first characters leaves out no rule that matches."""
    import re

    for sentence in ("lorem ipsum dolor", "Traceback (most recent call last):", "抱歉，该页面不存在", "请先启用 JavaScript", "Fehler 404", "HTTP Status 500", "ſorry, something went wrong", "noscript"):
        plain = {k for k, p in R._KINDS_OF_SENTENCE if re.match("(?:" + p + R._TAIL, sentence, re.I | re.S)}
        assert (R._GRAMMAR.kind(sentence) in plain) if plain else R._GRAMMAR.kind(sentence) is None
