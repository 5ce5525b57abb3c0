"""Template residue and error-page text: records that hold no content, or residue in place of part of it.

Four kinds are told apart: an unfilled ``placeholder``, ``filler`` text, an ``error`` message and a ``script`` notice.
Placeholders have one grammar per delimiter (``{{name}}``, ``${name}``, ``<%= name %>``, ``[Insert name here]`` and so
on): a delimiter alone is no evidence, what it holds must be a name or an instruction to fill in. The other kinds are
judged by the sentence: the message itself must be what the sentence says, from its beginning, not what it reports on.
What a placeholder counts depends on what surrounds it: little in a code block, little where a sentence explains a syntax or in
a tutorial, in full in running text; discounted ones make residue only where they are dense.

Defined results: null and empty texts are no cases; texts are read whole, however long; repeated rows give repeated
results (one per row); other columns of any name are not touched; an empty table gives an empty result.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("placeholder", "filler", "error", "script")
#: Placeholders per 100 characters from which a text that explains a syntax is residue all the same.
DENSE = 3.0

_NAME = r"[A-Za-z_][\w-]*(?:[. ][A-Za-z_][\w-]*){0,4}"
_UPPER = r"[A-Z][A-Z0-9]*(?:[._ ][A-Z0-9]+)*"
#: One grammar per delimiter.
PLACEHOLDERS = {
    "mustache": rf"\{{\{{[#/^&>]?\s*{_NAME}(?:\s*\|\s*{_NAME})*\s*\}}\}}",
    "dollar": rf"\$\{{\s*{_NAME}\s*\}}",
    "hash": rf"#\{{\s*{_NAME}\s*\}}",
    "tag": rf"\{{%-?\s*{_NAME}[^%{{}}\n]*-?%\}}",
    "erb": rf"<%[=-]?\s*{_NAME}\s*-?%>",
    "printf": rf"%\(\s*{_NAME}\s*\)[sdfr]",
    "angles": rf"<<\s*{_NAME}\s*>>",
    "brackets": rf"\[\[\s*{_NAME}\s*\]\]",
    "underscores": rf"(?<![\w_])__{_UPPER}__(?![\w_])",
    "ats": rf"@@\s*{_UPPER}\s*@@",
    "insert": r"(?i:[\[<{(]\s*(?:please\s+)?(?:insert|enter|fill\s+in|add|type|specify)\s+(?:the\s+|your\s+)?[\w /-]+?(?:\s+here)?\s*[\]>})])",
    "your": r"\[\s*(?:YOUR|Your|IHR|IHRE|IHR\(E\)|Ihr|Ihre|Ihr\(e\))\s+[\w /-]+\]",
    "completed": r"(?i:[\[<(]\s*[\w /-]+?\s*[–—:-]\s*(?:to\s+be\s+(?:completed|filled(?:\s+in)?|confirmed|added|defined)|tb[dac]|noch\s+(?:zu\s+ergänzen|offen))\s*[\])>])",
    "eintragen": r"(?i:[\[<(]\s*(?:hier\s+|bitte\s+)?[\w /-]+?\s+(?:eintragen|einfügen|einsetzen|ergänzen|ausfüllen|angeben)\s*[\])>])",
    "fill_zh": r"[【\[（(<《{]\s*(?:此处|这里|请在此|请)?\s*(?:填写|填入|输入|插入|请填写|请输入|录入)(?:[^\n】\]）)>》}]{1,20}|[^\n。；，,;】\]）)>》}]+)[】\]）)>》}]",
    "pending_zh": r"[【\[（(<《{](?:[^\n【】\[\]（）()<>《》{}]{1,20}|[^\n。；，,;【】\[\]（）()<>《》{}]+)(?:待补充|待填写|待填|待定|待完善|待确认)[】\]）)>》}]",
    "crosses_zh": r"[【\[][^\n【】\[\]]+[】\]]\s*[X×xＸ]{3,}",
    "blank_zh": r"[_＿]{3,}\s*[（(][^\n（）()]+[）)]",
}
#: Characters with which a delimiter can open; the grammars are tried nowhere else.
_OPENS = re.compile(r"[{$#%<\[@_＿【（(《]")
_PLACEHOLDER = re.compile("|".join(PLACEHOLDERS.values()))
#: What a sentence says that explains a syntax instead of leaving it unfilled.
_EXPLAINS = re.compile(
    r"(?i)\b(?:syntax|variable|delimiter|escap\w+|for example|e\.\s?g\.|such as|is written|are written|z\.\s?B\.|zum Beispiel|Schreibweise|heißt|lautet)\b|语法|写作|写成|例如|比如|形如|变量名"
)
_CODE = re.compile(r"```.*?(?:```|\Z)|~~~.*?(?:~~~|\Z)|<(pre|code)\b.*?</\1>|`[^`\n]+`", re.S | re.I)
#: What a placeholder counts where it stands: in running text, in a sentence that explains a syntax, beside such a sentence, in code.
WEIGHTS = {"text": 1.0, "beside": 0.5, "explained": 0.1, "code": 0.02}
#: Share of sentences that explain a syntax from which the whole text is a tutorial, and its placeholders count as explained.
TUTORIAL = 0.3

_THING = r"(?:the |this |that |your |requested |plan |page |site |website |document |file |form |viewer |view |record |content |resource |item |link |url |sheet |data |server |service |application |app |report |entry |connection |request |portal |system ){1,4}"
_DING = r"(?:(?:der|die|das|diese|dieser|dieses|ihre|ihr|angeforderte|gewünschte|aufgerufene) ){1,3}(?:[\w-]+ ){1,2}?"
_ZH_THING = r"(?:抱歉[，,]?|对不起[，,]?|很遗憾[，,]?|您?(?:所)?(?:请求|访问|查找|查看|查询|打开|浏览)的?|该|此|当前|所查|本|目标)?\s*(?:的)?(?:页面|网页|内容|文档|文件|资源|表单|记录|链接|网站|数据|服务|页|信息)"
_END = r"(?:[\s,，;；(（—–:-].{0,60})?[.。!！…]*"

#: Filler: the sentence asks to be replaced or only says that it stands for text.
FILLER = (
    r"lorem ipsum\b.*",
    r"(?:(?:your|the|main|body|sample|dummy|placeholder|some) ){1,3}(?:text|copy|content|paragraph)s? (?:goes|will go|comes|to go|to come) here\b.*",
    r"(?:body|main|page)? ?(?:copy|text|content) (?:to follow|to come|follows later|coming soon|pending)\b.*",
    r"(?:tbd|tba|tbc|todo|fixme)\b(?:\s*[–—:-].{0,80}|.{0,12})",
    r"(?:this is )?(?:a )?(?:sample|dummy|placeholder|filler|example) (?:text|paragraph|copy|content|heading)\b(?:\s*[,;:–—-]?\s*(?:please )?(?:replace|remove|delete|to be replaced|do not publish|only|goes here|here|for layout).*|)",
    r"text text(?: text)*",
    r"(?:xxx+|asdf\w*|foo bar(?: baz)?|test test(?: test)*|abc abc(?: abc)*)",
    r"blindtext(?:\s*[,;:–—-].*|\s+(?:für|zur|bitte|nur|der|in)\b.*|)",
    r"(?:muster|platzhalter|beispiel|füll)text(?:\s*[,;:–—-].*|\s+(?:bitte|für|zum|nur)\b.*|)",
    r"hier (?:steht|kommt|folgt|erscheint) (?:später |noch |demnächst |bald )?(?:ihr|der|dein|ein|noch|unser) .{0,40}(?:text|inhalt)\b.*",
    r"(?:text|inhalt) folgt(?: (?:in kürze|noch|später))?",
    r"(?:这里|此处|此段|本段|以下|这|此)(?:是|为)?.{0,8}(?:占位|示例|测试|样例|填充|排版)[^，,。]{0,8}(?:内容|文字|文本|文|段落)?(?:[，,].{0,10}(?:替换|删除|忽略|修改))?",
    r"(?:(?:示例|样例|占位|测试|填充|样板)(?:文字|文本|内容|段落)){1,20}(?:[，,].{0,10}(?:替换|删除|忽略))?",
    r"(?:此处|该处|本节|正文|内容|文字|详情|具体内容)?(?:内容|文字|正文)?(?:待补充|待完善|待填写|待添加|待更新|有待补充|暂缺)",
)
#: Errors: the sentence is the message of a server or a program.
ERRORS = (
    r"(?:http )?(?:status |error |fehler |错误 ?)?(?:code )?[45]\d\d\s*[–—:-]?\s*(?:not found|bad gateway|bad request|forbidden|unauthorized|internal server error|service (?:temporarily )?unavailable|gateway time-?out|method not allowed|gone|too many requests|seite nicht gefunden|抱歉|页面|对不起|服务|错误|禁止|未找到)" + r".{0,60}",
    r"http status [45]\d\d\b.*",
    r"(?:internal server error|bad gateway|service (?:temporarily )?unavailable|gateway time-?out|page not found|file not found|not found|forbidden|unauthorized)" + _END,
    _THING + r"(?:could not|cannot|can ?not|can't|couldn't|did not|does not|didn't|doesn't|is not|isn't|failed to|was not|has not) (?:be )?(?:found|loaded?|rendered?|displayed?|shown?|opened?|reached?|respond|available|exist|processed|retrieved|working|completed)\b.{0,60}",
    r"(?:(?:the|this|that|your|our) )?(?:[\w-]+ ){0,3}(?:could not|cannot|can't|couldn't|failed to) (?:be )?(?:found|load|loaded|rendered|displayed|shown|opened|reached|processed|retrieved)(?: (?:on this server|right now|at this time|at the moment|in time))?(?: \(error \w+\))?",
    r"(?:(?:the|this|that|your|our) )?(?:[\w-]+ ){0,3}(?:is no longer (?:available|here)|(?:was|were|has been) (?:moved|removed|deleted)(?: or (?:moved|removed|deleted))?)(?: on this server)?(?: \(error \w+\))?",
    r"the (?:page|document|file|resource) you (?:asked for|requested|are looking for|were looking for|tried to)\b.*",
    r"(?:access|permission) (?:to .{0,40} )?(?:denied|forbidden|refused)" + _END,
    r"you (?:do not|don't) have (?:the )?(?:permission|access|rights?|authori[sz]ation)\b.*",
    r"your session (?:has )?(?:expired|timed out|ended)\b.*",
    r"too many requests" + _END,
    r"(?:an? )?(?:unexpected |unknown |internal |fatal |server )?error (?:occurred|has occurred|establishing|connecting|loading|processing)\b.*",
    r"(?:sorry|oops|whoops)[,!.]? .{0,30}(?:something went wrong|error|not found|unavailable)\b.*",
    r"something went wrong\b.*",
    r"we(?: are|'re) (?:currently )?(?:down for|undergoing|performing) (?:scheduled |routine |planned )?maintenance\b.*",
    r"(?:site|service|system|website) (?:is )?(?:under|down for|in) (?:scheduled )?maintenance\b.*",
    r"(?:the )?connection (?:to .{0,30} )?(?:was|has been) (?:reset|refused|closed|interrupted|lost|timed out)\b.*",
    r"(?:please )?(?:slow down and retry|try again (?:later|in a few)|please sign in again|please log ?in again)\b.*",
    r"checking your browser\b.*",
    r"(?:verify|confirm) (?:that )?you are (?:a )?human\b.*",
    r"traceback \(most recent call last\).*",
    r"(?:exception in thread|caused by:|unhandled exception|stack trace:|fatal error:|type: exception report).*",
    r"(?:[a-z_]\w*\.)*[A-Za-z_]\w*(?:Error|Exception)(?::\s.{0,120}|)",
    r"\s*file \".{1,120}\", line \d+, in \S+",
    r"at [\w$.]+\.[\w$<>]+\([\w$]+\.(?:java|kt|scala):\d+\)",
    r"\{\s*\"(?:code|status|error|errno|statusCode)\"\s*:\s*(?:[45]\d\d|\"?error\"?|\"[^\"]{0,60}error[^\"]{0,60}\")\s*,.{0,300}",
    r"fehler \d{3}\b.*",
    r"(?:interner )?serverfehler\b.*",
    r"(?:es ist )?ein (?:interner |unerwarteter |unbekannter )?fehler (?:ist )?(?:aufgetreten|entstanden)\b.*",
    r"(?:" + _DING + r")(?:konnten? nicht .{0,30}werden|(?:wurden?|ist) nicht gefunden(?: worden)?|(?:ist|sind) (?:derzeit |leider |zurzeit |momentan )?nicht (?:mehr )?(?:verfügbar|erreichbar|vorhanden))" + _END,
    r"seite nicht (?:gefunden|verfügbar|erreichbar)\b.*",
    r"(?:zugriff|zugang) (?:verweigert|nicht erlaubt|gesperrt)\b.*",
    r"(?:ihre )?(?:sitzung|anmeldung) (?:ist )?abgelaufen\b.*",
    r"(?:zu viele anfragen|wartungsarbeiten)\b.{0,60}",
    r"(?:http)?(?:错误|状态码?|error)?\s*[45]\d\d\s*[:：–—-]?\s*(?:抱歉|页面|对不起|服务器|错误|禁止|未找到|访问).{0,40}",
    r"(?:抱歉|对不起|很遗憾)?[，,]?\s*" + _ZH_THING + r"(?:暂时|已经|已|正在)?(?:不存在|无法(?:显示|访问|打开|加载|找到)|加载失败|响应超时|已下线|下线|已(?:被)?删除|未找到|找不到|走丢了|打不开|出错|维护中).{0,30}",
    r"(?:该|本|此)?(?:内部)?(?:服务器|系统|网络|数据库)(?:内部)?(?:错误|繁忙|异常|维护中|连接失败|连接超时|出错|开小差|升级中|无响应)(?:[，,（(].{0,30})?",
    r"(?:您)?(?:没有|无)(?:访问|查看)?权限(?:访问|查看|打开)?.{0,20}",
    r"(?:访问|请求)(?:被拒绝|被禁止|过于频繁|超时|失败).{0,30}",
    r"操作(?:过于频繁|失败|超时).{0,30}",
    r"(?:登录|会话|登陆)(?:已)?(?:超时|过期|失效).{0,30}",
    r"[（(]?(?:错误码|错误代码|请求编号|追踪号)[:： ]*[\w-]{1,40}[）)]?",
)
#: Scripts: the sentence tells the reader to allow scripts, or that nothing shows without them.
SCRIPTS = (
    r"(?:please |kindly )?(?:enable|activate|turn on|switch on|allow) (?:java ?script|scripts?|scripting|cookies)\b.{0,80}",
    r"(?:you (?:need|have) to|you must|to (?:view|use|continue|run)\b.{0,50}(?:please )?)\s*(?:enable|turn on|activate|allow|switch on) (?:java ?script|scripts?|scripting|cookies)\b.{0,80}",
    r"(?:java ?script|scripts?|scripting|cookies)(?: and (?:java ?script|scripts?|cookies))? (?:is|are|seems?|appears?|must|has|have|needs?)(?: to)?(?: be)? (?:disabled|required|turned off|switched off|blocked|allowed|enabled|not (?:enabled|available|supported)|off)\b.{0,80}",
    r"(?:we're sorry,? but |sorry,? )?(?:this|the|our) (?:\w+ ){1,3}(?:does not|doesn't|will not|won't|cannot|can't) (?:work|run|function|load|be displayed|be shown)(?: properly| correctly)? without (?:java ?script|scripts?|scripting|cookies)\b.{0,60}",
    r"(?:this|the|our) (?:\w+ ){1,3}(?:requires?|needs?) (?:java ?script|scripts?|cookies)\b.{0,60}",
    r"noscript\b.{0,100}",
    r"(?:your )?browser (?:does not support|has disabled|blocks?) (?:java ?script|scripts?)\b.{0,60}",
    r"(?:bitte )?(?:aktivieren|erlauben|schalten) sie (?:bitte )?(?:java ?script|skripte?|scripting|cookies)\b.{0,80}",
    r"(?:java ?script|skripte?)(?: und cookies)? (?:ist|sind|muss|müssen|wurden?|wird)\b.{0,30}(?:deaktiviert|ausgeschaltet|blockiert|erforderlich|aktiviert|erlaubt|nötig|benötigt)\b.{0,40}",
    r"(?:zum|zur|um) .{0,50}(?:muss|müssen) (?:java ?script|skripte?)\b.{0,40}",
    r"ohne (?:aktives |aktiviertes |aktivierte )?(?:java ?script|skripting|scripting|skripte)\b.{0,60}(?:nicht|kein)\b.{0,40}",
    r"(?:diese|dieses|die|das) [\w-]+ (?:benötigt|erfordert|braucht) (?:java ?script|skripte)\b.{0,40}",
    r"(?:请|您?需要?|须|必须)(?:先)?(?:在浏览器中)?(?:启用|开启|打开|允许|激活)\s*(?:java ?script|脚本|js|cookie).{0,30}",
    r"(?:您的|当前|你的)?浏览器(?:已)?(?:禁用|关闭|不支持|拦截|屏蔽)了?\s*(?:java ?script|脚本|js).{0,30}",
    r"(?:检测到|发现)?(?:java ?script|脚本|js)(?:已)?(?:被)?(?:拦截|禁用|关闭|屏蔽).{0,30}",
    r"(?:本|该|此)(?:系统|页面|网站|页|应用|站点)(?:需要?|须|要求)(?:开启|启用|打开|允许|使用)?\s*(?:java ?script|脚本|js).{0,30}",
)


_KINDS_OF_SENTENCE = [("filler", p) for p in FILLER] + [("error", p) for p in ERRORS] + [("script", p) for p in SCRIPTS]
_TAIL = r")\s*[.。!！…?？]*\s*\Z"
_SPLIT = re.compile(r"(?<=[。！？!?])|(?<=[.…])(?=\s)|[\n\r\v\f\t\u2028\u2029\u0085]+")


class Grammar:
    """The sentence grammars as one table: by the first character of a sentence, those that can begin with it.

    Which ones can is asked of the grammars themselves (a partial match of that character), once a character.
    """

    def __init__(self, rules: list[tuple[str, str]]):
        self.rules = rules
        self.by_first: dict[str, tuple[tuple[str, re.Pattern], ...]] = {}
        self.compiled: dict[tuple[str, tuple[int, ...]], re.Pattern] = {}
        try:
            import regex

            self.begins = [regex.compile("(?:" + p + _TAIL, regex.I | regex.S) for _, p in rules]
        except ImportError:
            self.begins = None

    def _rules_for(self, c: str) -> tuple[tuple[str, re.Pattern], ...]:
        able = [i for i in range(len(self.rules)) if self.begins is None or self.begins[i].match(c, partial=True)]
        out = []
        for kind in dict.fromkeys(k for k, _ in self.rules):
            own = tuple(i for i in able if self.rules[i][0] == kind)
            if own:
                if (kind, own) not in self.compiled:
                    self.compiled[kind, own] = re.compile("(?:" + "|".join(f"(?:{self.rules[i][1]})" for i in own) + _TAIL, re.I | re.S)
                out.append((kind, self.compiled[kind, own]))
        return tuple(out)

    def kind(self, sentence: str) -> str | None:
        """The kind of which the whole sentence is, from its first character to its last."""
        first = sentence[:1]
        if (rules := self.by_first.get(first)) is None:
            if len(self.by_first) > 100_000:
                self.by_first.clear()
            rules = self.by_first[first] = self._rules_for(first)
        for kind, pattern in rules:
            if pattern.match(sentence):
                return kind
        return None


_GRAMMAR = Grammar(_KINDS_OF_SENTENCE)
#: A label before the sentence: a list mark, a heading mark, question and answer marks.
_LABEL = re.compile(r"^\s*(?:[-*•#>]+\s*|\(?[a-z0-9一二三四五六七八九十]{1,3}[.)、）]\s*|(?:q|a|frage|antwort|问|答)\s*[:：]\s*|\d+(?:\.\d+)*\s+(?=[^\d\s]))*", re.I)
_SENTENCE_END = re.compile(r"(?<=[。！？!?\n])(?!\Z)|(?<=[.…])(?=\s)")
_CODE_MARK = re.compile(r"`|~~~|<(?:pre|code)\b", re.I)
_PSEUDO = re.compile(r"(?i)\blorem ipsum\b")
#: A run of words without digits, capitals or marks, long enough to be judged as pseudo-Latin.
_WORDS = re.compile(r"(?<![a-z])[A-Z]?[a-z]++(?: [a-z]++){8,}+")
#: Words without which hardly any sentence of nine words or more gets along in languages written with plain letters.
_FUNCTION_WORDS = frozenset(
    "the of and to in is for on with at by from or that as are be was it this an not a has have its will may if "
    "der die das und ist nicht mit von zu den dem des im ein eine einer auf sich auch als bei oder wenn wird sind aus nach es an "
    "le la les et des une un du est dans pour que qui par sur au avec ou de el los las y una en por con para se del al "
    "il lo gli che di della e per non sono o os as um uma do da em no na het een van te dat op zijn voor met".split()
)


_HIDDEN = re.compile(r"[\u00ad\u200b-\u200f\u2060\ufeff]+")
_SPACES = re.compile(r"[\u00a0\u2000-\u200a\u202f\u205f\u3000]")
#: Letters of scripts other than Latin and ideographs, pictures, full-width letters and digits.
_FOREIGN = re.compile(r"[^\u0000-\u024f\u2000-\u206f\u3000-\u303f\u4e00-\u9fff\uff00-\uff0f\uff1a-\uff20\uff3b-\uff40\uff5b-\uff5e]+")


def normal(text: str) -> str:
    """The text without invisible characters, with one kind of space."""
    return text if text.isascii() else _SPACES.sub(" ", _HIDDEN.sub("", text))


def _without_foreign(text: str) -> str:
    """The text without short runs of letters of a foreign script or of pictures, which break sentences of the main scripts."""
    return text if text.isascii() else _FOREIGN.sub("", text)


def placeholders(text: str) -> list[tuple[int, int]]:
    """(begin, end) of each placeholder, by the grammar of the delimiter that opens there."""
    out, end = [], 0
    for o in _OPENS.finditer(text):
        if o.start() >= end and (m := _PLACEHOLDER.match(text, o.start())):
            end = m.end()
            out.append((m.start(), end))
    return out


def unfilled(text: str, code: list[tuple[int, int]]) -> bool:
    """Whether the text holds placeholders that stand for content: one that counts in full, or several that together are dense.

    A placeholder is discounted in code, in a sentence that explains a syntax, beside such a sentence (above all in the lines
    that follow a colon), and in a text of which a good part explains a syntax.
    """
    hits = placeholders(text)
    if not hits:
        return False
    ends = [m.start() for m in _SENTENCE_END.finditer(text)] + [len(text)]
    spans = list(zip([0, *(e for e in ends[:-1])], ends))
    explains = [bool(_EXPLAINS.search(text, a, b)) for a, b in spans]
    tutorial = sum(explains) / len(spans) >= TUTORIAL and len(spans) > 2
    full, dense = False, 0.0
    for a, b in hits:
        k = bisect.bisect_right(ends, a)
        if any(x <= a < y for x, y in code):
            where = "code"
        elif explains[k] or tutorial:
            where = "explained"
        elif k and explains[k - 1] and text[: spans[k][0]].rstrip()[-1:] in ":：":
            where = "beside"
        else:
            where = "text"
        full |= where == "text"
        dense += WEIGHTS["code"] if where == "code" else 1.0
    return full or 100 * dense / max(1, len(text)) >= DENSE


def pseudo_latin(run: str) -> bool:
    """Whether a run of nine words or more holds no function word and repeats words, as dictated filler does."""
    words = run.lower().split(" ")
    return _FUNCTION_WORDS.isdisjoint(words) and len(set(words)) < len(words)


def kinds_of(text: str | None) -> tuple[set[str], float]:
    """The kinds of residue in the text, and the share of its sentences that are residue. Messages within code are no messages of the text."""
    found: set[str] = set()
    if not text:
        return found, 0.0
    t = normal(text)
    code = [m.span() for m in _CODE.finditer(t)] if _CODE_MARK.search(t) else []
    if unfilled(t, code):
        found.add("placeholder")
    if code:
        t = _CODE.sub(" ", t)
    bad = total = 0
    seen: set[str] = set()
    for form in {t, _without_foreign(t)}:
        for s in _SPLIT.split(form):
            if not s or len(s := s.strip()) < 2:
                continue
            total += 1
            if s in seen:
                continue
            seen.add(s)
            kind = _GRAMMAR.kind(s)
            if kind is None and (x := _LABEL.sub("", s)) and x != s:
                kind = _GRAMMAR.kind(x)
            if kind:
                found.add(kind)
                bad += 1
    if _PSEUDO.search(t) or any(pseudo_latin(m.group()) for m in _WORDS.finditer(t)):
        found.add("filler")
    return found, bad / max(1, total)


def find_residue(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, kinds, share): the rows whose text is residue, wholly or in part. No shuffle."""
    source = df.select(F.col(f"`{key}`").alias("k"), F.col(f"`{text}`").alias("t")).where("length(t) > 0")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, kinds, shares = [], [], []
            for i, t in enumerate(b.column(1).to_pylist()):
                found, share = kinds_of(t)
                if found:
                    rows.append(i)
                    kinds.append([k for k in KINDS if k in found])
                    shares.append(share)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows, pa.int64())), pa.array(kinds, pa.list_(pa.string())), pa.array(shares, pa.float64())], ["k", "kinds", "share"])

    kind = source.schema["k"].dataType.simpleString()
    return source.mapInArrow(run, f"k {kind}, kinds array<string>, share double").select(F.col("k").alias(key), "kinds", "share")


def without_residue(df: DataFrame, key: str, text: str) -> DataFrame:
    """The rows of df that are no cases; a null key keeps its row. The join is on the key, found rows being few."""
    bad = find_residue(df, key, text).select(F.col(key).alias("_bad")).distinct()
    return df.join(bad, F.col(f"`{key}`") == F.col("_bad"), "left_anti")
