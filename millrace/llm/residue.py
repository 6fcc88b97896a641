"""Template residue and error-page text.

Lines are counted by host; a line that most of a host's documents carry is boilerplate
and is subtracted. A document is residue if what is left shows an unfilled placeholder,
filler, an unfinished-work mark, an error page, a notice that scripts or cookies are
required, or another notice in place of content. The first four are no part of a site's
furniture and count in boilerplate too. A document that consists of boilerplate alone is
judged as a whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Marks and phrases of residue, by kind. All match lower-case text.
FIELD = (
    r"(?:기관 ?명|부서 ?명|회사 ?명|업체 ?명|사업장 ?명|시설 ?명|학교 ?명|담당자(?: ?명)?|책임자|작성자|연락처|전화 ?번호|이메일|메일 ?주소|날짜|일자|일시|시간|지역(?: ?명)?|장소|주소"
    r"|재난 ?유형|재난 ?명|사고 ?유형|유형|이름|성명|직책|제목|내용|본문|문서 ?번호|번호|금액|수량|링크|url|name|date|time|title|phone|email|address|company|organization|region|site|user|agency)"
)
PLACEHOLDER = "|".join(
    (
        r"\{\{[^{}\n]*\}\}",
        r"\{%[^%\n]+%\}",
        r"<%[=-]?[^%\n]+%>",
        r"[$#]\{[^{}\n,]+\}",
        r"\[\[[^\[\]\n,]+\]\]",
        r"@@[^@\s]+@@",
        r"(?<![\p{L}\p{N}%])%{1,2}[a-z][a-z_]{2,}%{1,2}(?![\p{L}\p{N}%])",
        r"%\([a-z_][a-z0-9_]*\)[sdifr]",
        r"(?<![\p{L}\p{N}_])__[a-z][a-z_]+__",
        r"[<\[{](?:insert|enter|your|add)[ _][^<>\[\]{}\n]+[>\]}]",
        r"[\[{<](?:first|last|full|user|customer|company|product)[ _-](?:name|date|id|email|address|number)[\]}>]",
        r"\{[a-z][a-z0-9_]+\}",
        rf"«\s?(?:{FIELD}|[a-z]+_[a-z_]+)\s?»",
        rf"(?:\[|<|\{{|&lt;|【|〔|《)\s?{FIELD}(?: ?(?:입력|기재|작성|삽입|선택|란))?\s?(?:\]|>|\}}|&gt;|】|〕|》)",
        r"[\[<({][^\[\]<>(){}\n]+ (?:입력|기재|삽입|기입)[\]>)}]",
        rf"[○◯□△◇_＿]{{2,}} ?{FIELD}",
        r"\[object object\]",
        r"(?<![a-z_.'\"])undefined(?![a-z_('\"])",
    )
)
FILLER = "|".join(
    (
        r"lorem ipsum|dolor sit amet|consectetur adipi",
        r"(?:^|\n)[ \t]*(\S+)(?:[ \t]+\1){2,}[ \t]*(?:\n|$)",
        r"테스트 ?(?:글|문서|게시물|입니다|용)(?: 테스트|입니다|\s*$|\n)",
        r"asdf ?(?:asdf|qwer|zxcv|jkl)|qwer ?(?:asdf|qwer|ty)",
        r"가나다라마바사",
        r"(?:샘플|예시|견본|더미|임시) ?(?:문구|텍스트|글|본문|내용)(?:입니다|\.|\s*$)",
        r"(?:본문|내용|제목|부제|텍스트|글|설명|문구)(?:을|를) ?(?:여기에 ?)?(?:입력|작성|추가)(?:하세요|하십시오|해 ?주|해주)",
        r"실제 내용으로 (?:바꾸|교체|대체)",
        r"click (?:here )?to (?:add|edit)|(?:sample|dummy|placeholder|filler) text|your (?:text|content) (?:goes )?here",
    )
)
UNFINISHED = "|".join(
    (
        r"(?<![a-z])(?:todo|fixme|tbd|tbc|xxx)(?![a-z])",
        r"[(\[<](?:[^()\[\]<>\s]+ ){0,4}(?:작성|추가|보완|수정|입력|업데이트|게시|등록|추후 ?작성) ?(?:예정|중|필요|요망)[)\]>]",
        r"(?:내용|본문|페이지)(?:을|를|은|는)? ?준비 ?중(?:입니다)?|작성 ?중인 (?:문서|글|페이지)",
        r"coming soon|under construction|work in progress|to be (?:written|completed|determined|added)",
    )
)
ERROR = "|".join(
    (
        r"(?:^|\n|[>.] ?)\W{0,3}(?:http[ /\d.]{0,6})?\d{3}[ :-]{1,3}(?:forbidden|not found|bad gateway|bad request|service (?:temporarily )?unavailable|internal server error|gateway time-?out|request time-?out|unauthorized|too many requests|moved|gone|conflict|not acceptable|not implemented|not allowed|method not allowed|payment required)",
        r"traceback \(most recent call last\)|(?:^|\n)\s*at [a-z_$][\w.$]*\([\w.]*:\d+\)|(?:^|\n)[a-z_.]*(?:error|exception): ",
        r"upstream connect error|request was blocked|could not handle the request|(?:server|application) error|segmentation fault|stack trace:|fatal error:",
        r"<title>[^<]*(?:error|denied|forbidden|not found|오류|안내|차단)[^<]*</title>",
        r"(?:오류|에러) ?(?:코드|번호) ?[:#]? ?\d+",
        r"(?:페이지|문서|파일|게시물|자료)(?:를|을|가|이)? ?(?:찾을 수 없|존재하지 않|열 수 없)|존재하지 않는 (?:게시물|페이지|문서|글)|삭제된 (?:글|게시물|페이지|문서)",
        r"비정상적인? ?(?:요청|접근)|잘못된 (?:접근|요청)|데이터베이스에 연결할 수|여는 중 문제가 발생",
        r"page (?:you requested )?(?:was |could )?not (?:be )?found|this page (?:does not|doesn't|isn't) (?:exist|available)",
        r"^\s*(?:error |http[ /\d.]*)?[45]\d\d(?: (?:page|error))?\s*(?:\n|$)|backend fetch failed|connection timed out\s*(?:\n|$)",
        r"(?:ページ|ファイル|記事)(?:は|が)?(?:見つかりません|存在しません|削除され)|(?:页面|頁面|网页|網頁|文件)(?:不存在|未找到|无法访问|找不到)|找不到(?:该|此|您|这个)?(?:页面|頁面|网页|文件)",
        r"страница не (?:найдена|существует)|không tìm thấy trang|trang (?:này )?không tồn tại|página no (?:encontrada|existe)|page (?:introuvable|non trouvée)|seite (?:wurde )?nicht gefunden",
    )
)
SCRIPT = "|".join(
    (
        r"(?:enable|turn on|activate|switch on|allow|requires?|needs?|without) (?:your )?(?:java ?scripts?|scripts?|cookies)(?: (?:to|in|and|for)|[.,]|\s*$)",
        r"(?:java ?scripts?|cookies) (?:must|should|need|is (?:required|disabled)|are (?:required|disabled|turned off)|has to|have to)",
        r"(?:자바 ?)?스크립트(?:를|을|가|이)? ?(?:켜|꺼져|활성|허용|사용(?:할 수 있|하도록)|실행(?:을|이)? ?(?:허용|필요|되지)|비활성|차단|지원하지)",
        r"쿠키(?:를|을|가|이)? ?(?:설정|허용|켜|꺼져|활성|차단|사용하도록)",
        r"javascriptを(?:有効|オン)|(?:启用|開啟|打开|啟用) ?(?:javascript|cookie)|bật (?:javascript|cookie)|(?:active|habilite|activar|habilitar) (?:javascript|las cookies)",
    )
)
NOTICE = "|".join(
    (
        r"로그인 ?(?:후|하신 ?후|한 ?뒤|하셔야|이 ?필요|하세요|하십시오|해 ?주)",
        r"(?:접근|열람|조회|이용)(?:할|하실)? ?권한이? ?없|권한이 없습니다|접근이? ?(?:거부|제한|차단)되",
        r"로봇이 아(?:님|닙|닌)|자동 ?(?:입력|등록) ?방지|보안 ?문자를 ?입력",
        r"접속자가 많|대기 ?순번|접속 ?대기|잠시만 ?기다려 ?주|잠시 ?후 ?(?:다시|재) ?시도|(?:서비스|시스템|서버|사이트|홈페이지) ?(?:점검|작업|준비) ?중",
        r"세션이? ?만료|이전 ?화면으로 ?돌아가|주소를 다시 확인",
        r"verify (?:that )?you(?:'| a)re (?:a )?human|checking your browser|are you a robot|not a robot|captcha|unusual traffic|(?:just|one) moment(?: please)?\.\.\.|please wait",
        r"access (?:is )?denied|(?:please|must|need to) (?:log|sign) ?in|session (?:has )?expired|subscribe to (?:read|continue)|too many requests",
    )
)
#: Words quoted by a text that speaks about them; no evidence.
MENTION = "|".join(
    (
        r"['\"‘’“”「『][^'\"‘’“”」』\n]+['\"’”」』] ?(?:이?라[는고]|란 |문구|메시지|글|표시|화면|창)",
        r"(?:message|text|words?|sign|notice|note|title|reading|says?|said|shows?|reads?|called|saying) ?[:,]? ['\"‘“][^'\"‘’“”\n]+['\"’”]",
    )
)
#: Short strings of which every document with evidence holds one at least, or matches RARE, or START at its start.
STEMS = (
    "{", "<", "[", "@@", "__", "%(", "«", "undefined", "&lt;", "【", "〔", "《",
    "lorem", "dolor sit", "consectetur", "테스트", "asdf", "qwer", "가나다라마", "샘플", "견본", "더미", "을 입력", "를 입력", "을 여기", "를 여기", "을 작성", "를 작성", "을 추가", "를 추가", "실제 내용",
    "여기에", "기재", "입력", "삽입", "기입",
    "click", "sample text", "dummy", "placeholder", "filler", "goes here", "your text", "your content",
    "todo", "fixme", "tbd", "tbc", "xxx", "준비중", "준비 중", "작성중인", "작성 중인", "coming soon", "under construction", "in progress", "to be ",
    "forbidden", "not found", "gateway", "bad request", "unavailable", "server error", "time-out", "timeout", "unauthorized", "too many", "moved", "gone", "conflict", "not acceptable", "not implemented", "not allowed", "payment required",
    "traceback", "error", "exception", " at ", "\tat ", "blocked", "handle the request", "fault", "stack trace", "this page", "page you",
    "오류", "에러", "존재하지", "삭제된", "비정상", "잘못된", "데이터베이스", "여는 중", "찾을 수 없", "열 수 없",
    "script", "스크립트", "cookie", "쿠키",
    "로그인", "권한", "거부되", "제한되", "차단되", "로봇이", "방지", "보안", "접속자", "대기 순", "대기순", "접속대기", "접속 대기", "잠시", "점검 중", "점검중", "작업 중", "작업중", "만료", "화면으로 돌아", "화면으로돌아", "주소를 다시",
    "fetch failed", "timed out", "ページ", "ファイル", "記事", "页面", "頁面", "网页", "網頁", "文件", "страница", "trang", "página", "page ", "seite ",
    "verify", "checking your", "robot", "captcha", "traffic", "moment", "please wait", "denied", "sign in", "log in", "signin", "login", "session", "subscribe to",
    *(x + y for x in "○◯□△◇_＿" for y in "○◯□△◇_＿"),
    *(x + y for x in ("예정", "중", "필요", "요망") for y in ")]>"),
    *(x + y for x in ("을", "를") for y in ("작성", "추가")),
    *(x + z + y for x in ("예시", "임시") for z in ("", " ") for y in ("문구", "텍스트", "글", "본문", "내용")),
)
RARE = r"%[a-z][a-z_]{2,}%"
START = r"\s*(?:at [a-z_$]|(?:error |http[ /\d.]*)?[45]\d\d(?:\s|$))"
# End of the fixed values.

KINDS = {
    "placeholder": PLACEHOLDER,
    "filler": FILLER,
    "unfinished": UNFINISHED,
    "error_page": ERROR,
    "script_required": SCRIPT,
    "notice": NOTICE,
}
#: Kinds that are evidence however many of a host's documents carry them.
ALWAYS = ("placeholder", "filler", "unfinished", "error_page")


def _kinds(low: Column) -> Column:
    return F.filter(F.array(*[F.when(low.rlike(p), F.lit(k)) for k, p in KINDS.items()]), lambda x: x.isNotNull())


@lru_cache(maxsize=1)
def _stems():
    import ahocorasick

    automaton = ahocorasick.Automaton()
    for stem in STEMS:
        automaton.add_word(stem, stem)
    automaton.make_automaton()
    return automaton


_rare, _start = re.compile(RARE), re.compile(START)


def _may_hold(text: str | None) -> bool:
    if not text:
        return False
    low = text.lower()
    if next(_stems().iter(low), None) is not None or _rare.search(low) or _start.match(low):
        return True
    return any(len(w := line.split()) > 2 and len(set(w)) == 1 for line in low.splitlines())


_mention = re.compile(MENTION)


@F.pandas_udf(T.StringType())
def suspected(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """The text in lower case and without mentions where it may hold evidence, else null.

    One automaton over all stems reads a text once; a hundred searches by Catalyst cost
    twenty times as much. The expensive patterns then see a tenth of the texts.
    """
    for part in parts:
        yield pd.Series([_mention.sub(" ", t.lower()) if _may_hold(t) else None for t in part], dtype=object)


def evidence(text: Column) -> Column:
    """Kinds of residue in the text, as an array in the order of KINDS; null counts as empty."""
    return F.coalesce(_kinds(suspected(text)), F.array().cast("array<string>"))


def _line(text: Column) -> Column:
    return F.explode(F.array_distinct(F.transform(F.split(F.lower(text), r"\R"), lambda x: F.regexp_replace(x, r"[\s\d]+", " "))))


def boilerplate(docs: DataFrame, host: str, text: str, least_docs: int = 1, least_share: float = 0.5) -> DataFrame:
    """(host, line hash) of the normalised lines in more than a share of a host's documents.

    The share alone decides, so that equal proportions give equal results at any size; a
    caller may ask for a number of documents besides.
    """
    filled = docs.filter(F.col(text).isNotNull()).select(F.coalesce(F.col(host), F.lit("")).alias("host"), F.col(text).alias("t"))
    total = filled.groupBy("host").agg(F.count("*").alias("n_docs"))
    lines = filled.select("host", _line(F.col("t")).alias("line")).select("host", F.xxhash64("line").alias("line"))
    often = lines.groupBy("host", "line").agg(F.count("*").alias("n")).filter(F.col("n") >= least_docs)
    return often.join(total, "host").filter(F.col("n") > least_share * F.col("n_docs")).select("host", "line")


def residue_documents(docs: DataFrame, key: str, host: str, text: str, least_docs: int = 1, least_share: float = 0.5) -> DataFrame:
    """(key, kinds): documents whose text, less their host's boilerplate, shows residue, or
    whose boilerplate shows residue of the kinds in ALWAYS.

    Null and empty texts show none. A null host is a host of its own. Repeated texts are
    judged each; a key that comes more than once comes out once. Other columns are ignored.
    """
    # The patterns read what the automaton gives, so that Spark cannot move them before it.
    held = docs.select(F.col(key).alias("_k"), F.coalesce(F.col(host), F.lit("")).alias("host"), F.col(text).alias("_x"), suspected(F.col(text)).alias("_low"))
    hits = held.filter("_low is not null").withColumn("_seen", _kinds(F.col("_low"))).filter("size(_seen) > 0")
    lines = hits.select(
        "_k", "host", "_seen", F.md5("_x").alias("_h"), F.posexplode(F.split("_x", r"\R")).alias("_p", "_l")
    ).withColumn("line", F.xxhash64(F.regexp_replace(F.lower("_l"), r"[\s\d]+", " ")))
    common = boilerplate(docs, host, text, least_docs, least_share).withColumn("_common", F.lit(True))
    left = (
        lines.join(common, ["host", "line"], "left")
        .groupBy("_k", "_h")
        .agg(
            F.first("_seen").alias("_seen"),
            F.array_join(
                F.transform(F.sort_array(F.collect_list(F.when(F.col("_common").isNull(), F.struct("_p", "_l")))), lambda x: x["_l"]), "\n"
            ).alias("_rest"),
        )
        .withColumn("_sure", F.filter("_seen", lambda k: k.isin(*ALWAYS)))
        .withColumn("kinds", F.when(F.col("_rest").rlike(r"[\p{L}\p{N}]"), F.concat("_sure", evidence(F.col("_rest")))).otherwise(F.col("_seen")))
    )
    return left.filter("size(kinds) > 0").groupBy(F.col("_k").alias(key)).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("kinds")))).alias("kinds"))
