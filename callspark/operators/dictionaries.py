"""Default rule dictionaries of a Korean telecom contact centre. All are fixed values; every operator takes others."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Teams (id, name, time to answer, priority).
TEAMS = (
    ("legal", "법무·분쟁 대응팀", "4시간 내 1차 회신", "P1"),
    ("retention", "리텐션(해지 방어)팀", "당일 내 접촉", "P1"),
    ("billing", "요금정산팀", "영업일 1일 내 확인 회신", "P2"),
    ("planAdvice", "요금 상담팀", "영업일 1일 내 안내", "P3"),
    ("network", "네트워크 품질팀", "영업일 2일 내 현장 확인", "P2"),
    ("install", "설치·이전 지원팀", "영업일 1일 내 일정 안내", "P3"),
    ("compensation", "보상 심의팀", "영업일 3일 내 심의 결과 회신", "P2"),
    ("vas", "부가서비스팀", "영업일 1일 내 처리", "P3"),
    ("sales", "영업 지원팀", "영업일 1일 내 안내", "P3"),
    ("onboarding", "가입 지원팀", "영업일 1일 내 안내", "P3"),
    ("quality", "QA · 교육팀", "주간 코칭에 반영", "P3"),
    ("general", "고객지원 2선", "영업일 1일 내 회신", "P3"),
)

# Outside agencies, legal action, media.
ESCALATION_TERMS = ("방송통신위원회", "방통위", "소비자원", "소비자보호원", "국민신문고", "소송", "고소", "고발", "법적", "변호사", "손해배상", "언론", "제보", "기사화")
ESCALATION = "|".join(ESCALATION_TERMS)

# Causes (id, label, team, patterns), in order of priority.
THEMES = (
    ("speed", "인터넷 속도 저하·끊김", "network", (r"속도(가|는)?\s*(느|안|저하)", "느려", "끊[기겨김]", r"접속(이)?\s*안\s*(되|돼)", r"인터넷(이)?\s*안\s*(되|돼)")),
    ("overcharge", "요금 과다 청구", "billing", (r"요금이\s*왜", "과다", r"많이\s*나[왔온]", r"더\s*나[왔온]", r"청구(가|된)?\s*(이상|잘못)", "사기")),
    ("roaming", "해외 로밍 요금", "billing", ("로밍", r"해외\s*(데이터|요금)")),
    ("penalty", "위약금·할인반환금", "retention", ("위약금", "할인반환금", r"약정(이)?\s*(남|끝)")),
    ("churn", "해지·번호이동 의사", "retention", (r"해지(하려|할|해\s*주)", "번호이동", r"다른\s*회사", r"끊을?\s*거")),
    ("plan", "요금제 변경·비용 절감", "planAdvice", (r"요금제(를)?\s*(바꾸|변경|줄)", r"비싼\s*것?\s*같", r"싼\s*걸로", r"데이터를?\s*많이\s*안")),
    ("billing_date", "납부일·자동이체 변경", "billing", ("자동이체", "납부(일|날짜)", "출금(일|날짜)", "월급날")),
    ("micropay", "소액결제 차단·환불", "vas", ("소액결제", r"게임\s*결제", r"결제가\s*자꾸")),
    ("bundle", "결합할인·가족결합", "sales", ("결합", r"가족\s*(회선|할인)", "묶으")),
    ("install", "설치·이전·AS 방문", "install", ("설치", r"기사(님)?(이|가)?\s*(와|방문|다녀)", r"이전\s*설치", "점검")),
    ("namechange", "명의 변경 절차", "onboarding", (r"명의\s*변경", r"명의(를|로|가)?\s*(바꾸|변경|이전)")),
    ("signup", "신규 가입 상담", "sales", (r"새로\s*가입", r"신규\s*가입", "가입하려")),
    ("agent_quality", "상담 응대 미흡", "quality", (r"안내를?\s*못", "불친절", "태도가", r"제대로\s*설명", r"알아서\s*하[라셔]")),
    ("legal", "외부 기관 신고·법적 대응 언급", "legal", (ESCALATION, "민원", "법적으로", "신고(하|할)")),
)

# Signs that a call is about a matter called about before.
REPEATS = (r"또\s*(느|안|그|같|저)", r"다시\s*(연락|전화)", r"[두세네](\s*)번째", r"지난\s*(주|번|달)에?도?\s*(왔|했|말)", r"벌써\s*\d+\s*번", r"계속\s*(이래|그래|같)")

# Churn signals (id, label, weight, patterns); the last two lower the risk.
CHURN_SIGNALS = (
    ("cancel-intent", "해지 의사 직접 표현", 30, (r"해지(하|할|해\s*주|하겠|하려)", r"해지.{0,4}(해\s*주|부탁|요청|신청|원해|하고\s*싶)", r"끊(을|겠|어\s*주)", r"그만\s*(쓰|이용)", r"계약\s*종료")),
    ("competitor", "타사 비교·이동 언급", 25, ("타사", r"다른\s*(통신사|회사|업체)", r"번호\s*이동", "갈아타", "옮기(려|겠|고)")),
    ("penalty", "위약금·잔여 약정 확인", 18, ("위약금", r"해지\s*수수료", r"약정\s*(기간|남은|얼마)", r"할인\s*반환금")),
    ("repeat-issue", "반복 장애·재문의", 15, (r"또\s*(느려|끊|안|같은)", r"(두|세|네|몇)\s*번째", r"계속\s*(느려|끊|안\s*돼)", "지난번에도")),
    ("legal", "법적 대응·외부 제보 언급", 20, (ESCALATION, r"민원\s*접수")),
    ("compensation", "보상·감면 요구", 12, ("보상", "배상", "감면", "환불", "(요금|위약금).*(면제|빼|깎)")),
    ("trust-loss", "신뢰 상실 표현", 10, (r"못\s*믿", r"믿을\s*수\s*없", "실망", "최악", "형편없", r"어이가\s*없")),
    ("resolved", "해결·만족 확인", -12, ("해결(됐|되었|됨)", "고맙|감사", "만족", "친절", r"그럼\s*(그렇게|그걸로)")),
    ("stay", "유지·재계약 의사", -15, (r"계속\s*(쓰|이용)", "유지하", r"그대로\s*둘", "재계약", "연장하")),
)

# Mandatory mentions (id, label, points, patterns).
MENTIONS = (
    ("greeting", "첫인사·소속 밝히기", 8, ("안녕하세요", "안녕하십니까", "반갑습니다")),
    ("identity", "본인 확인", 8, (r"본인\s*확인", r"명의자\s*확인", "생년월일", "성함.*확인")),
    ("recording", "녹취 고지", 8, ("녹음", "녹취")),
    ("solution", "해결 안내·처리 확인", 8, (r"처리(해|하겠|되|가\s*완료)", r"안내(해\s*드리|드리)", "도와드리", "접수(해|하겠|되)")),
    ("closing", "마무리 인사·추가 문의 확인", 8, (r"더\s*(궁금|도와드릴|필요하신|문의)", r"좋은\s*하루", r"이용해\s*주셔서\s*감사")),
)

# Forbidden phrases (id, severity, points off, speaker ambiguous, phrases).
FORBIDDEN = (
    ("blame", "high", 6, False, ("고객님이 잘못", "고객님 잘못", "고객님 책임", "그러게 왜", "제대로 보셨어야")),
    ("dismissive", "high", 5, False, ("어쩔 수 없습니다", "저희가 알 수 없", "규정이라 안 됩", "알아서 하셔야", "해드릴 게 없")),
    ("informal", "medium", 4, True, ("그렇다니까", "했잖아요", "알았어요", "그건 몰라", "아 진짜")),
    ("overpromise", "medium", 4, False, ("무조건 됩니다", "100% 보장", "절대 문제 없", "제가 다 책임")),
)

# Call stages and their mentions, in order.
CALL_STAGES = (("open", ("greeting", "recording")), ("verify", ("identity",)), ("resolve", ("solution",)), ("close", ("closing",)))
# Signals that the live guide has advice for.
PLAYBOOK = ("legal", "cancel-intent", "competitor", "repeat-issue", "compensation", "trust-loss")

# Routing where no cause is found (team, category or none, pattern).
RESIDUAL_ROUTES = (
    ("billing", "요금", r"과금|이중\s*청구|잘못\s*청구|요금\s*이의"),
    ("network", None, r"느려|끊기|끊김|안\s*터지|장애|불통|속도"),
    ("install", None, r"이전\s*설치|설치\s*가능|이사|철거|재설치"),
    ("compensation", None, "보상|배상|감면|환불"),
)

# Synonyms (canonical word, others).
SYNONYMS = (
    ("위약금", ("해지수수료", "해지비용", "할인반환금", "해약금", "위약")),
    ("속도", ("느림", "느려", "느린", "끊김", "끊겨", "버벅", "지연")),
    ("소액결제", ("콘텐츠이용료", "휴대폰결제", "게임결제")),
    ("셋톱박스", ("셋탑박스", "셋톱", "셋탑")),
    ("명의", ("명의이전", "명의변경", "양도")),
    ("로밍", ("해외데이터", "해외요금", "해외로밍")),
    ("결합", ("가족결합", "묶음", "패밀리")),
    ("요금제", ("플랜", "상품제")),
    ("이전", ("이사", "전출", "이전설치")),
    ("환불", ("취소", "반환")),
)

# Query rewrites (id, kind, triggers in the text without blanks, word to add).
REWRITES = (
    ("변경", "topic", ("돌리", "바꾸", "바꿔", "넘기"), "변경"),
    ("해지", "topic", ("그만두", "해지"), "해지"),
    ("결합", "topic", ("같이쓰", "같이써", "같이사용", "함께쓰", "함께써", "묶"), "결합"),
    ("할인", "modifier", ("싸", "싼", "저렴"), "할인"),
    ("가족", "modifier", ("아버지", "아빠", "어머니", "엄마", "부모", "와이프", "아내", "남편", "배우자", "가족", "식구"), "가족"),
)


def teams(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(TEAMS), "team string, team_name string, sla string, priority string")


def patterns_table(spark: SparkSession, rules=THEMES) -> DataFrame:
    """(rule, label, value, ord, pattern_no, pattern): one row per pattern of (id, label, value, patterns) rules."""
    rows = [(r[0], r[1], str(r[2]), k, n, p) for k, r in enumerate(rules) for n, p in enumerate(r[3])]
    return spark.createDataFrame(rows, "rule string, label string, value string, ord int, pattern_no int, pattern string")
