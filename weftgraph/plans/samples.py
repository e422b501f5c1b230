"""Small literal inputs in Korean, which the supplied tables have none of; queries and their SQL read the same rows."""

from __future__ import annotations

QUESTIONS = [
    ("Q1", "안중근이 조직한 단체는?"), ("Q2", "윤봉길이 참여한 사건에 같이 있던 인물이 세운 조직은?"), ("Q3", "3·1 운동에 참여한 인물 가운데 조선의용대를 세운 사람은?"),
    ("Q4", "안중근이 설립한 방송국은?"), ("Q5", "김좌진과 함께 참전한 인물이 세운 조직이 참여한 전투는?"), ("Q6", "김구가 참여한 사건은 무엇인가?"), ("Q7", "누구인가"), ("Q8", "하늘은 왜 푸른가?"), ("Q9", "의열단을 만든 사람은?"), ("Q10", ""),
]
NODES = [
    ("안중근", "Person", "도마;안응칠"), ("김구", "Person", "백범"), ("윤봉길", "Person", "매헌"), ("김원봉", "Person", "약산"), ("김좌진", "Person", "백야"), ("홍범도", "Person", ""),
    ("하얼빈 의거", "Event", "하얼빈의거"), ("3·1 운동", "Event", "삼일운동;기미독립운동"), ("홍커우 공원 의거", "Event", ""), ("청산리 전투", "Event", "청산리대첩"), ("봉오동 전투", "Event", "봉오동전투"),
    ("동의단지회", "Organization", "단지동맹"), ("한인애국단", "Organization", "애국단"), ("의열단", "Organization", ""), ("조선의용대", "Organization", ""), ("대한독립군", "Organization", "백야"),
]
EDGES = [
    ("안중근", "PARTICIPATED_IN", "하얼빈 의거", 0.95, "안중근;하얼빈 의거"), ("안중근", "FOUNDED", "동의단지회", 0.88, "안중근"), ("윤봉길", "PARTICIPATED_IN", "홍커우 공원 의거", 0.9, "윤봉길"),
    ("김구", "PARTICIPATED_IN", "홍커우 공원 의거", 0.8, "김구;한인애국단"), ("김구", "FOUNDED", "한인애국단", 0.88, "김구"), ("김원봉", "PARTICIPATED_IN", "3·1 운동", 0.75, "김원봉"), ("김원봉", "FOUNDED", "조선의용대", 0.88, "김원봉;조선의용대"),
    ("김원봉", "FOUNDED", "의열단", 0.9, "의열단"), ("김좌진", "PARTICIPATED_IN", "청산리 전투", 0.88, "김좌진;청산리 전투"), ("홍범도", "PARTICIPATED_IN", "청산리 전투", 0.88, "홍범도"), ("홍범도", "FOUNDED", "대한독립군", 0.8, "홍범도"),
    ("대한독립군", "PARTICIPATED_IN", "봉오동 전투", 0.88, "봉오동 전투"), ("대한독립군", "PARTICIPATED_IN", "청산리 전투", 0.75, "청산리 전투"),
]
PAGES = [
    ("안중근", "1879년 태어남;한국의 독립운동가", "안중근은 하얼빈 의거에 참여하였다. 안중근은 동의단지회를 조직하였다.", 3), ("청산리 전투", "1920년 전투", "김좌진이 지휘관으로 싸웠다. 홍범도도 청산리 전투에 참전하였다.\n각주\n이것은 각주이다.", 2),
    ("신민회", "한국의 독립운동단체", "신민회는 1907년 안창호가 조직한 비밀결사이다.", 2), ("김규식", "1881년 태어남;한국의 독립운동가;대한민국 임시정부 사람", "김규식은 정치인이다.", 4), ("김규식 (북로군정서)", "한국의 독립운동가", "군인이다.", 1),
    ("한국방송공사", "대한민국의 방송", "방송국이다.", 5), ("1919년", "1919년", "연도이다.", 9), ("대한민국 임시정부 국무총리", "대한민국의 정치인", "직책이다.", 2), ("독립군", "한국의 독립군 단체", "총칭이다.", 3), ("이이", "1536년 태어남;1584년 죽음;조선의 학자", "학자이다.", 3),
    ("나혜석", "1896년 태어남;대한민국의 화가;한국의 소설가;여성 시인;3·1 운동 관련 만세운동", "화가이다.", 2), ("최규하", "1919년 태어남;대한민국의 대통령;건국훈장 대한민국장 수훈자", "대통령이다.", 2), ("장제스", "중국의 정치인;중국의 군인;중국의 교육자;건국훈장 대한민국장 수훈자", "정치인이다.", 2),
    ("독립운동가 목록", "한국의 독립운동가", "목록이다.", 2), ("무제", "", "분류가 없다.", 2),
]
GAZETTEER = [("하얼빈 의거", "1909년 사건"), ("동의단지회", "한국의 독립운동단체"), ("안창호", "한국의 독립운동가"), ("김좌진", "한국의 독립운동가"), ("홍범도", "의병장")]
BODIES = [
    ("a", "안중근(安重根)은 자유시 참변 이후 대한청년회 와 함께 하였다. 신흥무관학교 에서 배웠다."), ("b", "당시 김구(金九)는 자유시 참변 을 들었다. 대한청년회 도 있었다."), ("c", "옛 안중근 (安重根)과 청산리 전투 에서 자강단 의 일이다."), ("d", "자강단 이 있다. 독립운동 이다. 미지인(未知人)"), ("e", "자강단 과 자유시 참변"),
]
NAMES = ["  안중근 (1879년) ", "3 ・ 1 운동", "《독립신문》", "안중근(安重根)", "(괄호)", "", "  가   나  ", "임시정부", "김구ㆍ이동녕", "A,·;"]
WORDS = ["안중근이", "신민회에서", "이", "학교으로", "사건", "가", "김구는", "을", "에서", "독립을"]
SECRETS = ["", "short", "0123456789", "sk-abcdefghijklmnopqrstuvwx", "sk-short", "열한글자가넘는비밀번호다"]
ANSWERS = [("```json\n[{\"a\": 1}]\n```",), ("Here it is: {\"a\": [1, 2]} and no more",), ("nothing",), ("[1]",), ("",)]
TITLES = ["1919년", "1910년대", "3월 1일", "123", "독립운동가 목록", "틀:문서", "김구 (동음이의)", "일본", "안중근", "한국 일람"]
CATEGORIES = ["분류:20세기 한국 사람", "위키 문서", "1879년 태어남", "한국의 독립운동가", "고령 신씨", "서울대학교 동문", "조선 사람", "의병", "대한민국의 소설가", "올림픽", "한국의 시인"]

RULE_BODIES = [
    ("글", "", "김구는 한인애국단을 조직하였다. 한인애국단은 김구에 의해 조직되었다. 청산리 전투에서 김좌진은 크게 활약하였다. 안중근이 하얼빈 의거를 결행하였다. 아무도 없는 문장이다."), ("의열단", "Organization", "1919년 김원봉이 조직하였다. 김원봉 등이 중심이 되어 결성되었다. 김원봉에게 조직한 일을 물었다."),
    ("김구", "Person", "1931년 한인애국단을 조직하였다. 한인애국단에서 조직한 일이 있다."), ("청산리 전투", "Event", "김좌진이 지휘관으로 나섰다. 홍범도도 청산리 전투에 참전하였다. 봉오동 전투와 홍범도가 참전하였다."), ("홍범도", "Person", "1920년 봉오동 전투에 참전하였다. 김좌진과 청산리 전투에 참전하였다."),
]
REDIRECTS = [("안중근", "도마 안중근;안중근;안중근 (의사)"), ("김구", "백범 김구"), ("없음", "누구")]
MENTIONS = [("안중근", "안중근은"), ("신민회", "신민회"), ("김구", "김구가"), ("안중근", "안중근의")]
GOLDEN = [
    ("Q1", "path", 2, True, "윤봉길", "홍커우 공원 의거", "김구", "한인애국단"), ("Q2", "path", 3, True, "김구", "홍커우 공원 의거", "없는 사람", "없는 단체"), ("Q3", "path", 2, False, "누구", "어떤 의거", "없는 사람", "없는 단체"),
    ("Q4", "local", 1, True, "김좌진", "청산리 전투", "홍범도", "대한독립군"), ("Q5", "path", 2, True, "김구", "홍커우 공원 의거", "없는 사람", "없는 단체"), ("Q6", "path", 2, True, "윤봉길", "홍커우 공원 의거", "김구", "한인애국단"),
]


def quoted(text: str | None) -> str:
    return "NULL" if text is None else "'" + text.replace("'", "''") + "'"


def values(rows: list, columns: str, name: str) -> str:
    """rows as a common table of SQL."""
    cells = [r if isinstance(r, tuple) else (r,) for r in rows]
    lines = ", ".join("(" + ", ".join(quoted(c) if isinstance(c, str) or c is None else repr(c) for c in r) + ")" for r in cells)
    return f"{name}({columns}) AS (VALUES {lines})"
