"""Fixed values of the Korean history domain: word lists and patterns that results depend on."""


# Fixed values from here on: they must equal what the extraction and selection rules are defined with.

# Entity types by category and title
PERSON_CATEGORY = r"\d+년\s*태어남|\d+년\s*죽음|독립운동가|정치인|군인|교육자|언론인|사상가|종교인|아나키스트|사회주의자|민족주의자|공산주의자|승려|목사|신부|의병장|작가|시인|소설가|학자|역사가|혁명가|기업인|법조인|외교관|화가|음악가|인물|사람|동문|출신|왕|황제|천황|총리|대통령|장군|열사|의사자|암살자|수상자"

ORGANIZATION_CATEGORY = "단체|조직|정당|학교|대학|정부|기관|부대|군대|결사|협회|학회|연맹|동맹|회사|기업|신문|언론사|출판사|교회|사찰|재단|위원회|의정원|총독부|군정서|의용군|광복군|독립군|설립|창립|창설|해체|은행|병원|조합|본부|사령부"

EVENT_CATEGORY = "사건|전투|전쟁|운동|의거|봉기|시위|학살|조약|선언|항쟁|혁명|테러|암살|재판|회담|침공|점령|만세|투쟁|의병|폭동|파업|해전|작전"

NON_ENTITY_CATEGORY = "방송|텔레비전|라디오|드라마|영화|음반|앨범|게임|프로그램|잡지|웹사이트|스포츠|음악 그룹|만화|애니메이션|예능"

EVENT_TITLE = "(전투|전쟁|사건|의거|운동|봉기|시위|학살|조약|선언|항쟁|혁명|대첩|작전|회담|재판|만세운동|투쟁|참변|사변|정변|참사|회의|해전|공판|의병)$"

ORGANIZATION_TITLE = "(학교|대학교|정부|의정원|총독부|군정서|광복군|독립군|의용군|의용대|협회|학회|연맹|동맹|위원회|신문|일보|재단|회사|공사|은행|본부|사령부|애국단|청년회|부인회|소년단|결사대|의열단|흥사단|신민회|국민회|동지회|친목회|구락부|혁명당|국민당|독립당|공산당|사회당|청년당|의군부|독군부|통의부|정의부|신민부|참의부|학우회|수양회|동우회|자강회|광복회|광복단|청년단|의병대|유격대)$"

POSITION_TITLE = "(국무총리|대통령|국무위원|주석|총리|장관|위원장|의장|사령관|총사령|교장|총장|회장|단장|대표|비서장|참모장|국장|부장|과장)$"

# Signs in names, and breaks between sentences and quotations
DOTS = "[·‧・•ㆍ･‧]"
QUOTES = "[《》〈〉「」『』\"'“”‘’]"
QUALIFIER = r"\s*[(（][^()（）]*[)）]"
SENTENCE_BREAK = r"(?<=[.!?。])\s+|\n+"
QUOTE_BREAK = r"(?<=[.?!])\s+"
NAME_GLOSS = r"[(（]\s*([一-鿿][一-鿿\s·,、]*)\s*[)）]"

# Document files: as they are analysed, and as they are stored
DOCUMENT = r"(?s)\A# (.*?)\n\s*(?:분류: (.*?)\n)?\s*\n(.*)\z"
STORED = r"(?s)\A#\s*(.+?)\n\s*\n분류:\s*(.*?)\n\s*\n(.*)\z"

# Headings that end the body
SECTION_CUT = r"^\s*(각주|주석|참고 ?문헌|참고 ?자료|인용|출처|외부 ?링크|같이 ?보기|관련 ?항목|관련 ?문서|더 ?보기|대중 ?문화|대중문화 속|관련 ?작품|관련 ?매체|관련 ?미디어|전기 ?자료|함께 ?보기)\s*$"

# Names that are no entities
STOPWORDS = ('정부', '운동', '단체', '조직', '학교', '군대', '부대', '신문', '회의', '사건', '전투', '전쟁', '독립', '독립운동', '민족', '국가', '나라', '인민', '국민', '민중', '정당', '협회', '학회', '연맹', '동맹', '위원회', '본부',
 '사령부', '총독부', '결사', '의병', '의거', '봉기', '시위', '선언', '조약', '혁명', '항쟁', '투쟁', '교육', '종교', '사상', '문화', '역사', '사회', '경제', '정치', '군사', '외교', '대표', '회장', '단장', '총장', '주석',
 '국무총리', '대통령', '장군', '의사', '열사', '선생', '동지', '청년', '학생', '여성', '남성', '어머니', '아버지', '아들', '딸', '독립운동가', '독립운동단체', '애국지사', '순국선열', '의병장', '항일운동', '민족운동', '무장투쟁', '민족주의',
 '사회주의', '공산주의', '아나키즘', '광복', '친일파', '매국노', '식민지', '강제징용', '위안부', '정치인', '군인', '교육자', '언론인', '역사가', '사상가', '혁명가', '테러', '암살', '학살', '만세', '한국의 독립운동', '독립군', '일본군',
 '조선군', '청군', '관동군', '팔로군', '제국주의', '식민주의', '자결권', '파업', '반전 운동', '광복절', '신한촌', '서당', '교회', '개신교', '기독교', '천주교', '불교', '대종교', '로마 가톨릭교회', '개화파', '공산당', '유엔', '청나라',
 '중화인민공화국', '조선민주주의인민공화국', '대한민국 정부', '대한민국 국군', '국방부', '일본 제국 육군', '일본 제국', '조선총독부', '인민위원회', '일본인', '중국인', '조선인', '한국인', '일본 천황', '천황', '목사', '신부', '승려', '농민', '노동자',
 '지식인', '유생', '관료', '병사', '장병', '군인들', '한국', '조선', '대한민국', '대한제국', '일본', '중국', '미국', '러시아', '소련', '영국', '프랑스', '독일', '만주', '서울', '경성', '평양', '상하이', '상해', '베이징', '도쿄',
 '하와이', '연해주', '간도', '블라디보스토크', '일제', '일제강점기')

# Short names
ABBREVIATIONS = {'임시정부': '대한민국 임시정부',
 '임정': '대한민국 임시정부',
 '상해 임시정부': '대한민국 임시정부',
 '상하이 임시정부': '대한민국 임시정부',
 '대한민국임시정부': '대한민국 임시정부',
 '상해임시정부': '대한민국 임시정부',
 '임시 정부': '대한민국 임시정부',
 '광복군': '한국광복군',
 '한국 광복군': '한국광복군',
 '삼일운동': '3·1 운동',
 '3.1 운동': '3·1 운동',
 '3·1운동': '3·1 운동',
 '3.1운동': '3·1 운동',
 '삼일 운동': '3·1 운동',
 '기미독립운동': '3·1 운동',
 '기미 독립운동': '3·1 운동',
 '육십만세운동': '6·10 만세운동',
 '6.10 만세운동': '6·10 만세운동',
 '6·10만세운동': '6·10 만세운동',
 '청산리대첩': '청산리 전투',
 '청산리 대첩': '청산리 전투',
 '봉오동전투': '봉오동 전투',
 '애국단': '한인애국단',
 '의열단원': '의열단',
 '신흥무관학교': '신흥무관학교',
 '임시의정원': '대한민국 임시의정원',
 '독립신문': '독립신문'}

# Verbs
FOUND_STEMS = ('조직', '창설', '설립', '결성', '창립', '창건', '발족', '수립', '창단', '창간', '건립', '출범', '조직화')

PART_STEMS = ('참여', '참가', '참전', '가담', '합류', '동참', '관여', '주도', '주동', '거행', '전개', '활약', '가세', '출전', '종군', '기여', '봉기', '궐기', '호응', '선포', '낭독', '서명', '투신', '결행', '단행', '감행')

ACTIVE_ENDING = "(?:하였|하여|하며|하고|한|해|했|합|함|하기|하는|할|하|시켰|시킨|시켜)"

PASSIVE_ENDING = "(?:되었|되어|되고|되며|된|됐|됨|되기|되는|될|되)"

FOUND_ACTIVE = "(?:조직|창설|설립|결성|창립|창건|발족|수립|창단|창간|건립|출범|조직화)(?:하였|하여|하며|하고|한|해|했|합|함|하기|하는|할|하|시켰|시킨|시켜)|세웠|세운|세우고"

FOUND_PASSIVE = "(?:조직|창설|설립|결성|창립|창건|발족|수립|창단|창간|건립|출범|조직화)(?:되었|되어|되고|되며|된|됐|됨|되기|되는|될|되)"

PART_ACTIVE = "(?:참여|참가|참전|가담|합류|동참|관여|주도|주동|거행|전개|활약|가세|출전|종군|기여|봉기|궐기|호응|선포|낭독|서명|투신|결행|단행|감행)(?:하였|하여|하며|하고|한|해|했|합|함|하기|하는|할|하|시켰|시킨|시켜)|일으켰|일으킨|일으켜|이끌었|이끈|이끌고|지휘하|지휘했|지휘한|지휘를|벌였|벌인|맞서|싸웠|싸운|참전|출정|진두지휘"

PART_PASSIVE = "(?:참여|참가|참전|가담|합류|동참|관여|주도|주동|거행|전개|활약|가세|출전|종군|기여|봉기|궐기|호응|선포|낭독|서명|투신|결행|단행|감행)(?:되었|되어|되고|되며|된|됐|됨|되기|되는|될|되)"

AGENT_MARKER = "에 의해|에 의하여|의 주도로|중심이 되어|주축이 되어|주도하여|주도로|등이|들이|함께"

PART_ROLE = "지휘관|사령관|총사령|대장|부대장|참모|대표|주역|주모자|주동자|지도자|단원|대원|의사|열사|민족대표|33인|선언서"

# What may follow a name
NAME_SUFFIX = "(?:원들|원|장|측|계|파|내|들|군|사|씨)?"

NAME_PARTICLE = "(?:은|는|이|가|을|를|의|에|와|과|도|로|으로|에서|에게|께서|께|부터|까지|만|이나|나|라|이라|이라고|라고|이며|며|이고|고|이다|다|인|한|등|및|처럼|같이|보다|조차|마저|밖에|이라는|라는|으로부터|로부터|에서는|에게서|에는|에도|와는|과는|이라도|였|이었|랑|하고)?"

# Particles by role
SUBJECT_MARK = r"^(?:은|는|이|가|도|와|과|및|등|께서|[,·]|\s|$)"

NOT_SUBJECT = "^(?:에서|에게|에|의)"

OBJECT_MARK = "^(?:을|를|등을|[,·]|와|과|및)"

NOT_OBJECT = "^(?:은|는|이|가|에서|에게|에|의|으로|로)"

OBLIQUE = "^(?:에서|에게|에|의)"

GLOSS_AFTER = r"^\s*[(（][一-鿿\s·,、]+[)）]"

GLOSS = r"([가-힣][가-힣·\s]{1,14}?)\s*[(（]\s*([一-鿿]{2,10})\s*[)）]"

# Entities found by suffix
DISCOVER_EVENT = r"(?<![가-힣])((?:[가-힣0-9·]{2,8})(?:\s[가-힣0-9·]{1,8})?\s?(?:전투|의거|사건|봉기|항쟁|대첩|학살|전쟁|조약|선언|참변|정변|사변|폭동))(?![가-힣])"

DISCOVER_ORGANIZATION = r"(?<![가-힣])((?:[가-힣0-9·]{2,8})(?:\s[가-힣0-9·]{1,8})?\s?(?:무관학교|의정원|총독부|군정서|광복군|독립군|의용대|의용군|청년회|부인회|애국단|결사대|국민회|광복회|사령부|학교|협회|학회|연맹|동맹|위원회|신문사|은행|본부|정부|재단|공사))(?![가-힣])"

DISCOVER_SHORT_ORGANIZATION = "(?<![가-힣])([가-힣]{2,7}(?:단|회|당|군|부|서|사))(?![가-힣])"

GENERIC_NAMES = ('독립운동', '항일운동', '민족운동', '애국운동', '계몽운동', '학생운동', '노동운동', '사회운동', '문화운동', '실력양성운동', '무장투쟁', '독립전쟁', '해방운동', '저항운동', '농민운동', '여성운동', '청년운동', '반일운동', '의병운동', '국권회복운동',
 '애국계몽운동', '무장독립운동', '민족해방운동', '혁명운동', '만세운동', '독립선언', '세계대전', '세계 대전', '대일전쟁', '무장항쟁', '구국운동', '자치운동', '물산장려', '임시정부', '일본군', '관동군', '일본 정부', '조선 정부', '중국 정부', '미국 정부',
 '소련군', '연합군', '관동대학살', '한국군', '국군', '중국군', '미군', '일군')

# Titles and categories that are left out
TITLE_BLOCKS = (['^\\d+년(\\s|$)', 'year_page: 연도 문서'], ['^\\d+년대', 'year_page: 연대 문서'], ['^\\d+월\\s*\\d+일$', 'date_page: 날짜 문서'], ['^(기원전\\s*)?\\d+$', 'year_page: 숫자 제목'],
 ['목록', 'list_page: 목록 문서'], ['일람', 'list_page: 일람 문서'], ['^(틀|분류|위키프로젝트|파일|포털):', 'namespace_page: 틀/분류/포털 문서'], ['\\(동음이의\\)', 'disambiguation: 동음이의 문서'],
 ['^(대한민국|조선민주주의인민공화국|일본|중국|미국|러시아|소련|영국)$', 'too_generic: 국가명 일반 문서'])

CATEGORY_NOISE = ('위키', '문서', '출처', '인용', '오류', '정리', '넘겨주기', '링크', '틀', 'ISBN', '모호', '동음이의', '생몰년', '날짜', '기여', '번역')

GENERIC_CATEGORIES = ('^\\d+세기', '^\\d+년\\s*(출생|사망|태어남|죽음)$', '^(한국|대한민국|대한제국|조선|일본|중국) 사람$', '세기\\s.*사람$', '\\s씨$', '동문$', '출신$', '(기독교|장로교|천주교|가톨릭|개신교|불교|무신론|유교)',
 '(피해자|사망자|옥사한|사형된|암살된|자살한|화기에 죽은|처형된)', '^(소설가|시인|작가|화가|음악가|배우|언론인|의사|교육인|번역가)', '의 (소설가|시인|작가|화가|음악가|배우|서예가|국악인|축구|야구)', '(회장|수상자|올림픽|스포츠|드라마|영화|음반)')

CORE_TOPIC = "독립운동가|한국의 독립운동|독립운동단체|독립유공자|건국훈장|건국포장|임시정부|광복군|독립군|의병|의열|애국단|애국지사|순국|민족대표|무오독립선언|군정서|광복회|신민회|신간회|흥사단|국채보상|조선어학회|한국독립당|대한인국민회|만세운동|항일|반일 감정|의열단|한인애국단|대한민국 임시정부"

ARTS_IDENTITY = "소설가|시인|문학|화가|서예가|음악가|국악|판소리|배우|영화|가수|무용|체육|축구|야구|만화가|사진가|건축가"

STRONG_ACTIVIST = "독립운동가|의병장|애국지사|순국선열|건국훈장|건국포장|민족대표|의열단|광복군"

FOREIGN_CAT = "^(중국|일본|미국|대만|러시아|영국|프랑스|독일|중화민국|소련|캐나다)의 "

KOREAN_MARKER = "한국인|한인|조선인|한국 사람"

POST_LIBERATION = r"^대한민국의 (대통령|국무총리|대통령 권한대행)$|^대한민국 제\d+대 대통령"

ACTIVIST_CAT = "한국의 독립운동가|독립유공자|대한민국 임시정부|의열|광복군|민족대표|무오독립선언|의병장|애국지사|순국선열"

FOREIGN_EXEMPT = "대한민국 임시정부 사람|한국의 독립운동가|한국광복군"

BORN = r"^(\d{3,4})년\s*(?:출생|태어남)$"

DIED = r"^(\d{3,4})년\s*(?:사망|죽음)$"

# Questions
QUESTION_PARTICLES = ('에서', '으로', '에게', '이나', '이', '가', '은', '는', '을', '를', '의', '에', '과', '와', '로', '도', '만', '한', '된', '인', '던', '서')

COMMON_WORDS = ('사건', '인물', '조직', '단체', '학교', '정보', '대상', '내용', '관련', '위치', '무엇', '어디', '누구', '어떤', '함께', '같이', '동료', '동참', '거쳐', '이어진', '통해', '모의', '세운', '설립', '창설', '창립', '만든', '세웠',
 '창건', '참여', '가담', '일으킨', '의거', '전투', '참전', '동참', '벌인', '거사', '독립', '운동', '역사', '질문', '사람', '존재', '알려', '해당', '속한', '또는', '있던', '대첩', '함께한', '알려진', '나온', '설립자', '참여자',
 '가운데', '중에서', '사이', '당시', '이후', '이전', '주요', '대표', '모두', '각각', '다른', '참여했는가', '참전했는가', '조직한', '세운 조직', '세운 단체', '세운 학교', '세운 사람')

PATH_KEYWORDS = ('함께', '같이', '동료', '동참', '거쳐', '이어진', '통해', '관련된', '의 인물이 세운', '의 단체가 참여한', '의 사건에', '연결', '모의')

LOCAL_KEYWORDS = ('참여한 사건', '설립한 조직', '세운 단체', '참전한 사건', '의 거사', '언제', '누구인가', '무엇인가')

TYPE_KEYWORDS = (['Event', ['사건', '전투', '의거', '대첩', '운동', '참여했는가', '참전했는가', '벌어졌는가']], ['Organization', ['조직', '단체', '학교', '단', '정부', '회사']],
 ['Person', ['인물', '사람', '누구', '총책임자', '총장', '대표', '인물은']])

CO_PARTICIPANT = "(함께|같이|동참|동료|같은).*(참전|참여|있던|활동|거사|사건|전투|운동)"

CO_PARTICIPANT_REVERSED = "(참전|참여|있던|활동|거사|사건|전투|운동).*(함께|같이|동참|동료)"

FOUNDED_STEMS = "세운|설립|창설|창립|만든|조직한|세웠|창건"

CHAINED_QUESTION = r"(참여|세운|창설|설립|속한).*(인물|단체|조직|사건).*(세운|참여|일으킨|창설)"

BATTLE_QUESTION = "전투|참전"

BATTLE_NAME = "전투|대첩"

BATTLE_WORD = "전투"

NAME_PARTICLES = "은|는|이|가|을|를|의|와|과|에서|에게|에|도|으로|로|등"

LISTED_SUBJECT = r"^(?:을|를)\s*(?:위시|비롯|중심|포함)"

OBJECT_PARTICLE = "^(?:을|를)"

LOCATIVE = "^(?:에서|에|을|를|의|으로|로)"

CATEGORY_EVIDENCE = ("분류: ", " (문서 '", "' 의 위키 분류 행)")

# Texts of answers
REFUSAL = "제시된 지식 그래프 자료에서 해당 질문에 대한 근거를 찾을 수 없습니다."

NO_PATH = "(근거 경로를 찾을 수 없어 거절되었습니다)"

NO_SOURCE = "(없음)"

BLOCKS = ("[답변 요약]", "[탐색 및 추론 경로]", "[근거 출처]")

SEARCHED = "지식 그래프 탐색 결과, "

CO_EVENT = ("과(와) 함께 참전한 인물이 세운 조직이 참여한 사건/전투 ", "건, 신뢰도 및 경로 점수 기준 순위)은 다음과 같습니다:")

CO_ORGANIZATION = ("과(와) 함께한 인물이 세운 조직/단체 ", "건, 신뢰도 및 경로 점수 기준 순위)은 다음과 같습니다:")

ONE_STEP = ("이(가) ", "참여한 사건", "설립한 조직", "건, 신뢰도 순):")

PERSONS = (" 관련 인물", "건, 신뢰도 순):")

CHAIN = ("에서 시작하여 연쇄 관계를 거쳐 도출된 ", "조직", "사건", "건, 차수 감점 및 신뢰도 기준 순위)은 다음과 같습니다:")

UPPER = "(상위 "

GROUNDS = " (근거: "

CITED = ") | 출처: "

GRAPH_SOURCE = "지식 그래프"

REVERSED_STEP = " (역방향)"

QUOTED = "관련 문서 내용 발췌:\n"

NOTHING_FOUND = "검색된 관련 문서가 없습니다."
