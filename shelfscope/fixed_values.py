"""Word lists, lookup tables, formats and patterns.

Everything here is data whose exact content decides the results (Korean shop vocabulary, band
edges, CSV headers, page patterns). Nothing else in the package hard-codes such a value, and every
operator takes them as parameters, so another shop or language only needs other tables.
"""

# --- fixed values: CSV headers -> canonical column names -------------------------------------
PRODUCT_HEADERS = {
    "상품ID": "product_id",
    "브랜드": "brand",
    "상품명": "name",
    "가격": "price",
    "원가": "list_price",
    "할인율": "discount_pct",
    "상품링크": "link",
    "URL": "image_url",
    "이미지URL": "image_url",
    "이미지": "image_url",
    "TEXT": "text",
    "평점": "rating",
    "리뷰수": "review_count",
    "검색어": "search_term",
    "수집일시": "collected_at",
}

PRODUCT_COLUMNS = [
    "product_id", "brand", "name", "price", "list_price", "discount_pct", "link", "image_url",
    "text", "rating", "review_count", "search_term", "collected_at",
]
REVIEW_COLUMNS = [
    "product_id", "brand", "product_url", "rating", "text", "author", "date", "option",
    "helpful_count", "has_image", "page_number",
]
SENTIMENT_COLUMNS = [
    "product_id", "brand", "text", "sentiment", "positive_score", "negative_score",
    "positive_reasons", "negative_reasons",
]
DISPLAY_COLUMNS = [
    "brand", "name", "price", "list_price", "discount_pct", "product_id", "link",
]

# --- fixed values: bands ---------------------------------------------------------------------
PRICE_EDGES = [0, 30000, 50000, 100000, 200000, float("inf")]
PRICE_LABELS = ["~3만원", "3-5만원", "5-10만원", "10-20만원", "20만원~"]
DISCOUNT_EDGES = [0, 10, 20, 30, 40, 50, 100]
DISCOUNT_LABELS = ["0-10%", "10-20%", "20-30%", "30-40%", "40-50%", "50% 이상"]
ALL_OPTION = "전체"
SORT_LABELS = {
    "가격 낮은순": "price_asc",
    "가격 높은순": "price_desc",
    "할인율 높은순": "discount_desc",
    "브랜드명순": "brand",
    "가격 (낮은순)": "price_asc",
    "가격 (높은순)": "price_desc",
    "할인율 (높은순)": "discount_desc",
    "브랜드명": "brand",
}

# --- fixed values: review sentiment words ----------------------------------------------------
POSITIVE_WORDS = {
    "디자인": ["예쁘", "예뻐", "이쁘", "이뻐", "귀엽", "세련", "독특", "유니크", "트렌디", "스타일리시"],
    "품질": ["좋아", "좋은", "좋고", "탄탄", "튼튼", "고급", "퀄리티", "만족", "최고", "훌륭"],
    "핏": ["핏이", "핏도", "슬림", "여리", "날씬", "잘맞", "딱맞", "완벽"],
    "가격": ["저렴", "싸게", "가성비", "가격대비", "할인", "세일", "이가격"],
    "편안함": ["편하", "편안", "편해", "활동", "신축성", "스판", "늘어나"],
    "만족도": ["만족", "추천", "재구매", "또사", "좋아요", "최고", "대박", "성공"],
    "색상": ["색이", "색도", "색깔", "색상", "화사", "선명"],
    "사이즈": ["넉넉", "여유", "충분", "적당"],
    "소재": ["부드럽", "보들", "촉감", "시원", "가벼", "얇아", "두껍지"],
}
NEGATIVE_WORDS = {
    "사이즈": ["작아", "작은", "작음", "짧아", "짧은", "짧음", "커요", "큰", "크다", "안맞", "타이트", "꽉", "끼"],
    "품질": ["별로", "실망", "후회", "아쉬", "그저", "보통", "싸구려", "저렴해보", "나쁘", "최악"],
    "소재": ["까슬", "따가", "답답", "더워", "두꺼", "뻣뻣", "거칠", "얇아서", "비침", "비쳐"],
    "색상": ["다르", "다른", "차이", "바랜", "색바램"],
    "배송": ["늦게", "늦어", "오래", "지연"],
    "가격": ["비싸", "비싼", "비쌈", "부담"],
    "디자인": ["촌스럽", "올드", "구식", "평범", "심심"],
    "내구성": ["찢어", "뜯어", "해짐", "풀림", "늘어남", "변형"],
    "불편함": ["불편", "거슬", "신경쓰"],
}
IMPROVEMENT_WORDS = {
    "사이즈": ["사이즈표", "정사이즈", "실측", "상세사이즈"],
    "소재": ["소재설명", "두께감", "비침정도", "신축성"],
    "색상": ["실제색상", "색차이", "모니터"],
    "길이": ["기장", "총장", "길이조절", "길이감"],
    "디테일": ["마감", "박음질", "지퍼", "단추", "안감"],
}
NEED_WORDS = ["원해", "있으면", "있었으면", "필요", "바라", "기대", "원합니다", "좋겠"]
STOP_WORDS = ["제품", "상품", "구매", "배송", "옷", "원피스", "스커트", "사이즈", "색상", "디자인"]
THEME_PATTERN = "[가-힣]+"

# --- fixed values: brand profile words -------------------------------------------------------
POSITION_WORDS = {
    "프리미엄": ["고급", "프리미엄", "명품", "퀄리티", "품질", "소재", "마감"],
    "트렌디": ["트렌드", "유행", "인기", "핫", "세련", "스타일", "패션"],
    "실용적": ["편한", "편하", "실용", "데일리", "일상", "활용", "기본"],
    "가성비": ["가성비", "저렴", "싸", "할인", "세일", "가격", "부담"],
    "유니크": ["독특", "유니크", "특별", "개성", "차별", "남다른"],
    "베이직": ["베이직", "기본", "무난", "깔끔", "심플", "단순"],
    "영캐주얼": ["귀여운", "귀엽", "러블리", "큐트", "발랄", "화사"],
    "미니멀": ["미니멀", "심플", "모던", "깔끔", "절제", "간결"],
}
FACTOR_WORDS = {
    "디자인": ["디자인", "예쁘", "이쁘", "스타일", "모양", "패턴", "무늬"],
    "품질": ["품질", "퀄리티", "소재", "재질", "원단", "마감", "바느질"],
    "가격": ["가격", "가성비", "저렴", "비싸", "할인", "세일", "쿠폰"],
    "사이즈": ["사이즈", "핏", "맞아", "크기", "기장", "길이", "넉넉"],
    "색상": ["색상", "색깔", "컬러", "색이", "색도", "톤", "색감"],
    "배송": ["배송", "도착", "포장", "빠른", "늦은", "신속"],
    "브랜드": ["브랜드", "믿고", "신뢰", "유명", "인지도"],
}
RADAR_FACTORS = ["디자인", "품질", "가격", "사이즈", "색상"]
AGE_WORDS = {
    "10대": ["학생", "교복", "학교", "귀여운", "캠퍼스"],
    "20대": ["대학", "데이트", "취업", "면접", "클럽", "파티"],
    "30대": ["회사", "직장", "출근", "오피스", "결혼식", "하객"],
    "40대": ["품위", "단정", "격식", "모임", "학부모"],
}
BODY_WORDS = {
    "마른": ["마른", "슬림", "스키니", "날씬"],
    "통통": ["통통", "넉넉", "여유", "커버", "가려"],
    "보통": ["보통", "평범", "일반", "표준"],
}

# --- fixed values: catalogue style and colour words ------------------------------------------
STYLE_WORDS = {
    "플로럴": ["플로럴", "꽃", "플라워"],
    "체크": ["체크", "격자"],
    "스트라이프": ["스트라이프", "줄무늬"],
    "도트": ["도트", "물방울"],
    "레이스": ["레이스"],
    "데님": ["데님", "청"],
}
STYLE_WORDS_FULL = {
    "플로럴": ["플로럴", "꽃", "플라워"],
    "체크": ["체크", "격자"],
    "스트라이프": ["스트라이프", "줄무늬"],
    "도트": ["도트", "물방울"],
    "레이스": ["레이스"],
    "프릴": ["프릴", "러플"],
    "플리츠": ["플리츠", "주름"],
    "데님": ["데님", "청"],
    "니트": ["니트"],
    "셔츠": ["셔츠"],
}
COLOR_WORDS = {
    "블랙": ["블랙", "검정", "검은"],
    "화이트": ["화이트", "흰", "백색"],
    "베이지": ["베이지", "크림"],
    "네이비": ["네이비", "남색"],
    "그레이": ["그레이", "회색"],
    "브라운": ["브라운", "갈색"],
    "핑크": ["핑크", "분홍"],
    "블루": ["블루", "파란", "청색"],
    "그린": ["그린", "초록", "녹색"],
    "레드": ["레드", "빨간", "적색"],
}

# --- fixed values: message templates; {category} and {pct} are filled in ----------------------
MESSAGE_TEMPLATES = {
    ("디자인", "예쁘"): "고객 {pct}%가 인정한 세련된 디자인",
    ("디자인", "독특"): "남들과 다른 유니크한 스타일",
    ("디자인", "트렌디"): "최신 트렌드를 반영한 감각적인 디자인",
    ("품질", "좋아"): "구매 고객 {pct}%가 만족한 우수한 품질",
    ("품질", "탄탄"): "오래 입어도 변하지 않는 탄탄한 내구성",
    ("품질", "퀄리티"): "프리미엄 퀄리티, 가격 그 이상의 가치",
    ("핏", "핏이"): "{pct}%의 고객이 극찬한 완벽한 핏",
    ("핏", "슬림"): "몸매를 살려주는 슬림한 실루엣",
    ("핏", "날씬"): "날씬해 보이는 마법의 핏",
    ("가격", "가성비"): "합리적인 가격, 탁월한 선택",
    ("가격", "저렴"): "부담 없는 가격으로 즐기는 트렌드",
    ("가격", "할인"): "특별 할인가로 만나는 프리미엄",
}
MESSAGE_DEFAULT = "{category} 부문 고객 만족도 {pct}%"
SUGGESTION_TEMPLATES = {
    ("사이즈", "작아"): "사이즈 재검토 및 상세 치수 정보 제공 필요",
    ("사이즈", "짧아"): "기장 옵션 다양화 또는 길이 조절 기능 추가 검토",
    ("사이즈", "타이트"): "여유있는 핏 옵션 추가 고려",
    ("품질", "실망"): "품질 관리 강화 및 검수 프로세스 개선",
    ("품질", "싸구려"): "소재 업그레이드 및 마감 처리 개선",
    ("소재", "비침"): "안감 추가 또는 도톰한 소재로 변경 검토",
    ("소재", "답답"): "통기성 좋은 소재로 교체 검토",
    ("소재", "따가"): "피부 친화적 소재 사용 검토",
    ("색상", "다르"): "실제 색상과 유사한 상품 이미지 촬영",
    ("색상", "바랜"): "색상 유지력 강화 가공 처리",
}
SUGGESTION_DEFAULT = "{category} 관련 개선 필요"
POSITION_STRATEGIES = {
    "프리미엄": "프리미엄 이미지 강화 - 품질과 디테일 강조, VIP 프로그램 운영",
    "트렌디": "SNS 마케팅 강화 - 인플루언서 협업, 시즌별 신상품 홍보",
    "실용적": "일상 착용 사례 강조 - 리얼 리뷰 활용, 코디 제안",
    "가성비": "가격 경쟁력 홍보 - 할인 이벤트, 번들 상품 기획",
    "유니크": "차별화 포인트 강조 - 독특한 디자인 스토리텔링",
    "베이직": "기본 아이템 라인업 강화 - 사이즈/컬러 다양화",
    "영캐주얼": "젊은 감성 어필 - 밝고 활기찬 이미지, 캠퍼스룩 제안",
    "미니멀": "세련된 심플함 강조 - 고급스러운 이미지 연출",
}
POSITION_STRATEGY_DEFAULT = "브랜드 아이덴티티 강화"
AGE_STRATEGIES = {
    "10대": "학생 할인, 교복 코디 제안, 틱톡/인스타 마케팅",
    "20대": "인스타그램 중심 마케팅, 데이트룩/면접룩 스타일링",
    "30대": "오피스룩 제안, 품질과 실용성 강조, 네이버 블로그 마케팅",
    "40대": "품격있는 이미지, 체형 커버 강조, 카페/블로그 마케팅",
}
AGE_STRATEGY_DEFAULT = "타겟 연령층 맞춤 마케팅"
ADVANTAGE_TEMPLATE = "{category} - {keyword}"
ADVANTAGE_USAGE_TEMPLATE = "마케팅 카피에 활용 ({pct}% 고객 만족)"
STRENGTH_TYPE = "강점"

# --- fixed values: relative date words and review field patterns ------------------------------
AGO_WORD = "전"
HOUR_WORDS = ["시간"]
DAY_WORDS = ["일"]
WEEK_WORDS = ["주"]
MONTH_WORDS = ["개월", "달"]
RATING_PATTERN = r"(\d+)점|별(\d+)|★(\d+)|평점.*?(\d+)"

# --- fixed values: page patterns (attribute names and element selectors) ----------------------
CARD_CLASS = "gtm-view-item-list"
CARD_ATTRIBUTES = {
    "product_id": "data-item-id",
    "brand": "data-item-brand",
    "price": "data-price",
    "list_price": "data-original-price",
    "discount_pct": "data-discount-rate",
}
CARD_NAME_ATTRIBUTE = "aria-label"
CARD_NAME_SUFFIX = "상품상세로 이동"

DISPLAY_CARD = "div.sc-igtioI.eSJwIO"
DISPLAY_LINK = "a.gtm-view-item-list, a.gtm-select-item"
DISPLAY_BRAND = 'a[aria-label$="샵으로 이동"] span'
DISPLAY_NAME = 'a[aria-label$="상품상세로 이동"] span'
DISPLAY_PRICE = "div.sc-hKDTPf span.text-body_13px_semi.text-red + span.text-body_13px_semi"
DISPLAY_DISCOUNT = "span.text-body_13px_semi.text-red"
LOOSE_BRAND = 'a[aria-label$="샵으로 이동"] span, span.text-etc_11px_semibold'
LOOSE_NAME = 'a[aria-label$="상품상세로 이동"] span, span.text-body_13px_reg'
LOOSE_PRICE = "span[aria-label], span.text-body_13px_semi.sc-gwsNht"
LOOSE_DISCOUNT = "span.text-body_13px_semi.text-red, span.text-body_13px_semi.sc-gwsNht.text-red"
LOOSE_RATING = "span.text-etc_11px_reg.text-yellow"
LOOSE_REVIEWS = "span.text-etc_11px_reg.text-yellow+span"

BASIC_BLOCK = [
    "div[class*='review-list-item__Container']", "div[class*='review-list']",
    "div[class*='review-item']", "div[class*='ReviewItem']", "div[class*='review_list']",
    "li[class*='review']", "article[class*='review']", "div.review", "div[data-testid*='review']",
]
BASIC_TEXT = "div[class*='Content'], div[class*='content'], div[class*='Text'], div[class*='text'], p"
BASIC_STARS = "svg[class*='star'], svg[class*='Star'], span[class*='star']"
BASIC_AUTHOR = "span[class*='user'], span[class*='name'], div[class*='writer']"
BASIC_DATE = "span[class*='date'], span[class*='time'], time"
BASIC_OPTION = "span[class*='option'], div[class*='option']"

ENHANCED_BLOCK = [
    "div[class*='review-list-item']", "div[class*='review-item']", "li[class*='review']",
    "article[class*='review']", "div[class*='ReviewItem']",
]
ENHANCED_TEXT = [
    "div[class*='content']", "div[class*='Content']", "div[class*='text']", "div[class*='Text']",
    "p[class*='review']", "span[class*='review']", "div[class*='body']",
]
ENHANCED_STARS = "svg[class*='star'], svg[class*='Star'], span[class*='star-fill']"
ENHANCED_RATING = "span[class*='rating'], div[class*='score']"
ENHANCED_AUTHOR = [
    "span[class*='user']", "span[class*='name']", "div[class*='writer']", "span[class*='author']",
    "div[class*='nickname']",
]
ENHANCED_DATE = [
    "span[class*='date']", "span[class*='time']", "time", "div[class*='date']",
    "span[class*='created']",
]
ENHANCED_OPTION = [
    "span[class*='option']", "div[class*='option']", "span[class*='variant']",
    "div[class*='purchase']",
]
ENHANCED_HELPFUL = "span[class*='helpful'], button[class*='like']"
ENHANCED_IMAGE = "img[class*='review'], img[alt*='리뷰']"
