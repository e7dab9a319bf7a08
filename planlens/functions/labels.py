"""Display labels of codes, and the notices that go with a result."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from planlens.functions.scoring import UNDECIDED

c = F.col

# The codes with their labels.
REGIONS = {
    "SEOUL": "서울",
    "BUSAN": "부산",
    "DAEGU": "대구",
    "INCHEON": "인천",
    "GWANGJU": "광주",
    "DAEJEON": "대전",
    "ULSAN": "울산",
    "SEJONG": "세종",
    "GYEONGGI": "경기",
    "GANGWON": "강원",
    "CHUNGBUK": "충북",
    "CHUNGNAM": "충남",
    "JEONBUK": "전북",
    "JEONNAM": "전남",
    "GYEONGBUK": "경북",
    "GYEONGNAM": "경남",
    "JEJU": "제주",
}
TYPES = {
    "CULTURE_ART": "문화예술",
    "NATURE_ECOLOGY": "자연생태",
    "COMMUNITY": "주민화합",
    "TRADITION_HISTORY": "전통역사",
    "LOCAL_SPECIALTY": "지역특산물",
}
VENUES = {
    "VILLAGE": "마을형",
    "GREEN": "녹지형",
    "WATERFRONT": "수변형",
    "INDEPENDENT": "독립형",
    "OTHER": "기타",
    "UNDECIDED": "미정",
}
TIERS = {
    1: "동일 시군구·유형·장소",
    2: "동일 시도·유형·장소",
    3: "전국·유형·장소",
    4: "동일 시도·유형",
    5: "전국·유형",
    6: "전체 유사도",
}
# Days that a request may have at least, and should have at most.
DURATIONS = {"minimum": 2, "maximum_recommended": 180}
# When and what a result warns of.
FEW_SAMPLES, FEW_NATIONAL = 8, 10
SAMPLE_BASIS = "%d개 유사 축제 데이터 기반"
TYPE_BASIS = "축제 유형: %s"
REGION_BASIS = "지역: %s"
VENUE_BASIS = "장소 유형: %s"
SMALL_SAMPLE = "유사 축제 표본이 %d건으로 적어 추정 정확도가 낮을 수 있습니다."
OPEN_VENUE = "장소 유형이 미정으로 지정되어 추정 범위가 넓어질 수 있습니다."
NO_SAMPLE = "유사한 축제 데이터가 없어 예산을 추정할 수 없습니다."
FEW_OF_TYPE = "전국 %s 축제 표본이 %d건뿐입니다. 추천 근거가 약할 수 있습니다."
NONE_IN_REGION = "%s에는 %s 축제 사례가 없습니다. 지역 대비 차별화가 아니라 전국 사례 기준으로만 추천합니다."


def label(code: Column, names: dict) -> Column:
    """The label of a code; a code without one is its own label."""
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in names.items() for x in kv)), code), code.cast("string"))


def estimate_basis(samples: Column, kind: Column, region: Column, venue: Column) -> Column:
    """What an estimate rests on; empty without a sample."""
    lines = F.array(F.format_string(SAMPLE_BASIS, samples), F.format_string(TYPE_BASIS, kind), F.format_string(REGION_BASIS, region), F.format_string(VENUE_BASIS, venue))
    return F.when(samples > 0, lines).otherwise(F.array().cast("array<string>"))


def estimate_warnings(samples: Column, venue: Column, undecided: str = UNDECIDED) -> Column:
    small, open_ = F.when(samples < FEW_SAMPLES, F.format_string(SMALL_SAMPLE, samples)), F.when(venue == undecided, OPEN_VENUE)
    return F.when(samples > 0, F.array_compact(F.array(small, open_))).otherwise(F.array(F.lit(NO_SAMPLE)))


def cohort_warnings(national: Column, regional: Column, region: Column, kind: Column) -> Column:
    """Of too few records of the type in all, and of none in the region."""
    few = F.when(national < FEW_NATIONAL, F.format_string(FEW_OF_TYPE, label(kind, TYPES), national))
    none = F.when(regional == 0, F.format_string(NONE_IN_REGION, label(region, REGIONS), label(kind, TYPES)))
    return F.array_compact(F.array(few, none))
