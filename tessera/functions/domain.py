"""Domain column functions: date-time groups, units, glossary, spelling, report forms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .dictionary import holders

# Months, and how date-time groups and ISO times look.
MONTHS = ("JAN", "FEB", "MAR", "APR", "MAY", "JUN", "JUL", "AUG", "SEP", "OCT", "NOV", "DEC")
DTG = r"^(\d{2})(\d{2})(\d{2})([A-IK-Z])([A-Z]{3})(\d{2}|\d{4})$"
ISO = r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(?::\d{2}(?:\.\d+)?)?(?:Z|[+-]\d{2}:?\d{2})$"


def zone_hours() -> dict[str, int]:
    """Hours from UTC for each zone letter: A to I +1 to +9, K to M +10 to +12, N to Y -1 to -12, Z 0; J has none."""
    east = {c: i + 1 for i, c in enumerate("ABCDEFGHIKLM")}
    return east | {c: -i - 1 for i, c in enumerate("NOPQRSTUVWXY")} | {"Z": 0}


def zone_letter(hours: Column) -> Column:
    """The letter of an offset in whole hours; null beyond -12 to +12."""
    return F.try_element_at(_literal_map({h: c for c, h in zone_hours().items()}), hours.cast("int"))


def _literal_map(pairs: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])


def zone_key(zone: Column) -> Column:
    z = F.upper(F.trim(zone))
    return F.when(z == "KST", "I").when(z.isin("UTC", "GMT"), "Z").otherwise(z)


def parse_dtg(value: Column) -> Column:
    """DDHHMM, zone letter, month, year as a timestamp; or ISO 8601 with an offset; else null."""
    v = F.upper(F.regexp_replace(F.trim(value), " ", ""))
    part = lambda i: F.regexp_extract(v, DTG, i)
    year = part(6).try_cast("int") + F.when(F.length(part(6)) == 2, 2000).otherwise(0)
    month = F.try_element_at(_literal_map({m: i + 1 for i, m in enumerate(MONTHS)}), part(5))
    hours = F.try_element_at(_literal_map(zone_hours()), part(4))
    at = F.try_make_timestamp(year, month, part(1).try_cast("int"), part(2).try_cast("int"), part(3).try_cast("int"), F.lit(0).cast("decimal(16,6)"), F.lit("UTC"))
    grouped = at - F.make_dt_interval(F.lit(0), hours, F.lit(0), F.lit(0).cast("decimal(18,6)"))
    whole = F.regexp_replace(F.trim(value), r"^(\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2})(?!:)", "$1:00")
    iso = F.when(F.trim(value).rlike(ISO), whole).try_cast("timestamp")
    return F.when(v.rlike(DTG), grouped).otherwise(iso)


def format_dtg(at: Column, zone: Column) -> Column:
    """A timestamp as a date-time group in a zone; null for an unknown zone. Session time zone must be UTC."""
    letter = zone_key(zone)
    hours = F.try_element_at(_literal_map(zone_hours()), letter)
    local = at + F.make_dt_interval(F.lit(0), hours, F.lit(0), F.lit(0).cast("decimal(18,6)"))
    return F.concat(F.date_format(local, "ddHHmm"), letter, F.element_at(F.array(*[F.lit(m) for m in MONTHS]), F.month(local)), F.date_format(local, "yy"))


def convert_dtg(value: Column, zone: Column) -> Column:
    return format_dtg(parse_dtg(value), zone)


def current_dtg(zone: Column) -> Column:
    return format_dtg(F.current_timestamp(), zone)


# Factors to the base unit of each category (m, m/s, kg, l, deg, kPa).
UNITS = {
    "length": {"m": 1.0, "km": 1000.0, "cm": 0.01, "mm": 0.001, "mi": 1609.344, "nm": 1852.0, "nmi": 1852.0, "yd": 0.9144, "ft": 0.3048, "in": 0.0254},
    "speed": {"m/s": 1.0, "km/h": 1000.0 / 3600.0, "kph": 1000.0 / 3600.0, "mph": 1609.344 / 3600.0, "kn": 1852.0 / 3600.0, "kt": 1852.0 / 3600.0, "kts": 1852.0 / 3600.0, "ft/s": 0.3048},
    "mass": {"kg": 1.0, "g": 0.001, "t": 1000.0, "lb": 0.45359237, "oz": 0.028349523125},
    "volume": {"l": 1.0, "ml": 0.001, "gal": 3.785411784, "qt": 0.946352946},
    "angle": {"deg": 1.0, "mil": 360.0 / 6400.0, "mils": 360.0 / 6400.0, "rad": 57.29577951308232, "grad": 0.9},
    "pressure": {"kpa": 1.0, "hpa": 0.1, "mbar": 0.1, "bar": 100.0, "psi": 6.894757293168, "atm": 101.325, "mmhg": 0.133322387415, "inhg": 3.38638866667},
}
# Other names of units.
UNIT_NAMES = {
    "미터": "m", "킬로미터": "km", "마일": "mi", "해리": "nm", "야드": "yd", "피트": "ft", "인치": "in",
    "노트": "kn", "킬로그램": "kg", "파운드": "lb", "리터": "l", "갤런": "gal",
    "도": "deg", "밀": "mil", "라디안": "rad", "섭씨": "c", "화씨": "f", "켈빈": "k",
    "℃": "c", "°c": "c", "℉": "f", "°f": "f", "°": "deg",
}


def unit_table(spark: SparkSession) -> DataFrame:
    """(name, kind, factor, shift): every name of a unit, and x * factor + shift in its kind's base (degrees Celsius for heat)."""
    linear = [(u, kind, f, 0.0) for kind, units in UNITS.items() for u, f in units.items()]
    heat = [("c", "heat", 1.0, 0.0), ("f", "heat", 5 / 9, -160 / 9), ("k", "heat", 1.0, -273.15)]
    known = {u: rest for u, *rest in linear + heat}
    rows = [(u, *rest) for u, rest in known.items()] + [(name, *known[u]) for name, u in UNIT_NAMES.items()]
    return spark.createDataFrame(rows, "name string, kind string, factor double, shift double")


def with_converted(df: DataFrame, value: str, source: str, target: str, out: str = "converted") -> DataFrame:
    """df with the value of column `value` in another unit of the same kind; null for unknown units and across kinds."""
    units = unit_table(df.sparkSession)  # a fixed list of under a hundred names

    def side(col: str, tag: str) -> tuple[DataFrame, Column]:
        named = F.broadcast(units.select(*[F.col(c).alias(f"__{tag}_{c}") for c in units.columns]))
        return named, F.lower(F.trim(F.col(col))) == F.col(f"__{tag}_name")

    a, b = side(source, "a"), side(target, "b")
    joined = df.join(a[0], a[1], "left").join(b[0], b[1], "left")
    x = (F.col(value) * F.col("__a_factor") + F.col("__a_shift") - F.col("__b_shift")) / F.col("__b_factor")
    return joined.withColumn(out, F.when(F.col("__a_kind") == F.col("__b_kind"), x)).drop(*[f"__{t}_{c}" for t in "ab" for c in units.columns])


def significant(x: Column, digits: int = 4) -> Column:
    """A number rounded to so many significant digits, without trailing zeros, thousands set apart."""
    places = F.least(F.greatest(digits - 1 - F.floor(F.log10(F.abs(x))), F.lit(0)), F.lit(12)).cast("int")
    shown = F.when(x == 0, "0").otherwise(F.call_function("format_number", x, places))
    return F.when(x.isNotNull(), F.regexp_replace(F.regexp_replace(shown, r"(\.\d*?)0+$", "$1"), r"\.$", ""))


# The spelling alphabet.
SPELLING = {
    "A": "Alfa", "B": "Bravo", "C": "Charlie", "D": "Delta", "E": "Echo", "F": "Foxtrot",
    "G": "Golf", "H": "Hotel", "I": "India", "J": "Juliett", "K": "Kilo", "L": "Lima",
    "M": "Mike", "N": "November", "O": "Oscar", "P": "Papa", "Q": "Quebec", "R": "Romeo",
    "S": "Sierra", "T": "Tango", "U": "Uniform", "V": "Victor", "W": "Whiskey", "X": "X-ray",
    "Y": "Yankee", "Z": "Zulu",
    "0": "Zero", "1": "One", "2": "Two", "3": "Tree", "4": "Fower", "5": "Fife",
    "6": "Six", "7": "Seven", "8": "Ait", "9": "Niner",
    "-": "Dash", ".": "Decimal", "/": "Slant", " ": "(띄움)",
}


def spell(text: Column) -> Column:
    """Each character as its word; others stay; null for a blank text."""
    t = F.trim(text)
    words = F.transform(F.filter(F.split(t, ""), lambda c: c != ""), lambda c: F.coalesce(F.try_element_at(_literal_map(SPELLING), F.upper(c)), c))
    return F.when(t != "", F.array_join(words, " "))


def term_key(term: Column) -> Column:
    return F.upper(F.regexp_replace(F.trim(term), "[ -]", ""))


def look_up_terms(queries: DataFrame, glossary: DataFrame, limit: int = 5) -> DataFrame:
    """(query_id, place, term, full, ko, desc, exact): the term with the query's key; else up to `limit`
    terms that hold the query anywhere, in the order of the glossary (term, full, ko, desc, pos)."""
    q = queries.where(F.trim("query") != "").select("query_id", F.trim("query").alias("query"))
    key = term_key(F.col("term"))
    best = glossary.withColumn("key", key).groupBy("key").agg(F.max_by(F.struct("term", "full", "ko", "desc"), "pos").alias("e"))
    exact = q.join(best, term_key(F.col("query")) == F.col("key")).select("query_id", F.lit(1).alias("place"), "e.*", F.lit(True).alias("exact"))
    rest = q.join(exact.select("query_id"), "query_id", "left_anti")
    # What is left to find is itself a dictionary, looked for in the entries, which stay where they are.
    low = rest.withColumn("word", F.lower("query"))
    hits = holders(glossary, ["term", "full", "ko", "desc"], "pos", low.select("word").distinct(), limit)
    if hits is None:
        return exact
    first = hits.withColumn("place", F.row_number().over(Window.partitionBy("word").orderBy("pos"))).where(F.col("place") <= limit)
    entries = glossary.select(F.col("pos").cast("long").alias("pos"), "term", "full", "ko", "desc")
    near = low.join(first, "word").join(entries, "pos")
    return exact.union(near.select("query_id", "place", "term", "full", "ko", "desc", F.lit(False)))


# The report forms, their fields and their other names.
FORMS = {
    "SITREP": ("상황보고 (SITREP)", [
        ("unit", "보고 부대"), ("dtg", "일시군(DTG)"), ("enemy", "적 상황"), ("friendly", "아군 상황"), ("personnel", "인원 현황"),
        ("equipment", "장비 현황"), ("supply", "보급 현황 (탄약/유류/식량/식수)"), ("assessment", "지휘관 평가 및 건의"),
    ]),
    "SPOTREP": ("첩보보고 (SPOTREP, SALUTE 형식)", [
        ("size", "S – 규모 (Size)"), ("activity", "A – 활동 (Activity)"), ("location", "L – 위치 (Location)"), ("unit", "U – 부대/복장 (Unit/Uniform)"),
        ("time", "T – 시각 (Time, DTG)"), ("equipment", "E – 장비 (Equipment)"), ("observer", "관측자 / 보고 수단"),
    ]),
    "MEDEVAC": ("환자 후송 요청 (9-Line MEDEVAC)", [
        ("line1", "1. 착륙 지점 위치(좌표)"), ("line2", "2. 무전 주파수·호출부호"),
        ("line3", "3. 환자 수 및 긴급도 (A 긴급 / B 긴급-외과 / C 우선 / D 일상 / E 편의)"),
        ("line4", "4. 특수 장비 (A 없음 / B 호이스트(인양기) / C 구조장비 / D 인공호흡기)"), ("line5", "5. 환자 유형 (L 들것 / A 보행)"),
        ("line6", "6. 착륙 지점 안전 (N 적 없음 / P 적 가능 / E 적 활동 중 / X 호위 필요)"),
        ("line7", "7. 착륙 지점 표시 (A 패널 / B 발광 신호 / C 연막 / D 없음 / E 기타)"),
        ("line8", "8. 환자 국적·신분 (A 아군 군인 / B 아군 민간인 / C 비아군 군인 / D 비아군 민간인 / E 포로)"), ("line9", "9. 지형 특징 / NBC 오염 여부"),
    ]),
    "WARNORD": ("준비명령 (WARNORD)", [
        ("situation", "1. 상황 (적/아군 개요)"), ("mission", "2. 임무"), ("execution", "3. 실시 개요 (예상 과업, 준비 지시, 예행연습·검사 시간)"),
        ("service_support", "4. 전투근무지원 (보급 요청, 장비 준비)"), ("command_signal", "5. 지휘 및 통신 (명령 하달 시간·장소, 통신 수단)"),
    ]),
    "OPORD": ("작전명령 (OPORD, 5단락)", [
        ("situation", "1. 상황 (적 부대, 아군 부대, 배속 및 파견, 민간 고려사항)"), ("mission", "2. 임무 (누가·무엇을·언제·어디서·왜)"),
        ("execution", "3. 실시 (지휘관 의도, 작전 개념, 예하 부대 과업, 협조 지시)"), ("service_support", "4. 전투근무지원 (보급, 정비, 의무, 수송)"),
        ("command_signal", "5. 지휘 및 통신 (지휘소 위치, 지휘 승계, 통신 운용)"),
    ]),
}
# Other names of the forms.
FORM_NAMES = {
    "상황보고": "SITREP", "sitrep": "SITREP", "시트렙": "SITREP", "싯렙": "SITREP",
    "첩보보고": "SPOTREP", "spotrep": "SPOTREP", "salute": "SPOTREP", "스팟렙": "SPOTREP", "스폿렙": "SPOTREP",
    "메데박": "MEDEVAC", "medevac": "MEDEVAC", "9line": "MEDEVAC", "9-line": "MEDEVAC", "후송요청": "MEDEVAC", "환자후송": "MEDEVAC",
    "준비명령": "WARNORD", "warnord": "WARNORD", "warno": "WARNORD",
    "작전명령": "OPORD", "opord": "OPORD", "작명": "OPORD",
}
BLANK = "____________"
# Fixed value: the note under each report.
NOTE = "※ 작성 시 유의: 비밀·대외비 내용 및 실제 좌표·주파수는 인가된 체계에서만 기재합니다."


def form_kind(kind: Column) -> Column:
    return F.try_element_at(_literal_map(FORM_NAMES), F.lower(F.regexp_replace(F.trim(kind), " ", "")))


def fill_forms(requests: DataFrame) -> DataFrame:
    """requests (kind, fields: map of strings) with form, missing (labels), unknown (keys) and report.

    All are null for an unknown kind; an empty value counts as missing.
    """
    known = F.create_map(*[x for k, (_, fs) in FORMS.items() for x in (F.lit(k), F.array(*[F.struct(F.lit(f).alias("key"), F.lit(t).alias("label")) for f, t in fs]))])
    title = _literal_map({k: t for k, (t, _) in FORMS.items()})
    given = F.coalesce("fields", F.create_map().cast("map<string,string>"))
    d = requests.withColumn("form", form_kind(F.col("kind"))).withColumn("__f", F.try_element_at(known, F.col("form"))).withColumn("__g", given)
    value = lambda f: F.try_element_at(F.col("__g"), f["key"])
    empty = lambda f: F.coalesce(value(f), F.lit("")) == ""
    d = d.withColumn("missing", F.transform(F.filter("__f", empty), lambda f: f["label"]))
    d = d.withColumn("unknown", F.array_sort(F.array_except(F.map_keys("__g"), F.transform("__f", lambda f: f["key"]))))
    lines = F.transform("__f", lambda f: F.concat(f["label"], F.lit(": "), F.when(empty(f), BLANK).otherwise(value(f))))
    no = F.array().cast("array<string>")
    report = F.array_join(
        F.concat(
            F.array(F.concat(F.lit("■ "), F.try_element_at(title, F.col("form"))), F.lit("")), lines,
            F.when(F.size("missing") > 0, F.array(F.lit(""), F.concat(F.lit("※ 미기재 항목: "), F.array_join("missing", ", ")))).otherwise(no),
            F.when(F.size("unknown") > 0, F.array(F.concat(F.lit("※ 양식에 없는 항목(무시됨): "), F.array_join("unknown", ", ")))).otherwise(no),
            F.array(F.lit(""), F.lit(NOTE)),
        ),
        "\n",
    )
    return d.withColumn("report", report).drop("__f", "__g")
