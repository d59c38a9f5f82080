"""Closed vocabularies: tags, levels, roles, rules, patterns and word lists.

Every lookup that runs on data is offered as a native ``Column`` expression, so
no join is needed to go from a tag to its level or weight.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwright.sources.local import local_frame

# --- Fixed values ---------------------------------------------------------
LEVELS = ("HIGH", "MEDIUM", "LOW", "NONE")

# tag -> (sensitivity level, severity weight)
TAGS = {
    "RESIDENT_ID": ("HIGH", 9),
    "PHONE": ("MEDIUM", 5),
    "EMAIL": ("MEDIUM", 4),
    "HEALTH_INSURANCE_ID": ("HIGH", 7),
    "NAME": ("MEDIUM", 3),
    "ADDRESS": ("LOW", 2),
    "SALARY": ("HIGH", 6),
    "DOB": ("LOW", 1),
    "NONE": ("NONE", -2),
}
NONE_TAG, NONE_LEVEL, NONE_WEIGHT = "NONE", "NONE", -2

# Tags with a strict format, in detection order, and the pattern of the
# stripped value. Digits are Unicode decimal digits.
STRICT_PATTERNS = {
    "RESIDENT_ID": r"0\p{Nd}{11}",
    "PHONE": r"(?:03|05|07|08|09)\p{Nd}{8}",
    "EMAIL": r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}",
    "HEALTH_INSURANCE_ID": r"[A-Z]{2}\p{Nd}{13}",
}
STRICT_TAGS = tuple(STRICT_PATTERNS)

# Tags decided by meaning rather than by format alone.
SEMANTIC_TAGS = ("NAME", "ADDRESS", "SALARY", "DOB")

MASKING_RULES = ("HASH_MASK", "REDACTED_MASK", "NULLIFY_MASK", "PARTIAL_MASK", "CLEAR_TEXT")
REDACTED = "REDACTED"
INVALID_DATA = "[INVALID_DATA]"

ROLES = {
    "ADMIN": "Full-access administrator",
    "ANALYST": "Data analyst",
    "AUDITOR": "Information security auditor",
}

# role -> level -> masking rule
POLICIES = {
    "ADMIN": {"HIGH": "CLEAR_TEXT", "MEDIUM": "CLEAR_TEXT", "LOW": "CLEAR_TEXT", "NONE": "CLEAR_TEXT"},
    "ANALYST": {"HIGH": "HASH_MASK", "MEDIUM": "NULLIFY_MASK", "LOW": "HASH_MASK", "NONE": "CLEAR_TEXT"},
    "AUDITOR": {"HIGH": "PARTIAL_MASK", "MEDIUM": "PARTIAL_MASK", "LOW": "REDACTED_MASK", "NONE": "CLEAR_TEXT"},
}

SUCCESS, UNDETERMINED = "SUCCESS", "UNDETERMINED"
METHOD_LLM, METHOD_REGEX, METHOD_HYBRID = "LLM", "REGEX", "HYBRID"

REASON_REGEX = "Detected PII fully by Regex"
REASON_LLM = "Detected PII fully by LLM"
REASON_AMBIGUOUS_PII = "Detected PII by LLM and Regex, finally chosen by Regex"
REASON_AMBIGUOUS_NONE = "Regex detected PII but LLM did not detect any"
REASON_FULLY_NONE = "No PII detected by Regex or LLM"

# Acceptance targets: metric -> (target, direction)
SLA_TARGETS = {
    "precision": (0.85, ">="),
    "recall": (0.90, ">="),
    "f1_score": (0.87, ">="),
    "level_accuracy": (0.80, ">="),
    "masking_compliance": (100.0, ">="),
    "no_over_masking": (100.0, ">="),
    "overhead_pct": (20.0, "<"),
    "mean_latency_ms": (500.0, "<"),
    "scan_seconds": (30.0, "<="),
}

DEFAULT_THRESHOLD = 0.70
DEFAULT_SAMPLE_SIZE = 200
DEFAULT_MODEL_SAMPLE_SIZE = 5

# White space removed from both ends of a value before it is matched, as the
# body of a regular-expression character class.
WHITESPACE = (
    r"\t\n\x0B\f\r\x1C-\x1F \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
    r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
)

# Family names that open a personal name.
FAMILY_NAMES = (
    "Nguyễn", "Trần", "Lê", "Phạm", "Hoàng", "Huỳnh", "Phan", "Vũ", "Võ", "Đặng", "Bùi", "Đỗ",
    "Hồ", "Ngô", "Dương", "Lý", "Đinh", "Đoàn", "Trương", "Lâm", "Mai", "Trịnh", "Đào", "Cao",
    "Tạ", "Phùng", "Tô", "Chu", "Châu", "Quách", "Thái", "Lương", "Lưu", "Vương", "Hà", "Tăng",
)

# Words that name an administrative unit or a street in an address.
ADDRESS_UNITS = ("Quận", "Phường", "Xã", "Huyện", "Thị trấn", "Thị xã", "Thành phố", "Tỉnh",
                 "Đường", "TP.", "TX.", "Street", "Ward", "District", "Province")

# Words that open the name of an organisation; such a value is no address.
ORGANISATION_WORDS = ("UBND", "Sở", "Bộ", "Chi cục", "Công an", "Công ty", "Bệnh viện", "Phòng khám",
                      "Ngân hàng", "Trường", "Đại học", "Kho bạc")

PROVINCES = (
    "An Giang", "Bà Rịa - Vũng Tàu", "Bạc Liêu", "Bắc Giang", "Bắc Kạn", "Bắc Ninh", "Bến Tre",
    "Bình Dương", "Bình Định", "Bình Phước", "Bình Thuận", "Cà Mau", "Cao Bằng", "Cần Thơ",
    "Đà Nẵng", "Đắk Lắk", "Đắk Nông", "Điện Biên", "Đồng Nai", "Đồng Tháp", "Gia Lai", "Hà Giang",
    "Hà Nam", "Hà Nội", "Hà Tĩnh", "Hải Dương", "Hải Phòng", "Hậu Giang", "Hòa Bình", "Hồ Chí Minh",
    "Hưng Yên", "Khánh Hòa", "Kiên Giang", "Kon Tum", "Lai Châu", "Lạng Sơn", "Lào Cai", "Lâm Đồng",
    "Long An", "Nam Định", "Nghệ An", "Ninh Bình", "Ninh Thuận", "Phú Thọ", "Phú Yên", "Quảng Bình",
    "Quảng Nam", "Quảng Ngãi", "Quảng Ninh", "Quảng Trị", "Sóc Trăng", "Sơn La", "Tây Ninh",
    "Thái Bình", "Thái Nguyên", "Thanh Hóa", "Thừa Thiên Huế", "Tiền Giang", "Trà Vinh",
    "Tuyên Quang", "Vĩnh Long", "Vĩnh Phúc", "Yên Bái",
)
# --- End of fixed values --------------------------------------------------

# Whole words of a lower-cased column name that support a tag, in English and Vietnamese; chosen freely.
NAME_CUES = {
    "RESIDENT_ID": ("citizen_id", "national_id", "identity_number", "id_number", "passport_no", "so_can_cuoc", "cccd"),
    "PHONE": ("phone", "phone_number", "telephone", "cell", "mobile", "hotline", "dien_thoai", "so_may"),
    "EMAIL": ("email", "e_mail", "mailbox", "hop_thu"),
    "HEALTH_INSURANCE_ID": ("insurance_number", "insurance_card", "health_card", "the_bao_hiem", "bhyt"),
    "NAME": ("full_name", "first_name", "last_name", "surname", "name", "patient", "employee", "teacher", "student",
             "doctor", "customer", "ho_ten", "ten", "nguoi_benh", "sinh_vien"),
    "ADDRESS": ("address", "street", "residence", "home_town", "city", "province", "dia_chi", "noi_o", "que_quan"),
    "SALARY": ("salary", "wage", "pay", "earnings", "bonus", "tien_luong", "luong"),
    "DOB": ("birth", "birthday", "birth_date", "dob", "born", "ngay_sinh", "nam_sinh"),
}

_WS = f"[{WHITESPACE}]*"


def whole_value(pattern: str) -> str:
    """Regular expression for a value that is ``pattern`` once stripped."""
    return rf"^{_WS}(?:{pattern}){_WS}\z"


def _words(words) -> str:
    return "|".join(w.replace(".", r"\.") for w in words)


# Per-value patterns of the semantic tags; ``\z`` and ``\p{..}`` mean the same
# in Java and in RE2, so the same text serves both engines.
_YEAR = r"(?:19[3-9]\p{Nd}|200\p{Nd}|2010)"
_MONTH = r"(?:0?[1-9]|1[0-2])"
_DAY = r"(?:0?[1-9]|[12]\p{Nd}|3[01])"
_WORD = r"\p{Lu}[\p{L}\p{M}]*"

_DATE = rf"{_YEAR}[-/.]{_MONTH}[-/.]{_DAY}|{_DAY}[-/.]{_MONTH}[-/.]{_YEAR}"
_PAY = r"[1-9]\p{Nd}{3,5}000"

DOB_PATTERN = whole_value(_DATE)
SALARY_PATTERN = whole_value(_PAY)
# Any of the formats that are made of digits, with or without a letter prefix.
NUMERIC_PATTERN = whole_value(
    "|".join([*(p for t, p in STRICT_PATTERNS.items() if t != "EMAIL"), _DATE, _PAY])
)
SHORTEST_NUMERIC = 7
NAME_PATTERN = whole_value(rf"(?:{_words(FAMILY_NAMES)})(?: {_WORD}){{1,3}}")
# Anchored: an address opens with a unit, or with a number and a street, or names
# its unit or province behind its first commas. What follows may be of any length.
_PARTS = r"(?:[^,]*, ?){0,3}"
_UNIT = rf"(?:{_words(ADDRESS_UNITS)})(?:[ ,.]|\z)"
ADDRESS_PATTERN = (
    rf"^{_WS}(?:{_PARTS}{_UNIT}|\p{{Nd}}[^,]*[ ]{_UNIT}|{_PARTS}(?:{_words(PROVINCES)})(?:,|{_WS}\z))"
)
ORGANISATION_PATTERN = rf"^{_WS}(?:{_words(ORGANISATION_WORDS)})(?: |\z)"

# How far the format alone speaks for the tag once most values carry it:
# confidence = base + (1 - base) * share of matching values.
SEMANTIC_BASE = {
    "RESIDENT_ID": 0.6,
    "PHONE": 0.6,
    "EMAIL": 0.6,
    "HEALTH_INSURANCE_ID": 0.6,
    "NAME": 0.4,
    "ADDRESS": 0.4,
    "SALARY": 0.0,
    "DOB": 0.3,
}
CUE_BONUS = 0.1
# The median year of dates of birth in a column that its name does not tell is at most this one.
BIRTH_MEDIAN = 1990
EARLY_YEAR_PATTERN = r"19[3-8]\p{Nd}|1990"
# So many different values, or this share of a short column's, make names or addresses of more than a category.
MANY_VALUES = 20
MANY_SHARE = 0.5
MAJORITY_SHARE = 0.5
CONFIDENCE_GATE = 0.7


def name_cue_pattern(tag: str) -> str:
    return rf"(?:^|[^a-z0-9])(?:{'|'.join(NAME_CUES[tag])})(?:[^a-z0-9]|\z)"


def _lookup(tag: Column, position: int, default) -> Column:
    pairs = ", ".join(f"'{name}', {row[position]!r}" for name, row in TAGS.items())
    return F.coalesce(F.expr(f"map({pairs})")[tag], F.lit(default))


def level_of(tag: Column) -> Column:
    """Sensitivity level of a tag; an unknown tag or null gives NONE."""
    return _lookup(tag, 0, NONE_LEVEL)


def weight_of(tag: Column) -> Column:
    """Severity weight of a tag; an unknown tag or null gives -2."""
    return _lookup(tag, 1, NONE_WEIGHT)


def policies_frame(spark: SparkSession) -> DataFrame:
    """The seeded role x level policies (12 rows)."""
    rows = [(r, lv, rule) for r, levels in POLICIES.items() for lv, rule in levels.items()]
    return local_frame(spark, rows, "role_name string, sensitivity_level string, masking_rule string")


def roles_frame(spark: SparkSession) -> DataFrame:
    return local_frame(spark, list(ROLES.items()), "role_name string, role_description string")
