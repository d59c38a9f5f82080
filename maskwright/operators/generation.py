"""Labelled test data as native expressions over a row id.

Every value is a pure function of (id, seed): rows can be made in any task, in
any order, and made again after an executor is lost. All arithmetic is on
64-bit integers, so another SQL engine gives the same values.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import isqrt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwright import vocab as V
from maskwright.functions.masking import column_ref
from maskwright.functions.text import slugify
from maskwright.sources.local import local_frame

# Pools of the value makers, chosen freely: only the formats are given.
MIDDLE_NAMES = ("Hữu", "Đình", "Khánh", "Phương", "Gia", "Bảo", "Kim", "Thùy", "Công", "Diệu", "Nhật", "Tường")
GIVEN_NAMES = ("Khôi", "Trâm", "Phúc", "Vy", "Quân", "Hạnh", "Kiên", "Thư", "Tuấn", "Uyên", "Lộc", "Nhung", "Vinh",
               "Oanh", "Tâm", "Đạt", "Giang", "Hiếu", "Loan", "Thịnh")
STREETS = ("Phan Đình Phùng", "Tôn Đức Thắng", "Lạc Long Quân", "Hoàng Diệu", "Điện Biên Phủ", "Pasteur", "Kim Mã",
           "Võ Văn Tần", "Hùng Vương", "Láng Hạ", "Bạch Đằng", "Quang Trung", "Xô Viết Nghệ Tĩnh")
WARDS = ("Phường Thảo Điền", "Phường Tân Định", "Phường Kim Liên", "Xã Tân Phú Trung", "Thị trấn Củ Chi",
         "Phường Hải Châu 1", "Xã Đông Anh", "Phường An Khánh", "Thị trấn Sa Pa", "Xã Vĩnh Lộc A")
DISTRICTS = ("Quận Bình Thạnh", "Quận Cầu Giấy", "Huyện Hóc Môn", "Thị xã Sơn Tây", "Quận Hải An", "Huyện Củ Chi",
             "Quận 7", "Thành phố Thủ Đức", "Huyện Gia Lâm", "Quận Ninh Kiều")
PUBLIC_MAIL = ("icloud.com", "zoho.com", "fastmail.com", "gmx.net", "mail.com")
WORK_MAIL = ("congty-songhong.vn", "thepmiennam.com.vn", "nongsan-taynguyen.vn", "logistics-bienxanh.com")
PHONE_PREFIXES = ("033", "034", "036", "037", "039", "052", "059", "076", "078", "082", "083", "086", "089", "093", "096", "097")

# --- Fixed values: formats and codes ----------------------------------------
INSURANCE_GROUPS = ("GD", "DN", "CH", "HC", "XK")
AMOUNTS = (50, 100, 200, 500, 1000, 2000, 5000, 10000, 20000, 50000, 100000)
STATUS_CODES = ("200", "400", "404", "500")
# --- End of fixed values ---------------------------------------------------

_P1, _P2 = 2147483647, 2147483629  # primes below 2^31


def draw(row_id: Column, salt: int) -> Column:
    """A repeatable scattered integer in [0, 2^31) per (id, salt).

    The id is taken in two digits to the base of a prime below 2^31, each with a
    multiplier of its own per salt, so ids far apart draw apart; the product of
    two numbers below 2^31 never leaves 64 bits.
    """
    low, high = (1103515245 + 265443577 * salt) % _P2, (1566083941 + 387420489 * salt) % _P2
    upper = F.call_function("div", row_id, F.lit(_P1)) % F.lit(_P2) * F.lit(high) % F.lit(_P2)
    return (F.pmod(row_id, F.lit(_P1)) * F.lit(low) + upper + F.lit(12345 + 7919 * salt)) % F.lit(_P2)


def pick(pool, row_id: Column, salt: int) -> Column:
    options = F.array(*[F.lit(x) for x in pool])
    return F.element_at(options, (draw(row_id, salt) % len(pool) + 1).cast("int"))


def between(low: int, high: int, row_id: Column, salt: int) -> Column:
    """Integer in [low, high]; the range must be below 2^31."""
    return draw(row_id, salt) % (high - low + 1) + low


def _digits(value: Column, width: int) -> Column:
    return F.lpad(value.cast("string"), width, "0")


def make_name(i: Column, s: int) -> Column:
    return F.concat_ws(" ", pick(V.FAMILY_NAMES, i, s), pick(MIDDLE_NAMES, i, s + 1), pick(GIVEN_NAMES, i, s + 2))


def _birth_date(i: Column, s: int) -> Column:
    return F.date_add(F.lit("1960-01-01").cast("date"), between(0, 16060, i, s).cast("int"))


def make_dob(i: Column, s: int) -> Column:
    return _birth_date(i, s).cast("string")


def make_resident_id(i: Column, s: int) -> Column:
    """0 + two-digit province + one digit 0..3 + birth year + six digits."""
    year = F.substring(_birth_date(i, s + 2).cast("string"), 3, 2)
    return F.concat(
        F.lit("0"), _digits(between(1, 96, i, s), 2), between(0, 3, i, s + 1).cast("string"),
        year, _digits(between(0, 999999, i, s + 3), 6),
    )


def make_phone(i: Column, s: int) -> Column:
    return F.concat(pick(PHONE_PREFIXES, i, s), between(1000000, 9999999, i, s + 1).cast("string"))


def make_email(i: Column, s: int) -> Column:
    number = between(1, 999, i, s + 3).cast("string")
    return F.concat(slugify(make_name(i, s)), number, F.lit("@"), pick(PUBLIC_MAIL, i, s + 4))


def make_work_email(i: Column, s: int) -> Column:
    return F.concat(slugify(make_name(i, s)), F.lit("@"), pick(WORK_MAIL, i, s + 4))


def make_health_insurance_id(i: Column, s: int) -> Column:
    return F.concat(
        pick(INSURANCE_GROUPS, i, s),
        _digits(between(0, 9999999, i, s + 1), 7), _digits(between(0, 999999, i, s + 2), 6),
    )


def make_address(i: Column, s: int) -> Column:
    """House number and street, ward, district, province."""
    return F.concat(
        between(1, 500, i, s).cast("string"), F.lit(" "), pick(STREETS, i, s + 1),
        F.lit(", "), pick(WARDS, i, s + 2), F.lit(", "), pick(DISTRICTS, i, s + 3), F.lit(", "), pick(V.PROVINCES, i, s + 4),
    )


def make_salary(i: Column, s: int) -> Column:
    return (between(5, 100, i, s) * 500000).cast("string")


def make_id(prefix: str):
    return lambda i, s: F.concat(F.lit(prefix + "-"), between(100000, 999999, i, s).cast("string"))


def make_ip(i: Column, s: int) -> Column:
    return F.concat_ws(".", *[between(1, 254, i, s + k).cast("string") for k in range(4)])


def make_device_hash(i: Column, s: int) -> Column:
    return F.md5(draw(i, s).cast("string"))


def make_amount(i: Column, s: int) -> Column:
    return (pick(AMOUNTS, i, s) * 1000).cast("string")


def make_batch_id(i: Column, s: int) -> Column:
    return F.concat(F.lit("BATCH-"), between(1000, 9999, i, s).cast("string"))


def make_decision_no(i: Column, s: int) -> Column:
    return F.concat(between(100, 999, i, s).cast("string"), F.lit("/QĐ-UBND"))


def make_household_no(i: Column, s: int) -> Column:
    number = between(100000, 999999, i, s + 1).cast("string")
    return F.concat(F.lit("0"), _digits(between(1, 96, i, s), 2), F.lit("/"), number)


def make_badge(i: Column, s: int) -> Column:
    year = between(2021, 2025, i, s).cast("string")
    return F.concat(F.lit("NV-"), year, F.lit("-"), _digits(between(1, 9999, i, s + 1), 4))


def one_of(*pool: str):
    return lambda i, s: pick(pool, i, s)


def number(low: int, high: int):
    return lambda i, s: between(low, high, i, s).cast("string")


def prefixed(prefix: str, low: int, high: int):
    return lambda i, s: F.concat(F.lit(prefix), between(low, high, i, s).cast("string"))


MAKERS = {
    "RESIDENT_ID": make_resident_id,
    "PHONE": make_phone,
    "EMAIL": make_email,
    "HEALTH_INSURANCE_ID": make_health_insurance_id,
    "NAME": make_name,
    "ADDRESS": make_address,
    "SALARY": make_salary,
    "DOB": make_dob,
}

NOISE_MAKERS = {
    "record_id": make_id("SYS"),
    "ip": make_ip,
    "device_hash": make_device_hash,
    "amount": make_amount,
    "batch": make_batch_id,
    "decision": make_decision_no,
    "household": make_household_no,
    "badge": make_badge,
    "status_code": one_of(*STATUS_CODES),
    "boolean": one_of("true", "false"),
    "retry_count": number(0, 5),
}


def gen_values(tag: str, row_id: Column, seed: int = 42) -> Column:
    """A value of the given tag for each row id."""
    return MAKERS[tag](row_id, seed)


def gen_noise(kind: str, row_id: Column, seed: int = 42) -> Column:
    """A value without personal data of the given kind for each row id."""
    return NOISE_MAKERS[kind](row_id, seed)


def mixed_noise(row_id: Column, seed: int) -> Column:
    """Noise of one of four kinds per row, all made from a single draw."""
    d = draw(row_id, seed)
    kind = F.shiftright(d, 28) % 4
    bytes_ = [(F.shiftright(d, 7 * k) % 254 + 1).cast("string") for k in range(4)]
    return (
        F.when(kind == 0, F.concat(F.lit("NOISE-"), (d % 900000 + 100000).cast("string")))
        .when(kind == 1, F.concat_ws(".", *bytes_))
        .when(kind == 2, F.md5(d.cast("string")))
        .otherwise((F.element_at(F.array(*[F.lit(x) for x in AMOUNTS]), (d % len(AMOUNTS) + 1).cast("int")) * 1000)
                   .cast("string"))
    )


#: A prime below 2^26, so that the square of a number below it is exact as a double, and the multiplier of each round.
FEISTEL_PRIME = 67108859
FEISTEL_ROUNDS = (48271, 69621, 16807, 39373)


def feistel_addend(key: int, k: int) -> int:
    """What round ``k`` adds under ``key``."""
    return (key * 7919 + 104729 * (k + 1)) % FEISTEL_PRIME


def feistel_shape(n_rows: int) -> tuple[int, int]:
    """Two factors near the square root of ``n_rows`` whose product exceeds it least."""
    root = max(1, isqrt(n_rows))
    return min(((left, -(-n_rows // left)) for left in range(max(1, root - 1000), root + 1)), key=lambda x: (x[0] * x[1], -x[0]))


def permuted(row_id: Column, n_rows: int, key: int) -> Column:
    """A keyed permutation of 0..n_rows-1: a Feistel network over pairs of digits, each round adding a keyed square of
    one digit to the other, with cycle walking.

    The pairs are ``excess`` more than the ids. An id that falls among them is sent through the network again; it can
    meet no more than ``excess`` of them in a row, so that many steps always lead back."""
    left, right = feistel_shape(n_rows)

    def mixed(digit: Column, k: int, modulus: int) -> Column:
        # pow instead of a product, so that a digit is named once and the plan holds no copies of the rounds before
        y = (digit * F.lit(FEISTEL_ROUNDS[k]) + F.lit(feistel_addend(key, k))) % F.lit(FEISTEL_PRIME)
        return F.pow(y, F.lit(2)).cast("bigint") % F.lit(FEISTEL_PRIME) % F.lit(modulus)

    def once(place: Column) -> Column:
        a, b = F.call_function("div", place, F.lit(right)), place % F.lit(right)
        for k in range(0, len(FEISTEL_ROUNDS), 2):
            a = (a + mixed(b, k, left)) % F.lit(left)
            b = (b + mixed(a, k + 1, right)) % F.lit(right)
        return a * F.lit(right) + b

    place, excess = once(row_id.cast("bigint")), left * right - n_rows
    if not excess:
        return place
    steps = F.sequence(F.lit(1), F.lit(excess))
    return F.aggregate(steps, place, lambda at, _: F.when(at < F.lit(n_rows), at).otherwise(once(at)))


def is_chosen(row_id: Column, n_rows: int, match_pct: int, salt: int = 0) -> Column:
    """True for exactly ``int(n_rows * match_pct / 100)`` of the ids 0..n_rows-1.

    The ids are permuted, so the exact share is scattered over the table without ranking, sorting or shuffling it."""
    if n_rows <= 0:
        return F.lit(False)
    return permuted(row_id, n_rows, salt) < F.lit(int(n_rows * match_pct / 100))


@dataclass(frozen=True)
class ColumnSpec:
    """One generated column: its tag, its share of valid values, its maker.

    ``follows`` names the column that it agrees with in every row: an e-mail the
    name it is made from, a resident number the birth date whose year it holds."""

    column_name: str
    sensitivity_tag: str
    match_percentage: int = 100
    maker: object = None
    regex_status: str = V.UNDETERMINED
    detection_method: str = V.METHOD_HYBRID
    expected_regex_score: float = 0.0
    follows: str | None = None


def gen_column(spec: ColumnSpec, row_id: Column, n_rows: int, seed: int = 42) -> Column:
    """``int(n * pct / 100)`` valid values, mixed noise in the other rows."""
    maker = spec.maker or MAKERS.get(spec.sensitivity_tag, make_ip)
    valid = maker(row_id, seed)
    if spec.match_percentage >= 100:
        return valid
    chosen = is_chosen(row_id, n_rows, spec.match_percentage, seed)
    return F.when(chosen, valid).otherwise(mixed_noise(row_id, seed + 50))


def gen_columns(ids: DataFrame, specs: list[ColumnSpec], n_rows: int, id_column: str = "id", seed: int = 42):
    """Add one generated column per spec to a frame whose ids are 0..n_rows-1."""
    row_id = column_ref(id_column)
    return ids.select(*[
        gen_column(s, row_id, n_rows, seed_of(specs, k, seed)).alias(s.column_name) for k, s in enumerate(specs)
    ])


def seed_of(specs: list[ColumnSpec], k: int, seed: int) -> int:
    """The seed of the ``k``-th column; one that follows another draws the shared part alike."""
    followed = specs[k].follows
    if followed is None:
        return seed + 100 * k
    at = next(i for i, s in enumerate(specs) if s.column_name == followed)
    # a resident number draws its birth date two salts on
    return seed_of(specs, at, seed) - (2 if specs[k].sensitivity_tag == "RESIDENT_ID" else 0)


def gen_table(spark: SparkSession, specs: list[ColumnSpec], n_rows: int, seed: int = 42) -> DataFrame:
    """A labelled table of ``n_rows`` rows, made by the executors."""
    return gen_columns(spark.range(n_rows), specs, n_rows, "id", seed)


def truth_frame(spark: SparkSession, table: str, specs: list[ColumnSpec]) -> DataFrame:
    """(table_name, column_name, sensitivity_tag, sensitivity_level)."""
    rows = [(table, s.column_name, s.sensitivity_tag, V.TAGS[s.sensitivity_tag][0]) for s in specs]
    return local_frame(
        spark, rows, "table_name string, column_name string, sensitivity_tag string, sensitivity_level string"
    )


def expectations_frame(spark: SparkSession, table: str, specs: list[ColumnSpec]) -> DataFrame:
    rows = [
        (table, s.column_name, s.sensitivity_tag, s.regex_status, s.detection_method, s.expected_regex_score)
        for s in specs
    ]
    return local_frame(
        spark,
        rows,
        "table_name string, column_name string, sensitivity_tag string, regex_status string, "
        "detection_method string, expected_regex_score double",
    )


def emit_truth(spark: SparkSession, table: str, specs: list[ColumnSpec], n_rows: int, path: str) -> None:
    """Write the ground truth of one table as a JSON document."""
    column = F.struct("column_name", "sensitivity_tag", "sensitivity_level")
    truth_frame(spark, table, specs).agg(
        F.collect_list(column).alias("columns")  # one entry per configured column
    ).select(
        F.lit(table).alias("table_name"),
        F.lit(len(specs)).alias("total_columns"),
        F.lit(n_rows).cast("bigint").alias("total_rows"),
        "columns",
    ).write.mode("overwrite").json(path)
