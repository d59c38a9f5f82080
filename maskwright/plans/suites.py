"""Column layouts of the labelled tables: scanner suite, end-to-end, domain."""

from __future__ import annotations

from maskwright import vocab as V
from maskwright.operators.generation import (
    ColumnSpec,
    NOISE_MAKERS,
    make_id,
    make_work_email,
    number,
    one_of,
    prefixed,
)


def _strict(name: str, tag: str, pct: int) -> ColumnSpec:
    return ColumnSpec(name, tag, pct, None, V.SUCCESS, V.METHOD_REGEX, pct / 100)


def _semantic(name: str, tag: str) -> ColumnSpec:
    return ColumnSpec(name, tag, 100, None, V.UNDETERMINED, V.METHOD_LLM, 0.0)


def _noise(name: str, kind: str, pct: int = 100) -> ColumnSpec:
    return ColumnSpec(name, V.NONE_TAG, pct, NOISE_MAKERS[kind])


# --- Fixed values: column names, tags and shares; the category texts are free --
SCANNER_SUITE = [
    _strict("cccd_clean", "RESIDENT_ID", 100),
    _strict("cccd_noise_70", "RESIDENT_ID", 70),
    _strict("phone_clean", "PHONE", 100),
    _strict("phone_noise_70", "PHONE", 70),
    _strict("email_clean", "EMAIL", 100),
    _strict("email_noise_70", "EMAIL", 70),
    ColumnSpec("e8_n_65", "EMAIL", 65, None, V.UNDETERMINED, V.METHOD_HYBRID, 0.65),
    _strict("health_insurance_id_clean", "HEALTH_INSURANCE_ID", 100),
    _strict("health_insurance_id_noise_70", "HEALTH_INSURANCE_ID", 70),
    _semantic("c03", "NAME"),
    _semantic("o_text", "ADDRESS"),
    _semantic("m_val", "SALARY"),
    _semantic("info", "DOB"),
    _noise("sys_record_id", "record_id"),
    _noise("device_ip_address", "ip"),
    _noise("user_agent_hash", "device_hash"),
    _noise("status_code", "status_code"),
    _noise("is_active", "boolean"),
    _noise("retry_count", "retry_count"),
    _noise("tx_amount", "amount"),
]

END_TO_END = [
    ColumnSpec(name, tag, 85)
    for tag, names in {
        "RESIDENT_ID": ("resident_id", "r7"),
        "PHONE": ("phone_number", "p4"),
        "EMAIL": ("email_address", "e8"),
        "HEALTH_INSURANCE_ID": ("health_insurance_id", "h6"),
        "NAME": ("full_name", "c3"),
        "ADDRESS": ("address", "o2"),
        "SALARY": ("salary", "m5"),
        "DOB": ("date_of_birth", "d9"),
    }.items()
    for name in names
] + [
    _noise("sys_record_id", "record_id", 85),
    _noise("dp", "ip", 85),
    _noise("status_code", "status_code", 85),
    _noise("asi", "boolean", 85),
]


def _tagged(name: str, tag: str, maker=None, follows: str | None = None) -> ColumnSpec:
    return ColumnSpec(name, tag, 100, maker, follows=follows)


def _plain(name: str, maker) -> ColumnSpec:
    return ColumnSpec(name, V.NONE_TAG, 100, maker)


DOMAIN_TABLES = {
    "citizen_info": [
        _plain("record_id", make_id("CIT")),
        _tagged("cccd_so", "RESIDENT_ID", follows="ngay_sinh"),
        _tagged("ho_va_ten", "NAME"),
        _tagged("ngay_sinh", "DOB"),
        _plain("gioi_tinh", one_of("Nam", "Nữ")),
        _tagged("sdt_chinh", "PHONE"),
        _tagged("dia_chi_cu_tru", "ADDRESS"),
        _plain("quoc_tich", one_of("Việt Nam", "Lào", "Campuchia", "Hàn Quốc", "Pháp")),
        _tagged("ref_ext", "EMAIL", follows="ho_va_ten"),
        _tagged("so_phu", "PHONE"),
        _plain("nhom_mau", one_of("A", "B", "O", "AB")),
        _plain("tinh_trang_hn", one_of("Chưa kết hôn", "Có gia đình", "Góa", "Ly thân")),
        _plain("trinh_do_hv", one_of("THPT", "Trung cấp", "Cử nhân", "Tiến sĩ")),
        _plain("nghe_nghiep", one_of("Thợ điện", "Nông dân", "Y tá", "Lái xe", "Luật sư", "Hoàng Gia Travel")),
        _tagged("noi_sinh", "ADDRESS"),
        _plain("so_nguoi_phu_thuoc", number(0, 5)),
        _plain("acc_status", one_of("Hoạt động", "Chờ duyệt", "Tạm dừng")),
        _plain("dan_toc", one_of("Kinh", "Nùng", "Dao", "Khmer", "Ê Đê")),
        _plain("e_type", one_of("Hộ gia đình", "Ở trọ", "Ký túc xá")),
        _plain("xac_thuc", one_of("Vân tay", "Khuôn mặt", "Mã PIN")),
    ],
    "administrative_records": [
        _plain("ho_so_id", make_id("ADM")),
        _tagged("ref_id", "RESIDENT_ID"),
        _tagged("ten_chu_ho_so", "NAME"),
        _tagged("val_02", "PHONE"),
        _plain("loai_ho_so", one_of("Đăng ký kết hôn", "Giấy phép lái xe", "Sổ hồng", "Tách thửa")),
        _plain("co_quan_tiep_nhan", one_of("UBND Phường Thảo Điền", "Sở Y tế Lâm Đồng", "Chi cục Thuế Quận 7", "Công an Huyện Củ Chi")),
        _plain("trang_thai_xu_ly", one_of("Mới nhận", "Chờ bổ sung", "Đã trả", "Hủy")),
        _tagged("ext_info", "EMAIL", follows="ten_chu_ho_so"),
        _plain("so_bien_lai", make_id("BL")),
        _tagged("so_bao_hiem", "HEALTH_INSURANCE_ID"),
        _plain("process_days", one_of("3", "5", "7", "15", "30")),
        _plain("nhan_vien_xu_ly", make_id("NV")),
        _tagged("meta_addr", "ADDRESS"),
        _plain("so_ho_khau", NOISE_MAKERS["household"]),
        _plain("kenh_tiep_nhan", one_of("Cổng dịch vụ", "Tại quầy", "Tổng đài")),
        _plain("ket_qua_xu_ly", one_of("Đạt", "Không đạt", "Trả lại")),
        _plain("ma_loai_thu_tuc", prefixed("PROC-", 100, 999)),
        _plain("phong_tiep_nhan", prefixed("Cửa số ", 1, 15)),
        _plain("do_uu_tien_ho_so", one_of("Thấp", "Vừa", "Cao")),
        _plain("re_type", one_of("Nhận tại nhà", "Nhận tại quầy", "Bản điện tử")),
    ],
    "hr_employees": [
        _plain("emp_id", make_id("EMP")),
        _tagged("so_cccd", "RESIDENT_ID", follows="d_entry"),
        _tagged("ho_ten_nv", "NAME"),
        _tagged("d_entry", "DOB"),
        _tagged("sdt_ca_nhan", "PHONE"),
        _tagged("personal_email", "EMAIL", follows="ho_ten_nv"),
        _tagged("work_email", "EMAIL", make_work_email, "ho_ten_nv"),
        _tagged("res_data", "ADDRESS"),
        _plain("phong_ban", one_of("Pháp chế", "Kho vận", "Chăm sóc khách hàng", "Mai Linh Logistics")),
        _plain("chuc_vu", one_of("Thực tập sinh", "Tổ trưởng", "Phó phòng", "Cố vấn")),
        _tagged("m_val", "SALARY"),
        _plain("mnv", NOISE_MAKERS["batch"]),
        _plain("ten_ngan_hang", one_of("Ngân hàng Phương Nam", "Ngân hàng Sông Hồng", "Ngân hàng Cửu Long")),
        _plain("so_quyet_dinh", NOISE_MAKERS["decision"]),
        _tagged("ins_num", "HEALTH_INSURANCE_ID"),
        _plain("loai_hop_dong", one_of("Thời vụ", "Xác định thời hạn", "Không thời hạn")),
        _plain("status", one_of("Đang làm", "Nghỉ phép", "Thôi việc")),
        _plain("gender", one_of("nam", "nữ")),
        _plain("manager_id", make_id("EMP")),
        _plain("bac_luong", prefixed("LEVEL-", 1, 7)),
    ],
    "medical_records": [
        _plain("record_id", make_id("MED")),
        _tagged("so_cccd_benh_nhan", "RESIDENT_ID", follows="ngay_sinh"),
        _tagged("ref", "NAME"),
        _tagged("ngay_sinh", "DOB"),
        _plain("gioi_tinh", one_of("Nam", "Nữ")),
        _plain("nhom_mau", one_of("A", "B", "O", "AB")),
        _tagged("so_dien_thoai", "PHONE"),
        _tagged("email_lien_he", "EMAIL", follows="ref"),
        _tagged("dia_chi_thuong_tru", "ADDRESS"),
        _tagged("ma_so_bhyt", "HEALTH_INSURANCE_ID"),
        _plain("ten_benh_vien", one_of("Bệnh viện Hoa Sen", "Bệnh viện Quận Thủ Đức", "Phòng khám Tâm Đức", "Bệnh viện Lê Lợi")),
        _plain("khoa_kham", one_of("Ngoại tổng quát", "Da liễu", "Mắt", "Cao Áp")),
        _plain("chuan_doan", one_of("Cảm cúm", "Gãy xương đòn", "Thiếu máu nhẹ", "Dị ứng thời tiết")),
        _plain("thuoc_chi_dinh", one_of("Ibuprofen 400mg", "Cetirizine 10mg", "Vitamin C 1g")),
        _plain("chieu_cao_cm", number(150, 185)),
        _plain("can_nang_kg", number(45, 90)),
        _plain("huyet_ap", one_of("105/65", "118/76", "135/88")),
        _tagged("bac_si_dieu_tri", "NAME"),
        _plain("so_phong_kham", prefixed("P-", 101, 505)),
        _plain("hinh_thuc_ra_vien", one_of("Xuất viện", "Chuyển khoa", "Theo dõi tại nhà")),
    ],
}
# --- End of fixed values ---------------------------------------------------
