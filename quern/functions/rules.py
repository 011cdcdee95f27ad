"""Rules as data: ordered (label, patterns) compile to one CASE for Spark and one for SQL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Rules = list[tuple[str, list[str]]]


def matches(text: Column, pattern: str) -> Column:
    """Search with word classes of all scripts."""
    return text.rlike("(?U)" + pattern)


def first_rule(text: Column, rules: Rules, otherwise: str | None) -> Column:
    out = F
    for label, patterns in rules:
        hit = matches(text, patterns[0])
        for p in patterns[1:]:
            hit = hit | matches(text, p)
        out = out.when(hit, F.lit(label))
    return out.otherwise(F.lit(otherwise))


def score(text: Column, patterns: list[str]) -> Column:
    """How many of the patterns occur; a pattern that stands twice counts twice."""
    total = F.lit(0)
    for p in patterns:
        total = total + matches(text, p).cast("int")
    return total


def sql_pattern(pattern: str) -> str:
    """The same pattern for an engine whose word classes are ASCII."""
    if pattern.startswith(r"\b"):
        pattern = r"(?:^|[^\p{L}\p{N}_])" + pattern[2:]
    if pattern.endswith(r"\b"):
        pattern = pattern[:-2] + r"(?:$|[^\p{L}\p{N}_])"
    return pattern.replace(r"\b", "").replace(r"\w", r"[\p{L}\p{N}_]")


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def sql_match(column: str, pattern: str) -> str:
    return f"regexp_matches({column}, {quoted(sql_pattern(pattern))})"


def sql_first_rule(column: str, rules: Rules, otherwise: str | None) -> str:
    cases = " ".join(f"WHEN {' OR '.join(sql_match(column, p) for p in ps)} THEN {quoted(label)}" for label, ps in rules)
    return f"CASE {cases} ELSE {quoted(otherwise) if otherwise is not None else 'NULL'} END"


def sql_score(column: str, patterns: list[str]) -> str:
    return "(" + " + ".join(f"CAST({sql_match(column, p)} AS INTEGER)" for p in patterns) + ")"


# The word lists and patterns that decide intent, subject and content type.
INTENT: Rules = [
    ("greeting", [r"^(chào|hi|hello|xin chào|chị ơi|anh ơi)\s*[\.\!\?]*$", r"^(con|em|mình)\s+(đây|đến rồi|về rồi)"]),
    ("lookup_curriculum", [r"tuần\s+(này|nay|hiện tại).*học.*gì", r"hôm nay.*học.*bài\s+gì"]),
    ("lookup_specific", [r"bài\s+(\d+).*trang\s+(\d+)", r"trang\s+(\d+).*lớp\s+(\d+)"]),
    ("explain_concept", [r"(từ ghép|từ láy|danh từ|động từ|tính từ|câu kể|câu hỏi|câu cảm|dấu\s+\w+)\s+là\s+gì", r"phân biệt\s+(\w+)\s+(và|với)\s+(\w+)", r"khi nào (viết|dùng)", r"(thực hành tiếng việt|luyện từ)"]),
    ("writing_outline", [r"(tả|kể|viết|miêu tả).*(con|cây|người|cảnh|chuyện)", r"không biết (tả|kể|viết|làm)", r"giúp em (tả|kể|viết)", r"bài văn.*mẫu", r"văn mẫu", r"dàn ý"]),
]
WRITING: Rules = [("ta_cay", [r"tả.*cây"]), ("ta_con_vat", [r"tả.*con\s+\w+"]), ("ta_nguoi", [r"tả.*người"]), ("ke_chuyen", [r"kể.*chuyện"])]
LESSON_LEAD = r"^(đọc\s+(cho\s+(em|con|mình|tớ)\s+)?(bài\s+)?|soạn\s+(bài\s+)?|phân\s+tích\s+(bài\s+)?|cảm\s+nhận\s+(về\s+)?(bài\s+)?|tóm\s+tắt\s+(bài\s+)?|nội\s+dung\s+(bài\s+)?|văn\s+bản\s+|cho\s+(em|con|tớ)\s+nghe\s+(bài\s+)?)"
LESSON_TAIL = r"\s+(cho\s+(em|con|mình|tớ)\s+nghe|nhé|đi|nào|ạ)\s*$"
SUBJECTS: Rules = [
    ("toan", [r"cộng", r"trừ", r"phép\s+nhân", r"tích\b", r"chia", r"phân số", r"hỗn số", r"phần trăm", r"tam giác", r"hình thang", r"hình thoi", r"hình tròn", r"diện tích", r"chu vi", r"thể tích", r"phương trình", r"bất phương trình", r"số thập phân", r"số tự nhiên", r"ước số", r"bội số", r"tỉ số", r"căn bậc", r"lũy thừa", r"hàm số", r"hệ tọa độ", r"đồ thị", r"toán\b", r"bài\s+toán", r"lời\s+giải\s+toán"]),
    ("khtn", [r"nguyên tử", r"phân tử", r"hóa trị", r"liên kết hóa", r"axit", r"bazơ", r"muối\b", r"phản ứng hóa", r"oxygen", r"hydrogen", r"quang hợp", r"hô hấp", r"tế bào", r"gene", r"di truyền", r"vận tốc", r"lực\b", r"năng lượng", r"điện trở", r"từ trường", r"âm thanh", r"ánh sáng", r"nhiệt độ", r"dung dịch", r"khtn", r"khoa học tự nhiên", r"phản ứng", r"mol\b", r"electron", r"proton", r"thí nghiệm", r"động năng", r"thế năng", r"hệ mặt trời", r"ngân hà", r"vũ trụ", r"thực vật", r"động vật", r"sinh vật", r"đa dạng sinh học", r"hô hấp", r"khoáng chất"]),
    ("tieng_anh", [r"english", r"grammar", r"vocabulary", r"pronunciation", r"tense", r"present simple", r"past simple", r"future", r"unit\s+\d", r"từ vựng tiếng anh", r"ngữ pháp tiếng anh", r"tiếng anh lớp", r"\bverb\b", r"\bnoun\b", r"\badjective\b", r"writing skill", r"\bschool\b", r"\bbook\b", r"\bfriend\b", r"\bhome\b", r"\bfamily\b", r"\bteacher\b", r"\bstudent\b", r"\bplay\b", r"\bsport\b", r"nghĩa\s+(là\s+gì|tiếng\s+việt|của\s+\w+)\s*\?", r"(tiếng anh|anh văn)\s+(là gì|nghĩa|nói)"]),
    ("lich_su", [r"triều đại", r"cách mạng", r"kháng chiến", r"khởi nghĩa", r"chiến tranh\b", r"\bvua\b", r"hoàng đế", r"nhà\s+(nguyễn|lý|trần|lê|đinh|tiền lê|hồ)", r"thế kỉ\s+\d", r"năm\s+\d{3,4}", r"giải phóng\s+dân tộc", r"lịch sử", r"trận\s+\w+", r"cuộc\s+khởi nghĩa"]),
    ("dia_li", [r"khí hậu", r"địa hình", r"dân số", r"châu\s+\w+", r"đại dương", r"khoáng sản", r"đồng bằng", r"cao nguyên", r"kinh tế vùng", r"công nghiệp hóa", r"nông nghiệp\b", r"địa lí", r"địa lý", r"vùng kinh tế", r"bản đồ"]),
    ("gdcd", [r"đạo đức", r"trung thực", r"tôn trọng", r"pháp luật", r"quyền và nghĩa vụ", r"nhân quyền", r"công dân", r"tiết kiệm", r"gdcd", r"giáo dục công dân", r"nhặt được", r"quyền trẻ em"]),
]
LITERATURE = [r"bài đọc", r"bài thơ", r"tập làm văn", r"văn mẫu", r"nhân vật", r"tác giả", r"tác phẩm", r"phân tích\s+bài", r"soạn\s+(bài|văn)", r"đọc hiểu", r"văn bản", r"đọc\s+(cho\s+\w+\s+)?bài\b", r"nghe\s+bài\b", r"cảm\s+nhận", r"tóm\s+tắt\s+bài", r"nội\s+dung\s+(bài|của)", r"nhớ\s+rừng"]
CONTENT: Rules = [
    ("soan_van", ["soạn bài", "soan-bai", "soạn văn", "soan-van"]),
    ("phan_tich", ["phân tích", "phan-tich", "nghị luận", "nghi-luan", "cảm nhận", "bình giảng"]),
    ("tom_tat", ["tóm tắt", "tom-tat", "bố cục", "bo-cuc"]),
    ("tap_lam_van", ["tập làm văn", "tap-lam-van", "viết đoạn", "viết bài", "dàn ý", "văn mẫu", "van-mau"]),
    ("luyen_tu_va_cau", ["luyện từ và câu", "luyen-tu-va-cau", "luyen-tu-cau", "từ ghép", "từ láy", "danh từ", "động từ", "tính từ", "thực hành tiếng việt", "thuc-hanh-tieng-viet"]),
    ("chinh_ta", ["chính tả", "chinh-ta"]),
    ("ke_chuyen", ["kể chuyện", "ke-chuyen"]),
    ("bai_doc", ["tập đọc", "tap-doc", "bài đọc", "bai-doc", "đọc hiểu"]),
    ("on_tap", ["ôn tập", "on-tap"]),
    ("de_kiem_tra", ["đề kiểm tra", "đề thi", "de-kiem-tra", "de-thi"]),
    ("bai_doc", ["(?s)(?:sgk|sách giáo khoa|trang).*(?:lớp|lop)|(?:lớp|lop).*(?:sgk|sách giáo khoa|trang)"]),
]
# Content types that addresses tell, by subject; the first that fits.
READING_URLS: Rules = [
    ("van_ban", ["van-ban-"]),
    ("soan_van", ["soan-bai-", "soan-van-"]),
    ("phan_tich", ["phan-tich-", "nghi-luan-", "cam-nhan-"]),
    ("tom_tat", ["tom-tat-", "bo-cuc-"]),
    ("tap_lam_van", ["tap-lam-van", "van-mau"]),
    ("luyen_tu_va_cau", ["luyen-tu-va-cau", "luyen-tu-cau", "thuc-hanh-tieng-viet"]),
    ("chinh_ta", ["chinh-ta"]),
    ("ke_chuyen", ["ke-chuyen"]),
    ("bai_doc", ["tap-doc", "bai-doc"]),
    ("on_tap", ["on-tap"]),
    ("de_kiem_tra", ["de-kiem-tra", "de-thi"]),
]
MATHS_URLS: Rules = [
    ("math_theory", ["ly-thuyet-", "khai-niem-"]),
    ("math_exercise", ["giai-toan-", "bai-tap-"]),
    ("math_workbook", ["vo-bai-tap-", "-vbt-"]),
    ("math_sbt", ["sbt-"]),
    ("math_test", ["de-kiem-tra", "de-thi"]),
    ("math_exercise", ["-bai-"]),
]
# Series: by whole names only; also by abbreviations; on listing pages.
SERIES: Rules = [("KNTT", ["ket-noi-tri-thuc", "ket_noi_tri_thuc"]), ("CTST", ["chan-troi-sang-tao"]), ("CD", ["canh-dieu"])]
SERIES_SHORT: Rules = [("KNTT", ["ket-noi-tri-thuc", "kntt"]), ("CTST", ["chan-troi-sang-tao", "ctst"]), ("CD", ["canh-dieu", "cd"])]
SERIES_LISTING: Rules = [("CTST", ["chan-troi"]), ("CD", ["canh-dieu"])]
# Lessons by address: what is left out, and what a lesson has.
NOT_LESSON = ["kiem-tra", "on-tap", "thuc-hanh", "noi-va-nghe", "viet", "vbt", "vo-bai-tap"]
LESSON = ["soan-bai", "van-ban", "tieng-viet", "doc-hieu"]
NOT_PRIMARY = ["luyen-tap", "tim-hieu", "viet", "doc-mo-rong", "on-tap", "thu-tin", "goc-sang-tao", "ke-chuyen", "tu-va-cau", "chinh-ta", "tap-lam-van", "kiem-tra", "nghe-viet", "mo-rong-von-tu", "luyen-tu", "danh-tu", "dong-tu", "tinh-tu", "dai-tu", "viet-bai"]
NOT_GUIDE = ["viet-", "trinh-bay-", "nghe-va-", "luyen-tap", "on-tap", "tu-danh-gia", "thuc-hanh-tieng-viet", "cung-co-mo-rong", "phieu-hoc-tap"]
# What marks a block as no part of the lesson.
GARBAGE = ["xem thêm", "các bài giải", "quảng cáo", "mục lục", "hot sale", "sách cấp tốc", "trang trước", "trang sau", "adsbygoogle", "top 20", "tổng hợp đề thi", "toán - văn - anh", r"function\(\)", r"window\."]
# Requests to read something out; nothing asks for them.
READING: list[str] = [r"đọc\s+(bài\s+)?.+\s+cho\s+(em|con|mình|tớ)", r"đọc\s+(cho\s+(em|con|mình|tớ)\s+)?bài\s+", r"cho\s+(em|con|tớ)\s+nghe\s+bài", r"bài\s+đọc\s+", r"soạn\s+(bài|văn)\s+", r"soạn\s+bài\s+", r"phân\s+tích\s+bài\s+", r"phân\s+tích\s+tác\s+phẩm", r"cảm\s+nhận\s+(về\s+)?bài\s+", r"tóm\s+tắt\s+bài\s+", r"nội\s+dung\s+(bài|của)\s+", r"văn\s+bản\s+"]
# Science: branches by words of a chapter's title, and by words of the text.
SCIENCE: Rules = [
    ("hoa_hoc", ["nguyên tử", "phân tử", "hóa trị", "liên kết", "axit", "bazơ", "muối", "phản ứng", "oxi", "hydrogen", "H2O", "NaCl"]),
    ("vat_li", ["tốc độ", "vận tốc", "âm thanh", "ánh sáng", "từ trường", "lực", "năng lượng", "điện", "nhiệt độ"]),
    ("sinh_hoc", ["tế bào", "sinh trưởng", "phát triển", "quang hợp", "hô hấp", "sinh sản", "di truyền", "gene"]),
]
HISTORY_OR_GEOGRAPHY: Rules = [("lich_su", [r"chương.*lịch sử", "triều đại", "chiến tranh"]), ("dia_li", [r"chương.*địa lí", "khí hậu", "đồng bằng"])]
GRADE_HINTS: Rules = [
    ("lớp 1-2", ["đếm", "cộng trong phạm vi 10", "hình vuông"]),
    ("lớp 3-5", ["nhân", "chia", "phân số", "số thập phân", "diện tích"]),
    ("lớp 6-7", ["số nguyên", "phân số âm", "hệ tọa độ", "hàm số"]),
    ("lớp 8-9", ["phương trình", "bất phương trình", "căn bậc", "hình học không gian"]),
]
FIGURES = [r"[Hh]ình [0-9]+\.[0-9]+", r"[Qq]uan sát hình", r"dựa vào (hình|bảng|biểu đồ|lược đồ)", r"như hình (bên|dưới|trên)"]
# Sections of a unit by the address, science by the words of a chapter's title, marks
# that begin a solution.
SECTIONS: Rules = [
    ("getting_started", ["/getting-started-unit-[0-9]+"]),
    ("closer_look_1", ["/a-closer-look-1-unit-[0-9]+"]),
    ("closer_look_2", ["/a-closer-look-2-unit-[0-9]+"]),
    ("communication", ["/communication-unit-[0-9]+"]),
    ("skills_1", ["/skills-1-unit-[0-9]+"]),
    ("skills_2", ["/skills-2-unit-[0-9]+"]),
    ("looking_back", ["/looking-back-unit-[0-9]+"]),
    ("project", ["/project-unit-[0-9]+"]),
    ("vocabulary", ["/vocabulary-unit-[0-9]+"]),
    ("grammar", ["/grammar-unit-[0-9]+"]),
    ("pronunciation", ["/pronunciation-unit-[0-9]+"]),
]
CHAPTERS: Rules = [("hoa_hoc", ["nguyên tử", "phân tử", "phản ứng"]), ("vat_li", ["tốc độ", "âm", "ánh sáng", "từ"]), ("sinh_hoc", ["tế bào", "sinh", "trao đổi chất"])]
SOLUTION_MARKS = ["**Lời giải chi tiết:**", "**Lời giải:**", "**Trả lời:**", "Lời giải chi tiết:", "Lời giải:"]

