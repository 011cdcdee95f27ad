"""Column functions on text and HTML; all run in the JVM."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F


def _folds() -> tuple[str, str]:
    """Letters of the Latin blocks and what is left of each without marks."""
    src, dst = [], []
    for a, b in ((0x00C0, 0x0250), (0x1E00, 0x1F00)):
        for c in map(chr, range(a, b)):
            base = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))
            if len(base) == 1 and base != c:
                src.append(c)
                dst.append(base)
    return "".join(src) + "đĐ", "".join(dst) + "dd"


FOLD_FROM, FOLD_TO = _folds()


def accent_fold(c: Column) -> Column:
    """A search key: no accents, lower case, all else one space."""
    plain = F.lower(F.regexp_replace(F.translate(c, FOLD_FROM, FOLD_TO), r"\p{M}", ""))
    return F.trim(F.regexp_replace(plain, "[^a-z0-9]+", " "))


def slug(c: Column) -> Column:
    """ASCII letters, digits and single underscores; letters without an ASCII base (also đ) go."""
    plain = F.lower(F.regexp_replace(F.translate(c, FOLD_FROM[:-2], FOLD_TO[:-2]), r"[^\x00-\x7F]", ""))
    return F.regexp_replace(F.regexp_replace(plain, "[^a-z0-9_]+", "_"), "^_+|_+$", "")


def word_count(c: Column) -> Column:
    return F.regexp_count(c, F.lit(r"\S+")).cast("long")


def clean(c: Column) -> Column:
    """At most two newlines in a row, single blanks, 15000 characters."""
    return F.substring(F.trim(F.regexp_replace(F.regexp_replace(c, r"\n{3,}", "\n\n"), "[ \t]+", " ")), 1, 15000)


# What is said for each sign, in the order in which they are replaced.
SPEECH = [
    (r"\\frac\{([^{}]+)\}\{([^{}]+)\}", "$1 phần $2"),
    (r"([a-zA-Z0-9_]+)\^2", "$1 bình phương"),
    (r"([a-zA-Z0-9_]+)\^3", "$1 lập phương"),
    (r"([a-zA-Z0-9_]+)\^([a-zA-Z0-9_]+|\{[^{}]+\})", "$1 mũ $2"),
    (r"[{}]", ""),
    (r"\\times", "nhân"),
    (r"\\div", "chia"),
    (r"\\ge", "lớn hơn hoặc bằng"),
    (r"\\le", "nhỏ hơn hoặc bằng"),
    (r"\\neq", "khác"),
    (r"\\approx", "xấp xỉ"),
    (r"\\\+", "cộng"),
    (r"\\-", "trừ"),
    (r"\\sqrt\s*([a-zA-Z0-9_]+)", "căn bậc hai của $1"),
    (r"\$", ""),
    (r"\s+", " "),
]


def latex_speech(c: Column) -> Column:
    """Formulas as they are read out."""
    for pattern, said in SPEECH:
        c = F.regexp_replace(c, pattern, said)
    return F.trim(c)


def main_text(html: Column) -> Column:
    """The article's text by patterns: no scripts, styles, comments, tags."""
    bare = F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</(script|style)>|<!--.*?-->", " ")
    article = F.regexp_extract(bare, r"(?is)<article[^>]*>(.*?)(</article>|$)", 1)
    return F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(F.nullif(article, F.lit("")), bare), r"(?s)<[^>]*(>|$)", " "), r"\s+", " "))


def dot(a: Column, b: Column) -> Column:
    """In double precision."""
    return F.aggregate(F.zip_with(a, b, lambda u, v: u.cast("double") * v.cast("double")), F.lit(0.0), lambda s, v: s + v)


def four_digits(c: Column) -> Column:
    """A double of up to 1e9 with four digits, as its binary value rounds, halves to even digits (like
    format of C and of SQL; Java's %.4f rounds its shortest decimal form). The value is cut into two
    parts whose products with 10,000 are exact."""
    size = F.abs(c)
    high = size.cast("float").cast("double")
    begin = F.floor(size * 1e4)
    over = (high * 1e4 - begin - 0.5) + (size - high) * 1e4
    n = begin + F.when((over > 0) | ((over == 0) & (begin % 2 == 1)), 1).otherwise(0)
    digits = F.concat(F.when(F.startswith(c.cast("string"), F.lit("-")), "-").otherwise(""), F.floor(n / 10000).cast("string"), F.lit("."), F.lpad((n % 10000).cast("string"), 4, "0"))
    return F.when(F.isnan(c), "nan").otherwise(digits)


def norm(v: Column) -> Column:
    """A vector's length: worked out once for a row, before it meets others."""
    return F.sqrt(dot(v, v))


def drop_links(c: Column) -> Column:
    """Without what follows a see-more mark, links and addresses; at most two newlines in a row."""
    for pattern, to in [(r"(?s)>> Xem thêm.*", ""), (r"\[[^\n]*?\]\(http[^)]+\)", ""), (r"https?://[^\t\n\f\r ]+", ""), (r"\n{3,}", "\n\n"), (r"^\s+|\s+$", "")]:
        c = F.regexp_replace(c, pattern, to)
    return c


def _found(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def author(c: Column) -> Column:
    """What stands in the first parentheses of 3 to 60 characters, or null."""
    return _found(F.regexp_extract(c, r"\(([^)]{3,60})\)", 1))


def title(c: Column) -> Column:
    """The first line without the site's name behind a bar."""
    return F.trim(F.substring_index(F.substring_index(c, "\n", 1), "|", 1))


def marked_span(c: Column) -> Column:
    """The text from the mark [ ... ] to the first mark of a page's foot, or null."""
    return _found(F.regexp_replace(F.regexp_extract(c, r"(?s)\[\s*[.]{3}\s*\](.*?)(?:Bình luận|👉|Luyện Bài|Báo lỗi|\z)", 1), r"^\s+|\s+$", ""))


def search_terms(c: Column) -> Column:
    """Words of all scripts, one blank between them."""
    return F.trim(F.regexp_replace(F.regexp_replace(c, r"[^\p{L}\p{N}_\s]", " "), r"\s+", " "))


def clip(c: Column, markers: list[str], least: int) -> Column:
    """c up to the first of markers, in their order, that stands after `least` characters."""
    at = lambda m: F.instr(c, m) - 1
    return F.coalesce(*(F.when(at(m) > least, F.substring(c, F.lit(1), at(m))) for m in markers), c)


def occurrences(c: Column, word: str) -> Column:
    """How often word stands in c, without overlaps."""
    return ((F.length(c) - F.length(F.replace(c, F.lit(word), F.lit("")))) / len(word)).cast("long")


# Signs that stand for small digits and charges, and how formulas are read (v2).
SUBSCRIPT = ("0123456789", "₀₁₂₃₄₅₆₇₈₉")
SUPERSCRIPT = ("0123456789+-", "⁰¹²³⁴⁵⁶⁷⁸⁹⁺⁻")
SPEECH_V2 = [(r"\$", ""), (r"\\frac\{([^{}]+)\}\{([^{}]+)\}", "$1 chia $2"), (r"\\sqrt\{([^{}]+)\}", "căn bậc hai của $1"), (r"\\cdot", " nhân "), (r"\\times", " nhân "), (r"\\div", " chia "), (r"\\pm", " cộng hoặc trừ ")]
SIGNS = [("+", "cộng"), ("-", "trừ"), ("×", "nhân"), ("÷", "chia"), ("=", "bằng"), ("<", "nhỏ hơn"), (">", "lớn hơn"), ("≤", "nhỏ hơn hoặc bằng"), ("≥", "lớn hơn hoặc bằng"), ("≠", "khác"), ("²", "bình phương"), ("³", "lập phương"), ("π", "pi"), ("∞", "vô cực")]


def formula_speech(c: Column) -> Column:
    """A formula as it is read out, sign by sign."""
    for pattern, said in SPEECH_V2:
        c = F.regexp_replace(c, pattern, said)
    for sign, said in SIGNS:
        c = F.replace(c, F.lit(sign), F.lit(f" {said} "))
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def small_signs(html: Column) -> Column:
    """HTML with one-digit subscripts and one-sign superscripts as characters of their own."""
    for tag, signs in (("sub", SUBSCRIPT), ("sup", SUPERSCRIPT)):
        for a, b in zip(*signs, strict=True):
            html = F.regexp_replace(html, rf"(?i)<{tag}[^>]*>\s*\Q{a}\E\s*</{tag}>", b)
    return html


def keep_formulas(html: Column) -> Column:
    """HTML whose formulas (marked spans, scripts, pictures' texts) stand as $$...$$ in it."""
    html = F.regexp_replace(html, r"(?is)<span(?=[^>]*class=\"[^\"]*(?:MathJax|mjx-chtml))[^>]*data-latex=\"([^\"]*)\"[^>]*>.*?</span>", " \\$\\$$1\\$\\$ ")
    html = F.regexp_replace(html, r"(?is)<script[^>]*type=\"math/tex[^\"]*\"[^>]*>(.*?)</script>", " \\$\\$$1\\$\\$ ")
    return F.regexp_replace(html, r"(?is)<img[^>]*alt=\"([^\"]*[\\_^][^\"]*)\"[^>]*>", " \\$\\$$1\\$\\$ ")


def absolute(link: Column, base: Column) -> Column:
    """A link of a page as a whole address: base has no slash at its end."""
    return F.when(F.startswith(link, F.lit("http")), link).when(F.startswith(link, F.lit("/")), F.concat(base, link)).otherwise(F.concat(base, F.lit("/"), link))
