"""Text functions on Columns: folding, names, phones, status, redaction, sentences."""

from __future__ import annotations

import unicodedata
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def _plain_letters() -> tuple[str, str]:
    """Precomposed Latin letters and their base letters, by Unicode decomposition; đ counts as d."""
    pairs = {"đ": "d", "Đ": "D"}
    for cp in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        base = "".join(c for c in unicodedata.normalize("NFKD", chr(cp)) if not unicodedata.combining(c))
        if len(base) == 1 and base != chr(cp):
            pairs.setdefault(chr(cp), base)
    return "".join(pairs), "".join(pairs.values())


ACCENTED, PLAIN = _plain_letters()

# Business forms before a name (folded; patterns), and operators' words for a place's status.
NAME_PREFIXES = [
    "cong ty", "cty", "tnhh", "cp", "jsc", r"co\.?,?\s*ltd", "llc", "cua hang", "quan", "tiem", "nha hang", "shop", "store", "sieu thi",
    "hieu thuoc", "nha thuoc", "phong kham", "tram", "ben",
]
STATUS_WORDS = {
    "operational": "open", "open": "open", "open_for_business": "open", "dang hoat dong": "open", "mo cua": "open",
    "closed_temporarily": "temporarily_closed", "temporarily_closed": "temporarily_closed", "tam dong cua": "temporarily_closed",
    "tam ngung": "temporarily_closed", "ngung tam": "temporarily_closed", "closed_permanently": "permanently_closed",
    "permanently_closed": "permanently_closed", "closed": "permanently_closed", "dong cua": "permanently_closed",
    "da dong cua": "permanently_closed", "ngung hoat dong": "permanently_closed",
}


# Letters that only Vietnamese words have, and phrases that are Vietnamese without them.
TONE_LETTERS = "áàảãạăắằẳẵặâấầẩẫậđéèẻẽẹêếềểễệíìỉĩịóòỏõọôốồổỗộơớờởỡợúùủũụưứừửữựýỳỷỹỵ"
TONELESS = [
    "hom nay", "hom qua", "hien tai", "truc tiep", "moi nhat", "gia vang", "gia heo", "gia xang", "gia gao", "gia bac", "gia bitcoin",
    "gia ban", "ty gia", "ngoai te", "lai suat", "chi so", "co phieu", "xo so", "ket qua", "bong da", "lich thi dau", "thoi tiet",
    "du bao thoi tiet", "ve so",
]
# Words of a query that tell its intent, in the order in which they are tried.
INTENT_WORDS = {
    "comparison": ["so sánh", "so với", "vs", "versus", "compare", "khác nhau"],
    "current_fact": ["mới", "mới nhất", "hôm nay", "hiện tại", "ngày", "latest", "today", "now", "current", "news", "new"],
    "definition": ["là gì", "định nghĩa", "what is", "define", "meaning"],
    "howto": ["cách", "làm thế nào", "how to", "how do", "hướng dẫn"],
    "opinion": ["ý kiến", "đánh giá", "tốt không", "opinion", "review"],
}
# Words (whole) and phrases (anywhere) that ask for the state of now, for a number, for a result.
LIVE_WORDS = ["today", "now", "tonight", "live"]
LIVE_PHRASES = ["hôm nay", "hom nay", "hôm qua", "hom qua", "hiện tại", "hien tai", "trực tiếp", "truc tiep", "mới nhất", "moi nhat"]
NUMBER_WORDS = ["price", "prices", "rate", "rates", "usd", "vnd", "stock", "stocks", "nasdaq", "dow"]
NUMBER_PHRASES = [
    "giá vàng", "gia vang", "giá heo", "gia heo", "giá xăng", "gia xang", "giá gạo", "gia gao", "giá bạc", "gia bac", "giá bitcoin",
    "gia bitcoin", "giá bán", "gia ban", "tỷ giá", "ty gia", "ngoại tệ", "ngoai te", "lãi suất", "lai suat", "chỉ số", "chi so",
    "cổ phiếu", "co phieu", "how much",
]
RESULT_WORDS = ["result", "results", "score", "scores", "match", "fixture", "fixtures", "schedule", "weather", "forecast", "epl", "kqxs"]
RESULT_PHRASES = [
    "xổ số", "xo so", "kết quả", "ket qua", "bóng đá", "bong da", "lịch thi đấu", "lich thi dau", "thời tiết", "thoi tiet",
    "dự báo thời tiết", "du bao thoi tiet", "vé số", "ve so", "premier league", "world cup", "champions league",
]
# Phrases (folded) that tell how long an answer lasts, in the order in which they are tried.
LIFETIME_PHRASES = {
    "hours": ["dang mo", "gan day", "gan toi", "gio mo cua", "local", "mo cua", "near me", "open now", "quanh day"],
    "minutes": [
        "bay gio", "breaking", "current", "gio", "hien tai", "hom nay", "latest", "moi nhat", "news", "now", "tin moi", "tin tuc",
        "today", "tonight", "vua ra mat",
    ],
    "static": ["api reference", "cach su dung", "cach dung", "cu phap", "documentation", "how to", "huong dan", "syntax", "tutorial"],
}
# Words that join two questions, that begin a comparison, and that name a side of a thing asked about.
CONJUNCTIONS = ["và", "and", "&", "vs", "với", "versus", "hoặc", "hay", "or"]
COMPARISON_PREFIXES = ["so sánh", "so với", "compare", "versus", "vs"]
ASPECTS = [
    "giá", "ngày ra mắt", "ngày", "price", "release date", "specs", "review", "đánh giá", "hiệu năng", "performance", "thiết kế",
    "design", "pin", "battery", "camera", "màn hình", "display", "tính năng", "features",
]
# Orders to a reader that untrusted text may hold.
INJECTIONS = [
    r"ignore\s+(all\s+)?previous\s+instructions?", r"disregard\s+(all\s+)?previous\s+instructions?", r"you\s+are\s+now\s+a?\s+",
    r"new\s+instructions?:", r"system\s+prompt:", r"override\s+(all\s+)?previous\s+instructions?", r"forget\s+(all\s+)?previous\s+instructions?",
    r"bypass\s+(all\s+)?previous\s+instructions?", r"tuân\s+theo\s+(tất\s+cả\s+)?chỉ\s+thị\s+trước", r"bỏ\s+qua\s+(tất\s+cả\s+)?chỉ\s+thị\s+trước",
]


def let(value: Column, body) -> Column:
    """body(value), with value evaluated once for a row; a column used inside a lambda would be evaluated for each element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def fold(text: Column) -> Column:
    """Lower case without accents, trimmed."""
    return F.trim(F.lower(F.regexp_replace(F.translate(text, ACCENTED, PLAIN), r"\p{M}", "")))


def normalize(text: Column) -> Column:
    """fold, punctuation to blanks, blanks collapsed."""
    return F.trim(F.regexp_replace(fold(text), r"[^\p{L}\p{N}_]+", " "))


def tokens(text: Column, stopwords: list[str] | None = None) -> Column:
    """The words of the normal form, without stopwords; of an empty text none."""
    words = F.filter(F.split(normalize(text), " "), lambda x: x != "")
    return F.filter(words, lambda x: ~x.isin(stopwords)) if stopwords else words


def ngrams(words: Column, n: int) -> Column:
    """Runs of n words, joined by blanks."""
    def grams(w):
        made = F.transform(F.sequence(F.lit(0), F.greatest(F.size(w) - n, F.lit(0))), lambda i: F.array_join(F.slice(w, i + 1, n), " "))
        return F.when(F.size(w) >= n, made).otherwise(F.array().cast("array<string>"))

    return let(words, grams)


def norm_name(text: Column) -> Column:
    """A name to compare by: folded, without leading business forms (repeatedly) and punctuation."""
    return norm_address(F.regexp_replace(fold(text), rf"^(?:(?:{'|'.join(NAME_PREFIXES)})\b[\s.,:\-]*)+", ""))


def norm_address(text: Column) -> Column:
    """An address to compare by: folded, punctuation to blanks, blanks collapsed. Null: empty."""
    return normalize(F.coalesce(text, F.lit("")))


def name_signature(name: Column) -> Column:
    """The words of a normal name in order, repeats included."""
    return F.array_join(F.array_sort(F.filter(F.split(name, " "), lambda x: x != "")), " ")


def normalize_phone(text: Column) -> Column:
    """+84 form of a phone number; null if its digits number under 8 or over 13."""
    d = F.regexp_replace(F.coalesce(text, F.lit("")), r"\D", "")
    d = F.when(d.startswith("00"), F.concat(F.lit("+"), F.substring(d, 3, 99))).when(d.startswith("84"), F.concat(F.lit("+"), d)).when(d.startswith("0"), F.concat(F.lit("+84"), F.substring(d, 2, 99))).when((d != "") & (F.length(d) > 10), F.concat(F.lit("+"), d)).when(d != "", F.concat(F.lit("+0"), d)).otherwise(d)
    return F.when(F.length(F.ltrim(d, F.lit("+"))).between(8, 13), d)


def norm_status(text: Column) -> Column:
    """open, temporarily_closed, permanently_closed or null: by the folded word, then by parts of it."""
    t = fold(text)
    known = F.create_map(*[F.lit(x) for pair in STATUS_WORDS.items() for x in pair])
    return F.coalesce(F.try_element_at(known, t), F.when(t.contains("permanent"), "permanently_closed").when(t.contains("temporar"), "temporarily_closed"))


def slug(text: Column) -> Column:
    return F.replace(normalize(text), F.lit(" "), F.lit("-"))


def redact(text: Column, most: int = 500) -> Column:
    """E-mail addresses, phone numbers and ids of six digits or more are masked, in that order; then the text is cut."""
    t = F.regexp_replace(text, r"[A-Za-z0-9_.+-]+@[A-Za-z0-9_-]+(?:\.[A-Za-z0-9_-]+)+", "[email]")
    t = F.regexp_replace(t, r"(?<![0-9])(?:\+?84|0)[0-9]{8,10}(?![0-9])", "[sdt]")
    return F.substring(F.regexp_replace(t, r"(?<![A-Za-z0-9_])[0-9]{6,}(?![A-Za-z0-9_])", "[id]"), 1, most)


def _has_word(text: Column, words: list[str]) -> Column:
    return text.rlike(rf"(?<![\p{{L}}\p{{N}}_])(?:{'|'.join(words)})(?![\p{{L}}\p{{N}}_])")


def _has(text: Column, words: list[str], phrases: list[str]) -> Column:
    return _has_word(text, words) | text.rlike("|".join(phrases))


def query_language(text: Column) -> Column:
    """vi if the text has a Vietnamese letter or one of the phrases that are Vietnamese without, else en."""
    low = F.lower(text)
    return F.when(low.rlike(f"[{TONE_LETTERS}]") | low.rlike("|".join(TONELESS)), "vi").otherwise("en")


def intent(text: Column) -> Column:
    """comparison, current_fact, definition, howto or opinion: the first whose words the text has; current_fact if it has none."""
    low = F.lower(text)
    out = F.lit("current_fact")
    for name, words in reversed(INTENT_WORDS.items()):
        out = F.when(_has_word(low, words), name).otherwise(out)
    return out


def time_range(text: Column) -> Column:
    """day if the text asks for now, week if for a number or a result, else null. "rate" in "rate limit" is no number."""
    low = F.trim(F.lower(text))
    rates = _has_word(low, ["rate", "rates"]) & ~low.contains("rate limit")
    number = low.rlike("|".join(NUMBER_PHRASES)) | _has_word(low, [w for w in NUMBER_WORDS if w not in ("rate", "rates")]) | rates
    return F.when(_has(low, LIVE_WORDS, LIVE_PHRASES), "day").when(number | _has(low, RESULT_WORDS, RESULT_PHRASES), "week")


def freshness_class(text: Column) -> Column:
    """How long an answer lasts: hours, minutes, static, else days. Phrases count as whole words of the folded text."""
    words = F.concat(F.lit(" "), F.trim(F.regexp_replace(fold(text), "[^a-z0-9]+", " ")), F.lit(" "))
    out = F.lit("days")
    for name, phrases in reversed(LIFETIME_PHRASES.items()):
        out = F.when(words.rlike(f" (?:{'|'.join(phrases)}) "), name).otherwise(out)
    return out


def is_injection(text: Column) -> Column:
    return text.rlike("(?iu)" + "|".join(INJECTIONS))


def sanitize(text: Column) -> Column:
    """Untrusted text without comments, scripts, styles and hiding styles, trimmed; one with an order to its reader is cut to a mark and 100 letters."""
    for pattern in (r"(?s)<!--.*?-->", r"(?is)<script[^>]*>.*?</script>", r"(?is)<style[^>]*>.*?</style>", r'(?i)display\s*:\s*none[^"]*"', r'(?i)font-size\s*:\s*0[^"]*"'):
        text = F.regexp_replace(text, pattern, "")
    return F.trim(F.when(is_injection(text), F.concat(F.lit("[INJECTION DETECTED — CONTENT REMOVED]\n"), F.substring(text, 1, 100), F.lit("..."))).otherwise(text))


def edit_allowance(term: Column) -> Column:
    """Typos that a term of this length may have: 0, 1, 2 or 3."""
    n = F.length(term)
    return F.when(n < 5, 0).when(n <= 8, 1).when(n <= 14, 2).otherwise(3)


def sentences(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, r"[.!?]\s+|\n+"), lambda x: F.trim(x)), lambda x: x != "")


# What makes a sentence a claim, and what makes it none.
INFORMATIVE = [
    r"\d",
    r"(?i)\b(is|are|was|were|has|have|had|will|would|can|could|may|might|should|must|says|said|reports|reported|announces|announced)\b",
    r"(?i)\b(là|được|có|đã|sẽ|đang|gồm|bao gồm|theo|cho biết|công bố|ra mắt|đạt|tăng|giảm|triệu|tỷ|nghìn)\b",
    r"\b[A-Z][a-z]{2,}\b",
]
NO_CLAIM = [r"^\s*\[?\d+\]?\s*$", r"(?i)^\s*(source|nguồn)\s*:", r"^\s*#+\s", r"^\s*[-*]\s+\[?\d+\]?"]
CLAIM_LETTERS = 8


def is_claim(sentence: Column) -> Column:
    """Whether a sentence states something: it has a number, a name or a word of INFORMATIVE, and is no question, label, heading, citation or list mark."""
    some = lambda patterns: reduce(lambda a, b: a | b, [sentence.rlike("(?Uu)" + p) for p in patterns])
    return (F.char_length(sentence) >= CLAIM_LETTERS) & ~F.rtrim(sentence).endswith("?") & ~some(NO_CLAIM) & some(INFORMATIVE)


def claims(text: Column, most: int = 8) -> Column:
    """The first sentences that state something (is_claim), with their closing marks."""
    parts = F.filter(F.transform(F.split(text, r"(?<=[.!?])\s+|\n+"), lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", "")), lambda x: x != "")
    return F.slice(F.filter(parts, is_claim), 1, most)


def legal_article(text: Column) -> Column:
    """Number of the first article that a legal text names."""
    return F.regexp_extract(text, r"(?:Điều|Article)\s+([0-9]+)", 1)


def legal_clause(text: Column) -> Column:
    """Article and clause ("Điều 5, Khoản 2") that a legal text names first; without a clause the article only, null without an article."""
    article = legal_article(text)
    clause = F.regexp_extract(text, r"(?:Khoản|Clause)\s+([0-9]+)", 1)
    named = F.when(clause != "", F.concat(F.lit("Điều "), article, F.lit(", Khoản "), clause)).otherwise(F.concat(F.lit("Điều "), article))
    return F.when(article != "", named)


def decompose(query: Column, most: int = 2) -> Column:
    """The questions that a query joins, at most `most` (the last holds the rest); a query without a conjunction is one.

    Words of comparison at a question's begin go. A question that begins with an aspect (price, camera) and does not
    name the first question's thing gets it in front: the first question without an aspect at its end.
    """
    whole = F.trim(F.coalesce(query, F.lit("")))
    joins = rf"(?iu)(?<![\p{{L}}\p{{N}}_])(?:{'|'.join(CONJUNCTIONS)})(?![\p{{L}}\p{{N}}_])"
    longest = lambda words: "|".join(sorted(words, key=len, reverse=True))
    plain = lambda x: F.trim(F.regexp_replace(F.trim(x), rf"(?iu)^(?:{longest(COMPARISON_PREFIXES)})", ""))

    def made(parts):
        first = F.slice(parts, 1, most - 1)
        cut = F.transform(F.when(F.size(parts) > most, F.concat(first, F.array(F.array_join(F.slice(parts, most, 1 << 20), " ")))).otherwise(parts), plain)
        return F.when(F.size(parts) <= 1, F.array(whole)).otherwise(let(cut, carried))

    def carried(parts):
        head = F.element_at(parts, 1)
        thing = F.trim(F.regexp_replace(head, rf"(?iu)(?<![\p{{L}}\p{{N}}_])(?:{longest(ASPECTS)})\s*$", ""))
        alone = lambda x: F.lower(x).rlike(rf"^(?:{'|'.join(ASPECTS)})") & (thing != "") & ~F.contains(F.lower(x), F.lower(thing))
        return F.transform(parts, lambda x, i: F.when((i > 0) & alone(x), F.concat(thing, F.lit(" "), x)).otherwise(x))

    return let(F.filter(F.transform(F.split(whole, joins), lambda x: F.trim(x)), lambda x: x != ""), made)
