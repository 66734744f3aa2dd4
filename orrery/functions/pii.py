"""Personal data: recognisers, checksums, scores and decisions as column functions."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values: (pattern, score) of each entity type. A number with a checksum that holds scores 1, else it is left.
RECOGNISERS = {
    "KR_RRN": [(r"\b\d{6}-[1-4]\d{6}\b", 0.9), (r"\b\d{6}[1-4]\d{6}\b", 0.6)],
    "KR_PASSPORT": [(r"\b[A-Z][0-9]{8}\b", 0.8)],
    "KR_DRIVER_LICENSE": [(r"\b\d{2}-\d{2}-\d{6}-\d{2}\b", 0.85)],
    "KR_BANK_ACCOUNT": [(r"\b\d{3,4}-\d{2,6}-\d{4,7}(?:-\d{1,3})?\b", 0.75)],
    "KR_BRN": [(r"\b\d{3}-\d{2}-\d{5}\b", 0.9)],
}
#: A card number of any maker (with a Luhn check), one in groups, and one in a row (both without).
CARD = r"\b(?!1\d{12}(?!\d))(?:4\d{3}|5[0-5]\d{2}|6\d{3}|1\d{3}|3\d{3})[- ]?\d{3,4}[- ]?\d{3,4}[- ]?\d{3,5}\b"
CARD_GROUPS = r"(?<!\d)(?:\d{4}[-\s]\d{4}[-\s]\d{4}[-\s]\d{4}|\d{4}[-\s]\d{6}[-\s]\d{5})(?!\d)"
CARD_ROW = r"(?<!\d)(?:4[0-9]{12}(?:[0-9]{3})?|5[1-5][0-9]{14}|3[47][0-9]{13}|6(?:011|5[0-9]{2})[0-9]{12})(?!\d)"
#: What is looked for in generated output, in this order, and what each becomes when it is removed.
OUTPUT = [
    ("KR_RRN", r"(?<!\d)\d{6}-[1-4]\d{6}(?!\d)", "[주민등록번호 제거됨]"),
    ("KR_PASSPORT", r"(?<![A-Z])[A-Z]\d{7,8}(?!\d)", "[여권번호 제거됨]"),
    ("KR_DRIVER_LICENSE", r"(?<!\d)\d{2}-\d{2}-\d{6}-\d{2}(?!\d)", "[운전면허 제거됨]"),
    ("KR_BANK_ACCOUNT", r"(?<!\d)(?!(?:01[0-9]|02|0[3-9]\d)[-\s])\d{3,4}[-\s]\d{2,4}[-\s]\d{4,6}(?:[-\s]\d{1,3})?(?!\d)", "[계좌번호 제거됨]"),
    ("KR_BRN", r"(?<!\d)\d{3}-\d{2}-\d{5}(?!\d)", "[사업자번호 제거됨]"),
]
EMAIL_REMOVAL = (r"[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}", "[이메일 제거됨]")
OUTPUT_CARDS = [CARD_ROW, r"(?<!\d)(?:\d{4}[-\s]){3}\d{4}(?!\d)", r"(?<!\d)\d{4}[-\s]\d{6}[-\s]\d{5}(?!\d)"]
#: What is looked for in the text blocks of an image.
IMAGE = {
    "KR_RRN": r"\b\d{6}\s*[-–—]\s*\d{7}\b",
    "KR_RRN_SPACE": r"\b\d{6}\s+\d{7}\b",
    "KR_PASSPORT": r"\b[A-Za-z]\d{8}\b",
    "KR_DRIVER_LICENSE": r"\b\d{2}-\d{2}-\d{6}-\d{2}\b",
    "KR_BANK_ACCOUNT": r"\b\d{3,4}[-\s]\d{2,4}[-\s]\d{4,6}\b",
    "KR_BRN": r"\b\d{3}-\d{2}-\d{5}\b",
    "KR_PHONE": r"\b(?:010|011|016|017|018|019|02|\d{3})[\s-]\d{3,4}[\s-]\d{4}\b",
    "EMAIL": r"\b[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}\b",
    "CREDIT_CARD": r"\b\d{4}[-\s]\d{4}[-\s]\d{4}[-\s]\d{4}\b",
}
#: Words near a bank account, repeats of a value that make it a table's or a footer's, and the characters that count as near.
BANKS = ["국민은행", "KB국민", "KB", "신한은행", "신한", "우리은행", "우리", "하나은행", "하나", "카카오뱅크", "카카오", "농협", "NH", "NH농협", "기업은행", "IBK", "SC제일은행", "제일은행", "SC은행", "우체국", "토스뱅크", "토스", "한국은행", "산업은행", "수협", "씨티은행"]
ACCOUNT_WORDS = ["계좌", "계좌번호", "입금", "송금", "통장", "예금주", "입금처", "계좌이체", "이체", "출금", "account", "bank"]
MOST_REPEATS, NEAR = 5, 120
#: Sensitivity of the protected types; other types have none.
WEIGHTS = {"KR_RRN": 1.0, "KR_PASSPORT": 0.9, "KR_DRIVER_LICENSE": 0.8, "KR_BANK_ACCOUNT": 0.85, "KR_BRN": 0.6, "CREDIT_CARD": 0.88}
#: Exposure of each type in the risk score; types that are not listed have 0.30.
EXPOSURE = WEIGHTS | {"KR_PHONE": 0.0, "PERSON": 0.4, "EMAIL_ADDRESS": 0.0, "PHONE_NUMBER": 0.0}
#: Words of a request that make it risky, and those that ask for everything.
RISK_WORDS = ["전부", "모두", "전체 출력", "dump", "export", "삭제", "all records", "raw data", "원문 전부", "개인정보 전부", "주민번호", "계좌번호", "비밀번호", "카드번호", "패스워드", "여권", "passport", "운전면허", "사업자번호", "사업자등록", "개인정보"]
BULK_WORDS = ["전부", "모두", "전체 출력", "dump", "export", "all records", "raw data", "원문 전부", "개인정보 전부", "삭제"]
RESULT_BULK_WORDS = ["전부", "모두", "전체", "all", "dump", "export"]
#: Attempts to get round the policy.
BYPASS = [r"보안\s*무시", r"정책\s*무시", r"규칙\s*무시", r"ignore\s+policy", r"ignore\s+security", "bypass", "jailbreak", r"이전\s*지시\s*무시", r"모든\s*규칙\s*무시", r"DAN\s*mode", r"developer\s+mode"]
#: Types that make an answer be written again.
HIGH_RISK = ["KR_RRN", "KR_PASSPORT", "KR_BANK_ACCOUNT", "KR_DRIVER_LICENSE", "CREDIT_CARD"]
#: Makers and wordings of payment cards.
CARD_BRANDS = ["american express", "americanexpress", "amex", "아멕스", "mastercard", "master card", "visa", "discover", "jcb", "unionpay", "diners club", "마스터카드", "비자카드", "신용카드", "체크카드", "우리카드", "신한카드", "삼성카드", "현대카드", "롯데카드", "국민카드", "kb국민", "nh카드", "하나카드"]
CARD_FACE = ["valid thru", "valid from", "month/year", "good thru", "expires end", "member since", "cvv", "cvc"]
#: A document's kind by the types that it must hold, then by words.
KIND_BY_TYPES = [(["KR_PASSPORT"], "passport"), (["KR_RRN"], "rrn_document"), (["KR_DRIVER_LICENSE"], "driver_license"), (["KR_BANK_ACCOUNT"], "bank_document"), (["KR_BRN"], "business_registration"), (["CREDIT_CARD"], "payment_card"), (["PERSON", "EMAIL_ADDRESS"], "personal_contact"), (["PHONE_NUMBER"], "contact_info")]
KIND_BY_WORDS = [
    (["여권", "passport", "mrz", "nationality"], "passport"),
    (["주민등록", "주민번호", "rrn"], "rrn_document"),
    (["운전면허", "driver", "면허번호"], "driver_license"),
    (["계좌", "account", "은행", "bank"], "bank_document"),
    (["사업자등록", "사업자번호", "brn"], "business_registration"),
    (["회의", "meeting", "minutes", "agenda"], "meeting"),
    (["계약", "contract", "agreement"], "contract"),
    (["보고서", "report", "분석"], "report"),
]
#: What the text that is embedded for a document says of its kind and its types.
KIND_TERMS = {
    "passport": ["여권", "passport", "여권번호", "여권사진", "해외여행"],
    "rrn_document": ["주민등록", "주민번호", "주민등록증"],
    "driver_license": ["운전면허", "면허증", "driver"],
    "bank_document": ["계좌", "은행", "bank", "account", "금융"],
    "business_registration": ["사업자등록증", "사업자번호", "법인"],
    "personal_contact": ["연락처", "이름", "이메일", "contact"],
    "contact_info": ["전화번호", "연락처", "phone"],
    "meeting": ["회의", "meeting", "agenda", "회의록"],
    "contract": ["계약", "contract", "agreement", "계약서"],
    "report": ["보고서", "report", "분석", "통계"],
}
TYPE_TERMS = {
    "KR_PASSPORT": ["여권", "passport", "여권번호"],
    "KR_RRN": ["주민번호", "주민등록번호"],
    "KR_DRIVER_LICENSE": ["운전면허", "면허번호"],
    "KR_BANK_ACCOUNT": ["계좌번호", "통장번호"],
    "KR_BRN": ["사업자번호", "사업자등록번호"],
    "CREDIT_CARD": ["카드번호", "신용카드", "체크카드"],
    "PERSON": ["이름", "성명"],
    "EMAIL_ADDRESS": ["이메일", "email"],
    "PHONE_NUMBER": ["전화번호", "휴대폰"],
}
#: Metadata must not have these fields, nor types that look like values.
FORBIDDEN_FIELDS = ["rrn_value", "passport_number", "account_number", "phone", "email", "name", "address"]
VALUE_LIKE = r"\b\d{6,}\b|\b[A-Z]\d{8}\b|\b\d{3}-\d{2}-\d{5}\b|\b\d{4}-\d{4}-\d{4}\b"


def _weighted(digits: Column, weights: list[int]) -> Column:
    total = F.lit(0)
    for i, w in enumerate(weights):
        total = total + F.substring(digits, i + 1, 1).cast("int") * w
    return total


def resident_valid(number: Column) -> Column:
    """Modulo-11 check of a 13-digit resident number."""
    d = F.regexp_replace(number, "-", "")
    check = (11 - _weighted(d, [2, 3, 4, 5, 6, 7, 8, 9, 2, 3, 4, 5]) % 11) % 10
    return check == F.substring(d, 13, 1).cast("int")


def business_valid(number: Column) -> Column:
    """Weights 1 3 7 1 3 7 1 3 5; the ninth product's tens count again."""
    d = F.regexp_replace(number, "-", "")
    total = _weighted(d, [1, 3, 7, 1, 3, 7, 1, 3, 5]) + F.floor(F.substring(d, 9, 1).cast("int") * 5 / 10).cast("int")
    return (10 - total % 10) % 10 == F.substring(d, 10, 1).cast("int")


def any_word(text: Column, words: list[str]) -> Column:
    """Whether the text, in lower case, holds one of the words in lower case."""
    return reduce(or_, [F.lower(text).contains(w.lower()) for w in words])


def card_imagery(text: Column, is_image: Column) -> Column:
    """Signs of a payment card whose number cannot be read: makers or wordings, next to some digits unless it is an image."""
    digits = F.length(F.regexp_replace(text, "[^0-9]", ""))
    some = (digits >= 4) & text.rlike("[0-9]{4}")
    brand, face = any_word(text, CARD_BRANDS), any_word(text, CARD_FACE)
    return F.coalesce(F.when(is_image, brand | face | (digits >= 8) | some).otherwise((brand & (digits >= 8)) | ((brand | face) & some)), F.lit(False))


def protected(types: Column) -> Column:
    """The protected types among ``types``, in order, once each."""
    return F.array_distinct(F.filter(F.transform(types, F.upper), lambda t: t.isin(*WEIGHTS)))


def _weight(table: dict[str, float], rest: float):
    weights = F.create_map(*[x for k, w in table.items() for x in (F.lit(k), F.lit(w))])
    return lambda t: F.coalesce(weights[t], F.lit(rest))


def sensitivity(types: Column) -> Column:
    """Heaviest protected type plus .05 for each further one, at most 1; 0 without any."""
    kinds = protected(types)
    return F.when(F.size(kinds) == 0, 0.0).otherwise(F.round(F.least(F.lit(1.0), F.array_max(F.transform(kinds, _weight(WEIGHTS, 0.3))) + 0.05 * (F.size(kinds) - 1)), 4))


def privacy_risk(request: Column, contains: Column, ratio: Column, types: Column, bulk: Column) -> Column:
    """.30 risky words + .25 share of chunks with findings (.5 if only known to be there) + .30 exposure + .15 bulk; words of bulk give .65 at least."""
    density = F.when((ratio == 0) & contains, 0.5).otherwise(ratio)
    exposure = F.when(F.size(types) > 0, F.array_max(F.transform(types, lambda t: _weight(EXPOSURE, 0.3)(F.upper(t))))).otherwise(0.0)
    asks_all = any_word(request, BULK_WORDS)
    total = 0.30 * any_word(request, RISK_WORDS).cast("double") + 0.25 * density + 0.30 * exposure + 0.15 * (asks_all | bulk).cast("double")
    total = F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), total)), 4)
    return F.when(asks_all, F.greatest(total, F.lit(0.65))).otherwise(total)


def risk_label(score: Column) -> Column:
    return F.when(score >= 0.65, "DANGEROUS").when(score >= 0.30, "SENSITIVE").otherwise("NORMAL")


def decision(label: Column, bulk: Column) -> Column:
    """struct(allow, confirm, preview, event) of a label; an unknown one is blocked."""
    say = lambda a, c, p, e: F.struct(F.lit(a).alias("allow"), F.lit(c).alias("confirm"), F.lit(p).alias("preview"), F.lit(e).alias("event"))
    label = F.upper(label)
    return (
        F.when((label == "NORMAL") & bulk, say(True, True, False, "NORMAL_BULK_CONFIRM"))
        .when(label == "NORMAL", say(True, False, False, "NORMAL_ALLOWED"))
        .when(label == "SENSITIVE", say(True, True, True, "SENSITIVE_MASKED_PREVIEW"))
        .when(label == "DANGEROUS", say(False, False, False, "DANGEROUS_BLOCKED"))
        .otherwise(say(False, False, False, "UNKNOWN_LABEL_BLOCKED"))
    )


def upload_directive(choice: Column) -> Column:
    """struct(proceed, mask, exclude_pii_chunks) of a user's choice; anything else cancels."""
    say = lambda p, m, x: F.struct(F.lit(p).alias("proceed"), F.lit(m).alias("mask"), F.lit(x).alias("exclude_pii_chunks"))
    return F.when(choice == "mask_and_embed", say(True, True, False)).when(choice == "skip_pii_chunks", say(True, False, True)).when(choice == "embed_all", say(True, False, False)).otherwise(say(False, False, False))


def bypasses(text: Column) -> Column:
    return text.rlike("(?i)" + "|".join(BYPASS))


def removed(text: Column) -> Column:
    """Output without personal data: each kind's marker in its place, in order; cards are not removed."""
    for _, pattern, mark in OUTPUT:
        text = F.regexp_replace(text, pattern, mark)
    return F.regexp_replace(text, *EMAIL_REMOVAL)


def document_kind(types: Column, text: Column) -> Column:
    """By the types that it holds, else by the words in it."""
    out = None
    for needed, kind in KIND_BY_TYPES:
        fits = F.size(F.array_except(F.array(*map(F.lit, needed)), types)) == 0
        out = F.when(fits, kind) if out is None else out.when(fits, kind)
    for words, kind in KIND_BY_WORDS:
        out = out.when(any_word(text, words), kind)
    return out.otherwise("unknown")


def critic(blocked: Column, request: Column, output: Column, found: Column, bulk: Column, contains: Column, types: Column, score: Column) -> Column:
    """struct(decision, action) of an answer: the first of six checks that fits. found: types in the output; types: those of the sources."""
    say = lambda d, a: F.struct(F.lit(d).alias("decision"), F.lit(a).alias("action"))
    plain = ["KR_PHONE", "PHONE_NUMBER", "EMAIL_ADDRESS", "EMAIL", "IBAN_CODE"]
    return (
        F.when(blocked, say("reject", "block"))
        .when(bypasses(F.concat(request, F.lit(" "), output)), say("reject", "block"))
        .when(F.arrays_overlap(found, F.array(*map(F.lit, HIGH_RISK))), say("regenerate_with_constraints", "regenerate"))
        .when(F.size(found) > 0, say("approve_masked", "mask"))
        .when(bulk, say("reject", "block"))
        .when(contains & (F.size(types) > 0) & (F.size(F.array_except(F.transform(types, F.upper), F.array(*map(F.lit, plain)))) == 0), say("approve", "show"))
        .when(contains, say("approve_masked", "mask"))
        .otherwise(F.struct(F.lit("approve").alias("decision"), F.when(score >= 8, "show").otherwise("show").alias("action")))
    )


def embedding_text(kind: Column, types: Column) -> Column:
    """Terms of the kind, then each type and its terms, then that personal data is there; no value of any."""
    terms = lambda table: F.create_map(*[x for k, v in table.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    of_types = F.flatten(F.transform(types, lambda t: F.concat(F.array(t), F.coalesce(terms(TYPE_TERMS)[t], F.array().cast("array<string>")))))
    mark = F.when(F.size(types) > 0, F.array(*map(F.lit, ["개인정보", "PII", "민감문서"]))).otherwise(F.array().cast("array<string>"))
    return F.array_join(F.concat(F.coalesce(terms(KIND_TERMS)[kind], F.array(kind)), of_types, mark), " ")


def metadata_fault(fields: Column, types: Column) -> Column:
    """Why metadata must not be stored; null if it may."""
    bad = F.filter(fields, lambda f: F.lower(f).isin(*FORBIDDEN_FIELDS))
    like = F.filter(types, lambda t: t.rlike(VALUE_LIKE))
    return F.when(F.size(bad) > 0, F.concat(F.lit("field "), bad[0])).when(F.size(like) > 0, F.concat(F.lit("value "), like[0]))
