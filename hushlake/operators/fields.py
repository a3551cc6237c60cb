"""Form fields: what a field holds, from what its page says about it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hushlake.functions.taxonomy import PROFILE_KEYS
from hushlake.functions.text import EDGE as E

#: What a page's own declaration means.
AUTOCOMPLETE = {
    "current-password": "PASSWORD", "new-password": "PASSWORD", "one-time-code": "OTP", "cc-number": "CARD",
    "cc-csc": "CVV", "cc-exp": "CARD", "cc-exp-month": "CARD", "cc-exp-year": "CARD", "cc-name": "NAME",
    "cc-given-name": "NAME", "cc-family-name": "NAME", "email": "EMAIL", "tel": "PHONE", "tel-national": "PHONE",
    "tel-local": "PHONE", "tel-country-code": "PHONE", "bday": "DOB", "bday-day": "DOB", "bday-month": "DOB",
    "bday-year": "DOB", "street-address": "ADDRESS", "address-line1": "ADDRESS", "address-line2": "ADDRESS",
    "address-line3": "ADDRESS", "address-level1": "ADDRESS", "address-level2": "ADDRESS", "postal-code": "PINCODE",
    "name": "NAME", "given-name": "NAME", "family-name": "NAME", "additional-name": "NAME",
    "honorific-prefix": "NAME", "honorific-suffix": "NAME",
}
INERT = ("submit", "button", "reset", "image", "file", "range", "color", "checkbox", "radio")
_WHO = "full|first|last|middle|given|legal|holder'?s?|applicant'?s?|candidate'?s?|student'?s?|member'?s?|beneficiary'?s?|employee'?s?|passenger'?s?|father'?s?|mother'?s?|spouse'?s?|guardian'?s?|nominee'?s?|your"
#: Fixed values, in order; the first that fits wins.
KEYWORDS = (
    ("PASSWORD", "kw:password", f"{E}(?:password|passwd|pwd|passphrase){E}", 0.97),
    ("AADHAAR", "kw:aadhaar", f"{E}(?:aadhaar|aadhar|adhaar|uidai|uid\\s*number){E}", 0.97),
    ("PAN", "kw:pan", f"{E}pan{E}(?!\\s*(?:card\\s*)?(?:image|photo|upload))|{E}permanent\\s+account\\s+number{E}", 0.95),
    ("PASSPORT", "kw:passport", f"{E}passport{E}", 0.95),
    ("CVV", "kw:cvv", f"{E}(?:cvv|cvc|csc|card\\s*(?:security|verification)\\s*(?:code|value)){E}", 0.96),
    ("CARD", "kw:card", f"{E}(?:(?:credit|debit|atm)\\s*card|card\\s*(?:number|no\\.?)|cardnumber){E}", 0.95),
    ("IFSC", "kw:ifsc", f"{E}(?:ifsc|swift\\s*code|micr){E}", 0.95),
    ("UPI", "kw:upi", f"{E}(?:upi|vpa|virtual\\s+payment\\s+address){E}", 0.94),
    ("ACCOUNT", "kw:account", f"{E}(?:a/c|acct?|account)\\s*(?:number|no\\.?|#){E}|{E}bank\\s*acc(?:oun)?t?{E}", 0.94),
    ("OTP", "kw:otp", f"{E}(?:otp|one[\\s-]?time\\s*(?:code|password|pin)|verification\\s*code|auth\\s*code){E}", 0.94),
    ("EMAIL", "kw:email", f"{E}(?:e[\\s-]?mail|email\\s*(?:id|address)?){E}", 0.95),
    ("PHONE", "kw:phone", f"{E}(?:mob(?:ile)?|phone|contact\\s*(?:number|no\\.?)|whatsapp|telephone|msisdn){E}", 0.94),
    ("DOB", "kw:dob", f"{E}(?:dob|date\\s*of\\s*birth|birth\\s*date|birthday){E}", 0.94),
    ("PINCODE", "kw:pincode", f"{E}(?:pin\\s*code|pincode|postal\\s*code|post\\s*code|zip\\s*code|zip){E}", 0.92),
    ("ADDRESS", "kw:address", f"{E}(?:address|street|locality|landmark|house\\s*no|flat\\s*no|city|district|residence){E}", 0.88),
    ("NAME", "kw:name", f"{E}(?:(?:{_WHO})\\s*name|surname|name\\s*of\\s*(?:the\\s*)?(?:applicant|candidate|student|holder|nominee)){E}", 0.90),
    ("GENERIC", "kw:sensitive", f"{E}(?:salary|income|ssn|social\\s*security|tax\\s*id|gstin|voter\\s*id|driving\\s*licen[sc]e|licence\\s*number|nominee|blood\\s*group|pin){E}", 0.80),
)
_PEOPLE = "आवेदक|उम्मीदवार|अभ्यर्थी|छात्र|छात्रा|विद्यार्थी|पिता|माता|पति|पत्नी|अभिभावक|नामांकित व्यक्ति|लाभार्थी|कर्मचारी|यात्री|सदस्य|धारक"
#: Fixed values for labels in Hindi, tried after the English ones.
HINDI = (
    ("OTP", "kw:otp-hi", "ओटीपी|एक बार का पासवर्ड|सत्यापन कोड", 0.94),
    ("PASSWORD", "kw:password-hi", "पासवर्ड|कूटशब्द", 0.97),
    ("AADHAAR", "kw:aadhaar-hi", "आधार", 0.95),
    ("PAN", "kw:pan-hi", "पैन|स्थायी खाता संख्या", 0.94),
    ("PASSPORT", "kw:passport-hi", "पासपोर्ट", 0.95),
    ("CVV", "kw:cvv-hi", "सीवीवी", 0.96),
    ("CARD", "kw:card-hi", "(?:क्रेडिट|डेबिट|एटीएम)\\s*कार्ड|कार्ड\\s*(?:संख्या|नंबर|नम्बर)", 0.94),
    ("IFSC", "kw:ifsc-hi", "आईएफएससी", 0.95),
    ("UPI", "kw:upi-hi", "यूपीआई", 0.94),
    ("ACCOUNT", "kw:account-hi", "(?:बैंक\\s*)?खाता\\s*(?:संख्या|नंबर|नम्बर|क्रमांक)|बैंक खाता", 0.94),
    ("EMAIL", "kw:email-hi", "ई\\s*मेल", 0.95),
    ("PHONE", "kw:phone-hi", "मोबाइल|मोबाईल|फ़ोन|फोन|दूरभाष|संपर्क\\s*(?:नंबर|संख्या|सूत्र)", 0.94),
    ("DOB", "kw:dob-hi", "जन्म\\s*(?:तिथि|तारीख|दिनांक)|जन्मतिथि|जन्म की तारीख", 0.94),
    ("PINCODE", "kw:pincode-hi", "पिन\\s*कोड|पिनकोड|डाक\\s*सूचकांक", 0.92),
    ("ADDRESS", "kw:address-hi", "पता|गली|मोहल्ला|शहर|जिला|ज़िला|गाँव|गांव|निवास", 0.88),
    ("NAME", "kw:name-hi", "नाम|उपनाम", 0.88),
    ("GENERIC", "kw:sensitive-hi", "वेतन|आय|मतदाता पहचान पत्र|ड्राइविंग लाइसेंस|रक्त समूह|नामांकित", 0.80),
)
#: Hints about pictures, in order.
PICTURES = (
    ("avatar-like", f"{E}(?:avatar|profile|headshot|selfie|portrait|user[-_]?pic|photo|dp){E}"),
    ("document-like", f"{E}(?:aadhaar|aadhar|pan|passport|licen[sc]e|id[-_]?card|kyc|document|scan){E}"),
    ("signature-like", f"{E}(?:signature|sign){E}"),
    ("code-like", f"{E}(?:qr|barcode){E}"),
)
SOMEONE_ELSE = (
    f"(?i){E}(?:father|mother|guardian|spouse|husband|wife|nominee|parent|son|daughter|brother|sister|relative|emergency|referee"
    f"|reference|witness|co-?applicant|alternate|alternative|secondary|office|employer|company|institute|institution|college|school"
    f"|university){E}|पिता|माता|पति|पत्नी|अभिभावक|नामांकित"
)
PART_OF_NAME = f"{E}(?:first|last|middle|given|family|sur|nick|user|display|login|account|pet)\\s*name{E}|{E}(?:surname|username){E}"


def _hindi(alternatives: str) -> str:
    return f"(?<![\\u0900-\\u097F])(?:{alternatives})(?![\\u0900-\\u097F])"


def field_context(label: Column, aria: Column, placeholder: Column, name: Column, id_: Column, title: Column) -> Column:
    """Everything the page says about the field, as words."""
    said = [F.when(c != "", c) for c in (label, aria, placeholder, name, id_, title)]
    split = F.regexp_replace(F.concat_ws(" ", *said), "([a-z0-9])([A-Z])", "$1 $2")
    return F.lower(F.regexp_replace(split, "[_\\-.]+", " "))


def _personal(context: Column) -> Column:
    """Whether a Hindi label with the word for name is about a person."""
    about = context.rlike(_hindi(f"(?:{_PEOPLE})\\s*(?:का|की|के)\\s*नाम"))
    before = F.regexp_extract(context, "^(.*?)" + _hindi("नाम"), 1)
    has = context.rlike(_hindi("नाम"))
    return about | (has & ~before.rlike("(?:का|की|के)\\s*$"))


def _answer(kind: str | Column, reason: Column, confidence: float) -> Column:
    kind = F.lit(kind) if isinstance(kind, str) else kind
    return F.struct(kind.alias("type"), reason.alias("reason"), F.lit(confidence).alias("confidence"))


NO_ANSWER = "struct<type:string,reason:string,confidence:double>"


def classified_field(tag, type_, autocomplete, editable, context) -> Column:
    """(type, reason, confidence) or null: an ordered choice, first fit wins."""
    tag, kind = F.lower(tag), F.lower(F.coalesce(type_, F.lit("")))
    parts = F.split(F.lower(F.trim(F.coalesce(autocomplete, F.lit("")))), "\\s+")
    table = F.create_map(*[F.lit(x) for kv in AUTOCOMPLETE.items() for x in kv])
    declared = F.get(F.filter(parts, lambda p: F.try_element_at(table, p).isNotNull()), 0)
    choice = (
        F.when((tag == "input") & (kind == "password"), _answer("PASSWORD", F.lit("input[type=password]"), 1.0))
        .when((tag == "input") & kind.isin(*INERT), F.lit(None).cast(NO_ANSWER))
        .when(~tag.isin("input", "textarea", "select") & ~F.coalesce(editable, F.lit(False)), F.lit(None).cast(NO_ANSWER))
        .when(declared.isNotNull(), _answer(F.try_element_at(table, declared), F.concat(F.lit("autocomplete="), declared), 0.98))
        .when(context == "", F.lit(None).cast(NO_ANSWER))
    )
    for kind_, reason, pattern, confidence in KEYWORDS:
        choice = choice.when(context.rlike(pattern), _answer(kind_, F.lit(reason), confidence))
    for kind_, reason, pattern, confidence in HINDI:
        fits = context.rlike(_hindi(pattern))
        choice = choice.when(fits & _personal(context) if kind_ == "NAME" else fits, _answer(kind_, F.lit(reason), confidence))
    return choice


def classify_fields(df: DataFrame, keep: tuple[str, ...] = ("field_id",)) -> DataFrame:
    """``df`` has tag, type, label, aria_label, placeholder, name, id, title,
    autocomplete, editable; unclassified fields give nulls."""
    c = field_context(*[F.col(x) for x in ("label", "aria_label", "placeholder", "name", "id", "title")])
    staged = df.withColumn("__c", c)
    answer = classified_field(F.col("tag"), F.col("type"), F.col("autocomplete"), F.col("editable"), F.col("__c"))
    return staged.select(*keep, answer.alias("__a")).select(*keep, F.col("__a.type").alias("kind"), "__a.reason", "__a.confidence")


def image_hint(alt: Column, css: Column, src: Column) -> Column:
    text = F.lower(F.concat_ws(" ", alt, css, F.substring_index(src, "?", 1)))
    hint = F.lit(None).cast("string")
    for name, pattern in reversed(PICTURES):
        hint = F.when(text.rlike(pattern), F.lit(name)).otherwise(hint)
    return hint


def profile_key(kind: Column, label: Column) -> Column:
    """The profile key that an answer belongs in, or null."""
    text = F.lower(F.coalesce(label, F.lit("")))
    direct = F.create_map(*[F.lit(x) for kv in PROFILE_KEYS.items() if kv[0] not in ("NAME", "ADDRESS") for x in kv])
    return (
        F.when(kind.isNull() | text.rlike(SOMEONE_ELSE), F.lit(None).cast("string"))
        .when(kind == "NAME", F.when(~text.rlike(PART_OF_NAME), F.lit("FULL_NAME")))
        .when(kind == "ADDRESS", F.when(text.rlike("address|पता"), F.lit("ADDRESS")))
        .otherwise(F.try_element_at(direct, kind))
    )


def role_of(tag: Column, kind: Column, role: Column, editable: Column) -> Column:
    """What a control is: the role it names itself, else that of its tag and type."""
    t, k = F.lower(tag), F.lower(F.coalesce(kind, F.lit("text")))
    of_input = (
        F.when(k.isin("checkbox", "radio", "file"), k).when(k.isin("submit", "button", "reset", "image"), "button")
        .when(k == "range", "slider").when(k == "search", "searchbox").otherwise("textbox")
    )
    of_tag = (
        F.when(t == "a", "link").when(t.isin("button", "summary"), "button").when(t == "select", "combobox").when(t == "textarea", "textbox")
        .when(F.coalesce(editable, F.lit(False)), "textbox").when(t == "input", of_input).otherwise(t)
    )
    return F.coalesce(F.lower(F.nullif(role, F.lit(""))), of_tag)
