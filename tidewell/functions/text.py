"""String expressions: keys, names, ids in URLs, text measures and redaction.  All are built-in Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Sentinels that stand for an unknown customer and an unknown patient
UNKNOWN_CUSTOMER = "(고객명 미상)"
UNKNOWN_PATIENT = "(환자명 미상)"
# Fixed value: what stands in place of an owner for sales over the counter
RETAIL = "[RETAIL SALES]"

#: White space as a browser understands it, not only that of ASCII.
SPACE = r"(?U)[\s﻿]+"


def normalize_text(c: Column) -> Column:
    """STR-01: runs of white space become one space, and the ends are trimmed."""
    return F.trim(F.regexp_replace(c, SPACE, " "))


def normalize_key(c: Column) -> Column:
    """STR-02: a customer, receipt or bill number as a key: lower case, only letters, digits, underscore and hyphen."""
    return F.regexp_replace(F.lower(F.trim(c)), r"[^a-z0-9_-]", "")


def normalize_owner_name(c: Column) -> Column:
    """STR-03: an owner's name for comparison; null becomes empty."""
    return F.lower(normalize_text(F.coalesce(c, F.lit(""))))


def patient_names(c: Column) -> Column:
    """STR-04: the distinct names of a comma-separated list in order, without blanks."""
    names = F.transform(F.split(F.coalesce(c, F.lit("")), ","), normalize_owner_name)
    return F.array_sort(F.array_distinct(F.filter(names, lambda x: x != "")))


def split_owner_patients(c: Column) -> Column:
    """STR-05: a struct of owner and patients from "owner, (patient, patient)": what lies between the last opening and the last
    closing parenthesis are the patients.  Commas of the owner are tidied, those of the patients stay."""
    text = normalize_text(F.coalesce(c, F.lit("")))
    opened = F.length(text) - F.locate("(", F.reverse(text))  # before the last opening parenthesis
    closed = F.length(text) - F.locate(")", F.reverse(text))
    split = text.contains("(") & text.contains(")") & (opened < closed)
    tidy = lambda x: F.regexp_replace(F.regexp_replace(normalize_text(x), r"\s*,\s*$", ""), r"\s*,\s*", ", ")
    owner = F.when(split, tidy(F.substring(text, F.lit(1), opened))).otherwise(tidy(text))
    patients = F.when(split, normalize_text(F.substring(text, opened + 2, closed - opened - 1))).otherwise(F.lit(""))
    retail = text == RETAIL
    return F.struct(F.when(retail, text).otherwise(owner).alias("owner"), F.when(retail, F.lit("")).otherwise(patients).alias("patients"))


def occurrences(text: Column, term: Column) -> Column:
    """STR-08: how often a term occurs without overlaps; 0 for an empty term."""
    gone = F.length(text) - F.length(F.replace(text, term, F.lit("")))
    return F.when(F.length(term) > 0, (gone / F.length(term)).cast("long")).otherwise(F.lit(0).cast("long"))


def visible_chars(c: Column) -> Column:
    """STR-09: characters of a post without image markers, links' targets, tags, heading marks and white space."""
    plain = F.regexp_replace(c, r"!\[[^\]]*\]\([^)]*\)", "")
    plain = F.regexp_replace(plain, r"<[^>]+>", "")
    plain = F.regexp_replace(plain, r"(?m)^#{1,6}[ \t]*", "")
    plain = F.regexp_replace(plain, r"[*_`~>]", "")
    return F.length(F.regexp_replace(plain, SPACE, "")).cast("long")


def includes_loosely(text: Column, term: Column) -> Column:
    """STR-10: whether text contains term, white space aside; false for a blank term."""
    bare = F.regexp_replace(term, SPACE, "")
    return (bare != "") & F.contains(F.regexp_replace(text, SPACE, ""), bare)


def region_token(c: Column) -> Column:
    """STR-11: the first part of a region that ends in a district suffix, else its last part; without that suffix."""
    parts = F.filter(F.split(normalize_text(c), " "), lambda x: x != "")
    districts = F.filter(parts, lambda x: x.rlike("[구군]$"))
    found = F.when(F.size(districts) > 0, F.get(districts, F.lit(0))).otherwise(F.try_element_at(parts, F.lit(-1)))
    return F.when(F.length(found) > 2, F.regexp_replace(found, "[시구군]$", "")).otherwise(found)


def blog_id(c: Column) -> Column:
    """STR-13: the account in a blog's URL; a bare id is itself."""
    found = F.regexp_extract(c, r"(?:blog\.[a-z]+\.[a-z]+|m\.blog\.[a-z]+\.[a-z]+)/([A-Za-z0-9_-]+)", 1)
    return F.lower(F.when(found != "", found).otherwise(F.trim(c)))


def place_id(c: Column) -> Column:
    """STR-14: the number of a place in one of three kinds of URL; null where there is none."""
    patterns = (r"/place/(\d+)", r"/(?:hospital|restaurant)/(\d+)", r"[?&]id=(\d+)")
    return F.coalesce(*(F.nullif(F.regexp_extract(c, p, 1), F.lit("")) for p in patterns))


def store_name(c: Column) -> Column:
    """STR-15: a store's name with single spaces, an ampersand (written out or not) being one too; null becomes empty."""
    plain = F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("&amp;"), F.lit("&")), F.lit("&"), F.lit(" "))
    return normalize_text(plain)


def bare_store_name(c: Column) -> Column:
    """JN-25: a store's name as names are compared: without white space and ampersands."""
    return F.regexp_replace(store_name(c), " ", "")


def is_store(target: Column, seen: Column) -> Column:
    """JN-25: whether a name seen in a list is a store's: either holds the other, white space aside; a name that is part of the
    store's needs four characters."""
    t, s = bare_store_name(target), bare_store_name(seen)
    return (t != "") & (s != "") & (F.contains(s, t) | ((F.length(s) >= 4) & F.contains(t, s)))


def matches_literally(c: Column, term: str) -> Column:
    """FLT-09: whether a text contains a term in any case; per cent signs and underscores of the term stand for themselves."""
    escaped = term.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")
    return c.ilike(f"%{escaped}%")


def fold_lookalikes(c: Column) -> Column:
    """STR-16: Greek and Cyrillic capitals and small letters that look Latin become Latin."""
    # Look-alike letters and what they stand for, in the same order
    seen = "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧ" + "αβειηκμνορτυχ" + "АВЕКМНОРСТУХ" + "авекмнорстух"
    meant = "ABEZHIKMNOPTYX" + "abeinkmnoptux" + "ABEKMHOPCTYX" + "abekmhopctyx"
    return F.translate(c, seen, meant)


def ends_in_consonant(c: Column) -> Column:
    """STR-17: whether the last character is a Hangul syllable with a final consonant."""
    last = F.substring(F.trim(c), -1, 1)
    code = F.when(last != "", F.conv(F.hex(F.encode(last, "UTF-16BE")), 16, 10).cast("long"))
    return F.coalesce((code.between(0xAC00, 0xD7A3)) & ((code - 0xAC00) % 28 != 0), F.lit(False))


def with_particle(c: Column, after_consonant: str, after_vowel: str) -> Column:
    """STR-17: the word with the particle that fits its last sound."""
    return F.concat(c, F.when(ends_in_consonant(c), after_consonant).otherwise(after_vowel))


def redact(c: Column) -> Column:
    """STR-18: a text of at most 500 characters, with its length where it was cut, in which resident numbers, phone numbers and
    mail addresses are replaced."""
    c = F.when(F.length(c) > 500, F.concat(F.substring(c, 1, 500), F.lit("…("), F.length(c).cast("string"), F.lit("자)"))).otherwise(c)
    # Patterns of what is replaced, in this order, and by what
    patterns = [
        (r"\d{6}\s*-\s*[1-4]\d{6}", "[redacted:rrn]"),
        (r"01[016-9][-\s]?\d{3,4}[-\s]?\d{4}", "[redacted:phone]"),
        (r"0\d{1,2}[-\s]\d{3,4}[-\s]\d{4}", "[redacted:phone]"),
        # An address is looked for where a word begins or the last match ended, so a long word is read once and not from each character
        (r"(?:\G|(?<![\w.+-]))[\w.+-]++@[\w-]+\.[\w.-]+", "[redacted:email]"),
    ]
    for pattern, shown in patterns:
        c = F.regexp_replace(c, pattern, shown)
    return c


def is_private_key(c: Column) -> Column:
    """STR-18: whether a field's name, letters and digits only, tells that its value must not be kept."""
    # Names of private fields, and what other private names contain
    names = ["name", "patientname", "guardianname", "ownername", "username", "fullname", "phone", "phonenumber", "tel", "telephone", "mobile", "contact", "email", "address", "addressdetail", "zipcode", "postcode", "rrn", "ssn", "birth", "birthdate", "birthday", "dob", "cardnumber", "account", "accountnumber", "cvc", "memo", "note", "notes", "symptom", "symptoms", "diagnosis", "soap", "chiefcomplaint", "history", "content", "answer", "answers"]
    parts = ["password", "passwd", "secret", "token", "apikey", "accesskey", "authorization", "cookie", "credential"]
    key = F.regexp_replace(F.lower(c), "[^a-z0-9]", "")
    return key.isin(*names) | key.rlike("|".join(parts))


def redact_fields(fields: Column) -> Column:
    """STR-18: a map of texts in which private fields are replaced whole, and the others by what they contain."""
    return F.transform_values(fields, lambda k, v: F.when(is_private_key(k), F.lit("[redacted]")).otherwise(redact(v)))


def error_fingerprint(route: Column, message: Column) -> Column:
    """STR-19: 16 hexadecimal digits that are equal for messages that differ only in ids and numbers."""
    plain = F.regexp_replace(message, r"(?i)[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}", "<uuid>")
    plain = F.substring(F.regexp_replace(plain, r"\d+", "<n>"), 1, 300)
    return F.substring(F.sha1(F.concat_ws("|", F.coalesce(route, F.lit("")), plain)), 1, 16)


def digest_key(*parts: Column) -> Column:
    """STR-20: SHA-256 of parts joined by a bar; nulls count as empty."""
    return F.sha2(F.concat_ws("|", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts)), 256)


def keyword_key(c: Column) -> Column:
    """STR-21 and JN-22: a keyword without white space, for joins in lower case."""
    return F.lower(F.regexp_replace(c, SPACE, ""))


def order_number(day: Column, n: Column) -> Column:
    """STR-07: the year and a number of at least four digits; longer ones are cut as the database does."""
    return F.concat(F.year(day).cast("string"), F.lit("-"), F.lpad(n.cast("string"), 4, "0"))


def species_profile(raw: Column) -> Column:
    """STR-12: canine, feline or null, by the words that an entry begins with."""
    # How the two species are written
    words = {"canine": ["canine", "dog", "개", "강아지", "견"], "feline": ["feline", "cat", "고양이", "묘"]}
    key = normalize_owner_name(raw)
    found = F.lit(None).cast("string")
    for profile, listed in words.items():
        found = F.when(key.rlike("^(" + "|".join(listed) + ")"), profile).otherwise(found)
    return found


def species_word(raw: Column) -> Column:
    """STR-12: the word for a species in a post."""
    profile = species_profile(raw)
    return F.when(profile == "canine", "강아지").when(profile == "feline", "고양이").otherwise("반려동물")


def keyword_density(body: Column, keyword: Column) -> Column:
    """MTH-04: share of a body's characters, white space aside, that lie in a keyword's occurrences, in percent with one digit."""
    body = F.coalesce(body, F.lit(""))
    n = F.length(F.regexp_replace(body, r"\s+", ""))
    return F.when(n > 0, F.round(occurrences(body, keyword) * F.length(keyword) * 100 / n, 1)).otherwise(F.lit(0.0))
