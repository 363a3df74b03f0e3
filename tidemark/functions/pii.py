"""Patterns for personal and health data (group G) as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Name parts and patterns. Word edges look at the ASCII characters around and consume none of them.
PII_NAMES = "email|phone|ssn|social|passport|driver|credit|card|address|zip|postal"
PHI_NAMES = "patient|medical|diagnosis|treatment|health|prescription|symptom"
PHI_WORDS = "diagnosis|treatment|prescription|symptom|condition|medication|dosage|allergy|blood type|medical record"
L, R = "(?<![0-9A-Za-z_])", "(?![0-9A-Za-z_])"
PATTERNS = {
    # An address begins where its run of characters does, or where the address before ended: no run is tried twice.
    "EMAIL": r"(?:\G|(?<![a-zA-Z0-9._%+-]))[a-zA-Z0-9._%+-]++@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}",
    "PHONE": r"(?:\+?1[-.\s]?)?\(?[0-9]{3}\)?[-.\s]?[0-9]{3}[-.\s]?[0-9]{4}",
    "SSN": L + r"[0-9]{3}-?[0-9]{2}-?[0-9]{4}" + R,
    "CREDIT_CARD": L + r"[0-9]{4}[-\s]?[0-9]{4}[-\s]?[0-9]{4}[-\s]?[0-9]{4}" + R,
    "ZIP_CODE": L + r"[0-9]{5}(?:-[0-9]{4})?" + R,
    "IP": L + r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}" + R,
}
MEDICAL_CODE = r"[A-Z][0-9]{2}\.?[0-9]*"


def pii_by_name(name: Column) -> Column:
    return F.lower(name).rlike(PII_NAMES)


def phi_by_name(name: Column) -> Column:
    return F.lower(name).rlike(PHI_NAMES)


#: What a value must hold for a pattern to be worth a try.
HINTS = {"EMAIL": lambda v: v.contains("@")}


def holds(value: Column, name: str) -> Column:
    """Whether the pattern occurs in the value."""
    found = value.rlike(PATTERNS[name])
    return HINTS[name](value) & found if name in HINTS else found


def count_of(value: Column, name: str) -> Column:
    """How often the pattern occurs in the value."""
    n = F.regexp_count(value, F.lit(PATTERNS[name]))
    return F.when(HINTS[name](value), n).otherwise(0) if name in HINTS else n


def pii_by_content(value: Column, category: Column | None = None) -> Column:
    """Any pattern; null is no hit. With the value's category (G6) at hand only addresses are left to try."""
    if category is None:
        category = pii_category(value)
    return F.coalesce(~category.isin("IDENTIFIER", "UNKNOWN") | holds(value, "IP"), F.lit(False))


def phi_by_content(value: Column) -> Column:
    """G4."""
    return F.coalesce(value.rlike(MEDICAL_CODE) | F.lower(value).rlike(PHI_WORDS), F.lit(False))


def pii_category(value: Column) -> Column:
    """The first pattern that fits; an address alone is an IDENTIFIER, no text UNKNOWN."""
    out = F.when(value.isNull() | (value == ""), "UNKNOWN")
    for name in PATTERNS:
        if name != "IP":
            out = out.when(holds(value, name), name)
    return out.otherwise("IDENTIFIER")


def confidence(name: Column, text_type: Column, by_content: Column) -> Column:
    """G7."""
    base = F.when(by_content, 0.85).when(F.lower(name).rlike("email|phone|ssn"), 0.75).otherwise(0.60)
    return F.least(F.lit(1.0), F.round(base + F.when(text_type, 0.05).otherwise(0.0), 2))
