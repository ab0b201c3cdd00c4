"""Classes of sensitive text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Class, pattern, in order of priority. The first that is found names the text.
SENSITIVE_PATTERNS = [
    ("CREDENTIAL_AWS_KEY", r"AKIA[0-9A-Z]{16}"),
    ("CREDENTIAL_JWT", r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+"),
    ("CREDENTIAL_PRIVATE_KEY", r"0x[a-fA-F0-9]{64}"),
    ("PII_SSN", r"\b\d{3}-\d{2}-\d{4}\b"),
    ("PII_CREDIT_CARD", r"\b(\d{4}[-\s]?){3}\d{4}\b"),
    ("PII_EMAIL", r"(?i)[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}"),
]

# Text that each class cannot do without: a plain search for it spares most rows the pattern.
_NEEDS = {
    "CREDENTIAL_AWS_KEY": "AKIA",
    "CREDENTIAL_JWT": "eyJ",
    "CREDENTIAL_PRIVATE_KEY": "0x",
    "PII_SSN": "-",
    "PII_EMAIL": "@",
}
# The same where it is no fixed text: four digits in a row, found without trying word boundaries.
_NEEDS_MATCH = {"PII_CREDIT_CARD": r"\d{4}"}


def found(text: Column, name: str) -> Column:
    """Whether the class's pattern occurs anywhere in the text."""
    hit = text.rlike(dict(SENSITIVE_PATTERNS)[name])
    if name in _NEEDS:
        return text.contains(_NEEDS[name]) & hit
    return text.rlike(_NEEDS_MATCH[name]) & hit if name in _NEEDS_MATCH else hit


def classify(text: str | Column) -> Column:
    """First class whose pattern occurs anywhere in the whole text, else NULL."""
    text = F.col(text) if isinstance(text, str) else text
    return F.coalesce(*(F.when(found(text, name), F.lit(name)) for name, _ in SENSITIVE_PATTERNS))
