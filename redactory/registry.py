"""Recogniser registry: one row of data per pattern.

``guard`` is a literal that every match contains; texts without it skip the
pattern.  Patterns use ASCII classes and no look-around or anchors, so Java,
Python and RE2 read them alike and a match can be found again by its text; word
edges are tested on the neighbouring characters after the offsets are known.
"""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Recogniser:
    entity: str
    pattern: str
    guard: str | None
    score: float
    validator: str | None = None
    context: tuple[str, ...] = ()
    needs_digits: bool = True
    # The same matches in a form that only the JVM reads, where that is faster.
    jvm_pattern: str | None = None

    @property
    def name(self) -> str:
        return self.entity.title().replace("_", "") + "Recogniser"

    @property
    def pattern_name(self) -> str:
        return self.entity.lower()


# A validator that passes lifts the score of these kinds to 1.0; one that fails
# drops the span.  "ssn" and "date" only drop.
SCORE_LIFTING_VALIDATORS = {"luhn", "iban", "dea"}

# Every pattern that needs digits contains two of them with at most one separator
# between; texts without such a pair skip all those recognisers after one test.
DIGIT_PAIR = r"[0-9][-. /]?[0-9]"

CONTEXT_BOOST = 0.35
CONTEXT_WORDS = 5
CONTEXT_CHARS = 100

REGISTRY: tuple[Recogniser, ...] = (
    Recogniser("EMAIL_ADDRESS", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}",
               "@", 1.0, needs_digits=False,
               # A match starts where a run of local-part characters starts, or where the
               # last match ended; a run without an @ behind it is given up at once.
               jvm_pattern=r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"),
    Recogniser("PHONE_NUMBER", r"(?:\+1[ -])?\(?[0-9]{3}\)?[-. ][0-9]{3}[-. ][0-9]{4}",
               None, 0.4, None, ("phone", "call", "tel")),
    Recogniser("CREDIT_CARD", r"[0-9](?:[ -]?[0-9]){12,18}",
               None, 0.3, "luhn", ("card", "visa")),
    Recogniser("US_SSN", r"[0-9]{3}[-. ][0-9]{2}[-. ][0-9]{4}",
               None, 0.5, "ssn", ("ssn", "social")),
    Recogniser("US_ITIN", r"9[0-9]{2}[- ](?:5[0-9]|6[0-5]|7[0-9]|8[0-8]|9[0-24-9])[- ][0-9]{4}",
               None, 0.3, None, ("itin", "tax")),
    Recogniser("US_PASSPORT", r"[A-Z]?[0-9]{8,9}",
               None, 0.1, None, ("passport",)),
    Recogniser("US_DRIVER_LICENSE", r"[A-Z][0-9]{7,8}",
               None, 0.3, None, ("license", "driver")),
    Recogniser("US_BANK_NUMBER", r"[0-9]{8,17}",
               None, 0.05, None, ("account", "bank", "acct")),
    Recogniser("IP_ADDRESS", r"(?:[0-9]{1,3}\.){3}[0-9]{1,3}",
               None, 0.6, "octets", ("ip",)),
    Recogniser("URL", r"https?://[^ \t\r\n\x22\x27<>]+",
               "://", 0.6, needs_digits=False),
    Recogniser("IBAN_CODE", r"[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}",
               None, 0.5, "iban", ("iban",)),
    Recogniser("DATE_TIME", r"[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{1,2}/[0-9]{1,2}/[0-9]{2,4}",
               None, 0.6, "date", ("dob", "date")),
    Recogniser("MEDICAL_LICENSE", r"[A-Z]{2}[0-9]{7}",
               None, 0.4, "dea", ("dea",)),
)

# Entities found through dictionaries only (see operators.dictionary).
DICTIONARY_ENTITIES = ("PERSON", "LOCATION", "ORGANIZATION", "NRP")
DICTIONARY_SCORE = 0.85


def best_possible_score(r: Recogniser) -> float:
    """Highest score a recogniser can reach; decides plan-time pruning."""
    if r.validator in SCORE_LIFTING_VALIDATORS:
        return 1.0
    return min(1.0, r.score + (CONTEXT_BOOST if r.context else 0.0))


def select(entities: tuple[str, ...] | None, threshold: float) -> tuple[Recogniser, ...]:
    """Recognisers worth running for an entity subset and a threshold."""
    return tuple(
        r for r in REGISTRY
        if (not entities or r.entity in entities) and best_possible_score(r) >= threshold
    )
