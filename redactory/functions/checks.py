"""Validators for matched text, as SQL text."""

from __future__ import annotations

from .expr import cases, fold, let


def digits_of(text: str) -> str:
    return f"regexp_replace({text}, '[^0-9]', '')"


def luhn(text: str) -> str:
    """Mod-10 check over 13 to 19 digits; separators are ignored."""
    return let(digits_of(text), lambda d: f"(length({d}) BETWEEN 13 AND 19 AND luhn_check({d}))")


def iban(text: str) -> str:
    """Mod-97 check; letters count as 10 to 35."""

    def body(t: str) -> str:
        def add(acc: str, i: str) -> str:
            return let(f"ascii(substring({t}, {i}, 1))", lambda c: cases(
                (f"{c} < 58", f"({acc} * 10 + {c} - 48) % 97"), other=f"({acc} * 100 + {c} - 55) % 97"))

        return fold(f"sequence(1, length({t}))", "0", add) + " = 1"

    return let(f"concat(substring({text}, 5), substring({text}, 1, 4))", body)


def octets(text: str) -> str:
    """Every dotted part is at most 255."""
    return f"forall(split({text}, '[.]'), p -> cast(p as int) <= 255)"


def ssn(text: str) -> str:
    """No group is all zeros."""
    return let(digits_of(text), lambda d: (
        f"(substring({d}, 1, 3) <> '000' AND substring({d}, 4, 2) <> '00' "
        f"AND substring({d}, 6, 4) <> '0000')"))


def dea(text: str) -> str:
    """Check digit of a two-letter, seven-digit registration number."""
    digit = lambda i: f"cast(substring({text}, {i}, 1) as int)"
    odd = " + ".join(digit(i) for i in (3, 5, 7))
    even = " + ".join(digit(i) for i in (4, 6, 8))
    return f"({odd} + ({even}) * 2) % 10 = {digit(9)}"


def date(text: str) -> str:
    """ISO dates must exist in the calendar; slash dates pass."""
    return f"(contains({text}, '/') OR try_cast({text} as date) IS NOT NULL)"


VALIDATORS = {"luhn": luhn, "iban": iban, "octets": octets, "ssn": ssn, "dea": dea, "date": date}
