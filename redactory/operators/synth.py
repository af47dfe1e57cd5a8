"""Synthetic stand-ins: seeded, repeatable, equal input gives equal output."""

from __future__ import annotations

from ..functions.expr import cases, in_list, let, quoted, record, transform

# --- fixed values: stand-in vocabulary -------------------------------------
GIVEN = ["Ada", "Ben", "Cleo", "Dan", "Eva", "Finn", "Gina", "Hugo", "Iris", "Jon", "Kira", "Leo"]
FAMILY = ["Archer", "Brook", "Castle", "Dale", "Ember", "Field", "Grove", "Harbor", "Ivers",
          "Juniper", "Knoll", "Lake", "Marsh"]
FIRMS = ["Northwind Works", "Blue Harbor Ltd", "Cedar and Sons", "Delta Textiles", "Evergreen Labs",
         "Falcon Supply", "Granite Partners"]
TOWNS = ["Ashford", "Birchwood", "Clearwater", "Dunmore", "Eastvale", "Foxborough", "Glenhaven",
         "Hillcrest", "Inverness", "Kingsport", "Lakeside"]
WORDS = ["Amber", "Bramble", "Cobalt", "Drift", "Echo", "Fable", "Grain", "Haven", "Ivory"]


def _pick(values: list[str], n: str) -> str:
    return f"element_at(array({', '.join(quoted(v) for v in values)}), cast({n} % {len(values)} + 1 as int))"


def _digits(n: str, width: int) -> str:
    return f"lpad(cast({n} % {10 ** width} as string), {width}, '0')"


def fake_value(entity: str, covered: str, seed: str) -> str:
    """A stand-in chosen by a hash of seed, entity type and covered text."""
    digest = f"sha2(concat_ws('|', {quoted(seed)}, {entity}, {covered}), 256)"
    part = lambda h, at: f"cast(conv(substring({h}, {at}, 8), 16, 10) as bigint)"

    def body(n: str) -> str:
        a, b, c = f"{n}.a", f"{n}.b", f"{n}.c"
        return cases(
            (in_list(entity, ["PERSON", "NRP"]), f"concat_ws(' ', {_pick(GIVEN, a)}, {_pick(FAMILY, b)})"),
            (in_list(entity, ["ORGANIZATION", "ORG"]), _pick(FIRMS, a)),
            (in_list(entity, ["LOCATION", "GPE", "LOC"]), _pick(TOWNS, a)),
            (f"{entity} = 'EMAIL_ADDRESS'",
             f"concat(lower({_pick(GIVEN, a)}), '.', lower({_pick(FAMILY, b)}), {_digits(c, 4)}, '@example.org')"),
            (f"{entity} = 'PHONE_NUMBER'", f"concat('555-01', {_digits(a, 2)}, '-', {_digits(b, 4)})"),
            (f"{entity} = 'DATE_TIME'",
             f"cast(date_add(date'1970-01-01', cast({a} % 20000 as int)) as string)"),
            (f"{entity} = 'IP_ADDRESS'",
             f"concat('198.51.', cast({a} % 256 as string), '.', cast({b} % 256 as string))"),
            (f"{entity} = 'URL'",
             f"concat('https://', lower({_pick(WORDS, a)}), {_digits(b, 4)}, '.example.org/')"),
            (f"{entity} = 'US_SSN'", f"concat_ws('-', {_digits(a, 3)}, {_digits(b, 2)}, {_digits(c, 4)})"),
            (in_list(entity, ["CREDIT_CARD", "US_BANK_NUMBER"]), f"concat({_digits(a, 8)}, {_digits(b, 8)})"),
            (in_list(entity, ["US_DRIVER_LICENSE", "US_PASSPORT", "US_ITIN", "MEDICAL_LICENSE"]),
             f"concat(char(65 + {a} % 26), char(65 + {b} % 26), {_digits(c, 8)})"),
            other=_pick(WORDS, a))

    return let(digest, lambda h: let(record(a=part(h, 1), b=part(h, 9), c=part(h, 17)), body))


def synthesize_placeholders(text: str, row_key: str, seed: str) -> str:
    """<NAME> placeholders in already rewritten text -> stand-ins.

    The original values are gone, so the choice depends on the row key and the
    position of the placeholder.  Gives struct<text, backend>.
    """
    marks = f"regexp_extract_all({text}, '<([A-Z_]+)>', 1)"

    def fill(m: str) -> str:
        def piece(gap: str, i: str) -> str:
            place = f"concat_ws(':', cast({row_key} as string), cast({i} as string))"
            return f"IF({i} < size({m}), concat({gap}, {fake_value(f'get({m}, {i})', place, seed)}), {gap})"

        gaps = f"split({text}, '<[A-Z_]+>', -1)"
        return f"array_join({transform(gaps, piece, 'g', 'i')}, '')"

    return let(marks, lambda m: record(
        text=f"IF(size({m}) > 0, {fill(m)}, coalesce({text}, ''))",
        backend=f"IF(size({m}) > 0, 'seeded', 'none')"))
