"""Text expressions as SQL text: offsets, word edges, normalisation, escaping."""

from __future__ import annotations

from .expr import blocked_fold, empty, fold, let, quoted, raw, record, transform

WORD = r"[\p{L}\p{N}]+"
HIT_DDL = "struct<start:int,`end`:int,text:string>"
HITS_DDL = f"array<{HIT_DDL}>"

# Up to this many matches are found again by their text; more are placed by one
# more pass of the pattern.
FEW = 16


def offsets(text: str, hits: str, pattern: str) -> str:
    """Matches with 0-based start and exclusive end, in code points.

    The gaps between matches come from splitting on the same pattern, so the
    offsets are running sums of gap and match lengths.
    """

    def body(pairs: str) -> str:
        def step(pos: str, pair: str) -> tuple[str, str]:
            start = f"{pos} + length({pair}.gap)"
            end = f"{start} + length({pair}.hit)"
            return end, "array(" + record(start=start, end=end, text=f"{pair}.hit") + ")"

        return blocked_fold(pairs, "0", step, HIT_DDL)

    gaps = f"split({text}, {raw(pattern)}, -1)"
    pairs = let(gaps, lambda g: (
        f"zip_with(slice({g}, 1, size({hits})), {hits}, (g, h) -> named_struct('gap', g, 'hit', h))"))
    return let(pairs, body)


def refound(text: str, hits: str) -> str:
    """The same offsets for a few matches of a pattern without look-around.

    Matches come in order, and the next place where a match's text occurs is the
    match itself: an earlier occurrence would have been matched instead.
    """

    def step(acc: str, hit: str) -> str:
        def place(start: str) -> str:
            row = record(start=start, end=f"{start} + length({hit})", text=hit)
            return record(pos=f"{start} + length({hit})", rows=f"concat({acc}.rows, array({row}))")

        return let(f"locate({hit}, {text}, {acc}.pos + 1) - 1", place)

    return fold(hits, record(pos="0", rows=empty(HITS_DDL)), step, lambda a: f"{a}.rows")


def located(text: str, pattern: str, guard: str | None = None, lookaround: bool = False) -> str:
    """Non-overlapping matches with offsets; offsets are worked out only for rows with a match."""
    matches = f"regexp_extract_all({text}, {raw(pattern)}, 0)"
    if guard:
        matches = f"IF({guard}, {matches}, {empty('array<string>')})"

    def place(h: str) -> str:
        by_split = offsets(text, h, pattern)
        by_text = by_split if lookaround else f"IF(size({h}) <= {FEW}, {refound(text, h)}, {by_split})"
        return f"IF(size({h}) > 0, {by_text}, {empty(HITS_DDL)})"

    return let(matches, place)


# Where a word begins or ends.
BORDER = rf"(?<={WORD[:-1]})(?=[^{WORD[1:-2]}])|(?<=[^{WORD[1:-2]}])(?={WORD[:-1]})"
SEGMENT_DDL = "struct<_base:int,_pieces:array<string>>"


def segments(text: str, size: int, ahead: int) -> str:
    """A text as words and the gaps between them in turn, ``size`` at a time with ``ahead`` more, and the code points
    before each such part."""
    def parts(pieces: str) -> str:
        return transform(f"sequence(0, (size({pieces}) - 1) div {size})", lambda k: record(
            length=f"length(array_join(slice({pieces}, {k} * {size} + 1, {size}), ''))",
            pieces=f"slice({pieces}, {k} * {size} + 1, {size + ahead})"))

    def step(pos: str, part: str) -> tuple[str, str]:
        return f"{pos} + {part}.length", "array(" + record(_base=pos, _pieces=f"{part}.pieces") + ")"

    return let(f"split({text}, {raw(BORDER)}, -1)", lambda p: let(parts(p), lambda c: blocked_fold(c, "0", step, SEGMENT_DDL)))


CHUNK = 1024


def chunks(text: str) -> str:
    """A long text cut every ``CHUNK`` code points, in one pass; a short one as it is."""
    return f"IF(length({text}) <= {CHUNK}, array({text}), regexp_extract_all({text}, {raw(f'(?s).{{1,{CHUNK}}}')}, 0))"


def part(text: str, cut: str, start: str, n: str) -> str:
    """``n`` code points from a 0-based place, read from the chunks around it: a substring of the text itself would
    count code points from the text's beginning each time."""
    near = f"array_join(slice({cut}, ({start}) div {CHUNK} + 1, ({n}) div {CHUNK} + 2), '')"
    return (f"IF(size({cut}) < 2, substring({text}, ({start}) + 1, {n}), "
            f"substring({near}, ({start}) % {CHUNK} + 1, {n}))")


def edges_clear(text: str, cut: str, hit: str) -> str:
    """No letter, digit or underscore touches the outer edge of an alphanumeric match."""
    left, right = part(text, cut, f"{hit}.start - 1", "2"), part(text, cut, f"{hit}.`end` - 1", "2")
    return (f"NOT ({hit}.start > 0 AND rlike({left}, '^[A-Za-z0-9_][A-Za-z0-9]')) "
            f"AND NOT rlike({right}, '^[A-Za-z0-9][A-Za-z0-9_]')")


def word_nearby(text: str, cut: str, start: str, words, n_words: int, n_chars: int) -> str:
    """One of the words is among the last few before a position."""
    inside, outside = WORD[:-1], "[^" + WORD[1:-2] + "]"
    pattern = (f"(?:^|{outside})(?:{'|'.join(words)})"
               f"(?:{outside}+{inside}+){{0,{n_words - 1}}}{outside}*$")
    window = part(text, cut, f"greatest(0, {start} - {n_chars})", f"least({start}, {n_chars})")
    return f"rlike(lower({window}), {raw(pattern)})"


def count_words(text: str) -> str:
    """White-space separated words; blank text has none."""
    return f"regexp_count({text}, {raw('[^ ' + WHITE + ']+')})"


WHITE = r"\t\r\n\f"


def place_token(text: str) -> str:
    """Lower case, everything but a-z and 0-9 folded to single spaces."""
    return f"trim(regexp_replace(lower(coalesce({text}, '')), '[^a-z0-9]+', ' '))"


def escape_markup(text: str) -> str:
    """The five characters that matter in HTML, ampersand first."""
    for plain, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = f"replace({text}, {quoted(plain)}, {quoted(safe)})"
    return text


def entity_label(entity_type: str) -> str:
    """EMAIL_ADDRESS -> Email Address."""
    return f"initcap(replace({entity_type}, '_', ' '))"


PLACEHOLDER = "<([A-Z_]+)>"


def placeholders(text: str) -> str:
    """Entity names of the <NAME> placeholders in rewritten text."""
    return f"regexp_extract_all({text}, '{PLACEHOLDER}', 1)"


def tag_placeholders(text: str) -> str:
    """<NAME> -> `NAME`."""
    return f"regexp_replace({text}, '{PLACEHOLDER}', '`$1`')"
