"""Column functions that find labelled values in report text.

Text is matched as Unicode, without case unless said otherwise; a dot stops at a line end only.
The label grammar is data: each field names its labels, the value after them and what ends it.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

IGNORE_CASE, CASE = "(?idU)", "(?dU)"
SEPARATOR = r"[:\s]+"
#: What ``\s`` matches as Unicode.
WHITE_SPACE = "\t\n\v\f\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"

# ---- fixed values: bureaus, labels, value shapes and the status map, in their fixed order ----
BUREAUS = (("equifax", "equifax"), ("experian", "experian"), ("transunion", r"trans\s*union"))
SCORE_PATTERNS = (
    r"(?:credit\s+score|fico\s+score|vantage\s+score)[:\s]+(\d{3})",
    r"(\d{3})\s+(?:credit\s+score|fico)",
    r"score[:\s]+(\d{3})\b",
    r"\b([3-8]\d{2})\b.*(?:score|rating)",
)
DAY_DATE = r"\d{1,2}[/-]\d{1,2}[/-]\d{2,4}"
WORD_DATE = r"\w+\s+\d{1,2},?\s+\d{4}"
MONTH_DATE = r"\w+\s+\d{4}|\d{1,2}[/-]\d{4}"
AMOUNT = r"[\d,]+(?:\.\d{2})?"
ACCOUNT_HEADERS = ("Account #", "Account Number", "Creditor", "Credit Card", "Mortgage", "Auto Loan", "Student Loan", "Collection")
DATE_LABELS = {
    "date_opened": ("date opened", "opened"),
    "date_closed": ("date closed", "closed"),
    "date_of_first_delinquency": ("date of first delinquency", "first delinquency", "dofd"),
    "date_last_reported": ("date last reported", "date reported", "last reported"),
}
STATUS_MAP = (
    ("charge off", "charged_off"), ("charged off", "charged_off"), ("collection", "collection"), ("in collections", "collection"),
    ("closed", "closed"), ("open", "open"), ("current", "current"), ("pays as agreed", "current"), ("derogatory", "derogatory"),
    ("late", "late"), ("30", "30d_late"), ("60", "60d_late"), ("90", "90d_late"), ("120", "120d_late"),
)
INQUIRY_HEADINGS = ("hard inquiries", "credit inquiries", "inquiries in the last")
BUREAU_LINE_SCORE = r"[^\n]*?([3-8]\d{2})"
PERSON_NAME = r"[A-Z][a-z]+(?:\s+[A-Z][a-z]+)+"
MASKED_NUMBER, MASKED_DASHED_NUMBER = r"[Xx*]+\d{4}", r"[Xx*-]+\d{4}"
ACCOUNT_NUMBER = r"(?:account\s*(?:#|number|num)|acct)[:\s#]+([X*\d-]{4,20})"
INQUIRY_ENDS = ("accounts", r"public\s+records")
INQUIRY_NAME = r"^(.+?)(?:\n|date|\d{1,2}[/-])"
BLANK_LINES = r"\n{2,}"
SOFT_INQUIRY = (r"soft\s+inquiry", "promotional", "pre-screen", r"account\s+review")
SCORE_RANGE = (300, 850)
MIN_BLOCK, MIN_INQUIRY = 50, 20
# ---- end of fixed values ----
#: Where matches of SCORE_PATTERNS and ACCOUNT_NUMBER may be in a folded text, in which any digit beyond ASCII is OTHER.
SCORE_STARTS = ((r"credit\s+score[:\s]", r"fico\s+score[:\s]", r"vantage\s+score[:\s]"), r"[0-9\x01]\s+(?:credit\s+score|fico)", (r"score[:\s]",), r"[3-8][0-9\x01]{2}.*(?:score|rating)")
NUMBER_STARTS = (r"account\s*(?:#|num)", r"acct[:\s#]")
#: Letters beyond ASCII that are ASCII ones where case does not matter.
FOLDED = {"\u0130": "i", "\u0131": "i", "\u017f": "s", "\u212a": "k"}
FEW_BLOCKS = 50
WIDE_SPACE = "".join(c for c in WHITE_SPACE if c > "\x7f")
#: Stands in a folded text for what is neither ASCII nor white space.
OTHER = "\x01"
#: Beyond all places of a text.
NOWHERE = 2**31 - 1
#: Characters after a label in which nearly all values end.
NEAR = 400


def spaced(label: str) -> str:
    """The label with any white space where it has a space."""
    return r"\s+".join(label.split(" "))


def any_of(labels: tuple[str, ...]) -> str:
    """One of the labels; most places fail at the first letter, before any label is tried."""
    letters = "".join(sorted({label[0] for label in labels}))
    return f"(?=[{letters}])(?:" + "|".join(map(spaced, labels)) + ")"


def named(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often it is used.

    The value is where a fold of no items begins. An array of it would do, but reading its item back
    works out the type of all that is within for each row.
    """
    return F.aggregate(F.array().cast("array<int>"), value, lambda x, _: x, use)


def folded(text: Column) -> Column:
    """The text in lower-case ASCII, character for character.

    Where a pattern of lower-case ASCII letters, white space and signs matches in it, it matches in
    the text regardless of case, and several times as fast if it begins with four letters: Java looks
    for those alone by skipping. White space beyond ASCII is a blank in it, letters that case makes
    ASCII ones are these, and all else is OTHER.
    """
    ascii_only = lambda c: F.octet_length(c) == F.char_length(c)

    def rest(c: Column) -> Column:
        for letter, plain in FOLDED.items():
            c = F.replace(c, F.lit(letter), F.lit(plain))
        return F.regexp_replace(F.regexp_replace(c, f"(?=[^\\x00-\\x7f])[{WIDE_SPACE}]", " "), "[^\\x00-\\x7f]", OTHER)

    # in most texts letters of Latin 1 are all there is beyond ASCII, and one range is tried in a fraction of the time that a list takes
    latin = F.regexp_replace(text, "[\xa1-\xff]", OTHER)
    return F.lower(F.when(ascii_only(text), text).otherwise(named(latin, lambda c: F.when(ascii_only(c), c).otherwise(rest(c)))))


def with_low(text: Column, low: Column | None, use: Callable[[Column], Column]) -> Column:
    """``use`` of the folded text, which is made here if it is not given."""
    return named(folded(text), use) if low is None else use(low)


def place(low: Column, patterns: tuple[str, ...] | list[str]) -> Column:
    """Where in a folded text the first match of any of the patterns begins, from 1; NOWHERE where there is none."""
    at = [F.pmod(F.regexp_instr(low, F.lit(p)) - 1, F.lit(NOWHERE)) for p in patterns]
    return (F.least(*at) if len(at) > 1 else at[0]) + 1


def first(text: Column, pattern: str, flags: str = IGNORE_CASE) -> Column:
    """The group of the pattern's first match, null where there is none.

    The match is made to run to the text's end, so there is one at most, and the pattern is run once.
    """
    return F.get(F.regexp_extract_all(text, F.lit(f"{flags}(?:{pattern})(?s:.*)"), F.lit(1)), F.lit(0))


def near(text: Column, pattern: str, flags: str = IGNORE_CASE, at: str = r"\A") -> Column:
    """``first`` of a text of which NEAR characters are at hand, if the match begins ``at`` its beginning and is decided in these.

    It is if white space, another character and eight more follow it: no value goes on beyond those.
    """
    return F.get(F.regexp_extract_all(text, F.lit(rf"{flags}{at}(?>{pattern})(?=(?Us)\s*+\S.{{8}})"), F.lit(1)), F.lit(0))


def first_after(text: Column, low: Column, starts: tuple[str, ...] | list[str], pattern: str, flags: str = IGNORE_CASE) -> Column:
    """``first`` of a pattern each match of which begins where one of the patterns ``starts`` of the folded text does.

    It is looked for at the first such place, and from there on only if there are others.
    """

    def found(at: Column) -> Column:
        here = named(F.regexp_extract(F.substr(text, at), rf"{flags}\A(?:{pattern})", 1), lambda x: F.when(x != "", x))
        onward = F.when(place(F.substr(low, at + 1), starts) < NOWHERE, first(F.substr(text, at), pattern, flags)).otherwise(here)
        return F.coalesce(near(F.substr(text, at, F.lit(NEAR)), pattern, flags), onward)

    return named(place(low, starts), lambda at: F.when(at < NOWHERE, found(at)))


def stripped(text: Column) -> Column:
    """Without Unicode white space at both ends; the text is named once, as Spark reads what a lambda function names twice twice."""
    return F.btrim(text, F.lit(WHITE_SPACE))


def starts(labels: tuple[str, ...]) -> list[str]:
    """The labels as ``place`` takes them; what follows "date closed" follows "closed", so one that ends with another is left out."""
    return [spaced(x) + r"[:\s]" for x in labels if not any(x.endswith(" " + y) for y in labels)]


def after_label(text: Column, labels: tuple[str, ...], value: str, flags: str = IGNORE_CASE, separator: str = SEPARATOR, low: Column | None = None) -> Column:
    return with_low(text, low, lambda low: first_after(text, low, starts(labels), any_of(labels) + separator + f"({value})", flags))


def up_to(text: Column, labels: tuple[str, ...], ends: tuple[str, ...], low: Column | None = None) -> Column:
    """The stripped text between a label and the first of a line end and ``ends``; null if neither comes."""
    value = ".+?)(?:" + "|".join(("\\n", *ends))
    return stripped(after_label(text, labels, value, low=low))


def bureau(text: Column, low: Column | None = None) -> Column:
    """Which bureau a text names: one, ``tri_merge`` for several, ``unknown`` for none."""

    def of(found: Column) -> Column:
        return F.when(F.size(found) >= 2, "tri_merge").when(F.size(found) == 1, F.get(found, F.lit(0))).otherwise("unknown")

    return with_low(text, low, lambda low: named(F.array_compact(F.array(*(F.when(low.rlike(p), F.lit(name)) for name, p in BUREAUS))), of))


def chosen_bureau(asked: Column, text: Column, low: Column | None = None) -> Column:
    """The bureau asked for, unless that is ``auto_detect``."""
    return F.when(asked == "auto_detect", bureau(text, low)).otherwise(asked)


def _in_range(number: Column) -> Column:
    """The number if it is a score; filtering an array of it names it, so that it is extracted once."""
    return F.get(F.filter(F.array(number.try_cast("int")), lambda x: x.between(*SCORE_RANGE)), F.lit(0))


def credit_score(text: Column, low: Column | None = None) -> Column:
    """The first pattern whose first match is in range gives the score; null if none is.

    Patterns that begin with a number are tried where the folded text has what they need at all.
    """
    said, before, plain, line = SCORE_PATTERNS

    def of(low: Column) -> Column:
        return F.coalesce(
            _in_range(first_after(text, low, SCORE_STARTS[0], said)), _in_range(F.when(low.rlike(SCORE_STARTS[1]), first(text, before))),
            _in_range(first_after(text, low, SCORE_STARTS[2], plain)), _in_range(F.when(low.rlike(SCORE_STARTS[3]), first(text, line))),
        )

    return with_low(text, low, of)


def score_by_bureau(text: Column) -> Column:
    """A map from bureau (lower case, spaces removed) to its last in-range score on a line that names it."""
    names = "(" + "|".join(p for _, p in BUREAUS) + ")"
    pattern = F.lit(IGNORE_CASE + names + BUREAU_LINE_SCORE)
    found = F.arrays_zip(F.regexp_extract_all(text, pattern, F.lit(1)).alias("name"), F.regexp_extract_all(text, pattern, F.lit(2)).alias("score"))
    pairs = F.transform(found, lambda x: F.struct(F.replace(F.lower(x["name"]), F.lit(" ")).alias("k"), _in_range(x["score"]).alias("v")))
    kept = F.filter(pairs, lambda p: p["v"].isNotNull())
    last = F.filter(kept, lambda p, i: ~F.exists(F.slice(kept, i + 2, F.size(kept)), lambda q: q["k"] == p["k"]))
    return F.map_from_entries(last)


def personal_info(text: Column, ssn_mode: str = "strict", low: Column | None = None) -> Column:
    """A struct of name, ssn_last_four, date_of_birth and address.

    Name and number labels are lower case, as fixed; ``ssn_mode='tolerant'`` also takes labels of
    any case and dashes between masked groups.
    """

    def of(low: Column) -> Column:
        ssn = {
            "strict": after_label(text, ("ssn", "social"), MASKED_NUMBER, CASE, low=low),
            "tolerant": after_label(text, ("ssn", "social"), MASKED_DASHED_NUMBER, low=low),
        }[ssn_mode]
        return F.struct(
            after_label(text, ("name", "consumer"), PERSON_NAME, CASE, low=low).alias("name"),
            F.right(ssn, F.lit(4)).alias("ssn_last_four"),
            after_label(text, ("date of birth", "dob", "born"), DAY_DATE, low=low).alias("date_of_birth"),
            up_to(text, ("address", "current address"), ("city", "state"), low).alias("address"),
        )

    return with_low(text, low, of)


def report_date(text: Column, low: Column | None = None) -> Column:
    def of(low: Column) -> Column:
        return F.coalesce(
            after_label(text, ("report date", "date of report", "generated", "as of"), WORD_DATE, low=low),
            after_label(text, ("report date", "date of report"), DAY_DATE, low=low),
        )

    return with_low(text, low, of)


def amount_text(block: Column, labels: tuple[str, ...], low: Column | None = None) -> Column:
    return after_label(block, labels, AMOUNT, separator=SEPARATOR + r"\$?", low=low)


def number_of(amount: Column) -> Column:
    """An amount's text as a number; null for what is none (a lone comma)."""
    return named(F.replace(amount, F.lit(",")), lambda x: F.when(x != "", x.try_cast("double")))  # what fails to be cast is slow


def amount(block: Column, labels: tuple[str, ...]) -> Column:
    return number_of(amount_text(block, labels))


def amount_invalid(block: Column, labels: tuple[str, ...]) -> Column:
    """An amount was found that is no number."""
    return amount_text(block, labels).isNotNull() & amount(block, labels).isNull()


def status_text(block: Column, low: Column | None = None) -> Column:
    return F.lower(up_to(block, ("account status", "status", "payment status"), ("date", "balance"), low))


def status_of(said: Column) -> Column:
    """The first status word, in the map's order, that the status text holds; null if none."""
    out = F
    for word, value in STATUS_MAP:
        out = out.when(F.contains(said, F.lit(word)), value)
    return out


def account_status(block: Column) -> Column:
    return status_of(status_text(block))


def creditor_name(block: Column, low: Column | None = None) -> Column:
    return up_to(block, ("creditor", "company", "lender", "collection agency"), ("account",), low)


def account_number(block: Column, low: Column | None = None) -> Column:
    return stripped(with_low(block, low, lambda low: first_after(block, low, NUMBER_STARTS, ACCOUNT_NUMBER)))


def account_fields(block: Column, low: Column) -> dict[str, Column]:
    """Every field of an account block, by name, each extracted once: amounts are texts yet, and status_text is what the status is read from."""
    return {
        "creditor_name": creditor_name(block, low),
        "account_number": account_number(block, low),
        "balance": amount_text(block, ("balance", "amount owed"), low),
        "credit_limit": amount_text(block, ("credit limit", "high balance", "original amount"), low),
        "status_text": status_text(block, low),
        **{name: after_label(block, labels, MONTH_DATE, low=low) for name, labels in DATE_LABELS.items()},
        "account_type": up_to(block, ("account type", "type"), ("status", "balance"), low),
    }


def _long(low: Column, size: int) -> Column:
    """Whether a folded text has ``size`` characters or more without the white space at both ends; two are looked for that lie so far apart."""
    return low.rlike(rf"(?s)\A\s*+\S.{{{size - 2},}}?\S")


def account_blocks(text: Column, low: Column) -> Column:
    """The parts of a text, cut before each account header that a colon follows, that are no shorter than MIN_BLOCK: block and low."""

    def parts(of: Column, flags: str, more: str) -> Column:
        # up to the next letter that a header has first, in one step; tried as a header only there
        header, letters = f"(?:{'|'.join(map(spaced, ACCOUNT_HEADERS))})\\s*:".lower(), "".join(sorted({h[0].lower() for h in ACCOUNT_HEADERS}))
        s = f"(?-i:[{letters}{more}])"
        other = f"(?>(?-i:[^{letters}{more}])*)"
        no_second = f"(?![{''.join(sorted({h[1] for h in ACCOUNT_HEADERS}))}])"
        return F.regexp_extract_all(of, F.lit(f"{flags}(?:{header})?+{other}(?:(?:{s}{no_second}|(?!{header}){s}){other})*+"), F.lit(0))

    upper = "".join(sorted({h[0] for h in ACCOUNT_HEADERS})) + "".join(c for c, plain in FOLDED.items() if plain.upper() in {h[0] for h in ACCOUNT_HEADERS})

    def both(lows: Column) -> Column:
        # of few parts, those of the text are at the same places; of many, adding up sizes would take longer than to cut it too
        size = named(F.transform(lows, F.char_length), lambda sizes: F.transform(lows, lambda x, i: F.struct(F.substr(text, F.aggregate(F.slice(sizes, 1, i), F.lit(1), lambda a, b: a + b), F.get(sizes, i)).alias("block"), x.alias("low"))))
        return F.when(F.size(lows) <= FEW_BLOCKS, size).otherwise(F.arrays_zip(parts(text, IGNORE_CASE, upper).alias("block"), lows.alias("low")))

    return F.filter(named(parts(low, "", ""), both), lambda b: _long(b["low"], MIN_BLOCK))


def inquiry_blocks(text: Column, low: Column) -> Column:
    """The parts, at blank lines, of the first inquiry section that are no shorter than MIN_INQUIRY, with their numbers: n, block and low."""
    heading = [spaced(h) for h in INQUIRY_HEADINGS]

    def section(at: Column) -> Column:
        size = F.char_length(F.regexp_extract(F.substr(low, at), rf"\A(?:{'|'.join(heading)})", 0))
        lows = lambda start, end: F.struct(*(cut(c, start, end).alias(name) for c, name in ((text, "block"), (low, "low"))))
        return named(at + size, lambda start: named(place(F.substr(low, start + 1), INQUIRY_ENDS), lambda end: lows(start, end)))

    def cut(c: Column, start: Column, end: Column) -> Column:
        # one character at least comes before the section's end
        return F.split(F.substr(c, start, end), BLANK_LINES)

    found = named(place(low, [h + "(?s:.)" for h in heading]), lambda at: F.when(at < NOWHERE, section(at)))
    parts = named(found, lambda x: F.transform(x["block"], lambda b, i: F.struct(i.alias("n"), b.alias("block"), F.get(x["low"], i).alias("low"))))
    return F.filter(parts, lambda b: _long(b["low"], MIN_INQUIRY))


def inquiry_fields(block: Column, low: Column) -> dict[str, Column]:
    def nearby(pattern: str, flags: str = IGNORE_CASE) -> Column:
        found = F.coalesce(near(F.left(block, F.lit(NEAR)), pattern, flags, ""), first(block, pattern, flags))
        # of ASCII, which the folded text tells, the slow Unicode classes mean the same
        return F.when(F.octet_length(block) == F.octet_length(low), first(block, pattern, flags.replace("U", ""))).otherwise(found)

    return {
        "creditor_name": stripped(nearby(INQUIRY_NAME)),
        "inquiry_date": nearby(f"({DAY_DATE}|{WORD_DATE})", CASE),
        "inquiry_type": F.when(reduce(or_, (low.rlike(p) for p in SOFT_INQUIRY)), "soft").otherwise("hard"),
    }
