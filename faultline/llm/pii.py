"""Personal data by anchor expansion.

One Aho-Corasick pass over a text finds anchors: at-signs, digits that touch
(directly, over a point, a space or a dash), a plus before a digit, URL schemes and
identifier cues. A parser for each kind grows an anchor to the left and right by
fixed character rules and validates what it gets, so characters far from an
anchor are read by the automaton alone. An anchor inside the last match of its
kind is passed over: matches of a kind are the leftmost ones and never overlap,
and one that fails its validation is dropped with its characters.

Kinds: email, ip (parts at most 255), card (12 to 19 digits, Luhn), phone (9 to 15
digits), url (a scheme or ``www.`` and what follows, without closing
punctuation), account (the value after a cue). Anchors are found in any case.

A cue of an account has its own parser. An IBAN, in one go or in groups, is ended by
the length of its country and must have the remainder 1 modulo 97; a mark (``:``,
``=`` or ``#``) before it is optional, as it is for a social security number. Account
and passport numbers may be in groups; behind a blank alone the cue must be a whole
word, and a passport number needs four digits, an account number six in one go. A
secret needs a mark: it is what is in the quotes, or the next six characters or more
without a blank. Behind any cue with a mark a value of six characters in one go with a
digit is taken, whatever its check digits are.

Defined results: a null text has no spans; offsets count code points, the end is
exclusive; spans are ordered by start, then by kind in the order above; kinds may
overlap each other. Rows do not depend on each other. Other columns pass through,
except one with the name of the result.
"""

import re
from collections.abc import Iterator
from itertools import product

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.llm.arrow import by_pieces
from faultline.llm.common import text_of

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "url", "account")
SCHEMES = ("http://", "https://", "ftp://", "www.")
CUES = (
    "account", "acct", "iban", "passport", "ssn", "konto", "compte", "cuenta",
    "token", "secret", "password", "passwd", "api_key", "apikey", "api key", "api-key",
)
LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
QUAD = re.compile(r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
LINK = re.compile(r"[^\s<>\"]+")
CLOSING = ".,;:!?)]}'"
NUMBER = r"(?:[\x20\t]*(?:number|no\.?|nr\.?|num\.?))?"
MARK = re.compile(NUMBER + r"[\"']?[\x20\t]*[:=#]+[\x20\t]*[\"']?", re.I)
BLANK = re.compile(r"(?P<number>[\x20\t]+(?:number|no\.?|nr\.?|num\.?))?(?:[\x20\t]+is)?[\x20\t]+[\"']?", re.I)
VALUE = re.compile(r"[A-Za-z0-9_-]{6,}")
IBAN = re.compile(r"[A-Za-z]{2}[0-9]{2}(?:[\x20-]?[A-Za-z0-9]){11,30}")
GROUPED = re.compile(r"[0-9]+(?:[\x20./-]?[0-9]+)*(?![A-Za-z0-9])")
PASSPORT = re.compile(r"(?=[A-Za-z0-9]*[0-9])[A-Za-z0-9]{6,12}(?![A-Za-z0-9])|[A-Za-z]{0,3}(?:[\x20-]?[0-9]+)+(?![A-Za-z0-9])")
SOCIAL = re.compile(r"(?!000)[0-9]{3}[\x20-]?(?!00)[0-9]{2}[\x20-]?(?!0000)[0-9]{4}(?![0-9])")
SECRET = re.compile(r"[^\s\"'<>]+")
# characters of an IBAN by country
LENGTHS = {
    country: int(length)
    for length, countries in (
        line.split(":")
        for line in (
            "15:NO", "16:BE", "18:DK FI FK FO GL NL SD", "19:MK SI", "20:AT BA EE KZ LT LU MN XK", "21:CH HR LI LV",
            "22:BG BH CR DE GB GE IE ME RS VA", "23:AE GI IL IQ OM SO TL", "24:AD CZ ES MD PK RO SA SE SK TN VG",
            "25:LY PT ST", "26:IS TR", "27:BI DJ FR GR IT MC MR SM", "28:AL AZ BY CY DO GT HU LB NI PL SV",
            "29:BR EG PS QA UA", "30:JO KW MU YE", "31:MT SC", "32:LC", "33:RU",
        )
    )
    for country in countries.split()
}
DIGITS = "0123456789"


def luhn(digits: str) -> bool:
    total = 0
    for place, digit in enumerate(reversed(digits)):
        value = int(digit) * (1 + place % 2)
        total += value - 9 * (value > 9)
    return total % 10 == 0


def only_digits(text: str) -> str:
    return "".join(c for c in text if c in DIGITS)


def expand_email(text: str, at: int, done: int):
    start = at
    while start > done and text[start - 1] in LOCAL:
        start -= 1
    domain = DOMAIN.match(text, at + 1) if start < at else None
    return (start, domain.end(), True) if domain else None


def expand_ip(text: str, dot: int, done: int):
    start = dot
    while start > done and text[start - 1] in DIGITS:
        start -= 1
    quad = QUAD.match(text, start) if start < dot else None
    if not quad:
        return None
    parts = [p.lstrip("0") or "0" for p in quad[0].split(".")]
    return start, quad.end(), all(len(p) <= 3 and int(p) <= 255 for p in parts)


def expand_card(text: str, first: int, done: int):
    found = CARD.match(text, first)
    digits = only_digits(found[0])
    return first, found.end(), 12 <= len(digits) <= 19 and luhn(digits)


def expand_phone(text: str, plus: int, done: int):
    found = PHONE.match(text, plus)
    return found and (plus, found.end(), 9 <= len(only_digits(found[0])) <= 15)


def expand_url(text: str, first: int, done: int):
    found = LINK.match(text, first)
    end = found.end()
    while end > first and text[end - 1] in CLOSING:
        end -= 1
    rest = re.sub(r"^(?:www\.)", "", text[first:end].split("://")[-1], flags=re.I)
    return first, max(end, first + 1), bool(rest)


def whole_word(text: str, first: int) -> bool:
    return first == 0 or not text[first - 1].isalnum()


def iban_end(text: str, at: int) -> int | None:
    """Where the IBAN that starts here ends, by its country's length and its check digits."""
    found = IBAN.match(text, at)
    if not found:
        return None
    ends = [k + 1 for k in range(at, found.end()) if text[k] not in " -"]
    wanted = LENGTHS.get(text[at : at + 2].upper())
    for size in [wanted] if wanted else range(len(ends), 14, -1):
        if size > len(ends) or text[ends[size - 1] : ends[size - 1] + 1].isalnum():
            continue
        plain = "".join(text[k - 1] for k in ends[:size]).upper()
        if int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1:
            return ends[size - 1]
    return None


def marked_value(text: str, at: int):
    """Six characters or more in one go, with a digit."""
    found = VALUE.match(text, at)
    return (at, found.end(), True) if found and any(c in DIGITS for c in found[0]) else None


def expand_iban(text: str, after: int, done: int, cue: str):
    mark = MARK.match(text, after)
    blank = mark or (whole_word(text, after - len(cue)) and BLANK.match(text, after))
    end = blank and iban_end(text, blank.end())
    return (blank.end(), end, True) if end else mark and marked_value(text, mark.end())


def expand_account(text: str, after: int, done: int, cue: str):
    """An IBAN, a number in groups, or after a mark any value with a digit."""
    found = expand_iban(text, after, done, cue)
    mark = MARK.match(text, after)
    blank = mark or (whole_word(text, after - len(cue)) and BLANK.match(text, after))
    grouped = blank and GROUPED.match(text, blank.end())
    if not grouped or len(only_digits(grouped[0])) < 6 or (found and found[1] >= grouped.end()):
        return found
    if mark or blank["number"] or re.match("[0-9]{6}", grouped[0]):
        return *grouped.span(), True
    return found


def expand_passport(text: str, after: int, done: int, cue: str):
    mark = MARK.match(text, after)
    blank = mark or (whole_word(text, after - len(cue)) and BLANK.match(text, after))
    found = blank and PASSPORT.match(text, blank.end())
    if found and 6 <= len(re.sub("[^A-Za-z0-9]", "", found[0])) <= 12 and (mark or len(only_digits(found[0])) >= 4):
        return *found.span(), True
    return mark and marked_value(text, mark.end())


def expand_social(text: str, after: int, done: int, cue: str):
    mark = MARK.match(text, after)
    blank = mark or (whole_word(text, after - len(cue)) and BLANK.match(text, after))
    found = blank and SOCIAL.match(text, blank.end())
    return (*found.span(), True) if found else mark and marked_value(text, mark.end())


def expand_secret(text: str, after: int, done: int, cue: str):
    mark = MARK.match(text, after)
    if not mark:
        return None
    start = mark.end()
    quote = mark[0][-1:]
    if quote and quote in "\"'":
        line = text.find("\n", start)
        end = text.find(quote, start, len(text) if line < 0 else line)
        if end - start >= 6:
            return start, end, True
    found = SECRET.match(text, start)
    end = found.end() if found else start
    while end > start and text[end - 1] in ".,;:)]}":
        end -= 1
    return (start, end, True) if end - start >= 6 else None


ACCOUNTS = {"iban": expand_iban, "passport": expand_passport, "ssn": expand_social} | dict.fromkeys(
    ("account", "acct", "konto", "compte", "cuenta"), expand_account
)
PARSERS = dict(zip(KINDS, (expand_email, expand_ip, expand_card, expand_phone, expand_url)))


def lowered(text: str) -> str:
    """The text in lower case, with every character in its place."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c if len(c.lower()) > 1 else c.lower() for c in text)


def anchors() -> ahocorasick.Automaton:
    """Each anchor, in lower case, carries its kinds, where from its last character the parser starts, and itself."""
    found: dict[str, list[tuple[str, int]]] = {"@": [("email", 0)]}
    for a, b in product(DIGITS, DIGITS):
        found[f"{a}.{b}"] = [("ip", -1)]
        for between in ("", " ", "-"):
            found[f"{a}{between}{b}"] = [("card", -1 - len(between))]
    for a in DIGITS:
        found[f"+{a}"] = [("phone", -1)]
    for scheme in SCHEMES:
        found[scheme] = [("url", 1 - len(scheme))]
    for cue in CUES:
        found[cue] = [("account", 1)]
    automaton = ahocorasick.Automaton()
    for anchor, kinds in found.items():
        automaton.add_word(anchor, (anchor, kinds))
    automaton.make_automaton()
    return automaton


def spans_of(text: str, automaton: ahocorasick.Automaton) -> list[tuple[int, int, int]]:
    """(start, kind number, end) in order."""
    done = dict.fromkeys(KINDS, 0)
    found = []
    for last, (anchor, kinds) in automaton.iter(lowered(text)):
        for kind, shift in kinds:
            at = last + shift
            if at < done[kind]:
                continue
            if kind == "account":
                span = ACCOUNTS.get(anchor, expand_secret)(text, at, done[kind], anchor)
            else:
                span = PARSERS[kind](text, at, done[kind])
            if span:
                done[kind] = span[1]
                if span[2]:
                    found.append((span[0], KINDS.index(kind), span[1]))
    return sorted(found)


SPANS = "array<struct<kind:string,start:int,end:int>>"


def finder():
    held: list = []  # one automaton per Python worker

    def work(texts: pa.Array) -> pa.Array:
        if not held:
            held.append(anchors())
        rows = [
            [{"kind": KINDS[k], "start": s, "end": e} for s, k, e in spans_of(text, held[0])]
            for text in texts.to_pylist()
        ]
        kind = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])
        return pa.array(rows, pa.list_(kind))

    run = by_pieces(work)

    def apply(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        return run(batches)

    return F.arrow_udf(apply, SPANS)


def with_spans(docs: DataFrame, column: str = "pii") -> DataFrame:
    """Adds the spans of each text, as an array of (kind, start, end)."""
    return docs.withColumn(column, finder()(F.col("text")))


def redacted(docs: DataFrame) -> DataFrame:
    """The same rows with the characters of every span replaced by its kind in brackets.

    Of spans that overlap, the one that starts first is named and their union goes.
    """

    def step(state: Column, span: Column) -> Column:
        text, done, out = F.col("_text"), state["done"], state["out"]
        fresh = span["start"] >= done
        between = F.substring(text, done + 1, span["start"] - done)
        return F.struct(
            F.greatest(done, span["end"]).alias("done"),
            F.when(fresh, F.concat(out, between, F.lit("["), span["kind"], F.lit("]"))).otherwise(out).alias("out"),
        )

    rows = docs.select(F.struct("*").alias("_row"), F.col("text").alias("_text"), finder()(F.col("text")).alias("_spans"))
    start = F.struct(F.lit(0).alias("done"), F.lit("").alias("out"))
    folded = F.aggregate(
        "_spans", start, step, lambda s: F.concat(s["out"], F.substring(F.col("_text"), s["done"] + 1, F.lit(2**31 - 1)))
    )
    text = F.when(F.size("_spans") > 0, folded).otherwise(F.col("_text"))
    return rows.select(
        *[(text if c == "text" else F.col(f"_row.`{c}`")).alias(c) for c in docs.columns]
    )


def pii_report(docs: DataFrame) -> DataFrame:
    """Counts of the base kinds, the digest of their spans and all spans as text."""
    found = with_spans(docs.select("doc_id", text_of().alias("text")))
    base = F.filter("pii", lambda s: s["kind"].isin(*BASE))

    def joined(spans: Column) -> Column:
        return F.array_join(
            F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
        )

    counts = [
        F.size(F.filter("pii", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}") for kind in KINDS
    ]
    return found.select(
        "doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("pii")).alias("spans")
    )
