"""Format-preserving pseudonyms for personal data (operator 2), in DataFrame functions only.

Each kind of value has a pattern, a check that finds are real (ranges, check digits, calendar) and a permutation: the
value's free digits are read as a pair of numbers (l, r) with l < a and r < b, and eight rounds (ROUNDS = 4 double ones) of
a keyed Feistel network, l += F(r) mod a, then r += F(l) mod b, permute the a * b pairs. The format (length, separators, check digits,
calendar) stays valid, equal values get equal pseudonyms in all documents, and with the key the rounds can be undone.
Values of letters and digits (names in e-mail addresses, account numbers, hex strings) are halved, and the same rounds shift
each character of one half within its own alphabet by a keyed digest of the other half and of the value's shape. Where case
doesn't tell values apart (addresses, hex strings), the lower-case value is permuted and its case put back at the end, so
that the same value in two cases has the same pseudonym but for case.

Finds that fail their check stay as they are. All patterns are linear: their repetitions are bounded, and they begin only
where no character of theirs stands before.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.urls import ipv6_groups

ROUNDS = 4


def feistel(l: Column, r: Column, a: int, b: int, key: str, kind: str, inverse: bool = False) -> Column:
    """Struct (l, r): the keyed permutation of the pairs below (a, b); ``inverse`` undoes it."""

    def f(x: Column, i: Column, side: str, size: int) -> Column:
        digest = F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), F.lit(side), i, x), 256)
        return F.conv(F.substring(digest, 1, 14), 16, 10).cast("long") % size

    pair = lambda x, y: F.struct(x.alias("l"), y.alias("r"))

    def ahead(s: Column, i: Column) -> Column:
        first = F.transform(F.array(s), lambda s: pair((s["l"] + f(s["r"], i, "l", a)) % a, s["r"]))
        return F.element_at(F.transform(first, lambda s: pair(s["l"], (s["r"] + f(s["l"], i, "r", b)) % b)), 1)

    def back(s: Column, i: Column) -> Column:
        first = F.transform(F.array(s), lambda s: pair(s["l"], F.pmod(s["r"] - f(s["l"], i, "r", b), F.lit(b).cast("long"))))
        return F.element_at(F.transform(first, lambda s: pair(F.pmod(s["l"] - f(s["r"], i, "l", a), F.lit(a).cast("long")), s["r"])), 1)

    rounds = F.sequence(F.lit(ROUNDS), F.lit(1), F.lit(-1)) if inverse else F.sequence(F.lit(1), F.lit(ROUNDS))
    return F.aggregate(rounds, pair(l.cast("long"), r.cast("long")), back if inverse else ahead)


def permuted_digits(digits: Column, n: int, key: str, kind: str, inverse: bool = False) -> Column:
    """A keyed permutation of the strings of n digits."""
    half = n // 2
    pair = feistel(F.substring(digits, 1, half), F.substring(digits, half + 1, n - half), 10**half, 10 ** (n - half), key, kind, inverse)
    return F.element_at(F.transform(F.array(pair), lambda p: F.concat(F.lpad(p["l"].cast("string"), half, "0"), F.lpad(p["r"].cast("string"), n - half, "0"))), 1)


#: Alphabets in which the characters of a value stay: letters and digits, or hex digits of either case.
WORDLIKE, HEX = "wordlike", "hex"


def string_feistel(value: Column, key: str, kind: str, tweak: Column, alphabets: str = WORDLIKE, inverse: bool = False) -> Column:
    """A keyed permutation of all strings of the value's shape: letters a-z, A-Z and digits stay such (or hex digits stay
    hex digits), other characters stay as they are. ``tweak``: what else the rounds hang on."""
    shape = F.regexp_replace(F.regexp_replace(F.regexp_replace(value, "[a-z]", "a"), "[A-Z]", "A"), "[0-9]", "0")
    salt = F.concat_ws("|", F.lit(key), F.lit(kind), shape if alphabets == WORDLIKE else F.length(value).cast("string"), tweak)
    half = F.floor(F.length(value) / 2).cast("int")
    sign = -1 if inverse else 1

    def shifted(text: Column, other: Column, i: Column, side: str) -> Column:
        def one(c: Column, at: Column) -> Column:
            step = F.conv(F.substring(F.sha2(F.concat_ws("|", salt, F.lit(side), i, other, at), 256), 1, 12), 16, 10).cast("long")
            within = lambda first, size: F.char(F.lit(first) + F.pmod(F.ascii(c) - first + sign * (step % size), F.lit(size).cast("long")))
            if alphabets == HEX:
                digit = F.lower(F.conv(F.pmod(F.conv(c, 16, 10).cast("long") + sign * (step % 16), F.lit(16).cast("long")).cast("string"), 10, 16))
                return F.when(c.rlike("[0-9a-fA-F]"), digit).otherwise(c)
            return F.when(c.rlike("[a-z]"), within(97, 26)).when(c.rlike("[A-Z]"), within(65, 26)).when(c.rlike("[0-9]"), within(48, 10)).otherwise(c)

        return F.array_join(F.transform(F.split(text, "(?<=.)(?=.)"), one), "")

    pair = lambda x, y: F.struct(x.alias("l"), y.alias("r"))

    def ahead(s: Column, i: Column) -> Column:
        first = F.transform(F.array(s), lambda s: pair(shifted(s["l"], s["r"], i, "l"), s["r"]))
        return F.element_at(F.transform(first, lambda s: pair(s["l"], shifted(s["r"], s["l"], i, "r"))), 1)

    def back(s: Column, i: Column) -> Column:
        first = F.transform(F.array(s), lambda s: pair(s["l"], shifted(s["r"], s["l"], i, "r")))
        return F.element_at(F.transform(first, lambda s: pair(shifted(s["l"], s["r"], i, "l"), s["r"])), 1)

    rounds = F.sequence(F.lit(ROUNDS), F.lit(1), F.lit(-1)) if inverse else F.sequence(F.lit(1), F.lit(ROUNDS))
    start = pair(F.substr(value, F.lit(1), half), F.substr(value, half + 1))
    return F.aggregate(rounds, start, back if inverse else ahead, lambda s: F.concat(s["l"], s["r"]))


def luhn_sum(digits: Column) -> Column:
    """Sum of the digits ahead of a check digit: every second one from the last on doubled (less 9 if over 9)."""
    n = F.length(digits)
    each = F.transform(F.split(digits, "(?<=.)(?=.)"), lambda d, i: F.when((n - i) % 2 == 1, d.cast("int") * 2 - F.when(d.cast("int") > 4, 9).otherwise(0)).otherwise(d.cast("int")))
    return F.aggregate(each, F.lit(0), lambda s, d: s + d)


def digits_of(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def is_card(value: Column) -> Column:
    """Whether the last digit is the Luhn check digit of the others."""
    digits = digits_of(value)
    return (luhn_sum(F.substr(digits, F.lit(1), F.length(digits) - 1)) + F.right(digits, F.lit(1)).cast("int")) % 10 == 0


#: Digits between the first two and the last of the shorter cards, by their length.
SHORT_CARDS = {15: 12, 14: 11, 13: 10}


def card_pseudonym(value: Column, key: str, inverse: bool = False) -> Column:
    """Sixteen digits: the first fifteen are permuted; 13 to 15: all between the first two, which tell the issuer, and the
    last. The last is their Luhn check digit, and separators stay."""
    digits = digits_of(value)
    body = F.when(F.length(digits) == 16, permuted_digits(F.substring(digits, 1, 15), 15, key, "card", inverse))
    for n, free in SHORT_CARDS.items():
        body = body.when(F.length(digits) == n, F.concat(F.substring(digits, 1, 2), permuted_digits(F.substring(digits, 3, free), free, key, f"card{n}", inverse)))
    new = F.element_at(F.transform(F.array(body), lambda b: F.concat(b, F.pmod(-luhn_sum(b), F.lit(10)).cast("string"))), 1)
    return refilled(value, new)


def remainder_97(text: Column) -> Column:
    """An account number's remainder by 97, letters read as 10 to 35."""
    number = lambda c: F.when(c.rlike("[0-9]"), c.try_cast("int")).otherwise(F.ascii(c) - 55)
    return F.aggregate(F.split(text, "(?<=.)(?=.)"), F.lit(0), lambda r, c: (r * F.when(c.rlike("[0-9]"), 10).otherwise(100) + number(c)) % 97)


def is_account(value: Column) -> Column:
    """Whether the check digits (places 3 and 4) of an international account number fit, spaces aside."""
    bare = F.replace(value, F.lit(" "), F.lit(""))
    return F.length(bare).between(15, 34) & (remainder_97(F.concat(F.substr(bare, F.lit(5)), F.substring(bare, 1, 4))) == 1)


def account_pseudonym(value: Column, key: str, inverse: bool = False) -> Column:
    """What follows the country and the check digits is permuted within its shape; check digits are made anew."""
    bare = F.replace(value, F.lit(" "), F.lit(""))
    country = F.substring(bare, 1, 2)
    new = string_feistel(F.substr(bare, F.lit(5)), key, "account", country, WORDLIKE, inverse)
    whole = F.element_at(F.transform(F.array(new), lambda n: F.concat(country, F.lpad((98 - remainder_97(F.concat(n, country, F.lit("00")))).cast("string"), 2, "0"), n)), 1)
    return F.when(value.contains(" "), F.array_join(F.filter(F.split(whole, "(?<=\\G.{4})"), lambda x: x != ""), " ")).otherwise(whole)


def phone_pseudonym(value: Column, key: str, inverse: bool = False) -> Column:
    """Ten-digit numbers, however written: the country code and all separators stay, the ten digits are permuted."""
    digits = digits_of(value)
    country = F.substring(digits, 1, F.length(digits) - 10)
    new = F.concat(country, permuted_digits(F.right(digits, F.lit(10)), 10, key, "phone", inverse))
    return refilled(value, new)


def is_dialled(value: Column) -> Column:
    return F.length(digits_of(value)).between(8, 15)


def dialled_pseudonym(value: Column, key: str, inverse: bool = False) -> Column:
    """International numbers: the digits of the first group (three at most; two without separators) and all separators
    stay, the others are permuted."""
    digits = digits_of(value)
    first = F.length(F.regexp_extract(value, "^[+]([0-9]{1,3})[^0-9]", 1))
    kept = F.when(first > 0, first).otherwise(2)
    rest = string_feistel(F.substr(digits, kept + 1), key, "dialled", F.substr(digits, F.lit(1), kept), WORDLIKE, inverse)
    return refilled(value, F.concat(F.substr(digits, F.lit(1), kept), rest))


def refilled(value: Column, digits: Column) -> Column:
    """``value`` with its digits replaced by ``digits`` in order; all else stays in place."""
    shape = F.regexp_replace(value, "[0-9]", "0")

    def put(s: Column, c: Column) -> Column:
        isdigit = c == "0"
        at = s["n"] + F.when(isdigit, 1).otherwise(0)
        return F.struct(F.concat(s["out"], F.when(isdigit, F.substring(s["from"], at, F.lit(1))).otherwise(c)).alias("out"), at.alias("n"), s["from"].alias("from"))

    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("n"), digits.alias("from"))
    return F.aggregate(F.split(shape, "(?<=.)(?=.)"), start, put, lambda s: s["out"])


def ip_pseudonym(value: Column, key: str, inverse: bool = False) -> Column:
    """Dotted IPv4 addresses: all four bytes are permuted as one number of 32 bits."""
    part = lambda i: F.element_at(F.split(value, "[.]"), i).cast("long")
    pair = feistel(part(1) * 256 + part(2), part(3) * 256 + part(4), 1 << 16, 1 << 16, key, "ip", inverse)
    octets = lambda p: F.concat_ws(".", *[x.cast("string") for side in ("l", "r") for x in (F.floor(p[side] / 256), p[side] % 256)])
    return F.element_at(F.transform(F.array(pair), octets), 1)


def email_pseudonym(value: Column, key: str, inverse: bool = False) -> Column:
    """The name before the @ is permuted within its shape; the domain stays, for it names no person."""
    name, domain = F.substring_index(value, "@", 1), F.substring_index(value, "@", -1)
    new = string_feistel(lower_ascii(name), key, "email", F.lower(domain), WORDLIKE, inverse)
    return F.concat(recased(new, name), F.lit("@"), domain)


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lower_ascii(value: Column) -> Column:
    return F.translate(value, UPPER, LOWER)


def recased(new: Column, like: Column) -> Column:
    """``new`` with A-Z where ``like``, of the same length, has them."""
    each = lambda text: F.split(text, "(?<=.)(?=.)")
    return F.when(like.rlike("[A-Z]"), F.array_join(F.zip_with(each(new), each(like), lambda n, c: F.when(c.rlike("[A-Z]"), F.upper(n)).otherwise(n)), "")).otherwise(new)


def in_its_case(value: Column, permute: Callable[[Column], Column]) -> Column:
    """``permute`` of a hex value in lower case; in upper case if the value has letters and all are such."""
    new = permute(F.lower(value))
    return F.when(value == F.lower(value), new).otherwise(F.upper(new))


def ipv6_pseudonym(value: Column, key: str, inverse: bool = False) -> Column:
    """All hex digits that are written are permuted; the form (groups, colons, case) stays. Undone, an address comes back
    in lower case if its pseudonym has no letters."""
    return in_its_case(value, lambda v: string_feistel(v, key, "ipv6", F.lit(""), HEX, inverse))


def secret_pseudonym(value: Column, key: str, inverse: bool = False) -> Column:
    return in_its_case(value, lambda v: string_feistel(v, key, "secret", F.lit(""), HEX, inverse))


#: Days of the 400 years from 1800 on: the Gregorian calendar repeats after 146,097 days = 773 * 189.
FIRST_DAY, DAYS = "1800-01-01", (773, 189)


def american(value: Column) -> Column:
    """A date as month/day/year, in the order year-month-day."""
    return F.concat(F.substring(value, 7, 4), F.lit("-"), F.substring(value, 1, 2), F.lit("-"), F.substring(value, 4, 2))


def american_date_pseudonym(value: Column, key: str, inverse: bool = False) -> Column:
    """Month/day/year: the same permutation as that of the same day in ISO form."""
    new = date_pseudonym(american(value), key, inverse)
    return F.concat_ws("/", F.substring(new, 6, 2), F.substring(new, 9, 2), F.substring(new, 1, 4))


def is_american_date(value: Column) -> Column:
    return is_date(american(value))


def date_pseudonym(value: Column, key: str, inverse: bool = False) -> Column:
    """ISO dates (with -, / or . between) from 1800 to 2199: the day's number is permuted among the 146,097 days."""
    day = F.datediff(F.try_to_date(F.regexp_replace(value, "[/.]", "-"), "yyyy-MM-dd"), F.lit(FIRST_DAY).cast("date"))
    pair = feistel(F.floor(day / DAYS[1]), day % DAYS[1], *DAYS, key, "date", inverse)
    new = F.element_at(F.transform(F.array(pair), lambda p: F.date_add(F.lit(FIRST_DAY).cast("date"), (p["l"] * DAYS[1] + p["r"]).cast("int"))), 1)
    return refilled(value, F.date_format(new, "yyyyMMdd"))


def ssn_pseudonym(value: Column, key: str, inverse: bool = False) -> Column:
    """AAA-GG-SSSS with area 001-665 or 667-899, group 01-99, serial 0001-9999: permuted among the valid ones."""
    area, group, serial = (F.substring(value, a, n).cast("long") for a, n in ((1, 3), (5, 2), (8, 4)))
    area = area - F.when(area > 666, 2).otherwise(1)  # 0 to 897
    pair = feistel(area * 99 + group - 1, serial - 1, 898 * 99, 9999, key, "ssn", inverse)

    def shown(p: Column) -> Column:
        a = F.floor(p["l"] / 99)
        pad = lambda c, n: F.lpad(c.cast("string"), n, "0")
        return F.concat_ws("-", pad(a + F.when(a > 664, 2).otherwise(1), 3), pad(p["l"] % 99 + 1, 2), pad(p["r"] + 1, 4))

    return F.element_at(F.transform(F.array(pair), shown), 1)


def is_ip(value: Column) -> Column:
    return F.forall(F.split(value, "[.]"), lambda x: x.cast("int") <= 255)


def is_ssn(value: Column) -> Column:
    return ~value.rlike("^(000|666|9)|-00-|-0000$")


def is_date(value: Column) -> Column:
    return F.try_to_date(F.regexp_replace(value, "[/.]", "-"), "yyyy-MM-dd").isNotNull() & value.rlike("^(18|19|20|21)")


def is_ipv6(value: Column) -> Column:
    """Whether it is an address with four hex digits or more: shorter ones name no host of a person, or are other text."""
    return ipv6_groups(value).isNotNull() & (F.length(F.replace(value, F.lit(":"), F.lit(""))) >= 4)


always = lambda value: F.lit(True)


@dataclass(frozen=True)
class Kind:
    """``context``: a pattern that must stand before a find, if any."""

    name: str
    pattern: str
    check: Callable[[Column], Column]
    pseudonym: Callable[[Column, str, bool], Column]
    context: str = ""


DIGIT_EDGES = ("(?<![0-9])", "(?![0-9])")
GROUP = "[0-9a-f]{1,4}"
IPV6 = f"(?:{GROUP}:){{7}}{GROUP}|(?:{GROUP}:){{1,7}}:(?:{GROUP}(?::{GROUP}){{0,6}})?"
#: The order breaks ties of what a text's next find is; no find overlaps another.
KINDS = (
    Kind("secret", r"(?:[0-9a-f]{32,64}|[0-9A-F]{32,64})(?![0-9A-Za-z])", always, secret_pseudonym, r"(?:token|secret|key|password)[\"']? {0,2}[=:] {0,2}[\"']?"),
    Kind("email", r"(?<![\p{L}0-9._%+-])[\p{L}0-9._%+-]++@(?:[\p{L}0-9-]{1,63}+[.]){1,8}\p{L}{2,24}(?![\p{L}0-9-])", always, email_pseudonym),
    Kind("phone", r"(?:[+][0-9]{1,3}[ .-]?)?(?:[(][0-9]{3}[)] ?|(?<![0-9])[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])", always, phone_pseudonym),
    Kind("ten", r"[2-9][0-9]{2}[2-9][0-9]{6}(?![0-9])", always, phone_pseudonym, r"(?:[Tt]el|[Pp]hone|[Cc]all|[Mm]obile|[Ff]ax)[.:]{0,2} "),
    Kind("dialled", r"(?<![0-9+])[+][1-9][0-9]{0,2}(?:[ .-]?[0-9]{2,5}){2,5}(?![0-9])", is_dialled, dialled_pseudonym),
    Kind("ip", r"(?<![0-9.])[0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}(?![0-9]|[.][0-9])", is_ip, ip_pseudonym),
    Kind("ipv6", rf"(?<![0-9A-Za-z:.])(?:{IPV6}|{IPV6.replace('a-f', 'A-F')})(?![0-9A-Za-z:]|[.][0-9])", is_ipv6, ipv6_pseudonym),
    Kind("account", r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)(?![0-9A-Za-z])", is_account, account_pseudonym),
    Kind("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", is_ssn, ssn_pseudonym),
    Kind("date", r"(?<![0-9./-])[0-9]{4}(?:-[0-9]{2}-|/[0-9]{2}/|[.][0-9]{2}[.])[0-9]{2}(?![0-9]|[./-][0-9])", is_date, date_pseudonym),
    Kind("american date", r"(?<![0-9./-])[0-9]{2}/[0-9]{2}/[0-9]{4}(?![0-9]|[./-][0-9])", is_american_date, american_date_pseudonym),
    Kind("card", r"(?<![0-9])(?:[0-9]{16}|[0-9]{4}(?: [0-9]{4}){3}|[0-9]{4}(?:-[0-9]{4}){3}|3[47][0-9]{13}|3[0689][0-9]{12}|4[0-9]{12})(?![0-9])", is_card, card_pseudonym),
)
ANY = "|".join((f"(?<={k.context})" if k.context else "") + f"(?:{k.pattern})" for k in KINDS)
#: A cheap test that a text may hold a find at all.
HINT = r"[0-9]{3}-[0-9]|[0-9][.][0-9]|[0-9]{13}|@|[0-9]{4}[/ -]|[0-9]/[0-9]{2}/|[)] ?[0-9]|[0-9]{3} [0-9]{3}|[+][1-9]|[0-9A-Fa-f]:[0-9A-Fa-f:]|::|[A-Z]{2}[0-9]{2}|[0-9a-f]{32}|[0-9A-F]{32}|[lex:.] [0-9]{10}"


def replaced(find: Column, key: str, inverse: bool = False) -> Column:
    """A find's pseudonym by its kind; finds that fail their kind's check stay."""
    out = None
    for kind in KINDS:
        case = (find.rlike(f"^(?:{kind.pattern})\\z"), F.when(kind.check(find), kind.pseudonym(find, key, inverse)).otherwise(find))
        out = F.when(*case) if out is None else out.when(*case)
    return out.otherwise(find)


def pseudonymise(docs: DataFrame, key: str, inverse: bool = False) -> DataFrame:
    """Per document: doc_id, text with all finds replaced, n_found (finds), n_replaced (those whose text changed).

    n_found counts what has a kind's pattern; what fails the kind's check stays. Null texts stay null with no finds; blank
    and long texts are searched whole; repeated rows are alike; an empty table gives no rows; other columns are ignored.
    ``inverse`` turns pseudonyms made with the same key back.
    """
    text = F.col("text")
    finds = F.when(text.rlike(HINT), F.regexp_extract_all(text, F.lit(f"({ANY})"), F.lit(1))).otherwise(F.array().cast("array<string>"))
    found = docs.select("doc_id", "text", F.coalesce(finds, F.array().cast("array<string>")).alias("_finds"))
    made = found.withColumn("_new", F.transform("_finds", lambda v: replaced(v, key, inverse)))
    between = F.split("text", ANY, -1)
    joined = F.array_join(F.zip_with(between, "_new", lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    return made.select(
        "doc_id",
        F.when(F.size("_finds") > 0, joined).otherwise(F.col("text")).alias("text"),
        F.size("_finds").cast("long").alias("n_found"),
        F.size(F.filter(F.zip_with("_finds", "_new", lambda a, b: a != b), lambda x: x)).cast("long").alias("n_replaced"),
    )
