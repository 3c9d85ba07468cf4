"""Personal data: keyed pseudonyms that keep the format, with DataFrame functions only.

Numbers and dates are found by pattern, validated, and permuted within their own format by a keyed
Feistel network, so equal values get equal pseudonyms in every document, different values different
ones, and the text keeps its shape:

* cards: 13 to 19 digits with a valid check digit; all digits but the last are permuted, the check
  digit is made anew; blanks and hyphens stay. Where a number stands behind a card after one blank, the
  shortest reading whose check digit holds is the card;
* phones: an international prefix and 7 to 14 digits; the digits after the prefix are permuted. Where the
  country's numbers have one length (`PLANS`) the phone ends there; elsewhere a free number that stands
  behind it after one blank can't be told from a last group and is taken as one;
* IPv4 addresses: permuted as 32-bit numbers;
* dates: yyyy-mm-dd, dd.mm.yyyy and dd/mm/yyyy, valid in the calendar and from 1800 to 2199: permuted
  as day numbers of that 400-year cycle, which 189 x 773 factors exactly, so no value leaves it;
* e-mail addresses are no numbers: their local part becomes a keyed hash, the domain stays.

Numbers that fail validation stay as they are. Matches are replaced by interleaving the text between
them with their pseudonyms; nothing is shuffled.

Defined cases: a null text stays null, an empty one empty; texts of any length are processed whole;
repeated values and rows give repeated pseudonyms.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
# A domain name has 253 characters at most, so 126 labels before the last; unbounded, the repetition of a group would
# exhaust the matcher's stack on long texts.
EMAIL = r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]{1,64}+@(?:[A-Za-z0-9-]{1,63}\.){1,126}[A-Za-z]{2,24}(?![A-Za-z0-9-])"
DATE = r"(?<![\p{L}\p{N}./-])(?:\d{4}-\d{2}-\d{2}|\d{2}\.\d{2}\.\d{4}|\d{2}/\d{2}/\d{4})(?![\p{L}\p{N}/-]|\.\d)"
IPV4 = r"(?<![\p{L}\p{N}.])\d{1,3}(?:\.\d{1,3}){3}(?![\p{L}\p{N}]|\.\d)"
# A card must fill whole groups: what stands before and behind it, and its longest reading at each place.
_CARD_START, _CARD_END = r"(?<![\p{L}\p{N}.-])", r"(?![\p{L}\p{N}]|[.-]\d)"
CARD = rf"\d{{4}}(?:[ -]?\d){{9,15}}{_CARD_END}"
# Country codes by the digits of their national numbers, where all numbers have as many.
PLANS = {10: "1|7|30|44|52|57|90|91", 9: "31|33|34|41|48|351", 8: "45|47"}
_PHONE_START, _PHONE_END = r"(?<![\p{L}\p{N}+])\+", r"(?![\p{L}\p{N}]|-\d)"
_PLANNED = "|".join(
    rf"(?:{codes})[ -](?:\((?=\d{{2,4}}\))\d(?:\)?[ -]?\d){{{n - 1}}}|\d(?:[ -]?\d){{{n - 1}}}){_PHONE_END}" for n, codes in PLANS.items()
)


def _pattern(cards: str) -> str:
    """The pattern of all kinds; `cards` is that of the text's valid cards.

    A phone of a plan ends with the plan's last digit; another one takes up to four groups more, but
    none that begins a date, an address or a card.
    """
    shape = r"(?=\d{1,3}[ -](?:\(\d{2,4}\)[ -]?)?\d{2,4}[ -]\d{2,4})"
    free = rf"\d{{1,3}}[ -](?:\(\d{{2,4}}\)[ -]?)?\d{{2,4}}(?:(?:-| (?!{DATE}|{IPV4}|{cards}))\d{{2,4}}){{1,4}}{_PHONE_END}"
    return "|".join((EMAIL, DATE, IPV4, rf"{_PHONE_START}(?:{shape}(?:{_PLANNED})|{free})", cards))


KINDS = ("email", "date", "ipv4", "phone", "card")

_DAYS, _WIDE, _LONG = 146_097, 189, 773  # days of 400 years, and their factors
_DAY0 = "1800-01-01"


def _hash(key: str, *parts: Column) -> Column:
    """A keyed 60-bit number."""
    return F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(key), *(p.cast("string") for p in parts)), 256), 1, 15), 16, 10).cast("long")


def feistel(a: Column, b: Column, mod_a: Column, mod_b: Column, key: str, tweak: Column) -> Column:
    """Struct (a, b): a permutation of the pairs below (mod_a, mod_b), keyed and different per tweak."""

    def turn(s: Column, r: Column) -> Column:
        new_a = F.pmod(s["a"] + F.pmod(_hash(key, tweak, r, s["b"]), mod_a), mod_a)
        new_b = F.pmod(s["b"] + F.pmod(_hash(key, tweak, r, s["a"]), mod_b), mod_b)
        odd = r % 2 == 1
        return F.struct(F.when(odd, new_a).otherwise(s["a"]).alias("a"), F.when(odd, s["b"]).otherwise(new_b).alias("b"))

    first = F.struct(a.cast("long").alias("a"), b.cast("long").alias("b"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), first, turn)


def _digits(number: Column, length: Column) -> Column:
    return F.lpad(number.cast("string"), length.cast("int"), "0")


def permute_digits(digits: Column, key: str, kind: str) -> Column:
    """A digit string of the same length; a permutation of all strings of that length (2 to 36)."""
    half = F.floor(F.char_length(digits) / 2).cast("int")
    rest = F.char_length(digits) - half
    ten = lambda n: F.rpad(F.lit("1"), n + 1, F.lit("0")).cast("long")
    tweak = F.concat(F.lit(kind), F.char_length(digits).cast("string"))
    out = feistel(F.substr(digits, F.lit(1), half).cast("long"), F.substr(digits, half + 1).cast("long"), ten(half), ten(rest), key, tweak)
    return F.transform(F.array(out), lambda p: F.concat(_digits(p["a"], half), _digits(p["b"], rest)))[0]


def luhn_sum(digits: Column, doubled: int) -> Column:
    """Sum of the check-digit scheme; from the right, places 0, 1, ...; those of parity `doubled` count twice."""
    n = F.char_length(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.substr(digits, n - i, F.lit(1)).cast("int")
        two = d * 2 - F.when(d > 4, 9).otherwise(0)
        return total + F.when(i % 2 == doubled, two).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), add)


def _refill(pattern_of: Column, digits: Column) -> Column:
    """The text `pattern_of` with its digits replaced, in order, by `digits`."""
    step = lambda s, c: F.struct(
        F.concat(s["out"], F.when(F.rlike(c, F.lit("[0-9]")), F.substr(digits, s["i"], F.lit(1))).otherwise(c)).alias("out"),
        (s["i"] + F.rlike(c, F.lit("[0-9]")).cast("int")).alias("i"),
    )
    chars = F.split(pattern_of, "")
    return F.aggregate(chars, F.struct(F.lit("").alias("out"), F.lit(1).alias("i")), step)["out"]


def _only_digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _card(m: Column, key: str) -> Column:
    digits = _only_digits(m)
    body = permute_digits(F.substr(digits, F.lit(1), F.char_length(digits) - 1), key, "card")
    check = F.pmod(10 - luhn_sum(body, 0) % 10, F.lit(10)).cast("string")
    new = F.concat(body, check)
    return F.when((luhn_sum(digits, 1) % 10 == 0) & ~F.rlike(digits, F.lit("^0+$")), F.transform(F.array(new), lambda d: _refill(m, d))[0]).otherwise(m)


def _valid_cards(value: Column) -> Column:
    """The distinct cards in a text, shortest first: at each place every reading that ends with a group."""

    def readings(c: Column) -> Column:
        ends = F.filter(F.sequence(F.lit(13), F.char_length(c)), lambda n: F.substr(c, n + 1, F.lit(1)).isin(" ", ""))
        return F.transform(ends, lambda n: F.substr(c, F.lit(1), n))

    def valid(c: Column) -> Column:
        d = _only_digits(c)
        return F.char_length(d).between(13, 19) & (luhn_sum(d, 1) % 10 == 0)

    places = F.regexp_extract_all(value, F.lit(f"{_CARD_START}(?=({CARD}))"), F.lit(1))
    found = F.filter(F.array_distinct(F.flatten(F.transform(places, readings))), valid)
    return F.transform(F.array_sort(F.transform(found, lambda c: F.struct(F.char_length(c).alias("n"), c.alias("c")))), lambda x: x["c"])


def patterns(value: Column) -> Column:
    """The pattern of a text, which names its valid cards."""
    none = F.lit(_pattern("(?!)"))
    one, *more = _pattern(rf"{_CARD_START}(?=\d)(?:<cards>){_CARD_END}").split("<cards>")
    cards = F.array_join(_valid_cards(value), "|")
    parts = [F.lit(one)]
    for x in more:
        parts += [cards, F.lit(x)]
    return F.when(F.rlike(value, F.lit(r"\d{4}(?:[ -]?\d){9}")) & (cards != ""), F.concat(*parts)).otherwise(none)


def _phone(m: Column, key: str) -> Column:
    prefix = F.regexp_extract(m, r"^\+\d{1,3}", 0)
    tail = F.substr(m, F.char_length(prefix) + 1)
    digits = _only_digits(tail)
    n = F.char_length(digits)
    return F.when(n.between(7, 14), F.concat(prefix, F.transform(F.array(permute_digits(digits, key, "phone")), lambda d: _refill(tail, d))[0])).otherwise(m)


def _ipv4(m: Column, key: str) -> Column:
    o = F.transform(F.split(m, r"\."), lambda x: x.cast("long"))
    out = feistel(o[0] * 256 + o[1], o[2] * 256 + o[3], F.lit(65536), F.lit(65536), key, F.lit("ipv4"))
    text = F.transform(F.array(out), lambda p: F.concat_ws(".", F.floor(p["a"] / 256), p["a"] % 256, F.floor(p["b"] / 256), p["b"] % 256))[0]
    return F.when(F.forall(o, lambda x: x <= 255), text).otherwise(m)


def _date(m: Column, key: str) -> Column:
    iso, dotted = F.substr(m, F.lit(5), F.lit(1)) == "-", F.substr(m, F.lit(3), F.lit(1)) == "."
    fmt = F.when(iso, F.lit("yyyy-MM-dd")).when(dotted, F.lit("dd.MM.yyyy")).otherwise(F.lit("dd/MM/yyyy"))
    text = F.when(iso, m).otherwise(F.concat_ws("-", F.substr(m, F.lit(7), F.lit(4)), F.substr(m, F.lit(4), F.lit(2)), F.substr(m, F.lit(1), F.lit(2))))
    day = F.datediff(F.try_to_date(text, "yyyy-MM-dd"), F.lit(_DAY0).cast("date"))
    out = feistel(F.floor(day / _LONG), day % _LONG, F.lit(_WIDE), F.lit(_LONG), key, F.lit("date"))
    new = F.transform(F.array(out), lambda p: F.date_add(F.lit(_DAY0).cast("date"), (p["a"] * _LONG + p["b"]).cast("int")))[0]
    y, mm, dd = F.date_format(new, "yyyy"), F.date_format(new, "MM"), F.date_format(new, "dd")
    shown = F.when(iso, F.concat_ws("-", y, mm, dd)).when(dotted, F.concat_ws(".", dd, mm, y)).otherwise(F.concat_ws("/", dd, mm, y))
    return F.when(day.between(0, _DAYS - 1), F.transform(F.array(shown), lambda s: s)[0]).otherwise(m)


def _email(m: Column, key: str) -> Column:
    domain = F.substring_index(m, "@", -1)
    return F.concat(F.lit("u"), F.substring(F.sha2(F.concat_ws("|", F.lit(key), F.lit("email"), m), 256), 1, 12), F.lit("@"), domain)


def _kind(m: Column) -> Column:
    whole = lambda p: F.rlike(m, F.lit(f"^(?:{p})$"))
    return (
        F.when(F.contains(m, F.lit("@")), "email")
        .when(F.startswith(m, F.lit("+")), "phone")
        .when(whole(r"\d{4}-\d{2}-\d{2}|\d{2}\.\d{2}\.\d{4}|\d{2}/\d{2}/\d{4}"), "date")
        .when(whole(r"\d{1,3}(?:\.\d{1,3}){3}"), "ipv4")
        .otherwise("card")
    )


def pseudonymise(docs: DataFrame, key: str, text: str = "text", changed: str = "changed") -> DataFrame:
    """`docs` with pseudonyms in `text` and `changed`: array of (kind, old length, new value)."""
    value = F.col(f"`{text}`")
    some = F.rlike(value, F.lit("[0-9@]"))
    pattern = patterns(value)
    found = F.when(some, F.regexp_extract_all(value, pattern, F.lit(0))).otherwise(F.array().cast("array<string>"))

    def replaced(m: Column) -> Column:
        kind = _kind(m)
        new = F.when(kind == "email", _email(m, key)).when(kind == "phone", _phone(m, key)).when(kind == "date", _date(m, key))
        new = new.when(kind == "ipv4", _ipv4(m, key)).otherwise(_card(m, key))
        return F.struct(kind.alias("kind"), m.alias("old"), new.alias("new"))

    done = docs.withColumn(changed, F.transform(found, replaced))
    gaps = F.split(value, pattern)
    joined = F.array_join(F.flatten(F.zip_with(gaps, changed, lambda g, m: F.array(g, F.coalesce(m["new"], F.lit(""))))), "")
    new_text = F.when(F.size(changed) > 0, joined).otherwise(value)
    kept = F.transform(F.filter(changed, lambda m: m["old"] != m["new"]), lambda m: F.struct(m["kind"].alias("kind"), F.char_length(m["old"]).alias("length"), m["new"].alias("new")))
    return done.withColumn(text, new_text).withColumn(changed, kept)
