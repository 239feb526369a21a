"""Format-preserving pseudonyms for personal data, by keyed Feistel networks. DataFrame functions only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
#: Days of the 400 years from 1800 on, as a product of two near factors, so a Feistel network over them is exact.
DAYS_LEFT, DAYS_RIGHT, FIRST_DAY = 189, 773, "1800-01-01"
#: What may stand beside a number and is none of its groups: IP addresses, dates, expiry dates, times; and hyphened numbers.
BESIDE = r"(?:\d{1,3}\.){3}\d|\d{4}-\d{2}-\d{2}(?!\d)|\d{2}/\d{2}/\d{4}|\d{2}\.\d{2}\.\d{4}|\d{2}[/:]\d{2}(?!\d)"
HYPHENED = r"\d{3}-\d{2}-\d{4}(?![\d-])|\d{3}-\d{3}-\d{4}(?![\d-])"
#: Groups of a phone number after its area code: under one sign where that goes, none the start of what may stand beside; 15 digits at most.
AREA = r"[ .-]?(?:\(\d{2,4}\)|\d{2,4})"
ONE_STYLE = rf"(?:(?: (?!{BESIDE}|{HYPHENED})\d{{2,4}}){{2,4}}|(?:-(?!{BESIDE})\d{{2,4}}){{2,4}}|(?:\.\d{{2,4}}){{2,4}}|\d{{4,16}})"
ANY_STYLE = rf"(?:(?: (?!{BESIDE}|{HYPHENED})|-(?!{BESIDE})|\.)?\d{{2,4}}){{2,4}}"
NO_LONGER = r"(?<!\+" + r"[ ().-]{0,2}\d" * 16 + r"[ ().\d-]{0,14})"
#: Countries by the length of their IBANs.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL",
    24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
KNOWN = "|".join(IBAN_LENGTHS.values()).replace(" ", "|")
#: Groups of four and the rest, as long as the country's are; of other countries, any length up to the next IBAN.
IBANS = "|".join(rf"(?:{c.replace(' ', '|')})\d{{2}}(?: ?[A-Z0-9]{{4}}){{{(n - 4) // 4}}}" + (rf" ?[A-Z0-9]{{{n % 4}}}" if n % 4 else "") for n, c in IBAN_LENGTHS.items())
IBANS += rf"|(?!{KNOWN})[A-Z]{{2}}\d{{2}}(?: ?(?!(?:{KNOWN})\d{{2}} ?[A-Z0-9]{{4}})[A-Z0-9]{{4}}){{2,7}}(?: ?[A-Z0-9]{{1,3}})?"
#: Card numbers among other groups of digits: the lengths that numbers of such a start have, in groups of three or more but the last.
CARDS = r"^(?:4(?:\d{12}|\d{15}|\d{18})|(?:5[1-5]|2[2-7])\d{14}|3[47]\d{13}|3[0689]\d{12,17}|35\d{14,17}|(?:5[06-9]|6\d)\d{11,17})$"
GROUPS = r"^(?:\d{3,}[ -])*\d+$"
#: The labels of a domain up to the last that begins with two letters; loops that never go back, so its length is no matter.
DOMAIN = r"(?=[A-Za-z0-9-])(?:[A-Za-z0-9-]*+(?:\.(?![A-Za-z]{2})[A-Za-z0-9-]++)*+\.[A-Za-z]{2,}+)++"
#: What is looked for, in order of preference where two start at one place. Fixed formats.
PATTERNS = {
    "email": rf"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@{DOMAIN}",
    "key": r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b",
    "iban": rf"\b(?:{IBANS})\b",
    "ip": r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?!\d|\.\d)",
    "date": r"(?<![\d./-])(?:\d{4}-\d{2}-\d{2}|\d{2}/\d{2}/\d{4}|\d{2}\.\d{2}\.\d{4})(?![\d/-]|\.\d)",
    "ssn": r"(?<![\d-])(?!000|666|9)\d{3}-(?!00)\d{2}-(?!0000)\d{4}(?![\d-])",
    "phone": rf"\+1{AREA}[ .-]?\d{{3}}[ .-]?\d{{4}}(?![.-]?\d)|\+\d{{1,3}}{AREA}(?:{ONE_STYLE}(?![.-]\d)|{ANY_STYLE})(?!\d){NO_LONGER}|(?<!\d)(?:\(\d{{3}}\) ?|\d{{3}}-)\d{{3}}-\d{{4}}(?!\d)",
    "card": rf"(?<![\d.])\d(?:(?:[ -](?!{BESIDE}|{HYPHENED}))?\d){{12,400}}(?!\d|\.\d)",
}
ANY = "|".join(PATTERNS.values())


def _let(value: Column, use) -> Column:
    """use(value), with value taken once."""
    return F.transform(F.array(value), use)[0]


def _number(key: str, *parts: Column) -> Column:
    """60 bits of a keyed hash of the parts."""
    return F.conv(F.substring(F.sha2(F.concat_ws("\x1f", F.lit(key), *parts), 256), 1, 15), 16, 10).cast("long")


def feistel(value: Column, left: int, right: int, key: str, tag: str) -> Column:
    """A keyed permutation of 0 .. left * right - 1: halves in turn get a keyed hash of the other added, modulo their size."""

    def step(state: Column, k: Column) -> Column:
        x = F.pmod(state["x"] + F.pmod(_number(key, F.lit(tag), k.cast("string"), state["y"].cast("string")), state["p"]), state["p"])
        return F.struct(state["y"].alias("x"), x.alias("y"), state["q"].alias("p"), state["p"].alias("q"))

    start = F.struct(F.floor(value / F.lit(right)).cast("long").alias("x"), F.pmod(value, F.lit(right)).cast("long").alias("y"), F.lit(left).cast("long").alias("p"), F.lit(right).cast("long").alias("q"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, step, lambda s: s["x"] * right + s["y"])


def scramble(text: Column, key: str, tag: str) -> Column:
    """A keyed permutation of the strings of one format: digits stay digits, letters letters of their case, others stay.

    A Feistel network of two halves: in turn, each character of one half gets a keyed hash of the other half and of its
    own place added, modulo the size of its class; so each round can be undone and equal strings give equal ones. The
    work is in proportion to the length.
    """

    def step(state: Column, k: Column) -> Column:
        n, first = F.size(state), k % 2 == 0
        half = F.floor((n + 1) / 2).cast("int")
        other = F.when(first, F.slice(state, half + 1, n - half)).otherwise(F.slice(state, F.lit(1), half))

        def moved(c: Column, i: Column, seed: Column) -> Column:
            size, base = F.when(F.ascii(c) < 58, 10).otherwise(26), F.when(F.ascii(c) < 58, 48).when(F.ascii(c) < 91, 65).otherwise(97)
            return F.char(base + F.pmod(F.ascii(c) - base + F.pmod(_number(key, seed, i.cast("string")), size), size))

        def turn(seed: Column) -> Column:
            return F.transform(state, lambda c, i: F.when(((i < half) == first) & c.rlike("^[0-9A-Za-z]$"), moved(c, i, seed)).otherwise(c))

        return _let(F.sha2(F.concat_ws("\x1f", F.lit(key), F.lit(tag), k.cast("string"), F.array_join(other, "")), 256), turn)

    characters = F.filter(F.split(text, ""), lambda c: F.length(c) > 0)
    return F.array_join(F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), characters, step), "")


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, r"[^0-9]", "")


def _refill(shape: Column, digits: Column) -> Column:
    """shape with its digits replaced, in order, by the given ones."""
    at = lambda i: F.length(_digits(F.substring(shape, F.lit(1), i)))
    one = lambda i: F.when(F.substring(shape, i, F.lit(1)).rlike("^[0-9]$"), F.substring(digits, at(i), F.lit(1))).otherwise(F.substring(shape, i, F.lit(1)))
    return F.array_join(F.transform(F.sequence(F.lit(1), F.length(shape)), one), "")


def luhn_sum(digits: Column) -> Column:
    """The Luhn sum; digits with a valid check digit give a multiple of 10."""

    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, -i, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return total + F.when(i % 2 == 0, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add)


def _made_card(m: Column, key: str) -> Column:
    """The first digit stays, the check digit is made anew, those between are permuted."""

    def made(d: Column) -> Column:
        body = F.concat(F.substring(d, 1, 1), scramble(F.substring(d, F.lit(2), F.length(d) - 2), key, "card"))
        return _let(body, lambda b: F.concat(b, F.pmod(-luhn_sum(F.concat(b, F.lit("0"))), F.lit(10)).cast("string")))

    return _refill(m, _let(_digits(m), made))


def _cards_within(m: Column, key: str) -> Column:
    """m with the card numbers replaced that begin and end at borders of its groups, from the left, the longest first."""

    def within(x: Column) -> Column:
        groups = x["groups"]
        start = lambda i: F.get(x["starts"], i)
        part = lambda i, j: F.substring(m, start(i), start(j) + F.length(F.get(groups, j)) - start(i))

        def step(state: Column, i: Column) -> Column:
            ends = F.sequence(i, F.least(F.size(groups) - 1, i + 6))
            parts = F.filter(F.transform(ends, lambda j: F.struct(j.alias("j"), part(i, j).alias("p"))), lambda x: (F.length(x["p"]) - x["j"] + i >= 13) & x["p"].rlike(GROUPS) & _digits(x["p"]).rlike(CARDS) & (luhn_sum(_digits(x["p"])) % 10 == 0))
            before = F.when(i > 0, F.substring(m, start(i) - 1, F.lit(1))).otherwise(F.lit(""))
            found = lambda x: F.struct(F.concat(state["out"], before, _made_card(x["p"], key)).alias("out"), (x["j"] + 1).alias("next"))
            other = F.struct(F.concat(state["out"], before, F.get(groups, i)).alias("out"), state["next"].alias("next"))
            return F.when(i < state["next"], state).when(F.length(F.get(groups, i)) < 3, other).otherwise(_let(parts, lambda x: F.when(F.size(x) > 0, found(F.get(x, F.size(x) - 1))).otherwise(other)))

        begin = F.struct(F.lit("").alias("out"), F.lit(0).alias("next"))
        return F.aggregate(F.sequence(F.lit(0), F.size(groups) - 1), begin, step, lambda s: s["out"])

    def placed(groups: Column) -> Column:
        starts = F.aggregate(groups, F.array(F.lit(1)), lambda a, g: F.concat(a, F.array(F.element_at(a, -1) + F.length(g) + 1)))
        return F.struct(groups.alias("groups"), starts.alias("starts"))

    return _let(_let(F.split(m, "[ -]", -1), placed), within)


def _card(m: Column, key: str) -> Column:
    """All digits, if they are 13 to 19 and have a valid check digit, else the card numbers among them. Others stay.

    Where all are valid, but not as long as a card of such a start, a card among them goes first.
    """
    valid = lambda d: F.length(d).between(13, 19) & d.rlike("[1-9]") & (luhn_sum(d) % 10 == 0)

    def among(w: Column) -> Column:
        return F.when((w == m) & _let(_digits(m), valid), _made_card(m, key)).otherwise(w)

    return F.when(_let(_digits(m), lambda d: d.rlike(CARDS) & valid(d)), _made_card(m, key)).otherwise(_let(_cards_within(m, key), among))


def _ip(m: Column, key: str) -> Column:
    parts = F.split(m, r"\.")
    value = reduce(lambda a, i: a * 256 + parts[i].cast("long"), range(1, 4), parts[0].cast("long"))
    new = feistel(value, 65536, 65536, key, "ip")
    return _let(new, lambda v: F.concat_ws(".", *[F.pmod(F.shiftright(v, s), F.lit(256)).cast("string") for s in (24, 16, 8, 0)]))


def _date(m: Column, key: str) -> Column:
    """Days of 1800 to 2199, in the format they came in; a day first where it can be one. Other dates stay."""

    def one(form: str) -> Column:
        return F.try_to_timestamp(m, F.lit(form)).cast("date")

    def moved(day: Column, form: str) -> Column:
        n = F.datediff(day, F.lit(FIRST_DAY).cast("date")).cast("long")
        new = F.date_add(F.lit(FIRST_DAY).cast("date"), feistel(n, DAYS_LEFT, DAYS_RIGHT, key, "date").cast("int"))
        return F.when((n >= 0) & (n < DAYS_LEFT * DAYS_RIGHT), F.date_format(new, form))

    out = F.when(m.rlike("-"), moved(one("yyyy-MM-dd"), "yyyy-MM-dd")).when(m.rlike(r"\."), moved(one("dd.MM.yyyy"), "dd.MM.yyyy"))
    out = out.otherwise(F.coalesce(moved(one("dd/MM/yyyy"), "dd/MM/yyyy"), moved(one("MM/dd/yyyy"), "MM/dd/yyyy")))
    return F.coalesce(out, m)


def _iban(m: Column, key: str) -> Column:
    """The country stays, the account is permuted, the check digits are made anew. Without valid ones only cards within go."""

    def rest(text: Column) -> Column:
        """What is left of the characters' number after division by 97, letters counting 10 to 35."""
        add = lambda r, i: _let(F.ascii(F.substring(text, i, F.lit(1))), lambda c: F.when(c < 58, (r * 10 + c - 48) % 97).otherwise((r * 100 + c - 55) % 97))
        return F.aggregate(F.sequence(F.lit(1), F.length(text)), F.lit(0), add)

    def made(s: Column) -> Column:
        body = scramble(F.substring(s, F.lit(5), F.length(s)), key, "iban")
        return _let(body, lambda b: F.concat(F.substring(s, 1, 2), F.lpad((98 - rest(F.concat(b, F.substring(s, 1, 2), F.lit("00")))).cast("string"), 2, "0"), b))

    def fill(shape: Column, s: Column) -> Column:
        at = lambda i: F.length(F.replace(F.substring(shape, F.lit(1), i), F.lit(" "), F.lit("")))
        return F.array_join(F.transform(F.sequence(F.lit(1), F.length(shape)), lambda i: F.when(F.substring(shape, i, F.lit(1)) == " ", " ").otherwise(F.substring(s, at(i), F.lit(1)))), "")

    return _let(F.replace(m, F.lit(" "), F.lit("")), lambda s: F.when(rest(F.concat(F.substring(s, F.lit(5), F.length(s)), F.substring(s, 1, 4))) == 1, fill(m, made(s))).otherwise(_cards_within(m, key)))


def _email(m: Column, key: str) -> Column:
    return F.concat(scramble(F.substring_index(m, "@", 1), key, "email"), F.lit("@"), F.substring_index(m, "@", -1))


def _phone(m: Column, key: str) -> Column:
    """A country code stays, the other digits are permuted, the signs between them stay."""
    code = F.regexp_extract(m, r"^\+\d{1,3}?(?=[ .(-])|^\+\d", 0)
    return F.concat(code, _let(F.substring(m, F.length(code) + 1, F.length(m)), lambda r: _refill(r, scramble(_digits(r), key, "phone"))))


def _key(m: Column, key: str) -> Column:
    return F.concat(F.substring(m, 1, 4), scramble(F.substring(m, F.lit(5), F.length(m)), key, "key"))


def pseudonym(m: Column, key: str) -> Column:
    """The pseudonym of one match; a match that isn't valid (check digits, calendar) stays as it is."""
    whole = {k: m.rlike(f"^(?:{p})$") for k, p in PATTERNS.items()}
    made = {"email": _email, "key": _key, "iban": _iban, "ip": _ip, "date": _date, "ssn": lambda m, key: _refill(m, scramble(_digits(m), key, "ssn")), "phone": _phone, "card": _card}
    out = F.when(F.lit(False), m)
    for kind, condition in whole.items():
        out = out.when(condition, made[kind](m, key))
    return out.otherwise(m)


def pseudonymised(text: Column, key: str) -> Column:
    """struct(text, n_replaced): text with all matches replaced; null stays null, with 0 replaced."""
    found = F.regexp_extract_all(text, F.lit(ANY), F.lit(0))

    def put(m: Column) -> Column:
        parts = F.struct(F.transform(m, lambda x: pseudonym(x, key)).alias("new"), F.split(text, ANY, -1).alias("gaps"))
        return _let(
            parts,
            lambda p: F.struct(
                F.concat(p["gaps"][0], F.array_join(F.zip_with(p["new"], F.slice(p["gaps"], F.lit(2), F.size(m)), lambda x, y: F.concat(x, y)), "")).alias("text"),
                F.aggregate(F.zip_with(m, p["new"], lambda x, y: (x != y).cast("int")), F.lit(0), lambda a, x: a + x).alias("n_replaced"),
            ),
        )

    plain = F.struct(text.alias("text"), F.lit(0).alias("n_replaced"))
    return F.when(F.coalesce(text.rlike("[0-9@]|AKIA|ASIA"), F.lit(False)), _let(found, lambda m: F.when(F.size(m) > 0, put(m)).otherwise(plain))).otherwise(plain)


def pseudonymise(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the text's personal data replaced, and n_replaced int (in place of a column of that name).

    E-mail addresses (their local part), cloud keys, IBANs and card numbers with valid check digits, IPv4 addresses,
    calendar dates of 1800 to 2199, social security numbers and phone numbers get pseudonyms of the same format, by a
    permutation under `key`: equal values get equal ones in all documents, different values different ones. Spacing and
    signs stay, and what only looks alike (failing check digits, no such day) stays. Null text stays null. All rows,
    repeated ones too, and all other columns stay; an empty table stays empty. No shuffle; texts are taken whole.
    """
    if not key:
        raise ValueError("a key is needed")
    rows = docs.withColumn("__pii", pseudonymised(F.col(text_col).cast("string"), key))
    return rows.withColumn(text_col, F.col("__pii.text")).withColumn("n_replaced", F.col("__pii.n_replaced")).drop("__pii")
