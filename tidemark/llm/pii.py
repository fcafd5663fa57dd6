r"""Personal data as format-preserving Feistel pseudonyms, in DataFrame functions alone.

Found and validated: e-mail addresses (the part before the @), IBANs (check
modulo 97), payment cards (Luhn), US social security numbers (assigned ranges,
with hyphens or spaces), international phone numbers (7 to 15 digits), IPv4
addresses (octets, none with a leading zero) and dates
(ISO, d.m.y and m/d/y; 1800 to 2199). Each valid value is mapped by a keyed
permutation of its own format: an eight-round Feistel network over the product
Z_a x Z_b whose size is just the format's, so nothing has to be walked or
padded: a date becomes a date, a card a card of the same length and first
digit with a right check digit. Equal values get equal pseudonyms in every
document, different ones different ones, and the key reverses them. A phone's,
card's, IBAN's or social security number's separators make no difference; an
e-mail address's case does. Of an e-mail address digits and letters from A to Z
are permuted, and other letters stay.
Round values come from SHA-256 over the key, the format, the round and the other
half.

Values that fail validation stay as they are. A value's pieces of more than 24
characters are permuted one by one.

Odd input: a null text stays null with nothing replaced; a null id stays null;
repeated rows each get a row; empty tables give empty results; other columns
stay as they are, the added ones excepted.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS, PIECE = 8, 24

#: Labels and their number are bounded, as a mail domain's are: the matcher recurses once a label.
#: Accented Latin, Greek and Cyrillic letters stand in local parts, too; in scripts without spaces a sentence would run into one.
_LOCAL = r"[A-Za-z0-9._%+\u00C0-\u024F\u0370-\u052F-]"
EMAIL = r"(?<!" + _LOCAL + ")" + _LOCAL + r"{1,64}+@(?:[A-Za-z0-9-]{1,63}+\.){1,127}[A-Za-z]{2,}+"
IBAN = r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)"
#: What a space sets apart from a phone or card before it.
_NEXT = r"\d{1,3}(?:\.\d{1,3}){3}|\d{2}\.\d{2}\.\d{4}|\d{1,2}/\d{2}|\d{4}-\d{2}-\d{2}(?![\d-])|\d{3}-\d{2}-\d{4}(?![\d-])"
#: 15 digits at most, so that a longer run is tried shorter; a card of 16 digits is not a phone's.
PHONE = r"(?<![\w+])\+\d{1,3}(?:[ -]?\(\d{1,4}\))?(?:(?: (?!" + _NEXT + r"|\d{4}(?:[ -]?\d{4}){3}(?![\w-]))|-?)\d{2,4}){2,5}(?![\w-])(?<!" + r"\d[ ()-]{0,3}" * 16 + ")"
IP = r"(?<![\w.])\d{1,3}(?:\.\d{1,3}){3}(?!\w|\.\d)"
DATE = r"(?<![\w.])(?:\d{4}-\d{2}-\d{2}(?=T\d{2})|(?:\d{4}-\d{2}-\d{2}|\d{2}\.\d{2}\.\d{4}|\d{2}/\d{2}/\d{4})(?!\w))"
#: With spaces it is no part of a longer row of digits.
SSN = r"(?<![\w-])(?:\d{3}-\d{2}-\d{4}(?![\w-])|(?<!\d )\d{3} \d{2} \d{4}(?![\w-])(?! (?!" + _NEXT + r")\d))"
CARD = r"(?<![\w-])\d(?:(?: (?!" + _NEXT + r")|-?)\d){12,18}(?![\w-])"
ANY = "|".join([EMAIL, IBAN, PHONE, IP, DATE, SSN, CARD])

Permute = Callable[[Column, Column, Column, Column, str | Column], Column]


def _prf(key: str, tweak: Column, r: Column, value: Column) -> Column:
    """60 keyed pseudorandom bits."""
    return F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(key), tweak, r.cast("string"), value.cast("string")), 256), 1, 15), 16, 10).cast("long")


def feistel(key: str, back: bool = False) -> Permute:
    """The permutation of Z_a x Z_b, as a function of (x, y, a, b, tweak) that returns a struct of x and y; back: its inverse."""
    order = list(range(ROUNDS))[:: -1 if back else 1]

    def run(x: Column, y: Column, a: Column, b: Column, tweak: str | Column) -> Column:
        tweak = F.lit(tweak) if isinstance(tweak, str) else tweak

        def step(s: Column, r: Column) -> Column:
            even = r % 2 == 0
            moved = F.pmod(_prf(key, tweak, r, F.when(even, s["y"]).otherwise(s["x"])), F.when(even, a).otherwise(b))
            moved = -moved if back else moved
            return F.struct(F.when(even, F.pmod(s["x"] + moved, a)).otherwise(s["x"]).alias("x"), F.when(even, s["y"]).otherwise(F.pmod(s["y"] + moved, b)).alias("y"))

        return F.aggregate(F.array(*map(F.lit, order)), F.struct(x.cast("long").alias("x"), y.cast("long").alias("y")), step)

    return run


def _is_free(c: Column) -> Column:
    return c.rlike("[0-9A-Za-z]")


def _radix(c: Column) -> Column:
    return F.when(c.rlike("[0-9]"), 10).otherwise(26).cast("long")


def _zero(c: Column) -> Column:
    return F.when(c.rlike("[0-9]"), 48).when(c.rlike("[A-Z]"), 65).otherwise(97)


def _ranked(chars: Column) -> Column:
    return F.aggregate(chars, F.lit(0).cast("long"), lambda v, c: v * _radix(c) + F.ascii(c) - _zero(c))


def _room(chars: Column) -> Column:
    return F.aggregate(chars, F.lit(1).cast("long"), lambda v, c: v * _radix(c))


def _unranked(value: Column, like: Column) -> Column:
    """The characters of a rank, each in its model's class."""
    start = F.struct(value.alias("v"), F.lit("").alias("out"))
    step = lambda s, c: F.struct(_div(s["v"], _radix(c)).alias("v"), F.concat(F.chr((_zero(c) + s["v"] % _radix(c)).cast("long")), s["out"]).alias("out"))
    return F.aggregate(F.reverse(like), start, step)["out"]


def _div(a: Column, b: Column) -> Column:
    """Whole division of longs."""
    return F.call_function("div", a, b)


def characters(s: Column, permute: Permute, tweak: str | Column) -> Column:
    """s with its digits and letters permuted, each within its class; other characters stay."""
    tweak = F.lit(tweak) if isinstance(tweak, str) else tweak

    def piece(i: Column) -> Column:
        chars = F.split(F.substring(s, i * PIECE + 1, F.lit(PIECE)), "")
        chars = F.filter(chars, lambda c: c != "")
        free = F.filter(chars, _is_free)
        half = _div(F.size(free).cast("long"), F.lit(2).cast("long")).cast("int")
        one, two = F.slice(free, F.lit(1), half), F.slice(free, half + 1, F.size(free))
        kinds = F.array_join(F.transform(free, lambda c: _zero(c).cast("string")), ".")
        done = permute(_ranked(one), _ranked(two), _room(one), _room(two), F.concat(tweak, F.lit("/"), i.cast("string"), F.lit("/"), kinds))
        new = F.concat(_unranked(done["x"], one), _unranked(done["y"], two))
        merged = F.aggregate(
            chars,
            F.struct(F.lit(1).alias("i"), F.lit("").alias("out"), new.alias("new")),
            lambda t, c: F.struct((t["i"] + F.when(_is_free(c), 1).otherwise(0)).alias("i"), F.concat(t["out"], F.when(_is_free(c), F.substring(t["new"], t["i"], F.lit(1))).otherwise(c)).alias("out"), t["new"].alias("new")),
        )
        return merged["out"]

    return F.array_join(F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.length(s) / PIECE).cast("int") - 1)), piece), "")


def _digits(s: Column) -> Column:
    return F.filter(F.split(F.regexp_replace(s, r"\D", ""), ""), lambda c: c != "")


def luhn_sum(digits: Column, doubled: int) -> Column:
    """Of an array of digits, the last one's place counted as 0: places of the parity `doubled` are doubled."""
    return F.aggregate(
        F.transform(F.reverse(digits), lambda c, i: F.when(i % 2 != doubled, c.cast("int")).otherwise(c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0))),
        F.lit(0),
        lambda a, b: a + b,
    )


def _card(m: Column, permute: Permute) -> Column:
    """First digit kept, the others but the last permuted, the last one the check digit; signs between digits stay."""
    digits = _digits(m)
    n = F.size(digits)
    body = characters(F.array_join(F.slice(digits, F.lit(2), n - 2), ""), permute, "card")
    front = F.concat(digits[0], body)
    check = F.pmod(-luhn_sum(F.split(front, ""), 0), F.lit(10))
    return _poured(m, F.concat(front, check.cast("string")))


def _poured(form: Column, digits: Column) -> Column:
    """digits in the places that form has digits and capitals in."""
    return F.aggregate(
        F.split(form, ""),
        F.struct(F.lit(1).alias("i"), F.lit("").alias("out"), digits.alias("new")),
        lambda t, c: F.struct((t["i"] + F.when(_is_free(c), 1).otherwise(0)).alias("i"), F.concat(t["out"], F.when(_is_free(c), F.substring(t["new"], t["i"], F.lit(1))).otherwise(c)).alias("out"), t["new"].alias("new")),
    )["out"]


def mod97(s: Column) -> Column:
    """Of digits and capitals (A is 10), modulo 97."""
    return F.aggregate(F.filter(F.split(s, ""), lambda c: c != ""), F.lit(0), lambda v, c: F.when(c.rlike("[0-9]"), v * 10 + F.ascii(c) - 48).otherwise(v * 100 + F.ascii(c) - 55) % 97)


def _bare(m: Column) -> Column:
    return F.replace(m, F.lit(" "), F.lit(""))


def _iban_ok(m: Column) -> Column:
    s = _bare(m)
    return mod97(F.concat(F.substring(s, F.lit(5), F.length(s)), F.substring(s, 1, 4))) == 1


def _iban(m: Column, permute: Permute) -> Column:
    s = _bare(m)
    country = F.substring(s, 1, 2)
    own = characters(F.substring(s, F.lit(5), F.length(s)), permute, F.concat(F.lit("iban"), country))
    check = F.lpad((98 - mod97(F.concat(own, country, F.lit("00")))).cast("string"), 2, "0")
    return _poured(m, F.concat(country, check, own))


def _ssn_ok(m: Column) -> Column:
    return ~m.rlike(r"^(?:000|666|9)|^....00|0000$")


def _ssn(m: Column, permute: Permute) -> Column:
    area, group, serial = (F.substring(m, s, n).cast("long") for s, n in ((1, 3), (5, 2), (8, 4)))
    done = permute(area - F.when(area > 666, 2).otherwise(1), (group - 1) * 9999 + serial - 1, F.lit(898), F.lit(99 * 9999), "ssn")
    area = done["x"] + F.when(done["x"] >= 665, 2).otherwise(1)
    return _poured(m, F.concat(F.lpad(area.cast("string"), 3, "0"), F.lpad((_div(done["y"], F.lit(9999).cast("long")) + 1).cast("string"), 2, "0"), F.lpad((done["y"] % 9999 + 1).cast("string"), 4, "0")))


def _ip_ok(m: Column) -> Column:
    return F.forall(F.split(m, r"\."), lambda o: (o.cast("int") <= 255) & ~o.rlike("^0."))


def _ip(m: Column, permute: Permute) -> Column:
    o = F.transform(F.split(m, r"\."), lambda x: x.cast("long"))
    done = permute(o[0] * 256 + o[1], o[2] * 256 + o[3], F.lit(65536), F.lit(65536), "ip")
    return F.concat_ws(".", *[part.cast("string") for v in ("x", "y") for part in (_div(done[v], F.lit(256).cast("long")), done[v] % 256)])


#: Form, and the days that all forms share: 400 years from 1800, 189 * 773 days.
FORMS = {r"^\d{4}-": "yyyy-MM-dd", r"^\d\d\.": "dd.MM.yyyy", r"^\d\d/": "MM/dd/yyyy"}


def _day(m: Column) -> Column:
    """Days since 1800-01-01; null if it is no date of these 400 years."""
    read = F.coalesce(*[F.when(m.rlike(p), F.try_to_date(m, form)) for p, form in FORMS.items()])
    days = F.datediff(read, F.lit("1800-01-01").cast("date"))
    return F.when(days.between(0, 189 * 773 - 1), days.cast("long"))


def _date(m: Column, permute: Permute) -> Column:
    day = _day(m)
    done = permute(_div(day, F.lit(773).cast("long")), day % 773, F.lit(189), F.lit(773), "date")
    new = F.date_add(F.lit("1800-01-01").cast("date"), (done["x"] * 773 + done["y"]).cast("int"))
    return F.coalesce(*[F.when(m.rlike(p), F.date_format(new, form)) for p, form in FORMS.items()])


def _phone_ok(m: Column) -> Column:
    return F.length(F.regexp_replace(m, r"\D", "")).between(7, 15)


def _phone(m: Column, permute: Permute) -> Column:
    """The first three digits stay; the others are permuted by themselves, so that separators make no difference."""
    digits = F.regexp_replace(m, r"\D", "")
    head = F.substring(digits, 1, 3)
    return _poured(m, F.concat(head, characters(F.substring(digits, F.lit(4), F.length(digits)), permute, F.concat(F.lit("phone"), head))))


def _email(m: Column, permute: Permute) -> Column:
    local = F.substring_index(m, "@", 1)
    return F.concat(characters(local, permute, "email"), F.substring(m, F.length(local) + 1, F.length(m)))


def kind_of(m: Column) -> Column:
    """The kind of a match; null if it isn't valid."""
    whole = lambda p: m.rlike(f"^(?:{p})$")
    return (
        F.when(m.contains("@"), "email")
        .when(m.rlike("^[A-Z]"), F.when(_iban_ok(m), "iban"))
        .when(m.startswith("+"), F.when(_phone_ok(m), "phone"))
        .when(whole(r"[\d.]+") & m.rlike(r"^\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}$"), F.when(_ip_ok(m), "ip"))
        .when(whole(DATE), F.when(_day(m).isNotNull(), "date"))
        .when(whole(SSN), F.when(_ssn_ok(m), "ssn"))
        .otherwise(F.when(luhn_sum(_digits(m), 1) % 10 == 0, "card"))
    )


def pseudonym(m: Column, kind: Column, permute: Permute) -> Column:
    by_kind = {"email": _email, "iban": _iban, "phone": _phone, "ip": _ip, "date": _date, "ssn": _ssn, "card": _card}
    out = m
    for name, f in by_kind.items():
        out = F.when(kind == name, f(m, permute)).otherwise(out)
    return out


def pseudonymised(docs: DataFrame, key: str, back: bool = False, text: str = "text") -> DataFrame:
    """docs with the text's personal data replaced, and kinds: the kinds of the values replaced, in order. back: undo it."""
    permute = feistel(key, back)
    there = F.col(text).rlike("[0-9@]") & F.col(text).rlike(ANY)  # most texts are done after one look
    found = F.transform(F.regexp_extract_all(text, F.lit(ANY), 0), lambda m: F.struct(m.alias("m"), kind_of(m).alias("kind")))
    gaps, held = ("_".join([name, *docs.columns]) for name in ("gaps", "found"))  # longer than any column's name
    docs = docs.withColumn(gaps, F.when(there, F.split(text, ANY, -1))).withColumn(held, F.when(F.col(gaps).isNotNull(), found).otherwise(F.array()))
    new = F.transform(held, lambda f: pseudonym(f["m"], f["kind"], permute))
    woven = F.concat(F.col(gaps)[0], F.array_join(F.zip_with(new, F.slice(gaps, 2, 1 << 30), lambda a, b: F.concat(a, b)), ""))
    kinds = F.transform(F.filter(held, lambda f: f["kind"].isNotNull()), lambda f: f["kind"])
    return docs.withColumn(text, F.when(F.size(held) > 0, woven).otherwise(F.col(text))).withColumn("kinds", F.coalesce(kinds, F.array().cast("array<string>"))).drop(gaps, held)
