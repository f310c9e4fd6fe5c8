"""Personal data: format-preserving Feistel pseudonyms.

One regular expression finds candidates; each is validated (Luhn sum, octets, calendar,
area numbers, modulus 97) and a valid one is replaced by another value of the same format.
Numbers and dates are permuted by a keyed Feistel network over the exact set of valid
values (two residues of moduli whose product is the size of the set), so the map is one to
one, no cycle walking is needed, and equal values stay linked across documents. Mail
addresses, which have no finite format, get a keyed name.

All of it is built-in expressions. A null text stays null, a text without candidates (an
empty one too) is returned as it is, and so is an empty table; texts of any length go through
whole, as no pattern steps back over what a loop has taken. Repeated rows are treated alike,
extra columns are carried along, except one named ``pii``, which is replaced.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, sealed

#: The default key of the queries; a production run passes its own.
KEY = "marlstone-demonstration-key"
ROUNDS = 10

_NOT_IN_WORD = r"(?<![A-Za-z0-9_])"
_WORD_ENDS = r"(?![A-Za-z0-9_])"
#: In order of preference where two could start at one place.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "iban": _NOT_IN_WORD + r"[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?" + _WORD_ENDS,
    "ip": r"(?<![A-Za-z0-9_.])\d{1,3}(?:\.\d{1,3}){3}(?![A-Za-z0-9_]|\.\d)",
    "date": r"(?<![A-Za-z0-9_./-])(?:\d{4}([-/.])\d{1,2}\1\d{1,2}|\d{1,2}([-/.])\d{1,2}\2\d{4})(?![A-Za-z0-9_]|[./-]\d)",
    "ssn": r"(?<![A-Za-z0-9_-])\d{3}-\d{2}-\d{4}(?![A-Za-z0-9_]|-\d)",
    "phone": r"(?<![A-Za-z0-9_])(?:\+\d{1,3}[ .-]?(?:\(\d{2,4}\)[ .-]?|\d{2,4}[ .-])\d{3,4}[ .-]?\d{3,4}|\+\d{8,15}|\(\d{3}\) ?\d{3}[ .-]\d{4}|\d{3}[ .-]\d{3}[ .-]\d{4})(?![A-Za-z0-9_]|-\d)",
    "card": r"(?<![A-Za-z0-9_-])\d(?:[ -]?\d){12,18}(?![A-Za-z0-9_]|-\d)",
}
KINDS = tuple(PATTERNS)


def _numbered(patterns: dict[str, str]) -> str:
    """The date pattern refers back to its separators, which are groups 1 and 2 here too."""
    return "|".join(f"(?:{p})" for p in patterns.values())


CANDIDATE = _numbered(PATTERNS)


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _digest(key: str, *parts: Column) -> Column:
    """60 bits of a keyed hash as a long."""
    return F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(key), *parts), 256), 1, 15), 16, 10).cast("long")


def feistel(left: Column, right: Column, a: Column, b: Column, key: str, tweak: Column) -> Column:
    """Keyed permutation of the pairs (left < a, right < b), as a struct (l, r): even rounds
    add to the left residue what a hash of the right one gives, odd rounds the other way."""
    start = F.struct(left.cast("long").alias("l"), right.cast("long").alias("r"))

    def step(s: Column, i: Column) -> Column:
        even = i % 2 == 0
        add = _digest(key, tweak, i.cast("string"), F.when(even, s["r"]).otherwise(s["l"]).cast("string"))
        return F.struct(F.when(even, F.pmod(s["l"] + F.pmod(add, a), a)).otherwise(s["l"]).alias("l"), F.when(even, s["r"]).otherwise(F.pmod(s["r"] + F.pmod(add, b), b)).alias("r"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step)


def _power(n: Column) -> Column:
    return F.rpad(F.lit("1"), n + 1, "0").cast("long")


def permuted_digits(digits: Column, key: str, kind: str) -> Column:
    """A digit string of up to 18 to another of that length."""
    n = F.length(digits)
    half = F.floor(n / 2).cast("int")
    number = lambda s: F.coalesce(s.try_cast("long"), F.lit(0).cast("long"))
    new = feistel(number(F.substr(digits, F.lit(1), half)), number(F.substr(digits, half + 1)), _power(half), _power(n - half), key, F.concat_ws(":", F.lit(kind), n.cast("string")))
    pad = lambda x, k: F.when(k > 0, F.lpad(x.cast("string"), k, "0")).otherwise("")
    return bound(new, lambda x: F.concat(pad(x["l"], half), pad(x["r"], n - half)))


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, r"[^0-9]", "")


def _refilled(token: Column, digits: Column) -> Column:
    """The token with its digits replaced one by one."""
    place = lambda i: F.length(_digits(F.substr(token, F.lit(1), i)))
    char = lambda i: F.substr(token, i, F.lit(1))
    return bound(digits, lambda d: F.array_join(F.transform(F.sequence(F.lit(1), F.length(token)), lambda i: F.when(char(i).between("0", "9"), F.substr(d, place(i), F.lit(1))).otherwise(char(i))), ""))


def _luhn(digits: Column) -> Column:
    """Luhn sum modulo 10, the last digit taken as the check digit."""
    n = F.length(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.substr(digits, i, F.lit(1)).cast("int")
        twice = F.when((n - i) % 2 == 1, d * 2).otherwise(d)
        return total + F.when(twice > 9, twice - 9).otherwise(twice)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10


def _card(token: Column, key: str) -> Column:
    check = lambda body: (10 - _luhn(F.concat(body, F.lit("0")))) % 10
    whole = lambda body: F.concat(body, check(body).cast("string"))
    new = lambda digits: bound(permuted_digits(F.substr(digits, F.lit(1), F.length(digits) - 1), key, "card"), whole)
    return bound(_digits(token), lambda digits: F.when(_luhn(digits) == 0, _refilled(token, new(digits))))


#: Lengths of the countries' calling codes, by their first digits.
_CALLING_CODE = r"^\+(?:[17]|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3})"
#: North American numbers: neither the area nor the exchange begins with 0 or 1.
_NORTH_AMERICAN = r"^[2-9]\d{2}[2-9]\d{6}$"


def _phone(token: Column, key: str) -> Column:
    """The country's code stays. A national number of North American form goes to another
    one; without a country's code or brackets only that form counts as a phone number."""
    code = F.regexp_extract(F.concat(F.regexp_extract(token, "^[+]?", 0), _digits(token)), _CALLING_CODE, 0)
    bare = ~F.substr(token, F.lit(1), F.lit(1)).isin("+", "(")

    def north(d: Column) -> Column:
        part = lambda at, n: F.substr(d, F.lit(at), F.lit(n)).try_cast("long")
        pair = feistel(part(1, 3) - 200, (part(4, 3) - 200) * 10000 + part(7, 4), F.lit(800), F.lit(8_000_000), key, F.lit("phone-north"))
        pad = lambda x, n: F.lpad(x.cast("long").cast("string"), n, "0")
        return bound(pair, lambda x: F.concat(pad(x["l"] + 200, 3), pad(F.floor(x["r"] / 10000) + 200, 3), pad(x["r"] % 10000, 4)))

    def national(d: Column) -> Column:
        return F.when(d.rlike(_NORTH_AMERICAN), north(d)).when(~bare, permuted_digits(d, key, "phone"))

    def whole(c: Column) -> Column:
        kept = F.regexp_replace(c, "[+]", "")
        new = bound(F.substr(_digits(token), F.length(kept) + 1), national)
        return bound(new, lambda d: F.when(d.isNotNull(), _refilled(token, F.concat(kept, d))))

    return bound(code, whole)


def _ip(token: Column, key: str) -> Column:
    part = lambda i: F.get(F.split(token, r"\."), i).cast("long")
    pair = feistel(part(0) * 256 + part(1), part(2) * 256 + part(3), F.lit(65536), F.lit(65536), key, F.lit("ip"))
    new = bound(pair, lambda x: F.concat_ws(".", *((F.shiftright(x[h], s) % 256).cast("string") for h in ("l", "r") for s in (8, 0))))
    return F.when((part(0) < 256) & (part(1) < 256) & (part(2) < 256) & (part(3) < 256), new)


def _ssn(token: Column, key: str) -> Column:
    """Areas 001 to 899 but 666, groups 01 to 99, serials 0001 to 9999."""
    part = lambda i: F.get(F.split(token, "-"), i).cast("long")
    area = part(0)
    index = area - F.when(area > 666, 2).otherwise(1)
    pad = lambda x, k: F.lpad(x.cast("long").cast("string"), k, "0")

    def text(x: Column) -> Column:
        new = F.floor(x["l"] / 99)
        return F.concat_ws("-", pad(new + F.when(new >= 665, 2).otherwise(1), 3), pad(x["l"] % 99 + 1, 2), pad(x["r"] + 1, 4))

    pair = feistel(index * 99 + part(1) - 1, part(2) - 1, F.lit(898 * 99), F.lit(9999), key, F.lit("ssn"))
    return F.when(area.between(1, 899) & (area != 666) & (part(1) > 0) & (part(2) > 0), bound(pair, text))


#: Days from 1900-01-01 to 2099-12-31: 17 * 4297.
_DAYS = (17, 4297)


def _date(token: Column, key: str) -> Column:
    """Year first, or day (else month) first; years 1900 to 2099."""
    sep = F.substr(_no_digits(token), F.lit(1), F.lit(1))
    part = lambda i: F.get(F.split(token, r"[-/.]"), i)
    padded = lambda i: F.length(part(i)) == 2
    day_of = lambda y, m, d: F.try_to_date(F.concat_ws("-", y, F.lpad(m, 2, "0"), F.lpad(d, 2, "0")), "yyyy-MM-dd")
    first = F.length(part(0)) == 4
    day_first = day_of(part(2), part(1), part(0))
    day = F.when(first, day_of(part(0), part(1), part(2))).otherwise(F.coalesce(day_first, day_of(part(2), part(0), part(1))))
    fit = lambda x, wide: F.when(wide, F.lpad(x, 2, "0")).otherwise(x)

    def text(new: Column) -> Column:
        year, month, date = F.year(new).cast("string"), F.month(new).cast("string"), F.dayofmonth(new).cast("string")
        return (
            F.when(first, F.concat(year, sep, fit(month, padded(1)), sep, fit(date, padded(2))))
            .when(day_first.isNotNull(), F.concat(fit(date, padded(0)), sep, fit(month, padded(1)), sep, year))
            .otherwise(F.concat(fit(month, padded(0)), sep, fit(date, padded(1)), sep, year))
        )

    def moved(n: Column) -> Column:
        pair = feistel(F.floor(n / _DAYS[1]), n % _DAYS[1], F.lit(_DAYS[0]), F.lit(_DAYS[1]), key, F.lit("date"))
        new = bound(pair, lambda x: F.date_add(F.lit("1900-01-01").cast("date"), (x["l"] * _DAYS[1] + x["r"]).cast("int")))
        return F.when(n.between(0, _DAYS[0] * _DAYS[1] - 1), bound(new, text))

    return bound(F.datediff(day, F.lit("1900-01-01").cast("date")).cast("long"), moved)


def _no_digits(s: Column) -> Column:
    return F.regexp_replace(s, r"[0-9]", "")


def _mod97(s: Column) -> Column:
    def add(total: Column, i: Column) -> Column:
        c = F.substr(s, i, F.lit(1))
        return F.when(c.between("0", "9"), (total * 10 + c.cast("int")) % 97).otherwise((total * 100 + F.ascii(c) - 55) % 97)

    return F.aggregate(F.sequence(F.lit(1), F.length(s)), F.lit(0), add)


def _iban(token: Column, key: str) -> Column:
    plain = F.replace(token, F.lit(" "), F.lit(""))
    country, body = F.substr(plain, F.lit(1), F.lit(2)), F.substr(plain, F.lit(5))
    new = lambda d: F.concat(permuted_digits(F.substr(d, F.lit(1), F.lit(18)), key, "iban"), permuted_digits(F.substr(d, F.lit(19)), key, "iban2"))
    check = lambda x: F.lpad((98 - _mod97(F.concat(_refilled(body, x), country, F.lit("00")))).cast("string"), 2, "0")
    whole = bound(bound(_digits(body), new), lambda x: F.concat(check(x), x))
    return F.when((_mod97(F.concat(body, F.substr(plain, F.lit(1), F.lit(4)))) == 1) & (F.length(plain) >= 15), _refilled(token, whole))


#: Groups of capitals and digits in a row, in which cards and account numbers can stand.
_CHAIN = r"(?:(?<![A-Za-z0-9_])[A-Z]{2}\d{2}[A-Z0-9]*+|(?<![A-Za-z0-9_+-])\d++)(?![A-Za-z0-9_])(?:[ -][A-Z0-9]++(?![A-Za-z0-9_]))++"
_LONG = r"[0-9](?:[ -]?[A-Z0-9]){12}"
#: How card numbers are grouped.
_CARD_GROUPS = r"^(?:\d{13,19}|\d{4}([ -])\d{4}\1\d{4}\1\d{4}(?:\1\d{1,3})?|\d{4}([ -])\d{4}\2\d{4}\2\d|\d{4}([ -])\d{6}\3\d{4,5})$"
_MOST_GROUPS = 9


def _is_number(s: Column) -> Column:
    """A valid card number in its usual groups, or a valid account number."""
    plain = F.replace(s, F.lit(" "), F.lit(""))
    account = F.when(s.rlike(f"^(?:{PATTERNS['iban']})$"), (_mod97(F.concat(F.substr(plain, F.lit(5)), F.substr(plain, F.lit(1), F.lit(4)))) == 1) & (F.length(plain) >= 15))
    return F.when(s.rlike(_CARD_GROUPS), bound(_digits(s), lambda d: _luhn(d) == 0)).otherwise(F.coalesce(account, F.lit(False)))


#: Ends a piece; where a text has this character or the next, both are written otherwise.
_CUT, _ESCAPE = "\uffff", "\ufffe"


def _marked(chain: Column) -> Column:
    """A chain with its valid numbers set apart: from each group on, the longest counts. All
    arrays are computed once, so the time is in proportion to the chain."""

    def of(groups: Column) -> Column:
        n = F.size(groups)
        at = F.sequence(F.lit(0), n - 1)
        joined = lambda i, j: F.array_join(F.slice(groups, i + 1, j - i), "")
        span = lambda i, j: F.regexp_replace(joined(i, j + 1), "^[ -]", "")
        fits = lambda s: F.when(F.length(s) >= 13, _is_number(s)).otherwise(F.lit(False))
        ends = F.transform(at, lambda i: F.coalesce(F.get(F.filter(F.sequence(F.least(i + _MOST_GROUPS - 1, n - 1), i, F.lit(-1)), lambda j: bound(span(i, j), fits)), F.lit(0)), F.lit(-1)))

        def cuts(end: Column) -> Column:
            none = F.array().cast("array<struct<i:int,j:int>>")
            start = F.struct(F.lit(0).alias("next"), none.alias("cuts"))
            taken = lambda s, i: F.struct((F.get(end, i) + 1).alias("next"), F.concat(s["cuts"], F.array(F.struct(i.alias("i"), F.get(end, i).alias("j")))).alias("cuts"))
            return F.aggregate(at, start, lambda s, i: F.when((i >= s["next"]) & (F.get(end, i) >= 0), taken(s, i)).otherwise(s))["cuts"]

        def text(found: Column) -> Column:
            before = lambda k: F.when(k > 0, F.get(found, F.greatest(k - 1, F.lit(0)))["j"] + 1).otherwise(0)
            lead = lambda c: F.regexp_extract(F.get(groups, c["i"]), "^[ -]?", 0)
            each = F.transform(found, lambda c, k: F.concat(joined(before(k), c["i"]), lead(c), F.lit(_CUT), span(c["i"], c["j"]), F.lit(_CUT)))
            return F.when(F.size(found) == 0, chain).otherwise(F.concat(F.array_join(each, ""), joined(before(F.size(found)), n)))

        return bound(bound(ends, cuts), text)

    return bound(F.regexp_extract_all(chain, F.lit("[ -]?[A-Z0-9]+"), F.lit(0)), of)


def _segments(t: Column) -> Column:
    """The text in pieces: valid numbers that have other groups beside them stand alone."""
    odd = t.rlike(f"[{_ESCAPE}{_CUT}]")
    swap = lambda s, *pairs: F.replace(F.replace(s, *map(F.lit, pairs[0])), *map(F.lit, pairs[1]))
    safe = F.when(odd, swap(t, (_ESCAPE, _ESCAPE + "!"), (_CUT, _ESCAPE + "?"))).otherwise(t)
    steps = F.arrays_zip(F.split(safe, _CHAIN, -1).alias("gap"), F.regexp_extract_all(safe, F.lit(_CHAIN), F.lit(0)).alias("chain"))
    marked = F.array_join(F.transform(steps, lambda x: F.concat(x["gap"], F.when(x["chain"].isNotNull(), _marked(x["chain"])).otherwise(""))), "")
    pieces = F.split(marked, _CUT, -1)
    return F.when(odd, F.transform(pieces, lambda s: swap(s, (_ESCAPE + "?", _CUT), (_ESCAPE + "!", _ESCAPE)))).otherwise(pieces)


def _email(token: Column, key: str) -> Column:
    name = F.lower(F.lpad(F.hex(_digest(key, F.lit("email"), F.lower(token))), 15, "0"))
    return F.concat(F.lit("user-"), name, F.lit("@pseudonym.invalid"))


_MAKERS = {"email": _email, "iban": _iban, "ip": _ip, "date": _date, "ssn": _ssn, "phone": _phone, "card": _card}


def pseudonym(token: Column, key: str) -> Column:
    """(kind, value) of a candidate; value is null if it isn't valid under its pattern."""
    out = F.struct(F.lit(None).cast("string").alias("kind"), F.lit(None).cast("string").alias("value"))
    for name in reversed(KINDS):
        made = F.struct(F.lit(name).alias("kind"), _MAKERS[name](token, key).alias("value"))
        out = F.when(token.rlike(f"^(?:{PATTERNS[name]})$"), made).otherwise(out)
    return out


def pseudonymise(docs: DataFrame, key: str = KEY, text: str = "text") -> DataFrame:
    """``docs`` with the text rewritten and ``pii``: array of the kinds replaced, in order."""
    rest = [c for c in docs.columns if c not in (text, "pii")]
    none = F.array().cast("array<string>")
    df = docs.select(F.struct(F.lit(0).alias("_"), *rest).alias("_row"), F.col(text).alias("_text"))
    t = F.col("_text")
    pieces = F.when(t.rlike(_LONG), _segments(t)).otherwise(F.array(t))
    df = sealed(df.select("_row", "_text", F.when(t.rlike("[0-9@]"), pieces).alias("_parts")))
    # An empty candidate after the last gap of each piece.
    found = F.when(F.col("_parts").isNotNull(), F.flatten(F.transform("_parts", lambda s: F.concat(F.regexp_extract_all(s, F.lit(CANDIDATE), F.lit(0)), F.array(F.lit("")))))).otherwise(none)
    df = df.select("_row", "_text", "_parts", found.alias("_found"))
    some = F.size("_found") > F.size("_parts")
    df = sealed(df.select("_row", "_text", "_found", F.when(some, F.transform("_found", lambda m: pseudonym(m, key))).alias("_new"), F.when(some, F.flatten(F.transform("_parts", lambda s: F.split(s, CANDIDATE, -1)))).alias("_gaps")))
    piece = lambda g, i: F.concat(g, F.coalesce(F.get(F.col("_new"), i)["value"], F.get(F.col("_found"), i), F.lit("")))
    rewritten = F.when(F.col("_gaps").isNotNull(), F.array_join(F.transform("_gaps", piece), "")).otherwise(t)
    kinds = F.coalesce(F.transform(F.filter("_new", lambda s: s["value"].isNotNull()), lambda s: s["kind"]), none)
    return df.select(*(rewritten.alias(c) if c == text else F.col("_row")[c].alias(c) for c in docs.columns if c != "pii"), kinds.alias("pii"))


def op1_pii_feistel(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return pseudonymise(docs).select("doc_id", "text", F.size("pii").cast("long").alias("n_replaced"), F.array_join("pii", ",").alias("kinds"))
