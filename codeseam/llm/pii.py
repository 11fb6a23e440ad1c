"""Format-preserving Feistel pseudonyms for personal data, DataFrame functions only.

Candidates are found by one pattern; each is validated (check digits, octets,
calendar, area rules) and, if valid, replaced by a keyed permutation of itself
within its format.  The permutation is a Feistel network on two halves (L, R) of
the value: L += F(R), R += F(L), modulo the halves' sizes, F a keyed SHA-256; so
it is a bijection on the format, and equal values get equal pseudonyms in every
document, whatever their separators.  Check digits are made anew.  Numbers of the
form +1 whose area or office is below 200 are permuted among themselves, and so
are dates before 1900 and from 2100 on.

The permutation's key is the caller's, or the setting ``spark.codeseam.pii.key``;
where neither is given a random one is drawn for the session, so pseudonyms link
documents of one session and nobody can invert them later.  The key is a literal
of the plan: where plans are logged, have ``spark.sql.redaction.string.regex`` hide it.

Row local: one scan, no shuffle, no Python.
"""

from __future__ import annotations

import secrets

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codeseam.llm.shared import fresh_names

ROUNDS = 8
SETTING = "spark.codeseam.pii.key"

#: characters of an IBAN by country
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
    23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM",
    28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}


def _iban_pattern() -> str:
    """By the country's length, so that what follows isn't taken; any length for
    others, and where the country's doesn't fit."""
    group = r"(?:\x20?[A-Z0-9]{4})"
    tail = lambda n: rf"\x20?[A-Z0-9]{{{n}}}" if n else ""
    known = "|".join(f"(?:{lands.replace(' ', '|')})[0-9]{{2}}{group}{{{n // 4 - 1}}}{tail(n % 4)}" for n, lands in IBAN_LENGTHS.items())
    return rf"(?<![A-Za-z0-9])(?=[A-Z]{{2}}[0-9]{{2}})(?:(?:{known})(?![A-Za-z0-9])|[A-Z]{{2}}[0-9]{{2}}{group}{{2,7}}(?:\x20?[A-Z0-9]{{1,3}})?(?![A-Za-z0-9]))"


#: kind -> pattern, in the order in which they are tried at a place
PATTERNS = {
    "email": r"[A-Za-z0-9][A-Za-z0-9._%+-]*@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}",
    "iban": _iban_pattern(),
    "date": r"(?<![\w.-])[0-9]{4}-[0-9]{2}-[0-9]{2}(?![\w-])|(?<![\w./-])[0-9]{2}[./][0-9]{2}[./][0-9]{4}(?![\w/-])",
    "ip": r"(?<![\w.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?!\.?[\w])",
    "ssn": r"(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-])",
    "phone": r"(?<![\w+])(?:\+?1[\x20.-]?)?(?:\([2-9][0-9]{2}\)\x20?|[2-9][0-9]{2}[\x20.-])[2-9][0-9]{2}[\x20.-][0-9]{4}(?![\w])"
    r"|(?<![\w+])\+1[\x20.-]?(?:\([0-9]{3}\)[\x20.-]?|[0-9]{3}[\x20.-]?)[0-9]{3}[\x20.-]?[0-9]{4}(?![\w])"
    r"|(?<![\w+])\+[1-9][0-9]{0,2}(?:[\x20.-]?\(?[0-9]{2,5}\)?){2,5}(?![\w])",
    "card": r"(?<![\w-])(?:[0-9]{4}[\x20-][0-9]{4}[\x20-][0-9]{4}[\x20-][0-9]{1,7}|[0-9]{4}[\x20-][0-9]{6}[\x20-][0-9]{5}|[0-9]{13,19})(?![\w])",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())


def _number(key: Column, *parts: Column) -> Column:
    """A keyed 56-bit number of the parts."""
    said = F.concat_ws("|", key, *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.sha2(said.cast("binary"), 256), 1, 14), 16, 10).cast("long")


def feistel(left: Column, right: Column, a: Column, b: Column, key: Column, tweak: str) -> Column:
    """struct(l, r): (left, right) permuted on Z_a x Z_b."""

    def step(acc: Column, i: Column) -> Column:
        le = F.pmod(acc["l"] + F.pmod(_number(key, F.lit(tweak), i, a, b, acc["r"]), a), a)
        both = F.struct(le.alias("l"), acc["r"].alias("r"))
        # a second lambda level names the new half, so that it is made once
        return F.transform(
            F.array(both), lambda x: F.struct(x["l"].alias("l"), F.pmod(x["r"] + F.pmod(_number(key, F.lit(tweak + "'"), i, a, b, x["l"]), b), b).alias("r"))
        )[0]

    start = F.struct(left.cast("long").alias("l"), right.cast("long").alias("r"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, step)


def _let(value: Column, f) -> Column:
    """f(value) with the value made once, as a lambda variable."""
    return F.transform(F.array(value), f)[0]


def _power(digits: Column) -> Column:
    return F.pow(F.lit(10.0), digits).cast("long")


def digits_permuted(d: Column, key: Column, tweak: str) -> Column:
    """A digit string of up to 34 digits, permuted among those of its length."""
    half = F.floor(F.length(d) / 2).cast("int")

    def go(x: Column) -> Column:
        h, n = F.floor(F.length(x) / 2).cast("int"), F.length(x)
        two = feistel(F.substring(x, F.lit(1), h).cast("long"), F.substring(x, h + 1, n - h).cast("long"), _power(h), _power(n - h), key, tweak)
        return _let(two, lambda t: F.concat(F.lpad(t["l"].cast("string"), h, "0"), F.lpad(t["r"].cast("string"), n - h, "0")))

    return F.when(half >= 1, _let(d, go)).otherwise(d)


def luhn_sum(d: Column) -> Column:
    """Luhn's sum of a digit string, the last digit not doubled."""
    return F.aggregate(
        F.split(d, ""),
        F.struct(F.lit(0).alias("s"), F.length(d).alias("k")),
        lambda a, c: F.struct(
            (a["s"] + F.when(a["k"] % 2 == 0, 2 * c.cast("int") - F.when(c.cast("int") > 4, 9).otherwise(0)).otherwise(c.cast("int"))).alias("s"),
            (a["k"] - 1).alias("k"),
        ),
        lambda a: a["s"],
    )


def _mod97(s: Column) -> Column:
    """An IBAN in check order (letters count 10 to 35) modulo 97."""
    return F.aggregate(
        F.split(s, ""),
        F.lit(0),
        lambda a, c: F.when(c.rlike("[0-9]"), (a * 10 + F.ascii(c) - 48) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97),
    )


def characters_permuted(left: Column, right: Column, key: Column, tweak: str) -> Column:
    """struct(l, r): two strings whose letters and digits are shifted, each within
    its class, by keyed numbers of the other string; other characters stay."""

    def shifted(s: Column, other: Column, i: Column, side: str) -> Column:
        noise = F.concat(*[F.sha2(F.concat_ws("|", key, F.lit(f"{tweak}{side}{j}"), i.cast("string"), other).cast("binary"), 512) for j in range(2)])

        def chars(bits: Column) -> Column:
            def one(c: Column, at: Column) -> Column:
                by = F.conv(F.substring(bits, (at * 2) % 250 + 1, F.lit(5)), 16, 10).cast("int") + at
                move = lambda base, n: F.char(F.pmod(F.ascii(c) - base + by, F.lit(n)) + base)
                return F.when(c.rlike("^[0-9]$"), move(48, 10)).when(c.rlike("^[a-z]$"), move(97, 26)).when(c.rlike("^[A-Z]$"), move(65, 26)).otherwise(c)

            return F.array_join(F.transform(F.split(s, ""), one), "")

        return _let(noise, chars)

    def step(acc: Column, i: Column) -> Column:
        first = F.struct(shifted(acc["l"], acc["r"], i, "l").alias("l"), acc["r"].alias("r"))
        return _let(first, lambda x: F.struct(x["l"].alias("l"), shifted(x["r"], x["l"], i, "r").alias("r")))

    return F.aggregate(F.sequence(F.lit(1), F.lit(4)), F.struct(left.alias("l"), right.alias("r")), step)


def _into(form: Column, digits: Column) -> Column:
    """The digits put in the places of the digits of ``form``."""
    return F.aggregate(
        F.split(form, ""),
        F.struct(F.lit("").alias("out"), F.lit(1).alias("k")),
        lambda a, c: F.when(
            c.rlike("[0-9]"), F.struct(F.concat(a["out"], F.substring(digits, a["k"], F.lit(1))).alias("out"), (a["k"] + 1).alias("k"))
        ).otherwise(F.struct(F.concat(a["out"], c).alias("out"), a["k"].alias("k"))),
        lambda a: a["out"],
    )


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def _part(s: Column, at: int, n: int) -> Column:
    return F.substring(s, at, n).cast("long")


def _email(s: Column, key: Column) -> Column:
    at = F.instr(s, F.lit("@"))
    host = F.substring(s, at + 1, F.length(s))
    last = F.regexp_extract(host, r"\.[A-Za-z]+$", 0)
    name = F.substring(host, F.lit(1), F.length(host) - F.length(last))
    return _let(characters_permuted(F.substring(s, F.lit(1), at - 1), name, key, "email"), lambda t: F.concat(t["l"], F.lit("@"), t["r"], last))


def _iban(s: Column, key: Column) -> Column:
    """The longest beginning of s, up to a space or the end, that is valid is
    replaced; what follows it stays."""
    flat_of = lambda x: F.replace(x, F.lit(" "), F.lit(""))

    def valid(x: Column) -> Column:
        return _let(flat_of(x), lambda flat: (F.length(flat) >= 12) & (_mod97(F.concat(F.substring(flat, F.lit(5), F.length(flat)), F.substring(flat, 1, 4))) == 1))

    def go(old: Column) -> Column:
        flat = flat_of(old)
        body = F.substring(flat, F.lit(5), F.length(flat))
        half = F.floor(F.length(body) / 2).cast("int")
        two = characters_permuted(F.substring(body, F.lit(1), half), F.substring(body, half + 1, F.length(body)), key, "iban")
        land = F.substring(flat, 1, 2)
        new = _let(
            two,
            lambda t: F.concat(land, F.lpad((98 - _mod97(F.concat(t["l"], t["r"], land, F.lit("00")))).cast("string"), 2, "0"), t["l"], t["r"]),
        )
        spaced = F.when(F.contains(old, F.lit(" ")), F.rtrim(F.regexp_replace(new, "(.{4})", "$1 "))).otherwise(new)
        return F.when(old.isNotNull(), F.concat(spaced, F.substring(s, F.length(old) + 1, F.length(s))))

    ends = F.filter(F.sequence(F.greatest(F.length(s), F.lit(12)), F.lit(12), F.lit(-1)), lambda k: F.substring(F.concat(s, F.lit(" ")), k + 1, F.lit(1)) == " ")
    starts = F.filter(F.transform(ends, lambda k: F.substring(s, F.lit(1), k)), valid)
    return _let(F.get(starts, F.lit(0)), go)


#: first day and the two factors of the number of days of each range of dates
DATES = (("0001-01-01", 931, 745), ("1900-01-01", 17, 4297), ("2100-01-01", 195, 14797))


def _date(s: Column, key: Column) -> Column:
    iso = F.substring(s, 5, 1) == "-"
    said = F.when(iso, s).otherwise(F.concat(F.substring(s, 7, 4), F.lit("-"), F.substring(s, 4, 2), F.lit("-"), F.substring(s, 1, 2)))
    # a date of month/day order is read as such where day/month is none
    swapped = F.concat(F.substring(s, 7, 4), F.lit("-"), F.substring(s, 1, 2), F.lit("-"), F.substring(s, 4, 2))
    day = lambda x: F.try_to_timestamp(x, F.lit("yyyy-MM-dd")).cast("date")
    us = ~iso & day(said).isNull()
    d = F.coalesce(day(said), F.when(~iso, day(swapped)))
    sep = F.substring(s, 3, 1)

    def said_anew(new: Column) -> Column:
        y, m, dd = (F.date_format(new, f) for f in ("yyyy", "MM", "dd"))
        return F.when(iso, F.concat_ws("-", y, m, dd)).when(us, F.concat(m, sep, dd, sep, y)).otherwise(F.concat(dd, sep, m, sep, y))

    def moved(d: Column) -> Column:
        out = F.lit(None).cast("date")
        for first, a, b in DATES:
            start = F.lit(first).cast("date")
            n = F.datediff(d, start)
            two = feistel(F.floor(n / b), n % b, F.lit(a), F.lit(b), key, "date" if first[0] == "1" else f"date{first[:4]}")
            out = F.when((n >= 0) & (n < a * b), _let(two, lambda t: F.date_add(start, (t["l"] * b + t["r"]).cast("int")))).otherwise(out)
        return out

    return _let(d, lambda d: F.when(d.isNotNull(), _let(moved(d), said_anew)))


def _ip(s: Column, key: Column) -> Column:
    def go(o: Column) -> Column:
        n = [F.get(o, F.lit(i)).cast("int") for i in range(4)]
        valid = F.forall(o, lambda x: (x.cast("int") < 256) & ((F.length(x) == 1) | ~x.startswith("0")))
        two = feistel(n[0] * 256 + n[1], n[2] * 256 + n[3], F.lit(65536), F.lit(65536), key, "ip")
        return F.when(valid, _let(two, lambda t: F.concat_ws(".", *[x.cast("string") for h in "lr" for x in (F.shiftright(t[h], 8), t[h] % 256)])))

    return _let(F.split(s, r"\."), go)


def _ssn(s: Column, key: Column) -> Column:
    area, group, serial = _part(s, 1, 3), _part(s, 5, 2), _part(s, 8, 4)
    valid = (area > 0) & (area != 666) & (area < 900) & (group > 0) & (serial > 0)
    # areas 1 .. 899 without 666: 898
    at = area - 1 - F.when(area > 666, 1).otherwise(0)
    two = feistel(at * 99 + group - 1, serial - 1, F.lit(898 * 99), F.lit(9999), key, "ssn")

    def said(t: Column) -> Column:
        a = F.floor(t["l"] / 99)
        a = a + 1 + F.when(a >= 665, 1).otherwise(0)
        pad = lambda x, n: F.lpad(x.cast("string"), n, "0")
        return F.concat_ws("-", pad(a, 3), pad(t["l"] % 99 + 1, 2), pad(t["r"] + 1, 4))

    return F.when(valid, _let(two, said))


def _phone(s: Column, key: Column) -> Column:
    def go(d: Column) -> Column:
        land = F.substring(d, F.lit(1), F.length(d) - 10)
        ten = F.substring(d, F.length(d) - 9, F.lit(10))
        national = ((F.length(d) == 10) & ~s.startswith("+")) | ((F.length(d) == 11) & d.startswith("1"))
        area, office, line = _part(ten, 1, 3), _part(ten, 4, 3), _part(ten, 7, 4)
        assigned = (area >= 200) & (office >= 200)
        # areas and offices are 200 .. 999
        two = feistel((area - 200) * 800 + office - 200, line, F.lit(640000), F.lit(10000), key, "phone")
        new = _let(
            two,
            lambda t: F.concat(land, (F.floor(t["l"] / 800) + 200).cast("string"), (t["l"] % 800 + 200).cast("string"), F.lpad(t["r"].cast("string"), 4, "0")),
        )
        # the 360000 other pairs: any office below area 200, offices below 200 above;
        # among themselves, so that no two numbers get one pseudonym
        other = F.when(area < 200, area * 1000 + office).otherwise(200000 + (area - 200) * 200 + office)

        def unassigned(t: Column) -> Column:
            low, k = t["l"] < 200000, t["l"] - 200000
            pair = F.when(low, t["l"]).otherwise((F.floor(k / 200) + 200) * 1000 + F.pmod(k, F.lit(200)))
            return F.concat(land, F.lpad(pair.cast("string"), 6, "0"), F.lpad(t["r"].cast("string"), 4, "0"))

        rest = _let(feistel(other, line, F.lit(360000), F.lit(10000), key, "phone0"), unassigned)
        abroad = F.concat(F.substring(d, 1, 2), digits_permuted(F.substring(d, F.lit(3), F.length(d)), key, "phone+"))
        return (
            F.when(national & assigned, _into(s, new))
            .when(national, _into(s, rest))
            .when(~national & F.length(d).between(8, 15) & s.startswith("+"), _into(s, abroad))
        )

    return _let(_digits(s), go)


def _card(s: Column, key: Column) -> Column:
    def go(d: Column) -> Column:
        valid = F.length(d).between(13, 19) & (luhn_sum(d) % 10 == 0) & d.rlike("^[2-6]")
        body = F.concat(F.substring(d, 1, 1), digits_permuted(F.substring(d, F.lit(2), F.length(d) - 2), key, "card"))
        new = _let(body, lambda b: F.concat(b, F.pmod(-luhn_sum(F.concat(b, F.lit("0"))), F.lit(10)).cast("string")))
        return F.when(valid, _into(s, new))

    return _let(_digits(s), go)


_FORMS = {"email": _email, "iban": _iban, "date": _date, "ip": _ip, "ssn": _ssn, "phone": _phone, "card": _card}


def pseudonym(s: Column, key: Column) -> Column:
    """struct(kind, new) of one candidate; new is null where it isn't valid."""
    kind = F.lit(None).cast("string")
    for k in reversed(PATTERNS):
        kind = F.when(s.rlike(f"^(?:{PATTERNS[k]})$"), k).otherwise(kind)

    def made(kind: Column) -> Column:
        new = F.lit(None).cast("string")
        for k in _FORMS:
            new = F.when(kind == k, _FORMS[k](s, key)).otherwise(new)
        return F.struct(kind.alias("kind"), new.alias("new"))

    return _let(kind, made)


def session_key(spark: SparkSession) -> str:
    """The key as configured, else one drawn for this session."""
    key = spark.conf.get(SETTING, None)
    if not key:
        key = secrets.token_hex(32)
        spark.conf.set(SETTING, key)
    return key


def pseudonymise(docs: DataFrame, key: str | None = None, text: str = "text", counts: bool = False) -> DataFrame:
    """``docs`` with the text's personal data replaced; all other columns stay,
    but n_chars, where there is one, follows the text.  counts: adds pii_<kind>,
    replaced values by kind (a column of that name is replaced).

    Null texts stay null, empty ones empty; repeated rows get equal texts; an empty
    table gives an empty one.  ``key``: see above.
    """
    t = F.col(f"`{text}`")
    hits, gaps = F.regexp_extract_all(t, F.lit(ANY), F.lit(0)), F.split(t, ANY, -1)
    secret = F.lit(key or session_key(docs.sparkSession))
    own = fresh_names(docs, "pii")[0]
    hit = F.col(own)
    found = _let(hits, lambda hs: F.when(F.size(hs) > 0, F.transform(hs, lambda s: F.struct(s.alias("old"), pseudonym(s, secret).alias("p")))))
    df = docs.withColumn(own, found)
    parts = F.zip_with(gaps, hit, lambda g, h: F.concat(g, F.coalesce(h["p"]["new"], h["old"], F.lit(""))))
    out = {text: F.when(hit.isNotNull(), F.array_join(parts, "")).otherwise(t)}
    if counts:
        n = lambda k: F.size(F.filter(hit, lambda h: (h["p"]["kind"] == k) & h["p"]["new"].isNotNull()))
        out |= {f"pii_{k}": F.coalesce(F.when(hit.isNotNull(), n(k)), F.lit(0)).cast("long") for k in PATTERNS}
    df = df.withColumns(out).drop(own)
    if "n_chars" in docs.columns:
        df = df.withColumn("n_chars", F.length(t).cast(docs.schema["n_chars"].dataType))
    return df


def op6(docs: DataFrame) -> DataFrame:
    """doc_id, the pseudonymised text and the replaced values by kind, a row a
    document: null texts stay null, null ids stay null, other columns are ignored."""
    return pseudonymise(docs.select("doc_id", "text"), counts=True)
