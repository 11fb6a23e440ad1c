import datetime as dt
import hashlib
import re

from pyspark.sql import functions as F

from codeseam.llm import pii

KEY = "codeseam"


def number(*parts):
    return int(hashlib.sha256("|".join(map(str, (KEY, *parts))).encode()).hexdigest()[:14], 16)


def feistel(left, right, a, b, tweak):
    for i in range(1, pii.ROUNDS + 1):
        left = (left + number(tweak, i, a, b, right) % a) % a
        right = (right + number(tweak + "'", i, a, b, left) % b) % b
    return left, right


def luhn(d):
    s = sum(sum(divmod(int(c) * (2 if k % 2 else 1), 10)) for k, c in enumerate(reversed(d)))
    return s % 10 == 0


def brute_card(d):
    body = d[1:-1]
    h = len(body) // 2
    le, r = feistel(int(body[:h]), int(body[h:]), 10**h, 10 ** (len(body) - h), "card")
    new = d[0] + str(le).zfill(h) + str(r).zfill(len(body) - h)
    return next(new + str(c) for c in range(10) if luhn(new + str(c)))


def brute_phone(area, office, line):
    le, r = feistel((area - 200) * 800 + office - 200, line, 640000, 10000, "phone")
    return le // 800 + 200, le % 800 + 200, r


def brute_date(d):
    first, a, b = max(x for x in pii.DATES if x[0] <= d.isoformat())
    start = dt.date.fromisoformat(first)
    n = (d - start).days
    le, r = feistel(n // b, n % b, a, b, "date" if first[0] == "1" else "date" + first[:4])
    return start + dt.timedelta(days=le * b + r)


def brute_ssn(s):
    area, group, serial = map(int, s.split("-"))
    at = area - 1 - (area > 666)
    le, r = feistel(at * 99 + group - 1, serial - 1, 898 * 99, 9999, "ssn")
    a = le // 99
    return f"{a + 1 + (a >= 665):03d}-{le % 99 + 1:02d}-{r + 1:04d}"


def brute_characters(left, right, tweak):
    def shifted(s, other, i, side):
        noise = "".join(hashlib.sha512(f"{KEY}|{tweak}{side}{j}|{i}|{other}".encode()).hexdigest() for j in range(2))
        out = ""
        for at, c in enumerate(s):
            by = int(noise[(at * 2) % 250 :][:5], 16) + at
            base, n = (48, 10) if c in "0123456789" else (97, 26) if "a" <= c <= "z" else (65, 26) if "A" <= c <= "Z" else (0, 0)
            out += chr((ord(c) - base + by) % n + base) if n else c
        return out

    for i in range(1, 5):
        left = shifted(left, right, i, "l")
        right = shifted(right, left, i, "r")
    return left, right


def brute_email(s):
    name, host = s.split("@")
    domain, _, last = host.rpartition(".")
    a, b = brute_characters(name, domain, "email")
    return f"{a}@{b}.{last}"


def brute_iban(s):
    body, land = s[4:], s[:2]
    a, b = brute_characters(body[: len(body) // 2], body[len(body) // 2 :], "iban")
    value = int("".join(str(int(c, 36)) for c in a + b + land + "00"))
    return f"{land}{98 - value % 97:02d}{a}{b}"


def brute_ip(s):
    a, b, c, d = map(int, s.split("."))
    le, r = feistel(a * 256 + b, c * 256 + d, 65536, 65536, "ip")
    return f"{le >> 8}.{le & 255}.{r >> 8}.{r & 255}"


def one(spark, *values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "doc_id long, text string")
    return [r.text for r in pii.pseudonymise(df, KEY, counts=True).orderBy("doc_id").collect()]


def test_against_brute_force(spark):
    card = "4571475004921503"
    spaced = "4571 4750 0492 1503"
    got = one(spark, f"a {card} b", f"c {spaced}, {card}.", "call +1 (718) 555-1498 or 718-555-1498 now", "born 1987-03-12 (12.03.1987, 12/03/1987)", "at 42.144.35.254 ok", "SSN 123-45-6789")
    new = brute_card(card)
    assert got[0] == f"a {new} b" and luhn(new) and new != card
    assert got[1] == f"c {' '.join(new[i:i+4] for i in range(0, 16, 4))}, {new}."
    a, o, n = brute_phone(718, 555, 1498)
    assert got[2] == f"call +1 ({a}) {o}-{n:04d} or {a}-{o}-{n:04d} now"
    d = brute_date(dt.date(1987, 3, 12))
    assert got[3] == f"born {d:%Y-%m-%d} ({d:%d.%m.%Y}, {d:%d/%m/%Y})"
    assert got[4] == f"at {brute_ip('42.144.35.254')} ok"
    assert got[5] == f"SSN {brute_ssn('123-45-6789')}"


def test_emails_and_ibans_keep_form_and_link(spark):
    mail, iban = "bosbt.42@mail8.example.com", "DE89 3704 0044 0532 0130 00"
    got = one(spark, f"x {mail} y", f"{mail}", f"pay {iban} or DE89370400440532013000")
    assert mail not in got[0] and got[0] == f"x {got[1]} y"
    assert re.fullmatch(r"[a-z]{5}\.\d\d@[a-z]{4}\d\.[a-z]{7}\.com", got[1]) and got[1] == brute_email(mail)
    a, b = re.fullmatch(r"pay (DE\d\d(?: \d{4}){4} \d\d) or (DE\d{20})", got[2]).groups()
    assert a.replace(" ", "") == b == brute_iban("DE89370400440532013000")
    assert int("".join(str(int(c, 36)) for c in b[4:] + b[:4])) % 97 == 1


def test_invalid_and_clean_texts_stay(spark):
    texts = [None, "", "no data here", "4571475004921504", "300.1.2.3 and 1.2.3.4.5", "1987-13-41", "000-12-3456", "year 2024, 3.14, 10:30", "hash 48160bb3fce0c31ad44167de7d05e47a1227f75a", "DE88370400440532013000"]
    assert one(spark, *texts) == texts


def test_permutations(spark):
    df = spark.range(1000).select(F.lpad(F.col("id").cast("string"), 3, "0").alias("d"))
    got = {r.x for r in df.select(pii.digits_permuted(F.col("d"), F.lit("k"), "t").alias("x")).collect()}
    assert len(got) == 1000 and all(len(x) == 3 for x in got)
    days = spark.range(73049).select(F.date_add(F.lit("1900-01-01").cast("date"), F.col("id").cast("int")).cast("string").alias("d"))
    assert days.select(pii._date(F.col("d"), F.lit("k")).alias("x")).distinct().count() == 73049


def test_dates_of_all_years(spark):
    days = ["0001-01-01", "1066-10-14", "1899-12-31", "1900-01-01", "2099-12-31", "2100-01-01", "9999-12-31"]
    assert one(spark, *[f"on {d}." for d in days]) == [f"on {brute_date(dt.date.fromisoformat(d)).isoformat()}." for d in days]
    old = spark.range(0, 693595, 7).select(F.date_format(F.date_add(F.lit("0001-01-01").cast("date"), F.col("id").cast("int")), "yyyy-MM-dd").alias("d"))
    new = old.select(pii._date(F.col("d"), F.lit("k")).alias("x"))
    assert new.filter("x IS NULL OR x >= '1900'").count() == 0 and new.distinct().count() == old.count()


def test_key_of_the_session(spark, make_docs):
    docs = make_docs(["4571475004921503"])
    spark.conf.unset(pii.SETTING)
    text = lambda: pii.op6(docs).first().text
    first = text()
    assert first == text() != "4571475004921503" and len(spark.conf.get(pii.SETTING)) == 64
    spark.conf.set(pii.SETTING, KEY)
    assert text() == brute_card("4571475004921503")
    spark.conf.unset(pii.SETTING)
    assert text() not in (first, brute_card("4571475004921503"))


def test_columns_of_our_names_stay(spark, make_docs):
    docs = make_docs(["4571475004921503", None, ""]).withColumn("__pii", F.lit("mine"))
    out = pii.pseudonymise(docs)
    assert out.dtypes == docs.dtypes and {r["__pii"] for r in out.collect()} == {"mine"}


def test_tables(spark, make_docs, sample):
    docs = make_docs([("x 4571475004921503 ").strip() * 300, None], extra=True)
    out = pii.pseudonymise(docs)
    assert out.columns == docs.columns and out.filter("doc_id = 0").first().n_chars == len(docs.first().text)
    assert pii.op6(make_docs([])).count() == 0
    before = {r.doc_id: r.text for r in sample.collect()}
    kinds = [f"pii_{k}" for k in pii.PATTERNS]
    changed = 0
    for r in pii.op6(sample).collect():
        n = sum(r[k] for k in kinds)
        assert (n > 0) == (r.text != before[r.doc_id])
        changed += n
    assert changed


def test_phones_of_any_area(spark):
    texts = ["call +1 (017) 555-7713 now", "+1-017-555-7713, +10175557713", "+1 (718) 055-1498", "+1 (000) 000-0000", "+1 (017) 555-7713 20245 ok"]
    got = one(spark, *texts)
    le, r = feistel(17 * 1000 + 555, 7713, 360000, 10000, "phone0")
    pair = le if le < 200000 else ((le - 200000) // 200 + 200) * 1000 + (le - 200000) % 200
    a, o = divmod(pair, 1000)
    assert (a, o, r) != (17, 555, 7713)
    assert got[0] == f"call +1 ({a:03d}) {o:03d}-{r:04d} now"
    assert got[1] == f"+1-{a:03d}-{o:03d}-{r:04d}, +1{a:03d}{o:03d}{r:04d}"
    assert all(re.fullmatch(r"\+1 \(\d{3}\) \d{3}-\d{4}", x) and x != y for x, y in zip(got[2:4], texts[2:4]))
    assert got[4] == f"+1 ({a:03d}) {o:03d}-{r:04d} 20245 ok"
    numbers = spark.range(0, 1000, 7).crossJoin(spark.range(0, 1000, 31).withColumnRenamed("id", "o"))
    said = F.concat(F.lit("+1 ("), F.lpad(F.col("id").cast("string"), 3, "0"), F.lit(") "), F.lpad(F.col("o").cast("string"), 3, "0"), F.lit("-0042"))
    new = numbers.select(said.alias("s")).select("s", pii._phone(F.col("s"), F.lit("k")).alias("x"))
    assert new.filter("x IS NULL OR x = s").count() == 0 and new.select("x").distinct().count() == numbers.count()


def test_ibans_before_codes_and_numbers(spark):
    ibans = ["BE68539007547034", "AT611904300234573201", "ES91 2100 0418 4502 0005 1332", "XX02 2100 0418 4502 0005 1332", "NO9386011117947"]
    after = [" EUR 100", " USD", " 42", " EUR 7", " NOK 5"]
    got = one(spark, *[f"to {i}{a}." for i, a in zip(ibans, after)], *[f"to {i} paid" for i in ibans])
    for k, (i, a) in enumerate(zip(ibans, after)):
        new = got[k].removeprefix("to ").removesuffix(f"{a}.")
        flat = new.replace(" ", "")
        assert new != i and len(new) == len(i) and new[:2] == i[:2] and got[k] == f"to {new}{a}." and got[k + 5] == f"to {new} paid"
        assert int("".join(str(int(c, 36)) for c in flat[4:] + flat[:4])) % 97 == 1
