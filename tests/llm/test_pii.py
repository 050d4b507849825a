import datetime
import hashlib
import random
import re

from lodeseek.llm import pii as op

KEY = "k1"


def feistel(left, right, a, b, kind):
    for i in range(op.ROUNDS):
        f = lambda x: int(hashlib.sha256("|".join(map(str, [KEY, kind, a, b, i, x])).encode()).hexdigest()[:15], 16)  # noqa: E731, B023
        if i % 2:
            right = (right + f(left) % b) % b
        else:
            left = (left + f(right) % a) % a
    return left, right


def digits_of(x, n, base=10):
    out = ""
    for _ in range(n):
        x, d = divmod(x, base)
        out = "0123456789abcdefghijklmnopqrstuvwxyz"[d] + out
    return out


def permuted(s, kind, base=10):
    h = len(s) // 2
    left, right = feistel(int(s[:h], base), int(s[h:], base), base**h, base ** (len(s) - h), kind)
    return digits_of(left, h, base) + digits_of(right, len(s) - h, base)


def luhn(s):
    return sum(int(c) if i % 2 == 0 else (2 * int(c) - 9 * (int(c) > 4)) for i, c in enumerate(reversed(s))) % 10


def refill(form, new, kept="0-9"):
    new = iter(new)
    return re.sub(f"[{kept}]", lambda _: next(new), form)


def card(number):
    body = permuted(re.sub("[ -]", "", number)[:-1], "card")
    return refill(number, body + str(-luhn(body + "0") % 10))


def valid_card(rng, n=16):
    body = "".join(rng.choice("0123456789") for _ in range(n - 1))
    return body + str(-luhn(body + "0") % 10)


def test_equals_brute_force(spark):
    rng = random.Random(3)
    cases = []
    for n in (13, 16, 19):
        number = valid_card(rng, n)
        cases += [(number, card(number)), (number[:4] + "-" + number[4:], card(number[:4] + "-" + number[4:])), (number[:-1] + str((int(number[-1]) + 1) % 10), None)]
    left, right = feistel(192 * 256 + 168, 1 * 256 + 77, 65536, 65536, "ip")
    cases += [("192.168.1.77", f"{left >> 8}.{left & 255}.{right >> 8}.{right & 255}"), ("256.1.1.1", None), ("1.2.3.4.5", None)]
    day = (datetime.date(2024, 2, 29) - datetime.date(1900, 1, 1)).days
    left, right = feistel(day // 4297, day % 4297, 17, 4297, "date")
    made = datetime.date(1900, 1, 1) + datetime.timedelta(days=left * 4297 + right)
    cases += [("2024-02-29", made.isoformat()), ("29.02.2024", made.strftime("%d.%m.%Y")), ("29/02/2024", made.strftime("%d/%m/%Y")), ("2023-02-29", None)]
    left, right = feistel(700 - 2, 44 * 9999 + 6788, 898, 99 * 9999, "ssn")
    cases += [("700-45-6789", f"{left + 1 + (left >= 665):03}-{right // 9999 + 1:02}-{right % 9999 + 1:04}"), ("666-45-6789", None), ("700-00-6789", None)]
    cases += [("+1 (234) 555-0199", "+1" + refill(" (234) 555-0199", permuted("2345550199", "phone"))), ("234-555-0199", refill("234-555-0199", permuted("2345550199", "phone")))]
    cases += [("Jo.Doe7@mail.example.com", refill("Jo.Doe7", permuted("jodoe7", "email", 36), "A-Za-z0-9") + "@mail.example.com"), ("a@x.org", None)]
    rows = [(i, f"é {value}, and {value}! 12 3.5 ", 9) for i, (value, _) in enumerate(cases)] + [(98, None, 9), (99, "", 9), (97, "no numbers " * 20_000, 9), (97, cases[0][0], 9), (97, cases[0][0], 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_pseudonyms int")
    got = op.pseudonymise(docs, KEY)
    assert got.columns == docs.columns
    got = got.collect()
    for r in got:
        if r.doc_id < len(cases):
            value, new = cases[r.doc_id]
            assert r.text == f"é {new or value}, and {new or value}! 12 3.5 ", (value, new)
            assert r.n_pseudonyms == (2 if new and new != value else 0)
    assert sorted(str(r.text)[:30] for r in got if r.doc_id >= 97) == sorted([cases[0][1], cases[0][1], "None", "", ("no numbers " * 3)[:30]])


def test_long_names_and_permutation(spark):
    from pyspark.sql import functions as F

    name = "a1" * 20
    docs = spark.createDataFrame([(1, f"{name}@b.org")], "doc_id long, text string")
    text = op.pseudonymise(docs, KEY).first().text
    assert re.fullmatch("[a-z0-9]{40}@b.org", text) and text != f"{name}@b.org"
    pairs = spark.range(17 * 43).select(op.feistel(F.floor(F.col("id") / 43), F.pmod("id", F.lit(43)), F.lit(17), F.lit(43), KEY, "t").alias("p")).distinct()
    assert pairs.count() == 17 * 43 and pairs.filter("p.l between 0 and 16 and p.r between 0 and 42").count() == 17 * 43
    assert op.pseudonymise(docs.limit(0), KEY).count() == 0


def test_query_finds_common_forms(spark, tmp_path):
    from lodeseek.llm.queries import op3_pii

    shapes = {
        "3/14/2019": "%m/%d/%Y", "1.5.2020": "%d.%m.%Y", "14/3/2019": "%d/%m/%Y", "2019/03/14": "%Y/%m/%d", "2019/3/4": "%Y/%m/%d",
        "555 123 4567": "[0-9]{3} [0-9]{3} [0-9]{4}", "(555)123-4567": r"\([0-9]{3}\)[0-9]{3}-[0-9]{4}", "5551234567": "[0-9]{10}", "555-1234567": "[0-9]{3}-[0-9]{7}",
        "j@site.org": "[a-z0-9]@site.org", "k@site.org": "[a-z0-9]@site.org",
    }
    same = ["3/34/2019", "13.13.2020", "2019/13/14", "0.5551234567", "1612345678", "12345678901", "5551234567.25"]
    rows = [(i, f"on {value}, or {value}; 7") for i, value in enumerate([*shapes, *same])]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in op3_pii(spark, str(tmp_path)).collect()}
    for i, (value, shape) in enumerate(shapes.items()):
        new = re.fullmatch(r"on (.+), or \1; 7", got[i].text)[1]
        assert new != value and got[i].n_pseudonyms == 2, value
        assert datetime.datetime.strptime(new, shape) if "%" in shape else re.fullmatch(shape, new), (value, new)
    for i, value in enumerate(same, len(shapes)):
        assert got[i].text == rows[i][1] and got[i].n_pseudonyms == 0, value
    assert got[list(shapes).index("j@site.org")].text != got[list(shapes).index("k@site.org")].text


def test_every_slash_date_has_its_own_pseudonym(spark):
    from pyspark.sql import functions as F

    texts = spark.sql("SELECT lpad(a, 2, '0') || '/' || lpad(b, 2, '0') || '/' || y AS text FROM (SELECT explode(sequence(1, 31)) a), (SELECT explode(sequence(1, 31)) b), (SELECT explode(sequence(1900, 2099)) y)")
    texts = texts.repartition(8).filter(F.try_to_timestamp("text", F.lit("dd/MM/yyyy")).isNotNull() | F.try_to_timestamp("text", F.lit("MM/dd/yyyy")).isNotNull())
    made = op.pseudonymise(texts, KEY).agg(F.count("*").alias("n"), F.count_distinct("text").alias("d"), F.sum("n_pseudonyms").alias("p"), F.min(F.length("text")).alias("a"), F.max(F.length("text")).alias("b")).first()
    assert (made.n, made.d, made.a, made.b) == (117_298, 117_298, 10, 10) and made.p > 117_000


def test_numbers_that_are_equal_stay_linked(spark):
    rows = ["+44 20 7946 0958", "+442079460958", "+44-20-7946-0958", "+351 912 345 678", "+351912345678", "+1 555 123 4567", "(555) 123-4567"]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id int, text string")
    got = [re.sub("[^0-9+]", "", r.text) for r in op.pseudonymise(docs, KEY).orderBy("doc_id").collect()]
    assert got[0] == got[1] == got[2] != "+442079460958" and got[0].startswith("+44") and got[3] == got[4] and got[3].startswith("+351")
    assert got[5] == "+1" + got[6]


def test_long_unbroken_texts_and_clashing_names(spark):
    import time

    parts = ["a", ".", "7", "-", "@", "a@", "a@b.", "1.", "+1", "(5", "a.", "x@y.z-", "%+", "1-2", "9  ", "bb@cc.dd "]
    rows = [(i, x * ((9_000 if i == 15 else 1_000_000) // len(x)), 1, 2, 3) for i, x in enumerate(parts)] + [(90, "a@" + "b." * 8000, 1, 2, 3), (91, "a@" + "bb." * 8000 + "org", 1, 2, 3), (92, "x" * 70 + "@site.org.5", 1, 2, 3)]
    docs = spark.createDataFrame(rows, "doc_id int, text string, `__t` int, `___hit` int, `a.b` int").repartition(8)
    began = time.time()
    got = {r.doc_id: r for r in op.pseudonymise(docs, KEY, one=True).collect()}
    assert time.time() - began < 120
    assert got[0].text == rows[0][1] and got[1]["__t"] == 1 and got[1]["___hit"] == 2 and got[1]["a.b"] == 3
    assert got[15].n_pseudonyms == 1000 and got[90].n_pseudonyms == 0 and got[91].n_pseudonyms == 1
    assert re.fullmatch("[0-9a-z]{70}@site.org.5", got[92].text) and got[92].n_pseudonyms == 1


def test_long_names_do_not_meet(spark):
    from pyspark.sql import functions as F

    names = spark.range(2000).select(F.concat(F.lit("q" * 47), F.lpad(F.conv(F.col("id").cast("string"), 10, 36), 2, "0"), F.lit("@b.org")).alias("text"))
    assert op.pseudonymise(names, KEY).select("text").distinct().count() == names.distinct().count()
