import hashlib
import random
import re
import time

from shotlake.llm import pii, queries

from .conftest import SCHEMA, row

FORMS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(d):
    return sum(sum(divmod(int(c) * 2, 10)) if i % 2 else int(c) for i, c in enumerate(reversed(d))) % 10 == 0


def strict(kind, m):
    digits = re.sub("[^0-9]", "", m)
    return {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m.split(".")), "card": 16 <= len(digits) <= 19 and luhn(digits), "phone": 8 <= len(digits) <= 15}[kind]


def brute(text):
    return [(k, m.start(), m.end()) for k, p in FORMS.items() for m in re.finditer(p, text or "") if strict(k, m[0])]


TEXTS = [
    "a@b.c@d.e a@b.cd%x@e.f x@y @z.com joe@mail. joe@mail.co.", "1.2.3.4.5.6.7.8 256.1.1.1 0001.002.3.255 1.2.3 99999999999999999999.1.1.1 1.2.3.4", "4111 1111 1111 1111 4111-1111-1111-1112 41111111111111111 5500005555555559 5500 0055 5555 5559-",
    "+1 (437) 555-0689 +44 20 7946 0958 +1 +12345678901234567 ++49 89 1234567. 12+3 4", "é 😀 mail ü@x.de 😀 x@ü.de 10.0.0.1é", "9" * 5000 + " +" + "1(" * 2000 + " " + "a" * 5000 + " a." * 2000, None, "", "+1.2.3.4.5.6.7.8.9@a.b",
]


def test_base_spans(spark, docs):
    rows = [row(i, t) for i, t in enumerate(TEXTS)]
    want = {r[0]: brute(r[1]) for r in rows} | {1000 + r.doc_id: brute(r.text) for r in docs.collect()}
    from pyspark.sql import functions as F

    table = spark.createDataFrame(rows, SCHEMA).select("doc_id", "text").unionByName(docs.select((F.col("doc_id") + 1000).alias("doc_id"), "text"))
    got = {r.doc_id: r for r in pii.report(pii.find_pii(table)).collect()}
    for k, spans in want.items():
        text = ",".join(f"{a}:{b}:{c}" for a, b, c in spans)
        assert got[k].base_sha256 == hashlib.sha256(text.encode()).hexdigest(), (k, spans)
        assert [got[k][f"n_{x}"] for x in pii.KINDS] == [sum(s[0] == x for s in spans) for x in pii.KINDS]


def test_patterns_find_unseen_identifiers(spark):
    seeds = [row(i, f"some words call me at +1 (437) 555-{1000 + i} please or write to user{i}@mail.example.com today") for i in range(40)]
    unseen = [row(100, "other words call me at 437-555-0199 please"), row(101, "or write to user77@localhost today"), row(102, "room number 437-555-0100 is no identifier here")]
    got = {r.doc_id: r.spans for r in pii.report(pii.find_pii(spark.createDataFrame(seeds + unseen, SCHEMA))).collect()}
    assert got[100] == "phone:23:35" and got[101] == "email:12:28" and got[102] == ""


def test_accepted_instances_induce_patterns(spark):
    seeds = [row(i, f"some words call me at +1 (437) 555-{1000 + i} please") for i in range(40)]
    first = [row(100 + i, f"other words call me at 437-555-019{i} please") for i in range(3)]
    again = [row(110 + i, f"reach our desk under 437-555-019{i} any weekday") for i in range(3)]
    last = [row(120, "reach our desk under 437-555-0777 any weekday"), row(121, "room number 437-555-0100 is no identifier here")]
    got = {r.doc_id: r.spans for r in pii.report(pii.find_pii(spark.createDataFrame(seeds + first + again + last, SCHEMA))).collect()}
    assert all(got[k] == "phone:21:33" for k in (110, 111, 112, 120)) and got[121] == ""


def planted(rng):
    """(text, spans to add): identifiers in their usual contexts, strict ones and ones that miss the strict forms, and
    numbers in other contexts that are none."""
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))

    def card(good):
        d = digits(15)
        d += next(str(c) for c in range(10) if luhn(d + str(c)))
        d = d if good else d[:-1] + str((int(d[-1]) + 1 + rng.randrange(9)) % 10)
        d = d if luhn(d) == good else d[:-1] + str((int(d[-1]) + 1) % 10)
        return " ".join(d[i : i + 4] for i in range(0, 16, 4))

    contexts = {"phone": ["please call me at {} or come by", "our phone number is {} on any day"], "email": ["just write to {} about it", "send mail to {} by noon"], "card": ["paid with card number {} last week"], "ip": ["login came from host {} at night"]}
    strict = {"phone": lambda: f"+{rng.randint(1, 99)} ({digits(3)}) {digits(3)}-{digits(4)}", "email": lambda: f"u{digits(5)}@mail.example.com", "card": lambda: card(True), "ip": lambda: ".".join(str(rng.randint(0, 255)) for _ in range(4))}
    weak = {"phone": lambda: rng.choice([f"{digits(3)}-{digits(3)}-{digits(4)}", f"({digits(3)}) {digits(3)}-{digits(4)}", f"020 {digits(4)} {digits(4)}"]), "email": lambda: f"u{digits(5)}@localhost", "card": lambda: card(False), "ip": lambda: f"{rng.randint(256, 999)}.{rng.randint(0, 255)}.{rng.randint(0, 255)}.7"}
    others = [lambda: f"the part has number {digits(3)}-{digits(3)}-{digits(4)} in the list", lambda: f"it grew in {digits(4)} {digits(4)} {digits(4)} tons", lambda: f"order {digits(10)} was sent", lambda: f"see chapter {digits(2)}.{digits(2)}.{digits(2)}.{rng.randint(256, 999)} below", lambda: f"tag @home{digits(4)} here"]
    text, spans = "", []
    for _ in range(rng.randint(1, 4)):
        filler = " ".join(rng.choice(["lorem", "ipsum", "dolor", "amet", "sit", "elit"]) for _ in range(rng.randint(3, 12)))
        kind = rng.choice(list(contexts))
        r = rng.random()
        value = (strict if r < 0.6 else weak)[kind]()
        piece = rng.choice(others)() if r > 0.8 else rng.choice(contexts[kind]).format(value)
        text += filler + " "
        if 0.6 <= r <= 0.8:
            at = len(text) + piece.index(value)
            spans.append(f"{kind}:{at}:{at + len(value)}")
        text += piece + ". "
    return text, spans


def test_precision_and_recall_of_added_spans(spark):
    rng = random.Random(5)
    cases = [planted(rng) for _ in range(800)]
    got = {r.doc_id: r for r in pii.find_pii(spark.createDataFrame([row(i, t) for i, (t, _) in enumerate(cases)], SCHEMA)).collect()}
    found = {(i, f"{a.kind}:{a.start}:{a.end}") for i, r in got.items() for a in r.added}
    want = {(i, s) for i, (_, spans) in enumerate(cases) for s in spans}
    print(f"added spans: precision {len(found & want) / len(found):.3f}, recall {len(found & want) / len(want):.3f} of {len(want)}")
    assert len(found & want) > 0.95 * len(found) and len(found & want) > 0.9 * len(want)


def test_very_many_matches_in_one_text(spark):
    mails = " ".join(f"u{i}@b.co" for i in range(100_000))
    mixed = " ".join(f"+1 (437) 555-{i:04d} 4111 1111 1111 1111 10.0.0.{i % 256} x{i}@y 555-{i:06d}" for i in range(20_000))
    spark.range(1).count()
    began = time.perf_counter()
    got = {r.doc_id: r for r in pii.report(pii.find_pii(spark.createDataFrame([row(1, mails), row(2, mixed)], SCHEMA))).collect()}
    assert time.perf_counter() - began < 60
    assert got[1].n_email == 100_000 and (got[2].n_phone, got[2].n_card, got[2].n_ip) == tuple(sum(k == x for k, _, _ in brute(mixed)) for x in ("phone", "card", "ip"))


def test_running_sums(spark):
    from pyspark.sql import functions as F

    rng = random.Random(2)
    rows = [([rng.randint(0, 9) for _ in range(n)],) for n in (0, 1, 63, 64, 65, 128, 1000)]
    for r in spark.createDataFrame(rows, "v array<int>").select("v", pii.running(F.col("v"), lambda a, b: a + b).alias("s"), pii.running(F.col("v"), F.greatest).alias("m")).collect():
        assert r.s == [sum(r.v[:i]) for i in range(len(r.v))] and r.m == [max(r.v[:i], default=0) for i in range(len(r.v))]


def test_candidates_beside_base_spans(spark):
    """A token that any base span overlaps is none, whichever starts first; one right after or before it is."""
    from pyspark.sql import functions as F

    rng = random.Random(8)
    texts = [" ".join(rng.choice(["10.0.0.1", "+1 (437) 555-0689", "4111 1111 1111 1111", "a@b.co", "x1@y", "437-555-0199", "(017) 555-7713", "1.2.3.4.5.6", "+49.30.1234567.8.9", "99.1.1.1", "word", "7", "12345678"]) for _ in range(rng.randint(0, 12))) for _ in range(300)]
    seen = {r.doc_id: r for r in pii.scan(spark.createDataFrame([row(i, t) for i, t in enumerate(texts)], SCHEMA)).select("doc_id", F.filter("seen", lambda x: ~x["seed"]).alias("free")).collect()}
    for i, text in enumerate(texts):
        taken = [(a, b) for _, a, b in brute(text)]
        free = [(x.start, x.end) for x in seen[i].free]
        assert all(b <= x or y <= a for x, y in free for a, b in taken)
        tokens = [(m.start(), m.end()) for m in re.finditer(pii.TOKEN, text)]
        classed = [t for t in tokens if all(b <= t[0] or t[1] <= a for a, b in taken) and ("@" in text[slice(*t)] or (not re.search("[A-Za-z_@]", text[slice(*t)]) and (text[slice(*t)].count(".") >= 3 or len(re.sub("[^0-9]", "", text[slice(*t)])) >= 7)))]
        assert free == classed, text


def test_odd_rows(odd, none, odd_rows, spark, sf_dir):
    assert pii.report(pii.find_pii(odd)).count() == len(odd_rows)
    assert pii.report(pii.find_pii(none)).count() == 0
    assert queries.op8_pii(spark, sf_dir).count() == 200
