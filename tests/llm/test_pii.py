"""Base spans against Python's regular expressions, added spans, redaction, odd rows."""

import hashlib
import random
import re

import pytest

from tallyfield.llm import pii

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    return sum(2 * d - 9 * (d > 4) if i % 2 else d for i, d in enumerate(map(int, reversed(digits)))) % 10 == 0


def base(text):
    found = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else 0, "card": 16 <= len(digits) <= 19 and luhn(digits), "phone": 8 <= len(digits) <= 15}
            if ok[kind]:
                found.append(f"{kind}:{m.start()}:{m.end()}")
    return ",".join(found)


def texts():
    rng = random.Random(4)
    bits = ["a.b@c.de", "@", "x@y", "x@y.z.", "+d@e.f", "1.2.3.4", "1.2.3.4.5.6.7.8", "256.1.1.1", "0255.01.1.1", "10.0.0.1", "0.0.0.0", "127.000.00.1", "192.168.0.256", "00", "0", "4111 1111 1111 1111", "4111-1111-1111-1111", "5500000000000004", "+1 (427) 555-5262", "+12", "+1.", "é", "🙂", " ", "\n", "-", ".", "7", "12345678901234567890123", "a" * 50]
    made = ["".join(rng.choices(bits, k=rng.randint(1, 12))) for _ in range(400)]
    return [*made, None, "", "a" * 200_000, "1" * 50_000, "1 " * 20_000, "1." * 30_000, "a@b.c " * 300]


@pytest.fixture(scope="module")
def model(spark):
    return pii.train(spark)


def test_base_spans_match_python(spark, model):
    rows = list(enumerate(texts())) + [(3, texts()[3]), (None, "a@b.c")]
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, spans int")
    got = pii.personal_data(docs, model).collect()
    assert len(got) == len(rows)
    by_id = dict(rows)
    for r in got:
        want = base(by_id[r.doc_id] or "")
        assert r.base_sha256 == hashlib.sha256(want.encode()).hexdigest(), (r.doc_id, by_id[r.doc_id], want, r.spans)
        assert set(filter(None, want.split(","))) <= set(r.spans.split(","))
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [want.count(k) for k in pii.KINDS]
    assert pii.personal_data(docs.limit(0), model).count() == 0


def test_added_spans_and_clean_texts(spark, model):
    found = ["call (427) 555-5262 now", "write to an.12 (at) there (dot) com please", "host 10[.]0[.]0[.]7 is up"]
    clean = ["look at the dot and so on", "order 4471882390 of 2024-05-06 12", 'token = "2d36530ff989cdbaf29243955fc930be3d922"', "anea at oring. Thntea", "serial 12345678901234567"]
    docs = spark.createDataFrame(list(enumerate(found + clean)), "doc_id int, text string")
    got = {r.doc_id: r.spans for r in pii.personal_data(docs, model).collect()}
    assert all(got[i] for i in range(len(found))), got
    assert not any(got[i] for i in range(len(found), len(found + clean))), got


def test_every_part_of_an_address(spark, model):
    parts = [*map(str, range(301)), *(f"{k:03}" for k in range(0, 301, 7)), "00", "000", "0000", "0256", "00255"]
    rows = [(i, ".".join([p if k == i % 4 else "0" for k in range(4)])) for i, p in enumerate(parts)]
    docs = spark.createDataFrame([*rows, (1000, "server 10.0.0.1 down; ping 192.168.0.7; 8.8.8.8")], "doc_id int, text string")
    got = {r.doc_id: r.n_ip for r in pii.personal_data(docs, model).collect()}
    assert got == {i: int(int(p) <= 255) for i, p in enumerate(parts)} | {1000: 3}
    redacted = pii.redact(docs.where("doc_id = 1000"), model).first()
    assert redacted.text == "server <IP> down; ping <IP>; <IP>"


def test_families_of_formats_never_seen(spark):
    data = pii.measured(spark, pii.examples())
    x, family, y = data[:, :-2], data[:, -2].astype(int), data[:, -1]
    caught = right = wanted = 0
    for fold in range(4):
        own = family % 4 == fold
        model = pii.boost(x[~own], y[~own], family[~own])
        score = 1 / (1 + pii.np.exp(-(model.prior + pii.np.array([sum(pii.walk(t, row) for t in model.trees) for row in x[own]]))))
        loose = x[own][:, 1] == 0
        chosen = loose & (score >= pii.np.array(model.thresholds)[x[own][:, 0].astype(int)])
        caught, right, wanted = caught + chosen.sum(), right + y[own][chosen].sum(), wanted + y[own][loose].sum()
    print(f"families never seen: recall {right / wanted:.3f}, precision {right / caught:.3f}")
    assert right / wanted >= 0.9 and right / caught >= 0.9


def test_new_sentences_of_known_families(spark, model):
    made = [m for m in pii.examples(each=12, seed=77) if m[2]]
    clean = [m for m in pii.examples(each=12, seed=78) if not m[2]]
    docs = spark.createDataFrame([(i, m[0]) for i, m in enumerate(made + clean)], "doc_id int, text string")
    got = {r.doc_id: r.n_found for r in pii.personal_data(docs, model).collect()}
    assert sum(got[i] > 0 for i in range(len(made))) / len(made) > 0.9
    assert sum(got[i] > 0 for i in range(len(made), len(made + clean))) / len(clean) < 0.1


def test_redaction_keeps_columns(spark, model):
    docs = spark.createDataFrame([(1, "mail a@b.co or +1 (427) 555-5262!", "en"), (2, None, "de"), (3, "plain é", None)], "doc_id int, text string, row string").selectExpr("*", "1 as pii_base", "2 as spans", "3 as base")
    got = {r.doc_id: r for r in pii.redact(docs, model).collect()}
    assert got[1].text == "mail <EMAIL> or <PHONE>!" and got[1].row == "en"
    assert pii.redact(docs, model).columns == docs.columns and got[1].pii_base == 1 and got[1].base == 3
    assert got[2].text is None and got[3].text == "plain é"
