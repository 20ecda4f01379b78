import hashlib
import re
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from cases import AWKWARD, EXTRA, SCHEMA, rows, widened

from treeloom.llm import secrets, trigrams

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def brute(text):
    text = text or ""
    a = [m.span() for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    b = [m.span() for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    c = [m.span() for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 32]
    spans = sorted((s, k, e) for k, x in enumerate((a, b, c)) for s, e in x)
    said = ",".join(f"{('assign', 'access', 'hex')[k]}:{s}:{e}" for s, k, e in spans)
    return len(a), len(b), len(c), hashlib.sha256(said.encode()).hexdigest(), said


KEY = "AKIA" + "Q7" * 8
SECRETS = [
    "token = 'abcdefgh1234' and TOKEN:abcdefghi", "token: secret: abcdefghijkl", "password=token=abcdefghijk", f"🎉 {KEY} {KEY}x AKIAAKIA12 AKIA",
    "deadbeef" * 4, "deadbeef" * 9 + " Api_Key = \"" + "0f" * 20 + '"', "api_key=short apikey  :  longenough1", "passwd\": \"x\" passwd 'y",
    "-----BEGIN RSA PRIVATE KEY----- ghp_" + "a" * 36, "secre t=abcdefghij", "SECRET=\nabcdefghij", "ſecret=abcdefghij toKen=abcdefghij", "0f" * 4000 + " " + "0f" * 16,
]


def test_matches_brute_force(spark):
    some = rows([*AWKWARD, *SECRETS])
    for df in (spark.createDataFrame(some, SCHEMA), spark.createDataFrame(widened(some), EXTRA)):
        got = {r["doc_id"]: r for r in secrets.report(df).collect()}
        assert len(got) == len(some)
        for doc_id, text, *_ in some:
            r = got[doc_id]
            *want, said = brute(text)
            assert [r["n_assign"], r["n_access"], r["n_hex"], r["base_sha256"]] == want, text
            assert set(said.split(",")) - {""} <= set(r["spans"].split(","))
    assert "pem:0:31" in got[len(AWKWARD) + 8]["spans"] and "forge:32:72" in got[len(AWKWARD) + 8]["spans"]


def test_queries_are_implied_by_matches():
    assert trigrams.query(r"[0-9a-f]{32,}") is None
    assert trigrams.query("AKIA[A-Z0-9]{12,}") == frozenset([frozenset(["aki", "kia"])])
    q = trigrams.query(secrets.RULES[0].pattern)
    assert frozenset(["tok", "oke", "ken"]) in q and len(q) == 6
    for text in SECRETS:
        for rule in secrets.RULES:
            found = trigrams.query(rule.pattern)
            if found and re.search(rule.pattern, text, re.A):
                assert any(all(g in text.lower() for g in part) for part in found)


def test_redact_keeps_rows_and_columns(spark):
    df = spark.createDataFrame([*rows([*AWKWARD, *SECRETS]), (3, "AKIA" + "Z" * 16, "en", "s", 20)], SCHEMA)
    out = secrets.redact(df)
    assert out.schema == df.schema and out.count() == df.count()
    assert not [r for r in secrets.report(out).collect() if r["n_assign"] + r["n_access"] + r["n_hex"]]
    texts = {r["text"] for r in out.collect()}
    assert "[secret]' and [secret]" in texts and None in texts and "word " * 3000 in texts
    assert all(r["n_chars"] == len(r["text"]) for r in out.collect() if r["text"] is not None)
    assert secrets.redact(df.limit(0)).count() == 0


def test_many_matches_in_one_text_take_little_time(spark):
    text = "🎉 password=abcdefgh1 é " * 100_000
    df = spark.createDataFrame([(1, text, "en", "s", len(text))], SCHEMA)
    secrets.report(df.limit(0)).collect()
    start = time.time()
    r = secrets.report(df).first()
    assert r["n_assign"] == 100_000 and time.time() - start < 15
    want = [m.span() for m in ASSIGN.finditer(text)]
    assert r["spans"] == ",".join(f"assign:{a}:{b}" for a, b in want)
    start = time.time()
    assert secrets.redact(df).first()["text"] == "🎉 [secret] é " * 100_000 and time.time() - start < 15


def test_rows_without_ids_and_with_repeated_ones(spark):
    some = [(None, SECRETS[0]), (None, "clean"), (None, None), (4, SECRETS[1]), (4, SECRETS[4]), (4, "clean"), (4, "clean")] + [(None, SECRETS[0])] * 30
    df = spark.createDataFrame(some, "doc_id long, text string").repartition(3)
    got = sorted((r["doc_id"] or 0, r["base_sha256"]) for r in secrets.report(df).collect())
    assert got == sorted((d or 0, brute(t)[3]) for d, t in some)
    assert sorted(map(repr, (r["doc_id"] for r in secrets.redact(df).collect()))) == sorted(repr(d) for d, _ in some)


def test_a_key_on_very_many_rows_is_salted(spark):
    some = [(7, SECRETS[0])] * 3000 + [(i, "clean") for i in range(300)]
    got = secrets.report(spark.createDataFrame(some, "doc_id long, text string")).groupBy("base_sha256").count().collect()
    assert {r["base_sha256"]: r["count"] for r in got} == {brute(SECRETS[0])[3]: 3000, brute("clean")[3]: 300}
