import math
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from opsloom.llm import secret_scan as S

# The same patterns, written again for the brute-force version.
BASE = [
    (re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 6),
    (re.compile(r"AKIA[A-Z0-9]+"), 0, 20),
    (re.compile(r"[0-9a-f]+"), 0, 24),
]
TEXTS = [
    None, "", 'token = "abc123def" x', "token:token:abcdefgh", "PassWord='short' api_key=longenough1 apikey: AKIA" + "A1" * 10,
    "é日 secret = " + "0123456789abcdef" * 2, "AKIAAKIA" + "Z" * 15, "0" * 23 + " " + "f" * 24, "x" * 50_000 + " token=zzzzzz", "token=abc", "secret secret = = value99",
]


def brute(text):
    text = text or ""
    found = [(m.start(), k, m.end()) for k, (p, g, n) in enumerate(BASE) for m in p.finditer(text) if len(m[g]) >= n]
    return sorted(found)


def test_base_spans_and_redaction(documents):
    df = S.scan(documents(list(enumerate(TEXTS))))
    df = df.withColumn("masked", S.redact(F.coalesce("text", F.lit("")), F.col("secrets.spans")))
    for r in df.collect():
        want = brute(TEXTS[r["doc_id"]])
        assert [tuple(s) for s in r["secrets"]["base"]] == want
        assert set(want) <= {tuple(s) for s in r["secrets"]["spans"]}
        for a, _, b in want:
            assert (TEXTS[r["doc_id"]])[a:b] not in r["masked"]
        assert r["score"] == "x"


def brute_log_p(token):
    """The battery of one candidate, written again: -ln p against structure, 0 where a test speaks against randomness."""
    token = token.rstrip("=")
    found = [(alphabet, more) for _, p, alphabet, more in S.ENCODINGS if re.search(p, token)]
    if not found or len(token) < 16:
        return None
    alphabet, more = found[0]
    k, n = len(alphabet), len(token)
    chi = k / n * sum(c * c for c in Counter(token).values()) - n
    v = [alphabet.find(c) + 1 for c in token]
    mean = sum(v) / n
    serial = sum((a - mean) * (b - mean) for a, b in zip(v, v[1:], strict=False)) / max(1e-9, sum((x - mean) ** 2 for x in v))
    high = [x > k / 2 for x in v]
    n1, n2 = sum(high), n - sum(high)
    runs = 1 + sum(a != b for a, b in zip(high, high[1:], strict=False))
    expected = 2 * n1 * n2 / n + 1
    z_runs = abs(runs - expected) / math.sqrt(max(1e-9, (expected - 1) * (expected - 2) / (n - 1)))
    fits = (chi - (k - 1)) / math.sqrt(2 * (k - 1)) <= S.ALPHA_Z and z_runs <= S.ALPHA_Z and abs(serial + 1 / n) * math.sqrt(n) <= S.ALPHA_Z and n1 and n2
    against = ((k - 1) + (n - 1) * (more - 1) - chi) / math.sqrt(2 * (k - 1) + 4 * (more - 1) * n)
    return 0.6931 + against * against / 2 if fits and against > 0 else 0.0


def brute_accepted(values):
    """Benjamini-Hochberg over the same bins, by trying every bin."""
    bins = [min(int(v * S.BINS), S.LAST_BIN) for v in values]
    passing = [b for b in set(bins) if b and math.exp(-b / S.BINS) <= S.FALSE_RATE * sum(x >= b for x in bins) / len(bins)]
    return min(passing) / S.BINS if passing else math.inf


def test_randomness(documents):
    rng = random.Random(3)
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    keys = ["".join(rng.choice(alphabet) for _ in range(n)) for n in (24, 32, 44, 64, 88) for _ in range(8)]
    plain = ["internationalisationandmore" + str(i) for i in range(12)] + ["aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", "1111111111222222222233333333334444444444"]
    rows = [(i, f"see {k} here") for i, k in enumerate(keys)] + [(100 + i, f"see {k} here") for i, k in enumerate(plain)]
    found = {r["doc_id"] for r in S.scan(documents(rows)).where(F.exists("secrets.spans", lambda s: s["kind"] == S.KINDS.index("random"))).collect()}
    # Runs that the base patterns cover aren't candidates.
    values = {i: v for i, t in rows if not brute(t) and (v := brute_log_p(t.split()[1])) is not None}
    level = brute_accepted(list(values.values()))
    assert found == {i for i, v in values.items() if v >= level}
    assert set(range(24, 40)) <= found and not found & set(range(100, 200))


def test_empty_table(documents):
    assert S.scan(documents([])).count() == 0


def test_random_values_after_names(documents):
    rng = random.Random(5)
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    forms = ["AWS_SECRET_ACCESS_KEY={}", "DB_PASS={}", "https://h.example/x?sig={}&v=1", "PRIVATE_KEY={}==", "key:{}"]
    rows = [(i, "see " + forms[i % 5].format("".join(rng.choice(alphabet) for _ in range(48))) + " here") for i in range(40)]
    found = S.scan(documents(rows)).withColumn("masked", S.redact(F.col("text"), F.col("secrets.spans"))).collect()
    for r in found:
        value = re.search(r"[A-Za-z0-9]{48}", r["text"])[0]
        assert value not in r["masked"] and S.MASK in r["masked"]
