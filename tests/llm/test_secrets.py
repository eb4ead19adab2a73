import random
import string
import time

from terrane.llm import secrets
from tests.llm.helpers import frame

CHARS = string.ascii_letters + string.digits


def of(n, seed=1, chars=CHARS):
    r = random.Random(seed)
    return "".join(r.choice(chars) for _ in range(n))


def test_long_secrets_are_found_to_their_end(spark):
    lines = "\n".join(of(64, i) for i in range(200))
    key = f"-----BEGIN RSA PRIVATE KEY-----\n{lines}\n-----END RSA PRIVATE KEY-----"
    for before, secret, after in [('api_key = "', of(600), '" and more'), ("see ", key, " here"), ("get https://", f"user:{of(300)}", "@host/x now")]:
        text = before + secret + after
        assert [(f.begin, f.end) for f in secrets.candidates(text)][:1] == [(len(before), len(before) + len(secret))]
        assert [x.text for x in secrets.redacted(frame(spark, [text])).collect()] == [before + "[SECRET]" + after]


def test_a_long_value_around_a_known_key_is_taken_in_pieces():
    text = f"secret={of(300)}+AKIA{of(16, 2, string.ascii_uppercase)}+{of(300, 3)}"
    assert [(f.begin, f.end, f.kind) for f in secrets.candidates(text)] == [(7, 308, "assigned"), (308, 328, "aws_access_key"), (328, 629, "assigned")]


def test_long_runs_of_signs_and_open_keys_take_linear_time():
    start = time.time()
    secrets.candidates("key=" * 50_000 + " " + "-----BEGIN PRIVATE KEY-----\n" * 5_000)
    assert time.time() - start < 20


def test_many_assignments_take_linear_time():
    text = "\n".join(f"api_key = {of(20, i)}" for i in range(100_000))
    start = time.time()
    found = secrets.candidates(text)
    assert len(found) == 100_000 and time.time() - start < 40


def test_findings_against_brute_force():
    """Findings are in order, apart, and hold each planted secret whole."""
    r = random.Random(4)
    for _ in range(200):
        text, planted = "", []
        for _ in range(r.randint(0, 8)):
            before, value, after = r.choice([("password=", of(r.choice([8, 40, 400]), r.random()), "\n"), ("", "AKIA" + of(16, r.random(), string.ascii_uppercase), " "), ("see ", "ghp_" + of(36, r.random()), ", "), ("plain words ", "", "")])
            text += before
            if value:
                planted.append((len(text), len(text) + len(value)))
            text += value + after
        found = [(f.begin, f.end) for f in secrets.candidates(text)]
        assert found == sorted(found) and all(a[1] <= b[0] for a, b in zip(found, found[1:]))
        assert all(any(a <= x and y <= b for a, b in found) for x, y in planted)
