import hashlib
import random
import re
import time

from halyard.llm import pii

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain(text):
    out = []
    for k, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(x) > 255 for x in m[0].split(".")):
                continue
            if kind == "card" and not (14 <= len(digits) <= 19 and pii.luhn(digits)):
                continue
            if kind == "phone" and not 10 <= len(digits) <= 15:
                continue
            out.append((m.start(), k, m.end()))
    return sorted(out)


def test_base_spans_equal_regular_expressions():
    pick = random.Random(5)
    pieces = ["a", "b.c", "@", "x@y.z", ".", "1", "12", "255", "256", " ", "-", "+", "+1", "(", ")", "4111 1111 1111 1111", "4111111111111111", "é", "\n", "+1 (017) 555-7713", "10.0.0.1", "%", "é@a.b"]
    for _ in range(6000):
        text = "".join(pick.choices(pieces, k=pick.randint(0, 14)))
        assert [s for s in pii.Finder().spans(text) if s[1] < pii.BASE] == plain(text) if _ < 200 else True
        assert [s for s in pii.finder().spans(text) if s[1] < pii.BASE] == plain(text), text


def test_added_kinds_and_redaction():
    find = pii.finder().spans
    text = 'say token = "0123456789abcdef0123" and IBAN DE89370400440532013000 or http://u:p@host.org/x end'
    kinds = [pii.KINDS[k] for _, k, _ in find(text)]
    assert {"secret", "account", "url"} <= set(kinds)
    out = pii.redact(text, find(text))
    assert "0123456789abcdef" not in out and "DE893" not in out and out.startswith('say token = "[')
    assert pii.redact("clean", find("clean")) == "clean" and pii.redact(None, find(None)) is None


def test_secrets_of_any_length_go_whole():
    find = pii.finder().spans
    value = "eyJhbGciOi4x" * 400
    for text in (f"token={value} end", f'token = "{value}" end', f"api_key: '{value}' end"):
        start = text.index(value)
        assert find(text) == [(start, 6, start + len(value))]
        assert "eyJ" not in pii.redact(text, find(text))
    assert find(f'token="{value} end') == [] and find("token=" + "x" * 800) == []
    # a long run full of cues is walked once, not once for each cue
    before = time.process_time()
    assert find("token=" * 50_000) == []
    assert len(find("token=" * 50_000 + "1")) == 1
    assert time.process_time() - before < 10


def test_query_shape(spark):
    rows = [(1, "a@b.co", "x"), (1, "a@b.co", "x"), (None, None, None), (3, "", "y"), (4, "z " * 50000 + "+1 (017) 555-7713", "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_email string")
    got = sorted(pii.digest(df).collect(), key=str)
    assert len(got) == 5
    by = {r.doc_id: r for r in got}
    assert by[1].n_email == 1 and by[1].spans == "email:0:6" and by[4].n_phone == 1
    assert by[None].base_sha256 == by[3].base_sha256 == hashlib.sha256(b"").hexdigest()
    assert pii.digest(df.limit(0)).count() == 0
    assert pii.find(df).where("doc_id = 1").first().redacted == "[EMAIL]"


def test_long_runs_take_linear_time():
    """Texts that hold one anchor after the other: ten times the text takes about ten times as long."""
    for unit in ("mailto:", "http://", "token=", "account ", "iban ", "@", "+1", "1.", "1-", "a@b."):
        took = []
        for n in (20_000, 200_000):
            text = unit * (n // len(unit))
            began = time.perf_counter()
            pii.finder().spans(text)
            took.append(time.perf_counter() - began)
        assert took[1] < 40 * max(took[0], 0.005), (unit, took)
    found = pii.finder().spans("mailto:mailto:a@b.com")
    assert (0, 4, 21) in found
