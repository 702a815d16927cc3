import re

from hypothesis import given, settings
from hypothesis import strategies as st

from brookwell.llm import pii

from .helpers import corpus, table


def brute(text):
    """The base by the contract's patterns as they stand."""
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for kind, pattern, low, high in (("card", r"[0-9]([\x20-]?[0-9])+", 13, 19), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", 9, 15)):
        for m in re.finditer(pattern, text):
            d = re.sub("[^0-9]", "", m[0])
            if low <= len(d) <= high and (kind == "phone" or sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(d[::-1])) % 10 == 0):
                out.append((kind, *m.span()))
    return out


def base(text):
    return [(s.kind, s.start, s.end) for s in pii.find_spans(text) if s.kind in pii.BASE]


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="ab.@+-() 0123456789_%é", max_size=120))
def test_base_is_the_patterns(text):
    assert base(text) == brute(text)


def test_known_cases():
    text = "a@b.com@d.com 1.2.3.4.5.6.7.8 256.1.1.1 4111 1111 1111 1111 4111111111111112 +1 (234) 555-7777 +1 2"
    assert base(text) == brute(text)
    assert [s.kind for s in pii.find_spans("IBAN GB82 WEST 1234 5698 7654 32.")] == ["iban"]
    assert not pii.find_spans("GB82 WEST 1234 5698 7654 33")
    secret = "9b0b3c6a43eb78aa99cbd7049c572391524f37a8"
    assert [s.kind for s in pii.find_spans(f'token = "{secret}"') if s.kind == "secret"] == ["secret"]
    assert not [s for s in pii.find_spans(f"sha1 {secret}") if s.kind == "secret"]
    assert [s.kind for s in pii.find_spans("ssn 078-05-1120")] == ["ssn"]
    assert not [s for s in pii.find_spans("lot 078-05-1120") if s.kind == "ssn"]


def test_long_runs_take_linear_time():
    assert pii.find_spans("1" * 200_000) == []
    assert pii.find_spans("a" * 200_000) == []
    assert pii.find_spans("+1" + " " * 100_000) == []
    assert pii.find_spans("0" * 6000 + ".1.1.1")[0].kind == "ip"


def test_redaction():
    text = "write to a@b.com or +1 (234) 555-7777"
    assert pii.redact(text, pii.find_spans(text)) == "write to [EMAIL] or [PHONE]"


def test_table(spark):
    rows = corpus() + [(900, "mail a@b.com now", "en", "a", 1)]
    found = pii.detect(table(spark, rows)).collect()
    assert sorted(map(str, (r.doc_id for r in found))) == sorted(str(r[0]) for r in rows)
    assert [s.kind for r in found if r.doc_id == 900 for s in r.spans] == ["email"]
    assert pii.detect(table(spark, [])).collect() == []
    out = {r.doc_id: r for r in pii.redacted(table(spark, rows)).collect()}
    assert out[900].text == "mail [EMAIL] now" and out[900].key == "clash"
