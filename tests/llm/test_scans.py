"""PII, secrets, urls and the classifier against brute force, round trips and held-out accuracy."""

import base64
import itertools
import json
import random
import re

import pytest

from kestrelite.llm import pii, queries, quality_classifier, secret_scan, url_filter

ALPHABET = "ab9 0.@+-%()\n=:\"'A_"


def naive_pii(t):
    digits = lambda s: re.sub("[^0-9]", "", s)
    out = [(0, *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(1, *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m.group().split("."))]
    out += [(2, *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 16 <= len(digits(m.group())) <= 19 and pii.luhn(digits(m.group()))]
    out += [(3, *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 8 <= len(digits(m.group())) <= 15]
    return sorted(out)


def naive_secrets(t):
    a = r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    out = [(0, *m.span()) for m in re.finditer(a, t) if len(m[2]) >= 6]
    out += [(1, *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    return out + [(2, *m.span()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]


def test_base_patterns_equal_the_plain_expressions():
    r = random.Random(3)
    pieces = ["a.b@c.de", "@", "1.2.3.4", "999.1.1.1", "4111 1111 1111 1111", "+1 (555) 123-4567", "+", "12", " ", ".", "password=", "Token: ", "AKIA", "ABCDEFGHIJKLMNOPQRST", "deadbeef" * 3, "é", "\n", "ſecret=abcdefg"]
    for _ in range(4000):
        t = "".join(r.choice(pieces) if r.random() < 0.6 else r.choice(ALPHABET) for _ in range(r.randint(0, 14)))
        assert pii.base_spans(t) == naive_pii(t), t
        assert sorted(secret_scan.base_spans(t)) == sorted(naive_secrets(t)), t


def test_field_finds_held_out_entities():
    r, w = random.Random(99), pii.model()
    good = bad = missed = 0
    for _ in range(150):
        text, gold = pii._sentence(r)
        toks = pii._tokens(text, 0, len(text))
        found = {(k, toks[i][0], toks[j - 1][1]) for k, i, j in pii.decode(w, text, toks)}
        good, bad, missed = good + len(found & set(gold)), bad + len(found - set(gold)), missed + len(set(gold) - found)
    assert good / (good + bad) > 0.9 and good / (good + missed) > 0.9


def test_field_adds_what_the_patterns_leave_out():
    t = "write to anna dot miller at mail dot org or call (555) 123-4567 today"
    kinds = {k for k, _, _ in pii.added_spans(t, pii.base_spans(t), pii.model())}
    assert 3 in kinds
    assert pii.redact("mail a@b.co now", [{"kind": "email", "start": 5, "end": 11}]) == "mail <email> now"


def test_pii_edge_cases(odd, none):
    rows = pii.find(odd).collect()
    assert len(rows) == 9 and {r.spans for r in rows if r.doc_id in (1, 2, 3)} == {""}
    assert pii.find(none).count() == 0


def der(tag, body):
    return bytes([tag]) + (bytes([len(body)]) if len(body) < 128 else b"\x82" + len(body).to_bytes(2, "big")) + body


def keys():
    """Private keys of each form, and public ones that look alike; made of bytes, none is real."""
    num = lambda n, seed=1: der(2, bytes([1]) + bytes((i * 37 + seed) % 256 for i in range(n - 1)))
    oid = der(0x30, der(6, bytes.fromhex("2a864886f70d010101")) + der(5, b""))
    rsa = der(0x30, der(2, b"\0") + b"".join(num(n, n) for n in (128, 3, 128, 64, 64, 64, 64, 64)))
    ec = der(0x30, der(2, b"\1") + der(4, bytes(range(32))) + der(0xA0, der(6, bytes.fromhex("2a8648ce3d030107"))) + der(0xA1, der(3, b"\0\4" + bytes(64))))
    eight = der(0x30, der(2, b"\0") + oid + der(4, rsa))
    sealed = der(0x30, der(0x30, der(6, bytes.fromhex("2a864886f70d01050d")) + der(0x30, der(4, bytes(8)) + der(2, b"\x08\0"))) + der(4, bytes(range(64))))
    spki = der(0x30, oid + der(3, b"\0" + der(0x30, num(128) + num(3))))
    field = lambda x: len(x).to_bytes(4, "big") + x
    public = field(b"ssh-ed25519") + field(bytes(32))
    box = b"openssh-key-v1\0" + field(b"none") + field(b"none") + field(b"") + (1).to_bytes(4, "big") + field(public) + field(bytes(range(136)))
    return {"rsa": rsa, "ec": ec, "eight": eight, "sealed": sealed}, {"spki": spki, "public": public, "short": rsa[:-1], "magic": b"openssh-key-v1\0" + bytes(range(40)), "numbers": der(0x30, num(99) + num(3))}, box


def test_structures_are_confirmed_or_not():
    private, public, box = keys()
    encode = lambda x: base64.b64encode(x).decode()
    spans = lambda t: [(secret_scan.KINDS[k], t[s:e]) for k, s, e in secret_scan.added_spans(t)]
    for kind, data in [("der", d) for d in private.values()] + [("ssh", box)]:
        b64 = encode(data)
        assert secret_scan.structure(b64) == (kind, len(b64))
        for text in (b64, f"é file/{b64}", f"key={b64} then", f"a_{b64}", f"{b64}."):
            assert spans(text) == [(kind, b64)], text[:20]
        wrapped = "\n".join(b64[i : i + 64] for i in range(0, len(b64), 64))
        assert spans(f"x\n{wrapped}\ny")[0][1].split() == wrapped.split()
        assert [k for k, _ in spans(f"-----BEGIN PRIVATE KEY-----\n{wrapped}\n-----END PRIVATE KEY-----")] == ["pem"]
    assert spans(f"id {private['ec'].hex()} end") == [("der", private["ec"].hex())]
    for data in public.values():
        assert spans(encode(data)) == [] and spans(data.hex()) == [] and spans(f"-----BEGIN X KEY-----\n{encode(data)}\n-----END X KEY-----") == []
    old = f"-----BEGIN RSA PRIVATE KEY-----\nProc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,00\n\n{encode(bytes(range(128)))}\n-----END RSA PRIVATE KEY-----"
    assert spans(old) == [("pem", old)]
    assert secret_scan.added_spans("plain words " * 500) == [] and secret_scan.added_spans("MIIB/" * 20_000) == []


def test_signed_tokens_are_found_inside_a_candidate():
    part = lambda o: base64.urlsafe_b64encode(json.dumps(o).encode()).decode().rstrip("=")
    token = f"{part({'alg': 'HS256'})}.{part({'sub': 'someone', 'n': 12345})}.c2lnbmF0dXJl"
    bare = token.rsplit(".", 1)[0] + "."
    for text, want in ((f"It is {token}.", [token]), (f"at /v1/{token}", [token]), (f"../{token}...", [token]), (f"{token}.Then", [token]), (f"a/{token}/{token}.", [token] * 2), (token, [token]), (f"x {bare} y", [bare[:-1]]), (f"k={token}==", [token + "=="]), (f"Bearer_{token}", [token]), (f"http://h/cb/{token}", [token]), (f"a.{part({'x': 1})}.{part({})}.c2lnbmF0dXJl.", [])):
        assert [text[s:e] for k, s, e in secret_scan.added_spans(text) if secret_scan.KINDS[k] == "jwt"] == want


def test_secret_edge_cases(odd, none):
    assert secret_scan.scan(odd).count() == 9 and secret_scan.scan(none).count() == 0


@pytest.mark.parametrize(
    ("url", "host", "path", "rule"),
    [
        ("http://A.Example.COM/en/x?q#f", "a.example.com", "/en/x", "example.com/en/"), ("https://www.example.com/en/", "www.example.com", "/en/", "www.example.com/en/"),
        ("http://x.com", "x.com", "", None), ("http://x.com/", "x.com", "/", "com/"), ("http://a.net/es/1", "a.net", "/es/1", "net/es/"), ("no url", "", "", None), (None, "", "", None), ("http://xcom/", "xcom", "/", None),
    ],
)
def test_url_rules(url, host, path, rule):
    assert url_filter.parts(url) == (host, path)
    found = url_filter.Rules(url_filter.RULES).match(host, path) if host else None
    assert (found[0] if found else None) == rule


def test_host_words_are_split():
    s = url_filter.Splitter({"free": 50, "bets": 20, "casino": 30, "win": 40, "the": 100})
    assert s.split("casinowin") == ["casino", "win"] and s.split("freebets") == ["free", "bets"]


def test_url_filter_blocks_seed_hosts(spark, sf_dir):
    rows = queries.queries()["op2_url_filter"](spark, sf_dir).collect()
    assert len({r.page_id for r in rows}) == len(rows) == spark.read.parquet(f"{sf_dir}/pages.parquet").count()
    for r in rows:
        found = url_filter.Rules(url_filter.RULES).match(r.host, r.path)
        assert (r.rule, r.verdict) == found if found else r.rule is None
    empty = spark.createDataFrame([(1, None, None), (2, "x", None)], "page_id long, url string, html string")
    assert {r.verdict for r in url_filter.judge(empty).collect()} == {"allow"}
    assert url_filter.judge(empty.limit(0)).count() == 0


def test_words_are_split_as_by_all_splits():
    s = url_filter.Splitter({"a": 30, "ab": 9, "abc": 5, "bc": 12, "c": 20, "cab": 4, "b": 7})

    def cost(words):
        return sum(s.cost.get(w, s.unknown + 2.5 * len(w)) for w in words)

    r = random.Random(1)
    for _ in range(60):
        name = "".join(r.choice("abcx") for _ in range(r.randint(1, 9)))
        every = [[name[i:j] for i, j in zip([0, *cuts], [*cuts, len(name)])] for k in range(len(name)) for cuts in itertools.combinations(range(1, len(name)), k)]
        assert cost(s.split(name)) == pytest.approx(min(map(cost, every))) and "".join(s.split(name)) == name


def test_url_filter_edge_cases(spark):
    rows = [(1, "http://example.org/" + "a" * 20_000, "x"), (2, "http://casino-bets.org/x", None), (2, "http://casino-bets.org/x", None), (None, "http://h.org", "y")]
    docs = spark.createDataFrame([(*r, "extra") for r in rows], "page_id long, url string, html string, verdict string")
    got = url_filter.judge(docs).collect()
    assert len(got) == 4 and len({(r.host, r.verdict) for r in got if r.page_id == 2}) == 1


def test_classifier_held_out(spark, odd, none):
    r = random.Random(4)
    good, bad = [f"g{i}" for i in range(300)], [f"b{i}" for i in range(300)]
    rows = []
    for i in range(600):
        own, other = (good, bad) if i % 3 else (bad, good)
        rows.append((i, " ".join(r.choice(own if r.random() < 0.7 else other) for _ in range(60)), int(bool(i % 3))))
    docs, labels = spark.createDataFrame([x[:2] for x in rows], "doc_id long, text string"), spark.createDataFrame([(x[0], x[2]) for x in rows] + [(0, None), (1, 1), (None, 1)], "doc_id long, quality int")
    got = [x for x in quality_classifier.classify(docs, labels.select("doc_id", "quality")).collect() if x.held_out]
    truth = {x[0]: x[2] for x in rows}
    held = [(x.score, truth[x.doc_id], x.predicted) for x in got]
    assert len(held) == len({x.doc_id for x in got}) > 80  # labels that repeat add no rows
    up, down = [s for s, y, _ in held if y], [s for s, y, _ in held if not y]
    assert sum(a > b for a in up for b in down) / (len(up) * len(down)) > 0.97
    assert sum(p for _, y, p in held if y) / len(up) > 0.9 and sum(1 - p for _, y, p in held if not y) / len(down) > 0.7
    got = quality_classifier.classify(odd, labels.limit(0)).collect()
    assert len(got) == 9 and {r.score for r in got} == {0.5}
    assert quality_classifier.classify(none, labels).count() == 0
