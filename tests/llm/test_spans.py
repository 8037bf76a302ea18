"""Secrets and personal data: base patterns by brute force, structures to the last byte, long texts, and the trained tagger."""

import base64
import random
import re
import time

import numpy as np
import pytest

from capturelab.llm import pii, secrets
from capturelab.llm.spans import Cover

B64 = lambda b: base64.b64encode(b).decode()
string = lambda b: len(b).to_bytes(4, "big") + b


def randoms(alphabet, n, seed=3, most=60):
    r = random.Random(seed)
    return ["".join(r.choice(alphabet) for _ in range(r.randint(0, most))) for _ in range(n)]


def test_secret_base_patterns_by_brute_force():
    tries = (
        ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), lambda m: len(m[2]) >= 8),
        ("access", re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 16),
        ("hex", re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 32),
    )
    for t in randoms(["token", "API_KEY", "Passwd", "secret", '"', "'", " ", ":", "=", "AKIA", "AB12", "abcdef0123456789", "9", "xyz_", "é", "ſ", "\n"], 3000):
        assert secrets.base_spans(t) == [(k, *m.span()) for k, p, ok in tries for m in p.finditer(t) if ok(m)], t


def container(cipher=b"none", kdf=b"none", options=b"", check=(7, 7), pad=None, tail=b"", kind=b"ssh-ed25519"):
    public = string(kind) + string(bytes(32))
    private = check[0].to_bytes(4, "big") + check[1].to_bytes(4, "big") + string(kind) + string(bytes(32)) + string(bytes(64)) + string(b"me")
    private += bytes(range(1, -len(private) % 8 + 1)) if pad is None else pad
    if cipher != b"none":
        private = bytes(160)
    return b"openssh-key-v1\0" + string(cipher) + string(kdf) + string(options) + (1).to_bytes(4, "big") + string(public) + string(private) + tail


def test_openssh_to_the_last_byte():
    assert secrets.private_key(container()) == "openssh"
    assert secrets.private_key(container(b"aes256-ctr", b"bcrypt", bytes(24))) == "openssh"
    for bad in (container(tail=b"junk"), container()[:-1], container(check=(7, 8)), container(pad=b"\1\1\1"), container(kind=b"\xff\xfe\xff\xfe\xff"), container(b"aes256-ctr"), b"openssh-key-v1\0" + bytes(40)):
        assert secrets.private_key(bad) is None
    text = "a " + container().hex() + " b"
    assert [x for x in secrets.confirmed_spans(text) if x[0] == "key"] == [("key", 2, len(text) - 2)]


def test_pem_with_headers_and_wrapped_keys():
    block = lambda head, body: f"-----BEGIN RSA PRIVATE KEY-----\n{head}{body}\n-----END RSA PRIVATE KEY-----"
    dek = "Proc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,00112233445566778899AABBCCDDEEFF\n\n"
    good = block(dek, B64(bytes(range(64))))
    assert secrets.confirmed_spans(f"x {good} y") == [("key", 2, 2 + len(good))]
    assert not secrets.confirmed_spans(block(dek, B64(bytes(63)))) and not secrets.confirmed_spans(block(dek.replace("00112233", ""), B64(bytes(64))))
    key = b"\x30\x31\x02\x01\x01\x04\x20" + bytes(range(32)) + b"\xa0\x0a\x06\x08" + bytes(8)
    assert secrets.confirmed_spans(block("", B64(key)).replace("\n", "\\n"))[0][0] == "key"
    body = B64(container())
    lines = "\n".join(body[i : i + 60] for i in range(0, len(body), 60))
    assert secrets.confirmed_spans(f"key:\n{lines}\n\nend") == [("key", 5, 5 + len(lines))]
    assert not secrets.confirmed_spans(lines.replace(body[60:64], "AAAA"))


@pytest.mark.parametrize("piece", ["a", "0", "AKIA", "eyJ.", "password ", "-----BEGIN RSA PRIVATE KEY-----", "A" * 60 + "\n", "0" * 64 + " "])
def test_secrets_in_long_texts(piece):
    began = time.time()
    secrets.find([piece * (400_000 // len(piece))])
    assert time.time() - began < 8


def test_personal_base_patterns_by_brute_force():
    email, ip = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
    card, phone = re.compile(r"[0-9]([\x20-]?[0-9])+"), re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
    plain = lambda s: "".join(c for c in s if c in "0123456789")

    def luhn(s):
        total = 0
        for i, c in enumerate(reversed(s)):
            d = int(c) * (1 + i % 2)
            total += d - 9 * (d > 9)
        return total % 10 == 0

    for t in randoms("a@.-1234567890 +()%Zé", 6000) + randoms(["4111", "1111", " ", "-", "+1", "(", ")", ".", "255", "256", "a@b", ".c", "x"], 6000, most=14):
        want = [("email", *m.span()) for m in email.finditer(t)]
        want += [("ip", *m.span()) for m in ip.finditer(t) if all(int(p) <= 255 for p in m[0].split("."))]
        want += [("card", *m.span()) for m in card.finditer(t) if 12 <= len(plain(m[0])) <= 19 and luhn(plain(m[0]))]
        want += [("phone", *m.span()) for m in phone.finditer(t) if 9 <= len(plain(m[0])) <= 15]
        assert pii.base_spans(t) == want, t


@pytest.mark.parametrize("text", ["0" * 5000 + ".1.1.1", "1" * 300_000, "a" * 300_000 + " x@y.z", "@" * 100_000, "a@b.c " * 30_000, "1.2.3.4 " * 30_000, "4 " * 150_000, "a at b dot c " * 10_000])
def test_personal_data_in_long_texts(text):
    began = time.time()
    base = pii.base_spans(text)
    pii.added(text, base, [("email", i, i + 3) for i in range(0, len(text) - 3, 7)])
    assert time.time() - began < 8


def test_cover():
    c, r = Cover([("a", 3, 5), ("b", 4, 9), ("c", 20, 21)]), random.Random(0)
    taken = {3, 4, 5, 6, 7, 8, 20}
    for _ in range(300):
        s = r.randint(0, 25)
        e = s + r.randint(1, 6)
        assert c.meets(s, e) == bool(taken & set(range(s, e)))


def test_trained_tagger_on_held_out_plants(spark):
    """Other notations that were planted in unseen texts are found, and texts without personal data are left alone."""
    r = random.Random(99)
    syllables = ["ka", "lo", "mer", "tin", "va", "shu", "ber", "noi", "ü", "str"]
    word = lambda: "".join(r.choice(syllables) for _ in range(r.randint(1, 4)))
    prose = lambda n: " ".join(word() for _ in range(n))
    num = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    docs = spark.createDataFrame([(i, f"{prose(60)} {word()}.{num(2)}@mail{num(1)}.example.com {prose(40)} +1 ({num(3)}) 555-{num(4)} {prose(30)} {num(2)}.{num(2)}.{num(1)}.{num(2)} {prose(5)}") for i in range(150)], "doc_id long, text string")
    model = pii.train(docs)

    def card():
        while not pii.luhn(d := num(16)):
            pass
        return ".".join(d[i : i + 4] for i in range(0, 16, 4))

    plants = [
        lambda: f"{word()} [at] {word()} [dot] org", lambda: f"{word()}.{word()}(at){word()}.de", lambda: f"{word()} AT {word()} DOT com", lambda: f"{word()}{num(2)} at {word()} dot example dot com", lambda: f"{word()} {{at}} {word()}.org",
        lambda: f"({num(3)}) {num(3)}-{num(4)}", lambda: f"{num(3)}-{num(3)}-{num(4)}", lambda: f"{num(3)}.{num(3)}.{num(4)}", card,
    ]
    decoys = [lambda: f"met at {word()}", lambda: f"version {num(1)}.{num(1)}.{num(2)}", lambda: f"on 20{num(2)}-0{num(1)}-1{num(1)}", lambda: f"{num(2)},{num(3)}.{num(2)} euros", lambda: f"pages 1{num(2)}-1{num(2)}", lambda: "look at dots"]
    texts, spans = [], []
    for k in range(450):
        p, d = plants[k % len(plants)](), decoys[k % len(decoys)]()
        head = f"{prose(r.randint(0, 50))} {d} "
        texts.append(f"{head}{p} {prose(r.randint(0, 50))}")
        spans.append((len(head), len(head) + len(p)))
    clean = [f"{prose(40)} {d()} {prose(40)}" for d in decoys for _ in range(30)]
    base = [pii.base_spans(t) for t in texts + clean]
    got = [pii.added(t, b, x) for t, b, x in zip(texts + clean, base, pii.tagged(texts + clean, model), strict=True)]
    hits = sum(any(a < e and s < b for _, a, b in x) for x, (s, e) in zip(got, spans, strict=False))
    total = sum(map(len, got))
    assert hits >= 0.9 * len(spans) and hits >= 0.9 * total, (hits, total, len(spans))
    assert not any(got[len(texts) :])


def test_tables_with_clashing_columns(spark):
    rows = spark.createDataFrame([(1, "token: abcdefgh1 x@y.zz", 5, "k"), (1, "token: abcdefgh1 x@y.zz", 6, "l"), (None, None, None, None)], "doc_id long, text string, n_assign int, spans string")
    got = secrets.secret_spans(rows).collect()
    assert sorted(r.n_assign for r in got) == [0, 1, 1] and sorted(r.spans for r in got) == ["", "assign:0:16", "assign:0:16"]


def test_wrapped_keys_within_runs_of_lines():
    """A key between lines of its own width, or of others, is found alone and once, and a run of such lines takes linear time."""

    key = _pkcs1(600)
    wrap = lambda t, w: [t[i : i + w] for i in range(0, len(t), w)]
    for form in (B64(key), key.hex()):
        lines = wrap(form, 64)
        for before, after in ((["A" * 64], []), (["MIIC" + "B" * 60] * 3, ["C" * 64] * 2), (["A" * 70], []), ([], ["D" * 64]), (["A" * 50], ["E" * 20])):
            text = "\n".join([*before, *lines, *after])
            if after and len(lines[-1]) != 64:
                text = "\n".join([*before, *lines]) + "\n\n" + "\n".join(after)
            start = sum(len(x) + 1 for x in before)
            spans = [x for x in secrets.confirmed_spans(text) if x[0] == "key"]
            assert spans == [("key", start, start + len("\n".join(lines)))], (before, after)
    full = _pkcs1(600, 48 * 13)  # fills its last line, so that lines of its width may follow
    text = "\n".join(["A" * 64, *wrap(B64(full), 64), "B" * 64, *wrap(B64(full), 64)])
    assert [s for s, *_ in secrets.confirmed_spans(text)] == ["key", "key"] and secrets.confirmed_spans(text)[0][1:] == (65, 65 + 13 * 65 - 1)
    took = []
    for n in (4000, 8000):
        began = time.process_time()
        assert secrets.confirmed_spans("\n".join(["MIICXAIBAAKB" + "A" * 52] * n)) == []
        took.append(time.process_time() - began)
    assert took[1] < 3 * took[0] + 0.2, took


def _pkcs1(size, total=None):
    """An RSA key's DER structure of some bytes, with as many as asked for in all."""
    number = lambda b: b"\x02" + (bytes([len(b)]) if len(b) < 128 else b"\x82" + len(b).to_bytes(2, "big")) + b
    r = np.random.RandomState(size)
    for extra in range(0, 400):
        part = lambda n: b"\x01" + bytes(r.randint(1, 255, n - 1, np.uint8))  # noqa: E731, B023
        body = number(b"\0") + number(part(129)) + number(b"\1\0\1") + number(part(128)) + b"".join(number(part(64)) for _ in range(4)) + number(part(64 + extra))
        der = b"\x30\x82" + len(body).to_bytes(2, "big") + body
        if total is None or len(der) == total:
            return der
    raise AssertionError(len(der))


def test_numbers_beside_one_another(spark):
    """Two card numbers with a space between them are one run of digits to the base pattern, which drops it; the network finds both, equal ones too."""
    r = random.Random(21)

    def card():
        d = "".join(r.choice("0123456789") for _ in range(15))
        return d + next(c for c in "0123456789" if pii.luhn(d + c))

    words = "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor".split()
    prose = lambda n: " ".join(r.choice(words) for _ in range(n))
    docs = spark.createDataFrame([(i, f"{prose(60)} +49 123 4567890 {prose(20)} {card()} {prose(30)}") for i in range(200)], "doc_id long, text string")
    sent = spark.sparkContext.broadcast(pii.train(docs))
    texts, want = [], []
    for k in range(100):
        a, left = card(), prose(r.randint(3, 40)) + " "
        b = a if k % 2 else card()
        texts.append(f"{left}{a} {b} {prose(9)}")
        want.append({("lstm_card", len(left), len(left) + 16), ("lstm_card", len(left) + 17, len(left) + 33)})
    found = [set(added) for _, added in pii.finder(sent)(texts)]
    assert sum(len(w & f) for w, f in zip(want, found, strict=True)) >= 180
