import base64
import bz2
import gzip
import hashlib
import lzma
import re
import time
import urllib.parse
import zlib

import pytest
from corpora import ROWS, SCHEMA, table
from hypothesis import given, settings
from hypothesis import strategies as st
from tidewave.llm import secrets as S

SECRET = 'api_key = "Zm9vYmFyMTIzNDU2"'


def brute(text):
    """The three kinds as their patterns are stated, failing matches dropped."""
    out = []
    for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.IGNORECASE | re.ASCII):
        if len(m[2]) >= 8:
            out.append(("assign", *m.span()))
    out += [("access", *m.span()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    out += [("hex", *m.span()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(out, key=lambda s: (s[1], S.KINDS.index(s[0])))


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(["password", "PassWd", "api_key", "ApiKey", "tOken", "secret", "ſecret", "toKen", " ", "=", ":", '"', "'", "abc", "abcdefgh", "AKIA", "AKIA0123456789AB", "0" * 31, "a1b2" * 8, "G", "\n", "é", "😀"]), max_size=14).map("".join))
def test_base_spans(text):
    assert S.scan(text) == brute(text)
    base, added = S.find_secrets(text)
    assert base == brute(text)


@pytest.mark.parametrize("wrap", [
    lambda b: base64.b64encode(b).decode(),
    lambda b: base64.urlsafe_b64encode(b).decode().rstrip("="),
    lambda b: base64.b64encode(zlib.compress(b)).decode(),
    lambda b: base64.b64encode(gzip.compress(b)).decode(),
    lambda b: base64.b64encode(bz2.compress(b)).decode(),
    lambda b: base64.b64encode(lzma.compress(b)).decode(),
    lambda b: base64.b64encode(base64.b64encode(gzip.compress(base64.b64encode(b)))).decode(),
    lambda b: "".join(f"%{c:02X}" for c in b),
    lambda b: "".join(f"\\u{ord(c):04x}" for c in b.decode()),
    lambda b: "".join(f"\\x{c:02x}" for c in gzip.compress(b)),
    lambda b: urllib.parse.quote(base64.b64encode(b).decode(), safe=""),
    lambda b: urllib.parse.quote(urllib.parse.quote(b.decode(), safe="")),
])
def test_layers_are_unwrapped(wrap):
    inner = wrap(SECRET.encode())
    text = f"Été before: {inner} after"
    base, added = S.find_secrets(text)
    found = {s for s in base if s[0] == "assign"} | {s for _, s in added if s[0] == "assign"}
    assert found
    for _, a, b in found:
        assert 12 <= a < b <= 12 + len(inner)
    assert SECRET not in S.redacted(text) and S.redacted(text).startswith("Été before: ") and S.redacted(text).endswith(" after")


def planted(k):
    """A secret among letters whose base64 holds + and / or - and _."""
    return f"ÿÿ?>~{k} " * 3 + f'password = "{hashlib.md5(str(k).encode()).hexdigest()[:20]}"' + " ?>ÿ" * (k % 7)


def whole(text, inner):
    """That a secret is found and that no other stretch than inner is marked."""
    at = text.index(inner)
    _, added = S.find_secrets(text)
    return any(s[0] == "assign" for _, s in added) and all(at <= a < b <= at + len(inner) for _, (_, a, b) in added)


@pytest.mark.parametrize("encode", [base64.b64encode, base64.urlsafe_b64encode])
@pytest.mark.parametrize("pack", [bytes, gzip.compress])
def test_both_alphabets_are_decoded_whole(encode, pack):
    inner = [encode(pack(planted(k).encode())).decode() for k in range(60)]
    assert any(set(x) & set("+/") for x in inner) != any(set(x) & set("-_") for x in inner)
    for x in inner:
        assert whole(f"see ({x}) there", x)
        assert whole(f"see ({x.rstrip('=')}) there", x.rstrip("="))
    standard = base64.b64encode(planted(1).encode()).decode()
    assert whole(f"--data-{standard}", standard)


def wrap(data, width, line_break):
    run = base64.b64encode(data).decode()
    return line_break.join(run[i : i + width] for i in range(0, len(run), width))


@pytest.mark.parametrize("line_break", ["\n", "\r\n", "\n  "])
@pytest.mark.parametrize("width", [76, 64, 20])
@pytest.mark.parametrize("pack", [bytes, gzip.compress, lambda b: wrap(gzip.compress(b), 64, "\n").encode()])
def test_wrapped_base64_is_decoded_whole(pack, width, line_break):
    for k in range(20):
        inner = wrap(pack(planted(k).encode()), width, line_break)
        for before, after in (("", ""), ("see (", ") there"), ("-----BEGIN SOME DATA-----\n", "\n-----END SOME DATA-----\n"), ("A word\n", "\nand another"), ("Data: ", "\n\nmore text")):
            # a word that follows a last line of full width may be of the run
            more = "\nand" if after.startswith("\nand") and len(inner.split(line_break)[-1]) == width else ""
            assert whole(before + inner + after, inner + more), (before, inner)


def test_wrapped_lines_take_linear_time():
    words = "".join(f"{hashlib.md5(str(k).encode()).hexdigest()[: k % 31 + 1]}\n" for k in range(100_000))
    for text in ("x" * 1_000_000, "abcdefgh\n" * 100_000, words, "x" * 500_000 + " " * 500_000):
        began = time.process_time()
        list(S.unwrap(text))
        assert time.process_time() - began < 20


FILL = b"Some words, and more of them. " * 1000
SHORT = planted(3).encode()


@pytest.mark.parametrize("pack", [
    lambda: gzip.compress(FILL) + gzip.compress(SHORT),
    lambda: bz2.compress(FILL) + bz2.compress(SHORT),
    lambda: lzma.compress(FILL) + lzma.compress(SHORT),
    lambda: zlib.compress(FILL) + zlib.compress(SHORT),
    lambda: gzip.compress(b"") + gzip.compress(SHORT) + b"\0" * 100,
    lambda: gzip.compress(FILL) + b"\n" + SHORT,
    lambda: gzip.compress(SHORT + b"\0" * 10_000),  # as tar pads
    lambda: gzip.compress(bytes(range(256)) + SHORT),
    lambda: gzip.compress(b"BZh is no bzip2. " + FILL * 5 + SHORT),
    lambda: gzip.compress(gzip.compress(FILL) + gzip.compress(SHORT)),
    lambda: gzip.compress(b"".join(FILL for _ in range(3_000)) + SHORT),  # 90 MB
    lambda: gzip.compress("é, ".encode() * 30_000_000 + SHORT, 1),
    lambda: gzip.compress(FILL * 200 + base64.b64encode(gzip.compress(FILL * 200 + SHORT))),
])
def test_compressed_layers_are_read_whole(pack):
    data = pack()
    inner = base64.b64encode(data).decode()
    assert whole(f"see ({inner}) there", inner)
    if len(data) < 100_000:
        inner = "".join(f"%{c:02X}" for c in data)
        assert whole(f"see ({inner}) there", inner)


def test_windows_cut_nothing(monkeypatch):
    monkeypatch.setattr(S, "PIECE", 64)
    monkeypatch.setattr(S, "WINDOW", 100)
    for k in range(200):
        text = f"{'Words, é and more; ' * (k % 23)}{'x' * k} token = abcdefgh{k} {base64.b64encode(planted(k).encode()).decode()}, {'tail; ' * (k % 7)}"
        windows = [w for w, _ in S._as_texts(gzip.compress(text.encode()))]
        assert "".join(windows) == text
        assert sum(len(S.scan(w)) for w in windows) == len(S.scan(text)) == 1
        inner = base64.b64encode(gzip.compress(text.encode())).decode()
        assert whole(inner, inner)


def test_escapes_map_letter_by_letter():
    text = "x token%3D%22abcdefgh1 y \\u0074oken=ABCDEFGH"
    base, added = S.find_secrets(text)
    spans = {text[a:b] for _, (_, a, b) in added}
    assert spans == {"token%3D%22abcdefgh1", "\\u0074oken=ABCDEFGH"}


def test_cycles_and_bombs_end():
    text = "a"
    for _ in range(12):
        text = urllib.parse.quote(text, safe="") + base64.b64encode(text.encode()).decode()
    S.find_secrets(text)
    bomb = base64.b64encode(gzip.compress(b"a " * 5_000_000)).decode()
    assert S.find_secrets(bomb) == ([], [])


def test_queries(spark):
    rows = {(r.doc_id, r.base_sha256): r for r in S.scan_secrets(table(spark)).collect()}
    for r in ROWS:
        base = brute(r[1] or "")
        got = rows[r[0], hashlib.sha256(S.joined(base).encode()).hexdigest()]
        assert (got.n_assign, got.n_access, got.n_hex) == tuple(sum(s[0] == k for s in base) for k in S.KINDS)
        assert got.spans == S.joined(base)
    assert S.scan_secrets(table(spark)).count() == len(ROWS)
    assert S.scan_secrets(table(spark, [])).count() == 0


def test_redaction_keeps_the_rest(spark):
    docs = spark.createDataFrame([(1, f"a {SECRET} b", "en", "s", 1, 1, "n", 0.5, "b", "h"), (2, None, None, None, None, 1, "n", 0.5, "b", "h"), (3, "clean text", "en", "s", 3, 1, "n", 0.5, "b", "h")], SCHEMA)
    out = S.redact_secrets(docs)
    assert out.schema == docs.schema
    assert {r.doc_id: r.text for r in out.collect()} == {1: "a [SECRET] b".replace("[SECRET] b", '[SECRET]" b'), 2: None, 3: "clean text"}


def test_against_the_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in S.scan_secrets(docs).collect():
        base = brute(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(S.joined(base).encode()).hexdigest()
        assert set(S.joined(base).split(",")) <= set(r.spans.split(","))


def nested(escape, layers, secret="token=abcdefgh12"):
    """A secret whose first letter is under so many layers of escapes."""
    return escape(layers) + secret[1:]


CHAINS = [
    lambda n: "%" + "25" * (n - 1) + "74",
    lambda n: "\\" + "u005c" * (n - 1) + "u0074",
    lambda n: "\\" + "x5cx5c"[: 3] * (n - 1) + "x74",
    lambda n: "\\" + "u{00005c}" * (n - 1) + "u{74}",
    lambda n: "%" + "5cu0025" * (n // 2) + "74",
    lambda n: "%" + "5cu{25}" * (n // 2) + "74",
]


@pytest.mark.parametrize("chain", CHAINS)
@pytest.mark.parametrize("layers", [2, 7, 31, 32, 33, 34, 40, 5_000])
def test_deep_escapes(chain, layers):
    inner = nested(chain, layers)
    text = f"Before it, {inner}, and after"
    began = time.process_time()
    _, added = S.find_secrets(text)
    assert time.process_time() - began < 4
    assert ("assign", 11, 11 + len(inner)) in {s for _, s in added}
    assert S.redacted(text) == "Before it, [SECRET], and after"


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["%", "25", "74", "\\", "u0025", "u005c", "x41", "u{25}", "u{", "}", "C3", "%C3%A9", "%F0%9F%98%80", "\\ud83d\\ude00", "\\ud83d", "é", "4", "1", "z", ",", " "]), max_size=16).map("".join))
def test_all_escapes_at_once_are_the_layers_one_by_one(text):
    now, back = text, None
    while got := S._unescaped(now, []):
        # here each stretch is looked at; without letters apart that is all of it
        if S.APART.search(now):
            return
        now, back = got[1], got[2] if back is None else got[2].through(back)
    settled = S._settled(text)
    assert (settled[1] if settled else text).lower() == now.lower()
    if settled and back is not None and not set(now) & set("%\\"):
        assert [settled[2].back(i, i + 1) for i in range(len(now))] == [back.back(i, i + 1) for i in range(len(now))]


@pytest.mark.parametrize("layers", [800, 100_000])
def test_deep_escapes_in_long_texts_take_linear_time(layers):
    text = "some words of a text and so on " * 3_000 + "%" + "25" * layers + "41" + "\\u005cu0025" * 20_000
    began = time.process_time()
    S.find_secrets(text + "x" * 80_000)
    assert time.process_time() - began < 30


@pytest.mark.parametrize("before", ["https://h/dl/", "see/files/v2/x/", "a-b_c-", "https://host.example/p/q-r/"])
@pytest.mark.parametrize("pack", [bytes, gzip.compress, bz2.compress, lzma.compress, zlib.compress])
def test_base64_after_a_path(before, pack):
    for k in range(40):
        inner = base64.b64encode(pack(planted(k).encode())).decode()
        text = f"get {before}{inner}, now"
        _, added = S.find_secrets(text)
        assert any(s[0] == "assign" and s[2] <= text.index(",") for _, s in added), text
    began = time.process_time()
    S.find_secrets("/H4sIabcd" * 20_000 + "/" + "/ab/cd_ef-gh" * 30_000)
    assert time.process_time() - began < 20


def test_words_of_one_case_are_decoded():
    assert S.find_secrets("nothing of note in understandings or ABCDEFGHIJKLMNOP")[1] == []


def test_bytes_that_are_no_letters_stay():
    _, added = S.find_secrets("caf%E9%20%74oken%3Dabcdefgh1 \\ud800\\u0074oken=abcdefgh2")
    assert [s for _, s in added] == [("assign", 9, 28), ("assign", 35, 55)]


def test_streams_that_open_each_other_end():
    a = gzip.compress(SHORT)
    for _ in range(40):
        a = gzip.compress(a)
    inner = base64.b64encode(a).decode()
    assert whole(f"see ({inner}) there", inner)


@pytest.mark.parametrize("data", [
    "café password = hunter2hunter2 ok".encode("latin-1"),
    "ÿÿÿ".encode("utf-16") + b"\x00\xff\xfe api_key: abcdefgh12345 \x80\x81",
    bytes(range(256)) + b"token=abcdefgh12" + bytes(range(255, 127, -1)),
    "Ключ: secret=abcdefgh99".encode("cp1251"),
    b"\xff" + base64.b64encode(b"\xe9 password = hunter2hunter2 \xe9"),
])
def test_base64_of_other_encodings(data):
    for encode in (base64.b64encode, base64.urlsafe_b64encode):
        inner = encode(data).decode()
        for before in ("", "see (", "https://h/dl/", "--data-"):
            text = f"{before}{inner}, after"
            _, added = S.find_secrets(text)
            assert any(s[0] == "assign" and s[2] <= text.index(",") for _, s in added), text
    wrapped = wrap(data * 3, 20, "\n")
    assert any(s[0] == "assign" for _, s in S.find_secrets(f"({wrapped})")[1])


def test_a_secret_that_shows_in_a_deep_layer_only():
    """base64 whose first letter is under 40 layers, and that a letter under 41 makes unreadable."""
    run = base64.b64encode(b"password = hunter2hunter2 and 30 m--").decode()
    assert len(run) % 4 == 0 and "=" not in run
    inner = f"%{'25' * 39}{ord(run[0]):02x}{run[1:]}%{'25' * 40}41"
    text = f"See, {inner}, there"
    got = [p for p, s in S.find_secrets(text)[1] if s[0] == "assign"]
    assert len(got) == 1 and got[0].count("url") == 40 and got[0].endswith("base64")
    few = S.Limits(letters=0, times=8)
    assert not [s for _, s in S.find_secrets(text, few)[1] if s[0] == "assign"]
    assert [s for _, s in S.find_secrets(text, S.Limits(letters=None))[1] if s[0] == "assign"]


def test_large_xz_dictionaries_are_read():
    data = lzma.compress(planted(4).encode(), filters=[{"id": lzma.FILTER_LZMA2, "dict_size": 1 << 20}])
    size = (data[12] + 1) * 4
    at = data.index(b"\x21\x01", 12, 12 + size) + 2
    head = bytearray(data[12 : 12 + size - 4])
    head[at - 12] = 37  # 1.5 GiB, the most that xz writes
    data = data[:12] + bytes(head) + zlib.crc32(head).to_bytes(4, "little") + data[12 + size :]
    assert lzma.decompress(data).decode() == planted(4)
    inner = base64.b64encode(data).decode()
    assert whole(f"see ({inner}) there", inner)


def test_longest_window_is_a_parameter(monkeypatch):
    monkeypatch.setattr(S, "PIECE", 64)
    monkeypatch.setattr(S, "WINDOW", 100)
    run = base64.b64encode(gzip.compress(bytes(range(256)) * 40 + planted(2).encode())).decode()
    inner = base64.b64encode(gzip.compress(run.encode())).decode()
    found = lambda longest: [s for _, s in S.find_secrets(inner, S.Limits(longest=longest))[1] if s[0] == "assign"]
    assert found(64 << 20) and not found(256)


def test_digits_of_escapes_are_no_secrets():
    for layers in (40, 300, 5_000):
        text = f"Before, %{'25' * layers}41, after"
        assert S.find_secrets(text)[1] == []
    real = "0123456789abcdef" * 2
    for inner in (f"%41{real}", f"\\x41{real}", f"\\u0041{real}", f"%2541{real}", f"%e9{real}", f"\\ud800{real}"):
        spans = [s for _, s in S.find_secrets(f"is {inner}, after")[1]] + S.scan(f"is {inner}, after")
        assert any(k == "hex" and a <= len(inner) + 3 - len(real) and b == len(inner) + 3 for k, a, b in spans), inner


WRAPPERS = {
    "url": urllib.parse.quote,
    "url of all": lambda x: "".join(f"%{c:02x}" for c in x.encode()),
    "unicode": lambda x: "".join(f"\\u{ord(c):04x}" for c in x),
    "base64": lambda x: base64.b64encode(x.encode()).decode(),
    "base64, URL-safe": lambda x: base64.urlsafe_b64encode(x.encode()).decode().rstrip("="),
    "base64, wrapped": lambda x: base64.encodebytes((x * 3).encode()).decode(),
    "base64 of Latin-1": lambda x: base64.b64encode(("é" + x).encode("latin-1")).decode(),
    "base64 of gzip": lambda x: base64.b64encode(gzip.compress(x.encode())).decode(),
    "base64 of xz": lambda x: base64.b64encode(lzma.compress(x.encode())).decode(),
    "url of base64 of zlib": lambda x: urllib.parse.quote(base64.b64encode(zlib.compress(x.encode())).decode(), safe=""),
    "base64 of unicode of base64": lambda x: base64.b64encode("".join(f"\\u{ord(c):04x}" for c in base64.b64encode(x.encode()).decode()).encode()).decode(),
}


def recall(texts):
    """By wrapper: the share of secrets planted in texts, one in each, that an added or base span covers, and added spans elsewhere in a text."""
    out = {}
    for k, text in enumerate(texts):
        name = list(WRAPPERS)[k % len(WRAPPERS)]
        inner = WRAPPERS[name](f"note: api_key = {hashlib.md5(str(k).encode()).hexdigest()[:24]}?>")
        at = text.find(" ", len(text) // 2) + 1
        planted_text = f"{text[:at]}({inner}) {text[at:]}"
        before = S.find_secrets(text)[1]
        base, added = S.find_secrets(planted_text)
        spans = [s for _, s in added] + base
        hit = any(kind == "assign" and a >= at and b <= at + len(inner) + 1 for kind, a, b in spans)
        other = sum(not at <= a <= at + len(inner) for _, (_, a, b) in added) - len(before)
        n = out.setdefault(name, [0, 0, 0])
        out[name] = [n[0] + 1, n[1] + hit, n[2] + other]
    return out


def test_recall_of_planted_secrets():
    import pyarrow.parquet as pq

    texts = [t or "" for t in pq.read_table("/root/testdata/sf0.01/documents.parquet")["text"].to_pylist()]
    for name, (n, hit, other) in recall(texts).items():
        assert hit == n and other <= 0, name
