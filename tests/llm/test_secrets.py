import base64
import bz2
import gzip
import re
import urllib.parse

from veilframe.llm import secrets

SECRET = 'token = "abcd1234efgh"'


def base(text):
    """The contract's patterns, literally."""
    found = []
    word = "".join
    assign = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I)
    found += [(m.start(), 0, m.end()) for m in assign.finditer(text) if len(m.group(1)) >= 8]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m.group()) >= 16]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m.group()) >= 32]
    return sorted(found)


def spans(text, only_base=False):
    return [(s["start"], secrets.KINDS.index(s["kind"]), s["end"]) for s in secrets.find(text) if s["base"] or not only_base]


def test_base_spans_are_those_of_the_plain_patterns():
    for text in ("", SECRET, "TOKEN: x token: y token: abcdefghij", "token=token=abcdefgh", "AKIA" * 5 + "x AKIAAB", "a" * 31 + " " + "0f" * 20,
                 "ſecret=abcdefghij", "passwd:'a.b/c_d-e=f'", "é api_key = é apikey=12345678"):
        assert spans(text, only_base=True) == base(text)


def encoded(text):
    plain = base64.b64encode(text.encode()).decode()
    yield plain
    yield urllib.parse.quote(text, safe="")
    yield "".join(f"\\u{ord(c):04x}" for c in text)
    yield "".join(f"&#x{ord(c):x};" for c in text)
    yield base64.b64encode(gzip.compress(text.encode())).decode()
    yield base64.b64encode(gzip.compress(bz2.compress(text.encode()))).decode()
    yield base64.b64encode(("see " + plain + " there").encode()).decode()
    yield urllib.parse.quote(base64.b64encode(gzip.compress(text.encode())).decode(), safe="")


def test_layers_are_unwrapped_and_mapped_back():
    for inner in encoded(SECRET):
        text = f"é before {inner} after"
        found = [s for s in secrets.find(text) if not s["base"]]
        assert found, inner
        for s in found:
            assert 9 <= s["start"] < s["end"] <= 9 + len(inner) + 1


def test_a_span_is_widened_by_decoding_and_the_plain_one_stays():
    assert spans("token=abcdefgh%2Fij") == [(0, 0, 14), (0, 0, 19)]


def test_cycles_and_damaged_layers_end():
    assert secrets.find("%25" * 200) == []
    broken = base64.b64encode(gzip.compress(SECRET.encode() * 50)[:60]).decode()
    secrets.find(broken)


def test_table(frame):
    rows = [(1, None), (2, ""), (3, SECRET), (3, SECRET), (None, SECRET), (4, "x " * 200_000 + SECRET)]
    df = frame([(*r, "a", "b") for r in rows], "doc_id long, text string, secrets string, k0 string")
    got = sorted(((r["doc_id"] or 0, len(r["secrets"])) for r in secrets.scan(df).collect()))
    assert got == [(0, 1), (1, 0), (2, 0), (3, 1), (3, 1), (4, 1)]
    assert secrets.scan(df.limit(0)).count() == 0
    masked = {r["doc_id"]: r["masked"] for r in secrets.mask(df).collect()}
    assert masked[1] is None and masked[3] == '[SECRET]"'


def glued():
    secret = b'password = "hunter2abcdef" '
    for raw in (secret, gzip.compress(secret, mtime=0), bz2.compress(secret)):
        for code in (base64.b64encode(raw).decode().rstrip("="), base64.urlsafe_b64encode(raw).decode().rstrip("=")):
            for before in ("", "https://x.org/data/", "user_", "a-b/c", "ab", "Please\n", "Please rotate\nsoonest\n"):
                for behind in ("", "\nPlease rotate", "/next", "_x", "\nPlease\nrotate it"):
                    yield before, code, behind
    lines = base64.encodebytes(b"some words before it, " + secret + b" and behind " * 9).decode().rstrip("=\n")
    yield "data/", lines, "\nPlease rotate"


def test_base64_with_words_glued_before_and_behind():
    for before, code, behind in glued():
        text = f"see {before}{code}{behind}"
        found = [s for s in secrets.find(text) if not s["base"]]
        assert any(4 + len(before) <= s["start"] < 4 + len(before) + len(code) for s in found), text
        assert "[SECRET]" in secrets.masked(text)


def test_text_beside_encoded_secrets_stays():
    code = base64.b64encode(b'password = "hunter2abcdef" ').decode()
    start, end = len("https://x.org/data/"), len("https://x.org/data/") + len(code)
    got = secrets.masked(f"https://x.org/data/{code}\nPlease rotate")
    assert got.startswith("https://x.org/data/") and got.endswith("\nPlease rotate")
    assert all(start <= s["start"] < s["end"] <= end for s in secrets.find(f"https://x.org/data/{code}\nPlease rotate"))


def test_bytes_that_are_no_text_only_spoil_themselves():
    quoted = "".join(f"%{b:02X}" for b in b"\xff" + SECRET.encode() + b"\xfe")
    assert [s["depth"] for s in secrets.find(quoted)] == [1]
    assert secrets.find(base64.b64encode(b"\xff\xfe\x00" + SECRET.encode() + b"\xff").decode())
