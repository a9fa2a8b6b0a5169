"""Forms of keys that are wrapped, escaped, URL-safe or encrypted."""

import base64
import textwrap
import time

import pytest

from test_operators import der, rsa_like_key
from vigilake.llm import secrets


def found(text):
    return [(k, text[a:b]) for k, a, b in secrets.find_spans(text) if k in ("pem", "key")]


def armoured(label, body):
    return f"-----BEGIN {label}-----\n{body}\n-----END {label}-----"


def test_forms_of_keys():
    key = base64.b64encode(rsa_like_key()).decode()
    for width in (64, 76):
        lines = "\n".join(textwrap.wrap(key, width))
        assert ("key", lines) in found(f"some words\n{lines}\nmore words")
        assert ("pem", armoured("PRIVATE KEY", lines)) in found(f"x {armoured('PRIVATE KEY', lines)}")
        escaped = armoured("PRIVATE KEY", lines).replace("\n", "\\n")
        assert ("pem", escaped) in found(f'é {{"key": "{escaped}"}}')
    url = base64.urlsafe_b64encode(der(0x30, der(2, b"\0") + der(2, b"\xfb\xef\xff" * 40))).decode()
    assert "-" in url or "_" in url
    assert ("key", url) in found(f"see {url} there")
    assert not found(f"see {url[4:]} there")


def test_encrypted_keys():
    method = der(0x30, der(6, bytes.fromhex("2a864886f70d01050d")) + der(0x30, der(0x30, b"")))
    key = der(0x30, method + der(4, b"\x07" * 96))
    body = base64.b64encode(key).decode()
    assert [k for k, _ in found(armoured("ENCRYPTED PRIVATE KEY", body))] == ["pem", "key"]
    digest = der(0x30, der(0x30, der(6, bytes.fromhex("608648016503040201")) + der(5, b"")) + der(4, b"\x07" * 32))
    assert not found(armoured("ENCRYPTED PRIVATE KEY", base64.b64encode(digest).decode()))
    head = "Proc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,00112233445566778899AABBCCDDEEFF\n\n"
    whole, cut = (base64.b64encode(b"\x9c" * n).decode() for n in (96, 95))
    assert [k for k, _ in found(armoured("RSA PRIVATE KEY", head + whole))] == ["pem"]
    assert not found(armoured("RSA PRIVATE KEY", head + cut))


LINE = base64.b64encode(bytes(range(48))).decode()


@pytest.mark.parametrize("unit", [
    "\\", "eyJ", "eyJabcdefgh.", LINE + "\n", LINE + "=\n ", "a:-----BEGIN PRIVATE KEY-----\n", "-----BEGIN A ", "\\n", "password ",
    "secret=\"", "0a", "AKIA", LINE[:39] + "\\n", "DEK-Info: A",
])
def test_a_megabyte_is_read_in_linear_time(unit):
    text = unit * (1_000_000 // len(unit))
    before = time.process_time()
    secrets.find_spans(text)
    assert time.process_time() - before < 2


def test_signed_tokens_after_other_text():
    part = lambda text: base64.urlsafe_b64encode(text.encode()).decode().rstrip("=")
    token = f"{part('{\"alg\": \"HS256\"}')}.{part('{\"sub\": \"1\"}')}.{part('signature')}"
    for before in ("", "Bearer ", "token=", '"', "x." , "\\n"):
        spans = [text for text in [(before + token)[a:b] for k, a, b in secrets.find_spans(before + token) if k == "jwt"]]
        assert spans == [token], before
