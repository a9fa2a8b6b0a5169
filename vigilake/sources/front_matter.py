"""The head of a markdown file: a flat YAML mapping of text values.

Read are plain and quoted scalars (over several lines, too), literal and folded blocks with
their chomping marks, lists in both spellings, comments, nulls, booleans and numbers. A
nested mapping is kept as its text. Anchors, tags and several documents are not read.
"""

from __future__ import annotations

import re

KEY = re.compile(r"""(?:"((?:[^"\\]|\\.)*)"|'((?:[^']|'')*)'|([^\s#'"\[\]{},&*!|>%@`-][^#:]*?|-[^\s#:][^#:]*?))[ \t]*:(?=\s|$)""")
BLOCK = re.compile(r"([|>])([+-]?)([1-9]?)([+-]?)[ \t]*(?:#.*)?$")
COMMENT = re.compile(r"(?:^|[ \t])#.*$")
NULLS = ("", "~", "null", "Null", "NULL")
TRUTHS = {word: value for value, words in ((True, "true yes on"), (False, "false no off"))
          for plain in words.split() for word in (plain, plain.capitalize(), plain.upper())}
ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "0": "\0", "/": "/", '"': '"', "\\": "\\", " ": " ", "e": "\x1b", "a": "\a", "b": "\b"}


class NotAMapping(ValueError):
    """The head is a list or a bare value."""


def _unescaped(text: str) -> str:

    return re.sub(r"\\(?:(x)([0-9a-fA-F]{2})|(u)([0-9a-fA-F]{4})|(U)([0-9a-fA-F]{8})|(.))", lambda m: (
        chr(int(m[2] or m[4] or m[6], 16)) if m[2] or m[4] or m[6] else ESCAPES.get(m[7], m[0])), text)


def _plain(text: str):
    """A bare scalar as the value it stands for."""
    if text in NULLS:
        return None
    if text in TRUTHS:
        return TRUTHS[text]
    if re.fullmatch(r"[-+]?(?:0|[1-9][0-9_]*)", text):
        return int(text.replace("_", ""))
    if re.fullmatch(r"[-+]?(?:[0-9][0-9_]*)?\.[0-9_]+(?:[eE][-+][0-9]+)?|[-+]?[0-9][0-9_]*\.(?:[eE][-+][0-9]+)?", text):
        return float(text.replace("_", ""))
    return text


def _scalar(text: str):
    text = text.strip()
    if len(text) > 1 and text[0] == text[-1] == '"':
        return _unescaped(text[1:-1])
    if len(text) > 1 and text[0] == text[-1] == "'":
        return text[1:-1].replace("''", "'")
    return _plain(text)


def _flow_items(text: str) -> list:
    parts = re.findall(r"""\s*("(?:[^"\\]|\\.)*"|'(?:[^']|'')*'|[^,\[\]]+)\s*(?:,|$)""", text.strip()[1:-1])
    return [_scalar(p) for p in parts]


def _folded(lines: list[str]) -> str:
    """Lines of a plain or quoted scalar: a line end is a space, an empty line a line end."""
    out, gap = lines[0], ""
    for line in lines[1:]:
        if not line:
            gap += "\n"
            continue
        out += (gap or " ") + line
        gap = ""
    return out


def _block(style: str, chomp: str, lines: list[str]) -> str:
    depth = min((len(x) - len(x.lstrip(" ")) for x in lines if x.strip()), default=0)
    body = [x[depth:] for x in lines]
    while body and not body[-1].strip():
        body.pop()
    kept = len(lines) - len(body)
    if style == "|":
        text = "\n".join(body)
    else:
        text, before, blank = "", None, 0
        for line in body:
            if not line:
                blank += 1
                continue
            deeper = line[0] in " \t" or before is not None and before[0] in " \t"
            text += "\n" * blank if before is None else "\n" * (blank + 1) if deeper else "\n" * blank or " "
            text, before, blank = text + line, line, 0
    return text + ("" if chomp == "-" or not body else "\n" * (1 + kept) if chomp == "+" else "\n")


def _closed(text: str) -> bool:
    """Whether a quoted or bracketed value ends on its line."""
    if text[0] == '"':
        return re.fullmatch(r'"(?:[^"\\]|\\.)*"', text) is not None
    if text[0] == "'":
        return re.fullmatch(r"'(?:[^']|'')*'", text) is not None
    return text.endswith("]")


def _stripped(text: str) -> str:
    """A value without the comment after it."""
    quoted = re.match(r"""("(?:[^"\\]|\\.)*"|'(?:[^']|'')*')[ \t]*(?:#.*)?$""", text)
    return quoted[1] if quoted else text if text[:1] in ("'", '"') else COMMENT.sub("", text).strip()


def read_front_matter(text: str) -> dict[str, str | None]:
    """Top-level keys and their values as text; nulls are None."""
    lines = text.split("\n")
    found: dict[str, str | None] = {}
    at = 0
    while at < len(lines):
        line = lines[at].rstrip("\r")
        if not line.strip() or line.lstrip().startswith("#"):
            at += 1
            continue
        key = KEY.match(line)
        if key is None:
            raise NotAMapping(line)
        name = next(g for g in key.groups() if g is not None).strip()
        rest = line[key.end():].strip()
        under = at + 1
        block = BLOCK.match(rest)
        # what belongs to the key: lines that are indented, or the items of its list
        listed = not _stripped(rest) if rest else True
        while under < len(lines) and (
            not lines[under].strip() or lines[under][:1] in (" ", "\t") or listed and re.match(r"-(?:\s|$)", lines[under])
        ):
            under += 1
        more = [x.rstrip("\r") for x in lines[at + 1:under]]
        at = under
        if block:
            value = _block(block[1], block[2] or block[4], more)
        else:
            value = _value(_stripped(rest), more)
        found[name] = None if value is None else str(value)
    return found


def _value(first: str, more: list[str]):
    if first[:1] in ('"', "'", "["):
        parts = [first]
        for line in more:
            if _closed(_folded(parts)):
                break
            parts.append(_stripped(line.strip()))
        whole = _folded(parts)
        return _flow_items(whole) if whole[0] == "[" else _scalar(whole)
    items = [line.strip() for line in more if line.strip() and not line.lstrip().startswith("#")]
    if not first and items and all(re.match(r"-(?:\s|$)", i) for i in items):
        return [_scalar(_stripped(i[1:].strip())) for i in items]
    if not first and not items:
        return None
    lines = [first] * bool(first) + [_stripped(line.strip()) for line in more]
    while lines and not lines[-1]:
        lines.pop()
    return _plain(_folded(lines)) if lines else None
