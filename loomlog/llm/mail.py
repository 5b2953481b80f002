"""Tolerant reading of raw messages: text parts decoded, and what is left open at the end."""

from __future__ import annotations

import binascii
import html
import re
import unicodedata
from dataclasses import dataclass, field

HEADER = re.compile(r"[A-Za-z][A-Za-z0-9-]*:[^\n]*\n|[A-Za-z][A-Za-z0-9-]*:[^\n]*$")
BLANK = re.compile(r"\r?\n\r?\n")
TYPE = re.compile(r"(?im)^content-type:[ \t]*([^;\s]*)([^\n]*)")
ENCODING = re.compile(r"(?im)^content-transfer-encoding:[ \t]*(\S+)")
BOUNDARY = re.compile(r'(?i)boundary=(?:"([^"\n]*)"?|([^\s;]+))')
CHARSET = re.compile(r'(?i)charset="?([\w.:-]+)')
NOT_BASE64 = re.compile(r"[^A-Za-z0-9+/]+")
HIDDEN = re.compile(r"(?is)<!--.*?(?:-->|$)|<(script|style)\b.*?(?:</\1\s*>|$)")
INLINE = re.compile(r"(?i)</?(?:a|b|i|u|s|em|strong|span|font|small|big|sub|sup|code|tt|mark|ins|del|abbr|wbr)\b[^<>]*>")
BREAKS = re.compile(r"(?i)</?(?:p|div|li|ul|ol|tr|table|h\d|blockquote|body|html|head|hr)\b[^<>]*>")
TAG = re.compile(r"<[/!?]?[A-Za-z][^<>]*(?:>|$)")


@dataclass
class Message:
    """``parts``: (content type, text) of text parts; ``open``: why the end is inside a block; ``plain_end``: the end is plain text of the last part."""

    parts: list[tuple[str, str]] = field(default_factory=list)
    open: str = ""
    plain_end: bool = False
    body: bool = False


def html_text(source: str) -> str:
    """The text of a page; inline tags vanish, all others part words."""
    t = HIDDEN.sub(" ", source)
    t = TAG.sub(" ", BREAKS.sub("\n\n", INLINE.sub("", t)))
    return html.unescape(t) if "&" in t else t


def _split(text: str) -> tuple[str, str]:
    """Headers (unfolded) and body; a text that doesn't begin with a header is all body."""
    if text[:1] in "\r\n":
        return "", text.lstrip("\r\n")
    if not HEADER.match(text):
        return "", text
    m = BLANK.search(text)
    head, body = (text, "") if m is None else (text[: m.start()], text[m.end() :])
    return re.sub(r"\r?\n[ \t]+", " ", head).replace("\r", ""), body


def _bytes_text(raw: bytes, charset: str) -> tuple[str, bool]:
    """Decoded text, and whether its last character was cut."""
    try:
        return raw.decode(charset), False
    except LookupError:
        return _bytes_text(raw, "utf-8")
    except UnicodeDecodeError as e:
        return raw.decode(charset, "replace" if e.start < len(raw) - 4 else "ignore"), e.start >= len(raw) - 4


def _leaf(kind: str, rest: str, encoding: str, body: str, out: Message, last: bool) -> None:
    charset = m[1] if (m := CHARSET.search(rest)) else "utf-8"
    is_text = kind.startswith("text/") or not kind
    open_, text = "", body
    if encoding == "base64":
        code = NOT_BASE64.sub("", body)
        n = len(code)
        if "=" not in body and n % 4:
            open_ = "base64"
        if is_text:
            code = code[: n - 1] if n % 4 == 1 else code
            text, broken = _bytes_text(binascii.a2b_base64(code + "=" * (-len(code) % 4)), charset)
            open_ = open_ or ("base64" if broken else "")
    elif encoding == "quoted-printable":
        if re.search(r"=[0-9A-Fa-f]?\s*$", body):
            open_ = "quoted"
        if is_text:
            text, broken = _bytes_text(binascii.a2b_qp(body.encode("utf-8", "replace")), charset)
            open_ = open_ or ("quoted" if broken else "")
    low = text.lower() if kind == "text/html" else ""
    if kind == "text/html" and "<html" in low and "</html" not in low:
        open_ = open_ or "markup"
    if is_text:
        out.parts.append((kind or "text/plain", html_text(text) if kind == "text/html" else text))
    out.body = out.body or bool(body.strip())
    if last:
        out.open = out.open or open_
        out.plain_end = is_text and kind != "text/html"


def _inside(text: str, out: Message, last: bool) -> list[tuple[str, bool]]:
    """Reads one part; returns the raw parts in it, and whether each ends where the text does (a message in a message)."""
    head, body = _split(text)
    m = TYPE.search(head)
    kind, rest = (m[1].lower(), m[2]) if m else ("", "")
    b = BOUNDARY.search(rest) if kind.startswith("multipart/") else None
    mark = (b[1] or b[2] or "") if b else ""
    if mark:
        pieces = body.split("--" + mark)
        end = next((k for k, p in enumerate(pieces) if k and p.startswith("--")), 0)
        out.body = out.body or bool(body.strip())
        if last:
            out.open = "" if end or not body.strip() else "multipart"
            out.plain_end = False
        if pieces[0].strip() and len(pieces) == 1:
            out.parts.append(("text/plain", pieces[0]))
        return [(p.removeprefix("\r").removeprefix("\n"), False) for p in pieces[1 : end or None]]
    if kind == "message/rfc822":
        return [(body, last)]
    enc = ENCODING.search(head)
    _leaf(kind, rest, enc[1].lower() if enc else "", body, out, last)
    return []


def parse(text: str | None) -> Message:
    """Reads a raw message; null and empty texts have no parts and no body.

    Parts stand in the order of the text, however deep they are nested.
    """
    out = Message()
    todo = [(text, True)] if text else []
    while todo:
        part, last = todo.pop()
        todo += reversed(_inside(part, out, last))
    return out


WORD = re.compile(r"[^\W_]+")


def words(text: str) -> list[str]:
    """Runs of letters and digits, in lower case, composed characters."""
    if not text.isascii():
        text = unicodedata.normalize("NFC", text)
    return WORD.findall(text.lower())
