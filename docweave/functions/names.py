"""Portable names, data URIs, image types and paths of documentation pages."""

from __future__ import annotations

import base64
import binascii
import hashlib
import posixpath
import re
import unicodedata
from urllib.parse import quote, unquote, unquote_to_bytes, urljoin, urlsplit

RESERVED = {"CON", "PRN", "AUX", "NUL"} | {f"{k}{i}" for k in ("COM", "LPT") for i in range(1, 10)}
EXTENSIONS = {"image/png": ".png", "image/jpeg": ".jpg", "image/gif": ".gif", "image/webp": ".webp", "image/svg+xml": ".svg"}


def package_name(title: str) -> str:
    """One basename for all that a document yields: NFKC, and one hyphen for whatever isn't a word character."""
    name = re.sub(r"(?:[^\w]|_|-)+", "-", unicodedata.normalize("NFKC", title)).strip("-")
    if not name:
        return "article"
    return f"article-{name}" if name.upper() in RESERVED else name


def numbered_name(title: str, ordinal: int) -> str:
    """``NN-name``; a number that the title begins with goes only if it is this one."""
    if ordinal < 1:
        raise ValueError("ordinals begin at 1")
    text = unicodedata.normalize("NFKC", title)
    m = re.fullmatch(r"\s*(\d{1,4})(?:\s*[|｜:：._-]\s*|\s+)(.+)", text)
    if m and int(m[1]) == ordinal:
        text = m[2]
    return f"{ordinal:02d}-{package_name(text)}"


_TOKEN = r"[\w!#$%&'*+.^`|~-]+"
_TYPE = re.compile(f"{_TOKEN}/{_TOKEN}", re.ASCII)
_PARAM = re.compile(f'{_TOKEN}=(?:"[^"]*"|{_TOKEN})', re.ASCII)


def data_uri(source: str) -> tuple[str, bytes]:
    """MIME type and bytes; ValueError where it isn't well formed."""
    head, comma, payload = source.partition(",")
    if head[:5].lower() != "data:" or not comma:
        raise ValueError("invalid data URI")
    mime, *params = head[5:].split(";")
    mime = mime.lower() or "text/plain"
    coded = bool(params) and params[-1].lower() == "base64"
    if not _TYPE.fullmatch(mime) or not all(_PARAM.fullmatch(p) for p in params[: len(params) - coded]):
        raise ValueError("invalid data URI media type")
    if coded:
        try:
            return mime, base64.b64decode(payload, validate=True)
        except (binascii.Error, ValueError) as bad:
            raise ValueError(f"invalid data URI payload: {bad}") from bad
    if re.search(r"%(?![0-9A-Fa-f]{2})", payload):
        raise ValueError("invalid data URI payload: malformed percent-encoding")
    return mime, unquote_to_bytes(payload)


def extension(mime: str) -> str:
    return EXTENSIONS.get(mime.lower(), ".bin")


def page_path(url: str, base: str) -> str:
    """Path of a page's Markdown below the base URL; ValueError outside it."""
    plain, base = re.split(r"[?#]", url, maxsplit=1)[0], base.rstrip("/")
    if plain != base and not plain.startswith(base + "/"):
        raise ValueError(f"{url} is not below {base}")
    rest = plain[len(base) + 1 :]
    stem = rest.strip("/")
    return (f"{stem}/index" if stem and rest.endswith("/") else stem or "index") + ".md"


def image_url(src: str | None, page: str) -> str:
    src = (src or "").strip()
    return src if not src or src.startswith("data:") else urljoin(page, src)


def local_image(url: str) -> str:
    """Where an image is kept, below the output folder."""
    if url.startswith("data:"):
        mime, data = data_uri(url)
        return f"assets/inline/{hashlib.sha1(data).hexdigest()[:16]}{extension(mime)}"
    path = unquote(urlsplit(url).path)
    return "assets/" + path.rsplit("assets/", 1)[-1].lstrip("/")


def relative_link(target: str, page_file: str) -> str:
    return quote(posixpath.relpath(target, posixpath.dirname(page_file) or "."), safe="/")


def safe_path(url: str) -> str | None:
    """local_image(), or None where it would lie outside the folder or the data URI isn't well formed."""
    try:
        path = local_image(url)
    except ValueError:
        return None
    return None if posixpath.normpath(path).startswith("..") or "\0" in path else path
