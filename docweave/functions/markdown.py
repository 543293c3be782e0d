"""Rules on Markdown text: fences, greetings, mathematics as GitHub reads it, captions, placeholders."""

from __future__ import annotations

import re

# -- fences

_QUOTE = re.compile(r" {0,3}>[ \t]?")
_RUN = re.compile(r"( *)(`{3,}|~{3,})(.*)$")
_ITEM = re.compile(r" {0,3}(?:[-+*]|\d{1,9}[.)])[ \t]+(?=`{3}|~{3})")


def _unquoted(line: str) -> tuple[int, str]:
    depth = at = 0
    while m := _QUOTE.match(line, at):
        depth, at = depth + 1, m.end()
    return depth, line[at:]


class Fence(ValueError):
    """A block that isn't closed."""


def fences(text: str) -> list[dict]:
    """Closed blocks (start_line, end_line, marker, marker_length, blockquote_depth, container_indent); Fence where one isn't closed."""
    if "```" not in text and "~~~" not in text:
        return []
    found, now, near = [], None, None
    for number, line in enumerate(text.splitlines(), 1):
        depth, rest = _unquoted(line)
        if now is None:
            item = _ITEM.match(rest)
            m = _RUN.match(rest, item.end() if item else 0)
            if m and (item or len(m[1]) <= 3) and not (m[2][0] == "`" and "`" in m[3]):
                now, near = {"start_line": number, "end_line": 0, "marker": m[2][0], "marker_length": len(m[2]), "blockquote_depth": depth, "container_indent": m.start(2) if item else 0}, None
            continue
        m = _RUN.match(rest)
        if not m:
            continue
        least = now["container_indent"]
        wrong = (
            "blockquote depth does not match the opener" if depth != now["blockquote_depth"]
            else "closing fence uses a different marker" if m[2][0] != now["marker"]
            else "closing fence is shorter than the opener" if len(m[2]) < now["marker_length"]
            else (f"closing fence is outside the list-item content indentation {least}-{least + 3}" if least else "closing fence indentation exceeds three spaces") if not least <= len(m[1]) <= least + 3
            else "closing fence has trailing text" if m[3].strip()
            else None
        )
        if wrong:
            near = (number, wrong)
        else:
            found.append(now | {"end_line": number})
            now = None
    if now:
        raise Fence(f"invalid closing fence at line {near[0]}: {near[1]}; block opened at line {now['start_line']}" if near else f"unclosed fenced code block opened at line {now['start_line']}")
    return found


def fenced_lines(text: str) -> set[int]:
    return {n for b in fences(text) for n in range(b["start_line"], b["end_line"] + 1)}


def without_fences(text: str) -> str:
    """Fenced lines emptied; their number and endings stay."""
    inside = fenced_lines(text)
    return "".join(re.search(r"(?:\r\n|\n|\r)?\Z", line)[0] if n in inside else line for n, line in enumerate(text.splitlines(keepends=True), 1))


# -- greetings

_OPENERS = [r"你好[，,]\s*我是", r"(?:大家|同学们|各位)好[，,。！!]", r"亲爱的.{0,6}们好[，,。！!]", r"欢迎(?:来|回)到", r"欢迎(?:收听|阅读|学习)", r"你好[！!。]$"]
_CLOSERS = [r"我们下[节一]?[节课讲次]?(?:再)?见[！!。～~\s]*$", r"下节?课(?:再)?见[！!。～~\s]*$", r"欢迎你?(?:分享|转发)给.{0,20}朋友[，,。！!\s]*$", r"期待你的(?:反馈|分享|留言)[。！!\s]*$", r"我们下[次回]再?[见聊][！!。～~\s]*$"]
OPENER, CLOSER = re.compile("|".join(_OPENERS)), re.compile("|".join(_CLOSERS))
_SENTENCE = re.compile(r"[^。！？!?]*[。！？!?]+|[^。！？!?]+")
_STRUCTURE = re.compile(r"[#>|!]|```|\$\$|[-*+]\s")


def _bare(sentence: str) -> str:
    return sentence.strip().strip("*").strip()


def _opens(s: str) -> bool:
    return not re.search(r"[？?]\s*$", _bare(s)) and bool(OPENER.match(_bare(s)))


def _closes(s: str) -> bool:
    return bool(CLOSER.search(_bare(s)))


def _trimmed(line: str, last: bool) -> str | None:
    """The line without greeting sentences at that end; None where nothing stays."""
    if line.isascii():  # no greeting is
        return line
    s = line.strip()
    if _STRUCTURE.match(s):
        return line
    bold = len(s) > 4 and s[:2] == s[-2:] == "**" and "**" not in s[2:-2]
    parts = _SENTENCE.findall(s[2:-2] if bold else line)
    n = len(parts)
    if last:
        while parts and _closes(parts[-1]):
            parts.pop()
    else:
        while parts and _opens(parts[0]):
            parts.pop(0)
    if len(parts) == n:
        return line
    rest = "".join(parts).strip()
    return None if not rest else f"**{rest}**" if bold else rest


def without_greetings(text: str) -> str:
    text = text.replace("\r\n", "\n").replace("\r", "\n")
    if text.isascii():  # no greeting is
        out = text.strip("\n")
        return out + "\n" if out and text.endswith("\n") else out
    lines = text.split("\n")
    full = [i for i, line in enumerate(lines) if line.strip()]
    if full:
        lines[full[0]] = _trimmed(lines[full[0]], False)
        full = [i for i in full if lines[i] is not None]
    if full:
        lines[full[-1]] = _trimmed(lines[full[-1]], True)
    out = "\n".join(x for x in lines if x is not None).strip("\n")
    return out + "\n" if out and text.endswith("\n") else out


# -- mathematics

CJK = "\u4e00-\u9fff\u3000-\u303f\uff00-\uffef"
_SPACING = [(re.compile(a), b) for a, b in (("\u00a0(?=\\$)", " "), ("(?<=\\$)\u00a0", " "), (" {2,}(?=\\$)", " "), ("(?<=\\$) {2,}", " "), (rf"([{CJK}])\$(?!\$)", r"\1 $"), (rf"(?<!\$)\$([{CJK}])", r"$ \1"))]
_INLINE = re.compile(r"(?<!\$)\$(?!\$)(.+?)(?<!\$)\$(?!\$)")
_SLASHES = re.compile(r"(\\+)(.?)", re.DOTALL)


def spaced(line: str) -> str:
    if "$" in line:
        for rx, new in _SPACING[2:4] if line.isascii() else _SPACING:
            line = rx.sub(new, line)
    return line


def promoted(line: str) -> str:
    """A line that is one inline formula becomes a display formula."""
    s = line.strip()
    return f"$${s[1:-1]}$$" if len(s) > 2 and s[0] == s[-1] == "$" and "$" not in s[1:-1] and s[1:-1].strip() else line


def doubled(math: str) -> str:
    """Backslashes as they must be written so that, after GitHub has taken one layer, the formula is what was meant."""

    def run(m: re.Match) -> str:
        k, after = len(m[1]), m[2]
        odd = k % 2 == 1
        if after == "_" or (odd and after.isascii() and after.isalpha()):
            twice = False
        elif after and after.isascii() and after.isprintable() and not after.isalnum() and after != " ":
            twice = odd
        else:
            twice = odd or k // 2 % 2 == 1
        return m[1] * (1 + twice) + after

    return _SLASHES.sub(run, math)


def _inline(m: re.Match) -> str:
    return "$" + re.sub(r"(?<!\\)_", r"\\_", doubled(m[1])) + "$"


def math_escaped(text: str, fenced: set[int]) -> str:
    out, block = [], False
    for n, line in enumerate(text.split("\n"), 1):
        if n not in fenced:
            if line.strip() == "$$":
                block = not block
            elif block:
                line = doubled(line)
            elif "$" in line:
                line = _INLINE.sub(_inline, re.sub(r"\$\$(.+?)\$\$", lambda m: f"$${doubled(m[1])}$$", line))
        out.append(line)
    return text if block else "\n".join(out)


# -- captions

_CAPTION = re.compile(r"(?:\*\*)?(?:图|表|代码|清单|公式)\s*[A-Za-z0-9]+(?:[-–][A-Za-z0-9]+)?\u3000\S")
_CENTER = '<div align="center">'


def _is_caption(text: str) -> bool:
    return bool(_CAPTION.match(re.sub(r"</?strong>|\*\*", "", text.strip()).lstrip()))


def _centered(text: str) -> str:
    text = re.sub(r"</?strong>|\*\*", "", re.sub(r"</code>|<code(?:\s[^>]*)?>", "`", text.strip()))
    return f"{_CENTER}\n\n**{text}**\n\n</div>"


def captions(text: str, fenced: set[int]) -> str:
    if text.isascii():  # no caption is
        return text
    lines, out, i = text.split("\n"), [], 0
    while i < len(lines):
        line, s = lines[i], lines[i].strip()
        end = next((j for j in range(i + 1, len(lines)) if lines[j].strip() == "</div>"), 0) if s == _CENTER else 0
        if i + 1 in fenced:
            out.append(line)
        elif end:
            own = [x.strip() for x in lines[i + 1 : end] if x.strip()]
            out.extend([_centered(own[0])] if len(own) == 1 and _is_caption(own[0]) else lines[i : end + 1])
            i = end
        elif s.startswith(_CENTER) and s.endswith("</div>") and _is_caption(s[len(_CENTER) : -6]):
            out.append(_centered(s[len(_CENTER) : -6]))
        elif _CAPTION.match(line):
            out.append(_centered(line))
        else:
            out.append(line)
        i += 1
    return "\n".join(out)


# -- all together

PLACEHOLDER = re.compile(r"\{\{FORMULA:[^}]+\}\}")


def placeholders(text: str) -> list[tuple[int, str]]:
    inside = fenced_lines(text)
    return [(n, m) for n, line in enumerate(text.split("\n"), 1) if n not in inside for m in PLACEHOLDER.findall(line)]


def postprocessed(text: str) -> str:
    text = without_greetings(text)
    inside = fenced_lines(text)
    if "$" not in text and "****" not in text and text.isascii():
        return text  # captions aren't ASCII
    lines = [line if n in inside else promoted(spaced(line).replace("****", "")) for n, line in enumerate(text.split("\n"), 1)]
    text = math_escaped("\n".join(lines), inside)
    return captions(text, fenced_lines(text))
