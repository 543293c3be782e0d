"""Rules on text that are plain expressions; each has a twin in SQL in the catalog."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.markdown import CJK
from ..functions.preflight import EDITOR, NOTEBOOK

BLANK = r"[ \t\n\r\f]+"


def tidy(text: Column) -> Column:
    """White space collapsed, none before closing punctuation or after an opening bracket."""
    text = F.regexp_replace(text, r"[\t\r\n ]+", " ")
    text = F.regexp_replace(text, r" +([,.;:!?，。；：！？、)])", "$1")
    return F.btrim(F.regexp_replace(text, r"([(]) +", "$1"), F.lit(" \t\n\r"))


def normalized(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, BLANK, " "))


def longest_ticks(text: Column) -> Column:
    return F.coalesce(F.array_max(F.transform(F.regexp_extract_all(text, F.lit("(`+)"), 1), F.length)), F.lit(0))


def markers(html: Column) -> tuple[Column, Column]:
    """Whether the page has marks of a notebook, and of a virtualised editor."""
    low = F.lower(html)
    return tuple(F.greatest(*(low.contains(m) for m in own)) for own in (NOTEBOOK, EDITOR))


def dollar_spacing(line: Column) -> Column:
    """Blanks around formulas as GitHub wants them."""
    for rx, new in (("\u00a0(?=\\$)", " "), ("(?<=\\$)\u00a0", " "), (" {2,}(?=\\$)", " "), ("(?<=\\$) {2,}", " "), (f"([{CJK}])\\$(?!\\$)", "$1 \\$"), (f"(?<!\\$)\\$([{CJK}])", "\\$ $1")):
        line = F.regexp_replace(line, rx, new)
    return line


def promoted(line: Column) -> Column:
    s = F.btrim(line, F.lit(" \t\r"))
    inner = F.substr(s, F.lit(2), F.length(s) - 2)
    return F.when((F.length(s) > 2) & s.startswith("$") & s.endswith("$") & ~F.contains(inner, F.lit("$")) & (F.trim(inner) != ""), F.concat(F.lit("$$"), inner, F.lit("$$"))).otherwise(line)


def data_uri_bytes(src: Column) -> Column:
    """About how many bytes a data URI holds; 0 for anything else."""
    comma = F.locate(",", src)
    head, payload = F.substr(src, F.lit(1), comma - 1), F.substr(src, comma + 1)
    coded = F.length(F.regexp_replace(F.regexp_replace(payload, r"\s+", ""), "=+$", "")) * 3
    return F.when(src.startswith("data:") & (comma > 0), F.when(head.contains(";base64"), F.floor(coded / 4)).otherwise(F.length(payload))).otherwise(0)


def page_path(url: Column, base: str) -> Column:
    """The page's Markdown file below the base; null outside it."""
    base = base.rstrip("/")
    plain = F.regexp_replace(url, r"[?#].*$", "")
    rest = F.substr(plain, F.lit(len(base) + 2))
    stem = F.btrim(rest, F.lit("/"))
    name = F.when(stem == "", "index").when(rest.endswith("/"), F.concat(stem, F.lit("/index"))).otherwise(stem)
    return F.when((plain == base) | plain.startswith(base + "/"), F.concat(name, F.lit(".md")))


def url_list(urls: DataFrame, skip: list[str] | None = None, limit: int | None = None) -> DataFrame:
    """ord, url: stripped, without blank lines and those that have a skipped part; the first ones in order where a limit is asked for."""
    df = urls.select("ord", F.btrim("url", F.lit(" \t\r\n")).alias("url")).filter("url <> ''")
    for s in skip or []:
        df = df.filter(~F.contains("url", F.lit(s)))
    return df if limit is None else df.orderBy("ord").limit(limit)
