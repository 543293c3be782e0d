"""Quality rules by distribution divergence.

Each document has two histograms: six character classes (lower case, upper case, digits, white
space, sentence punctuation, all else) and the common words of its language beside all other words.
The reference of a language is the sum of the histograms of its documents: first of all of them, then
once more without those that are far from that first reference, if any are left.  Each value of lang
has its own reference, on its own list of common words or on a mixed one.  A document without a
language is judged by the nearest of all references; where a language of the lists has no labelled
documents, its reference is that of the unlabelled ones with most of its words.  A document is
rejected when the Jensen-Shannon distance (base 2, 0 to 1) of either histogram from the reference
is above a limit.  The limit falls with length, since short texts stray by chance, and texts under
a minimum length aren't judged.

Defined results: null text and text without any visible character are rejected as ``empty``; texts
under the minimum are kept as ``short``; null, blank and ``UNKNOWN`` are no
language, and without one, texts mostly in letters other than Latin, or with no reference at all, aren't
judged (no unlabelled text tells the norm of its script); repeated rows get the same verdict each; an empty table gives no rows; other
columns of the input, whatever their names, are neither read nor harmed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._util import scratch, side

#: Common words by language; und is for every other language.
COMMON = {
    "en": "the of and to in is that a it for on was".split(),
    "de": "der die und in den von zu das mit sich des ist".split(),
    "fr": "de la le et les des en un du que une est".split(),
    "es": "de la que el en y los se del las un por".split(),
    "und": "the de der of la die and le und to en que".split(),
}
LISTS = sorted(COMMON)
UNKNOWN = ("", "und", "unknown")
SLOTS = len(COMMON["und"])
CLASSES = {"lower": r"\p{Ll}+", "upper": r"\p{Lu}+", "digit": r"\p{Nd}+", "space": r"[ \t\n\r\f]+", "stop": r"[.,;:?'\"()-]+"}
CHAR_COLS = [f"c{i}" for i in range(len(CLASSES) + 1)]
WORD_COLS = [f"w{i}" for i in range(SLOTS + 1)]

MIN_CHARS = 60
MIN_WORDS = 20
CHAR_LIMIT, CHAR_SLACK = 0.11, 1.6
WORD_LIMIT, WORD_SLACK = 0.14, 1.6
#: A document this far from the first reference has no part in the second.
TRIM_CHAR, TRIM_WORD = 0.25, 0.45


def _sum_terms(terms: list[str]) -> str:
    return " + ".join(terms)


def sql_distance(own: list[str], ref: list[str], own_n: str, ref_n: str) -> str:
    """DuckDB text of the distance of two histograms given by their columns; 1 where either is empty."""
    parts = []
    for a, b in zip(own, ref, strict=True):
        p, q = f"({a} * 1.0e0 / {own_n})", f"({b} * 1.0e0 / {ref_n})"
        parts.append(f"(case when {a} > 0 then {p} * ln(2.0e0 * {p} / ({p} + {q})) else 0.0e0 end + case when {b} > 0 then {q} * ln(2.0e0 * {q} / ({p} + {q})) else 0.0e0 end)")
    return f"case when {own_n} = 0 or {ref_n} = 0 then 1.0e0 else sqrt(greatest(0.0e0, ({_sum_terms(parts)}) / (2.0e0 * ln(2.0e0)))) end"


def js_distance(own: Column, ref: Column) -> Column:
    """Of two arrays of counts; 1 where either is empty."""
    total = lambda a: F.aggregate(a, F.lit(0).cast("bigint"), lambda s, x: s + x)
    share = lambda a: F.transform(a, lambda x: x.cast("double") / total(a))

    def term(p: Column, q: Column) -> Column:
        part = lambda x: F.when(x > 0, x * F.ln(2 * x / (p + q))).otherwise(0.0)
        return part(p) + part(q)

    d = F.aggregate(F.zip_with(share(own), share(ref), term), F.lit(0.0), lambda s, x: s + x)
    import math

    return F.when((total(own) == 0) | (total(ref) == 0), 1.0).otherwise(F.sqrt(F.greatest(F.lit(0.0), d / (2 * math.log(2)))))


def language(lang: Column) -> Column:
    """Null for none."""
    return F.when(~F.lower(F.trim(lang)).isin(list(UNKNOWN)), lang)


def with_histograms(docs: DataFrame) -> DataFrame:
    """Columns beside the given ones: ``_qr_lang``, ``_qr_n`` (code points), ``_qr_c`` (character classes), ``_qr_w`` (common words, then all others), ``_qr_m`` (words).

    Without a language, ``_qr_all`` has the word histograms of all LISTS, ``_qr_lang`` is the one with most common words, null without any, and ``_qr_latin`` tells whether most letters are Latin."""
    t = F.coalesce(F.col("text"), F.lit(""))
    n = F.length(t)
    without = lambda x, rx: F.length(F.regexp_replace(x, rx, ""))
    counts = F.array(*((n - without(t, rx)).cast("bigint") for rx in CLASSES.values()))
    words = F.trim(F.regexp_replace(F.lower(t), r"[^\p{L}]+", "  "))
    df = docs.withColumns({"_qr_own": language(F.col("lang")), "_qr_n": n.cast("bigint"), "_qr_k": counts, "_qr_t": F.concat(F.lit(" "), words, F.lit(" "))})
    inner, none = F.col("_qr_t"), F.col("_qr_own").isNull()
    listed = F.when(none, F.lit([w for name in LISTS for w in COMMON[name]])).otherwise(F.lit(COMMON["und"]))
    for name, own in COMMON.items():
        if name != "und":
            listed = F.when(F.col("_qr_own") == name, F.lit(own)).otherwise(listed)
    slots = F.transform(listed, lambda w: ((F.length(inner) - F.length(F.replace(inner, F.concat(F.lit(" "), w, F.lit(" ")), F.lit("")))) / (F.length(w) + 2)).cast("bigint"))
    total = F.when(F.length(inner) <= 2, 0).otherwise((F.length(inner) - F.length(F.replace(inner, F.lit("  "), F.lit("")))) / 2 + 1).cast("bigint")
    latin = F.when(none, 2 * (F.length(inner) - without(inner, r"\p{IsLatin}+")) >= F.length(inner) - without(inner, r"\p{L}+"))
    df = df.withColumns({"_qr_s": slots, "_qr_m": total, "_qr_latin": latin})
    held = lambda a: F.aggregate(a, F.lit(0).cast("bigint"), lambda s, x: s + x)
    rest = lambda a, n: F.array_append(a, F.col(n) - held(a))
    part = {name: F.slice("_qr_s", 1 + i * SLOTS, SLOTS) for i, name in enumerate(LISTS)}
    most = F.array_max(F.array(*(F.struct(held(part[name]).alias("n"), F.lit(-i).alias("i")) for i, name in enumerate(LISTS) if name != "und")))
    df = df.withColumns({"_qr_c": rest(F.col("_qr_k"), "_qr_n"), "_qr_all": F.when(none, F.array(*(rest(part[name], "_qr_m") for name in LISTS))), "_qr_most": F.when(none, most)})
    guess = F.when(F.col("_qr_most.n") > 0, -F.col("_qr_most.i"))
    lang = F.when(none, F.get(F.lit(LISTS), guess)).otherwise(F.col("_qr_own"))
    return df.withColumns({"_qr_lang": lang, "_qr_w": F.when(none, F.get(F.col("_qr_all"), guess)).otherwise(rest(F.col("_qr_s"), "_qr_m"))}).drop("_qr_own", "_qr_k", "_qr_t", "_qr_s", "_qr_most")


def _summed(h: DataFrame) -> dict[tuple[str, bool], tuple[list[int], list[int]]]:
    """By language, and whether its documents are labelled with it; a row for each of these reaches the driver."""
    sums = [F.sum(F.get(F.col(a), F.lit(i))).alias(f"{a}{i}") for a, k in (("_qr_c", len(CHAR_COLS)), ("_qr_w", len(WORD_COLS))) for i in range(k)]
    rows = h.filter("_qr_lang is not null").groupBy("_qr_lang", F.col("_qr_all").isNull().alias("_qr_known")).agg(*sums).collect()
    return {(r["_qr_lang"], r["_qr_known"]): ([r[f"_qr_c{i}"] for i in range(len(CHAR_COLS))], [r[f"_qr_w{i}"] for i in range(len(WORD_COLS))]) for r in rows}


def _literal(counts: list[int]) -> Column:
    return F.array(*(F.lit(int(x)).cast("bigint") for x in counts))


def _of(refs: dict, i: int) -> Column:
    """Of the document's language; empty where that has none."""
    none = F.array().cast("array<bigint>")
    if not refs:
        return none
    return F.coalesce(F.element_at(F.create_map(*(x for k, v in sorted(refs.items()) for x in (F.lit(k), _literal(v[i])))), F.col("_qr_lang")), none)


def _distances(h: DataFrame, refs: dict) -> DataFrame:
    """From the reference of the language, labelled or found."""
    return h.withColumns({f"_qr_d{c}": F.round(js_distance(F.col(f"_qr_{c}"), _of(refs, i)), 6) for i, c in enumerate("cw")})


def references(h: DataFrame) -> dict[str, tuple[list[int], list[int]]]:
    """By language, from a table of histograms: first of all documents, then of those that aren't far from that first reference, so that junk doesn't shape what it is measured against."""
    first = _summed(h)
    refs = {k: v for (k, known), v in first.items() if known or (k, True) not in first}
    trimmed = _summed(_distances(h, refs).filter((F.col("_qr_dc") <= TRIM_CHAR) & (F.col("_qr_dw") <= TRIM_WORD)))
    return refs | {k: v for (k, known), v in trimmed.items() if known or (k, True) not in first}


def _judged(h: DataFrame, refs: dict) -> DataFrame:
    """Distances of a document with a language from that one's reference, of another from the nearest."""
    df = _distances(h, refs)
    near = F.lit(None).cast("struct<d:double,c:double,w:double>")
    if refs:
        all_refs = F.array(*(F.struct(_literal(c).alias("c"), _literal(w).alias("w"), F.lit(LISTS.index(k if k in COMMON else "und")).alias("i")) for k, (c, w) in sorted(refs.items())))
        each = F.transform(all_refs, lambda r: F.struct(F.round(js_distance(F.col("_qr_c"), r["c"]), 6).alias("c"), F.round(js_distance(F.get(F.col("_qr_all"), r["i"]), r["w"]), 6).alias("w")))
        near = F.array_min(F.transform(each, lambda x: F.struct((x["c"] + x["w"]).alias("d"), x["c"].alias("c"), x["w"].alias("w"))))
    none = F.col("_qr_all").isNotNull()
    df = df.withColumn("_qr_near", F.when(none, near))
    return df.withColumns({f"_qr_d{c}": F.when(none, F.col(f"_qr_near.{c}")).otherwise(F.col(f"_qr_d{c}")) for c in "cw"}).drop("_qr_near")


def histograms(docs: DataFrame) -> DataFrame:
    """Written once: the references and the verdicts both read it, and it has some 200 bytes a document."""
    return scratch(with_histograms(docs.select("doc_id", "text", "lang")).drop("text", "lang"), "histograms")


def _reason(h: DataFrame, refs: dict) -> DataFrame:
    """Adds _qr_reason, _qr_dc, _qr_dw."""
    n = F.col("_qr_n")
    judged = F.coalesce(F.col("_qr_latin"), F.lit(True))
    reason = (
        F.when(n - F.get(F.col("_qr_c"), F.lit(3)) <= 0, "empty")
        .when(judged & (n >= MIN_CHARS) & (F.col("_qr_dc") > CHAR_LIMIT + CHAR_SLACK / F.sqrt(n)), "characters")
        .when(judged & (F.col("_qr_m") >= MIN_WORDS) & (F.col("_qr_dw") > WORD_LIMIT + WORD_SLACK / F.sqrt(F.col("_qr_m"))), "words")
        .when((n < MIN_CHARS) & (F.col("_qr_m") < MIN_WORDS), "short")
        .otherwise("ok")
    )
    return _judged(h, refs).withColumn("_qr_reason", reason)


def quality_rules(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, n_words, d_char, d_word, reason, keep for every row."""
    h = histograms(docs)
    r = _reason(h, references(h))
    return r.select("doc_id", F.col("_qr_n").alias("n_chars"), F.col("_qr_m").alias("n_words"), F.col("_qr_dc").alias("d_char"), F.col("_qr_dw").alias("d_word"), F.col("_qr_reason").alias("reason"), F.col("_qr_reason").isin("ok", "short").alias("keep"))


def _same(prefix: str) -> dict[str, Column]:
    """The verdict depends on text and language alone; this is their hash of 128 bits."""
    return {f"{prefix}a": F.xxhash64("text", "lang"), f"{prefix}b": F.xxhash64(F.lit(7919), "lang", "text")}


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows that the rules keep, with their columns as they came."""
    src = docs.select("text", "lang").withColumns(_same("_qr_"))
    h = scratch(with_histograms(src).drop("text", "lang"), "histograms")
    bad = scratch(_reason(h, references(h)).filter(~F.col("_qr_reason").isin("ok", "short")).select("_qr_a", "_qr_b").distinct(), "rejected")
    own = _same("_qr_k")
    return docs.join(side(bad), (own["_qr_ka"] == bad["_qr_a"]) & (own["_qr_kb"] == bad["_qr_b"]), "left_anti")


def _sql() -> str:
    """For tables whose languages are those of COMMON's lists, as the given ones."""
    case = lambda k: "case lang " + " ".join(f"when '{n}' then ' {w[k]} '" for n, w in COMMON.items() if n != "und") + f" else ' {COMMON['und'][k]} ' end"
    quote = lambda rx: rx.replace("'", "''")
    count = ", ".join(f"cast(length(t) - length(regexp_replace(t, '{quote(rx)}', '', 'g')) as bigint) as {k}" for k, rx in zip(CHAR_COLS, CLASSES.values(), strict=False))
    slots = ", ".join(f"cast((length(words) - length(replace(words, {case(k)}, ''))) // length({case(k)}) as bigint) as {WORD_COLS[k]}" for k in range(SLOTS))
    sums = ", ".join(f"cast(sum({k}) as bigint) as {k}" for k in [*CHAR_COLS, *WORD_COLS, "n_chars", "n_words"])
    listed = ", ".join(f"'{k}'" for k in COMMON if k != "und")
    return f"""
with a as (select doc_id, coalesce(text, '') as t, case when lang in ({listed}) then lang else 'und' end as lang from documents),
b as (select doc_id, lang, cast(length(t) as bigint) as n_chars, {count}, ' ' || trim(regexp_replace(lower(t), '[^\\p{{L}}]+', '  ', 'g')) || ' ' as words from a),
c as (select *, n_chars - ({" + ".join(CHAR_COLS[:-1])}) as {CHAR_COLS[-1]}, case when length(words) <= 2 then 0 else (length(words) - length(replace(words, '  ', ''))) // 2 + 1 end as n_words, {slots} from b),
h as (select *, n_words - ({" + ".join(WORD_COLS[:-1])}) as {WORD_COLS[-1]} from c),
e as (select lang, {sums} from h group by lang),
g as (select h.* from h join e using (lang) where round({sql_distance([f"h.{k}" for k in CHAR_COLS], [f"e.{k}" for k in CHAR_COLS], "h.n_chars", "e.n_chars")}, 6) <= {TRIM_CHAR}
 and round({sql_distance([f"h.{k}" for k in WORD_COLS], [f"e.{k}" for k in WORD_COLS], "h.n_words", "e.n_words")}, 6) <= {TRIM_WORD}),
f as (select lang, {sums} from g group by lang),
d as (select h.doc_id, h.n_chars, cast(h.n_words as bigint) as n_words, h.c3,
 round({sql_distance([f"h.{k}" for k in CHAR_COLS], [f"coalesce(f.{k}, 0)" for k in CHAR_COLS], "h.n_chars", "coalesce(f.n_chars, 0)")}, 6) as d_char,
 round({sql_distance([f"h.{k}" for k in WORD_COLS], [f"coalesce(f.{k}, 0)" for k in WORD_COLS], "h.n_words", "coalesce(f.n_words, 0)")}, 6) as d_word
 from h left join f on h.lang = f.lang),
r as (select doc_id, n_chars, n_words, d_char, d_word, case when n_chars - c3 <= 0 then 'empty'
 when n_chars >= {MIN_CHARS} and d_char > {CHAR_LIMIT} + {CHAR_SLACK} / sqrt(n_chars) then 'characters'
 when n_words >= {MIN_WORDS} and d_word > {WORD_LIMIT} + {WORD_SLACK} / sqrt(n_words) then 'words'
 when n_chars < {MIN_CHARS} and n_words < {MIN_WORDS} then 'short' else 'ok' end as reason from d)
select *, reason in ('ok', 'short') as keep from r"""


SQL = _sql()
