"""Line de-duplication by overlapping windows of three lines.

A document's lines are cut at ``\\n``; blank lines (nothing but white space) take no part and are
always kept.  Every three consecutive other lines form a window, hashed to 128 bits after trimming.
A window that occurs more than once anywhere keeps its first occurrence, in the order of doc_id,
text hash and position; the lines that its later occurrences cover are removed, where overlapping
occurrences merge into one covered stretch.  The content of a removed line always stays at an
earlier place.

Defined results: null text stays null; texts of fewer than three such lines have no window and
stay as they are; a text of which all lines go becomes empty; null doc_id sorts first; rows
that agree in doc_id and text are one occurrence, treated alike; rows that share a doc_id only
are told apart by their text; an empty table gives an empty one; other columns pass through untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WIDTH = 3


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _hash(*cols: Column) -> Column:
    """128 bits."""
    return F.struct(F.xxhash64(*cols).alias("a"), F.xxhash64(F.lit(7919), *reversed(cols)).alias("b"))


def windows(docs: DataFrame) -> DataFrame:
    """doc_id, t (text hash), k (number of the window's first line among the lines that aren't blank), h (window hash)."""
    lines = F.filter(F.transform(_lines(F.col("text")), lambda x: F.btrim(x, F.lit(" \t\r\f"))), lambda x: x != "")
    df = docs.select("doc_id", _hash(F.col("text")).alias("t"), lines.alias("l")).filter(F.size("l") >= WIDTH)
    df = df.select("doc_id", "t", F.transform("l", lambda x: F.struct(F.xxhash64(x).alias("a"), F.xxhash64(F.lit(7919), x).alias("b"))).alias("l"))
    starts = F.sequence(F.lit(0), F.size("l") - WIDTH)
    h = F.transform(starts, lambda i: F.struct(*(F.xxhash64(*(F.get(F.col("l"), i + j)[s] for j in range(WIDTH))).alias(s) for s in ("a", "b"))))
    return df.select("doc_id", "t", F.posexplode(h).alias("k", "h"))


def covered(docs: DataFrame) -> DataFrame:
    """doc_id, t, gone: the sorted numbers of the lines that later occurrences cover."""
    w = windows(docs)
    first = w.groupBy("h").agg(F.min(F.struct("doc_id", "t", "k")).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.col("h").alias("h1"), "first")
    later = w.join(first, F.col("h") == F.col("h1")).filter(F.struct("doc_id", "t", "k") > F.col("first"))
    reach = F.array_sort(F.collect_set("k"))
    gone = F.array_sort(F.array_distinct(F.flatten(F.transform("starts", lambda k: F.sequence(k, k + WIDTH - 1)))))
    return later.groupBy("doc_id", "t").agg(reach.alias("starts")).select("doc_id", "t", gone.alias("gone"))


def _apply(docs: DataFrame) -> DataFrame:
    """The columns of docs, beside _removed; they travel in one struct, so that none of them clashes with what is added."""
    gone = covered(docs.select("doc_id", "text"))
    row = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col("text").alias("x"), _hash(F.col("text")).alias("th"))
    df = row.join(gone.hint("shuffle_hash"), F.col("row")["doc_id"].eqNullSafe(F.col("doc_id")) & (F.col("th") == F.col("t")), "left")
    blank = lambda x: F.btrim(x, F.lit(" \t\r\f")) == ""
    # Numbers of the lines that aren't blank: one walk over the flags, then the kept lines are put together again.
    number = F.aggregate(
        _lines(F.col("x")),
        F.struct(F.lit(0).alias("n"), F.array().cast("array<string>").alias("kept")),
        lambda s, x: F.struct(
            (s["n"] + F.when(blank(x), 0).otherwise(1)).alias("n"),
            F.when(~blank(x) & F.array_contains(F.col("gone"), s["n"]), s["kept"]).otherwise(F.array_append(s["kept"], x)).alias("kept"),
        ),
    )["kept"]
    df = df.select("row", F.when(F.col("gone").isNull(), F.col("x")).otherwise(F.array_join(number, "\n")).alias("new"), F.coalesce(F.size("gone"), F.lit(0)).alias("removed"))
    new = {"text": F.col("new")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.length("new").cast(docs.schema["n_chars"].dataType)
    return df.select(*(new.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns), F.col("removed").alias("_removed"))


def dedup_lines(docs: DataFrame) -> DataFrame:
    """The documents with ``text`` cut, ``n_chars`` (if there) set anew, and every other column as it was."""
    df = _apply(docs)
    return df.toDF(*(f"c{i}" for i in range(len(df.columns)))).drop(f"c{len(docs.columns)}").toDF(*docs.columns)


def line_dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_removed, text for every row."""
    return _apply(docs.select("doc_id", "text")).select("doc_id", F.col("_removed").cast("bigint").alias("n_removed"), "text")


SQL = r"""
with l as (select doc_id, unnest(string_split(text, chr(10))) as line, unnest(range(len(string_split(text, chr(10))))) as pos from documents where text is not null),
n as (select doc_id, line, pos, trim(line, chr(32) || chr(9) || chr(13) || chr(12)) as body, trim(line, chr(32) || chr(9) || chr(13) || chr(12)) = '' as blank from l),
k as (select doc_id, body, pos, row_number() over (partition by doc_id order by pos) - 1 as k from n where not blank),
w as (select doc_id, k, body || chr(10) || lead(body) over d || chr(10) || lead(body, 2) over d as h from k window d as (partition by doc_id order by k)),
r as (select doc_id, k, row_number() over (partition by h order by doc_id, k) as nth from w where h is not null),
gone as (select distinct doc_id, k + j as k from r, (select unnest(range(3)) as j) where nth > 1),
kept as (select n.doc_id, string_agg(n.line, chr(10) order by n.pos) filter (where gone.k is null) as text, count(gone.k) as n_removed
 from n left join k on n.doc_id = k.doc_id and n.pos = k.pos left join gone on gone.doc_id = k.doc_id and gone.k = k.k group by n.doc_id)
select d.doc_id, cast(coalesce(n_removed, 0) as bigint) as n_removed, case when d.text is null then null else coalesce(kept.text, '') end as text from documents d left join kept using (doc_id)"""
